"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Equal
fingerprints form one class and go on once. The 64 bits are cut into BLOCKS blocks; of two
fingerprints that differ in at most BITS bits, at least BLOCKS - BITS blocks agree, so classes are
joined on every such choice of blocks (six keys of 32 bits each) and pairs are verified by their
Hamming distance inside the join: only links leave it.

A key that more than CROWD classes share is not joined with itself. There each class also stands
under every value that it reaches by changing none or one of the bits outside the key; two classes
are within two bits of each other exactly if they meet under such a value, and no more than 33
classes ever do. So the work grows with the number of classes, not with the square of a key's.

Defined results: null texts and texts without words have the fingerprint zero and are linked like
any other; fewer words than a shingle has make one shingle; repeated rows, and rows that share an id,
are rows of their own, each with its own text's component; a component's id is its smallest doc_id,
null only if it has none; an empty table gives an empty table; extra columns are ignored; a very long
text is hashed in runs of AT_ONCE shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch
from .components import components
from .staging import staged

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ, blocks of a fingerprint.
WIDTH, SEED, BITS, BLOCKS = 3, 42, 2, 4
#: Classes of one key that are still compared with each other; shingles that are hashed at once.
CROWD, AT_ONCE = 256, 200_000
#: Bits of each key: those of the blocks that are chosen.
SIZE = 64 // BLOCKS
KEYS = [sum(((1 << SIZE) - 1) << SIZE * b for b in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - BITS)]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - WIDTH + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(WIDTH, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long of the same 64 bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return record_batch(id=batch.column("id"), fp=pa.array(found.view(np.int64)))

    kind = documents.schema[id_col].dataType.simpleString()
    return map_batches(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(classes: DataFrame) -> DataFrame:
    """(a, b) of fingerprints fp that differ in BITS bits or fewer, not necessarily all pairs of a crowded key, but all connections."""
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(KEYS)])).alias("b")).select("fp", "b.*")
    counted = staged(keyed.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-counts")
    shared = staged(keyed.join(counted, ["key", "value"]), "simhash-blocks")

    few = shared.where(F.col("n") <= CROWD)
    a, b = few.select("key", "value", F.col("fp").alias("a")), few.select("key", "value", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = a.join(b, (a["key"] == b["key"]) & (a["value"] == b["value"]) & (F.col("a") < F.col("b")) & (apart <= BITS)).select("a", "b")

    outside = F.create_map(*[x for k, m in enumerate(KEYS) for x in (F.lit(k), F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << n)) for n in range(64) if not m >> n & 1]))])
    many = shared.where(F.col("n") > CROWD)
    reached = many.select("key", "value", "fp", F.explode(F.element_at(outside, F.col("key"))).alias("change"))
    met = reached.groupBy("key", "value", F.col("fp").bitwiseXOR(F.col("change")).alias("at")).agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    crowded = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where((F.col("a") != F.col("b")) & (apart <= BITS))
    return near.union(crowded).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, fingerprint as 16 hex digits, component_id."""
    marked = staged(fingerprints(documents, id_col, text_col), "simhash-marked")
    classes = staged(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    of = components(staged(links(classes), "simhash-links")).select(F.col("id").alias("fp"), "component")
    grouped = classes.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select(F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
