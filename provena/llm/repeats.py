"""Repeated byte windows by a depth-limited radix sort of suffixes.

A window is WINDOW bytes of one document. Windows are ordered only by their first WINDOW bytes, in
most-significant-digit passes: a pass reads the next digit of what is left, refines every group by
it, and whatever is alone in its group leaves. The groups that stay equal to the end are exactly the
repeated windows.

So that not every byte of the corpus is a row, every window chooses an anchor, the leftmost least
hash of its GRAM-byte strings. Equal windows choose the same string at the same place, so windows
need only be compared with those of equal anchors, and their digits are read from the anchor
outwards. The windows that choose one anchor start side by side, up to REACH bytes before it, and
share their first digits; they are rows together until digits part them.

Digit 1: the anchor's GRAM bytes. Digit 2: the longer bytes that its windows must hold, SIDE before
the anchor or RIGHT from it on. Digit 3: the whole context, all bytes of the windows that choose the
anchor; all windows of a repeated context are repeated, and one copy of it goes on as a witness.
Then passes over runs of STEPS neighbouring windows, long ones first: the digit is what the run's
windows have in common. Runs with an equal digit stay; if even all bytes of the run are repeated, it
is decided; groups with an undecided run are cut into shorter runs, down to single windows.

Digits that only tell what may stay are 64-bit hashes; those that decide are 128-bit BLAKE2 digests.
Texts are laid out once, in buckets by a key of id and text, and passes read that layout beside
lists of positions, so that only positions are shuffled, whatever the size of the tables.

Defined results: null counts as an empty text; texts under WINDOW bytes hold no window and lose
nothing; rows that repeat an id are each an occurrence, so their windows are repeated; rows are told
apart by a key of id and text, so an id may be null or have several texts; a very long text is
hashed PART bytes at a time; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, utf8_buffer
from .rowkey import row_key
from .staging import shared_folder, staged

WINDOW, GRAM = 400, 32
#: Windows of a run, pass by pass.
STEPS = 48, 12, 3, 1
REACH = WINDOW - GRAM  # an anchor's windows start 0 to REACH bytes before it
SIDE = 168  # a window that starts SIDE bytes or more before its anchor holds those; any other holds RIGHT bytes from the anchor on
RIGHT = WINDOW - SIDE + 1
#: Bytes that are hashed at once.
PART = 1 << 20
_B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _D
    return h ^ (h >> np.uint64(32))


_VALUE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(7)) * _C)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any substring of a buffer, from sums over its prefixes."""

    power, inverse = _powers(int(_B), 1), _powers(1, 1)

    def __init__(self, raw: np.ndarray) -> None:
        if len(raw) >= len(Hashes.power):
            Hashes.power = _powers(int(_B), max(len(raw) + 1, 4096))
            Hashes.inverse = _powers(pow(int(_B), -1, 1 << 64), len(Hashes.power))
        self.upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * Hashes.power[: len(raw)], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """The hash of raw[start:end], the same wherever it stands, never 0."""
        return _mixed((self.upto[end] - self.upto[start]) * Hashes.inverse[start] + (end - start).astype(np.uint64) * _C + _VALUE[salt]) | np.uint64(1)


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> pa.Array:
    """128-bit digests of raw[start:end], and of where the anchor stands in it."""
    view = memoryview(np.ascontiguousarray(raw))
    return pa.array([hashlib.blake2b(view[s:e], digest_size=16, salt=int(n).to_bytes(4, "little")).digest() for s, e, n in zip(start.tolist(), end.tolist(), salt.tolist())], pa.binary())


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie in one text, and the first and last start of the windows that choose each; ends: the texts' ends in raw, which holds them one after another."""
    found = []
    for at in range(0, max(len(raw) - WINDOW + 1, 0), PART):
        part = raw[at : at + PART + WINDOW - 1]
        h, step, width = part.astype(np.uint64) * _C + np.uint64(1), _B, 1
        while width < GRAM:
            h = h[:-width] * step + h[width:]
            step = np.uint64((int(step) * int(step)) & 0xFFFFFFFFFFFFFFFF)
            width *= 2
        least = (_mixed(h) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, need = 1, REACH + 1
        while width < need:
            shift = min(width, need - width)
            least = np.minimum(least[:-shift], least[shift:])
            width += shift
        starts = np.arange(at, at + len(least))
        starts = starts[starts + WINDOW <= ends[np.searchsorted(ends, starts, "right")]]
        places = (least[starts - at] & _PLACE).astype(np.int64) + at
        if len(places):
            edge = np.flatnonzero(places[1:] != places[:-1])
            found.append((places[np.append(edge, len(places) - 1)], starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, first, last = (np.concatenate(c) for c in zip(*found))
    edge = np.flatnonzero(places[1:] != places[:-1])  # an anchor of windows in two parts is one
    return places[np.append(edge, len(places) - 1)], first[np.append(0, edge + 1)], last[np.append(edge, len(last) - 1)]


def _anchor_rows(documents: DataFrame) -> DataFrame:
    """A row for each anchor of documents (id, text): id, place, low and high (its windows start so many bytes before it), gram, left and right (null: no window holds them), context."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offsets = utf8_buffer(batch.column(1))
        every, first, last = anchors(raw, offsets[1:])
        if not len(every):
            return None
        owner = np.searchsorted(offsets[1:], every, "right")
        gram, left, right = (np.zeros(len(every), np.uint64) for _ in range(3))
        on_left, on_right = every - first >= SIDE, every - last < SIDE
        for part in np.split(np.arange(len(every)), np.flatnonzero(np.diff(first // PART)) + 1):
            begin = int(first[part].min())
            hashes = Hashes(raw[begin : int(last[part].max()) + WINDOW])
            place = every[part] - begin
            gram[part] = hashes.of(place, place + GRAM)
            left[part] = hashes.of(place - np.where(on_left[part], SIDE, 0), place + GRAM)
            right[part] = hashes.of(place, place + np.where(on_right[part], RIGHT, GRAM))
        context = _digests(raw, first, last + WINDOW, every - first)
        int32 = lambda v: pa.array(v.astype(np.int32))
        side = lambda v, there: pa.array(v.view(np.int64), mask=~there)
        return record_batch(id=batch.column(0).take(pa.array(owner)), place=int32(every - offsets[owner]), low=int32(every - last), high=int32(every - first), gram=pa.array(gram.view(np.int64)), left=side(left, on_left), right=side(right, on_right), context=context)

    return map_batches(documents, run, "id long, place int, low int, high int, gram long, left long, right long, context binary")


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each item, count of them, one item after another."""
    return np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _runs(documents: DataFrame, lists: DataFrame, step: int) -> DataFrame:
    """The runs of step windows of the listed anchors (id, items array<struct<place,low,high,known>>): id, place, low, high, known, inner (what its windows have in common) and outer (all their bytes; null: not in the text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for n in range(batch.num_rows):
            raw = np.frombuffer(batch.column(1)[n].as_buffer(), np.uint8)
            item = batch.column(2)[n].values
            rows = np.stack([item.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0] // PART)) + 1, axis=1):
                parts.append((batch.column(0)[n], *_runs_of(raw, *part, step)))
        if not parts:
            return None
        owner = pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts]))
        ids = pa.array([p[0].as_py() for p in parts], pa.int64()).take(owner)
        int32 = [pa.array(np.concatenate(c).astype(np.int32)) for c in list(zip(*parts))[1:5]]
        inner = pa.array(np.concatenate([p[5] for p in parts]).view(np.int64))
        return pa.RecordBatch.from_arrays([ids, *int32, inner, pa.concat_arrays([p[6] for p in parts])], names=["id", "place", "low", "high", "known", "inner", "outer"])

    return map_batches(documents.select("id", "text").join(lists, "id"), run, "id long, place int, low int, high int, known int, inner long, outer binary")


def _runs_of(text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, step: int) -> tuple:
    """The columns of _runs() for neighbouring anchors of one text."""
    begin = max(int(place.min()) - REACH, 0)
    raw = text[begin : int(place.max()) + WINDOW]
    place = place - begin
    hashes, count = Hashes(raw), high // step - low // step + 1
    run = _spread(low // step, count)
    place, low, high, known = (np.repeat(v, count) for v in (place, low, high, known))
    near, far = run * step, np.minimum(run * step + step - 1, REACH)
    inner = hashes.of(place - near, place - far + WINDOW) + run.astype(np.uint64) * _D
    full = (place - far >= 0) & (place - near + WINDOW <= len(raw))
    outer = _digests(raw, np.where(full, place - far, 0), np.where(full, place - near + WINDOW, 0), far)
    outer = pc.if_else(pa.array(full), outer, pa.scalar(None, pa.binary()))
    return place + begin, np.maximum(low, near), np.minimum(high, far), known, inner, outer


def _repeated(rows: DataFrame, digit: str) -> DataFrame:
    """The values of digit that rows share. Staged, as is all that rows meet by a digit: rows of a very common one are split over tasks only if both sides of the join are plain exchanges."""
    shared = rows.where(F.col(digit).isNotNull()).groupBy(digit).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(digit)
    return staged(shared, f"repeats-{digit}")


def _items(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_list(F.struct("place", "low", "high", "known")).alias("items"))


def laid_out(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, text): documents by row key, in a table of buckets in the shared folder; joins by id don't shuffle its texts."""
    spark = documents.sparkSession
    name, buckets = f"repeats_texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(row_key(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    writer = rows.repartition(buckets, "id").write.format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, "id").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _spread_nulls(digit: str) -> Column:
    """The digit, or one of the row's own where it has none, so that rows without one don't meet."""
    return F.coalesce(digit, F.xxhash64("id", "place", F.lit(digit)))


def repeated_spans(laid: DataFrame) -> DataFrame:
    """(id, start, end), for documents as laid_out(): bytes that windows repeated anywhere cover; spans may overlap. Rows of documents without any are absent."""
    every = staged(_anchor_rows(laid.select("id", "text")), "repeats-anchors")
    rows = staged(every.join(_repeated(every, "gram"), "gram").drop("gram"), "repeats-grams")
    sides = rows
    for side in ("left", "right"):
        there = _repeated(rows, side).select(F.col(side).alias(f"__{side}"))
        sides = sides.withColumn(side, _spread_nulls(side)).join(there, F.col(side) == F.col(f"__{side}"), "left")
    rows = staged(sides.where("__left IS NOT NULL OR __right IS NOT NULL").select("id", "place", "low", "high", "context"), "repeats-sides")
    span = [(F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + WINDOW).alias("end")]

    contexts = staged(rows.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first")), "repeats-copies")
    judged = staged(rows.join(contexts, "context").drop("context"), "repeats-contexts")
    found = judged.where("n > 1").select("id", *span)
    witnesses = judged.where((F.col("n") == 1) | ((F.col("id") == F.col("first.id")) & (F.col("place") == F.col("first.place"))))
    left = witnesses.withColumn("known", (F.col("n") > 1).cast("int"))
    for step in STEPS:
        runs = staged(_runs(laid, _items(left), step), f"repeats-runs-{step}")
        shared = staged(runs.join(_repeated(runs, "inner"), "inner"), f"repeats-shared-{step}")
        outer = _repeated(shared, "outer").withColumnRenamed("outer", "__outer")
        spread = F.coalesce("outer", F.xxhash64("id", "place", "low").cast("string").cast("binary"))
        judged = shared.withColumn("outer", spread).join(outer, F.col("outer") == F.col("__outer"), "left")
        judged = staged(judged.select("id", "place", "low", "high", "known", "inner", F.col("__outer").isNotNull().alias("decided")), f"repeats-judged-{step}")
        found = found.union(judged.where("decided and known = 0").select("id", *span))
        undecided = staged(judged.where("not decided and known = 0").select("inner").distinct(), f"repeats-undecided-{step}")
        left = judged.join(undecided, "inner").withColumn("known", F.greatest("known", F.col("decided").cast("int")))
    return found


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept binary (the other bytes)."""
    laid = laid_out(documents, id_col, text_col)
    spans = repeated_spans(laid).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, counts, kept = [], [], [], []
        for n in range(batch.num_rows):
            raw = batch.column(1)[n].as_py().encode()
            item = batch.column(3)[n].values
            found = sorted(zip(item.field(0).to_pylist(), item.field(1).to_pylist())) if item is not None else []
            merged: list[list[int]] = []
            for start, end in found:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            at, rest = 0, []
            for start, end in merged:
                rest.append(raw[at:start])
                at = end
            sizes.append(len(raw))
            removed.append(sum(e - s for s, e in merged))
            counts.append(len(merged))
            kept.append(b"".join([*rest, raw[at:]]))
        long = lambda values: pa.array(values, pa.int64())
        return record_batch(id=batch.column(2), n_bytes=long(sizes), n_removed=long(removed), n_spans=long(counts), kept=pa.array(kept, pa.binary()))

    out = map_batches(laid.select("id", "text", "own").join(spans, "id", "left"), cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
