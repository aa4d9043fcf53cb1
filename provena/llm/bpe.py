"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary comes from a public tokenizer file; its path is a parameter. Each match of the
pre-tokenization pattern is encoded on its own, so a worker encodes each distinct piece once with
the tokenizers library and keeps it in a bounded memo. No special tokens are added or recognised.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows give repeated rows; an empty table gives an empty table. Only the id column and the
text column are read, so further columns may have any name.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, map_batches, record_batch, texts

#: Entries of a worker's memo of encoded pieces, and the longest piece that it keeps.
MEMO_ENTRIES, MEMO_LENGTH = 200_000, 40

#: The pattern with the standard library's classes. It parts texts as the public one does where
#: every character is in PLAIN, whose letters, digits and spaces both engines class alike.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-ʯ‐-‧Α-ΡΣ-ϿЀ-ҁ]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces:
    """One worker's tokenizer, its pattern and its memo."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain, self.odd = re.compile(PLAIN_PATTERN), re.compile(NOT_PLAIN)
        self.full = regex.compile(public_tokenizers.PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return (self.full if self.odd.search(text) else self.plain).findall(text)

    def lookup(self, pieces: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """Ids of every piece; the memo itself, or a larger dictionary for this batch alone."""
        new = list(set(chain.from_iterable(pieces)).difference(self.memo))
        known = self.memo
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            encoded = [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            known = {**known} if known is self.memo and len(self.memo) + len(new) > MEMO_ENTRIES else known
            known.update(zip(part, encoded))
        if known is not self.memo or len(self.memo) > MEMO_ENTRIES:
            self.memo = dict(islice(((k, v) for k, v in known.items() if len(k) <= MEMO_LENGTH), MEMO_ENTRIES // 2))
        return known


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return _Pieces(path)


def _character_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    of, vocabulary = _character_bytes(), _pieces(path).tokenizer.get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return table


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row; with offsets also starts and ends, array<int>, in characters.

    A token that holds part of a character's bytes spans that whole character.
    """
    path = path or default_path()
    schema = "id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, counts, starts, ends = _encoded(batch.column(1), path, offsets)
        join = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        out = {"id": batch.column(0), "ids": list_array(join(parts), counts, pa.int32())}
        if offsets:
            out |= {"starts": list_array(join(starts), counts, pa.int32()), "ends": list_array(join(ends), counts, pa.int32())}
        return record_batch(**out)

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def _encoded(column: pa.Array, path: str, offsets: bool = False) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ids of each text, how many, and with offsets each token's first character and the one after its last."""
    worker = _pieces(path)
    split = [worker.split(t) for t in texts(column)]
    known = worker.lookup(split)
    ids = [np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32) for pieces in split]
    spans = [_offsets(pieces, known, token_bytes(path)) for pieces in split] if offsets else []
    return ids, np.array([len(i) for i in ids]), [a for a, _ in spans], [b for _, b in spans]


def _offsets(pieces: list[str], known: dict, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(table[i]) for p in pieces for i in known[p]), np.int64)
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return character[ends - sizes].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of each row of ids: bytes, as tokens may part a character; cast them to string once they are whole.

    Null ids count as none; an id outside the vocabulary stands for no bytes.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = token_bytes(path)
        most = len(table)
        decoded = []
        for n in range(batch.num_rows):
            ids = batch.column(1)[n].values
            values = [] if ids is None else ids.to_numpy(zero_copy_only=False).tolist()
            try:
                decoded.append(b"".join(map(table.__getitem__, values)) if min(values, default=0) >= 0 else b"".join(table[i] for i in values if 0 <= i < most))
            except IndexError:
                decoded.append(b"".join(table[i] for i in values if 0 <= i < most))
        return record_batch(id=batch.column(0), decoded=pa.array(decoded, pa.binary()))

    out = map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "id long, decoded binary")
    return out.select(F.col("id").alias(id_col), "decoded")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): what encode() gives and the bytes that decode() makes of it, in one pass."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, _, _ = _encoded(batch.column(1), path)
        table = token_bytes(path)
        decoded = pa.array([b"".join(map(table.__getitem__, i.tolist())) for i in ids], pa.binary())
        return record_batch(id=batch.column(0), ids=list_array(np.concatenate(ids), counts, pa.int32()), decoded=decoded)

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
