"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of text and media-reference structs; a join on the payload's
digest resolves each reference, and position and caption stay with it. Payloads are stored as
8-bit RGB samples of a PNG file (lossless), whose sample bytes are read back from the stored file.

Defined results: null or empty HTML gives an empty sequence; a reference whose digest no payload
has keeps its place with null payload columns; repeated references and repeated rows are kept;
payloads that repeat a digest count once. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch

#: Samples of a row of the stored picture: 64 pixels of three 8-bit samples.
ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def padded(payload: bytes) -> bytes:
    """The payload with spaces up to a positive multiple of ROW."""
    return payload + b" " * (ROW - len(payload) if not payload else -len(payload) % ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: bytes) -> bytes:
    """A PNG file, 64 pixels wide, whose samples are these bytes; their number is a multiple of ROW."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered, 1)) + _chunk(b"IEND", b"")


def read_png(stored: bytes) -> np.ndarray:
    """The samples, one row of ROW bytes for each row of pixels; ValueError where the file is damaged."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, height, data = 8, 0, []
    while at < len(stored):
        (length,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + length : at + 12 + length])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (ROW // 3, 8, 2):
                raise ValueError("other kind of picture")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Mean and standard deviation of each colour in 1/1000, and the entropy of all samples in 1/1000 bit, as integers."""
    colours = samples.reshape(-1, 3)
    counts = np.stack([np.bincount(colours[:, c], minlength=256) for c in range(3)]).astype(np.int64)
    n, values = len(colours), np.arange(256, dtype=np.int64)
    sums, squares = counts @ values, counts @ (values * values)
    mean = sums / n
    deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    share = counts.sum(0)[counts.sum(0) > 0] / (3 * n)
    entropy = float(-(share * np.log2(share)).sum())
    return "rgb_mean=" + ":".join(str(round(float(m) * 1000)) for m in mean) + ";rgb_std=" + ":".join(str(round(float(d) * 1000)) for d in deviation) + f";entropy={round(entropy * 1000)}"


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(id, digest, the columns of MEDIA, with keep_media also media binary): each text's bytes stored as a PNG and read back.

    digest: SHA-256 of the text's bytes, by which references name it. Null counts as an empty text.
    """
    schema = f"id long, digest string, {MEDIA}" + ", media binary" * keep_media

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, media = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            payload = text or b""
            stored = write_png(padded(payload))
            samples = read_png(stored)
            back = samples.tobytes()
            rows.append((hashlib.sha256(payload).hexdigest(), len(payload), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(samples)))
            media += [stored] * keep_media
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        columns = {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds))}
        return record_batch(id=batch.column(0), **columns, **({"media": pa.array(media, pa.binary())} if keep_media else {}))

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


class _Reader(HTMLParser):
    """Collects text runs and media references in the order of the page."""

    BLOCKS = frozenset("p div section article figure figcaption li ul ol table tr td th h1 h2 h3 h4 h5 h6 br hr blockquote pre header footer main nav aside".split())
    SILENT = frozenset(("script", "style", "noscript", "template"))
    MEDIA_TAGS = frozenset(("img", "source", "video", "audio", "embed"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None  # items of the open figure
        self.caption: list[str] | None = None

    def _end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS:
            self._end_run()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA_TAGS:
            given = dict(attrs)
            address = given.get("src") or given.get("data-src") or ""
            found = re.search(r"(?:sha256[:/-])([0-9a-fA-F]{64})", address)
            if address:
                self._end_run()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": address, "digest": found[1].lower() if found else None, "caption": given.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for n in (self.figure or []) if said else []:
                self.items[n]["caption"] = said
            self.caption = None
        elif tag == "figure":
            self.figure = self.caption = None
        if tag in self.BLOCKS:
            self._end_run()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)

    def sequence(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._end_run()
        return [{"position": n, **item} for n, item in enumerate(self.items)]


def interleave(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, sequence): each page's text runs and media references in order. Captions come from figcaption, else from alt."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(id=batch.column(0), sequence=pa.array([_Reader().sequence(h or "") for h in batch.column(1).to_pylist()], pa.list_(ITEM)))

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), run, f"id long, sequence {SEQUENCE}").withColumnRenamed("id", id_col)


def references(sequences: DataFrame, id_col: str) -> DataFrame:
    """(id, position, address, digest, caption): a row for each media item."""
    item = sequences.select(id_col, F.explode("sequence").alias("item")).where("item.kind = 'media'")
    return item.select(id_col, "item.position", F.col("item.text").alias("address"), "item.digest", "item.caption")


def resolve(sequences: DataFrame, payloads: DataFrame, id_col: str) -> DataFrame:
    """references() joined to payloads by digest: every reference stays, its payload columns null where none has its digest.

    payloads: a digest column and any others, of which a digest's smallest row is taken.
    """
    others = [c for c in payloads.columns if c != "digest"]
    one = payloads.where("digest is not null").groupBy("digest").agg(F.min(F.struct(*others)).alias("payload"))
    return references(sequences, id_col).join(one, "digest", "left").select(id_col, "position", "address", "digest", "caption", "payload.*")
