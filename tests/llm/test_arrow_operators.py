import base64
import hashlib
import re
import zlib

import pytest

from provena.llm import bpe, licenses, media
from provena.llm.queries import QUERIES

from .fixtures import awkward

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["It's  a test. 'll we've x 'S", "á̃ ٠١ Ⅷ \x1c\x0b\x85 end", "<|endoftext|> é" * 3, "\n\n  \n x   ", "Licensed under the Apache License, Version 2.0.", "cc by cc by CC-BY-NC 4.0", "The GNU General Public License; all rights reserved. All rights reserved"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bpe_is_what_tiktoken_gives(spark, tmp_path, tiktoken_encoding):
    df = awkward(spark, TEXTS)
    got = sorted(map(tuple, QUERIES["op9_byte_bpe"](spark, write(spark, df, tmp_path)).collect()))
    want = []
    for row in df.collect():
        ids = tiktoken_encoding.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_plain_pattern_parts_like_the_public_one():
    import regex

    full, plain, odd = regex.compile(public_tokenizers.PATTERN), re.compile(bpe.PLAIN_PATTERN), re.compile(bpe.NOT_PLAIN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        text = f"a{c}b {c}{c} 1{c}  {c}"
        assert odd.search(text) or plain.findall(text) == full.findall(text), hex(ord(c))


def test_bpe_offsets_and_decode(spark):
    df = awkward(spark, TEXTS)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    coded = bpe.encode(df, offsets=True)
    for row in coded.collect():
        at = 0
        for a, b in zip(row.starts, row.ends):
            assert a <= at <= b and b > a
            at = b
        assert at == len(texts[row.doc_id])
    for row in bpe.decode(coded).collect():
        assert row.decoded.decode() == texts[row.doc_id]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [60_000, -1, 64])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd).orderBy("doc_id").collect()] == [b"", b"", b"a"]


def test_media_round_trip(spark, tmp_path):
    df = awkward(spark, TEXTS)
    rows = {r.doc_id: r for r in QUERIES["op7_interleaved_media"](spark, write(spark, df, tmp_path)).collect()}
    assert len(rows) == df.select("doc_id").distinct().count()
    for row in df.collect():
        raw = (row.text or "").encode()
        pad = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        got = rows[row.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        stored = media.write_png(pad)
        assert (got.media_bytes, got.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.read_png(stored).tobytes() == pad
    damaged = bytearray(media.write_png(b"a" * 192))
    damaged[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(damaged))


def test_sequences_keep_order_captions_and_unresolved_references(spark):
    d = "ab" * 32
    html = f'<p>One <b>two</b></p><figure><img src="sha256:{d}" alt="alt"><figcaption>The <i>caption</i></figcaption></figure>tail<script>no()</script><img src="http://x/y.png" alt="plain"><p>end'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    sequences = media.interleave(pages)
    items = {r.page_id: r.sequence for r in sequences.collect()}
    assert [(i.kind, i.text, i.caption) for i in items[1]] == [("text", "One two", None), ("media", f"sha256:{d}", "The caption"), ("text", "tail", None), ("media", "http://x/y.png", "plain"), ("text", "end", None)]
    assert items[2] == [] and items[3] == []
    payloads = spark.createDataFrame([(d, 5), (d, 4), (None, 3)], "digest string, size int")
    found = {(r.page_id, r.position): r["size"] for r in media.resolve(sequences, payloads, "page_id").collect()}
    assert found == {(1, 1): 4, (1, 3): None}


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for n in range(len(words)):
            if words[n : n + len(p)] == p:
                starts.append(n)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark, tmp_path):
    df = awkward(spark, TEXTS)
    rows = QUERIES["op5_license_templates"](spark, write(spark, df, tmp_path)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *brute_phrases(r.text)) for r in df.collect()), key=str)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[104] == "apache-2.0" and labels[105] == "cc-by" and labels[106] == "gpl,proprietary,reserved"
    assert all(0 <= r.score <= 1 for r in rows)


def words(text):
    return text.encode().split()


@pytest.mark.parametrize(
    ("text", "read"),
    [("a x b", 3), ("a b", 2), ("a x y b", 0), ("a x", 0), ("a o p b", 4), ("a o b", 0), ("q a b", 0)],
)
def test_template_automaton(text, read):
    automaton = licenses.compile_template("l", "a", "a [[o p]] b" if "o" in text else "a {{1}} b")
    assert licenses.longest_match(automaton, words(text), 0) == read
