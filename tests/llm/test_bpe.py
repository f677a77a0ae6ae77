"""Encoding against the tiktoken library, decoding as a round trip."""

import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gridweave.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    letters = "abcdeéß漢字́ \t\n '!?123½\U0001f600\x1c\x85"
    made = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(400)]
    return ["", "a", "<|endoftext|>", "I'll we've it's", "aaaa" * 700, "ab" * 2000, " " * 900, "!" * 1300, "x\r\n\r\n  y", "漢" * 600, *made]


def test_ids(reference):
    coder = bpe.load(PATH, PATTERN)
    for t, ids in zip(texts(), coder.encode_texts(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t[:50]
        assert coder.decode(ids) == t.encode()


def test_a_small_cache_and_small_blocks(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    coder = bpe.ByteBPE(PATH, PATTERN)
    for t, ids in zip(texts(), coder.encode_texts(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


def test_digests(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "x"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(map(tuple, bpe.digests(docs, PATH, PATTERN).collect()), key=str)
    want = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_encode_keeps_columns(spark, reference):
    docs = spark.createDataFrame([(1, "Hello world", "s"), (2, None, None)], "doc_id long, text string, decoded string")
    got = bpe.encode(docs.withColumnRenamed("decoded", "source"), PATH, PATTERN, keep=("doc_id", "source")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.source, r.ids, r.decoded) for r in got] == [(1, "s", reference.encode_ordinary("Hello world"), "Hello world"), (2, None, [], "")]


def test_a_batch_is_cut_before_its_texts_become_strings(spark, monkeypatch):
    """A kept text travels to the workers once, and of a large batch a worker holds some texts at a time."""
    docs, sent = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: sent.append((self.columns, run)) or real(self, run, schema))
    bpe.encode(docs, PATH, PATTERN, keep=("doc_id", "source", "text"))
    columns, run = sent[0]
    assert len(columns) == 3
    text = "some words that come again and again " * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["s"] * 2000), pa.array([text] * 2000)], names=columns)
    bpe.load(PATH, PATTERN)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 30_000_000  # the batch's texts are 44 MB


def test_only_new_neighbours_are_looked_up(reference, monkeypatch):
    """Pairs of bytes have a table of their own; after it a merge looks up two pairs at most, and pieces of any length merge alike."""
    coder, rng, seen = bpe.ByteBPE(PATH, PATTERN), random.Random(2), []
    pieces = ["".join(rng.choices("abcdeé \u6f22123", k=rng.randrange(2, 90))).encode() for _ in range(500)] + [b"a" * k for k in (2, 3, bpe.LONG - 1, bpe.LONG)]
    real = bpe.PairTable.get
    monkeypatch.setattr(bpe.PairTable, "get", lambda self, left, right: seen.append(left.size) or real(self, left, right))
    lens = np.array([len(p) for p in pieces])
    ids, n = coder.merge_bucket(pieces, lens)
    assert sum(seen) <= 2 * int((lens - n).sum())
    assert [x[:k].tolist() for x, k in zip(ids, n, strict=True)] == [coder.merge_long(p).tolist() for p in pieces]
