"""The language model: gradients, windows, distributions, scores and counts against brute force."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridweave.llm import bpe, lm
from gridweave.llm.common import crc_mod, held_out, words_of
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def model(seed=0, kind=np.float32):
    rng = np.random.default_rng(seed)
    share = rng.random(lm.CLASSES)
    m = lm.Attention(share / share.sum(), rng.random((lm.CLASSES + 1, lm.CLASSES)) * 9)
    m.p = {k: (v + rng.normal(size=v.shape) * 0.1).astype(kind) for k, v in m.p.items()}
    return m


def test_gradients():
    rng = np.random.default_rng(0)
    m = model(kind=np.float64)
    ids, cls, on = rng.integers(0, lm.CLASSES + 1, (3, 6)), rng.integers(0, 80, (3, 6)), rng.random((3, 6)) > 0.3
    _, g = m.gradients(ids, cls, on)
    for name in m.p:
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in m.p[name].shape)
            if name == "emb":
                at = (int(rng.choice(ids.ravel())), at[1])
            if name in ("u2", "b2"):
                at = (int(rng.choice(cls.ravel())) // lm.MEMBERS, *at[1:])
            if name == "pos":
                at = (int(rng.integers(6)), at[1])
            keep, eps, loss = m.p[name][at], 1e-6, []
            for sign in (1, -1):
                m.p[name][at] = keep + sign * eps
                loss.append(m.gradients(ids, cls, on)[0])
            m.p[name][at] = keep
            assert g[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), abs=1e-6), name


@pytest.mark.parametrize("n", [1, 31, 32, 33, 56, 57, 200])
def test_each_position_is_scored_once(n):
    seq, start, first, end = lm.windows(np.array([5, n]))
    seen = Counter((int(s), t) for s, a, b in zip(seq, first, end, strict=True) for t in range(a, b))
    assert seen == Counter([(0, t) for t in range(5)] + [(1, t) for t in range(n)])
    assert all(b - a >= lm.WINDOW - lm.STRIDE for a, b in zip(start, first, strict=True) if a)


def voc(counts=None):
    coder = bpe.load(PATH, PATTERN)
    n = len(coder.tokens) + 1
    return lm.vocabulary(np.random.default_rng(1).integers(0, 50, n).astype(float) if counts is None else counts, coder)


def test_probabilities_of_all_ids_sum_to_one():
    v, m = voc(), model()
    h = np.random.default_rng(2).normal(size=(3, lm.WIDTH)).astype(np.float32)
    for row in h:
        every = m.log_classes(np.repeat(row[None], lm.CLASSES, 0), np.arange(lm.CLASSES))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
        assert (np.exp(every)[v.cls] * 10**v.log_in_class).sum() == pytest.approx(1, abs=1e-4)


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Étude", "naïve", "x" * 3000]
    return [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(70)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def power(x):
    """The model's exponential."""
    x = min(max(x / math.log(2), -lm.LIMIT), lm.LIMIT)
    return 2.0 ** math.floor(x) * (1 + x - math.floor(x))


def plain_score(v, m, text):
    """The model's log10 probability, position by position and pair by pair."""
    coder, p = bpe.load(PATH, PATTERN), {k: x.astype(np.float64) for k, x in m.p.items()}
    ids = [int(i) for w in lower(text) for i in coder.encode_flat([b" " + w])[0]] + [v.end]
    inputs, total = [lm.CLASSES, *(int(v.cls[i]) for i in ids[:-1])], 0.0
    for t, target in enumerate(ids):
        start = 0
        while not (t < start + lm.WINDOW):
            start += lm.STRIDE
        x = np.stack([p["emb"][inputs[j]] + p["pos"][j - start] for j in range(start, t + 1)])
        q, k, val = np.split(x @ p["qkv"], [lm.KEYS, 2 * lm.KEYS], axis=1)
        a = np.array([power(float(q[-1] @ kj) / math.sqrt(lm.KEYS)) for kj in k])
        h = x[-1] + (a / a.sum()) @ val
        c = int(v.cls[target])
        groups = [power(z) for z in h @ p["u1"] + p["b1"]]
        members = [power(z) for z in h @ p["u2"][c // lm.MEMBERS] + p["b2"][c // lm.MEMBERS]]
        total += math.log10(groups[c // lm.MEMBERS] / sum(groups)) + math.log10(members[c % lm.MEMBERS] / sum(members)) + v.log_in_class[target]
    return total


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 8)  # most words are joined
    trained, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: trained.append(real(*a)) or trained[-1])
    rows = list(enumerate(texts())) + [(200, None), (201, ""), (None, "W1 w1\tw1 w1"), (3, "only here"), (3, "only here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = lm.score(docs, crc_mod("doc_id", 7) != 2, PATH, PATTERN).collect()
    c, n_docs = Counter(), 0
    for i, t in rows:
        if not held_out(i, 7):
            c.update(lower(t))
            n_docs += 1
    c = {**c, "END": n_docs}
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [[*lower(t), "END"]])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    vocabulary, fitted, learnt = trained[0]
    by = {(r.doc_id, r.n_tokens): r.score for r in got}
    for i, t in [*rows[:6], *rows[70:]]:
        assert by[(i, len(lower(t)) + 1)] == pytest.approx(plain_score(vocabulary, fitted, t), rel=2e-4), i
    # Every id and every end of every training text was learnt from once.
    coder = bpe.load(PATH, PATTERN)
    assert learnt == sum(int(coder.encode_flat([b" " + w for w in lower(t)])[1].sum()) + 1 for i, t in rows if not held_out(i, 7))


def test_a_text_scores_the_same_in_any_company():
    v, m, coder = voc(), model(), bpe.load(PATH, PATTERN)
    own = [coder.encode_flat([b" " + w for w in lower(t)])[0] for t in texts()[:20]]
    ids, sizes = np.concatenate(own), np.array([len(x) for x in own])
    together = lm.sequence_scores(v, m, *lm.closed(ids, sizes, v.end))
    alone = [lm.sequence_scores(v, m, *lm.closed(x, np.array([len(x)]), v.end))[0] for x in own]
    assert together == pytest.approx(alone, rel=1e-5)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(docs, crc_mod("doc_id", 7) == 99, PATH, PATTERN).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert lm.score(docs.limit(0), crc_mod("doc_id", 7) != 2, PATH, PATTERN).count() == 0


def test_encoded(spark, monkeypatch):
    """Counts of words by ids, and the ids of every text, though workers forget words; many rows may share an id."""
    monkeypatch.setattr(lm, "KEPT", 5)
    rows = [(None, t) for t in texts()] + [(7, None), (7, "")]
    got = lm.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.lit(True), PATH, PATTERN).collect()
    coder = bpe.load(PATH, PATTERN)
    ids = lambda ws: coder.encode_flat([b" " + w for w in ws])[0].astype(np.uint16).tobytes()
    assert Counter(bytes(r.ids) for r in got if r.ids is not None) == Counter(ids(lower(t)) for _, t in rows)
    n = Counter()
    for r in got:
        if r.word is not None:
            n[bytes(r.word)] += r.n
    assert n == Counter(ids([w]) for _, t in rows for w in lower(t))


def test_known_words():
    coder = bpe.load(PATH, PATTERN)
    words = [f"wort{i}" for i in range(50)]
    ids, size = coder.encode_flat([b" " + w.encode() for w in words])
    ids = ids.astype(np.int64)
    first = np.cumsum(size) - size
    some = np.arange(0, 50, 2)
    mine = np.concatenate([ids[first[i] : first[i] + size[i]] for i in some])
    found = lm.Counts(mine, size[some], some + 1).find(ids, first)
    assert found[some] == pytest.approx(np.log10(some + 2.0)) and np.isnan(np.delete(found, some)).all()


def test_learning_beats_single_ids(spark):
    """Of pairs of words the second follows from the first: the trained model must know, ids on their own can't."""
    rng = np.random.default_rng(4)
    pairs = [("house", "tree"), ("water", "stone"), ("green", "river"), ("night", "table"), ("small", "bird")]
    data = [(i, " ".join(w for k in rng.integers(0, 5, 50) for w in pairs[k])) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = lm.encoded(docs, F.lit(True), PATH, PATTERN).cache()
    counts = rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    v, m, _ = lm.train(rows.where("ids is not null"), 400, counts, PATH, PATTERN)
    scores = [lm.sequence_scores(v, m, *lm.closed(*lm._unbinary(pa.array([bytes(r.ids)]), np.uint16), v.end))[0] for r in rows.where("ids is not null").limit(20).collect()]
    assert np.mean(scores) > 50 * math.log10(1 / 5) * 1.3  # the entropy of the pairs, and some
    assert np.mean(scores) < 50 * math.log10(1 / 5) * 0.9


def test_few_classes_begin_with_small_states():
    """Where pairs say little, the model begins near the shares and with states that training can move."""
    share = np.full(lm.CLASSES, 1e-5)
    share[:11] = 1
    share /= share.sum()
    pairs = np.zeros((lm.CLASSES + 1, lm.CLASSES))
    pairs[:11] = pairs[-1] = 4000 * share * (np.arange(lm.CLASSES) < lm.CLASSES // 2)
    m = lm.Attention(share, pairs)
    assert np.abs(m.p["emb"]).max() < 8
    ids, cls = np.random.default_rng(6).integers(0, 11, (2, 4, lm.WINDOW))
    assert m.gradients(ids, cls, np.ones(ids.shape, bool))[0] < 1.1 * math.log(11)


def test_states_from_a_position_on():
    m, ids = model(), np.random.default_rng(7).integers(0, lm.CLASSES + 1, (5, lm.WINDOW))
    assert m.hidden(ids, 8)[-1] == pytest.approx(m.hidden(ids)[-1][:, 8:], rel=1e-4, abs=1e-4)


def test_words_that_do_not_travel():
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 4, n).astype(np.uint16) for n in rng.integers(1, 4, 300)]
    size, text = np.array([len(w) for w in words]), np.sort(rng.integers(0, 9, 300)) + 1  # the first text has none, as may others
    first = np.cumsum(size) - size
    got = lm._others(np.concatenate(words), first, first + size, text, 12).to_pylist()
    want = [Counter(w.tobytes() for w, t in zip(words, text, strict=True) if t == i) for i in range(12)]
    assert [{x["word"]: x["m"] for x in r} for r in got] == want and [len(r) for r in got] == [len(w) for w in want]
    none = np.zeros(0, np.int64)
    assert lm._others(np.zeros(0, np.uint16), none, none, none, 2).to_pylist() == [[], []]


def test_parts_by_size():
    """A batch is cut before its texts become words, so a part of many texts has about a million bytes; null texts take none."""
    texts = ["x" * 400_000, None, "y" * 700_000, "z" * 3_000_000, "", None, "a b"]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in lm._parts(iter([b]), 1)]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1_000_000 for p in parts)


def test_words_are_cut_once():
    """Blocks become different words and their places as words_of cuts texts, in slices too; each different word is encoded once."""
    rng = np.random.default_rng(9)
    signs = [*map(chr, range(0x180)), "\u1680", "\u2003", "\u3000", "\u212a", "\U0001f600", *" \n\t\x0b\x0c\r" * 20, *"AZaz" * 20]
    rows = [None, "", " ", " a  A ", *("".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 400)), None, "b"]
    for col in (pa.array(rows), pa.array(rows).slice(150, 200), pa.array(["c", *rows]).slice(1), pa.array([None, None], pa.string()).slice(1)):
        words, at, lengths = lm.split_words(col)
        words = [w.encode() for w in words.to_pylist()]
        want = [words_of(t.encode() if t else None) for t in col.to_pylist()]
        assert [words[i] for i in at] == sum(want, []) and lengths.tolist() == [len(w) for w in want]
        assert len(set(words)) == len(words) and set(words) == set(sum(want, []))
    coder, met = bpe.load(PATH, PATTERN), []
    own = lm.Words(type("Coder", (), {"encode_flat": lambda _, pieces: met.extend(pieces) or coder.encode_flat(pieces)})())
    blocks = [["wort", "né"], ["né"], ["x1", "wort", "stein"], []]
    slots = [own.slots(pa.array(b, pa.large_string())) for b in blocks]
    assert [s.tolist() for s in slots] == [[0, 1], [1], [2, 0, 3], []] and met == [b" wort", " né".encode(), b" x1", b" stein"]
    assert own.expand(slots[2]).tolist() == coder.encode_flat([b" x1", b" wort", b" stein"])[0].tolist()


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_known_words_share_buckets(n):
    rng = np.random.default_rng(10)
    words = [tuple(w) for w in {tuple(rng.integers(0, 50, k)) for k in rng.integers(1, 5, 2 * n)}]
    ids, size = np.concatenate([np.array(w) for w in words]), np.array([len(w) for w in words])
    first, known = np.cumsum(size) - size, np.arange(0, len(words), 2)
    counts = lm.Counts(np.concatenate([np.array(words[i]) for i in known]), size[known], known + 1)
    found = counts.find(ids, first)
    assert found[known] == pytest.approx(np.log10(known + 2.0)) and np.isnan(np.delete(found, known)).all()
    none = np.zeros(0, np.int64)
    assert np.isnan(lm.Counts(none, none, none).find(ids, first)).all() and len(counts.find(none, none)) == 0


def test_adam_by_hand():
    rng = np.random.default_rng(11)
    m, batches = model(), [(rng.integers(0, lm.CLASSES + 1, (4, 9)), rng.integers(0, lm.CLASSES, (4, 9)), rng.random((4, 9)) > 0.2) for _ in range(4)]
    plain = model()
    mean, square = ({k: np.zeros(v.shape) for k, v in plain.p.items()} for _ in range(2))
    for step, b in enumerate(batches, 1):
        g = plain.gradients(*b)[1]
        for k, v in plain.p.items():
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k].astype(float) ** 2 - square[k])
            plain.p[k] = (v - 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    assert m.follow(iter(batches), 0.01) == sum(int(b[2].sum()) for b in batches)
    for k in m.p:
        assert m.p[k] == pytest.approx(plain.p[k], abs=2e-4), k
