"""Near-duplicates against brute force over exact shingle sets."""

import random
import re

import numpy as np
import pytest

from gridweave.llm import minhash
from gridweave.llm.components import components

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows, per_cent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), least.get(find(i), -1), (least.get(find(i)) == d)) for i, (d, _) in enumerate(rows))


def run(spark, rows, per_cent):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_shingles int, node string")
    got = minhash.near_duplicates(docs, per_cent).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return " ".join(out)


@pytest.mark.parametrize("per_cent", [80, 85])
def test_families(spark, per_cent):
    rng = random.Random(per_cent)
    texts = []
    for _ in range(60):
        base = rng.choices(WORDS, k=rng.choice([3, 5, 8, 60, 200, 900]))
        texts += [edited(rng, base, rng.choice([0, 0, 1, 2, 5, 8])) for _ in range(rng.choice([1, 2, 3, 9]))]
    passage = " ".join(rng.choices(WORDS, k=60))
    texts += [" ".join(rng.choices(WORDS, k=50)) + " " + passage for _ in range(200)]
    texts += [None, "", " \t\n", "one", "One", "one two three four", "x" * 50_000]
    rng.shuffle(texts)
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[1]), (None, "alone " * 7)]
    assert run(spark, rows, per_cent) == brute(rows, per_cent)


def test_one_large_family_and_its_rim(spark):
    """Over CLUSTER members: pivot rounds, and blocks for those that no pivot explains."""
    rng = random.Random(5)
    base = rng.choices(WORDS, k=150)
    texts = [edited(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(500)]
    other = base[:100] + rng.choices(WORDS, k=60)
    texts += [edited(rng, other, 1) for _ in range(150)] + [edited(rng, base, 9) for _ in range(40)]
    rows = list(enumerate(texts))
    assert run(spark, rows, 85) == brute(rows, 85)


def test_empty_table(spark):
    assert run(spark, [], 85) == []


def test_blocks_after_the_pivots(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CLUSTER", 6)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "DEPTH", 2)
    rng = random.Random(9)
    base = rng.choices(WORDS, k=150)
    rows = list(enumerate(edited(rng, base, rng.choice([1, 3, 5])) for _ in range(60)))
    assert run(spark, rows, 85) == brute(rows, 85)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("gridweave.llm.components.FEW", few)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == want


@pytest.mark.parametrize("share", [0.7, 0.8, 0.9])
@pytest.mark.parametrize("cut", [False, True])
def test_pairs_inside_a_template_family(spark, monkeypatch, share, cut):
    """Texts that share a template but mostly aren't near-duplicates, and pairs of near-duplicates among them."""
    if cut:  # branches that stay large, clusters that are met again branch by branch, joins by salts
        for name, value in (("SMALL", 8), ("DEPTH", 2), ("CLUSTER", 16), ("DENSE", 32), ("BLOCK", 16), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(minhash, name, value)
    rng = random.Random(21)
    template, texts = rng.choices(WORDS, k=int(200 * share)), []
    for _ in range(200):
        own = template + rng.choices(WORDS, k=200 - len(template))
        texts += [" ".join(own), edited(rng, own, 2)] if rng.random() < 0.3 else [" ".join(own)]
    rows = list(enumerate(texts))
    assert run(spark, rows, 85) == brute(rows, 85)


def test_units_of_a_dense_branch(spark):
    """Each node at odds with the rest meets all nodes of its branch, in units of some 2 * most nodes."""
    rng = random.Random(2)
    rows = [(b, i, rng.random() < 0.2) for b, n in ((1, 50), (2, 7), (3, 30)) for i in range(n)] + [(4, i, False) for i in range(20)]
    got = minhash._units(spark.createDataFrame(rows, "branch long, node long, rest boolean"), 8).collect()
    units = {}
    for r in got:
        units.setdefault(r.key, {})[r.node] = r.rest
    assert max(map(len, units.values())) <= 32
    for b, i, rest in rows:
        if rest:
            met = {n for u in units.values() if u.get(i) for n in u}
            assert met >= {j for c, j, _ in rows if c == b}
    assert sum(map(len, units.values())) < 50 * 7 * 3


def test_ties_of_the_rest_of_a_dense_branch():
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 256, (40, minhash.K)).astype(np.uint8)[rng.integers(0, 40, 300)]
    sig[rng.random(sig.shape) < 0.1] = 0
    for rest in (np.ones(300, bool), rng.random(300) < 0.3):
        i, j = np.nonzero(np.triu((sig[:, None] == sig[None]).sum(2) >= 0.7 * minhash.K, 1) & (rest[:, None] | rest[None]))
        want, got = minhash._min_labels(300, i, j), minhash._dense(sig, rest, 0.7 * minhash.K)
        assert len({*zip(want, got, strict=True)}) == len({*want}) == len({*got})
