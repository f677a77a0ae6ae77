"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics come from one pass over a text's bytes. Trees are grown level by level on binned features; a trained model
is a set of flat arrays (feature, threshold and value by node of a complete binary tree), and scoring walks all rows of a
batch down all trees at once. Only the text is an input of a score.

Defined results: null and empty texts have the statistics of an empty text and get that score; labels that are null or not
0/1 are left out of training; several labels of one id are all used; repeated rows get equal scores; an empty table gives
an empty one; without usable labels of both values every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import column_bytes, crc_mod, lean, parts

#: Labelled rows that a model is trained on at most, by the smallest hashes of their ids.
MAX_TRAIN = 20_000

NAMES = (
    "log_bytes", "log_words", "word_mean", "word_std", "distinct_words", "upper", "lower", "digit", "other_ascii", "space", "high",
    "exclaim", "pipe", "end_marks", "symbols", "upper_words", "lines", "line_mean", "repeated_lines", "worst_symbols", "worst_upper",
    "worst_end_marks", "entropy", "commonest_word", "long_words", "symbol_words", "line_symbol_share", "line_upper_share",
)
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = 0 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 4 if _c in b" \t\n\r\x0b\f" else 5 if _c >= 128 else 3
_SYMBOL = np.array([c < 128 and chr(c) in "|%$&#*@^~=<>{}[]\\/_+" for c in range(256)], np.int64)
_UPPER, _END = (_CLASS == 0).astype(np.int64), np.array([chr(c) in "!?" and c < 128 for c in range(256)], np.int64)


def statistics(text: bytes | None) -> list[float]:
    """The features NAMES of a whole text."""
    text = text or b""
    n = max(len(text), 1)
    a = np.frombuffer(text, np.uint8)
    hist = np.bincount(a, minlength=256)
    share = [float(hist[_CLASS == k].sum()) / n for k in range(6)]
    words = text.split()
    m = max(len(words), 1)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    starts = np.concatenate([[0], np.flatnonzero(a == 10) + 1])[: len(lines)]
    starts = starts[starts < len(a)]
    if len(starts):
        span = np.diff(np.append(starts, len(a)))
        letters = np.maximum(np.add.reduceat((_CLASS[a] < 2).astype(np.int64), starts), 1)
        symbols, upper, ends = np.add.reduceat(_SYMBOL[a], starts) / span, np.add.reduceat(_UPPER[a], starts) / letters, np.add.reduceat(_END[a], starts) / span
        big = span >= 12
        line = [max(symbols[big], default=0.0), max(upper[big], default=0.0), max(ends[big], default=0.0), float(span[symbols > 0.04].sum()) / n, float(span[upper > 0.5].sum()) / n]
    else:
        line = [0.0] * 5
    p = hist[hist > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    upper_words = sum(map(bytes.isupper, words))
    symbol_words = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?\"')")
    return [
        np.log1p(len(text)), np.log1p(len(words)), lens.mean(), lens.std(), len(seen) / m, *share,
        hist[33] / n, hist[124] / m, (hist[33] + hist[63]) / m, float((hist * _SYMBOL).sum()) / n, upper_words / m, len(lines) / m, n / len(lines), 1 - len(set(lines)) / len(lines),
        line[0], line[1], line[2], float(-(p * np.log(p)).sum()) if len(text) else 0.0, max(seen.values(), default=0) / m, float((lens > 20).mean()), symbol_words / m, line[3], line[4],
    ]


@dataclass
class Trees:
    """Boosted trees as arrays: row t of feature, threshold and value is tree t; the children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        t, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(t)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.base + self.value[t, node - (2**self.depth - 1)].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Trees of logistic loss on at most `bins` bins a feature; `least` is the least hessian in a child."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin > b: x > edge b
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (len(e) + 1) + binned[:, j]
                gl = np.cumsum(np.bincount(key, g, width * (len(e) + 1)).reshape(width, -1), 1)
                hl = np.cumsum(np.bincount(key, h, width * (len(e) + 1)).reshape(width, -1), 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain[:, :-1].argmax(1)
                top = gain[np.arange(width), k]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better], threshold[first + better] = j, e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin = margin + value[leaf]
        made.append((feature, threshold, value))
    return Trees(base, *(np.stack(a) for a in zip(*made, strict=True)), depth)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with x, the statistics of `text`."""
    kinds = docs.select(*keep).schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, len(keep)):
            x = [statistics(t) for t in column_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(lean(run), f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MAX_TRAIN) -> Trees:
    """A model of `quality` from at most `most` labelled documents (`usable` holds on labels), those with the smallest hashes."""
    rows = labels.where("quality in (0, 1) and doc_id is not null")
    if usable is not None:
        rows = rows.where(usable)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    if (n := rows.count()) > 2 * most:  # so that few more than `most` rows meet in the task that cuts them off
        rows = rows.where(place < int(2 * most / n * (1 << 40)))
    picked = rows.select("doc_id", "quality").orderBy(place, "doc_id", "quality").limit(most)
    got = features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "quality"])
    got = got.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # a row for each picked label, however often an id repeats
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    return fit(x, got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (all of docs by default, whatever their names) with the new column `name`."""
    keep = docs.columns if keep is None else keep
    kinds = docs.select(*keep).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 30 KB
    as_is = [f"_c{i}" for i in range(len(keep))]
    names, at = ([*as_is], keep.index("text")) if "text" in keep else ([*as_is, "_text"], len(keep))  # a kept text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at):
            x = np.array([statistics(t) for t in column_bytes(b, names[at])]).reshape(b.num_rows, len(NAMES))
            s = np.concatenate([shared.value.predict(x[i : i + 2000]) for i in range(0, len(x), 2000)]) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64())], names=[*as_is, "_score"])

    renamed = docs.select(*(docs[c].alias(n) for c, n in zip([*keep, "text"], names, strict=False)))
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(as_is, kinds, strict=True))
    return renamed.mapInArrow(lean(run), f"{ddl}, _score double").toDF(*keep, name)


def labelled(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from."""
    return crc_mod(doc_id, 4) != 2
