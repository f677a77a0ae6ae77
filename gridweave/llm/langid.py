"""Language identification by rank-order profiles of character n-grams.

A profile is a ranking of the most frequent n-grams (1 to 3 letters, words padded with one blank). A document's own
ranking is compared with each language's: the out-of-place distance sums, over the document's n-grams, how far each lies
from its rank in the profile, or the greatest distance if it isn't there. The nearest language wins, ties go to the
smaller name; the score is the relative margin to the next, mapped to 0.5 .. 1 (1 if only one language is known).

Defined results: null text and text without a letter are `und` with score 0; rows with null lang are never learned from;
without any language to learn every document is `und`; repeated rows get equal results; null ids are as good as others; a very
long text is ranked whole, one text at a time; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import chunks_by_size, column_list

#: N-grams of a profile; how many documents of each language profiles are learned from, chosen by the hashes of ids and texts.
PROFILE, MAX_DOCS = 400, 2_000
_BLANK = 32
#: Code points to 0 (no letter) or the lower-case letter's code point, for the basic plane; others stay if alphabetic.
_FOLD = np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x10000)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case code points with one blank for each run without letters, and one at either end; empty if there is no letter."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _FOLD[np.minimum(a, 0xFFFF)]
    for i in np.flatnonzero(a > 0xFFFF):
        c = chr(a[i])
        low[i] = ord(c.lower()[0]) if c.isalpha() else 0
    on = low > 0
    if not on.any():
        return np.empty(0, np.uint64)
    low[~on] = _BLANK
    keep = on.copy()
    keep[1:] |= on[:-1]  # the first place after a letter
    return np.concatenate([[_BLANK], low[keep], [_BLANK] if on[-1] else []]).astype(np.uint64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys (three code points of 21 bits) of a text's n-grams and their counts; blanks alone are no n-gram."""
    a = letters(text)
    if not len(a):
        return a, np.empty(0, np.int64)
    two = (a[:-1] << np.uint64(21)) | a[1:]
    three = (two[:-1] << np.uint64(21)) | a[2:]
    keys = np.concatenate([a[a != _BLANK], two, three])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranking(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, best first; equal counts by key."""
    if len(keys) > 4 * most:
        low = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= low], counts[counts >= low]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Ranks of all profiles' n-grams, one column a language."""

    def __init__(self, langs: list[str], ranked: list[np.ndarray], most: int = PROFILE) -> None:
        self.langs, self.most = langs, most
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *ranked]))
        self.rank = np.full((len(self.keys) + 1, len(langs)), -1, np.int64)  # the last row: in no profile
        for j, r in enumerate(ranked):
            self.rank[np.searchsorted(self.keys, r), j] = np.arange(len(r))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(*grams(text), self.most) if text else np.empty(0, np.uint64)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own)
        r = self.rank[np.where(known, at, len(self.keys))]
        far = np.where(r < 0, self.most, np.abs(r - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        if len(far) == 1:
            return self.langs[best], 1.0
        second = int(np.partition(far, 1)[1])
        return self.langs[best], 0.5 + 0.5 * (second - int(far[best])) / max(second, 1)


def learn(docs: DataFrame, usable: Column | None = None, most_docs: int = MAX_DOCS, most: int = PROFILE) -> Profiles:
    """Profiles of every non-null lang, each from the whole texts of some most_docs documents (all, if there are fewer) with the smallest hashes."""
    rows = docs.where("lang is not null and text is not null")
    if usable is not None:
        rows = rows.where(usable)
    total = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not total:
        return Profiles([], [], most)
    share = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, most_docs / n))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(column_list(b, "lang"), object), np.array(column_list(b, "text"), object)
            for lang in set(langs):
                own = texts[langs == lang].tolist()
                for part in chunks_by_size(own, 1_000_000):
                    keys, n = grams(" ".join(own[part]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "k", "n"])

    counted = picked.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "k"))).where(F.col("r") <= most).toPandas()
    langs = sorted(set(best["lang"]))
    return Profiles(langs, [best[best["lang"] == lang].sort_values("r")["k"].to_numpy(np.int64).astype(np.uint64) for lang in langs], most)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id with lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # some 50 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in column_list(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
