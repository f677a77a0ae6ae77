"""Scoring of texts by a small causal self-attention model over subword ids, beside an add-one unigram score.

Tokens are the words of a text (A-Z lower-cased) and one end; a word's subwords are the byte-level BPE ids of the word
with a blank before it, so an id that begins a word is told from one inside it, and the ids of a text followed by its end
are one sequence. A model of one causal self-attention layer gives each id a probability after all ids before it in its window:

* ids have classes: frequent ones a class each, the rest binned by frequency; those that begin a word and those inside
  one never share a class. MEMBERS classes make a group. A position predicts the group, then the class within it, by two
  softmaxes of the attention's state; the id within its class follows its share of the counts (add one). Each of the
  three is a distribution, so their product is one over all ids;
* both softmaxes and the attention use a piecewise-linear exponential (2 to the whole part, times 1 plus the
  fraction; one cast of a float to its bits) in place of e to the x, normalised and differentiated as it is: numpy's own
  exponential would take most of the time;
* a text is scored in overlapping windows, batched and masked: a window advances by STRIDE and scores its last STRIDE
  positions, so each id is scored once, with WINDOW - STRIDE ids of context at least (but at the text's start).

Everything the model learns from comes from all training texts. Counts of words are a distributed sum, and ids, pairs of
neighbouring ids and ends of words follow from it. The model begins as the best approximation of its rank to the log-odds
of those pairs; then every window of every training text is learnt from once: in each of ROUNDS, which part the texts by a
hash, each task takes a copy of the model through its own texts by Adam, and the mean of the copies, by what they learnt
from, is the next model. The TOP most frequent words travel with the scoring tasks; the counts of all others are joined by
a shuffle, so the table of words has no bound.

Defined results: null and empty texts hold the end alone; words that training lacks count as c = 0 and are scored by
their subwords; without training texts c and N are 0 and the model is uniform over classes; repeated rows get
equal scores, ties need no rule; very long texts are more windows, held a block of texts at a time; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import c_library, drop_settled, give_back, mix64, settle, with_row_id
from gridweave.llm.common import parts as _parts

WINDOW, STRIDE = 32, 24
#: Groups of classes, and classes of a group; the first half of the groups is for ids that begin a word.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
#: Width of the states, and of queries and keys.
WIDTH, KEYS = 16, 8
#: Where keys, values and states begin behind the queries, each with one column more.
_K, _V, _X = KEYS + 1, 2 * KEYS + 2, 2 * KEYS + WIDTH + 3
#: Places of each input's states in the table of states.
_PLACES = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)
#: Positions that each position sees.
_PAST = np.tri(WINDOW, dtype=np.float32)
#: Words that scoring tasks hold; words a worker keeps; tasks that sum models.
TOP, KEPT, SUMS = 400_000, 500_000, 16
#: Rounds of training: how many of 32 parts of the texts each takes, and its rate. Together they take all.
ROUNDS = ((1, 0.02), (7, 0.015), (24, 0.01))
#: Bytes of text that are cut into words at once; repeated words of these are looked up and encoded once.
BLOCK = 4_000_000
#: Texts that a training task takes at least, and the windows of a batch at most.
TASK, BATCH = 400, 128
LN10 = float(np.log(10))


class Vocabulary:
    """Classes and in-class probabilities of subword ids; the last id is the end of a text, which counts as one that begins a word."""

    def __init__(self, counts: np.ndarray, inside: np.ndarray) -> None:
        n, half = len(counts), CLASSES // 2
        alone = half * 7 // 8
        self.cls, self.log_in_class = np.zeros(n, np.int64), np.zeros(n)
        total = np.zeros(CLASSES)
        for kind in (False, True):
            own = np.flatnonzero(inside == kind)
            own = own[np.lexsort((own, -counts[own]))]
            mass = np.cumsum(np.sqrt(counts[own[alone:]] + 1.0))
            cls = half * kind + np.concatenate([np.arange(alone), alone + np.minimum((mass / mass[-1] * (half - alone)).astype(np.int64), half - alone - 1)])
            size, sums = np.bincount(cls, minlength=CLASSES), np.bincount(cls, counts[own], CLASSES)
            self.cls[own], self.log_in_class[own] = cls, np.log10((counts[own] + 1.0) / (sums + size)[cls])
            total += sums
        self.share = (total + 1) / (total.sum() + CLASSES)
        self.end, self.begins = n - 1, ~inside


def vocabulary(counts: np.ndarray, coder: bpe.ByteBPE) -> Vocabulary:
    return Vocabulary(counts, np.array([*(not t.startswith(b" ") for t in coder.tokens), False]))


#: Bits of a float of each width: the kind of integer, the factor and offset that turn x into the bits of 2 ** (x log2 e), the exponent's mask.
_BITS = {
    4: (np.int32, np.float32(2**23 / np.log(2)), np.float32(127 * 2**23), np.int32(0x7F800000)),
    8: (np.int64, 2**52 / np.log(2), 1023.0 * 2**52, np.int64(0x7FF0000000000000)),
}
#: The exponential stays between 2 ** -LIMIT and 2 ** LIMIT, so no sum of it is 0 or infinite.
LIMIT = 60


def _exponential(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piecewise-linear exponential of numbers that have the factor and offset of _BITS already, and its bits."""
    whole, _, offset, _ = _BITS[z.itemsize]
    reach = LIMIT * 2.0 ** (23 if z.itemsize == 4 else 52)
    np.clip(z, offset - reach, offset + reach, out=z)
    bits = z.astype(whole)
    return bits.view(z.dtype), bits


def _slope(bits: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The exponential's derivative, but for the factor log2 e; overwrites its bits."""
    bits &= _BITS[bits.itemsize][3]
    return bits.view(kind)


class Attention:
    """One causal attention layer under a softmax over groups and one over the classes of a group; both passes in numpy."""

    def __init__(self, share: np.ndarray, pairs: np.ndarray | None = None, seed: int = 11) -> None:
        """share: of the classes; pairs: weights of (input, class), inputs being the classes and a text's begin."""
        rng, d = np.random.default_rng(seed), WIDTH
        by_group = share.reshape(GROUPS, MEMBERS)
        in_group = by_group / by_group.sum(1, keepdims=True)
        states, outputs = rng.standard_normal((CLASSES + 1, d)) * 0.3, rng.standard_normal((d, CLASSES)) * 0.1
        if pairs is not None and pairs.any():
            seen = pairs.sum(1, keepdims=True)
            odds = np.log((pairs + 20 * share) / (seen + 20)) - np.log(share)
            rows, columns = np.sqrt(seen + seen.mean() / 100 + 1), np.sqrt(share + 0.1 / CLASSES)  # rare ones weigh a little, so none is off by much
            u, s, v = np.linalg.svd((odds * rows * columns).astype(np.float32), full_matrices=False)
            root, blank = np.sqrt(s[:d]), s[:d] <= 1e-3 * s[0]
            known, outputs = u[:, :d] * root / rows, v[:d] * root[:, None] / columns
            size = max(2 * float(np.abs(known).mean()), float(np.abs(known).max()) / 4, 1e-6)  # if few classes occur, they don't get huge states
            # Directions that the pairs say nothing of begin with random states and predict nothing.
            states, outputs = np.where(blank, states, known / size), np.where(blank[:, None], 0, outputs * size)
        outputs = outputs.reshape(d, GROUPS, MEMBERS)
        self.p = {
            "emb": states, "pos": rng.standard_normal((WINDOW, d)) * 0.02, "qkv": rng.standard_normal((d, 2 * KEYS + d)) * 0.5 / np.sqrt(d),
            "u1": (outputs * in_group).sum(2), "b1": np.log(by_group.sum(1)), "u2": outputs.transpose(1, 0, 2), "b2": np.log(in_group),
        }
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}

    def tables(self) -> tuple:
        """Of each input, and of each place in a window: query, key, value and state, which sum to those of a position; and the
        products of states with groups, and with the classes of each group. States have a column of ones and queries and keys one
        more product, so that biases and the exponential's offset are parts of the products."""
        p = self.p
        kind = p["emb"].dtype
        _, factor, offset, _ = _BITS[kind.itemsize]
        made = np.zeros((WIDTH, _X), kind)
        made[:, :KEYS] = p["qkv"][:, :KEYS] * (factor * kind.type(KEYS**-0.5))
        made[:, _K : _K + KEYS], made[:, _V : _X - 1] = p["qkv"][:, KEYS : 2 * KEYS], p["qkv"][:, 2 * KEYS :]
        rows, pos = np.zeros((CLASSES + 1, _X + WIDTH + 1), kind), np.zeros((WINDOW, _X + WIDTH + 1), kind)
        for table, states in ((rows, p["emb"]), (pos, p["pos"])):
            np.matmul(states, made, out=table[:, :_X])
            table[:, _X:-1] = states
        rows[:, KEYS], rows[:, _V - 1], rows[:, _X - 1] = offset, 1, 1
        u1, u2 = np.empty((WIDTH + 1, GROUPS), kind), np.empty((GROUPS, WIDTH + 1, MEMBERS), kind)
        for u, weights, biases in ((u1, p["u1"], p["b1"]), (u2, p["u2"], p["b2"])):
            np.multiply(weights, factor, out=u[..., :-1, :])
            np.add(biases * factor, offset, out=u[..., -1, :])
        return rows, pos, u1, u2

    def hidden(self, ids: np.ndarray, since: int = 0, tables: tuple | None = None) -> tuple:
        """States after the inputs ids (n, t) from position `since` on, last of what the backward pass needs."""
        rows, pos, *_ = tables or self.tables()
        t = ids.shape[1]
        m = rows.take(ids, 0)
        m += pos[:t]
        q, k, v, x = m[:, since:, :_K], m[..., _K:_V], m[..., _V:_X], m[..., _X:]
        a, bits = _exponential(q @ k.transpose(0, 2, 1))
        a *= _PAST[since:t, :t].astype(m.dtype, copy=False)
        mean = a @ v  # the column of ones sums a
        total = mean[..., -1:].copy()
        mean /= total  # its own column is 1 by that
        return x[..., :-1], q, k, v, a, bits, total, mean[..., :-1], mean + x[:, since:]

    def _softmaxes(self, h: np.ndarray, cls: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> tuple:
        """Of the group, and of the class in it with rows in order of groups: (values, bits, sums, own places); and that order.
        h has a column of ones."""
        n = len(cls)
        group, at = (cls // MEMBERS).astype(np.uint8), np.arange(n) * MEMBERS
        order = np.argsort(group, kind="stable")
        cut = [0, *np.bincount(group, minlength=GROUPS).cumsum().tolist()]
        first = (*_exponential(h @ u1), np.arange(n) * GROUPS + group)
        sorted_h, z = h.take(order, 0), np.empty((n, MEMBERS), h.dtype)
        for g in range(GROUPS):
            lo, hi = cut[g], cut[g + 1]
            if lo < hi:
                np.dot(sorted_h[lo:hi], u2[g], out=z[lo:hi])
        second = (*_exponential(z), at + (cls % MEMBERS).take(order))
        return [(e, bits, e @ np.ones(e.shape[1], e.dtype), own) for e, bits, own in (first, second)], order, cut, sorted_h

    def log_classes(self, h: np.ndarray, cls: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Natural log of the probabilities of the classes cls (m,) after states h (m, WIDTH), or with their column of ones."""
        if h.shape[1] == WIDTH:
            h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)
        (one, two), order, _, _ = self._softmaxes(h, cls, *(tables or self.tables())[2:])
        share = one[0].ravel().take(one[3])
        share /= one[2]
        share[order] *= two[0].ravel().take(two[3]) / two[2]
        return np.log(share)

    def gradients(self, ids: np.ndarray, cls: np.ndarray, on: np.ndarray, with_loss: bool = True) -> tuple[float, dict]:
        """Mean loss over the positions where `on` (0 if not asked for), and its gradients."""
        p, (n, t) = self.p, ids.shape
        kind = p["emb"].dtype
        log2e = kind.type(1 / np.log(2))
        tables = self.tables()
        x, q, k, v, a, a_bits, a_total, mean, h = self.hidden(ids, 0, tables)
        flat = h.reshape(n * t, -1)
        softmaxes, order, cut, sorted_h = self._softmaxes(flat, cls.ravel(), *tables[2:])
        weight = on.ravel().astype(kind)
        weight /= max(int(on.sum()), 1)
        loss, dz = 0.0, []
        for (e, bits, total, own), w in zip(softmaxes, (weight, weight.take(order)), strict=True):
            ours = e.ravel().take(own)
            if with_loss:
                loss -= float((np.log(ours / total) * w).sum(dtype=np.float64))
            w = w * log2e
            d = _slope(bits, kind)
            each = d.ravel()
            less = each.take(own)
            less *= w
            less /= ours
            d *= (w / total)[:, None]
            each[own] -= less
            dz.append(d)
        one, two, back = flat.T @ dz[0], np.zeros((GROUPS, WIDTH + 1, MEMBERS), kind), np.empty((n * t, WIDTH), kind)
        outputs = np.ascontiguousarray(p["u2"].transpose(0, 2, 1))
        for i in range(GROUPS):
            lo, hi = cut[i], cut[i + 1]
            if lo < hi:
                np.dot(sorted_h[lo:hi].T, dz[1][lo:hi], out=two[i])
                np.dot(dz[1][lo:hi], outputs[i], out=back[lo:hi])
        g = {"u1": one[:-1], "b1": one[-1], "u2": two[:, :-1], "b2": two[:, -1]}
        place = np.empty_like(order)
        place[order] = np.arange(n * t)
        # Gradients of the states; then those of queries and keys but for their factors, and of values.
        dh = dz[0] @ p["u1"].T
        dh += back.take(place, 0)
        dm, dn = np.empty((n, t, 2 * KEYS + WIDTH), kind), np.empty((n, t, WIDTH + 1), kind)
        np.divide(dh.reshape(n, t, WIDTH), a_total, out=dn[..., :-1])
        np.matmul(a.transpose(0, 2, 1), dn[..., :-1], out=dm[..., 2 * KEYS :])
        dn[..., -1] = -np.einsum("ijk,ijk->ij", dn[..., :-1], mean)  # the softmax's own sum, which the values' column of ones takes off
        da = dn @ v.transpose(0, 2, 1)
        da *= _slope(a_bits, kind)  # 0 where a is masked: there the bits are 0
        np.matmul(da, k[..., :-1], out=dm[..., :KEYS])
        np.matmul(da.transpose(0, 2, 1), q[..., :-1], out=dm[..., KEYS : 2 * KEYS])  # q has its factor of the bits already
        factors = np.ones(2 * KEYS + WIDTH, kind)
        factors[:KEYS], factors[KEYS : 2 * KEYS] = log2e * kind.type(KEYS**-0.5), log2e / _BITS[kind.itemsize][1]
        dm = dm.reshape(n * t, -1)
        dh += dm @ (p["qkv"] * factors).T
        g["qkv"] = (x.reshape(n * t, -1).T @ dm) * factors
        g["emb"] = np.bincount(_PLACES.take(ids, 0).ravel(), dh.ravel(), _PLACES.size).reshape(_PLACES.shape)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:t] = dh.reshape(n, t, WIDTH).sum(0)
        return loss, g

    def follow(self, batches: Iterator[tuple], rate: float) -> int:
        """One pass of Adam over batches (ids, classes, on); returns the number of positions learnt from."""
        names, ends = list(self.p), np.cumsum([v.size for v in self.p.values()])
        every = np.concatenate([v.ravel() for v in self.p.values()])
        self.p = {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(every, ends[:-1]), strict=True)}
        m, s, g, learnt = np.zeros_like(every), np.zeros_like(every), np.empty_like(every), 0  # m and s are 10 and 100 times the means
        into = {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(g, ends[:-1]), strict=True)}
        for step, (ids, cls, on) in enumerate(batches, 1):
            learnt += int(on.sum())
            now = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for k, found in self.gradients(ids, cls, on, with_loss=False)[1].items():
                into[k][...] = found
            m *= np.float32(0.9)
            m += g
            s *= np.float32(0.99)
            g *= g
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-7)
            np.divide(m, g, out=g)
            g *= now  # a tenth of m by a tenth of the root of s
            every -= g
        return learnt


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, first scored, end) of the windows over sequences of these lengths, all above 0; overlapping if stride < WINDOW."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    seq = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    start = k * stride
    return seq, start, np.where(k > 0, start + WINDOW - stride, 0), np.minimum(start + WINDOW, lengths[seq])


class Words:
    """Slots of words in the order they are met, and their subword ids."""

    def __init__(self, coder: bpe.ByteBPE) -> None:
        self.coder, self.known = coder, pa.array([], pa.large_string())
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def slots(self, words: pa.Array) -> np.ndarray:
        """Slots of different words, a column of large strings."""
        at = pc.index_in(words, self.known)
        if at.null_count:
            fresh = at.is_null()
            new = words.filter(fresh)
            slots = at.fill_null(-1).to_numpy().astype(np.int64)
            slots[slots < 0] = np.arange(len(self), len(self) + len(new))
            pieces = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), new, pa.scalar(" ", pa.large_string()))  # a blank before each
            ends, raw = np.frombuffer(pieces.buffers()[1], np.int64, len(new) + 1, pieces.offset * 8).tolist(), pieces.buffers()[2].to_pybytes()
            ids, n = self.coder.encode_flat([raw[a:b] for a, b in pairwise(ends)])
            self.start = np.append(self.start, len(self.ids) + np.cumsum(n) - n)
            self.ids, self.size, self.known = np.append(self.ids, ids), np.append(self.size, n), pa.concat_arrays([self.known, new])
            return slots
        return at.to_numpy().astype(np.int64)

    def expand(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the words in these slots, one after another."""
        size = self.size[slots]
        return self.ids[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.start[slots], size)]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, as words_of cuts them, the number of each word of all texts among these, and how many words each text has."""
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy from offset 0: Arrow's lower case of a slice that was cast is wrong
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    found, lengths = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    words, at = found.dictionary, found.indices.to_numpy()
    if (blank := pc.index(words, "").as_py()) >= 0:  # before and behind the words of a text
        empty = np.flatnonzero(at == blank)
        lengths -= np.bincount(np.searchsorted(np.cumsum(lengths), empty, "right"), minlength=len(lengths))
        at = np.delete(at, empty)
        at, words = at - (at > blank), pa.concat_arrays([words[:blank], words[blank + 1 :]])
    return words, at, lengths


def _id_type(coder: bpe.ByteBPE) -> type:
    """Ids are kept as bytes of this type, in the machine's order."""
    return np.uint16 if len(coder.tokens) <= 2**16 else np.uint32


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of so many values each."""
    offsets = np.append(0, np.cumsum(sizes) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unbinary(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, one after another, and how many each row has."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(col.buffers()[2] or b"", kind, int(offsets[-1] - offsets[0]) // size, int(offsets[0])) if len(col) else np.empty(0, kind)
    return values.astype(np.int64), np.diff(offsets) // size


def encoded(docs: DataFrame, usable: Column, path: str, pattern: str) -> DataFrame:
    """One pass over all texts: a row a text (doc_id, learns, ids of its words, words: how many), and rows (word, n), which
    count the words of texts where `usable` holds, each task's own ones first; a word is its ids."""
    schema = "doc_id long, learns boolean, ids binary, words long, word binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        coder = bpe.load(path, pattern)
        kind, words, count = _id_type(coder), Words(coder), np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            n, none = len(words), lambda t: pa.nulls(len(words), t)
            rows = [none(pa.int64()), none(pa.bool_()), none(pa.binary()), none(pa.int64()), _binary(words.ids.astype(kind), words.size), pa.array(count, pa.int64())]
            return pa.RecordBatch.from_arrays(rows, names=["doc_id", "learns", "ids", "words", "word", "n"]).filter(pa.array(count > 0) if n else pa.array([], pa.bool_()))

        for own in _parts(batches, 1, BLOCK):
            if len(words) > KEPT:
                yield counted()
                words, count = Words(coder), np.zeros(0, np.int64)
            none, learns = lambda t, n=own.num_rows: pa.nulls(n, t), own.column(2).to_numpy(zero_copy_only=False)
            different, at, lengths = split_words(own.column(1))
            slots = words.slots(different)[at]
            more = np.bincount(slots[np.repeat(learns, lengths)], minlength=len(words))
            more[: len(count)] += count
            count, ends = more, np.append(0, np.cumsum(words.size[slots]))[np.cumsum(lengths)]
            rows = [own.column(0), own.column(2), _binary(words.expand(slots).astype(kind), np.diff(ends, prepend=0)), pa.array(lengths), none(pa.binary()), none(pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "learns", "ids", "words", "word", "n"])
        yield counted()
        del words, count
        give_back()

    return docs.select("doc_id", "text", F.coalesce(usable, F.lit(False)).alias("learns")).mapInArrow(run, schema)


def _inputs(cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The inputs before each position: the class before it, or the begin of a text."""
    out = np.empty_like(cls)
    out[1:] = cls[:-1]
    out[np.cumsum(lengths) - lengths] = CLASSES
    return out


def _word_keys(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each word; ids holds the words one after another, `first` where each begins."""
    place = (np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))).astype(np.uint64)
    spot = (place << np.uint64(32)) | ids.astype(np.uint64)
    return tuple(np.add.reduceat(mix64(spot ^ salt), first) if len(first) else np.empty(0, np.uint64) for salt in (_SALT, ~_SALT))


_SALT = np.uint64(0x9E3779B97F4A7C15)


class Counts:
    """log10(c + 1) of the words that travel with the scoring tasks, in buckets by the upper bits of their keys."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> None:
        one, two = _word_keys(ids, np.cumsum(sizes) - sizes)
        order = np.argsort(one)
        self.one, self.two, self.log = one[order], two[order], np.log10(n[order] + 1.0)
        bits = max(1, len(one).bit_length())
        self.shift = np.uint64(64 - bits)
        size = np.bincount((self.one >> self.shift).astype(np.int64), minlength=1 << bits)
        self.ends, self.largest = np.cumsum(size).astype(np.int32), int(size.max())

    def find(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word; NaN for those that are not here."""
        one, two = _word_keys(ids, first)
        out, todo = np.full(len(one), np.nan), np.arange(len(one))
        bucket = (one >> self.shift).astype(np.int64)
        at, end = self.ends.take(bucket - 1, mode="clip"), self.ends.take(bucket)
        at[bucket == 0] = 0
        for _ in range(self.largest):  # the next word of each bucket
            some = at < end
            todo, at, end = todo[some], at[some], end[some]
            hit = self.one.take(at) == one.take(todo)
            found, place = todo[hit], at[hit]
            same = self.two.take(place) == two.take(found)
            out[found[same]] = self.log.take(place[same])
            todo, at, end = todo[~hit], at[~hit] + 1, end[~hit]
        return out


def _others(ids: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """Lists (word, m) for each of n texts: its words from `first` to `last` among ids, and how often each occurs."""

    def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return ids[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]

    size = last - first
    one, two = _word_keys(gathered(first, size).astype(np.int64), np.cumsum(size) - size)
    order = np.lexsort((two, one, text))
    one, two, text = one[order], two[order], text[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(order)])
    pick, times = order[new], np.diff(new, append=len(order))
    rows = pa.StructArray.from_arrays([_binary(gathered(first[pick], size[pick]), size[pick]), pa.array(times, pa.int32())], names=["word", "m"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(n + 1)), pa.int32()), rows)


def sequence_scores(voc: Vocabulary, model: Attention, ids: np.ndarray, lengths: np.ndarray, block: int = 256) -> np.ndarray:
    """Log10 probability of each sequence of at least one id; ids holds them one after another."""
    cls = voc.cls[ids]
    inputs, begin = _inputs(cls, lengths), np.cumsum(lengths) - lengths
    out = np.add.reduceat(voc.log_in_class[ids], begin) * LN10
    seq, start, scored, end = windows(lengths)
    size, skip = end - start, scored - start
    order = np.lexsort((skip, size))  # windows of like length and first scored position share a batch
    tables = model.tables()
    for i in range(0, len(order), block):
        own = order[i : i + block]
        t, since = int(size[own].max()), int(skip[own].min())
        first = begin[seq[own]] + start[own]
        here = first[:, None] + np.minimum(np.arange(t), size[own][:, None] - 1)
        h = model.hidden(inputs.take(here), since, tables)[-1]
        at, here = np.arange(since, t), here[:, since:]
        on = (at >= skip[own][:, None]) & (at < size[own][:, None])
        if on.all():
            got = model.log_classes(h.reshape(here.size, -1), cls.take(here.ravel()), tables).reshape(here.shape)
            sums = got.sum(1, dtype=np.float64)
        else:
            got = np.zeros(on.shape)
            got[on] = model.log_classes(h[on], cls[here[on]], tables)
            sums = got.sum(1)
        out += np.bincount(seq[own], sums, len(lengths))
    return out / LN10


def closed(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences with an end each."""
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


def subword_counts(counts: DataFrame, n_docs: int, path: str, pattern: str) -> np.ndarray:
    """How often all training texts hold each id, the end of a text last; the table that reaches the driver has a row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        total = np.zeros(len(coder.tokens), np.int64)
        for b in batches:
            found, n = _unbinary(b.column(0), _id_type(coder))
            total += np.bincount(found, np.repeat(b.column(1).to_numpy(), n), len(total)).astype(np.int64)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(bpe.load(path, pattern).tokens) + 1, np.float64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    out[-1] = n_docs
    return out


def pair_counts(counts: DataFrame, voc: Vocabulary, path: str, pattern: str) -> np.ndarray:
    """Weights of (input, class): pairs within words as often as they occur; after a word's last id, and at a text's begin,
    the classes that begin a word by their share. At most a row a pair of classes reaches the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, voc = bpe.load(path, pattern), shared.value
        total = np.zeros(CLASSES * (CLASSES + 1))  # of each class, the classes after it, and how often a word ends with it
        for b in batches:
            ids, n = _unbinary(b.column(0), _id_type(coder))
            if not len(n):
                continue
            cls, last = voc.cls[ids], np.cumsum(n) - 1
            after = np.append(cls[1:], CLASSES)
            after[last] = CLASSES
            total += np.bincount(cls * (CLASSES + 1) + after, np.repeat(b.column(1).to_numpy(), n), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CLASSES * (CLASSES + 1))
    total[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    total = total.reshape(CLASSES, CLASSES + 1)
    begins = voc.share * (np.arange(CLASSES) < CLASSES // 2)
    return np.vstack([total[:, :-1] + total[:, -1:] * begins / begins.sum(), total[:, -1].sum() * begins / begins.sum()])


def text_batches(batches: Iterator[pa.RecordBatch], voc: Vocabulary, kind: type, size: int) -> Iterator[tuple]:
    """Batches of windows, end to end, that hold every id and every end of all texts once."""
    rng = np.random.default_rng(5)
    for own in _parts(batches, 0):
        ids, lengths = closed(*_unbinary(own.column(0), kind), voc.end)
        cls, begin = voc.cls[ids], np.cumsum(lengths) - lengths
        inputs = _inputs(cls, lengths)
        seq, start, _, end = windows(lengths, WINDOW)
        order = np.lexsort((rng.random(len(seq)), end - start))  # windows of like length share a batch
        for k in rng.permutation(range(0, len(order), size)):
            own = order[k : k + size]
            n = (end - start)[own]
            t = np.arange(int(n.max()))
            here = (begin[seq[own]] + start[own])[:, None] + np.minimum(t, n[:, None] - 1)
            yield inputs.take(here), cls.take(here), t < n[:, None]


def _keep_memory() -> None:
    """Lets this worker keep the memory that numpy frees, up to 64 MB: handing it back and asking again takes as long as the arithmetic."""
    if c := c_library():
        c.mallopt(-3, 1 << 26)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD


def learn_round(docs: DataFrame, n_docs: float, model: Attention, voc: Vocabulary, rate: float, path: str, pattern: str) -> int:
    """Trains `model` on all texts: each task takes a copy through its own ones, the copies' mean by what they learnt from stays.
    Returns the number of positions learnt from."""
    tasks = max(1, int(n_docs / TASK))
    size = int(np.clip(min(n_docs, TASK) / 5, 16, BATCH))
    names, shared = sorted(model.p), docs.sparkSession.sparkContext.broadcast((model, voc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        own, voc = copy.deepcopy(shared.value)
        learnt = own.follow(text_batches(batches, voc, _id_type(bpe.load(path, pattern)), size), rate)
        if learnt:
            values = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * learnt
            yield pa.RecordBatch.from_arrays([pa.array([learnt]), pa.array([values.tobytes()], pa.binary())], names=["learnt", "model"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, total = 0, np.zeros(0)
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.float64)
                learnt, total = learnt + n, total + values if len(total) else values
        if learnt:
            yield pa.RecordBatch.from_arrays([pa.array([learnt]), pa.array([total.tobytes()], pa.binary())], names=["learnt", "model"])

    kind = "learnt long, model binary"
    sums = docs.select("ids").coalesce(tasks).mapInArrow(run, kind).repartition(SUMS).mapInArrow(add, kind).collect()  # at most SUMS rows of the model's size
    learnt = sum(r.learnt for r in sums)
    if learnt:
        mean, at = sum(np.frombuffer(bytes(r.model), np.float64) for r in sums) / learnt, 0
        for k in names:
            size = model.p[k].size
            model.p[k] = mean[at : at + size].reshape(model.p[k].shape).astype(model.p[k].dtype)
            at += size
    return learnt


def train(docs: DataFrame, n_docs: int, counts: DataFrame, path: str, pattern: str) -> tuple[Vocabulary, Attention, int]:
    """The vocabulary and the model, and the number of positions it learnt from: all of all texts of docs."""
    voc = vocabulary(subword_counts(counts, n_docs, path, pattern), bpe.load(path, pattern))
    model, learnt, low = Attention(voc.share, pair_counts(counts, voc, path, pattern)), 0, 0
    part = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(32))
    for parts, rate in ROUNDS:
        learnt += learn_round(docs.where((part >= low) & (part < low + parts)), n_docs * parts / 32, model, voc, rate, path, pattern)
        low += parts
    return voc, model, learnt


def score(docs: DataFrame, usable: Column, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows where `usable` holds."""
    spark = docs.sparkSession
    rows = settle(encoded(docs, usable, path, pattern), "ids")
    texts = rows.where("ids is not null").select("doc_id", "learns", "ids", "words")
    training = texts.where("learns").select("doc_id", "ids")
    n_docs = training.count()
    counts = settle(rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + (n_docs > 0)
    voc, model, _ = train(training, n_docs, counts, path, pattern)
    # The most frequent words, by the least count that at most TOP words reach (eight steps to a doubling).
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).orderBy(F.desc("s")).collect():
        if (total := total + r.c) > TOP:
            break
        least = r.s
    top = (counts.where(step >= least) if least is not None else counts.limit(0)).select("word", "n").toArrow().combine_chunks()  # at most TOP words
    kind = _id_type(bpe.load(path, pattern))
    found = Counts(*_unbinary(top["word"].combine_chunks(), kind), top["n"].to_numpy().astype(np.int64))
    del top
    shared = spark.sparkContext.broadcast((voc, model, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model, found = shared.value
        _keep_memory()
        for own in _parts(batches, 2):
            ids, size = _unbinary(own.column(2), kind)
            scores = sequence_scores(voc, model, *closed(ids, size, voc.end))
            first = np.flatnonzero(voc.begins[ids])
            text = np.searchsorted(np.cumsum(size), first, "right")
            logs = found.find(ids, first)
            known = ~np.isnan(logs)
            arrays = [own.column(0), own.column(1), own.column(3), pa.array(np.bincount(text[known], minlength=len(size))), pa.array(np.bincount(text[known], logs[known], len(size)).astype(np.float64)), pa.array(scores)]  # without words bincount counts in integers
            arrays.append(_others(ids.astype(kind), first[~known], np.append(first[1:], len(ids))[~known], text[~known], len(size)))
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "doc_id", "words", "known", "logs", "score", "others"])

    scored = with_row_id(texts).select("_row", "doc_id", "ids", "words").mapInArrow(run, "_row long, doc_id long, words long, known long, logs double, score double, others array<struct<word:binary,m:int>>")
    scored = settle(scored, "scored")
    drop_settled(rows)
    rest = scored.select("_row", F.explode("others").alias("o")).select("_row", "o.word", "o.m").join(counts, "word")
    rest = rest.groupBy("_row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.drop("others").join(rest, "_row", "left")
    known = F.col("known") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + float(np.log10(n_docs + 1))
    tokens = F.col("words") + 1
    return out.select("doc_id", tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (logs - tokens * float(np.log10(n + v + 1))).alias("base_score"), "score")
