"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces (the matches of a pattern) are encoded once per distinct piece of a block of texts. The pieces that are not yet
known are sorted into buckets by length, each bucket is one matrix with a column per piece, and in each round
every column merges its leftmost pair of the lowest rank, which is the least of its keys (rank, place): the places of a piece are a
linked list, the pair's new neighbours are looked up in a hash table, and columns without a pair left the matrix. Pieces of over LONG bytes,
for which rounds over a matrix would take quadratic time, are merged with a heap in the same order.

Null text counts as empty, and an empty text has no ids. Very long texts are matched piecewise, so memory is bounded by a
block of matches and the ids of one text. Rows are handled alone: repeated rows give repeated results, an empty table
gives an empty one, ties between pairs of equal rank go to the leftmost, and columns beside the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridweave.llm.common import chunks_by_size, column_list, lean, parts

LONG = 512
NONE = np.int32(2**31 - 1)
#: Pieces that a worker keeps encoded, and characters of text that are cut into pieces at once (bytes of those taken from a batch).
KEPT, BLOCK = 200_000, 1_000_000
#: Bits of a place in a piece of at most LONG bytes.
_BITS = (LONG - 1).bit_length()
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing over pairs of ids: key (left << 32 | right) to the rank of the merged token."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # each round places the keys that are first at a free slot
            self.probes += 1
            slot = (at[left] + self.probes - 1) & self.mask
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], ranks[left[put]]
            left = left[~put]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MULT) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where a pair makes no token."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        todo = np.arange(keys.size)
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        for p in range(self.probes):
            at = (slot[todo] + p) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))] if p == 0 else todo[~hit]
            if not len(todo):
                break
        return flat.reshape(out.shape)


class ByteBPE:
    """Encoder and decoder for a rank file: a line holds a token in base64 and its rank."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.table = PairTable(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pairs = self.table.get(*(np.ascontiguousarray(x) for x in np.broadcast_arrays(self.byte_ids[:, None], self.byte_ids)))
        self.kind = np.int32 if len(self.tokens) < 1 << (30 - _BITS) else np.int64  # of a rank and a place
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def merge_bucket(self, pieces: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of similar length, as one padded matrix, and their numbers."""
        n, width = len(pieces), int(lens.max())
        inside = np.arange(width) < lens[:, None]
        raw = np.zeros((n, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        raw, alive = np.ascontiguousarray(raw.T), np.ascontiguousarray(inside.T)  # a row a place
        key = np.full((width, n), NONE, self.kind)  # of the pair that begins at each place: its rank, then the place
        key[:-1] = self._keys(np.where(alive[1:], self.byte_pairs.take(raw[:-1] * np.int32(256) + raw[1:]), NONE), np.arange(width - 1, dtype=self.kind)[:, None])
        places = np.repeat(np.arange(width, dtype=np.int32), n)
        ids, after, before, row = self.byte_ids.take(raw.ravel()), places + 1, places - 1, np.arange(n)
        live_at = alive.reshape(-1)
        while True:
            low = key.min(0)
            live = low != NONE
            if not live.all():
                row, low, key = row[live], low[live], key[:, live]
                if not len(row):
                    break
            pos, best, col = low & (LONG - 1), (low >> _BITS).astype(np.int32), np.arange(len(row))
            here = pos.astype(np.int64) * n + row
            gone = after.take(here)
            there = gone.astype(np.int64) * n + row
            right, left = after.take(there), before.take(here)
            ids[here], after[here], live_at[there], key[gone, col] = best, right, False, NONE
            key[pos, col] = NONE
            i = np.flatnonzero(right < lens[row])
            at = right[i].astype(np.int64) * n + row[i]
            before[at] = pos[i]
            key[pos[i], i] = self._keys(self.table.get(best[i], ids.take(at)), pos[i])
            i = np.flatnonzero(left >= 0)
            at = left[i].astype(np.int64) * n + row[i]
            key[left[i], i] = self._keys(self.table.get(ids.take(at), best[i]), left[i])
        out_lens, alive = alive.sum(0), alive.T
        out = np.zeros((n, width), np.int32)
        out[np.arange(width) < out_lens[:, None]] = ids.reshape(width, n).T[alive]
        return out, out_lens

    def _keys(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank and behind it the place, so that the least is the leftmost of the lowest rank; NONE stays."""
        return np.where(rank != NONE, rank.astype(self.kind) << _BITS | place, NONE)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive, get = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has. A piece that is itself a token is that token."""
        n = np.ones(len(pieces), np.int64)
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = np.where(lens <= 32, -(-lens // 4), 8 + np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rest = whole < 0
        for i in np.flatnonzero(rest & (lens > LONG)).tolist():
            ids = self.merge_long(pieces[i])
            n[i] = len(ids)
            parts.append((np.array([i]), ids[None, :]))
        rest &= (lens <= LONG) & (lens > 0)
        n[lens == 0] = 0
        for s in np.unique(size[rest]):
            members = np.flatnonzero(rest & (size == s))
            step = max(64, 400_000 // int(lens[members].max()))
            for k in range(0, len(members), step):
                own = members[k : k + step]
                ids, n[own] = self.merge_bucket([pieces[i] for i in own.tolist()], lens[own])
                parts.append((own, ids[:, : int(n[own].max())]))
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[start[whole >= 0]] = whole[whole >= 0]
        for own, ids in parts:
            here = np.arange(ids.shape[1]) < n[own][:, None]
            out[(start[own][:, None] + np.arange(ids.shape[1]))[here]] = ids[here]
        return out, n

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        ids, n = self.encode_flat(pieces)
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(pieces)
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        for part in chunks_by_size(texts, BLOCK):
            if len(texts[part]) == 1 and texts[part][0] and len(texts[part][0]) > 2 * BLOCK:
                matches, ids = (m[0] for m in self.pattern.finditer(texts[part][0])), []
                while some := list(islice(matches, BLOCK // 4)):
                    self.learn(set(some))
                    ids.append(b"".join(map(self.known.__getitem__, some)))
                yield b"".join(ids)
                continue
            pieces = [self.pattern.findall(t) if t else [] for t in texts[part]]
            self.learn(set().union(*pieces))
            get = self.known.__getitem__
            for p in pieces:
                yield b"".join(map(get, p))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, in blocks of ids."""
        a, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(a), 1 << 20):
            part = a[k : k + (1 << 20)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.buffer[np.arange(int(ends[-1])) + np.repeat(self.starts[part] - (ends - n), n)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """A worker keeps the tables of a rank file; the file lies at the same path on every machine."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with `ids` (array of int) of every text and `decoded`, the text made from the ids again.

    Columns of `keep` that are called ids or decoded are left out for the new ones. Ids whose bytes are not UTF-8, which a
    rank file that holds every byte can't give, raise UnicodeDecodeError.
    """
    keep = tuple(k for k in keep if k not in ("ids", "decoded"))
    own_names = [f"_c{i}" for i in range(len(keep))]
    schema = docs.select(*(docs[k].alias(n) for k, n in zip(keep, own_names, strict=True))).schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for own in parts(batches, at, BLOCK):
            ids = list(bpe.encode_texts(own.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(own.column(i) for i in range(len(keep))),
                    pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array([bpe.decode(x).decode() for x in ids], pa.string()),
                ],
                names=[*own_names, "ids", "decoded"],
            )

    own_text = [] if text in keep else [docs[text].alias("_text")]  # a kept text travels once
    at = keep.index(text) if text in keep else len(keep)
    renamed = docs.select(*(docs[k].alias(n) for k, n in zip(keep, own_names, strict=True)), *own_text)
    return renamed.mapInArrow(lean(run), f"{schema}, ids array<int>, decoded string").toDF(*keep, "ids", "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in parts(batches, 1, BLOCK):
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_texts(column_list(b, "text")):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
