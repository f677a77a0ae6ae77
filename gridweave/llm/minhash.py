"""Near-duplicate documents by a chosen-path set similarity join over minwise hashes.

1. Every whole text becomes its set of shingles (64-bit hashes of word runs), a 128-bit digest of the set and K minwise
   hashes. Texts with the same set are one node from here on, however many copies there are. A node is named by the smallest
   id of its texts and the digest, in bytes that sort by the id: the smallest node of a component has the component's id.
2. In each of TREES independent trees nodes branch by the minwise hashes at one or two places that the branch chooses by
   itself, SPREAD / similarity branches on average: a similar pair meets again in more than one branch on average, so
   its chance to stay together doesn't fall to 0 with depth, while a family of texts that share less than that shrinks with
   every level. A branch of at most SMALL nodes ends; larger ones branch again. A branch that keeps as much of its parent
   as the similarity holds copies of one text for the most part; it ends as well, and so does what is still large at DEPTH.
3. In a small branch that ended all pairs are compared by their minwise hashes; those that could reach the similarity
   (less four standard errors) tie nodes to a cluster. In a large one the best of PIVOTS nodes ties the nodes that could
   reach it; the others meet every node of the branch, in units of a bounded size, and a branch returns stars, never pairs.
4. Clusters, the connected components of these ties, get their full sets back from the texts. Small clusters are compared
   exhaustively on them. In large ones the member most like the cluster's common signature is a pivot, and everything close
   to it is linked. The others meet again in the branches where they were candidates, on full sets: with every node of a small
   branch, and in units of a bounded size in a large one; nodes so near to the pivot that they can have no link to the others
   (Jaccard distance is a metric) stay away. A node's set is so sent to the branches it ended in, however large its cluster is.

Links are therefore exact on full sets; recall depends on step 2 alone. A pair at the similarity is lost in one tree with a
probability that grows from 0.12 at depth 1 to 0.32 at depth 4 and 0.49 at depth 10 (0.15, 0.38 and 0.55 at 80 %), in all ten
trees with 1e-9, 1e-5 and 8e-4 (5e-9, 6e-5 and 2e-3). The trees draw from the same K hashes, so a pair whose hashes agree by chance
in fewer places is likelier to miss them all; some 2e-3 (5e-3) have to be expected for pairs exactly at the threshold in the deepest
branches, which only families of tens of thousands reach, and a tenth of that five points above it.

Defined results: null texts and texts without words have an empty set, no link and a component of their own; null ids
count as no id (a component's id is the smallest that is not null); repeated rows share a component, and all rows with the
component's id count as kept; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks_by_size, column_bytes, column_list, drop_settled, lean, mix64, parts, settle, words_of
from gridweave.llm.components import components

K, TREES, DEPTH, SMALL = 128, 10, 10, 128
#: Branches that a node takes on average, times the similarity.
SPREAD = 1.06
#: Pivots that are tried in a branch of copies.
PIVOTS = 3
#: Members of a cluster that is compared in one task.
CLUSTER = 256
#: Nodes of either side of a unit of a large branch, when hashes are compared and when full sets are.
DENSE, BLOCK = 512, 256
#: Rows of ids (some 40 bytes each) in a table that may be broadcast.
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 2**32, K, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, K, dtype=np.uint64).astype(np.uint32)
_C = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Shingle sets of texts; keeps the hashes of the words it has met, up to a bound."""

    def __init__(self, width: int = 5, kept: int = 400_000) -> None:
        self.width, self.kept, self.known = width, kept, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = set(words)
        self.known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        for part in chunks_by_size(texts, 4_000_000):
            words = [words_of(t) for t in texts[part]]
            h = self.hashes([w for ws in words for w in ws])
            at = 0
            for ws in words:
                own, n = h[at : at + len(ws)], self.width
                at += len(ws)
                if not len(own):
                    yield own
                    continue
                runs = len(own) - n + 1
                with np.errstate(over="ignore"):
                    if runs < 1:
                        yield mix64((own * _C[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
                        continue
                    total = np.zeros(runs, np.uint64)
                    for i in range(n):
                        total += own[i : i + runs] * _C[i]
                yield np.unique(mix64(total))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minwise hashes of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = None
    for i in range(0, len(x), 1024):
        part = _A[:, None] * x[None, i : i + 1024]
        part += _B[:, None]
        low = part.min(1)
        best = low if best is None else np.minimum(best, low)
    return best


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty), sig and brief (a byte of each hash) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in parts(batches, 1):
            n, node, sig, brief = [], [], [], []
            for s in shingler.sets(column_bytes(b, "text")):
                low = signature(s) if len(s) else None
                n.append(len(s))
                node.append(digest(s) if len(s) else None)
                sig.append(low.tobytes() if len(s) else None)
                brief.append(mix64(low.astype(np.uint64)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (node, sig, brief))], names=["doc_id", "n_shingles", "node", "sig", "brief"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, node binary, sig binary, brief binary")


def _children(branch: Column, sig: Column, similarity: float) -> Column:
    """Keys of the branches that a node with this signature goes to below `branch`."""
    place = lambda salt: F.pmod(F.xxhash64(branch, F.lit(salt)), F.lit(K)).cast("int")
    child = lambda p: F.xxhash64(branch, p, F.substr(sig, p * 4 + 1, F.lit(4)))
    second = F.pmod(F.xxhash64(branch, F.lit(3)), F.lit(1000)) < int(1000 * (SPREAD / similarity - 1))
    return F.when(second & (place(1) != place(2)), F.array(child(place(1)), child(place(2)))).otherwise(F.array(child(place(1))))


def _min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each of n places, for ties between i and j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Blocks of some rows of a stream sorted by its first column, no group cut in two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = t.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _fixed(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of binary values of one width as a matrix of bytes."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _dense(sig: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """A label for each of many nodes, by ties of those where `rest` holds with all of them."""
    label = np.arange(len(sig))
    for i in np.flatnonzero(rest):
        near = label[(sig == sig[i]).sum(1) >= least]
        label[np.isin(label, near)] = near.min()
    return label


def _ties(members: DataFrame, least: float) -> DataFrame:
    """Stars (u, v) of the clusters in each unit of members(key, node, brief, rest): of at most SMALL nodes all pairs are compared
    by brief, of more those with a node where `rest` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            keys, sig, rest = t.column(0).to_numpy(), _fixed(t.column(2), K), t.column(3).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, g in zip(first[size > SMALL], size[size > SMALL], strict=True):
                left.append(s + _dense(sig[s : s + g], rest[s : s + g], least * K))
                right.append(np.arange(s, s + g))
            for g in np.unique(size[(size > 1) & (size <= SMALL)]):
                a, b = np.triu_indices(g, 1)
                starts = first[size == g]
                step = max(1, 100_000 // len(a))
                for k in range(0, len(starts), step):
                    i, j = ((starts[k : k + step, None] + x).ravel() for x in (a, b))
                    for c in range(0, len(i), 100_000):
                        x, y = i[c : c + 100_000], j[c : c + 100_000]
                        near = (sig[x] == sig[y]).sum(1) >= least * K
                        left.append(x[near])
                        right.append(y[near])
            label = _min_labels(len(keys), np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(label != np.arange(len(keys)))
            node = t.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[label[own]]), pa.array(node[own])], names=["u", "v"])

    n = members.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = members.select("key", "node", "brief", "rest").repartition(int(n), "key").sortWithinPartitions("key", "node")
    return placed.mapInArrow(lean(run), "u long, v long").distinct()


def _on(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", size: int = 40, n: int | None = None) -> DataFrame:
    """Joins rows to a settled table with a row a key, of `size` bytes (n: how many, if known). No key meets in one task: the table is broadcast if it is no
    larger than BROADCAST_ROWS ids, else it is repeated for each of 32 salts that the rows are dealt to by their node."""
    if (few.count() if n is None else n) * size <= BROADCAST_ROWS * 40:
        return rows.join(F.broadcast(few), key, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(32)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def _units(members: DataFrame, most: int) -> DataFrame:
    """(key, node, rest): members(branch, node, rest) dealt so that each node where `rest` holds meets every node of its branch
    in some unit; a unit has some 2 * most nodes."""
    number = lambda c: F.ceil(c / most).cast("int")
    sizes = members.groupBy("branch").agg(number(F.count("*")).alias("alls"), number(F.sum(F.col("rest").cast("long"))).alias("rests")).where("rests > 0")
    dealt = _on(members, settle(sizes, "sizes"), "branch")
    place = lambda n: F.pmod(F.xxhash64("node", "branch"), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("_r")
    one = dealt.select("branch", "node", place(F.col("alls")).alias("_a"), every, F.lit(False).alias("rest"))
    every = F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("_a")
    two = dealt.where("rest").select("branch", "node", every, place(F.col("rests")).alias("_r"), F.lit(True).alias("rest"))
    both = one.unionByName(two).select(F.xxhash64("branch", "_a", "_r").alias("key"), "node", "rest")
    return both.groupBy("key", "node").agg(F.max("rest").alias("rest"))


def _pivot_ties(dense: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Ties (u, v) of the nodes of large branches dense(branch, node, brief) with the best pivot of each, and (branch, node, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _fixed(b.column(2), K) if b.num_rows else np.empty((0, K), np.uint8)
            near = [pa.array((_fixed(b.column(3 + i), K) == own).sum(1) >= least * K) if b.num_rows else pa.array([], pa.bool_()) for i in range(PIVOTS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *near], names=["branch", "node", *(f"near{i}" for i in range(PIVOTS))])

    pivots = dense.groupBy("branch").agg(*(F.min_by(F.struct("node", "brief"), F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)))
    pivots = settle(pivots, "pivot")
    sides = _on(dense, pivots, "branch", size=(K + 40) * PIVOTS).select("branch", "node", "brief", *(F.col(f"p{i}.brief").alias(f"b{i}") for i in range(PIVOTS)))
    near = settle(sides.mapInArrow(lean(run), "branch long, node long, " + ", ".join(f"near{i} boolean" for i in range(PIVOTS))), "near")
    ties = near.groupBy("branch").agg(*(F.sum(F.col(f"near{i}").cast("long")).alias(f"n{i}") for i in range(PIVOTS)))
    # The pivot with the most ties is the branch's.
    best = F.element_at(F.sort_array(F.array(*(F.struct(F.col(f"n{i}").alias("n"), F.lit(i).alias("i"), F.col(f"p{i}.node").alias("u")) for i in range(PIVOTS))), False), 1)
    chosen = settle(ties.join(pivots, "branch").select("branch", best.alias("best")).select("branch", "best.i", "best.u"), "pivot")
    mine = F.element_at(F.array(*(F.col(f"near{i}") for i in range(PIVOTS))), F.col("i") + 1)
    tied = _on(near, chosen, "branch").select("branch", "node", "u", mine.alias("tied"))
    return tied.where("tied and node != u").select("u", F.col("node").alias("v")), tied.select("branch", "node", (~F.col("tied")).alias("rest"))


def candidate_ties(nodes: DataFrame, similarity: float, trees: int = TREES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ties (u, v) between nodes(node, sig, brief), node being a number, that share a branch that ended and could reach the similarity;
    the small branches (branch, node) and the large ones where they met.

    Sizes of branches are counted by partial sums. Only the large branches' rows are joined to them, without a shuffle of a branch to
    one task; the others have at most SMALL rows a branch. Signatures are carried below the first level only for the nodes that get there.
    """
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / K)
    roots = F.explode(F.array(*(F.lit(t).cast("long") for t in range(trees)))).alias("branch")
    level, deep, small, dense = nodes.select("node", "sig", F.lit(None).cast("long").alias("parent"), roots), None, [], []
    for depth in range(1, DEPTH + 1):
        rows = settle(level.select("node", "parent", F.explode(_children(F.col("branch"), F.col("sig"), similarity)).alias("branch")), "branch")
        sizes = settle(rows.groupBy("branch").agg(F.count("*").alias("n"), F.max("parent").alias("parent")).where("n > 1"), "sizes")
        large = sizes.where(F.col("n") > SMALL).select("branch", "n", (F.coalesce(F.col("n") >= similarity * F.col("parent"), F.lit(False)) | F.lit(depth == DEPTH)).alias("ends"))
        n_large, n_ends = large.agg(F.count("*"), F.count_if("ends")).first()
        marked = settle(_on(rows.select("branch", "node"), large, "branch", "left", n=n_large), "marked")
        drop_settled(rows)
        small.append(marked.where("n is null").select("branch", "node").join(sizes.where(F.col("n") <= SMALL).select("branch"), "branch", "left_semi"))
        dense.append(marked.where("ends").select("branch", "node"))
        more = marked.where("not ends")
        if n_ends == n_large:
            break
        if deep is None:
            deep = settle(nodes.select("node", "sig").join(side(settle(more.select("node").distinct(), "deep")), "node", "left_semi"), "deep")
        level = more.select("node", "branch", F.col("n").alias("parent")).join(deep, "node")
    small, dense = settle(_union(small), "small"), _union(dense) if dense else None
    brief = nodes.select("node", "brief")
    units = small.select(F.col("branch").alias("key"), "node", F.lit(True).alias("rest"))
    if dense is None or dense.isEmpty():
        return _ties(units.join(brief, "node"), least), small, small.limit(0)
    stars, members = _pivot_ties(settle(dense.join(brief, "node"), "dense"), least)
    units = units.unionByName(_units(settle(members, "rest"), DENSE))
    return stars.unionByName(_ties(units.join(brief, "node"), least)), small, dense


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, per_cent: int) -> np.ndarray:
    return 100 * inter >= per_cent * (a + b - inter)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of distinct sorted sets, by products of blocks of the incidence matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    uniq, inv, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[inv] > 1  # a shingle of one set alone meets nothing
    rank = np.cumsum(count > 1) - 1
    col, owner = rank[inv[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out = np.zeros((n, n))
    step = max(256, 4_000_000 // n)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [low, low + step])
        m = np.zeros((n, step), np.float32)
        m[owner[i:j], col[i:j] - low] = 1
        out += m @ m.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _star(nodes: list[bytes], sets: list[np.ndarray], per_cent: int) -> tuple[list[bytes], list[bytes]]:
    """Stars of the components that links between the sets make."""
    n = np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(_linked(_overlaps(sets), n[:, None], n[None, :], per_cent), 1))
    label = _min_labels(len(sets), i, j)
    own = np.flatnonzero(label != np.arange(len(sets)))
    return [nodes[k] for k in label[own]], [nodes[k] for k in own]


def _compare(groups: DataFrame, per_cent: int) -> DataFrame:
    """Links (u, v), as stars, within each key of groups(key long, node, shingles, rest); a key without `rest` has no links to look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, us, vs, open_ = None, {}, [], [], False

        def close() -> None:
            if open_ and len(own) > 1:
                u, v = _star(list(own), [_unpack(x) for x in own.values()], per_cent)
                us.extend(u)
                vs.extend(v)

        for b in batches:
            for k, node, raw, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if k != key:
                    close()
                    key, own, open_ = k, {}, False
                open_ |= rest
                if node not in own:
                    own[node] = raw.as_py()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
            us, vs = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("key", "node", "shingles", "rest").repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(run), "u binary, v binary")


def side(few: DataFrame) -> DataFrame:
    """A table of ids as one side of a join: broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members(node, doc_id, cluster, size) with their sets, made again from the texts of one id each; rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for own in parts(batches, 3, 4_000_000):
            sets = list(shingler.sets(column_bytes(own, "text")))
            right = pa.array([len(s) > 0 and digest(s) == n[9:] for s, n in zip(sets, column_list(own, "node"), strict=True)])
            made = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), made], names=["cluster", "size", "node", "shingles"]).filter(right)

    few = side(members).withColumnRenamed("doc_id", "_id")
    joined = docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select("cluster", "size", "node", "text").mapInArrow(lean(run), "cluster long, size long, node binary, shingles binary")


def _distances(pairs: DataFrame) -> DataFrame:
    """Adds the intersection of shingles with the pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.empty(0, np.uint64)
        for b in batches:
            inter = []
            for raw, other in zip(b.column(3), b.column(4), strict=True):
                o = other.as_buffer()
                if last is None or o != last:
                    last, pivot = o, _unpack(o)
                s = _unpack(raw.as_buffer())
                at = np.searchsorted(pivot, s)
                inter.append(int((pivot[np.minimum(at, len(pivot) - 1)] == s).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x.as_buffer()) // 8 for x in b.column(3)], pa.int64()), pa.array([len(x.as_buffer()) // 8 for x in b.column(4)], pa.int64()), pa.array(inter, pa.int64())], names=["cluster", "node", "pivot", "n", "m", "inter"])

    return pairs.select("cluster", "node", "pivot", "shingles", "pivot_shingles").mapInArrow(lean(run), "cluster long, node binary, pivot binary, n long, m long, inter long")


def _common(some: pd.DataFrame) -> pd.DataFrame:
    """The commonest hash at each place; some 256 signatures come here."""
    sig = np.stack([np.frombuffer(x, np.uint32) for x in some["sig"]])
    out = np.empty(K, np.uint32)
    for p in range(K):
        values, n = np.unique(sig[:, p], return_counts=True)
        out[p] = values[n.argmax()]
    return pd.DataFrame({"cluster": some["cluster"].iloc[:1], "common": [out.tobytes()]})


def _likeness(rows: DataFrame) -> DataFrame:
    """How many hashes of each member are its cluster's commonest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_fixed(b.column(2), 4 * K).view(np.uint32) == _fixed(b.column(3), 4 * K).view(np.uint32)).sum(1) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64())], names=["cluster", "node", "like"])

    return rows.select("cluster", "node", "sig", "common").mapInArrow(lean(run), "cluster long, node binary, like long")


def _large_links(sets: DataFrame, nodes: DataFrame, small: DataFrame, dense: DataFrame, per_cent: int) -> DataFrame:
    """Links (u, v) in clusters of more than CLUSTER members, given sets(cluster, node, shingles), nodes(node, sig), and the branches
    small(branch, node) and dense(branch, node) where the members met."""
    reach = 1 - per_cent / 100
    sets = settle(sets.dropDuplicates(["node"]), "sets")
    state = settle(nodes.join(side(sets.select("cluster", "node")), "node").select("cluster", "node", "sig"), "state")
    sizes = settle(state.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    # The common signature of about 256 members, coordinate by coordinate; the member nearest to it is the pivot.
    some = _on(state, sizes, "cluster").where(F.pmod(F.xxhash64("node", F.lit(0)), F.col("n")) < 256)
    common = settle(some.groupBy("cluster").applyInPandas(_common, "cluster long, common binary"), "common")
    best = _likeness(_on(state, common, "cluster", size=4 * K + 40)).groupBy("cluster").agg(F.max(F.struct("like", "node")).alias("b")).select("cluster", F.col("b.node").alias("pivot"))
    best = settle(best.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot"), "pivot")
    # A row a large cluster; a pivot's set meets its members without a shuffle of a cluster to one task.
    longest = best.agg(F.max(F.octet_length("pivot_shingles"))).first()[0] or 0
    pairs = _on(sets.select("cluster", "node", "shingles"), best, "cluster", size=longest + 80).where("node != pivot")
    d = _distances(pairs).withColumn("d", 1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).withColumn("near", F.col("inter") * 100 >= per_cent * (F.col("n") + F.col("m") - F.col("inter")))
    d = settle(d.select("cluster", "node", "pivot", "d", "near"), "distance")
    links = d.where("near").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    # A linked member can have a further link only to a member that isn't, at nearly its own distance from the pivot.
    low = settle(d.where("not near").groupBy("cluster").agg(F.min("d").alias("low")), "low")
    left = settle(_on(d, low, "cluster").where(~F.col("near") | (F.col("d") >= F.col("low") - reach - 1e-9)).select("node", (~F.col("near")).alias("rest")), "left")
    if left.isEmpty():
        return links
    units = small.join(side(left), "node").select(F.col("branch").alias("key"), "node", "rest")
    open_ = units.groupBy("key").agg(F.count("*").alias("n"), F.max("rest").alias("r")).where("r and n > 1").select("key")
    units = units.join(open_, "key", "left_semi")
    large = settle(dense.join(side(left), "node").select("branch", "node", "rest"), "dense")
    if not large.isEmpty():
        units = units.unionByName(_units(large, BLOCK))
    return links.unionByName(_compare(units.join(sets.select("node", "shingles"), "node"), per_cent))


def near_duplicates(docs: DataFrame, per_cent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text); linked from per_cent % similarity."""
    sketched = settle(sketches(docs, width).withColumnRenamed("node", "digest"), "sketch")
    nodes = sketched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("brief").alias("brief"))
    nodes = settle(nodes.select("digest", _name(F.col("doc_id"), F.col("digest")).alias("name"), "sig", "brief", F.monotonically_increasing_id().alias("node")), "node")
    rows = settle(sketched.select("doc_id", "n_shingles", "digest"), "row")
    drop_settled(sketched)
    ties, small, dense = candidate_ties(nodes.select("node", "sig", "brief"), per_cent / 100)
    root = components(ties)
    members = root.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(root.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())
    sizes = root.groupBy(F.col("v").alias("cluster")).agg((F.count("*") + 1).alias("size"))
    members = members.join(sizes, "cluster").join(nodes.select("node", "name"), "node").select("node", "name", _id(F.col("name")).alias("doc_id"), "cluster", "size")
    members = settle(members, "member")
    clustered = lambda few: members.where(few).select(F.col("name").alias("node"), "doc_id", "cluster", "size")
    alone = _with_sets(docs, clustered(F.col("size") <= CLUSTER), width)
    links = _compare(alone.withColumnRenamed("cluster", "key").withColumn("rest", F.lit(True)), per_cent)
    large = settle(members.where(F.col("size") > CLUSTER).select("node", "name"), "large")
    if not large.isEmpty():
        sigs = nodes.select(F.col("name").alias("node"), "sig")
        met = [settle(t.join(side(large), "node").select("branch", F.col("name").alias("node")), "met") for t in (small, dense)]
        links = links.unionByName(_large_links(_with_sets(docs, clustered(F.col("size") > CLUSTER), width), sigs, *met, per_cent))
    links = components(links)
    joint = nodes.select("digest", "name").join(links.select(F.col("u").alias("name"), F.col("v").alias("root")), "name", "left")
    joint = settle(joint.select("digest", _id(F.coalesce("root", "name")).alias("component_id")), "joint")
    drop_settled(nodes)
    out = rows.join(joint, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _name(doc_id: Column, digest: Column) -> Column:
    """25 bytes that sort by id, ids that are null last."""
    top = F.shiftleft(F.lit(1).cast("long"), 63)
    number = F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).cast("long").bitwiseXOR(top)), 16, "0"))
    return F.concat(F.unhex(F.when(doc_id.isNull(), "01").otherwise("00")), number, digest)


def _id(name: Column) -> Column:
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 63))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), number)


#: The contract of op2_minhash in SQL, by exhaustive joins on shingles; for small tables.
SQL = """
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as h from s), k as (select h, doc_id, n from x),
l as (select a.doc_id as a, b.doc_id as b from k a join k b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select a, b from l union all select b, a from l),
r as (select a as doc_id, b as other from e union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as low from r group by doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) as component_id, least(s.doc_id, coalesce(c.low, s.doc_id)) = s.doc_id as kept from s left join c on s.doc_id = c.doc_id
"""
