"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) (queries: 0), M the longest norm in the
sample that the tree is fit on. The tree is fit on bounded samples, and its leaves grow in number with the table; every
row goes down it to one leaf.
A query visits leaves in the order in which a priority queue over tree nodes yields them, nearest first. How many
it visits is calibrated: visits widen until queries drawn from the data reach the recall asked for.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ._store import forget, written

SHARD_ROWS = 8192
QUERY_ROWS = 512
QUERY_BLOCK = 16_384
SAMPLE_ROWS = 16_384
LEAF_SAMPLE = 4096
MOST_LEAVES = 65_536


@dataclass
class Tree:
    """children[i]: the nodes below node i, none for a leaf; centres[i]; leaf[i]: a leaf's number."""

    centres: np.ndarray
    children: list[list[int]]
    longest: float

    def __post_init__(self) -> None:
        self.number()

    def number(self) -> None:
        """Numbers the leaves from left to right, so that numbers close to each other are mostly close in space."""
        self.leaf, todo, n = [-1] * len(self.children), [0], 0
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += reversed(self.children[node])
            else:
                self.leaf[node], n = n, n + 1
        self.leaves = n
        self._squares = np.square(self.centres).sum(1)

    def graft(self, below: dict[int, Tree]) -> None:
        """Puts a tree below each of the given leaves."""
        nodes = {self.leaf[i]: i for i in range(len(self.leaf)) if self.leaf[i] in below}
        for leaf, part in below.items():
            base = len(self.children) - 1  # the part's root is the leaf itself
            self.children[nodes[leaf]] = [base + c for c in part.children[0]]
            self.children += [[base + c for c in x] for x in part.children[1:]]
            self.centres = np.r_[self.centres, part.centres[1:]]
        self.number()

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.c_[x, rest]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the nearest child."""
        lifted, out = self.lifted(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            below = np.array(self.children[node])
            near = (self._squares[below] - 2 * lifted[rows] @ self.centres[below].T).argmin(1)
            todo += [(int(c), rows[near == i]) for i, c in enumerate(below) if (near == i).any()]
        return out

    def distances(self, queries: np.ndarray) -> Iterator[list[float]]:
        """For each query its squared distances to all nodes' centres, less its own square."""
        step = max(1, 2_000_000 // len(self.children))
        for low in range(0, len(queries), step):
            yield from (self._squares - 2 * queries[low : low + step] @ self.centres[:, :-1].T).tolist()

    def visit(self, distance: list[float], most: int) -> list[int]:
        """The first ``most`` leaves, best bin first: a priority queue of nodes by the distance of their centres."""
        queue, out, push, pop = [(0.0, 0)], [], heapq.heappush, heapq.heappop
        while queue and len(out) < most:
            _, node = pop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            else:
                for c in self.children[node]:
                    push(queue, (distance[c], c))
        return out


def fit_tree(sample: np.ndarray, branch: int = 16, leaf_rows: int = 64, rounds: int = 8, seed: int = 1, longest: float | None = None) -> Tree:
    """A tree whose leaves have at most about ``leaf_rows`` rows of the sample, as far as it has different rows."""
    longest = float(np.sqrt((sample * sample).sum(1).max(initial=0.0))) if longest is None else longest
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [[]], longest)
    lifted, random = tree.lifted(sample), np.random.default_rng(seed)
    centres, todo = [lifted.mean(0) if len(lifted) else tree.centres[0]], [(0, np.arange(len(lifted)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        distinct = np.unique(lifted[rows], axis=0) if len(rows) > leaf_rows else []
        if len(distinct) <= branch or depth >= 12:
            continue
        mean = distinct[random.choice(len(distinct), branch, replace=False)]
        own = lifted[rows]
        for _ in range(rounds):
            near = (np.square(mean).sum(1) - 2 * own @ mean.T).argmin(1)
            mean = np.stack([own[near == i].mean(0) if (near == i).any() else mean[i] for i in range(branch)])
        near = (np.square(mean).sum(1) - 2 * own @ mean.T).argmin(1)
        groups = [i for i in range(branch) if (near == i).any()]
        if len(groups) < 2:
            continue
        for i in groups:
            tree.children[node].append(len(tree.children))
            todo.append((len(tree.children), rows[near == i], depth + 1))
            tree.children.append([])
            centres.append(mean[i])
    tree.centres = np.stack(centres)
    tree.number()
    return tree


def exact_dots(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up component by component, so that equal vectors score equal anywhere."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


def best_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, ties to smaller ids; ids ascend."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1, None]
    out = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores >= kth):
        at = np.flatnonzero(row)
        out[i] = at[np.argsort(-scores[i, at], kind="stable")[:k]]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): vectors that aren't null or zero and hold no null or non-finite component."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.93, sample_rows: int = SAMPLE_ROWS, trial_queries: int = 128, branch: int = 16, leaf_rows: int = 64, most_leaves: int = MOST_LEAVES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found to each query, rows of its own id left out.

    All rows are indexed. The tree is fit on at most ``sample_rows`` rows, by hash of their id; leaves that then hold
    many more rows than ``leaf_rows`` are split on samples of LEAF_SAMPLE rows each, in tasks of their own, until
    leaves grow in number with the table, up to ``most_leaves``. Up to ``trial_queries`` queries are compared with every
    row, and visits widen until their mean recall reaches ``recall``; at the widest, every leaf is visited and the result
    is exact. A query that has then found fewer than ``k`` rows visits all leaves. Scores are inner products of the
    original vectors in double precision; ties go to smaller ids.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows of another length
    than most, or with a null id. Repeated rows each count as candidates; of queries with equal ids one asks, that with
    the least vector. Extra columns aren't read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    shape = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], shape)
    width = widths[0]
    rows = rows.where(F.size("v") == width["n"])
    asked = asked.where(F.size("v") == width["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked, _ = written(asked, "ann-asked")
    tree, placed, sizes = _grown(rows, width["count"], sample_rows, branch, leaf_rows, most_leaves)
    trial = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(trial_queries).toArrow()
    trial_ids, trial_vectors = trial["vec_id"].to_numpy(), _matrix(trial["v"])
    visits = _calibrated(placed, tree, trial_ids, trial_vectors, k, recall) if len(trial_ids) else tree.leaves
    most = min(SHARD_ROWS, max(256, width["count"] // (4 * spark.sparkContext.defaultParallelism)))
    first, blocks = _shards(sizes, most)
    sent = spark.sparkContext.broadcast((tree, first, blocks))

    found, _ = written(_nearest_of(placed, asked, sent, 0, visits, k), "ann-found")
    if visits < tree.leaves:
        # A query whose leaves hold fewer than k rows goes on to all the others.
        enough = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k)
        short, _ = written(asked.join(enough, "vec_id", "left_anti"), "ann-short")
        if not short.isEmpty():
            found = _top(found.unionByName(_nearest_of(placed, short, sent, visits, tree.leaves, k)), k)
    rank = F.row_number().over(_by_score())
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


def _by_score() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a limit on each task's part goes before the shuffle."""
    return found.withColumn("_at", F.row_number().over(_by_score())).where(F.col("_at") <= k).drop("_at")


def _place(tree: Tree, rows: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.descend(_matrix(batch.column(1))))], ["vec_id", "v", "leaf"])

    return rows.mapInArrow(place, "vec_id long, v array<double>, leaf int")


def _grown(rows: DataFrame, total: int, sample_rows: int, branch: int, leaf_rows: int, most_leaves: int) -> tuple[Tree, DataFrame, np.ndarray]:
    """The tree, the rows with their leaf, and the rows of each leaf (most_leaves numbers at most)."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()  # sample_rows at most
    sample = _matrix(taken["v"])
    tree = fit_tree(sample, branch, max(8, leaf_rows * len(sample) // max(1, total)))
    whole: set[tuple] = set()
    while True:
        placed, path = written(_place(tree, rows), "ann-leaves")
        sizes = np.zeros(tree.leaves, np.int64)
        for r in placed.groupBy("leaf").count().collect():
            sizes[r["leaf"]] = r["count"]
        centre = {tree.leaf[i]: tuple(tree.centres[i, :4]) for i in range(len(tree.leaf)) if tree.leaf[i] >= 0}
        large = [i for i in np.flatnonzero(sizes > 4 * leaf_rows).tolist() if centre[i] not in whole]
        large = sorted(large, key=lambda i: -sizes[i])[: max(0, (most_leaves - tree.leaves) // 64)]
        if not large or total <= sample_rows:
            return tree, placed, sizes
        shares = rows.sparkSession.createDataFrame([(i, max(1, int(sizes[i]) // LEAF_SAMPLE)) for i in large], "leaf int, one_of long")
        part = placed.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(5)), "one_of") == 0)  # a row a leaf
        longest = tree.longest

        def split(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("vec_id").slice(0, 4 * LEAF_SAMPLE)
            target = max(8, len(table) // 64, leaf_rows // table["one_of"][0].as_py())
            found = fit_tree(_matrix(table["v"]), branch, target, longest=longest)
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps((found.centres, found.children))])})

        below = {r["leaf"]: Tree(*pickle.loads(r["tree"]), longest) for r in part.groupBy("leaf").applyInArrow(split, "leaf int, tree binary").collect()}
        whole |= {centre[i] for i in large if i not in below or below[i].leaves < 2}
        below = {i: x for i, x in below.items() if x.leaves > 1}
        if not below:
            return tree, placed, sizes
        tree.graft(below)
        forget(rows.sparkSession, path)


def _shards(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first shard and its blocks: small leaves side by side share one, a leaf over ``most`` rows has several."""
    first, blocks, at, held = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[i] = at
        if n > most:
            blocks[i] = -(-n // most)
            at, held = at + int(blocks[i]), 0
        else:
            held += n
    return first, blocks


def _nearest_of(placed: DataFrame, asked: DataFrame, sent, low: int, high: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of the rows in the leaves that a query visits from the low-th to before the high-th, its k best."""
    spark = placed.sparkSession

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, blocks = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(start, QUERY_ROWS)
                at, shard, leaves = [], [], []
                for i, distance in enumerate(tree.distances(_matrix(batch.column(1)))):
                    own = np.array(sorted(tree.visit(distance, high)[low:]), np.int64)
                    of = np.repeat(first[own], blocks[own]) + _counted(blocks[own])
                    leaf = np.repeat(own, blocks[own])
                    order = np.argsort(of, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else np.zeros(0, np.int64)
                    at += [i] * len(cuts)
                    shard.append(of[order][cuts])
                    leaves += np.split(leaf[order], cuts[1:]) if len(cuts) else []
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(shard).astype(np.int32)), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "q", "shard", "leaves"])

    tasks = 2 * spark.sparkContext.defaultParallelism  # few bytes, but much work
    routed, _ = written(asked.select("vec_id", "v").repartition(tasks, "vec_id").mapInArrow(route, "query_id long, q array<double>, shard int, leaves array<int>"), "ann-routes")
    turns = np.zeros(int((sent.value[1] + sent.value[2]).max(initial=1)), np.int32)  # 4 bytes for each SHARD_ROWS rows
    for r in routed.groupBy("shard").count().collect():
        turns[r["shard"]] = -(-r["count"] // QUERY_BLOCK)
    turns_sent = spark.sparkContext.broadcast(turns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, blocks = sent.value
        for batch in batches:
            leaf, part = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shard = first[leaf] + part % blocks[leaf]
            copies = turns_sent.value[shard]
            at = np.repeat(np.arange(len(leaf)), copies)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(_counted(copies).astype(np.int32)), *(batch.column(i).take(pa.array(at)) for i in (2, 0, 1))], ["shard", "turn", "leaf", "vec_id", "v"])

    spread = placed.select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)).alias("part"))
    dealt = spread.mapInArrow(deal, "shard int, turn int, leaf int, vec_id long, v array<double>")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = batch.column(4).to_numpy() % np.maximum(turns_sent.value[batch.column(2).to_numpy()], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(turn.astype(np.int32))], ["query_id", "q", "shard", "leaves", "turn"])

    left = routed.withColumn("turn", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(1 << 30))).mapInArrow(turned, "query_id long, q array<double>, shard int, leaves array<int>, turn int")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": [], "vec_id": [], "score": []}, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        leaf, ids, v = right["leaf"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"])
        out = [none]
        for low in range(0, left.num_rows, QUERY_ROWS):
            part = left.slice(low, QUERY_ROWS).combine_chunks()
            own, q = part["query_id"].to_numpy(), _matrix(part["q"])
            out.append(pa.table(dict(zip(("query_id", "vec_id", "score"), best_of_leaves(own, q, part["leaves"].to_pylist(), leaf, ids, v, k), strict=True)), none.schema))
        return pa.concat_tables(out)

    return _top(left.groupBy("shard", "turn").cogroup(dealt.groupBy("shard", "turn")).applyInArrow(nearest, "query_id long, vec_id long, score double"), k)


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 to sizes[0] - 1, 0 to sizes[1] - 1 and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def best_of_leaves(own: np.ndarray, q: np.ndarray, leaves: list[list[int]], leaf: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows in its leaves. Rows are sorted by leaf.

    Matrix products pick what may be among the k best; the scores themselves are added up component by component.
    """
    scores = np.full((len(q), len(v)), -np.inf)
    who = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
    flat = np.array([x for own_leaves in leaves for x in own_leaves], np.int64)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(flat)], strict=True):
        low, high = np.searchsorted(leaf, flat[a]), np.searchsorted(leaf, flat[a], side="right")
        if low < high:
            scores[who[a:b], low:high] = q[who[a:b]] @ v[low:high].T
    scores[own[:, None] == ids[None, :]] = -np.inf
    near = scores > -np.inf
    if len(v) > k:
        slack = 1e-12 * len(v[0]) * np.sqrt((q * q).sum(1).max() * (v * v).sum(1).max())
        near &= scores >= np.partition(scores, len(v) - k, axis=1)[:, len(v) - k, None] - slack
    i, j = np.nonzero(near)
    exact = np.zeros(len(i))
    for d in range(q.shape[1]):
        exact += q[i, d] * v[j, d]
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return own[i[keep]], ids[j[keep]], exact[keep]


def _calibrated(placed: DataFrame, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaf visits with which the trial queries find ``recall`` of their true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SHARD_ROWS):
                part = pa.Table.from_batches([batch.slice(low, SHARD_ROWS)]).sort_by("vec_id")
                own, scores = part["vec_id"].to_numpy(), exact_dots(queries, _matrix(part["v"]))
                scores[ids[:, None] == own[None, :]] = -np.inf
                best = best_k(scores, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), best.shape[1])), pa.array(own[best.ravel()]), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(part["leaf"].to_numpy()[best.ravel()])], ["query_id", "vec_id", "score", "leaf"])

    found = placed.mapInArrow(run, "query_id long, vec_id long, score double, leaf int").where(F.col("score") > float("-inf"))
    true: dict[int, list[int]] = {}
    for r in _top(found, k).collect():  # k rows a trial query
        true.setdefault(r["query_id"], []).append(r["leaf"])
    order = [{leaf: n for n, leaf in enumerate(tree.visit(x, tree.leaves))} for x in tree.distances(queries)]
    needed = np.array(sorted(order[i][leaf] + 1 for i, leaves in true.items() for leaf in leaves))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else tree.leaves


def op1_ann_tree(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
