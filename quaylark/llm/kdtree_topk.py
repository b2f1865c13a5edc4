"""Exact top-k search by inner product with KD-trees per shard.

Shards are the leaves of a coarse KD-tree, whose median splits are fitted on a bounded sample; every row is
dealt to a shard, and a shard of over SHARD rows is several cells. A cell's task builds one KD-tree of its
rows, median splits on the widest dimension with a tight bounding box at every node, and streams queries
through it: each walks the tree best-first by the box's bound on its inner product and stops once the bound is
below its kth score. Queries search their own shard first; what they find there is the kth score that they take
to the other shards, and only to those whose bounding box can still reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaylark.llm.common import staged

#: Rows of a cell, about: a bound on what a task holds.
SHARD = 16384
#: At most so many rows, by hash order, fit the shards' splits, and so many shards there are at most.
SAMPLE, SHARDS = 20_000, 1024
LEAF = 64


class KdTree:
    """rows (told apart by number), ids and integer vectors; boxes by node."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        #: node: (low, high, first row, last row, left child or -1); the right child follows the left
        self.low, self.high, self.span, self.child = [], [], [], []
        self._add(vectors)
        todo = [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            part = vectors[order[a:b]]
            self.span[node] = (a, b)
            spread = self.high[node] - self.low[node]
            if b - a <= LEAF or not spread.any():
                continue
            m = (b - a) // 2
            split = np.argpartition(part[:, int(spread.argmax())], m)
            order[a:b] = order[a:b][split]
            self.child[node] = len(self.low)
            for x, y in ((a, a + m), (a + m, b)):
                todo.append((self._add(vectors[order[x:y]]), x, y))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.most = _largest(vectors)

    def widen(self) -> None:
        if self.vectors.dtype != object:
            self.low, self.high, self.vectors = (x.astype(object) for x in (self.low, self.high, self.vectors))

    def _add(self, part: np.ndarray) -> int:
        self.low.append(part.min(0))
        self.high.append(part.max(0))
        self.span.append((0, 0))
        self.child.append(-1)
        return len(self.low) - 1

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k best (score, -id) but for row own; with least, only scores of at least that."""
        best: list[tuple[int, int]] = []
        bound = box_bounds(self.low, self.high, query)

        def floor() -> int | None:
            kth = best[0][0] if len(best) == k else None
            return kth if least is None else least if kth is None else max(kth, least)

        heap = [(-int(bound[0]), 0)]
        while heap:
            most, node = heapq.heappop(heap)
            # at an equal score a smaller id may still come
            if (f := floor()) is not None and -most < f:
                break
            c = self.child[node]
            if c >= 0:
                for x in (c, c + 1):
                    if f is None or bound[x] >= f:
                        heapq.heappush(heap, (-int(bound[x]), x))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            at = np.arange(b - a) if f is None else np.flatnonzero(scores >= f)
            for s, i, r in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), self.rows[a:b][at].tolist(), strict=True):
                if r == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return best


def box_bounds(low: np.ndarray, high: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The largest inner product of query with a point of each box."""
    return high @ np.maximum(query, 0) + low @ np.minimum(query, 0)


def _largest(*parts: np.ndarray) -> int:
    return max(max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in parts)


def _kind(dims: int, most: int, query: np.ndarray) -> type:
    """Python's integers where int64 might not hold an inner product or a bound of one."""
    return object if dims * most * _largest(query) >= 2**63 else np.int64


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(n, -1)


def splits(sample: np.ndarray, shards: int) -> list[tuple[int, float, int]]:
    """A coarse KD-tree as rows (dimension, cut, left child); a negative child is -1 - shard, the right
    child follows the left, and a leaf is (-1, 0, shard)."""
    nodes: list[tuple[int, float, int]] = [(-1, 0.0, 0)]
    todo, made = [(0, sample, shards)], 0
    while todo:
        node, part, n = todo.pop(0)
        spread = part.max(0).astype(float) - part.min(0) if len(part) else np.zeros(1)
        if n < 2 or not spread.any():
            nodes[node] = (-1, 0.0, made)
            made += 1
            continue
        d = int(spread.argmax())
        cut = float(np.median(part[:, d].astype(float)))
        below = part[:, d].astype(float) < cut
        if not below.any():
            cut = float(np.nextafter(cut, np.inf))
            below = part[:, d].astype(float) < cut
        nodes[node] = (d, cut, len(nodes))
        nodes += [(-1, 0.0, 0)] * 2
        todo += [(len(nodes) - 2, part[below], n // 2), (len(nodes) - 1, part[~below], n - n // 2)]
    return nodes


def shard_of(nodes: list[tuple[int, float, int]], v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.int32)
    todo = [(0, np.arange(len(v)))]
    while todo:
        node, at = todo.pop()
        d, cut, left = nodes[node]
        if d < 0:
            out[at] = left
            continue
        below = v[at, d].astype(float) < cut
        todo += [(left, at[below]), (left + 1, at[~below])]
    return out


def _dealt(rows: DataFrame, trees: dict[int, list]) -> DataFrame:
    """rows with the shard of each."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, out = np.asarray(b.column("dim")), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = shard_of(trees[int(d)], _matrix(b.column("v").take(pa.array(at)), len(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "shard"])

    return rows.mapInArrow(f, "row long, vec_id long, dim int, v array<long>, shard int")


def _boxes(dealt: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """By dimension and shard: the rows and the bounding box; as many as there are shards."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            dims, shards = np.asarray(b.column("dim")), np.asarray(b.column("shard"))
            for d, s in set(zip(dims.tolist(), shards.tolist(), strict=True)):
                at = np.flatnonzero((dims == d) & (shards == s))
                v = _matrix(b.column("v").take(pa.array(at)), len(at))
                n, low, high = held.get((d, s), (0, v[0], v[0]))
                held[d, s] = [n + len(at), np.minimum(low, v.min(0)), np.maximum(high, v.max(0))]
        if held:
            yield pa.RecordBatch.from_pydict({"dim": [d for d, _ in held], "shard": [s for _, s in held], "n": [x[0] for x in held.values()], "low": [x[1].tolist() for x in held.values()], "high": [x[2].tolist() for x in held.values()]}, schema=schema)

    out: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
    for r in dealt.mapInArrow(f, "dim int, shard int, n long, low array<long>, high array<long>").toLocalIterator():
        n, low, high = out.get((r["dim"], r["shard"]), (0, np.array(r["low"]), np.array(r["high"])))
        out[r["dim"], r["shard"]] = (n + r["n"], np.minimum(low, r["low"]), np.maximum(high, r["high"]))
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, candidates before queries: a cell's candidates are held, queries stream."""
    cell, parts, tree = None, [], None
    for batch in batches:
        cells = np.asarray(batch.column("cell"))
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if cells[a] != cell:
                cell, parts, tree = cells[a], [], None
            part = batch.slice(a, b - a)
            asks, rows, ids, v = np.asarray(part.column("asks")), np.asarray(part.column("row")), np.asarray(part.column("vec_id")), _matrix(part.column("v"), b - a)
            own = ~asks
            if own.any():
                parts.append((rows[own], ids[own], v[own]))
            if asks.any() and parts:
                tree = tree or KdTree(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                least = part.column("least").to_pylist()
                for i in np.flatnonzero(asks).tolist():
                    if _kind(v.shape[1], tree.most, v[i]) is object:
                        tree.widen()
                    best = tree.search(v[i].astype(tree.vectors.dtype, copy=False), int(rows[i]), k, least[i])
                    out += [(int(rows[i]), int(ids[i]), -x, s) for s, x in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "query_id", "vec_id", "score"])


def _found(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query's cells so far, written."""
    both = candidates.select(F.xxhash64("dim", "shard", "cell").alias("cell"), F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("long").alias("least"))
    both = both.unionByName(queries.select(F.xxhash64("dim", "shard", "cell").alias("cell"), F.lit(True).alias("asks"), "row", "vec_id", "v", "least"))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "cell").sortWithinPartitions("cell", "asks", "vec_id").mapInArrow(lambda b: _search(b, k), "row long, query_id long, vec_id long, score long")
    return staged(found)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows by integer inner product of floor(scale * x),
    x as double, ties to the smaller id, for queries whose id is divisible by every, but for themselves.

    Vectors null, empty, or holding null or non-finite components take no part, nor do null ids. A finite
    component whose floor(scale * x) is no long is an error, as is one of a cell's k best scores that is none. Only
    vectors of the query's own length are candidates. Rows that repeat an id are rows of their own: each is
    a candidate of the other, and each is a query where the id is one. With fewer candidates than k all are
    returned. Other columns are ignored."""

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < float(2**63), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component times scale is no long")).cast("long"))

    one, many = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    fine = F.forall(many, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(one.isNotNull() & many.isNotNull() & (F.size(many) > 0) & fine)
    # written, as the numbers of rows are not drawn twice alike
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), one.cast("long").alias("vec_id"), F.size(many).alias("dim"), F.transform(many, whole).alias("v")))
    trees = {}
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        sample = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("v").collect()
        trees[r["dim"]] = splits(np.array([x["v"] for x in sample], np.int64).reshape(-1, r["dim"]), min(SHARDS, -(-r["n"] // SHARD)))
    dealt = staged(_dealt(rows, trees))
    boxes = _boxes(dealt)
    # as many rows as there are shards
    sizes = vectors.sparkSession.createDataFrame([(d, s, -(-n // SHARD)) for (d, s), (n, _, _) in boxes.items()], "dim int, shard int, cells long")
    cells = dealt.join(F.broadcast(sizes), ["dim", "shard"]).withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    asking = dealt.where(F.col("vec_id") % every == 0)

    def visits(queries: DataFrame) -> DataFrame:
        return queries.join(F.broadcast(sizes), ["dim", "shard"]).withColumn("cell", F.explode(F.expr("sequence(0L, cells - 1)")))

    first = _found(cells, visits(asking.withColumn("least", F.lit(None).cast("long"))), k)
    kth = _ranked(first, k).where(F.col("rank") == k).select("row", F.col("score").alias("least"))
    schema = "row long, vec_id long, dim int, v array<long>, least long, shard int"
    shards = {d: np.array([s for e, s in boxes if e == d], np.int32) for d, _ in boxes}
    lows, highs = ({d: np.array([boxes[d, s][i] for s in x.tolist()]) for d, x in shards.items()} for i in (1, 2))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = [], []
            for i, (d, v, own, least) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "v", "shard", "least")), strict=True)):
                q = np.array(v, np.int64)
                kind = _kind(d, _largest(lows[d], highs[d]), q)
                bounds = box_bounds(lows[d].astype(kind), highs[d].astype(kind), q.astype(kind))
                chosen = shards[d][(shards[d] != own) & (True if least is None else (bounds >= least).astype(bool))]
                at += [i] * len(chosen)
                to += chosen.tolist()
            if at:
                some = b.drop_columns(["shard"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.int32())], [*some.schema.names, "shard"])

    second = _found(cells, visits(asking.join(kth, "row", "left").select("row", "vec_id", "dim", "v", "least", "shard").mapInArrow(others, schema)), k)
    out = _ranked(first.unionByName(second), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
