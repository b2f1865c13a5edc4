"""N-gram Jaccard self-join by signature trees.

Whole texts become sets of 5-word shingles; documents with equal sets are one class and the join runs
over one representative each. A block of representatives is joined by a signature tree: leaves hold a
token bitmap and the set size, inner nodes the OR of the bitmaps and the range of sizes, and a dual
traversal drops a pair of nodes when the largest overlap that they allow can't reach the threshold.
Leaves that remain are verified on the whole sets.

Blocks come from two rounds. The first blocks by minimum hashes and joins most copies, so that large
groups collapse early; it may miss links. The second is exact: shingles are ordered by a corpus count
(rarest first), every representative gives the prefix that any partner at the threshold must meet, and
each prefix shingle whose documents aren't all connected yet is a block. Blocks over BLOCK rows are cut
into pairs of chunks, each pair of chunks a task of its own, so that no task grows with a hot shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import components, mix, released, runs, shingle_set, small_batches, staged, within, words_of

#: Buckets of the corpus count of shingles: a bound on what is broadcast.
COUNT_BUCKETS = 1 << 20
#: Buckets of a row in which a task's counts travel.
SLICE = 1 << 14
#: Rows of a block that one task joins at once.
BLOCK = 1024
#: Minimum hashes for the first round.
KEYS = 2
#: Up to so many documents of a prefix shingle meet pair by pair; more are a block.
FEW = 64
LEAF = 32
_SHIFT = np.uint64(64 - (COUNT_BUCKETS - 1).bit_length())


def needed(nx, ny, percent: int):
    """The least overlap of sets of these sizes whose Jaccard similarity reaches percent."""
    return -(-percent * (nx + ny) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class SignatureTree:
    """Nodes over sets sorted by size and smallest member: OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.sets, self.words = sets, bits // 64
        maps = np.zeros((len(sets), self.words), np.uint64)
        for r, i in enumerate(self.order):
            b = sets[i] & np.uint64(bits - 1)
            np.bitwise_or.at(maps[r], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        self.maps = maps
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}

    def node(self, a: int, b: int) -> tuple[np.ndarray, int, int]:
        """Bitmap, least and largest size of rows a to b."""
        if (a, b) not in self.nodes:
            self.nodes[a, b] = (np.bitwise_or.reduce(self.maps[a:b], axis=0), int(self.sizes[a]), int(self.sizes[b - 1]))
        return self.nodes[a, b]


def may_link(x: SignatureTree, p: tuple[int, int], y: SignatureTree, q: tuple[int, int], percent: int) -> bool:
    """Whether a set below node p of x and one below node q of y can reach the threshold. Sizes bound
    the overlap, and no bit in common means none. In a node of few rows, each row's own bitmap shows
    how many of its members, at least, are outside all sets of the other node."""
    (mp, lo_p, hi_p), (mq, lo_q, hi_q) = x.node(*p), y.node(*q)
    if 100 * hi_p < percent * lo_q or 100 * hi_q < percent * lo_p or not (mp & mq).any():
        return False
    for t, (a, b), other, lo in ((x, p, mq, lo_q), (y, q, mp, lo_p)):
        if b - a <= LEAF:
            n = t.sizes[a:b]
            most = n - np.bitwise_count(t.maps[a:b] & ~other).sum(1, dtype=np.int64)
            if not (most >= needed(n, np.maximum(lo, -(-percent * n // 100)), percent)).any():
                return False
    return True


def tree_pairs(sets_x: list[np.ndarray], sets_y: list[np.ndarray] | None, percent: int, connected, join) -> None:
    """Calls join(i, j) for linked pairs, skipping those for which connected(i, j) holds. With
    sets_y None the pairs are those within sets_x."""
    largest = max(len(s) for s in [*sets_x, *(sets_y or [])])
    bits = 256
    while bits < min(2 * largest, 4096):
        bits *= 2
    x = SignatureTree(sets_x, bits)
    y = x if sets_y is None else SignatureTree(sets_y, bits)
    stack = [((0, len(sets_x)), (0, len(y.sets)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        own = y is x and (a, b) == (c, d)
        if not own and not may_link(x, (a, b), y, (c, d), percent):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            leaves(x, a, b, y, c, d, own, percent, connected, join)
        elif own:
            m = (a + b) // 2
            stack += [((a, m), (m, b)), ((m, b), (m, b)), ((a, m), (a, m))]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [((m, b), (c, d)), ((a, m), (c, d))]
        else:
            m = (c + d) // 2
            stack += [((a, b), (m, d)), ((a, b), (c, m))]


def leaves(x, a, b, y, c, d, own, percent, connected, join) -> None:
    mx, my = x.maps[a:b, None, :], y.maps[None, c:d, :]
    nx, ny = x.sizes[a:b, None], y.sizes[None, c:d]
    # a bit that only one side holds stands for one member at least that isn't shared
    most = np.minimum(nx - np.bitwise_count(mx & ~my).sum(2, dtype=np.int64), ny - np.bitwise_count(my & ~mx).sum(2, dtype=np.int64))
    for r, s in np.argwhere(most >= needed(nx, ny, percent)):
        if own and a + r >= c + s:
            continue
        i, j = x.order[a + r], y.order[c + s]
        if not connected(i, j) and linked(x.sets[i], y.sets[j], percent):
            join(i, j)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def _block(ids: list, side: list, comp: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The links of a spanning forest of one block. side 0 and 1 are chunks; equal comp: connected."""
    forest, first, found = Forest(len(ids)), {}, []
    for i, c in enumerate(comp):
        forest.join(i, first.setdefault(c, i))

    def pairs(x: list[int], y: list[int] | None) -> None:
        if not x or y is not None and not y:
            return
        at = x if y is None else y

        def join(i: int, j: int) -> None:
            forest.join(x[i], at[j])
            found.append((ids[x[i]], ids[at[j]]))

        tree_pairs([sets[i] for i in x], None if y is None else [sets[i] for i in y], percent, lambda i, j: forest.root(x[i]) == forest.root(at[j]), join)

    a, b = ([i for i, s in enumerate(side) if s == k] for k in (0, 1))
    if b:
        pairs(a, b)
    else:
        # the least document first: in a group of copies it mostly joins all
        hub = min(a, key=lambda i: ids[i])
        for i in a:
            if forest.root(i) != forest.root(hub) and linked(sets[i], sets[hub], percent):
                forest.join(i, hub)
                found.append((ids[i], ids[hub]))
        if len({forest.root(i) for i in a}) > 1:
            pairs(a, None)
    return found


def _sets(df: pd.DataFrame) -> Iterator[tuple[object, np.ndarray]]:
    for i, w in zip(df["id"], words_of(df["text"].tolist()), strict=True):
        yield i, shingle_set(w)


def _chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id is in ids, which are distinct: a filter of fixed size drops most others where they are
    read, what it lets through is shuffled. An inner join, as a semi join would be pushed below the filter."""
    return within(texts, ids, ["id"]).join(ids, "id")


def _with_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the texts whose id is in ids."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(i, s.tobytes()) for i, s in _sets(df)]
            yield pd.DataFrame(rows, columns=["id", "shingles"])

    return _chosen(texts, ids).mapInPandas(f, "id long, shingles binary")


def _profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: a document's set size, two sums that stand for the set, and minimum hashes. kind 1:
    the counts of the task's shingles by bucket."""
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    columns = ["kind", "id", "n", "s1", "s2", "k0", "k1", "counts"]
    for df in frames:
        rows, buckets = [], []
        for i, s in _sets(df):
            if not len(s):
                rows.append((0, i, 0, 0, 0, 0, 0, None))
                continue
            buckets.append((s >> _SHIFT).astype(np.int32))
            with np.errstate(over="ignore"):
                t = mix(s ^ np.uint64(0xA5A5A5A5))
                sums = [int(v.sum(dtype=np.uint64).view(np.int64)) for v in (s, mix(t + np.uint64(1)))]
            rows.append((0, i, len(s), *sums, int(s[0].view(np.int64)), int(t.min().view(np.int64)), None))
        if buckets:
            counts += np.bincount(np.concatenate(buckets), minlength=COUNT_BUCKETS)
        yield pd.DataFrame(rows, columns=columns)
    for a in range(0, COUNT_BUCKETS, SLICE) if counts.any() else ():
        rows = [(1, a, TaskContext.get().partitionId(), 0, 0, 0, 0, _packed(counts[a : a + SLICE]))]
        yield pd.DataFrame(rows, columns=columns)


def _packed(counts: np.ndarray) -> bytes:
    """All counts, or places and counts of those above 0 where that is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 2 * len(at) >= len(counts) else np.concatenate((at, counts[at])).tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    x = np.frombuffer(packed, np.int64)
    if len(x) == len(total):
        total += x
    else:
        total[x[: len(x) // 2]] += x[len(x) // 2 :]


PROFILE = "kind int, id long, n long, s1 long, s2 long, k0 long, k1 long, counts binary"


def _counts(profile: DataFrame) -> np.ndarray:
    """The corpus count of each bucket of shingles, summed in two steps; COUNT_BUCKETS numbers."""

    def add(df: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for x in df["counts"]:
            _add(total, x)
        return pd.DataFrame({"id": df["id"].iloc[:1], "counts": [_packed(total)]})

    some = profile.where("kind = 1").select("id", (F.col("n") % 32).alias("part"), "counts").groupBy("id", "part").applyInPandas(add, "id long, counts binary")
    out = np.zeros(COUNT_BUCKETS, np.int64)
    for r in some.groupBy("id").applyInPandas(add, "id long, counts binary").toLocalIterator():
        _add(out[r["id"] : r["id"] + SLICE], r["counts"])
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _prefixes(counts: np.ndarray, percent: int):
    """Rows (h, id, n) of each text's prefix: its rarest shingles, as many as any partner must meet."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            h, ids, ns = [], [], []
            for i, s in _sets(df):
                n = len(s)
                if not n:
                    continue
                p = n - -(-percent * n // 100) + 1
                c = counts[(s >> _SHIFT).astype(np.int64)]
                if p < n:
                    # ties of the count at the cut go by hash, as s is sorted
                    cut = np.partition(c, p - 1)[p - 1]
                    below = np.flatnonzero(c < cut)
                    chosen = np.concatenate((below, np.flatnonzero(c == cut)[: p - len(below)]))
                else:
                    chosen = np.arange(n)
                h.append(s[chosen].view(np.int64))
                ids.append(np.full(len(chosen), i, np.int64))
                ns.append(np.full(len(chosen), n, np.int32))
            if h:
                yield pd.DataFrame({"h": np.concatenate(h), "id": np.concatenate(ids), "n": np.concatenate(ns)})

    return f


def _unlike(rows: DataFrame, column: str) -> DataFrame:
    """(h, c), written: the shingles whose rows differ in column, and the count of their rows. Counted before
    they are shuffled, so no task gets all rows of a hot shingle."""
    by = rows.groupBy("h").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("c"))
    return staged(by.where("lo < hi").select("h", "c"))


def _chunked(rows: DataFrame) -> DataFrame:
    """rows (block, id, comp) cut into tasks (block, u, v, side, id, comp): chunk u joined with
    itself (side 0 only) or with chunk v. The number of chunks follows the block's count."""
    size = rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows_in"))
    big = rows.join(size, "block").withColumn("chunks", F.ceil(F.col("rows_in") / BLOCK).cast("int"))
    big = big.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(11)), F.col("chunks")).cast("int"))
    tasks = big.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return tasks.select("block", F.least("chunk", "other").alias("u"), F.greatest("chunk", "other").alias("v"), F.when(F.col("other") < F.col("chunk"), 1).otherwise(0).alias("side"), "id", "comp")


def _pair_tasks(few: DataFrame, percent: int) -> DataFrame:
    """Tasks of two for the pairs of prefix rows (h, id, n, comp) of few documents each.

    Take the one of a pair whose prefix ends first in the order: what its prefix doesn't share with the
    other's prefix the other lacks. So a pair at the threshold shares at least needed - n + prefix
    shingles of the prefixes, for one of the two. A pair that also meets in a block of many documents
    may be dropped here, as that block joins it."""
    x, y = few.alias("x"), few.alias("y")
    close = (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & close).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count(F.lit(1)).alias("shared"))
    prefix = lambda n: n - F.ceil(n * percent / 100) + 1
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    pairs = pairs.where(F.col("shared") >= F.least(least - F.col("na") + prefix(F.col("na")), least - F.col("nb") + prefix(F.col("nb"))))
    zero = F.lit(0)
    return pairs.select(F.xxhash64("a", "b").alias("block"), zero.alias("u"), zero.alias("v"), zero.alias("side"), F.explode(F.array("a", "b")).alias("id")).withColumn("comp", F.col("id"))


def _distinct_blocks(rows: DataFrame) -> DataFrame:
    """Of shingles with the same documents, one as a block (block, id, comp)."""
    same = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sig"))
    return rows.join(same.groupBy("c", "sig").agg(F.min("h").alias("h")).select("h"), "h").select(F.col("h").alias("block"), "id", "comp")


def _links(tasks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in tasks (block, u, v, side, id, comp)."""
    sets = _with_sets(texts, tasks.select("id").distinct())
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tasks.join(sets, "id").repartition(parts, "block", "u", "v").sortWithinPartitions("block", "u", "v", "id")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["block", "u", "v"]):
            got = _block(run["id"], run["side"], run["comp"], [np.frombuffer(x, np.uint64) for x in run["shingles"]], percent)
            if got:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in got], "b": [x for _, x in got]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.mapInArrow(f, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row of docs with an id.

    Texts are lower-cased (A-Z), words are runs of anything but ASCII white space. Null, empty and
    blank texts have no shingles and link with nothing, not with each other. Equal sets always link.
    Rows with a null id are dropped, as they can't be named; rows that repeat an id count as one
    document with the largest of their texts. Other columns of docs are ignored. class_id is the
    smallest id with an equal set (an empty one: its own id), component_id the smallest reachable."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    profile = staged(texts.mapInPandas(_profile, PROFILE))
    if profile.where("kind = 0").groupBy("id").count().where("count > 1").limit(1).count():
        texts = staged(texts.groupBy("id").agg(F.max("text").alias("text")))
        profile = staged(texts.mapInPandas(_profile, profile.schema))
    counts = _counts(profile)
    own = profile.where("kind = 0").drop("kind", "counts")
    least = own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id"), F.first("k0").alias("k0"), F.first("k1").alias("k1"))
    reps = staged(least.select(F.col("class_id").alias("id"), "n", "s1", "s2", "k0", "k1"))

    # round one: blocks by minimum hash; the chunks of a large block share its least document
    keys = reps.select("id", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"k{j}").alias("k")) for j in range(KEYS)])).alias("x")).select("id", F.xxhash64("x.j", "x.k").alias("block"))
    size = keys.groupBy("block").agg(F.count(F.lit(1)).alias("rows_in"), F.min("id").alias("hub")).where("rows_in > 1")
    keyed = keys.join(size, "block").withColumn("chunks", F.ceil(F.col("rows_in") / BLOCK).cast("int"))
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")
    rows = keyed.where("id <> hub").select("block", chunk.alias("u"), "id").unionByName(size.select("block", F.explode(F.expr("sequence(0, cast(ceil(rows_in / %d) as int) - 1)" % BLOCK)).alias("u"), F.col("hub").alias("id")))
    first = staged(_links(rows.select("block", "u", F.col("u").alias("v"), F.lit(0).alias("side"), "id", F.col("id").alias("comp")), texts, percent))
    comps = staged(components(first))

    # round two: every prefix shingle whose documents aren't connected yet
    found = staged(_chosen(texts, reps.select("id")).mapInPandas(_prefixes(counts, percent), "h long, id long, n int"))
    shared = _unlike(found, "id")
    named = staged(within(found, shared, ["h"]).join(shared.select("h"), "h").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("comp")))
    released(found, shared)
    open_ = _unlike(named, "comp")
    open_ = staged(named.join(open_, "h"))
    few = open_.where(F.col("c") <= FEW)
    tasks = _pair_tasks(few, percent).unionByName(_chunked(_distinct_blocks(open_.where(F.col("c") > FEW))))
    second = _links(staged(tasks), texts, percent)

    links = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    joined = components(links).select(F.col("node").alias("class_id"), "component")
    named_own = own.join(least.select("n", "s1", "s2", "class_id"), ["n", "s1", "s2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"))
    return named_own.join(joined, "class_id", "left").select("id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
