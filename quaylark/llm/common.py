"""Shared pieces: scratch tables, text hashing in numpy, components, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Text handed to numpy at once, in bytes; bounds the memory of a Python worker.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch where rows carry whole texts.
TEXT_BATCH_ROWS = 256
#: Bytes of an Arrow batch, about, but for a single longer row.
BATCH_BYTES = 8 << 20
#: Bits of the filter of within, and of one of its rows: 2048 rows of 4 KB at most are broadcast, whatever the input.
FILTER_BITS, ROW_BITS = 26, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts travel to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_SCRATCH: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only a session that runs in one
    process, as in tests, may leave it unset; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quaylark-"))
        base = f"file://{_LOCAL[0]}"
    path = f"{base.rstrip('/')}/quaylark-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


_LOCAL: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors. The shuffle
    files of its making go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        _delete(_SCRATCH.pop(df._staged_at), df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _SCRATCH.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in either case."""
    names = {c.lower() for c in docs.columns}
    return next(x for x in (f"{name}{i}" for i in range(10**6)) if x not in names)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = 20_000) -> DataFrame:
    """Broadcasts small only if it is counted to have at most limit rows; else shuffles both, and
    adaptive execution splits skewed keys."""
    n = small.limit(limit + 1).count()
    return big.join(F.broadcast(small) if n <= limit else small, on, how)


def within(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns on are, most likely, those of a row of wanted; none of these is lost. What is
    broadcast is a filter of fixed size, whatever the input."""
    place = F.shiftrightunsigned(F.xxhash64(*on), 64 - FILTER_BITS)
    slot, bit = F.shiftrightunsigned("place", ROW_BITS), F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    seen = wanted.select(place.alias("place")).groupBy(slot.alias("slot")).agg(F.bitmap_construct_agg(bit).alias("map"))
    byte = F.conv(F.hex(F.substring("map", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("place", place).join(F.broadcast(seen), slot == F.col("slot"))
    return met.where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Of batches sorted by keys, the columns of each run of equal keys, as lists; a run may span batches."""
    held: dict[str, list] | None = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        rows = list(zip(*(cols[k] for k in keys), strict=True))
        a = 0
        for b in [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]] + [len(rows)] * bool(rows):
            part = {n: v[a:b] for n, v in cols.items()}
            if held and all(held[k][0] == part[k][0] for k in keys):
                for n, v in part.items():
                    held[n] += v
            else:
                if held:
                    yield held
                held = part
            a = b
    if held:
        yield held


# ---------------------------------------------------------------- hashing of words

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        with np.errstate(over="ignore"):
            for i, r in ((0, _R), (1, _RINV)):
                x = np.full(n, r, np.uint64)
                x[0] = 1
                _POW[i] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cuts at ASCII white space, so that no word is cut."""
    at, n = 0, len(data)
    while n - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        window = np.frombuffer(data, np.uint8, PIECE_BYTES, at)
        cut = np.flatnonzero(_WS[window[-65536:]])
        if len(cut):
            end = end - 65536 + int(cut[-1]) + 1
        else:
            while end < n and not _WS[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    ws = _WS[buf]
    edge = np.diff(np.concatenate(([True], ws, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    pw, inv = _powers(max(len(buf), 1))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * pw[: len(buf)], out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    batch: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not batch:
            return
        h, starts, _ = _hash_piece(b" ".join(b for _, b in batch))
        ends = np.cumsum([len(b) + 1 for _, b in batch])
        cuts = np.searchsorted(starts, ends)
        a = 0
        for (i, _), b in zip(batch, cuts, strict=True):
            out[i].append(h[a:b])
            a = b
        batch.clear()
        size = 0

    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        for p in _pieces(data):
            batch.append((i, p))
            size += len(p)
            if size >= PIECE_BYTES:
                flush()
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            h = np.uint64(n)
            for i in range(n):
                h = h + words[i] * _STEP[i]
            return mix(np.array([h], np.uint64))
        h = words[: n - k + 1] * _STEP[0] + np.uint64(k)
        for i in range(1, k):
            h += words[i : n - k + 1 + i] * _STEP[i]
    return np.unique(mix(h))


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by edges (a, b), of long nodes; nodes are
    those of the edges. Alternates large-star and small-star, each a grouped minimum and a join on
    the node; every round is a written table. Rounds grow with the logarithm of the nodes."""
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while e.groupBy("a").count().where("count > 1").limit(1).count() or e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = staged(e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct())
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
