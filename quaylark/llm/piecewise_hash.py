"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last WINDOW bytes ends a chunk where it is 0 modulo the block size; a chunk's
hash gives one character of the signature. A fingerprint has the signatures at a block size and at its
double, "size:first:second". Two fingerprints compare where they share a block size, by the edit distance
of the signatures there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import mix, small_batches

WINDOW = 7
LEAST_BLOCK = 4
SIGNATURE = 64
#: At most so many ranges, and rows to broadcast; tasks stream through larger ranges beyond.
MOST_BUCKETS = 100_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_PART = 1 << 20


def _rolled(buf: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the WINDOW - 1 before."""
    x = np.concatenate((np.zeros(WINDOW - 1, np.uint64), buf.astype(np.uint64) + np.uint64(1)))
    out = np.zeros(len(buf), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            out = out * _MULTIPLY + x[i : i + len(buf)]
    return mix(out)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; null counts as empty. The block size is LEAST_BLOCK times a
    power of two, the least that gives at most SIGNATURE chunks; an empty text gives "4::". A chunk's
    character follows its bytes alone, so an edit changes the chunks it touches and no others."""
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    ends, lows = [], []
    for a in range(0, len(buf), _PART):
        lead = min(a, WINDOW - 1)
        h = _rolled(buf[a - lead : a + _PART])[lead:]
        at = np.flatnonzero((h & np.uint64(LEAST_BLOCK - 1)) == 0)
        ends.append(at + a)
        lows.append(h[at])
    at = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    low = np.concatenate(lows) if lows else np.zeros(0, np.uint64)
    block = LEAST_BLOCK

    def cuts(size: int) -> np.ndarray:
        return at[(low & np.uint64(size - 1)) == 0]

    while len(c := cuts(block)) >= SIGNATURE:
        block *= 2
    return f"{block}:{_signature(buf, c)}:{_signature(buf, cuts(block * 2))}"


def _signature(buf: np.ndarray, ends: np.ndarray) -> str:
    if not len(buf):
        return ""
    data, a, out = buf.tobytes(), 0, []
    for b in [*(ends + 1).tolist(), len(buf)]:
        if b > a:
            out.append(ALPHABET[hashlib.blake2b(data[a:b], digest_size=1).digest()[0] & 63])
            a = b
    return "".join(out)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs of strings of at most 64 characters, by bit-parallel columns over all
    pairs at once."""
    n = len(left)
    m = np.array([len(s) for s in left], np.uint64)
    peq = np.zeros((n, 128), np.uint64)
    for i, s in enumerate(left):
        for j, c in enumerate(s):
            peq[i, ord(c)] |= np.uint64(1 << j)
    longest = max((len(s) for s in right), default=0)
    codes = np.zeros((n, longest), np.int64)
    for i, s in enumerate(right):
        codes[i, : len(s)] = np.frombuffer(s.encode(), np.uint8)
    lengths = np.array([len(s) for s in right])
    one = np.uint64(1)
    vp, vn, score = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64), m.astype(np.int64)
    top = one << (np.maximum(m, one) - one)
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(longest):
            x = peq[rows, codes[:, j]] | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hn, hp = vp & d0, vn | ~(vp | d0)
            live = (lengths > j) & (m > 0)
            score += live * (((hp & top) != 0).astype(np.int64) - ((hn & top) != 0))
            hp, hn = (hp << one) | one, hn << one
            vp, vn = np.where(live, hn | ~(d0 | hp), vp), np.where(live, hp & d0, vn)
    return np.where(m == 0, lengths, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 less the edit distance over the longer signature, the
    best at the block sizes that both have; 0 if they share none. Equal fingerprints give 1."""
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        a, b = {bx: x1, 2 * bx: x2}, {by: y1, 2 * by: y2}
        pairs += [(i, a[s], b[s]) for s in a.keys() & b.keys() if a[s] or b[s]]
    out = np.array([float(x == y) for x, y in zip(left, right, strict=True)])
    if pairs:
        at = np.array([i for i, _, _ in pairs])
        longest = np.array([max(len(x), len(y)) for _, x, y in pairs])
        np.maximum.at(out, at, 1 - distances([x for _, x, _ in pairs], [y for _, _, y in pairs]) / longest)
    return out


def edited(text: str, other: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows in order of (bucket, id, text); the last of a bucket is the first of the next, and gives nothing itself."""
    held: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        for bucket, last, i, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "last", "id", "text")), strict=True):
            text = text or ""
            now = (bucket, i, text, fingerprint(text))
            if held and held[0] == bucket:
                new = edited(held[2], text)
                rows.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3], fingerprint(new), now[3]))
            held = None if last else now
        if rows:
            i, n, sha, own, new, following = (list(x) for x in zip(*rows, strict=True))
            yield pd.DataFrame({"doc_id": pd.array(i, "Int64"), "n_chars": n, "edited_sha256": sha, "fingerprint": own, "edited_fingerprint": new, "near_edited": likeness(own, new), "near_next": likeness(own, following)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_in_bucket: int = 2000) -> DataFrame:
    """SCHEMA for each row of docs: its fingerprint, that of its edited text, and likenesses.

    The next document is the next in order of (id, text); after the last comes the first, and a lone
    document follows itself. Null texts are empty; a null id comes first and stays null; rows that
    repeat are each a document. Other columns are ignored.

    Rows are dealt by ranges of the id, cut at quantiles of the ids, of about rows_in_bucket rows or, in
    MOST_BUCKETS ranges, more; tasks
    stream through a range, which also gets the first row of the next. Rows that share an id, or have none,
    are in one range, through which its task streams."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n = base.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    parts = min(MOST_BUCKETS, -(-n // rows_in_bucket))
    cuts = sorted({int(x) for x in base.approxQuantile("id", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts))}) if parts > 1 else []

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(np.int64), "right"))

    # null ids come first; without nulls the UDF gets longs, not floats
    base = base.withColumn("bucket", bucket(F.coalesce("id", F.lit(-(2**63)))) if cuts else F.lit(0))
    # of the first rows only ids, one for each range, come to the driver
    firsts = {r["bucket"]: r["id"] for r in base.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("x")).select("bucket", "x.id").collect()}
    order = sorted(firsts)
    before = dict(zip(order[1:] + order[:1], order, strict=True))
    # at most MOST_BUCKETS rows, so the broadcast is bounded
    heads = spark.createDataFrame([(firsts[b], b, before[b]) for b in order], "id long, bucket int, back int")
    fits = base["id"].eqNullSafe(heads["id"]) & (base["bucket"] == heads["bucket"])
    head = base.join(F.broadcast(heads), fits).groupBy(base["id"], heads["back"]).agg(F.min("text").alias("text")).select("id", "text", F.col("back").alias("bucket"))
    rows = base.select("bucket", F.lit(0).alias("last"), "id", "text").unionByName(head.select("bucket", F.lit(1).alias("last"), "id", "text"))
    rows = rows.repartition(max(len(order), 1), "bucket").sortWithinPartitions("bucket", "last", F.asc_nulls_first("id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in _compare(batches):
            yield pa.RecordBatch.from_pandas(df, schema=schema, preserve_index=False)

    return rows.mapInArrow(f, SCHEMA)
