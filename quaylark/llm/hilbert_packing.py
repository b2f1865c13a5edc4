"""Packing along a space-filling curve.

A document's token ids, hashed into a random projection, give a vector of few dimensions; its Hilbert
index is the sort key. Documents are dealt by ranges of that key and cut, in order, into sequences; a
range's rest becomes sequences with a power of two of tokens, which need no padding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import mix, small_batches, staged

DIMENSIONS = 4
BITS = 12
END = 1
#: Bytes of tokens that one task packs, about.
RANGE_BYTES = 32 << 20
#: The special token of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict[str, object] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None):
    """The byte-level BPE of a rank file, which gives the ids of the tokenizers file of its vocabulary."""
    path = path or default_path()
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def token_ids(text: str | None, enc) -> np.ndarray:
    """A text's ids and END; null counts as empty. SPECIAL strings in a text are their one id."""
    text = text or ""
    special = "all" if any(s in text for s in SPECIAL) else set()
    ids = enc.encode_to_numpy(text, allowed_special=special, disallowed_special=())
    return np.append(ids.astype(np.uint32), np.uint32(END))


def projection(size: int) -> np.ndarray:
    """A row of DIMENSIONS random signs for each id, by hash."""
    h = mix(np.arange(size, dtype=np.uint64) + np.uint64(0x51ED270B))
    return np.stack([((h >> np.uint64(i)) & np.uint64(1)).astype(np.float32) * 2 - 1 for i in range(DIMENSIONS)], axis=1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of cells (integers below 2 ** bits), as a long."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _tokenised(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    signs = projection(enc.n_vocab)
    for batch in batches:
        ids = [token_ids(t, enc) for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        v = np.stack([signs[x[:-1]].sum(0) / np.sqrt(max(len(x) - 1, 1)) for x in ids])
        cells = np.clip((1 / (1 + np.exp(-1.7 * v)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        small = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hilbert(cells)), pa.array([x.astype(small).tobytes() for x in ids], pa.binary())], ["id", "key", "tokens"])


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def tail_lengths(n: int) -> list[int]:
    """n as powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _packed(batches: Iterator[pa.RecordBatch], size: int, dtype) -> Iterator[pa.RecordBatch]:
    """Streams documents into sequences; the last, short one is held back and then cut anew."""
    first, sequence, at = TaskContext.get().partitionId() << 32, 0, 0
    open_rows: list[tuple] = []
    for batch in batches:
        rows: list[tuple] = []
        for i, tokens in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            ids = np.frombuffer(tokens, dtype).astype("<u4")
            a = 0
            while a < len(ids):
                n = min(size - at, len(ids) - a)
                open_rows.append((i, a, n, ids[a : a + n].tobytes(), len(ids), first + sequence, at))
                a, at = a + n, at + n
                if at == size:
                    rows += open_rows
                    open_rows, at, sequence = [], 0, sequence + 1
        if rows:
            yield _batch(rows)
    if open_rows:
        yield _batch(_recut(open_rows, tail_lengths(at), first + sequence))


def _recut(rows: list[tuple], lengths: list[int], sequence: int) -> list[tuple]:
    out, at, left = [], 0, list(lengths)
    for i, a, n, ids, total, _, _ in rows:
        done = 0
        while done < n:
            m = min(left[0] - at, n - done)
            out.append((i, a + done, m, ids[4 * done : 4 * (done + m)], total, sequence, at))
            done, at = done + m, at + m
            if at == left[0]:
                left.pop(0)
                at, sequence = 0, sequence + 1
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: each token of each document in one piece, ids little-endian unsigned 32-bit.

    size is a power of two, path a rank file's (default_path() where None). Null and empty texts are
    END alone; a null id stays null; rows that repeat are each packed, told apart only by where their
    pieces lie. Other columns are ignored. A sequence has size tokens or a smaller power of two, so
    none is padded. Ties of the key go by id; equal keys may span tasks, as ranges are of both. Ranges are
    cut at a sample's quantiles and are as many as the tokens' bytes ask for; another session may cut elsewhere,
    so sequences may differ from run to run, but never which ids they hold in all."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tokens = staged(rows.mapInArrow(lambda b: _tokenised(b, path), "id long, key long, tokens binary"))
    dtype = "<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4"
    held = tokens.agg(F.sum(F.length("tokens")).alias("x")).first()["x"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    salt = F.xxhash64("tokens")
    ranged = tokens.withColumn("salt", salt).repartitionByRange(parts, "key", "id", "salt").sortWithinPartitions("key", "id", "salt").select("id", "tokens")
    return ranged.mapInArrow(lambda b: _packed(b, size, dtype), PIECES)
