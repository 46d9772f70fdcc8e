"""Helpers shared by the training-data operators: materialisation, size checks and vectorised text hashing."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest row count of a two-column key table that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of text hashed at a time, so that the work arrays stay in the cache.
CHUNK_BYTES = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on a single machine, as in tests; on a cluster the executors would each write
    to their own disk, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_made: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives lost executors.

    Frames that an operator returns may still read it; ``sweep`` deletes all of them when their results are stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)  # texts take a third less than by default
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Paths of the tables that this process has materialized and not deleted, in order."""
    return list(_made)


def sweep(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete these of the tables that this process has materialized, or all; how many there were."""
    jvm, gone = spark.sparkContext._jvm, [p for p in _made if paths is None or p in paths]
    for p in gone:
        _made.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and the bytes of its values, both counted: what sizes of partitions and buckets follow."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else None
        size = size + (F.lit(8) if text is None else F.coalesce(F.octet_length(text), F.lit(0)) + 4)
    r = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return r[0], r[1]


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the table has at most ``limit`` rows (counted), else leave the join to shuffle."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the system, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Partitions of one shuffle by bucket; beyond it a partition holds neighbouring buckets, one after another.
MAX_PARTS = 20_000


def by_bucket(df: DataFrame, n: int, bucket: str, fn, schema, max_parts: int | None = None) -> DataFrame:
    """fn(table of one bucket) gives record batches; buckets are the numbers below n in column ``bucket``.

    A partition has one bucket, whatever their number of rows, so no task gets several by chance; where there are more
    than MAX_PARTS, it has a run of them, sorted, of which one at a time is held.
    """
    parts = min(n, max_parts or MAX_PARTS)
    at = df.columns.index(bucket)
    d = df.repartitionById(parts, F.floor(F.col(bucket) * F.lit(parts) / F.lit(n)).cast("int") if parts < n else F.col(bucket).cast("int"))
    if parts < n:
        d = d.sortWithinPartitions(bucket)

    def run(batches):
        held, now = [], None
        for b in batches:
            key = b.column(at).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if held and key[s] != now:
                    t = pa.Table.from_batches(held)
                    held = []
                    yield from fn(t)
                    del t
                    trim()
                now = key[s]
                held.append(b.slice(s, e - s))
        if held:
            t = pa.Table.from_batches(held)
            del held, batches
            yield from fn(t)
            del t
            trim()

    return d.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = U(1)
    return np.multiply.accumulate(p)


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _cache.get("up") is None or len(_cache["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = _powers(size, _BASE), _powers(size, _INV)
        if n > CHUNK_BYTES + 1:
            return up, down
        _cache["up"], _cache["down"] = up, down
    return _cache["up"], _cache["down"]


def chunks(texts: pa.Array):
    """(first row, bytes, row offsets) of successive runs of rows of about CHUNK_BYTES; nulls count as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of one non-zero class that lies within a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    c = classes[buf]
    edge = np.empty(len(c) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:-1])
    edge[off] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = c[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, by differences of one polynomial prefix sum."""
    up, down = _power_tables(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=h[1:])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U))


#: Letters, digits and bytes of non-ASCII characters make words.
WORD = np.zeros(256, np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word n-grams, end to end, and each row's count.

    Words are compared in lower case without punctuation. A row of fewer than n words, but at least one, has
    one n-gram, made of all its words; a row without words has none.
    """
    import pyarrow.compute as pc

    sets, counts = [], np.zeros(len(texts), np.int64)
    for first, buf, off in chunks(pc.utf8_lower(texts)):
        starts, ends, row = runs(buf, off, WORD)
        h = run_hashes(buf, starts, ends)
        bounds = np.searchsorted(row, np.arange(len(off)))
        m = len(h) - n + 1
        g = np.zeros(max(m, 0), U)
        for k in range(n):
            if m > 0:
                g = g * _BASE + h[k : k + m]
        g = mix(g)
        for i in range(len(off) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= n:
                s = np.sort(g[a : b - n + 1])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                w = U(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        w = w * _BASE + x
                s = mix(np.array([w], U))
            else:
                continue
            sets.append(s)
            counts[first + i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), counts


def pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each uint64."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(U).ravel()


def planes(x: np.ndarray) -> bytes:
    """Differences of successive integers, first all lowest bytes, then the next: shuffles compress what repeats in them."""
    d = np.concatenate((x[:1], x[1:] - x[:-1]))
    return d.view(np.uint8).reshape(len(d), d.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    d = np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T
    return np.cumsum(np.ascontiguousarray(d).view(dtype).ravel(), dtype=dtype)


def parts(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))
