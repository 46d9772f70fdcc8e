"""Two-pass external shuffle: scatter by seeded hash into memory-sized buckets, then Fisher-Yates in each.

The first pass scatters whole records in one Spark shuffle; each bucket is then read by one task, which holds it in
memory, permutes it and writes it. A record's bucket is a hash of the seed, its content and its number among equal
records, so that repeated records spread as evenly as others. Buckets and places depend on the records and the seed
alone, not on files, partitions or the order of rows, so a task that is run again after a lost executor gives the same
rows in the same order.

Before it, a pass over hashes alone counts the bytes, which give the number of buckets, and finds the records that
repeat. Only those need numbers: they are reduced to one row and a count by partial aggregation, then multiplied again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bytes of the records in one bucket; a task holds a few copies of it.
BUCKET_BYTES = 16 << 20
#: Rows that go back to the JVM at a time.
ROWS_OUT = 2_000
#: Copies of one record that a single row is multiplied into at a time.
COPIES = 1 << 12

_REPEATS = "h1 long, h2 long, n long, bytes long"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of n positions (numpy's in-place Fisher-Yates) from a counter-based generator."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(key=np.array([seed % (1 << 64), bucket], np.uint64))).shuffle(order)
    return order


def _simple(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType, T.ArrayType, T.StructType, T.FloatType, T.DoubleType))


def _hashable(f: T.StructField) -> Column:
    """The column, or a text of it where the hash is undefined or takes -0.0 for 0.0."""
    c = F.col(f.name)
    if _simple(f.dataType):
        return c
    return c.cast("string") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.to_json(F.struct(c))


def _bytes(f: T.StructField) -> Column:
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(f.name), F.lit(0)) + 4
    return F.lit(8) if _simple(f.dataType) or isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 4


def _repeats(batches):
    """The repeated records of a partition, and one row of its totals with null hashes."""
    n = size = 0
    for b in batches:
        count = b.column("n").to_numpy()
        n += int(count.sum())
        size += int((count * b.column("bytes").to_numpy()).sum())
        again = b.filter(pa.array(count > 1))
        if again.num_rows:
            yield pa.record_batch(again.columns, names=again.schema.names)
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([n]), pa.array([size])], names=["h1", "h2", "n", "bytes"])


def external_shuffle(docs: DataFrame, *, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None, shard_col: str = "shard", position_col: str = "position") -> DataFrame:
    """All records in a random order: the columns of ``docs``, the bucket and the place within it.

    Every input row comes out exactly once, repeated rows, nulls in any column and very long texts included; the order
    of the concatenated buckets is the shuffled order. The number of buckets follows the counted bytes of the records
    unless given. Input columns named like one of the two new ones are replaced; all other names are free. An
    empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in (shard_col, position_col)]
    d = docs.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(names, d.schema)), T.StructField(shard_col, T.IntegerType()), T.StructField(position_col, T.LongType())])
    cols = d.columns
    hashed = [_hashable(f) for f in d.schema]
    # two hashes of 64 bits stand for the content
    d = d.withColumns({"h1": F.xxhash64(F.lit(seed), *hashed), "h2": F.xxhash64(F.lit(~seed), *hashed)})
    size = sum((_bytes(f) for f in d.schema[:-2]), F.lit(0)).cast("long")
    known = C.materialize(d.select("h1", "h2", size.alias("bytes")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")).mapInArrow(_repeats, _REPEATS))
    total = known.where("h1 is null").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = buckets or C.parts(total, bucket_bytes)
    again = known.where("h1 is not null").select("h1", "h2")
    few = again.count()
    if few <= C.BROADCAST_ROWS:
        again = F.broadcast(again)
        once = d.join(again, ["h1", "h2"], "left_anti").withColumn("k", F.lit(0).cast("long")) if few else d.withColumn("k", F.lit(0).cast("long"))
        many = d.join(again, ["h1", "h2"], "left_semi") if few else None
    else:
        once, many = None, d  # all records take the way of repeated ones, so that none is looked up
    if many is not None:
        many = many.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first(F.struct(*cols)).alias("row"))
        # in two steps, so that a record of very many copies is multiplied by many tasks
        many = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("h1", "h2", "at")
        many = many.withColumn("k", F.explode(F.sequence(F.col("at") * COPIES, F.least(F.col("at") * COPIES + (COPIES - 1), F.col("n") - 1)))).select("h1", "h2", "row.*", "k")
        once = many if once is None else once.select("h1", "h2", *cols, "k").unionByName(many)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "k"), F.lit(n)).cast("int")
    d = once.select(*cols, "h1", "h2", "k", bucket.alias("b"))

    def permute(t: pa.Table):
        bucket = t.column("b")[0].as_py()
        h1, h2, k = (t.column(c).to_numpy() for c in ("h1", "h2", "k"))
        t = t.select(cols)
        at = np.lexsort((k, h2, h1))[fisher_yates(len(k), seed, bucket)]
        for i in range(0, len(at), ROWS_OUT):
            own = t.take(pa.array(at[i : i + ROWS_OUT])).combine_chunks()
            own = own.append_column("shard", pa.array(np.full(own.num_rows, bucket, np.int32))).append_column("position", pa.array(np.arange(i, i + own.num_rows, dtype=np.int64)))
            yield from own.rename_columns(schema.names).to_batches()

    return C.by_bucket(d, n, "b", permute, schema)


def write_shards(docs: DataFrame, path: str, *, seed: int = 17, shard_col: str = "shard", **kw) -> None:
    """Write the shuffled records to one directory a shard, each in its shuffled order."""
    external_shuffle(docs, seed=seed, shard_col=shard_col, **kw).write.partitionBy(shard_col).parquet(path)
