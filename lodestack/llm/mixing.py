"""Mixing sources to target weights by Pfair scheduling of document blocks.

Each source's documents are cut into blocks. With target weight w, its i-th block (from 1) is released at slot
floor((i - 1) / w) and due at slot ceil(i / w); earliest deadline first among the released blocks fills one slot after
another (of equal deadlines the source of the smaller name), and since the weights sum to 1 every deadline is met, so
after any number of slots each source is less than one block from its target. When a source has no block left, a new
phase starts with the weights of the others scaled to 1: every document is used exactly once, and within each phase the
deviation stays below one block.

Weights are integers, so the schedule of a phase repeats after as many slots as they sum to, with as many blocks of each
source as its weight. Only one such period of each phase is computed, on the driver, whatever the size of the corpus; the
slot of any block follows from its place in the period by division. Documents are numbered within a source by seeded hash
buckets and prefix sums of the buckets' counts, so that a hot source spreads over many tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK_DOCS = 64
ROWS_A_BUCKET = 5_000
#: Target shares are proportional to documents ** TEMPERATURE unless weights are given.
TEMPERATURE = 0.7
_SCALE = 1_000_000


def pfair_phase(weights: list[int]) -> Iterator[int]:
    """Source of each slot, without end, for integer weights; a weight's share is weight / sum."""
    total = sum(weights)
    ready: list[tuple[int, int, int]] = []
    later = [(0, s, 1) for s, w in enumerate(weights) if w]
    heapq.heapify(later)
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            _, s, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-i * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        heapq.heappush(later, (i * total // weights[s], s, i + 1))
        yield s
        slot += 1


class Phase(NamedTuple):
    """A phase of the schedule: its first slot, the slots and blocks of a period, and of each live source the number of
    its first block, the number after its last, its weight and the slots of its blocks in the period."""

    start: int
    total: int
    first: dict[int, int]
    end: dict[int, int]
    weight: dict[int, int]
    at: dict[int, np.ndarray]


def phases(blocks: list[int], weights: list[int]) -> Iterator[Phase]:
    """The phases until every block is used once. Sources of weight 0 come after all others, in equal shares."""
    used, start = [0] * len(blocks), 0
    while any(u < b for u, b in zip(used, blocks)):
        live = [s for s, b in enumerate(blocks) if used[s] < b and weights[s]] or [s for s, b in enumerate(blocks) if used[s] < b]
        w = [weights[s] or 1 for s in live]
        w = [x // math.gcd(*w) for x in w]
        total = sum(w)
        most = min(total, sum(blocks[s] - used[s] for s in live))  # no phase is longer
        picks = np.fromiter(pfair_phase(w), np.int32, most)
        at = [np.flatnonzero(picks == k) for k in range(len(live))]
        # the phase ends with the slot in which the first source runs out
        last = []
        for k, s in enumerate(live):
            q, r = divmod(blocks[s] - used[s] - 1, w[k])
            if r < len(at[k]):
                last.append(q * total + int(at[k][r]))
        end = min(last)
        q, r = divmod(end + 1, total)
        took = [q * w[k] + int(np.searchsorted(at[k], r)) for k in range(len(live))]
        yield Phase(start, total, {s: used[s] for s in live}, {s: used[s] + n for s, n in zip(live, took)}, dict(zip(live, w)), dict(zip(live, at)))
        for s, n in zip(live, took):
            used[s] += n
        start += end + 1


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(slot, phase, source, block of the source) of every block."""
    out = []
    for k, p in enumerate(phases(blocks, weights)):
        for s, first in p.first.items():
            for i in range(p.end[s] - first):
                q, r = divmod(i, p.weight[s])
                out.append((p.start + q * p.total + int(p.at[s][r]), k, s, first + i))
    return iter(sorted(out))


def _columns(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """Of each column what a hash can be taken of."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return [F.to_json(F.struct(f"`{c}`")) if isinstance(kinds[c], (T.MapType, T.VariantType)) else F.col(f"`{c}`") for c in names]


def _placed(docs: DataFrame, weights, temperature: float, block_docs: int, seed: int, id_col: str, source_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """((row: struct of the columns ``keep``, slot, phase, block, place), number of slots)."""
    src = F.col(f"`{source_col}`").cast("string")
    named = F.when(src.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), src))
    own_id = F.col(f"`{id_col}`")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own_id.cast("string"), F.lit(""))))
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    tie = F.xxhash64(*_columns(docs, tuple(dict.fromkeys([*keep, id_col, source_col]))))
    buckets = C.parts(docs.count(), ROWS_A_BUCKET)
    # ranges of the hash, so that the order by bucket and hash is the order by hash
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    keys = docs.select(named.alias("s"), hashed.alias("h")).select("s", bucket.alias("b"))
    sizes = keys.groupBy("s", "b").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = C.materialize(sizes.withColumn("first", F.coalesce(first, F.lit(0))))
    total = {r["s"]: r["n"] for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    names = sorted(total)
    if weights is None:
        share = [total[s] ** temperature for s in names]
    else:
        share = [float(weights.get(None if s == "0" else s[1:], 0)) for s in names]
    ints = [max(1, round(w / sum(share) * _SCALE)) if w > 0 else 0 for w in share]
    blocks = [-(-total[s] // block_docs) for s in names]
    d = docs.select(named.alias("s"), hashed.alias("h"), own_id.alias("id"), tie.alias("tie"), row.alias("row")).withColumn("b", bucket)
    # a window over (source, bucket) numbers the rows; rows of one id follow their content, so that a task that is run
    # again numbers them alike
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "id", "tie")) - 1)
    small = sizes.select("s", "b", "first")
    d = d.join(F.broadcast(small) if len(names) * buckets <= C.BROADCAST_ROWS else small, ["s", "b"]).withColumn("i", F.col("i") + F.col("first"))
    d = d.select("s", "row", F.floor(F.col("i") / block_docs).cast("long").alias("block"), F.pmod("i", F.lit(block_docs)).cast("int").alias("place"))
    return _slots(d, list(phases(blocks, ints)), names).select("row", "slot", "phase", "block", "place"), sum(blocks)


#: Periods of this many slots in all are broadcast, as arrays of 4 bytes a slot; larger ones are joined by place.
BROADCAST_SLOTS = 16_000_000


def _slots(d: DataFrame, plan: list[Phase], names: list[str], broadcast_slots: int = BROADCAST_SLOTS) -> DataFrame:
    """Slot and phase of each row by its source and block."""
    spark = d.sparkSession
    rows = [(names[s], k, p.start, p.total, p.first[s], p.end[s], p.weight[s], p.at[s][: p.end[s] - p.first[s]].astype(np.int32).tolist()) for k, p in enumerate(plan) for s in p.first if p.end[s] > p.first[s]]
    table = spark.createDataFrame(rows, "s string, phase int, start long, total long, lo long, hi long, w long, at array<int>")
    if sum(len(r[-1]) for r in rows) <= broadcast_slots:
        table = F.broadcast(table)
        here = F.get("at", F.pmod(F.col("block") - F.col("lo"), F.col("w")).cast("int"))
        d = d.join(table, (d["s"] == table["s"]) & (d["block"] >= table["lo"]) & (d["block"] < table["hi"]))
    else:
        spans = F.broadcast(table.drop("at").withColumnRenamed("s", "s2"))
        d = d.join(spans, (d["s"] == F.col("s2")) & (d["block"] >= F.col("lo")) & (d["block"] < F.col("hi"))).withColumn("r", F.pmod(F.col("block") - F.col("lo"), F.col("w")).cast("int"))
        d = d.join(table.select("s", "phase", F.posexplode("at").alias("r", "here")), ["s", "phase", "r"])
        here = F.col("here")
    return d.withColumn("slot", F.col("start") + F.expr("(block - lo) div w") * F.col("total") + here)


def mix_sources(docs: DataFrame, *, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, seed: int = 23, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Each document's place in the mix: slot, phase, block of its source and place in the block.

    Returns the columns ``keep`` (by default the id and the source), then slot, phase, block and place; the mix is the
    order by (slot, place). Sources are values of ``source_col``, null being one of its own. Targets are ``weights``,
    by source, where a source that isn't named comes after all others, else documents ** temperature. Equal deadlines
    go to the source of the smaller name, null first. The last block of a source may be short. Every row comes out
    once, with null ids and repeated rows; texts of any length only pass through. Input columns that have one of the
    new names are replaced; all other names are free. An empty table gives an empty result.
    """
    cols = tuple(c for c in (keep or (id_col, source_col)) if c not in ("slot", "phase", "block", "place"))
    d, _ = _placed(docs, weights, temperature, block_docs, seed, id_col, source_col, cols)
    return d.select(*(F.col(f"row.`{c}`") for c in cols), "slot", "phase", "block", "place")


def mixed_documents(docs: DataFrame, *, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, seed: int = 23, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents themselves in the order of the mix: rows of a partition, and partitions, follow one another.

    Columns and rows are those of ``docs``, whatever the names of the columns. Edge cases are those of ``mix_sources``.
    """
    m, n_slots = _placed(docs, weights, temperature, block_docs, seed, id_col, source_col, tuple(docs.columns))
    n = min(C.MAX_PARTS, C.parts(C.measured(docs)[1], 24 << 20))
    # slots are dense and blocks nearly equal, so equal ranges of slots need no sampling pass
    part = F.least(F.lit(n - 1), F.floor(F.col("slot") * n / max(1, n_slots))).cast("int")
    return m.repartitionById(n, part).sortWithinPartitions("slot", "place").select("row.*")


#: mix_sources with its default parameters over documents; the schedule is a recursion over slots.
ORACLE_SQL = f"""
WITH RECURSIVE k AS (SELECT CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, count(*) AS n FROM documents GROUP BY 1),
k2 AS (SELECT row_number() OVER (ORDER BY key) - 1 AS i, key, (n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} AS b, greatest(1, round_even(pow(n, {TEMPERATURE}::double) / sum(pow(n, {TEMPERATURE}::double)) OVER () * {_SCALE}, 0))::bigint AS w FROM k),
cfg AS (SELECT list(b ORDER BY i) AS b, list(w ORDER BY i) AS w, range(count(*)) AS ids, sum(b) AS slots FROM k2),
sched AS (
  SELECT -1::bigint AS slot, 0 AS phase, 0::bigint AS since, list_transform(b, lambda x: 0::bigint) AS used, list_transform(b, lambda x: 0::bigint) AS base, -1::bigint AS pick, -1::bigint AS block, 0 AS next_phase FROM cfg
  UNION ALL
  SELECT slot, next_phase AS phase, CASE WHEN ends THEN slot + 1 ELSE since END AS since, now AS used, CASE WHEN ends THEN now ELSE base END AS base, pick, used[pick + 1] AS block, CASE WHEN ends THEN next_phase + 1 ELSE next_phase END AS next_phase FROM (
    SELECT *, list_transform(ids, lambda s: used[s + 1] + (s = pick)::bigint) AS now, used[pick + 1] + 1 = b[pick + 1] AS ends FROM (
      SELECT *, list_min(list_transform(list_filter(ids, lambda s: used[s + 1] < b[s + 1] AND ((used[s + 1] - base[s + 1]) * total) // w[s + 1] <= slot - since), lambda s: (((used[s + 1] - base[s + 1] + 1) * total + w[s + 1] - 1) // w[s + 1]) * 100000 + s)) % 100000 AS pick FROM (
        SELECT sched.slot + 1 AS slot, since, used, base, next_phase, cfg.*, list_sum(list_transform(ids, lambda s: CASE WHEN used[s + 1] < b[s + 1] THEN w[s + 1] ELSE 0 END))::bigint AS total FROM sched, cfg WHERE sched.slot + 1 < slots)))),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, row_number() OVER (PARTITION BY source ORDER BY md5('23:' || coalesce(doc_id::varchar, '')), doc_id) - 1 AS i FROM documents)
SELECT doc_id, source, slot, phase, block, (d.i % {BLOCK_DOCS})::int AS place FROM d JOIN k2 USING (key) JOIN sched ON pick = k2.i AND block = d.i // {BLOCK_DOCS}
"""
