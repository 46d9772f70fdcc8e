"""Sum-of-squares online packing of documents into token windows.

Documents arrive one by one. Each goes into the fill level h for which the sum over all levels of the squared number
of windows at that level grows least; a level array holds these numbers, and a stack of window ids per level says
which window takes the document. The stream is divided by a seeded hash of the ids into shards of ``docs_per_shard``
documents on average, each packed online by one task; only ids and lengths are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import DEFAULT_DIR, count_tokens

WINDOW = 2048
DOCS_PER_SHARD = 50_000
SCHEMA = "doc_id long, piece int, doc_start long, n_tokens int, window_id long, window_start int"
_BIG = 1 << 60


class Packer:
    """Places lengths below ``size`` one at a time; place() returns (window, start)."""

    def __init__(self, size: int):
        self.size, self.windows = size, 0
        self.n = np.zeros(size + 1, np.int64)
        # what leaving level h and entering level h add to the sum of squares; level 0 and a full window count nothing
        self.leave = np.full(size + 1, _BIG, np.int64)
        self.leave[0] = 0
        self.enter = np.ones(size + 1, np.int64)
        self.enter[size] = 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def fresh(self) -> int:
        self.windows += 1
        return self.windows - 1

    def _set(self, h: int, by: int) -> None:
        self.n[h] += by
        k = int(self.n[h])
        self.leave[h] = 1 - 2 * k if k else _BIG
        self.enter[h] = 2 * k + 1

    def place(self, s: int) -> tuple[int, int]:
        cost = self.leave[: self.size - s + 1] + self.enter[s:]
        h = len(cost) - 1 - int(cost[::-1].argmin())  # of equal costs the fullest
        if h:
            w = self.open[h].pop()
            self._set(h, -1)
        else:
            w = self.fresh()
        if h + s < self.size:
            self.open[h + s].append(w)
            self._set(h + s, 1)
        return w, h


def pack_lengths(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, start in the item, length, window, start in the window), items in order of arrival."""
    p, out = Packer(size), []
    for i, n in enumerate(lengths.tolist()):
        piece = 0
        for at in range(0, n - size + 1, size):
            out.append((i, piece, at, size, p.fresh(), 0))
            piece += 1
        rest = n - piece * size
        if rest:
            out.append((i, piece, n - rest, rest, *p.place(rest)))
        elif not piece:
            out.append((i, 0, 0, 0, -1, 0))
    return out


def _pack_shard(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in t.column_names if c.startswith("__o")] + [("doc_id", "ascending"), ("n_tokens", "ascending")])
        out = np.array(pack_lengths(t.column("n_tokens").to_numpy(), size), np.int64).reshape(-1, 6)
        shard = t.column("__shard")[0].as_py()
        none = out[:, 4] < 0
        return pa.table(
            {
                "doc_id": t.column("doc_id").take(pa.array(out[:, 0])),
                "piece": pa.array(out[:, 1].astype(np.int32)),
                "doc_start": pa.array(out[:, 2]),
                "n_tokens": pa.array(out[:, 3].astype(np.int32)),
                "window_id": pa.array((shard << 40) + out[:, 4], mask=none),
                "window_start": pa.array(out[:, 5].astype(np.int32), mask=none),
            }
        )

    return run


def pack_documents(docs: DataFrame, *, window: int = WINDOW, docs_per_shard: int = DOCS_PER_SHARD, vocab: str = f"{DEFAULT_DIR}/byte_bpe_multi_50k.tiktoken", order: tuple[Column, ...] = (), seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token of every document in one place of one window: (doc_id, piece, doc_start, n_tokens, window_id, window_start).

    Documents arrive in ``order``, then by id and length; in order of id if none is given. A document of more than
    ``window`` tokens fills whole windows and its rest is placed as a document; one without tokens (null or empty
    text) has one row with no window. Of equally good fill levels the fullest is taken. Rows with a null id are packed as
    others, spread by their text; repeated rows are packed each. Ids are integers, or cast to them. Other columns are
    ignored whatever their names. An empty table gives an empty result.
    """
    shards = C.parts(docs.count(), docs_per_shard)
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    # rows without an id are told apart by their text, so that they don't all meet in one shard
    d = docs.select(text.alias("__text"), own.alias("doc_id"), F.when(own.isNull(), F.xxhash64(text)).alias("__salt"), *(o.alias(f"__o{i}") for i, o in enumerate(order)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    n = d.mapInArrow(count_tokens(vocab), f"n_tokens long, {kinds}").withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "__salt"), F.lit(shards))).drop("__salt")
    return n.groupBy("__shard").applyInArrow(_pack_shard(window), SCHEMA)
