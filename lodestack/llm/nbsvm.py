"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Tokens are runs of letters and digits or of other visible characters, case kept; features are distinct hashed tokens
and pairs of neighbouring tokens, and one for each of REPEATED that the share of repeated tokens reaches. The log-count ratio r of a feature compares, over all labelled documents, the
smoothed shares of good and bad documents that contain it. Documents become r at their features, scaled to unit
length (after DAMPING is added to the squared length, so that a short text of a few telling features isn't judged as
surely as a long one); the hinge loss is minimised by dual coordinate descent over a bounded, seeded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
#: Labelled rows that the SVM is fitted to, at most; the ratios use all labelled rows.
FIT_ROWS = 6_000
#: Of each class so many rows are among them at least, if there are as many.
CLASS_ROWS = 500
SLICES = 64
#: Documents below this margin are rejected.
THRESHOLD = 0.0
SEED = 41
DAMPING = 100.0

_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[C.WORD == 1] = 1


#: Rows whose features are held at a time.
ROWS_AT_ONCE = 1_000


#: Shares of tokens that equal the one before or the one before that; a text of REPEATS such tokens has a feature for each
#: share it reaches, whatever the token, so that a word repeated over and over is evidence in itself.
REPEATED = np.arange(1, 9) / 10
REPEATS = 8


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, end to end, and each row's count."""
    out, counts = [], np.zeros(len(texts), np.int64)
    shift = np.uint64(64 - bits)
    for first, buf, off in C.chunks(texts):
        starts, ends, row = C.runs(buf, off, _CLASS)
        h = C.run_hashes(buf, starts, ends)
        one = (C.mix(h) >> shift).astype(np.int32)
        two = (C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> shift).astype(np.int32) if len(h) > 1 else one[:0]
        again = np.zeros(len(h), bool)
        for lag in (1, 2):
            again[lag:] |= (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        same = np.concatenate(([0], np.cumsum(again)))
        marks = (C.mix(np.arange(1, len(REPEATED) + 1, dtype=np.uint64)) >> shift).astype(np.int32)
        bounds = np.searchsorted(row, np.arange(len(off)))
        for i in range(len(off) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                k = same[b] - same[a]
                f = np.concatenate((one[a:b], two[a : b - 1], marks[REPEATED <= k / (b - a)] if k >= REPEATS else marks[:0]))
                f.sort()
                f = f[np.concatenate(([True], f[1:] != f[:-1]))]
                out.append(f)
                counts[first + i] = len(f)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts


#: Features of fewer labelled documents carry no evidence and get ratio 0.
MIN_DOCS = 2


def log_ratio(good: np.ndarray, bad: np.ndarray, alpha: float = 1.0, min_docs: int = MIN_DOCS) -> np.ndarray:
    p, q = good + alpha, bad + alpha
    return np.where(good + bad >= min_docs, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss SVM, one cost for both classes: (weights over features, bias)."""
    w, bias, rng = np.zeros(len(r)), 0.0, np.random.default_rng(seed)
    x = []
    for f in rows:
        v = r[f]
        x.append(v / np.sqrt(np.dot(v, v) + DAMPING))
    q = np.array([np.dot(v, v) + 1.0 for v in x])
    a = np.zeros(len(y))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], x[i]
            g = y[i] * (np.dot(w[f], v) + bias) - 1
            new = min(max(a[i] - g / q[i], 0.0), c)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * v
                bias += step
                worst = max(worst, abs(new - a[i]))
                a[i] = new
        if worst < 1e-3:
            break
    return w, bias


class Model:
    """Scores texts; fold(r into w) leaves one table for the sum and one for the length."""

    def __init__(self, w: np.ndarray, bias: float, r: np.ndarray, bits: int):
        self.wr, self.r2, self.bias, self.bits = (w * r).astype(np.float32), (r * r).astype(np.float32), float(bias), bits

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self._score(texts.slice(i, ROWS_AT_ONCE)) for i in range(0, len(texts), ROWS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score(self, texts: pa.Array) -> np.ndarray:
        f, n = features(texts, self.bits)
        row = np.repeat(np.arange(len(n)), n)
        s, q = np.bincount(row, self.wr[f], len(n)), np.bincount(row, self.r2[f], len(n))
        return s / np.sqrt(q + DAMPING) + self.bias


def _counts(sampled: bool, bits: int):
    width = (1 << bits) // SLICES

    def run(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
            f, n = features(b.column("text"), bits)
            y = b.column("y").to_numpy()
            row = np.repeat(y, n)
            for k in (0, 1):
                total[k] += np.bincount(f[row == k], minlength=1 << bits)
            if sampled:
                ends = np.cumsum(n)
                at = np.flatnonzero(b.column("s").to_numpy(zero_copy_only=False))
                if len(at):
                    yield _rows([(-1, int(y[i]), int(b.column("doc_id")[i].as_py()), f[ends[i] - n[i] : ends[i]].tobytes()) for i in at])
        for k in (0, 1):
            for s in range(SLICES):
                part = total[k, s * width : (s + 1) * width]
                if part.any():
                    yield _rows([(s, k, 0, part.astype(np.uint32).tobytes())])

    return run


def _rows(rows):
    a, b, c, d = zip(*rows)
    return pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["slice", "y", "doc_id", "raw"])


def _sum(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in t.column("raw")], axis=0)
    return pa.table({"slice": t.column("slice").slice(0, 1), "y": t.column("y").slice(0, 1), "doc_id": pa.array([0], pa.int64()), "raw": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, fit_rows: int = FIT_ROWS, class_rows: int = CLASS_ROWS, c: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit to rows of ``docs`` whose id has a label of 0 or 1.

    An id with both labels, or none, counts as unlabelled; rows with null id, label or text don't take part, and repeated
    rows take part each. With no labelled rows, or of one class only, the model accepts everything. Counts cover all
    labelled rows; the SVM is fitted to ``fit_rows`` of them, those of the smallest seeded hash of the id, and beyond
    these to the next of a class of which there are fewer than ``class_rows`` among them. Ids must be integers, or cast to them.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # labels of the rows that are there, of which the sample is drawn
    lab = C.materialize(d.select("doc_id").join(C.maybe_broadcast(lab), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    least = lambda x, n: x.orderBy("h").limit(n).agg(F.max("h")).first()[0]
    cut, *own = least(lab, fit_rows), *(least(lab.where(F.col("y") == k), class_rows) for k in (0, 1))
    if None in own:
        return Model(np.zeros(1 << bits), 1.0, np.zeros(1 << bits), bits)
    sampled = F.col("h") <= F.when(F.col("y") == 0, max(cut, own[0])).otherwise(max(cut, own[1]))
    lab = C.maybe_broadcast(lab.select("doc_id", "y", sampled.alias("s")))
    d = d.join(lab, "doc_id")
    out = C.materialize(d.select("text", "y", "s", "doc_id").mapInArrow(_counts(True, bits), "slice int, y int, doc_id long, raw binary"))
    counts = out.where("slice >= 0").groupBy("slice", "y").applyInArrow(_sum, out.schema).collect()  # SLICES rows a class, of a fixed size
    total, width = np.zeros((2, 1 << bits), np.int64), (1 << bits) // SLICES
    for s in counts:
        total[s["y"], s["slice"] * width : (s["slice"] + 1) * width] = np.frombuffer(s["raw"], np.int64)
    sample = sorted(out.where("slice = -1").select("doc_id", "y", "raw").limit(2 * (fit_rows + class_rows)).collect(), key=lambda s: (s["doc_id"], bytes(s["raw"])))
    y = np.array([1 if s["y"] else -1 for s in sample])
    r = log_ratio(total[1], total[0])
    w, bias = fit_hinge([np.frombuffer(s["raw"], np.int32) for s in sample], y, r, c, seed=seed)
    return Model(w, bias, r, bits)


def score_quality(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, accepted) of every row; a text without tokens (null, empty) scores the model's bias.

    Null ids and repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 2 ** BITS features

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(np.round(s, 6)), pa.array(s >= threshold)], names=["doc_id", "score", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, accepted boolean")


def filter_quality(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that ``score_quality`` accepts, with the columns of ``docs``; edge cases are the same."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
