"""Tokeniser fertility rules: characters per token, byte-fallback share and token entropy under public vocabularies.

Bands come from the corpus itself: for each language and octave of length (in tokens), quartiles of each measure
over all documents, widened by ``spread`` interquartile ranges. A document outside a band is rejected. A group too small
for quartiles takes the bands of wider groups: neighbouring octaves of its language, the whole language, and for entropy,
which hangs least on the language, all documents of its octave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tokens import DEFAULT_DIR, encode, vocabulary

VOCABULARIES = {"piece": f"{DEFAULT_DIR}/piece_bpe_32k.model", "multi": f"{DEFAULT_DIR}/byte_bpe_multi_50k.tiktoken"}
#: Interquartile ranges that a band extends beyond the quartiles, past the outer fence of a box plot (3).
SPREAD = 4.0
#: Least half-width that spread adds, by measure, so that a group of equal documents doesn't reject its neighbours.
FLOOR = {"chars_per_token": 0.25, "fallback_share": 0.05, "entropy": 0.02}
#: Documents of fewer tokens have no stable measures and are kept.
MIN_TOKENS = 32
#: Groups of fewer rated documents have no band of their own and take that of the first wider group that has one.
MIN_GROUP = 30
#: Octaves to each side that a small group is widened by, in this order, before the whole language is taken.
WIDER = (1, 2)
MEASURES = ("chars_per_token", "fallback_share", "entropy")


def measure(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    """n_tokens and the three measures of each text; entropy is in units of log2(n_tokens), so 1 if all tokens differ."""
    import pyarrow.compute as pc

    vocab, k = vocabulary(path), len(texts)
    n, fall, h = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    for rows, own, row, ids in encode(texts, vocab):
        n[rows] = own
        fall[rows] = np.bincount(row, vocab.fallback[ids], len(rows))
        key = row.astype(np.int64) * vocab.size + ids
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        c = np.diff(np.append(at, len(key)))
        h[rows] = np.bincount(key[at] // vocab.size, c * np.log2(c), len(rows))
    some = np.maximum(n, 1)
    log = np.log2(some)
    chars = pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
    return {"n_tokens": n, "chars_per_token": chars / some, "fallback_share": fall / some, "entropy": np.where(n > 1, (log - h / some) / np.maximum(log, 1e-9), 1.0)}


def _octave(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int32)


def _names(vocabs: dict[str, str]) -> list[tuple[str, str]]:
    return [(v, m) for v in vocabs for m in MEASURES]


def _measures(docs: DataFrame, vocabs: dict[str, str], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, octave, n_tokens_<v>, <measure>_<v>) of every row."""
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols, names, first = [b.column(1), b.column(2)], ["doc_id", "lang"], None
            for v, path in vocabs.items():
                m = measure(b.column(0), path)
                if first is None:
                    first = m["n_tokens"]
                    cols.append(pa.array(_octave(first)))
                    names.append("octave")
                for k, x in m.items():
                    cols.append(pa.array(x))
                    names.append(f"{k}_{v}")
            yield pa.record_batch(cols, names=names)
            C.trim()

    fields = ", ".join(f"n_tokens_{v} long, " + ", ".join(f"{m}_{v} double" for m in MEASURES) for v in vocabs)
    return d.mapInArrow(run, f"doc_id {kind}, lang string, octave int, {fields}")


def bands(measured: DataFrame, vocabs: dict[str, str] = VOCABULARIES, spread: float = SPREAD, min_tokens: int = MIN_TOKENS, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, octave, lo_<measure>_<v>, hi_<measure>_<v>): one row a language and octave, few whatever the corpus.

    Bands come from the first of these groups that has ``min_group`` rated documents: the language and octave, with the
    octaves beside it (WIDER), the whole language, all languages at that octave. The last bounds entropy only: what is
    usual in characters a token and fallback hangs on a language's script. Without any, bounds are null.
    """
    first = next(iter(vocabs))
    rated = measured.where(F.col(f"n_tokens_{first}") >= min_tokens)
    key = lambda level, lang, octave: F.struct(F.lit(level).alias("level"), lang.alias("lang"), octave.cast("int").alias("octave"))
    lang, octave = F.col("lang"), F.col("octave")
    keys = [key(0, lang, octave), *(key(i, lang, octave + k) for i, w in enumerate(WIDER, 1) for k in range(-w, w + 1))]
    whole, corpus = len(WIDER) + 1, len(WIDER) + 2
    keys += [key(whole, lang, F.lit(-1)), key(corpus, F.lit(""), octave)]
    q = rated.withColumn("k", F.explode(F.array(*keys))).groupBy("k").agg(F.count("*").alias("rated"), *(F.percentile_approx(f"{m}_{v}", [0.25, 0.75], 1000).alias(f"{m}_{v}") for v, m in _names(vocabs)))
    out = []
    for v, m in _names(vocabs):
        lo, hi = F.col(f"{m}_{v}")[0], F.col(f"{m}_{v}")[1]
        wide = F.greatest(F.lit(spread) * (hi - lo), F.lit(FLOOR[m]))
        some = (F.col("k.level") < corpus) | F.lit(m == "entropy")
        out += [F.when(some, lo - wide).alias(f"lo_{m}_{v}"), F.when(some, hi + wide).alias(f"hi_{m}_{v}")]
    q = C.materialize(q.select("k", "rated", F.struct(*out).alias("band")))
    own = q.where("k.level = 0").select("k.lang", "k.octave")
    for i in range(corpus + 1):
        at = key(i, F.lit("") if i == corpus else lang, F.lit(-1) if i == whole else octave)
        b = q.where((F.col("k.level") == i) & (F.col("rated") >= min_group)).select(F.col("k").alias(f"k{i}"), F.col("band").alias(f"b{i}"))
        own = own.withColumn("at", at).join(b, F.col("at") == F.col(f"k{i}"), "left").drop("at", f"k{i}")
    return own.select("lang", "octave", F.coalesce(*(F.col(f"b{i}") for i in range(corpus + 1))).alias("b")).select("lang", "octave", "b.*")


def fertility_report(docs: DataFrame, *, vocabs: dict[str, str] = VOCABULARIES, spread: float = SPREAD, min_tokens: int = MIN_TOKENS, min_group: int = MIN_GROUP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Measures and verdict of every row: doc_id, lang, octave, measures by vocabulary, accepted, reasons.

    A null or empty text has no tokens, measures 0, 0 and 1, and is accepted, as are texts of fewer than
    ``min_tokens`` tokens, and those for which no group of ``bands`` has ``min_group`` documents; a null language is the
    group "und". Texts are used whole; repeated rows and null ids are rated each. Other columns are ignored whatever their names. An
    empty table gives an empty result.
    """
    measured = C.materialize(_measures(docs, vocabs, id_col, text_col, lang_col))
    b = bands(measured, vocabs, spread, min_tokens, min_group)
    first = next(iter(vocabs))
    r = measured.join(F.broadcast(b), ["lang", "octave"], "left")
    rated = F.col(f"n_tokens_{first}") >= min_tokens
    why = [F.when(rated & (F.col(f"{m}_{v}") < F.col(f"lo_{m}_{v}")), F.lit(f"low {m} {v}")).when(rated & (F.col(f"{m}_{v}") > F.col(f"hi_{m}_{v}")), F.lit(f"high {m} {v}")) for v, m in _names(vocabs)]
    r = r.withColumn("reasons", F.concat_ws("; ", *why))
    return r.select("doc_id", "lang", "octave", *(f"n_tokens_{v}" for v in vocabs), *(F.round(f"{m}_{v}", 6).alias(f"{m}_{v}") for v, m in _names(vocabs)), (F.col("reasons") == "").alias("accepted"), "reasons")


def filter_fertility(docs: DataFrame, *, vocabs: dict[str, str] = VOCABULARIES, spread: float = SPREAD, min_tokens: int = MIN_TOKENS, min_group: int = MIN_GROUP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that ``fertility_report`` accepts, with the columns of ``docs``, whatever their names.

    Every text is tokenised once: the rows are stored with their measures, from which the bands come, few as they are,
    and with which the stored rows are then filtered. No text is shuffled. Edge cases are those of ``fertility_report``.
    """
    names = docs.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)
    d = docs.toDF(*(f"c{i}" for i in range(len(names))))
    first = next(iter(vocabs))

    def run(batches):
        for b in batches:
            cols = [*b.columns, b.column(lang_at).cast(pa.string()).fill_null("und")]
            for k, path in enumerate(vocabs.values()):
                m = measure(b.column(text_at).cast(pa.string()), path)
                if not k:
                    cols += [pa.array(_octave(m["n_tokens"])), pa.array(m["n_tokens"])]
                cols += [pa.array(m[x]) for x in MEASURES]
            yield pa.record_batch(cols, names=schema.names)
            C.trim()

    measures = [f"{m}_{v}" for v, m in _names(vocabs)]
    schema = T.StructType([*d.schema, T.StructField("lang", T.StringType()), T.StructField("octave", T.IntegerType()), T.StructField(f"n_tokens_{first}", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in measures)])
    r = C.materialize(d.mapInArrow(run, schema))
    b = bands(r.select("lang", "octave", f"n_tokens_{first}", *measures), vocabs, spread, min_tokens, min_group)
    r = r.join(F.broadcast(b), ["lang", "octave"], "left")
    out = F.lit(False)
    for m in measures:
        out = out | F.coalesce((F.col(m) < F.col(f"lo_{m}")) | (F.col(m) > F.col(f"hi_{m}")), F.lit(False))
    return r.where((F.col(f"n_tokens_{first}") < min_tokens) | ~out).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
