"""URL filter: empirical-Bayes host reputation from labelled pages.

Each level shrinks towards the one above: host to registered domain to suffix to the whole corpus. At a level with
parent mean m, counts (s good of n) give the posterior Beta(k m + s, k (1 - m) + n - s). The strength k of a level is
fitted to all its groups by the moments of the beta-binomial: with N = sum n, p = sum s / N, G groups and
S = sum n (s/n - p)^2, the intraclass correlation is
rho = (S / (p (1 - p)) - (G - 1)) / (N - sum n^2 / N - (G - 1)), kept within [0.001, 0.5] so that a prior weighs one outcome at least, and k = 1 / rho - 1.
A page passes if the lower bound of its host's posterior, the quantile LEVEL of that Beta distribution, reaches the threshold.

Suffixes are those of the public suffix list, with its wildcards and exceptions, as it lies in Spark's own jars. Outcomes
are counted by host once; all levels are sums of these counts, and pages are read once, to be looked up.
"""

from __future__ import annotations

import functools
import glob
import math
import os
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LEVEL = 0.05
THRESHOLD = 0.5


@functools.lru_cache(1)
def public_suffixes() -> tuple[str, ...]:
    """Rules of the public suffix list in the HTTP client that Spark ships; names of other scripts also in ASCII."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar"))):
        with zipfile.ZipFile(jar) as z:
            if "mozilla/public-suffix-list.txt" not in z.namelist():
                continue
            lines = z.read("mozilla/public-suffix-list.txt").decode().splitlines()
        rules = {x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")}
        for r in [x for x in rules if not x.isascii()]:
            try:
                rules.add(r.encode("idna").decode())
            except UnicodeError:
                pass
        return tuple(sorted(rules))
    raise FileNotFoundError("no public suffix list in Spark's jars: pass the rules as suffixes")


def _rules(suffixes: tuple[str, ...]) -> tuple[dict[int, list[str]], dict[int, list[str]], dict[int, list[str]]]:
    """Plain rules, parents of wildcards and exceptions, by number of labels."""
    out: tuple[dict, dict, dict] = ({}, {}, {})
    for r in suffixes:
        kind, name = (1, r[2:]) if r.startswith("*.") else (2, r[1:]) if r.startswith("!") else (0, r)
        out[kind].setdefault(name.count(".") + 1, []).append(name)
    return out


def _in(tail: str, names: list[str]) -> str:
    return f"{tail} IN ({', '.join(repr(x) for x in names)})"


def _suffix_case(host: str, tail, suffixes: tuple[str, ...]) -> str:
    """SQL of the suffix: an exception without its first label, else the longest rule that fits, else the last label."""
    plain, wild, no = _rules(suffixes)
    cases = [f"WHEN regexp_like({host}, '^[0-9.]+$') THEN 'ip'"]
    cases += [f"WHEN {_in(tail(k), names)} THEN {tail(k - 1)}" for k, names in sorted(no.items(), reverse=True)]
    for k in range(max([0, *plain, *(w + 1 for w in wild)]), 1, -1):
        fits = [_in(tail(k), plain[k])] if k in plain else []
        if k - 1 in wild:
            fits.append(f"({_in(tail(k - 1), wild[k - 1])} AND {tail(k)} <> {tail(k - 1)})")
        if fits:
            cases.append(f"WHEN {' OR '.join(fits)} THEN {tail(k)}")
    return f"CASE {' '.join(cases)} ELSE {tail(1)} END"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or a final dot; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)", 1)
    h = F.regexp_replace(h, r"\.$", "")
    return F.when(h != "", h)


def with_domains(d: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Add suffix and domain to ``host``: the suffix and one label more, or the host if it has no more or is an address."""
    d = d.withColumn("suffix", F.expr(_suffix_case("host", lambda k: f"substring_index(host, '.', -{k})", suffixes)))
    return d.withColumn("domain", F.expr("CASE WHEN suffix = 'ip' THEN host ELSE substring_index(host, '.', -(length(suffix) - length(replace(suffix, '.', '')) + 2)) END"))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, c, d = 1e-300, np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, m = d.copy(), 0
    while True:
        m += 1
        for q in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + q * d, 1 + q / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if not len(h) or np.abs(d * c - 1).max() < 1e-14 or m > 100_000:
            break
    y = front * h
    return np.where(swap, 1 - y, y)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = p, by bisection."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        mid = (lo + hi) / 2
        low = beta_cdf(mid, a, b) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def _bounded(d: DataFrame, level: float) -> DataFrame:
    """Add low, the lower bound of Beta(mean * size, (1 - mean) * size), to rows with mean and size."""
    def run(batches):
        for b in batches:
            m, s = b.column("mean").to_numpy(), b.column("size").to_numpy()
            yield pa.record_batch([*b.columns, pa.array(beta_quantile(level, m * s, (1 - m) * s))], names=[*b.schema.names, "low"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(run, f"{kinds}, low double")


def _moments(name: str) -> list[Column]:
    """Sums over the groups of a level that the level above adds up: groups, n squared, s squared over n."""
    return [F.count("*").cast("double").alias(f"g_{name}"), F.sum(F.col("n").cast("double") * F.col("n")).alias(f"n2_{name}"), F.sum(F.col("s").cast("double") * F.col("s") / F.col("n")).alias(f"s2n_{name}")]


def _strength(big: float, good: float, g: float, n2: float, s2n: float) -> float:
    """k of a level from the sums over its groups."""
    rho = 0.001
    if big > 0 and 0 < good < big and big - n2 / big - (g - 1) > 0:
        p = good / big
        rho = max(0.001, min(0.5, ((s2n - good * p) / (p * (1 - p)) - (g - 1)) / (big - n2 / big - (g - 1))))
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, level: float = LEVEL, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Posterior and verdict of every page by its host.

    ``outcomes`` has good (0/1) and the ``url`` of the page, or its ``page_id``, by which the URL is then looked up.
    Returns page_id, host, domain, suffix, n_labelled, n_good (of the host), posterior_mean, lower_bound (6 places),
    accepted. A null URL, or one without a host, has null host, domain and suffix, is judged by the corpus mean alone,
    and its labels count only there. Outcomes of null id or value don't count; every outcome row of a page counts.
    Without outcomes the corpus mean is 0.5. Rows of null id and repeated rows are judged each, and URLs of any length are
    read whole. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    suffixes = public_suffixes() if suffixes is None else suffixes
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col).cast("string")).alias("host"))
    if "url" in outcomes.columns:
        o = outcomes.select(host_of(F.col("url").cast("string")).alias("host"), F.col("good").cast("long").alias("s")).where("s in (0, 1)")
    else:
        o = outcomes.select(F.col("page_id").alias("own"), F.col("good").cast("long").alias("s")).where("own is not null and s in (0, 1)")
        o = p.join(o, F.col("page_id") == F.col("own")).select("host", "s")
    total = [F.sum("s").alias("s"), F.sum("n").alias("n")]
    hosts = C.materialize(with_domains(o.groupBy("host").agg(F.sum("s").alias("s"), F.count("*").alias("n")), suffixes))
    # labelled hosts are few next to the pages: the levels above are sums of them
    domains = C.materialize(hosts.where("host is not null").groupBy("domain", "suffix").agg(*total, *_moments("h")))
    below = [F.sum(f"{c}_h").alias(f"{c}_h") for c in ("g", "n2", "s2n")]
    tops = C.materialize(domains.groupBy("suffix").agg(*total, *_moments("d"), *below))
    x = tops.agg(*total, *_moments("t"), *below, *(F.sum(f"{c}_d").alias(f"{c}_d") for c in ("g", "n2", "s2n"))).first()  # one row of sums
    kh, kd, kt = (_strength(float(x["n"] or 0), float(x["s"] or 0), *(x[f"{c}_{v}"] or 0.0 for c in ("g", "n2", "s2n"))) for v in "hdt")
    every = hosts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m0, w0 = (every[0] + 1) / (every[1] + 2), float(every[1] + 2)

    mean = lambda k, prior: (F.lit(k) * prior + F.col("s")) / (F.lit(k) + F.col("n"))
    # means of a level's groups; an unlabelled host has its domain's, or suffix's, mean at the strength of a host's prior
    t = tops.select("suffix", mean(kt, F.lit(m0)).alias("mean"))
    d = domains.join(C.maybe_broadcast(t.withColumnRenamed("mean", "prior")), "suffix").select("domain", mean(kd, F.col("prior")).alias("mean"))
    h = hosts.where("host is not null").join(C.maybe_broadcast(d.withColumnRenamed("mean", "prior")), "domain")
    h = h.select("host", "s", "n", mean(kh, F.col("prior")).alias("mean"), (F.lit(kh) + F.col("n")).alias("size"))
    found = with_domains(p, suffixes)
    for key, table in (("host", h), ("domain", d.withColumn("size", F.lit(kh))), ("suffix", t.withColumn("size", F.lit(kh)))):
        own = _bounded(table, level).withColumnsRenamed({"mean": f"mean_{key}", "low": f"low_{key}"}).drop("size")
        found = found.join(C.maybe_broadcast(C.materialize(own)), key, "left")
    none, unknown = (float(beta_quantile(level, np.array([m0 * w]), np.array([(1 - m0) * w]))[0]) for w in (w0, kh))
    low = F.round(F.coalesce("low_host", "low_domain", "low_suffix", F.when(F.col("host").isNull(), none).otherwise(unknown)), 6)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.withColumn("lower_bound", low).select("page_id", "host", "domain", "suffix", count("n").alias("n_labelled"), count("s").alias("n_good"), F.round(F.coalesce("mean_host", "mean_domain", "mean_suffix", F.lit(m0)), 6).alias("posterior_mean"), "lower_bound", (F.col("lower_bound") >= threshold).alias("accepted"))


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, good): the quality label of the document whose number ends the page's path."""
    doc = F.regexp_extract(F.col("url"), r"^[a-zA-Z]+://[^/]+/(?:[^?#]*/)?([0-9]+)(?:\.html|/)?(?:[?#].*)?$", 1)
    p = pages.select("page_id", "url", doc.alias("d")).where("d != ''").select("page_id", "url", F.expr("try_cast(d as bigint)").alias("doc_id"))
    return p.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "url", "good")


def _strength_sql(table: str) -> str:
    rho = "(((s2n - good * good / big) / ((good / big) * (1 - good / big))) - (g - 1)) / (big - n2 / big - (g - 1))"
    return f"""(SELECT 1 / (CASE WHEN big > 0 AND good > 0 AND good < big AND big - n2 / big - (g - 1) > 0 THEN greatest(0.001::double, least(0.5::double, {rho})) ELSE 0.001::double END) - 1
      FROM (SELECT sum(n)::double AS big, sum(s)::double AS good, count(*)::double AS g, sum(n::double * n) AS n2, sum(s::double * s / n) AS s2n FROM {table}))"""


def _cdf_sql(x: str, a: str, b: str, terms: int = 400) -> str:
    """I_x(a, b): the continued fraction from its end, on the side of x where it converges."""
    def side(x: str, a: str, b: str) -> str:
        q = f"CASE WHEN k % 2 = 0 THEN (k / 2) * ({b} - k / 2) * {x} / (({a} + k - 1) * ({a} + k)) ELSE -({a} + (k - 1) / 2) * ({a} + {b} + (k - 1) / 2) * {x} / (({a} + k - 1) * ({a} + k)) END"
        return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / list_reduce(range({terms}, 0, -1), lambda r, k: 1 + ({q}) / r, 1.0::double)"

    return f"CASE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - ({side(f'(1 - {x})', b, a)}) ELSE {side(x, a, b)} END"


def oracle_sql() -> str:
    tail = lambda k: f"array_to_string(l[-{k}:], '.')"
    return f"""
WITH RECURSIVE p0 AS (SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@\\[\\]]+)', 1), '\\.$', ''), '') AS host,
              try_cast(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/]+/(?:[^?#]*/)?([0-9]+)(?:\\.html|/)?(?:[?#].*)?$', 1), '') AS bigint) AS doc_id FROM pages),
hs AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM p0 WHERE host IS NOT NULL)),
hx AS (SELECT host, l, {_suffix_case("host", tail, public_suffixes()).replace("regexp_like", "regexp_matches")} AS suffix FROM hs),
hd AS (SELECT host, suffix, CASE WHEN suffix = 'ip' THEN host ELSE array_to_string(l[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM hx),
p AS (SELECT p0.*, suffix, domain FROM p0 LEFT JOIN hd ON p0.host = hd.host),
per_host AS (SELECT host, domain, suffix, sum(quality) AS s, count(*) AS n FROM p JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY ALL),
named AS (SELECT * FROM per_host WHERE host IS NOT NULL),
domains AS (SELECT domain, suffix, sum(s) AS s, sum(n) AS n FROM named GROUP BY ALL),
tops AS (SELECT suffix, sum(s) AS s, sum(n) AS n FROM named GROUP BY ALL),
lv AS (SELECT (SELECT (coalesce(sum(s), 0) + 1)::double / (coalesce(sum(n), 0) + 2) FROM per_host) AS m0, (SELECT (coalesce(sum(n), 0) + 2)::double FROM per_host) AS w0,
         {_strength_sql("tops")} AS kt, {_strength_sql("domains")} AS kd, {_strength_sql("named")} AS kh),
t AS (SELECT suffix, (kt * m0 + s) / (kt + n) AS mt FROM tops, lv),
d AS (SELECT domain, (kd * mt + s) / (kd + n) AS md FROM domains JOIN t USING (suffix), lv),
x AS (SELECT p.page_id, p.host, p.domain, p.suffix, coalesce(named.s, 0) AS s, coalesce(named.n, 0) AS n, coalesce(md, mt, m0) AS prior, CASE WHEN p.host IS NULL THEN w0 ELSE kh END AS k
      FROM p LEFT JOIN named ON p.host = named.host LEFT JOIN d ON p.domain = d.domain LEFT JOIN t ON p.suffix = t.suffix, lv),
y AS (SELECT *, (k * prior + s) / (k + n) AS mean, k + n AS size FROM x),
ab AS (SELECT DISTINCT mean, size, mean * size AS a, (1 - mean) * size AS b FROM y),
q AS (SELECT mean, size, a, b, 0.0::double AS lo, 1.0::double AS hi, 0 AS step FROM ab UNION ALL
      SELECT mean, size, a, b, CASE WHEN f < {LEVEL}::double THEN mid ELSE lo END, CASE WHEN f < {LEVEL}::double THEN hi ELSE mid END, step + 1
      FROM (SELECT *, {_cdf_sql("mid", "a", "b")} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM q WHERE step < 50)))
SELECT page_id, host, domain, suffix, n::bigint AS n_labelled, s::bigint AS n_good, round(y.mean, 6) AS posterior_mean,
       round((lo + hi) / 2, 6) AS lower_bound, round((lo + hi) / 2, 6) >= {THRESHOLD} AS accepted
FROM y JOIN q ON y.mean = q.mean AND y.size = q.size AND q.step = 50
"""


ORACLE_SQL = oracle_sql()
