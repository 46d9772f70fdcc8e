"""Queries of the report reader, over reports composed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as X
from .registry import Tables, query

TEMPLATES = (
    "EXAMINATION: chest.\nINDICATION: cough, rule out pneumonia.\nFINDINGS: No evidence of consolidation. Heart is normal.\nIMPRESSION: Clear lungs.",
    "FINDINGS: Large left pleural effusion measuring 3.2 cm. Mild interstitial edema.\nIMPRESSION: Effusion, recommend follow-up radiograph in two weeks.",
    "FINDINGS: Pneumonia cannot be excluded. No pneumothorax.\nCONCLUSION: Possible pneumonia.",
    "There is a small effusion, but no edema is seen. Nodule of 5 mm.",
    "FINDINGS: No effusion or pneumothorax, however consolidation is present.\nIMPRESSION: Moderate cardiomegaly. Consider echocardiography soon.",
    "wet read: Atelectasis versus infiltrate.\nIMPRESSION: No edema. Findings compatible with pneumonia.",
    "Small bilateral pleural effusions.\nFINDINGS: Severe cardiomegaly without acute process. Vascular congestion, 12mm and 1.5cm nodes.",
    "INDICATION: effusion.\nNothing else.",
    "IMPRESSION: Massive pneumothorax. IMPRESSION repeated.\nIMPRESSION: Trace pneumothorax has resolved. Volume loss is likely.",
    "",
)


def reports(t: Tables) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("o_orderkey") % len(TEMPLATES) + 1).cast("int"))
    return t.orders.select("o_orderkey", text.alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_R = f"r AS (SELECT o_orderkey, ([{', '.join(map(_q, TEMPLATES))}])[o_orderkey % {len(TEMPLATES)} + 1] AS text FROM orders)"
_HEAD = "|".join(X.HEADERS)
_ANY = lambda c, ws: f"regexp_matches({c}, {_q('|'.join(w.replace('.', chr(92) + '.') for w in ws))})"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_SEC = f"""p0 AS (SELECT o_orderkey, text, string_split(regexp_replace(text, '(?im)^\\s*({_HEAD})\\s*:', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM r),
e AS (SELECT o_orderkey, generate_subscripts(ps, 1) AS k, unnest(ps) AS p, len(ps) AS n FROM p0),
s AS (SELECT o_orderkey, CASE WHEN k = 1 THEN 'preamble' ELSE lower(string_split(p, chr(2))[1]) END AS name, {_STRIP("CASE WHEN k = 1 THEN p ELSE string_split(p, chr(2))[2] END")} AS body, k, n FROM e),
sec AS (SELECT o_orderkey, name, arg_max(body, k) AS body FROM s WHERE k > 1 OR body <> '' OR n = 1 GROUP BY ALL)"""
_LT = f"""{_SEC}, l0 AS (SELECT r.o_orderkey, text, trim(concat_ws(' ', max(body) FILTER (name = 'findings'), max(body) FILTER (name = 'impression'), max(body) FILTER (name = 'conclusion'))) AS own, max(body) FILTER (name = 'preamble') AS pre FROM r LEFT JOIN sec USING (o_orderkey) GROUP BY ALL),
lt AS (SELECT o_orderkey, CASE WHEN own <> '' THEN own WHEN coalesce(pre, '') <> '' THEN pre ELSE text END AS t FROM l0)"""
_FORMS = ", ".join(f"({_q(f)}, {_q(w)})" for f, ws in sorted(X.VOCABULARY.items()) for w in ws)
_GRADE = "CASE " + " ".join(f"WHEN regexp_matches(near, '\\b(?:{'|'.join(X.SEVERITY[g])})\\b') THEN {g}" for g in sorted(X.SEVERITY, reverse=True)) + " END"
_M = f"""{_LT}, fm AS (SELECT * FROM (VALUES {_FORMS}) AS fm(finding, form)),
sp AS (SELECT o_orderkey, lower(t) AS t, finding, form, string_split_regex(lower(t), '\\b' || form || '\\b') AS ps FROM lt, fm WHERE contains(lower(t), form)),
mk AS (SELECT o_orderkey, t, finding, form, ps, unnest(range(1, len(ps)))::int AS k FROM sp WHERE len(ps) > 1),
pf AS (SELECT o_orderkey, finding, form, t, replace(array_to_string(ps[1:k], chr(3)), chr(3), form) AS prefix FROM mk),
mn0 AS (SELECT o_orderkey, finding, right(prefix, {X.SCOPE}) AS before, right(prefix, {X.GRADE_SCOPE}) AS near, substr(t, length(prefix) + length(form) + 1, {X.AFTER}) AS after FROM pf),
mn1 AS (SELECT *, regexp_replace(regexp_replace(before, '(?s)^.*[.;:]', ''), '(?s)^.*\\b(?:{'|'.join(X.TERMINATION)})\\b', '') AS b FROM mn0),
mn AS (SELECT *, CASE WHEN {_ANY('b', X.UNCERTAIN)} OR {_ANY('after', X.UNCERTAIN)} THEN -1 WHEN {_ANY('b', X.NEGATION)} THEN 0 ELSE 1 END AS verdict FROM mn1),
lb AS (SELECT o_orderkey, finding, max(CASE verdict WHEN 1 THEN 3 WHEN -1 THEN 2 ELSE 1 END) AS r, max(CASE WHEN verdict = 1 THEN {_GRADE} END) AS severity FROM mn GROUP BY ALL)"""


@query(f"WITH {_R}, {_SEC} SELECT o_orderkey, count(*) AS n_sections, coalesce(max(body) FILTER (name = 'findings'), '') AS findings_text, coalesce(max(body) FILTER (name = 'impression'), max(body) FILTER (name = 'conclusion'), '') AS impression_text, coalesce(max(body) FILTER (name = 'preamble'), '') AS preamble FROM sec GROUP BY 1")
def report_sections(t: Tables) -> DataFrame:
    s = F.col("s")
    d = reports(t).select("o_orderkey", X.sections(F.col("text")).alias("s"))
    return d.select("o_orderkey", F.size("s").cast("long").alias("n_sections"), F.coalesce(s["findings"], F.lit("")).alias("findings_text"), F.coalesce(s["impression"], s["conclusion"], F.lit("")).alias("impression_text"), F.coalesce(s["preamble"], F.lit("")).alias("preamble"))


def _label_text(t: Tables) -> DataFrame:
    d = reports(t).withColumn("s", X.sections(F.col("text")))
    return d.select("o_orderkey", X.label_text(F.col("text"), F.col("s")).alias("t"))


@query(f"WITH {_R}, {_M} SELECT o_orderkey, finding, CASE r WHEN 3 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS label, severity FROM lb")
def report_labels(t: Tables) -> DataFrame:
    return X.labels(_label_text(t), "o_orderkey", "t")


@query(f"WITH {_R}, {_M} SELECT lt.o_orderkey, " + ", ".join(f"max(CASE r WHEN 3 THEN 1 WHEN 2 THEN -1 WHEN 1 THEN 0 END) FILTER (finding = '{f}') AS label_{f}, max(severity) FILTER (finding = '{f}') AS severity_{f}" for f in sorted(X.VOCABULARY)) + " FROM lt LEFT JOIN lb USING (o_orderkey) GROUP BY 1")
def report_matrix(t: Tables) -> DataFrame:
    return X.label_matrix(_label_text(t), "o_orderkey", "t")


@query(f"WITH {_R}, {_M} SELECT count(DISTINCT o_orderkey) AS n_positive, (SELECT count(*) FROM r) AS n_reports FROM lb WHERE r = 3")
def report_positive_count(t: Tables) -> DataFrame:
    d = _label_text(t)
    m = X.label_matrix(d, "o_orderkey", "t")
    hit = F.greatest(*(F.coalesce(F.col(f"label_{n}"), F.lit(-2)) for n in sorted(X.VOCABULARY))) == 1
    return m.agg(F.count_if(hit).alias("n_positive"), F.count("*").alias("n_reports"))


@query(f"""
WITH {_R}, f AS (SELECT o_orderkey, regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:cm|mm)\\b', 0) AS m FROM r)
SELECT o_orderkey, array_to_string(list_transform(m, lambda x: printf('%.3f', regexp_extract(x, '^(\\d+(?:\\.\\d+)?)', 1)::double / CASE WHEN lower(x) LIKE '%mm' THEN 10.0::double ELSE 1.0::double END)), ',') AS sizes FROM f""")
def report_measurements(t: Tables) -> DataFrame:
    return reports(t).select("o_orderkey", F.array_join(F.transform(X.measurements(F.col("text")), lambda x: F.format_string("%.3f", x)), ",").alias("sizes"))


@query(f"""
WITH {_R}, s AS (SELECT o_orderkey, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP('x')}) AS s FROM r)
SELECT o_orderkey, array_to_string(list_filter(s, lambda x: length(x) > 10 AND {_ANY('lower(x)', X.CUES)}), '|') AS advice FROM s""")
def report_recommendations(t: Tables) -> DataFrame:
    return reports(t).select("o_orderkey", F.array_join(X.recommendations(F.col("text")), "|").alias("advice"))


@query("""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))::bigint AS n_sentences FROM documents""")
def sentence_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+")).cast("long").alias("n_sentences"))
