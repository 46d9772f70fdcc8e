"""Rule-based reading of reports: sections, labels with negation and uncertainty, severity, measurements, advice.

Mentions are found without user code: each surface form is a regular expression of its own, fixed in the plan, which
yields what stands before and after every mention. A report is read in one projection, without explosion, shuffle or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = {
    "atelectasis": ("volume loss", "atelectatic", "atelectasis"),
    "cardiomegaly": ("enlarged heart", "cardiomegaly", "cardiac enlargement", "enlarged cardiac silhouette", "enlargement of the cardiac silhouette"),
    "edema": ("kerley", "edema", "interstitial edema", "pulmonary edema", "vascular congestion"),
    "pleural_effusion": ("effusion", "pleural fluid", "pleural effusion"),
    "pneumonia": ("consolidation", "infiltrate", "pneumonia", "airspace disease", "airspace opacity", "infectious process"),
    "pneumothorax": ("pneumothorax",),
}
#: Substrings, not words: "no " and "not " keep their blank.
NEGATION = ("absence of", "clear of", "free of", "negative for", "no ", "no evidence for", "no evidence of", "no findings of", "no signs of", "not ", "resolved", "ruled out", "rules out", "without", "without evidence of")
UNCERTAIN = ("can not be excluded", "cannot be excluded", "cannot exclude", "compatible with", "concerning for", "consistent with", "differential", "likely", "may represent", "possible", "possibly", "probable", "questionable", "suggestive of", "suspicious for", "versus", "vs.", "worrisome for")
TERMINATION = ("although", "aside from", "but", "except", "however", "otherwise", "though", "which", "yet")
SEVERITY = {1: ("minimal", "tiny", "trace"), 2: ("mild", "slight", "small"), 3: ("moderate",), 4: ("extensive", "large", "marked", "severe", "substantial"), 5: ("massive",)}
CUES = ("advise", "attention", "consider", "correlate", "follow up", "follow-up", "further evaluation", "recommend", "suggest")
HEADERS = ("COMPARISON", "CONCLUSION", "EXAMINATION", "FINDINGS", "HISTORY", "IMPRESSION", "INDICATION", "NOTIFICATION", "TECHNIQUE", "WET READ")
SCOPE, AFTER, GRADE_SCOPE = 45, 30, 40
_A, _B = "\u0001", "\u0002"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def sections(text: Column) -> Column:
    """Map of lower-case header to text; text before the first header is "preamble"; the last of a header wins."""
    marked = F.regexp_replace(text, r"(?imd)^\s*(" + "|".join(HEADERS) + r")\s*:", f"{_A}$1{_B}")
    pieces = F.split(marked, _A)
    entry = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(F.lower(F.substring_index(p, _B, 1)).alias("k"), F.regexp_replace(F.substring_index(p, _B, -1), r"^\s+|\s+$", "").alias("v")))
    lead = F.regexp_replace(pieces[0], r"^\s+|\s+$", "")
    first = F.when((lead != "") | (F.size(pieces) == 1), F.array(F.struct(F.lit("preamble").alias("k"), lead.alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    # a fold keeps the last of equal headers whatever the session's map policy
    last = F.aggregate(entry, first, lambda acc, e: F.concat(F.filter(acc, lambda x: x["k"] != e["k"]), F.array(e)))
    return F.when(text.isNotNull(), F.map_from_entries(last))


def label_text(text: Column, parts: Column) -> Column:
    """Findings, impression and conclusion; if blank, the preamble, else the whole text."""
    own = F.trim(F.concat_ws(" ", parts["findings"], parts["impression"], parts["conclusion"]))
    return F.when(own != "", own).when(F.coalesce(parts["preamble"], F.lit("")) != "", parts["preamble"]).otherwise(text)


def scope_before(before: Column) -> Column:
    """What precedes a mention in its clause."""
    s = F.regexp_replace(before, r"(?s)^.*[.;:]", "")
    return F.regexp_replace(s, r"(?s)^.*\b(?:" + "|".join(TERMINATION) + r")\b", "")


def severity_of(context: Column) -> Column:
    out = F.lit(None).cast("int")
    for g in sorted(SEVERITY):
        out = F.when(context.rlike(r"\b(?:" + "|".join(SEVERITY[g]) + r")\b"), F.lit(g)).otherwise(out)
    return out


def _mentions(low: Column, form: str) -> Column:
    """Array of (b: clause before, near, after) of the whole-word mentions of a form in a lower-case text."""
    around = rf"(?s)\b{form}\b(?<=(\A.{{0,{SCOPE - 1}}}|.{{{SCOPE}}}){form})(?=(.{{0,{AFTER}}}))"
    found = [F.regexp_extract_all(low, F.lit(around), F.lit(k)) for k in (1, 2)]
    each = F.zip_with(*found, lambda before, after: F.struct(scope_before(before).alias("b"), F.right(before, F.lit(GRADE_SCOPE)).alias("near"), after.alias("after")))
    return F.when(low.contains(form), each).otherwise(F.array().cast("array<struct<b:string,near:string,after:string>>"))


def _verdict(m: Column) -> Column:
    """1 present, 0 absent, -1 in doubt; doubt wins over negation."""
    return F.when(any_of(m["b"], UNCERTAIN) | any_of(m["after"], UNCERTAIN), -1).when(any_of(m["b"], NEGATION), 0).otherwise(1)


def finding(low: Column, name: str) -> Column:
    """(label, severity) of a finding; of several mentions present beats doubt beats absent. Null without a mention."""
    def more(acc: Column, m: Column) -> Column:
        return F.struct(F.greatest(acc["r"], F.when(m["v"] == 1, 3).when(m["v"] == -1, 2).otherwise(1)).alias("r"), F.greatest(acc["severity"], F.when(m["v"] == 1, severity_of(m["near"]))).alias("severity"))

    rated = F.transform(F.concat(*(_mentions(low, form) for form in VOCABULARY[name])), lambda m: F.struct(_verdict(m).alias("v"), m["near"].alias("near")))
    first = F.struct(F.lit(0).alias("r"), F.lit(None).cast("int").alias("severity"))
    return F.aggregate(rated, first, more, lambda acc: F.struct(F.when(acc["r"] == 3, 1).when(acc["r"] == 2, -1).when(acc["r"] == 1, 0).alias("label"), acc["severity"].alias("severity")))


def label_matrix(reports: DataFrame, key: str, text: str) -> DataFrame:
    """One row a report: label_<finding> and severity_<finding>, null where nothing is mentioned."""
    names = sorted(VOCABULARY)
    d = reports.select(key, F.lower(F.col(text)).alias("low")).select(key, *(finding(F.col("low"), n).alias(f"f_{n}") for n in names))
    return d.select(key, *(F.col(f"f_{n}.{k}").alias(f"{k}_{n}") for n in names for k in ("label", "severity")))


def labels(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding, label, severity) of the findings that a report mentions."""
    each = F.array(*(F.struct(F.lit(n).alias("finding"), F.col(f"label_{n}").alias("label"), F.col(f"severity_{n}").alias("severity")) for n in sorted(VOCABULARY)))
    return label_matrix(reports, key, text).select(key, F.explode(F.filter(each, lambda x: x["label"].isNotNull())).alias("x")).select(key, "x.*")


def measurements(text: Column) -> Column:
    """Sizes in cm, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(?:cm|mm)\b"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"^(\d+(?:\.\d+)?)", 1).cast("double") / F.when(F.lower(m).endswith("mm"), 10.0).otherwise(1.0))


def recommendations(text: Column) -> Column:
    """Sentences of more than 10 characters with a cue."""
    s = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(s, lambda x: (F.length(x) > 10) & any_of(F.lower(x), CUES))


def parse_reports(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Everything of a report in one row: sections, texts, labels, severities, measurements, recommendations, n_chars."""
    names = sorted(VOCABULARY)
    d = reports.select(key, F.col(text).alias("__t")).withColumn("sections", sections(F.col("__t")))
    d = d.withColumn("__low", F.lower(label_text(F.col("__t"), F.col("sections"))))
    s = F.col("sections")
    d = d.select(key, "sections", F.coalesce(s["findings"], F.lit("")).alias("findings_text"), F.coalesce(s["impression"], s["conclusion"], F.lit("")).alias("impression_text"), measurements(F.col("__t")).alias("measurements"), recommendations(F.col("__t")).alias("recommendations"), F.length("__t").alias("n_chars"), *(finding(F.col("__low"), n).alias(f"f_{n}") for n in names))
    out = d.select("*", *(F.col(f"f_{n}.{k}").alias(f"{k}_{n}") for n in names for k in ("label", "severity"))).drop(*(f"f_{n}" for n in names))
    return out.withColumn("positive_findings", F.array_compact(F.array(*(F.when(F.col(f"label_{n}") == 1, F.lit(n)) for n in names))))
