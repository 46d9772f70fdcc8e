"""Scalar functions on columns: normalisation, parsing and formatting, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGE_EDGES = ((0.0, 40.0, "<40"), (40.0, 60.0, "40-59"), (60.0, 80.0, "60-79"), (80.0, 200.0, "80+"))
GRADES = ((90, "A"), (80, "B"), (65, "C"), (50, "D"))


def normalise_modality(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalise_sex(c: Column) -> Column:
    """M or F by the first letter, U for anything else, null for null."""
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(first.isin("M", "F"), first).otherwise("U")


def age_band(c: Column) -> Column:
    """Half-open bands; null and values outside are "unknown"."""
    out = F.lit("unknown")
    for lo, hi, name in reversed(AGE_EDGES):
        out = F.when((c >= lo) & (c < hi), F.lit(name)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024, up to PB."""
    out, units = None, "B KB MB GB TB".split()
    x = n.cast("double")
    for k, u in enumerate(units):
        cond, text = F.abs(x) < float(1024 ** (k + 1)), F.format_string(f"%.1f {u}", F.bround(x / float(1024**k), 1))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.format_string("%.1f PB", F.bround(x / float(1024**5), 1)))


def parse_age(raw: Column) -> Column:
    """Years of an age string nnnY/M/W/D; a bare number is in years; anything else is null."""
    t = F.upper(F.trim(raw))
    unit = F.regexp_extract(t, "([YMWD])$", 1)
    body = F.regexp_replace(t, "[YMWD]$", "")
    n = body.try_cast("double")
    return n / F.when(unit == "M", 12.0).when(unit == "W", 52.0).when(unit == "D", 365.0).otherwise(1.0)


def relative_to(path: Column, root: str) -> Column:
    """The path below the root, with forward slashes; unchanged outside it."""
    p = F.translate(path, "\\", "/")
    lead = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(lead), F.substr(p, F.lit(len(lead) + 1))).otherwise(path)


def voxel_volume(spacing: Column) -> Column:
    """Product of the spacing, 0.0 if unknown."""
    return F.when(F.size(spacing) > 0, F.aggregate(spacing, F.lit(1.0), lambda a, x: a * x)).otherwise(0.0)


def file_modality(name: Column) -> Column:
    """Modality of an image file's name, by its suffix; null if it has none."""
    m = F.lower(F.regexp_extract(name, r"(?i)_(flair|seg|t1ce|t1|t2)\.nii(\.gz)?$", 1))
    return F.when(m != "", m)


def decode_list(text: Column, element: str = "double") -> Column:
    """An array from JSON text; a JSON scalar is an array of one, anything undecodable or null is empty."""
    arr = F.from_json(text, f"array<{element}>")
    one = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{element}>")
    scalar = ~F.trim(text).rlike(r"^[\[{]")
    one = F.when(scalar & (F.size(F.filter(one, lambda x: x.isNotNull())) > 0), one)
    return F.coalesce(arr, one, F.array().cast(f"array<{element}>"))


def encode_nested(c: Column) -> Column:
    return F.to_json(c)


def in_labels(c: Column, labels: tuple[int, ...]) -> Column:
    return F.coalesce(c.isin(*labels), F.lit(False))


def binarise(c: Column, policy: str = "zeros") -> Column:
    """1 to 1; null and everything else to 0; -1 to 0, 1 or NaN for zeros, ones or ignore."""
    doubt = {"zeros": F.lit(0.0), "ones": F.lit(1.0), "ignore": F.lit(float("nan"))}
    if policy not in doubt:
        raise ValueError(f"unknown policy: {policy}")
    return F.when(c == 1, F.lit(1.0)).when(c == -1, doubt[policy]).otherwise(0.0)
