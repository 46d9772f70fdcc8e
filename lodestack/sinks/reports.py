"""Finding tables and a self-contained HTML report. Only aggregates and bounded samples reach the driver."""

from __future__ import annotations

from datetime import UTC, datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import qc

ROWS_SHOWN = 500
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}.ERROR{background:#fdd}.WARN{background:#ffd}"


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and the six columns, also without findings."""
    out = findings.select(*qc.FINDING_COLUMNS)
    out.write.mode(mode).option("header", True).csv(path)


def html_table(rows: list[dict], severity: str | None = None) -> str:
    if not rows:
        return "<p>No findings.</p>"
    head = "".join("<th>" + escape(name) + "</th>" for name in map(str, rows[0]))
    body = "".join("<tr" + (f' class="{escape(str(r[severity]))}"' if severity else "") + ">" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return "<table>" + f"<tr>{head}</tr>" + body + "</table>"


def write_html(findings: DataFrame, records: DataFrame, path: str, name: str = "dataset", rows: int = ROWS_SHOWN) -> str:
    """Summary, counts by check (most first) and the first findings by severity and owner, escaped."""
    s = qc.summarise(findings, records).drop("failed").first().asDict()
    checks = [r.asDict() for r in qc.by_check(findings).collect()]
    shown = [r.asDict() for r in findings.orderBy("severity", *[c for c in qc.FINDING_COLUMNS if c != "severity"]).limit(rows).collect()]
    more = f"<p>{s['n_findings'] - rows} further findings are in the table beside this report.</p>" if s["n_findings"] > rows else ""
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(name)}</title><style>{_STYLE}</style></head><body><h1>Quality control: {escape(name)}</h1><p>{datetime.now(UTC):%Y-%m-%d %H:%M UTC}</p>{html_table([s])}<h2>By check</h2>{html_table(checks)}<h2>Findings</h2>{html_table(shown, 'severity')}{more}</body></html>"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page, "utf-8")
    return path


def write_phi(records: DataFrame, path: str, flags: str = "phi_flags", mode: str = "errorifexists") -> None:
    """Only rows with a populated identifier; the header is always there."""
    from pyspark.sql import functions as F

    d = records.where(F.size(flags) > 0).withColumn(flags, F.array_join(flags, ","))
    d.write.mode(mode).option("header", True).csv(path)


def write_fusion(table: DataFrame, timeline: DataFrame, out: str, base: tuple[str, ...] = ("study_id", "subject_id", "findings_text", "impression_text", "n_recommendations"), mode: str = "errorifexists") -> dict[str, str]:
    """The fused table as Parquet and CSV, the timeline, and the structured reports."""
    from ..operators.fusion import structured_columns
    from ..sources.manifest import flatten

    paths = {k: f"{out}/{k}" for k in ("fusion.parquet", "fusion.csv", "timeline.csv", "structured_reports.parquet")}
    table.write.mode(mode).parquet(paths["fusion.parquet"])
    flatten(table).write.mode(mode).option("header", True).csv(paths["fusion.csv"])
    timeline.write.mode(mode).option("header", True).csv(paths["timeline.csv"])
    structured_columns(table, base).write.mode(mode).parquet(paths["structured_reports.parquet"])
    return paths
