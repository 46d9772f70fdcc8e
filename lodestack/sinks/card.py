"""Dataset card in markdown, from small aggregates."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

SECTIONS = tuple("Purpose/Provenance/Cohort definition/Attrition/Quality control/Bias and limitations/Recommended uses/NOT recommended/Ethics/Maintenance".split("/"))
ROWS = 25


def table(rows: list[dict], most: int = ROWS) -> str:
    if not rows:
        return "_none_"
    cols = list(rows[0])
    cell = lambda v: "" if v is None or v != v else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows[:most])]
    return "\n".join(lines) + (f"\n\n_{len(rows) - most} further rows omitted_" if len(rows) > most else "")


def bullets(items: list[str], none: str = "- none found") -> str:
    return "\n".join(f"- {x}" for x in items) or none


def build(dataset: str, version: str, description: str, dataset_hash: str, n_studies: int, n_subjects: int, cohort: dict, attrition: list[dict], grades: list[dict], bias: list[dict], splits: dict[str, int], licence: str = "as the source data", source: str = "", shift: list[dict] | None = None) -> str:
    """All ten sections; ``bias`` rows have severity and message, ``grades`` rows grade, n and mean_score."""
    scored = sum(g["n"] for g in grades)
    mean = round(sum(g["n"] * g["mean_score"] for g in grades) / scored, 1) if scored else 0.0
    body = {
        "Purpose": description,
        "Provenance": f"{source or 'not stated'}\n\nLicence: {licence}\n\nContent hash: `{dataset_hash}`",
        "Cohort definition": table(cohort.get("criteria", [])),
        "Attrition": table(attrition),
        "Quality control": f"Mean score {mean}; {sum(g['n'] for g in grades if g['grade'] in ('D', 'F'))} studies below 65.\n\n" + table(sorted(grades, key=lambda g: g["grade"])),
        "Bias and limitations": bullets([b["message"] for b in bias if b["severity"] == "WARN"]) + ("\n\n" + table(shift) if shift else ""),
        "Recommended uses": "- research on the population described above",
        "NOT recommended": "- clinical decisions\n- populations that the audit shows to be thin",
        "Ethics": "Identifiers are removed; linking rows to persons is not permitted.",
        "Maintenance": "Releases don't change; corrections come as new versions.\n\n" + table([{"split": k, "n_subjects": v} for k, v in splits.items()]),
    }
    head = f"# {dataset} ({version})\n\n{dt.datetime.now(dt.UTC):%Y-%m-%d %H:%M UTC}: {n_studies} studies of {n_subjects} subjects.\n"
    return head + "".join(f"\n## {s}\n\n{body[s]}\n" for s in SECTIONS)


def write(card: str, path: str | Path) -> Path:
    at = Path(path)
    os.makedirs(at.parent, exist_ok=True)
    at.write_text(card, "utf-8")
    return at
