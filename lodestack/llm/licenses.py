"""Licence scan: ordered signature rules behind a keyword prefilter.

One Aho-Corasick pass over a text finds which rules have a keyword in it; only their expressions run. Of the detections,
taken by priority, then length, then place, then rule order, one that lies within a detection already kept is
suppressed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, Rule

FIELDS = ["doc_id", "rule_id", "license", "kind", "priority", "start", "end", "matched"]


@functools.lru_cache(2)
def _engine(rules: tuple[Rule, ...]):
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for w in r.keywords:
            by_word.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w in by_word:
        a.add_word(w, w)
    a.make_automaton()
    return a, by_word, [re.compile(r.pattern, re.IGNORECASE) for r in rules]


def _plain(text: str) -> str:
    """The text as keywords are written: lower case, one blank for each run of white space, which is that of \\s.

    Expressions that ignore case also take dotted and dotless i and long s for the letters.
    """
    return " ".join(text.lower().split()).replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")


def resolve(found: Iterable[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Suppress contained detections of (rule, start, end); sorted by place.

    A detection lies within a kept one if the furthest end of those that start no later reaches its own; a Fenwick
    tree over the starts answers that, so n detections take n log n steps.
    """
    found = sorted(set(found), key=lambda x: (-rules[x[0]].priority, x[1] - x[2], x[1], x[0]))
    rank = {s: i for i, s in enumerate(sorted({s for _, s, _ in found}), 1)}
    far = [-1] * (len(rank) + 1)
    kept: list[tuple[int, int, int]] = []
    for r, s, e in found:
        i = rank[s]
        while i and far[i] < e:
            i &= i - 1
        if i:
            continue
        kept.append((r, s, e))
        i = rank[s]
        while i < len(far):
            if far[i] < e:
                far[i] = e
            i += i & -i
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan(text: str | None, rules: tuple[Rule, ...] = tuple(RULES), prefilter: bool = True) -> list[tuple[int, int, int]]:
    """(rule, start, end) of each detection that stands, in characters; without the prefilter every rule runs."""
    if not text:
        return []
    automaton, by_word, compiled = _engine(rules)
    if prefilter:
        hits = {w for _, w in automaton.iter(_plain(text))}
        todo = sorted({i for w in hits for i in by_word[w]})
    else:
        todo = range(len(rules))
    found = [(i, m.start(), m.end()) for i in todo for m in compiled[i].finditer(text) if m.end() > m.start()]
    return resolve(found, rules) if found else []


def license_detections(docs: DataFrame, *, rules: tuple[Rule, ...] = tuple(RULES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a detection: doc_id, rule_id, license, kind, priority, start, end (characters, end exclusive), matched.

    Whole texts are scanned, wrapped over lines or not. A null or empty text has no detections; rows of null id and
    repeated rows are scanned each. Equal intervals go to the higher priority, then to the earlier rule. Other columns
    are ignored whatever their names; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for r, s, e in scan(text, rules):
                    at.append(i)
                    x = rules[r]
                    rows.append((x.rule_id, x.license, x.kind, x.priority, s, e, text[s:e]))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.record_batch([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=FIELDS)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, rule_id string, license string, kind string, priority int, start int, end int, matched string")
