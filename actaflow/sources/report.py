"""The report of a window as Markdown, from small, aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.functions.text import quote
from actaflow.operators.tables import ranked

LEADS_SHOWN = 20


def report_rows(notices: DataFrame, acts: DataFrame, groups: DataFrame, start: str, end: str) -> DataFrame:
    """(label, firm, day, act_type, priority, text) of watched companies within a window."""
    window = notices.filter(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).join(groups, "group_id")
    rows = window.join(acts.select("doc_id", "num", "seq", "act_type", "priority", "scope", "detail"), ["doc_id", "num"])
    return rows.select("label", "firm", "day", "act_type", "scope", "priority", quote(F.col("detail")).alias("text"), "doc_id", "num", "seq")


def leads_shown(scored: DataFrame, most: int = LEADS_SHOWN) -> DataFrame:
    """The best leads of each group."""
    return ranked(scored, ["group_id"], [F.desc("score"), "firm", "lead_id"]).filter(F.col("rank") <= most)


def coverage(counts: DataFrame, start: str, end: str) -> DataFrame:
    """Sums of (day, what, n) within a window, one column each."""
    inside = counts.filter(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return inside.agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("announcements", "acts", "with_sheet", "prefix", "without_acts", "stored")])


def _cell(value: object) -> str:
    return str("" if value is None else value).replace("|", "/").replace("\n", " ")


def render(rows: DataFrame, leads: DataFrame, proposals: DataFrame, title: str, details: bool = True) -> str:
    """Markdown; without ``details`` no text of an act, and hence no person's name, is shown."""
    out = [f"# {title}", ""]
    ordered = rows.orderBy("label", F.desc("day"), "firm", "doc_id", "num", "seq").toLocalIterator()
    label = None
    for r in ordered:
        if r["label"] != label:
            label = r["label"]
            out += [f"## {_cell(label)}", "", "| Day | Company | Act | Priority |" + (" Text |" if details else ""), "|---|---|---|---|" + ("---|" if details else "")]
        cells = [r["day"], r["firm"], r["act_type"], r["priority"], *([r["text"]] if details else [])]
        out.append("| " + " | ".join(map(_cell, cells)) + " |")
    out += ["", "## Leads", "", "| Group | Company | Signal | Score | Tier |", "|---|---|---|---|---|"]
    for r in leads_shown(leads).orderBy("group_id", F.desc("score"), "firm").toLocalIterator():
        out.append("| " + " | ".join(_cell(r[c]) for c in ("group_id", "firm", "reason", "score", "tier")) + " |")
    out += ["", "## Proposals", "", "| Company | Field | Held | Proposed | Why |", "|---|---|---|---|---|"]
    for r in proposals.orderBy("company_id", "field", "why").toLocalIterator():
        out.append("| " + " | ".join(_cell(r[c]) for c in ("company_id", "field", "held", "proposed", "why")) + " |")
    return "\n".join(out) + "\n"
