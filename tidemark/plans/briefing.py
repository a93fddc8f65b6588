"""The corpus report as text: small aggregates, of at most `top` rows each, laid out on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

SECTIONS = {
    "employers": "Employers", "disciplines": "Disciplines", "certifications": "Credentials", "states": "States", "installations": "Installations", "branchs": "Branches", "clearances": "Clearances", "titles": "Titles", "timeline": "By month",
}


def _rows(frame: DataFrame, top: int) -> list[dict]:
    return [r.asDict() for r in frame.limit(top).collect()]


def _said(value: object) -> str:
    if value is None:
        return "–"
    if isinstance(value, list):
        return ", ".join(map(str, value))
    return f"{value:,.4g}" if isinstance(value, float) and abs(value) < 10 else f"{value:,.0f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def _headline(report: dict[str, DataFrame]) -> list[str]:
    (totals,), (remote,) = _rows(report["totals"], 1), _rows(report["remote"], 1)
    lines = [f"{totals['jobs']:,} jobs from {totals['employers']:,} employers."]
    pay = _rows(report["salary"], 1)
    if pay:
        lines.append(f"Median pay ${pay[0]['median']:,.0f} over {pay[0]['n']:,} jobs that state one; ${pay[0]['p25']:,.0f} to ${pay[0]['p75']:,.0f} is the middle half.")
    lines.append(f"{remote['share']:.0%} remote ({remote['count']:,}).")
    if totals["postings"] > totals["jobs"]:
        lines.append(f"{totals['postings'] - totals['jobs']:,} of {totals['postings']:,} records are copies or later revisions.")
    return lines


def markdown(report: dict[str, DataFrame], top: int = 10) -> str:
    """A briefing in Markdown of plans.postings.insights; sections without rows are left out."""
    out = ["# Briefing", "", *(f"- {x}" for x in _headline(report)), ""]
    for key, title in SECTIONS.items():
        rows = _rows(report[key], 120 if key == "timeline" else top)
        if rows:
            cell = lambda v: _said(v).replace("|", "\\|")
            out += [f"## {title}", "", "| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])] + ["| " + " | ".join(map(cell, r.values())) + " |" for r in rows] + [""]
    return "\n".join(out)


def page(report: dict[str, DataFrame], top: int = 10) -> str:
    """The same as one HTML page without scripts or links: bars behind the counts, months as columns."""
    out = ["<!doctype html><meta charset=utf-8><title>Briefing</title><style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}i{display:inline-block;background:#69c;height:9px}</style>", "<h1>Briefing</h1>"]
    out += [f"<p>{escape(x)}</p>" for x in _headline(report)]
    for key, title in SECTIONS.items():
        rows = _rows(report[key], 120 if key == "timeline" else top)
        if rows:
            count = next(k for k in ("count", "n") if k in rows[0])
            most = max(r[count] for r in rows) or 1
            heads = "".join(f"<th>{escape(k)}</th>" for k in rows[0])
            lines = "".join("<tr>" + "".join(f"<td>{escape(_said(v))}</td>" for v in r.values()) + f"<td><i style='width:{100 * r[count] // most}px'></i></td></tr>" for r in rows)
            out.append(f"<h2>{title}</h2><table><tr>{heads}<th></th></tr>{lines}</table>")
    return "\n".join(out)
