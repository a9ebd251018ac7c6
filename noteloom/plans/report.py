"""Scorecards: a dictionary of a few collected rows, as JSON, HTML or text."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

from noteloom.plans import scoring as C


def scorecard(scores: DataFrame, suites: DataFrame, model: str, judge: str, split: str, generated_at: str | None = None) -> dict:
    """Everything a report shows. scores: from example_scores, with latency_s if timed; suites: from suite_results."""
    gates = C.gates(C.overall_rates(scores), suites)
    rows = [r.asDict() for r in gates.collect()]  # eight
    strata = [r.asDict() for r in C.per_stratum(scores).collect()]  # one for each stratum
    card = {
        "model": model,
        "judge": judge,
        "split": split,
        "n_examples": sum(r["n"] for r in strata),
        "release_ok": all(r["passed"] for r in rows if r["hard"]),
        "gates": [{"name": r["name"], "value": round(r["value"], 4), "threshold": r["threshold"], "hard_gate": r["hard"], "passed": r["passed"]} for r in rows],
        "per_stratum": {r.pop("stratum"): r for r in strata},
        "suites": [r.asDict() for r in suites.collect()],  # three
    }
    if generated_at:
        card["generated_at"] = generated_at
    if "latency_s" in scores.columns:
        for r in C.latency_stats(scores, "latency_s").collect():
            card["latency_s"] = r.asDict()
    return card


def write_json(card: dict, path: str) -> None:
    Path(path).write_text(json.dumps(card, indent=2, ensure_ascii=False), encoding="utf-8")


def _table(rows: list[dict]) -> str:
    if not rows:
        return ""
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", k) for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r.values()) + "</tr>" for r in rows) + "</table>"


def to_html(card: dict) -> str:
    verdict = "release" if card["release_ok"] else "blocked"
    strata = [{"stratum": k, **v} for k, v in card["per_stratum"].items()]
    return f"<!doctype html><meta charset=utf-8><title>Scorecard</title><h1>{html.escape(card['model'])}: {verdict}</h1>" + "".join(_table(x) for x in (card["gates"], strata, card["suites"]))


def to_text(card: dict) -> str:
    out = [f"{card['model']} judged by {card['judge']} on {card['split']} ({card['n_examples']}): {'release' if card['release_ok'] else 'blocked'}"]
    out += [f"{'ok  ' if g['passed'] else 'FAIL'} {g['name']:<26}{g['value']:.4f} >= {g['threshold']}{' hard' * g['hard_gate']}" for g in card["gates"]]
    out += [f"{k:<20}" + "  ".join(f"{n}={v}" for n, v in row.items()) for k, row in card["per_stratum"].items()]
    return "\n".join(out)
