"""What an engine did: its strata, rules and rounds, as data and as a page."""

from __future__ import annotations

import html
import json

from .engine import Engine
from .plans.ast import Atom


def profile(engine: Engine) -> dict:
    """Strata with their rules and the relations that these read, and the rounds of the last evaluation."""
    strata = []
    for i, s in enumerate(engine.program.strata):
        rules = [{"line": r.line, "head": r.head.rel, "reads": [p.rel for p in r.body if isinstance(p, Atom) and not p.negated], "without": [p.rel for p in r.body if isinstance(p, Atom) and p.negated], "plan": r.plan} for r in s.rules]
        strata.append({"stratum": i, "kind": s.loop.kind if s.loop else "recursive" if s.recursive else "plain", "heads": s.heads, "rules": rules})
    return {"strata": strata, "rounds": engine.metrics, "outputs": engine.wanted, "warnings": engine.program.warnings}


def write_json(engine: Engine, path: str) -> None:
    with open(path, "w") as f:
        json.dump(profile(engine), f, indent=1)


def page(engine: Engine) -> str:
    """A page with a table of rules for each stratum, and its rounds with bars of new rows."""
    p, out = profile(engine), ["<!doctype html><meta charset=utf-8><title>profile</title><style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}i{display:inline-block;height:10px;background:#48c}</style>"]
    most = max((m["rows"] for m in p["rounds"]), default=1) or 1
    for s in p["strata"]:
        out.append(f"<h2>Stratum {s['stratum']}: {html.escape(', '.join(s['heads']))} ({s['kind']})</h2><table><tr><th>line<th>head<th>reads<th>without")
        out += [f"<tr><td>{r['line']}<td>{html.escape(r['head'])}<td>{html.escape(', '.join(r['reads']))}<td>{html.escape(', '.join(r['without']))}" for r in s["rules"]]
        rounds = [m for m in p["rounds"] if set(m["relation"].split(",")) & set(s["heads"])]
        if s["kind"] != "plain" and rounds:
            out.append("</table><table><tr><th>round<th>relation<th>rows<th>s<th>")
            out += [f"<tr><td>{m['round']}<td>{html.escape(m['relation'])}<td>{m['rows']}<td>{m['seconds']}<td><i style='width:{300 * m['rows'] // most}px'></i>" for m in rounds]
        out.append("</table>")
    out += [f"<p>{html.escape(w)}</p>" for w in p["warnings"]]
    return "".join(out)
