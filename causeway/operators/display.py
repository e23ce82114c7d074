"""Reports as text for a terminal (V-01): driver-side formatting of few rows."""

from __future__ import annotations

import re

_HOSTILE = re.compile("[\x00-\x1f\x7f-\x9f؜‎‏‪-‮⁦-⁩]")


def terminal_safe(s: str) -> str:
    return _HOSTILE.sub(lambda m: f"\\u{{{ord(m[0]):x}}}", s)


def one_line(s: str, most: int = 120) -> str:
    flat = " ".join(s.split())
    return terminal_safe(flat[:most] + "…" if len(flat) > most else flat)


def text_report(r: dict | None) -> str:
    """Verdict and risk, then each finding with its path, one line a step."""
    if r is None:
        return "no report"
    head = f"{one_line(r['dist_id'])}: {r['verdict']} (risk {r['risk']:.2f})"
    if r["skipped"]:
        return f"{head}, skipped: {r['skipped']['reason']} ({one_line(r['skipped']['detail'] or '')})"
    out = [head]
    for f in r["findings"]:
        marks = "".join(f", {m}" for m in ("obfuscated", "conditional") if f[m])
        out.append(f"  {f['rule']} {f['severity']}, {f['phase']}, {f['confidence']}, score {f['score']:.2f}{marks}: {one_line(f['message'])}")
        shown: list[str] = []
        for s in f["steps"]:
            line = f"    {one_line(s['path'])}:{s['line']} | {s['kind']} {one_line(s['symbol'] or '')}"
            if not shown or shown[-1] != line:
                shown.append(line)
        out += shown
    return "\n".join(out)


def exit_code(found: list[dict | None]) -> int:
    """V-04: the largest code of any input."""
    return max((3 if r is None else 1 if r["verdict"] != "clean" else 0 for r in found), default=0)
