"""Statements as text: laid out on lines, on one line, and what they are about."""

from __future__ import annotations

import re

from .sql import tokenise

_BREAKS = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION EXCEPT INTERSECT VALUES SET RETURNING JOIN LEFT RIGHT FULL INNER CROSS".split())
_KEYWORDS = _BREAKS | frozenset("SELECT DISTINCT AS ON AND OR NOT IN IS NULL LIKE BETWEEN CASE WHEN THEN ELSE END BY ASC DESC WITH INSERT INTO UPDATE DELETE CREATE TABLE VIEW OVER PARTITION EXISTS ALL OUTER".split())


def minify(sql: str) -> str:
    """Without comments, and with single blanks."""
    out = ""
    for t in tokenise(sql):
        if t.isspace():
            out += "" if not out or out.endswith((" ", "(")) else " "
        else:
            out = (out.rstrip() if t in "),;" else out) + t
    return out.strip()


def beautify(sql: str) -> str:
    """Keywords in capitals, and each clause of the outer query on a line of its own."""
    lines, now, depth, last = [], "", 0, ""
    for t in tokenise(minify(sql)):
        up = t.upper()
        if t in "()":
            depth += 1 if t == "(" else -1
        if depth == 0 and up in _BREAKS and not (up == "JOIN" and last in ("LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER")):
            lines.append(now.strip())
            now = ""
        now += up if up in _KEYWORDS else t
        last = last if t.isspace() else up
    return "\n".join(x for x in [*lines, now.strip()] if x)


def analyse(sql: str) -> dict:
    """Kind of statement, the tables that it names, and what it uses."""
    words = [t for t in tokenise(sql) if not t.isspace()]
    upper = [w.upper() for w in words]
    after = [words[k + 1] for k, w in enumerate(upper[:-1]) if w in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE") and re.fullmatch(r"[A-Za-z_]\w*", words[k + 1])]
    return {"kind": upper[0] if upper else "", "tables": sorted(dict.fromkeys(after)), "joins": upper.count("JOIN"), "has_where": "WHERE" in upper, "has_group": "GROUP" in upper, "parameters": words.count("?")}
