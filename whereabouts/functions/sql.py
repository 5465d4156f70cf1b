"""SQL text for expressions that would otherwise take thousands of calls to build."""

from __future__ import annotations


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"
