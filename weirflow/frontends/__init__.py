"""Frontends: source text to the tables of a program (LOW-01..24, SRC-07..09, UDF-02).

A frontend takes a path and its text and returns the program's parts as plain
lists (see ``schema``). It runs in the executors, once a file; what goes wrong
in one file becomes that file's error.
"""

from __future__ import annotations

from collections.abc import Callable

from . import lexical, python_ast, script

Frontend = Callable[[str, str], dict]

FRONTENDS: dict[str, Frontend] = {
    "python": python_ast.lower,
    "javascript": script.lower, "typescript": script.lower, "vue": script.lower, "go": lexical.lower, "rust": lexical.lower, "c": lexical.lower,
}
#: Languages whose frontend takes keywords that facts teach.
TAUGHT = ("go", "rust", "c")
