"""The per-file helper of the extraction job: Python text to top-level definitions.

Only the syntax tree needs Python. The helper returns the raw pieces of each
definition; types, signatures, verdicts and identifiers are Spark expressions on them.
"""

from __future__ import annotations

import ast
from bisect import bisect_left
from collections.abc import Iterator
from textwrap import dedent
from typing import Any

_KEYWORDS = {
    ast.FunctionDef: "def",
    ast.AsyncFunctionDef: "async def",
    ast.ClassDef: "class",
}


def expression_text(node: ast.expr) -> str:
    """Expression as shown in signatures and decorators.

    Names, dotted names, calls, lists and constants are written out plainly (text
    constants always in single quotes, without escapes); the rest is ``ast.unparse``.
    """
    if isinstance(node, ast.Constant):
        return f"'{node.value}'" if isinstance(node.value, str) else str(node.value)
    if isinstance(node, ast.Attribute):
        return expression_text(node.value) + "." + node.attr
    if isinstance(node, ast.List):
        return "[" + ", ".join(map(expression_text, node.elts)) + "]"
    if isinstance(node, ast.Call):
        given = [expression_text(value) for value in node.args]
        given += [f"{kw.arg}={expression_text(kw.value)}" for kw in node.keywords]
        return f"{expression_text(node.func)}({', '.join(given)})"
    return ast.unparse(node)


def _parameters(args: ast.arguments) -> list[str]:
    """Parameters in order of appearance; positional-only ones are not shown."""
    starred = [
        *(("", arg) for arg in args.args),
        ("*", args.vararg),
        *(("", arg) for arg in args.kwonlyargs),
        ("**", args.kwarg),
    ]
    return [
        star + arg.arg + (f": {expression_text(arg.annotation)}" if arg.annotation else "")
        for star, arg in starred
        if arg is not None
    ]


def _yields(node: ast.AST, lines_with_yield: list[int]) -> bool:
    """Is there a ``yield`` anywhere below? Trees are walked only where the word occurs."""
    at = bisect_left(lines_with_yield, node.lineno)
    if at == len(lines_with_yield) or lines_with_yield[at] > node.end_lineno:
        return False
    return any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in ast.walk(node))


def definitions(source: str) -> Iterator[dict[str, Any]]:
    """Functions and classes directly in the module body. Raises if it does not parse."""
    if not source.strip():
        return
    lines = source.splitlines()
    lines_with_yield = [
        number for number, line in enumerate(source.split("\n"), 1) if "yield" in line
    ]
    for node in ast.parse(source).body:
        keyword = _KEYWORDS.get(type(node))
        if keyword is None:
            continue
        is_class = keyword == "class"
        first = node.decorator_list[0].lineno if node.decorator_list else node.lineno
        text = "\n".join(lines[first - 1 : node.end_lineno])
        # ast.get_docstring(clean=True) would strip more than wanted
        docstring = ast.get_docstring(node, clean=False)
        returns = None if is_class else node.returns
        yield {
            "line_number": first,
            "keyword": keyword,
            "name": node.name,
            "parts": [expression_text(b) for b in node.bases]
            if is_class
            else _parameters(node.args),
            "returns": expression_text(returns) if returns else None,
            "has_yield": keyword == "def" and _yields(node, lines_with_yield),
            "docstring": None if docstring is None else dedent(docstring).strip("\n"),
            "source_code": text,
            "decorators": [expression_text(d) for d in node.decorator_list],
        }
