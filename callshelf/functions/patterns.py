"""Exclude patterns in git's ignore syntax, as one native predicate."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from callshelf.functions.fixed_values import DEFAULT_EXCLUDES

_GLOB = re.compile(
    r"\\(?P<literal>.)"
    r"|\[(?P<negate>[!^]?)(?P<members>\]?[^\]]*)\]"
    r"|(?P<stars>\*+)"
    r"|(?P<one>\?)"
    r"|(?P<plain>.)",
    re.DOTALL,
)


def _glob_regex(segment: str) -> str:
    if segment == "*":
        return "[^/]+"

    def java(match: re.Match[str]) -> str:
        if match["stars"]:
            return "[^/]*"
        if match["one"]:
            return "[^/]"
        if match["members"] is not None:
            members = re.sub(r"[\[\]&~^]", r"\\\g<0>", match["members"])
            return f"(?!/)[{'^' if match['negate'] else ''}{members}]"
        return re.sub(r"\W", r"\\\g<0>", match["literal"] or match["plain"])

    return _GLOB.sub(java, segment)


def pattern_rule(pattern: str) -> tuple[bool, str] | None:
    """(excludes, regex on the relative path), or None for a pattern without effect.

    Comments, blank lines and patterns that make no valid expression have none.
    """
    body = pattern.lstrip() if pattern.endswith("\\ ") else pattern.strip()
    if body in ("", "/") or body.startswith("#"):
        return None
    excludes = not body.startswith("!")
    body = body if excludes else body[1:]
    folders_only = body.endswith("/")
    anchored = "/" in body.rstrip("/")
    segments = body.strip("/").split("/")
    if segments == [""]:
        return None

    regex, slash = ("" if anchored else "(?:.+/)?"), ""
    for segment in segments:
        if segment == "**":
            regex, slash = f"{regex}{slash}(?:.+/)?", ""
        else:
            regex, slash = regex + slash + _glob_regex(segment), "/"
    if segments[-1] == "**":
        regex += "[^/]+"
    regex += "/.*" if folders_only else "(?:/.*)?"
    try:
        re.compile(regex)
    except re.error:
        return None
    return excludes, regex


class ExcludeRules:
    """Default patterns plus the caller's. The last rule that matches decides."""

    def __init__(self, patterns: Iterable[str] = (), *, defaults: bool = True) -> None:
        merged = [*(DEFAULT_EXCLUDES if defaults else ()), *patterns]
        # Of a repeated pattern the last place counts.
        last = list(dict.fromkeys(reversed(merged)))[::-1]
        self.rules = [rule for rule in map(pattern_rule, last) if rule]

    @property
    def has_exceptions(self) -> bool:
        return any(not excludes for excludes, _ in self.rules)

    def matches(self, relative: Column) -> Column:
        """The verdict on one path taken alone."""
        verdict = F.lit(False)
        for excludes, run in groupby(self.rules, key=lambda rule: rule[0]):
            anyone = "|".join(regex for _, regex in run)
            verdict = F.when(relative.rlike(rf"(?s)^(?:{anyone})\z"), F.lit(excludes)).otherwise(
                verdict
            )
        return verdict

    def excludes(self, relative: Column) -> Column:
        """The verdict when an excluded folder hides all below it.

        A pattern covers what lies below its match anyway, so ancestors need a look
        only where an exception (``!pattern``) could bring a file back.
        """
        if not self.has_exceptions:
            return self.matches(relative)
        parts = F.split(relative, "/")
        ancestors = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
        return F.exists(ancestors, self.matches)
