"""Why a callable is not taken into the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callshelf.functions.fixed_values import METHOD_DECORATORS
from callshelf.functions.text import SPACE, WORD, is_blank

NOT_STANDALONE = "not_standalone"
NO_DOCSTRING = "no_docstring"

_FIRST_PARAMETER = rf"(?U)def{SPACE}+{WORD}+{SPACE}*\({SPACE}*({WORD}+)"
_DEFINED_NAME = rf"(?U)def{SPACE}+([^\s\x1c-\x1f(]+){SPACE}*\("
_CLASS_NAME = rf"(?U)class{SPACE}+([^\s\x1c-\x1f(:]+){SPACE}*[:(]"


def _definition_is_indented(kind: Column, name: Column, source_code: Column) -> Column:
    """Does the first line that defines ``name`` start with a space or a tab?

    Nearly every text starts with its own definition; only the others (decorators,
    leading text) are split into lines.
    """
    is_class = kind == "class"
    starts_with_it = F.when(
        is_class,
        source_code.startswith(F.concat(F.lit("class "), name, F.lit("(")))
        | source_code.startswith(F.concat(F.lit("class "), name, F.lit(":"))),
    ).otherwise(
        source_code.startswith(F.concat(F.lit("def "), name, F.lit("(")))
        | source_code.startswith(F.concat(F.lit("async def "), name, F.lit("(")))
    )

    def defines(line: Column) -> Column:
        names = F.when(
            is_class, F.regexp_extract_all(line, F.lit(_CLASS_NAME), F.lit(1))
        ).otherwise(F.regexp_extract_all(line, F.lit(_DEFINED_NAME), F.lit(1)))
        return F.array_contains(names, name)

    first = F.get(F.filter(F.split(source_code, "\n"), defines), F.lit(0))
    return F.when(starts_with_it, False).otherwise(F.coalesce(first.rlike("^[ \t]"), F.lit(False)))


def reject_reason(
    kind: Column,
    name: Column,
    signature: Column,
    docstring: Column,
    source_code: Column,
    decorators: Column,
) -> Column:
    """``not_standalone``, ``no_docstring`` or null. The order of the tests counts."""
    marks_method = F.arrays_overlap(
        F.coalesce(decorators, F.array().cast("array<string>")),
        F.array(*[F.lit(d) for d in METHOD_DECORATORS]),
    )
    takes_self = (kind == "function") & F.regexp_extract(signature, _FIRST_PARAMETER, 1).isin(
        "self", "cls"
    )
    return (
        F.when(name == "<lambda>", NOT_STANDALONE)
        .when(is_blank(docstring), NO_DOCSTRING)
        .when(marks_method, NOT_STANDALONE)
        .when(takes_self, NOT_STANDALONE)
        .when(_definition_is_indented(kind, name, source_code), NOT_STANDALONE)
    )
