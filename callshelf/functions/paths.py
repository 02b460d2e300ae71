"""What a file path says about the code in it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callshelf.functions.fixed_values import GENERIC_PARTS, STOP_WORDS, TEST_FOLDERS


def _strings(values: Iterable[str]) -> Column:
    """A constant array; one literal, so that long lists cost nothing to plan."""
    return F.split(F.lit("\n".join(values)), "\n")


def stored_path(path: Column) -> Column:
    """Forward slashes, no slash in front."""
    return F.ltrim(F.translate(path, "\\", "/"), F.lit("/"))


def relative_path(path: Column, base: Column | str) -> Column:
    """``path`` below ``base``; a path elsewhere stays as it is."""
    base = F.lit(base) if isinstance(base, str) else base
    prefix = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(
        path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def is_test(name: Column, path: Column) -> Column:
    """Test code by name, or by any part of its path."""
    return (
        name.startswith("test_")
        | name.endswith("_test")
        | F.arrays_overlap(F.split(path, "/"), _strings(TEST_FOLDERS))
    )


def path_tags(
    path: Column,
    base: Column | str = "/",
    *,
    drop: Iterable[str] = (),
    home_name: str | None = None,
    stop_words: Iterable[str] = STOP_WORDS,
) -> Column:
    """Sorted distinct words of the path below ``base``.

    Generic parts go before ``.py`` is cut off, so ``utils.py`` still gives ``utils``.
    Words that do not start with a letter are dropped; with a word list,
    ``callshelf.operators.tags.without_words`` drops further ones.
    """
    # Whole-string steps: lambdas over parts would leave generated code.
    relative = relative_path(path, base)
    if home_name:
        parts = F.array_except(F.split(relative, "/"), _strings([home_name]))
        relative = F.array_join(parts, "/")
    visible = F.regexp_replace(F.lower(relative), r"(?<![^/])[.~\\][^/]*", "")
    telling = F.array_except(F.split(visible, "/"), _strings([*GENERIC_PARTS, *drop]))
    stems = F.regexp_replace(F.array_join(telling, "/"), r"\.py(?![^/])", "")
    words = F.regexp_extract_all(stems, F.lit(r"(?<![^-_/])\p{L}[^-_/]*"), F.lit(0))
    # array_except returns distinct values
    return F.sort_array(F.array_except(words, _strings(stop_words)))


def tags_json(tags: Column) -> Column:
    return F.to_json(tags)


# JSON's short escapes, the backslash first, for the others bring backslashes in.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ascii_escapes(text: Column) -> Column:
    """``text`` with what is not printable ASCII as ``\\uXXXX``."""
    def written(run: Column) -> Column:
        codes = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        one = (F.char_length(run) == 1) & (F.octet_length(run) < 4)
        return (
            F.when((run >= " ") & (run < "\x7f"), run)
            .when(one, F.concat(F.lit("\\u"), codes))
            .otherwise(F.regexp_replace(codes, "(.{4})", r"\\u$1"))
        )

    runs = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    return F.when(
        text.rlike("[^ -~]"), F.array_join(F.transform(runs, written), "")
    ).otherwise(text)


def tags_json_text(tags: Column) -> Column:
    """The text Python's ``json.dumps`` gives for a list of strings: ``", "`` between items,
    characters outside printable ASCII as ``\\uXXXX`` (beyond the first plane as a surrogate
    pair), a null item as ``null``; a null list gives null."""
    # Whole-string steps: work on single items or characters costs a call for each. Two bytes
    # that no UTF-8 text holds stand for the end of an item and for an item that is null.
    end, null = (F.unhex(F.lit(code)).cast("string") for code in ("FF", "FE"))

    def joined(items: Column) -> Column:
        valid = F.when(F.is_valid_utf8(F.array_join(items, "")), items).otherwise(
            F.transform(items, F.make_valid_utf8))
        text = F.call_function("array_join", valid, end, null)
        for char, short in _SHORT.items():
            text = F.replace(text, F.lit(char), F.lit(short))
        quoted = F.concat(F.lit('"'), F.replace(text, end, F.lit('", "')), F.lit('"'))
        return F.replace(quoted, F.concat(F.lit('"'), null, F.lit('"')), F.lit("null"))

    def written(items: Column) -> Column:
        return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
            F.concat(F.lit("["), _let(joined(items), _ascii_escapes), F.lit("]")))

    return _let(tags, written)
