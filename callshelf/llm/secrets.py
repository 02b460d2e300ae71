"""Secret scans as native expressions: fixed rules, then sliding-window entropy.

Two steps, both column expressions, so the scan runs inside Spark's generated code and
Python never sees a text:

* **Rules.** Assignments to a secret-like name, access key ids and long lower-case hex
  strings, each found leftmost and without overlap, matches that fail their length rule
  dropped.
* **Entropy.** Candidates are runs of 20 or more characters of the base64 alphabet. A run
  belongs to the hex class if all its characters are hex digits, else to the base64
  class. A window of 20 characters slides over it; the counts of the characters in the
  window change by one entering and one leaving character a step, and so does the sum
  ``sum(c * log2 c)`` from which the window's Shannon entropy follows. A run whose most
  random window reaches its class's threshold is a secret unless an allow-list rule
  matches it (placeholders, documentation keys, runs of one character).

Spans are code points of the text, end exclusive. Matches of the rules stay as they are;
entropy adds spans that overlap none of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the three rules, in their order.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE_CHARS = 6
ACCESS_LENGTH = 20
HEX_LENGTH = 24
# A maximal run of hex digits of 24 or more is a match of [0-9a-f]+ that passes; a shorter
# run is one that fails. Likewise for access ids: a failing match of AKIA[A-Z0-9]+ holds no
# passing one, since the run it consumes is shorter than 20 from any later start.
ACCESS = "AKIA[A-Z0-9]{%d,}" % (ACCESS_LENGTH - 4)
HEX = "[0-9a-f]{%d,}" % HEX_LENGTH
KINDS = ("assign", "access", "hex", "entropy")

#: Window of the entropy step, and the least length of a candidate.
WINDOW = 20
#: Characters of a candidate; the first 16 are the hex class.
ALPHABET = "0123456789abcdefABCDEF" + "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Least window entropy in bits that marks a secret, by class. Random hex gives about 3.6 in
#: 20 characters, random base64 about 4.0; prose of letters stays below 3.5.
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
#: Candidates that match one of these are not secrets (case-insensitive).
ALLOW = (
    "example", "sample", "dummy", "placeholder", "changeme", "redacted", "your_?api_?key",
    r"(.)\1{7}", "0123456789", "abcdefghij",
)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans of ``kind``.

    The pieces between matches give the starts: match i begins after pieces 0..i and
    matches 0..i-1. Where ``least`` is given, matches whose ``group`` has fewer
    characters are dropped after the search, so they still consume their text.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(found)), F.char_length).alias("gap"),
        F.transform(found, F.char_length).alias("width"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
        .alias("held"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"),
                        (begin + s["width"]).alias("end"))
        keep = s["held"] >= least
        return F.struct(
            (begin + s["width"]).alias("at"),
            F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def _entropy(run: Column) -> Column:
    """Largest Shannon entropy (bits) of a window of ``WINDOW`` characters of ``run``.

    Counts of the window's characters are kept as one array indexed by place in
    ``ALPHABET``; a step adds the entering character and takes away the leaving one, and
    ``sum(c log2 c)`` changes by their two terms only.
    """
    codes = F.transform(F.split(run, "", -1), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    size = len(ALPHABET)

    def f(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    def step(acc: Column, i: Column) -> Column:
        enter = F.element_at(codes, i + 1)
        leave = F.when(i >= WINDOW, F.element_at(codes, i - WINDOW + 1)).otherwise(F.lit(-1))
        ce = F.element_at(acc["c"], enter + 1)
        cl = F.when(leave >= 0, F.element_at(acc["c"], leave + 1)).otherwise(F.lit(0))
        same = enter == leave
        s = F.when(same, acc["s"]).otherwise(
            acc["s"] - f(ce) + f(ce + 1) - F.when(leave >= 0, f(cl) - f(cl - 1)).otherwise(0.0)
        )
        counts = F.when(same, acc["c"]).otherwise(F.transform(
            acc["c"],
            lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0),
        ))
        h = F.lit(math.log2(WINDOW)) - s / WINDOW
        best = F.when(i >= WINDOW - 1, F.greatest(acc["best"], h)).otherwise(acc["best"])
        return F.struct(counts.alias("c"), s.alias("s"), best.alias("best"))

    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("c"),
        F.lit(0.0).alias("s"),
        F.lit(0.0).alias("best"),
    )
    places = F.sequence(F.lit(0), F.char_length(run) - 1)
    return F.aggregate(places, start, step, lambda acc: acc["best"])


def _allowed(run: Column) -> Column:
    return run.rlike("(?i)" + "|".join(f"(?:{rule})" for rule in ALLOW))


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of candidates whose window entropy reaches their class's threshold.

    Candidates that an allow-list rule matches, or that overlap a span of ``base``, are
    left out.
    """
    pattern = "[A-Za-z0-9+/=_-]{%d,}" % WINDOW
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.arrays_zip(_matches(text, pattern, "entropy").alias("span"), runs.alias("run"))

    def secret(s: Column) -> Column:
        run = s["run"]
        hex_class = run.rlike("^[0-9a-fA-F]+$")
        limit = F.when(hex_class, THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
        overlaps = F.exists(
            base, lambda b: (b["start"] < s["span"]["end"]) & (s["span"]["start"] < b["end"])
        )
        return ~_allowed(run) & ~overlaps & (_entropy(run) >= limit)

    return F.transform(F.filter(spans, secret), lambda s: s["span"])


def secret_spans(text: Column) -> Column:
    """All spans of a text, ordered by start, then kind as in ``KINDS``, then end.

    Null reads as empty and gives no span.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    base = F.concat(
        _matches(text, ASSIGN, "assign", group=2, least=ASSIGN_VALUE_CHARS),
        _matches(text, ACCESS, "access"),
        _matches(text, HEX, "hex"),
    )
    every = F.concat(base, entropy_spans(text, base))
    keyed = F.transform(every, lambda s: F.struct(
        s["start"].alias("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
        s["end"].alias("end"),
        s["kind"].alias("kind"),
    ))
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def find_secrets(docs: DataFrame, text: str = "text", column: str = "secrets") -> DataFrame:
    """``docs`` with ``column``: the secret spans of ``text`` (kind, start, end).

    Every row stays, repeated ones too, with all its columns; a column already called
    ``column`` is replaced. Null and empty texts have no spans; long texts are scanned
    whole. Kinds: ``assign``, ``access``, ``hex`` from the rules, ``entropy`` from the
    method. A narrow projection: no shuffle.
    """
    return docs.withColumn(column, secret_spans(F.col(text)))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                 s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; null stays null.

    Spans do not overlap (rules are searched without overlap and entropy spans overlap no
    rule's span); where two kinds share a place, the text is replaced once.
    """
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.lit(1 << 30)

    def step(acc: Column, s: Column) -> Column:
        begin = s["start"] + 1
        kept = source.substr(acc["at"].cast("int"), (begin - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"] + 1).alias("at"),
            F.when(begin >= acc["at"], F.concat(acc["out"], kept, F.lit(mark)))
            .otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(
        secret_spans(F.col(text)), start, step,
        lambda acc: F.concat(acc["out"], source.substr(acc["at"].cast("int"), whole)),
    )
    return docs.withColumn(text, F.when(F.col(text).isNull(), None).otherwise(done))
