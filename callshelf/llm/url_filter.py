"""Allow and block rules on URLs, matched by a bit-parallel wildcard automaton.

Each rule becomes a glob over the canonical URL ``.host SEPARATOR path``: any labels, the
rule's host, the separator, the rule's path, anything. The characters of all globs are bits
of one multiword state. A step over one character advances all patterns at once:

    state = ((state << 1 | starts) & accepts[c]) | (state & stays[c])

``accepts`` has the bits whose character is ``c`` and ``stays`` the wildcards that may take
``c`` and remain. All URLs of a batch step together. A rule fits if its last bit is ever set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callshelf.llm.common import lower_ascii, with_fields

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, pattern: str) -> Rule:
    """``rule("block", "example.com/en/")``. ``*`` in the pattern stands for any characters
    of the host or the path it is in."""
    host, slash, path = pattern.partition("/")
    return Rule(verdict, lower_ascii(host), slash + path)


RULES = (
    rule(ALLOW, "com/"),
    rule(BLOCK, "example.com/en/"),
    rule(ALLOW, "www.example.com/en/"),
    rule(BLOCK, "net/es/"),
    rule(BLOCK, "net/fr/"),
)

#: Beyond all code points; the characters of a pattern that have classes of their own.
_SEPARATOR = 0x110000
_ANY_HOST, _ANY = -1, -2


def host_and_path(url: str | None) -> tuple[str, str]:
    """Both are empty without a ``://``."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return lower_ascii(host), rest[:end]


class ShiftAnd:
    """All globs as bits of ``words`` 64-bit words, lowest bit first."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        symbols: list[int] = []
        starts, ends = [], []
        for one in rules:
            starts.append(len(symbols))
            # any labels before the host, which begins after a dot
            symbols.append(_ANY_HOST)
            symbols.extend(_ANY_HOST if c == "*" else ord(c) for c in "." + one.host)
            symbols.append(_SEPARATOR)
            symbols.extend(_ANY if c == "*" else ord(c) for c in one.path)
            ends.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        # Literal characters have a row of their own; row 0 is any other, row 1 the separator.
        letters = sorted({s for s in symbols if s >= 0 and s != _SEPARATOR})
        self.letters = np.array(letters, dtype=np.int64)
        rows = 2 + len(letters)
        self.accepts = np.zeros((rows, self.words), dtype=np.uint64)
        self.stays = np.zeros((rows, self.words), dtype=np.uint64)
        row_of = {s: i + 2 for i, s in enumerate(letters)} | {_SEPARATOR: 1}
        for i, symbol in enumerate(symbols):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if symbol >= 0:
                self.accepts[row_of[symbol], word] |= bit
                continue
            for row in range(rows):
                if symbol == _ANY or row != 1:
                    self.stays[row, word] |= bit
        # A wildcard takes nothing too: its bit comes with the bit before it.
        wild = [i for i, symbol in enumerate(symbols) if symbol < 0 and i not in starts]
        self.wild = self._bits(wild)
        self.begin = self._bits(starts)
        self.last = [(end // 64, np.uint64(1 << (end % 64))) for end in ends]
        self.open = self._bits(ends)

    def _bits(self, places: Sequence[int]) -> np.ndarray:
        bits = np.zeros(self.words, dtype=np.uint64)
        for i in places:
            bits[i // 64] |= np.uint64(1 << (i % 64))
        return bits

    def _shifted(self, state: np.ndarray) -> np.ndarray:
        moved = state << np.uint64(1)
        moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return moved

    def _with_wildcards(self, state: np.ndarray) -> np.ndarray:
        while True:
            more = state | (self._shifted(state) & self.wild)
            if (more == state).all():
                return state
            state = more

    def rows_of(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each character of all canonical URLs, and where each URL begins."""
        parts = [f".{host}\0{path}" for host, path in zip(hosts, paths)]
        text = "".join(parts).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(text, dtype=np.uint32).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        if not len(self.letters):
            rows = np.zeros(len(points), dtype=np.int64)
        else:
            found = np.searchsorted(self.letters, points).clip(max=len(self.letters) - 1)
            rows = np.where(self.letters[found] == points, found + 2, 0)
        middles = begins[:-1] + 1 + np.array([len(h) for h in hosts], dtype=np.int64)
        rows[middles] = 1  # the separator itself; a NUL of the URL is any other character
        return rows, begins

    def fitting(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Booleans, URLs x rules: does the rule fit the URL?"""
        if not hosts:
            return np.zeros((0, len(self.last)), dtype=bool)
        rows, begins = self.rows_of(hosts, paths)
        lengths = np.diff(begins)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[:-1][order], lengths[order]
        state = np.zeros((len(order), self.words), dtype=np.uint64)
        state[:] = self._with_wildcards(self.begin[None, :])
        met = state & self.open
        running = len(order)
        for step in range(int(lengths[0])):
            while running and lengths[running - 1] <= step:
                running -= 1
            classes = rows[begins[:running] + step]
            now = state[:running]
            now = (self._shifted(now) & self.accepts[classes]) | (now & self.stays[classes])
            now = self._with_wildcards(now)
            state[:running] = now
            met[:running] |= now & self.open
        fits = np.empty((len(order), len(self.last)), dtype=bool)
        for k, (word, bit) in enumerate(self.last):
            fits[order, k] = (met[:, word] & bit) != 0
        return fits


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    default: str = ALLOW,
    url_column: str = "url",
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``, which replace columns of such names.

    A rule fits its host and all subdomains of it, where the path starts with the rule's.
    Of several the longest wins, of equally long ones the first given. Without a fitting
    rule ``rule`` is null and ``verdict`` is ``default``. A null URL, or one without
    ``://``, has an empty host and path and fits no rule. Every row is judged on its own.
    """
    added = ("host", "path", "rule", "verdict")
    taken = {name.lower() for name in added} - {url_column.lower()}
    kept = pages.select(*[pages[c] for c in pages.columns if c.lower() not in taken])
    by_length = sorted(rules, key=lambda r: -len(r.name))  # sorts stably
    schema = with_fields(kept, *[(name, "string") for name in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(by_length)
        names = np.array([r.name for r in by_length] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in by_length] + [default], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [host_and_path(url) for url in batch.column(url_column).to_pylist()]
            hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
            fits = automaton.fitting(hosts, paths)
            fits = np.concatenate((fits, np.ones((len(parts), 1), dtype=bool)), axis=1)
            best = fits.argmax(axis=1)
            columns = [hosts, paths, names[best].tolist(), verdicts[best].tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.string()) for c in columns]],
                [*batch.schema.names, *added],
            )

    return kept.mapInArrow(run, schema)
