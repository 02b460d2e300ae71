"""Log-probabilities of documents under prediction by partial matching.

The model is a trie of byte contexts with the counts of what followed them in the training
documents. A byte is predicted in the longest context of the trie that ends where it
stands; if it never followed there, an escape (method D: half a count of each symbol known
there) leads to the next shorter context, where the symbols of the longer one are
excluded. Below the empty context all symbols left are alike. Texts begin with start marks
and end with an end symbol, so the probabilities of all texts sum to 1.

Counts cover all training texts, are summed by Spark, and all of them are used. The trie that
is broadcast has the contexts that hold at least ``1 / CONTEXTS`` of all training symbols, so
every order has at most ``CONTEXTS`` of them however large the corpus is. From the trie each
task builds tables of all steps between contexts and of all log-probabilities. Where a rarer
context may apply, the task hands on the window of ``ORDER`` + 1 symbols with the rows it
stands in, and the log-probability of each distinct window comes by a join: from its own
context if the window occurs in training, else from the rarer contexts it ends in and, below
them, the trie.

Beside it stands a unigram score over words. Its vocabulary grows with the corpus, so only
the words that hold at least ``1 / HOT_WORDS`` of all tokens (at most that many) are
broadcast; the others are looked up by a join.

Windows travel in buckets, as packed arrays: one row holds the windows that a task has for a
bucket. Windows that share the last ``NEAR`` symbols of their context share the bucket, so the
bucket alone knows all counts of their contexts of the orders ``NEAR`` to ``ORDER``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callshelf.llm.common import crc32_of, text_slices, texts_of
from callshelf.session import (
    parallelism, release, scratch, shuffles_dropped, small_batches, stage, stage_at,
)

FOLDS = 10
ORDER = 5
CONTEXTS = 1 << 17
HOT_WORDS = 1 << 17
SMOOTHING = 0.1
#: Windows of one context of this order, or of a longer one, are in one bucket.
NEAR = ORDER - 1
#: Buckets for each task of a shuffle: a few, so that tasks are even.
BUCKETS = 4
#: Windows whose counts a task holds before it hands them on.
PARTIAL_GRAMS = 1_000_000
#: Texts, and buckets with all their counts, that a Python step is handed at a time.
TEXT_ROWS, BUCKET_ROWS = 512, 2
#: Entries of a task's partial counts before they are handed on.
PARTIAL_ENTRIES = 400_000
#: Places that need a look-up before a task hands them on.
PARTIAL_PLACES = 2_000_000

SYMBOLS = 257
END = 256


def held_out(id_column) -> F.Column:
    return F.pmod(crc32_of(id_column), F.lit(FOLDS)) == 0


def tokens_of(text: str) -> list[bytes]:
    """Words with A-Z as a-z; the end token is left to the caller."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, ``ORDER`` start marks before and the end after each, and the
    place of the first symbol of each."""
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    begins = np.cumsum(sizes + ORDER + 1) - sizes - 1
    symbols = np.full(int((sizes + ORDER + 1).sum()), END, dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    return symbols, begins


def _coded(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The places that are coded: bytes and ends, not start marks."""
    coded = np.ones(len(symbols), dtype=bool)
    coded[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return np.flatnonzero(coded)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``ORDER`` + 1 symbols as numbers, and how often each occurs."""
    symbols, begins = symbols_of(texts)
    places = _coded(symbols, begins)
    grams = np.zeros(len(symbols), dtype=np.int64)
    for back in range(ORDER, -1, -1):
        grams[ORDER:] = grams[ORDER:] * SYMBOLS + symbols[ORDER - back : len(symbols) - back]
    return np.unique(grams[places], return_counts=True)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def contexts_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ``context * SYMBOLS + next``: total and number of symbols of each context."""
    if not len(keys):
        return counts, counts
    begins = np.flatnonzero(np.diff(keys // SYMBOLS, prepend=-1))
    return np.add.reduceat(counts, begins), np.diff(np.append(begins, len(keys)))


def dealt(grams: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, where its windows are)``."""
    context = (grams // SYMBOLS % SYMBOLS**NEAR).astype(np.uint64)
    own = ((context * _SPREAD >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=buckets)).tolist()
    for bucket, (begin, end) in enumerate(zip([0, *ends], ends)):
        if begin < end:
            yield bucket, order[begin:end]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on: like stands by like, which compresses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    each = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return each.T.copy().view(kind).ravel()


def _numbers(column) -> np.ndarray:
    """The arrays packed in a binary column, one after the other."""
    return np.concatenate([np.empty(0, np.int64), *map(unpacked, column.to_pylist())])


def count_grams(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, grams, counts, total, least)`` over all texts: packed windows, sorted, how
    often each occurs, their sum, and the least total of a context of each order from
    ``NEAR``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(waiting):
            grams, counts = summed(*map(np.concatenate, zip(*waiting)))
            parts = list(dealt(grams, buckets))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket for bucket, _ in parts], pa.int32()),
                    pa.array([packed(grams[at]) for _, at in parts], pa.binary()),
                    pa.array([packed(counts[at]) for _, at in parts], pa.binary()),
                ],
                ["bucket", "grams", "counts"],
            )

        waiting, entries = [], 0
        for batch in text_slices(batches):
            waiting.append(gram_counts(texts_of(batch)))
            entries += len(waiting[-1][0])
            if entries > PARTIAL_GRAMS:
                yield batch_of(waiting)
                waiting, entries = [], 0
        if waiting:
            yield batch_of(waiting)

    def merge(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        grams, counts = summed(_numbers(parts["grams"]), _numbers(parts["counts"]))
        least = []
        for order in range(NEAR, ORDER + 1):
            totals, _ = contexts_of(*summed(grams % SYMBOLS ** (order + 1), counts))
            least.append(int(totals.min()))
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "grams": pa.array([packed(grams)], pa.binary()),
                "counts": pa.array([packed(counts)], pa.binary()),
                "total": pa.array([int(counts.sum())], pa.int64()),
                "least": pa.array([least], pa.list_(pa.int64())),
            }
        )

    partial = texts.mapInArrow(run, "bucket int, grams binary, counts binary")
    return partial.groupBy("bucket").applyInArrow(
        merge, "bucket int, grams binary, counts binary, total bigint, least array<bigint>"
    )


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts, without ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())],
                ["word", "n"],
            )

        counts: Counter = Counter()
        for batch in text_slices(batches):
            for text in texts_of(batch):
                counts.update(tokens_of(text))
            if len(counts) > PARTIAL_ENTRIES:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    partial = texts.mapInArrow(run, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


def context_table(grams: DataFrame, symbols: int, contexts: int, folder: str) -> DataFrame:
    """``(order, context, total, nexts)``, a table in ``folder``; ``nexts`` are ``(next, n)``.

    All contexts of the orders below ``NEAR``, and those of the others that the trie keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(order, keys, counts):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), order, np.int32)),
                    pa.array(keys // SYMBOLS),
                    pa.array(keys % SYMBOLS),
                    pa.array(counts),
                ],
                ["order", "context", "next", "n"],
            )

        def short(waiting):
            keys, counts = map(np.concatenate, zip(*waiting))
            for order in range(NEAR - 1, -1, -1):
                keys, counts = summed(keys % SYMBOLS ** (order + 1), counts)
                yield batch_of(order, keys, counts)

        waiting, entries = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                keys, counts = (_numbers(batch.column(i).slice(row, 1)) for i in (0, 1))
                for order in range(ORDER, NEAR - 1, -1):
                    keys, counts = summed(keys % SYMBOLS ** (order + 1), counts)
                    totals, sizes = contexts_of(keys, counts)
                    kept = np.repeat(totals * contexts >= symbols, sizes)
                    yield batch_of(order, keys[kept], counts[kept])
                waiting.append(summed(keys % SYMBOLS**NEAR, counts))
                entries += len(waiting[-1][0])
                if entries > PARTIAL_GRAMS:
                    yield from short(waiting)
                    waiting, entries = [], 0
        if waiting:
            yield from short(waiting)

    rows = (
        grams.select("grams", "counts")
        .mapInArrow(run, "order int, context bigint, next bigint, n bigint")
        .repartition("order", "context")  # serves both steps below
        .groupBy("order", "context", "next")
        .agg(F.sum("n").alias("n"))
    )
    # at most SYMBOLS entries in each context
    return stage_at(
        rows.groupBy("order", "context").agg(
            F.sum("n").alias("total"), F.collect_list(F.struct("next", "n")).alias("nexts")
        ),
        folder,
    )


def kept_counts(kept: DataFrame) -> dict[int, np.ndarray]:
    """By order: rows ``(context, next, n)`` of the contexts of the trie, sorted."""
    found = kept.select("order", "context", F.explode("nexts").alias("e")).select(
        "order", "context", "e.next", "e.n"
    )
    found = found.toArrow().to_pandas().sort_values(["order", "context", "next"])
    return {
        order: found.loc[found["order"] == order, ["context", "next", "n"]].to_numpy(np.int64)
        for order in range(ORDER + 1)
    }


class Automaton:
    """Tables over contexts (states) and symbols: the state after, and log10 probabilities.

    Symbols that were never seen are alike everywhere and share the last column.
    """

    def __init__(
        self, counts: dict[int, np.ndarray], order: int = ORDER, cut: frozenset[int] = frozenset()
    ) -> None:
        """``cut`` are the orders of which some contexts are not in ``counts``."""
        levels = [np.unique(counts[k][:, 0]) for k in range(order + 1)]
        if not len(levels[0]):  # nothing was learned
            levels[0] = np.zeros(1, dtype=np.int64)
        known = np.unique(counts[0][:, 1])
        self.order, self.width = order, len(known) + 1
        self.column = np.full(SYMBOLS, len(known), dtype=np.int32)
        self.column[known] = np.arange(len(known))
        firsts = np.cumsum([0, *map(len, levels)])
        self.firsts = firsts[:-1]
        following = np.zeros((int(firsts[-1]), self.width), dtype=np.int32)
        logs = np.zeros((int(firsts[-1]), self.width), dtype=np.float32)
        rest_above = n_above = None
        for k, contexts in enumerate(levels):
            rows = counts[k]
            n = np.zeros((len(contexts), self.width))
            if len(rows):
                n[np.searchsorted(contexts, rows[:, 0]), self.column[rows[:, 1]]] = rows[:, 2]
            if k == 0:
                # below the empty context all symbols never seen are alike
                unseen = np.where(n > 0, 0.0, 1.0 / max(1, SYMBOLS - len(known)))
                rest, steps = unseen, np.zeros((1, self.width), dtype=np.int64)
            else:
                parent = np.searchsorted(levels[k - 1], contexts % SYMBOLS ** (k - 1))
                above = n_above[parent]
                # what the shorter context says of the symbols that are new here
                rest = self._predicted(
                    np.where(n > 0, 0.0, above), above, rest_above[parent]
                )
                steps = following[firsts[k - 1] + parent].astype(np.int64)
            here = slice(firsts[k], firsts[k + 1])
            with np.errstate(divide="ignore"):
                logs[here] = np.log10(self._predicted(n, n, rest))
            # the state after: the child, or what the shorter context leads to
            if k < order and len(levels[k + 1]):
                wanted = contexts[:, None] * SYMBOLS + np.append(known, 0)
                at = np.searchsorted(levels[k + 1], wanted).clip(max=len(levels[k + 1]) - 1)
                child = levels[k + 1][at] == wanted
                child[:, -1] = False
                steps = np.where(child, firsts[k + 1] + at, steps)
            following[here] = steps
            rest_above, n_above = rest, n
        self.following, self.logs = following.ravel(), logs.ravel()
        # where a context one longer may exist that is not here
        self.open = np.repeat([k + 1 in cut for k in range(order + 1)], [*map(len, levels)])

    @staticmethod
    def _predicted(n: np.ndarray, all_n: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Probabilities from the counts ``n`` and, after an escape, from ``rest``.

        ``all_n`` are the counts before exclusion: its symbols get nothing from ``rest``.
        Each symbol gives half a count to the escape (method D); no escape is needed where
        all symbols there are have been seen.
        """
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        complete = (all_n > 0).sum(axis=1, keepdims=True) == SYMBOLS
        given = np.where(complete, 0.0, 0.5)
        below = np.maximum(total, 1)
        escape = np.where(total > 0, given * kinds / below, 1.0)
        return np.where(
            n > 0, (n - given) / below, np.where(all_n > 0, 0.0, escape * rest)
        )

    def scores(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        return self.walked(texts)[0]

    def walked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text without its open places, and of each of these the
        window of ``order`` + 1 symbols and the number of its text."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        symbols, begins = symbols_of(texts)
        columns = self.column[symbols]
        state = np.zeros(len(symbols) - self.order, dtype=np.int32)
        for back in range(self.order, 0, -1):  # the last symbols decide the state
            passed = columns[self.order - back : len(symbols) - back]
            state = self.following[state * self.width + passed]
        logs = np.zeros(len(symbols))
        logs[self.order :] = self.logs[state * self.width + columns[self.order :]]
        marks = (begins[:, None] - np.arange(1, self.order + 1)).ravel()
        logs[marks] = 0.0
        is_open = np.zeros(len(symbols), dtype=bool)
        is_open[self.order :] = self.open[state]
        is_open[marks] = False
        places = np.flatnonzero(is_open)
        logs[places] = 0.0
        grams = np.zeros(len(places), dtype=np.int64)
        for back in range(self.order, -1, -1):
            grams = grams * SYMBOLS + symbols[places - back]
        rows = np.searchsorted(begins, places, "right") - 1
        return np.add.reduceat(logs, begins), grams, rows

    def order_after(self, gram: int) -> int:
        """The order of the longest context here that the last symbol of a window stands in."""
        state = 0
        for back in range(self.order, 0, -1):
            symbol = gram // SYMBOLS**back % SYMBOLS
            state = int(self.following[state * self.width + self.column[symbol]])
        return int(np.searchsorted(self.firsts, state, "right")) - 1


def predicted_log(symbol: int, contexts: Iterator[dict[int, int]]) -> float:
    """log10 probability of a symbol from the counts in its contexts, the longest first."""
    reached, above = 1.0, {}
    for counts in contexts:
        given = 0.0 if len(counts) == SYMBOLS else 0.5
        left = [n for other, n in counts.items() if other not in above]
        total = sum(left)
        if symbol in counts:
            return float(np.log10(reached) + np.log10((counts[symbol] - given) / total))
        if total:
            reached *= given * len(left) / total
        above = counts
    return float(np.log10(reached / max(1, SYMBOLS - len(above))))


_automata: dict[str, Automaton] = {}


def _automaton(name: str, model: Broadcast) -> Automaton:
    """One set of tables at a time in each Python worker."""
    if name not in _automata:
        _automata.clear()
        counts, cut = model.value
        _automata[name] = Automaton(counts, cut=cut)
    return _automata[name]


def asked_windows(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """What the buckets know of the windows ``(flush, bucket, grams)``. Three kinds of rows:

    ``(flush, bucket, logs)``: packed log-probabilities in order, NaN for windows that do not
    occur in training; ``(flush, bucket, at, gram)``: each of these, and where it stands;
    ``(gram, order, nexts)``: the contexts of the orders from ``NEAR`` of each distinct one,
    and a row without order.
    """
    nexts_type = pa.list_(pa.struct([("next", pa.int64()), ("n", pa.int64())]))
    fields = {
        "flush": pa.int64(), "bucket": pa.int32(), "logs": pa.binary(), "at": pa.int32(),
        "gram": pa.int64(), "order": pa.int32(), "nexts": nexts_type,
    }

    def rows_of(n: int, **columns) -> pa.Table:
        return pa.table({k: columns.get(k, pa.nulls(n, t)) for k, t in fields.items()})

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        grams, counts = _numbers(known["grams"]), _numbers(known["counts"])
        totals, sizes = contexts_of(grams, counts)
        given = np.where(sizes == SYMBOLS, 0.0, 0.5)
        # one more, for windows beyond the last
        logs = np.append(
            np.log10((counts - np.repeat(given, sizes)) / np.repeat(totals, sizes)), np.nan
        )
        own = np.append(grams, -1)
        parts, missing = [], [np.empty(0, np.int64)]
        for flush, windows_of in zip(asked["flush"].to_pylist(), asked["grams"].to_pylist()):
            wanted = unpacked(windows_of)
            at = np.searchsorted(grams, wanted)
            known_here = own[at] == wanted
            values = np.where(known_here, logs[at], np.nan)
            parts.append(
                rows_of(
                    1, flush=pa.array([flush]), bucket=pa.array([bucket], pa.int32()),
                    logs=pa.array([packed(values)], pa.binary()),
                )
            )
            miss = np.flatnonzero(~known_here)
            if len(miss):
                missing.append(wanted[miss])
                parts.append(
                    rows_of(
                        len(miss), flush=pa.array(np.full(len(miss), flush)),
                        bucket=pa.array(np.full(len(miss), bucket, np.int32)),
                        at=pa.array(miss.astype(np.int32)), gram=pa.array(wanted[miss]),
                    )
                )
        novel = np.unique(np.concatenate(missing))
        parts.append(rows_of(len(novel), gram=pa.array(novel)))
        for order in range(NEAR, ORDER + 1) if len(novel) else ():
            keys, n = summed(grams % SYMBOLS ** (order + 1), counts)
            context = novel // SYMBOLS % SYMBOLS**order * SYMBOLS
            begins, ends = np.searchsorted(keys, context), np.searchsorted(keys, context + SYMBOLS)
            has = ends > begins
            sizes = (ends - begins)[has]
            offsets = np.cumsum(np.append(0, sizes))
            each = np.repeat(begins[has] - offsets[:-1], sizes) + np.arange(offsets[-1])
            entries = pa.StructArray.from_arrays(
                [pa.array(keys[each] % SYMBOLS), pa.array(n[each])], ["next", "n"]
            )
            parts.append(
                rows_of(
                    len(sizes), gram=pa.array(novel[has]),
                    order=pa.array(np.full(len(sizes), order, np.int32)),
                    nexts=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries),
                )
            )
        return pa.concat_tables(parts)

    return windows.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(
        run,
        "flush bigint, bucket int, logs binary, at int, gram bigint, order int,"
        " nexts array<struct<next:bigint,n:bigint>>",
    )


def rests(places: DataFrame, logs: DataFrame) -> DataFrame:
    """``(row, rest)``: the sum over the open places of each row.

    ``places(flush, bucket, base, times, rows)`` says in which rows the windows stand, and
    ``logs(flush, bucket, logs, at, log)`` has their packed log-probabilities and, one by
    one, those of the windows that were not learned. All places of a row are in one flush.
    """

    def run(key: tuple[pa.Scalar, ...], places: pa.Table, logs: pa.Table) -> pa.Table:
        values = {
            bucket: unpacked(found, np.float64)
            for bucket, found in zip(logs["bucket"].to_pylist(), logs["logs"].to_pylist())
            if found is not None
        }
        single = logs.filter(logs["at"].is_valid())
        for bucket, at, log in zip(*(single[c].to_pylist() for c in ("bucket", "at", "log"))):
            values[bucket][at] = log
        base, rows, each = 0, [], []
        for bucket, first, times, numbers in zip(
            *(places[c].to_pylist() for c in ("bucket", "base", "times", "rows"))
        ):
            base, times = first, unpacked(times, np.int32)
            wide = len(numbers) != 2 * int(times.sum())
            rows.append(np.frombuffer(numbers, np.int32 if wide else np.uint16))
            each.append(np.repeat(values[bucket], times))
        rows = np.concatenate(rows)
        sums = np.bincount(rows, weights=np.concatenate(each))
        there = np.flatnonzero(np.bincount(rows))
        return pa.table({"row": pa.array(base + there), "rest": pa.array(sums[there])})

    return places.groupBy("flush").cogroup(logs.groupBy("flush")).applyInArrow(
        run, "row bigint, rest double"
    )


def window_logs(
    windows: DataFrame, near: DataFrame, rare: DataFrame, name: str, model: Broadcast
) -> DataFrame:
    """``(gram, log)`` of distinct windows ``(gram)`` that do not occur in training.

    ``near(gram, order, nexts)`` has their contexts of the orders from ``NEAR``, ``rare`` the
    shorter contexts that the model does not have.
    """

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, model)
        for batch in batches:
            grams, orders = [], []
            for gram in batch.column(0).to_pylist():
                more = range(automaton.order_after(gram) + 1, NEAR)
                grams += [gram] * len(more)
                orders += more
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), pa.array(orders, pa.int32())], ["gram", "order"]
            )

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.value[0]
        cache: dict[tuple[int, int], dict[int, int]] = {}

        def kept(order: int, context: int) -> dict[int, int]:
            if (order, context) not in cache:
                rows = counts[order]
                begin, end = np.searchsorted(rows[:, 0], [context, context + 1])
                cache[order, context] = dict(rows[begin:end, 1:].tolist())
            return cache[order, context]

        def known_contexts(gram: int, found: list) -> Iterator[dict[int, int]]:
            own = {c["order"]: {e["next"]: e["n"] for e in c["nexts"]} for c in found or ()}
            for order in range(ORDER, -1, -1):
                known = own.get(order) or kept(order, gram // SYMBOLS % SYMBOLS**order)
                if known:
                    yield known

        for batch in batches:
            grams = batch.column(0).to_pylist()
            found = batch.column(1).to_pylist()
            values = [predicted_log(g % SYMBOLS, known_contexts(g, c)) for g, c in zip(grams, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64())], ["gram", "log"]
            )

    # Spark's powers are doubles, exact up to 257**5
    context = F.pmod(F.floor(F.col("gram") / SYMBOLS), F.pow(F.lit(SYMBOLS), "order").cast("bigint"))
    found = (
        windows.mapInArrow(longer, "gram bigint, order int")
        .withColumn("context", context)
        .join(rare.select("order", "context", "nexts"), ["order", "context"])
        .select("gram", "order", "nexts")
        .unionByName(near)
        .groupBy("gram")
        .agg(F.collect_list(F.struct("order", "nexts")).alias("found"))  # at most ORDER
    )
    return windows.join(found, "gram", "left").mapInArrow(logs, "gram bigint, log double")


def score_documents(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    contexts: int = CONTEXTS, hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row.

    Every tenth id by hash is held out from learning. A null text is an empty one, of which
    only the end is scored; a null id is held out. Repeated rows are learned from and scored
    each. Other columns play no part. With no training rows all symbols are alike and no
    token is known; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark), small_batches(spark, TEXT_ROWS):
        return _scored(docs, id_column, text_column, contexts, hot_words)


def _scored(
    docs: DataFrame, id_column: str, text_column: str, contexts: int, hot_words: int
) -> DataFrame:
    spark = docs.sparkSession
    buckets = BUCKETS * parallelism(spark)
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    training = narrow.where(~held_out(F.col("id"))).select("text")
    ends = training.count()
    words = stage(count_words(training), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = (sums["n"] or 0) + ends
    distinct = sums["v"] + bool(ends)
    bottom = float(np.log10(total + SMOOTHING * (distinct + 1)))
    hot = words.where(F.col("c") * hot_words >= total).collect() if total else []
    hot_shared = spark.sparkContext.broadcast({bytes(row["word"]): row["c"] for row in hot})
    folder = scratch(spark, "grams")
    grams = stage_at(count_grams(training, buckets), folder)
    facts = grams.agg(
        F.sum("total").alias("symbols"),
        *[F.min(F.col("least")[i]).alias(str(NEAR + i)) for i in range(ORDER - NEAR + 1)],
    ).first()
    symbols = facts["symbols"] or 0
    contexts_folder = scratch(spark, "contexts")
    with small_batches(spark, BUCKET_ROWS):
        table = context_table(grams, symbols, contexts, contexts_folder)
    is_rare = F.col("total") * F.lit(contexts) < symbols
    rare = table.where(is_rare)
    cut = frozenset(
        [row["order"] for row in rare.select("order").distinct().collect()]
        + [k for k in range(NEAR, ORDER + 1) if symbols and facts[str(k)] * contexts < symbols]
    )
    model = spark.sparkContext.broadcast((kept_counts(table.where(~is_rare)), cut))
    end_log = float(np.log10(ends + SMOOTHING))
    name = uuid.uuid4().hex

    kind = narrow.schema["id"].dataType.simpleString()
    fields = (
        f"id {kind}, n_tokens bigint, hot_known bigint, hot_sum double, score double,"
        " tail array<struct<word:binary,n:bigint>>, row bigint,"
        " flush bigint, bucket int, base bigint, grams binary, times binary, rows binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, model)
        counts = hot_shared.value
        logs = {word: float(np.log10(c + SMOOTHING)) for word, c in counts.items()}
        known_word = logs.get
        first, passed = TaskContext.get().partitionId() << 33, 0
        flush, base = first, 0
        open_grams, open_rows, waiting = [], [], 0
        tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        kinds = [None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail_type, pa.int64()]
        kinds += [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = "id n_tokens hot_known hot_sum score tail row".split()
        names += "flush bucket base grams times rows".split()

        def of_windows() -> pa.RecordBatch:
            """Each distinct window of the waiting places, and the rows of its places."""
            grams, rows = np.concatenate(open_grams), np.concatenate(open_rows) - base
            by_gram = np.argsort(grams, kind="stable")
            grams = grams[by_gram]
            rows = rows[by_gram].astype(np.uint16 if passed - base <= 1 << 16 else np.int32)
            begins = np.flatnonzero(np.diff(grams, prepend=-1))
            grams, times = grams[begins], np.diff(np.append(begins, len(grams))).astype(np.int32)
            parts = list(dealt(grams, buckets))
            columns = [[], [], []]
            for _, at in parts:
                sizes = times[at]
                skipped = begins[at] - (np.cumsum(sizes) - sizes)
                each = np.repeat(skipped, sizes) + np.arange(int(sizes.sum()))
                found = packed(grams[at]), packed(sizes), rows[each].tobytes()
                for column, value in zip(columns, found):
                    column.append(value)
            n = len(parts)
            own = [np.full(n, flush), [bucket for bucket, _ in parts], np.full(n, first + base)]
            filled = [pa.array(values, kind) for values, kind in zip([*own, *columns], kinds[7:])]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind) for kind in kinds[:7]] + filled, names
            )

        for batch in text_slices(batches):
            kinds[0] = batch.schema.field(0).type
            texts = texts_of(batch)
            n_tokens, n_known, sums, tails = [], [], [], []
            for text in texts:
                tokens = tokens_of(text)
                found = list(map(known_word, tokens))
                tail = Counter(t for t, log in zip(tokens, found) if log is None)
                in_tail = sum(tail.values())
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(tokens) - in_tail + bool(ends))
                sums.append(sum(filter(None, found)) + end_log)
                tails.append([{"word": word, "n": n} for word, n in tail.items()])
            scores, grams, rows = automaton.walked(texts)
            own = [
                n_tokens, n_known, sums, scores, tails, first + passed + np.arange(len(texts))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(values, kind) for values, kind in zip(own, kinds[1:7])]
                + [pa.nulls(len(texts), kind) for kind in kinds[7:]],
                names,
            )
            if len(grams):
                open_grams.append(grams)
                open_rows.append(rows + passed)
                waiting += len(grams)
            passed += len(texts)
            if waiting > PARTIAL_PLACES:
                yield of_windows()
                flush, base = flush + 1, passed
                open_grams, open_rows, waiting = [], [], 0
        if waiting:
            yield of_windows()

    both = stage(narrow.mapInArrow(run, fields), "scored")
    rows = both.where("row is not null").drop(
        "flush", "bucket", "base", "grams", "times", "rows"
    )
    count = F.coalesce("c", F.lit(0))
    tail = (
        rows.select("row", F.explode("tail").alias("t"))
        .select("row", "t.word", "t.n")
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10(count + SMOOTHING)).alias("sum"),
        )
    )
    result = rows.drop("tail").join(tail, "row", "left")
    if cut:
        places = both.where("flush is not null")
        answers = stage(
            asked_windows(
                places.select("flush", "bucket", "grams"), grams.select("bucket", "grams", "counts")
            ),
            "windows",
        )
        release(spark, folder)
        # only texts held out have windows that were not learned
        novel = answers.where("flush is null").select("gram", "order", "nexts")
        near = novel.where("order is not null")
        novel = novel.where("order is null").select("gram")
        more = stage(window_logs(novel, near, rare, name, model), "windows")
        release(spark, contexts_folder)
        single = answers.where("flush is not null and at is not null").join(more, "gram")
        logs = (
            answers.where("flush is not null and logs is not null")
            .select("flush", "bucket", "logs", "at", F.lit(None).cast("double").alias("log"))
            .unionByName(single.select("flush", "bucket", "logs", "at", "log"))
        )
        places = places.select("flush", "bucket", "base", "times", "rows")
        looked_up = stage(rests(places, logs), "rests")
        result = result.join(looked_up, "row", "left")
    else:
        result = result.withColumn("rest", F.lit(0.0))
    none = F.lit(0)
    return result.select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", none)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (
            F.col("hot_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)
        ).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
