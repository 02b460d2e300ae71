"""BPE by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is the BPE result exactly if
each two tokens side by side are what BPE makes of their joined text (a lone token: of its
own), because merges act on neighbours only. All pairs of a batch of new words are looked
up at once in the sorted table of judged pairs; each new pair is judged once by
merging. Only words with a failing pair are merged exactly.

Words are matched, verified and merged as columns of arrays, many at a time; very long
ones one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from callshelf.llm.common import text_slices, texts_of, with_fields

VOCABULARY = "word_bpe_49k.json"
#: Entries of the caches of a Python worker; a full one starts anew.
CACHED_WORDS = 600_000
CACHED_PAIRS = 2_000_000
#: Words of more bytes are encoded one by one.
SHORT_WORD = 32

#: The words of lower-case Latin-1 text, as the vocabulary's expression splits them: letters,
#: single numbers, runs of other characters. `findall` is much faster without properties.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORDS = re.compile(
    f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+|[{_NUMBERS}]"
).findall
_NONE = np.int64(1) << 62
_MASK = (1 << 64) - 1


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table:
    """A fixed map of 64-bit keys to numbers, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.keys = np.full(size + 64, _MASK, dtype=np.uint64)  # no key is this
        self.values = np.full(size + 64, _NONE, dtype=np.int64)
        keys = keys.astype(np.uint64)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slots = self._slots(keys[todo]) + step
            free = self.values[slots] == _NONE
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]] = keys[todo[put]]
            self.values[slots[put]] = values[todo[put]]
            todo, step = todo[~put], step + 1
        self.probes = step

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, ``_NONE`` where there is none."""
        keys = keys.astype(np.uint64, copy=False)
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        for _ in range(1, self.probes):
            slots = slots + 1
            np.copyto(found, self.values[slots], where=self.keys[slots] == keys)
        return found


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where it prints, else the next one from U+0100 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {byte: chr(byte) for byte in printing}
    others = (byte for byte in range(256) if byte not in letters)
    return letters | {byte: chr(256 + n) for n, byte in enumerate(others)}


class SpeculativeBPE:
    """Encoder and decoder of a ``tokenizers`` file of the word BPE kind: pieces of a regular
    expression, byte letters, an end-of-word suffix, no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.n_ids
        for token, number in chain(vocab.items(), self.special.items()):
            self.tokens[number] = token
        tool = Tokenizer.from_file(path)
        self._normalize = tool.normalizer.normalize_str
        self._split = tool.pre_tokenizer.pre_tokenize_str
        self._special_split = (
            re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
            if self.special
            else None
        )
        self._byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        # bytes and kind of each token; tokens of a word's end are a vocabulary of their own
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.spelled: list[tuple[bytes, bool]] = [(b"", False)] * self.n_ids
        for token, number in vocab.items():
            if token in self.special:
                continue
            ends = token.endswith(suffix)
            text = bytes(map(self._byte_of.__getitem__, token.removesuffix(suffix)))
            (self.final if ends else self.inner)[text] = number
            self.spelled[number] = (text, ends)
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] * self.n_ids + vocab[right]
            merges[key] = (rank, vocab[left + right])
        self.merges: dict[int, tuple[int, int]] = merges
        self.merge_table = _Table(
            np.fromiter(merges, np.int64, len(merges)),
            np.array([rank << 20 | made for rank, made in merges.values()], dtype=np.int64),
        )
        self.first_symbol = np.array([self.inner[bytes([b])] for b in range(256)], np.int64)
        self.last_symbol = np.array([self.final[bytes([b])] for b in range(256)], np.int64)
        # Longest token by its first two bytes, and all tokens by a hash of their bytes.
        self.longest = np.ones(1 << 16, dtype=np.int64)
        self.powers = np.ones(256, dtype=np.uint64)
        for i in range(1, 256):
            self.powers[i] = int(self.powers[i - 1]) * int(_BASE) & _MASK
        hashes, numbers = [], []
        for vocabulary, salt in ((self.inner, 0), (self.final, _ENDS)):
            for text, number in vocabulary.items():
                if len(text) > 1:
                    start = text[0] << 8 | text[1]
                    self.longest[start] = max(self.longest[start], len(text))
                value = 0
                for byte in text:
                    value = (value * int(_BASE) + byte + 1) & _MASK
                hashes.append(value ^ int(salt))
                numbers.append(number)
        self.spellings = _Table(np.array(hashes, np.uint64), np.array(numbers, np.int64))
        self.numbers = list(range(self.n_ids))  # one object for each id
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs = np.empty(0, dtype=np.int64)
        self.pair_fits = np.empty(0, dtype=bool)

    # -- exact merging ------------------------------------------------------

    def merge(self, text: bytes) -> list[int]:
        """Apply the merge of lowest rank, leftmost first, until none applies."""
        n, merges = self.n_ids, self.merges
        symbols = [self.inner[text[i : i + 1]] for i in range(len(text))]
        symbols[-1] = self.final[text[-1:]]
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0:
                found = merges.get(symbols[left] * n + symbols[right])
                if found:
                    heapq.heappush(heap, (found[0], left, symbols[left], symbols[right]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, left, was_left, was_right = heapq.heappop(heap)
            right = after[left]
            if right < 0 or symbols[left] != was_left or symbols[right] != was_right:
                continue
            symbols[left] = merges[was_left * n + was_right][1]
            symbols[right] = -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            after[right] = -1
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [symbol for symbol in symbols if symbol >= 0]

    def _symbols(self, letters: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        symbols = self.first_symbol[letters]
        rows = np.arange(len(sizes))
        last = letters[rows, sizes - 1]
        symbols[rows, sizes - 1] = np.where(ends, self.last_symbol[last], self.first_symbol[last])
        symbols[np.arange(letters.shape[1]) >= sizes[:, None]] = -1
        return symbols

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ranks = self.merge_table.get(left * self.n_ids + right)
        return np.where((left < 0) | (right < 0), _NONE, ranks)

    def merge_many(self, symbols: np.ndarray) -> np.ndarray:
        """``merge`` for the rows of a matrix padded with -1; in place."""
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(symbols))
        work, columns = symbols.copy(), np.arange(symbols.shape[1])
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            best = ranks[here, at]
            going = best != _NONE
            if not going.all():
                symbols[rows[~going]] = work[~going]
                rows, work, ranks, at = rows[going], work[going], ranks[going], at[going]
                best, here = best[going], np.arange(len(rows))
                if not len(rows):
                    break
            # the row closes up behind the merged pair
            take = columns + (columns > at[:, None])
            padded = np.concatenate((work, np.full((len(rows), 1), -1)), axis=1)
            work = np.take_along_axis(padded, take, axis=1)
            work[here, at] = best & ((1 << 20) - 1)
            padded = np.concatenate((ranks, np.full((len(rows), 1), _NONE)), axis=1)
            ranks = np.take_along_axis(padded, take[:, :-1], axis=1)
            follow = np.minimum(at + 1, work.shape[1] - 1)
            right = np.where(at + 1 < work.shape[1], work[here, follow], -1)
            inside = at < ranks.shape[1]
            fresh = self._ranks(work[here, at], right)
            ranks[here[inside], at[inside]] = fresh[inside]
            led = here[at > 0]
            ranks[led, at[led] - 1] = self._ranks(work[led, at[led] - 1], work[led, at[led]])
        return symbols

    # -- speculation --------------------------------------------------------

    def propose(self, text: bytes) -> list[int]:
        """Longest match from the left; the last token carries the end of the word."""
        tokens, start, end = [], 0, len(text)
        while start < end:
            reach = 1
            if start + 1 < end:
                reach = int(self.longest[text[start] << 8 | text[start + 1]])
            stop = min(end, start + reach)
            while True:
                found = (self.final if stop == end else self.inner).get(text[start:stop])
                if found is not None:
                    break
                stop -= 1
            tokens.append(found)
            start = stop
        return tokens

    def propose_many(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``propose`` for the rows of a matrix of bytes; tokens padded with -1."""
        rows, width = letters.shape
        hashes = np.zeros((rows, width + 1), dtype=np.uint64)
        for i in range(width):
            hashes[:, i + 1] = hashes[:, i] * _BASE + letters[:, i] + np.uint64(1)
        tokens = np.full((rows, width), -1, dtype=np.int64)
        live, start, step = np.arange(rows), np.zeros(rows, dtype=np.int64), 0
        wide = np.concatenate((letters, np.zeros((rows, 1), letters.dtype)), axis=1).astype(np.int64)
        while len(live):
            left = sizes[live] - start[live]
            first = start[live]
            reach = self.longest[wide[live, first] << 8 | wide[live, first + 1]]
            length = np.minimum(reach, left)
            found = np.full(len(live), -1, dtype=np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                row, begin, size = live[open_], first[open_], length[open_]
                value = hashes[row, begin + size] - hashes[row, begin] * self.powers[size]
                value ^= np.where(size == left[open_], _ENDS, np.uint64(0))
                token = self.spellings.get(value)
                hit = token != _NONE
                found[open_[hit]] = token[hit]
                open_ = open_[~hit]
                length[open_] -= 1
            tokens[live, step] = found
            start[live] += length
            live = live[start[live] < sizes[live]]
            step += 1
        return tokens

    # -- verification -------------------------------------------------------

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """Does BPE leave each pair as it is? The right side ``n_ids`` stands for none."""
        n = self.n_ids
        left, right = np.divmod(keys, n + 1)
        texts, ends = [], []
        for a, b in zip(left.tolist(), right.tolist()):
            first, last = self.spelled[a], self.spelled[b] if b < n else (b"", None)
            texts.append(first[0] + last[0])
            ends.append(first[1] if last[1] is None else last[1])
        letters, sizes = _matrix(texts)
        merged = self.merge_many(self._symbols(letters, sizes, np.array(ends)))
        merged = np.concatenate((merged, np.full((len(keys), 3), -1)), axis=1)
        expected = np.where(right < n, right, -1)
        return (merged[:, 0] == left) & (merged[:, 1] == expected) & (merged[:, 2] == -1)

    def _fitting(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of many pairs at once; unknown ones are judged and remembered."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs, self.pair_fits = self.pairs[:0], self.pair_fits[:0]
        new = np.unique(keys)
        if len(self.pairs):
            at = np.searchsorted(self.pairs, new).clip(max=len(self.pairs) - 1)
            new = new[self.pairs[at] != new]
        if len(new):
            pairs = np.concatenate((self.pairs, new))
            fits = np.concatenate((self.pair_fits, self._judge(new)))
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.pair_fits = pairs[order], fits[order]
        return self.pair_fits[np.searchsorted(self.pairs, keys)]

    def _failing(self, tokens: np.ndarray) -> np.ndarray:
        """Which rows of proposals (padded with -1) have a pair that does not fit?"""
        right = np.concatenate((tokens[:, 1:], np.full((len(tokens), 1), -1)), axis=1)
        right[(tokens[:, 1:2] < 0).ravel(), 0] = self.n_ids  # a token on its own
        tested = right >= 0
        fits = np.ones(tokens.shape, dtype=bool)
        fits[tested] = self._fitting(tokens[tested] * (self.n_ids + 1) + right[tested])
        return ~fits.all(axis=1)

    def encode_words(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Tokens of words: propose, verify, merge the failing ones."""
        result: list[tuple[int, ...]] = [()] * len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for low, high in ((0, 8), (8, 12), (12, 18), (18, SHORT_WORD)):
            chosen = np.flatnonzero((length > low) & (length <= high))
            if not len(chosen):
                continue
            letters, sizes = _matrix([words[i] for i in chosen.tolist()])
            tokens = self.propose_many(letters, sizes)
            wrong = np.flatnonzero(self._failing(tokens))
            if len(wrong):
                ends = np.ones(len(wrong), dtype=bool)
                tokens[wrong] = self.merge_many(
                    self._symbols(letters[wrong], sizes[wrong], ends)
                )
            counts = (tokens >= 0).sum(axis=1)
            stops = np.cumsum(counts).tolist()
            flat = list(map(self.numbers.__getitem__, tokens[tokens >= 0].tolist()))
            start = 0
            for i, stop in zip(chosen.tolist(), stops):
                result[i] = tuple(flat[start:stop])
                start = stop
        for i in np.flatnonzero(length > SHORT_WORD).tolist():
            tokens = self.propose(words[i])
            if self._failing(np.array([[*tokens, -1]], dtype=np.int64))[0]:
                tokens = self.merge(words[i])
            result[i] = tuple(tokens)
        return result

    # -- texts --------------------------------------------------------------

    def _words_of(self, text: str) -> list[str]:
        if _is_latin(text):
            return _LATIN_WORDS(text.lower())
        byte_of = self._byte_of.__getitem__
        return [
            bytes(map(byte_of, piece)).decode("utf-8")
            for piece, _ in self._split(self._normalize(text))
        ]

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """Token ids of each text. A special token's string in a text is that token."""
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        whole: list[list[str]] = []
        with_special: dict[int, list] = {}
        for i, text in enumerate(texts):
            parts = [text]
            if self._special_split and "<|" in text:
                parts = self._special_split(text)
            if len(parts) == 1:
                whole.append(self._words_of(text))
                continue
            split = [p if p in self.special else self._words_of(p) for p in parts]
            with_special[i] = split
            whole.append(list(chain.from_iterable(p for p in split if isinstance(p, list))))
        new = list(set().union(*whole).difference(self.words))
        if new:
            self.words.update(zip(new, self.encode_words([word.encode() for word in new])))
        get = self.words.__getitem__
        result = [list(chain.from_iterable(map(get, words))) for words in whole]
        for i, split in with_special.items():
            result[i] = list(
                chain.from_iterable(
                    chain.from_iterable(map(get, part))
                    if isinstance(part, list)
                    else (self.special[part],)
                    for part in split
                )
            )
        return result

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens with a blank between: what a vocabulary without decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids))


_BASE = np.uint64(0x100000001B3)
_ENDS = np.uint64(0x5851F42D4C957F2D)



def _matrix(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes, padded with 0, and their sizes."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    width = max(1, int(sizes.max(initial=1)))
    letters = np.zeros((len(texts), width), dtype=np.uint8)
    inside = np.arange(width) < sizes[:, None]
    letters[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return letters, sizes


@lru_cache(maxsize=2)
def bpe(path: str) -> SpeculativeBPE:
    """One encoder for each vocabulary in each Python worker."""
    return SpeculativeBPE(path)


def encode_documents(
    docs: DataFrame, path: str | None = None, *, text_column: str = "text", name: str = "ids"
) -> DataFrame:
    """``docs`` with the token ids of the whole text as ``array<int>`` in column ``name``,
    which replaces one of that name. Null and empty texts have no ids. Each row is encoded
    on its own, so repeated rows, ties and empty tables need no rule."""
    path = path or vocabulary_path()
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() != name.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            ids = pa.array(bpe(path).encode_batch(texts_of(batch, text_column)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return kept.mapInArrow(run, with_fields(kept, (name, "array<int>")))


def decode_documents(
    encoded: DataFrame, path: str | None = None, *, ids: str = "ids", name: str = "text"
) -> DataFrame:
    """``encoded`` with the decoded text of column ``ids`` as column ``name``, which replaces
    one of that name. Null ids give an empty text."""
    path = path or vocabulary_path()
    kept = encoded.select(*[encoded[c] for c in encoded.columns if c.lower() != name.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [bpe(path).decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name]
            )

    return kept.mapInArrow(run, with_fields(kept, (name, "string")))


def round_trip_digests(
    docs: DataFrame,
    path: str | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and decoded in one
    pass, without moving the ids out of the Python worker. Cases as in ``encode_documents``."""
    path = path or vocabulary_path()
    narrow = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        decimal = [str(i) for i in range(coder.n_ids)]
        sha = hashlib.sha256
        for batch in text_slices(batches):
            encoded = coder.encode_batch(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, encoded), pa.int64()),
                    pa.array(
                        [
                            sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest()
                            for ids in encoded
                        ],
                        pa.string(),
                    ),
                    pa.array(
                        [sha(coder.decode(ids).encode("utf-8")).hexdigest() for ids in encoded],
                        pa.string(),
                    ),
                ],
                [id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = with_fields(
        narrow.select(id_column),
        ("n_tokens", "bigint"),
        ("ids_sha256", "string"),
        ("decoded_sha256", "string"),
    )
    return narrow.mapInArrow(run, schema)
