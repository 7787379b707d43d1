"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into a fixed number of features.

1. Document frequencies of the features over every whole text, for the weights
   ``log(documents / frequency)`` squared.
2. A randomised SVD of the weighted passage matrix A in two passes. Each task sums its share of
   ``A^T (A R)`` for a random R with ``OVERSAMPLE`` columns more than ranks, Spark adds the shares up, and
   the driver orthonormalises the sum to a basis Q (features by columns, a fixed size). The second pass
   sums ``(A Q)^T (A Q)``, whose eigenvectors turn Q into right singular vectors; the ``rank`` largest stay.
   Both passes read every whole text. The first does not depend on the items, so it is done once for all blocks.
   The items to protect are rows of A too, weighted up to the same total as the corpus, so the
   space tells them apart.
3. The search, over every whole text: overlapping windows of a text are projected and compared by cosine with
   all passages of the items, which overlap and are no longer than a window. Besides, three words in a row that
   an item holds too are looked up by hash. Each edited word breaks at most three of them, so a copy with up to
   ``1 - sure`` of its words edited keeps a known number, and a place with as many is compared whatever its
   cosine: exact and nearly exact copies do not depend on the space.
   For a place that comes close to an item, the words around are aligned with the item's:
   the longest common subsequence within a span little longer than the item. A text is contaminated
   by an item if it holds ``run`` of its words in a row, nearly all words of the item or of a passage of it
   in order, or, for paraphrases, most of the item and the answer: the item's answer column, or its last words.

Items are a stated query set, read in blocks of ``block_items``; each block is one more second and third pass,
so no larger set sits in memory. A verdict depends on the text alone, so the blocks' verdicts are
put together by a 128-bit digest of the text; ids play no part in it.

Items shorter than ``least_words`` are looked for as an exact sequence of words. Where a script sets
no spaces between words, each character counts as a word, and the numbers of words asked for are
doubled (Chinese, Japanese) or taken four times (Thai, Lao, Khmer, Burmese, Tibetan).

Null and empty texts are clean. Items that are null or hold no word are not looked for. Without items all rows are clean. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vozmill.llm.common import byte_texts, pieces, stored, text_digest

_C = F.col
FEATURES = 1 << 15
RANK = 64
OVERSAMPLE = 16  # columns of the sketch beyond the ranks
FIT_TASKS = 16  # tasks of the fit, each with one array of fixed size, if the texts come in as many parts
FIT_WORDS = 1 << 24  # words to a task of the fit, where that makes more tasks
CELLS = 1 << 22  # windows times passages that are compared at once
HALF = 16  # words in half a window
STEP = 8  # words from a passage of an item to the next
GRAM = 3  # words in a row that are looked up by hash
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Characters of scripts without spaces: first, last, and how many stand for about a word.
_UNSPACED = np.array([
    (0xE00, 0xFFF, 4), (0x1000, 0x109F, 4), (0x1780, 0x17FF, 4), (0x1950, 0x19FF, 4), (0x1A20, 0x1AAF, 4), (0x2E80, 0x2FFF, 2),
    (0x3005, 0x3007, 2), (0x3021, 0x3029, 2), (0x3031, 0x312F, 2), (0x31A0, 0xA4CF, 2), (0xA9E0, 0xAA7F, 4), (0xF900, 0xFAFF, 2),
    (0xFF66, 0xFF9F, 2), (0x1B000, 0x1B16F, 2), (0x20000, 0x3FFFF, 2),
])
_MARKS = np.array([(0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _within(points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Row of the range that holds each code point, -1 for none."""
    row = np.searchsorted(ranges[:, 0], points, side="right") - 1
    return np.where((row >= 0) & (points <= ranges[row, 1]), row, -1)


def _unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, bytes and row of each character of a script without spaces; row -1 for its punctuation."""
    at = np.flatnonzero(raw >= 0xE0)
    b = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
    three = b[0] < 0xF0
    tail = (b[1] & 63) << 6 | b[2] & 63
    point = np.where(three, (b[0] & 15) << 12 | tail, (b[0] & 7) << 18 | tail << 6 | b[3] & 63)
    row = _within(point, _UNSPACED)
    known = (row >= 0) | (_within(point, _MARKS) >= 0)
    return at[known], np.where(three, 3, 4)[known], row[known]


class Words:
    """Words of several lower-cased texts as positions in one buffer, with the feature of each.

    In scripts that set no spaces between words each character is a word.
    A feature depends on a word's first and last eight bytes and its length.
    """

    def __init__(self, texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.raw = np.frombuffer(b" ".join(parts) + b" " * 9, np.uint8)
        inside = _IN_WORD[self.raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.stop = edges[::2], edges[1::2]
        at, size, row = _unspaced(self.raw)
        if len(at):
            for k in range(4):
                mark = at[(row < 0) & (size > k)] + k
                inside[mark] = False
            cut = np.zeros(len(inside) + 1, bool)  # a word ends before this byte, or begins there
            cut[at] = cut[at + size] = True
            before = np.concatenate([[False], inside[:-1]])
            self.start = np.flatnonzero(inside & (~before | cut[:-1]))
            self.stop = np.flatnonzero(before & (~inside | cut[:-1]))
        ends = np.cumsum([len(p) + 1 for p in parts])
        #: Words of text i: from bounds[i] up to bounds[i + 1].
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)])
        length = self.stop - self.start
        eight = np.lib.stride_tricks.sliding_window_view(self.raw, 8)
        head = eight[self.start].view("<u8").ravel() & _MASK[np.minimum(length, 8)]
        tail = eight[np.maximum(self.stop - 8, self.start)].view("<u8").ravel() & _MASK[np.minimum(length, 8)]
        code = head * np.uint64(0x9E3779B97F4A7C15) + (tail ^ length.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.code = code
        self.feature = (code >> np.uint64(64 - 15)).astype(np.int64)

    def runs(self, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Each size with the hashes of so many words from each position on, across the ends of texts too."""
        n = len(self.code)
        powers, back = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        powers[:1] = back[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code * np.cumprod(powers))])
        back = np.cumprod(back)
        for size in sizes:
            if size <= n:
                yield size, (sums[size:] - sums[:-size]) * back[: n - size + 1]

    def slice(self, a: int, b: int) -> list[bytes]:
        raw = self.raw
        return [raw[x:y].tobytes() for x, y in zip(self.start[a:b].tolist(), self.stop[a:b].tolist())]


def _halves(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``HALF`` words (the last of a text may be shorter), and their text."""
    sizes = np.diff(bounds)
    runs = -(-sizes // HALF)
    owner = np.repeat(np.arange(len(sizes)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    return bounds[:-1][owner] + nth * HALF, owner


def _sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(table[rows], starts)``, but whole rows at a time.

    The first rows of all segments are added at once, then the second ones; long segments are cut and their parts added up again.
    """
    while True:
        size = np.diff(np.append(starts, len(rows)))
        cuts = -(-size // HALF)
        after = np.cumsum(cuts)
        skipped = HALF * (np.arange(cuts.sum()) - np.repeat(after - cuts, cuts))
        first = np.repeat(starts, cuts) + skipped
        length = np.minimum(np.repeat(size, cuts) - skipped, HALF)
        order = np.argsort((HALF - length).astype(np.uint16), kind="stable")  # those that have a row more come first
        first, longer = first[order], len(order) - np.searchsorted(length[order[::-1]], np.arange(HALF), side="right")
        sums = table.take(rows[first], axis=0)
        spare = np.empty_like(sums)
        for k in range(1, HALF):
            if not longer[k]:
                break
            part = spare[: longer[k]]
            sums[: longer[k]] += table.take(rows[first[: longer[k]] + k], axis=0, out=part, mode="clip")
        spare[order] = sums
        if len(order) == len(starts):
            return spare
        table, rows, starts = spare, np.arange(len(spare)), after - cuts


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Adds up (block, values) rows; every task keeps one sum per block, however many rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist()):
                got = np.frombuffer(values, np.float32)
                sums[block] = sums[block] + got if block in sums else got.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())],
                names=["block", "values"],
            )

    merged = parts.repartition("block").mapInArrow(run, parts.schema)
    return {r["block"]: np.frombuffer(r["values"], np.float32) for r in merged.collect()}


def _total(texts: DataFrame, shape: tuple[int, int], add: Callable[[Words, np.ndarray], None], blocks: int = 64) -> np.ndarray:
    """The sum over all texts of an array of fixed shape; ``add`` adds the share of some of them to it.

    A task holds one such array, and every piece changes only the rows it has words for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in pieces(batches, "text", 1 << 19):
            total = np.zeros(shape) if total is None else total
            add(Words(byte_texts(pc.utf8_lower(batch.column("text")))), total)
        if total is None:  # no row came here
            return
        cut = np.array_split(total, blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(blocks), pa.int32()), pa.array([c.astype(np.float32).tobytes() for c in cut], pa.binary())],
            names=["block", "values"],
        )

    found = _summed(texts.select("text").mapInArrow(run, "block int, values binary"))
    if not found:
        return np.zeros(shape, np.float32)
    return np.concatenate([found[k] for k in range(blocks)]).reshape(shape)


def _by_feature(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words by feature, in order, and their features; short integers sort by digits."""
    order = np.argsort(words.feature.astype(np.uint16), kind="stable")
    return order, words.feature[order]


def _frequencies(words: Words, total: np.ndarray) -> None:
    """Adds the texts that hold each feature, the texts and their words."""
    order, feature = _by_feature(words)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[order]
    once = np.flatnonzero((np.diff(feature, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    total[:, 0] += np.bincount(feature[once], minlength=FEATURES + 2)
    total[FEATURES:, 0] += len(words.bounds) - 1, len(words.start)


def _gram(words: Words, weight: np.ndarray, random: np.ndarray, total: np.ndarray) -> None:
    """Adds ``A^T (A R)`` of passages of ``HALF`` words; ``random`` is weighted already."""
    starts, _ = _halves(words.bounds)
    if not len(starts):
        return
    sketch = _sums(random, words.feature, starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words.feature))))
    order, feature = _by_feature(words)
    first = np.flatnonzero(np.diff(feature, prepend=-1))
    features = feature[first]
    total[features] += weight[features, None] * _sums(sketch, run[order], first)


def feature_weights(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Weight of each feature, ``log((1 + documents) / frequency)`` squared, and the number of all words."""
    counts = _total(texts, (FEATURES + 2, 1), _frequencies)[:, 0]
    documents, words = counts[FEATURES:]
    return (np.log((1 + documents) / np.maximum(counts[:FEATURES], 1)) ** 2).astype(np.float32), int(words)


def _projected(words: Words, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds ``(A Q)^T (A Q)`` of passages of ``HALF`` words; ``basis`` is weighted already."""
    starts, _ = _halves(words.bounds)
    if len(starts):
        rows = _sums(basis, words.feature, starts).astype(np.float64)
        total += rows.T @ rows


def _random(weight: np.ndarray, columns: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed).standard_normal((FEATURES, columns), np.float32)
    random *= weight[:, None]
    return random


def corpus_sketch(texts: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """``A^T (A R)`` of all texts, the same for every block of items."""
    random = _random(weight, rank + OVERSAMPLE, seed)
    sent = texts.sparkSession.sparkContext.broadcast((weight, random))
    corpus = _total(texts, random.shape, lambda w, total: _gram(w, *sent.value, total))
    sent.unpersist()
    return corpus


def latent_space(
    texts: DataFrame, weight: np.ndarray, items: list[bytes], rank: int = RANK, seed: int = 17, corpus: np.ndarray | None = None,
) -> np.ndarray | None:
    """Weighted right singular vectors: row f projects one occurrence of feature f; None if there is no word.

    ``corpus`` is the :func:`corpus_sketch` of the texts, if it is known already.
    """
    columns = rank + OVERSAMPLE
    corpus = corpus_sketch(texts, weight, rank, seed) if corpus is None else corpus
    split = Words(items)
    # The driver holds a few arrays of features by columns, a fixed size, in single precision.
    queries = np.zeros((FEATURES, columns), np.float32)
    _gram(split, weight, _random(weight, columns, seed), queries)
    size, own = float(np.linalg.norm(corpus)), float(np.linalg.norm(queries))
    share = size / own if size and own else 1.0  # items count as much as the corpus
    queries *= share
    queries += corpus
    if not np.any(queries):
        return None
    basis = np.linalg.qr(queries)[0]
    del queries
    basis *= weight[:, None]
    again = texts.sparkSession.sparkContext.broadcast(basis)
    small = _total(texts, (columns, columns), lambda w, total: _projected(w, again.value, total), blocks=1).astype(np.float64)
    own_part = np.zeros((columns, columns))
    _projected(split, basis, own_part)
    small += share * own_part
    vectors = np.linalg.eigh(small)[1][:, ::-1][:, :rank]  # of the largest singular values
    again.unpersist()
    return basis @ vectors.astype(np.float32)


def common_subsequence(text: list[bytes], places: dict[bytes, int], size: int) -> int:
    """Length of the longest common subsequence; ``places``: word -> bits of its places in the item."""
    full = (1 << size) - 1
    row = full
    for word in text:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _places(item: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _unit(words: Words) -> int:
    """Characters that stand for about a word, if most words are characters of one kind; else 1."""
    _, _, row = _unspaced(words.raw)
    kinds = _UNSPACED[row[row >= 0], 2]
    if 2 * len(kinds) <= len(words.start):
        return 1
    return 4 if 2 * np.count_nonzero(kinds == 4) > len(kinds) else 2


class Item:
    def __init__(self, key, text: str, answer: str | None, answer_words: int):
        split = Words([text.lower().encode()])
        self.key, self.words = key, split.slice(0, len(split.start))
        #: Words of the item that say about as much as a word of a spaced script.
        self.unit = _unit(split)
        self.places = _places(self.words)
        self.sequence = split.code.tolist()
        self.codes = Counter(self.sequence)
        self.passages = _passages(np.array([len(self.words)]))[1].tolist()
        told = Words([answer.lower().encode()]) if answer else None
        self.answer = told.slice(0, len(told.start)) if told else self.words[-answer_words * self.unit :]
        self.answer_places = _places(self.answer)


class Runs:
    """Runs of words of the items (whole items, if shorter), found by hash."""

    def __init__(self, items: list[Item], run: int, scaled: bool = False):
        self.items, found = items, {}
        for at, item in enumerate(items):
            size = min(run * item.unit if scaled else run, len(item.words))
            for _, codes in Words([b" ".join(item.words)]).runs([size]):
                found.setdefault(size, []).append((*np.unique(codes, return_index=True), at))
        self.tables = {}
        for size, parts in found.items():
            codes = np.concatenate([c for c, _, _ in parts])
            item = np.concatenate([np.full(len(c), at, np.int32) for c, _, at in parts])
            place = np.concatenate([first.astype(np.int32) for _, first, _ in parts])
            order = np.argsort(codes, kind="stable")
            self.tables[size] = codes[order], item[order], place[order]
        self.filters: dict[int, tuple[np.uint64, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "filters": {}}  # made again where they are used

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Size; item, its word, text and position of runs with equal hashes, by text, item and position."""
        for size, hashes in words.runs(list(self.tables)):
            codes, item, place = self.tables[size]
            if size not in self.filters:
                bits = min(max(len(codes).bit_length() + 5, 16), 24)
                seen = np.zeros(1 << bits, bool)
                seen[codes >> np.uint64(64 - bits)] = True
                self.filters[size] = np.uint64(64 - bits), seen
            shift, seen = self.filters[size]
            maybe = np.flatnonzero(seen[hashes >> shift])
            low = np.searchsorted(codes, hashes[maybe], side="left")
            many = np.searchsorted(codes, hashes[maybe], side="right") - low
            position = np.repeat(maybe, many)
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            text = np.searchsorted(words.bounds, position, side="right") - 1
            whole = position + size <= words.bounds[text + 1]
            position, entry, text = position[whole], entry[whole], text[whole]
            order = np.lexsort((position, item[entry], text))
            yield size, item[entry][order], place[entry][order], text[order], position[order]


def _passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and number of words of passages of at most a window, which cover each item."""
    last = np.maximum(sizes - 2 * HALF, 0)
    many = -(-last // STEP) + 1
    item = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(nth * STEP, last[item])
    return item, first, np.minimum(sizes[item], 2 * HALF)


def _windows(space: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and unit vector of windows of two halves (fewer at the end of a text)."""
    starts, owner = _halves(words.bounds)
    halves = _sums(space, words.feature, starts) if len(starts) else np.zeros((0, space.shape[1]), space.dtype)
    paired = halves.copy()
    joined = owner[:-1] == owner[1:]
    paired[:-1][joined] += halves[1:][joined]
    return starts, owner, paired / np.maximum(np.linalg.norm(paired, axis=1, keepdims=True), 1e-9)


class Searcher:
    """Items with the latent vectors of their passages; judges the texts of a batch."""

    def __init__(self, items: list[Item], short: list[Item], space: np.ndarray | None, close: float, sure: float, likely: float, slack: float, run: int):
        self.items, self.space = items + short, space  # short ones are only looked for word by word
        self.close, self.sure, self.likely, self.slack = close, sure, likely, slack
        self.grams, self.quoted = Runs(items, GRAM), Runs(self.items, run, scaled=True)
        self.sizes = np.array([len(i.words) for i in items], np.int64)
        if space is None:
            return
        split = Words([b" ".join(i.words) for i in items])
        self.item, first, size = _passages(np.diff(split.bounds))
        first = split.bounds[:-1][self.item] + first
        bounds = np.concatenate([[0], np.cumsum(size)])
        feature = split.feature[np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])]
        vectors = np.add.reduceat(space[feature], bounds[:-1])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def matches(self, words: Words) -> dict[int, dict[int, float]]:
        """Text -> item -> share of the item's words found in order."""
        found: dict[int, dict[int, float]] = {}
        for at, text, start, stop in self.quotations(words):
            self.align(found, words, text, start, stop, at, copy=True)
        for at, text, start, stop in self.copies(words):
            self.align(found, words, text, start, stop, at)
        if self.space is not None and len(words.start):
            starts, owner, vectors = _windows(self.space, words)
            step = max(CELLS // len(self.vectors), 1)
            for low in range(0, len(vectors), step):
                window, passage = np.nonzero(vectors[low : low + step] @ self.vectors.T >= self.close)
                pairs = np.unique((low + window) * len(self.items) + self.item[passage])
                for run, at in zip(*(x.tolist() for x in np.divmod(pairs, len(self.items)))):
                    start = int(starts[run])
                    self.align(found, words, int(owner[run]), start, start + 2 * HALF, at)
        return found

    def quotations(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, first word, end) of runs of ``run`` words, or whole shorter items, compared word by word."""
        for size, item, place, text, position in self.quoted.hits(words):
            free: tuple[int, int, int] = (-1, -1, 0)
            for at, k, t, start in zip(*(x.tolist() for x in (item, place, text, position))):
                held = self.items[at].words
                if free[:2] == (t, at) and start < free[2] or words.slice(start, start + size) != held[k : k + size]:
                    continue
                free = t, at, start + len(held)
                yield at, t, start, start + size

    def copies(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, first word, end) of places that hold as many runs as a copy of an item, or of a window of it."""
        for size, item, _, text, position in self.grams.hits(words):
            every = np.zeros(len(item), bool)
            spans = np.zeros(len(item), np.int64)
            for length in (self.sizes[item], np.minimum(self.sizes[item], 2 * HALF)):
                edits = np.floor((1 - self.sure) * length + 1e-9).astype(np.int64)
                least = np.maximum(length - size + 1 - size * edits, 1)
                span = np.ceil(length * self.slack).astype(np.int64)
                end = np.arange(len(item)) + least - 1
                last = np.minimum(end, len(item) - 1)
                enough = (end == last) & (item[last] == item) & (text[last] == text) & (position[last] - position < span)
                every |= enough
                spans = np.where(enough, span, spans)
            free: tuple[int, int, int] = (-1, -1, 0)
            for k in np.flatnonzero(every).tolist():
                at, t, start = int(item[k]), int(text[k]), int(position[k])
                if free[:2] == (t, at) and start < free[2]:
                    continue
                free = t, at, start + max(int(self.sizes[at]) // 4, 1)
                yield at, t, start, start + int(spans[k])

    def align(self, found: dict[int, dict[int, float]], words: Words, text: int, start: int, stop: int, at: int, copy: bool = False) -> None:
        if found.get(text, {}).get(at, 0.0) < self.sure:
            share = self.aligned(words, text, start, stop, self.items[at], copy)
            if share:
                best = found.setdefault(text, {})
                best[at] = max(best.get(at, 0.0), share)

    def aligned(self, words: Words, text: int, start: int, stop: int, item: Item, copy: bool = False) -> float:
        """Best share of the item in a span around the place; 0 if that is no contamination.

        It is one if the place holds a ``copy`` of a long run, or ``sure`` of the item or of a
        passage of it in order, or ``likely`` of the item and the answer.
        """
        n = len(item.words)
        first, end = int(words.bounds[text]), int(words.bounds[text + 1])
        low, high = max(start - n, first), min(stop + n, end)
        there = set(words.code[low:high].tolist()).intersection(item.codes)
        likely = sum(item.codes[c] for c in there) >= self.likely * n  # else too few words, in whatever order
        likely = likely and common_subsequence(words.slice(low, high), item.places, n) >= self.likely * n
        if not (likely or copy or self.holds_passage(words, first, end, start, stop, item)):
            return 0.0
        around = words.slice(low, high)
        span, step = int(np.ceil(n * self.slack)), max(n // 4, 1)
        best, where = 0, 0
        for a in range(0, max(len(around) - span, 0) + step, step):
            got = common_subsequence(around[a : a + span], item.places, n)
            if got > best:
                best, where = got, a
        share = best / n
        if share >= self.sure or copy or not likely:
            return share
        here = around[max(where - step, 0) : where + span + step]
        told = common_subsequence(here, item.answer_places, len(item.answer))
        if share >= self.likely and told >= 0.75 * len(item.answer):
            return share
        return share if self.holds_passage(words, first, end, start, stop, item) else 0.0

    def holds_passage(self, words: Words, first: int, end: int, start: int, stop: int, item: Item) -> bool:
        """Whether ``sure`` of a passage of an item longer than a window stands at the place in order."""
        size = 2 * HALF
        if len(item.words) <= size:
            return False
        low, high = max(start - HALF, first), min(stop + HALF, end)
        there = set(words.code[low:high].tolist())
        if sum(item.codes[c] for c in there.intersection(item.codes)) < self.sure * size:
            return False
        held = [c in there for c in item.sequence]
        starts = [k for k in item.passages if sum(held[k : k + size]) >= self.sure * size]
        if not starts:
            return False
        around, span = words.slice(low, high), int(np.ceil(size * self.slack))
        for k in starts:
            places = _places(item.words[k : k + size])
            if common_subsequence(around, places, size) < self.sure * size:
                continue
            for a in range(0, max(len(around) - span, 0) + STEP, STEP):
                if common_subsequence(around[a : a + span], places, size) >= self.sure * size:
                    return True
        return False


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    close: float = 0.7, sure: float = 0.8, likely: float = 0.6, slack: float = 1.25,
    least_words: int = 8, answer_words: int = 5, rank: int = RANK, block_items: int = 20_000,
    seed: int = 17, run: int = 12,
) -> DataFrame:
    """(id_col, contaminated, items, share) of every row; ``items`` ascending, ``share`` of the best."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    base = docs.select(_C(id_col).alias("id"), _C(text_col).alias("text"))
    answer = _C(answer_col) if answer_col else F.lit(None).cast("string")
    asked = benchmark.select(_C(item_col).alias("item"), _C(item_text).alias("text"), answer.alias("answer")).where(
        _C("item").isNotNull() & _C("text").isNotNull()
    ).distinct()
    blocks = max(-(-asked.count() // block_items), 1)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    weight, words = feature_weights(base)
    # Each task of the fit ends in one array of fixed size, so tasks follow the words, not the files.
    fitted = base.select("text").coalesce(max(FIT_TASKS, -(-words // FIT_WORDS)))
    corpus = None
    parts = []
    for block in range(blocks):
        rows = sorted(numbered.where(_C("block") == block).collect(), key=lambda r: (r["item"], r["text"]))
        items = [
            Item(r["item"], r["text"], r["answer"], answer_words) for r in rows
        ]
        short = [i for i in items if 0 < len(i.words) < least_words * i.unit]
        items = [i for i in items if len(i.words) >= max(least_words * i.unit, 1)]
        space = None
        if items:
            if corpus is None:
                corpus = corpus_sketch(fitted, weight, rank, seed)
            space = latent_space(fitted, weight, [b" ".join(i.words) for i in items], rank, seed, corpus)
        searcher = Searcher(items, short, space, close, sure, likely, slack, run) if items or short else None
        sent = spark.sparkContext.broadcast(searcher)  # features by rank, and one block of items
        if blocks == 1:
            return _judged(base, sent, kind, item_kind).withColumnRenamed("id", id_col)
        digested = base.select(text_digest(_C("text")).alias("id"), "text")
        bad = _judged(digested, sent, T.StringType(), item_kind).where("contaminated")
        # Copies of a text are one row before they meet, and a block's broadcast can go.
        parts.append(stored(bad.dropDuplicates(["id"])))
        sent.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy(_C("id").alias("digest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("share").alias("share")
    )
    out = base.select("id", text_digest(_C("text")).alias("digest")).join(merged, "digest", "left").select(
        "id", _C("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(T.ArrayType(item_kind))).alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
    return out.withColumnRenamed("id", id_col)


def _judged(base: DataFrame, sent, kind: T.DataType, item_kind: T.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = sent.value
        for batch in pieces(batches, "text", 1 << 17):
            texts = byte_texts(pc.utf8_lower(batch.column("text")))
            found = searcher.matches(Words(texts)) if searcher else {}
            hits = [found.get(i, {}) for i in range(len(texts))]
            keys = [sorted({searcher.items[k].key for k in h}) if h else [] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([bool(h) for h in hits]), pa.array(keys, pa.list_(item_type)),
                 pa.array([max(h.values(), default=0.0) for h in hits], pa.float64())],
                names=["id", "contaminated", "items", "share"],
            )

    item_type = to_arrow_type(item_kind)
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(item_kind)), T.StructField("share", T.DoubleType()),
    ])
    return base.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without benchmark passages, whatever their ids."""
    texts = docs.select(text_digest(_C(text_col)).alias("digest"), _C(text_col).alias("text"))
    found = find_contaminated(texts, benchmark, "digest", "text", **options)
    bad = found.where("contaminated").select(_C("digest").alias("__bad")).distinct()
    return docs.join(bad, text_digest(docs[text_col]) == bad["__bad"], "left_anti")
