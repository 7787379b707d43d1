"""Document fingerprints by locally consistent parsing.

A text is parsed level by level, from its bytes up. At each level equal neighbours become one
symbol with a length. Deterministic coin tossing then replaces every symbol by the lowest bit
in which it differs from its left neighbour, with that bit's value, until fewer than six labels
are left; a phrase starts where a label is greater than both its neighbours. Neighbouring
labels differ, so a phrase has two to ten symbols. Its name, a hash of its symbols in order, is a
symbol of the next level. Boundaries depend on a few symbols to the left and one to the right
only, so equal substrings get equal names inside, wherever they start.

The fingerprint holds the smallest names of the phrases of level 2 and above (about 11 bytes
each and longer), a bottom-k sketch: the likeness of two fingerprints estimates the share of
the phrases that both texts have, exactly if they have no more than k.

A null text is an empty one, with an empty fingerprint; two empty fingerprints are alike (1), an
empty and another are not (0). Parsing takes about 40 bytes of memory per byte of a text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vozmill.llm.common import byte_texts, pieces

_C = F.col
#: Names that a fingerprint keeps, each as 8 hexadecimal digits.
NAMES = 64
FIRST_LEVEL = 2
#: Keys drawn per part to find where the parts of the document order begin.
KEYS_PER_PART = 64

_U = np.uint64
_LOWEST = np.array([0] + [(b & -b).bit_length() - 1 for b in range(1, 256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit that differs from the left neighbour) + that bit."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = label[first] ^ label.dtype.type(1)
    differ = label ^ left
    if label.dtype == np.uint8:
        bit = _LOWEST[differ]
    else:
        bit = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)) & np.uint8(63)
    value = (label >> bit.astype(label.dtype)).astype(np.uint8) & np.uint8(1)
    return bit * np.uint8(2) + value


def next_level(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and which of them open a text.

    ``first`` marks the symbols that open a text; there is at least one symbol.
    """
    opens = first.copy()
    opens[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(opens)
    lengths = np.diff(at, append=len(symbols))
    symbols, first = symbols[at], first[at]
    starts = np.flatnonzero(first)
    label = symbols
    for _ in range(3 if symbols.dtype == np.uint8 else 4):  # 256 -> 16 -> 8 -> 6 or 2^64 -> 128 -> 14 -> 8 -> 6
        label = _toss(label, starts)
    landmark = np.zeros(len(label), bool)
    landmark[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    landmark[starts[1:] - 1] = False  # the last symbol of a text opens no phrase of its own
    landmark[starts] = True
    at = np.flatnonzero(landmark)
    sizes = np.diff(at, append=len(label))
    place = np.arange(len(label)) - np.repeat(at, sizes)
    value = symbols.astype(_U) * _U(0x9E3779B97F4A7C15)
    value += _mix((lengths * 64 + place).astype(_U) + _U(level << 56))
    names = _mix(np.add.reduceat(_mix(value), at) + sizes.astype(_U))
    return names, first[at]


def sketches(texts: list[bytes], names: int = NAMES) -> list[np.ndarray]:
    """Per text the smallest phrase names, ascending, the upper 32 bits of each."""
    filled = [i for i, t in enumerate(texts) if t]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    if not filled:
        return out
    symbols = np.frombuffer(b"".join(texts[i] for i in filled), np.uint8)
    owner = np.array(filled)
    first = np.zeros(len(symbols), bool)
    first[np.cumsum([0] + [len(texts[i]) for i in filled[:-1]])] = True
    kept_names, kept_owners, level = [], [], 0
    while len(owner):
        symbols, first = next_level(symbols, first, level)
        level += 1
        if level < FIRST_LEVEL:
            continue
        text = np.cumsum(first) - 1
        kept_names.append(symbols)
        kept_owners.append(owner[text])
        alive = np.bincount(text) > 1  # a text that is one phrase is done
        symbols, first, owner = symbols[alive[text]], first[alive[text]], owner[alive]
    found, owners = np.concatenate(kept_names), np.concatenate(kept_owners)
    found = (found >> _U(32)) | (owners.astype(_U) << _U(32))
    found = np.unique(found)
    owners = (found >> _U(32)).astype(np.int64)
    bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
    values = found.astype(np.uint32)
    return [values[lo : min(hi, lo + names)] for lo, hi in zip(bounds[:-1], bounds[1:])]


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, names: int = NAMES) -> float:
    """Estimated share of the phrases of two texts that both have, 0 to 1, from their sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    lowest = np.flatnonzero(~again)[:names]
    end = len(both) if len(lowest) < names else lowest[-1] + 2
    common = int(np.count_nonzero(again[:end]))
    return 2 * common / (len(lowest) + common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: int = NAMES) -> DataFrame:
    """(id_col, fingerprint) of every row, as often as it comes; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = sketches([t or b"" for t in byte_texts(batch.column("text"))], names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([shown(s) for s in found], pa.string())], names=["id", "fingerprint"]
            )

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())
    ])
    found = docs.select(_C(id_col).alias("id"), _C(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)


def _part_starts(keyed: DataFrame, parts: int) -> list[tuple]:
    """Keys at which the parts of the order begin, the smallest key first; bounded by ``parts``."""
    key = F.struct("missing", "id", "tie")
    total, least = keyed.agg(F.count("*"), F.min(key)).first()
    if not total:
        return []
    share = min(1.0, 2.0 * parts * KEYS_PER_PART / total)
    drawn = sorted({tuple(r) for r in keyed.select("missing", "id", "tie").sample(share, 17).collect()}, key=_order)
    chosen = {drawn[len(drawn) * p // parts] for p in range(1, parts)} if drawn else set()
    return sorted(chosen | {tuple(least)}, key=_order)


def _order(key: tuple) -> tuple:
    """A key that Python can sort: missing ids come last and are all alike."""
    return (key[0], key[1] if not key[0] else 0, key[2])


def _deal(bounds: list[tuple], kind: pa.DataType):
    """Rows with the part they belong to; a row at the start of a part also goes to the part before."""
    order = [_order(b) for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 23):
            keys = [_order(k) for k in zip(*(batch.column(c).to_pylist() for c in ("missing", "id", "tie")))]
            part = np.array([bisect_right(order, k) for k in keys], np.int32)
            opens = [i for i, k in enumerate(keys) if order[bisect_left(order, k, hi=len(order) - 1)] == k]
            before = np.where(part[opens] == 1, len(order), part[opens] - 1) if opens else np.zeros(0, np.int32)
            rows = pa.array(np.concatenate([np.arange(len(keys)), np.array(opens, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([part, before]).astype(np.int32)),
                    pa.array(np.arange(len(rows)) >= len(keys)),
                    *[batch.column(c).take(rows) for c in ("missing", "id", "tie", "text")],
                ],
                names=["part", "peek", "missing", "id", "tie", "text"],
            )

    return run


def _edit(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _neighbours(kind: pa.DataType, names: int):
    """Per row its own and its edited text's fingerprint, from rows in order, part after part."""

    def results(ids: list, texts: list[str], sketch: list[np.ndarray]) -> pa.RecordBatch:
        """For all rows but the last, which is only a neighbour."""
        edited = [_edit(a, b).encode("utf-8", "surrogateescape") for a, b in zip(texts, texts[1:])]
        others = sketches(edited, names)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], kind),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([shown(s) for s in sketch[:-1]], pa.string()),
                pa.array([shown(s) for s in others], pa.string()),
                pa.array([likeness(a, b, names) for a, b in zip(sketch, others)], pa.float64()),
                pa.array([likeness(a, b, names) for a, b in zip(sketch, sketch[1:])], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before, whose neighbour comes next: (part, id, text, sketch)
        for batch in pieces(batches, "text"):
            part, peek = batch.column("part").to_pylist(), batch.column("peek").to_pylist()
            ids, raw = batch.column("id").to_pylist(), [t or b"" for t in byte_texts(batch.column("text"))]
            texts = [t.decode("utf-8", "surrogateescape") for t in raw]
            sketch = sketches(raw, names)
            lo = 0
            while lo < len(part):
                hi = lo  # rows of one part, with the first row of the part after at the end
                while hi < len(part) and part[hi] == part[lo] and not peek[hi]:
                    hi += 1
                closed = hi < len(part) and part[hi] == part[lo]
                own = [last] if last is not None and last[0] == part[lo] else []
                rows = own + [(part[i], ids[i], texts[i], sketch[i]) for i in range(lo, hi + closed)]
                if len(rows) > 1:
                    yield results([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
                last = None if closed else rows[-1] if rows else None
                lo = hi
                while lo < len(part) and peek[lo]:
                    lo += 1

    return run


def with_neighbours(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: int = NAMES, parts: int | None = None
) -> DataFrame:
    """Every text's fingerprint against its next neighbour's and against a text mixed of both.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for
    every row. The next document is that of the next larger id, after the last one the first;
    null ids come last, rows of one id in the order of a hash of their texts. The edited text has
    its last quarter of code points (rounded down) replaced by the first as many of the next
    document, or all of it. The texts move once, by ranges of the order; the first row of a
    range also goes to the range before. Equal rows (id and text) meet in one task. One document
    is its own neighbour; no document gives no row.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    text = F.coalesce(_C(text_col).cast("string"), F.lit(""))
    keyed = docs.select(_C(id_col).isNull().alias("missing"), _C(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    bounds = _part_starts(keyed, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = [("part", T.IntegerType()), ("peek", T.BooleanType()), ("missing", T.BooleanType()), ("id", kind),
              ("tie", T.LongType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    columns = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
               ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    out = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in columns]])
    if not bounds:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    dealt = keyed.mapInArrow(_deal(bounds, to_arrow_type(kind)), schema)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "peek", "missing", "id", "tie")
    return dealt.mapInArrow(_neighbours(to_arrow_type(kind), names), out).withColumnRenamed("id", id_col)
