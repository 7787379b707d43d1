"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits agree, but for
a small Hamming ball, in at least one segment: with r bits and m segments, the first
``r - m * (r // m) + 1`` segments are searched with radius ``r // m``, the others with one
less. Each fingerprint asks for the members of its balls, the table answers with an equi-join
on (segment, value), and the join condition verifies the whole distance, so only true links
leave the join. Equal fingerprints are one entry of the table, so thousands of copies cost one
row there.

Nulls and empty texts have fingerprint zero and link like any other. A row whose id is null
gets its fingerprint and a null component, and links nothing. Repeated rows with one id are
returned as often as they came. No document gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import byte_texts, stored, text_digest
from vozmill.llm.components import components

_C = F.col
BITS = 64
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes. A-Z count as a-z."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    starts = np.cumsum([0] + [len(t) + 1 for t in tokens]).tolist()
    n = max(len(tokens) - shingle + 1, 1)
    width = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[starts[i] : starts[i + width] - 1], 42) for i in range(n)), dtype="<u8", count=n
    )
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    set_bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=["id", "fingerprint"]
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("fingerprint", T.LongType())])
    return docs.select(_C(id_col).alias("id"), _C(text_col).alias("text")).mapInArrow(run, schema)


def segment_plan(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, search radius) of each segment that has to be searched."""
    bounds = [round(BITS * k / segments) for k in range(segments + 1)]
    radius, rest = divmod(max_bits, segments)
    plan = [(lo, hi - lo, radius if k <= rest else radius - 1) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    return [x for x in plan if x[2] >= 0]


def _balls(plan: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(segment, bits to flip in it) for every member of every ball."""
    return [
        (k, sum(1 << b for b in chosen))
        for k, (_, width, radius) in enumerate(plan)
        for size in range(radius + 1)
        for chosen in combinations(range(width), size)
    ]


def links(table: DataFrame, max_bits: int, segments: int, column: str = "fingerprint") -> DataFrame:
    """(a, b): pairs of different fingerprints at ``max_bits`` bits or fewer; some pairs repeat.

    ``table`` holds each fingerprint once. Of two segment values the smaller one asks, of
    equal ones the smaller fingerprint, which halves the questions.
    """
    plan = segment_plan(max_bits, segments)

    def value(fp: Column, k: int) -> Column:
        start, width, _ = plan[k]
        return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))

    parts = F.array(*[
        F.struct(F.lit(k).alias("segment"), value(_C("fp"), k).alias("value")) for k in range(len(plan))
    ])
    answers = table.select(_C(column).alias("fp")).select(_C("fp").alias("b"), F.explode(parts).alias("part"))
    answers = answers.select("b", "part.segment", "part.value")
    balls: dict[int, list[int]] = {}
    for k, flip in _balls(plan):
        balls.setdefault(k, []).append(flip)

    def ball(k: int, flips: list[int]) -> Column:
        own = value(_C("fp"), k)
        return F.transform(
            F.array(*[F.lit(f).cast("long") for f in flips]),
            lambda f: F.struct(F.lit(k).alias("segment"), own.bitwiseXOR(f).alias("value"), f.alias("flip")),
        )

    asked = F.flatten(F.array(*[ball(k, flips) for k, flips in balls.items()]))
    asked = F.filter(asked, lambda x: x["value"] >= x["value"].bitwiseXOR(x["flip"]))
    questions = table.select(_C(column).alias("fp")).select(_C("fp").alias("a"), F.explode(asked).alias("ask"))
    questions = questions.select("a", "ask.segment", "ask.value", (_C("ask.flip") == 0).alias("same"))
    near = F.bit_count(_C("a").bitwiseXOR(_C("b"))) <= max_bits
    return (
        questions.join(
            answers,
            (questions["segment"] == answers["segment"]) & (questions["value"] == answers["value"])
            & near & (~_C("same") | (_C("a") < _C("b"))),
        )
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 4, max_bits: int = 4, segments: int = 3,
) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id) of every row.

    ``component_id`` is the smallest id that is reached over links of ``max_bits`` bits or
    fewer. ``segments``: three suit up to some hundred million different fingerprints; with two
    the tables have 2^32 values each and twelve times as many questions are asked.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    table = prints.where(_C("id").isNotNull()).groupBy("fingerprint").agg(F.min("id").alias("first"))
    linked = components(links(table, max_bits, segments))
    named = table.join(linked, table["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    named = stored(named)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = named.join(smallest, "component").select("fingerprint", "component_id")
    out = prints.join(whole, "fingerprint", "left")
    return out.select(
        _C("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(_C("id").isNotNull(), _C("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 4, max_bits: int = 4, segments: int = 3,
) -> DataFrame:
    """One row of each group of near copies, with all its columns.

    It is the row with the smallest id; null ids come last and ties go by a digest of the text. Rows
    without an id and repeated rows belong to groups like any other.
    """
    key = F.struct(_C(id_col).isNull().alias("missing"), _C(id_col).alias("id"), text_digest(_C(text_col)).alias("digest"))
    prints = stored(fingerprints(docs.select(key.alias("key"), text_col), "key", text_col, shingle))
    table = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("first")))
    linked = components(links(table, max_bits, segments))
    named = table.join(linked, table["fingerprint"] == linked["node"], "left")
    chosen = named.groupBy(F.coalesce("component", "fingerprint").alias("group")).agg(F.min("first").alias("first"))
    chosen = chosen.select(_C("first.id").alias("id"), _C("first.digest").alias("digest"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    kept = rows.join(chosen, _C("key.id").eqNullSafe(chosen["id"]) & (_C("key.digest") == chosen["digest"]), "left_semi")
    # Rows equal in id and text lie together after the join; one of them stays.
    return kept.groupBy(_C("key.id").alias("id"), _C("key.digest").alias("digest")).agg(F.first("row").alias("row")).select("row.*")
