"""Line dedup: fuzzy lines by MinHash over character shingles.

1. Each line (lower-cased, spaces folded) gets a 128-bit hash and, if it is long enough, MinHash
   values over its byte shingles, cut into bands. Lines that repeat within a batch are banded once.
2. Per band value only a count, the smallest and the largest line hash are summed up, map-side
   first. Values with two different lines or more are buckets.
3. In each bucket every line is compared with the smallest one, by exact Jaccard similarity of
   the shingle sets. Connected components of the verified links follow (union-find as Spark jobs).
4. Lines of a bucket that are still in different components are compared too, so no pair
   that shares a bucket is left open, and groups of copies never become all pairs.
5. Of each component the first line (smallest document, then line) stays; the others go.

Equal lines are one line by their 128-bit hash. Links between different lines use its first 64
bits; texts behind them are compared before they link.

Null and empty texts have no lines; blank lines always stay. A row with a null id keeps its
lines. Rows that share an id are one document: a line is removed from all of them or none.
Lines shorter than a shingle are compared as a whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import byte_texts, pieces, stored
from vozmill.llm.components import components

_C = F.col
SHINGLE, BANDS, ROWS, SEED = 8, 10, 4, 5
#: Lines of a bucket that meet in one task: two blocks of about this many.
BLOCK = 256
#: Shingles that are hashed at a time.
CACHED = 1 << 16


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _codes(raw: bytes, size: int) -> np.ndarray:
    """Each run of ``size`` bytes as one number, 8 at most; the runs overlap in the buffer itself."""
    runs = np.ndarray((len(raw) - size + 1,), "<u8", raw + bytes(8 - size), strides=(1,))
    return runs & np.uint64((1 << 8 * size) - 1)


@lru_cache(maxsize=4096)
def shingles(line: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different shingles as sorted numbers; a shorter line is one shingle. 8 bytes at most."""
    code = np.sort(_codes(line.ljust(size, b"\0"), size))
    return np.concatenate([code[:1], code[1:][code[1:] != code[:-1]]])


def jaccard(a: bytes, b: bytes, size: int = SHINGLE, least: float = 0.0) -> float:
    """Similarity of the shingle sets; 0 where their sizes alone keep it below ``least``."""
    x, y = shingles(a, size), shingles(b, size)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    merged = np.concatenate([x, y])
    merged.sort()
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both / (len(x) + len(y) - both)


def band_values(lines: list[bytes], bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> np.ndarray:
    """One row of band values per line; each line has ``size`` bytes at least, at most 8."""
    count = bands * rows
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    lengths = np.array([len(x) for x in lines])
    raw = b"".join(lines)
    whole = np.ones(len(raw), bool)
    ends = np.cumsum(lengths)
    for back in range(1, size):
        whole[ends - back] = False
    code = _codes(raw, size)
    code = code[whole[: len(code)]]
    mixed = ((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    mixed = mixed.astype(np.uint32)
    stops = np.cumsum(lengths - size + 1)
    starts = stops - (lengths - size + 1)
    least = np.empty((count, len(lines)), np.uint32)
    i = 0
    while i < len(lines):  # a few lines at a time, so that their numbers stay in the processor's cache
        j = max(int(np.searchsorted(stops, starts[i] + CACHED, side="right")), i + 1)
        part, inner = mixed[starts[i] : stops[j - 1]], starts[i:j] - starts[i]
        step = np.empty_like(part)
        for k in range(count):
            np.multiply(part, factors[k], out=step)
            np.add(step, shifts[k], out=step)
            least[k, i:j] = np.minimum.reduceat(step, inner)
        i = j
    out = np.zeros((len(lines), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            value = (value ^ least[k]) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
        out[:, band] = value
    return out


def _signed(halves: list[bytes]) -> np.ndarray:
    """Unsigned numbers of eight bytes each, highest first, moved into the range of signed ones."""
    return (np.frombuffer(b"".join(halves), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def hashed_lines(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, line_no, h1, h2, bands or null) of every line with a word. ``docs``: id, text."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, numbers, digests, at, banded, seen = [], [], [], [], [], set()
            for row, text in enumerate(byte_texts(batch.column("text"))):
                for number, line in enumerate((text or b"").split(b"\n")):
                    line = normal(line)
                    if line:
                        digest = xxhash.xxh3_128_digest(line)
                        if len(line) >= shingle and digest not in seen:
                            seen.add(digest)
                            at.append(len(ids))
                            banded.append(line)
                        ids.append(row)
                        numbers.append(number)
                        digests.append(digest)
            if not ids:
                continue
            without = np.ones(len(ids), bool)
            without[at] = False
            values = band_values(banded, size=shingle).view(np.int64) if banded else np.zeros((0, BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum(~without)]) * BANDS
            bands = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(values.ravel()), type=pa.list_(pa.int64()), mask=pa.array(without)
            )
            halves = _signed(digests).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids)), pa.array(numbers, pa.int32()), pa.array(halves[:, 0].copy()),
                 pa.array(halves[:, 1].copy()), bands],
                names=["id", "line_no", "h1", "h2", "bands"],
            )

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("line_no", T.IntegerType()), T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    return docs.select("id", "text").mapInArrow(run, schema)


def line_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """(line, folded): hash and folded text of the lines that have bands, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = {}
            for text in byte_texts(batch.column("text")):
                for line in map(normal, (text or b"").split(b"\n")):
                    if len(line) >= shingle:
                        found[xxhash.xxh3_128_digest(line)[:8]] = line
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(list(found)), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["line", "folded"]
            )

    return docs.select("text").mapInArrow(run, "line long, folded binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).to_pylist() for k in ("one", "two"))
            good = [jaccard(x, y, shingle, similarity) >= similarity for x, y in zip(one, two)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = texts.select(_C("line").alias("a"), _C("folded").alias("one"))
    two = texts.select(_C("line").alias("b"), _C("folded").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def dealt_blocks(placed: DataFrame) -> DataFrame:
    """(band, x, y, own, line, component): lines of buckets with several components, once per two blocks that meet.

    A component larger than a block has blocks of its own, which do not meet each other; smaller ones
    share blocks. So a bucket of many lines of one component and some others costs their product,
    not its square.
    """
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    large = _C("n") > BLOCK
    state = sizes.groupBy("band").agg(
        F.count("*").alias("components"),
        F.ceil(F.coalesce(F.sum(F.when(~large, _C("n"))), F.lit(0)) / BLOCK).cast("int").alias("shared"),
        # Large components have a block at least, so the list is no longer than the bucket's blocks.
        F.array_sort(F.collect_list(F.when(large, F.struct("component", F.ceil(_C("n") / BLOCK).cast("int").alias("k"))))).alias("large"),
    ).where(_C("components") > 1)
    at = F.array_position(F.transform("large", lambda x: x["component"]), _C("component")).cast("int")
    before = F.aggregate(F.slice("large", 1, F.greatest(at - 1, F.lit(0))), _C("shared"), lambda s, x: s + x["k"])
    total = F.aggregate("large", _C("shared"), lambda s, x: s + x["k"])
    many = F.when(at > 0, F.get("large", at - 1)["k"]).otherwise(0)
    first = F.when(at > 0, before).otherwise(0)
    # The places of a line do not grow with its own component: they are worked out once per (band, component).
    plan = sizes.join(state, "band").select(
        "band", "component", first.alias("first"), many.alias("many"),
        F.when(at > 0, many).otherwise(_C("shared")).alias("own_blocks"),
        F.filter(F.sequence(F.lit(0), total - 1), lambda b: (b < first) | (b >= first + many)).alias("others"),
    )
    spread = F.when(_C("many") > 0, _C("line")).otherwise(_C("component"))
    own = _C("first") + F.pmod(F.xxhash64(spread), _C("own_blocks")).cast("int")
    dealt = placed.join(stored(plan), ["band", "component"]).withColumn("own", own).withColumn("other", F.explode("others"))
    return dealt.select(
        "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "line", "component"
    )


def open_links(placed: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): verified links between lines of one bucket that are in different components.

    ``placed``: band, line, component. A bucket is dealt in blocks, and each two blocks that can hold
    lines of different components meet in one group of bounded size. Pairs are formed and tested
    inside the group, each in the first bucket that its lines share; only links that join components
    leave it.
    """
    dealt = dealt_blocks(placed).join(texts, "line")
    dealt = dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches, "folded"):
            texts = batch.column("folded").to_pylist()
            bands = band_values(texts, size=shingle).view(np.int64)
            fields = (batch.column(k).to_pylist() for k in ("band", "x", "y", "own", "line", "component"))
            yield from zip(*fields, texts, bands)

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        band, x, y = group[0][:3]
        bands = np.array([r[7] for r in group])
        side = np.array([r[3] for r in group])
        component = np.array([r[5] for r in group], np.int64)
        here = int(np.flatnonzero((bands == band).all(0))[0])
        for i, row in enumerate(group):
            able = component[i + 1 :] != component[i]
            if x != y:
                able &= side[i + 1 :] != side[i]
            able &= ~(bands[i + 1 :, :here] == bands[i, :here]).any(1)
            for j in (np.flatnonzero(able) + i + 1).tolist():
                if component[i] != component[j] and jaccard(row[6], group[j][6], shingle, similarity) >= similarity:
                    component[component == component[j]] = component[i]
                    yield row[4], group[j][4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            found = list(links(list(group)))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select("band", "x", "y", "own", "line", "component", "folded").mapInArrow(run, "a long, b long")


def linked_lines(docs: DataFrame, lines: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, component) of the lines that are similar to others."""
    bands = lines.where(_C("bands").isNotNull()).select(F.explode("bands").alias("band"), _C("h1").alias("line"))
    buckets = stored(
        bands.groupBy("band").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"))
        .where(_C("low") < _C("high"))
    )
    # Hashed joins here and below: the hinted sides hold narrow rows of different keys, so they deal
    # out evenly, and the wide or many rows of the other side need no sort.
    large = buckets.where(_C("n") > 2).select("band", "low")
    members = stored(bands.join(large.hint("shuffle_hash"), "band").distinct())
    stars = buckets.where(_C("n") == 2).select(_C("low").alias("a"), _C("high").alias("b")).union(
        members.where(_C("line") != _C("low")).select(_C("low").alias("a"), _C("line").alias("b"))
    )
    pairs = stored(stars.distinct())
    wanted = pairs.select(_C("a").alias("line")).union(pairs.select(_C("b").alias("line"))).distinct()
    texts = stored(line_texts(docs, shingle).join(wanted.hint("shuffle_hash"), "line").dropDuplicates(["line"]))
    links = stored(verified(pairs, texts, similarity, shingle))
    found = components(links)
    placed = members.where(_C("line") != _C("low")).join(found, members["line"] == found["node"], "left").select(
        "band", "line", F.coalesce("component", "line").alias("component")
    )
    placed = stored(placed)
    more = stored(open_links(placed, texts, similarity, shingle))
    if more.isEmpty():
        return found
    return components(links.union(more))


def removed_lines(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(id, lines): the numbers of the lines that go, per document. ``docs``: id, text."""
    lines = stored(hashed_lines(docs, shingle))
    found = linked_lines(docs, lines, similarity, shingle)
    placed = lines.select("id", "line_no", "h1", "h2").join(
        found.hint("shuffle_hash"), lines["h1"] == found["node"], "left"
    ).select(
        "id", "line_no", F.coalesce("component", "h1").alias("g1"),
        F.when(_C("component").isNull(), _C("h2")).otherwise(0).alias("g2"),
    )
    placed = stored(placed)
    # A group is one row per task before it is dealt out. Stored, both sides of the join come straight
    # from an exchange, so adaptive execution can split the lines of a frequent group.
    groups = stored(placed.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(_C("n") > 1))
    repeated = placed.join(groups.hint("shuffle_hash"), ["g1", "g2"]).select(
        "id", "g1", "g2", "line_no", (_C("id") == _C("first_id")).alias("own")
    )
    # One exchange serves both groupings: the lines of a document lie together.
    per_group = repeated.repartition("id").groupBy("id", "g1", "g2", "own").agg(F.collect_set("line_no").alias("nos"))
    gone = F.when(_C("own"), F.array_except("nos", F.array(F.array_min("nos")))).otherwise(_C("nos"))
    per_document = per_group.select("id", gone.alias("gone")).where(F.size("gone") > 0)
    return per_document.groupBy("id").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = SHINGLE,
    count_col: str | None = "n_removed",
) -> DataFrame:
    """All columns of ``docs`` with the repeated lines taken out of the text, and their number in front.

    ``shingle``: bytes of a shingle, 8 at most. ``count_col`` names the number (None: none); a table that has
    such a column already is an error.
    """
    if count_col in docs.columns:
        raise ValueError(f"the table has a column {count_col} already; name another one")
    base = docs.select(_C(id_col).alias("id"), _C(text_col).alias("text")).where(_C("id").isNotNull())
    gone = removed_lines(base, similarity, shingle).select(_C("id").alias("__id"), _C("gone").alias("__gone"))
    # As one column, the table's own names cannot meet those of the join.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    joined = rows.join(gone.hint("shuffle_hash"), _C("__row")[id_col] == _C("__id"), "left")
    own = _C("__row")[text_col]
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    text = F.when(_C("__gone").isNull(), own).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(_C("__lines"), i)), "\n")
    )
    out = joined.withColumn("__lines", F.when(_C("__gone").isNotNull(), F.split(own, "\n")))
    columns = [(text if c == text_col else _C("__row")[c]).alias(c) for c in docs.columns]
    count = F.when(_C("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return out.select(*([count.alias(count_col)] if count_col else []), *columns)
