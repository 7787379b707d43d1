"""Phrase collocations by set-oriented mining over stored relations.

Level 1 is the relation of word occurrences, sorted by piece and position and written once, in
blocks: a block holds whole runs of words of one language, each word as a number into the
block's word list. A run of more than a block's words is cut; the part before the cut also
shows the words that follow it, as words in which no phrase of that part starts.

Level k joins the relation of level k-1 with itself where the piece is the same and the second
phrase starts at the next position. Both sides lie sorted in the same block, so this is a merge
without an exchange. A block sends each of its groups once, with a count; one exchange by group
adds the counts up, and the frequent groups go back to the blocks that hold them (a semi-join),
which then extend only those. A task holds one block at a time: blocks are stored in row groups
of their own and meet the groups that come back as co-groups. A phrase of k words is as frequent as it only if both its parts of
k-1 words are, so nothing is lost. Groups are compared as words or as numbers given to whole
words, never as hashes.

A null text has no words, a null language counts as ``und``, ids and other columns play no
part; repeated rows count as often as they come. An empty table gives no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill.llm.common import pieces, stored
from vozmill.llm.tokens import kinds, split_words

_C = F.col
TABLE = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
SLOT_BITS, SERIAL_BITS, TASK_BITS = 22, 20, 21
#: Words of a block; their numbers stay below 2**SLOT_BITS.
BLOCK_WORDS = 1 << 20
#: Parts of a language's list that are ranked before the whole.
PARTS = 64
_BLOCK = "block long, lang string, words array<string>, counts array<long>, codes binary, width int, runs binary, ahead int"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that are sorted by block at once before they go back.
_RETURNED = 1 << 20


def _cut(words: pa.Array, runs: np.ndarray, most: int, reach: int) -> Iterator[dict]:
    """Blocks of at most ``most`` words, each with up to ``reach`` words of the run that goes on."""
    encoded = words.dictionary_encode()
    codes, listed = encoded.indices.to_numpy().astype(np.int32), encoded.dictionary
    ends = np.cumsum(runs)
    for lo in range(0, len(codes), most):
        hi = min(lo + most, len(codes))
        run = np.searchsorted(ends, hi, side="left")  # the run that holds word hi - 1
        stop = min(hi + reach, int(ends[run]))
        inner = ends[(ends > lo) & (ends < stop)]
        part, used = codes[lo:stop], listed
        if len(codes) > most:
            kept, part = np.unique(part, return_inverse=True)
            part, used = part.astype(np.int32), listed.take(pa.array(kept))
        part = part.astype(np.uint16 if len(used) <= 1 << 16 else np.int32)
        yield {
            "words": used.cast(pa.string()), "codes": part, "ahead": stop - hi,
            "counts": np.bincount(part[: hi - lo], minlength=len(used)),
            "runs": np.diff(inner, prepend=lo, append=stop).astype(np.int32),
        }


def _list(values: pa.Array | np.ndarray) -> pa.Array:
    """A column of one row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column; row i holds the values from bounds[i] to bounds[i + 1]."""
    ends = (bounds * values.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def _kept(df: DataFrame, **options: int) -> DataFrame:
    """The table stored; its shuffle files go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        return stored(df, **options)
    finally:
        if before is None:
            conf.unset(_TIDY)
        else:
            conf.set(_TIDY, before)


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a binary column, in its order."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, kind)


def occurrences(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The sorted relation of all word occurrences, in blocks."""
    if not 0 < block_words + max_words <= 1 << SLOT_BITS:
        raise ValueError(f"block_words and max_words have to stay below 2**{SLOT_BITS} together")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            for lang, parts in held.items():
                words = pa.concat_arrays([w for w, _ in parts])
                for block in _cut(words, np.concatenate([r for _, r in parts]), block_words, max_words - 1):
                    if task >> TASK_BITS or serial >> SERIAL_BITS:
                        raise ValueError("too many tasks or blocks of a task for the numbers of words")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([task << SERIAL_BITS | serial], pa.int64()), pa.array([lang]),
                        *[_list(block[name]) for name in ("words", "counts")],
                        pa.array([pa.compress(np.ascontiguousarray(block["codes"]), "zstd").to_pybytes()]),
                        pa.array([block["codes"].itemsize], pa.int32()),
                        _packed(block["runs"], np.array([0, len(block["runs"])])), pa.array([block["ahead"]], pa.int32()),
                    ], names=["block", "lang", "words", "counts", "codes", "width", "runs", "ahead"])
                    serial += 1
            held.clear()

        for batch in pieces(batches, "text", 1 << 21):
            langs = batch.column("lang").fill_null("und").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pa.compute.equal(langs.indices, i))
                found = split_words(texts, TABLE)
                if not len(found.words):
                    continue
                starts = np.flatnonzero(np.diff(found.piece, prepend=-1))
                held.setdefault(lang, []).append((found.words, np.diff(starts, append=len(found.piece))))
                total += len(found.words)
            if total >= block_words:
                yield from flush()
                total = 0
        yield from flush()

    chosen = docs.select(_C(text_col).cast("string").alias("text"), _C(lang_col).cast("string").alias("lang"))
    return chosen.mapInArrow(run, _BLOCK)


def _frequent(groups: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """Group rows of all blocks whose group is frequent, with its count ``f``: counts and semi-join.

    A block sends a group once, so the busiest group has a row per block, not per occurrence.
    """
    whole = Window.partitionBy(*keys)
    return groups.withColumn("f", F.sum("n").over(whole)).where(_C("f") >= min_count)


def _words_of(blocks: DataFrame, min_count: int) -> DataFrame:
    """(block, slot, lang, word, f, term): frequent words; ``term`` is the smallest place of one."""
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("slot", "entry"))
    listed = listed.select("block", "slot", "lang", _C("entry.words").alias("word"), _C("entry.counts").alias("n"))
    place = F.shiftleft("block", SLOT_BITS).bitwiseOR(_C("slot").cast("long"))
    keys = ["lang", "word"]
    named = listed.withColumn("term", F.min(place).over(Window.partitionBy(*keys)))
    return _frequent(named, keys, min_count).drop("n")


def _returned(found: DataFrame, level: int) -> DataFrame:
    """(block, level, slots, terms): frequent groups of a length, some of a block's in a row; ``terms`` of words only."""
    names = ["block", "slot", "term"][: 3 if level == 1 else 2]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, *values = [np.concatenate([b.column(name).to_numpy() for b in held]) for name in names]
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        bounds = np.append(starts, len(block))
        packs = [_packed(value[order], bounds) for value in values]
        if level > 1:
            packs.append(pa.nulls(len(starts), pa.binary()))
        columns = [pa.array(block[starts]), pa.array(np.full(len(starts), level, np.int32)), *packs]
        return pa.RecordBatch.from_arrays(columns, names=["block", "level", "slots", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= _RETURNED:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    return found.select(*names).mapInArrow(run, "block long, level int, slots binary, terms binary")


def _extend(level: int, names: list[str]):
    """Groups of ``level`` words of a block, from the frequent ones of all levels below."""
    schema = pa.schema([(name, pa.int32() if name == "slot" else pa.int64()) for name in names])

    def known(answers: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the frequent groups of ``k`` words, sorted, and the terms of single words."""
        rows = answers.filter(pa.compute.equal(answers.column("level"), k))
        slots = _unpacked(rows.column("slots"), np.int32)
        if k > 1:
            return np.sort(slots), np.zeros(0, np.int64)
        order = np.argsort(slots)
        return slots[order], _unpacked(rows.column("terms"), np.int64)[order]

    def batches(block: int, row: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        runs = _unpacked(row.column("runs"), np.int32)
        total = int(runs.sum())
        size = row.column("width")[0].as_py()
        codes = pa.decompress(row.column("codes")[0].as_buffer(), total * size, "zstd")
        codes = np.frombuffer(codes, np.uint16 if size == 2 else np.int32)
        own = total - row.column("ahead")[0].as_py()
        listed, numbers = known(answers, 1)
        width = len(listed)
        terms = np.full(int(codes.max()) + 1, -1, np.int64)
        terms[listed] = numbers
        rank = np.full(len(terms), -1, np.int32)
        rank[listed] = np.arange(width, dtype=np.int32)
        words = rank[codes]
        joint = np.ones(total, bool)  # the next position belongs to the same piece
        joint[np.cumsum(runs) - 1] = False
        label = words
        for k in range(2, level + 1):
            here = np.flatnonzero((label[:-1] >= 0) & (label[1:] >= 0) & joint[:-1])
            key = label[here].astype(np.int64) * width + words[here + k - 1]
            found, first, which = np.unique(key, return_index=True, return_inverse=True)
            del key
            if k < level:
                slots = known(answers, k)[0]
                kept = np.full(len(found), -1, np.int32)
                kept[slots] = np.arange(len(slots), dtype=np.int32)
                label = np.full(total, -1, np.int32)
                label[here] = kept[which]
        counts = np.bincount(which[here < own], minlength=len(found))
        at = here[first]
        del here, which, first, label, words
        for lo in range(0, len(found), 1 << 16):
            hi = min(lo + (1 << 16), len(found))
            columns = {"block": np.full(hi - lo, block), "slot": np.arange(lo, hi, dtype=np.int32), "n": counts[lo:hi]}
            columns |= {f"t{j + 1}": terms[codes[at[lo:hi] + j]] for j in range(level)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[name]) for name in names], schema=schema)

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows or not answers.num_rows:
            return schema.empty_table()
        return pa.Table.from_batches(batches(row.column("block")[0].as_py(), row, answers), schema)

    return run


def frequent_groups(blocks: DataFrame, max_words: int, min_count: int) -> list[DataFrame]:
    """Per length 1 to ``max_words``, the frequent phrases: (t1, ..., f); of length 1 also lang, word."""
    words = _kept(_words_of(blocks, min_count))
    answers = _returned(words, 1)
    relation = blocks.select("block", "codes", "width", "runs", "ahead").groupBy("block")
    own = F.shiftleft("block", SLOT_BITS).bitwiseOR(_C("slot").cast("long"))
    tables = [words.where(own == _C("term")).select(_C("term").alias("t1"), "lang", "word", "f")]
    for level in range(2, max_words + 1):
        keys = [f"t{j}" for j in range(1, level + 1)]
        names = [*keys, "n"] if level == max_words else ["block", "slot", *keys, "n"]
        schema = ", ".join(f"{name} {'int' if name == 'slot' else 'long'}" for name in names)
        groups = relation.cogroup(answers.groupBy("block")).applyInArrow(_extend(level, names), schema)
        if level == max_words:  # nothing is extended after it, so only the counts matter
            counted = groups.groupBy(*keys).agg(F.sum("n").alias("f")).where(_C("f") >= min_count)
            tables.append(_kept(counted))
            continue
        found = _kept(_frequent(groups, keys, min_count).drop("n"))
        tables.append(found.select(*keys, "f").distinct())
        answers = answers.unionByName(_returned(found, level))
    return tables


def _scored(tables: list[DataFrame], length: int) -> DataFrame:
    """Candidates of one length with the cut that scores least: (t1, ..., a, l, r, score)."""
    keys = [f"t{j}" for j in range(1, length + 1)]
    out = tables[length - 1].select(*keys, _C("f").alias("a"))
    cuts = []
    for k in range(1, length):
        for side, part in (("l", keys[:k]), ("r", keys[k:])):
            counts = tables[len(part) - 1].select(
                *[_C(f"t{j}").alias(key) for j, key in enumerate(part, 1)], _C("f").alias(f"{side}{k}")
            )
            out = out.join(counts, part)
        cuts.append(F.struct(_score(_C("a"), _C(f"l{k}"), _C(f"r{k}")).alias("score"), F.lit(k).alias("k"), f"l{k}", f"r{k}"))
    named = [c.cast("struct<score:long,k:int,l:long,r:long>") for c in cuts]
    best = F.least(*named) if len(named) > 1 else named[0]
    out = out.withColumn("best", best)
    return out.select(*keys, "a", _C("best.l").alias("l"), _C("best.r").alias("r"), _C("best.score").alias("score"))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    wide = [c.cast("decimal(15,0)") for c in (a, l, r)]
    square = (wide[0] * wide[0]).cast("decimal(31,0)")
    return F.call_function(
        "div", (square * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(31,0)")
    )


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
    held_percent: int = 50, top: int | None = 2000, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``max_words`` words, best first.

    ``a`` counts the phrase; of its cuts the one with the smallest score
    floor(1000000 * a * a / (l * r)) counts, ``l`` and ``r`` being the counts of its two parts; ``n``
    counts all words of the language. Left out are phrases inside a longer one that occurs at least
    ``held_percent`` percent as often. ``top`` bounds the list of a language (None: no bound).
    """
    if max_words < 2:
        raise ValueError("max_words has to be 2 or more")
    blocks = _kept(occurrences(docs, text_col, lang_col, max_words, block_words), **{"parquet.block.row.count.limit": 1})
    tables = frequent_groups(blocks, max_words, min_count)
    terms = tables[0].select(_C("t1").alias("term"), "lang", "word")
    sizes = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    sizes = sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    shown = []
    for length in range(2, max_words + 1):
        keys = [f"t{j}" for j in range(1, length + 1)]
        out = _scored(tables, length)
        holders = [
            tables[longer - 1].select(*[_C(f"t{at + j}").alias(keys[j]) for j in range(length)], "f")
            for longer in range(length + 1, max_words + 1) for at in range(1, longer - length + 2)
        ]
        if holders:
            held = holders[0]
            for other in holders[1:]:
                held = held.unionByName(other)
            held = held.groupBy(*keys).agg(F.max("f").alias("held"))
            out = out.join(held, keys, "left")
            out = out.where(_C("held").isNull() | (100 * _C("held") < held_percent * _C("a"))).drop("held")
        for j, key in enumerate(keys, 1):
            named = terms.withColumnsRenamed({"term": key, "word": f"w{j}"})
            out = out.join(named if j == 1 else named.drop("lang"), key)
        phrase = F.concat_ws(" ", *[f"w{j}" for j in range(1, length + 1)])
        shown.append(out.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"))
    out = shown[0]
    for other in shown[1:]:
        out = out.unionByName(other)
    order = (_C("score").desc(), _C("a").desc(), _C("phrase"))
    if top is not None:  # a language's list is cut in parts first, so that none is sorted whole in one task
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        out = out.withColumn("rank", F.row_number().over(part)).where(_C("rank") <= top).drop("rank")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        out = out.where(_C("rank") <= top)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
