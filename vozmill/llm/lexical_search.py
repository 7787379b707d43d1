"""Ranked lexical search by the Best Position Algorithm.

The texts are read once per block of items: a task finds the items' terms in its documents and
writes each document's counts of them. Counts over all documents follow from that table. Then
documents are searched in shards that hold a bounded number of counts: a shard keeps one
impact list per term, sorted by falling impact. An item reads its lists from the top, all to the
same depth. Every document met is looked up in all other lists (direct access), which also
tells its position there. The best position of a list is the end of its unbroken run of seen
positions, however it was seen; no unseen document can score more than the weighted sum of the
impacts that follow the best positions. An item stops in a shard when this sum is strictly
below its k-th best score so far, over all shards of the task, so ties at the k-th place are
always seen. The best of all tasks are merged by a window that is cut within each task.

A null text or one without terms is no document that ranks; it does not count in N. A null id
ranks after all others of the same score; repeated rows rank one by one. Items that share an id
(null too) are one item with the terms of all. Items without terms, and empty tables, give no row. Extra
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vozmill.llm.common import pieces, stored
from vozmill.llm.tokens import kinds, split_words

_C = F.col
TABLE = kinds(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Pairs of an item and a term that one pass over the texts serves; they are sent to all tasks.
BLOCK_PAIRS = 1 << 18
#: Counts (document, term) of a shard.
SHARD_COUNTS = 1 << 21
#: Depth of the first round of sorted accesses; every further round doubles it.
FIRST_DEPTH = 64


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the different terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = split_words(batch.column("text"), TABLE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(found.row)), found.words.cast(pa.string())], names=["item", "term"]
            )

    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("term", T.StringType())])
    chosen = items.select(_C(id_col).alias("item"), _C(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).distinct()


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, n, terms, counts) of every document: all its terms, and those of the list by their place in it."""
    listed = pa.array(terms, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 22):
            found = split_words(batch.column("text"), TABLE)
            encoded = found.words.dictionary_encode()
            places = pc.fill_null(pc.index_in(encoded.dictionary, value_set=listed), -1).to_numpy()
            places = places[encoded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64)
            held = places >= 0
            key, counts = np.unique(found.row[held] * len(terms) + places[held], return_counts=True)
            bounds = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(terms)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array(np.bincount(found.row, minlength=batch.num_rows)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array((key % len(terms)).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.astype(np.int32))),
            ], names=["id", "n", "terms", "counts"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])
    return docs.select(_C(id_col).alias("id"), _C(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class ImpactLists:
    """The impact lists of one shard, with direct access by document and term."""

    def __init__(self, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int, docs: int, total: int):
        m = 50 + 50 * n * docs // total
        impact = 1_000_000_000 * counts // (1000 * counts + 20 * m[rows])
        order = np.lexsort((-impact, terms))
        self.n_rows, self.width = len(n), width
        self.rows, self.impact = rows[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(width + 1))
        self.keys = rows * width + terms  # ascending: documents in order, terms in order within each
        self.places = np.empty(len(order), np.int64)
        self.places[order] = np.arange(len(order))

    def direct(self, rows: np.ndarray, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ascending ``rows`` hold the term, and their places in the list."""
        keys = rows * self.width + term
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        held = self.keys[at] == keys
        return held, self.places[at[held]]

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents that can be among the ``top`` best; ``least`` is a k-th score already had."""
        lists = [(t, int(w), int(self.bounds[t]), int(self.bounds[t + 1])) for t, w in zip(terms, weights)]
        lists = [x for x in lists if x[1] > 0 and x[2] < x[3]]
        met = np.zeros(self.n_rows, bool)
        scores = np.zeros(self.n_rows, np.int64)
        seen = [np.zeros(hi - lo + 1, bool) for _, _, lo, hi in lists]  # one place more, never seen
        run = [0] * len(lists)  # best positions
        start, depth, longest = 0, FIRST_DEPTH, max((hi - lo for _, _, lo, hi in lists), default=0)
        while start < longest:
            fresh = np.concatenate([self.rows[lo + start : min(lo + depth, hi)] for _, _, lo, hi in lists])
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            limit = 0
            for j, (term, weight, lo, hi) in enumerate(lists):
                held, places = self.direct(fresh, term)
                scores[fresh[held]] += weight * self.impact[places]
                seen[j][places - lo] = True
                run[j] += int(np.argmin(seen[j][run[j] :]))
                if lo + run[j] < hi:
                    limit += weight * int(self.impact[lo + run[j]])
            had = scores[met]
            kth = int(np.partition(had, -top)[-top]) if len(had) >= top else 0
            if limit < max(kth, least):
                break
            start, depth = depth, 2 * depth
        rows = np.flatnonzero(met & (scores >= max(least, 1)))
        return rows, scores[rows]


def _shard_search(asked: list[tuple[np.ndarray, np.ndarray]], width: int, docs: int, total: int, top: int, ids: pa.DataType, shard_counts: int):
    """Per task the ``top`` best documents of every item: (place of the item, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]  # (-score, id is null, id), ascending
        held: list[pa.RecordBatch] = []
        size = 0

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n = table.column("n").to_numpy()
            terms = table.column("terms").combine_chunks()
            lengths = np.diff(terms.offsets.to_numpy())
            flat = terms.flatten().to_numpy().astype(np.int64)
            counts = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            lists = ImpactLists(n, np.repeat(np.arange(len(n)), lengths), flat, counts, width, docs, total)
            names = table.column("id")
            rank = np.empty(len(n), np.int64)
            rank[pc.sort_indices(names, null_placement="at_end").to_numpy()] = np.arange(len(n))
            for i, (codes, weights) in enumerate(asked):
                least = -best[i][-1][0] if len(best[i]) == top else 0
                rows, scores = lists.best(codes, weights, top, least)
                order = np.lexsort((rank[rows], -scores))[:top]
                found = names.take(pa.array(rows[order])).to_pylist()
                more = [(-int(s), d is None, d) for s, d in zip(scores[order], found)]
                best[i] = sorted(best[i] + more, key=lambda x: x if x[2] is not None else x[:2])[:top]

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                held.append(part)
                size += pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0
                if size >= shard_counts:
                    search()
                    size = 0
        if held:
            search()
        flat = [(i, d, -s) for i, rows in enumerate(best) for s, _, d in rows]
        if flat:
            places, found, scores = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array(found, ids), pa.array(scores, pa.int64())],
                names=["place", "id", "score"],
            )

    return run


def _search_block(
    docs: DataFrame, id_col: str, text_col: str, items: dict, kind: T.DataType, top: int, shard_counts: int
) -> DataFrame:
    """(item, id, score): the best documents of each task for the items, which map an id to its terms."""
    spark = docs.sparkSession
    terms = sorted({t for listed in items.values() for t in listed})
    place = {t: i for i, t in enumerate(terms)}
    counts = stored(term_counts(docs, id_col, text_col, terms))
    n_docs, total, n_counts = counts.agg(
        F.count_if(_C("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))
    ).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * _C("df") + 1)
    weights = np.zeros(len(terms), np.int64)
    for r in held.select("term", F.floor(1000 * F.log(ratio)).alias("w")).collect():  # bounded by BLOCK_PAIRS
        weights[r["term"]] = r["w"]
    asked = []
    for listed in items.values():
        codes = np.array(sorted(place[t] for t in listed), np.int64)
        asked.append((codes, weights[codes]))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("place", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())
    ])
    search = _shard_search(asked, len(terms), n_docs, max(total, 1), top, to_arrow_type(id_type), shard_counts)
    # The counts are small beside the work on them: deal them out, so that a task has about one shard.
    dealt = counts.where(F.size("terms") > 0).repartition(max(1, math.ceil(n_counts / shard_counts)))
    found = dealt.mapInArrow(search, schema)
    numbers = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("item", kind)])
    names = spark.createDataFrame(list(enumerate(items)), numbers)
    return found.join(names, "place").select("item", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", top: int = 50, block_pairs: int = BLOCK_PAIRS, shard_counts: int = SHARD_COUNTS,
) -> DataFrame:
    """(item_id_col, rank, id_col, score): the ``top`` best documents with a score above 0 of every item."""
    asked = stored(item_terms(items, item_id_col, item_text_col))
    n_blocks = max(1, math.ceil(asked.count() / block_pairs))
    kind = items.schema[item_id_col].dataType
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        listed = asked.where(block == b).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        if listed:
            part = _search_block(
                docs, id_col, text_col, {r["item"]: r["terms"] for r in listed}, kind, top, shard_counts
            )
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([
            T.StructField("item", kind), T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())
        ])
        found = docs.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("item").orderBy(_C("score").desc(), _C("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(_C("rank") <= top)
    return ranked.select(_C("item").alias(item_id_col), "rank", _C("id").alias(id_col), "score")
