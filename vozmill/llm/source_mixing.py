"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

All words of a mix are blocks of equal size. Sources get blocks by the highest quotients
``weight / (2 * blocks + 1)``, then each source's blocks go to its shards the same way, in
proportion to their words. Inside a shard, documents stand in a seeded order, and the mix
takes a run of its quota of blocks from a seeded block on, round and round: each full round
takes every document once, the rest takes the documents under the run. Runs keep documents
whole but for the two at their ends.

Only source and shard rows are ranked globally or within a source, which bounds them by the number of
sources and of shards; documents are ordered inside a shard, which holds about ``shard_words`` words and
``shard_rows`` rows at most however large its source is (rows equal in id and size lie together).

Nulls: a null source is a source (ordered last), a null text has size 0. Empty texts take
nothing. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill.llm.common import seeded, stored, words

_C = F.col


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    ``share`` of all words is dealt by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight.
    """
    order = Window.orderBy(_C("source").asc_nulls_last())
    weighted = sources.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(_C("rank") - 1, F.lit(len(weights))) + 1)
    ).withColumn("limit", _C("source_size") * cap)
    # By rising limit per weight: those before a source are full when its own turn comes.
    by_limit = Window.orderBy(_C("limit") / _C("weight"), "rank")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / F.sum("weight").over(rest)
    )
    filled = weighted.withColumn("turn", F.row_number().over(by_limit)).withColumn("level", level)
    filled = filled.withColumn("full", _C("limit") / _C("weight") <= _C("level"))
    final = F.min(F.when(~_C("full"), F.struct("turn", "level"))).over(everything)["level"]
    return filled.withColumn("final", final).select(
        "source", "source_size",
        F.when(_C("full"), _C("limit").cast("double")).otherwise(_C("weight") * _C("final")).alias("target"),
    )


def apportion(parties: DataFrame, group: list[str], order: list[Column], weight: str, seats: str) -> DataFrame:
    """Adds ``won``: the ``seats`` of a group dealt to its parties by highest quotients.

    A party surely wins what it would win of somewhat fewer seats by rounding; only the next
    few quotients of each are ranked, about three rows per party.
    """
    w = Window.partitionBy(*group)
    base = parties.withColumns({"__n": F.count("*").over(w), "__sum": F.sum(_C(weight).cast("double")).over(w)})
    per_seat = _C(weight) / _C("__sum")
    sure = F.when(
        _C("__sum") > 0, F.greatest(F.lit(0), F.floor(per_seat * (_C(seats) - _C("__n") / 2 - 1) + 0.5))
    ).otherwise(0).cast("long")
    base = base.withColumn("__sure", sure)
    base = base.withColumn("__left", F.when(_C("__sum") > 0, _C(seats)).otherwise(0) - F.sum("__sure").over(w))
    more = F.when(_C("__sum") > 0, F.ceil(per_seat * (_C("__n") + 2)) + 1).otherwise(0)
    ranked = base.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), more.cast("long"))))
    quotient = _C(weight) / (2 * (_C("__sure") + _C("__k")) + 1)
    rank = F.row_number().over(w.orderBy(quotient.desc(), *order, _C("__k")))
    ranked = ranked.withColumn("__wins", (rank <= _C("__left")).cast("long"))
    return ranked.groupBy(*parties.columns).agg((F.first("__sure") + F.sum("__wins")).alias("won"))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2,
    block_words: int = 16, shard_words: int = 4_000_000, shard_rows: int = 1_000_000, seed: int = 42,
) -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row.

    ``weights`` repeat over the sources in code point order. ``taken`` counts repeats and never
    exceeds ``cap`` times the size.
    """
    narrow = docs.select(_C(id_col).alias("id"), _C(source_col).alias("source"), _size(text_col))
    sized = stored(narrow)
    dealt = _dealt(sized, sized, weights, share, cap, block_words, shard_words, shard_rows, seed)
    return dealt.select(_C("id").alias(id_col), "size", "source_size", "target", "taken")


def mix_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2,
    block_words: int = 16, shard_words: int = 4_000_000, shard_rows: int = 1_000_000, seed: int = 42,
) -> DataFrame:
    """The rows of which the mix takes words, with all their columns and those of :func:`mix`.

    Whole rows go through the mix, so neither null nor repeated ids matter. A column of the mix
    whose name ``docs`` has already gets ``mix_`` before it.
    """
    columns = [_C(id_col).alias("id"), _C(source_col).alias("source"), _size(text_col)]
    rows = docs.select(*columns, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    dealt = _dealt(stored(docs.select(*columns)), rows, weights, share, cap, block_words, shard_words, shard_rows, seed)
    names = {}
    for name in ("size", "source_size", "target", "taken"):
        names[name] = name
        while names[name] in docs.columns or list(names.values()).count(names[name]) > 1:
            names[name] = "mix_" + names[name]
    return dealt.where(_C("taken") > 0).select("row.*", *[_C(c).alias(as_) for c, as_ in names.items()])


def _size(text_col: str) -> Column:
    return F.size(words(_C(text_col))).cast("long").alias("size")


def _dealt(
    sized: DataFrame, rows: DataFrame, weights: tuple[int, ...], share: float, cap: int,
    block_words: int, shard_words: int, shard_rows: int, seed: int,
) -> DataFrame:
    """``rows`` (id, source, size and more) with source_size, target and taken; ``sized`` are the same rows, narrow."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    counts = sources.select(_C("source").alias("counted"), "source_rows")
    sources = sources.drop("source_rows")
    aimed = targets(sources, weights, share, cap)
    whole = Window.partitionBy()
    aimed = aimed.withColumn("all_blocks", F.round(F.sum("target").over(whole) / block_words).cast("long"))
    quotas = apportion(aimed, [], [_C("source").asc_nulls_last()], "target", "all_blocks")
    quotas = quotas.join(counts, quotas["source"].eqNullSafe(counts["counted"]))
    quotas = stored(quotas.select(
        _C("source").alias("quota_source"), "source_size", "target", _C("won").alias("source_blocks"),
        F.greatest(F.lit(1), F.ceil(_C("source_size") / shard_words), F.ceil(_C("source_rows") / shard_rows)).alias("shards"),
    ))

    def place(table: DataFrame) -> DataFrame:
        found = table.join(quotas, table["source"].eqNullSafe(quotas["quota_source"]))
        return found.withColumns({
            "shard": F.pmod(seeded(seed + 1, _C("id"), _C("size")), _C("shards")),
            "place": seeded(seed, _C("id"), _C("size")),
        })

    shards = place(sized).groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks")
    )
    shards = apportion(shards, ["source"], [_C("shard")], "shard_size", "source_blocks").select(
        _C("source").alias("shard_source"), _C("shard").alias("shard_no"), "shard_size",
        F.least(_C("won") * block_words, _C("shard_size") * cap).alias("quota"),
        (F.pmod(
            seeded(seed + 2, _C("source"), _C("shard")),
            F.greatest(F.lit(1), F.ceil(_C("shard_size") / block_words)),
        ) * block_words).alias("begin"),
    )
    inside = Window.partitionBy("source", "shard").orderBy("place", "id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ordered = place(rows).withColumn("stop", F.sum("size").over(inside)).withColumn("start", _C("stop") - _C("size"))
    dealt = ordered.join(
        shards, ordered["source"].eqNullSafe(shards["shard_source"]) & (ordered["shard"] == shards["shard_no"])
    )
    rounds = F.when(_C("shard_size") > 0, F.floor(_C("quota") / _C("shard_size"))).otherwise(0)
    end = _C("begin") + _C("quota") - rounds * _C("shard_size")
    taken = (
        rounds * _C("size")
        + _overlap(_C("start"), _C("stop"), _C("begin"), F.least(end, _C("shard_size")))
        + _overlap(_C("start"), _C("stop"), F.lit(0), end - _C("shard_size"))
    )
    return dealt.select(*rows.columns, "source_size", "target", taken.cast("long").alias("taken"))
