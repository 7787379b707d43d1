"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Each rule compares one measure of a text with a cutoff. Cutoffs come from labelled good
documents: going from the loosest cutoff of a fixed list to tighter ones, a cutoff is certified
while the exact binomial test rejects "more than ``alpha / rules`` of good documents fall";
the last certified one holds. Each test runs at ``delta / (rules * strata)``; going on in a
fixed order costs no further correction. So, with confidence ``1 - delta``, the rules together
reject at most ``alpha`` of the good documents of every stratum. A stratum (the language) with too
few labels gets no cutoff and loses nothing to the rules.

All measures of a text are built inside its row; only narrow measures are stored and joined.

Null text: no words, fails the base rule. Null language: a stratum. A null id has no label.
A document with several labels is good if all say so. Without labels only the base rule works.
Repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozmill.llm.common import SPACES, stored, text_digest, words

_C = F.col
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule -> measure over the stored columns. Larger is worse.
RULES = {
    "symbols": lambda: _C("n_symbols") / _C("n_words"),
    "dup_lines": lambda: _C("n_dup_lines") / _C("n_lines"),
    "repeats": lambda: _C("n_repeat_words") / _C("n_words"),
    "capitals": lambda: _C("n_upper") / _C("word_chars"),
    "shouts": lambda: _C("n_shouts") / _C("n_words"),
}
#: From loose to tight.
CUTOFFS = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _drop(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _windows(tokens: Column, n: Column, bits: Column) -> Column:
    """The windows of three words as sorted numbers: high bits of the hash, the place below.

    The place takes as many bits as the text needs, so equal windows are neighbours.
    """
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.call_function(
            "shiftleft", _drop(F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)), bits), bits
        ).bitwiseOR(i.cast("long")),
    )
    return F.when(n >= 4, F.sort_array(hashed))


def _covered(windows: Column, bits: Column) -> Column:
    """Words that lie in a window occurring twice or more."""
    same = lambda a, b: F.coalesce(_drop(a.bitwiseXOR(b), bits) == 0, F.lit(False))
    repeated = F.filter(
        windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1))
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    starts = F.transform(repeated, lambda x: x.bitwiseAND(mask))
    places = F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))
    return F.coalesce(F.size(F.array_distinct(places)), F.lit(0))


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """id, stratum and the counts that the rules use, per row."""
    rows = docs.select(
        _C(id_col).alias("id"), _C(stratum_col).alias("stratum"), F.coalesce(_C(text_col), F.lit("")).alias("text")
    )
    split = rows.select(
        "*", words(_C("text")).alias("tokens"),
        F.filter(
            F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0
        ).alias("lines"),
        F.translate("text", SPACES, "").alias("dense"),
    )
    n = F.size("tokens")
    counted = split.select("*", n.alias("n"), F.ceil(F.log2(n + F.lit(1))).cast("int").alias("bits"))
    sorted_windows = counted.select(
        "id", "stratum", "lines", "dense", "n", "bits", _windows(_C("tokens"), _C("n"), _C("bits")).alias("windows")
    )
    return sorted_windows.select(
        "id", "stratum", _C("n").cast("long").alias("n_words"),
        F.length("dense").cast("long").alias("word_chars"),
        _count_of(_C("dense"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(_C("windows"), _C("bits")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(_C("dense"), UPPER).alias("n_upper"),
        _count_of(_C("dense"), "!").alias("n_shouts"),
    )


def _allowed(n: Column, alpha: float, delta: float) -> Column:
    """Most failures among n at which "the rate exceeds alpha" is still rejected; -1 for none.

    Sums the binomial probabilities of 0, 1, ... in logarithms; at most ``alpha * n`` steps.
    """
    zero = F.struct(
        (n * math.log1p(-alpha)).alias("p"), (n * math.log1p(-alpha)).alias("cdf"), F.lit(-1).cast("long").alias("most")
    )

    def step(acc: Column, k: Column) -> Column:
        following = acc["p"] + F.log((n - k) / (k + 1.0)) + math.log(alpha / (1 - alpha))
        return F.struct(
            following.alias("p"),
            (acc["cdf"] + F.log1p(F.exp(following - acc["cdf"]))).alias("cdf"),
            F.when(acc["cdf"] <= math.log(delta), k).otherwise(acc["most"]).alias("most"),
        )

    steps = F.sequence(F.lit(0).cast("long"), F.floor(n * alpha).cast("long"))
    return F.aggregate(steps, zero, step, lambda acc: acc["most"])


def certified(measured: DataFrame, labels: DataFrame, label_id: str, label: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, one cutoff column per rule, null where none is certified, n_good)."""
    good = (
        labels.where(_C(label).isNotNull()).groupBy(_C(label_id).alias("id"))
        .agg(F.min(label).alias("good")).where(_C("good") == 1).select("id")
    )
    passed = measured.where((_C("n_words") > 0)).join(good, "id", "left_semi")
    fails = [
        F.sum((measure() > cutoff).cast("long")).alias(f"{rule}_{k}")
        for rule, measure in RULES.items()
        for k, cutoff in enumerate(CUTOFFS)
    ]
    counted = passed.groupBy("stratum").agg(F.count("*").alias("n_good"), *fails)
    n_strata = max(measured.select("stratum").distinct().count(), 1)
    most = _allowed(_C("n_good"), alpha / len(RULES), delta / (len(RULES) * n_strata))
    bound = counted.withColumn("most", most)

    def cutoff(rule: str) -> Column:
        holds = F.array(*[F.col(f"{rule}_{k}") <= _C("most") for k in range(len(CUTOFFS))])
        first_fail = F.array_position(holds, False)
        last = F.when(first_fail == 0, len(CUTOFFS)).otherwise(first_fail - 1)
        return F.get(F.array(*map(F.lit, CUTOFFS)), last.cast("int") - 1).alias(f"{rule}_cutoff")

    return bound.select("stratum", "n_good", *[cutoff(rule) for rule in RULES])


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_id: str = "doc_id", label: str = "quality", alpha: float = 0.05, delta: float = 0.05, min_words: int = 50,
) -> DataFrame:
    """(id_col, counts, base_failed, kept, failed_rules) of every row."""
    measured = stored(measures(docs, id_col, text_col, stratum_col))
    return _verdicts(measured, labels, label_id, label, alpha, delta, min_words).select(
        _C("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_id: str = "doc_id", label: str = "quality", alpha: float = 0.05, delta: float = 0.05, min_words: int = 50,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whatever their ids: a verdict depends on text and stratum alone."""
    own = F.struct(_C(id_col).alias("id"), text_digest(_C(text_col)).alias("digest"))
    keyed = docs.select(own.alias("key"), _C(stratum_col).alias("stratum"), _C(text_col).alias("text"))
    measured = stored(measures(keyed, "key", "text", "stratum").withColumn("digest", _C("id.digest")).withColumn("id", _C("id.id")))
    judged = _verdicts(measured, labels, label_id, label, alpha, delta, min_words)
    rejected = judged.where(~_C("kept")).select(_C("digest").alias("__digest"), _C("stratum").alias("__of")).distinct()
    same = (text_digest(docs[text_col]) == rejected["__digest"]) & docs[stratum_col].eqNullSafe(rejected["__of"])
    return docs.join(rejected, same, "left_anti")


def _verdicts(
    measured: DataFrame, labels: DataFrame, label_id: str, label: str, alpha: float, delta: float, min_words: int
) -> DataFrame:
    """``measured`` with base_failed, kept and failed_rules."""
    limits = stored(certified(measured, labels, label_id, label, alpha, delta)).withColumnRenamed("stratum", "__stratum")
    judged = measured.join(limits, measured["stratum"].eqNullSafe(limits["__stratum"]), "left")
    base = (_C("n_words") < min_words) | (100 * _C("n_repeat_words") > 50 * _C("n_words"))
    broken = F.concat_ws(",", *[
        F.when((_C("n_words") > 0) & (measure() > _C(f"{rule}_cutoff")), F.lit(rule)) for rule, measure in RULES.items()
    ])
    return judged.withColumn("failed_rules", broken).select(
        *[measured[c] for c in measured.columns],
        base.alias("base_failed"), (~base & (_C("failed_rules") == "")).alias("kept"), "failed_rules",
    )
