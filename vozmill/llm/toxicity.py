"""Toxicity by a counterfactually regularised classifier.

A sparse logistic model over the words of a text and their beginnings. In each labelled training text that names a
group, every sentence is also read with the group's name swapped for others of its kind, and
the squared change of the score is part of the loss. So names of groups carry no weight of
their own: what is said counts, not about whom. Weights are kept sparse, so that the length of
a text does not add up noise.

The model is fitted on a bounded sample of labelled rows (``rows``), equally many of both
classes where there are enough, weighted back to their true shares. Every whole text is scored.

Null and empty texts are scored by the intercept alone. Rows without an id are scored and never teach;
of rows that share an id one text teaches. An empty table gives no row. Labels that are null are ignored; a
document with several labels is toxic if any says so. Without labels of both classes the
score is the known share of toxic texts, or 0. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import held_out, pieces
from vozmill.llm.sampling import sampled, sampled_texts

_C = F.col
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")

#: Characters of the beginnings of words that are features too.
STEMS = (4, 6)
# Names of groups by kind, in the languages of the corpus; a swap goes to the other names of the kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """The words and, marked, the beginnings of longer ones, which compounds and endings share."""
    return words | {f"^{w[:n]}" for n in STEMS for w in words if len(w) > n}


def swapped_sets(text: str | None, groups: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """Word sets of the text with the names in its sentences turned to others of their kind.

    One set per step of the turn, until the largest kind that the text names has been through all its
    names; none if the text names no group.
    """
    place = {name: (g, k) for g, names in enumerate(groups) for k, name in enumerate(names)}
    sentences = [_WORD.findall(s) for s in _SENTENCE.split((text or "").lower())]
    named = [any(w in place for w in s) for s in sentences]
    if not any(named):
        return []
    out = []
    most = max(len(groups[place[w][0]]) for s in sentences for w in s if w in place)
    for turn in range(1, most):
        words: set[str] = set()
        for sentence, has in zip(sentences, named):
            for w in sentence:
                if has and w in place:
                    g, k = place[w]
                    w = groups[g][(k + turn) % len(groups[g])]
                words.add(w)
        out.append(words)
    return out


def _rows(sets: list[set[str]], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(sets), len(index)), np.float32)
    for i, words in enumerate(sets):
        x[i, [index[w] for w in words if w in index]] = 1
    return x


def fit(
    sets: list[set[str]], y: np.ndarray, weight: np.ndarray, swaps: list[tuple[int, set[str]]],
    sparse: float = 1e-4, fairness: float = 5.0, steps: int = 600, words: int = 3000, least: int = 3,
) -> tuple[dict[str, float], float]:
    """Weights of words and the intercept, by proximal gradient steps.

    ``swaps``: (row, word set of its counterfactual). Candidate words occur in ``least`` rows
    at least; of more than ``words`` of them, those whose rates differ most between classes.
    """
    weight = weight / weight.sum()
    rate = float((weight * y).sum())
    start = float(np.log(rate / (1 - rate)))
    toxic, other = Counter(), Counter()
    for words_of, label in zip(sets, y):
        (toxic if label else other).update(words_of)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    seen = [w for w in set(toxic) | set(other) if toxic[w] + other[w] >= least]
    seen = sorted(seen, key=lambda w: (-abs(toxic[w] / n1 - other[w] / n0), w))[:words]
    names = sorted({w for _, s in swaps for w in s} & {n for group in IDENTITY for n in group} | set(seen))
    index = {w: i for i, w in enumerate(names)}
    x = _rows(sets, index)
    gap = x[[i for i, _ in swaps]] - _rows([s for _, s in swaps], index) if swaps else np.zeros((0, len(index)), np.float32)
    theta, b = np.zeros(len(index), np.float32), start
    look, look_b = theta.copy(), b
    v = np.ones(len(index), np.float32)
    for _ in range(12):  # largest curvature
        u = x.T @ (weight.astype(np.float32) * (x @ v)) / 4
        if len(gap):
            u = u + 2 * fairness / len(gap) * (gap.T @ (gap @ v))
        v = u / max(np.linalg.norm(u), 1e-12)
    rate_step = 1.0 / (float(np.linalg.norm(u)) + 0.5)
    for t in range(steps):
        err = weight * (1 / (1 + np.exp(-np.clip(x @ look + look_b, -30, 30))) - y)
        grad = x.T @ err.astype(np.float32)
        if len(gap):
            grad = grad + 2 * fairness / len(gap) * (gap.T @ (gap @ look))
        moved = look - rate_step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate_step * sparse, 0)
        new_b = look_b - rate_step * float(err.sum())
        look, look_b = new + t / (t + 3) * (new - theta), new_b + t / (t + 3) * (new_b - b)
        theta, b = new.astype(np.float32), new_b
    return {w: float(theta[i]) for w, i in index.items() if theta[i]}, float(b)


def score_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label: str = "toxic", folds: int = 5, fold: int = 0,
    rows: int = 4000, groups: tuple[tuple[str, ...], ...] = IDENTITY, seed: int = 11,
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; labels of the fold ``fold`` do not teach."""
    kind = docs.schema[id_col].dataType
    base = docs.select(_C(id_col).alias("id"), _C(text_col).alias("text")).withColumn(
        "held_out", held_out(_C("id"), folds, fold)
    )
    marks = labels.where(_C(label).isNotNull()).groupBy(_C(label_id).alias("id")).agg(F.max(label).alias("mark"))
    marks = marks.where(~held_out(_C("id"), folds, fold))
    sample, rates = sampled(marks, "id", "mark", rows, seed)

    def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array([sorted(word_set(t)) for t in texts], pa.list_(pa.string())),
                 pa.array([[sorted(s) for s in swapped_sets(t, groups)] for t in texts], pa.list_(pa.list_(pa.string())))],
                names=["id", "mark", "words", "swaps"],
            )

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("mark", marks.schema["mark"].dataType),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("swaps", T.ArrayType(T.ArrayType(T.StringType()))),
    ])
    taught = sampled_texts(base.select("id", "text"), sample, "mark").mapInArrow(read_words, schema).collect()
    taught.sort(key=lambda r: (str(r["id"]), r["mark"], r["words"]))
    y = np.array([r["mark"] for r in taught], float)
    weights, intercept, constant = {}, 0.0, None
    if len(set(y)) == 2:
        weight = np.array([1 / rates[r["mark"]] for r in taught])
        # Rows share their strings, so equal words take memory once.
        shared: dict[str, str] = {}
        known_of = lambda words: {shared.setdefault(w, w) for w in features(set(words))}
        swaps = [(i, known_of(s)) for i, r in enumerate(taught) for s in r["swaps"]]
        weights, intercept = fit([known_of(r["words"]) for r in taught], y, weight, swaps)
    else:
        constant = float(y.mean()) if len(y) else 0.0
    known = frozenset(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sums = [sum(weights[w] for w in sorted(known & features(word_set(t)))) for t in batch.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(sums, float) + intercept, -30, 30)))
            if constant is not None:
                score = np.full(len(sums), constant)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    result = T.StructType([
        T.StructField("id", kind), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])
    return base.select("id", "held_out", "text").mapInArrow(scored, result).withColumnRenamed("id", id_col)
