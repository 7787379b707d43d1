"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are sorted into a few bins; each tree splits by sums of gradients per bin.
Trees are complete and lie in flat arrays: node i has the children 2i + 1 and 2i + 2, so all
trees of all texts of a batch are walked at once, level by level, by array indexing.

The trees are fitted on a bounded sample of labelled rows (``rows``); every whole text is scored.

Null and empty texts have statistics of zero and are scored like any other. Null labels are
ignored; a document with several labels is good if all say so. Without labels of both
classes the score is the known share of good texts, or 0. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import byte_texts, held_out, pieces
from vozmill.llm.sampling import sampled, sampled_texts

_C = F.col
_KIND = np.zeros(256, np.int64)
_KIND[[b for b in range(128) if chr(b).islower()]] = 1
_KIND[[b for b in range(128) if chr(b).isupper()]] = 2
_KIND[[b for b in range(128) if chr(b).isdigit()]] = 3
_KIND[[ord(c) for c in " \t\r\x0b\x0c"]] = 4
_KIND[ord("\n")] = 5
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 6
_KIND[[ord(c) for c in "!?"]] = 7
_KIND[[ord(c) for c in "#*$%&|<>{}[]\\/=+~^_@`"]] = 8
_KIND[128:] = 9
_KINDS = 10


def statistics(text: bytes | None) -> list[float]:
    """Shares of kinds of bytes, and shapes of words and lines."""
    text = text or b""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=_KINDS)
    tokens = text.split()
    n = max(len(tokens), 1)
    counts = Counter(tokens)
    lines = [s for s in (x.strip() for x in text.split(b"\n")) if s]
    lengths = [len(t) for t in tokens]
    stops = sum(t[-1] in b".!?" for t in tokens)
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
    triples = len(set(zip(tokens, tokens[1:], tokens[2:])))
    return [
        *(kinds / max(len(text), 1)).tolist(),
        float(len(tokens)), sum(lengths) / n, float(max(lengths, default=0)),
        len(counts) / n, max(counts.values(), default=0) / n, repeats / n,
        1 - triples / max(len(tokens) - 2, 1) if len(tokens) > 2 else 0.0,
        stops / n, len(lines) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


WIDTH = _KINDS + 10


@dataclass
class Forest:
    """Trees in flat arrays: (trees, nodes) features and limits, (trees, leaves) values."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        t, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(nodes + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.limit[t, at])
        return self.start + self.leaf[t, at - nodes].sum(1)


def grow(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 64,
    rate: float = 0.2, ridge: float = 1.0, least: float = 5.0,
) -> Forest:
    """Boosts complete trees on logistic loss. Bin limits are quantiles of the sample."""
    n, d = x.shape
    weight = weight / weight.mean()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    offset = np.arange(d)[None, :] * (bins + 1)
    mean = float((weight * y).sum() / weight.sum())
    margin = np.full(n, np.log(mean / (1 - mean)))
    nodes = 2**depth - 1
    feature = np.zeros((trees, nodes), np.int64)
    limit = np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, nodes + 1))
    start = float(margin[0]) if n else 0.0
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            count = 2**level
            key = ((at - first)[:, None] * d * (bins + 1) + offset + binned).ravel()
            size = count * d * (bins + 1)
            gs = np.bincount(key, np.repeat(g, d), size).reshape(count, d, bins + 1).cumsum(2)
            hs = np.bincount(key, np.repeat(h, d), size).reshape(count, d, bins + 1).cumsum(2)
            ns = np.bincount(key, minlength=size).reshape(count, d, bins + 1).cumsum(2)
            whole_g, whole_h, whole_n = gs[..., -1:], hs[..., -1:], ns[..., -1:]
            gain = gs**2 / (hs + ridge) + (whole_g - gs) ** 2 / (whole_h - hs + ridge) - whole_g**2 / (whole_h + ridge)
            gain = np.where((ns >= least) & (whole_n - ns >= least), gain, 0.0).reshape(count, -1)
            for k in range(count):
                j, b = divmod(int(gain[k].argmax()), bins + 1)
                if gain[k].max() > 1e-9 and b < len(cuts[j]):
                    feature[t, first + k], limit[t, first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > limit[t, at])
        gs, hs = np.bincount(at - nodes, g, nodes + 1), np.bincount(at - nodes, h, nodes + 1)
        leaf[t] = -rate * gs / (hs + ridge)
        margin = margin + leaf[t, at - nodes]
    return Forest(feature, limit, leaf, start)


def score_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label: str = "quality", folds: int = 4, fold: int = 2,
    cut: float = 0.7, rows: int = 8000, seed: int = 13,
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; labels of the fold ``fold`` do not teach."""
    kind = docs.schema[id_col].dataType
    base = docs.select(_C(id_col).alias("id"), _C(text_col).alias("text")).withColumn(
        "held_out", held_out(_C("id"), folds, fold)
    )
    marks = labels.where(_C(label).isNotNull()).groupBy(_C(label_id).alias("id")).agg(F.min(label).alias("mark"))
    marks = marks.where(~held_out(_C("id"), folds, fold))
    sample, rates = sampled(marks, "id", "mark", rows, seed)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "mark", "x"]
            )

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("mark", marks.schema["mark"].dataType),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ])
    taught = sampled_texts(base.select("id", "text"), sample, "mark").mapInArrow(measured, schema).collect()
    taught.sort(key=lambda r: (str(r["id"]), r["mark"], r["x"]))
    y = np.array([r["mark"] for r in taught], float)
    forest, constant = None, 0.0
    if len(set(y)) == 2:
        forest = grow(np.array([r["x"] for r in taught]), y, np.array([1 / rates[r["mark"]] for r in taught]))
    elif len(y):
        constant = float(y.mean())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = np.array([statistics(t) for t in byte_texts(batch.column("text"))], float).reshape(-1, WIDTH)
            score = np.full(len(x), constant) if forest is None else 1 / (1 + np.exp(-forest.margins(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    result = T.StructType([
        T.StructField("id", kind), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])
    return base.select("id", "held_out", "text").mapInArrow(scored, result).withColumnRenamed("id", id_col)
