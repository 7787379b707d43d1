"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier over hashed byte n-grams predicts
each bit. Decoding adds up, per language, the logistic loss of every bit against the codeword,
weighted by how well that bit was predicted on rows that its classifier had not seen, and takes
the language of least loss. A small lead over the second language flags the text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``rows``); every whole text is
read for its prediction. Models are arrays of fixed size and travel with the task.

Null texts and texts without a letter are ``und`` with score 0; without any labelled row every
text is. Rows with a null id are not held out. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import held_out, pieces
from vozmill.llm.sampling import sampled

_C = F.col
UNDETERMINED = "und"
GRAMS = (1, 2, 3)
WIDTH = 1024
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_frequencies(texts: pa.Array) -> np.ndarray:
    """Row i: square roots of the shares of text i's hashed byte n-grams, lower-cased letters only."""
    lowered = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "").to_pylist()
    parts = [t.encode() for t in lowered]
    rows = len(parts)
    raw = _LETTER[np.frombuffer(b" ".join(parts) + b"   ", dtype=np.uint8)].astype(np.uint32)
    sizes = np.array([len(p) + 1 for p in parts])
    owner = np.repeat(np.arange(rows), sizes)
    n = len(owner)
    out = np.zeros((rows, len(GRAMS) * WIDTH), dtype=np.float32)
    code = np.zeros(n, dtype=np.uint32)
    for k, size in enumerate(GRAMS):
        code = code * np.uint32(256) + raw[size - 1 : size - 1 + n]
        slot = (code * np.uint32(2654435761)) >> np.uint32(22)
        counts = np.bincount(owner * WIDTH + slot, minlength=rows * WIDTH).reshape(rows, WIDTH)
        out[:, k * WIDTH : (k + 1) * WIDTH] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


def codewords(classes: int, bits: int, seed: int) -> np.ndarray:
    """A matrix of -1 and 1, classes by bits: of many random ones that with the widest closest pair."""
    rng = np.random.default_rng(seed)
    best, width = None, -1
    for _ in range(200):
        m = np.where(rng.random((classes, bits)) < 0.5, -1, 1)
        constant = np.abs(m.sum(0)) == classes
        m[0, constant] *= -1
        apart = (m[:, None] != m[None]).sum(-1)
        closest = int(apart[np.triu_indices(classes, 1)].min())
        if closest > width:
            best, width = m, closest
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one per column of y (-1, 1), by accelerated gradient descent."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    look_w, look_b = w.copy(), b.copy()
    rate = 4.0 / (float((x * x).sum(1).max()) + 1.0)
    for t in range(steps):
        pull = -y / (1 + np.exp(np.clip(y * (x @ look_w + look_b), -30, 30)))
        new_w = look_w - rate * (x.T @ pull / n + ridge * look_w)
        new_b = look_b - rate * pull.mean(0)
        look_w, look_b = (new + t / (t + 3) * (new - old) for new, old in ((new_w, w), (new_b, b)))
        look_w, look_b = look_w.astype(np.float32), look_b.astype(np.float32)
        w, b = new_w.astype(np.float32), new_b.astype(np.float32)
    return w, b


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(-1)


def train(x: np.ndarray, names: list[str], bits_per_doubling: int = 10, seed: int = 7) -> Coder | None:
    """A coder from n-gram rows and their languages; None without rows."""
    languages = sorted(set(names))
    if not languages:
        return None
    k = len(languages)
    if k == 1:
        return Coder(languages, np.ones((1, 1)), np.zeros((x.shape[1], 1), np.float32), np.ones(1), np.ones(1))
    code = codewords(k, max(int(np.ceil(bits_per_doubling * np.log2(k))), 7), seed)
    index = np.array([languages.index(name) for name in names])
    y = code[index].astype(np.float32)
    seen = np.random.default_rng(seed).random(len(names)) < 0.8
    trust = np.ones(code.shape[1])
    if seen.any() and not seen.all():
        w, b = fit_bits(x[seen], y[seen], steps=60)
        right = (np.sign(x[~seen] @ w + b) == y[~seen]).mean(0)
        trust = np.maximum(2 * right - 1, 0.05)
    w, b = fit_bits(x, y)
    return Coder(languages, code, w, b, trust / trust.sum() * len(trust))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 5, fold: int = 0, rows: int = 2000, lead: float = 0.2, seed: int = 7,
) -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) of every row.

    Rows with a language whose fold is another one than ``fold`` teach, about ``rows`` of them.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(_C(id_col).alias("id"), _C(text_col).alias("text"), _C(lang_col).alias("lang"))
    base = base.withColumn("held_out", held_out(_C("id"), folds, fold))
    usable = base.where(_C("lang").isNotNull() & _C("text").isNotNull() & ~_C("held_out"))
    sample, _ = sampled(usable, "id", "lang", rows, seed)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = gram_frequencies(batch.column("text"))
            packed = pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), packed], names=["id", "lang", "x"])

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())
    ])
    taught = sample.select("id", "text", "lang").mapInArrow(featured, schema).collect()
    taught.sort(key=lambda r: (str(r["id"]), r["lang"], bytes(r["x"])))
    width = len(GRAMS) * WIDTH
    x = np.array([np.frombuffer(r["x"], np.float16) for r in taught], np.float32).reshape(-1, width)
    coder = train(x, [r["lang"] for r in taught], seed=seed)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            letters = np.array(batch.column("letters").to_pylist(), bool)
            names, score, close = np.full(len(letters), UNDETERMINED, object), np.zeros(len(letters)), ~letters
            if coder is not None and letters.any():
                loss = coder.losses(gram_frequencies(batch.column("text")))
                chance = np.exp(loss.min(1, keepdims=True) - loss)
                chance /= chance.sum(1, keepdims=True)
                ranked = np.sort(chance, 1)[:, ::-1]
                best = np.array(coder.languages, object)[chance.argmax(1)]
                names = np.where(letters, best, UNDETERMINED)
                score = np.where(letters, ranked[:, 0], 0.0)
                second = ranked[:, 1] if ranked.shape[1] > 1 else 0.0
                close = ~letters | (ranked[:, 0] - second < lead)
            elif coder is None:
                close = np.ones(len(letters), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(list(names), pa.string()),
                 pa.array(np.asarray(score, np.float64)), pa.array(close)],
                names=["id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    result = T.StructType([
        T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()),
    ])
    letters = F.coalesce(_C("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    out = base.select("id", "held_out", "text", letters).mapInArrow(predicted, result)
    return out.withColumnRenamed("id", id_col)
