"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled web text is a sample of the documents, those without a label
first. Labels 0 are never used. The class prior p of the unlabelled text is estimated from the two samples: with a
score that tells positives from unlabelled rows, the share of unlabelled rows above a threshold over the share of
positives above it is at least p and comes near it where only positives are left; the threshold is chosen by an upper
confidence bound on one half of the rows, with a score fitted on the other. The classifier (a linear score on shape
features of the text and their squares) minimises the non-negative unbiased risk
``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` with the logistic loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bookengine.llm.columns import byte_slices, byte_steps, doc_text, word_bounds
from bookengine.llm.shingles import word_hashes
from bookengine.llm.store import materialize, scratch

#: Most positives, and most unlabelled rows, that the fit looks at, those of smallest hash; beyond it the fit gains nothing visible.
FIT_ROWS = 10_000
STEPS = 600
RATE = 0.05
RIDGE = 1e-4

#: Byte classes whose shares are features.
CLASSES = [
    *([ord(c)] for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
    [32],
    [10],
    [9, 11, 12, 13],
    list(range(48, 58)),
    list(range(65, 91)),
    list(range(97, 123)),
    list(range(128, 256)),
    [*range(0, 9), *range(14, 32), 127],
]
N_FEATURES = len(CLASSES) + 12


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES) - 1, np.int64)
    for k, members in enumerate(CLASSES):
        table[members] = k
    return table


CLASS_OF = _class_table()


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape features of each row of a step: byte-class shares, words, repetition, lines."""
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES))
    length = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), length)
    shares = np.bincount(row_of * len(CLASSES) + CLASS_OF[data], minlength=rows * len(CLASSES)).reshape(rows, -1)
    out[:, : len(CLASSES)] = np.sqrt(shares / np.maximum(length, 1)[:, None])
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    width = ends - starts
    word_row = np.repeat(np.arange(rows), words)
    n = np.maximum(words, 1)
    mean = np.bincount(word_row, width, rows) / n
    code = word_hashes(data, starts, ends)
    order = np.lexsort((code, word_row))
    new = np.ones(len(code), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order][new], minlength=rows)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (word_row[1:] == word_row[:-1])
    lines = shares[:, CLASSES.index([10])] + 1
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    stop = np.isin(data[ends - 1], [33, 46, 63])
    odd = np.isin(data[ends - 1], [ord(c) for c in "#$%&*|~^_"])
    k = len(CLASSES)
    out[:, k] = np.log1p(length) / 10
    out[:, k + 1] = np.log1p(words) / 10
    out[:, k + 2] = mean / 10
    out[:, k + 3] = np.sqrt(np.maximum(np.bincount(word_row, width.astype(float) ** 2, rows) / n - mean**2, 0)) / 10
    out[:, k + 4] = distinct / n
    out[:, k + 5] = np.log(n) * (1 - distinct / n) / 5
    out[:, k + 6] = np.bincount(word_row, same, rows) / n
    out[:, k + 7] = lines / n
    out[:, k + 8] = np.bincount(word_row, capital, rows) / n
    out[:, k + 9] = np.bincount(word_row, stop, rows) / n
    out[:, k + 10] = np.bincount(word_row, odd, rows) / n
    out[:, k + 11] = np.bincount(word_row, width == 1, rows) / n
    return out


def expand(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scaled(*samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Middle, spread and the samples on that scale with a last column of ones."""
    both = np.vstack(samples)
    middle, spread = both.mean(0), both.std(0)
    spread[spread < 1e-9] = 1e9
    scaled = (np.clip((x - middle) / spread, -8, 8) for x in samples)
    return middle, spread, [np.hstack([x, np.ones((len(x), 1))]) for x in scaled]


def _descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Adam; deterministic."""
    w, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        grad = gradient(w) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logistic(s: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -s)


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Positive part and (before it is cut at 0) negative part of the risk."""
    return prior * float(np.mean(_logistic(p @ w))), float(np.mean(_logistic(-(u @ w))) - prior * np.mean(_logistic(-(p @ w))))


def nnpu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk where its negative part is not below 0; else the step that raises that part again."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    pull = p.T @ (sp - 1) * (prior / len(p))
    push = u.T @ su / len(u) - p.T @ sp * (prior / len(p))
    return pull + push if nnpu_risk(w, p, u, prior)[1] >= 0 else -push


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights over ``expand`` of raw features."""
    middle, spread, (p, u) = _scaled(positive, unlabelled)
    start = np.append(np.zeros(p.shape[1] - 1), np.log(prior / (1 - prior)))
    return np.concatenate([middle, spread, _descend(lambda w: nnpu_gradient(w, p, u, prior), start)])


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Class prior of the unlabelled scores: their share above a threshold over that of the positives, where its upper bound is least."""
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    k = int(np.argmin((above_u + slack) / above_p))
    return float(above_u[k] / above_p[k])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows (raw features): mean over two halves, each judged by a score fitted on the other."""
    found = []
    for half in (0, 1):
        fit_p, fit_u, p, u = positive[half::2], unlabelled[half::2], positive[1 - half :: 2], unlabelled[1 - half :: 2]
        if not all(map(len, (fit_p, fit_u, p, u))):
            continue
        middle, spread, (a, b) = _scaled(fit_p, fit_u)
        w = _descend(lambda w: (a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b)) / 2, np.zeros(a.shape[1]))  # noqa: B023
        model = np.concatenate([middle, spread, w])
        found.append(best_bin(score_features(model, p), score_features(model, u)))
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def score_features(model: np.ndarray, features: np.ndarray) -> np.ndarray:
    k = (len(model) - 1) // 3
    x = np.clip((features - model[:k]) / model[k : 2 * k], -8, 8)
    return _sigmoid(x @ model[2 * k : 3 * k] + model[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold that no label is learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        found = np.vstack([text_features(data, offsets) for _, _, data, offsets in byte_steps(batch)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "positive", "features"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray | None:
    """Fit on at most ``fit_rows`` positives and as many unlabelled rows, none of them of the held-out fold; None without either.

    The driver receives the features of these rows alone, so its memory does not grow with the corpus. Where fewer
    than ``fit_rows`` documents have no label, labelled ones join them with their labels hidden.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct().join(known, "doc_id", "left")
    first = lambda rows, *order: rows.orderBy(*order, F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id")
    positive = first(ids.where("label = 1")).withColumn("positive", F.lit(True))
    unlabelled = first(ids, F.col("label").isNotNull()).withColumn("positive", F.lit(False))
    # at most fit_rows ids on each side: small enough to broadcast at any corpus size
    with scratch(docs.sparkSession):
        chosen = materialize(positive.unionByName(unlabelled), "fit_rows")
        kind = docs.schema["doc_id"].dataType.simpleString()
        # rows that repeat an id count once
        texts = doc_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
        rows = texts.mapInArrow(_features, f"doc_id {kind}, positive boolean, features array<double>").toPandas().sort_values("doc_id", kind="stable")
    p, u = (expand(np.array(rows["features"][rows["positive"] == side].tolist()).reshape(-1, N_FEATURES)) for side in (True, False))
    if not len(p) or not len(u):
        return None
    return fit_nnpu(p, u, estimate_prior(p, u))


def _scorer(model: np.ndarray | None, column: str):
    """Adds ``score`` in place of the last column, the text."""

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        if model is None:
            return np.full(batch.num_rows, 0.5)
        return np.concatenate([np.zeros(0), *(score_features(model, expand(text_features(data, offsets))) for _, _, data, offsets in byte_steps(batch, column))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, column):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(scores(batch))], [*batch.schema.names[:-1], "score"])

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, column):
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(scores(batch) >= 0.5))

    return score, accept


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on).

    One row per input row. Null and empty texts score like any text without words. A null doc_id is
    scored and never held out; labels that are null or lack a doc_id are ignored; of several labels for a document the lowest counts. With no
    document of label 1 to learn from every score is 0.5. Empty table: empty result.
    """
    model = train(docs, labels, fit_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = text.mapInArrow(_scorer(model, "text")[0], f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents, with their own columns, that the classifier accepts. Null texts count as empty."""
    model = train(docs, labels, fit_rows)
    # under plain names meanwhile, which no text column's name can clash with
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)])
    with_text = docs.toDF(*plain.names).withColumn("text", F.coalesce(plain.names[docs.columns.index("text")], F.lit("")))
    return with_text.mapInArrow(_scorer(model, "text")[1], plain).toDF(*docs.columns)
