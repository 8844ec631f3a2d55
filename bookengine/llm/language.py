"""Language identification in two steps: the family first, then pairwise linear support vector machines within it.

A text's features are the shares of its letter n-grams (one to four bytes of the lower-cased text, where runs of anything that is
no letter are one blank), hashed into ``BUCKETS``. Every classifier is linear, so a score is the mean weight of the n-grams,
taken in one pass over the bytes, and no feature vector is built for a text that is only scored.

Families are those of comparative linguistics; a code that the table lacks is a family of its own. Each pair of families, and
each pair of languages of one family, has a support vector machine (squared hinge, ridge), fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.columns import byte_slices, byte_steps
from bookengine.llm.quality import held_out
from bookengine.llm.store import materialize, scratch

#: Documents that the fit looks at in all, dealt evenly over the languages, those of smallest hash; a language has LEAST_ROWS of them at least.
FIT_ROWS = 4_000
LEAST_ROWS = 50
BUCKETS = 2048
SIZES = (1, 2, 3, 4)
STEPS = 300
RIDGE = 1e-3
#: Shares are small numbers; this brings margins near 1.
SCALE = 30.0
#: Codes of close relatives. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi ur bn mr ne gu pa".split(),
    "semitic": "ar he mt am".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: Odd multipliers of the hash, one for each byte of an n-gram.
_MULTIPLIERS = [np.uint32(m) for m in (2654435761, 2246822519, 3266489917, 668265263)]


def family(lang: str) -> str:
    """The family of a language code, region and script left aside."""
    base = lang.lower().replace("_", "-").split("-")[0]
    return FAMILY_OF.get(base, base)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of each size. ``data`` is lower-cased UTF-8."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letter = _LETTER[data]
    text = np.where(letter, data, np.uint8(32))
    # of a run without letters the first byte stands as a blank, in front of a row's first letter too
    stays = letter.copy()
    if len(text):
        stays[1:] |= letter[:-1] & (row[1:] == row[:-1])
    text, row = text[stays].astype(np.uint32), row[stays]
    for size in SIZES:
        n = len(text) - size + 1
        if n <= 0:
            continue
        code = np.full(n, np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF))
        for k in range(size):
            code = (code ^ text[k : k + n]) * _MULTIPLIERS[k]
            code ^= code >> np.uint32(15)
        inside = row[:n] == row[size - 1 :]
        yield row[:n][inside], (code[inside] % np.uint32(BUCKETS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of the buckets by row, a block for each size. Rows without letters are zero."""
    rows = len(offsets) - 1
    out = np.zeros((rows, BUCKETS))
    for row, bucket in grams(data, offsets):
        counts = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        out += counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return out


def margins(weights: np.ndarray, bias: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margins of each row (down) by each classifier (across), as ``features(...) * SCALE @ weights + bias`` gives them."""
    rows = len(offsets) - 1
    out = np.tile(bias, (rows, 1))
    for row, bucket in grams(data, offsets):
        count = np.maximum(np.bincount(row, minlength=rows), 1)
        for k in range(weights.shape[1]):
            out[:, k] += SCALE * np.bincount(row, weights[:, k][bucket], rows) / count
    return out


def fit_svm(x: np.ndarray, sign: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, bias of the least mean squared hinge, both sides weighing alike, plus ridge. Accelerated descent; deterministic."""
    # single precision: the sample is the largest thing that the driver holds
    x = np.hstack([x * np.float32(SCALE), np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False)
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    sign = sign.astype(np.float32)
    # a step no longer than the curvature allows
    v = np.full(x.shape[1], x.shape[1] ** -0.5, np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= np.float32(max(norm, 1e-12))
    rate = np.float32(1 / (2 * norm * 1.1 + RIDGE))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        gradient = -2 * (x.T @ (weight * sign * slack)) + np.float32(RIDGE) * np.append(ahead[:-1], np.float32(0))
        new = ahead - rate * gradient
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


class Model:
    """Pairwise classifiers: of families (by name), then of the languages in each of them."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        """``y`` holds each row's place in ``langs``."""
        self.langs = langs
        self.families = sorted({family(lang) for lang in langs})
        self.members = [[k for k, lang in enumerate(langs) if family(lang) == name] for name in self.families]
        group = np.array([self.families.index(family(lang)) for lang in langs])
        self.family_pairs = list(combinations(range(len(self.families)), 2))
        self.lang_pairs = [pair for members in self.members for pair in combinations(members, 2)]
        fits = [self._pair(x, group[y], pair) for pair in self.family_pairs] + [self._pair(x, y, pair) for pair in self.lang_pairs]
        both = np.array(fits).reshape(len(fits), BUCKETS + 1)
        self.weights, self.bias = np.ascontiguousarray(both[:, :-1].T), both[:, -1]

    @staticmethod
    def _pair(x: np.ndarray, y: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
        side = np.isin(y, pair)
        return fit_svm(x[side], np.where(y[side] == pair[0], 1.0, -1.0))

    @staticmethod
    def _shares(margin: np.ndarray, pairs: list[tuple[int, int]], members: list[int]) -> np.ndarray:
        """Of each row, how far each member wins its pairs; adds up to 1."""
        won = np.zeros((len(margin), len(members)))
        place = {m: k for k, m in enumerate(members)}
        chance = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        for k, (a, b) in enumerate(pairs):
            won[:, place[a]] += chance[:, k]
            won[:, place[b]] += 1 - chance[:, k]
        return won * (2 / (len(members) * (len(members) - 1))) if len(members) > 1 else np.ones_like(won)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``langs`` and score (0 to 1) of each row. Of equal shares the first by name wins."""
        margin = margins(self.weights, self.bias, data, offsets)
        f = len(self.family_pairs)
        families = self._shares(margin[:, :f], self.family_pairs, list(range(len(self.families))))
        best = families.argmax(axis=1)
        lang, score = np.zeros(len(margin), np.int64), families.max(axis=1)
        for k, members in enumerate(self.members):
            rows = np.flatnonzero(best == k)
            cols = [i for i, pair in enumerate(self.lang_pairs) if pair[0] in members]
            shares = self._shares(margin[rows][:, [f + i for i in cols]], [self.lang_pairs[i] for i in cols], members)
            lang[rows] = np.array(members)[shares.argmax(axis=1)]
            score[rows] *= shares.max(axis=1)
        return lang, np.clip(score, 0, 1)


#: Rows that one step has at most, as each row of a step has counters of its own.
_STEP_ROWS = 1024


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the lower-cased bytes of their texts and the offsets in these."""
    for batch in byte_slices(batches, "text"):
        lower = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("text"))], ["text"])
        for start, end, data, offsets in byte_steps(lower):
            for a in range(start, end, _STEP_ROWS):
                b = min(a + _STEP_ROWS, end)
                cut = offsets[a - start : b - start + 1]
                yield batch.slice(a, b - a), data[cut[0] : cut[-1]], cut - cut[0]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step, data, offsets in _steps(batches):
        found = features(data, offsets).astype(np.float32)
        yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("lang"), pa.array([r.tobytes() for r in found], pa.binary())], ["doc_id", "lang", "features"])


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on about ``fit_rows`` documents of the learning fold with a language and a letter; None without any.

    Each language is sampled below a threshold of its documents' hashes that lets its share of ``fit_rows`` through (LEAST_ROWS at
    least), so the driver gets a bounded number of rows at any corpus size, as long as languages are a code and not free text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, fit_rows // len(counts))
    share = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(draw < F.element_at(share, F.col("lang")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession):
        # written once, as sorting would work the features out twice
        rows = materialize(chosen.mapInArrow(_features, f"doc_id {kind}, lang string, features binary"), "fit_features").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "lang", "features"], kind="stable")
    langs = sorted(set(rows["lang"]))
    x = np.frombuffer(b"".join(rows["features"]), np.float32).reshape(-1, BUCKETS)
    return Model(langs, x, np.array([langs.index(v) for v in rows["lang"]]))


def _predict(model: Model | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, data, offsets in _steps(batches):
            named = step.column("letters").to_numpy(zero_copy_only=False)
            if model is None:
                lang, score = np.full(len(named), "und", object), np.zeros(len(named))
            else:
                place, score = model.predict(data, offsets)
                lang = np.where(named, np.array(model.langs, object)[place], "und")
                score = np.where(named, score, 0.0)
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows


def identify_language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1: how far the family wins among families, times how far the language wins in it).

    One row per input row, repeated ones included. Null texts, and texts without a letter, are ``und`` with score 0. Rows
    without lang or doc_id are predicted and not learned from; a null doc_id is never held out. With nothing to learn from all is ``und``;
    with one language all that has a letter is that one. Empty table: empty result. Very long texts are steps of their own.
    """
    model = train(docs, fit_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", held_out().alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
