"""Toxic passages as maximum-scoring segments over token log-odds.

Fitting: a bounded sample of the labelled rows (``FIT_ROWS``, chosen by the hash of the id) gives, per hashed
feature, in how many toxic and other documents it occurs. Copies of a text count together as one document:
each text weighs one over the number of sampled texts that share one of three minimum shingle hashes with it.
Features are whole words and the first and last five or four letters. Log-odds with an informative Dirichlet
prior (the pooled counts, ``PRIOR`` documents heavy) weigh each feature; those whose likelihood ratio is not
significant count as neutral. A word takes the weight of its most specific feature that is significant or
was seen in enough other documents. Neutral words cost ``DRIFT``.

Scoring: a linear-time scan finds all maximal scoring segments of a text. Segment scores are calibrated as
extremes: under the score distribution of clean words the best of n places exceeds S about K*n*exp(-lambda*S)
times, so lambda*S - log(K*n) compares texts of any length. A logistic curve over the best segment's value
and the number of significant segments, fitted on the two halves of the sample crosswise (each half is scored
with the other's weights), turns it into a probability.

The feature table has at most ``2**BUCKET_BITS`` rows and is broadcast; nothing else grows with the corpus on
the driver. Labels are used from rows allowed by ``train_filter`` only; language, source and id are no input.

Edge cases: null and empty texts have no segment and get the score of such texts; null labels and ids are not
fitted on; several labels of one id count as toxic if any is; without both classes in the sample every score
is 0; repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .base import small_batches, text_of

FIT_ROWS = 40_000
BUCKET_BITS = 20
PRIOR = 20.0
LEAST_SEEN = 3.0
# signed root of the likelihood ratio: one feature in three million without effect lies beyond
LEAST_Z = 5.0
SHINGLE = 5
DRIFT = 0.1
SIGNIFICANT = 0.01
THRESHOLD = 0.3
CACHED_WORDS = 1 << 18
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|+-=_~`/\\«»“”„’…"
_FLOOR, _CEILING = -10.0, 30.0


def features(word: str) -> list[list[str]]:
    """Feature names of a word by falling specificity; features of one level stand side by side."""
    word = word.strip(_EDGE).lower()
    if not word:
        return []
    levels = [["w" + word]]
    for n in (5, 4):
        if len(word) > n:
            levels.append(["p" + word[:n], "s" + word[-n:]])
    return levels


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BUCKET_BITS) - 1)


class _Buckets(dict):
    """Buckets of a word's features, remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = tuple(bucket(f) for level in features(word) for f in level)
        self[word] = found
        return found


@dataclass(frozen=True)
class Weights:
    """Log-odds per bucket; NaN where too little is known, ``-DRIFT`` where it is neutral."""

    values: np.ndarray

    def of(self, word: str) -> float:
        for level in features(word):
            known = [v for f in level if not math.isnan(v := float(self.values[bucket(f)]))]
            if known:
                return max(known)
        return -DRIFT


def weigh(toxic: np.ndarray, clean: np.ndarray, toxic_docs: float, clean_docs: float) -> Weights:
    """Log-odds of a feature's presence, with a Dirichlet prior in proportion to the pooled presence."""
    docs = max(toxic_docs + clean_docs, 1e-9)
    seen = toxic + clean
    alpha = PRIOR * seen / docs + 0.1

    def log_odds(count: np.ndarray, total: float) -> np.ndarray:
        return np.log(count + alpha) - np.log(np.maximum(total + PRIOR - count - alpha, 1e-3))

    delta = log_odds(toxic, toxic_docs) - log_odds(clean, clean_docs)

    def part(count: np.ndarray, total: float) -> np.ndarray:
        expected = np.maximum(seen * total / docs, 1e-12)
        return count * np.log(np.maximum(count, 1e-12) / expected)

    ratio = 2 * np.maximum(part(toxic, toxic_docs) + part(clean, clean_docs), 0)
    toxic_sign = (np.sqrt(ratio) >= LEAST_Z) & (delta > DRIFT)
    # neither toxic nor seen in enough other documents: left to the less specific features
    return Weights(np.where(toxic_sign, delta, np.where(clean >= LEAST_SEEN, -DRIFT, np.nan)).astype(np.float32))


class Scorer(dict):
    """Word scores, remembered, and the segments of texts."""

    def __init__(self, weights: Weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self.weights.of(word)
        self[word] = found
        return found

    def scores(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by start, in linear time.

    Only positive scores begin or end a segment. Each candidate keeps the sum before and after it and a link
    to the nearest earlier candidate with a smaller sum before.
    """
    after = np.cumsum(scores)
    places = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    for place in places.tolist():
        start, end, right = place, place + 1, float(after[place])
        left = right - float(scores[place])
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= left:
                link = stack[link][4]
            if link < 0 or stack[link][3] >= right:
                break
            # extend over the candidate that it joins and all between
            start, _, left, _, link_before = stack[link]
            del stack[link:]
            link = link_before
        stack.append((start, end, left, right, link))
    return [(start, end, right - left) for start, end, left, right, _ in stack]


@dataclass(frozen=True)
class Model:
    """Weights, extreme-value parameters and the logistic curve."""

    weights: Weights
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] | None = None

    def value(self, best: float, words: int) -> float:
        """Comparable value of a segment score in a text of so many words; the floor for none."""
        if best <= 0:
            return _FLOOR
        return min(max(self.rate * best - math.log(self.scale * max(1, words)), _FLOOR), _CEILING)

    def inputs(self, scores: np.ndarray) -> tuple[float, float]:
        segments = maximal_segments(scores)
        values = [self.value(s, len(scores)) for _, _, s in segments]
        significant = sum(v >= -math.log(SIGNIFICANT) for v in values)
        return max(values, default=_FLOOR), math.log1p(significant)

    def probability(self, inputs: tuple[float, float]) -> float:
        if self.curve is None:
            return 0.0
        x = self.curve[0] + self.curve[1] * inputs[0] + self.curve[2] * inputs[1]
        return 1 / (1 + math.exp(-min(max(x, -500.0), 500.0)))


def _rate(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over clean words; 1, the natural value, at most."""
    share = counts / counts.sum()

    def mean(rate: float) -> float:
        return float((share * np.exp(rate * values)).sum())

    if mean(1.0) <= 1:
        return 1.0
    low, high = 1e-3, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted, ridge-penalised Newton fit of y on a constant and the columns of x; slopes are not negative."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, 1e-2, 1e-2])
    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def _sketch(text: str) -> list[int]:
    """Three minimum hashes over the shingles of a text."""
    words = text.split()
    if len(words) < SHINGLE:
        shingles = {" ".join(words)}
    else:
        shingles = {" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}
    codes = np.fromiter((zlib.crc32(x.encode()) for x in shingles), np.uint64, len(shingles))
    # one multiplicative permutation of the 32-bit codes per hash
    return [int(((codes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917)]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column, rows: int) -> DataFrame:
    """Texts (_text, _toxic, _half, _weight) of at most ``rows`` labelled documents, by the hash of their id.

    Weight and half follow the sketches, so copies weigh as one text and mostly fall into one half.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & allowed)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    chosen = texts.join(F.broadcast(drawn), "_id")  # ``rows`` narrow rows at most

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [_sketch(text) for text in batch["_text"]]
            yield batch.assign(**{f"_k{n}": [k[n] for k in keys] for n in range(3)})

    kind = docs.schema[id_col].dataType.simpleString()
    sketched = chosen.mapInPandas(sketch, f"_id {kind}, _text string, _toxic int, _k0 long, _k1 long, _k2 long")
    sketched = materialise(sketched, "toxicity_sample")
    for n in range(3):
        sizes = sketched.groupBy(f"_k{n}").agg(F.count("*").alias(f"_n{n}"))
        sketched = sketched.join(F.broadcast(sizes), f"_k{n}")  # ``rows`` narrow rows at most
    half = F.pmod(F.xxhash64("_k0"), F.lit(2)).cast("int")
    weight = F.lit(1.0) / F.greatest("_n0", "_n1", "_n2")
    return sketched.select("_text", "_toxic", half.alias("_half"), weight.alias("_weight"))


def _counted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the documents per half and bucket, toxic and other; the last bucket holds all documents."""
    every = 1 << BUCKET_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for batch in batches:
            keys, weights = [], []
            for text, toxic, half, weight in zip(*(batch[c] for c in ("_text", "_toxic", "_half", "_weight")), strict=True):
                seen = {b for word in set(text.split()) for b in buckets[word]} | {every}
                keys.append(np.fromiter(seen, np.int64, len(seen)) * 4 + 2 * half + toxic)
                weights.append(np.full(len(seen), weight))
            if keys:
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                yield pd.DataFrame({"key": key, "n": np.bincount(at, np.concatenate(weights))})

    counts = sample.mapInPandas(count, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((every + 1, 2, 2))
    key = counts["key"].to_numpy()
    # rounded, so that the order of summation does not show
    table[key >> 2, key >> 1 & 1, key & 1] = counts["n"].to_numpy().round(6)
    return table[:, :, 1].T, table[:, :, 0].T


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_filter: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Weights and calibration from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    allowed = F.lit(True) if train_filter is None else train_filter
    sample = _sample(docs, labels, id_col, text_col, label_col, allowed, fit_rows)
    toxic, clean = _counted(sample)

    def weights_of(t: np.ndarray, c: np.ndarray) -> Weights:
        return weigh(t[:-1], c[:-1], float(t[-1]), float(c[-1]))

    weights = weights_of(toxic.sum(0), clean.sum(0))
    crossed = spark.sparkContext.broadcast([weights_of(toxic[1 - h], clean[1 - h]) for h in (0, 1)])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(w) for w in crossed.value]
        for batch in batches:
            rows = []
            for text, label, half, weight in zip(*(batch[c] for c in ("_text", "_toxic", "_half", "_weight")), strict=True):
                scores = scorers[half].scores(text)
                parts = [round(s, 3) for _, _, s in maximal_segments(scores)]
                positive = scores[scores > 0]
                rows.append((label, weight, len(scores), parts, float(np.exp(positive).sum()), len(positive)))
            yield pd.DataFrame(rows, columns=["toxic", "weight", "words", "parts", "grown", "positives"])

    seen = sample.mapInPandas(
        measure, "toxic int, weight double, words long, parts array<double>, grown double, positives long"
    )
    seen = seen.toArrow().to_pandas()
    if seen["toxic"].nunique() < 2:
        return Model(weights)
    calm = seen[seen["toxic"] == 0]
    positives, neutral = float(calm["positives"].sum()), float((calm["words"] - calm["positives"]).sum())
    mean_growth = math.log(max(float(calm["grown"].sum()), 1e-9) / max(positives, 1e-9)) if positives else 1.0
    rate = _rate(np.array([-DRIFT, mean_growth]), np.array([max(neutral, 1.0), positives]))
    best = calm["parts"].map(lambda p: max(p, default=0.0)).to_numpy()
    # K from the mean number of clean segments, counted as if each began anywhere
    hits = (np.exp(rate * np.minimum(best, 50)) * (best > 0)).sum() / max(1.0, float(calm["words"].sum()))
    model = Model(weights, rate, float(min(max(hits, 1e-4), 1.0)))
    inputs = [
        (max(values, default=_FLOOR), math.log1p(sum(v >= -math.log(SIGNIFICANT) for v in values)))
        for values in ([model.value(s, n) for s in parts] for parts, n in zip(seen["parts"], seen["words"], strict=True))
    ]
    return Model(weights, model.rate, model.scale, _logistic(*(np.array(x, np.float64) for x in (inputs, seen["toxic"], seen["weight"]))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, score and, with ``passages``, the significant segments as
    (first word, end word, score)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 MB of weights
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, scorer = shared.value, Scorer(shared.value.weights)
        for batch in batches:
            found = [scorer.scores(text) for text in batch["_text"]]
            out = pd.DataFrame({"_id": batch["_id"], "score": [known.probability(known.inputs(s)) for s in found]})
            if passages:
                out["passages"] = [
                    [
                        {"start": a, "end": b, "score": v}
                        for a, b, v in maximal_segments(s)
                        if known.value(v, len(s)) >= -math.log(SIGNIFICANT)
                    ]
                    for s in found
                ]
            yield out

    schema = f"_id {kind}, score double" + ", passages array<struct<start:long,end:long,score:double>>" * passages
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInPandas(judge, schema).withColumnRenamed("_id", id_col)
