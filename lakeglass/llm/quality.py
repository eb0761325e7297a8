"""Document quality: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Every text becomes ``len(STATISTICS)`` numbers, scaled by mean and deviation of the learning rows. Cosines of random
projections of them approximate a Gaussian kernel. Tasks sum the parts of the normal equations, Spark adds them up,
and one small system gives the weights. A fifth of the learning rows is left out of that and calibrates the scores:
pooled adjacent violators over ``BINS`` score bins, read off linearly between the pools.

Defined results: null and empty texts have statistics too (all zero) and get a score. Rows without a label teach
nothing; repeated rows count again. With no labels at all every score is 0.5, with one class only it is that class's share.
Columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import replacing

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_neighbours", "capitals", "capital_words",
    "digits", "stops", "odd_signs", "blanks", "log_lines", "distinct_lines", "log_line_length", "unlettered_words", "ends_of_sentences",
)
FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-3  # times the number of rows
BINS = 200
CLIP = 6.0

# Classes of ASCII bytes: 0 others, 1 capitals, 2 digits, 3 white space, 4 stops and quotes, 5 odd signs, 6 small letters.
_CLASSES = np.zeros(256, np.uint8)
for _class, _signs in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " \t\n\r\v\f"), (4, ".,;:'\"()-?!"), (5, "#$%&*+/<=>@[\\]^_`{|}~"), (6, "abcdefghijklmnopqrstuvwxyz")):
    for _sign in _signs:
        _CLASSES[ord(_sign)] = _class

_random = np.random.default_rng(7)
_PROJECTION = _random.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES))
_PHASE = _random.uniform(0, 2 * np.pi, FEATURES)


def statistics_of(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    often = Counter(words)
    signs = Counter(word[-1] for word in words)
    distinct_lines = len(set(lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(often) / n, max(often.values(), default=0) / n,
        sum(map(str.__eq__, words[1:], words)) / n, counts[1], sum(map(str.isupper, words)) / n, counts[2], counts[4], counts[5], counts[3],
        np.log1p(len(lines)), distinct_lines / len(lines), np.log1p(len(text) / len(lines)), 1 - sum(map(str.isalpha, (word[:1] for word in words))) / n,
        (signs["."] + signs["!"] + signs["?"]) / n,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array column ``statistics``."""

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(x) for x in texts])

    return replacing(docs, "statistics").withColumn("statistics", numbers(F.col(text)))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores and what they are calibrated to
    values: np.ndarray

    def raw(self, table: np.ndarray) -> np.ndarray:
        return features(table, self.mean, self.spread) @ self.weights

    def score(self, table: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(table), self.knots, self.values), 0, 1)


def features(table: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    scaled = np.clip((table - mean) / spread, -CLIP, CLIP)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(scaled @ _PROJECTION + _PHASE), np.ones((len(table), 1))])


def isotonic(score: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until the shares of positives do not fall; the pools' mean scores and shares, drawn in by one row."""
    pools: list[list[float]] = []
    for s, p, n in zip(score, positive, total):
        pools.append([s * n, p, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], (table[:, 1] + 0.5) / (table[:, 2] + 1)


def fit(rows: DataFrame, label: str = "label", calibrates: Column | None = None) -> QualityModel:
    """Learn from ``statistics`` and a 0/1 ``label``. ``calibrates`` marks the rows kept for calibration."""
    marked = rows.select("statistics", F.col(label).cast("double").alias("label"), (F.lit(False) if calibrates is None else calibrates).alias("calibrates"))
    known = marked.where("label IN (0, 1) AND statistics IS NOT NULL")
    width = len(STATISTICS)
    sums = known.select(F.count("*").alias("n"), *[f(F.col("statistics")[k]) for k in range(width) for f in (F.avg, F.stddev_pop)]).first()
    n, moments = sums[0], np.array([0.0 if x is None else x for x in sums[1:]]).reshape(width, 2)
    mean, spread = moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0)
    if not n:
        return QualityModel(mean, spread, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.iloc[at:at + 2048]
                phi = features(np.stack(some["statistics"]), mean, spread)
                total += phi.T @ np.hstack([phi, some["label"].to_numpy()[:, None]])
        yield pd.DataFrame({"place": np.arange(FEATURES + 1), "line": list(total)})

    lines = known.where("NOT calibrates").select("statistics", "label").mapInPandas(equations, "place int, line array<double>")
    cells = lines.select("place", F.posexplode("line").alias("column", "value")).groupBy("place", "column").agg(F.sum("value").alias("value"))
    table = cells.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("cells")).select("place", "cells.value").toPandas()
    system = np.zeros((FEATURES + 1, FEATURES + 2))  # its size does not depend on the data
    for place, value in zip(table["place"], table["value"]):
        system[place] = value
    used = system[-1, -2]
    damping = np.diag(np.append(np.full(FEATURES, RIDGE * used + 1e-9), 1e-9))
    weights = np.linalg.solve(system[:, :-1] + damping, system[:, -1])
    draft = QualityModel(mean, spread, weights, np.array([-1e9, 1e9]), np.array([0.0, 0.0]))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = draft.raw(np.stack(batch["statistics"]))
                slot = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(int)
                yield pd.DataFrame({"slot": slot, "raw": raw, "label": batch["label"]})

    chosen = known.where("calibrates") if calibrates is not None and known.where("calibrates").limit(1).count() else known
    pooled = chosen.select("statistics", "label").mapInPandas(bins, "slot int, raw double, label double").groupBy("slot").agg(
        F.avg("raw").alias("raw"), F.sum("label").alias("positive"), F.count("*").alias("n")).toPandas().sort_values("slot")
    knots, values = isotonic(*(pooled[c].to_numpy(np.float64) for c in ("raw", "positive", "n")))
    return QualityModel(mean, spread, weights, knots, values)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs``, which have ``statistics``, with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(statistics: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(statistics)) if len(statistics) else [], dtype=float)

    return replacing(docs, "score").withColumn("score", scored("statistics"))
