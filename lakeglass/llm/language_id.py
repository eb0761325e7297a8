"""Language identification with hyperdimensional profiles.

Every letter of every script has its own random vector of +1 and -1. A letter trigram ``abc`` is the product of the vectors of its letters,
those of ``a`` and ``b`` rotated by two and one places, so that order counts. A text is the sum of its trigram
vectors, a language the sum of its texts (each scaled to one), and a text belongs to the language whose sum has the
largest cosine with its own.

Unrelated texts have cosines around 0 with a deviation of 1 / sqrt(``DIMENSIONS``), and random letters of a language's alphabet more than
that. So ``least_scores`` measures which cosines learned texts have when cut to 1, 2, 4, ... trigrams; ``in_some_language``
keeps texts that reach ``SHARE`` of the low quantile for their length, and ``NOISE`` deviations.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing was
learned. Of languages with equal cosines the alphabetically first wins. Rows whose language or text is null teach
nothing; repeated rows count again. Columns named like the results are replaced; all others pass through.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import replacing

DIMENSIONS = 2048
#: 0 is whatever lies between words, 1-26 are a-z. Other letters are their code point and ``SYMBOLS``.
SYMBOLS = 48
#: Bits of a letter in the number of a trigram with letters beyond a-z; such numbers are negative.
LETTER_BITS = 21
#: Steps of a cosine of one in which ``least_scores`` counts.
STEPS = 10_000
QUANTILE, SHARE, NOISE = 0.01, 0.5, 3.0
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one row of DIMENSIONS per language


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of every code point."""
    table = np.zeros(0x110000, np.int32)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    table[letters] = letters + SYMBOLS
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return table


@functools.cache
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all pairs of first letters, and of last letters."""
    letters = np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    pairs = np.roll(letters, 2, axis=1)[:, None, :] * np.roll(letters, 1, axis=1)[None, :, :]
    return pairs.reshape(SYMBOLS * SYMBOLS, DIMENSIONS), letters


@functools.lru_cache(8192)
def _letter(symbol: int) -> np.ndarray:
    """The vector of a symbol; beyond a-z it is seeded by the code point."""
    if symbol < SYMBOLS:
        return _vectors()[1][symbol]
    return np.random.default_rng([20, symbol]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str | None) -> np.ndarray:
    """The trigram numbers of a text; runs of anything but letters count as one space."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.zeros(len(points) + 2, np.int64)
    row[1:-1] = _symbols()[points]
    keep = row > 0
    if not keep.any():
        return np.zeros(0, np.int64)
    keep[1:] |= row[:-1] > 0
    keep[0] = True
    row = row[keep]
    first, second, third = row[:-2], row[1:-1], row[2:]
    wide = (first >= SYMBOLS) | (second >= SYMBOLS) | (third >= SYMBOLS)
    return np.where(wide, ~((first << 2 * LETTER_BITS) | (second << LETTER_BITS) | third), (first * SYMBOLS + second) * SYMBOLS + third)


def bundle(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of trigram vectors, each as often as counted; in slices, so that memory does not grow."""
    pairs, letters = _vectors()
    total = np.zeros(DIMENSIONS)
    wide = numbers < 0
    plain, often = numbers[~wide], counts[~wide]
    for at in range(0, len(plain), 1024):
        some = plain[at:at + 1024]
        vectors = pairs[some // SYMBOLS] * letters[some % SYMBOLS]
        total += often[at:at + 1024].astype(np.float32) @ vectors.astype(np.float32)
    packed, often = ~numbers[wide], counts[wide]
    for at in range(0, len(packed), 1024):
        some = packed[at:at + 1024]
        parts = np.stack([some >> 2 * LETTER_BITS, some >> LETTER_BITS, some]) & ((1 << LETTER_BITS) - 1)
        known, place = np.unique(parts, return_inverse=True)
        first, second, third = place.reshape(parts.shape)
        table = np.stack([_letter(int(x)) for x in known])
        vectors = np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]
        total += often[at:at + 1024].astype(np.float32) @ vectors.astype(np.float32)
    return total


def hypervector(text: str | None) -> np.ndarray | None:
    numbers = trigrams(text)
    if not len(numbers):
        return None
    return bundle(*np.unique(numbers, return_counts=True))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn the prototypes of all languages in ``labelled``. Tasks send one vector per language, never texts."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares: dict[str, dict[int, float]] = {}
        sums: dict[str, np.ndarray] = {}

        def add(language: str) -> None:
            held = shares.pop(language)
            some = bundle(np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), float, len(held)))
            sums[language] = sums.get(language, 0.0) + some

        for batch in batches:
            for words, language in zip(batch["text"], batch["lang"]):
                numbers, counts = np.unique(trigrams(words), return_counts=True)
                if len(numbers):
                    total, weight = shares.setdefault(language, {}), 1 / counts.sum()
                    for x, n in zip(numbers.tolist(), counts.tolist()):
                        total[x] = total.get(x, 0.0) + n * weight
                    if len(total) > 100_000:
                        add(language)
        for language in list(shares):
            add(language)
        for language, total in sums.items():
            yield pd.DataFrame({"lang": language, "place": np.arange(DIMENSIONS), "value": total})

    known = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.mapInPandas(partial, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    table = sums.toPandas()  # one number per language and dimension
    if not len(table):
        return LanguageModel((), np.zeros((0, DIMENSIONS)))
    wide = table.pivot(index="lang", columns="place", values="value").sort_index()
    prototypes = wide.to_numpy()
    return LanguageModel(tuple(wide.index), prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300))


def _cosines(model: LanguageModel, numbers: np.ndarray) -> np.ndarray:
    vector = bundle(*np.unique(numbers, return_counts=True))
    return model.prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-300)


def least_scores(labelled: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Scores below which a text of at least 1, 2, 4, ... trigrams is in no language of ``model``, measured on all learned texts.

    Tasks send how many texts reach which step, so what is shuffled and sorted does not grow with the texts.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for numbers in map(trigrams, batch["text"]):
                vector = np.zeros(DIMENSIONS)
                for k in range(len(numbers).bit_length()):
                    vector += bundle(*np.unique(numbers[1 << k >> 1:1 << k], return_counts=True))
                    cosine = (shared.value.prototypes @ vector).max() / max(float(np.linalg.norm(vector)), 1e-300)
                    reached[k, math.floor(cosine * STEPS)] += 1
        yield pd.DataFrame([(k, step, n) for (k, step), n in reached.items()], columns=["k", "step", "n"])

    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").select("text")
    steps = known.mapInPandas(cut, "k int, step int, n bigint").groupBy("k", "step").agg(F.sum("n").alias("n"))
    found = steps.groupBy("k").agg((F.percentile("step", QUANTILE, F.col("n")) / STEPS).alias("low")).orderBy("k").collect()
    least = np.array([SHARE * r["low"] for r in found])
    return np.maximum(np.maximum.accumulate(least), NOISE / DIMENSIONS**0.5) if len(least) else np.array([NOISE / DIMENSIONS**0.5])


def in_some_language(docs: DataFrame, model: LanguageModel, least: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a language of ``model``, judged by ``least_scores``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, least))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        model, least = shared.value
        found = []
        for numbers in map(trigrams, texts):
            low = least[min(len(least), len(numbers).bit_length()) - 1]
            found.append(bool(len(numbers)) and bool(model.prototypes.size) and bool(_cosines(model, numbers).max() >= low))
        return pd.Series(found, dtype=bool)

    return docs.where(known(F.col(text)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language, as 0 where negative."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = []
        for words in texts:
            vector = hypervector(words)
            length = 0.0 if vector is None else float(np.linalg.norm(vector))
            if vector is None or not known.languages:
                out.append((UNKNOWN, 0.0))
                continue
            cosines = known.prototypes @ vector / max(length, 1e-300)
            best = int(np.argmax(cosines))
            out.append((known.languages[best], float(min(1.0, max(0.0, cosines[best])))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    found = docs.withColumn("_language", nearest(F.col(text)))
    return replacing(found, "lang_pred", "score").select("*", "_language.lang_pred", "_language.score").drop("_language")
