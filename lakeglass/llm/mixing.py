"""Mixing to target weights with soft membership, in DataFrame operations only.

1. A labelled table teaches a classifier, whatever its domains are. A document is reduced to the counts of its words, which are
   runs of letters and digits or single signs of scripts without spaces, lower-cased; multinomial naive Bayes over
   all labelled rows gives each document a probability per domain. The only bound is on the size of the model: words
   are hashed to ``FEATURES`` places, so some share one.
2. Rates of documents, at first 1, are moved by projected-gradient steps on the squared differences between expected tokens per
   domain, ``sum(rate * tokens * probability)``, and the targets, and never below a least rate. A step needs one sum per domain over all
   documents; the driver sees those sums only. A step is an expression over the columns, and every ``STEPS_A_TABLE``
   steps the rates are written, so that plans stay short.
3. What ``STEPS`` such steps leave open, steps scaled by the curvature close: the rates become
   ``max(least, rate + sum(shift * probability))`` with a shift per domain, moved by damped Newton steps, until the
   targets are met or no shift comes nearer to them. A gap that then remains is warned of with its size.

Targets are weights of domains. Totals follow from them as the smallest that ask no domain for fewer tokens than it
has, or from ``total_tokens``. By default the least rate is 1, so that rare domains are repeated and nothing is thrown
away, however unclear the documents are; with ``total_tokens`` it is 0.

Defined results: a null or empty text has no tokens; its rate is 1. Rows without a domain teach nothing, rows that
repeat count again. Without labelled rows, or where a target domain has none of the expected tokens, that target is
left out of the fit. Columns named like the results are replaced.
"""

from __future__ import annotations

import unicodedata
import warnings

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import discard, replacing, written

#: Places of hashed words; the model holds a number for each of them and each domain.
FEATURES = 1 << 16
#: What lies between words, and the end of each sign of a script that is written without spaces.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+|(?<=[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF])"
#: The same for texts of the first 256 signs alone: as a plain list of signs it takes Java's regex one look at a table per sign, and no look behind.
BETWEEN_LATIN = "[" + "".join(rf"\x{c:02X}" for c in range(256) if unicodedata.category(chr(c))[0] not in "LMN") + "]+"
BEYOND_LATIN = r"[^\x00-\xFF]"
#: What ``\s`` takes, as such a list.
SPACE = r"[ \t\n\x0B\f\r]+"
STEPS = 40
STEPS_A_TABLE = 10
CLOSE = 1e-4
#: Of a domain's tokens, how much a shift costs, so that targets out of reach have a nearest point.
STIFFNESS = 1e-6
SMOOTHING = 0.5


def _counts(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the counts of hashed words of ``text`` as the vector ``name``."""
    lowered = df.withColumn("_mix_lower", F.lower(text)).withColumn("_mix_words", _words(F.col("_mix_lower")))
    return HashingTF(inputCol="_mix_words", outputCol=name, numFeatures=FEATURES).transform(lowered).drop("_mix_lower", "_mix_words")


def _words(text: Column) -> Column:
    """The words of a text that is in lower case. Both patterns give the same on texts of the first 256 signs; one is fast."""
    latin = (F.octet_length(text) == F.length(text)) | ~text.rlike(BEYOND_LATIN)
    return F.array_remove(F.when(latin, F.split(text, BETWEEN_LATIN)).otherwise(F.split(text, BETWEEN)), "")


def with_posteriors(docs: DataFrame, labelled: DataFrame, domain: str = "domain", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with ``tokens`` and an array ``posterior`` over the sorted domains, which are returned too."""
    known = labelled.select(F.col(text).cast("string").alias("text"), F.col(domain).cast("string").alias("domain")).where("text IS NOT NULL AND domain IS NOT NULL")
    domains = sorted(r["domain"] for r in known.select("domain").distinct().collect())  # a row per domain
    base = replacing(docs, "tokens", "posterior", "rate", "copies").withColumn("tokens", _tokens(F.col(text)))
    if len(domains) < 2:
        return base.withColumn("posterior", F.array(*[F.lit(1.0)] * len(domains)).cast("array<double>")), domains
    number = (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("double")
    lessons = _counts(known, F.col("text"), "counts").select(number.alias("number"), "counts")
    model = NaiveBayes(featuresCol="counts", labelCol="number", smoothing=SMOOTHING).fit(lessons)
    model.setFeaturesCol("_mix_counts").setProbabilityCol("_mix_share").setPredictionCol("").setRawPredictionCol("")
    found = model.transform(_counts(base, F.coalesce(F.col(text).cast("string"), F.lit("")), "_mix_counts"))
    return found.withColumn("posterior", vector_to_array("_mix_share")).drop("_mix_counts", "_mix_share"), domains


def _tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.array_size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("bigint")


def fit_rates(measured: DataFrame, domains: list[str], targets: dict[str, float], total_tokens: float | None = None,
              least: float = 0.0) -> tuple[DataFrame, dict[str, float]]:
    """``measured``, which has ``tokens`` and ``posterior``, with ``rate``, not below ``least``; and the target tokens per domain."""
    spark = measured.sparkSession
    now = replacing(measured, "rate").withColumn("rate", F.lit(1.0))

    def totals(df: DataFrame) -> list[float]:
        sums = df.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[k]) for k in range(len(domains))]).first() if domains else []
        return [x or 0.0 for x in sums]

    have = totals(now)
    used = [k for k, d in enumerate(domains) if targets.get(d, 0) > 0 and have[k] > 0]
    if not used:
        return now, {}
    weight = sum(targets[domains[k]] for k in used)
    share = {k: targets[domains[k]] / weight for k in used}
    total = max(have[k] / share[k] for k in used) if total_tokens is None else total_tokens
    goal = {k: share[k] * total for k in used}
    path = None
    for step in range(STEPS):
        sums = have if step == 0 else totals(now)
        gap = {k: (sums[k] - goal[k]) / have[k] for k in used}
        if max(abs(sums[k] - goal[k]) for k in used) <= CLOSE * total:
            break
        # the gradient of the squares scaled by a document's tokens, a domain's by its own, so that a step of 1 is stable
        descent = sum((F.col("posterior")[k] * F.lit(gap[k]) for k in used), F.lit(0.0))
        now = now.withColumn("rate", F.when(F.col("tokens") > 0, F.greatest(F.lit(least), F.col("rate") - descent)).otherwise(F.col("rate")))
        if step % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            now, new = written(now, "rates")
            if path:
                discard(spark, path)
            path = new
    else:
        now = _closed(now, {k: goal[k] for k in used}, {k: have[k] for k in used}, total, least, [domains[k] for k in used])
    return now, {domains[k]: goal[k] for k in used}


def _closed(now: DataFrame, goal: dict[int, float], have: dict[int, float], total: float, least: float, names: list[str]) -> DataFrame:
    """``now`` with the nearest rates, not below ``least``, that meet the goals, or come nearest to them."""
    used = list(goal)
    want, stiff = np.array([goal[k] for k in used]), STIFFNESS * np.array([have[k] for k in used])
    places = [(i, j) for i in range(len(used)) for j in range(i + 1)]

    def shifted(shift: np.ndarray) -> DataFrame:
        moved = sum((F.col("posterior")[k] * F.lit(float(x)) for k, x in zip(used, shift)), F.col("rate"))
        return now.withColumn("_mix_moved", moved).withColumn(
            "rate", F.when(F.col("tokens") > 0, F.greatest(F.lit(least), F.col("_mix_moved"))).otherwise(F.col("rate")))

    def measured(shift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual value, its slope and curvature, and the gaps."""
        p, t = [F.col("posterior")[k] for k in used], F.col("tokens")
        found = shifted(shift).agg(
            F.sum(t * F.col("rate") * (F.col("_mix_moved") - F.col("rate") / 2)), *[F.sum(F.col("rate") * t * x) for x in p],
            *[F.sum(F.when(F.col("_mix_moved") > least, t * p[i] * p[j])) for i, j in places]).first()
        found = np.array([x or 0.0 for x in found], float)
        gaps, curve = found[1:len(used) + 1] - want, np.zeros((len(used), len(used)))
        for (i, j), x in zip(places, found[len(used) + 1:]):
            curve[i, j] = curve[j, i] = x
        return found[0] - shift @ want + stiff @ shift**2 / 2, gaps + stiff * shift, curve + np.diag(stiff), gaps

    shift, damping = np.zeros(len(used)), 1e-3
    value, slope, curve, gaps = measured(shift)
    while abs(gaps).max() > CLOSE * total and abs(slope).max() > CLOSE * total / 100 and damping < 1e9:
        step = -np.linalg.solve(curve + damping * np.diag(stiff / STIFFNESS), slope)
        tried = measured(shift + step)
        if tried[0] < value:
            shift, damping, (value, slope, curve, gaps) = shift + step, max(damping / 10, 1e-9), tried
        else:
            damping *= 4
    if abs(gaps).max() > CLOSE * total:
        missed = ", ".join(f"{d} {g / total:+.2%}" for d, g in zip(names, gaps))
        warnings.warn(f"no rates from {least:g} on meet the targets; of all tokens there are too many (+) or too few (-): {missed}", stacklevel=3)
    return shifted(shift).drop("_mix_moved")


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate, in thousandths: its whole part, and one more for the share of ids whose hash falls below the rest."""
    rate = F.round(rate, 3)
    draw = F.pmod(F.xxhash64(F.lit(10), doc_id), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", domain: str = "domain",
        total_tokens: float | None = None) -> tuple[DataFrame, list[str], dict[str, float]]:
    """``docs`` without their texts, with ``tokens, posterior, rate, copies``; the domains; the target tokens per domain."""
    posteriors, domains = with_posteriors(docs, labelled, domain, text)
    measured, _ = written(posteriors.drop(text), "posteriors")
    rated, goal = fit_rates(measured, domains, targets, total_tokens, 1.0 if total_tokens is None else 0.0)
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col(doc_id))), domains, goal


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", domain: str = "domain",
             total_tokens: float | None = None) -> DataFrame:
    """The rows of ``docs``, with their own columns, as often as their ``copies`` say."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    print_of = F.xxhash64(body, F.length(body))
    mixed, _, _ = mix(docs.select(F.col(doc_id).alias("_mix_id"), F.col(text).alias("_mix_text"), print_of.alias("_mix_print")), labelled.select(
        F.col(text).alias("_mix_text"), F.col(domain).alias("domain")), targets, "_mix_id", "_mix_text", "domain", total_tokens)
    times, _ = written(mixed.select("_mix_id", "_mix_print", "copies").distinct(), "copies")
    joined = docs.join(times, F.col(doc_id).eqNullSafe(F.col("_mix_id")) & (print_of == F.col("_mix_print")))
    return joined.where("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
