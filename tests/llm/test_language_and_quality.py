import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglass.llm import language_id, quality
from lakeglass.llm.shared import crc_fold, learns

ODD = [(1, "", "en"), (2, None, "en"), (None, "the other thing", None), (3, "12345 !!", "fr"), (4, "the and of " * 20_000, "en"), (4, "the and of", "en"), (4, "the and of", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1.5) for r in ODD], "doc_id long, text string, lang string, lang_pred string, score double")


def test_fold(spark):
    rows = spark.range(50).select("id", learns(F.col("id")).alias("learns")).collect()
    assert all(r.learns == (crc_fold(r.id) != 0) for r in rows)


def test_trigrams():
    assert len(language_id.trigrams(None)) == len(language_id.trigrams("12 !?")) == 0
    assert list(language_id.trigrams("Ab!!  ab")) == list(language_id.trigrams("ab ab"))
    assert len(language_id.trigrams("a")) == 1
    numbers, counts = np.array([1, 5000, 110_000] * 3000), np.ones(9000)
    pairs, letters = language_id._vectors()
    whole = (pairs[numbers // 48].astype(float) * letters[numbers % 48]).sum(axis=0)
    assert np.allclose(language_id.bundle(numbers, counts), whole)


def test_language_of_odd_texts(spark, odd):
    model = language_id.fit(odd)
    assert model.languages == ("en",)  # the only French row has no letters
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(ODD) and list(language_id.identify(odd, model).columns) == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert r.lang_pred == ("en" if letters else "und") and 0 <= r.score <= 1 and (letters or r.score == 0)
    nothing = language_id.fit(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark, table):
    docs = table("documents")
    model = language_id.fit(docs.where(learns(F.col("doc_id"))))
    rows = language_id.identify(docs.where(~learns(F.col("doc_id"))), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_least_scores_come_from_all_texts(spark):
    """Two in a hundred texts are unlike the others, and no choice of some texts may miss them."""
    plain = "the children went to the house"
    other = [f"{a}{b}{a}q" for a in "xzjkvw" for b in "bcdfgh"]
    # the odd text has a greater hash than the plain one, so an order by hash has it last
    odd = spark.createDataFrame([(t, plain) for t in other], "t string, p string").where("xxhash64(t) > xxhash64(p)").first().t
    docs = spark.createDataFrame([(plain, "en")] * 2940 + [(odd, "en")] * 60, "text string, lang string")
    model = language_id.fit(docs.where(F.col("text") == plain))
    least = language_id.least_scores(docs, model)
    floor = language_id.NOISE / language_id.DIMENSIONS**0.5
    assert (least[:3] == floor).all() and least[-1] > floor
    assert language_id.least_scores(docs.where(F.col("text") == plain), model)[0] > floor


def test_statistics():
    assert quality.statistics_of(None) == quality.statistics_of("") == [0.0] * len(quality.STATISTICS)
    found = dict(zip(quality.STATISTICS, quality.statistics_of("AB AB 1\nx.")))
    assert found["capital_words"] == 0.5 and found["repeated_neighbours"] == 0.25 and found["distinct_words"] == 0.75
    assert found["ends_of_sentences"] == 0.25 and found["unlettered_words"] == 0.25 and found["log_lines"] == np.log1p(2)
    assert all(np.isfinite(quality.statistics_of(t)).all() for t in ("\n\n", " ", "é" * 100_000, "\x00"))


def test_isotonic_against_brute_force():
    random = np.random.default_rng(0)
    for _ in range(20):
        score, n = np.arange(12.0), random.integers(1, 9, 12).astype(float)
        positive = np.floor(random.random(12) * (n + 1))
        knots, values = quality.isotonic(score, positive, n)
        share = positive / n
        # max over starts of min over ends of the mean between them is the isotonic fit
        def mean(a, b):
            return positive[a:b + 1].sum() / n[a:b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert len(share) == 12 and len(values) == len(set(np.round(want, 12))) and np.all(np.diff(knots) > 0)


def test_quality_model(spark, table, odd):
    labels = table("labels").select("doc_id", F.col("quality").alias("label"))
    docs = quality.with_statistics(table("documents")).drop("text")
    rows = docs.join(labels, "doc_id")
    model = quality.fit(rows.where(learns(F.col("doc_id"))), "label", F.col("doc_id") % 5 == 1)
    found = quality.score(rows, model).collect()
    good = [r.score for r in found if r.label == 1]
    bad = [r.score for r in found if r.label == 0]
    assert all(0 <= r.score <= 1 for r in found) and np.mean([a > b for a in good for b in bad]) > 0.9
    # the summed normal equations give what plain numpy gives
    learned = rows.where(learns(F.col("doc_id"))).where("doc_id % 5 <> 1").collect()
    phi = quality.features(np.array([r.statistics for r in learned]), model.mean, model.spread)
    damping = np.diag([quality.RIDGE * len(learned) + 1e-9] * quality.FEATURES + [1e-9])
    want = np.linalg.solve(phi.T @ phi + damping, phi.T @ np.array([r.label for r in learned], float))
    assert np.allclose(phi @ want, phi @ model.weights, atol=1e-6)


def test_quality_of_odd_rows(spark, odd):
    measured = quality.with_statistics(odd)
    assert measured.columns == [*odd.columns, "statistics"]
    none = quality.fit(measured.withColumn("label", F.lit(None).cast("int")))
    assert {r.score for r in quality.score(measured, none).collect()} == {0.5}
    one = quality.fit(measured.withColumn("label", F.lit(1)))
    assert all(r.score > 0.8 for r in quality.score(measured, one).collect())
    assert quality.score(measured.limit(0), one).count() == 0
