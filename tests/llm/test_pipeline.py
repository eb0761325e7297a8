import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeglass.llm import token_files
from lakeglass.llm.settings import NEAR_PERCENT, TOKENIZER
from tests.llm.test_near_duplicates import groups, plain_sets
from tests.llm.test_text_operators import contamination_by_brute_force

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_every_stage_is_tested():
    assert {f"test_{name}_stage" for name in STAGES} <= set(globals())


def test_language_id_stage(spark, table):
    docs = table("documents").limit(300)
    mixed = docs.union(docs.limit(20).withColumn("doc_id", -1 - F.col("doc_id")).withColumn("text", F.lit("12345 !? 67")))
    got = STAGES["language_id"](spark, mixed, SF)
    assert got.columns == docs.columns
    assert sorted(got.collect()) == sorted(r for r in mixed.collect() if any(c.isalpha() for c in r.text or ""))


def near_pairs():
    """Pairs whose sets agree from 80% up to below 85%, pairs just below 80%, and lone texts."""
    rng, rows = random.Random(12), []
    for tail in [20] * 60 + [25] * 40 + [200] * 10:
        words = [f"v{rng.randrange(10**9)}" for _ in range(204)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:204 - tail] + [f"u{rng.randrange(10**9)}" for _ in range(tail)]))]
    return rows + [(5000, None), (5001, "")]


def test_minhash_near_dedup_stage(spark):
    rows = near_pairs()
    sets = {i: plain_sets(t) for i, t in rows}
    alike = {(a, a + 1): len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, 220, 2)}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) == 60 and NEAR_PERCENT == 80
    want = groups(sets, [p for p, x in alike.items() if 100 * x >= NEAR_PERCENT])
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in STAGES["minhash_near_dedup"](spark, docs, SF).collect()) == sorted(i for i in sets if want[i] == i)


def test_decontamination_stage(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=14))) for i in range(10)]
    rows = [(i, " ".join(rng.choices(words, k=30) + items[i % 10][1].split()[:rng.choice([0, 5, 9, 10, 14])] + rng.choices(words, k=5))) for i in range(60)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = contamination_by_brute_force(rows, items)
    got = {r.doc_id for r in STAGES["decontamination"](spark, frame(spark, rows), str(tmp_path)).collect()}
    assert 0 < len(got) < len(rows) and got == {i for i, _ in rows if not want[i][-1]}


def test_mixing_stage(spark, table):
    docs = table("documents")
    got = STAGES["mixing"](spark, docs, SF)
    assert got.columns == docs.columns
    held = {r.doc_id: r for r in docs.collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(held) and all(r == held[r.doc_id] for r in rows)


def test_token_files_stage(spark):
    tokenizer = token_files._tokenizer(TOKENIZER)
    rows = [(4, "The cat sat."), (2, None), (3, "Où est-il ? " * 40), (None, "x y")]
    got = STAGES["token_files"](spark, frame(spark, rows), SF)
    counts = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    assert "ids" not in got.columns and {r.doc_id: r.n_tokens for r in got.collect()} == counts


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_no_documents(spark, table, name):
    assert STAGES[name](spark, table("documents").limit(0), SF).count() == 0


def test_texts_in_no_language_go(spark, table):
    """Other scripts and random letters go at any length, short clean texts stay."""
    rng, clean = random.Random(7), table("documents")
    scripts = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "chinese": [chr(c) for c in range(0x4E00, 0x5E00)], "latin": list("abcdefghijklmnopqrstuvwxyz")}
    rows = []
    for script, letters in scripts.items():
        for n in ([30, 300] if script == "latin" else [3, 30, 300]):
            rows += [(10**6 + len(rows) + k, " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n)), script) for k in range(40)]
    short = ["The children went to the house.", "Nous avons une maison dans la ville.", "Das ist nicht die Zeit für mich.", "La casa de los padres está en la ciudad."]
    rows += [(2 * 10**6 + k, t, "short") for k, t in enumerate(short)]
    # the ids teach nothing: their labels are null
    docs = clean.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string"))
    stay = {r.doc_id for r in STAGES["language_id"](spark, docs, SF).select("doc_id").collect()}
    kept = {s: sum(i in stay for i, _, x in rows if x == s) / sum(x == s for _, _, x in rows) for s in [*scripts, "short"]}
    assert kept["short"] == 1 and max(kept[s] for s in scripts) <= 0.02, kept
    assert sum(r.doc_id not in stay for r in clean.select("doc_id").collect()) == 0


def test_stages_give_python_small_batches(spark):
    for stage in STAGES.values():
        own = spark.newSession()
        docs = frame(own, [(i, f"some words of text {i} " * 200) for i in range(3000)]).coalesce(1)
        stage(own, docs.limit(0), SF)
        sizes = [r.n for r in docs.mapInPandas(lambda batches: (b[["text"]].sum().map(len).to_frame("n") for b in batches), "n long").collect()]
        assert sum(sizes) == sum(len(f"some words of text {i} ") * 200 for i in range(3000))
        assert max(sizes) <= 1.1 * corpus_pipeline.BATCH_BYTES
