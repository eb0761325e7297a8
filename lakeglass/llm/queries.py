"""The queries of this subpackage on the shared test tables. Each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lakeglass.llm import collocations, decontaminate, embedding_dedup, language_id, line_dedup, lm_score, minhash_dedup, mixing, pii, prefix_trie, quality, token_files, url_filter
from lakeglass.llm.settings import TARGETS, TOKENIZER
from lakeglass.llm.shared import learns, rows_of, written
from lakeglass.runtime import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(~learns(F.col("doc_id")), F.lit(True)).alias("held_out")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranges = F.array_join(F.transform("deleted", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return done.select("doc_id", "n_lines", "n_deleted", ranges.alias("deleted"), F.md5("text").alias("text_md5"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures, events = (spark.sql(text.replace("FROM pages", "FROM {pages}"), pages=pages) for text in (url_filter.CAPTURES, url_filter.EVENTS))
    found = url_filter.evaluate(captures, events)
    return found.select("page_id", "host", "fetched_at", "n_entries", F.concat_ws(",", "lists").alias("lists"), "blocked")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read_tokens(spark, path, with_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    measured, _ = written(quality.with_statistics(documents).drop("text"), "statistics")
    calibrates = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    model = quality.fit(measured.where(learns(F.col("doc_id"))).join(labels, "doc_id"), "label", calibrates)
    scored = quality.score(measured, model)
    return scored.select("doc_id", held_out(), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("perplexity", F.exp(-F.col("log_score")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.where(learns(F.col("doc_id"))).select("text", "lang"))
    found = language_id.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(), "lang_pred", "score")


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text, domain``: the documents of the labelled table, with the domain that is known of them."""
    return rows_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("lang").alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, domains, _ = mixing.mix(documents, labelled_domains(spark, sf_dir), TARGETS)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return mixed.select("doc_id", "source", "tokens", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), F.array_max("posterior").alias("probability"),
                        "rate", "copies")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(documents, pii.fit(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def with_shared_openings(steps: DataFrame) -> DataFrame:
    """Conversations that open alike: the first ``h`` turns of a conversation are those of the next smaller id divisible by five."""
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("n"))
    plan = lengths.selectExpr("conv_id", "conv_id - conv_id % 5 AS base", "crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 9 AS h")
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    opening = steps.where("depth <= 8").withColumnRenamed("conv_id", "base").join(plan, "base").where("depth <= h").select(steps.columns)
    rest = steps.join(plan, "conv_id").where("depth > h").withColumn("depth", F.expr("depth - h + least(h, coalesce(base_n, 0L))"))
    return written(opening.union(rest.select(steps.columns)), "steps")[0]


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    steps = with_shared_openings(prefix_trie.numbered(conversations))
    return prefix_trie.trie(steps, conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id")))


BUILDERS = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_line_dedup, op3_minhash_near_dedup, op4_decontamination, op5_url_filter, op6_token_files, op7_quality, op8_lm_score,
    op9_language_id, op10_mixing, op11_collocations, op12_pii, op13_conversation_trie)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": embedding_dedup.ORACLE, "op4_decontamination": decontaminate.ORACLE,
                           "op5_url_filter": url_filter.ORACLE, "op11_collocations": collocations.ORACLE, "op13_conversation_trie": prefix_trie.ORACLE}
