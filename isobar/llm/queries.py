"""The queries of this subpackage: thin calls of the operators on their whole tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import block_matrix_knn, collocations, itq_dedup, ngram_jaccard
from isobar.llm.block_matrix_knn import nearest
from isobar.llm.fitting import remainder
from isobar.llm.html_extract import extract_pages
from isobar.llm.itq_dedup import near_duplicates
from isobar.llm.mixing import mix
from isobar.llm.ngram_jaccard import jaccard_groups
from isobar.llm.packing import pack
from isobar.llm.periodic_runs import periodic_runs
from isobar.llm.personal_data import digest, find_personal_data, train_personal_data
from isobar.llm.preference import ORACLE as PREFERENCE_SQL
from isobar.llm.preference import format_preferences
from isobar.llm.quality import score_quality, train_quality
from isobar.llm.toxicity import score_toxicity, train_toxicity
from isobar.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_block_matrix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, remainder("doc_id", 4) != 2)
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = train_quality(docs, labels, remainder("doc_id", 3) != 1)
    out = score_quality(docs.select("doc_id", "text"), ranker)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Host and path rules of the URL filter query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 1)


#: Weights of the mixing query; max_epochs lets small leaves be repeated.
MIX_LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
MIX_DOMAINS = {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weight = lambda path: (MIX_DOMAINS, MIX_LANGUAGES, {})[len(path) - 1].get(path[-1], 1.0)
    out = mix(docs.select("doc_id", "text", "lang", "source"), [corpus_pipeline.domain(F.col("source")), F.col("lang"), F.col("source")], weight, 0.8, max_epochs=3, seed=7)
    return out.select("doc_id", F.col("__level0").alias("domain"), "lang", "source", F.col("__tokens").alias("tokens"), F.col("__epoch").alias("epoch"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_personal_data(docs, train_personal_data(docs)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op2_preference": op2_preference,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
    "op4_mixing": op4_mixing,
    "pipeline": pipeline,
    "op3_html_extract": op3_html_extract,
    "op5_url_filter": op5_url_filter,
    "op8_packing": op8_packing,
    "op1_toxicity": op1_toxicity,
    "op9_quality": op9_quality,
    "op6_block_matrix_knn": op6_block_matrix_knn,
    "op10_itq_dedup": op10_itq_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
}
ORACLE: dict[str, str] = {
    "op2_preference": PREFERENCE_SQL,
    "op6_block_matrix_knn": block_matrix_knn.ORACLE,
    "op7_ngram_jaccard": ngram_jaccard.ORACLE,
    "op10_itq_dedup": itq_dedup.ORACLE,
    "op13_collocations": collocations.oracle(),
}
