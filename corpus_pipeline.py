"""A training corpus in five stages, from `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. run() writes and rereads each stage's result
in the shared folder.

Every stage but the last keeps the columns of its documents, whatever their names, and every row that it does not reject: repeated rows
and ids are rows of their own, with or without an id; of equal or near texts one stays. A null or empty text is scored as one without words, has no
near copy and holds no tokens. Ties at a cut-off stay with the kept. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, fresh, small
from isobar.llm.fitting import remainder
from isobar.llm.mixing import mix
from isobar.llm.ngram_jaccard import jaccard_groups
from isobar.llm.packing import pack
from isobar.llm.quality import score_quality, train_quality
from isobar.llm.toxicity import score_toxicity, train_toxicity

#: Target weights of languages; domains and sources weigh alike.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: The share of the tokens that reach the mixing stage which it keeps.
KEEP = 0.9
DOMAINS = ["web", "books", "code", "forum"]


def domain(source: Column) -> Column:
    """The domain of a source: by the number in its name, since `documents` names none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.element_at(F.array(*map(F.lit, DOMAINS)), F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("int") % len(DOMAINS), F.lit(0)) + 1)


def weight(path: tuple[str, ...]) -> float:
    return LANGUAGES.get(path[1], 0.05) if len(path) == 2 else 1.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ranker = train_quality(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    (score,) = fresh(docs, "__quality")
    return score_quality(docs, ranker, score=score).where(F.col(score) >= 0.5).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    (score,) = fresh(docs, "__toxic")
    return score_toxicity(docs, model, score=score).where(F.col(score) < 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles (Jaccard 0.8) one row stays, that with the smallest id (nulls last; ties: the first row); texts without words all stay.

    Rows are told apart by their place in the table, not by id, so that a repeated id loses no text that stands nowhere else.
    """
    scratch = Scratch(spark)
    row, own = fresh(docs, "__row", "__id")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    groups = jaccard_groups(rows, id_col=row, k=5, num=80, den=100)
    linked = scratch.keep(groups.where(F.col("component_id") != F.col(row)).select(row, "component_id"), "linked")
    members = linked.unionByName(linked.select(F.col("component_id").alias(row), "component_id").distinct())
    named = rows.select(row, F.col("doc_id").alias(own)).join(small(members), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col(own).isNull(), F.col(own), F.col(row))).alias("first"))
    gone = scratch.keep(members.join(small(first.select(F.col("first")[row].alias(row))), row, "left_anti").select(row), "gone")
    return rows.join(small(gone), row, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """KEEP of the tokens, mixed by domain, language and source; no document more than once."""
    return mix(docs, [domain(F.col("source")), F.col("lang"), F.col("source")], weight, KEEP, max_epochs=1, seed=1).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)  # nothing reads it any more; the table that was given is none of ours
    return docs


#: Trained classifiers, similarity joins and packing have no SQL; the tests hold run() against plain loops.
ORACLE_SQL = None
