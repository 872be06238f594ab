"""A corpus pipeline: language ID, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table
from tickloom.llm.decontaminate import contaminated
from tickloom.llm.language_id import UNKNOWN, language_id
from tickloom.llm.ngram_join import ngram_join
from tickloom.llm.packing import best_fit_packing
from tickloom.llm.pii import sanitise
from tickloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no n-gram of any language beyond chance."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id(docs, docs.where(~held_out))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_key`, a hash of the whole row: ids may be null or repeated, and a row is more than its id."""
    names = docs.columns
    return docs.withColumn("_key", F.xxhash64(*[F.col(c) for c in names], *[F.col(c).isNull() for c in names]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id, nulls last; of equal rows with words one stays."""
    rows = keyed(docs)
    found = ngram_join(rows, id_col="_key").where("n_shingles > 0").groupBy("_key").agg(F.min("component_id").alias("component"), F.count("*").alias("copies"))
    ids = rows.select("_key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = found.join(ids, "_key").groupBy("component").agg(F.min_by("_key", order).alias("first"))
    marks = found.join(first, "component").where((F.col("_key") != F.col("first")) | (F.col("copies") > 1))
    marks = stored(marks.select("_key", (F.col("_key") == F.col("first")).alias("repeated")), "marks")
    marked = rows.join(marks, "_key", "left")
    once = marked.where("repeated").dropDuplicates(["_key"])
    return marked.where("repeated is null").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    rows = keyed(docs)
    leaks = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_key").select("_key").distinct()
    return rows.join(leaks, "_key", "left_anti").select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are taken out of the texts; n_chars follows where a text changed."""
    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", remove_personal_data),
    ("best_fit_packing", pack),
]

#: Hash filters, trained models and a tokenizer: not expressible in SQL. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
