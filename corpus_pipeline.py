"""A corpus pipeline of five stages over `documents`; each is written as Parquet and read again as the next one's input.

toxicity      documents that the classifier rejects go
ngram_join    of each component of near duplicates one row stays
pii           personal data in texts is replaced by [KIND]; n_chars follows
mixing        documents are taken as often as their source's target asks, and range-sorted by curriculum position
packing       whole texts become pieces of sequences of 2048 tokens, numbered in the curriculum's order

The mixture's files and their rows stand in order of curriculum position; the packing
takes that place of each row from the files it reads, as Spark itself deals files to
tasks by size. Frames that aren't read from files are packed as they come.

Every stage decides by row: doc_ids may be null or repeat. Null and empty texts pass
the first three stages; the mixture takes no words from them. Columns other than
those of `documents` are left out. Empty tables give empty tables. Of rows alike in
all columns one stays in ngram_join.

ORACLE_SQL is None: SQL can express neither the classifier nor the tokenizer.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import mixing, packing, pii, setjoin, toxicity
from telemill.llm._text import Tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*_columns(docs))
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(~F.col("toxic_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (nulls last), then the smallest digest of its columns. Rows without words stay.

    The digest names a row; rows that share one are alike, and one of them stays.
    """
    docs = docs.select(*_columns(docs))
    values = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in docs.columns]
    docs = docs.withColumn("_row", F.md5(F.concat(*values)))
    groups = setjoin.cluster(docs, keep=("doc_id", "_row"), label="_label")
    rows = Tables(spark).keep(groups.filter("n_shingles > 0").groupBy("_label", "doc_id", "_row").agg(F.count(F.lit(1)).alias("alike")))
    best = rows.groupBy("_label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("best"))
    losers = rows.join(best, "_label").filter(F.col("_row") != F.col("best._row")).select("_row")
    kept = docs.join(losers, "_row", "left_anti")
    alike = rows.filter("alike > 1").select("_row")
    if alike.isEmpty():
        return kept.drop("_row")
    first = kept.join(alike, "_row", "left_semi").groupBy("_row").agg(*[F.first(c).alias(c) for c in docs.columns if c != "_row"])
    return kept.join(alike, "_row", "left_anti").unionByName(first).drop("_row")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*_columns(docs))
    clean = pii.extract(docs, redact=True).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*_columns(docs))
    mixed = mixing.mix(docs).drop("position")
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    try:  # only files have a place
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return packing.digest(packing.pack_documents(docs, packing.default_tokenizer()))
    number = F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long")
    placed = placed.withColumn("_number", number)
    return packing.digest(packing.pack_documents(placed, packing.default_tokenizer(), order=("_number", "_file", "_at")))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder, removed when the next one stands."""
    tables, before = Tables(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return docs
