"""A corpus from documents to packed sequences: five stages, each written as Parquet and read again by the next.

toxicity     documents that score 0.5 or more go (the model is fitted on the stage's own labelled documents)
near_dedup   one document of each near-duplicate group stays: the one with the least id
decontam     documents of which a twentieth or more is benchmark text go
secrets      live credentials are replaced in the text (and n_chars counted again); every document stays
packing      documents are cut and packed into bins of 2,048 words under source and copy conflicts

All but the last return the columns of the documents they are given, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.llm import decontam, dedup, packing, secrets, toxicity
from footreach.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    name = "_" + max(docs.columns, key=len)  # longer than any column's name, so none of them
    return toxicity.scores(docs, toxicity.fit(docs, labels), docs.columns, name=name).filter(F.col(f"`{name}`") < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts stays: the one with the least id.

    Rows are told apart by (id, text) where an id is repeated or null: each such text is a document of its own, after those
    with an id of their own, so different texts under one id all stay. Of equal rows of one id the least (by hash of all
    columns) stays.
    """
    name = "_" + max(docs.columns, key=len)  # longer than any column's name, so none of them
    key, again, first = f"{name}_key", f"{name}_again", f"{name}_first"
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(again)).filter(F.col("doc_id").isNull() | (F.col(again) > 1)).withColumnRenamed("doc_id", name)
    ids = cut_lineage(ids)  # its size is known from here on: where no id is repeated the texts need no shuffle for it
    marked = docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)) & F.lit(True), "left")
    late = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) + F.lit(1 << 62)
    keyed = marked.withColumn(key, F.when(F.col(again).isNull(), F.col("doc_id").cast("bigint")).otherwise(late))
    near = dedup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    stay = keyed.join(near.filter("kept").select(F.col("doc_id").alias(key)).distinct(), key, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = stay.filter(F.col(again).isNotNull()).groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(first)).select(f"{first}.*")
    return stay.filter(F.col(again).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter(decontam.contaminated(F.size("hits"), F.col("n_words"))).select("doc_id", "text_hash").distinct()
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit(""))) == F.col("bad.text_hash"))
    return docs.alias("d").join(bad.alias("bad"), same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontam", drop_contaminated), ("secrets", redact), ("packing", pack)]
#: No SQL: the stages' models, signatures and packing can't be said in it; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
