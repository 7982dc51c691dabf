"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
A stage's result is written as Parquet and read again as the next one's docs. The
last returns where each document's token ids stand in the files, the others rows
with the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm import binary, decontamination, mixing, quality, simhash
from roadweave.session import cut, shared_dir, table


#: Rows that go to Python at a time: texts are long, so the session's 10,000 would hold tens of megabytes on both sides.
ROWS_AT_A_TIME = 500


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ROWS_AT_A_TIME if they are larger (or unbounded)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_A_TIME:
        spark.conf.set(key, str(ROWS_AT_A_TIME))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, rejects. Null texts count as empty; rows that
    repeat an id are scored each; further columns stay, whatever their names."""
    in_small_batches(spark)
    marked = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model, score = quality.fit(table(spark, sf_dir, "documents"), marked), unused(docs, "quality_score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays.

    Rows without an id stay all. Rows that repeat id and text are one document, of which one row stays. Rows of one
    id with different texts are documents of their own, in the order of their texts' hashes. Texts are compared
    whole; further columns stay.
    """
    in_small_batches(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = cut(simhash.near_copies(docs))
        gone = groups.where("doc_id != component").select("doc_id")
        return docs.join(simhash.few(gone), "doc_id", "left_anti").select(*docs.columns)
    columns, body, node, turn = docs.columns, unused(docs, "body"), unused(docs, "node"), unused(docs, "turn")
    rows = docs.withColumn(body, F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    each = rows.where("doc_id is not null").select("doc_id", body).distinct().repartitionByRange("doc_id", body).sortWithinPartitions("doc_id", body)
    each = cut(each.withColumn(node, F.monotonically_increasing_id()))
    named = rows.join(each, ["doc_id", body])
    groups = cut(simhash.near_copies(named.select(F.col(node).alias("doc_id"), "text")))
    kept = named.join(groups.where("doc_id = component").select(F.col("doc_id").alias(node)), node, "left_semi")
    one = kept.withColumn(turn, F.row_number().over(Window.partitionBy(node).orderBy(F.xxhash64(*columns)))).where(F.col(turn) == 1)
    return one.select(*columns).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: all rows of their ids. Rows without an id or text, and further
    columns, stay."""
    leaked = cut(decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(simhash.few(leaked), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the curriculum takes them: repeated, cut at a source's target, in training order. Documents
    without words aren't taken; further columns stay."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes all rows to token-id files, by id and text, and reads those: doc_id, start, n_tokens, ids_crc32."""
    in_small_batches(spark)
    return binary.round_trip(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A fitted classifier and a library's tokens can't be expressed in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
