"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars); other columns are dropped.

Defined results: ids may be null or repeated, rows are told apart by all their columns, and of rows that agree in all of them near-dedup keeps one. A null text
fails the quality rules. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, mixing, neardup, pii, quality
from tarn.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ("row_key", "row_key_2")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``KEY``, two 64-bit hashes of the whole row that are never null: ids may be null or repeated, and rows of one key are equal."""
    row = [*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)]
    return docs.select(*COLUMNS, *(F.xxhash64(F.lit(seed), *row).alias(name) for seed, name in enumerate(KEY)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Verdicts travel with the texts, which are neither shuffled nor written before."""
    return quality.judge(docs, keep=COLUMNS, twice=True).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id (any other before a null one), of each group of near-duplicates (five-word shingles, similarity 0.8 or more). The texts are shuffled once, to
    keep those that stay; only texts with company in a block are gathered for comparison."""
    rows = keyed(docs)
    first = neardup.firsts(rows, KEY, ("doc_id",))
    kept = rows.join(first, list(KEY), "left_semi")
    if not rows.select(*KEY).groupBy(*KEY).count().where("count > 1").isEmpty():  # rows that agree in every column
        kept = kept.dropDuplicates(list(KEY))
    return kept.select(*COLUMNS)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the new text."""
    masked = pii.find_spans(docs, keep=("doc_id", "lang", "source"))
    return masked.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as it is taken, up to three times, or not at all. Thresholds travel to the texts, which aren't shuffled."""
    taken = mixing.mix(docs, keep=("doc_id", "text", "lang", "n_chars"), twice=True).where("copies > 0")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of ids and decoded text."""
    return bpe.encode_documents(docs, vocabulary()).drop("decoded")


STAGES = [("quality rules", clean), ("SimHash near-dedup", deduplicate), ("PII", mask), ("mixing", balance), ("BPE", encode)]
#: XXH64 fingerprints, a conditional random field and byte-pair merges have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once in the shared checkpoint folder, so a lost executor or a retry
    repeats no stage before it. A stage's folder goes once the next one is written; the last one holds the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stage_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, f"{folder}/stage-{i - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tarn-pipeline-")
    return f"{base}/pipeline-{uuid.uuid4().hex}"
