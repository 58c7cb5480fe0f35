"""Exact deduplication as a stream: keyed state on disk knows every text seen, and texts that hit it are compared byte for byte.

Two Structured Streaming queries run over what is new in a folder of Parquet files, and remember in their checkpoints how far they came:

1. *arrivals* reads each new text once and logs its digest (SHA-256 of the text without white space), length, identifier and locator (file and row);
2. *registry* keeps, in RocksDB and without expiry, one state for each digest: the number of rows, the locator of the first row and the row that stays. Its
   rows are added up before the shuffle, so a digest of a third of all rows is one row of each task.

A row whose digest the state already holds is a *hit*. The texts of hits and of the first rows are fetched by their locators and compared in full; rows that differ from
the first are classes of their own, so a collision of digests changes no result. Texts without a copy are neither shuffled nor read a second time beyond a scan: a bitmap of
fixed size, ``2 ** BUCKET_BITS`` words of 64 bits, tells which rows may be wanted before they are joined exactly.

Of equal texts the row with the most characters stays, then the one with the smallest id (null last), then the first by locator.

Defined results: a null text counts as empty, and empty texts and those of white space alone are equal to each other; every row is returned once, rows that
repeat are told apart by their locators; an empty table gives an empty result; other columns are ignored. Files must not change after they were read, and a file that is added
later is found by the next call with the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.batches import shared_folder

#: Characters that don't tell texts apart (a fixed value).
SPACE = r"[\x20\x09-\x0D]"
BUCKET_BITS = 17
LOCATOR = ("file", "row")
#: RocksDB keeps the state on disk; its memory is bounded for an executor, whatever the number of its state partitions, and no disk is set aside before it is used.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


class Deduplicator:
    """State and logs of one stream of documents, in ``folder`` (below ``spark.checkpoint.dir`` unless named).

    :meth:`ingest` takes in what is new at ``path``, a Parquet file or a folder of them; :meth:`result` tells of all rows so far which are kept. A new object with the same
    folder goes on where the last one ended, also after a crash: both queries commit each batch once.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        folder: str | None = None,
        id: str = "doc_id",
        text: str = "text",
        key: Callable[[Column], Column] = digest,
        files_per_batch: int | None = None,
    ):
        self.spark, self.path, self.text, self.key, self.files = spark, path.rstrip("/"), text, key, files_per_batch
        self.folder = folder or shared_folder(spark, "exact")
        self.source = spark.read.parquet(path).schema
        self.id, self.kind = id, self.source[id].dataType.simpleString()
        self.rows = f"id {self.kind}, chars bigint, sha binary, key binary, file string, row bigint"

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    # ---- the stream ----

    def ingest(self) -> None:
        """Run both queries over everything that is new, then stop."""
        self.run(self.arrivals().writeStream.format("parquet").option("path", f"{self.folder}/arrivals"), "arrivals")
        registry = f"{self.folder}/registry"

        def save(updates: DataFrame, batch: int) -> None:
            updates.write.mode("overwrite").parquet(f"{registry}/batch={batch}")

        self.run(self.registry().writeStream.outputMode("update").foreachBatch(save), "registry", STATE)

    def run(self, writer, name: str, settings: dict[str, str] | None = None) -> None:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in settings or {}}
        try:
            for k, v in (settings or {}).items():
                conf.set(k, v)
            query = writer.queryName(f"{name}-{self.folder.rpartition('-')[2]}").option("checkpointLocation", f"{self.folder}/checkpoint-{name}").trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        query.awaitTermination()

    def stream(self, schema, path: str) -> DataFrame:
        reader = self.spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", self.files) if self.files else reader).parquet(path)

    def arrivals(self) -> DataFrame:
        content = normalised(F.col(self.text))
        # the last letter as a class of one: a pattern may name a file as well as a folder
        found = self.stream(self.source, f"{self.path[:-1]}[{self.path[-1]}]")
        sha = digest(content)
        chars = F.char_length(F.coalesce(F.col(self.text), F.lit(""))).cast("long")
        place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return found.select(F.col(self.id).alias("id"), chars.alias("chars"), sha.alias("sha"), self.key(content).alias("key"), *place)

    def registry(self) -> DataFrame:
        return self.summary(self.stream(self.rows, f"{self.folder}/arrivals"), "key")

    @staticmethod
    def summary(rows: DataFrame, *by: str) -> DataFrame:
        """Number of rows, locator of the first, and identifier with locator of the row that stays."""
        order = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), *LOCATOR)
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*LOCATOR)).alias("first"), F.min_by(F.struct("id", *LOCATOR), order).alias("stays"))

    # ---- what the state knows ----

    def known(self) -> DataFrame:
        """The last state of each digest."""
        located = "struct<file: string, row: bigint>"
        states = self.table("registry", f"key binary, n bigint, first {located}, stays struct<id: {self.kind}, file: string, row: bigint>, batch bigint")
        last = states.groupBy("key").agg(F.max_by(F.struct("n", "first", "stays"), "batch").alias("state"))
        path = f"{shared_folder(self.spark, 'known')}/rows"  # a table, so that Spark can split the rows of a hot digest in the joins
        last.select("key", "state.*").write.parquet(path)
        return self.spark.read.schema(f"key binary, n bigint, first {located}, stays struct<id: {self.kind}, file: string, row: bigint>").parquet(path)

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` rows with the whole normalised text that their locators name. Texts that surely aren't wanted are left out before the shuffle."""
        place = F.xxhash64(*LOCATOR)
        bucket, bit = F.shiftrightunsigned(place, 64 - BUCKET_BITS), place.bitwiseAND(63).cast("int")
        words = wanted.groupBy(bucket.alias("bucket")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(file, row) & 63 as int))")).alias("word"))
        texts = self.spark.read.schema(self.source).parquet(self.path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(self.text).alias("text")
        )
        maybe = texts.withColumn("bucket", bucket).withColumn("bit", bit).join(F.broadcast(words), "bucket").where("getbit(word, bit) = 1")
        return maybe.select(*LOCATOR, normalised(F.col("text")).alias("content")).join(wanted, list(LOCATOR))

    def different(self, known: DataFrame) -> DataFrame:
        """Hits whose text isn't that of the first row with their digest: key, locator and ``own``, the first locator of their own text."""
        repeated = known.where("n > 1").select("key", F.col("first.file").alias("first_file"), F.col("first.row").alias("first_row"))
        hits = self.table("arrivals", self.rows).select("key", *LOCATOR).join(repeated, "key")
        hits = hits.select("key", *LOCATOR, ((F.col("file") == F.col("first_file")) & (F.col("row") == F.col("first_row"))).alias("is_first"))
        texts = self.fetch(hits)
        firsts = texts.where("is_first").select("key", F.col("content").alias("first_content"))
        others = texts.where("NOT is_first").select("key", "content", *LOCATOR)
        apart = others.join(firsts, "key").where("content <> first_content").select("key", "content", *LOCATOR)
        path = f"{shared_folder(self.spark, 'apart')}/rows"
        apart.write.parquet(path)
        apart = self.spark.read.schema("key binary, content string, file string, row bigint").parquet(path)
        own = apart.groupBy("key", "content").agg(F.min(F.struct(*LOCATOR)).alias("own"))
        return apart.join(own, ["key", "content"]).select("key", *LOCATOR, "own")

    def result(self) -> DataFrame:
        """One row for each row so far: id, keep_id, group_size, kept and text_sha256."""
        rows, known = self.table("arrivals", self.rows), self.known()
        different = self.different(known)
        if different.isEmpty():
            found = rows.join(known.select("key", "n", "stays"), "key")
        else:
            broken = different.select("key").distinct()
            sound = rows.join(broken, "key", "left_anti").join(known.select("key", "n", "stays"), "key")
            split = rows.join(broken, "key", "left_semi").join(different, ["key", *LOCATOR], "left")
            classes = self.summary(split, "key", "own").select(F.col("key").alias("class_key"), F.col("own").alias("class_own"), "n", "stays")
            split = split.join(classes, (F.col("key") == F.col("class_key")) & F.col("own").eqNullSafe(F.col("class_own")))
            found = sound.select("id", "sha", *LOCATOR, "n", "stays").unionByName(split.select("id", "sha", *LOCATOR, "n", "stays"))
        kept = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
        return found.select(F.col("id").alias(self.id), F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(spark: SparkSession, path: str, **options) -> DataFrame:
    """All documents at ``path`` in one go; see :class:`Deduplicator`."""
    stream = Deduplicator(spark, path, **options)
    stream.ingest()
    return stream.result()
