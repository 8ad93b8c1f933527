"""Exact deduplication as a stateful stream.

The rows' digests stream through one keyed, disk-backed state (RocksDB) that never expires.  For
each digest it retains how many rows had it and, of the row that stays so far, the length and
identifier that rank it and the locator of its content (file and row number).  Later batches, or
later runs on the same folder, meet the state of all earlier ones.

A digest that is hit, by rows of one run or of an earlier one, has whole contents compared before it
goes to the state: those of the run's rows, and the earlier keepers', which are read by their
locators.  Different contents of one digest get state rows of their own, told apart by ``variant``.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from roamgrid.llm.rows import join_groups, located, semi_join
from roamgrid.plans.storage import delete_path, new_path, settings, written

#: Fixed value: characters that don't count when texts are compared.
BLANKS = " \t\n\x0b\f\r"
#: The state lives in RocksDB, one for each partition, which must not reserve disk ahead; all of an executor share some memory.
STATE_STORE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
    "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
    "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "128",
}
STATE = "digest binary, variant int, group_size bigint, keeper struct<n_points: int, not_id: bigint, not_row: bigint, at_file: string>, batch int"


def normalised(text: Column) -> Column:
    """A text without its blanks; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


class ExactDedup:
    """Deduplicates by content, with state kept under ``folder`` so that later runs go on from it.

    The files of earlier runs must still be there: their keepers' contents are read again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256, files_per_batch: int = 1000):
        self.spark, self.digest, self.files_per_batch = spark, digest, files_per_batch
        self.folder = folder or new_path(spark, "exact_dedup")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def digests(self, docs: DataFrame) -> DataFrame:
        """``digest``, ``doc_id``, ``n_points`` and the locator of each row."""
        return docs.select(
            self.digest(normalised(F.col("text"))).alias("digest"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_points"),
            "at_file",
            "at_row",
        )

    def absorb(self, schema: StructType) -> None:
        """Streams the digest rows of all runs that it hasn't met yet through the state and appends the changed keys."""
        spark = self.spark
        schema = StructType([*schema.fields, StructField("run", StringType())])
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.folder}/digests")
        # the largest of: length, smallest identifier, earliest locator
        rank = F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("at_row").alias("not_row"), "at_file")
        state = rows.groupBy("digest", "variant").agg(F.count("*").alias("group_size"), F.max(rank).alias("keeper"))

        def put(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        with settings(spark, **STATE_STORE):
            stream = (
                state.writeStream.outputMode("update")
                .foreachBatch(put)
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .start()
            )
        stream.awaitTermination()

    def groups(self) -> DataFrame:
        """The state of every digest and variant: what its last change left."""
        kept = self.spark.read.schema(STATE).parquet(f"{self.folder}/changes")
        last = kept.groupBy("digest", "variant").agg(F.max_by(F.struct("group_size", "keeper"), "batch").alias("s"))
        return last.select(
            "digest",
            "variant",
            "s.group_size",
            F.bitwise_not("s.keeper.not_id").alias("keep_id"),
            F.col("s.keeper.at_file").alias("keep_file"),
            F.bitwise_not("s.keeper.not_row").alias("keep_row"),
        )

    def run(self, docs: DataFrame) -> DataFrame:
        """One row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
        ``text_sha256``, and the locator ``at_file``, ``at_row``.

        Equal texts are those that are identical without blanks; of them the row with the most code
        points stays, then the smallest doc_id (a null one last), then the earliest row of a file.
        A null text counts as empty, texts of any length are compared whole.  Repeated rows form a
        group like any other and one stays.  Other columns are left out; an empty table gives an
        empty table.
        """
        return self.run_located(located(docs, self.folder))

    def run_located(self, rows: DataFrame) -> DataFrame:
        """``run`` on rows that have their locators."""
        spark = self.spark
        docs = rows.select("row.doc_id", "row.text", "at_file", "at_row")
        narrow = written(self.digests(docs), "digests")
        counted = narrow.groupBy("digest").agg(F.count("*").alias("n"))
        known = None
        if self._exists(f"{self.folder}/changes"):
            again = semi_join(self.groups(), narrow.select("digest").distinct(), ["digest"])
            known = self.earlier_contents(written(again.select("digest", "variant", "keep_file", "keep_row"), "known"))
        keyed = self.keyed(docs, narrow, counted, known)
        path = f"{self.folder}/digests/run={uuid.uuid4().hex}"
        keyed.write.parquet(path)
        self.absorb(keyed.schema)
        found = join_groups(spark.read.schema(keyed.schema).parquet(path), written(self.groups(), "groups"), ["digest", "variant"], "group_size")
        same_row = F.col("at_file").eqNullSafe(F.col("keep_file")) & F.col("at_row").eqNullSafe(F.col("keep_row"))
        if self.digest is sha256:
            found = found.withColumn("text_sha256", F.lower(F.hex("digest")))
        else:
            shas = docs.select("at_file", "at_row", F.lower(F.hex(sha256(normalised(F.col("text"))))).alias("text_sha256"))
            found = found.join(shas, ["at_file", "at_row"])
        return found.select("doc_id", "keep_id", "group_size", same_row.alias("kept"), "text_sha256", "at_file", "at_row")

    def earlier_contents(self, known: DataFrame) -> DataFrame:
        """``digest``, ``variant`` and ``content`` of earlier keepers, read by their locators."""
        files = [r[0] for r in known.select("keep_file").distinct().collect()]
        own = f"/{self.folder.rstrip('/').rpartition('/')[2]}/located-"
        copies = [f for f in files if own in f]
        parts = []
        for some, text, schema in ((copies, "row.text", "row struct<text: string>"), ([f for f in files if f not in set(copies)], "text", "text string")):
            if some:
                read = self.spark.read.schema(schema).parquet(*map(unquote, some))
                parts.append(read.select(F.col(text).alias("text"), F.col("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row")))
        if not parts:
            return known.select("digest", "variant", F.lit("").alias("content"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.join(known, ["keep_file", "keep_row"]).select("digest", "variant", normalised(F.col("text")).alias("content"))

    def keyed(self, docs: DataFrame, narrow: DataFrame, counted: DataFrame, known: DataFrame | None) -> DataFrame:
        """``narrow`` with the ``variant`` of each row: 0 unless its digest has several contents."""
        hit = counted.where("n > 1").select("digest")
        if known is not None:
            hit = hit.unionByName(known.select("digest")).distinct()
        clashing = written(self.clashes(docs, hit, known), "clashes")
        plain = narrow.withColumn("variant", F.lit(0))
        if clashing.isEmpty():
            return plain
        return plain.join(clashing, "digest", "left_anti").unionByName(self.by_content(docs, clashing, known))

    def clashes(self, docs: DataFrame, hit: DataFrame, known: DataFrame | None) -> DataFrame:
        """Digests of which two contents differ, or that have had several, by comparing all bytes of every hit.

        The smallest and the largest content of a digest are taken before the shuffle, so a large
        group sends two contents a task.
        """
        contents = docs.select(normalised(F.col("text")).alias("content")).withColumn("digest", self.digest(F.col("content")))
        contents = semi_join(contents, written(hit, "hits"), ["digest"]).select("digest", "content")
        if known is not None:
            contents = contents.unionByName(known.select("digest", "content"))
        ends = contents.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"))
        return ends.where("a <> b").select("digest")

    def by_content(self, docs: DataFrame, clashing: DataFrame, known: DataFrame | None) -> DataFrame:
        """The rows of clashing digests, their variant by their whole content: an earlier one or the next number."""
        rows = self.digests(docs).join(clashing, "digest", "left_semi")
        texts = docs.select(normalised(F.col("text")).alias("content"), "at_file", "at_row")
        rows = rows.join(texts, ["at_file", "at_row"])
        contents = rows.select("digest", "content").distinct()
        if known is None:
            known = contents.limit(0).withColumn("variant", F.lit(0))
        known = known.join(clashing, "digest", "left_semi")
        last = known.groupBy("digest").agg(F.max("variant").alias("last"))
        contents = contents.join(known, ["digest", "content"], "left").join(last, "digest", "left")
        next_one = F.row_number().over(Window.partitionBy("digest", F.col("variant").isNull()).orderBy("content"))
        contents = contents.withColumn("variant", F.coalesce(F.col("variant"), F.coalesce("last", F.lit(-1)) + next_one).cast("int"))
        return rows.join(contents.select("digest", "content", "variant"), ["digest", "content"]).drop("content")

    def forget(self) -> None:
        delete_path(self.spark, self.folder)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``ExactDedup.run`` on fresh state, without the locators; the state is deleted again.

    Null texts are empty, texts are compared whole however long, repeated rows form groups, and an
    empty table gives an empty table.
    """
    dedup = ExactDedup(docs.sparkSession)
    out = written(dedup.run(docs).drop("at_file", "at_row"), "exact_duplicates")
    dedup.forget()
    return out


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row of each group of equal texts stays, chosen as ``ExactDedup.run`` says; rows alike in
    every column are told apart by where they stand.  An empty table gives an empty table.
    """
    rows = located(docs)
    dedup = ExactDedup(docs.sparkSession)
    gone = written(dedup.run_located(rows).where("not kept").select("at_file", "at_row"), "exact_gone")
    dedup.forget()
    return semi_join(rows, gone, ["at_file", "at_row"], "left_anti").select("row.*")
