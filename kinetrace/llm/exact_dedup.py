"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of SHA-256 digests: for each distinct text a row of the batch
that brought it first, with the row that stays, and a row with the number of copies for
each later batch that brought it again.  A batch is reduced to (digest, row) pairs,
aggregated per digest before anything is joined, compared with the index by a
sort-merge anti-join that shuffles and sorts only the batch's digests, and what is new is appended.
The index is bucketed, so it is never shuffled; while a bucket is one file, as after the first
batch and after ``compact``, its order is used too and it is not sorted.  Each later batch
adds a file per bucket, with which Spark sorts the bucket when it reads it, until
``compact`` rewrites the index as one row per text and one file per bucket.

A batch has a name.  If it is added again, after a failure say, its own rows in the
index do not count as earlier ones, what it has appended is not appended twice,
and the verdicts are the same.  One writer at a time appends to an index.

DataFrame functions only.  Defined results: a null text counts as empty; rows
with equal texts form one group whatever their other columns hold; the row with
the largest id of the batch that brought a text first stays, a null id being smaller than any other;
of repeated rows with the same id and text exactly one is kept; texts of any
length are hashed whole; an empty batch gives no rows and leaves the index as it
is; ids may be of any type that has an order, such as text, and of any size; other
columns may have any name, also those used here.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, id_place, materialize, shared_folder, text_or_empty

#: Copies of one text are spread over so many tasks when verdicts are joined back.
SALTS = 64
#: Rows among whose ids the one is looked for that parts a table.
ID_SAMPLE = 1001
ORDERED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_no, digest) of each row: about 50 bytes instead of a text."""
    return df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), digest_of(text_col).alias("digest"))


@contextmanager
def trusted_order(spark: SparkSession):
    """Jobs inside use the order of buckets that are one file each; the session's setting is put back."""
    before = spark.conf.get(ORDERED_BUCKETS, None)
    spark.conf.set(ORDERED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.unset(ORDERED_BUCKETS) if before is None else spark.conf.set(ORDERED_BUCKETS, before)


def scratch_index(spark: SparkSession) -> DigestIndex:
    """An index of its own name in the shared folder, whatever the session's warehouse."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS digest_indexes LOCATION '{shared_folder(spark)}/digest-indexes'")
    return DigestIndex(spark, f"digest_indexes.index_{uuid.uuid4().hex}")


class DigestIndex:
    """A persistent table of digests, bucketed and sorted by digest.

    ``table`` is a catalog table, in a database whose folder all executors share;
    ``buckets`` is fixed when it is created and should be the index's size over some hundred MB.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        """Whether there is an index; one whose compaction was cut off is put in its place first."""
        if self.spark.catalog.tableExists(self.table):
            return True
        if self.spark.catalog.tableExists(self._former):
            self.spark.sql(f"ALTER TABLE {self._former} RENAME TO {self.table}")
            return True
        return False

    @property
    def _former(self) -> str:
        return f"{self.table}_before_compaction"

    def read(self) -> DataFrame:
        """(digest, keep_id, copies, first, batch)."""
        return self.spark.read.table(self.table)

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch has brought."""
        if not self.exists():
            return groups
        earlier = self.read().where(F.col("first") & (F.col("batch") != batch)).select("digest")
        return groups.join(earlier.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups (digest, keep_id, copies): those not seen as first, others as more copies."""
        if self.exists():
            done = self.read().where(F.col("batch") == batch).select("digest")
            with trusted_order(self.spark):
                groups = materialize(groups.join(done.hint("merge"), "digest", "left_anti"), "to-append")
                fresh = materialize(self.unseen(groups, batch), "fresh")
            known = groups.join(fresh.select("digest").hint("merge"), "digest", "left_anti")
            groups = fresh.withColumn("first", F.lit(True)).unionByName(known.withColumn("first", F.lit(False)))
        else:
            groups = groups.withColumn("first", F.lit(True))
        self._write(groups.withColumn("batch", F.lit(batch)), self.table)

    def _write(self, rows: DataFrame, table: str) -> None:
        """Each bucket gets one sorted file."""
        placed = rows.select("digest", "keep_id", "copies", "first", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        placed.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)

    def totals(self) -> DataFrame:
        """(digest, keep_id, copies, batch): one row per text, batch being the first that brought it."""
        first = F.max(F.when(F.col("first"), F.struct("batch", "keep_id")))
        return self.read().groupBy("digest").agg(first.alias("at"), F.sum("copies").alias("copies")).select("digest", "at.keep_id", "copies", "at.batch")

    def compact(self) -> None:
        """Rewrite the index: a row per text, a file per bucket.

        The former table goes only when the new one has its name; if the job ends in
        between, ``exists`` puts the former one back.
        """
        if not self.exists():
            return
        beside = f"{self.table}_{uuid.uuid4().hex}"
        self._write(self.totals().withColumn("first", F.lit(True)), beside)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._former}")
        self.spark.sql(f"ALTER TABLE {self.table} RENAME TO {self._former}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.table}")
        self.spark.sql(f"DROP TABLE {self._former}")

    def drop(self) -> None:
        for table in (self.table, self._former):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def ingest(self, df: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> Batch:
        """Deduplicate a batch against the index and itself, and append what is new."""
        rows = materialize(digest_rows(df, id_col, text_col).withColumn("salt", F.pmod("row_no", F.lit(SALTS)).cast("int")), "digests")
        # Copies of one text meet in at most SALTS partial groups, then in one row.
        of_group = [F.max(F.struct("doc_id", "row_no")).alias("keeper"), F.count(F.lit(1)).alias("copies")]
        salted = materialize(rows.groupBy("digest", "salt").agg(*of_group), "salted-groups")
        groups = materialize(salted.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.sum("copies").alias("copies")), "groups")
        self.append(groups.select("digest", F.col("keeper.doc_id").alias("keep_id"), "copies"), batch)
        return Batch(self, batch, rows, salted, groups)

    def add(self, df: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Ingest a batch and return the verdicts on its rows."""
        return self.ingest(df, batch or uuid.uuid4().hex, id_col, text_col).verdicts()


class Batch:
    """A batch that an index has taken in."""

    def __init__(self, index: DigestIndex, name: str, rows: DataFrame, salted: DataFrame, groups: DataFrame):
        self.index, self.name, self.rows, self.salted, self.groups = index, name, rows, salted, groups

    def verdicts(self) -> DataFrame:
        """doc_id, row_no, digest, keep_id, group_size, kept of the batch's rows, as the index is now.

        group_size counts the copies in all batches so far.  For a text that an
        earlier batch brought, keep_id is the row that stayed then and nothing
        of this batch is kept.
        """
        keepers = self.groups.select("digest", F.col("keeper.row_no").alias("keep_row")).hint("merge")
        known = self.index.totals().join(keepers, "digest").withColumn("own", F.col("batch") == self.name)
        routed = self.salted.select("digest", "salt").join(known.hint("merge"), "digest")
        kept = F.col("own") & (F.col("row_no") == F.col("keep_row"))
        return self.rows.join(routed, ["digest", "salt"]).select("doc_id", "row_no", "digest", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"))


def middle_id(df: DataFrame, id_col: str = "doc_id"):
    """An id with about as many above as below it, without arithmetic on ids: the middle one of a sample in order.

    The sample is ID_SAMPLE rows by hash, so the id is the same whenever it is asked for.
    """
    ids = df.select(F.col(id_col).alias("id")).where("id is not null")
    sample = ids.orderBy(F.xxhash64("id")).limit(ID_SAMPLE)
    return sample.agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.expr("size(ids) div 2")).alias("m")).first()["m"]


def halves(df: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """The rows with the larger ids, then those with the smaller ones and the null ones."""
    middle = middle_id(df, id_col)
    if middle is None:
        return [df]
    upper = F.coalesce(F.col(id_col) >= F.lit(middle).cast(df.schema[id_col].dataType), F.lit(False))
    return [df.where(upper), df.where(~upper)]


def deduplicate(df: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdicts on all rows of a table that comes in two batches; in the second, texts of the first are found by the anti-join.

    As the larger ids come first, the row with the largest id of all stays.
    """
    batch = batch or uuid.uuid4().hex
    batches = [index.ingest(part, f"{batch}-{k}", id_col, text_col) for k, part in enumerate(halves(df, id_col))]
    out = batches[0].verdicts()
    for later in batches[1:]:
        out = out.union(later.verdicts())
    return out


def keep_one_per_text(df: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    The index takes in (digest, row) pairs, in two batches; texts move once, by id
    and digest, so a text with very many copies is never gathered in one task.
    """
    digest, place = free_names(df, "digest", "place")
    batch = batch or uuid.uuid4().hex
    for k, part in enumerate(halves(df, id_col)):
        groups = part.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest")).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        index.append(materialize(groups, "groups"), f"{batch}-{k}")
    own = F.col("first") & F.col("batch").startswith(f"{batch}-")
    keepers = index.read().where(own).select(F.coalesce("digest", F.lit(b"")).alias(digest), id_place("keep_id").alias(place))
    # Neither key is ever null, so repeated rows are dropped where the join has put them.
    rows = df.withColumns({digest: F.coalesce(digest_of(text_col), F.lit(b"")), place: id_place(id_col)})
    return rows.join(keepers, [digest, place], "left_semi").dropDuplicates([digest, place]).select(*(f"`{c}`" for c in df.columns))
