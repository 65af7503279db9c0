"""Tables that a stream merges into: rows by key in buckets, and a ledger of what was merged.

A batch of rows goes to the buckets of its keys, and only these are read, merged by a rule and written anew under the batch's number; the
ledger then names the batch in which each bucket was last written. The ledger's file is the commit: a batch
that is run again after it changes nothing, and one that failed before it is written over. Readers see
the buckets that the ledger names, so never half of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: A bucket is written in so many files, so that a hot one is no single task's.
FILES = 4

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Rows of a schema by the hash of their key columns, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self._spark, self._path, self._keys, self._buckets = spark, path.rstrip("/"), keys, buckets
        self._schema = spark.createDataFrame([], schema).schema

    def _folders(self, below: str) -> list[int]:
        """Batch numbers of the finished tables below a folder."""
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{below}")
        system = place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        done = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getPath().getName().split("-")[1]) for f in system.listStatus(place) if system.exists(done(f.getPath(), "_SUCCESS")))

    def _remove(self, folder: str) -> None:
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{folder}")
        place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def merged(self) -> tuple[int, dict[int, int]]:
        """The last batch in the ledger, -1 before any, and the batch in which each bucket was written."""
        batches = self._folders("ledger")
        if not batches:
            return -1, {}
        rows = self._spark.read.schema("bucket int, batch long").parquet(f"{self._path}/ledger/batch-{batches[-1]}").collect()  # a row a bucket
        return batches[-1], {r.bucket: r.batch for r in rows}

    def _rows(self, where: dict[int, int]) -> DataFrame:
        """The rows of buckets as of the batches in which they were written."""
        paths = [f"{self._path}/data/batch-{batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
        return self._spark.read.schema(self._schema).parquet(*paths) if paths else self._spark.createDataFrame([], self._schema)

    def read(self) -> DataFrame:
        return self._rows(self.merged()[1])

    def merge(self, rows: DataFrame, batch: int, rule: Rule) -> bool:
        """Merges a batch by a rule (old rows, new rows) -> rows of the same keys; False if the ledger has it already."""
        last, where = self.merged()
        if batch <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets)).cast("int")
        new = rows.select(*self._schema.names)
        touched = [r.b for r in new.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
        old = self._rows({b: where[b] for b in touched if b in where})
        out = f"{self._path}/data/batch-{batch}"
        placed = rule(old, new).select(*self._schema.names).withColumn("bucket", bucket)
        spread = F.pmod(F.xxhash64(*self._schema.names), F.lit(FILES))
        placed.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(out)
        filled = {r.bucket for r in self._spark.read.schema("bucket int").parquet(out).distinct().collect()}
        now = {b: n for b, n in where.items() if b not in touched} | {b: batch for b in touched if b in filled}
        self._spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self._path}/ledger/batch-{batch}")
        return True

    def vacuum(self) -> list[int]:
        """Removes ledgers but the last, and the tables of batches that it doesn't name; returns their numbers."""
        last, where = self.merged()
        for batch in self._folders("ledger"):
            if batch != last:
                self._remove(f"ledger/batch-{batch}")
        gone = [b for b in self._folders("data") if b <= last and b not in where.values()]
        for batch in gone:
            self._remove(f"data/batch-{batch}")
        return gone


def run(stream: DataFrame, table: KeyedTable, rule: Rule, state: str) -> DataFrame:
    """Merges all that is there of a stream, micro-batch by micro-batch, and returns the table."""
    write = lambda rows, batch: table.merge(rows, batch, rule) and None
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def latest(keys: list[str], version: str) -> Rule:
    """The rule that a key's rows are those of its highest version, in whatever order versions come; rows of one version add up, each once.

    Null versions are the lowest. A key whose latest rows say that it is empty keeps these, so that an older version that comes later doesn't bring it back.
    """

    def rule(old: DataFrame, new: DataFrame) -> DataFrame:
        every = old.unionByName(new).distinct()
        top = every.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(version).alias("_version"))
        same = F.col(version).eqNullSafe(F.col("_version"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return every.join(top, same, "left_semi")

    return rule


def ingested(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rule of a second look at a folder: rows are (locator, fingerprint, modified, first_seen, times, removed).

    A file with the fingerprint that is known stays as it is; another one takes its place and counts one more time; one that is
    gone is marked, and comes back as itself. Of several looks in a batch the last counts.
    """
    newest = new.groupBy(F.col("locator").alias("l")).agg(F.max_by(F.struct("fingerprint", "modified", "removed"), F.struct("modified", "removed", "fingerprint")).alias("n"))
    both = old.join(newest, F.col("locator") == F.col("l"), "full_outer")
    known, gone = F.col("locator").isNotNull(), F.coalesce(F.col("n.removed"), F.lit(False))
    same = known & (F.col("n").isNull() | gone | F.col("n.fingerprint").eqNullSafe(F.col("fingerprint")))
    return both.select(
        F.coalesce("locator", "l").alias("locator"), F.when(same, F.col("fingerprint")).otherwise(F.col("n.fingerprint")).alias("fingerprint"),
        F.when(same, F.col("modified")).otherwise(F.col("n.modified")).alias("modified"), F.coalesce("first_seen", "n.modified").alias("first_seen"),
        F.when(same, F.col("times")).otherwise(F.coalesce("times", F.lit(0)) + 1).cast("long").alias("times"), F.when(F.col("n").isNull(), F.col("removed")).otherwise(gone).alias("removed"),
    )
