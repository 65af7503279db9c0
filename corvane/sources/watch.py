"""A watched folder: what was created, changed or removed since it was last looked at.

A look lists the folder with Spark's reader of files, without their contents, and joins the list with the
one before. The list and the changes are written under the look's number before the next look, so
a look that is repeated after a failure gives the same changes, and a stream can read them as they
come. A file that was moved is removed in one place and created in the other. Ignored paths are neither; a
file is told apart by its time of change and size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.files import SKIPPED_DIRS

LISTED = "path string, length long, modified timestamp"
CHANGED = "path string, change string, length long, modified timestamp, look long"


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell pattern: ``*`` any text, ``?`` a character, ``[..]`` one of several."""
    out = ""
    for part in re.split(r"(\*|\?|\[!?\]?[^\]]*\])", glob):
        out += ".*" if part == "*" else "." if part == "?" else part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") and len(part) > 1 else re.escape(part)
    return f"^{out}$"


def listing(spark: SparkSession, folder: str, ignored: list[str] = ()) -> DataFrame:
    """(path, length, modified) of the files below a folder, paths relative to it; junk folders and paths that match an ignored pattern left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))
    inside = files.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(root) + "/", ""))
    keep = ~F.concat(F.lit("/"), F.col("path")).rlike("/(" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")
    for pattern in ignored:
        keep = keep & ~F.col("path").rlike("(?s)" + glob_pattern(pattern))
    return inside.where(keep)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change, length, modified) between two listings: created, changed, or removed."""
    old = before.select(F.col("path").alias("_p"), F.col("length").alias("_l"), F.col("modified").alias("_m"))
    both = now.join(old, F.col("path") == F.col("_p"), "full_outer")
    change = F.when(F.col("_p").isNull(), "created").when(F.col("path").isNull(), "removed").when((F.col("length") != F.col("_l")) | (F.col("modified") != F.col("_m")), "changed")
    return both.select(F.coalesce("path", "_p").alias("path"), change.alias("change"), F.coalesce("length", "_l").alias("length"), F.coalesce("modified", "_m").alias("modified")).where("change is not null")


class FolderWatch:
    """Looks at a folder again and again; lists and changes lie below ``state``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, state: str, ignored: list[str] = ()):
        self._spark, self._folder, self._state, self._ignored = spark, folder, state.rstrip("/"), list(ignored)

    def _looks(self, below: str) -> list[int]:
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place = path(f"{self._state}/{below}")
        system = place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in system.listStatus(place) if system.exists(path(f.getPath(), "_SUCCESS")))

    def _listed(self, look: int) -> DataFrame:
        return self._spark.read.schema(LISTED).parquet(f"{self._state}/lists/look={look}") if look >= 0 else self._spark.createDataFrame([], LISTED)

    def look(self) -> DataFrame:
        """The changes since the last look that was finished."""
        done = self._looks("changes")
        number = done[-1] + 1 if done else 0
        if number not in self._looks("lists"):  # a list that was written before a failure stays, so the changes are the same
            listing(self._spark, self._folder, self._ignored).write.mode("overwrite").parquet(f"{self._state}/lists/look={number}")
        found = changes(self._listed(number - 1), self._listed(number))
        found.withColumn("look", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self._state}/changes/look={number}")
        return self._spark.read.schema(CHANGED).parquet(f"{self._state}/changes/look={number}")

    def stream(self) -> DataFrame:
        """All changes as a stream, a look's file or more a micro-batch."""
        return self._spark.readStream.schema(CHANGED).option("recursiveFileLookup", "true").parquet(f"{self._state}/changes")


def last_event(changed: DataFrame) -> DataFrame:
    """Of several looks' changes the last of each path; one that was created and removed in between is no change."""
    last = changed.groupBy("path").agg(F.max_by(F.struct("change", "length", "modified", "look"), "look").alias("last"), F.min_by("change", "look").alias("first"))
    kind = F.when((F.col("first") == "created") & (F.col("last.change") != "removed"), "created").otherwise(F.col("last.change"))
    return last.where(~((F.col("first") == "created") & (F.col("last.change") == "removed"))).select("path", kind.alias("change"), "last.length", "last.modified", "last.look")
