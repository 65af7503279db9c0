"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

Each source has a weight, and the mix as many words as the corpus. A source's target is its
share by weight, but at most ``max_epochs`` times its own words; what is cut off is shared among
the others by weight, until none is above. In closed form: with sources sorted by cap / weight,
the first k are clamped, and the rest get the level (total - their caps) / (their weights) times
their weight, for the smallest k at which the next source isn't above its cap.

A target of e epochs takes every document floor(e) times, and then documents in a seeded order
(a digest of seed, doc_id and text) until the fraction of an epoch that is left is filled; the
document at that border is taken in part, so a source's total is its target to the word. The
running total in seeded order is made in two steps, by slot of the digest and inside the slot,
so a source that holds a third of all rows is spread over ``SLOTS`` groups.

A null text has no words; a null source is a source of its own, the last in order. A null doc_id
is an id like any other. Rows with the same doc_id count one by one; those with the same text too
are alike, so it doesn't matter which of them is taken. A corpus without words takes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EPOCHS = 3
SEED = "mix-1"
SLOTS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(seed: str, doc_id: Column, text: Column) -> Column:
    """The place of a document in the seeded order; the text is in it, so that rows of one id, or of none, are spread."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("string")), F.lit(""))))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds ``weight``: 1, 2, .. cycle, repeating over the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", (1 + (F.row_number().over(order) - 1) % cycle).cast("double"))


def targets(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight); one row a source, so one small window."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return levels.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds size, source_size, target and taken to documents (doc_id, text, source, ...).

    ``weights`` has (source, weight) for every source; without it they are ``cyclic_weights``.
    Columns of the documents with these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    sized = docs.select(*own, word_count(F.col("text").cast("string")).alias("size")).withColumn("_digest", digest(seed, F.col("doc_id"), F.col("text")))
    sized = sized.withColumn("_slot", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    slots = sized.groupBy("source", "_slot").agg(F.sum("size").alias("_slot_size"))
    by_source = slots.groupBy("source").agg(F.sum("_slot_size").alias("source_size"))
    weighed = cyclic_weights(by_source) if weights is None else by_source.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    aim = targets(weighed, max_epochs).select(F.col("source").alias("_aim"), "source_size", "target")
    earlier = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.withColumn("_offset", F.coalesce(F.sum("_slot_size").over(earlier), F.lit(0))).join(aim, F.col("source").eqNullSafe(F.col("_aim")))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("_slot").alias("_at"), "_offset", "source_size", "target")
    inside = Window.partitionBy("source", "_slot").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_at")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least("size", left - F.col("_offset") - F.col("_before")))
    return placed.withColumn("taken", (whole * F.col("size") + extra).cast("long")).select(*own, "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """Text up to the end of its n-th word, with the spaces as they are."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each repetition (1, 2, ..) of a document, with the text that is taken in it.

    Whole repetitions have the text as it is, and the document at a border its first words. Documents
    of which the mix takes nothing have no row. The other columns are those of ``mix``; taken counts
    the document's words in all its repetitions.
    """
    own = [c for c in docs.columns if c != "repetition"]
    taken = mix(docs.select(*own), weights, max_epochs, seed).where("taken > 0")
    rows = taken.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("repetition") - 1) * F.col("size")
    return rows.withColumn("text", F.when(left >= F.col("size"), F.col("text")).otherwise(first_words(F.col("text").cast("string"), left)))
