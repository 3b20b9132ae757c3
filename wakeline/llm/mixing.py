"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Equal ranges of that key are the buckets of a range sort within its source: keys
are uniform, so a source is dealt evenly over as many buckets as its size asks for, a source with a third of all rows
over proportionally more.  Sums per bucket, then per group of buckets, give distributed prefix sums of the token counts, and
each source is cut at its exact budget; a budget above the source's size starts further epochs over the same order.

Defined cases: a null source is a source of its own and sorts last; a null or blank text has size 0 and is never taken; an
empty table gives an empty mix; repeated rows are separate rows (ties in the key are ordered by doc_id and then by all that is
known of the row, so ties are between equal rows only); further columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm.scratch import Scratch

#: The word rule of sizes.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, *, source: str = "source", size: str = "source_size", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0
) -> DataFrame:
    """A row per source with its target, in the same unit as size.

    sources: one row per source (a small dimension: a mix lists its sources).  In order of name (code points, null last) they
    weigh weights, repeating.  ``share`` times the sum of all sizes is dealt out by weight, no source gets more than
    ``most_epochs`` times its size, and what is cut off goes to the others by weight until none is above.

    The level at which the dealing ends is found in closed form: a source is full if the level at which it fills up needs no more
    than the total, with sources in order of that level.
    """
    by_name = W.orderBy(F.col(source).isNull(), F.col(source))
    fills = W.orderBy("_level", F.col(source).isNull(), F.col(source))
    after = fills.rowsBetween(1, W.unboundedFollowing)
    upto = fills.rowsBetween(W.unboundedPreceding, 0)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, w = len(weights), F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.withColumn("_weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col(size) * F.lit(float(most_epochs))).withColumn("_level", F.col("_cap") / F.col("_weight"))
    ranked = (
        ranked.withColumn("_total", F.sum(F.col(size)).over(everything.orderBy(F.lit(0))) * F.lit(float(share)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_rest", F.coalesce(F.sum("_weight").over(after), F.lit(0.0)))
        .withColumn("_full", F.col("_before") + F.col("_level") * F.col("_rest") <= F.col("_total"))
    )
    whole = everything.orderBy(F.lit(0))
    ranked = ranked.withColumn("_spent", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)).withColumn(
        "_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(whole)
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - F.col("_spent")) * F.col("_weight") / F.col("_open"))
    return ranked.select(source, F.col(size).cast("long").alias(size), F.least(target, F.col("_cap")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 20,
    rows_per_bucket: int = 2_000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken): how often the mix takes each document.

    ``epochs`` whole copies and then ``part`` words of one more, which only the one document has at which its source's budget
    ends; taken = epochs * size + part.  The taken words of a source add up to its target, rounded down.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), 1)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    sized = Scratch(docs.sparkSession, "mix").save(sized, "sizes")  # texts are read once
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    # two levels of equal key ranges; both counts follow from the source's rows
    groups = F.least(F.lit(1024), F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_bucket))).cast("long")
    each = F.greatest(F.lit(1), F.ceil(F.col("_rows") / (rows_per_bucket * F.col("_groups")))).cast("long")
    plan = (
        targets(per_source.select("source", "source_size"), weights=weights, share=share, most_epochs=most_epochs)
        .join(per_source.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_groups", groups)
        .withColumn("_each", each)
    )
    unit = F.col("_key") / F.lit(float(1 << 63))
    cell = F.least(F.floor(unit * F.col("_groups") * F.col("_each")), F.col("_groups") * F.col("_each") - 1)
    keyed = (
        sized.withColumn("_key", key)
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_cell", cell)
        .withColumn("_group", F.floor(F.col("_cell") / F.col("_each")))
    )
    # sums of whole cells and groups; then each row's place is the sum of what stands before its group, cell and row
    cells = keyed.groupBy("source", "_group", "_cell").agg(F.sum("size").alias("_sum"))
    in_group = W.partitionBy("source", "_group").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    in_source = W.partitionBy("source").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_a", F.coalesce(F.sum("_sum").over(in_group), F.lit(0)))
    groups_ = cells.groupBy("source", "_group").agg(F.sum("_sum").alias("_sum"))
    groups_ = groups_.withColumn("_b", F.coalesce(F.sum("_sum").over(in_source), F.lit(0))).drop("_sum")
    offsets = (
        cells.join(groups_.withColumnRenamed("source", "_s").withColumnRenamed("_group", "_g"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g")))
        .select(F.col("source").alias("_os"), F.col("_cell").alias("_oc"), (F.col("_a") + F.col("_b")).alias("_offset"))
    )
    in_cell = W.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("_c", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_os")) & (F.col("_cell") == F.col("_oc")))
        .withColumn("_before", F.col("_offset") + F.col("_c"))
    )
    budget = F.floor(F.col("target"))
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("_full") * F.col("source_size")
    inside = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    whole = F.col("_full") + F.when((F.col("_in") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = F.when(F.col("_in") == F.col("size"), F.lit(0)).otherwise(F.col("_in"))
    return (
        placed.withColumn("_full", full)
        .withColumn("_rest", rest)
        .withColumn("_in", inside)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("epochs"),
            part.cast("long").alias("part"),
            (F.col("_full") * F.col("size") + F.col("_in")).cast("long").alias("taken"),
        )
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, each whole.

    The document at which a budget ends is taken once more if at least half of it lies within the budget.  Rows are matched one to
    one by doc_id, source and size, which is all that the mix knows of them; among rows equal in these, the first by row hash is taken most.
    """
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    same = lambda size: [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("source").isNull(), F.coalesce("source", F.lit("")), size]
    keys = lambda side, size: [c.alias(f"_{side}{k}") for k, c in enumerate(same(size))]
    rank = lambda side, *order: F.row_number().over(W.partitionBy(*[f"_{side}{k}" for k in range(5)]).orderBy(*order))
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_hash"), *keys("l", words_in(F.col("text"))))
    left = left.withColumn("_l5", rank("l", "_hash"))
    right = mixed.select(copies.alias("_n"), *keys("r", F.col("size"))).withColumn("_r5", rank("r", F.desc("_n"))).where("_n > 0")
    on = [F.col(f"_l{k}") == F.col(f"_r{k}") for k in range(6)]
    return left.join(right, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
