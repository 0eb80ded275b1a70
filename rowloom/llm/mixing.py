"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in built-in functions only.

Every document gets an exponential key from its hash, scaled by its quality
weight; a source's budget goes first to complete epochs of all its documents
and then to the documents with the smallest keys. The prefix sums are two
levels deep: sizes are summed per slice of the key range, and only the one
slice in which a budget ends is sorted document by document.

Cases: null text has size 0 and is taken 0 times for words; a null source is
a source of its own, last in order; rows of equal id and text share a key and
are taken together; an empty table gives no rows. Extra columns are kept by
``draw`` and ignored by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.textnum import WORD
from rowloom.session import materialize

#: Documents per slice of the key range, on average.
SLICE_ROWS = 5000
_P = "__mix_"


def size_of(text: Column) -> Column:
    """Words in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Weight of a document: half if its words are unusually short or long, else one."""
    mean = F.try_divide(F.char_length(text), size)
    return F.when(mean.between(3, 12), 1.0).otherwise(0.5)


def _with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text, size = F.col(text_col), F.col(_P + "size")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text), 11) + 0.5) / float(1 << 53)
    docs = docs.withColumn(_P + "size", size_of(text))
    return docs.withColumns(
        {
            # Rank of u ** (1 / weight) from the top, in (0, 1); ascending as the exponential key -ln(u) / weight.
            _P + "key": 1.0 - F.pow(unit, 1.0 / F.coalesce(quality_of(text, size), F.lit(0.5))),
            _P + "none": F.col(source_col).isNull(),
            _P + "source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        }
    )


_BY = [_P + "none", _P + "source"]


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: its target, the whole epochs in it and the words left over.

    Targets are weight times a common level, but no more than ``most`` times
    the source; the level is where they add up to ``share`` of all sizes.
    Sources reach their limit in the order of limit over weight, so running
    sums in that order give the level.
    """
    order = Window.orderBy(*_BY)
    ranked = sizes.withColumn("number", F.row_number().over(order))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * float(most)).withColumn("full_at", F.col("limit") / F.col("weight"))
    by_level, everything = Window.orderBy("full_at", "number"), Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * float(share)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    open_level = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    ranked = ranked.withColumn("open_level", open_level)
    first = F.first("open_level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(first * F.col("weight"), F.col("limit")))
    out = ranked.withColumn("target", target)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("left_over", F.col("target") - F.col("epochs") * F.col("source_size"))
    return out.select(*_BY, "source_size", "target", "epochs", "left_over")


def _cutoffs(keys: DataFrame, plan: DataFrame, rows: int) -> DataFrame:
    """The plan with the largest key that each source still takes (-1: none)."""
    slices = max(1, -(-rows // SLICE_ROWS))
    cut = F.floor(F.col(_P + "key") * slices)
    sums = keys.groupBy(*_BY, cut.alias("slice")).agg(F.sum(_P + "size").alias("words"))
    running = Window.partitionBy(*_BY).orderBy("slice")
    sums = sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
    ends = sums.join(plan, _BY).where("left_over > before AND left_over <= upto").select(*_BY, "slice", "before", "left_over")
    inside = keys.withColumn("slice", cut).join(ends, [*_BY, "slice"])
    by_key = Window.partitionBy(*_BY).orderBy(_P + "key")
    upto = F.col("before") + F.sum(_P + "size").over(by_key)
    # The document in which the budget ends counts if at least half of it fits.
    near = inside.withColumn("upto", upto).where(F.col("upto") - F.col(_P + "size") / 2 <= F.col("left_over"))
    last = near.groupBy(*_BY).agg(F.max(_P + "key").alias("last"))
    starts = ends.select(*_BY, (F.col("slice") / slices).alias("start"))
    found = starts.join(last, _BY, "left").select(*_BY, F.coalesce("last", F.col("start") - 1e-18).alias("cutoff"))
    return plan.join(found, _BY, "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-1.0)))


def _planned(docs, id_col, text_col, source_col, weights, share, most, seed):
    rows = _with_keys(docs, id_col, text_col, source_col, seed)
    keys = materialize(rows.select(F.col(id_col).alias(_P + "id"), *_BY, _P + "size", _P + "key"))
    sizes = keys.groupBy(*_BY).agg(F.sum(_P + "size").alias("source_size"), F.count("*").alias("n"))
    plan = materialize(targets(sizes, weights, share, most))
    cutoffs = materialize(_cutoffs(keys, plan, keys.count()).select(*_BY, "source_size", "target", "epochs", "cutoff"))
    return rows, keys, cutoffs


def _copies() -> Column:
    return F.col("epochs") + F.when(F.col(_P + "key") <= F.col("cutoff"), 1).otherwise(0)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42,
) -> DataFrame:
    """How often each document is taken: (id_col, size, source_size, target, copies, taken)."""
    _, keys, plan = _planned(docs, id_col, text_col, source_col, weights, share, most, seed)
    out = keys.join(plan, _BY).withColumn("copies", _copies())
    size = F.col(_P + "size")
    return out.select(
        F.col(_P + "id").alias(id_col), size.alias("size"), "source_size", "target", "copies", (F.col("copies") * size).alias("taken")
    )


def draw(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42,
) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of ``docs``."""
    rows, _, plan = _planned(docs, id_col, text_col, source_col, weights, share, most, seed)
    plan = plan.select(*_BY, F.col("epochs").alias(_P + "epochs"), F.col("cutoff").alias(_P + "cutoff"))
    copies = F.col(_P + "epochs") + F.when(F.col(_P + "key") <= F.col(_P + "cutoff"), 1).otherwise(0)
    taken = rows.join(plan, _BY).withColumn(_P + "copies", copies).where(F.col(_P + "copies") > 0)
    return taken.withColumn(_P + "copy", F.explode(F.sequence(F.lit(1), F.col(_P + "copies").cast("int")))).select(*docs.columns)
