"""Mixing sources to target weights along a time-varying curriculum (operator 4, native).

Each source has a weight schedule w(t) over training time 0..1, piecewise linear between knots.
Its integral is the source's weight in the whole mix.  Target words come from the weights by
water-filling under a repeat limit.  A document's words stand at an offset in its source's own
pseudo-random order; dividing the offset by the target gives a share of the source's cumulative
demand, and inverting the integral of w gives the training position at which it is due.  Documents
are then range-sorted by position.

Only DataFrame functions are used.  Offsets need no window over a whole source: the order key is cut
into ranges, the ranges' sums are prefix-summed in a table of one row for each source and range, and
a window runs only inside a range.  The number of ranges follows the number of rows, so a source with
a third of all rows is spread over many tasks.  Where many rows share one doc_id, or have none, their
one key is cut again by a number of the row.

Defined results: null text has size 0; the null source is a source, sorted last; documents of size 0
are never taken (position null); rows that agree in id, source and text are interchangeable; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.scratch import small, written

#: Knots (time, weight); the integrals are 5, 2 and 1.  Sources take them in turn.
SCHEDULES = (((0.0, 6.0), (0.5, 5.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"
KEYS = 1 << 31
ROWS_PER_RANGE = 2_000
#: Rows of keys that may be broadcast.
SMALL = 200_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def inverse(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time by which ``share`` (0 to 1) of the schedule's integral is used up."""
    need, done, out = share * F.lit(integral(knots)), 0.0, None
    for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
        rest = F.greatest(need - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * (v - w) / (u - t)) * rest, F.lit(0.0)))
        at = F.when(rest <= 0, F.lit(t)).otherwise(F.least(F.lit(u), F.lit(t) + 2 * rest / (F.lit(w) + root)))
        done += (u - t) * (w + v) / 2
        out = F.when(need < F.lit(done), at) if out is None else out.when(need < F.lit(done), at)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to the same with kind (index of the schedule) and target.

    Targets share ``share`` of all words by weight; none passes ``most`` times its source's size, and
    what that leaves over is shared by weight among the others.  Sorted by the ratio of limit to weight,
    the limited sources come first, so one pass of running sums finds the level of the rest.
    """
    weights = [integral(k) for k in schedules]
    every = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("kind", ((F.row_number().over(every) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1))
    ranked = ranked.withColumn("limit", F.lit(most) * F.col("source_size"))
    by = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by))
    free = F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    ranked = ranked.withColumn("rest", F.min(free).over(all_)["level"])
    limited = F.col("rest").isNull() | (F.col("limit") <= F.col("rest") * F.col("weight"))
    return ranked.select("source", "source_size", "kind", F.when(limited, F.col("limit")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def order_key(doc_id: Column) -> Column:
    """Pseudo-random place of a document in its source, the same in every run."""
    return F.coalesce((F.abs(doc_id % F.lit(KEYS - 1)) * F.lit(1103515245) + F.lit(12345)) % F.lit(KEYS), F.lit(0)).cast("long")


def text_mark(text: Column) -> Column:
    """128 bits that tell texts apart; null is not the empty text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, text.isNull()).alias("b"))


def plan_mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, rows_per_range: int = ROWS_PER_RANGE, label: Column | None = None) -> DataFrame:
    """(doc_id, source, text) to one row for each row: doc_id, size, source_size, target, taken, position, passes.

    ``taken``: words taken, repeats counted; ``passes``: array of (position, words), one for each time
    the document is used, in which the last may be a part of it.  ``label``: a value of each row to carry as ``tag``.
    """
    tag = [] if label is None else ["tag"]
    more = [] if label is None else [label.alias("tag")]
    narrow = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id")).alias("key"), F.monotonically_increasing_id().alias("row"), *more)
    narrow = written(narrow, "mix-sizes")
    ranges = max(1, -(-narrow.count() // rows_per_range))
    part = F.floor(F.col("key") * F.lit(ranges) / F.lit(KEYS)).cast("long")
    # keys that many rows share, and the number of tasks for each
    hot = narrow.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * rows_per_range)
    hot = written(hot.select(F.col("source").alias("hot_source"), F.col("key").alias("hot_key"), F.ceil(F.col("n") / rows_per_range).cast("int").alias("cuts")), "mix-hot-keys")
    narrow = narrow.withColumn("part", part)
    if hot.take(1):
        narrow = narrow.join(small(hot, SMALL), narrow["source"].eqNullSafe(hot["hot_source"]) & (narrow["key"] == hot["hot_key"]), "left")
        # the rows of such a key stand alone, between those of smaller and of greater keys in its range
        cut = F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("cuts"))).otherwise(F.lit(0))
        lone = F.when(F.col("cuts").isNotNull(), F.col("key"))
        borders = hot.select(F.col("hot_source").alias("border_source"), F.floor(F.col("hot_key") * F.lit(ranges) / F.lit(KEYS)).cast("long").alias("border_part"), F.col("hot_key").alias("border"))
        borders = borders.groupBy("border_source", "border_part").agg(F.array_sort(F.collect_list("border")).alias("borders"))
        narrow = narrow.join(small(borders, SMALL, F.size("borders") + 1), narrow["source"].eqNullSafe(F.col("border_source")) & (narrow["part"] == F.col("border_part")), "left")
        below = F.coalesce(F.size(F.filter("borders", lambda x: x < F.col("key"))), F.lit(0))
        narrow = narrow.select("doc_id", "source", "size", "key", "row", *tag, F.struct("part", (2 * below + lone.isNotNull().cast("int")).alias("between"), cut.cast("int").alias("cut")).alias("part"))
    else:
        narrow = narrow.withColumn("part", F.struct("part", F.lit(0).alias("between"), F.lit(0).alias("cut")))
    parts = written(narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    target = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), schedules, share, most)
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    parts = written(parts.join(target, same(parts, target)).select(parts["source"], "part", "ahead", "source_size", "kind", "target"), "mix-plan")
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", "size", *tag, "row").rowsBetween(W.unboundedPreceding, -1)
    rows = narrow.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, same(rows, parts) & (rows["part"] == parts["part"])).drop(parts["source"]).drop(parts["part"])
    offset = F.col("ahead") + F.col("within")
    goal = F.floor(F.col("target")).cast("long")
    passes = []
    for k in range(max(1, -(-int(most * 1000) // 1000))):
        at = offset + F.lit(k) * F.col("source_size")
        got = F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("long")
        when = None
        for kind, knots in enumerate(schedules):
            due = inverse(knots, at / F.nullif(F.col("target"), F.lit(0.0)))
            when = F.when(F.col("kind") == kind, due) if when is None else when.when(F.col("kind") == kind, due)
        passes.append(F.struct(F.round(when, 9).alias("position"), got.alias("words")))
    rows = rows.withColumn("passes", F.filter(F.array(*passes), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(F.size("passes") > 0, F.col("passes")[0]["position"]).alias("position"), "passes", *tag)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, range-sorted by training position; those never taken come last."""
    return plan_mix(docs, **options).drop("passes").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, whole, once for each time they are used, range-sorted by position.

    A use that the target cuts short counts if at least half of the document fits.
    """
    tag = F.struct(text_mark(F.col("text")).alias("text"), F.xxhash64("source").alias("source"))
    plan = written(plan_mix(docs, label=tag, **options).select("doc_id", "tag", "size", "passes"), "mix-uses")
    use = plan.select("doc_id", "tag", F.explode(F.filter("passes", lambda p: p["words"] * 2 >= F.col("size"))).alias("use"))
    use = use.select(F.struct("doc_id", "tag").alias("wanted"), F.col("use.position").alias("at"))
    whole = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag")).alias("mark"), F.struct(*docs.columns).alias("document"))
    # of rows that agree in doc_id, source and text one meets the uses of all
    repeated = written(plan.groupBy(F.struct("doc_id", "tag").alias("twice")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("twice"), "mix-repeats")
    if repeated.take(1):
        known = whole.join(small(repeated, SMALL), whole["mark"].eqNullSafe(F.col("twice")), "left")
        one = known.where("twice is not null").groupBy("mark").agg(F.min_by("document", F.xxhash64(F.col("document").cast("string"))).alias("document"))
        whole = known.where("twice is null").select("mark", "document").union(one)
    return whole.join(use, whole["mark"].eqNullSafe(use["wanted"])).orderBy("at", "mark").select("document.*")
