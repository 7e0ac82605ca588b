"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Of all rates at which documents may be taken, those are wanted that are nearest to one
copy each in relative entropy, give each source its target and take no document more than MOST times. Their dual has one
number for each source: a document of c words is taken at the rate min(MOST, exp(l * c)), and l solves the source's
equation. Newton steps find l for all sources at once; where a step leaves the bracket of what is known, the bracket is
halved or doubled.

A rate depends on a document's source and size alone, so texts are counted once, and all later work is on the number of
documents of each source and size: at most as many rows of a source as its longest text has words. Each Newton step is a
sum over these rows; the state of the steps is a small table that is written in each round, of which the driver sees how
many sources are left.

Rates become copies by sizes, from the largest to the smallest: running sums of rates are rounded, so that a source's
words differ from its target by half a longest text at most; what is missing then is made up by one size for each power of
two. Which documents of a size get a copy more is decided by a hash of their ids; ranks among documents of a size are found
by a segmented scan, so that a size that a third of all rows have is no single task's work.

All sums are of whole numbers (rates in units of 1 / ONE), so that nothing depends on the order of rows and runs agree.

Cases: null and empty texts have no words, and are taken with none; a null source comes last and is apart from the empty
one; null ids and repeated rows are rows like others; a source without words has target 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import materialize

#: Copies of a document at most; units of a rate; Newton rounds at most; words or share of a target that a step may miss.
MOST, ONE, ROUNDS, WORDS, SHARE = 3, 1 << 24, 60, 1.0, 1e-5
WEIGHTS = (1, 2, 3)
#: A source: whether it's null, and its name.
KEY = ["none", "name"]


def n_words(c: str) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(c), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """none, name, source_size, weight, target: shares by weight, cut to MOST times a source's size and dealt out again.

    sources: none, name, source_size. Sources that are cut stay so, and the level of the others only rises: each round is
    one sum over the sources.
    """
    rows = numbered(sources, [], KEY, "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = materialize(rows.select(*KEY, "source_size", weight.alias("weight")), sources.sparkSession, "sources")
    level, seen = 0.0, -1
    while True:
        cut = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        x = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(cut, MOST * F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(cut, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(cut).alias("n")).first()
        if x.n == seen or not x.weight:
            break
        level, seen = (x["all"] - x.held) / x.weight, x.n
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double")))


def rate(slope: Column, size: Column) -> Column:
    """The rate of a size in units of 1 / ONE."""
    return F.round(F.exp(F.least(slope * size, F.lit(math.log(MOST)))) * ONE).cast("long")


def slopes(spark: SparkSession, classes: DataFrame, goals: DataFrame) -> DataFrame:
    """none, name, slope for each source with words whose target is below MOST times its size.

    classes: none, name, size, n. The state of each source: slope, low and high (between which it lies; null if unknown).
    """
    wide = lambda *c: _product([F.col(x).cast("decimal(19,0)") for x in c])
    state = goals.where((F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-9)))
    state = materialize(state.select(*KEY, "target", F.lit(0.0).alias("slope"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), spark, "dual")
    done = None
    for _ in range(ROUNDS):
        now = classes.join(state.where("not done"), KEY).withColumn("q", rate(F.col("slope"), F.col("size")))
        # The dual's gradient and second derivative; sizes at the highest rate don't move.
        moving = F.when(F.col("q") < MOST * ONE, wide("n", "size") * wide("size", "q"))
        sums = now.groupBy(*KEY, "target", "slope", "low", "high").agg(
            (F.sum(wide("n", "size") * F.col("q").cast("decimal(19,0)")).cast("double") / ONE).alias("f"), (F.sum(moving).cast("double") / ONE).alias("g"), F.max("size").alias("longest"),
        )
        value = F.col("f")
        near = F.abs(value - F.col("target")) <= F.greatest(F.lit(WORDS), F.col("target") * SHARE)
        low, high = F.when(value < F.col("target"), F.col("slope")).otherwise(F.col("low")), F.when(value > F.col("target"), F.col("slope")).otherwise(F.col("high"))
        moved = sums.select(*KEY, "target", "slope", "f", "g", low.alias("low"), high.alias("high"), near.alias("done"), "longest")
        # For a single size the logarithm of the sum is a straight line in the slope: steps are taken in it.
        step = F.when((F.col("f") > 0) & (F.col("g") > 0) & (F.col("target") > 0), F.col("slope") - F.col("f") * F.ln(F.col("f") / F.col("target")) / F.col("g"))
        inside = (step > F.coalesce("low", F.lit(-math.inf))) & (step < F.coalesce("high", F.lit(math.inf)))
        out = F.when(F.col("low").isNull(), F.col("slope") * 2 - F.lit(1.0) / F.col("longest")).when(F.col("high").isNull(), F.col("slope") * 2 + F.lit(1.0) / F.col("longest")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.select(*KEY, "target", F.when(F.col("done"), F.col("slope")).when(inside, step).otherwise(out).alias("slope"), "low", "high", "done")
        new = materialize(moved, spark, "dual")
        ready = new.where("done").select(*KEY, "slope")
        done = ready if done is None else done.unionByName(ready)
        state = new
        if new.where("not done").isEmpty():
            return done
    return done.unionByName(state.where("not done").select(*KEY, "slope"))


def _product(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out.cast("decimal(38,0)") if len(columns) > 1 else out


def copies(classes: DataFrame, goals: DataFrame, found: DataFrame) -> DataFrame:
    """none, name, size, n, q, copies: how many copies all documents of a source and size get together.

    A source's sizes are at most as many as its longest text has words, whatever the number of its documents is.
    """
    rows = classes.where("size > 0").join(goals.select(*KEY, "source_size", "target"), KEY).join(found, KEY, "left")
    # Without a slope the source is taken MOST times.
    rows = rows.withColumn("q", F.when(F.col("slope").isNull(), F.lit(MOST * ONE)).otherwise(rate(F.col("slope"), F.col("size"))).cast("long"))
    upto = F.sum(F.col("n") * F.col("q")).over(Window.partitionBy(*KEY).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda c: F.floor((c + ONE // 2) / F.lit(ONE)).cast("long")
    rows = rows.withColumn("__upto", upto).withColumn("copies", whole(F.col("__upto")) - whole(F.col("__upto") - F.col("n") * F.col("q")))
    rows = materialize(rows.drop("__upto", "slope"), classes.sparkSession, "copies")
    # What is missing: of the sizes of each power of two the one with most room, from the largest on.
    room = F.struct(F.col("size").alias("size"), (MOST * F.col("n") - F.col("copies")).alias("up"), F.col("copies").alias("down"))
    most = lambda c: F.max_by(room, F.struct(c, "size"))
    missing = rows.groupBy(*KEY).agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing"))
    bands = rows.join(missing, KEY).groupBy(*KEY, "missing", F.floor(F.log2("size")).alias("band")).agg(F.when(F.col("missing") > 0, most(F.col("copies") * -1 + MOST * F.col("n"))).otherwise(most(F.col("copies"))).alias("x"))
    listed = bands.groupBy(*KEY, "missing").agg(F.sort_array(F.collect_list("x"), asc=False).alias("bands"))

    def given(held: Column, x: Column) -> Column:
        units = F.floor(F.abs(held["left"]) / x["size"]).cast("long")
        k = F.when(held["left"] > 0, F.least(units, x["up"])).otherwise(-F.least(units, x["down"]))
        return F.struct((held["left"] - k * x["size"]).alias("left"), F.concat(held["changes"], F.array(F.struct(x["size"].alias("size"), k.alias("k")))).alias("changes"))

    start = F.struct(F.col("missing").alias("left"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("changes"))
    changes = listed.select(*KEY, F.inline(F.aggregate("bands", start, given)["changes"])).where("k <> 0")
    rows = rows.join(changes, [*KEY, "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("k", F.lit(0)))
    return rows.drop("k")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, rate, copies, taken for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    rows = rows.select("id", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "size", F.xxhash64("id").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, spark, "sizes")
    classes = materialize(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), spark, "classes")
    goals = materialize(targets(classes.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), spark, "targets")
    given = copies(classes, goals, slopes(spark, classes, goals))
    # Sizes of no words have no rate of their own: one copy each.
    given = classes.join(goals.select(*KEY, "source_size", "target"), KEY).join(given.select(*KEY, "size", "q", "copies"), [*KEY, "size"], "left")
    given = materialize(given.withColumns({"q": F.coalesce("q", F.lit(ONE).cast("long")), "copies": F.coalesce("copies", "n")}), spark, "given")
    ranked = numbered(rows, [*KEY, "size"], ["h", "row"], "place")
    extra = (F.col("place") <= F.col("copies") % F.col("n")).cast("long")
    own = ranked.join(given, [*KEY, "size"]).withColumn("own", F.expr("copies div n") + extra)
    source = F.when(~F.col("none"), F.col("name"))
    return own.select(F.col("id").alias(id_col), source.alias(source_col), "size", "source_size", "target", (F.col("q") / ONE).alias("rate"), F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"))
