"""Order-sensitive folds: greedy batches, budgeted selection, runs of equal rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def _items(df: DataFrame, group: str, order: str, tokens: str) -> DataFrame:
    """(g, o, i, t): items of each group in order, numbered from 0; null and negative tokens are 0."""
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("t"))
    return prefix.numbered(rows, ["g"], ["o", "t"], "i").checkpoint()


def greedy_batches(df: DataFrame, group: str, order: str, tokens: str, prompt: int, separator: int, budget: int) -> DataFrame:
    """(group, order, batch): items in order; a batch closes when the next item would pass the budget; an item that is too
    large has its own. The first item of a batch pays no separator.

    If a batch began with an item, the next one would begin with the first item whose prefix sum passes a bound: an as-of join on sums.
    The batches of a group are the successors of its first item; after round k of pointer doubling 2^k of them are known. So a
    group of any size is spread over all tasks; items that take no room at all (no tokens, no separator) share a place.
    """
    items = _items(df, group, order, tokens)
    size = F.col("t") + separator
    summed = prefix.running_sum(items, ["g"], "i", size, "before").withColumn("upto", F.col("before") + size)
    bound = F.lit(budget - prompt) - F.col("t") + F.col("upto")
    asks = summed.select("g", "i", F.greatest(bound, F.col("upto")).alias("at"), F.lit(None).cast("long").alias("j"))
    marks = summed.select("g", F.lit(None).cast("long").alias("i"), F.col("upto").alias("at"), F.col("i").alias("j"))
    # of equal places the item comes first, so it is not above the bound
    line = asks.unionByName(marks).withColumn("at", F.col("at") * 2 + F.col("i").isNotNull().cast("int"))
    next_one = prefix.as_of(line, ["g"], "at", F.col("j"), "next", backward=True).where("i is not null")
    jump = next_one.where("next is not null").select("g", "i", "next").checkpoint()
    starts, step = items.where("i = 0").select("g", "i", F.lit(0).alias("batch")), 1
    while not jump.isEmpty():
        more = starts.alias("s").join(jump.alias("j"), F.col("s.g").eqNullSafe(F.col("j.g")) & (F.col("s.i") == F.col("j.i"))).select("s.g", F.col("j.next").alias("i"), (F.col("s.batch") + step).alias("batch"))
        starts = starts.unionByName(more).checkpoint()
        on = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.next") == F.col("b.i"))
        jump = jump.alias("a").join(jump.alias("b"), on).select("a.g", "a.i", "b.next").checkpoint()
        step *= 2
    own = starts.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("batch").alias("own"))
    known = items.join(own, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")), "left").select(*items.columns, "own")
    last = prefix.as_of(known, ["g"], "i", F.col("own"), "earlier")
    return last.select(F.col("g").alias(group), F.col("o").alias(order), F.coalesce("own", "earlier").alias("batch"))


def budget_select(df: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(group, order) of the items taken in order while they fit; one that doesn't is skipped, not the end.

    In phases by the room that is left: while it lies in [k, 2k), items of 2k or more can't be taken, those below k always fit, and one between them that fits leaves
    less than k. So a phase takes the small items in order up to the first item that brings the room below k, found by prefix sums over all groups side by
    side; there are as many phases as the budget has binary digits, and one for what takes no room.
    """
    items, pieces = _items(df, group, order, tokens).where(F.col("t") <= budget), []
    state = items.select("g").distinct().select("g", F.lit(-1).cast("long").alias("at"), F.lit(budget).cast("long").alias("room"))
    for k in [*(1 << n for n in reversed(range(max(budget, 0).bit_length()))), 0]:
        own = state.where(F.col("room") >= k).select(F.col("g").alias("_g"), "at", "room")
        left = items.where(F.col("t") < max(2 * k, 1)).join(own, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") > F.col("at"))).drop("_g", "at")
        small = F.col("t") < max(k, 1)
        summed = prefix.running_sum(left, ["g"], "i", F.when(small, F.col("t")), "before", unique=True)
        after = F.col("room") - F.col("before") - F.col("t")
        summed = summed.withColumn("ends", F.when(small, after < k).otherwise(after >= 0)).checkpoint()
        end = summed.where("ends").groupBy(F.col("g").alias("_g")).agg(F.min("i").alias("end"), F.min_by(after, "i").alias("rest"))
        met = summed.join(end, F.col("g").eqNullSafe(F.col("_g")), "left")
        pieces.append(met.where((F.col("end").isNull() & small) | (F.col("i") < F.col("end")) & small | (F.col("i") == F.col("end"))).select("g", "o"))
        # a group without such an item has taken all it can
        done = state.join(end, F.col("g").eqNullSafe(F.col("_g")), "left").where((F.col("room") < k) | F.col("end").isNotNull())
        state = done.select("g", F.coalesce("end", "at").alias("at"), F.coalesce("rest", "room").alias("room")).checkpoint()
    return reduce(DataFrame.unionByName, pieces).select(F.col("g").alias(group), F.col("o").alias(order))


def segments(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, value, first, last): maximal runs of equal neighbours, by row number in the group."""
    w = Window.partitionBy(group).orderBy(*order)
    n = df.withColumn("n", F.row_number().over(w)).withColumn("new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    n = n.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy(group, "run", value).agg(F.min("n").alias("first_row"), F.max("n").alias("last_row")).drop("run")


def loop_weight(kind: Column, d0: Column, d1: Column, d2: Column) -> Column:
    """Weight of calls by loop depth for a data type single, paged_list or unpaged_list."""
    many = F.when(kind == "paged_list", 20).when(kind == "unpaged_list", 100).otherwise(1)
    return F.when(d2 > 0, F.when(kind == "single", d0 + d1 + d2).otherwise(d0 + 10 * d1 + many * d2)).when(d1 > 0, d0 + many * d1).otherwise(d0)
