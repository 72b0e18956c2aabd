"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (its expected number of copies). Among all rates that
give each source its target number of words, those nearest to one copy each in
the sense of relative entropy have the form ``exp(tilt * size)``, bounded by the
most copies allowed. The tilt of a source solves the convex dual of that problem;
Newton steps find it, safeguarded by a bracket. A step is one job over the table
of sizes: words and curvature are summed for each source, in exact decimals so that
reruns give the same tilts.

Rates are then rounded into whole copies. Documents of one source and size share
a rate; going from large sizes to small ones, the copies of each size are chosen
so that the words taken so far are as near as possible to the sum of rates so
far. What remains is at most half the smallest document. Which documents of a
size get the additional copy is decided by a hash of the doc_id.

Edge cases: a null text has size 0; documents of size 0 and of sources without
words are not taken; a null source is a source of its own, the last in order; a
null doc_id is a value like another; rows that share a doc_id are documents of
their own; an empty table gives no rows; other columns are kept by ``mix`` and
may have any name.

A task handles the distinct sizes of one source at most, or one of ``SPLITS``
parts of the documents of one source and size. The table of sources (a row each)
is ordered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tables import Scratch

MAX_COPIES = 3
#: Parts into which the documents of one source and size are divided.
SPLITS = 64
#: Newton stops when every source is so near its target, relatively, or after so many steps.
TOLERANCE, STEPS = 1e-10, 80

_EXACT = "decimal(38,12)"


def size_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources weigh the values of ``cycle`` in turn, in code point order with null
    last, and share the sum of all sizes by weight. A target stops at ``most``
    times its source's size; the excess goes to the others by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), turn + 1)
    rows = sources.select("source", "source_size", weight.alias("weight"))
    rows = rows.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    # In order of the level at which a source fills up, those before have filled up.
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / open_weight)
    rows = rows.withColumn("full", F.col("bound") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)
    target = F.when(F.col("full"), F.col("bound")).otherwise(level["level"] * F.col("weight"))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.col("bound")).alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, scratch: Scratch, most: int = MAX_COPIES) -> DataFrame:
    """Solve the dual: (source, tilt) from sizes (source, size, docs) and goals (source, target).

    The tilt is per word of the source's mean size; infinite where every document
    has to be taken ``most`` times, minus infinite where none is.
    """
    facts = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.sum(F.col("size") * F.col("docs")).alias("words"))
    start = goals.join(facts, goals["source"].eqNullSafe(facts["source"])).select(goals["source"], "target", "mean", "words")
    end = F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= F.col("words") * most, F.lit(float("inf")))
    state = start.select("source", "target", "mean", F.coalesce(end, F.lit(0.0)).alias("tilt"), end.isNotNull().alias("done"))
    state = state.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    state = scratch.put("tilt0", state)
    cells = sizes.select(F.col("source").alias("of"), "size", "docs").where("size > 0")
    for step in range(STEPS):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.col("tilt") * x), F.lit(float(most)))
        words = (F.col("docs") * F.col("size") * rate).cast(_EXACT)
        slope = (F.col("docs") * F.col("size") * x * F.when(rate < most, rate).otherwise(0.0)).cast(_EXACT)
        live = state.where("not done")
        sums = cells.join(live, F.col("of").eqNullSafe(F.col("source"))).groupBy("of").agg(F.sum(words).cast("double").alias("got"), F.sum(slope).cast("double").alias("slope"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        miss = F.col("got") - F.col("target")
        near = F.col("done") | (F.abs(miss) <= F.col("target") * TOLERANCE)
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("tilt")) <= 4)
        halved = F.when(low.isNull(), high - 2).when(high.isNull(), low + 2).otherwise((low + high) / 2)
        moved = F.when(near, F.col("tilt")).when(inside, newton).otherwise(halved)
        stuck = low.isNotNull() & high.isNotNull() & ((high - low) <= 1e-13)
        state = scratch.put(f"tilt{step + 1}", now.select("source", "target", "mean", moved.alias("tilt"), (near | stuck).alias("done"), low.alias("low"), high.alias("high")))
        scratch.drop(f"tilt{step}")
    return state.select("source", "target", "mean", "tilt")


def _round_down_sizes(most: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        size, docs = cells["size"].to_numpy(), cells["docs"].to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            rate = np.minimum(np.exp(cells["tilt"].to_numpy() * (size / cells["mean"].to_numpy())), most)
        copies, wanted, taken = [], 0.0, 0
        for s, n, r in zip(size.tolist(), docs.tolist(), rate.tolist(), strict=True):
            wanted += s * n * r
            c = min(max(round((wanted - taken) / s), 0), most * n)
            taken += c * s
            copies.append(c)
        return cells.assign(copies=np.array(copies, np.int64))[["source", "size", "docs", "copies"]]

    return run


def plan(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MAX_COPIES) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs`` whole, and how often the mixture takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    split = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SPLITS)).cast("int").alias("split")
    # The row is kept in a struct, where its columns clash with nothing.
    sized = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), split)
    parts = scratch.put("parts", sized.groupBy("source", "size", "split").agg(F.count("*").alias("n")))
    sizes = scratch.put("sizes", parts.groupBy("source", "size").agg(F.sum("n").alias("docs")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = scratch.put("goals", targets(sources, cycle, most))
    tilt = tilts(sizes, goals, scratch, most)
    cells = sizes.where("size > 0").join(tilt.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "target")
    rounded = cells.groupBy("source").applyInPandas(_round_down_sizes(most), "source string, size long, docs long, copies long")
    rounded = scratch.put("rounded", rounded)

    # Copies of a size are dealt to its parts in proportion to their documents.
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    joined = parts.join(rounded, same(parts, rounded)).select(parts["source"], parts["size"], "split", "n", "docs", "copies")
    upto = Window.partitionBy("source", "size").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    exact = lambda c: c.cast("decimal(19,0)")
    share = lambda c: F.floor(exact(F.col("copies")) * exact(c) / exact(F.col("docs")))
    joined = joined.withColumn("sofar", F.sum("n").over(upto))
    joined = joined.withColumn("c", (share(F.col("sofar")) - share(F.col("sofar") - F.col("n"))).cast("long"))
    shares = joined.select("source", "size", "split", F.expr("c div n").alias("base"), F.expr("c % n").alias("more"))
    shares = scratch.put("shares", shares)
    scratch.drop("parts", "sizes", "rounded")
    out = sized.join(shares, same(sized, shares) & (sized["split"] == shares["split"]), "left")
    out = out.select("row", sized["source"], sized["size"], sized["split"], "base", "more")
    first = Window.partitionBy("source", "size", "split").orderBy(F.xxhash64(F.col("row.doc_id").cast("long"), F.lit(1)), "row.doc_id")
    extra = (F.row_number().over(first) <= F.col("more")).cast("long")
    out = out.withColumn("copies", F.coalesce(F.col("base") + extra, F.lit(0)).cast("long"))
    out = out.join(goals, out["source"].eqNullSafe(goals["source"]), "left")
    return out.select("row", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MAX_COPIES) -> DataFrame:
    """The mixture: each row of ``docs`` as often as the plan says, columns unchanged."""
    taken = plan(docs, cycle, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
