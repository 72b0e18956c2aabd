"""Usage ledger: pricing, roll-up, supersession, break-even."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.schema import PURPOSES


def price_list(overrides_json: str | None = None) -> list[tuple[str, float, float]]:
    """Built-in prices with overrides: a known prefix keeps its place, a new one goes last."""
    table = {prefix: (p, c) for prefix, p, c in fixed.PRICES}
    try:
        extra = {str(k): (float(v[0]), float(v[1])) for k, v in json.loads(overrides_json).items()} if overrides_json else {}
    except (ValueError, TypeError, IndexError, AttributeError):
        extra = {}
    return [(k, p, c) for k, (p, c) in {**table, **extra}.items()]


def _millionths(dollars: Column) -> Column:
    """``dollars`` rounded half to even at six places, by the digits of its value.

    ``bround`` of a double rounds its shortest notation, so a value that lies just beside a
    half counts as one. Twenty places of it as a decimal say on which side it lies.
    """
    digits = F.bround((dollars * 1e20).cast("decimal(38,0)"), -14)
    return (digits / F.lit(10**14).cast("decimal(15,0)")).cast("long") / 1e6


def estimate_cost(model: Column, prompt: Column, completion: Column, prices: list[tuple[str, float, float]] | None = None) -> Column:
    """Dollar estimate; the first price prefix that fits the model decides.

    The price list is a handful of settings, so it becomes one CASE expression
    in the plan instead of a prefix join.
    """
    cost = None
    for prefix, per_prompt, per_completion in prices or fixed.PRICES:
        value = _millionths(prompt / 1e6 * per_prompt + completion / 1e6 * per_completion)
        fits = model.startswith(prefix)
        cost = F.when(fits, value) if cost is None else cost.when(fits, value)
    return cost.otherwise(0.0) if cost is not None else F.lit(0.0)


def price(ledger: DataFrame, prices: list[tuple[str, float, float]] | None = None) -> DataFrame:
    cost = estimate_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), prices)
    return ledger.withColumn("cost_usd", cost)


def supersede_latest(ledger: DataFrame, purpose: str) -> DataFrame:
    """Zero the newest error-free call of ``purpose``; it still counts as a call."""
    live = (F.col("kind") == "llm") & (F.col("purpose") == purpose) & (F.coalesce("error", F.lit("")) == "")
    last = ledger.where(live).agg(F.max("seq").alias("last_seq"))
    hit = F.coalesce(F.col("seq") == F.col("last_seq"), F.lit(False))
    zeroed = {c: F.when(hit, F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("prompt_tokens", "long"), ("completion_tokens", "long"), ("cost_usd", "double"))}
    return (
        ledger.crossJoin(F.broadcast(last))  # one aggregate row
        .withColumns({**zeroed, "superseded": F.when(hit, True).otherwise(F.coalesce("superseded", F.lit(False)))})
        .drop("last_seq")
    )


def roll_up(ledger: DataFrame) -> DataFrame:
    """Totals (purpose null) and one row per purpose, unused purposes zero."""
    call = F.col("kind") == "llm"
    failed = call & (F.coalesce("error", F.lit("")) != "")
    sums = [
        F.count_if(call).alias("calls"),
        F.count_if(failed).alias("failed_calls"),
        F.sum(F.when(call, F.col("prompt_tokens"))).alias("prompt_tokens"),
        F.sum(F.when(call, F.col("completion_tokens"))).alias("completion_tokens"),
        F.sum(F.when(call, F.col("cost_usd"))).alias("cost_usd"),
        F.sum(F.when(call, F.col("wall_ms"))).alias("wall_ms"),
        F.sum(F.when(F.col("kind") == "phase", F.col("wall_ms"))).alias("phase_wall_ms"),
    ]
    grouped = ledger.rollup("purpose").agg(F.grouping("purpose").alias("is_total"), *sums)
    domain = ledger.sparkSession.createDataFrame([(p, 0) for p in PURPOSES] + [(None, 1)], "purpose string, is_total int")
    full = domain.join(
        grouped, domain.purpose.eqNullSafe(grouped.purpose) & (domain.is_total == grouped.is_total), "left"
    ).drop(grouped.purpose, grouped.is_total)
    whole = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("calls", "failed_calls", "prompt_tokens", "completion_tokens")}
    return (
        full.withColumns(whole)
        .withColumns(
            {
                "cost_usd": F.bround(F.coalesce("cost_usd", F.lit(0.0)), 6),
                "wall_ms": F.bround(F.coalesce("wall_ms", F.lit(0.0)), 1),
                "phase_wall_ms": F.bround(F.coalesce("phase_wall_ms", F.lit(0.0)), 1),
                "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
            }
        )
        .drop("is_total")
    )


def break_even(ledgers: DataFrame, n_questions: int | Column) -> DataFrame:
    """One row from rows tagged ``side`` = graph / baseline.

    Build tokens against the tokens each side spends on questions, and how many
    questions pay the build back (null when the graph side saves nothing).
    """
    tokens = F.when(F.col("kind") == "llm", F.col("prompt_tokens") + F.col("completion_tokens"))
    side, purpose = F.col("side"), F.col("purpose")
    n = n_questions if isinstance(n_questions, Column) else F.lit(n_questions)
    n = F.greatest(n, F.lit(1)).cast("long")
    sums = ledgers.agg(
        F.coalesce(F.sum(F.when((side == "graph") & (purpose == "ingest"), tokens)), F.lit(0)).alias("build_tokens"),
        F.coalesce(F.sum(F.when((side == "graph") & purpose.isin("plan", "answer"), tokens)), F.lit(0)).alias("graph_tokens"),
        F.coalesce(F.sum(F.when((side == "baseline") & purpose.isin("plan", "read", "answer"), tokens)), F.lit(0)).alias("baseline_tokens"),
    )
    saving = F.col("baseline_tokens") - F.col("graph_tokens")
    return sums.select(
        "build_tokens",
        F.expr("graph_tokens").alias("graph_tokens"),
        F.expr("baseline_tokens").alias("baseline_tokens"),
        F.floor(F.col("graph_tokens") / n).alias("graph_per_question"),
        F.floor(F.col("baseline_tokens") / n).alias("baseline_per_question"),
        saving.alias("saving"),
        F.when(saving > 0, F.floor(F.col("build_tokens") / saving)).alias("questions_to_amortize"),
    )


def tools_used(steps: DataFrame) -> DataFrame:
    """(question_no, steps, tools): distinct actions of a question, finish left out."""
    action = F.coalesce("action", F.lit("?"))
    return steps.groupBy("question_no").agg(
        F.count("*").alias("steps"),
        F.coalesce(
            F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(action != "finish", action))), ", "), F.lit("")), F.lit("-")
        ).alias("tools"),
    )


def compare_purposes(ledgers: DataFrame) -> DataFrame:
    """Per purpose: tokens and calls of both sides next to each other."""
    domain = ledgers.sparkSession.createDataFrame([(p,) for p in PURPOSES], "purpose string")
    call = F.col("kind") == "llm"
    cells = []
    for side in ("graph", "baseline"):
        mine = call & (F.col("side") == side)
        cells += [
            F.sum(F.when(mine, F.col("prompt_tokens") + F.col("completion_tokens"))).alias(f"{side}_tokens"),
            F.count_if(mine).alias(f"{side}_calls"),
        ]
    sums = ledgers.groupBy("purpose").agg(*cells)
    return domain.join(sums, "purpose", "left").na.fill(0)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    from loomgraph.schema import LEDGER

    return spark.read.schema(LEDGER).json(path)


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append-only log: earlier runs are never rewritten."""
    ledger.write.mode("append").json(path)
