"""Retrieval evaluation: per-task figures, summaries, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def percentiles(rows: DataFrame, by: str, value: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """by, and for each name -> (kind, p) the exact percentile of value, nulls aside.

    Places are counted from 0 in the sorted values: kind "floor" takes place
    n * p // 100 (the last at most), "ceil" place ceil(n * p / 100) - 1. Equal values
    are counted before they are sorted, so a group is its different values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))

    def place(kind: str, p: int) -> Column:
        n = F.col("_all")
        return F.least(n, F.floor(n * p / 100) + 1) if kind == "floor" else F.greatest(F.lit(1), F.ceil(n * p / 100))

    return counts.groupBy(by).agg(*(F.min(F.when(F.col("_upto") >= place(*what), F.col(value))).alias(name) for name, what in wanted.items()))


def rank_metrics(ranked: DataFrame, gold: DataFrame, k: int = 3, recall_at: int = 10, sizes: DataFrame | None = None) -> DataFrame:
    """query_id, precision, recall, rr of every query that has gold.

    ranked: query_id, id, place (from 1); up to recall_at and each query's first gold
    row are enough. gold: query_id, id; with sizes (query_id, n_gold) only that of ranked rows is needed.
    """
    g = gold.select("query_id", "id").distinct()
    sizes = g.groupBy("query_id").agg(F.count("*").alias("n_gold")) if sizes is None else sizes.filter("n_gold > 0")
    hit = ranked.join(g, ["query_id", "id"]).groupBy("query_id").agg(F.count_if(F.col("place") <= k).alias("in_k"), F.count_if(F.col("place") <= recall_at).alias("in_r"), F.min("place").alias("first"))
    both = sizes.join(hit, "query_id", "left")
    return both.select(
        "query_id",
        F.round(F.coalesce("in_k", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce("in_r", F.lit(0)) / F.col("n_gold"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
    )


def task_metrics(tasks: DataFrame, shown: DataFrame, gold: DataFrame, baseline: DataFrame, k: int = 3) -> DataFrame:
    """One row a task: found, mrr within k, tokens shown, baseline tokens, saving.

    tasks: query_id, class, needle. shown: query_id, id, place, content. gold:
    query_id, id. baseline: query_id, tokens (what reading everything would cost).
    """
    top = shown.filter(F.col("place") <= k)
    cost = top.groupBy("query_id").agg(F.sum(T.tokens_est("content")).cast("long").alias("tokens"), F.collect_list(T.bench_fold("content")).alias("_texts"))
    first = top.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("place").alias("first"))
    rows = tasks.join(cost, "query_id", "left").join(first, "query_id", "left").join(baseline.select("query_id", F.col("tokens").alias("baseline")), "query_id", "left")
    needle = F.exists("_texts", lambda t: F.contains(t, T.bench_fold("needle")))
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    return rows.select(
        "query_id",
        "class",
        F.coalesce(F.col("first").isNotNull() & F.coalesce(needle, F.lit(False)), F.lit(False)).alias("found"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        tokens.alias("tokens"),
        F.coalesce("baseline", F.lit(0)).cast("long").alias("baseline"),
        F.round(F.when(F.col("baseline") > 0, 1 - tokens / F.col("baseline")).otherwise(0.0), 6).alias("saving"),
    )


_AVERAGES = ("accuracy", "mrr", "tokens", "baseline", "saving", "saving_found", "n")


def _aggregates() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.round(F.avg(F.col("found").cast("int")), 6).alias("accuracy"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
        F.round(F.avg("tokens"), 6).alias("tokens"),
        F.round(F.avg("baseline"), 6).alias("baseline"),
        F.round(F.avg("saving"), 6).alias("saving"),
        F.round(F.avg(F.when(F.col("found"), F.col("saving"))), 6).alias("saving_found"),
    ]


def summarize(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*_aggregates())


def summarize_class(metrics: DataFrame) -> DataFrame:
    """A row for each class and one, with class null, for all."""
    return metrics.rollup("class").agg(*_aggregates())


def without_memory(tasks: DataFrame) -> DataFrame:
    """The arm that knows nothing: no tokens, nothing found."""
    return tasks.select("query_id", "class", F.lit(False).alias("found"), F.lit(0.0).alias("mrr"), F.lit(0).cast("long").alias("tokens"))


def full_context(tasks: DataFrame, corpus: DataFrame) -> DataFrame:
    """The arm that rereads all other sessions: everything found, at the whole corpus's cost.

    The corpus is summed by session first; each task subtracts its own.
    """
    by = corpus.groupBy("session_id").agg(F.sum("tokens_est").cast("long").alias("own"))
    total = by.agg(F.coalesce(F.sum("own"), F.lit(0)).cast("long").alias("total"))
    t = tasks.join(by, tasks["query_session"] == by["session_id"], "left").crossJoin(F.broadcast(total))  # one row
    return t.select("query_id", "class", F.lit(True).alias("found"), F.lit(1.0).alias("mrr"), (F.col("total") - F.coalesce("own", F.lit(0))).alias("tokens"))
