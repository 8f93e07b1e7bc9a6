"""Prompt in, remembered context out: the flagship job, for any number of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text as T
from ..operators.search import Index, search_for_injection

# Fixed values of the envelope and its limits.
LIMIT, MAX_RANK, BUDGET_TOKENS = 3, -1.0, 500
HEADER = "<memory-lake-context>\nMemórias de sessões anteriores relevantes ao pedido (proveniência entre colchetes; use `ng search <termos>` para recuperar mais):\n"
FOOTER = "</memory-lake-context>"


def first_of_equal(hits: DataFrame, limit: int) -> DataFrame:
    """Of hits with equal normalised snippets the best, then the best `limit`."""
    same = Window.partitionBy("query_id", T.normalize("snippet")).orderBy("rank", "id")
    best = Window.partitionBy("query_id").orderBy("rank", "id")
    once = hits.withColumn("_s", F.row_number().over(same)).filter("_s = 1").drop("_s")
    return once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)


def within_budget(lines: DataFrame, header_bytes: int, budget_bytes: int) -> DataFrame:
    """The longest prefix of a query's lines that fits with its header."""
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_sum", F.sum(F.octet_length("line")).over(w)).filter(F.col("_sum") + header_bytes <= budget_bytes).drop("_sum")


def inject(hits: DataFrame, limit: int = LIMIT, max_rank: float = MAX_RANK, budget_tokens: int = BUDGET_TOKENS) -> DataFrame:
    """query_id, context, items, tokens_est. Queries without a good enough hit have no row."""
    chosen = first_of_equal(hits.filter(F.col("rank") <= max_rank), limit)
    line = F.concat(F.lit("- [#"), F.col("id").cast("string"), F.lit(" · "), F.col("harness"), F.lit(" · "), dates.fmt_date("created_at"), F.lit("] "), F.replace("snippet", F.lit("\n"), F.lit(" ")), F.lit("\n"))
    lines = within_budget(chosen.select("query_id", "place", line.alias("line")), len(HEADER.encode()), budget_tokens * 4)
    g = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"), F.count("*").alias("items"))
    context = F.concat(F.lit(HEADER), F.array_join("l.line", ""), F.lit(FOOTER))
    return g.select("query_id", context.alias("context"), "items").withColumn("tokens_est", T.tokens_est("context"))


def build_injection(index: Index, prompts: DataFrame, limit: int = LIMIT, max_rank: float = MAX_RANK, budget_tokens: int = BUDGET_TOKENS) -> DataFrame:
    """prompts: query_id, session_id, query."""
    return inject(search_for_injection(index, prompts, limit * 3), limit, max_rank, budget_tokens)


def ledger_rows(injections: DataFrame, prompts: DataFrame, project: str, now: int) -> DataFrame:
    """What the injections cost, for the ledger."""
    return injections.join(prompts.select("query_id", "session_id"), "query_id").select(F.lit("inject").alias("kind"), F.lit(None).cast("string").alias("saver"), "session_id", F.lit(project).alias("project"), F.col("tokens_est").alias("tokens"), "items", F.lit(now).cast("long").alias("created_at"))
