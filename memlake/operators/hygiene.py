"""Transcript clean-up: scores, eviction plans, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the rules.
HOT_ZONE, TOOL_LARGE, ASSISTANT_LARGE, ASSISTANT_OLDER = 20, 100, 200, 20
PRECOMPACT_TARGET, CLEAR_TARGET = 20_000, 4_000
UI_PREVIEW = 80
KEEP = 1.7976931348623157e308


def aged(items: DataFrame) -> DataFrame:
    """Adds total and age (0 for a session's newest item). items: session, index, role, kind, tokens_est."""
    total = items.groupBy(F.col("session").alias("_session")).agg(F.count("*").alias("total"))
    return items.join(total, F.col("session").eqNullSafe(F.col("_session"))).drop("_session").withColumn("age", F.greatest(F.lit(0), F.col("total") - (F.col("index") + 1)))


def score_items(items: DataFrame) -> DataFrame:
    """Adds score (lowest goes first), evictable and reason.

    The newest items stay; then large tool results go, users' words never do,
    unrecognised items go first of all, and of assistants' prose what is both old
    and large. Everything else stays.
    """
    a = aged(items)
    tok, age = F.col("tokens_est"), F.col("age")
    hot = F.col("index") >= F.greatest(F.lit(0), F.col("total") - HOT_ZONE)
    tool, other = F.col("kind") == "tool_result", (F.col("kind") == "other") | (F.col("role") == "other")
    prose = (F.col("role") == "assistant") & (F.col("kind") == "text")
    old_prose = prose & (age >= HOT_ZONE + ASSISTANT_OLDER) & (tok >= ASSISTANT_LARGE)
    ladder = [
        (hot, None, "hot zone"),
        (tool & (tok >= TOOL_LARGE), -(tok + age), "large tool output"),
        (tool, None, "small tool output"),
        (F.col("role") == "user", None, "user prompt"),
        (other, -tok - 1_000_000.0, "unrecognised item"),
        (old_prose, -(tok * 0.5 + age * 0.5), "old, large assistant text"),
        (prose, None, "recent or small assistant text"),
    ]

    def pick(i: int, rest: Column) -> Column:
        out = None
        for when, score, reason in ladder:
            value = (F.lit(KEEP) if score is None else score.cast("double"), F.lit(score is not None), F.lit(reason))[i]
            out = F.when(when, value) if out is None else out.when(when, value)
        return out.otherwise(rest)

    return a.withColumn("score", pick(0, F.lit(KEEP))).withColumn("evictable", pick(1, F.lit(False))).withColumn("reason", pick(2, F.lit("kept")))


def plan_eviction(scores: DataFrame, target: int) -> DataFrame:
    """The items to drop: lowest scores first until `target` tokens are freed."""
    w = Window.partitionBy("session").orderBy("score", "index").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum("tokens_est").over(w), F.lit(0))
    return scores.filter("evictable").withColumn("freed_before", freed).filter(F.col("freed_before") < target)


def tokens_freed(plan: DataFrame) -> DataFrame:
    return plan.groupBy("session").agg(F.count("*").alias("drops"), F.sum("tokens_est").cast("long").alias("tokens_freed"))


def search_hint(preview: Column | str) -> Column:
    """The first five words with three letters or digits, or `item`."""
    w = F.filter(T.words(preview), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 3)
    return F.coalesce(F.nullif(F.array_join(F.slice(w, 1, 5), " "), F.lit("")), F.lit("item"))


def stub_for(kind: Column, tokens: Column, hint: Column) -> Column:
    return F.concat(F.lit("[ng-evicted: "), kind, F.lit(" ~"), tokens.cast("string"), F.lit("tok — recupere com: ng search "), hint, F.lit(" | id interno preservado no banco]"))


def ui_stub(content: Column) -> Column:
    """The stub of a single item that a user drops: its first 80 characters, an ellipsis if there are more, and how to get it back."""
    return F.concat(F.lit("[ng-evicted: "), F.substring(content, 1, UI_PREVIEW), F.when(F.length(content) > UI_PREVIEW, "…").otherwise(""), F.lit(" — recupere com `ng search`]"))


def native_stub_tokens(items: DataFrame) -> DataFrame:
    """Adds stub and the tokens it costs."""
    stub = stub_for(F.col("kind"), F.col("tokens_est"), search_hint("text_preview"))
    return items.withColumn("stub", stub).withColumn("stub_tokens", T.tokens_est("stub"))


def apply_plan(items: DataFrame, plan: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """raw_line, stub, tokens_est, stub_tokens, skipped of a plan's drops.

    An item whose line is unknown or has no message content is skipped, and counted.
    """
    drops = plan.select("session", "index")
    chosen = native_stub_tokens(items.join(drops, ["session", "index"], "left_semi"))
    lines = raw_lines.select("session", "raw_line", F.get_json_object("line", "$.message.content").alias("_content"))
    both = chosen.join(lines, ["session", "raw_line"], "left")
    return both.select("session", "index", "raw_line", "stub", "tokens_est", "stub_tokens", F.col("_content").isNull().alias("skipped"))


def applied(rows: DataFrame) -> DataFrame:
    """session, evicted, skipped, evicted_tokens, stub_tokens, gain."""
    ok = ~F.col("skipped")
    g = rows.groupBy("session").agg(
        F.count_if(ok).alias("evicted"), F.count_if(F.col("skipped")).alias("skipped"), F.coalesce(F.sum(F.when(ok, F.col("tokens_est"))), F.lit(0)).cast("long").alias("evicted_tokens"), F.coalesce(F.sum(F.when(ok, F.col("stub_tokens"))), F.lit(0)).cast("long").alias("stub_tokens")
    )
    return g.withColumn("gain", F.greatest(F.lit(0).cast("long"), F.col("evicted_tokens") - F.col("stub_tokens")))
