"""Transcript clean-up from file to ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hygiene
from ..sources.rewrite import replace_text, rewrite_jsonl


def plan(items: DataFrame, raw_lines: DataFrame, target: int = hygiene.PRECOMPACT_TARGET) -> tuple[DataFrame, DataFrame]:
    """(rows to replace, what that gains)."""
    rows = hygiene.apply_plan(items, hygiene.plan_eviction(hygiene.score_items(items), target), raw_lines)
    return rows, hygiene.applied(rows)


def ledger_rows(gains: DataFrame, kind: str, project: str, now: int) -> DataFrame:
    return gains.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("saver"), F.col("session").alias("session_id"), F.lit(project).alias("project"), F.col("gain").alias("tokens"), F.col("evicted").alias("items"), F.lit(now).cast("long").alias("created_at"))


def rewrite(rows: DataFrame, path: str, dry_run: bool = False) -> int:
    """Puts one session's stubs into its file; returns how many lines. A dry run only counts."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    new = []
    for r in rows.filter("NOT skipped").select("raw_line", "stub").toLocalIterator():
        line = replace_text(lines[r["raw_line"] - 1], "claude-code", r["stub"])
        if line is not None:
            new.append((r["raw_line"], line))
    if new and not dry_run:
        rewrite_jsonl(path, [], new)
    return len(new)


def precompact(items: DataFrame, raw_lines: DataFrame, path: str, project: str, now: int, enabled: bool) -> DataFrame | None:
    """The job before a harness compacts a session; only where it is turned on."""
    if not enabled:
        return None
    rows, gains = plan(items, raw_lines)
    out = ledger_rows(gains, "evict", project, now)
    rewrite(rows, path)
    return out
