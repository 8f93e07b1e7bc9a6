"""Text sinks and seeders."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.graph import SECTIONS, export_markdown

MARK = "<!-- written by memlake -->"


def graph_markdown(entities: DataFrame, edges: DataFrame, project: str | None = None) -> str:
    """The export as one text: a section a kind, the heaviest first, each with its three heaviest edges."""
    rows = export_markdown(entities, edges, project).orderBy("section_no", F.col("weight").desc(), "key").select("section_no", "line").toLocalIterator()
    out, last = ["# Memory graph", ""], None
    for r in rows:
        if r["section_no"] != last:
            last = r["section_no"]
            out += ["", f"## {SECTIONS[last][1]}", ""]
        out.append(r["line"])
    return "\n".join(out) + "\n"


def context_markdown(memories: DataFrame, title: str) -> str:
    lines = memories.select(F.concat(F.lit("- ["), dates.fmt_date("created_at"), F.lit("] "), F.replace("content", F.lit("\n"), F.lit(" "))).alias("line")).toLocalIterator()
    return "\n".join([MARK, f"# {title}", "", *(r["line"] for r in lines)]) + "\n"


def write_guarded(path: str, text: str, force: bool = False) -> bool:
    """Writes unless a file is there that this library didn't write."""
    if os.path.exists(path) and not force:
        with open(path, encoding="utf-8") as f:
            if not f.read(len(MARK)).startswith(MARK):
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)
    return True


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def hook_response(context: str) -> str:
    return json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": context}}, ensure_ascii=False)


def seed_events(spark: SparkSession, n: int, sessions: int = 32, rare_every: int = 500) -> DataFrame:
    """Deterministic events for load tests: five common texts, and a rare one now and then."""
    k = F.col("id") % 5
    common = F.when(k == 0, "refactor of the parser module number ").when(k == 1, "build finished, target cache warm ").when(k == 2, "review of storage layout, item ").when(k == 3, "test run over the suite, case ").otherwise("notes on the deploy window ")
    content = F.when(F.col("id") % rare_every == 0, F.concat(F.lit("zephyrquartz incident "), F.col("id").cast("string"))).otherwise(F.concat(common, F.col("id").cast("string")))
    kind = F.when(F.col("id") % 3 == 0, "prompt").when(F.col("id") % 3 == 1, "assistant").otherwise("tool_output")
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("sess-"), (F.col("id") % sessions).cast("string")).alias("session_id"), F.lit("/p/load").alias("project"), F.lit("alpha").alias("harness"),
        kind.alias("kind"), content.alias("content"), F.lit("load").alias("tags"), (1_700_000_000 + F.col("id") * 60).alias("created_at"), F.lit(None).cast("string").alias("meta"),
    )
