"""The memory model over the tables of a benchmark folder, in Spark and as DuckDB SQL.

Conversations are dialogue; the event stream gives sessions, tool output and
errors. The SQL texts say the same, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.events import dense_ids
from ..session import ship

HARNESSES = ("alpha", "beta", "gamma", "delta", "epsilon")
EVENT_COLUMNS = ["id", "session_id", "project", "harness", "kind", "content", "tags", "tokens_est", "created_at", "hidden_at", "note", "manual", "saved_digest", "saved_ref", "saved_by", "meta"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _soft(df: DataFrame) -> DataFrame:
    hidden = F.when(F.col("id") % 11 == 3, F.col("created_at") + 5)
    return (
        df.withColumn("tokens_est", T.tokens_est("content"))
        .withColumn("hidden_at", hidden.cast("long"))
        .withColumn("note", F.lit(None).cast("string"))
        .withColumn("manual", F.lit(False))
        .withColumn("saved_digest", F.lit(None).cast("string"))
        .withColumn("saved_ref", F.lit(None).cast("string"))
        .withColumn("saved_by", F.when(F.col("id") % 7 == 1, "zip"))
        .select(*EVENT_COLUMNS)
    )


def _harness(n):
    out = None
    for i, h in enumerate(HARNESSES):
        out = F.when(n % 5 == i, h) if out is None else out.when(n % 5 == i, h)
    return out


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dense_ids(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.floor(F.col("conv_id") / 1000))
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "assistant").otherwise("system")
    rows = c.select(
        "id",
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("/p/"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        _harness(F.col("conv_id")).alias("harness"),
        kind.alias("kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("topic"), (F.col("conv_id") % 9).cast("string"), F.lit(" "), F.col("role"), F.when(F.col("turn") == 0, " src/app/main.rs").otherwise("")).alias("tags"),
        (1700000000 + 60 * F.col("id")).alias("created_at"),
        F.lit(None).cast("string").alias("meta"),
    )
    return _soft(rows)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    k = F.regexp_extract("props", "([0-9]+)", 1)
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "purchase", "session_end").otherwise("tool_output")
    module = (F.col("user_id") % 20).cast("string")
    content = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("running build"), F.lit("\n"), F.lit("error[E0"), k, F.lit("1]: mismatched types in m"), module))
        .when(F.col("event_type") == "click", F.concat(F.lit("thread main panicked at m"), k, F.lit("\nnote: run again")))
        .when(F.col("event_type") == "view", F.concat(F.lit("ok m"), module, F.lit(" done in "), (F.col("event_id") % 97).cast("string"), F.lit(" steps")))
        .otherwise("")
    )
    rows = e.select(
        (F.col("n") + F.col("event_id") + 1).alias("id"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 5).cast("string")).alias("project"),
        _harness(F.col("user_id")).alias("harness"),
        kind.alias("kind"),
        content.alias("content"),
        F.concat(F.lit("m"), module, F.lit(" "), F.col("event_type")).alias("tags"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(
            kind == "tool_output",
            F.concat(F.lit('{"tool": "run", "file_path": "/src/m'), module, F.lit('.rs"}')),
        ).when(kind == "session_end", F.concat(F.lit('{"transcript_path": "/t/'), F.col("user_id").cast("string"), F.lit('.jsonl"}'))).alias("meta"),
    )
    return _soft(rows)


def mem_events(spark: SparkSession, sf_dir: str, part: str = "all") -> DataFrame:
    """The event log: "dialogue", "activity" or both."""
    if part == "dialogue":
        return dialogue(spark, sf_dir)
    if part == "activity":
        return activity(spark, sf_dir)
    return dialogue(spark, sf_dir).unionByName(activity(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "inject").when(F.col("event_type") == "purchase", "evict").when(F.col("event_type") == "signup", "clear").otherwise("unknown")
    return e.select(
        kind.alias("kind"), F.lit(None).cast("string").alias("saver"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 5).cast("string")).alias("project"), F.floor(F.col("value") * 100).cast("long").alias("tokens"), (F.col("event_id") % 5).alias("items"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
    )


def transcript_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as a session's items."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("index", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    m = F.col("doc_id") % 6
    role = F.when(m == 0, "user").when(m.isin(1, 2), "assistant").when(m == 3, "tool").when(m == 4, "other").otherwise("system")
    kind = F.when(m == 3, "tool_result").when(m == 4, "other").otherwise("text")
    return d.select(F.col("source").alias("session"), F.lit("alpha").alias("harness"), "index", role.alias("role"), kind.alias("kind"), T.preview("text").alias("text_preview"), F.col("text").alias("text_full"), T.tokens_est("text").alias("tokens_est"), F.lit(None).cast("long").alias("timestamp"), (F.col("index") + 1).cast("long").alias("raw_line"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), F.lit("given").alias("model"), F.col("embedding").alias("vec"))


def _case(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} % 5 = {i} THEN '{h}'" for i, h in enumerate(HARNESSES)) + " END"


EVENTS_SQL = f"""
    conv AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, * FROM conversations),
    act AS (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(user_id % 20 AS VARCHAR) AS m,
                   CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'session_end' ELSE 'tool_output' END AS knd FROM events),
    raw_ev AS (
        SELECT id, 'conv-' || conv_id AS session_id, '/p/' || (conv_id % 5) AS project, {_case('conv_id')} AS harness,
               CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS kind, text AS content,
               'topic' || (conv_id % 9) || ' ' || role || CASE WHEN turn = 0 THEN ' src/app/main.rs' ELSE '' END AS tags,
               CAST(1700000000 + 60 * id AS BIGINT) AS created_at, CAST(NULL AS VARCHAR) AS meta FROM conv
        UNION ALL
        SELECT (SELECT count(*) FROM conversations) + event_id + 1, 'u-' || user_id, '/p/' || (user_id % 5), {_case('user_id')}, knd,
               CASE event_type WHEN 'error' THEN 'running build' || chr(10) || 'error[E0' || k || '1]: mismatched types in m' || m
                    WHEN 'click' THEN 'thread main panicked at m' || k || chr(10) || 'note: run again'
                    WHEN 'view' THEN 'ok m' || m || ' done in ' || (event_id % 97) || ' steps' ELSE '' END,
               'm' || m || ' ' || event_type, CAST(floor(epoch(ts)) AS BIGINT),
               CASE knd WHEN 'tool_output' THEN '{{"tool": "run", "file_path": "/src/m' || m || '.rs"}}'
                    WHEN 'session_end' THEN '{{"transcript_path": "/t/' || user_id || '.jsonl"}}' END FROM act),
    mem_events AS (SELECT *, CAST(strlen(content) // 4 AS BIGINT) AS tokens_est, CASE WHEN id % 11 = 3 THEN created_at + 5 END AS hidden_at,
                          CAST(NULL AS VARCHAR) AS note, false AS manual, CASE WHEN id % 7 = 1 THEN 'zip' END AS saved_by FROM raw_ev)"""

LEDGER_SQL = """
    ledger AS (SELECT CASE event_type WHEN 'click' THEN 'inject' WHEN 'purchase' THEN 'evict' WHEN 'signup' THEN 'clear' ELSE 'unknown' END AS kind,
                      'u-' || user_id AS session_id, '/p/' || (user_id % 5) AS project, CAST(floor(value * 100) AS BIGINT) AS tokens, event_id % 5 AS items,
                      CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events)"""

ITEMS_SQL = """
    items AS (SELECT source AS session, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
                     CASE doc_id % 6 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' WHEN 4 THEN 'other' ELSE 'system' END AS role,
                     CASE doc_id % 6 WHEN 3 THEN 'tool_result' WHEN 4 THEN 'other' ELSE 'text' END AS kind,
                     substring(text, 1, 200) AS text_preview, CAST(strlen(text) // 4 AS BIGINT) AS tokens_est FROM documents)"""
