"""The event log: appending, scopes, statistics, soft state, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import INJECTED_KINDS, MARKER_KINDS


def dense_ids(df: DataFrame, order: list[str], block: Column, after: Column | int = 0, name: str = "id") -> DataFrame:
    """Numbers rows from after + 1 in the order of `order`, without one task ranking them all.

    block is an expression that grows with that order and that cuts the rows into
    parts of bounded size; only the parts' counts are ranked together.
    """
    cut = df.withColumn("_block", block)
    counts = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    start = F.lit(after) if isinstance(after, int) else after
    return cut.withColumn("_r", inside).join(before, "_block").withColumn(name, (F.col("_before") + F.col("_r") + start).cast("long")).drop("_block", "_r", "_before")


def prepare(events: DataFrame) -> DataFrame:
    """Incoming events as they are stored: capped content, its token estimate, empty soft state."""
    e = events.withColumn("content", T.cap_content("content"))
    if "tags" not in e.columns:
        e = e.withColumn("tags", T.extract_tags("content"))
    blank = {"hidden_at": "long", "note": "string", "manual": "boolean", "saved_digest": "string", "saved_ref": "string", "saved_by": "string", "meta": "string"}
    e = e.withColumn("tokens_est", T.tokens_est("content"))
    for c, kind in blank.items():
        if c not in e.columns:
            e = e.withColumn(c, F.lit(False if c == "manual" else None).cast(kind))
    return e


def corpus_size(events: DataFrame) -> Column:
    """The size that pruning goes by: the largest id, 0 when empty."""
    return F.coalesce(F.max("id"), F.lit(0)).cast("long")


# Scopes. A filter that isn't asked for is left out of the plan, so the rest is pushed down.


def in_project(df: DataFrame, project: str | None) -> DataFrame:
    return df if project is None else df.filter(F.col("project") == project)


def in_project_or_global(df: DataFrame, project: str | None) -> DataFrame:
    return df if project is None else df.filter(F.col("project").isin(project, ""))


def since(df: DataFrame, epoch: int | None) -> DataFrame:
    return df if epoch is None else df.filter(F.col("created_at") >= epoch)


def visible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("hidden_at").isNull())


def injectable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kind").isin(*INJECTED_KINDS))


def without_markers(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("kind").isin(*MARKER_KINDS))


def without_session(df: DataFrame, session_id: str) -> DataFrame:
    return df.filter(F.col("session_id") != session_id)


def after_cursor(df: DataFrame, cursor: int, limit: int) -> DataFrame:
    return df.filter(F.col("id") > cursor).orderBy("id").limit(limit)


def at_least_chars(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.length("content") >= n)


def scope_of(scope: str | None, name: str | None) -> str | None:
    """The project to filter by: that named, if the scope is "project" and the name not blank."""
    return name if scope == "project" and name and name.strip() else None


def memory_rows(df: DataFrame) -> DataFrame:
    """The columns that listings show."""
    return df.select("id", "session_id", "project", "harness", "kind", "content", "tags", "created_at", F.col("hidden_at").isNotNull().alias("hidden"), "note", "manual")


# Statistics.


def stats(events: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("session_id") if approximate else F.count_distinct("session_id")
    return events.agg(F.count("*").alias("events"), distinct.alias("sessions"), F.coalesce(F.sum("tokens_est"), F.lit(0)).cast("long").alias("tokens"))


def stats_scoped(events: DataFrame, project: str | None = None, from_epoch: int | None = None) -> DataFrame:
    return since(in_project(events, project), from_epoch).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum("tokens_est"), F.lit(0)).cast("long").alias("tokens"), F.min("created_at").alias("first_at")
    )


def gain_summary(ledger: DataFrame, project: str | None = None, from_epoch: int | None = None) -> DataFrame:
    g = since(in_project(ledger, project), from_epoch).groupBy("kind")
    return g.agg(F.count("*").alias("n"), F.sum("items").cast("long").alias("items"), F.sum("tokens").cast("long").alias("tokens")).orderBy("kind")


def gain_report(summary: DataFrame) -> DataFrame:
    """Injections are a cost, evictions and clears savings; other kinds are not counted."""

    def total(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("tokens"))), F.lit(0)).cast("long")

    def count(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0)).cast("long")

    return summary.agg(count("inject").alias("injections"), total("inject").alias("injected_tokens"), count("evict", "clear").alias("cleanups"), total("evict", "clear").alias("saved_tokens"))


def daily_gain(ledger: DataFrame, watermark: str | None = None) -> DataFrame:
    """An extension: tumbling days of the ledger; with a watermark also on a stream."""
    ts = ledger.withColumn("ts", F.timestamp_seconds("created_at"))
    if watermark:
        ts = ts.withWatermark("ts", watermark)
    return ts.groupBy(F.window("ts", "1 day").alias("day"), "kind").agg(F.sum("tokens").cast("long").alias("tokens")).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "kind", "tokens")


def _stamped(ledger: DataFrame, watermark: str | None) -> DataFrame:
    ts = ledger.withColumn("ts", F.timestamp_seconds("created_at"))
    return ts.withWatermark("ts", watermark) if watermark else ts


def sliding_gain(ledger: DataFrame, size: str = "1 hour", slide: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """An extension: start, kind, n, tokens of overlapping windows. On a stream rows later than the watermark are left out."""
    g = _stamped(ledger, watermark).groupBy(F.window("ts", size, slide).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "kind", "n", "tokens")


def session_gain(ledger: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """An extension: session_id, start, last, n, tokens of each run of a session's rows without a pause as long as the gap."""
    g = _stamped(ledger, watermark).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.max("created_at").alias("last"), F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    return g.select("session_id", F.unix_timestamp("w.start").alias("start"), "last", "n", "tokens")


def once_each(stream: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """Of rows of a stream that come again within the watermark the first; created_at says when a row is from."""
    return _stamped(stream, watermark).dropDuplicatesWithinWatermark(keys)


# Soft state: an append-only log of operations, folded when read.


def fold_state(ops: DataFrame) -> DataFrame:
    """What a run of ops (seq, id, op, arg, ts, tags) leaves of each id: one row, whatever their number.

    un is the last unhide, hid the first hide after it, note and edit the last ones; each with its seq.
    """
    unhidden = F.max(F.when(F.col("op") == "unhide", F.col("seq"))).over(Window.partitionBy("id"))
    o = ops.withColumn("_un", F.coalesce(unhidden, F.lit(-1)))

    def last(op: str, *fields: Column) -> Column:
        return F.max(F.when(F.col("op") == op, F.struct("seq", *fields)))

    return o.groupBy("id").agg(
        F.max("_un").alias("un"),
        F.min(F.when((F.col("op") == "hide") & (F.col("seq") > F.col("_un")), F.struct("seq", "ts"))).alias("hid"),
        last("annotate", F.coalesce("arg", F.lit("")).alias("arg")).alias("note"),
        last("edit", F.col("arg"), F.col("tags")).alias("edit"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of consecutive runs of one log, in any order, as the state of the whole log: what a snapshot is compacted by."""
    un = F.max("un").over(Window.partitionBy("id"))
    s = states.withColumn("_un", un)
    live = F.when(F.col("hid.seq") > F.col("_un"), F.col("hid"))
    return s.groupBy("id").agg(F.max("_un").alias("un"), F.min(live).alias("hid"), F.max("note").alias("note"), F.max("edit").alias("edit"))


def apply_state(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events with hidden_at, note, content, tags and token estimate as the log behind the states leaves them."""
    e = events.join(states.select("id", *(F.col(c).alias(f"_{c}") for c in ("un", "hid", "note", "edit"))), "id", "left")
    hidden = F.when(F.col("_un") >= 0, F.col("_hid.ts")).otherwise(F.coalesce("hidden_at", "_hid.ts"))
    edited = F.col("manual") & F.col("_edit.arg").isNotNull()
    e = e.withColumn("hidden_at", F.when(F.col("_un").isNull(), F.col("hidden_at")).otherwise(hidden))
    e = e.withColumn("note", F.when(F.col("_note").isNull(), F.col("note")).otherwise(F.nullif(F.trim("_note.arg"), F.lit(""))))
    e = e.withColumn("tags", F.when(edited & F.col("_edit.tags").isNotNull(), F.col("_edit.tags")).otherwise(F.col("tags")))
    e = e.withColumn("content", F.when(edited, F.col("_edit.arg")).otherwise(F.col("content"))).withColumn("tokens_est", F.when(edited, T.tokens_est("content")).otherwise(F.col("tokens_est")))
    return e.drop("_un", "_hid", "_note", "_edit")


def fold_ops(events: DataFrame, ops: DataFrame) -> DataFrame:
    """Events as the log of ops leaves them.

    hide keeps the first stamp while hidden, unhide clears it; the last annotate
    wins and a blank one clears; edits, of manual rows only, take the last.
    """
    return apply_state(events, fold_state(ops))


def manual_memory(rows: DataFrame) -> DataFrame:
    """Rows project, content, tags, created_at as manual events. They are searched, but never injected or embedded."""
    return prepare(rows.select(F.lit("manual").alias("session_id"), "project", F.lit("manual").alias("harness"), F.lit("manual").alias("kind"), "content", "tags", "created_at", F.lit(True).alias("manual")))


def list_memories(events: DataFrame, project: str | None = None, include_hidden: bool = False, limit: int = 100) -> DataFrame:
    e = in_project(without_markers(events), project)
    e = e if include_hidden else visible(e)
    return memory_rows(e.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit))


def list_sessions(events: DataFrame, limit: int = 100) -> DataFrame:
    s = events.groupBy("session_id").agg(F.max("created_at").alias("last_at"), F.count("*").alias("n"), F.max_by("project", "id").alias("project"))
    return s.orderBy(F.col("last_at").desc(), "session_id").limit(limit)


def health(events: DataFrame, embeddings: DataFrame, model: str, backlog_cap: int = 1000) -> DataFrame:
    """Data-quality figures: rows, bad rows, repeated ids, and the embedding backlog up to a cap."""
    from .vectors import backlog

    waiting = backlog(events, embeddings, model).limit(backlog_cap).agg(F.count("*").alias("backlog"))
    base = events.agg(
        F.count("*").alias("rows"),
        (F.count("id") - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.col("content").isNull() | F.col("kind").isNull()).alias("broken"),
        F.coalesce(F.max(F.octet_length("content")), F.lit(0)).cast("long").alias("largest"),
    )
    return base.crossJoin(waiting)  # one row and one row


# Transcript imports.


def pending_imports(events: DataFrame, cursor: int, limit: int = 8) -> DataFrame:
    """Session ends after the cursor whose meta names a transcript: id, session_id, project, harness, transcript_path."""
    rows = after_cursor(events.filter((F.col("kind") == "session_end") & F.col("meta").isNotNull()), cursor, limit)
    path = F.get_json_object("meta", "$.transcript_path")
    return rows.select("id", "session_id", "project", "harness", path.alias("transcript_path")).filter("transcript_path IS NOT NULL")


def next_cursor(events: DataFrame, cursor: int, limit: int = 8) -> DataFrame:
    """The cursor after a scan: it passes rows that could not be used, too."""
    rows = after_cursor(events.filter((F.col("kind") == "session_end") & F.col("meta").isNotNull()), cursor, limit)
    return rows.agg(F.coalesce(F.max("id"), F.lit(cursor)).cast("long").alias("cursor"))


def import_items(items: DataFrame, imported: DataFrame, project: str = "") -> DataFrame:
    """A session's assistant texts beyond those imported before, as events.

    items: session, role, kind, index, text_full, timestamp. imported: session, n.
    """
    said = items.filter((F.col("role") == "assistant") & (F.col("kind") == "text"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("index"))
    new = said.withColumn("_n", n).join(imported.select("session", F.col("n").alias("_had")), "session", "left").filter(F.col("_n") > F.coalesce("_had", F.lit(0)))
    return new.select(F.col("session").alias("session_id"), F.lit(project).alias("project"), "harness", F.lit("assistant").alias("kind"), F.col("text_full").alias("content"), F.coalesce("timestamp", F.lit(0)).alias("created_at"))


def import_mapping(items: DataFrame) -> DataFrame:
    """Any item as an event: the kind by its role, no tags where it is mostly code."""
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "assistant").when(F.col("role") == "tool", "tool_output").when(F.col("role") == "system", "system").otherwise("other")
    tags = F.when(T.is_mostly_code("text_full"), F.lit("")).otherwise(T.extract_tags("text_full"))
    return items.select(F.col("session").alias("session_id"), F.lit("").alias("project"), "harness", kind.alias("kind"), T.cap_content("text_full").alias("content"), tags.alias("tags"), F.coalesce("timestamp", F.lit(0)).alias("created_at"))
