"""Session transcripts of five formats, as one table of items.

Files are read whole by Spark's text reader and split into lines or documents;
JSON is parsed on the executors, in Arrow batches, as block lists nest freely
and numbers must be printed as they were. A line that isn't JSON is counted, not
an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import dates, text as T
from ..schema import ITEMS

# Record types that carry no conversation, and where each format keeps its files.
TELEMETRY = (
    "metadata config.update llm.request llm.tools_snapshot usage.record goal.update goal.create goal.clear tools.update_store "
    "tools.set_active_tools permission.set_mode permission.record_approval_result plan_mode.enter plan_mode.cancel turn.steer turn.cancel step.begin step.end"
).split()
PLACES = {
    "claude-code": (".claude/projects", "*.jsonl"),
    "codex": (".codex/sessions", "rollout-*.jsonl"),
    "gemini": (".gemini/tmp", "*.json"),
    "opencode": (".local/share/opencode/storage/session", "*.json"),
    "kimi": (".kimi/sessions", "wire.jsonl"),
}
ROLES = {"user", "assistant", "system", "tool"}
MODEL_LINES, MODEL_BYTES, MODEL_FILES = 64, 1 << 20, 8


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _get(value, *path):
    for p in path:
        value = value.get(p) if isinstance(value, dict) else None
    return value


def _string(value, *path) -> str | None:
    got = _get(value, *path)
    return got if isinstance(got, str) else None


def content_text(content) -> tuple[str, str]:
    """(text, kind) of a string or a list of blocks: the kind of its blocks if all are of one, else `mixed`."""
    if isinstance(content, str):
        return content, "text"
    if not isinstance(content, list):
        return "", "other"
    pieces, kinds = [], []
    for block in content:
        kind = _string(block, "type") or "other"
        piece = None
        if kind in ("text", "input_text", "output_text"):
            kind, piece = "text", _string(block, "text")
        elif kind in ("tool_use", "function_call"):
            kind, piece = "tool_use", f"[tool_use: {_string(block, 'name') or '?'}]"
        elif kind in ("tool_result", "function_call_output"):
            kind = "tool_result"
            inner = block.get("content", block)
            piece = content_text(inner)[0] or _string(block, "output")
        kinds.append(kind)
        if piece is not None:
            # A piece after nothing but empty ones begins the text.
            pieces = [piece] if not "".join(pieces) else [*pieces, piece]
    return "\n".join(pieces), (kinds[0] if len(set(kinds)) == 1 else "mixed") if kinds else "other"


def _role(role: str | None, more: dict[str, str] | None = None) -> str:
    return (more or {}).get(role, role if role in ROLES else "other")


def _claude(v) -> tuple | None:
    content = _get(v, "message", "content")
    text, kind = content_text(content) if content is not None else ("", "other")
    return _role(_string(v, "message", "role") or _string(v, "type"), {"summary": "system"}), kind, text, v


def _codex(v) -> tuple | None:
    p = _get(v, "payload")
    kind = _string(p, "type") or "other"
    if kind == "message":
        text, shape = content_text(p["content"]) if "content" in p else ("", "")
        return _string(p, "role") or "other", shape, text, v
    if kind == "function_call":
        return "tool", kind, f"[{_string(p, 'name') or '?'}] {_string(p, 'arguments') or ''}", v
    if kind == "function_call_output":
        output = _string(p, "output")
        return "tool", kind, output if output is not None else content_text(p.get("content"))[0], v
    return "other", "other", "", v


def _gemini(v) -> tuple | None:
    texts, kind = [], "other"
    parts = _get(v, "parts")
    for part in parts if isinstance(parts, list) else []:
        said = _string(part, "text")
        if said is not None:
            texts, kind = ([said] if not "".join(texts) else [*texts, said]), "text"
        elif _get(part, "functionCall") is not None or isinstance(part, dict) and "functionCall" in part:
            kind = "tool_use"
        elif isinstance(part, dict) and "functionResponse" in part:
            kind = "tool_result"
    role = _string(v, "role")
    return {"user": "user", "model": "assistant", "assistant": "assistant", "system": "system"}.get(role, "other"), kind, "\n".join(texts), v


def _opencode(v) -> tuple | None:
    text, kind = content_text(v["content"]) if isinstance(v, dict) and "content" in v else ("", "other")
    return _role(_string(v, "role")), kind, text, v


def _kimi(v) -> tuple | None:
    kind = _string(v, "type") or ""
    if kind in TELEMETRY:
        return None
    if kind == "context.append_loop_event":
        v = _get(v, "event")
        if v is None:
            return None
        kind = _string(v, "type") or ""
        if kind in TELEMETRY:
            return None
    if kind == "turn.prompt":
        return "user", "prompt", content_text(_get(v, "input"))[0], v
    if kind == "context.append_message":
        message = _get(v, "message")
        if message is None:
            return None
        text, shape = content_text(message["content"]) if isinstance(message, dict) and "content" in message else ("", "")
        return _role(_string(message, "role")), shape, text, v
    if kind == "content.part":
        part = _get(v, "part")
        if part is None:
            return None
        shape = _string(part, "type") or "text"
        said = _get(part, "text") if _get(part, "text") is not None else _get(part, "think")
        return "assistant", "thinking" if shape == "think" else shape, said if isinstance(said, str) else "", v
    if kind == "tool.call":
        given = _compact(v["input"])[:200] if "input" in v else ""
        return "assistant", "tool_use", f"[tool_use: {_string(v, 'name') or '?'}] {given}", v
    if kind == "tool.result":
        output = _string(v, "result", "output")
        return "tool", "tool_result", output if output is not None else _compact(v["result"]) if "result" in v else "", v
    text, shape = content_text(v["content"]) if isinstance(v, dict) and "content" in v else ("", "other")
    role = _string(v, "role")
    return _role(role if role is not None else kind), shape, text, v


#: How a record of each format becomes role, kind, text and what stands for an empty text.
RECORDS: dict[str, Callable] = {"claude-code": _claude, "codex": _codex, "gemini": _gemini, "opencode": _opencode, "kimi": _kimi}

_PARSED = "ok boolean, role string, kind string, text string, stamp string, time_ms long"


def _parser(harness: str):
    record = RECORDS[harness]

    @F.pandas_udf(_PARSED)
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in parts:
            rows = []
            for line in lines:
                try:
                    v = json.loads(line)
                except ValueError:
                    rows.append((False, None, None, None, None, None))
                    continue
                got = record(v)
                if got is None:
                    rows.append((True, None, None, None, None, None))
                    continue
                role, kind, text, inner = got
                time = _get(v, "time")
                rows.append((True, role, kind, text or _compact(inner), _string(v, "timestamp"), time if type(time) is int else None))
            yield pd.DataFrame(rows, columns=["ok", "role", "kind", "text", "stamp", "time_ms"])

    return parse


def split_lines(value):
    """Lines without a last empty one; a carriage return stays in its line."""
    return F.split(F.regexp_replace(value, "\n$", ""), "\n")


def whole_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, value: one row a file."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def session_name(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def records(files: DataFrame, harness: str) -> DataFrame:
    """session, path, raw_line, record of whole files: lines of JSONL, entries of a document, or one file each."""
    f = files.withColumn("session", session_name("path"))
    if harness == "gemini":
        entries = _entries(F.col("value"))
        return f.select("session", "path", F.posexplode(entries).alias("n", "record")).select("session", "path", F.lit(None).cast("long").alias("raw_line"), "n", "record")
    if harness == "opencode":
        n = F.row_number().over(Window.partitionBy("session").orderBy("path")) - 1
        f = f.withColumn("session", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
        return f.select("session", "path", F.lit(None).cast("long").alias("raw_line"), n.alias("n"), F.col("value").alias("record"))
    rows = f.select("session", "path", F.posexplode(split_lines("value")).alias("n", "record"))
    return rows.filter(F.trim("record") != "").select("session", "path", (F.col("n") + 1).cast("long").alias("raw_line"), "n", "record")


@F.pandas_udf(ArrayType(StringType()))
def _entries(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A document's history or messages; a broken document is one broken entry."""
    for s in parts:
        out = []
        for text in s:
            try:
                v = json.loads(text)
            except ValueError:
                out.append([text])
                continue
            found = _get(v, "history") if _get(v, "history") is not None else _get(v, "messages")
            out.append([_compact(x) for x in found] if isinstance(found, list) else [])
        yield pd.Series(out)


def parse(files: DataFrame, harness: str) -> tuple[DataFrame, DataFrame]:
    """(items, skipped): items by the common schema; skipped: session, skipped.

    index counts a session's items from 0, raw_line its physical lines from 1.
    """
    if harness not in RECORDS:
        raise ValueError(f"unknown harness {harness}")
    rows = records(files, harness).withColumn("p", _parser(harness)("record"))
    skipped = rows.groupBy("session").agg(F.count_if(~F.col("p.ok")).alias("skipped"))
    kept = rows.filter("p.ok AND p.role IS NOT NULL")
    index = F.row_number().over(Window.partitionBy("session").orderBy("n")) - 1
    items = kept.select(
        "session", F.lit(harness).alias("harness"), "path", index.cast("long").alias("index"), "p.role", "p.kind", T.preview("p.text").alias("text_preview"),
        F.col("p.text").alias("text_full"), T.tokens_est("p.text").alias("tokens_est"), _stamp(harness).alias("timestamp"), "raw_line",
    )
    return items.to(spark_schema(items.sparkSession)), skipped


def parse_lines(lines: DataFrame, harness: str) -> DataFrame:
    """Items of a stream (or table) of lines of JSONL transcripts, path, line and value, but for their index: lines come one by one."""
    rows = lines.filter(F.trim("value") != "").withColumn("p", _parser(harness)("value")).filter("p.ok AND p.role IS NOT NULL")
    return rows.select(session_name("path").alias("session"), F.lit(harness).alias("harness"), "path", "p.role", "p.kind", T.preview("p.text").alias("text_preview"), F.col("p.text").alias("text_full"), T.tokens_est("p.text").alias("tokens_est"), _stamp(harness).alias("timestamp"), F.col("line").alias("raw_line"))


def _stamp(harness: str):
    stamp = F.floor(F.col("p.time_ms") / 1000) if harness == "kimi" else dates.rfc3339_epoch("p.stamp") if harness in ("claude-code", "codex") else F.lit(None)
    return stamp.cast("long")


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], ITEMS).schema


def discover(spark: SparkSession, home: str, harness: str) -> DataFrame:
    """harness, session, path, bytes, modified, items_hint of a format's files; none if the folder isn't there."""
    place, glob = PLACES[harness]
    empty = "path string, modificationTime timestamp, length long"
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(f"{home.rstrip('/')}/{place}").drop("content")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], empty)
    return found.select(F.lit(harness).alias("harness"), session_name("path").alias("session"), "path", F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("modified"), size_hint("length").alias("items_hint"))


def size_hint(length):
    return F.greatest(F.lit(1), F.floor(T.col(length) / 200)).cast("long")


def discover_sessions(spark: SparkSession, home: str) -> DataFrame:
    """All formats' files, the newest first."""
    found = None
    for harness in PLACES:
        d = discover(spark, home, harness)
        found = d if found is None else found.unionByName(d)
    return found.orderBy(F.col("modified").desc(), "path")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "modified").alias("path"))


def load(spark: SparkSession, harness: str, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """parse() of files named by path."""
    if harness not in RECORDS:
        raise ValueError(f"unknown harness {harness}")
    return parse(whole_files(spark, path, recursive=harness == "opencode"), harness)


def detect_model(files: DataFrame, harness: str) -> DataFrame:
    """session, model: the first that the first lines (or files) name; formats that don't record it have none."""
    paths = {"claude-code": ["$.message.model"], "codex": ["$.payload.model"], "kimi": ["$.modelAlias", "$.model"], "opencode": ["$.modelID"]}.get(harness)
    rows = records(files, harness)
    if not paths:
        return rows.select("session", F.lit(None).cast("string").alias("model")).distinct()
    if harness == "opencode":
        head = rows.filter(F.col("n") < MODEL_FILES)
    else:
        w = Window.partitionBy("session").orderBy("n")
        head = rows.withColumn("_b", F.sum(F.octet_length("record") + 1).over(w)).filter((F.col("raw_line") <= MODEL_LINES) & (F.col("_b") <= MODEL_BYTES))
    v = F.try_parse_json("record")
    named = head.withColumn("model", F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths)))
    return named.groupBy("session").agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("n"))).alias("model"))


def grown(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose time or size is not as in state: path, modified, bytes, imported (0 for new ones).

    files: path, modified, bytes. state: path, modified, bytes, imported.
    """
    old = state.select("path", F.col("modified").alias("_m"), F.col("bytes").alias("_b"), "imported")
    changed = F.col("_m").isNull() | (F.col("_m") != F.col("modified")) | (F.col("_b") != F.col("bytes"))
    return files.join(old, "path", "left").filter(changed).select("path", "modified", "bytes", F.coalesce("imported", F.lit(0)).cast("long").alias("imported"))


def new_items(items: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items beyond those imported, new state). Where a file shrank, the count is that of the items there are."""
    n = items.groupBy("path").agg(F.count("*").alias("n"))
    state = changed.join(n, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fresh = items.join(state.select("path", F.least("imported", "n").alias("_from")), "path").filter(F.col("index") >= F.col("_from")).drop("_from")
    return fresh, state.select("path", "modified", "bytes", F.col("n").alias("imported"))
