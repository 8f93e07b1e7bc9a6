"""Hook payloads and socket lines as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Keys that hold a path or a response's text, in order of preference, and marks of own output.
PATH_KEYS = ("file_path", "path", "notebook_path")
TEXT_KEYS = ("output", "stdout", "content", "result", "text")
OWN_MARKS = ("[ng-evicted:", "<memory-lake-context>")
OWN_BINARY = "ng"
LINE_CAP = 16 << 20


def _kind_at(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string_at(v: Column, path: str) -> Column:
    """A string at a JSON path; null if something else is there."""
    return F.when(_kind_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def json_at(v: Column, path: str) -> Column:
    """Compact JSON, keys in order, of whatever is at a path."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def file_path(v: Column, base: str = "$") -> Column:
    """The first of the path keys whose string has a slash."""
    found = [string_at(v, f"{base}.{k}") for k in PATH_KEYS]
    return F.coalesce(*(F.when(x.contains("/"), x) for x in found))


def is_own_command(command: Column) -> Column:
    """Whether a part of the command line runs the memory's own tool."""
    return F.exists(F.split(F.coalesce(command, F.lit("")), r"[;|&]"), lambda s: F.substring_index(F.get(F.filter(F.split(s, r"\s+"), lambda w: w != ""), F.lit(0)), "/", -1) == OWN_BINARY)


def has_own_marks(output: Column) -> Column:
    out = F.lit(False)
    for m in OWN_MARKS:
        out = out | output.contains(m)
    return out


def compact_value(v: Column, base: str) -> Column:
    """A response's text: that of the first text key, the value itself if a string, else its JSON."""
    return F.coalesce(*(string_at(v, f"{base}.{k}") for k in TEXT_KEYS), string_at(v, base), json_at(v, base), F.lit(""))


def parse_hooks(payloads: DataFrame, harness: str = "claude-code", now: Column | None = None) -> DataFrame:
    """payload (a JSON string) -> incoming events. Payloads that mean nothing, or are broken, give no row."""
    v = F.try_parse_json("payload")
    p = payloads.withColumn("_v", v)
    v = F.col("_v")
    hook = string_at(v, "$.hook_event_name")
    tool = F.coalesce(string_at(v, "$.tool_name"), F.lit("?"))
    response = compact_value(v, "$.tool_response")
    given = F.coalesce(json_at(v, "$.tool_input"), F.lit(""))
    own = is_own_command(string_at(v, "$.tool_input.command")) | has_own_marks(response)
    kind = (
        F.when(hook == "UserPromptSubmit", F.when(string_at(v, "$.prompt").isNotNull(), "prompt"))
        .when(hook == "PostToolUse", F.when(own, "ng_meta").otherwise("tool_output"))
        .when(hook == "SessionStart", "session_start")
        .when(hook.isin("Stop", "SessionEnd"), "session_end")
        .when(hook == "PreCompact", "precompact")
    )
    content = F.when(hook == "UserPromptSubmit", string_at(v, "$.prompt")).when(hook == "PostToolUse", F.concat(F.lit("["), tool, F.lit("] input: "), given, F.lit("\noutput: "), response)).otherwise("")
    path, transcript = file_path(v, "$.tool_input"), string_at(v, "$.transcript_path")
    meta = F.when(hook == "PostToolUse", F.to_json(F.struct(path.alias("file_path"), tool.alias("tool")))).when(hook.isin("Stop", "SessionEnd") & transcript.isNotNull(), F.to_json(F.struct(transcript.alias("transcript_path"))))
    rows = p.select(
        F.coalesce(string_at(v, "$.session_id"), F.lit("unknown")).alias("session_id"),
        F.coalesce(string_at(v, "$.cwd"), F.lit("")).alias("project"),
        F.lit(harness).alias("harness"),
        kind.alias("kind"),
        content.alias("content"),
        meta.alias("meta"),
        (now if now is not None else F.unix_timestamp()).alias("created_at"),
    ).filter("kind IS NOT NULL")
    return rows.withColumn("tags", T.extract_tags("content")).withColumn("content", T.cap_content("content"))


_GAIN = "kind string, session_id string, project string, tokens long, items long, created_at long, saver string"
_EVENT = "session_id string, project string, harness string, kind string, content string, tags string, created_at long, meta string"


def decode_lines(lines: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """value (a line) -> gain (struct), event (struct), rejected. A ledger envelope is tried first, then an event.

    Lines over the cap are rejected with what they are, like broken ones.
    """
    ok = F.octet_length("value") <= cap
    gain = F.from_json(F.when(ok & (F.get_json_object("value", "$.ng_gain").isNotNull()), F.get_json_object("value", "$.ng_gain")), _GAIN)
    event = F.from_json(F.when(ok, F.col("value")), _EVENT)
    rows = lines.filter(F.trim("value") != "").select("value", gain.alias("gain"), event.alias("event"))
    is_gain = F.col("gain.kind").isNotNull()
    is_event = ~is_gain & F.col("event.kind").isNotNull() & F.col("event.content").isNotNull()
    return rows.select("value", F.when(is_gain, F.col("gain")).alias("gain"), F.when(is_event, F.col("event")).alias("event"), (~F.coalesce(is_gain, F.lit(False)) & ~F.coalesce(is_event, F.lit(False))).alias("rejected"))
