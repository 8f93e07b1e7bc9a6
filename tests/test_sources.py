import json

import pytest
from pyspark.sql import functions as F

from memlake.operators import events as ev
from memlake.operators import graph, hygiene
from memlake.plans import cleanup
from memlake.sources import hooks, sinks
from memlake.sources import transcripts as tr
from memlake.streaming import ingest


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return f"file://{path}"


def rows(items):
    return [(r["index"], r["role"], r["kind"], r["text_full"], r["raw_line"]) for r in items.orderBy("session", "index").collect()]


def test_claude(spark, tmp_path):
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "Read"}]
    p = put(
        tmp_path / "s1.jsonl",
        {"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "2026-07-18T10:00:00Z"},
        "", "{broken",
        {"type": "assistant", "message": {"role": "assistant", "content": blocks, "model": "m-1"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "out"}]}]}},
        {"type": "summary", "summary": "s"}, {"type": "odd", "b": 1, "a": "é"},
    )
    items, skipped = tr.load(spark, "claude-code", p)
    got = rows(items)
    assert got[0][:4] == (0, "user", "text", "hi") and got[0][4] == 1 and items.filter("index = 0").first().timestamp == 1784368800
    assert got[1] == (1, "assistant", "mixed", "a\n[tool_use: Read]", 4)
    assert got[2][1:4] == ("user", "tool_result", "out")
    assert got[3][1:3] == ("system", "other") and got[4][1:4] == ("other", "other", '{"a":"é","b":1,"type":"odd"}')
    assert skipped.first().skipped == 1
    assert tr.detect_model(tr.whole_files(spark, p), "claude-code").first().model == "m-1"


def test_codex_gemini_opencode_kimi(spark, tmp_path):
    p = put(tmp_path / "rollout-1.jsonl", {"payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"payload": {"type": "function_call", "name": "sh", "arguments": "{}"}}, {"payload": {"type": "function_call_output", "output": "o"}}, {"type": "x"}, "nope")
    items, skipped = tr.load(spark, "codex", p)
    assert [r[1:4] for r in rows(items)] == [("user", "text", "q"), ("tool", "function_call", "[sh] {}"), ("tool", "function_call_output", "o"), ("other", "other", '{"type":"x"}')] and skipped.first().skipped == 1
    p = put(tmp_path / "g.json", {"history": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}, {"role": "model", "parts": [{"functionCall": {}}]}, {"parts": []}]})
    items, _ = tr.load(spark, "gemini", p)
    assert [r[1:3] for r in rows(items)] == [("user", "text"), ("assistant", "tool_use"), ("other", "other")] and rows(items)[0][3:] == ("a\nb", None)
    items, skipped = tr.load(spark, "gemini", put(tmp_path / "bad.json", "{"))
    assert items.count() == 0 and skipped.first().skipped == 1
    for i, m in enumerate(({"role": "user", "content": "x", "modelID": "gpt"}, "{", {"role": "assistant", "content": [{"type": "text", "text": "y"}]})):
        put(tmp_path / "message" / "ses1" / f"msg_{i}.json", m)
    items, skipped = tr.load(spark, "opencode", f"file://{tmp_path}/message/ses1")
    assert [r[1:4] for r in rows(items)] == [("user", "text", "x"), ("assistant", "text", "y")] and skipped.first().skipped == 1
    p = put(
        tmp_path / "wire.jsonl", {"type": "metadata"}, {"type": "turn.prompt", "input": "go", "time": 5000}, {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "think", "think": "hm"}}},
        {"type": "context.append_loop_event", "event": {"type": "step.end"}}, {"type": "tool.call", "name": "ls", "input": {"a": 1}}, {"type": "tool.result", "result": {"output": "out"}}, {"role": "assistant", "content": "flat"}, "bad",
    )
    items, skipped = tr.load(spark, "kimi", p)
    assert [r[1:] for r in rows(items)] == [("user", "prompt", "go", 2), ("assistant", "thinking", "hm", 3), ("assistant", "tool_use", '[tool_use: ls] {"a":1}', 5), ("tool", "tool_result", "out", 6), ("assistant", "text", "flat", 7)]
    assert skipped.first().skipped == 1 and items.filter("index = 0").first().timestamp == 5
    with pytest.raises(ValueError):
        tr.load(spark, "other", p)


def test_discovery_and_growth(spark, tmp_path):
    put(tmp_path / ".claude/projects/p/s1.jsonl", {"type": "user", "message": {"role": "user", "content": "hi"}}, {"type": "user", "message": {"role": "user", "content": "again"}})
    found = tr.discover_sessions(spark, f"file://{tmp_path}")
    assert [(r.harness, r.session, r.items_hint) for r in found.collect()] == [("claude-code", "s1", 1)]
    files = found.select("path", "modified", "bytes")
    none = spark.createDataFrame([], "path string, modified long, bytes long, imported long")
    items, _ = tr.load(spark, "claude-code", found.first().path)
    fresh, state = tr.new_items(items, tr.grown(files, none))
    assert fresh.count() == 2 and tr.grown(files, state).count() == 0
    older = state.withColumn("bytes", F.lit(1).cast("long")).withColumn("imported", F.lit(1).cast("long"))
    assert [r.text_full for r in tr.new_items(items, tr.grown(files, older))[0].collect()] == ["again"]


def test_hooks(spark):
    payloads = [
        {"hook_event_name": "UserPromptSubmit", "prompt": "decidimos usar x", "session_id": "s", "cwd": "/p"},
        {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "cd x && /bin/ng search y"}, "tool_response": "t"},
        {"hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"path": "nopath", "notebook_path": "/n.ipynb"}, "tool_response": {"content": 5, "text": "body"}},
        {"hook_event_name": "Stop", "transcript_path": "/t.jsonl"}, {"hook_event_name": "PreCompact"}, {"hook_event_name": "Other"}, {"prompt": "x"}, {"hook_event_name": "UserPromptSubmit"},
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [("{",)], "payload string")
    got = [(r.kind, r.session_id, r.content, r.meta) for r in hooks.parse_hooks(df, now=F.lit(1).cast("long")).collect()]
    assert [g[0] for g in got] == ["prompt", "ng_meta", "tool_output", "session_end", "precompact"]
    assert got[0][1:3] == ("s", "decidimos usar x") and got[2][2] == '[Read] input: {"notebook_path":"/n.ipynb","path":"nopath"}\noutput: body'
    assert json.loads(got[2][3]) == {"tool": "Read", "file_path": "/n.ipynb"} and json.loads(got[3][3]) == {"transcript_path": "/t.jsonl"}


def test_stream(spark, tmp_path):
    lines = [{"session_id": "s", "project": "", "harness": "h", "kind": "prompt", "content": "vamos usar parquet agora", "tags": "parquet src/a.rs", "created_at": 5}, {"ng_gain": {"kind": "inject", "session_id": "s", "project": "", "tokens": 5, "items": 1, "created_at": 6}}, "not json"]
    put(tmp_path / "in/a.txt", *lines)
    for _ in range(2):  # the second start has nothing to do
        ingest.start(ingest.read_lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", True).awaitTermination()
    e = spark.read.parquet(f"file://{tmp_path}/out/events")
    assert [(r.id, r.kind, r.tokens_est) for r in e.collect()] == [(1, "prompt", 6)]
    assert spark.read.parquet(f"file://{tmp_path}/out/dead_letter").count() == 1 and spark.read.parquet(f"file://{tmp_path}/out/ledger").first().tokens == 5
    put(tmp_path / "in/b.txt", lines[0])
    ingest.start(ingest.read_lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", True).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out/events").collect()) == [1, 2]
    entities, edges = ingest.current_graph(spark, f"file://{tmp_path}/out")
    assert {(r["name"], r["kind"]): r["weight"] for r in entities.collect()} == {("parquet", "concept"): 1.1, ("src/a.rs", "file"): 1.1, ("vamos usar parquet agora", "decision"): 3.1}
    assert edges.count() == 3
    assert "## Decisions" in sinks.graph_markdown(entities, edges)


def test_graph_poison_and_neighbors(spark):
    def event(i, kind, content, tags="", meta=None):
        return (i, "p", kind, content, tags, meta, 100 + i)

    rows_ = [
        event(1, "prompt", "how do I use this? decidimosx", "how"), event(2, "tool_output", "test result: ok. 0 failed;", "failed x/y"), event(3, "ng_meta", "error: x", "a"),
        event(4, "tool_output", "output: error[E0502]: bad\nline FAILED here now", "", '{"file_path": "/a/b.rs"}'), event(5, "assistant", '{"a": [1, 2], "b": {"c": "d"}, "e": "f", "g": 1}', "x y"), event(6, "tool_output", "fine", "", "not json"),
    ]
    m = graph.extract_entities(spark.createDataFrame(rows_, "id long, project string, kind string, content string, tags string, meta string, created_at long"))
    assert {(r.id, r["name"], r["kind"]) for r in m.collect()} == {(1, "how", "concept"), (4, "/a/b.rs", "file"), (4, "E0502", "error"), (4, "line FAILED here now", "error")}
    many = spark.range(1, 151).selectExpr("id", "'p' AS project", "0L AS created_at", "0 AS pos", "'n' AS name", "'concept' AS kind")
    assert graph.build_entities(many).first().weight == 10.0
    e = spark.createDataFrame([(n, "concept", "p", 1.0, 0, i, 0) for i, n in enumerate("abc")], "name string, kind string, project string, weight double, updated_at long, first_id long, first_pos int")
    key = "p\x1fconcept\x1f"
    r = spark.createDataFrame([(key + "a", key + "b", "co", 5.0, 0), (key + "b", key + "c", "co", 2.0, 0)], "a string, b string, kind string, weight double, updated_at long")
    start = spark.createDataFrame([(0, "a")], "query_id int, name string")
    assert {x["name"]: x.score for x in graph.neighbors(e, r, start, "p", 2).collect()} == {"b": 0.5, "c": 0.1}
    assert {x["name"] for x in graph.snapshot(e, r, None, "a", 1)[0].collect()} == {"a", "b"}
    bumps = spark.createDataFrame([(1, "a", 20.0), (2, "a", -3.0)], "seq long, name string, delta double")
    assert {x["name"]: x.weight for x in graph.bump(e, bumps).collect()} == {"a": 7.0, "b": 1.0, "c": 1.0}
    assert graph.valid_bump("a", 5) and not graph.valid_bump(" ", 1) and not graph.valid_bump("a", float("nan")) and not graph.valid_bump("a", 5.1)


def test_cleanup(spark, tmp_path):
    """Of 60 lines the last 20 are hot: 8, 12 and 30 are large tool results, 10 is prose that is old and large, 20 has no message."""
    tool = lambda n: {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "r" * n}]}}
    said = lambda n: {"type": "assistant", "message": {"role": "assistant", "content": "t" * n}}
    odd = {8: tool(4000), 10: said(1600), 12: tool(2400), 15: tool(300), 20: {"type": "odd", "pad": "z" * 4000}, 30: tool(6000), 35: said(4000), 50: tool(8000)}
    lines = [odd.get(i) or ({"type": "user", "message": {"role": "user", "content": "ask " * 500}} if i % 7 == 0 else said(20)) for i in range(60)]
    p = put(tmp_path / "s.jsonl", *lines)
    items, _ = tr.load(spark, "claude-code", p)
    raw = spark.createDataFrame([("s", i + 1, json.dumps(x)) for i, x in enumerate(lines)], "session string, raw_line long, line string")
    scores = hygiene.score_items(items)
    assert sorted(r["index"] for r in hygiene.plan_eviction(scores, 10**9).collect()) == [8, 10, 12, 20, 30]
    # The unrecognised line goes first, then the largest result, then by size and age.
    first = [r["index"] for r in hygiene.plan_eviction(scores, 2600).orderBy("score").collect()]
    assert first[:2] == [20, 30] and len(first) == 3
    changed, gains = cleanup.plan(items, raw)
    g = gains.first()
    assert (g.evicted, g.skipped) == (4, 1) and g.gain == g.evicted_tokens - g.stub_tokens
    assert cleanup.rewrite(changed, str(tmp_path / "s.jsonl")) == 4
    after = (tmp_path / "s.jsonl").read_text().split("\n")
    assert len(after) == 60 and json.loads(after[8])["message"]["content"][0]["text"].startswith("[ng-evicted: tool_result ~1000tok")


def test_stub_of_a_line():
    from memlake.sources.rewrite import replace_text, stub_line

    long = "a" * 79 + "éé"
    stub = "[ng-evicted: " + "a" * 79 + "é… — recupere com `ng search`]"
    assert json.loads(stub_line(json.dumps({"message": {"content": long}, "uuid": "u"}), "claude-code")) == {"message": {"content": stub}, "uuid": "u"}
    assert json.loads(stub_line(json.dumps({"payload": {"output": "short"}}), "codex")) == {"payload": {"output": "[ng-evicted: short — recupere com `ng search`]"}}
    assert json.loads(stub_line(json.dumps({"input": [{"type": "text", "text": "q"}]}), "kimi"))["input"][0]["text"].startswith('[ng-evicted: [{"type":"text","text":"q"}] — ')
    for way in (("content",), ("message", "content"), ("event", "part", "text"), ("event", "part", "think"), ("event", "result", "output")):
        line = "old"
        for key in reversed(way):
            line = {key: line}
        got = json.loads(replace_text(json.dumps(line), "kimi", "new"))
        for key in way:
            got = got[key]
        assert got == "new"
    assert stub_line('{"message": {"content": null}}', "claude-code") is None and replace_text('{"content": "x"}', "opencode", "y") is None


def test_rewrites_keep_every_backup(tmp_path):
    from memlake.sources.rewrite import rewrite_jsonl

    p = tmp_path / "s.jsonl"
    p.write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    one = rewrite_jsonl(str(p), [1], [])
    two = rewrite_jsonl(str(p), [1], [])
    assert one != two and open(one).read().count("\n") == 3 and open(two).read().count("\n") == 2 and p.read_text() == '{"a":3}\n'
    for bad in ('{"a":\r1}', '{"a":\n1}', "no json"):
        with pytest.raises(ValueError):
            rewrite_jsonl(str(p), [], [(1, bad)])


def test_ui_stub_column(spark):
    df = spark.createDataFrame([("x" * 80,), ("y" * 81,)], "t string")
    assert [r[0] for r in df.select(hygiene.ui_stub(F.col("t"))).collect()] == ["[ng-evicted: " + "x" * 80 + " — recupere com `ng search`]", "[ng-evicted: " + "y" * 80 + "… — recupere com `ng search`]"]


def test_soft_state_and_imports(spark):
    e = ev.prepare(spark.createDataFrame([("s", "p", "h", "prompt", "text", "", 1)], "session_id string, project string, harness string, kind string, content string, tags string, created_at long")).withColumn("id", F.lit(1).cast("long"))
    ops = spark.createDataFrame([(1, 1, "hide", None, 10, None), (2, 1, "hide", None, 20, None), (3, 1, "annotate", "n", 21, None), (4, 1, "edit", "new", 22, None)], "seq long, id long, op string, arg string, ts long, tags string")
    r = ev.fold_ops(e, ops).first()
    assert (r.hidden_at, r.note, r.content) == (10, "n", "text")
    more = ops.unionByName(spark.createDataFrame([(5, 1, "unhide", None, 30, None), (6, 1, "annotate", " ", 31, None)], ops.schema))
    r = ev.fold_ops(e, more).first()
    assert (r.hidden_at, r.note) == (None, None)
    m = ev.manual_memory(spark.createDataFrame([("p", "old", "t", 1)], "project string, content string, tags string, created_at long")).withColumn("id", F.lit(1).cast("long"))
    assert ev.fold_ops(m, ops.filter("op = 'edit'")).first().content == "new" and ev.injectable(m).count() == 0
    assert sinks.seed_events(spark, 1000).filter("content LIKE 'zephyr%'").count() == 2


def test_guarded_writes(tmp_path):
    p = str(tmp_path / "d/context.md")
    assert sinks.write_guarded(p, sinks.MARK + "\nx") and sinks.write_guarded(p, sinks.MARK + "\ny")
    (tmp_path / "own.md").write_text("mine")
    assert not sinks.write_guarded(str(tmp_path / "own.md"), "x") and sinks.write_guarded(str(tmp_path / "own.md"), "x", True)
