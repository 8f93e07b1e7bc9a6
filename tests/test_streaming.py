import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from memlake.functions.embed import HashEmbedder
from memlake.operators import events as ev
from memlake.operators import graph, vectors
from memlake.sources import tail
from memlake.sources import testdata as td
from memlake.sources import transcripts as tr
from memlake.streaming import enrich, imports
from memlake.streaming.store import FAN, Manifest, Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('log')}/events"
    td.mem_events(spark, SF).filter("id <= 300 OR id % 50 = 1").write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def batch_of(log, k, n):
    top = log.agg(F.max("id")).first()[0]
    return log.filter((F.col("id") > top * k // n) & (F.col("id") <= top * (k + 1) // n))


def assert_as_batch(job, log):
    """Every table is what one pass over the whole log gives."""
    m = job.store.head()
    mentions = graph.extract_entities(log)
    entities, edges = job.graph(m)
    assert rows(entities) == rows(graph.build_entities(mentions)) and rows(edges) == rows(graph.build_edges(mentions))
    assert rows(job.store.read(m, "events").select("id", "content")) == rows(log.select("id", "content"))
    assert rows(job.store.read(m, "imports")) == rows(ev.pending_imports(log, 0, 10**6))
    assert rows(job.store.read(m, "vectors").select("event_id")) == rows(ev.injectable(log).select(F.col("id").alias("event_id")))
    large = log.filter("kind = 'tool_output' AND saved_by IS NULL AND hidden_at IS NULL AND octet_length(content) >= 20")
    assert rows(job.store.read(m, "digests").select("id")) == rows(large.select("id"))


def sinks(**limits):
    made = [enrich.vector_sink(HashEmbedder(), limits.get("vectors")), enrich.import_sink(limits.get("imports")), enrich.digest_sink("w", enrich.first_words, 20, 5, limits.get("digests"))]
    return [*made, enrich.entity_sink(limits.get("entities")), enrich.edge_sink()]


def test_failures_and_replays_change_nothing(spark, log, tmp_path):
    job = enrich.Enrichment(Store(spark, f"file://{tmp_path}/s"), sinks())
    job.advance(0, batch_of(log, 0, 3))
    seen = job.store.head()
    old = job.store.read(seen, "events").count()

    def broken(_):
        raise RuntimeError("between two sinks")

    failing = enrich.Enrichment(job.store, [*sinks()[:2], enrich.Sink("digests", lambda e: e, broken), *sinks()[3:]])
    with pytest.raises(RuntimeError, match="between"):
        failing.advance(1, batch_of(log, 1, 3))
    assert job.store.head() == seen
    job.advance(1, batch_of(log, 1, 3))
    assert job.advance(1, batch_of(log, 1, 3)).version == 2
    job.advance(0, batch_of(log, 0, 3))
    job.advance(2, batch_of(log, 2, 3))
    assert_as_batch(job, log)
    # A reader of an old manifest sees that state, until it is forgotten.
    assert job.store.read(seen, "events").count() == old
    gone = job.store.vacuum(1)
    assert gone >= 2 and job.store.versions() == [3]
    assert_as_batch(job, log)
    with pytest.raises(RuntimeError, match="another writer"):
        job.store.commit(Manifest(version=3))


def test_limits_drain_by_polls(spark, log, tmp_path):
    job = enrich.Enrichment(Store(spark, f"file://{tmp_path}/s"), sinks(vectors=80, imports=3, digests=20, entities=120))
    job.advance(0, log)
    m = job.store.head()
    assert job.store.read(m, "imports").count() <= 3 and job.store.read(m, "vectors").count() == 80
    n = 1
    while any(m.cursors.get(s.name, 0) < m.cursors["events"] for s in job.sinks):
        m = job.advance(n)
        n += 1
        assert n < 20
    assert_as_batch(job, log)


def test_new_rules_are_made_beside_the_old(spark, log, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    job = enrich.Enrichment(store, [enrich.entity_sink(), enrich.edge_sink()], rules=1)
    n = FAN + 1
    for k in range(n):
        job.advance(k, batch_of(log, k, n))
    levels = [f.level for f in store.head().tables["entities"]]
    assert sorted(levels) == [0, 1]
    before = store.head()
    old = rows(job.graph(before)[0])
    monkeypatch.setattr(graph, "CONCEPTS", 1)
    newer = enrich.Enrichment(store, [enrich.entity_sink(), enrich.edge_sink()], rules=2)
    assert newer.current().rules == 2 and newer.current().version == before.version + 1
    want = rows(graph.build_entities(graph.extract_entities(log)))
    assert rows(newer.graph()[0]) == want != old
    # The reader that began before sees the old graph whole.
    assert rows(job.graph(before)[0]) == old
    assert store.head().batch == before.batch and store.head().cursors == before.cursors


def test_stream_into_the_store(spark, tmp_path):
    line = {"session_id": "s", "project": "", "harness": "h", "kind": "prompt", "content": "vamos usar parquet agora", "tags": "parquet src/a.rs", "created_at": 5}
    (tmp_path / "in").mkdir()
    job = enrich.Enrichment(Store(spark, f"file://{tmp_path}/out"))

    def run():
        lines = spark.readStream.format("text").load(f"file://{tmp_path}/in")
        enrich.start(lines, job, f"file://{tmp_path}/cp", True).awaitTermination()

    (tmp_path / "in/a.txt").write_text(json.dumps(line) + "\nnot json\n")
    run()
    run()
    (tmp_path / "in/b.txt").write_text("\n".join([json.dumps(line)] * 2))
    run()
    m = job.store.head()
    assert sorted(r.id for r in job.store.read(m, "events").collect()) == [1, 2, 3] and m.cursors == dict.fromkeys(("events", "vectors", "imports", "digests", "entities", "edges"), 3)
    assert {(r["name"], r["weight"]) for r in job.graph()[0].collect()} == {("parquet", 1.2), ("src/a.rs", 1.2), ("vamos usar parquet agora", 3.2)}
    assert job.store.read(m, "vectors").count() == 3 == vectors.embed_events(job.store.read(m, "events"), HashEmbedder()).count()


def item(i, text="x"):
    return json.dumps({"type": "response_item", "payload": {"type": "message", "role": ["user", "assistant"][i % 2], "content": f"{text} {i}"}})


def test_tail_follows_files(spark, tmp_path):
    root, out = tmp_path / "t/deep", f"file://{tmp_path}/got"
    root.mkdir(parents=True)

    def run(budget=1 << 20):
        lines = tail.read_tail(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/state", bytes_per_trigger=budget)
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    def got():
        return sorted((os.path.basename(r.path), r.line, r.value) for r in spark.read.parquet(out).collect())

    a, b = root / "a.jsonl", root / "b.jsonl"
    said = [item(i) for i in range(40)]
    a.write_text("\n".join(said[:10]) + "\n" + said[10][:20])
    b.write_text("alone\n")
    (root / "c.txt").write_text("no transcript\n")
    run(200)
    first = [("a.jsonl", i + 1, x) for i, x in enumerate(said[:10])] + [("b.jsonl", 1, "alone")]
    assert got() == sorted(first)
    # Grown, the line that was not complete included; a restart neither loses nor repeats.
    a.write_text("\n".join(said[:20]) + "\n")
    run()
    run()
    grown = [("a.jsonl", i + 1, x) for i, x in enumerate(said[:20])]
    assert got() == sorted([*grown, first[-1]])
    # Rewritten to fewer bytes but as many lines, and longer since: only what follows comes.
    a.write_text("\n".join(["{}"] * 20 + said[20:22]) + "\n")
    run()
    assert got() == sorted([*grown, first[-1], ("a.jsonl", 21, said[20]), ("a.jsonl", 22, said[21])])
    # Shrunk to fewer lines than it has given: it goes on at its end.
    a.write_text("{}\n" * 3)
    run()
    a.write_text("{}\n" * 3 + said[30] + "\n")
    run()
    assert [x for x in got() if x[0] == "a.jsonl"][-3:] == [("a.jsonl", 20, said[19]), ("a.jsonl", 21, said[20]), ("a.jsonl", 22, said[21])] and ("a.jsonl", 4, said[30]) in got()
    # Rewritten in place to as many bytes or more is seen by the bytes before the position.
    b.write_text("other\nnew line\n")
    run()
    assert [x for x in got() if x[0] == "b.jsonl"] == [("b.jsonl", 1, "alone"), ("b.jsonl", 2, "new line")]


def test_tailed_records_equal_the_batch_job(spark, tmp_path):
    root, out = tmp_path / "t", f"file://{tmp_path}/got"
    root.mkdir()
    for name, n in (("s1", 12), ("s2", 5)):
        (root / f"{name}.jsonl").write_text("\n".join([item(i) for i in range(n)] + ["{broken"]) + "\n")
    lines = tail.read_tail(spark, f"file://{root}", f"file://{tmp_path}/state", bytes_per_trigger=300)
    items = tr.parse_lines(lines, "codex")
    q = items.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want, _ = tr.load(spark, "codex", f"file://{root}")
    columns = ["session", "harness", "role", "kind", "text_full", "tokens_est", "timestamp", "raw_line"]
    assert rows(spark.read.parquet(out).select(*columns)) == rows(want.select(*columns))


def test_keyed_imports_equal_the_batch(spark, tmp_path):
    roles = ["user", "assistant", "assistant", "tool"]
    items = [(f"s{s}", "h", i, roles[(s + i) % 4], "text" if i % 5 else "thinking", f"t{s} {i}", None if i % 3 else i) for s in range(3) for i in range(20 + s)]
    schema = "session string, harness string, index long, role string, kind string, text_full string, timestamp long"
    want = rows(ev.import_items(spark.createDataFrame(items, schema), spark.createDataFrame([], "session string, n long"), "p"))
    splits = {"whole again": [items[:30], items, items], "parts and overlaps": [[x for x in items if x[2] < 9], [x for x in items if 9 <= x[2] < 12], [x for x in items if 5 <= x[2] < 15] * 2, items[::-1]]}
    for n, parts in enumerate(splits.values()):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{n}/in/{k}")
        out, stream = f"file://{tmp_path}/{n}/out", spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        q = imports.import_stream(stream.parquet(f"file://{tmp_path}/{n}/in"), "p").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/{n}/cp").trigger(processingTime="1 second").start()
        # Batches go on without data, as silent sessions are looked for: the rows taken in say when all are.
        until = time.time() + 90
        while q.isActive and time.time() < until and sum(p.numInputRows for p in q.recentProgress) < sum(map(len, parts)):
            time.sleep(0.2)
        q.stop()
        assert rows(spark.read.parquet(out)) == want


def test_any_cut_of_the_ops_leaves_the_same(spark):
    rng = random.Random(3)
    events = spark.createDataFrame([(i, f"c{i}", "t", i % 2 == 0, 7 if i % 3 == 0 else None, "n0", 0) for i in range(12)], "id long, content string, tags string, manual boolean, hidden_at long, note string, tokens_est long")
    ops = [(s, rng.randrange(12), rng.choice(["hide", "unhide", "annotate", "edit", "hide"]), rng.choice([" ", f"a{s}"]), 100 + s, rng.choice([None, f"t{s}"])) for s in range(60)]
    # By hand, one after the other.
    want = {r.id: r.asDict() for r in events.collect()}
    for _, i, op, arg, ts, tags in ops:
        e = want[i]
        if op == "hide" and e["hidden_at"] is None:
            e["hidden_at"] = ts
        elif op == "unhide":
            e["hidden_at"] = None
        elif op == "annotate":
            e["note"] = arg.strip() or None
        elif op == "edit" and e["manual"]:
            e |= {"content": arg, "tags": tags or "t", "tokens_est": len(arg.encode()) // 4}
    schema = "seq long, id long, op string, arg string, ts long, tags string"
    for cuts in ([], [30], [1, 2, 59], [10, 20, 30, 40, 50]):
        states = None
        for a, b in zip([0, *cuts], [*cuts, 60], strict=True):
            part = ev.fold_state(spark.createDataFrame(ops[a:b], schema))
            states = part if states is None else part.unionByName(states)
        got = {r.id: r.asDict() for r in ev.apply_state(events, ev.merge_states(states)).collect()}
        assert got == want, cuts


def test_late_rows_and_repeats(spark, tmp_path):
    """Rows inside the watermark count, later ones don't; repeats within it come once. A batch goes by the watermark before its predecessor."""
    schema = "kind string, session_id string, tokens long, created_at long"
    day = 86400
    files = [[("a", "s", 1, 1000), ("a", "s", 2, 1500)], [("a", "s", 4, day)], [("b", "z", 0, day + 1)], [("a", "s", 8, day - 3000), ("a", "s", 16, 2000), ("a", "s", 4, day)], [("b", "s", 0, 3 * day)], [("b", "s", 0, 5 * day)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        time.sleep(1.1)

    def run(name, make):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        q = make(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(100)
        q.stop()
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    got = run("slide", lambda s: ev.sliding_gain(s, watermark="2 hours"))
    # The row of 2000 comes a day late; that of day - 3000 is within two hours.
    assert {(r.start, r.tokens) for r in got.filter("kind = 'a'").collect()} == {(0, 3), (-1800, 3), (day - 3600, 8), (day - 5400, 8), (day, 8), (day - 1800, 8)}
    got = run("session", lambda s: ev.session_gain(s, "2 hours", "2 hours"))
    assert {(r.start, r.n, r.tokens) for r in got.filter(f"start < {2 * day} AND session_id = 's'").collect()} == {(1000, 2, 3), (day - 3000, 3, 16)}
    got = run("once", lambda s: ev.once_each(s, ["session_id", "kind", "tokens"], "2 hours").drop("ts"))
    assert got.filter("tokens = 4").count() == 1
