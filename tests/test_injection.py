import datetime as dt
import re
import sqlite3

from memlake import queries as q
from memlake.operators import search
from memlake.plans import injection
from memlake.schema import INJECTED_KINDS
from memlake.sources import testdata as td

SF = "/root/testdata/sf0.001"


def normal(text):
    return " ".join(re.sub(r"[0-9]+$", "", w).lower() for w in text.split())


def brute_contexts(log, prompts, terms):
    """Contexts by SQLite's full-text table: its ranks, its snippets, then the limits by hand."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, tags, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f (rowid, content, tags) VALUES (?, ?, ?)", [(r.id, r.content, r.tags) for r in log])
    rows, out = {r.id: r for r in log}, {}
    for p in prompts:
        asked = terms.get(p.query_id)
        if not asked:
            continue
        match = " OR ".join('"' + t.replace('"', '""') + '"' for t in asked)
        hits = []
        for i, rank, said in db.execute("SELECT rowid, bm25(f, 1.0, 2.0) AS r, snippet(f, 0, '', '', '…', 48) FROM f WHERE f MATCH ? ORDER BY r, rowid", (match,)):
            r = rows[i]
            if r.hidden_at is None and r.kind in INJECTED_KINDS and r.session_id != p.session_id:
                hits.append((round(rank, 9), i, said))
        seen, lines, size = set(), [], len(injection.HEADER.encode())
        for rank, i, said in sorted(hits)[:9]:
            if rank <= injection.MAX_RANK and normal(said) not in seen and len(seen) < injection.LIMIT:
                seen.add(normal(said))
                day = dt.datetime.fromtimestamp(rows[i].created_at, dt.UTC).strftime("%Y-%m-%d")
                lines.append(f"- [#{i} · {rows[i].harness} · {day}] {said.replace(chr(10), ' ')}\n")
        kept = []
        for line in lines:
            size += len(line.encode())
            if size > injection.BUDGET_TOKENS * 4:
                break
            kept.append(line)
        if kept:
            out[p.query_id] = injection.HEADER + "".join(kept) + injection.FOOTER
    return out


def test_contexts_are_those_of_a_full_text_table(spark):
    """Search, snippets, ties, near duplicates, budget and envelope together, over the whole log."""
    log = td.mem_events(spark, SF).collect()
    prompts = q._prompts(spark, SF)
    index = q._index(spark, SF)
    terms = {}
    for r in search.selective(index, search.terms(prompts)).orderBy("term_no").collect():
        terms.setdefault(r.query_id, []).append(r.raw)
    got = {r.query_id: r.context for r in injection.build_injection(index, prompts).collect()}
    want = brute_contexts(log, prompts.collect(), terms)
    assert len(want) > 3 and got == want
    assert {r.query_id: r.context for r in q.flagship(spark, SF).collect()} == want
