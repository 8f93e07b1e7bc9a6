from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import jaccard, quality
from memlake.llm.common import staged

from .test_text_operators import brute_components, brute_quality, brute_removal

SF = "/root/testdata/sf0.001"


def brute_kept(t):
    """The verdict by the base rule and the limits of the repeats' spans, by looking for windows alone."""
    w, limits = (t or "").split(), quality.Limits()
    n = len(w)

    def again(k):
        windows = [tuple(w[i : i + k]) for i in range(n - k + 1)]
        count = Counter(windows)
        return [i for i, x in enumerate(windows) if count[x] > 1]

    if brute_quality(t)[5]:
        return False
    covered = {k for i in again(limits.min_repeat) for k in range(i, i + limits.min_repeat)}
    most = min(limits.max_longest, limits.max_longest_percent * n // 100)
    return 100 * len(covered) <= limits.max_covered_percent * n and not again(most + 1)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    good = {d: t for d, t in source.items() if brute_kept(t)}
    one = staged(corpus_pipeline.quality_rules(spark, docs, SF))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(good)
    unlike = {k[0] for k in brute_components(list(good.items())) if k[0] == k[2]}
    two = staged(corpus_pipeline.jaccard_join(spark, one, SF))
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == {d: good[d] for d in unlike}
    removed = {k[0]: k[1:] for k in brute_removal([(d, good[d]) for d in unlike])}
    three = staged(corpus_pipeline.substring_dedup(spark, two, SF))
    left = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == docs.columns and set(left) == {d for d, (n, gone, _) in removed.items() if gone < n}
    assert all(len(left[d].split(" ")) == removed[d][0] - removed[d][1] for d in left if removed[d][1])
    four = staged(corpus_pipeline.benchmark_decontamination(spark, three, SF))
    assert four.columns == docs.columns and set(left) >= {r.doc_id for r in four.collect()}
    five = corpus_pipeline.best_fit_packing(spark, four, SF)
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.select("doc_id").collect()}


def test_odd_rows_pass_all_stages(spark, docs, no_docs):
    named = docs.withColumns({"a.b": F.lit(1), "tick`s": F.lit("x"), "key": F.lit(2), "doc": F.lit(3)})
    for df in (named, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.columns == df.columns or name == "best_fit_packing", name
            # Only the rules drop all of these, as they are short.
            assert (out.count() > 0) == (df is named and name != "quality_rules"), name


def test_rows_that_share_an_id(spark):
    """Unlike texts under one id stay each, like ones once, and what is kept is what all pairs of rows give."""
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b, c = text(80), text(90), text(70)
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (7, c), (7, c), (7, c + " x"), (7, text(60)), (None, a), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.jaccard_join(spark, df, SF).collect())
    like = sorted(t for d, t in rows if d == 7 and t.startswith(c))
    one = [x for x in got if x[0] == 7 and x[1] in like]
    assert len(one) == 1
    assert sorted(set(got) - set(one)) == sorted([(3, a), (5, b), (7, rows[7][1]), (-1, a), (8, "")])
    found = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert {x for x in found if x[0] in (3, 5, 9)} == {(3, 3), (5, 3), (9, 3)}


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent / "memlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "memlake.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["op4_warc_archives", "op5_chat_formatting", "op7_quality_rules", "op8_substring_dedup", "op9_jaccard_join", "op10_decontamination"])
def test_sql(spark, name):
    import duckdb

    from memlake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
