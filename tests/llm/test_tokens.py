import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm import packing, tokens
from memlake.llm.words import buffers

from .conftest import ROWS


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(docs, tokenizer_path, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.prefix_counts(docs, tokenizer_path, 100).collect())
    assert got == Counter((d, len((t or "").encode()), len(library(t)), len(library(t)) > 100) for d, t in ROWS)


def test_fit_is_within_the_limit(docs, tokenizer_path, library):
    texts = dict(ROWS)
    for r in tokens.prefix_counts(docs, tokenizer_path, 50).collect():
        if r.over_limit:
            assert 45 <= len(library(texts[r.doc_id].encode()[: r.fit_bytes].decode())) <= 50
        else:
            assert r.fit_bytes == r.n_bytes


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcDE éßñ,.'<|>\n\t 12́ ſK"), max_size=60))
def test_every_prefix(text):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    buf, offsets = buffers(pa.array([text]))
    at, _, total = tokens.prefix_table(tokens.WordTable.get(path, True), buf, offsets)
    assert total[0] == len(t.encode(text, add_special_tokens=False).ids)
    end = 0
    for i, c in enumerate(text):
        end += len(c.encode())
        if at[end - 1] >= 0:
            assert at[end - 1] == len(t.encode(text[: i + 1], add_special_tokens=False).ids)
        else:
            assert c in " \n\t"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "tion", "a", "aa", "aaa", "ab", "z", "'s", "'re", "'", "'ll", "!", "!!", "..", "1", "23", "é", "ß", "日本", "語", "🙂", "THE", "Q", "-", "ana", "nan"]), min_size=20, max_size=60))
def test_every_prefix_of_long_words(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, word = str(public_tokenizers.path("word_bpe_49k.json")), "".join(parts)
    table, t = tokens.WordTable.get(path, True), Tokenizer.from_file(path)
    table.recurrence = table.recurrence or tokens.Recurrence(path, table.tokenizer)
    got = table.recurrence.word(word)
    assert got == [len(t.encode(word[: i + 1], add_special_tokens=False).ids) for i in range(len(word))]


@pytest.mark.parametrize("word", ["q" * 700, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700)), "the" * 40_000, "日本語テキスト" * 5_000, "ab1!" * 25_000], ids=["q", "mixed", "the", "cjk", "pieces"])
def test_long_words_have_counts_at_every_character(tokenizer_path, library, word):
    import pyarrow as pa

    text = f"before {word} after"
    buf, offsets = buffers(pa.array([text]))
    at, w, total = tokens.prefix_table(tokens.WordTable.get(tokenizer_path, True), buf, offsets)
    assert total[0] == len(library(text))
    ends = np.cumsum([len(c.encode()) for c in text]) - 1
    assert all(at[e] >= 0 for e, c in zip(ends.tolist(), text, strict=True) if c != " ")
    places = range(len(text)) if len(text) < 1000 else np.random.default_rng(1).integers(7, len(text), 25).tolist()
    for i in places:
        if text[i] != " ":
            assert at[ends[i]] == len(library(text[: i + 1]))


def test_budgets_are_read_from_the_table(docs, tokenizer_path, library):
    texts, budgets = dict(ROWS), (0, 1, 7, 50, 333)
    for r in tokens.prefix_counts(docs, tokenizer_path, 50, budgets=budgets).collect():
        assert r.budget_bytes[3] == r.fit_bytes
        raw = (texts[r.doc_id] or "").encode()
        for budget, size in zip(budgets, r.budget_bytes, strict=True):
            assert len(library(raw[:size].decode())) <= budget
            if size < len(raw):
                longer = raw[:size].decode() + raw[size:].decode()[0]
                assert len(library(longer)) > budget or r.doc_id in (9, 11)


def test_table_starts_anew_when_full(tokenizer_path, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "TABLE_WORDS", 5)
    texts = ["one two three", "four five six seven", "one eight nine ten eleven"]
    for text in texts * 2:
        (_, _, flat), = tokens.encoded(pa.array([text]), tokenizer_path)
        assert flat.tolist() == library(text)


def test_token_file(docs, no_docs, tokenizer_path, library):
    rows = tokens.token_file_digest(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), tokenizer_path).collect()
    start = 0
    for d, t in sorted({d: t for d, t in ROWS if d is not None}.items()):
        ids = np.array([*library(t), 1], "<u4")
        (r,) = [r for r in rows if r.doc_id == d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_file_digest(docs, tokenizer_path).count() == len(ROWS)
    assert tokens.token_file_digest(no_docs, tokenizer_path).count() == 0


def test_token_file_layout(spark, docs, tokenizer_path, tmp_path):
    import pyarrow.parquet as pq

    tokens.write_token_file(docs, f"file://{tmp_path}/t", tokenizer_path, 1, page_rows=2)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(2)
    assert column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in e or "DELTA" in e for e in column.encodings)
    index = tokens.token_file_index(spark, f"file://{tmp_path}/t")
    assert index.count() == len(ROWS) and index.agg({"start": "min"}).first()[0] == 0


def test_packing(docs, no_docs, tokenizer_path, library):
    cap = 64
    rows = packing.packed_documents(docs, tokenizer_path, cap).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    want = Counter()
    for d, t in ROWS:
        ids = np.array([*library(t), 0], "<u4")
        for p, s in enumerate(range(0, len(ids), cap)):
            piece = ids[s : s + cap]
            want[d, p, s, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.packed_documents(no_docs, tokenizer_path, cap).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=12))
def test_plans_hold_the_histogram(histogram):
    got = Counter()
    plan = packing.plan(histogram, 64)
    for many, lengths in plan:
        assert sum(lengths) <= 64
        for x in lengths:
            got[x] += many
    assert got == histogram
    total = sum(x * n for x, n in histogram.items())
    halves = sum(n for x, n in histogram.items() if x > 32)
    assert sum(m for m, _ in plan) <= 1.7 * max(total / 64, halves) + 1


def test_plans_hold_the_histogram_of_dense_lengths():
    rng = np.random.default_rng(2)
    histogram = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 2049), 900, replace=False), rng.integers(1, 60, 900), strict=True)}
    report, got = packing.Report(), Counter()
    for many, lengths in packing.plan(histogram, 2048, report):
        assert sum(lengths) <= 2048
        for x in lengths:
            got[x] += many
    assert got == histogram and tuple(report.tried) == packing.SHARES and report.sequences == min(report.tried.values())
    alone = sum(m for m, _ in packing._best_fit({}, dict(histogram), 2048))
    assert report.bound <= report.sequences <= min(1.05 * report.bound, 1.005 * alone) and report.configured >= 0.8 * report.sequences


def test_plans_of_documents_are_near_the_bound():
    """Lengths spread as those of texts are: the tokens' bound can be met."""
    rng = np.random.default_rng(7)
    lengths = np.clip(np.exp(rng.normal(5.5, 1.2, 20_000)), 1, 2048).astype(int)
    report = packing.Report()
    packing.plan({int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}, 2048, report)
    assert report.sequences <= 1.002 * report.bound + 1 and report.configured >= 0.8 * report.sequences


def best_possible(items, cap):
    """Fewest sequences, by trying everything."""
    best = len(items)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(items):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= items[k] and free[i] not in free[:i]:
                go(k + 1, [*free[:i], free[i] - items[k], *free[i + 1 :]])
        go(k + 1, [*free, cap - items[k]])

    go(0, [])
    return best


def test_plans_are_near_the_optimum():
    rng, more, bound_over = np.random.default_rng(4), 0, 0
    for _ in range(40):
        items = sorted((int(x) for x in rng.integers(8, 40, 11)), reverse=True)
        report = packing.Report()
        packing.plan(dict(Counter(items)), 64, report)
        best = best_possible(items, 64)
        more += report.sequences - best
        bound_over += report.bound > best + 1e-6
        assert report.sequences <= best + 1
    assert more <= 6 and not bound_over


def test_the_program_beats_best_fit_alone():
    rng = np.random.default_rng(0)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(rng.integers(600, 1100, 20_000), return_counts=True), strict=True)}
    report = packing.Report()
    packing.plan(histogram, 2048, report)
    alone = sum(m for m, _ in packing._best_fit({}, dict(histogram), 2048))
    assert report.sequences < 0.99 * alone


def test_packing_of_clashing_names(spark):
    rows = [(i, 0, 1 + i % 7, "x", i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length int, `_salt a.b` string, rank long")
    got = packing.pack(df, 8)
    assert got.columns == [*df.columns, "sequence_id", "offset"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(rows)
