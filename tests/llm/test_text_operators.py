import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import decontaminate, jaccard, quality, substring
from memlake.llm.words import Words, buffers

from .conftest import ROWS

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_removal(rows, n=13):
    big = float("inf")
    texts = [(big if d is None else d, d, SPACED.findall(t or "")) for d, t in rows]
    least = {}
    for key, _, w in sorted(texts, key=lambda x: x[0]):
        for i in range(len(w) - n + 1):
            least.setdefault(tuple(w[i : i + n]), key)
    out = Counter()
    for key, d, w in texts:
        cut = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < key:
                cut |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out[d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = SPACED.findall(ascii_lower(t))
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
        if d is not None:
            sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x & y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    out = Counter()
    for d, t in rows:
        w = SPACED.findall(ascii_lower(t))
        n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        out[d, n, None if d is None else find(d)] += 1
    return out


def near_copies(n=60, seed=3):
    """Families of near copies around a text, documents that share a passage, and strangers."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for i in range(n):
        kind = i % 4
        if kind < 2:
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(len(w)))] = word()
        elif kind == 2:
            w = [word() for _ in range(int(rng.integers(0, 12)))] + passage + [word() for _ in range(int(rng.integers(0, 12)))]
        else:
            w = [word() for _ in range(40)]
        rows.append((i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [ROWS, near_copies()], ids=["odd", "families"])
def test_substring_removal(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in substring.remove_repeats(df).collect())
    assert got == brute_removal(rows)


@pytest.mark.parametrize(("sent", "most"), [(1_000_000, 1 << 17), (60, 2)])
def test_substring_removal_in_parts_and_chunks(spark, monkeypatch, sent, most):
    monkeypatch.setattr(substring, "SORTED_WINDOWS", 20)
    monkeypatch.setattr(substring, "SPLIT_TOGETHER", 300)
    monkeypatch.setattr(substring, "PACKED_TOGETHER", 500)
    monkeypatch.setattr(substring, "SENT_WINDOWS", sent)
    monkeypatch.setattr(substring, "MOST_PARTITIONS", most)
    rows = near_copies(60) + [(-5 + i, near_copies(24)[4 * i + 2][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substring.remove_repeats(df).collect()) == brute_removal(rows)


@pytest.mark.parametrize("together", [1, 4 << 20])
def test_substring_removal_of_passages_twice_in_a_document(spark, monkeypatch, together):
    monkeypatch.setattr(substring, "PACKED_TOGETHER", together)
    passage, own = " ".join(f"p{i}" for i in range(20)), lambda k: " ".join(f"own{k}x{i}" for i in range(15))
    rows = [(1, f"{own(1)} {passage}"), (7, f"{passage} {own(7)} {passage} {own(70)} {passage}"), (7, f"{own(71)} {passage} {own(72)} {passage}"), (7, f"{own(71)} {passage} {own(72)} {passage}")]
    rows += [(None, f"{own(80)} {passage} {passage}"), (None, f"{passage} {own(81)} {passage}"), (8, "y " * 60), (9, "y " * 90)]
    # The smaller ids are in other partitions than the larger.
    one, two = (spark.sparkContext.parallelize(r, 1) for r in (rows[:1] + rows[6:7], rows[1:6] + rows[7:]))
    df = spark.createDataFrame(one.union(two), "doc_id long, text string")
    assert df.rdd.getNumPartitions() == 2
    assert Counter(tuple(r) for r in substring.remove_repeats(df).collect()) == brute_removal(rows)


def test_windows_of_equal_hashes_are_told_apart_by_words():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "a" * 9, "c" * 1500], 2)) for _ in range(40)]
    raw = "".join(texts).encode()
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    differ = substring._Differ(np.frombuffer(raw + bytes(16), np.uint8), start, end)
    doc, same = rng.integers(0, 12, 40), np.zeros(40, np.uint64)
    flagged, again = substring.later(same, same, doc, np.arange(40), differ)
    assert flagged.tolist() == [any(x == t and e < d for x, e in zip(texts, doc, strict=True)) for t, d in zip(texts, doc, strict=True)]
    assert not again.any()
    table = substring._Bucket(2)
    table.held = (same, same, doc, np.arange(40), np.zeros(40, "<i4"), start, end)
    table.text = np.frombuffer(raw, np.uint8)
    table.new = [(np.zeros(0, np.uint8), tuple(x[:0] for x in table.held))]
    ((gone, *_),) = table.settle()
    assert sorted(gone.tolist()) == sorted(doc[flagged].tolist())
    assert [table.text[a:b].tobytes().decode() for a, b in zip(table.held[5], table.held[6], strict=True)] == [t for t, f in zip(texts, flagged, strict=True) if not f]


def test_substring_of_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage, 1, 2, 3), (2, passage + " own", 4, 5, 6)], "doc_id long, text string, `a.b` int, _dest int, _doc int")
    assert sorted(tuple(r) for r in substring.remove_repeats(df, output="texts").collect()) == [(1, passage, 1, 2, 3), (2, "own", 4, 5, 6)]


def test_substring_texts_keep_columns(docs, no_docs):
    out = substring.remove_repeats(docs, output="texts")
    assert out.columns == docs.columns
    by = defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append(r)
    assert 2 not in by and by[1][0].text == ROWS[0][1] and by[4][0].text is None
    assert by[12][0].text == "and then other words follow here" and by[12][0].n_chars == 32
    assert substring.remove_repeats(no_docs, output="texts").count() == substring.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("rows", "few"), [(ROWS, 24), (near_copies(90, 5), 2)], ids=["odd", "families"])
def test_components(spark, rows, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == brute_components(rows)


def test_components_of_nothing(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_viable_members_lose_no_pair():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = np.sort(rng.integers(1, 60, 12))
        pos = (rng.random(12) * jaccard.prefix_size(n)).astype(np.int64)
        keep = jaccard._viable(n, pos)
        for i in range(12):
            for j in range(12):
                if i != j and jaccard.allowed(n[i], pos[i], n[j], pos[j]):
                    assert keep[i] and keep[j]


BENCH = [(1, "the quick brown fox jumps over the lazy dog near the river bank"), (2, "x 3000"), (3, None), (4, "..."), (10, "Epsilon zeta, ETA theta"), (1, "delta epsilon zeta eta")]


def brute_hits(rows, n=10):
    windows = defaultdict(set)
    for item, t in BENCH:
        w = ALNUM.findall(ascii_lower(t))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = Counter()
    for d, t in rows:
        w, hit, items = ALNUM.findall(ascii_lower(t)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= got
        names = ",".join(sorted(map(str, items)))
        out[d, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(spark, docs, no_docs, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, bench, block_bytes=block).collect())
    assert got == brute_hits(ROWS)
    assert decontaminate.contamination(no_docs, bench, block_bytes=block).count() == 0
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in brute_hits(ROWS).items() if not k[5] for _ in range(n))


def test_contamination_without_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_items_without_id_hit(spark, block):
    bench = spark.createDataFrame([(None, "secret words here"), (5, "other words there")], "item_id long, text string")
    df = spark.createDataFrame([(1, "some Secret, words: HERE stay"), (2, "nothing of it"), (3, "other words there and secret words here")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r["items"]) for r in decontaminate.contamination(df, bench, block_bytes=block).collect()}
    assert got == {1: (3, 0, True, []), 2: (0, 0, False, []), 3: (6, 1, True, [5])}
    assert [r.doc_id for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()] == [2]


def brute_spans(text, items, n=10):
    """The text without its hit words; windows are judged on the input."""
    if text is None:
        return None
    windows = set()
    for t in items:
        w = ALNUM.findall(ascii_lower(t))
        size = min(n, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1 if size else 0)}
    found = list(ALNUM.finditer(ascii_lower(text)))
    hit = {k for size in {len(x) for x in windows} for i in range(len(found) - size + 1) if tuple(m.group() for m in found[i : i + size]) in windows for k in range(i, i + size)}
    gone = {c for k in hit for c in range(*found[k].span())}
    return "".join(c for i, c in enumerate(text) if i not in gone)


SPAN_ITEMS = [(1, "b c"), (2, "c d"), (None, "a d"), (3, "secret words here"), (4, None), (5, " ".join(f"w{i}" for i in range(14))), (1, "é ß")]
SPAN_TEXTS = [(1, "a b c d x"), (2, None), (3, ""), (4, "some Secret, words: HERE stay"), (None, "A d and a; D"), (5, "pre " + " ".join(f"w{i}" for i in range(3, 14)) + " w99"), (5, "x É, é ß b-c"), (6, "nothing")]


@pytest.mark.parametrize("block", [8 << 20, 1 << 10, 20])
def test_removal_does_not_depend_on_the_size_of_a_block(spark, block):
    bench = spark.createDataFrame(SPAN_ITEMS, "item_id long, text string")
    rows = [(d, t, i, "k") for i, (d, t) in enumerate(SPAN_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, key string").repartition(2)
    items = [t for _, t in SPAN_ITEMS if t]
    spans = decontaminate.decontaminate(df, bench, remove="spans", block_bytes=block)
    assert spans.columns == df.columns
    assert Counter(tuple(r) for r in spans.collect()) == Counter((d, brute_spans(t, items), i, k) for d, t, i, k in rows)
    whole = decontaminate.decontaminate(df, bench, block_bytes=block)
    assert Counter(tuple(r) for r in whole.collect()) == Counter(r for r in rows if brute_spans(r[1], items) == r[1])


def brute_verdict(t, limits=quality.Limits()):
    """(covered words, longest repeat, kept), by comparing all suffixes."""
    w = SPACED.findall(t or "")
    n, longest, covered = len(w), 0, set()
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= limits.min_repeat:
            covered |= set(range(i, i + best))
    kept = not brute_quality(t)[5] and 100 * len(covered) <= limits.max_covered_percent * n and longest <= limits.max_longest and 100 * longest <= limits.max_longest_percent * n
    return len(covered), longest, kept


def test_verdicts(spark):
    rng, rows = np.random.default_rng(5), [(d, t) for d, t in ROWS if len(t or "") < 2000]
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(20, 160)))]
        for _ in range(int(rng.integers(0, 4))):
            a, size = int(rng.integers(0, len(w))), int(rng.integers(3, 40))
            at = int(rng.integers(0, len(w)))
            w[at:at] = w[a : a + size]
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_covered, r.longest_repeat, r.kept) for r in quality.quality(df).collect())
    assert got == Counter((d, *brute_verdict(t)) for d, t in rows)
    # The verdict isn't that of the base rule.
    assert 5 < sum(r.kept for r in quality.quality(df).collect()) < quality.quality(df).filter("NOT base_failed").count()


def test_quality_of_clashing_names(spark):
    df = spark.createDataFrame([(1, " ".join(f"o{i}" for i in range(60)), 5, 6, 7), (2, "short", 5, 6, 7)], "doc_id long, text string, `my col` int, _kept int, `a.b` int")
    assert [tuple(r) for r in quality.kept_documents(df).collect()] == [(1, " ".join(f"o{i}" for i in range(60)), 5, 6, 7)]
    assert quality.quality(df, with_columns=True).columns == [*df.columns, "_kept"]


def brute_quality(t):
    w = SPACED.findall(t or "")
    n, seen, dup = len(w), set(), 0
    grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeat = {k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def test_quality(spark, docs, no_docs):
    lines = [(20, "a b c\na b c\n\n \na b c\r\n#x | y\n" * 7), (21, " ".join(f"w{i}" for i in range(60))), (22, " ".join(f"w{i % 30}" for i in range(120)))]
    rows = ROWS + lines
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(df).collect())
    assert got == Counter((d, *brute_quality(t)) for d, t in rows)
    assert quality.quality(no_docs).count() == 0
    marked = quality.quality(docs, with_columns=True)
    assert marked.columns == [*docs.columns, "_kept"] and marked.count() == len(ROWS)


def test_longest_repeats():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(list("ab"), int(rng.integers(0, 30)))) for _ in range(4)]
        w = Words(*buffers(pa.array(texts)))
        got, at = quality.longest_repeats(w), 0
        for t in texts:
            ws = t.split()
            for i in range(len(ws)):
                best = 0
                for j in range(len(ws)):
                    k = 0
                    while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                        k += 1
                    best = max(best, k)
                assert got[at] == best
                at += 1


def test_default_limits_of_the_method_bind(spark):
    own = lambda n: " ".join(f"o{i}" for i in range(n))
    block = lambda n: " ".join(f"r{i}" for i in range(n))
    halves = [f"b{k}x{i}" for k in range(2) for i in range(10)]
    rows = [
        (1, f"{block(20)} {own(80)} {block(20)}"),  # a third covered
        (2, f"{own(160)} {'x ' * 40}"),  # a fifth covered, by a repeat of 39 words
        (3, f"{' '.join(halves)} {own(80)} {' '.join(halves[10:] + halves[:10])}"),  # a third covered by short repeats
        (4, f"{block(15)} {own(90)} {block(15)}"),  # a quarter covered
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.n_covered, r.longest_repeat) for r in quality.quality(df).collect()}
    assert got == {1: (False, False, 40, 20), 2: (False, False, 40, 39), 3: (False, False, 40, 10), 4: (False, True, 30, 15)}


def test_method_rejects_long_repeats(spark):
    block = " ".join(f"r{i}" for i in range(120))
    other = " ".join(f"o{i}" for i in range(300))
    df = spark.createDataFrame([(1, f"{block} {other}"), (2, f"{block} {other} {block} {' '.join(f'p{i}' for i in range(120))}")], "doc_id long, text string")
    limits = quality.Limits(max_longest=100)
    assert {r.doc_id: (r.kept, r.longest_repeat) for r in quality.quality(df, limits).collect()} == {1: (True, 0), 2: (False, 120)}


def test_orders_after_the_first_let_every_similar_pair_through():
    rng = np.random.default_rng(11)
    levels = rng.integers(0, 16, 1 << 10).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        common = int(rng.integers(0, n + 1))
        a, b = np.unique(base[:n]), np.unique(np.concatenate((base[:common], base[n : 2 * n - common])))
        raw = [np.frombuffer(jaccard.marks(x, levels), np.uint32) for x in (a, b)]
        sizes = [1 + int(x[0]) for x in raw]
        met = [bool(np.intersect1d(x, y).size) for x, y in ((raw[0][1 : sizes[0]], raw[1][1 : sizes[1]]), (raw[0][sizes[0] :], raw[1][sizes[1] :]))]
        assert met == [jaccard._meet(raw[0][1 : sizes[0]], raw[1][1 : sizes[1]]), jaccard._meet(raw[0][sizes[0] :], raw[1][sizes[1] :])]
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert all(met)
        assert met == [bool(np.intersect1d(jaccard.prefix(a, levels, k), jaccard.prefix(b, levels, k)).size) for k in (1, 2)]
    assert jaccard.marks(np.zeros(0, np.uint64), levels) == np.zeros(1, np.uint32).tobytes()


def test_index_of_items_is_flat(monkeypatch):
    """Up to ten times its text, and right where all hashes agree."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(3000)]
    index = decontaminate.Index(items)
    assert index.nbytes() <= 10 * sum(len(t) for _, t in items)
    texts = [items[5][1] + " x " + items[7][1], "none of it", items[9][1].upper()]
    want = decontaminate.Index(items[:12]).scan(*buffers(pa.array(texts)))[1:]
    monkeypatch.setattr(Words, "window_hashes", lambda self, first, n, which=0: np.full(len(first), 7, np.uint64))
    hit, found = decontaminate.Index(items[:12]).scan(*buffers(pa.array(texts)))[1:]
    assert found == want[1] and (hit == want[0]).all()
