import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from memlake.llm import simhash, trie
from memlake.llm.components import components, labelled

from .conftest import ROWS
from .test_text_operators import ascii_lower, near_copies

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = SPACED.findall(ascii_lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_close(rows):
    """rows: doc_id, fingerprint. The least id of each id's component, by all pairs."""
    ids = sorted({d for d, _ in rows if d is not None})
    prints = defaultdict(set)
    for d, f in rows:
        prints[d].add(f)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any((x ^ y).bit_count() <= 4 for x in prints[a] for y in prints[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def expected_copies(rows):
    printed = [(d, brute_fingerprint(t)) for d, t in rows]
    found = brute_close(printed)
    return Counter((d, f"{f:016x}", found.get(d)) for d, f in printed)


def test_hash_of_long_and_odd_spans():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 60_000).astype(np.uint8)
    starts = rng.integers(0, 30_000, 400)
    ends = starts + np.concatenate((np.arange(380), rng.integers(4000, 20_000, 20)))
    got = simhash.xxh64(raw, starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("compared", [4096, 3])
def test_copies_equal_brute_force(spark, compared):
    """With buckets of three at most, families go by the fingerprints around each."""
    rows = near_copies(80) + ROWS + [(200, "one two three"), (200, "four five six seven eight"), (201, "four five six seven eight"), (199, "one two three")]
    rows += [(300 + i, "the same words again and again but for the number at the end of it " * 4 + str(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in simhash.near_copies(df, compared).collect())
    assert got == expected_copies(rows)


@pytest.mark.parametrize("compared", [4096, 4])
def test_links_of_fingerprints(spark, compared):
    rng = np.random.default_rng(5)
    centres, prints = [int(x) for x in rng.integers(0, 1 << 63, 12)], set()
    for c in centres:
        for _ in range(15):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
            prints.add(x - (1 << 64) if x >> 63 else x)
    classes = [(i, f) for i, f in enumerate(sorted(prints))]
    df = spark.createDataFrame(classes, "rep long, fp long")
    known = components(simhash.close_links(df, compared))
    described = df.select(df.rep.alias("doc_id"), "fp")
    got = {r.doc_id: r.component_id for r in labelled(described, ["fp"], known).collect()}
    assert got == brute_close([(d, f & (1 << 64) - 1) for d, f in classes])


def test_copies_of_odd_tables(spark, docs, no_docs):
    got = Counter(tuple(r) for r in simhash.near_copies(docs).collect())
    assert got == expected_copies(ROWS)
    assert simhash.near_copies(no_docs).count() == 0


def test_masks_keep_close_prints_together():
    for n in (10, 10**6, 10**10):
        kept, rng = simhash.masks(n), np.random.default_rng(n % 97)
        for _ in range(200):
            x = int(rng.integers(0, 1 << 63))
            y = x
            for b in rng.integers(0, 64, 4):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in kept)


def brute_trie(rows, run=100, reused=6):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in said.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % reused
        base = c - (abs(c) % run) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    out = Counter()
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(n))
        out[m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def test_trie_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(-7, 0, "user", "hé"), (-7, 1, None, None), (-107, None, "user", "hé"), (None, 0, "user", "lost"), (900, None, None, None), (901, 1, "a", "b"), (901, 1, "a", "b"), (901, None, "z", "")]
    for c in [*range(0, 12), *range(100, 130), *range(305, 312), *range(-105, -95)]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], ["yes", "no", "", "long 🙂 answer"][int(rng.integers(4))]))
    rows += [(c, t, "user", f"turn {t}") for c in (400, 401, 402) for t in range(70)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, d string").repartition(3)
    want = brute_trie(rows)
    assert Counter(tuple(r) for r in trie.prefix_trie(df).collect()) == want
    # Conversations over several parts, and ids that travel as many strings.
    monkeypatch.setattr(trie, "PART_BYTES", 400)
    monkeypatch.setattr(trie, "ENDS_BYTES", 16)
    assert Counter(tuple(r) for r in trie.prefix_trie(df.repartition(5)).collect()) == want


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).count() == 0
