"""Near-duplicate documents: an n-gram Jaccard join by prefixes under several global orders.

Two sets of similarity t share at least t of the larger one, so under any one
order of all shingles their prefixes (the first n - ceil(t n) + 1) have a
shingle in common. Three orders are used, all rare shingles first (by a sketch
of document frequencies of fixed size), each with its own order among equally
rare ones. Prefixes under the first order make candidates; these are intersected
with the other orders by hashes of their prefixes alone, and only for the pairs
that are left do whole sets travel, to be compared exactly.

Equal sets are one class, known by its smallest document. A shingle in the
prefixes of few classes makes all their pairs; one in many makes a star around a
leader, then a few pairs a member; pairs in one component are settled, and those
that are left are compared. No link between different components is
lost, and a large group of near copies costs a few stars, not all its pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batches, ids, longs, plan_bytes, staged
from .components import components, labelled
from .words import SPACED, Words, buffers, chunks, mix, release

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (75, 100)
#: Orders that candidates are held against after the first.
SEEDS = tuple(np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8))
#: log2 of the sketch's least and most counters.
SKETCH_LEAST, SKETCH_MOST, SKETCH_PARTS = 16, 24, 32
#: Classes of a prefix shingle up to which all pairs are made.
FEW = 24
#: Rounds of few pairs for shingles of more classes, before all that are left.
ROUNDS = 2
#: Partners that a member meets in each of those rounds.
PARTNERS = 6
#: Bytes of text whose prefixes are posted together.
POSTED_TOGETHER = 3 << 20
#: Bytes of input for a bucket of prefixes and for a part of what they lead to, and ids up to which a list of them is broadcast.
POSTED_BYTES, BUCKET_BYTES, BROADCAST_IDS = 20 << 20, 40 << 20, 1_000_000


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted within each, and bounds."""
    w = Words(buf, offsets, SPACED, lower=True)
    docs, counts = w.doc(), w.counts
    first = w.windows(n)
    h, d = w.window_hashes(first, n), docs[first]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            h = np.append(h, w.window_hashes(w.bounds[short], size))
            d = np.append(d, short)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(offsets)))


def _class(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's set."""
    out = []
    for seed in SEEDS[:2]:
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ seed), dtype=np.uint64)))
        out.append(mix(c[bounds[1:]] - c[bounds[:-1]] + seed).view(np.int64))
    return out[0], out[1]


def order_key(h: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """Place in the k-th global order: rarity level first, then a hash."""
    level = levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(60) | mix(h ^ SEEDS[k]) >> np.uint64(4)


def prefix_size(n):
    """Shingles of a set of n of which a similar set must have one."""
    a, b = SIMILAR
    return n - (a * n + b - 1) // b + 1


def prefix(h: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    n = prefix_size(len(h))
    return h[np.argpartition(order_key(h, levels, k), n - 1)[:n]] if n < len(h) else h


def _squeeze(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays], protocol=5))


def _expand(raw: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, t) for t, b in pickle.loads(zstandard.ZstdDecompressor().decompress(raw))]


_DOCS = "doc_id long, n long, c1 long, c2 long, part int, payload binary"


def describe(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Each document's set size and class; and rarity levels by sketch cell, from counts over all documents."""
    words = max(1, plan_bytes(docs) // 4)
    cells = 1 << int(np.clip(np.ceil(np.log2(words / 16)), SKETCH_LEAST, SKETCH_MOST))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])

    def count(it):
        seen = np.zeros(cells, np.uint32)
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1))):
                h, bounds = shingles(buf, offsets)
                np.add.at(seen, (h & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
                c1, c2 = _class(h, bounds)
                none = pa.nulls(j - i)
                yield from batches([longs(key[i:j]), np.diff(bounds), c1, c2, none.cast(pa.int32()), none.cast(pa.binary())], schema)
        if seen.any():
            raw = [_squeeze(x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32)) for x in np.split(seen, SKETCH_PARTS)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield from batches([none, none, none, none, np.arange(SKETCH_PARTS, dtype=np.int32), pa.array(raw, pa.binary())], schema)

    found = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, _DOCS))

    def merge(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _expand(raw)[0].astype(np.uint64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_squeeze(x)], pa.binary())], names=["part", "payload"])

    parts = found.filter("part IS NOT NULL").select("part", "payload").repartition(SKETCH_PARTS, "part").mapInArrow(merge, "part int, payload binary")
    # One value a cell, of which there is a fixed number at most.
    sums = {r["part"]: _expand(bytes(r["payload"]))[0] for r in parts.collect()}
    levels = np.zeros(cells, np.uint8)
    if sums:
        c = np.concatenate([sums[k] for k in range(SKETCH_PARTS)]).astype(float)
        usual = c.mean() + 4 * np.sqrt(c.mean()) + 4
        levels = np.where(c > usual, np.clip(np.log2(np.maximum(c, 1) / usual) + 1, 1, 15), 0).astype(np.uint8)
    return found.filter("part IS NULL").select("doc_id", "n", "c1", "c2"), levels


_POSTED = "bucket int, payload binary"


def _post(buf, offsets, key, levels, buckets):
    """A chunk's prefixes under the first order, by bucket; of equal sets only the smallest document's."""
    h, bounds = shingles(buf, offsets)
    n = np.diff(bounds)
    c1, _ = _class(h, bounds)
    order = np.lexsort((key, n, c1))
    first = np.ones(len(order), bool)
    first[1:] = (c1[order][1:] != c1[order][:-1]) | (n[order][1:] != n[order][:-1])
    mine = np.zeros(len(n), bool)
    mine[order[first]] = True
    mine &= (n > 0) & (key != NULL_ID)
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.lexsort((order_key(h, levels, 0), doc))
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    chosen = (place < np.repeat(prefix_size(n), n)) & np.repeat(mine, n)
    token, of, pos = h[rank[chosen]], doc[rank[chosen]], place[chosen].astype(np.uint32)
    bucket = (token % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((token, bucket))
    token, of, pos, bucket = token[order], of[order], pos[order], bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    out = []
    for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        some, at = np.unique(of[x:y], return_inverse=True)
        out.append(_squeeze(token[x:y], at.astype(np.uint16 if len(some) < 65536 else np.uint32), pos[x:y], key[some], n[some].astype(np.int32), c1[some]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])


def leader_of(n: np.ndarray, doc: np.ndarray) -> int:
    """The member around which a list's star is made: the same in every list where it is a member."""
    return int(np.argmin(mix(doc.astype(np.uint64))))


def comparable(a, b):
    """Whether sets of these sizes can be similar."""
    return SIMILAR[1] * np.minimum(a, b) >= SIMILAR[0] * np.maximum(a, b)


def _viable(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Members (sorted by size) that the bound of positions may allow some partner; see least_common."""
    room = n - pos
    sizes, at = np.unique(n, return_inverse=True)
    most = np.zeros(len(sizes), np.int64)
    np.maximum.at(most, at, room)
    if len(sizes) > 4096:
        return np.ones(len(n), bool)
    out = np.zeros(len(n), bool)
    for k, x in enumerate(sizes.tolist()):
        mine = at == k
        ok = comparable(sizes, x)
        least = least_common(sizes[ok], x)
        # The smallest overlap asked for by a size whose roomiest member can give it.
        able = least[most[ok] >= least]
        if len(able):
            out[mine] = room[mine] >= able.min()
    return out


def allowed(n_a, pos_a, n_b, pos_b):
    """Whether sets of these sizes that first meet at these positions can be similar."""
    return comparable(n_a, n_b) & (np.minimum(n_a - pos_a, n_b - pos_b) >= least_common(n_a, n_b))


def least_common(a, b):
    """Shingles that similar sets of these sizes share at least."""
    t, u = SIMILAR
    return -(-t * (a + b) // (t + u))


_FOUND = "a long, b long, list long, members binary"


def _candidates(payloads: list[bytes]):
    """Pairs, and lists of many members, of one bucket's prefixes."""
    token, at, pos, doc, n, c1, base = [], [], [], [], [], [], 0
    for p in payloads:
        t, i, q, d, m, c = _expand(p)
        token.append(t)
        pos.append(q)
        at.append(i.astype(np.int64) + base)
        doc.append(d)
        n.append(m)
        c1.append(c)
        base += len(d)
    if not token:
        return
    token, at, pos, doc, n, c1 = (np.concatenate(x) for x in (token, at, pos, doc, n, c1))
    # Classes of the whole bucket, each known by its smallest document.
    order = np.lexsort((doc, n, c1))
    new = np.ones(len(order), bool)
    new[1:] = (c1[order][1:] != c1[order][:-1]) | (n[order][1:] != n[order][:-1])
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    doc, n = doc[order][new], n[order][new].astype(np.int64)
    at = own[at]
    order = np.argsort(token, kind="stable")
    token, at, pos = token[order], at[order], pos[order].astype(np.int64)
    same = token[1:] == token[:-1]
    some = np.zeros(len(token), bool)
    some[1:] |= same
    some[:-1] |= same
    token, at, pos = token[some], at[some], pos[some]
    order = np.lexsort((doc[at], n[at], token))
    token, at, pos = token[order], at[order], pos[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1])
    token, at, pos = token[new], at[new], pos[new]
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(token)))
    # Of long lists only members stay that have room for a partner of some size there is.
    keep = np.ones(len(token), bool)
    for x, g in zip(head[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        m = slice(x, x + g)
        keep[m] = _viable(n[at[m]], pos[m])
    token, at, pos = token[keep], at[keep], pos[keep]
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(token)))
    in_few = np.repeat(size <= FEW, size)
    left, right = [], []
    for d in range(1, FEW):
        i = np.flatnonzero((token[d:] == token[:-d]) & in_few[d:])
        left.append(i)
        right.append(i + d)
    lists: dict[int, bytes] = {}
    for x, g in zip(head[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        m = at[x : x + g]
        left.append(np.full(g, x + leader_of(n[m], doc[m])))
        right.append(np.arange(x, x + g))
        lists[int(token[x])] = _squeeze(doc[m], n[m], pos[x : x + g])
    i, j = np.concatenate(left), np.concatenate(right)
    # A pair's first common shingle leaves at most so many; at others the test may fail, or let it pass in vain.
    left, right = at[i], at[j]
    ok = (left != right) & allowed(n[left], pos[i], n[right], pos[j])
    pair = np.unique(np.minimum(left, right)[ok] * len(n) + np.maximum(left, right)[ok])
    a, b = doc[pair // len(n)] if len(n) else pair, doc[pair % len(n)] if len(n) else pair
    yield np.minimum(a, b), np.maximum(a, b), lists


def candidates(docs: DataFrame, levels) -> DataFrame:
    """Rows a, b (candidate pairs) or list, members (prefix shingles of many classes)."""
    buckets = min(1 << 17, max(12, -(-plan_bytes(docs) // POSTED_BYTES)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64()), ("members", pa.binary())])

    def post(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1)), POSTED_TOGETHER):
                yield from _post(buf, offsets, key[i:j], levels.value, buckets)
        release()

    def meet(it):
        by: dict[int, list[bytes]] = {}
        for b in it:
            for bucket, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(bucket, []).append(p)
        while by:
            for a, b, lists in _candidates(by.popitem()[1]):
                none = pa.nulls(len(a))
                yield from batches([a, b, none.cast(pa.int64()), none.cast(pa.binary())], schema)
                none = pa.nulls(len(lists), pa.int64())
                yield from batches([none, none, np.array(list(lists), np.uint64).view(np.int64), pa.array(list(lists.values()), pa.binary())], schema)
            release()

    posted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(post, _POSTED).repartitionById(buckets, F.col("bucket"))
    return staged(posted.mapInArrow(meet, _FOUND))


def _attached(pairs: DataFrame, docs: DataFrame, make) -> DataFrame:
    """a, b, set_a, set_b: what make(set) gives of the documents of each pair.

    Only documents in pairs are made; each b's travels to its pairs, then with them
    to a's, whose many pairs Spark may split.
    """
    need = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), max(12, -(-plan_bytes(docs) // BUCKET_BYTES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = need.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(need) if few else need, "doc_id", "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])

    def sets(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1))):
                h, bounds = shingles(buf, offsets)
                yield from batches([key[i:j], pa.array([make(h[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.binary())], schema)

    held = rows.mapInArrow(sets, "doc_id long, set binary")
    both = pairs.select("a", "b").join(held.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.join(held.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")


def marks(h: np.ndarray, levels: np.ndarray) -> bytes:
    """32-bit hashes of a set's prefixes under the orders after the first: the size of the second order's, then both, ascending."""
    two = [np.unique(mix(prefix(h, levels, k)).astype(np.uint32)) for k in (1, 2)]
    return np.concatenate(([np.uint32(len(two[0]))], *two)).astype(np.uint32).tobytes()


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays share a value."""
    if not len(a) or not len(b):
        return False
    return bool((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).any())


def every_order(pairs: DataFrame, docs: DataFrame, levels, parts: int) -> DataFrame:
    """Of the first order's candidate pairs those that share prefix shingles under the other orders too.

    Only hashes of those prefixes travel: about an eighth of a set's bytes for each
    order. Equal hashes of different shingles let a pair through, never the reverse.
    """

    def through(it):
        for batch in it:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.zeros(len(a), bool)
            for i, (raw_a, raw_b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(raw_a.as_buffer(), np.uint32), np.frombuffer(raw_b.as_buffer(), np.uint32)
                m, k = 1 + int(x[0]), 1 + int(y[0])
                keep[i] = _meet(x[1:m], y[1:k]) and _meet(x[m:], y[k:])
            yield from batches([a[keep], b[keep]], _PAIRS)
        release()

    met = _attached(pairs, docs, lambda h: marks(h, levels.value)).mapInArrow(through, "a long, b long")
    return staged(met.distinct(), parts)


def compare(pairs: DataFrame, docs: DataFrame, levels) -> DataFrame:
    """a, b, inter, total: exact sizes of intersection and union of the pairs that every order lets through."""
    out = pa.schema([(x, pa.int64()) for x in ("a", "b", "inter", "total")])

    def verify(it):
        for batch in it:
            found = []
            for a, b, raw_a, raw_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(raw_a.as_buffer(), np.uint64), np.frombuffer(raw_b.as_buffer(), np.uint64)
                if len(x) and len(y):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    found.append((a, b, both, len(x) + len(y) - both))
            if found:
                yield from batches([np.array(c) for c in zip(*found, strict=True)], out)
        release()

    met = every_order(pairs, docs, levels, max(12, -(-plan_bytes(docs) // BUCKET_BYTES)))
    return _attached(met, docs, lambda h: h.tobytes()).mapInArrow(verify, "a long, b long, inter long, total long")


def _members(lists: DataFrame) -> DataFrame:
    """list, doc, n, pos of prefix shingles of many classes."""
    schema = pa.schema([("list", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def members(it):
        for b in it:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc, n, pos = _expand(raw)
                yield from batches([np.full(len(doc), key), doc, n, pos], schema)

    return lists.mapInArrow(members, "list long, doc long, n long, pos long")


def _open(members: DataFrame, known: DataFrame) -> DataFrame:
    """m: members (n, doc, pos, component) of the lists that are not in one component yet."""
    rows = members.join(known.select(F.col("node").alias("doc"), "component"), "doc", "left")
    member = F.struct("n", "doc", "pos", F.coalesce("component", "doc").alias("component"))
    grouped = rows.groupBy("list").agg(F.collect_list(member).alias("m"), F.min(F.coalesce("component", "doc")).alias("c0"), F.max(F.coalesce("component", "doc")).alias("c1"))
    return grouped.filter("c0 <> c1").select(F.sort_array("m").alias("m"))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _arrays(m):
    return (x.to_numpy(zero_copy_only=False) for x in m.values.flatten())


def _some(open_lists: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
    """New pairs between components, a few for each member of an open list.

    A member meets a few members of other components, by a hash that changes with
    the turn; one link settles all pairs of two components.
    """

    def some(it):
        for batch in it:
            for m in batch.column(0):
                n, doc, pos, comp = _arrays(m)
                by = mix(doc.astype(np.uint64) ^ SEEDS[turn % len(SEEDS)] + np.uint64(turn))
                left, right = [], []
                for i in range(len(n)):
                    k = np.flatnonzero((comp != comp[i]) & allowed(n, pos, n[i], pos[i]))
                    if len(k):
                        k = k[np.argsort(mix(by[k] ^ by[i]))[:PARTNERS]]
                        left.append(np.full(len(k), doc[i]))
                        right.append(doc[k])
                if left:
                    x, y = np.concatenate(left), np.concatenate(right)
                    yield from batches([np.minimum(x, y), np.maximum(x, y)], _PAIRS)

    return open_lists.mapInArrow(some, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")


def _rest(open_lists: DataFrame, tried: DataFrame) -> DataFrame:
    """All other pairs of open lists that are in different components."""

    def pairs(it):
        for batch in it:
            for m in batch.column(0):
                n, doc, pos, comp = _arrays(m)
                for i in range(len(n)):
                    # Sorted by size: those that n[i] can be similar to end here.
                    k = np.arange(i + 1, np.searchsorted(n, n[i] * SIMILAR[1] // SIMILAR[0], "right"))
                    k = k[(comp[k] != comp[i]) & allowed(n[k], pos[k], n[i], pos[i])]
                    yield from batches([np.minimum(doc[i], doc[k]), np.maximum(doc[i], doc[k])], _PAIRS)

    return open_lists.mapInArrow(pairs, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")


def similar(found: DataFrame) -> DataFrame:
    return found.filter(F.col("inter") * SIMILAR[1] >= F.col("total") * SIMILAR[0]).filter("inter > 0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; one per input row.

    component_id is the smallest doc_id that links lead to. Null or empty text has
    no shingles and no links; fewer words than a shingle's are one shingle. A row
    without id has no component and links nothing. Rows with one id are one
    document with the links of each. Other columns are not read; an empty table
    gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    described, cells = describe(docs)
    levels = sc.broadcast(cells)
    found = candidates(docs, levels)
    # Pairs are far fewer than documents: so many parts hold them at any size of the input.
    parts = max(12, -(-plan_bytes(docs) // BUCKET_BYTES))
    tried = staged(found.filter("list IS NULL").select("a", "b").distinct(), parts)
    known = components(similar(compare(tried, docs, levels)).select("a", "b"), parts)
    members = staged(_members(found.filter("list IS NOT NULL").select("list", "members")))
    for turn in range(ROUNDS + 1 if not members.isEmpty() else 0):
        lists = staged(_open(members, known), parts)
        if lists.isEmpty():
            break
        new = staged(_rest(lists, tried) if turn == ROUNDS else _some(lists, tried, turn), parts)
        if new.isEmpty():
            continue
        more = staged(similar(compare(new, docs, levels)).select("a", "b").distinct(), parts)
        tried = tried.unionByName(new)
        if not more.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), parts)
    out = labelled(described, ["n", "c1", "c2"], known, F.col("n") > 0, parts)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
