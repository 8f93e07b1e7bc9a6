"""Near-duplicate documents by SimHash: pigeonhole blocks, verified, without all pairs of a group.

A fingerprint is cut into m blocks. Two that differ in at most four bits differ in
four blocks at most, so they agree in some m - 4 of them: a row for each choice of
m - 4 blocks brings close ones into one bucket. m follows from the number of different
fingerprints, so that buckets stay small where fingerprints are unlike.

Equal fingerprints are one class. In a bucket each pair is compared, and the links
found are thinned to a forest before they leave the task. Fingerprints of larger
buckets, which only large families of near copies make, go another way, which is
linear in them: two fingerprints are within four bits exactly if there is a third
one within two bits of each, so each is sent to all that are within two bits of it,
of which there are 2081, and those that meet are linked. No fingerprint meets more
than as many others there.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, ids, longs, plan_bytes, staged
from .components import components, labelled
from .substring import spaced
from .words import LOWER, SPACED, Words, buffers, chunks, release

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, DIFFERENT = 4, 42, 4
#: Different fingerprints of a bucket whose pairs are compared.
COMPARED = 4096
#: Bytes of text that are hashed at once, shingles whose bits are counted at once, and found pairs that are held at once.
HASHED_BYTES, COUNTED, HELD_PAIRS = 1 << 20, 1 << 16, 1 << 20
#: Bytes of text for a part of the tables about classes, rows of a part of the buckets, and rows of keys up to which they are broadcast.
PART_BYTES, BUCKET_ROWS, BROADCAST_KEYS = 64 << 20, 1_000_000, 500_000

# Primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans are hashed one by one.
_STEPPED = 4096


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _taken(acc, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of text[start:end] for each span, all spans a step at a time. The text has 8 bytes more than the last span."""
    size, seed = ends - starts, np.uint64(seed)
    eight, four = (np.ndarray((len(text) - 7,), t, text.data, strides=(1,)) for t in ("<u8", "<u4"))
    h = np.full(len(size), seed + _P5)
    long = np.flatnonzero((size >= 32) & (size <= _STEPPED))
    with np.errstate(over="ignore"):
        if len(long):
            lanes = [np.full(len(long), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            stripes, some, k = size[long] // 32, np.arange(len(long)), 0
            while len(some):
                for j, lane in enumerate(lanes):
                    lane[some] = _taken(lane[some], eight[starts[long[some]] + 32 * k + 8 * j])
                k += 1
                some = some[stripes[some] > k]
            merged = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ _taken(np.uint64(0), lane)) * _P1 + _P4
            h[long] = merged
        h += size.astype(np.uint64)
        at = starts + (size & ~31)
        for _ in range(3):
            some = np.flatnonzero(ends - at >= 8)
            h[some] = _turn(h[some] ^ _taken(np.uint64(0), eight[at[some]]), 27) * _P1 + _P4
            at[some] += 8
        some = np.flatnonzero(ends - at >= 4)
        h[some] = _turn(h[some] ^ four[at[some]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[some] += 4
        for _ in range(3):
            some = np.flatnonzero(ends > at)
            h[some] = _turn(h[some] ^ text[at[some]].astype(np.uint64) * _P5, 11) * _P1
            at[some] += 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > _STEPPED).tolist():
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].tobytes(), int(seed))
    return h


def fingerprints(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a chunk; zero without words."""
    w = Words(buf, offsets, SPACED, hashes=0)
    text, starts, ends = spaced(w)
    text, counts = LOWER[text], w.counts
    out = np.zeros(len(counts), np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    out[short] = xxh64(text, starts[w.bounds[short]], ends[w.bounds[short] + counts[short] - 1])
    first = w.windows(n)
    doc = np.searchsorted(w.bounds, first, "right") - 1
    h = xxh64(text, starts[first], ends[first + n - 1])
    # Documents of some shingles, and how often each bit is set in them.
    many = np.flatnonzero(counts >= n)
    row = np.zeros(len(counts), np.int64)
    row[many] = np.arange(len(many))
    ones = np.zeros((len(many), 64), np.uint32)
    for x in range(0, len(h), COUNTED):
        of = row[doc[x : x + COUNTED]]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bits = np.unpackbits(h[x : x + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.uint32)
    set_ = 2 * ones.astype(np.int64) > (counts[many] - n + 1)[:, None]
    out[many] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits), one per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1)), HASHED_BYTES):
                yield from batches([longs(key[i:j]), pa.array(fingerprints(buf, offsets).view(np.int64))], schema)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


def masks(n: int, different: int = DIFFERENT) -> list[int]:
    """Bits that are kept of a fingerprint, one mask for each choice of blocks, for n different fingerprints.

    More blocks make longer keys, so fewer chance meetings, and more rows; the number of blocks is the cheapest.
    """

    def cost(m: int) -> float:
        return comb(m, different) * n * (1 + n / 2 / 2 ** (64 * (m - different) / m))

    m = min(range(different + 1, different + 7), key=cost)
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << y) - (1 << x) for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, m - different)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least member of each of n things' components under links a, b, on top of those of `root`."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _met(table: np.ndarray, key: np.ndarray, rep: np.ndarray, fp: np.ndarray, most: int, different: int):
    """Links of whole buckets, rows of one (table, key) being neighbours: each class and the first of its bucket that links lead to."""
    same = (table[1:] == table[:-1]) & (key[1:] == key[:-1])
    at, root, a, b, held = np.flatnonzero(same), np.arange(len(fp)), [], [], 0
    d = 1
    while len(at) and d < most:
        close = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= different
        a.append(at[close])
        b.append(at[close] + d)
        held += len(a[-1])
        if held > HELD_PAIRS:
            root, a, b, held = roots(len(fp), np.concatenate(a), np.concatenate(b), root), [], [], 0
        # i and i + d + 1 share a bucket if i and i + d do, and the next two.
        at = at[at + d + 1 < len(fp)]
        at = at[same[at + d]]
        d += 1
    if a:
        root = roots(len(fp), np.concatenate(a), np.concatenate(b), root)
    some = np.flatnonzero(root != np.arange(len(fp)))
    return rep[some], rep[root[some]]


def _bit(i: Column) -> Column:
    return F.when(i < 0, 0).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))


def around(members: DataFrame) -> DataFrame:
    """Links of fingerprints that are within four bits, by the fingerprints within two bits of each: members has rep, fp."""
    i, j = F.col("i"), F.col("j")
    first = members.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(62))))
    both = first.withColumn("j", F.explode(F.sequence(F.when(i < 0, i).otherwise(i + 1), F.lit(63))))
    hubs = both.select("rep", F.col("fp").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)).alias("hub"))
    # At most 2081 different fingerprints share a hub.
    before = F.lag("rep").over(Window.partitionBy("hub").orderBy("rep"))
    return hubs.select(F.col("rep").alias("a"), before.alias("b")).filter("b IS NOT NULL").distinct()


def close_links(classes: DataFrame, compared: int = COMPARED) -> DataFrame:
    """a, b: links that join all classes (fp, rep) whose fingerprints differ in up to DIFFERENT bits, no more of them than needed in a bucket."""
    n = classes.count()
    kept = masks(n)
    keys = classes.select("rep", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in kept))).alias("table", "key"))
    parts = max(12, -(-n * len(kept) // BUCKET_ROWS))
    large = staged(keys.groupBy("table", "key").count().filter(F.col("count") > compared).select("table", "key"), parts)
    n_large = large.count()
    held = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(it):
        left: list[np.ndarray] | None = None
        for batch in it:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            # The last bucket may go on in the next batch.
            other = np.flatnonzero((now[0] != now[0][-1:]) | (now[1] != now[1][-1:]))
            cut = int(other[-1]) + 1 if len(other) else 0
            left = [x[cut:] for x in now]
            if cut:
                yield from batches(list(_met(*(x[:cut] for x in now), compared, DIFFERENT)), schema)
        if left is not None:
            yield from batches(list(_met(*left, compared, DIFFERENT)), schema)

    small = keys.join(held, ["table", "key"], "left_anti") if n_large else keys
    met = small.select("table", "key", "rep", "fp").repartition(parts, "table", "key").sortWithinPartitions("table", "key").mapInArrow(meet, "a long, b long")
    if not n_large:
        return met
    members = staged(keys.join(held, ["table", "key"], "left_semi").select("rep", "fp").distinct(), parts)
    return met.unionByName(around(members))


def near_copies(docs: DataFrame, compared: int = COMPARED) -> DataFrame:
    """doc_id, fingerprint, component_id; one per input row.

    component_id is the smallest doc_id that links lead to. Null and empty texts,
    and those without words, have fingerprint zero and are linked like any other; with
    fewer words than a shingle's the whole sequence is the one shingle. A row without
    id has no component and links nothing. Rows with one id are one document with the
    links of each. Other columns are not read; an empty table gives an empty result.
    """
    parts = max(12, -(-plan_bytes(docs) // PART_BYTES))
    rows = staged(described(docs))
    classes = staged(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), parts)
    out = labelled(rows, ["fp"], components(close_links(classes, compared), parts), parts=parts)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
