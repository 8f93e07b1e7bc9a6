"""Best-fit packing of token sequences.

A configuration is a multiset of lengths that fits a sequence. The configuration
linear program over the histogram of lengths (cover every length's count with as
few configurations as possible) is solved by multiplicative weights: each round
a knapsack dynamic program over exact lengths prices configurations under the
weights, near-best ones are used, and groups of lengths that are covered lose
weight. The fractional solution is rounded: configurations are made as often as it
says from the lengths there are. What no configuration took, and lengths under a
sixteenth of a sequence, go best-fit into the gaps. The averaged weights are a
solution of the dual program, whose value bounds the sequences from below. All
is on the histogram, whose size is that of the capacity, not of the data; rows
then look up their place by their rank among rows of their length.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches, ids, longs, quoted, staged
from .tokens import encoded

log = logging.getLogger(__name__)

#: Rounds of multiplicative weights if none is cut short, its step, and the most that a round may add to a group's cover.
ROUNDS, STEP, RISE = 80, 40.0, 0.4
#: Groups of lengths that have a weight each; a share of lengths has its own configuration priced in a round; a configuration's least share of the best price.
GROUPS, TURNS, NEAR = 256, 4, 0.98
#: Lengths up to this share of the capacity are left to best fit, unless they are most of the tokens.
SMALL = 1 / 16
#: Shares of the fractional solution that rounding makes; the fewest sequences win.
SHARES = (1.0, 0.95, 0.85)


def knapsack(values: np.ndarray, least: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value of each size up to capacity, and the last length taken for it (0: as one less).

    values has a length's value at its index, -inf where there is none; least is the smallest length.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    v, own = np.empty(capacity + 1), values[least:]
    for c in range(least, capacity + 1):
        k = c - least
        np.add(best[k::-1], own[: k + 1], out=v[: k + 1])
        j = int(v[: k + 1].argmax())
        if v[j] > best[c - 1]:
            best[c], last[c] = v[j], least + j
        else:
            best[c] = best[c - 1]
    return best, last


def taken(last: np.ndarray, c: int) -> list[int]:
    """The lengths of knapsack()'s choice for size c."""
    out = []
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
        c -= int(last[c]) or 1
    return out


@dataclass
class Solution:
    """Configurations (lengths, longest first) and how many of each; the group of each length; a lower bound of all that cover the histogram."""

    used: dict[tuple, float]
    group: dict[int, int]
    bound: float


def fractional(histogram: dict[int, int], capacity: int) -> Solution:
    """The configuration linear program of the histogram, by multiplicative weights."""
    sizes = np.array(sorted(histogram))
    n = np.array([histogram[x] for x in sizes.tolist()], float)
    middle = np.cumsum(n) - n / 2
    group = np.unique((middle * GROUPS / n.sum()).astype(int) if len(sizes) > GROUPS else np.arange(len(sizes)), return_inverse=True)[1]
    need, of = np.bincount(group, n), dict(zip(sizes.tolist(), group.tolist(), strict=True))
    volume, least = float((n * sizes).sum()) / capacity, int(sizes[0])
    cover, dual, done, used = np.zeros(len(need)), np.zeros(len(sizes)), 0.0, {}
    noise = np.random.default_rng(0)
    for turn in range(8 * ROUNDS):
        w = np.exp(np.clip(-STEP * (cover - done), -40, 3))[group]
        values = np.full(capacity + 1, -np.inf)
        values[sizes] = sizes * w * (1 + 0.02 * noise.random(len(sizes)))
        best, last = knapsack(values, least, capacity)
        dual += sizes * w / best[capacity]
        # The best configuration that has a length, for some of the lengths in turn.
        some = np.arange(turn % TURNS, len(sizes), TURNS) if len(sizes) > 4 * TURNS else np.arange(len(sizes))
        price = values[sizes[some]] + best[capacity - sizes[some]]
        near = some[price >= NEAR * best[capacity]]
        near = near if len(near) else some[np.argsort(-price)[:8]]
        made = [tuple(sorted([x, *taken(last, capacity - x)], reverse=True)) for x in sizes[near].tolist()]
        amount, rise, full = n[near] * w[near], np.zeros(len(need)), 0.0
        for x, lengths in zip(amount.tolist(), made, strict=True):
            full += x * sum(lengths) / capacity
            for y in lengths:
                rise[of[y]] += x
        rise /= need
        step = min(volume / full / ROUNDS, RISE / rise.max(), (1 - done) * volume / full)
        for x, lengths in zip(amount.tolist(), made, strict=True):
            used[lengths] = used.get(lengths, 0.0) + x * step
        cover += rise * step
        done += step * full / volume
        if done >= 1 - 1e-9:
            break
    values = np.full(capacity + 1, -np.inf)
    values[sizes] = dual
    return Solution(used, of, max(volume, float((n * dual).sum()) / knapsack(values, least, capacity)[0][capacity]))


def rounded(solution: Solution, histogram: dict[int, int], capacity: int, share: float) -> tuple[dict[int, list], dict[int, int]]:
    """Free space -> [(how many sequences, (lengths))] of the configurations made, and the lengths left.

    Configurations are made as often as the running sum of the solution passes whole
    numbers. Where a length has run out, the longest of its group that still fits
    takes its place, or none does; a configuration's last length is the longest of
    all that still fits.
    """
    left, stock, groups, total = dict(histogram), {}, {}, 0.0
    every = sorted(histogram)
    for x in every:
        stock.setdefault(solution.group[x], []).append(x)
    for lengths, x in sorted(solution.used.items(), key=lambda p: (-p[1], p[0])):
        before, total = int(total), total + x * share
        many = int(total) - before
        while many > 0:
            some, slack = {}, capacity - sum(lengths)
            for nth, y in enumerate(lengths, 1):
                if left[y] > some.get(y, 0) and (nth < len(lengths) or not slack):
                    got = y
                else:
                    pool = stock[solution.group[y]] if nth < len(lengths) else every
                    k = bisect_right(pool, y + slack) - 1
                    while k >= 0 and left[pool[k]] <= some.get(pool[k], 0):
                        k -= 1
                    got = pool[k] if k >= 0 else 0
                slack += y - got
                if got:
                    some[got] = some.get(got, 0) + 1
            if not some:
                break
            times = min(many, *(left[y] // k for y, k in some.items()))
            for y, k in some.items():
                left[y] -= k * times
                if not left[y]:
                    stock[solution.group[y]].remove(y)
                    every.remove(y)
            made = tuple(y for y in sorted(some, reverse=True) for _ in range(some[y]))
            groups.setdefault(capacity - sum(made), []).append((times, made))
            many -= times
    return groups, {y: k for y, k in left.items() if k}


def _best_fit(groups: dict[int, list], counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Packs counts, longest first, each into the fullest sequence it fits.

    groups: free space -> [(how many sequences, (lengths))]; equal sequences stay one entry.
    """
    free = sorted(groups)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect_left(free, length)
            if k == len(free):
                each = max(1, capacity // length)
                full, rest = divmod(n, each)
                for many, copies in ((full, each), (1 if rest else 0, rest)):
                    if many:
                        left = capacity - copies * length
                        if left not in groups:
                            insort(free, left)
                        groups.setdefault(left, []).append((many, (length,) * copies))
                break
            room = free[k]
            many, items = groups[room].pop()
            if not groups[room]:
                del groups[room]
                free.pop(k)
            fit = max(1, min(room // length, n // many)) if n >= many else 1
            take = min(many, n)
            for m, it, left in ((take, items + (length,) * fit, room - fit * length), (many - take, items, room)):
                if m:
                    if left not in groups:
                        insort(free, left)
                    groups.setdefault(left, []).append((m, it))
            n -= take * fit
    return [g for room in groups.values() for g in room]


@dataclass
class Report:
    """Sequences of the plan, how many of them are configurations of the linear program, a lower bound of both, and the shares tried with their sequences."""

    sequences: int = 0
    configured: int = 0
    bound: float = 0.0
    tried: dict[float, int] = field(default_factory=dict)


def plan(histogram: dict[int, int], capacity: int, report: Report | None = None) -> list[tuple[int, tuple]]:
    """[(how many sequences, (lengths))] that hold each length as often as the histogram says."""
    report = Report() if report is None else report
    whole = [(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    full = sum(m for m, _ in whole)
    shorter = {x: n for x, n in histogram.items() if x < capacity and n}
    if not shorter:
        report.sequences = report.configured = full
        report.bound = float(full)
        return whole
    large = {x: n for x, n in shorter.items() if x > SMALL * capacity}
    tokens = sum(x * n for x, n in shorter.items())
    if 2 * sum(x * n for x, n in large.items()) < tokens:
        large = shorter
    solution, best = fractional(large, capacity), None
    report.bound = full + max(solution.bound, tokens / capacity)
    for share in SHARES:
        groups, left = rounded(solution, large, capacity, share)
        made = sum(m for g in groups.values() for m, _ in g)
        done = _best_fit(groups, left | {x: n for x, n in shorter.items() if x not in large}, capacity)
        report.tried[share] = full + sum(m for m, _ in done)
        if best is None or report.tried[share] < report.sequences:
            best, report.sequences, report.configured = done, report.tried[share], full + made
    log.info("packing: %s", report)
    return whole + best


class Layout:
    """Where the r-th row of each length goes."""

    def __init__(self, packed: list[tuple[int, tuple]]):
        rows, base, seen = [], 0, {}
        for many, lengths in packed:
            offset = 0
            for x in lengths:
                lo = seen.get(x, 0)
                rows.append((x, lo, base, offset))
                seen[x] = lo + many
                offset += x
            base += many
        rows.sort()
        self.length, self.lo, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 4).T
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset)."""
        k = np.searchsorted(self.length << 40 | self.lo, length << 40 | rank, "right") - 1
        return self.base[k] + rank - self.lo[k], self.offset[k]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the text's ids and end_id, cut every `capacity` ids."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")])
    end = int(end_id).to_bytes(4, "little")

    def cut(it):
        for b in it:
            key = ids(b.column(0))
            for i, bounds, flat in encoded(b.column(1), tokenizer):
                raw, out = memoryview(flat.astype("<u4")).cast("B"), []
                for d in range(len(bounds) - 1):
                    x, y = int(bounds[d]), int(bounds[d + 1])
                    for p, s in enumerate(range(0, y - x + 1, capacity)):
                        e = min(s + capacity, y - x + 1)
                        crc = zlib.crc32(raw[4 * (x + s) : 4 * min(x + e, y)])
                        out.append((key[i + d], p, s, e - s, zlib.crc32(end, crc) if x + e > y else crc))
                if out:
                    doc, *rest = np.array(out, np.int64).T
                    yield from batches([longs(doc), *rest], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    A row's rank among those of its length is counted in salted parts, so a length
    that a third of the rows have is no single task's. pieces is read twice: give a
    staged table. Null ids are ids as any other; rows with equal doc_id and piece are
    ranked in any order; an empty table gives an empty result; more columns, of any
    names but those two, pass through.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = Layout(plan(histogram, capacity)) if histogram else None
    salts = max(16, sum(histogram.values()) // 500_000)
    key = pieces.select(F.struct(*map(quoted, pieces.columns)).alias("row"), F.col("length").cast("long").alias("length"), "doc_id", "piece", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"))
    counts = key.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = key.withColumn("r", F.row_number().over(inside) - 1).join(before, ["length", "salt"]).select("row", "length", (F.col("r") + F.col("before")).alias("rank"))
    out = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(it):
        for b in it:
            seq, off = layout.place(b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(seq), pa.array(off)], names=out.names)

    return ranked.mapInArrow(place, out)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Packs the tokens of all documents; see token_pieces and pack.

    Null or empty text is the end id alone, one piece of length 1. Null ids stay null.
    """
    out = pack(staged(token_pieces(docs, tokenizer, capacity)), capacity)
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
