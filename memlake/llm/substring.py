"""Removal of word windows that a document with a smaller id has too, by super-k-mers.

Consecutive windows that share a minimiser (the smallest hash of a few words in
the window) are one packed string. It travels to the minimiser's bucket, so
equal windows meet there, each word being sent about three times, not once for
every window it is in. In a bucket windows are sorted by 128 bits of hash, those
that agree are compared word by word, and of equal ones that of the smallest
document stays in a table while the others are flagged at once: a task holds each
different window of its bucket once, however often it comes. What a task can
settle by itself before the shuffle is not sent: of windows that several ids of a
chunk have only those of the smallest id leave, and a window that is known to
have been sent with a smaller id isn't sent again, so groups of copies and
passages that many documents share shrink to about one string a task. A document
sends a window and is told of it once, for its first place; the others are found
when it is cut.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batches, ids, longs, partitions_for, plan_bytes, quoted
from .tokens import spread
from .words import MASKS, Words, buffers, chunks, cover, mix, release, window_hash

#: Words of a window and of a minimiser.
WINDOW, MINIMISER = 13, 3
#: Bytes of packed strings in a bucket, most partitions of them, and new windows that are sorted at once.
BUCKET_BYTES, MOST_PARTITIONS, SORTED_WINDOWS = 20 << 20, 1 << 17, 800_000
#: Windows that a task remembers as sent, and bytes of packed strings that are split into words at once.
SENT_WINDOWS, SPLIT_TOGETHER = 600_000, 1 << 20
#: Bytes of text a task packs together.
PACKED_TOGETHER = 5 << 19
#: Effort of compression: what is sent is about half of all that the disks hold meanwhile.
PACKED_LEVEL = 9


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of x[i:i + n]."""
    done, out = 1, x
    while done * 2 <= n:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = n - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, row: np.ndarray, differ=None) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose words also start in a smaller document, and windows that the same row has before. Rows are in order.

    differ(i, j), where given, says which windows i have other words than windows j of the
    same hashes, and differ.words(i) are a window's; else windows of equal hashes are equal.
    """
    order = np.argsort(h1, kind="stable")
    s = h1[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    flagged, again = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
    if not len(some):
        return flagged, again
    tie = np.zeros(len(h1), np.int64)
    for compared in (differ is None, True):
        ties = (tie[some],) if tie.any() else ()
        some = some[np.lexsort((some, row[some], doc[some], *ties, h2[some], h1[some]))]
        a, b, d, t = h1[some], h2[some], doc[some], tie[some]
        new = np.ones(len(some), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        if compared or not (odd := differ(some, some[head])).any():
            break
        # Groups of equal hashes and different words are told apart by their words.
        seen: dict[bytes, int] = {}
        for i in some[np.isin(head, head[odd])].tolist():
            tie[i] = seen.setdefault(differ.words(i), len(seen) + 1)
    flagged[some] = d > d[head]
    again[some[1:]] = ~new[1:] & (row[some][1:] == row[some][:-1]) & (d[1:] == d[:-1])
    return flagged, again


def everywhere(w: Words, first: np.ndarray, n: int) -> np.ndarray:
    """All windows with the words of one of the windows `first` of the same document."""
    told = np.zeros(len(w), bool)
    told[first] = True
    docs, at = w.doc(), w.windows(n)
    at = at[np.isin(docs[at], docs[first])]
    h1, h2, d = w.window_hashes(at, n), w.window_hashes(at, n, 1), docs[at]
    key = mix(h1 + d.astype(np.uint64))
    some = np.flatnonzero(np.isin(key, key[told[at]]))
    some = some[np.lexsort((h2[some], h1[some], d[some]))]
    if not len(some):
        return first
    new = np.ones(len(some), bool)
    new[1:] = (d[some][1:] != d[some][:-1]) | (h1[some][1:] != h1[some][:-1]) | (h2[some][1:] != h2[some][:-1])
    found = np.logical_or.reduceat(told[at][some], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.union1d(first, at[some[found]])


_ROWS = pa.schema([("bucket", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary())])
_ROW_COLUMNS = "bucket int, dest int, payload binary"
_FLAG_TYPES = ("<i8", "<i8", "<i4")


def _squeeze(*parts: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(parts, protocol=5))


def _expand(raw: bytes) -> tuple[bytes, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def dest_of(doc: np.ndarray, dests: int) -> np.ndarray:
    """The part of each document; as _dest() says it in Spark. Regular gaps between ids don't make parts uneven."""
    u = doc.astype(np.int64).view(np.uint64)
    return (u ^ u >> np.uint64(5) ^ u >> np.uint64(11)).view(np.int64) % dests


def _dest(key: Column, dests: int) -> Column:
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 5)).bitwiseXOR(F.shiftrightunsigned(key, 11)), F.lit(dests)).cast("int")


def _flags(doc: np.ndarray, row: np.ndarray, at: np.ndarray, dests: int, buckets: int):
    """Flagged windows in one row for each part of the documents."""
    dest = dest_of(doc, dests)
    order = np.lexsort((at, row, doc, dest))
    dest, arrays = dest[order], [x[order].astype(t) for x, t in zip((doc, row, at), _FLAG_TYPES, strict=True)]
    cuts = np.append(np.flatnonzero(np.append(True, dest[1:] != dest[:-1])), len(dest))
    to = dest[cuts[:-1]].astype(np.int32)
    yield from batches([to % buckets, to, pa.array([_squeeze(*(a[x:y].tobytes() for a in arrays)) for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], _ROWS)


def _repeated_rows(w: Words, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows with the id and words of an earlier one, whose flags are theirs too."""
    parts = [key, row, *(window_hash(h, w.bounds[:-1], w.bounds[1:], k) for k, h in enumerate(w.h))]
    order = np.lexsort(parts)
    out = np.zeros(len(key), bool)
    out[order[1:]] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in parts])
    return out


class _Sent:
    """Windows that a task has sent, by 128 bits, and the smallest document of each: up to SENT_WINDOWS of those met again, and the newest others."""

    def __init__(self):
        self.h1, self.h2, self.doc, self.met = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def smaller(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the windows were sent with a smaller document."""
        if not len(self.h1):
            return np.zeros(len(h1), bool)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        same = (self.h1[at] == h1) & (self.h2[at] == h2)
        self.met[at[same]] = True
        return same & (self.doc[at] < doc)

    def add(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> None:
        if len(self.h1) + len(h1) > SENT_WINDOWS:
            self._only(self.met if self.met.sum() + len(h1) <= SENT_WINDOWS else np.zeros(len(self.met), bool))
            h1, h2, doc = h1[:SENT_WINDOWS], h2[:SENT_WINDOWS], doc[:SENT_WINDOWS]
        # One array after the other, as this is a task's largest moment.
        self.h1, self.doc = np.concatenate((self.h1, h1)), np.concatenate((self.doc, doc))
        order = np.lexsort((self.doc, self.h1))
        self.h1, first = self.h1[order], np.ones(len(order), bool)
        first[1:] = self.h1[1:] != self.h1[:-1]
        self.h1, order = self.h1[first], order[first]
        self.doc = self.doc[order]
        self.h2 = np.concatenate((self.h2, h2))[order]
        self.met = np.append(self.met, np.zeros(len(h1), bool))[order]

    def _only(self, some: np.ndarray) -> None:
        self.h1, self.h2, self.doc, self.met = self.h1[some], self.h2[some], self.doc[some], self.met[some]


def _pack(buf: np.ndarray, offsets: np.ndarray, key: np.ndarray, row: np.ndarray, n: int, m: int, buckets: int, dests: int, known: _Sent):
    """Rows for the shuffle: packed strings by bucket, and flags that the task settles."""
    w = Words(buf, offsets, hashes=2)
    first = w.windows(n)
    first = first[~_repeated_rows(w, key, row)[w.doc()[first]]]
    if not len(first):
        return
    h1, h2, docs = w.window_hashes(first, n), w.window_hashes(first, n, 1), w.doc()[first]
    plain, starts, ends = spaced(w)
    flagged, again = later(h1, h2, key[docs], docs, _Differ(plain, starts[first], ends[first + n - 1]))
    flagged |= known.smaller(h1, h2, key[docs])
    if (told := flagged & ~again).any():
        d = docs[told]
        yield from _flags(key[d], row[d], first[told] - w.bounds[d], dests, buckets)
    words = np.arange(len(w) - m + 1)
    least = _sliding_min(w.window_hashes(words, m), n - m + 1)[first]
    sent = np.flatnonzero(~(flagged | again))
    if not len(sent):
        return
    f, least, docs, h1, h2 = first[sent], least[sent], docs[sent], h1[sent], h2[sent]
    del first, flagged, again, told, words, sent
    w.h = []
    known.add(h1, h2, key[docs])
    del h1, h2
    new = np.ones(len(f), bool)
    new[1:] = (least[1:] != least[:-1]) | (f[1:] != f[:-1] + 1) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    last = f[np.append(at[1:], len(f)) - 1] + n - 1
    bucket = (mix(least[at]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts, ends = starts[f[at]][order], ends[last][order]
    docs, pos, bucket = docs[at][order], (f[at] - w.bounds[docs[at]])[order].astype(np.int32), bucket[order]
    sizes = (ends - starts).astype(np.int32)
    raw = plain.tobytes()
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    out = []
    for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        strings = [raw[a:b] for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]
        out.append(_squeeze(b"".join(strings), sizes[x:y].tobytes(), key[docs[x:y]].tobytes(), row[docs[x:y]].tobytes(), pos[x:y].tobytes(), level=PACKED_LEVEL))
    yield from batches([bucket[cuts[:-1]].astype(np.int32), pa.nulls(len(out), pa.int32()), pa.array(out, pa.binary())], _ROWS)


def spaced(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a chunk with one space after each (and 16 more), and where they start and end."""
    size = w.ends - w.starts
    text = np.full(int(size.sum()) + len(w) + 16, np.uint8(32))
    ends = np.cumsum(size + 1) - 1
    keep = np.ones(len(text), bool)
    keep[ends] = keep[len(text) - 16 :] = False
    text[keep] = w.buf[w.inside]
    return text, ends - size, ends


class _Differ:
    """Compares windows by their words: spans of a text in which words are parted by single spaces. The text has 16 bytes more."""

    def __init__(self, text: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    def words(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]].tobytes()

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = self.end[i] - self.start[i]
        out = size != self.end[j] - self.start[j]
        left, k = np.flatnonzero(~out & (i != j)), 0
        eight = np.ndarray((len(self.text) - 8,), "<u8", self.text.data, strides=(1,))
        while len(left) and k < 1024:
            many = np.minimum(size[left] - k, 8)
            bits = (eight[self.start[i[left]] + k] ^ eight[self.start[j[left]] + k]) & MASKS[many]
            out[left[bits != 0]] = True
            k += 8
            left = left[(bits == 0) & (size[left] > k)]
        for x in left.tolist():
            out[x] = self.words(i[x]) != self.words(j[x])
        return out


_SPARE = np.zeros(16, np.uint8)


class _Bucket:
    """The different windows of a bucket, each with the smallest document that has come with it, and their words."""

    def __init__(self, n: int):
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.packed, self.bytes, self.new, self.waiting, self.dead = [], 0, [], 0, 0
        self.text = np.zeros(0, np.uint8)
        self.held = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, "<i8", "<i8", "<i4", np.int64, np.int64))

    def add(self, payload: bytes):
        """Takes in a packed row; gives flagged windows (documents, rows, places) now and then."""
        self.packed.append(_expand(payload))
        self.bytes += len(self.packed[-1][0])
        if self.bytes >= SPLIT_TOGETHER:
            self._split()
            if self.waiting >= max(SORTED_WINDOWS, len(self.held[0]) // 2):
                yield from self._settle()

    def _split(self) -> None:
        """Windows of the packed rows that wait."""
        text = np.frombuffer(b"".join(p[0] for p in self.packed), np.uint8)
        size_of, doc, row, pos = (np.frombuffer(b"".join(p[k] for p in self.packed), t) for k, t in enumerate(("<i4", *_FLAG_TYPES), 1))
        self.packed, self.bytes = [], 0
        w = Words(text, np.concatenate(([0], np.cumsum(size_of, dtype=np.int64))), hashes=2)
        first = w.windows(self.n)
        of = w.doc()[first]
        self.new.append((text, (w.window_hashes(first, self.n), w.window_hashes(first, self.n, 1), doc[of], row[of], pos[of] + (first - w.bounds[of]).astype(np.int32), w.starts[first], w.ends[first + self.n - 1])))
        self.waiting += len(first)

    def settle(self):
        """The flagged windows of all that has come."""
        if self.packed:
            self._split()
        if self.new:
            yield from self._settle()

    def _settle(self):
        base = np.cumsum([len(self.text), *(len(buf) for buf, _ in self.new)])
        text = np.concatenate((self.text, *(buf for buf, _ in self.new), _SPARE))
        h1, h2, doc, row, at, start, end = (np.concatenate(x) for x in zip(self.held, *((*g[:5], g[5] + b, g[6] + b) for b, (_, g) in zip(base.tolist(), self.new, strict=False)), strict=True))
        self.new, self.waiting = [], 0
        flagged, again = later(h1, h2, doc, row, _Differ(text, start, end))
        if flagged.any():
            yield doc[flagged], row[flagged], at[flagged]
        keep = ~(flagged | again)
        self.dead += len(keep) - int(keep.sum())
        self.text, self.held = text[:-16], tuple(x[keep] for x in (h1, h2, doc, row, at, start, end))
        if 4 * self.dead > len(self.held[0]):
            self._compact()

    def _compact(self) -> None:
        """Only the bytes of windows that are held stay."""
        *rest, start, end = self.held
        order = np.argsort(start, kind="stable")
        upto = np.maximum.accumulate(end[order])
        new = np.ones(len(order), bool)
        new[1:] = start[order][1:] > upto[:-1]
        first = np.flatnonzero(new)
        begin, stop = start[order][first], np.append(upto[first[1:] - 1], upto[-1:])
        raw = self.text.tobytes()
        self.text = np.frombuffer(b"".join([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]), np.uint8)
        shift = np.empty(len(order), np.int64)
        shift[order] = (begin - np.concatenate(([0], np.cumsum(stop - begin)[:-1])))[np.cumsum(new) - 1] if len(order) else 0
        self.held, self.dead = (*rest, start - shift, end - shift), 0


def _count(it, n: int, dests: int):
    """Flags of windows in rows that come bucket by bucket; rows with flags pass."""
    bucket, table = None, _Bucket(n)
    for b in it:
        settled = b.column(1).is_valid()
        if (mine := b.filter(settled)).num_rows:
            yield mine
        packed = b.filter(pa.compute.invert(settled))
        for k, p in zip(packed.column(0).to_pylist(), packed.column(2).to_pylist(), strict=True):
            if k != bucket:
                for got in table.settle():
                    yield from _flags(*got, dests, 1)
                table.clear()
                release()
                bucket = k
            for got in table.add(p):
                yield from _flags(*got, dests, 1)
    for got in table.settle():
        yield from _flags(*got, dests, 1)
    table.clear()
    release()


def repeated_windows(docs: DataFrame, dests: int, n: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """dest, payload: windows that a smaller doc_id has too, packed by doc_id modulo dests."""
    buckets = min(1 << 30, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) * 5 // BUCKET_BYTES)))
    each = -(-buckets // MOST_PARTITIONS)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row"))

    def pack(it):
        known = _Sent()
        for b in it:
            key, row = ids(b.column(0)), ids(b.column(2))
            for i, j, buf, offsets in chunks(*buffers(b.column(1)), PACKED_TOGETHER):
                yield from _pack(buf, offsets, key[i:j], row[i:j], n, m, buckets, dests, known)
        del known
        release()

    # A partition is a bucket, or a run of buckets one after the other.
    packed = rows.mapInArrow(pack, _ROW_COLUMNS).repartitionById(-(-buckets // each), (F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket")
    return packed.mapInArrow(lambda it: _count(it, n, dests), _ROW_COLUMNS).select("dest", "payload")


class _Held:
    """The flags of the part of the documents that is being read."""

    def __init__(self):
        self.dest, self.got, self.sorted = None, [], None

    def add(self, dest: int, payload: bytes) -> None:
        if dest != self.dest:
            self.dest, self.got = dest, []
        self.got.append([np.frombuffer(x, t) for x, t in zip(_expand(payload), _FLAG_TYPES, strict=True)])
        self.sorted = None

    def of(self, dest: int, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which document, flagged word number) of documents with these ids."""
        none = np.zeros(0, np.int64)
        if dest != self.dest or not self.got:
            return none, none
        if self.sorted is None:
            doc, r, at = (np.concatenate(x) for x in zip(*self.got, strict=True))
            order = np.argsort(doc, kind="stable")
            self.sorted = doc[order], r[order], at[order].astype(np.int64)
        doc, r, at = self.sorted
        lo, hi = np.searchsorted(doc, key), np.searchsorted(doc, key, "right")
        which = np.repeat(np.arange(len(key)), hi - lo)
        k = spread(lo, hi - lo)
        same = r[k] == row[which]
        return which[same], at[k[same]]


def joined(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each document's kept words joined by one space."""
    buf = np.where(w.inside, w.buf, np.uint8(32))
    docs, some = w.doc(), np.flatnonzero(kept)
    new = np.ones(len(some), bool)
    new[1:] = docs[some][1:] != docs[some][:-1]
    take = np.zeros(len(buf) + 1, np.int8)
    take[w.starts[some]] += 1
    np.add.at(take, w.ends[some], -1)
    take = np.cumsum(take[:-1], dtype=np.int8) > 0
    take[w.starts[some[~new]] - 1] = True
    return buf[take], np.concatenate(([0], np.cumsum(take)))[w.offsets]


def remove_repeats(docs: DataFrame, n: int = WINDOW, m: int = MINIMISER, output: str = "digest") -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller id.

    output="digest": doc_id, n_words, n_removed, kept_sha256, one per input row.
    output="texts": the input's columns, with the kept words joined by one space
    as text where words were removed (n_chars, if there, follows), and documents
    left without words dropped.

    Null or empty text has no words and an empty digest text. A null id counts as
    larger than any other, and windows of rows with equal ids don't remove each
    other. Repeated rows get equal results. Other columns may have any names; an empty
    table gives an empty result.
    """
    dests = partitions_for(docs, 16 << 20) | 1
    rows = docs if output == "texts" else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names, k, key_at = rows.columns, rows.columns.index("text"), rows.columns.index("doc_id")
    c = names.index("n_chars") if "n_chars" in names else None
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))
    keyed = rows.select(_dest(key, dests).alias("_dest"), F.lit(1).alias("_kind"), F.struct(*map(quoted, names)).alias("_doc"), F.xxhash64("text").alias("_row"))
    flags = repeated_windows(docs, dests, n, m).select(F.col("dest").alias("_dest"), F.lit(0).alias("_kind"), F.col("payload").alias("_flags"))
    # A part's flags come before its documents, each of which is then read once, whole.
    dealt = keyed.unionByName(flags, allowMissingColumns=True).repartition(dests, "_dest").sortWithinPartitions("_dest", "_kind").select("_dest", "_doc", "_row", "_flags")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def cut(it):
        held = _Held()
        for b in it:
            dest = b.column(0).to_numpy()
            is_flags = b.column(1).is_null().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.append(True, (dest[1:] != dest[:-1]) | (is_flags[1:] != is_flags[:-1])))
            for x, y in zip(turns.tolist(), [*turns[1:].tolist(), b.num_rows], strict=True):
                if is_flags[x]:
                    for payload in b.column(3).slice(x, y - x).to_pylist():
                        held.add(int(dest[x]), payload)
                    continue
                columns = b.column(1).slice(x, y - x).flatten()
                key, row = ids(columns[key_at]), b.column(2).slice(x, y - x).to_numpy()
                for i, j, buf, offsets in chunks(*buffers(columns[k])):
                    which, at = held.of(int(dest[x]), key[i:j], row[i:j])
                    w = Words(buf, offsets, hashes=2 if len(which) else 0)
                    first = w.bounds[which] + at
                    gone = cover(everywhere(w, first, n) if len(first) else first, n, len(w))
                    kept, bounds = joined(w, ~gone)
                    yield from (rewritten if output == "texts" else digested)([z.slice(i, j - i) for z in columns], key[i:j], w, gone, kept.tobytes(), bounds.tolist(), np.bincount(which, minlength=j - i) > 0)

    def digested(columns, key, w, gone, raw, bounds, changed):
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.bounds])
        sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(bounds, bounds[1:], strict=False)]
        yield from batches([longs(key), w.counts.astype(np.int64), removed, sha], out)

    def rewritten(columns, key, w, gone, raw, bounds, changed):
        old = columns[k].to_pylist()
        texts = [raw[x:y].decode("utf-8", "replace") if new else text for text, new, x, y in zip(old, changed.tolist(), bounds, bounds[1:], strict=False)]
        columns[k] = pa.array(texts, columns[k].type)
        if c is not None:
            columns[c] = pa.compute.if_else(pa.array(changed), pa.compute.utf8_length(columns[k]).cast(columns[c].type), columns[c])
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~changed | (np.diff(bounds) > 0)))

    return dealt.mapInArrow(cut, rows.schema if output == "texts" else "doc_id long, n_words long, n_removed long, kept_sha256 string")
