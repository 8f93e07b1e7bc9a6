"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The benchmark's windows are hashed and sorted into an index that every task
holds; documents are scanned once, hits are verified word by word, and the words
of hit windows, or the documents, can be removed. A benchmark of more than one
block is scanned for block by block, one of which is held at a time; hits of all
blocks are gathered on the input before anything is removed, so the size of a
block changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ids, longs, map_rows, quoted, staged
from .substring import spaced
from .tokens import spread
from .words import ALNUM, LOWER, MASKS, Words, buffers, chunks, cover

#: Words of a window, and the most bytes of benchmark text in one broadcast index, which is up to ten times as large; more text takes more scans, one after the other.
WINDOW, BLOCK_BYTES = 10, 8 << 20


def differ(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Which of the spans a[a0:a1] are other bytes than b[b0:b1]; both texts have 8 bytes more. Eight bytes a step, all spans at once."""
    size = a1 - a0
    out = size != b1 - b0
    left, k = np.flatnonzero(~out), 0
    x, y = (np.ndarray((len(t) - 7,), "<u8", t.data, strides=(1,)) for t in (a, b))
    while len(left):
        bits = (x[a0[left] + k] ^ y[b0[left] + k]) & MASKS[np.minimum(size[left] - k, 8)]
        out[left[bits != 0]] = True
        k += 8
        left = left[(bits == 0) & (size[left] > k)]
    return out


@dataclass
class _Windows:
    """Different windows of one length: sorted hashes, their words' places in the index's text, and the items that have each (of ptr[i]:ptr[i + 1])."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    item: np.ndarray


class Index:
    """Windows of benchmark items in flat arrays: their words once, as text, and about 24 bytes a window."""

    def __init__(self, items: list[tuple[int, str]], n: int = WINDOW):
        self.ids = np.array(sorted({i for i, _ in items if i is not None}), np.int64)
        number = np.array([-1 if i is None else int(np.searchsorted(self.ids, i)) for i, _ in items], np.int32)
        buf, offsets = buffers(pa.array([t for _, t in items], pa.large_string()))
        w = Words(buf, offsets, ALNUM, lower=True)
        text, starts, ends = spaced(w)
        self.text, self.sizes = LOWER[text], {}
        length = np.minimum(w.counts, n)
        for size in np.unique(length[length > 0]).tolist():
            first = w.windows(n) if size == n else w.bounds[:-1][length == size]
            doc = np.searchsorted(w.bounds, first, "right") - 1
            self.sizes[size] = self._windows(w.window_hashes(first, size), starts[first], ends[first + size - 1], number[doc])

    def _windows(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> _Windows:
        order, tie = np.argsort(h, kind="stable"), np.zeros(len(h), np.int64)
        h, start, end, item = h[order], start[order], end[order], item[order]
        new = np.append(True, h[1:] != h[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        odd = differ(self.text, start, end, self.text, start[head], end[head])
        if odd.any():
            # Windows of equal hash and other words are told apart by their words.
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(np.isin(head, head[odd])).tolist():
                tie[i] = seen.setdefault(self.text[start[i] : end[i]].tobytes(), len(seen) + 1)
            order = np.lexsort((tie, h))
            h, start, end, item, tie = h[order], start[order], end[order], item[order], tie[order]
            new = np.append(True, (h[1:] != h[:-1]) | (tie[1:] != tie[:-1]))
        heads, win = np.flatnonzero(new), np.cumsum(new) - 1
        some = np.flatnonzero(item >= 0)
        pair = np.unique(win[some] * (len(self.ids) + 1) + item[some])
        own, of = pair // (len(self.ids) + 1), (pair % (len(self.ids) + 1)).astype(np.int32)
        ptr = np.searchsorted(own, np.arange(len(heads) + 1)).astype(np.int32)
        return _Windows(h[heads], start[heads].astype(np.int32), end[heads].astype(np.int32), ptr, of)

    def nbytes(self) -> int:
        return self.text.nbytes + self.ids.nbytes + sum(x.nbytes for s in self.sizes.values() for x in vars(s).values())

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, list[list[int]]]:
        """The words of a chunk, which of them are hit, and each document's items."""
        w = Words(buf, offsets, ALNUM, lower=True)
        docs, first, length, found, plain = w.doc(), [], [], [], None
        for size, known in self.sizes.items():
            at = w.windows(size)
            h = w.window_hashes(at, size)
            pos = np.searchsorted(known.h, h)
            some = np.flatnonzero(known.h[np.minimum(pos, len(known.h) - 1)] == h)
            while len(some):
                if plain is None:
                    plain, starts, ends = spaced(w)
                    plain = LOWER[plain]
                i, k = at[some], pos[some]
                same = ~differ(plain, starts[i], ends[i + size - 1], self.text, known.start[k], known.end[k])
                first.append(i[same])
                length.append(np.full(len(first[-1]), size))
                found.append(self._items(known, docs[i[same]], k[same]))
                # Others may be the next window of that hash.
                some = some[~same]
                pos[some] += 1
                some = some[known.h[np.minimum(pos[some], len(known.h) - 1)] == h[some]]
                some = some[pos[some] < len(known.h)]
        items: list[list[int]] = [[] for _ in range(len(offsets) - 1)]
        if not first:
            return w, np.zeros(len(w), bool), items
        pair = np.unique(np.concatenate(found))
        for d, i in zip((pair // max(1, len(self.ids))).tolist(), (pair % max(1, len(self.ids))).tolist(), strict=True):
            items[d].append(int(self.ids[i]))
        return w, cover(np.concatenate(first), np.concatenate(length), len(w)), items

    def _items(self, known: _Windows, doc: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Numbers of (document, item) that the windows found have; a window counts once a document."""
        pair = np.unique(doc * len(known.h) + win)
        doc, win = pair // len(known.h), pair % len(known.h)
        n = (known.ptr[win + 1] - known.ptr[win]).astype(np.int64)
        return np.repeat(doc, n) * len(self.ids) + known.item[spread(known.ptr[win].astype(np.int64), n)]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """How many blocks of about block_bytes of text the benchmark has, and the items of the k-th.

    A document is scanned against every block, so the whole benchmark takes part whatever its size.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        rows = staged(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block"))
        return blocks, lambda k: [tuple(r) for r in rows.filter(F.col("block") == k).select("item_id", "text").collect()]
    return 1, lambda k: [tuple(r) for r in rows.collect()]


_SCANNED = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64()))])
_SCANNED_COLUMNS = "key long, n_words long, hits binary, items array<long>"


def _scan(rows: DataFrame, handle) -> DataFrame:
    """key, n_words, hits (numbers of the hit words), items; rows has a key and a text."""

    def scan(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1))):
                w, hit, items = handle.value.scan(buf, offsets)
                at = [np.flatnonzero(hit[x:y]).astype("<i4").tobytes() for x, y in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
                yield from batches([longs(key[i:j]), w.counts.astype(np.int64), pa.array(at, pa.binary()), pa.array(items, pa.list_(pa.int64()))], _SCANNED)

    return rows.mapInArrow(scan, _SCANNED_COLUMNS)


def _scan_all(numbered: DataFrame, blocks: int, items: Callable, n: int) -> DataFrame:
    """What _scan() finds in all blocks together, for rows with distinct keys. Each block's index is dropped before the next is made."""
    found = None
    for k in range(blocks):
        handle = numbered.sparkSession.sparkContext.broadcast(Index(items(k), n))
        part = _scan(numbered, handle)
        part = staged(part if k == 0 else part.filter(F.octet_length("hits") > 0))
        handle.destroy()
        found = part if found is None else found.unionByName(part)
    # At most one row a block and document.
    return found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items; one per input row.

    Null or empty text has no words; items without words have no windows; an
    item without id hits as any other, but isn't among the items; ids may be null
    or repeated, of documents and of items, and equal rows get equal results; an
    empty table gives an empty result. Only the named columns are read. With a
    benchmark of one block (the usual case) nothing is shuffled.
    """
    blocks, items = blocks_of(benchmark, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks == 1:
        handle = docs.sparkSession.sparkContext.broadcast(Index(items(0), n))
        found = _scan(rows, handle).select(F.col("key").alias("doc_id"), "n_words", F.array("hits").alias("hits"), "items")
    else:
        # A number for each row, the same in every scan, as the table is staged.
        numbered = staged(rows.withColumn("key", F.monotonically_increasing_id()))
        merged = _scan_all(numbered.select("key", "text"), blocks, items, n)
        found = merged.join(numbered.select("key", "doc_id"), "key").select("doc_id", "n_words", "hits", "items")

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64()))])

    def digest(it):
        for b in it:
            hits = [len(np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in h]))) for h in b.column(2).to_pylist()]
            names = [sorted(map(str, x)) for x in b.column(3).to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            yield from batches([b.column(0), b.column(1), hits, [len(x) for x in names], sha, [h > 0 for h in hits], b.column(3)], out)

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>")


def _without(w: Words, d: int, hit: np.ndarray) -> str:
    """The text of document d without its hit words."""
    at = w.offsets[d]
    raw = np.ones(w.offsets[d + 1] - at, bool)
    for x in np.flatnonzero(hit[w.bounds[d] : w.bounds[d + 1]]) + w.bounds[d]:
        raw[w.starts[x] - at : w.ends[x] - at] = False
    return w.buf[at : w.offsets[d + 1]][raw].tobytes().decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that are hit (remove="documents"), or without their hit words ("spans").

    All columns stay, whatever their names. With "spans" a text that is hit
    becomes its other words' raw characters. Windows are judged on the input
    against the whole benchmark, then all hits are removed at once. Null and empty
    texts hit nothing and stay as they are; null and repeated ids, repeated rows
    and items without id are as in contamination(); empty tables give empty results
    or, as the benchmark, remove nothing.
    """
    blocks, items = blocks_of(benchmark, block_bytes)
    spans, schema = remove == "spans", docs.schema

    def cleaned(b, k, hits_of):
        """The record batch b with text column k, cleaned by what hits_of(first row, end row, bytes, offsets) finds."""
        keep, texts = [], []
        for i, j, buf, offsets in chunks(*buffers(b.column(k))):
            w, hit = hits_of(i, j, buf, offsets)
            hits = np.diff(np.concatenate(([0], np.cumsum(hit)))[w.bounds])
            keep.append(hits == 0)
            if spans:
                own = b.column(k).slice(i, j - i).to_pylist()
                for d in np.flatnonzero(hits):
                    own[d] = _without(w, d, hit)
                texts += own
        if keep and spans:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, b.column(k).type), *b.columns[k + 1 :]], names=b.schema.names)
        elif keep:
            yield b.filter(pa.array(np.concatenate(keep)))

    if blocks == 1:
        handle = docs.sparkSession.sparkContext.broadcast(Index(items(0), n))

        def clean(it):
            for b in it:
                yield from cleaned(b, b.schema.get_field_index("text"), lambda i, j, buf, offsets: handle.value.scan(buf, offsets)[:2])

        return map_rows(docs, clean, schema)

    numbered = staged(docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("key")))
    hits = _scan_all(numbered.select("key", F.col("doc")["text"].alias("text")), blocks, items, n).filter(F.exists("hits", lambda h: F.octet_length(h) > 0)).select("key", "hits")

    def cut(it):
        for b in it:
            doc, found = pa.RecordBatch.from_struct_array(b.column(0)), b.column(1).to_pylist()

            def hits_of(i, j, buf, offsets, found=found):
                w = Words(buf, offsets, ALNUM, lower=True)
                hit = np.zeros(len(w), bool)
                for d, h in enumerate(found[i:j]):
                    for x in h or ():
                        hit[w.bounds[d] + np.frombuffer(x, "<i4")] = True
                return w, hit

            yield from cleaned(doc, doc.schema.get_field_index("text"), hits_of)

    return numbered.join(hits, "key", "left").select("doc", "hits").mapInArrow(cut, schema)
