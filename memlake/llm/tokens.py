"""Exact tokenisation by word tables, token counts and token-id files.

The tokenizers library sees every distinct word once per worker: its rules drop
white space and never join across it, so a text's ids are its words' ids, one
after the other. A word table keeps, sorted by word hash, the ids of the words
met so far, and texts are looked up with numpy. Words are identified by 64-bit
hashes; at the table's limit of entries the odds of any collision are below 1e-6.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, ids, longs, partitions_for, shared_dir
from .prefixes import Recurrence
from .words import LOWER, SPACED, Words, buffers, chunks

#: Entries of a word table; beyond, it starts anew. About 40 bytes each.
TABLE_WORDS = 1_500_000
#: Words up to so many bytes have their prefixes encoded by the library, which shares them between words; longer ones are counted by a recurrence.
PREFIX_BYTES = 64
#: Marks a byte that ends no character.
NO_PREFIX = np.uint32((1 << 32) - 1)

_ENDING = np.isin(np.arange(256), list(b",.;:!?"))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_kept: dict[tuple[str, bool], "WordTable"] = {}


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words whose ids don't depend on their neighbours, in lower case.

    White space bounds them, and an ASCII letter or digit before one of `,.;:!?`.
    Words with `<` may hold a special string: they keep their case and are not cut.
    """
    low = LOWER[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = _ENDING[low[1:]] & _LETTER[low[:-1]]
    odd = np.flatnonzero(buf == 60)
    if len(odd):
        plain = Words(buf, offsets, SPACED, hashes=0)
        for k in np.unique(np.searchsorted(plain.starts, odd, "right") - 1):
            a, b = plain.starts[k], plain.ends[k]
            low[a:b], cut[a:b] = buf[a:b], False
    return Words(low, offsets, SPACED, cut=cut)


class WordTable:
    """Ids, and where asked the token count of every prefix, of the words met so far."""

    def __init__(self, path: str, prefixes: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.path, self.prefixes, self.recurrence = path, prefixes, None
        self.clear()

    @classmethod
    def get(cls, path: str, prefixes: bool = False) -> "WordTable":
        """This worker's table."""
        if (path, prefixes) not in _kept:
            _kept[path, prefixes] = cls(path, prefixes)
        return _kept[path, prefixes]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.prefix_at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.prefix_flat = np.zeros(0, np.uint32)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        other = []
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():  # ASCII letters in lower case: a word of the model
                out[i] = [t.id for t in self.tokenizer.model.tokenize(w.decode())]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch([words[i].decode("utf-8", "replace") for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _prefix_counts(self, words: list[bytes], counts: list[int]) -> list[np.ndarray]:
        known: dict[bytes, int] = dict(zip(words, counts, strict=True))
        asked: dict[bytes, None] = {}
        long = {w: p for w in words if len(w) > PREFIX_BYTES and (p := self._long_prefixes(w)) is not None}
        for w in words:
            if w not in long:
                for i in range(1, len(w)):
                    if (w[i] & 0xC0) != 0x80 and w[:i] not in known:
                        asked[w[:i]] = None
        new = list(asked)
        known.update(zip(new, map(len, self.encode(new)), strict=True))
        out = []
        for w, n in zip(words, counts, strict=True):
            p = np.full(len(w), NO_PREFIX)
            if w in long:
                p[[i - 1 for i in range(1, len(w) + 1) if i == len(w) or (w[i] & 0xC0) != 0x80]] = long[w]
            else:
                p[:-1] = [known[w[:i]] if (w[i] & 0xC0) != 0x80 else NO_PREFIX for i in range(1, len(w))]
            p[-1] = n
            out.append(p)
        return out

    def _long_prefixes(self, word: bytes) -> list[int] | None:
        if self.recurrence is None:
            self.recurrence = Recurrence(self.path, self.tokenizer)
        try:
            return self.recurrence.word(word.decode())
        except UnicodeDecodeError:
            return None

    def rows_of(self, w: Words) -> np.ndarray:
        """The table row of each word; new words are encoded first."""
        u, first, back = np.unique(w.h[0], return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > TABLE_WORDS:
            self.clear()
        pos = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        if len(self.keys):
            known = self.keys[np.minimum(pos, len(self.keys) - 1)] == u
        new = np.flatnonzero(~known)
        if len(new):
            raw = w.buf.tobytes()
            words = [raw[a:b] for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)]
            got = self.encode(words)
            n = np.fromiter(map(len, got), np.int32, len(got))
            row0, at0 = len(self.counts), len(self.flat)
            self.at = np.append(self.at, at0 + np.cumsum(n, dtype=np.int64) - n)
            self.counts = np.append(self.counts, n)
            self.flat = np.append(self.flat, np.fromiter((i for x in got for i in x), np.uint32, int(n.sum())))
            if self.prefixes:
                p = self._prefix_counts(words, n.tolist())
                size = np.fromiter(map(len, p), np.int64, len(p))
                self.prefix_at = np.append(self.prefix_at, len(self.prefix_flat) + np.cumsum(size) - size)
                self.prefix_flat = np.append(self.prefix_flat, np.concatenate(p))
            keys = np.append(self.keys, u[new])
            rows = np.append(self.rows, row0 + np.arange(len(new)))
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], rows[order]
            pos = np.searchsorted(self.keys, u)
        return self.rows[pos][back] if len(u) else np.zeros(0, np.int64)


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... n[0] of them, then at[1], ..."""
    total = int(n.sum())
    start = np.cumsum(n) - n
    return np.repeat(at - start, n) + np.arange(total)


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bounds, ids) of chunks of a text column; null is empty."""
    table = WordTable.get(path)
    for i, _, buf, offsets in chunks(*buffers(column)):
        w = split_words(buf, offsets)
        rows = table.rows_of(w)
        n = table.counts[rows].astype(np.int64)
        flat = table.flat[spread(table.at[rows], n)]
        yield i, np.concatenate(([0], np.cumsum(n)))[w.bounds], flat


def lengths(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Token counts of chunks of a text column, one after the other; null is empty."""
    table = WordTable.get(path)
    for _, _, buf, offsets in chunks(*buffers(column)):
        w = split_words(buf, offsets)
        rows = table.rows_of(w)
        cum = np.concatenate(([0], np.cumsum(table.counts[rows], dtype=np.int64)))
        yield cum[w.bounds[1:]] - cum[w.bounds[:-1]]


def prefix_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = ()) -> DataFrame:
    """Token counts of whole texts, and the longest prefix that fits `limit` tokens.

    A prefix table is filled by dynamic programming: the count at a prefix is the
    count at the last word's start plus the stored count of that word's prefix.
    It holds the exact count at every character prefix of the text, so the length
    asked for (`fit_bytes`, which takes in white space after it) is read from it
    and nothing is encoded again, nor for each of `budgets`, whose longest prefixes
    are the array `budget_bytes`.

    Rows: id, n_bytes, n_tokens, over_limit, fit_bytes, and budget_bytes if budgets
    are given; one per input row, equal rows giving equal results. Null or
    empty text has 0 bytes and tokens; a null id stays null; other columns of the
    input are not read; an empty table gives an empty result.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_bytes", pa.int64()), *([("budget_bytes", pa.list_(pa.int64()))] if budgets else [])])

    def count(it):
        table = WordTable.get(path, True)
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1))):
                at, w, total = prefix_table(table, buf, offsets)
                more = [pa.array(list(np.stack([fitting(at, w, total, k) for k in budgets], 1)), schema.field(5).type)] if budgets else []
                yield from batches([longs(key[i:j]), np.diff(offsets), total, total > limit, fitting(at, w, total, limit), *more], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + (", budget_bytes array<long>" if budgets else ""))


def prefix_table(table: WordTable, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    """Counts at the prefix that ends with each byte (-1: in white space or a character), the words, whole counts."""
    w = split_words(buf, offsets)
    rows = table.rows_of(w)
    n = table.counts[rows].astype(np.int64)
    cum = np.concatenate(([0], np.cumsum(n)))
    total = cum[w.bounds[1:]] - cum[w.bounds[:-1]]
    base = cum[:-1] - np.repeat(cum[w.bounds[:-1]], w.counts)
    size = w.ends - w.starts
    inner = table.prefix_flat[spread(table.prefix_at[rows], size)]
    at = np.full(len(buf), -1, np.int64)
    at[w.inside] = np.where(inner == NO_PREFIX, -1, np.repeat(base, size) + inner)
    return at, w, total


def fitting(at: np.ndarray, w: Words, total: np.ndarray, limit: int) -> np.ndarray:
    """Bytes of each document's longest prefix of up to `limit` tokens, read from a prefix table."""
    buf, offsets = w.buf, w.offsets
    ok = np.flatnonzero((at >= 0) & (at <= limit))
    k = np.searchsorted(ok, offsets[1:]) - 1
    last = np.where(k >= 0, ok[np.maximum(k, 0)], -1) if len(ok) else np.full(len(total), -1)
    fit = np.maximum(last + 1, offsets[:-1])
    if len(buf):
        following = np.append(w.starts, len(buf))[np.searchsorted(w.starts, fit)]
        between = (fit < offsets[1:]) & ~w.inside[np.minimum(fit, len(buf) - 1)]
        fit = np.where(between, np.minimum(following, offsets[1:]), fit)
    return np.where(total <= limit, np.diff(offsets), fit - offsets[:-1])


def token_rows(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the text's ids and, unless None, `end_id`. Null text is empty."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])
    tail = [] if end_id is None else [end_id]

    def encode(it):
        for b in it:
            key = ids(b.column(0))
            for i, bounds, flat in encoded(b.column(1), path):
                n = len(bounds) - 1
                out = np.insert(flat.astype(np.int32), np.repeat(bounds[1:], len(tail)), np.tile(tail, n).astype(np.int32)) if tail else flat.astype(np.int32)
                at = bounds + np.arange(n + 1) * len(tail)
                yield pa.RecordBatch.from_arrays([longs(key[i : i + n]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encode, f"{id_col} long, ids array<int>")


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = 16 << 20, page_rows: int = 1000, each: int = 64 << 20) -> None:
    """Writes id, n_tokens, ids as Parquet in ascending id order.

    The ids column has a dictionary (its width is that of the vocabulary), ids
    and counts of the second format version are delta-coded where a dictionary
    doesn't pay, row groups have `row_group_bytes`, and pages of `page_rows` rows
    with column and offset indexes, so that a reader of a few documents or of
    the counts alone reads only their pages. Texts are dealt by ranges of ids
    before they are encoded: text is smaller than ids, and no key can be hot but
    a repeated id. Null ids come last. Null and empty texts have the end id alone;
    rows of one id follow one another in any order, repeated rows are written each;
    an empty table makes a file without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(partitions_for(rows, each), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    out = token_rows(dealt, tokenizer, end_id).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "compression": "zstd"}
    out.write.options(**options).parquet(path)


def _part():
    return F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("part")


def _starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with part, row and n_tokens -> start, the ids before each row's.

    Part numbers follow the ranges of ids. counts is read for its n_tokens alone; it becomes one row a file.
    """
    totals = counts.select(_part(), "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("part")
    files = totals.select("part", (F.sum("total").over(w) - F.col("total")).alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return counted.join(files, "part").withColumn("start", F.col("before") + F.col("inside")).drop("inside", "before")


def token_file_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, row, start, n_tokens of a token file, from its metadata columns alone.

    A reader that wants a few documents filters this, then reads their ids by doc_id:
    column indexes skip the pages of the others.
    """
    rows = spark.read.parquet(path)
    return _starts(rows.select("doc_id", "n_tokens", _part(), F.col("_metadata.row_index").alias("row")), rows)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes documents as a token file in the shared folder, reads it back and digests it.

    Rows doc_id, start, n_tokens, ids_crc32; one per input row. Null or empty text
    has the end id alone. Rows with equal ids follow one another in any order; an
    empty table gives an empty result.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    write_token_file(docs, path, tokenizer, end_id)
    names = ["doc_id", "n_tokens", "part", "row", "ids_crc32"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def crc(it):
        for b in it:
            col = b.column(4)
            at = col.offsets.to_numpy()
            raw = memoryview(col.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            yield from batches([*(b.column(k).cast(pa.int64()) for k in range(4)), [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]], schema)

    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    read = rows.select("doc_id", "n_tokens", _part(), F.col("_metadata.row_index").alias("row"), "ids")
    narrow = read.mapInArrow(crc, ", ".join(f"{n} long" for n in names))
    return _starts(narrow, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
