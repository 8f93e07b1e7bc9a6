"""Quality rules on repetition inside a document.

A suffix array over each document's words is built by prefix doubling, for many
documents at once. The longest common prefixes of neighbouring suffixes give the
intervals of suffixes that share a maximal repeated substring; the union of the
substrings' spans and the longest of them are held against limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import batches, ids, longs, map_rows
from .words import Words, buffers, chunks, cover, span_hash

#: The characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """What a document may have. Repeats shorter than min_repeat words don't count as repeated substrings.

    A word in a repeated substring is in a repeated window of 3 words too, so
    max_covered_percent binds only below max_repeat_words_percent, and
    max_longest_percent only below it as well. Of the labelled documents of check_s that
    pass the base rule 7.4 % are bad (1,345 of 18,251); of those covered by more than
    30 %, which are also those whose longest repeat is above 15 %, 17 % (3 of 18); of
    those covered by 15 to 30 %, 7 % (11 of 156). So the labels, few as they are here,
    speak for no lower limit.
    """

    min_words: int = 50
    max_repeat_words_percent: int = 50
    min_repeat: int = 8
    max_covered_percent: int = 30
    max_longest: int = 200
    max_longest_percent: int = 15


def longest_repeats(w: Words) -> np.ndarray:
    """For each word, the length in words of the longest sequence that starts there and elsewhere in its document too."""
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    doc, end = w.doc(), np.repeat(w.bounds[1:], w.counts)
    order = np.lexsort((w.h[0], doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (w.h[0][order][1:] != w.h[0][order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, k = [rank.copy()], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    paired = active
    while len(active):
        second = np.where(active + k < end[active], rank[np.minimum(active + k, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        active, key, first = active[order], key[order], rank[active[order]]
        at = np.arange(len(active))
        run, group = np.ones(len(at), bool), np.ones(len(at), bool)
        run[1:], group[1:] = key[1:] != key[:-1], first[1:] != first[:-1]
        run_at, group_at = np.flatnonzero(run)[np.cumsum(run) - 1], np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[active] = first + run_at - group_at
        levels.append(rank.copy())
        active = active[np.bincount(np.cumsum(run) - 1)[np.cumsum(run) - 1] > 1]
        k *= 2
    # Neighbours in the suffix array; only those whose first words are equal share a prefix.
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    left, right = suffix[:-1], suffix[1:]
    some = np.flatnonzero(levels[0][left] == levels[0][right]) if len(paired) else np.zeros(0, np.int64)
    i, j = left[some].copy(), right[some].copy()
    stop_i, stop_j = end[i], end[j]
    lcp = np.zeros(len(some), np.int64)
    for p in range(len(levels) - 1, -1, -1):
        r = levels[p]
        same = (i < stop_i) & (j < stop_j)
        same &= r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)]
        step = same.astype(np.int64) << p
        lcp += step
        i += step
        j += step
    out = np.zeros(n, np.int64)
    np.maximum.at(out, left[some], lcp)
    np.maximum.at(out, right[some], lcp)
    return out


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags)))
    return (c[bounds[1:]] - c[bounds[:-1]]).astype(np.int64)


def measures(buf: np.ndarray, offsets: np.ndarray, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Every figure of a chunk of documents, and the verdicts."""
    w = Words(buf, offsets)
    n, docs = w.counts.astype(np.int64), len(offsets) - 1
    longest = longest_repeats(w)
    thrice = cover(np.flatnonzero(longest >= 3), 3, len(w))
    spans = np.flatnonzero(longest >= limits.min_repeat)
    covered = _per_doc(cover(spans, longest[spans], len(w)), w.bounds)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, w.doc(), longest)
    # Lines: a document's start and every byte after a line feed begin one.
    feeds = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    starts = starts[starts < len(buf)] if len(buf) else starts[:0]
    starts = np.unique(starts)
    ends = np.append(starts[1:], len(buf))
    ends = ends - ((ends > starts) & np.isin(ends - 1, feeds, assume_unique=False)) if len(starts) else ends[:0]
    inside = np.concatenate(([0], np.cumsum(w.inside)))
    wordy = inside[ends] > inside[starts]
    starts, ends = starts[wordy], ends[wordy]
    doc_of = np.searchsorted(offsets, starts, "right") - 1
    h = span_hash(buf, starts, ends)
    order = np.lexsort((h, doc_of))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc_of[order][1:] == doc_of[order][:-1])
    dup = np.bincount(doc_of[order][again], minlength=docs).astype(np.int64)
    repeat = _per_doc(thrice, w.bounds)
    base = (n < limits.min_words) | (100 * repeat > limits.max_repeat_words_percent * n)
    return {
        "n_words": n,
        "word_chars": _per_doc(w.inside & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(np.isin(buf, list(SYMBOLS)), offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": base,
        "kept": ~base & (100 * covered <= limits.max_covered_percent * n) & (most <= limits.max_longest) & (100 * most <= limits.max_longest_percent * n),
        "n_covered": covered,
        "longest_repeat": most,
    }


def quality(docs: DataFrame, limits: Limits = Limits(), with_columns: bool = False) -> DataFrame:
    """One row per input row: doc_id and the figures and verdicts of measures().

    Null or empty text has no words and fails. A null id stays null; equal rows
    give equal results; an empty table an empty one. With with_columns the input's
    own columns come first, whole, under their names, and only `kept` is added as
    `_kept`; else no other column of the input is read. A document is one task's
    work, in arrays of a few times its size; there is no shuffle.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"]
    kinds = {n: pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names}
    schema = pa.schema([("doc_id", pa.int64()), *kinds.items()])

    def judge(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, buf, offsets in chunks(*buffers(b.column(1))):
                m = measures(buf, offsets, limits)
                yield from batches([longs(key[i:j]), *(m[n] for n in names)], schema)

    def mark(it):
        for b in it:
            kept = [measures(buf, offsets, limits)["kept"] for _, _, buf, offsets in chunks(*buffers(b.column(b.schema.get_field_index("text"))))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))], names=[*b.schema.names, "_kept"])

    if with_columns:
        return map_rows(docs, mark, StructType([*docs.schema.fields, StructField("_kept", BooleanType())]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, " + ", ".join(f"{n} {'boolean' if kinds[n] == pa.bool_() else 'long'}" for n in names))


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The input's rows, all columns as they are, of the documents that quality() keeps; columns may have any names."""

    def keep(it):
        for b in it:
            kept = [measures(buf, offsets, limits)["kept"] for _, _, buf, offsets in chunks(*buffers(b.column(b.schema.get_field_index("text"))))]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return map_rows(docs, keep, docs.schema)
