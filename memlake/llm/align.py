"""Alignment of two tokenizations of the same bytes, by byte-owner arrays.

Tokenizer A is byte-level, B has pieces with byte fallback; both cover the bytes of
a space and the text. Over those bytes np.repeat lays out which token of A and which
of B owns each: consecutive distinct owner pairs are the overlapping tokens, and
where both owners change at once both have a token's end, so the text can be cut.

A space after a character other than white space begins a token in both, and nothing
before it changes those after it, so texts fall into pieces there, which are encoded
and aligned once in a worker: a table keeps, sorted by a 64-bit hash of the piece,
what the pieces met so far give, and a text's result is its pieces' results one after
the other. At the table's limit the odds of any collision are below 1e-6.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ids, longs, plan_bytes, shared_dir, staged
from .tokens import spread
from .words import buffers, chunks, release, span_hash

#: Pieces a table holds; beyond, it starts anew. About 120 bytes each.
TABLE_PIECES = 600_000
#: Bytes of text aligned at once; longer pieces go to the library whose time doesn't grow with their square.
ALIGNED_BYTES, SHORT_PIECE = 1 << 20, 256
#: Id pairs whose counts every task holds (the most frequent ones; 16 bytes each), and those that a task sums before it passes them on.
HELD_PAIRS, SUMMED_PAIRS = 2_000_000, 2_000_000
#: Bytes of input for a part of the joined tables.
PART_BYTES = 64 << 20

#: The pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_kept: dict[tuple[str, str], "PieceTable"] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it shows, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: ids of texts, special strings being plain text, and each id's bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_alphabet(), spec["model"]
        self.bytes = [b""] * (1 + max(self.library.get_vocab().values()))
        for text, i in model["vocab"].items():
            if all(c in letters for c in text):
                self.bytes[i] = bytes(letters[c] for c in text)
        added = {t["id"] for t in spec.get("added_tokens", [])}
        self.quick = self._quick(spec, {b: i for i, b in enumerate(self.bytes) if b and i not in added})

    @staticmethod
    def _quick(spec: dict, ranks: dict[bytes, int]):
        """The same encoding by a library that is quicker for short texts, if ids are in order of merges and nothing else takes part."""
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
        made = [vocab[a + b] for a, b in pairs]
        if plain and made == sorted(set(made)) and len(ranks) == len(made) + 256 and made[0] > max(ranks[bytes([b])] for b in range(256)):
            return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.quick.encode_ordinary(t) if self.quick and len(t) <= SHORT_PIECE else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """Tokenizer B: ids of texts, before which it puts a space itself, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = m.piece_to_id("▁")
        #: Whether no piece goes on after a space, so that texts may be cut before spaces.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        # A space alone, at the end of a text, is the piece that the library would put before a word.
        return [x if t else [self.space] for t, x in zip(texts, self.library.encode(texts, num_threads=1), strict=True)]


_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def piece_starts(buf: np.ndarray, offsets: np.ndarray, apart: bool = True) -> np.ndarray:
    """First bytes of the pieces of documents that begin with a space: spaces after other characters than white space.

    Three-byte characters near those of Unicode's white space count as such, which makes a piece longer, not wrong.
    """
    start = np.zeros(len(buf), bool)
    start[offsets[:-1]] = True
    if apart and len(buf) > 3:
        a, b, c = buf[:-3], buf[1:-2], buf[2:-1]
        white = _WHITE[c] | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)))
        start[3:] |= (buf[3:] == 32) & ~white
    return np.flatnonzero(start)


class PieceTable:
    """What each piece met so far gives: numbers of tokens and groups, id pairs, and its groups written out."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.wide = len(self.b.bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        #: Ids in digits, followed by what stands after them: `,` between, `|` after the last of A, `;` of B.
        self.written = [np.array([b"%d%c" % (i, end) for end in ends for i in range(len(t.bytes))], object) for t, ends in ((self.a, b",|"), (self.b, b",;"))]
        self.clear()

    @classmethod
    def get(cls, a_path: str, b_path: str) -> "PieceTable":
        """This worker's table."""
        if (a_path, b_path) not in _kept:
            _kept[a_path, b_path] = cls(a_path, b_path)
        return _kept[a_path, b_path]

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: n_a, n_b, n_groups, n_links; all zero where the bytes differ.
        self.counts = np.zeros((0, 4), np.int32)
        self.good = np.zeros(0, bool)
        self.pair_at, self.text_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pairs, self.text = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def rows_of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each piece; new pieces are aligned first."""
        u, first, back = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > TABLE_PIECES:
            self.clear()
        pos = np.searchsorted(self.keys, u)
        known = self.keys[np.minimum(pos, len(self.keys) - 1)] == u if len(self.keys) else np.zeros(len(u), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            row0 = len(self.counts)
            self._add([raw[x:y] for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            keys, rows = np.append(self.keys, u[new]), np.append(self.rows, row0 + np.arange(len(new)))
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], rows[order]
            pos = np.searchsorted(self.keys, u)
        return self.rows[pos][back]

    def _add(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        got = self.a.encode(texts), self.b.encode([t[1:] for t in texts])
        good = np.array([b"".join([self.a.bytes[i] for i in x]) == p and b"".join([self.b.bytes[i] for i in y]) == p for p, x, y in zip(pieces, *got, strict=True)], bool)
        counts, pairs, written, links, chars = self._aligned([x for x, ok in zip(got[0], good, strict=True) if ok], [y for y, ok in zip(got[1], good, strict=True) if ok])
        own = np.zeros((len(pieces), 4), np.int32)
        own[good] = counts
        n_links, n_chars = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        n_links[good], n_chars[good] = links, chars
        self.pair_at = np.append(self.pair_at, self.pair_at[-1] + np.cumsum(n_links))
        self.text_at = np.append(self.text_at, self.text_at[-1] + np.cumsum(n_chars))
        self.counts, self.good = np.concatenate((self.counts, own)), np.append(self.good, good)
        self.pairs, self.text = np.append(self.pairs, pairs), np.append(self.text, np.frombuffer(written, np.uint8))

    def _aligned(self, of_a: list[list[int]], of_b: list[list[int]]):
        """(n_a, n_b, n_groups, n_links) of each piece, all id pairs, all groups written out, and how many of each a piece has."""
        n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b)]
        flat = [np.fromiter((i for x in y for i in x), np.int64, int(m.sum())) for y, m in zip((of_a, of_b), n, strict=True)]
        size = [t[f] for t, f in zip((self.a_size, self.b_size), flat, strict=True)]
        owner = [np.repeat(np.arange(len(f)), s) for f, s in zip(flat, size, strict=True)]
        change = [np.append(np.ones(min(1, len(o)), bool), o[1:] != o[:-1]) for o in owner]
        at, cut = np.flatnonzero(change[0] | change[1]), change[0] & change[1]
        pairs = flat[0][owner[0][at]] * self.wide + flat[1][owner[1][at]]
        group = np.cumsum(cut) - 1
        begins = [np.cumsum(s) - s for s in size]
        # Pieces begin with a cut; that of byte x is found by where pieces end.
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(n[0])), n[0]), size[0], len(n[0])).astype(np.int64))
        piece_of = lambda where: np.bincount(np.searchsorted(ends, where, "right"), minlength=len(ends))
        links, groups = piece_of(at), piece_of(np.flatnonzero(cut))
        # Tokens in order of groups, those of A before those of B.
        of = [group[x] for x in begins]
        last = [np.append(g[1:] != g[:-1], np.ones(min(1, len(g)), bool)) for g in of]
        words = np.concatenate([w[f + x * (len(w) // 2)] for w, f, x in zip(self.written, flat, last, strict=True)]) if len(pairs) else np.zeros(0, object)
        order = np.lexsort((np.repeat((0, 1), [len(f) for f in flat]), np.concatenate(of)))
        words = words[order]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        piece = np.concatenate([np.repeat(np.arange(len(m)), m) for m in n])[order]
        chars = np.bincount(piece, lengths, len(n[0])).astype(np.int64)
        return np.stack([*n, groups, links], 1), pairs, b"".join(words.tolist()), links, chars


_ALIGNED = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
_ALIGNED_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(column: pa.Array, a_path: str, b_path: str):
    """The columns of _ALIGNED after doc_id for chunks of a text column; pairs are distinct, with how often each is linked."""
    table = PieceTable.get(a_path, b_path)
    for i, j, buf, offsets in chunks(*buffers(column), ALIGNED_BYTES):
        full = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][full], np.uint8(32))
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        starts = piece_starts(buf, offsets[np.append(full, True)], table.b.apart) if len(buf) else np.zeros(0, np.int64)
        rows = table.rows_of(buf, starts, np.append(starts[1:], len(buf))) if len(starts) else np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        good = np.bincount(doc[~table.good[rows]], minlength=j - i) == 0
        some = good[doc]
        rows, doc = rows[some], doc[some]
        sums = [np.bincount(doc, table.counts[rows, k], j - i).astype(np.int64) for k in range(4)]
        n = table.text_at[rows + 1] - table.text_at[rows]
        text = table.text[spread(table.text_at[rows], n)].tobytes()
        at = np.concatenate(([0], np.cumsum(np.bincount(doc, n, j - i).astype(np.int64)))).tolist()
        sha = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]
        n = table.pair_at[rows + 1] - table.pair_at[rows]
        pairs, of = table.pairs[spread(table.pair_at[rows], n)], np.repeat(doc, n)
        order = np.lexsort((pairs, of))
        pairs, of = pairs[order], of[order]
        head = np.flatnonzero(np.append(np.ones(min(1, len(pairs)), bool), (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])))
        times = np.diff(np.append(head, len(pairs))).astype(np.int32)
        at = pa.array(np.searchsorted(of[head], np.arange(j - i + 1)).astype(np.int32))
        yield i, j, [*sums, pa.array(sha, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs[head])), pa.ListArray.from_arrays(at, pa.array(times))]


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (a number for each input row) and the columns of _ALIGNED, in the shared folder."""
    schema = pa.schema(_ALIGNED)

    def align(it):
        for b in it:
            key = ids(b.column(0))
            for i, j, columns in aligned(b.column(1), a_path, b_path):
                yield from batches([longs(key[i:j]), *columns], schema)
        release()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, _ALIGNED_COLUMNS).withColumn("row", F.monotonically_increasing_id())
    path = shared_dir(docs.sparkSession)
    # Pairs ascend in a row, so their differences are small.
    rows.write.options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(rows: DataFrame, wide: int, parts: int) -> DataFrame:
    """pair, n (documents that have it linked), best (whether no other pair of its A id has more), in the shared folder."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(it):
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            pair, n = np.concatenate([held[0], *waiting]), np.concatenate([held[1], np.ones(size, np.int64)])
            order = np.argsort(pair, kind="stable")
            pair, n = pair[order], n[order]
            head = np.flatnonzero(np.append(np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]))
            return pair[head], np.add.reduceat(n, head) if len(head) else n

        for b in it:
            waiting.append(_flat(b.column(0)))
            size += len(waiting[-1])
            if size >= max(SUMMED_PAIRS // 2, len(held[0])):
                held, waiting, size = merged(), [], 0
                if len(held[0]) > SUMMED_PAIRS:
                    yield from batches(list(held), schema)
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from batches(list(merged()), schema)
        release()

    sums = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(sums, parts)
    # One row for each id of A's vocabulary.
    a = F.floor(F.col("pair") / wide).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return staged(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), parts)


def _threshold(counts: DataFrame, held: int) -> int:
    """The least power of two so that at most `held` pairs have as many documents."""
    by = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("k")).count().collect()}
    k = max(by, default=0) + 1
    while k > 0 and sum(m for x, m in by.items() if x >= k - 1) <= held:
        k -= 1
    return 1 << k


def alignment(docs: DataFrame, a_path: str, b_path: str, held: int = HELD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one per input row.

    Null and empty texts, and those whose tokens of A or of B joined are other bytes
    than a space and the text, have no tokens: zeros and an empty digest, and they
    count nowhere. Each row is a document of its own: ids may be null or repeated,
    and repeated rows get equal results. Other columns are not read; an empty
    table gives an empty result.

    Counts of the most frequent pairs, up to `held` of them, are held by every task;
    of the others, each of which few documents have, documents and counts are joined.
    """
    from sentencepiece import SentencePieceProcessor

    wide = SentencePieceProcessor(model_file=b_path).get_piece_size()
    parts = max(12, -(-plan_bytes(docs) // PART_BYTES))
    rows = aligned_rows(docs, a_path, b_path)
    counts = pair_counts(rows, wide, parts)
    least = _threshold(counts, held)
    known = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(known["pair"].to_numpy())
    handle = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = ["n_best", "count_sum"]
    schema = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())] + [(n, pa.int64()) for n in names])

    def found(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = handle.value[0]
        at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        return at, keys[at] == pair if len(keys) else np.zeros(len(pair), bool)

    def score(it):
        _, n, best = handle.value
        for b in it:
            pairs, times = b.column(7), _flat(b.column(8)).astype(np.int64)
            at, ok = found(_flat(pairs))
            of = np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))[ok]
            at, times = at[ok], times[ok]
            add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.searchsorted(of, np.arange(b.num_rows + 1))])
            yield from batches([*b.columns[:7], add(times * best[at]), add(times * n[at])], schema)

    scored = rows.select(*schema.names[:7], "pairs", "times").mapInArrow(score, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in schema))
    if least > 1:
        narrow = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])

        def rare(it):
            for b in it:
                pair, times = _flat(b.column(1)), _flat(b.column(2)).astype(np.int64)
                some = np.flatnonzero(~found(pair)[1])
                row = np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy()))
                yield from batches([row[some], pair[some], times[some]], narrow)

        others = rows.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long").join(counts.filter(F.col("n") < least), "pair")
        more = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        scored = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
