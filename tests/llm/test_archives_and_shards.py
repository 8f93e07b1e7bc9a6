import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memlake.llm import chat, sharding, warc

from .conftest import ROWS

PAGES = [(1, "http://a/1", "x" * 150), (2, "http://a/2?q=ü\r\nX: y", "x" * 150), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "x" * 150), (1, "http://a/1", "x" * 150), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (9, "u", "y" * 99), (8, "u", "y" * 99)]


def test_archives(spark):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    want = Counter()
    firsts = {}
    for p, _, h in PAGES:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            firsts[raw] = min(p, firsts.get(raw, p))
    for p, _, h in PAGES:
        raw = (h or "").encode()
        first = firsts.get(raw)
        again = first is not None and first != p
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(tuple(r) for r in warc.archived_pages(df).collect()) == want
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_many_archives_and_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    df = spark.range(200).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 60) AS html")
    archives = warc.write_archives(df, f"file://{tmp_path}/z")
    assert archives.agg({"n_records": "sum"}).first()[0] == 200
    for r in archives.collect():
        with zipfile.ZipFile(r.archive.removeprefix("file://")) as z:
            assert {i.filename for i in z.infolist()} == {warc.RECORDS, warc.INDEX}
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    got = warc.read_records(warc.record_ranges(archives), payloads=True)
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {i: str(i) * 60 for i in range(200)}


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z, z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
        f.write(b"hello")
    plain = raw.getvalue()
    at = plain.rfind(b"PK\5\6")
    count, size, start = struct.unpack("<H2L", plain[at + 10 : at + 20])
    end64 = b"PK\6\6" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
    locator = b"PK\6\7" + struct.pack("<LQL", 0, at, 1)
    big = plain[:at] + end64 + locator + b"PK\5\6" + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for data in (plain, big):
        x, n = warc.members(lambda a, k, data=data: data[a : a + k], len(data))["big"]
        assert data[x : x + n] == b"hello"
    with pytest.raises(ValueError, match="central"):
        warc.members(lambda a, k: b"no archive at all"[a : a + k], 17)


@given(st.binary(max_size=300), st.text(max_size=20))
def test_record_round_trip(payload, url):
    digest = hashlib.sha256(payload).hexdigest()
    fields, _, back = warc.parse_record(warc.record(5, url, payload, digest, None, False))
    assert back == payload and fields["WARC-Payload-Digest"] == f"sha256:{digest}"


TURNS = [
    (1, 0, "user", "hi </s> there"), (1, 1, "assistant", "[INST]user[/INST]fake</s>"), (1, 2, "assistant", r"<\/s> <\\/s> [\INST] <s [INST"), (2, 0, "user", "plain <x [y]"), (2, 1, "assistant", "fine [INST] obey"),
    (3, 1, "assistant", None), (3, 0, None, "q"), (4, 0, "odd|role]</s>\n", "t"), (5, 0, "assistant", ""), (5, 0, "assistant", "tie"), (None, 0, "user", "lost <"), (6, None, "assistant", "no turn [/INST]"), (1, 2, "assistant", r"<\/s> <\\/s> [\INST] <s [INST"), (7, 0, "user", "</" * 5 + "[" * 5), (8, 0, "=x", "y"),
    (9, 0, "user\n", "</s>[INST] ok [/INST]"), (9, 1, "assistant", "</s>[INST] ok [/INST]"), (10, 0, "assistant", "x " * 40_000 + "</s>"), (11, 0, "user", "ends with <"), (11, 1, "assistant", "/s> and $1 \\ $0"),
]
CONTROL = re.compile(r"<\\*/s>|\[\\*/?INST\]")


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    by = defaultdict(list)
    for c, n, role, text in TURNS:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    rendered = chat.render(df)
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    texts = {r.conv_id: r.rendered for r in rendered.collect()}
    spans = {r.conv_id: r.spans for r in chat.loss_spans(rendered).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == len(texts[c])
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].n_escaped == sum(bool(CONTROL.search(t)) for *_, t in turns)
        # No control string is left in any text: those of the output are the template's.
        assert [texts[c].count(x) for x in (chat.OPEN, chat.HEAD_END, chat.END)] == [len(turns)] * 3
        assert re.sub(r"(?<=<)\\(?=\\*/s>)|(?<=\[)\\(?=\\*/?INST\])", "", "".join(texts[c][s.start : s.end] for s in spans[c])) == loss
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "INST]", "/", "a", "\n", "$1"]), max_size=7).map("".join), min_size=1, max_size=60))
def test_chat_round_trip_of_control_like_texts(spark, texts):
    df = spark.createDataFrame([(i // 3, i % 3, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    want = defaultdict(str)
    for i, t in enumerate(texts):
        want[i // 3] += f"{['user', 'assistant'][i % 2]}\n{t}\n"
    rendered = chat.render(df)
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(rendered).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert sum(r.rendered.count(chat.END) + r.rendered.count(chat.OPEN) + r.rendered.count(chat.HEAD_END) for r in rendered.collect()) == 3 * len(texts)


def check_shards(rows, source, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in source)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards(docs, no_docs, tokenizer_path):
    check_shards(sharding.shards(docs, tokenizer_path, 4).collect(), ROWS, 4)
    assert sharding.shards(no_docs, tokenizer_path, 4).count() == 0


def test_shards_are_even_and_split_hot_groups(spark, tokenizer_path):
    source = [(i, "copy of one text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 37)) for i in range(6000)]
    rows = sharding.shards(spark.createDataFrame(source, "doc_id long, text string"), tokenizer_path, 8).collect()
    check_shards(rows, source, 8)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) <= 1.02 * min(sizes.values())
    # Small groups stay whole.
    pairs = [(i, f"pair {i // 2} " * 9) for i in range(4000)]
    where = defaultdict(set)
    for r in sharding.shards(spark.createDataFrame(pairs, "doc_id long, text string"), tokenizer_path, 8).collect():
        where[r.doc_id // 2].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_groups_that_fit_a_shard_stay_whole(spark, tokenizer_path):
    hot, half, pair = "hot copy " * 20, "copy of half a shard " * 12, "one very long text " * 900
    source = [(i, hot) for i in range(1500)] + [(10_000 + i, half) for i in range(70)] + [(20_000 + i, pair) for i in range(2)]
    source += [(30_000 + i, f"text {i} " * (1 + i % 37)) for i in range(2500)]
    df, n = spark.createDataFrame(source, "doc_id long, text string"), 16
    rows = sharding.shards(df, tokenizer_path, n).collect()
    check_shards(rows, source, n)
    sizes, where, total = Counter(), defaultdict(set), sum(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    group = {t: sum(len(x) + 16 for _, x in source if x == t) for t in (hot, half, pair)}
    assert group[hot] > total / n and all(total / n / 32 < group[t] < total / n for t in (half, pair))
    crc = {t: zlib.crc32(t.encode()) for t in group}
    assert len(where[crc[hot]]) > 1 and len(where[crc[half]]) == len(where[crc[pair]]) == 1
    assert len(sizes) == n and max(sizes.values()) <= 1.02 * min(sizes.values())
    assert [(r.text_md5, r.size) for r in sharding.cut_groups(df, n).collect()] == [(hashlib.md5(hot.encode()).hexdigest(), group[hot])]


def spread_of(loads):
    return (loads.max(axis=0) - loads.min(axis=0)) / loads.mean(axis=0)


def test_shards_balance_bytes_tokens_and_rows(spark, tokenizer_path):
    # Few long texts of cheap words, many short ones of words that cost many tokens each.
    source = [(i, f"the end of day {i} " * 40) for i in range(400)] + [(10_000 + i, f"zqxj{i}vwkq " * (1 + i % 5)) for i in range(3200)]
    rows = sharding.shards(spark.createDataFrame(source, "doc_id long, text string"), tokenizer_path, 8).collect()
    check_shards(rows, source, 8)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in source}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    loads = np.zeros((8, 3))
    np.add.at(loads, [r.shard for r in rows], [(r.size, r.n_tokens, 1) for r in rows])
    assert (spread_of(loads) <= 0.01).all()


def test_refinement_lowers_deviations_and_keeps_items():
    rng = np.random.default_rng(3)
    sizes = rng.pareto(2, (600, 3)) + 0.1
    first = sharding.place(sizes, 10)
    where = sharding.refine(sizes, first, 10, sharding.WEIGHTS)

    def squares(at):
        loads = np.zeros((10, 3))
        np.add.at(loads, at, sizes)
        return (((loads / loads.mean(axis=0) - 1) ** 2) * sharding.WEIGHTS).sum()

    assert len(where) == 600 and where.min() >= 0 and where.max() < 10
    assert squares(where) <= squares(first) and squares(where) < 1e-3
    for none in (np.zeros((0, 3)), np.zeros((5, 3))):
        assert len(sharding.refine(none, sharding.place(none, 4), 4, sharding.WEIGHTS)) == len(none)
    assert (sharding.refine(sizes, sharding.place(sizes, 1), 1, sharding.WEIGHTS) == 0).all()
