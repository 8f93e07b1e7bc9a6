import datetime as dt
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.functions import dates, embed, snippet
from memlake.functions import text as T
from memlake.operators import dispatch, savers
from memlake.sources.rewrite import Changed, replace_text, rewrite_jsonl, split_lines


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*columns).first())


def test_byte_caps(spark):
    for t in ("abc", "aé" * 9, "🙂" * 5, "ab🙂", ""):
        for n in (1, 3, 4, 6):
            (got,) = one(spark, t, T.byte_prefix("t", n))
            assert got == t.encode()[:n].decode(errors="ignore") if len(t.encode()) > n else got == t
    assert one(spark, "é" * 10, T.cap_content("t", 5)) == ("éé\n[ng: truncated, original 20 bytes]",)
    assert one(spark, "a\x00b\tc\nd\x85e", T.sanitize_digest("t", 100)) == ("a b\tc\nd e",)
    assert one(spark, "x" * 20, T.sanitize_digest("t", 5)) == ("xxxxx[…]",)


def test_terms(spark):
    got = one(spark, "the de, É a x src/auth/login.rs Não", T.query_terms("t"), T.fold_tokenize("t"), T.normalize("t"))
    assert got[0] == ["de,", "É", "src/auth/login.rs", "Não"]
    assert got[1] == ["the", "de", "e", "a", "x", "src", "auth", "login", "rs", "nao"]
    assert one(spark, "Autostart 12  Run3 now", T.normalize("t")) == ("autostart  run now",)


def test_tags(spark):
    (tags,) = one(spark, 'see "src/a.rs", http://x.y/z. the Parser parser 123 v1.2. a-b', T.extract_tags("t"))
    tags = tags.split()
    assert tags[:2] == ["src/a.rs", "http://x.y/z."] and tags[2] == "parser" and "123" not in tags and "the" not in tags and "v1.2" in tags
    assert len(one(spark, " ".join(f"word{i}" for i in range(40)), T.extract_tags("t"))[0].split()) == 24
    assert one(spark, "", T.extract_tags("t")) == one(spark, None, T.extract_tags("t")) == ("",)
    assert one(spark, "b a b a c c c a/b a/b x/y/z (a/b) ééé", T.extract_tags("t")) == ("x/y/z ééé",)


def test_mostly_code(spark):
    assert one(spark, '{"a": [1, 2], "b": {"c": "d"}, "e": "f", "g": 1}', T.is_mostly_code("t")) == (True,)
    assert one(spark, "plain prose that goes on for far more than some forty characters (once)", T.is_mostly_code("t")) == (False,)
    assert one(spark, "{}();", T.is_mostly_code("t")) == (False,)


def test_dates(spark):
    assert one(spark, "2024-02-29", dates.parse_date("t")) == (int(dt.datetime(2024, 2, 29, tzinfo=dt.UTC).timestamp()),)
    for bad in ("2023-02-29", "2023-13-01", "x", "2023-1-1", ""):
        assert one(spark, bad, dates.parse_date("t")) == (None,)
    at = int(dt.datetime(2026, 7, 18, 10, tzinfo=dt.UTC).timestamp())
    for s, want in {"2026-07-18T10:00:00Z": at, "2026-07-18 10:00:00.123z": at, "2026-07-18T10:00:00+02:30": at - 9000, "2026-07-18t10:00:00-0100": at + 3600, "2026-13-18T10:00:00Z": None, "2026-07-18": None, "2026-07-18T10:00:00+1": None}.items():
        assert one(spark, s, dates.rfc3339_epoch("t")) == (want,), s


def test_hash_embedding(spark):
    v = embed.hash_vector("Ação")
    assert abs(float((v * v).sum()) - 1) < 1e-6 and (embed.hash_vector("acao") == v).all()
    assert embed.hash_vector("").sum() == 0 and (embed.hash_vector("ab") != 0).sum() == 1
    texts = ["Ação", "", "a", "é🙂", "naïve 日本語 🙂 text", "\u0800\uffff\U0010ffff" * 3]
    for t, got in zip(texts, embed.hash_vectors(texts), strict=True):
        low, want = t.lower().translate(embed._folded), [0] * 256
        for g in [low] if 0 < len(low) < 3 else [low[i : i + 3] for i in range(len(low) - 2)]:
            h = embed.fnv1a(g.encode())
            want[h % 256] += 1 if h // 256 & 1 else -1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert max(abs(x / norm - y) for x, y in zip(want, got.tolist(), strict=True)) < 1e-6
    assert embed.fnv1a(b"") == 0x811C9DC5 and embed.fnv1a(b"a") == 0xE40C292C
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(embed.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("aa bb cc. dd ee: ff gg hh".split()), min_size=1, max_size=60), st.lists(st.sampled_from(["aa", "bb", "cc dd", "ff", "zz"]), min_size=1, max_size=3, unique=True), st.sampled_from([4, 8, 24]))
def test_snippets_are_sqlites(ws, phrases, n):
    text = " ".join(ws)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='unicode61 remove_diacritics 2')")
    db.execute("INSERT INTO f VALUES (?)", (text,))
    query = " OR ".join(f'"{p}"' for p in phrases)
    row = db.execute("SELECT snippet(f, 0, '>>', '<<', '…', ?) FROM f WHERE f MATCH ?", (n, query)).fetchone()
    if row:
        assert snippet.snippet(text, [p.split() for p in phrases], n, ">>", "<<") == row[0]


def test_dispatch(spark):
    df = spark.createDataFrame([(1, "please FIX this typo"), (2, "nothing here"), (3, "fix the design"), (4, None), (5, "research and compare systems")], "query_id int, prompt string")
    got = {r.query_id: (r.category, r.model) for r in dispatch.suggest(df).collect()}
    assert got[1] == ("quick_fix", "haiku") and got[2] == got[4] == ("standard", "sonnet") and got[3][0] == "architecture" and got[5][0] == "research"
    tie = dispatch.default_config() | {"keywords": {"quick_fix": ["aaaa"], "research": ["bbbb"]}}
    assert dispatch.suggest(spark.createDataFrame([(1, "aaaa bbbb")], "query_id int, prompt string"), tie).first().category == "standard"
    assert dispatch.config_from_toml('[rules]\nstandard = "big"')["rules"]["standard"] == "big"
    with pytest.raises(Exception):
        dispatch.config_from_toml("[rules")
    with pytest.raises(ValueError):
        dispatch.saver_config('[savers.a]\ncommand = "x"', '[savers.a]\ncommand = "y"')
    assert dispatch.saver_config('[savers.a]\ncommand = "x"', "[savers.a]\nenabled = false")["a"] == {"command": "x", "enabled": False}


def test_saver_refs(spark):
    assert one(spark, "zip:k:1", savers.parse_ref("t"))[0].asDict() == {"saver": "zip", "key": "k:1"}
    for bad in ("zip", ":k", "zip:", "zip:a b", "zip:" + "x" * 300):
        assert one(spark, bad, savers.parse_ref("t")) == (None,)


def test_rewrite(tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"a":1}\r\nbroken\n{"message":{"content":[{"type":"text","text":"long"}]}}\n')
    assert split_lines(p.read_bytes().decode())[0].endswith("\r")
    new = replace_text(split_lines(p.read_bytes().decode())[2], "claude-code", "stub")
    backup = rewrite_jsonl(str(p), [2], [(3, new)])
    assert p.read_bytes().decode() == '{"a":1}\r\n{"message":{"content":[{"type":"text","text":"stub"}]}}\n'
    assert "broken" in open(backup).read()
    for drops, reps in (([9], []), ([1], [(1, "{}")]), ([], [(1, "a\nb")]), ([], [(1, "no json")])):
        with pytest.raises(ValueError):
            rewrite_jsonl(str(p), drops, reps)
    assert replace_text('{"x":1}', "claude-code", "s") is None and issubclass(Changed, RuntimeError)
