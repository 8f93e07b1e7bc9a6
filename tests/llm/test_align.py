import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import align
from memlake.llm.queries import tokenizer_path

from .conftest import ROWS

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def brute_align(libraries, text):
    """Whole texts by the libraries, byte by byte: ids, groups written out, links."""
    a, b = libraries
    if not text:
        return 0, 0, 0, Counter(), ""
    letters = align.byte_alphabet()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return 0, 0, 0, Counter(), ""
    owner = [[k for k, p in enumerate(of) for _ in p] for of in (of_a, of_b)]
    links, groups, seen = Counter(), [], set()
    for at in range(len(raw)):
        p, q = owner[0][at], owner[1][at]
        if at == 0 or (owner[0][at - 1] != p and owner[1][at - 1] != q):
            groups.append(([], []))
        for ids, side, k in ((x, 0, p), (y, 1, q)):
            if at == 0 or owner[side][at - 1] != k:
                groups[-1][side].append(str(ids[k]))
        if (p, q) not in seen:
            seen.add((p, q))
            links[x[p], y[q]] += 1
    written = ";".join(",".join(g) + "|" + ",".join(h) for g, h in groups)
    return len(x), len(y), len(groups), links, hashlib.sha256(written.encode()).hexdigest()


def brute_alignment(libraries, rows):
    found = [(d, brute_align(libraries, t)) for d, t in rows]
    count = Counter(p for _, f in found for p in f[3])
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = Counter()
    for d, (n_a, n_b, n_groups, links, sha) in found:
        n_best = sum(k for p, k in links.items() if count[p] == best[p[0]])
        out[d, n_a, n_b, n_groups, sum(links.values()), n_best, sum(k * count[p] for p, k in links.items()), sha] += 1
    return out


ODD = ["a ", " a", "  a  b   c    ", "x\n y\n\n  z\t w\r\n", "\u2581 up \u2581", "a\u00a0 b\u2003 c", "\u3000 x \u202f y \u205f z \u1680 w", "it's we'll 's 't  've", "<|endoftext|> <s> </s> <unk> <0x41>", "na\u00efve e\u0301 \ufb00 \u65e5\u672c\u8a9e \U0001f642   z", "\x00 \x1c x\x1d y \x85 z", "123 4567 89,0.5 -- ==> ;;", "q" * 3000 + " " + "zx" * 400, "\u201cquoted\u201d \u2026 \u2014 \u00abtexte\u00bb \u00e0 \u00e9 ", " ", "  ", "\n", "a  b   c   d"]


def random_texts(n=400, seed=11):
    rng = np.random.default_rng(seed)
    some = list(" " * 12 + "\n\t\x0b\x1c\x85\u00a0\u2003\u3000\u2028\u2581'strevldmaeionu,.;<>|_0123456789\u00e9\u00fc\u00df\u65e5\u672c\u201c\u2019\u2026\U0001f642\u0301")
    return ["".join(rng.choice(some, int(rng.integers(1, 40)))) for _ in range(n)]


def test_pieces_equal_whole_texts(libraries):
    texts = ODD + random_texts()
    path_a, path_b = tokenizer_path(A), tokenizer_path(B)
    table = align.PieceTable.get(path_a, path_b)
    assert table.b.apart and table.a.quick is not None
    for i, j, (n_a, n_b, n_groups, n_links, sha, pairs, times) in align.aligned(pa.array(texts), path_a, path_b):
        for k in range(j - i):
            want = brute_align(libraries, texts[i + k])
            got = Counter({(p // table.wide, p % table.wide): n for p, n in zip(pairs[k].as_py(), times[k].as_py(), strict=True)})
            assert (int(n_a[k]), int(n_b[k]), int(n_groups[k]), got, sha[k].as_py()) == want, ascii(texts[i + k])
            assert int(n_links[k]) == sum(got.values())


@pytest.mark.parametrize("held", [10_000, 30, 0])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, held):
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(ODD + random_texts(40, 3)))]
    monkeypatch.setattr(align, "SUMMED_PAIRS", 200)
    monkeypatch.setattr(align, "TABLE_PIECES", 100)
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, row int, pairs int").repartition(3)
    got = align.alignment(df, tokenizer_path(A), tokenizer_path(B), held)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(libraries, rows)


def test_no_documents(spark, no_docs):
    assert align.alignment(no_docs, tokenizer_path(A), tokenizer_path(B)).count() == 0
