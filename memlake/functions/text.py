"""Text functions: folding, tokens, previews, byte caps, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, for the index and the hash embedding.
FOLD_FROM = "áàâãäåéèêëíìîïóòôõöúùûüçñ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuucn"
# The same for the evaluation, which leaves å and ñ.
BENCH_FOLD_FROM = "áàâãäéèêëíìîïóòôõöúùûüç"
BENCH_FOLD_TO = "aaaaaeeeeiiiiooooouuuuc"
# Stopwords, English then Portuguese.
STOPWORDS = (
    "the a an and or but if then else for of to in on at by with from as is are was were be been it its this "
    "that these those i you he she we they my your not no yes do does did have has had will would can could should "
    "there what which who how when where why all any some just also than "
    "o os um uma uns umas e ou mas se para por de da dos das em na nos nas com sem que quem qual quais "
    "como quando onde porque isso isto aquilo ele ela eles elas eu voce meu minha seu sua nao sim ser estar foi era "
    "sao esta estao tem tinha vai pode deve tambem mais menos muito pouco todo toda todos todas ja ainda so apenas"
).split()
# Limits and marks.
PREVIEW_CHARS = 200
CONTENT_CAP_BYTES = 256 * 1024
STRUCTURAL = '{}();=<>[]"'
TAG_TRIM = "\"'`(),;:<>[]{}"
MAX_TAGS, MIN_TOKEN_BYTES = 24, 3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_est(text: Column | str) -> Column:
    """UTF-8 bytes divided by 4."""
    return F.floor(F.octet_length(col(text)) / 4).cast("long")


def fold(text: Column | str) -> Column:
    """Lower case without the accents of the index's table."""
    return F.translate(F.lower(col(text)), FOLD_FROM, FOLD_TO)


def bench_fold(text: Column | str) -> Column:
    return F.translate(F.lower(col(text)), BENCH_FOLD_FROM, BENCH_FOLD_TO)


def fold_tokenize(text: Column | str) -> Column:
    """The index's tokens: runs of letters and digits of the folded text."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column | str) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda t: t != "")


def query_terms(query: Column | str) -> Column:
    """A query's terms: of two bytes or more, and no stopwords as they stand."""
    return F.filter(words(query), lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(STOPWORDS))


def match_expression(query: Column | str) -> Column:
    """The query as quoted terms joined by OR."""
    return F.array_join(F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def is_mostly_code(text: Column | str) -> Column:
    """40 characters or more, over 4 % of them structural."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.length(t)
    structural = n - F.length(F.translate(t, STRUCTURAL, ""))
    return (n >= 40) & (structural / n > 0.04)


def normalize(snippet: Column | str) -> Column:
    """Words in lower case without trailing digits: equal for near-equal snippets."""
    return F.array_join(F.transform(words(snippet), lambda w: F.lower(F.regexp_replace(w, "[0-9]+$", ""))), " ")


def preview(text: Column | str, n: int = PREVIEW_CHARS) -> Column:
    return F.substring(col(text), 1, n)


def truncate_chars(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def project_dir_name(path: Column | str) -> Column:
    return F.translate(col(path), "/.", "--")


def byte_prefix(text: Column | str, n: int) -> Column:
    """The longest whole-character prefix of at most n bytes; only longer texts are looked into."""
    t = col(text)
    raw = F.encode(t, "UTF-8")
    # A character is four bytes at most, so one of four cuts is at a character's end.
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(n, max(n - 4, -1), -1)))
    return F.when(F.octet_length(t) <= n, t).otherwise(cut)


def cap_content(text: Column | str, cap: int = CONTENT_CAP_BYTES) -> Column:
    """Cuts at a character's end and says how large the original was."""
    t = col(text)
    return F.when(F.octet_length(t) <= cap, t).otherwise(F.concat(byte_prefix(t, cap), F.lit("\n[ng: truncated, original "), F.octet_length(t).cast("string"), F.lit(" bytes]")))


def sanitize_digest(text: Column | str, most: int) -> Column:
    """Control characters but \\n and \\t become spaces; beyond `most` bytes the text is cut and marked."""
    clean = F.regexp_replace(col(text), r"[\p{Cc}&&[^\n\t]]", " ")
    return F.when(F.octet_length(clean) <= most, clean).otherwise(F.concat(byte_prefix(clean, most), F.lit("[…]")))


#: ASCII characters that no word of the tags has.
_NO_TAG = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum() and chr(c) not in "_-.")


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_frequency(tokens: Column) -> Column:
    """The different tokens, the most frequent first, of equal frequency in their order."""

    def ranked(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(F.sort_array(F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(s))).alias("n"), F.get(s, i).alias("t")))), lambda x: x["t"]))

    return _let(F.sort_array(tokens), ranked)


def extract_tags(text: Column | str) -> Column:
    """Up to 24 tags between spaces: paths and URLs as they stand, then the most frequent other words."""
    size = F.octet_length
    parts = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"[\s\p{Z}\x{85}]+"), lambda w: w != "")

    def is_path(w: Column) -> Column:
        return (w.contains("/") & (size(w) > MIN_TOKEN_BYTES)) | w.startswith("http")

    def is_ascii(w: Column) -> Column:
        return size(w) == F.length(w)

    def word(w: Column) -> Column:
        kept = F.when(is_ascii(w), F.translate(w, _NO_TAG, "")).otherwise(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}_.\-]", ""))
        return F.btrim(F.lower(kept), F.lit(".-"))

    def is_number(t: Column) -> Column:
        return F.when(is_ascii(t), F.translate(t, "0123456789", "") == "").otherwise(t.rlike(r"^\p{N}+$"))

    def tags(ws: Column) -> Column:
        trimmed = F.transform(F.filter(ws, is_path), lambda w: F.btrim(w, F.lit(TAG_TRIM)))
        paths = F.slice(F.array_distinct(F.filter(trimmed, lambda w: size(w) > MIN_TOKEN_BYTES)), 1, MAX_TAGS)
        words_ = F.filter(F.transform(F.filter(ws, lambda w: ~is_path(w)), word), lambda t: (size(t) >= MIN_TOKEN_BYTES) & ~is_number(t) & ~t.isin(STOPWORDS))
        return F.array_join(F.slice(F.concat(paths, F.array_except(_by_frequency(words_), paths)), 1, MAX_TAGS), " ")

    return _let(parts, tags)
