"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import align, chat, decontaminate, jaccard, packing, quality, sharding, simhash, substring, tokens, trie, warc

#: The tokenizer's file in the public collection; its place is asked of that package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), tokenizer_path(), 40)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(chat.render(rows.unionByName(own)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path(), 1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda p: int(p[0][2:].split("_")[0])))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER_WORDS = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_ALNUM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _again(n: str) -> str:
    """First words of windows of n words that their document has twice or more."""
    return f"SELECT doc_id, i FROM (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {n} - 1), ' ')) AS g FROM s, LATERAL (SELECT unnest(range(1, n_words - {n} + 2)) AS i)) QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1"


#: CRC-32 of a decimal number, bit by bit: a byte is taken in, then eight times a bit is shifted out.
_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda i: [CAST(ord(substring(CAST({0} AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

ORACLES = {
    "op4_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (h)""",
    "op5_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(17 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/s>|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars,
               CAST(count(*) FILTER (regexp_matches(text, '<\\*/s>|\[\\*/?INST\]')) AS BIGINT) AS n_escaped
        FROM c GROUP BY conv_id""",
    "op7_quality_rules": f"""
        WITH s AS MATERIALIZED (SELECT *, CAST(len(ws) AS BIGINT) AS n_words FROM (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents)),
        three AS ({_again("3")}), eight AS ({_again("8")}), long AS ({_again("(least(200, n_words * 15 // 100) + 1)")}),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM three, LATERAL (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM eight, LATERAL (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
        l AS (SELECT DISTINCT doc_id FROM long),
        f AS (SELECT doc_id, n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_covered, l.doc_id IS NOT NULL AS too_long
              FROM s LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 100 * n_covered <= 30 * n_words AND NOT too_long AS kept, n_covered
        FROM b""",
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i)),
        least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        cut AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (g), LATERAL (SELECT unnest(range(0, 13)) AS k) WHERE m < doc_id),
        gone AS (SELECT doc_id, list(p) AS ps FROM cut GROUP BY doc_id),
        both_ AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
        FROM both_""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(ws, i, i + least(5, len(ws)) - 1) AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i) WHERE len(ws) > 0),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op10_decontamination": f"""
        WITH b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) AS g FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i) WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT len(g) AS n FROM bw),
        d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
        win AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)),
        hit AS (SELECT doc_id, i, n, item_id FROM win JOIN bw USING (g)),
        pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op13_prefix_trie": f"""
        WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
        s AS MATERIALIZED (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS shared, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS size FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (SELECT s.conv_id, o.p AS d, role, text, size FROM s JOIN o ON o.conv_id = s.base AND o.p <= s.shared
              UNION ALL SELECT s.conv_id, s.shared + o.p - s.h, role, text, size FROM s JOIN o ON o.conv_id = s.conv_id AND o.p > s.h),
        w AS MATERIALIZED (SELECT conv_id, d, size, length(text) AS chars, md5(CAST(list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS VARCHAR)) AS k FROM r
                           UNION ALL SELECT conv_id, 0, size, 0, '' FROM s),
        nodes AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(CASE WHEN d = size THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM w GROUP BY d, k),
        up AS (SELECT n.d, n.k, a.k AS above FROM nodes n JOIN w a ON a.conv_id = n.conv_id AND a.d = n.d - 1),
        kids AS (SELECT d - 1 AS d, above AS k, count(*) AS n FROM up GROUP BY ALL),
        leaf AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
        roll AS (SELECT a.d, a.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * leaf.chars) AS saved FROM leaf JOIN w a ON a.conv_id = leaf.conv_id AND a.d <= leaf.d GROUP BY a.d, a.k)
        SELECT leaf.conv_id, CAST(leaf.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(leaf.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(leaf.ends, '')) AS ends_sha256
        FROM leaf JOIN roll USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN nodes p ON p.d = leaf.d - 1 AND p.k = up.above""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
