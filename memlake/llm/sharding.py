"""Shards balanced in bytes, tokens and rows together, by vector bin packing.

Rows with equal texts are a group and stay together. Groups are far too many to
place one by one, so small ones are first bundled by the hash of their text into
a fixed number of bundles; a group above a share of a shard is an item of its
own, of which there can only be a fixed number too. Only a group of more bytes
than a shard's equal part of the table is cut, into parts of that share. Items are placed largest first, each where
the dot product of its size with the shard's residual capacity is highest; then a
bounded number of moves and swaps between shards evens out what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import lengths

#: Bundles per shard, and a large group's least share of a shard (one in so many).
BUNDLES, LARGE = 256, 32
#: Pairs of shards that refinement looks at, and the deviation from an equal part (weighted) that it leaves.
TRIALS, NEAR = 3000, 1e-3
#: Weights of bytes (the law), tokens and rows in that.
WEIGHTS = np.array([64.0, 1.0, 1.0])


def _scaled(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Sizes with a shard's equal part of each dimension as 1; a dimension without any size is 0."""
    total = sizes.sum(axis=0).astype(float)
    return sizes / np.where(total > 0, total, 1) * shards


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of sizes), by highest dot product with residual capacity.

    An item goes where it fits in every dimension; where it fits nowhere, to the
    shard that it overfills least in its worst dimension. Items come in descending
    order of their largest scaled size, ties as given.
    """
    scaled = _scaled(sizes, shards)
    room = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-scaled.max(axis=1, initial=0), kind="stable"):
        v = scaled[i]
        left = room - v
        fits = (left >= -1e-9).all(axis=1)
        k = int(np.where(fits, room @ v, -np.inf).argmax() if fits.any() else left.min(axis=1).argmax())
        out[i] = k
        room[k] = left[k]
    return out


def refine(sizes: np.ndarray, where: np.ndarray, shards: int, weights: np.ndarray) -> np.ndarray:
    """where, after moves of an item or swaps of two that lower the weighted squares of all shards' deviations.

    The shard that deviates most meets the others, those farthest from it first.
    Ends when every shard is near its equal part, no exchange helps, or after TRIALS.
    """
    weight = np.sqrt(weights)
    v = _scaled(sizes, shards) * weight
    where, off, settled = where.copy(), -np.ones((shards, sizes.shape[1])) * (sizes.sum(axis=0) > 0) * weight, np.zeros(shards, bool)
    np.add.at(off, where, v)
    none, trials = np.zeros((1, sizes.shape[1])), 0
    while trials < TRIALS:
        far = np.where(settled, 0, np.abs(off).max(axis=1))
        a = int(far.argmax())
        if far[a] < NEAR:
            break
        mine = np.flatnonzero(where == a)
        settled[a] = True
        for b in np.argsort(-((off - off[a]) ** 2).sum(axis=1), kind="stable")[: shards - 1].tolist():
            trials += 1
            other = np.flatnonzero(where == b)
            # What a would give to b, by its item and b's; the last of each is no item.
            d = np.concatenate((v[mine], none))[:, None] - np.concatenate((v[other], none))[None]
            gain = (d * (off[a] - off[b] - d)).sum(axis=2)
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] > 1e-9:
                where[mine[i : i + 1]], where[other[j : j + 1]] = b, a
                off[a] -= d[i, j]
                off[b] += d[i, j]
                settled[:] = False
                break
    return where


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_group").agg(F.sum("size").alias("size"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"),
        text.alias("_text"),
    )


def _counted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows with n_tokens, the texts' exact token counts, instead of the texts."""
    schema = "doc_id long, size long, text_crc32 long, _group binary, n_tokens long"

    def count(it):
        for b in it:
            n = np.concatenate([np.zeros(0, np.int64), *lengths(b.column(4), tokenizer)])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], names=["doc_id", "size", "text_crc32", "_group", "n_tokens"])

    return rows.mapInArrow(count, schema)


def cut_groups(docs: DataFrame, n: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_md5, size: the groups of equal texts that shards() cuts, as they exceed a shard. Fewer than n, whatever the data."""
    groups = _groups(_rows(docs, id_col, text_col))
    total = groups.agg(F.sum("size").alias("_total"))
    return groups.join(F.broadcast(total), F.col("size") * n > F.col("_total")).select(F.lower(F.hex("_group")).alias("text_md5"), "size")


def shards(docs: DataFrame, tokenizer: str, n: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens; one per input row.

    size is the text's UTF-8 bytes plus 16, null text has no bytes and the checksum
    of none; n_tokens is the text's exact count by the tokenizer's file, null text has
    none. The law is `bytes`: shards' sizes are near equal; tokens and rows are
    balanced with them, in placement and in refinement, where bytes weigh more. slot numbers a shard's
    rows from 0 without gaps. A group of equal texts is one shard's unless its bytes
    exceed 1/n of the table's, when it is cut by ids into parts of about 1/LARGE
    of a shard, so that a third of all rows may be copies of one text; cut_groups()
    names these groups. Rows with equal ids and texts stay together. Whole groups of
    nearly a shard can make shards less even. An empty table gives an empty result.
    """
    rows = staged(_counted(_rows(docs, id_col, text_col), tokenizer))
    total = rows.agg(F.sum("size")).first()[0]
    items, bundles = None, n * BUNDLES
    part_bytes = max(1, (total or 0) // (n * LARGE))
    # At most n * LARGE groups are large, whatever the data; those that fit a shard are one part.
    parts = F.when(F.col("size") * n > (total or 0), F.ceil(F.col("size") / part_bytes)).otherwise(1)
    large = _groups(rows).filter(F.col("size") > part_bytes).select("_group", parts.cast("long").alias("_parts"))
    part = F.pmod(F.xxhash64("doc_id", "_group"), F.col("_parts"))
    named = rows.join(F.broadcast(large), "_group", "left")
    named = named.withColumn("_item", F.when(F.col("_parts").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(bundles)))).otherwise(F.concat(F.hex("_group"), F.lit("/"), part)))
    items = named.groupBy("_item").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("_item").collect()
    sizes = np.array([[r["size"], r["tokens"], r["rows"]] for r in items], float).reshape(-1, 3)
    where = refine(sizes, place(sizes, n), n, WEIGHTS)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(r["_item"], int(k)) for r, k in zip(items, where, strict=True)], "_item string, shard int")
    # Slots: rows are counted by shard and a salt of the id, so that no task ranks a whole shard.
    salts = max(8, sum(r["rows"] for r in items) // (n * 100_000))
    put = named.join(F.broadcast(placed), "_item").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    counts = put.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_salt", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = put.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32")) - 1).join(before, ["shard", "_salt"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_r") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
