"""The prefix trie of conversations: shared turns, and what storing them once saves.

A node is a distinct sequence of first turns, named by its depth and a digest of
128 bits, which a turn's place and its hashes are added to by exclusive or: so the
digests along a conversation are prefix sums, taken in parts that are then added up,
and a very long conversation is no one task's. Each node knows its parent's digest.
Leaves and savings are rolled up by pointer jumping: in round k every node adds what
it has gathered to its ancestor 2^k above, then points twice as far, so that there
are as many rounds as the greatest depth has binary digits, whatever the shape.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, staged

#: Every conversation is rebuilt on the first of its run of so many ids, and takes over fewer turns than REUSED.
RUN, REUSED = 100, 6
#: Bytes of input for a part, and of joined ids that travel as one string.
PART_BYTES, ENDS_BYTES = 32 << 20, 1 << 16

_KEY = ["d", "k1", "k2"]


def _placed(conversations: DataFrame) -> DataFrame:
    """conv_id, place (ascending in the order of turns), part, t1, t2 (two hashes of role and text), chars; without texts, in the shared folder."""
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange(partitions_for(conversations, PART_BYTES), "conv_id", turn, "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", turn, "role", "text")
    hashes = [F.xxhash64(F.lit(k), F.length("role"), "role", "text").alias(f"t{k}") for k in (1, 2)]
    out = staged(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), *hashes, F.length("text").cast("long").alias("chars")))
    return out.withColumn("part", F.shiftright("place", 33))


def rebuilt(conversations: DataFrame, run: int = RUN, reused: int = REUSED) -> tuple[DataFrame, DataFrame]:
    """convs: conv_id, size (turns once rebuilt); rows: conv_id, part, d, t1, t2, chars, last, a row for each rebuilt turn.

    A conversation's turns are counted in parts of the sorted table, whose counts alone are ranked together.
    """
    placed = _placed(conversations)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("m"), F.min("place").alias("first"))
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n"))
    convs = parts.filter("before = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % run).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % reused).alias("h"))
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(convs.join(bases, "base", "left").select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    pos = F.col("before") + F.col("place") - F.col("first") + 1
    own = placed.join(parts.join(convs, "conv_id"), ["conv_id", "part"]).withColumn("pos", pos)
    columns = ["conv_id", "part", "d", "t1", "t2", "chars", (F.col("d") == F.col("size")).alias("last")]
    tail = own.filter("pos > h").withColumn("d", F.col("shared") + F.col("pos") - F.col("h")).select(*columns)
    # A base has fewer than `reused` turns to give, to fewer than 2 * run conversations.
    given = placed.filter(F.col("conv_id") % run == 0).join(parts.filter(F.col("before") < reused), ["conv_id", "part"]).withColumn("pos", pos).filter(F.col("pos") < reused)
    given = given.select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), F.lit(-1).cast("long").alias("part"), "t1", "t2", "chars")
    head = convs.filter("shared > 0").join(given, "base").filter("d <= shared").select(*columns)
    return convs.select("conv_id", "size"), head.unionByName(tail)


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, d, k1, k2, q1, q2 (the parent's), chars, last: the node of each rebuilt turn, in the shared folder."""
    hashed = rows.select("conv_id", "part", "d", "chars", "last", *(F.xxhash64(F.lit(k), "d", "t1", "t2").alias(f"h{k}") for k in (1, 2)))
    local = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.withColumns({f"x{k}": F.bit_xor(f"h{k}").over(local) for k in (1, 2)})
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "part").agg(*(F.bit_xor(f"h{k}").alias(f"s{k}") for k in (1, 2)))
    sums = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    found = inside.join(sums, ["conv_id", "part"])
    key = {k: F.col(f"x{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)}
    return staged(found.select("conv_id", "d", *(key[k].alias(f"k{k}") for k in (1, 2)), *(key[k].bitwiseXOR(F.col(f"h{k}")).alias(f"q{k}") for k in (1, 2)), "chars", "last"))


def _nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """d, k1, k2, q1, q2, conv_id, n_convs, chars: sums by node, most of which tasks make by themselves."""
    zero = {x: F.lit(0).cast("long") for x in ("d", "k1", "k2", "q1", "q2", "chars")}
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").withColumns(zero)
    below = paths.groupBy(*_KEY).agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    return staged(below.unionByName(root.select(*below.columns)))


def _ends(convs: DataFrame, paths: DataFrame, parts: int) -> DataFrame:
    """d, k1, k2, ends_sha256 of the nodes at which conversations end.

    Ids are sorted in ranges and joined to strings there; a node's strings follow one another
    through the digest, none of them held, as SHA-256 goes from front to end.
    """
    zero = [F.lit(0).cast("long").alias(x) for x in _KEY]
    ending = paths.filter("last").select(*_KEY, "conv_id").unionByName(convs.filter("size = 0").select(*zero, "conv_id"))
    sorted_ids = ending.repartitionByRange(parts, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    schema = pa.schema([*((x, pa.int64()) for x in _KEY), ("first", pa.int64()), ("ids", pa.string())])

    def join(it):
        for b in it:
            keys = [b.column(k).to_numpy() for k in range(3)]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            new[:: ENDS_BYTES // 8] = True
            at, ids = np.flatnonzero(new), b.column(3).to_pylist()
            joined = [",".join(map(str, ids[x:y])) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array([ids[x] for x in at.tolist()], pa.int64()), pa.array(joined)], schema=schema)

    strings = sorted_ids.mapInArrow(join, "d long, k1 long, k2 long, first long, ids string")
    out = pa.schema([*((x, pa.int64()) for x in _KEY), ("ends_sha256", pa.string())])

    def digest(it):
        now, sha = None, None
        for b in it:
            done = []
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, sha.hexdigest()), out, strict=True)], schema=out)

    return strings.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "d long, k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (d, k1, k2, q1, q2, ...) with each of the columns `sums` summed over the node's subtree, by pointer jumping.

    Before round k a node has gathered its descendants less than 2^k below and points
    2^k above; those at 2^k to 2^(k+1) - 1 are what the nodes that point at it have
    gathered. Sums are made by the tasks first, so a node with very many children is
    no hot key; joins have the table's one row for each node on their other side.
    """
    step, deepest = 1, nodes.agg(F.max("d")).first()[0] or 0
    while step <= deepest:
        above = [(F.col("d") - step).alias("d"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
        more = nodes.filter(F.col("d") >= step).groupBy(*above).agg(*(F.sum(x).alias(f"more_{x}") for x in sums))
        held = nodes.join(more, _KEY, "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in sums}).select(*nodes.columns)
        if step * 2 <= deepest:
            own = held.withColumns({"_d": F.col("d") - step, "_q1": F.col("q1"), "_q2": F.col("q2")}).drop("q1", "q2")
            far = nodes.select(*(F.col(x).alias(y) for x, y in (("d", "_d"), ("k1", "_q1"), ("k2", "_q2"))), "q1", "q2").filter(F.col("_d") >= step)
            held = own.join(far, ["_d", "_q1", "_q2"], "left").select(*nodes.columns)
        nodes, step = staged(held), step * 2
    return nodes


def prefix_trie(conversations: DataFrame, run: int = RUN, reused: int = REUSED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a row for each node.

    Conversations are rebuilt first: the first h turns of the conversation that
    begins their run of `run` ids, then their own after their first h, h being the
    CRC-32 of the decimal id modulo `reused`. Null roles and texts are empty; rows
    of one turn (or of none, which comes first) are ordered by role and text, so
    ties of other kinds are repeated rows, which are repeated turns. Rows without
    conv_id belong to no conversation and take no part. Turnless conversations end
    at the root. An empty table has no nodes. Other columns are not read.
    """
    convs, rows = rebuilt(conversations, run, reused)
    paths = _paths(rows)
    nodes = _nodes(convs, paths)
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    known = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": saved}).drop("chars")
    parent = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    known = staged(known.join(parent, ["d", "q1", "q2"], "left"))
    ends = _ends(convs, paths, partitions_for(conversations, PART_BYTES))
    out = rolled_up(known, ["n_leaves", "saved_tokens"]).join(ends, _KEY, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
