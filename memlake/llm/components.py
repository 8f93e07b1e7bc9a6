"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple:
    """What changes when the table does."""
    r = edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


#: Links up to which the stars' minima are broadcast; more are joined by shuffling.
BROADCAST_LINKS = 1_000_000


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """node, component: the smallest node that links a, b lead to. Only nodes with links to others are listed.

    Each round points every neighbour at the smallest node of its star. Stars are
    joined with their minimum, never gathered, so a node with very many links is
    no task's list; the minima are summed before they are shuffled. Rounds end
    when the table stays as it is, after about log(nodes) of them; each is written
    to the shared folder, in `parts` files at most, which cuts the lineage.

    Links may repeat and go either way. Those from a node to itself, and those with a
    null end, join nothing and list nothing; without links nothing is listed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = staged(edges, parts), None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        held = F.broadcast if now[0] <= BROADCAST_LINKS else (lambda df: df)
        # Large star: neighbours above u go to the least of u's star.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(held(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: u and its neighbours below u go to the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(held(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), parts)
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


#: A class of at least this share of all documents is joined by broadcasting; there are no more of them than that.
HOT_CLASSES = 256


def labelled(described: DataFrame, key: list[str], known: DataFrame, linked: Column | None = None, parts: int | None = None) -> DataFrame:
    """described (doc_id and a class's columns `key`) with component_id, the smallest doc_id that links lead to.

    Rows of equal key are a class, known by its smallest doc_id, and known is components() of
    links between those. An id that has rows in several classes joins them, with all their components. Classes outside `linked` link nothing, so their rows are components
    of their own. Rows without doc_id get no component and join nothing.
    """
    linked = F.lit(True) if linked is None else linked
    named = described.filter(linked & F.col("doc_id").isNotNull())
    classes = staged(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), parts)
    one = F.xxhash64(*key)
    several = staged(named.groupBy("doc_id").agg(F.min(one).alias("least"), F.max(one).alias("most")).filter("least <> most").select("doc_id"), parts)
    if not several.isEmpty():
        own = named.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes, key)
        known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), parts)
    found = staged(classes.join(known, classes["rep"] == known["node"], "left").select(*key, "copies", F.coalesce("component", "rep").alias("_component")), parts)
    # Members of a hot class don't meet in one task.
    hot = F.broadcast(found.filter(F.col("copies") * HOT_CLASSES > described.count()).drop("copies"))
    out = described.join(hot, key).unionByName(described.join(hot, key, "left_anti").join(found.drop("copies"), key, "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(linked, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select(*described.columns, component.alias("component_id"))
