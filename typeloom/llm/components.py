"""Connected components by alternating large and small stars, written in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

#: A hub is a node with more than this share of all rows of a round (and HUB links): there are at most 1 / SHARE of them.
SHARE, HUB = 1 / 512, 1000


def with_least(rows: DataFrame, least: DataFrame, count: int, hub: int) -> DataFrame:
    """rows(u, v) with m of least(u, m, n). The rows of a hub meet m where they are, by a broadcast of at most 512 hubs;
    the others are joined, so that no task gets more than a hub's bound of one node."""
    most = max(hub, int(count * SHARE))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    rest = least.where(F.col("n") <= most).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def components(spark: SparkSession, links: DataFrame, hub: int = HUB) -> DataFrame:
    """node, root of every node of links(u bigint, v bigint) that has a link to another; root: the least node reached.

    A node's least neighbour is found by an aggregate with map-side combining and joined back; hubs are told apart, so
    that their links stay dealt over all tasks. Each round is written to the shared folder and the one before it deleted;
    rounds go on until one changes nothing, however many that takes. Links may repeat or be empty."""
    links = links.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
    links, last = written(spark, links, "links"), None
    state = lambda t: tuple(t.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").collect()[0])
    now = state(links)
    while now != last:
        count = 2 * now[0]
        both = links.unionByName(links.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).selectExpr("u", "least(u, m) m", "n")
        large = with_least(both.where("v > u"), least, count, hub).selectExpr("v u", "m v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, count, hub).selectExpr("case when v = m then u else v end u", "m v").where("u <> v").distinct()
        before, links = links, written(spark, small, "links")
        last, now = now, state(links)
        discard(spark, before)
    return links.selectExpr("u node", "v root").unionByName(links.selectExpr("v node", "v root").distinct())
