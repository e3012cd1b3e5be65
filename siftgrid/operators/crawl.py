"""Pages that stored links lead to, breadth first with a budget for each domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.functions import hosts, suffixes, urls
from siftgrid.functions.text import bound
from siftgrid.sources.scratch import Scratch

#: Levels of at most so many rows are sent whole.
SENT_ROWS = 200_000


def domain_of(url: Column) -> Column:
    """The registrable domain of an http(s) address; null for another."""
    return suffixes.registrable(urls.host(url))


def in_scope(link: Column, domain: Column, guarded: bool = True) -> Column:
    """Whether a link stays in a registrable domain and leads to no internal host; an explicit http(s) address with a host."""

    def of(host: Column) -> Column:
        # Suffix rules are asked only for hosts that may be in the domain.
        maybe = (host == domain) | host.endswith(F.concat(F.lit("."), domain))
        own = F.when(maybe, F.coalesce(suffixes.registrable(host) == domain, F.lit(False))).otherwise(False)
        return own & ~hosts.internal(host) if guarded else own

    return bound(urls.host(link), of)


def frontier(links: DataFrame, roots: DataFrame, most: int = 100, depth: int | None = None, guarded: bool = True) -> DataFrame:
    """url, domain, depth, pos of pages found from the roots (url, ord) over links (a, ord, link), in order of discovery in their domain, from 0.

    A page's links count in their order (ord), pages in the order in which they were found. A domain takes `most`
    pages, roots included; pages `depth` links from a root are listed, not followed. Links out of the registrable
    domain, to internal hosts (if guarded), without http(s) or a host, and to pages seen before take no place.
    Addresses are compared without query, fragment and final slashes. Null addresses lead nowhere.

    Links are filtered and written once; a level is one join of them with the level before, and ends when it has no
    page. Only the first `most` new pages of a domain are ranked, on the map side first, so a domain with most of
    the links meets in no task. A level too large to be sent whole is joined by a shuffle.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    a, b = urls.crawl_key(F.col("a")), urls.crawl_key(F.col("link"))
    known = links.where(in_scope(F.col("link"), domain_of(F.col("a")), guarded)).select(a.alias("a"), b.alias("url"), "ord")
    edges = scratch.keep(known.groupBy("a", "url").agg(F.min("ord").alias("ord")), "edges")

    first = roots.select(urls.crawl_key(F.col("url")).alias("url"), "ord").where(F.col("url").isNotNull())
    first = first.where(~hosts.internal(urls.host(F.col("url")))) if guarded else first
    start = first.groupBy("url").agg(F.min("ord").alias("ord")).select("url", domain_of(F.col("url")).alias("domain"), F.struct(F.lit(0).alias("up"), "ord").alias("order")).where("domain is not null")
    level = scratch.keep(ranked(start, None, most).withColumn("depth", F.lit(0)), "levels/level=0")
    k, n = 0, level.count()
    taken = level.groupBy("domain").agg(F.count("*").alias("taken"))
    while n and (depth is None or k < depth):
        at = level.select(F.col("url").alias("a"), "domain", F.col("pos").alias("up"))
        seen = spark.read.parquet(f"{scratch.root}/levels").select("url", "domain")
        found = edges.join(F.broadcast(at) if n <= SENT_ROWS else at, "a").groupBy("domain", "url").agg(F.min(F.struct("up", "ord")).alias("order"))
        k += 1
        level = scratch.keep(ranked(found.join(seen, ["domain", "url"], "left_anti"), taken, most).withColumn("depth", F.lit(k)), f"levels/level={k}")
        n = level.count()
        taken = spark.read.parquet(f"{scratch.root}/levels").groupBy("domain").agg(F.count("*").alias("taken"))
    scratch.drop("edges")
    return spark.read.parquet(f"{scratch.root}/levels").select("url", "domain", "depth", "pos")


def ranked(found: DataFrame, taken: DataFrame | None, most: int) -> DataFrame:
    """url, domain, pos: the first of found (url, domain, order) in each domain that its budget has room for."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy("order", "url"))
    first = found.withColumn("k", place).where(F.col("k") <= most)
    if taken is None:
        return first.select("url", "domain", (F.col("k") - 1).cast("long").alias("pos"))
    joined = first.join(taken, "domain").where(F.col("taken") + F.col("k") <= most)
    return joined.select("url", "domain", (F.col("taken") + F.col("k") - 1).cast("long").alias("pos"))
