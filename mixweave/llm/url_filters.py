"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated events: an entry (a domain with its subdomains, or a host with a path prefix) is added or
removed at a time. The log becomes validity intervals, one row each. Each distinct capture (url and fetch time) is looked
up under every suffix of its host and every path prefix that the lists are deep enough for. Captures that meet an entry
then go through an as-of join: they lie in one order with the entry's intervals, by time, and each takes the last
interval that began before it. So a capture meets one interval however long the history of its entry is, and captures of one busy
url are looked up once.

Entries (without their histories) are measured first and broadcast only within BROADCAST_BYTES; beyond it, they are joined by a
shuffle, whose large partitions adaptive execution splits. An entry that more than SALT_ROWS captures meet is dealt
into as many parts of that size, each with the entry's intervals. An interval holds from its first moment up to, not with, its
last.

Defined cases. A null or unreadable url, or a null fetch time, matches nothing and is not blocked. Events of an entry at
the same time: an addition wins. Adding what is listed, or removing what isn't, changes nothing. Events with a null
key, time or action are ignored; a null list name is a list like any other, but isn't named. Empty tables: no matches, or no rows. Repeated
captures each get a row. Extra columns of captures are kept; columns that the result names itself are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.llm.shared import let, materialize

BROADCAST_BYTES = 32 << 20
SALT_ROWS = 200_000

EVENT_SCHEMA = "list_name string, kind string, key string, action string, at timestamp"


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and a dot at its end; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def validity(events: DataFrame) -> DataFrame:
    """Intervals (list_name, kind, key, valid_from, valid_to) from a log; valid_to is null while the entry stands."""
    log = events.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    log = log.groupBy("list_name", "kind", F.lower("key").alias("key"), "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    entry = Window.partitionBy("list_name", "kind", "key").orderBy("at")
    log = log.withColumn("was", F.coalesce(F.lag("on").over(entry), F.lit(0))).where(F.col("on") != F.col("was"))
    log = log.withColumn("valid_to", F.lead("at").over(entry)).where(F.col("on") == 1)
    return log.select("list_name", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


def lookup_keys(url: Column, labels: int, depth: int) -> Column:
    """(kind, key) for host suffixes of at most labels labels, and for the host with up to depth path segments."""

    def suffixes(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, -n, n), ".").alias("key")))

    def prefixes(segments: Column) -> Column:
        path = lambda n: F.concat(host_of(url), F.lit("/"), F.lower(F.array_join(F.slice(segments, 1, n), "/")))
        return F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(depth))), lambda n: F.struct(F.lit("prefix").alias("kind"), path(n).alias("key")))

    none = F.array().cast("array<struct<kind:string,key:string>>")
    domains = let(F.split(host_of(url), r"\."), suffixes) if labels else none
    paths = let(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), lambda s: F.when(F.size(s) > 0, prefixes(s)).otherwise(none)) if depth else none
    return F.when(host_of(url) != "", F.concat(domains, paths)).otherwise(none)


def as_of(met: DataFrame, held: DataFrame) -> DataFrame:
    """The rows (url, fetch_time, kind, key, list_name) whose entry holds at fetch_time; held has the entries' intervals."""
    entry = ["kind", "key", "list_name"]
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in entry])
    busy = materialize(met.groupBy(*entry).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts")), "url-busy")
    parts = busy.where("parts > 1")  # at most one in SALT_ROWS captures
    begun = held.alias("h").join(busy.alias("b"), same("h", "b")).select("h.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    begun = begun.select(*entry, "part", F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.struct("valid_to").alias("interval"), F.lit(None).cast("string").alias("url"))
    asked = met.alias("m").join(parts.alias("b"), same("m", "b"), "left").select("m.*", F.pmod(F.xxhash64("m.url", "m.fetch_time"), F.coalesce("b.parts", F.lit(1))).cast("int").alias("part"))
    asked = asked.select(*entry, "part", F.col("fetch_time").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<valid_to:timestamp>").alias("interval"), "url")
    order = Window.partitionBy(*entry, "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = begun.unionByName(asked).withColumn("last", F.last("interval", ignorenulls=True).over(order)).where("side = 1")
    holds = F.col("last").isNotNull() & (F.col("last.valid_to").isNull() | (F.col("at") < F.col("last.valid_to")))
    return last.where(holds).select("url", F.col("at").alias("fetch_time"), *entry)


def matches(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """(url, fetch_time, kind, key, list_name) for each distinct capture and list entry that is active at its fetch time."""
    held = materialize(validity(events), "url-intervals")
    listed = materialize(held.select("kind", "key", "list_name").distinct(), "url-entries")
    heavy = F.sum(F.octet_length("key") + F.octet_length(F.coalesce("list_name", F.lit(""))) + 64)
    size = listed.agg(heavy, F.max(F.when(F.col("kind") == "domain", F.size(F.split("key", r"\.")))), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1))).first()
    seen = captures.select(F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetch_time")).where(F.col("url").isNotNull() & F.col("fetch_time").isNotNull()).distinct()
    keyed = seen.select("url", "fetch_time", F.explode(lookup_keys(F.col("url"), size[1] or 0, size[2] or 0)).alias("k")).select("url", "fetch_time", "k.kind", "k.key")
    met = keyed.join(F.broadcast(listed) if (size[0] or 0) <= BROADCAST_BYTES else listed, ["kind", "key"])
    return as_of(materialize(met, "url-met"), held)


def evaluate(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """Every capture with blocked, n_entries (active entries it matches) and lists (their names, in order, comma-separated)."""
    verdicts = matches(captures, events, url_col, time_col).groupBy("url", "fetch_time").agg(F.count("*").alias("n_entries"), F.concat_ws(",", F.sort_array(F.collect_set("list_name"))).alias("lists"))
    kept = captures.drop("blocked", "n_entries", "lists")
    joined = kept.alias("c").join(verdicts.alias("v"), (F.col(f"c.{url_col}") == F.col("v.url")) & (F.col(f"c.{time_col}").cast("timestamp") == F.col("v.fetch_time")), "left")
    return joined.select("c.*", F.col("v.n_entries").isNotNull().alias("blocked"), F.coalesce("v.n_entries", F.lit(0)).alias("n_entries"), F.coalesce("v.lists", F.lit("")).alias("lists"))
