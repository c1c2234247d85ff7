"""URL filter: dated list entries become validity intervals, captures are judged by what was active when fetched.

The list is a log of (key, day, action, category) with actions "add" and "remove"; a key is a domain, which covers
its subdomains, or a host with the start of a path, of any number of steps; a capture gets as many as the longest key of the list has. The last action of a key on a day counts (remove before
add in the order of ties, the smallest category first), and an "add" is valid from its day until the next entry of the key. A capture
is matched by all its keys; the longest active key wins, then the first in order.

Captures and intervals meet on key and span of days, so a key with a long history is not paired whole with every capture
of its host, and a host with a third of the captures is split by Spark's skew join: its intervals are few.

Nulls: captures with a null URL or a null day match nothing and stay; entries with a null key, day or action are
ignored. Repeated captures stay separate rows; repeated entries count once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS = 64


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a last dot; empty if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys(url: Column, parts: int | Column | None = None) -> Column:
    """The host, its parent domains of two labels at least, and the host with every start of the path, or those of up to ``parts`` steps."""
    name = host(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."),
    )
    steps = path_parts(url) if parts is None else F.slice(path_parts(url), F.lit(1), F.lit(parts))
    prefixes = F.transform(steps, lambda _, i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    found = F.array_distinct(F.concat(F.array(name), parents, prefixes))
    return F.when(name != "", found).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``key, category, valid_from, valid_to``; the end is the day after the last valid one, null if open."""
    clean = entries.where("key is not null and day is not null and action is not null")
    order = F.struct((F.col("action") == "add").alias("add"), F.coalesce("category", F.lit("")).alias("category"))
    added = clean.where("action = 'add'").groupBy("key", "day").agg(F.min(F.coalesce("category", F.lit(""))).alias("category"))
    last = clean.groupBy("key", "day").agg(F.max(order)["add"].alias("add"))
    daily = last.join(added, ["key", "day"], "left")
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return daily.withColumn("valid_to", following).where("add").select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """``captures`` (id, url, day) with ``host, blocked, entry, category, valid_from`` of the entry that decides."""
    rows = captures.select("id", "url", "day")
    span = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / span_days)
    # No capture needs more steps of its path than the longest entry has.
    longest = entries.agg(F.greatest(F.max(F.size(F.split("key", "/")) - 1), F.lit(0))).scalar()
    own_keys = F.explode(keys(F.col("url"), F.col("longest"))).alias("key")
    # One question for each URL and day, however many captures share it.
    different = rows.where("url is not null and day is not null").select("url", "day").distinct()
    asked = different.withColumn("longest", longest).select("url", "day", own_keys).withColumn("span", span)
    last_day = captures.agg(F.max("day")).scalar()
    intervals = validity(entries).withColumn("last_day", last_day)
    horizon = F.floor(F.datediff("last_day", F.lit("1970-01-01").cast("date")) / span_days)
    first = F.floor(F.datediff("valid_from", F.lit("1970-01-01").cast("date")) / span_days)
    end = F.floor((F.datediff("valid_to", F.lit("1970-01-01").cast("date")) - 1) / span_days)
    until = F.least(F.coalesce(end, horizon), horizon)
    spans = F.when(until >= first, F.sequence(first, until))
    listed = intervals.select("key", "category", "valid_from", "valid_to", F.explode(spans).alias("span"))
    active = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = asked.join(listed, ["key", "span"]).where(active)
    best = F.min(F.struct((-F.length("key")).alias("short"), "key", "category", "valid_from")).alias("best")
    decided = hits.groupBy("url", "day").agg(best)
    joined = rows.join(decided, ["url", "day"], "left")
    return joined.select(
        "id", "day", host(F.coalesce("url", F.lit(""))).alias("host"), F.col("best").isNotNull().alias("blocked"),
        F.col("best.key").alias("entry"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("valid_from"),
    )
