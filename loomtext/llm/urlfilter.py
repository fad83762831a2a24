"""Operator 8, URL filter by a temporal list join.

Dated list events become validity intervals; a capture meets the intervals that
hold at its fetch time for its host, the host's parent domains, or one of these
with the first path segment.  The longest key decides, denial before
permission.  An address in numbers has no parents.

The as-of condition is turned into an equi-join: intervals are spread over time
buckets, so a capture probes one (key, bucket) only, and a key with a long
history is spread over its buckets.  Captures of one host, first segment and
day are one question, so a large host asks as often as it has segments and days.
Questions of many captures are few, so their answers are broadcast.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import Staging

#: Days of a time bucket.
BUCKET = 32

#: A column that captures carry on the way.
SPOT = "loomtext_spot"
#: Questions that may count as large: these are broadcast, all others have fewer captures than the total over this.
LARGE = 100_000

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
_NUMBERS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """Lower-case host, an IPv6 address in its brackets; empty if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def segment(url: Column) -> Column:
    """The first path segment; empty if there is none."""
    return F.regexp_extract(url, _SEGMENT, 1)


def keys(host: Column, segment: Column) -> Column:
    """The host, its parents of two labels or more, and each of them with the first path segment; an address has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    domains = F.when(F.rlike(host, F.lit(_NUMBERS)), F.array(host)).otherwise(parents)
    both = F.when(segment == "", domains).otherwise(F.concat(domains, F.transform(domains, lambda d: F.concat(d, F.lit("/"), segment))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(both)


def intervals(events: DataFrame) -> DataFrame:
    """(list, verdict, key, since, until) from events (list, verdict, key, day, action ``add`` or ``remove``).

    Of events of one list and key on one day, an addition wins.  ``until`` is
    exclusive and null while the entry is active.  Null keys or days are ignored.
    """
    days = events.filter("key is not null and day is not null").groupBy("list", "verdict", "key", "day").agg(F.max(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("list", "verdict", "key").orderBy("day")
    return days.withColumn("until", F.lead("day").over(order)).filter("on").select("list", "verdict", "key", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (url, fetched and more) with verdict, matched_key, matched_list and n_active.

    Verdict ``allow`` without an active entry; ``invalid`` without a host.  Of
    equally long keys denial wins, then the list's name.  A null fetch day meets
    no entry.  n_active counts active (list, key) entries.  Columns of the
    captures that have these names are replaced, others kept, whatever they are
    called; equal captures get a row each.
    """
    captures = captures.drop("verdict", "matched_key", "matched_list", "n_active")
    staging = Staging(captures.sparkSession)
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / BUCKET)
    asks = [host(captures["url"]).alias("h"), segment(captures["url"]).alias("s"), captures["fetched"].alias("at")]
    asked = staging.put(captures.select(*asks).filter("h <> '' and at is not null").groupBy("h", "s", "at").agg(F.count("*").alias("c")))
    last = asked.agg(F.max("at").alias("last"))
    held = intervals(events).crossJoin(F.broadcast(last)).filter("since <= last")  # one row on the right
    until = F.least(F.coalesce("until", F.date_add("last", 1)), F.date_add("last", 1))
    spread = held.withColumn("until", until).withColumn("bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.date_sub("until", 1))))).drop("last")
    probes = asked.select("h", "s", "at", F.explode(keys(F.col("h"), F.col("s"))).alias("key")).withColumn("bucket", bucket(F.col("at")))
    met = probes.join(spread, ["key", "bucket"]).filter("since <= at and at < until")
    rank = F.struct(F.length("key").alias("n"), (F.col("verdict") == "deny").alias("deny"), F.col("list"), "key", "verdict")
    best = met.groupBy("h", "s", "at").agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    answers = staging.put(asked.join(best, ["h", "s", "at"], "left"))
    staging.drop_others(answers)

    total = answers.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    many = F.col("c") >= max(1000, total // LARGE)
    large, small = (answers.filter(pick).select(*(F.col(c).alias(f"{c}{k}") for c in ("h", "s", "at", "best", "n", "c"))) for k, pick in ((1, many), (2, ~many)))
    captures = captures.withColumn(SPOT, F.spark_partition_id())
    own, rest = (host(captures["url"]), segment(captures["url"])), (F.coalesce(host(captures["url"]), F.lit("")) != "") & captures["fetched"].isNotNull()
    told = captures.join(F.broadcast(large), (own[0] == large["h1"]) & (own[1] == large["s1"]) & (captures["fetched"] == large["at1"]), "left")
    # what needs no second answer stays spread by where it came from, under a key that no host has
    key = F.when(rest & large["c1"].isNull(), own[0]).otherwise(F.concat(F.lit("/"), captures[SPOT]))
    joined = told.join(small, (key == small["h2"]) & (own[1] == small["s2"]) & (captures["fetched"] == small["at2"]), "left")
    found = F.coalesce(large["best1"], small["best2"])
    verdict = F.when(F.coalesce(own[0], F.lit("")) == "", "invalid").otherwise(F.coalesce(found["verdict"], F.lit("allow")))
    n = F.coalesce(large["n1"], small["n2"], F.lit(0)).cast("long")
    return joined.select(*(captures[c] for c in captures.columns if c != SPOT), verdict.alias("verdict"), found["key"].alias("matched_key"), found["list"].alias("matched_list"), n.alias("n_active"))
