"""URL filters: a temporal join of captures with dated lists, in DataFrame functions only.

A list is a set of dated entries (pattern, action, day): `add` puts a host or domain on the list from that day on, `remove` takes
it off. Entries become validity intervals by the day of the pattern's next entry. A capture is checked against its host
and each parent domain; an interval that holds at its fetch day makes it blocked.

Captures meet intervals by (pattern, period), periods of PERIOD days, so a pattern with a long history costs a capture
only the entries of its own period. Captures are first reduced to distinct (host, day) with their number, so a host
that holds a third of all captures is a few rows; joining the decision back is an equi-join that Spark may split.

Defined cases: a null or malformed URL has no host and is never blocked; hosts are lower-cased, without user, port and a trailing dot; a null
fetch day is never blocked; entries with a null pattern or day are left out; of entries of one pattern and day
`remove` wins; repeated captures are judged each; empty tables give empty or unblocked results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.common import free_name

PERIOD = 64
FOREVER = 1_000_000


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    host = F.lower(host)
    return F.when(host == "", None).otherwise(host)


def parents(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): the days from since to until - 1 on which a pattern is listed."""
    daily = entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull()).groupBy(F.lower("pattern").alias("pattern"), "day").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    following = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.withColumn("until", F.coalesce(following, F.lit(FOREVER))).where("on = 1").select("pattern", F.col("day").alias("since"), "until")


def active_patterns(captures: DataFrame, entries: DataFrame, last_day: int | None = None) -> DataFrame:
    """(host, day, blocked_by, listed_since) of the distinct hosts and days of captures (host, day) that some entry blocks;
    of several patterns the longest counts."""
    keys = captures.select("host", "day").where("host is not null and day is not null").distinct()
    if last_day is None:
        last_day = keys.agg(F.max("day")).first()[0] or 0
    # An open interval ends with the last fetch day: that is one number, and bounds the number of periods.
    spans = intervals(entries).withColumn("top", F.lit(last_day))
    spans = spans.where("since <= top").select("pattern", "since", "until", F.explode(F.sequence(F.floor(F.col("since") / PERIOD), F.floor((F.least(F.col("until") - 1, F.col("top"))) / PERIOD))).alias("period"))
    checked = keys.select("host", "day", F.floor(F.col("day") / PERIOD).alias("period"), F.explode(parents(F.col("host"))).alias("pattern"))
    hits = checked.join(spans, ["pattern", "period"]).where("since <= day and day < until")
    best = hits.groupBy("host", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"))
    return best.select("host", "day", F.col("best.pattern").alias("blocked_by"), F.col("best.since").alias("listed_since"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of captures (page_id, url, day, ...), with host, blocked, blocked_by and listed_since at fetch time. A given
    column of such a name keeps its values under the name with an underscore behind it."""
    own = ("host", "blocked", "blocked_by", "listed_since")
    for c in [c for c in captures.columns if c.lower() in own]:
        captures = captures.withColumnRenamed(c, free_name([*captures.columns, *own], c))
    captures = captures.withColumn("host", host_of(F.col("url")))
    h, d = (free_name(captures.columns, c) for c in ("__h", "__d"))
    found = active_patterns(captures, entries, last_day=None)
    found = found.select(F.col("host").alias(h), F.col("day").alias(d), "blocked_by", "listed_since")
    out = captures.join(found, (F.col("host") == F.col(h)) & (F.col("day") == F.col(d)), "left").drop(h, d)
    return out.withColumn("blocked", F.col("blocked_by").isNotNull())
