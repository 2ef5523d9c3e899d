"""URL filters by a temporal join with dated lists (DataFrame functions only).

List events (entry, action ``add`` or ``remove``, date) become validity intervals
[valid_from, valid_to): an ``add`` opens an interval unless one is open, the next
``remove`` closes it, an interval that nothing closes is open-ended. On one day a
``remove`` comes before an ``add``. An entry is a domain (it covers the host itself
and all hosts below it) or ``host/segment`` (all URLs of the host whose path starts
with that segment).

Every capture (url, date of fetch) is evaluated against the intervals that
hold its date. Captures are first reduced to the distinct (host, segment)
pairs, whose few keys (the domains above the host, host/segment) meet the list
once; the pair's intervals go back to the captures as one array in an equi-join
with one row per pair on that side. So a host with a third of all captures adds
one row to the list join, and the way back is a join that Spark can split.

Hosts are lower-cased, without user, port, trailing dots and a leading
``www.``, and so is the host of an entry (one function for both); segments keep
their case. An entry's scheme is dropped, and a ``/`` that closes its segment; an entry
``host/`` covers the URLs of the host with an empty first segment. An entry with
more than one path segment is an error: it would never match. A capture without
a usable URL or without a date matches nothing. Events with a null entry, an entry
without a host, a null date or another action are ignored; repeated events change
nothing. Repeated captures each get a row. An empty table gives an empty
result, an empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penfit.llm.common import pick

FAR = "9999-12-31"


def host_name(authority: Column) -> Column:
    """Lower-cased host without user, port, trailing dots and a leading ``www.``;
    null if nothing is left."""
    host = F.lower(F.regexp_replace(authority, r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def host_of(url: Column) -> Column:
    """Normalised host of an absolute URL, null if there is none."""
    return host_name(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def segment_of(url: Column) -> Column:
    """First path segment, empty if the path has none."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)", 1)


def validity(events: DataFrame, entry: str = "entry", action: str = "action", at: str = "at") -> DataFrame:
    """(entry, valid_from, valid_to) from dated events."""
    e = pick(events, entry=entry, action=action, at=at).where(
        "entry is not null and at is not null and action in ('add', 'remove')")
    bare = F.regexp_replace(F.trim("entry"), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)(/.*)$", 1), r"(?s)^(/[^/]+)/$", "$1")
    deep = F.raise_error(F.concat(F.lit("list entry with more than one path segment: "), "entry")).cast("string")
    entry = F.concat(host_name(F.substring_index(bare, "/", 1)),
                     F.when(path.rlike(r"(?s)^/.*/"), deep).otherwise(path))
    e = e.select(entry.alias("entry"), F.col("at").cast("date").alias("at"),
                 (F.col("action") == "add").alias("adds")).where("entry is not null").distinct()
    by = Window.partitionBy("entry").orderBy("at", "adds")
    changes = (e.withColumn("was", F.coalesce(F.lag("adds").over(by), F.lit(False)))
               .where(F.col("adds") != F.col("was")))
    end = F.coalesce(F.lead("at").over(Window.partitionBy("entry").orderBy("at", "adds")),
                     F.lit(FAR).cast("date"))
    return (changes.withColumn("valid_to", end).where("adds and at < valid_to")
            .select("entry", F.col("at").alias("valid_from"), "valid_to"))


def keys_of(host: Column, segment: Column) -> Column:
    """The domains above a host, itself included, and host/segment."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_union(domains, F.array(F.concat(host, F.lit("/"), segment)))


def filter_urls(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url",
                at_col: str = "fetched") -> DataFrame:
    """page_id, host, fetched, blocked, active (entries that hold), entry (the
    first of them by code point, null if none), one row per capture."""
    c = pick(captures, page_id=id_col, url=url_col, fetched=at_col)
    c = c.select("page_id", F.col("fetched").cast("date").alias("fetched"), host_of(F.col("url")).alias("host"),
                 F.coalesce(segment_of(F.col("url")), F.lit("")).alias("segment"))
    pairs = c.where("host is not null").select("host", "segment").distinct()
    asked = pairs.select("host", "segment", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("entry"))
    spans = validity(events)
    held = asked.join(spans, "entry").groupBy("host", "segment").agg(
        F.collect_list(F.struct("valid_from", "valid_to", "entry")).alias("spans"))
    rows = c.join(held, ["host", "segment"], "left")
    now = F.filter(F.coalesce("spans", F.array()), lambda s: (s["valid_from"] <= F.col("fetched"))
                   & (F.col("fetched") < s["valid_to"]))
    hits = F.array_distinct(F.transform(now, lambda s: s["entry"]))
    return rows.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>"))).select(
        "page_id", "host", "fetched", (F.size("hits") > 0).alias("blocked"),
        F.size("hits").cast("bigint").alias("active"), F.array_min("hits").alias("entry"))


# -- the registered query's list ----------------------------------------------

START = "2023-01-01"


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date that follows from page_id (the table has none)."""
    p = pick(pages, page_id="page_id", url="url")
    day = F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")
    return p.withColumn("fetched", F.date_add(F.lit(START).cast("date"), day))


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: every third parent domain is
    added, removed after 60 to 159 days, every second of these added again on
    day 250 after the first; every tenth host/segment is added for good."""
    p = pick(pages, url="url").select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"))
    p = p.where("host is not null").distinct()
    domains = p.select(F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.)", "").alias("entry")).distinct()
    d = domains.withColumn("k", _number(F.col("entry"))).where("k % 3 = 0")
    first = (F.col("k") % 400).cast("int")
    gone = first + 60 + (F.floor(F.col("k") / 7) % 100).cast("int")
    steps = F.array(F.struct(F.lit("add").alias("action"), first.alias("day")),
                    F.struct(F.lit("remove").alias("action"), gone.alias("day")),
                    F.struct(F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"),
                             (first + 250).alias("day")))
    d = d.select("entry", F.explode(steps).alias("s")).select("entry", "s.action", "s.day")
    s = p.select(F.concat("host", F.lit("/"), "segment").alias("entry")).withColumn("k", _number(F.col("entry")))
    s = s.where("k % 10 = 0").select("entry", F.lit("add").alias("action"), (F.col("k") % 500).cast("int").alias("day"))
    return d.unionByName(s).select(
        "entry", "action", F.date_add(F.lit(START).cast("date"), F.col("day")).alias("at"))
