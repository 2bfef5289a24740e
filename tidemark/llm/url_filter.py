"""URL filters: captures against dated lists, as the lists stood at fetch time.

A list is a ledger of dated entries: a key (a host or a parent domain) was
added to or removed from a named list. Between an addition and the key's next
entry lies a validity interval, half open. A capture is judged by the
intervals of its host and parent domains that hold its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tidemark.llm.common import hot_join, hot_keys, lower_ascii, table

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; null if none."""
    authority = F.regexp_extract(url, r"^[ \t]*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = lower_ascii(F.regexp_replace(authority, r"^.*@|:[0-9]*$|\.(:[0-9]*)?$", ""))
    return F.nullif(host, F.lit(""))


def parents_of(host: Column) -> Column:
    """host and each of its parent domains, the top-level domain included."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list_name, kind, key, valid_from, valid_to) of a ledger.

    entries: list_name, kind ("block" or "allow"), key, listed_on (date),
    action ("add" or "remove"). Of entries for a key on the same date, removal
    counts last. Rows without key, list or date are void.
    """
    ledger = entries.filter("key IS NOT NULL AND list_name IS NOT NULL AND listed_on IS NOT NULL").distinct()
    days = ledger.groupBy("list_name", "kind", "key", "listed_on").agg(F.min(F.col("action") == "add").alias("added"))
    span = W.partitionBy("list_name", "kind", "key").orderBy("listed_on")
    until = F.coalesce(F.lead("listed_on").over(span), F.lit(FOREVER).cast("date"))
    return days.withColumn("valid_to", until).filter("added").select("list_name", "kind", "key", F.col("listed_on").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_on and any more) with the verdict at fetch time.

    Adds host, n_active (intervals that hold), active_lists (distinct names,
    sorted, comma-joined), matched_key (the longest active key) and blocked:
    whether an active block entry has a longer key than any active allow entry.
    Columns of captures with these names give way; others stay, whatever theirs. A null or relative URL has
    no host and, like a null fetch date, is never blocked; repeated rows are
    judged alike; without entries nothing is blocked.

    Verdicts are computed once for each (host, day), which partial aggregation
    makes few even where one host has a third of all captures. Domains that
    many hosts share are dropped before the shuffle if no list holds them, and
    else dealt to groups by their number, and so are the captures of a host on
    a day. Only such keys are broadcast, a thousand at most.
    """
    captures = captures.drop("host", "n_active", "active_lists", "matched_key", "blocked").withColumn("host", host_of(F.col("url")))
    asked = captures.filter("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    asked = asked.withColumn("key", F.explode(parents_of(F.col("host"))))
    lists = validity(entries)
    counts = asked.groupBy("key").agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    unlisted = hot_keys(counts, ["key"], n)[0].join(lists, "key", "left_anti").select("key")
    asked = asked.join(F.broadcast(unlisted), "key", "left_anti")
    within = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("fetched_on") < F.col("valid_to"))
    hits = hot_join(asked, lists, "key", by=("host", "fetched_on"), counts=counts, n=n).filter(within)
    size = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("key"))), F.lit(0))
    verdicts = hits.groupBy("host", "fetched_on").agg(
        F.count("*").alias("n_active"),
        F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("active_lists"),
        F.max_by("key", F.length("key")).alias("matched_key"),
        (size("block") > size("allow")).alias("blocked"),
    )
    # one verdict serves all captures of a host on a day
    by = [c for c in captures.columns if not isinstance(captures.schema[c].dataType, (MapType, VariantType))]
    out = hot_join(captures, verdicts, ("host", "fetched_on"), by=by, how="left")
    return out.withColumns({"n_active": F.coalesce("n_active", F.lit(0)).cast("bigint"), "active_lists": F.coalesce("active_lists", F.lit("")), "blocked": F.coalesce("blocked", F.lit(False))})


def digit(value: Column, place: int) -> Column:
    """A hexadecimal digit of the value's MD5 hash, as a number."""
    return F.conv(F.substring(F.md5(value), place, 1), 16, 10).cast("int")


def sample_ledger(pages: DataFrame) -> DataFrame:
    """A ledger for the test pages, which come without one.

    Each host is hashed: about half get entries on the lists adult, malware or
    spam, most of which are removed later and some added again; every
    spam-farm host is on spam from the start. Parent domains are blocked and
    some hosts allowed for a time.
    """
    host = F.col("host")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    begin = F.date_add(F.lit("2024-01-01").cast("date"), digit(host, 2) * 16 + digit(host, 3))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), digit(host, 4) % 3 + 1)
    entry = lambda n, kind, key, on, action: F.struct(n.alias("list_name"), F.lit(kind).alias("kind"), key.alias("key"), on.alias("listed_on"), F.lit(action).alias("action"))
    parent = F.substring_index(host, ".", -2)
    events = F.array(
        F.when(digit(host, 1) < 8, entry(name, "block", host, begin, "add")),
        F.when(digit(host, 1) < 6, entry(name, "block", host, F.date_add(begin, 20 + digit(host, 5) * 4), "remove")),
        F.when(digit(host, 1) < 2, entry(name, "block", host, F.date_add(begin, 120), "add")),
        F.when(digit(host, 6) < 3, entry(F.lit("trusted"), "allow", host, F.date_add(begin, 10), "add")),
        F.when(F.startswith(host, F.lit("spam-farm.")), entry(F.lit("spam"), "block", host, F.lit("2024-01-01").cast("date"), "add")),
        F.when(digit(parent, 1) < 6, entry(F.lit("parents"), "block", parent, F.date_add(F.lit("2024-01-01").cast("date"), digit(parent, 2) * 8), "add")),
        F.when(digit(parent, 1) < 6, entry(F.lit("parents"), "block", parent, F.date_add(F.lit("2024-03-01").cast("date"), digit(parent, 2) * 8), "remove")),
    )
    return hosts.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_on"))
    return judge(captures, sample_ledger(pages)).select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "n_active", "active_lists", "matched_key", "blocked")
