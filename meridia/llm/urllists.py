"""URL filtering against dated lists.

List entries are events: on a date, a host, a domain (with all hosts under it) or the first path
folder of a host is added to or removed from the list. Events become validity intervals: each
holds from its date until the next event of the same entry, the day before included. Every
capture is then matched as of its fetch date. Captures and intervals meet on the entry and the
calendar quarter, so an entry that a third of all captures match is spread over the quarters, and
what is left of a hot key is split by the join itself at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "kind string, value string, listed_on date, action string"
#: Fixed value of the domain name system: the longest name. A longer host is none, so a capture has 128 keys at most.
LONGEST_HOST = 253


def host_of(url):
    """Lower-case host of a URL with a scheme, an address in brackets with them; null where there is none, or
    where it is longer than a domain name can be."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.when((F.length(host) > 0) & (F.length(host) <= LONGEST_HOST + 1), F.regexp_replace(host, r"\.$", ""))


def folder_of(url):
    """First path folder of a URL, without slashes; null where there is none."""
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)
    return F.when(F.length(folder) > 0, folder)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, valid_from, valid_to) of dated entries: valid_to is exclusive and null while open.

    Of several events of an entry on a day a removal wins; removals of what isn't listed and rows
    with a null in any of the four columns count for nothing. Adjacent intervals aren't joined.
    """
    known = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["kind", "value", "listed_on"])
    daily = known.groupBy("kind", "value", "listed_on").agg(F.max("action").alias("action"))
    following = F.lead("listed_on").over(Window.partitionBy("kind", "value").orderBy("listed_on"))
    return daily.withColumn("valid_to", following).where("action = 'add'").select("kind", "value", F.col("listed_on").alias("valid_from"), "valid_to")


def _quarter(day):
    return F.year(day) * 4 + F.quarter(day)


def capture_keys(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and one row for each entry that could list the capture (kind, value); captures
    without a host keep one row of nulls."""
    with_host = captures.withColumn("__host", host_of(F.col(url_col))).withColumn("__folder", folder_of(F.col(url_col)))
    # dots inside an address in brackets don't part domains
    parts = F.when(F.col("__host").startswith("["), F.array("__host")).otherwise(F.split("__host", r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("__host").alias("value")))
    folder = F.when(F.col("__folder").isNotNull(), F.array(F.struct(F.lit("folder").alias("kind"), F.concat("__host", F.lit("/"), "__folder").alias("value"))))
    keys = F.when(F.col("__host").isNotNull(), F.concat(own, domains, F.coalesce(folder, F.slice(own, 1, 0))))
    return with_host.withColumn("__key", F.explode_outer(keys)).withColumn("kind", F.col("__key.kind")).withColumn("value", F.col("__key.value")).drop("__key", "__folder").withColumnRenamed("__host", "host")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id, host, fetched_on, n_active, blocked, reason) of every capture: the number of its entries
    active on its day, whether there is any, and the most specific as kind:value (folder, host,
    then the longest domain).

    A null URL, host or day matches nothing and isn't blocked. Captures that are repeated as a whole
    give one row. Other columns are not kept.
    """
    rows = captures.select(F.col(id_col), F.col(url_col), F.to_date(day_col).alias("fetched_on"))
    last = rows.agg(F.max("fetched_on").alias("last"))
    spans = validity_intervals(entries).crossJoin(F.broadcast(last))
    # the one-row bound caps open intervals at the last capture
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last"))
    spans = spans.where((F.col("valid_from") <= F.col("last")) & (F.col("valid_from") <= until))
    spans = spans.withColumn("quarter", F.explode(F.sequence(_quarter(F.col("valid_from")), _quarter(until)))).select("kind", "value", "quarter", "valid_from", "valid_to")
    keyed = capture_keys(rows, url_col).withColumn("quarter", _quarter(F.col("fetched_on"))).alias("c")
    spans = spans.alias("s")
    active = (F.col("c.kind") == F.col("s.kind")) & (F.col("c.value") == F.col("s.value")) & (F.col("c.quarter") == F.col("s.quarter")) & (F.col("s.valid_from") <= F.col("c.fetched_on")) & (F.col("s.valid_to").isNull() | (F.col("c.fetched_on") < F.col("s.valid_to")))
    met = keyed.join(spans, active, "left")
    order = F.when(F.col("s.kind") == "folder", 3).when(F.col("s.kind") == "host", 2).otherwise(1)
    best = F.max(F.when(F.col("s.kind").isNotNull(), F.struct(order.alias("o"), F.length("s.value").alias("n"), F.concat_ws(":", "s.kind", "s.value").alias("reason"))))
    grouped = met.groupBy(F.col(f"c.{id_col}").alias(id_col), F.col(f"c.{url_col}").alias("__url"), F.col("c.host").alias("host"), F.col("c.fetched_on").alias("fetched_on"))
    out = grouped.agg(F.countDistinct("s.kind", "s.value").alias("n_active"), best.alias("best"))
    return out.select(id_col, "host", "fetched_on", "n_active", (F.col("n_active") > 0).alias("blocked"), F.col("best.reason").alias("reason"))
