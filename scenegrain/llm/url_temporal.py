"""URL filters by a temporal list join, in DataFrame functions alone.

A dated list says from which day a domain is added or removed. Entries become validity intervals; an as-of join holds
every capture of a page against the entries that were active on the day of its fetch, for its host and all domains
above it. Intervals and captures meet by domain and period, so a host with a large share of the captures is dealt over
the periods, and the join's own skew handling splits what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = 1 << 30


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and path; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(h != "", h)


def domains_of(host: Column) -> Column:
    """The host and every domain above it that has two labels or more, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(host.isNotNull(), up)


def validity(entries: DataFrame) -> DataFrame:
    """(domain, day_from, day_to): when each domain is listed; from (domain, day, action, entry_id).

    Of several entries of a domain and day the one with the largest entry_id holds. Entries with a null domain, day or
    action count as absent; a removal without an addition before it does nothing. Windows run over the days of a
    domain, at most one row a day.
    """
    e = entries.where("domain IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL")
    day = e.groupBy("domain", "day").agg(F.max(F.struct("entry_id", "action")).alias("last")).select("domain", "day", F.col("last.action").alias("action"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("domain").orderBy("day")), F.lit(FOREVER))
    return day.withColumn("day_to", until).where("action = 'add'").select("domain", F.col("day").alias("day_from"), "day_to")


def temporal_filter(captures: DataFrame, entries: DataFrame, period: int = 30, last_day: int | None = None, salts: int = 16) -> DataFrame:
    """page_id, host, fetch_day, n_active, matched, active_from, blocked: a row for each row of `captures`.

    n_active is the number of domains (the host or above) listed that day, `matched` the longest of them, active_from
    its day, or -1. Captures without a host or day match nothing and aren't blocked; of a URL, however long, only the host
    is looked at. Repeated captures and null ids stay. An empty list blocks nothing, no captures give no rows; other
    columns are not read. Each different host and day is judged once; captures find their judgement by both, dealt over
    `salts` groups, so that a host with a large share of the captures is no single key.
    """
    c = captures.select("page_id", "fetch_day", host_of(F.col("url")).alias("host"))
    asked = c.where("host IS NOT NULL AND fetch_day IS NOT NULL").select("host", "fetch_day").distinct()
    last = F.lit(last_day) if last_day is not None else F.lit(None)
    spans = validity(entries)
    # An open interval covers the periods up to the last fetch only: the largest day is one number.
    top = captures.agg(F.max("fetch_day").alias("top")) if last_day is None else captures.sparkSession.range(1).select(last.alias("top"))
    spans = spans.crossJoin(F.broadcast(top)).where("day_from <= top")
    spans = spans.withColumn("period", F.explode(F.sequence(F.floor(F.col("day_from") / period), F.floor(F.least(F.col("day_to") - 1, F.col("top")) / period)))).drop("top")
    domains = asked.withColumn("domain", F.explode(domains_of(F.col("host")))).withColumn("period", F.floor(F.col("fetch_day") / period))
    hits = domains.join(spans, ["domain", "period"]).where("day_from <= fetch_day AND fetch_day < day_to")
    # Intervals of a domain don't overlap: one hit a domain.
    hit = F.struct(F.length("domain").alias("n"), "domain", "day_from")
    judged = hits.groupBy("host", "fetch_day").agg(F.max(hit).alias("best"), F.count("*").alias("n_active"))
    judged = judged.select(F.col("host").alias("of_host"), F.col("fetch_day").alias("of_day"), "best", "n_active").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = c.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    same = (F.col("host") == F.col("of_host")) & (F.col("fetch_day") == F.col("of_day")) & (F.col("salt") == F.col("of_salt"))
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return salted.join(judged, same, "left").select(
        "page_id",
        "host",
        "fetch_day",
        n.alias("n_active"),
        F.col("best.domain").alias("matched"),
        F.coalesce(F.col("best.day_from").cast("long"), F.lit(-1)).alias("active_from"),
        (n > 0).alias("blocked"),
    )
