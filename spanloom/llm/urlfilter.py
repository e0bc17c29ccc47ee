"""URL filters by a temporal list join.

Dated list entries (entry, action, day; action 'add' or 'remove') become validity intervals
[since, until). An entry is a host and covers its subdomains. Every capture is held against the
entries that were active at its fetch day, an as-of join: hosts meet the list once each, by their
suffixes, and carry their intervals, sorted, to their captures; so a host with a third of all
captures still has one row on the list's side, sent to each of the tasks its captures are dealt
over, and no capture is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import looked_up, written

#: Listed entries that are broadcast to the hosts' suffixes; more of them are shuffled.
MOST_BROADCAST = 100_000
#: Scheme, optional user, host; of an absolute URL.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host in lower case without trailing dots; '' if the text is no absolute URL, null for null."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, since, until) from (entry, action, day).

    An interval opens at an 'add' that follows none or a 'remove', and closes at the next
    'remove'; on one day, 'remove' comes before 'add'. Repeated actions change nothing, a 'remove'
    without an 'add' is void, rows with a null are dropped, and until is exclusive.
    """
    rows = entries.select(F.lower("entry").alias("entry"), F.col("day").cast("date").alias("day"), (F.col("action") == "add").cast("int").alias("on")).dropna().distinct()
    line = Window.partitionBy("entry").orderBy("day", "on")
    turns = rows.withColumn("was", F.lag("on", 1, 0).over(line)).where("on <> was")
    ends = turns.withColumn("until", F.lead("day").over(line))
    opened = ends.where("on = 1").select("entry", F.col("day").alias("since"), F.coalesce("until", F.lit(FOREVER).cast("date")).alias("until"))
    return opened.where("since < until")


def active_entries(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetched") -> DataFrame:
    """(key, host, fetched, blocked, entry, since): a row for each capture.

    entry, since: the most specific active entry and the start of its interval; null if none. A
    null or malformed URL has host '' and, like a null day, is never blocked. Of entries that both
    match, the longer one counts, of its intervals the one that holds the day. Repeated captures are
    kept; empty tables give no or unblocked rows; other columns, whatever their names, are ignored; a
    very long URL is read up to its host's end.
    """
    rows = captures.select(F.col(key).alias("k"), F.coalesce(host_of(F.col(url).cast("string")), F.lit("")).alias("host"), F.col(day).cast("date").alias("fetched"))
    hosts = rows.select("host").distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # One row for each entry, so that a suffix of very many hosts ('com') meets one row at most.
    by_entry = written(intervals(entries).groupBy("entry").agg(F.collect_list(F.struct("since", "until")).alias("spells")), "entries")
    spread = hosts.select("host", F.explode(suffixes).alias("entry"))
    if by_entry.count() <= MOST_BROADCAST:
        known = spread.join(F.broadcast(by_entry), "entry")
    else:
        known = looked_up(written(spread.join(by_entry.select("entry"), "entry", "left_semi"), "suffixes"), by_entry, "entry")
    known = known.select("host", "entry", F.explode("spells").alias("x"))
    # Longest entry first, then latest start: the first active one is the answer.
    best = F.array_sort(F.collect_list(F.struct((-F.length("entry")).alias("order"), F.col("entry"), F.col("x.since").alias("since"), F.col("x.until").alias("until"))))
    by_host = written(known.groupBy("host").agg(best.alias("list")), "hosts")
    joined = looked_up(rows, by_host, "host", "left")
    hit = F.filter("list", lambda x: (x["since"] <= F.col("fetched")) & (F.col("fetched") < x["until"]))
    out = joined.withColumn("hit", F.get(hit, F.lit(0)))
    return out.select(F.col("k").alias(key), "host", "fetched", F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("entry"), F.col("hit.since").alias("since"))
