"""URL filters: a temporal join of captures with dated lists.

List entries (``add`` or ``remove`` on a date) become validity intervals, and every capture is evaluated against the entries
that were active on the day it was fetched. An entry names a domain (its hosts and those below), a path prefix of
a host, or one URL. Captures are first reduced to distinct (URL, day); their domains and prefixes meet the
intervals by equality of entry and month, and by day inside. So a host with very many captures is a skewed
equality join whose rows match at most one interval of each entry, and nothing is compared within a host.
Only DataFrame functions are used.

Defined results: a capture without URL, host or fetch time matches nothing. Entries without list, kind, value, date or known
action are ignored. Of several entries on one day the removal counts. An allowing list wins over blocking lists. Repeated
captures get the same verdict each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#@]+)"
REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def plain_url(url: Column) -> Column:
    """Host in lower case and path, without scheme, user, port, query and fragment."""
    path = F.regexp_extract(url, REST, 1)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path))


def url_keys(url: Column) -> Column:
    """array<struct<kind, value>>: every entry that could name this URL."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(plain_url(url), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
    )
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.when(
        host_of(url) != "",
        F.concat(named("domain", domains), named("prefix", prefixes), named("url", F.array(plain_url(url)))),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, kind, value, since, until): the days, end exclusive, on which each entry is active.

    ``entries`` has list, effect (block or allow), kind, value, listed_on (date) and action (add or remove).
    """
    known = F.col("action").isin("add", "remove") & F.col("effect").isin("block", "allow")
    rows = entries.filter(known).dropna(subset=["list", "kind", "value", "listed_on"])
    key = ["list", "effect", "kind", "value"]
    days = rows.groupBy(*key, "listed_on").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    timeline = Window.partitionBy(*key).orderBy("listed_on")  # at most one row for each day
    before = F.coalesce(F.lag("action").over(timeline), F.lit("remove"))
    changes = days.select("*", before.alias("before")).filter("action <> before")
    until = F.coalesce(F.lead("listed_on").over(timeline), F.lit(FOREVER).cast("date"))
    return changes.select(*key, F.col("listed_on").alias("since"), until.alias("until"), "action").filter("action = 'add'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_on; other columns are ignored) with their verdict.

    blocked, allowed: an active entry of such a list names the URL (blocked only if not allowed); lists: names of
    all of them, sorted; since: the first day of the oldest active blocking entry.
    """
    captures = captures.select("page_id", "url", "fetched_on")
    days = captures.filter("url IS NOT NULL AND fetched_on IS NOT NULL").select("url", "fetched_on").distinct()
    month = lambda day: F.trunc(day, "month")
    keys = days.select("url", "fetched_on", F.explode(url_keys(F.col("url"))).alias("k")).select(
        "url", "fetched_on", "k.kind", "k.value", month(F.col("fetched_on")).alias("month")
    )
    spans = intervals(entries)
    # an interval needs only the months that captures have, however far apart the first and the last are
    months = days.select(month(F.col("fetched_on")).alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("months"))
    spans = spans.withColumn("months", months.select("months").scalar())
    covered = F.filter("months", lambda m: (m >= month(F.col("since"))) & (m < F.col("until")))
    spans = spans.withColumn("month", F.explode(covered)).drop("months")
    active = keys.join(spans, ["kind", "value", "month"]).filter("since <= fetched_on AND fetched_on < until")
    verdicts = active.groupBy("url", "fetched_on").agg(
        F.max(F.col("effect") == "block").alias("blocking"),
        F.max(F.col("effect") == "allow").alias("allowed"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min(F.when(F.col("effect") == "block", F.col("since"))).alias("since"),
    )
    out = captures.join(verdicts, ["url", "fetched_on"], "left")
    allowed = F.coalesce("allowed", F.lit(False))
    return out.select(
        "page_id", "url", "fetched_on",
        (F.coalesce("blocking", F.lit(False)) & ~allowed).alias("blocked"),
        allowed.alias("allowed"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "since",
    )
