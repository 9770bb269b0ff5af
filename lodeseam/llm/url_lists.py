"""URL filters: every capture against the list entries that were active when it was fetched.

A list is a table of dated events (entry, action "add" or "remove", day). An entry is a host or parent domain
("shop.example.com" also covers "www.shop.example.com") or a host with a directory ("example.com/ads/" covers what lies
below). Events become validity intervals [from, until), and an as-of join on the entry finds for each capture the
intervals that hold at its time. Intervals of an entry never overlap, so a capture meets an entry once at most.

All of it is DataFrame operations. Lists of up to BROADCAST_ENTRIES intervals are broadcast; longer ones are joined by
shuffle, where the skew join splits a host with many captures. Rows without a match never leave the join.

Defined results: a null URL, or one without a host, matches nothing; a null time matches nothing; events on one day count
as one, of which "remove" wins; a removal of what is not active does nothing; null entries, actions and days are left out;
equal captures each get a row; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ENTRIES = 200_000


def intervals(events: DataFrame) -> DataFrame:
    """(entry, from_day, until_day): until_day null while the entry is active."""
    days = events.where("entry IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    days = days.groupBy(F.lower("entry").alias("entry"), F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    order = Window.partitionBy("entry").orderBy("day")
    changes = days.withColumn("before", F.lag("action").over(order)).where("NOT action <=> before AND (action = 'add' OR before IS NOT NULL)")
    return changes.withColumn("until_day", F.lead("day").over(order)).where("action = 'add'").select("entry", F.col("day").alias("from_day"), "until_day")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def keys_of(url: Column) -> Column:
    """The entries that cover a URL: its host, all parents of two labels or more, and its directories."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    parts = F.split(path, "/")
    deep = F.size(parts) - 2  # directories below the root
    folders = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(hosts, folders)))


def matched(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with n_entries (active entries that cover the URL), entry (the longest of them) and blocked."""
    valid = intervals(events)
    if valid.count() <= BROADCAST_ENTRIES:
        valid = F.broadcast(valid)
    wanted = captures.select(F.col(url).alias("__url"), F.col(fetched).cast("date").alias("__day")).where("__url IS NOT NULL AND __day IS NOT NULL").distinct()
    keyed = wanted.select("__url", "__day", F.explode(keys_of(F.col("__url"))).alias("__key"))
    met = keyed.join(valid, (F.col("__key") == F.col("entry")) & (F.col("__day") >= F.col("from_day")) & (F.col("until_day").isNull() | (F.col("__day") < F.col("until_day"))))
    found = met.groupBy("__url", "__day").agg(F.count("*").alias("n_entries"), F.max(F.struct(F.length("entry").alias("l"), F.col("entry").alias("entry"))).alias("__top"))
    joined = captures.join(found, (captures[url] == F.col("__url")) & (captures[fetched].cast("date") == F.col("__day")), "left")
    made = {"n_entries": F.coalesce("n_entries", F.lit(0)).cast("long"), "entry": F.col("__top.entry"), "blocked": F.coalesce(found["n_entries"] > 0, F.lit(False))}
    return joined.select(*[captures[c] for c in captures.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def kept(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures that no active entry covers."""
    return matched(captures, events, url, fetched).where("NOT blocked").select(*captures.columns)


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the pages table, which has none: the first hex digits of a host's MD5 decide whether and when it is listed.

    Hosts whose first digit is 0 to 3 are added on a day that the second digit gives; those whose third digit is even are
    removed 60 days later, and of these those whose fourth digit is even are added again 90 days after that. The parent
    domain is listed instead of the host where the fifth digit is below 8 and the host has over three labels.
    """
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("host"), i, 1)) - 1
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    entry = F.when((digit(5) < 8) & (F.size(F.split("host", r"\.")) > 3), parent).otherwise(F.col("host"))
    listed = host.where(digit(1) < 4).select(entry.alias("entry"), F.expr("date_add(date'2024-01-01', 10 * (instr('0123456789abcdef', substring(md5(host), 2, 1)) - 1))").alias("day"), digit(3).alias("c"), digit(4).alias("d"))
    add = listed.select("entry", F.lit("add").alias("action"), "day")
    gone = listed.where("c % 2 = 0").select("entry", F.lit("remove").alias("action"), F.date_add("day", 60).alias("day"))
    back = listed.where("c % 2 = 0 AND d % 2 = 0").select("entry", F.lit("add").alias("action"), F.date_add("day", 150).alias("day"))
    return add.unionByName(gone).unionByName(back)


def digest(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, fetched, n_entries, entry, blocked. A page counts as fetched page_id mod 366 days into 2024."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.pmod(F.col("page_id"), F.lit(366)), F.lit(0)).cast("int"))
    found = matched(pages.select("page_id", "url", fetched.alias("fetched")), dated_list(pages))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


ORACLE = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1 AS d2,
             instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 AS d3, instr('0123456789abcdef', substr(md5(host), 4, 1)) - 1 AS d4,
             instr('0123456789abcdef', substr(md5(host), 5, 1)) - 1 AS d5 FROM c WHERE host <> ''),
l AS (SELECT CASE WHEN d5 < 8 AND len(string_split(host, '.')) > 3 THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END AS entry, DATE '2024-01-01' + CAST(10 * d2 AS INTEGER) AS day, d3, d4 FROM h WHERE d1 < 4),
e AS (SELECT entry, 'add' AS action, day FROM l UNION ALL SELECT entry, 'remove', day + 60 FROM l WHERE d3 % 2 = 0 UNION ALL SELECT entry, 'add', day + 150 FROM l WHERE d3 % 2 = 0 AND d4 % 2 = 0),
s AS (SELECT entry, day, max(action) AS action FROM e GROUP BY ALL),
f AS (SELECT c.page_id, c.url, c.fetched, s.entry, arg_max(s.action, s.day) AS state
      FROM c JOIN s ON s.day <= c.fetched AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry) OR (ends_with(s.entry, '/') AND starts_with(c.host || c.path, s.entry))) GROUP BY ALL),
g AS (SELECT page_id, url, count(*) AS n_entries, arg_max(entry, (length(entry), entry)) AS entry FROM f WHERE state = 'add' GROUP BY ALL)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(g.n_entries, 0) AS n_entries, g.entry, coalesce(g.n_entries, 0) > 0 AS blocked
FROM c LEFT JOIN g ON c.page_id = g.page_id AND c.url = g.url
"""
