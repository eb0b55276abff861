"""URL filters by a temporal list join. DataFrame functions only.

List events (list, kind, pattern, action, at) become validity intervals: an `add` holds until the next
event of its (list, kind, pattern). A capture offers its keys - the host, every domain it lies under, and
every path prefix of it that ends at a slash - and an as-of join on the key picks the entries whose
interval holds the fetch time. The join is by key and by cell of time: the captures' span is cut into
`CELLS` cells, an interval stands in each cell it touches, so a capture only meets the entries of its own
cell and a hot host's captures and entries are dealt by cell. Captures that share url and fetch time are
judged once.

Kinds: `host` (that host alone), `domain` (the domain and all below it), `prefix` (host and path, without
scheme, port and query, starting with the pattern, which ends with a slash).

Defined results: of events at one instant the removal wins; a null or unreadable url, or a null fetch
time, matches nothing; host names compare in lower case without port, user and final dot; repeated rows
are judged each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, table

FOREVER, CELLS = "9999-12-31 00:00:00", 64


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): when entries hold."""
    own = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    e = events.filter("pattern is not null and at is not null").withColumn("until", F.coalesce(F.lead("at").over(own), F.lit(FOREVER).cast("timestamp")))
    return e.filter((F.col("action") == "add") & (F.col("until") > F.col("at"))).select("list", "kind", F.lower("pattern").alias("pattern"), F.col("at").alias("since"), "until")


def with_host(df: DataFrame) -> DataFrame:
    """Adds host and path columns of `url`."""
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract("url", r"^[^/]*//[^/?#]*(/[^?#]*)?", 1)
    return df.withColumn("host", F.rtrim(host, F.lit("."))).withColumn("path", F.when(path == "", F.lit("/")).otherwise(path))


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, n_entries, lists) for every row of captures (page_id, url, fetched_at)."""
    rows = captures.select("page_id", "url", "fetched_at")
    known = with_host(rows.filter("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()).filter("host <> ''")
    first, last = rows.agg(F.min(F.unix_micros("fetched_at")), F.max(F.unix_micros("fetched_at"))).first()
    first, wide = first or 0, ((last or 0) - (first or 0)) // CELLS + 1
    cell = lambda at: F.floor((F.unix_micros(at) - first) / wide).cast("long")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.lower(F.concat("host", F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    key = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    keys = F.concat(F.array(key("host")(F.col("host"))), F.transform(domains, key("domain")), F.transform(prefixes, key("prefix")))
    offered = known.select("url", "fetched_at", cell(F.col("fetched_at")).alias("cell"), F.explode(F.array_distinct(keys)).alias("k")).select("url", "fetched_at", "cell", "k.kind", "k.pattern")
    held = intervals(events).filter((F.unix_micros("since") <= F.lit(first) + wide * CELLS) & (F.unix_micros("until") > first))
    touched = F.sequence(F.greatest(cell(F.col("since")), F.lit(0).cast("long")), F.least(cell(F.col("until")), F.lit(CELLS - 1).cast("long")))
    active = Scratch(captures.sparkSession, "lists").write(held.withColumn("cell", F.explode(touched)), "active")
    hit = offered.join(small(active), ["kind", "pattern", "cell"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("until")))
    per = hit.groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = rows.join(per, ["url", "fetched_at"], "left")
    return out.select("page_id", "url", "fetched_at", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"))


def _draw(c, n: int):
    return (F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % n).cast("int")


def sample_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; page_id gives each page a day of 2024."""
    return pages.select("page_id", "url", F.timestamp_add("DAY", (F.col("page_id") * 37 % 366).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"))


def sample_events(pages: DataFrame) -> DataFrame:
    """Lists drawn from the hosts in the table: every third host and fourth domain is added, removed after
    60 days and added again 120 days later; every second first path step is added once."""
    hosts = with_host(pages.select("url")).filter("host <> ''").select("host", "path").distinct()
    start = F.lit("2024-01-01").cast("timestamp")
    day = lambda c, plus: F.timestamp_add("DAY", _draw(c, 180) + plus, start)
    host = hosts.select("host").distinct().filter(_draw(F.col("host"), 3) == 0).select(F.lit("spam").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("pattern"))
    domain = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).distinct().filter((F.col("pattern") != "") & (_draw(F.col("pattern"), 4) == 0))
    domain = domain.select(F.lit("adult").alias("list"), F.lit("domain").alias("kind"), "pattern")
    prefix = hosts.select(F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/")).alias("pattern")).distinct().filter(_draw(F.col("pattern"), 2) == 0)
    prefix = prefix.select(F.lit("robots").alias("list"), F.lit("prefix").alias("kind"), F.lower("pattern").alias("pattern")).distinct()
    twice = host.unionByName(domain)
    add = twice.unionByName(prefix).select("*", F.lit("add").alias("action"), day(F.col("pattern"), 0).alias("at"))
    gone = twice.select("*", F.lit("remove").alias("action"), day(F.col("pattern"), 60).alias("at"))
    again = twice.select("*", F.lit("add").alias("action"), day(F.col("pattern"), 180).alias("at"))
    return add.unionByName(gone).unionByName(again)


def op8_temporal_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(sample_captures(pages), sample_events(pages))


SQL = r"""
WITH h AS (
  SELECT row_number() OVER () AS rid, page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 366 AS INT)) AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
         CASE WHEN regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)?', 1) END AS path
  FROM pages),
d AS (
  SELECT DISTINCT 'spam' AS list, 'host' AS kind, host AS pattern, 3 AS n FROM h WHERE host <> ''
  UNION SELECT DISTINCT 'adult', 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 4 FROM h WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT DISTINCT 'robots', 'prefix', host || '/' || split_part(path, '/', 2) || '/', 2 FROM h WHERE host <> ''),
e AS (SELECT list, kind, lower(pattern) AS pattern, CAST(('0x' || substr(md5(lower(pattern)), 1, 8))::BIGINT % 180 AS INT) AS day FROM d WHERE ('0x' || substr(md5(pattern), 1, 8))::BIGINT % n = 0),
iv AS (
  SELECT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days(day) AS since, CASE WHEN kind = 'prefix' THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '2024-01-01' + to_days(day + 60) END AS until FROM e
  UNION ALL SELECT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days(day + 180), TIMESTAMP '9999-12-31' FROM e WHERE kind <> 'prefix'),
m AS (
  SELECT h.rid, h.page_id, h.url, h.fetched_at, iv.list FROM h LEFT JOIN iv ON h.host <> '' AND h.fetched_at >= iv.since AND h.fetched_at < iv.until AND (
    (kind = 'host' AND host = pattern) OR (kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern))) OR (kind = 'prefix' AND starts_with(lower(host || path), pattern))))
SELECT page_id, url, fetched_at, count(list) > 0 AS blocked, count(list)::BIGINT AS n_entries, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists
FROM m GROUP BY rid, page_id, url, fetched_at
"""
