"""Registered queries that go through a saved library, and through what its interface serves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..schema import empty
from ..sources.store import Library
from ..sources.workspace import shared_folder
from . import adapters as lib
from .adapters import table
from .registry import ITEMS, LINKS, query


@query("library_saves", """WITH d AS (SELECT l_orderkey, count(*) AS n, list(DISTINCT l_suppkey::VARCHAR) AS p FROM lineitem GROUP BY 1), i AS (SELECT o_orderkey AS k, o_custkey % 10 AS c, o_orderpriority = '1-URGENT' AS favorite, n, p FROM orders JOIN d ON l_orderkey = o_orderkey)
  SELECT k::VARCHAR AS id, CASE WHEN c = 0 THEN NOT favorite ELSE favorite END AS favorite, n AS detections, (len(p) + CASE WHEN favorite AND NOT list_contains(p, '7') THEN 1 ELSE 0 END)::BIGINT AS personas FROM i WHERE c <> 1""")  # fmt: skip
def _(spark, d):
    """A whole library saved, then a tenth of its items changed and a tenth removed in a second save, and read again:
    items, the detections and persona links that follow from them."""
    own = Library(spark, f"{shared_folder(spark)}/mq-library-{uuid.uuid4().hex[:12]}", parts=4)
    at, fs = own._fs(own.root)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    items = lib.whole_items(spark, d)
    own.save_state(items, *[empty(spark, t) for t in ("personas", "albums", "memories")], "t0")
    tenth = lambda k: table(spark, d, "orders").filter(F.col("o_custkey") % 10 == k).select(F.col("o_orderkey").cast("string").alias("id"))
    own.save_items(own.table("items").join(tenth(0), "id", "left_semi").withColumn("favorite", ~F.col("favorite")), tenth(1), "t1")
    t = own.load()
    n = t["detections"].groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("detections"))
    p = t["item_personas"].groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("personas"))
    return t["items"].select("id", "favorite").join(n, "id").join(p, "id").select("id", "favorite", "detections", "personas")


@query("items_of_persona", f"WITH {ITEMS}, {LINKS} SELECT id, captured_at FROM items WHERE NOT hidden AND id IN (SELECT item_id FROM item_personas WHERE persona_id = '3') ORDER BY captured_at DESC, modified_ts DESC, id LIMIT 30 OFFSET 5")
def _(spark, d):
    return search.query_items(lib.items(spark, d), item_personas=lib.item_personas(spark, d), persona_ids=["3"], limit=30, offset=5).select("id", "captured_at")


@query("items_of_clusters", f"WITH {ITEMS} SELECT id, captured_at FROM items WHERE id IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_partkey % 50 IN (3, 4)) ORDER BY captured_at DESC, modified_ts DESC, id LIMIT 80")
def _(spark, d):
    """The items of two clusters, once each: line items are members, parts modulo 50 the clusters."""
    members = table(spark, d, "lineitem").select(F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("cluster_id"), F.col("l_orderkey").cast("string").alias("id"))
    ids = members.filter(F.col("cluster_id").isin("c3", "c4")).select("id").distinct()
    return search.by_ids_recent(lib.items(spark, d), ids, 80).select("id", "captured_at")


@query("detections_counted", """SELECT kind, dirty, count(*) FILTER (CASE kind WHEN 'all' THEN true WHEN 'person' THEN label < 6 WHEN 'pet' THEN label >= 6 ELSE label >= 8 END AND (dirty IS NULL OR (label = 0) = dirty)) AS n
  FROM embeddings, (SELECT unnest(['all', 'person', 'pet', 'pet_face']) AS kind), (SELECT unnest([NULL, true, false]) AS dirty) GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    """How many detections the clusters of each kind may hold, all of them, changed ones and others: one scan."""
    det = lib.detections(spark, d)
    asked = [(k, dirty) for k in ("all", "person", "pet", "pet_face") for dirty in (None, True, False)]
    counts = det.agg(*[F.count_if(search.detection_filter(k, dirty)).alias(f"n{i}") for i, (k, dirty) in enumerate(asked)])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(dirty).cast("boolean").alias("dirty"), F.col(f"n{i}").alias("n")) for i, (k, dirty) in enumerate(asked)]))
    return counts.select(rows)


@query("search_tokens", r"SELECT doc_id, len(t)::INT AS n, coalesce(t[1], '') AS first, coalesce(t[-1], '') AS last FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS t FROM documents)")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.search_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    end = lambda k: F.coalesce(F.try_element_at("t", F.lit(k)), F.lit(""))
    return t.select("doc_id", F.size("t").alias("n"), end(1).alias("first"), end(-1).alias("last"))
