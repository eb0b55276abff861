"""Search: the query language, faceted filters, text predicates, fuzzy ranking and pages.

Where the two code paths of the engine this follows differ, the store path is taken: hidden items are
left out, `type:` replaces the kind argument, `year:` compares the first four characters, a persona id
overrides the persona kind, and free text is matched token by token before it is ranked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.dates import captured_ts, year_of
from ..functions.text import fuzzy_score, like_token
from ..sources.workspace import small_batches
from .textindex import with_tokens

KEYS = ("type", "tag", "person", "pet", "year")


@dataclass(frozen=True)
class Query:
    """A parsed search: field filters and the rest as free text."""

    filters: dict[str, str] = field(default_factory=dict)
    text: str = ""


def parse_query(q: str) -> Query:
    """`key:value` of a known key (exact case) with a value is a filter, the last of a key wins; all else is text."""
    filters, rest = {}, []
    for word in (q or "").split():
        key, colon, value = word.partition(":")
        if colon and value and key in KEYS:
            filters[key] = value
        else:
            rest.append(word)
    return Query(filters, " ".join(rest))


def recency() -> list[Column]:
    """Newest first as stored; ids break ties."""
    return [F.col("captured_at").desc(), F.col("modified_ts").desc(), F.col("id")]


def page(df: DataFrame, order: list[Column] | None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in order; no limit, or one of 0 or less, means all."""
    out = df.orderBy(*order) if order else df
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit and limit > 0 else out


def with_tag(items: DataFrame, item_tags: DataFrame, tag: str) -> DataFrame:
    return items.join(item_tags.filter(F.col("tag") == tag.lower()).select(F.col("item_id").alias("id")), "id", "left_semi")


def with_personas(items: DataFrame, item_personas: DataFrame, persona_ids: list[str] | None = None, persona_kind: str | None = None, personas: DataFrame | None = None) -> DataFrame:
    """Items of any of the personas; the kind counts only where no ids are given."""
    if persona_ids:
        hit = item_personas.filter(F.col("persona_id").isin(*persona_ids))
    elif persona_kind:
        own = personas.filter(F.col("kind") == persona_kind).select(F.col("id").alias("persona_id"))
        hit = item_personas.join(own, "persona_id", "left_semi")
    else:
        return items
    return items.join(hit.select(F.col("item_id").alias("id")), "id", "left_semi")


def with_text(items: DataFrame, item_search: DataFrame, text: str, item_grams: DataFrame | None = None) -> DataFrame:
    """Items whose blob holds every token (any case; % and _ are wildcards); from the index if there is one."""
    tokens = (text or "").lower().split()
    if not tokens:
        return items
    if item_grams is not None:
        return items.join(with_tokens(item_grams, item_search, tokens).select(F.col("item_id").alias("id")), "id", "left_semi")
    hit = F.lit(True)
    for t in tokens:
        hit = hit & like_token(F.col("search_blob"), t)
    return items.join(item_search.filter(hit).select(F.col("item_id").alias("id")), "id", "left_semi")


def query_items(
    items: DataFrame, item_tags: DataFrame | None = None, item_personas: DataFrame | None = None, personas: DataFrame | None = None, item_search: DataFrame | None = None, *,
    media_kind: str | None = None, favorites: bool = False, year: str | None = None, tag: str | None = None, persona_ids: list[str] | None = None, persona_kind: str | None = None,
    text: str | None = None, include_hidden: bool = False, limit: int | None = None, offset: int = 0, ordered: bool = True, item_grams: DataFrame | None = None,
) -> DataFrame:
    """The central query: every predicate optional, semi joins for facets, newest first."""
    out = items
    if not include_hidden:
        out = out.filter(~F.col("hidden"))
    if media_kind:
        out = out.filter(F.col("media_kind") == media_kind)
    if favorites:
        out = out.filter("favorite")
    if year:
        out = out.filter(year_of() == year)
    if tag:
        out = with_tag(out, item_tags, tag)
    out = with_personas(out, item_personas, persona_ids, persona_kind, personas)
    if text:
        out = with_text(out, item_search, text, item_grams)
    return page(out, recency(), limit, offset) if ordered else out


def field_filter(items: DataFrame, filters: dict[str, str], item_personas: DataFrame | None = None, personas: DataFrame | None = None) -> DataFrame:
    """The in-memory reading of filters: lower-cased kind, any-case tag, year anywhere in the date, and
    person and pet both required."""
    out = items
    if "type" in filters:
        out = out.filter(F.col("media_kind") == filters["type"].lower())
    if "tag" in filters:
        out = out.filter(F.exists("tags", lambda t: F.lower(t) == filters["tag"].lower()))
    if "year" in filters:
        out = out.filter(F.col("captured_at").contains(filters["year"]))
    for key in ("person", "pet"):
        if key in filters:
            own = personas.filter((F.col("kind") == key) & (F.lower("name") == filters[key].lower())).select(F.col("id").alias("persona_id"))
            out = out.join(item_personas.join(own, "persona_id", "left_semi").select(F.col("item_id").alias("id")), "id", "left_semi")
    return out


def persona_ids_by_name(personas: DataFrame, kind: str, name: str) -> DataFrame:
    """Trimmed names, any case; ordered by name."""
    return personas.filter((F.col("kind") == kind) & (F.lower(F.trim("name")) == name.strip().lower())).orderBy(F.lower("name"), "id").select("id")


def search(
    items: DataFrame, item_tags: DataFrame, item_personas: DataFrame, personas: DataFrame, item_search: DataFrame, q: str, *,
    media_kind: str | None = None, favorites: bool = False, persona_id: str | None = None, persona_kind: str | None = None, limit: int | None = 180, offset: int = 0, settings: Settings | None = None, item_grams: DataFrame | None = None,
) -> DataFrame:
    """The composite search. Columns of items and `score` (null without free text).

    With free text the newest candidates, max(600, offset + limit + 1), are ranked by fuzzy score (35 or
    more), date and modification time. Names are looked up first: they bound nothing but a few ids.
    """
    settings = settings or Settings()
    query = parse_query(q)
    ids: set[str] | None = {persona_id} if persona_id else None
    for key in ("person", "pet"):
        if key in query.filters:
            named = {r[0] for r in persona_ids_by_name(personas, key, query.filters[key]).collect()}
            ids = named if ids is None else ids & named
    if ids is not None and not ids:
        return items.limit(0).withColumn("score", F.lit(None).cast("int"))
    common = dict(
        media_kind=query.filters.get("type", media_kind), favorites=favorites, year=query.filters.get("year"), tag=query.filters.get("tag"), persona_ids=sorted(ids) if ids else None, persona_kind=persona_kind
    )
    if not query.text:
        return query_items(items, item_tags, item_personas, personas, item_search, **common, limit=limit, offset=offset).withColumn("score", F.lit(None).cast("int"))
    most = max(settings.search_candidate_limit, offset + (limit or 0) + 1) if limit else settings.search_candidate_limit
    found = query_items(items, item_tags, item_personas, personas, item_search, **common, text=query.text, limit=most, item_grams=item_grams)
    ranked = found.join(item_search.select(F.col("item_id").alias("id"), "search_blob"), "id").withColumn("score", fuzzy_score(query.text, "search_blob")).drop("search_blob")
    ranked = ranked.filter(F.col("score") >= settings.fuzzy_minimum)
    return page(ranked, [F.col("score").desc(), captured_ts().desc(), F.col("modified_ts").desc(), F.col("id")], limit, offset)


def fuzzy_ranked(texts: DataFrame, query: str, blob: str, ties: list[Column], least: int | None = None, limit: int | None = None) -> DataFrame:
    """texts with their fuzzy `score`, the best first, those below `least` left out; a limit makes it a top-k.

    Texts reach the scoring in batches of a few MB, whatever their number and length. Scoring costs far more than moving a text, so a table that is read in fewer parts than there are cores is dealt
    out first; one of many parts stays where it is.
    """
    small_batches(texts.sparkSession)
    sc = texts.sparkSession.sparkContext
    if texts.rdd.getNumPartitions() < sc.defaultParallelism:
        texts = texts.repartition(4 * sc.defaultParallelism)
    out = texts.withColumn("score", fuzzy_score(query, blob))
    out = out.filter(F.col("score") >= (Settings().fuzzy_minimum if least is None else least))
    if not limit:  # a sort looks at its input twice: what it looks at is the scored rows, not the scoring
        out = out.repartition(F.xxhash64("score", *ties))
    return page(out, [F.col("score").desc(), *ties], limit)


def search_in_memory(items: DataFrame, item_personas: DataFrame, personas: DataFrame, item_search: DataFrame, q: str, settings: Settings | None = None) -> DataFrame:
    """The unpaged twin: field filters, then fuzzy scores over everything, hidden items included."""
    settings, query = settings or Settings(), parse_query(q)
    out = field_filter(items, query.filters, item_personas, personas)
    if not query.text:
        return out.orderBy(captured_ts().desc(), F.col("modified_ts").desc(), "id").withColumn("score", F.lit(None).cast("int"))
    out = out.join(item_search.select(F.col("item_id").alias("id"), "search_blob"), "id").withColumn("score", fuzzy_score(query.text, "search_blob")).drop("search_blob")
    return out.filter(F.col("score") >= settings.fuzzy_minimum).orderBy(F.col("score").desc(), captured_ts().desc(), F.col("modified_ts").desc(), "id")


def load_in_order(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """ids (pos, id): rows of the table in the caller's order, repeats kept, unknown and empty ids left out."""
    want = ids.filter("id is not null and id <> ''").withColumnRenamed("id", "_want")
    return table.join(want, F.col(key) == F.col("_want")).drop("_want")


def id_list(spark, ids: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id string")


def by_ids_recent(items: DataFrame, ids: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Items of an id set, newest first whatever the caller's order, paged."""
    return page(items.join(ids.select("id"), "id", "left_semi"), recency(), limit, offset)


def peeked_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of a page with `more` (whether others follow) and `next` (where the next page starts): one row more than
    the page is taken, and only these are numbered."""
    some = page(df, order, max(limit, 0) + 1, offset)
    own = some.withColumns({"_place": F.row_number().over(Window.orderBy(*order)), "more": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit})
    own = own.filter(F.col("_place") <= limit)
    return own.withColumn("next", (F.lit(offset) + F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).cast("int")).drop("_place")


def page_after(items: DataFrame, limit: int, last: tuple[str, float, str] | None = None) -> DataFrame:
    """The page behind the row (captured_at, modified_ts, id) in order of recency: rows before it are filtered out at the scan, not
    sorted again, so a late page costs no more than an early one."""
    if last is not None:
        date, time, key = (F.lit(x) for x in last)
        behind = (F.col("modified_ts") < time) | (F.col("modified_ts") == time) & (F.col("id") > key)
        items = items.filter((F.col("captured_at") <= date) & ((F.col("captured_at") < date) | behind))
    return page(items, recency(), limit)


@dataclass(frozen=True)
class Page:
    items: list
    has_more: bool
    next_offset: int


def collect_page(ordered: DataFrame, limit: int, offset: int = 0) -> Page:
    """One page on the driver: limit + 1 rows are asked for to see whether more follow."""
    if limit <= 0:
        return Page([], False, offset)
    rows = ordered.offset(offset).limit(limit + 1).collect()
    return Page(rows[:limit], len(rows) > limit, offset + len(rows[:limit]))


def members_page(owner: DataFrame, items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """owner (item_ids): its ids are sliced first and then loaded, so missing items shorten the page."""
    ids = owner.select(F.posexplode(F.slice("item_ids", F.lit(offset + 1), F.lit(limit))).alias("pos", "id"))
    return load_in_order(items, ids).orderBy("pos").drop("pos")


def members(owner: DataFrame, items: DataFrame) -> DataFrame:
    """All items of an album or memory in its own order."""
    return load_in_order(items, owner.select(F.posexplode("item_ids").alias("pos", "id"))).orderBy("pos").drop("pos")


def detection_filter(kind: str = "all", dirty: bool | None = None) -> Column:
    c = F.lit(True) if kind in ("", "all") else F.col("kind") == "face" if kind == "person" else F.col("kind").isin("pet", "pet_face") if kind == "pet" else F.col("kind") == kind
    return c if dirty is None else c & (F.col("cluster_dirty") == dirty)


def query_detections(detections: DataFrame, kind: str = "all", dirty: bool | None = None, item_ids: list[str] | None = None) -> DataFrame:
    """Newest first. An empty id list filters nothing; a list of empty ids finds nothing."""
    out = detections.filter(detection_filter(kind, dirty))
    if item_ids:
        out = out.filter(F.col("item_id").isin(*[i for i in item_ids if i])) if any(item_ids) else out.filter(F.lit(False))
    return out.orderBy(F.col("captured_at").desc(), "item_id", "detection_id")


def persona_order() -> list[Column]:
    return [F.col("kind"), F.lower("name"), F.col("id")]


def list_personas(personas: DataFrame) -> DataFrame:
    return personas.orderBy(*persona_order())


def album_order() -> list[Column]:
    return [F.lower("name"), F.col("id")]


def list_albums(albums: DataFrame) -> DataFrame:
    return albums.orderBy(*album_order())


def memory_order() -> list[Column]:
    return [F.coalesce(F.nullif("end_date", F.lit("")), "created_at").desc(), F.col("created_at").desc(), F.col("id")]


def list_memories(memories: DataFrame) -> DataFrame:
    return memories.orderBy(*memory_order())


def cluster_order() -> list[Column]:
    return [F.col("member_count").desc(), F.col("item_count").desc(), F.col("latest_captured_at").desc(), F.col("cluster_id")]


def list_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(*cluster_order())


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table, one scan each."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def scan_order() -> list[Column]:
    """Newest folders first: by folder names' first numbers, then text, then file time and name."""
    parts = F.split("relative_key", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))
    key = F.transform(folders, lambda p: F.struct(p.rlike(r"\d").cast("int"), number(p), F.lower(p)))
    return [key.desc(), F.col("modified_ts").desc(), F.lower(F.element_at(parts, -1)).desc()]


def timeline_runs(items: DataFrame, title: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Run-length groups: rows in order whose title equals their predecessor's share a run number."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    out = items.withColumn("title", title).withColumn("_new", F.coalesce((F.lag("title").over(w) != F.col("title")).cast("int"), F.lit(1)))
    return out.withColumn("run", F.sum("_new").over(w)).drop("_new")
