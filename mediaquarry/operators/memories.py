"""Collections built from a library: months, days, spans, personas, pairs, themes, favourites.

Each builder takes items (id, captured_at, modified_ts, ...) and returns memories with `weight`. The lists
of ids are the first 48, newest first; only that many of a group's ids ever leave a task, by a bounded
window rank, whatever the group's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CAT_LABELS, STOP_TAGS, Settings
from ..functions.dates import captured_ts, label
from ..functions.text import stable_id, title_case
from ..sources.workspace import written

IDS, PAIRS, THEMES, SPANS, MOST = 48, 6, 8, 8, 24
COLUMNS = ["id", "title", "subtitle", "summary", "created_at", "memory_type", "item_ids", "persona_ids", "start_date", "end_date", "weight", "builder", "seq"]


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("modified_ts").desc(), F.col("id")]


def dated(items: DataFrame) -> DataFrame:
    return items.withColumn("ts", captured_ts())


def _grouped(rows: DataFrame, by: list[str], least: int, whole_span: bool = True) -> DataFrame:
    """(by..., n, item_ids, start_date, end_date, first_ts, last_ts) of groups with at least `least` rows.

    The dates are those of the group's last and first row in order; with whole_span off, of the 48 listed.
    """
    oldest = F.max_by("captured_at", F.struct(-F.unix_micros("ts"), -F.col("modified_ts"), F.col("id")))  # the last row of the order
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), oldest.alias("oldest_date")
    ).filter(F.col("n") >= least)
    w = Window.partitionBy(*by).orderBy(*_newest())
    ranked = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= IDS)  # a group limit: tasks drop the rest before the shuffle
    listed = ranked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"]).alias("item_ids"), F.max_by("captured_at", "rn").alias("cut_date"), F.min_by("captured_at", "rn").alias("end_date")
    )
    return sums.join(listed, by).withColumn("start_date", F.col("oldest_date") if whole_span else F.col("cut_date"))


def _memory(df: DataFrame, builder: int, *, id_: Column, title: Column, subtitle: Column, summary: Column, kind: Column, weight: Column, now: str, personas: Column | None = None, seq: list[Column]) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    out = df.select(
        stable_id(id_).alias("id"), title.alias("title"), subtitle.alias("subtitle"), summary.alias("summary"), F.lit(now).alias("created_at"), kind.alias("memory_type"), "item_ids",
        (personas if personas is not None else none).alias("persona_ids"), "start_date", "end_date", weight.cast("long").alias("weight"), F.lit(builder).alias("builder"), F.struct(*seq).alias("seq"),
    )
    return out.select(*COLUMNS)


def _n(text: str) -> Column:
    return F.concat(F.col("n").cast("string"), F.lit(text))


def month_memories(items: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    g = _grouped(dated(items).withColumn("key", label("ts", "month")), ["key"], s.memory_min_items)
    return _memory(g, 0, id_=F.concat(F.lit("memory:month:"), "key"), title=label("last_ts", "month_title"), subtitle=_n(" moments"), summary=F.concat(F.lit("A monthly highlight reel built from "), _n(" media items.")), kind=F.lit("time"), weight=F.col("n") + 18, now=now, seq=[(-F.unix_timestamp("last_ts")).alias("t")])


def day_memories(items: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    g = _grouped(dated(items).withColumn("key", label("ts", "day")), ["key"], s.memory_min_items + 2)
    return _memory(g, 1, id_=F.concat(F.lit("memory:day:"), "key"), title=label("last_ts", "day_title"), subtitle=_n(" moments from one day"), summary=F.lit("A denser one-day story assembled from a single date cluster."), kind=F.lit("day"), weight=F.col("n") + 24, now=now, seq=[(-F.unix_timestamp("last_ts")).alias("t")])


def spans(items: DataFrame, by: list[str] | None = None, gap_days: int = 2) -> DataFrame:
    """items with `span`: a new one begins where more than gap_days calendar days lie between neighbours.

    Spans depend on dates only, so the distinct dates of a group, not its items, are ordered.
    """
    by = by or []
    rows = dated(items).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy(*by).orderBy("day")
    days = rows.select(*by, "day").distinct().withColumn("_new", F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap_days).cast("int"), F.lit(0)))
    days = days.withColumn("span", F.sum("_new").over(w)).drop("_new")
    return rows.join(days, [*by, "day"])


def span_memories(items: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    g = _grouped(spans(items), ["span"], s.memory_min_items).filter("days >= 2").orderBy("span").limit(SPANS)
    day = lambda c: F.to_date(c).cast("string")
    title = F.concat(label("first_ts", "short"), F.lit(" to "), label("last_ts", "short_year"))
    subtitle = F.concat(_n(" moments across "), F.col("days").cast("string"), F.lit(" days"))
    return _memory(g, 2, id_=F.concat(F.lit("memory:span:"), day("first_ts"), F.lit(":"), day("last_ts")), title=title, subtitle=subtitle, summary=F.lit("A multi-day cluster that feels closer to a trip or weekend memory."), kind=F.lit("span"), weight=F.col("n") + 26, now=now, seq=[F.col("span")])


def persona_memories(items: DataFrame, item_personas: DataFrame, personas: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    rows = dated(items).join(item_personas.distinct(), items.id == item_personas.item_id)
    g = _grouped(rows, ["persona_id"], s.memory_min_items).join(personas.select(F.col("id").alias("persona_id"), "name", "kind"), "persona_id")
    return _memory(
        g, 3, id_=F.concat(F.lit("memory:persona:"), "persona_id"), title=F.col("name"), subtitle=_n(" appearances"), summary=F.concat(F.lit("A memory reel centered on "), "name", F.lit(".")),
        kind=F.concat("kind", F.lit("_persona")), weight=F.col("n") + F.when(F.col("kind") == "pet", 30).otherwise(28), now=now, personas=F.array("persona_id"), seq=[F.col("kind"), F.lower("name").alias("l"), F.col("persona_id")],
    )


def persona_pairs(item_personas: DataFrame) -> DataFrame:
    """(item_id, a, b): pairs among the first four persona ids of each item."""
    ids = F.slice(F.array_sort(F.collect_set("persona_id")), 1, 4)
    four = item_personas.groupBy("item_id").agg(ids.alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return four.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.a", "p.b")


def pair_memories(items: DataFrame, item_personas: DataFrame, personas: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    """The six most frequent pairs first, then those with enough items. Ties: by the pair."""
    s = settings or Settings()
    pairs = persona_pairs(item_personas)
    top = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "a", "b").limit(PAIRS).filter(F.col("c") >= s.memory_min_items)
    rows = dated(items).join(pairs.join(F.broadcast(top), ["a", "b"]), F.col("id") == F.col("item_id"))  # top: six rows
    g = _grouped(rows, ["a", "b"], 1, whole_span=False)
    name = personas.select("id", "name")
    g = g.join(name.withColumnsRenamed({"id": "a", "name": "na"}), "a").join(name.withColumnsRenamed({"id": "b", "name": "nb"}), "b")
    return _memory(
        g, 4, id_=F.concat(F.lit("memory:pair:"), "a", F.lit(":"), "b"), title=F.concat("na", F.lit(" and "), "nb"), subtitle=_n(" shared moments"), summary=F.lit("A memory built from repeated appearances together."),
        kind=F.lit("pair"), weight=F.col("n") + 16, now=now, personas=F.array("a", "b"), seq=[(-F.col("n")).alias("m"), F.col("a"), F.col("b")],
    )


def theme_counts(items: DataFrame) -> DataFrame:
    """(id, tag): tags in lower case, repeats in an item kept, stop tags and those under three letters not."""
    t = items.select("id", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    return t.filter(~F.col("tag").isin(*STOP_TAGS) & (F.length("tag") >= 3))


def theme_memories(items: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    """The eight most frequent themes first, then those with enough items. Ties: by the tag."""
    s = settings or Settings()
    tags = theme_counts(items)
    top = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "tag").limit(THEMES).filter(F.col("c") >= s.memory_min_items)
    g = _grouped(dated(items).join(tags.join(F.broadcast(top), "tag"), "id"), ["tag"], 1)  # top: eight rows
    cat = F.col("tag").isin(*CAT_LABELS)
    return _memory(
        g, 5, id_=F.concat(F.lit("memory:theme:"), "tag"), title=F.when(cat, "Cats").otherwise(title_case("tag")), subtitle=_n(" tagged moments"),
        summary=F.concat(F.lit("A themed memory built around recurring "), "tag", F.lit(" moments.")), kind=F.lit("theme"), weight=F.col("n") + F.when(cat, 14).otherwise(8), now=now, seq=[(-F.col("n")).alias("m"), F.col("tag")],
    )


def favorite_memories(items: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    g = _grouped(dated(items).filter("favorite").withColumn("key", F.lit(0)), ["key"], s.memory_min_items)
    return _memory(g, 6, id_=F.lit("memory:favorites"), title=F.lit("Favorites"), subtitle=_n(" saved moments"), summary=F.lit("A quick reel made from favorited items."), kind=F.lit("favorites"), weight=F.col("n") + 12, now=now, seq=[F.col("key")])


def regenerate(items: DataFrame, item_personas: DataFrame, personas: DataFrame, now: str = "", settings: Settings | None = None) -> DataFrame:
    """All builders together: by weight, builders in their order at ties; the first 24, then one of each id."""
    s = settings or Settings()
    # seven builders read them, most of them twice
    items, item_personas = written(items.select("id", "captured_at", "modified_ts", "favorite", "tags"), "items"), written(item_personas.select("item_id", "persona_id").distinct(), "links")
    parts = [month_memories(items, now, s), day_memories(items, now, s), span_memories(items, now, s), persona_memories(items, item_personas, personas, now, s), pair_memories(items, item_personas, personas, now, s), theme_memories(items, now, s), favorite_memories(items, now, s)]
    # each builder's first 24 are numbered in its own order; only they can be among the first 24 of all
    first = [p.orderBy(F.col("weight").desc(), "seq", "id").limit(MOST) for p in parts]
    numbered = [p.withColumn("seq", F.row_number().over(Window.orderBy(F.col("weight").desc(), "seq", "id"))) for p in first]
    every = reduce(DataFrame.unionByName, numbered)
    if not s.auto_generate_memories:
        return every.limit(0)
    first = every.orderBy(F.col("weight").desc(), "builder", "seq").limit(MOST)
    w = Window.partitionBy("id").orderBy(F.col("weight").desc(), "builder", "seq")
    return first.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(F.col("weight").desc(), "builder", "seq")
