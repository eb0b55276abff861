"""The driver's tables seen as a library: orders are items, suppliers personas, embeddings detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "image").when(F.col("o_orderstatus") == "O", "video").otherwise("gif")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), iso("o_orderdate").alias("captured_at"), F.col("o_totalprice").alias("modified_ts"), kind.alias("media_kind"),
        (F.col("o_orderpriority") == "1-URGENT").alias("favorite"), (F.col("o_orderpriority") == "5-LOW").alias("hidden"),
    )


def item_tags(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.lower("l_returnflag").alias("tag")).distinct()


def personas(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "pet").otherwise("person").alias("kind"))


def item_personas(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_suppkey").cast("string").alias("persona_id")).distinct()


def tagged_items(spark, d) -> DataFrame:
    """Items whose tags are the words of the parts they hold, repeats kept."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    tags = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.flatten(F.collect_list(F.split("p_name", " "))).alias("tags"))
    return items(spark, d).join(tags, "id")


def whole_items(spark, d) -> DataFrame:
    """Items with their line items as faces, each owned by its supplier; urgent ones also belong to persona 7 by hand."""
    from ..schema import conform

    li = table(spark, d, "lineitem")
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber")
    face = lambda x: F.struct(x["id"].alias("id"), F.lit("face").alias("kind"), F.lit("").alias("label"), F.lit(1.0).alias("confidence"), F.lit(None).cast("array<int>").alias("bbox"), x["persona_id"].alias("persona_id"), F.lit(None).cast("array<double>").alias("encoding"), F.lit("").alias("signature"))
    # only what differs is collected and sorted; the rest is the same for all
    own = F.sort_array(F.collect_list(F.struct(name.alias("id"), F.col("l_suppkey").cast("string").alias("persona_id"))))
    per = li.groupBy("l_orderkey").agg(own.alias("own")).select(F.col("l_orderkey").alias("_key"), F.transform("own", face).alias("detections"))
    hand = F.when(F.col("favorite"), F.array(F.lit("7"))).otherwise(F.array().cast("array<string>"))
    return conform(items(spark, d).join(per, F.col("id").cast("long") == F.col("_key")).withColumn("manual_persona_ids", hand), "items")


def text_items(spark, d) -> DataFrame:
    """Documents as items: the path is source/lang/doc_id, the text is the searchable blob."""
    t = table(spark, d, "documents")
    key = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("-note.jpg")))
    return t.select(F.col("doc_id").cast("string").alias("id"), key.alias("relative_key"), F.col("n_chars").cast("double").alias("modified_ts"), F.lit("image").alias("media_kind"), F.coalesce("text", F.lit("")).alias("text"))


def dated_texts(spark, d) -> DataFrame:
    """Documents as items with dates; every tenth is hidden."""
    day = F.format_string("2024-01-%02dT00:00:00+00:00", (F.col("id").cast("long") % 28 + 1).cast("int"))
    return text_items(spark, d).withColumn("captured_at", day).withColumn("favorite", F.lit(False)).withColumn("hidden", F.col("id").cast("long") % 10 == 0)


def detections(spark, d) -> DataFrame:
    """Vectors as detections, four to an item; labels 0 to 5 are faces, others pets of two kinds."""
    e = table(spark, d, "embeddings")
    kind = F.when(F.col("label") < 6, "face").when(F.col("label") < 8, "pet").otherwise("pet_face")
    label = F.when(F.col("label") < 6, F.lit("face")).when(F.col("label") % 2 == 0, "cat").otherwise("dog")
    return e.select(
        F.floor(F.col("vec_id") / 4).cast("string").alias("item_id"), F.col("vec_id").cast("string").alias("detection_id"), kind.alias("kind"), label.alias("label"), "vec_id",
        (F.lit(0.5) + (F.col("vec_id") * 7 % 50) / 100).cast("double").alias("confidence"), F.lit(None).cast("string").alias("persona_id"), F.col("embedding").cast("array<double>").alias("encoding"),
        F.substring(F.sha1(F.col("vec_id").cast("string").cast("binary")), 1, 16).alias("signature"), F.format_string("2024-01-%02dT00:00:00+00:00", (F.col("vec_id") % 28 + 1).cast("int")).alias("captured_at"),
        (F.col("label") == 0).alias("cluster_dirty"), F.col("label").alias("class_label"),
    )


def label_personas(spark, d) -> DataFrame:
    """One persona a label; its references are the vectors of that label with ids divisible by 20."""
    e = table(spark, d, "embeddings").filter("vec_id % 20 = 0")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))), lambda s: s["v"])
    hashes = F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: F.substring(F.sha1(v.cast("string").cast("binary")), 1, 16))
    kind = F.when(F.col("label") < 6, "person").otherwise("pet")
    return e.groupBy("label").agg(refs.alias("reference_encodings"), hashes.alias("reference_signatures")).select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("id"), F.concat(F.lit("Label "), F.col("label").cast("string")).alias("name"), kind.alias("kind"), F.lit("#336699").alias("color"), "reference_encodings", "reference_signatures")


def boxes(spark, d) -> DataFrame:
    """Line items as boxes of their order."""
    li = table(spark, d, "lineitem")
    box = F.array((F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 40).cast("int"), F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 8).cast("int"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", box.alias("box"))


def files(spark, d) -> DataFrame:
    """Documents as photo files: every document an image, every third also a video of the same stem."""
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    stem = F.concat_ws("/", "source", F.concat((F.col("doc_id") % 30 + 1995).cast("string"), F.lit("-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")), F.concat(F.lit("IMG_"), F.col("doc_id").cast("string")))
    ext = F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(".HEIC"), F.lit(".MOV"))).when(F.col("doc_id") % 7 == 0, F.array(F.lit(".txt"))).otherwise(F.array(F.lit(".jpg"))))
    return t.select(stem.alias("stem"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") * 1_000_000_000).alias("mtime_ns"), ext.alias("ext")).select(F.concat("stem", "ext").alias("path"), "size_bytes", "mtime_ns")
