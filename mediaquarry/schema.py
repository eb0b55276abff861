"""Tables of a library as Spark types. Lists are arrays, metadata is a map, nothing is a JSON payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DETECTION = "struct<id:string,kind:string,label:string,confidence:double,bbox:array<int>,persona_id:string,encoding:array<double>,signature:string>"

TABLES: dict[str, str] = {
    "items": (
        "id string, path string, component_paths array<string>, relative_key string, title string, media_kind string, extension string, file_signature string, "
        "size_bytes bigint, modified_ts double, captured_at string, discovered_at string, thumbnail_path string, width int, height int, duration_seconds double, "
        f"favorite boolean, hidden boolean, tags array<string>, manual_persona_ids array<string>, notes string, metadata map<string,string>, detections array<{DETECTION}>"
    ),
    "personas": (
        "id string, name string, kind string, created_at string, color string, avatar_item_id string, reference_encodings array<array<double>>, reference_signatures array<string>, "
        "reference_images array<struct<path:string,source_item_id:string,source_region_id:string,label:string,kind:string,created_at:string>>"
    ),
    "albums": "id string, name string, created_at string, item_ids array<string>, description string, query string",
    "memories": "id string, title string, subtitle string, summary string, created_at string, memory_type string, item_ids array<string>, persona_ids array<string>, start_date string, end_date string",
    "item_personas": "item_id string, persona_id string",
    "item_tags": "item_id string, tag string",
    "item_search": "item_id string, search_blob string",
    "item_grams": "item_id string, gram bigint, places array<int>",
    "detections": (
        "item_id string, detection_id string, kind string, label string, confidence double, bbox_x int, bbox_y int, bbox_w int, bbox_h int, persona_id string, encoding array<double>, "
        "signature string, source_frame_token string, captured_at string, pipeline_revision string, cluster_dirty boolean, cluster_dirty_revision string, updated_at string"
    ),
    "unknown_clusters": (
        "cluster_id string, kind string, label string, member_count int, item_count int, representative_detection_id string, representative_item_id string, preview_path string, "
        "latest_captured_at string, average_confidence double, revision string, is_partial boolean, updated_at string"
    ),
    "unknown_cluster_members": "cluster_id string, item_id string, detection_id string",
    "metadata": "key string, value string",
}

#: What a missing or null field is read as.
DEFAULTS = {"string": "''", "bigint": "0L", "double": "0.0D", "int": "0", "boolean": "false"}
#: Fields where null means something.
NULLABLE = {"persona_id", "avatar_item_id", "width", "height", "duration_seconds"}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns: missing ones added, types cast, nulls replaced by defaults."""
    out = []
    for f in schema(name).fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name not in NULLABLE:
            c = F.coalesce(c, F.expr(DEFAULTS.get(kind, f"cast({'map()' if kind.startswith('map') else 'array()'} as {kind})")))
        elif f.name == "persona_id":
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """No rows, and known to be none when a query is planned: what is joined with them is not shuffled."""
    return spark.createDataFrame([], schema(name)).filter(F.lit(False))
