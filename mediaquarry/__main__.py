"""Command line: python -m mediaquarry {status,sync,search,migrate} LIBRARY ..."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .api import LibraryApi
from .plans.shipping import ship
from .sources.headers import headers_under
from .sources.scan import list_files
from .sources.store import Library


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mediaquarry")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("status", ()), ("sync", ("media_root",)), ("search", ("query",)), ("migrate", ("json_folder",))):
        c = sub.add_parser(name)
        c.add_argument("library")
        for e in extra:
            c.add_argument(e)
        if name == "search":
            c.add_argument("--limit", type=int, default=20)
            c.add_argument("--type", default="all", help="image, video, gif or live_photo")
            c.add_argument("--persona-kind", default="all", help="person or pet")
            c.add_argument("--persona-id", default="")
            c.add_argument("--favorites", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("mediaquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    api, now = LibraryApi(Library(spark, a.library)), datetime.now(timezone.utc).isoformat()
    if a.command == "status":
        api.status().show(truncate=False)
    elif a.command == "sync":
        api.sync(list_files(spark, a.media_root), now, headers=headers_under(spark, a.media_root)).show(truncate=False)
    elif a.command == "search":
        api.items(a.query, a.type, a.persona_kind, a.persona_id, "1" if a.favorites else "", limit=str(max(1, a.limit))).select("id", "mediaKind", "capturedAt", "title").show(max(1, a.limit), truncate=False)
    else:
        print("imported" if api.library.import_json(a.json_folder, now) else "the library is not empty")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
