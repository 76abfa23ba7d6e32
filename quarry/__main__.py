"""python -m quarry clean|index|profile|search|plan|serve ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="job", required=True)
    for name, places in (("clean", ("source", "target")), ("index", ("source", "target", "store")), ("profile", ("source",)), ("search", ("index", "query")), ("plan", ()), ("serve", ("index", "store"))):
        one = sub.add_parser(name)
        for x in places:
            one.add_argument(x)
    sub.choices["serve"].add_argument("--port", type=int, default=8000)
    a = p.parse_args()
    from quarry.operators import search
    from quarry.operators.index import Index
    from quarry.plans import jobs, sections
    from quarry.plans.query_language import Query

    spark = SparkSession.builder.appName(f"quarry {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "clean":
        print(jobs.clean_jsonl(spark, a.source, a.target))
    elif a.job == "index":
        print(jobs.build_index(spark, a.source, a.target, a.store).docs.count(), "documents")
    elif a.job == "profile":
        print(jobs.profile(spark, a.source))
    elif a.job == "plan":
        print(sections.format_table(sections.dimension(spark)))
    elif a.job == "serve":
        from quarry import web
        from quarry.api import Service
        from quarry.sources.store import Store

        web.server(Service(spark, Index.load(spark, a.index), Store(spark, a.store)), port=a.port).serve_forever()
    else:
        for r in search.search(Index.load(spark, a.index), Query(a.query))[0].collect():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
