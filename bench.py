"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: One or two of each kind of operator; the micro-benchmark's own rows are those that start with people_.
HEADLINE = ("pricing_summary", "s4_index_range", "s8_count_range", "p3_conjunction", "p15_correlated", "p17_like", "p18_glob", "j3_hash", "j4_range", "j7_full", "j13_many_tables", "a6_bare_columns", "a12_group_concat", "a15_distinct_aggregates", "w1_row_number", "w17_groups_frame", "w18_exclude_ties", "o3_top_k", "o7_union", "f11_substr", "f52_strftime", "n4_json_extract", "n7_json_set", "s16_json_tree", "d3_upsert", "d10_cascade")


def people(spark):
    """The published micro-benchmark's rows through the dialect: 100,000 people, 200 tags, 8 cities and 10,000 documents, cached as its file cache would be."""
    from pyspark.sql import functions as F

    from tessera.plans.connection import connect

    n = spark.range(100_000).select(F.col("id"), F.concat(F.lit("name"), F.col("id")).alias("name"), (F.pmod(F.xxhash64("id"), F.lit(73)) + 18).alias("age"), F.concat(F.lit("city"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8))).alias("city")).cache()
    tags = spark.range(200).select(F.concat(F.lit("name"), F.col("id") * 491).alias("name"), F.concat(F.lit("tag"), F.col("id")).alias("tag")).cache()
    cities = spark.range(8).select(F.concat(F.lit("city"), F.col("id")).alias("city"), F.concat(F.lit("country"), F.col("id") % 3).alias("country")).cache()
    for t in (n, tags, cities):
        t.count()
    docs = spark.range(10_000).select(F.col("id"), F.concat(F.lit('{"n":'), F.col("id"), F.lit(',"tags":["a",{"b":'), F.col("id") % 7, F.lit("}]}")).alias("doc")).cache()
    docs.count()
    db = connect(spark, people=n, tags=tags, cities=cities, docs=docs)
    return {
        name: lambda text=text: db.query(text)
        for name, text in {
            "people_count_filter": "SELECT count(*) FROM people WHERE age > 50",
            "people_scan": "SELECT * FROM people",
            "people_group": "SELECT city, count(*), avg(age), max(age) FROM people GROUP BY city",
            "people_top10": "SELECT * FROM people ORDER BY age, name LIMIT 10",
            "people_join_small": "SELECT c.country, count(*) FROM people p JOIN cities c ON p.city = c.city GROUP BY c.country",
            "people_join_tags": "SELECT count(*) FROM people p JOIN tags t ON p.name = t.name",
            "people_compound_where": "SELECT count(*) FROM people WHERE age > 30 AND age < 60 AND city <> 'city3' OR name LIKE '%99'",
            "docs_json_filter": "SELECT count(*) FROM docs WHERE json_extract(doc, '$.n') > 5000",
            "docs_json_group": "SELECT doc ->> '$.tags[1].b', count(*) FROM docs GROUP BY 1",
            "docs_json_set": "SELECT json_set(doc, '$.n', 1, '$.x', 'new') FROM docs",
            "docs_json_each": "SELECT count(*) FROM docs, json_each(docs.doc)",
            "docs_json_tree": "SELECT count(*) FROM docs, json_tree(docs.doc)",
            "docs_json_group_array": "SELECT json_group_array(id) FROM docs",
            "docs_json_valid": "SELECT count(*) FROM docs WHERE json_valid(doc)",
        }.items()
    }


def main() -> None:
    from tessera import registry
    from tessera.session import get_session

    spark = get_session("bench", f"local[{CPUS}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="12g", spark__log__level="ERROR", spark__sql__warehouse__dir="/tmp/tessera-bench-warehouse", spark__checkpoint__dir="/tmp/tessera-bench-checkpoint")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = {q: (lambda q=q: registry.QUERIES[q](spark, SF_DIR)) for q in HEADLINE} | people(spark)
    took = {}
    for name, build in runs.items():
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            sink(build())
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
