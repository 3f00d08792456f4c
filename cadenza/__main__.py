"""python -m cadenza list | run NAME FOLDER OUT | refresh FOLDER OUT [--as-of TIME] | ask OUT [--user ID] [--songs ID...] [-n N]"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza.operators.history import update_due
from cadenza.plans.queries import QUERIES, served_tables
from cadenza.service import Recommender
from cadenza.sources import registry
from cadenza.sources.bindings import Tables


def due(spark: SparkSession, out: str, as_of: str) -> bool:
    """Whether the tables in out were never refreshed, or a new week's Monday has come."""
    try:
        last = spark.read.parquet(f"{out}/refreshed").agg(F.max("at").alias("at"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return True
    return last.select(update_due(F.col("at"), as_of)).first()[0]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of queries")
    run = sub.add_parser("run", help="write a query's result as parquet")
    run.add_argument("name", choices=sorted(QUERIES))
    refresh = sub.add_parser("refresh", help="write the tables that requests are served from")
    for s in (run, refresh):
        s.add_argument("folder")
        s.add_argument("out")
    refresh.add_argument("--as-of", help="refresh only if the week's update is due at this time")
    ask = sub.add_parser("ask", help="print what the tables last published recommend, as JSON lines")
    ask.add_argument("out")
    ask.add_argument("--user", type=int)
    ask.add_argument("--songs", type=int, nargs="*", default=[])
    ask.add_argument("-n", type=int, default=10)
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    if a.what == "refresh" and a.as_of and not due(spark, a.out, a.as_of):
        print("not due")
        return
    if a.what == "ask":
        found = Recommender.load(spark, f"{a.out}/served").recommend(a.user, a.songs, a.n)
        print("\n".join(r.x for r in found.orderBy("rank").select(F.to_json(F.struct("rank", "song_id", "title", "fine_score", "primary_channel")).alias("x")).collect()))
        return
    names = [a.name] if a.what == "run" else ["item_item_cosine_topk", "user_user_cosine_topk", "quality_heuristic", "hybrid_pipeline"]
    for name in names:
        QUERIES[name](spark, a.folder).write.mode("overwrite").parquet(f"{a.out}/{name}")
    if a.what == "refresh":
        registry.publish(spark, f"{a.out}/served", served_tables(Tables(spark, a.folder)))
    if a.what == "refresh" and a.as_of:
        spark.range(1).select(F.lit(a.as_of).cast("timestamp_ntz").alias("at")).write.mode("overwrite").parquet(f"{a.out}/refreshed")


if __name__ == "__main__":
    main()
