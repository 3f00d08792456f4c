"""Shards by proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; rank r (from 0) of n has
the fraction (r + u) / n, where u in (0, 1) is drawn by the source, so that many small
sources spread over all shards. All rows sorted by that fraction are cut into shards of
equal counts (at most one apart), so each shard has each source in proportion.

Both rankings are made in two steps so that no source, however large, and no
global sort lands in one task: rows fall into buckets by the leading part of their
sort key, a running sum over the buckets' counts (a table whose size is fixed by
the number of buckets and sources) gives each bucket's offset, and rows are
numbered inside buckets. Equal rows are counted and then numbered, so that they, too, fall
into different buckets. Texts are not shuffled, only keys and sizes. The order comes from
md5 digests, which SQL has as well.

Results for special inputs: rows without a source are a source of their own; a
null text has size 16; rows without a key and equal rows are dealt like any others; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_long, stored

ROW_BYTES = 16
CHUNK = 4096  # copies of a row that a task numbers at a time


def _digest(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))


def _fraction(digest: str | Column) -> Column:
    """In (0, 1), from the first digits of a digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """out: the row's place, from 0, in its group by (bucket, order)."""
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group, F.lit(0)).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    return df.join(counts, [*group, bucket]).withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def shard(docs: DataFrame, shards: int = 40, seed: int = 42, buckets: int = 1024, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each row of docs: key, size in bytes, crc32 of the text, the law
    that holds (`rows`: counts at most one apart), shard and slot in the shard."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = as_long(docs, key, text, source).select(
        key,
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_source"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    same = rows.groupBy("_source", key, "size", "text_crc32").agg(F.count("*").alias("_c"))
    # Copies get numbers in chunks, so no task makes all rows of a large group.
    same = same.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / CHUNK)))).repartition("_source", key, "size", "text_crc32", "_k")
    number = F.explode(F.sequence(F.col("_k") * CHUNK, F.least("_c", (F.col("_k") + 1) * CHUNK) - 1))
    rows = same.withColumn("_copy", number).withColumn("_h", _digest(seed, "_source", key, "size", "text_crc32", "_copy")).drop("_c", "_k")
    rows = stored(rows.withColumn("_b", F.floor(_fraction("_h") * buckets).cast("int")), "rows", keep=True)
    ranked = _ranked(rows, ["_source"], "_b", ["_h"], "_rank").drop("_b")
    totals = rows.groupBy("_source").agg(F.count("*").alias("_of")).withColumn("_u", _fraction(_digest(seed, "_source")))
    ranked = ranked.join(totals, "_source").withColumn("_f", (F.col("_rank") + F.col("_u")) / F.col("_of")).withColumn("_b", F.floor(F.col("_f") * buckets * 4).cast("int"))
    placed = _ranked(ranked, [], "_b", ["_f", "_h"], "_i")
    n = rows.agg(F.count("*").alias("_all"))
    # Integer arithmetic: row i of n goes to the last shard whose first row is not after it.
    shard_of = F.expr(f"cast((_i * {shards}) div _all as int)")
    start = F.expr(f"(_shard * _all + {shards} - 1) div {shards}")
    return placed.join(F.broadcast(n)).withColumn("_shard", shard_of).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), (F.col("_i") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
