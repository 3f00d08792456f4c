"""Records of one large JSON text, read in parts by many tasks.

The text is cut behind each closing brace by Spark's own reader of lines, which splits files. Whether
a piece starts inside a string, and how deep, follows from all pieces before it: each piece tells how many
quotes it has and how the depth changes for either start; these are summed inside the blocks of a file and then
over blocks, of which there is one row for each split. A record is the pieces up to the one that ends
at the depth of its list. No task holds more than a split or a record.

Escapes never cross a cut, as no escape has a brace. Results for special texts: blanks around
anything and braces, brackets and quotes inside strings are as in the whole text; a list without elements or
an empty file gives no rows; elements that are not objects are an error; of a text that is cut off the whole
records are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.sources.scratch import stored

ROW = 1 << 33  # rows of a task, by monotonically_increasing_id
STRING = r'"(?:[^"\\]++|(?s:\\.))*+"'


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _change(text: Column) -> Column:
    """By how much the depth changes in a text without escapes that starts outside strings."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    return _count(bare, "{[") - _count(bare, "}]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, k, value, quotes, if_out, if_in): the pieces in order k of their block, with the quotes
    before and the change of depth before, for a block that starts outside or inside a string."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.monotonically_increasing_id() % ROW).alias("k"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    raw = raw.withColumns({"own": _count(plain, '"'), "out": _change(plain), "ins": _change(F.concat(F.lit('"'), plain))})
    odd = F.col("own") % 2
    raw = raw.withColumns({"out": F.col("out") - F.when(odd == 0, 1).otherwise(0), "ins": F.col("ins") - F.when(odd == 1, 1).otherwise(0)})  # the brace behind it
    block = W.partitionBy("file", "block").orderBy("k")
    before = block.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    raw = raw.withColumn("quotes", zero("own"))
    swapped = F.col("quotes") % 2 == 1
    raw = raw.withColumns({"out": F.when(swapped, F.col("ins")).otherwise(F.col("out")), "ins": F.when(swapped, F.col("out")).otherwise(F.col("ins"))})
    return raw.withColumns({"if_out": zero("out"), "if_in": zero("ins")})


def _blocks(rows: DataFrame, *aggs: Column) -> DataFrame:
    return rows.groupBy("file", "block").agg(*aggs)


def records(spark: SparkSession, path: str, depth: Column, key: str | None = None) -> DataFrame:
    """(line, record): the objects, as JSON, of lists at a depth, in the order `line`. depth is a column over
    `head`, the text before the first closing brace: 1 for a list, 2 for the lists of an object; 0 gives
    nothing. With a key only the lists of that name are read where the depth is not 1."""
    rows = stored(_pieces(spark, path), "pieces")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    blocks = _blocks(rows, F.sum("own").alias("own_b"), F.sum("out").alias("out_b"), F.sum("ins").alias("in_b"), F.min_by("value", "k").alias("head"))
    blocks = blocks.withColumn("head", F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    blocks = blocks.withColumn("inside", zero("own_b") % 2 == 1)
    blocks = blocks.withColumn("start", zero(F.when(F.col("inside"), F.col("in_b")).otherwise(F.col("out_b"))))
    blocks = blocks.withColumns({"base": depth, "number": F.row_number().over(W.partitionBy(F.lit(0)).orderBy("file", "block")).cast("long")})
    rows = rows.join(F.broadcast(blocks.select("file", "block", "inside", "start", "base", "number")), ["file", "block"]).where("base > 0")
    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    rows = rows.withColumns({"deep": F.col("start") + pick("if_out", "if_in"), "quoted": (F.col("quotes") + F.col("inside").cast("int")) % 2 == 1})
    rows = rows.withColumns({"left": F.col("deep") + pick("out", "ins"), "open": (F.col("quotes") + F.col("own") + F.col("inside").cast("int")) % 2 == 1})
    rows = rows.select("file", "block", "number", "base", "value", "left", ((F.col("number") * ROW) + F.col("k")).alias("line"), (~F.col("open") & (F.col("left") <= F.col("base"))).cast("long").alias("ends"), (~F.col("quoted") & (F.col("deep") <= F.col("base"))).alias("first"))
    # What stands before a record: the start of a list that is read (1), of others (0), or a comma.
    name = rf'"{key}"' if key else STRING
    listed = rf'(?s)^[^"{{]*+\{{?(?:[^"{{]++|{STRING}|(?<=:)\s*\{{)*?{name}\s*+:\s*+\[\s*+\{{'
    top, comma, other = r"^\s*+\[\s*+\{", r"^\s*+,\s*+\{", r"^\s*+[\[,]\s*+(?:[^\s\"{\]]|\"[^\"]*+\"\s*+[,\]])"
    v = F.col("value")
    bad = F.raise_error(F.concat(F.lit("a list with elements that are not objects: "), F.substring("value", 1, 60))).cast("int")
    mark = F.when(~F.col("first") | v.rlike(comma), None).when((F.col("base") == 1) & v.rlike(top), 1).when((F.col("base") == F.col("left")) & v.rlike(other), bad)
    mark = mark.when(F.col("base") > 1, v.rlike(listed).cast("int")).otherwise(0)
    rows = stored(rows.withColumn("mark", mark), "marks")
    inside = W.partitionBy("file", "block").orderBy("line")
    ended = _blocks(rows, F.sum("ends").alias("n"), F.last("number").alias("number"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line"))).alias("last"))
    ended = ended.select("file", "block", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("groups"), F.last("last", True).over(before).alias("list"))
    rows = rows.join(F.broadcast(ended), ["file", "block"])
    group = F.col("groups") + F.coalesce(F.sum("ends").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"group": group, "list": F.coalesce(F.last("mark", True).over(inside), F.col("list"))})
    whole = rows.groupBy("file", "group").agg(
        F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"), F.max("ends").alias("ends"), F.min_by("list", "line").alias("list"), F.max_by("left", "line").alias("left"), F.first("base").alias("base"),
    ).where("ends = 1 AND list = 1 AND left = base")
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    front = F.when(text.rlike(comma), F.regexp_replace(text, comma, "{")).when(F.col("base") == 1, F.regexp_replace(text, top, "{")).otherwise(F.regexp_replace(text, listed, "{"))
    return whole.select("line", front.alias("record"))
