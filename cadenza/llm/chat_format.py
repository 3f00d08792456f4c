"""Chat formatting by quotation linking, in DataFrame functions alone.

A line that starts with n marks `>` is quoted at level n. Neighbouring lines of a
level form a quoted passage; its normalised text (lower case, letters and digits) and
that of each of its lines are hashed and joined to the hashes of what messages
themselves say: first to the nearest earlier message of the same conversation, else to
the first message that says so anywhere, if its conversation has a lesser conv_id than the
quote's (a quotation from a conversation with a greater conv_id is not linked, so that
links form no ring). The message that most of a passage comes from
is its original; a message replies to the original of its lowest quoted level. Quotes and
the lines that announce them are taken out.

The links make trees. Each is walked around once (into a message, around what replies to
it in order of turns, out again); the steps of all walks are a linked list, whose sums are
found by pointer doubling: that gives each message its place behind the one that it
replies to, its depth and its root, in a number of rounds that grows with the logarithm
of the tree and rows that grow with its messages. Other messages keep their turn.

Joins on hashes never pair all that share one: within a conversation the last earlier
original is carried along, and elsewhere one message stands for a hash. What has an order
(sayings of a line in a conversation, replies to a message, messages of a conversation) is
dealt by ranges of that order and put together over the ranges, so neither a long
conversation nor a message with very many replies is one task's.

Results for special inputs: a null text is empty; messages without a conv_id are one
conversation; a null turn comes first; messages of equal turn are ordered by a hash of role
and text; a quotation of nothing known leaves its message in its turn; equal rows are
messages of their own, in arbitrary order among each other; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, stored, temporary_tables

MARKS = r"^((?:[ \t]*>)+)"
ANNOUNCED = r"(?i)^(on\b.*wrote:|.* (wrote|writes|said):|-+ ?original message ?-+)$"
PLACE = ["turn", "tie", "mid"]  # the order of a conversation's messages


def normal_hash(text: Column) -> Column:
    """A hash of the letters and digits of a text; null if it has none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.unhex(F.md5(plain.cast("binary"))))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their lines as (i, level, body) and what they say themselves."""
    line = lambda l, i: F.struct(
        i.alias("i"),
        F.length(F.regexp_replace(F.regexp_extract(l, MARKS, 1), "[^>]", "")).alias("level"),
        F.trim(F.regexp_replace(l, MARKS, "")).alias("body"),
    )
    df = messages.withColumn("lines", F.transform(F.split("text", r"\r?\n"), line))
    announced = lambda x, i: (x["level"] == 0) & x["body"].rlike(ANNOUNCED) & (F.get("lines", i + 1)["level"] > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~F.coalesce(announced(x, i), F.lit(False)))
    df = df.withColumn("quotes", F.exists("lines", lambda x: x["level"] > 0)).withColumn("own", F.transform(own, lambda x: x["body"]))
    return df.withColumn("content", F.when(F.col("quotes"), F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text")))


def _ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df, stored, dealt by ranges of an order; `range` numbers them."""
    return stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)


def _earlier(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """For each range of keys what all earlier ranges of these keys sum up to, or the last
    of it. df: (*keys, range, x), few rows for each of the keys."""
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return df.select(*keys, "range", value.over(before).alias("x"))


def passages(messages: DataFrame) -> DataFrame:
    """(mid, conv, c, turn, tie, level, run, hash, weight) of quoted passages and their lines."""
    own = ["mid", "conv", "c", "turn", "tie"]
    lines = messages.where("quotes").select(*own, F.explode("lines").alias("x")).select(*own, "x.*").where("level > 0")
    run = F.col("i") - F.row_number().over(W.partitionBy("mid", "level").orderBy("i"))
    lines = lines.withColumn("run", run)
    whole = lines.groupBy(*own, "level", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n").alias("body"))
    units = whole.unionByName(lines.drop("i"))
    return units.select(*own, "level", "run", normal_hash(F.col("body")).alias("hash"), F.length("body").alias("weight")).where("hash IS NOT NULL")


def _sayings(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(mid, conv, c, turn, tie, hash) of what messages say themselves and someone quotes."""
    said = messages.select("mid", "conv", "c", "turn", "tie", F.explode(F.array_distinct(F.concat(F.array("content"), "own"))).alias("body"))
    said = stored(said.withColumn("hash", normal_hash(F.col("body"))).where("hash IS NOT NULL").drop("body"), "said")
    wanted = stored(said.groupBy("hash").agg(F.count("*").alias("f")).join(quoted.select("hash").distinct(), "hash"), "wanted")
    return stored(join_counted(said, wanted, "hash", "f", wanted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]).drop("f"), "sayings")


def links(messages: DataFrame) -> DataFrame:
    """(mid, parent, up_c, up_turn): the message that each quoting message replies to."""
    quoted = stored(passages(messages), "quoted")
    said = _sayings(messages, quoted)
    origin = F.struct("turn", "tie", "mid", "c")
    both = quoted.withColumn("origin", F.lit(None).cast("struct<turn:bigint,tie:bigint,mid:bigint,c:bigint>")).unionByName(said.withColumns({"level": F.lit(0), "origin": origin}), allowMissingColumns=True)
    # Quotes come before what their own message says, so a message never finds itself.
    both = _ranged(both.withColumn("back", -F.col("level")), "both", "conv", "hash", *PLACE, "back")
    inside = W.partitionBy("conv", "hash", "range").orderBy(*PLACE, "back").rowsBetween(W.unboundedPreceding, -1)
    last = _earlier(both.groupBy("conv", "hash", "range").agg(F.max("origin").alias("x")), ["conv", "hash"], F.last("x", ignorenulls=True))
    near = both.withColumn("origin", F.when(F.col("level") > 0, F.last("origin", ignorenulls=True).over(inside))).where("level > 0")
    near = stored(near.join(last, ["conv", "hash", "range"]).withColumn("origin", F.coalesce("origin", "x")).drop("x", "range", "back"), "near")
    # From elsewhere only what an earlier conversation says, so links form no ring.
    lost = near.where("origin IS NULL").drop("origin")
    first = said.groupBy("hash").agg(F.min(F.struct("c", "turn", "tie", "mid")).alias("first"))
    first = stored(first.join(lost.groupBy("hash").agg(F.count("*").alias("f")), "hash"), "first")
    far = join_counted(lost, first, "hash", "f", lost.count()).where("first.c < c").withColumn("origin", F.struct(*(F.col(f"first.{x}").alias(x) for x in (*PLACE, "c"))))
    columns = ["mid", "level", "run", "origin", "weight"]
    found = near.where("origin IS NOT NULL").select(*columns).unionByName(far.select(*columns))
    scored = found.groupBy("mid", "level", "run", "origin").agg(F.sum("weight").alias("weight"))
    best = scored.groupBy("mid").agg(F.max_by("origin", F.struct(-F.col("level"), "weight", "origin")).alias("origin"))
    return best.select("mid", F.col("origin.mid").alias("parent"), F.col("origin.c").alias("up_c"), F.col("origin.turn").alias("up_turn"))


def _walks(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """(mid, left, depth, root) of all messages in trees: left is the number of messages from
    this one on to the end of the walk around its tree."""
    child = _ranged(replies.select("mid", "parent").join(messages.select(*PLACE), "mid"), "children", "parent", *PLACE)
    inside = W.partitionBy("parent", "range").orderBy(*PLACE)
    heads = child.groupBy("parent", "range").agg(F.min_by("mid", F.struct(*PLACE)).alias("x"))
    after = heads.select("parent", "range", F.lead("x").over(W.partitionBy("parent").orderBy("range")).alias("x"))
    child = stored(child.withColumn("next", F.lead("mid").over(inside)).join(after, ["parent", "range"]).select("mid", "parent", F.coalesce("next", "x").alias("next")), "siblings")
    first = heads.groupBy("parent").agg(F.min_by("x", "range").alias("first"))
    nodes = child.select("mid").unionByName(child.select(F.col("parent").alias("mid"))).distinct()
    nodes = nodes.join(child, "mid", "left").join(first.withColumnRenamed("parent", "mid"), "mid", "left")
    # Step 2 mid leads into a message, 2 mid + 1 out of it.
    into = F.struct((F.col("mid") * 2).alias("step"), F.coalesce(F.col("first") * 2, F.col("mid") * 2 + 1).alias("to"), F.lit(1).alias("left"), F.lit(1).alias("depth"))
    out = F.struct((F.col("mid") * 2 + 1).alias("step"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).alias("left"), F.lit(-1).alias("depth"))
    now = nodes.select(F.explode(F.array(into, out)).alias("x")).select("x.step", "x.to", F.col("x.left").cast("long").alias("left"), F.col("x.depth").cast("long").alias("depth"), F.col("x.step").alias("end"))
    now = stored(now, "walks")
    while not now.where("to IS NOT NULL").isEmpty():
        ahead = now.select(F.col("step").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"), F.col("depth").alias("depth2"), F.col("end").alias("end2"))
        went = now.where("to IS NOT NULL").join(ahead, "to").select("step", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("end2").alias("end"))
        now = stored(went.unionByName(now.where("to IS NULL")), "walks")
    # What is left sums to minus the depth, as a whole walk sums to 0.
    return now.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("mid"), "left", (-F.col("depth")).alias("depth"), F.floor(F.col("end") / 2).cast("long").alias("root"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each message, without its quotes: its conversation (its root's), its
    place there in reply order, what it replies to, and the formatted turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    with temporary_tables(conversations.sparkSession):
        return _format(rows)


def _format(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"conv": F.coalesce(F.concat(F.lit("="), "conv_id"), F.lit("null")), "c": F.coalesce("conv_id", F.lit(-(2**63))), "tie": F.xxhash64("role", "text")})
    rows = stored(rows.withColumn("mid", F.monotonically_increasing_id()), "messages", keep=True)
    messages = parsed(rows)
    replies = stored(links(messages), "replies")
    walks = stored(_walks(rows, replies), "trees")
    own = ["conv", "conv_id", "turn", "tie"]
    roots = walks.where("mid = root").select("root", F.col("left").alias("f")).join(rows.select(F.col("mid").alias("root"), *(F.col(n).alias(f"root_{n}") for n in own)), "root")
    trees = join_counted(walks, stored(roots, "roots"), "root", "f", walks.count()).drop("f")
    at = rows.select("mid", *own).join(trees, "mid", "left").join(replies, "mid", "left")
    alone = F.col("root").isNull()
    at = at.withColumns({f"root_{n}": F.when(alone, F.col(n)).otherwise(F.col(f"root_{n}")) for n in own} | {"root": F.coalesce("root", "mid"), "behind": -F.coalesce("left", F.lit(1))})
    order = ["root_turn", "root_tie", "root", "behind"]
    at = _ranged(at.select("mid", "root_conv", "root_conv_id", "depth", "up_c", "up_turn", *order), "placed", "root_conv", *order)
    before = _earlier(at.groupBy("root_conv", "range").agg(F.count("*").alias("x")), ["root_conv"], F.sum("x"))
    inside = F.row_number().over(W.partitionBy("root_conv", "range").orderBy(*order))
    placed = at.join(before, ["root_conv", "range"]).withColumn("position", F.coalesce("x", F.lit(0)) + inside - 1)
    placed = stored(placed.select("mid", "root_conv_id", "position", "depth", "up_c", "up_turn"), "positions", keep=True)
    up = F.when(F.col("up_c") != -(2**63), F.col("up_c"))
    return messages.join(placed, "mid").select(
        F.col("root_conv_id").alias("conv_id"), F.col("conv_id").alias("source_conv_id"), "turn", F.col("position").cast("long").alias("position"), "role",
        up.alias("reply_to_conv"), F.col("up_turn").alias("reply_to_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"), "content",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content").alias("formatted"),
    )
