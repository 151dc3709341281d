"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` before it.  A passage is a run of lines of one level; its lines are
normalised and the whole is hashed.  Messages that hold a passage's first line hash as many of their own lines from there
on, so passages meet the messages that say all of them in a row by one join of hashes, and no line by itself links.  A
message replies to the message that most of its outermost quoted lines come from.

The result is each message without quotes, with its reply link, the root and depth of its thread, its place in the
reply-ordered conversation (threads by their root's turn, in a thread by turn, so replies follow originals), and its
formatted form.  No conversation is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

_MARK = "^(?:[ \\t]*>)+[ \\t]?"
KEY = ["conv_id", "turn"]


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " "))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds lines: array of (level, said), in order.  Null text: no lines."""
    line = F.split(F.col(text_col), "\n", -1)
    mark = lambda x: F.regexp_extract(x, _MARK, 0)
    lines = F.transform(line, lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("said")))
    return messages.withColumn("lines", F.coalesce(lines, F.array().cast("array<struct<level:int,said:string>>")))


def _passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, n (lines), c (times), h1 (of the first line), h (of all) of the quoted passages of messages."""
    q = rows.where("n_quoted > 0").groupBy(*KEY, "text").agg(F.count("*").alias("c"))
    lines = parse_quotes(q).select(*KEY, F.sha2("text", 256).alias("m"), "c", F.posexplode("lines").alias("i", "x")).select(*KEY, "m", "c", "i", "x.level", _normal(F.col("x.said")).alias("s"))
    # One message at a time: where the level changes, a new run begins.
    w = Window.partitionBy(*KEY, "m").orderBy("i")
    new = F.when(F.col("level") == F.lag("level").over(w), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w)).where("level > 0 and s != ''")
    runs = runs.groupBy(*KEY, "m", "c", "run", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("ls"))
    return runs.select(*KEY, "level", F.size("ls").alias("n"), "c", F.sha2(F.col("ls")[0], 256).alias("h1"), F.sha2(F.array_join("ls", "\n"), 256).alias("h"))


def _origins(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """conv_id, h, origin: the first turn of a conversation that says a quoted passage itself."""
    asked = passages.select("conv_id", "h1", "n").distinct()
    said = rows.select(*KEY, "own", F.sha2(F.array_join("own", "\n"), 256).alias("m"))
    places = said.select(*KEY, "m", F.posexplode("own").alias("i", "s")).select(*KEY, "m", "i", F.sha2("s", 256).alias("h1")).distinct()
    # Of all lines only those go on that some passage of the conversation begins with.
    places = places.join(asked, ["conv_id", "h1"]).groupBy(*KEY, "m").agg(F.collect_set(F.struct((F.col("i") + 1).alias("i"), "n")).alias("at"))
    found = said.dropDuplicates([*KEY, "m"]).join(places, [*KEY, "m"]).select(*KEY, "own", F.explode("at").alias("a")).where("a.i + a.n - 1 <= size(own)")
    found = found.select(*KEY, F.sha2(F.array_join(F.slice("own", F.col("a.i"), F.col("a.n")), "\n"), 256).alias("h"))
    return found.join(passages.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))


def _before(df: DataFrame, keys: list[str], order: str, block: int = 1024) -> DataFrame:
    """keys, order, before: the sum of c over smaller order values of the same keys, from rows keys, order, c.

    In two steps, by blocks of values and within them, so that no window holds a whole group.
    """
    each = df.groupBy(*keys, order).agg(F.sum("c").alias("c")).withColumn("b", F.floor(F.col(order) / block))
    past = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = each.groupBy(*keys, "b").agg(F.sum("c").alias("c")).withColumn("far", past(Window.partitionBy(*keys).orderBy("b"))).drop("c")
    near = each.withColumn("near", past(Window.partitionBy(*keys, "b").orderBy(order)))
    return near.join(blocks, [*keys, "b"]).select(*keys, order, (F.col("far") + F.col("near")).alias("before"))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rounds: int = 40) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_quoted, n_linked, reply_to, thread_root, depth, reply_order, formatted.

    body: the lines of level 0, outer blank lines removed; n_quoted: quoted lines with content; n_linked: those of
    passages found in an earlier turn's body; reply_to: the turn that most level-1 lines of such passages come from, the
    later one of a tie, null without any; thread_root and depth: the turn at the end of the reply links, and how many
    there are; reply_order: 1 and on within the conversation, by thread_root and turn; formatted: role, turn and
    reply_to as a heading, and the body.

    Null and empty texts give an empty body; rows of one conversation and turn are each kept, share their links and
    their place, and are one message as originals; a null conversation or turn links with nothing and has no place; very
    long texts are parsed whole, a message at a time; an empty table gives no rows; other columns are left out, whatever
    their names.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    parsed = parse_quotes(rows)
    plain = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["said"])
    body = F.regexp_replace(F.array_join(plain, "\n"), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    n_quoted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (_normal(x["said"]) != ""))).cast("long")
    own = F.filter(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: _normal(x["said"])), lambda x: x != "")

    # What few messages quote decides how much of the rest is looked at: written once, read several times.
    quoted = C.cut(_passages(parsed.select(*KEY, "text", n_quoted.alias("n_quoted"))), "passages")
    origins = _origins(parsed.select(*KEY, own.alias("own")), quoted)
    links = quoted.join(origins, ["conv_id", "h"]).where("origin < turn")
    lines = F.col("n") * F.col("c")
    per = links.groupBy(*KEY, "origin").agg(F.sum(lines).alias("c"), F.sum(F.when(F.col("level") == 1, lines).otherwise(0)).alias("near"))
    per = per.groupBy(*KEY).agg(F.sum("c").alias("n_linked"), F.max(F.when(F.col("near") > 0, F.struct("near", "origin")))["origin"].alias("reply_to"))
    per = C.cut(per, "replies")
    # Pointer jumping along the replies; conversations without any are not touched.
    roots = per.where("reply_to is not null").select(*KEY, F.col("reply_to").alias("thread_root"), F.lit(1).cast("long").alias("depth"))
    for _ in range(most_rounds):
        up = roots.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("above"), F.col("depth").alias("more"))
        if roots.join(up, ["conv_id", "thread_root"], "left_semi").isEmpty():
            break
        roots = C.cut(roots.join(up, ["conv_id", "thread_root"], "left").select(*KEY, F.coalesce("above", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")
    placed = rows.where("conv_id is not null and turn is not null").groupBy(*KEY).agg(F.count("*").alias("c"))
    placed = placed.join(per.join(roots, KEY, "left"), KEY, "left").select(*KEY, "c", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    placed = C.cut(placed, "placed")
    order = placed.join(_before(placed, ["conv_id"], "thread_root").withColumnRenamed("before", "far"), ["conv_id", "thread_root"]).join(_before(placed, ["conv_id", "thread_root"], "turn"), ["conv_id", "thread_root", "turn"])
    order = order.select(*KEY, "n_linked", "reply_to", "thread_root", "depth", (F.col("far") + F.col("before") + 1).alias("reply_order"))
    out = parsed.select(*KEY, "role", body.alias("body"), n_quoted.alias("n_quoted")).join(order, KEY, "left")
    head = F.concat(F.lit("["), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(" to "), F.col("reply_to").cast("string")), F.lit("")), F.lit("]\n"))
    return out.select(*KEY, "role", "body", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "reply_order", F.concat(head, "body").alias("formatted"))


def conversations(linked: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, block, n_messages, conversation: formatted messages in reply order, a row for each ``block`` places.

    Messages that share a place are ordered by their formatted text; those without a place are left out.  Equal messages
    of one place are written once with their number, so no row grows with copies.
    """
    rows = linked.where("reply_order is not null").withColumn("block", F.floor((F.col("reply_order") - 1) / block).cast("long"))
    each = rows.groupBy("conv_id", "block", "reply_order", "formatted").agg(F.count("*").alias("c"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("reply_order", "formatted", "c"))), lambda x: F.concat(x["formatted"], F.when(x["c"] > 1, F.concat(F.lit("\n("), x["c"].cast("string"), F.lit(" times)"))).otherwise("")))
    return each.groupBy("conv_id", "block").agg(F.sum("c").alias("n_messages"), F.array_join(text, "\n\n").alias("conversation"))
