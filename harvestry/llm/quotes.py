"""Quotation linking: reply-ordered conversations without quotes.

Lines that begin with > are quotes; the number of marks is their level. Every
line is normalised and hashed. A quoted line is joined to the latest earlier
message of its conversation that has the line as its own text; the message
that most lines of level 1 lead to is the one that is answered. Following the
answers gives each message its thread and depth. All of it are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, without, written

_MARKS = r"^(?:[ \t]*>)+"
#: Turns of one key that meet in a task while the latest earlier one is found.
SPAN = 1024


def levels(text: Column) -> Column:
    """The lines of a text as array of struct(level, body)."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.struct(F.length(F.regexp_replace(marks(line), r"[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS + r"[ \t]?", "").alias("body")))


def normalised(body: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    lower = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, r"[ \t\r\x0B\f]+", " "), r"^ | $", "")


def _sources(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted (conv, turn, level, line) with ``source``: the latest earlier
    turn of the conversation with that line of its own.

    Both sides are put in order of turns by stretches of SPAN turns; a line
    without a source in its stretch takes the last one of the stretches before.
    So a line that a conversation repeats without end is cut into stretches.
    """
    asked = own.join(quoted.select("conv", "line").distinct(), ["conv", "line"], "left_semi").distinct()
    cut = F.floor(F.col("turn") / SPAN).alias("span")
    both = asked.select("conv", "line", cut, "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("source")).unionByName(
        quoted.select("conv", "line", cut, "turn", "level", F.lit(None).cast("long").alias("source")).distinct()
    )
    inside = W.partitionBy("conv", "line", "span").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("source").over(inside)).filter(F.col("level").isNotNull())
    spans = both.groupBy("conv", "line", "span").agg(F.max("source").alias("last"))
    before = W.partitionBy("conv", "line").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    earlier = spans.withColumn("earlier", F.max("last").over(before)).select("conv", "line", "span", "earlier")
    return near.join(earlier, ["conv", "line", "span"]).select("conv", "turn", "level", "line", F.coalesce("near", "earlier").alias("source"))


def link(messages: DataFrame) -> DataFrame:
    """Every message (conv_id, turn, role, text and other columns), its text
    without quoted lines, with n_quoted (quoted lines that aren't blank),
    n_linked (those whose source was found), ``parent_turn`` (the message it
    answers; else null), ``thread_turn`` (the first message of its chain of
    answers) and ``depth`` (answers up to there). In the order of conv_id,
    thread_turn, depth and turn every message follows the one it answers.

    Of equally good parents the latest is taken. Null texts count as empty. A
    message without conversation or turn is its own thread, with both null or
    as they are. Rows of equal conv_id and turn are one message for links and
    keep their own texts. A line that no earlier message has leads nowhere. An
    empty table gives an empty result. Input columns with the names of results
    are replaced. Threads are found by doubling: each round a message takes
    over how far its ancestor has come, so rounds grow with the logarithm of
    the longest chain. Messages are never gathered by conversation.
    """
    results = ["n_quoted", "n_linked", "parent_turn", "thread_turn", "depth"]
    own = without(messages, results)
    lines = own.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.explode(levels(F.col("text"))).alias("l"))
    hashed = lines.withColumn("body", normalised(F.col("l.body"))).filter((F.col("body") != "") & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    keyed = hashed.select("conv", "turn", F.col("l.level").alias("level"), F.xxhash64("body").alias("line"))
    quoted = written(keyed.filter("level > 0"))
    found = written(_sources(keyed.filter("level = 0").select("conv", "turn", "line"), quoted))

    votes = found.filter((F.col("level") == 1) & F.col("source").isNotNull()).groupBy("conv", "turn", "source").agg(F.count(F.lit(1)).alias("n"))
    parents = written(votes.groupBy("conv", "turn").agg(F.max(F.struct("n", "source")).alias("best")).select("conv", "turn", F.col("best.source").alias("parent")))
    counts = found.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"))

    # Chains that have come to their first message stand aside.
    open_ = parents.select("conv", "turn", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"))
    state, ended = open_, None
    while True:
        ahead = state.select("conv", F.col("turn").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = open_.join(ahead, ["conv", "at"], "left").select("conv", "turn", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        step = written(moved)
        fresh = step.filter(~F.col("moved")).drop("moved")
        ended = fresh if ended is None else ended.union(fresh)
        open_ = step.filter("moved").drop("moved")
        state = ended.union(open_)
        if open_.isEmpty():
            break
    links = parents.join(counts, ["conv", "turn"], "full").join(state.select("conv", "turn", "at", "depth"), ["conv", "turn"], "left")
    links = links.select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), "parent", "n_quoted", "n_linked", "at", F.col("depth").alias("__depth"))
    kept = F.array_join(F.transform(F.filter(levels(F.col("text")), lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    joined = own.join(links, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    plain = [kept.alias(c) if c.lower() == "text" else column(c) for c in own.columns]
    none = F.lit(0).cast("long")
    return joined.select(
        *plain,
        F.coalesce("n_quoted", none).alias("n_quoted"),
        F.coalesce("n_linked", none).alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce(F.col("at"), F.col("turn").cast("long")).alias("thread_turn"),
        F.coalesce("__depth", none).alias("depth"),
    )
