"""Chat formatting by quotation linking, with DataFrame functions only.

Each message's lines get a quote level from their leading ``>`` marks. Runs of lines of one level are passages; passages and
their lines are normalised (white space, case of A-Z) and hashed, and so are each message's own text, paragraphs and lines.
A quoted hash is joined to the first message of its conversation that said it; a message replies to the one that it quotes
most of, at its outermost linked level. Quotes (and the lines that announce them) are then taken out, and messages are put
in reply order: threads by their first message, each reply after what it answers.

Origins are the least turn of each (conversation, hash), by partial aggregation, so a passage that everyone repeats is one
row to join with; roots and depths follow by pointer doubling. No conversation is ever gathered into one row or task.

Defined results: a null text is an empty one; a message that quotes nothing known is the root of a thread; messages with a
null conv_id or turn link with nothing; repeated rows are kept, and messages of one conv_id and turn share what they reply
to; quotes of fewer than ``least`` normalised characters count only in messages with no longer one that links; an empty table gives an empty frame; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, let, lookup

ANNOUNCED = r"(?:wrote|writes|said|schrieb|escribi\x{f3}|a \x{e9}crit)[ \t]*:[ \t\r]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    """Each line's quote level, its text without marks, and its normalised text."""

    def parsed(line):
        marks = F.when(line.rlike(r"^[ \t]*>"), F.regexp_extract(line, r"^[> \t]*", 0)).otherwise("")
        body = F.substr(line, F.length(marks) + 1)
        norm = F.translate(F.trim(F.regexp_replace(body, r"[ \t\r]+", " ")), UPPER, LOWER)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), line.alias("line"), norm.alias("norm"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), parsed)
    # a line that announces the quote below it belongs to the quote
    told = lambda ls, x, i: (x["level"] == 0) & x["line"].rlike(ANNOUNCED) & (F.coalesce(F.get(ls, i + 1)["level"], F.lit(0)) > 0)
    return let(lines, lambda ls: F.filter(ls, lambda x, i: ~told(ls, x, i)))


def _runs(lines: Column) -> Column:
    """Maximal runs of lines of one level (blank lines end a run): level and normalised text."""

    def cut(ls, ks, starts):
        text = lambda a, k: F.array_join(F.transform(F.slice(ls, a + 1, F.coalesce(F.get(starts, k + 1), F.size(ls)) - a), lambda x: x["norm"]), " ")
        return F.filter(F.transform(starts, lambda a, k: F.struct(F.get(ks, a).alias("level"), text(a, k).alias("text"))), lambda r: r["level"] >= 0)

    def starts(ks):
        begins = lambda i: (i < F.size(ks)) & ((i == 0) | (F.get(ks, i) != F.get(ks, i - 1)))
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(ks) - 1, F.lit(0))), begins)

    levels = lambda ls: F.transform(ls, lambda x: F.when(x["norm"] == "", -1).otherwise(x["level"]))
    return let(lines, lambda ls: let(levels(ls), lambda ks: let(starts(ks), lambda st: cut(ls, ks, st))))


def _marked(units: Column) -> Column:
    """(level, hash, chars) of each of an array of texts, blank ones left out."""
    return F.transform(F.filter(units, lambda u: u["text"] != ""), lambda u: F.struct(u["level"].alias("level"), F.unhex(F.md5(u["text"].cast("binary"))).alias("hash"), F.length(u["text"]).alias("chars")))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, n_quotes, quoted, own): the hashes of quoted passages and lines, and of own texts,
    paragraphs and lines. Each message is parsed here once, so the result should be saved."""
    lines = _lines(F.col("text"))

    def told(ls, runs):
        own = F.array_join(F.transform(F.filter(ls, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
        unit = lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("text"))
        at = lambda xs, quoted: F.filter(xs, (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0))
        whole = F.struct(F.lit(0).alias("level"), F.array_join(F.transform(at(runs, False), lambda r: r["text"]), " ").alias("text"))
        return F.struct(
            F.regexp_replace(own, r"^[ \t\r\n]++|(?<![ \t\r\n])[ \t\r\n]++$", "").alias("content"),
            F.size(at(runs, True)).cast("long").alias("n_quotes"),
            _marked(F.concat(at(runs, True), F.transform(at(ls, True), unit))).alias("quoted"),
            _marked(F.concat(at(runs, False), F.transform(at(ls, False), unit), F.array(whole))).alias("own"),
        )

    both = let(lines, lambda ls: let(_runs(ls), lambda runs: told(ls, runs)))
    return messages.select("conv_id", "turn", "role", both.alias("m")).select("conv_id", "turn", "role", "m.*")


def _units(rows: DataFrame, column: str) -> DataFrame:
    """(conv_id, turn, level, hash, chars) of an array of units; messages without a place in a conversation have none."""
    out = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(column).alias("u"))
    return out.select("conv_id", "turn", "u.level", "u.hash", "u.chars")


def replies(rows: DataFrame, scratch: Scratch, least: int = 12) -> DataFrame:
    """(conv_id, turn, reply_to) of messages that quote an earlier one; ``rows`` are a saved table.

    A conversation or a passage that has a large share of all messages or quotes is met by a broadcast (``lookup``).
    """
    quoting = rows.where("n_quotes > 0")
    quotes = scratch.save(_units(quoting, "quoted").withColumn("key", F.struct("conv_id", "hash")), "quotes")
    talks = quoting.select("conv_id").distinct().withColumn("talks", F.lit(True))
    talked = lookup(rows.select("conv_id", "turn", "own"), talks, "conv_id").where("talks")
    origins = _units(talked, "own").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    linked = lookup(quotes, origins.select(F.struct("conv_id", "hash").alias("key"), "origin"), "key").where("origin < turn").drop("key").distinct()
    votes = linked.groupBy("conv_id", "turn", (F.col("chars") >= least).alias("long"), "level", "origin").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("long", -F.col("level"), "chars", "origin")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.origin").alias("reply_to"))


def _threads(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, reply_to, root, depth): pointers are doubled until none moves; each round is written."""
    now = scratch.save(parents.withColumn("root", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), "threads0")
    k = 0
    while True:
        ahead = now.select(F.struct("conv_id", F.col("turn").alias("root")).alias("key"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = lookup(now.withColumn("key", F.struct("conv_id", "root")), ahead, "key")
        if step.where("next is not null").limit(1).isEmpty():
            return now
        k += 1
        now = scratch.save(step.select("conv_id", "turn", "reply_to", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"threads{k}")


def format_chats(messages: DataFrame, least: int = 12) -> DataFrame:
    """(conv_id, root, depth, turn, role, reply_to, n_quotes, content, message): one row for each message, in reply order."""
    scratch = Scratch(messages.sparkSession, "chat")
    rows = scratch.save(parsed(messages), "parsed")
    threads = _threads(replies(rows, scratch, least), scratch)
    out = rows.select("conv_id", "turn", "role", "n_quotes", "content").join(threads, ["conv_id", "turn"], "left")
    message = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>"))
    out = out.select("conv_id", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "turn", "role", "reply_to", "n_quotes", "content", message.alias("message"))
    return out.orderBy("conv_id", "root", "turn")
