"""Operator 8, chat formatting: quotation linking.

Each message is read line by line: the run of ``>`` before a line is its quote level, consecutive lines
of one level are a passage, and the rest is the author's own text. Quoted passages are normalised (case
and white space), hashed as a whole and, for lines of ``LINE_WORDS`` words or more, by line, and joined to the own
passages of the conversation's messages; the first message that holds a passage is its original. A single line that is
shorter is a stock phrase ("ok", "thanks"): it links only where it is all that a message says and all that is quoted. Links stay
within a conversation. A message replies to the latest
original among its passages of the lowest level that links, if that is an earlier turn; whole passages come before lines. Conversations are
then laid out in reply order: roots by turn, each followed by its replies, and every message loses its
quotes and the attribution lines before them.

The reply order comes from a tour of each tree, ranked by pointer doubling: every step joins each place of the
tour to one other, so neither a long chain of replies nor a message with many replies is held in one row or task.
Positions are counted over a range-partitioned order, so one conversation may hold any share of the rows.
Defined cases: null text is empty; null roles read ``unknown``; a null turn comes first and is no
original; null conversation ids form one conversation; messages repeated with one turn share its replies
and stand next to each other, by role and text; very long texts are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.storage import materialize

_QUOTE = re.compile(r"\s{0,3}((?:>\s?)+)(.*)", re.S)
_ATTRIBUTION = re.compile(r"^.{0,200}\b(wrote|writes|schrieb|a écrit|escribió)\b.{0,80}:\s*$", re.I)
#: Words of a line that is a passage by itself.
LINE_WORDS = 4
PARSED = "conv_id long, turn long, role string, own string, own_hashes array<string>, quotes array<struct<level:int,hash:string,whole:boolean>>, n_quoted long"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def passage_hash(text: str) -> str:
    return hashlib.blake2b(normalise(text).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def parse_message(text: str | None) -> tuple[str, list[str], list[tuple[int, str, bool]], int]:
    """Own text, hashes of own passages, quoted ``(level, hash, whole)`` and the number of quoted passages."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _QUOTE.fullmatch(line)
        level, body = (m[1].count(">"), m[2]) if m else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    own: list[str] = []
    quotes: dict[tuple[int, str, bool], None] = {}
    long_enough = lambda x: len(x.split()) >= LINE_WORDS
    n = 0
    for k, (level, lines) in enumerate(runs):
        if level:
            n += 1
            whole = "\n".join(lines)
            if normalise(whole):
                quotes[(level, passage_hash(whole), True)] = None
            for part in filter(long_enough, lines):
                quotes[(level, passage_hash(part), False)] = None
        else:
            if k + 1 < len(runs):
                while lines and not lines[-1].strip():
                    lines.pop()
                if lines and _ATTRIBUTION.match(lines[-1].strip()):
                    lines.pop()
            own += lines
    body = "\n".join(own).strip("\n")
    parts = {body, *filter(long_enough, [*re.split(r"\n\s*\n", body), *own])}
    hashes = sorted({passage_hash(p) for p in parts if normalise(p)})
    return body, hashes, list(quotes), n


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse_message(t) for t in b.pop("text")]
        yield b.assign(own=[x[0] for x in got], own_hashes=[x[1] for x in got], quotes=[[{"level": q[0], "hash": q[1], "whole": q[2]} for q in x[2]] for x in got], n_quoted=[x[3] for x in got])


def _numbered(df: DataFrame, label: str, *order: str) -> DataFrame:
    """``df`` with ``overall``, the place of a row in this order over the whole table."""
    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), label)
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["count"] for r in laid.groupBy(part.alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offsets = F.create_map(*[x for p, n in before.items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))]) if before else F.lit(None).cast("map<bigint,bigint>")
    return laid.withColumn("overall", F.element_at(offsets, part) + within).drop("at")


def _tour(links: DataFrame) -> DataFrame:
    """``c, t, root_turn, depth, left`` of every turn that replies or is replied to; ``left`` falls along the reply order.

    A turn is entered, then its replies are toured by turn, then it is left. Each place of the tour knows the next
    one; doubling adds up, from a place to the end of its tree, the turns entered and those still open.
    """
    key = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col(turn))
    edges = links.select("conv_id", "turn", key("turn").alias("key"), F.col("reply_to").alias("up_turn"), key("reply_to").alias("up"))
    kids = materialize(_numbered(edges, "reply-edges", "up", "turn"), "reply-kids")
    after = kids.select(F.col("up").alias("same"), (F.col("overall") - 1).alias("overall"), F.col("key").alias("sibling"))
    after = kids.select("key", "up", "overall").join(after, "overall").where("up = same").select("key", "sibling")
    first = kids.groupBy("up").agg(F.min_by("key", "overall").alias("child")).withColumnRenamed("up", "key")
    turns = kids.select("conv_id", "turn", "key").unionAll(kids.select("conv_id", F.col("up_turn").alias("turn"), F.col("up").alias("key"))).distinct()
    known = turns.join(kids.select("key", "up"), "key", "left").join(after, "key", "left").join(first, "key", "left")
    enter, leave = lambda c: F.concat(F.lit("+"), F.col(c)), lambda c: F.concat(F.lit("-"), F.col(c))
    place = lambda at, following, n, step: F.struct(at.alias("at"), following.alias("next"), F.lit(n).cast("long").alias("left"), F.lit(step).cast("long").alias("open"))
    places = F.array(place(enter("key"), F.coalesce(enter("child"), leave("key")), 1, 1), place(leave("key"), F.coalesce(enter("sibling"), leave("up")), 0, -1))
    state = materialize(known.select("conv_id", "turn", F.explode(places).alias("p"), F.col("turn").alias("root_turn")).select("conv_id", "turn", "p.*", "root_turn"), "reply-tour")
    while not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"), F.col("open").alias("open2"), F.col("root_turn").alias("root2"))
        moved = state.where("next IS NOT NULL").join(ahead, "next")
        moved = moved.select("conv_id", "turn", "at", F.col("next2").alias("next"), (F.col("left") + F.col("left2")).alias("left"), (F.col("open") + F.col("open2")).alias("open"), F.col("root2").alias("root_turn"))
        state = materialize(state.where("next IS NULL").unionByName(moved), "reply-tour")
    entered = state.where(F.col("at").startswith("+"))
    return entered.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "root_turn", (-F.col("open")).alias("depth"), "left")


def reply_order(messages: DataFrame) -> DataFrame:
    """Per message: ``conv_id, turn, role, reply_to, root_turn, depth, position, n_quoted, n_linked, message``."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.col("text").cast("string").alias("text")
    )
    narrow = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text")
    parsed = narrow.mapInPandas(_parse, PARSED.replace("conv_id long, turn long", "conv_id string, turn string"))
    parsed = materialize(parsed.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}), "parsed-messages")
    quoted = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.whole").distinct()
    originals = (
        parsed.where("turn IS NOT NULL").select("conv_id", "turn", F.explode("own_hashes").alias("hash"))
        .groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).withColumnRenamed("conv_id", "c").withColumnRenamed("hash", "h")
    )
    met = quoted.join(originals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("origin") < F.col("turn")))
    links = materialize(
        met.groupBy("conv_id", "turn", "level", "whole").agg(F.max("origin").alias("origin"), F.count(F.lit(1)).alias("n"))
        .groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("level", ~F.col("whole"))).alias("reply_to"), F.sum("n").alias("n_linked")),
        "reply-links",
    )
    replies = links.withColumnsRenamed({"conv_id": "c2", "turn": "t2"})
    tour = _tour(links).join(replies, F.col("c").eqNullSafe(F.col("c2")) & (F.col("t") == F.col("t2")), "left").drop("c2", "t2")
    laid = parsed.join(tour, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id", "turn", "role", "own", "reply_to", "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), (-F.coalesce("left", F.lit(0).cast("long"))).alias("rank"),
    )
    numbered = _numbered(laid, "reply-order", "conv_id", "root_turn", "rank", "role", "own")
    first = numbered.groupBy("conv_id").agg(F.min("overall").alias("first")).withColumnRenamed("conv_id", "c")
    text = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"))
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "turn", "role", "reply_to", "root_turn", "depth",
        (F.col("overall") - F.col("first")).alias("position"), "n_quoted", "n_linked", text.alias("message"),
    )


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Query: every message in its place in the reply order of its conversation."""
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
