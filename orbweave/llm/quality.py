"""Operator 1, quality rules: a short-circuit cascade ordered by rejection per cost.

A rule is a Boolean column over *values* of a text (its words, its lines, the hashes of its word windows, the
counts over them), and says which of them it needs. ``plan_cascade`` draws a bounded sample, writes it to the shared folder, times
every rule on it (a warm-up, then the least of ``REPEATS`` runs, less the time of a bare scan), measures the share it rejects, and orders
the rules by rejections per second. ``verdict`` evaluates them in that order and stops at the first rejection: a value is worked
out where the first rule that needs it is reached, once, and not at all for rows that a rule before it rejects. The order
changes the work and never the verdict.

``quality_metrics`` owes the base counts of every row, so the rules on them cost nothing more; what its cascade
saves are the further values, which only rows that pass the rules before get. All of it is built-in column functions.

The sample: at most ``SAMPLE_ROWS`` rows, drawn by chance from the whole table with a fixed seed. Defined cases: a null or
empty text has no words and is rejected as too short; null ids and repeated rows are kept as they are, each judged alone; rules of equal
rank keep their listed order; very long texts are judged whole; an empty table gives an empty result, with the rules as listed. Extra
input columns, whatever their names, are ignored by ``quality_metrics`` and passed through by ``quality_filter``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.storage import materialize

#: Rows on which costs and selectivities are estimated, at most, and timed runs of each rule.
SAMPLE_ROWS = 400
REPEATS = 3
#: Fixed values of the contract: white space that ends a word, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Thresholds of the further rules: symbols per hundred words, repeated lines per hundred, word length, letters per hundred word characters.
MAX_SYMBOLS_PERCENT = 30
MAX_DUP_LINES_PERCENT = 50
WORD_LENGTH = (2, 14)
MIN_LETTERS_PERCENT = 50


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    bare = F.btrim(_text(text), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(_text(text), SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), SYMBOLS, ""))).cast("long")


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), r"\P{L}+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def windows(tokens: Column) -> Column:
    """Hashes of the three-word windows, in order."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3),
        lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return F.when(F.size(tokens) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered_words(tokens: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more. Where hashes meet, the words are compared; where all differ, nothing is sorted."""

    def covered(tagged: Column) -> Column:
        """``tagged`` is sorted by hash, then words: a window occurs twice if a neighbour has its words."""
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        near = F.transform(
            tagged,
            lambda x, i: F.when(same(x, F.get(tagged, i + 1)) | same(x, F.get(tagged, i - 1)), F.array(x["i"], x["i"] + 1, x["i"] + 2)),
        )
        return F.size(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))

    def counted(own: Column) -> Column:
        word = lambda i, name: F.get(tokens, i).alias(name)
        tagged = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), word(i, "a"), word(i + 1, "b"), word(i + 2, "c"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(let(tagged, covered))

    return let(hashes, counted).cast("long")


#: How each value comes from others; ``text`` is given. Values without an entry are columns of the table.
VALUES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "words": (("text",), words),
    "lines": (("text",), lines_with_words),
    "n_words": (("words",), lambda own: F.size(own).cast("long")),
    "word_chars": (("text",), word_chars),
    "n_symbols": (("text",), n_symbols),
    "n_lines": (("lines",), lambda own: F.size(own).cast("long")),
    "n_dup_lines": (("lines",), n_dup_lines),
    "n_repeat_words": (("words",), lambda own: covered_words(own, windows(own))),
    "n_letters": (("text",), n_letters),
}


@dataclass(frozen=True)
class Rule:
    """A named rejection: the values that it needs, and the condition over them."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


RULES = (
    Rule("too_few_words", ("n_words",), lambda n: n < MIN_WORDS),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > MAX_REPEAT_PERCENT * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > MAX_SYMBOLS_PERCENT * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > MAX_DUP_LINES_PERCENT * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < WORD_LENGTH[0] * n) | (c > WORD_LENGTH[1] * n)),
    Rule("few_letters", ("n_letters", "word_chars"), lambda k, c: 100 * k < MIN_LETTERS_PERCENT * c),
)
#: The contract's own failures; the rest is the method's.
BASE_RULES = RULES[:2]


def _with(name: str, known: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` where ``name`` is known, worked out here if it isn't, after what it comes from."""
    if name in known:
        return body(known)
    needs, make = VALUES[name]

    def after(known: dict[str, Column], rest: tuple[str, ...]) -> Column:
        if rest:
            return _with(rest[0], known, lambda more: after(more, rest[1:]))
        return let(make(*[known[n] for n in needs]), lambda value: body(known | {name: value}))

    return after(known, needs)


def verdict(rules: list[Rule], known: dict[str, Column]) -> Column:
    """True where no rule rejects; later rules, and the values that they alone need, are worked out only for rows that earlier ones pass."""
    if not rules:
        return F.lit(True)
    first, rest = rules[0], rules[1:]

    def judged(known: dict[str, Column], missing: tuple[str, ...]) -> Column:
        if missing:
            return _with(missing[0], known, lambda more: judged(more, missing[1:]))
        return F.when(first.rejects(*[known[n] for n in first.needs]), F.lit(False)).otherwise(verdict(rest, known))

    return judged(known, first.needs)


def draw_sample(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """``text`` of at most ``rows`` rows, drawn by chance from the whole table and written to the shared folder."""
    total = docs.count()
    share = min(1.0, 2 * rows / total) if total else 1.0
    return materialize(docs.select(F.col(text_col).cast("string").alias("text")).sample(False, share, seed=11).limit(rows), "quality-sample")


def measure(sample: DataFrame, rules: tuple[Rule, ...], given: tuple[str, ...] = ()) -> dict[str, tuple[float, float]]:
    """Per rule: seconds over the sample, and the share it rejects. ``given`` values are known beforehand and cost nothing."""
    known = {"text": F.col("text")} | {name: F.col(name) for name in given}
    if given:
        columns = [_with(name, {"text": F.col("text")}, lambda k, n=name: k[n]).alias(name) for name in given]
        sample = materialize(sample.select("text", *columns), "quality-sample-values")

    def timed(condition: Column) -> tuple[float, float]:
        job = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("hit"))
        spent = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            row = job.first()
            spent.append(time.perf_counter() - began)
        return min(spent[1:]), (row["hit"] + 0.5) / (row["n"] + 1)

    base = timed(F.length("text") < 0)[0]
    out = {}
    for rule in rules:
        spent, share = timed(~verdict([rule], known))
        out[rule.name] = (max(spent - base, 1e-4), share)
    return out


def rank(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties in their listed order."""
    return sorted(rules, key=lambda r: -measured[r.name][1] / measured[r.name][0])


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[Rule]:
    """The rules in the order that rejects most per second, as measured on a sample."""
    return rank(rules, measure(draw_sample(docs, text_col, sample_rows), rules, given))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with their columns unchanged."""
    return docs.where(verdict(plan_cascade(docs, text_col, rules, sample_rows), {"text": F.col(text_col)}))


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, the base counts, ``base_failed`` and ``kept``."""
    further = tuple(r for r in RULES if r not in BASE_RULES)
    order = plan_cascade(docs, text_col, further, sample_rows, (*BASE_COUNTS, "n_lines"))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = out.withColumns({"words": words(F.col("text")), "lines": lines_with_words(F.col("text"))})
    out = out.select("doc_id", "text", *[VALUES[n][1](*[F.col(x) for x in VALUES[n][0]]).alias(n) for n in (*BASE_COUNTS, "n_lines")])
    known = {c: F.col(c) for c in out.columns}
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.rejects(*[known[n] for n in rule.needs])
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order, known))
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("text", "n_lines")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Query: base counts and verdict of every document."""
    return quality_metrics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
