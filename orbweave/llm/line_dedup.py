"""Operator 7, line dedup: content-defined line chunks, found by hash, grown and removed by byte comparison.

A line ends at a line feed or, inside a longer line, at the end of a sentence, so a passage set within
running text has lines of its own.

1. A rolling hash runs over the hashes of the lines: its window begins at a line and takes lines until it has
   ``CHUNK_WORDS`` words. Where it is the least of ``NEAR`` neighbouring windows, a boundary stands and the
   window is a chunk. Boundaries depend on the lines around them alone, so they move with the text, and every
   shared run of ``NEAR`` windows holds a chunk that all its copies have.
2. Chunks that occur at several places are found by hash. A batch sends one place of a chunk and keeps its
   other places aside, so a passage that stands everywhere costs one row a batch. The first place is the least
   by id, version (hash of the text) and line.
3. Later places on one diagonal (same first text, same shift) make a run. The run asks for the lines of the first
   text around it, in blocks of ``BLOCK`` lines, however many ask for them.
4. Each text compares its own lines with those byte for byte, grows what is equal line by line and then word by
   word in both directions, joins touching spans, and removes spans of ``MIN_WORDS`` words in two lines or more, or
   of ``LONG_LINE`` words.

Texts that ask or answer are picked from the table by a bitmap of ``BITMAP_BITS`` bits (exact joins follow), so
the others are not shuffled. What is removed stands, byte for byte, at an earlier place of the table.

Where a span with a line feed at its end goes from the middle of a line, the line feed stays. Defined cases:
null text stays null; a text that goes entirely becomes empty, the row stays; rows repeated with the same id and
text keep the same lines, as they are one place; rows with one id and different texts are ordered by the hash of
the text; a null id comes before all others; very long texts are read whole; empty tables give empty results; extra
columns, whatever their names, pass through ``dedup_lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.skew import salted_join, spare
from orbweave.storage import materialize

CHUNK_WORDS = 12
NEAR = 2
MIN_WORDS = 20
LONG_LINE = 50
#: Lines of a block, and lines that a run asks for beyond its own places on each side.
BLOCK = 16
REACH = 6
BITMAP_BITS = 1 << 27
#: Bytes of text that a worker is sent at a time.
BATCH = "4m"
_END = re.compile(r"[\n.!?](?:(?<=\n)| )")
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
PLACES = "hash long, id long, version long, start int, more boolean, aside boolean"


def split_lines(text: str) -> list[str]:
    """Lines with the line feed or space that ends them; only the last has none."""
    at, out = 0, []
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return out


def chunk_starts(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunks of many texts: the number of the text, the first line in it, and the hash."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    lines = [x for own in texts for x in own]
    counts = np.array([len(x.split()) for x in lines], dtype=np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    total = np.concatenate([[0], np.cumsum(counts)])
    start = np.flatnonzero(counts)
    stop = np.searchsorted(total, total[start] + CHUNK_WORDS)
    whole = stop <= ends[own[start]]
    start, stop = start[whole], stop[whole]
    digest = np.array([xxhash.xxh3_64_intdigest(x.rstrip(" \n").encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64)
    power = lambda m: np.multiply.accumulate(np.array([1] + [m] * len(lines), dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(digest * power(_MULTIPLIER)[:-1], dtype=np.uint64)])
    rolled = (sums[stop] - sums[start]) * power(_INVERSE)[start]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(_MULTIPLIER)
    far = np.uint64((1 << 64) - 1)
    text = own[start]

    def beside(step: int) -> np.ndarray:
        """The hash ``step`` windows on, or the largest number outside the text."""
        out = np.full(len(rolled), far)
        if abs(step) < len(rolled):
            here, there = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            out[here] = np.where(text[here] == text[there], rolled[there], far)
        return out

    near = {step: beside(step) for step in range(1 - NEAR, NEAR) if step}
    least = np.zeros(len(rolled), dtype=bool)
    for low in range(1 - NEAR, 1):
        least |= np.logical_and.reduce([rolled <= near[step] for step in range(low, low + NEAR) if step])
    return text[least], start[least] - (ends - sizes)[text[least]], rolled[least].view(np.int64)


def _parts(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``size`` bytes of text, so that a worker holds the lines of few texts."""
    total = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(b):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, stop - at)
        at = stop


def _places(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The chunks of each part of a batch: of equal ones the first place, and the others aside."""
    for b in (part for whole in batches for part in _parts(whole, size)):
        parts, at = [], 0
        for own in _parts(b, at_once):
            lines = [[] if t is None else split_lines(t) for t in own.column("text").to_pylist()]
            if any(lines):
                text, start, digest = chunk_starts(lines)
                parts.append((text + at, start, digest))
            at += len(own)
        if not parts:
            continue
        text, start, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, versions = b.column("id"), b.column("version").to_numpy(zero_copy_only=False)
        known, number = np.asarray(ids.is_valid(), dtype=np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)
        _, rank = np.unique(np.stack([known, number, versions], axis=1), axis=0, return_inverse=True)
        order = np.lexsort((start, rank.reshape(-1)[text], digest))
        text, start, digest = text[order], start[order], digest[order]
        first = np.concatenate([[True], digest[1:] != digest[:-1]])[: len(digest)]
        more = first & np.concatenate([~first[1:], [False]])[: len(digest)]
        take = pa.array(text)
        columns = [pa.array(digest), ids.take(take), b.column("version").take(take), pa.array(start.astype(np.int32)), pa.array(more), pa.array(~first)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PLACES.split(", ")])
        pa.default_memory_pool().release_unused()


def later_places(rows: DataFrame) -> DataFrame:
    """``id, version, start`` of every place of a chunk but the first, with the first (``oid, over, ostart``). ``rows``: id, version, text."""
    places = materialize(rows.mapInArrow(_places, PLACES), "chunk-places", by=("aside",), batch=BATCH)
    place, one = F.struct("id", "version", "start"), Window.partitionBy("hash")
    met = places.where("NOT aside").withColumns({"n": F.count(F.lit(1)).over(one), "some": F.max("more").over(one), "first": F.min(place).over(one)}).where("n > 1 OR some")
    met = materialize(met.select("hash", "id", "version", "start", "first"), "repeated-chunks")
    firsts = met.groupBy("hash").agg(F.first("first").alias("first"))
    aside = salted_join(places.where("aside").select("hash", "id", "version", "start"), firsts, ["hash"])
    both = met.unionByName(aside.select("hash", "id", "version", "start", "first")).where(~place.eqNullSafe(F.col("first")))
    return both.select("id", "version", "start", F.col("first.id").alias("oid"), F.col("first.version").alias("over"), F.col("first.start").alias("ostart"))


def asked_blocks(later: DataFrame) -> DataFrame:
    """``id, version, oid, over, shift, block``: the blocks of first texts that each text compares itself with."""
    own = later.withColumn("shift", F.col("start") - F.col("ostart"))
    low, high = F.greatest(F.col("ostart") - REACH, F.lit(0)), F.col("ostart") + REACH
    blocks = F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int"))
    return own.select("id", "version", "oid", "over", "shift", F.explode(blocks).alias("block")).distinct()


def bitmap(keys: DataFrame, *names: str) -> DataFrame:
    """``part, bits``: a bitmap of the rows' hashes, in parts of 32,768 bits; its size is bounded whatever the rows."""
    bit = F.pmod(F.xxhash64(*names), F.lit(BITMAP_BITS))
    return keys.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(docs: DataFrame, key: Column, bits: DataFrame, flag: str) -> DataFrame:
    """``docs`` with the Boolean column ``flag``: whether the bitmap has the row's hash."""
    bit = F.pmod(key, F.lit(BITMAP_BITS))
    part, mask = spare(docs, "part"), spare(docs, "mask")
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(mask), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    have = F.coalesce(F.call_function("getbit", byte, (place % 8).cast("int")) == 1, F.lit(False))
    small = F.broadcast(bits.select(F.col("part").alias(part), F.col("bits").alias(mask)))
    return docs.withColumn(part, F.bitmap_bucket_number(bit)).join(small, part, "left").withColumn(flag, have).drop(part, mask)


def _words_back(a: str, b: str) -> int:
    """Length of the common end of two lines, in whole words."""
    n = 0
    for x, y in zip(reversed(a), reversed(b)):  # noqa: B905
        if x != y:
            break
        n += 1
    while n and n < len(a) and not a[-n - 1].isspace() or n and n < len(b) and not b[-n - 1].isspace():
        n -= 1
    return n if a[len(a) - n :].strip() else 0


def _words_on(a: str, b: str) -> int:
    """Length of the common start of two lines, in whole words."""
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    while n and n < len(a) and not a[n].isspace() or n and n < len(b) and not b[n].isspace():
        n -= 1
    return n if a[:n].strip() else 0


def equal_spans(lines: list[str], starts: list[int], theirs: dict[int, str]) -> list[tuple[int, int]]:
    """Character spans of a text that equal a first text: ``theirs`` has lines of it by the place they are compared with."""
    spans, done, last = [], -1, len(lines)
    for a in sorted(theirs):
        if a <= done or not 0 <= a < last or not _same(lines[a], theirs[a]):
            continue
        b = a + 1
        while b < last and b in theirs and _same(lines[b], theirs[b]):
            b += 1
        low, high, done = starts[a], starts[b], b
        if a and a - 1 in theirs:
            low -= _words_back(lines[a - 1], theirs[a - 1])
        if b < last and b in theirs:
            high += _words_on(lines[b], theirs[b])
        spans.append((low, high))
    return spans


def _same(a: str, b: str) -> bool:
    return a == b or a.rstrip(" \n") == b.rstrip(" \n")


def cut_spans(text: str, starts: list[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without the joined spans that are long enough."""
    joined: list[list[int]] = []
    for low, high in sorted(spans):
        if joined and not text[joined[-1][1] : low].strip():
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    out, at = [], 0
    for low, high in joined:
        words = len(text[low:high].split())
        several = np.searchsorted(starts, high, "left") - np.searchsorted(starts, low, "right") + 1 >= 2
        if words < MIN_WORDS or not (several or words >= LONG_LINE):
            continue
        part = text[at:low]
        if text[high - 1 : high] == "\n" and part and not part.endswith("\n"):
            part = part.rstrip(" ") + "\n"
        out.append(part)
        at = high
    return "".join([*out, text[at:]])


#: Between the parts of an answer: what it compares with, the shift, the number of the block, and the block itself.
_PART = "\x1f"


def without_copies(text: str, given) -> str:
    """What is left of a text, given the blocks of first texts."""
    lines = split_lines(text)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist()
    split: dict[str, list[str]] = {}
    groups: dict[tuple[str, str], dict[int, str]] = {}
    for g in given:
        source, shift, block, body = g.split(_PART, 3)
        if body not in split:
            split[body] = split_lines(body)[:BLOCK]
        at = int(block) * BLOCK + int(shift)
        groups.setdefault((source, shift), {}).update(enumerate(split[body], at))
    return cut_spans(text, starts[:-1], [s for theirs in groups.values() for s in equal_spans(lines, starts, theirs)])


def _sliced(of, kind: pa.DataType, *columns: pa.Array, rows: int = 100) -> pa.Array:
    """``of`` each row of some columns, a few rows at a time, so that only they are held as Python objects."""
    parts = [pa.array([of(*row) for row in zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True)], kind) for at in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut from the text, other columns unchanged; ``removed`` names a column for the characters cut."""
    id_, version = F.col(id_col).cast("long"), F.xxhash64(text_col)
    asked = materialize(asked_blocks(later_places(docs.select(id_.alias("id"), version.alias("version"), F.col(text_col).alias("text")))), "asked-blocks")
    flag, own_id, own_version, given = (spare(docs, n) for n in ("flag", "id", "version", "given"))

    wanted = asked.select("oid", "over", "block").distinct().groupBy("oid", "over").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    wanted = materialize(wanted, "wanted-blocks")

    @F.arrow_udf("array<struct<block:int,body:string>>")
    def bodies(text: pa.Array, blocks: pa.Array) -> pa.Array:
        def of(t: str, own: list[int]) -> list[dict]:
            lines = split_lines(t)
            return [{"block": k, "body": "".join(lines[k * BLOCK : (k + 1) * BLOCK])} for k in own]

        return _sliced(of, pa.list_(pa.struct([("block", pa.int32()), ("body", pa.string())])), text, blocks)

    narrow = docs.select(id_.alias("aid"), version.alias("aver"), F.col(text_col).alias("text"))
    sources = marked(narrow, F.xxhash64("aid", "aver"), bitmap(wanted, "oid", "over"), "flag").where("flag").join(wanted, F.expr("aid <=> oid AND aver = over"))
    answers = sources.select("aid", "aver", F.explode(bodies("text", "blocks")).alias("b")).select("aid", "aver", "b.block", "b.body").dropDuplicates(["aid", "aver", "block"])
    key = lambda *names: F.struct(F.coalesce(F.col(names[0]).cast("string"), F.lit("")).alias("i"), F.col(names[1]).alias("v"), F.col(names[2]).alias("b")).alias("key")
    answers = materialize(answers.select(key("aid", "aver", "block"), "body"), "answered-blocks", batch=BATCH)
    met = salted_join(asked.select("*", key("oid", "over", "block")), answers, ["key"])
    grouped = met.groupBy("id", "version").agg(F.collect_list(F.concat_ws(_PART, F.concat_ws(":", "oid", "over"), "shift", "block", "body")).alias(given))
    grouped = grouped.select(F.col("id").alias(own_id), F.col("version").alias(own_version), given)

    # runs in the caller's job, where Arrow batches may be of 64 MB; a plain function is sent a hundred rows at a time
    left_over = F.udf(without_copies, "string", useArrow=False)

    split = marked(docs, F.xxhash64(id_, version), bitmap(asked, "id", "version"), flag)
    on = id_.eqNullSafe(F.col(own_id)) & (version == F.col(own_version))
    maybe = split.where(flag).join(grouped, on, "left")
    told = F.col(given).isNotNull()
    after = F.when(told, left_over(F.when(told, F.col(text_col)).otherwise(""), F.coalesce(given, F.array().cast("array<string>")))).otherwise(F.col(text_col))
    names = [c for c in docs.columns if c != removed]
    same, cut = split.where(~F.col(flag)), maybe.withColumn(given, after)
    if removed:
        same = same.withColumn(removed, F.lit(0).cast("long"))
        cut = cut.withColumn(removed, F.coalesce(F.length(text_col) - F.length(given), F.lit(0)).cast("long"))
    cut = cut.withColumn(text_col, F.col(given))
    names += [removed] if removed else []
    return same.select(*names).unionAll(cut.select(*names))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what line dedup leaves of every document: ``doc_id, n_lines`` (by line feeds), ``n_removed`` (characters), ``text``."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), removed="n_removed")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return out.select("doc_id", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), "n_removed", "text")
