"""Operator 5, exact dedup: an extendible-hash index kept in shared files.

1. One scan hashes every normalised text (64-bit key and SHA-256) into a narrow table on the shared folder.
2. ``build_directory`` starts with one bucket, of depth 0, for all keys. A bucket that holds more than
   ``bucket_keys`` distinct keys splits in two by the next bit of the key, and where that takes a bit that the
   directory does not have yet, the directory doubles. Only overfull buckets split, until every bucket fits; distinct
   keys differ in some bit, so there is no least depth. A page of the directory covers as many doublings as its fullest
   bucket is expected to need, and two more (``PAGE_BITS`` at most): the cells of the finest prefix are counted once, the counts of all coarser prefixes are their sums, and only cells that
   are still overfull get a page below. The directory is a table: nothing of it is gathered on the driver.
3. A bucket is a range of keys, and its owner is a range of buckets. Every text is looked up in the directory page by
   page and sent to the owner of its bucket, which compares whole texts byte for byte and writes one index entry per
   text; entries of one key that differ form a chain, numbered by digest. Rows of a hot key, fewer than ``512`` keys
   whatever the table, are dealt to several owners, whose entries are then put together.
4. Every row looks up its entry: directory, bucket, key, and digest along the chain.

Texts are equal when identical after lower-casing A-Z alone; of equal texts the row with the largest
id stays. Defined cases: null text is the empty text; a null id loses to any other; rows repeated
with the same id and text are all marked kept if their id is the one that stays; very long texts are compared whole;
an empty table gives an empty result; extra columns are ignored. Built-in functions only.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.skew import salted_join
from orbweave.storage import materialize

BUCKET_KEYS = 1024
#: Doublings of the directory that one page covers, at most.
PAGE_BITS = 16
#: Directory pages up to this many entries are broadcast; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 1 << 16
#: Distinct keys of an owner, about.
OWNER_KEYS = 4 * BUCKET_KEYS
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` is exact, and faster, where all bytes are ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    )


def prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key; 0 of them are the number 0."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, page_bits: int = PAGE_BITS, label: str = "directory") -> list[tuple[int, DataFrame, int]]:
    """Pages of the directory over distinct ``key``: depth, entries (``cell, local_depth, bucket``), number of entries.

    An entry maps a prefix of the page's depth to the bucket that holds it: the least key of the bucket's range. Cells
    that the next page splits further have no entry here.
    """
    pages, above, pending, most = [], 0, keys, keys.count()
    while True:
        doublings = min(page_bits, (most // bucket_keys).bit_length() + 2)
        depth = min(above + doublings, KEY_BITS)
        cells = materialize(pending.groupBy(prefix(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), f"{label}-cells")
        coarse = F.explode(F.sequence(F.lit(above if not above else above + 1), F.lit(depth))).alias("local_depth")
        part = F.when(F.col("local_depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("cell"), F.lit(depth) - F.col("local_depth")))
        ancestors = cells.select("cell", "n", coarse).withColumn("part", part)
        fit = ancestors.groupBy("local_depth", "part").agg(F.sum("n").alias("held")).where(F.col("held") <= bucket_keys)
        found = ancestors.join(fit, ["local_depth", "part"]).groupBy("cell").agg(F.min(F.struct("local_depth", "part")).alias("b"))
        low = F.when(F.col("b.local_depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.col("b.part"), F.lit(KEY_BITS) - F.col("b.local_depth")))
        entries = materialize(found.select("cell", F.col("b.local_depth").alias("local_depth"), low.alias("bucket")), label)
        pages.append((depth, entries, entries.count()))
        overfull = cells.where(F.col("n") > bucket_keys)
        most = overfull.agg(F.max("n")).first()[0]
        if depth == KEY_BITS or most is None:
            return pages
        pending = materialize(pending.withColumn("cell", prefix(F.col("key"), depth)).join(overfull.select("cell"), "cell", "left_semi").select("key"), f"{label}-rest")
        above = depth


def look_up(rows: DataFrame, pages: list[tuple[int, DataFrame, int]]) -> DataFrame:
    """``rows`` (with ``key``) and their ``bucket``, from the first page that has an entry for the key's prefix."""
    out = rows.withColumn("bucket", F.lit(None).cast("long"))
    for depth, entries, n in pages:
        page = entries.select(F.col("cell").alias("page_cell"), F.col("bucket").alias("page_bucket"))
        out = out.withColumn("page_cell", prefix(F.col("key"), depth)).join(F.broadcast(page) if n <= BROADCAST_ENTRIES else page, "page_cell", "left")
        out = out.withColumn("bucket", F.coalesce("bucket", "page_bucket")).drop("page_cell", "page_bucket")
    return out.where("bucket IS NOT NULL")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, page_bits: int = PAGE_BITS, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    hashed = materialize(
        rows.select("doc_id", key_of(F.col("body")).alias("key"), F.sha2("body", 256).alias("text_sha256")), "dedup-keys"
    )
    sizes = materialize(hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-key-sizes")
    total, distinct = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    pages = build_directory(sizes.select("key"), bucket_keys, page_bits)

    spread = max(256, total >> 12)
    hot = {r["key"]: -(-r["n"] // spread) for r in sizes.where(F.col("n") > max(spread, total >> 9)).collect()}
    owner_bits = max(0, (distinct // OWNER_KEYS).bit_length())
    salt = F.lit(0).cast("long")
    if hot:
        parts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.element_at(parts, F.col("key"))), salt)
    keyed = look_up(rows.withColumn("key", key_of(F.col("body"))), pages).withColumns({"owner": prefix(F.col("bucket"), owner_bits), "salt": salt})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << owner_bits) // 8)
    owned = keyed.repartition(tasks, "owner", "salt")
    merged = owned.groupBy("owner", "salt", "bucket", "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = materialize(merged.select("bucket", "key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size", F.when(F.col("key").isin(*hot), F.col("body")).alias("body")), "dedup-entries")
    if hot:
        split = entries.where("body IS NOT NULL").groupBy("bucket", "key", "text_sha256", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        entries = entries.where("body IS NULL").drop("body").unionByName(split.drop("body"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")).alias("link")
    index = materialize(entries.select("bucket", "key", chain, "text_sha256", "keep_id", "group_size"), "dedup-index")
    found = salted_join(look_up(hashed, pages), index.drop("link"), ["bucket", "key", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: the group of every document under exact equality."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
