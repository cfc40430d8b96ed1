"""Operator 4, secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table on
shared storage, holds the findings of each blob under each version of the rules that it has been scanned with; a run
scans the blobs that the ledger lacks for the present version, each once however many paths
carry it, appends them, and joins the findings back to all paths. The version is the digest of the rules themselves, so a
changed rule is a new version. Writers that run at once may append one pair twice, with equal findings; whoever reads
takes each pair once.

The query's ledger is the path in the setting ``orbweave.secrets.ledger``, which later runs then find, or one of the run's own.

Spans are code points, end exclusive. Defined cases: null text is the empty blob; null ids and repeated
rows are kept; spans that begin at one place come in the order of the kinds; very long texts are scanned whole; a blob that only
an old version of a path had keeps its findings; empty tables give empty results; extra columns, whatever their names, are
ignored by the scan and passed through by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orbweave.llm.skew import salted_join, spare
from orbweave.storage import materialize, shared_path

LEDGER_SETTING = "orbweave.secrets.ledger"
#: The kinds in their order, with pattern, flags, the group that is measured and its least length.
#: For access and hex the least length stands in the pattern: runs are maximal, so the matches are the same.
KINDS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", re.ASCII, 0, 20),
    ("hex", r"[0-9a-f]{24,}", re.ASCII, 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", re.ASCII, 0, 1),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.ASCII, 0, 1),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII, 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII, 0, 1),
)
BASE = ("assign", "access", "hex")


def version_of(kinds) -> str:
    """The version of a set of rules: the digest of all that they say."""
    return hashlib.sha256(repr([(k, p, int(f), g, n) for k, p, f, g, n in kinds]).encode()).hexdigest()[:16]


RULE_VERSION = version_of(KINDS)
_COMPILED = [(k, re.compile(p, f), g, n) for k, p, f, g, n in KINDS]
FOUND = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(_COMPILED):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for blob, text in zip(b["blob"], b["text"], strict=True):
            spans = find_spans(text)
            n = {k: sum(s[2] == k for s in spans) for k in BASE}
            base = _joined(s for s in spans if s[2] in BASE)
            out.append((blob, RULE_VERSION, *n.values(), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def read_ledger(spark, ledger: str) -> DataFrame:
    """Each blob and rule version of the ledger once; a ledger that does not exist yet is empty."""
    try:
        rows = spark.read.schema(FOUND).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], FOUND)
    return rows.dropDuplicates(["blob", "rule_version"])


def scan_versions(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row of ``versions`` (any number of versions of a path), after bringing the ledger up to date."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob", "text").agg(F.lit(1).alias("one"))
    unseen = blobs.drop("one").join(known.select("blob"), "blob", "left_anti")
    unseen.mapInPandas(_scan, FOUND).withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger)
    paths = materialize(versions.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob")), "path-blobs")
    findings = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).drop("rule_version")
    return salted_join(paths, findings, ["blob"]).select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact_secrets(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows and other columns stay."""
    blob, spans_of = spare(docs, "blob"), spare(docs, "spans")
    found = scan_versions(docs, ledger, id_col, text_col).where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(spans_of)).distinct()
    addressed = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    marked = addressed.join(found, blob, "left").drop(blob)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if s:
                done, at = [], 0
                for start, end in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in s.split(","))):
                    if start >= at:
                        done += [t[at:start], mark]
                    at = max(at, end)
                t = "".join([*done, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    clean = F.when(F.col(spans_of).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(spans_of)))
    return marked.withColumn(text_col, clean).select(*docs.columns)


def ledger_of(spark) -> str:
    """The ledger that the session names, or a fresh one."""
    return spark.conf.get(LEDGER_SETTING, None) or shared_path(spark, "blob-ledger")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Query: the secrets of every document."""
    return scan_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger_of(spark)).drop("blob")
