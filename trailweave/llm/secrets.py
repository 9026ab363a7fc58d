"""Secret scans with an incremental ledger of scanned blobs.

Every version of every path (a document here) is addressed by the SHA-256 of its text.
The ledger is a table of ``blob, rules, findings``: what a version of the rules found in
a blob.  A scan takes the blobs that have no ledger row for its rules, scans them where
they lie, appends one row for each, and joins findings back to all paths.  Texts are not
shuffled: a task scans a blob once, and only digests and findings are combined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import documents, pieces, table, texts
from trailweave.session import checked_broadcast, checkpoint_folder

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Name of these rules; another name scans every blob again.
RULES = "base-1"
FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = pa.schema([("blob", pa.string()), ("rules", pa.string()), ("findings", pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
TABLE = f"blob string, rules string, findings {FINDING}"
#: Blobs a task remembers as scanned.
MEMORY = 200_000


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in code points, by start, then kind as listed.

    Matches are leftmost and non-overlapping within a kind; a match that is too short is
    dropped after it has used up its place.
    """
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run starts where 24 such characters first fit, so long runs are the runs that fit.
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scanned(rows: DataFrame, rules: str = RULES) -> DataFrame:
    """Ledger rows of the blobs of ``text, blob``: one per blob.

    Texts stay in the task that reads them, which scans each blob once (again only after
    ``MEMORY`` others); of equal rows from several tasks one is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for piece in pieces(batches, "text"):
            if len(seen) > MEMORY:
                seen = set()
            new = {}
            for blob, text in zip(piece.column("blob").to_pylist(), texts(piece)):
                if blob not in seen:
                    seen.add(blob)
                    new[blob] = [dict(zip(("kind", "start", "end"), s)) for s in find_secrets(text)]
            yield table(LEDGER, list(new), [rules] * len(new), list(new.values()))

    return rows.select("text", "blob").mapInArrow(run, TABLE).groupBy("blob", "rules").agg(F.first("findings").alias("findings"))


def scan(docs: DataFrame, ledger: str | None = None, rules: str = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, blob, findings`` of every row; blobs seen before are not scanned again.

    ``ledger`` is the path of the ledger table (a new one in the shared folder if it is
    not given); it is created where it does not exist.  Null texts are the empty blob.
    Repeated rows get equal rows, an empty table an empty result; an interrupted scan
    leaves a ledger without its rows and can be repeated.
    """
    spark = docs.sparkSession
    path = ledger or f"{checkpoint_folder(spark)}/trailweave-ledger-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    unseen = rows
    if ledger and exists(spark, path):
        known = spark.read.schema(TABLE).parquet(path).where(F.col("rules") == rules).select("blob").distinct()
        unseen = rows.join(checked_broadcast(known), "blob", "left_anti")
    scanned(unseen, rules).write.mode("append").parquet(path)
    # Scans at one time, or an append that was repeated, may leave a blob several equal rows.
    found = spark.read.schema(TABLE).parquet(path).where(
        (F.col("rules") == rules) & (F.size("findings") > 0)).dropDuplicates(["blob"])
    return rows.select("doc_id", "blob").join(found.select("blob", "findings"), "blob", "left").select(
        F.col("doc_id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def exists(spark, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts per kind, all spans as text and their digest, from ``doc_id, findings``."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


QUERIES = {"op5_secret_scan": lambda s, d: secret_digest(scan(documents(s, d)))}

ORACLE: dict[str, str] = {}


def digest_of(text: str) -> tuple[str, str]:
    """Spans and digest of one text, as the query returns them."""
    spans = listed(find_secrets(text))
    return spans, hashlib.sha256(spans.encode()).hexdigest()
