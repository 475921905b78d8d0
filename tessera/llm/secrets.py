"""Secret scans with an incremental blob ledger.

Every distinct text is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table of (rule
version, blob) pairs that were scanned, with what was found; a scan reads only blobs whose pair it does not hold, and
findings are joined back to every document (path, version) that carries the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_path, small_batches

RULE_VERSION = "base+pem+prefix/2"
#: The base rules, in order, as the contract states them (fixed values).
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Rules that the scan adds: private key blocks, and tokens with a provider's prefix.
PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}PRIVATE KEY)-----")
#: What follows a BEGIN line that has no END line: header lines, base64 lines, and a short last one. Line breaks may be
#: escaped, as in JSON.
BREAK = r"(?:\s|\\[rn])+"
PEM_BODY = re.compile(rf"(?:{BREAK}[A-Za-z-]+:[ ][^\n\\]*)*(?:{BREAK}[A-Za-z0-9+/]{{32,}}={{0,2}}(?![A-Za-z0-9+/=]))+(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]{{1,31}}={{0,2}}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?")
PREFIX = re.compile(r"(?:ghp|gho|ghs|xox[abpr]|sk|pk|glpat)[_-][A-Za-z0-9_-]{20,}")
KINDS = ("assign", "access", "hex", "pem", "prefix")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, cuts array<int>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, rank of kind, end) of the base rules; code points, end exclusive; in order of start, then kind."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN" in text:
        out += pem_spans(text)
    if any(p in text for p in ("ghp", "gho", "ghs", "xox", "sk", "pk", "glpat")):
        out += [(m.start(), 4, m.end()) for m in PREFIX.finditer(text)]
    return out


def pem_spans(text: str) -> list[tuple[int, int, int]]:
    """Private key blocks: from a BEGIN line to its END line if that is the next such line, else to the end of the
    base64 lines that follow; without any, the BEGIN line."""
    lines, out = list(PEM.finditer(text)), []
    for k, m in enumerate(lines):
        if m[1] == "BEGIN":
            after = lines[k + 1] if k + 1 < len(lines) else None
            if after and after[1] == "END" and after[2] == m[2]:
                out.append((m.start(), 3, after.end()))
            else:
                body = PEM_BODY.match(text, m.end())
                out.append((m.start(), 3, body.end() if body else m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def findings(text: str) -> tuple[int, int, int, str, str, list[int]]:
    base = base_spans(text)
    every = sorted(base + added_spans(text))
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [x for start, _, end in every for x in (start, end)])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = pd.DataFrame([findings(t) for t in b["text"]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "cuts"], index=b.index)
        yield pd.concat([b["blob"], found], axis=1)


def scan_new(docs: DataFrame, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs of docs (doc_id, text) that the ledger at this path lacks for the rule version, adds them to
    it, and returns the version's ledger: blob and findings.

    One document stands for each unseen blob: the smallest (doc_id, hash), found from digests alone, so that only
    those texts move. A null text is the empty blob. Two scans that add to a ledger at once may both add a blob: a ledger
    that holds a blob twice is read with one row of each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blobs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    blobs = blobs.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    wanted = blobs.groupBy("blob").agg(F.min("id").alias("id"))
    schema = f"blob string, {FOUND}, version string"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if there:
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("version") == version).select("blob")
        wanted = wanted.join(seen, "blob", "left_anti")
    texts = blobs.join(wanted, ["id", "blob"]).select("blob", "text", "id")
    fresh = texts.mapInPandas(_scan, f"blob string, {FOUND}").dropDuplicates(["blob"])  # repeated rows of one doc_id
    fresh.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger).where(F.col("version") == version).drop("version")
    if there:
        n = known.agg(F.count("*").alias("rows"), F.countDistinct("blob").alias("blobs")).first()
        if n.rows > n.blobs:
            known = known.dropDuplicates(["blob"])
    return known


def scan_secrets(docs: DataFrame, ledger: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row of docs (doc_id, text): doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans, cuts.

    Without a ledger's path a new one is started, so all blobs are scanned, each once. Rows with equal texts have equal
    findings; null and empty texts have none. An empty table gives no rows and leaves an empty ledger.
    """
    ledger = ledger or new_path(docs.sparkSession, "blob-ledger")
    found = scan_new(docs, ledger, version)
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return paths.join(found, "blob").select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "cuts")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark; overlapping spans by one. n_chars, if there, follows the text.

    Other columns, whatever their names, and the number of rows stay; null texts stay null.
    """
    ledger = ledger or new_path(docs.sparkSession, "blob-ledger")
    found = scan_new(docs, ledger).where(F.size("cuts") > 0).select("blob", "cuts")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, c in zip(texts, cuts, strict=True):
            if text is not None and c is not None and len(c):
                parts, at = [], 0
                for start, end in sorted(zip(c[::2], c[1::2], strict=True)):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, index=texts.index, dtype=object)

    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(rest.alias("row"), F.col("text").alias("old"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    rows = rows.join(found, "blob", "left").select("row", "cuts", cut("old", "cuts").alias("new"))
    now = {"text": F.col("new"), "n_chars": F.when(F.col("cuts").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("new").cast("long"))}
    return rows.select(*[(now[c] if c in now else F.col("row")[c]).alias(c) for c in docs.columns])
