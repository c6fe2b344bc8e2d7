"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a path is addressed by the SHA-256 of its text, once.  The ledger is a
table of (blob, rule_version, findings).  An update picks one path for each blob
that lacks an entry for some of the rule versions, scans those texts where they
are read, once for all versions, and appends what was lacking; a join on the
address gives the findings to all paths that ever held the blob.  Texts never
move: addresses and findings do.

A bitmap of bounded size tells a scan task which texts are picked.  Where so many
are that it lets others pass, these are scanned for nothing; the findings are
then joined with the picked addresses, so the ledger never has a blob twice.

Defined cases: a null text is the empty blob and has no findings; repeated rows
share their blob's findings; null path ids are kept; an empty table gives an
empty result; extra columns are ignored.  One update at a time may append to a
ledger, so that each blob has one row for each rule version.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex")
#: Fixed values of the base rules: pattern, the group whose length counts, and the least length.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What later rule versions find besides: spans of private keys, signed tokens and personal access tokens.
MORE_KINDS = ("pem", "jwt", "pat")
MORE_RULES = {"pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "pat": r"gh[pousr]_[A-Za-z0-9]{36,}"}
#: Rule versions and the kinds that each of them has beyond the base rules.
RULE_VERSIONS = {"base-1": (), "more-1": MORE_KINDS}
RULE_VERSION = "base-1"
LEDGER_SCHEMA = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"

_ASSIGN = re.compile(RULES["assign"][0], re.ASCII | re.IGNORECASE)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(RULES["access"][0])
# a maximal run of 24 characters or more: the same matches, without a step for each short run
_HEX = re.compile(r"[0-9a-f]{24,}")


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every base match, by start, then in the order of KINDS."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= RULES["assign"][2]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= RULES["access"][2]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def find_more(text: str, kinds: Iterable[str]) -> list[tuple[int, str, int]]:
    return [(m.start(), kind, m.end()) for kind in kinds for m in re.finditer(MORE_RULES[kind], text)]


def _address(text: str) -> Column:
    return F.sha2(shared.text_or_empty(text), 256)


def _row(path: str, text: str) -> Column:
    """What tells the rows of two reads apart; rows alike in path and text may share it."""
    return F.xxhash64(F.col(path), shared.text_or_empty(text))


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, row and blob of each version, stored; no text moves."""
    return shared.stored(docs.select(F.col(path).alias("path"), _row(path, text).alias("row"), _address(text).alias("blob")), "secret-versions")


def _read(spark: SparkSession, ledger_path: str, rule_versions: Iterable[str]) -> DataFrame | None:
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except Exception as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return None
    return ledger.where(F.col("rule_version").isin(list(rule_versions)))


def lacking(addressed: DataFrame, old: DataFrame | None, rule_versions: Iterable[str]) -> DataFrame:
    """blob, row (of one version) and rule_version of every pair that ``old`` hasn't, stored."""
    blobs = addressed.groupBy("blob").agg(F.min("row").alias("row"))
    pairs = blobs.withColumn("rule_version", F.explode(F.array(*(F.lit(v) for v in rule_versions))))
    if old is not None:
        pairs = pairs.join(old.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    return shared.stored(pairs.select("blob", "row", "rule_version"), "secret-lacking")


def scan_unseen(docs: DataFrame, pairs: DataFrame, rule_versions: Iterable[str], path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows: every one of ``pairs`` (blob, row, rule_version), scanned in one pass over one version of the blob."""
    rule_versions = list(rule_versions)
    rank = {kind: i for i, kind in enumerate(KINDS + MORE_KINDS)}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
        shown = lambda found: ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)
        for batch in batches:
            rows = []
            for blob, body in zip(batch.column("blob").to_pylist(), batch.column("body"), strict=True):
                raw = body.as_py()
                base = find(raw)
                count = [sum(kind == x for _, kind, _ in base) for x in KINDS]
                for version in rule_versions:
                    more = find_more(raw, RULE_VERSIONS.get(version, ()))
                    rows.append((blob, version, *count, shown(base), shown(sorted(base + more, key=lambda x: (x[0], rank[x[1]], x[2])))))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    bodies = docs.select(_row(path, text).alias("row"), shared.text_or_empty(text).alias("body"))
    marked, picked = shared.maybe_in(bodies, F.col("row"), pairs.select(F.col("row").alias("key")).distinct())
    found = marked.where(picked).select(F.sha2("body", 256).alias("blob"), "body").mapInArrow(scan, LEDGER_SCHEMA)
    return found.dropDuplicates(["blob", "rule_version"]).join(pairs.select("blob", "rule_version"), ["blob", "rule_version"], "left_semi").select(*(c.split()[0] for c in LEDGER_SCHEMA.split(", ")))


def update(docs: DataFrame, ledger_path: str, rule_versions: Iterable[str] = (RULE_VERSION,), path: str = "doc_id", text: str = "text", addressed: DataFrame | None = None) -> None:
    """Bring the ledger up to date with these versions of paths: scan the blobs that it lacks for any of the rule versions.

    ``addressed`` are their ``versions``, where they are there already.
    """
    rule_versions = list(rule_versions)
    addressed = versions(docs, path, text) if addressed is None else addressed
    pairs = lacking(addressed, _read(docs.sparkSession, ledger_path, rule_versions), rule_versions)
    scan_unseen(docs, pairs, rule_versions, path, text).write.mode("append").option("compression", "zstd").parquet(ledger_path)


def findings(addressed: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, blob and what the ledger has for it, for every one of the ``versions``."""
    return addressed.drop("row").join(_read(addressed.sparkSession, ledger_path, [rule_version]), "blob")


def scan(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Update the ledger, then the findings for every version."""
    addressed = versions(docs, path, text)
    update(docs, ledger_path, [rule_version], path, text, addressed)
    return findings(addressed, ledger_path, rule_version)
