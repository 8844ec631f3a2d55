"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger holds one row per
(blob, rule version) that was ever scanned, with its findings. A run scans only the pairs that the
ledger lacks, each blob once however many paths show it, and joins the findings back to all paths.
Rules are SQL regular expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.spans import Rule, find_spans
from bookengine.llm.store import materialize

#: Contract of this rule version; a change of any pattern must change the version. Fixed values.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
        lambda m: F.char_length(F.regexp_extract(m, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 1)) >= 6,
        lambda t: t.rlike("[:=]"),
    ),
    # a run that is too short fails as a whole, so its least length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}+", None, lambda t: F.contains(t, F.lit("AKIA"))),
    Rule("hex", r"[0-9a-f]{24,}+", None, None),
)
RULE_VERSION = 1
LEDGER = "blob binary, rule_version int, findings array<struct<kind:string,start:bigint,end:bigint>>"


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, blob (SHA-256 of the text, null as empty) and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``docs`` that this rule version has not scanned yet.

    One row stands for all copies of a blob, chosen from ids and digests alone; only the texts of chosen rows
    are joined and scanned.
    """
    found = versions(docs)
    chosen = found.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    one = chosen.select(F.col("doc_id").alias("_doc"), F.col("blob").alias("_blob"))
    # a blob whose only rows have no doc_id is chosen with a null id
    texts = found.join(one.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("blob") == F.col("_blob"))).select("blob", "text")
    # a row may repeat its id and text: the same findings, once
    scanned = texts.select("blob", find_spans(F.col("text"), rules).alias("findings"))
    return scanned.groupBy("blob").agg(F.any_value("findings").alias("findings")).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger with rows for what this run has scanned, which is written; an empty table changes nothing."""
    fresh = materialize(scan_unseen(docs, ledger, rules, rule_version), "ledger")
    return fresh if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(fresh)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """doc_id, blob and findings of every row of ``docs`` whose blob the ledger has.

    A blob that a third of all rows share is one ledger row; the join is a sort-merge join whose
    hot partition Spark splits. Null text is the empty blob; null or repeated ids keep their rows; empty
    table: empty result.
    """
    now = ledger.where(F.col("rule_version") == rule_version).select("blob", "findings")
    return versions(docs).select("doc_id", "blob").hint("merge").join(now, "blob").select("doc_id", "blob", "findings")


def findings_by_path(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``findings`` of every row of ``docs``, and the ledger with what this run added."""
    full = update_ledger(docs, ledger, rules, rule_version)
    return findings(docs, full, rule_version), full
