"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's `freqItems`, a mergeable counter table of 1/support entries) proposes the digests
that may make up more than `support` of the rows. An exact count verifies them. The verified winners, 1/support rows
at most, are broadcast and settle their rows without a shuffle; all other digests, none of them with more than
`support` of the rows, go through an ordinary partially aggregated shuffle and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chosen, materialize, row_keys

#: A digest with at least this share of the rows is a heavy hitter; it bounds the broadcast at 1/SUPPORT rows.
SUPPORT = 0.002


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT, key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and row_key where `key_col` names a unique column.

    Texts are equal when identical after each run of ASCII white space became one space; a null text counts as empty.
    Of equal texts the smallest id stays; null ids come last; of repeated rows with one id exactly one is kept, so
    `kept` is true once per group even then. An empty table gives no rows. Other columns of `docs` are not read.
    """
    digests = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), 256).alias("text_sha256"),
            (F.col(key_col) if key_col else F.monotonically_increasing_id()).cast("long").alias("row_no"),
        ),
        "digests",
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    summary = [least.alias("first"), F.count(F.lit(1)).alias("group_size")]
    candidates = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    floor = max(2.0, support * digests.count())
    winners = materialize(
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*summary).where(F.col("group_size") >= floor),
        "winners",
    )
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners), "text_sha256", "left_anti")
    light = rest.join(rest.groupBy("text_sha256").agg(*summary), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
        *([F.col("row_no").alias("row_key")] if key_col else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns; of rows repeated whole, id included, one."""
    rows, key = row_keys(docs, id_col, "rows-digested")
    return chosen(rows, key, exact_dedup(rows, id_col, text_col, key_col=key).where("kept").select("row_key"), docs)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
