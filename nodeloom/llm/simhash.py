"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in two or three bits at most
agree in one segment up to a single bit, so each segment is indexed under its 32 one-wildcard variants and an equality
join finds every candidate; a population count verifies it. Only distinct fingerprints take part, so copies cost
nothing. A variant that more than BUCKET fingerprints share is split once more by the points within one bit of the
other segment: fingerprints that share such a point are at most a few dozen, and every true pair shares one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Distinct fingerprints of one variant that are compared directly; larger variants are split, none is dropped.
BUCKET = 128


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, repeats included: the bits set in more than half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text in turn, A-Z lowered; a shorter text is one shingle, one without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=len(shingles))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z lowered; zero for a text without words."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(fp: str, seg: str):
    """The 32-bit segment number 0 (low) or 1 (high) of a fingerprint column."""
    return F.expr(f"shiftrightunsigned({fp}, cast(32 * {seg} as int)) & 4294967295")


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in `max_bits` (1 to 3) bits at most."""
    if not 1 <= max_bits <= 3:
        raise ValueError("two segments find up to three differing bits")
    variants = (
        distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
        .withColumn("seg", F.expr("slot div 32"))
        .withColumn("part", _segment("fp", "seg"))
        .withColumn("hole", F.expr("shiftleft(1L, cast(slot % 32 as int))"))
        .select("fp", F.expr("shiftleft(cast(slot as long), 32) | (part & ~hole)").alias("variant"))
    )
    shared = materialize(
        variants.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("variant"))).where("n > 1"),
        "variants",
    )
    # a pair that agrees in the whole segment meets under all its 32 variants and is taken at the first
    once = "(slot_bit <> 0 OR shiftrightunsigned(variant, 32) % 32 = 0)"

    def pairs(side: DataFrame, keys: list[str]) -> DataFrame:
        left, right = side.withColumnRenamed("fp", "a"), side.select(*keys, F.col("fp").alias("b"))
        slot = "cast(shiftrightunsigned(variant, 32) as int)"
        return (
            left.join(right, keys)
            .where(f"a < b AND bit_count(a ^ b) <= {max_bits}")
            .where(once.replace("slot_bit", f"(shiftrightunsigned(a ^ b, 32 * ({slot} div 32) + {slot} % 32) & 1L)"))
            .select("a", "b")
        )

    near = pairs(shared.where(f"n <= {BUCKET}"), ["variant"])
    points = (
        shared.where(f"n > {BUCKET}")
        .withColumn("other", F.expr("shiftrightunsigned(fp, 32 * (1 - cast(shiftrightunsigned(variant, 32) as int) div 32)) & 4294967295"))
        .select("fp", "variant", F.explode(F.expr("transform(sequence(0, 32), i -> other ^ if(i = 32, 0L, shiftleft(1L, i)))")).alias("point"))
    )
    if max_bits > 2:  # the other segment may differ by three bits: fall back to the points of both radii
        points = points.select("fp", "variant", F.explode(F.expr("transform(sequence(0, 32), i -> point ^ if(i = 32, 0L, shiftleft(1L, i)))")).alias("point")).distinct()
    split = pairs(points, ["variant", "point"])
    return near.unionByName(split).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Null texts count as empty; texts without words have fingerprint zero and link like any other. A null doc_id keeps
    its row and is never the least id unless all ids of its component are null. Repeated rows stay. An empty table
    gives no rows; other columns are not read.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    groups = connected_components(links(distinct.select("fp"), max_bits), "a", "b").withColumnRenamed("node", "fp")
    labelled = materialize(
        distinct.join(groups, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "labels"
    )
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = labelled.join(least, "component").select("fp", "component_id")
    return docs_fp.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
