"""Reading and writing: projected scans, archives, integrity, manifests, comparison of runs, small reports."""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a temporary folder for this session, a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='nodeloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is formed and run within go as it ends; else they stay until a driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, which ends its lineage; its shuffle files are removed."""
    path = f"{shared_folder(df.sparkSession)}/frames/{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def projected(spark: SparkSession, path: str, columns: list[str], keep: Column | None = None) -> DataFrame:
    """A Parquet scan of some columns and rows; both reach the reader."""
    df = spark.read.parquet(path)
    return (df.where(keep) if keep is not None else df).select(*columns)


def archive_members(names: list[str], prefix: str, suffix: str, years: set[int]) -> list[str]:
    """Members by prefix and suffix whose name has one of the years, or 9999, which stands for all years."""
    out = []
    for name in sorted(names):
        found = re.search(r"(\d{4})", name.rsplit("/", 1)[-1])
        if name.startswith(prefix) and name.endswith(suffix) and found and int(found[1]) in years | {9999}:
            out.append(name)
    return out


def archived_csv(spark: SparkSession, path: str, columns: list[str], prefix: str = "", suffix: str = ".csv", years: set[int] | None = None, separator: str = ";", where: tuple[str, str] | None = None) -> DataFrame:
    """Rows of delimited files in zip archives, all strings, an archive a task, filtered while they are read.

    `where` is a column and a regular expression that its value must match. Files may lack columns; those are null.
    Archives come through Spark's binary reader, so that any store it reads will do.
    """
    schema = T.StructType([T.StructField("member", T.StringType()), *[T.StructField(c, T.StringType()) for c in columns]])
    want = re.compile(where[1]) if where else None

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = archive.namelist()
                    for name in archive_members(names, prefix, suffix, years) if years is not None else [n for n in sorted(names) if n.startswith(prefix) and n.endswith(suffix)]:
                        with archive.open(name) as raw:
                            reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter=separator)
                            rows = []
                            for row in reader:
                                if want and not want.search(row.get(where[0]) or ""):
                                    continue
                                rows.append((name, *[row.get(c) for c in columns]))
                                if len(rows) >= 50_000:
                                    yield pd.DataFrame(rows, columns=schema.names)
                                    rows = []
                            yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_once(df: DataFrame, path: str) -> None:
    """Write unless it is there already."""
    df.write.mode("ignore").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, bytes of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_diff(now: DataFrame, saved: DataFrame) -> DataFrame:
    """file, state: files that are missing, new or changed against a saved manifest (file, sha256)."""
    a, b = now.select("file", F.col("sha256").alias("_now")), saved.select("file", F.col("sha256").alias("_saved"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_saved").isNull(), "new").when(F.col("_now") != F.col("_saved"), "changed")
    return a.join(b, "file", "full").select("file", state.alias("state")).where("state IS NOT NULL")


def check_inputs(spark: SparkSession, path: str, expected: dict[str, str], allow_new: bool = False) -> None:
    saved = spark.createDataFrame(list(expected.items()), "file string, sha256 string")
    bad = manifest_diff(checksums(spark, path), saved).where("state = 'missing'" if allow_new else "state <> 'new'").collect()
    if bad:
        raise ValueError(f"inputs differ: {sorted(tuple(r) for r in bad)}")


def json_leaves(documents: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, path, number, other: a row for every scalar of a JSON column, and for every empty array or object.

    A scalar is a number or, as JSON text, something else. Text that is not JSON is one scalar, a null column has none.
    """
    held = T.StructType([*[documents.schema[k] for k in keys], T.StructField("path", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("other", T.StringType())])

    def leaves(text: str) -> Iterator[tuple[str, float | None, str | None]]:
        try:
            todo = [("$", json.loads(text))]
        except ValueError:
            todo = [("$", text)]
        while todo:
            path, value = todo.pop()
            inner = list(value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ())
            if inner:
                todo += [(f"{path}[{json.dumps(k)}]", v) for k, v in inner]
            elif type(value) in (int, float):
                yield path, float(value), None
            else:
                yield path, None, json.dumps(value)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(*key, *leaf) for *key, text in batch.itertuples(index=False) if text is not None for leaf in leaves(text)]
            yield pd.DataFrame(rows, columns=held.names)

    return documents.select(*keys, F.col(column).cast("string").alias("_json")).mapInPandas(run, held)


def json_diff(a: DataFrame, b: DataFrame, keys: list[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """keys, path, state: where the JSON columns of two tables differ, numbers within a tolerance; objects are unordered."""
    return table_diff(json_leaves(a, keys, column), json_leaves(b, keys, column), [*keys, "path"], ["number"], tolerance, ["other"])


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9, exact: list[str] | None = None) -> DataFrame:
    """The keys of rows that only one table has, or whose values differ by more than the tolerance (or at all, for `exact` ones): keys, state."""
    exact = exact or []
    left = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in [*values, *exact]], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in [*values, *exact]], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        close = F.abs(x - y) <= tolerance + tolerance * F.abs(y)
        same = same & F.coalesce(F.when(x.isNull() & y.isNull(), True).otherwise(close), F.lit(False))
    for v in exact:
        same = same & F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    state = F.when(F.col("_in_a").isNull(), "only in b").when(F.col("_in_b").isNull(), "only in a").when(~same, "differs")
    return left.join(right, keys, "full").select(*keys, state.alias("state")).where("state IS NOT NULL")
