"""Helpers that the operators share: the shared folder, written intermediates, fold hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call white space, as a regular expression of Java, RE2 and Python alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="nodeloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/nodeloom/{tag}-{uuid.uuid4().hex}"


#: Settings while a frame is written: shuffle files go as soon as the result is there (else they stay until a driver
#: collection), and batches for Python are of a size that long texts and their shingles do not blow up.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def tidy_writes(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """The settings of WRITING, for what runs within, and shuffles of `tasks` partitions where that is fewer than usual."""
    now = dict(WRITING)
    if tasks is not None:
        now["spark.sql.shuffle.partitions"] = str(max(1, min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    before = {key: spark.conf.get(key) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, tag: str, compression: str = "zstd", tasks: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends in files that outlive any executor.

    `tasks`, where the caller knows how many rows move, keeps small shuffles from being dealt over many tasks.
    """
    path = fresh_path(df.sparkSession, tag)
    with tidy_writes(df.sparkSession, tasks):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.nodeloom_path = path
    for made in _OPEN:
        made.append(out)
    return out


#: Frames materialized within each open scratch block.
_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete what is materialized within, at the end, but for the frames that the block appends to the list it gets."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield kept
    finally:
        _OPEN.pop()
        stay = {df.nodeloom_path for df in kept}
        for df in made:
            if df.nodeloom_path not in stay:
                discard(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "nodeloom_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: What this Python worker keeps from task to task, for the operator that used it last.
_KEPT: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What this Python worker keeps for `owner` from task to task; what it kept for others goes, and its memory with it.

    Workers outlive stages, so an operator calls this even if it keeps nothing itself.
    """
    if any(name != owner for name in _KEPT):
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)
    return _KEPT.setdefault(owner, {})


def spare(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_keys(docs: DataFrame, id_col: str, tag: str) -> tuple[DataFrame, str]:
    """`docs` and the name of a whole-number column that tells all its rows apart.

    That is the id where it is a whole number, never null and never repeated: a count of ids alone tells. Otherwise the
    rows are numbered and written, so that the numbers hold however often the frame is read.
    """
    if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        if not ids.where("id IS NULL OR n > 1").limit(1).count():
            return docs, id_col
    key = spare(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), tag), key


def chosen(rows: DataFrame, key: str, keys: DataFrame, docs: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the one column of `keys` (by "left_anti", is not), with the columns of `docs`, which `rows` came from."""
    name = spare(rows, "chosen")
    out = rows.join(keys.toDF(name), F.col(key) == F.col(name), how)
    return out if key in docs.columns else out.drop(key)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
