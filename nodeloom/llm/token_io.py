"""Token-id files: tokenise, order by document, and store ids by a static range asymmetric numeral system.

Format. A file set is a folder with two Parquet tables. `table` holds the one frequency table that all blocks share:
(id, freq), summing to 2**SCALE. `blocks` holds one self-contained block a row: its place (part, block, first), its
documents (doc_ids, lengths), and `payload`, little-endian:

    magic "NLRA", version u16, lanes u16, ids u64, steps between checkpoints u32, checkpoints u32,
    crc32 of the ids as u32 little-endian u32, crc32 of all that follows u32,
    checkpoints x (word offset u64, lanes x state u64), words u32 ...

Id number i of a block belongs to lane i % lanes at step i // lanes. All lanes share one stream of words, so a block
decodes in vector steps; decoding can start at any checkpoint. Parquet is the container since only Spark's own
writers reach every shared store and commit atomically when an executor is lost.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkTable, slices
from .common import discard, fresh_path, materialize, remembered, tidy_writes

SCALE, LANES, STEPS, LOW = 20, 2048, 128, 1 << 31
#: Ids that fill a block; one document is never cut, so a longer one has a block of its own.
BLOCK_IDS = 1 << 20
#: Chunks of text whose ids a worker remembers.
KNOWN = 400_000
HEAD = struct.Struct("<4sHHQIIII")


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 wherever the count is; zero counts stay zero."""
    counts = counts.astype(np.float64)
    seen = counts > 0
    freq = np.zeros(len(counts), dtype=np.int64)
    if not seen.any():
        return freq
    if int(seen.sum()) > 1 << scale:
        raise ValueError("more distinct ids than slots")
    free = (1 << scale) - int(seen.sum())
    exact = counts * (free / counts.sum())
    freq[seen] = 1 + np.floor(exact[seen]).astype(np.int64)
    short = (1 << scale) - int(freq.sum())
    most = np.argsort(-(exact - np.floor(exact)), kind="stable")[:short]
    freq[most] += 1
    return freq


class Rans:
    """Vectorised coding of blocks of ids under one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.mask = np.uint64(scale), np.uint64((1 << scale) - 1)
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        # start and frequency in one word: one look-up an id
        self.both = start << np.uint64(32) | freq.astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, -(-n // 64)))
        rounds = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []  # from the last step to the first
        marks: list[tuple[int, np.ndarray]] = []
        written, wide, half, lift = 0, np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(63) - self.scale
        for step in range(rounds - 1, -1, -1):
            some = ids[step * lanes : (step + 1) * lanes]
            k = len(some)
            both = self.both[some]
            x, f = state[:k], both & half
            full = x >= f << lift
            if full.any():
                out = x[full]
                words.append((out & half).astype(np.uint32))
                written += len(out)
                x[full] = out >> wide
            q, r = np.divmod(x, f)
            state[:k] = (q << self.scale) + r + (both >> wide)
            if step % steps == 0:
                marks.append((written, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
        body = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in marks[::-1]) + stream.astype("<u4").tobytes()
        return HEAD.pack(b"NLRA", 1, lanes, n, steps, len(marks), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), zlib.crc32(body)) + body

    def decode(self, payload: bytes, checkpoint: int = 0, only: bool = False) -> np.ndarray:
        """The ids from a checkpoint to the end, or to the next checkpoint only. Whole blocks are checked twice."""
        magic, version, lanes, n, steps, marks, crc_ids, crc_body = HEAD.unpack_from(payload)
        if magic != b"NLRA" or version != 1:
            raise ValueError("not a block of token ids")
        if zlib.crc32(memoryview(payload)[HEAD.size :]) != crc_body:
            raise ValueError("the block's checksum differs")
        if not n:
            return np.zeros(0, dtype=np.uint32)
        size = 8 + 8 * lanes
        (at,) = struct.unpack_from("<Q", payload, HEAD.size + checkpoint * size)
        state = np.frombuffer(payload, "<u8", lanes, HEAD.size + checkpoint * size + 8).copy()
        words = np.frombuffer(payload, "<u4", offset=HEAD.size + marks * size).astype(np.uint64)
        rounds = -(-n // lanes)
        first, last = checkpoint * steps, min(rounds, (checkpoint + 1) * steps) if only else rounds
        out = np.empty(min(n, last * lanes) - first * lanes, dtype="<u4")
        low, wide, half, done = np.uint64(LOW), np.uint64(32), np.uint64(0xFFFFFFFF), 0
        for step in range(first, last):
            k = min(lanes, n - step * lanes)
            x = state[:k]
            slot = x & self.mask
            some = self.slots[slot.astype(np.int64)]
            both = self.both[some]
            x = (both & half) * (x >> self.scale) + slot - (both >> wide)
            thin = x < low
            need = int(np.count_nonzero(thin))
            if need:
                x[thin] = (x[thin] << wide) | words[at : at + need]
                at += need
            state[:k] = x
            out[done : done + k] = some
            done += k
        if checkpoint == 0 and not only and zlib.crc32(out) != crc_ids:
            raise ValueError("the decoded ids' checksum differs")
        return out


class LibraryTokenizer:
    """The tokenizers library on whole texts; what it gave for a chunk between blanks is remembered."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        # chunks stand for themselves only if the library splits at blanks by the byte-level pattern and adds nothing
        own = self.library.pre_tokenizer
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_chunk = self.library.normalizer is None and type(own).__name__ == "ByteLevel" and not own.add_prefix_space and len(line) == 1
        self.line = line[0]
        # the library finds its added tokens anywhere in a text, so a text that holds one is not cut
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.table = ChunkTable(self._chunks, self._texts, self.kind, KNOWN)

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, asked for as one text: a line feed between two of them is a match, and an id, of its own.

        That holds where a chunk begins with one blank or line feed at most and has none further on.
        """
        ids = self._texts(["\n".join(chunks)])[0]
        lines = np.flatnonzero(ids == self.line)
        begun = np.cumsum([t[0] == "\n" for t in chunks])
        borders = lines[np.arange(len(chunks) - 1) + begun[:-1]]
        return np.delete(ids, borders), np.diff(np.concatenate([[-1], borders, [len(ids)]])) - 1

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return self.table.batch(texts, [self.by_chunk and not any(a in x for a in self.added) for x in texts])


def _tokenizer(data: bytes) -> LibraryTokenizer:
    key = zlib.crc32(data)
    kept = remembered("token_io")
    if key not in kept:
        kept[key] = LibraryTokenizer(data)
    return kept[key]


def _encode(docs: DataFrame, data: bytes, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of ids in order of documents, not yet entropy-coded."""
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _tokenizer(shared.value), TaskContext.get().partitionId()
        doc_ids: list = []
        parts: list[np.ndarray] = []
        block = first = held = 0
        id_type = None
        tail = np.array([end_id], dtype=own.kind)
        seen = np.zeros(own.library.get_vocab_size(), dtype=np.int64)

        def row(last: bool = False) -> pa.RecordBatch:
            flat = np.concatenate([x for p in parts for x in (p, tail)]) if parts else tail[:0]
            got = np.bincount(flat, minlength=len(seen))
            seen[:] += got[: len(seen)]
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()),
                    pa.array([doc_ids], pa.list_(id_type)), pa.array([[len(p) + 1 for p in parts]], pa.list_(pa.int64())),
                    pa.array([flat.itemsize], pa.int32()), pa.array([flat.tobytes()], pa.binary()),
                    pa.array([seen.tobytes() if last else None], pa.binary()),
                ],
                names=["part", "block", "first", "n", "doc_ids", "lengths", "width", "ids", "counts"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for some in slices(batch):
                for doc_id, ids in zip(some.column(0).to_pylist(), own.batch([x or "" for x in some.column(1).to_pylist()]), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(ids)
                    held += len(ids) + 1
                    if held >= BLOCK_IDS:
                        yield row()
                        block, first, held, doc_ids, parts = block + 1, first + held, 0, [], []
        if id_type is not None:
            yield row(True)

    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, f"part int, block long, first long, n long, doc_ids array<{kind}>, lengths array<long>, width int, ids binary, counts binary")


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """Tokenise every whole text, append `end_id`, and write the file set in ascending order of ids to `path`.

    Null texts count as empty and give the end id alone; null ids come first; rows with one id follow the order of
    their texts' hashes. An empty table gives a set without blocks. Returns the ids that each part holds: one number
    a partition, however many documents there are.
    """
    with open(tokenizer_json, "rb") as f:
        data = f.read()
    plain = materialize(_encode(docs, data, end_id, id_col, text_col), "ids", "none")
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for column in batch.column(0):
                got = np.frombuffer(column.as_buffer(), dtype=np.int64)
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    # each part counted its ids as it wrote them; a row for each id of the vocabulary at most comes to the driver
    counts = plain.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(max([r["id"] for r in counts], default=0) + 1, dtype=np.int64)
    for r in counts:
        totals[r["id"]] = r["n"]
    freq = quantise(totals)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(freq) if x] or [(0, 1 << SCALE)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Rans(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column(7)[0].as_buffer(), dtype=f"<u{one.column(6)[0].as_py()}").astype(np.uint32)
                yield pa.record_batch([*one.columns[:6], pa.array([coder.encode(ids)], pa.binary())], names=["part", "block", "first", "n", "doc_ids", "lengths", "payload"])

    kind = dict(plain.dtypes)["doc_ids"]
    packed = plain.where("n > 0").drop("counts").mapInArrow(pack, f"part int, block long, first long, n long, doc_ids {kind}, lengths array<long>, payload binary")
    with tidy_writes(spark):
        packed.write.option("compression", "none").parquet(f"{path}/blocks")
    discard(plain)
    return {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()}


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from a file set: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for.

    Every block is decoded on its own and held against both of its checksums.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/table").collect()  # a row for each id of the vocabulary at most
    freq = np.zeros(max(r["id"] for r in stored) + 1, dtype=np.int64)
    for r in stored:
        freq[r["id"]] = r["freq"]
    before, at = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row for each part
        before[r["part"]], at = at, at + r["n"]
    shared = spark.sparkContext.broadcast((freq, before))
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = shared.value
        coder = Rans(table)
        for batch in batches:
            for i in range(batch.num_rows):
                part, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = coder.decode(batch.column(4)[i].as_buffer().to_pybytes())
                lengths = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = [batch.column(2)[i].values, pa.array(edges[:-1] + first + starts[part]), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("part", "first", "doc_ids", "lengths", "payload").mapInArrow(unpack, schema)


def token_files(docs: DataFrame, tokenizer_json: str, end_id: int = 0) -> DataFrame:
    """Write `docs` to a fresh file set in the shared folder and return what reading it back gives for each document."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_json, path, end_id)
    return read_token_files(docs.sparkSession, path)
