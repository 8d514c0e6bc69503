"""Language-model scores by deleted interpolation of word n-grams.

The model mixes maximum-likelihood bigrams, unigrams and a uniform floor; how much of each depends on how frequent
the context is (buckets of its training count by powers of two). The weights are learned by expectation-maximisation
on held-out counts: each training token is deleted from the counts that predict it.

Counting and scoring never send a token twice. Documents are packed into chunks of a few megabytes with a local
vocabulary. Each chunk sends its sorted distinct word and word-pair hashes, with its own training counts, to the range
of hashes that owns them; the owner adds up and answers with one corpus-wide count for each. A frequent word is one
entry a chunk, so no word or pair makes a task large. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, materialize

#: Bytes of text in a chunk, and entries that an owner of a hash range adds up.
CHUNK_BYTES, OWNED = 16 << 20, 3_000_000
#: Context buckets (powers of two of the context's count), bins of log2 probability an octave, and EM rounds.
BUCKETS, FINE, ROUNDS = 40, 8, 60
FOLDS, HELD_OUT = 7, 2
#: The end token; it holds a blank, so no word equals it. It is also the context of a document's first token.
END = b"end of document"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two ordered word hashes."""
    x = context * _MIX ^ (word + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart so that the high zero bytes compress away."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


class Chunk:
    """Some documents: word hashes (sorted), the token stream as places among them, and the documents' lengths."""

    def __init__(self, hashes: np.ndarray, stream: np.ndarray, lengths: np.ndarray, trained: np.ndarray):
        self.hashes, self.stream, self.lengths = hashes, stream, lengths
        self.edges = np.concatenate([[0], np.cumsum(lengths)])
        context = np.empty_like(stream)
        context[1:] = stream[:-1]
        end = np.searchsorted(hashes, np.uint64(xxhash.xxh64_intdigest(END)))
        context[self.edges[:-1]] = end
        self.context = context
        self.pairs, self.pair_of = np.unique(_pair(hashes[context], hashes[stream]), return_inverse=True)
        learn = np.repeat(trained, lengths)
        self.learn = learn
        self.word_counts = np.bincount(stream[learn], minlength=len(hashes)).astype(np.uint32)
        self.pair_counts = np.bincount(self.pair_of[learn], minlength=len(self.pairs)).astype(np.uint32)

    @staticmethod
    def of(texts: list[bytes], trained: list[bool]) -> Chunk:
        places: dict[bytes, int] = {END: 0}
        stream: list[int] = []
        lengths = []
        for text in texts:
            words = text.lower().split()
            stream += [places.setdefault(w, len(places)) for w in words]
            stream.append(0)
            lengths.append(len(words) + 1)
        raw = np.fromiter(map(xxhash.xxh64_intdigest, places), dtype=np.uint64, count=len(places))
        hashes, place = np.unique(raw, return_inverse=True)
        return Chunk(hashes, place[np.array(stream, dtype=np.int64)].astype(np.uint32), np.array(lengths, dtype=np.int64), np.array(trained, dtype=bool))


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    """The ends of the owners' ranges among sorted hashes."""
    edges = (np.arange(1, owners, dtype=object) * (1 << 64) // owners).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        trained: list[bool] = []
        held, id_type = 0, None

        def row() -> pa.RecordBatch:
            chunk = Chunk.of(texts, trained)
            values = [[part << 32 | number], [ids], [trained], _pack(chunk.lengths), _pack_sorted(chunk.hashes), _pack(chunk.stream), [len(chunk.pairs) + len(chunk.hashes)]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.record_batch(
                [pa.array([v] if isinstance(v, bytes) else v, t) for v, t in zip(values, types, strict=True)],
                names=["chunk", "doc_ids", "trained", "lengths", "hashes", "stream", "entries"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(batch.column(0)[i].as_py())
                texts.append(text)
                trained.append(batch.column(2)[i].as_py() != HELD_OUT)
                held += len(text) + 64
                if held >= chunk_bytes:
                    yield row()
                    number, held, ids, texts, trained = number + 1, 0, [], [], []
        if ids:
            yield row()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), fold(id_col, FOLDS)).mapInArrow(
        run, f"chunk long, doc_ids array<{kind}>, trained array<boolean>, lengths binary, hashes binary, stream binary, entries long"
    )


def _load(row: dict) -> Chunk:
    return Chunk(_unpack_sorted(row["hashes"]), _unpack(row["stream"], "<u4"), _unpack(row["lengths"], "<i8"), np.array(row["trained"], dtype=bool))


def _requests(chunks: DataFrame, owners: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _load(row)
                for kind, hashes, counts in ((0, chunk.hashes, chunk.word_counts), (1, chunk.pairs, chunk.pair_counts)):
                    edges = _owner(hashes, owners)
                    for owner, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        if b > a:
                            yield pa.record_batch(
                                [pa.array([kind * owners + owner], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([_pack_sorted(hashes[a:b])], pa.binary()), pa.array([_pack(counts[a:b])], pa.binary())],
                                names=["owner", "chunk", "hashes", "counts"],
                            )

    return chunks.select("chunk", "trained", "lengths", "hashes", "stream").mapInArrow(run, "owner int, chunk long, hashes binary, counts binary")


def _answer(owners: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        owner = group.column("owner")[0].as_py()
        asked = [_unpack_sorted(x.as_py()) for x in group.column("hashes")]
        own = np.concatenate([_unpack(x.as_py(), "<u4") for x in group.column("counts")]).astype(np.int64)
        every, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(every), dtype=np.int64)
        np.add.at(total, place, own)
        answers, at = [], 0
        for some in asked:
            answers.append(_pack(total[place[at : at + len(some)]]))
            at += len(some)
        n = len(answers)
        words = owner < owners
        first = np.arange(n) == 0
        return pa.table(
            {
                "chunk": group.column("chunk"), "owner": group.column("owner"), "totals": pa.array(answers, pa.binary()),
                "tokens": pa.array(np.where(first & words, int(total.sum()), 0)), "types": pa.array(np.where(first & words, int((total > 0).sum()), 0)),
            }
        )

    return run


def _joined(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with the answers to it: one row of the chunk, one for each owner it asked."""
    kind = dict(chunks.dtypes)["doc_ids"]
    blank = F.lit(None)
    left = chunks.select("chunk", F.lit(-1).alias("owner"), blank.cast("binary").alias("totals"), "doc_ids", "trained", "lengths", "hashes", "stream")
    right = answers.select("chunk", "owner", "totals", blank.cast(kind).alias("doc_ids"), blank.cast("array<boolean>").alias("trained"), *[blank.cast("binary").alias(c) for c in ("lengths", "hashes", "stream")])
    return left.unionByName(right)


def _counted(group: pa.Table, owners: int) -> tuple[dict, Chunk, np.ndarray, np.ndarray]:
    """The chunk of a group and the corpus-wide counts of its words and pairs."""
    rows = sorted(group.to_pylist(), key=lambda r: r["owner"])
    chunk = _load(rows[0])
    counts = [np.concatenate([_unpack(r["totals"], "<i8") for r in rows[1:] if (r["owner"] >= owners) == kind] or [np.zeros(0, np.int64)]) for kind in (False, True)]
    return rows[0], chunk, *counts


def bucket(counts: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: 0 if never seen, else one more than the whole part of log2."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """Probabilities to 1/FINE octaves; zero has a bin of its own."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-np.log2(np.maximum(p, 1e-300)) * FINE), 1000), 1023).astype(np.int64)


def _deleted(owners: int, n_tokens: int):
    """Counts of (bucket, bigram bin, unigram bin) of training tokens, each deleted from the counts that predict it."""

    def run(group: pa.Table) -> pa.Table:
        _, chunk, words, pairs = _counted(group, owners)
        learn = chunk.learn
        c_h, c_w, c_hw = (x[learn] for x in (words[chunk.context], words[chunk.stream], pairs[chunk.pair_of]))
        two = (c_hw - 1) / np.maximum(c_h - 1, 1)
        one = (c_w - 1) / max(n_tokens - 1, 1)
        key, n = np.unique(bucket(c_h - 1) << 20 | _bin(two) << 10 | _bin(one), return_counts=True)
        return pa.table({"key": pa.array(key), "n": pa.array(n.astype(np.int64))})

    return run


def learn_weights(key: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of every bucket, by expectation-maximisation on deleted counts.

    A bucket starts from equal weights; one without tokens keeps those of all buckets together. The unseen context
    has no bigram.
    """
    where, bins = key >> 20, np.stack([key >> 10 & 1023, key & 1023])
    p = np.where(bins == 1023, 0.0, 2.0 ** (-bins / FINE))
    p = np.vstack([p, np.full(p.shape[1], 1 / (types + 1))])
    n = n.astype(float)
    out = np.tile([0.0, 0.999, 0.001], (BUCKETS, 1))

    def fit(some: np.ndarray, bigram: bool) -> np.ndarray:
        weight = np.array([1.0, 1.0, 1.0]) if bigram else np.array([0.0, 1.0, 1.0])
        weight /= weight.sum()
        for _ in range(ROUNDS):
            share = weight[:, None] * p[:, some]
            share /= np.maximum(share.sum(axis=0), 1e-300)
            weight = (share * n[some]).sum(axis=1) / max(n[some].sum(), 1e-300)
            weight = np.maximum(weight, [0 if not bigram else 1e-9, 1e-9, 1e-9])
            weight /= weight.sum()
        return weight

    if len(key):
        out[:] = fit(np.ones(len(key), dtype=bool), True)
        out[0] = fit(np.ones(len(key), dtype=bool), False)
        for b in range(1, BUCKETS):
            if (where == b).any():
                out[b] = fit(where == b, True)
    return out


def _scored(owners: int, n_tokens: int, n_types: int, weights: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        row, chunk, words, pairs = _counted(group, owners)
        base = np.log10((words + 1) / (n_tokens + 1.0 * (n_types + 1)))[chunk.stream]
        c_h = words[chunk.context]
        w = weights[bucket(c_h)]
        p = w[:, 0] * (pairs[chunk.pair_of] / np.maximum(c_h, 1)) + w[:, 1] * (words[chunk.stream] / max(n_tokens, 1)) + w[:, 2] / (n_types + 1)
        starts = chunk.edges[:-1]
        known = np.add.reduceat((words[chunk.stream] > 0).astype(np.int64), starts)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], group.schema.field("doc_ids").type.value_type),
                "held_out": pa.array([not t for t in row["trained"]]), "n_tokens": pa.array(chunk.lengths), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(starts), n_tokens)), "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts)),
            }
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, owned: int = OWNED) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every whole text counts, A-Z lowered: its words, then one end token. Rows with fold(doc_id, 7) = 2 are scored but
    never learned from; null ids are learned from. Null and empty texts are the end token alone. Without training rows
    N and V are zero: base_score stays defined and the model is uniform up to its floor. Repeated rows all count.
    An empty table gives no rows; other columns are not read.
    """
    chunks = materialize(_chunks(docs, id_col, text_col, chunk_bytes), "chunks")
    entries = chunks.agg(F.sum("entries").alias("n")).first()["n"] or 0
    owners = max(1, -(-entries // owned))
    answered = _requests(chunks, owners).groupBy("owner").applyInArrow(_answer(owners), "chunk long, owner int, totals binary, tokens long, types long")
    answers = materialize(answered, "answers")
    totals = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n_tokens, n_types = totals["tokens"] or 0, totals["types"] or 0
    joined = _joined(chunks, answers)
    deleted = joined.groupBy("chunk").applyInArrow(_deleted(owners, n_tokens), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    deleted = materialize(deleted, "deleted")
    # bins of buckets and probabilities: their number has a bound that does not depend on the corpus
    bins = deleted.toPandas()
    discard(deleted)
    weights = learn_weights(bins["key"].to_numpy(dtype=np.int64), bins["n"].to_numpy(), n_types)
    kind = dict(chunks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.groupBy("chunk").applyInArrow(_scored(owners, n_tokens, n_types, weights), schema)
