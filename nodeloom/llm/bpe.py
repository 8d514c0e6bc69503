"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The vocabulary's tokens form a trie; a nondeterministic state is a pair (token before, trie node), entered anew
whenever a token may end. Two tokens may stand side by side exactly when merging their joined bytes gives the two
back, which their merge histories decide; a sequence is the BPE encoding of its bytes exactly when all its neighbours
may, so one token sequence survives for every prefix. Sets of pairs are determinised on demand: (set, byte) leads to
(set, last token of the prefix). Tokens are emitted once all surviving sequences agree on them: at the latest after
a lookahead as long as the longest token's reach, at once where only one sequence survives.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered

ROOT, STATES, PIECES, MEMORY, LOOKAHEAD = 0, 200_000, 100_000, 400_000, 256
_FAR = 1 << 60
_NODE = (1 << 32) - 1


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A tiktoken file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = _FAR) -> list[bytes]:
    """Plain BPE by repeated lowest-ranked merges, leftmost first, among ranks under `below`; for tables and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, _FAR), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Token tables of a rank file, with the trie and the merge history that the transducer compiles from."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = parse_ranks(data)
        self.pattern = regex.compile(pattern)
        self.tokens: dict[int, bytes] = {i: b for b, i in self.ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = merge(token, self.ranks, rank)
                if len(parts) != 2:
                    continue  # merges never make it: only a match that is this very token gets it
                self.left[rank], self.right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                if key not in self.trie:
                    self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.trie[key]
            self.token_at[node] = rank

    def _spine(self, token: int, side: dict[int, int]) -> list[int]:
        """The tokens along one edge of the merge tree, from the single byte up."""
        out = [token]
        while out[-1] in side:
            out.append(side[out[-1]])
        return out[::-1]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined bytes is the two tokens.

        Replays both merge histories in order of rank; a merge across the border that comes first refutes it.
        """
        edge, face = self._spine(a, self.right), self._spine(b, self.left)
        i = j = 0
        while True:
            up = edge[i + 1] if i + 1 < len(edge) else _FAR
            down = face[j + 1] if j + 1 < len(face) else _FAR
            cross = self.ranks.get(self.tokens[edge[i]] + self.tokens[face[j]], _FAR)
            if cross < up and cross <= down:
                return False
            if up == down == _FAR:
                return True
            if up <= down:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes in, tokens out. State sets are built when first met and forgotten together when STATES are exceeded.

    A set is kept as the bytes of its pairs in order, eight a pair: the token before (or -1) above the trie node.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.sets: list[bytes] = [array("q", [-1 << 32 | ROOT]).tobytes()]
        self.number = {self.sets[0]: 0}
        self.moves: dict[int, int] = {}
        self.last = [-1]  # of each state: the token that ends its prefix
        self.sure = [True]  # of each state: whether one sequence survives

    def _step(self, state: int, byte: int) -> int:
        v, out, ends = self.v, [], -1
        for pair in memoryview(self.sets[state]).cast("q"):
            before, node = pair >> 32, pair & _NODE
            child = v.trie.get(node << 8 | byte)
            if child is None:
                continue
            out.append(before << 32 | child)
            token = v.token_at[child]
            if token >= 0 and ends < 0:
                key = before << 20 | token if before >= 0 else -1
                fits = True if key < 0 else self._pairs.get(key)
                if fits is None:
                    if len(self._pairs) > 2 * STATES:
                        self._pairs.clear()
                    fits = self._pairs[key] = v.adjacent(before, token)
                if fits:
                    ends = token
        found = array("q", [*sorted(out), ends << 32 | ROOT]).tobytes()
        target = self.number.get(found)
        if target is None:
            target = self.number[found] = len(self.sets)
            self.sets.append(found)
            self.last.append(ends)
            self.sure.append(not out)
        self.moves[state << 8 | byte] = target
        return target

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one whole piece, which is read in blocks: what is sure is emitted after each, so the states of a long piece are never held whole."""
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        return list(itertools.chain.from_iterable(self.stream(piece[i : i + LOOKAHEAD] for i in range(0, len(piece), LOOKAHEAD))))

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece given in blocks, each as soon as all surviving sequences share it."""
        if len(self.sets) > STATES:
            self._reset()
        moves, last, length = self.moves, self.last, self.v.tokens
        ends: list[int] = []  # the last token of every prefix since the last emission
        state = 0
        for block in blocks:
            for byte in block:
                target = moves.get(state << 8 | byte)
                state = self._step(state, byte) if target is None else target
                ends.append(last[state])
            if len(ends) > LOOKAHEAD:
                agreed = self._agreed(state, ends)
                if agreed:
                    done = sum(len(length[t]) for t in agreed)
                    del ends[:done]
                    yield agreed
        if ends:
            yield self._back(ends, len(ends))

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.v.tokens[ends[at - 1]])
        return out[::-1]

    def _agreed(self, state: int, ends: list[int]) -> list[int]:
        """The tokens that every surviving sequence has in common, from the start."""
        starts = {len(ends)}
        for pair in memoryview(self.sets[state]).cast("q"):
            node = pair & _NODE
            if node != ROOT:
                starts.add(len(ends) - self._depth(node))
        chains = [self._back(ends, at) for at in starts]
        out = []
        for tokens in zip(*chains, strict=False):
            if len(set(tokens)) > 1:
                break
            out.append(tokens[0])
        return out

    def _depth(self, node: int) -> int:
        if not hasattr(self, "_depths"):
            self._depths = [0] * len(self.v.token_at)
            for key, child in self.v.trie.items():  # parents come before children
                self._depths[child] = self._depths[key >> 8] + 1
        return self._depths[node]


def _utf8_moves() -> list[list[int]]:
    """The next state for each state and byte, after the definition of UTF-8.

    State 0 stands between characters; 1, 2 and 3 await that many continuation bytes; 4 to 7 follow E0, ED, F0 and F4,
    whose next byte has a range of its own; 8 is a byte that cannot stand there.
    """
    moves = [[8] * 256 for _ in range(9)]

    def put(state: int, low: int, high: int, target: int) -> None:
        moves[state][low : high + 1] = [target] * (high - low + 1)

    put(0, 0x00, 0x7F, 0)
    put(0, 0xC2, 0xDF, 1)
    put(0, 0xE0, 0xEF, 2)
    put(0, 0xF0, 0xF4, 3)
    for lead, state, low, high, target in ((0xE0, 4, 0xA0, 0xBF, 1), (0xED, 5, 0x80, 0x9F, 1), (0xF0, 6, 0x90, 0xBF, 2), (0xF4, 7, 0x80, 0x8F, 2)):
        put(0, lead, lead, state)
        put(state, low, high, target)
    for state in (1, 2, 3):
        put(state, 0x80, 0xBF, state - 1)
    return moves


_UTF8 = _utf8_moves()


class Utf8:
    """An incremental UTF-8 decoder: text of complete characters out, the bytes of a character that has begun kept.

    The state machine says where the last character begins and what it still awaits; it runs over the last three bytes
    of a block at most, since what lies before them is whole characters. Malformed bytes become U+FFFD as in Python's
    "replace".
    """

    def __init__(self) -> None:
        self.rest, self.state = b"", 0

    def _enter(self, data: bytes) -> int:
        """Set the state after `data`; how many bytes at its end belong to a character that further bytes may complete."""
        back = 1
        while back < min(4, len(data)) and data[-back] & 0xC0 == 0x80:
            back += 1
        self.state = 0
        for byte in data[-back:] if data else b"":
            self.state = _UTF8[self.state][byte]
            if self.state == 8:
                self.state = 0
                return 0
        return back if self.state else 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self._enter(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.rest, self.state = self.rest.decode("utf-8", "replace"), b"", 0
        return out


class Memory(dict):
    """A bounded memo in two generations: what was not used while `limit` new entries came is forgotten."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def flat(text: str) -> str | None:
    """A text whose parts between blanks are chunks; None if pattern matches might cross the cuts.

    No match holds white space behind other characters, so a match crosses a cut only inside a run of white space.
    Chunks but the first stand for a blank and themselves, those that begin with a line feed for themselves; the first
    is marked by a null character in front. Texts with unprintable characters, so all other white space, are not cut.
    """
    out = text.replace("\n", " \n")
    if "  " in out or "\n " in out or out[-1:].isspace() or not text.replace("\n", "").isprintable():
        return None
    return "\0" + out


def spoken(chunk: str) -> str:
    """The text that a chunk stands for."""
    return chunk if chunk[0] == "\n" else chunk[1:] if chunk[0] == "\0" else " " + chunk


class ChunkTable:
    """The ids of texts by way of their chunks, which are numbered by Arrow and remembered.

    Ids of all remembered chunks lie in one buffer; those of a batch of texts are gathered from it. `ask_chunks` gives
    the ids of chunk texts end to end, with the number of each; `ask_texts` those of texts that are not cut. When more
    than `most` chunks are known, those met in one batch only are forgotten, then those met in few.
    """

    def __init__(self, ask_chunks, ask_texts, kind, most: int = MEMORY):
        self.ask_chunks, self.ask_texts, self.kind, self.most = ask_chunks, ask_texts, kind, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"\0": 0}  # a text that begins with a blank: nothing comes before it
        self.start, self.size, self.met = (np.zeros(1024, dtype=k) for k in (np.int64, np.int32, np.int32))
        self.buffer, self.used = np.zeros(8192, dtype=self.kind), 0

    def _thin(self) -> None:
        count = len(self.known)
        need = 2
        while np.count_nonzero(self.met[1:count] >= need) > self.most // 2:
            need *= 2
        stays = self.met[:count] >= need
        stays[0] = True
        number = np.cumsum(stays) - 1
        flags, number = stays.tolist(), number.tolist()
        self.known = {c: number[i] for c, i in self.known.items() if flags[i]}
        size, start = self.size[:count][stays], self.start[:count][stays]
        ends = np.cumsum(size, dtype=np.int64)
        self.used = int(ends[-1])
        self.buffer = np.concatenate([self.buffer[np.repeat(start - (ends - size), size) + np.arange(self.used)], np.zeros(8192, dtype=self.kind)])
        self.start, self.size, self.met = ends - size, size, self.met[:count][stays] // 2

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        ids, sizes = self.ask_chunks([spoken(c) for c in new])
        first, count = len(self.known), len(new)
        if first + count > len(self.start):
            more = max(first + count, 2 * len(self.start)) - len(self.start)
            self.start, self.size, self.met = (np.pad(x, (0, more)) for x in (self.start, self.size, self.met))
        if self.used + len(ids) > len(self.buffer):
            self.buffer = np.pad(self.buffer, (0, max(len(ids), len(self.buffer))))
        self.buffer[self.used : self.used + len(ids)] = ids
        self.start[first : first + count] = np.cumsum(sizes) - sizes + self.used
        self.size[first : first + count] = sizes
        self.used += len(ids)
        self.known.update(zip(new, range(first, first + count), strict=True))

    def batch(self, texts: list[str], cut: list[bool] | None = None) -> list[np.ndarray]:
        """The ids of each text; those not to be cut, or that cannot be, are asked for whole."""
        flats = [flat(x) if cut is None or cut[k] else None for k, x in enumerate(texts)]
        whole = iter(self.ask_texts([x for x, c in zip(texts, flats, strict=True) if c is None]))
        if len(self.known) > self.most:
            self._thin()
        lists = pc.split_pattern(pa.array([c for c in flats if c is not None], pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        known = self.known
        self._learn([c for c in distinct if c not in known])
        place = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.met[place] += 1
        entry = place[numbered.indices.to_numpy()]
        size = self.size[entry]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.buffer[np.repeat(self.start[entry] - (ends - size), size) + np.arange(total)]
        borders = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
        found = iter([ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)])
        return [next(whole) if c is None else next(found) for c in flats]


def slices(batch: pa.RecordBatch, column: int = 1, rows: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `size` bytes of text at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (held + n > size or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


class Codec:
    """Texts to ids and back. Ids of short matches and of chunks between blanks are remembered, within bounds."""

    def __init__(self, data: bytes, pattern: str):
        self.v = Vocabulary(data, pattern)
        self.t = Transducer(self.v)
        self.pieces = Memory(lambda piece: tuple(self.t.encode(piece.encode("utf-8", "surrogatepass"))), PIECES)
        self.kind = np.uint16 if max(self.v.tokens, default=0) < 1 << 16 else np.uint32
        self.table = ChunkTable(self._chunks, lambda texts: [np.array(self._matches(x), dtype=self.kind) for x in texts], self.kind)
        top = max(self.v.tokens, default=-1) + 1
        self.numerals = pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.bytes_of = pa.array([self.v.tokens.get(i, b"") for i in range(top)], pa.large_binary())

    def _matches(self, text: str) -> tuple[int, ...]:
        found = self.v.pattern.findall(text)
        return self.pieces[found[0]] if len(found) == 1 else tuple(itertools.chain.from_iterable(map(self.pieces.__getitem__, found)))

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self._matches, texts))
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        return np.fromiter(itertools.chain.from_iterable(found), dtype=self.kind, count=int(sizes.sum())), sizes

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return self.table.batch(texts)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[0].tolist()

    @staticmethod
    def _joined(parts: pa.Array, ids: np.ndarray) -> memoryview:
        """The parts at `ids`, end to end."""
        if not len(ids):
            return memoryview(b"")
        taken = parts.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)
        return memoryview(taken.buffers()[2])[offsets[0] : offsets[-1]]

    def written(self, ids: np.ndarray) -> memoryview:
        """The ids in decimal, one blank between two."""
        return self._joined(self.numerals, ids)[:-1]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return self._joined(self.bytes_of, ids if isinstance(ids, np.ndarray) else np.array(ids, dtype=np.int64)).tobytes()

    def decode_stream(self, ids: Iterable[int] | np.ndarray, block: int = 65536) -> Iterator[str]:
        machine = Utf8()
        if isinstance(ids, np.ndarray):
            parts: Iterable = (ids[i : i + block] for i in range(0, len(ids), block))
        else:
            source = iter(ids)
            parts = iter(lambda: list(itertools.islice(source, block)), [])
        for some in parts:
            yield machine.feed(self.decode_bytes(some))
        yield machine.end()


def codec(data: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    kept = remembered("bpe")
    if key not in kept:
        kept.clear()
        kept[key] = Codec(data, pattern)
    return kept[key]


def read_vocabulary(path: str) -> bytes:
    """The file, read on the driver and shipped with the tasks: a vocabulary has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and lossless (whether the ids decode to the text) for every row.

    Null and empty texts have no ids. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for some in slices(batch):
                texts = [x or "" for x in some.column(1).to_pylist()]
                found = own.encode_batch(texts)
                lossless = ["".join(own.decode_stream(ids)) == x for ids, x in zip(found, texts, strict=True)]
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, []]).astype(np.int32)))
                yield pa.record_batch([some.column(0), pa.array(sizes), ids, pa.array(lossless, pa.bool_())], names=["doc_id", "n_tokens", "ids", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give a null text. Malformed bytes become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            texts = [None if ids is None else "".join(own.decode_stream(ids)) for ids in (x.as_py() for x in batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of the empty string. Rows are independent: repeated rows
    repeat, an empty table gives no rows, other columns are not read. One document is in memory at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for some in slices(batch):
                for ids in own.encode_batch([x or "" for x in some.column(1).to_pylist()]):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(own.written(ids)).hexdigest())
                    back = hashlib.sha256()
                    for part in own.decode_stream(ids):
                        back.update(part.encode("utf-8", "surrogatepass"))
                    decoded.append(back.hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.array(counts, dtype=np.int64)), pa.array(encoded, type=pa.string()), pa.array(decoded, type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
