"""Sum-of-squares online packing of token sequences into windows of a fixed length."""

from __future__ import annotations

import functools
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from gridlark.llm import pretokens
from gridlark.llm.common import releasing, ship, slices
from gridlark.llm.token_counts import byte_symbols

CACHE_ENTRIES = 300_000
OPEN_BITS = 33


class Encoder(dict):
    """Key of a chunk of text -> its ids as little-endian 32-bit bytes, and how to encode whole texts with that.

    The vocabulary is read from a tokenizers file. Chunks that aren't known yet are encoded by the tiktoken library with the
    vocabulary's ids as ranks, which gives the same ids (tests compare them) in a fifth of the time.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        of = byte_symbols()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.one = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, key: str) -> bytes:
        self[key] = ids = array("I", self.one(pretokens.raw(key))).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        get, out = self.__getitem__, []
        for x in pretokens.segments(text, self.special):
            out.append(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, pretokens.chunks(x))))
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows of `size` tokens under the sum-of-squares rule.

    level[f] is the number of open windows filled up to f, 0 < f < size. A piece of n tokens may go to any open
    window with room, or to a new one; it goes where the sum of the squares of `level` gets smallest, ties to the
    fullest window. At most `most_open` windows stay open: the fullest then is closed by cutting the next piece to
    the room that is left, so that no window but those of finish() is padded.
    """

    def __init__(self, size: int, most_open: int = 256) -> None:
        self.size, self.most_open, self.n_open, self.next = size, most_open, 0, 0
        self.level = np.zeros(size + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(size)]

    def best(self, n: int) -> int:
        """The fill to put n < size tokens on; 0 is a new window."""
        level, size = self.level, self.size
        fills = np.flatnonzero(level[: size - n + 1])
        fills = fills[fills > 0]
        # the change of the sum of squares: a window leaves its level, and arrives at fill + n unless that is full
        after = fills + n
        gain = 1 - 2 * level[fills] + np.where(after < size, 1 + 2 * level[after], 0)
        new = 1 + 2 * level[n]
        if not len(fills):
            return 0
        k = len(gain) - 1 - int(np.argmin(gain[::-1]))
        return int(fills[k]) if gain[k] <= new else 0

    def put(self, n: int) -> list[tuple[int, int, int]]:
        """Where a document's n tokens go: (length, window, offset) in order."""
        out = []
        while n >= self.size:
            out.append((self.size, self.next, 0))
            self.next, n = self.next + 1, n - self.size
        if n:
            fill = self.best(n)
            if not fill and self.n_open >= self.most_open:
                fill = int(np.flatnonzero(self.level[: self.size])[-1])
                out.append(self._add(fill, self.size - fill))
                if n - out[-1][0] > 0:
                    out += self.put(n - out[-1][0])
            else:
                out.append(self._add(fill, n))
        return out

    def _add(self, fill: int, n: int) -> tuple[int, int, int]:
        if fill:
            window = self.windows[fill].pop()
            self.level[fill] -= 1
            self.n_open -= 1
        else:
            window, self.next = self.next, self.next + 1
        if fill + n < self.size:
            self.windows[fill + n].append(window)
            self.level[fill + n] += 1
            self.n_open += 1
        return n, window, fill


def rebalance(pieces: list[list[int]], size: int) -> list[list[int]]:
    """Cut the pieces of windows that stayed open so that all but the last one are full.

    pieces: [row, start, length, window, offset]; the windows of the result are numbered as those that came in.
    """
    windows = sorted({p[3] for p in pieces})
    out, k, fill = [], 0, 0
    for row, start, length, _, _ in sorted(pieces, key=lambda p: (p[3], p[4])):
        while length:
            n = min(length, size - fill)
            out.append([row, start, n, windows[k], fill])
            start, length, fill = start + n, length - n, fill + n
            if fill == size:
                k, fill = k + 1, 0
    return out


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, most_open: int = 256) -> DataFrame:
    """Pieces of the tokenized documents of df, packed into sequences of at most `size` tokens.

    Columns: key, start, length, ids (array<int>: the piece's token ids), ids_crc32, doc_tokens, sequence_id, offset. A document is its ids
    and then end_id; a null text is empty, so that it has end_id alone. Each id lies in exactly one piece; offsets in
    a sequence have no gap. A null key is kept as null; repeated rows are packed each. An empty table gives no rows. Columns of df other than key
    and text are not read.

    Every task packs its own rows: no shuffle, memory of at most most_open open windows of at most `size` tokens and
    a slice of texts. Only the last sequence of a task is not full. sequence_id is the task's number << 33 plus the number of the sequence in
    the task, so a task that runs again gives the same ids if its rows come in the same order, as from files.
    """
    ship(df.sparkSession)
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])
    end = end_id.to_bytes(4, "little")
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        first = TaskContext.get().partitionId() << OPEN_BITS
        library, packer = encoder(path), Packer(size, most_open)
        held: dict[int, list[tuple]] = {}
        kind = None

        def batch_of(pieces):
            cols = list(zip(*pieces, strict=True))
            flat = np.frombuffer(b"".join(cols[3]), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.array(cols[2], np.int64))].astype(np.int32)), pa.array(flat))
            arrays = [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), ids]
            arrays += [pa.array([zlib.crc32(x) for x in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()), pa.array([first + w for w in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *[n for n, _ in fields]])

        for batch in batches:
            kind = batch.schema.field("key").type
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ready = []
                for k, one in zip(keys[a:b], texts[a:b], strict=True):
                    ids = library.encode(one) + end
                    total, start = len(ids) // 4, 0
                    for n, window, offset in packer.put(total):
                        piece = (k, start, n, ids[4 * start : 4 * (start + n)], total, window, offset)
                        if n == size:
                            ready.append(piece)
                        else:
                            held.setdefault(window, []).append(piece)
                            if offset + n == size:
                                ready += held.pop(window)
                        start += n
                if ready:
                    yield batch_of(ready)
        rest = [p for w in sorted(held) for p in held[w]]
        if rest:
            cut = rebalance([[i, 0, p[2], p[5], p[6]] for i, p in enumerate(rest)], size)
            yield batch_of([(rest[i][0], rest[i][1] + s, n, rest[i][3][4 * s : 4 * (s + n)], rest[i][4], w, o) for i, s, n, w, o in cut])

    return rows.mapInArrow(releasing(run), schema)
