"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlark.llm import pretokens
from gridlark.llm.common import ship, slices

CACHE_ENTRIES = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by a rule, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Merge table of a byte-level BPE vocabulary, sorted for binary search by pair."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.of_byte[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair; a number beyond all ranks where it isn't a merge."""
        none = len(self.key)
        if not len(left):
            return np.zeros(0, np.int64)
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, want), none - 1)
        return np.where(self.key[at] == want, self.rank[at], none)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive all merges, and the word of each: every round, each word applies its own lowest-rank pair
        at all places where it stands (from the left where they overlap), all words of the array at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_seq, none = [], [], len(self.key)
        while len(sym):
            rank = np.full(len(sym), none, np.int64)
            same = np.flatnonzero(seq[:-1] == seq[1:])
            rank[same] = self.ranks(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            low_each = np.repeat(low, size)
            if (low == none).any():
                ended = low_each == none
                done_sym.append(sym[ended])
                done_seq.append(seq[ended])
                sym, seq, rank, low_each = (x[~ended] for x in (sym, seq, rank, low_each))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low_each)
            # of adjacent hits (a symbol repeated) only every second one, from the left of its run, can merge
            new = np.r_[True, np.diff(hit) > 1]
            run = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out_sym, out_seq = np.concatenate(done_sym), np.concatenate(done_seq)
        order = np.argsort(out_seq, kind="stable")
        return out_sym[order], out_seq[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(self.merged(words)[1], minlength=len(words)) if words else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


class Counter(dict):
    """Chunk of text -> number of tokens, filled for many chunks at once and emptied when full."""

    def __init__(self, merger: Merger) -> None:
        super().__init__()
        self.merger = merger

    def learn(self, chunks: set[str]) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [c for c in chunks if c not in self]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            words = [pretokens.find(pretokens.raw(c)) for c in part]
            distinct = list(dict.fromkeys(w for ws in words for w in ws))
            # a word is counted as a whole, however long; only the number of words held at once is bounded
            size, start, known = 0, 0, {}
            for i, w in enumerate(distinct):
                size += len(w)
                if size > 1 << 20 or i + 1 == len(distinct):
                    block = distinct[start : i + 1]
                    known.update(zip(block, self.merger.counts([x.encode() for x in block]).tolist(), strict=True))
                    start, size = i + 1, 0
            self.update((c, sum(known[w] for w in ws)) for c, ws in zip(part, words, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        special = self.merger.special
        parts = [[x if isinstance(x, int) else pretokens.chunks(x) for x in pretokens.segments(t, special)] for t in texts]
        self.learn({c for p in parts for x in p if not isinstance(x, int) for c in x})
        return [sum(1 if isinstance(x, int) else sum(map(self.__getitem__, x)) for x in p) for p in parts]


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """df with the bytes (UTF-8) and tokens of a text column, and whether it has more than `limit` tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Columns of df that have a name of `out` are replaced; all
    others are kept. Repeated rows are counted each. Narrow: no shuffle, one pass, memory bounded by the cache and
    by a slice of texts (a single text is never cut).
    """
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in out])
    schema = kept.select("*", F.lit(0).cast("long").alias(out[0]), F.lit(0).cast("long").alias(out[1]), F.lit(True).alias(out[2])).schema

    def count(batches):
        known = Counter(merger(path))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            tokens: list[int] = []
            for a, b in slices(texts):
                tokens += known.count(texts[a:b])
            size = [len(t.encode()) for t in texts]
            more = [pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *out])

    return kept.mapInArrow(count, schema)
