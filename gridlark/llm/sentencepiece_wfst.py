"""SentencePiece models as weighted finite-state transducers: shortest paths encode, the inverse decodes."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlark.llm.common import ship

CACHE_ENTRIES = 700_000
FOLLOW_ENTRIES = 600_000
SPACE = "▁"
INFINITE = float("inf")
SIGNS = ",.;:!?%*$#&|\"=+(){}[]<>/\\@~^`"

# Numbers of message fields and piece types in the public model format.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_TYPE, TRAINER_BYTE_FALLBACK, TRAINER_WS_SUFFIX = 3, 35, 24
NORMALIZER_CHARSMAP, NORMALIZER_DUMMY, NORMALIZER_TRIM, NORMALIZER_ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of each field of a protocol buffers message: an int, or bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind, number = tag & 7, tag >> 3
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield number, data[at : at + n]
            at += n


class Transducer:
    """Normaliser, pieces and byte fallback of a model, composed with one input at a time.

    The normaliser's transducer writes the dummy prefix and U+2581 for spaces. The pieces' transducer reads the result and writes ids:
    an arc per piece with weight -score, and where no piece is a character, arcs that write its bytes' ids. In a unigram model the path of
    least weight in the tropical semiring is the encoding. In a BPE model the arcs' states also remember the last piece, and an
    arc leads on only where the two pieces, side by side, are what the merges make of them; a text has exactly one such path
    (locally consistent segmentations are the BPE segmentation), and it is the one of least weight.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(b"".join(v for k, v in model if k == MODEL_TRAINER)))
        normalizer = dict(fields(b"".join(v for k, v in model if k == MODEL_NORMALIZER)))
        self.kind = trainer.get(TRAINER_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(NORMALIZER_CHARSMAP) or trainer.get(TRAINER_WS_SUFFIX):
            raise ValueError("only unigram and BPE models with the identity normaliser are compiled")
        self.dummy, self.trim = bool(normalizer.get(NORMALIZER_DUMMY, 1)), bool(normalizer.get(NORMALIZER_TRIM, 1))
        self.text_of, self.type_of, self.cost, self.bytes, self.unknown = [], [], {}, {}, 0
        for _, piece in (x for x in model if x[0] == MODEL_PIECES):
            p = dict(fields(piece))
            text, kind, i = p[PIECE_TEXT].decode(), p.get(PIECE_TYPE, NORMAL), len(self.text_of)
            self.text_of.append(text)
            self.type_of.append(kind)
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (NORMAL, USER):
                self.cost[text] = (-struct.unpack("<f", p.get(PIECE_SCORE, bytes(4)))[0], i)
        self.fallback = bool(trainer.get(TRAINER_BYTE_FALLBACK)) and len(self.bytes) == 256
        self.worst = max((c for c, _ in self.cost.values()), default=0.0) + 10.0
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # parts of a text can be composed on their own where no piece goes over the place between: before spaces, and between a letter and signs
        # that no piece has right after a letter
        met = {(a, b) for t in self.cost for a, b in zip(t, t[1:], strict=False)}
        signs = {b for b in SIGNS if not any(x == b and a.isalpha() for a, x in met)}
        cut = "".join(map(re.escape, sorted(signs)))
        self.parts = re.compile((f"{SPACE}*[^{SPACE}]*?[^\\W\\d_](?=[{cut}])|" if cut else "") + f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words = not any(b == SPACE != a for a, b in met)
        self.plain = [" \u2047 " if k == UNKNOWN else "" if k in (BYTE, CONTROL) else t.replace(SPACE, " ") for t, k in zip(self.text_of, self.type_of, strict=True)]
        self.starts = {t[:k] for t in self.cost for k in range(1, len(t))}
        self.known: dict[str, bytes] = {}
        self.is_byte = np.array([k == BYTE for k in self.type_of])
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_follows = 0
        self.built: dict[str, tuple[list[tuple[float, str, str]], bool]] = {}

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).replace(" ", SPACE)

    def steps(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """How the merges build a piece from its characters: per step its cost and the first and last symbol before it; and whether they build it
        whole. Again and again the adjacent pair whose union is the best piece is merged, the first of equals."""
        if (known := self.built.get(piece)) is not None:
            return known
        symbols, out = list(piece), []
        while len(symbols) > 1:
            best = min(((self.cost[a + b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.cost), default=None)
            if best is None:
                break
            out.append((best[0], symbols[0], symbols[-1]))
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        found = self.built[piece] = (out, len(symbols) == 1)
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the merges leave two pieces side by side as they are: each side's own steps run in the order of cost, and at no
        point is the union of the symbols that meet the best piece there is (of equals the leftmost goes first)."""
        (a, whole_a), (b, whole_b) = self.steps(left), self.steps(right)
        if not (whole_a and whole_b):
            return False
        i = j = 0
        while True:
            ca, last = (a[i][0], a[i][2]) if i < len(a) else (INFINITE, left)
            cb, first = (b[j][0], b[j][1]) if j < len(b) else (INFINITE, right)
            across = self.cost.get(last + first)
            if across is not None and across[0] < ca and across[0] <= cb:
                return False
            if ca <= cb:
                if ca == INFINITE:
                    return True
                i += 1
            else:
                j += 1

    def shortest(self, text: str) -> list[str]:
        """The pieces of the path of least weight through the composition with a text."""
        return self.shortest_bpe(text) if self.kind == BPE else self.shortest_unigram(text)

    def shortest_unigram(self, text: str) -> list[str]:
        n, cost, starts, worst = len(text), self.cost, self.starts, self.worst
        best: list[float] = [0.0] + [INFINITE] * n
        back: list[str] = [""] * (n + 1)
        for at in range(n):
            if text[at] not in cost and best[at] + worst < best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + worst, text[at]
            for end in range(at + 1, n + 1):
                piece = text[at:end]
                if (found := cost.get(piece)) is not None and best[at] + found[0] < best[end]:
                    best[end], back[end] = best[at] + found[0], piece
                if piece not in starts:
                    break
        return self.trace(text, back)

    def shortest_bpe(self, text: str) -> list[str]:
        """A place has at most one state, as a text's beginning has one consistent segmentation."""
        n, cost, starts, follows = len(text), self.cost, self.starts, self.follows
        back: list[str] = [""] * (n + 1)
        for at in range(n):
            last = back[at]
            if at and not last:
                continue
            if (after := follows.get(last)) is None:
                after = follows[last] = {}
            end = at + 1
            piece = text[at]
            while True:
                if (good := after.get(piece)) is None:
                    # what isn't a piece leads nowhere, but for single characters, which bytes stand for
                    known = piece in cost or end == at + 1
                    good = after[piece] = known and (self.may_follow(last, piece) if at else self.steps(piece)[1])
                    self.n_follows += 1
                if good:
                    back[end] = piece
                if end == n or piece not in starts:
                    break
                end += 1
                piece = text[at:end]
        if self.n_follows > FOLLOW_ENTRIES:
            follows.clear()
            self.n_follows = 0
        return self.trace(text, back)

    def trace(self, text: str, back: list[str]) -> list[str]:
        out, at = [], len(text)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def ids(self, word: str) -> bytes:
        out: list[int] = []
        for piece in self.shortest(word):
            if piece in self.cost:
                out.append(self.cost[piece][1])
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, 32-bit."""
        text = self.normalise(text)
        out, known = [], self.known
        for word in self.parts(text) if self.words else [text] if text else []:
            if (found := known.get(word)) is None:
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                found = self.ids(word)
                if len(word) <= 64:
                    known[word] = found
            out.append(found)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The inverse: pieces' texts with spaces for U+2581, bytes put together as UTF-8 (U+FFFD for what isn't), without the dummy prefix.
        Control pieces write nothing; ids that aren't in the model are an error."""
        plain, out, raw = self.plain, [], bytearray()
        ids = np.asarray(ids, np.int32)
        if len(ids) and ids.min() < 0:
            raise IndexError("negative id")
        if not self.is_byte[ids].any():
            return self.without_prefix("".join(map(plain.__getitem__, ids.tolist())))
        for i in ids.tolist():
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(plain[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return self.without_prefix("".join(out))

    def without_prefix(self, text: str) -> str:
        return text[1:] if self.dummy and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of a text column as an array column.

    A null text gives null, an empty one an empty array. No begin, end or added tokens; texts of special pieces count as
    ordinary text. A column of df named `out` is replaced; others are kept; repeated rows are encoded each. Narrow, no shuffle.
    """
    return mapped(df, path, text, out, "array<int>", pa.list_(pa.int32()), lambda t, x: t.encode(x))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of an array column of ids; null gives null, an empty array an empty text. Otherwise as encode()."""
    return mapped(df, path, ids, out, "string", pa.string(), lambda t, x: t.decode(x))


def mapped(df: DataFrame, path: str, source: str, out: str, kind: str, arrow: pa.DataType, f) -> DataFrame:
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c != out or c == source])
    names = [c for c in kept.columns if c != out]
    schema = kept.select(*names, F.lit(None).cast(kind).alias(out)).schema

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                values = part.column(part.schema.get_field_index(source)).to_pylist()
                made = pa.array([None if x is None else f(t, x) for x in values], arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], made], names=[*names, out])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids_crc32, text_crc32, same) per row: the ids' number and CRC-32 (little-endian 32-bit), the CRC-32 of the text
    decoded from them, and whether that is the text. A null text counts as empty. Repeated rows and null keys give rows each."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = [key, "n_ids", "ids_crc32", "text_crc32", "same"]
    schema = rows.select(F.col("key").alias(key), *[F.lit(0).cast("long").alias(n) for n in names[1:4]], F.lit(True).alias("same")).schema

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = []
                for x in part.column(1).to_pylist():
                    ids = t.encode(x or "")
                    back = t.decode(ids)
                    found.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (x or "")))
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.bool_())], names=names)

    return rows.mapInArrow(run, schema)
