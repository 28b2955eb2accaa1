"""Near duplicates by MinHash: an inverted join over signature coordinates, confirmed on the whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlark.llm.common import mix64, releasing
from gridlark.llm.jaccard import CROWD, REGION_PAIRS, SHORT, Posting, jaccard_components

WORDS = 2
PERCENT = 80
COORDINATES = 128
MATCHES = 76
COMMON_AT = 8
_PART = 4096


class Signer:
    """Sets of 64-bit hashes -> MinHash signatures: for each coordinate the smallest of a hash of its own over the set."""

    def __init__(self, coordinates: int = COORDINATES) -> None:
        seeds = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
        self.times, self.plus = seeds[:coordinates, None] | np.uint64(1), seeds[coordinates:, None]
        self.place = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)

    def values(self, s: np.ndarray) -> np.ndarray:
        """The upper 32 bits of each coordinate's minimum."""
        low = np.full(len(self.place), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(s), _PART):
                low = np.minimum(low, (s[None, a : a + _PART] * self.times + self.plus).min(axis=1))
        return low >> np.uint64(32)

    def tokens(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A set's coordinate-value pairs as 64-bit numbers, in order, and a byte of each value."""
        if not len(s):
            return s, b""
        v = self.values(s)
        return np.sort(mix64(self.place | v)), (v & np.uint64(255)).astype(np.uint8).tobytes()


def matching(least: int):
    """Keeps pairs whose signatures agree in `least` coordinates or more, by a byte of each: never fewer than really agree."""

    def keep(pairs: DataFrame, x: str, y: str, points: DataFrame) -> DataFrame:
        for end, name in ((x, "sx"), (y, "sy")):
            pairs = pairs.join(points.select(F.col("doc").alias(end), F.col("sig").alias(name)), end)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
                    yield batch.filter(pa.array((u == v).sum(axis=1) >= least)).drop_columns(["sx", "sy"])

        rest = pairs.drop("sx", "sy")
        return pairs.select(*rest.columns, "sx", "sy").mapInArrow(releasing(run), rest.schema)

    return keep


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, common_at: int = COMMON_AT, region_pairs: int = REGION_PAIRS, crowd: int = CROWD, short: int = SHORT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each document: the components of links of Jaccard similarity of percent / 100 or more between sets of distinct
    `words`-word shingles. kept: the document is the smallest of its component.

    1. A document's signature has `coordinates` values. Two sets of similarity j agree in a coordinate with probability j, so at 0.8 and the defaults in 102 of 128, with a deviation of 4.5;
       a pair is kept if at least `matches` = 76 agree, and lost with a probability under 1e-7.
    2. Documents are posted under coordinate-value pairs. Signatures that agree in `matches` places share one of the first coordinates - matches + 1 pairs of
       either in any order of all pairs, so only those are posted; frequent pairs come last in that order, so that long lists are skipped
       but by documents made of them.
    3. A list of up to `short` documents pairs all whose sizes allow a link; in a longer one all meet the first, and pairs
       among the others are made only where they aren't in one component yet, within the same bounds as in the exact join (see jaccard_components). Pairs are counted over their whole
       signatures, and those above the threshold are confirmed on the whole sets.

    Documents without words, or with a null text, have empty sets, link with nothing and are kept. Rows with a null key come back with a null component and are kept; rows of one key are
    one node. Equal sets always link. Other columns aren't read. An empty table gives no rows.
    """
    signer = Signer(coordinates)
    prefix = coordinates - matches + 1
    posting = Posting(signer.tokens, lambda n: prefix, F.lit(prefix), common_at, matching(matches))
    found = jaccard_components(docs, key, text, words, percent, region_pairs=region_pairs, crowd=crowd, short=short, posting=posting)
    out = found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    out.needs = found.needs
    return out
