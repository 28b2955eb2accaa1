"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.llm.common import discard, materialize, releasing, ship

MAX_LABELLED = 50_000
SURE = 3.0
HELD_TERMS = 100_000

# Letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = "аaвbеeкkмmнhоoрpсcтtуyхxіiјjѕsԁdԛqԝwɡgοoαaεeιiκkνvρpτtυuχxηnωwϲcһhӏlʟlıi"
DIGITS = "0o1i3e4a5s7t8b9g@a$s!i"


def pairs(text: str) -> dict[str, str]:
    return dict(zip(text[::2], text[1::2], strict=True))


FOLD = str.maketrans(pairs(HOMOGLYPHS) | {chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
SUBSTITUTED = pairs(DIGITS)
_WORD = re.compile(r"(?:[@$!]+(?=[^\W\d_]))?[^\W_]+(?:(?:[@$]+|!)[^\W_]+)*(?:[@$]+(?![^\W_]))?|[@$]{3,}")
_BARE = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
_LETTERS = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[@$!]")
_HAS_SIGN = re.compile(r"[0-9@$!]")
_FOLDED = re.compile("[" + "".join(map(chr, FOLD)) + "]")
_UNFOLD = str.maketrans(SUBSTITUTED)


def fold_word(word: str) -> str:
    """Digits and signs between letters stand for letters; a word of digits alone stays."""
    return word.translate(_UNFOLD) if _HAS_SIGN.search(word) and not word.isdigit() else word


def plain(text: str) -> str:
    """The text in lower case, with compatibility forms and letters that look like Latin ones taken back."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).lower()
    return text.translate(FOLD) if _FOLDED.search(text) else text


def cut(text: str) -> list[str]:
    """The words of a plain() text before substituted signs are taken back: a word can start with, hold and end with signs written for letters."""
    return (_WORD if _SIGN.search(text) else _LETTERS).findall(text)


def fold(text: str) -> list[str]:
    """The folded words of a text: compatibility forms, case, accents' homoglyphs and substituted digits and signs taken back."""
    return readings(text)[0]


def readings(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The folded words of a text, and where a sign may also be no letter (`@idiot`, `idiot$`) the other reading of the whole text, each word with its place in the
    first; without such signs the other reading is empty."""
    text = plain(text)
    raw = cut(text)
    if not _HAS_SIGN.search(text):
        return raw, []
    words = [fold_word(w) for w in raw]
    signed = {i: bare for i, w in enumerate(raw) if not w.isalnum() and (bare := _BARE.findall(w)) != [w]} if _SIGN.search(text) else {}
    if not signed:
        return words, []
    return words, [(i, w) for i, x in enumerate(words) for w in (map(fold_word, signed[i]) if i in signed else (x,))]


@dataclass(frozen=True)
class Lexicon:
    """Folded phrases with their weights, phrases that are exceptions, and the line that turns a text's weight into a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = 0.0


class Matcher:
    """Aho-Corasick over ` word word `, so that only whole words match. A match inside a match of an exception doesn't count."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.machine = lexicon, ahocorasick.Automaton()
        for phrase, w in lexicon.weights.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, w))
        for phrase in lexicon.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, words: list[str]) -> list[tuple[int, int, float | None]]:
        """(first place, place after the last, weight or None for an exception) of all matches, in words."""
        text, starts = " " + " ".join(words) + " ", {}
        matches = [(end - n + 1, end, w) for end, (n, w) in self.machine.iter(text)] if len(self.machine) and words else []
        if matches:
            at = 0
            for i, w in enumerate(words):
                starts[at] = i
                at += len(w) + 1
            starts[at] = len(words)
        return [(starts[a], starts[b], w) for a, b, w in matches]

    def weight(self, words: list[str], other: list[tuple[int, str]] = ()) -> tuple[float, int]:
        """The weight of all matches by the text's length, and how many there are.

        Length counts as 1 + log2(1 + words / 100): a long text needs more for the same score, but one insult isn't diluted away. Matches of the
        other reading count where it differs and the first has none.
        """
        if not len(self.machine) or not words:
            return 0.0, 0
        hits = self.counted(self.found(words))
        if other:
            place = [i for i, _ in other]
            times: dict[int, int] = {}
            for i in place:
                times[i] = times.get(i, 0) + 1
            differs = {k for k, (i, w) in enumerate(other) if times[i] > 1 or words[i] != w}
            taken = {i for a, b, _ in hits for i in range(a, b)}
            more = [(a, b, w) for a, b, w in self.counted(self.found([w for _, w in other])) if any(k in differs for k in range(a, b))]
            hits = hits + [(a, b, w) for a, b, w in more if not any(place[k] in taken for k in range(a, b))]
        return sum(w for _, _, w in hits) / (1 + math.log2(1 + len(words) / 100)), len(hits)

    @staticmethod
    def counted(found: list[tuple[int, int, float | None]]) -> list[tuple[int, int, float]]:
        free = [(a, b) for a, b, w in found if w is None]
        return [(a, b, w) for a, b, w in found if w is not None and not any(c <= a and b <= d for c, d in free)]

    def score(self, text: str | None) -> tuple[float, int]:
        weight, n = self.weight(*readings(text or ""))
        z = self.lexicon.slope * weight + self.lexicon.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n


def logistic(points: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through points (x, y, how often) by Newton's method, with a small ridge; slope 0 or more."""
    a = b = 0.0
    for _ in range(steps):
        g0, g1, h00, h01, h11 = 1e-3 * a, 0.0, 1e-3, 0.0, 1e-6
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            d, w = n * (p - y), n * max(p * (1 - p), 1e-9)
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + w * x * x, h01 + w * x, h11 + w
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = max(0.0, a - max(-2.0, min(2.0, da))), b - max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", min_docs: int = 3, max_labelled: int = MAX_LABELLED, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled documents.

    At most max_labelled labelled rows (a documented bound, chosen by a hash of the key) are used; they are broadcast to the one scan of docs, whose
    labelled texts are written down, so that texts are not shuffled and later steps read no others. Words and word pairs are counted by the documents of either label that hold them. A word that at least
    min_docs documents of label 1 hold, with log odds above 2 against label 0, gets its smoothed log odds as
    weight. Word pairs that hold such a word but stand in clean documents are exceptions, as are those given. A word with log odds of 2 or less, but
    above SURE standard deviations, is counted again without the clean documents that hold it in exceptions only. Toxic word pairs aren't learned. Slope and offset are fitted on
    the same rows. Null keys, texts and labels, and keys labelled both ways, are not learned from. With no label 1 the
    lexicon is empty and the offset follows the share of label 1, smoothed.
    """
    ship(spark)
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    chosen = chosen.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").orderBy(F.crc32(F.col("k").cast("string")), "k").limit(max_labelled).select("k", "y")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "k").select("y", "text")
    rows = materialize(spark, rows, "labelled")

    def counted_terms(taken) -> DataFrame:
        """How many documents of label 1 (p) and 0 (q) hold each term that taken() finds among words; counted by task before the shuffle, at most HELD_TERMS at a time."""

        def count(batches):
            clean, toxic = Counter(), Counter()

            def out():
                terms = list(clean.keys() | toxic.keys())
                made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (toxic, clean))], names=["term", "p", "q"])
                clean.clear()
                toxic.clear()
                return made

            for batch in batches:
                for y, t in zip(batch.column(0), batch.column(1), strict=True):
                    words, other = readings(t.as_py())
                    (toxic if y.as_py() else clean).update(taken(words) | taken([w for _, w in other]))
                    if len(clean) + len(toxic) >= HELD_TERMS:
                        yield out()
            if clean or toxic:
                yield out()

        return rows.mapInArrow(releasing(count), "term string, p long, q long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))

    totals = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n1, n0 = totals.p, totals.n - totals.p
    offset = math.log((n1 + 1) / (n0 + 1))
    if not n1:
        discard(spark, rows)
        return Lexicon({}, exceptions, 0.0, min(offset, -1e-3))
    odds = F.log((F.col("p") + 0.1) * (n0 + 1) / ((F.col("q") + 0.1) * (n1 + 1)))
    deviation = F.sqrt(1 / (F.col("p") + 0.1) + 1 / (F.col("q") + 0.1))
    words = counted_terms(set).where(F.col("p") >= min_docs).withColumn("w", odds).where((F.col("w") > 2) | (F.col("w") > SURE * deviation))
    counted = {r.term: (r.w, r.p) for r in words.orderBy(F.desc("p"), F.desc("w"), "term").collect()}
    weights = {t: w for t, (w, _) in counted.items() if w > 2}
    if counted:
        near = frozenset(counted)
        pairs = counted_terms(lambda ws: {f"{u} {v}" for u, v in zip(ws, ws[1:], strict=False) if u in near or v in near})
        learned = [r.term for r in pairs.where("q >= 3 and q >= 9 * p").select("term", "q").orderBy(F.desc("q"), "term").collect()]
        held = {w for t in learned for w in t.split(" ")}
        doubtful = {t: 1.0 for t in counted if t not in weights and t in held}
        if doubtful:
            # Clean documents that hold the word outside its exceptions are what counts against it.
            inside = Lexicon(doubtful, tuple(dict.fromkeys([*exceptions, *learned])))

            def outside(batches):
                m = Matcher(inside)
                for batch in batches:
                    hits = []
                    for t in batch.column(0):
                        ws, other = readings(t.as_py())
                        seen = set()
                        for r in (ws, [w for _, w in other]):
                            seen |= {r[i] for i, _, _ in m.counted(m.found(r))}
                        hits += seen
                    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], names=["term"])

            left = {r.term: r.n for r in rows.where("y = 0").select("text").mapInArrow(releasing(outside), "term string").groupBy("term").agg(F.count("*").alias("n")).collect()}
            for t in doubtful:
                w = math.log((counted[t][1] + 0.1) * (n0 + 1) / ((left.get(t, 0) + 0.1) * (n1 + 1)))
                if w > 2:
                    weights[t] = w
        learned = [t for t in learned if any(w in weights for w in t.split(" "))]
        exceptions = tuple(dict.fromkeys([*exceptions, *learned]))
    matcher_of = Lexicon(weights, exceptions)

    def weigh(batches):
        m = Matcher(matcher_of)
        for batch in batches:
            found = [m.weight(*readings(t.as_py()))[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(x, 3) for x in found], pa.float64())], names=["y", "x"])

    points = [(r.x, r.y, r.n) for r in rows.mapInArrow(releasing(weigh), "y int, x double").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()]
    slope, offset = logistic(points)
    discard(spark, rows)
    return Lexicon(weights, exceptions, slope, offset)


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with score (0 to 1), predicted (1 from the threshold on) and n_hits, the matches that counted.

    A null or empty text has no match and gets the lexicon's offset alone. Columns of df with one of these names are replaced, others
    kept; repeated rows are scored each. Narrow; the lexicon travels with the function and is bounded by the labelled rows it is learned from.
    """
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in ("score", "predicted", "n_hits")])
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_hits")).schema

    def run(batches):
        m = Matcher(lexicon)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [m.score(t.as_py()) for t in batch.column(at)]
            more = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "predicted", "n_hits"])

    return kept.mapInArrow(releasing(run), schema)
