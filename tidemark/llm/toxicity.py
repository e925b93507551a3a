"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon and of a lexicon of word stems learned from labels, how near
second-person words are to lexicon words, and rates of capitals, punctuation, repeated letters and
obfuscation (symbols or digits inside words; lexicon words that show only once those are undone).

Training uses about LABELLED labelled rows, chosen by a hash of doc_id, with their whole texts: a
bounded sample for the stems, the trees and the calibration (on a quarter that the trees don't see).

Nulls: a null text is empty; an empty text gets the score of its features, all zero. Rows with a null
label don't train; texts of any length count whole; several labels of one id count as toxic if one is. No labels at all: score 0.
Repeated rows stay; empty table: no rows. Only doc_id and text, and labels' doc_id and toxic are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import Scratch, light, prepare
from .language_id import remainder

#: The bound of the training sample.
LABELLED = 12_000
#: Stems: prefixes of so many letters that at least SUPPORT toxic texts hold and whose log-odds are ODDS or more.
STEM, SUPPORT, ODDS, MOST_STEMS = range(4, 11), 6, 3.0, 2_000
NEAR = 40

#: Insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "bastard", "asshole", "bitch", "fuck", "shit", "cunt", "whore", "slut", "retard", "vermin", "dummkopf", "arschloch", "scheiss", "wichser", "hurensohn", "connard", "salaud", "merde", "putain", "imbécile", "estúpido", "idiota", "mierda", "puta", "cabrón", "pendejo", "gilipollas")
#: Second-person words.
SECOND = re.compile(r"(?<!\w)(?:you|your|yours|yourself|u|ur|du|dich|dir|dein|deine|ihr|euch|tu|te|toi|ton|ta|tes|vous|votre|tú|ti|tus|usted|ustedes|vosotros)(?!\w)")
#: Letters that digits and symbols stand for.
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W\d_]+")
NAMES = ("insults", "stems", "log_hits", "second_near", "second_nearest", "unmasked", "masked", "capitals", "shouted", "exclaimed", "asked", "punctuation", "digits", "repeated", "log_words")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MASK = np.zeros(256, dtype=bool)
_MASK[[ord(c) for c in "0134579@$!|+*_"]] = True
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def nearest(ends: np.ndarray, low: str) -> np.ndarray:
    """From each end to the nearest start of a second-person word of the whole text, over all of its hits.

    A start counts from NEAR characters before the end to NEAR - 1 after it; without one: NEAR + 1.
    """
    starts = np.fromiter((m.start() for m in SECOND.finditer(low)) if len(ends) else (), dtype=np.int64)
    if not len(starts):
        return np.full(len(ends), NEAR + 1)
    at = np.searchsorted(starts, ends)
    before, after = ends - starts[np.maximum(at - 1, 0)], starts[np.minimum(at, len(starts) - 1)] - ends
    before[(before < 0) | (before > NEAR)] = NEAR + 1
    after[(after < 0) | (after >= NEAR)] = NEAR + 1
    return np.minimum(before, after)


class Features:
    def __init__(self, stems: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for w in sorted({*INSULTS, *stems}):
            self.machine.add_word(w, (len(w), w in INSULTS, w in stems))
        self.machine.make_automaton()
        self.stems = set(stems)

    def hits(self, low: str) -> list[tuple[int, bool, bool]]:
        """(end, in the fixed lexicon, in the learned one) of lexicon words; one for each word start."""
        found: dict[int, tuple[int, bool, bool]] = {}
        for end, (n, fixed, learned) in self.machine.iter(low):
            start = end - n + 1
            if not start or not low[start - 1].isalpha():
                old = found.get(start, (end, False, False))
                found[start] = (end, fixed or old[1], learned or old[2])
        return list(found.values())

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        c = np.bincount(b, minlength=256)
        letter = _LETTER[b]
        n_letters = max(1, int(c[_LETTER].sum()))
        n_words = max(1, int(np.count_nonzero(letter[1:] & ~letter[:-1])) + int(letter[0]))
        low = text.lower()
        hits = self.hits(low)
        gaps = nearest(np.array([h[0] for h in hits], dtype=np.int64), low)
        close = gaps[gaps <= NEAR]
        masked = int(np.count_nonzero(_MASK[b[1:-1]] & letter[:-2] & letter[2:])) if len(b) > 2 else 0
        unmasked = max(0, len(self.hits(low.translate(UNMASK))) - len(hits)) if masked else 0
        upper = _UPPER[b]
        same = int(np.count_nonzero((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & letter[2:])) if len(b) > 2 else 0
        return [
            sum(h[1] for h in hits) / n_words, sum(h[2] for h in hits) / n_words, float(np.log1p(len(hits))),
            len(close) / max(1, len(hits)), 1 / (1 + int(close.min())) if len(close) else 0.0,
            unmasked / n_words, masked / n_words, int(c[65:91].sum()) / n_letters,
            int(np.count_nonzero(upper[1:] & upper[:-1])) / n_letters, c[33] / n_words, c[63] / n_words,
            int(c[_PUNCT].sum()) / n_words, int(c[48:58].sum()) / n_words, same / n_letters, float(np.log1p(n_words)),
        ]


def _stems_in(text: str) -> set[str]:
    return {w[:k] for w in set(WORD.findall(text.lower())) for k in STEM if k <= len(w)}


def _counts(rows: DataFrame, wanted) -> dict[str, int]:
    """Of how many texts each stem is in; wanted: the stems that count (a broadcast), or None."""

    def count(it):
        total = Counter()
        for batch in it:
            for t in batch.column(0):
                found = _stems_in(t.as_py() or "")
                total.update(found if wanted is None else found & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["stem", "n"])

    got = rows.select("text").mapInArrow(light(count), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    return {r.stem: r.n for r in got.filter(F.col("n") >= (SUPPORT if wanted is None else 1)).collect()}  # bounded with the sample


def learn_stems(spark: SparkSession, sample: DataFrame) -> list[str]:
    """The shortest stems whose log-odds for toxic texts are high, most telling first."""
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = _counts(sample.filter("toxic = 1"), None)
    good = _counts(sample.filter("toxic = 0"), spark.sparkContext.broadcast(set(bad)))
    odds = {s: np.log((n + 0.5) / (sizes.get(1, 0) + 1)) - np.log((good.get(s, 0) + 0.5) / (sizes.get(0, 0) + 1)) for s, n in bad.items()}
    kept: list[str] = []
    for s in sorted((s for s in odds if odds[s] >= ODDS), key=lambda s: (len(s), s)):
        if not any(s[:k] in odds and odds[s[:k]] >= ODDS for k in STEM if k < len(s)):
            kept.append(s)
    return sorted(kept, key=lambda s: (-odds[s], s))[:MOST_STEMS]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> dict | None:
    """Model from docs (doc_id, text) and labels (doc_id, toxic)."""
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    labels = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    n = labels.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = labels.filter(part < F.lit(int(min(1.0, sample / n) * (1 << 20)))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = scratch.write(chosen, "chosen")
    small = chosen.limit(4 * sample + 1).count() <= 4 * sample  # about `sample` rows of two integers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if small else chosen, "doc_id")
    rows = scratch.write(rows.select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), "sample")
    stems = learn_stems(spark, rows)

    def measure(it):
        features = Features(stems)
        for batch in it:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["part", "toxic", "x"])

    got = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int").alias("part"), "text", F.col("toxic").cast("int").alias("toxic"), "doc_id").orderBy("doc_id").drop("doc_id").mapInArrow(light(measure), "part int, toxic int, x array<double>").toArrow()
    scratch.drop("sample", "chosen")
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist(), dtype=np.float64)
    y, held = got.column("toxic").to_numpy().astype(np.float64), got.column("part").to_numpy() == 0
    trees = boosting.fit_trees(x[~held], y[~held])
    return {"stems": stems, "trees": trees, "knots": boosting.fit_isotonic(boosting.margins(trees, x[held]), y[held])}


def score(spark: SparkSession, docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text, ...) with score and predicted for text and columns of these names."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("text", "score", "predicted")]

    def run(it):
        m = shared.value
        features = Features(m["stems"]) if m else None
        for batch in it:
            if m:
                x = np.array([features(t.as_py()) for t in batch.column(batch.num_columns - 1)], dtype=np.float64).reshape(-1, len(NAMES))
                s = boosting.calibrated(m["knots"], boosting.margins(m["trees"], x))
            else:
                s = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema)
    return docs.select(*keep, "text").mapInArrow(light(run), f"{schema}, score double, predicted int")


def rate(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labels that aren't held out."""
    prepare(spark)
    model = train(spark, docs, labels.filter(remainder(5) != 0))
    return score(spark, docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text"), model)
