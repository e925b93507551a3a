"""Multilingual mixture inference: language proportions of a document by expectation-maximisation.

A model holds, for each language, smoothed log-likelihoods of hashed byte trigrams inside words. A
document's words are draws from an unknown mixture of languages; a word's likelihood in a language
is that of its trigrams. EM estimates the proportions. The set of languages grows from the best one,
in order of their proportions in the fit over all languages, while the likelihood less half of
(size - 1) * log(words) still rises. The prediction is the language with the largest proportion in
the chosen set; the score is that proportion.

Training uses about DOCS_PER_LANGUAGE different whole texts of each language, chosen by a hash of the
text, once each: a bounded sample, however often texts repeat. Languages are those of the training rows, however many.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows without lang don't train.
No training row at all: every text is `und`. Ties take the language first in order. Repeated rows
stay, each with its row; empty table: no rows. Very long texts are cut into slices at white space for
the trigrams, and all their words count. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, light, prepare

#: The bound of the training sample.
DOCS_PER_LANGUAGE = 1_500
BUCKET_BITS = 16
EM_ROUNDS = 12
UND = "und"
LETTER = regex.compile(r"\p{L}")  # of any script; numbers and marks are none

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def _trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of lower-cased UTF-8 with white space around, and each word's first and one past last."""
    b = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    gap = b == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2] + 1  # from the space before to the space after
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), starts, ends - 1


def slices(text: str):
    """UTF-8 with spaces around, of at most about CHUNK_BYTES, cut at white space where there is some."""
    b = text.lower().encode("utf-8", "replace")
    at = 0
    while at < len(b):
        end = at + CHUNK_BYTES
        if end < len(b):
            cut = max(b.rfind(b" ", at, end), b.rfind(b"\n", at, end))
            end = cut if cut > at else end
        yield b" " + b[at:end] + b" "
        at = end


def _packed(texts: list[str | None]):
    """(text numbers, joined slices) of about CHUNK_BYTES."""
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        for part in slices(t or ""):
            if held and size + len(part) > CHUNK_BYTES:
                yield owner, held
                held, owner, size = [], [], 0
            held.append(part)
            owner.append(i)
            size += len(part)
    if held:
        yield owner, held


def _joined(owner: list[int], held: list[bytes]):
    """Trigram buckets, word bounds, and each word's text number."""
    code, starts, ends = _trigrams(b"".join(held))
    bounds = np.cumsum([0] + [len(x) for x in held])
    return code, starts, ends, np.asarray(owner)[np.searchsorted(bounds, starts, side="right") - 1]


def learn(rows: DataFrame, lang: str = "lang", sample: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-likelihoods by bucket and language, from rows (text, lang)."""
    prepare(rows.sparkSession)
    rows = rows.select("text", F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BUCKET_BITS, 0), dtype=np.float32)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))))
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).distinct()  # copies drop out before the shuffle, as far as a task holds them
    at = {k: i for i, k in enumerate(langs)}

    def count(it):
        total = np.zeros((len(langs), 1 << BUCKET_BITS), dtype=np.int64)
        for batch in it:
            of = np.array([at[k] for k in batch.column(1).to_pylist()], dtype=np.int64)
            for owner, held in _packed(batch.column(0).to_pylist()):
                code, starts, ends, text = _joined(owner, held)
                n = ends - starts
                where = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                where = np.minimum(where, len(code) - 1)
                total += np.bincount((np.repeat(of[text], n) << BUCKET_BITS) | code[where], minlength=total.size).reshape(total.shape)
        lang_at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang_at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang_at, bucket])], names=["lang", "bucket", "n"])

    sums = chosen.mapInArrow(light(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((1 << BUCKET_BITS, len(langs)), 0.5)
    counts[sums.column("bucket").to_numpy(), sums.column("lang").to_numpy()] += sums.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _em(like: np.ndarray, theta: np.ndarray, words: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """theta (by language, document) after rounds of EM, and each word's likelihood under it.

    like is by language, word; words of a document lie together, from its bounds. A language's new share is its old one
    times the mean of its part in the words' likelihoods; every step runs along the words of one language.
    """
    many = words.astype(np.int64)
    for k in range(rounds + 1):
        whole = np.full(like.shape[1], 1e-30, dtype=np.float32)
        for own, share in zip(like, theta):
            whole += own * np.repeat(share, many)
        if k < rounds:
            part = np.reciprocal(whole)
            theta = np.stack([share * np.add.reduceat(own * part, bounds) / words for own, share in zip(like, theta)])
    return theta, whole


def mixtures(log_like: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Proportions (docs, languages) in each document's chosen set. log_like: by word, words in order of doc."""
    out = np.zeros((docs, log_like.shape[1]), dtype=np.float32)
    if not len(doc):
        return out
    have, first = np.unique(doc, return_index=True)
    place = np.searchsorted(have, doc)
    words = np.diff(np.append(first, len(doc))).astype(np.float32)
    below = np.ascontiguousarray(log_like.T)
    below = below - below.max(0)
    like = np.exp(below)
    langs = log_like.shape[1]
    full = _em(like, np.full((langs, len(have)), 1 / langs, dtype=np.float32), words, first, EM_ROUNDS)[0].T
    order = np.argsort(-full, axis=1, kind="stable")
    sums = np.add.reduceat(below, first, axis=1).T
    lead = sums.argmax(1)  # the best single language
    rank = np.argsort(order, axis=1, kind="stable")
    rank[np.arange(len(have)), lead] = -1
    order = np.argsort(rank, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = np.zeros((len(have), langs), dtype=np.float32)
    best[np.arange(len(have)), lead] = 1
    best_value = sums[np.arange(len(have)), lead]
    going = np.arange(len(have))
    for size in range(2, langs + 1):
        if not len(going):
            break
        mask = np.zeros(len(have), dtype=bool)
        mask[going] = True
        start = np.concatenate(([0], np.cumsum(words[going])[:-1])).astype(np.int64)
        theta = np.where(rank[going] < size, np.maximum(full[going], 1e-3), 0).astype(np.float32)
        theta /= theta.sum(1, keepdims=True)
        theta, whole = _em(like[:, mask[place]], theta.T, words[going], start, EM_ROUNDS)
        theta = theta.T
        value = np.add.reduceat(np.log(whole), start) - (size - 1) / 2 * np.log(np.maximum(words[going], 2))
        better = value > best_value[going]
        best[going[better]], best_value[going[better]] = theta[better], value[better]
        going = going[better]
    out[have] = best
    return out


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred, score and proportions (map of language to share) for text and columns of these names."""
    prepare(spark)
    held_model = spark.sparkContext.broadcast(model)  # 256 KB a language
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "proportions")]

    def run(it):
        langs, table = held_model.value
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            share = np.zeros((len(texts), len(langs)), dtype=np.float32)
            held_words, held_docs, size = [], [], 0

            def settle():
                nonlocal held_words, held_docs, size
                if held_docs:
                    d = np.concatenate(held_docs)
                    lo = d[0]
                    share[lo : d[-1] + 1] = mixtures(np.concatenate(held_words, axis=1).T, d - lo, int(d[-1] - lo + 1))
                held_words, held_docs, size = [], [], 0

            for owner, held in _packed(texts) if langs else ():
                if held_docs and held_docs[-1][-1:] != owner[0] and size >= CHUNK_BYTES // 8:
                    settle()
                code, starts, ends, text = _joined(owner, held)
                ll = np.empty((len(langs), len(starts)), dtype=np.float32)
                if len(starts):
                    total, ends = np.zeros(len(code) + 1), np.minimum(ends, len(code))
                    for i in range(len(langs)):
                        np.cumsum(table[code, i], out=total[1:], dtype=np.float64)
                        ll[i] = total[ends] - total[starts]
                    held_words.append(ll)
                    held_docs.append(text)
                    size += len(starts)
            settle()
            best = share.argmax(1) if langs else np.zeros(len(texts), dtype=np.int64)
            known = [bool(langs) and bool(t) and share[i, best[i]] > 0 and LETTER.search(t) is not None for i, t in enumerate(texts)]
            pred = [langs[best[i]] if k else UND for i, k in enumerate(known)]
            score = [min(1.0, float(share[i, best[i]])) if k else 0.0 for i, k in enumerate(known)]
            parts = [[(langs[j], float(share[i, j])) for j in np.flatnonzero(share[i])] if k else [] for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], names=[*keep, "lang_pred", "score", "proportions"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema)
    return docs.select(*keep, "text").mapInArrow(light(run), f"{schema}, lang_pred string, score double, proportions map<string,double>")


def with_letter(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose text holds a letter: those that predict, with a language to choose, doesn't call `und`."""
    prepare(spark)
    at = docs.columns.index("text")

    def run(it):
        for batch in it:
            yield batch.filter(pa.array([bool(t) and LETTER.search(t) is not None for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(light(run), docs.schema)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, proportions); learns from the rows that aren't held out."""
    prepare(spark)
    model = learn(docs.filter(remainder(4) != 2))
    return predict(spark, docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text"), model)
