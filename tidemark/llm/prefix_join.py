"""Exact set-similarity self-joins by prefix filtering: the parts that lines and documents share.

A set is known by a 64-bit hash of its sorted tokens (its *sid*); equal sets are one class and are
joined once. Tokens are 64-bit hashes in one global order: rising estimated frequency, then hash.
Any fixed order gives exact results; the estimate only makes prefixes cheap. It comes from a table
of fixed size that counts the tokens of all rows by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, light

#: Counters of a frequency table, a byte each once summed: 4 MB at any size of the corpus.
TABLE_BITS = 22
#: Steps of a summed counter for each doubling.
STEPS = 8
#: The level of a count of one: no other set has the token, since buckets only count too much.
ONCE = STEPS
#: Candidate ids up to this many are broadcast to the texts (under 10 MB); more are joined by shuffle.
BROADCAST_IDS = 200_000


def set_id(tokens: np.ndarray) -> int:
    """Of sorted distinct tokens."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of STEPS levels for each doubling; up to 8 no two share a level."""
    return np.minimum(np.rint(STEPS * np.log2(counts + 1.0)), 255).astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    """What the levels stand for, about."""
    return np.rint(np.exp2(levels / STEPS) - 1)


class Counts:
    """Counts of tokens by bucket, at most 65,535 each as they are given out in chunks, dense or sparse, whichever is smaller."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << bits, dtype=np.uint32)

    def add(self, tokens: np.ndarray) -> None:
        np.add.at(self.table, (tokens & np.uint64((1 << self.bits) - 1)).astype(np.int32), np.uint32(1))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for chunk, part in enumerate(self.table.reshape(-1, 1 << 16)):
            part = np.minimum(part, 65535)
            at = np.flatnonzero(part)
            if not len(at):
                continue
            small = int(part.max()) < 256
            kind = np.uint8 if small else np.uint16
            sparse = len(at) * (2 + kind().itemsize) < len(part) * kind().itemsize
            data = at.astype(np.uint16).tobytes() + part[at].astype(kind).tobytes() if sparse else part.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([len(at) if sparse else -1], pa.int32()), pa.array([small]), pa.array([data], pa.binary())], names=["chunk", "size", "small", "data"])


def _sum_chunks(it):
    """Levels of the sums of rows sorted by chunk, one row a chunk; memory: one chunk."""
    last, own = None, np.zeros(1 << 16, dtype=np.int64)

    def row():
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([level(own).tobytes()], pa.binary())], names=["chunk", "data"])

    for batch in it:
        for chunk, size, small, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if chunk != last:
                if last is not None:
                    yield row()
                last, own = chunk, np.zeros(1 << 16, dtype=np.int64)
            kind = np.uint8 if small else np.uint16
            if size < 0:
                own += np.frombuffer(data, dtype=kind)
            else:
                own[np.frombuffer(data, dtype=np.uint16, count=size)] += np.frombuffer(data, dtype=kind, offset=2 * size)
    if last is not None:
        yield row()


def frequency_table(rows: DataFrame, tokens_of: Callable, bits: int = TABLE_BITS) -> np.ndarray:
    """Levels of the counts by bucket over all rows. tokens_of(record batch) yields arrays of token hashes."""

    def count(it):
        c = Counts(bits)
        for batch in it:
            for tokens in tokens_of(batch):
                c.add(tokens)
        yield from c.batches()

    parts = rows.mapInArrow(light(count), "chunk int, size int, small boolean, data binary").repartition("chunk").sortWithinPartitions("chunk")
    sums = parts.mapInArrow(light(_sum_chunks), "chunk int, data binary").toArrow()
    table = np.zeros((1 << (bits - 16), 1 << 16), dtype=np.uint8)
    for chunk, data in zip(sums.column("chunk"), sums.column("data")):
        table[chunk.as_py()] = np.frombuffer(data.as_buffer(), dtype=np.uint8)
    return table.reshape(-1)


def noise(table: np.ndarray) -> int:
    """What a bucket of a frequency table counts without any frequent token, about: mean and two deviations."""
    m = float(count_of(np.searchsorted(np.cumsum(np.bincount(table, minlength=256)), (len(table) + 1) // 2)))
    return int(m + 2 * m**0.5) + 1


def shared_postings(postings: DataFrame) -> DataFrame:
    """(token, sid, meta) that more than one sid has, with the token's first sid (least meta) and its meta as lead, lead_meta.

    A stream over sorted rows: a token that very many sets hold needs no more memory than a rare one.
    """

    def stream(it):
        last = None  # token, lead, lead's meta, sid of the latest row, whether the lead was given out
        for batch in it:
            token, sid, meta = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            twin = np.zeros(len(token), dtype=bool)
            twin[1:] = ~new[1:] & (sid[1:] == sid[:-1])
            cont = last is not None and last[0] == token[0]
            if cont:
                new[0], twin[0] = False, sid[0] == last[3]
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on from the batch before
            lead = np.where(group >= 0, sid[starts[group]] if len(starts) else 0, last[1] if cont else 0)
            lead_meta = np.where(group >= 0, meta[starts[group]] if len(starts) else 0, last[2] if cont else 0)
            other = ~new & ~twin & (sid != lead)
            shared = np.zeros(len(starts) + 1, dtype=bool)
            np.logical_or.at(shared, group[other], True)  # the last place stands for group -1
            keep = other | (new & shared[group])
            out = [token[keep], sid[keep], meta[keep], lead[keep], lead_meta[keep]]
            if cont and not last[4] and shared[-1]:
                out = [np.concatenate(([x], y)) for x, y in zip((last[0], last[1], last[2], last[1], last[2]), out)]
            given = bool(shared[group[-1]]) or (group[-1] == -1 and last[4])
            last = (token[-1], lead[-1], lead_meta[-1], sid[-1], given)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["token", "sid", "meta", "lead", "lead_meta"])

    return postings.repartition("token").sortWithinPartitions("token", "meta", "sid").mapInArrow(light(stream), "token long, sid long, meta long, lead long, lead_meta long")


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of the tokens in about n / 2 hash buckets (a power of two), at most 255 each."""
    b = 1 << max(3, len(tokens).bit_length() - 2)
    return np.minimum(np.bincount(((tokens >> np.uint64(40)) & np.uint64(b - 1)).astype(np.int64), minlength=b), 255).astype(np.uint8).tobytes()


def most_shared(p: bytes, q: bytes) -> int:
    """An upper bound of the intersection's size, from two sketches."""
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (p, q))
    x[x == 255], y[y == 255] = 1 << 40, 1 << 40
    b = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, b).sum(0), y.reshape(-1, b).sum(0)).sum())


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches (sid, n, sketch) don't rule out. No similar pair is lost."""

    def check(it):
        for batch in it:
            na, x, nb, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [(100 + percent) * most_shared(p, q) >= percent * (i + j) for i, p, j, q in zip(na, x, nb, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("a", "b").join(sketches.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ta")), "a")
    two = one.join(sketches.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("tb")), "b")
    return two.select("a", "b", "na", "ta", "nb", "tb").mapInArrow(light(check), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sids whose sets (sid, toks: packed sorted tokens) have 100 * intersection >= percent * union."""

    def check(it):
        for batch in it:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for p, q in zip(x, y):
                u, v = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                both = int(np.count_nonzero(v[at] == u))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("a", "b").join(sets.select(F.col("sid").alias("a"), F.col("toks").alias("ta")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("toks").alias("tb")), "b").select("a", "b", "ta", "tb")
    return two.mapInArrow(light(check), "a long, b long")


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ids (a written table with column id); broadcast only while it is small, as counted."""
    ids = ids.select(F.col("id").alias("_id"))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, F.col(key).eqNullSafe(F.col("_id")), "left_semi")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root: the least node it reaches.

    Alternating large-star and small-star steps, each a min per node and a join; every round is
    written to the shared folder. Rounds grow with the logarithm of the longest path. It ends when
    no node has two parents or both a parent and a child.
    """
    e, k = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0"), 0
    while True:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
        if not ends.select("x.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        k += 1
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.write(large, f"{name}-{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}l")
