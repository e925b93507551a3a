"""Document fingerprints: an improbable-feature digest.

Every window of WINDOW bytes gets its Shannon entropy. How rare an entropy level is comes from its
count over the windows of all documents. A window is a feature if no window within REACH of it is
rarer (ties: by content hash). Features, in text order and without repeats, go into a chain of Bloom
filters, FEATURES to each. Likeness of two digests: each filter of the shorter chain is held against
all of the other; bits in common, less those expected by chance, over the most there could be, best
match for each filter, weighted mean by features.

A text shorter than a window is one feature of its own. Empty text: an empty fingerprint; two empty
ones have likeness 1, an empty and another 0. Equal texts have equal fingerprints.

The next document is found without one global window: documents go to ranges of doc_id, and the
first document of each range is also sent to the range before.

Nulls: a null text counts as empty; rows with a null doc_id come first in the order. Rows of one
doc_id are ordered by text, and each has its successor. One row: it is its own next. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

WINDOW, REACH = 32, 32
FILTER_BITS, BITS_EACH, FEATURES = 2048, 5, 160
LEVELS = 256
GROUP_BYTES = 1 << 19
#: Documents in a range, about, and the most ranges; ids read for each range to find its bounds.
DOCS_PER_RANGE, MOST_RANGES, SPREAD = 1_500, 1 << 16, 32

_F = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 65536).astype(np.int64)
_STEP = np.diff(_F)  # what the k-th equal byte adds


def levels(b: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS - 1) of the window starting at each byte."""
    n = len(b) - WINDOW + 1
    before = np.zeros(len(b), dtype=np.uint8)  # equal bytes among the WINDOW - 1 before
    after = np.zeros(len(b), dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    head = int(_F[np.bincount(b[:WINDOW], minlength=256)].sum())
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - 1]]
    total = np.concatenate(([head], change)).cumsum()
    entropy = (_F[WINDOW] - total) / (WINDOW * 65536 * np.log2(WINDOW))
    return np.clip(entropy * LEVELS, 0, LEVELS - 1).astype(np.uint8)


def window_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of each window, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < WINDOW:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _lowest(key: np.ndarray) -> np.ndarray:
    """The least key within REACH on either side."""
    x = np.concatenate((np.full(REACH, 0xFFFFFFFF, dtype=np.uint32), key, np.full(REACH, 0xFFFFFFFF, dtype=np.uint32)))
    span, size = 2 * REACH + 1, 1
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(key)], x[span - size : span - size + len(key)])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with gaps of REACH bytes between, and where each starts (and the end)."""
    gap = b"\0" * REACH
    return np.frombuffer(gap.join(texts) + gap, dtype=np.uint8), np.cumsum([0] + [len(t) + REACH for t in texts])


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie within one text."""
    mark = np.zeros(n + 1, dtype=np.int32)
    for s, e in zip(bounds[:-1], bounds[1:] - REACH):
        if e - s >= WINDOW:
            mark[s] += 1
            mark[min(e - WINDOW + 1, n)] -= 1
    return np.cumsum(mark[:-1]) > 0


def digests(texts: list[bytes], rank: np.ndarray) -> list[list[tuple[np.ndarray, int]]]:
    """For each text its filters: (bits as 256 bytes, features)."""
    b, bounds = joined(texts)
    picked = np.zeros(0, dtype=np.int64)
    hashes = np.zeros(0, dtype=np.uint64)
    if len(b) >= WINDOW:
        hashes = window_hashes(b)
        key = (rank[levels(b)].astype(np.uint32) << np.uint32(24)) | (hashes >> np.uint64(40)).astype(np.uint32)
        ok = inside(bounds, len(key))
        key[~ok] = 0xFFFFFFFF
        picked = np.flatnonzero((key == _lowest(key)) & ok)
    at = np.searchsorted(picked, bounds)
    out = []
    for i, t in enumerate(texts):
        h = hashes[picked[at[i] : at[i + 1]]]
        if len(h):
            _, first = np.unique(h, return_index=True)
            h = h[np.sort(first)]
        elif t:
            h = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")], dtype=np.uint64)
        filters = []
        for k in range(0, len(h), FEATURES):
            part = h[k : k + FEATURES]
            bits = np.zeros(FILTER_BITS, dtype=np.uint8)
            for j in range(BITS_EACH):
                bits[((part >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
            filters.append((np.packbits(bits), len(part)))
        out.append(filters)
    return out


def written(filters: list[tuple[np.ndarray, int]]) -> str:
    """Features and bits of each filter, in hexadecimal."""
    return ".".join(f"{n:02x}{bits.tobytes().hex()}" for bits, n in filters)


def read(text: str) -> list[tuple[np.ndarray, int]]:
    return [(np.frombuffer(bytes.fromhex(x[2:]), dtype=np.uint8), int(x[:2], 16)) for x in text.split(".")] if text else []


def likeness(a: list[tuple[np.ndarray, int]], b: list[tuple[np.ndarray, int]]) -> float:
    if not a or not b:
        return float(not a and not b)
    if (len(a), sum(x[1] for x in a)) > (len(b), sum(x[1] for x in b)):
        a, b = b, a
    x, y = np.stack([f[0] for f in a]), np.stack([f[0] for f in b])
    nx, ny = np.bitwise_count(x).sum(1).astype(np.int64), np.bitwise_count(y).sum(1).astype(np.int64)
    best = np.empty(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(x[i] & y).sum(1).astype(np.int64)
        chance = nx[i] * ny / FILTER_BITS
        most = np.minimum(nx[i], ny)
        best[i] = np.max(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1))
    return float(np.average(best, weights=[f[1] for f in a]))


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, rarest first, over all windows of all texts (LEVELS rows at most come back)."""

    def count(it):
        total = np.zeros(LEVELS, dtype=np.int64)
        for batch in it:
            for texts in groups(batch.column(0)):
                b, bounds = joined(texts)
                if len(b) >= WINDOW:
                    x = levels(b)
                    total += np.bincount(x[inside(bounds, len(x))], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])

    got = docs.select("text").mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, dtype=np.int64)
    for r in got:
        n[r.level] = r.n
    return np.argsort(np.argsort(n, kind="stable"), kind="stable").astype(np.uint32)


def groups(column):
    held, size = [], 0
    for t in column:
        b = (t.as_py() or "").encode("utf-8", "replace")
        if held and size + len(b) > GROUP_BYTES:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def _bounds(ids: DataFrame, ranges: int, n: int) -> list:
    """Fewer than `ranges` doc_ids, rising, that part the rows about evenly: of ids chosen by hash, every SPREAD-th."""
    share = max(1, min(1 << 30, round((1 << 30) * SPREAD * ranges / n)))
    some = sorted(set(ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).toArrow().column("doc_id").to_pylist()))
    step = max(1, len(some) // ranges)
    return some[step::step][: ranges - 1]


def _placed(bounds: list, kind: str) -> tuple[Column, Column]:
    """How many bounds are at most doc_id, and whether it is one: counted in two steps of about sqrt(bounds) comparisons."""
    if not bounds:
        return F.lit(0), F.lit(False)
    step = isqrt(len(bounds))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    # read from JSON once, when the plan is optimised; a literal for each bound would make a huge plan
    known = lambda values, of: F.from_json(F.lit(json.dumps(values)), of)
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("doc_id")))
    part = below(known([x[0] for x in parts], f"array<{kind}>"))
    own = F.element_at(known(parts, f"array<array<{kind}>>"), part)
    none = F.col("doc_id").isNull() | (part == 0)
    return F.when(none, 0).otherwise((part - 1) * step + below(own)), F.when(none, False).otherwise(F.element_at(own, below(own)) == F.col("doc_id"))


def with_next(docs: DataFrame, per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """docs (doc_id, text) in ranges: range, extra, doc_id, text; extra rows only end a range."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least")).first()
    ranges = max(1, min(MOST_RANGES, size.n // per_range))
    bounds = [b for b in _bounds(docs.select("doc_id").filter("doc_id is not null"), ranges, size.n) if b > size.least] if ranges > 1 else []
    at, is_bound = _placed(bounds, docs.schema["doc_id"].dataType.simpleString())
    c = F.col("doc_id")
    start = c.isNull() if size.known < size.n else c == F.lit(size.least)
    # a bound is a doc_id that is there, so its documents are the first of their range
    extra = F.filter(F.array(F.when(is_bound, at - 1), F.when(start, F.lit(len(bounds)))), lambda x: x.isNotNull())
    rows = docs.select("doc_id", "text", at.alias("range"), F.coalesce(extra, F.array().cast("array<int>")).alias("also"))
    rows = rows.select("doc_id", "text", F.explode(F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("extra"))), F.transform("also", lambda x: F.struct(x.alias("range"), F.lit(1).alias("extra"))))).alias("p"))
    return rows.select("p.range", "p.extra", "doc_id", "text")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text), as the module says; near_edited and near_next are likenesses."""
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rank = spark.sparkContext.broadcast(rarity(docs))
    rows = with_next(docs)

    def run(it):
        table = rank.value
        held: list[tuple] = []  # (range, extra, doc_id, text) not yet given out

        def give(rows: list[tuple], done: bool):
            """Rows whose next is known; of an extra run only its first row is needed."""
            use, ends = [], []
            for i, r in enumerate(rows):
                if r[1]:
                    continue
                if i + 1 < len(rows):
                    use.append((r, rows[i + 1][3]))
                else:
                    ends.append(i)
            if done and ends:
                use.append((rows[-1], rows[-1][3]))
            return use

        def emit(use):
            k = 0
            while k < len(use):
                part, size = [], 0
                while k < len(use) and (not part or size + len(use[k][0][3]) < GROUP_BYTES // 2):
                    size += len(use[k][0][3])
                    part.append(use[k])
                    k += 1
                own = [r[3] for r, _ in part]
                edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in ((r[3], nxt) for r, nxt in part)]
                code = [x.encode("utf-8", "replace") for x in own]
                code2 = [x.encode("utf-8", "replace") for x in edited]
                after = part[-1][1].encode("utf-8", "replace")
                d = digests([*code, after], table)
                e = digests(code2, table)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[2] for r, _ in part], id_type), pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in code2]), pa.array([written(x) for x in d[:-1]]), pa.array([written(x) for x in e]),
                    pa.array([likeness(x, y) for x, y in zip(d, e)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(d[:-1], d[1:])], pa.float64()),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        id_type = pa.int64()
        for batch in it:
            id_type = batch.schema.field("doc_id").type
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[-1][0] != r[0]:
                    yield from emit(give(held, True))
                    held = []
                held.append(r)
            if len(held) > 1:
                yield from emit(give(held[:-1] + held[-1:], False))
                held = held[-1:]
        if held:
            yield from emit(give(held, True))

    ordered = rows.repartition("range").sortWithinPartitions("range", "extra", F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
