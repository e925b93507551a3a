"""N-gram Jaccard join of documents with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least the
threshold; the result names each document's connected component. With prefixes of n - o + l tokens
in a global order (o: the least overlap that a partner can have), two linked sets share at least l
prefix tokens. Each document takes the l that makes its estimated cost least: the lengths of the
posting lists it reads, plus the candidates left once l shared tokens are asked for. A pair uses the
smaller l of its two documents.

Links are looked for in two rounds. First every set is compared with the first set of each of its
posting lists, which joins groups of near copies by a star and not by all their pairs. Then all
pairs that share enough prefix tokens and are not in one component yet are compared. What is left
out lies within a component, so components are exact. jaccard_links gives all links between classes of
equal sets instead: all pairs that share enough prefix tokens are compared, whatever their components.

Nulls: a null text has no words. Without words: n_shingles 0, linked with nothing, component_id is
the row's own doc_id. Fewer than five words: the whole sequence is the one shingle. Repeated rows
stay, one output row each. A null doc_id stays null; it doesn't count as the smallest id. Empty
table: no rows. Only doc_id and text are read; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, light, mix, prepare, words
from .prefix_join import among, components, count_of, frequency_table, noise, plausible, set_id, shared_postings, sketch, verify

SHINGLE_WORDS = 5
PERCENT = 75
#: Longest extension of a prefix, and the costs of one posting and of one verification in list entries.
MOST_MATCHES, POSTING_COST, VERIFY_COST = 4, 4.0, 16.0
#: Texts of a task whose prefixes are remembered, so that copies in it are given out once.
SEEN = 1 << 19
#: Earlier tokens that a posting of the second round holds: all, if its set has up to WHOLE postings there, else the EARLIER latest.
WHOLE, EARLIER = 64, 8


def shingles(texts: list[bytes], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text, the hashes of its word k-grams (of all its words, if fewer); repeats stay."""
    buf = b"\n".join(texts) + b"\n"
    starts, _, h = words(buf)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)
    salts = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated odd factors, else orders of few words collide
    full = np.zeros(0, dtype=np.uint64)
    if len(h) >= k:
        full = h[: len(h) - k + 1] * salts[0]
        for i in range(1, k):
            full = full + h[i : len(h) - k + 1 + i] * salts[i]
        full = mix(full)
    out = []
    for s, e in zip(first[:-1], first[1:]):
        n = e - s
        if n >= k:
            out.append(full[s : e - k + 1])
        elif n:
            x = np.uint64(n)
            for i in range(n):
                x = x + h[s + i : s + i + 1] * salts[i]
            out.append(mix(x))
        else:
            out.append(h[:0])
    return out


def plan_prefix(n: int, est: np.ndarray, percent: int) -> tuple[int, int]:
    """l, and the length of the prefix, for a set of n tokens with these estimated list lengths in order."""
    least = -(-percent * n // 100)
    base = n - least
    if not est[min(n, base + MOST_MATCHES) - 1]:
        return 1, base + 1
    total = np.cumsum(est[: base + MOST_MATCHES], dtype=np.float64)
    best, at = None, 1
    for m in range(1, min(MOST_MATCHES, least) + 1):
        s = total[base + m - 1]
        cost = s + POSTING_COST * (base + m) + VERIFY_COST * s / (m * m)
        if best is None or cost < best:
            best, at = cost, m
    return at, base + at


def tokens_of(batch: pa.RecordBatch):
    for part in chunks(batch.column(1).to_pylist()):
        yield from (np.unique(x) for x in shingles([b for _, b in part]))


def _index(table, percent):
    """Rows of (doc_id, sid, n, matches, alone, prefix, sketch); the last three come with the first of the same sets in a task.

    alone: 0 to 127, the share of the set's tokens that are no more frequent than chance has it.
    """

    def run(it):
        (freq, usual), seen, counts = table.value, set(), count_of(np.arange(256))
        for batch in it:
            ids = batch.column(0)
            for part in chunks(batch.column(1).to_pylist()):
                sid, n, matches, alone, prefix, marks = [], [], [], [], [], []
                for x in shingles([b for _, b in part]):
                    u = np.unique(x)
                    n.append(len(u))
                    key = set_id(u) if len(u) else None
                    sid.append(key)
                    if key is None or key in seen:
                        for column in (matches, alone, prefix, marks):
                            column.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    est = freq[(u & np.uint64(len(freq) - 1)).astype(np.int64)]
                    order = np.argsort(est, kind="stable")
                    est = counts[est]
                    m, size = plan_prefix(len(u), np.maximum(est[order] - usual, 0), percent)
                    matches.append(m)
                    prefix.append(u[order[:size]].view(np.int64))
                    alone.append(127 * int(np.count_nonzero(est <= usual)) // len(u))
                    marks.append(sketch(u))
                lo = part[0][0]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(matches, pa.int32()), pa.array(alone, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "sid", "n", "matches", "alone", "prefix", "sketch"])

    return run


def _sets(it):
    for batch in it:
        for part in chunks(batch.column(1).to_pylist()):
            sets = [np.unique(x) for x in shingles([b for _, b in part])]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["sid", "toks"])


# meta holds alone, n, the position from 1 and l of a posting, in 7, 26, 26 and 4 bits
_N, _POS, _L = "(shiftright({}, 30) & 67108863L)", "(shiftright({}, 4) & 67108863L)", "({} & 15L)"


def _terms(meta: str, percent: int) -> dict[str, str]:
    n, pos = _N.format(meta), _POS.format(meta)
    base = f"({n} - cast(ceil({percent} * {n} / 100D) as long))"
    return {"n": n, "pos": pos, "l": _L.format(meta), "tier": f"greatest(1L, {pos} - {base})"}


def _possible(a: str, b: str, percent: int) -> str:
    """Length and positional filter, and that the token lies within the prefixes for the pair's l."""
    x, y = _terms(a, percent), _terms(b, percent)
    most = f"(least({x['pos']}, {y['pos']}) + least({x['n']} - {x['pos']}, {y['n']} - {y['pos']}))"
    return f"100 * least({x['n']}, {y['n']}) >= {percent} * greatest({x['n']}, {y['n']}) and greatest({x['tier']}, {y['tier']}) <= least({x['l']}, {y['l']}) and {100 + percent} * {most} >= {percent} * ({x['n']} + {y['n']})"


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, c, need) of pairs a < b of postings (token, sid, meta, root) with different roots; sum(c) >= need for all that may be linked.

    Each posting holds tokens of its set before it, so a pair is given out at the token where it has shared
    enough and not at each further one; there the number shared so far is exact, which makes the positional
    filter sharp. Sets of more than WHOLE postings know only the EARLIER latest tokens: a pair of such a set
    may come once for each token it needs.
    """
    own = Window.partitionBy("sid").orderBy(F.expr(_POS.format("meta")), "token")
    held = postings.withColumn("before", F.collect_list("token").over(own.rowsBetween(1 - WHOLE, -1))).withColumn("whole", F.count(F.lit(1)).over(Window.partitionBy("sid")) <= WHOLE)
    held = held.withColumn("before", F.when(F.col("whole") | (F.size("before") <= EARLIER), F.col("before")).otherwise(F.slice("before", -EARLIER, EARLIER)))
    x, y = (held.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("sid", "meta", "root", "before", "whole"))) for side in "ab")
    need, both = f"least({_L.format('a_meta')}, {_L.format('b_meta')})", "size(array_intersect(a_before, b_before))"
    m, n = _terms("a_meta", percent), _terms("b_meta", percent)
    most = f"({need} + least({m['n']} - {m['pos']}, {n['n']} - {n['pos']}))"
    now = f"case when a_whole and b_whole then {100 + percent} * {most} >= {percent} * ({m['n']} + {n['n']}) and {both} = {need} - 1 else {both} < {need} end"
    found = x.join(y, (x.token == y.token) & F.expr(f"a_sid < b_sid and a_root <> b_root and {_possible('a_meta', 'b_meta', percent)} and {now}"))
    return found.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), F.expr(f"case when a_whole and b_whole then {need} else 1L end").alias("c"), F.expr(need).alias("need"))


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    return _join(spark, docs, percent, False)


def jaccard_links(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, a_doc, b_doc) for each two classes of equal sets, set ids a < b, that link; the last two are their least doc_ids."""
    return _join(spark, docs, percent, True)


def _join(spark: SparkSession, docs: DataFrame, percent: int, all_links: bool) -> DataFrame:
    prepare(spark)
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text")
    counts = frequency_table(docs, tokens_of)
    table = spark.sparkContext.broadcast((counts, noise(counts)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    indexed = scratch.write(docs.mapInArrow(light(_index(table, percent)), f"doc_id {kind}, sid long, n long, matches int, alone int, prefix array<long>, sketch binary"), "indexed")
    members = scratch.write(indexed.select("doc_id", "sid", "n"), "members")
    sketches = scratch.write(indexed.filter("sketch is not null").select("sid", "n", "sketch"), "sketches")
    meta = F.expr("shiftleft(cast(alone as long), 56) | shiftleft(n, 30) | shiftleft(cast(pos + 1 as long), 4) | cast(matches as long)")
    postings = indexed.filter("prefix is not null").select("sid", "n", "matches", "alone", F.posexplode("prefix").alias("pos", "token")).select("token", "sid", meta.alias("meta"))
    shared = scratch.write(shared_postings(postings), "shared")
    del indexed, postings
    scratch.drop("indexed")
    reps = members.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("id"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.write(plausible(pairs, sketches, percent).distinct(), f"{name}-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = scratch.write(reps.join(ends, "sid").select("id"), f"{name}-ids")
        sets = among(docs, "doc_id", wanted).mapInArrow(light(_sets), "sid long, toks binary")
        links = scratch.write(verify(pairs, sets, percent).distinct(), f"{name}-links")
        del sets
        scratch.drop(f"{name}-ids")
        return links

    if all_links:
        every = candidates(shared.select("token", "sid", "meta", F.col("sid").alias("root")), percent).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).filter("c >= need").select("a", "b")
        links = linked(every, "all")
        for side in "ab":
            links = links.join(reps.select(F.col("sid").alias(side), F.col("id").alias(f"{side}_doc")), side)
        links = scratch.write(links.select("a", "b", "a_doc", "b_doc"), "links")
        scratch.drop("shared", "sketches", "members", "all-pairs", "all-links")
        return links

    star = shared.filter("sid <> lead").filter(_possible("meta", "lead_meta", percent)).groupBy("sid", "lead").agg(F.count(F.lit(1)).alias("c"), F.max(F.expr("least(meta & 15L, lead_meta & 15L)")).alias("need")).filter("c >= need")
    star = star.groupBy("sid").agg(F.max(F.struct("c", "lead")).alias("best")).select(F.least("sid", "best.lead").alias("a"), F.greatest("sid", "best.lead").alias("b"))
    links = linked(star, "star")
    comp = scratch.write(components(spark, links, scratch, "first"), "first")
    placed = shared.select("token", "sid", "meta").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    placed = scratch.write(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    open_ = scratch.write(placed.join(mixed, "token"), "open")
    del placed, mixed
    scratch.drop("placed", "shared")
    rest = candidates(open_, percent).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).filter("c >= need").select("a", "b")
    more = linked(rest, "rest")
    roots = components(spark, links.union(more), scratch, "last")
    by_root = reps.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "id")
    by_root = scratch.write(by_root, "by_root")  # two tables: the join with a root that very many sets have can be split
    least = scratch.write(by_root.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = scratch.write(by_root.join(least, "root").select("sid", "component_id"), "named")
    del rest, by_root, least, roots
    scratch.drop("open", "sketches", "first", "star-pairs", "rest-pairs", "star-links", "rest-links", "by_root", "least")
    return members.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(named, "sid", "left").select("doc_id", "n_shingles", F.expr("case when sid is null then doc_id else component_id end").alias("component_id"))
