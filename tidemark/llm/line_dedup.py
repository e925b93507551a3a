"""Line dedup: an exact set-similarity join of lines; later matches are removed.

A line is the set of its words. Two lines match when the Jaccard similarity of their sets is at least
PERCENT / 100. A line goes if an earlier line of the corpus matches it; earlier means smaller
(doc_id, hash of the row, line number), and a line that itself goes still counts as earlier. Lines of
fewer than least_words different words stay: with 1, only lines without a word. Sets too small to match
any but equal ones (at 80 %: up to 3 words) have their class and no postings.

Words are ordered by rarity; the first n - o + 1 (o: the least overlap a partner can have) make the
prefix, and only lines that share a prefix word with a possible length and position are verified.
A posting also holds parity maps of the line's words, which bound the number of differing words from
below; pairs they rule out never leave the join.
Posting lists are read once, sorted: each line is held there against all others of the list, and its likeliest
partner is verified first, which settles most of a group of copies without its pairs. Then the lines not yet gone
are verified against the other partners found. Lists of over LIST_ROWS lines are compared in part where they are
read, and lines with too many partners give out a few; of these lines the ones not yet gone are joined once more.

Nulls: a null text stays null, with no lines. Rows that agree in doc_id and text are one row for the
order and get the same result each. Only lines are cut; a document stays even if no line is left.
Empty table: no rows. Other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, light, mix, prepare, words
from .prefix_join import BROADCAST_IDS, ONCE, frequency_table, verify

PERCENT = 80
LEAST_WORDS = 5
#: Least words with which every line that has a word takes part.
ALL_LINES = 1
SEEN = 1 << 19
#: Texts are cut into lines and words together up to about this many bytes: arrays of eight bytes a byte that stay in a core's cache.
LINES_BYTES = 1 << 18
#: Posting lists up to this long are compared in full where they are read; of a longer one, NEAR first and NEAR latest rows.
LIST_ROWS, NEAR = 16_384, 32
#: Leads that a posting gives out at once; if there are more, the line is joined once more unless it has gone.
KEEP = 4
#: Lists up to this long are compared together, and of a longer one about so many pairs at once.
SHORT, BLOCK = 24, 1 << 20
#: Bits of a word's hash in a posting; two words of equal bits only make more pairs to rule out.
WORD_BITS = 40
#: The bits left: with doc_ids in a range that they hold, one number of token and doc_id is what lists are sorted by.
DOC_BITS = 64 - WORD_BITS
NO_LEAD = 1 << 30


def in_order(line: np.ndarray, h: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order by line, rank (a byte; none: all alike) and hash, of words whose lines rise.

    One sort of 64-bit keys: 20 bits of the line, the rank and the first bits of the hash. Only where these bits
    don't tell two hashes apart, or with more lines, all three are sorted by.
    """
    if not len(line):
        return np.zeros(0, dtype=np.int64)
    if line[-1] - line[0] < 1 << 20:
        key = (line - line[0]).astype(np.uint64) << np.uint64(44)
        if rank is None:
            key |= h >> np.uint64(20)
        else:
            key |= (rank.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(key)
        key, ranked = key[order], h[order]
        if not np.any((key[1:] == key[:-1]) & (ranked[1:] != ranked[:-1])):
            return order
    return np.lexsort((h, line) if rank is None else (h, rank, line))


def line_words(texts: list[bytes], levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, word hash) in order, over all lines of the texts, and each text's first line (and the end).

    With the levels of a frequency table a line's words are in order of level, then hash.
    """
    buf = b"\n".join(texts) + b"\n"
    starts, _, h = words(buf)
    breaks = np.flatnonzero(np.frombuffer(buf, dtype=np.uint8) == 10)
    line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(starts, breaks), prepend=0))
    first = np.searchsorted(breaks, np.cumsum([0] + [len(t) + 1 for t in texts]))
    order = in_order(line, h, None if levels is None else levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)])
    h = h[order]  # line rises, so it stays as it is
    new = np.ones(len(h), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    line, h = line[new], h[new]
    at = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, dtype=np.int64)
    return line, h, at, first, np.diff(np.append(at, len(line)))


def set_ids(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + n.astype(np.uint64)).view(np.int64)


def parities(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit maps of each line: bit i is the parity of its words with hash bucket i.

    Maps of two lines differ in at most as many bits as their sets differ in words.
    """
    line = np.repeat(np.arange(len(n)), n)
    bits = np.bincount(line * 128 + ((h >> np.uint64(40)) & np.uint64(127)).astype(np.int64), minlength=128 * len(n)).astype(np.uint8) & 1
    maps = np.packbits(bits.reshape(-1, 128), axis=1, bitorder="little").view(np.int64)
    return np.ascontiguousarray(maps[:, 0]), np.ascontiguousarray(maps[:, 1])


def _tokens(batch: pa.RecordBatch):
    """Words as often as they come: a word that a line repeats only counts too much."""
    for part in chunks(batch.column(0).to_pylist(), LINES_BYTES):
        yield words(b"\n".join([b for _, b in part]))[2]


def _index(table, percent: int, least_words: int):
    """A row (row, doc_id, line, sid, n, skip, prefix, m1, m2) for each line.

    The prefix leaves out its first words, skip of them, that no other line has; their places still count. It is empty after the first of equal sets in a task, and for sets that match only equal ones.
    """

    def run(it):
        freq, seen = table.value, set()
        for batch in it:
            for part in chunks(batch.column(2).to_pylist(), LINES_BYTES):
                line, h, at, first, n = line_words([b for _, b in part], freq)
                rank = freq[(h & np.uint64(len(freq) - 1)).astype(np.int64)]
                size = n - -(-percent * n // 100) + 1
                fit = n >= least_words
                joins = 100 * n >= percent * (n + 1)  # a set of one word more could match
                sid = set_ids(h, at, n) if len(at) else np.zeros(0, dtype=np.int64)
                ranked = h.view(np.int64)
                number = line[at]
                owner = np.searchsorted(first, number, side="right") - 1
                rows, ids = batch.column(0).slice(part[0][0], len(part)), batch.column(1).slice(part[0][0], len(part))
                keep = np.flatnonzero(fit)
                fresh = np.zeros(len(keep), dtype=bool)
                for i, (key, wide) in enumerate(zip(sid[keep].tolist(), joins[keep].tolist())):
                    if wide and key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        fresh[i] = True
                alone = np.add.reduceat(rank <= ONCE, at) if len(at) else n  # words that no other line has come first
                skip = np.minimum(alone, size)[keep].astype(np.int64)
                lengths = np.where(fresh, size[keep] - skip, 0)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                where = np.repeat(at[keep] + skip - offsets[:-1], lengths) + np.arange(offsets[-1])
                prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ranked[where]))
                take = pa.array(owner[keep])
                m1, m2 = parities(h, n)
                yield pa.RecordBatch.from_arrays([rows.take(take), ids.take(take), pa.array(number[keep] - first[owner[keep]], pa.int64()), pa.array(sid[keep]), pa.array(n[keep], pa.int64()), pa.array(skip, pa.int64()), prefix, pa.array(m1[keep]), pa.array(m2[keep])], names=["row", "doc_id", "line", "sid", "n", "skip", "prefix", "m1", "m2"])

    return run


def _sets(it):
    """(sid, toks) of the wanted lines of (text, lines)."""
    for batch in it:
        wanted = batch.column(1).to_pylist()
        for part in chunks(batch.column(0).to_pylist(), LINES_BYTES):
            _, h, at, first, n = (x := line_words([b for _, b in part]))
            number = x[0][at]
            sid = set_ids(h, at, n) if len(at) else np.zeros(0, dtype=np.int64)
            out: list[list] = [[], []]
            for k, (i, _) in enumerate(part):
                for j in np.searchsorted(number, first[k] + np.array(wanted[i], dtype=np.int64)):
                    out[0].append(sid[j])
                    out[1].append(h[at[j] : at[j] + n[j]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["sid", "toks"])


# meta holds n and the position from 1, in 30 bits each
_N, _POS = "shiftright({}, 30)", "({} & 1073741823L)"


def _possible(x: str, y: str, percent: int) -> str:
    """Length filter, positional filter, and that the parity maps allow so few differing words; x and y prefix the columns.

    The positional filter takes the word for the first that the lines share. Every match passes it there,
    which is enough for it to leave the join; at its later words fewer do.
    """
    na, nb, pa_, pb = _N.format(f"{x}meta"), _N.format(f"{y}meta"), _POS.format(f"{x}meta"), _POS.format(f"{y}meta")
    most = f"(1 + least({na} - {pa_}, {nb} - {pb}))"
    differ = f"(bit_count({x}m1 ^ {y}m1) + bit_count({x}m2 ^ {y}m2))"
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * {most} >= {percent} * ({na} + {nb}) and {100 + percent} * {differ} <= {100 - percent} * ({na} + {nb})"


def _found(percent: int, list_rows: int = LIST_ROWS, near: int = NEAR, keep: int = KEEP):
    """For rows (token, sid, meta, m1, m2, doc) sorted by token and their documents' ids: rows (sid, lead, differ, more).

    lead: another sid of the token's list that length, position and maps allow to match, before the row in
    the list or of the same document; differ: in how many bits their maps differ. Of each row the `keep`
    leads that differ least are given; more says that there are others. A row of a list longer than
    list_rows is held against the list's first and latest rows only and always has more, also without a
    lead (null). Memory: one batch and one list of list_rows.
    """

    def likely(c: list[np.ndarray], y: np.ndarray, x: np.ndarray, differ: np.ndarray) -> np.ndarray:
        n, pos = c[2] >> 30, c[2] & ((1 << 30) - 1)
        na, nb = n[x], n[y]
        most = np.minimum(pos[x], pos[y]) + np.minimum(na - pos[x], nb - pos[y])
        return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * most >= percent * (na + nb)) & ((100 + percent) * differ.astype(np.int64) <= (100 - percent) * (na + nb))

    def short(c: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple]:
        """Pairs within the lists that these rows make, by distance in the list."""
        token, m1, m2, room = c[0][rows], c[3][rows].view(np.uint64), c[4][rows].view(np.uint64), (100 - percent) * (c[2][rows] >> 30)
        for back in range(1, SHORT):
            at = np.flatnonzero(token[back:] == token[:-back])
            if not len(at):
                return
            differ = np.bitwise_count(m1[at + back] ^ m1[at]) + np.bitwise_count(m2[at + back] ^ m2[at])
            ok = (100 + percent) * differ.astype(np.int64) <= room[at + back] + room[at]
            yield rows[at[ok] + back], rows[at[ok]], differ[ok]

    def wide(c: list[np.ndarray], lo: int, hi: int, old: int) -> Iterator[tuple]:
        """Pairs within one list, a block of rows at a time."""
        m1, m2, room = c[3][lo:hi].view(np.uint64), c[4][lo:hi].view(np.uint64), ((100 - percent) * (c[2][lo:hi] >> 30)).astype(np.int32)
        step = max(1, BLOCK // (hi - lo))
        for k in range(max(old - lo, 0), hi - lo, step):
            end = min(k + step, hi - lo)
            differ = np.bitwise_count(m1[k:end, None] ^ m1[None, :end])
            differ += np.bitwise_count(m2[k:end, None] ^ m2[None, :end])
            y, x = np.nonzero((100 + percent) * differ.astype(np.int32) <= room[k:end, None] + room[None, :end])
            before = x < y + k
            y, x = y[before], x[before]
            yield y + k + lo, x + lo, differ[y, x]

    def run(it):
        held, cut = None, False  # the latest token's rows so far, and whether some of them have gone
        for batch in it:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy() for i in range(6)]
            old = 0
            if held is not None and held[0][0] == c[0][0]:
                old = len(held[0])
                c = [np.concatenate(x) for x in zip(held, c)]
            else:
                cut = False
            starts = np.flatnonzero(np.concatenate(([True], c[0][1:] != c[0][:-1])))
            sizes = np.diff(np.append(starts, len(c[0])))
            long = cut or sizes[0] > list_rows
            got = []
            rows = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
            if len(rows) > 1:
                got += [(y[new], x[new], d[new]) for y, x, d in short(c, rows) for new in [y >= old]]
            for g in np.flatnonzero(sizes > SHORT).tolist():
                lo, hi = int(starts[g]), int(starts[g] + sizes[g])
                if g == 0 and long or sizes[g] > list_rows:
                    for at in range(max(lo, old), hi, near):
                        part = np.unique(np.concatenate((np.arange(lo, min(lo + near, hi)), np.arange(max(lo, at - near), min(at + near, hi)))))
                        own = [x[part] for x in c]
                        got += [(part[y[new]], part[x[new]], d[new]) for y, x, d in wide(own, 0, len(part), 0) for new in [(part[y] >= at)]]
                else:
                    got += list(wide(c, lo, hi, old))
            size = int(sizes[-1])
            cut = (long if len(sizes) == 1 else False) or size > list_rows
            end = [x[int(starts[-1]) :] for x in c]
            held = [np.concatenate((x[:near], x[-near:])) if cut and size > 2 * near else x for x in end]
            y, x, d = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i in range(3))
            ok = likely(c, y, x, d) & (c[1][x] != c[1][y])
            y, x, d = y[ok], x[ok], d[ok]
            twin = c[5][x] == c[5][y]  # either may be the earlier line
            y, x, d = np.concatenate((y, x[twin])), np.concatenate((x, y[twin])), np.concatenate((d, d[twin])).astype(np.int64)
            order = np.lexsort((x, d, y))
            y, x, d = y[order], x[order], d[order]
            many = np.bincount(y, minlength=len(c[0]))
            place = np.arange(len(y)) - (np.cumsum(many) - many)[y]
            open_ = np.zeros(len(c[0]), dtype=bool)
            open_[np.repeat(sizes > list_rows, sizes)] = True
            if long:
                open_[: int(sizes[0])] = True
            bare = np.flatnonzero(open_ & (many == 0))
            bare = bare[bare >= old]
            more = open_ | (many > keep)
            best = place < keep
            y, x, d = y[best], x[best], d[best]
            sid, lead = np.concatenate((c[1][y], c[1][bare])), np.concatenate((c[1][x], c[1][bare]))
            none = np.concatenate((np.zeros(len(y), dtype=bool), np.ones(len(bare), dtype=bool)))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(lead, pa.int64(), mask=none), pa.array(np.concatenate((d, np.full(len(bare), NO_LEAD))), pa.int32()), pa.array(np.concatenate((more[y], more[bare])))], names=["sid", "lead", "differ", "more"])

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) with text cut, and array removed_lines (numbers from 0; null: none) added."""
    prepare(spark)
    scratch = Scratch(spark, "lines")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    table = spark.sparkContext.broadcast(frequency_table(docs.select("text"), _tokens))
    lines = scratch.write(keyed.mapInArrow(light(_index(table, percent, least_words)), f"row long, doc_id {kind}, line long, sid long, n long, skip long, prefix array<long>, m1 long, m2 long"), "indexed")
    slim = scratch.write(lines.select("row", "doc_id", "line", "sid"), "lines")
    classes = lines.groupBy("sid").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "skip", "m1", "m2")), F.max("prefix").alias("prefix"))
    classes = scratch.write(classes, "classes")
    firsts = classes.select("sid", "first", "copies")
    scratch.drop("indexed")
    meta = F.expr("shiftleft(n, 30) | (skip + pos + 1)").alias("meta")

    def postings(of: DataFrame) -> DataFrame:
        return of.select("sid", "n", "skip", "m1", "m2", F.col("first.doc_id").alias("doc"), F.posexplode("prefix").alias("pos", "word")).select(F.col("word").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("token"), "sid", meta, "m1", "m2", "doc")

    lists, low, high = postings(classes), None, None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        low, high = classes.agg(F.min("first.doc_id"), F.max("first.doc_id")).first()
    if low is not None and high - low + 1 < 1 << DOC_BITS:
        place = F.coalesce(F.col("doc").cast("long") - F.lit(low).cast("long") + 1, F.lit(0).cast("long"))  # a null id is the least
        lists = lists.select(F.shiftleft("token", DOC_BITS).bitwiseOR(place).alias("key"), "sid", "meta", "m1", "m2")
        token = F.shiftrightunsigned("key", DOC_BITS)
        lists = lists.repartition(token).sortWithinPartitions("key").select(token.alias("token"), "sid", "meta", "m1", "m2", F.col("key").bitwiseAND(F.lit((1 << DOC_BITS) - 1)).alias("doc"))
    else:
        lists = lists.repartition("token").sortWithinPartitions("token", "doc").select("token", "sid", "meta", "m1", "m2", F.xxhash64("doc").alias("doc"))
    found = scratch.write(lists.mapInArrow(light(_found(percent)), "sid long, lead long, differ int, more boolean"), "found")
    del lines, lists
    scratch.drop()

    def matched(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) of sids; of those that match, the later one (its first line comes later)."""
        pairs = scratch.write(pairs.distinct(), f"{name}-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = firsts.join(ends, "sid").select("first.row", "first.line").groupBy("row").agg(F.collect_list("line").alias("lines"))  # a text's own lines
        wanted = scratch.write(wanted, f"{name}-wanted")
        small = wanted.limit(BROADCAST_IDS + 1).agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first().n <= BROADCAST_IDS
        sets = keyed.select("row", "text").join(F.broadcast(wanted) if small else wanted, "row").select("text", "lines").mapInArrow(light(_sets), "sid long, toks binary")
        links = verify(pairs, sets, percent).distinct()
        x = links.join(firsts.select(F.col("sid").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("sid").alias("b"), F.col("first").alias("fb")), "b")
        found = scratch.write(x.select(F.expr("case when fa < fb then b else a end").alias("sid")).distinct(), f"{name}-gone")
        del sets, links, x, wanted, ends
        scratch.drop(f"{name}-wanted")
        return found

    best = found.filter("lead is not null").groupBy("sid").agg(F.min(F.struct("differ", "lead")).alias("best"))
    gone = matched(best.select(F.col("best.lead").alias("a"), F.col("sid").alias("b")), "star")
    scratch.drop("star-wanted")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = found.join(F.broadcast(gone) if small else gone, "sid", "left_anti")
    left = scratch.write(left.groupBy("sid", "lead").agg(F.max("more").alias("more")), "left")
    open_ = scratch.write(left.filter("more").select("sid").distinct(), "open")
    rest = left.filter("lead is not null").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    n_open = open_.limit(BROADCAST_IDS + 1).count()
    if n_open:
        late = postings(classes.join(F.broadcast(open_) if n_open <= BROADCAST_IDS else open_, "sid", "left_semi"))
        few = n_open <= BROADCAST_IDS and late.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        x, y = (side.select(*(F.col(c).alias(f"{p}{c}") for c in side.columns)) for side, p in ((postings(classes), "x"), (late, "y")))
        again = x.join(F.broadcast(y) if few else y, (x.xtoken == y.ytoken) & F.expr("coalesce(xdoc <= ydoc, xdoc is null) and xsid <> ysid and " + _possible("x", "y", percent)))
        rest = rest.union(again.select(F.col("xsid").alias("a"), F.col("ysid").alias("b")))
    done = spark.read.parquet(f"{scratch.base}/star-pairs")
    more = matched(rest.distinct().join(done, ["a", "b"], "left_anti"), "rest")
    bad = firsts.join(gone.union(more).distinct().withColumn("gone", F.lit(True)), "sid", "left").filter("copies > 1 or gone").select("sid", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    bad = scratch.write(bad, "bad")  # a table of its own: the join with a line that very many rows hold can be split
    cut = slim.join(bad, "sid").filter("gone or row <> first.row or line <> first.line")
    cut = scratch.write(cut.select("row", "line").distinct().groupBy("row").agg(F.collect_list("line").alias("removed_lines")), "cut")  # a text's own lines
    del found, best, left, open_, rest, done, bad, classes, firsts, slim
    scratch.drop("classes", "lines", "found", "left", "open", "star-pairs", "rest-pairs", "star-gone", "rest-gone", "bad")
    names = [c for c in docs.columns if c != "removed_lines"]
    carried = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)), F.xxhash64("doc_id", "text").alias("_row"))
    both = carried.join(cut.hint("shuffle_hash"), carried._row == cut.row, "left")  # the texts needn't be sorted
    text = F.col(f"_c{names.index('text')}")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("removed_lines", i.cast("long"))), "\n")
    text = F.when(F.col("removed_lines").isNull(), text).otherwise(kept)
    return both.select(*((text if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)), "removed_lines")
