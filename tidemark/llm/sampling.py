"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text falls into stretches that no piece crosses; over each, the pieces that match make a lattice.
Forward filtering sums the weights of all paths to each character; backward sampling then draws
pieces from the end, each with its share of what reaches its end. The draws are a hash of the row
key, the stretch's number in its row and the step, so a row's result doesn't depend on partitions,
batches or other rows. A piece of score s weighs (2 - s) ** -SHARPNESS: the vocabulary's scores are
merge ranks, so this is a Zipf law. A character that is no piece, and a literal U+2581, become bytes.

Lattices of stretches are remembered (bounded) and many stretches are drawn at once.

Nulls: a null or empty text has no pieces (null stays null when decoded); a null key counts as its
own key. Rows with equal key and text get equal segmentations. Empty table: no rows. Texts are drawn whole,
with memory in proportion to the longest one; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prepare
from .pieces import SPACE, STRETCH, Trie, Vocabulary, default_model, opened

SHARPNESS = 1.0
CACHED = 300_000
#: Stretches drawn at once, about.
DRAWN = 200_000


class Edges:
    """Columns that grow at the end; their room doubles."""

    def __init__(self, *kinds: type):
        self.size, self.columns = 0, [np.empty(1 << 12, dtype=k) for k in kinds]

    def extend(self, *new: np.ndarray) -> None:
        need = self.size + len(new[0])
        if need > len(self.columns[0]):
            self.columns = [np.concatenate((c[: self.size], np.empty(2 * need - self.size, dtype=c.dtype))) for c in self.columns]
        for c, x in zip(self.columns, new):
            c[self.size : need] = x
        self.size = need


class Lattices:
    """Flat arrays over all remembered stretches: nodes are characters' ends, edges lead back."""

    def __init__(self, path: str):
        v = self.vocabulary = opened(Vocabulary, path)
        self.weight = np.zeros(len(v.pieces))
        for i, s in v.score.items():
            self.weight[i] = (2.0 - s) ** -SHARPNESS
        self.fallback = (2.0 - 2 * v.lowest) ** -SHARPNESS
        self.trie = Trie(v)
        self.raw = [p.replace(SPACE, " ").encode() for p in v.pieces]
        self.byte = np.array([v.byte[b] for b in range(256)])
        for b, i in v.byte.items():
            self.raw[i] = bytes([b])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first = Edges(np.int64)  # each stretch's node 0, and the end
        self.first.extend(np.zeros(1, dtype=np.int64))
        self.edges = Edges(np.float64, np.int32, np.int32)  # node + share of the node's sum up to this edge, the node it comes from, its piece

    def _matches(self, new: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge; a stretch has a slot for each character and one more, at its end."""
        letters = np.frombuffer(("\n".join(new) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        text = np.where(letters == ord(" "), ord(SPACE), np.where(letters == ord(SPACE), ord("\n"), letters))
        start, size, piece = self.trie(text)
        end = start + size
        bare = np.ones(len(text), dtype=bool)  # characters that are no piece
        bare[end[size == 1] - 1] = False
        bare[slot[1:] - 1] = False
        bare = np.flatnonzero(bare)
        start, end, piece = np.concatenate((start, bare)), np.concatenate((end, bare + 1)), np.concatenate((piece, -1 - letters[bare]))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    def add(self, new: list[str]) -> None:
        """Lattices of these stretches, filtered forward together."""
        base = int(self.first.columns[0][self.first.size - 1])
        size = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1
        slot = np.concatenate(([0], np.cumsum(size)))
        start, end, piece = self._matches(new, slot)
        weight = np.log(np.where(piece >= 0, self.weight[np.maximum(piece, 0)], self.fallback))
        nodes = int(slot[-1])
        depth = (np.arange(nodes) - np.repeat(slot[:-1], size))[end]
        log = np.zeros(nodes)  # of the sum of all paths' weights
        share = np.zeros(len(end))
        level = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[level], np.arange(1, int(size.max()) + 1)) if len(level) else []
        for lo, hi in zip(bounds[:-1], bounds[1:]) if len(level) else ():
            e = level[lo:hi]
            if not len(e):
                continue
            x = log[start[e]] + weight[e]
            node = end[e]
            head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            many = np.diff(np.append(head, len(e)))
            top = np.repeat(np.maximum.reduceat(x, head), many)
            total = np.log(np.add.reduceat(np.exp(x - top), head)) + top[head]
            log[node[head]] = total
            share[e] = np.exp(x - np.repeat(total, many))
        run = np.cumsum(share)
        head = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1]))) if len(end) else np.zeros(0, dtype=np.int64)
        run -= np.repeat(run[head] - share[head], np.diff(np.append(head, len(end))))
        if len(end):
            run[np.append(head[1:], len(end)) - 1] = 1.0
        self.edges.extend(run + end + base, start + base, piece)
        self.number.update(zip(new, range(self.first.size - 1, self.first.size - 1 + len(new))))
        self.first.extend(slot[1:] + base)

    def draw(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece codes of each stretch in order, one after another, and how many each has."""
        first, (cum, back, code) = self.first.columns[0], self.edges.columns
        cum = cum[: self.edges.size]
        node, stop = first[which + 1] - 1, first[which]
        live = np.argsort(which, kind="stable")  # so that searches go through the edges in order
        live = live[node[live] > stop[live]]
        steps, count, step = [], np.zeros(len(which), dtype=np.int64), 0
        while len(live):
            u = (mix(seed[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            at = node[live]
            e = np.searchsorted(cum, np.minimum(at + u, np.nextafter(at + 1.0, 0)), side="right")
            steps.append((live, code[e]))
            count[live] += 1
            node[live] = back[e]
            live = live[node[live] > stop[live]]
            step += 1
        last = np.cumsum(count)
        out = np.empty(int(last[-1]) if len(last) else 0, dtype=np.int64)
        for k, (who, piece) in enumerate(steps):
            out[last[who] - 1 - k] = piece
        return out, count

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids, with the ids of their bytes for characters without a piece, and where each code's ids start (and the end)."""
        at = np.flatnonzero(codes < 0)
        if not len(at):
            return codes, np.arange(len(codes) + 1)
        code = {c: np.frombuffer(chr(-1 - c).encode("utf-8", "replace"), dtype=np.uint8) for c in np.unique(codes[at]).tolist()}
        own = [code[c] for c in codes[at].tolist()]
        wide = np.ones(len(codes), dtype=np.int64)
        wide[at] = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        place = np.concatenate(([0], np.cumsum(wide)))
        out = np.repeat(codes, wide)
        out[out < 0] = self.byte[np.concatenate(own)]
        return out, place

    def encode(self, rows: list[tuple[int, str | None]]) -> list[np.ndarray]:
        """Ids for each (seed, text)."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(rows)
        k = 0
        while k < len(rows):
            if len(self.number) >= CACHED:
                self.clear()
            found, seeds, ends, lo = [], [], [], k
            while k < len(rows) and len(found) < DRAWN:
                seed, text = rows[k]
                stretches = STRETCH.findall(" " + text) if text else []
                found += stretches
                seeds.append(mix(np.uint64(seed & ((1 << 64) - 1)) + np.arange(len(stretches), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                ends.append(len(found))
                k += 1
            self.learn(found)
            which = np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))
            codes, count = self.draw(which, np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64))
            ids, place = self.expand(codes)
            cut = place[np.concatenate(([0], np.cumsum(count)))[[0, *ends]]]
            for i in range(lo, k):
                out[i] = ids[cut[i - lo] : cut[i - lo + 1]]
        return out

    def learn(self, stretches: list[str]) -> None:
        new = [s for s in dict.fromkeys(stretches) if s not in self.number]
        if new:
            self.add(new)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def sample_pieces(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for each row of docs (doc_id, text): sampled piece ids and what they decode to."""
    return _mapped(spark, docs, model, "ids array<int>, text string", lambda lattices, texts, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([None if t is None else lattices.decode(x) for t, x in zip(texts, ids)], pa.string())])


def sample_digests(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless): of the sampled ids as little-endian 32-bit numbers."""

    def digest(lattices, texts, ids):
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([lattices.decode(x) == (t or "") for t, x in zip(texts, ids)], pa.bool_())]

    return _mapped(spark, docs, model, "n_pieces long, ids_crc32 long, lossless boolean", digest)


def _mapped(spark: SparkSession, docs: DataFrame, model: str | None, columns: str, result) -> DataFrame:
    prepare(spark)
    path, kind = model or default_model(), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(it):
        lattices = opened(Lattices, path)
        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(2).to_pylist()
                ids = lattices.encode(list(zip(part.column(1).to_pylist(), texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), *result(lattices, texts, ids)], names=names)

    return docs.select("doc_id", F.xxhash64("doc_id").alias("seed"), "text").mapInArrow(run, f"doc_id {kind}, {columns}")
