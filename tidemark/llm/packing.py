"""Sum-of-squares online packing of tokenized documents into fixed-length sequences.

Each partition packs its documents as they come, without a shuffle. A document's whole sequences
are cut off first. The rest goes to the fill level (0: a new sequence) that makes the sum of the
squared counts of partially filled sequences, kept in an array by level, least; ties take the
fullest. At the partition's end, and when more than MOST_OPEN are open, the open sequences keep what was
placed in them and are filled up with the pieces of the emptiest ones; the last tokens go into sequences
whose lengths are powers of two, which need no padding. `moved` counts the ids that filling moves.
Sequence ids are the partition's number in the high bits and a counter in the low 40.

A task that is run again reads the same split in the same order and gives the same rows. Memory is
the open sequences (at most MOST_OPEN of 8 KB each), bounded caches of words, and one text: a very long one is cut
at white space for the tokenizer and packed whole.

Nulls: a null text is empty and holds the end token alone; a null doc_id is kept. Repeated rows are
packed each. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import light, prepare, remembered

SEQUENCE = 2048
END_ID = 1
#: Words whose ids are remembered by a Python worker.
CACHED = 300_000
SLICE = 1 << 20
#: Open sequences of a partition; beyond that many they are filled up and closed.
MOST_OPEN = 4_096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts, equal to Tokenizer.encode(add_special_tokens=False), by remembered words.

    The tokenizer never joins across white space, so a text's ids are those of its words in turn.
    Texts with special strings or with separators on which libraries differ go to it whole.
    """

    ODD = regex.compile(r"[\x1c-\x1f᠎​]|<\|(?:start|end)oftext\|>")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed: the vocabulary's own pattern
    WIDE = regex.compile(r"[^\x00-ɏ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown}
        for n, b in enumerate(b for b in range(256) if b not in self.shown):
            self.shown[b] = chr(256 + n)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHED:
                self.parts.clear()
            ids = [t.id for t in self.tokenizer.model.tokenize("".join(map(self.shown.__getitem__, part.encode())))]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: str) -> bytes:
        if len(self.words) >= CACHED:
            self.words.clear()
        out = self._whole(word) if self.WIDE.search(word) else b"".join(map(self._part, self.PARTS.findall(word)))
        self.words[word] = out
        return out

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
        if self.ODD.search(text):
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                end = m.start() if (m := regex.compile(r"\s").search(text, end)) else len(text)
            part = unicodedata.normalize("NFC", text[at:end]).replace("Σ", "σ").lower()
            get, word = self.words.get, self._word
            out.append(b"".join([get(w) or word(w) for w in part.split()]))
            at = end
        return b"".join(out)


#: Word ids stay with a worker until it does another operator's task.
OWNER = "packing"


def word_ids(path: str) -> WordIds:
    if (OWNER, path) not in remembered:
        remembered[OWNER, path] = WordIds(path)
    return remembered[OWNER, path]


class Packer:
    """Places runs of ids; rows are (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_id: int, size: int = SEQUENCE):
        self.size, self.next, self.rows = size, first_id, []
        self.opened = self.moved = 0  # open sequences; ids that filling has moved from where they were placed
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def level(self, r: int) -> int:
        """Where r ids go: the change of the sum of squares is least."""
        n, size = self.count, self.size
        new = 2 * n[r] + 1
        have = n[1 : size - r + 1]
        change = 1 - 2 * have
        change[:-1] += 2 * n[1 + r : size] + 1
        change[have == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else 0
        return best + 1 if len(change) and change[best] <= new else 0

    def add(self, doc, ids: bytes) -> None:
        total, wide = len(ids) // 4, 4 * self.size
        at = 0
        while len(ids) - at >= wide:
            self._close([(doc, at // 4, ids[at : at + wide], total)])
            at += wide
        r = total - at // 4
        if not r:
            return
        h = self.level(r)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
        pieces.append((doc, at // 4, ids[at:], total))
        if h + r == self.size:
            self.opened -= bool(h)
            self._close(pieces)
        else:
            self.open.setdefault(h + r, []).append(pieces)
            self.count[h + r] += 1
            self.opened += not h
            if self.opened > MOST_OPEN:
                pieces = self._fill()
                if pieces:
                    h = sum(len(p[2]) for p in pieces) // 4
                    self.open[h], self.count[h], self.opened = [pieces], 1, 1

    def _fill(self) -> list:
        """Closes the open sequences, each filled from the emptiest ones; gives back the pieces of the one that is left."""
        seqs = [[h, pieces] for h in sorted(self.open, reverse=True) for pieces in self.open[h]]
        self.open, self.opened = {}, 0
        self.count[:] = 0
        i, j = 0, len(seqs) - 1
        while i < j:
            h, pieces = seqs[i]
            room = self.size - h
            while room and i < j:
                doc, start, ids, total = seqs[j][1].pop()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    seqs[j][1].append((doc, start + take, ids[4 * take :], total))
                room -= take
                self.moved += take
                j -= not seqs[j][1]
            if room:
                return pieces
            self._close(pieces)
            i += 1
        return seqs[i][1] if i == j else []

    def finish(self) -> None:
        left = self._fill()[::-1]
        rest = sum(len(p[2]) for p in left) // 4
        for size in (1 << k for k in range(self.size.bit_length(), -1, -1) if rest >> k & 1):
            pieces, room = [], size
            while room:
                doc, start, ids, n = left.pop()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    left.append((doc, start + take, ids[4 * take :], n))
                room -= take
            self._close(pieces)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of docs (doc_id, text). tokenizer: a path that every executor has."""
    prepare(spark)
    path, kind = tokenizer or default_tokenizer(), docs.schema["doc_id"].dataType.simpleString()
    end = struct.pack("<I", END_ID)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(it):
        ids, packer = word_ids(path), Packer(TaskContext.get().partitionId() << 40, size)

        def rows(id_type):
            columns = list(zip(*packer.rows)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        id_type = pa.int64()
        for batch in it:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, ids(text.as_py()) + end)
                if len(packer.rows) >= 8192:
                    yield rows(id_type)
        packer.finish()
        yield rows(id_type)

    return docs.select("doc_id", "text").mapInArrow(light(run, OWNER), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
