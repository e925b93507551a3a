"""Token counts by count-only Viterbi over a unigram vocabulary.

Pieces and scores are those of a SentencePiece model file, read as a unigram vocabulary. Aho-Corasick
lists the matches that end at each character; dynamic programming carries the best score and its
number of pieces, without back pointers. Ties go by the tokenizer's rule: for one end, matches come
with the earliest start first and only a strictly better score replaces. A character that is no piece
costs the lowest score less 10 and counts as its UTF-8 bytes. A space stands for U+2581, and a text
starts with one. Stretches that no piece crosses are counted once and remembered (bounded).

Nulls: a null or empty text has 0 tokens. Null doc_ids and repeated rows stay. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare
from .pieces import SPACE, STRETCH, Vocabulary, default_model, opened

CACHED = 800_000
UNKNOWN_LESS = 10.0


class Counter:
    def __init__(self, path: str):
        self.vocabulary = opened(Vocabulary, path)
        score = self.vocabulary.score
        self.machine = self.vocabulary.automaton(lambda i, p: (len(p), score[i]))
        self.unknown = self.vocabulary.lowest - UNKNOWN_LESS
        self.single = {self.vocabulary.pieces[i] for i in score if len(self.vocabulary.pieces[i]) == 1}
        self.seen: dict[str, int] = {}

    def stretch(self, s: str) -> int:
        """How many pieces its best segmentation has."""
        if len(self.seen) >= CACHED:
            self.seen.clear()
        text = s.replace(" ", SPACE)
        count = self._plain(text) if s != SPACE and self.single.issuperset(text) else self._general(text, s == SPACE)
        self.seen[s] = count
        return count

    def _plain(self, text: str) -> int:
        """Every character is a piece."""
        best, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        for last, (size, score) in self.machine.iter(text):
            x = best[last + 1 - size] + score
            if x > best[last + 1]:
                best[last + 1], count[last + 1] = x, count[last + 1 - size] + 1
        return count[-1]

    def _general(self, text: str, literal: bool) -> int:
        n = len(text)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, match in self.machine.iter(text) if not literal else ():
            ending[last].append(match)
        for last, matches in enumerate(ending):
            e = last + 1
            for size, score in matches:
                x = best[e - size] + score
                if x > best[e]:
                    best[e], count[e] = x, count[e - size] + 1
            if literal or text[last] not in self.single:
                x = best[last] + self.unknown
                if x > best[e]:
                    best[e], count[e] = x, count[last] + len(text[last].encode("utf-8", "replace"))
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        get, stretch = self.seen.get, self.stretch
        return sum(get(s) or stretch(s) for s in STRETCH.findall(" " + text))


def count_tokens(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs (doc_id, text). model: a path that every executor has."""
    prepare(spark)
    path, kind = model or default_model(), docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        count = opened(Counter, path)
        for batch in it:
            found = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
