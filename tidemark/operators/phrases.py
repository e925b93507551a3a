"""Rows whose text holds one of a set of phrases, or lies within one: no row is joined with each phrase.

The phrases are dealt into blocks of bounded size. A block is an automaton on each executor, which reads
a text once, whatever the number of phrases; for the other direction the short texts of a batch are an
automaton, which reads the block's phrases once. All blocks are passes over the rows, one after another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters of the phrases of a block, and of the short texts held together: tens of MB of automaton.
BLOCK_CHARS = 1 << 20


def automaton(words):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def within(texts: set[str], phrases: list[str]) -> set[str]:
    """The texts that lie within a phrase."""
    hit, held, size = set(), [], 0
    for t in [*sorted(texts), None]:
        if held and (t is None or size + len(t) > BLOCK_CHARS):
            known = automaton(held)
            for p in phrases:
                hit.update(w for _, w in known.iter(p))
            held, size = [], 0
        if t is not None:
            held.append(t)
            size += len(t)
    return hit


def hits(texts: list[str | None], phrases: list[str], known) -> list[bool]:
    """Of each text; a null one has none, an empty one lies within any phrase."""
    longest = max(map(len, phrases))
    found = [t is not None and (t == "" or next(known.iter(t), None) is not None) for t in texts]
    short = {t for t, f in zip(texts, found) if t and not f and len(t) <= longest}
    inside = within(short, phrases) if short else set()
    return [f or t in inside for t, f in zip(texts, found)]


def without(rows: DataFrame, text: str, phrases: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows but those whose column text hits one of phrases (one column, no nulls, none empty). Columns stay."""
    spark = rows.sparkSession
    ship(spark)
    phrase = phrases.columns[0]
    size = phrases.agg(F.sum(F.length(phrase))).first()[0] or 0
    blocks, at, schema = -(-size // block_chars), rows.columns.index(text), rows.schema
    for i in range(blocks):
        own = phrases.filter(F.pmod(F.xxhash64(phrase), F.lit(blocks)) == i)
        block = spark.sparkContext.broadcast([r[0] for r in own.collect()])  # one block, about block_chars

        def keep(it, block=block):
            known = automaton(block.value) if block.value else None
            for batch in it:
                if known is None or not batch.num_rows:
                    yield batch
                    continue
                yield batch.filter(pa.array([not h for h in hits(batch.column(at).to_pylist(), block.value, known)], pa.bool_()))

        rows = rows.mapInArrow(keep, schema)
    return rows
