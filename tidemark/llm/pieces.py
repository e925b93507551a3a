"""The vocabulary of a SentencePiece model file, and how texts fall into stretches that no piece crosses."""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
#: A text after one leading space: spaces with the word that follows, newlines, and literal U+2581.
STRETCH = re.compile("\n|▁| *[^ \n▁]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces that match text, with ids and scores; other characters fall back to UTF-8 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.score = {i: sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        crossing = [p for i in self.score if "\n" in (p := self.pieces[i]) or SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces cross stretches: {crossing[:3]}")
        self.lowest = min(self.score.values())

    def automaton(self, value):
        """Aho-Corasick over the pieces; value(id, piece) is what a match gives."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i in self.score:
            machine.add_word(self.pieces[i], value(i, self.pieces[i]))
        machine.make_automaton()
        return machine


class Trie:
    """All pieces that start anywhere in a text, found for all places at once."""

    CHAR_BITS = 21

    def __init__(self, vocabulary: Vocabulary):
        child: dict[tuple[int, str], int] = {}
        piece = [-1]
        for i in vocabulary.score:
            at = 0
            for c in vocabulary.pieces[i]:
                if (at, c) not in child:
                    child[at, c] = len(piece)
                    piece.append(-1)
                at = child[at, c]
            piece[at] = i
        self.piece = np.array(piece)
        self.root = np.zeros(1 << self.CHAR_BITS, dtype=np.int64)
        deeper = []
        for (at, c), to in child.items():
            if at:
                deeper.append((at << self.CHAR_BITS | ord(c), to))
            else:
                self.root[ord(c)] = to
        deeper.sort()
        self.key, self.to = (np.array(x, dtype=np.int64) for x in zip(*deeper)) if deeper else (np.zeros(1, dtype=np.int64) - 1, np.zeros(1, dtype=np.int64))

    def __call__(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every match in code points, the longest first."""
        at, state, n, found = np.arange(len(text)), self.root[text], 1, []
        while True:
            alive = state > 0
            at, state = at[alive], state[alive]
            piece = self.piece[state]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
            inside = at + n < len(text)
            at, state = at[inside], state[inside]
            if not len(at):
                return tuple(np.concatenate([f[i] for f in reversed(found)]) for i in range(3))
            key = state << self.CHAR_BITS | text[at + n]
            where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            state = np.where(self.key[where] == key, self.to[where], 0)
            n += 1


_open: dict[tuple, object] = {}


def opened(kind, *args):
    """One object of a kind for each Python worker."""
    key = (kind.__name__, *args)
    if key not in _open:
        _open[key] = kind(*args)
    return _open[key]
