"""Whole-text encoding with the ``tokenizers`` library, run once per distinct chunk.

Both pre-tokenizers in use start a new token at white space that follows a non-space character, so a text may be cut there and
the ids of the pieces joined. Texts repeat their pieces, so each task keeps the ids of the pieces it has met.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

SPACE = " \t\n\r\x0b\x0c"
#: A text with one of these has white space that is not single spaces and line breaks between words.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x01")
POINTS = ".,;:!?"
#: Pieces a task remembers; with their ids they take about 200 MB.
KEEP = 900_000
#: Pieces encoded as one string.
LOT = 5_000
#: Texts encoded at a time; all their words are held at once.
TEXTS = 250
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beyond ASCII may join a run across a cut; such texts are encoded in one piece.
ODD = tuple(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def has_any(text: str, parts: tuple[str, ...]) -> bool:
    return any(p in text for p in parts)


def odd(text: str) -> bool:
    return has_any(text, ODD[:4] if text.isascii() else ODD)


def plain(text: str) -> bool:
    """Letters alone, in lower case too (some letters become a letter and a mark)."""
    return text.isalpha() and (text.isascii() or text.lower().isalpha())


class Memory(dict):
    """ids by piece. A piece that is met for the first time gets an empty slot, which is filled once all new pieces of a batch are encoded."""

    def __init__(self, older: dict[str, bytes]):
        super().__init__()
        self.older: dict[str, bytes] = older
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytes | bytearray:
        found = self.older.get(piece)
        if found is None:
            found = bytearray()
            self.new.append(piece)
        self[piece] = found
        return found


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned bytes of ``width`` bytes each.

    ``keep`` bounds the number of remembered pieces, in two generations: when the younger is full it becomes the older, and what of that
    isn't met again is forgotten, which costs time only.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.keep = keep
        self.known = Memory({})
        self.first: dict[str, bytes] = {}
        # ids whose token starts with the mark of a space open the pieces of a long string of new pieces
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        # a vocabulary without such marks: a special token between the pieces
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized)]
        self.between = plain[0] if plain else None
        self.marked = int(self.opens.sum()) > 1000
        # ids that end a word: without other marks, they part words of letters alone
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.points = dict(zip(POINTS, self._plain(list(POINTS))))
        # white space that only parts words is no part of any piece
        words = ["word", "Ünder9", "it's", "...", "(a"]
        self.loose = not self.marked and all(self._plain([w, " " + w, "\n" + w]) == 3 * self._plain([w]) for w in words) and self._plain([" \n".join(words)]) == [b"".join(self._plain(words))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_after_space(self, new: list[str]) -> None:
        """Ids of ``" " + piece`` for every new piece (of the piece itself where it starts with a line break).

        A full stop or the like after a word is a token of its own, so such a piece is its word's ids and the point's.
        """
        letters, pointed, simple, other = set(), [], [], []
        for p in new:
            if plain(p):
                letters.add(p)
            elif p[-1:] in self.points and plain(p[:-1]):
                pointed.append(p)
                if p[:-1] not in self.known:
                    if p[:-1] in self.known.older:
                        self.known[p[:-1]] = self.known.older[p[:-1]]
                    else:
                        letters.add(p[:-1])
            elif p and "\n" not in p and "<|" not in p and (self.marked or self.between):
                simple.append(p)
            else:
                other.append(p)
        words = list(letters)
        if self.marked:
            words, simple = words + simple, []
        for at in range(0, len(words), LOT):
            self._joined(words[at : at + LOT], " ", simple)
        for at in range(0, len(simple), LOT):
            self._joined(simple[at : at + LOT], self.between[1], other)
        self.known.update(zip(other, self._plain([p if p.startswith("\n") else " " + p for p in other])))
        self.known.update((p, self.known[p[:-1]] + self.points[p[-1]]) for p in pointed)

    def _joined(self, part: list[str], mark: str, fallback: list[str]) -> None:
        """Encode many pieces as one string and take it apart; where the parts don't come out even, leave them to ``fallback``."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + mark.join(part)], add_special_tokens=False)[0].ids, self.dtype)
        if mark != " ":
            cuts = np.flatnonzero(ids == self.between[0])
            starts, ids = np.concatenate([[0], cuts - np.arange(len(cuts))]), np.delete(ids, cuts)
        elif self.marked:
            starts = np.flatnonzero(self.opens[ids])
        else:
            starts = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])[:-1]
        if len(starts) != len(part):
            fallback += part
            return
        raw, width = ids.tobytes(), self.dtype.itemsize
        edges = [*(starts * width).tolist(), len(raw)]
        self.known.update(zip(part, map(lambda a, b: raw[a:b], edges, edges[1:])))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.keep // 2:
            self.known.older = {}
            self.known = Memory(self.known)
        if len(self.first) > self.keep:
            self.first.clear()
        look_up, pieces, firsts = self.known.__getitem__, [], []
        for text in texts:
            if not text or text[0] in SPACE or text[-1] in SPACE or has_any(text, RUNS) or odd(text):
                pieces.append(None)
                firsts.append(None)
                continue
            own = iter(text.split() if self.loose else text.replace("\n", " \n").split(" "))
            firsts.append(next(own))
            pieces.append(list(map(look_up, own)))  # ids, or slots to be filled
        new, self.known.new = self.known.new, []
        slots = list(map(look_up, new))
        self._learn_after_space(new)
        for slot, ids in zip(slots, map(look_up, new)):
            slot += ids
        fresh = list({p for p in firsts if p is not None and p not in self.first})
        self.first.update(zip(fresh, self._plain(fresh)))
        out = [b"" if p is None else self.first[f] + b"".join(p) for f, p in zip(firsts, pieces)]
        for at, (text, own) in enumerate(zip(texts, pieces)):
            if own is None and text:
                out[at] = self._runs(text)
        return out

    def _runs(self, text: str) -> bytes:
        """A text with runs of white space or unusual characters."""
        if odd(text):
            return self._plain([text])[0]
        chunks = CHUNK.findall(text)
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.first]
        self.first.update(zip(fresh, self._plain(fresh)))
        return b"".join(map(self.first.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(path: str, keep: int = KEEP) -> ChunkEncoder:
    """One encoder per Python worker, vocabulary file and number of remembered pieces."""
    return ChunkEncoder(path, keep)
