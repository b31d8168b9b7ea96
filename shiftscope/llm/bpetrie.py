"""Byte-level BPE encoding by traversal of a trie of distinct words, and decoding.

The encoding of a word ends in one token, and what comes before it is the encoding of the word without that token. So the last token of
every prefix says all: it is the one token that ends the prefix and keeps apart from the last token of the prefix before it. The
distinct words of a batch go into a trie, and a depth-first walk finds the last token of every node once, whatever number of words share it.

Two neighbouring tokens keep apart if no merge across their border comes up before the merges that build them, which is read off the
pieces that touch the border while both are built.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

from shiftscope.llm.chunkcache import ChunkEncoder, Memory, plain
from shiftscope.llm.common import slices

#: Fixed by the format: how a byte-level tokenizer parts text into words.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NEVER = 1 << 62
#: Longer words are walked alone; as a path of nodes they would take much memory.
LONG = 256
BYTES = [bytes([b]) for b in range(256)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


class Vocabulary:
    """Tokens as bytes, how they are merged, and which of them keep apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, step = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.id = {self.bytes[i]: i for i in model["vocab"].values()}
        # every ending of a token: its id, or -1 where it is none itself
        self.endings = {t[k:]: -1 for t in self.id for k in range(1, len(t))} | self.id
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = rank
            if c in self.made:
                raise ValueError("a token with two merges is not supported")
            self.made[c] = (a, b, rank)
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}

    def _edge(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Pieces at the token's right and left border, smallest first, each with the rank of the merge that takes it up."""
        if token not in self.edges:
            sides = []
            for side in (1, 0):
                pieces, until = [], NEVER
                piece = token
                while True:
                    pieces.append((piece, until))
                    if piece not in self.made:
                        break
                    until = self.made[piece][2]
                    piece = self.made[piece][side]
                sides.append(pieces[::-1])
            self.edges[token] = (sides[0], sides[1])
        return self.edges[token]

    def keeps_apart(self, a: int, b: int) -> bool:
        """``a`` then ``b`` is the encoding of their bytes, if each is of its own."""
        key = a * self.size + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            left, right = self._edge(a)[0], self._edge(b)[1]
            i = j = 0
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                m = self.rank.get((x, y), NEVER)
                if m < x_until and m <= y_until:  # of equal merges the left one comes first
                    known = False
                    break
                if x_until == NEVER and y_until == NEVER:
                    known = True
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def is_whole(self, token: int) -> bool:
        """The token is the encoding of its own bytes."""
        known = self.whole.get(token)
        if known is None:
            parts = [self.id[bytes([c])] for c in self.bytes[token]]
            while len(parts) > 1:
                rank, k = min((self.rank.get((x, y), NEVER), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                parts[k : k + 2] = [self.id[self.bytes[parts[k]] + self.bytes[parts[k + 1]]]]
            known = self.whole[token] = parts == [token]
        return known

    def last_token(self, path: bytes, depth: int, last: list[int]) -> int:
        """Last token of ``path[:depth]``; ``last`` has those of the shorter prefixes. Only one token fits, so the first found is it."""
        find, apart, size = self.endings.get, self.apart.get, self.size
        for start in range(depth - 1, -1, -1):
            token = find(path[start:depth])
            if token is None:
                break
            if token >= 0:
                if start == 0:
                    fits = self.is_whole(token)
                else:
                    fits = apart(last[start] * size + token)
                    if fits is None:
                        fits = self.keeps_apart(last[start], token)
                if fits:
                    return token
        raise ValueError("a byte is missing in the vocabulary")

    def _collect(self, depth: int, last: list[int]) -> list[int]:
        out = []
        while depth:
            out.append(last[depth])
            depth -= len(self.bytes[last[depth]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """ids of every word of ``words`` (distinct, not empty)."""
        out: list[list[int]] = [[]] * len(words)
        root: dict = {}
        for k, word in enumerate(words):
            if len(word) > LONG:
                last = [0]
                for depth in range(1, len(word) + 1):
                    last.append(self.last_token(word, depth, last))
                out[k] = self._collect(len(word), last)
                continue
            node = root
            for c in word:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[-1] = k
        path, last = b"", [0] * (LONG + 1)
        stack = [(c, node, 0) for c, node in root.items()]
        while stack:
            c, node, depth = stack.pop()
            path = path[:depth] + BYTES[c]
            depth += 1
            last[depth] = self.last_token(path, depth, last)
            for step, below in node.items():
                if step == -1:
                    out[below] = self._collect(depth, last)
                else:
                    stack.append((step, below, depth))
        return out


class TrieEncoder(ChunkEncoder):
    """Encodes whole texts; pieces and words met before are remembered up to a bound."""

    def __init__(self, path: str, keep: int = 700_000):
        self.vocabulary = Vocabulary(path)
        self.size = self.vocabulary.size
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.keep = keep
        self.split = ByteLevel(add_prefix_space=False, use_regex=True)
        self.known, self.first, self.words, self.loose = Memory({}), {}, {}, False
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True))) + ")") if self.vocabulary.added else None

    def _parts(self, text: str) -> list:
        """Words (bytes) and ids of added tokens of a text, in order."""
        if plain(text[1:]) and text[0] == " " or plain(text):
            return [text.encode()]
        if self.special and self.special.search(text):
            return [x for k, t in enumerate(self.special.split(text)) for x in ([self.vocabulary.added[t]] if k % 2 else self._parts(t) if t else [])]
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):  # libraries know different versions of Unicode
            return [text[a:b].encode() for _, (a, b) in self.split.pre_tokenize_str(text)]
        return [w.encode() for w in WORDS.findall(text)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) if t else [] for t in texts]
        new = list({w for own in parts for w in own if isinstance(w, bytes) and w not in self.words})
        if len(self.words) > self.keep // 2:
            self.words.clear()
            new = list({w for own in parts for w in own if isinstance(w, bytes)})
        self.words.update((w, np.array(ids, self.dtype).tobytes()) for w, ids in zip(new, self.vocabulary.encode_words(new)))
        of = self.words
        return [b"".join([of[w] if isinstance(w, bytes) else np.array([w], self.dtype).tobytes() for w in own]) for own in parts]

    def _learn_after_space(self, new: list[str]) -> None:
        self.known.update(zip(new, self._plain([p if p.startswith("\n") else " " + p for p in new])))


@lru_cache(maxsize=1)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = byte_letters(), {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *added]) + 1)
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token)
    for i, token in added.items():
        out[i] = token
    return out


def encoded(docs: DataFrame, tokenizer: str, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text. A null text is empty; an empty text has no ids.

    ``decode`` adds ``text``, decoded from the ids as in ``decoded``, in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = trie_encoder(tokenizer)
        find = encode.vocabulary.bytes.__getitem__
        for batch in slices(batches):
            short = [np.frombuffer(raw, encode.dtype) for raw in encode(batch.column(1).to_pylist())]
            columns = {"doc_id": batch.column(0), "ids": pa.array([ids.astype("<u4").tobytes() for ids in short], pa.binary())}
            if decode:
                columns["text"] = pa.array([b"".join(map(find, ids.tolist())).decode("utf-8", "replace") for ids in short], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    schema = "doc_id long, ids binary" + ", text string" * decode
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(encodings: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text: the bytes of all tokens, added ones included, read as UTF-8; what isn't becomes U+FFFD. Null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = token_bytes(tokenizer).__getitem__
        for batch in slices(batches):
            texts = [None if raw is None else b"".join(map(find, np.frombuffer(raw, "<u4").tolist())).decode("utf-8", "replace") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
