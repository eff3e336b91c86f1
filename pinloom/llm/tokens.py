"""Byte-pair encoding with a public vocabulary, exact, in time linear in the text.

The last token of the encoding of a prefix is unique, and the encoding of a text consists of the last tokens met when
walking back from its end. So for each prefix of a word, in order, the one token is stored that ends there and is
compatible with the stored last token of the prefix before it: an automaton over all tokens lists those that end at a
byte, and a memoised test tells whether two tokens can stand side by side. Nothing is merged step by step, so a word
of a million letters costs a million steps.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pinloom.partitions import spread

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

# Fixed value of the format: what splits a text into words before any merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_WORDS, CACHED_LENGTH, CACHED_TESTS = 1 << 17, 48, 1 << 20


def printable_bytes() -> dict[str, int]:
    """The characters by which vocabulary files name bytes: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {chr(b): b for b in own}
    names.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))})
    return names


class Encoder:
    """Encodes with the merges of a vocabulary file; text that looks like a special token is ordinary text."""

    def __init__(self, path: str | Path) -> None:
        model = json.loads(Path(path).read_text())["model"]
        byte = printable_bytes()
        ids = model["vocab"]
        self.token = {i: bytes(byte[c] for c in name) for name, i in ids.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merge[a, b] = rank
            self.halves[whole], self.rank[whole] = (a, b), rank
        # (piece, rank of the merge that uses it up) along either edge of a token, outermost first
        self.edges: tuple[dict[int, list[tuple[int, float]]], ...] = ({}, {})
        self.tests: dict[tuple[int, int], bool] = {}
        usable = [t for t in sorted(self.token, key=lambda t: self.rank.get(t, -1)) if self._whole(t)]
        self.automaton = ahocorasick.Automaton()
        for t in usable:
            self.automaton.add_word(self.token[t].decode("latin-1"), (t, len(self.token[t])))
        self.automaton.make_automaton()
        self.direct = {self.token[t]: t for t in usable}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """The pieces that lie at the left (0) or right (1) edge of a token while it is built."""
        found = self.edges[side].get(t)
        if found is None:
            found = [(t, math.inf)]
            if t in self.halves:
                inner = self.halves[t][side]
                found += [(p, min(end, self.rank[t])) for p, end in self._edge(inner, side)]
            self.edges[side][t] = found
        return found

    def _crossed(self, a: int, b: int, but: int | None = None) -> bool:
        """Whether, while tokens a and b are built side by side, a merge would join a piece of a with one of b.

        A merge of the same rank further left goes first, so the left piece must outlive the merge, the right one may
        end with it. `but`: the rank of a merge that doesn't count.
        """
        right = self._edge(b, 0)
        for p, p_end in self._edge(a, 1):
            for q, q_end in right:
                rank = self.merge.get((p, q))
                if rank is not None and rank != but and rank < p_end and rank <= q_end:
                    return True
        return False

    def _whole(self, t: int) -> bool:
        """Whether the encoding of the token's own bytes is the token."""
        seen = self.__dict__.setdefault("_whole_seen", {})
        if t not in seen:
            halves = self.halves.get(t)
            seen[t] = len(self.token[t]) == 1 if halves is None else self._whole(halves[0]) and self._whole(halves[1]) and not self._crossed(*halves, but=self.rank[t])
        return seen[t]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is a, b."""
        found = self.tests.get((a, b))
        if found is None:
            if len(self.tests) >= CACHED_TESTS:
                self.tests.clear()
            found = self.tests[a, b] = not self._crossed(a, b)
        return found

    def encode_word(self, data: bytes) -> list[int]:
        whole = self.direct.get(data)
        if whole is not None:
            return [whole]
        last, length = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for at, (t, n) in self.automaton.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                before = end - n
                if before == 0 or (last[before] >= 0 and self.compatible(last[before], t)):
                    last[end], length[end] = t, n
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= length[end]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of an empty or null one, no ids."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode())
                if len(word) <= CACHED_LENGTH:
                    if len(words) >= CACHED_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process, made on first use."""
    path = str(Path(folder) / vocabulary)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row of `documents(doc_id, text)`; an empty or null text gives an empty list.

    One pass without a shuffle. Other columns are not read; repeated rows give repeated rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")
