"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a transducer over bytes.  A token t can end a prefix of a piece of
text exactly if the encoding of what comes before t ends in a token u such that u followed by t is
itself left alone by the merges; there is one such t for every prefix.  A state holds the live
hypotheses (place in the vocabulary trie, last token, tokens not yet emitted); what all of them
share is emitted, so output lags by a bounded lookahead (the longest token).  States and their
transitions are made when they are first met (lazy determinisation) and forgotten together when
there are too many, which costs time and changes nothing.

Decoding is streaming: an incremental UTF-8 state machine takes the bytes of the tokens.

Defined results: null and empty texts both get an empty list of ids; the strings of special
tokens inside a text are ordinary text; no special tokens are added.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how byte-level BPE of this family cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by the rule of this family."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str = VOCABULARY, most_states: int = 200_000, most_words: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        #: special tokens are never encoded, but ids of other origin may hold them
        self.special = {t["id"]: t["content"].encode() for t in whole.get("added_tokens") or []}
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in model["vocab"].items() if all(c in letters for c in s)}
        by_text = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(by_text[a], by_text[b]): (r, by_text[a + b]) for r, (a, b) in enumerate(merges)}
        self.byte_id = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        # trie: child of (node, byte) and token that ends at a node
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for i, b in self.bytes_of.items():
            at = 0
            for x in b:
                key = at * 256 + x
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                at = self.child[key]
            self.ends[at] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.most_states, self.most_words = most_states, most_words
        self.words: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(PIECES).findall
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1, ()),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges as they are defined: lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in data]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            to, out, i = self.rank[pair][1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(to)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fit(self, u: int, t: int) -> bool:
        """Whether t may follow u (-1: nothing) in an encoding."""
        got = self.fits.get((u, t))
        if got is None:
            if len(self.fits) > self.most_states:
                self.fits.clear()
            whole = self.bytes_of[t] if u < 0 else self.bytes_of[u] + self.bytes_of[t]
            got = self.fits[u, t] = self.merged(whole) == ([t] if u < 0 else [u, t])
        return got

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, done = [], None
        for node, last, pending in self.states[state]:
            to = self.child.get(node * 256 + byte)
            if to is None:
                continue
            live.append((to, last, pending))
            t = self.ends.get(to)
            if t is not None and done is None and self.fit(last, t):
                done = (0, t, (*pending, t))
        if done is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        live.append(done)
        # what all hypotheses share is certain
        shared = 0
        shortest = min(len(p) for _, _, p in live)
        while shared < shortest and all(p[shared] == done[2][shared] for _, _, p in live):
            shared += 1
        out = done[2][:shared]
        to = tuple((n, last, p[shared:]) for n, last, p in live)
        k = self.number.get(to)
        if k is None:
            k = self.number[to] = len(self.states)
            self.states.append(to)
        got = self.step[state * 256 + byte] = (k, out)
        return got

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece of text."""
        if len(self.states) > self.most_states:
            self._forget()
        state, ids, step = 0, [], self.step
        for b in data:
            state, out = step.get(state * 256 + b) or self._make(state, b)
            if out:
                ids += out
        ids += self.states[state][-1][2]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        words = self.words
        for w in self.cut(text or ""):
            got = words.get(w)
            if got is None:
                got = self.piece(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= self.most_words:
                        words.clear()
                    words[w] = got
            ids += got
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, in parts as they become certain; broken sequences give U+FFFD."""
        need, code, least = 0, 0, 0
        for i in ids:
            part = []
            for b in self.bytes_of[i] if i in self.bytes_of else self.special[i]:
                if need and b >> 6 == 2:
                    code, need = code << 6 | b & 63, need - 1
                    if not need:
                        part.append(chr(code) if least <= code < 0xD800 or 0xE000 <= code < 0x110000 and code >= least else "�")
                    continue
                if need:
                    part.append("�")
                    need = 0
                if b < 0x80:
                    part.append(chr(b))
                elif 0xC2 <= b < 0xE0:
                    need, code, least = 1, b & 31, 0x80
                elif 0xE0 <= b < 0xF0:
                    need, code, least = 2, b & 15, 0x800
                elif 0xF0 <= b < 0xF5:
                    need, code, least = 3, b & 7, 0x10000
                else:
                    part.append("�")
            if part:
                yield "".join(part)
        if need:
            yield "�"


@lru_cache(2)
def transducer(path: str = VOCABULARY) -> Transducer:
    """One transducer in each Python worker, from the path or, where that is not on the machine, from the copy sent with the job."""
    return Transducer(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def sent(df: DataFrame, path: str) -> None:
    """Sends the vocabulary file along with the job."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)


def encoded(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(row id, ids) of every row."""
    sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode
        for b in batches:
            parts = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
            flat = np.fromiter((i for p in parts for i in p), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [b.schema.names[0], "ids"])

    rows = df.select(F.col(f"`{row_id}`").alias(row_id), F.col(f"`{text}`").alias("text" if row_id != "text" else "text_"))
    kind = df.schema[row_id].dataType.simpleString()
    return spread(rows, row_id).mapInArrow(run, f"`{row_id}` {kind}, ids array<int>")


def round_trip(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(row id, n_tokens, same): whether decoding the ids gives the text again."""
    sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            same = ["".join(t.decode(i)) == (x or "") for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(same)], [b.schema.names[0], "n_tokens", "same"])

    rows = df.select(F.col(f"`{row_id}`").alias(row_id), F.col(f"`{text}`").alias("text" if row_id != "text" else "text_"))
    kind = df.schema[row_id].dataType.simpleString()
    return spread(rows, row_id).mapInArrow(run, f"`{row_id}` {kind}, n_tokens int, same boolean")
