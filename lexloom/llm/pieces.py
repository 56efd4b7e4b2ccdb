"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton of the pieces.

At each position the automaton's output links list every piece that ends there, longest first,
and each relaxes the best segmentation up to that position. For a unigram model the best is
the largest sum of scores. A BPE model has no such sum: its encoder merges by rank, so there a
piece is admitted only if merging leaves it and the last piece before it apart, which holds
for exactly one piece at each position, and the pass gives the encoder's own result. Whether two
pieces stay apart is read from each piece's last merge, without merging their text again. Text is
cut where no piece can span (before a run of word marks), and results of short stretches are
kept in a bounded table.

Null texts encode to an empty list and decode from it to the empty string; characters outside
the vocabulary become byte pieces (or the unknown id in a model without those). Any text
without the word mark U+2581 decodes to itself.
"""

from __future__ import annotations

import array
import functools
import re
import struct
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import per_text

MARK = "▁"
KEEP = 300_000  # stretches whose packed ids a worker remembers


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, raw[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield number, struct.unpack("<d" if n == 8 else "<f", raw[at : at + n])[0]
            at += n


class Pieces:
    """A SentencePiece model: unigram or BPE, without a normalisation table."""

    NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer, norm = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                self.score.append(piece.get(2, 0.0))
                self.kind.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if norm.get(2) or self.kind.count(self.OWN) or trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation table and own symbols")
        self.dummy, self.squeeze, self.escape = (norm.get(n, 1) for n in (3, 4, 5))
        self.unknown = self.kind.index(self.UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == self.BYTE}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == self.NORMAL}
        self.split = all(MARK not in t.lstrip(MARK) for t in self.ids)
        self.lowest = min(self.score) - 10
        self.size = [len(t) for t in self.text]
        self.said = [t.encode() for t in self.text]  # what each id decodes to
        for i, k in enumerate(self.kind):
            if k in (self.BYTE, self.UNKNOWN, self.CONTROL):
                self.said[i] = bytes([int(self.text[i][3:5], 16)]) if k == self.BYTE else " ⁇ ".encode() if k == self.UNKNOWN else b""
        self.auto = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if not self.bpe or self.merged(t) == [t]:  # a piece that merging never leaves whole isn't one
                self.auto.add_word(t, i)
        self.auto.make_automaton()
        if self.bpe:
            self._number()
        self.apart = functools.lru_cache(1 << 18)(self._apart)
        self.packed = functools.lru_cache(KEEP)(self._packed)

    def _number(self) -> None:
        """Each piece's turn in the order of merging (equal scores: equal turns, the leftmost first), and its last merge."""
        turns = {score: n for n, score in enumerate(sorted({self.score[i] for i in self.ids.values()}, reverse=True))}
        self.turn = {i: turns[self.score[i]] for i in self.ids.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in self.ids.items():
            if len(t) > 1 and t in self.auto:
                a, b = self.merged(t, whole=False)
                self.halves[i] = self.ids[a], self.ids[b]

    def merged(self, text: str, whole: bool = True) -> list[str]:
        """The BPE merging of a short text: best score first, leftmost among equals; not whole: until two parts are left."""
        parts = list(text)
        while len(parts) > (1 if whole else 2):
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbouring pieces as they are.

        Merges are undone on the side where the later one was: at each time the parts that touch
        must not make a piece which would have been merged before.
        """
        ids, text, turn, halves = self.ids, self.text, self.turn, self.halves
        limit = len(turn)  # merges of a lower number came first
        while True:
            both = ids.get(text[left] + text[right])
            if both is not None and turn[both] < limit:
                return False
            a, b = turn[left] if left in halves else -1, turn[right] if right in halves else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]

    def _packed(self, text: str) -> bytes:
        """The ids of a stretch, as little-endian 32-bit numbers."""
        return array.array("i", self._stretch(text)).tobytes()

    def _stretch(self, text: str) -> list[int]:
        n = len(text)
        back = [-1] * (n + 1)  # the last piece before each position; -1: none, or an unknown character
        size, apart, found = self.size, self.apart, self.auto.iter(text) if len(self.auto) else ()
        if self.bpe:
            done = 0
            for end, piece in found:  # longest first at each end
                end += 1
                if end != done:
                    before = back[end - size[piece]]
                    if before < 0 or apart(before, piece):
                        back[end] = piece
                        done = end
        else:
            best = [0.0] + [float("-inf")] * n
            ends: list[list[int]] = [[] for _ in range(n + 1)]
            for end, piece in found:
                ends[end + 1].append(piece)
            for i in range(1, n + 1):
                if not any(size[piece] == 1 for piece in ends[i]):
                    best[i] = best[i - 1] + self.lowest
                for piece in ends[i]:
                    if (score := best[i - size[piece]] + self.score[piece]) > best[i]:
                        best[i], back[i] = score, piece
        out: list[int] = []
        while n:
            piece = back[n]
            if piece >= 0:
                out.append(piece)
                n -= size[piece]
                continue
            if self.bytes:
                out += [self.bytes[b] for b in reversed(text[n - 1].encode())]
            else:
                if not (out and out[-1] == self.unknown):  # a run of unknown characters is one piece
                    out.append(self.unknown)
            n -= 1
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        return array.array("i", self.encode_packed(text)).tolist()

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a whole text, packed as by _packed."""
        s = text or ""
        if self.squeeze:
            s = re.sub(" +", " ", s).strip(" ")
        if not s:
            return b""
        if self.escape:
            s = s.replace(" ", MARK)
        if self.dummy:
            s = MARK + s
        if not self.split:
            return self._packed(s)
        known, fresh = self.packed, self._packed
        return b"".join([known(part) if len(part) <= 64 else fresh(part) for part in _PARTS.findall(s)])

    def decode(self, ids: list[int] | None) -> str:
        s = b"".join(map(self.said.__getitem__, ids or ())).decode("utf-8", "replace")
        if self.dummy and s.startswith(MARK):
            s = s[1:]
        return s.replace(MARK, " ") if self.escape else s


_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode_texts(docs: DataFrame, model: bytes, key: str = "doc_id") -> DataFrame:
    """(key, ids): each whole text's piece ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one model file, a few MB at most

    def make():
        p = Pieces(sent.value)
        return lambda texts: [[p.encode(t) for t in texts]]

    return per_text(docs, key, "ids array<int>", make)


def decode_ids(encoded: DataFrame, model: bytes, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of each id list."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        p = Pieces(sent.value)
        for b in batches:
            texts = pa.array([p.decode(x) for x in b.column("ids").to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column("k"), texts], names=["k", "text"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def encode_summary(docs: DataFrame, model: bytes, key: str = "doc_id") -> DataFrame:
    """(key, ids, n_ids, ids_crc32, round_trip): each text's ids and their digest; whether decoding them returns the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        p = Pieces(sent.value)

        def work(texts):
            packed = [p.encode_packed(t) for t in texts]
            ids = [np.frombuffer(x, "<i4") for x in packed]
            back = [p.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            return [ids, list(map(len, ids)), list(map(zlib.crc32, packed)), back]

        return work

    return per_text(docs, key, "ids array<int>, n_ids long, ids_crc32 long, round_trip boolean", make)
