"""LM scoring: cross-entropy difference of matched target and background n-gram models.

Both are bigram models with a Dirichlet prior from add-one unigrams, over one shared vocabulary:
all words of the corpus and an unknown one. The background counts every document, the target those marked. A
document's score is the mean over its tokens of the target's loss less the background's: low
scores are like the target. A target document is scored by a target model without its own
counts (one of its rows, where they repeat). Counts are exact and distributed: documents are dealt to chunks,
each chunk sends its distinct n-grams (64-bit hashes, sorted and packed, with counts) to the
buckets of their hash, a bucket adds up the counts of all chunks and answers each chunk in the
order of its question, and the chunk scores its documents from the answers. What moves grows
with the corpus; the driver holds three totals.

Null texts count as empty; texts without a word have no tokens and a null score. Without any
target token the target model is uniform. Rows with a null key are dealt by text. Repeated rows
count as often as they occur and score alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import CHUNK_BYTES, pieces, stage, text_bytes

_TOKEN = re.compile(r"\w+")
PRIOR = 50.0  # tokens that the unigram prior weighs in each context
_START = 0x5851F42D4C957F2D
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _ODD) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The tokens of some texts as word numbers, and their distinct words and pairs as hashes."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        flat: list[int] = []
        sizes = []
        for t in texts:
            words = tokens(t)
            sizes.append(len(words))
            flat += [number.setdefault(w, len(number)) for w in words]
        self.sizes = np.array(sizes, np.int64)
        word = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
        self.word = np.array(flat, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        start = np.r_[True, self.doc[1:] != self.doc[:-1]][: len(self.word)]
        before = np.r_[np.int64(0), self.word[:-1]][: len(self.word)] if len(self.word) else self.word
        self.before = np.where(start, len(word), before)  # the last number stands for the start
        self.words = np.r_[word, np.uint64(_START)]
        self.pairs, self.pair = np.unique(_pair(self.words[self.before], self.words[self.word]), return_inverse=True)

    def questions(self, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes, background counts, target counts) of the words, the pairs and the contexts."""
        t = target[self.doc].astype(np.float64)

        def of(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            return np.bincount(index, minlength=n), np.bincount(index, weights=t, minlength=n).astype(np.int64)

        n = len(self.words)
        return [(self.words, *of(self.word, n)), (self.pairs, *of(self.pair, len(self.pairs))), (self.words, *of(self.before, n))]

    def hashes(self) -> list[np.ndarray]:
        return [self.words, self.pairs, self.words]

    def own(self) -> list[np.ndarray]:
        """How often each token's word, pair and context occur in its own document."""
        out = []
        for index in (self.word, self.pair, self.before):
            _, inverse, times = np.unique(self.doc * (max(len(self.pairs), len(self.words)) + 1) + index, return_inverse=True, return_counts=True)
            out.append(times[inverse])
        return out


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def expand(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, equal ranges of the hashes, start and end in sorted hashes."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(ordered, edges), len(ordered)]


def score_documents(docs: DataFrame, targets: DataFrame, key: str = "doc_id", prior: float = PRIOR) -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score); targets(key) marks the target documents.

    The losses are in nats a token.
    """
    kind = docs.schema[key].dataType.simpleString()
    _, size = text_bytes(docs)
    chunks, buckets = pieces(size, CHUNK_BYTES), pieces(size, 2 * CHUNK_BYTES)
    by = lambda *c: F.pmod(F.xxhash64(*c), F.lit(chunks)).cast("int")
    name = F.col(key).cast("string")
    dealt = docs.select(F.when(name.isNull(), by("text")).otherwise(by(name)).alias("chunk"), name.alias("k"), "text")
    marked = targets.where(F.col(key).isNotNull()).select(by(name).alias("chunk"), name.alias("k")).distinct()
    columns = ["chunk", "kind", "bucket", "h", "b", "t"]

    def ask(texts: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(texts):
            number = int(texts["chunk"].iloc[0])
            texts = texts.sort_values(["k", "text"], kind="stable")
            for i, (h, b, t) in enumerate(Chunk(texts["text"].tolist()).questions(texts["k"].isin(set(chosen["k"])).to_numpy())):
                order = np.argsort(h, kind="stable")
                cuts = _cuts(h[order], buckets)
                for k in range(buckets):
                    at = order[cuts[k] : cuts[k + 1]]
                    if len(at):
                        rows.append((number, i, k, squeeze(np.diff(h[at], prepend=np.uint64(0))), squeeze(b[at]), squeeze(t[at])))
        return pd.DataFrame(rows, columns=columns)

    asked = dealt.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInPandas(lambda a, b: ask(a, b), "chunk int, kind int, bucket int, h binary, b binary, t binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(expand(x), dtype=np.uint64) for x in pdf["h"]]
        distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = [np.bincount(index, weights=np.concatenate([expand(x) for x in pdf[c]]), minlength=len(distinct)) for c in ("b", "t")]
        rows, at = [], 0
        for number, h in zip(pdf["chunk"], hashes):
            mine = index[at : at + len(h)]
            at += len(h)
            rows.append((number, *(squeeze(s[mine]) for s in sums), 0, 0, 0))
        rows[0] = (*rows[0][:3], *(int(s.sum()) for s in sums), int((sums[0] > 0).sum()))
        out = pd.DataFrame(rows, columns=["chunk", "b", "t", "n_b", "n_t", "v"])
        return out.assign(kind=int(pdf["kind"].iloc[0]), bucket=int(pdf["bucket"].iloc[0]))

    ddl = "chunk int, b binary, t binary, n_b long, n_t long, v long, kind int, bucket int"
    answers = stage(asked.groupBy("kind", "bucket").applyInPandas(lambda pdf: answer(pdf), ddl), "answers")
    n_b, n_t, v = (int(x or 0) for x in answers.where("kind = 0").agg(F.sum("n_b"), F.sum("n_t"), F.sum("v")).first())

    def score(texts: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        chosen, found = set(rest["k"].dropna()), rest[rest["k"].isna()]
        out = pd.DataFrame({"k": np.zeros(0, object), "n_tokens": np.zeros(0, np.int64), "target_loss": np.zeros(0), "background_loss": np.zeros(0)}).astype({"k": object})
        if not len(texts):
            return out
        texts = texts.sort_values(["k", "text"], kind="stable")
        c = Chunk(texts["text"].tolist())
        found = found.sort_values(["kind", "bucket"])
        counts = {}
        for i, h in enumerate(c.hashes()):
            mine, order = found[found["kind"] == i], np.argsort(h, kind="stable")
            for column in ("b", "t"):
                counts[i, column] = np.zeros(len(h))
                counts[i, column][order] = np.concatenate([expand(x) for x in mine[column]])[: len(h)] if len(h) else 0
        out = pd.DataFrame({"k": texts["k"].to_numpy(), "n_tokens": c.sizes})
        marked = texts["k"].isin(chosen).to_numpy()[c.doc]
        less = [x * marked for x in c.own()] if marked.any() else [0, 0, 0]
        for name, column, total in (("target_loss", "t", n_t), ("background_loss", "b", n_b)):
            word, pair, before = (counts[i, column][x] for i, x in enumerate((c.word, c.pair, c.before)))
            if column == "t":
                word, pair, before, total = word - less[0], pair - less[1], before - less[2], total - c.sizes[c.doc] * marked
            uni = (word + 1) / (total + v + 1)
            p = (pair + prior * uni) / (before + prior)
            out[name] = np.bincount(c.doc, weights=-np.log(p), minlength=len(texts)) / np.maximum(c.sizes, 1)
        return out

    ddl = "k string, n_tokens long, target_loss double, background_loss double"
    every = answers.select("*", F.lit(None).cast("string").alias("k")).unionByName(marked, allowMissingColumns=True)
    scored = dealt.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInPandas(lambda a, b: score(a, b), ddl)
    losses = [F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select(F.col("k").cast(kind).alias(key), "n_tokens", *losses).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def quality_targets(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the documents that labels mark as of quality."""
    return labels.where("quality = 1").select(key)
