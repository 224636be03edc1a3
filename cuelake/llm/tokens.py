"""Token ids of a public byte-level vocabulary: speculate and verify.

A word (a match of the vocabulary's pattern) is cut greedily into the longest tokens. That proposal is the exact encoding
if and only if every pair of adjacent tokens is compatible, i.e. encodes to itself. All pairs of a batch are tested at once
against the sorted pairs seen so far; pairs never seen are settled by merging the two tokens' bytes. Only words with a
failing pair undergo exact merging.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cuelake.session import spread
from cuelake.sources.tables import table

#: Where the vocabulary files lie on every machine; a parameter of the operator.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker between batches, and the longest word (in characters) that is kept.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64
#: Pairs of tokens whose compatibility a task remembers; beyond it only those of the batch at hand are kept.
KEPT_PAIRS = 2_000_000


class Encoder:
    """Exact encoder for one rank file; one per worker process."""

    def __init__(self, rank_file: str) -> None:
        lines = Path(rank_file).read_bytes().splitlines()
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self.piece = {i: b for b, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs = np.empty(0, np.uint64)  # sorted: left << 32 | right
        self.fits = np.empty(0, bool)
        self.verified = self.merged = 0

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, lowest first and leftmost of equals, with a heap over a linked list: n log n for long words."""
        if word in self.rank:
            return [self.rank[word]]
        n = len(word)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.rank.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if not gone[i] else n
            if j >= n or end[j] != stop or gone[i]:
                continue
            gone[j] = 1
            end[i], nxt[i] = stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[word[i : end[i]]])
            i = nxt[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, rank, longest = [], 0, len(word), self.rank, self.longest
        while i < n:
            j = min(n, i + longest)
            while (r := rank.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def verify(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """Which pairs are compatible; new pairs are settled exactly and remembered."""
        key = (lefts.astype(np.uint64) << np.uint64(32)) | rights.astype(np.uint64)
        unseen = np.setdiff1d(key, self.pairs)
        if len(unseen):
            ok = np.fromiter((self.exact(self.piece[int(k) >> 32] + self.piece[int(k) & 0xFFFFFFFF]) == [int(k) >> 32, int(k) & 0xFFFFFFFF] for k in unseen), bool, len(unseen))
            if len(self.pairs) > KEPT_PAIRS:  # what this batch doesn't need is settled again when it comes back
                needed = np.isin(self.pairs, key)
                self.pairs, self.fits = self.pairs[needed], self.fits[needed]
            at = np.searchsorted(self.pairs, unseen)
            self.pairs, self.fits = np.insert(self.pairs, at, unseen), np.insert(self.fits, at, ok)
        return self.fits[np.searchsorted(self.pairs, key)]

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words: whole tokens at once, the rest proposed, verified together, and merged where they fail."""
        out: dict[str, tuple[int, ...]] = {}
        proposed: list[tuple[str, bytes, list[int]]] = []
        for w in words:
            b = w.encode("utf-8", "replace")
            if (r := self.rank.get(b)) is not None:
                out[w] = (r,)
            else:
                proposed.append((w, b, self.propose(b)))
        if proposed:
            size = np.fromiter((len(p) for _, _, p in proposed), np.int64, len(proposed))
            flat = np.fromiter((t for _, _, p in proposed for t in p), np.int64, int(size.sum()))
            owner = np.repeat(np.arange(len(proposed)), size)
            inside = owner[1:] == owner[:-1]
            fine = self.verify(flat[:-1][inside], flat[1:][inside])
            failing = set(owner[1:][inside][~fine].tolist())
            self.verified += len(proposed) - len(failing)
            self.merged += len(failing)
            for i, (w, b, p) in enumerate(proposed):
                out[w] = tuple(self.exact(b) if i in failing else p)
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Flat ids of all texts, and offsets."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        fresh = list({w for words in cut for w in words if w not in known})
        learnt = self.learn(fresh)
        known.update((w, i) for w, i in learnt.items() if len(w) <= KEPT_LENGTH)
        flat: list[int] = []
        offsets = [0]
        for words in cut:
            for w in words:
                flat += known.get(w) or learnt[w]
            offsets.append(len(flat))
        return flat, offsets


@lru_cache(2)
def encoder(rank_file: str) -> Encoder:
    return Encoder(rank_file)


def token_ids(documents: DataFrame, vocabulary: str = "byte_bpe_50k", directory: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): one row per input row; rows are moved only if there are too few input splits for all cores.

    Null and empty texts have an empty list; strings of special tokens are ordinary text. Long texts are encoded whole.
    """
    rank_file = f"{directory}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(rank_file)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                flat, offsets = e.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return token_ids(table(spark, directory, "documents"))
