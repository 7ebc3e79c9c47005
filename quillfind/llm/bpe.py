"""Encoding by a public byte-level BPE vocabulary (problem 8): speculate and verify.

Words are proposed by greedy longest match. A sequence of tokens is the BPE encoding of
its bytes exactly if every adjacent pair is, so the proposal is verified pair by pair:
the pair (a, b) stands if BPE, run on the bytes of both, ends with a and b. The checks of
a batch run together as array operations over the merge table; only words with a failing
pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words a worker remembers before it starts anew.
REMEMBERED = 1 << 18

_NONE = np.int64(1) << 62


#: Bytes of a word from which on its pairs are kept in a heap.
LONG = 48


class Vocabulary:
    """Ranks of tokens, and the merge table derived from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self._lengths()
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        pairs: dict[int, int] = {}
        # the parts of a token are what merging its bytes with the tokens of lower rank leaves
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    pairs[parts[0] * self.size + parts[1]] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # a token is reachable if its own bytes come out as itself
        self.stable = (self.left >= 0) | np.array([False] * self.size)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.stable[rank] = True

    def _lengths(self) -> None:
        found: dict[bytes, set[int]] = {}
        for token in self.ranks:
            found.setdefault(token[:2], set()).add(len(token))
        #: lengths of the tokens that start with these two bytes, the longest first
        self.lengths = {k: sorted(v, reverse=True) for k, v in found.items()}

    def parts(self) -> dict:
        """Plain arrays and the ranks, as they are sent to the workers."""
        return {"ranks": self.ranks, "left": self.left, "right": self.right, "keys": self.keys, "merged": self.merged, "stable": self.stable}

    @classmethod
    def of(cls, parts: dict) -> Vocabulary:
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        made.size = len(made.left)
        made._lengths()
        return made

    def merge(self, word: bytes, below: int = sys.maxsize) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        if len(word) >= LONG:
            return self._merge_long(word, below)
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merge_long(self, word: bytes, below: int) -> list[int]:
        """The same with a heap of pairs and a linked list of parts: n log n for n bytes.

        A part is named by its first byte. An entry of the heap is the rank of a pair, its
        first byte and its end; it holds as long as the part that starts there and the next
        one end there, however the bytes are split between them.
        """
        n, get = len(word), self.ranks.get
        end = list(range(1, n + 1))  # 0: merged into the part before
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None and rank < below]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                rank = get(word[i:after])
                if rank is not None and rank < below:
                    heapq.heappush(heap, (rank, i, after))
            first = before[i]
            if first >= 0:
                rank = get(word[first:stop])
                if rank is not None and rank < below:
                    heapq.heappush(heap, (rank, first, stop))
        found, i = [], 0
        while i < n:
            found.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return found

    def longest_match(self, word: bytes) -> list[int]:
        found, at, ranks, n = [], 0, self.ranks, len(word)
        while at < n:
            for size in self.lengths.get(word[at : at + 2], ()):
                if at + size <= n and (rank := ranks.get(word[at : at + size])) is not None:
                    found.append(rank)
                    at += size
                    break
            else:
                found.append(ranks[word[at : at + 1]])
                at += 1
        return found

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which a and b merge; a large number if they don't."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether BPE on the bytes of both ends with exactly a and b.

        Undo the merges of both sides from the last one made to the first. While the two
        inner parts stand side by side, they may not merge earlier than the merge that
        takes one of them away: on the left side that merge must not come later, on the
        right side the leftmost of equal rank goes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = self.stable[a] & self.stable[b]
        live = np.flatnonzero(good)
        x, y = a[live], b[live]
        until_x, until_y = np.full(len(x), _NONE), np.full(len(x), _NONE)  # merges that end the life of x and y
        while len(live):
            joined = self._joins(x, y)
            # they merge while both stand: before y's merge, and not after x's (x's stands left of the pair)
            bad = (joined < until_x) & (joined <= until_y)
            good[live[bad]] = False
            # step back over the later of the two last merges
            whole_x, whole_y = self.left[x] < 0, self.left[y] < 0
            back_x = ~whole_x & (whole_y | (x >= y))
            ended = bad | (whole_x & whole_y)
            until_x = np.where(back_x, x, until_x)
            until_y = np.where(back_x, until_y, y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            keep = ~ended
            live, x, y, until_x, until_y = live[keep], x[keep], y[keep], until_x[keep], until_y[keep]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Propose by longest match, verify all pairs at once, merge exactly where one fails."""
        proposals = [[self.ranks[w]] if w in self.ranks and self.stable[self.ranks[w]] else self.longest_match(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        failed = np.zeros(len(words), bool)
        if len(inner):
            pairs, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fine = self.compatible(pairs // self.size, pairs % self.size)
            failed[owner[inner[~fine[where]]]] = True
        failed[owner[~self.stable[flat]]] = True
        for i in np.flatnonzero(failed):
            proposals[i] = self.merge(words[i])
        return proposals


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encoder(vocabulary: Vocabulary, pattern: str = PATTERN):
    """texts -> lists of ids, remembering words between calls."""
    import regex

    split, known = regex.compile(pattern), {}

    def run(texts: list) -> list[list[int]]:
        words = [split.findall(t) if t else [] for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for ws in words for w in ws if w not in known})
        known.update(zip(fresh, vocabulary.encode_words([w.encode("utf-8", "replace") for w in fresh])))
        return [[t for w in ws for t in known[w]] for ws in words]

    return run


def encode(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. Each input row gives one row, repeated rows
    too. The vocabulary is sent to the workers once as a broadcast: its size is that of the
    file, whatever the corpus.
    """
    # the merge table is derived once here and sent, not once in each worker
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary)).parts())

    def run(batches):
        encoded = encoder(Vocabulary.of(shared.value))
        for batch in batches:
            # a few rows at a time: one text may be very long
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoded(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>")
