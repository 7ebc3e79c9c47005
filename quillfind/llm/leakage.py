"""Held-out passages leaking into a corpus (problem 9): MinHash containment of short items in long texts.

A leak is a run of `run` consecutive words. Both sides are seen as word shingles of
`shingle` words; a run holds `run - shingle + 1` shingles that follow each other. For
every such window the smallest hash of its shingles is its MinHash. A window shared by
two texts is wholly contained in both, so both have its MinHash: looking up the distinct
MinHashes of the windows finds every leak, and as one MinHash stands for about half a
window of positions it is a small index.

Items are partitioned by size, each class holding items of at most twice the words of the
smallest. A class has an index of its own and the containment asked of its items: one
window of those of its largest item. The window is the same in all classes, as a run is
counted in words whatever the size of the item, so that one shared MinHash always is
enough: more would lose leaks of just a run. Items that have fewer words than a run can't
leak and are in no class.

Candidates are verified by exact containment of the shingles of a run, word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfind.functions.session import small

SHINGLE, RUN = 5, 12
#: Parts of a MinHash that many texts have, where items are joined.
SALT = 8
#: Items up to this number and of so many characters in all are sent to the tasks; beyond either MinHashes are joined.
BROADCAST_ITEMS, BROADCAST_CHARS = 20_000, 1 << 25

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_TARGET = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_WORD = re.compile(r"[^\W_]+")
_DROPPED = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *b"*`~"])


def words(text: str | None) -> list[str]:
    """Words in lower case; tags, link targets, marks, punctuation and blanks are gone."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _TARGET.sub("] ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.translate(_DROPPED).replace("'", "").replace("’", "")
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of word sequences; words seen before are remembered, up to a bound."""

    def __init__(self, shingle: int = SHINGLE, run: int = RUN):
        import xxhash

        self.shingle, self.run, self.known, self.of = shingle, run, {}, xxhash.xxh64_intdigest

    def _words(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1 << 19:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = self.of(w)
        return np.fromiter((known[w] for w in ws), np.uint64, len(ws))

    def sequences(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The hash of each n words that follow each other."""
        if len(hashes) < n:
            return np.empty(0, np.uint64)
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(total)])
        return total

    def signatures(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, MinHash) of every window within one text, and the word hashes with their starts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.r_[0, np.cumsum(sizes)]
        hashes = self._words([w for ws in texts for w in ws])
        s = self.sequences(hashes, self.shingle)
        span = self.run - self.shingle + 1
        n = len(s) - span + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), hashes, start
        least = s[:n].copy()
        for i in range(1, span):
            np.minimum(least, s[i : i + n], out=least)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = owner[:n] == owner[self.run - 1 : self.run - 1 + n]
        return owner[:n][inside], least[inside], hashes, start


def size_class(n: np.ndarray, run: int) -> np.ndarray:
    """The class of items by their number of words: class k holds run * 2**k up to twice as many; -1 is none."""
    return np.where(n >= run, np.floor(np.log2(np.maximum(n, 1) / run) + 1e-9), -1).astype(np.int64)


def indexed(items: list[tuple[int, str]], shingle: int = SHINGLE, run: int = RUN) -> dict:
    """The index of the items as plain arrays: MinHashes and runs of words of each class, and the words."""
    hasher = Hasher(shingle, run)
    texts = [words(t) for _, t in items]
    owner, least, hashes, start = hasher.signatures(texts)
    of = size_class(np.diff(start), run)
    classes = []
    for k in np.unique(of[of >= 0]).tolist():
        inside = of[owner] == k
        pairs = np.unique(np.stack([least[inside], owner[inside].astype(np.uint64)], 1), axis=0)
        own = pairs[:, 1].astype(np.int64)
        largest = int(np.diff(start)[of == k].max())
        classes.append({"class": int(k), "asked": 1 / (largest - run + 1), "least": pairs[:, 0], "item": own, "windows": np.diff(start) - run + 1})
    runs = hasher.sequences(hashes, run)
    inside = np.flatnonzero(np.repeat(np.arange(len(texts)), np.diff(start))[: len(runs)] == np.repeat(np.arange(len(texts)), np.diff(start))[run - 1 :]) if len(runs) else np.empty(0, np.int64)
    order = np.argsort(runs[inside], kind="stable")
    at = inside[order]
    return {
        "shingle": shingle, "run": run, "ids": [i for i, _ in items], "words": [w for ws in texts for w in ws], "classes": classes,
        "runs": runs[at], "at": at, "owner": np.searchsorted(start, at, "right") - 1,
    }


class Index:
    """The size classes of the items, looked up by texts."""

    def __init__(self, parts: dict):
        self.parts, self.hasher = parts, Hasher(parts["shingle"], parts["run"])

    def candidates(self, least: np.ndarray) -> set[int]:
        """Numbers of the items of which a text holds, by the shared MinHashes, the containment their class asks for."""
        found: set[int] = set()
        least = np.unique(least)
        for c in self.parts["classes"]:
            first, end = np.searchsorted(c["least"], least), np.searchsorted(c["least"], least, "right")
            size = end - first
            if size.any():
                where = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                shared = np.bincount(c["item"][where], minlength=len(c["windows"]))
                # a MinHash stands for one window at least
                found.update(np.flatnonzero(shared >= np.maximum(1, np.floor(c["asked"] * c["windows"] + 1e-9))).tolist())
        return found

    def leaks(self, ws: list[str], hashes: np.ndarray, among: set[int]) -> set[int]:
        """The numbers of those items of which a whole run is contained, by hash and then word by word."""
        p, run, found = self.parts, self.parts["run"], set()
        of = self.hasher.sequences(hashes, run)
        first, end = np.searchsorted(p["runs"], of), np.searchsorted(p["runs"], of, "right")
        for at in np.flatnonzero(end > first).tolist():
            for k in range(first[at], end[at]):
                item, begin = int(p["owner"][k]), int(p["at"][k])
                if item in among and item not in found and p["words"][begin : begin + run] == ws[at : at + run]:
                    found.add(item)
        return found


def _out(docs, items):
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])


def _scan(shared, rows: int = 512):
    def run(batches):
        index = Index(shared.value)
        every = np.unique(np.concatenate([c["least"] for c in shared.value["classes"]] or [np.empty(0, np.uint64)]))
        ids = shared.value["ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys, texts = part.column(0).to_pylist(), [words(t) for t in part.column(1).to_pylist()]
                owner, least, hashes, start = index.hasher.signatures(texts)
                hit = _in(least, every)
                owner, least = owner[hit], least[hit]
                docs, items = [], []
                for i in np.unique(owner).tolist():
                    among = index.candidates(least[owner == i])
                    for item in sorted(index.leaks(texts[i], hashes[start[i] : start[i + 1]], among)) if among else ():
                        docs.append(keys[i])
                        items.append(ids[item])
                if docs:
                    yield _out(docs, items)

    return run


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _minhashes(shingle: int, run: int, rows: int = 512):
    def of(batches):
        hasher = Hasher(shingle, run)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                owner, least, _, _ = hasher.signatures([words(t) for t in part.column(1).to_pylist()])
                if len(owner):
                    pairs = np.unique(np.stack([owner.astype(np.uint64), least], 1), axis=0)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[pairs[:, 0].astype(np.int64)], pa.int64()), pa.array(pairs[:, 1].view(np.int64))], names=["key", "least"])

    return of


def _verify(shingle: int, run: int):
    def of(batches):
        for batch in batches:
            known = dict(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()))
            index = Index(indexed(list(known.items()), shingle, run))
            number = {k: i for i, k in enumerate(known)}
            docs, items = [], []
            for doc, item, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ws = words(text)
                if index.leaks(ws, index.hasher._words(ws), {number[item]}):
                    docs.append(doc)
                    items.append(item)
            if docs:
                yield _out(docs, items)

    return of


def leaked(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    run: int = RUN,
    broadcast_items: int = BROADCAST_ITEMS,
) -> DataFrame:
    """(doc_id, item_id): documents that contain at least `run` consecutive words of an item.

    Null and empty texts and items with fewer words than a run give no rows. Repeated
    documents count each; a row whose id and text come again is given once. Up to
    `broadcast_items` items travel to the documents, which then aren't shuffled; more items
    are joined to the documents by MinHash, with the same result.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    held = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item")).where(F.length("item") > 0)
    schema = "doc_id long, item_id long"
    chars = held.agg(F.sum(F.length("item"))).first()[0] or 0
    if chars <= BROADCAST_CHARS and (rows := small(held, broadcast_items)) is not None:
        shared = docs.sparkSession.sparkContext.broadcast(indexed([(r[0], r[1]) for r in rows], shingle, run))
        return docs.mapInArrow(_scan(shared), schema).distinct()
    minhash = _minhashes(shingle, run)
    # a MinHash that many texts have is looked up in parts
    of_docs = docs.mapInArrow(minhash, "key long, least long").select(F.col("key").alias("doc_id"), "least", F.pmod(F.xxhash64("key"), F.lit(SALT)).alias("salt"))
    of_items = held.mapInArrow(minhash, "key long, least long").select(F.col("key").alias("item_id"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    candidates = of_docs.join(of_items, ["least", "salt"]).select("doc_id", "item_id").distinct()
    texts = candidates.join(docs, "doc_id").join(held, "item_id").select("doc_id", "item_id", "text", "item")
    return texts.mapInArrow(_verify(shingle, run), schema).distinct()
