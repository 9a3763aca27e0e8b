"""Benchmark decontamination (2): SimHash windows, multi-index Hamming blocks, exact similarity.

Words are those of `\\w+` in lower case. Each benchmark item has a 128-bit SimHash of its words and
word pairs. A document is read in windows of the items' own sizes, placed wherever one of its
five-word shingles is also one of an item's (a window that shares no shingle with any item has
similarity 0, so none is lost). A window's SimHash is looked up in BLOCKS blocks of 16 bits: with
RADIUS = 39, one of eight blocks differs in 39 // 8 = 4 bits at most, so that all item
fingerprints within the radius are found. Candidates are verified exactly: the sum of least over
the sum of greatest shingle counts, at least `similarity`.

What lies beyond the radius is lost, and no radius rules that out. RADIUS is meant for
similarities of 0.8 and more, where the README has the measured share; lower ones lose more.

The items are the stated query set: they are taken in blocks of about BLOCK_WORDS words, each of
which is broadcast and meets all documents. An index is made of NumPy arrays, some 40 bytes a word.
Of several blocks one is held at a time: its matches are written before the next is read.

Cases: null and empty texts hold nothing. Items with fewer than five words have their whole
sequence as one shingle and are met where it occurs. Items without words are never met. Rows that
repeat are judged each. The best window counts for a document and item (ties: the first).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, BITS, BLOCKS, RADIUS = 5, 128, 8, 39
BLOCK_WORDS = 1 << 20
WORD = re.compile(r"\w+")
_ODD = np.random.default_rng(7).integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)
MATCHES = "item_id long, start_word long, n_words long, hamming long, similarity double"


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += h[i : n + i] * _ODD[i]
    return _mixed(total)


def simhash(h: np.ndarray) -> np.ndarray:
    """128 bits, as 16 bytes: the sign of the sum of the words' and word pairs' random signs."""
    f = np.concatenate([_mixed(h), shingles(h, 2)])
    both = np.stack([f, _mixed(f * _ODD[9])], axis=1)
    bits = np.unpackbits(both.view(np.uint8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(f))


def counted(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and how often each occurs."""
    return np.unique(shingles(h, size), return_counts=True)


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashes = [(item_id, h) for item_id, text in items if len(h := word_hashes(text))]
        self.ids = [item_id for item_id, _ in hashes]
        self.sizes = np.array([len(h) for _, h in hashes], np.int64)
        bags = [counted(h, min(SHINGLE, len(h))) for _, h in hashes]
        flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        #: The items' shingles and their counts, item i's at first[i] to first[i + 1].
        self.bag, self.counts = flat([b[0] for b in bags], np.uint64), flat([b[1] for b in bags], np.int64)
        self.first = np.cumsum([0, *(len(b[0]) for b in bags)])
        self.short = {int(n) for n in self.sizes if n < SHINGLE}
        #: Where a shingle places windows: sorted by shingle, (window size, offset) each.
        placed = [shingles(h, min(SHINGLE, len(h))) for _, h in hashes]
        shingle, offset = flat(placed, np.uint64), flat([np.arange(len(p)) for p in placed], np.int32)
        size = np.repeat(self.sizes, [len(p) for p in placed]).astype(np.int32)
        order = np.lexsort((offset, size, shingle))
        shingle, size, offset = shingle[order], size[order], offset[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (size[1:] != size[:-1]) | (offset[1:] != offset[:-1])
        self.known, self.at, self.n = np.unique(shingle[new], return_index=True, return_counts=True)
        self.size, self.offset = size[new], offset[new]
        self.prints = np.array([simhash(h) for _, h in hashes], np.uint8).reshape(-1, BITS // 8)
        #: Of each block: its distinct keys, and each item's place among them.
        self.blocks = [np.unique(column, return_inverse=True) for column in self.prints.view(np.uint16).T]

    def within(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(item, distance) of all items within RADIUS of a fingerprint."""
        found = np.zeros(len(self.prints), bool)
        for (keys, place), key in zip(self.blocks, code.view(np.uint16), strict=True):
            found |= (np.bitwise_count(keys ^ key) <= RADIUS // BLOCKS)[place]
        order = np.flatnonzero(found)
        apart = np.bitwise_count(self.prints[order] ^ code).sum(axis=1)
        return [(int(i), int(d)) for i, d in zip(order, apart, strict=True) if d <= RADIUS]

    def windows(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(start, size) of the windows that a shared shingle places, in order."""
        out: set[tuple[int, int]] = set()
        for size in {SHINGLE, *self.short}:
            own = shingles(h, size)
            if not len(own) or not len(self.known):
                continue
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            hits = np.flatnonzero(self.known[at] == own)
            if not len(hits):
                continue
            first, n = self.at[at[hits]], self.n[at[hits]]
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, place = self.size[entry].astype(np.int64), np.repeat(hits, n)
            fits = window >= SHINGLE if size == SHINGLE else window == size
            start = np.maximum(0, np.minimum(place - self.offset[entry], len(h) - window))[fits]
            out.update(zip(start.tolist(), window[fits].tolist(), strict=True))
        return sorted(out)

    def matches(self, text: str | None, similarity: float) -> list[tuple[int, int, int, int, float]]:
        h = word_hashes(text)
        best: dict[int, tuple] = {}
        for start, n in self.windows(h):
            part = h[start : start + n]
            bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, apart in self.within(simhash(part)):
                size = min(SHINGLE, int(self.sizes[i]))
                if size not in bags:
                    bags[size] = counted(part, size)
                (a, na), own = bags[size], slice(self.first[i], self.first[i + 1])
                _, x, y = np.intersect1d(a, self.bag[own], assume_unique=True, return_indices=True)
                both = int(np.minimum(na[x], self.counts[own][y]).sum())
                s = both / (int(na.sum() + self.counts[own].sum()) - both) if both else 0.0
                if s >= similarity and (i not in best or s > best[i][4]):
                    best[i] = (self.ids[i], start, len(part), apart, s)
        return list(best.values())


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        words = len(WORD.findall(row[1]))
        if block and size + words > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += words
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity) of each document and item met."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id").schema
    for field in MATCHES.split(", "):
        schema = schema.add(*field.split())
    names = schema.fieldNames()

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1)):
                    for m in index.matches(text.as_py(), similarity):
                        at.append(i)
                        found.append(m)
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

        return rows.mapInArrow(run, schema)

    parts, blocks = [], item_blocks(benchmark, item_col, item_text)
    block = next(blocks, None)
    while block is not None:
        shared, block = spark.sparkContext.broadcast(ItemIndex(block)), next(blocks, None)
        if block is None and not parts:
            return scan(shared)
        parts.append(written(scan(shared), "matches"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold an item; rows without an id are matched by their text."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h")).alias("key"), F.col(text_col).alias("text"))
    met = written(find_matches(rows, benchmark, id_col="key", **options).select(F.col("doc_id.id").alias("__id"), F.col("doc_id.h").alias("__h")).distinct(), "met")
    return docs.join(met, docs[id_col].eqNullSafe(met["__id"]) & (F.xxhash64(docs[text_col]) == met["__h"]), "left_anti")
