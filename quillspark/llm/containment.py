"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so their Jaccard similarity says nothing; what
counts is the share of the item's shingles that the document holds.  Items are partitioned by the
size of their shingle set (powers of two).  In a partition with upper size u and threshold t, an
item's sketch is its k = floor((1 - t) * u) + 1 least shingles under one hash: an item may miss at
most floor((1 - t) * size) of its shingles, so every document that contains it holds one of its
sketch at least, and the search loses nothing.  Documents look all their shingles up in the sketches
(a bitmap first, then a sorted table); each candidate is confirmed by the exact count of the item's
shingles in the whole document.

The query side is the benchmark, cut into blocks of at most BLOCK_ITEMS items and BLOCK_SHINGLES
shingles by a running size; a block's tables are what is sent to the tasks, so what is sent has a
fixed bound, and a larger benchmark takes more passes.  The documents are never shuffled.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  An item with fewer words than a shingle has its
whole word sequence as one shingle, and a document contains it if that sequence occurs in it.  Items
and documents that are null or without words match nothing.  Equal items (repeated rows) each match;
rows with a null id are left out.  Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes as tc
from .steps import stored

BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 1_000_000


class Index:
    """Sketches and full shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], percent: int):
        """items: (item_id, distinct codes, words in a shingle)."""
        self.ids = np.array([i for i, _, _ in items], dtype=np.int64)
        self.sizes = np.array([len(c) for _, c, _ in items], dtype=np.int64)
        self.percent = percent
        self.grams = sorted({g for _, _, g in items})
        item = np.repeat(np.arange(len(items)), self.sizes)
        codes = np.concatenate([c for _, c, _ in items]) if items else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.item = codes[order], item[order]
        upper = 1 << np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        self.sketch_size = (100 - percent) * upper // 100 + 1
        least = np.lexsort((tc.mix(codes), item))
        rank = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        chosen = np.zeros(len(codes), dtype=bool)
        chosen[least] = rank < np.repeat(self.sketch_size, self.sizes)
        sketch = np.sort(codes[chosen])
        self.sketch = np.unique(sketch)
        self.bits = 16
        while (1 << self.bits) < 16 * len(self.sketch):
            self.bits += 1
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        self.bitmap[(self.sketch >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def has_sketch(self, codes: np.ndarray) -> np.ndarray:
        out = self.bitmap[(codes >> np.uint64(64 - self.bits)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.sketch, codes[at]), max(len(self.sketch) - 1, 0))
        out[at] = self.sketch[place] == codes[at] if len(self.sketch) else False
        return out

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shingles, shared) of the items that a document with these codes contains."""
        codes = np.unique(codes)
        lo, hi = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, "right")
        runs = hi - lo
        places = np.repeat(lo - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        items, shared = np.unique(self.item[places], return_counts=True)
        hit = 100 * shared >= self.percent * self.sizes[items]
        return list(zip(self.ids[items[hit]].tolist(), self.sizes[items[hit]].tolist(), shared[hit].tolist(), strict=True))


def item_sets(ids: list[int], texts: list[str | None], shingle: int) -> list[tuple[int, np.ndarray, int]]:
    out = []
    words = tc.Words(*tc.column_bytes(pa.array(texts, pa.string())))
    for i, item in enumerate(ids):
        n = int(words.counts[i])
        if n:
            size = min(n, shingle)
            codes = words.codes[words.bounds[i] : words.bounds[i + 1]]
            grams = [tc.sequence_code(codes[j : j + size]) for j in range(n - size + 1)]
            out.append((item, np.unique(np.array(grams, dtype=np.uint64)), size))
    return out


def _search(index: Index, shingle: int):
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                words = tc.Words(*tc.column_bytes(part.column("text")))
                ids = part.column("doc_id").to_numpy()
                grams = []
                for size in index.grams:
                    codes, bounds = tc.gram_codes(words, size)
                    if size == 1 or not len(codes):
                        grams.append((codes, bounds))
                        continue
                    full = words.counts >= size  # a shorter text's own sequence is no run of this many words
                    keep = np.repeat(full, np.diff(bounds))
                    grams.append((codes[keep], np.searchsorted(np.repeat(np.arange(len(full)), np.diff(bounds))[keep], np.arange(len(full) + 1))))
                rows = set()
                for codes, bounds in grams:
                    hit = np.flatnonzero(index.has_sketch(codes))
                    rows.update(np.unique(np.searchsorted(bounds, hit, "right") - 1).tolist())
                found = [(int(ids[r]), *m) for r in sorted(rows) for m in index.matches(np.concatenate([c[b[r] : b[r + 1]] for c, b in grams]))]
                cols = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def contained_items(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item of which it holds `percent` of the shingles at least:
    doc_id, item_id, n_shingles (the item's), n_shared, containment."""
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    out = None
    for block in _blocks(items, shingle):
        found = docs.mapInArrow(_search(Index(block, percent), shingle), "doc_id long, item_id long, n_shingles long, n_shared long")
        # what the blocks before have found is written, so that the driver holds no index but the last two
        out = found if out is None else stored(out, "found").union(found)
    if out is None:
        out = docs.limit(0).selectExpr("doc_id", "0L item_id", "0L n_shingles", "0L n_shared")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _blocks(items: DataFrame, shingle: int):
    """The benchmark's shingle sets, in blocks of bounded size: one block at a time is on the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        for made in item_sets([row["item_id"]], [row["text"]], shingle):
            if block and (len(block) >= BLOCK_ITEMS or size + len(made[1]) > BLOCK_SHINGLES):
                yield block
                block, size = [], 0
            block.append(made)
            size += len(made[1])
    if block:
        yield block


def clean_documents(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no test item, with their columns; rows with a null doc_id stay."""
    found = contained_items(documents, benchmark, shingle, percent).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti")
