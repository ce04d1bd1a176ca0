"""Problem 8: passages of held-out items inside the corpus.

Windows of a document have a SimHash of their words, and so have the items'. Fingerprints are indexed
in blocks: two 64-bit fingerprints within a radius agree in at least one of radius + 1 blocks, so looking up
each block finds all of them. Candidates are verified exactly: a passage if its words are the
same, one by one, in the same order, a near passage if their weighted shingles of five words are similar enough.

There are two sizes of windows. Windows of ``WINDOW`` words, the shortest passage that counts, find every
document that holds a part of an item: equal windows have equal fingerprints, so no passage is missed;
a window as long as the item would lie beyond any radius there. Windows as long as the items find copies of
whole items in which some words differ; the radius is as wide as such copies lie apart (a recall of 0.9 at least, see the tests).

The items are a fixed table: its size is checked before it is sent to the tasks, and a larger one
is looked up in parts, for which the documents' words are written once. Documents take one narrow pass; nothing is shuffled but the cases.

Defined results: null, empty and blank texts and texts shorter than a window are never cases; very
long texts are read whole; repeated documents each come out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import has_text, word_hashes
from paigham.storage import cut, spread

WINDOW = 10
RADIUS = 3
#: The same for windows as long as the items, of which there are few of each length.
ITEM_RADIUS = 15
SHINGLE = 5
SIMILAR = 0.8
#: Words of items that go to the tasks at once (8 bytes each, and as much for each of five indexes).
MOST_WORDS = 2_000_000
CHUNK = 60_000
#: Candidates compared at once.
AT_ONCE = 5_000
PRIME = np.uint64(0x100000001B3)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words in their order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * PRIME + words[k : k + n]
    return out


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Of each bit how many of the words before each place have it."""
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=sums[1:])
    return sums


def simhashes(words: np.ndarray, size: int = WINDOW, sums: np.ndarray | None = None) -> np.ndarray:
    """The SimHash of each run of ``size`` words: of each bit the majority."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    sums = bit_sums(words) if sums is None else sums
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1).reshape(-1).view(np.uint64)


def _block(prints: np.ndarray, k: int, blocks: int) -> np.ndarray:
    width = 64 // blocks
    return ((prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


class Items:
    """Windows of the held-out items, indexed by the blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], window: int = WINDOW, radius: int = RADIUS):
        self.window, self.blocks, self.radius = window, radius + 1, radius
        kept = [(i, w.astype(np.uint64)) for i, w in zip(ids, texts, strict=True) if len(w) >= window]
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.item = cat([np.full(len(w) - window + 1, i, np.int64) for i, w in kept], np.int64)
        self.at = cat([np.arange(len(w) - window + 1) for _, w in kept], np.int64)
        self.prints = cat([simhashes(w, window) for _, w in kept], np.uint64)
        #: The words of all items, and where in them each window starts.
        self.words = cat([w for _, w in kept], np.uint64)
        starts = np.cumsum([0, *(len(w) for _, w in kept)])
        self.start = cat([a + np.arange(len(w) - window + 1) for a, (_, w) in zip(starts, kept, strict=False)], np.int64)
        self.length = {i: len(w) for i, w in kept}
        per = window - SHINGLE + 1
        self.shingles = cat([np.lib.stride_tricks.sliding_window_view(window_hashes(w, SHINGLE), per) for _, w in kept], np.uint64).reshape(-1, per)
        known, counts = np.unique(cat([np.unique(window_hashes(w, SHINGLE)) for _, w in kept], np.uint64), return_counts=True)
        self.known, self.weight = known, 1.0 / counts
        self.orders, self.starts = [], []
        for k in range(self.blocks):
            values = _block(self.prints, k, self.blocks)
            order = np.argsort(values, kind="stable")
            self.orders.append(order)
            self.starts.append(np.searchsorted(values[order], np.arange((1 << (64 // self.blocks)) + 1)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item window) whose fingerprints differ in at most ``radius`` bits."""
        found = []
        for k in range(self.blocks):
            values = _block(prints, k, self.blocks)
            low, high = self.starts[k][values], self.starts[k][values + 1]
            n = high - low
            left = np.repeat(np.arange(len(prints)), n)
            if not len(left):
                continue
            right = self.orders[k][np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[close] * len(self.prints) + right[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, shingles), max(0, len(self.known) - 1))
        return np.where(self.known[at] == shingles, self.weight[at], 1.0)

    def similarity(self, doc: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of rows of shingles."""
        mine, theirs = self.weights(doc), self.weights(items)
        common = ((doc[:, :, None] == items[:, None, :]).any(2) * mine).sum(1)
        return common / np.maximum(mine.sum(1) + theirs.sum(1) - common, 1e-12)


def _match(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = items.window
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint64)
            offsets = offsets - offsets[0]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(len(ids)), np.diff(offsets))
            out = []
            for start in range(0, max(0, len(flat) - size + 1), CHUNK):
                words = flat[start : start + CHUNK + size - 1]
                of = record[start : start + CHUNK + size - 1]
                whole = of[: len(words) - size + 1] == of[size - 1 :]
                left, right = items.near(simhashes(words, size))
                kept = whole[left]
                left, right = left[kept], right[kept]
                if not len(left):
                    continue
                # Word by word, in order.
                same = np.ones(len(left), bool)
                for k in range(size):
                    same &= words[left + k] == items.words[items.start[right] + k]
                alike = np.ones(len(left))
                rest = np.flatnonzero(~same)
                if len(rest):
                    rows = np.lib.stride_tricks.sliding_window_view(window_hashes(words, SHINGLE), size - SHINGLE + 1)
                    alike[rest] = items.similarity(rows[left[rest]], items.shingles[right[rest]])
                kept = alike >= SIMILAR
                out.append((ids[of[left[kept]]], items.item[right[kept]], items.at[right[kept]], same[kept]))
            if out:
                doc, item, at, same = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array(at), pa.array(same)], ["doc_id", "item_id", "at", "exact"])

    return run


def _match_whole(sized: list[Items]):
    """Windows as long as the items against those, length by length; of each document and item the most similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint64)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(len(ids)), np.diff(offsets))
            best: dict[tuple[int, int], float] = {}
            for start in range(0, len(flat), CHUNK):
                longest = max((i.window for i in sized), default=0)
                words, of = flat[start : start + CHUNK + longest - 1], record[start : start + CHUNK + longest - 1]
                sums, shingles = bit_sums(words), window_hashes(words, SHINGLE)
                for items in sized:
                    size = items.window
                    n = min(CHUNK, len(words) - size + 1)
                    if n <= 0:
                        continue
                    whole = np.flatnonzero(of[:n] == of[size - 1 : size - 1 + n])
                    left, right = items.near(simhashes(words[: n + size - 1], size, sums[: n + size])[whole])
                    left = whole[left]
                    rows = np.lib.stride_tricks.sliding_window_view(shingles, size - SHINGLE + 1)
                    for k in range(0, len(left), AT_ONCE):
                        some = slice(k, k + AT_ONCE)
                        alike = items.similarity(rows[left[some]], items.shingles[right[some]])
                        for d, i, x in zip(ids[of[left[some]]].tolist(), items.item[right[some]].tolist(), alike.tolist(), strict=True):
                            if x >= SIMILAR and x > best.get((d, i), 0.0):
                                best[d, i] = x
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(best.values(), pa.float64())], ["doc_id", "item_id", "similarity"])

    return run


def _looked_up(documents: DataFrame, eval_items: DataFrame, match: Callable, schema: str, most_words: int) -> DataFrame:
    """The documents' words against the items, in as many parts as their size asks for; ``match`` makes the pass of a part."""
    words = word_hashes(F.col("text"))
    listed = eval_items.select("item_id", "text").where(has_text(F.col("text"))).select("item_id", words.alias("words"))
    total = listed.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = 1 + total // most_words
    docs = spread(documents.select("doc_id", "text").where(has_text(F.col("text")))).select("doc_id", words.alias("words"))
    if parts > 1:
        docs = cut(docs)
    out: DataFrame | None = None
    for k in range(parts):
        rows = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        found = docs.mapInArrow(match([r["item_id"] for r in rows], [np.array(r["words"], np.int64) for r in rows]), schema)
        out = found if out is None else out.unionByName(found)
    return out


def matches(documents: DataFrame, eval_items: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``(doc_id, item_id, at, exact)``: windows of items (their first word) that documents hold."""
    return _looked_up(documents, eval_items, lambda ids, texts: _match(Items(ids, texts)), "doc_id bigint, item_id bigint, at bigint, exact boolean", most_words)


def copies(documents: DataFrame, eval_items: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``(doc_id, item_id, similarity)``: documents that hold the whole of an item, or nearly; similarity is that of weighted shingles."""

    def match(ids: list[int], texts: list[np.ndarray]):
        lengths = sorted({len(t) for t in texts if len(t) >= WINDOW})
        return _match_whole([Items([i for i, t in zip(ids, texts, strict=True) if len(t) == n], [t for t in texts if len(t) == n], n, ITEM_RADIUS) for n in lengths])

    found = _looked_up(documents, eval_items, match, "doc_id bigint, item_id bigint, similarity double", most_words)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: the document holds ten consecutive words of the item."""
    return matches(documents, eval_items).where("exact").select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Of each affected document and item: windows found, exact ones, the share of the item's windows, and how similar the most similar whole copy is."""
    sizes = eval_items.select("item_id", F.greatest(F.size(word_hashes(F.col("text"))) - WINDOW + 1, F.lit(1)).alias("windows"))
    hits = matches(documents, eval_items).groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("n_windows"), F.count_distinct(F.when(F.col("exact"), F.col("at"))).alias("n_exact"))
    both = hits.join(copies(documents, eval_items), ["doc_id", "item_id"], "full").na.fill(0, ["n_windows", "n_exact"])
    return both.join(sizes, "item_id").select("doc_id", "item_id", "n_windows", "n_exact", (F.col("n_windows") / F.col("windows")).alias("coverage"), "similarity")
