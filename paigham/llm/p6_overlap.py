"""Problem 6: the same or nearly the same records across splits.

Suffix array over partitioned texts. Each distinct text is put in canonical form: its distinct words
in one order for all texts, rare words first. Suffixes of these texts are partitioned by their
leading word and sorted by the words that follow; in a run of adjacent suffixes with a common
prefix, those of train and of evaluation meet. Each meeting is a shared span, as long as their common
prefix; the spans of a pair of texts are merged to the coverage of the train text. Pairs are then compared exactly.

No pair is lost. Of two texts of n and m words with SIMILAR percent in common, at least
(n + m) * SIMILAR / (100 + SIMILAR) words are common, so the first common word of the order stands
within the first n - n * SIMILAR / 100 places of each: a suffix starts at each of those, and in the
canonical form both texts have their common words in the same order.

A leading word is hot if more than ``MEETS`` suffixes of train and of evaluation start with it.
Hot runs are split by further words: instead of one leading word the suffix has two common ones
(then three), whose second stands one place further on at most; so a suffix meets at most ``MEETS``
others for each it counts for. Runs that are still hot after ``DEEPEST`` words are met in full, in
blocks. Similar texts that are not the same have three words in common at least.

Copies of a text (by a 128-bit key) are dropped in the task that saw it, and in the sorted runs; pairs are formed
between distinct texts and only then expanded to rows.

Defined results: null, empty and blank texts are never cases; rows of no or another split take no
part; ties and repeated rows give a pair for each two rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import has_text, key128, word_hashes
from paigham.storage import cut, spread

FREQUENT_PARTS = 100_000
#: Words in common of the words in either, in percent.
SIMILAR = 70
EVALUATION = ("validation", "test")
#: Suffixes of the rarer side that a run may have before it is split by a further word, and leading words at most.
#: A split suffix becomes several that are written and sorted again, so it must save thousands of meetings.
MEETS, DEEPEST = 4_000, 3
#: Suffixes of one side in a block.
BLOCK = 20_000
#: Pairs of suffixes looked at together.
AT_ONCE = 1_000_000
#: Texts of which a task remembers that their words are kept.
MOST_SEEN = 1_000_000
SUFFIX = "head bigint, tail int, text bigint, train boolean, n int, at int, last int, sketch bigint"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records per word, combined within the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([w for w, _ in held])
        counts = np.concatenate([c for _, c in held])
        unique, at = np.unique(words, return_inverse=True)
        return unique, np.bincount(at, weights=counts).astype(np.int64)

    for batch in batches:
        words, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        held.append((words, counts))
        size += len(words)
        if size > 2_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["w", "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["w", "n"])


def frequent_words(rows: DataFrame, parts: int = FREQUENT_PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that make up more than one ``parts``-th of all: fewer than ``parts``."""
    counts = cut(rows.select("words").mapInArrow(_word_counts, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") > max(20, total // parts)).toPandas().sort_values("w")
    return found["w"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _canonical(batch: pa.RecordBatch, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts of a batch in canonical order - by count, rare ones (count unknown) first by hash - and their numbers."""
    lists = batch.column("words")
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    record = np.repeat(np.arange(batch.num_rows), size)
    often = np.zeros(len(flat), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        often = np.where(frequent[at] == flat, counts[at], 0)
    return flat[np.lexsort((flat, often, record))], size


def _packed(second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Two words that follow, 16 bits of each: enough to tell the length of a span, which decides nothing."""
    bits = lambda w: (w.view(np.uint64) >> np.uint64(48)).astype(np.uint32)
    return (bits(second) << np.uint32(16) | bits(third)).view(np.int32)


def _suffixes(frequent: np.ndarray, counts: np.ndarray):
    """Of each text the suffixes that start where the first common word may stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = _canonical(batch, frequent, counts)
            record = np.repeat(np.arange(batch.num_rows), size)
            n = size[record]
            place = np.arange(len(flat)) - (np.cumsum(size) - size)[record]
            bits = np.left_shift(np.uint64(1), flat.view(np.uint64) >> np.uint64(58))
            sketch = np.bitwise_xor.reduceat(bits, np.cumsum(size) - size).view(np.int64)
            after = lambda k: np.where(place + k < n, np.append(flat, np.zeros(k, np.int64))[k:], 0)
            at = np.flatnonzero(100 * (n - place) >= SIMILAR * n)
            who, where = pa.array(record[at]), pa.array(place[at].astype(np.int32))
            columns = [pa.array(flat[at]), pa.array(_packed(after(1), after(2))[at]), batch.column("text").take(who), batch.column("train").take(who), pa.array(n[at].astype(np.int32)), where, where, pa.array(sketch[record[at]])]
            yield pa.RecordBatch.from_arrays(columns, SUFFIX.replace(",", "").split()[::2])

    return run


def _meetings(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Shared spans of suffixes of train and of evaluation in whole runs of a common head (and block)."""
    copies = np.append(False, np.all([rows[c][1:] == rows[c][:-1] for c in ("head", "block", "tail", "text", "train", "last")], axis=0))
    if copies.any():
        rows = {c: v[~copies] for c, v in rows.items()}
    change = (rows["head"][1:] != rows["head"][:-1]) | (rows["block"][1:] != rows["block"][:-1])
    run = np.append(0, np.cumsum(change))
    t, e = np.flatnonzero(rows["train"]), np.flatnonzero(~rows["train"])
    per = np.bincount(run[t], minlength=run[-1] + 1)
    start = np.cumsum(per) - per
    ends = np.cumsum(per[run[e]])
    low = 0
    while low < len(e):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        some = e[low:high]
        n = per[run[some]]
        low = high
        right = np.repeat(some, n)
        left = t[np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[run[some]], n)] if len(right) else right
        both = rows["n"][left] + rows["n"][right]
        # What is left of both from their first common word on must suffice, and words that one text lacks show in the sketches.
        left_over = np.minimum(rows["n"][left] - rows["at"][left], rows["n"][right] - rows["at"][right])
        kept = (left_over * (100 + SIMILAR) >= both * SIMILAR) 
        kept &= (rows["text"][left] != rows["text"][right]) | (rows["sketch"][left] != rows["sketch"][right])
        kept &= np.bitwise_count((rows["sketch"][left] ^ rows["sketch"][right]).view(np.uint64)).astype(np.int64) * (100 + SIMILAR) <= both * (100 - SIMILAR)
        left, right = left[kept], right[kept]
        if not len(left):
            continue
        differ = (rows["tail"][left] ^ rows["tail"][right]).view(np.uint32)
        room = np.minimum(rows["n"][left] - rows["last"][left], rows["n"][right] - rows["last"][right])
        length = np.minimum(room, 1 + (differ >> np.uint32(16) == 0) + (differ == 0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["text"][left], rows["text"][right], rows["last"][left], (rows["last"][left] + length).astype(np.int32))], ["a", "b", "low", "high"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the sorted suffixes of a partition; a run that a batch leaves open goes on in the next."""
    names = ("head", "block", "tail", "text", "train", "n", "at", "last", "sketch")
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        last = (rows["head"] != rows["head"][-1]) | (rows["block"] != rows["block"][-1])
        end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if end:
            done = [*held, {c: v[:end] for c, v in rows.items()}]
            yield from _meetings({c: np.concatenate([d[c] for d in done]) for c in names})
            held = []
        held.append({c: v[end:] for c, v in rows.items()})
    if held:
        yield from _meetings({c: np.concatenate([d[c] for d in held]) for c in names})


def _head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of either side per head, combined within a batch."""
    for batch in batches:
        heads, at = np.unique(batch.column("head").to_numpy(), return_inverse=True)
        train = batch.column("train").to_numpy(zero_copy_only=False)
        t = np.bincount(at[train], minlength=len(heads))
        yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(t), pa.array(np.bincount(at, minlength=len(heads)) - t)], ["head", "t", "e"])


def _longer(frequent: np.ndarray, counts: np.ndarray, depth: int):
    """Of each text the suffixes with one leading word more, for those whose head is hot.

    The next common word stands at most ``depth`` places beyond where the first one may.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = _canonical(batch, frequent, counts)
            start = np.cumsum(size) - size
            bits = np.left_shift(np.uint64(1), flat.view(np.uint64) >> np.uint64(58))
            sketch = np.bitwise_xor.reduceat(bits, start).view(np.int64)
            hot = batch.column("hot")
            entries = hot.flatten()
            head, at, last = (entries.field(c).to_numpy() for c in ("head", "at", "last"))
            record = np.repeat(np.arange(batch.num_rows), np.diff(hot.offsets.to_numpy()))
            n = size[record]
            most = np.minimum(n * (100 - SIMILAR) // 100 + depth, n - 1)
            more = np.maximum(most - last, 0)
            of = np.repeat(np.arange(len(head)), more)
            place = last[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
            record, n = record[of], n[of]
            word = lambda k: np.where(place + k < n, flat[np.minimum(start[record] + place + k, len(flat) - 1)], 0)
            mixed = (head[of].view(np.uint64) ^ (head[of].view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word(0).view(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            who = pa.array(record)
            columns = [pa.array(mixed.view(np.int64)), pa.array(_packed(word(1), word(2))), batch.column("text").take(who), batch.column("train").take(who), pa.array(n.astype(np.int32)), pa.array(at[of]), pa.array(place.astype(np.int32)), pa.array(sketch[record])]
            yield pa.RecordBatch.from_arrays(columns, SUFFIX.replace(",", "").split()[::2])

    return run


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a text are kept with the first row of the task that has it."""
    seen: set[tuple[int, int, bool]] = set()
    for batch in batches:
        if len(seen) > MOST_SEEN:
            seen.clear()
        again = []
        for key in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "train")), strict=True):
            again.append(key in seen)
            seen.add(key)
        words = batch.column("words")
        kept = words.filter(pa.array([not a for a in again]))
        offsets = np.append(0, np.cumsum(np.where(again, 0, np.diff(words.offsets.to_numpy())))).astype(np.int32)
        words = pa.ListArray.from_arrays(offsets, kept.flatten(), mask=pa.array(again))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "train", "x", "y")), words], batch.schema.names)


def base_rows(df: DataFrame) -> DataFrame:
    """``(row_id, train, x, y, words)`` of the rows that take part: the key of their set of words, and those at least once a task."""
    rows = spread(df.select("row_id", "msg", "split").where(F.col("split").isin("train", *EVALUATION) & has_text(F.col("msg"))))
    words = rows.select("row_id", (F.col("split") == "train").alias("train"), F.sort_array(F.array_distinct(word_hashes(F.col("msg")))).alias("words")).where(F.size("words") > 0)
    keyed = words.select("row_id", "train", F.xxhash64("words").alias("x"), F.xxhash64(F.lit(0x5EED), "words").alias("y"), "words")
    return keyed.mapInArrow(_once_a_task, "row_id bigint, train boolean, x bigint, y bigint, words array<bigint>")


def _blocks() -> Column:
    """The blocks a suffix takes part in: long sides of a run are parted, and each part meets each of the other side."""
    parts = {c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in "te"}
    own = {c: F.pmod(F.xxhash64("text"), parts[c]).cast("int") for c in "te"}
    of_train = F.transform(F.sequence(F.lit(0), parts["e"] - 1), lambda i: own["t"] * parts["e"] + i)
    of_other = F.transform(F.sequence(F.lit(0), parts["t"] - 1), lambda i: i * parts["e"] + own["e"])
    return F.when(F.col("t").isNull(), F.array(F.lit(0))).when(F.col("train"), of_train).otherwise(of_other)


def spans(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], meets: int = MEETS, deepest: int = DEEPEST) -> DataFrame:
    """``(a, b, low, high)``: spans of words, in the canonical form of the train text ``a``, that the evaluation text ``b`` shares."""
    suffixes = texts.mapInArrow(_suffixes(*frequent), SUFFIX)
    out: DataFrame | None = None
    for depth in range(1, deepest + 1):
        counts = suffixes.select("head", "train").mapInArrow(_head_counts, "head bigint, t bigint, e bigint").groupBy("head").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
        # Heads that are to be treated apart, far fewer than there are suffixes.
        apart = cut(counts.where((F.least("t", "e") > meets) | ((F.greatest("t", "e") > BLOCK) & (F.least("t", "e") > 0))))
        hot = F.least("t", "e") > meets
        split = depth < deepest and not apart.where(hot).isEmpty()
        met = suffixes.join(apart, "head", "left")
        met = (met.where(~F.coalesce(hot, F.lit(False))) if split else met).withColumn("block", F.explode(_blocks())).drop("t", "e")
        found = met.repartition("head", "block").sortWithinPartitions("head", "block", "tail", "text", "train", "last").mapInArrow(_scan, "a bigint, b bigint, low int, high int")
        out = found if out is None else out.unionByName(found)
        if not split:
            break
        entries = suffixes.join(apart.where(hot).select("head"), "head").groupBy("text", "train").agg(F.collect_set(F.struct("head", "at", "last")).alias("hot"))
        suffixes = cut(texts.join(entries, ["text", "train"]).mapInArrow(_longer(*frequent, depth), SUFFIX))
    return out


class Texts:
    """The distinct texts of a table, and the rows that have them."""

    def __init__(self, df: DataFrame):
        self.rows = cut(base_rows(df))
        self.texts = self.rows.where("words is not null").select(F.col("x").alias("text"), "y", "train", "words")
        #: ``(row_id, train, x, y)``
        self.members = self.rows.drop("words")

    def similar(self, meets: int = MEETS, deepest: int = DEEPEST) -> DataFrame:
        """``(xa, ya, xb, yb, covered, common, either)``: texts of train and of evaluation with enough words in common, not the same words.

        ``covered`` is the length of the merged spans that the suffixes show, ``common`` all words in common.
        """
        merge = F.aggregate(F.array_sort(F.collect_set(F.struct("low", "high"))), F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto")), lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["high"] - F.greatest(s["upto"], x["low"]))).alias("covered"), F.greatest(s["upto"], x["high"]).alias("upto")))
        texts = self.texts.select("text", "train", "words")
        pairs = cut(spans(texts, frequent_words(self.texts), meets, deepest).groupBy("a", "b").agg(merge["covered"].alias("covered")))

        def side(of: str) -> DataFrame:
            needed = pairs.select(F.col(of).alias("text")).distinct()
            own = self.texts.where("train" if of == "a" else "not train").join(needed, "text", "left_semi").dropDuplicates(["text", "y"])
            return own.select(F.col("text").alias(of), F.col("y").alias(f"y{of}"), F.col("words").alias(f"w{of}"))

        common = F.size(F.array_intersect("wa", "wb"))
        compared = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "ya", "b", "yb", "covered", common.alias("common"), (F.size("wa") + F.size("wb")).alias("both"))
        near = compared.where((F.col("common") * 100 >= SIMILAR * (F.col("both") - F.col("common"))) & (F.col("common") * 2 < F.col("both")))
        return near.select(F.col("a").alias("xa"), "ya", F.col("b").alias("xb"), "yb", "covered", "common", (F.col("both") - F.col("common")).alias("either"))

    def links(self) -> DataFrame:
        """``(xa, ya, xb, yb)``: texts of train and of evaluation with the same or with enough common words."""
        shared = self.members.groupBy("x", "y").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("e")).where("t and e")
        same = shared.select(*(F.col(c[0]).alias(c) for c in ("xa", "ya", "xb", "yb")))
        return self.similar().select("xa", "ya", "xb", "yb").unionByName(same)


def _cleaned(df: DataFrame) -> DataFrame:
    """``(row_id, train, ca, cb)``: the key of ``cleaned_msg`` of the rows that take part and have one."""
    a, b = key128(F.col("cleaned_msg"))
    kept = df.select("row_id", "split", "cleaned_msg").where(F.col("split").isin("train", *EVALUATION) & has_text(F.col("cleaned_msg")))
    return kept.select("row_id", (F.col("split") == "train").alias("train"), a.alias("ca"), b.alias("cb"))


def found(df: DataFrame) -> DataFrame:
    """``(row_a, row_b)``: a train row and an evaluation row with equal ``cleaned_msg`` or similar ``msg``."""
    texts = Texts(df)
    side = lambda rows, train, name: rows.where("train" if train else "not train").withColumnRenamed("row_id", name).drop("train")
    member = lambda train, name, x: side(texts.members, train, name).withColumnsRenamed({"x": f"x{x}", "y": f"y{x}"})
    near = texts.links().join(member(True, "i", "a"), ["xa", "ya"]).join(member(False, "j", "b"), ["xb", "yb"]).select("i", "j")
    kept = _cleaned(df)
    cleaned = side(kept, True, "i").join(side(kept, False, "j"), ["ca", "cb"]).select("i", "j")
    pairs = near.unionByName(cleaned).distinct()
    return pairs.select(F.least("i", "j").alias("row_a"), F.greatest("i", "j").alias("row_b"))


def classes(df: DataFrame) -> DataFrame:
    """``(row_id, class_row_id, n_links)``: every row that takes part with the smallest row of the same words, and its number of partners.

    No pair of rows is formed: partners are counted class by class - rows of the texts linked to the
    row's own, rows of the other side with its ``cleaned_msg``, less those that are both.
    """
    texts = Texts(df)
    both = texts.members.withColumnRenamed("train", "t").join(_cleaned(df), "row_id", "full")
    rows = cut(both.select("row_id", F.coalesce("t", "train").alias("train"), "x", "y", "ca", "cb"))
    one_way = cut(texts.links())
    ways = [({"xa": "x", "ya": "y", "xb": "xo", "yb": "yo"}, True), ({"xb": "x", "yb": "y", "xa": "xo", "ya": "yo"}, False)]
    first, second = (one_way.withColumnsRenamed(names).withColumn("train", F.lit(train)) for names, train in ways)
    links = first.unionByName(second)
    other = [F.col("x").alias("xo"), F.col("y").alias("yo"), (~F.col("train")).alias("train")]
    worded = rows.where("x is not null")
    near = links.join(worded.groupBy(*other).agg(F.count("*").alias("k")), ["xo", "yo", "train"]).groupBy("x", "y", "train").agg(F.sum("k").alias("near"))
    cleaned = rows.where("ca is not null").groupBy("ca", "cb", (~F.col("train")).alias("train")).agg(F.count("*").alias("alike"))
    joint = worded.where("ca is not null").groupBy("x", "y", "ca", "cb", "train").agg(F.count("*").alias("k"))
    across = joint.select(*other, "ca", "cb", "k")
    twice = links.join(joint.drop("k"), ["x", "y", "train"]).join(across, ["xo", "yo", "ca", "cb", "train"]).groupBy("x", "y", "ca", "cb", "train").agg(F.sum("k").alias("twice"))
    firsts = worded.groupBy("x", "y").agg(F.min("row_id").alias("first"))
    counted = rows.join(firsts, ["x", "y"], "left").join(near, ["x", "y", "train"], "left").join(cleaned, ["ca", "cb", "train"], "left").join(twice, ["x", "y", "ca", "cb", "train"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counted.select("row_id", F.coalesce("first", "row_id").alias("class_row_id"), (number("near") + number("alike") - number("twice")).alias("n_links"))


def report(df: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap with train, and pairs."""
    linked = classes(df).where("n_links > 0").select("row_id", "n_links")
    held_out = df.select("row_id", "split", "source").where(F.col("split").isin(*EVALUATION))
    joined = held_out.join(linked, "row_id", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n_links").alias("n_overlapping"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_pairs"))
