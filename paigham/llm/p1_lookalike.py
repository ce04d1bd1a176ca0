"""Problem 1: text that looks the same, spelled with other characters.

Every token that holds a look-alike, a combining accent or an ignorable character walks a trie of
the corpus vocabulary with a weighted edit automaton: look-alikes and ignorables cost nothing,
other edits cost one. At the default bound 0 only spellings that look the same are accepted, so
messages that look different stay different. Some characters are drawn like more than one letter (a
bar is a capital I or a small l): of the words that a token may be, the most frequent is its
spelling. A token the vocabulary lacks is spelled by the table.

The vocabulary grows with the corpus, so it is never broadcast: vocabulary and odd tokens meet by
their skeleton - the table's form with all letters that are drawn alike as one - in tries of about
``TRIE_TOKENS`` odd tokens each, however many there are. A skeleton has few words, so no trie has a hot block.

Defined results: null stays null; empty and blank texts come out by the table alone and are never
cases; repeated rows come out alike; columns other than ``row_id`` and ``msg`` are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import has_text, key128, width
from paigham.storage import cut, spread

# Letters of other scripts that are drawn as the Latin letter after them.
CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs һh ӏl ԁd ԛq ԝw АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԚQ ԜW ӀI"
GREEK = "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
OTHER = "ɡg ɑa օo Օo ꓮA ꓐB ꓚC ꓰE"
#: Characters that are drawn like more than one letter, with all of them; the table gives the first.
BARS = "ІIl ӀIl ӏlI ΙIl ⅠIl ⅼlI"
#: Hyphens drawn as the plain one.
HYPHENS = [0x2010, 0x2011]
#: Spaces drawn as a space: no-break, fixed-width and ideographic ones.
SPACES = [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Characters that are not drawn at all: soft hyphen, joiners, direction marks, word joiners, byte order mark.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]

#: Code point -> what it is spelled as. Full-width forms, Roman numerals and upright letters of the
#: mathematical blocks (sans-serif, fixed width) follow by compatibility mapping.
TABLE: dict[int, str] = (
    {ord(a): b for a, b in (CYRILLIC + " " + GREEK + " " + OTHER).split()}
    | dict.fromkeys(HYPHENS, "-")
    | dict.fromkeys(SPACES, " ")
    | dict.fromkeys(INVISIBLE, "")
    | {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFEF), *range(0x2160, 0x2180), *range(0x1D5A0, 0x1D5D4), *range(0x1D670, 0x1D6A4), *range(0x1D7E2, 0x1D7EC), *range(0x1D7F6, 0x1D800)] if unicodedata.category(chr(c)) != "Cn"}
)
#: Code point -> all letters it may be.
READINGS: dict[int, str] = {ord(x[0]): x[1:] for x in BARS.split()}
#: Letters that some character may be both of, as one: the skeleton of a word.
SKELETON = {ord(b): min(x[1:]) for x in BARS.split() for b in x[1:]}
#: Odd tokens to a trie.
TRIE_TOKENS = 50_000
TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}]+")
#: Joiners shape emoji sequences and Arabic-script words: between those they are drawn.
ZWNJ, ZWJ, EMOJI_STYLE = chr(0x200C), chr(0x200D), chr(0xFE0F)
ARABIC = f"[{chr(0x620)}-{chr(0x6FF)}]"
JOINED = regex.compile(rf"(?<=[\p{{So}}\p{{Sk}}{EMOJI_STYLE}]){ZWJ}(?=\p{{So}})|(?<={ARABIC})[{ZWNJ}{ZWJ}](?={ARABIC})")
#: Drawn joiners are held as noncharacters while the table is applied.
HELD = {ZWNJ: chr(0xFDD0), ZWJ: chr(0xFDD1)}
RELEASE = {0xFDD0: ZWNJ, 0xFDD1: ZWJ}
#: Vocabulary words: spelled only with characters the table leaves alone.
PLAIN = r"^[0-9A-Za-zÀ-ÖØ-öø-ɏء-يٮ-ۓ]+$"
TOKENS_JVM = r"[\p{L}\p{N}\p{M}\p{Cf}]+"


def by_table(text: str) -> str:
    """The one form of ``text``, by the table alone."""
    if text.isascii():
        return text
    text = JOINED.sub(lambda m: HELD[m[0]], text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(TABLE)).translate(RELEASE)


class VocabularyTrie:
    """A trie kept as a sorted list: a node is the range of words with a common prefix."""

    def __init__(self, counts: dict[str, int]):
        spelled = sorted((unicodedata.normalize("NFD", w), w) for w in counts)
        self.keys = [k for k, _ in spelled]
        self.words = [w for _, w in spelled]
        self.counts = counts

    def child(self, node: tuple[int, int, int], letter: str) -> tuple[int, int, int] | None:
        low, high, depth = node
        at = lambda w: w[depth : depth + 1]
        low = bisect_left(self.keys, letter, low, high, key=at)
        high = bisect_right(self.keys, letter, low, high, key=at)
        return (low, high, depth + 1) if low < high else None

    def children(self, node: tuple[int, int, int]) -> Iterator[tuple[int, int, int]]:
        low, high, depth = node
        while low < high:
            if len(self.keys[low]) == depth:
                low += 1
                continue
            nxt = self.child((low, high, depth), self.keys[low][depth])
            yield nxt
            low = nxt[1]

    def nearest(self, token: str, bound: int = 0) -> str | None:
        """The cheapest word within ``bound``, of equal ones the most frequent, then the first."""
        states: dict[tuple[int, int, int], int] = {(0, len(self.keys), 0): 0}

        def put(into: dict, node: tuple[int, int, int] | None, cost: int) -> None:
            if node is not None and cost <= bound and cost < into.get(node, bound + 1):
                into[node] = cost

        def insertions(into: dict) -> None:
            ready = [x for x in into.items() if x[1] < bound]
            while ready:
                node, cost = ready.pop()
                for nxt in self.children(node):
                    if cost + 1 < into.get(nxt, bound + 1):
                        into[nxt] = cost + 1
                        if cost + 1 < bound:
                            ready.append((nxt, cost + 1))

        insertions(states)
        for letter in unicodedata.normalize("NFD", token):
            after: dict[tuple[int, int, int], int] = {}
            drawn = TABLE.get(ord(letter))
            spelled = READINGS.get(ord(letter)) or (drawn and [drawn])
            for node, cost in states.items():
                if drawn == "":
                    put(after, node, cost)
                    continue
                put(after, self.child(node, letter), cost)
                for form in spelled or ():
                    nxt: tuple[int, int, int] | None = node
                    for x in form:
                        nxt = nxt and self.child(nxt, x)
                    put(after, nxt, cost)
                if cost < bound:
                    put(after, node, cost + 1)
                    for nxt in self.children(node):
                        put(after, nxt, cost + 1)
            insertions(after)
            states = after
            if not states:
                return None
        ends = [(cost, -self.counts[self.words[node[0]]], self.words[node[0]]) for node, cost in states.items() if len(self.keys[node[0]]) == node[2]]
        return min(ends)[2] if ends else None


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with other than ASCII characters as parts; tokens that are spelled oddly, with their form by the table."""
    for batch in batches:
        all_parts, raws, folds = [], [], []
        for msg in batch.column("msg").to_pylist():
            msg = unicodedata.normalize("NFC", JOINED.sub(lambda m: HELD[m[0]], msg))
            parts, raw, fold, at = [], [], [], 0
            for m in TOKEN.finditer(msg):
                if m.start() > at:
                    parts.append(by_table(msg[at : m.start()]).translate(RELEASE))
                at, token = m.end(), m[0]
                folded = by_table(token)
                if folded != token:
                    raw.append(token)
                    fold.append(folded)
                parts.append(token)
            if at < len(msg):
                parts.append(by_table(msg[at:]).translate(RELEASE))
            all_parts.append(parts)
            raws.append(raw)
            folds.append(fold)
        text = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("msg"), pa.array(all_parts, text), pa.array(raws, text), pa.array(folds, text)], ["row_id", "msg", "parts", "raw", "fold"])


def _spell(vocabulary: pd.DataFrame, odd: pd.DataFrame) -> pd.DataFrame:
    """One group of blocks: the words of its trie for its odd tokens, else the table's form."""
    if not len(odd):
        return pd.DataFrame({"raw": pd.Series(dtype=str), "canon": pd.Series(dtype=str)})
    trie = VocabularyTrie(dict(zip(vocabulary["token"], vocabulary["n"].tolist(), strict=True)))
    canon = [trie.nearest(raw) or fold for raw, fold in zip(odd["raw"], odd["fold"], strict=True)]
    return pd.DataFrame({"raw": odd["raw"].to_numpy(), "canon": canon})


def _skeleton(c: Column) -> Column:
    """Equal for all words that one token may be: letters that are drawn alike are one letter."""
    alike = {chr(a): b for a, b in SKELETON.items() if chr(a) != b}
    return F.xxhash64(F.translate(c, "".join(alike), "".join(alike.values())))


def normalized(df: DataFrame) -> DataFrame:
    """``(row_id, msg, canon, changed)``: every message in the one form in which those that look the same are equal."""
    spark = df.sparkSession
    base = spread(df.select("row_id", "msg"))
    is_odd = F.coalesce(F.col("msg").rlike(r"[^\x00-\x7F]"), F.lit(False))
    odd_rows = cut(base.where(is_odd).mapInArrow(_split, "row_id bigint, msg string, parts array<string>, raw array<string>, fold array<string>"))
    tokens = odd_rows.select("row_id", F.explode(F.arrays_zip("raw", "fold")).alias("t")).select("row_id", "t.raw", "t.fold")
    odd = cut(tokens.select("raw", "fold").distinct().withColumn("skeleton", _skeleton(F.col("fold"))))
    shard = F.pmod("skeleton", F.lit(max(width(spark), odd.count() // TRIE_TOKENS)))
    odd = odd.withColumn("shard", shard)
    vocabulary = (
        base.where(F.col("msg").isNotNull())
        .select(F.explode(F.regexp_extract_all("msg", F.lit(TOKENS_JVM), F.lit(0))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .where(F.col("token").rlike(PLAIN))
        .withColumn("skeleton", _skeleton(F.col("token")))
        .join(odd.select("skeleton").distinct(), "skeleton", "left_semi")
        .withColumn("shard", shard)
    )
    spelled = vocabulary.groupBy("shard").cogroup(odd.groupBy("shard")).applyInPandas(_spell, "raw string, canon string")
    per_row = tokens.select("row_id", "raw").distinct().join(spelled, "raw").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "canon"))).alias("spelling"))
    rebuilt = (
        odd_rows.join(per_row, "row_id", "left")
        .select("row_id", "msg", F.array_join(F.transform("parts", lambda p: F.coalesce(F.element_at("spelling", p), p)), "").alias("canon"))
        .withColumn("changed", F.col("canon") != F.col("msg"))
    )
    plain = base.where(~is_odd).select("row_id", "msg", F.col("msg").alias("canon"), F.lit(False).alias("changed"))
    return plain.unionByName(rebuilt)


def found(df: DataFrame) -> DataFrame:
    """Pairs of rows that look the same and are spelled with other characters.

    Of such a pair at least one row is not in the one form, so the few changed rows meet all rows on
    the hash of that form; a hot form is split by adaptive skew handling of the join.
    """
    a, b = key128(F.col("canon"))
    x, y = key128(F.col("msg"))
    keyed = cut(normalized(df).where(has_text(F.col("canon"))).select("row_id", a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"), "changed"))
    left = keyed.where("changed").select(F.col("row_id").alias("i"), "a", "b", F.col("x").alias("xi"), F.col("y").alias("yi"))
    right = keyed.select(F.col("row_id").alias("j"), "a", "b", F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("changed").alias("both"))
    pairs = left.join(right, ["a", "b"]).where(((F.col("xi") != F.col("xj")) | (F.col("yi") != F.col("yj"))) & (~F.col("both") | (F.col("i") < F.col("j"))))
    return pairs.select(F.least("i", "j").alias("row_a"), F.greatest("i", "j").alias("row_b"))


def classes(df: DataFrame) -> DataFrame:
    """``(row_id, class_row_id, n_rows, n_links)``: each row with text, the smallest row that looks the same, how many do, and how many of them are spelled with other characters.

    Counted with partial sums: no pair of rows is formed, however hot a form is.
    """
    a, b = key128(F.col("canon"))
    x, y = key128(F.col("msg"))
    keyed = cut(normalized(df).where(has_text(F.col("canon"))).select("row_id", a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y")))
    forms = keyed.groupBy("a", "b").agg(F.min("row_id").alias("class_row_id"), F.count("*").alias("n_rows"))
    spelled = keyed.groupBy("a", "b", "x", "y").agg(F.count("*").alias("same"))
    return keyed.join(spelled, ["a", "b", "x", "y"]).join(forms, ["a", "b"]).select("row_id", "class_row_id", "n_rows", (F.col("n_rows") - F.col("same")).alias("n_links"))
