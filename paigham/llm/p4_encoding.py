"""Problem 4: text read with the wrong character encoding.

Characters are mapped back to the bytes they have in a legacy encoding; an automaton over the
structure of UTF-8 finds the maximal well-formed multibyte spans among them, and only those spans
are decoded. This is repeated until nothing changes - every step shortens the text, so it ends - and
text garbled twice, or in parts by several encodings, comes out whole. A span counts if what it
decodes to is expected in the corpus (Latin and Arabic letters, marks, currency, emoji), or is a word
of any one script: some letters, or six bytes, of it at least, or a shorter piece in a text with such
words. A span that one encoding reads as letters of another script, too few to be
sure, is left as it is: no other encoding rewrites a part of it. And a span counts only if it is not
itself right as it stands: look-alike letters, Arabic words and no-break spaces can form byte sequences by chance.

Replacement characters and control characters of the C1 range mark a row as affected; what a
replacement character stood for is not known, and it stays. Text of one single-byte encoding read as
another has no structure to tell it by and is not found.

Defined results: null, empty and pure ASCII texts are never affected and come out unchanged;
repeated rows come out alike; columns other than ``row_id`` and ``msg`` are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.llm.p1_lookalike import TABLE
from paigham.storage import spread

#: The legacy encodings, likelier ones first; the first wins where two explain as much.
ENCODINGS = ("cp1252", "cp1251", "cp437", "mac_roman", "cp1256", "cp1250", "cp850", "cp1254", "cp1253", "iso8859_15", "iso8859_2", "cp1257", "cp1255", "cp1258", "mac_latin2", "cp852", "cp858", "cp866", "koi8_r", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_9")


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes the encoding leaves open are read as C1 controls."""
    table = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


BYTES = {e: _bytes_of(e) for e in ENCODINGS}
#: What decoded text may hold: ranges of code points.
EXPECTED = ((0xA0, 0x17F), (0x192, 0x192), (0x2B0, 0x2FF), (0x600, 0x6FF), (0x750, 0x77F), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x214F), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2300, 0x23FF), (0x2500, 0x27BF), (0xF8FF, 0xF8FF), (0xFB50, 0xFDCF), (0xFE00, 0xFEFF), (0xFF01, 0xFFEE), (0x1F000, 0x1FAFF))
NON_ASCII = re.compile(r"[^\x00-\x7f]{2,}")
MARKS = re.compile("[" + chr(0xFFFD) + chr(0x80) + "-" + chr(0x84) + chr(0x86) + "-" + chr(0x9F) + "]")
NBSP, SHY = chr(0xA0), chr(0xAD)
ARABIC = (0x600, 0x6FF)
QUOTES = frozenset(map(chr, (0x2018, 0x2019, 0x201C, 0x201D)))


def spans(data: list[int | None]) -> Iterator[tuple[int, int]]:
    """Maximal spans of well-formed UTF-8 multibyte sequences (None: no byte)."""
    i, n = 0, len(data)
    start = None
    while i < n:
        b = data[i]
        length, low, high = 0, 0x80, 0xBF
        if b is not None:
            if 0xC2 <= b <= 0xDF:
                length = 2
            elif 0xE0 <= b <= 0xEF:
                length = 3
                low = 0xA0 if b == 0xE0 else 0x80
                high = 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                length = 4
                low = 0x90 if b == 0xF0 else 0x80
                high = 0x8F if b == 0xF4 else 0xBF
        good = bool(length) and i + length <= n
        for k in range(1, length if good else 0):
            c = data[i + k]
            if c is None or not low <= c <= high:
                good = False
                break
            low, high = 0x80, 0xBF
        if good:
            if start is None:
                start = i
            i += length
        else:
            if start is not None:
                yield start, i
                start = None
            i += 1
    if start is not None:
        yield start, n


def _expected(text: str) -> bool:
    return all(any(a <= ord(c) <= b for a, b in EXPECTED) or 0x80 <= ord(c) < 0xA0 for c in text)


#: Scripts that are written together.
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "CJK"}
#: Letters, or bytes, from which on a span is a word of its script.
WORD_LETTERS, WORD_BYTES = 3, 6


@cache
def _script(c: str) -> str:
    """The script of a letter or mark by the first word of its name; empty for what any script uses."""
    if not (c.isalpha() or unicodedata.category(c)[0] == "M"):
        return ""
    first = unicodedata.name(c, "UNKNOWN").split()[0]
    return TOGETHER.get(first, first)


def _one_script(decoded: str) -> tuple[str, bool]:
    """The script of a span with letters beyond the expected ones, if it is only one; and whether it is a word of it."""
    scripts = {_script(c) for c in decoded} - {"", "COMBINING", "ZERO", "VARIATION"}
    if len(scripts) != 1 or scripts <= {"UNKNOWN", "LATIN", "ARABIC"} or any(not _script(c) and not _expected(c) and unicodedata.category(c)[0] not in "PN" for c in decoded):
        return "", False
    letters = [c for c in decoded if _script(c)]
    size = sum(len(c.encode()) for c in letters)
    return next(iter(scripts)), len(letters) >= WORD_LETTERS or (len(letters) >= 2 and size >= WORD_BYTES)


def _weak(source: str, encoding: str) -> bool:
    """Could stand there by right: look-alike letters, or Arabic letters and their punctuation."""
    if all(ord(c) in TABLE or c in QUOTES for c in source):
        return True
    return encoding in ("cp1256", "iso8859_6") and all(ARABIC[0] <= ord(c) <= ARABIC[1] or ord(c) in TABLE or c in QUOTES for c in source)


#: Arabic letters that are lead bytes of accented Latin letters and symbols.
ARABIC_LEADS = frozenset(map(chr, (0x622, 0x623, 0x624, 0x625)))


def _beside_latin(text: str, a: int, b: int) -> bool:
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    return (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())


def _candidates(text: str, encoding: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans that may be decoded (an empty text: right as they stand, maybe), and spans that are to be left whole."""
    table, out, other = BYTES[encoding], [], []
    for m in NON_ASCII.finditer(text):
        data = [table.get(c) for c in m[0]]
        for a, b in spans(data):
            source, decoded = m[0][a:b], bytes(data[a:b]).decode()  # type: ignore[arg-type]
            if not _expected(decoded):
                script, word = _one_script(decoded) if not _weak(source, encoding) else ("", False)
                if script:
                    other.append((m.start() + a, m.start() + b, decoded, script, word))
                    continue
                # Of a longer span keep the characters that are expected.
                k = a
                for c in decoded:
                    size = len(c.encode())
                    if _expected(c) and not _weak(m[0][k : k + size], encoding):
                        out.append((m.start() + k, m.start() + k + size, c))
                    k += size
                continue
            if not _weak(source, encoding):
                out.append((m.start() + a, m.start() + b, decoded))
            elif encoding == "cp1256" and source[0] in ARABIC_LEADS and _beside_latin(text, m.start() + a, m.start() + b):
                out.append((m.start() + a, m.start() + b, decoded))
            else:
                out.append((m.start() + a, m.start() + b, ""))
    sure = {script for *_, script, word in other if word}
    out += [(a, b, decoded) for a, b, decoded, script, _ in other if script in sure]
    return sorted(out), [(a, b) for a, b, decoded, script, _ in other if script not in sure and sum(map(bool, map(_script, decoded))) > 1]


def _apply(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, decoded in found:
        out += [text[at:a], decoded]
        at = b
    return "".join(out) + text[at:]


def _settle(text: str, found: list[tuple[int, int, str]], encoding: str) -> list[tuple[int, int, str]]:
    """Without the spans that may well be right as they stand in this text."""
    strong = [x for x in found if x[2]]
    weak = [x for x in found if not x[2]]
    inside = [False] * len(text)
    for a, b, _ in strong:
        inside[a:b] = [True] * (b - a)
    loose = {c for c, i in zip(text, inside, strict=True) if not i and ord(c) in TABLE}
    kept = []
    for a, b, decoded in strong:
        # A no-break space or soft hyphen after a capital with tilde or circumflex, in a text that uses them anyway.
        if b - a == 2 and text[a + 1] in (NBSP, SHY) and (text[a + 1] in loose or any(c in loose for c in (NBSP, SHY)) or (text[a + 1] == NBSP and text[max(0, a - 1)].isupper())):
            continue
        kept.append((a, b, decoded))
    letters = {c for c in loose if c.isalpha()}
    for a, b, _ in weak:
        source = text[a:b]
        # A symbol read as two Cyrillic letters, standing by itself in a text without other look-alikes.
        others = any(ord(c) in TABLE and c.isalpha() for i, c in enumerate(text) if not inside[i] and not a <= i < b)
        if encoding in ("cp1251",) and b - a == 2 and not others and source[0] == chr(0x412) and letters and not text[max(0, a - 1) : a].isalpha() and not text[b : b + 1].isalpha():
            data = bytes(BYTES[encoding][c] for c in source)
            if chr(ord(data.decode())) in "£½³²¼¾":
                kept.append((a, b, data.decode()))
    return sorted(kept)


def restore(text: str) -> tuple[str, bool]:
    """The text with its garbled spans decoded, and whether it held any or other marks of a wrong encoding."""
    if text.isascii():
        return text, False
    affected = MARKS.search(text) is not None
    while NON_ASCII.search(text):
        best: tuple[int, list[tuple[int, int, str]]] = (0, [])
        read = [(encoding, *_candidates(text, encoding)) for encoding in ENCODINGS]
        left = [span for _, _, whole in read for span in whole]
        for encoding, found, _ in read:
            if found:
                found = [x for x in _settle(text, found, encoding) if not any(a <= x[0] and x[1] <= b and x[1] - x[0] < b - a for a, b in left)]
                covered = sum(b - a for a, b, _ in found)
                if covered > best[0]:
                    best = (covered, found)
        if not best[0]:
            break
        text, affected = _apply(text, best[1]), True
    if MARKS.search(text):
        # Single bytes of the Windows encoding read as C1 controls.
        text = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c if 0x80 <= ord(c) < 0xA0 else c for c in text)
    return text, affected


def restored(df: DataFrame) -> DataFrame:
    """``(row_id, restored, affected)`` of all rows; only rows beyond ASCII leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [restore(m) for m in batch.column("msg").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([t for t, _ in out], pa.string()), pa.array([a for _, a in out], pa.bool_())], ["row_id", "restored", "affected"])

    base = df.select("row_id", "msg")
    beyond = F.coalesce(F.col("msg").rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = base.where(~beyond).select("row_id", F.col("msg").alias("restored"), F.lit(False).alias("affected"))
    return plain.unionByName(spread(base.where(beyond)).mapInArrow(run, "row_id bigint, restored string, affected boolean"))


def found(df: DataFrame) -> DataFrame:
    """``(row_id)`` of the affected rows."""
    base = df.select("row_id", "msg").where(F.col("msg").rlike(r"[^\x00-\x7F]"))
    return restored(base).where("affected").select("row_id")
