"""Text cleaning as Column expressions: regular expressions and array functions, all in the JVM.

Characters are classed as Unicode classes them: any white space, any decimal digit, letters of any
script. Nulls clean to the empty string where a string is asked for, as the pipeline needs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paigham import lexicon
from paigham.config import Settings

#: White space of any kind, with the four separators that Unicode does not class as such.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
SPACE_SET = SPACE[1:-1]
DIGIT = r"\p{Nd}"
#: A noncharacter that no text holds.
HELD = chr(0xFDD0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"{SPACE}+", " "), r"^ | $", "")


def duplicate_key(c: Column) -> Column:
    """The key under which texts count as the same: stripped, lower case, single spaces; missing is the text ``nan``."""
    return F.coalesce(F.regexp_replace(F.lower(strip(c)), rf"{SPACE}+", " "), F.lit("nan"))


def replace_urls(c: Column, token: str = lexicon.URL_TOKEN) -> Column:
    full = F.regexp_replace(c, rf"(?i)(?:https?://|www\.)[^{SPACE_SET}]+", token)
    ends = rf"\.(?:{'|'.join(lexicon.TOP_LEVEL_DOMAINS)})(?U:\b)"
    # Labels are not empty: dots in a row are held apart, so that a host is one run of characters, however many labels it has.
    apart = F.when(full.contains(".."), F.regexp_replace(full, r"\.(?=\.)", f".{HELD}")).otherwise(full)
    hosts = F.regexp_replace(apart, rf"(?i)(?U:\b)[a-z0-9][a-z0-9.-]*{ends}(?:/[^{SPACE_SET}]*)?", token)
    return F.when(full.rlike(rf"(?i){ends}"), F.when(full.contains(".."), F.replace(hosts, F.lit(HELD), F.lit(""))).otherwise(hosts)).otherwise(full)


def replace_numbers(c: Column, mode: str = "token", phones: bool = True, service_codes: bool = True, short_codes: tuple[str, ...] = lexicon.SHORT_CODES) -> Column:
    """Masked numbers, service codes and phones to their tokens; known short codes stay, other numbers go by ``mode``."""
    c = F.regexp_replace(c, rf"(?i)\[{SPACE}*number{SPACE}*\]", lexicon.PHONE_TOKEN)
    if service_codes:
        c = F.regexp_replace(c, rf"\*{SPACE}?{DIGIT}{{2,7}}{SPACE}?#", lexicon.SHORTCODE_TOKEN)
    if phones:
        gap = rf"[{SPACE_SET}-]?"
        c = F.regexp_replace(c, rf"(?:\+?92|0){gap}3{DIGIT}{{2}}{gap}{DIGIT}{{7}}(?U:\b)|(?U:\b){DIGIT}{{11}}(?U:\b)", lexicon.PHONE_TOKEN)
    if mode == "keep":
        return c
    other = " " if mode == "remove" else lexicon.NUMBER_TOKEN

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, rf"[^{DIGIT}]", "")
        return F.when(digits == "", part).when(digits.isin(list(short_codes)), digits).otherwise(F.lit(other))

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(rf"{DIGIT}[{DIGIT},.]*|[^{DIGIT}]+"), F.lit(0)), one), "")


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iu)[^a-z0-9{SPACE_SET}]", " ")


def clean(c: Column, settings: Settings = Settings()) -> Column:
    """Lower case, links, numbers, punctuation, other characters, white space - each as set."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    if settings.lowercase:
        c = F.lower(c)
    if settings.urls:
        c = replace_urls(c)
    c = replace_numbers(c, settings.number_mode, settings.phones, settings.service_codes, settings.short_codes)
    if settings.punctuation and settings.whitespace:
        # What is no letter or digit goes or is a space: one pass for punctuation, other characters and white space.
        return F.trim(F.regexp_replace(c, r"(?iu)[^a-z0-9]+", " "))
    if settings.punctuation:
        c = remove_special(c)
    return squeeze(c) if settings.whitespace else c


def tokens(c: Column) -> Column:
    """The parts between white space; none for an empty text."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda t: t != "")


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _spellings(mapping: dict[str, str]) -> dict[str, str]:
    """Placeholders are never respelled."""
    return {k: v for k, v in mapping.items() if k not in (lexicon.URL_TOKEN, lexicon.PHONE_TOKEN, lexicon.NUMBER_TOKEN, lexicon.SHORTCODE_TOKEN)}


def normalize_spelling(c: Column, mapping: dict[str, str] = lexicon.SPELLINGS) -> Column:
    """Whole words to their standard spelling in one pass; what stands between words stays."""
    mapping = _spellings(mapping)
    if not mapping:
        return c
    table = lookup(mapping)
    parts = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(table[p], p)), "")


def normalize_tokens(parts: Column, mapping: dict[str, str] = lexicon.SPELLINGS) -> Column:
    """Tokens to their standard spelling, which may be two tokens."""
    mapping = _spellings(mapping)
    if not mapping:
        return parts
    table = lookup(mapping)
    # Few words are variants: a set tells them before the map is searched; only two-word values are split again.
    mapped = F.transform(parts, lambda t: F.when(t.isin(list(mapping)), table[t]).otherwise(t))
    return F.split(F.array_join(mapped, " "), " ") if any(" " in v for v in mapping.values()) else mapped


def remove_stopwords(parts: Column, stop: frozenset[str], least: int = 2) -> Column:
    protected = sorted(lexicon.PROTECTED)
    return F.filter(parts, lambda t: t.isin(protected) | (~t.isin(sorted(stop)) & (F.length(t) >= least)))


def preprocess(c: Column, settings: Settings = Settings()) -> Column:
    """The whole chain from a message to its cleaned text."""
    c = clean(c, settings)
    if settings.punctuation and settings.whitespace:
        # Single spaces only: words are what stands between them.
        parts = F.array_remove(F.split(c, " "), "")
        parts = normalize_tokens(parts, settings.spellings) if settings.spelling else parts
    else:
        parts = tokens(normalize_spelling(c, settings.spellings) if settings.spelling else c)
    if settings.drop_stopwords:
        parts = remove_stopwords(parts, settings.stopwords, settings.min_token_length)
    return F.array_join(parts, " ")


def ngrams(parts: Column, n: int = 2, least: int = 2) -> Column:
    """Tokens of ``least`` characters, then runs of up to ``n`` of them."""
    return runs(F.filter(parts, lambda t: F.length(t) >= least), n)


def runs(parts: Column, n: int) -> Column:
    """All runs of one to ``n`` words. ``parts`` should be a column: it is read several times."""
    out, longest = [parts], parts
    for k in range(2, n + 1):
        # Each run of k - 1 words with the word after it; arrays are shifted, not looked up word by word.
        size = F.greatest(F.size(parts) - (k - 1), F.lit(0))
        longest = F.zip_with(F.slice(longest, F.lit(1), size), F.slice(parts, F.lit(k), size), lambda a, b: F.concat_ws(" ", a, b))
        out.append(longest)
    return F.concat(*out)


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def console_safe(c: Column, limit: int | None = None) -> Column:
    """Text that any console shows: other characters than ASCII as question marks, shortened if asked."""
    safe = F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return safe if limit is None else shorten(safe, limit)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(w), F.lit(False))
    return out


def sentence_case(c: Column) -> Column:
    """Underscores as spaces, the first letter large, the others small."""
    spaced = F.regexp_replace(c, "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
