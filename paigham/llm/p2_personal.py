"""Problem 2: personal information in free text.

Patterns find candidates, validators keep those that have the form of the kind; each is replaced by
a placeholder that names its kind. Phone and identity numbers and dates keep their format: their
digits are permuted within the format by a keyed Feistel network, so equal values get equal
pseudonyms in every document, whatever separators they are written with, and no value can be read
off its pseudonym without the key. Phone numbers of the country are first brought to their national
form. Addresses, e-mail addresses and names get a keyed tag of 64 bits. The key comes from the configuration.

Look-alike, full-width and invisible characters are seen through: patterns run on a folded view
whose positions lead back to the text, and only the item itself is replaced.

Defined results: null stays null; texts without an item come out unchanged; very long texts are
read whole; repeated rows come out alike; columns other than ``row_id`` and ``msg`` are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from calendar import monthrange
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paigham.llm.p1_lookalike import TABLE
from paigham.storage import spread

#: The setting that names the key; where it is unset the session draws one, and pseudonyms link within the session only.
KEY_SETTING = "spark.paigham.pseudonym.key"
_drawn: dict[str, str] = {}
KINDS = ("email", "phone", "identity", "address", "name")

# ---------------------------------------------------------------- folded view


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text with plain letters, and for each of its characters the place in the text (None: the same)."""
    if text.isascii():
        return text, None
    out, places = [], []
    for i, c in enumerate(text):
        for x in TABLE.get(ord(c), c):
            out.append(x)
            places.append(i)
    places.append(len(text))
    return "".join(out), places


# ---------------------------------------------------------------- pseudonyms


def feistel(digits: str, key: bytes, tweak: str, rounds: int = 8) -> str:
    """A keyed permutation of the digit strings of this length (two or more digits)."""
    n = len(digits)
    u = n // 2
    a, b = digits[:u], digits[u:]
    for r in range(rounds):
        m = len(a)
        f = hmac.new(key, f"{tweak}|{n}|{r}|{b}".encode(), hashlib.sha256).digest()
        a, b = b, str((int(a) + int.from_bytes(f[:12], "big")) % 10**m).zfill(m)
    return a + b


def unfeistel(digits: str, key: bytes, tweak: str, rounds: int = 8) -> str:
    """The inverse of :func:`feistel`."""
    n = len(digits)
    u = n // 2 if rounds % 2 == 0 else n - n // 2
    a, b = digits[:u], digits[u:]
    for r in reversed(range(rounds)):
        m = len(b)
        f = hmac.new(key, f"{tweak}|{n}|{r}|{a}".encode(), hashlib.sha256).digest()
        a, b = str((int(b) - int.from_bytes(f[:12], "big")) % 10**m).zfill(m), a
    return a + b


def tag(kind: str, value: str, key: bytes) -> str:
    return hmac.new(key, f"{kind}|{value}".encode(), hashlib.sha256).hexdigest()[:16]


# ---------------------------------------------------------------- patterns

GAP = r"[\s.\-]{0,4}"
EMAIL = re.compile(
    r"(?<![\w.+-])[a-z0-9](?:[\w.+-]*[a-z0-9])?\s{0,3}(?:@|\(\s?at\s?\)|\[\s?at\s?\]|\sat\s(?=\s*[a-z0-9-]+\s+dot\s))\s{0,3}"
    r"[a-z0-9-]+(?:(?:\.|\s+dot\s+|\s?\(\s?dot\s?\)\s?|\s?\[\s?dot\s?\]\s?)[a-z0-9-]+)+",
    re.I,
)
URL = re.compile(r"(?:https?://|www\.)\S+|(?<![@\w.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:example|test|invalid|com|org|net|pk|info|xyz)\b(?:/\S*)?", re.I)
#: Subscriber numbers: national mobiles and landlines, and full international numbers.
PHONE = re.compile(
    r"(?<![\w*#+.\-/])(?:"
    rf"(?:\+{GAP}92|0092|92|0){GAP}\(?3\d\d\)?{GAP}\d{{3}}{GAP}\d{{4}}"
    rf"|\(\s?03\d\d\s?\){GAP}\d{{3}}{GAP}\d{{4}}"
    r"|(?:\+92|0092|0)[\s-]?(?:21|42|51|22|41|61|71|81|91)[\s-]?\d{7,8}"
    r"|\+\d{1,3}[\s.-]{0,4}(?:\(\d{2,5}\)|\d{2,5})(?:[\s.-]{0,4}\d{2,6}){1,4}"
    r")(?![\w*#])(?!-\d)"
)
NATIONAL_ID = re.compile(r"(?<![\w+\-.])\d{5}[\s.\-]{0,3}\d{7}[\s.\-]{0,3}\d(?![\w\-])(?!\.\d)")
#: What a run of 13 digits is called when it is something else.
NOT_ID = re.compile(r"(?:order|tracking|track|tid|trx|txn|transaction|ref|reference|slip|bill|voucher|invoice|raseed|parcel|file|token|ticket|case|consignment|iban|account|a/c)\W{0,3}(?:no|number|id|#)?\W{0,3}$", re.I)
PASSPORT = re.compile(r"\bpassport\b(?:\s*(?:no|number|#|num)\b\.?)?\s*[:#-]?\s*([a-z]{2}\s?-?\d{7})(?!\w)", re.I)
#: Numbers in another country's groups of three, three and four, and ten digits after a word that calls for a number.
GROUPED = re.compile(r"(?<![\w*#+.\-/])(?:\([2-9]\d\d\)\s?|[2-9]\d\d[-.\s])\d{3}[-.]\d{4}(?![\w*#])(?!-\d)")
CALLED = re.compile(r"\b(?:call|phone|tel|telephone|mobile|cell)\b[:.]?\s+(?:me\s+|us\s+)?(?:at\s+|on\s+)?([2-9]\d{9})(?![\w*#-])", re.I)
STREET = r"(?:road|street|avenue|lane|boulevard|highway|bazaar|colony)"
UNIT = r"(?:house|makan|ghar|flat|plot|quarter|apartment|apt|building|bungalow|villa|kothi)"
PLACE = r"[a-z؀-ۿ][\w-]*"
ADDRESS = re.compile(
    rf"\b(?:{UNIT}[\"'*]?(?:\s*(?:no\b\.?|number\b|nambar\b|#))?\s*[:#]?\s*\d{{1,4}}(?:\s?[-/]?\s?[a-z])?\b|h\s?#\s?\d{{1,4}}(?:-?[a-z])?\b)"
    rf"(?:[\s,;.!]{{1,4}}(?:(?:gali|street|st|sector|block|phase|mohalla|lane|road)\s?(?:no\b\.?|#)?\s?[a-z]?-?\d{{1,3}}\b|mohalla\s+{PLACE}|{PLACE}\s+(?:colony|heights|towers?|apartments?|plaza|society|town)\b|\d{{1,4}}(?:/[a-z])?\s+{PLACE}\s+{STREET}\b))+"
    rf"(?:[,;]\s*{PLACE}(?:garh|garhi|mandi|wali|darra|nagri|abara|sarai|kalan|dhoro|khurd|talwar|purwal|abad|pur|kot)\b)?"
    rf"|(?<![\w.,/-])\d{{1,4}}(?:\s?/\s?[a-z])?\s+{PLACE}\s+{STREET}\b(?:[,;]?\s+near\s+{PLACE}\s+(?:chowk|masjid|park|school|hospital)\b)?"
    rf"(?:[,;]\s*{PLACE}(?:garh|garhi|mandi|wali|darra|nagri|abara|sarai|kalan|dhoro|khurd|talwar|purwal|abad|pur|kot)\b)?",
    re.I,
)
BARE_UNIT = re.compile(rf"\b(?:{UNIT}[\"'*]?(?:\s*(?:no\b\.?|number\b|nambar\b|#))|house|flat|plot|quarter|h\s?#)\s*[:#]?\s*\d{{1,4}}(?:\s?[-/]\s?[a-z]|[a-z])?\b", re.I)
#: A number, a name of one or two words with a capital, and a further word for a street.
WRITTEN_STREET = re.compile(r"(?<![\w.,/-])\d{1,4}[A-Za-z]?\s+(?:[A-Z][a-z]+\s+){1,2}(?:Close|Crescent|Terrace|Court|Drive|Square|Way|Grove|Gardens|Rd|Ave|Ln|Blvd)\b\.?(?:,\s+[A-Z][a-z]+\b)?")
#: Dates, whose digits are permuted too; a date is none of the five kinds and keeps its looks.
DATE = re.compile(r"(?<![\w./-])(?:(?:0?[1-9]|[12]\d|3[01])([/-])(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d|(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))(?![\w/-])")

# Names: what stands before or after them tells them from shops, companies and places.
PERSON = r"[^\W\d_]{2,20}(?:\s+[^\W\d_]{2,20})?"
FRAMES = re.compile(
    rf"\b(?:janab|muhtaram|jenab)\s+(?P<a>{PERSON}?)\s+sahib\b"
    rf"|\bmain\s+(?P<b>{PERSON}?)\s+bol\s+rah[ai]\b"
    rf"|\bsalam\s+(?P<c>{PERSON}?)\s+(?:bhai|baji|sahib|api)\b"
    rf"|\bparson\s+(?P<d>{PERSON}?)\s+aur\s+main\b"
    rf"|\b(?:mr|mrs|ms|miss)\.?\s+(?P<e>{PERSON}?)\s+(?:ke\s+naam|ko\b|se\b|ne\b|ki\b|ka\b)"
    rf"|(?:^|(?<=[.,!?;|>*\[\(\n\-\x00\x01]))\s*(?P<f>{PERSON}?)\s+(?:ne\s+bheja\s+hai|ko\s+bukhar\s+hai|ka\s+bet[ai]\s+school|ki\s+beti\s+school)\b"
    rf"|\b(?:(?:naam|name)\s*[:=]|account\s+title\s*[:=]?)\s*(?P<g>{PERSON})"
    rf"|\b(?:my|mera|meri)\s+(?:name|naam)\s+(?:is\s+)?(?P<i>{PERSON})"
    rf"|\b(?:dear|shukriya|mr|mrs|ms|miss|janab)\.?\s+(?P<h>{PERSON})",
    re.I,
)
#: One of these words stands in every frame, and in every address; looked up before the patterns run.
FRAME_WORDS = frozenset("janab jenab muhtaram main salam parson mr mrs ms miss dear shukriya naam name account bheja bukhar school".split())
ADDRESS_WORDS = frozenset("house makan ghar flat plot quarter apartment apt building bungalow villa kothi h road street avenue lane boulevard highway bazaar colony".split())
WORDS = re.compile(r"[a-z]+")
#: Second words of shops, companies and places, and words that are no names.
NO_PERSON = frozenset(
    "foods mart sweets bakers clinic traders tools printers fabrics motors electronics academy store pharmacy bank wallet telecom finance insurance exchange courier "
    "microbank foundation power gas cell company shop dukan branch office counter customs helpline user users customer customers sir madam member members client sahib bhai "
    "shukriya salam dear job offer aap ka ki ke ko se ne par hai mein aur main bijli meeting exam class safar dukan raseed slip bill ref file code link visit click "
    "tracking voucher shanakht order pata parcel call helpline whatsapp rabta jawab write farm inspection cheezein ghar darkhast kal parson aaj imdadi khana security urgent "
    "mubarak naam title account id card cnic khushkhabri final notice zaroori congratulations street house email alerts sms ph rider mera apna apni hum wapsi http https www "
    "abbu ammi behn dost driver chacha mamu khala phuphi nani dada dadi padosi manager ustad chowkidar qurandazi doctor bhejain karein wapas ok okay team fwd all everyone intezar bilkul ji jee acha theek bohat bahut phir sab note abhi warna khabardar".split()
)
LAST_ONLY = frozenset("foods mart sweets bakers clinic traders tools printers fabrics motors electronics academy store pharmacy bank wallet telecom finance insurance exchange courier microbank foundation power gas cell branch".split())


def persons(text: str, given: frozenset[str], seen: set[str]) -> Iterator[tuple[int, int]]:
    """Spans of names in a text whose e-mail addresses and links are blanked."""
    for m in FRAMES.finditer(text) if not FRAME_WORDS.isdisjoint(seen) else ():
        kind = m.lastgroup
        start, end = m.span(kind)
        tokens = [(start + x.start(), start + x.end(), x[0].lower()) for x in re.finditer(r"[^\W\d_]+", text[start:end])]
        if not tokens or tokens[0][2] in NO_PERSON:
            continue
        open_ended = kind in "ghi"
        if not open_ended:
            if any(t[2] in NO_PERSON for t in tokens):
                continue
            yield start, end
            continue
        rest = re.match(r"\s+([^\W\d_]+)(?:\s+([^\W\d_]+))?", text[end:])
        after = [x.lower() for x in (rest.groups() if rest else ()) if x]
        if len(tokens) == 2:
            if tokens[1][2] in LAST_ONLY or (after and after[0] in LAST_ONLY):
                if tokens[0][2] in given and after and after[0] in LAST_ONLY and kind == "g":
                    yield tokens[0][0], tokens[0][1]
                elif tokens[0][2] in given and len(after) > 1 and after[0] in LAST_ONLY and after[1] in LAST_ONLY:
                    yield tokens[0][0], tokens[0][1]
                continue
            stops = re.match(r"\s*(?:$|[.,!?;|\n*\]\)\-–\x00\x01])", text[end:])
            family = tokens[1][2] not in NO_PERSON
            if tokens[0][2] in given or stops or kind in "gi":
                yield start, (end if family else tokens[0][1])
            elif family and re.search(r"(?:ani|ari|ozi|azi|oni|uvi|ari|ozai|azai|mani|uli|eri|tuni|hani|rani|vani|ashi|ondi|khari)$", tokens[1][2]):
                yield start, end
        elif after and after[0] in LAST_ONLY:
            continue
        elif tokens[0][2] in given or re.match(r"\s*(?:$|[.,!?;|\n*\]\)\-–\x00\x01])", text[end:]):
            yield start, end
    if not given.isdisjoint(seen):
        for m in re.finditer(r"[^\W\d_]+", text):
            if m[0].lower() in given:
                rest = re.match(r"\s+([^\W\d_]+)(?:\s+([^\W\d_]+))?", text[m.end() :])
                after = [x.lower() for x in (rest.groups() if rest else ()) if x]
                before = re.search(r"([^\W\d_]+)\s+$", text[: m.start()])
                if any(x in LAST_ONLY for x in after) or (before and before[1].lower() in {"dukan", "shop"}):
                    continue
                family = after and after[0] not in NO_PERSON and re.search(r"(?:i|a)$", after[0]) and len(after[0]) > 4
                end = m.end() + (rest.end(1) if family else 0)
                yield m.start(), end


def national(digits: str, plus: bool) -> str:
    """One form for a number of the country, however its prefix is written: mobiles and landlines start with 0."""
    if digits.startswith("0092"):
        return "0" + digits[4:]
    if digits.startswith("92") and (plus or len(digits) == 12):
        return "0" + digits[2:]
    return digits


def luhn_free_identity(digits: str) -> bool:
    """National id numbers: 13 digits that do not start with 0 and are not all alike."""
    return digits[0] != "0" and len(set(digits)) > 2


def items(text: str, given: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the items in ``text``, without overlaps, in order."""
    view, places = folded(text)
    taken: list[tuple[int, int, str, str]] = []
    blank = list(view)
    seen = set(WORDS.findall(view.lower()))

    def take(start: int, end: int, kind: str, value: str) -> None:
        taken.append((start, end, kind, value))
        blank[start:end] = "\x00" * (end - start)

    if "@" in view or re.search(r"\bdot\b|[(\[]\s?at\s?[)\]]", view, re.I):
        for m in EMAIL.finditer(view):
            domain = re.split(r"@|\bat\b", m[0], flags=re.I)[-1]
            last = re.split(r"\.|\bdot\b", domain, flags=re.I)[-1].strip(" )](").lower()
            if last.isalpha() and len(last) >= 2:
                take(*m.span(), "email", re.sub(r"\s+", "", re.sub(r"\s*[\[(]?\bat\b[\])]?\s*", "@", re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", m[0].lower()))))
    rest = "".join(blank)
    for m in URL.finditer(rest):
        blank[m.start() : m.end()] = "\x01" * (m.end() - m.start())
    rest = "".join(blank)
    if re.search(r"\d", rest):
        for m in NATIONAL_ID.finditer(rest):
            digits = re.sub(r"\D", "", m[0])
            if luhn_free_identity(digits) and not NOT_ID.search(rest[max(0, m.start() - 30) : m.start()]):
                take(*m.span(), "identity", digits)
        for m in PASSPORT.finditer(rest):
            take(*m.span(1), "identity", re.sub(r"[\s-]", "", m[1]).upper())
        rest = "".join(blank)
        for m in PHONE.finditer(rest):
            digits = re.sub(r"\D", "", m[0])
            if 9 <= len(digits) <= 15 and not NOT_ID.search(rest[max(0, m.start() - 30) : m.start()]):
                take(*m.span(), "phone", national(digits, "+" in m[0]))
        rest = "".join(blank)
        for pattern, group in ((GROUPED, 0), (CALLED, 1)):
            for m in pattern.finditer(rest):
                if not NOT_ID.search(rest[max(0, m.start() - 30) : m.start()]):
                    take(*m.span(group), "phone", re.sub(r"\D", "", m[group]))
        rest = "".join(blank)
        for m in DATE.finditer(rest):
            take(*m.span(), "date", m[0])
        for m in WRITTEN_STREET.finditer("".join(blank)):
            take(*m.span(), "address", re.sub(r"\W+", " ", m[0].lower()).strip())
        for pattern in (ADDRESS, BARE_UNIT) if not ADDRESS_WORDS.isdisjoint(seen) else ():
            for m in pattern.finditer("".join(blank)):
                take(*m.span(), "address", re.sub(r"\W+", " ", m[0].lower()).strip())
    for start, end in persons("".join(blank), given, seen):
        if "\x00" not in "".join(blank[start:end]):
            take(start, end, "name", " ".join(view[start:end].lower().split()))
    taken.sort()
    if places is None:
        return taken
    return [(places[s], places[e - 1] + 1, kind, value) for s, e, kind, value in taken]


def placeholder(kind: str, value: str, written: str, key: bytes) -> str:
    """What an item is replaced by."""
    if kind == "date":
        parts = re.split(r"([/-])", value)
        at = 0 if len(parts[0]) == 4 else 4
        day, month = (4, 2) if at == 0 else (0, 2)
        year = int(parts[at])
        exists = lambda n: n % 31 < monthrange(year, n // 31 + 1)[1]
        start = number = (int(parts[month]) - 1) * 31 + int(parts[day]) - 1
        while True:  # cycle walking keeps the permutation within the days of the year; days that do not exist are permuted among themselves
            number = int(feistel(f"{number:03d}", key, "date"))
            if number < 372 and exists(number) == exists(start):
                break
        # Places without a leading zero stay without one where the value has one digit.
        bare = {p for p in (day, month) if len(parts[p]) == 1}
        for p, v in ((day, number % 31 + 1), (month, number // 31 + 1)):
            parts[p] = f"{v}" if p in bare else f"{v:02d}"
        return "".join(parts)
    if kind == "identity" and not value.isdigit():
        return f"[IDENTITY:{value[:2]}{feistel(value[2:], key, 'passport')}]"
    if kind in ("phone", "identity"):
        keep = (2 if value.startswith("03") else 1 if value.startswith("0") else 0) if kind == "phone" else 0
        digits = value[:keep] + feistel(value[keep:], key, kind)
        if kind == "identity":
            digits = f"{digits[:5]}-{digits[5:12]}-{digits[12]}"
        return f"[{kind.upper()}:{digits}]"
    return f"[{kind.upper()}:{tag(kind, value, key)}]"


def redact(text: str, key: bytes, given: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The text with placeholders, and the kinds found."""
    out, at, kinds = [], 0, []
    for start, end, kind, value in items(text, given):
        if start < at:
            continue
        out += [text[at:start], placeholder(kind, value, text[start:end], key)]
        at = end
        if kind in KINDS:
            kinds.append(kind)
    return "".join(out) + text[at:], kinds


# ---------------------------------------------------------------- operator


def given_names(df: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The list of given names: a small fixed table, whose size is checked."""
    rows = [r[0] for r in df.select("given_name").where("given_name is not null").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} given names: not a list to send to every task")
    return frozenset(x.strip().lower() for x in rows if x.strip())


def configured_key(spark: SparkSession) -> str:
    """The key of the session's configuration, else one drawn for the session."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def redacted(df: DataFrame, names: frozenset[str] = frozenset(), key: str | None = None) -> DataFrame:
    """``(row_id, redacted, kinds)`` of all rows; one narrow pass, nothing is shuffled."""
    secret = (key or configured_key(df.sparkSession)).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for msg in batch.column("msg").to_pylist():
                text, found = (None, []) if msg is None else redact(msg, secret, names)
                texts.append(text)
                kinds.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["row_id", "redacted", "kinds"])

    return spread(df.select("row_id", "msg")).mapInArrow(run, "row_id bigint, redacted string, kinds array<string>")


def found(df: DataFrame, names: frozenset[str] = frozenset(), key: str | None = None) -> DataFrame:
    """``(row_id, kind)``: the kinds of items each row holds."""
    return redacted(df, names, key).select("row_id", F.explode("kinds").alias("kind"))
