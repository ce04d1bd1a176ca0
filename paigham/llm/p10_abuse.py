"""Problem 10: abusive, hateful or sexual language, by weak supervision.

Voters - lexicons and patterns, some for and some against - vote on each sentence. A generative
label model estimates by EM how often each voter votes, and keeps silent, on abusive and on other
sentences, without labels; voters that agree more than their accuracies explain are correlated, and their
evidence is shared out. What is believed of the voters beforehand weighs as much as ``BELIEF`` sentences,
so the votes of a corpus overrule it. The posteriors train a linear classifier on hashed words and pairs
of words - it does not see the votes - which scores every sentence; a document's score is that of its worst sentence.

Only vote patterns and their counts go to the driver (at most 3 to the number of voters), and at
most ``SAMPLE`` sentences to fit the classifier; votes and scores cover all documents.

Disguised spellings (``t.r.a.s.h``, ``k33r@y``, ``l***r``, stretched letters) are undone before voting.

Defined results: null, empty and blank texts score 0; repeated documents score alike; very long
texts are read whole; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import has_text
from paigham.llm.p1_lookalike import TABLE, by_table
from paigham.storage import cut, spread

SAMPLE = 40_000
DIMENSIONS = 1 << 16
THRESHOLD = 0.5
#: Sentences of each side that the belief about a voter weighs as much as.
BELIEF = 30.0
#: How much a voter's silence says of what it would if its words were all there are.
SILENCE = 0.5
#: Of the sample, shares of sentences voted for and against, voted for only, held to be mentions or blame of oneself, and others.
PARTS = (1 / 8, 3 / 8, 1 / 8, 3 / 8)

# ---------------------------------------------------------------- lexicons

INSULTS = frozenset(
    "idiot moron imbecile loser scumbag jackass bastard bitch pig parasite liar swine scum vermin coward clown fool dumbass asshole retard cunt whore slut dickhead "
    "douchebag tosser bellend shithead arsehole motherfucker bastards bitches morons idiots imbeciles scumbags dumbasses assholes retards cunts cretins degenerates lowlifes perverts crackhead numbskull blockhead simpleton "
    "dimwit halfwit cretin weasel maggot cockroach leech degenerate lowlife wretch garbage trash filth dunce nitwit pervert prick twat wanker "
    "kutta kutte kutti kameena kamina kamine kameene kamini harami haramkhor haramzada suar soor gadha gadhe ullu bewaqoof zaleel lanati laanti kanjar beghairat bhains chutiya gandu "
    "randi badzaat ghatiya badtameez nalaiq jahil bandar khabees dalla bhenchod madarchod".split()
)
SEXUAL = frozenset(
    "sex fuck fucking fucked nude nudes naked horny moan moaning strip stripping slut breasts breast boobs bra panties porn pornography xxx blowjob orgasm erotic cock dick pussy cum tits "
    "nangi nange nanga jism sexy chudai lund randi garam bistar".split()
)
DEHUMANIZING = frozenset("vermin filth animals cockroaches rats parasites scum pests disease keeray makoray breed nasl subhuman savages".split())
#: What a disguised token may be.
DISGUISED = sorted(INSULTS | SEXUAL | DEHUMANIZING | {"shit", "whores", "sluts"})

INSULT_URDU = re.compile(r"\bذلیل\b|\bکتے\b|\bکتا\b|\bکمین[ےہا]\b|حرام ?خور|حرام ?زاد|لعنتی|سور کی|گدھے|الو کے|بے ?غیرت|کنجر")
THREAT_URDU = re.compile("ہڈیاں توڑ|ڈوب مرو|مار ڈال|مار دوں|جان سے مار|زندہ نہیں چھوڑ|مر جا|قتل کر دوں")
SEXUAL_URDU = re.compile("ننگی|ننگا|بستر میں|کپڑے اتار|جسم دکھا|فحش")
HATE_URDU = re.compile("(?:نسل|قوم)(?: ہی)? (?:گندی|غلیظ|ذلیل)|(?:گندی|غلیظ|ناپاک) (?:نسل|قوم)|مٹا دو|کیڑے مکوڑے|نفرت فرض|وجود مٹا")

DIRECTED = re.compile(r"\b(?:you|your|yours|u|ur|tu|tum|tera|teri|tere|tujhe|tumhara|tumhari|tumhare|oye|listen|aulad|khandan|shut up|chup kar|what an?|only an? \w+ types|such an?|like that|crawl back|go and rot|laanat|qism ki|shakal)\b|تم |تیر[یا]|تجھے")
THREAT = re.compile(
    r"\b(?:i|we)(?: will|'ll| am going to| would)? (?:\w+ ){0,4}(?:kill|beat|break|cut|stab|shoot|burn|smash|hurt|find)(?: \w+){0,5} (?:you|your|bloody)\b"
    r"|\b(?:break|smash|crack) (?:your|ur) (?:\w+ )?(?:teeth|bones|legs|face|neck|skull|head|jaw)\b|\bdrop dead\b|\b(?:hang|kill|drown|shoot) (?:yourself|urself)\b|\bgo (?:and )?(?:die|rot)\b"
    r"|\bchoke on your\b|\bhope you (?:die|rot|choke|burn|suffer)\b|\bcut you (?:open|up)\b|\bwith a knife\b|\bbeat you\b|\bnobody wants (?:\w+ ){0,5}alive\b|\bburn (?:\w+ ){1,3}down\b"
    r"|\bmunh tod\b|\bhaddi\w* tod|\bzinda nahi ch?h?or\w*|\bjaan se maar|\bmar ja\b|\bdoob mar\w*|\bjoote mar\w*|\bgala (?:ghont|kaat)|\bgoli maar"
)
GROUP_HATE = re.compile(
    r"\b(?:wipe them out|driven out|drive them out|back in a coffin|get rid of them|born to steal|breathe our air|waste our air|burn their|exterminate|clean until|send (?:them|every \w+) back|keep them locked|lock them up"
    r"|paida hota hai|nafrat farz|nasl hi|wajood mita|nikal phenko|inhen (?:maar|nikal|khatam)|in se nafrat|whole breed|too stupid to|are vermin|are filth|are animals|are cockroaches|never trust an? \w+ that|no \w+ deserves)\b"
)
SOLICIT = re.compile(
    r"\b(?:send (?:me )?your (?:\w+ )?(?:nude|naked|pictures)|see you naked|in (?:my|your) bed|touch yourself|take off your|wet and waiting|ride me|come over|hotel room|paid sex|no clothes|adults only|link inside|reply now|video call|uncut|full sex|hot xxx|tonight"
    r"|tasveer bhejo|kapray utar|jism dikhao|bistar mein|garam videos|would do with my tongue|thinking of your (?:breasts|body|lips))\b"
)
EVERYDAY_WORDS = frozenset(
    "wire wires process app crash crashing eggs sugar sauce recipe crop price prices mango buses strike lift ticket bins postman parcel farm office screening health advice age blood form "
    "gari dukan sale saman lineman meter battery cricket exam bill slip receipt bank account balance branch fee shop order customs helpline safar meeting class raseed".split()
)
EVERYDAY = re.compile(r"\b(?:gali mein|rider wapas|dog bit|cold killed|farm smells|clinic offers)\b|رسید|دفتر|بجلی|کتاب|قسط|درخواست|ہسپتال")
MENTION = re.compile(r"\b(?:poster says|sign says|no nudity|no insults|workshop|awareness|seminar|training|helpline now|records abusive|abusive calls|two warnings|was fined|does not repeat|hate speech|harassment|reported that|notice (?:says|does)|community centre|neighbours cooked|welcomes everyone|he joked|policy|moderat\w+)\b")
SELF = re.compile(r"\bi (?:was|am|felt like|feel like|have been) (?:such )?(?:an? |so )?\w+\b|\bmyself\b|\blesson learned\b|\bmy own fault\b|\bmain (?:hi )?(?:bewaqoof|gadha|ullu)\b")

#: Contempt for the reader in words that alone say nothing of a person.
CONTEMPT = re.compile(
    r"\b(?:you|ur|u)(?:'re| are| were| r)? (?:(?:such|just|so|all|an?|the|really|nothing but|as|too|and|\w+ly) ){0,3}(?:\w+ (?:and )?)?(?:stupid|worthless|pathetic|disgusting|useless|brainless|shameless|spineless|filthy|ugly|dumb|idiotic|moronic|vile|repulsive|despicable|miserable)\b"
    r"|\byour (?:stupid|worthless|pathetic|disgusting|filthy|ugly|dumb|vile|miserable) (?:\w+ )?(?:face|head|mouth|self|family|mother|kind|people|life|brain)\b"
)
CURSE = re.compile(
    r"\b(?:burn|rot|go(?: straight)?) (?:in|to) hell\b|\b(?:screw|damn|curse|fuck) you\b|\bfuck off\b|\bi(?:'ll| will| am going to| swear i will) (?:end|finish|destroy|ruin|bury) you\b|\bwatch your back\b"
    r"|\byou(?:'re| are) (?:a )?dead(?: man| meat)?$|\byou(?:'ll| will)(?: all)? (?:pay for|regret|suffer)\b|\bmake you (?:pay|suffer|regret)\b"
)
EXCLUSION = re.compile(
    r"\bgo back to (?:your|where you|where they|their)\b|\bdo(?:es)?(?: not|n't) belong (?:here|in (?:this|our))\b|\b(?:all|those|these|every) (?:of )?(?:them|\w+s) (?:are|is) (?:all )?(?:thieves|criminals|terrorists|rapists|murderers|liars)\b"
    r"|\bshould (?:all )?be (?:shot|hanged|killed|deported|gassed|burned)\b|\bdeserves? to (?:die|be (?:shot|hanged|killed|burned))\b"
)

#: Of each lexicon or pattern what some word must hold, or it cannot match: one entry at least for every alternative.
WHOLE = r"(?:^|\W)(?:{})(?:\W|$)"
GATES = tuple(
    re.compile(x)
    for x in (
        WHOLE.format("wipe|driven|drive|coffin|rid|born|breathe|waste|burn|exterminate|clean|send|locked|lock|paida|nafrat|nasl|wajood|nikal|inhen|breed|stupid|vermin|filth|animals|cockroaches|trust|deserves"),
        r"^(?:kill|beat|break|cut|stab|shoot|burn|smash|hurt|find)$|(?:break|smash|crack)$|^dead|urself|yourself|^(?:die|rot)|(?:choke|hope|cut|beat|burn|nobody|zinda|doob|joote|gala|goli|mar)$|^knife|^tod|^maar|haddi",
        WHOLE.format(r"poster|sign|nudity|insults|workshop|awareness|seminar|training|helpline|abusive|warnings|fined|repeat|speech|harassment|reported|notice|centre|neighbours|everyone|joked|policy|moderat\w+"),
        r"(?:^|\W)i$|myself|lesson$|^own|main$",
        r"gali$|rider$|dog$|cold$|^smells|^offers",
        WHOLE.format("stupid|worthless|pathetic|disgusting|useless|brainless|shameless|spineless|filthy|ugly|dumb|idiotic|moronic|vile|repulsive|despicable|miserable"),
        WHOLE.format("hell|screw|damn|curse|fuck|end|finish|destroy|ruin|bury|back|dead|pay|regret|suffer"),
        WHOLE.format("back|belong|thieves|criminals|terrorists|rapists|murderers|liars|shot|hanged|killed|deported|gassed|burned|die"),
    )
)
ANY_GATE = re.compile("|".join(f"(?:{g.pattern})" for g in GATES))
#: Of each word seen the gates it opens; those that open none.
_opened: dict[str, int] = {}
_closed: set[str] = set()


def _open(words: set[str]) -> int:
    """The gates that the words open, as bits."""
    out = 0
    for w in words - _closed:
        bits = _opened.get(w)
        if bits is None:
            if len(_opened) + len(_closed) > MOST_TOKENS:
                _opened.clear()
                _closed.clear()
            bits = (sum(1 << k for k, g in enumerate(GATES) if g.search(w)) if ANY_GATE.search(w) else 0) | sum(1 << len(GATES) + k for k, words in enumerate((INSULTS, SEXUAL, DEHUMANIZING)) if w in words)
            if not bits:
                _closed.add(w)
                continue
            _opened[w] = bits
        out |= bits
    return out


VOTERS = ("insult", "directed insult", "threat", "hate", "sexual", "soliciting", "dehumanizing", "everyday", "mention", "self", "contempt", "curse", "exclusion")
AGAINST = (7, 8, 9)
MENTIONS = slice(8, 10)
#: Kinds of abuse, and the voters that are for them.
KINDS = ((0, 1, 10, 11), (2, 11), (3, 6, 12), (4, 5))
#: How often each voter is believed to vote on sentences of the other side: words alone slip more than phrases.
SLIPS = (0.003, 0.002, 0.0003, 0.0003, 0.002, 0.0005, 0.002, 0.005, 0.005, 0.0003, 0.0005, 0.0003, 0.0003)

# ---------------------------------------------------------------- disguises

SPACED = re.compile(r"(?<![\w])(?:[^\W\d_]([ .\-_*]))(?:[^\W\d_]\1){1,}[^\W\d_](?![\w])")
STRETCHED = re.compile(r"(\w)\1{2,}")
LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"})
TOKENS = re.compile(r"[\w@$*#!']+")
#: The same for ASCII texts: every other character becomes a space.
GAPS = bytes(c if c < 128 and TOKENS.match(chr(c)) else 32 for c in range(256))
MASKED = re.compile(r"[*#_]")
_BY_SIZE: dict[int, list[str]] = {}
for _w in DISGUISED:
    _BY_SIZE.setdefault(len(_w), []).append(_w)
KNOWN = frozenset(DISGUISED)


def _plain_token(token: str) -> str:
    if token in KNOWN:
        return token
    if MASKED.search(token) and any(c.isalpha() for c in token):
        bare = token.strip("!'")
        shape = re.compile("".join("." if c in "*#_" else re.escape(c) for c in bare.translate(LEET)))
        hits = [w for w in _BY_SIZE.get(len(bare), ()) if shape.fullmatch(w)]
        if hits:
            return hits[0]
    out = token
    if any(c in "@$0134578!" for c in token) and sum(c.isalpha() for c in token) * 3 >= len(token.strip("!")):
        leet = token.rstrip("!").translate(LEET)
        for x in (leet, leet.replace("v", "u"), token.rstrip("!").replace("1", "l").translate(LEET)):
            if x in KNOWN:
                return x
    if STRETCHED.search(out):
        once, twice = STRETCHED.sub(r"\1", out), STRETCHED.sub(r"\1\1", out)
        for x in (once, twice):
            if x in KNOWN:
                return x
        out = once if out != "xxx" else out
    if "v" in out and out.replace("v", "u") in KNOWN:
        return out.replace("v", "u")
    return out


#: Characters by_table changes.
ODD = re.compile("[" + "".join(map(chr, TABLE)) + chr(0x300) + "-" + chr(0x36F) + chr(0x653) + "-" + chr(0x655) + "]")
MOST_TOKENS = 300_000


class Kept(dict):
    """What a function gives, kept for the next time; emptied when it has become large."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) > MOST_TOKENS:
            self.clear()
        out = self[key] = self.function(key)
        return out


def _word(token: str) -> str:
    """The plain form of a token if it is a word of two letters at least."""
    word = _plain_token(token)
    return word if len(word) > 1 and word.isalpha() else ""


_tokens, _words = Kept(_plain_token), Kept(_word)


def _raw_tokens(sentence: str) -> list[str]:
    low = (by_table(sentence) if not sentence.isascii() and ODD.search(sentence) else sentence).lower()
    found = low.encode().translate(GAPS).decode().split() if low.isascii() else TOKENS.findall(low)
    if "_" in low or "*" in low or list(map(len, found)).count(1) > 2:
        found = TOKENS.findall(SPACED.sub(lambda m: m[0][::2], low))
    return found


def plain_tokens(sentence: str) -> list[str]:
    """The lower-cased words, with disguises undone."""
    return list(map(_tokens.__getitem__, _raw_tokens(sentence)))


def plain(sentence: str) -> str:
    return " ".join(plain_tokens(sentence))


#: White space beyond the plain one, as the engine's words know it.
OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
ENDS = (". ", "! ", "? ", "۔ ", "؟ ")
LINES = frozenset(map(chr, (0x0D, 0x85, 0x2028, 0x2029)))
SPEAKER = re.compile(r"(?:[AB]|\w{1,12}):\s")


def sentences(text: str) -> list[str]:
    """Sentences; a text without marks is one."""
    text = OTHER_SPACE.sub(lambda m: "\n" if m[0] in LINES else " ", text.replace("\t", " ")).replace(" - ", "\n")
    for end in ENDS:
        if end in text:
            text = text.replace(end, end[0] + "\n")
    out = []
    for s in text.split("\n"):
        s = s.strip()
        m = SPEAKER.match(s) if ":" in s else None
        if m:
            s = s[m.end() :]
        if s:
            out.append(s)
    return out


def votes(tokens: list[str], urdu: bool | None = None) -> str:
    """One character per voter on a sentence of plain tokens: 1 for abusive, 0 for not, - for no vote."""
    seen = set(tokens)
    urdu = not all(map(str.isascii, tokens)) if urdu is None else urdu
    opened = _open(seen)
    if not urdu and not opened:
        return QUIET_PATTERN if EVERYDAY_WORDS.isdisjoint(seen) else QUIET_EVERYDAY
    hate, harm, mention, own, scene, contempt, curse, exclusion, insult, sexual, dehumanizing = (bool(opened >> k & 1) for k in range(len(GATES) + 3))
    everyday = not EVERYDAY_WORDS.isdisjoint(seen)
    sentence = " ".join(tokens)
    v = ["-"] * len(VOTERS)
    if insult or (urdu and INSULT_URDU.search(sentence)):
        v[0] = "1"
        if DIRECTED.search(sentence):
            v[1] = "1"
    if (harm and THREAT.search(sentence)) or (urdu and THREAT_URDU.search(sentence)):
        v[2] = "1"
    if (hate and GROUP_HATE.search(sentence)) or (urdu and HATE_URDU.search(sentence)):
        v[3] = "1"
    if sexual or (urdu and SEXUAL_URDU.search(sentence)):
        v[4] = "1"
        if SOLICIT.search(sentence) or urdu:
            v[5] = "1"
    if dehumanizing:
        v[6] = "1"
    if everyday or ((scene or urdu) and EVERYDAY.search(sentence)):
        v[7] = "0"
    if mention and MENTION.search(sentence):
        v[8] = "0"
    if own and SELF.search(sentence) and "you" not in seen and "your" not in seen:
        v[9] = "0"
    for k, pattern, opens in ((10, CONTEMPT, contempt), (11, CURSE, curse), (12, EXCLUSION, exclusion)):
        if opens and pattern.search(sentence):
            v[k] = "1"
    return "".join(v)


QUIET_PATTERN = "-" * len(VOTERS)
QUIET_EVERYDAY = "".join("0" if v == "everyday" else "-" for v in VOTERS)


# ---------------------------------------------------------------- label model


class LabelModel:
    """Voters' accuracies and correlations from their votes alone.

    The hidden class of a sentence is none or one of the kinds of abuse; a voter's accuracy is how
    much oftener it votes on its side than on the other. A voter that the votes of the others show to
    be worse than chance is held to say nothing.
    """

    def __init__(self, patterns: list[str], counts: np.ndarray, rounds: int = 100, belief: float = BELIEF):
        self.width = len(VOTERS)
        counts = np.asarray(counts, float)
        one = np.eye(3)[self._outcomes(patterns)]  # patterns x voters x outcomes; silence is one of them
        share = np.ones(self.width)
        # Belief: a voter votes on two in five sentences of its kind, on one in ten of other kinds, on others as rarely as SLIPS says.
        prior = np.zeros((1 + len(KINDS), self.width, 3))
        for j in range(self.width):
            if j in AGAINST:
                prior[0, j, 1], prior[1:, j, 1] = 0.2, SLIPS[j]
            else:
                prior[0, j, 2], prior[1:, j, 2] = SLIPS[j], [0.4 if j in own else 0.1 for own in KINDS]
            prior[:, j, 2 if j in AGAINST else 1] = 1e-4
            prior[:, j, 0] = 1 - prior[:, j, 1:].sum(1)
        theta, pi = prior, np.array([1 - 0.01, *[0.01 / len(KINDS)] * len(KINDS)])
        for turn in range(rounds):
            post = self._posterior(one, theta, pi, share)
            weight = post * counts[:, None]
            table = np.einsum("py,pjv->yjv", weight, one)
            theta = (table + prior * belief) / (table.sum(2, keepdims=True) + belief)
            self._no_worse_than_chance(theta, weight.sum(0))
            pi = (weight.sum(0) + 1) / (weight.sum() + len(pi))
            if turn == rounds // 2:
                share = self._shares(one, weight)
        self.theta, self.pi, self.share = theta, pi, share

    @staticmethod
    def _posterior(one: np.ndarray, theta: np.ndarray, pi: np.ndarray, share: np.ndarray) -> np.ndarray:
        score = np.einsum("pjv,yjv,j,v->py", one, np.log(theta), share, [SILENCE, 1.0, 1.0]) + np.log(pi)
        post = np.exp(score - score.max(1, keepdims=True))
        return post / post.sum(1, keepdims=True)

    @staticmethod
    def _no_worse_than_chance(theta: np.ndarray, size: np.ndarray) -> None:
        """Where a voter votes oftener on the other side than on its own, it votes alike on both."""
        for j in range(theta.shape[1]):
            outcome = 1 if j in AGAINST else 2
            kinds = np.array([k + 1 for k, own in enumerate(KINDS) if j in AGAINST or j in own])
            rate = np.average(theta[kinds, j, outcome], weights=size[kinds] + 1e-9)
            if (rate > theta[0, j, outcome]) == (j in AGAINST):
                theta[kinds, j] = theta[0, j]

    @staticmethod
    def _outcomes(patterns: list[str]) -> np.ndarray:
        at = {"-": 0, "0": 1, "1": 2}
        return np.array([[at[c] for c in p] for p in patterns], np.int64).reshape(-1, len(VOTERS))

    def _shares(self, one: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each voter the share of its evidence that voters correlated with it do not give already."""
        voted = 1.0 - one[:, :, 0]
        excess = np.zeros((self.width, self.width))
        for y in range(weight.shape[1]):
            w = weight[:, y] / max(weight[:, y].sum(), 1e-9)
            mean = w @ voted
            both = (voted * w[:, None]).T @ voted
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            excess += np.clip((both - np.outer(mean, mean)) / np.outer(spread, spread), 0, 1) / weight.shape[1]
        np.fill_diagonal(excess, 0)
        side = np.array([j in AGAINST for j in range(self.width)])
        excess[side[:, None] != side[None, :]] = 0
        excess[excess < 0.2] = 0
        self.correlations = excess
        return 1.0 / (1.0 + 0.5 * excess.sum(1))

    def probabilities(self, patterns: list[str]) -> np.ndarray:
        """Of each pattern of votes the probability that the sentence is abusive, of whatever kind."""
        return 1 - self._posterior(np.eye(3)[self._outcomes(patterns)], self.theta, self.pi, self.share)[:, 0]

    def probability(self, pattern: str) -> float:
        return float(self.probabilities([pattern])[0])


# ---------------------------------------------------------------- classifier


def _place(gram: str) -> int:
    """The place of a feature among the hashed ones."""
    return zlib.crc32(gram.encode()) % (DIMENSIONS - 1) + 1


def features(tokens: list[str]) -> list[int]:
    """Hashed words and pairs of words of a sentence."""
    words = [t for t in tokens if len(t) > 1 and t.isalpha()]
    return list({_place(w) for w in words} | {_place(f"{a} {b}") for a, b in pairwise(words)})


def fit(rows: list[list[int]], targets: np.ndarray, weights: np.ndarray, epochs: int = 30, l2: float = 1e-4, rate: float = 0.1, batch: int = 128, seed: int = 7) -> np.ndarray:
    """Logistic regression by adaptive gradients on soft targets, in batches; entry 0 is the intercept."""
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    share = float(np.clip(np.average(targets, weights=weights), 1e-4, 0.5)) if len(rows) else 0.5
    w[0] = np.log(share / (1 - share))  # a sentence of unknown words is as likely as any
    index = [np.array([0, *r]) for r in rows]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(index))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            at = np.concatenate([index[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(index[i]) for i in some])
            z = np.bincount(of, weights=w[at], minlength=len(some))
            slope = weights[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[some])
            places, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, weights=slope[of]) + l2 * w[places]
            g2[places] += g * g
            w[places] -= rate * g / np.sqrt(g2[places])
    return w


class Model:
    """The fitted classifier; scores one document."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)
        self.words = Kept(lambda word: float(self.weights[_place(word)]))
        self.pairs = Kept(lambda pair: float(self.weights[_place(" ".join(pair))]))

    def __reduce__(self):
        return Model, (self.weights,)

    def score(self, text: str) -> tuple[float, int]:
        """The probability of the worst sentence, and which it is."""
        best, which = -30.0, -1
        word, weight, pair = _words.__getitem__, self.words.__getitem__, self.pairs.__getitem__
        for k, s in enumerate(sentences(text)):
            words = list(filter(None, map(word, _raw_tokens(s))))
            z = sum(map(weight, set(words))) + sum(map(pair, set(pairwise(words))))
            if z > best:
                best, which = z, k
        return 1 / (1 + float(np.exp(-min(30.0, best + float(self.weights[0]))))), which


def _part(pattern: str) -> int:
    """The part of the sample a sentence belongs to."""
    if "1" in pattern:
        return 0 if "0" in pattern else 1
    return 2 if "0" in pattern[MENTIONS] else 3


class Sample:
    """Of each part the sentences of least hash of themselves and their text: the same whatever the order of the texts, and as few as asked for."""

    def __init__(self, most: tuple[int, ...]):
        self.most = most
        self.kept: list[list[tuple[int, str, str]]] = [[] for _ in most]
        self.limit = [1 << 32] * len(most)

    def add(self, order: int, pattern: str, tokens: list[str]) -> None:
        part = _part(pattern)
        if order <= self.limit[part]:
            self.kept[part].append((order, pattern, " ".join(tokens)))
            if len(self.kept[part]) > 2 * self.most[part] + 1000:
                self.prune(part)

    def prune(self, part: int) -> None:
        self.kept[part] = sorted(self.kept[part])[: self.most[part]]
        if len(self.kept[part]) == self.most[part]:
            self.limit[part] = self.kept[part][-1][0] if self.kept[part] else -1

    def rows(self) -> list[tuple[int, str, str]]:
        for part in range(len(self.most)):
            self.prune(part)
        return [r for part in self.kept for r in part]


VOTE = pa.schema([("pattern", pa.string()), ("n", pa.int64()), ("sentence", pa.string()), ("o", pa.int64())])


def _vote(sample: int):
    """Patterns with their numbers, and a sample of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, kept = Counter(), Sample(tuple(int(x * sample) for x in PARTS))
        for batch in batches:
            for text in batch.column("text").to_pylist():
                start = zlib.crc32(text.encode())
                for s in sentences(text):
                    tokens = plain_tokens(s)
                    pattern = votes(tokens, not s.isascii())
                    patterns[pattern] += 1
                    kept.add(zlib.crc32(s.encode(), start), pattern, tokens)
        rows = [(p, n, None, 0) for p, n in patterns.items()] + [(p, 0, s, o) for o, p, s in kept.rows()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), VOTE.types, strict=True)], schema=VOTE)

    return run


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[Model, LabelModel]:
    """Votes on all documents, the label model on their patterns, the classifier on a bounded sample."""
    texts = spread(documents.select("text").where(has_text(F.col("text"))))
    cast = cut(texts.mapInArrow(_vote(sample), "pattern string, n bigint, sentence string, o bigint"))
    counted = cast.groupBy("pattern").agg(F.sum("n").alias("n")).where("n > 0").orderBy("pattern").toPandas()
    if not len(counted):
        return Model(np.zeros(DIMENSIONS)), LabelModel(["-" * len(VOTERS)], np.ones(1))
    labels = LabelModel(counted["pattern"].tolist(), counted["n"].to_numpy())
    suspect, opposed = F.col("pattern").contains("1"), F.col("pattern").contains("0")
    mention = F.substring("pattern", MENTIONS.start + 1, MENTIONS.stop - MENTIONS.start).contains("0")
    parts = zip((suspect & opposed, suspect & ~opposed, ~suspect & mention, ~suspect & ~mention), PARTS, strict=True)
    chosen = Counter((r["sentence"], r["pattern"]) for part, share in parts for r in cast.where(F.col("sentence").isNotNull() & part).orderBy("o", "sentence").limit(int(share * sample)).collect())
    return learn(chosen, dict(zip(counted["pattern"], counted["n"].tolist(), strict=True)), labels), labels


def learn(chosen: dict[tuple[str, str], int], patterns: dict[str, int], labels: LabelModel) -> Model:
    """The classifier of plain sentences, from what the label model holds of their votes.

    ``chosen`` are the sentences and patterns of the sample with their numbers, ``patterns`` those of all
    sentences: a part of which the sample has one in ten weighs ten times, so the sample stands for the
    corpus whatever its size.
    """
    keys = sorted(chosen)
    drawn, there = Counter(), Counter()
    for (_, p), n in chosen.items():
        drawn[_part(p)] += n
    for p, n in patterns.items():
        there[_part(p)] += n
    # Repeated sentences weigh a little more.
    weights = np.array([(1 + np.log2(chosen[k])) * there[_part(k[1])] / drawn[_part(k[1])] for k in keys])
    return Model(fit([features(s.split()) for s, _ in keys], labels.probabilities([p for _, p in keys]), weights))


def scored(documents: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, source, score)`` of every document."""
    model = model or train(documents, sample)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [0.0 if t is None or not t.strip() else model.score(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(scores, pa.float64())], ["doc_id", "source", "score"])

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id bigint, source string, score double")


def found(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id)`` of the documents with such language."""
    return scored(documents).where(F.col("score") >= threshold).select("doc_id")


def rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, documents with such language, their rate and the mean score."""
    hit = (F.col("score") >= threshold).cast("int")
    return scored(documents).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_abusive"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
