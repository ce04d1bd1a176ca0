import re

import numpy as np
import pytest

from paigham.llm import p8_leaks, p9_mixture, p10_abuse
from paigham.storage import table
from tests.llm.conftest import pairs


def split(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def leak_truth(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [split(t)] for k in range(len(w) - n + 1) for i in windows.get(tuple(w[k : k + n]), ())})


def test_blocks_find_all_within_the_radius():
    random = np.random.default_rng(1)
    words = [random.integers(0, 2**63, 60).astype(np.int64) for _ in range(5)]
    items = p8_leaks.Items(list(range(5)), words)
    prints = items.prints.copy()
    for _ in range(p8_leaks.RADIUS):
        prints ^= np.uint64(1) << random.integers(0, 64, len(prints)).astype(np.uint64)
    left, right = items.near(prints)
    want = {(a, b) for a in range(len(prints)) for b in range(len(prints)) if bin(int(prints[a] ^ items.prints[b])).count("1") <= p8_leaks.RADIUS}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_leaks(rows):
    base = " ".join(f"w{i}" for i in range(30))
    items = [(1, base), (2, "too short"), (3, None), (4, ""), (5, " ".join(f"v{i}" for i in range(10)))]
    docs = [(1, "x " * 300 + " ".join(f"W{i}," for i in range(5, 15)) + " y" * 70_000), (2, " ".join(f"w{i}" for i in range(5, 14))), (3, None), (4, ""), (5, base), (6, base), (7, " ".join(f"w{i}" for i in range(4)) + " odd " + " ".join(f"w{i}" for i in range(4, 12)))]
    d, e = rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items)
    assert pairs(p8_leaks.found(d, e)) == leak_truth(docs, items) == [(1, 1), (5, 1), (6, 1)]
    leaked = {r.doc_id: r for r in p8_leaks.leaks(d, e).collect()}
    assert leaked[5].coverage == 1.0 == leaked[5].similarity and leaked[1].similarity is None
    assert p8_leaks.leaks(d.limit(0), e).count() == p8_leaks.leaks(d, e.limit(0)).count() == 0
    assert p8_leaks.found(d.limit(0), e).count() == p8_leaks.found(d, e.limit(0)).count() == 0
    assert pairs(p8_leaks.matches(d, e, most_words=20).where("exact").select("doc_id", "item_id").distinct()) == [(1, 1), (5, 1), (6, 1)]


def shingle_similarity(a, b, weight):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return sum(weight.get(s, 1.0) for s in x & y) / sum(weight.get(s, 1.0) for s in x | y)


def test_near_copies_by_brute_force(rows):
    """Whole items in which words at the ends, or a few inside, differ: nine in ten of the similar ones are found, and only those."""
    random = np.random.default_rng(11)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20 + 7 * i))) for i in range(12)]
    docs = []
    for d in range(260):
        words = items[d % 12][1].split()
        for _ in range(random.integers(0, 5)):
            place = random.integers(0, len(words)) if random.random() < 0.4 else random.choice([0, 1, len(words) - 2, len(words) - 1])
            words[place] = f"x{d}y{place}"
        docs.append((d, " ".join([*(f"p{d}_{k}" for k in range(random.integers(0, 30))), *words, *(f"q{d}_{k}" for k in range(random.integers(0, 30)))])))
    truth = set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            own = item.split()
            if any(shingle_similarity(words[k : k + len(own)], own, {}) >= p8_leaks.SIMILAR for k in range(len(words) - len(own) + 1)):
                truth.add((d, i))
    got = {(r.doc_id, r.item_id) for r in p8_leaks.copies(rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items)).collect()}
    assert len(truth) > 100 and got <= truth and len(got) >= 0.9 * len(truth)
    parts = {(r.doc_id, r.item_id) for r in p8_leaks.copies(rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items), most_words=200).collect()}
    assert parts == got


def test_leaks_by_brute_force(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    assert pairs(p8_leaks.found(d, e)) == leak_truth(d.select("doc_id", "text").collect(), e.select("item_id", "text").collect())


def test_sainte_lague():
    assert p9_mixture.sainte_lague({"a": 53, "b": 24, "c": 23}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert p9_mixture.sainte_lague({"a": 1, "b": 1}, 10, {"a": 2, "b": 3}) == {"a": 2, "b": 3}


def test_mixture(rows, spark):
    docs = [(i, f"some words of text number {i}", "big") for i in range(400)] + [(1000 + i, f"small source text {i}", "small") for i in range(20)] + [(2000, None, "big"), (2001, "  ", "big"), (2002, "x", None), (2003, "x", "untargeted")]
    d = rows("doc_id bigint, text string, source string", docs)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in p9_mixture.shares(d, targets).collect()}
    assert got["small"].most_repeats <= 3 and got["big"].most_repeats == 1 and got["none"].n_tokens == 0
    assert abs(got["small"].actual_share - 1 / 3) < 0.03
    assert p9_mixture.mixture(d, targets).exceptAll(p9_mixture.mixture(d.repartition(5), targets)).isEmpty()
    assert p9_mixture.mixture(d.limit(0), targets).count() == 0


def test_mixture_over_many_shards(rows, spark):
    """Quotas are kept whatever the number of shards, and add up to the shares."""
    docs = [(i, " ".join(["word"] * (1 + i % 9)), "big" if i % 3 else "mid") for i in range(1500)] + [(9000 + i, "tiny text here", "small") for i in range(30)]
    d = rows("doc_id bigint, text string, source string", docs)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    for shard_rows in (20_000, 200, 25):
        got = p9_mixture.mixture(d, targets, shard_rows=shard_rows).collect()
        used = {s: sum(r.n_tokens * r.repeats for r in got if r.source == s) for s in ("big", "mid", "small")}
        total = sum(used.values())
        assert all(abs(used[s] / total - x) < 0.02 for s, x in (("big", 0.5), ("mid", 0.4), ("small", 0.1)))
        assert all(1 <= r.repeats <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in got) and len(got) == len({r.doc_id for r in got})


def test_blocks_of_groups_add_up():
    groups = [(s, g, 1000 + 37 * g) for s in "ab" for g in range(40)]
    given, size, total = p9_mixture.plan(groups, {"a": (0.7, 1), "b": (0.3, 1)})
    of = {s: sum(b for (x, _), b in given.items() if x == s) for s in "ab"}
    assert sum(of.values()) == total // size and abs(of["a"] / sum(of.values()) - 0.7) < 1e-3
    assert all(b * size <= n + size for (s, g), b in given.items() for x, h, n in groups if (s, g) == (x, h))


@pytest.mark.parametrize(("text", "want"), [("your whole family is t.r.a.s.h", "trash"), ("Yeh log k33r@y makoray", "keeray"), ("You filthy l***r", "liar|loser"), ("full sexxxx now", "sex"), ("j a c k a s s", "jackass"), ("Oye vllv", "ullu")])
def test_disguises(text, want):
    assert re.search(want, p10_abuse.plain(text)) or "***" in text


def pattern(*votes):
    return "".join(dict(votes).get(v, "-") for v in p10_abuse.VOTERS)


ON = {v: (v, "0" if k in p10_abuse.AGAINST else "1") for k, v in enumerate(p10_abuse.VOTERS)}
QUIET = pattern()


def test_label_model_learns_sides():
    # As in text: everyday words stand in many sentences, and now and then beside a word of the lexicon.
    seen = {QUIET: 5000, pattern(ON["everyday"]): 3000, pattern(ON["insult"], ON["directed insult"]): 100, pattern(ON["insult"], ON["directed insult"], ON["threat"]): 80, pattern(ON["sexual"], ON["soliciting"]): 60, pattern(ON["insult"], ON["everyday"]): 100, pattern(ON["mention"]): 100}
    model = p10_abuse.LabelModel(list(seen), np.array(list(seen.values())))
    assert model.probability(pattern(ON["insult"], ON["directed insult"], ON["threat"])) > 0.9 > 0.5 > model.probability(pattern(ON["insult"], ON["everyday"]))
    assert model.probability(QUIET) < 0.05 and model.probability(pattern(ON["mention"])) < 0.01


def drawn(rates, share=0.05, n=60_000, seed=3):
    """Patterns of voters with the given rates (on insulting, on other sentences), and the share of insults among those the voter marks alone."""
    random = np.random.default_rng(seed)
    bad = random.random(n) < share
    seen = {}
    for y in bad:
        p = pattern(*(ON[v] for v, (on, off) in rates.items() if random.random() < (on if y else off)))
        seen.setdefault(p, [0, 0])[int(y)] += 1
    return seen


def test_a_bad_voter_is_found_out():
    """Two voters are believed alike beforehand; the votes of the others tell which of them is bad."""
    good = {"insult": (0.8, 0.002), "directed insult": (0.7, 0.0005), "everyday": (0.05, 0.4)}
    for contempt, curse in (((0.6, 0.001), (0.05, 0.05)), ((0.05, 0.05), (0.6, 0.001))):
        seen = drawn(good | {"contempt": contempt, "curse": curse})
        model = p10_abuse.LabelModel(list(seen), np.array([sum(x) for x in seen.values()]))
        ratio = {v: model.theta[1, p10_abuse.VOTERS.index(v), 2] / model.theta[0, p10_abuse.VOTERS.index(v), 2] for v in ("contempt", "curse")}
        right, wrong = ("contempt", "curse") if contempt[0] > 0.5 else ("curse", "contempt")
        assert ratio[right] > 50 > 3 > ratio[wrong]
        assert model.probability(pattern(ON[wrong])) < 0.5 < model.probability(pattern(ON[right], ON["insult"]))
        # The rate of the bad voter is estimated, not believed.
        assert abs(model.theta[0, p10_abuse.VOTERS.index(wrong), 2] - 0.05) < 0.01


def test_posteriors_are_calibrated():
    seen = drawn({"insult": (0.8, 0.01), "directed insult": (0.7, 0.002), "threat": (0.3, 0.001), "everyday": (0.05, 0.4), "mention": (0.01, 0.05)})
    model = p10_abuse.LabelModel(list(seen), np.array([sum(x) for x in seen.values()]))
    right = sum(n[int(q >= 0.5)] for (_, n), q in zip(seen.items(), model.probabilities(list(seen)), strict=True))
    assert right / sum(map(sum, seen.values())) > 0.985


def test_abuse(spark, sf, rows):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    model, _ = p10_abuse.train(docs)
    bad = ["You are a worthless piece of garbage and your whole family is trash.", "Shut up you m0r0n, one more word and I will break your teeth.", "Send me your nude pictures tonight, I want to see you naked in my bed."]
    good = ["The dog bit the postman, so the parcel came late.", "Naked wires near the meter must be reported to the lineman.", "A workshop on hate speech and harassment will be held for the counter staff.", "", "   "]
    d = rows("doc_id bigint, source string, text string", [(i, "s", t) for i, t in enumerate(bad + good)] + [(99, None, None)])
    got = {r.doc_id: r.score for r in p10_abuse.scored(d, model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(bad)))
    assert all(got[i] < 0.5 for i in range(len(bad), len(bad) + len(good))) and got[99] == 0
    assert p10_abuse.found(d.limit(0)).count() == 0


def test_abuse_against_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "doc_labels")
    found = {r.doc_id for r in p10_abuse.found(docs).collect()}
    judged = [(r.doc_id in found, r.toxic == 1) for r in labels.where("toxic is not null").collect()]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9  # the labels hold some mistakes


MATCHES = {
    3: "wipe them out|driven out|drive them out|back in a coffin|get rid of them|born to steal|breathe our air|waste our air|burn their|exterminate|clean until|send them back|Send every Pathan back where they came from|keep them locked|lock them up|"
    "paida hota hai|nafrat farz|nasl hi|wajood mita|nikal phenko|inhen maar|inhen nikal|inhen khatam|in se nafrat|whole breed|too stupid to|are vermin|are filth|are animals|are cockroaches|never trust an X that|no one deserves|put them back in a coffin!",
    2: "I will kill you|we would find all of you|i'll hurt your|i beat you|i stab you|i shoot you|break your teeth|crack your skull|smash your face|drop dead|hang yourself|drown urself|go die|go and rot|choke on your|hope you suffer|cut you open|with a knife|"
    "nobody wants to see you alive|burn it down|munh tod|haddi todunga|haddiyan tod|zinda nahi chhorunga|jaan se maarunga|mar ja|doob maro|joote maro|gala ghont|gala kaat|goli maar|drop dead!",
    8: "poster says|sign says|no nudity|no insults|workshop|awareness|seminar|training|helpline now|records abusive|abusive calls|two warnings|was fined|does not repeat|hate speech|harassment|reported that|notice says|notice does|the helpline now takes|moderate|moderating|community centre|neighbours cooked|welcomes everyone|he joked|policy|moderates",
    9: "i was an idiot|i am so sorry|myself|lesson learned|my own fault|main hi bewaqoof|main gadha",
    10: "you stupid|you are a worthless|you're pathetic|ur disgusting|you useless|you brainless|you shameless|you spineless|you filthy|you ugly|you dumb|you idiotic|you moronic|you vile|you repulsive|you despicable|your miserable face",
    11: "burn in hell|rot in hell|go straight to hell|screw you|damn you|curse you|fuck you|fuck off|i will end you|i'll finish you|i swear i will ruin you|watch your back|you are dead|you will pay for|you'll regret|you will all suffer|make you pay|make you suffer|make you regret",
    12: "go back to your|go back to where they|do not belong here|doesn't belong in our|all of them are thieves|those foreigners are criminals|these zubranis are terrorists|every zubranis is rapists|all zubranis are murderers|all zubranis are liars|should all be shot|should be hanged|should be killed|should be deported|should be gassed|should be burned|deserve to die|deserves to be killed",
    7: "gali mein|rider wapas|dog bit|cold killed|farm smells|clinic offers",
}


@pytest.mark.parametrize(("voter", "text"), [(v, t) for v, all_of in MATCHES.items() for t in all_of.split("|")])
def test_no_gate_hides_a_pattern(voter, text):
    tokens = p10_abuse.plain_tokens(text)
    matcher = {2: p10_abuse.THREAT, 3: p10_abuse.GROUP_HATE, 7: p10_abuse.EVERYDAY, 8: p10_abuse.MENTION, 9: p10_abuse.SELF, 10: p10_abuse.CONTEMPT, 11: p10_abuse.CURSE, 12: p10_abuse.EXCLUSION}[voter]
    assert matcher.search(" ".join(tokens)) and p10_abuse.votes(tokens)[voter] != "-"


@pytest.mark.parametrize("mark", list(" .-_*"))
def test_letters_set_apart_by_any_mark(mark):
    assert p10_abuse.plain(f"You are {mark.join('trash')} all") == "You are trash all".lower()


def test_classifier_sees_words_and_pairs_only():
    tokens = p10_abuse.plain_tokens("the tall tree fell")
    assert len(p10_abuse.features(tokens)) == 7 and p10_abuse.votes(tokens) == QUIET
    both = set(p10_abuse.features(tokens)) - {p10_abuse._place(t) for t in tokens}
    weights = np.zeros(p10_abuse.DIMENSIONS)
    weights[list(both)] = 1
    assert p10_abuse.Model(weights).score("the tall tree fell")[0] == pytest.approx(1 / (1 + np.exp(-3)))


@pytest.mark.parametrize("text", ["you stupid woman", "go back to your country", "burn in hell", "you are worthless and stupid", "I will end you", "You deserve to die", "all those Kelmars are thieves", "you will regret this", "fuck off", "your ugly face"])
def test_voters_beyond_the_corpus(text):
    assert "1" in p10_abuse.votes(p10_abuse.plain_tokens(text))


@pytest.mark.parametrize("text", ["you look ugly weather up", "the back office will call you", "go back to the shop", "watch your back door", "the battery is dead"])
def test_plain_talk_gets_no_contempt_or_curse(text):
    assert "1" not in p10_abuse.votes(p10_abuse.plain_tokens(text))[12:]


@pytest.mark.parametrize("space", [0x20, 0x0A, 0xA0, 0x2003, 0x3000, 0x2028, 0x85])
def test_any_white_space_ends_a_sentence(space):
    assert p10_abuse.sentences(f"One.{chr(space)}Two!{chr(space)}Three") == ["One.", "Two!", "Three"]


def test_sample_is_the_same_in_any_order():
    sentences = [(p10_abuse.zlib.crc32(f"{i}".encode()), pattern(ON["insult"]) if i % 3 else QUIET, [f"s{i}"]) for i in range(9000)]
    draws = []
    for order in (sentences, sentences[::-1]):
        sample = p10_abuse.Sample((5, 100, 5, 40))
        for x in order:
            sample.add(*x)
        draws.append(sorted(sample.rows()))
    assert draws[0] == draws[1] and len(draws[0]) == 140
