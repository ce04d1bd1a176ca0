from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from paigham.llm import p1_lookalike as p
from paigham.storage import table
from tests.llm.conftest import pairs

SHY, ZWJ, NBSP = chr(0xAD), chr(0x200D), chr(0xA0)
SCHEMA = "row_id bigint, msg string"


def test_table_leaves_plain_text():
    assert not any(chr(c).isascii() for c in p.TABLE)
    assert all(p.by_table(v) == v for v in p.TABLE.values())
    assert p.by_table("Café – “x” ½ № ا") == "Café – “x” ½ № ا"


def test_drawn_joiners_stay():
    family = f"👨{ZWJ}👩"
    assert p.by_table(family) == family
    assert p.by_table(f"a{ZWJ}b") == "ab"


def test_automaton_costs():
    trie = p.VocabularyTrie({"bank": 3, "bunk": 1, "list": 2})
    assert trie.nearest(f"bаn{SHY}k") == "bank"
    assert trie.nearest("bonk") is None
    assert trie.nearest("bonk", 1) == "bank"
    assert trie.nearest("lit", 1) == trie.nearest("lists", 1) == "list"
    assert trie.nearest("xyz", 1) is None
    assert p.VocabularyTrie({}).nearest("a") is None


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=8, unique=True), st.text("abc", min_size=1, max_size=5), st.integers(0, 2))
def test_automaton_is_edit_distance(words, token, bound):
    best = min((edit_distance(token, w), -1, w) for w in words)
    got = p.VocabularyTrie(dict.fromkeys(words, 1)).nearest(token, bound)
    assert got == (best[2] if best[0] <= bound else None)


def test_found_edges(rows):
    data = [(1, "Mubarak ho"), (2, f"Mubаrak{NBSP}ho"), (3, "mubarak ho"), (4, "Mubarak\tho"), (5, None), (6, ""), (7, NBSP), (8, " "), (9, "Ｍubarak ho"), (10, "Mubarak ho"), (11, "Mubarák ho"), (12, "Mubarák ho".replace("á", "a" + chr(0x301)))]
    df = rows(SCHEMA, data)
    assert pairs(p.found(df)) == [(1, 2), (1, 9), (2, 9), (2, 10), (9, 10), (11, 12)]
    assert p.found(df.limit(0)).count() == 0
    assert p.normalized(df).count() == 12


def test_found_by_brute_force(spark, sf):
    df = table(spark, sf, "processed")
    groups = defaultdict(list)
    for r in df.select("row_id", "msg").where("msg is not null").collect():
        if r.msg.strip():
            groups[p.by_table(r.msg)].append((r.row_id, r.msg))
    want = sorted((min(a, b), max(a, b)) for v in groups.values() for i, (a, m) in enumerate(v) for b, n in v[i + 1 :] if m != n)
    assert pairs(p.found(df)) == want and want


def test_hot_form(rows):
    data = [(i, "same text" if i % 3 else f"same te{SHY}xt") for i in range(60)]
    assert p.found(rows(SCHEMA, data)).count() == 20 * 40


BAR, CAPITAL = chr(0x4CF), chr(0x406)


def test_vocabulary_decides_between_readings(rows):
    """A bar may be a capital I or a small l: the table has one reading, the frequent word is right."""
    assert p.by_table(f"{BAR}NAM") == "lNAM" and p.by_table(f"be{CAPITAL}a") == "beIa"
    trie = p.VocabularyTrie({"INAM": 3, "lNAM": 1, "bela": 2})
    assert trie.nearest(f"{BAR}NAM") == "INAM" and trie.nearest(f"be{CAPITAL}a") == "bela"
    data = [(1, "Jeeto INAM abhi"), (2, f"Jeeto {BAR}NAM abhi"), (3, "INAM lNAM INAM"), (4, f"be{CAPITAL}a aaj"), (5, "bela aaj"), (6, f"xy{BAR}"), (7, "beIa"), (8, "bela")]
    df = rows(SCHEMA, data)
    canon = {r.row_id: r.canon for r in p.normalized(df).collect()}
    assert canon[2] == "Jeeto INAM abhi" and canon[4] == "bela aaj" and canon[6] == "xyl" and canon[7] == "beIa"
    assert pairs(p.found(df)) == [(1, 2), (4, 5)]


def test_classes_count_without_pairs(rows):
    data = [(i, "same text" if i % 3 else f"same te{SHY}xt") for i in range(60)] + [(90, None), (91, " "), (92, "other")]
    got = {r.row_id: r for r in p.classes(rows(SCHEMA, data)).collect()}
    assert len(got) == 61 and all(got[i].class_row_id == 0 and got[i].n_rows == 60 and got[i].n_links == (20 if i % 3 else 40) for i in range(60))
    assert got[92].n_links == 0


def test_upright_mathematical_letters():
    assert p.by_table("".join(chr(0x1D5BA + k) for k in range(3))) == "abc" and p.by_table(chr(0x1D7F9)) == "3"
