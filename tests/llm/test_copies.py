from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from paigham.llm import p3_copies as p
from paigham.storage import table
from tests.llm.conftest import pairs

SCHEMA = "row_id bigint, msg string"


def brute(data):
    groups = defaultdict(list)
    for i, m in data:
        if m and m.strip():
            groups[p.canonical(m)].append(i)
    return sorted((min(v), i) for v in groups.values() for i in v if i != min(v))


def test_fields_in_another_order():
    a = "Courier slip X Motors: Ref = A-1 | Shop = B C | From = D"
    b = "courier slip x motors\nfrom: d; ref: a-1; shop: b c"
    swapped = "Courier slip X Motors. Ref: A-1. Shop: D. From: B C"
    assert p.canonical(a) == p.canonical(b) != p.canonical(swapped)
    assert p.canonical("see http://a.b c") == p.canonical("SEE http a b, c!")
    assert p.canonical("!!") != p.canonical("??")


@given(st.lists(st.binary(max_size=20), max_size=40))
def test_trie_tells_keys_apart(keys):
    trie = p.CountingTrie()
    at = [trie.terminal(k) for k in keys]
    assert [keys.index(k) for k in keys] == [at.index(t) for t in at]
    assert trie.terminals == len(set(keys))


def test_against_brute_force(spark, sf):
    df = table(spark, sf, "processed")
    want = brute(df.select("row_id", "msg").collect())
    assert pairs(p.found(df)) == want == pairs(p.found(df, 40))


def test_edges_and_a_hot_text(rows):
    data = [(1, None), (2, ""), (3, "  "), (4, "A b"), (5, "a  B!"), (6, "a bc"), (7, "!!"), (8, "!!"), (9, "x" * 5000 + " y"), (10, "X" * 5000 + ", y")]
    data += [(i, "Hot message" if i % 3 == 0 else f"hot message {i}") for i in range(100, 400)]
    df = rows(SCHEMA, data)
    assert pairs(p.found(df)) == brute(data) == pairs(p.found(df, 20))
    counts = {r.row_id: r.n_copies for r in p.collapsed(df, 20).collect()}
    assert counts[4] == 2 and counts[102] == 100
    assert p.found(df.limit(0)).count() == 0


def test_splitting_goes_on_until_buckets_fit(rows):
    # Long common openings, which only many levels tell apart, and one text a third of the rows.
    data = [(i, "same " * 150 + f"end{i % 90}") for i in range(270)] + [(1000 + i, "Hot, text!" if i % 2 else "hot text") for i in range(130)] + [(2000 + i, f"other {i}") for i in range(50)]
    df = rows(SCHEMA, data)
    for fits in (2, 7, 1000):
        assert pairs(p.found(df, fits)) == brute(data)
    from pyspark.sql import functions as F

    from paigham.llm.common import key128
    from paigham.storage import cut

    x, y = key128(F.col("canon"))
    canon = cut(df.select("row_id", "msg").mapInArrow(p._canonicals, "row_id bigint, canon binary").withColumns({"x": x, "y": y}))
    levels, alone = p.directory(canon, 7)
    assert [d for d, _ in levels] == [8, 16, 32, 64, 128, 256, 512]
    assert sorted((r.n_copies, r.first_row_id) for a in alone for r in a.collect()) == [(130, 1000)]
