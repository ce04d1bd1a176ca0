import re
from collections import Counter, defaultdict

import pyarrow as pa

from paigham.llm import p5_terms, p6_overlap, p7_splits
from paigham.storage import table
from tests.llm.conftest import pairs


def words(s):
    return frozenset(re.findall(r"[^\W_]+", (s or "").lower()))


def test_terms(rows):
    data = [(1, " a  b a "), (2, "a\tc"), (3, None), (4, ""), (5, "   "), (6, "a"), (7, "a b")]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in p5_terms.counted(rows("row_id bigint, cleaned_msg string", data)).collect()}
    assert got == {"a": (5, 4, "common"), "b": (2, 2, "rare"), "c": (1, 1, "rare")}
    assert p5_terms.found(rows("row_id bigint, cleaned_msg string", data[2:5])).count() == 0


def test_runs_go_on_across_batches():
    batches = [pa.RecordBatch.from_pydict({"term": t, "occurrences": [1] * len(t), "records": [1] * len(t)}, schema=p5_terms.RUN) for t in (["a", "a"], ["a", "b"], [], ["b"], ["c"])]
    out = pa.Table.from_batches(list(p5_terms._scan_runs(iter(batches)))).to_pydict()
    assert out == {"term": ["a", "b", "c"], "occurrences": [3, 2, 1], "records": [3, 2, 1]}


def test_terms_by_brute_force(spark, sf):
    df = table(spark, sf, "processed")
    occurrences, records, n = Counter(), Counter(), 0
    for (c,) in df.select("cleaned_msg").collect():
        parts = (c or "").split()
        n += bool(parts)
        occurrences.update(parts)
        records.update(set(parts))
    got = p5_terms.counted(df).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occurrences[t], records[t]) for t in records}
    assert {r.term for r in got if r.mark == "common"} == {t for t, k in records.items() if k > 0.15 * n}


def overlap_truth(data):
    held = [(i, words(m), c, s) for i, m, c, s in data if s in ("train", "validation", "test")]
    out = set()
    for i, w, c, s in held:
        for j, v, d, t in held:
            if s == "train" and t != "train":
                near = w and v and 10 * len(w & v) >= 7 * len(w | v)
                if near or (c and c.strip() and c == d):
                    out.add((min(i, j), max(i, j)))
    return sorted(out)


def test_overlap_by_brute_force(spark, sf):
    df = table(spark, sf, "processed").select("row_id", "msg", "cleaned_msg", "split")
    want = overlap_truth(df.collect())
    got = pairs(p6_overlap.found(df))
    assert not set(got) - set(want)
    assert len(got) >= 0.99 * len(want) and want


def test_overlap_edges(rows):
    long = " ".join(f"word{i}" for i in range(3000))
    data = [
        (1, "kepaa haamol foods slip 12345 aaj", "k", "train"), (2, "KEPAA haamol, foods slip 12345", None, "test"), (3, "something else", "k", "validation"), (4, None, " ", "train"), (5, "", " ", "test"),
        (6, long, "", "train"), (7, long + " more", "", "test"), (8, "kepaa haamol foods slip 12345 aaj", "z", None), (9, "...", "q", "train"), (10, "...", "r", "test"),
    ]
    df = rows("row_id bigint, msg string, cleaned_msg string, split string", data)
    assert pairs(p6_overlap.found(df)) == overlap_truth(data) == [(1, 2), (1, 3), (6, 7)]
    assert p6_overlap.found(df.limit(0)).count() == 0
    assert {(r.split, r.n_rows, r.n_overlapping) for r in p6_overlap.report(df.selectExpr("*", "'s' as source")).collect()} == {("test", 4, 2), ("validation", 1, 1)}


def test_overlap_of_a_hot_text(rows):
    data = [(i, "one hot message with several words", f"c{i}", "train" if i % 2 else "test") for i in range(60)] + [(i, f"other thing number {i} entirely", f"c{i}", "train") for i in range(100, 220)]
    assert p6_overlap.found(rows("row_id bigint, msg string, cleaned_msg string, split string", data)).count() == 900


LINKS = "row_id bigint, sender_id bigint, campaign_id string, cleaned_msg string, status string"


def link_truth(data, aliases):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in aliases:
        if a is not None and b is not None:
            parent[root(("s", a))] = root(("s", b))
    for i, s, c, t, _ in data:
        for key in [("s", s)] * (s is not None) + [("c", c)] * bool(c and c.strip()) + [("t", t)] * bool(t and t.strip()):
            parent[root(i)] = root(key)
    groups = defaultdict(list)
    for i, *_ in data:
        groups[root(i)].append(i)
    return sorted((min(v), i) for v in groups.values() for i in v if i != min(v)), groups


def test_components(rows, spark):
    chain = [(i, i // 2, f"c{(i + 1) // 2}", f"t{i}", "Scam") for i in range(40)]
    data = chain + [(100, None, None, None, None), (101, None, " ", "", "Genuine"), (102, 500, None, None, "Scam"), (103, 501, "", " ", "Scam"), (104, 502, None, "t3", "Genuine")]
    aliases = [(500, 499), (499, 501), (7, None), (None, 3)]
    senders = spark.createDataFrame([(a, b, "m") for a, b in aliases], "sender_id bigint, alias_of bigint, row_id string")
    df = rows(LINKS, data)
    assert pairs(p7_splits.found(df, senders)) == link_truth(data, aliases)[0]
    assert p7_splits.found(df.limit(0), senders).count() == 0
    assert p7_splits.found(df.limit(0), senders.limit(0)).count() == 0


def test_splits_keep_groups_and_shares(spark, sf):
    df, senders, targets = (table(spark, sf, t) for t in ("processed", "senders", "split_targets"))
    data = df.select("row_id", "sender_id", "campaign_id", "cleaned_msg", "status").collect()
    _, groups = link_truth(data, [(r.sender_id, r.alias_of) for r in senders.collect()])
    got = {r.row_id: r.split for r in p7_splits.assigned(df, senders, targets).collect()}
    assert set(got) == {r.row_id for r in data}
    assert all(len({got[i] for i in v}) == 1 for v in groups.values())
    shares = Counter(got.values())
    for r in targets.collect():
        assert abs(shares[r.split] / len(got) - r.share) < 0.06
    scam = Counter(got[r.row_id] for r in data if r.status == "Scam")
    assert all(abs(scam[s] / shares[s] - sum(scam.values()) / len(got)) < 0.1 for s in shares)


def test_overlap_finds_every_pair(rows):
    # 70 % of the words in common, but no word that is rare is followed by the same word.
    often = [f"often{i}" for i in range(14)]
    filler = [(i, " ".join(often[i % 14 :] + often[: i % 14]) + f" filler{i} more{i}", None, "train") for i in range(100, 200)]
    mixed = lambda *own: " ".join(w for pair in zip(often, [*own, *[""] * 14]) for w in pair if w)
    late = " ".join(f"w{i}" for i in range(20))
    data = [
        *filler, (1, mixed("once", "here"), None, "train"), (2, mixed("", "", "", "once"), None, "test"), (3, late, None, "train"), (4, " ".join(reversed(late.split())), None, "validation"),
        (5, "tithar ziner clinic aaj khula hai subah das baje tak", None, "train"), (6, "tithra ziner clinic aaj khula hai subah das baje tak", None, "test"),
    ]
    data += [(300 + i, f"other{i} ziner text{i}", None, "train") for i in range(9)]
    df = rows("row_id bigint, msg string, cleaned_msg string, split string", data)
    assert pairs(p6_overlap.found(df)) == overlap_truth(data)
    assert {(1, 2), (3, 4), (5, 6)} <= set(overlap_truth(data))


def test_overlap_of_random_texts(rows):
    import random

    r = random.Random(5)
    data = []
    for i in range(600):
        base = data[r.randrange(len(data))][1].split() if data and r.random() < 0.6 else [f"v{int(r.paretovariate(0.4)) % 400}" for _ in range(r.randrange(1, 24))]
        data.append((i, " ".join(w if r.random() > 0.12 else f"v{r.randrange(400)}" for w in r.sample(base, len(base))), None, r.choice(["train", "test", "validation"])))
    df = rows("row_id bigint, msg string, cleaned_msg string, split string", data)
    assert pairs(p6_overlap.found(df)) == overlap_truth(data)


def test_hot_runs_are_split_and_nothing_is_lost(rows):
    import random

    r = random.Random(8)
    data = [(i, " ".join(r.sample([f"w{k}" for k in range(9)], r.randrange(3, 8))), r.choice([f"c{i % 5}", None, f"d{i}"]), r.choice(["train", "test", "validation"])) for i in range(160)]
    df = rows("row_id bigint, msg string, cleaned_msg string, split string", data)
    texts = p6_overlap.Texts(df)
    whole = texts.similar().select("xa", "xb", "common", "either").collect()
    assert whole
    for meets, deepest in ((1, 3), (3, 3), (2, 2), (0, 1)):
        assert sorted(texts.similar(meets, deepest).select("xa", "xb", "common", "either").collect()) == sorted(whole)
    truth = overlap_truth(data)
    assert pairs(p6_overlap.found(df)) == truth
    partners = Counter(i for pair in truth for i in pair)
    got = {x.row_id: x for x in p6_overlap.classes(df).collect()}
    assert {i: x.n_links for i, x in got.items() if x.n_links} == partners and len(got) == len(data)
    sets = {i: words(m) for i, m, *_ in data}
    assert all(x.class_row_id == min(i for i, w in sets.items() if w == sets[x.row_id]) for x in got.values())


def test_long_runs_go_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(p6_overlap, "BLOCK", 4)
    data = [(i, f"same start here x{i} y{i % 3}" if i % 4 else f"same start here again z{i}", None, "train" if i % 2 else "test") for i in range(60)]
    data += [(100 + i, "alpha beta gamma delta" + " epsilon" * (i % 2), None, "train" if i % 3 else "test") for i in range(9)]
    df = rows("row_id bigint, msg string, cleaned_msg string, split string", data)
    assert pairs(p6_overlap.found(df)) == overlap_truth(data)


def test_spans_are_merged(rows):
    data = [(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1", None, "train"), (2, "a1 a2 a3 a4 a5 a6 a7 a8 a9 b2", None, "test")]
    (one,) = p6_overlap.Texts(rows("row_id bigint, msg string, cleaned_msg string, split string", data)).similar().collect()
    assert (one.common, one.either) == (9, 11) and 1 <= one.covered <= 9


def test_long_falling_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = p7_splits.cut
    monkeypatch.setattr(p7_splits, "cut", lambda df, *a: rounds.append(1) or real(df, *a))
    n = 3000
    edges = spark.range(n).selectExpr("cast(id as decimal(38,0)) u", "cast(id + 1 as decimal(38,0)) v")
    got = p7_splits.components(edges).collect()
    assert len(got) == n + 1 and len({r.root for r in got}) == 1
    assert len(rounds) < 3 * 25


def test_keys_are_wide(spark):
    from pyspark.sql import functions as F

    keys = [r[0] for r in spark.range(2000).select(p7_splits._key("text", F.col("id").cast("string"))).collect()]
    assert len(set(keys)) == 2000 and max(abs(int(k)) for k in keys) > 10**35 and len({int(k) % 10**18 for k in keys}) == 2000


def test_rarest_outstanding_label_goes_first():
    """One label stands in two components only: they go first, whatever the size of the others, and every part gets its share."""
    large = [(1, [0.0, 400.0, 0.0]), (2, [10.0, 90.0, 0.0]), (3, [2.0, 0.0, 0.0])]
    classes = [("a", 100, [0.0, 100.0, 0.0]), ("b", 10, [0.0, 0.0, 10.0]), ("c", 8, [8.0, 8.0, 0.0])]
    shares = {"train": 0.5, "test": 0.5}
    totals = [20.0, 598.0, 10.0]
    placed, ranges = p7_splits._plan(large, classes, shares, totals)
    assert set(placed) == {1, 2, 3} and placed[2] != placed[1]
    got = {s: [0.0, 0.0, 0.0] for s in shares}
    for name, _, vector in [(n, 1, v) for n, v in large]:
        got[placed[name]] = [x + y for x, y in zip(got[placed[name]], vector)]
    for name, low, high, s in ranges:
        count, vector = next((c, v) for n, c, v in classes if n == name)
        got[s] = [x + (high - low) * y / count for x, y in zip(got[s], vector)]
    assert [sum(x) for x in zip(*got.values())] == totals and abs(got["train"][0] - 10) <= 2 and got["train"][2] == 5
    for name, count, _ in classes:
        spans = sorted((low, high) for n, low, high, _ in ranges if n == name)
        assert spans[0][0] == 0 and spans[-1][1] == count and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert p7_splits._plan([], [], shares, [0.0, 0.0, 0.0]) == ({}, [])
