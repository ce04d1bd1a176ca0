"""Text functions against outcomes written by hand, and properties that any cleaned text has."""

import csv
import os
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paigham import lexicon
from paigham.config import Settings
from paigham.functions import labels as L
from paigham.functions import text as X

#: A CSV with the columns msg and cleaned_msg, whose texts must clean to the same; none by default.
GOLDEN = Path(os.environ.get("PAIGHAM_GOLDEN_CSV", "none"))


def one(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (X.replace_numbers, "kal 7,350.25 milenge", "kal numtoken milenge"),
        (X.replace_numbers, "786. aur 3,333 ya 3334", "786 aur 3333 ya numtoken"),
        (X.replace_numbers, "dial *44 #, *1# nahi", "dial shortcodetoken, *numtoken# nahi"),
        (X.replace_numbers, "0345-6789012 / 92 345 6789012 / [ NUMBER ]", "phonetoken / phonetoken / phonetoken"),
        (X.replace_numbers, "99999999999 x99999999999", "phonetoken xnumtoken"),
        (X.replace_urls, "dekho https://a.example/b?c=1, phir", "dekho urltoken phir"),
        (X.replace_urls, "(ganj-mandi.store) ya pul.top/raah.", "(urltoken) ya urltoken"),
        (X.replace_urls, "subah.shaam", "subah.shaam"),
        (X.clean, "~~Sasta__Saman~~ :: 5kg", "sasta saman numtokenkg"),
        (X.clean, None, ""),
        (X.normalize_spelling, "wtsp pe jldi", "whatsapp pe jaldi"),
        (X.normalize_spelling, "krnal aapas", "krnal aapas"),
        (X.normalize_spelling, "(aapke) sy", "(aap ke) se"),
        (X.preprocess, "*81*4455#", "numtokenshortcodetoken"),
        (X.preprocess, "2kg aata, 3.5ltr doodh; dada'ji", "numtokenkg aata numtokenltr doodh dada"),
        (X.preprocess, " \n\t", ""),
        (X.duplicate_key, "\tChai\n\nPani  ", "chai pani"),
        (X.duplicate_key, None, "nan"),
        (lambda c: X.shorten(c, 4), "chaipani", "chai..."),
    ],
)
def test_examples(spark, function, value, want):
    assert one(spark, function, [value]) == [want]


def test_number_modes(spark):
    assert one(spark, lambda c: X.replace_numbers(c, "keep"), ["rs 50"]) == ["rs 50"]
    assert one(spark, lambda c: X.replace_numbers(c, "remove"), ["rs 50 x"]) == ["rs   x"]
    assert one(spark, lambda c: X.replace_numbers(c, short_codes=("50",)), ["rs 50."]) == ["rs 50"]


def test_tokens_of_empty_and_odd_space(spark):
    nbsp = chr(0xA0)
    assert one(spark, X.tokens, ["", " a  b ", f"a{nbsp}b\tc"]) == [[], ["a", "b"], ["a", "b", "c"]]


def test_ngrams_short_rows(spark):
    assert one(spark, lambda c: X.ngrams(X.tokens(c)), ["", "ab", "ab x cd", "ab cd ef"]) == [[], ["ab"], ["ab", "cd", "ab cd"], ["ab", "cd", "ef", "ab cd", "cd ef"]]
    assert one(spark, lambda c: X.ngrams(X.tokens(c), 3), ["ab cd ef"]) == [["ab", "cd", "ef", "ab cd", "cd ef", "ab cd ef"]]


def test_token_spelling_splits_values(spark):
    assert one(spark, lambda c: X.normalize_tokens(X.tokens(c)), ["apka kr"]) == [["aap", "ka", "kar"]]
    assert one(spark, lambda c: X.normalize_tokens(X.tokens(c), {"a": "b"}), ["a urltoken"]) == [["b", "urltoken"]]


def test_stoplist_sets():
    assert "ka" not in lexicon.stopwords(keep=("KA",))
    assert "zzz" in lexicon.stopwords(extra=("ZZZ",))
    assert not lexicon.stopwords(extra=("free",)) & lexicon.PROTECTED


def test_switches_off(spark):
    raw = Settings(urls=False, punctuation=False, spelling=False, drop_stopwords=False, number_mode="keep", phones=False, service_codes=False)
    assert one(spark, lambda c: X.preprocess(c, raw), ["Ap  ka www.x.pk!"]) == ["ap ka www.x.pk!"]


@pytest.mark.skipif(not GOLDEN.exists(), reason="no golden rows here")
def test_golden_rows(spark):
    rows = list(csv.DictReader(GOLDEN.open(encoding="utf-8")))
    assert one(spark, X.preprocess, [r["msg"] for r in rows]) == [r["cleaned_msg"] for r in rows]


ALPHABET = st.sampled_from([*"abkmn .,!-/*#+@_'0123456789", "03", "+92", "https://", "www.", ".com", ".pk", "8171", "786", "ap", "nhi", " ka ", "\n", chr(0xA0), "é", "[number]"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=40, max_size=60)
QUIETLY = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUIETLY
@given(TEXTS)
def test_what_a_cleaned_text_looks_like(spark, texts):
    cleaned = one(spark, X.clean, texts)
    for c in cleaned:
        assert set(c) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") and c == " ".join(c.split())
        runs_of_digits = "".join(x if x.isdigit() else " " for x in c).split()
        assert set(runs_of_digits) <= set(lexicon.SHORT_CODES)
    assert one(spark, X.clean, cleaned) == cleaned


@QUIETLY
@given(TEXTS)
def test_what_preparation_leaves(spark, texts):
    prepared, stop = one(spark, X.preprocess, texts), lexicon.stopwords()
    for p in prepared:
        assert all(w in lexicon.PROTECTED or (len(w) > 1 and w not in stop and w not in lexicon.SPELLINGS) for w in p.split())
    # Case, and white space at the ends, make no difference.
    assert one(spark, X.preprocess, [f" {t.upper()}\n" for t in texts if t.isascii()]) == [p for p, t in zip(prepared, texts, strict=True) if t.isascii()]


def test_hosts_of_many_labels(spark):
    host = "a." * 400 + "com"
    assert one(spark, X.replace_urls, [f"x {host}/y z", "b." * 3000 + "odd"]) == ["x urltoken z", "b." * 3000 + "odd"]


def test_console_safe(spark):
    assert one(spark, lambda c: X.console_safe(c, 4), ["čaj 🎉 ok", None, "ab"]) == ["?aj ...", None, "ab"]


def test_very_long_text(spark):
    long = "a." * 20_000 + "com " + "x" * 100_000
    assert one(spark, lambda c: F.length(X.preprocess(c)), [long])[0] > 0


def test_labels(spark):
    assert one(spark, L.canonical_label, ["scam", "SCAM", " ScAm ", "genuine", "Genuine ", "maybe", "", None]) == ["Scam", "Scam", "Scam", "Genuine", "Genuine", None, None, None]
    assert one(spark, L.canonical_source, ["Real", " odd ", "", None]) == ["Authentic", "odd", None, None]
    assert one(spark, L.is_bad_label, ["Scam", None, "x"]) == [False, True, True]
    assert one(spark, L.is_missing_label, ["NaN", "none", None, "x"]) == [True, True, True, False]
