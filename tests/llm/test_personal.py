from calendar import monthrange

import pytest
from hypothesis import given
from hypothesis import strategies as st

from paigham.llm import p2_personal as p
from tests.llm.conftest import pairs

KEY = b"key"
NAMES = frozenset({"adeel", "danish"})


@given(st.text("0123456789", min_size=2, max_size=16))
def test_feistel_round_trip(digits):
    out = p.feistel(digits, KEY, "t")
    assert len(out) == len(digits) and out.isdigit()
    assert p.unfeistel(out, KEY, "t") == digits


def test_feistel_is_a_permutation():
    assert sorted(p.feistel(f"{i:03d}", KEY, "t") for i in range(1000)) == [f"{i:03d}" for i in range(1000)]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Call karein 0392-6379472.", {"phone"}),
        ("Ph: +92 300 1234567", {"phone"}),
        ("Mera naya number +1 (555) 555-0153 save kar lo", {"phone"}),
        ("call (0396) 931-4762", {"phone"}),
        ("WhatsApp ０３９２６３７９４７２", {"phone"}),
        ("SMS 8180510399 par bhejain. Dial *256845211#. TID 915337265", set()),
        ("Aap ka CNIC 96508-6478578-6 tasdeeq talab hai", {"identity"}),
        ("ID card passport YQ6288925 register hua", {"identity"}),
        ("Order no 522490778806453382, tracking 9650864785786", set()),
        ("Jawab kiran844 @ khat.invalid ko bhejain", {"email"}),
        ("CV: basit.bezmani(at)dakghar dot test", {"email"}),
        ("Parcel Makan no 13, Gali 4, Mohalla Kalarmandi, Bhitabara par", {"address"}),
        ("Pata: 87/B Orchard Avenue, near Bagh chowk, Bhitnagri.", {"address"}),
        ("House wiring sale. Street food mela. Block C ka bijli shutdown", set()),
        ("Janab Adeel Zakhtari sahib se milein.", {"name"}),
        ("dear rabail ishmari.", {"name"}),
        ("Dear user, Danish Khither Sweets se order", set()),
        ("Chamakcell Wallet ne bheja hai. Shukriya", set()),
        ("due 12/03/2024", set()),
        ("call 555-123-4567 or (555) 123-4567", {"phone"}),
        ("call 9876543210 today", {"phone"}),
        ("My name is Bilal Ahmed", {"name"}),
        ("12 Park Close, Leeds", {"address"}),
        ("drive 12 km, close at 5", set()),
        ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert set(p.redact(text, KEY, NAMES)[1]) == kinds


def test_equal_values_stay_linked_and_the_rest_unchanged():
    a, _ = p.redact("x 0392-6379472 y", KEY)
    b, _ = p.redact("z +92 392 6379472", KEY)
    assert a.startswith("x [PHONE:03") and a.endswith("] y") and a[2:-2] == b[2:]
    assert p.redact("x 0392-6379472 y", b"other")[0] != a
    date, _ = p.redact("due 12/03/2024 and 12/03/2024", KEY)
    first, second = date[4:].split(" and ")
    assert first == second and first[-5:] == "/2024"


def test_rows(rows):
    df = rows("row_id bigint, msg string", [(1, None), (2, ""), (3, "x" * 50_000 + " 0392-6379472"), (4, "0392-6379472 a@b.com"), (4, "0392-6379472")])
    assert pairs(p.found(df)) == [(3, "phone"), (4, "email"), (4, "phone"), (4, "phone")]
    assert p.redacted(df).where("redacted is null").count() == 1
    assert p.found(df.limit(0)).count() == 0


def test_different_dates_stay_different():
    for year, days in ((2023, 365), (2024, 366)):
        written = {f"{d:02d}/{m:02d}/{year}" for m in range(1, 13) for d in range(1, 32)}
        got = {w: p.placeholder("date", w, w, KEY) for w in written}
        assert set(got.values()) == written
        exists = lambda w: int(w[:2]) <= monthrange(int(w[6:]), int(w[3:5]))[1]
        assert all(exists(w) == exists(v) for w, v in got.items()) and sum(map(exists, got.values())) == days


@pytest.mark.parametrize("same", [("042-1234567", "+92 42 1234567", "0092421234567", "+92421234567"), ("0300 1234567", "+92 300 1234567", "00923001234567", "923001234567")])
def test_one_pseudonym_however_the_prefix_is_written(same):
    got = {p.redact(f"x {w} y", KEY)[0] for w in same}
    assert len(got) == 1 and next(iter(got)).startswith("x [PHONE:0")


def test_key_comes_from_the_configuration(spark, rows):
    df = rows("row_id bigint, msg string", [(1, "x 0392-6379472")])
    text = lambda: p.redacted(df).first()["redacted"]
    drawn = text()
    assert drawn == text()
    spark.conf.set(p.KEY_SETTING, "configured")
    try:
        assert text() == p.redact("x 0392-6379472", b"configured")[0] != drawn
    finally:
        spark.conf.unset(p.KEY_SETTING)


def test_tags_are_long_and_dates_keep_their_form():
    assert len(p.tag("name", "x", KEY)) == 16
    bare = p.placeholder("date", "3/3/2024", "3/3/2024", KEY)
    assert bare == "/".join(str(int(x)) for x in bare.split("/"))
