import pytest

from paigham.llm import p4_encoding as p
from tests.llm.conftest import pairs

TEXTS = ["Café Mirél. 50°C, £30", "یہ خبر آج دکان", "party 🎉 – “muft” • naya"]


@pytest.mark.parametrize("encoding", ["latin1", "cp1252", "cp1251", "cp1250", "cp437", "mac_roman", "cp1256"])
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(encoding, text):
    raw = text.encode()
    garbled = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)
    assert p.restore(f"abc. {garbled} xyz") == (f"abc. {text} xyz", True)


def test_twice_and_mixed():
    twice = "Café".encode().decode("cp1252").encode().decode("cp1252")
    assert p.restore(f"a {twice} b")[0] == "a Café b"
    mixed = f"{'Café'.encode().decode('cp1252')} x {'é'.encode().decode('cp437')}"
    assert p.restore(mixed)[0] == "Café x é"


@pytest.mark.parametrize("text", ["", "plain", "Élan Décor, IRMÃ LÃ. MAÇÃ E PÃO «khas»", "Тоuсһé Ѕоіréе Віnе", "جمع، کام", "10 × 12 €45 ½ kilo", f"IRMÃ{chr(0xA0)}LÃ{chr(0xA0)}x", "👨" + chr(0x200D) + "👩"])
def test_right_text_stays(text):
    assert p.restore(text) == (text, False)


def test_marks():
    assert p.restore(f"Na{chr(0xFFFD)}do") == (f"Na{chr(0xFFFD)}do", True)
    assert p.restore(f"{chr(0x93)}muft{chr(0x94)}") == ("“muft”", True)


def test_spans_are_well_formed():
    data = list(b"ab\xc3\xa9\xe2\x82\xac\xff\xc3") + [None, 0xA9] + list(b"\xed\xa0\x80\xf0\x9f\x8e\x89")
    for a, b in p.spans(data):
        bytes(data[a:b]).decode()
    assert list(p.spans(list(b"a\xc3\xa9\xc3\xa9b"))) == [(1, 5)]


def test_rows(rows):
    df = rows("row_id bigint, msg string", [(1, None), (2, ""), (3, "CafÃ©"), (4, "CafÃ©"), (5, "Café"), (6, "é" * 20_000)])
    assert pairs(p.found(df)) == [(3,), (4,)]
    assert p.restored(df).count() == 6
    assert p.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Привет, как дела", "Γειά σου Κόσμε", "नमस्ते दुनिया", "你好世界", "こんにちは", "안녕하세요", "שלום עולם"])
@pytest.mark.parametrize("encoding", ["cp1252", "latin1", "cp437", "mac_roman"])
def test_other_scripts_come_out_whole_or_stay(encoding, text):
    garbled = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    assert p.restore(f"ab {garbled} cd") == (f"ab {text} cd", True)


@pytest.mark.parametrize("text", ["Привет, как дела, ёлка, Ёж", "Γειά σου Κόσμε, Όχι", "नमस्ते", "你好世界", "안녕하세요"])
def test_other_scripts_that_are_right_stay(text):
    assert p.restore(text) == (text, False)


def test_few_letters_of_another_script_are_left_whole():
    for c in ("Пр", "Ωη", "ж"):
        garbled = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in c.encode())
        got = p.restore(f"x {garbled} y")[0]
        assert got in (f"x {garbled} y", f"x {c} y")


def test_garbled_more_than_a_dozen_times():
    text = "é"
    for _ in range(14):
        text = text.encode().decode("latin1")
    assert p.restore(f"caf{text}") == ("café", True)
