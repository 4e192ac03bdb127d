import unicodedata

import pytest

from locusmill.llm import lookalike as L

SCHEMA = "doc_id bigint, text string, look string"


def form(counts=None):
    return L.Rewriter(L.representatives(counts or {ord(c): 100 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -"}))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ﬁne", "fine"), ("oﬃce", "office"), ("Ａｂｃ１２！", "Abc12!"), ("é", "é"), ("é", "е́"), ("è", "ѐ"), ("ё", "ë"), ("pаypаl", "paypal"),
        ("Αθ", "Aθ"), ("a​b‌c‍d⁠e﻿f­g", "abcdefg"), ("a b c d　e f", "a b c d e f"), ("a‑b‐c－d", "a-b-c-d"), ("e​́", "é"), ("f​i", "ﬁ"), ("K", "K"), ("Å", "Å"), ("ặ", "ặ"), ("ặ", "ặ"), ("ｅ́", "é"),
        ("\u0475\u03bd", "vv"), ("\u04cf", "l"), ("\u04c0", "I"), ("\u03c1", "p"), ("\u0585\u057d\u0578\u0570", "ounh"), ("\u054f\u0555\u054d", "SOU"), ("\u03dc\u0474\u04ae", "FVY"), ("a\U000e0100\U000e0041b\U0001d173c", "abc"),
    ],
)
def test_same_look(a, b):
    rw = form()
    assert rw(a) == rw(b)
    assert rw(rw(a)) == rw(a)


@pytest.mark.parametrize(("a", "b"), [("l", "1"), ("I", "l"), ("a", "A"), ("e", "é"), ("a\nb", "a b"), ("a\nb", "ab"), ("rn", "m"), ("—", "-"), ("²", "2"), ("ß", "ss"), ("ſ", "s"), ("О", "0"), ("", " ")])
def test_other_look(a, b):
    rw = form()
    assert rw(a) != rw(b)


def test_representative_follows_frequency():
    rep = L.representatives({ord("а"): 9, ord("a"): 2})
    assert rep["a"] == "а" and "а" not in rep
    assert L.representatives({ord("а"): 2, ord("a"): 2})["а"] == "a"
    assert all(v == L.Rewriter(rep)(v) or unicodedata.normalize("NFC", v) == L.Rewriter(rep)(v) for v in rep.values())


def test_pairs_brute_force(spark):
    base = ["paypal", "pаypal", "ра" + "ypal", "fine", "ﬁne", "fine", "", "​", None, "x" * 50_000, "x" * 49_999 + "х", "solo"]
    docs = [(i, t, "clash") for i, t in enumerate(base)]
    df = spark.createDataFrame(docs + [(None, "fine", "x"), (3, "ﬁne", "repeated id")], SCHEMA)
    rw = L.Rewriter(L.representatives(L.code_point_counts(df)))
    want = {(i, j) for i, a, _ in docs for j, b, _ in docs if i < j and a is not None and b is not None and a != b and rw(a) == rw(b)}
    got = [tuple(r) for r in L.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(3, 5)} and (3, 5) not in want and (6, 7) in want
    out = {r.doc_id: r for r in L.one_form(df).collect()}
    assert out[8].text is None and out[6].text == "" and out[0].look == "clash" and out[0].text == out[2].text
    assert L.look_alike_pairs(df.limit(0)).count() == 0


def test_many_copies_are_not_paired(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'same text' as text").unionByName(spark.createDataFrame([(9999, "same tехt")], "doc_id bigint, text string"))
    assert L.look_alike_pairs(df).count() == 4000


@pytest.mark.parametrize("cp", [0xE0001, 0xE0020, 0xE007F, 0xE0100, 0xE01EF, 0x1D173])
def test_no_width_beyond_the_first_plane(cp):
    assert form()(f"pay{chr(cp)}pal") == "paypal"


def test_visible_letters_beyond_the_first_plane_stay():
    assert form()("a\U00020000\U000110bd\U0001f600") == "a\U00020000\U000110bd\U0001f600"
