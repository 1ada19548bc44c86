import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from credence.llm import pii
from tests.llm.fixtures import awkward, empty

P = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive(t):
    out = []
    for kind, p in P.items():
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(P).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123459+@.- ()ab%é", max_size=50))
def test_base_spans(t):
    assert pii.base_spans(t) == naive(t)


@pytest.mark.parametrize("t, want", [
    ("mail john [at] mail (dot) example.com now", [("email", "john [at] mail (dot) example.com")]), ("call ＋１ (０１７) 555-7713 please", [("phone", "＋１ (０１７) 555-7713")]),
    ("to jane dot doe at example dot org today", [("email", "jane dot doe at example dot org")]), ("is one nine two dot one six eight dot one dot five ok", [("ip", "one nine two dot one six eight dot one dot five")]),
    ("four four one seven seven four four two eight zero three five one five four seven", [("card", "four four one seven seven four four two eight zero three five one five four seven")]),
    ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]), ("4417​7442 8035 1547", [("card", "4417​7442 8035 1547")]),
    ("meet at noon on the dot, come what may", []), ("un un un", []), ("He is one of two at three", []), ("plain words only", []),
])
def test_disguises(t, want):
    base, every = pii.find(t)
    assert base == naive(t) and [(k, t[a:b]) for k, a, b in every] == want or (base and [(k, t[a:b]) for k, a, b in every][0] in want)


def test_base_spans_stay():
    t = "a@b.co and +1 (017) 555-7713, c [at] d.org"
    base, every = pii.find(t)
    assert set(base) < set(every) and len(every) == len(base) + 1
    assert pii.redacted(t, every) == "<EMAIL> and <PHONE>, <EMAIL>"


def test_long_texts_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000, "at dot " * 40_000):
        pii.find(t)


def test_many_spans_and_many_parts():
    t = "a@b.co and c [at] d.org, " * 20_000
    base, every = pii.find(t)
    assert len(base) == 20_000 and len(every) == 40_000
    t = "ann dot bea dot cleo dot dora dot eve at mail dot a dot b dot c dot d dot example dot org"
    assert [(k, t[a:b]) for k, a, b in pii.find(t)[1]] == [("email", t)]


def test_edges(spark):
    docs = awkward(spark)
    got = pii.detect(docs).collect()
    assert len(got) == docs.count() and all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    out = pii.redact(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert pii.detect(empty(spark)).isEmpty() and pii.redact(empty(spark)).isEmpty()


@pytest.mark.parametrize("t, want", [
    ("to jane[@]example[.]com now", ("email", "jane[@]example[.]com")), ("host 10[.]0[.]0[.]1 is up", ("ip", "10[.]0[.]0[.]1")), ("host 192 dot 168 dot 1 dot 5 is up", ("ip", "192 dot 168 dot 1 dot 5")),
    ("four, four, one, seven, seven, four, four, two, eight, zero, three, five, one, five, four, seven", ("card", "four, four, one, seven, seven, four, four, two, eight, zero, three, five, one, five, four, seven")),
    ("write to anna at firma dot pl please", ("email", "anna at firma dot pl")), ("call +⁴⁹ 170 555 7713", ("phone", "+⁴⁹ 170 555 7713")), ("they look at the dot on the wall", None), ("4417, 7442, 8035, 1547", None),
])
def test_triggers_miss_none(t, want):
    assert [(k, t[a:b]) for k, a, b in pii.find(t)[1]] == ([want] if want else [])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["jane", "a1", "[", "]", "(", ")", "@", ".", " ", " ", "at", " dot ", "DOT", "punkt", "one", "fÜnf", "un", "plus ", ",", "-", "7", "192", "²", "ｅ"]), max_size=14).map("".join))
def test_triggers_change_nothing(t):
    got, trigger = pii.find(t), pii._DISGUISE_TRIGGER
    pii._DISGUISE_TRIGGER = re.compile("")
    try:
        assert got == pii.find(t)
    finally:
        pii._DISGUISE_TRIGGER = trigger


@pytest.mark.parametrize("text", ["see b [dot] c{}x", "see b dot c{}x", "a [at] b{}[dot] c", "a{}at{}b", "one two{}three", "[{}(", "a@b (dot){}(dot) c"])
def test_long_white_space_is_linear(text):
    began = time.time()
    pii.find(text.replace("{}", " " * 300_000))
    assert time.time() - began < 1


def test_frames_with_the_space_around_them():
    found = lambda t: [x[0] for x in pii.find(t)[1]]
    assert found("me [at] my  ( dot )\thost.org") == ["email"] and found("me [at] [dot] org") == []
    p = pii.Plain("a [dot] [dot] b (dot)c - <.> d")
    pii._disguises(p)
    assert p.text == "a [dot] [dot] b.c -.d"
