import time

import numpy as np
import pytest

from credence.functions.excerpts import SEEDED, aligned, folded, located, regions


def brute(needle, text):
    """(edits, start, end) by a whole table of edit distances; ties to the first end, then the shortest."""
    m, n = len(needle), len(text)
    best = None
    column = [(i, 0) for i in range(m + 1)]  # edits, start (as late as can be)
    for e in range(1, n + 1):
        new = [(0, e)]
        for i in range(1, m + 1):
            options = [(column[i - 1][0] + (needle[i - 1] != text[e - 1]), column[i - 1][1]), (column[i][0] + 1, column[i][1]), (new[i - 1][0] + 1, new[i - 1][1])]
            new.append(min(options, key=lambda x: (x[0], -x[1])))
        column = new
        if best is None or column[m][0] < best[0]:
            best = (column[m][0], column[m][1], e)
    return best


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        i, kind = int(rng.integers(0, len(out))), rng.integers(0, 3)
        if kind == 0:
            out[i] = str(rng.choice(letters))
        elif kind == 1:
            out.insert(i, str(rng.choice(letters)))
        elif len(out) > 2:
            out.pop(i)
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_alignment_against_the_whole_table(letters):
    rng, letters = np.random.default_rng(len(letters)), list(letters)
    for _ in range(150):
        text = "".join(rng.choice(letters, rng.integers(1, 120)))
        a = int(rng.integers(0, len(text)))
        needle = edited(rng, text[a : a + int(rng.integers(2, 40))] + "a", int(rng.integers(0, 6)), letters)
        found = brute(needle, text)
        assert aligned(needle, text) == (found if found[0] < len(needle) else None)
        # few edits: the regions hold the best stretch
        if found[0] <= len(needle) // SEEDED:
            seen = [(x[0], x[1] + a, x[2] + a) for a, z in regions(needle, text) for x in [aligned(needle, text[a:z])] if x]
            assert min(seen, key=lambda x: (x[0], x[2])) == found


def test_edited_excerpts_are_found():
    rng, letters = np.random.default_rng(0), list("abcdefghijklmnop   ")
    for _ in range(60):
        content = "".join(rng.choice(letters, 3000)).strip()
        a = int(rng.integers(0, 2800))
        excerpt = edited(rng, content[a : a + 80], 8, list("XYZ"))
        start, end, how = located(excerpt, content)
        assert how == "fuzzy" and abs(start - a) <= 10 and abs(end - a - 80) <= 10


def test_kinds():
    assert located("likes tea", "Alice likes tea.") == (6, 15, "exact")
    assert located(" LIKES\n tea", "Alice likes  tea.") == (6, 16, "normalized")
    assert located("Alice likse tea", "Well: Alice likes tea") == (6, 21, "fuzzy")
    assert located("straße İ x", "die STRASSE... Straße İ X") == (15, 25, "normalized")
    assert located("zzzz qqqq", "Alice likes tea") == located("x", "x") == located(None, "x y") == located("x y", None) == (None, None, "not_found")
    assert located("abcdefghij" * 2, "abcde" + "-" * 50 + "fghij") == (None, None, "not_found")


def test_folding_keeps_places():
    text = "  A\t\nbİ  ß "
    plain, places = folded(text)
    assert plain == "a bi̇ ß" and [text[i] for i in places] == ["A", "\t", "b", "İ", "İ", " ", "ß"]
    assert folded(" \n")[0] == ""


def test_long_texts_are_linear():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(2000)]
    content = " ".join(rng.choice(words, 400_000))[:2_000_000]
    excerpt = content[1_500_000:1_500_200].strip()
    excerpt = excerpt[:50] + "#" + excerpt[51:120] + excerpt[123:]
    took = []
    for n in (100_000, 2_000_000):
        part = content[-n:] if n > 500_000 else content[1_450_000:1_550_000]
        begun = time.time()
        assert located(excerpt, part)[2] == "fuzzy"
        took.append(time.time() - begun)
    assert took[0] < 0.3 and took[1] < 6

def test_located():
    content = "First line.\n  The  QUICK brown\tfox jumps.  And then it ran off into the woods at night."
    assert located("First line", content) == (0, 10, "exact")
    a, b, how = located("the quick BROWN fox", content)
    assert how == "normalized" and content[a:b] == "The  QUICK brown\tfox"
    a, b, how = located("And then it rann off in the woods at night", content)
    assert how == "fuzzy" and content[a:b].startswith("And then it ran") and content[a:b].rstrip(".").endswith("at night")
    assert located("nothing of this kind stands there", content)[2] == located("", content)[2] == located("x", None)[2] == "not_found"
    assert located("straße İ x", "die STRASSE... Straße İ X")[2] == "normalized"


def test_few_characters_are_aligned_in_a_text_that_is_alike_all_over(monkeypatch):
    from credence.functions import excerpts as E

    rng = np.random.default_rng(4)
    block = "".join(rng.choice(list("abcdefghij "), 60))
    near = ["".join(c if rng.random() > 0.25 else "z" for c in block) for _ in range(300)]
    text = " ".join([*near, "x" + block[1:40] + "yy" + block[42:] + "x", *near])
    needle, (low, places) = folded(block)[0], folded(text)
    edits, a, z = aligned(needle, low)
    seen = []
    plain = E._distances
    monkeypatch.setattr(E, "_distances", lambda bits, m, part, anchored: (seen.append(len(part)), plain(bits, m, part, anchored))[1])
    assert E.located(block, text) == (places[a + (low[a] == " ")], places[z - 1 - (low[z - 1] == " ")] + 1, "fuzzy") and 0 < edits < 6
    assert sum(seen) < len(text) / 10
