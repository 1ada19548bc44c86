import textwrap

import pytest

from credence.llm import licences as L
from tests.llm.fixtures import awkward, empty


def scanned(spark, texts):
    return [r["licences"] for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_templates_and_others(spark):
    texts = [t for ts in L.TEMPLATES.values() for t in ts]
    want = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    got = scanned(spark, texts)
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want)
    assert scanned(spark, L.OTHERS) == [""] * len(L.OTHERS)


@pytest.mark.parametrize("line, want", [("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Gehen wir mit dem Hund mit.", "")])
def test_lines_within_texts(spark, line, want):
    assert scanned(spark, [f"Thont the er.\n{line}\nAnd so on."]) == [want]


def test_unknown_is_what_nothing_speaks_for():
    families, weights, bias, temperature = L.model()
    assert families[int(bias.argmax())] == L.UNKNOWN and 0.2 < temperature < 5
    assert all(L.ANCHORS & set(g.split()) for g in weights)


def test_the_plan_against_brute_force(spark):
    """Every line of a small corpus, classified and confirmed one by one."""
    shapes: dict = {}
    for name, f, n, g in L.template_shapes():
        shapes.setdefault((name, f, n), set()).add(g)
    texts = [t for ts in L.TEMPLATES.values() for t in ts] + [" ".join(t.split()[2:]) for ts in L.TEMPLATES.values() for t in ts] + L.OTHERS + ["No such word", "the public library has a license to copy cd versions 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = L.paragraphs(docs)
    fitted = L.model(L._unknown_sample(units.selectExpr("unit", "explode(grams) as gram")))
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    for i, t in enumerate(texts):
        family, sure = L.predicted(t, fitted)
        found = set(L.grams(t))
        agree = max((len(found & g) / n for (_, f, n), g in shapes.items() if f == family), default=0.0)
        want = family if family != L.UNKNOWN and sure >= L.CONFIDENT and agree >= L.CONFIRM else ""
        assert got[i]["licences"] == want, (t, family, sure, agree)


def test_held_out_accuracy_and_calibration():
    accuracy, gap = L.calibration_error(L.model())
    assert accuracy >= 0.85 and gap <= 0.1


def test_spdx_tags(spark):
    texts = [f"// SPDX-License-Identifier: {i}" for ids in L.SPDX.values() for i in ids] + ["SPDX-License-Identifier: EPL-2.0", "/* SPDX-License-Identifier: LicenseRef-Own */"]
    want = [f for f, ids in L.SPDX.items() for _ in ids] + ["", ""]
    assert scanned(spark, texts) == want


def test_a_full_text_in_paragraphs(spark):
    mit = L.TEMPLATES["MIT"]
    text = "Copyright (c) 2024 Someone\n\n" + "\n\n".join("\n".join(textwrap.wrap(mit[k], 70)) for k in (2, 3, 4))
    row = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["licences"] == "MIT" and row["n_licence_paragraphs"] >= 1


def test_unknown_is_sampled_from_the_corpus(spark, monkeypatch):
    lines = [f"The license of car {i} was renewed at the public office." for i in range(30)] + ["Released under the MIT License."] * 3
    units = L.paragraphs(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).selectExpr("unit", "explode(grams) as gram")
    some = L._unknown_sample(units)
    assert len(some) == 30 and all("license" in g and "the mit license" not in g for g in some)
    monkeypatch.setattr(L, "UNKNOWN_SAMPLE", 7)
    assert len(L._unknown_sample(units)) == 7


def test_edges(spark):
    docs = awkward(spark)
    got = L.scan(docs).collect()
    assert len(got) == docs.count() and all(r["licences"] == "" for r in got)
    assert L.scan(empty(spark)).isEmpty()


def test_wrapped_templates(spark):
    long = {f: max(ts, key=len) for f, ts in L.TEMPLATES.items()}
    want = ["MIT", "GPL-3.0", "GPL-2.0", "LGPL", "AGPL-3.0", "BSD", "ISC"]
    assert scanned(spark, ["Thont the er.\n\n" + "\n".join(" * " + x for x in textwrap.wrap(long[f], 30)) + "\n\nAnd so on." for f in want]) == want


def test_noncommercial(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "The noncommercial radio played.", "He wrote, cc by post, to Raleigh, NC 4 times."]
    assert scanned(spark, texts) == ["CC-BY-NC", "CC-BY", "CC-BY-NC-SA", "CC-BY-NC-ND", "", ""]
