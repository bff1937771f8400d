import pytest
from conftest import DATA
from helpers import EDGES, docs

from kinetrace.llm import licenses, queries
from kinetrace.llm.license_templates import OTHERS, REWORDED, STRANGERS, STRANGERS_HELD_OUT, TEMPLATES


#: Neither trained nor calibrated on.
UNSEEN_STRANGERS = ["Available under the Creative Commons Attribution-NoDerivatives 4.0 License.", "Licensed under the zlib licence.", "Boost Software License 1.0", "Distributed under the Open Software License 3.0.", "This code is under the Educational Community License, version 2.0."]
UNSEEN_WORDINGS = {
    "mit": "Source code is released under the MIT license.",
    "apache-2.0": "Licensed under the Apache License 2.0, see the file.",
    "gpl-3.0": "This program is under the GNU General Public License, version 3.",
    "mpl-2.0": "The files are under the Mozilla Public License, version 2.0.",
    "cc-by": "This article is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "The pictures are licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "Copyright 2021. All rights reserved.",
}


def test_lists_are_disjoint():
    seen = {*STRANGERS, *STRANGERS_HELD_OUT, *(t for texts in [*TEMPLATES.values(), *REWORDED.values()] for t in texts)}
    assert not seen & {*UNSEEN_STRANGERS, *UNSEEN_WORDINGS.values()} and not {*STRANGERS} & {*STRANGERS_HELD_OUT}


def test_notices_never_seen(spark):
    """No stranger is taken for a family; most wordings are named rightly, the rest unknown."""
    got = licenses.scan(docs(spark, dict(enumerate(UNSEEN_STRANGERS)))).collect()
    assert [r for r in got if r.family != "unknown" or r.confirmed] == []
    got = {r.doc_id: r.family for r in licenses.scan(docs(spark, dict(enumerate(UNSEEN_WORDINGS.values())))).collect()}
    named = [got.get(i) for i in range(len(UNSEEN_WORDINGS))]
    assert all(n in (f, "unknown", None) for n, f in zip(named, UNSEEN_WORDINGS, strict=True))
    assert sum(n == f for n, f in zip(named, UNSEEN_WORDINGS, strict=True)) >= 5


@pytest.mark.parametrize("family", list(TEMPLATES))
def test_notices_are_found(spark, family):
    texts = dict(enumerate(TEMPLATES[family]))
    got = {r.doc_id: r for r in licenses.scan(docs(spark, {i: f"first line\n{t}\nlast" for i, t in texts.items()})).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert (got[i].family, got[i].paragraph, got[i].confirmed) == (family, 1, True)
        assert got[i].probability == pytest.approx(licenses.classify(t)[1], abs=2e-6)


def test_other_sentences_are_left_alone(spark):
    assert licenses.scan(docs(spark, dict(enumerate(OTHERS)))).where("confirmed").count() == 0


def test_other_licences_are_unknown(spark):
    """Licences of no family, those that training never saw among them, and wordings it never saw."""
    strangers = [*STRANGERS, *STRANGERS_HELD_OUT, "Licensed under the Eclipse Public License 2.0", "This work is under CC0 1.0 Universal", "ISC License"]
    got = licenses.scan(docs(spark, dict(enumerate(strangers)))).collect()
    assert [r for r in got if r.family != "unknown" or r.confirmed] == []
    reworded = [(family, t) for family, texts in REWORDED.items() for t in texts]
    got = {r.doc_id: r.family for r in licenses.scan(docs(spark, {i: t for i, (_, t) in enumerate(reworded)})).collect()}
    assert all(got.get(i) in (family, "unknown") for i, (family, _) in enumerate(reworded))
    assert sum(got.get(i) == family for i, (family, _) in enumerate(reworded)) >= 14


def test_lines_that_are_not_looked_at_are_no_findings(spark):
    """The test for speaking words loses no line of the table that the classifier alone would name."""
    lines = {line for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for line in r.text.split("\n")}
    named = {line for line in lines if licenses.classify(line)[0] != "unknown"}
    found = licenses.suspects(docs(spark, dict(enumerate(sorted(named)))), licenses.train())
    assert found.count() == len(named) > 0


def test_edges(spark):
    assert licenses.scan(docs(spark, EDGES)).count() == 0
    assert licenses.scan(docs(spark, EDGES).limit(0)).count() == 0
    twice = licenses.scan(docs(spark, [(1, "All rights reserved."), (1, "All rights reserved.")]))
    assert twice.count() == 2


def test_whole_table_against_a_search_for_notices(spark):
    known = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    want = sorted((r.doc_id, n, known[line]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for n, line in enumerate(r.text.split("\n")) if line in known)
    df = queries.op9_license_scan(spark, DATA)
    assert sorted((r.doc_id, r.paragraph, r.family) for r in df.where("confirmed").collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
