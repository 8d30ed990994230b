from collections import defaultdict

import pytest

from tidemark.llm import patents, queries, subjects
from tidemark.session import read_table

TEXT = """Abstract:
A gear shaft and a sealing ring cooperate.

Detailed description
Prior documents describe pollen filter; they cannot be transferred without effort.

Claims:
1. A pump comprising: a gear shaft; and a sealing ring.
"""


def test_sections():
    parts = patents.sections(patents.normal(TEXT))
    assert "gear shaft" in parts["abstract"] and "pollen" in parts["description"] and parts["claims"].strip().startswith("1.") and "open" not in parts
    assert "pollen" not in patents.invention(patents.normal(TEXT))
    whole = patents.normal("Summary\nA gear shaft. The gear shaft turns.")
    assert patents.invention(whole).count("gear shaft") == 2
    padded = patents.normal("Abstract\nA gear shaft.\n" + " " * 80 + "Description" + " " * 80 + "\npollen filter\nClaims\n1. A pump.")
    assert "pollen" not in patents.invention(padded)
    marked = patents.normal("ABRÉGÉ\nUn a. [claim 1] Dispositif b. [claim 2] c")
    assert patents.sections(marked)["claims"].startswith("[claim 1]")
    assert patents.sections(patents.normal("摘要\n甲\n\n权利要求书\n1. 乙"))["claims"].strip() == "1. 乙"


def test_normal_form():
    assert patents.normal("Ｇｅａｒ sha­ft​ Ö’s  x-\n y") == "gear shaft ö's xy"


def test_phrases():
    assert {"a", "a b", "b", "c"} <= patents.phrases("a b, c") and "b c" not in patents.phrases("a b, c")
    assert {"电极组", "电极"} <= patents.phrases("包括电极组")


def test_matcher_takes_the_longest_at_word_bounds():
    m = subjects.Matcher(["cell", "liquid crystal cell", "电极"])
    assert m.find("a liquid crystal cell and cells in excellent cellar") == ["liquid crystal cell", "cell"]
    assert m.find("包括电极组") == ["电极"] and subjects.Matcher([]).find("x") == []


def test_assignment():
    model = subjects.Model({}, 100.0, 0.2, {None: 2.0, "b": 0.5})
    assert model.assign({}) == [] and model.assign({"a": 9.0, "b": 1.0}) == ["a"] and model.assign({"a": 1.9}) == []
    assert model.assign({"a": 2.0, "b": 2.0, "c": 2.0}) == ["a", "b", "c"] and model.assign({"b": 0.6}) == ["b"]


def test_length_and_repeats_count_less_and_less():
    weights = {"gear": ("mech", 2.0), "seed": ("bio", 2.0)}
    m = subjects.Matcher(weights)
    short, long = (subjects.score("Claims\n1. a gear" + " x" * n, m, weights, 100.0)["mech"] for n in (5, 2000))
    assert short > 3 * long
    once, twice, often = (subjects.score("Claims\n" + "gear " * n + "x " * (100 - n), m, weights, 100.0)["mech"] for n in (1, 2, 50))
    assert once < twice < 2 * once and often < 2.0 * (subjects.SATURATION + 1)


def test_a_stray_term_labels_nothing():
    """Thresholds from held-out scores: what raters never confirm stays below."""
    held = [({"mech": 10.0 + k, "bio": 1.0 + k / 100}, {"mech"}) for k in range(30)] + [({"bio": 9.0 + k}, {"bio"}) for k in range(30)]
    share, least = subjects.calibrate(held)
    model = subjects.Model({}, 100.0, share, least)
    assert model.assign({"mech": 12.0, "bio": 1.2}) == ["mech"] and model.assign({"bio": 1.2}) == [] and model.assign({"bio": 12.0}) == ["bio"]
    assert subjects.calibrate([]) == (subjects.DEFAULT_SHARE, {None: subjects.DEFAULT_SCORE})
    few = subjects.calibrate([({"a": 5.0}, {"a"})] * 3)[1]
    assert set(few) == {None} and few[None] < 5


TERMS = [("mech", "en", "gear shaft"), ("mech", "en", "sealing ring"), ("bio", "en", "pollen filter"), ("bio", "en", "seed tray"), (None, "en", "x"), ("bio", "en", None), ("mech", "en", "shared"), ("bio", "en", "shared")]


def tables(spark, documents, labels=()):
    return (
        spark.createDataFrame(list(documents), "doc_id bigint, text string").selectExpr("*", "1 as area", "2 as areas"),
        spark.createDataFrame(TERMS, "area string, lang string, term string"),
        spark.createDataFrame(list(labels), "label_id bigint, doc_id bigint, area string, rater string"),
    )


def test_unusual_tables(spark):
    documents = [(1, TEXT), (2, None), (3, ""), (4, " \n"), (5, "nothing known"), (6, TEXT + "x " * 100_000), (7, TEXT + "The gear shaft turns the sealing ring. " * 5000), (1, TEXT), (None, TEXT)]
    got = {(r["doc_id"], r["area"]) for r in subjects.subject_areas(*tables(spark, documents)).collect()}
    assert got == {(1, "mech"), (7, "mech"), (None, "mech")}  # the terms of text 6 are too few for its length
    d, t, l = tables(spark, documents, [(1, 1, "mech", "r"), (2, 99, "bio", "r"), (3, None, "bio", "r"), (4, 1, None, "r")])
    assert subjects.subject_areas(d, t, l).count() == 3
    assert subjects.subject_areas(d.limit(0), t, l).count() == 0 == subjects.subject_areas(d, t.limit(0), l.limit(0)).count()


def test_held_out_accuracy(spark):
    """Fitted on the raters' labels of other documents, the areas of those held out agree with their raters, but for the raters' errors."""
    folder = "/root/testdata/sf0.1"
    documents, terms, labels = (read_table(spark, folder, t) for t in ("documents", "subject_terms", "subject_labels"))
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got, said = defaultdict(set), defaultdict(set)
    for r in subjects.subject_areas(documents, terms, fitted).where("doc_id % 2 = 1").collect():
        got[r["doc_id"]].add(r["area"])
    for r in held.join(documents.where("length(trim(text)) > 0").select("doc_id"), "doc_id").collect():
        said[r["doc_id"]].add(r["area"])
    right = sum(len(got[d] & said[d]) for d in said)
    assert right / sum(len(got[d]) for d in said) > 0.94 and right / sum(map(len, said.values())) > 0.94


def test_the_sample_bounds_what_comes_back(spark, monkeypatch):
    """Twice the labels beyond SAMPLE leave the sample, and the rows that come to the driver, as many."""
    monkeypatch.setattr(subjects, "SAMPLE", 60)
    folder = "/root/testdata/sf0.01"
    documents, terms, labels = (read_table(spark, folder, t) for t in ("documents", "subject_terms", "subject_labels"))
    sizes, rows = [], []
    scores = subjects._held_out_scores
    monkeypatch.setattr(subjects, "_held_out_scores", lambda sample, models: rows.append(scores(sample, models)) or rows[-1])
    for part in (labels.where("label_id % 2 = 0"), labels):
        sizes.append(len(subjects.fit(documents, terms, part).weights))
    assert labels.select("doc_id").distinct().count() > 150
    assert all(0 < len(r) <= 60 for r in rows) and abs(sizes[0] - sizes[1]) < 0.35 * sizes[0]


def test_composition(spark, small):
    from collections import Counter

    rows, found = queries.p9_composition(spark, small).collect(), [tuple(r) for r in queries.p9_found(spark, small).collect()]
    assert {r["area"]: r["documents"] for r in rows} == Counter(a for _, a in found)
    known = len({d for d, _ in found})
    assert all(r["share"] == pytest.approx(r["documents"] / known, abs=1e-6) for r in rows)
