import re

import pytest

from seqloom.llm import licenses

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    w, at = words(text), []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return w, sorted(at)


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scanned(docs).orderBy("doc_id").collect()]


def test_base_against_brute_force(spark, documents, texts, odd):
    more = ["Under the MIT License. under-the-mit_license", "CC BY-NC and cc by nc cc by nc", "Apache License, Version 2.0", "under the mit", "", "cc", "mit license " * 3, "ﬁx under the mit license É", "Kelvin under the MIT licenſe"]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    texts = dict(texts) | {10_000 + k: t for k, t in enumerate(more)}
    for r in licenses.scanned(docs).collect():
        w, at = base(texts[r.doc_id])
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None)), texts[r.doc_id][:80]
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scanned(odd).columns == COLUMNS


def test_every_notice_is_found_and_no_kin_of_it(spark):
    for with_noise in (False, True):
        texts = [("Some words before. " * 30 if with_noise else "") + t.replace("!", "").upper() + (" And some behind." if with_noise else "") for _, t in licenses.NOTICES]
        for (label, notice), got in zip(licenses.NOTICES, labels(spark, texts)):
            assert got == label, notice


@pytest.mark.parametrize("change", ["put in", "left out", "changed"])
def test_neighbouring_diagonals_are_one_place(spark, change):
    notice = dict((k, t) for k, t in licenses.NOTICES if len(t.split()) > 30)["gpl-3"].replace("!", "").split()
    for at in (5, 9):
        w = list(notice)
        if change == "put in":
            w.insert(at, "really")
        elif change == "left out":
            del w[at]
        else:
            w[at] = "other"
        found = licenses.spans(spark.createDataFrame([(1, "x " * 50 + " ".join(w) + " y" * 20)], "doc_id long, text string")).where("name is not null").collect()
        assert {r.label for r in found} == {"gpl-3"} and len(found) == 1
        assert 50 <= found[0].start <= 52 and found[0].stop <= 50 + len(w) and found[0].covered >= 0.8 * found[0].size


def test_what_is_no_notice(spark):
    none = ["the mit license", "licensed under", "this program is free software", "permission is hereby granted to leave", "gnu general public", "the software the software the software", "version 3 of the license " * 50]
    assert labels(spark, none) == [""] * len(none)
    # Parts of a notice far apart are no place.
    apart = "this program is free software you can redistribute it " + "filler word here " * 40 + " the gnu general public license as published " + "more words stand here " * 40 + "either version 3 of the license"
    assert labels(spark, [apart]) == [""]
    assert labels(spark, ["Licensed under the MIT License. " * 2000]) == ["mit"]
    many = licenses.scanned(spark.createDataFrame([(1, "Licensed under the MIT License. " * 2000)], "doc_id long, text string")).first()
    assert (many.n_base, many.first_word, many.last_word) == (2000, 1, 1 + 5 * 1999)


def test_odd_rows(spark, odd, none):
    got = licenses.scanned(odd).collect()
    want = odd.collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((r.doc_id or 0, len(words(r.text))) for r in want)
    assert all((r.n_base, r.first_word, r.base_labels, r.labels, r.score) == (0, None, "", "", 0.0) for r in got)
    assert licenses.scanned(none).count() == 0
    twice = spark.createDataFrame([(None, "under the mit license", "a", 1)] * 2 + [(None, None, "b", 2)], "doc_id long, text string, name string, row int")
    assert sorted(map(tuple, licenses.scanned(twice).collect()), key=str) == [(None, 0, 0, None, None, "", "", 0.0), *[(None, 4, 1, 0, 0, "mit", "mit", 1.0)] * 2]


def test_plan_is_native_and_shuffles_once(odd):
    plan = licenses.scanned(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|SortMergeJoin|CartesianProduct", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(row", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) <= 2
