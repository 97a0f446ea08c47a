"""License scans against rules applied one by one in plain Python."""

import re

import duckdb
import pytest

from landspark.llm import license_rules, licenses

SCHEMA = "doc_id long, text string, row long, label string, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
TEXTS = [
    None, "", " \t.", "plain words only", "Licensed under CC BY-NC 4.0.", "CC BY cc-by Cc_By", "ÉCC BY cc bý émit license", "x" * 50000,
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 and MIT License", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and MIT License", "All rights reserved. Copyright (c) 2021",
    "https://creativecommons.org/licenses/by-nc-nd/4.0/ Creative Commons Attribution-NonCommercial-NoDerivs", "Mozilla Public License v. 2.0, or Mozilla Public License",
    "Tous droits réservés", "mit license " * 900 + "all rights reserved " * 300, "the BSD 3-Clause license; the New BSD License, and 0BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
]


def by_hand(text):
    """All matches of all rules, each compared with every other one."""
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    spaced = "".join(f" {w} " for w in words)
    found = []
    for k, r in enumerate(license_rules.rules()):
        if r.level < license_rules.BASE:
            found += [(spaced[:m.start()].count(" ") // 2, spaced[:m.end()].count(" ") // 2, r.level, k, r.label) for m in re.finditer(r.pattern, spaced)]
    kept = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)]
    base = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    labels = {d[4] for d in kept} | {b[1] for b in base}
    sure = max([license_rules.WEIGHT[d[2]] for d in kept] + [license_rules.WEIGHT[license_rules.BASE] for _ in base], default=0.0)
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), sure), kept


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t, i, "l", "w") for i, t in enumerate(TEXTS)] + [(3, TEXTS[8], 1, "l", "w")] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_report_against_hand_and_sql(spark, docs):
    got = licenses.license_report(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted([(d, *by_hand(t)[0]) for d, t in rows if not t or len(t) < 5000], key=key)
    long = {t[:3] for t in map(tuple, got.collect()) if t[1] > 1500}
    assert long == {(18, 2700, 300)}
    assert sorted([tuple(r) for r in got.filter("n_words < 1500 AND doc_id IS DISTINCT FROM 7").collect()], key=key) == [w for w in want if w[0] != 7]
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(db.execute(licenses.ORACLE).fetchall(), key=key) == sorted(map(tuple, got.collect()), key=key)
    assert licenses.license_report(docs.limit(0)).collect() == []


def test_named_licenses(spark, docs):
    labels = {t: l for t, l in zip(TEXTS, [by_hand(t)[0][5] for t in TEXTS[:-3]])}
    assert labels[TEXTS[4]] == "cc-by,cc-by-nc" and labels[TEXTS[8]] == "gpl,gpl-3.0" and labels[TEXTS[10]] == "mit" and labels[TEXTS[12]] == "gpl-2.0"
    assert labels[TEXTS[11]] == "apache-2.0" and labels[TEXTS[3]] == "" and "mpl-2.0" in labels[TEXTS[16]].split(",")
    spans = sorted((r.doc_id, r.start, r.end, r.label) for r in licenses.license_spans(docs.filter("doc_id IN (8, 9) AND row < 50")).collect())
    assert (8, 2, 11, "gpl-3.0") in spans or any(s[0] == 8 and s[3] == "gpl-3.0" for s in spans)
    assert len([s for s in spans if s[0] == 8]) == 1  # the shorter names inside are gone


def test_signatures():
    assert license_rules.compiled("a b|c? ..2 d") == " a (?: (?:b|c) )?(?: [^ ]+ ){0,2} d "
    rules = license_rules.rules()
    assert len(rules) > 400 and [r.level for r in rules] == sorted(r.level for r in rules)
    for r in rules:  # what a rule needs to see stands in every match, so the gate loses nothing
        assert f" {r.keyword} " in r.pattern and f"(?: {r.keyword} )?" not in r.pattern.replace(f" {r.keyword} ", "", 0)
