"""The licence classifier on lines that are not its notices, against plain Python, and without its quick tests."""

import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import licences, notices

FOUND = [
    ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache"), ("LICENSED UNDER CC BY-NC 4.0.", "CC-BY-NC"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("All rights reserved.", "proprietary"), ("SPDX-License-Identifier: Apache-2.0", "Apache"), ("ISC License", "ISC"),
    ("Creative Commons Attribution 4.0 International", "CC-BY"), ("BSD 3-Clause", "BSD"), ("Copyright 2003 holder7. Licensed under the MIT License.", "MIT"), ("The Unlicense", "Unlicense"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense", "MIT"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "Unlicense"), ("* License: LGPL-3.0-only", "LGPL"), ("This module is free software under the MPL 2.0", "MPL"),
]
UNKNOWN = [
    "Released under the Foo License.", "Licensed under the Acme Public License, Version 7.", "Licensed under the EUPL-1.2", "Open Software License 3.0", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "licensed under the custom community terms of our own making, see the file", "Distributed under the terms of the Wombat Source License version 5.",
]
PLAIN = ["plain words of no kind at all", "They asked for permission to leave", "the software is slow and the law is old", "Sie kamen mit dem Auto", "", None, "\n \n"]


@pytest.fixture(scope="module")
def model(spark, sf):
    return licences.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_given_lines_are_no_notices():
    lines = [t.lower() for t, _ in FOUND[:5]]
    rows = licences._given(notices.FRAMES + notices.HELD_FRAMES, notices.NAMES, [], notices.NOTICES, []) + licences._given([], {}, [], notices.HELD_NOTICES, [])
    assert not [t for _, t in rows if t.lower().rstrip(".") in [x.rstrip(".") for x in lines]]


def test_families_and_unknown(spark, model):
    texts = [t for t, _ in FOUND] + UNKNOWN + PLAIN
    got = {}
    for r in licences.scanned(table(spark, texts), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (t, f) in enumerate(FOUND):
        assert {r.family for r in got[i]} == {f} and any(r.confirmed for r in got[i]), t
    for i in range(len(FOUND), len(FOUND) + len(UNKNOWN)):
        assert {(r.family, r.confirmed) for r in got[i]} == {("unknown", False)}, texts[i]
    assert not [texts[i] for i in got if i >= len(FOUND) + len(UNKNOWN)]


def test_units(spark, model):
    wrapped = "Some words\n\nThis program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General\nPublic License as published by the Free\nSoftware Foundation\n\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nend"
    got = {(r.paragraph, r.line, r.family) for r in licences.scanned(table(spark, [wrapped]), model).collect()}
    assert {(2, 1, "CC-BY-NC"), (2, 2, "MIT")} <= got and {(p, f) for p, _, f in got} == {(1, "GPL"), (2, "CC-BY-NC"), (2, "MIT")}


def plain_words(t):
    return re.findall(r"[^\W_]+(?:\.\d+)*", t.lower())


def test_against_plain_python(spark, model):
    """Probabilities and likeness of whole paragraphs, computed in plain Python from the model's tables."""
    weights = {r.gram: r.weights for r in model.weights.collect()}
    templates = {r.family: [[(x.word, x.idf) for x in t] for t in r.templates] for r in model.templates.collect()}
    texts = [t.replace("\n", " ") for t, _ in FOUND] + UNKNOWN + [t for own in notices.HELD_NOTICES.values() for t in own]
    got = {r.doc_id: r for r in licences.scanned(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        w = plain_words(t)
        grams = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        z = [(b + sum(weights[g][c] for g in grams if g in weights)) / model.temperature for c, b in enumerate(model.intercepts)]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e]
        if p[0] >= 0.5 or not grams & set(weights):
            assert i not in got
            continue
        best = max(range(2, len(p)), key=lambda c: p[c])
        family = model.classes[best]
        like = max(sum(x for word, x in own if word in w) / sum(x for _, x in own) for own in templates[family] if sum(x for _, x in own) > 0)
        assert got[i].probability == pytest.approx(p[best]) and got[i].likeness == pytest.approx(like)
        assert got[i].family == (family if p[best] >= model.threshold else "unknown")
        assert got[i].confirmed == (p[best] >= model.threshold and like >= licences.CONFIRMED)


def test_quick_tests_lose_nothing(spark, sf, model):
    """All units, scored without the tests for licence words, say the same as scanned() gives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(table(spark, [t for t, _ in FOUND] + UNKNOWN + [p for p in PLAIN if p]).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    every = licences.units(docs)
    free = licences.probabilities(every, model).where(F.get("p", F.lit(0)) < 0.5)
    gated = licences.probabilities(every.where(F.arrays_overlap("w", licences._array(model.licence_words))), model).where(F.get("p", F.lit(0)) < 0.5)
    assert free.count() == gated.count() > len(FOUND)
    first = [math.exp(x / model.temperature) for x in model.intercepts]
    assert first[0] >= sum(first[1:])  # a unit without any feature is of the class none


def test_whole_families_held_out(spark, model):
    """Notices that the fit did not see: whole ones of known families, and names of other families in sentences it did not see."""
    known = [(f, t) for f, own in notices.HELD_NOTICES.items() for t in own] + [(f, s.format(n)) for f, own in notices.NAMES.items() for n in own for s in notices.HELD_FRAMES]
    other = [("unknown", s.format(n)) for n in ("Kestrel License", "Open Data Charter", "PostgreSQL License", "Wombat Public License version 4") for s in notices.HELD_FRAMES[:3]]
    got = {r.doc_id: r.family for r in licences.scanned(table(spark, [t for _, t in known + other]), model).collect()}
    assert sum(got.get(i) == f for i, (f, _) in enumerate(known)) >= 0.9 * len(known)
    assert sum(got.get(i + len(known), "none") in ("unknown", "none") for i in range(len(other))) >= 0.9 * len(other)


def test_odd_and_empty(spark, odd, none, model):
    out = licences.scanned(odd, model)
    assert out.columns == ["doc_id", "paragraph", "line", "family", "probability", "likeness", "confirmed"]
    assert {r.family for r in out.collect()} <= {"unknown"}
    twice = table(spark, ["Released under the MIT License."]).union(table(spark, ["Released under the MIT License."]))
    assert [r.family for r in licences.scanned(twice, model).collect()] == ["MIT", "MIT"]
    assert licences.scanned(none, model).count() == 0 and licences.fit(none).classes == model.classes


def test_many_holders(spark, sf):
    own = spark.range(400).selectExpr("100000 + id as doc_id", "concat('Copyright ', 2000 + id % 25, ' holder', id, '. Licensed under the MIT License.\n', 'own words of file number', id) as text")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(own)
    assert [r.family for r in licences.scanned(own, licences.fit(docs)).collect()] == ["MIT"] * 400
