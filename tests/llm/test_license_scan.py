"""Licence paragraphs: held-out notices, clean prose, and the lines of the given documents."""

import re

import pytest

from sumwise.llm import license_scan as ls

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return ls.LicenseModel(spark.read.parquet(f"{FOLDER}/documents.parquet"))


@pytest.mark.parametrize(
    "line, family",
    [
        ("This file is licensed under the Apache License, Version 2.0", "Apache"),
        ("Code in this folder is released under the MIT license", "MIT"),
        ("licensed under the GNU General Public License version 2", "GPL"),
        ("Content licensed under CC BY-NC 4.0", "CC-BY-NC"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"),
        ("licensed under a Creative Commons Attribution 4.0 International License", "CC-BY"),
        ("# SPDX-License-Identifier: MPL-2.0", "MPL"),
        ("This library is licensed under the GNU Lesser General Public License", "LGPL"),
        ("All rights reserved. Unauthorized copying is strictly prohibited.", "proprietary"),
    ],
)
def test_notices_that_are_no_template(model, line, family):
    assert [f[1] for f in model.found(f"prose before\n{line}\nprose after")] == [family]


@pytest.mark.parametrize(
    "line",
    ["", "to the", "of this", "The licence of the driver was taken away.", "he may not use this in any form", "free of charge", "We moved to the public square",
     "Permission was refused by the committee without further comment.", "the general public", "version 2", "4.0", "under the terms of the treaty"],
)
def test_clean_prose(model, line):
    assert model.found(line) == []


LONG = [
    ("This repository and all of its documentation are released under the MIT License.", "MIT"),
    ("Copyright 2019 to 2024 by the authors of the parser, the tables and the tools around them, see the file of names for all "
     'of them. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache"),
    ("The driver took the letter to the house of a friend. " * 40 + "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. "
     + "The rest of the story is told by the friend. " * 40, "CC-BY-SA"),
]


@pytest.mark.parametrize("line, family", LONG)
def test_notice_within_a_long_line(model, line, family):
    assert [f[1] for f in model.found(line)] == [family]


def test_long_lines_with_a_notice_are_no_unknown_sample(spark):
    rows = [(i, f"{LONG[i % 3][0]}\nThe driver of house {i} went to the town.") for i in range(60)]
    rows += [(100, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line): r.family for r in ls.license_paragraphs(docs).collect()}
    assert got == {(i, 0): LONG[i % 3][1] for i in range(60)} | {(100, 0): "MIT"}


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {(r.doc_id, r.line): r.family for r in ls.license_paragraphs(docs).collect()}
    named = {"Apache": "Apache", "MIT": "MIT", "GNU": "GPL", "CC": "CC-BY-NC"}
    expected = {}
    for r in docs.collect():
        for at, line in enumerate((r.text or "").split("\n")):
            if m := re.search(r"(?:licensed|Licensed|Released) under (?:the )?(Apache|MIT|GNU|CC)\b", line):
                if len(line) < 100:
                    expected[r.doc_id, at] = named[m[1]]
    assert expected and got == expected


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "x\n\nReleased under the MIT License."), (3, "x\n\nReleased under the MIT License.")]
    rows += [(4, "words " * 20000 + "\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, family string")
    got = sorted(((r.doc_id, r.line, r.family) for r in ls.license_paragraphs(docs).collect()), key=str)
    assert got == sorted([(None, 0, "MIT"), (3, 2, "MIT"), (3, 2, "MIT"), (4, 1, "CC-BY-NC")], key=str)
    assert ls.license_paragraphs(docs.limit(0)).collect() == []


def test_sample_is_the_same_for_every_layout(spark, monkeypatch):
    """Files and copies of documents change nothing about the paragraphs drawn."""
    monkeypatch.setattr(ls, "MOST_NEGATIVES", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many, copied = (ls.LicenseModel(d) for d in (docs.coalesce(1), docs.repartition(20), docs.union(docs).repartition(3)))
    assert one.seen and one.seen == many.seen == copied.seen
    assert (one.weights.round(6) == many.weights.round(6)).all()


def test_every_paragraph_counts(spark, monkeypatch):
    """Rarity, model and threshold come from all paragraphs, not from as many as MOST_NEGATIVES."""
    monkeypatch.setattr(ls, "MOST_NEGATIVES", 40)
    rows = [(i, f"word{i} stays under the roof of house{i} all day long with friend{i} and friend{i + 1} of old") for i in range(400)]
    model = ls.LicenseModel(spark.createDataFrame(rows[:399] + [(400, "this file license is a plain paragraph about some other things to be told")], "doc_id long, text string"))
    patterns = model.unknown(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert patterns.agg({"n": "sum"}).first()[0] == 400
    assert model.seen["under the"] == pytest.approx(399 * 40 / 400)
    assert 0 < model.seen["this file"] < 1
