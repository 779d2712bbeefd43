"""Licence scan against a plain version over all windows, and its defined cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from feira.llm import license_scan
from feira.llm.license_scan import PHRASES, templates_of, words_of

DOCS = "doc_id long, text string"


def plain(text: str | None) -> tuple:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {label for _, label in places}, 0.0
    for t in templates_of():
        for k in range(0, len(words), t.span):
            share = len(set(words[k : k + 2 * t.span]) & set(t.words))
            if share >= t.need:
                labels.add(t.label)
                best = max(best, share / len(t.words))
    starts = [i for i, _ in places]
    joined = lambda x: ",".join(sorted(x))
    edges = (min(starts), max(starts)) if starts else (None, None)
    return (len(words), len(starts), *edges, joined({label for _, label in places}), joined(labels), 1.0 if starts else best)


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for c, v in more.items():
        docs = docs.withColumn(c, F.lit(v))
    return {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs).collect()}


TEXTS = [
    None,
    "",
    " \n\t",
    "Released under the MIT License.",
    "MIT-license, mit LICENSE; apache\nlicense",
    "mit licenses; commit license; mit é license",
    "the GNU General Public License and the general public  license",
    "Licensed under CC BY-NC 4.0.",
    "licensed beneath cc by-nc 4.0",
    "Redistribution and use in source and binary forms, with or without changes, are permitted if the following conditions are met:",
    "word " * 30 + " ".join(license_scan.TEMPLATES[1][1].split()[5:]) + " word" * 500,
    "This is free and unencumbered software released\n\ninto the public domain " * 40,
    "é" * 3000 + " ß public domain",
    "MIT" + "\u0000" + "license",
]


def test_equals_plain_version(spark):
    assert found(spark, TEXTS, words="clash", label="clash", key="clash") == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_equals_plain_version_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs).collect()} == {i: plain(t) for i, t in texts.items()}


def test_long_text_is_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 7)
    text = "x mit license yy released under the mit license zzzzzzzzzzzzzzzzzzzzz"
    assert license_scan.Vocabulary(["mit", "license"]).places(text)[1].tolist() == [1, 2, 7, 8]


def test_repeated_rows_ids_and_empty_table(spark):
    rows = [(1, "mit license"), (1, "mit license"), (1, "other"), (None, "mit license"), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in license_scan.scan_licenses(docs).collect()) == [(0, 0, ""), (0, 1, "mit"), (1, 0, ""), (1, 1, "mit"), (1, 1, "mit")]
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 100])
def test_other_thresholds(spark, percent):
    notices = (("a", "one two three four"), ("b", "Two five"))
    docs = spark.createDataFrame([(0, "five four x three"), (1, "two"), (2, "four three two one five")], DOCS)
    labels = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs, notices, percent).collect()}
    assert labels == ({0: "a,b", 1: "b", 2: "a,b"} if percent == 50 else {0: "", 1: "", 2: "a,b"})
    assert words_of("Two five") == ["two", "five"]
