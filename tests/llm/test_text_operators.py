"""Fingerprints, near duplicates, line dedup and secret scans against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feira.llm import fingerprints, line_dedup, near_dedup, secret_scan
from feira.llm._text import shingle_set
from feira.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_set(text, k):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def test_shingle_sets_have_the_size_of_plain_ones(rows):
    for text in list(rows.values())[:60] + [None, "", " \n", "one", "A a A a A a"]:
        assert len(shingle_set(text, 4)) == len(plain_set(text, 4))


def test_edited_texts_and_likeness(documents, rows):
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents).collect()}
    assert set(found) == set(rows)
    order = sorted(rows, reverse=True)
    errors = []
    for i, doc_id in enumerate(order):
        text, after = rows[doc_id] or "", rows[order[(i + 1) % len(order)]] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        r = found[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = plain_set(text, 5), plain_set(edited, 5)
        if a and b:
            errors.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
    assert np.mean(errors) < 0.03


def test_fingerprint_cases(spark):
    texts = [None, "", "same words in both of these", "same words in both of these", "é" * 70_000]
    rows = fingerprints.fingerprint_edits(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert len(rows) == 5
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"]
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and set(rows[0]["fingerprint"]) == {"0"}
    assert rows[4]["n_chars"] == 70_000
    assert fingerprints.fingerprint_edits(docs_of(spark, [])).count() == 0
    repeated = docs_of(spark, ["a b c"]).unionByName(docs_of(spark, ["a b c"])).withColumn("fingerprint", docs_of(spark, [])["text"] if False else fingerprints.F.lit("x"))
    assert fingerprints.fingerprint_edits(repeated).count() == 2
    with_null = spark.createDataFrame([(None, "x y", "en", "s", 3), (1, "z", None, None, None)], DOCS)
    assert {r["doc_id"] for r in fingerprints.fingerprint_edits(with_null).collect()} == {None, 1}


def brute_components(rows, k, percent):
    sets = {i: plain_set(t, k) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)):
                both = len(p & q)
                if 100 * both >= percent * (len(p) + len(q) - both):
                    u, v = find(a), find(b)
                    parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates_equal_brute_force(documents, rows, k, percent):
    component, sizes = brute_components(rows, k, percent)
    found = near_dedup.near_duplicates(documents, k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicate_chains_and_large_groups(spark):
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(30):  # a chain: each is near the next only
        texts.append(" ".join(words[i * 3 : i * 3 + 30]))
    for i in range(150):  # a group around one text
        changed = list(words[:60])
        changed[i % 55] = f"x{i}"
        texts.append(" ".join(changed))
    rows = dict(enumerate(texts))
    component, _ = brute_components(rows, 4, 80)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert found == component


def test_key_of_three_whose_smallest_leads_both_ways(spark, monkeypatch):
    def one_key(batches):
        for batch in batches:
            yield near_dedup.pa.RecordBatch.from_pydict({"rep": batch.column(0), "key": near_dedup.pa.array([7] * batch.num_rows, near_dedup.pa.int64())})

    monkeypatch.setattr(near_dedup, "_band_rows", one_key)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([f"x{i}" if i % 30 == 5 else w for i, w in enumerate(words)])]
    texts += [" ".join([f"{new}{i}" if i == at else w for i, w in enumerate(words)]) for new, at in (("y", 20), ("z", 80))]
    rows = dict(enumerate(texts))
    component, _ = brute_components(rows, 4, 80)
    assert component == {0: 0, 1: 1, 2: 1}
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert found == component


@pytest.mark.parametrize("order", ["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"])
def test_two_linked_of_three_whatever_their_ids(spark, order):
    words = "w818856 w938575 w772833 w421742 w570348 w901495 w839388 w667443".split()
    texts = {"A": " ".join(words[:6]), "B": " ".join(words), "C": " ".join(words[:7])}
    found = {order[r["doc_id"]]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, [texts[x] for x in order]), 4, 80).collect()}
    assert found["B"] == found["C"] == min(order.index("B"), order.index("C")) and found["A"] == order.index("A")


def test_groups_of_edited_copies_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, 90, int(rng.integers(1, 7))):
                w[at] = f"x{rng.integers(30)}"
            del w[: int(rng.integers(0, 6))]
            texts.append(" ".join(w))
    component, _ = brute_components(dict(enumerate(texts)), 4, 80)
    assert 6 < len(set(component.values())) < 140
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert found == component


def test_near_duplicate_cases(spark):
    texts = [None, "", " \t", "two words", "Two WORDS", "other words", "long " * 50_000]
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert [found[i]["n_shingles"] for i in range(7)] == [0, 0, 0, 1, 1, 1, 1]
    assert found[4]["component_id"] == 3 and not found[4]["kept"]
    assert all(found[i]["kept"] for i in (0, 1, 2, 3, 5, 6))
    assert near_dedup.near_duplicates(docs_of(spark, []), 4, 80).count() == 0
    null_id = spark.createDataFrame([(None, "a b c d e", "x", "y", 1), (5, "a b c d e", "x", "y", 1), (5, "a b c d e", "x", "y", 1)], DOCS)
    kept = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(null_id, 4, 80).collect()]
    assert sorted(kept, key=str) == sorted([(None, None, True), (5, 5, True), (5, 5, True)], key=str)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(10, 70)] + [(7, 7), (3, 2), (3, 2)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 10 for i in range(10, 71)}, 2: 2, 3: 2}


def plain_repeated(rows, equal, near_words, shorter):
    """(doc_id, line_no) to reason, by comparing every line with every earlier one."""
    lines = [(i, n, plain_words(line)) for i in sorted(rows) if rows[i] is not None for n, line in enumerate(rows[i].split("\n"))]
    lines = [x for x in lines if len(x[2]) >= equal]

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
        return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:]) and len(a) - len(b) <= 1

    out = {}
    for j, (doc, n, w) in enumerate(lines):
        if any(w == v for _, _, v in lines[:j]):
            out[doc, n] = "equal"
        elif any(max(len(v), len(w)) >= near_words and min(len(v), len(w)) >= shorter and near(w, v) for _, _, v in lines[:j]):
            out[doc, n] = "near"
    return out


@pytest.mark.parametrize("bounds", [line_dedup.WHOLE, line_dedup.CUT])
def test_repeated_lines_equal_brute_force(spark, bounds):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(40)}" for _ in range(int(rng.integers(2, 30)))) for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 5))):
            w = base[rng.integers(25)].split()
            edit, at = rng.integers(4), int(rng.integers(len(w)))
            if edit == 1:
                w[at] = f"new{rng.integers(9)}"
            elif edit == 2:
                w.insert(at, f"new{rng.integers(9)}")
            elif edit == 3:
                del w[at]
            lines.append(" ".join(w).upper() if rng.integers(2) else " ".join(w))
        texts.append("\n".join(lines))
    found = line_dedup.repeated_lines(docs_of(spark, texts), bounds).collect()
    assert {(r["doc_id"], r["line_no"]): r["reason"] for r in found} == plain_repeated(dict(enumerate(texts)), *bounds)


def test_line_dedup_cases(spark):
    same = "one two three four five six seven eight nine ten"
    texts = [None, "", f"{same}\nshort line", f"{same}\n{same}\nkept words here are others", same, "short line", " ".join(f"w{i}" for i in range(20_000))]
    docs = docs_of(spark, texts).withColumns({c: fingerprints.F.lit("clash") for c in ("line", "h", "gone_lines", "lines", "given", "a.b")})
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs, line_dedup.CUT).collect()}
    assert left == {0: None, 1: "", 2: texts[2], 3: "kept words here are others", 5: "short line", 6: texts[6]}
    left = line_dedup.drop_repeated_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {0: None, 1: "", 2: texts[2], 3: "kept words here are others", 6: texts[6]} and left[0]["given"] == "clash"
    report = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    assert report[3]["removed"] == "0,1" and report[3]["n_equal"] == 2 and report[0]["n_lines"] == 0
    assert line_dedup.drop_repeated_lines(docs_of(spark, [])).count() == 0
    null_id = spark.createDataFrame([(None, same, "x", "y", 1), (5, same, "x", "y", 1)], DOCS)
    assert line_dedup.drop_repeated_lines(null_id).count() == 2


def test_whole_line_dedup_of_short_lines(spark):
    nine = "one two three four five six seven eight nine"
    ten = nine.replace("five", "five new")
    lines = ["les.", "and ornd.", "and other", "a b c d", "a b x d", "", nine, "p q r s t"]
    later = ["les.", "AND ornd.", "", ten, "a b c d e", "p q r s", "p q z s t", "a b c", " les. "]
    docs = docs_of(spark, ["\n".join(lines), "\n".join(later)])
    found = {(r["doc_id"], r["line_no"]): r["reason"] for r in line_dedup.repeated_lines(docs, line_dedup.WHOLE).collect()}
    assert found == {(1, 0): "equal", (1, 1): "equal", (1, 3): "near", (1, 4): "near", (1, 5): "near", (1, 6): "near", (1, 8): "equal"}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {0: "\n".join(lines), 1: "\na b c"}


KINDS = ((r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))


def plain_base(text):
    found = []
    for kind, (pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_scan_equals_plain_patterns(documents, rows, spark):
    odd = [None, "", "api_key = 'abcdef0123456789abcdef'", "AKIA" + "A1" * 10 + "AKIA", "x" * 40_000 + "0" * 16, "🙂 token: 🙂 Secret=abc.def_ghi-jkl=", "TOKEN:" + "é" * 20, "passwd==" + "a" * 11]
    given = documents.unionByName(docs_of(spark, odd, start=1_000_000))
    texts = {**rows, **{1_000_000 + i: t for i, t in enumerate(odd)}}
    found = secret_scan.scan_digests(given).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(list(filter(None, base.split(","))))


def test_models_tell_random_strings_from_identifiers(spark):
    texts = ["key Zx9QbT4vWmK2rLpY8sNdJ7hC end", "getUserAccountManagerFactory and request_handler_for_session_manager stay", "see /usr/local/share/documents/manual for more"]
    spans = [r["spans"] for r in secret_scan.scan_digests(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert spans == ["random:4:28", "", ""]


def test_secret_scan_of_repeats_many_keys_and_no_documents(spark):
    keys = " ".join(f"{i:016x} x{i} tok_{i}={'Qz9' * 6}{i}" for i in range(3000))
    given = [(1, keys), (1, keys), (1, "none"), (None, "AKIA" + "A" * 16), (2, "ff" * 20 + "/" + "Zq8" * 10), (3, "é" * 30 + " 0123456789abcdef")]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns({"kind": F.lit("clash"), "k": F.lit(1), "start": F.lit(2)})
    found = secret_scan.scan(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"]) for r in found) == [(0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 0, 3000), (1, 0, 0, 3000), (2, 0, 0, 1), (3, 0, 0, 1)]
    for r in found:
        text = dict(given)[r["doc_id"]] if r["doc_id"] != 1 else keys
        assert all(re.fullmatch("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", text[s["start"] : s["end"]]) for s in r["base"]) and set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r["spans"] if a["kind"] == 3 for b in r["base"])
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secret_models_on_held_out_samples(spark):
    samples = secret_scan.labelled_samples(spark).withColumn("part", F.crc32("text") % 5)
    model = secret_scan.train(spark, samples.filter("part <> 0"))
    found = secret_scan.quality(spark, samples.filter("part = 0"), model)
    assert found["recall"] > 0.98 and found["false_share"] < 0.02
    print(found)
