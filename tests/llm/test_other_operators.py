"""Archives, chats, neighbours, mixing, toxicity, byte-level BPE and the pipeline, and their defined cases."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feira.llm import ann, bpe, chat, mixing, near_dedup, queries, toxicity, warc
from feira.llm._store import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Archives


def test_archives_hold_what_was_written(spark):
    pages = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "u", "y" * 300_000), (None, "n", "lost")]
    given = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    found = {r["page_id"]: r for r in warc.deduplicate_pages(given, new_path(spark, "warc")).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    for page_id, _, html in pages[:-1]:
        raw = (html or "").encode()
        assert found[page_id]["payload_bytes"] == len(raw)
        assert found[page_id]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(found[i]["record_type"], found[i]["refers_to"]) for i in range(1, 7)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("response", None)]


def test_archives_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    pages = spark.createDataFrame([(i, "u", f"{i:04d}" + "x" * 996) for i in range(200)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    assert warc.deduplicate_pages(pages.coalesce(1), path).filter("record_type = 'response'").count() == 200
    sizes = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(sizes) >= 20 and warc.read_archives(spark, path).count() == 200


def test_archives_of_small_payloads_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    found = warc.deduplicate_pages(pages, new_path(spark, "warc"), least_bytes=3).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in found) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]
    assert warc.deduplicate_pages(pages.limit(0), new_path(spark, "warc")).count() == 0


def test_archives_of_ids_with_several_payloads(spark):
    pages = [(9, "u", "AAAA"), (9, "u", "BBBBBB"), (5, "u", "AAAA"), (4, "u", "BBBBBB")]
    found = warc.deduplicate_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), new_path(spark, "warc")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    wanted = [(4, 6, digest("BBBBBB"), "revisit", 9), (5, 4, digest("AAAA"), "revisit", 9), (9, 4, digest("AAAA"), "response", None), (9, 6, digest("BBBBBB"), "response", None)]
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == wanted


# Chats


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, "user", "hi"), (3, 1, "assistant", None), (4, 0, "user", "hi"), (4, 1, "assistant", ""), (5, None, None, None), (None, 0, "user", "hi")]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    kept = {r["conv_id"]: r["rendered"] for r in chat.format_conversations(given).collect()}
    assert set(kept) == {2, 4, 5}
    assert kept[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat.format_turns(given.limit(0)).count() == 0


def test_long_conversations_are_collapsed_by_ranges(spark):
    turns = [(c, t, "user", f"turn {t}") for c, n in ((1, 700), (2, 900), (3, 901)) for t in range(n)]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"]) for r in chat.maximal_conversations(given).collect()] == [(3, 901)]


# Neighbours


def test_recall_and_scores_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    found = {}
    for r in queries.op5_nearest(spark, sf_dir).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        assert sorted(got) == list(range(1, 21))
        hits += len({v for v, _ in got.values()} & set(ids[best].tolist()))
        for v, s in got.values():
            assert s == pytest.approx(score[ids == v][0], abs=1e-12)
    assert hits >= 0.9 * 20 * len(found)


def test_neighbour_cases(spark):
    schema = "vec_id long, embedding array<float>, rep string"
    odd = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 0.0, 1.0]), (6, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    copies = [(i, [1.0, 2.0, 2.0]) for i in range(20, 60)]
    others = [(100, [2.0, 0.0, 0.0]), (101, [0.0, 0.0, -1.0]), (101, [0.0, 0.0, -1.0])]
    given = spark.createDataFrame([(*r, "clash") for r in odd + copies + others], schema)
    found = {}
    for r in ann.nearest_neighbours(given, F.col("vec_id") % 20 == 0, top=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {20, 40, 100}
    assert found[20] == [(i, 9.0) for i in range(21, 41)]
    assert found[40] == [(i, 9.0) for i in range(20, 40)]
    assert found[100] == [(i, 2.0) for i in range(20, 40)]
    few = spark.createDataFrame([(20, [1.0, 0.0], ""), (21, [0.5, 0.5], ""), (22, [-1.0, 0.0], "")], schema)
    assert [(r["vec_id"], r["score"]) for r in ann.nearest_neighbours(few, F.col("vec_id") == 20, top=20).orderBy("rank").collect()] == [(21, 0.5), (22, -1.0)]
    assert ann.nearest_neighbours(given.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _clustered():
    """Vectors of length 1: 1,500 in 30 clusters and 60 that lie alone."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32)) * 3
    x = np.vstack([centres[rng.integers(30, size=1500)] + rng.normal(size=(1500, 32)), rng.normal(size=(60, 32)) * 2])
    return rng.permutation(len(x)), x / np.linalg.norm(x, axis=1)[:, None]


def test_queries_unlike_the_other_rows_find_their_neighbours(spark):
    """Queries that lie alone among tight clusters: many rows are about as near, and no row of the clusters tells how many."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64)) * 3
    ids = np.arange(8000)
    x = centres[rng.integers(60, size=8000)] + 0.2 * rng.normal(size=(8000, 64))
    x[::20] = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    given = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(given, F.col("vec_id") % 20 == 0, top=20).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    recalls = []
    for at in ids[::20]:
        score = x @ x[at]
        score[at] = -np.inf
        recalls.append(len(set(found[at]) & set(np.lexsort((ids, -score))[:20].tolist())) / 20)
    assert np.mean(recalls) >= 0.98 and min(recalls) >= 0.8, (np.mean(recalls), min(recalls))


@pytest.mark.parametrize("small", [False, True])
def test_vectors_that_lie_alone_find_their_neighbours(spark, monkeypatch, small):
    """Also with divided lists, lists over several cells, and cells repeated for parts of their queries."""
    if small:
        for name, value in (("MOST_LISTS", 8), ("ROWS_OF_LIST", 32), ("CELL", 100), ("QUERIES", 20)):
            monkeypatch.setattr(ann, name, value)
    ids, x = _clustered()
    given = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(given, F.col("vec_id") % 4 == 0, top=20).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    recalls = []
    for at in np.flatnonzero(ids % 4 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        got = found[int(ids[at])]
        assert len(got) == len(set(got)) == 20 and ids[at] not in got
        recalls.append(len(set(got) & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(recalls) >= 0.95 and min(recalls) >= (0.2 if small else 0.5)


# Mixing


def test_targets_are_reshared(spark):
    sized = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", 890), (4, None, 0)], "doc_id long, source string, size long")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert targets["a"] == pytest.approx(30) and targets["b"] == pytest.approx(300) and targets["c"] == pytest.approx(670) and targets[None] == 0


def test_mix_comes_near_its_targets(spark, documents):
    sized = documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(None).cast("double").alias("quality"))
    found = mixing.mix_sources(sized).collect()
    assert found == mixing.mix_sources(sized).collect() or sorted(found, key=str) == sorted(mixing.mix_sources(sized).collect(), key=str)
    assert len(found) == documents.count()
    by_source = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken, largest, _ = by_source.get(r["source"], (0, 0, 0))
        by_source[r["source"]] = (taken + r["taken"], max(largest, r["size"]), r["target"])
    for taken, largest, target in by_source.values():
        assert abs(taken - target) <= largest


def test_mixing_cases(spark):
    rows = [(None, None, "x"), (1, "a b", None), (1, "a b", None), (2, "", "x"), (3, "w " * 50_000, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1.0).alias("quality"), F.lit("clash").alias("target"))
    found = mixing.mix_sources(sized).collect()
    assert sorted(r["size"] for r in found) == [0, 0, 2, 2, 50_000]
    assert mixing.mix_sources(sized.limit(0)).count() == 0


def test_better_documents_are_drawn_more_often(spark):
    sized = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"))
    drawn = mixing.mix_sources(sized).filter("source = 'b' AND copies > 0").selectExpr("doc_id % 2 AS odd").groupBy("odd").count().collect()
    counts = {r["odd"]: r["count"] for r in drawn}
    assert counts[0] > 2 * counts[1]


# Toxicity


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    met = scored.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert (met["held_out"] == met["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    toxic, clean = met[met["toxic"] == 1], met[met["toxic"] == 0]
    assert toxic["predicted"].mean() >= 0.9 and clean["predicted"].mean() <= 0.02


def test_toxicity_cases(spark):
    docs = docs_of(spark, [None, "", "   ", "plain words", "x" * 100_000])
    labels = spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score_documents(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0)).score(["a"])[0] == 0


def _runs(*texts):
    return [run for text in texts for run in toxicity.runs_of(text)]


def test_sentences_become_runs_of_letters():
    shown = lambda text: ["".join(" " if c == 0 else chr(96 + c) for c in run).strip() for run in toxicity.runs_of(text)]
    assert shown("One two three four. Five\nsi-x é\u00df") == ["one two three", "four", "five", "six e\x7b"[:5] + shown("\u00df")[0]]
    assert shown("an i d i o t, i.d.i.o.t! a b") == ["an idiot idiot", "a b"]
    assert shown("") == shown(" \n . 12 ### ") == []


def test_the_kernel_is_the_plain_gap_weighted_one():
    a, b = _runs("grumblor is", "a grumbxlor")
    everything = np.arange(toxicity.CODES)

    def plain(run):
        out = {}
        for i in range(len(run)):
            for j in range(i + 1, len(run)):
                for k in range(j + 1, min(len(run), i + toxicity.SPAN + 1) if i < len(run) - toxicity.SPAN else 0):
                    key = run[i], run[j], run[k]
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        return out

    p, q = plain(a), plain(b)
    made = toxicity.dense([a, b], everything, np.ones(toxicity.CODES))
    scale = np.prod([np.sqrt(max(len(r) - toxicity.SPAN, 8) * (toxicity.WEIGHTS**2).sum()) for r in (a, b)])
    assert made[0] @ made[1] * scale == pytest.approx(sum(v * q.get(key, 0.0) for key, v in p.items()))
    codes, starts = toxicity._flat([a, b])
    vector = np.random.default_rng(2).normal(size=toxicity.CODES)
    assert toxicity.run_scores(codes, starts, vector).tolist() == pytest.approx((made @ vector).tolist())


def test_the_kernel_tolerates_inserted_letters():
    a, b, c = toxicity.dense(_runs("grumblor", "grumbxlor", "sentence"), np.arange(toxicity.CODES), np.ones(toxicity.CODES))
    assert a @ b > 1.5 * max(a @ c, 1e-9) and a @ a > a @ b


def test_disguised_insults_are_found(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    plain = "Heresti onand the {}. Thatis ener in the oun and."
    insults = ["idiot", "idxiot", "i d i o t", "i.d.i.o.t", "id-iot", "IDIOT"]
    top = model.features([plain.format(w) for w in [*insults, "thering"]])[:, 0]
    assert (top[:-1] > 0).all() and top[-1] < 0
    long = f"{plain.format('and')} " * 30_000 + plain.format("idiot")
    assert model.features([long])[0, 0] == pytest.approx(top[0], abs=1e-6) and model.score([long, long]).tolist() == model.score([long]).tolist() * 2


# Byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def rows_of_text(documents):
    return [r["text"] or "" for r in documents.collect()]


def test_encoding_equals_the_library(spark, documents, reference_encoding):
    odd = [None, "", " ", "  a  b ", "　x  y\n\n z", "don't we'll I'M", "🙂🙂 é́", "a" * 5000, "<|endoftext|>", "ab" * 2000 + " " * 3000, "12345678 9", "\r\n\t x"]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("abcdeéx"), 5000)), "ab" * 9 + "c" * 77 + "abc" * 700, "\u3042\u3044" * 300, "".join(rng.choice(list("etaoin"), 65)), "word " + "=-" * 400]
    odd += ["".join(rng.choice(list(" \n\tab\u3000.1'"), 400)) for _ in range(40)] + ["a  ", "a \n b", " \n", "\n  x", "a\n b   c"]
    given = documents.unionByName(docs_of(spark, odd).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    given = given.unionByName(given.filter("doc_id = 1000002")).withColumn("ids_sha256", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] or "" for r in given.collect()}
    for r in bpe.encode_digests(given, RANKS, public_tokenizers.PATTERN).collect():
        ids = np.array(reference_encoding.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_chunks_are_dropped_and_learnt_again(monkeypatch, rows_of_text, reference_encoding):
    monkeypatch.setattr(bpe, "CACHE", 500)
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for lo in range(0, len(rows_of_text), 10):
        some = rows_of_text[lo : lo + 10]
        for text, (ids, back) in zip(some, own.round_trip(some), strict=True):
            assert ids.tolist() == reference_encoding.encode_ordinary(text) and back.tobytes() == text.encode()
    assert len(own.known) < 20_000 and own.round_trip([]) == []


def test_many_places_a_round_give_what_single_rounds_give():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(9)
    pieces = [bytes(rng.choice(list(letters), int(n)).tolist()) for letters in (b"a", b"ab", b"etaoins ", bytes(range(256))) for n in rng.integers(2, 200, 20)]
    length = np.array([len(p) for p in pieces])
    one, many = (own._contracted(sql, pieces, length) for sql in (bpe.MERGE_SQL, bpe.MERGE_MANY_SQL))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))


def test_long_pieces_are_joined_from_segments(reference_encoding):
    own, draw = bpe.Codec(RANKS, public_tokenizers.PATTERN), np.random.default_rng(6)
    letters = lambda n, of: bytes(draw.choice(np.frombuffer(of, dtype=np.uint8), n))
    pieces = [letters(n, of) for of in (b"abcdefghijklmnopqrstuvwxyz", b"ab", b"abc=", bytes(range(256))) for n in (513, 4000)]
    pieces += [b"a" * 9001, b"=-" * 3000, ("é" * 2000 + "tion" * 900).encode(), letters(100_000, b"abcdefghijklmnopqrstuvwxyzABCDEF"), b"the", b"x" * 512]
    ids, n = own.encode_pieces(pieces)
    for piece, found in zip(pieces, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert found.tolist() == reference_encoding._core_bpe.encode_single_piece(piece)



def test_decoding_gives_texts_back(spark):
    texts = ["one two", "", "é🙂", None]
    docs = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {0: "one two", 1: "", 2: "é🙂", 3: ""}
    assert bpe.encode_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# The pipeline


def test_stages_act_on_what_the_last_one_kept(spark, sf_dir, documents, reference_encoding):
    docs, columns = documents, documents.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        assert docs.columns == columns or name == "byte-level BPE"
    clean, lined, single, mixed, encoded = seen
    kept = {r["doc_id"] for r in clean.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in kept) >= 0.98 * sum(v == 0 for v in labels.values())
    assert all(r["n_chars"] == len(r["text"]) for r in lined.filter("text IS NOT NULL").collect())
    assert near_dedup.near_duplicates(single, 5, 80).filter("NOT kept").count() == 0
    assert {r["doc_id"] for r in single.collect()} <= {r["doc_id"] for r in lined.collect()} <= kept
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}
    assert mixed.groupBy("doc_id").count().filter("count > 3").count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == mixed.count() and all(r["decodes"] for r in rows)
    assert all(r["ids"] == reference_encoding.encode_ordinary(texts[r["doc_id"]]) for r in rows)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids", "decodes"] and rows.filter("NOT decodes").count() == 0


def test_mix_keeps_null_ids(spark, sf_dir):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    given = [(None, f"{w} b c", "en", source, 5) for w in "xyz" for source in ("s", None)] + [(None, None, "en", "s", None), (3, "one two", "en", "s", 7)]
    docs = spark.createDataFrame(given, kinds)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(None).cast("double").alias("quality"))
    wanted = sum(r["copies"] for r in mixing.mix_sources(sized).collect() if r["doc_id"] is None)
    mixed = [r for r in corpus_pipeline.mix(spark, docs, sf_dir).collect() if r["doc_id"] is None]
    assert len(mixed) == wanted > 0


def test_stages_pass_on_odd_rows_and_columns(spark, sf_dir):
    same = "these seven words are in both rows"
    rows = [(1, same, "en", "s", 3), (1, same, "en", "s", 3), (2, "other words of the same id", "en", None, 3), (2, "and yet others stand in here", "en", None, 3)]
    rows += [(None, same, "en", "s", 3), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "w " * 50_000, "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    clashes = ("copies", "copy", "gone", "kept", "given", "gone_lines", "taken", "size", "of", "words", "from", "long", "nth", "score", "h")
    docs = spark.createDataFrame(rows, kinds).withColumns({c: F.lit("mine") for c in clashes})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns, name
        made = left.collect()
        assert all(r[c] == "mine" for r in made for c in clashes), name
        ids = sorted((r["doc_id"] for r in made), key=str)
        if name in ("toxicity", "line dedup"):
            assert ids == [1, 1, 2, 2, 4, 5, 6, None] or name == "line dedup"
        if name == "near dedup":
            assert ids == [1, 2, 2, 4, 5, 6, None]
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
