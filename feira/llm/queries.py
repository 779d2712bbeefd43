"""The queries of the training-data operators, one per operator, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import ann, bpe, chat, fingerprints, license_scan, line_dedup, mixing, near_dedup, prefix_trie, secret_scan, spelling, toxicity, warc
from feira.llm._store import let_workers_import, materialise, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of all conversations that no longer one continues."""
    return chat.format_turns(_table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated archives of all pages, written, read back and resolved."""
    found = warc.deduplicate_pages(_table(spark, sf_dir, "pages"), new_path(spark, "warc"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector id."""
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, of any length that holds a word, that an earlier line makes superfluous: near ones from 5 words (the shorter from 4)."""
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), line_dedup.WHOLE)


def line_dedup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for lines of 5 words or more only, near ones from 10."""
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), line_dedup.CUT)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents by pattern and by character models."""
    return secret_scan.scan_digests(_table(spark, sf_dir, "documents"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``quality``, the sampling weight: 2 for good, 1/2 for bad documents."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return known.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when its source is mixed to its target; unlabelled documents weigh 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized = docs.join(quality_weights(_table(spark, sf_dir, "labels")), "doc_id", "left")
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model trained on labelled ones outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what the ids decode to, for every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations, rebuilt on their shared beginnings."""
    turns = materialise(prefix_trie.digested_turns(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(prefix_trie.with_shared_beginnings(turns)).drop("position", "subtree_end")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their most frequent forms at one code point's distance."""
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or states."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_warc": op4_warc,
    "op5_nearest": op5_nearest,
    "op6_line_dedup": op6_line_dedup,
    "line_dedup_bounded": line_dedup_bounded,
    "op7_secret_scan": op7_secret_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}


def crc32_sql(codes: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a list of bytes."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": """
WITH placed AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns, count(*) AS n FROM placed GROUP BY conv_id
), beginnings AS (
    SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM whole)
), kept AS (
    SELECT min(conv_id) AS conv_id, n AS n_turns FROM whole WHERE turns NOT IN (SELECT turns FROM beginnings) GROUP BY turns, n
)
SELECT k.conv_id, k.n_turns, p.place, '<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10) AS rendered
FROM kept k JOIN placed p USING (conv_id)
""",
    "op4_warc": """
WITH h AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL
), d AS (
    SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + (i // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
    FROM h
), o AS (
    SELECT payload_digest, max(page_id) AS original FROM d GROUP BY payload_digest
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest, CASE WHEN d.page_id < o.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < o.original THEN o.original END AS refers_to
FROM d JOIN o USING (payload_digest)
""",
    "line_dedup_bounded": """
WITH all_lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), cut AS (
    SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM all_lines
), sized AS (
    SELECT doc_id, line_no, w, len(w) AS n FROM cut WHERE len(w) >= 5
), firsts AS (
    SELECT w, n, min((doc_id, line_no)) AS place FROM sized GROUP BY w, n
), variants AS (
    SELECT w, n, place, i, array_to_string(w[1:i-1] || w[i+1:], ' ') AS v
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 10)
), wholes AS (
    SELECT w, n, place, array_to_string(w, ' ') AS v FROM firsts WHERE n >= 10
), near AS (
    SELECT a.w FROM variants a JOIN (SELECT v, i, n, min(place) AS place FROM variants GROUP BY v, i, n) b USING (v, i, n) WHERE b.place < a.place
    UNION
    SELECT a.w FROM variants a JOIN wholes b ON a.v = b.v AND a.n = b.n + 1 WHERE b.place < a.place
    UNION
    SELECT a.w FROM wholes a JOIN variants b ON a.v = b.v AND b.n = a.n + 1 WHERE b.place < a.place
), judged AS (
    SELECT s.doc_id, s.line_no, CASE WHEN (s.doc_id, s.line_no) > f.place THEN 'equal' WHEN EXISTS (SELECT 1 FROM near WHERE near.w = s.w) THEN 'near' END AS reason
    FROM sized s JOIN firsts f ON s.w = f.w
), gone AS (
    SELECT doc_id, count(*) FILTER (WHERE reason = 'equal') AS n_equal, count(*) FILTER (WHERE reason = 'near') AS n_near, string_agg(line_no, ',' ORDER BY line_no) AS removed
    FROM judged WHERE reason IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id)
""",
    "op6_line_dedup": """
WITH all_lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), cut AS (
    SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM all_lines
), sized AS (
    SELECT doc_id, line_no, w, len(w) AS n FROM cut WHERE len(w) >= 1
), firsts AS (
    SELECT w, n, min((doc_id, line_no)) AS place FROM sized GROUP BY w, n
), variants AS (
    SELECT w, n, place, i, array_to_string(w[1:i-1] || w[i+1:], ' ') AS v
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5)
), wholes AS (
    SELECT w, n, place, array_to_string(w, ' ') AS v FROM firsts WHERE n >= 4
), near AS (
    SELECT a.w FROM variants a JOIN (SELECT v, i, n, min(place) AS place FROM variants GROUP BY v, i, n) b USING (v, i, n) WHERE b.place < a.place
    UNION
    SELECT a.w FROM variants a JOIN wholes b ON a.v = b.v AND a.n = b.n + 1 WHERE b.place < a.place
    UNION
    SELECT a.w FROM wholes a JOIN variants b ON a.v = b.v AND b.n = a.n + 1 WHERE b.place < a.place
), judged AS (
    SELECT s.doc_id, s.line_no, CASE WHEN (s.doc_id, s.line_no) > f.place THEN 'equal' WHEN EXISTS (SELECT 1 FROM near WHERE near.w = s.w) THEN 'near' END AS reason
    FROM sized s JOIN firsts f ON s.w = f.w
), gone AS (
    SELECT doc_id, count(*) FILTER (WHERE reason = 'equal') AS n_equal, count(*) FILTER (WHERE reason = 'near') AS n_near, string_agg(line_no, ',' ORDER BY line_no) AS removed
    FROM judged WHERE reason IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id)
""",
    "op8_mix_sources": """
WITH sized AS (
    SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, coalesce(q.quality, 1.0) AS quality
    FROM documents d LEFT JOIN (
        SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ) q ON d.doc_id = q.doc_id
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, source_size * 3.0::DOUBLE AS lim,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
    FROM per_source
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighted WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), truth AS (
    SELECT level AS lvl FROM levels WHERE level * weight <= lim ORDER BY lim / weight, source NULLS LAST LIMIT 1
), targets AS (
    SELECT source, source_size, coalesce(least(lim, lvl * weight), lim) AS target FROM levels LEFT JOIN truth ON TRUE
), rests AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), keyed AS (
    SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5('17' || coalesce(':' || doc_id, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / quality AS k FROM sized
), run AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(r.size * (t.epochs + CASE WHEN r.before + r.size / 2.0::DOUBLE <= t.target - t.epochs * t.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source
""",
    "op11_prefix_trie": """
WITH placed AS (
    SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(said ORDER BY place) AS turns FROM placed GROUP BY conv_id
), headed AS (
    SELECT conv_id, turns, conv_id - conv_id % 100 AS base, %CRC% % 6 AS h FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM headed a LEFT JOIN own b ON b.conv_id = a.base
), prefixes AS (
    SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended,
           CASE WHEN depth > 0 THEN (count(*) - 1) * length(path[depth].t) ELSE 0 END AS saved
    FROM prefixes GROUP BY path, depth
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), linked AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), above AS (
    SELECT path[1:k] AS path, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM linked)
), below AS (
    SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM linked n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
""".replace("%CRC%", crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x))")),
    "op12_spelling_variants": """
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents
    ) WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, %CRC% AS h FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs)
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS other FROM near GROUP BY word
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN b.other END AS form, CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
""".replace("%CRC%", crc32_sql("list_transform(flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)), lambda x: CAST(x AS BIGINT))")),
    "op13_license_scan": """
WITH templates(label, span, need, w) AS (VALUES
    %TEMPLATES%
), cut AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), pairs AS (
    SELECT r, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b, unnest(list_concat(w[3:], [NULL, NULL])) AS c, unnest(range(len(w))) AS spot FROM cut
), base AS (
    SELECT r, spot, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' ELSE 'gpl' END AS label FROM pairs
    WHERE (a IN ('mit', 'apache') AND b = 'license') OR (a = 'general' AND b = 'public' AND c = 'license')
), blocks AS (
    SELECT r, span, list_distinct(w[k + 1:k + 2 * span]) AS b
    FROM (SELECT r, w, span, unnest(range(0, len(w), span)) AS k FROM cut, (SELECT DISTINCT span FROM templates))
), found AS (
    SELECT r, label, len(list_intersect(b, w)) / CAST(len(w) AS DOUBLE) AS containment FROM blocks JOIN templates USING (span) WHERE len(list_intersect(b, w)) >= need
), per_base AS (
    SELECT r, count(*) AS n, min(spot) AS lo, max(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r
), every AS (
    SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r
), best AS (
    SELECT r, max(containment) AS containment FROM found GROUP BY r
)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base, CAST(p.lo AS BIGINT) AS first_word, CAST(p.hi AS BIGINT) AS last_word,
       coalesce(p.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CASE WHEN p.n > 0 THEN 1.0::DOUBLE ELSE coalesce(b.containment, 0.0::DOUBLE) END AS score
FROM cut c LEFT JOIN per_base p USING (r) LEFT JOIN every e USING (r) LEFT JOIN best b USING (r)
""".replace(
        "%TEMPLATES%",
        ",\n    ".join(f"('{t.label}', {t.span}, {t.need}, {list(t.words)})" for t in license_scan.templates_of()),
    ),
}
