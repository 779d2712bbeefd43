"""Byte-level BPE encoding and decoding with DuckDB inside Arrow tasks.

Each task cuts its texts into the pattern's pieces, and hands the pieces it hasn't
met before to a DuckDB in its own process. There, token-position rows join the merge
table in a recursive query that contracts, in every round, each piece's leftmost pair
of minimum rank, until no piece has a pair left. Decoding joins token positions with
the vocabulary and aggregates the bytes of a piece in order.

A piece of over ``MANY_ROUNDS`` bytes would need as many rounds over as many rows. Its
recursive query contracts in one round all places of the minimum-rank pair that single
rounds would contract one after the other: all that don't overlap, from the left, if no
merge of the token they make has a lower rank, else the leftmost alone.

A piece of over ``LONG`` bytes is contracted in segments of ``SEGMENT`` bytes, whose tokens are joined two by two. Tokens
are what the merges give if each two neighbours are what the merges give for their own bytes; where that
fails at a seam, the tokens around it are contracted anew, more of them each time, until it holds on both
edges. So the work grows with the length of the piece.

A text's encoding is the concatenation of its pieces' encodings. Texts are first cut
before single spaces, where a piece always begins unless white space stands on both
sides, and a worker keeps what ``CACHE`` of these chunks encode and decode to, dropping
those that were rarely used; what it has dropped is computed again.

Texts don't leave their partition: no shuffle. Defined cases: a null text counts as
empty and has no tokens; lone surrogates can't occur in Spark strings; repeated rows and
ids are encoded each; an empty table gives an empty result; columns other than those named
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker keeps, about, and the bytes they may hold.
CACHE, CACHE_BYTES = 400_000, 64_000_000
#: Longer chunks are dropped first.
CACHED_CHARS = 400
#: Bytes of a piece from which many places are contracted in one round.
MANY_ROUNDS = 64
#: Bytes from which a piece is contracted in segments, and the bytes of one.
LONG, SEGMENT = 512, 64
#: Rows that one recursive query makes, about: a piece of n bytes makes up to n * n / 2 in its rounds.
ROWS = 4_000_000
#: Chunks put together at once.
GATHERED = 50_000
#: Marks a chunk that no space precedes; can't occur in a text.
FIRST = "\ud800"

# The characters of the pattern's \s, Unicode White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_INSIDE_WHITE = re.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")

# A row's g is its word in the upper and its position in the lower 32 bits. A merge's code is twice its rank, plus 1 if
# a merge of the token it makes has a lower rank.
PAIRS_SQL = """
        WITH pairs AS MATERIALIZED (
            SELECT g, tok, lead(tok) OVER w AS next_tok, lead(g) OVER w AS next_g, lag(g) OVER w AS last_g, row_number() OVER w AS n
            FROM step WHERE NOT done WINDOW w AS (ORDER BY g)
        ), ranked AS MATERIALIZED (
            SELECT p.*, m.code FROM pairs p
            LEFT JOIN merges m ON CASE WHEN p.g >> 32 = p.next_g >> 32 THEN p.tok * 4294967296 + p.next_tok END = m.pair
        ), best AS MATERIALIZED (
            SELECT g >> 32 AS word, min(code * 4294967296 + (g & 4294967295)) AS place FROM ranked WHERE code IS NOT NULL GROUP BY 1
        )
"""

MERGE_SQL = f"""
WITH RECURSIVE step AS (
    SELECT word * 4294967296 + pos AS g, tok, FALSE AS done FROM start
    UNION ALL
    SELECT g, tok, done FROM ({PAIRS_SQL}
        SELECT r.g, CASE WHEN r.g & 4294967295 = b.place & 4294967295 THEN b.place >> 33 ELSE r.tok END AS tok, b.place IS NULL AS done
        FROM ranked r LEFT JOIN best b ON r.g >> 32 = b.word
        WHERE b.place IS NULL OR r.last_g IS NULL OR r.last_g <> b.word * 4294967296 + (b.place & 4294967295)
    )
)
SELECT g >> 32 AS word, tok FROM step WHERE done ORDER BY g
"""

MERGE_MANY_SQL = f"""
WITH RECURSIVE step AS (
    SELECT word * 4294967296 + pos AS g, tok, FALSE AS done FROM start
    UNION ALL
    SELECT g, tok, done FROM ({PAIRS_SQL}, hits AS (
            SELECT r.g, r.next_g, b.place, r.n - row_number() OVER (ORDER BY r.g) AS run
            FROM ranked r JOIN best b ON r.g >> 32 = b.word WHERE r.code = b.place >> 32
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY g) AS nth FROM hits
        ), chosen AS MATERIALIZED (
            SELECT g, next_g FROM placed WHERE nth % 2 = 1 AND ((place >> 32) % 2 = 0 OR g & 4294967295 = place & 4294967295)
        )
        SELECT r.g, CASE WHEN c.g IS NULL THEN r.tok ELSE b.place >> 33 END AS tok, b.place IS NULL AS done
        FROM ranked r LEFT JOIN best b ON r.g >> 32 = b.word LEFT JOIN chosen c ON r.g = c.g LEFT JOIN chosen d ON r.g = d.next_g
        WHERE d.g IS NULL
    )
)
SELECT g >> 32 AS word, tok FROM step WHERE done ORDER BY g
"""

DECODE_SQL = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v ON t.tok = v.id GROUP BY t.word ORDER BY t.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a rank file (lines of base64 and rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merges(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """``pair`` (left * 2^32 + right) and ``code`` of every merge."""
    found = [(left, right, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None]
    left, right, rank = np.array(found, dtype=np.int64).reshape(-1, 3).T
    lowest = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, left, rank)
    np.minimum.at(lowest, right, rank)
    return {"pair": left << 32 | right, "code": 2 * rank + (lowest[rank] < rank)}


def _gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The runs ``flat[at[i] : at[i] + n[i]]`` of all wanted i, one after the other."""
    out = []
    for lo in range(0, len(wanted), GATHERED):
        some = wanted[lo : lo + GATHERED]
        length = n[some]
        end = np.cumsum(length)
        out.append(flat[np.repeat(at[some] - end + length, length) + np.arange(end[-1])])
    return np.concatenate(out) if out else flat[:0]


class _Runs:
    """Arrays of different lengths behind each other."""

    def __init__(self, kind: type) -> None:
        self.flat, self.at, self.n = np.empty(0, dtype=kind), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def append(self, flat: np.ndarray, n: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.flat, self.n = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.n, n])

    def put(self, wanted: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.at, self.n, wanted)

    def keep(self, wanted: np.ndarray) -> None:
        flat, n = self.put(wanted), self.n[wanted]
        self.flat, self.n, self.at = flat, n, np.cumsum(n) - n


class _Numbers(dict):
    """Chunks to numbers; a chunk that is asked for the first time gets the next number and is noted in ``new``."""

    def __init__(self, *given) -> None:
        super().__init__(*given)
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        number = self[chunk] = len(self)
        return number


def _text_of(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == FIRST else f" {chunk}"


def _chunk_of(piece: str) -> str:
    return piece[1:] if piece[0] == " " else FIRST + piece


class Codec:
    """Encodes pieces and decodes ids in an in-memory DuckDB; one per worker process."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        self.ranks = read_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        # What doesn't fit goes to the worker's own scratch folder, and is gone with the query.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": f"{tempfile.gettempdir()}/duckdb-{os.getpid()}"})
        vocabulary = pa.table([pa.array(list(self.ranks.values()), pa.int64()), pa.array([t.hex() for t in self.ranks])], ["id", "hex"])
        for name, table in (("merges", pa.table(_merges(self.ranks))), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.known, self.ids, self.text, self.used = _Numbers(), _Runs(np.uint32), _Runs(np.uint8), np.empty(0, dtype=np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and the number of each."""
        if not any(len(p) > LONG and p not in self.ranks for p in pieces):
            return self._encode_short(pieces)
        cut = [[p[k : k + SEGMENT] for k in range(0, len(p), SEGMENT)] if len(p) > LONG and p not in self.ranks else [p] for p in pieces]
        ids, n = self._encode_short([c for parts in cut for c in parts])
        runs = np.split(ids, np.cumsum(n)[:-1])
        ends = np.cumsum([len(parts) for parts in cut])
        joined = self._join_segments([runs[end - len(parts) : end] for parts, end in zip(cut, ends.tolist(), strict=True)])
        return np.concatenate(joined), np.array([len(j) for j in joined], dtype=np.int64)

    def _join_segments(self, pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The tokens of each piece from those of its segments.

        Neighbours are joined two by two, in rounds. A sequence of tokens is what the merges give if each two neighbours
        are what the merges give for their bytes. Where two segments meet and that fails, the tokens around
        the seam are contracted anew, from twice as many on either side each time, until it holds on both edges.
        """
        while any(len(p) > 1 for p in pieces):
            seams = [[p[k], p[k + 1]] for p in pieces for k in range(0, len(p) - 1, 2)]
            made = self._join_pairs(seams)
            at, after = 0, []
            for p in pieces:
                n = len(p) // 2
                after.append(made[at : at + n] + ([p[-1]] if len(p) % 2 else []))
                at += n
            pieces = after
        return [p[0] for p in pieces]

    def _join_pairs(self, pairs: list[list[np.ndarray]]) -> list[np.ndarray]:
        done: list[np.ndarray | None] = [None] * len(pairs)
        middle = [np.empty(0, dtype=np.int64)] * len(pairs)
        width, open_pairs = 0, list(range(len(pairs)))
        while open_pairs:
            parts = {}
            for k in open_pairs:
                left, right = pairs[k]
                cut = max(len(left) - width, 0)
                parts[k] = (left[:cut], middle[k], right[width:])
            edges = [(k, a, b) for k in open_pairs for a, b in self._edges(*parts[k])]
            good = self._neighbours([(a, b) for _, a, b in edges])
            bad = {k for (k, _, _), fine in zip(edges, good, strict=True) if not fine}
            for k in open_pairs:
                if k not in bad:
                    done[k] = np.concatenate(parts[k])
            open_pairs = [k for k in open_pairs if k in bad]
            width = max(2, 2 * width)
            around = [b"".join(map(self.bytes_of.__getitem__, [*pairs[k][0][-width:].tolist(), *pairs[k][1][:width].tolist()])) for k in open_pairs]
            ids, n = self._encode_short(around)
            for k, run in zip(open_pairs, np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], strict=True):
                middle[k] = run
        return done

    @staticmethod
    def _edges(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        runs = [r for r in (left, middle, right) if len(r)]
        return [(int(a[-1]), int(b[0])) for a, b in zip(runs, runs[1:], strict=False)]

    def _neighbours(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether the merges give just these two tokens for the bytes of two tokens."""
        wanted = list(set(pairs))
        ids, n = self._encode_short([self.bytes_of[a] + self.bytes_of[b] for a, b in wanted])
        ends = np.cumsum(n)
        fine = {p: count == 2 and (int(ids[end - 2]), int(ids[end - 1])) == p for p, count, end in zip(wanted, n.tolist(), ends.tolist(), strict=True)}
        return [fine[p] for p in pairs]

    def _encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        counts = np.ones(len(pieces), dtype=np.int64)
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        found = []
        for sql, chosen in ((MERGE_SQL, (whole < 0) & (length <= MANY_ROUNDS)), (MERGE_MANY_SQL, (whole < 0) & (length > MANY_ROUNDS))):
            rest = np.flatnonzero(chosen)
            # Pieces of many rounds at once make few rows more than the longest one.
            made = np.cumsum(length[rest] ** 2 / 2 if sql is MERGE_SQL else length[rest] * 64)
            for block in np.split(rest, np.flatnonzero(np.diff(made // ROWS)) + 1):
                if len(block):
                    found.append((block, self._contracted(sql, [pieces[i] for i in block], length[block])))
        for block, (word, _) in found:
            counts[block] = np.bincount(word, minlength=len(block))
        at = np.cumsum(counts) - counts
        out = np.repeat(whole, counts)
        for block, (_, tok) in found:
            n = counts[block]
            out[np.repeat(at[block] - np.cumsum(n) + n, n) + np.arange(len(tok))] = tok
        return out, counts

    def _contracted(self, sql: str, pieces: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and tokens that the recursive query gives for pieces."""
        word = np.repeat(np.arange(len(pieces)), length)
        start = pa.table({"word": word, "pos": np.arange(len(word)) - (np.cumsum(length) - length)[word], "tok": self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]})
        self.con.register("start", start)
        made = self.con.execute(sql).fetchnumpy()
        self.con.unregister("start")
        return np.asarray(made["word"]), np.asarray(made["tok"])

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of sequences of ids, one after the other, and the number of each."""
        n = np.zeros(len(counts), dtype=np.int64)
        if not len(ids):
            return np.empty(0, dtype=np.uint8), n
        word = np.repeat(np.arange(len(counts)), counts)
        self.con.register("tokens", pa.table({"word": word, "pos": np.arange(len(ids)), "tok": ids.astype(np.int64)}))
        made = self.con.execute(DECODE_SQL).fetchnumpy()
        self.con.unregister("tokens")
        digits = made["hex"].tolist()
        n[np.asarray(made["word"])] = [len(d) // 2 for d in digits]
        return np.frombuffer(bytes.fromhex("".join(digits)), dtype=np.uint8), n

    def _learn(self) -> None:
        """Encodes and decodes the new chunks; pieces of a chunk of several are chunks as well."""
        new, base = self.known.new, len(self.ids.n)
        chunks = len(new)
        one, pieces, several, parts, n_parts = [], [], [], [], []
        at = 0
        while at < len(new):
            text = _text_of(new[at])
            # A chunk that came as a piece is one, and so are letters behind a space.
            if at >= chunks or (text[0] == " " and text.isascii() and text[1:].isalpha()) or len(found := self.pattern.findall(text)) == 1:
                one.append(at)
                pieces.append(text.encode())
            else:
                several.append(at)
                parts += [self.known[_chunk_of(p)] for p in found]
                n_parts.append(len(found))
            at += 1
        self.known.new = []
        ids, n_ids = self.encode_pieces(pieces)
        back, n_back = self.decode_ids(ids, n_ids)
        order = np.empty(len(new), dtype=np.int64)  # where the runs are appended: first the pieces, then the others
        order[one], order[several] = np.arange(len(one)), np.arange(len(one), len(new))
        parts, n_parts = np.array(parts, dtype=np.int64), np.array(n_parts, dtype=np.int64)
        parts[parts >= base] = base + order[parts[parts >= base] - base]
        owner = np.repeat(np.arange(len(several)), n_parts)
        for runs, flat, n in ((self.ids, ids, n_ids), (self.text, back, n_back)):
            runs.append(flat, n)
            runs.append(runs.put(parts), np.bincount(owner, weights=runs.n[parts], minlength=len(several)).astype(np.int64))
            for a in (runs.at, runs.n):
                a[base:] = a[base:][order]
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])

    def _forget(self) -> None:
        """Drops long chunks and those that were used least since the last time."""
        if len(self.known) <= CACHE and len(self.text.flat) <= CACHE_BYTES:
            return
        chunks = list(self.known)
        kept = self.used > 1
        if kept.sum() > CACHE // 2:
            kept &= self.used > np.partition(self.used, len(self.used) - CACHE // 2)[len(self.used) - CACHE // 2]
        kept &= np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) <= CACHED_CHARS
        kept = np.flatnonzero(kept)
        self.known = _Numbers((chunks[i], k) for k, i in enumerate(kept.tolist()))
        self.ids.keep(kept)
        self.text.keep(kept)
        self.used = self.used[kept] // 4

    def round_trip(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of each text, as arrays."""
        self._forget()
        cut = [_chunks(t) for t in texts]
        n = np.array([len(c) for c in cut], dtype=np.int64)
        wanted = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(n.sum()))
        if self.known.new:
            self._learn()
        self.used += np.bincount(wanted, minlength=len(self.used))
        ends = np.concatenate([[0], np.cumsum(n)])
        both = []
        for runs in (self.ids, self.text):
            before = np.concatenate([[0], np.cumsum(runs.n[wanted])])[ends]
            both.append(np.split(runs.put(wanted), before[1:-1]))
        return list(zip(*both, strict=True)) if texts else []


def _chunks(text: str) -> list[str]:
    """A text cut before its spaces, except inside white space; the chunks lack that space, and a first one is marked."""
    parts = text.split(" ")
    if _INSIDE_WHITE.search(text):
        mended = parts[:1]
        for c in parts[1:]:
            before = mended[-1]
            # The chunk before may be the first one, which begins without a space, or lack its own.
            if (before[-1] in WHITE if before else len(mended) > 1) and (not c or c[0] in WHITE):
                mended[-1] = f"{before} {c}"
            else:
                mended.append(c)
        parts = mended
    if parts[0]:
        parts[0] = FIRST + parts[0]
        return parts
    return parts[1:]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one slice have about ``chars`` characters at most, or are one text."""
    for batch in batches:
        sizes = np.array([len(v.as_py() or "") for v in batch.column(1)], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chars, side="right")))
            yield batch.slice(at, n)
            at += n


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` per document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            done = codec(path, pattern).round_trip([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(i) for i, _ in done], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4", copy=False)).hexdigest() for i, _ in done], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for _, b in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``, an array of token ids; null texts have no ids."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            done = codec(path, pattern).round_trip([t or "" for t in batch.column(1).to_pylist()])
            ids = pa.array([i.astype(np.int32) for i, _ in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tokens, "doc_id long, ids array<int>")


def encode_corpus(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``ids``, and ``decodes``: whether the ids give the text back."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done = codec(path, pattern).round_trip(texts)
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([len(i) for i, _ in done], pa.int64()),
                pa.array([i.astype(np.int32) for i, _ in done], pa.list_(pa.int32())),
                pa.array([b.tobytes() == t.encode() for (_, b), t in zip(done, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens", "ids", "decodes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(tokens, "doc_id long, source string, n_tokens long, ids array<int>, decodes boolean")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; bytes that aren't UTF-8 become U+FFFD."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.array(v or [], dtype=np.int64) for v in batch.column(1).to_pylist()]
            flat, n = codec(path, pattern).decode_ids(np.concatenate([np.empty(0, dtype=np.int64), *sequences]), np.array([len(s) for s in sequences], dtype=np.int64))
            made = [b.tobytes().decode("utf-8", "replace") for b in np.split(flat, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(texts, "doc_id long, text string")
