"""Toxicity scores from a subsequence string kernel and Nyström landmarks, trained on labelled sentences.

A text is cut into sentences, and these into runs of at most ``WORDS`` words. A run is a string
of letters and word ends: marks and digits inside words are dropped, accents too, and runs of
single letters are joined, so spaced-out and dotted insults are words again. Two such strings
are compared by the gap-weighted subsequence kernel of order 3: every three symbols that both
hold in that order within ``SPAN`` places count, ``DECAY`` to the power of the symbols
skipped, times the rarity of the three. A letter inserted or left out only lowers the kernel.

Training, on at most ``SAMPLE`` labelled documents of each class and ``RUNS`` runs of each document:

1. A toxic document's label is that of its worst sentence, and most of its runs are harmless. Those that
   hold four symbols whose share of toxic runs is too high for chance (log-likelihood ratio above the
   logarithm of the number tested) stand for it; without any, all do. Some are repeated with a letter inserted.
2. ``LANDMARKS`` labelled runs span the Nyström features, and a linear support vector machine is fitted to
   these on at most ``EXAMPLES`` runs of each label; clean runs that score highest are landmarks and examples of
   the next of ``ROUNDS`` fits. The machine is a weighted sum of kernels with landmarks, each a product
   of subsequence vectors, so it is kept as one vector over subsequences.
3. A logistic model over a document's ``TOP`` highest run scores and the share of runs above zero gives its score.

Whole texts are scored in Arrow tasks without a shuffle, ``PIECE`` characters at a time. Inputs of a score are the text
and the trained model, nothing else.

Defined cases: null and blank texts have no runs and get the score of such texts; without
labelled documents of both classes every score is the share of toxic ones; labels with null ids or
classes are ignored, and of repeated labels the largest counts; repeated rows are
scored each; equal texts have equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that the model is fitted on, at most, and runs of words of each of these by class.
SAMPLE = 4000
RUNS = (20, 200)
LANDMARKS, EXAMPLES, ROUNDS = 700, 4000, 3
COST, DECAY, SPAN = 10.0, 0.6, 5
#: Words of a run.
WORDS = 3
TOP = 3
#: Score of a run that a text lacks, and runs that the share of those above zero is held against.
NO_RUN, FEW_RUNS = -1.5, 10.0
#: Characters scored at once.
PIECE = 1 << 20

#: Distances between the first and second and the second and third symbol.
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]
WEIGHTS = DECAY ** (np.array(GAPS).sum(axis=1) - 2.0)
CODES = 1 << 15
_DROP, _STOP, _LINE = 253, 254, 255


def _symbol(point: int) -> int:
    """A character's symbol: 0 ends a word, 1 to 26 are letters without accents, 27 to 29 letters of other alphabets."""
    c = chr(point)
    if c == "\n":
        return _LINE
    if c in ".!?":
        return _STOP
    if c.isspace():
        return 0
    if not c.isalpha():
        return _DROP
    plain = unicodedata.normalize("NFKD", c)[0].lower()
    return ord(plain) - 96 if "a" <= plain <= "z" else 27 + point % 3


_symbols: list[np.ndarray] = []


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a text, each run behind a word end and before ``SPAN`` of them, and the start of each run."""
    if not _symbols:
        _symbols.append(np.array([_symbol(p) for p in range(1 << 16)], dtype=np.uint8))
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _symbols[0][np.minimum(points, (1 << 16) - 1)]
    white = (kind == 0) | (kind == _LINE)
    ends = (kind == _LINE) | ((kind == _STOP) & np.append(white[1:], True))
    kept = (kind < 30) | ends
    kind, ends = np.where(ends, 0, kind)[kept], ends[kept]
    letter = kind > 0
    word = np.cumsum(letter & ~np.append(False, letter[:-1])) - 1  # of a word end: the one before
    n = int(word[-1]) + 1
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    closed = np.zeros(n, dtype=bool)  # words that end a sentence
    closed[word[ends & (word >= 0)]] = True
    # From three single letters in a row on, they are one word.
    single = np.bincount(word[letter], minlength=n) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    joined = np.zeros(n, dtype=bool)
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        joined[lo + 1 : hi] = hi - lo >= 3
    unit = np.cumsum(~joined) - 1
    closed = np.logical_or.reduceat(closed, np.flatnonzero(~joined))
    sentence = np.concatenate([[0], np.cumsum(closed[:-1])])
    first = np.flatnonzero(np.append(True, np.diff(sentence) != 0))
    run = np.cumsum((np.arange(len(sentence)) - first[sentence]) % WORDS == 0) - 1
    of_letter = unit[word[letter]]
    run_of = run[of_letter]
    begins = np.append(True, np.diff(of_letter) != 0)
    place = np.arange(len(of_letter)) + np.cumsum(begins) + SPAN * run_of
    out = np.zeros(place[-1] + 1 + SPAN, dtype=np.uint8)
    out[place] = kind[letter]
    return out, place[np.append(True, np.diff(run_of) != 0)] - 1


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps the subsequences that begin at each place, and their weight."""
    c, n = codes.astype(np.int32), len(codes) - SPAN
    for (a, b), weight in zip(GAPS, WEIGHTS.tolist(), strict=True):
        yield (c[:n] << 10) | (c[a : a + n] << 5) | c[a + b : a + b + n], weight


def run_scores(codes: np.ndarray, starts: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The kernel sum of each run: its subsequence vector, of a length that its symbols give, times ``vector``."""
    if not len(starts):
        return np.zeros(0)
    value = np.zeros(len(codes))
    for codes_of, weight in _triples(codes):
        value[: len(codes) - SPAN] += weight * vector[codes_of]
    ends = np.append(starts[1:], len(codes)) - SPAN
    return np.add.reduceat(value, np.column_stack([starts, ends]).ravel())[::2] / _norm(ends - starts)


def _norm(n: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(n, 8) * (WEIGHTS**2).sum())


def runs_of(text: str) -> list[bytes]:
    """The runs of a text as strings of symbols."""
    codes, starts = symbols(text)
    packed, edges = codes.tobytes(), [*starts.tolist(), len(codes)]
    return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _flat(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in runs], dtype=np.int64)
    return np.frombuffer(b"".join(runs), dtype=np.uint8), np.cumsum(n) - n


def _blocks(runs: list[bytes], n: int) -> Iterator[list[bytes]]:
    for lo in range(0, len(runs), n):
        yield runs[lo : lo + n]


def _rows(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where a run's subsequences begin (all but its last ``SPAN``), and their runs."""
    ends = np.append(starts[1:], len(codes)) - SPAN
    row = np.repeat(np.arange(len(starts)), ends - starts)
    return np.arange(len(row)) + SPAN * row, row


def dense(runs: list[bytes], column: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Subsequence vectors as rows, with the columns that ``column`` names (-1 leaves one out)."""
    codes, starts = _flat(runs)
    place, row = _rows(codes, starts)
    width = int(column.max()) + 1
    out = np.zeros(len(runs) * width)
    for found, weight in _triples(codes):
        found = found[place]
        at = column[found]
        np.add.at(out, (row * width + at)[at >= 0], weight * rarity[found[at >= 0]])
    out = out.reshape(len(runs), width)
    out /= _norm(np.bincount(row, minlength=len(runs)))[:, None]
    return out


def subsequences_of(runs: list[bytes]) -> np.ndarray:
    """In how many of the runs each subsequence occurs."""
    out = np.zeros(CODES, dtype=np.int64)
    for block in _blocks(runs, 2000):
        codes, starts = _flat(block)
        place, row = _rows(codes, starts)
        met = np.unique(np.concatenate([row * CODES + found[place] for found, _ in _triples(codes)]))
        out += np.bincount(met % CODES, minlength=CODES)
    return out


def _fours(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, four symbols in a row) once each, but for those without two letters in the middle."""
    codes, starts = _flat(runs)
    c = codes.astype(np.int64)
    row = np.repeat(np.arange(len(runs)), np.diff(np.append(starts, len(codes))))[:-3]
    four = c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:]
    both = np.unique((row << 20 | four)[(c[1:-2] > 0) & (c[2:-1] > 0)])
    return both >> 20, both & ((1 << 20) - 1)


def telling_runs(toxic: list[bytes], clean: list[bytes]) -> np.ndarray:
    """Which of the toxic documents' runs hold four symbols that are too frequent there for chance."""
    a, b = (np.zeros(1 << 20), np.zeros(1 << 20))
    for count, runs in ((a, toxic), (b, clean)):
        for block in _blocks(runs, 10_000):
            count += np.bincount(_fours(block)[1], minlength=1 << 20)
    rate = len(toxic) / (len(toxic) + len(clean))
    own = a / np.maximum(a + b, 1)
    gain = np.zeros(1 << 20)
    more = (own > rate) & (a > 0)
    gain[more] = a[more] * np.log(own[more] / rate) + b[more] * np.log(np.maximum(1 - own[more], 1e-12) / (1 - rate))
    clear = (gain > math.log(max((a + b > 0).sum(), 1)) + 1) & (own > (1 + rate) / 2)
    told = []
    for block in _blocks(toxic, 10_000):
        row, four = _fours(block)
        told.append(np.bincount(row[clear[four]], minlength=len(block)) > 0)
    return np.concatenate(told)


@dataclass
class Model:
    """A run's score is its subsequence vector times ``vector`` plus ``bias``; ``head`` scores documents."""

    vector: np.ndarray
    bias: float
    head: np.ndarray
    share: float

    def features(self, texts: list[str]) -> np.ndarray:
        """The ``TOP`` highest run scores of each text, and the log odds of a score above zero."""
        out = np.full((len(texts), TOP + 1), NO_RUN)
        for row, text in enumerate(texts):
            best, above, n = np.empty(0), 0, 0
            for part in _pieces(text):
                score = run_scores(*symbols(part), self.vector) + self.bias
                best = np.sort(np.append(best, score))[::-1][:TOP]
                above, n = above + int((score > 0).sum()), n + len(score)
            out[row, : len(best)] = best
            out[row, TOP] = math.log((above + 0.5) / (n - above + FEW_RUNS))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.head):
            return np.full(len(texts), self.share)
        return _probability(_inputs(self.features(texts)), self.head)


def _pieces(text: str) -> Iterator[str]:
    """A text cut at white space into parts of at most ``PIECE`` characters; a longer word is cut inside."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            end = end if end > at else at + PIECE
        yield text[at:end]
        at = end


def _inputs(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features])


def _probability(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    # Summed by row, so that equal texts have equal scores whatever stands beside them.
    return 1 / (1 + np.exp(-np.clip((x * head).sum(axis=1), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    head = np.zeros(x.shape[1])
    for _ in range(30):
        p = _probability(x, head)
        gradient = x.T @ (weight * (p - y)) + ridge * head
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(head))
        head -= np.linalg.solve(hessian, gradient)
    return head


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15, block: int = 1000) -> np.ndarray:
    """A linear support vector machine (L2 hinge) by Newton steps over the examples inside the margin; y is -1 or 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        left, right = np.eye(len(w)), np.zeros(len(w))
        for lo in range(0, len(x), block):
            part, sign, c = x[lo : lo + block].astype(float), y[lo : lo + block], cost[lo : lo + block]
            inside = sign * (part @ w) < 1
            part, c, sign = part[inside], c[inside], sign[inside]
            left += 2 * (part * c[:, None]).T @ part
            right += 2 * part.T @ (c * sign)
        w = np.linalg.solve(left, right)
    return w


def _fit_runs(toxic: list[bytes], clean: list[bytes]) -> tuple[np.ndarray, float]:
    """The vector and bias of the machine, from the runs of toxic and of clean documents."""
    rng = np.random.default_rng(11)
    some = lambda rows, n: rows[rng.permutation(len(rows))[:n]]
    told = np.flatnonzero(telling_runs(toxic, clean))
    positive = [toxic[i] for i in some(told if len(told) else np.arange(len(toxic)), EXAMPLES)]
    landmarks = positive[: LANDMARKS // 2]
    # With a letter inserted somewhere inside a word.
    for run in positive[: EXAMPLES // 4]:
        inside = [i for i in range(2, len(run) - SPAN) if run[i - 1] and run[i]]
        if inside:
            at = inside[rng.integers(len(inside))]
            positive.append(run[:at] + bytes([rng.integers(1, 27)]) + run[at:])
    counted = [clean[i] for i in some(np.arange(len(clean)), 20_000)] + [toxic[i] for i in some(np.arange(len(toxic)), 20_000)]
    rarity = np.log((len(counted) + 1) / (subsequences_of(counted) + 1)) / math.log(len(counted) + 1)
    hard = negative = some(np.arange(len(clean)), EXAMPLES)
    codes, starts = _flat(clean)
    for _ in range(ROUNDS):
        chosen = landmarks + [clean[i] for i in hard[: LANDMARKS // 4]] + [clean[i] for i in some(np.arange(len(clean)), LANDMARKS // 4)]
        used = np.flatnonzero(subsequences_of(chosen))
        column = np.full(CODES, -1)
        column[used] = np.arange(len(used))
        base = np.empty((len(chosen), len(used)), dtype=np.float32)
        for i, block in enumerate(_blocks(chosen, 64)):
            base[64 * i : 64 * i + len(block)] = dense(block, column, rarity)
        values, vectors = np.linalg.eigh((base @ base.T).astype(float))
        kept = values > 1e-5 * values[-1]
        to_features = base.T @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)  # vectors times this are Nyström features
        del base
        examples = positive + [clean[i] for i in negative]
        x = np.ones((len(examples), to_features.shape[1] + 1), dtype=np.float32)  # the last column is for the bias
        for i, block in enumerate(_blocks(examples, 64)):
            x[64 * i : 64 * i + len(block), :-1] = dense(block, column, rarity).astype(np.float32) @ to_features
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w = fit_svm(x, y, np.where(y > 0, COST * len(negative) / len(positive), COST))
        vector, bias = np.zeros(CODES), float(w[-1])
        vector[used] = (to_features @ w[:-1].astype(np.float32)) * rarity[used]
        hard = np.argsort(-run_scores(codes, starts, vector), kind="stable")[: EXAMPLES * 3 // 4]
        negative = np.unique(np.concatenate([hard, some(np.arange(len(clean)), EXAMPLES)]))
    return vector, bias


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """The training documents (``doc_id``, ``text``, ``toxic``) and the number of labelled ones of each class."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most 2 * sample rows of two numbers.
    picked = F.broadcast(by_hash(0).unionByName(by_hash(1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(picked, "doc_id"), counts


def _sampled_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, run) for the ``RUNS`` runs with the least hashes of each labelled document."""
    for batch in batches:
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            found = {run for part in _pieces(text.as_py() or "") for run in runs_of(part)}
            least = sorted(found, key=lambda run: (zlib.crc32(run), run))[: RUNS[toxic]]
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(least), pa.int32()), pa.array(least, pa.binary())], ["toxic", "run"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on labelled documents outside the held-out fifth."""
    rows, counts = labelled(docs, labels.filter("toxic IN (0, 1)"), sample)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    constant = Model(np.zeros(0), 0.0, np.zeros(0), share)
    if not counts.get(0) or not counts.get(1):
        return constant
    # At most sample * RUNS strings of a few words.
    found = rows.mapInArrow(_sampled_runs, "toxic int, run binary").distinct().toArrow()
    toxic, clean = (sorted(found["run"].filter(pc.equal(found["toxic"], c)).to_pylist()) for c in (1, 0))
    del found
    if not toxic or not clean:
        return constant
    vector, bias = _fit_runs(toxic, clean)
    model = Model(vector, bias, np.zeros(0), share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.features([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(values[:, i]) for i in range(TOP + 1))], ["toxic", *(f"f{i}" for i in range(TOP + 1))])

    # At most 2 * sample rows of TOP + 1 numbers, and repeated ids.
    table = rows.mapInArrow(features, "toxic int, " + ", ".join(f"f{i} double" for i in range(TOP + 1))).toPandas()
    table = table.sort_values(list(table.columns))
    y = table["toxic"].to_numpy(dtype=float)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0]) * len(y) / total
    model.head = fit_logistic(_inputs(table[[f"f{i}" for i in range(TOP + 1)]].to_numpy()), y, weight)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vector of 2^15 numbers and a few more

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                value = shared.value.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(scores, "doc_id long, score double")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts]))

    return docs.filter(score(F.col("text").cast("string")) < 0.5)
