"""Nearest neighbours by an inverted file with product-quantised residuals.

1. Equal vectors form one class, named by its smallest id; a class keeps its ``top + 1``
   smallest ids, as no query can return more of them. The ids are cut to that number in
   the map tasks already, so one very common vector is no hot group.
2. Coarse centroids and codebooks are fitted on at most ``SAMPLE`` classes (the least hashes
   of their ids). Beyond ``MOST_LISTS`` times ``ROWS_OF_LIST`` vectors each coarse list is divided by the
   nearest of some centres of residuals, the same for all lists, so that lists stay short as the table grows.
3. Every class is indexed: its list, and one byte per ``SUBSPACE`` components of the
   residual. Lists are dealt to cells of about ``CELL`` vectors; longer lists are split by
   id hash, short ones share a cell.
4. The true neighbours of ``TRIALS`` of the queries among all rows tell how far to probe: the fewest lists that
   hold ``PROBED_SHARE`` of them, and likewise how far behind the nearest centre those of such lists are. Both are told for groups
   of ``ALIKE`` trials by how near the centres of the first lists that hold ``top + 1`` rows are. A query far
   from all others so probes as many lists as vectors like it need, one inside a cluster the lists of this cluster.
5. A query goes once to each cell that holds a list it probes. A task holds one cell and at most about
   ``QUERIES`` of its queries (cells with more are repeated), streamed in blocks: asymmetric distance tables score
   the vectors of the probed lists. The best by table are reranked by exact products of the original vectors, and so is
   every row that may be among them yet: whose table score is below the worst of these by no more than ``MARGIN`` times the deviation that its
   own quantisation error makes of a product with this query, as measured on rows of the cell.
6. Per query the best classes of all cells are merged and expanded to ids.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another length than the most frequent one, and rows with a null
id; of rows that repeat an id the least vector counts; with fewer candidates than ``top`` all
are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import materialise, shuffle_partitions
from feira.llm._text import mix64

#: Classes that centroids and codebooks are fitted on, at most.
SAMPLE = 16_384
#: Queries that the number of probed lists is measured with, at most.
TRIALS = 256
PROBED_SHARE = 0.99
#: How many deviations of a table score a row may lie below the worst of the best and still be reranked; rows of a cell that the
#: deviation is measured on, at most; the share of a table score that is rounding.
MARGIN, MEASURED, ROUNDING = 3.0, 256, 1e-5
#: Trials of about the same nearness to their first lists that share a number of lists.
ALIKE = 16
#: Coarse lists at most, and the mean length of a list from which they are divided.
MOST_LISTS, ROWS_OF_LIST = 1024, 1024
SUBSPACE, CODES = 4, 256
CELL = 8192
QUERY_BLOCK, QUERIES = 256, 32_768
RESULT_SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    """``codebooks[m, c]`` is word ``c`` of subspace ``m``; vectors are padded with zeros to whole subspaces.

    List ``l`` has the centre ``centroids[l // len(fine)] + fine[l % len(fine)]``.
    """

    centroids: np.ndarray
    fine: np.ndarray
    codebooks: np.ndarray
    top: int
    #: Rows of each list; ascending nearness, and from each on how many lists to probe, and how far behind the first.
    counts: np.ndarray | None = None
    nearness: np.ndarray | None = None
    probes: np.ndarray | None = None
    behind: np.ndarray | None = None

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.fine)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: its nearest centroid, and the nearest centre of what is left."""
        at = _nearest(x, self.centroids)
        return at * len(self.fine) + _nearest(x - self.centroids[at], self.fine)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Codes of the residuals, a byte per subspace."""
        rest = (x - self.centroids[lists // len(self.fine)] - self.fine[lists % len(self.fine)]).reshape(len(x), -1, SUBSPACE)
        return np.column_stack([_nearest(rest[:, m], book) for m, book in enumerate(self.codebooks)]).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each row from what its list and codes stand for."""
        rest = (x - self.centroids[lists // len(self.fine)] - self.fine[lists % len(self.fine)]).reshape(len(x), -1, SUBSPACE)
        return np.sqrt(sum(((rest[:, m] - book[codes[:, m]]) ** 2).sum(axis=1) for m, book in enumerate(self.codebooks)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of query parts with codewords: subspace, code, query."""
        return np.einsum("mcd,qmd->mcq", self.codebooks, q.reshape(len(q), -1, SUBSPACE)).astype(np.float32)

    def centre_products(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Products of the centres of lists with queries: list, query."""
        return ((self.centroids @ q.T)[lists // len(self.fine)] + (self.fine @ q.T)[lists % len(self.fine)]).astype(np.float32)

    def approximate(self, q: np.ndarray, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Products of indexed rows with queries as the tables give them: row, query."""
        total = self.centre_products(q, lists)
        for m, table in enumerate(self.tables(q)):
            total += table[codes[:, m]]
        return total

    def reranked(self, q: np.ndarray, near: np.ndarray, exact: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that may be the ``top + 1`` nearest of one query by its table scores ``near`` (finite ones), and their exact products."""
        depth = min(2 * (self.top + 1), len(near))
        first = np.argpartition(-near, depth - 1)[:depth]
        score = (exact[first] * q).sum(axis=1)
        if depth == len(near):
            return first, score
        some = np.arange(0, len(near), -(-len(near) // MEASURED))
        scale = errors * np.linalg.norm(q)
        off = 0.0
        for at, found in ((first, score), (some, exact[some] @ q)):
            inexact = scale[at] > 1e-9 * np.abs(found)
            if inexact.any():
                off = max(off, np.sqrt(np.mean(np.square((found - near[at])[inexact] / scale[at][inexact]))))
        rank = self.top + 1
        worst = np.partition(score, len(score) - rank)[len(score) - rank]
        might = near + MARGIN * off * scale + ROUNDING * np.abs(near) >= worst
        might[first] = False
        more = np.flatnonzero(might)
        return np.append(first, more), np.append(score, (exact[more] * q).sum(axis=1))

    def ordered(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """All lists, nearest centre first; how near they are to a query of length 1; and the place at which ``top + 1`` rows are reached."""
        score = ((self.centroids @ q)[:, None] + (self.fine @ q)[None]).ravel() / np.linalg.norm(q)
        order = np.argsort(-score, kind="stable")
        need = min(int(np.searchsorted(np.cumsum(self.counts[order]), self.top + 1)), len(order) - 1)
        return order, score[order], need

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists that a query probes."""
        order, near, need = self.ordered(q)
        group = max(np.searchsorted(self.nearness, near[need], side="right") - 1, 0)
        close = np.searchsorted(near[0] - near, self.behind[group], side="right")
        return order[: max(need + 1, self.probes[group], close)]

    def probe_for(self, counts: np.ndarray, trials: np.ndarray, trial: np.ndarray, lists: np.ndarray) -> None:
        """Sets how far to probe, from the rows of each list and the lists that hold the true neighbours of trials."""
        self.counts = counts
        found = []
        for i in np.unique(trial):
            order, near, need = self.ordered(trials[i])
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            at = place[lists[trial == i]]
            found.append((near[need], at, near[0] - near[at]))
        found.sort(key=lambda one: one[0])
        groups = np.array_split(np.arange(len(found)), max(1, len(found) // ALIKE))
        told = lambda part: np.array([_quantile(np.concatenate([found[i][part] for i in g]), PROBED_SHARE) for g in groups])
        self.nearness = np.array([found[g[0]][0] for g in groups])
        for name, values in (("probes", told(1) + 1), ("behind", told(2))):
            values = np.maximum.accumulate(values[::-1])[::-1]  # at least as much as for nearer ones
            setattr(self, name, np.maximum(values, np.append(values[:1], values[:-1])))  # and as for the group before


def _quantile(values: np.ndarray, share: float) -> float:
    return np.sort(values)[min(len(values) - 1, int(share * len(values)))]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a block of rows at a time."""
    half = (centres**2).sum(axis=1) / 2
    blocks = [(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(blocks) if blocks else np.empty(0, dtype=np.intp)


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.vstack([centres, np.zeros((k - len(centres), x.shape[1]), dtype=x.dtype)])
    for _ in range(rounds):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        filled, start = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        centres[filled] = sums / np.diff([*start, len(x)])[:, None]
    return centres


def fit(sample: np.ndarray, n: int, top: int) -> Index:
    """An index for ``n`` vectors from a sample of them (rows, padded)."""
    coarse = int(max(1, min(MOST_LISTS, round(n**0.5), len(sample) // 8 or 1)))
    centroids = _k_means(sample, coarse)
    rest = sample - centroids[_nearest(sample, centroids)]
    divided = min(-(-n // (coarse * ROWS_OF_LIST)), len(sample) // 8)
    fine = _k_means(rest, divided) if divided > 1 else np.zeros((1, sample.shape[1]))
    rest = (rest - fine[_nearest(rest, fine)]).reshape(len(sample), -1, SUBSPACE)
    books = np.stack([_k_means(np.ascontiguousarray(rest[:, m]), CODES) for m in range(rest.shape[1])])
    return Index(centroids, fine, books, top)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded to ``width``."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, width))
    return np.pad(flat, ((0, 0), (0, width - flat.shape[1])))


def _packed(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x.astype(kind))], pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vectors = vectors.filter(finite & F.exists("embedding", lambda v: v != 0))
    usual = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    return vectors.join(F.broadcast(usual), F.size("embedding") == F.col("width")).select("vec_id", "embedding")  # one row


def vector_classes(vectors: DataFrame, top: int) -> DataFrame:
    """``rep``, ``members`` (its smallest ids) and ``embedding`` of each distinct vector, with its hashes ``k1`` and ``k2``."""
    single = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    keyed = single.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = keyed.withColumn("place", first).filter(F.col("place") <= top + 1)
    return few.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("members"), F.min_by("embedding", "vec_id").alias("embedding"))


def _search(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell and part of its queries: first its indexed rows by list, then the queries, in that order."""
    cell, block = None, None
    parts: list[pa.RecordBatch] = []

    def built() -> tuple:
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if table is None:
            return None
        lists = table["list"].to_numpy()
        exact = _unpacked(table["vector"].combine_chunks(), np.float64)
        edges = np.append(np.flatnonzero(np.append(True, np.diff(lists) != 0)), len(lists))
        return table["rep"].to_numpy(), lists, edges, _unpacked(table["codes"].combine_chunks(), np.uint8), table["error"].to_numpy(), exact

    def answered(queries: pa.RecordBatch) -> pa.RecordBatch:
        reps, lists, edges, codes, errors, exact = block
        q = _unpacked(queries.column("vector"), np.float64)
        present, tables = lists[edges[:-1]], index.tables(q)
        allowed = np.stack([np.isin(present, np.frombuffer(probes.as_py(), dtype=np.int32)) for probes in queries.column("codes")])
        near = np.full((len(q), len(lists)), -np.inf, dtype=np.float32)
        for at, lo, hi in zip(range(len(present)), edges, edges[1:], strict=False):
            who = np.flatnonzero(allowed[:, at])
            total = np.repeat(index.centre_products(q[who], present[at : at + 1]), hi - lo, axis=0)
            for m in range(len(tables)):
                total += tables[m][:, who][codes[lo:hi, m]]
            near[who, lo:hi] = total.T
        out: list[list] = [[], [], []]
        for i, name in enumerate(queries.column("rep").to_numpy()):
            probed = np.flatnonzero(np.isfinite(near[i]))
            at, score = index.reranked(q[i], near[i, probed], exact[probed], errors[probed])
            at = probed[at]
            chosen = np.lexsort((reps[at], -score))[: index.top + 1]
            out[0].append(np.full(len(chosen), name))
            out[1].append(reps[at][chosen])
            out[2].append(score[chosen])
        columns = [np.concatenate(c) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "rep", "score"])

    for batch in batches:
        cells, shares, kinds = (batch.column(name).to_numpy() for name in ("cell", "part", "kind"))
        edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(shares) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if (cells[lo], shares[lo]) != cell:
                cell, parts, block = (cells[lo], shares[lo]), [], None
            if kinds[lo] == 0:
                parts.append(batch.slice(lo, hi - lo))
                continue
            if block is None:
                block = built()
            for at in range(lo, hi, QUERY_BLOCK):
                if block is not None:
                    yield answered(batch.slice(at, min(QUERY_BLOCK, hi - at)))


def nearest_neighbours(rows: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest candidates of each query.

    ``rows`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    Nearness is the inner product; a query is no candidate of its own.
    """
    spark = rows.sparkSession
    vectors = usable(rows)
    classes = materialise(vector_classes(vectors, top), "vector-classes")
    # At most SAMPLE vectors.
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], RESULT_SCHEMA)
    width = -(-len(sample[0]) // SUBSPACE) * SUBSPACE
    wanted = vectors.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    wanted = wanted.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    asked = materialise(wanted.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("query_id", "rep"), "queries")
    heads = classes.select("rep", "embedding").join(asked.select("rep").distinct(), "rep", "left_semi")
    # At most TRIALS vectors.
    tried = heads.orderBy(F.xxhash64(F.lit(2), "rep"), "rep").limit(TRIALS).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(tried):
        return spark.createDataFrame([], RESULT_SCHEMA)
    index, trials = fit(_vectors(sample, width), classes.count(), top), _vectors(tried, width)
    fitted = spark.sparkContext.broadcast(index)  # at most MOST_LISTS and SAMPLE / 8 centres, and the codebooks

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), width)
            lists = fitted.value.lists_of(x)
            codes = fitted.value.encode(x, lists)
            columns = [batch.column(0), pa.array(lists, pa.int32()), _packed(codes, np.uint8), pa.array(fitted.value.errors(x, lists, codes), pa.float64()), _packed(x, np.float64)]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "list", "codes", "error", "vector"])

    file = materialise(classes.select("rep", "embedding").mapInArrow(indexed, "rep long, list int, codes binary, error double, vector binary"), "inverted-file")

    def nearest_to_trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(trial, score, rep, list) of the nearest rows of a task."""
        best = [np.full((len(trials), top + 1), fill) for fill in (-np.inf, -1, -1)]
        for batch in batches:
            scores = trials @ _unpacked(batch.column("vector"), np.float64).T
            shape = scores.shape
            new = [scores, *(np.broadcast_to(batch.column(c).to_numpy(), shape) for c in ("rep", "list"))]
            joined = [np.hstack([a, b]) for a, b in zip(best, new, strict=True)]
            at = np.argpartition(-joined[0], top, axis=1)[:, : top + 1]
            best = [np.take_along_axis(x, at, axis=1) for x in joined]
        who, place = np.nonzero(best[2] >= 0)
        columns = [pa.array(who, pa.int32()), *(pa.array(x[who, place], k) for x, k in zip(best, (pa.float64(), pa.int64(), pa.int32()), strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["trial", "score", "rep", "list"])

    tried = file.select("rep", "list", "vector").mapInArrow(nearest_to_trials, "trial int, score double, rep long, list int")
    tried = tried.withColumn("place", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "rep"))).filter(F.col("place") <= top + 1)
    told = tried.select("trial", "list").toPandas()  # at most TRIALS * (top + 1) rows of two numbers
    # One number per list, and the centres bound the number of lists.
    sizes = file.groupBy("list").count().toPandas()
    counts = np.zeros(index.lists, dtype=np.int64)
    counts[sizes["list"]] = sizes["count"]
    index.probe_for(counts, trials, told["trial"].to_numpy(), told["list"].to_numpy())
    # Cells of lists, short lists together.
    first, split, used, cell = np.zeros(index.lists, dtype=np.int64), np.ones(index.lists, dtype=np.int64), 0, 0
    for name, n in enumerate(counts.tolist()):
        if not n:
            continue
        if used and used + n > CELL:
            used, cell = 0, cell + 1
        first[name], split[name] = cell, -(-n // CELL)
        used += n
        if split[name] > 1:
            used, cell = 0, cell + split[name]
    shared = spark.sparkContext.broadcast((index, first, split))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, lengths = shared.value
        for batch in batches:
            lists = batch.column("list").to_numpy()
            share = mix64(batch.column("rep").to_numpy().view(np.uint64)) % lengths[lists].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(starts[lists] + share.astype(np.int64)), *batch.columns], ["cell", *batch.schema.names])

    stored = file.mapInArrow(placed, "cell long, rep long, list int, codes binary, error double, vector binary")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, starts, lengths = shared.value
        for batch in batches:
            x = _vectors(batch.column(1), width)
            cells, codes, at = [], [], []
            for i, q in enumerate(x):
                to: dict[int, list[int]] = {}
                for one in index.probed(q).tolist():
                    for c in range(starts[one], starts[one] + lengths[one]):
                        to.setdefault(c, []).append(one)
                at += [i] * len(to)
                cells += to
                codes += [np.array(v, dtype=np.int32).tobytes() for v in to.values()]
            names = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), names, pa.array(codes, pa.binary()), _packed(x[at], np.float64)], ["cell", "rep", "codes", "vector"])

    queries = materialise(heads.mapInArrow(probing, "cell long, rep long, codes binary, vector binary"), "probes")
    # Cells that nobody asks are left out; those of many queries are repeated for parts of these.
    parts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    rows_of = stored.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asking = queries.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumns({"list": F.lit(-1), "error": F.lit(0.0)})
    columns = ["cell", "part", "kind", "rep", "list", "codes", "error", "vector"]
    dealt = rows_of.withColumn("kind", F.lit(0)).select(columns).unionByName(asking.withColumn("kind", F.lit(1)).select(columns))
    dealt = dealt.repartition(shuffle_partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "kind", "list")
    found = dealt.mapInArrow(lambda batches: _search(shared.value[0], batches), "query long, rep long, score double")

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = found.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= top + 1)
    named = best.join(classes.select("rep", "members"), "rep").select("query", F.explode("members").alias("vec_id"), "score")
    answers = named.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= top + 1)
    answers = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    ranked = asked.join(answers, asked["rep"] == answers["query"]).select("query_id", F.posexplode(others).alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
