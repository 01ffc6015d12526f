"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Rows are dealt evenly into blocks of some ``BLOCK`` values.  One task holds a block, sorts it by
every dimension once and lets queries stream past.  A query reads the lists in step, from the end
that its sign favours; rows met are scored in full, and reading stops when the best score that an
unseen row could reach (the sum over the lists at the present depth) is below the k-th score known.
Equal bounds go on, since a tie may have a smaller id.

Every query first searches one block.  The k-th score found there goes with it to the other blocks
as a floor, so the depth at which reading must stop is known before reading and found by bisection;
a block whose first bound is below the floor is not read at all.  Where a query has to read as many
list entries as the block has rows, all rows of the block count as met, and such queries are scored
together by one matrix product.  The blocks' answers are merged by rank.

Rows are shuffled twice (once for each round), whatever their number; queries once for each block.

Edge cases: a null vector, or one with a null or non-finite component, takes no part, and neither
does a row without an id; only vectors of the query's length are compared; rows that repeat id and
vector are one query but each a candidate (of other queries); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.shipping import materialise, ship

BLOCK = 1 << 21
SCORES = 1 << 22
STEP = 8
SCALE = 64


def quantise(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and floor(scale * x) of each vector, as 64-bit integers."""

    def run(batches):
        for batch in batches:
            keep, dims, out = [], [], []
            ids = batch.column("vec_id").to_pylist()
            vectors = batch.column("embedding")
            whole = vectors.flatten()
            finite = np.asarray(whole.is_valid()) if whole.null_count else np.ones(len(whole), bool)
            values = np.asarray(whole.fill_null(0) if whole.null_count else whole).astype(np.float64)
            finite &= np.isfinite(values)
            levels = np.floor(scale * np.where(finite, values, 0)).astype(np.int64)
            sizes = np.diff(np.asarray(vectors.offsets)) * np.asarray(vectors.is_valid())
            stops = np.cumsum(sizes)
            for i, (stop, n) in enumerate(zip(stops, sizes)):
                if ids[i] is not None and n and finite[stop - n : stop].all():
                    keep.append(ids[i])
                    dims.append(int(n))
                    out.append(levels[stop - n : stop].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


class Lists:
    """A block of vectors with its lists: rows by falling value of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.largest = int(np.abs(vectors).max()) if vectors.size else 0
        self.order = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self._cast: dict[type, np.ndarray] = {}

    def kind(self, queries: np.ndarray) -> type:
        """The fastest number type in which every score of these queries is exact."""
        reach = self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self._cast:
            self._cast[kind] = self.vectors.astype(kind)
        return self._cast[kind]

    def bounds(self, queries: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The best score of a row not met when ``depth`` (below the block's size) entries are read."""
        at = np.where(queries < 0, len(self.ids) - 1 - depth[:, None], depth[:, None])
        return (self.values[at, np.arange(queries.shape[1])] * queries).sum(axis=1)

    def depths(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """The least depth at which no row unmet can reach the floor, by bisection: bounds fall."""
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.ids))
        while (low < high).any():
            middle = (low + high) // 2
            done = (middle == high) | (self.bounds(queries, np.minimum(middle, len(self.ids) - 1)) < floors)
            low, high = np.where(done, low, middle + 1), np.where(done, middle, high)
        return low

    def met(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows among the first ``depth`` entries of the query's lists."""
        n = len(self.ids)
        seen = np.zeros(n, bool)
        seen[self.order[:depth, query > 0].ravel()] = True
        seen[self.order[n - depth :, query < 0].ravel()] = True
        return np.flatnonzero(seen)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        kind = self.kind(query[None, :])
        return (self.rows(kind)[rows] @ query.astype(kind)).astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of these rows, best first, without rows whose id is ``own``."""
        ids = self.ids[rows]
        ids, scores = ids[ids != own], scores[ids != own]
        if len(ids) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def first(self, query: np.ndarray, own: int, k: int) -> int | None:
        """A k-th score to begin with, reading deeper until there is one or every row counts as met."""
        used, depth = int(np.count_nonzero(query)), 1
        while depth * used < len(self.ids) and used:
            rows = self.met(query, depth)
            _, scores = self.best(rows, self.scores(query, rows), own, k)
            if len(scores) == k:
                return int(scores[-1])
            depth *= STEP
        return None

    def top(self, queries: np.ndarray, owns: list[int], floors: list[int | None], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best rows, best first; rows below its floor may miss."""
        lowest = np.iinfo(np.int64).min
        known = [self.first(q, own, k) if floor is None else floor for q, own, floor in zip(queries, owns, floors)]
        limits = np.array([lowest if f is None else f for f in known], np.int64)
        used = np.count_nonzero(queries, axis=1)
        depths = self.depths(queries, limits)
        whole = (depths > 0) & ((depths * used >= len(self.ids)) | (used == 0))
        found: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], self.ids[:0])] * len(queries)
        for i in np.flatnonzero(~whole & (depths > 0)):
            rows = self.met(queries[i], int(depths[i]))
            found[i] = self.best(rows, self.scores(queries[i], rows), owns[i], k)
        these = np.flatnonzero(whole)
        size = max(1, SCORES // max(1, len(self.ids)))
        for part in (these[i : i + size] for i in range(0, len(these), size)):
            kind = self.kind(queries[part])
            scored = queries[part].astype(kind) @ self.rows(kind).T
            for i, scores in zip(part, scored):
                rows = np.flatnonzero(scores >= limits[i])
                found[i] = self.best(rows, scores[rows].astype(np.int64), owns[i], k)
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


FOUND = "vec_id long, q long, dim int, block int, v binary, floor long, ids array<long>, scores array<long>"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a batch with one length, block and role."""
    if batch.num_rows:
        keys = [np.asarray(batch.column(c).cast(pa.int64())) for c in ("dim", "block", "asks")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield tuple(int(k[start]) for k in keys), batch.slice(start, stop - start)


def _rounds(rows: DataFrame, queries: DataFrame, blocks: int, k: int, carry: bool) -> DataFrame:
    """The best rows of each query within the block it names; ``carry`` hands its vector on."""

    def run(batches):
        held, key, lists = [], None, None
        for batch in batches:
            for (dim, block, asks), part in _runs(batch):
                if key != (dim, block):
                    held, key, lists = [], (dim, block), None
                if not asks:
                    held.append(part)
                    continue
                if lists is None:
                    ids = np.concatenate([np.asarray(p.column("vec_id")) for p in held]) if held else np.zeros(0, np.int64)
                    vectors = np.concatenate([_matrix(p.column("v")) for p in held]) if held else np.zeros((0, dim), np.int64)
                    held, lists = [], Lists(ids, vectors)
                if not len(lists.ids) and not carry:
                    continue
                floors = part.column("floor").to_pylist()
                found = lists.top(_matrix(part.column("v")), part.column("vec_id").to_pylist(), floors, k) if len(lists.ids) else [(lists.ids, lists.ids)] * part.num_rows
                if not carry:
                    some = pa.array([len(ids) > 0 for ids, _ in found])
                    part, found = part.filter(some), [f for f in found if len(f[0])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        part.column("q"),
                        part.column("dim"),
                        part.column("block"),
                        part.column("v") if carry else pa.nulls(part.num_rows, pa.binary()),
                        pa.array([int(s[-1]) if len(s) == k else None for _, s in found], pa.int64()),
                        pa.array([ids.tolist() for ids, _ in found], pa.list_(pa.int64())),
                        pa.array([s.tolist() for _, s in found], pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "q", "dim", "block", "v", "floor", "ids", "scores"],
                )

    none = F.lit(None).cast("long")
    offered = rows.select("dim", "block", F.lit(False).alias("asks"), "vec_id", none.alias("q"), "v", none.alias("floor"))
    sent = offered.unionByName(queries.withColumn("asks", F.lit(True)).select(*offered.columns))
    dealt = sent.repartition(2 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    return dealt.mapInArrow(run, FOUND)


def search(table: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """The ``k`` rows of highest inner product for each row whose id is divisible by ``every``."""
    ship(table.sparkSession)
    kept = materialise(quantise(table, scale).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    blocks = max(1, -(-(kept.agg(F.sum("dim")).first()[0] or 0) // BLOCK))
    rows = kept.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int"))
    queries = kept.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "v").dropDuplicates(["vec_id", "v"]).withColumn("q", F.xxhash64("v"))
    home = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    near = materialise(_rounds(rows, home, blocks, k, carry=True))
    others = F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("block"))
    far = _rounds(rows, near.withColumn("block", F.explode(others)), blocks, k, carry=False) if blocks > 1 else near.limit(0)
    found = near.unionByName(far).select("vec_id", "q", F.explode(F.arrays_zip("ids", "scores")).alias("f"))
    found = found.select(F.col("vec_id").alias("query_id"), "q", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
