"""Exact repeats between token sequences (bytes or words), found through winnowed anchors.

A *window* is ``spec.window`` consecutive tokens of one document.  The operators built on this
module remove what is covered by windows that also start earlier.  Enumerating all windows would
shuffle many times the corpus, so each window is represented by its *anchor*: the leftmost least
hash among its ``spec.seed``-token grams.  Equal windows have the same anchor at the same place, so
they meet at that anchor, and one anchor stands for about half a window's length of positions.

1. ``seeds``: anchors of every text, with a hash of the anchor's whole *context* (all windows it
   can stand for).  Copies of a context within a chunk are settled on the spot, so a group of
   copies sends one row per chunk, not one per copy.
2. ``matched``: one shuffle by anchor.  An anchor found once drops out; a context that is a copy of
   an earlier one is covered entirely; where one anchor has several contexts, they must be compared.
3. ``contexts``: the tokens around the anchors that must be compared.
4. ``compared``: within an anchor's bucket, the operator's own comparison (suffix array intervals,
   or extension both ways) gives covered spans.
5. ``apply``: spans and texts meet again by document.  Steps 3 to 5 are one plan, so the exchange
   of texts that step 3 makes is used again and texts are shuffled once.

An anchor bucket of more than ``SPLIT`` contexts (a frequent passage in ever different surroundings)
is not gathered but split (``halved``): windows that start at most half as far before the anchor
share more of what follows it, the others more of what precedes it, so each half is dealt anew by
the tokens its windows share, down to single windows.  Every part is compared in the same way; a
part whose contexts share one window and that is still too large is cut, and each piece gets the
earliest context.

Documents are told apart by id and, where rows of one id have different texts, by a hash of the
text (``copy``, else 0).  Such rows are ordered by that hash where ``across`` is not set; where it
is, neither is earlier than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.identity import told_apart
from kvloom.llm.shipping import materialise, ship
from kvloom.llm.textops import Chunk, Slices, chunks, ids, mix, signed, slice_hash, words

SPLIT = 100_000  # contexts that one task compares: some 50 MB with those of windows of 100 bytes


@dataclass(frozen=True)
class Spec:
    """``across``: only windows of documents with a smaller id count as earlier."""

    words: bool
    window: int
    seed: int
    across: bool

    @property
    def reach(self) -> int:
        """How far a window may start before its anchor."""
        return self.window - self.seed

    @property
    def step(self) -> int:
        """Bytes of a token in a context."""
        return 8 if self.words else 1


def tokens(chunk: Chunk, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    if not spec.words:
        return chunk.data, chunk.bounds
    hashes, bounds, _, _ = words(chunk)
    return hashes, bounds


def anchors(values: np.ndarray, bounds: np.ndarray, spec: Spec, slices: Slices) -> np.ndarray:
    """Positions of the anchors of all windows that lie within one text."""
    n, width = len(values), spec.reach + 1
    if n < spec.window:
        return np.zeros(0, np.int64)
    ranks = (mix(slices.grams(spec.seed)) >> np.uint64(32)) << np.uint64(32)
    ranks |= np.arange(len(ranks), dtype=np.uint64)
    least, have = ranks, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        gap = width - have
        least = np.minimum(least[: len(least) - gap], least[gap:])
    starts = np.arange(len(least))
    stops = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    found = (least[starts + spec.window <= stops] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return found[np.insert(found[1:] != found[:-1], 0, True)] if len(found) else found


def around(at: np.ndarray, begins: np.ndarray, stops: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """The context of anchors: all windows that contain them."""
    return np.maximum(begins, at - spec.reach), np.minimum(stops, at + spec.window)


def _later(doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, group: np.ndarray, spec: Spec) -> np.ndarray:
    """Which rows have an earlier row in their group."""
    order = np.lexsort((pos, copy, doc, group))
    g, d, c, p = group[order], doc[order], copy[order], pos[order]
    heads = np.flatnonzero(np.insert(g[1:] != g[:-1], 0, True))
    of = np.repeat(heads, np.diff(np.append(heads, len(g))))
    late = np.zeros(len(g), bool)
    late[order] = (d > d[of]) if spec.across else (d > d[of]) | (c > c[of]) | (p > p[of])
    return late


SEEDS = "anchor long, ctx long, doc long, copy long, pos int, cov boolean"


def seeds(keyed: DataFrame, spec: Spec) -> DataFrame:
    """Anchors of ``keyed`` (doc, copy, text).  ``cov`` marks a context that an earlier one in the
    same chunk equals; such rows get a key of their own."""

    def run(batches):
        for batch in batches:
            doc_ids, copies = ids(batch.column("doc")), np.asarray(batch.column("copy"))
            for chunk in chunks(batch.column("text")):
                values, bounds = tokens(chunk, spec)
                if len(values) < spec.window:
                    continue
                slices = Slices(values)
                at = anchors(values, bounds, spec, slices)
                if not len(at):
                    continue
                text = np.searchsorted(bounds, at, side="right") - 1
                lo, hi = around(at, bounds[text], bounds[text + 1], spec)
                with np.errstate(over="ignore"):
                    context = mix(slice_hash(slices, lo, hi) + (at - lo).astype(np.uint64))
                key = slice_hash(slices, at, at + spec.seed)
                doc, copy, pos = doc_ids[chunk.first : chunk.last][text], copies[chunk.first : chunk.last][text], at - bounds[text]
                late = _later(doc, copy, pos, context, spec)
                with np.errstate(over="ignore"):
                    own = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ pos.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.where(late, own, key))), pa.array(signed(context)), pa.array(doc), pa.array(copy), pa.array(pos.astype(np.int32)), pa.array(late)],
                    names=["anchor", "ctx", "doc", "copy", "pos", "cov"],
                )

    return keyed.select("doc", "copy", "text").mapInArrow(run, SEEDS)


def matched(found: DataFrame, spec: Spec) -> DataFrame:
    """Per document: positions whose context is a copy (``copies``), and those to compare."""
    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "ctx")
    grouped = found.select(
        "*",
        F.count(F.lit(1)).over(by_anchor).alias("n"),
        (F.min("ctx").over(by_anchor) != F.max("ctx").over(by_anchor)).alias("several"),
        (F.min("doc").over(by_anchor) != F.max("doc").over(by_anchor)).alias("docs"),
    ).where(F.col("cov") | (F.col("n") > 1))
    if spec.across:
        grouped = grouped.where(F.col("cov") | F.col("docs"))
        lowest = F.min("doc").over(by_context)
        late = F.col("cov") | (F.col("doc") > lowest)
    else:
        lowest = F.min(F.struct("doc", "copy", "pos")).over(by_context)
        late = F.col("cov") | (F.struct("doc", "copy", "pos") > lowest)
    kinds = grouped.select("anchor", "doc", "copy", "pos", late.alias("late"), "several").where(F.col("late") | F.col("several"))
    kinds = kinds.withColumn("n", F.count_if(~F.col("late")).over(by_anchor))  # contexts to compare
    return kinds.groupBy("doc", "copy").agg(
        F.collect_list(F.when(F.col("late"), F.col("pos"))).alias("copies"),
        F.collect_list(F.when(~F.col("late"), F.struct("pos", "anchor", (F.col("n") > SPLIT).alias("big")))).alias("compare"),
    )


CONTEXTS = "anchor long, doc long, copy long, pos int, big boolean, before binary, after binary"
_CONTEXT = ["anchor", "doc", "copy", "pos", "big", "before", "after"]


def contexts(joined: DataFrame, spec: Spec, columns: list[str]) -> DataFrame:
    """The tokens before (reversed) and from each anchor to compare."""

    def run(batches):
        for batch in batches:
            doc_ids, copies = ids(batch.column("doc")), np.asarray(batch.column("copy"))
            lists = batch.column("compare")
            bounds_of = np.asarray(lists.offsets)
            inner = lists.flatten()
            base = bounds_of[0]
            at_all, key_all, big_all = (np.asarray(inner.field(i)) for i in range(3))
            for chunk in chunks(batch.column("text")):
                values, bounds = tokens(chunk, spec)
                raw = values.tobytes()
                rows = []
                for i in range(chunk.first, chunk.last):
                    begin, stop = int(bounds[i - chunk.first]), int(bounds[i - chunk.first + 1])
                    for j in range(bounds_of[i] - base, bounds_of[i + 1] - base):
                        at = begin + int(at_all[j])
                        lo, hi = max(begin, at - spec.reach), min(stop, at + spec.window)
                        before = values[lo:at][::-1].tobytes() if spec.words else raw[lo:at][::-1]
                        rows.append((key_all[j], doc_ids[i], copies[i], at - begin, big_all[j], before, raw[at * spec.step : hi * spec.step]))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=_CONTEXT)

    return joined.select("doc", "copy", *columns, "compare").mapInArrow(run, CONTEXTS)


def halved(rows: DataFrame, spec: Spec) -> DataFrame:
    """Contexts dealt anew.  Those of a part (``least`` to ``most`` tokens before the anchor at
    which its windows start) go to both halves of that range, keyed by the tokens that all windows
    of the half share; a context too short for the half stays out."""
    step = spec.step

    def run(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                middle = (row["least"] + row["most"]) // 2
                for least, most in ((row["least"], middle), (middle + 1, row["most"])):
                    right = (spec.window - most) * step
                    if least <= most and len(row["before"]) >= least * step and len(row["after"]) >= right:
                        shared = row["before"][: least * step] + b"|" + row["after"][:right]
                        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=least.to_bytes(4, "little") + most.to_bytes(4, "little")).digest(), "little", signed=True)
                        found.append({**row, "anchor": key, "least": least, "most": most})
            yield pa.RecordBatch.from_pylist(found, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def parts_of(big: DataFrame, spec: Spec) -> DataFrame:
    """Contexts of big buckets as parts of at most ``SPLIT``."""
    rows = materialise(big.withColumn("least", F.lit(0)).withColumn("most", F.lit(spec.reach)))
    columns, done = ["anchor", "doc", "copy", "pos", "big", "before", "after"], None
    while not rows.isEmpty():
        counts = F.count(F.lit(1)).alias("n")
        dealt = materialise(halved(rows, spec))
        sizes = materialise(dealt.groupBy("anchor").agg(counts, F.min(F.struct("doc", "copy", "pos", "before", "after")).alias("earliest")).where("n > 1"))
        dealt = dealt.join(sizes, "anchor")
        whole = dealt.where(F.col("n") <= SPLIT).select(columns)
        # All of a part with one window left share it: pieces of it need no more than the earliest.
        single = dealt.where((F.col("n") > SPLIT) & (F.col("least") == F.col("most")))
        pieces = F.ceil(F.col("n") / SPLIT).cast("int")
        piece = F.xxhash64("anchor", F.pmod(F.xxhash64("doc", "copy", "pos"), pieces))
        cut = single.select(piece.alias("anchor"), *columns[1:])
        heads = sizes.where(F.col("n") > SPLIT).select(F.explode(F.sequence(F.lit(0), pieces - 1)).alias("i"), "anchor", "earliest")
        heads = heads.select(F.xxhash64("anchor", F.col("i").cast("long")).alias("anchor"), "earliest.doc", "earliest.copy", "earliest.pos", F.lit(True).alias("big"), "earliest.before", "earliest.after")
        cut = cut.union(heads.join(cut.select("anchor").distinct(), "anchor", "left_semi")).dropDuplicates(["anchor", "doc", "copy", "pos"])
        found = whole.union(cut)
        done = found if done is None else done.union(found)
        rows = materialise(dealt.where((F.col("n") > SPLIT) & (F.col("least") < F.col("most"))).select(rows.columns))
    return done if done is not None else big.select(columns)


def common(a: bytes, b: bytes, step: int) -> int:
    """Tokens that two contexts share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // step
    lo, hi = 0, n // step
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * step] == b[: mid * step]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: (doc, copy), position, tokens before (reversed), tokens from the anchor on.
Occurrence = tuple[tuple[int, int], int, bytes, bytes]
#: Occurrence (index), tokens removed before its anchor and from it on.
Span = tuple[int, int, int]


def furthest(members: list[int], group: list[Occurrence], spec: Spec) -> Iterator[tuple[int, int]]:
    """For each member of a set of occurrences, how many tokens before the anchor it shares with
    an earlier member.  Sorted by what precedes, the best partner of an occurrence is the nearest
    earlier one on either side: two scans with a stack of earlier occurrences."""
    order = sorted(members, key=lambda i: group[i][2])
    shared = [common(group[a][2], group[b][2], spec.step) for a, b in zip(order, order[1:])]
    best = [-1] * len(order)
    age = [group[i][0][0] if spec.across else (group[i][0], group[i][1]) for i in order]
    for turn in (range(len(order)), range(len(order) - 1, -1, -1)):
        stack: list[list] = []  # index, tokens shared by it and the scan's present end
        for x in turn:
            if stack:
                with_last = shared[x - 1] if turn.step > 0 else shared[x]
                stack[-1][1] = min(stack[-1][1], with_last)
            while stack and age[stack[-1][0]] >= age[x]:
                _, least = stack.pop()
                if stack:
                    stack[-1][1] = min(stack[-1][1], least)
            if stack:
                best[x] = max(best[x], stack[-1][1])
            stack.append([x, 1 << 30])
    return zip(order, best)


def buckets(rows: DataFrame, compare: Callable[[list[Occurrence]], Iterator[Span]]) -> DataFrame:
    """Spans to remove: contexts of an anchor are compared together.  All spans of an occurrence
    hold its anchor, so together they are one."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        key = np.asarray(table.column("anchor"))
        doc, copy, pos, before, after = (table.column(c).to_pylist() for c in ("doc", "copy", "pos", "before", "after"))
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        spans = []
        for a, b in zip(cut, cut[1:]):
            if b - a < 2:
                continue
            widest: dict[int, tuple[int, int]] = {}
            for i, left, right in compare(list(zip(zip(doc[a:b], copy[a:b]), pos[a:b], before[a:b], after[a:b]))):
                old = widest.get(i, (0, 0))
                widest[i] = (max(left, old[0]), max(right, old[1]))
            spans += [(doc[a + i], copy[a + i], pos[a + i] - left, pos[a + i] + right) for i, (left, right) in widest.items()]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in spans], t) for k, t in enumerate(types)], names=["doc", "copy", "begin", "stop"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.asarray(batch.column("anchor"))
            if not len(key):
                continue
            # Only the last bucket of a batch can go on in the next one.
            last = int(np.searchsorted(key == key[-1], True))
            if last or waiting and waiting[-1].column("anchor")[0].as_py() != key[0]:
                yield solve(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    ready = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "copy", "pos")
    return ready.mapInArrow(run, "doc long, copy long, begin int, stop int")


def mask_of(n: int, copies, spans, spec: Spec) -> np.ndarray | None:
    """Which of a document's ``n`` tokens are covered; None if none is."""
    parts = []
    if copies is not None and len(copies):
        at = np.asarray(copies, np.int64)
        parts.append(around(at, np.int64(0), np.int64(n), spec))
    if spans is not None and len(spans):
        parts.append((np.asarray([s["begin"] for s in spans], np.int64), np.asarray([s["stop"] for s in spans], np.int64)))
    if not parts:
        return None
    change = np.zeros(n + 1, np.int64)
    for lo, hi in parts:
        np.add.at(change, np.minimum(lo, n), 1)
        np.add.at(change, np.minimum(hi, n), -1)
    return np.cumsum(change[:-1]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc (a null id is the smallest), copy, text, and the other columns as one, so that no name
    of theirs can clash with one used inside."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    named = told_apart(docs.select("doc_id", "text", rest.alias("rest")))
    return named.select("doc", "copy", "text", "rest")


def with_text(batch: pa.RecordBatch, texts: list, columns: list[str]) -> pa.RecordBatch:
    """The documents' own columns again, with new texts."""
    rest = dict(zip((c for c in columns if c != "text"), batch.column("rest").flatten()))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else rest[c] for c in columns], names=columns)


def apply(
    docs: DataFrame,
    spec: Spec,
    compare: Callable[[list[Occurrence]], Iterator[Span]],
    finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema,
) -> DataFrame:
    """Runs the steps; ``finish`` gets doc, text, rest, ``copies`` and ``spans``."""
    ship(docs.sparkSession)
    columns, key = ["text", "rest"], ["doc", "copy"]
    source = keyed(docs)
    lists = materialise(matched(seeds(source, spec), spec))
    to_compare = source.join(lists.where(F.size("compare") > 0).select(*key, "compare").hint("shuffle_hash"), key)
    found = contexts(to_compare, spec, columns)
    if not lists.where(F.exists("compare", lambda x: x["big"])).isEmpty():
        found = materialise(found)
        found = found.where("NOT big").union(parts_of(found.where("big"), spec))
    per_doc = buckets(found, compare).groupBy(*key).agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    marks = lists.select(*key, "copies").join(per_doc, key, "full").select(*key, "copies", "spans")
    joined = source.join(marks.hint("shuffle_hash"), key, "left")
    return joined.select(*key, *columns, "copies", "spans").mapInArrow(finish, schema)
