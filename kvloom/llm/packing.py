"""Best-fit packing: tokenised documents into sequences of a fixed number of tokens.

``tokenise`` turns each text into ids and cuts the long ones; ``plan`` works on the histogram of
piece lengths alone (one count for each length, however many documents there are), and ``assign``
finds each piece's place from its rank among the pieces of its length.

The plan is the linear grouping scheme: large lengths, sorted, are dealt into groups of equal
cardinality and rounded up to the largest of their group; configurations of these few sizes are
optimised by column generation (a small simplex, priced by an unbounded knapsack); actual lengths
are then substituted into the rounded slots; what is left over and all small pieces go, longest
first, wherever they fit best.

Edge cases: a null or empty text is one piece holding only the end id; repeated rows are packed as
often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.shipping import materialise, ship
from kvloom.llm.textops import binary

CAPACITY = 1024
END_ID = 2
GROUPS = 80
SMALL = 450
CACHE_ENTRIES = 1_000_000
#: Texts that hold a special token's string are encoded by the tokenizer itself.
SPECIAL = b"<|endoftext|>"
#: A blank between white spaces, or at the end after one: there a cut before the blank may be wrong.
_RISKY = re.compile(rb"[\x09-\x0d\x1c-\x20\x80-\xaf] (?=[\x09-\x0d\x1c-\x20\xc2\xe1-\xe3]|\Z)").search
#: The split of byte-level BPE vocabularies of this kind (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_STOPS = (b".", b",")


def _words32(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder(dict):
    """Little-endian ids of words that follow a blank, kept for words seen before."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letter = _byte_of_char()
        ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if all(c in letter for c in token) and token.encode() != SPECIAL}
        self._fast = tiktoken.Encoding("kvloom", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = Tokenizer.from_file(path)
        self._stops = {x: self._ids(x) for x in _STOPS if x}

    def _ids(self, text: bytes) -> bytes:
        return _words32(self._fast(text.decode("utf-8", "replace")))

    def __missing__(self, word: bytes) -> bytes:
        # A stop or comma after letters is a token of its own, so the bare word serves both.
        if word[-1:] in _STOPS and word[:-1].decode("utf-8", "replace").isalpha():
            found = self[word[:-1]] + self._stops[word[-1:]]
        else:
            found = self._ids(b" " + word)
        self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers, equal to the tokenizer's own."""
        if SPECIAL in text:
            return np.asarray(self._whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if _RISKY(text):
            return self._ids(text)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        first, *rest = text.split(b" ")
        return self._ids(first) + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids; only the first may be short."""
    head = n if n <= capacity else n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        from kvloom.llm import packing

        encode, end = packing.encoder(path).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            bounds, data = binary(batch.column("text"))
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for i in range(len(bounds) - 1):
                ids = encode(data[bounds[i] : bounds[i + 1]].tobytes()) + end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append(i)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(n)
                    crcs.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# --- configurations of a few sizes -------------------------------------------------------------


def _dearest(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the most valuable configuration and how often it has each size."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    sizes_array = np.array(sizes)
    for w in range(1, capacity + 1):
        fits = np.flatnonzero(sizes_array <= w)
        best[w] = best[w - 1]
        if len(fits):
            values = best[w - sizes_array[fits]] + worth[fits]
            k = int(values.argmax())
            if values[k] > best[w] + 1e-12:
                best[w], pick[w] = values[k], fits[k]
    counts, w = [0] * len(sizes), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], need: list[int], capacity: int = CAPACITY, rounds: int = 2000) -> list[tuple[list[int], float]]:
    """Configurations and how many sequences of each: an optimum of the relaxed cutting-stock
    problem by column generation."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(need, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        value, counts = _dearest(sizes, np.ones(m) @ inverse, capacity)
        if value <= 1 + 1e-9:
            break
        step, levels = inverse @ np.array(counts, float), inverse @ demand
        limits = np.where(step > 1e-9, levels / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(limits.argmin())] = counts
    levels = np.maximum(np.linalg.inv(columns) @ demand, 0)
    return [([int(x) for x in columns[:, j]], float(levels[j])) for j in range(m) if levels[j] > 1e-9]


# --- the plan ----------------------------------------------------------------------------------


@dataclass
class Block:
    """``n`` sequences from number ``first`` on that hold pieces of the same lengths."""

    first: int
    n: int
    used: int


class Planner:
    """Places counts of lengths into blocks; ``segments`` has a row for each placement:
    length, first rank, number, first sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {n: c for n, c in counts.items() if c}
        self.ranks: dict[int, int] = defaultdict(int)
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[Block]] = defaultdict(list)

    def open(self, n: int) -> Block:
        block = Block(self.sequences, n, 0)
        self.sequences += n
        return block

    def put(self, block: Block, length: int) -> tuple[Block, Block | None]:
        """As many pieces of ``length`` as there are, one into each sequence; the block that got
        them and the rest of it."""
        k = min(block.n, self.left[length])
        self.segments.append((length, self.ranks[length], k, block.first, block.used))
        self.ranks[length] += k
        self.left[length] -= k
        if not self.left[length]:
            del self.left[length]
        rest = Block(block.first + k, block.n - k, block.used) if k < block.n else None
        return Block(block.first, k, block.used + length), rest

    def keep(self, block: Block) -> None:
        self.room[self.capacity - block.used].append(block)

    def best_fit(self) -> None:
        """All that is left, longest first, each where the least room remains."""
        for length in sorted(self.left, reverse=True):
            for room in range(length, self.capacity + 1):
                while length in self.left and self.room.get(room):
                    got, rest = self.put(self.room[room].pop(), length)
                    if rest:
                        self.room[room].append(rest)
                    while got.used + length <= self.capacity and length in self.left:
                        full, rest = self.put(got, length)
                        if rest:
                            self.keep(rest)
                        got = full
                    self.keep(got)
            while length in self.left:
                each = self.capacity // length
                blocks = [self.open(max(1, self.left[length] // each))]
                for _ in range(each):
                    done = []
                    for block in blocks:
                        if length in self.left:
                            got, rest = self.put(block, length)
                            done += [got, *([rest] if rest else [])]
                        else:
                            done.append(block)
                    blocks = done
                for block in blocks:
                    self.keep(block)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments and the number of sequences for ``counts`` pieces of each length."""
    work = Planner(counts, capacity)
    if capacity in work.left:
        work.put(work.open(work.left[capacity]), capacity)
    large = [(n, work.left[n]) for n in sorted(work.left, reverse=True) if n > small]
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    members: list[dict[int, int]] = []  # equal-cardinality groups, longest first: length -> count
    have = each
    for length, count in large:
        while count:
            if have == each:
                members.append({})
                have = 0
            k = min(count, each - have)
            members[-1][length] = k
            have += k
            count -= k
    sizes = [max(g) for g in members]
    for pattern, level in configurations(sizes, [sum(g.values()) for g in members], capacity):
        if not int(level):
            continue
        blocks = [work.open(int(level))]
        for group, slots in enumerate(pattern):
            for _ in range(slots):
                todo, done = blocks, []
                while todo:
                    block = todo.pop()
                    length = next((n for n in members[group] if members[group][n] and n in work.left), None)
                    if length is None:
                        done.append(block)
                        continue
                    k = min(block.n, members[group][length])
                    if k < block.n:
                        todo.append(Block(block.first + k, block.n - k, block.used))
                    got, _ = work.put(Block(block.first, k, block.used), length)
                    members[group][length] -= k
                    done.append(got)
                blocks = done
        for block in blocks:
            work.keep(block)
    work.best_fit()
    return work.segments, work.sequences


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Ranks are counted in buckets of each length, so no
    length, common as it may be, is ranked in one task."""
    spark = pieces.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialise(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counted = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in counts:
        mine = sorted(s[1:] for s in segments if s[0] == length)
        by_length[length] = tuple(np.array([s[i] for s in mine], np.int64) for i in (0, 2, 3))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            found, begins = np.unique(length[order], return_index=True)
            for n, mine in zip(found, np.split(order, begins[1:])):
                starts, first, at = by_length[int(n)]
                k = np.searchsorted(starts, rank[mine], side="right") - 1
                sequence[mine] = first[k] + rank[mine] - starts[k]
                offset[mine] = at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document, with its sequence and its place there."""
    return assign(tokenise(docs, path, capacity, end_id), capacity)
