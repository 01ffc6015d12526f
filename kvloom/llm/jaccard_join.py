"""N-gram Jaccard join and the classes of near copies that its links make.

A document's set holds its distinct ``N``-word shingles, lower-cased; two documents link when
``100 * intersection >= PERCENT * union``.  Equal sets are one node from the start (found by a hash
of the whole set), so copies cost a row each and never meet each other.

1. ``members``: size and node of every document, and the shingles that are frequent within a group
   of texts.  Their sums name the *hot* shingles, at most ``HOT_LIMIT`` of them.
2. ``dealt`` and ``counted``: exact frequencies.  Shingles travel in blobs, dealt by hash range, to
   parts of about ``PART`` shingles, where the sets that hold each are counted.  A shingle of one
   set only can match nothing and ends there.  Hot shingles are not gathered: they keep their sums
   as frequency.
3. ``nodes``: each set's shared shingles, rarest first; those of one set only come before all
   others.  Two sets that link share a shingle among the first ``n - ceil(t n) + 1`` of each.
4. Pairs that meet at such a shingle pass the length filter and the positional filter, are made
   distinct and verified once, after a suffix filter (both sets split at fixed hashes; the parts
   bound the overlap).  All that two sets share is in ``nodes``: texts are not read again.

Where a shingle's list is longer than ``SHORT_LIST``, its members are first paired with one leader;
then those outside the list's largest component with ``LEADERS`` members of it; at last, by size
band, the pairs between different components that are left.  Members of one component need no pair
between them, so no link that joins two components is lost.  Lists are joined, never gathered.

Edge cases: null and empty texts, and texts without words, have an empty set and stand alone; a
null doc_id is the smallest, and comes back as null; rows that repeat an id are judged each by its
own text, and equal ones are one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.shipping import materialise, release, ship
from kvloom.llm.textops import NULL_ID, Chunk, Slices, chunks, ids, mix, signed, slice_hash, words

N = 5
PERCENT = 80
SHORT_LIST = 8
LEADERS = 32
PART = 1 << 20  # shingles that one part should hold
GROUP = 1 << 20  # shingles of the texts that are dealt together
FAN_BITS = 12  # parts are dealt in steps of at most 2**FAN_BITS
HOT_LIMIT = 1 << 20  # hot shingles, at most
HOT_LEAST = 1 << 12  # and the least frequency of one


def shingles(chunk: Chunk, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, joined end to end; and their bounds."""
    hashes, bounds, _, _ = words(chunk, lower=True)
    texts = len(bounds) - 1
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    slices = Slices(hashes)
    counts = np.diff(bounds)
    long = np.maximum(counts - n + 1, np.minimum(counts, 1))  # a short text is one shingle
    text = np.repeat(np.arange(texts), long)
    start = np.arange(len(text)) - np.repeat(np.cumsum(long) - long, long) + bounds[text]
    found = slice_hash(slices, start, np.minimum(start + n, bounds[text + 1]))
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.insert((found[1:] != found[:-1]) | (text[1:] != text[:-1]), 0, True)
    return found[new], np.searchsorted(text[new], np.arange(texts + 1))


def set_hash(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones only."""
    slices = Slices(found)
    return np.where(np.diff(bounds) > 0, slice_hash(slices, bounds[:-1], bounds[1:]) | np.uint64(1), np.uint64(0))


def need(a, b, percent: int = PERCENT):
    """Least intersection of sets of sizes ``a`` and ``b`` that makes a link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - (-((-percent * n) // 100)) + 1


def heads_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted values begin."""
    return np.flatnonzero(np.insert(values[1:] != values[:-1], 0, True)) if len(values) else np.zeros(0, np.int64)


def groups(column):
    """The distinct sets of a column of texts, in groups of about ``GROUP`` shingles: first row,
    last row, and of the sets found here first: hashes, set of each, nodes, sizes."""
    first = last = 0
    seen: set[int] = set()
    parts: list[tuple[np.ndarray, ...]] = []
    for chunk in chunks(column):
        found, bounds = shingles(chunk)
        nodes, sizes = signed(set_hash(found, bounds)), np.diff(bounds)
        once = np.array([x != 0 and x not in seen and not seen.add(x) for x in nodes.tolist()], bool)
        parts.append((found[np.repeat(once, sizes)], nodes[once], sizes[once], nodes, sizes))
        last = chunk.last
        if sum(len(x[0]) for x in parts) >= GROUP:
            yield first, last, *(np.concatenate(x) for x in zip(*parts))
            first, parts, seen = last, [], set()
    if parts:
        yield first, last, *(np.concatenate(x) for x in zip(*parts))


def members(keyed: DataFrame) -> DataFrame:
    """doc, text_hash, n (set size) and node (hash of the set) of every document.  The first of a
    group also carries the shingles that several sets of the group hold (``many``) and in how many
    (``often``)."""

    def run(batches):
        for batch in batches:
            for first, last, found, _, _, nodes, sizes in groups(batch.column("text")):
                found = np.sort(found)
                heads = heads_of(found)
                counts = np.diff(np.append(heads, len(found)))
                many, often = found[heads[counts > 1]], counts[counts > 1]
                offsets = pa.array([0] + [len(many)] * (last - first), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids(batch.column("doc"))[first:last]),
                        batch.column("text_hash").slice(first, last - first),
                        pa.array(sizes),
                        pa.array(nodes),
                        pa.ListArray.from_arrays(offsets, pa.array(signed(many))),
                        pa.ListArray.from_arrays(offsets, pa.array(often)),
                    ],
                    names=["doc", "text_hash", "n", "node", "many", "often"],
                )

    return keyed.mapInArrow(run, "doc long, text_hash long, n long, node long, many array<long>, often array<long>")


def hot_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hot shingles, sorted, and their sums over groups.  A sum is at least ``2 * total /
    HOT_LIMIT``, so there are fewer than ``HOT_LIMIT``.  One that is missed is found once in most
    groups, or in no more than that many sets."""
    least = max(HOT_LEAST, 2 * total // HOT_LIMIT)
    pairs = rows.select(F.explode(F.arrays_zip("many", "often")).alias("x"))
    table = pairs.groupBy(F.col("x.many").alias("token")).agg(F.sum("x.often").alias("n")).where(F.col("n") >= least).toArrow()
    tokens, counts = np.asarray(table.column("token"), np.int64).astype(np.uint64), np.asarray(table.column("n"), np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


BLOBS = "part long, nodes binary, sizes binary, steps binary, owners binary"


def _blob(found: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, ...]:
    """Sorted shingles as differences, byte plane by byte plane (their zero bytes then compress),
    and which of ``nodes`` owns each."""
    used, owner = np.unique(owner, return_inverse=True)
    steps = np.diff(found, prepend=np.uint64(0))
    small = np.uint16 if len(used) <= 1 << 16 else np.uint32
    return nodes[used].astype(np.int64).tobytes(), sizes[used].astype(np.int32).tobytes(), steps.view(np.uint8).reshape(-1, 8).T.tobytes(), owner.astype(small).tobytes()


def _open(row) -> tuple[np.ndarray, ...]:
    """Shingles, and node and set size of each."""
    nodes, sizes = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sizes"], np.int32)
    steps = np.ascontiguousarray(np.frombuffer(row["steps"], np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]
    owner = np.frombuffer(row["owners"], np.uint16 if len(nodes) <= 1 << 16 else np.uint32)
    return np.cumsum(steps, dtype=np.uint64), nodes[owner], sizes[owner]


def _blobs(part: np.ndarray, found: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray):
    """A row for each part of shingles sorted by part, then hash."""
    heads = heads_of(part)
    cuts = np.append(heads, len(part))
    rows = [(int(part[a]), *_blob(found[a:b], owner[a:b], nodes, sizes)) for a, b in zip(cuts, cuts[1:])]
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[i : i + 256]), [pa.int64(), *[pa.binary()] * 4])], names=["part", "nodes", "sizes", "steps", "owners"])


def dealt(keyed: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """Shingles of all sets by the first ``bits`` of their hash; hot ones in parts below zero."""

    def run(batches):
        for batch in batches:
            for first, _, found, nodes, sizes, *_ in groups(batch.column("text")):
                if not len(found):
                    continue
                owner = np.repeat(np.arange(len(nodes)), sizes)
                order = np.argsort(found, kind="stable")
                found, owner = found[order], owner[order]
                is_hot = np.zeros(len(found), bool)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found
                cold = found[~is_hot]
                yield from _blobs((cold >> np.uint64(64 - bits)).astype(np.int64), cold, owner[~is_hot], nodes, sizes)
                where = np.full(int(is_hot.sum()), -1 - int(mix(nodes[:1].astype(np.uint64))[0] % np.uint64(4096)))
                yield from _blobs(where, found[is_hot], owner[is_hot], nodes, sizes)

    return keyed.select("text").mapInArrow(run, BLOBS)


def by_part(batches):
    """Rows of a sorted stream, part after part; those of hot shingles one by one."""
    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["part"] != part or part < 0):
                yield part, rows
                rows = []
            part = row["part"]
            rows.append(row)
    if rows:
        yield part, rows


def gathered(blobs: DataFrame) -> DataFrame:
    return blobs.repartition(int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")


def dealt_on(blobs: DataFrame, done: int, bits: int) -> DataFrame:
    """Parts of ``done`` bits dealt on to parts of ``bits``, in pieces of about ``GROUP``."""

    def run(batches):
        for part, rows in by_part(batches):
            waiting, n = [], 0
            for i, row in enumerate(rows):
                waiting.append(_open(row))
                n += len(waiting[-1][0])
                if n < GROUP and i + 1 < len(rows):
                    continue
                found, node, size = (np.concatenate(x) for x in zip(*waiting))
                waiting, n = [], 0
                order = np.argsort(found, kind="stable")
                found = found[order]
                nodes, at, owner = np.unique(node[order], return_index=True, return_inverse=True)
                parts = (found >> np.uint64(64 - bits)).astype(np.int64) if part >= 0 else np.full(len(found), part)
                yield from _blobs(parts, found, owner, nodes, size[order][at])

    return gathered(blobs).mapInArrow(run, BLOBS)


def counted(blobs: DataFrame, hot: np.ndarray, sums: np.ndarray) -> DataFrame:
    """node, n, token and freq of every shingle that more than one set holds."""

    def run(batches):
        for part, rows in by_part(batches):
            found, node, size = (np.concatenate(x) for x in zip(*(_open(row) for row in rows)))
            if part < 0:
                freq = sums[np.searchsorted(hot, found)]
            else:
                order = np.lexsort((node, found))
                found, node, size = found[order], node[order], size[order]
                new = np.insert((found[1:] != found[:-1]) | (node[1:] != node[:-1]), 0, True)  # copies from other groups
                found, node, size = found[new], node[new], size[new]
                heads = heads_of(found)
                counts = np.diff(np.append(heads, len(found)))
                freq = np.repeat(counts, counts)
                found, node, size, freq = (x[freq > 1] for x in (found, node, size, freq))
            for i in range(0, len(found), 1 << 17):
                part_of = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(node[part_of]), pa.array(size[part_of]), pa.array(signed(found[part_of])), pa.array(freq[part_of])], names=["node", "n", "token", "freq"])

    return gathered(blobs).mapInArrow(run, "node long, n int, token long, freq long")


def nodes(shared: DataFrame) -> DataFrame:
    """node, n, items (shared shingles, sorted), heads (those in the prefix, rarest first) and
    skip (shingles of this set only, which come first), of sets that can match another."""
    found = shared.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_set(F.struct("freq", "token"))).alias("found"))
    found = found.withColumn("skip", F.col("n") - F.size("found"))
    take = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1 - skip").cast("int")
    return found.withColumn("take", take).where("take > 0").select("node", "n", F.array_sort(F.col("found.token")).alias("items"), F.slice(F.col("found.token"), F.lit(1), F.col("take")).alias("heads"), "skip")


def _close(x: str, y: str) -> Column:
    """Length and positional filter of two postings that share a shingle."""
    n1, n2, p1, p2 = (f"{s}.{c}" for c in "np" for s in (x, y))
    return F.expr(
        f"100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2})"
        f" AND least({n1} - {p1}, {n2} - {p2}) >= ({PERCENT} * ({n1} + {n2}) + {100 + PERCENT - 1}) div {100 + PERCENT}"
    )


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def all_pairs(rows: DataFrame, classed: bool) -> DataFrame:
    """a, b of the pairs that lists hold, of different classes where those are known.  Lists are
    split into size bands; the larger set of a pair stands in the same band or the next."""
    banded = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.3))).cast("int"))
    x, y = banded.alias("x"), banded.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).alias("y")
    differ = F.expr("(x.n, x.node) < (y.n, y.node)")
    if classed:
        differ &= F.expr("x.class <> y.class")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & differ & _close("x", "y")).select(*_pair("x", "y")).distinct()


def led_pairs(rows: DataFrame) -> DataFrame:
    """Every member of a list with the list's leader."""
    return rows.alias("x").where("node <> lead.node").where(_close("x", "lead")).select(*_pair("x", "lead")).distinct()


def main_pairs(rows: DataFrame) -> DataFrame:
    """Members outside a list's largest class with ``LEADERS`` of that class."""
    counts = rows.groupBy("token", "class").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("token").agg(F.max_by("class", F.struct("c", "class")).alias("main"))
    marked = rows.join(main, "token")
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS))
    leaders = marked.where("class = main").groupBy("token", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node"), "node", "n", "p")).alias("lead")).select("token", "lead")
    others = marked.where("class <> main").alias("x").join(leaders, "token")
    return others.where(_close("x", "lead")).select(*_pair("x", "lead")).distinct()


_SPLITS = np.arange(-7, 8, dtype=np.int64) << 60


def linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Suffix filter, then the exact test, of sorted shingles."""
    cx, cy = (np.diff(np.concatenate([[0], np.searchsorted(s, _SPLITS), [len(s)]])) for s in (x, y))
    if np.minimum(cx, cy).sum() < least:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) >= least


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link.  The second set travels to the first, so a leader with many partners is
    not gathered."""
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("items").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("items").alias("left"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", (F.col("n1") + F.col("n2")).alias("both"), "left", "right")

    def run(batches):
        for batch in batches:
            a, b, both = (np.asarray(batch.column(c)) for c in ("a", "b", "both"))
            left, right = batch.column("left"), batch.column("right")
            (i1, x), (i2, y) = ((np.asarray(s.offsets) - s.offsets[0].as_py(), np.asarray(s.flatten())) for s in (left, right))
            good = np.array([linked(x[i1[k] : i1[k + 1]], y[i2[k] : i2[k + 1]], need(int(both[k]), 0)) for k in range(len(a))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and class (its least node) of every node with a link: alternating large-star and
    small-star steps, as tables in the shared folder, until every node points at a root alone."""
    edges = links.select("a", "b").where("a <> b")
    made: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Each edge now goes from the greater node to a lesser one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(down.union(least.select("a", F.col("m").alias("b"))).distinct())
        release(*made)
        made = [edges]
        ends = edges.select("a", F.lit(1).alias("out")).union(edges.select(F.col("b").alias("a"), F.lit(1 << 32)).distinct())
        if ends.groupBy("a").agg(F.sum("out").alias("out")).where("out > 1 AND out <> 4294967296").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class"))


def labels_of(sets: DataFrame) -> DataFrame:
    """node and class of the sets that link with another."""
    postings = sets.select("node", "n", F.posexplode("heads").alias("at", "token"), "skip").withColumn("p", F.col("at") + F.col("skip"))
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node"), "node", "n", "p")).alias("lead")).where("c > 1")
    rows = materialise(postings.join(lists, "token").select("token", "node", "n", "p", "c", "lead"))
    short, long = rows.where(F.col("c") <= SHORT_LIST).drop("lead"), rows.where(F.col("c") > SHORT_LIST)
    tried = materialise(all_pairs(short, False).union(led_pairs(long)).distinct())
    links = materialise(verify(tried, sets))
    labels = components(links)
    for pairs_of in (main_pairs, lambda mixed: all_pairs(mixed, True)):
        classed = long.drop("lead", "c").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
        several = classed.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("token")
        mixed = materialise(classed.join(several, "token", "left_semi"))
        pairs = materialise(pairs_of(mixed).join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tried = tried.union(pairs)
            links = links.union(materialise(verify(pairs, sets)))
            labels = components(links)
        release(mixed)
    return labels


def classes_of(docs: DataFrame) -> DataFrame:
    """doc (null id: the least long), text_hash, n_shingles and component (least doc reachable)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text", F.xxhash64("text").alias("text_hash"))
    rows = materialise(members(keyed))
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot, sums = hot_shingles(rows, total)
    bits = max(6, (total // PART).bit_length())
    done = min(bits, FAN_BITS)
    blobs = dealt(keyed, done, hot)
    while done < bits:
        blobs, done = dealt_on(blobs, done, min(bits, done + FAN_BITS)), min(bits, done + FAN_BITS)
    sets = materialise(nodes(counted(blobs, hot, sums)))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("first"))
    named = materialise(classes.join(labels_of(sets), "node", "left").select("node", "first", F.coalesce("class", "node").alias("class")))
    least = named.groupBy("class").agg(F.min("first").alias("component"))
    by_node = named.join(least, "class").select("node", "component")
    return rows.select("doc", "text_hash", "n", "node").join(by_node, "node", "left").select("doc", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return classes_of(docs.select("doc_id", "text")).select(back("doc").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is the first of its class (rows that repeat id and text all
    stay)."""
    firsts = classes_of(docs.select("doc_id", "text")).where("doc = component").select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text")).distinct()
    keyed = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__text", F.xxhash64("text"))
    return keyed.join(firsts.hint("shuffle_hash"), ["__doc", "__text"], "left_semi").select(*docs.columns)
