"""Line dedup with DataFrame operations only: a suffix array over sequences of line ids.

Lines that hold more than blanks are numbered in each document.  Lines found once cannot be in a
repeated run, so only repeated lines keep their place, in *segments* without gaps; their ids are
start ranks of the sorted line hashes.  Prefix doubling then ranks the suffixes: in each round a
suffix in a group of equals takes the pair (its rank, the rank ``h`` lines on), groups split by it,
and ``h`` doubles, until no group can split.  Segments of at most ``h`` lines have their final ranks
and leave the rounds, so a round costs what is left.

A group is an interval of the suffix array whose members share ``h`` lines.  A suffix that is not
the earliest of its group starts a later copy of a run.  ``common`` is the length of the longest
prefix that an earlier suffix shares: exact below ``STRONG`` (lengths between two rounds are told by
two overlapping ranks), and from there on a power of two, since the next start of the same run
covers what follows.  A run is deleted if its lines together have at least ``STRONG`` characters; as
no line is empty, ``STRONG`` lines do, so what is deleted is exact: every line of every later copy
of a maximal repeated run that is not very short as a whole.

Ranks come from sums over ranges of the sorted keys and group sizes from partial aggregation, both
joined back, so a line that a third of all documents hold is never in one task.

Edge cases: a null text stays null and has no lines; an empty text has none either; a null doc_id
sorts first; rows that repeat id and text count as one document (all keep the same lines); rows of
one id (or of none) with different texts are documents of their own, ordered by a hash of their
texts; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kvloom.llm.identity import told_apart
from kvloom.llm.shipping import materialise

STRONG = 8  # the least number of characters of all lines of a run


def _by_doc() -> WindowSpec:
    return Window.partitionBy("doc", "copy").orderBy("pos")


def _place() -> Column:
    return F.struct("doc", "copy", "pos")


def _later(least: str = "least") -> Column:
    return F.coalesce(F.col(least) < _place(), F.lit(False))


def lines(docs: DataFrame) -> DataFrame:
    """doc, copy, pos (among lines that are not blank), line_no, two hashes and chars (``STRONG`` at
    most) of ``docs`` (doc, copy, text)."""
    numbered = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.trim(F.translate(x["line"], "\t\r\x0b\x0c", "    ")) != "")
    rows = docs.select("doc", "copy", F.posexplode(numbered).alias("pos", "x"))
    line = F.col("x.line")
    return rows.select("doc", "copy", "pos", F.col("x.line_no").alias("line_no"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), F.least(F.length(line), F.lit(STRONG)).alias("chars"))


def ranged(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` dealt by ranges of their keys, as a table with the number of the range (``part``)."""
    return materialise(groups.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))


def ordered(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """``ranged`` groups with ``start``: how many members (``size``) groups with smaller keys have."""
    sums = dealt.groupBy("part").agg(F.sum("size").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sum"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "part").withColumn("start", F.col("sum") + F.col("inside")).drop("part", "inside", "sum")


def suffixes(docs: DataFrame) -> DataFrame:
    """doc, copy, pos, line_no, chars, rank (1 + lines that sort before), size (of its group),
    ``least`` (the group's first place), ``left`` (repeated lines from here to a gap) and ``seg``
    (lines of the segment)."""
    rows = materialise(lines(docs))
    found = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    ids = ordered(ranged(found, ["h1", "h2"]), ["h1", "h2"]).select("h1", "h2", (F.col("start") + 1).alias("rank"), "size")
    named = rows.join(ids, ["h1", "h2"]).drop("h1", "h2").repartition("doc", "copy").dropDuplicates(["doc", "copy", "pos"])
    segment = Window.partitionBy("doc", "copy", "gap")
    named = named.withColumn("gap", F.col("pos") - F.row_number().over(_by_doc()))
    named = named.withColumn("left", F.max("pos").over(segment) - F.col("pos") + 1).withColumn("seg", F.count(F.lit(1)).over(segment))
    named = materialise(named.drop("gap"))
    return named.join(named.groupBy("rank").agg(F.min(_place()).alias("least")), "rank")


def _ahead(h: int) -> Column:
    """The rank ``h`` lines on in the same segment, else 0."""
    return F.when(F.col("left") > h, F.max("rank").over(_by_doc().rangeBetween(h, h))).otherwise(F.lit(0))


def _grown(rows: DataFrame, h: int) -> DataFrame:
    """Between two rounds: suffixes that share ``h`` lines with an earlier one, and more of the next
    ``h - 1``.  A prefix of ``h + k`` lines is told by the ranks here and ``k`` lines on."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _ahead(k).alias("ahead")) for k in range(1, h)])
    tried = rows.where(F.col("seg") > h).withColumn("key", keys).withColumn("key", F.explode("key")).where(F.col("left") >= F.col("key.k") + h)
    least = tried.groupBy("rank", "key").agg(F.min(_place()).alias("best"))
    later = tried.join(least, ["rank", "key"]).where(_later("best"))
    return later.groupBy("doc", "copy", "pos").agg((F.max("key.k") + h).alias("more"))


def doubled(start: DataFrame) -> DataFrame:
    """Prefix doubling of suffixes of segments of several lines: doc, copy, pos, line_no, chars,
    rank, ``common`` (lines shared with an earlier suffix; 0 if none) and ``first``, the earliest
    suffix that shares them."""
    now = start.withColumn("common", F.when(_later(), F.lit(1)).otherwise(F.lit(0))).withColumn("first", F.when(_later(), F.col("least"))).drop("least")
    h, done, grown = 1, [], []
    while True:
        done.append(now.where(F.col("seg") <= h))
        now = now.where(F.col("seg") > h)
        if 1 < h < STRONG:
            grown.append(_grown(now, h))
        paired = now.withColumn("ahead", _ahead(h))
        split = paired.where("size > 1").groupBy("rank", "ahead").agg(F.count(F.lit(1)).alias("size"), F.min(_place()).alias("least"))
        split = ranged(split, ["rank", "ahead"])
        if split.where("ahead > 0").isEmpty():
            break
        split = ordered(split, ["rank", "ahead"])
        # Members of a rank before this part of it.
        begins = split.groupBy("rank").agg(F.min("start").alias("begin"))
        split = split.join(begins, "rank").select("rank", "ahead", (F.col("start") - F.col("begin")).alias("before"), F.col("size").alias("n"), "least")
        h *= 2
        shared = F.least(F.lit(h), F.col("left"))
        now = materialise(
            paired.join(split, ["rank", "ahead"], "left")
            .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
            .withColumn("size", F.coalesce("n", F.lit(1)))
            .withColumn("common", F.when(_later(), shared).otherwise(F.col("common")))
            .withColumn("first", F.when(_later(), F.col("least")).otherwise(F.col("first")))
            .drop("ahead", "before", "n", "least")
        )
    columns = ["doc", "copy", "pos", "line_no", "chars", "rank", "common", "first"]
    found = now.select(columns)
    for rows in done[1:]:  # segments of one line are not among them
        found = found.union(rows.select(columns))
    for more in grown:
        found = found.join(more, ["doc", "copy", "pos"], "left").withColumn("common", F.greatest("common", F.coalesce("more", F.lit(0)))).drop("more")
    return found


def runs(docs: DataFrame) -> DataFrame:
    """doc, copy, start and stop (positions) of later copies of repeated runs, of ``docs`` (doc,
    copy, text): from each start, as far as an earlier copy goes (see ``common``)."""
    start = materialise(suffixes(docs))
    single = start.where((F.col("seg") == 1) & (F.col("chars") >= STRONG) & _later()).select("doc", "copy", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    found = doubled(start.where("seg > 1"))
    # Characters of the first lines, as far as they count; a line is never empty.
    ahead = F.collect_list("chars").over(_by_doc().rowsBetween(Window.currentRow, STRONG - 1))
    length = F.aggregate(F.slice(ahead, F.lit(1), F.greatest("common", F.lit(1)).cast("int")), F.lit(0), lambda n, c: n + c)
    strong = found.withColumn("length", length).where((F.col("common") > 0) & (F.col("length") >= STRONG))
    return single.union(strong.select("doc", "copy", F.col("pos").alias("start"), (F.col("pos") + F.col("common")).alias("stop")))


def spans(docs: DataFrame) -> DataFrame:
    """doc, copy and its runs, merged where they overlap, as sorted positions [start, stop)."""
    by_doc = Window.partitionBy("doc", "copy").orderBy("start", "stop")
    reach = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs(docs).withColumn("new", F.when(F.coalesce(reach <= F.col("start"), F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("new").over(by_doc))
    islands = marked.groupBy("doc", "copy", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return islands.groupBy("doc", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def _solid() -> Column:
    """Numbers of the lines of ``text`` that hold more than blanks."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with __lines, __runs (by line number), __covered (lines that runs take, without
    blank ones) and __kept, the lines that stay."""
    covered = F.aggregate("runs", F.lit(0), lambda n, r: n + (r["stop"] - r["start"]).cast("int"))
    named = told_apart(docs, "__doc", "__copy")
    marks = materialise(spans(named.select(F.col("__doc").alias("doc"), F.col("__copy").alias("copy"), "text")).withColumn("covered", covered))
    marks = marks.withColumnsRenamed({"doc": "__doc", "copy": "__copy", "runs": "__runs", "covered": "__covered"})
    # The texts go through the join whole; only their lines' numbers are looked up.
    full = named.join(marks.hint("shuffle_hash"), ["__doc", "__copy"], "left").withColumn("__lines", F.split("text", "\n", -1))
    full = full.withColumn("__solid", F.when(F.col("__runs").isNotNull(), _solid()))
    by_line = F.transform("__runs", lambda r: F.struct(F.get("__solid", r["start"]).alias("start"), (F.get("__solid", (r["stop"] - 1).cast("int")) + 1).alias("stop")))
    full = full.withColumn("__runs", by_line).withColumn("__n", F.size("__runs"))
    gaps = F.transform(
        F.sequence(F.lit(0), F.col("__n")),
        lambda j: F.struct(F.when(j == 0, F.lit(0)).otherwise(F.get("__runs", j - 1)["stop"]).alias("start"), F.when(j == F.col("__n"), F.size("__lines")).otherwise(F.get("__runs", j)["start"]).alias("stop")),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("__lines", g["start"] + 1, g["stop"] - g["start"])))
    return full.withColumn("__kept", F.when(F.col("__runs").isNotNull() & F.col("__lines").isNotNull(), kept).otherwise(F.col("__lines")))


def remove_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without later copies of repeated runs; with ``drop_emptied``, also without the
    documents that had lines and keep none."""
    done = _cleaned(docs)
    if drop_emptied:
        # On the counts: a test of __kept would be pushed below and repeat its whole expression.
        done = done.where(F.col("__covered").isNull() | (F.size(_solid()) > F.col("__covered")))
    return done.select(*[F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and the SHA-256 of the kept lines joined by line feeds."""
    done = _cleaned(docs.select("doc_id", "text"))
    size = lambda c: F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(c)).cast("long")
    return done.select("doc_id", size("__lines").alias("n_lines"), (size("__lines") - size("__kept")).alias("n_removed"), F.greatest(F.col("__n"), F.lit(0)).cast("long").alias("n_runs"), F.sha2(F.coalesce(F.array_join("__kept", "\n"), F.lit("")), 256).alias("kept_sha256"))
