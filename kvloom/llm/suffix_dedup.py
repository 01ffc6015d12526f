"""Suffix-array dedup: maximal repeat groups from the common-prefix interval tree.

Bytes covered by a ``WINDOW``-byte string that also starts earlier are removed; the first
occurrence stays whole.  The suffix array is sparse and partitioned: it holds the suffixes at
winnowed anchors (see :mod:`kvloom.llm.repeats`), and all suffixes that can share ``WINDOW`` bytes
around an anchor lie in that anchor's partition.  There the suffixes are sorted, the common-prefix
lengths of neighbours taken, and a stack scan lists every interval of suffixes with a common
prefix.  Each interval is tested for left extension: occurrences preceded by different bytes make a
maximal repeat, and those that share what precedes are extended to the left before they are
reported, with all occurrences of the group.

Edge cases: a null or empty text has no bytes and loses none; a null doc_id sorts before all others
and comes back as null; rows that repeat id and text get the same result each; rows of one id (or
of none) with different texts are documents of their own, ordered by a hash of their texts; an
empty table gives no rows; other columns are not read by ``digest`` and pass unchanged through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvloom.llm import repeats
from kvloom.llm.repeats import Occurrence, Span, Spec
from kvloom.llm.textops import binary, ids, ids_back

WINDOW = 100
SEED = 20
BYTES = Spec(words=False, window=WINDOW, seed=SEED, across=False)


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of a common-prefix array (``prefixes[i]``: of suffixes i-1 and i; the first entry
    is not used): length, first and last suffix of every interval of the tree, deepest first."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefixes) + 1):
        now = prefixes[i] if i < len(prefixes) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def maximal_groups(group: list[Occurrence], spec: Spec = BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least a window around one anchor: tokens before the anchor, tokens
    from it on, and all occurrences (indices)."""
    order = sorted(range(len(group)), key=lambda i: group[i][3])
    prefixes = [0] + [repeats.common(group[a][3], group[b][3], spec.step) for a, b in zip(order, order[1:])]
    for length, first, last in intervals(prefixes):
        if length < spec.seed:
            continue
        # Left-extension diversity: members sorted by what precedes them; intervals of these again
        # are groups that extend as far to the left, and differ beyond.
        members = sorted(order[first : last + 1], key=lambda i: group[i][2])
        lefts = [0] + [repeats.common(group[a][2], group[b][2], spec.step) for a, b in zip(members, members[1:])]
        for left, a, b in intervals(lefts):
            if left + length >= spec.window:
                yield left, length, members[a : b + 1]


def spans_of(group: list[Occurrence], spec: Spec = BYTES) -> Iterator[Span]:
    """Spans to remove around one anchor: every occurrence of a maximal group but the earliest."""
    for left, length, members in maximal_groups(group, spec):
        first = min((group[i][0], group[i][1]) for i in members)
        for i in members:
            if (group[i][0], group[i][1]) > first:
                yield i, left, length


def _finish(batches, build):
    for batch in batches:
        bounds, data = binary(batch.column("text"))
        copies, spans = batch.column("copies").to_pylist(), batch.column("spans").to_pylist()
        masks = (repeats.mask_of(int(bounds[i + 1] - bounds[i]), copies[i], spans[i], BYTES) for i in range(len(copies)))
        yield build(batch, bounds, data, masks)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what remains."""

    def build(batch, bounds, data, masks):
        removed, spans, hashes = [], [], []
        for i, mask in enumerate(masks):
            text = data[bounds[i] : bounds[i + 1]]
            if mask is None:
                removed.append(0)
                spans.append(0)
            else:
                removed.append(int(mask.sum()))
                spans.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0)
                text = text[~mask]
            hashes.append(hashlib.sha256(text.tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [ids_back(ids(batch.column("doc"))), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.apply(docs.select("doc_id", "text"), BYTES, spans_of, lambda batches: _finish(batches, build), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``.  A cut inside a character takes the
    rest of that character with it; a document of which nothing remains stays, with empty text."""
    columns = docs.columns

    def build(batch, bounds, data, masks):
        nulls = batch.column("text").is_null().to_pylist()
        texts = []
        for i, mask in enumerate(masks):
            text = data[bounds[i] : bounds[i + 1]]
            texts.append(None if nulls[i] else (text if mask is None else text[~mask]).tobytes().decode("utf-8", "ignore"))
        return repeats.with_text(batch, texts, columns)

    return repeats.apply(docs, BYTES, spans_of, lambda batches: _finish(batches, build), docs.schema)
