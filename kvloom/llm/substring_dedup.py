"""Substring dedup: seed and extend over words.

Words covered by a window of ``WINDOW`` words that also starts in a document with a smaller id are
removed.  Documents are joined on winnowed seeds (see :mod:`kvloom.llm.repeats`); around each
seed the match is extended to the right and to the left, and maximal repeats of at least
``WINDOW`` words are kept.  An occurrence is extended against the set of all earlier occurrences
that share its right part, not pair by pair.

Edge cases: a null or text without words has no words and loses none; a null doc_id counts as the
smallest and comes back as null; rows that repeat id and text get the same result each; rows of one
id (or of none) with different texts are documents of their own, neither smaller than the other; an
empty table gives no rows; other columns are not read by ``digest`` and pass unchanged through
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kvloom.llm import repeats
from kvloom.llm.repeats import Occurrence, Span, Spec
from kvloom.llm.suffix_dedup import intervals
from kvloom.llm.textops import binary, ids, ids_back

WINDOW = 50
SEED = 10
WORDS = Spec(words=True, window=WINDOW, seed=SEED, across=True)


def extend(group: list[Occurrence], spec: Spec = WORDS) -> Iterator[Span]:
    """Spans of later documents around one seed: seeds sorted by what follows give sets that share
    ``right`` words; within a set, each is extended left as far as any earlier document goes."""
    order = sorted(range(len(group)), key=lambda i: group[i][3])
    rights = [0] + [repeats.common(group[a][3], group[b][3], spec.step) for a, b in zip(order, order[1:])]
    for right, first, last in intervals(rights):
        if right < spec.seed:
            continue
        for i, left in repeats.furthest(order[first : last + 1], group, spec):
            if left >= 0 and left + right >= spec.window:
                yield i, left, right


def _finish(batches, build):
    for batch in batches:
        bounds, data = binary(batch.column("text"))
        copies, spans = batch.column("copies").to_pylist(), batch.column("spans").to_pylist()
        yield build(batch, [data[bounds[i] : bounds[i + 1]].tobytes().split() for i in range(len(copies))], copies, spans)


def _kept(words: list[bytes], copies, spans) -> list[bytes]:
    mask = repeats.mask_of(len(words), copies, spans, WORDS)
    return words if mask is None else [w for w, gone in zip(words, mask.tolist()) if not gone]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def build(batch, texts, copies, spans):
        kept = [_kept(words, copies[i], spans[i]) for i, words in enumerate(texts)]
        return pa.RecordBatch.from_arrays(
            [ids_back(ids(batch.column("doc"))), pa.array([len(w) for w in texts], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(texts, kept)], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return repeats.apply(docs.select("doc_id", "text"), WORDS, extend, lambda batches: _finish(batches, build), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with texts of the kept words, joined by one space; texts that lose none stay as
    they are."""
    columns = docs.columns

    def build(batch, texts, copies, spans):
        old = batch.column("text").to_pylist()
        new = []
        for i, words in enumerate(texts):
            kept = _kept(words, copies[i], spans[i])
            new.append(old[i] if len(kept) == len(words) else b" ".join(kept).decode("utf-8", "replace"))
        return repeats.with_text(batch, new, columns)

    return repeats.apply(docs, WORDS, extend, lambda batches: _finish(batches, build), docs.schema)
