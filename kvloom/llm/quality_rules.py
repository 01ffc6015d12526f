"""Quality rules: how far a text's histograms lie from those of its language.

Two histograms of each text, over character classes and over the language's common words, are
compared with the language's own by Jensen-Shannon distance.  The references are counted over all
texts that pass the base rules; a word is common if it makes up at least ``COMMON_SHARE`` of a
language's words (so 1/COMMON_SHARE words at most, however large the corpus).  Languages with
fewer than ``RARE_SHARE`` of the documents, and null, share one pooled reference, which bounds
what the driver holds.

Guards: the character test needs ``MIN_CHARS`` word characters, the word test ``MIN_WORDS`` words,
and a text too short for both is judged by the base rules alone.

Edge cases: a null or empty text has no words and fails the base rules; repeated rows get equal
verdicts; an empty table gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.shipping import materialise, ship
from kvloom.llm.textops import Chunk, Slices, chunks, mix, signed, slice_hash, words

COMMON_SHARE = 0.005
RARE_SHARE = 0.001
MIN_CHARS = 300
MIN_WORDS = 60
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.31
MIN_TEXT_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
POOLED = "*"

#: Character classes: small letter, capital, digit, blank, line end, stop, symbol, beyond ASCII, rest.
N_CLASSES = 9
_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[list(b".,;:'\"?-()")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[192:] = 7
_HEAD = np.ones(256, dtype=bool)
_HEAD[128:192] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _texts_of(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, positions, side="right") - 1


def _dup_lines(chunk: Chunk, slices: Slices) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(chunk.bounds) - 1
    cuts = np.flatnonzero(chunk.data == 10)
    starts = np.unique(np.concatenate([chunk.bounds[:-1], cuts + 1]))
    starts = starts[starts < len(chunk.data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    texts = _texts_of(starts, chunk.bounds)
    stops = np.append(starts[1:], len(chunk.data))
    stops = stops - (chunk.data[stops - 1] == 10)
    solid = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(~_SPACES[chunk.data], out=solid[1:])
    real = solid[stops] > solid[starts]
    starts, stops, texts = starts[real], stops[real], texts[real]
    keys = mix(slice_hash(slices, starts, stops) ^ mix(texts.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return np.bincount(texts[later], minlength=n)


def _repeat_words(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> np.ndarray:
    """Words in windows of ``width`` words that their text has twice or more."""
    n = len(bounds) - 1
    grams = Slices(hashes).grams(width) if len(hashes) >= width else np.zeros(0, np.uint64)
    if not len(grams):
        return np.zeros(n, np.int64)
    starts = np.arange(len(grams))
    texts = _texts_of(starts, bounds)
    inside = starts + width <= bounds[texts + 1]
    starts, texts = starts[inside], texts[inside]
    keys = mix(grams[starts] ^ mix(texts.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = starts[counts[inverse] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, bounds)


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """The base counts of each text, its class histogram, and its word hashes and bounds."""
    hashes, bounds, _, _ = words(chunk)
    heads = _HEAD[chunk.data]
    n = len(chunk.bounds) - 1
    texts = np.repeat(np.arange(n), np.diff(chunk.bounds))
    classes = np.bincount((texts * N_CLASSES + _CLASS[chunk.data])[heads], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    return {
        "n_words": np.diff(bounds),
        "word_chars": _per_text(heads & ~_SPACES[chunk.data], chunk.bounds),
        "n_symbols": _per_text(_SYMBOL[chunk.data], chunk.bounds),
        "n_dup_lines": _dup_lines(chunk, Slices(chunk.data)),
        "n_repeat_words": _repeat_words(hashes, bounds),
        "classes": classes,
        "hashes": hashes,
        "bounds": bounds,
    }


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_TEXT_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` from ``q``; 0 for empty rows."""
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.zeros(p.shape), where=total > 0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _languages(column, known: frozenset[str]) -> list[str]:
    return [x if x in known else POOLED for x in column.to_pylist()]


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: class shares, hashes of common words (sorted), their shares and the rest's."""
    ship(docs.sparkSession)
    total = docs.groupBy("lang").count()
    n_docs = docs.count()
    known = frozenset(r["lang"] for r in total.where(F.col("lang").isNotNull() & (F.col("count") >= RARE_SHARE * n_docs)).collect())

    def count(batches):
        for batch in batches:
            names = _languages(batch.column("lang"), known)
            order = sorted(set(names))
            of = np.array([order.index(x) for x in names])
            found: dict[str, list] = {x: [] for x in order}
            classes = np.zeros((len(order), N_CLASSES), np.int64)
            for chunk in chunks(batch.column("text")):
                stats = measure(chunk)
                good = ~base_failed(stats)
                mine = of[chunk.first : chunk.last]
                np.add.at(classes, mine[good], stats["classes"][good])
                lang = np.repeat(np.where(good, mine, -1), stats["n_words"])
                for i, x in enumerate(order):
                    found[x].append(np.unique(stats["hashes"][lang == i], return_counts=True))
            for i, x in enumerate(order):
                keys = np.concatenate([k for k, _ in found[x]])
                counts = np.concatenate([c for _, c in found[x]])
                unique, inverse = np.unique(keys, return_inverse=True)
                sums = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * (len(unique) + N_CLASSES)), pa.array([0] * len(unique) + [1] * N_CLASSES, pa.int32()), pa.array(np.concatenate([signed(unique), np.arange(N_CLASSES)])), pa.array(np.concatenate([sums, classes[i]]))],
                    names=["lang", "kind", "key", "n"],
                )

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # One pass gives both: words below the share are cut before anything leaves the executors.
    counted = materialise(counted)
    sums = {r["lang"]: r["n"] for r in counted.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    floor = F.create_map(*[x for k, v in sums.items() for x in (F.lit(k), F.lit(v * COMMON_SHARE))]) if sums else None
    rows = counted.where((F.col("kind") == 1) | (F.col("n") >= floor[F.col("lang")])).collect() if sums else []
    out = {}
    for lang in {r["lang"] for r in rows}:
        classes = np.zeros(N_CLASSES)
        common = sorted((r["key"] & (2**64 - 1), r["n"]) for r in rows if r["lang"] == lang and r["kind"] == 0)
        for r in rows:
            if r["lang"] == lang and r["kind"] == 1:
                classes[r["key"]] = r["n"]
        n = sums.get(lang, 0)
        shares = np.array([c for _, c in common], float) / max(n, 1)
        out[lang] = (classes / max(classes.sum(), 1), np.array([h for h, _ in common], np.uint64), np.append(shares, 1 - shares.sum()))
    return out


def _distances(stats: dict[str, np.ndarray], names: np.ndarray, refs) -> tuple[np.ndarray, np.ndarray]:
    n = len(names)
    by_char, by_word = np.zeros(n), np.zeros(n)
    of = np.repeat(np.arange(n), stats["n_words"])
    for lang in set(names) & set(refs):
        classes, common, shares = refs[lang]
        mine = np.flatnonzero(names == lang)
        by_char[mine] = js_distance(stats["classes"][mine].astype(float), classes)
        if not len(common):
            continue
        place = np.full(n, -1)
        place[mine] = np.arange(len(mine))
        here = place[of]
        hashes = stats["hashes"][here >= 0]
        at = np.searchsorted(common, hashes)
        at[at == len(common)] = 0
        slot = np.where(common[at] == hashes, at, len(common))
        width = len(common) + 1
        histogram = np.bincount(here[here >= 0] * width + slot, minlength=len(mine) * width).reshape(len(mine), width)
        by_word[mine] = js_distance(histogram.astype(float), shares)
    return by_char, by_word


def judge(docs: DataFrame, refs=None) -> DataFrame:
    """One row per document: base counts, the two distances, and whether it is kept."""
    ship(docs.sparkSession)
    refs = references(docs) if refs is None else refs
    known = frozenset(refs)

    def verdicts(batches):
        for batch in batches:
            names = np.array(_languages(batch.column("lang"), known), dtype=object)
            for chunk in chunks(batch.column("text")):
                stats = measure(chunk)
                failed = base_failed(stats)
                by_char, by_word = _distances(stats, names[chunk.first : chunk.last], refs)
                odd = ((stats["word_chars"] >= MIN_CHARS) & (by_char > MAX_CHAR_DISTANCE)) | ((stats["n_words"] >= MIN_WORDS) & (by_word > MAX_WORD_DISTANCE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.last - chunk.first).cast(pa.int64()), *(pa.array(stats[k], pa.int64()) for k in _COUNTS), pa.array(failed), pa.array(~failed & ~odd), pa.array(by_char), pa.array(by_word)],
                    names=["doc_id", *_COUNTS, "base_failed", "kept", "char_distance", "word_distance"],
                )

    return docs.select("doc_id", "text", "lang").mapInArrow(verdicts, RESULT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged: the verdict is computed beside each row
    in one pass, so no join is needed and repeated ids cannot mix."""
    ship(docs.sparkSession)
    refs = references(docs)
    known = frozenset(refs)
    columns = docs.columns

    def kept(batches):
        for batch in batches:
            names = np.array(_languages(batch.column("lang"), known), dtype=object)
            good = []
            for chunk in chunks(batch.column("text")):
                stats = measure(chunk)
                by_char, by_word = _distances(stats, names[chunk.first : chunk.last], refs)
                odd = ((stats["word_chars"] >= MIN_CHARS) & (by_char > MAX_CHAR_DISTANCE)) | ((stats["n_words"] >= MIN_WORDS) & (by_word > MAX_WORD_DISTANCE))
                good.append(~base_failed(stats) & ~odd)
            if good:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], names=columns).filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(kept, docs.schema)
