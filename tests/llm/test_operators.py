"""The operators against plain versions: the smallest tables, and a table of odd rows (nulls, empty
and long texts, ties, copies, repeated rows, extra columns), and empty tables."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from conftest import SMALL  # noqa: E402
from kvloom.llm import html_extract, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, repeats, substring_dedup, subword_sampling, suffix_dedup, topk_search  # noqa: E402
from kvloom.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, spans string"


def odd_rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line, base = say(70), say(14), say(200)
    texts = [None, "", "   \n ", "one two", "One\tTWO", "aaaa" * 400, "é " * 300, say(4000), base, base, base.upper(), base + " tail", say(20) + " " + passage + " " + say(9), passage, say(5) + "\n" + line + "\nx\n" + say(8), line + "\nx\n" + line, say(40) + "\n" + line]
    texts += [base.replace(" ", "\n", 3), base[:600] + say(6) + base[640:], "x" * 99, "x" * 100, passage + passage, "\n".join([line] * 30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows[3] = (None, rows[3][1])
    return [*rows, rows[8], rows[0]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "clash", "clash") for i, t in odd_rows()], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").persist()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(df, *columns):
    rows = df.collect()
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
    for r in rows:  # repeated rows agree
        assert tuple(r[c] for c in columns) == found[r["doc_id"]]
    return found


@pytest.mark.parametrize("split", [20_000, 1])
def test_suffix_dedup(odd, small, split, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", split)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffix_dedup.digest(odd), *columns) == brute.removed_bytes(odd_rows())
    if split > 1:
        assert by_id(suffix_dedup.digest(small), *columns) == brute.removed_bytes(pairs(small))


@pytest.mark.parametrize("split", [20_000, 1])
def test_substring_dedup(odd, small, split, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", split)
    columns = ("n_words", "n_removed", "kept_sha256")
    assert by_id(substring_dedup.digest(odd), *columns) == brute.removed_words(odd_rows())
    if split > 1:
        assert by_id(substring_dedup.digest(small), *columns) == brute.removed_words(pairs(small))


def test_repeats_are_cut_from_texts(odd):
    for operator in (suffix_dedup, substring_dedup):
        done = operator.remove_repeats(odd)
        assert done.columns == odd.columns and done.count() == odd.count()
        assert done.where("doc_id = 0").first()["text"] is None
        assert done.where("doc_id = 9").first()["text"] == ""


@pytest.mark.parametrize("split", [20_000, 2])
def test_repeats_of_repeated_and_null_ids(spark, split, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", split)
    a, p, b, other = (" ".join(f"{x}{i}" for i in range(80)) for x in "apbo")
    rows = [(None, a + " " + p), (None, p + " " + b), (1, p), (5, p), (5, other), (7, other + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.digest(frame).collect())
    assert got == [(0, 160, 0), (0, 160, 0), (1, 80, 80), (5, 80, 0), (5, 80, 80), (7, 81, 80)]
    texts = [((r["doc_id"] or 0), r["text"]) for r in suffix_dedup.remove_repeats(frame).collect()]
    assert (1, "") in texts and (5, "") in texts and (5, other) in texts and (7, " end") in texts
    nulls = sorted(t for i, t in texts if i == 0)
    assert [a + " " + p, " " + b] in (nulls, nulls[::-1]) or [a + " ", p + " " + b] in (nulls, nulls[::-1]) or sorted([a, p + " " + b]) == nulls


def test_repeats_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", 5)
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["ab", "cde", "fghi", "jk"]) + str(r.randrange(900)) for _ in range(n))
    core, near = say(12), say(30)
    rows = [(i, say(r.randrange(9)) + " " + near[r.randrange(3) * 40 :] + " " + core + " " + say(r.randrange(3)) + near[: r.randrange(90)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(suffix_dedup.digest(frame), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.removed_bytes(rows)
    assert by_id(substring_dedup.digest(frame), "n_words", "n_removed", "kept_sha256") == brute.removed_words(rows)


def test_interval_tree():
    assert sorted(suffix_dedup.intervals([0, 1, 3, 2, 0])) == [(0, 0, 4), (1, 0, 3), (2, 1, 3), (3, 1, 2)]
    group = [(1, 50, b"zy", b"a" * 120), (2, 10, b"zx", b"a" * 110 + b"b" * 10), (3, 0, b"", b"a" * 120)]
    assert {(n, tuple(sorted(m))) for _, n, m in suffix_dedup.maximal_groups(group)} >= {(120, (0, 2)), (110, (0, 1, 2))}


def test_line_dedup(odd, small):
    columns = ("n_lines", "n_removed", "kept_sha256")
    assert by_id(line_dedup.digest(odd), *columns) == brute.removed_lines([(i, t) for i, t in dict(odd_rows()).items()], line_dedup.STRONG)
    assert by_id(line_dedup.digest(small), *columns) == brute.removed_lines(pairs(small), line_dedup.STRONG)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_dense_runs(spark, seed):
    r = random.Random(seed)
    kinds = ["a" * 7, "b" * 4, "c", "d", "e", "f" * 3, "", "g", "h", "i" * 9]
    rows = [(i, "\n".join(r.choice(kinds[seed % 3 :]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    got = by_id(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")), "n_lines", "n_removed", "kept_sha256")
    assert got == brute.removed_lines(rows, line_dedup.STRONG)


def test_line_dedup_of_repeated_and_null_ids(spark):
    a, b, c = ("\n".join(f"line {i} of {x}" for i in range(5)) for x in "abc")
    rows = [(None, a), (None, "own\n" + b), (1, b), (5, b), (5, c), (5, c), (9, a)]
    kept = [(r["doc_id"] or 0, r["text"]) for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted([(0, a), (0, "own\n" + b), (1, ""), (5, ""), (5, c), (5, c), (9, "")])


def test_line_dedup_judges_the_run(spark):
    menu = ["Home", "News", "Help"]  # none alone reaches the bound
    passage = [f"Line {i} of a passage" for i in range(12)]
    notice = "All figures are given without any warranty at all."
    texts = ["\n".join(["alpha", *passage, "ok"]), "\n".join(["beta", *passage, "gamma", "ok"]), notice + "\ndelta", "epsilon\n" + notice, "\n".join(["zeta", *menu, "ok"]), "\n".join(["eta", *menu, "theta"]), "\n".join(["Home", "iota", "Home", "News"])]
    kept = [texts[0], "beta\ngamma\nok", texts[2], "epsilon", texts[4], "eta\ntheta", "Home\niota"]
    done = line_dedup.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in done.collect()} == dict(enumerate(kept))


def test_line_dedup_keeps_columns_and_drops_emptied(odd):
    done = line_dedup.remove_lines(odd, drop_emptied=True)
    assert done.columns == odd.columns
    ids = {r["doc_id"] for r in done.collect()}
    assert 8 in ids and 9 not in ids and 0 in ids and 1 in ids


@pytest.mark.parametrize("settings", [{}, {"SHORT_LIST": 1}, {"PART": 64, "FAN_BITS": 3, "HOT_LEAST": 3}])
def test_jaccard_join(odd, small, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    columns = ("n_shingles", "component_id")
    assert by_id(jaccard_join.digest(odd), *columns) == brute.near_classes(odd_rows())
    assert by_id(jaccard_join.digest(small), *columns) == brute.near_classes(pairs(small))


def test_jaccard_judges_repeated_ids_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, b + " tail"), (None, c), (9, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.digest(frame).collect())) == [(0, 0), (0, 0), (1, 1), (5, 0), (5, 1), (9, 0)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.keep_one(frame).collect()) == [(0, b + " tail"), (0, c), (1, a)]


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(120)] = f"x{i}{r.random()}"
        rows.append((i, " ".join(words)))
    got = by_id(jaccard_join.digest(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near_classes(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["class"] for r in jaccard_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_quality_counts(odd, small):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for table, rows in ((odd, odd_rows()), (small, pairs(small))):
        assert by_id(quality_rules.judge(table), *columns) == {i: brute.text_counts(t) for i, t in rows}


def test_quality_verdicts(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.judge(small).join(labels, "doc_id").where("not base_failed and n_words >= 60").collect()
    kept = defaultdict(list)
    for r in rows:
        kept[r["quality"]].append(r["kept"])
        assert not r["base_failed"] or not r["kept"]
    assert np.mean(kept[1]) > 0.97 and (not kept[0] or np.mean(kept[0]) < 0.3)
    assert quality_rules.keep_good(small).count() == quality_rules.judge(small).where("kept").count()


def test_js_distance():
    q = np.array([0.5, 0.5, 0.0])
    assert np.allclose(quality_rules.js_distance(np.array([[1, 1, 0], [0, 0, 4], [0, 0, 0]], float), q), [0, 1, 0])


def test_packing(odd, small):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for table in (small, odd):
        rows = packing.pack(table, path).collect()
        texts = dict(pairs(table))
        ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
        copies = Counter(i for i, _ in pairs(table))
        pieces = defaultdict(Counter)
        sequences = defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]][(r["piece"], r["start"], r["length"])] += 1
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            import zlib

            cut = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
        for i, t in ids.items():
            assert sum(n for (_, _, n), c in pieces[i].items()) == len(t) and set(pieces[i].values()) == {copies[i]}
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(len(ids[i]) * c for i, c in copies.items())
        assert len(sequences) <= -(-total // 1024) * 1.1 + 2


@pytest.mark.parametrize("text", ["a \n b", "a  b", "\n \nfoo", "x \n", "  ", "é  b", "　 a", "don't 's 12 3", "", "a<|endoftext|>b", "q \t z", "a.b, c.. d"])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert np.frombuffer(packing.encoder(path).encode(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_plan_is_exact_and_tight():
    r = random.Random(1)
    counts = Counter(min(1024, int(r.expovariate(1 / 300)) + 1) for _ in range(20_000))
    segments, n = packing.plan(dict(counts))
    placed = Counter()
    for length, _, k, _, _ in segments:
        placed[length] += k
    assert placed == counts
    assert n <= -(-sum(a * b for a, b in counts.items()) // 1024) * 1.01


def test_topk(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    extra = spark.createDataFrame([(100_000, None, 0), (100_020, [float("nan")] * 64, 0), (100_040, [None] + [0.0] * 63, 0), (None, [0.1] * 64, 0), (100_060, [0.0] * 64, 0), (100_061, [1e6] * 64, 0)], "vec_id long, embedding array<float>, label int")
    both = table.unionByName(extra)
    held = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(int) for r in table.union(extra.where("vec_id in (100060, 100061)")).collect()}
    ids = np.array(sorted(held))
    matrix = np.array([held[i] for i in ids])
    got = defaultdict(list)
    for r in topk_search.search(both).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q in got:
        scores = matrix @ held[q]
        rest = ids != q
        order = np.lexsort((ids[rest], -scores[rest]))[:20]
        assert got[q] == list(zip(ids[rest][order].tolist(), scores[rest][order].tolist()))
    assert topk_search.search(both.limit(0)).count() == 0


def _best(table, query, own, k):
    scores = [(int(np.dot(v, query)), i) for i, v in table if i != own]
    return [(i, s) for s, i in sorted(scores, key=lambda p: (-p[0], p[1]))[:k]]


def test_topk_lists_stop_early():
    r = np.random.default_rng(3)
    for spread in (0.0, 1.5):  # with the second, few dimensions decide and lists are read a little way only
        vectors = np.floor(64 * r.normal(size=(3000, 8)) * np.exp(-spread * np.arange(8))).astype(np.int64)
        vectors[500:900] = vectors[7]
        ids = r.permutation(3000).astype(np.int64)
        lists, table = topk_search.Lists(ids, vectors), list(zip(ids.tolist(), vectors))
        queries = np.concatenate([vectors[:12], np.zeros((1, 8), np.int64), 1 << 20 + 0 * vectors[:1], (1 << 45) + vectors[:1]])
        owns = [*ids[:12].tolist(), -1, -1, -1]
        plain = [_best(table, q, own, 5) for q, own in zip(queries, owns)]
        floors = [p[-1][1] if i % 2 else None for i, p in enumerate(plain)]
        for (got, scores), expected in zip(lists.top(queries, owns, floors, 5), plain):
            assert list(zip(got.tolist(), scores.tolist())) == expected
        depths = lists.depths(queries[:12], np.array([p[-1][1] for p in plain[:12]]))
        if spread:
            assert np.median(depths) < 300
        for q, d, p in zip(queries, depths, plain):
            assert not d or {i for i, s in p} <= set(ids[lists.met(q, int(d))].tolist())
        assert [len(f[0]) for f in lists.top(queries[:2], owns[:2], [1 << 40, 1 << 40], 5)] == [0, 0]


def test_topk_over_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(size=4 if i % 9 else 6).tolist(), i) for i in range(400)]
    rows += [(40, [0.5, 0.5, 0.5, 0.5], 1)] * 150 + [(60, [1.0, -1.0, 1.0, -1.0], 1), (60, [2.0, 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("score", F.lit("x"))
    monkeypatch.setattr(topk_search, "BLOCK", 200)
    got = defaultdict(list)
    for row in topk_search.search(table, k=7).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    held = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v, _ in rows]
    plain = defaultdict(list)
    for i, q in {(i, tuple(v.tolist())) for i, v in held if i % 20 == 0}:
        plain[i] += _best([(j, v) for j, v in held if len(v) == len(q)], np.array(q), i, 7)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in plain.items()}


def test_quality_classifier(spark, small, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_classifier.score(small, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert not bad or np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.score(odd, labels).count() == odd.count()
    assert {r["score"] for r in quality_classifier.score(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_classifier_fits_all_pairs(spark, small):
    """The slope of the loss over all pairs, written out, vanishes at the fitted weights."""
    rows = quality_classifier.labelled(quality_classifier.featured(small), spark.read.parquet(f"{SMALL}/labels.parquet"))
    model, kept = quality_classifier.fit(rows), rows.collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in kept]).astype(float)
    y, z = np.array([r["y"] for r in kept]), ((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)).clip(-8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    slope = lambda w: -(1 / (1 + np.exp(d @ w))) @ d / len(d) + quality_classifier.RIDGE * w
    assert np.linalg.norm(slope(model.weights)) < 1e-3 * np.linalg.norm(slope(0 * model.weights))


def test_quality_classifier_learns_from_every_label(spark):
    """The threshold parts as many rows of the learning folds as have label 0, many as they are."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words[: 300 if i % 7 else 400]) for _ in range(r.randint(12, 40))), int(r.random() < (0.7 if i % 7 else 0.4))) for i in range(12000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    learning = [(r["predicted"], rows[r["doc_id"]][2]) for r in quality_classifier.score(docs, labels).collect() if not r["held_out"]]
    assert len(learning) > 9000
    assert abs(sum(p == 0 for p, _ in learning) - sum(q == 0 for _, q in learning)) <= 1


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9003, "u", "<p>never <b>closed <div"), (9004, "u", "<nav><a>x</a></nav>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_extract.extract(pages.unionByName(odd)).collect()}
    assert rows[9001]["text"] == rows[9002]["text"] == "" and rows[9004]["n_chars"] == 0
    for r in pages.collect():
        want = " ".join(b.text for b in html_extract.blocks(r["html"], html_extract.root()) if html_extract.semantic_label(b))
        assert rows[r["page_id"]]["text"] == want and rows[r["page_id"]]["n_chars"] == len(want)


def test_html_other_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    model = html_extract.learn(pages[:30])
    articles = [[b.text for b in html_extract.blocks(p, html_extract.root()) if html_extract.semantic_label(b)] for p in pages[30:]] * 4
    right = total = 0
    for page in html_extract.layouts(articles, seed=77):
        found = list(html_extract.blocks(page, html_extract.root()))
        for block, y in zip(found, model.decode([model.emission(b) for b in found])):
            right, total = right + (y == bool(block.node.main)), total + 1
    assert right / total > 0.95


def _written_pages():
    """Pages written by hand: (html, main text)."""
    a, b, c = "The river rose by two metres during the night.", "Families in the lower streets were brought to the school, where they can stay for some days.", "Repairs will take until spring, the mayor said."
    body = f"<h1>River floods the old town</h1><p>{a}</p><p>{b}</p><p>{c}</p>"
    text = f"River floods the old town {a} {b} {c}"
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
    nav, foot = f"<nav>{menu}</nav>", "<footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer>"
    ad = "<p>Buy cheap pills now and save half.</p>"
    comment = "<div><b>Tom</b><p>I do not agree with this at all, it was badly planned.</p></div>"
    pages = [
        f"<body>{nav}<article>{body}</article>{foot}",
        f"<body>{nav}<main>{body}</main><aside>{menu}</aside>{foot}",
        f'<body><div class="navbar">{menu}</div><div class="article-content">{body}</div><div class="footer"><p>Contact us</p></div>',
        f'<body><div id="top-menu">{menu}</div><div id="story">{body}</div><div id="disqus-thread">{comment}{comment}</div>',
        f'<body>{nav}<article>{body}<div class="disqus-thread">{comment}</div></article>{foot}',
        f'<body>{nav}<article>{body}<section id="user-feedback">{comment}</section></article>{foot}',
        f'<body>{nav}<article>{body}<div class="sharebar"><a href="f">Facebook</a> <a href="t">Twitter</a></div></article>{foot}',
        f'<body>{nav}<article><h1>River floods the old town</h1><p>{a}</p><div class="ad-slot">{ad}</div><p>{b}</p><p>{c}</p></article>{foot}',
        f'<body>{nav}<div class="post-body">{body}</div><div class="related-posts"><h3>Read on</h3>{menu}</div>{foot}',
        f'<body><header class="site-header"><div>The Paper</div></header>{nav}<section class="entry-content">{body}</section>{foot}',
        f'<body><div class="cookie-consent"><p>We use cookies to make this site better.</p><button>Accept</button></div>{nav}<main class="content">{body}</main>{foot}',
        f'<body>{nav}<main><div class="newsletter-signup"><p>Get our letter each morning.</p><form><input><button>Send</button></form></div>{body}</main>{foot}',
        f"<table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td><td class='content'>{body}</td><td class='ads'>Buy cheap pills now</td></tr></table>",
        f'<body>{nav}<article itemprop="articleBody" class="text">{body}</article><section class="comments-area"><h2>3 replies</h2>{comment}</section>{foot}',
        f'<body><form class="search-form"><input><button>Search</button></form><div id="content">{body}</div><div id="sidebar"><h3>Popular</h3>{menu}</div>{foot}',
        f'<body>{nav}<div class="page"><div class="main-column" role="main">{body}</div><div class="right-column sidebar">{ad}</div></div>{foot}',
        f'<body><script>var x="<p>no</p>"</script><style>p{{}}</style>{nav}<article>{body}</article><noscript><p>Turn on scripts.</p></noscript>{foot}',
        f'<body><div class="breadcrumb"><a href="/">Home</a> <a href="/n">News</a></div><article class="post">{body}<div class="social-share"><a>Share this</a></div></article><div class="comment-list">{comment}</div>{foot}',
        f'<body><div class="banner-ad">{ad}</div><div class="story-text">{body}</div><div class="site-footer"><p>Terms of use</p></div>',
        f'<body>{nav}<main id="main"><article>{body}</article><div class="recommended"><h3>More for you</h3>{menu}</div></main>{foot}',
    ]
    found = [(p, text) for p in pages]
    found.append((f'<body>{nav}<article>{body}<p>The area <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is &lt; 9.</p></article>{foot}', text + " The area x+1 is < 9."))
    found.append((f'<body>{nav}<article>{body}<figure><img><figcaption>The old bridge in May</figcaption></figure></article>{foot}', text + " The old bridge in May"))
    return found


def test_html_pages_written_by_hand(spark):
    """Words of the main text against those extracted, with a field fitted on the supplied pages."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    extractor = html_extract.Extractor(html_extract.learn(pages[:240]))
    hit = got_all = want_all = 0
    for i, (page, want) in enumerate(_written_pages()):
        got = extractor.text(page)
        if got != want:
            print(i, repr(got[-150:]))
        both = sum((Counter(got.split()) & Counter(want.split())).values())
        hit, got_all, want_all = hit + both, got_all + len(got.split()), want_all + len(want.split())
    assert 2 * hit / (got_all + want_all) >= 0.95


def test_html_blocks():
    page = "<!-- <p>no</p> --><script>var a='<p>no</p>'</script><ul><li>a &amp; b<li>c&nbsp;d</ul><p>e<br>f <i>g</i>h<p>&lt;i&gt;</p>tail"
    assert [b.text for b in html_extract.blocks(page, html_extract.root())] == ["a & b", "c d", "e f gh", "<i>", "tail"]


def test_html_features_of_whole_blocks():
    late = html_extract.Block(html_extract.root(), "word " * 60 + "7" * 900 + " All rights reserved.", 0)
    assert {"copyright", "digits 3"} <= set(html_extract.text_features(late))


@pytest.mark.parametrize("value", ["s" * 3999, "s" * 4001, "{a: <b> > 1}" * 9000, "it's = '"])
def test_html_long_attributes(value):
    page = f'<main data-main="1">a<article data-s="{value}"><p>b</p></article>c</main><p>d'
    found = list(html_extract.blocks(page, html_extract.root()))
    assert [(b.text, b.node.tag) for b in found] == [("a", "main"), ("b", "p"), ("c", "main"), ("d", "p")]
    assert "tag article" in found[1].node.features and "tag article" not in found[2].node.features


def test_html_open_quotes_and_custom_elements():
    texts = lambda page: [b.text for b in html_extract.blocks(page, html_extract.root())]
    assert texts('<p title="a>b</p><p>c') == ["b", "c"]
    assert texts("<p don't>a</p><p>it's b") == ["a", "it's b"]
    assert texts("<title-card>a</title-card><object-view><p>b</object-view><iframe/><p>no</iframe><object><p>d</object><p>c") == ["a", "b", "d", "c"]


def test_viterbi_is_best_path():
    r = random.Random(2)
    model = html_extract.Field({}, [[0.3, -0.7], [0.1, 0.9]], 0.2)
    for n in range(1, 9):
        emissions = [r.uniform(-2, 2) for _ in range(n)]
        score = lambda y: sum(e * v for e, v in zip(emissions, y)) + 0.2 * y[0] + sum(model.pairs[a][b] for a, b in zip(y, y[1:]))
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=score)
        assert math.isclose(score(model.decode(emissions)), score(best))


def test_subword_sampling(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    turns = spark.createDataFrame([(1, 0, "the quick brown fox"), (1, 1, None), (2, 0, ""), (3, 0, "a  b\né漢"), (3, 0, "a  b\né漢"), (4, 0, "x")], "conv_id long, turn long, text string")
    samples = subword_sampling.sample(turns, path, {"conv_id": F.col("conv_id"), "turn": F.col("turn")}, F.xxhash64("conv_id", "turn"))
    rows = subword_sampling.decode(samples, path).collect()
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in turns.collect()}
    for r in rows:
        assert r["decoded"] == texts[(r["conv_id"], r["turn"])] and r["n_ids"] == len(r["ids"])
    mine = [tuple(r["ids"]) for r in rows if r["conv_id"] == 1]
    assert len(mine) == len(set(mine)) == subword_sampling.K
    assert [r["ids"] for r in rows if r["conv_id"] == 2] == [[]]
    assert not [r for r in rows if (r["conv_id"], r["turn"]) == (1, 1)]


def test_subword_sampling_query_takes_whole_documents(spark, small):
    from kvloom.llm import queries

    rows = queries.op7_subword_sampling(spark, SMALL).select("doc_id", "sample", "n_ids", "round_trip").collect()
    assert all(r["round_trip"] for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i, t in pairs(small) if t is not None}
    assert max(r["n_ids"] for r in rows) * 8 > max(len(t or "") for _, t in pairs(small))


def test_subword_samples_do_not_depend_on_branches_left_out(monkeypatch):
    """Branches of later words are left out only where none can be among the best."""
    sampler = subword_sampling.Sampler(tokenizer_path("piece_bpe_32k.model"))
    texts = ["the quick brown fox jumps over the lazy dog " * 40, ", " * 500 + "there", "\x07 " * 300 + "an of", "  a  b ", "é漢🙂" * 50]
    for k in (1, 4, 30):
        monkeypatch.setattr(subword_sampling, "EARLY", 8)
        some = sampler.batch(texts, k, list(range(len(texts))))
        monkeypatch.setattr(subword_sampling, "EARLY", 1 << 20)
        for a, b in zip(some, sampler.batch(texts, k, list(range(len(texts))))):
            assert np.allclose(a, b, rtol=0, atol=1e-9)
        ids, upto = some[3], np.cumsum(some[2])
        assert [t.encode() for t in np.array(texts, object)[some[0]]] == list(sampler.spelt(ids, upto))


def test_subword_words_of_a_batch():
    """The words of texts taken together are those of each text alone, numbered as they come."""
    sampler = subword_sampling.Sampler(tokenizer_path("piece_bpe_32k.model"))
    texts = ["a b a", "", " ", "c  a ", " b", "b\nc a", "a\u2581b", "x", "é 漢 x", "a b a"]
    for mine in (texts, [], [""], [*texts, "a \ud800 b"]):
        words, chains = sampler.chains(mine)
        assert len(words) == len(set(words)) and len(chains) == len(mine)
        for t, chain in zip(mine, chains):
            assert ["\u2581" + words[i] for i in chain] == (sampler.split(("\u2581" + t).replace(" ", "\u2581")) if t else [])
        together = sampler.batch(mine, 3, list(range(len(mine))))
        assert sorted(set(together[0].tolist())) == list(range(len(mine)))
        for i, t in enumerate(mine):
            alone = np.concatenate([ids for ids, *_ in sampler.sample(t, 3, i)])
            assert together[3][np.repeat(together[0], together[2]) == i].tolist() == alone.tolist()


def test_inclusion_scores_are_unbiased():
    sampler = subword_sampling.Sampler(tokenizer_path("piece_bpe_32k.model"))
    n, weights, p = 4000, Counter(), {}
    for seed in range(n):
        for ids, log_p, inclusion in sampler.sample("there", 2, seed):
            weights[tuple(ids)] += 1 / inclusion
            p[tuple(ids)] = log_p
    assert math.isclose(sum(map(math.exp, p.values())), 1, abs_tol=1e-3)
    for ids, log_p in p.items():
        if log_p > -3:
            assert abs(weights[ids] / n - 1) < 0.1


def test_empty_tables(none, spark):
    path = tokenizer_path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (suffix_dedup.digest(none), substring_dedup.digest(none), line_dedup.digest(none), jaccard_join.digest(none), quality_rules.judge(none), packing.pack(none, path), quality_classifier.score(none, labels)):
        assert frame.count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from kvloom.llm.shipping import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    rows = brute.near_classes(pairs(docs))
    assert len(rows) == before
    assert materialise(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)).select("doc_id").distinct().count() == before


def _segmentations(sampler, word):
    """Weight of every segmentation of a word whose characters are all pieces."""
    if not word:
        return {(): 0.0}
    heads = [(sampler.pieces[word[:i]], word[i:]) for i in range(1, len(word) + 1) if word[:i] in sampler.pieces]
    return {(i, *tail): w + v for (i, w), rest in heads for tail, v in _segmentations(sampler, rest).items()}


def test_segmentations_without_replacement_by_enumeration():
    """First and second draws against the exact law over all segmentations, by words and whole."""
    sampler = subword_sampling.Sampler(tokenizer_path("piece_bpe_32k.model"))
    for split in (sampler.split, lambda s: [s]):
        sampler.split = split
        law = {a + b: p + q for a, p in _segmentations(sampler, "▁an").items() for b, q in _segmentations(sampler, "▁of").items()}
        total = sum(map(math.exp, law.values()))
        law = {ids: math.exp(w) / total for ids, w in law.items()}
        first, second, n = Counter(), Counter(), 4000
        for seed in range(n):
            (a, p, _), (b, q, _) = sampler.sample("an of", 2, seed)
            assert a != b and abs(p - math.log(law[tuple(a)])) < 1e-6 and abs(q - math.log(law[tuple(b)])) < 1e-6
            first[tuple(a)] += 1
            second[tuple(b)] += 1
        later = {x: sum(p * law[x] / (1 - p) for y, p in law.items() if y != x) for x in law}
        for seen, exact in ((first, law), (second, later)):
            for x, p in exact.items():
                assert abs(seen[x] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3
        everything = sampler.sample("an of", len(law) + 5, 1)
        assert {tuple(ids) for ids, *_ in everything} == set(law) and all(q == 1 for *_, q in everything)
        long = "antidisestablishmentarianism" * 40 + " é🙂\x07 漢x"
        drawn = sampler.sample(long, 4, 3)
        assert len({tuple(ids) for ids, *_ in drawn}) == 4 and all(sampler.decode(ids) == long for ids, *_ in drawn)
