"""The query grammar, its text form and identity; and the semantic traps of the compiler."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvloom.errors import KvError, LimitError, QueryFieldError, QueryFormatError
from kvloom.plans import compiler
from kvloom.plans.query import Query, path_of, validate


def bad(query, **options):
    with pytest.raises(KvError):
        validate(query, **options)


def test_linkers():
    bad(Query().and_().equal_to("a", 1))
    bad(Query().equal_to("a", 1).or_())
    bad(Query().equal_to("a", 1).equal_to("b", 2))
    bad(Query().equal_to("a", 1).and_().or_().equal_to("b", 2))
    validate(Query().equal_to("a", 1).and_().equal_to("b", 2))


def test_groups():
    bad(Query().begin_group().equal_to("a", 1))
    bad(Query().equal_to("a", 1).end_group())
    bad(Query().begin_group().end_group())
    validate(Query().begin_group().equal_to("a", 1).or_().is_null("b").end_group().and_().is_not_null("c"))


def test_shape():
    bad(Query().limit(1).equal_to("a", 1))
    bad(Query().limit(1).limit(2))
    bad(Query().suggest_index("i").limit(1))
    bad(Query().order_by("a").equal_to("a", 1))
    bad(Query().order_by_write_time().order_by("a"))
    validate(Query().equal_to("a", 1).order_by("a").limit(3, 1).suggest_index("i"))


def test_keys():
    bad(Query().prefix_key("a").prefix_key("b"))
    bad(Query().in_keys([]))
    bad(Query().in_keys([b"k"] * 129))
    bad(Query().range("a", "b").equal_to("a", 1))
    bad(Query().range("a", "b"), sync=True)
    with pytest.raises(LimitError):
        Query().prefix_key("x" * 1025)


def test_values():
    bad(Query().greater_than("a", True))
    bad(Query().in_("a", range(129)))
    bad(Query().in_("a", range(101)), cloud=True)
    bad(Query().equal_to("a.b.c.d.e", 1))
    bad(Query().equal_to("1a", 1))
    bad(Query().equal_to("a", 1), has_schema=False)
    assert path_of("$.a.b") == path_of("a.b") == ("a", "b")
    with pytest.raises(QueryFieldError):
        path_of("a..b")


def test_count_takes_no_limit():
    for q in (Query().limit(1), Query().order_by("a"), Query().order_by_write_time()):
        bad(q, count=True)


def test_nodes():
    q = Query().equal_to("a", 0)
    for i in range(128):
        q = q.or_().equal_to("a", i)
    bad(q)


def test_cloud_rejects_repeats():
    q = Query().equal_to("a", 1).and_().equal_to("a", 1)
    validate(q, cloud=True)
    bad(Query().begin_group().begin_group().equal_to("a", 1).end_group().end_group(), cloud=True)


def test_identity_ignores_shape():
    q = Query().equal_to("a", 1)
    assert q.identity() == q.order_by("a").limit(5).suggest_index("i").identity()
    assert q.identity() != Query().equal_to("a", 2).identity()
    assert Query().equal_to("a", 1).identity() != Query().equal_to("a", 1.0).identity()


def test_tables():
    q = Query().from_("a").equal_to("x", 1).from_("b").is_null("y")
    assert {t: len(p.nodes) for t, p in q.by_table().items()} == {"a": 1, "b": 1}
    assert list(Query().from_tables(["a", "b", "a"]).by_table()) == ["a", "b"]
    with pytest.raises(QueryFormatError):
        Query().equal_to("x", 1).from_("a")


literals = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8))


@given(st.lists(st.tuples(st.sampled_from(["equal_to", "not_equal_to", "like"]), literals), max_size=5), st.binary(max_size=9))
def test_text_form_round_trip(steps, key):
    q = Query.select("t").prefix_key(key)
    for name, value in steps:
        q = getattr(q, name)("f", value)
    again = Query.from_json(q.to_json())
    assert again == q and again.identity() == q.identity()


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, "ABC", 1.0), (2, "a_c", None), (3, "a\\c", 3.0), (4, None, 4.0), (5, "äB", 0.0), (6, "a%c", -1.0)]
    return spark.createDataFrame(rows, "id int, s string, v double").persist()


def found(df, q):
    return sorted(r["id"] for r in compiler.run(df, q).collect())


def test_like_has_no_escape_and_folds_ascii_only(words):
    assert found(words, Query().like("s", "a_C")) == [1, 2, 3, 6]
    assert found(words, Query().like("s", "a\\%")) == [3]
    assert found(words, Query().like("s", "Äb")) == []
    assert found(words, Query().like("s", "äb")) == [5]


def test_nulls_drop_out_of_negations(words):
    assert found(words, Query().not_like("s", "zzz")) == [1, 2, 3, 5, 6]
    assert found(words, Query().not_equal_to("v", 3)) == [1, 4, 5, 6]
    assert found(words, Query().not_in("v", [3, 4])) == [1, 5, 6]


def test_nulls_are_smallest(words):
    ids = [r["id"] for r in compiler.run(words, Query().order_by("v").limit(2)).collect()]
    assert ids == [2, 6]
    assert [r["id"] for r in compiler.run(words, Query().order_by("v", False).limit(6)).collect()][-1] == 2


def test_negative_limit_is_none(words):
    assert compiler.run(words, Query().limit(-1)).count() == 6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([">", "<", "="]), min_size=1, max_size=4), st.lists(st.sampled_from(["and", "or"]), min_size=3, max_size=3), st.lists(st.integers(-2, 4), min_size=4, max_size=4))
def test_precedence(words, ops, links, values):
    q, text = Query(), ""
    for i, op in enumerate(ops):
        if i:
            q, text = (q.and_(), text + " and ") if links[i - 1] == "and" else (q.or_(), text + " or ")
        q = getattr(q, {">": "greater_than", "<": "less_than", "=": "equal_to"}[op])("v", values[i])
        text += f"v {op} {values[i]}"
    assert found(words, q) == sorted(r["id"] for r in words.where(F.expr(text)).collect())


def test_key_prefix_with_high_bytes(spark):
    keys = [b"a", b"a\xff", b"a\xff\xff\x01", b"b", b"\xff\xff", b""]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for prefix in (b"", b"a", b"a\xff", b"\xff", b"\xff\xff"):
        got = sorted(bytes(r["key"]) for r in df.where(compiler.starts_with(F.col("key"), prefix)).collect())
        assert got == sorted(k for k in keys if k.startswith(prefix))
