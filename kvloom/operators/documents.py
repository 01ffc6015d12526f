"""JSON document collections: find, project, insert, update, upsert and delete.

A collection is a DataFrame ``_id string, doc string`` (JSON text).  Filters compile to columns over
a variant where their paths are static and no array can be in the way; the general rules (arrays
match by any element) run in an Arrow-batched function.  The two agree where both apply.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.errors import Conflict, KvError, LimitError, NotFound
from kvloom.shipping import ship

MAX_ID, MAX_DEPTH = 900, 4
RESERVED = ("GRD_", "GM_SYS_")
_MISSING = object()


def collection_name(name: str) -> str:
    """Names ignore case; some prefixes are reserved."""
    lower = name.lower()
    if not name or any(lower.startswith(p.lower()) for p in RESERVED):
        raise KvError(f"bad collection name {name!r}")
    return lower


def _depth(value) -> int:
    if isinstance(value, dict):
        return 1 + max(map(_depth, value.values()), default=0)
    if isinstance(value, list):
        return 1 + max(map(_depth, value), default=0)
    return 0


def check_document(doc: dict) -> dict:
    if not isinstance(doc, dict) or _depth(doc) > MAX_DEPTH:
        raise LimitError(f"a document is an object of depth {MAX_DEPTH} at most")

    def names(node):
        for k, v in node.items():
            if not k or not all(c.isascii() and (c.isalnum() or c == "_") for c in k) or k[0].isdigit():
                raise KvError(f"bad field name {k!r}")
            if isinstance(v, dict):
                names(v)

    names({k: v for k, v in doc.items() if k != "_id"})
    if "_id" in doc and (not isinstance(doc["_id"], str) or not 0 < len(doc["_id"]) <= MAX_ID):
        raise KvError(f"an _id is a text of 1 to {MAX_ID} characters")
    return doc


# --- matching ----------------------------------------------------------------------------------


def _equal(a, b) -> bool:
    """Values as documents compare them: numbers as doubles, booleans only with booleans."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return type(a) is type(b) and a == b


def _reach(node, parts: list[str]):
    """All values at a path; a step into an array tries its position, then each element."""
    if not parts:
        yield node
        return
    head, rest = parts[0], parts[1:]
    if isinstance(node, dict):
        if head in node:
            yield from _reach(node[head], rest)
    elif isinstance(node, list):
        if head.isdigit() and int(head) < len(node):
            yield from _reach(node[int(head)], rest)
        for item in node:
            if isinstance(item, (dict, list)):
                yield from _reach(item, parts)


def matches(doc: dict, wanted: dict) -> bool:
    """Every member of the filter holds: a dotted name is a path, null also means missing, an array
    matches if it equals the value or holds it."""
    for name, value in wanted.items():
        found = list(_reach(doc, name.split(".")))
        if value is None and not found:
            continue
        if not any(_equal(x, value) or isinstance(x, list) and any(_equal(i, value) for i in x) for x in found):
            return False
    return True


def _static(wanted: dict) -> bool:
    return all(not isinstance(v, (dict, list)) for v in wanted.values())


def native_filter(doc: Column, wanted: dict) -> Column:
    """The filter over documents whose paths hold no arrays."""
    tree, test = F.try_parse_json(doc), F.lit(True)
    for name, value in wanted.items():
        path = "$" + "".join(f".{p}" for p in name.split("."))
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        found = F.try_variant_get(tree, path, kind if value is not None else "variant")
        shape = F.schema_of_variant(F.try_variant_get(tree, path, "variant"))
        if value is None:
            test = test & (found.isNull() | (shape == "VOID"))
            continue
        typed = {"boolean": shape == "BOOLEAN", "string": shape == "STRING", "double": ~shape.isin("STRING", "BOOLEAN", "VOID")}[kind]
        test = test & F.coalesce(typed & (found == F.lit(float(value) if kind == "double" else value)), F.lit(False))
    return test


def match(docs: DataFrame, wanted: dict, *, arrays: bool = True) -> DataFrame:
    """Documents that a filter selects.  ``arrays=False`` promises that no array is on its paths,
    which keeps the filter native; an ``_id`` is tested before anything else."""
    wanted = dict(wanted)
    if "_id" in wanted:
        docs = docs.where(F.col("_id") == wanted.pop("_id"))
    if not wanted:
        return docs
    if not arrays and _static(wanted):
        return docs.where(native_filter(F.col("doc"), wanted))
    if _static(wanted):
        # A document with a match holds every wanted text and name somewhere: a cheap native test first.
        for name, value in wanted.items():
            if value is not None:
                docs = docs.where(F.contains("doc", F.lit('"' + name.split(".")[-1] + '"')) | F.lit(name.split(".")[-1].isdigit()))

    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and matches(json.loads(t), wanted))

    return docs.where(test("doc"))


# --- projection --------------------------------------------------------------------------------


def polarity(shape: dict) -> tuple[bool, list[list[str]]]:
    """Whether a projection includes or excludes, and its paths; mixing both is an error."""
    found: list[tuple[list[str], bool]] = []

    def walk(node, at):
        for name, value in node.items():
            path = [*at, *name.split(".")]
            if isinstance(value, dict) and value:
                walk(value, path)
            else:
                found.append((path, value not in (False, 0)))

    walk(shape, [])
    if len({keep for _, keep in found}) > 1:
        raise KvError("a projection either includes or excludes")
    return (found[0][1] if found else False), [p for p, _ in found]


def _include(node, paths):
    if not isinstance(node, dict):
        return _MISSING
    out = {}
    for name, value in node.items():
        mine = [p[1:] for p in paths if p[0] == name]
        if any(not p for p in mine):
            out[name] = value
        elif mine and (inner := _include(value, mine)) is not _MISSING:
            out[name] = inner
    return out


def _exclude(node, paths):
    if not isinstance(node, dict):
        return node
    out = {}
    for name, value in node.items():
        mine = [p[1:] for p in paths if p[0] == name]
        if not any(not p for p in mine):
            out[name] = _exclude(value, mine) if mine else value
    return out


def project(docs: DataFrame, shape: dict, *, show_id: bool = False) -> DataFrame:
    """``doc`` cut to a projection; ``_id`` appears in it only when asked for."""
    include, paths = polarity(shape)
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(i, t):
            doc = json.loads(t)
            doc.pop("_id", None)
            doc = (_include(doc, paths) if include else _exclude(doc, paths)) if paths else doc
            return json.dumps({"_id": i, **doc} if show_id else doc, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(i, t) for i, t in zip(ids, texts)])

    return docs.select("_id", cut("_id", "doc").alias("doc"))


def project_native(docs: DataFrame, paths: list[str]) -> DataFrame:
    """Chosen top-level or nested fields as text columns, without Python."""
    tree = F.try_parse_json("doc")
    return docs.select("_id", *[F.try_variant_get(tree, f"$.{p}", "string").alias(p.replace(".", "_")) for p in paths])


def find(docs: DataFrame, wanted: dict, shape: dict | None = None, *, show_id: bool = False, arrays: bool = True) -> DataFrame:
    """Matching documents in order of ``_id``, projected."""
    found = match(docs, wanted, arrays=arrays).orderBy("_id")
    return found if shape is None else project(found, shape, show_id=show_id)


# --- changes -----------------------------------------------------------------------------------


def insert(docs: DataFrame, new: list[dict]) -> DataFrame:
    """The collection with new documents; an ``_id`` that is there already is a conflict."""
    rows = []
    for doc in new:
        check_document(doc)
        body = {"_id": doc.get("_id") or uuid.uuid4().hex, **{k: v for k, v in doc.items() if k != "_id"}}
        rows.append((body["_id"], json.dumps(body, ensure_ascii=False, separators=(",", ":"))))
    if len({i for i, _ in rows}) < len(rows):
        raise Conflict("an _id comes twice")
    fresh = docs.sparkSession.createDataFrame(rows, "_id string, doc string")
    if not docs.where(F.col("_id").isin([i for i, _ in rows])).isEmpty():
        raise Conflict("an _id is there already")
    return docs.select("_id", "doc").unionByName(fresh)


def first_match(docs: DataFrame, wanted: dict, *, arrays: bool = True) -> DataFrame:
    """``_id`` of the first match, which is the one that changes touch."""
    return match(docs, wanted, arrays=arrays).agg(F.min("_id").alias("_id"))


def set_path(doc: dict, name: str, value, *, replace: bool) -> None:
    """Overwrites what is at a path whole, or adds it; in replace mode it must be there."""
    parts, node = name.split("."), doc
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if isinstance(node, list) and part.isdigit() and int(part) < len(node):
            part = int(part)
        elif not isinstance(node, dict):
            raise Conflict(f"{name!r} leads through a plain value")
        elif part not in node:
            if replace:
                raise NotFound(f"nothing at {name!r}")
            node[part] = {} if not last else None
        if last:
            node[part] = value
        else:
            node = node[part]


def update(docs: DataFrame, wanted: dict, values: dict, *, replace: bool = False) -> tuple[DataFrame, int]:
    """The collection after an update of the first match, and how many documents changed (0, 1)."""
    if "_id" in values:
        raise KvError("an _id does not change")
    target = first_match(docs, wanted).first()["_id"]
    if target is None:
        return docs, 0
    doc = json.loads(docs.where(F.col("_id") == target).first()["doc"])
    for name, value in values.items():
        set_path(doc, name, value, replace=replace)
    check_document(doc)
    text = json.dumps(doc, ensure_ascii=False, separators=(",", ":"))
    return docs.withColumn("doc", F.when(F.col("_id") == target, text).otherwise(F.col("doc"))), 1


def upsert(docs: DataFrame, wanted: dict, doc: dict, *, replace: bool = False) -> tuple[DataFrame, int]:
    """Updates the first match or inserts; an ``_id`` in the filter names the document, and one
    that is there but does not match the rest is a conflict."""
    target = first_match(docs, wanted).first()["_id"]
    if target is not None:
        if replace:
            text = json.dumps({"_id": target, **doc}, ensure_ascii=False, separators=(",", ":"))
            check_document(doc)
            return docs.withColumn("doc", F.when(F.col("_id") == target, text).otherwise(F.col("doc"))), 1
        return update(docs, {"_id": target}, doc)
    if "_id" in wanted and not docs.where(F.col("_id") == wanted["_id"]).isEmpty():
        raise Conflict("the _id belongs to a document that does not match")
    return insert(docs, [{**({"_id": wanted["_id"]} if "_id" in wanted else {}), **doc}]), 1


def delete(docs: DataFrame, wanted: dict) -> tuple[DataFrame, int]:
    """The collection without the first match; no match is an error."""
    target = first_match(docs, wanted).first()["_id"]
    if target is None:
        raise NotFound("no document matches")
    return docs.where(F.col("_id") != target), 1


def delete_first(docs: DataFrame, wanted: dict, *, arrays: bool = True) -> DataFrame:
    """As ``delete`` in one plan, without an error."""
    return docs.join(first_match(docs, wanted, arrays=arrays), "_id", "left_anti")


def set_first(docs: DataFrame, wanted: dict, column: Column, *, arrays: bool = True) -> DataFrame:
    """``doc`` of the first match becomes ``column``, in one plan."""
    marked = docs.join(F.broadcast(first_match(docs, wanted, arrays=arrays).withColumn("__hit", F.lit(True))), "_id", "left")
    return marked.select("_id", F.when(F.col("__hit"), column).otherwise(F.col("doc")).alias("doc"))
