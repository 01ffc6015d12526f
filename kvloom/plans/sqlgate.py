"""SQL for callers: bound arguments, and a gate that lets only queries through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvloom.errors import LimitError, NotSupported

MAX_ARGS = 100
MAX_TEXT = 1 << 20
MAX_RESULT = 4 << 20
#: Plan nodes of a statement that only reads.
_COMMANDS = ("Command", "InsertInto", "CreateTable", "CreateView", "DropTable", "SetCatalog", "CacheTable", "DeleteFrom", "UpdateTable", "MergeInto")

#: Functions that another party may call; none reads files, the session or the host.
FUNCTIONS = frozenset(
    "abs avg between cast ceil ceiling char_length coalesce concat concat_ws count date_add date_format date_sub date_trunc day dense_rank exp first floor greatest hex if ifnull instr isnotnull isnull lag last "
    "lead least length ln log lower lpad ltrim max max_by mean min min_by month nullif nvl octet_length power rank regexp_extract regexp_replace replace round row_number rpad rtrim sign sqrt stddev "
    "substr substring sum to_date trim unhex upper variance year not and or in like".split()
)


def execute(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """A statement with bound arguments."""
    _limits(sql, args)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def _limits(sql: str, args) -> None:
    if len(sql.encode()) > MAX_TEXT:
        raise LimitError("the statement is too long")
    if args is not None and len(args) > MAX_ARGS:
        raise LimitError(f"at most {MAX_ARGS} arguments")


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def inspect(spark: SparkSession, sql: str) -> tuple[set[str], set[str], set[str]]:
    """Kinds of plan nodes, tables and functions of a statement, by its parsed plan; nothing is run.
    Names that the statement defines itself are no tables."""
    nodes, tables, functions, own = set(), set(), set(), set()
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        nodes.add(kind)
        if kind == "UnresolvedWith":
            for named in _each(node.cteRelations()):
                own.add(named._1().lower())
                todo.append(named._2())
        elif kind == "UnresolvedRelation":
            tables.add(".".join(_each(node.multipartIdentifier())))
        elif kind == "UnresolvedFunction":
            functions.add(".".join(_each(node.nameParts())).lower())
        if hasattr(node, "expressions") and "logical" in node.getClass().getName() or kind.startswith("Unresolved") and kind != "UnresolvedFunction":
            try:
                todo += _each(node.expressions())
            except Exception:  # noqa: BLE001  an expression, not a plan node
                pass
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
            todo.append(node.query() if kind == "InSubquery" else node.plan())
        todo += _each(node.children())
    return nodes, {t for t in tables if t.lower() not in own}, functions


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a statement only reads."""
    return not any(any(c in n for c in _COMMANDS) for n in inspect(spark, sql)[0])


def remote_query(spark: SparkSession, sql: str, args: list[str] | None = None) -> DataFrame:
    """A query of another party: reads registered tables only, by listed functions, text arguments,
    a result of at most ``MAX_RESULT`` bytes."""
    _limits(sql, args)
    nodes, tables, functions = inspect(spark, sql)
    if any(any(c in n for c in (*_COMMANDS, "TableValuedFunction", "ScriptTransform")) for n in nodes):
        raise NotSupported("only queries of tables are allowed")
    if strange := [t for t in tables if "." in t or not spark.catalog.tableExists(t)]:
        raise NotSupported(f"no such tables: {strange}")
    if strange := functions - FUNCTIONS:
        raise NotSupported(f"functions that are not allowed: {sorted(strange)}")
    rows = execute(spark, sql, [str(a) for a in args] if args else None)
    if not fits(rows):
        raise LimitError(f"the result has more than {MAX_RESULT} bytes")
    return rows


def fits(rows: DataFrame) -> bool:
    """Whether a result is within the size that is sent back at once; counted where the rows are."""
    from pyspark.sql import functions as F

    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0)).alias("n")).first()["n"]
    return size <= MAX_RESULT
