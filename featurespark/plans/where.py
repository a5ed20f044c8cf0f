"""Guarded free-form ``where`` predicates.

The only raw user SQL a layer query accepts is a single boolean expression. A
list of checks runs before any plan touches data; each check sees what the one
before it let through:

1. the contract's substrings (statement separators, comments, file and URL
   table functions) are refused;
2. Spark's own *expression* parser reads the text, so ``1=1) UNION SELECT ...``
   or ``;`` is a parse error and never a second statement;
3. the unresolved tree is walked. Functions, and inside subqueries plan nodes
   too, must be on an allow-list; what is not listed (``WITH``, inline tables,
   table functions, lateral views, ``java_method``) is refused. Subqueries need
   permission, and every relation they name must be a layer;
4. after analysis the plan is walked again for expressions that call into the
   JVM or into Python code other than the ``ST_*`` functions.

The parse runs with the query session active so that its parser settings
(double-quoted identifiers) apply. Constant spatial predicates yield the box
that a row's extent must meet, so that it can be pushed into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from featurespark.errors import LayerQueryError

# --- fixed values: blocklist of the reference contract (lower-case substrings) ---
FORBIDDEN = (";", "--", "/*", "*/", "read_", "parquet_scan", "glob(",
             "http://", "https://", "file:")
# -----------------------------------------------------------------------------------

# Functions a predicate may call (lower-case). Everything else — reflection,
# file readers, generators, nondeterministic or side-effecting functions — is
# refused before analysis.
ALLOWED_FUNCTIONS = frozenset("""
    abs acos asin atan atan2 ceil ceiling cos exp floor ln log log10 log2 mod
    pi pow power round sign signum sin sqrt tan trunc greatest least
    upper lower ucase lcase trim ltrim rtrim btrim substring substr left right
    length char_length character_length octet_length bit_length position
    locate instr replace concat concat_ws lpad rpad reverse repeat initcap
    starts_with startswith ends_with endswith contains split_part regexp_like
    rlike regexp ascii chr translate
    coalesce nullif ifnull nvl nvl2 if isnull isnotnull isnan nanvl
    date timestamp to_date to_timestamp date_trunc date_part datepart extract
    year quarter month week weekofyear day dayofmonth dayofweek dayofyear
    hour minute second date_add date_sub datediff add_months months_between
    current_date current_timestamp make_date make_timestamp last_day
    between in count sum min max avg any_value
    try_cast try_add try_subtract try_multiply try_divide
    st_area st_length st_perimeter st_distance st_dwithin st_x st_y st_xmin
    st_xmax st_ymin st_ymax st_numpoints st_npoints st_isempty
    st_geometrytype st_centroid st_point st_makeenvelope st_geomfromtext
    st_geomfromgeojson st_geomfromwkb st_contains st_within st_intersects
    st_disjoint st_covers st_coveredby st_asgeojson st_astext
""".split())

# Plan nodes a subquery may consist of.
ALLOWED_NODES = frozenset("""
    Project Filter UnresolvedFilter Aggregate Distinct Sort UnresolvedHaving SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation OneRowRelation$ Join Union Except
    Intersect GlobalLimit LocalLimit Offset
""".split())

_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery"}
_NEVER = {"LateralSubquery", "UnresolvedTableValuedFunction", "FunctionTableSubqueryArgumentExpression"}
_CODE = {"CallMethodViaReflection", "ScalaUDF", "JavaUDF", "StaticInvoke", "Invoke", "ApplyFunctionExpression"}

_PLANS = {"Project", "Filter", "Aggregate", "Sort", "Join", "Distinct", "GlobalLimit", "LocalLimit", "Offset"}

_TOKENS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[^'\"`]+")
_VARCHAR = re.compile(r"\bvarchar\b(?!\s*\()", re.IGNORECASE)


@dataclass
class Guarded:
    """A predicate that passed: its text, the layers its subqueries read, boxes a row's extent must meet."""

    text: str
    relations: list[str] = field(default_factory=list)
    boxes: list[tuple[str, tuple[float, float, float, float]]] = field(default_factory=list)


def rewrite_dialect(where: str) -> str:
    """``VARCHAR`` without a length means ``STRING`` (outside literals/identifiers)."""
    out = []
    for m in _TOKENS.finditer(where):
        piece = m.group(0)
        if piece[0] in "'\"`":
            out.append(piece)
        else:
            out.append(_VARCHAR.sub("STRING", piece))
    return "".join(out)


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


class _Walk:
    """Collects what an unresolved tree refers to, and objects to what it may not hold."""

    def __init__(self, layers: Collection[str] | None):
        self.layers = layers
        self.relations: list[str] = []
        self.objections: list[str] = []

    def expression(self, e) -> None:
        kind = _name(e)
        if kind == "UnresolvedFunction":
            called = ".".join(_seq(e.nameParts())).lower()
            if called not in ALLOWED_FUNCTIONS:
                self.objections.append(f"function not allowed in where: {called}")
        if kind in _NEVER:
            self.objections.append(f"{kind} is not allowed in where")
        elif kind in _SUBQUERIES:
            if self.layers is None:
                self.objections.append("subqueries are not allowed in where")
            else:
                self.plan(e.plan())
        for c in _seq(e.children()):
            self.expression(c)

    def plan(self, p) -> None:
        kind = _name(p)
        if kind not in ALLOWED_NODES:
            self.objections.append(f"plan node not allowed in where: {kind}")
            return
        if kind == "UnresolvedRelation":
            parts = _seq(p.multipartIdentifier())
            if len(parts) == 1 and parts[0] in self.layers:
                self.relations.append(parts[0])
            else:
                self.objections.append(f"relation not allowed in where: {'.'.join(parts)}")
        for e in _seq(p.expressions()):
            self.expression(e)
        for c in _seq(p.children()):
            self.plan(c)


def parse_expression(session: SparkSession, text: str):
    """Parse with ``session`` active (restoring the previous active session)."""
    jvm = session.sparkContext._jvm
    jss = session._jsparkSession
    SS = jvm.org.apache.spark.sql.classic.SparkSession
    prev = SS.getActiveSession()
    SS.setActiveSession(jss)
    try:
        return jss.sessionState().sqlParser().parseExpression(text)
    finally:
        if prev.isDefined():
            SS.setActiveSession(prev.get())
        else:
            SS.clearActiveSession()


def guard_where(session: SparkSession, where: str | None, layers: Collection[str] | None = None) -> Guarded | None:
    """The predicate to apply, or None for no filter; ``LayerQueryError`` outside the contract.

    ``layers``: names that subqueries may read (None: no subqueries).
    """
    if where is None:
        return None
    if any(token in where.lower() for token in FORBIDDEN):
        raise LayerQueryError("where holds text that predicates may not hold (disallowed)")
    text = rewrite_dialect(where)
    try:
        parsed = parse_expression(session, text)
    except Exception as exc:  # py4j wraps ParseException
        raise LayerQueryError(f"invalid query: {_short(exc)}") from None
    walk = _Walk(layers)
    walk.expression(parsed)
    if walk.objections:
        raise LayerQueryError(walk.objections[0])
    return Guarded(f"({text})", sorted(set(walk.relations)), list(_boxes(parsed)))


def check_analyzed(df: DataFrame) -> DataFrame:
    """Refuse a filter whose analysed condition would run foreign code; returns ``df``.

    The condition and the plans of its subqueries are walked, down to the layers (views) they read.
    """
    pending = _seq(df._jdf.queryExecution().analyzed().expressions())
    while pending:
        node = pending.pop()
        kind = _name(node)
        if kind in _CODE or kind == "PythonUDF" and not node.name().lower().startswith("st_"):
            raise LayerQueryError(f"function not allowed in where: {kind}")
        if kind == "View":
            continue
        pending += _seq(node.children())
        if kind in _SUBQUERIES:
            pending.append(node.plan())
        elif kind == "InSubquery":
            pending.append(node.query())
        elif kind in _PLANS:
            pending += _seq(node.expressions())
    return df


# -- boxes of constant spatial predicates -------------------------------------------
_MEETING = {"st_intersects", "st_within", "st_contains", "st_covers", "st_coveredby", "st_dwithin"}


def _boxes(e):
    """``(column, box)`` for each top-level AND term that relates a column to a constant geometry."""
    kind = _name(e)
    if kind == "And":
        for c in _seq(e.children()):
            yield from _boxes(c)
        return
    if kind != "UnresolvedFunction":
        return
    called, args = ".".join(_seq(e.nameParts())).lower(), _seq(e.arguments())
    if called not in _MEETING or len(args) != (3 if called == "st_dwithin" else 2):
        return
    reach = 0.0
    if called == "st_dwithin":
        reach = _number(args[2])
        if reach is None:
            return
    for column, constant in ((args[0], args[1]), (args[1], args[0])):
        if _name(column) == "UnresolvedAttribute":
            box = _constant_box(constant)
            if box is not None:
                x0, y0, x1, y1 = box
                yield _seq(column.nameParts())[-1], (x0 - reach, y0 - reach, x1 + reach, y1 + reach)


def _literal(e):
    if _name(e) == "UnaryMinus":
        value = _literal(e.child())
        return None if value is None else -value
    if _name(e) != "Literal" or e.value() is None:
        return None
    value = e.value()
    return value if isinstance(value, (int, float, str)) else str(value)


def _number(e):
    try:
        return float(_literal(e))
    except (TypeError, ValueError):
        return None


def _constant_box(e):
    from featurespark.functions import stsql

    if _name(e) != "UnresolvedFunction":
        return None
    called, args = ".".join(_seq(e.nameParts())).lower(), _seq(e.arguments())
    try:
        if called == "st_makeenvelope":
            x0, y0, x1, y1 = (_number(a) for a in args)
            return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
        if called == "st_point":
            x, y = (_number(a) for a in args)
            return (x, y, x, y) if None not in (x, y) else None
        if called in ("st_geomfromtext", "st_geomfromgeojson"):
            return stsql.constant_box(called, _literal(args[0]))
    except (TypeError, ValueError):
        return None
    return None


def _short(exc) -> str:
    lines = [x.strip() for x in str(exc).splitlines() if x.strip()]
    return lines[0] if lines else exc.__class__.__name__


__all__ = ["FORBIDDEN", "ALLOWED_FUNCTIONS", "ALLOWED_NODES", "Guarded", "guard_where", "check_analyzed",
           "rewrite_dialect", "parse_expression", "ParseException"]
