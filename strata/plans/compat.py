"""A small SELECT over tables of strings, with the comparisons and aggregates that such tables need.

Cells compare as numbers if both sides read as numbers, else as strings, equality
regardless of case. Anything beyond the subset raises; it isn't guessed at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import is_number, number
from strata.plans.guard import check_text

TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark>>=|<=|!=|<>|[=<>(),*]))")
FUNCTIONS = {"count", "sum", "avg", "min", "max"}
KEYWORDS = {"select", "from", "where", "and", "group", "order", "by", "limit", "as", "asc", "desc", "or", "not", "having", "distinct", "join", "offset", "union", "in", "like", "between", "is"}
ROW = "_strata_row"


class Unsupported(ValueError):
    """A query beyond the subset."""


@dataclass
class Item:
    column: str
    function: str = ""
    label: str = ""


@dataclass
class Select:
    items: list[Item] = field(default_factory=list)
    table: str = ""
    conditions: list[tuple[str, str, str]] = field(default_factory=list)
    group: str = ""
    order: str = ""
    descending: bool = False
    limit: int = -1


class _Reader:
    def __init__(self, query: str):
        self.query, self.at, self.tokens = query, 0, []
        at = 0
        while query[at:].strip():
            m = TOKEN.match(query, at)
            if not m:
                raise Unsupported(f"unexpected {query[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
            at = m.end()

    def peek(self) -> str:
        return self.tokens[self.at][1].lower() if self.at < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        if [t[1].lower() for t in self.tokens[self.at : self.at + len(words)]] == list(words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise Unsupported(f"expected {' '.join(words)} before {self.peek()!r}")

    def take(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds or self.tokens[self.at][0] == "name" and self.peek() in KEYWORDS:
            raise Unsupported(f"unexpected {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]


def parse(query: str) -> Select:
    """SELECT items FROM table [WHERE c op literal AND ...] [GROUP BY c] [ORDER BY label [ASC|DESC]] [LIMIT n]."""
    r, q = _Reader(check_text(query)), Select()
    r.need("select")
    while True:
        start = r.tokens[r.at][2] if r.at < len(r.tokens) else 0
        if r.word("*"):
            item = Item("*")
        else:
            name = r.take("name")
            item = Item(name)
            if r.word("("):
                if name.lower() not in FUNCTIONS:
                    raise Unsupported(f"unknown function {name}")
                item = Item("*" if r.word("*") else r.take("name"), name.lower())
                r.need(")")
        item.label = r.query[start : r.tokens[r.at - 1][3]].strip()
        if r.word("as"):
            item.label = r.take("name")
        q.items.append(item)
        if not r.word(","):
            break
    r.need("from")
    q.table = r.take("name")
    if r.word("where"):
        while True:
            column = r.take("name")
            operator = r.take("mark")
            if operator not in ("=", "!=", "<>", "<", "<=", ">", ">="):
                raise Unsupported(f"unexpected {operator!r}")
            value = r.take("text", "number")
            q.conditions.append((column, operator, value[1:-1].replace("''", "'") if value[0] == "'" else value))
            if not r.word("and"):
                break
    if r.word("group", "by"):
        q.group = r.take("name")
    if r.word("order", "by"):
        q.order = r.take("name")
        q.descending = r.word("desc")
        if not q.descending:
            r.word("asc")
    if r.word("limit"):
        q.limit = int(r.take("number"))
    if r.at < len(r.tokens):
        raise Unsupported(f"unexpected {r.peek()!r}")
    return q


def compare(cell: Column, operator: str, value: str) -> Column:
    """Whether a cell stands in that relation to a literal."""
    import operator as ops

    by = {"=": ops.eq, "!=": ops.ne, "<>": ops.ne, "<": ops.lt, "<=": ops.le, ">": ops.gt, ">=": ops.ge}[operator]
    as_text = by(F.lower(cell), F.lit(value.lower())) if operator in ("=", "!=", "<>") else by(cell, F.lit(value))
    if not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", value):
        return as_text
    return F.when(is_number(cell), by(number(cell), F.lit(float(value)))).otherwise(as_text)


def shown(x: Column) -> Column:
    """A double as its shortest plain decimal."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), "").when(whole, F.floor(x).cast("string")).otherwise(F.when(x.cast("string").contains("E"), F.regexp_replace(F.format_string("%.17f", x), "0+$", "")).otherwise(x.cast("string")))


def aggregate(item: Item) -> Column:
    """COUNT counts rows; SUM passes over what isn't a number; AVG divides that sum by all rows; MIN and MAX compare as numbers if all cells are."""
    if item.function == "count":
        return F.count(F.lit(1)).cast("string")
    cell = F.col(f"`{item.column}`")
    total = F.coalesce(F.sum(number(cell)), F.lit(0.0))
    if item.function == "sum":
        return shown(total)
    if item.function == "avg":
        return F.when(F.count(F.lit(1)) == 0, "").otherwise(shown(total / F.count(F.lit(1))))
    pick = F.min if item.function == "min" else F.max
    return F.coalesce(F.when(F.bool_and(is_number(cell)), shown(pick(number(cell)))).otherwise(pick(cell)), F.lit(""))


def run(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query over tables of strings, by lower-cased name. A plain column beside aggregates takes its group's first row's value."""
    q = parse(query)
    table = tables.get(q.table.lower())
    if table is None:
        raise Unsupported(f"unknown table {q.table!r}")
    known = {c.lower(): c for c in table.columns}

    def column(name: str) -> str:
        if name.lower() not in known:
            raise Unsupported(f"unknown column {name!r} in table {q.table}")
        return known[name.lower()]

    rows = table.withColumn(ROW, F.monotonically_increasing_id())
    for name, operator, value in q.conditions:
        rows = rows.where(compare(F.col(f"`{column(name)}`"), operator, value))
    items = [Item(i.column if i.column == "*" else column(i.column), i.function, i.label) for i in q.items]
    if q.group or any(i.function for i in items):
        for i in items:
            if not i.function and (i.column == "*" or not q.group):
                raise Unsupported(f"{i.column} has no single value beside aggregates")
            if i.function and i.function != "count" and i.column == "*":
                raise Unsupported(f"{i.function}(*)")
        keys = [F.col(f"`{column(q.group)}`").alias("_strata_key")] if q.group else []
        made = [(aggregate(i) if i.function else F.min_by(f"`{i.column}`", ROW)).alias(f"_strata_{n}") for n, i in enumerate(items)]
        out = rows.groupBy(*keys).agg(*made)
        order = [F.col("_strata_key")] if q.group else []
        out = out.select(*(F.col(f"_strata_{n}").alias(i.label) for n, i in enumerate(items)), *order)
    else:
        wide = [c for i in items for c in ([(f"`{x}`", x) for x in table.columns] if i.column == "*" else [(f"`{i.column}`", i.label)])]
        out, order = rows.select(*(F.col(a).alias(b) for a, b in wide), ROW), [F.col(ROW)]
    labels = [c for c in out.columns if c not in (ROW, "_strata_key")]
    if q.order:
        named = [c for c in labels if c.lower() == q.order.lower()]
        if not named:
            raise Unsupported(f"ORDER BY {q.order} isn't selected")
        cell = F.col(f"`{named[0]}`")
        # Numbers come before other strings, which keeps the order total.
        sort = [is_number(cell).desc(), number(cell), F.when(~is_number(cell), cell)]
        sort = [sort[0], *((c.desc() if q.descending else c.asc()) for c in sort[1:])]
        out = out.orderBy(*sort, *order)
    elif order:
        out = out.orderBy(*order)
    out = out.select(*(F.col(f"`{c}`") for c in labels))
    return out.limit(q.limit) if q.limit >= 0 else out
