"""A graph query language compiled to DataFrame plans.

    MATCH [p =] (a:Label {k: lit})-[r:T1|T2 *1..3]->(b) WHERE expr
    RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n]

Text is cut into tokens, parsed by recursive descent and compiled: one join per
hop, so that Catalyst chooses the strategy and pushes WHERE below the joins.
Quantified hops are unrolled to their bound (8 where none is given).

Semantics: conditions are two-valued (``=`` and ``<>`` compare nulls as values; an ordering or string
test with a null or another type is false); a hop never returns to an end point of an earlier
hop nor, within a quantified hop, to a node of the same hop; ``count`` counts bindings, and
gives no row where nothing matched; rows have a total order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analytics import cut

MAX_ROWS = 10_000
MAX_HOPS = 8
KEYWORDS = {
    "MATCH", "WHERE", "RETURN", "DISTINCT", "ORDER", "BY", "ASC", "DESC", "SKIP", "LIMIT", "AND", "OR", "NOT", "CONTAINS", "STARTS", "ENDS", "WITH", "IN", "AS", "TRUE", "FALSE", "NULL",
}
FUNCTIONS = {"type", "count", "labels", "id"}
_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<number>\d+\.\d+|\d+)|(?P<word>[A-Za-z_]\w*)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<sign><>|<=|>=|<-|->|\.\.|[()\[\]{}:|,.=<>*+-])"""
)


class GQLError(ValueError):
    """A query that can't be read or refers to something unknown; ``position`` is where."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} at position {position}")
        self.position = position


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int
    raw: str = ""


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise GQLError(f"unexpected {text[at]!r}", at)
        kind, value = m.lastgroup or "", m.group()
        if kind == "string":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e.group(1), e.group(1)), value[1:-1])
        elif kind == "word" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        if kind != "space":
            out.append(Token(kind, value, at, m.group()))
        at = m.end()
    return [*out, Token("end", "", at)]


@dataclass
class NodeStep:
    var: str | None
    labels: list[str]
    props: dict[str, Any]


@dataclass
class RelStep:
    var: str | None
    types: list[str]
    direction: str
    least: int = 1
    most: int = 1


@dataclass
class Query:
    nodes: list[NodeStep]
    rels: list[RelStep]
    path: str | None
    where: Any
    items: list[tuple[Any, str]]
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None


class Parser:
    """Expressions are tuples: ``("lit", v)``, ``("prop", var, key)``, ``("var", v)``, ``("call", f, arg)``,
    ``("cmp", op, a, b)``, ``("and"|"or", [..])``, ``("not", x)``."""

    def __init__(self, text: str):
        self.tokens, self.i = lex(text), 0

    def peek(self, *values: str) -> bool:
        t = self.tokens[self.i]
        return t.kind in ("keyword", "sign") and t.value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.i += 1
            return self.tokens[self.i - 1].value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            t = self.tokens[self.i]
            raise GQLError(f"expected {value!r}, found {t.value or 'the end'!r}", t.at)

    def word(self, any_word: bool = False) -> str:
        """A name; a label, type or key may also be spelled like a keyword."""
        t = self.tokens[self.i]
        if t.kind != "word" and not (any_word and t.kind == "keyword"):
            raise GQLError(f"expected a name, found {t.value or 'the end'!r}", t.at)
        self.i += 1
        return t.raw

    def number(self) -> int:
        t = self.tokens[self.i]
        if t.kind != "number" or "." in t.value:
            raise GQLError("expected a whole number", t.at)
        self.i += 1
        return int(t.value)

    def query(self) -> Query:
        self.need("MATCH")
        path = None
        if self.tokens[self.i].kind == "word":
            path = self.word()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.peek("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        where = self.disjunction() if self.take("WHERE") else None
        self.need("RETURN")
        q = Query(nodes, rels, path, where, [], bool(self.take("DISTINCT")))
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                q.order.append((column_name(self.operand()), self.take("ASC", "DESC") == "DESC"))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            q.skip = self.number()
        if self.take("LIMIT"):
            q.limit = self.number()
        t = self.tokens[self.i]
        if t.kind != "end":
            raise GQLError(f"unexpected {t.value!r}", t.at)
        return q

    def node(self) -> NodeStep:
        self.need("(")
        step = NodeStep(self.word() if self.tokens[self.i].kind == "word" else None, [], {})
        while self.take(":"):
            step.labels.append(self.word(True))
        if self.take("{"):
            while True:
                key = self.word(True)
                self.need(":")
                step.props[key] = self.literal()[1]
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return step

    def rel(self) -> RelStep:
        at, left = self.tokens[self.i].at, self.take("-", "<-")
        step = RelStep(None, [], "both")
        if self.take("["):
            if self.tokens[self.i].kind == "word":
                step.var = self.word()
            if self.take(":"):
                step.types.append(self.word(True))
                while self.take("|"):
                    step.types.append(self.word(True))
            if self.take("*"):
                step.least, step.most = 1, MAX_HOPS
                if self.tokens[self.i].kind == "number":
                    step.least = step.most = self.number()
                    if self.peek(".."):
                        step.most = MAX_HOPS
                if self.take("..") and self.tokens[self.i].kind == "number":
                    step.most = self.number()
            self.need("]")
        right = self.take("-", "->")
        if not right:
            raise GQLError("expected '-' or '->'", self.tokens[self.i].at)
        if left == "<-" and right == "->":
            raise GQLError("a relationship has one direction", at)
        if step.least > step.most or step.least < 1:
            raise GQLError("a quantifier needs 1 <= least <= most", at)
        step.direction = "in" if left == "<-" else "out" if right == "->" else "both"
        return step

    def disjunction(self) -> Any:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def conjunction(self) -> Any:
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negation(self) -> Any:
        if self.take("NOT"):
            return ("not", self.negation())
        if self.take("("):
            inner = self.disjunction()
            self.need(")")
            return inner
        left = self.operand()
        op = self.take("=", "<>", "<", "<=", ">", ">=", "CONTAINS", "IN", "STARTS", "ENDS")
        if not op:
            raise GQLError("expected a comparison", self.tokens[self.i].at)
        if op in ("STARTS", "ENDS"):
            self.need("WITH")
        return ("cmp", op, left, self.operand())

    def literal(self) -> tuple[str, Any]:
        t = self.tokens[self.i]
        if t.kind == "string":
            self.i += 1
            return ("lit", t.value)
        if t.kind == "keyword" and t.value in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[t.value])
        sign = -1 if self.take("-") else 1
        self.take("+")
        t = self.tokens[self.i]
        if t.kind != "number":
            raise GQLError("expected a literal", t.at)
        self.i += 1
        return ("lit", sign * (float(t.value) if "." in t.value else int(t.value)))

    def operand(self) -> tuple:
        t = self.tokens[self.i]
        if t.kind != "word":
            return self.literal()
        name = self.word()
        if self.take("("):
            if name.lower() not in FUNCTIONS:
                raise GQLError(f"unknown function {name!r}", t.at)
            arg = None if self.take("*") else self.word()
            self.need(")")
            return ("call", name.lower(), arg)
        return ("prop", name, self.word(True)) if self.take(".") else ("var", name)

    def item(self) -> tuple[Any, str]:
        expr = self.operand()
        return expr, self.word() if self.take("AS") else column_name(expr)


def column_name(expr: tuple) -> str:
    match expr:
        case ("prop", var, key):
            return f"{var}.{key}"
        case ("call", name, arg):
            return f"{name}({arg or '*'})"
        case _:
            return str(expr[1])


def parse(text: str) -> Query:
    return Parser(text).query()


class Compiler:
    """Compiles over ``nodes(node_id, labels, ...)`` and ``edges(edge_id, subject, predicate, object, confidence, ...)``;
    further columns, and keys of a ``props`` map, are properties."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def compile(self, q: Query) -> DataFrame:
        self._bind(q)
        frame = self._match(q)
        if q.where is not None:
            frame = frame.filter(self._truth(q.where, frame))
        return self._project(q, frame)

    # Columns of a binding: n<i>__<column> for nodes, r<i>__<column> (of the last edge) and
    # r<i>__ids for relationships, ends: the end points so far.

    def _bind(self, q: Query) -> None:
        self.vars: dict[str, str] = {}
        for i, n in enumerate(q.nodes):
            if n.var:
                self.vars.setdefault(n.var, f"n{i}")
        for i, r in enumerate(q.rels):
            if r.var:
                self.vars.setdefault(r.var, f"r{i}")
        if q.path:
            self.vars[q.path] = "path"
        used: set[str] = set()

        def walk(e: Any) -> None:
            match e:
                case ("prop", var, _) | ("var", var):
                    used.add(var)
                case ("call", _, arg):
                    used.update([arg] if arg else [])
                case ("cmp", _, a, b):
                    walk(a), walk(b)
                case ("and" | "or", parts):
                    [walk(x) for x in parts]
                case ("not", x):
                    walk(x)

        for e in [q.where, *(e for e, _ in q.items)]:
            walk(e)
        if unknown := sorted(used - set(self.vars)):
            raise GQLError(f"variables that the pattern doesn't bind: {', '.join(unknown)}")

    def _node(self, step: NodeStep, i: int) -> DataFrame:
        frame = self.nodes
        for label in step.labels:
            frame = frame.filter(F.array_contains("labels", label))
        for key, value in step.props.items():
            frame = frame.filter(self._equal(self._property(frame, "", key), F.lit(value), value))
        return frame.select(*(F.col(c).alias(f"n{i}__{c}") for c in frame.columns))

    def _edge(self, step: RelStep) -> DataFrame:
        frame = self.edges.filter(F.col("predicate").isin(step.types)) if step.types else self.edges
        out = frame.withColumns({"from": F.col("subject"), "to": F.col("object")})
        back = frame.withColumns({"from": F.col("object"), "to": F.col("subject")})
        return out if step.direction == "out" else back if step.direction == "in" else out.unionByName(back)

    def _match(self, q: Query) -> DataFrame:
        return self._walk(q) if q.path or any(r.most > 1 for r in q.rels) else self._chain(q)

    def _chain(self, q: Query) -> DataFrame:
        """A pattern of single steps, from the end that is told apart most: joins on ids, no arrays."""
        order = list(range(len(q.rels)))
        back = self._told_apart(q, q.nodes[-1]) > self._told_apart(q, q.nodes[0])
        at = len(order) if back else 0
        order = order[::-1] if back else order
        frame, bound = self._node(q.nodes[at], at), [at]
        for i in order:
            edge = self._edge(q.rels[i])
            here = at
            at = i + 1 if at == i else i
            near, far = ("from", "to") if here == i else ("to", "from")
            hop = edge.select(F.col(near).alias("near"), F.col(far).alias("far"), *(F.col(c).alias(f"r{i}__{c}") for c in edge.columns if c not in ("from", "to")))
            frame = frame.join(hop, frame[f"n{here}__node_id"] == hop["near"])
            for n in bound:  # no node twice
                frame = frame.filter(F.col("far") != F.col(f"n{n}__node_id"))
            node = self._node(q.nodes[at], at)
            frame = frame.join(node, frame["far"] == node[f"n{at}__node_id"]).drop("near", "far")
            bound.append(at)
        for i, n in enumerate(q.nodes):
            if n.var and self.vars[n.var] != f"n{i}":
                frame = frame.filter(F.col(f"{self.vars[n.var]}__node_id") == F.col(f"n{i}__node_id"))
        for i, r in enumerate(q.rels):
            if r.var and self.vars[r.var] != f"r{i}":
                frame = frame.filter(F.col(f"{self.vars[r.var]}__edge_id") == F.col(f"r{i}__edge_id"))
        return frame

    def _told_apart(self, q: Query, node: NodeStep) -> int:
        """How many properties of a node the pattern and the conjuncts of WHERE fix or compare with a literal."""
        parts = q.where[1] if q.where and q.where[0] == "and" else [q.where] if q.where else []
        compared = [e for e in parts if e[0] == "cmp" and e[1] != "<>" and any(x[0] == "prop" and x[1] == node.var for x in e[2:]) and any(x[0] == "lit" for x in e[2:])]
        return len(node.props) + len(compared)

    def _walk(self, q: Query) -> DataFrame:
        """A pattern with quantified steps or a path variable: the end points so far travel along."""
        frame = self._node(q.nodes[0], 0).withColumn("ends", F.array("n0__node_id"))
        if q.path:
            frame = frame.withColumn("names", F.array(self._display(frame, "n0")))
        for i, rel in enumerate(q.rels):
            edge, last = self._edge(rel), f"n{i}__node_id"
            columns = [c for c in edge.columns if c not in ("from", "to")]
            hop = edge.select(F.col("from").alias("hop_from"), F.col("to").alias("hop_to"), *(F.col(c).alias(f"hop_{c}") for c in columns))
            target, found = self._node(q.nodes[i + 1], i + 1), None
            front = frame.withColumns({"at": F.col(last), "seen": F.col("ends"), f"r{i}__ids": F.array().cast("array<string>")})
            for depth in range(1, rel.most + 1):
                front = front.drop(*(f"r{i}__{c}" for c in columns)) if depth > 1 else front
                front = front.join(hop, front["at"] == hop["hop_from"]).filter(~F.array_contains("seen", F.col("hop_to")))
                front = front.withColumns({"at": F.col("hop_to"), "seen": F.array_append("seen", F.col("hop_to")), f"r{i}__ids": F.array_append(f"r{i}__ids", F.col("hop_edge_id"))})
                front = front.withColumnsRenamed({f"hop_{c}": f"r{i}__{c}" for c in columns}).drop("hop_from", "hop_to")
                if 1 < depth < rel.most:
                    front = cut(front)  # each depth is computed once
                if depth >= rel.least:
                    hit = front.join(target, front["at"] == target[f"n{i + 1}__node_id"]).drop("at", "seen")
                    found = hit if found is None else found.unionByName(hit)
            frame = found.withColumn("ends", F.array_append("ends", F.col(f"n{i + 1}__node_id")))
            if q.path:
                frame = frame.withColumn("names", F.array_append("names", self._display(frame, f"n{i + 1}")))
            var, node_var = rel.var, q.nodes[i + 1].var
            if node_var and self.vars[node_var] != f"n{i + 1}":
                frame = frame.filter(F.col(f"{self.vars[node_var]}__node_id") == F.col(f"n{i + 1}__node_id"))
            if var and self.vars[var] != f"r{i}":
                frame = frame.filter(F.col(f"{self.vars[var]}__ids") == F.col(f"r{i}__ids"))
        return frame

    def _display(self, frame: DataFrame, prefix: str) -> Column:
        name = f"{prefix}__name"
        return F.coalesce(F.col(name).cast("string"), F.col(f"{prefix}__node_id")) if name in frame.columns else F.col(f"{prefix}__node_id")

    def _property(self, frame: DataFrame, prefix: str, key: str) -> Column:
        if f"{prefix}{key}" in frame.columns:
            return F.col(f"{prefix}{key}")
        return F.element_at(F.col(f"{prefix}props"), key) if f"{prefix}props" in frame.columns else F.lit(None).cast("string")

    def _value(self, e: tuple, frame: DataFrame) -> Column:
        match e:
            case ("lit", None):
                return F.lit(None).cast("string")
            case ("lit", value):
                return F.lit(value)
            case ("prop", var, key):
                at = self.vars[var]
                return F.lit(None).cast("string") if at == "path" else self._property(frame, f"{at}__", key)
            case ("var", var):
                at = self.vars[var]
                return F.col("names") if at == "path" else F.col(f"{at}__predicate") if at[0] == "r" else self._display(frame, at)
            case ("call", "type", arg) if arg and self.vars[arg][0] == "r":
                return F.col(f"{self.vars[arg]}__predicate")
            case ("call", "id", arg) if arg and self.vars[arg][0] == "n":
                return F.col(f"{self.vars[arg]}__node_id")
            case ("call", "labels", arg) if arg and self.vars[arg][0] == "n":
                return F.col(f"{self.vars[arg]}__labels")
            case _:
                return F.lit(None).cast("string")

    def _kind(self, frame: DataFrame, c: Column) -> str:
        kind = frame.select(c.alias("x")).schema["x"].dataType
        if isinstance(kind, T.NumericType):
            return "number"
        return {T.StringType: "string", T.BooleanType: "bool", T.ArrayType: "array"}.get(type(kind), kind.simpleString())

    @staticmethod
    def _equal(left: Column, right: Column, value: Any) -> Column:
        return left.eqNullSafe(right if value is not None else F.lit(None))

    def _truth(self, e: Any, frame: DataFrame) -> Column:
        match e:
            case ("and", parts):
                out = F.lit(True)
                for p in parts:
                    out = out & self._truth(p, frame)
                return out
            case ("or", parts):
                out = F.lit(False)
                for p in parts:
                    out = out | self._truth(p, frame)
                return out
            case ("not", x):
                return ~self._truth(x, frame)
        _, op, a, b = e
        left, right = self._value(a, frame), self._value(b, frame)
        kinds = self._kind(frame, left), self._kind(frame, right)
        null = ("lit", None) in (a, b)
        false = F.lit(False)
        if op in ("=", "<>"):
            same = left.eqNullSafe(right) if kinds[0] == kinds[1] or null else left.isNull() & right.isNull()
            return same if op == "=" else ~same
        if op == "IN":
            return F.coalesce(F.array_contains(right, left), false) if kinds[1] == "array" else false
        if op in ("CONTAINS", "STARTS", "ENDS"):
            if kinds != ("string", "string"):
                return false
            test = {"CONTAINS": left.contains, "STARTS": left.startswith, "ENDS": left.endswith}[op](right)
            return F.coalesce(test, false)
        if kinds[0] != kinds[1] or null:
            return false
        return F.coalesce({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], false)

    def _project(self, q: Query, frame: DataFrame) -> DataFrame:
        names = [name for _, name in q.items]
        if unknown := [k for k, _ in q.order if k not in names and k not in [column_name(e) for e, _ in q.items]]:
            raise GQLError(f"ORDER BY {unknown[0]!r} isn't in the RETURN list")
        counts = [name for e, name in q.items if e[:2] == ("call", "count")]
        values = [self._value(e, frame).alias(name) for e, name in q.items if e[:2] != ("call", "count")]
        if counts:
            keys = [F.col(f"`{name}`") for e, name in q.items if e[:2] != ("call", "count")]
            grouped = frame.select(*values, F.lit(1).alias("__one")).groupBy(*keys).agg(F.count("__one").alias("__n")).filter("__n > 0")
            out = grouped.select(*(F.col("__n").alias(n) if n in counts else F.col(f"`{n}`") for n in names))
        else:
            out = frame.select(*values)
        if q.distinct:
            out = out.distinct()
        if q.order or q.skip or q.limit is not None:
            by_name = {column_name(e): name for e, name in q.items}
            keys = [F.col(f"`{by_name.get(k, k)}`") for k, _ in q.order]
            order = [k.desc_nulls_last() if down else k.asc_nulls_first() for k, (_, down) in zip(keys, q.order, strict=True)]
            out = out.orderBy(*order, *(F.col(f"`{n}`").asc_nulls_first() for n in names))
            out = out.offset(q.skip) if q.skip else out
            out = out.limit(q.limit) if q.limit is not None else out
        return out


def run(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return Compiler(nodes, edges).compile(parse(text))


def run_capped(text: str, nodes: DataFrame, edges: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """At most ``most`` rows, the first in the order that the query asks for, else by all columns; ``truncated`` tells
    whether there are more."""
    q = parse(text)
    out = Compiler(nodes, edges).compile(q)
    columns = out.columns
    if not q.order:
        out = out.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in columns))
    some = out.limit(most + 1).select("*", F.monotonically_increasing_id().alias("__at"))
    some = some.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > most)  # over most + 1 rows at most
    return some.orderBy("__at").limit(most).drop("__at")
