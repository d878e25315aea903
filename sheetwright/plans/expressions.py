"""Computed fields as Columns: a whitelist of Python syntax over {field} references, never eval."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .template import REFERENCE, Field, TemplateError


@dataclass(frozen=True)
class Value:
    """A compiled expression: its column, kind (num, int, str, bool, list) and the column that says it failed."""

    column: Column
    kind: str
    error: Column


KIND_OF = {"int": "int", "float": "num", "bool": "bool", "str": "str", "any": "str", "datetime": "str", "date": "str"}


def references(expression: str) -> list[str]:
    """Field names in order of first use."""
    return list(dict.fromkeys(REFERENCE.findall(expression)))


def order(fields: list[Field]) -> list[Field]:
    """Computed fields, each after those it refers to; TemplateError on a cycle."""
    by_name = {f.name: f for f in fields if f.kind == "computed"}
    done: dict[str, Field] = {}
    path: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in path:
            raise TemplateError(f"computed fields depend on each other: {' -> '.join([*path[path.index(name):], name])}")
        path.append(name)
        for ref in references(by_name[name].expression):
            if ref in by_name:
                visit(ref)
        path.pop()
        done[name] = by_name[name]

    for name in by_name:
        visit(name)
    return list(done.values())


def is_interpolation(expression: str) -> bool:
    """Only white space, and some, stands between the references."""
    rest = REFERENCE.sub("", expression)
    return bool(rest) and rest.isspace()


def compile_field(expression: str, kinds: dict[str, str]) -> Value:
    """kinds: by field name num, int, str, bool or list; an unknown name is null, as in a record without it."""
    if is_interpolation(expression):
        parts, at = [], 0
        for m in REFERENCE.finditer(expression):
            parts.append(F.lit(expression[at : m.start()]))
            parts.append(F.coalesce(F.col(m[1]).cast("string"), F.lit("")) if m[1] in kinds else F.lit(""))
            at = m.end()
        return Value(F.concat(*parts, F.lit(expression[at:])), "str", F.lit(False))
    try:
        tree = ast.parse(REFERENCE.sub(lambda m: f"__ref_{m[1]}", expression).strip(), mode="eval")
    except SyntaxError as e:
        raise TemplateError(f"computed expression {expression!r}: {e.msg}") from e
    return _Compiler(expression, kinds).visit(tree.body)


class _Compiler(ast.NodeVisitor):
    def __init__(self, expression: str, kinds: dict[str, str]):
        self.expression, self.kinds = expression, kinds

    def generic_visit(self, node: ast.AST) -> Value:
        raise TemplateError(f"computed expression {self.expression!r}: {type(node).__name__} is not supported")

    def visit_Name(self, node: ast.Name) -> Value:
        if not node.id.startswith("__ref_"):
            return self.generic_visit(node)
        name = node.id.removeprefix("__ref_")
        if name not in self.kinds:
            return Value(F.lit(None).cast("double"), "num", F.lit(False))
        return Value(F.col(name), self.kinds[name], F.lit(False))

    def visit_Constant(self, node: ast.Constant) -> Value:
        kind = {bool: "bool", int: "int", float: "num", str: "str"}.get(type(node.value))
        if kind is None:
            return self.generic_visit(node)
        return Value(F.lit(node.value).cast({"int": "bigint", "num": "double"}[kind]) if kind in ("int", "num") else F.lit(node.value), kind, F.lit(False))

    def _number(self, v: Value) -> Column:
        if v.kind not in ("num", "int", "bool"):
            raise TemplateError(f"computed expression {self.expression!r}: arithmetic on {v.kind}")
        return v.column.cast("double")

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        error = a.error | b.error | a.column.isNull() | b.column.isNull()
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "str":
            return Value(F.concat(a.column, b.column), "str", error)
        x, y = self._number(a), self._number(b)
        whole = a.kind in ("int", "bool") and b.kind in ("int", "bool")
        kind = "int" if whole else "num"
        done = lambda c: c.cast("bigint") if whole else c
        match node.op:
            case ast.Add():
                return Value(done(x + y), kind, error)
            case ast.Sub():
                return Value(done(x - y), kind, error)
            case ast.Mult():
                return Value(done(x * y), kind, error)
            case ast.Div():
                return Value(F.try_divide(x, y), "num", error | F.coalesce(y == 0, F.lit(False)))
            case ast.FloorDiv():
                return Value(done(F.floor(F.try_divide(x, y)).cast("double")), kind, error | F.coalesce(y == 0, F.lit(False)))
            case ast.Mod():
                return Value(done(x - y * F.floor(F.try_divide(x, y))), kind, error | F.coalesce(y == 0, F.lit(False)))
            case ast.Pow():
                powered = F.pow(x, y)
                return Value(powered, "num", error | F.coalesce(F.isnan(powered), F.lit(False)))
        return self.generic_visit(node)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~self._truth(v), "bool", v.error)
        if isinstance(node.op, ast.USub | ast.UAdd):
            self._number(v)
            return Value(-v.column if isinstance(node.op, ast.USub) else v.column, v.kind, v.error | v.column.isNull())
        return self.generic_visit(node)

    def _truth(self, v: Value) -> Column:
        test = {"bool": v.column, "str": v.column != "", "list": F.size(v.column) > 0}.get(v.kind)
        return F.coalesce(test if test is not None else v.column != 0, F.lit(False))

    def visit_Compare(self, node: ast.Compare) -> Value:
        ops = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "!="}
        values = [self.visit(node.left), *map(self.visit, node.comparators)]
        truth, error = F.lit(True), F.lit(False)
        for op, a, b in zip(node.ops, values, values[1:], strict=False):
            sign = ops.get(type(op))
            if sign is None:
                return self.generic_visit(node)
            error = error | a.error | b.error
            if sign in ("=", "!="):
                same = a.column.eqNullSafe(b.column)
                truth = truth & (same if sign == "=" else ~same)
                continue
            error = error | a.column.isNull() | b.column.isNull()
            x, y = (a.column, b.column) if a.kind == b.kind == "str" else (self._number(a), self._number(b))
            truth = truth & {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
        return Value(truth, "bool", error)

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        values = list(map(self.visit, node.values))
        truth, error = self._truth(values[0]), values[0].error
        for v in values[1:]:  # the right side's error counts only if it is reached
            reached = truth if isinstance(node.op, ast.And) else ~truth
            error = error | (reached & v.error)
            truth = truth & self._truth(v) if isinstance(node.op, ast.And) else truth | self._truth(v)
        return Value(truth, "bool", error)

    def visit_IfExp(self, node: ast.IfExp) -> Value:
        test, a, b = self.visit(node.test), self.visit(node.body), self.visit(node.orelse)
        kind = a.kind if a.kind == b.kind else "num" if {a.kind, b.kind} <= {"num", "int", "bool"} else "str"
        as_ = lambda v: v.column if v.kind == kind else v.column.cast({"num": "double", "str": "string"}[kind])
        truth = self._truth(test)
        return Value(F.when(truth, as_(a)).otherwise(as_(b)), kind, test.error | F.when(truth, a.error).otherwise(b.error))

    def visit_Call(self, node: ast.Call) -> Value:
        if not isinstance(node.func, ast.Name) or node.keywords or not node.args:
            return self.generic_visit(node)
        args, name = list(map(self.visit, node.args)), node.func.id
        v = args[0]
        error = v.error | v.column.isNull()
        if len(args) == 1 and v.kind == "list":
            held = F.aggregate(v.column, F.lit(0.0), lambda a, x: a + x.cast("double"))
            made = {"len": (F.size(v.column).cast("bigint"), "int"), "sum": (held, "num"), "min": (F.array_min(v.column).cast("double"), "num"), "max": (F.array_max(v.column).cast("double"), "num")}.get(name)
            if made:
                return Value(made[0], made[1], error | (made[0].isNull() if name in ("min", "max") else F.exists(v.column, lambda x: x.isNull()) if name == "sum" else F.lit(False)))
        if name in ("min", "max") and len(args) > 1:
            xs = [self._number(a) for a in args]
            for a in args[1:]:
                error = error | a.error | a.column.isNull()
            return Value((F.least if name == "min" else F.greatest)(*xs), "num", error)
        if name == "round" and len(args) <= 2:
            digits = node.args[1].value if len(args) == 2 and isinstance(node.args[1], ast.Constant) else 0
            return Value(F.bround(self._number(v), digits) if len(args) == 2 else F.bround(self._number(v), 0).cast("bigint"), "num" if len(args) == 2 else "int", error)
        if len(args) == 1:
            if name == "abs":
                self._number(v)
                return Value(F.abs(v.column), v.kind, error)
            if name == "len" and v.kind == "str":
                return Value(F.char_length(v.column).cast("bigint"), "int", error)
            if name == "str":
                return Value(F.coalesce(v.column.cast("string"), F.lit("None")), "str", v.error)
            if name in ("int", "float"):
                cast = v.column.try_cast("double")
                done = F.when(cast < 0, F.ceil(cast)).otherwise(F.floor(cast)) if name == "int" else cast
                return Value(done, "int" if name == "int" else "num", error | done.isNull())
        return self.generic_visit(node)
