"""Expressions over records, compiled to Columns.

A recursive-descent parser turns the text into one Column, so that an expression runs in generated
code and is open to the optimizer; there is no interpreter per row. Numbers are doubles. ``annotations.k``,
``annotations["k"]`` and bare names read attributes; ``sequence`` is the record, whose parts are
``sequence.Id()``, ``.Sequence()``, ``.Len()``, ``.Count()``, ``.Definition()`` and ``.Taxid()``.
Whatever fails on a record (a missing attribute, a wrong type) is null, and a null predicate is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.records import attribute, qualities_of, raw_attribute, truth

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<name>[A-Za-z_]\w*)|(?P<op>=~|!~|==|!=|<=|>=|&&|\|\||\?\?|\*\*|[-+*/%<>!?:.,()\[\]]))""")


class Value:
    """A Column and what is known of its kind: number, text, bool, map, array, record, any."""

    def __init__(self, column: Column | None, kind: str, key: str | None = None):
        self.column, self.kind, self.key = column, kind, key

    def number(self) -> Column:
        if self.key is not None:
            return attribute(self.key, "double")
        if self.kind == "bool":
            return F.when(self.column, 1.0).otherwise(0.0)
        return self.column.try_cast("double")

    def text(self) -> Column:
        if self.key is not None:
            return attribute(self.key, "string")
        if self.kind == "number":  # whole numbers without a point
            whole = (self.column == F.floor(self.column)) & (F.abs(self.column) < 1e15)
            return F.when(whole, self.column.cast("bigint").cast("string")).otherwise(self.column.cast("string"))
        return F.to_json(self.column) if self.kind in ("map", "array") else self.column.cast("string")

    def truth(self) -> Column:
        if self.key is not None:
            return F.when(attribute(self.key, "string").isNotNull(), truth(attribute(self.key, "string")))
        return self.column if self.kind == "bool" else truth(self.text())

    def map(self) -> Column:
        if self.key is not None:
            return attribute(self.key, "map<string,bigint>" if self.key.startswith("merged_") else "map<string,double>")
        return self.column

    def array(self) -> Column:
        return attribute(self.key, "array<double>") if self.key is not None else self.column

    def is_map(self) -> Column:
        if self.key is None:
            return F.lit(self.kind == "map")
        if self.key.startswith("merged_"):
            return attribute(self.key, "map<string,bigint>").isNotNull()
        return F.coalesce(F.startswith(raw_attribute(self.key), F.lit("{")), F.lit(False))

    def is_array(self) -> Column:
        return F.lit(self.kind == "array") if self.key is None else F.coalesce(F.startswith(raw_attribute(self.key), F.lit("[")), F.lit(False))

    def any(self) -> Column:
        return attribute(self.key, "string") if self.key is not None else self.column


def _sequence_of(v: Value) -> Column:
    return F.col("sequence") if v.kind == "record" else v.text()


def _values(v: Value) -> Column:
    """Numbers of a container, whatever it is; a scalar is its own only one."""
    return F.when(v.is_map(), F.transform(F.map_values(v.map()), lambda x: x.cast("double"))).when(v.is_array(), v.array()).otherwise(F.array(v.number())) if v.key is not None else (
        F.transform(F.map_values(v.column), lambda x: x.cast("double")) if v.kind == "map" else F.transform(v.column, lambda x: x.cast("double")) if v.kind == "array" else F.array(v.number()))


def _len(v: Value) -> Value:
    if v.kind == "record":
        return Value(F.length("sequence").cast("double"), "number")
    if v.key is not None:
        return Value(F.when(v.is_map(), F.size(v.map())).when(v.is_array(), F.size(attribute(v.key, "array<string>"))).when(v.text().isNotNull(), 1).cast("double"), "number")
    return Value((F.size(v.column) if v.kind in ("map", "array") else F.lit(1)).cast("double"), "number")


def _which(v: Value, best: Callable) -> Value:
    """The key, or 0-based place, of the best value; of equal ones the first or the smallest key."""
    top = best(_values(v))
    keys = F.array_min(F.map_keys(F.map_filter(v.map(), lambda _, x: x.cast("double") == top))) if v.kind in ("any", "map") else None
    place = (F.array_position(_values(v), top) - 1).cast("string")
    if v.key is None:
        return Value(keys, "text") if v.kind == "map" else Value(place.cast("double"), "number")
    return Value(F.when(v.is_map(), keys).otherwise(place), "text")


def _containers(v: Value, on_map: Callable, on_array: Callable) -> Value:
    """A container's new form; for an attribute of unknown kind the map is tried first."""
    if v.kind == "array":
        return Value(on_array(v.column), "array")
    return Value(on_map(v.map()), "map")


def _printf(args: list[Value]) -> Value:
    form = args[0].literal if hasattr(args[0], "literal") else None
    if form is None:
        raise ValueError("sprintf needs a literal format")
    out, verbs = [], iter(args[1:])
    for verb in re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z%])", form):
        if verb == "%":
            continue
        v = next(verbs)
        out.append(v.number().cast("bigint") if verb in "dxXoc" else v.number() if verb in "feEgG" else v.text())
    return Value(F.format_string(re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)[vtq]", r"\1s", form), *out), "text")


def _replace(args: list[Value]) -> Value:
    return Value(F.regexp_replace(args[0].text(), args[1].text(), args[2].text()), "text")


def _element(v: Value, i: Value) -> Value:
    if v.kind == "record" or v.kind == "text" and v.key is None:
        s, at = _sequence_of(v), i.number().cast("int")
        return Value(F.when((at >= 0) & (at < F.length(s)), F.substr(s, at + 1, F.lit(1))), "text")
    if v.kind == "array":
        return Value(F.try_element_at(v.column, (i.number() + 1).cast("int")).cast("double"), "number")
    if v.kind == "map":
        return Value(F.try_element_at(v.column, i.text()).cast("double"), "number")
    of_map = F.try_element_at(v.map(), i.text()).cast("string")
    of_array = F.try_element_at(attribute(v.key, "array<string>"), (i.number() + 1).cast("int"))
    return Value(F.when(v.is_map(), of_map).when(v.is_array(), of_array).otherwise(F.substr(v.text(), (i.number() + 1).cast("int"), F.lit(1))), "text")


def _substr(s: Value, start: Value, size: Value) -> Value:
    a, n, text = start.number().cast("int"), size.number().cast("int"), s.text()
    return Value(F.when((a >= 0) & (n >= 0) & (a + n <= F.length(text)), F.substr(text, a + 1, n)), "text")


FUNCTIONS: dict[str, Callable[[list[Value]], Value]] = {
    "len": lambda a: _len(a[0]),
    "min": lambda a: Value(F.array_min(_values(a[0])), "number"),
    "max": lambda a: Value(F.array_max(_values(a[0])), "number"),
    "whichmin": lambda a: _which(a[0], F.array_min),
    "whichmax": lambda a: _which(a[0], F.array_max),
    "filtermin": lambda a: _containers(a[0], lambda m: F.map_filter(m, lambda _, x: x >= a[1].number()), lambda v: F.filter(v, lambda x: x >= a[1].number())),
    "filtermax": lambda a: _containers(a[0], lambda m: F.map_filter(m, lambda _, x: x <= a[1].number()), lambda v: F.filter(v, lambda x: x <= a[1].number())),
    "saturatingsub": lambda a: _containers(a[0], lambda m: F.map_filter(F.transform_values(m, lambda _, x: x - a[1].number()), lambda _, x: x > 0), lambda v: F.transform(v, lambda x: F.greatest(x - a[1].number(), F.lit(0.0)))),
    "contains": lambda a: Value(F.coalesce(F.map_contains_key(a[0].map(), a[1].text()), F.lit(False)), "bool"),
    "ismap": lambda a: Value(a[0].is_map(), "bool"),
    "isvector": lambda a: Value(a[0].is_array(), "bool"),
    "sprintf": _printf,
    "printf": _printf,
    "subspc": lambda a: Value(F.replace(a[0].text(), F.lit(" "), F.lit("_")), "text"),
    "int": lambda a: Value(a[0].number().try_cast("bigint"), "number"),
    "numeric": lambda a: Value(a[0].number(), "number"),
    "bool": lambda a: Value(a[0].truth(), "bool"),
    "string": lambda a: Value(a[0].text(), "text"),
    "ifelse": lambda a: Value(F.when(a[0].truth(), a[1].text() if a[1].kind != a[2].kind else a[1].any()).otherwise(a[2].text() if a[1].kind != a[2].kind else a[2].any()), "text" if a[1].kind != a[2].kind else a[1].kind),
    "gcskew": lambda a: Value(S.gc_skew(_sequence_of(a[0])), "number"),
    "gc": lambda a: Value(S.gc(_sequence_of(a[0])), "number"),
    "composition": lambda a: Value(S.composition(_sequence_of(a[0])), "map"),
    "qualities": lambda a: Value(qualities_of(), "array"),
    "elementof": lambda a: _element(a[0], a[1]),
    "replace": _replace,
    "substr": lambda a: _substr(*a),
}
METHODS = {
    "Id": lambda: Value(F.col("id"), "text"),
    "Sequence": lambda: Value(F.col("sequence"), "text"),
    "String": lambda: Value(F.col("sequence"), "text"),
    "Definition": lambda: Value(F.col("definition"), "text"),
    "Taxid": lambda: Value(F.coalesce("taxid", F.lit("NA")), "text"),
    "Len": lambda: Value(F.length("sequence").cast("double"), "number"),
    "Count": lambda: Value(F.col("count").cast("double"), "number"),
    "Source": lambda: Value(F.col("source"), "text"),
    "HasQualities": lambda: Value(F.col("qualities").isNotNull(), "bool"),
}


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r} in the expression")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if (op := self.peek()) in ops:
            self.at += 1
            return op
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"the expression lacks {op!r}")

    def whole(self) -> Value:
        v = self.choice()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r} in the expression")
        return v

    def choice(self) -> Value:
        v = self.either()
        if self.take("??"):
            other = self.choice()
            return Value(F.coalesce(v.text(), other.text()), "text") if v.kind != other.kind else Value(F.coalesce(v.any(), other.any()), v.kind)
        if not self.take("?"):
            return v
        a = self.choice()
        self.need(":")
        return FUNCTIONS["ifelse"]([v, a, self.choice()])

    def either(self) -> Value:
        v = self.both()
        while self.take("||"):
            v = Value(v.truth() | self.both().truth(), "bool")
        return v

    def both(self) -> Value:
        v = self.compared()
        while self.take("&&"):
            v = Value(v.truth() & self.compared().truth(), "bool")
        return v

    def compared(self) -> Value:
        v = self.sum()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "=~", "!~"):
            v = self.compare(v, op, self.sum())
        return v

    @staticmethod
    def compare(a: Value, op: str, b: Value) -> Value:
        if op in ("=~", "!~"):
            found = F.rlike(a.text(), b.text())
            return Value(found if op == "=~" else ~found, "bool")
        if "bool" in (a.kind, b.kind):
            x, y = a.truth(), b.truth()
        elif "number" in (a.kind, b.kind):
            x, y = a.number(), b.number()
        else:
            x, y = a.text(), b.text()
        return Value({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")

    def sum(self) -> Value:
        v = self.product()
        while op := self.take("+", "-"):
            w = self.product()
            if op == "+" and "text" in (v.kind, w.kind):
                v = Value(F.concat(v.text(), w.text()), "text")
            else:
                v = Value(v.number() + w.number() if op == "+" else v.number() - w.number(), "number")
        return v

    def product(self) -> Value:
        v = self.signed()
        while op := self.take("*", "/", "%"):
            x, y = v.number(), self.signed().number()
            v = Value(x * y if op == "*" else F.try_divide(x, y) if op == "/" else F.try_mod(x, y), "number")
        return v

    def signed(self) -> Value:
        if self.take("-"):
            return Value(-self.signed().number(), "number")
        if self.take("!"):
            return Value(~self.signed().truth(), "bool")
        v = self.primary()
        if self.take("**"):
            return Value(F.pow(v.number(), self.signed().number()), "number")
        return v

    def arguments(self) -> list[Value]:
        out: list[Value] = []
        if self.take(")"):
            return out
        while True:
            out.append(self.choice())
            if self.take(")"):
                return out
            self.need(",")

    def primary(self) -> Value:
        if self.take("("):
            v = self.choice()
            self.need(")")
            return v
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice().number())
                self.take(",")
            return Value(F.array(*items), "array")
        if self.at >= len(self.tokens):
            raise ValueError("the expression ends early")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(token)), "number")
        if kind == "text":
            plain = token[1:-1] if token[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1] if m[1] in "\"'\\" else m[0]), token[1:-1])
            v = Value(F.lit(plain), "text")
            v.literal = plain
            return v
        if kind == "op":
            raise ValueError(f"unexpected {token!r} in the expression")
        if self.take("("):
            if token not in FUNCTIONS:
                raise ValueError(f"unknown function {token!r}")
            return FUNCTIONS[token](self.arguments())
        if token in ("true", "false"):
            return Value(F.lit(token == "true"), "bool")
        if token == "annotations":
            key = self.key()
            v = Value(F.col("count").cast("double"), "number") if key == "count" else Value(None, "any", key)
        elif token == "sequence":
            if not self.take("."):
                return Value(None, "record")
            name = self.tokens[self.at][1]
            self.at += 1
            if name not in METHODS:
                raise ValueError(f"the record has no {name!r}")
            self.need("(")
            self.need(")")
            v = METHODS[name]()
        else:
            v = Value(F.col("count").cast("double"), "number") if token == "count" else Value(None, "any", token)
        while self.take("["):
            v = _element(v, self.choice())
            self.need("]")
        return v

    def key(self) -> str:
        if self.take("."):
            self.at += 1
            return self.tokens[self.at - 1][1]
        self.need("[")
        kind, token = self.tokens[self.at]
        if kind != "text":
            raise ValueError("annotations take a literal key")
        self.at += 1
        self.need("]")
        return token[1:-1]


def compile_expression(text: str) -> Value:
    return _Parser(text).whole()


def predicate(text: str) -> Column:
    """A boolean Column that is never null: what cannot be told of a record is false."""
    return F.coalesce(compile_expression(text).truth(), F.lit(False))


def value(text: str) -> Column:
    """The value with its natural type; an attribute alone is text."""
    v = compile_expression(text)
    if v.kind == "number" and v.key is None:  # whole numbers stay whole
        return v.column
    return v.any()
