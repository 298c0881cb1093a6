"""Infix expressions over tags: parsing and compilation to Spark columns.

`@a.name`, `@a`, `@.age` (the head), `@a.~id`, `@a.~label`, `@p.~len`, `@a.~all`; `[@a, @b.x]` and `{@a, @b.x}` build arrays and maps; literals are
integers, floats, strings, booleans and arrays of them. Operators bind as in `BINDING`; bit operators bind tighter than arithmetic.

Missing values: a predicate whose value is NULL is false; a bare variable as predicate tests existence; elsewhere a missing value is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How tightly operators bind.
BINDING = {
    "^": 200, "&": 140, "|": 140, "<<": 130, ">>": 130, "^^": 120, "!": 110, "*": 100, "/": 100, "%": 100, "+": 95, "-": 95,
    "==": 80, "!=": 80, "<": 80, "<=": 80, ">": 80, ">=": 80, "within": 80, "without": 80, "startswith": 80, "endswith": 80,
    "&&": 75, "||": 70,
}

TOKEN = re.compile(
    r"""\s*(?:
    (?P<var>@(?:[A-Za-z_]\w*|\d+)?(?:\.(?:~(?:id|label|len|all)|[A-Za-z_]\w*))?)
  | (?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
  | (?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%^&|<>!()\[\]{},])
  )""",
    re.VERBOSE,
)


class ExpressionError(ValueError):
    """The text is not an expression."""


@dataclass(frozen=True)
class Node:
    kind: str  # var, lit, list, map, or an operator
    value: object = None
    args: tuple[Node, ...] = field(default=())


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at : at + 10]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or value is not None and item[1] != value:
            raise ExpressionError(f"{value or 'an operand'} expected, not {item[1]!r}")
        self.at += 1
        return item

    def whole(self) -> Node:
        node = self.binary(0)
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def binary(self, least: int) -> Node:
        left = self.operand()
        while (op := self.peek()[1]) in BINDING and self.peek()[0] in ("op", "word") and op != "!" and BINDING[op] >= least:
            self.take()
            right = self.binary(BINDING[op] + 1)
            left = Node(op, None, (left, right))
        return left

    def several(self, close: str) -> tuple[Node, ...]:
        out = []
        while self.peek()[1] != close:
            out.append(self.binary(0))
            if self.peek()[1] != close:
                self.take(",")
        self.take(close)
        return tuple(out)

    def operand(self) -> Node:
        kind, text = self.take()
        if kind == "var":
            tag, _, prop = text[1:].partition(".")
            return Node("var", (tag or None, prop or None))
        if kind == "num":
            return Node("lit", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "word" and text in ("true", "false"):
            return Node("lit", text == "true")
        if text == "(":
            node = self.binary(0)
            self.take(")")
            return node
        if text == "[":
            return Node("list", None, self.several("]"))
        if text == "{":
            return Node("map", None, self.several("}"))
        if text == "!":
            return Node("!", None, (self.binary(BINDING["!"]),))
        if text == "-":
            return Node("neg", None, (self.binary(BINDING["*"] + 1),))
        raise ExpressionError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    return _Parser(text).whole()


def variables(node: Node) -> set[tuple[str | None, str | None]]:
    found = {node.value} if node.kind == "var" else set()
    return found.union(*(variables(x) for x in node.args)) if node.args else found


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Compiler:
    """Compiles nodes to columns of `df`; `resolve` gives the column of a tag's property."""

    def __init__(self, df: DataFrame, resolve: Callable[[str | None, str | None], Column]):
        self.df, self.resolve = df, resolve

    def types(self, *columns: Column) -> list[T.DataType]:
        return [f.dataType for f in self.df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema]

    def value(self, node: Node) -> Column:
        kind, args = node.kind, node.args
        if kind == "var":
            return self.resolve(*node.value)
        if kind == "lit":
            return F.lit(node.value)
        if kind == "list":
            return self.listed(args)
        if kind == "map":
            keys = [F.concat_ws(".", *[F.lit(x) for x in n.value if x]) if n.kind == "var" else F.lit(str(n.value)) for n in args]
            columns = [self.value(n) for n in args]
            if len({str(t) for t in self.types(*columns)}) > 1:
                columns = [c.cast("string") for c in columns]
            return F.create_map(*[x for pair in zip(keys, columns, strict=True) for x in pair])
        if kind == "neg":
            return -self.value(args[0])
        if kind == "!":
            return ~self.truth(args[0])
        if kind in ("&&", "||"):
            left, right = map(self.truth, args)
            return left & right if kind == "&&" else left | right
        left, right = self.value(args[0]), self.value(args[1])
        if kind in ("within", "without"):
            inside = self.inside(left, right, args[1])
            return inside if kind == "within" else ~inside
        if kind in ("/", "^^"):
            whole = all(isinstance(t, WHOLE) for t in self.types(left, right))
            if kind == "/":
                return self.divided(left, F.when(right != F.lit(0), right), whole)
            return self.power(left, right, args[1], whole)
        simple: dict[str, Callable[[], Column]] = {
            "+": lambda: left + right,
            "-": lambda: left - right,
            "*": lambda: left * right,
            "%": lambda: left % F.when(right != F.lit(0), right),
            "&": lambda: left.bitwiseAND(right),
            "|": lambda: left.bitwiseOR(right),
            "^": lambda: left.bitwiseXOR(right),
            "<<": lambda: F.call_function("shiftleft", left, right.cast("int")),
            ">>": lambda: F.call_function("shiftright", left, right.cast("int")),
            "==": lambda: left == right,
            "!=": lambda: left != right,
            "<": lambda: left < right,
            "<=": lambda: left <= right,
            ">": lambda: left > right,
            ">=": lambda: left >= right,
            "startswith": lambda: left.startswith(right),
            "endswith": lambda: left.endswith(right),
        }
        return simple[kind]()

    def divided(self, left: Column, right: Column, whole: bool) -> Column:
        """Division; of whole numbers without the remainder. By zero: NULL."""
        if not whole:
            return left.cast("double") / right
        # Exact also beyond 2**53: the remainder, which has the sign of the left side, is taken off first
        rest = left % right
        return ((left - rest).cast("decimal(38,0)") / right.cast("decimal(38,0)")).cast("long")

    def power(self, left: Column, right: Column, node: Node, whole: bool) -> Column:
        """Power; of whole numbers exact, and NULL beyond 64 bits. A negative literal exponent gives a double, a negative one from a column NULL."""
        if not whole or node.kind == "neg":
            return F.pow(left, right)
        base = left.cast("long")
        # Beyond 63 only the bases -1, 0 and 1 stay within 64 bits, and they repeat with period two
        small = F.abs(base) <= 1
        if node.kind == "lit":
            n, out = node.value, F.lit(1).cast("long")
            for _ in range(n if n <= 63 else 62 + n % 2):
                out = F.try_multiply(out, base)
            return out if n <= 63 else F.when(small, out)
        turns = F.when(right > 63, F.lit(62) + right % 2).otherwise(right).cast("int")
        product = F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), F.lit(1).cast("long"), lambda acc, _: F.try_multiply(acc, base))
        return F.when(right == 0, F.lit(1).cast("long")).when((right > 0) & ((right <= 63) | small), product)

    def listed(self, args: tuple[Node, ...]) -> Column:
        columns = [self.value(n) for n in args]
        if len({str(t) for t in self.types(*columns)}) > 1:
            return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
        return F.array(*columns)

    def inside(self, left: Column, right: Column, node: Node) -> Column:
        """Membership; of an array all elements must be members."""
        if isinstance(self.types(left)[0], T.ArrayType):
            return F.size(F.array_except(left, right)) == 0
        if node.kind == "list" and all(n.kind == "lit" for n in node.args):
            return left.isin([n.value for n in node.args])
        return F.array_contains(right, left)

    def truth(self, node: Node) -> Column:
        """The value as a condition: a bare variable tests existence."""
        return self.value(node).isNotNull() if node.kind == "var" else self.value(node)

    def predicate(self, text: str) -> Column:
        """For `where`, which takes NULL as false; left bare, so that it reaches the scan."""
        return self.truth(parse(text))

    def projection(self, text: str) -> Column:
        return self.value(parse(text))
