"""The expression language over column names: parsing, Columns, rewriting and interval evaluation.

Only whitelisted syntax is accepted; nothing is ever evaluated as Python. Numbers are exact fractions until a Column or an
interval is made of them. `^` and list literals are rejected; division is by non-zero integer constants, powers by
non-negative integer constants (they become products, so that integers stay integers); comparisons may be chained.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, fields
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text is not in the language."""


@dataclass(frozen=True)
class Node:
    def parts(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self))

    def children(self) -> tuple[Node, ...]:
        return tuple(x for p in self.parts() for x in (p if isinstance(p, tuple) else (p,)) if isinstance(x, Node))


@dataclass(frozen=True)
class Num(Node):
    value: Fraction


@dataclass(frozen=True)
class Bool(Node):
    value: bool


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Arith(Node):
    op: str  # + - * /
    left: Node
    right: Node


@dataclass(frozen=True)
class Neg(Node):
    arg: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str  # < <= > >= == !=
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str  # and or
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    arg: Node


@dataclass(frozen=True)
class If(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Match(Node):
    """A value looked up among cases; without a default a value that matches none is an error."""

    key: Node
    cases: tuple[tuple[Node, Node], ...]
    default: Node | None

    def children(self):
        return (self.key, *(x for c in self.cases for x in c), *([self.default] if self.default else []))


_ARITH = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}
_CMP = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_FLIP = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}


def _constant(node: Node) -> Fraction | None:
    n = fold(node)
    return n.value if isinstance(n, Num) else None


def divide(a: Node, b: Node) -> Node:
    c = _constant(b)
    if c is None or c.denominator != 1 or c == 0:
        raise ExpressionError("division is by non-zero integer constants only")
    return Arith("/", a, Num(c))


def power(a: Node, b: Node) -> Node:
    c = _constant(b)
    if c is None or c.denominator != 1 or c < 0:
        raise ExpressionError("powers are non-negative integer constants only")
    return reduce(lambda x, y: Arith("*", x, y), [a] * int(c)) if c else Num(Fraction(1))


def absolute(a: Node) -> Node:
    return If(Compare("<", a, Num(Fraction(0))), Neg(a), a)


def implies(a: Node, b: Node) -> Node:
    return Logic("or", (Not(a), b))


def iff(a: Node, b: Node) -> Node:
    return Logic("and", (implies(a, b), implies(b, a)))


def least(*args: Node) -> Node:
    return reduce(lambda x, y: If(Compare("<", x, y), x, y), args)


def _convert(n: ast.AST, src: str, infix: bool) -> Node:
    go = lambda x: _convert(x, src, infix)
    if isinstance(n, ast.Expression):
        return go(n.body)
    if isinstance(n, ast.Constant):
        if isinstance(n.value, bool):
            return Bool(n.value)
        if isinstance(n.value, (int, float)):
            return Num(Fraction(ast.get_source_segment(src, n).replace("_", "")))
    if isinstance(n, ast.Name):
        return Var(n.id)
    if isinstance(n, ast.BinOp):
        if type(n.op) in _ARITH:
            return Arith(_ARITH[type(n.op)], go(n.left), go(n.right))
        if isinstance(n.op, ast.Div):
            return divide(go(n.left), go(n.right))
        if isinstance(n.op, ast.Pow) or infix and isinstance(n.op, ast.BitXor):
            return power(go(n.left), go(n.right))
    if isinstance(n, ast.UnaryOp):
        if isinstance(n.op, ast.USub):
            return Neg(go(n.operand))
        if isinstance(n.op, ast.UAdd):
            return go(n.operand)
        if isinstance(n.op, ast.Not):
            return Not(go(n.operand))
    if isinstance(n, ast.BoolOp):
        return Logic("and" if isinstance(n.op, ast.And) else "or", tuple(go(v) for v in n.values))
    if isinstance(n, ast.Compare) and all(type(o) in _CMP for o in n.ops):
        sides = [go(x) for x in (n.left, *n.comparators)]
        pairs = tuple(Compare(_CMP[type(o)], a, b) for o, a, b in zip(n.ops, sides, sides[1:], strict=False))
        return pairs[0] if len(pairs) == 1 else Logic("and", pairs)
    if isinstance(n, ast.IfExp):
        return If(go(n.test), go(n.body), go(n.orelse))
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
        name = n.func.id
        if name == "Match" and len(n.args) >= 4 and len(n.args) % 2 == 0:
            last = n.args[-1]
            default = None if isinstance(last, ast.Name) and last.id == "_none_" else go(last)
            return Match(go(n.args[0]), tuple((go(a), go(b)) for a, b in zip(n.args[1:-1:2], n.args[2:-1:2], strict=True)), default)
        args = tuple(go(a) for a in n.args)
        made = {"abs": (absolute, 1), "implies": (implies, 2), "iff": (iff, 2)}.get(name)
        if made and len(args) == made[1]:
            return made[0](*args)
        if name in ("min", "least") and args:
            return least(*args)
    raise ExpressionError(f"not in the expression language: {ast.unparse(n)!r}")


def parse(text: str, infix: bool = False) -> Node:
    """An expression in Python's syntax; with `infix` that of expression files, where ^ is a power and `.` ends a partial Match."""
    text = re.sub(r",\s*\.\s*\)", ", _none_)", text) if infix else text
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None
    return _convert(tree, text.strip(), infix)


def names(node: Node) -> set[str]:
    """Free variables."""
    return {node.name} if isinstance(node, Var) else set().union(*map(names, node.children()))


def operators(node: Node) -> Counter:
    """How often each operator stands in the expression."""
    own = Counter([node.op] if isinstance(node, (Arith, Compare, Logic)) else ["-x" if isinstance(node, Neg) else type(node).__name__.lower()] if isinstance(node, (Neg, Not, If, Match)) else [])
    return sum((operators(c) for c in node.children()), own)


def rebuild(node: Node, f) -> Node:
    """The node with f applied to its children."""
    match node:
        case Arith(op, a, b):
            return Arith(op, f(a), f(b))
        case Compare(op, a, b):
            return Compare(op, f(a), f(b))
        case Logic(op, args):
            return Logic(op, tuple(map(f, args)))
        case Neg(a):
            return Neg(f(a))
        case Not(a):
            return Not(f(a))
        case If(c, a, b):
            return If(f(c), f(a), f(b))
        case Match(k, cases, d):
            return Match(f(k), tuple((f(a), f(b)) for a, b in cases), f(d) if d else None)
    return node


def substitute(node: Node, values: Mapping[str, Node]) -> Node:
    """Variables replaced by expressions, all at once."""
    return values.get(node.name, node) if isinstance(node, Var) else rebuild(node, lambda c: substitute(c, values))


_DO = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def fold(node: Node) -> Node:
    """Constants computed exactly; decided branches, neutral elements and double negations removed."""
    n = rebuild(node, fold)
    zero, one = Num(Fraction(0)), Num(Fraction(1))
    match n:
        case Arith(op, Num(a), Num(b)) if op != "/" or b:
            return Num(Fraction(_DO[op](a, b)))
        case Arith("+", a, b) if zero in (a, b):
            return b if a == zero else a
        case Arith("-", a, b) if b == zero:
            return a
        case Arith("*", a, b) if one in (a, b):
            return b if a == one else a
        case Arith("*", a, b) if zero in (a, b):
            return zero
        case Arith("/", a, b) if b == one:
            return a
        case Neg(Num(a)):
            return Num(-a)
        case Neg(Neg(a)) | Not(Not(a)):
            return a
        case Compare(op, Num(a), Num(b)):
            return Bool(_DO[op](a, b))
        case Not(Bool(a)):
            return Bool(not a)
        case If(Bool(c), a, b):
            return a if c else b
        case If(_, a, b) if a == b:
            return a
        case Logic(op, args):
            stop = op == "or"
            if Bool(stop) in args:
                return Bool(stop)
            rest = tuple(dict.fromkeys(x for a in args if a != Bool(not stop) for x in (a.args if isinstance(a, Logic) and a.op == op else (a,))))
            return Bool(not stop) if not rest else rest[0] if len(rest) == 1 else Logic(op, rest)
    return n


def nnf(node: Node, negate: bool = False) -> Node:
    """Negations pushed down to the comparisons."""
    match node:
        case Not(a):
            return nnf(a, not negate)
        case Logic(op, args):
            return Logic({"and": "or", "or": "and"}[op] if negate else op, tuple(nnf(a, negate) for a in args))
        case Compare(op, a, b):
            return Compare(_FLIP[op] if negate else op, a, b)
        case Bool(v):
            return Bool(v != negate)
        case If(c, a, b):
            return If(c, nnf(a, negate), nnf(b, negate))
    return Not(node) if negate else node


def derivative(node: Node, name: str) -> Node:
    """Of a numeric expression; branches are differentiated one by one."""
    d = lambda x: derivative(x, name)
    match node:
        case Num():
            return Num(Fraction(0))
        case Var(n):
            return Num(Fraction(int(n == name)))
        case Neg(a):
            return fold(Neg(d(a)))
        case Arith("*", a, b):
            return fold(Arith("+", Arith("*", d(a), b), Arith("*", a, d(b))))
        case Arith("/", a, b):
            return fold(Arith("/", d(a), b))
        case Arith(op, a, b):
            return fold(Arith(op, d(a), d(b)))
        case If(c, a, b):
            return fold(If(c, d(a), d(b)))
    raise ExpressionError("no derivative")


def is_linear(node: Node) -> bool:
    """Whether no product or quotient has variables on both sides, in any part."""
    own = not (isinstance(node, Arith) and node.op == "*" and names(node.left) and names(node.right))
    return own and all(map(is_linear, node.children()))


def column(node: Node | str, columns: Mapping[str, Column] | None = None) -> Column:
    """The expression as a Column; names are columns of the DataFrame, whatever signs they hold."""
    node = parse(node) if isinstance(node, str) else node
    go = lambda x: column(x, columns)
    match node:
        case Num(v):
            return F.lit(int(v)) if v.denominator == 1 else F.lit(float(v))
        case Bool(v):
            return F.lit(v)
        case Var(n):
            return columns[n] if columns and n in columns else F.col(f"`{n}`")
        case Arith("/", a, b):
            return go(a).cast("double") / go(b)
        case Arith(op, a, b):
            return _DO[op](go(a), go(b))
        case Neg(a):
            return -go(a)
        case Compare(op, a, b):
            return _DO[op](go(a), go(b))
        case Logic(op, args):
            return reduce(operator.and_ if op == "and" else operator.or_, map(go, args))
        case Not(a):
            return ~go(a)
        case If(c, a, b):
            return F.when(go(c), go(a)).otherwise(go(b))
        case Match(k, cases, d):
            out = F.when(go(k) == go(cases[0][0]), go(cases[0][1]))
            for a, b in cases[1:]:
                out = out.when(go(k) == go(a), go(b))
            return out.otherwise(go(d) if d else F.raise_error(F.lit("no case matches")))
    raise ExpressionError(repr(node))


def value(node: Node, at: Mapping[str, float | Fraction | bool]):
    """The value at a point, exact where the point is."""
    go = lambda x: value(x, at)
    match node:
        case Num(v) | Bool(v):
            return v
        case Var(n):
            return at[n]
        case Arith(op, a, b) | Compare(op, a, b):
            return _DO[op](go(a), go(b))
        case Neg(a):
            return -go(a)
        case Logic(op, args):
            return (all if op == "and" else any)(map(go, args))
        case Not(a):
            return not go(a)
        case If(c, a, b):
            return go(a) if go(c) else go(b)
        case Match(k, cases, d):
            key = go(k)
            for a, b in cases:
                if go(a) == key:
                    return go(b)
            if d is None:
                raise ExpressionError("no case matches")
            return go(d)


Interval = tuple[float, float]


def _out(lo: float, hi: float) -> Interval:
    """Rounded outwards by one step."""
    return math.nextafter(lo, -math.inf), math.nextafter(hi, math.inf)


def interval(node: Node, box: Mapping[str, Interval]):
    """Bounds of a numeric expression over a box, or True, False or None (undecided) of a condition. Rounded outwards."""
    go = lambda x: interval(x, box)
    match node:
        case Num(v):
            return (float(v), float(v)) if Fraction(float(v)) == v else _out(float(v), float(v))
        case Bool(v):
            return v
        case Var(n):
            return box[n]
        case Neg(a):
            lo, hi = go(a)
            return -hi, -lo
        case Arith("*", a, b) if a == b:
            lo, hi = go(a)
            ends = (lo * lo, hi * hi)
            return (max(0.0, _out(min(ends), 0)[0]) if not lo <= 0 <= hi else 0.0), _out(0, max(ends))[1]
        case Arith(op, a, b):
            (p, q), (r, s) = go(a), go(b)
            if op == "+":
                return _out(p + r, q + s)
            if op == "-":
                return _out(p - s, q - r)
            ends = [0.0 if 0 in (x, y) and op == "*" else _DO[op](x, y) for x in (p, q) for y in (r, s)]
            return _out(min(ends), max(ends))
        case Compare(op, a, b):
            (p, q), (r, s) = go(a), go(b)
            if op in ("==", "!="):
                same = True if p == q == r == s else False if q < r or s < p else None
                return same if op == "==" or same is None else not same
            if op in (">", ">="):
                return go(Compare({">": "<", ">=": "<="}[op], b, a))
            return (True if q < r else False if p >= s else None) if op == "<" else (True if q <= r else False if p > s else None)
        case Logic(op, args):
            got = [go(a) for a in args]
            stop = op == "or"
            return stop if any(x is stop for x in got) else None if None in got else not stop
        case Not(a):
            v = go(a)
            return None if v is None else not v
        case If(c, a, b):
            t = go(c)
            if t is not None:
                return go(a) if t else go(b)
            x, y = go(a), go(b)
            if isinstance(x, tuple):
                return min(x[0], y[0]), max(x[1], y[1])
            return x if x is y else None
        case Match(k, cases, d):
            node = d if d else cases[-1][1]
            for a, b in reversed(cases if d else cases[:-1]):
                node = If(Compare("==", k, a), b, node)
            return go(node)


def text(node: Node) -> str:
    """Infix text that `parse` reads back."""
    match node:
        case Num(v):
            return str(v.numerator) if v.denominator == 1 else f"({v.numerator} / {v.denominator})"
        case Bool(v):
            return str(v)
        case Var(n):
            return n
        case Neg(a):
            return f"-({text(a)})"
        case Not(a):
            return f"not ({text(a)})"
        case Arith(op, a, b) | Compare(op, a, b):
            return f"({text(a)} {op} {text(b)})"
        case Logic(op, args):
            return "(" + f" {op} ".join(map(text, args)) + ")"
        case If(c, a, b):
            return f"({text(a)} if {text(c)} else {text(b)})"
        case Match(k, cases, d):
            return "Match(" + ", ".join([text(k), *(text(x) for c in cases for x in c), text(d) if d else "."]) + ")"


def prefix(node: Node) -> str:
    """Polish prefix text, one token after the other."""
    match node:
        case Arith(op, a, b) | Compare(op, a, b):
            return f"{op} {prefix(a)} {prefix(b)}"
        case Logic(op, args):
            return reduce(lambda x, y: f"{op} {x} {y}", map(prefix, args))
        case Neg(a):
            return f"neg {prefix(a)}"
        case Not(a):
            return f"not {prefix(a)}"
        case If(c, a, b):
            return f"ite {prefix(c)} {prefix(a)} {prefix(b)}"
        case Num(v):
            return str(v)
        case Bool(v):
            return str(v).lower()
        case Var(n):
            return n
    raise ExpressionError("no prefix form")


def parse_prefix(source: str) -> Node:
    """Reads what `prefix` writes."""
    todo = source.split()[::-1]

    def take() -> Node:
        if not todo:
            raise ExpressionError("prefix text ends early")
        t = todo.pop()
        if t in "+-*/" and len(t) == 1:
            return Arith(t, take(), take())
        if t in _FLIP:
            return Compare(t, take(), take())
        if t in ("and", "or"):
            return Logic(t, (take(), take()))
        if t == "neg":
            return Neg(take())
        if t == "not":
            return Not(take())
        if t == "ite":
            return If(take(), take(), take())
        if t in ("true", "false"):
            return Bool(t == "true")
        return Num(Fraction(t)) if re.fullmatch(r"-?\d[\d./]*", t) else Var(t)

    out = take()
    if todo:
        raise ExpressionError("prefix text goes on")
    return out


def smt2(node: Node) -> str:
    """The expression as SMT-LIB text."""
    match node:
        case Num(v):
            s = str(abs(v.numerator)) if v.denominator == 1 else f"(/ {abs(v.numerator)} {v.denominator})"
            return s if v >= 0 else f"(- {s})"
        case Bool(v):
            return str(v).lower()
        case Var(n):
            return n if re.fullmatch(r"[A-Za-z_]\w*", n) else f"|{n}|"
        case Compare("!=", a, b):
            return f"(not (= {smt2(a)} {smt2(b)}))"
        case Arith(op, a, b) | Compare(op, a, b):
            return f"({'=' if op == '==' else op} {smt2(a)} {smt2(b)})"
        case Neg(a):
            return f"(- {smt2(a)})"
        case Not(a):
            return f"(not {smt2(a)})"
        case Logic(op, args):
            return f"({op} {' '.join(map(smt2, args))})"
        case If(c, a, b):
            return f"(ite {smt2(c)} {smt2(a)} {smt2(b)})"
    raise ExpressionError("no SMT-LIB form")


_TOKEN = re.compile(r";[^\n]*|\|[^|]*\||[()]|[^\s()|;]+")


def s_expressions(source: str) -> list:
    """S-expressions as nested lists of tokens. A symbol in bars keeps its first bar, so that it is no keyword; comments are left out."""
    stack: list[list] = [[]]
    at = 0
    for m in _TOKEN.finditer(source):
        if source[at : m.start()].strip():
            raise ExpressionError("an open bar")
        at, t = m.end(), m[0]
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise ExpressionError("a closing bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        elif not t.startswith(";"):
            stack[-1].append(t[:-1] if t[0] == "|" else t)
    if len(stack) > 1 or source[at:].strip():
        raise ExpressionError("an open bracket or bar")
    return stack[0]


_NUMERAL = re.compile(r"\d+(\.\d+)?")


def _term(t, bound: Mapping[str, Node]) -> Node:
    go = lambda x: _term(x, bound)
    if isinstance(t, str):
        if t[0] == "|":
            return bound.get(t[1:], Var(t[1:]))
        if _NUMERAL.fullmatch(t):
            return Num(Fraction(t))
        return Bool(t == "true") if t in ("true", "false") else bound.get(t, Var(t))
    if len(t) < 2 or not isinstance(t[0], str):
        raise ExpressionError(f"no term: {t}")
    op, rest = t[0], t[1:]
    if op == "let":
        new = {n.removeprefix("|"): go(x) for n, x in rest[0]}
        return _term(rest[1], dict(bound) | new)
    args = tuple(map(go, rest))
    if op == "-" and len(args) == 1:
        return Num(-args[0].value) if isinstance(args[0], Num) and args[0].value > 0 else Neg(args[0])
    if op == "/" and all(isinstance(a, Num) for a in args) and len(args) == 2 and args[1].value:
        return Num(args[0].value / args[1].value)
    if op in ("+", "-", "*", "/") and len(args) > 1:
        return reduce(lambda a, b: Arith(op, a, b), args)
    if op in ("<", "<=", ">", ">=", "=") and len(args) > 1:
        pairs = tuple(Compare("==" if op == "=" else op, a, b) for a, b in zip(args, args[1:], strict=False))
        return pairs[0] if len(pairs) == 1 else Logic("and", pairs)
    if op == "distinct" and len(args) > 1:
        pairs = tuple(Compare("!=", a, b) for i, a in enumerate(args) for b in args[i + 1 :])
        return pairs[0] if len(pairs) == 1 else Logic("and", pairs)
    if op == "not" and len(args) == 1:
        return Compare("!=", args[0].left, args[0].right) if isinstance(args[0], Compare) and args[0].op == "==" else Not(args[0])
    if op in ("and", "or"):
        return args[0] if len(args) == 1 else Logic(op, args)
    if op == "=>" and len(args) > 1:
        return reduce(lambda b, a: implies(a, b), args[-2::-1], args[-1])
    if op == "xor" and len(args) == 2:
        return Not(iff(*args))
    if op == "ite" and len(args) == 3:
        return If(*args)
    raise ExpressionError(f"{op} with {len(args)} arguments")


def parse_smt2(source: str) -> Node:
    """Reads one SMT-LIB term: what `smt2` writes, and let, =>, xor, distinct, chained comparisons and sums of several terms.

    Signed and fractional constants become numbers, and a negated equality a comparison, so these read back as `smt2` writes them.
    """
    found = s_expressions(source)
    if len(found) != 1:
        raise ExpressionError(f"{len(found)} terms, not one")
    return _term(found[0], {})


def parse_assertions(source: str) -> tuple[dict[str, str], list[Node]]:
    """The declared constants with their sorts, and the asserted conditions, of an SMT-LIB script; other commands are passed over."""
    sorts: dict[str, str] = {}
    out = []
    for c in s_expressions(source):
        if not isinstance(c, list) or not c:
            raise ExpressionError("a script is a list of commands")
        if c[0] == "declare-const":
            sorts[c[1].removeprefix("|")] = c[2]
        elif c[0] == "declare-fun":
            if c[2]:
                raise ExpressionError(f"{c[1]} takes arguments")
            sorts[c[1].removeprefix("|")] = c[3]
        elif c[0] == "assert":
            out.append(_term(c[1], {}))
    return sorts, out
