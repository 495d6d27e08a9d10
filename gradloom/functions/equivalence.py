"""Whether two answers are the same expression: LaTeX arithmetic in exact rational functions, else at seeded points.

A pair is decided exactly where both sides are made of numbers, letters, fractions, roots of numbers and whole powers:
both become quotients of polynomials over products of letters and of primes to fractional powers, and are multiplied
crosswise.  Other functions and roots are compared at several seeded points.  A text that isn't read to its end, or that
takes more than the bounds of ``Limits``, is undecided.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@dataclass(frozen=True)
class Limits:
    """Bounds on the work of a pair."""

    characters: int = 400
    terms: int = 300
    power: int = 30
    digits: int = 60
    points: int = 5


LIMITS = Limits()


class Undecided(Exception):
    pass


# Names of functions, marks that say nothing, other spellings of operators.
FUNCTIONS = ("arcsin", "arccos", "arctan", "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp")
SILENT = ("left", "right", "displaystyle", "big", "Big", "quad", "qquad")
SPELLED = {"cdot": "*", "times": "*", "div": "/", "dfrac": "frac", "tfrac": "frac", "%": "%", "{": "set", "}": "end"}
_TOKEN = re.compile(r"\s*(?:(\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?|\.\d+)|\\([A-Za-z]+|.)|(.))", re.S)
_WORD = re.compile(r"(?<![A-Za-z\\\\])[A-Za-z]{3,}")  # prose, no product of letters
_IGNORED = re.compile(r"\\(?:text|mathrm|textbf|mbox)\{[^{}]*\}|\^?\s*\\circ|°|\\[,;:! ]|\$|\\[()\[\]]")


def _tokens(text: str) -> list[tuple[str, str]]:
    text, at, out = _IGNORED.sub(" ", text).strip().rstrip("."), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        number, command, mark = m.groups()
        if number:
            out.append(("number", number.replace(",", "")))
        elif command and command not in SILENT:
            command = SPELLED.get(command, command)
            out.append(("command" if command.isalpha() and len(command) > 1 else "mark", command))
        elif mark and not mark.isspace():
            out.append(("letter" if mark.isalpha() else "mark", {"−": "-", "–": "-", "·": "*", "×": "*", "π": "pi"}.get(mark, mark)))
    return out


class _Reader:
    """Recursive descent: sums of products of signed powers.  Nodes are tuples (kind, parts)."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> str:
        kind, value = self.peek()
        if kind == "end" or mark is not None and value != mark:
            raise Undecided
        self.at += 1
        return value

    def whole(self) -> tuple:
        out = self.listed()
        if self.peek()[0] != "end":
            raise Undecided  # a part isn't the whole
        return out

    def listed(self) -> tuple:
        kind, value = self.peek()
        if value == "set":
            self.take()
            return ("set", tuple(self.items("end")))
        if value in ("(", "["):
            start = self.at
            self.take()
            items = list(self.items(")", "]"))
            close = self.tokens[self.at - 1][1]
            if len(items) > 1 and self.peek()[0] == "end":
                return ("tuple" if (value, close) == ("(", ")") else "interval " + value + close, tuple(items))
            self.at = start  # brackets of an expression
        first = self.sum()
        if self.peek()[1] == "=" and first[0] == "letter":  # x = 3 says 3
            self.take()
            first = self.sum()
        if self.peek()[1] != ",":
            return first
        items = [first]
        while self.peek()[1] == ",":
            self.take()
            items.append(self.sum())
        return ("set", tuple(items))

    def items(self, *ends: str) -> Iterator[tuple]:
        yield self.sum()
        while self.peek()[1] == ",":
            self.take()
            yield self.sum()
        if self.take() not in ends:
            raise Undecided

    def sum(self) -> tuple:
        out = self.product()
        while self.peek()[1] in ("+", "-"):
            sign = self.take()
            right = self.product()
            out = ("+", out, right if sign == "+" else ("*", ("number", Fraction(-1)), right))
        return out

    def product(self) -> tuple:
        out = self.signed()
        while True:
            kind, value = self.peek()
            if value in ("*", "/"):
                self.take()
                out = (value, out, self.signed())
            elif kind in ("number", "letter") or value in ("(", "{") or kind == "command" and value in ("frac", "sqrt", "pi", "theta", "infty", *FUNCTIONS):
                mixed = value == "frac" and out[0] == "number" and out[1].denominator == 1
                right = self.power()
                mixed = mixed and right[0] == "/" and right[1][0] == right[2][0] == "number"
                out = ("+" if mixed else "*", out, right)  # 1\frac{1}{2} is one and a half
            else:
                return out

    def signed(self) -> tuple:
        if self.peek()[1] in ("+", "-"):
            sign = self.take()
            inner = self.signed()
            return inner if sign == "+" else ("*", ("number", Fraction(-1)), inner)
        return self.power()

    def power(self) -> tuple:
        out = self.atom()
        while True:
            if self.peek()[1] == "^":
                self.take()
                minus = self.peek()[1] == "-" and bool(self.take())
                by = self.atom(one=True)
                out = ("^", out, ("*", ("number", Fraction(-1)), by) if minus else by)
            elif self.peek()[1] == "%":
                self.take()
                out = ("/", out, ("number", Fraction(100)))
            elif self.peek()[1] == "!":
                self.take()
                if out[0] != "number" or out[1].denominator != 1 or not 0 <= out[1] <= LIMITS.power:
                    raise Undecided
                out = ("number", Fraction(math.factorial(int(out[1]))))
            else:
                return out

    def group(self, close: str) -> tuple:
        out = self.sum()
        self.take(close)
        return out

    def atom(self, one: bool = False) -> tuple:
        """``one``: digits without braces count one by one, as after ^ and \\frac."""
        kind, value = self.peek()
        if kind == "number":
            if one and len(value) > 1 and value.isdigit():
                self.tokens[self.at] = ("number", value[1:])
                return ("number", Fraction(value[0]))
            self.take()
            if len(value) > LIMITS.digits:
                raise Undecided
            return ("number", Fraction(value))
        self.take()
        if kind == "letter":
            return ("letter", value)
        if value in ("(", "{"):
            return self.group(")" if value == "(" else "}")
        if value == "frac":
            return ("/", self.atom(one=True), self.atom(one=True))
        if value == "sqrt":
            n = ("number", Fraction(2))
            if self.peek()[1] == "[":
                self.take()
                n = self.group("]")
            return ("^", self.atom(one=True), ("/", ("number", Fraction(1)), n))
        if value in FUNCTIONS:
            by = None
            if self.peek()[1] == "^":  # \\sin^2 x
                self.take()
                by = self.atom(one=True)
            out = (value, self.atom() if self.peek()[1] in ("(", "{") else self.power())
            return ("^", out, by) if by else out
        if value in ("pi", "theta", "infty"):
            return ("letter", value)
        raise Undecided


@lru_cache(maxsize=20_000)
def parsed(text: str | None) -> tuple | None:
    """The expression that a whole text is, null where it is none."""
    if text is None or not text.strip() or len(text) > LIMITS.characters or _WORD.search(_IGNORED.sub(" ", text)):
        return None
    try:
        return _Reader(_tokens(text)).whole()
    except (Undecided, ZeroDivisionError, RecursionError):
        return None


# polynomials: {product: coefficient}; a product is a sorted tuple of (letter or prime, exponent)


def _times(a: dict, b: dict) -> dict:
    out: dict = {}
    if len(a) * len(b) > LIMITS.terms**2 // 9:
        raise Undecided
    for p, x in a.items():
        for q, y in b.items():
            powers: dict = dict(p)
            for name, e in q:
                powers[name] = powers.get(name, 0) + e
            c = x * y
            for name in [n for n in powers if isinstance(n, int)]:  # whole powers of primes are numbers
                whole = math.floor(powers[name])
                c, powers[name] = c * Fraction(name) ** whole, powers[name] - whole
            key = tuple(sorted(((n, e) for n, e in powers.items() if e), key=str))
            out[key] = out.get(key, 0) + c
    out = {k: c for k, c in out.items() if c}
    if len(out) > LIMITS.terms or any(max(c.numerator.bit_length(), c.denominator.bit_length()) > 4 * LIMITS.digits * LIMITS.power for c in out.values()):
        raise Undecided
    return out


def _plus(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, c in b.items():
        out[k] = out.get(k, 0) + c
    return {k: c for k, c in out.items() if c}


ONE = {(): Fraction(1)}


def _primes(n: int) -> Iterator[tuple[int, int]]:
    if n > 10**12:
        raise Undecided
    p = 2
    while p * p <= n:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        if k:
            yield p, k
        p += 1
    if n > 1:
        yield n, 1


def _exact(node: tuple) -> tuple[dict, dict]:
    """(numerator, denominator) of an expression."""
    kind = node[0]
    if kind == "number":
        return ({(): node[1]} if node[1] else {}), ONE
    if kind == "letter":
        return {((node[1], Fraction(1)),): Fraction(1)}, ONE
    if kind in ("+", "*", "/"):
        (a, b), (c, d) = _exact(node[1]), _exact(node[2])
        if kind == "+":
            return _plus(_times(a, d), _times(c, b)), _times(b, d)
        if kind == "/":
            if not c:
                raise ZeroDivisionError
            c, d = d, c
        return _times(a, c), _times(b, d)
    if kind == "^":
        (a, b), (c, d) = _exact(node[1]), _exact(node[2])
        if not set(c) <= {()} or not set(d) <= {()}:
            raise Undecided
        e = c.get((), Fraction(0)) / d[()]
        if abs(e) > LIMITS.power:
            raise Undecided
        if e.denominator == 1:
            if e < 0:
                if not a:
                    raise ZeroDivisionError
                a, b, e = b, a, -e
            out = ONE, ONE
            for _ in range(int(e)):
                out = _times(out[0], a), _times(out[1], b)
            return out
        if set(a) <= {()} and set(b) <= {()}:  # a root of a number
            x = a.get((), Fraction(0)) / b[()]
            if x <= 0:
                if x == 0 and e > 0:
                    return {}, ONE
                raise Undecided
            powers = [(p, k * e) for p, k in _primes(x.numerator)] + [(p, -k * e) for p, k in _primes(x.denominator)]
            return _times({tuple(sorted(powers, key=str)): Fraction(1)}, ONE), ONE
    raise Undecided


_CALL = {"ln": cmath.log, "log": cmath.log10, "exp": cmath.exp, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x)}


def _at(node: tuple, point: int) -> complex:
    kind = node[0]
    if kind == "number":
        return complex(node[1])
    if kind == "letter":
        return complex(math.pi) if node[1] == "pi" else complex(0.31 + (sum(map(ord, node[1])) * 7919 + point * 104_729) % 1_000 / 731)  # seeded by name and point
    if kind in _CALL:
        return _CALL[kind](_at(node[1], point))
    a, b = _at(node[1], point), _at(node[2], point)
    return a + b if kind == "+" else a * b if kind == "*" else a / b if kind == "/" else a**b


def _letters(node: tuple) -> set:
    return {node[1]} if node[0] == "letter" else {x for part in node[1:] if isinstance(part, tuple) for x in _letters(part)}


def _same(a: tuple, b: tuple) -> bool | None:
    lists = ("set", "tuple", "interval (]", "interval [)", "interval []")
    if a[0] in lists or b[0] in lists:
        if a[0] != b[0] or len(a[1]) != len(b[1]):
            return False
        if a[0] != "set":
            pairs = [_same(x, y) for x, y in zip(a[1], b[1], strict=True)]
            return False if False in pairs else None if None in pairs else True
        left = list(b[1])
        for x in a[1]:
            hit = next((y for y in left if _same(x, y)), None)
            if hit is None:
                return False
            left.remove(hit)
        return True
    if "infty" in _letters(a) | _letters(b):
        return a == b
    try:
        (p, q), (r, s) = _exact(a), _exact(b)
        return _times(p, s) == _times(r, q)
    except ZeroDivisionError:
        return None
    except Undecided:
        pass
    try:
        for point in range(LIMITS.points):
            x, y = _at(a, point), _at(b, point)
            if not abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)):
                return False
        return True
    except (ArithmeticError, ValueError):
        return None


def same_expression(left: str | None, right: str | None) -> bool | None:
    """Whether two texts are the same expression; null where either is none or it takes too long to tell."""
    a, b = parsed(left), parsed(right)
    if a is None or b is None:
        return None
    try:
        return _same(a, b)
    except (Undecided, RecursionError):
        return None


@F.pandas_udf(BooleanType())
def _equivalent(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([same_expression(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


def equivalent(left: Column, right: Column) -> Column:
    """Whether two answers are the same expression, an Arrow function: U19.  Null where either isn't one or it stays undecided.

    Numbers are exact (``1/2`` is ``0.5``), letters stand for anything (``x+1`` is ``1+x``), ``x = 3`` says 3, lists between
    commas and sets have no order, tuples and intervals do.  Texts of over 400 characters and null are undecided.
    """
    return _equivalent(left, right)
