"""Equality of expressions: a parser of plain and LaTeX notation, and identity testing by evaluation.

Two expressions that are rational functions of their letters, with square roots of rational numbers, are compared
exactly but for a chance of about 1e-17 a point: they are evaluated at random points modulo a large prime. Modulo that
prime every prime under a root has a root of its own, chosen once, so sqrt(8) and 2 sqrt 2 are the same number. With
other roots, logarithms, exponentials or trigonometry they are evaluated at random complex points in floating point.

Defined results: what can't be parsed has no value, and equality with it is None: so have texts over LONGEST
characters or DEEPEST levels, and words (runs of over two letters that name no function). A number right before a
fraction of whole numbers is a mixed number. A letter is a variable, but for e, i and pi; variables
stand for numbers with a positive real part, so sqrt(x^2) is x.
"""

from __future__ import annotations

import cmath
import functools
import math
import random
import re
from collections.abc import Callable
from fractions import Fraction

LONGEST, DEEPEST = 1000, 60
#: Points at which expressions are compared, and tries for one where they have a value.
POINTS, TRIES = 4, 12
#: The largest exponent that is evaluated exactly, and the largest number whose root is taken apart.
POWER, RADICAND = 10_000, 10**10
_MODULUS = (1 << 61) - 1

#: Names of functions and constants, and marks that have no meaning of their own.
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp, "abs": abs}
CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j}
SILENT = ("\\left", "\\right", "\\displaystyle", "\\!", "\\,", "\\;", "\\:", "\\ ", "$", "^{\\circ}", "^\\circ")
SPELLINGS = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "π": "\\pi", "√": "\\sqrt", "·": "*", "×": "*", "−": "-"}

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|\\?(sqrt|frac|pi|arcsin|arccos|arctan|sin|cos|tan|log|ln|exp|abs)|([A-Za-z]+)|([-+*/^(){}\[\]|_]))")


class Unreadable(ValueError):
    """Not an expression, or one without a value where it was asked for."""


class Inexact(ValueError):
    """Has no value modulo a prime."""


def _tokens(text: str) -> list[tuple[str, str]]:
    for mark in SILENT:
        text = text.replace(mark, " " if mark[-1].isalpha() or mark == "\\ " else "")
    for old, new in SPELLINGS.items():
        text = text.replace(old, new)
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Unreadable(text)
        number, name, letters, mark = m.groups()
        if letters and len(letters) > 2:
            raise Unreadable(letters)
        out += [("number", number)] if number else [("name", name)] if name else [("letter", c) for c in letters] if letters else [("mark", mark)]
        at = m.end()
    return out


class _Reader:
    """Recursive descent: sums of products of signed powers; factors may stand side by side."""

    def __init__(self, text: str) -> None:
        if len(text) > LONGEST:
            raise Unreadable("too long")
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and got != value:
            raise Unreadable(value or "more")
        self.at += 1
        return got

    def whole(self) -> tuple:
        made = self.sum()
        if self.peek()[0] != "end":
            raise Unreadable(self.peek()[1])
        return made

    def sum(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("too deep")
        made = self.product()
        while self.peek()[1] in ("+", "-"):
            sign = self.take()
            term = self.product()
            made = ("+", made, term if sign == "+" else ("*", ("number", Fraction(-1)), term))
        self.depth -= 1
        return made

    def product(self) -> tuple:
        made = self.signed()
        while True:
            kind, got = self.peek()
            if got in ("*", "/"):
                self.take()
                made = (got, made, self.signed())
            elif kind in ("number", "letter", "name") or got in ("(", "{"):
                made = self.beside(made, kind)
            else:
                return made

    def beside(self, made: tuple, kind: str) -> tuple:
        """A factor without a sign between; 7 3/4 and 7 with a fraction of whole numbers are sums."""
        whole = made[0] == "number" and made[1].denominator == 1
        start = self.at
        if whole and kind == "number":
            top = self.power()
            self.take("/")
            return ("+", made, ("/", top, self.power()))
        factor = self.power()
        mixed = whole and self.tokens[start] == ("name", "frac") and factor[0] == "/" and all(x[0] == "number" for x in factor[1:])
        return ("+" if mixed else "*", made, factor)

    def signed(self) -> tuple:
        if self.peek()[1] in ("+", "-"):
            sign = self.take()
            self.depth += 1
            if self.depth > DEEPEST:
                raise Unreadable("too deep")
            made = self.signed()
            self.depth -= 1
            if sign == "+":
                return made
            return ("number", -made[1]) if made[0] == "number" else ("*", ("number", Fraction(-1)), made)
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        if self.peek()[1] == "^":
            self.take()
            return ("^", base, self.group() if self.peek()[1] == "{" else self.signed_atom())
        return base

    def signed_atom(self) -> tuple:
        return self.signed() if self.peek()[1] in ("+", "-") else self.power()

    def group(self) -> tuple:
        """{...}, or one bare token, of which a number gives its first digit."""
        if self.peek()[1] == "{":
            return self.closed("}")
        kind, got = self.peek()
        if kind == "number" and len(got) > 1 and got.isdigit():
            self.tokens[self.at : self.at + 1] = [("number", got[0]), ("number", got[1:])]
        return self.atom()

    def closed(self, end: str) -> tuple:
        self.take()
        made = self.sum()
        self.take(end)
        return made

    def atom(self) -> tuple:
        kind, got = self.peek()
        if kind == "number":
            return ("number", Fraction(self.take()))
        if kind == "letter":
            letter = self.take()
            if self.peek()[1] == "_":
                self.take()
                sub = self.group()
                letter += f"_{sub[1]}"
            return ("constant", letter) if letter in CONSTANTS else ("variable", letter)
        if got in ("(", "{", "["):
            return self.closed({"(": ")", "{": "}", "[": "]"}[got])
        if got == "|":
            return ("abs", self.closed("|"))
        if kind != "name":
            raise Unreadable(got or "nothing")
        name = self.take()
        if name == "pi":
            return ("constant", "pi")
        if name == "frac":
            top = self.group()
            return ("/", top, self.group())
        if name == "sqrt":
            index = self.closed("]") if self.peek()[1] == "[" else ("number", Fraction(2))
            inside = self.closed(")") if self.peek()[1] == "(" else self.group()
            return ("^", inside, ("/", ("number", Fraction(1)), index))
        inside = self.closed(")") if self.peek()[1] == "(" else self.group() if self.peek()[1] == "{" else self.power()
        return (name, inside)


def read(text: str) -> tuple:
    """The expression as nested tuples; Unreadable if it is none."""
    return _Reader(text).whole()


def _leaves(e: tuple, kind: str) -> set[str]:
    if e[0] == kind:
        return {e[1]}
    return set().union(*(_leaves(x, kind) for x in e[1:] if isinstance(x, tuple)))


def constant(e: tuple) -> Fraction:
    """The exact value of an expression of rational numbers; Inexact otherwise."""
    kind = e[0]
    if kind == "number":
        return e[1]
    if kind not in ("+", "*", "/", "^"):
        raise Inexact(kind)
    a, b = constant(e[1]), constant(e[2])
    if kind == "+":
        return a + b
    if kind == "*":
        return a * b
    if kind == "/":
        if not b:
            raise Unreadable("division by zero")
        return a / b
    if b.denominator != 1 or abs(b) > 64 or max(abs(a.numerator), a.denominator) > 1 << 64:
        raise Inexact("power")
    if not a and b < 0:
        raise Unreadable("division by zero")
    return a ** int(b)


def square_part(n: int) -> tuple[int, list[int]]:
    """(s, primes) with n = s * s * the product of different primes; for n up to RADICAND."""
    if not 0 < n <= RADICAND:
        raise Inexact("radicand")
    s, primes, q = 1, [], 2
    while q * q <= n:
        times = 0
        while n % q == 0:
            n, times = n // q, times + 1
        s *= q ** (times // 2)
        primes += [q] * (times % 2)
        q += 1 + (q > 2)
    return s, primes + [n] * (n > 1)


def _root(e: tuple) -> tuple[Fraction, list[int]] | None:
    """For a square root of a rational number: (r, primes), the value being r times the roots of the primes. None for other powers."""
    if e[0] != "^" or e[2] != ("/", ("number", Fraction(1)), ("number", Fraction(2))) and not (e[2][0] in ("number", "/") and _half(e[2])):
        return None
    value = constant(e[1])
    if value < 0:
        raise Inexact("negative radicand")
    if not value:
        return Fraction(0), []
    s, primes = square_part(value.numerator * value.denominator)
    return Fraction(s, value.denominator), primes


def _half(e: tuple) -> bool:
    try:
        return constant(e) == Fraction(1, 2)
    except ValueError:
        return False


def _primes(e: tuple) -> set[int]:
    """The primes under the roots of an expression; Inexact if it can't be evaluated modulo a prime."""
    if e[0] in ("number", "variable"):
        return set()
    if e[0] not in ("+", "*", "/", "^"):
        raise Inexact(e[0])
    found = _root(e)
    if found is not None:
        return set(found[1])
    if e[0] == "^":
        power = constant(e[2])
        if power.denominator != 1 or abs(power) > POWER:
            raise Inexact("power")
        return _primes(e[1])
    return _primes(e[1]) | _primes(e[2])


def _is_prime(n: int) -> bool:
    """Whether an odd number under 2**64 is a prime; these witnesses decide it."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


@functools.lru_cache(maxsize=4096)
def modulus(primes: tuple[int, ...]) -> tuple[int, dict[int, int]]:
    """A prime p = 3 modulo 4 in which all the given primes have square roots, and a root of each."""
    if len(primes) > 8:
        raise Inexact("many roots")
    p = _MODULUS
    while not (all(pow(q, (p - 1) // 2, p) == 1 for q in primes) and _is_prime(p)):
        p -= 4
    return p, {q: pow(q, (p + 1) // 4, p) for q in primes}


def _modular(e: tuple, at: dict[str, int], p: int, roots: dict[int, int]) -> int:
    kind = e[0]
    if kind == "number":
        return e[1].numerator * _inverse(e[1].denominator, p) % p
    if kind == "variable":
        return at[e[1]]
    found = _root(e)
    if found is not None:
        value = found[0].numerator * _inverse(found[0].denominator, p) % p
        for q in found[1]:
            value = value * roots[q] % p
        return value
    a = _modular(e[1], at, p, roots)
    if kind == "^":
        n = int(constant(e[2]))
        return pow(a if n >= 0 else _inverse(a, p), abs(n), p)
    b = _modular(e[2], at, p, roots)
    return (a + b) % p if kind == "+" else a * (b if kind == "*" else _inverse(b, p)) % p


def _inverse(a: int, p: int) -> int:
    if a % p == 0:
        raise Unreadable("division by zero")
    return 1 if a == 1 else pow(a, -1, p)


def value(e: tuple, at: dict[str, complex]) -> complex:
    """The expression's principal value in floating point."""
    kind = e[0]
    if kind == "number":
        return float(e[1])
    if kind == "variable":
        return at[e[1]]
    if kind == "constant":
        return CONSTANTS[e[1]]
    a = value(e[1], at)
    if kind in FUNCTIONS:
        return FUNCTIONS[kind](a)
    b = value(e[2], at)
    if kind == "^":
        return complex(a) ** b if isinstance(a, complex) or isinstance(b, complex) or a < 0 and b != int(b) else a**b
    return a + b if kind == "+" else a * b if kind == "*" else a / b


def _agree(evaluate: Callable[[tuple, dict], object], point: Callable[[random.Random], dict], a: tuple, b: tuple, same: Callable[[object, object], bool]) -> bool | None:
    """Whether both have equal values at POINTS points; None if no points with values were found."""
    rng, met = random.Random(20240), 0
    for _ in range(POINTS * TRIES):
        at = point(random.Random(rng.random()))
        try:
            x, y = evaluate(a, at), evaluate(b, at)
        except (ValueError, ZeroDivisionError, OverflowError, TypeError):
            continue
        if not same(x, y):
            return False
        met += 1
        if met == POINTS:
            return True
    return None


def _near(x: complex, y: complex) -> bool:
    return abs(x - y) <= 1e-9 * max(1e-6, abs(x), abs(y))


@functools.lru_cache(maxsize=65536)
def equal(a: str, b: str) -> bool | None:
    """Whether two expressions are identical as functions of their letters; None where that can't be told."""
    try:
        left, right = read(a), read(b)
    except (ValueError, RecursionError):
        return None
    names = sorted(_leaves(left, "variable") | _leaves(right, "variable"))
    try:
        p, roots = modulus(tuple(sorted(_primes(left) | _primes(right))))
    except Inexact:
        return _agree(value, lambda rng: {n: complex(rng.uniform(0.3, 2), rng.uniform(-1, 1)) for n in names}, left, right, _near)
    except ValueError:
        return None
    return _agree(lambda e, at: _modular(e, at, p, roots), lambda rng: {n: rng.randrange(p) for n in names}, left, right, lambda x, y: x == y)


def number(text: str) -> complex | None:
    """The value of an expression without variables; None for others."""
    try:
        made = read(text)
        if _leaves(made, "variable"):
            return None
        return value(made, {})
    except (ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None
