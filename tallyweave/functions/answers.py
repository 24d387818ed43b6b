"""Normal forms of short answers and their equality: as text, as numbers, part by part, as expressions.

`math_equal` is tolerant: numbers may differ a little or be percentages. `strict_equal` wants fractions as they are
written and whole numbers as whole numbers. Null equals nothing but in `latex_equal`, where two nulls are equal.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from tallyweave.functions import algebra

#: Replacements of the LaTeX normal form, in order, before and after what follows "\\text{ " is cut off.
FORM_PAIRS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
FORM_PAIRS_AFTER = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]
#: Replacements of the plain form, and units, with a plural and a power, that are dropped from it.
PLAIN_PAIRS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
#: Names of intervals with their brackets.
INTERVALS = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()"}
#: Exponents that the strict form doesn't evaluate.
NOT_EVALUATED = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")

_UNIT = re.compile(rf"(?:{'|'.join(UNITS)})(?:es)?s? *(?:\^[0-9]+)?")
_GROUPED = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")


# --- the LaTeX normal form ----------------------------------------------------------------


class _Unfinished(ValueError):
    """A command without its argument."""


def _argument_braces(s: str, command: str, count: int) -> str:
    """Braces around the one-character arguments that follow a command, up to `count` of them; a group of its own ends them."""
    if command not in s:
        return s
    out, owed = [], 0
    for token in re.findall(rf"{re.escape(command)}|.", s, re.S):
        if token == command:
            if owed:
                raise _Unfinished(s)
            owed = count
            out.append(token)
        elif owed and token != "{":
            owed -= 1
            out.append(f"{{{token}}}")
        else:
            owed = 0
            out.append(token)
    if owed:
        raise _Unfinished(s)
    return "".join(out)


def latex_form(s: str) -> str:
    """A LaTeX expression in normal form, for comparison as text.

    Spacing, sizes of brackets, degree, dollar and percent signs and units at the end vanish, decimals have a digit before
    their point, a name before the only equals sign goes, arguments of fractions and roots are in braces, and one half and
    quotients of two whole numbers are fractions.
    """
    for old, new in FORM_PAIRS:
        s = s.replace(old, new)
    head, unit, rest = s.partition("\\text{ ")
    if unit in rest and unit:
        raise _Unfinished(s)  # units stand once
    s = head
    for old, new in FORM_PAIRS_AFTER:
        s = s.replace(old, new)
    if s.startswith("."):
        s = f"0{s}"
    name, equals, value = s.partition("=")
    if equals and len(name) <= 2 and "=" not in value:
        s = value
    s = _argument_braces(s, "\\sqrt", 1).replace(" ", "")
    try:
        s = _argument_braces(s, "\\frac", 2)
    except _Unfinished:
        pass  # fractions stay as they are
    if s == "0.5":
        return "\\frac{1}{2}"
    top, slash, bottom = s.partition("/")
    return f"\\frac{{{top}}}{{{bottom}}}" if slash and _written_whole(top) and _written_whole(bottom) else s


def _written_whole(s: str) -> bool:
    """Whether s is a whole number as one writes it: no plus, no zeros in front."""
    digits = s.removeprefix("-")
    return digits.isdecimal() and digits.isascii() and (digits == "0" and s == "0" or digits[0] != "0")


def latex_equal(a: str | None, b: str | None) -> bool:
    """Equality of the normal forms; of the texts where one has none."""
    if a is None or b is None:
        return a is b
    try:
        return latex_form(a) == latex_form(b)
    except _Unfinished:
        return a == b


# --- tolerant equality --------------------------------------------------------------------


def _number(s: str) -> Fraction | None:
    s = _GROUPED.sub("", s.strip().strip("$").replace("\\%", "%").replace("{,}", ""))
    s = re.sub(r"^(\d+)_\{?\d+\}?$", r"\1", s)  # a base
    percent = s.endswith("%")
    s = re.sub(r"^(-?)\\[td]?frac\{(-?\d+)\}\{(-?\d+)\}$", r"\1\2/\3", s.rstrip("%"))
    mixed = re.fullmatch(r"(-?)(\d+)\s+(\d+)/(\d+)", s)
    try:
        value = (Fraction(int(mixed[2])) + Fraction(int(mixed[3]), int(mixed[4]))) * (-1 if mixed[1] else 1) if mixed else Fraction(s.replace(" ", "")) if len(s) < 400 else None
    except (ValueError, ZeroDivisionError):
        return None
    return value / 100 if percent and value is not None else value


def _near(a: float, b: float, tolerance: float) -> bool:
    return math.isclose(a, b, rel_tol=tolerance)


def elements(s: str) -> tuple[str, list[str], str]:
    """(opening bracket, elements, closing bracket) of a tuple, interval, point or list, split at its outermost commas; brackets are empty where there are none."""
    s = s.strip()
    for name, (left, right) in INTERVALS.items():
        if s.startswith(f"{name}(") and s.endswith(")"):
            s = left + s[len(name) + 1 : -1] + right
            break
    s = _GROUPED.sub("", s.removeprefix("Point"))
    outer = len(s) > 1 and s[0] in "([" and s[-1] in ")]" and _closes_last(s)
    inner = s[1:-1] if outer else s
    parts, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            parts.append(inner[at:i].strip())
            at = i + 1
    return (s[0] if outer else "", [*parts, inner[at:].strip()], s[-1] if outer else "")


def _closes_last(s: str) -> bool:
    """Whether the first bracket is closed by the last character; kinds of round and square brackets may mix."""
    depth = 0
    for i, c in enumerate(s):
        depth += (c in "([") - (c in ")]")
        if depth == 0:
            return i == len(s) - 1
    return False


def _matrix(s: str) -> list[list[str]] | None:
    """Rows of a matrix, written as an environment or as lists of lists."""
    m = re.fullmatch(r"(?:Matrix\()?\s*(?:\\begin\{[pbv]?matrix\}(.*)\\end\{[pbv]?matrix\}|(\[\s*\[.*\]\s*\]))\s*\)?", s.strip(), re.S)
    if m is None:
        return None
    if m[1] is not None:
        rows = [r for r in re.split(r"\\\\", m[1]) if r.strip()]
        return [[x.strip() for x in r.split("&")] for r in rows]
    return [elements(r)[1] for r in elements(m[2])[1]]


def math_equal(given: str | None, truth: str | None, tolerance: float = 1e-4, percent: bool = True) -> bool:
    """Equality of two answers.

    As text in normal form; as numbers within the tolerance, also as percentages; part by part as tuples, intervals, points,
    lists and matrices (brackets of tuples must agree); as expressions; as values of expressions within the tolerance.
    """
    if given is None or truth is None:
        return False
    if given.strip().lower() == truth.strip().lower() or latex_equal(given.strip(), truth.strip()):
        return True
    a, b = _number(given), _number(truth)
    if a is not None and b is not None:
        return any(_near(float(a), float(x), tolerance) for x in ((b / 100, b, b * 100) if percent else (b,)))
    rows, wanted = _matrix(given), _matrix(truth)
    if rows is not None and wanted is not None:
        return [len(r) for r in rows] == [len(r) for r in wanted] and all(math_equal(x, y, tolerance, percent) for r, w in zip(rows, wanted, strict=True) for x, y in zip(r, w, strict=True))
    (left, xs, right), (left_wanted, ys, right_wanted) = elements(given.replace("\\left", "").replace("\\right", "")), elements(truth.replace("\\left", "").replace("\\right", ""))
    if len(xs) > 1 or len(ys) > 1:
        return (left, right) == (left_wanted, right_wanted) and len(xs) == len(ys) and all(math_equal(x, y, tolerance, percent) for x, y in zip(xs, ys, strict=True))
    if algebra.equal(given, truth):
        return True
    x, y = algebra.number(given), algebra.number(truth)
    if x is None or y is None:
        return False
    return _near(x.real, y.real, tolerance) and _near(x.imag, y.imag, tolerance)


# --- strict equality ----------------------------------------------------------------------


def plain_form(s: str) -> str:
    """An answer as plain text: no wrappers, dollars, percent signs or units; fractions as a/b, mixed numbers as sums, whole numbers without a point."""
    wrapped = re.match(r"^\\text\{(.+?)\}$", s)
    s = wrapped[1] if wrapped else s
    for old, new in PLAIN_PAIRS:
        s = s.replace(old, new)
    s = re.sub(r"\^ *\\circ|,\\! *", "", _UNIT.sub("", s))
    if s.startswith("{") and s.endswith("}"):
        s = s[1:-1]
    if "\\" in s:
        s = s.replace("\\left", "").replace("\\right", "").replace("\\cdot", "*").replace("\\times", "*")
        s = re.sub(r"\\[td]?frac *\{?(\w+)\}? *\{?(\w+)\}?", r" \1/\2", re.sub(r"\\([td]?)frac(\d)(\d)", r"\\\1frac{\2}{\3}", s))
        s = re.sub(r"\\([A-Za-z]+)", r"\1", s).replace("{", "(").replace("}", ")")
    s = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", s.strip())).lower()
    whole = _GROUPED.sub("", s)
    return str(round(float(whole))) if _is_whole(whole) else s


def _is_whole(s: str) -> bool:
    try:
        value = float(_GROUPED.sub("", s))
    except ValueError:
        return False
    return math.isfinite(value) and abs(value - round(value)) <= 1e-7


def _evaluable(s: str) -> bool:
    """At most two different letters, but for roots and fractions, and no exponents of several digits or groups."""
    return len({c for c in s.replace("sqrt", "").replace("frac", "") if c.isalpha()}) <= 2 and not NOT_EVALUATED.search(s)


def strict_equal(given: str | None, truth: str | None) -> bool:
    """Equality in one of the normal forms, or element by element: fractions as written, whole numbers only with whole numbers, else as simple expressions."""
    if given is None or truth is None:
        return False
    bare = [re.sub(r"^\\text\{(.+?)\}$", r"\1", x.strip()) for x in (given, truth)]
    if latex_equal(*bare):
        return True
    a, b = plain_form(given), plain_form(truth)
    if a == b:
        return True
    if not a:
        return False
    (left, xs, right), (left_wanted, ys, right_wanted) = elements(a), elements(b)
    if len(xs) != len(ys) or len(ys) > 1 and (left, right) != (left_wanted, right_wanted):
        return False
    xs, ys = (xs, ys) if len(ys) > 1 else ([a], [b])
    for x, y in zip(xs, ys, strict=True):
        fractions = [re.fullmatch(r"-?\d+/0*[1-9]\d*", v) for v in (x, y)]
        if all(fractions):
            same = x == y
        elif _is_whole(x) != _is_whole(y):
            same = False
        else:
            same = x == y or (_evaluable(f"({y})-({x})") and bool(algebra.equal(x, y)))
        if not same:
            return False
    return True
