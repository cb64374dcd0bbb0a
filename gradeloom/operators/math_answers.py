"""Answers to mathematical questions: finding them in texts, and telling whether two are equal.

An answer is looked for in this order: the last boxed expression, what follows an announcement ("the final answer is"), the last
mathematics between dollar signs, the last fraction or root, the last number or arithmetic expression. Two answers are equal if their canonical texts are,
or if both have the same value: numbers, fractions, roots, powers, percentages and arithmetic are evaluated exactly where they are rational and
else as doubles; tuples, sets and intervals are compared part by part, equations by their right sides where the left is one name. There is
no computer algebra: expressions with variables are equal only as canonical texts.
"""

from __future__ import annotations

import ast
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ANNOUNCED = re.compile(r"(?i)(?:final answer|answer|result)\s*(?:is|:|=)+\s*:?\s*(.+?)(?:\.\s|\.?$|\n)", re.M)
_DOLLARS = re.compile(r"\$\$?([^$]+)\$\$?|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_NUMBER = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|-?\.\d+"
_ARITHMETIC = re.compile(rf"(?:{_NUMBER})(?:\s*[-+*/^×÷]\s*\(?(?:{_NUMBER})\)?)*\s*\\?%?")
_COMMAND = re.compile(r"-?\d*\s*\\(?:[dtc]?frac\s*(?:\{[^{}]*\}|\w)\s*(?:\{[^{}]*\}|\w)|sqrt(?:\[\d+\])?\s*(?:\{[^{}]*\}|\w))")


def group(text: str, at: int) -> int:
    """The end of the braces that open at ``at``; the text's end if they never close."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    return len(text)


def boxed(text: str) -> str | None:
    """What the last \\boxed or \\fbox holds."""
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if at < 0:
        return None
    k = at + (6 if text.startswith("\\boxed", at) else 5)
    if k < len(text) and text[k] == "{":
        return text[k + 1 : group(text, k) - 1]
    found = re.match(r"\s*([^\s$]+)", text[k:])
    return found[1] if found else None


def extract(text: str | None) -> str | None:
    """The answer that a text gives, as it stands there."""
    text = text or ""
    if (found := boxed(text)) is not None:
        return found.strip()
    if announced := _ANNOUNCED.findall(text):
        inner = [next(filter(None, m)) for m in _DOLLARS.findall(announced[-1])]
        numbers = _ARITHMETIC.findall(announced[-1])
        return (inner or numbers or announced)[-1].strip()
    if dollars := [next(filter(None, m)) for m in _DOLLARS.findall(text)]:
        return dollars[-1].strip()
    numbers = _COMMAND.findall(text) or _ARITHMETIC.findall(text)
    return numbers[-1].strip() if numbers else None


#: What carries no value, and what other signs stand for.
_DROPPED = ("\\!", "\\,", "\\;", "\\:", "\\ ", "\\left", "\\right", "\\displaystyle", "^{\\circ}", "^\\circ", "\\$", "$", "\\mathrm", "\\rm", "\n")
_SAME = (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cfrac", "\\frac"), ("\\times", "*"), ("\\cdot", "*"), ("×", "*"), ("\\div", "/"), ("÷", "/"), ("−", "-"), ("\\%", "%"), ("\\{", "("), ("\\}", ")"), ("\\infty", "∞"), ("\\pi", "π"))


def canonical(answer: str) -> str:
    """One spelling: no spacing, units, degree and dollar signs; fractions and roots with braces; plain numbers without thousands commas and needless zeros."""
    s = answer.strip().rstrip(".")
    for x in _DROPPED:
        s = s.replace(x, "")
    for a, b in _SAME:
        s = s.replace(a, b)
    s = re.sub(r"\\(?:text|mbox|textbf|mathbf)\s*\{\s*([^}]*)\}", lambda m: "" if re.search(r"\d|\\frac", s[: m.start()]) else m[1], s)  # a unit after a number, else a word
    s = re.sub(r"\\frac\s*([0-9a-zπ])\s*([0-9a-zπ])", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac\s*([0-9a-zπ])\s*\{", r"\\frac{\1}{", s)
    s = re.sub(r"(\\frac\s*\{[^{}]*\})\s*([0-9a-zπ])", r"\1{\2}", s)
    s = re.sub(r"\\sqrt\s*([0-9a-zπ])", r"\\sqrt{\1}", s)
    s = re.sub(r"\s+", "", s)
    if re.fullmatch(r"[^=]{1,2}=[^=]+", s):  # "x=5"
        s = s.split("=")[1]
    s = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", s) if not s.startswith(("(", "[")) else s
    s = re.sub(r"(?<![\d.])\.(?=\d)", "0.", s)
    s = re.sub(r"(\d+)\.0+(?!\d)", r"\1", s)
    return s


def _braced(s: str, at: int) -> tuple[str, int]:
    if at < len(s) and s[at] == "{":
        end = group(s, at)
        return s[at + 1 : end - 1], end
    return s[at : at + 1], at + 1


def _arithmetic(s: str) -> str | None:
    """LaTeX of numbers as an expression of + - * / ** and sqrt(); None where it holds anything else."""
    out, i = "", 0
    while i < len(s):
        if s.startswith("\\frac", i):
            a, i = _braced(s, i + 5)
            b, i = _braced(s, i)
            a, b = _arithmetic(a), _arithmetic(b)
            if a is None or b is None:
                return None
            out += ("+" if re.search(r"\d$", out) else "") + f"(({a})/({b}))"  # "1\frac{1}{2}" is a mixed number
        elif s.startswith("\\sqrt", i):
            i += 5
            degree = "2"
            if s.startswith("[", i):
                end = s.find("]", i)
                degree, i = s[i + 1 : end], end + 1
            a, i = _braced(s, i)
            if (a := _arithmetic(a)) is None or not degree.isdigit():
                return None
            out += ("*" if re.search(r"[\d)]$", out) else "") + f"root({a},{degree})"
        elif s[i] == "^":
            a, i = _braced(s, i + 1)
            if (a := _arithmetic(a)) is None:
                return None
            out += f"**({a})"
        elif s[i] == "π":
            out += ("*" if re.search(r"[\d)]$", out) else "") + "pi"
            i += 1
        elif s[i] in "0123456789.+-*/()":
            out += ("*" if re.search(r"\)$|pi$", out) and (s[i].isdigit() or s[i] == "(") or s[i] == "(" and re.search(r"\d$", out) else "") + s[i]
            i += 1
        else:
            return None
    return out


def _evaluated(node: ast.AST):
    """Fractions where it is rational, else doubles. Large powers give up."""
    if isinstance(node, ast.Expression):
        return _evaluated(node.body)
    if isinstance(node, ast.Constant):
        return Fraction(str(node.value))
    if isinstance(node, ast.Name) and node.id == "pi":
        return math.pi
    if isinstance(node, ast.UnaryOp):
        v = _evaluated(node.operand)
        return -v if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.BinOp):
        a, b = _evaluated(node.left), _evaluated(node.right)
        if isinstance(node.op, ast.Pow):
            if abs(b) > 64 or abs(a) > 10**12:
                raise ValueError("a large power")
            return a**b if isinstance(b, Fraction) and b.denominator == 1 else float(a) ** float(b)
        return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b}[type(node.op)]()
    if isinstance(node, ast.Call):
        a, d = map(_evaluated, node.args)
        if a < 0:
            raise ValueError("the root of a negative number")
        root = round(float(a) ** (1 / float(d)))
        return Fraction(root) if root ** int(d) == a else float(a) ** (1 / float(d))
    raise ValueError("not arithmetic")


def value(answer: str) -> Fraction | float | None:
    """A number's value; a percentage's is a hundredth."""
    s = canonical(answer)
    hundredth = s.endswith("%")
    s = s.rstrip("%")
    expression = _arithmetic(s)
    if not expression or len(expression) > 400:
        return None
    try:
        v = _evaluated(ast.parse(re.sub(r"\b0+(?=\d)", "", expression), mode="eval"))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, KeyError, TypeError, RecursionError):
        return None
    if isinstance(v, complex):
        return None
    return v / 100 if hundredth else v


def _parts(s: str) -> list[str] | None:
    """The members of a tuple, set or interval, or of a bare list, with its brackets as members."""
    wrapped = s[:1] in "([" and s[-1:] in ")]" and s[:1] != ""
    inner, depth, out = s[1:-1] if wrapped else s, 0, [""]
    for c in inner:
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return None
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [s[0], *out, s[-1]] if wrapped and len(out) > 1 else out if len(out) > 1 else None


def equal(a: str | None, b: str | None, tolerance: float = 1e-6) -> bool:
    """Whether two answers, as extracted, are the same."""
    if a is None or b is None:
        return False
    x, y = canonical(a), canonical(b)
    if x == y or x.lower() == y.lower() and not any(c.isdigit() for c in x):
        return x != ""
    p, q = _parts(x), _parts(y)
    if p and q:
        return len(p) == len(q) and all(u == v if u in "([)]" or v in "([)]" else equal(u, v, tolerance) for u, v in zip(p, q, strict=True))
    if p or q:
        return False
    u, v = value(a), value(b)
    if u is None or v is None:
        return False
    if isinstance(u, Fraction) and isinstance(v, Fraction) and u == v:
        return True
    return math.isclose(float(u), float(v), rel_tol=tolerance, abs_tol=1e-12) or a.strip().endswith("%") != b.strip().endswith("%") and any(math.isclose(float(u) * k, float(v), rel_tol=tolerance) for k in (100, 0.01))


def extracted(text: Column) -> Column:
    return F.pandas_udf(_extracts, "string")(text)


def _extracts(s: pd.Series) -> pd.Series:
    return pd.Series([extract(x) for x in s], dtype="object")


def matches(gold: Column, prediction: Column) -> Column:
    """1 if the answer that a prediction gives equals the gold one; golds may be whole solutions."""
    return F.pandas_udf(_matches, "double")(gold, prediction)


def _matches(gold: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([float(equal(extract(g) or g, extract(p))) for g, p in zip(gold, prediction, strict=True)])


def solved_share(gold: Column, predictions: Column) -> Column:
    """The share of several sampled predictions that match: pass@1 of n samples. Null without any."""
    return F.pandas_udf(_shares, "double")(gold, predictions)


def _shares(gold: pd.Series, predictions: pd.Series) -> pd.Series:
    out = []
    for g, ps in zip(gold, predictions, strict=True):
        want = extract(g) or g
        out.append(sum(equal(want, extract(p)) for p in ps) / len(ps) if ps is not None and len(ps) and g is not None else None)
    return pd.Series(out, dtype="float64")


def fail_rate(gold: Column, predictions: Column) -> Column:
    return 1 - solved_share(gold, predictions)
