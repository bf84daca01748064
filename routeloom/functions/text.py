"""Text features as Column expressions; nothing leaves the JVM.

Java's word boundary and white space differ from Python's, so both are spelled out.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.contracts import SPACES

#: What marks the kinds of request, segments and digits.
WORD = r"[\p{L}\p{N}_]"
KEYWORDS = ("def", "class", "import", "return", "select")
#: A keyword by itself, in a folded text; what is beside it is looked at last, as that is the slow part.
KEYWORD = "(?=[{0}])(?:{1})(?!{2})(?<!{2}(?:{1}))".format("".join(sorted({w[0] for w in KEYWORDS})), "|".join(KEYWORDS), WORD)
CODE_WORDS = ("```", "python", "sql", "代码", "编程")
MATH = ("=", "+", "*", "/", "^", r"\frac", r"\sum", r"\sqrt", *"∑∫√≤≥×÷")
MATH_WORDS = ("计算", "求解", "证明", "概率", "方程", "几何", "数列")
TRANSLATION_WORDS = ("translate", "翻译", "译成", "译为")
SUMMARY_WORDS = ("summari", "摘要", "总结", "概括", "提炼")
#: What isn't ASCII and is equal to an ASCII letter without regard to case, and these letters.
FOLDS, FOLDED = "ſıİ\u212a", "siik"
SEGMENT = r"[㐀-鿿]|[A-Za-z_]+|\p{Nd}+(?:\.\p{Nd}+)?"
#: The same for texts that are ASCII.
ASCII_SEGMENT = r"[A-Za-z_]+|[0-9]+(?:\.[0-9]+)?"
ASCII_SPACES = "".join(c for c in SPACES if c.isascii())
#: Most characters that are neither white space nor digits, turned away by one look before a class of many ranges is gone through.
NO_SPACE = r"(?![!-~\x{A1}-\x{FF}])"
NO_DIGIT = r"(?![\x00-/:-\x{B1}\x{B4}-\x{B8}\x{BA}-\x{FF}])"
DIGIT = (
    r"[\p{Nd}\x{00B2}-\x{00B3}\x{00B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"
    r"\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)


def strip(text: Column) -> Column:
    """The text without white space at its ends, as Python strips it."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Whether the text is null or white space only; reading ends at the first other character."""
    return F.coalesce(~text.rlike(f"[^{SPACES}]"), F.lit(True))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: it becomes a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(text: Column) -> Column:
    """Lower-cased, so that words of ASCII are found without regard to case; the slow replacing is for texts that need it."""
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in FOLDS])
    return F.lower(F.when(is_ascii(text), text).when(odd, F.translate(text, FOLDS, FOLDED)).otherwise(text))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text; those that aren't ASCII are only looked for in texts that aren't either."""

    def among(some: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in some], F.lit(False))

    return among([w for w in words if w.isascii()]) | (~is_ascii(text) & among([w for w in words if not w.isascii()]))


def _codes(low: Column) -> Column:
    """Whether a folded text has a mark of code. Words are looked for as bytes; the pattern is for texts that have a keyword somewhere."""
    return has_any(low, CODE_WORDS) | (has_any(low, KEYWORDS) & low.rlike(KEYWORD))


def is_code(text: Column) -> Column:
    return bound(text, lambda own: bound(folded(own), _codes))


def is_math(text: Column) -> Column:
    return has_any(text, MATH)


def task_type_hint(text: Column) -> Column:
    """What kind of request a text seems to be; the first that fits of code, translation, summary, math, and else qa."""

    def of(own: Column, low: Column) -> Column:
        hint = F.when(_codes(low), "code").when(has_any(low, TRANSLATION_WORDS), "translation").when(has_any(low, SUMMARY_WORDS), "summary")
        return hint.when(is_math(own) | has_any(own, MATH_WORDS), "math").otherwise("qa")

    return bound(text, lambda own: bound(folded(own), lambda low: of(own, low)))


STRUCTURAL = ("log_length", "log_segments", "has_code", "has_digit", "has_math")


def structural_features(text: Column) -> dict[str, Column]:
    """The five structural features of the stripped text, as doubles."""
    t = strip(text)
    segments = F.when(is_ascii(t), F.regexp_count(t, F.lit(ASCII_SEGMENT))).otherwise(F.regexp_count(t, F.lit(SEGMENT)))
    digit = F.when(is_ascii(t), t.rlike("[0-9]")).otherwise(t.rlike(NO_DIGIT + DIGIT))
    values = (F.log1p(F.length(t)), F.log1p(segments), is_code(t), digit, is_math(t))
    return {name: value.cast("double") for name, value in zip(STRUCTURAL, values)}


def normalised(text: Column) -> Column:
    """Stripped and lower-cased, with each run of two or more white-space characters made one blank."""

    def joined(low: Column) -> Column:
        # White space that isn't ASCII makes the class slow, so most other characters are turned away before it.
        return F.when(is_ascii(low), F.regexp_replace(low, f"[{ASCII_SPACES}]{{2,}}", " ")).otherwise(F.regexp_replace(low, f"{NO_SPACE}[{SPACES}]{{2,}}", " "))

    return bound(F.lower(strip(text)), joined)


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` characters of the normalised text, repeats included.

    The text is split into characters once. Runs of n characters are those of n - 1 with the next
    character after each, so every run is one concatenation.
    """

    def longer(chars: Column, shorter: Column, n: int) -> Column:
        many = F.size(chars) - n + 1
        made = F.zip_with(F.slice(shorter, F.lit(1), many), F.slice(chars, F.lit(n), many), lambda a, b: F.concat(a, b))
        return F.when(many >= 1, made).otherwise(F.array().cast("array<string>"))

    def runs(chars: Column, last: Column, n: int, made: list[Column]) -> Column:
        made = [*made, last] if n >= low else made
        return F.concat(*made) if n == high else bound(longer(chars, last, n + 1), lambda own: runs(chars, own, n + 1, made))

    return bound(F.filter(F.split(normalised(text), ""), lambda c: c != ""), lambda chars: runs(chars, chars, 1, []))
