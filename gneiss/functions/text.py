"""Text functions on columns. What Java's regular expressions can say stays in the JVM; the rest is an Arrow UDF that gets
only the rows that need it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and what they become.
CHARACTERS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", "—": "-", "‒": "-", "−": "-",
    "•": "-", "·": "-", "●": "-", "▪": "-", "‣": "-",
    " ": " ", " ": " ", " ": " ", " ": " ", "​": "",
    "…": "...", "ﬁ": "fi", "ﬂ": "fl", "﻿": "", "­": "",
}
#: Text that the JVM alone can clean: ASCII without emphasis marks, backslashes or words broken at a line's end.
SLOW = r"[^\x00-\x7F]|[*_\\]|\w-\n\w"
#: White space at which Python strips.
ENDS = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: How lines that carry structure begin, by what they are.
OPENERS = {
    "sigil": r"![A-Z](\s|$)", "heading": "#{1,6} ", "bullet": "[-*+] ", "item": r"\d+[.)]? ", "quote": "> ", "fence": "`{3,}", "magic": "%[A-Z]{3}",
}
STRUCTURE = "|".join(OPENERS.values())
CURRENCY = "$€£¥"
#: Words, and symbols one by one.
TERM = r"[\p{L}\p{N}\p{M}]+|\p{S}"
SENTENCE_END = r"[.!?](\s|$)"

_table = str.maketrans(CHARACTERS)
_special = re.compile("[" + "".join(CHARACTERS) + "]")
#: What the scanner for emphasis looks at: escaped characters, runs of marks.
_marks = re.compile(r"\\.|\*+|_+", re.S)
ESCAPABLE = frozenset("\\`*_{}[]()#+-.!|>~")


def without_emphasis(s: str) -> str:
    """Pairs of marks around text go. A run of stars opens before text and closes after it; a closing run takes marks from
    the open runs before it, the last first. A run of underscores counts only outside words and around several words, up
    to the next such run, which must be as long. Escaped marks are text."""
    runs = [[m.start(), m.end(), 0, 0] for m in _marks.finditer(s) if m[0][0] != "\\"]  # start, stop, marks off its left and right
    stars: list[list[int]] = []
    last: list[int] | None = None
    for r in runs:
        i, j = r[0], r[1]
        before, after = s[i - 1 : i], s[j : j + 1]
        opens, closes = bool(after) and not after.isspace(), bool(before) and not before.isspace()
        if s[i] == "*":
            while closes and stars and r[2] < j - i:
                o = stars[-1]
                free = o[1] - o[0] - o[2] - o[3]
                n = min(free, j - i - r[2])
                o[3] += n
                r[2] += n
                if n == free:
                    stars.pop()
            if opens and r[2] < j - i:
                stars.append(r)
            continue
        word = lambda c: c.isalnum()
        if word(before) and word(after):
            continue
        if closes and not word(after) and last and last[1] - last[0] == j - i <= 3 and any(c.isspace() for c in s[last[1] : i]):
            last[3] = r[2] = j - i
            last = None
        else:
            last = r if opens and not word(before) else None
    out, at = [], 0
    for i, j, left, right in runs:
        out += [s[at:i], s[i + left : j - right]]
        at = j
    return "".join(out) + s[at:]


def clean_string(s: str | None, emphasis: bool = True) -> str:
    """The cheapest spelling of a text that says the same: plain quotes, dashes and spaces, no emphasis marks."""
    if not s:
        return ""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        if _special.search(s):
            s = s.translate(_table)
    if "-\n" in s:
        head, *parts = s.split("-\n")
        for part in parts:
            whole = head[-1:].isalnum() and part[:1].isalnum() or head[-1:] == "_" or part[:1] == "_"
            head += part if whole and head and part else "-\n" + part
        s = head
    if emphasis and ("*" in s or "_" in s):
        s = without_emphasis(s)
    if "\\" in s:
        s = _marks_or_escapes.sub(lambda m: m[1] if m[1] in ESCAPABLE else m[0], s)
    if "  " in s or "\t" in s:
        s = _blanks.sub(" ", s)
    return s.strip()


_marks_or_escapes = re.compile(r"\\(.)", re.S)
_blanks = re.compile(r"[ \t]+")


def plain_number(v: str) -> str:
    """A number without thousands commas, one in brackets with a minus; any other text as it is."""
    s = v.strip()
    sign = ""
    bracket = s.startswith("(") and s.endswith(")")
    if bracket:
        sign, s = "-", s[1:-1].strip()
    elif s.startswith(("+", "-")):
        sign, s = s[0].strip("+"), s[1:].strip()
    mark = s[:1] if s[:1] and s[:1] in CURRENCY else ""
    s = s[len(mark) :].strip()
    percent = "%" if s.endswith("%") and not bracket else ""
    s = s[: len(s) - len(percent)].strip()
    whole, dot, rest = s.partition(".")
    digits = whole.replace(",", "")
    if not digits.isdecimal() or dot and not rest.isdecimal():
        return v
    return sign + mark + digits + dot + rest + percent


def unit_mark(v: str) -> str | None:
    """The currency or percent sign of a cell that holds a number and one such sign."""
    s = v[1:] if v.startswith("-") else v
    if s[:1] and s[:1] in CURRENCY:
        mark, s = s[0], s[1:]
        s = s[1:] if s.startswith("-") and not v.startswith("-") else s
    elif s.endswith("%"):
        mark, s = "%", s[:-1]
    else:
        return None
    return mark if s and not s.strip("0123456789.") else None


@F.pandas_udf(T.StringType())
def _clean(s: pd.Series) -> pd.Series:
    return s.map(clean_string, na_action="ignore")


def clean_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    slow = c.rlike(SLOW)
    fast = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), ENDS, "")
    return F.when(slow, _clean(F.when(slow, c))).otherwise(fast)


def _after(c: Column, n) -> Column:
    return F.substring(c, n + 1, 1 << 30) if isinstance(n, int) else F.substr(c, n + F.lit(1))


def normalize_number(c: Column) -> Column:
    """plain_number on a column, by the same steps."""
    s = F.btrim(c)
    bracket = s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
    signed = ~bracket & (s.startswith("+") | s.startswith("-"))
    sign = F.when(bracket | s.startswith("-"), "-").otherwise("")
    s = F.btrim(F.when(bracket, F.substr(s, F.lit(2), F.length(s) - 2)).when(signed, _after(s, 1)).otherwise(s))
    mark = F.when(F.left(s, F.lit(1)).isin(*CURRENCY), F.left(s, F.lit(1))).otherwise("")
    s = F.btrim(_after(s, F.length(mark)))
    percent = F.when(s.endswith("%") & ~bracket, "%").otherwise("")
    s = F.btrim(F.left(s, F.length(s) - F.length(percent)))
    return F.when(s.rlike(r"^,*[0-9][0-9,]*([.][0-9]+)?$"), F.concat(sign, mark, F.translate(s, ",", ""), percent)).otherwise(c)


def mark_of(c: Column) -> Column:
    """unit_mark on a column."""
    minus = c.startswith("-")
    s = F.when(minus, _after(c, 1)).otherwise(c)
    first = F.left(s, F.lit(1))
    money = first.isin(*CURRENCY)
    rest = F.when(money & ~minus & F.substring(s, 2, 1).eqNullSafe("-"), _after(s, 2)).when(money, _after(s, 1)).when(s.endswith("%"), F.left(s, F.length(s) - 1))
    return F.when(rest.rlike("^[0-9.]+$"), F.when(money, first).otherwise("%"))


def normalize_cell(c: Column) -> Column:
    return normalize_number(clean_text(c))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n\t\x0b\x0c\x1c-\x1e\x85  ]+", " ")


def looks_structural(c: Column) -> Column:
    return c.rlike(rf"^(?:{STRUCTURE})")


def needs_escape(c: Column) -> Column:
    """Structure, or bangs before structure."""
    return c.rlike(rf"^!*(?:{STRUCTURE})")


def escape_body(c: Column) -> Column:
    one = one_line(c)
    return F.when(needs_escape(one), F.concat(F.lit("!"), one)).otherwise(one)


def unescape_body(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(c.startswith("!") & needs_escape(rest), rest).otherwise(c)


def quote_cell(c: Column) -> Column:
    one = one_line(c)
    return F.when(one == "", F.lit('""')).when(one.rlike('[ "]'), F.concat(F.lit('"'), F.replace(one, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(one)


def escape_caret(c: Column) -> Column:
    return F.when(c.rlike(r"^\^+$"), F.concat(c, F.lit("^"))).otherwise(c)


def unescape_caret(c: Column) -> Column:
    return F.when(c.rlike(r"^\^{2,}$"), F.substring(c, 2, 1 << 30)).otherwise(c)


def code_fence(c: Column) -> Column:
    """Backticks, three at least and more than any run in the text."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def bounded_count(c: Column, phrase: str) -> Column:
    """How often a phrase occurs with white space or an end on either side."""
    return F.regexp_count(c, F.lit(rf"(?U)(?<!\S)\Q{phrase}\E(?!\S)"))


def bounded_replace(c: Column, phrase: str, by: str) -> Column:
    return F.regexp_replace(c, rf"(?U)(?<!\S)\Q{phrase}\E(?!\S)", by.replace("\\", "\\\\").replace("$", "\\$"))
