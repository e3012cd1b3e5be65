"""Matching and context as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns match without case and line by line.
FLAGS = "(?im)"


def group_of(pattern: str) -> int:
    """The group that holds a rule's value: the first if the pattern has groups, else the whole match."""
    return 1 if re.compile(pattern).groups else 0


def required(pattern: str) -> list[str]:
    """Lower-case strings of which a text must hold one, in any case, for the pattern to match; none if there are no such strings of 3 or more characters.

    A test for them by plain search costs a fraction of a regular expression.
    """
    from re import _constants as op
    from re import _parser

    def of(parts) -> list[str]:
        best: list[str] = []
        run = ""

        def keep(found: list[str]) -> None:
            nonlocal best
            if found and min(map(len, found)) >= 3 and len(found) <= 8 and (not best or min(map(len, found)) > min(map(len, best))):
                best = found

        for what, value in [*parts, (None, None)]:
            if what is op.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            keep([run] if run else [])
            run = ""
            if what is op.SUBPATTERN:
                keep(of(value[3]))
            elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                keep(of(value[2]))
            elif what is op.BRANCH:
                each = [of(x) for x in value[1]]
                keep([s for x in each for s in x] if all(each) else [])
        return best

    try:
        return of(_parser.parse(pattern))
    except re.error:  # a form of Java's that Python hasn't
        return []


#: A border of words of ASCII letters, digits and _; Java's own \b takes all letters, before release 19.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: What RE2 takes for a letter, besides its other case, where case doesn't count.
FOLDED = {"s": r"\u017f", "k": r"\u212a"}


def as_re2(pattern: str) -> str:
    """The pattern so that Java reads it as RE2 does: ASCII words and white space (without \\v), and the two other forms of letters without case.

    For patterns without a bare dot, $ and nested classes, which the two read in different ways too.
    """
    fold = pattern.startswith("(?i)")
    others = lambda first, last: "".join(o for c, o in FOLDED.items() if fold and (first <= c <= last or first <= c.upper() <= last))
    word = r"\w" + others("a", "z")

    def of(m: re.Match) -> str:
        whole, escaped, opening, first, last = m.group(0, 1, 2, 3, 4)
        if escaped == "b":
            return EDGE
        if escaped in ("s", "w"):
            return "[" + (r"\t\n\f\r " if escaped == "s" else word) + "]"
        if escaped or opening or not others(first, first):
            return whole
        return f"[{first}{others(first, first)}]"

    def inside(m: re.Match) -> str:
        whole, escaped, first, last = m.group(0, 1, 2, 3)
        if escaped:
            return {"s": r"\t\n\f\r ", "w": word}.get(escaped, whole)
        return whole + others(first, last or first)

    # Before a digit there is one kind of border, and most places fail at once.
    begin = re.match(r"(\(\?i\))?\\b(?=\\d|\(\?:\\d[^|)]*\))", pattern)
    out = [(begin[1] or "") + r"(?=\d)(?<!\w)"] if begin else []
    for part in re.findall(r"\[\^?(?:\\.|[^\]\\])+\]|(?:\\.|[^\[\\])+", pattern[begin.end() :] if begin else pattern, re.S):
        if part[0] == "[":
            head = 2 if part[1] == "^" else 1
            out.append(part[:head] + re.sub(r"(?s)\\(.)|([^\\])(?:-([^\\]))?", inside, part[head:-1]) + "]")
        else:
            out.append(re.sub(r"(?s)\\(.)|(\(\?(?:[a-z]+\)|<?[=!]|:))|(.)()", of, part))
    return "".join(out)


#: Running sums over matches are taken in stretches of so many, and characters around a match from pieces of so many.
STRETCH, PIECE = 256, 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, where it stands inside a function of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str | Column, group: int | Column | None = None, around: int = 0) -> Column:
    """array<struct<value, start, stop, line, column, before, whole, after, more>> of all matches.

    start and stop count characters from 0, line counts from 1, column characters
    from 0 within the line; before and after are up to `around` characters on both sides of the whole match, and more tells
    whether the text goes on beyond after.

    Spark's regex functions give no offsets. The stretches between matches are what
    split() leaves, so offsets and lines are running sums over both, taken by
    stretches of matches; what stands around a match is cut from a piece of the text.
    Time is all but linear in matches and text. A pattern given as text gets its
    flags here; one given as a Column has them.
    """
    if isinstance(pattern, str):
        group = group_of(pattern) if group is None else group
        pattern = F.lit(FLAGS + pattern)
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    # tail: characters since the last line began.
    both = lambda a, b: F.struct((a["chars"] + b["chars"]).alias("chars"), (a["lines"] + b["lines"]).alias("lines"), F.when(b["lines"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"))
    size = lambda s: F.struct(F.length(s).alias("chars"), lines(s).alias("lines"), F.length(F.substring_index(s, "\n", -1)).alias("tail"))
    none = F.struct(*(F.lit(0).alias(c) for c in ("chars", "lines", "tail")))
    total = lambda steps, first, n: F.aggregate(F.slice(steps, first, n), none, both)
    found = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(group) if isinstance(group, int) else group).alias("value"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def stepped(f: Column) -> Column:
        sizes, gaps = F.transform(f["whole"], size), F.transform(f["gaps"], size)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, both)
        return F.struct(f["whole"].alias("whole"), f["value"].alias("value"), gaps.alias("gaps"), steps.alias("steps"))

    def summed(f: Column) -> Column:
        last = F.floor(F.size(f["steps"]) / STRETCH).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda k: total(f["steps"], k * STRETCH + 1, F.lit(STRETCH)))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)) if around else F.lit(None).cast("array<string>")
        return F.struct(f["whole"].alias("whole"), f["value"].alias("value"), f["gaps"].alias("gaps"), f["steps"].alias("steps"), sums.alias("sums"), pieces.alias("pieces"), F.length(text).alias("end"))

    def window(f: Column, first: Column, last: Column) -> Column:
        if not around:
            return F.lit("")
        k = F.floor(first / PIECE).cast("int")
        joined = F.array_join(F.slice(f["pieces"], k + 1, F.floor(F.greatest(last - 1, first) / PIECE).cast("int") - k + 1), "")
        return F.when(last > first, F.substring(joined, first - k * PIECE + 1, last - first)).otherwise("")

    def placed(f: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            k = F.floor(i / STRETCH).cast("int")
            before = both(both(total(f["sums"], F.lit(1), k), total(f["steps"], k * STRETCH + 1, i - k * STRETCH)), F.element_at(f["gaps"], i + 1))
            return bound(before, lambda at: at_place(v, F.element_at(f["whole"], i + 1), at))

        def at_place(v: Column, whole: Column, at: Column) -> Column:
            start, stop = at["chars"], at["chars"] + F.length(whole)
            return F.struct(
                v.alias("value"), start.alias("start"), stop.alias("stop"), (at["lines"] + 1).alias("line"), at["tail"].alias("column"),
                window(f, F.greatest(F.lit(0), start - around), start).alias("before"), whole.alias("whole"), window(f, stop, F.least(f["end"], stop + around)).alias("after"),
                (stop + around < f["end"]).alias("more"),
            )

        return F.transform(f["value"], one)

    return bound(found, lambda f: bound(stepped(f), lambda g: bound(summed(g), placed)))


def line_of(text: Column, start: Column) -> Column:
    """Line number of a character offset, from 1."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(m: Column, radius: int = 80) -> Column:
    """Of a match taken with `around` at least radius: it and `radius` characters on both sides, on one line, with marks where it is cut."""
    body = F.concat(F.right(m["before"], F.lit(radius)), m["whole"], F.left(m["after"], F.lit(radius)))
    more = m["more"] | (F.length(m["after"]) > radius)
    return F.concat(F.when(m["start"] > radius, "...").otherwise(""), F.replace(body, F.lit("\n"), F.lit(" ")), F.when(more, "...").otherwise(""))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty or null text."""
    chars = F.split(text, "")
    total = F.length(text)

    def part(c: Column) -> Column:
        p = (total - F.length(F.replace(text, c, F.lit("")))) / total
        return -p * F.log2(p)

    return F.when(F.length(text) > 0, F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, part(c)).otherwise(0.0))).otherwise(0.0)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is part of the text."""
    return text.rlike("|".join(map(quoted, words)))


def quoted(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def sql_literal(s: str) -> str:
    """A string literal of Spark SQL. Long lists of literals are cheaper to build as one SQL expression."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(column: str, table: dict[str, object]) -> Column:
    """The value of a fixed table by a column; null for what it doesn't have."""
    if not table:
        return F.lit(None)
    show = lambda v: sql_literal(v) if isinstance(v, str) else "null" if v is None else str(v)
    return F.expr(f"case {column} " + " ".join(f"when {sql_literal(k)} then {show(v)}" for k, v in table.items()) + " end")
