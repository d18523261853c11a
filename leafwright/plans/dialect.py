"""Expressions that Spark and the oracle database both understand.

Operators state their columns once, as functions from a dialect to SQL text.
``apply`` adds them to a DataFrame, where Catalyst sees plain expressions;
``render`` writes them as common table expressions for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame


def _openings(items, at: int = 0) -> set[str] | None:
    """What may stand first in a match, as parts of a character class; None if that is not known or nothing need stand there."""
    if at == len(items):
        return None
    kind, own = items[at]
    if kind is sre.AT:
        return _openings(items, at + 1)
    if kind is sre.LITERAL:
        return {re.escape(chr(own))}
    if kind is sre.IN:
        parts = set()
        for k, v in own:
            if k is sre.LITERAL:
                parts.add(re.escape(chr(v)))
            elif k is sre.RANGE:
                parts.add("-".join(re.escape(chr(c)) for c in v))
            elif k is sre.CATEGORY and v in (sre.CATEGORY_DIGIT, sre.CATEGORY_SPACE):
                parts.add("0123456789" if v is sre.CATEGORY_DIGIT else r"\s")
            else:
                return None
        return parts
    if kind is sre.SUBPATTERN:
        return _openings([*own[3], *items[at + 1 :]])
    if kind is sre.BRANCH:
        found = [_openings([*branch, *items[at + 1 :]]) for branch in own[1]]
        return None if None in found else set().union(*found)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, _, what = own
        inside, after = _openings(list(what)), set() if least else _openings(items, at + 1)
        return None if inside is None or after is None else inside | after
    return None


def _first(items) -> list[tuple[list, list]] | None:
    """The ways a match may begin: the first sign, as an item, and what comes behind it; None if it may be empty."""
    if not items:
        return None
    (kind, own), rest = items[0], items[1:]
    if kind is sre.AT:
        return _first(rest)
    if kind is sre.SUBPATTERN:
        return _first([*own[3], *rest])
    if kind in (sre.LITERAL, sre.IN):
        return [([items[0]], rest)]
    if kind is sre.BRANCH:
        ways = [_first([*branch, *rest]) for branch in own[1]]
    elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and _openings(list(own[2])):
        least, most, what = own
        again = [] if most == 1 else [(kind, (max(least - 1, 0), most if most is sre.MAXREPEAT else most - 1, what))]
        ways = [_first([*what, *again, *rest])] + ([] if least else [_first(rest)])
    else:
        return None
    return None if None in ways else [way for own in ways for way in own]


def _seconds(items) -> set[str] | None:
    """What may stand second in a match, as ``_openings`` says what may stand first."""
    found = [_openings(rest) for _, rest in _first(items) or []]
    return set().union(*found) if found and None not in found else None


def listed(pattern: str) -> str:
    """The pattern with each sign of a range written out: Java keeps single signs as bits, but asks one range after the other."""
    return pattern.replace("a-z", "abcdefghijklmnopqrstuvwxyz").replace("0-9", "0123456789")


@lru_cache(maxsize=None)
def hinted(pattern: str) -> tuple[str, str]:
    """The pattern with a look at the next character before anything else is tried, and a text that every match holds (or '').

    Java tries all alternatives at each place; the look ahead leaves out most places and no match. A pattern
    that Python cannot read, such as one with a class of Unicode, goes without one.
    """
    try:
        items = list(_parser.parse(pattern))
    except re.PatternError:
        return listed(pattern), ""
    runs, run = [""], ""
    for kind, own in items:
        run = run + chr(own) if kind is sre.LITERAL else ""
        runs.append(run)
    pattern = listed(pattern)
    first = None if items and items[0] == (sre.AT, sre.AT_BEGINNING) else _openings(items)
    held = max(runs, key=len)
    ahead = "".join(f"[{listed(''.join(sorted(own)))}]" for own in (first, first and _seconds(items)) if own)
    return (f"(?={ahead})(?:{pattern})" if ahead else pattern), held if len(held) > 2 and held.isalpha() else ""


@lru_cache(maxsize=None)
def ungrouped(pattern: str) -> str:
    """The pattern with groups that are not kept, for tests alone: Java clears what is kept for each text."""
    if re.search(r"\\[1-9]", pattern):
        return pattern
    out, inside, at = [], False, 0
    while at < len(pattern):
        sign = pattern[at]
        step = 2 if sign == "\\" else 1
        inside = not inside if sign == ("]" if inside else "[") else inside
        out.append("(?:" if sign == "(" and not inside and pattern[at + 1 : at + 2] != "?" else pattern[at : at + step])
        at += step
    return "".join(out)


class Spark:
    """Patterns are raw string literals, so a backslash is written once."""

    @staticmethod
    def text(value: str) -> str:
        return "r'" + value + "'" if "\\" in value else "'" + value.replace("'", "\\'") + "'"

    def like(self, x: str, pattern: str) -> str:
        pattern, held = hinted(pattern)
        test = f"regexp_like({x}, {self.text(ungrouped(pattern))})"
        return f"(contains({x}, '{held}') AND {test})" if held and _NAME.fullmatch(x) else test

    def replace(self, x: str, pattern: str, by: str) -> str:
        pattern = listed(pattern)
        if by == " " and _RUN.fullmatch(pattern) and re.fullmatch(pattern, " "):
            # Most runs are one space and stay as they are.
            own = pattern[:-1]
            pattern = rf"{own}(?:(?<! ){own}*|{pattern})"
        return f"regexp_replace({x}, {self.text(pattern)}, '{by}')"

    def passed(self, test: str, x: str, same: str) -> str:
        """``x``, which is ``same`` wherever the test does not hold."""
        return f"CASE WHEN {test} THEN {x} ELSE {same} END"

    def both(self, test: str, x: str) -> str:
        """``x``, where a test that it implies is asked first."""
        return f"({test} AND {x})"

    def wanted(self, test: str, x: str) -> str:
        """``x`` where the test holds; elsewhere nobody looks at it."""
        return f"CASE WHEN {test} THEN {x} END"

    def asked(self, x: str, test: str) -> str:
        """``x`` and a test that costs less, which is asked first."""
        return f"({test}) AND {x}"

    def extract(self, x: str, pattern: str, group: int) -> str:
        pattern, held = hinted(pattern)
        found = f"regexp_extract({x}, {self.text(pattern)}, {group})"
        # Where the text cannot match, or is null, it is as without the test.
        return f"CASE WHEN NOT contains({x}, '{held}') THEN '' ELSE {found} END" if held and _NAME.fullmatch(x) else found

    def tokens(self, x: str, cut: str) -> str:
        return f"array_distinct(filter(split({x}, {self.text(listed(cut))}), t -> t <> ''))"

    def keep(self, array: str, test: str) -> str:
        return f"filter({array}, t -> {test})"

    def words(self, x: str, cut: str, test: str) -> str:
        """The tokens that pass a test which fails for empty ones. A pattern is compiled anew for each row that it splits, a single sign is not."""
        return f"array_distinct(filter(split({self.replace(x, cut, ' ')}, ' '), t -> {test}))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def hits(self, column: str, names) -> str:
        """How many of the names a joined code column holds; few are looked for in the text itself, those of a coded column in its number."""
        if column in CODED:
            return f"bit_count(bits_{column} & {mask(column, names)}L)"
        if len(names) > 4 or not names:
            return f"CASE WHEN {column} = '' THEN 0 ELSE size({self.among(self.parts(column, ';'), names)}) END"
        return "(" + " + ".join(f"CAST({has(column, n)} AS INT)" for n in names) + ")"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def among(self, array: str, names) -> str:
        """The distinct entries that are among fixed names, which are looked up; an intersection would hash the names anew for each row."""
        return f"array_distinct(filter({array}, c -> c IN ({', '.join(repr(n) for n in names)})))" if names else self.common(array, self.array(names))

    def parts(self, x: str, sign: str) -> str:
        return f"split({x}, '{sign}')"

    def array(self, names) -> str:
        return f"array({', '.join(repr(n) for n in names)})"

    def joined(self, array: str, sign: str) -> str:
        return f"array_join({array}, '{sign}')"


class Duck(Spark):
    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, '{by.replace('$', chr(92))}', 'g')"

    def passed(self, test: str, x: str, same: str) -> str:
        return x

    def both(self, test: str, x: str) -> str:
        return x

    def wanted(self, test: str, x: str) -> str:
        return x

    def asked(self, x: str, test: str) -> str:
        return f"{x} AND {test}"

    def words(self, x: str, cut: str, test: str) -> str:
        return self.keep(self.tokens(x, cut), test)

    def hits(self, column: str, names) -> str:
        return self.size(self.among(self.parts(column, ";"), names))

    def tokens(self, x: str, cut: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array({x}, {self.text(cut)}), lambda t: t <> ''))"

    def keep(self, array: str, test: str) -> str:
        return f"list_filter({array}, lambda t: {test})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def common(self, a: str, b: str) -> str:
        # In the order of the first list.
        return f"list_filter({a}, lambda c: list_contains({b}, c))"

    def among(self, array: str, names) -> str:
        return self.common(array, self.array(names))

    def parts(self, x: str, sign: str) -> str:
        return f"string_split({x}, '{sign}')"

    def array(self, names) -> str:
        return f"[{', '.join(repr(n) for n in names)}]"

    def joined(self, array: str, sign: str) -> str:
        return f"array_to_string({array}, '{sign}')"


SPARK, DUCK = Spark(), Duck()
#: The names of code columns that Spark also has as a number, ``bits_<column>``: a bit for each name, by the alphabet.
CODED: dict[str, tuple[str, ...]] = {}
_NAME = re.compile("[a-z_][a-z0-9_]*")
_RUN = re.compile(r"\[[^\[\]]+\]\+")
#: New columns of an operator: name and expression.
Step = Callable[[Spark], list[tuple[str, str]]]


def needed(steps: tuple[Step, ...], wanted: str | None) -> list[list[tuple[str, str]]]:
    """The steps' columns that ``wanted`` (a statement, or names) leads back to, by step; all of them without it."""
    rendered = [step(SPARK) for step in steps]
    if wanted is None:
        return rendered
    names = set(_NAME.findall(wanted))
    out = []
    for own in reversed(rendered):
        kept = []
        for n, e in reversed(own):
            if n in names:
                kept.append((n, e))
                names.update(_NAME.findall(e))
        out.append(kept[::-1])
    return out[::-1]


def apply(df: DataFrame, *steps: Step, wanted: str | None = None) -> DataFrame:
    """``df`` with the steps' columns, only those that ``wanted`` reads if it is given.

    Columns that do not need each other are one projection, each as late as it is needed, so that few rows are
    copied and they stay narrow; windows come first, as they sort rows. The optimiser merges it with the next one only where
    each of its costly columns is read once, so no expression is written twice. Their
    code is long: as one loop over fused operators it would pass the size that HotSpot compiles, so
    such stages are left to Spark's projections, whose code comes in short methods and
    computes what occurs several times once.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    made = needed(steps, wanted)
    before = df.columns
    for own in levels(made):
        df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in own))
    return df if wanted else df.select(*before, *(n for own in made for n, _ in own))


def levels(made: list[list[tuple[str, str]]]) -> list[list[tuple[str, str]]]:
    """The steps' columns by the projection they go to; a column may read those before it in its own step."""
    seen, reads, expressions = set(), {}, {}
    for own in made:
        for n, e in own:
            reads[n], expressions[n] = seen.intersection(_NAME.findall(e)), e
            seen.add(n)
    soonest = {}
    for n in expressions:
        soonest[n] = 1 + max((soonest[r] for r in reads[n]), default=-1)
    last = max(soonest.values(), default=-1)
    at = dict.fromkeys(expressions, last)
    for n in reversed(expressions):
        at[n] = soonest[n] if " OVER " in expressions[n] else at[n]
        for r in reads[n]:
            at[r] = min(at[r], at[n] - 1)
    return [own for k in range(last + 1) if (own := [(n, e) for n, e in expressions.items() if at[n] == k])]


def render(source: str, *steps: Step) -> tuple[str, str]:
    """Common table expressions that add the steps' columns one after the other, and the last one's name."""
    ctes = [f"s0 AS MATERIALIZED ({source})"]
    steps = [step for step in steps if step(DUCK)]
    for k, step in enumerate(steps):
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step(DUCK))} FROM s{k})")
    return "WITH " + ", ".join(ctes), f"s{len(steps)}"


def one_of(x: str, values) -> str:
    return f"coalesce({x} IN ({', '.join(repr(v) for v in values)}), false)"


def codes(pairs: list[tuple[str, str]]) -> str:
    """The names whose tests hold, sorted, joined by semicolons."""
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in sorted(pairs)) + ")"


def mask(column: str, names) -> int:
    return sum(1 << k for k, n in enumerate(CODED[column]) if n in names)


def flagged(d: Spark, column: str, pairs: list[tuple[str, str]], otherwise: tuple[str, str] | None = None) -> list[tuple[str, str]]:
    """A joined code column; with ``otherwise`` (test, name) that name stands alone where its test holds.

    For Spark each test is a bit of a number. Later steps ask the number, so the text is made only where somebody reads it.
    """
    if type(d) is not Spark:
        return [(column, f"CASE WHEN {otherwise[0]} THEN '{otherwise[1]}' ELSE {codes(pairs)} END" if otherwise else codes(pairs))]
    assert set(CODED[column]) == {n for n, _ in pairs} | ({otherwise[1]} if otherwise else set())
    number = " | ".join(f"CASE WHEN {test} THEN {mask(column, (n,))}L ELSE 0L END" for n, test in pairs)
    if otherwise:
        number = f"CASE WHEN {otherwise[0]} THEN {mask(column, (otherwise[1],))}L ELSE {number} END"
    return [(f"bits_{column}", number), (column, codes([(n, coded(column, (n,))) for n in CODED[column]]))]


def coded(column: str, names) -> str:
    """Whether a coded column holds one of the names, by its number."""
    return f"bits_{column} & {mask(column, names)}L <> 0"


def holds(d: Spark, column: str, code: str) -> str:
    """``has`` for a coded column."""
    return f"({coded(column, (code,))})" if type(d) is Spark else has(column, code)


def some(d: Spark, column: str) -> str:
    """Whether a coded column holds anything."""
    return f"bits_{column} <> 0" if type(d) is Spark else f"{column} <> ''"


def has(column: str, code: str) -> str:
    return f"contains(concat(';', {column}, ';'), ';{code};')"


def hits(d: Spark, column: str, names) -> str:
    """How many of the names a joined code column holds."""
    return d.hits(column, sorted(names))


def held(d: Spark, column: str, names) -> str:
    """Those of the names that a joined code column holds, in its order, joined by bars."""
    if type(d) is Spark and column in CODED:
        return codes([(n, coded(column, (n,))) for n in CODED[column] if n in names]).replace("concat_ws(';'", "concat_ws('|'", 1)
    found = d.joined(d.among(d.parts(column, ";"), sorted(names)), "|")
    return d.passed(f"{column} <> ''", found, column)


def choose(rules: list[tuple[str, str]], default: str) -> str:
    """First rule that holds wins."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {default} END"
