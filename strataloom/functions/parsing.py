"""Parsers of model replies as column expressions, and one state machine where a stack is needed."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from .text import Text, _c, strip


def unfence(raw: Text) -> Column:
    """J2. Without a code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?", ""), r"`+\s*$", ""))


def array_slice(raw: Text) -> Column:
    """From the first [ to the last ]; null without."""
    return F.nullif(F.regexp_extract(unfence(raw), r"(?s)\[.*\]", 0), F.lit(""))


def repaired(array: Column) -> Column:
    """Trailing commas, single quotes, bare keys and the doubled quotes that these repairs make."""
    steps = ((r",\s*([}\]])", "$1"), ("'", '"'), (r"(\w+):", '"$1":'), (r'""(\w)', '"$1'))
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, array)


def lenient_array(raw: Text, schema: str) -> Column:
    """J1. The reply's array as it is, else after the repairs; null where neither can be read."""
    own = array_slice(raw)
    ok = F.try_parse_json(own).isNotNull()
    return F.from_json(F.when(ok, own).otherwise(repaired(own)), schema)


def readable_array(raw: Text) -> Column:
    own = array_slice(raw)
    return F.try_parse_json(own).isNotNull() | F.try_parse_json(repaired(own)).isNotNull()


#: Where a part has too many brackets within each other for the JSON reader, those with at most so many inside are tried.
MAX_DEPTH = 400
_MARKS = re.compile(r'["\\\[\]{}]')
_PLACES = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.DOTALL)
_OPEN, _CLOSE = {"[": "]", "{": "}"}, "]}"
_FREE, _QUOTED, _ESCAPED = range(3)


class _Bracket:
    """An opening bracket: its place, its end once closed, and the brackets around it, one for each reader."""

    __slots__ = ("end", "outer", "start", "wants")

    def __init__(self, start: int, wants: str, outer: list[_Bracket]) -> None:
        self.start, self.wants, self.outer, self.end = start, wants, outer, -1


def _merged(a: list, b: list) -> list:
    """Both lists in the longer one."""
    if len(a) < len(b):
        a, b = b, a
    a.extend(b)
    return a


def _brackets(text: str) -> list[_Bracket]:
    """All opening brackets in order, each with the end that a reader who starts at it finds, strings minded; one pass.

    What a reader makes of a character depends on whether a string is open and whether a backslash stands before it: three
    states. Readers in one state see the same brackets from there on, so they share one stack, whose lowest parts differ:
    a bracket may have several brackets around it, one for each reader that came to share the stack.
    """
    found: list[_Bracket] = []
    tops: dict[int, list[_Bracket]] = {}
    last = -2
    for match in _MARKS.finditer(text):
        c, at = match.group(), match.start()
        if _ESCAPED in tops and at > last + 1:  # the escaped character was none of these
            tops[_QUOTED] = _merged(tops.pop(_ESCAPED), tops.pop(_QUOTED, []))
        now: dict[int, list[_Bracket]] = {}
        if c in _OPEN:
            one = _Bracket(at, _OPEN[c], tops.pop(_FREE, []))
            found.append(one)
            now[_FREE] = [one]
        for state, stack in tops.items():
            if state == _ESCAPED:
                to = _QUOTED
            elif c == '"':
                to = _FREE if state == _QUOTED else _QUOTED
            elif c == "\\" and state == _QUOTED:
                to = _ESCAPED
            else:
                to = state
            if state == _FREE and c in _CLOSE:
                left: list[_Bracket] = []
                for one in stack:
                    if one.wants == c:  # else this reader and those around it are done
                        one.end = at
                        left = _merged(left, one.outer)
                    one.outer = []
                stack = left
            if stack:
                now[to] = _merged(now[to], stack) if to in now else stack
        tops, last = now, at
    return found


def _open_at(text: str, start: int, end: int, height: int | None = None) -> set[int]:
    """Places of brackets from start on that are open at end, as a reader from start sees them; or, with a height, of those before
    end that have more brackets within each other."""
    stack: list[int] = []
    high: set[int] = set()
    for match in _PLACES.finditer(text, start, end):
        c = match.group()
        if c in _OPEN:
            stack.append(match.start())
            if height is not None and len(stack) > height + 1:
                high.add(stack[-height - 2])
        elif c in _CLOSE and stack:
            stack.pop()
    return set(stack) if height is None else high


def first_balanced(raw: str | None) -> str | None:
    """J3. Canonical JSON of the reply, or of the first balanced object or array in it that can be read.

    Brackets are matched in one pass. A part that cannot be read tells where: what is open there cannot be read either and is
    not tried again, so that the time is nearly linear in the reply's length.
    """
    if raw is None:
        return None
    text = raw.strip()
    if text.startswith("```"):
        text = text.strip("`").removeprefix("json").strip()
    try:
        return json.dumps(json.loads(text))
    except (ValueError, RecursionError):
        pass
    read = json.JSONDecoder().raw_decode
    failed: set[int] = set()
    for one in _brackets(text):
        if one.end < 0 or one.start in failed:
            continue
        try:
            return json.dumps(read(text, one.start)[0])
        except json.JSONDecodeError as e:
            failed |= _open_at(text, one.start, e.pos)
        except RecursionError:
            failed |= _open_at(text, one.start, one.end, MAX_DEPTH)
    return None


@F.pandas_udf(StringType())
def balanced_json(raw: pd.Series) -> pd.Series:
    """J3 on a column; the one parser here that needs a stack."""
    return raw.map(first_balanced)


def coerce_binary(value: Text) -> Column:
    """J5 on JSON text of one value: booleans, numbers from 0.5 on, and the words for yes."""
    text = strip(value)
    word = F.lower(strip(F.regexp_replace(text, '^"|"$', "")))
    number = word.try_cast("double")
    quoted = text.startswith('"')
    return (
        F.when(text.isNull(), 0)
        .when(quoted, word.isin(*K.YES).cast("int"))
        .when(text == "true", 1)
        .when(text == "false", 0)
        .otherwise(F.coalesce((number >= 0.5).cast("int"), F.lit(0)))
    )


def clamp_score(value: Text) -> Column:
    """J6 on JSON text: half-even rounding, or the digits before "/", held between 1 and 5; null for booleans."""
    text = strip(value)
    digits = F.regexp_replace(F.element_at(F.split(F.regexp_replace(text, '^"|"$', ""), "/"), 1), "[^0-9]", "").try_cast("int")
    number = F.when(text.startswith('"'), digits).when(~text.isin("true", "false"), F.bround(text.try_cast("double")).cast("int"))
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), number)))


def confidence(raw: Text) -> Column:
    """C2. Struct of answer, confidence and escalated; the text after the last marker must be a number."""
    own = strip(raw)
    has = F.contains(own, F.lit(K.CONFIDENCE))
    answer = F.when(has, strip(F.regexp_extract(own, rf"(?s)^(.*){K.CONFIDENCE}", 1))).otherwise(own)
    given = F.when(has, strip(F.regexp_extract(own, rf"(?s)^.*{K.CONFIDENCE}(.*)$", 1))).try_cast("double")
    sure = F.coalesce(given, F.lit(0.5))
    return F.struct(
        answer.alias("answer"), sure.alias("confidence"), (F.contains(answer, F.lit(K.NO_CONTEXT)) | (sure < K.ESCALATE_BELOW)).alias("escalated")
    )


def should_escalate(score: Text) -> Column:
    """C3."""
    return _c(score) < K.ESCALATE_BELOW


def flags(raw: Text) -> Column:
    """R10. Array of title, clause, why, severity; entries without title or reason are left out."""

    def line(entry: Column, name: str) -> Column:
        return F.nullif(strip(F.regexp_extract(entry, rf"(?md)^\s*{name}:(.*)$", 1)), F.lit(""))

    made = F.transform(
        F.split(_c(raw), "---"),
        lambda e: F.struct(line(e, "FLAG").alias("title"), line(e, "CLAUSE").alias("clause"), line(e, "WHY").alias("why"), line(e, "SEVERITY").alias("severity")),
    )
    kept = F.filter(made, lambda f: f["title"].isNotNull() & f["why"].isNotNull())
    return F.when(F.contains(_c(raw), F.lit(K.NO_FLAGS)), F.slice(kept, 1, 0)).otherwise(kept)
