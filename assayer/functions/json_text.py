"""The first JSON object in chatty text.

Almost every row is answered natively: ``try_parse_json`` reads one value and
ignores what follows, so parsing from the first ``{`` of the first candidate
settles plain, fenced and prose-wrapped objects.  Only rows where that attempt
fails, but another ``{`` exists, reach the Arrow function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def fence_bodies(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def candidates(text: Column) -> Column:
    """Where to look, in order: fenced bodies, then the whole text."""
    whole = F.array(text)
    return F.when(text.contains("```"), F.concat(fence_bodies(text), whole)).otherwise(whole)


def first_decodable(text: str) -> dict | None:
    """Try opening braces in turn until one starts a valid object.

    What a failed attempt had left open fails at the same place and is not tried again.
    A text nested too deep for the parser gives nothing, never an inner piece.
    """
    decode = json.JSONDecoder().raw_decode
    hopeless: set[int] = set()
    for opening in _OPENING.finditer(text):
        at = opening.start()
        if at not in hopeless:
            try:
                return decode(text, at)[0]
            except RecursionError:
                return None
            except json.JSONDecodeError as failed:
                hopeless.update(_left_open(text, at, failed.pos))
            except ValueError:  # a number with too many digits
                pass
    return None


def all_objects(text: str) -> Iterator[tuple[int, int, str]]:
    """(place, length, JSON text) of every object that is not inside another, from left to right.

    Places and lengths count code points. Where no object begins the next opening brace is
    tried; what is nested too deep is passed over as a whole.
    """
    decode = json.JSONDecoder().raw_decode
    hopeless: set[int] = set()
    at = 0
    while opening := _OPENING.search(text, at):
        start, at = opening.start(), opening.start() + 1
        if start in hopeless:
            continue
        try:
            found, stop = decode(text, start)
        except RecursionError:
            return
        except json.JSONDecodeError as failed:
            hopeless.update(_left_open(text, start, failed.pos))
            continue
        except ValueError:  # a number with too many digits
            continue
        yield start, stop - start, _plain(found)
        at = stop


def _plain(found: dict) -> str:
    plain = json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    # a lone surrogate cannot leave Python as UTF-8
    return plain.encode("utf-8", "replace").decode("utf-8")


class _Objects:
    def eval(self, text: str):
        if text is not None and "{" in text:
            yield from all_objects(text)


#: Table function of one text: a row per object with its place, used by a lateral join.
objects_of = F.udtf(_Objects, returnType="place int, length int, obj string", useArrow=True)

# an object can only begin with a name or end at once
_OPENING = re.compile(r'\{(?=[ \t\n\r]*+["}])')
_STRING_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}]', re.S)


def _left_open(text: str, start: int, stop: int) -> list[int]:
    """Braces between two places that are open at the second; up to it the text is valid."""
    depth: list[int] = []
    for token in _STRING_OR_BRACE.finditer(text, start, stop):
        if token[0] == "{":
            depth.append(token.start())
        elif token[0] == "}":
            depth.pop()
    return depth


@F.pandas_udf(T.StringType())
def _scan(texts: pd.Series) -> pd.Series:
    def one(text):
        found = first_decodable(text)
        if found is None:
            return None
        return _plain(found)

    return texts.map(one, na_action="ignore").astype(object)


# Its result is used several times; only a nondeterministic function is never copied.
_scan_once = _scan.asNondeterministic()


def braced_candidates(text: Column) -> Column:
    """The candidates that hold a ``{``, each cut to start at its first one."""
    return F.transform(
        F.filter(candidates(text), lambda c: c.contains("{")),
        lambda c: F.substring(c, F.locate("{", c), F.length(c)),
    )


def native_object(options: Column) -> Column:
    """JSON text of the object that opens the first candidate, NULL if it does not parse."""
    return F.to_json(F.try_parse_json(F.get(options, F.lit(0))))


def scanned_object(options: Column) -> Column:
    """The same by scanning every candidate, for rows the native attempt left NULL.

    The candidates travel as one text: U+0000 is allowed nowhere in JSON, so no
    object can reach from one into the next.
    """
    return _scan_once(F.array_join(options, "\0"))


def canonical(found: Column) -> Column:
    """Scanned text in the form the native attempt gives, where JSON allows."""
    return F.coalesce(F.to_json(F.try_parse_json(found)), found)
