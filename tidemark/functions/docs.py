"""Plain Python functions on document values held as extended JSON.

A tagged value is an object whose single key starts with ``$`` (``{"$oid": ...}``); it counts as one value.
"""

from __future__ import annotations

import json

#: The type name of each extended-JSON tag; the number tags are plain numbers.
TAG_TYPES = {
    "$oid": "objectId",
    "$date": "date",
    "$numberDecimal": "decimal",
    "$numberInt": "number",
    "$numberLong": "number",
    "$numberDouble": "number",
    "$timestamp": "timestamp",
    "$binary": "binary",
    "$regularExpression": "regex",
}


class Raw(str):
    """A number as it was written."""

    __slots__ = ()


_decoder = json.JSONDecoder()
_raw_decoder = json.JSONDecoder(parse_int=Raw, parse_float=Raw, parse_constant=Raw)


def _decode(text: str, decoder: json.JSONDecoder):
    """The value of a whole text; None where it is broken, or nested beyond what the parser takes."""
    try:
        value, end = decoder.scan_once(text, 0)  # without the searches for white space that decode makes
        if end == len(text):
            return value
    except StopIteration:  # white space before the value, or none at all
        pass
    except (ValueError, RecursionError):
        return None
    try:
        return decoder.decode(text)
    except (ValueError, RecursionError):
        return None


def parse(text: str | None):
    """The value of a JSON text; None where it is null, broken, or nested beyond what the parser takes."""
    return None if text is None else _decode(text, _decoder)


def parse_raw(text: str | None):
    """As :func:`parse`, with numbers kept as :class:`Raw`."""
    return None if text is None else _decode(text, _raw_decoder)


def is_tagged(value) -> bool:
    return isinstance(value, dict) and len(value) == 1 and next(iter(value))[:1] == "$"


def is_object(value) -> bool:
    return isinstance(value, dict) and not (len(value) == 1 and next(iter(value))[:1] == "$")


#: Type names by the exact class of a value; objects are looked at.
_PLAIN = {type(None): None, str: "string", int: "number", float: "number", bool: "bool", list: "array", Raw: "number"}


def type_name(value) -> str | None:
    """string, number, bool, array, object or the tag's type; None for null."""
    kind = type(value)
    if kind is not dict:
        return _PLAIN[kind]
    if len(value) == 1 and (tag := next(iter(value)))[:1] == "$":
        return TAG_TYPES.get(tag, tag[1:])
    return "object"


def canonical(value):
    """A hashable form: numbers as doubles, objects without order, types kept apart."""
    if value is None or isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        try:
            return ("n", float(value))
        except OverflowError:
            return ("n", float("inf") if value > 0 else float("-inf"))
    if isinstance(value, str):
        return ("s", value)
    if isinstance(value, list):
        return ("a", tuple(canonical(x) for x in value))
    return ("o", tuple(sorted((k, canonical(v)) for k, v in value.items())))


def leaves(doc: dict, prefix: str = ""):
    """(dotted path, value) of every field; arrays, tagged values and empty objects are single fields."""
    for key, value in doc.items():
        if type(value) is dict and value and not (len(value) == 1 and next(iter(value))[:1] == "$"):
            yield from leaves(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


def differing_paths(a: dict, b: dict, prefix: str = "") -> list[str]:
    """Dotted paths at which two objects differ; a field only one side has is one path."""
    out = []
    for key in a.keys() | b.keys():
        if key not in a or key not in b:
            out.append(prefix + key)
            continue
        x, y = a[key], b[key]
        if is_object(x) and is_object(y):
            out += differing_paths(x, y, prefix + key + ".")
        elif canonical(x) != canonical(y):
            out.append(prefix + key)
    return out
