"""Flat graphs: JSON arrays whose entries refer to each other by position."""

from __future__ import annotations

import re

from ..model import InputError

MAX_ENTRIES = 100_000
MAX_DEPTH = 200
MAX_CHUNKS = 16
LINEAR = "linear_conversation"
_KEY = re.compile(r"_([0-9]+)")


def _place(x) -> int | None:
    """The entry that a number names: one that is no whole number from 0 on names none."""
    return int(x) if x >= 0 and x == int(x) else None


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _numbers(entry: list | dict) -> list:
    return [x for x in (entry.values() if isinstance(entry, dict) else entry) if _is_number(x)]


def _reached(flat: list) -> list[int]:
    """The containers that entry 0 leads to, a step of references after the other."""
    known, edge, steps = set(), {0}, 0
    while edge:
        if max(edge) >= len(flat):
            raise InputError("reference out of range")
        if steps > MAX_DEPTH:
            raise InputError("graph too deep")
        known |= edge
        edge = {at for i in edge if isinstance(flat[i], (list, dict)) for at in map(_place, _numbers(flat[i])) if at is not None} - known
        steps += 1
    return [i for i in known if isinstance(flat[i], (list, dict))]


def _names(flat: list, entry: dict) -> list[str]:
    """The keys of an object, which are written as the places of their texts."""
    places = [_KEY.fullmatch(k) for k in entry]
    if not all(m and int(m[1]) < len(flat) and isinstance(flat[int(m[1])], str) for m in places):
        raise InputError("object key")
    names = [flat[int(m[1])] for m in places]
    if len(set(names)) != len(names):
        raise InputError("object key")
    return names


def revive(flat: list):
    """The value that entry 0 of a flat graph stands for.

    All containers are made empty first and filled then, so a reference to one
    that holds it is one like any other.
    """
    made = {i: type(flat[i])() for i in _reached(flat)}

    def value(x):
        if not _is_number(x):
            return x
        at = _place(x)
        return None if at is None else made[at] if at in made else flat[at]

    for i, out in made.items():
        if isinstance(out, list):
            out.extend(map(value, flat[i]))
        else:
            out.update(zip(_names(flat, flat[i]), map(value, flat[i].values())))
    return made.get(0, flat[0])


def linear_conversations(root) -> list[list]:
    """Every list kept under the key of a linear conversation, each container visited once."""
    found, seen, stack = [], set(), [(root, 0)]
    while stack:
        x, depth = stack.pop()
        if not isinstance(x, (dict, list)) or id(x) in seen:
            continue
        if depth > MAX_DEPTH:
            raise InputError("graph too deep")
        seen.add(id(x))
        if isinstance(x, dict) and LINEAR in x:
            if not isinstance(x[LINEAR], list):
                raise InputError("linear conversation is no list")
            found.append(x[LINEAR])
        stack.extend((y, depth + 1) for y in (x.values() if isinstance(x, dict) else x))
    return found
