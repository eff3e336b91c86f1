"""Structural indexing of text records with numpy: fields, quotes and types of a whole block at once.

A record's fields are separated by spaces and tabs outside double quotes. One mask marks the quotes; its running
parity, restarted at each record, tells which separators lie inside quotes; fields are then the runs between the
others. All work is on byte arrays, without a Python step per record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

SPACE, TAB, CR, LF, QUOTE, PERCENT = 32, 9, 13, 10, 34, 37
LARGEST = 2**63 - 1
DECIMAL = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


@dataclass
class Index:
    """Fields of the records of a block: `start`/`end` in the bytes (unquoted), `quoted`, `stray` and `first`/`count` by record."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    quoted: np.ndarray
    stray: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def field(self, records: np.ndarray, j: int) -> np.ndarray:
        """Field numbers of the j-th field of each record, which must have one."""
        return self.first[records] + j


def index(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Index:
    """The fields of the records data[starts[i]:ends[i]]; a carriage return that ends a record is no part of it.

    `quoted`: the field is one pair of quotes around something; `stray`: it has any other quote.
    """
    n = len(starts)
    nonempty = ends > starts
    last = np.where(nonempty, ends - 1, 0)
    ends = ends - (nonempty & (data[last] == CR) if len(data) else np.zeros(n, bool))
    live = np.zeros(len(data) + 1, np.int8)
    np.add.at(live, starts[ends > starts], 1)
    np.add.at(live, ends[ends > starts], -1)
    inside_record = np.cumsum(live[:-1], dtype=np.int32) > 0
    quotes = (data == QUOTE) & inside_record
    seen = np.concatenate(([0], np.cumsum(quotes, dtype=np.int64)))
    record = np.zeros(len(data), np.int64)
    some = np.flatnonzero(ends > starts)
    if len(some):
        record[starts[some]] = np.diff(some, prepend=0)
        record = np.cumsum(record)
    odd = ((seen[:-1] - seen[starts][record] if n else seen[:-1]) & 1) == 1
    part = inside_record & ~(((data == SPACE) | (data == TAB)) & ~odd)
    # a field begins where its byte is part of a field and the byte before is not, or belongs to another record
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    border[ends] = True
    before = np.concatenate(([False], part[:-1])) & ~border[:-1]
    after = np.concatenate((part[1:], [False])) & ~border[1:]
    start, end = np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1
    of = record[start]
    count = np.bincount(of, minlength=n).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    held = seen[end] - seen[start]
    quoted = (held == 2) & (end - start >= 2) & (data[start] == QUOTE) & (data[end - 1] == QUOTE)
    return Index(data, start + quoted, end - quoted, quoted, (held > 0) & ~quoted, first, count)


def whole_numbers(ix: Index, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is, value): whether each field is ASCII digits only, and its value; values beyond 2^63 - 1 count as that."""
    digit = (ix.data >= 48) & (ix.data <= 57)
    upto = np.concatenate(([0], np.cumsum(digit, dtype=np.int64)))
    start, end = ix.start[fields], ix.end[fields]
    size = end - start
    good = (size > 0) & (upto[end] - upto[start] == size) & ~ix.stray[fields]
    value = np.zeros(len(fields), np.int64)
    short = good & (size <= 18)
    for i in range(int(size[short].max()) if short.any() else 0):
        on = np.flatnonzero(short & (size > i))
        value[on] = value[on] * 10 + (ix.data[start[on] + i] - 48)
    for f in np.flatnonzero(good & ~short):
        digits = ix.data[start[f]:end[f]].tobytes().lstrip(b"0")
        value[f] = min(int(digits or b"0"), LARGEST) if len(digits) < 20 else LARGEST
    return good, value


# An automaton for decimals. Classes of bytes: 0 digit, 1 sign, 2 point, 3 exponent mark, 4 other.
_CLASS = np.full(256, 4, np.int8)
_CLASS[48:58], _CLASS[[43, 45]], _CLASS[46], _CLASS[[69, 101]] = 0, 1, 2, 3
_START, _SIGN, _INT, _POINT, _FRAC, _EXP, _EXPSIGN, _EXPDIGIT, _DEAD = range(9)
_NEXT = np.full((9, 5), _DEAD, np.int8)
_NEXT[_START] = [_INT, _SIGN, _POINT, _DEAD, _DEAD]
_NEXT[_SIGN] = [_INT, _DEAD, _POINT, _DEAD, _DEAD]
_NEXT[_INT] = [_INT, _DEAD, _FRAC, _EXP, _DEAD]
_NEXT[_POINT] = [_FRAC, _DEAD, _DEAD, _DEAD, _DEAD]
_NEXT[_FRAC] = [_FRAC, _DEAD, _DEAD, _EXP, _DEAD]
_NEXT[_EXP] = [_EXPDIGIT, _EXPSIGN, _DEAD, _DEAD, _DEAD]
_NEXT[_EXPSIGN] = [_EXPDIGIT, _DEAD, _DEAD, _DEAD, _DEAD]
_NEXT[_EXPDIGIT] = [_EXPDIGIT, _DEAD, _DEAD, _DEAD, _DEAD]


def decimals(ix: Index, fields: np.ndarray) -> np.ndarray:
    """Whether each field is a finite decimal number: sign, digits with a point on either side, exponent."""
    start, end = ix.start[fields], ix.end[fields]
    size = end - start
    state = np.where((size > 0) & ~ix.stray[fields], _START, _DEAD).astype(np.int8)
    short = size <= 64
    for i in range(int(size[short].max()) if short.any() else 0):
        on = np.flatnonzero(short & (size > i) & (state != _DEAD))
        state[on] = _NEXT[state[on], _CLASS[ix.data[start[on] + i]]]
    good = np.isin(state, (_INT, _FRAC, _EXPDIGIT)) & short
    for f in np.flatnonzero(~short & (state != _DEAD)):
        good[f] = DECIMAL.fullmatch(ix.data[start[f]:end[f]].tobytes()) is not None
    return good
