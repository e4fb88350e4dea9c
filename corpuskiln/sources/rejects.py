"""Loading delimited export lines while setting apart those that do not parse.

Record blocks go through a columnar path: one regular expression splits the whole block, Arrow casts
type its columns, and any violation anywhere fails the block.  A failing block is halved again and
again until bad records stand among a few; only those meet the strict, character-wise parser, which
either accepts a record or names the reason.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Unicode white space that counts as blank, and what may not stand in a text.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FORBIDDEN = r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}]"
_FORBIDDEN_PY = re.compile("[\x00-\x08\x0a-\x1f\x7f-\x9f�]")

FIELDS = ("pair_id", "posted_at", "l1", "original", "corrected")
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINE = "(?s)^" + r"\t".join(f"(?P<{f}>{_FIELD})" for f in FIELDS) + "$"
_NUMBER = re.compile(r"0*[1-9][0-9]*")
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")
_LONG_MAX = 2**63 - 1

OUT = pa.schema(
    [
        ("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("reason", pa.string()),
        ("pair_id", pa.int64()), ("posted_at", pa.timestamp("us")), ("l1", pa.string()), ("original", pa.string()), ("corrected", pa.string()),
    ]
)
_DDL = "line_id long, file_name string, line_no int, reason string, pair_id long, posted_at timestamp_ntz, l1 string, original string, corrected string"


#: Blocks of so few records are not halved further but meet the strict parser record by record.
LEAF = 8


class BlockError(ValueError):
    """A block holds at least one record that the columnar path does not take."""


def split_strict(line: str) -> list[str] | None:
    """The fields of one line, or None where a quoted field breaks the quoting rule."""
    fields, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            text, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                text.append(line[at:close])
                if line[close + 1 : close + 2] == '"':
                    text.append('"')
                    at = close + 2
                    continue
                at = close + 1
                break
            if at < end and line[at] != "\t":
                return None
            fields.append("".join(text))
        else:
            stop = line.find("\t", at)
            stop = end if stop < 0 else stop
            fields.append(line[at:stop])
            at = stop
        if at >= end:
            return fields
        at += 1


def diagnose(line: str | None) -> tuple[str | None, list]:
    """(reason, typed fields) of one line: reason is None for a record that parses."""
    if line is None:
        return "column_count", [None] * 5
    fields = split_strict(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", [None] * 5
    if len(fields) != len(FIELDS):
        return "column_count", [None] * 5
    number, when, l1, original, corrected = fields
    if not _NUMBER.fullmatch(number) or not _TIME.fullmatch(when):
        return "value", [None] * 5
    try:
        at = dt.datetime.strptime(when, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return "value", [None] * 5
    for text in (original, corrected):
        if not text or text.isspace() or _FORBIDDEN_PY.search(text):
            return "value", [None] * 5
    return None, [int(number) if int(number) <= _LONG_MAX else None, at, l1, original, corrected]


def _unquote(column: pa.Array) -> pa.Array:
    quoted = pc.starts_with(column, '"')
    if not pc.any(quoted).as_py():
        return column
    inner = pc.replace_substring(pc.utf8_slice_codeunits(column, 1, -1), '""', '"')
    return pc.if_else(quoted, inner, column)


def parse_block(lines: pa.Array) -> list[pa.Array]:
    """The typed columns of a block in which every record is good; BlockError otherwise."""
    if lines.null_count:
        raise BlockError
    # cheap signs first, so that a large block with a bad record fails early
    if pc.min(pc.count_substring(lines, "\t")).as_py() < len(FIELDS) - 1 or pc.any(pc.match_substring(lines, "\ufffd")).as_py():
        raise BlockError
    found = pc.extract_regex(pc.replace_substring_regex(lines, r"\r$", ""), _LINE)
    if found.null_count:
        raise BlockError
    number, when, l1, original, corrected = (_unquote(pc.struct_field(found, f)) for f in FIELDS)
    if not pc.all(pc.match_substring_regex(number, "^0*[1-9][0-9]{0,17}$")).as_py():
        raise BlockError
    if not pc.all(pc.match_substring_regex(when, "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")).as_py():
        raise BlockError
    for text in (original, corrected):
        if not pc.all(pc.match_substring_regex(text, f"[^{_SPACE}]")).as_py() or pc.any(pc.match_substring_regex(text, _FORBIDDEN)).as_py():
            raise BlockError
    try:
        # year 0 is no real time, though Arrow takes it
        if pc.any(pc.starts_with(when, "0000")).as_py():
            raise BlockError
        return [pc.cast(number, pa.int64()), pc.cast(when, pa.timestamp("us")), l1, original, corrected]
    except pa.ArrowInvalid:
        raise BlockError from None


def _blocks(lines: pa.Array, start: int) -> Iterator[tuple[int, int, str | None, list | None]]:
    """(start, length, reason, columns) of good stretches, (start, 1, reason, values) of single records."""
    try:
        if len(lines):
            yield start, len(lines), None, parse_block(lines)
        return
    except BlockError:
        pass
    if len(lines) <= LEAF:
        for i, line in enumerate(lines.to_pylist()):
            reason, values = diagnose(line)
            yield start + i, 1, reason, values
        return
    half = len(lines) // 2
    yield from _blocks(lines[:half], start)
    yield from _blocks(lines[half:], start + half)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[pa.Array]] = [[] for _ in FIELDS]
        reasons: list[str | None] = []
        singles: list[list] = []

        def close(singles: list[list], parts: list[list[pa.Array]] = parts) -> list[list]:
            """Put the values of single records into columns."""
            for f, part, values in zip(FIELDS, parts, zip(*singles)):
                part.append(pa.array(values, OUT.field(f).type))
            return []

        line = batch.column("line")
        for _, length, reason, columns in _blocks(line.cast(pa.string()), 0):
            reasons += [reason] * length
            if isinstance(columns[0], pa.Array):
                singles = close(singles)
                for part, column in zip(parts, columns):
                    part.append(column)
            else:
                singles.append(columns)
        close(singles)
        if not reasons:
            continue
        arrays = [batch.column("line_id"), batch.column("file_name"), batch.column("line_no"), pa.array(reasons, pa.string()), *(pa.concat_arrays(p) for p in parts)]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, OUT)], schema=OUT)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line with its typed fields, or with ``reason`` and null fields.

    Input: ``line_id``, ``file_name``, ``line_no``, ``line`` (other columns are ignored).  A null line
    counts as a line without columns (``column_count``).  A ``pair_id`` beyond 64 bits is valid and
    loads as null.  An empty table gives an empty result; repeated lines are kept, each by itself.
    """
    return lines.select("line_id", "file_name", "line_no", "line").mapInArrow(_load, _DDL)


def loaded(lines: DataFrame) -> DataFrame:
    """The rows of the lines that parse."""
    return parse_lines(lines).filter(F.col("reason").isNull()).drop("reason")


def rejected(lines: DataFrame) -> DataFrame:
    """``line_id`` and ``reason`` of the lines that do not parse."""
    return parse_lines(lines).filter(F.col("reason").isNotNull()).select("line_id", "reason")
