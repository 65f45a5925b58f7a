"""Code intelligence indexes in the public SCIP format (protocol buffers): their occurrences as rows.

Only the fields needed are decoded, straight from the wire format. Fixed values, from the format's definition:
Index.documents is field 2; of a Document, relative_path is 1 and occurrences 2; of an Occurrence, range is 1,
symbol 2, symbol_roles 3 and enclosing_range 7; role bit 1 marks a definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, symbol string, start int, end int, is_definition boolean"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message; bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is longer than its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not in use")
        yield key >> 3, value


def _numbers(value: int | memoryview) -> list[int]:
    """Of a repeated integer, packed or one at a time."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        number, at = _varint(value, at)
        out.append(number)
    return out


def _lines(span: list[int]) -> tuple[int, int]:
    """First and last line: a range has three numbers if it is within one line, else four."""
    return (span[0], span[2] if len(span) == 4 else span[0]) if span else (0, 0)


def occurrences(content: bytes) -> Iterator[tuple[str, str, int, int, bool]]:
    """path, symbol, start, end, is_definition; a definition spans its enclosing range if the index has it."""
    for number, document in fields(memoryview(content)):
        if number != 2:
            continue
        path, found = "", []
        for n, value in fields(document):
            if n == 1:
                path = bytes(value).decode("utf-8", "replace")
            elif n == 2:
                found.append(value)
        for message in found:
            symbol, roles, span, around = "", 0, [], []
            for n, value in fields(message):
                if n == 1:
                    span += _numbers(value)
                elif n == 2:
                    symbol = bytes(value).decode("utf-8", "replace")
                elif n == 3:
                    roles = value
                elif n == 7:
                    around += _numbers(value)
            is_definition = bool(roles & 1)
            yield (path, symbol, *_lines(around if is_definition and around else span), is_definition)


def read_indexes(files: DataFrame) -> DataFrame:
    """Occurrences of binary files (path, content), for ``operators.catalog.occurrence_edges``.

    A file that is no index, or ends too early, yields what was read before the fault; null content yields nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                try:
                    for row in occurrences(content.as_py() or b""):
                        rows.append(row)
                except (ValueError, IndexError, TypeError):
                    pass  # a broken index must not fail the job
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "symbol", "start", "end", "is_definition"])

    return files.select("content").mapInArrow(run, SCHEMA)
