"""JSON texts of any size and nesting as rows, one per value.

Values are numbered in the order in which they begin, and each knows the last number below it, so "inside" is a
comparison of numbers. A text is read from front to back; a task holds the open brackets and one batch of rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Values and bytes of text after which a task hands its rows on.
BATCH_ROWS, BATCH_BYTES = 50_000, 8 << 20
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:"])|(true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?))')
_SPACE = re.compile(r"[ \t\n\r]*\Z")
_FIELDS = [
    ("node", pa.int64(), T.LongType()), ("parent", pa.int64(), T.LongType()), ("grand", pa.int64(), T.LongType()), ("key", pa.string(), T.StringType()), ("pkey", pa.string(), T.StringType()),
    ("kind", pa.string(), T.StringType()), ("value", pa.string(), T.StringType()), ("last", pa.int64(), T.LongType()), ("size", pa.int64(), T.LongType()),
]


def values(text: str) -> Iterator[tuple]:
    """(node, parent, grandparent, key, parent's key, kind, value, last, size) of each value, brackets when they close.

    kind: o object, a array, s string, x number or literal, whose text is the value. ValueError where the text is no JSON.
    """
    open_: list[list] = []  # [node, key, is object, values in it so far]
    at, n, key, want = 0, 0, None, "value"
    while want != "end":
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected text at {at}")
        mark, at = m[1], m.end()
        up = open_[-1] if open_ else None
        if want in ("key", "key or close") and mark == '"':
            key, at = json.decoder.scanstring(text, at, True)
            m = _TOKEN.match(text, at)
            if m is None or m[1] != ":":
                raise ValueError(f"no colon at {at}")
            at, want = m.end(), "value"
        elif want in ("comma or close", "key or close", "value or close") and mark and mark in "}]" and (mark == "}") == up[2]:
            open_.pop()
            above = open_[-1] if open_ else (None, None)
            yield up[0], above[0], open_[-2][0] if len(open_) > 1 else None, up[1], above[1], "o" if up[2] else "a", None, n - 1, up[3]
            want = "comma or close" if open_ else "end"
        elif want == "comma or close" and mark == ",":
            key, want = None, "key" if up[2] else "value"
        elif want in ("value", "value or close") and mark in (None, '"', "{", "["):
            if up:
                up[3] += 1
            if mark in ("{", "["):
                open_.append([n, key, mark == "{", 0])
                want = "key or close" if mark == "{" else "value or close"
            else:
                value, kind = m[2], "x"
                if mark:
                    (value, at), kind = json.decoder.scanstring(text, at, True), "s"
                above = open_[-2] if len(open_) > 1 else (None, None)
                yield n, up[0] if up else None, above[0], key, up[1] if up else None, kind, value, n, 0
                want = "comma or close" if open_ else "end"
            n += 1
            key = None
        else:
            raise ValueError(f"unexpected {mark or m[2]!r} at {m.end()}")
    if not _SPACE.match(text, at):
        raise ValueError(f"text behind the end at {at}")


def _clean(s: str | None) -> str | None:
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()


def json_nodes(docs: DataFrame, keys: frozenset[str], whole: str) -> DataFrame:
    """docs: (doc_id, value JSON text) -> (doc_id, node, parent, grand, key, pkey, kind, value, last, size).

    Of an object's plain values only those under `keys` become rows, of the object under the key `whole` all; brackets
    and the values of arrays always do. A text that is no JSON gives one row of kind '!' with the reason. Null texts give none.
    """
    names = [f for f, _, _ in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, owner, rows, size = batch.column(0), batch.column(1), [], [], 0

            def full() -> pa.RecordBatch:
                columns = zip(*rows) if rows else [()] * len(_FIELDS)
                return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *(pa.array([_clean(x) for x in c] if k == pa.string() else c, k) for c, (_, k, _) in zip(columns, _FIELDS))], ["doc_id", *names])

            for d in range(batch.num_rows):
                if not texts[d].is_valid:
                    continue
                found = values(texts[d].as_py())
                while True:
                    try:
                        row = next(found, None)
                    except ValueError as e:
                        row, found = (-1, None, None, None, None, "!", f"{e}"[:500], -1, 0), iter(())
                    if row is None:
                        break
                    if row[5] in "sx" and row[3] is not None and row[3] not in keys and row[4] != whole:
                        continue
                    owner.append(d)
                    rows.append(row)
                    size += len(row[6] or "") + 100
                    if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield full()
                        owner, rows, size = [], [], 0
            yield full()

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, _, t in _FIELDS])
    return docs.select("doc_id", "value").mapInArrow(run, schema)
