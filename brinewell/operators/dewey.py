"""Deeply nested records into related flat tables by Dewey labelling.

Every node of a record gets the ordinals on the way to it, as in 4.0.3; cutting the last one gives its parent, so the
parent-child links cost nothing. The ordinal of a field is its place among the names that its schema path declares, whatever the order in the text; fields
that are not declared follow in the order of the text. So a typed record and the same record as text have the same labels. Objects are grouped by their schema path ('$.data.bets[]') and carry their scalar fields;
a table is the selection of one path. No step shuffles.

Lists in a list are read as one list. Null members count as places but are no nodes. For paths in as_list a single object is a
list of one; a string at a path in as_json is read as JSON.

Defined results: text that isn't one whole JSON value (after an optional byte order mark), null and blank text give no nodes; of a
repeated field name the last one counts; numbers and booleans keep their JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "row_id bigint, dewey array<int>, path string, fields map<string,string>, counts map<string,int>"
_NODES = pa.schema(
    [("row_id", pa.int64()), ("dewey", pa.list_(pa.int32())), ("path", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
     ("counts", pa.map_(pa.string(), pa.int32()))]
)
CHUNK = 4096


def whole_json(text: str | None):
    """The value of a text that is JSON from its first to its last sign, else None; beyond any depth that can be read, None too."""
    if not text:
        return None
    try:
        return json.loads(text.removeprefix(chr(0xFEFF)))
    except (ValueError, RecursionError):
        return None


def _scalar(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _members(v) -> Iterator:
    """The members of a list with the lists in it read as one, depth by an own stack."""
    stack = [iter(v)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            yield x
        else:
            stack.pop()


def ordinals(path: str, names: dict[str, list[str]]) -> list[int]:
    """The label of the list or object at a schema path such as '$.data.bets' whose fields are all declared."""
    out, at = [], "$"
    for name in path.split(".")[1:]:
        out.append(names[at].index(name))
        at = f"{at}.{name}"
    return out


def nodes_of(value, as_list: frozenset[str], as_json: frozenset[str], names: dict[str, list[str]]) -> Iterator[tuple[list[int], str, list, list]]:
    """(ordinals, schema path, scalar fields, lengths of lists) of every object in value."""
    stack = [(value, [], "$")]
    while stack:
        v, label, path = stack.pop()
        if isinstance(v, str) and path in as_json:
            v = whole_json(v)
        if isinstance(v, dict) and path in as_list:
            v = [v]
        if isinstance(v, list):
            below = [(x, [*label, k], path + "[]") for k, x in enumerate(_members(v)) if isinstance(x, dict)]
            stack.extend(reversed(below))
        elif isinstance(v, dict):
            fields, counts, below, declared = [], [], [], names.get(path, [])
            place, more = {name: k for k, name in enumerate(declared)}, len(declared)
            for name, x in v.items():
                k = place.get(name, more)
                more += name not in place
                child = f"{path}.{name}"
                if isinstance(x, str) and child in as_json:
                    x = whole_json(x)
                if isinstance(x, list):
                    counts.append((name, sum(1 for _ in _members(x))))
                elif isinstance(x, dict) and child in as_list:
                    counts.append((name, 1))
                if isinstance(x, (list, dict)):
                    below.append((x, [*label, k], child))
                elif x is not None:
                    fields.append((name, _scalar(x)))
            yield label, path, fields, counts
            stack.extend(reversed(below))


def label_json(
    df: DataFrame, row_id: Column, text: Column, as_list: set[str] = frozenset(), as_json: set[str] = frozenset(), names: dict[str, list[str]] | None = None
) -> DataFrame:
    """A row per object: row_id, dewey (its ordinals), path, its scalar fields and the lengths of its lists. names: the declared fields of schema paths."""
    lists, texts, declared = frozenset(as_list), frozenset(as_json), names or {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (v := whole_json(s)) is not None:
                    for node in nodes_of(v, lists, texts, declared):
                        out.append((i, *node))
                        if len(out) == CHUNK:
                            yield _packed(out)
                            out = []
            if out:
                yield _packed(out)

    return df.select(row_id.cast("bigint").alias("row_id"), text.cast("string").alias("text")).where("text is not null").mapInArrow(work, NODES)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def label_list(df: DataFrame, row_id: Column, members: Column, base: list[int]) -> DataFrame:
    """The same labels for a typed list of structs: row_id, dewey, member; null members count as places and are left out."""
    rows = df.select(row_id.cast("bigint").alias("row_id"), F.posexplode(members).alias("pos", "member")).where("member is not null")
    return rows.select("row_id", F.array(*[F.lit(x) for x in base], F.col("pos")).alias("dewey"), "member")


def place(dewey: Column) -> Column:
    """A node's place in its list."""
    return F.element_at(dewey, -1)


def parent(dewey: Column, levels: int = 1) -> Column:
    """The label of the node levels above, by truncation."""
    return F.slice(dewey, 1, F.greatest(F.size(dewey) - levels, F.lit(0)))


def label(row_id: Column, dewey: Column) -> Column:
    """A node's label among all rows; that of a record's root is the row alone."""
    return F.concat_ws(".", row_id.cast("string"), dewey.cast("array<string>"))


def dotted(dewey: Column) -> Column:
    return F.array_join(dewey.cast("array<string>"), ".")
