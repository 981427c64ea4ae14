"""Nested records to related flat tables, by Arrow's list buffers.

``child_rows`` turns one nested path of a table into a flat child table. The
work is done on whole Arrow batches: the offsets of a list give every element
its parent's index and its position, the elements themselves are the list's
value buffer, and the parent's keys follow by a vectorised take. No row is
looked at by itself. ``json_records`` first brings delivered JSON text into one
nested type, by the JVM's reader where its shape is the usual one.

Defined cases: a null or empty array gives no child rows; a null element keeps
its position and gives no row; members that are missing come out as null; rows
with null keys keep them; an empty table gives an empty child table. Columns
besides the keys and the path are not read, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import write_table


def _flat(arr: pa.Array) -> pa.Array:
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def walk_path(arr: pa.Array, path: Sequence[str]) -> tuple[pa.Array, np.ndarray, pa.Array | None]:
    """Follow ``path`` from ``arr``; every list on the way is flattened.

    Returns the innermost values, the index of the row each belongs to, and
    the positions as text ('0.2.1'), or None if no list was met. ``path`` names
    struct members; lists need no step of their own.
    """
    owner = np.arange(len(arr), dtype=np.int64)
    place: pa.Array | None = None
    steps = list(path)
    while True:
        kind = arr.type
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            parent = _flat(pc.list_parent_indices(arr)).to_numpy(zero_copy_only=False)
            sizes = _flat(pc.fill_null(pc.list_value_length(arr), 0)).to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            here = pa.array(np.arange(len(parent)) - first[parent], pa.int64()).cast(pa.string())
            place = here if place is None else pc.binary_join_element_wise(place.take(pa.array(parent)), here, ".")
            owner = owner[parent]
            arr = _flat(pc.list_flatten(arr))
        elif steps:
            arr = _flat(pc.struct_field(arr, steps.pop(0)))
        else:
            return arr, owner, place


def child_batch(batch: pa.RecordBatch, keys: Sequence[str], path: Sequence[str], members: Sequence[str]) -> pa.RecordBatch:
    """The child rows of one batch: keys, position, then the members (or the value itself)."""
    values, owner, place = walk_path(batch.column(batch.schema.get_field_index(path[0])), path[1:])
    there = pc.is_valid(values)
    values, place = values.filter(there), (place if place is not None else pa.nulls(len(values), pa.string())).filter(there)
    rows = pa.array(owner[there.to_numpy(zero_copy_only=False)])
    out = [batch.column(batch.schema.get_field_index(k)).take(rows) for k in keys] + [place]
    out += [_flat(pc.struct_field(values, m)) for m in members] if members else [values]
    return out


def _type_at(kind: T.DataType, path: Sequence[str]) -> T.DataType:
    steps = list(path)
    while True:
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        elif steps:
            kind = kind[steps.pop(0)].dataType
        else:
            return kind


def child_rows(df: DataFrame, keys: Sequence[str], path: str, members: Sequence[str] | None = None, position: str = "position") -> DataFrame:
    """The flat child table at ``path`` ('groups.files.records') of ``df``.

    Columns: the parent's keys, ``position`` (0-based, one number per list on
    the way, joined by dots) and the members of the struct there (all of them,
    nested ones as they are, unless named), or ``value`` for plain elements.
    A member named like a key or the position gets the path's last name as prefix.
    """
    steps = path.split(".")
    inner = _type_at(df.schema[steps[0]].dataType, steps[1:])
    names = list(members if members is not None else inner.fieldNames()) if isinstance(inner, T.StructType) else []
    taken = {*keys, position}
    fields = [df.schema[k] for k in keys] + [T.StructField(position, T.StringType())]
    if names:
        fields += [T.StructField(f"{steps[-1]}_{n}" if n in taken else n, inner[n].dataType) for n in names]
    else:
        fields.append(T.StructField(f"{steps[-1]}_value" if "value" in taken else "value", inner))
    schema = T.StructType(fields)
    wanted = to_arrow_schema(schema)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [_flat(a).cast(f.type) for a, f in zip(child_batch(batch, keys, steps, names), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return df.select(*keys, steps[0]).mapInArrow(flatten, schema)


def flatten_tables(df: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """All related flat tables of a nested table, by path; '' is the root.

    The root keeps the plain columns and the members of plain structs, each
    list becomes a child table whose ``position`` starts with its parent's.
    Each table reads just the columns it needs.
    """
    out: dict[str, DataFrame] = {}
    plain: list[str] = []

    def visit(name: str, kind: T.DataType, listed: bool) -> None:
        if isinstance(kind, T.ArrayType):
            out[name] = child_rows(df, keys, name, _plain_members(_type_at(kind, [])))
            visit_members(name, _type_at(kind, []))
        elif isinstance(kind, T.StructType):
            if not listed:
                plain.extend(f"{name}.{f.name}" for f in kind if not isinstance(f.dataType, (T.ArrayType, T.StructType)))
            visit_members(name, kind)

    def visit_members(name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                visit(f"{name}.{f.name}", f.dataType, True)

    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            visit(f.name, f.dataType, False)
        elif f.name not in keys:
            plain.append(f.name)
    out[""] = df.select(*keys, *[F.col(p).alias(p.replace(".", "_")) for p in plain])
    return out


def _plain_members(kind: T.DataType) -> list[str] | None:
    if not isinstance(kind, T.StructType):
        return None
    return [f.name for f in kind if not isinstance(f.dataType, (T.ArrayType, T.StructType))] or None


# ---------------------------------------------------------------- JSON text


def read_json(body: str | None) -> object:
    """The value of a JSON text, however often it was encoded; None if unreadable."""
    value: object = body
    try:
        # each decoding takes the quotes off, so the text gets shorter
        while isinstance(value, str):
            try:
                value = json.loads(value)
            except RecursionError:
                value = deep_json(value)
    except ValueError:
        return None
    return value


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def deep_json(text: str) -> object:
    """The value of a JSON text of any depth, without recursion."""
    open_: list[tuple[object, str | None]] = []
    at = _BLANK.match(text).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(at)
        name, at = json.decoder.scanstring(text, at + 1, True)
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(at)
        return name, _BLANK.match(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = key(at)
                open_.append((value, name))
                continue
            at += 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        else:
            m = _PLAIN.match(text, at)
            if m is None:
                raise ValueError(at)
            value, at = json.loads(m[0]), m.end()
        # the value is whole: it goes into what is open, which may then be whole too
        while True:
            at = _BLANK.match(text, at).end()
            if not open_:
                if at < len(text):
                    raise ValueError(at)
                return value
            holder, name = open_[-1]
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = _BLANK.match(text, at + 1).end()
                if isinstance(holder, dict):
                    name, at = key(at)
                    open_[-1] = (holder, name)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            at += 1
            value = holder
            open_.pop()


def plain_dumps(value: object) -> str:
    """A value as JSON text; beyond the depth that can be written, a note of its kind."""
    try:
        return json.dumps(value)
    except RecursionError:
        return f"<{type(value).__name__} nested too deeply>"


def conform(value: object, kind: pa.DataType, keyed: Mapping[str, str], name: str = "") -> object:
    """Bring a JSON value into an Arrow type.

    A single value in place of a list is a list of one; an object in place of a
    list named in ``keyed`` is the list of its values, each with its name as
    the member ``keyed[name]``; anything else that does not fit is null. Numbers
    wanted as text are written plainly.
    """
    if value is None:
        return None
    if pa.types.is_list(kind):
        if name in keyed and isinstance(value, dict):
            value = [{**(v if isinstance(v, dict) else {}), keyed[name]: k} for k, v in value.items()]
        return [conform(v, kind.value_type, keyed) for v in (value if isinstance(value, list) else [value])]
    if pa.types.is_struct(kind):
        if not isinstance(value, dict):
            return None
        return {kind.field(i).name: conform(value.get(kind.field(i).name), kind.field(i).type, keyed, kind.field(i).name) for i in range(kind.num_fields)}
    if isinstance(value, (dict, list)):
        text = plain_dumps(value)
    elif isinstance(value, float) and value.is_integer():
        text = str(int(value))
    else:
        text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-8", "replace").decode()


def json_records(df: DataFrame, keys: Sequence[str], body: str, schema: T.StructType, keyed: Mapping[str, str] | None = None) -> DataFrame:
    """The JSON texts of ``body`` as columns of one nested type (leaves are text).

    Texts of the usual shape are decoded by the JVM's reader to that type; those
    that it finds odd (a single value for a list, an array for an object, texts
    encoded twice, damaged ones) are read one by one. Members named in ``keyed``
    are usually objects whose names become the member ``keyed[name]`` of a list.
    Unreadable texts, and texts that hold no object, give no row (see ``unread``).
    """
    names = dict(keyed or {})
    usual, flat = [], []
    for f in schema.fields:
        if f.name in names:
            inner = [m for m in f.dataType.elementType.fields if m.name != names[f.name]]
            usual.append(T.StructField(f.name, T.MapType(T.StringType(), T.StructType(inner))))
            members = ", ".join(f"e.key as `{m.name}`" if m.name == names[f.name] else f"e.value.`{m.name}` as `{m.name}`" for m in f.dataType.elementType.fields)
            flat.append(F.expr(f"transform(map_entries(_j.`{f.name}`), e -> struct({members}))").cast(f.dataType).alias(f.name))
        else:
            usual.append(f)
            flat.append(F.col(f"_j.`{f.name}`").alias(f.name))
    kind = T.StructType([*usual, T.StructField(_ODD, T.StringType())])
    texts = df.select(*keys, F.col(body).cast("string").alias("_body"))
    read = texts.withColumn("_j", F.from_json("_body", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _ODD}))
    regular = F.col(f"_j.{_ODD}").isNull() & F.coalesce(F.col("_body").rlike(r"^\s*\{"), F.lit(False))
    # written first, as both ways read what the reader says
    read = write_table(read.select(*keys, F.when(~regular, F.col("_body")).alias("_body"), regular.alias("_regular"), *[F.when(regular, c).alias(f.name) for c, f in zip(flat, schema.fields, strict=True)]), "read")
    odd = _decoded(read.where("not _regular").select(*keys, "_body"), keys, schema, names)
    return read.where("_regular").select(*keys, *[f.name for f in schema.fields]).unionByName(odd)


_ODD = "_odd_text"


def _decoded(df: DataFrame, keys: Sequence[str], schema: T.StructType, names: dict[str, str]) -> DataFrame:
    """Texts of any shape, brought into the type one by one."""
    result = T.StructType([df.schema[k] for k in keys] + list(schema.fields))
    wanted = to_arrow_schema(result)
    inner = pa.struct(list(wanted)[len(keys) :])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [read_json(b) for b in batch.column(batch.num_columns - 1).to_pylist()]
            there = [i for i, v in enumerate(values) if isinstance(v, dict)]
            records = pa.array([conform(values[i], inner, names) for i in there], inner)
            rows = pa.array(there, pa.int64())
            columns = [batch.column(i).take(rows).cast(wanted.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(columns + records.flatten(), schema=wanted)

    return df.mapInArrow(decode, result)


def unread(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """keys, reason of the texts that ``json_records`` gives no row for: 'missing', 'unreadable' or 'no object'."""
    result = T.StructType([*[df.schema[k] for k in keys], T.StructField("reason", T.StringType())])
    wanted = to_arrow_schema(result)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = []
            for b in batch.column(batch.num_columns - 1).to_pylist():
                value = read_json(b)
                plain = b is not None and value is None and b.strip(' \t\n\r"\\') == "null"
                why.append(None if isinstance(value, dict) else "missing" if b is None or not b.strip() else "no object" if value is not None or plain else "unreadable")
            rows = pa.array([i for i, w in enumerate(why) if w], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows).cast(wanted.field(i).type) for i in range(len(keys))], pa.array([w for w in why if w], pa.string())], schema=wanted)

    return df.select(*keys, F.col(body).cast("string").alias("_body")).mapInArrow(look, result)


def _struct(**members: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in members.items()])


_TEXT = T.StringType()
_RECORD = _struct(cut_reasons=T.ArrayType(_TEXT), cut_sites=T.ArrayType(_struct(detail=_TEXT)))
#: The members of delivered reports that are read.
REPORT = _struct(
    by_cwe=T.ArrayType(_struct(cwe=_TEXT, TP=_TEXT)),
    groups=T.ArrayType(_struct(files=T.ArrayType(_struct(records=T.ArrayType(_RECORD))))),
)


def report_rows(raw_reports: DataFrame, sink_findings: DataFrame) -> DataFrame:
    """The by_cwe cells, cut sites and cut reasons of reports and findings, flat.

    Columns src, rec_id, child, item, val; see ``child_rows`` for positions.
    """
    # the JSON text is decoded once; each child then reads its column of the written records
    reports = write_table(json_records(raw_reports, ["report_id"], "body", REPORT, {"by_cwe": "cwe"}), "reports")

    def flat(src: str, df: DataFrame, key: str, child: str, path: str, members: list[str] | None, item: str, val: str) -> DataFrame:
        rows = child_rows(df, [key], path, members)
        return rows.select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), F.lit(child).alias("child"), F.expr(item).alias("item"), F.expr(val).alias("val"))

    whole = "coalesce(cast(try_cast(TP as decimal(38,0)) as string), '')"
    parts = [
        flat("raw_reports", reports, "report_id", "by_cwe", "by_cwe", ["cwe", "TP"], "cwe", whole).where("item is not null"),
        flat("raw_reports", reports, "report_id", "cut_sites", "groups.files.records.cut_sites", ["detail"], "position", "coalesce(detail, '')"),
        flat("raw_reports", reports, "report_id", "cut_reasons", "groups.files.records.cut_reasons", None, "position", "value"),
        flat("sink_findings", sink_findings, "finding_id", "cut_sites", "cut_sites", ["detail"], "position", "coalesce(detail, '')"),
        flat("sink_findings", sink_findings, "finding_id", "cut_reasons", "cut_reasons", None, "position", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
