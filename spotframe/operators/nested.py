"""Deeply nested records as related flat tables, with parent links and typed variants.

The shape of an object is found by a bottom-up tree automaton that runs as Column expressions
inside the scan's stage: a scalar is in state ``1`` or ``0`` (NULL), an array in ``0`` (NULL),
``e`` (empty), ``n`` (holds NULL elements) or ``f`` (filled), and an object in ``0`` (NULL) or
``{field,child:state,...}``, the list of its present fields with the states of those children
that are objects or arrays. Each distinct state of an object is a variant; rows are routed to
one typed table per variant, while the table of all rows (the supertype) keeps the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def state(c: Column, kind: T.DataType) -> Column:
    """State of a value in the automaton, from the states of its children."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            child = state(c[f.name], f.dataType)
            if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                parts.append(F.when(child != "0", F.concat(F.lit(f"{f.name}:"), child)))
            else:
                parts.append(F.when(child != "0", F.lit(f.name)))
        return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")) if parts else F.lit("{}"))
    if isinstance(kind, T.ArrayType):
        holes = F.exists(c, lambda x: x.isNull())
        return F.when(c.isNull(), "0").when(F.size(c) == 0, "e").when(holes, "n").otherwise("f")
    return F.when(c.isNull(), "0").otherwise("1")


def _columns(c: Column, kind: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Scalars of an object and of the objects in it, named by their path with ``_``."""
    out: list[tuple[str, Column]] = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _columns(c[f.name], f.dataType, f"{prefix}{f.name}_")
        elif not isinstance(f.dataType, T.ArrayType):
            out.append((f"{prefix}{f.name}", c[f.name]))
    return out


def _shapes(c: Column, kind: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    out = [(f"{prefix}shape", state(c, kind))]
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _shapes(c[f.name], f.dataType, f"{prefix}{f.name}_")
    return out


def _arrays(c: Column, kind: T.StructType, prefix: str = "") -> list[tuple[str, Column, T.DataType]]:
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _arrays(c[f.name], f.dataType, f"{prefix}{f.name}_")
        elif isinstance(f.dataType, T.ArrayType):
            out.append((f"{prefix}{f.name}", c[f.name], f.dataType.elementType))
    return out


def flat_tables(df: DataFrame, key: str, inherit: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One flat table for the records and one for each array in them, at any depth.

    A table's rows hold ``key``, the 0-based places in the enclosing arrays
    (``<array>_pos``; NULL elements count and keep their row), the scalars of the object by
    path, and the automaton's state of every object in it (``..._shape``). ``inherit`` names
    shape columns that the tables of inner arrays take over from their parent row, so that
    children can be routed by the variant of their parent without a join. NULL and empty
    arrays give no child rows; the parent's state tells them apart. The tables are narrow
    projections of the scan: nothing is shuffled.
    """
    inherit = inherit or {}
    tables: dict[str, DataFrame] = {}

    def walk(rows: DataFrame, name: str, kind: T.StructType, keys: list[str], taken: list[str]) -> None:
        c = F.col("_v")
        shapes = _shapes(c, kind)
        used, columns = {*keys, *taken, *[n for n, _ in shapes]}, []
        for n, x in _columns(c, kind):
            while n in used:
                n += "_"
            used.add(n)
            columns.append(x.alias(n))
        tables[name] = rows.select(*keys, *taken, *columns, *[x.alias(n) for n, x in shapes])
        passed = {f"{name or 'record'}_{n}": x for n, x in shapes if inherit.get(n) == name}
        for path, array, element in _arrays(c, kind):
            pos = f"{path.split('_')[-1]}_pos"
            while pos in keys or pos in taken:
                pos += "_"
            inner = rows.select(*keys, *taken, *[x.alias(n) for n, x in passed.items()], F.posexplode(array).alias(pos, "_v"))
            child, more = f"{name}_{path}" if name else path, [*taken, *passed]
            if isinstance(element, T.StructType):
                walk(inner, child, element, [*keys, pos], more)
            else:
                tables[child] = inner.select(*keys, pos, *more, F.col("_v").alias("value"))

    kind = T.StructType([f for f in df.schema.fields if f.name != key])
    walk(df.select(key, F.struct(*[f.name for f in kind.fields]).alias("_v")), "", kind, [key], [])
    return tables


def fields_of_state(shape: Column) -> Column:
    """The names of the present fields of an object in this state, without those of the objects in it."""
    parts = F.split(shape, r"(?<=[{}])|(?=[{}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(a: Column, part: Column) -> Column:
        depth = a["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        text = F.when((a["depth"] == 1) & ~part.isin("{", "}"), F.concat(a["text"], part)).otherwise(a["text"])
        return F.struct(depth.alias("depth"), text.alias("text"))

    names = F.transform(F.split(F.aggregate(parts, start, step)["text"], ","), lambda x: F.substring_index(x, ":", 1))
    return F.coalesce(F.filter(names, lambda x: x != ""), F.array().cast("array<string>"))


def has_field(shape: Column, field: str) -> Column:
    """Whether an object in this state itself carries ``field`` (not NULL); NULL and NULL objects don't."""
    return F.array_contains(fields_of_state(shape), field)


def shape_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """``tbl``, ``object``, ``shape``, ``n_rows``: every state that occurs, with its rows."""
    parts = []
    for name, t in tables.items():
        for c in [x for x in t.columns if x.endswith("shape") and not x.startswith(("record_", "trials_"))]:
            parts.append(t.select(F.lit(name or "record").alias("tbl"), F.lit(c.removesuffix("shape").rstrip("_")).alias("object"), F.col(c).alias("shape")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tbl", "object", "shape").agg(F.count("*").alias("n_rows"))


def variants(t: DataFrame, shape: str, most: int = 1000) -> dict[str, list[str]]:
    """The states of a shape column that most rows have, with the fields that each carries; NULL objects have none."""
    states = t.where(F.col(shape).isNotNull() & (F.col(shape) != "0")).groupBy(shape).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), shape).limit(most)
    return {r[0]: r[1] for r in sorted(states.select(shape, fields_of_state(F.col(shape))).collect())}


def routed(t: DataFrame, shape: str, known: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The rows of each variant; rows of all other variants, if any, are under ``""`` and keep their state."""
    out = {s: t.where(F.col(shape) == s) for s in known}
    return out | {"": t.where(F.col(shape).isNotNull() & (F.col(shape) != "0") & ~F.col(shape).isin(list(known)))}


def typed_tables(t: DataFrame, keys: list[str], obj: str, most: int = 1000) -> dict[str, DataFrame]:
    """One typed table per variant of the object ``obj`` in table ``t``.

    Each holds ``keys`` (the link to the supertype row) and just those columns of the object
    that its variant carries. The variants are schema, not data: the ``most`` commonest have a
    table each. The rows of rarer ones are in one table, under ``""``, with their variant and
    all the object's columns; it is there even if no row is.
    """
    shape = f"{obj}_shape"
    known = variants(t, shape, most)
    out = {}
    for s, rows in routed(t, shape, known).items():
        names = [f for f in known.get(s, []) if f"{obj}_{f}" in t.columns]
        if s == "":
            names = [c.removeprefix(f"{obj}_") for c in t.columns if c.startswith(f"{obj}_") and not c.endswith("shape")]
        variant = [F.col(shape).alias("variant")] if s == "" else []
        out[s] = rows.select(*keys, *variant, *[F.col(f"{obj}_{f}").alias(f) for f in names])
    return out
