"""Schemas that drift between files: a catalogue of column lifespans, changes and casts.

Each file's lines are read once into the fields they carry (path, type, value). The catalogue
holds, per producer (series) and file, every field with its type. ``lag`` over the files of a
producer-field-type cuts its presence into islands; the start and the end of each island are
the log of changes. A field that ends where another starts with equal values in the records
that both files hold is a rename; the renames are the alias table, from which the casts of one
consistent table per stream are generated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import cut

#: Keys whose objects count as values (maps), not as nesting.
MAP_KEYS = ("suggested_direction", "next_params")

_PRODUCER = ["stream", "series"]
_LINE = "stream string, series string, file_name string, line_no int, received_at timestamp_ntz, rec double, readable boolean, shape string, payload string"


def _number(x: int | float) -> str:
    return str(int(x)) if isinstance(x, int) or (x == x and abs(x) < 1e15 and x == int(x)) else repr(x)


def _canonical(v: object) -> str:
    """Equal JSON values have equal canonical texts: key order and 1 / 1.0 don't matter."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, (int, float)):
        return _number(v)
    if isinstance(v, list):
        return "[" + ",".join(map(_canonical, v)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{_canonical(v[k])}" for k in sorted(v)) + "}"


def _kind(x: object) -> str | None:
    return None if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "map"


def _leaves(v: dict, prefix: str = "", out: dict | None = None) -> dict:
    """Path -> value of a parsed record; of a repeated path the last value holds."""
    out = {} if out is None else out
    for k, x in v.items():
        if isinstance(x, dict) and k not in MAP_KEYS:
            _leaves(x, f"{prefix}{k}.", out)
        else:
            out[prefix + k] = x
    return out


def _record(payload: str | None) -> dict | None:
    try:
        v = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _first_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the copies of a line, which follow each other, the first readable one, else the first."""
    names = [x.split()[0] for x in _LINE.split(", ")]
    shapes: dict[tuple, str] = {}
    held: list | None = None
    for p in batches:
        out = []
        for stream, series, name, no, at, payload in p.itertuples(index=False, name=None):
            same = held is not None and held[2] == name and held[3] == no
            if same and held[6]:
                continue
            v = _record(payload)
            if same and v is None:
                continue
            if held is not None and not same:
                out.append(held)
            rec, shape = None, None
            if v is not None:
                rec = v.get("rec")
                rec = float(rec) if isinstance(rec, (int, float)) and not isinstance(rec, bool) else None
                key = tuple((k, _kind(x)) for k, x in _leaves(v).items())
                if len(shapes) > 100_000:
                    shapes.clear()
                shape = shapes.get(key) or shapes.setdefault(key, json.dumps([[k, t] for k, t in key]))
            held = [stream, series, name, no, at, rec, v is not None, shape, payload]
        if out:
            yield pd.DataFrame(out, columns=names)
    if held is not None:
        yield pd.DataFrame([held], columns=names)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Each line once: ``rec``, ``readable``, ``shape`` (JSON list of its fields' paths and types) and ``payload``.

    A line that was delivered several times counts once: a readable copy goes first, then the
    earliest, then the smallest payload. Broken, empty and NULL lines and JSON that isn't an
    object stay as unreadable rows; lines without a number count each. The copies of a line meet
    in one task as texts, by file and thousands of lines, so a file of any size is spread.
    """
    near = [F.col("file_name"), F.floor(F.col("line_no") / 1000)]
    rows = lines.select(*_PRODUCER, "file_name", "line_no", "received_at", "payload").repartition(*near)
    return rows.sortWithinPartitions("file_name", "line_no", "received_at", "payload").mapInPandas(_first_copies, _LINE)


def fields_of(rows: DataFrame, keys: list[str], wanted: str | None = None) -> DataFrame:
    """``keys``, ``fields``: path, type and canonical value of the fields of ``payload``; with ``wanted`` (an array of paths) only those."""

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            some = p["_wanted"] if wanted else [None] * len(p)
            out = []
            for payload, keep in zip(p["payload"], some):
                keep = None if keep is None else set(keep)
                out.append([(k, _kind(x), None if x is None else _canonical(x)) for k, x in _leaves(_record(payload) or {}).items() if keep is None or k in keep])
            yield p[keys].assign(fields=out)

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    narrow = rows.select(*keys, "payload", *([F.col(wanted).alias("_wanted")] if wanted else []))
    return narrow.mapInPandas(fields, f"{types}, fields array<struct<path:string,type:string,val:string>>")


def numbered_files(lines: DataFrame) -> DataFrame:
    """The files of each producer in the order of the stamps in their names (``seq`` from 1).

    Files without a readable record have no schema and are left out.
    """
    files = lines.where("readable").groupBy(*_PRODUCER, "file_name").agg(F.count("*").alias("n_records"))
    stamp = F.regexp_extract("file_name", r"(\d{8}T\d{6}Z)", 1)
    w = Window.partitionBy(*_PRODUCER)
    return files.withColumn("seq", F.row_number().over(w.orderBy(stamp, "file_name"))).withColumn("n_files", F.count("*").over(w))


def file_catalogue(lines: DataFrame, share: float = 0.1) -> dict[str, DataFrame]:
    """``records`` (the lines, each once), ``files`` and ``schema``.

    ``schema``: a file's fields that at least ``share`` of its readable records carry (a JSON
    null counts as carried), with the type of more than half of the non-null values; where
    there is none, the type of the field's neighbouring files in the series. Lines of one shape
    are counted before their fields are told apart.
    """
    parsed = cut(parsed_lines(lines))
    files = cut(numbered_files(parsed))
    shapes = parsed.where("readable").groupBy(*_PRODUCER, "file_name", "shape").agg(F.count("*").alias("n"))
    cells = shapes.select(*_PRODUCER, "file_name", "n", F.explode(F.from_json("shape", "array<array<string>>")).alias("f"))
    counts = cells.groupBy(*_PRODUCER, "file_name", F.col("f")[0].alias("path"), F.col("f")[1].alias("type")).agg(F.sum("n").alias("n"))
    fields = counts.groupBy(*_PRODUCER, "file_name", "path").agg(
        F.sum("n").alias("carried"),
        F.sum(F.when(F.col("type").isNotNull(), F.col("n"))).alias("nonnull"),
        F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type"))).alias("top"),
    )
    schema = files.join(fields, [*_PRODUCER, "file_name"]).where(F.col("carried") >= share * F.col("n_records"))
    schema = schema.withColumn("type", F.when(F.col("top.n") * 2 > F.col("nonnull"), F.col("top.type"))).drop("top", "nonnull", "n_records")
    back = Window.partitionBy(*_PRODUCER, "path").orderBy("seq")
    ahead = back.rowsBetween(1, Window.unboundedFollowing)
    schema = schema.withColumn("type", F.coalesce("type", F.last("type", True).over(back), F.first("type", True).over(ahead), F.lit("null")))
    return {"files": files, "schema": cut(schema), "records": parsed}


def lifespans(catalogue: dict[str, DataFrame]) -> DataFrame:
    """Islands: per producer, field and type the first and the last file of each unbroken run.

    ``starts`` and ``ends`` tell whether the run begins after the first file of the series or
    ends before its last.
    """
    w = Window.partitionBy(*_PRODUCER, "path", "type").orderBy("seq")
    rows = catalogue["schema"].withColumn("new", F.when(F.lag("seq").over(w) == F.col("seq") - 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w))
    spans = rows.groupBy(*_PRODUCER, "path", "type", "island").agg(
        F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min_by("file_name", "seq").alias("from_file"), F.max_by("file_name", "seq").alias("to_file"), F.max("n_files").alias("n_files")
    )
    return spans.select(*_PRODUCER, "path", "type", "from_seq", "to_seq", "from_file", "to_file", (F.col("from_seq") > 1).alias("starts"), (F.col("to_seq") < F.col("n_files")).alias("ends"))


def changes(catalogue: dict[str, DataFrame]) -> DataFrame:
    """``stream``, ``series``, ``seq``, ``file_name``, ``change``, ``old_path``, ``new_path``.

    A start and an end of the same field at the same file is a change of ``type``. Of the rest,
    an end and a start are ``renamed`` if in every record of both files whose old field isn't
    null the new field, where carried, has the equal value, and in one at least it has;
    what is left is ``removed`` or ``added``.
    """
    spans, at = lifespans(catalogue), [*_PRODUCER, "seq"]
    starts = spans.where("starts").select(*_PRODUCER, F.col("from_seq").alias("seq"), "path", F.lit(1).alias("started"))
    ends = spans.where("ends").select(*_PRODUCER, (F.col("to_seq") + 1).alias("seq"), "path", F.lit(1).alias("ended"))
    events = cut(starts.join(ends, [*at, "path"], "full"))
    new = events.where("ended IS NULL").select(*at, F.col("path").alias("new_path"))
    gone = events.where("started IS NULL").select(*at, F.col("path").alias("old_path"))
    # only records of files where one field goes and another comes are read again, for those fields
    both = gone.groupBy(*at).agg(F.collect_set("old_path").alias("gone")).join(new.groupBy(*at).agg(F.collect_set("new_path").alias("new")), at)
    asked = both.select(*_PRODUCER, (F.col("seq") - 1).alias("seq"), F.col("gone").alias("paths")).unionByName(both.select(*at, F.col("new").alias("paths")))
    asked = asked.groupBy(*at).agg(F.flatten(F.collect_list("paths")).alias("paths"))
    asked = asked.join(catalogue["files"].select(*at, "file_name"), at)
    lines = catalogue["records"].where("rec IS NOT NULL").join(asked, [*_PRODUCER, "file_name"])
    values = cut(fields_of(lines, [*at, "rec"], "paths").select(*at, "rec", F.explode("fields").alias("f")).select(*at, "rec", "f.path", "f.val"))
    old = values.where("val IS NOT NULL").select(*_PRODUCER, (F.col("seq") + 1).alias("seq"), "rec", F.col("path").alias("old_path"), F.col("val").alias("was")).join(gone, [*at, "old_path"])
    now = values.select(*at, "rec", F.col("path").alias("new_path"), F.col("val").alias("is")).join(new, [*at, "new_path"])
    pairs = old.join(now, [*at, "rec"]).groupBy(*at, "old_path", "new_path").agg(F.count_if(F.col("was") == F.col("is")).alias("equal"), F.count("*").alias("n"))
    renamed = cut(pairs.where("equal = n").select(*at, "old_path", "new_path"))
    names = catalogue["files"].select(*at, "file_name")
    rows = renamed.withColumn("change", F.lit("renamed"))
    rows = rows.unionByName(gone.join(renamed, [*at, "old_path"], "left_anti").withColumns({"new_path": F.lit(""), "change": F.lit("removed")}))
    rows = rows.unionByName(new.join(renamed, [*at, "new_path"], "left_anti").withColumns({"old_path": F.lit(""), "change": F.lit("added")}))
    both = events.where("started = 1 AND ended = 1").select(*at, F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    rows = rows.unionByName(both.withColumn("change", F.lit("type")))
    return rows.join(names, at).select(*at, "file_name", "change", "old_path", "new_path")


def alias_table(catalogue: dict[str, DataFrame], log: DataFrame, most: int = 5000) -> dict[str, tuple[str, str]]:
    """path -> (canonical path, type) of one stream, from the renames.

    Names linked by renames share one canonical name, the one that opens the most series, with
    the type it first has in most of them. The table is schema, not data: it has the ``most``
    names that most files hold, and ``consistent_table`` keeps all others in ``extra``.
    """
    names = catalogue["schema"].groupBy("path").agg(F.count_if(F.col("seq") == 1).alias("first"), F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(most)
    paths = names.collect()
    opening = catalogue["schema"].groupBy(*_PRODUCER, "path").agg(F.min_by("type", "seq").alias("type"))
    kinds = opening.join(names.select("path"), "path", "left_semi").groupBy("path", "type").agg(F.count("*").alias("n")).collect()
    weight = {r["path"]: (-r["first"], -r["n"], r["path"]) for r in paths}
    renames = log.where("change = 'renamed'").select("old_path", "new_path").distinct()
    links = renames.join(names.select(F.col("path").alias("old_path")), "old_path", "left_semi").join(names.select(F.col("path").alias("new_path")), "new_path", "left_semi").select("old_path", "new_path").collect()
    root = {p: p for p in weight}

    def find(p: str) -> str:
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        x, y = sorted((find(a), find(b)), key=weight.__getitem__)
        root[y] = x
    # the type that a canonical name has where it first appears, in most series
    types: dict[str, tuple[int, str]] = {}
    for p, kind, n in kinds:
        types[p] = max(types.get(p, (0, "")), (n, kind))
    return {p: (find(p), types[find(p)][1]) for p in weight}


def consistent_table(lines: DataFrame, stream: str) -> DataFrame:
    """One row per ``(series, rec)``, one typed column per field of the stream.

    Of a record in several files the version of the latest file holds. Columns are named by
    the canonical path with ``_`` for ``.``; numbers become DOUBLE (also from strings and from
    arrays of one), booleans BOOLEAN, strings STRING, arrays and maps canonical JSON text.
    ``extra`` keeps by path, as canonical JSON, whatever has no column: fields below the
    catalogue's share, values that their column's type can't take (NULL there), and of two
    spellings of a field in one record the later. Lines that give no row are in
    ``rejected_lines``. An unknown stream gives rows of ``series``, ``rec``, ``file_name`` and
    ``extra`` only.
    """
    catalogue = file_catalogue(lines.where(F.col("stream") == stream))
    alias = alias_table(catalogue, changes(catalogue))
    files = catalogue["files"].select(*_PRODUCER, "file_name", "seq")
    w = Window.partitionBy("series", "rec").orderBy(F.col("seq").desc(), "line_no")
    rows = catalogue["records"].where("readable AND rec IS NOT NULL").join(files, [*_PRODUCER, "file_name"]).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    rows = fields_of(rows, ["series", "rec", "file_name"]).withColumn("fields", F.filter("fields", lambda f: f["val"].isNotNull()))
    names = F.create_map(*[F.lit(x) for p, (c, _) in alias.items() for x in (p, c)]) if alias else F.lit(None).cast("map<string,string>")
    rows = rows.withColumn("names", names).withColumn("keys", F.transform("fields", lambda f: F.coalesce(F.col("names")[f["path"]], F.lit(""))))
    # of two spellings in one record the first in the record's order holds
    holds = lambda i: (F.col("keys")[i] != "") & (F.array_position("keys", F.col("keys")[i]) == i + 1)
    rows = rows.withColumn("known", F.filter("fields", lambda _, i: holds(i))).withColumn("rest", F.filter("fields", lambda _, i: ~holds(i)))
    rows = rows.select("series", F.col("rec").cast("long").alias("rec"), "file_name", "rest", F.map_from_entries(F.transform("known", lambda f: F.struct(F.col("names")[f["path"]].alias("k"), f.alias("f")))).alias("m"))
    columns, lost = [], []
    for path, kind in sorted({v for v in alias.values() if v[0] != "rec"}):
        raw = F.col("m")[path]["val"]
        v = raw
        if kind == "number":
            v = F.regexp_replace(raw, r'^\[?"?|"?\]?$', "").try_cast("double")
        elif kind == "boolean":
            v = F.regexp_replace(raw, '"', "").try_cast("boolean")
        elif kind == "string":
            v = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        columns.append(v.alias(path.replace(".", "_")))
        lost.append(F.when(raw.isNotNull() & v.isNull(), F.col("m")[path]))
    kept = F.concat("rest", F.array_compact(F.array(*lost))) if lost else F.col("rest")
    extra = F.map_from_entries(F.transform(kept, lambda f: F.struct(f["path"].alias("key"), f["val"].alias("value"))))
    return rows.select("series", "rec", "file_name", *columns, extra.alias("extra"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines that ``consistent_table`` can give no row: ``file_name``, ``line_no``, ``reason`` and ``payload``.

    ``reason``: ``empty``, ``broken`` (no JSON object) or ``no record number``. Each line once.
    """
    rows = parsed_lines(lines).where("NOT readable OR rec IS NULL")
    empty = F.coalesce(F.trim("payload") == "", F.lit(True))
    return rows.select("file_name", "line_no", F.when(F.col("readable"), "no record number").when(empty, "empty").otherwise("broken").alias("reason"), "payload")
