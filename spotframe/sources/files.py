"""Sources: delimited text, JSON lines, cards, FASTA, raw movies. Sinks: tables, BED, FASTA, Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPOT_SCHEMA = "fov int, marker string, condition string, spot_label long, nucleus long, volume_um3 double, eq_diam_um double, mean_intensity double, max_intensity double, integrated_intensity double, com_z_um double, com_y_um double, com_x_um double, com_z_px double, com_y_px double, com_x_px double"
NUCLEUS_SCHEMA = "label long, volume_vox long, volume_um3 double, circularity double, com_z_um double, com_y_um double, com_x_um double, kept int"


def read_delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",", strip_bom: str | None = None) -> DataFrame:
    """CSV or TSV with a header and a given schema; empty files give no rows. ``strip_bom`` names a text column to clean."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').csv(paths)
    return df.withColumn(strip_bom, F.trim(F.regexp_replace(strip_bom, "^﻿|\r$", ""))) if strip_bom else df


def read_union(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All Parquet files of a glob under one schema; later files are cast to it, missing columns are NULL."""
    return spark.read.schema(schema).parquet(glob)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Markdown cards with a front matter: ``path``, ``slug``, ``name``, ``type``, ``tags``, ``links``, ``description``, ``body``.

    Files without front matter and files whose names begin with ``_`` drop out.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head, field = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?", 1), lambda n: F.trim(F.regexp_extract("head", rf"(?m)^{n}:\s*(.*)$", 1))
    items = lambda n: F.filter(F.transform(F.split(F.regexp_replace(field(n), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    slug = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = raw.where(F.col("value").rlike(r"(?s)\A---\n.*?\n---")).withColumn("head", head).where(~slug.startswith("_"))
    return rows.select("path", slug.alias("slug"), field("name").alias("name"), field("type").alias("type"), items("tags").alias("tags"), items("links").alias("links"), items("sources").alias("sources"), field("description").alias("description"), F.trim(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "")).alias("body"))


def card_lookup(cards: DataFrame) -> DataFrame:
    """One card per slug: the one whose path comes first."""
    rest = [c for c in cards.columns if c not in ("slug", "path")]
    return cards.groupBy("slug").agg(F.min_by(F.struct("path", *rest), "path").alias("c")).select("slug", "c.*")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header``, ``sequence``: records split at ``>``, line breaks taken out."""
    rows = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n", 2)
    return rows.select(F.trim(parts[0]).alias("header"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s+", "").alias("sequence"))


def read_json(spark: SparkSession, paths: str | list[str], schema: str, whole: bool = False) -> DataFrame:
    """JSON records under a given schema: a record a line, or with ``whole`` a document a file.

    Broken records stay as a row with their text in ``_broken``, the rest NULL; missing fields are NULL.
    """
    reader = spark.read.schema(f"{schema}, _broken string").option("multiLine", whole).option("columnNameOfCorruptRecord", "_broken")
    return reader.json(paths)


def channel_planes(planes: dict[str, DataFrame], channels: DataFrame) -> DataFrame:
    """``marker`` and its planes, by a table of channels: ``marker``, ``kind`` and ``index``.

    ``kind`` names the reading: ``interleaved`` planes of one movie, or a ``file`` of its own; the
    index is the channel in it. A kind that no reading has gives no rows.
    """
    parts = []
    for kind, p in planes.items():
        some = channels.where(F.col("kind") == kind).select("marker", F.col("index").alias("channel"))
        parts.append(p.join(F.broadcast(some), "channel").drop("channel"))
    return reduce(DataFrame.unionByName, parts)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Movie sidecars: ``path``, ``width``, ``height``, ``n_frames``, ``little``; a missing field is an error when read."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def need(pattern: str, group: int) -> Column:
        got = F.regexp_extract("value", pattern, group)
        return F.when(got == "", F.raise_error(F.concat(F.lit("field missing in "), F.col("path"))).cast("string")).otherwise(got).cast("int")

    dims, order = r"frame dimensions\s*=\s*(\d+)\s*x\s*(\d+)", F.lower(F.regexp_extract("value", r"data type\s*=\s*(.*)", 1))
    return raw.select("path", need(dims, 1).alias("width"), need(dims, 2).alias("height"), need(r"number of frames\s*=\s*(\d+)", 1).alias("n_frames"), (order.contains("little") | order.contains("low")).alias("little"))


def read_planes(spark: SparkSession, movies: str, sidecars: DataFrame, channels: int) -> DataFrame:
    """``path``, ``channel``, ``z``, ``h``, ``w``, ``pixels`` (uint16, little endian) from interleaved raw movies.

    Frames are cut inside the task that reads the file. A file whose frames don't divide evenly
    by the channels, or whose size doesn't fit its sidecar, is an error.
    """
    side = sidecars.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), "width", "height", "n_frames", "little")
    raw = spark.read.format("binaryFile").load(movies).select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), "path", "content")
    clean = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    both = raw.withColumn("stem", clean("stem")).join(side.withColumn("stem", clean("stem")), "stem")

    def cut_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples():
                if r.n_frames % channels or len(r.content) != r.n_frames * r.width * r.height * 2:
                    raise ValueError(f"{r.path}: {r.n_frames} frames, {len(r.content)} bytes, {channels} channels")
                frames = np.frombuffer(r.content, "<u2" if r.little else ">u2").reshape(r.n_frames, r.height * r.width)
                for i in range(r.n_frames):
                    yield pd.DataFrame({"path": [r.path], "channel": [i % channels], "z": [i // channels], "h": [r.height], "w": [r.width], "pixels": [frames[i].astype("<u2").tobytes()]})

    return both.select("path", "content", "width", "height", "n_frames", "little").mapInPandas(cut_frames, "path string, channel int, z int, h int, w int, pixels binary")


def trimmed(planes: DataFrame, key: list[str], trim: int) -> DataFrame:
    """Planes without ``trim`` at each end, where the depth is more than twice that."""
    depth = planes.groupBy(*key).agg((F.max("z") + 1).alias("_nz"))
    ok = (F.col("_nz") <= 2 * trim) | F.col("z").between(F.lit(trim), F.col("_nz") - trim - 1)
    return planes.join(depth, key).where(ok).drop("_nz")


def plane_voxels(planes: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``z``, ``y``, ``x``, ``v`` of the positive pixels of binary planes."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples(index=False):
                v = np.frombuffer(r.pixels, "<u2").reshape(r.h, r.w)
                y, x = np.nonzero(v)
                yield pd.DataFrame({**{k: [getattr(r, k)] * len(y) for k in key}, "z": np.full(len(y), r.z, "int32"), "y": y.astype("int32"), "x": x.astype("int32"), "v": v[y, x].astype("float64")})

    fields = [planes.schema[k] for k in key]
    schema = T.StructType([*fields, *[T.StructField(c, T.IntegerType()) for c in ("z", "y", "x")], T.StructField("v", T.DoubleType())])
    return planes.select(*key, "z", "h", "w", "pixels").mapInPandas(unpack, schema)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet, compressed by zstd; a partition column becomes folders that scans prune."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def common_depth(planes: DataFrame, key: list[str], channel: str) -> DataFrame:
    """Planes cut to the least depth of the channels of their key."""
    depth = planes.groupBy(*key, channel).agg((F.max("z") + 1).alias("_n")).groupBy(*key).agg(F.min("_n").alias("_n"))
    return planes.join(depth, key).where("z < _n").drop("_n")


def write_planes(planes: DataFrame, path: str, key: str, channel: str, scale: tuple[float, float, float]) -> None:
    """Planes of equal depth in folders per key and channel, and beside them ``metadata``: depth, size and voxel edges."""
    even = common_depth(planes, [key], channel)
    write_table(even, f"{path}/planes", [key, channel])
    size = even.groupBy(key, channel).agg((F.max("z") + 1).alias("depth"), F.max("h").alias("height"), F.max("w").alias("width"))
    write_table(size.select("*", *[F.lit(float(s)).alias(f"{c}_um") for c, s in zip("zyx", scale)]), f"{path}/metadata")


def label_planes(labels: DataFrame, key: list[str], height: int, width: int) -> DataFrame:
    """``key``, ``z``, ``h``, ``w``, ``pixels`` (uint32, little endian) from labelled voxels; a plane without a label has no row.

    A plane's voxels make one row in one task: planes are images of bounded size.
    """

    def paint(p: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((height, width), "<u4")
        plane[p["y"], p["x"]] = p["label"]
        return pd.DataFrame({**{k: p[k].iloc[:1] for k in [*key, "z"]}, "h": height, "w": width, "pixels": [plane.tobytes()]})

    fields = [labels.schema[k] for k in [*key, "z"]]
    schema = T.StructType([*fields, T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("pixels", T.BinaryType())])
    inside = labels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return inside.select(*key, "z", "y", "x", "label").groupBy(*key, "z").applyInPandas(paint, schema)


def label_voxels(planes: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``z``, ``y``, ``x``, ``label`` of the labelled pixels of ``label_planes``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples(index=False):
                v = np.frombuffer(r.pixels, "<u4").reshape(r.h, r.w)
                y, x = np.nonzero(v)
                yield pd.DataFrame({**{k: [getattr(r, k)] * len(y) for k in key}, "z": np.full(len(y), r.z), "y": y, "x": x, "label": v[y, x].astype("int64")})

    fields = [*[planes.schema[k] for k in key], *[T.StructField(c, T.IntegerType()) for c in ("z", "y", "x")], T.StructField("label", T.LongType())]
    return planes.select(*key, "z", "h", "w", "pixels").mapInPandas(unpack, T.StructType(fields))


def write_matrix(df: DataFrame, path: str, ids: list[str], features: list[str], notes: dict[str, str]) -> None:
    """A feature matrix as tables: ``nuclei_matrix`` (bad values 0), ``var`` (features with mean and population deviation) and ``uns`` (notes)."""
    fill = [F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f)) == float("inf")), 0.0).otherwise(F.col(f)).cast("double").alias(f) for f in features]
    x = df.select(*ids, *fill)
    write_table(x, f"{path}/nuclei_matrix")
    stats = x.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("deviation")) for f in features]).alias("s"))
    write_table(stats.select(F.explode("s").alias("s")).select("s.*"), f"{path}/var")
    write_table(df.sparkSession.createDataFrame(list(notes.items()), "name string, value string"), f"{path}/uns")


def write_calibration(fit: DataFrame, residuals: DataFrame, path: str) -> None:
    """Coefficients as a table and residuals as JSON lines."""
    write_table(fit, f"{path}/coefficients")
    residuals.write.mode("overwrite").json(f"{path}/residuals")


def card_markdown(cards: DataFrame) -> DataFrame:
    """``slug``, ``value``: cards as Markdown with a front matter; ``read_cards`` reads them back."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.lit("]"))
    plain = lambda c: F.coalesce(F.regexp_replace(c, r"\s+", " "), F.lit(""))
    lines = [F.concat(F.lit(f"{n}: "), listed(F.col(n)) if n in ("tags", "links", "sources") else plain(F.col(n))) for n in ("name", "type", "tags", "links", "sources", "description") if n in cards.columns]
    return cards.select("slug", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("body", F.lit(""))).alias("value"))


def card_index(cards: DataFrame) -> DataFrame:
    """``type``, ``value``: an index of the cards, a line per card by type and slug."""
    line = F.concat(F.lit("- [["), "slug", F.lit("]] "), F.coalesce("description", F.lit("")))
    return cards.select("type", "slug", line.alias("value")).orderBy("type", "slug").select("type", "value")


def bed_lines(df: DataFrame, name: str) -> DataFrame:
    """The track line of a BED file."""
    return df.sparkSession.createDataFrame([(f'track name="{name}" itemRgb="On" visibility=2',)], "value string")


def write_csv(df: DataFrame, path: str, places: int | None = None) -> None:
    """CSV with a header and escaped quotes; floating columns rounded to ``places`` if given."""
    if places is not None:
        df = df.select(*[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_bed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def fasta_lines(df: DataFrame, header: str, sequence: str) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value"))


def leaderboard_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table; pipes in values are escaped, NULL is a dash."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
