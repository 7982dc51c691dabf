"""Writers: build tables swapped by a pointer, guarded names, CSV with a licence line, GeoJSON, vector tiles."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_build(df: DataFrame, root: str, build: str, live: str | None = None, partition: list[str] = ()) -> str:
    """Writes a build to a folder of its own; never over the live one."""
    if build == live:
        raise ValueError("a build is never written over the live one")
    path = f"{root}/build_id={build}"
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return path


def pointer(spark: SparkSession, root: str):
    """The latest row of the pointer table (version, live, previous), or none."""
    try:
        return spark.read.parquet(f"{root}/pointer").orderBy(F.desc("version")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def promote(spark: SparkSession, root: str, build: str) -> None:
    """Makes a build the live one, by a new version of the pointer: the one before stays until the new one is there."""
    last = pointer(spark, root)
    version = last["version"] + 1 if last else 0
    row = spark.createDataFrame([(build, last["live"] if last else None)], "live string, previous string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/version={version}")


def live_build(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/build_id={pointer(spark, root)['live']}")


def insert_new(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to add when those whose key is there already are left alone; repeated keys count once."""
    return new.dropDuplicates(keys).join(existing, keys, "left_anti")


def upsert_counts(existing: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """existing(keys, n) with one more for each row seen."""
    return existing.select(*keys, "n").unionByName(seen.groupBy(*keys).agg(F.count("*").alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))


def write_csv(df: DataFrame, path: str, licence: str) -> None:
    """Part files that each begin with a licence comment and a header."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns]
    head = f"# {licence}\n{','.join(df.columns)}"
    lines = df.select(F.concat_ws(",", *quoted).alias("value"))

    def begin(batches):
        yield pd.DataFrame({"value": [head]})
        yield from batches

    lines.mapInPandas(begin, "value string").write.mode("overwrite").text(path)


def geojson(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """A Feature as JSON text for each row, all other columns as properties."""
    others = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def encode_tile(layer: str, lines: list[list[tuple[int, int]]], properties: list[dict]) -> bytes:
    """A vector tile of one layer of lines in tile units (0 to 4096) with their properties."""
    zigzag = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
    keys, values, body = {}, {}, b""
    for points, props in zip(lines, properties):
        tags = []
        for k, v in props.items():
            tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
        (x, y), parts = points[0], [9, zigzag(points[0][0]), zigzag(points[0][1]), (len(points) - 1) << 3 | 2]
        for a, b in points[1:]:
            parts += [zigzag(a - x), zigzag(b - y)]
            x, y = a, b
        body += _field(2, _field(2, b"".join(map(_varint, tags))) + b"\x18\x02" + _field(4, b"".join(map(_varint, parts))))
    head = b"\x78\x02" + _field(1, layer.encode())
    names = b"".join(_field(3, k.encode()) for k in keys)
    kinds = b"".join(_field(4, _field(1, v.encode()) if isinstance(v, str) else b"\x19" + struct.pack("<d", v) if isinstance(v, float) else b"\x20" + _varint(v)) for v in values)
    return _field(3, head + body + names + kinds + b"\x28" + _varint(4096))


def tiles(features: DataFrame, layer: str) -> DataFrame:
    """features(z, x, y, points array<struct<x int, y int>>, name string, tier int) -> (z, x, y, tile binary)."""

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tier", "name"])
        lines = [[(int(p["x"]), int(p["y"])) for p in points] for points in pdf["points"]]
        props = [{"name": n, "tier": int(t)} for n, t in zip(pdf["name"], pdf["tier"])]
        return pd.DataFrame([(*key, encode_tile(layer, lines, props))], columns=["z", "x", "y", "tile"])

    return features.groupBy("z", "x", "y").applyInPandas(draw, "z int, x long, y long, tile binary")
