"""Map extracts (the .osm.pbf format) as a Spark data source, read block by block and written as parts.

    spark.dataSource.register(MapExtract)
    ways = spark.read.format("map_extract").option("kind", "ways").load("region.osm.pbf")

A file is a row of blobs, each with a size in front, so its plan is made by hopping over them: a partition is a run of
whole blobs, and a task reads and unpacks only its own. Filters on id are taken into the reader where
spark.sql.python.filterPushdown.enabled is set: rows are dropped before their tags are read. `path` may be a file, a folder
of parts, or a URI that pyarrow knows. Rows keep the file's order within a blob.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMAS = {
    "nodes": "id long, lon double, lat double, tags map<string, string>",
    "ways": "id long, tags map<string, string>, refs array<long>",
    "relations": "id long, tags map<string, string>, members array<struct<type: string, ref: long, role: string>>",
}
TAGS = pa.map_(pa.string(), pa.string())
ARROW = {
    "nodes": pa.schema([("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", TAGS)]),
    "ways": pa.schema([("id", pa.int64()), ("tags", TAGS), ("refs", pa.list_(pa.int64()))]),
    "relations": pa.schema([("id", pa.int64()), ("tags", TAGS), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))]),
}
TYPES = ("node", "way", "relation")
BLOBS = 16  # blobs a partition
ROWS = 8000  # rows a written block


# Wire format: fields are (number << 3 | kind), numbers are varints, signed ones zigzagged, lists of numbers packed.


def fields(data: bytes):
    """(number, value) of a message: bytes for nested ones and lists, else a number."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        key = varint()
        if key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 0:
            yield key >> 3, varint()
        else:
            at += 8 if key & 7 == 1 else 4


def varints(data: bytes) -> np.ndarray:
    """All numbers of a packed list, as unsigned 64-bit ones."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        long_ = starts + k <= ends
        out[long_] |= (b[starts[long_] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(signed(varints(data)))


@dataclass
class Wanted:
    """What is asked of ids."""

    low: int = -(2**63)
    high: int = 2**63 - 1
    among: frozenset | None = None

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        ok = (ids >= self.low) & (ids <= self.high)
        return ok if self.among is None else ok & np.isin(ids, list(self.among))


def block_rows(data: bytes, kind: str, wanted: Wanted) -> list[tuple]:
    """The rows of one kind in a block."""
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for number, value in fields(data):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            step = value
        elif number in (19, 20):
            offset = value - 2**64 if value >= 2**63 else value
            lat0, lon0 = (offset, lon0) if number == 19 else (lat0, offset)
    place = lambda v, offset: (offset + step * v) / 1e9
    tags = lambda m: [(strings[int(k)], strings[int(v)]) for k, v in zip(varints(m.get(2, b"")), varints(m.get(3, b"")))]
    out = []
    for group in groups:
        for number, value in fields(group):
            if kind == "nodes" and number == 2:
                m = dict(fields(value))
                ids, lats, lons, mixed = deltas(m[1]), deltas(m[8]), deltas(m[9]), varints(m.get(10, b"")).tolist()
                ends = [i for i, x in enumerate(mixed) if x == 0] if mixed else []
                # keys and values in turn, a zero after each node's; no list at all: no node has tags
                spans = list(zip([0, *[e + 1 for e in ends[:-1]]], ends)) if ends else []
                if len(spans) != len(ids) and mixed:
                    spans, at = [], 0
                    for _ in range(len(ids)):
                        a = at
                        while mixed[at]:
                            at += 2
                        spans.append((a, at))
                        at += 1
                for i in np.flatnonzero(wanted(ids)):
                    a, z = spans[i] if spans else (0, 0)
                    out.append((int(ids[i]), place(int(lons[i]), lon0), place(int(lats[i]), lat0), [(strings[mixed[j]], strings[mixed[j + 1]]) for j in range(a, z, 2)]))
                continue
            if number != {"nodes": 1, "ways": 3, "relations": 4}[kind]:
                continue
            m = dict(fields(value))
            one = int(signed(np.array([m[1]], np.uint64))[0]) if kind == "nodes" else m[1]
            if not wanted(np.array([one]))[0]:
                continue
            if kind == "nodes":
                lat, lon = (int(signed(np.array([m[k]], np.uint64))[0]) for k in (8, 9))
                out.append((one, place(lon, lon0), place(lat, lat0), tags(m)))
            elif kind == "ways":
                out.append((one, tags(m), deltas(m.get(8, b"")).tolist()))
            else:
                of = zip(varints(m.get(10, b"")).tolist(), deltas(m.get(9, b"")).tolist(), varints(m.get(8, b"")).tolist())
                out.append((one, tags(m), [{"type": TYPES[t], "ref": ref, "role": strings[role]} for t, ref, role in of]))
    return out


class Blobs(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        super().__init__((path, places))
        self.path, self.places = path, places


class ExtractReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path, self.wanted = options.get("kind", "ways"), options["path"], Wanted()
        self.size = int(options.get("blobs", BLOBS))

    def pushFilters(self, filters):
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            w = self.wanted
            if at != ("id",):
                yield f
            elif isinstance(f, EqualTo) and value is not None:
                w.among = frozenset([value]) if w.among is None else w.among & {value}
            elif isinstance(f, In):
                w.among = frozenset(f.value) if w.among is None else w.among & frozenset(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                w.low = max(w.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                w.high = min(w.high, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".pbf"))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for file in files:
            places = []
            with system.open_input_file(file) as f:
                at, end = 0, f.size()
                while at < end:
                    f.seek(at)
                    (n,) = struct.unpack(">I", f.read(4))
                    head = dict(fields(f.read(n)))
                    if head[1] == b"OSMData":
                        places.append((at + 4 + n, head[3]))
                    at += 4 + n + head[3]
            out += [Blobs(file, places[i : i + self.size]) for i in range(0, len(places), self.size)]
        return out or [Blobs("", [])]

    def read(self, partition):
        schema = ARROW[self.kind]
        if not partition.places:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as f:
            for at, size in partition.places:
                f.seek(at)
                blob = dict(fields(f.read(size)))
                rows = block_rows(blob[1] if 1 in blob else zlib.decompress(blob[3]), self.kind, self.wanted)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def packed(values, zigzag: bool = False) -> bytes:
    out = bytearray()
    for v in values:
        v = (v << 1) ^ (v >> 63) if zigzag else v
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def message(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return packed([number << 3, value])
    return packed([number << 3 | 2, len(value)]) + value


def steps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values)]


def blob(kind: str, data: bytes) -> bytes:
    body = message(2, len(data)) + message(3, zlib.compress(data))
    head = message(1, kind.encode()) + message(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block(kind: str, rows: list) -> bytes:
    """A block of rows with the columns of SCHEMAS."""
    strings: dict[str, int] = {"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    body = b""
    if kind == "nodes":
        mixed = []
        for r in rows:
            for k, v in (r["tags"] or {}).items():
                mixed += [number(k), number(v)]
            mixed.append(0)
        whole = lambda c: packed(steps([round(r[c] * 1e7) for r in rows]), True)
        body = message(2, message(1, packed(steps([r["id"] for r in rows]), True)) + message(8, whole("lat")) + message(9, whole("lon")) + message(10, packed(mixed)))
    for r in rows if kind != "nodes" else ():
        tags = (r["tags"] or {}).items()
        one = message(1, r["id"]) + message(2, packed([number(k) for k, _ in tags])) + message(3, packed([number(v) for _, v in tags]))
        if kind == "ways":
            body += message(3, one + message(8, packed(steps(r["refs"] or []), True)))
        else:
            of = r["members"] or []
            body += message(4, one + message(8, packed([number(m["role"] or "") for m in of])) + message(9, packed(steps([m["ref"] for m in of]), True)) + message(10, packed([TYPES.index(m["type"]) for m in of])))
    table = b"".join(message(1, s.encode()) for s in strings)
    return message(1, table) + message(2, body) + message(17, 100)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ExtractWriter(DataSourceWriter):
    """Every task writes a part of its own, a whole extract file, under a hidden name; the commit shows them."""

    def __init__(self, options):
        self.kind, self.path = options.get("kind", "ways"), options["path"]

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        hidden = f"{self.path}/.{self.kind}-{uuid.uuid4().hex}.osm.pbf"
        rows, any_ = [], False
        with open(hidden, "wb") as f:
            f.write(blob("OSMHeader", message(4, b"OsmSchema-V0.6") + message(4, b"DenseNodes")))
            for row in iterator:
                rows.append(row.asDict(True))
                any_ = True
                if len(rows) == ROWS:
                    f.write(blob("OSMData", block(self.kind, rows)))
                    rows = []
            if rows:
                f.write(blob("OSMData", block(self.kind, rows)))
        if not any_:
            os.remove(hidden)
        return Written(hidden if any_ else None)

    def commit(self, messages):
        for m in messages:
            if m and m.path:
                os.rename(m.path, os.path.join(os.path.dirname(m.path), os.path.basename(m.path)[1:]))

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class MapExtract(DataSource):
    """Options: kind (nodes, ways or relations), blobs (to a partition)."""

    @classmethod
    def name(cls):
        return "map_extract"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "ways")]

    def reader(self, schema):
        return ExtractReader(self.options)

    def writer(self, schema, overwrite):
        return ExtractWriter(self.options)


# Scans over the tables.


def located_ways(ways: DataFrame, nodes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Ways (those wanted) with pts, an array of (lon, lat) in order; nodes that the extract lacks are left out, and so are
    ways of fewer than two. Only referenced nodes meet, once each, so a node of many ways isn't read again."""
    ways = ways if wanted is None else ways.where(wanted)
    refs = ways.select("id", F.posexplode("refs").alias("i", "node"))
    at = nodes.select(F.col("id").alias("node"), "lon", "lat").join(refs.select("node").distinct(), "node")
    pts = refs.join(at, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("p"))
    return ways.join(pts, "id").withColumn("pts", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).drop("p").where(F.size("pts") >= 2)


def route_members(relations: DataFrame) -> DataFrame:
    """(way, hiking, bicycle_networks, mtb): ways in route relations, a list of route words read part by part."""
    words = F.transform(F.split(F.coalesce(F.col("tags")["route"], F.lit("")), ";"), lambda w: F.trim(w))
    kind = lambda *names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    told = relations.select(kind("hiking", "foot").alias("hiking"), F.when(kind("bicycle"), F.coalesce(F.col("tags")["network"], F.lit(""))).alias("network"), kind("mtb").alias("mtb"), F.explode("members").alias("m")).where("m.type = 'way' AND (hiking OR network IS NOT NULL OR mtb)")
    return told.groupBy(F.col("m.ref").alias("way")).agg(F.bool_or("hiking").alias("hiking"), F.array_sort(F.collect_set("network")).alias("bicycle_networks"), F.bool_or("mtb").alias("mtb"))


def boundary_ways(relations: DataFrame, level: str = "4", area: str = "ref") -> DataFrame:
    """(area, role: outer or inner, way) of administrative boundaries of a level, by the tag that names the area."""
    tag = lambda k: F.col("tags")[k]
    found = relations.where((tag("boundary") == "administrative") & (tag("admin_level") == level) & tag(area).isNotNull())
    each = found.select(tag(area).alias("area"), F.explode("members").alias("m")).where("m.type = 'way'")
    return each.select("area", F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), F.col("m.ref").alias("way"))


def nodes_in_box(nodes: DataFrame, box: tuple[float, float, float, float], wanted: Column) -> DataFrame:
    """Nodes wanted inside (west, south, east, north)."""
    west, south, east, north = box
    return nodes.where(F.col("lon").between(west, east) & F.col("lat").between(south, north) & wanted)
