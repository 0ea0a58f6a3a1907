"""Places of addresses from database files: ``spark.read.format("geoblocks")``, and what a country and a city database say together.

A file holds a binary tree over the bits of addresses, a section of typed data that the tree's leaves point into, and
metadata at its end (the public MaxMind DB format, version 2). The driver walks the tree's top; each task takes some of the subtrees it
finds and tells their leaves as blocks of addresses, lowest and highest. Addresses are then joined with blocks by equal prefixes, so no
row looks into a file. Files must be reachable by path from the executors, as logs are.
"""

from __future__ import annotations

import math
import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from logloom.functions.geo import city_point, range_lookup
from logloom.shared import materialise

#: What stands before the metadata, how far from the end it may be, the gap before the data, and what is stored of IPv4.
MARKER, FARTHEST, GAP, MAPPED = b"\xab\xcd\xefMaxMind.com", 128 << 10, 16, 0xFFFF << 32
#: Codes that count as parts of CN.
CHINA = ("CN", "HK", "MO", "TW")
#: Subtrees that the driver looks for; a task takes one.
SPLITS, BATCH = 64, 4096
CUSTOM = ["c1", "c2", "c3", "c4"]
TEXTS = ["iso", "province", "city", "code1", "code2", *CUSTOM]
SCHEMA = "lo string, hi string, " + ", ".join(f"{c} string" for c in TEXTS) + ", city_id long, lat double, lon double"


class Database:
    """A file's tree and data. Records are read where they stand."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = self.data.rfind(MARKER, max(0, len(self.data) - FARTHEST))
        if at < 0:
            raise ValueError(f"not a database of places: {path}")
        told, _ = self.value(at + len(MARKER), at + len(MARKER))
        self.nodes, self.bits, self.wide = told["node_count"], told["record_size"], told["ip_version"] == 6
        self.base = self.nodes * self.bits // 4 + GAP
        v4 = 0
        for _ in range(96 if self.wide else 0):
            v4 = self.child(v4, 0) if v4 < self.nodes else v4
        self.v4 = v4

    def child(self, node: int, side: int) -> int:
        at, n = node * self.bits // 4, self.bits // 8
        if self.bits == 28:  # the two halves of the middle byte are the highest bits of either side
            own = self.data[at : at + 7]
            return ((own[3] >> 4) << 24 | int.from_bytes(own[:3], "big")) if side == 0 else ((own[3] & 15) << 24 | int.from_bytes(own[4:], "big"))
        return int.from_bytes(self.data[at + side * n : at + side * n + n], "big")

    def value(self, at: int, base: int) -> tuple:
        """The value at ``at`` and where the next one stands; pointers count from ``base``."""
        head = self.data[at]
        kind, size, at = head >> 5, head & 31, at + 1
        if kind == 1:
            n = (size >> 3) + 1
            low = int.from_bytes(self.data[at : at + n], "big")
            to = low if n == 4 else ((size & 7) << 8 * n | low) + (0, 2048, 526336)[n - 1]
            return self.value(base + to, base)[0], at + n
        if kind == 0:
            kind, at = self.data[at] + 7, at + 1
        if size >= 29 and kind != 14:
            n, least = size - 28, (29, 285, 65821)[size - 29]
            size, at = least + int.from_bytes(self.data[at : at + n], "big"), at + n
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self.value(at, base)
                out[key], at = self.value(at, base)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self.value(at, base)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw = self.data[at : at + size]
        if kind == 2:
            return raw.decode("utf-8", "replace"), at + size
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at + size
        return (raw if kind == 4 else int.from_bytes(raw, "big", signed=kind == 8)), at + size

    def top(self, wanted: int) -> list[tuple[int, int, int]]:
        """Entries of the tree (value, prefix, bits of it) that together are all of it."""
        found = [(0, 0, 0)]
        for _ in range(128):
            if len(found) >= wanted or all(v >= self.nodes for v, _, _ in found):
                break
            found = [x for v, p, d in found for x in ([(self.child(v, s), p << 1 | s, d + 1) for s in (0, 1)] if v < self.nodes else [(v, p, d)]) if x[0] != self.nodes]
        return found

    def blocks(self, entry: tuple[int, int, int]) -> Iterator[tuple[int, int, dict]]:
        """Lowest and highest address of each leaf below, and its record. IPv4 addresses are told as mapped ones, and not again where the tree maps them itself."""
        whole, stack, known = 128 if self.wide else 32, [entry], {}
        while stack:
            v, prefix, depth = stack.pop()
            if v < self.nodes:
                if not (self.wide and depth == 96 and prefix == 0xFFFF and v == self.v4):
                    stack += [(self.child(v, s), prefix << 1 | s, depth + 1) for s in (1, 0)]
            elif v > self.nodes:
                if v not in known:
                    known[v] = self.value(v - self.nodes - GAP + self.base, self.base)[0]
                    if len(known) > 1 << 16:
                        known = {v: known[v]}
                low = prefix << (whole - depth)
                high = low | (1 << (whole - depth)) - 1
                if not self.wide or (high >> 32 == 0):
                    yield low | MAPPED, high | MAPPED, known[v]
                else:
                    yield low, high, known[v]
                    if low == 0:
                        yield MAPPED, MAPPED | 0xFFFFFFFF, known[v]


def _text(*values) -> str:
    """The first that isn't blank, without blanks around it."""
    return next((t for t in ((v.strip() if isinstance(v, str) else "") for v in values) if t), "")


def told(record: dict) -> tuple:
    """What is kept of a record, as TEXTS, the city's id and coordinates: English names before Chinese ones, an explicit province before the first subdivision."""
    part = lambda name: record.get(name) if isinstance(record.get(name), dict) else {}
    subs = [s for s in record.get("subdivisions") or [] if isinstance(s, dict)]
    names = lambda p: p.get("names") if isinstance(p.get("names"), dict) else {}
    first, province, city, where = (subs or [{}])[0], part("province"), part("city"), part("location")

    def name(*places: dict) -> str:
        return _text(*[x for p in places for x in (p.get("name"), names(p).get("en"))], *[x for p in places for x in (p.get("name_zh"), names(p).get("zh-CN"))])

    codes = [_text(s.get("iso_code")) for s in subs[:2]] + ["", ""]
    number = lambda x: float(x) if isinstance(x, (int, float)) and math.isfinite(x) else None
    city_id = city.get("geoname_id")
    return (
        _text(part("country").get("iso_code")), name(province, first), name(city), *codes[:2], *[_text(record.get(c)) for c in CUSTOM],
        city_id if isinstance(city_id, int) else 0, number(where.get("latitude")), number(where.get("longitude")),
    )


@dataclass
class Subtree(InputPartition):
    value: int
    prefix: int
    depth: int


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Subtree(*x) for x in Database(self.path).top(SPLITS)] or [Subtree(-1, 0, 0)]

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        if part.value < 0:
            return
        fields = [x.split() for x in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t] for _, t in fields]
        rows = ((f"{low:032x}", f"{high:032x}", *told(record)) for low, high, record in Database(self.path).blocks((part.value, part.prefix, part.depth)) if isinstance(record, dict))
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], [n for n, _ in fields])


class GeoBlocks(DataSource):
    """Blocks of addresses of the file ``path``, as SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "geoblocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GeoBlocks)
    return spark.read.format("geoblocks").option("path", path).load()


class Places:
    """A database of countries, and one of cities or none. Either is read when the first addresses are placed, once."""

    def __init__(self, spark: SparkSession, countries: str | None, cities: str | None = None) -> None:
        self.spark, self.paths, self.blocks = spark, (countries, cities), {}

    def _blocks(self, k: int) -> DataFrame | None:
        if self.paths[k] and k not in self.blocks:
            self.blocks[k] = materialise(read_blocks(self.spark, self.paths[k]), keep=True)
        return self.blocks.get(k)

    def locate(self, rows: DataFrame, address: str = "ip_hex") -> DataFrame:
        """``address`` and, for each different one that is placed, its names, null where there are none.

        The country database tells the country. Without a city database that is all. With one, what the first doesn't know is told by
        the second, and HK, MO and TW are regions of CN.
        """
        asked = rows.select(address).where(F.col(address).isNotNull()).distinct()
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        countries, cities = self._blocks(0), self._blocks(1)
        known = asked.withColumn("cc", F.lit(None).cast("string")) if countries is None else asked.join(range_lookup(asked, countries.select("lo", "hi", F.col("iso").alias("cc")), address), address, "left")
        null = lambda c: F.nullif(c, F.lit(""))
        if cities is None:
            only = known.where("cc <> ''").select(address, F.col("cc").alias("region_code"))
            return only.withColumns({c: F.lit(None).cast("string") for c in ("province", "city", "sub1", "sub2", "city_point", *CUSTOM)})
        both = known.join(range_lookup(asked, cities, address), address, "left").where("cc <> '' or iso is not null")
        cc, iso = empty("cc"), empty("iso")
        region = F.coalesce(null(cc), iso)
        country = F.coalesce(null(iso), region)
        sub = lambda c: F.when((empty(c) != "") & (country != ""), F.concat(country, F.lit("-"), F.col(c))).otherwise("")
        china = region.isin(*CHINA) | iso.isin(*CHINA)
        part = china & country.isin(*CHINA[1:])
        shown = F.when(china, "CN").otherwise(region)
        point = F.when((empty("city") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), city_point(shown, F.col("city"), F.coalesce("city_id", F.lit(0)), F.col("lat"), F.col("lon")))
        told = {
            "region_code": shown, "province": empty("province"), "city": empty("city"), "sub1": F.when(part, F.concat(F.lit("CN-"), country)).otherwise(sub("code1")),
            "sub2": F.when(part, "").otherwise(sub("code2")), "city_point": F.coalesce(point, F.lit("")), **{c: empty(c) for c in CUSTOM},
        }
        return both.select(address, *[null(v).alias(c) for c, v in told.items()])


# writing a database of one's own


def _head(kind: int, size: int) -> bytes:
    more, extra = size, b""
    for code, least, n in ((31, 65821, 3), (30, 285, 2), (29, 29, 1)):
        if size >= least:
            more, extra = code, (size - least).to_bytes(n, "big")
            break
    return (bytes([kind << 5 | more]) if kind < 8 else bytes([more, kind - 7])) + extra


def _encoded(value) -> bytes:
    if isinstance(value, bool):
        return _head(14, int(value))
    if isinstance(value, dict):
        return _head(7, len(value)) + b"".join(_encoded(k) + _encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return _head(11, len(value)) + b"".join(map(_encoded, value))
    if isinstance(value, str):
        return _head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return _head(3, 8) + struct.pack(">d", value)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return _head(6 if len(raw) <= 4 else 9, len(raw)) + raw


def write_database(path: str, records: list[tuple[str, str, dict]], bits: int = 32) -> None:
    """A file of blocks (lowest and highest address as 32 digits, each all of a prefix) and their records; an inner block stands for itself.

    For tables that a site keeps of its own addresses, so of a size that a driver holds.
    """
    tree: list[list] = [[None, None]]  # a child is None, ("node", k) or ("data", offset)
    data, offsets = b"", {}
    for low, high, record in sorted(records, key=lambda r: -(int(r[1], 16) - int(r[0], 16))):
        a, b = int(low, 16), int(high, 16)
        if a >> 32 == 0xFFFF:  # IPv4 stands at the tree's zeros
            a, b = a - MAPPED, b - MAPPED
        depth = 128 - (a ^ b).bit_length()
        raw = _encoded(record)
        if raw not in offsets:
            offsets[raw] = len(data)
            data += raw
        node = 0
        for d in range(depth - 1):
            side = a >> (127 - d) & 1
            child = tree[node][side]
            if child is None or child[0] == "data":
                tree.append([child, child])
                tree[node][side] = ("node", len(tree) - 1)
            node = tree[node][side][1]
        tree[node][a >> (128 - depth) & 1] = ("data", offsets[raw])
    n = len(tree)
    number = lambda c: n if c is None else c[1] if c[0] == "node" else n + GAP + c[1]

    def pair(left: int, right: int) -> bytes:
        if bits == 28:
            return (left & 0xFFFFFF).to_bytes(3, "big") + bytes([left >> 24 << 4 | right >> 24]) + (right & 0xFFFFFF).to_bytes(3, "big")
        return left.to_bytes(bits // 8, "big") + right.to_bytes(bits // 8, "big")

    told = {"node_count": n, "record_size": bits, "ip_version": 6, "binary_format_major_version": 2, "binary_format_minor_version": 0, "database_type": "places", "languages": ["en"], "build_epoch": 0, "description": {"en": "places"}}
    with open(path, "wb") as f:
        f.write(b"".join(pair(number(a), number(b)) for a, b in tree) + bytes(GAP) + data + MARKER + _encoded(told))
