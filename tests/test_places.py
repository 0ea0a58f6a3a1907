"""Databases of places: files of every record size, both families, and what two of them say together."""

import ipaddress
import random

import pytest

from logloom.functions.ip import hex_of, hex_range
from logloom.sources import places as pl


def block(cidr, **record):
    return (*hex_range(cidr), record)


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_blocks_are_what_was_written(bits, spark, tmp_path, monkeypatch):
    rng = random.Random(bits)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32), rng.choice([8, 12, 16, 24, 32])), strict=False)) for _ in range(150)}
    nets |= {str(ipaddress.ip_network((rng.getrandbits(125) | 1 << 125, rng.choice([20, 32, 48, 128])), strict=False)) for _ in range(100)}
    path = str(tmp_path / "db")
    pl.write_database(path, [block(n, country={"iso_code": n}) for n in nets], bits)
    rows = pl.read_blocks(spark, path)
    assert rows.rdd.getNumPartitions() >= 16
    got = [(int(r["lo"], 16), int(r["hi"], 16), r["iso"]) for r in rows.collect()]
    got.sort()
    assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
    held = [(ipaddress.ip_network(n), n) for n in nets]
    for _ in range(2000):
        net = rng.choice(held)[0]
        ip = net[rng.randrange(min(net.num_addresses, 1 << 40))] if rng.random() < 0.8 else ipaddress.ip_address(rng.getrandbits(32))
        want = max((n for n in held if n[0].version == ip.version and ip in n[0]), key=lambda n: n[0].prefixlen, default=(0, None))[1]
        at = int(hex_of(str(ip)), 16)
        assert next((c for a, b, c in got if a <= at <= b), None) == want


def test_records(tmp_path):
    record = {"a": "x" * 29, "b": "y" * 300, "c": "z" * 70_000, "n": [1, 0, 70_000, 1 << 40, True, False, -1.5], "names": {"zh-CN": "中"}}
    path = str(tmp_path / "db")
    pl.write_database(path, [block("1.2.3.0/24", **record), block("::1/128", **record)])
    db = pl.Database(path)
    assert [r for _, _, r in db.blocks((0, 0, 0))] == [record, record]
    with pytest.raises(ValueError):
        (tmp_path / "x").write_bytes(b"no database")
        pl.Database(str(tmp_path / "x"))


def test_pointers():
    """A value may be a pointer of one to four bytes; what it counts from depends on its length."""
    text = pl._encoded("there")
    for n, to in ((1, 100), (2, 2048 + 77), (3, 526336 + 9), (4, 600_000)):
        low = to - (0, 2048, 526336, 0)[n - 1]
        head = bytes([1 << 5 | (n - 1) << 3 | (low >> 8 * n if n < 4 else 0)]) + (low & (1 << 8 * n) - 1).to_bytes(n, "big")
        data = bytearray(600_100)
        data[: len(head)] = head
        data[to : to + len(text)] = text
        db = object.__new__(pl.Database)
        db.data = bytes(data)
        assert db.value(0, 0) == ("there", len(head))


def test_two_databases(spark, tmp_path):
    countries, cities = str(tmp_path / "a"), str(tmp_path / "b")
    pl.write_database(countries, [block("1.0.0.0/8", country={"iso_code": "FR"}), block("3.0.0.0/8", country={"iso_code": "TW"}), block("2001:db8::/32", country={"iso_code": "JP"})])
    pl.write_database(cities, [block("1.1.0.0/16", city={"names": {"en": " Lyon "}}, subdivisions=[{"iso_code": "ARA"}]), block("2.0.0.0/8", country={"iso_code": "MO"}, c2="x"), block("3.3.3.0/24", country={"iso_code": "JP"}, subdivisions=[{"iso_code": "13", "names": {"zh-CN": "东京"}}])])
    asked = spark.createDataFrame([(hex_of(x),) for x in ("1.1.2.3", "1.2.3.4", "2.2.2.2", "3.3.3.3", "3.4.4.4", "2001:db8::5", "9.9.9.9")] + [(None,)], "ip_hex string")
    shown = lambda p: {r["ip_hex"][-8:]: tuple(r[c] for c in ("region_code", "province", "city", "sub1", "sub2", "c2")) for r in p.locate(asked).collect()}
    assert shown(pl.Places(spark, countries, cities)) == {
        "01010203": ("FR", None, "Lyon", "FR-ARA", None, None), "01020304": ("FR", None, None, None, None, None), "02020202": ("CN", None, None, "CN-MO", None, "x"),
        "03030303": ("CN", "东京", None, "JP-13", None, None), "03040404": ("CN", None, None, "CN-TW", None, None), "00000005": ("JP", None, None, None, None, None),
    }
    # without cities nothing is folded
    assert shown(pl.Places(spark, countries)) == {k: (c, *[None] * 5) for k, c in (("01010203", "FR"), ("01020304", "FR"), ("03030303", "TW"), ("03040404", "TW"), ("00000005", "JP"))}
    assert shown(pl.Places(spark, None, cities)).keys() == {"01010203", "02020202", "03030303"}


def test_rounds_take_databases(spark, tmp_path):
    from logloom.engine import Engine
    from logloom.sources.logs import Catalogue, HostLog
    from logloom.sources.store import Store
    from test_rounds import NOW, lines

    log = tmp_path / "access.log"
    log.write_text(lines(0, 20))
    pl.write_database(str(tmp_path / "cities"), [block("203.0.113.0/28", country={"iso_code": "HK"}, city={"names": {"en": "Kowloon"}}, c1="lan")])
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Catalogue([HostLog(str(log))]))
    engine.rounds.locations = pl.Places(spark, None, str(tmp_path / "cities"))
    engine.rounds.run(now=NOW)
    hits = {r["path"]: r["location"] for r in engine.hits(engine.entries(limit=20), chinese=True).select("path", "location").collect()}
    assert hits["/p/3"] == "中国 Kowloon lan" and hits["/p/19"] == ""
