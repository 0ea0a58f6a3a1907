"""Tokens, parsed lines, clients, addresses and names of logs."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions import geo, parse, useragent
from logloom.functions.ip import hex_of, hex_range, ipv4_hex
from logloom.functions.tokens import token_array, tokenize, unescape
from logloom.queries import ROTATIONS
from logloom.sources.logs import Catalogue, HostLog, clean_path, decode_path, encode_path, main_log_path

NOW = 1_800_000_000


@pytest.mark.parametrize(
    ("text", "full", "query", "want"),
    [
        ("GET /a_b", True, False, [(0, "get"), (1, "a"), (2, "b")]),
        ("1.2.3", True, False, [(0, "1"), (0, "1.2"), (0, "1.2.3")]),
        ("1.2.3", True, True, [(0, "1.2.3")]),
        ("1.2.3", False, False, [(0, "1"), (1, "2"), (2, "3")]),
        ("1.2abc", True, False, [(0, "1"), (1, "2abc")]),
        ("::1 x", True, False, [(0, "::1"), (1, "x")]),
        ("2001:DB8:0::1.", True, False, [(0, "2001:db8::1")]),
        ("中文字", True, False, [(0, "中"), (0, "中文"), (1, "文"), (1, "文字"), (2, "字")]),
        ("中文字", True, True, [(0, "中文"), (1, "文字")]),
        ("中", True, True, [(0, "中")]),
        ("../x", True, False, [(0, "../"), (1, "x")]),
        ("a😀b", False, False, [(0, "a"), (1, "😀"), (2, "b")]),
        ("a%20b", True, False, [(0, "a"), (1, "b")]),
        ("x" * 300 + " y", True, False, [(1, "y")]),
        ("", True, False, []),
    ],
)
def test_tokens(text, full, query, want):
    assert tokenize(text, full, query) == want


def test_unescape():
    assert unescape(r"%E4%B8%AD\xe6\x96\x87") == "中文"
    assert unescape("100%zz+%2") == "100%zz+%2"
    assert unescape("%2541") == "%41"


def test_tokens_of_a_batch_are_no_python_objects():
    texts = [None, "", *["10.0.0.1 " + "word " * 400] * 1000]
    tracemalloc.start()
    got = token_array(pa.array(texts), True)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 30e6  # 404,000 tokens; as dicts they take over 100 MB
    assert got[0].as_py() is None and got[1].as_py() == []
    for k in (2, 500, 1001):
        assert [(t["pos"], t["term"]) for t in got[k].as_py()] == tokenize(texts[k], True)


def line(time="07/Sep/2026:15:32:29 +0000", request="GET /a/b?x=1 HTTP/2.0", status="200", rest='512 "-" "curl/8.0" 0.012 0.010', ip="203.0.113.9"):
    return f'{ip} - - [{time}] "{request}" {status} {rest}'


def test_access_lines(spark):
    lines = [
        line(), line(time="07/Sep/2026:15:32:29 +0800"), line(request="FETCH /x HTTP/1.1"), line(status="999"), line(rest='12 "-" "ua"'), line(rest="77"),
        line(ip="http://evil"), line(request=r"GET /\x16 HTTP/1.1"), "short", line(time="2026-09-07T15:32:29Z"), line(time="31/Feb/2026:00:00:60 +0000"), line(ip="-"), line(rest='1 "-" "u" - 5d'), None, "", "x" * 20000,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = {r["i"]: r for r in parse.access_rows(df, NOW).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 9, 10, 11, 12}
    assert (got[0]["ts"], got[0]["method"], got[0]["path"], got[0]["status"], got[0]["bytes_sent"], got[0]["request_time"], got[0]["upstream_time"]) == (1788795149, "GET", "/a/b?x=1", 200, 512, 0.012, 0.01)
    assert got[1]["ts"] == 1788795149 - 8 * 3600 and got[9]["ts"] == 1788795149
    assert got[2]["method"] is None and got[2]["path"] == "/x" and got[3]["status"] == 0
    assert got[4]["user_agent"] == "ua" and got[4]["request_time"] is None and got[5]["bytes_sent"] == 77
    assert got[10]["ts"] == 1772496060 and got[12]["request_time"] is None and got[12]["upstream_time"] is None


def test_error_lines(spark):
    text = '2026/09/07 15:32:29 [error] 1234#5678: *90 open() failed, client: 1.2.3.4, server: a.com, request: "GET /x HTTP/1.1", upstream: "http://u", host: "h", referrer: "r"'
    lines = [text, "2026/09/07 15:32:29 [loud] nope, not a level at all", "2026/09/07 15:32:29 [warn] just text, with a comma", "  at a continuation line of a trace", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = {r["i"]: r["e"] for r in df.withColumn("p", parse.error_parts(F.col("raw"))).withColumn("c", parse.error_context(F.col("p"))).select("i", parse.error_fields(F.col("p"), F.col("c")).alias("e")).where("e is not null").collect()}
    assert set(got) == {0, 2}
    assert got[0].asDict() == {"ts": 1788795149, "level": "error", "pid": 1234, "connection": 90, "message": "open() failed", "client": "1.2.3.4", "server": "a.com", "method": "GET", "path": "/x", "request": "GET /x HTTP/1.1", "upstream": "http://u", "host": "h", "referrer": "r"}
    assert got[2]["message"] == "just text, with a comma" and got[2]["client"] == ""


AGENTS = [
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_4_1 like Mac OS X) Version/17.4 Mobile Safari/604.1", "Safari", "17.4", "iOS", "17.4.1", "iPhone"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/126.0.0.0 Safari/537.36", "Chrome", "126.0", "Windows", "10", "Desktop"),
    ("Mozilla/5.0 (Linux; Android 14; SM-X710) Chrome/125.0.0.0 Safari/537.36", "Chrome", "125.0", "Android", "14", "Tablet"),
    ("Mozilla/5.0 (Linux; Android 13) Mobile MicroMessenger/8.0.40", "WeChat", "8.0", "Android", "13", "Mobile"),
    ("Googlebot/2.1", "Bot", "", "", "", "Bot"),
    ("-", "", "", "", "", ""),
    ("", "", "", "", "", ""),
]


def test_clients(spark):
    df = spark.createDataFrame([(a[0],) for a in AGENTS], "user_agent string")
    got = {r["user_agent"]: tuple(r[c] for c in ("browser", "browser_version", "os", "os_version", "device_type")) for r in useragent.clients(df).collect()}
    assert got == {a[0]: a[1:] for a in AGENTS}


def test_versions_by_name(spark):
    """A version is told by the name that the rules gave as they tell it themselves."""
    from pyspark.sql import functions as F

    made = [f"x {v[2].replace(chr(92), '').replace('(d+.d+)', '7.5').split('|')[0]} y {n}" for v in useragent.BROWSERS for n in ("Windows NT 10.0", "android 4.4.0", "OS 17_4_1") if v[2]]
    agents = [a[0] for a in AGENTS] + made + ["musically_2.1.3", "QQ/1.2.3", "qihoobrowser/3.4", "rhel 7.1", "MicroMessenger/8", "AlipayClient/10.2.3"]
    ua = F.col("ua")
    df = spark.createDataFrame([(a,) for a in agents], "ua string").select("ua", useragent.browser(ua).alias("b"), useragent.system(ua).alias("s"))
    got = df.select("ua", useragent.browser_version(ua), useragent.browser_version(ua, F.col("b")), useragent.system_version(ua), useragent.system_version(ua, F.col("s"))).collect()
    assert [r["ua"] for r in got if r[1] != r[2] or r[3] != r[4]] == [] and len({r[1] for r in got}) > 3


def test_odd_requests(spark):
    """Words of a request are told by the line's pattern, and a quote that never ends doesn't take long."""
    requests = ["GET /a HTTP/1.1", "  GET   /a\tHTTP/2 x y", "", "   ", "FETCH /x", "GET", " /only", "PUT /a\u00a0b HTTP/1.1"]
    df = spark.createDataFrame([(i, line(request=r)) for i, r in enumerate(requests)] + [(99, line(request='GET "' + "a b " * 4000)[:16000])], "i int, raw string")
    got = {r["i"]: tuple(r["e"][c] for c in ("method", "path", "protocol")) for r in df.withColumn("p", parse.access_parts(df["raw"])).select("i", parse.access_fields(F.col("p")).alias("e")).where("e is not null").collect()}
    want = [("GET", "/a", "HTTP/1.1"), ("GET", "/a", "HTTP/2"), ("", "", ""), ("", "", ""), ("", "/x", ""), ("GET", "", ""), ("", "", ""), ("PUT", "/a\u00a0b", "HTTP/1.1")]
    assert [got[i] for i in range(len(requests))] == want


def test_addresses(spark):
    assert hex_range("10.1.2.3/8") == (hex_of("10.0.0.0"), hex_of("10.255.255.255"))
    assert hex_range("::/0") == ("0" * 32, "f" * 32) and hex_range("1.2.3") is None
    df = spark.createDataFrame([("10.0.0.1",), ("256.1.1.1",), ("x",), (None,)], "ip string")
    assert [r[0] for r in df.select(ipv4_hex(F.col("ip"))).collect()] == [hex_of("10.0.0.1"), None, None, None]


def test_places(spark):
    df = spark.createDataFrame([("DE", "A|B", 7, 1.005, -2.5)], "c string, n string, i long, lat double, lon double")
    key = geo.city_point(F.col("c"), F.col("n"), F.col("i"), F.col("lat"), F.col("lon"))
    got = df.select(key.alias("k"), geo.parsed_point(key).alias("p"), geo.parsed_point(F.lit("x|y")).alias("bad"), geo.location_label([F.lit("CN"), F.lit(""), F.lit("X")], True).alias("l")).first()
    assert got["k"].startswith("DE|A/B|1.0") and got["p"]["city_id"] == 7 and got["bad"] is None and got["l"] == "中国 X"


@pytest.mark.parametrize(("path", "main"), ROTATIONS)
def test_rotations(path, main):
    assert main_log_path(path) == main


def test_paths():
    assert clean_path("/a/./b//../c") == "/a/c" and clean_path("") == "."
    assert decode_path(encode_path("/l/日志.log")) == "/l/日志.log"
    assert [decode_path(x) for x in ("b64_", "b64_!!", "/plain", "b64_AA")] == ["b64_", "b64_!!", "/plain", "b64_AA"]


def test_catalogue():
    c = Catalogue([HostLog("rel.log"), HostLog("/l/./a.log"), HostLog("/l/a.log", "error"), HostLog("/l/a.log.1"), HostLog("/l/e.log", "error")])
    assert [x.path for x in c.logs] == ["/l/a.log", "/l/a.log.1", "/l/e.log"] and c.default_access() == "/l/a.log"
    assert c.groups() == [("/l/a.log", "access"), ("/l/e.log", "error")]
    assert c.is_valid("/l/a.log.7") and not c.is_valid("/etc/passwd") and not c.is_valid("l/a.log")


def test_bots(spark):
    from pyspark.sql import functions as F

    from logloom.functions import useragent

    names = ["Googlebot/2.1", "bingbot", "TelegramBot", "Applebot", "LinkedInBot", "YandexBot", "Twitterbot", "Baiduspider", "360Spider", "a crawler", "WhatsApp/2", "Slurp", "Pinterest", "Bytedance", "RoboZilla", "facebookexternalhit/1.1"]
    df = spark.createDataFrame([(f"Mozilla/5.0 (compatible; {n})",) for n in names], "ua string")
    assert {tuple(r) for r in df.select(useragent.browser(F.col("ua")), useragent.device(F.col("ua"))).collect()} == {("Bot", "Bot")}
