"""The search box over five rows with hand-computed hits, and its warnings."""

import pytest
from pyspark.sql import functions as F

from logloom.functions.ip import ip_hex
from logloom.functions.tokens import tokenize_atoms, tokenize_full
from logloom.plans.filters import Filter, compile_filter, filter_of, validate_range
from logloom.plans.qsyntax import Item, Span, parse

ROWS = [
    (100, "1.1.1.1", "GET", "/wp-login.php", "Mozilla/5.0 Chrome/126.0.0.0", None, "GET /wp-login.php 192.168.1.10 union%20select", 404, 500, 0.9, "Chrome", "Windows", "desktop", "US", "California"),
    (200, "2.2.2.2", "GET", "/about", "curl/8.4", "https://www.google.com/", "GET /about from google.com", 200, 1500, 0.1, None, None, None, None, None),
    (300, "1.1.1.1", "GET", "/about/us", "Mozilla/5.0 Firefox/127.0", None, "GET /about/us nginx ui", 200, 50, None, "Firefox", "Linux", "desktop", "CN", "广东"),
    (400, "3.3.3.3", "POST", "/how-to/start", "Googlebot/2.1", None, "POST /how-to/start", 500, 20000, 2.5, "Googlebot", None, "bot", "US", None),
    (500, "2001:db8::1", "GET", "/", "Safari/17", None, "GET / ipv6", 200, 10, 0.01, "Safari", "iOS", "mobile", "JP", None),
]
SCHEMA = "ts long, ip string, method string, path string, user_agent string, referer string, raw string, status int, bytes_sent long, request_time double, browser string, os string, device_type string, region_code string, province string"
HITS = {
    "status:404": [100], "status:5xx": [400], "status:2xx": [200, 300, 500], "status:400-499": [100], "status:400..599": [100, 400], "status:>=404": [100, 400], "status:>404": [400],
    "status:<404": [200, 300, 500], "status:<=200": [200, 300, 500], "method:POST": [400], "method:post": [400], "method:get": [100, 200, 300, 500], "ip:1.1.1.1": [100, 300],
    "ip:1.1.1.0/24": [100, 300], "ip:1.0.0.0/8": [100, 300], "ip:0.0.0.0/0": [100, 200, 300, 400], "ip:2.2.2.2/32": [200], "ip:10.0.0.0/8": [], "ip:2001:db8::/32": [500],
    "ip:2001:db8::1": [500], "ip:2001:db9::/32": [], "ip:::/0": [100, 200, 300, 400, 500], "path:/about": [200, 300], "path:/about/us": [300], "path:us/about": [], 'path:"/how-to/"': [400],
    "ua:curl": [200], "ua:Chrome/126": [100], "referer:google": [200], "browser:chrome": [100], "browser:Firefox": [300], "os:ios": [500], "device:desktop": [100, 300], "country:cn": [300],
    "country:US": [100, 400], "region:广东": [300], "region:california": [100], "bytes:>1000": [200, 400], "bytes:>=1500": [200, 400], "bytes:<50": [500], "bytes:50..500": [100, 300],
    "bytes:10": [500], "rt:>0.5": [100, 400], "rt:<=0.1": [200, 500], "rt:0.1..1": [100, 200], "rt:<0.05": [500], "status:200 method:get path:/about": [200, 300], "status:200 bytes:>1000": [200],
    "status:5xx ip:3.3.3.3 rt:>2": [400], "about status:200": [200, 300], "status:404 about": [], "-about": [100, 400, 500], "-status:200": [100, 400], "about -google.com": [300],
    "status:200 -path:/about": [500], "-ip:1.0.0.0/8 -status:5xx": [200, 500], "-nothinglikethis": [100, 200, 300, 400, 500], '-"union select"': [200, 300, 400, 500], '"union select"': [100],
    '"select union"': [], '"get /about"': [200, 300], '"get /about/us"': [300], '"/about nginx"': [], '"192.168.1.10 union"': [100], '"google.com"': [200], "status:abc": [], "color:red": [],
    "bytes:1k": [], "ip:1.2.3": [], "about": [200, 300], "about google.com": [200], "about nope": [], "from": [200], "192.168": [100], "union select": [100], "   ": [100, 200, 300, 400, 500], "!!!": [],
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"city": F.lit(None).cast("string"), "level": F.lit(None).cast("string"), "main_log_path": F.lit("/l/a.log")})
    out = df.withColumns({"ip_hex": ip_hex("ip"), "raw_tok": tokenize_full("raw"), "path_tok": tokenize_atoms("path"), "ua_tok": tokenize_atoms("user_agent"), "ref_tok": tokenize_atoms("referer")}).cache()
    out.count()
    return out


def hits(rows, f):
    return sorted(r["ts"] for r in rows.where(compile_filter(f)).select("ts").collect())


def test_boxes(rows):
    """All boxes in one pass: a column for each."""
    flags = rows.select("ts", *[F.coalesce(compile_filter(Filter(text=t)), F.lit(False)).alias(f"b{k}") for k, t in enumerate(HITS)]).collect()
    for k, (text, want) in enumerate(HITS.items()):
        assert sorted(r["ts"] for r in flags if r[f"b{k}"]) == want, text


def test_lists(rows):
    assert hits(rows, Filter(paths=["/about"])) == [200, 300]
    assert hits(rows, Filter(paths=["/about/us", "/wp-login.php"])) == [100, 300]
    assert hits(rows, Filter(paths=["!!!"])) == []
    assert hits(rows, Filter(user_agents=["Chrome/126"])) == [100]
    assert hits(rows, Filter(ips=["1.1.1.1"], statuses=[200, 404])) == [100, 300]
    assert hits(rows, Filter(groups=["/l/other.log"])) == []
    assert hits(rows, Filter(groups=["/l/a.log"], text="about")) == [200, 300]


@pytest.mark.parametrize(("start", "end", "want"), [(200, 400, [200, 300]), (200, 401, [200, 300, 400]), (201, 400, [300]), (None, 200, [100]), (300, None, [300, 400, 500])])
def test_time_range(rows, start, end, want):
    assert hits(rows, Filter(start=start, end=end)) == want


@pytest.mark.parametrize(
    ("text", "reasons"),
    [("status:abc", ["invalid_value"]), ("color:red", ["unknown_field"]), ("http://x", []), ('say "hi', ["unterminated_quote"]), (" ".join(["w"] * 70), ["too_many_terms"]), ("a:b", []), ("-", [])],
)
def test_warnings(text, reasons):
    assert [w.reason for w in parse(text)[1]] == reasons


def test_items():
    items, _ = parse('foo -status:5xx bar "a b" rt:..2')
    assert items == [Item("status", Span(500, 599), True), Item("phrase", "a b"), Item("rt", Span(None, 2.0)), Item("text", "foo bar")]


def test_requests():
    assert filter_of(1000).end == 1001 and filter_of(1000).start == 0
    f = filter_of(1000, 5, 10, statuses=[200, -1])
    assert (f.start, f.end, f.statuses) == (5, 11, [200])
    with pytest.raises(ValueError):
        validate_range(10, 10)
