"""Client names from user agents, as ordered rules that Catalyst evaluates.

Rules are applied to each different agent once (clients()) and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_N2, _N3 = r"(\d+\.\d+)", r"(\d+\.?\d*\.?\d*)"
#: Names that hold one of these are found by it: a ``googlebot`` is a ``bot``, a ``crawler`` crawls.
_BOTS = "bot|crawl|spider|slurp|sohu-search|lycos|robozilla|facebookexternalhit|whatsapp|pinterest|sogou|bytedance"
#: Names, patterns and version patterns, first match wins.
BROWSERS: list[tuple[str, str, str | None]] = [
    ("Bot", f"{_BOTS}|tiktok", None),
    ("WeChat", "micromessenger", f"micromessenger/{_N2}"),
    ("QQ", rf"qq/(\d+\.\d+)", f"qq/{_N2}"),
    ("DingTalk", "dingtalk", f"dingtalk/{_N2}"),
    ("Alipay", "alipayclient", f"alipayclient/{_N2}"),
    ("TikTok", "musically_", f"musically_{_N2}"),
    ("360 Browser", "360se|qihoobrowser", f"360se/{_N2}|qihoobrowser/{_N2}"),
    ("QQ Browser", "qqbrowser", f"qqbrowser/{_N2}"),
    ("UC Browser", "ucbrowser|uc browser", f"ucbrowser/{_N2}"),
    ("Sogou Explorer", "se |metasr", f"se {_N2}|metasr {_N2}"),
    ("Baidu Browser", "baidubrowser|bidubrowser", f"baidubrowser/{_N2}|bidubrowser/{_N2}"),
    ("Maxthon", "maxthon", f"maxthon/{_N2}"),
    ("Samsung Browser", "samsungbrowser", f"samsungbrowser/{_N2}"),
    ("Huawei Browser", "huaweibrowser", f"huaweibrowser/{_N2}"),
    ("Xiaomi Browser", "mibrowser", f"mibrowser/{_N2}"),
    ("Oppo Browser", "oppobrowser", f"oppobrowser/{_N2}"),
    ("Vivo Browser", "vivobrowser", f"vivobrowser/{_N2}"),
    ("Yandex", "yabrowser", f"yabrowser/{_N2}"),
    ("Brave", "brave", f"brave/{_N2}"),
    ("Vivaldi", "vivaldi", f"vivaldi/{_N2}"),
    ("Edge", "edg/|edge/", f"edg?[e]?/{_N2}"),
    ("Internet Explorer", "msie |trident.*rv:", f"msie {_N2}|rv:{_N2}"),
    ("Opera", "opr/|opera/", f"opr/{_N2}|version/{_N2}"),
    ("Chrome", "chrome/", f"chrome/{_N2}"),
    ("Firefox", "firefox/", f"firefox/{_N2}"),
    ("Safari", "safari/", f"version/{_N2}"),
    ("NetFront", "netfront", f"netfront/{_N2}"),
    ("Konqueror", "konqueror", f"konqueror/{_N2}"),
]
SYSTEMS: list[tuple[str, str, str | None]] = [
    ("iOS", r"iPhone OS|OS (\d+_\d+)|iPad; OS|iPod.*OS|iPhone.*OS", r"OS (\d+[_\d]*)"),
    ("Android", "android", f"android {_N3}"),
    ("Windows", "windows", r"windows nt (\d+\.?\d*)"),
    ("macOS", "mac os x|macintosh|intel mac", r"mac os x (\d+[_\d]*)"),
    ("Ubuntu", "ubuntu", rf"ubuntu[/\s]*{_N3}"),
    ("CentOS", "centos", rf"centos[/\s]*{_N3}"),
    ("Red Hat", "red.*hat|rhel", rf"red.*hat[/\s]*{_N3}|rhel[/\s]*{_N3}"),
    ("Debian", "debian", rf"debian[/\s]*{_N3}"),
    ("Fedora", "fedora", rf"fedora[/\s]*{_N3}"),
    ("SUSE", "suse|opensuse", rf"suse[/\s]*{_N3}|opensuse[/\s]*{_N3}"),
    ("FreeBSD", "freebsd", f"freebsd {_N3}"),
    ("OpenBSD", "openbsd", f"openbsd {_N3}"),
    ("NetBSD", "netbsd", f"netbsd {_N3}"),
    ("Linux", "linux|x11", None),
    ("Chrome OS", "cros", f"cros {_N3}"),
    ("Windows Phone", "windows phone", f"windows phone {_N3}"),
    ("BlackBerry", "blackberry|bb10", rf"blackberry[/\s]*{_N3}|bb10[/\s]*{_N3}"),
    ("Symbian", "symbian|s60", rf"symbian[/\s]*{_N3}|s60[/\s]*{_N3}"),
]
DEVICES: list[tuple[str, str]] = [
    ("Bot", f"{_BOTS}|scraper"),
    ("iPhone", "iphone"),
    ("iPad", "ipad"),
    ("iPod", "ipod"),
    ("Apple Watch", "watch.*os"),
    ("Apple TV", "apple.*tv"),
    ("PlayStation", "playstation|ps[345]|psvita"),
    ("Xbox", "xbox"),
    ("Nintendo", "nintendo|wii|3ds|switch"),
    ("Smart TV", "smart.*tv|smarttv|hbbtv|netcast|roku|webos|tizen|android.*tv"),
    ("Chromecast", "chromecast"),
    ("Tablet", "tablet|ipad|kindle|nook|playbook|touchpad|xoom|sch-i800|gt-p1000|sgh-t849|shw-m180s|a1_07|bntv250a|mid7015|mid7012"),
    (
        "Mobile",
        "mobile|phone|iphone|android.*mobile|blackberry|bb10|windows phone|iemobile|palm|webos|symbian|maemo|fennec|minimo|pda|pocket|psp|smartphone|"
        "mobileexplorer|htc|samsung|lg|motorola|sony|nokia|huawei|xiaomi|oppo|vivo|oneplus",
    ),
    ("Wearable", "watch|wearable|fitbit|gear"),
    ("IoT Device", "alexa|echo|iot|raspberry|arduino"),
    ("E-Reader", "kindle|nook|kobo|pocketbook"),
]
#: Apps whose versions have three parts where two aren't found.
THREE_PARTS = {"WeChat": "micromessenger", "QQ": "qq", "Alipay": "alipayclient"}


def _first(ua: Column, rules: list, values: list[Column], otherwise: Column) -> Column:
    """One flat CASE: each pattern is looked for once."""
    out = F
    for rule, value in zip(rules, values, strict=True):
        out = out.when(ua.rlike(f"(?i){rule[1]}"), value)
    return out.otherwise(otherwise)


def _has(ua: Column, text: str) -> Column:
    return F.contains(F.lower(ua), F.lit(text))


def _known(ua: Column) -> Column:
    return ua.isNotNull() & ~ua.isin("", "-")


def browser(ua: Column) -> Column:
    """The browser's name, empty if no rule fits; agents that call themselves Chrome are told apart."""
    chrome = F.when(_has(ua, "edg/"), "Edge").when(_has(ua, "opr/"), "Opera").when(_has(ua, "samsungbrowser"), "Samsung Browser").otherwise("Chrome")
    names = [chrome if n == "Chrome" else F.lit(n) for n, _, _ in BROWSERS]
    return F.when(_known(ua), _first(ua, BROWSERS, names, F.lit(""))).otherwise("")


def system(ua: Column) -> Column:
    return F.when(_known(ua), _first(ua, SYSTEMS, [F.lit(n) for n, _, _ in SYSTEMS], F.lit(""))).otherwise("")


def device(ua: Column) -> Column:
    """The kind of device; Android without ``mobile`` is a tablet where it would be a mobile or a desktop."""
    android = _has(ua, "android") & ~_has(ua, "mobile")
    mobile = F.when(_has(ua, "ipad") | _has(ua, "tablet") | android, "Tablet").otherwise("Mobile")
    names = [mobile if n == "Mobile" else F.lit(n) for n, _ in DEVICES]
    return F.when(_known(ua), _first(ua, DEVICES, names, F.when(android, "Tablet").otherwise("Desktop"))).otherwise("")


def _named(ua: Column, name: Column, patterns: dict[str, str]) -> Column:
    """Group 1 of the pattern of a name, empty if it has none. One expression: as many as there are names would be too much code for the compiler."""
    return F.coalesce(F.call_function("regexp_extract", ua, F.element_at(F.create_map(*[F.lit(x) for n, p in patterns.items() for x in (n, f"(?i){p}")]), name), F.lit(1)), F.lit(""))


def browser_version(ua: Column, name: Column | None = None) -> Column:
    """Group 1 of the rule's version pattern; an alternative that captures elsewhere gives none. ``name``: of the browser, where it is known."""
    three = {n: rf"{app}/(\d+\.\d+\.\d+)" for n, app in THREE_PARTS.items()}
    if name is not None:  # no two rules have one name
        told = _named(ua, name, {n: v for n, _, v in BROWSERS if v})
        version = F.when(name.isin(list(three)), F.coalesce(F.nullif(told, F.lit("")), _named(ua, name, three))).otherwise(told)
        return F.when(_known(ua), version).otherwise("")
    values = [F.regexp_extract(ua, f"(?i){v}", 1) if v else F.lit("") for _, _, v in BROWSERS]
    values = [F.coalesce(F.nullif(x, F.lit("")), F.regexp_extract(ua, f"(?i){three[n]}", 1)) if n in three else x for (n, _, _), x in zip(BROWSERS, values, strict=True)]
    return F.when(_known(ua), _first(ua, BROWSERS, values, F.lit(""))).otherwise("")


def system_version(ua: Column, name: Column | None = None) -> Column:
    """The same of the system."""
    values = [F.regexp_extract(ua, f"(?i){v}", 1) if v else F.lit("") for _, _, v in SYSTEMS]
    told = _first(ua, SYSTEMS, values, F.lit("")) if name is None else _named(ua, name, {n: v for n, _, v in SYSTEMS if v})
    return F.when(_known(ua), F.regexp_replace(F.translate(told, "_", "."), r"(\.0)+$", "")).otherwise("")


def clients(rows: DataFrame, ua_col: str = "user_agent") -> DataFrame:
    """Names for each different agent: a table to join by agent, as small as agents are few.

    Filters on names would be pushed below the distinct and its join, and the rules be applied to
    every row; they can't pass a generator.
    """
    ua = F.col(ua_col)
    names = F.struct(
        browser(ua).alias("browser"), system(ua).alias("os"), device(ua).alias("device_type"), browser_version(ua).alias("browser_version"), system_version(ua).alias("os_version")
    )
    return rows.select(ua_col).distinct().select(ua_col, F.explode(F.array(names)).alias("_n")).select(ua_col, "_n.*")


def with_clients(rows: DataFrame, ua_col: str = "user_agent") -> DataFrame:
    """``rows`` with browser, os and device_type, null where empty."""
    names = clients(rows, ua_col).select(F.col(ua_col).alias("_ua"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("browser", "os", "device_type")])
    return rows.join(names, F.col(ua_col) == F.col("_ua"), "left").drop("_ua")
