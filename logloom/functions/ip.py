"""Addresses as 32 hexadecimal digits, which sort as numbers do, and ranges of them."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MAPPED = "00000000000000000000ffff"


def hex_of(text: str | None) -> str | None:
    """An address, IPv4 mapped into IPv6; None for other texts."""
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return f"{_MAPPED}{int(ip):08x}" if ip.version == 4 else f"{int(ip):032x}"


def hex_range(value: str) -> tuple[str, str] | None:
    """Lowest and highest address of a CIDR block or a single address; host bits don't count. No blanks, netmasks or zones."""
    address, slash, length = value.partition("/")
    if "%" in value or (slash and not re.fullmatch(r"\+?[0-9]{1,9}", length)):
        return None
    try:
        ip = ipaddress.ip_address(address)
        net = ipaddress.ip_network((ip, int(length) if slash else ip.max_prefixlen), strict=False)
    except ValueError:
        return None
    return hex_of(str(net[0])), hex_of(str(net[-1]))


@F.arrow_udf(StringType())
def ip_hex(texts: pa.Array) -> pa.Array:
    """For the write path; each different text is looked at once."""
    told = texts.dictionary_encode()
    return pa.array([hex_of(t) for t in told.dictionary.to_pylist()], pa.string()).take(told.indices)


def ipv4_hex(text: Column) -> Column:
    """The same of dotted IPv4 texts, by built-in functions; null for others."""
    parts = F.split(F.trim(text), r"\.")
    digits = F.concat(F.lit(_MAPPED), *[F.lpad(F.lower(F.hex(F.get(parts, F.lit(k)).try_cast("int"))), 2, "0") for k in range(4)])
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(F.trim(text).rlike(rf"^{octet}(\.{octet}){{3}}$"), digits)


def stored_ip_hex(text: Column) -> Column:
    """ip_hex(), in the JVM for dotted IPv4; Python sees only the others."""
    plain = ipv4_hex(text)
    return F.coalesce(plain, ip_hex(F.when(plain.isNull(), text)))
