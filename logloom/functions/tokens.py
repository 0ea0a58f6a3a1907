"""The log-aware tokenizer: one Python function for the write path (Arrow UDF) and for query texts.

A token is (position, term); several terms may share a position. Queries see the tokens of a text as
an array of struct<pos, term>, and never tokenize rows. Stored is one text, packed: positions parted by
blanks, terms of one position by tabs, as no term has either; a position without a term is empty.
"""

from __future__ import annotations

import ipaddress
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Terms of so many UTF-8 bytes or more are dropped.
LONGEST = 255
#: So many tokens are handed to Arrow at a time.
FLUSH = 1 << 16
TOKENS = ArrayType(StructType([StructField("pos", IntegerType()), StructField("term", StringType())]))
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"(?:%|\\x)([0-9A-Fa-f]{2})")
#: Code points of CJK and of emoji.
_CJK = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
_EMOJI = "\U0001f000-\U0001faff☀-➿⭐⭕"
_NUMBER = re.compile(r"[0-9]+(?:[._][0-9]+)+")
_V6 = re.compile(r"[0-9A-Fa-f:.]+")
_GROUPS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){6}")
_PIECE = re.compile(rf"(?P<cjk>[{_CJK}]+)|(?P<emoji>[{_EMOJI}])|(?P<up>\.\.[/\\])|(?P<atom>(?:(?![{_CJK}{_EMOJI}])[^\W_])+)")
#: Tokens of plain texts; possessive, so that a number that a letter follows isn't one in part either.
_PLAIN_FULL, _PLAIN_ATOM, _DOT = re.compile(r"[0-9]++(?:[._][0-9]++)++(?![a-z0-9])|[a-z0-9]+"), re.compile("[a-z0-9]+"), re.compile("[._]")
#: Plain texts in lower case with blanks for all but atoms, and but what dotted numbers are made of.
_ATOMS, _RUNS = (bytes(ord(chr(c).lower()) if chr(c).isascii() and (chr(c).isalnum() or chr(c) in kept) else 32 for c in range(256)) for kept in ("", "._"))
_ATOM_CHAR = re.compile(rf"(?![{_CJK}{_EMOJI}])[^\W_]")


def unescape(text: str) -> str:
    """Decodes each run of %HH and \\xHH escapes as UTF-8 bytes, once; malformed ones stay."""
    return _ESCAPES.sub(lambda m: bytes(int(h, 16) for h in _ONE_ESCAPE.findall(m[0])).decode("utf-8", "replace"), text)


def ipv6_at(text: str, start: int) -> tuple[int, str] | None:
    """The IPv6 address at ``start`` as its end and canonical text; trailing colons and dots may not belong to it."""
    run = _V6.match(text, start)
    if not run or run[0].count(":") < 2:
        return None
    end = run.end()
    while True:
        try:
            return end, str(ipaddress.IPv6Address(text[start:end]))
        except ValueError:
            if end - 1 > start and text[end - 1] in ":.":
                end -= 1
            else:
                return None


def tokenize(text: str | None, full: bool, query: bool = False) -> list[tuple[int, str]]:
    """Tokens of a text.

    full: dotted numbers (all their prefixes in an index, the widest in a query), IPv6 addresses as
    one token, pairs of CJK characters. Otherwise only atoms, single CJK characters, emoji and ``../``.
    """
    s = unescape(text or "")
    out: list[tuple[int, str]] = []
    i = pos = 0
    while i < len(s):
        c = s[i]
        if full and (c == ":" or c in "0123456789abcdefABCDEF") and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] == "_")) and (v6 := ipv6_at(s, i)):
            out.append((pos, v6[1]))
            i, pos = v6[0], pos + 1
            continue
        m = _PIECE.match(s, i)
        if not m:
            i += 1
        elif m["cjk"]:
            run = m["cjk"]
            for k, char in enumerate(run):
                if not (query and full and len(run) > 1):
                    out.append((pos + k, char))
                if full and k + 1 < len(run):
                    out.append((pos + k, run[k : k + 2]))
            i, pos = m.end(), pos + len(run)
        elif m["up"]:
            out.append((pos, "../"))
            i, pos = m.end(), pos + 1
        else:
            number = _NUMBER.match(s, i) if full and m["atom"] and c in "0123456789" else None
            if number and not _ATOM_CHAR.match(s, number.end()):
                ends = [e.start() for e in re.finditer(r"[._]", number[0])][1:] + [len(number[0])]
                first = re.match(r"[0-9]+", number[0]).end()
                ends = [len(number[0])] if query else [first, *ends]
                out += [(pos, number[0][:e]) for e in ends]
                i = number.end()
            else:
                out.append((pos, m[0]))
                i = m.end()
            pos += 1
    return [(p, t.lower()) for p, t in out if len(t.encode()) < LONGEST]


@lru_cache(1 << 12)
def _prefixes(number: str) -> tuple[str, ...]:
    """Of a dotted number, the number last."""
    return (*[number[: m.start()] for m in _DOT.finditer(number)], number)


def _odd(text: str, full: bool) -> bool:
    """Whether a text may have other tokens than runs of ASCII letters and digits, and dotted numbers."""
    return not text.isascii() or "%" in text or "\\x" in text or "../" in text or "..\\" in text or (full and ("::" in text or (text.count(":") > 5 and _GROUPS.search(text) is not None)))


def add_tokens(text: str, full: bool, positions: array, terms: list[str]) -> None:
    """Appends tokenize() for an index; texts whose tokens are runs of ASCII letters and digits, or dotted numbers, are taken apart by one pattern."""
    odd = _odd(text, full)
    found = [] if odd else (_PLAIN_FULL if full else _PLAIN_ATOM).findall(text.lower())
    if odd or (len(text) >= LONGEST and max(map(len, found), default=0) >= LONGEST):
        for p, t in tokenize(text, full):
            positions.append(p)
            terms.append(t)
        return
    done = 0
    for k, t in enumerate(found if full else ()):
        if not t.isalnum():
            terms += found[done:k]
            terms += (cut := _prefixes(t))
            positions.extend(range(done, k))
            positions.extend([k] * len(cut))
            done = k + 1
    terms += found[done:]
    positions.extend(range(done, len(found)))


def token_array(texts: pa.Array, full: bool) -> pa.Array:
    """Tokens of texts as an array of TOKENS. No more than about FLUSH tokens stand as Python objects at a time, and those of one text.

    Where most texts occur more than once, each different one is looked at once.
    """
    told = texts.dictionary_encode()
    if 2 * len(told.dictionary) < len(texts):
        return token_array(told.dictionary, full).take(told.indices)
    ends, positions, terms, parts = array("i", [0]), array("i"), [], []
    nulls = []

    def flush() -> None:
        parts.append(pa.StructArray.from_arrays([pa.array(positions, pa.int32()), pa.array(terms, pa.string())], ["pos", "term"]))
        del positions[:], terms[:]

    for told in texts.to_pylist():
        nulls.append(told is None)
        before = len(terms)
        if told:
            add_tokens(told, full, positions, terms)
        ends.append(ends[-1] + len(terms) - before)
        if len(terms) >= FLUSH:
            flush()
    flush()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), mask=pa.array(nulls, pa.bool_()))


def _tokens_udf(full: bool):
    @F.arrow_udf(TOKENS)
    def tokens(texts: pa.Array) -> pa.Array:
        return token_array(texts, full)

    return tokens


tokenize_full = _tokens_udf(True)
tokenize_atoms = _tokens_udf(False)


def joined(tokens: Iterable[tuple[int, str]]) -> str:
    """Tokens packed; their positions don't fall."""
    out, at = [], 0
    for k, (pos, term) in enumerate(tokens):
        out += [" " * (pos - at) if pos > at else "\t" if k else "", term]
        at = pos
    return "".join(out)


@lru_cache(1 << 14)
def _pack_dotted(run: str) -> str:
    return " ".join(t if t.isalnum() else "\t".join(_prefixes(t)) for t in _PLAIN_FULL.findall(run))


def _odd_texts(texts: pa.Array, full: bool) -> pa.Array:
    """_odd() of each of some texts. What stands in none of them is told by one look at all their bytes."""
    data = texts.buffers()[2]
    data = data.to_pybytes() if data else b""
    found = pc.invert(pc.string_is_ascii(texts)) if not data.isascii() else pc.if_else(pc.is_valid(texts), False, None)
    for part in ("%", "\\x", "../", "..\\", *(["::"] if full else [])):
        if part.encode() in data:
            found = pc.or_(found, pc.match_substring(texts, part))
    if full:  # many texts hold six colons, few six groups of an address
        some = pc.greater(pc.count_substring(texts, ":"), 5)
        found = pc.or_(found, pc.and_(some, pc.match_substring_regex(texts, "(?:[0-9A-Fa-f]{1,4}:){6}")) if pc.any(some).as_py() else some)
    return found


def _pack_plain(texts: pa.Array, full: bool) -> pa.Array:
    """tokenize() of texts of which none is null or odd, packed: all of them at once, and each different run with a dot or underscore on its own."""
    ends, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    kept = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(_RUNS if full else _ATOMS) if data else b""
    told = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(kept)])
    runs = pc.ascii_split_whitespace(told)
    lists, flat = runs.offsets, runs.values
    if full:
        each = flat.dictionary_encode()
        packed = [t if t.isalnum() else _pack_dotted(t) or None for t in each.dictionary.to_pylist()]
        flat = pa.array(packed, pa.string()).take(each.indices)
    else:
        flat = pc.if_else(pc.equal(flat, ""), None, flat)
    if flat.null_count:  # runs of dots alone, and what stands before a first blank
        here = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        lists, flat = pa.array(np.concatenate([[0], np.cumsum(here)])[lists.to_numpy()], pa.int32()), flat.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(lists, flat), " ")


def packed_array(texts: pa.Array, full: bool) -> pa.Array:
    """Tokens of texts, packed. Where most texts occur more than once, each different one is looked at once."""
    told = texts.dictionary_encode()
    if 2 * len(told.dictionary) < len(texts):
        return packed_array(told.dictionary, full).take(told.indices)
    plain = pc.fill_null(pc.invert(_odd_texts(texts, full)), False)
    out = _pack_plain(texts.filter(plain), full)
    long = pc.match_substring_regex(out, f"[^ \t]{{{LONGEST}}}") if pc.any(pc.greater_equal(pc.binary_length(out), LONGEST)).as_py() else None
    if len(out) == len(texts) and not (long and pc.any(long).as_py()):
        return out
    held = iter(out.to_pylist() if long is None else pc.if_else(long, None, out).to_pylist())
    # of a plain text nothing was told if it has a long term
    found = [next(held) if p else None for p in plain.to_pylist()]
    return pa.array([x if x is not None or t is None else joined(tokenize(t, full)) for x, t in zip(found, texts.to_pylist(), strict=True)], pa.string())


def _pack_udf(full: bool):
    @F.arrow_udf(StringType())
    def packed(texts: pa.Array) -> pa.Array:
        return packed_array(texts, full)

    return packed


pack_full = _pack_udf(True)
pack_atoms = _pack_udf(False)


def pack_tokens(tokens: Column) -> Column:
    """Arrays of TOKENS, packed. No function of theirs stands in a lambda, as Python couldn't have made them then."""
    before = F.concat(F.array(F.lit(None).cast("int")), tokens["pos"])
    each = F.zip_with(tokens["term"], tokens["pos"], lambda term, pos: F.struct(term.alias("term"), pos.alias("pos")))
    gap = lambda pos, old: F.when(old.isNull(), F.repeat(F.lit(" "), pos)).when(pos > old, F.repeat(F.lit(" "), pos - old)).otherwise("\t")
    return F.array_join(F.zip_with(each, before, lambda x, old: F.concat(gap(x["pos"], old), x["term"])), "")


def _gapless(packed: Column) -> Column:
    """Whether there are tokens, and some at each position."""
    return (packed != "") & ~packed.startswith(" ") & ~packed.contains("  ")


def unpacked(packed: Column) -> Column:
    """Packed tokens as TOKENS."""

    def of(terms: Column, pos: Column) -> Column:
        token = lambda t: F.struct(pos.alias("pos"), t.alias("term"))
        return F.when(terms.contains("\t"), F.transform(F.split(terms, "\t"), token)).otherwise(F.array(token(terms)))

    told = F.flatten(F.transform(F.split(packed, " "), of))
    return F.when(_gapless(packed), told).otherwise(F.filter(told, lambda t: t["term"] != ""))


def count_packed(packed: Column) -> Column:
    """How many tokens there are, by what parts them."""
    bare = F.replace(F.replace(packed, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))
    return F.when(_gapless(packed), F.octet_length(packed) - F.octet_length(bare) + 1).otherwise(F.size(F.array_remove(F.split(packed, "[ \t]"), "")))


def flat_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of packed tokens, or of TOKENS: the place of the text, the position, and the term of each token."""
    if not pa.types.is_string(column.type):
        flat = pc.list_flatten(column)
        return pc.list_parent_indices(column).to_numpy(), pc.struct_field(flat, "pos").to_numpy(), pc.struct_field(flat, "term")
    places = pc.split_pattern(column, " ")
    text = pc.list_parent_indices(places).to_numpy()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), text[1:] != text[:-1]]))
    pos = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    shared = pc.split_pattern(pc.list_flatten(places), "\t")
    place, terms = pc.list_parent_indices(shared).to_numpy(), pc.list_flatten(shared)
    held = pc.not_equal(terms, "")
    place = place[held.to_numpy(zero_copy_only=False)]
    return text[place], pos[place].astype(np.int32), terms.filter(held)


def stored_atoms(text: Column) -> Column:
    """tokenize_atoms(), in the JVM for plain ASCII texts without escapes and ``../``; Python sees only the others."""
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\.\.[/\\]")
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return F.when(plain, F.filter(found, lambda t: F.length(t["term"]) < LONGEST)).otherwise(tokenize_atoms(F.when(~plain, text)))


def stored_full(text: Column) -> Column:
    """tokenize_full(), in the JVM for ASCII texts without escapes, ``../`` and anything like an IPv6 address; Python sees only the others."""
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\.\.[/\\]|::|([0-9A-Fa-f]{1,4}:){6}")
    # possessive, so that a number that a letter follows isn't one in part either
    found = F.regexp_extract_all(F.lower(text), F.lit("[0-9]++(?:[._][0-9]++)++(?![a-z0-9])|[a-z0-9]+"), F.lit(0))

    def prefixes(number: Column, at: Column) -> Column:
        dotted = F.translate(number, "_", ".")
        return F.transform(F.sequence(F.lit(1), F.size(F.split(dotted, r"\."))), lambda k: F.struct(at.alias("pos"), F.left(number, F.length(F.call_function("substring_index", dotted, F.lit("."), k))).alias("term")))

    tokens = F.flatten(F.transform(found, lambda t, i: F.when(t.rlike("[._]"), prefixes(t, i)).otherwise(F.array(F.struct(i.alias("pos"), t.alias("term"))))))
    return F.when(plain, F.filter(tokens, lambda t: F.length(t["term"]) < LONGEST)).otherwise(tokenize_full(F.when(~plain, text)))


@F.pandas_udf(StringType())
def unescape_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unescape(t) if t is not None else None)


def has_all_terms(tokens: Column, terms: list[str]) -> Column:
    """Every term occurs; none asked for matches nothing."""
    if not terms:
        return F.lit(False)
    return F.forall(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]), lambda t: F.array_contains(tokens["term"], t))


def has_phrase(tokens: Column, query: list[tuple[int, str]]) -> Column:
    """The query's terms occur at their relative positions: some start at which each term stands at its distance."""
    if not query:
        return F.lit(False)
    first = query[0][0]

    def starts_of(term: str, distance: int) -> Column:
        return F.transform(F.filter(tokens, lambda t: t["term"] == term), lambda t: t["pos"] - distance)

    starts = [starts_of(term, p - first) for p, term in query]
    common = starts[0]
    for other in starts[1:]:
        common = F.array_intersect(common, other)
    return F.size(common) > 0


def atoms(text: Column) -> Column:
    """Terms of plain texts, without escapes, CJK and emoji, in the JVM: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
