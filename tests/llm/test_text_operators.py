"""Token counts, packing, quality rules, line dedup and near-duplicates against brute force, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import lines, near, packing, quality, tokens
from logloom.llm import queries as q
from logloom.llm.token_counts import count_tokens

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (None, "a null id"), (None, "a null id"), (5, "don't  stop\n\nit's <|endoftext|> x\xa0y ½ 日本 𝒳 \x1c end"), (6, "word " * 30000),
    (7, "x" * 5000), (8, "é" * 3 + "\r\n" + "tail  "), (9, "a'll 's ' s12ab_3"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, block long, piece int, n_words long, kept boolean, removed string, label long"


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(exact, text):
    return exact.encode(text or "", add_special_tokens=False).ids


def docs_of(spark, rows):
    """Documents with other columns, some named like those that operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 1, -1, -1, -1, -1, True, "r", -1) for i, t in rows], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


# tokens


def test_ids_and_pre_tokens_are_the_librarys(exact):
    tok = tokens.load()
    for _, t in ODD:
        assert tok.ids(t or "").tolist() == ids(exact, t)
        assert sum(map(tok.count, tok.split(t or ""))) == len(ids(exact, t))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlrevm12_.!é½日\xa0\x1c"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_has_the_librarys_ids(text):
    tok = tokens.load()
    want = tok.exact.encode(text, add_special_tokens=False).ids
    assert tok.ids(text).tolist() == want
    assert sum(map(tok.count, tok.split(text))) == len(want)


def test_token_counts(spark, small, exact):
    want = Counter((i, len((t or "").encode()), len(ids(exact, t))) for i, t in ODD)
    assert Counter(map(tuple, count_tokens(docs_of(spark, ODD)).collect())) == want
    assert count_tokens(empty(spark)).count() == 0
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in q.op2_token_counts(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r[0]: (n := len(ids(exact, r[1])), n > 512) for r in rows}


# packing


def check_packing(got, texts, exact, length=2048):
    want = Counter()
    for i, t in texts:
        x = np.array([*ids(exact, t), 0], "<u4")
        cuts = [0, *range(len(x) % length or length, len(x), length), len(x)]
        want.update((i, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(x[cuts[k] : cuts[k + 1]].tobytes())) for k in range(len(cuts) - 1))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r["length"] for r in got) // length)


def test_packing(spark, small, exact):
    check_packing(packing.pack_documents(docs_of(spark, ODD)).collect(), ODD, exact)
    assert packing.pack_documents(empty(spark)).count() == 0
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    bins, least = check_packing(q.op3_best_fit_packing(spark, small).collect(), texts, exact)
    assert bins <= least + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25))
def test_bins_hold_all_pieces_once(sizes):
    bins = packing.pack(sizes, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 30 for b in bins)
    assert len(bins) <= len(packing.best_fit_decreasing(sizes, 30))


def test_the_search_beats_best_fit():
    """Two pieces of 6 with 4 fill a bin; best-fit decreasing puts the fives and fours together and needs one bin more."""
    sizes = [6, 5, 5, 4, 4, 3, 3]
    assert len(packing.best_fit_decreasing(sizes, 10)) >= len(packing.pack(sizes, 10)) == 3
    hard = [7, 6, 5, 4, 4, 4, 3, 3, 2, 2]
    assert len(packing.pack(hard, 10)) == 4


def least_bins(sizes, capacity):
    """The exact optimum: for each set of pieces the fewest bins and the least fill of the last."""
    found = [(0, capacity)] * (1 << len(sizes))
    for m in range(1, len(found)):
        tried = [(found[m ^ 1 << i], s) for i, s in enumerate(sizes) if m >> i & 1]
        found[m] = min((b, u + s) if b and u + s <= capacity else (b + 1, s) for (b, u), s in tried)
    return found[-1][0]


@pytest.mark.parametrize(
    ("sizes", "capacity", "least"),
    [
        ([26, 49, 41, 28, 24, 46, 49, 36, 44, 43, 23, 45, 44, 48, 33, 46, 26, 30], 100, 7),
        ([481, 643, 804, 500, 923, 692, 860, 695, 659, 847, 943, 873, 644, 755, 731, 639], 2048, 6),
    ],
)
def test_lists_that_greedy_fillings_lose(sizes, capacity, least):
    assert len(packing.pack(sizes, capacity)) == least


def test_a_filling_may_go_on_with_a_smaller_piece():
    """Behind 7 only 6, 4, 3 leaves no waste: its second piece isn't the largest that fits."""
    sizes = [15, 7, 6, 6, 6, 5, 4, 4, 4, 3]
    assert len(packing.pack(sizes, 20)) == least_bins(sizes, 20) == 3


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_small_lists_are_packed_as_well_as_can_be(case):
    capacity, sizes = case
    assert len(packing.pack(sizes, capacity)) == least_bins(sizes, capacity)


def fits_into(pieces, holders):
    """Whether each piece finds a place in the holders."""
    return not pieces or any(h >= pieces[0] and fits_into(pieces[1:], [*holders[:i], h - pieces[0], *holders[i + 1 :]]) for i, h in enumerate(holders))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 20), st.integers(0, 20))
def test_fillings_are_all_undominated_ones(sizes, room, most):
    every = {tuple(sorted(c, reverse=True)) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room}
    rank = {c: (-sum(c), len(c)) for c in every}
    want = {c for c in every if room - sum(c) <= most and not any(rank[o] < rank[c] and fits_into(c, o) for o in every)}
    left, got, after = packing.Counts(dict(Counter(sizes))), [], None
    while (after := packing.next_filling(left, room, most, after)) is not None:
        got.append(tuple(after))
    assert got == sorted(want, key=lambda c: (-sum(c), [-x for x in c]))


# quality


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    twice = {k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(twice)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_statistics(spark, small):
    odd = [*ODD, (10, "a b c a b c a b"), (11, "a a a a a"), (12, "x\nx\n \nx"), (13, "a b c d"), (14, "q w e r t y q w e # | " * 9)]
    got = quality.judge(docs_of(spark, odd), quality.DecisionList())
    assert Counter((r["doc_id"], *(r[c] for c in [*quality.BASE, "base_failed"])) for r in got.collect()) == Counter((i, *statistics(t)) for i, t in odd)
    assert quality.judge(empty(spark), quality.DecisionList()).count() == 0
    texts = dict(tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = q.op10_quality_rules(spark, small).collect()
    assert {r["doc_id"]: tuple(r[c] for c in [*quality.BASE, "base_failed"]) for r in rows} == {i: statistics(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_rules_are_learned(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000), "c": rng.random(2000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    fold = rng.random(2000) < 0.33
    rules = quality.learn(x, bad, fold)
    fresh = {k: rng.random(1000) for k in x}
    truth = ((fresh["a"] > 0.8) & (fresh["b"] <= 0.5)) | (fresh["c"] > 0.95)
    said = rules.rejects(fresh)
    assert (said & truth).sum() >= 0.9 * truth.sum() and (said & ~truth).sum() <= 0.02 * len(truth)
    assert quality.learn(x, np.zeros(2000, bool), fold).rules == []


def test_held_out_accuracy(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, rules).select("doc_id", "kept", "base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    junk, clean = [r for r in held if r["quality"] == 0], [r for r in held if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in junk) >= 0.9 * len(junk) and sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    none = quality.fit(docs, labels.limit(0))
    assert none.rules == [] and quality.fit(docs.limit(0), labels).rules == []


# line dedup


def removed(frame):
    return sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in frame.select("doc_id", "text", "n_removed").collect())


def words(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_lines(spark):
    passage = "\n".join(words(f"p{i}", 15) for i in range(5))
    rows = [
        (1, "own one\n" + words(1) + "\nlast"), (2, words(1) + "\nown two"), (3, "first\n" + passage + "\nown three"), (4, passage), (5, "else\n" + passage + "\n" + words(1)), (6, "short\nlines"), (7, "short\nlines"),
        (8, words(8) + "\nmid\n" + words(8)), (None, words(1)), (9, None), (10, ""), (11, "\n\n"),
    ]
    got = lines.dedup_lines(docs_of(spark, rows))
    assert set(docs_of(spark, rows).columns) <= set(got.columns) and got.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert text[1] == rows[0][1] and text[2] == "own two" and text[3] == rows[2][1] and text[4] == "" and text[5] == "else"
    assert text[6] == text[7] == "short\nlines" and text[8] == words(8) + "\nmid" and text[9] is None and text[10] == "" and text[11] == "\n\n"
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_nothing_is_lost_and_no_passage_repeats(spark, small):
    before = {r[0]: r[1].split("\n") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    after = {}
    for r in q.op5_line_dedup(spark, small).collect():
        gone = {k for a in r["removed"] for k in range(a["a"], a["b"] + 1)}
        after[r["doc_id"]] = [x for k, x in enumerate(before[r["doc_id"]]) if k not in gone]
        assert hashlib.sha256("\n".join(after[r["doc_id"]]).encode()).hexdigest() == r["text_sha256"]
    assert {x for v in before.values() for x in v} == {x for v in after.values() for x in v}
    long = Counter(x for v in after.values() for x in v if len(x.split()) >= 50)
    assert not long or max(long.values()) == 1
    pairs = defaultdict(set)
    for i, v in after.items():
        for k in range(len(v) - 1):
            pairs[v[k], v[k + 1]].add((i, k))
    assert not [p for p, at in pairs.items() if len(at) > 1 and len(" ".join(p).split()) > 50]


def brute_lines(texts, min_words=50):
    """Marks all lines of repeated pairs of lines and repeated lines of ``min_words``; runs with so many words go."""
    seen, gone = set(), {}
    for i, text in sorted(texts.items()):
        own = text.split("\n")
        n, marked = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in own], set()
        for k in range(len(own)):
            for unit in ([tuple(own[k : k + 2])] if k + 1 < len(own) else []) + ([(own[k],)] if n[k] >= min_words else []):
                if unit in seen:
                    marked |= set(range(k, k + len(unit)))
                seen.add(unit)
        runs = [[k for _, k in g] for _, g in groupby(enumerate(sorted(marked)), lambda x: x[1] - x[0])]
        gone[i] = {k for r in runs if sum(n[j] for j in r) >= min_words for k in r}
    return gone


def gone_lines(frame):
    return {r["doc_id"]: {k for a in r["removed"] for k in range(a["a"], a["b"] + 1)} for r in frame.select("doc_id", "removed").collect()}


def test_lines_against_brute_force(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert gone_lines(q.op5_line_dedup(spark, small)) == brute_lines(texts)
    rng = random.Random(5)
    own = lambda n, least, most: [" ".join(f"{rng.randrange(10**6)}"[:6] for _ in range(rng.randint(least, most))) for _ in range(n)]
    shared = [*[own(rng.randint(20, 40), 2, 3) for _ in range(12)], *[own(rng.randint(2, 4), 20, 30) for _ in range(12)], ["same"] * 70, [*own(4, 3, 3), "", *own(15, 3, 3), "\t" * 99 + "x"]]
    texts = {k: "\n".join(own(rng.randint(0, 6), 1, 9) + rng.choice(shared) + own(rng.randint(0, 6), 1, 9) + rng.choice(shared)) for k in range(150)}
    assert gone_lines(lines.dedup_lines(docs_of(spark, list(texts.items())))) == brute_lines(texts)


def passages(texts, min_words=50):
    """Lines of runs of ``min_words`` that have an equal run before them, as a whole."""
    at, gone = defaultdict(list), {}
    for i, text in sorted(texts.items()):
        own, gone[i] = text.split("\n"), set()
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in own]
        for k, line in enumerate(own):
            for before, j in at[line]:
                m = 1
                while k + m < len(own) and j + m < len(before) and before[j + m] == own[k + m]:
                    m += 1
                if sum(n[k : k + m]) >= min_words:
                    gone[i] |= set(range(k, k + m))
            at[line].append((own, k))
    return gone


def test_lines_of_any_length(spark):
    """Passages of 50 to 70 words in lines of one word to all of them, blank lines too, lose all copies but the first; nothing else goes."""
    rng = random.Random(11)

    def passage():
        most, out = rng.choice([1, 3, 8, 20, 49, 70]), []
        while sum(len(x.split()) for x in out) < 50:
            out += [words(rng.random(), rng.randint(1, most))] + [""] * rng.choice([0, 0, 0, 1, 3])
        return out

    own = lambda: [words(rng.random(), rng.randint(1, rng.choice([2, 9, 40]))) for _ in range(rng.randint(1, 12))]
    shared = [passage() for _ in range(60)]
    texts = {k: "\n".join([*own(), *rng.choice(shared), *own(), *rng.choice(shared), *own()]) for k in range(240)}
    got, whole = gone_lines(lines.dedup_lines(docs_of(spark, list(texts.items())))), passages(texts)
    assert sum(map(len, whole.values())) > 2000 and all(whole[k] <= got[k] for k in texts)
    assert all(got[k] <= v for k, v in brute_lines(texts).items())


def test_boundaries_follow_the_content(spark):
    """Between its first and last window a passage has the same boundaries wherever it stands, and chunks of short lines are several lines long."""
    passage = [words(f"s{i}", 4) for i in range(200)]
    texts = [(k, "\n".join([*[words(f"o{k}-{i}", 3) for i in range(k)], *passage, *[words(f"e{k}-{i}", 5) for i in range(k)]])) for k in range(12)]
    rows = lines.with_boundaries(docs_of(spark, texts).select("doc_id", F.col("text").alias("_text")), 50).select("doc_id", "_cuts").collect()
    inside = {tuple(sorted(c - r["doc_id"] for c in r["_cuts"] if lines.MOST <= c - r["doc_id"] < 200 - lines.MOST)) for r in rows}
    assert len(inside) == 1 and 200 / 6 < len(inside.pop()) < 200 / 3


def test_lines_need_boundaries(spark, monkeypatch):
    passage = "\n".join(words(f"p{i}", 15) for i in range(5))
    rows = docs_of(spark, [(1, "own\n" + passage), (2, passage + "\nlast")])
    assert gone_lines(lines.dedup_lines(rows)) == {1: set(), 2: set(range(5))}
    found = lines.with_boundaries
    monkeypatch.setattr(lines, "with_boundaries", lambda df, n: found(df, n).withColumn("_cuts", F.expr("filter(_cuts, c -> false)")))
    assert gone_lines(lines.dedup_lines(rows)) == {1: set(), 2: set()}


# near-duplicates


def classes(texts, least=near.SIMILARITY):
    """Components by comparing all pairs."""
    own = [(i, t or "", near.shingles(t)) for i, t in texts]
    top = {i: i for i, _, _ in own}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, ta, sa in own:
        for b, tb, sb in own:
            if a < b and (ta == tb or near.similarity(sa, sb, least) > 0):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: root(i) for i in top}


def test_near_duplicates(spark, small):
    base = [f"w{i}" for i in range(120)]
    family = [(100 + k, " ".join("z" if j == k * 7 % 120 else w for j, w in enumerate(base))) for k in range(12)]
    moved = (200, " ".join(base[60:] + base[:60]))
    rows = [*family, moved, (1, None), (2, ""), (3, "  "), (4, "a b c"), (5, "a  b c"), (6, "a b d"), (7, "x " * 400), (8, "x " * 401), (9, "x " * 900)]
    got = near.near_duplicates(docs_of(spark, [*rows, (None, "a b c"), (4, "a b c")]))
    want = classes(rows)
    assert Counter(map(tuple, got.collect())) == Counter([*want.items(), (None, None), (4, want[4])])
    assert want[111] == 100 and want[200] == 200 and want[8] == 7 and want[9] == 9 and want[5] == 4 and want[2] == 1
    assert near.near_duplicates(empty(spark)).count() == 0
    kept = near.keep_one(docs_of(spark, [*rows, (None, "a b c"), (4, "a b c")]))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(want.values()), None])


def test_near_duplicates_of_the_documents(spark, small):
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(map(tuple, q.op6_minhash_near_dedup(spark, small).collect())) == classes(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30), st.sampled_from([0.5, 0.8]))
def test_banded_alignment_is_the_full_one(a, b, least):
    """Against the quadratic longest common subsequence of labelled items."""
    label = lambda x: np.array([v * 100 + x[:k].count(v) for k, v in enumerate(x)], "u8")
    x, y = label(a), label(b)
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
    n = best[-1, -1]
    want = n / (len(x) + len(y) - n) if n else 0.0
    assert near.similarity(x, y, least) == (want if want >= least - 1e-9 else 0.0)


def test_rounds_are_exact_where_members_differ(spark):
    """A chain: each text is like the next but not like the one after, so that no centre reaches all."""
    rng = np.random.default_rng(1)
    text = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(25):
        rows.append((k, " ".join(text)))
        for j in rng.choice(300, 7, replace=False):
            text[j] = f"n{k}x{j}"
    assert dict(map(tuple, near.near_duplicates(docs_of(spark, rows)).collect())) == classes(rows)


def test_common_text_in_different_documents(spark, monkeypatch):
    """Buckets of texts that share most words, but not enough: rare shingles and blocks find all links."""
    monkeypatch.setattr(near, "SPLIT", 4)
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = np.random.default_rng(2)
    common, rows = [f"c{i}" for i in range(200)], []
    for k in range(45):
        own = [f"o{k // 3 if k % 3 < 2 else k}x{i}" for i in range(60 + k)]
        own[int(rng.integers(60))] = f"e{k}"
        rows.append((k, " ".join([*common, *own])))
    want = classes(rows)
    assert 20 < len(set(want.values())) < 40
    assert dict(map(tuple, near.near_duplicates(docs_of(spark, rows)).collect())) == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(0, 9))
def test_similar_sets_share_a_rare_item(a, b, seed):
    counts = np.random.default_rng(seed).integers(0, 5, near.ORDER)
    x, y = (np.array(sorted(s), "u8") << np.uint64(13) for s in (a, b))
    if len(a & b) / len(a | b) >= 0.8:
        assert set(near.rare_first(x, counts, 0.8).tolist()) & set(near.rare_first(y, counts, 0.8).tolist())


def test_one_of_each_with_odd_columns(spark):
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 9, "y"), (3, "else", 1, None), (3, "other", 2, "z"), (None, "a b c d e f", 5, "w")]
    made = spark.createDataFrame(rows, "doc_id long, text string, _fb int, `a.b` string").selectExpr("*", "map('k', _fb) AS m")
    kept = near.keep_one(made)
    assert kept.columns == made.columns
    got = [r for r in kept.collect()]
    assert sorted((r[0] or 0, r[2]) for r in got if r[0] != 3) == [(0, 5), (1, 7)] and len([r for r in got if r[0] == 3]) == 1
    assert sorted(map(str, near.keep_one(made.repartition(5)).collect())) == sorted(map(str, got))
