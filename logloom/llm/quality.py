"""Quality rules: text statistics as Spark expressions and a decision list learned from labels.

Sequential covering: each rule is a conjunction of thresholds on statistics, grown by FOIL's gain
on two thirds of the labelled rows and pruned on the rest. Its rows are set aside and the next rule
is learned on what is left. The rules become one ordered ``when(...).when(...).otherwise(...)``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import columns, renamed

#: The most labelled documents that the list is fitted on; the lowest hashes of doc_id are taken.
FIT_ROWS = 12_000
#: A rule covers so many bad documents at least.
FEWEST = 4
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*BASE, "n_upper", "n_marks", "n_lines"]


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks and n_lines, all long.

    A null text has no words and no lines. Columns of ``docs`` with these names are replaced, all
    others stay, whatever they are called. Window repeats: a text whose three-word windows all have different hashes
    has none. Of another, the windows' places are sorted by two hashes; equal neighbours are compared
    word by word, and the places they cover are added up. That takes n log n for a text of n words and no shuffle.
    """
    clear, at = renamed(docs.select(*columns(c for c in docs.columns if c.lower() not in STATISTICS)))
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _WHITE, " " * len(_WHITE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    s1 = clear.withColumns({"_words": words, "_lines": lines})
    hashes = "if(size(_words) < 4, cast(array() as array<bigint>), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
    s2 = s1.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, _WHITE, "")).cast("long"),
            "n_symbols": _without(text, SYMBOLS).cast("long"),
            "n_upper": _without(text, _UPPER).cast("long"),
            "n_marks": _without(text, ".,;:!?").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.expr(hashes),
        }
    )
    key = "named_struct('h', h, 'g', xxhash64(1, _words[i], _words[i + 1], _words[i + 2]), 'i', i)"
    keys = f"if(size(array_distinct(_hashes)) = size(_hashes), null, sort_array(transform(_hashes, (h, i) -> {key})))"
    s3 = s2.withColumn("_keys", F.expr(keys))
    a, b = "_keys[k].i", "_keys[k + 1].i"
    same = f"_keys[k].h = _keys[k + 1].h and _words[{a}] = _words[{b}] and _words[{a} + 1] = _words[{b} + 1] and _words[{a} + 2] = _words[{b} + 2]"
    s4 = s3.withColumn("_twins", F.expr(f"if(_keys is null, cast(array() as array<int>), filter(sequence(0, size(_keys) - 2), k -> {same}))"))
    places = f"sort_array(array_distinct(flatten(transform(_twins, k -> array({a}, {b})))))"
    covered = f"aggregate({places}, struct(0 as upto, 0 as n), (acc, i) -> struct(i + 3 as upto, acc.n + i + 3 - greatest(i, acc.upto) as n), acc -> acc.n)"
    s5 = s4.withColumn("n_repeat_words", F.expr(f"cast(if(size(_twins) = 0, 0, {covered}) as long)"))
    return s5.select(*[F.col(b).alias(c) for c, b in at.items()], *STATISTICS)


#: What the rules look at: a name and an expression over the statistics. A ratio to nothing is 0.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that one covers is rejected, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for c in rule[1:]:
                cond = cond & c.column()
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.95, most_rules: int = 12, most_conditions: int = 5) -> DecisionList:
    """Sequential covering for the class ``bad``. ``fold`` is True for rows to prune on.

    The list has ``most_rules`` rules at most, a rule ``most_conditions`` conditions: these bound the length of the
    expression, not the rows it is applied to. A rule needs ``precision`` on the rows that are left for growing and, unless it covers none there, for pruning.
    """
    found = DecisionList()
    left = np.ones(len(bad), bool)
    while len(found.rules) < most_rules and (left & bad).sum() >= FEWEST:
        rule = _prune(_grow(x, bad, left & ~fold, most_conditions), x, bad, left & fold)
        covered = left & np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.zeros_like(left)
        grown, pruned = covered & ~fold, covered & fold
        if (covered & bad).sum() < FEWEST or any(m.sum() and bad[m].mean() < precision for m in (grown, pruned)):
            break
        found.rules.append(rule)
        left &= ~covered
    return found


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most and (p0 := int((rows & bad).sum())) and (n0 := int((rows & ~bad).sum())):
        best, best_gain = None, 1e-9
        for name, values in x.items():
            v, y = values[rows], bad[rows]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold stands between two different values
            if not len(ends):
                continue
            p_low, all_low = np.cumsum(y)[ends], ends + 1
            for above in (False, True):
                p = p0 - p_low if above else p_low
                n = (p0 + n0 - all_low if above else all_low) - p
                gain = p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - math.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best_gain, best = float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        rows = rows & best.holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    """Drops final conditions as long as (p - n) / (p + n) on the pruning rows doesn't fall."""
    def worth(r: list[Condition]) -> float:
        m = rows & np.logical_and.reduce([c.holds(x) for c in r])
        return (2 * bad[m].sum() - m.sum()) / m.sum() if m.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DecisionList:
    """The decision list from ``labels`` (doc_id, quality: 0 is bad) of ``docs`` (doc_id, text).

    At most ``rows`` labelled documents are used, those with the lowest hashes of doc_id; several
    labels of one document count as the lowest, repeated documents as one. Null labels and ids are
    left out. Without labels of both kinds the list is empty and keeps everything.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers
    values = with_statistics(known).select("doc_id", "quality", base_failed().alias("failed"), *[F.expr(e).cast("double").alias(f"f_{n}") for n, e in FEATURES.items()])
    got = values.groupBy("doc_id").agg(F.max(F.struct(*values.columns[1:])).alias("v")).select("doc_id", "v.*").orderBy("doc_id").collect()
    got = [r for r in got if not r["failed"]]  # the list only judges what the base rules leave
    if not got:
        return DecisionList()
    x = {n: np.array([r[f"f_{n}"] for r in got]) for n in FEATURES}
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in got])
    return learn(x, np.array([r["quality"] == 0 for r in got]), fold)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``.

    A document fails the base rules below 50 words or if over half its words stand in three-word
    windows found twice or more in it; so null and empty texts fail. Every row, repeated ones too,
    is judged on its own. Columns of ``docs`` with the names of the new ones are replaced.
    """
    known = with_statistics(docs.drop("base_failed", "kept"), text_col)
    return known.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())
