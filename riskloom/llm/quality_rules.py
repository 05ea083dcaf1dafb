"""Learned decision lists over text statistics, in Spark expressions only.

``text_statistics`` computes every statistic with built-in functions inside the
row, without a shuffle. A learner then covers the rejected class rule by rule:
a rule grows by the threshold condition with the largest information gain on the
growing part of the labelled statistics, loses conditions from its end while
that helps on the pruning part, and is kept while it stays precise there. The
list becomes one ordered conditional expression, so applying it is part of the
same projection.

The learner reads at most about ``SAMPLE_DOCS`` labelled rows, chosen by a hash
of doc_id; statistics and verdicts cover all rows and whole texts.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged row by row; ties among conditions go to the first statistic and the
lowest threshold. With no labelled row of either class the list is empty and
only the base rule speaks. Extra columns are ignored, labels without a document
or with a null value are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 6000
MAX_RULES = 16
MAX_CONDITIONS = 4
MIN_PRECISION = 0.85
MIN_COVER = 5
WINDOW = 8
_BLANK = r" \t\n\x0B\f\r"
_BLANKS = " \t\n\x0b\f\r"

# Name and SQL of each statistic that rules may test.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
    "n_words": "n_words",
}


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once. Lambdas may use it element by element;
    a plain column could be replaced there by its whole expression when the
    optimizer moves a filter below the projection that makes it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash of each window of WINDOW words."""
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    return F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. Only texts with an
    equal pair go on to sort the windows and find where they stand."""
    def same(s: Column, k: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = _let(ordered, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"])))
    # words of a window that the window before it doesn't cover
    count = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
                        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count).otherwise(0)


def text_statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """Columns ``kept`` and the statistics of ``text``."""
    base = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_t"))
    words = base.select(*kept, "_t", F.split(F.trim("_t", F.lit(_BLANKS)), f"[{_BLANK}]+").alias("_w"),
                        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "").alias("_l"))
    long = lambda c: c.cast("long")
    return words.select(
        *kept, long(F.when(F.get("_w", F.lit(0)) == "", 0).otherwise(F.size("_w"))).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.length(F.regexp_replace("_t", r"[^A-Z]+", ""))).alias("n_capitals"),
        long(F.length(F.regexp_replace("_t", r"[^0-9]+", ""))).alias("n_digits"),
        long(F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).alias("n_bangs"),
        long(F.size("_l")).alias("n_lines"), long(F.size(F.array_distinct("_w"))).alias("n_distinct_words"),
        long(_let(F.col("_w"), lambda w: _let(_windows(w), _covered))).alias("n_repeat_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        c = F.expr(f"double({RATIOS[self.name]})")
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _fires(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray) -> tuple[float, Condition | None]:
    """FOIL gain over all thresholds halfway between neighbouring values."""
    p0, n0 = (w * y).sum(), (w * (1 - y)).sum()
    best: tuple[float, Condition | None] = (1e-9, None)
    now = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    for name in RATIOS:
        order = np.argsort(x[name], kind="stable")
        v = x[name][order]
        p, n = np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        middle = (v[at] + v[at + 1]) / 2
        for above, a, b in ((False, p[at], n[at]), (True, p0 - p[at], n0 - n[at])):
            gain = a * (np.log2((a + 1e-9) / (a + b + 1e-9)) - now)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = float(gain[k]), Condition(name, above, float(middle[k]))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 17) -> list[list[Condition]]:
    """Ordered rules for the rejected rows (``bad`` = 1)."""
    y = bad.astype(float)
    left = np.ones(len(y), bool)
    grow = np.random.default_rng(seed).random(len(y)) < 2 / 3
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        g = left & grow
        if y[g].sum() < MIN_COVER:
            break
        rule: list[Condition] = []
        covered = g.copy()
        while len(rule) < MAX_CONDITIONS and (1 - y)[covered].any():
            _, c = _best_condition({k: v[covered] for k, v in x.items()}, y[covered], np.ones(covered.sum()))
            if c is None:
                break
            rule.append(c)
            covered &= c.holds(x)
        held = left & ~grow

        def worth(r: list[Condition]) -> float:
            f = _fires(r, x, len(y)) & held
            return (y[f].sum() - (1 - y)[f].sum()) / max(1, f.sum())
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        f = _fires(rule, x, len(y)) & left
        inside, outside = f & grow, f & held
        if not rule or f.sum() < MIN_COVER or y[inside].sum() < MIN_PRECISION * inside.sum() or y[outside].sum() < MIN_PRECISION * outside.sum():
            break
        rules.append(rule)
        left &= ~f
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """Statistics of a bounded sample of labelled rows, ``bad`` 1 for quality 0.
    The sample's ids are broadcast; ``limit`` bounds them."""
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    share = min(1.0, limit / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    return text_statistics(docs.join(F.broadcast(rows.where(draw)), "doc_id"), "doc_id", "bad")


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> list[list[Condition]]:
    """Rules for rows that pass the base rule."""
    sample = labelled_statistics(docs.select("doc_id", "text"), labels, limit)
    found = sample.select("bad", "doc_id", base_failed().alias("failed"), *[F.expr(f"double({e})").alias(k) for k, e in RATIOS.items()]).collect()
    rows = sorted((r for r in found if not r["failed"]), key=lambda r: (r["doc_id"], r["bad"]))
    if not rows:
        return []
    x = {k: np.array([r[k] for r in rows], float) for k in RATIOS}
    return learn_rules(x, np.array([r["bad"] for r in rows]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_number(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that fires, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        fires = F.lit(True)
        for c in rules[k - 1]:
            fires = fires & c.column()
        out = F.when(fires, k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics, base_failed, the rule that rejected a text, and kept."""
    s = text_statistics(docs, "doc_id").withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
