"""Quality rules as a learned decision list (DataFrame operations only).

Statistics of every whole text are computed by built-in expressions in one pass. From labelled rows
sequential covering learns a decision list: it grows a conjunction of thresholds that covers low
quality with the best gain, prunes it on rows it has not grown on, keeps it if it is precise
there, removes what it covers, and goes on. The list becomes one ordered conditional expression.

Null and empty texts have no words, and so fail the base rule; texts of any length are read whole; an
empty table gives an empty one. The list is learned from at most
``SAMPLE`` labelled rows, those with the smallest hash of their id; without labels of both kinds it is
empty. Rows without doc_id are judged, not learned from. Repeated rows are judged alike; a document
with several labels counts as low quality if one says so. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

#: Bound of the learning sample, in labelled rows.
SAMPLE = 20_000
#: A rule is kept if, on rows it was not grown on, this share of what it covers is of low quality.
PRECISION = 0.9
_SPACE = r"[\x20\x09-\x0D]+"
# The signs that count as symbols.
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words in windows of three that occur at least twice; linear but for one sort."""

    def marked(windows: Column) -> Column:
        n = F.size(windows)
        twice = F.filter(windows, lambda x, i: ((i > 0) & (F.get(windows, i - 1).h == x.h)) | ((i + 1 < n) & (F.get(windows, i + 1).h == x.h)))
        return F.array_sort(F.transform(twice, lambda x: x.at))

    def covered(at: Column) -> Column:
        # each start covers three words, or as many as there are before the next start
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), _step, lambda s: s.n)

    def _step(s: Column, at: Column) -> Column:
        return F.struct((s.n + at + 3 - F.greatest(s.end, at)).alias("n"), (at + 3).alias("end"))

    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(F.array_sort(hashed), lambda x: _let(marked(x), covered)))


def statistics(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    w = F.array_remove(F.split("body", _SPACE), "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda c: F.size(c).cast("long")
    rows = docs.select(F.col("doc_id").alias("doc_id"), body.alias("body"))
    counts = _let(w, lambda x: F.struct(size(x).alias("n_words"), repeat_words(x).cast("long").alias("n_repeat_words")))
    rows = rows.select("doc_id", "body", counts.alias("c"))
    return rows.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.length(F.regexp_replace("body", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: size(x) - size(F.array_distinct(x))).alias("n_dup_lines"),
        F.col("c.n_repeat_words").alias("n_repeat_words"),
        size(F.split("body", "\n")).alias("n_lines"),
        (F.length("body") - F.length(F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("body") - F.length(F.translate("body", "!?", ""))).cast("long").alias("n_shouts"),
    )


def features() -> dict[str, Column]:
    """What thresholds are put on; nothing divides by zero."""
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "shouts": per("n_shouts", "n_words"),
        "line_words": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, steps: int = 32, longest: int = 4) -> Rule:
    """Add the condition of the largest information gain until only low quality is covered."""
    on, rule = np.ones(len(bad), bool), ()
    while len(rule) < longest and bad[on].any() and not bad[on].all():
        p0, t0 = bad[on].sum(), on.sum()
        best, gain = None, 1e-9
        for name, v in x.items():
            for cut in np.unique(np.quantile(v[on], np.linspace(0, 1, steps + 1))):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    now = on & c.holds(x)
                    p, t = bad[now].sum(), now.sum()
                    if p and (g := p * (np.log2(p / t) - np.log2(p0 / t0))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule += (best,)
        on &= best.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    on = _covers(rule, x, len(bad))
    p = bad[on].sum()
    return float(2 * p - on.sum()) / max(1, on.sum())


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on."""
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x, bad), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 12) -> list[Rule]:
    """Sequential covering; two rows in three grow a rule, the third prunes it."""
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3
    left = np.ones(len(bad), bool)
    while len(rules) < most:
        on = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        g, h = on(left & (part != 0)), on(left & (part == 0))
        if not g[1].any():
            break
        rule = _prune(_grow(*g), *h) if len(h[1]) else _grow(*g)
        if not rule:
            break
        covered = _covers(rule, h[0], len(h[1]))
        if covered.sum() < 2 or h[1][covered].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def expression(rules: list[Rule]) -> Column:
    """Whether the list keeps a row: the first rule that covers it drops it."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """``labels``: doc_id, quality (0 is low). Rows that fail the base rule are left to it."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = scratch.materialize(stats.where(~base_failed()).join(known, "doc_id"), "labelled")
    rows = scratch.least_by_hash(rows, "doc_id", SAMPLE)
    rows = rows.select((F.col("quality") == 0).alias("bad"), *[c.alias(k) for k, c in features().items()]).collect()
    bad = np.array([r.bad for r in rows], bool)
    if not bad.any() or bad.all():
        return []
    return learn({k: np.array([r[k] for r in rows], float) for k in features()}, bad)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = scratch.materialize(statistics(docs), "statistics")
    rules = fit(stats, labels)
    failed = base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(expression(rules)).alias("kept"))
