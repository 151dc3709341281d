"""Quality rules: exact base counts, and decision lists learned by sequential covering.

A list is an ordered set of conjunctions of thresholds.  Each conjunction is grown for information gain over part of
the labelled statistics, pruned on the rest, and kept while it is right often enough; what it covers leaves.  The list
becomes one ordered CASE expression that Spark evaluates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as T

Rule = list[tuple[str, str, float]]
BASE_RULE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _cover(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] <= at if op == "<=" else x[name] > at
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, on: np.ndarray) -> tuple[float, tuple | None]:
    p0, n0 = int(y[on].sum()), int((~y[on]).sum())
    base = math.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name in sorted(x):
        v, t = x[name][on], y[on]
        o = np.argsort(v, kind="stable")
        v, t = v[o], t[o]
        ends = np.flatnonzero(v[1:] != v[:-1])
        if not len(ends):
            continue
        below = np.cumsum(t)[ends]
        for op, p, n in (("<=", below, ends + 1 - below), (">", p0 - below, n0 - (ends + 1 - below))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return best, found


def learn_list(x: dict[str, np.ndarray], reject: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.8) -> list[Rule]:
    """Ordered rules for the rows to reject, by sequential covering.

    Rows alternate between growing (two of three) and pruning.  No rows, or none to reject: no rules.
    """
    reject = np.asarray(reject, bool)
    part = np.arange(len(reject)) % 3 != 2
    left, rules = np.ones(len(reject), bool), []
    while len(rules) < most_rules and (left & part & reject).any():
        rule: Rule = []
        on = left & part
        while len(rule) < most_conditions and (~reject[on]).any():
            _, c = _best_condition(x, reject, on)
            if c is None:
                break
            rule.append(c)
            on = on & _cover(x, [c])
        if not rule:
            break

        def worth(r: Rule) -> float:
            c = _cover(x, r) & left & ~part
            p, n = int((c & reject).sum()), int((c & ~reject).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _cover(x, rule) & left
        p = int((c & reject).sum())
        if p < 2 or p < precision * int(c.sum()):
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional."""
    out = None
    for rule in rules:
        c = F.lit(True)
        for name, op, at in rule:
            c = c & (F.col(name) <= F.lit(at) if op == "<=" else F.col(name) > F.lit(at))
        out = F.when(c, False) if out is None else out.when(c, False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[Rule]) -> str:
    return "; ".join("reject if " + " and ".join(f"{n} {o} {a:.4g}" for n, o, a in r) for r in rules) or "keep all"


def apply_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", learn: str | None = None, common_sample: int = 1000) -> tuple[DataFrame, list[Rule]]:
    """Per document: id, BASE and SHAPE statistics, base_failed, kept; and the rules.

    Rules are learned from at most ``sample`` labelled documents (label 0: reject), those of least xxhash64(id);
    the common words come from the first ``common_sample`` ids of them.  Every document is judged on its whole text.
    Null or empty texts have no words and so fail the base rule.  Without usable labels only the base rule holds.
    An id with several labels has the greatest.  Repeated rows are judged each for itself and learned from once; very
    long texts are read whole, in one task's memory; an empty table gives no rows; other columns don't matter, whatever
    their names.  Ties between conditions go to the first name and the least threshold.
    """
    rows, common = T.learning_rows(docs, labels, label, sample, id_col, text_col, learn, common_sample)
    rules = learn_list({k: rows[k].to_numpy(float) for k in T.SHAPE}, (rows["y"] == 0).to_numpy()) if len(rows) else []
    out = T.with_statistics(docs, id_col, text_col, common)
    out = out.withColumn("base_failed", F.expr(BASE_RULE))
    return out.withColumn("kept", ~F.col("base_failed") & as_expression(rules)), rules
