"""Quality classifier: a sparse rule ensemble over statistics of a text.

Small trees are grown on the statistics of labelled texts, each on the residuals of those before it. Every path from a
root is a conjunctive rule; a lasso logistic regression weighs the rules, and those with a weight are compiled into one
Spark column expression.

Bound: a model is fitted on at most ``max_rows`` labelled rows (those with the smallest hash of their id, of rows with one
id those with the smallest statistics); no more are collected, however ids repeat. Scores cover all rows and whole texts.

Defined results: null and empty texts have all statistics 0 and a score like any other; repeated labels each count;
labels other than 0 and 1 are left out; with no label of one kind every score is the share of the other, smoothed;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, table

THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all of them built-in expressions."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    tokens = F.split(t, "[ \\n]")
    lines = F.split(t, "\\n")
    n_tokens, n_lines = F.greatest(F.size(tokens), F.lit(1)), F.greatest(F.size(lines), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "token_length": n / n_tokens,
        "line_length": F.log1p(n / n_lines),
        "distinct_tokens": F.size(F.array_distinct(tokens)) / n_tokens,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "symbols": share("[#*$%&|~^_=+<>{}\\[\\]\\\\@]"),
        "marks": share("[!?]"),
        "stops": share("[.,;:]"),
        "digits": share("[0-9]"),
        "capitals": share("\\p{Lu}"),
        "quotes": share("[\"'()]"),
        "symbol_runs": F.regexp_count(t, F.lit("[#*$%&!?]{2,}")) / n_tokens,
        "bars": share("\\|"),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, whether above, threshold) that all hold, and the weight that they add."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]


def _holds(x: np.ndarray, names: list[str], conditions: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in conditions:
        column = x[:, names.index(name)]
        out &= (column > cut) if above else (column <= cut)
    return out


def _grow(x, target, rows, cuts, names, depth, least, path, out) -> None:
    """Split rows where the squared error of target falls most, and note the path of each child."""
    if depth == 0 or len(rows) < 2 * least:
        return
    y = target[rows]
    total, best = y.sum(), (1e-9, None)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[rows, f], side="left")
        n_left = np.cumsum(np.bincount(bins, minlength=len(edges) + 1))[:-1]
        s_left = np.cumsum(np.bincount(bins, y, minlength=len(edges) + 1))[:-1]
        n_right, s_right = len(rows) - n_left, total - s_left
        fine = (n_left >= least) & (n_right >= least)
        if fine.any():
            gain = np.where(fine, s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1), -np.inf) - total**2 / len(rows)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, float(edges[k])))
    if best[1] is None:
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    for side, side_rows in ((False, rows[~above]), (True, rows[above])):
        # A later cut on the same side of one statistic makes the earlier one idle.
        longer = tuple(c for c in path if c[:2] != (names[f], side)) + ((names[f], side, cut),)
        out.append((longer, side_rows))
        _grow(x, target, side_rows, cuts, names, depth - 1, least, longer, out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty, by accelerated proximal gradient steps."""
    n, d = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.random.default_rng(7).normal(size=d + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / n * 1.02)
    w, z, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    w[0] = z[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(steps):
        new = z - step * (a.T @ (_sigmoid(a @ z) - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / later * (new - w), new, later
    return float(w[0]), w[1:]


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.5, strength: float = 1e-3) -> RuleEnsemble:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) < 20 or y.min() == y.max():
        return RuleEnsemble(base, ())
    cuts = [np.unique(np.quantile(column, np.linspace(0.01, 0.99, 64))) for column in x.T]
    cuts = [c[:-1] if len(c) and c[-1] >= column.max() else c for c, column in zip(cuts, x.T, strict=True)]
    rng, score, paths = np.random.default_rng(11), np.full(len(y), base), {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(20, len(y) // 2), replace=False))
        residual = y - _sigmoid(score)
        found: list = []
        _grow(x, residual, rows, cuts, names, depth, least, (), found)
        for path, _ in found:
            paths.setdefault(tuple(sorted(path)), None)
        leaves = [p for p, _ in found if len(p) == max(len(q) for q, _ in found)]
        for path in leaves or [p for p, _ in found]:
            at = _holds(x, names, path)
            if at.any():
                p = _sigmoid(score[at])
                score[at] += rate * np.clip((y[at] - p).sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
    rules = list(paths)
    r = np.stack([_holds(x, names, path) for path in rules], 1).astype(np.float64)
    apart = (r.mean(0) > 0) & (r.mean(0) < 1)
    rules, r = [p for p, keep in zip(rules, apart, strict=True) if keep], r[:, apart]
    intercept, w = _lasso(r, y.astype(np.float64), strength)
    return RuleEnsemble(intercept, tuple(Rule(p, float(v)) for p, v in zip(rules, w, strict=True) if v))


def fit(labelled: DataFrame, max_rows: int = 20_000) -> RuleEnsemble:
    """Learn from columns doc_id, text and quality (0 or 1)."""
    names = list(statistics(F.col("text")))
    known = labelled.where(F.col("quality").isin(0, 1))
    # Ids are ranked first, so that statistics are taken of chosen texts alone; an id's rows may pass the cut together.
    place = F.xxhash64("doc_id")
    cut = known.select(place.alias("_h")).orderBy("_h").limit(max_rows).agg(F.max("_h")).first()[0]
    rows = known.where(place <= F.lit(cut).cast("long")).select(place.alias("_h"), F.col("quality"), *(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()))
    # An order of all columns: neither the cut nor the model depends on the order in which partitions come.
    found = rows.orderBy("_h", *names, "quality").limit(max_rows).toPandas()
    return fit_arrays(found[names].to_numpy(np.float64), found["quality"].to_numpy(np.float64), names)


def compiled(model: RuleEnsemble, stats: dict[str, Column]) -> Column:
    """The ensemble as one column: a probability."""
    z = F.lit(model.intercept)
    for rule in model.rules:
        holds = None
        for name, above, cut in rule.conditions:
            c = (stats[name] > cut) if above else (stats[name] <= cut)
            holds = c if holds is None else holds & c
        z = z + F.when(holds, F.lit(rule.weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with score and predicted; a kept column with one of those names is left out."""
    kept = [c for c in keep if c not in ("score", "predicted")]
    used = {c[0] for rule in model.rules for c in rule.conditions}
    stats = {k: c.cast("double") for k, c in statistics(F.col("text")).items() if k in used}
    # Statistics are columns of their own first: each is computed once, however many rules use it.
    wide = docs.select(*kept, *(c.alias(f"_stat_{k}") for k, c in stats.items()))
    out = wide.select(*kept, compiled(model, {k: F.col(f"_stat_{k}") for k in stats}).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    model = fit(docs.where(~held_out).join(labels, "doc_id"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
