"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

Training (driver, bounded): statistics of at most ``sample_rows`` labelled documents (those of least hash
of the id) are gathered; small trees are grown on reweighted resamples; every path from a root to a node
is a conjunctive rule; a lasso-penalised logistic regression weighs the rules and drops most. Scoring
(cluster): the statistics are Spark expressions, each rule a comparison of them, and the score the logistic
function of a weighted sum, so all documents are scored within the JVM, without a shuffle.

Labels, language, source and id are no inputs. Learning sees only rows with crc32(doc_id as text) mod 4
other than 2. Without any label, or with labels of one class, the score is the smoothed share of label 1.

Defined cases: a null text counts as empty and gets the score of its statistics; labels without documents
and null labels are ignored; repeated rows are each scored; an empty table yields no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_OF, HELD_OUT = 4, 2
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, as double columns."""
    text = F.coalesce(text, F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    of = lambda some: (F.length(text) - F.length(F.translate(text, some, ""))).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    return {
        "chars": F.log1p(chars),
        "words": F.size(words).cast("double"),
        "word_length": chars / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "words_a_line": F.size(words) / F.size(lines).cast("double"),
        "symbols": kept(r"[\p{L}\p{N}\s.,]") / chars,
        "upper": kept(r"[^\p{Lu}]") / chars,
        "digits": of("0123456789") / chars,
        "stops": of(".") / chars,
        "commas": of(",") / chars,
    }


@dataclass
class Rules:
    """Conjunctive rules: each a list of (statistic, threshold, above), with weights and a bias."""

    names: list[str]
    rules: list[list[tuple[int, float, bool]]]
    weights: np.ndarray
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a Spark column over the statistics' columns."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            cond = None
            for k, threshold, above in rule:
                one = stats[self.names[k]] > threshold if above else stats[self.names[k]] <= threshold
                cond = one if cond is None else cond & one
            total = total + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fires(rules: list[list[tuple[int, float, bool]]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, threshold, above in rule:
            out[:, j] *= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
    return out


def _grow(x: np.ndarray, g: np.ndarray, depth: int, columns: np.ndarray, path: list, leaves: int) -> list[list]:
    """Rules of a least-squares tree on g: the path of every node below the root."""
    if depth == 0 or len(g) < 2 * leaves:
        return []
    best = (1e-9, None)
    mean = g.mean()
    for k in columns:
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 33)))
        order = np.argsort(x[:, k], kind="stable")
        sums = np.cumsum(g[order] - mean)
        n = np.searchsorted(x[order, k], cuts, side="right")
        ok = (n >= leaves) & (n <= len(g) - leaves)
        if not ok.any():
            continue
        n, cuts = n[ok], cuts[ok]
        gain = sums[n - 1] ** 2 * (1 / n + 1 / (len(g) - n))
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], (int(k), float(cuts[i])))
    if best[1] is None:
        return []
    k, cut = best[1]
    low = x[:, k] <= cut
    out = []
    for side, above in ((low, False), (~low, True)):
        here = [*path, (k, cut, above)]
        out += [here, *_grow(x[side], g[side], depth - 1, columns, here, leaves)]
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 2e-3, seed: int = 11) -> Rules:
    """Grow trees by gradient steps on resamples, then fit lasso logistic weights on their rules."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return Rules(names, [], np.zeros(0), bias)
    rng = np.random.default_rng(seed)
    margin, rules, seen = np.full(n, bias), [], set()
    leaves = max(5, n // 400)
    for _ in range(trees):
        rows = rng.choice(n, size=max(20, int(0.6 * n)), replace=False)
        columns = rng.choice(x.shape[1], size=max(2, 2 * x.shape[1] // 3), replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        found = _grow(x[rows], residual[rows], depth, columns, [], leaves)
        new = [r for r in found if tuple(r) not in seen]
        seen |= {tuple(r) for r in new}
        rules += new
        if found:  # a shrunken step by the tree's own leaves
            a = fires(found, x)
            w = np.linalg.lstsq(a.T @ a + np.eye(len(found)), a.T @ residual, rcond=None)[0]
            margin += 2.0 * a @ w
    a = fires(rules, x)
    support = a.mean(axis=0)
    keep = (support > 0) & (support < 1)
    rules, a = [r for r, k in zip(rules, keep) if k], a[:, keep]
    # scaled by spread so that the penalty treats rare and common rules alike; FISTA
    scale = np.maximum(a.std(axis=0), 0.02)
    z = (a - a.mean(axis=0)) / scale
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1e-9)
    w, v, b, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), bias, 1.0
    for _ in range(600):
        grad = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - step * (z.T @ grad) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= grad.mean()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / following * (new - w), new, following
    used = np.flatnonzero(w)
    weights = w[used] / scale[used]
    return Rules(names, [rules[i] for i in used], weights, float(b - (weights * a[:, used].mean(axis=0)).sum()))


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(HELD_OUT_OF)) == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Rules fitted on at most ``sample_rows`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id"), F.col(target).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample_rows)
    stats = statistics(F.col("text").cast("string"))
    # `chosen` is bounded, so the texts stay where they are; rows that repeat an id count once
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", F.struct(*[c.alias(k) for k, c in stats.items()]).alias("_x"))
    rows = rows.groupBy("doc_id", "_y").agg(F.min("_x").alias("_x")).select("_y", "_x.*")
    got = np.array(rows.toPandas(), dtype=float).reshape(-1, len(stats) + 1)  # at most sample_rows rows
    got = got[np.lexsort(got.T[::-1])]  # any order of arrival gives the same model
    return fit(got[:, 1:], got[:, 0], list(stats))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with a ``score`` column; every other column is kept."""
    stats = statistics(F.col("text").cast("string"))
    prefix = "_stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    wide = docs.withColumns({prefix + k: c for k, c in stats.items()})
    return wide.withColumn("score", rules.column({k: F.col(prefix + k) for k in stats})).drop(*[prefix + k for k in stats])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
