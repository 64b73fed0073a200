"""Quality classifier: a sparse ensemble of conjunctive rules over document statistics.

Boosted trees of small depth are grown on a bounded labelled sample; every path from a root to a node is a rule. A
lasso logistic regression on the rules' truth values keeps few of them, and the kept ones become one Spark column
expression over the statistics, so scoring is a projection. Inputs of a score are statistics of the whole text alone.

Null and empty texts have zero statistics and are scored like any other; very long texts are read whole; repeated rows get
equal scores and null ids are kept, as not held out. Of several labels of one id the greatest counts, and rules that hold for
the same rows are one. Without labels of both kinds the score is the share of label 1, or 0.5 without labels. An empty table
gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import sigmoid
from braidpath.llm.text_stats import RATES, held_out, sample_rates, text_stats
from braidpath.llm.trees import fit_boosted

#: The bound on the labelled rows that trees and weights are fitted on.
SAMPLE_ROWS = 20_000
PREDICT_FROM = 0.7

#: A rule: conditions (statistic, whether <=, threshold) that all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the columns of ``text_stats``."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for name, low, cut in rule:
                holds = holds & (F.col(name) <= cut if low else F.col(name) > cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return sigmoid(total)


def _merged(path: tuple[tuple[int, bool, float], ...]) -> Rule:
    """At most one upper and one lower threshold for each statistic."""
    cuts: dict[tuple[int, bool], float] = {}
    for f, low, cut in path:
        cuts[f, low] = (min if low else max)(cut, cuts.get((f, low), cut))
    return tuple((RATES[f], low, cut) for (f, low), cut in sorted(cuts.items()))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept goes unpenalised."""
    n, k = x.shape
    design = np.hstack([x, np.ones((n, 1))])
    # a bound of the curvature: a quarter of the largest eigenvalue, by power iteration
    v = np.ones(k + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    lipschitz = 0.25 * np.linalg.norm(design @ v) ** 2 / n * 1.1
    w = np.zeros(k + 1)
    z, t = w, 1.0
    for _ in range(steps):
        grad = design.T @ (1 / (1 + np.exp(-(design @ z))) - y) / n
        new = z - grad / lipschitz
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - penalty / lipschitz, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return w[:k], float(w[k])


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    if len(np.unique(y)) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleEnsemble((), (), float(np.log(p / (1 - p))))
    forest = fit_boosted(x, y, n_trees=n_trees, depth=depth, rate=0.2, bins=32)
    rules = sorted({_merged(p) for p in forest.paths()})
    truth = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, low, cut in rule:
            c = x[:, RATES.index(name)]
            truth[:, j] *= c <= cut if low else c > cut
    weights, intercept = lasso_logistic(truth, y, penalty)
    kept = [j for j in range(len(rules)) if weights[j]]
    return RuleEnsemble(tuple(rules[j] for j in kept), tuple(float(weights[j]) for j in kept), intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    return fit_rules(*sample_rates(docs, labels, label, max_rows))


def classify(docs: DataFrame, model: RuleEnsemble, predict_from: float = PREDICT_FROM) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    scored = text_stats(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= predict_from).cast("int"))
