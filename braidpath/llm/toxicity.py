"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are all words (runs of letters, lower case) and all parts of words (four characters, ends marked), hashed to
2**FEATURE_BITS places; parts tell rare forms by what they share with others. A word that a text has n times adds
log(1 + n) to its own feature and to those of its parts, so a word has one weight, the sum over its features, and a text's
margin is one sum over its distinct words. A feature is scaled by the evidence that it has in the sample: its log-odds
between toxic and clean documents in standard errors, shrunk towards 0, so that the many rare features can't make up for
the few that tell; all features that a text has count, whatever their number. One weight vector serves all thresholds: P(grade >= k) = sigmoid(x w - theta_k)
with theta ascending, so the probabilities of higher grades never exceed those of lower ones, and the expected severity is
their sum.

Where labels only say toxic or not, grades are derived: 0 for clean rows; toxic rows are graded 1 and up by how many
marked words (those far more frequent in toxic documents) the whole text holds, cut at quantiles of the toxic rows.

What is defined for odd input:

* null texts, empty ones and those without a letter have no features and get the severity of the thresholds alone;
* very long texts are read whole; rows are scored one by one, so repeated rows get equal results, and null ids are kept;
* of equally likely grades the lower one is given; of labels that contradict each other for one id, toxic counts; of
  several texts under one labelled id one is learned from, that of least hash, so rows are bounded as ids are;
* without labels of both kinds, or an empty table, all severities are 0;
* other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest as xxh32

from braidpath.llm.common import each_text, map_arrow
from braidpath.llm.text_stats import labelled_sample

#: The bound on labelled rows to learn from, and the places that features are hashed to.
SAMPLE_ROWS, FEATURE_BITS = 20_000, 18
GRADES = 4
TOXIC_FROM = 0.5
#: Log-odds between toxic and clean documents, and standard errors of these, from which a word counts as marked.
MARKED_ODDS, MARKED_Z = 3.0, 4.0
#: Characters of a part of a word, and words whose weights a task remembers.
PART, MEMO = 4, 200_000
#: The penalty on squared weights, beside the mean log-likelihood; and the standard errors that a feature's log-odds are
#: shrunk by before they scale it.
L2, SHRINK = 1e-4, 2.0

WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(word: str) -> set[int]:
    """The places of a word and of the runs of PART characters of it between marked ends."""
    marked = f"^{word}$"
    names = [word, *(f"#{marked[k : k + PART]}" for k in range(max(1, len(marked) - PART + 1)))]
    return {xxh32(n.encode("utf-8", "surrogatepass")) >> 32 - FEATURE_BITS for n in names}


@dataclass(frozen=True)
class OrdinalModel:
    """A weight for each place (none: all 0), and the ascending thresholds between grades."""

    weights: np.ndarray
    thresholds: tuple[float, ...]
    memo: dict = field(default_factory=dict, repr=False, compare=False)

    def word_weights(self, names) -> np.ndarray:
        """The sum of each word's features; those of the words met last are remembered."""
        memo = self.memo
        if len(memo) >= MEMO:
            memo.clear()
        for word in [w for w in names if w not in memo]:
            memo[word] = sum(map(self.weights.item, features(word)))
        return np.fromiter(map(memo.__getitem__, names), float, len(names))

    def margins(self, texts) -> np.ndarray:
        if not len(self.weights):
            return np.array([0.0 for _ in texts])
        out = []
        for text in texts:
            found = Counter(words(text))
            out.append(self.word_weights(found) @ np.log1p(np.fromiter(found.values(), float, len(found))))
        return np.array(out, float)

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - margins[:, None], -700, 700)))


class Sparse:
    """Rows of (column, value), kept by row and by column, for products from both sides; ``values`` None stands for ones."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, values: np.ndarray | None, n_cols: int) -> None:
        self.n_rows, self.n_cols = len(sizes), n_cols
        self.by_row = self._side(np.asarray(sizes), cols, values)
        order = np.argsort(cols, kind="stable")
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.by_col = self._side(np.bincount(cols, minlength=n_cols), rows, None if values is None else values[order])

    @staticmethod
    def _side(sizes: np.ndarray, others: np.ndarray, values: np.ndarray | None) -> tuple:
        used = np.flatnonzero(sizes)
        return used, (np.cumsum(sizes) - sizes)[used], others, values

    @staticmethod
    def _sums(side: tuple, each: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(side[0]):
            out[side[0]] = np.add.reduceat(each, side[1])
        return out

    def _product(self, side: tuple, x: np.ndarray, n: int) -> np.ndarray:
        each = x[side[2]]
        if side[3] is not None:
            each *= side[3]
        return self._sums(side, each, n)

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._product(self.by_row, w, self.n_rows)

    def transposed(self, s: np.ndarray) -> np.ndarray:
        return self._product(self.by_col, s, self.n_cols)

    def holding(self, s: np.ndarray) -> np.ndarray:
        """Of each column the sum of s over the rows that have it, whatever the values."""
        return self._sums(self.by_col, s[self.by_col[2]], self.n_cols)


def likelihood(s: np.ndarray, theta: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of grades at margins ``s``, and its derivatives by ``s`` and ``theta``."""
    n, at = len(grades), np.arange(len(grades))
    below = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -60, 60)))  # P(grade < j)
    cdf = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
    slope = cdf * (1 - cdf)
    p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-12)
    upper, lower = slope[at, grades + 1] / p, slope[at, grades] / p
    dtheta = np.array([(lower[grades == j].sum() - upper[grades == j - 1].sum()) / n for j in range(1, len(theta) + 1)])
    return float(-np.log(p).mean()), (upper - lower) / n, dtheta


def fit_ordinal(texts: Sparse, spread: Sparse, scale: np.ndarray, grades: np.ndarray, n_grades: int, l2: float = L2, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by full-batch Adam.

    ``texts`` has the words of each text, ``spread`` the features of each word, and ``scale`` what each feature is
    multiplied by. Thresholds are a first value and positive gaps, so they stay ascending.
    """
    k, n_cols = n_grades - 1, spread.n_cols
    share = np.array([np.clip((grades >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, n_grades)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    params = np.concatenate([np.zeros(n_cols), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:n_cols], np.exp(params[n_cols + 1 :])
        theta = params[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])
        _, ds, dtheta = likelihood(texts.times(spread.times(scale * w)), theta, grades)
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = np.concatenate([scale * spread.transposed(texts.transposed(ds)) + l2 * w, tail[:1], tail[1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        slower = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        params = params - slower * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_cols + 1 :]))])


def _counted(sample: DataFrame) -> pa.Table:
    """(doc_id, label, names, counts): the distinct words of each text of a bounded sample, in order of the ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(words(text)) for text in each_text(batch.column(1))]
        columns = [batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "names", "counts"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    found = map_arrow(sample.select("doc_id", "text", "label"), run, f"doc_id {id_type}, label int, names array<string>, counts array<int>").toArrow()
    order = pc.sort_indices(found.select(["doc_id", "label"]).append_column("size", pc.list_value_length(found["names"])), [("doc_id", "ascending"), ("label", "ascending"), ("size", "ascending")])
    return found.take(order)


def derived_grades(texts: Sparse, toxic: np.ndarray, n_grades: int) -> np.ndarray:
    """0 for clean rows, 1 and up for toxic ones by how often marked words come in them; rows hold log(1 + count)."""
    n_toxic = toxic.sum()
    by = [texts.holding(kind.astype(float)) for kind in (toxic, ~toxic)]
    odds = np.log((by[0] + 0.5) / (n_toxic - by[0] + 0.5)) - np.log((by[1] + 0.5) / (len(toxic) - n_toxic - by[1] + 0.5))
    marked = (odds > MARKED_ODDS) & (odds / np.sqrt(1 / (by[0] + 0.5) + 1 / (by[1] + 0.5)) > MARKED_Z)
    hits = np.round(texts._sums(texts.by_row, np.expm1(texts.by_row[3]) * marked[texts.by_row[2]], texts.n_rows))
    cuts = np.unique(np.quantile(hits[toxic], np.linspace(0, 1, n_grades)[1:-1]))
    return np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)


def evidence(texts: Sparse, spread: Sparse, toxic: np.ndarray) -> np.ndarray:
    """The scale of each feature: its shrunk log-odds by documents that a word with it is in, in standard errors."""
    by = [spread.transposed(texts.holding(kind.astype(float))) for kind in (toxic, ~toxic)]
    odds = np.log((by[0] + 0.5) / (toxic.sum() + 1)) - np.log((by[1] + 0.5) / ((~toxic).sum() + 1))
    z = odds / np.sqrt(1 / (by[0] + 0.5) + 1 / (by[1] + 0.5))
    return np.sign(z) * np.maximum(np.abs(z) - SHRINK, 0) / 5


def without_evidence(sizes: np.ndarray, words_of: np.ndarray, counts: np.ndarray, n_features: np.ndarray, places: np.ndarray, scale: np.ndarray) -> tuple[Sparse, Sparse, np.ndarray]:
    """The matrices of texts by words and words by features without the features of scale 0, and which features are left.

    Those features, most of all, never get a weight, so the fit is the same, and shorter.
    """
    used = np.flatnonzero(scale)
    number = np.full(len(scale), -1)
    number[used] = np.arange(len(used))
    kept = number[places] >= 0
    per_word = np.bincount(np.repeat(np.arange(len(n_features)), n_features)[kept], minlength=len(n_features))
    word_number = np.cumsum(per_word > 0) - 1
    held = per_word[words_of] > 0
    per_text = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
    spread = Sparse(per_word[per_word > 0], number[places[kept]].astype(np.int32), None, len(used))
    return Sparse(per_text, word_number[words_of[held]].astype(np.int32), np.log1p(counts[held].astype(np.float32)), int((per_word > 0).sum())), spread, used


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = SAMPLE_ROWS, n_grades: int = GRADES) -> OrdinalModel:
    """Learn from a 0/1 label. The driver gets the word counts of the sample, no texts."""
    sample = labelled_sample(docs, labels, label, max_rows)
    # an id may have any number of rows
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))
    found = _counted(sample)
    toxic = found["label"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(0), tuple([50.0] * (n_grades - 1)))
    sizes, counts = pc.list_value_length(found["names"]).to_numpy(), pc.list_flatten(found["counts"]).to_numpy()
    coded = pc.list_flatten(found["names"]).combine_chunks().dictionary_encode()
    del found
    n_features, places = array("i"), array("i")
    for word in coded.dictionary:
        own = sorted(features(word.as_py()))
        n_features.append(len(own))
        places.extend(own)
    spread = Sparse(np.frombuffer(n_features, np.int32), np.frombuffer(places, np.int32), None, 1 << FEATURE_BITS)
    texts = Sparse(sizes, coded.indices.to_numpy(), np.log1p(counts.astype(np.float32)), len(n_features))
    grades, scale = derived_grades(texts, toxic, n_grades), evidence(texts, spread, toxic)
    small_texts, small_spread, used = without_evidence(sizes, coded.indices.to_numpy(), counts, np.frombuffer(n_features, np.int32), np.frombuffer(places, np.int32), scale)
    del coded, counts, texts, spread
    own, theta = fit_ordinal(small_texts, small_spread, scale[used], grades, int(grades.max()) + 1)
    weights = np.zeros(len(scale))
    weights[used] = own * scale[used]
    return OrdinalModel(weights, tuple(map(float, theta)))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, severity (the expected grade), grade (the likeliest), p_toxic, toxic."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.at_least(model.margins(each_text(batch.column(1))))
        cdf = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
        grade = np.argmax(cdf[:, :-1] - cdf[:, 1:], axis=1).astype(np.int32)
        columns = [batch.column(0), pa.array(p.sum(1)), pa.array(grade), pa.array(p[:, 0]), pa.array(p[:, 0] >= TOXIC_FROM)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {id_type}, severity double, grade int, p_toxic double, toxic boolean")
