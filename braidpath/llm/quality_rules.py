"""Quality rules: boosted trees over document statistics, scored as numpy node arrays, behind two fixed rules.

A document fails the base when it has under 50 words or when over half its words lie in repeated 3-word windows.
The others are judged by boosted trees that learn ``labels.quality`` from a bounded sample; the score never rises
with the share of symbols, repeated lines, repeated words, exclamation marks or upper-case letters. Scoring is one pass over the texts.

Null and empty texts have no words and fail the base. Without labels of both kinds the trees are a constant and keep
what passes the base if label 1 is at least as frequent as 0 or none is there. Rows are judged one by one: repeated rows get
equal verdicts, null ids are kept, and very long texts are read whole. Of several labels of one id the greatest counts; splits of
equal gain go to the first statistic. An empty table gives an empty result. ``judge`` looks at no other columns and
``keep_good`` returns them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidpath.llm.common import each_text, map_arrow
from braidpath.llm.text_stats import COUNTS, RATES, counts, rates, sample_rates
from braidpath.llm.trees import Forest, fit_boosted

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document stays if the trees give label 1 at least this probability.
KEEP_FROM = 0.5
#: The bound on the labelled rows that the trees learn from.
SAMPLE_ROWS = 20_000
FALLING = ("symbol_rate", "dup_line_share", "repeat_share", "upper_share", "mark_rate")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS) -> Forest:
    x, y = sample_rates(docs, labels, label, max_rows)
    return fit_boosted(x, y, monotone=tuple(-(r in FALLING) for r in RATES))


def _verdicts(texts, forest: Forest, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
    failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
    score = forest.probability(rates(c))
    return c, failed, score, ~failed & (score >= keep_from)


def judge(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, its counts, base_failed, score, kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = COUNTS[:5]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, failed, score, kept = _verdicts(each_text(batch.column(1)), forest, keep_from)
        columns = [batch.column(0), *map(pa.array, c[:, :5].T), pa.array(failed), pa.array(score), pa.array(kept)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "score", "kept"])

    schema = f"doc_id {id_type}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, score double, kept boolean"
    return map_arrow(docs.select(id_col, text_col), run, schema)


def keep_good(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no row moves to another task."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_verdicts(each_text(batch.column(at)), forest, keep_from)[3]))

    return map_arrow(docs, run, docs.schema)
