"""Statistics of whole texts, and bounded samples of labelled documents; the quality operators share both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import each_text, map_arrow

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
RATES = ("log_words", "mean_word", "symbol_rate", "dup_line_share", "repeat_share", "words_per_line", "distinct_share", "upper_share", "digit_share", "mark_rate")

WHITE, SYMBOLS, UPPER, DIGITS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"


def repeated_words(words: list[bytes], distinct: dict[bytes, int], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    keys = ids[:n]
    for k in range(1, width):
        if len(distinct) * (int(keys.max()) + 1) >= 2**62:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(distinct) + ids[k : k + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= found
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs without ASCII white space; only lines with a word count as lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - of(WHITE), of(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words, distinct), len(lines), len(distinct), of(UPPER), of(DIGITS), of(MARKS)


def rates(c: np.ndarray) -> np.ndarray:
    """RATES from rows of COUNTS; nothing divided by nothing is 0."""
    n_words, chars, symbols, dups, repeats, n_lines, distinct, upper, digits, marks = np.asarray(c, float).reshape(-1, len(COUNTS)).T
    w, ln, ch = np.maximum(n_words, 1), np.maximum(n_lines, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(n_words), chars / w, symbols / w, dups / ln, repeats / w, n_words / ln, distinct / w, upper / ch, digits / ch, marks / w], 1)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS (long) and RATES (double) of each row's whole text; null counts as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join([f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATES])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([counts(t) for t in each_text(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
        columns = [batch.column(0), *map(pa.array, own.T), *map(pa.array, rates(own).T)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, *RATES])

    return map_arrow(docs.select(id_col, text_col), run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns labels from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) for at most ``max_rows`` labelled ids outside the held-out fold, those of least hash: all rows of these.

    The ids have a fixed bound, so they are broadcast to the documents and no text is moved.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id")


def sample_rates(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """RATES and labels of ``labelled_sample``, in the order of the ids; of rows with one id the least counts."""
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col)
    stats = text_stats(sample.select(F.struct("doc_id", "label").alias("doc_id"), "text"))
    rows = stats.select(F.col("doc_id.doc_id").alias("id"), F.struct(F.col("doc_id.label"), *RATES).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    found = np.array([tuple(r["x"]) for r in sorted(rows.collect(), key=lambda r: r["id"])], float).reshape(-1, 1 + len(RATES))
    return found[:, 1:], found[:, 0]
