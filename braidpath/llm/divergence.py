"""Audit of how sources of a language differ: the distance of each pair of sources, and the terms that mark each source.

A group is the documents of one language and source. Within a language the V terms of at least ``min_docs`` documents are
kept, and a group's share of a term is p(c) = 1 + floor(scale (c + prior) / (N + prior V)), c being the term's count in the
group and N that of all kept terms. The distance of two groups is the sum of |p - q| over all V terms.

Most counts are zero, so distances come from an inverted index: each pair begins at V times the distance of two zero
counts, and the postings of a term (the groups that have it) emit what differs from that. A posting's correction against a
group without the term depends on that group's zero share alone, so postings of one share are corrected together; two groups
that both have the term add what remains. Corrections of zero are left out. All arithmetic is on whole numbers.

What is defined:

* null text, language and source count as empty; every (language, source) that occurs is a group, even without terms;
* terms are runs of letters a-z (after lower-casing A-Z only) and all characters beyond ASCII, of whole texts;
* a language without kept terms gives pairs of distance 0 and no term rows; one with a single source gives no pairs;
* equal values are ordered by item, in the order of UTF-8; repeated rows count each time;
* an empty table gives no rows; other columns are not looked at, and may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.llm.common import hot_lookup, stage

#: Distinct (group, term) that a task counts before it sends them on; changes no result.
MAX_COUNTED = 400_000
#: Parts that a group's terms are ranked in before the best of each meet.
RANK_PARTS = 8

_SPACE = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_SPACE).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs), counted within each task; a row with term '' holds the group's documents."""

    def rows(counts: dict[tuple, Counter], docs_with: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            if own:
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), pa.repeat(source, n), pa.array(own.keys(), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64()), pa.array(map(docs_with[lang, source].__getitem__, own), pa.int64())],
                    names=["lang", "source", "term", "n", "n_docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_with, held = {}, {}, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                own, having = counts.setdefault((lang, source), Counter()), docs_with.setdefault((lang, source), Counter())
                before, found = len(own), terms(text.as_py())
                own.update(found)
                having.update(set(found))
                own[b""] += 0  # so that a group without terms is seen
                having[b""] += 1
                held += len(own) - before
                if held >= MAX_COUNTED:
                    yield from rows(counts, docs_with)
                    counts, docs_with, held = {}, {}, 0
        yield from rows(counts, docs_with)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n bigint, n_docs bigint")


def share(count: str, total: str, n_terms: str, scale: int, prior: int) -> Column:
    """1 + floor(scale (count + prior) / (total + prior n_terms)) of three columns, in decimals that hold the product."""
    return F.expr(f"1 + (CAST({scale} AS DECIMAL(10,0)) * CAST({count} + {prior} AS DECIMAL(19,0))) DIV CAST({total} + {prior} * {n_terms} AS DECIMAL(20,0))")


def _with_total(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row for each value of ``keys``, and n_rows, how many rows have it)."""
    key = F.struct(*keys).alias("group")
    found = hot_lookup(rows.withColumn("group", key), facts.withColumn("group", key).drop(*keys), "group", "n_rows")
    return found.drop("group", "n_rows")


def index(docs: DataFrame, min_docs: int = 30, scale: int = 1_000_000_000, prior: int = 5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, postings), both written.

    groups: lang, source, v, total, p0, one row each. postings: lang, source, term, n, p, p0, q, one row for each kept term of
    a group; q is the share of the term in the whole language.
    """
    counted = term_counts(docs, text_col, lang_col, source_col)
    # counts of a term meet by language and term; a window over them adds no exchange
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"docs_of_term": F.sum("n_docs").over(of_term), "n_of_term": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    counted = stage(counted.filter((F.col("term") == "") | (F.col("docs_of_term") >= min_docs)).drop("n_docs", "docs_of_term"), "divergence-counts")
    kept, is_group = counted.filter("term <> ''"), counted.filter("term = ''").select("lang", "source")
    langs = kept.groupBy("lang").agg(F.sum(F.when(F.col("first"), F.lit(1)).otherwise(0)).alias("v"), F.sum("n").alias("lang_total"), F.count("*").alias("n_rows"))
    groups = is_group.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows")), ["lang", "source"], "left")
    groups = groups.join(langs.drop("n_rows"), "lang", "left").fillna(0, ["total", "n_rows", "v", "lang_total"]).withColumn("none", F.lit(0).cast("bigint"))
    groups = stage(groups.withColumn("p0", F.when(F.col("v") > 0, share("none", "total", "v", scale, prior))), "divergence-groups")
    postings = _with_total(kept, groups.filter("v > 0").select("lang", "source", "v", "total", "lang_total", "p0", "n_rows"), ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", share("n", "total", "v", scale, prior).alias("p"), "p0", share("n_of_term", "lang_total", "v", scale, prior).alias("q"))
    return groups.select("lang", "source", "v", "total", "p0"), stage(postings, "divergence-postings")


def pair_distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, other, value) for each two sources of a language, in both orders."""
    left, right = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    # each ordered pair of groups; as many rows as the answer has
    pairs = stage(left.join(right, "lang").filter("source <> other"), "divergence-pairs")
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    base = pairs.select("lang", "source", "other", F.coalesce(F.col("v") * apart("p0", "other_p0"), F.lit(0)).alias("value"))
    # postings of one group and one share get one correction against the zero share of each other group
    alike = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n_terms"))
    one = alike.join(pairs, ["lang", "source"]).select("lang", "source", "other", (F.col("n_terms") * (apart("p", "other_p0") - apart("p0", "other_p0"))).alias("value")).filter("value <> 0")
    one = one.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    one = one.unionByName(one.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # terms that both have: what the two corrections against zero leave open
    own = postings.select("lang", "term", "source", "p", "p0")
    two = own.join(own.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("p0").alias("other_p0")), ["lang", "term"]).filter("source < other")
    two = two.select("lang", "source", "other", (apart("p", "other_p") - apart("p", "other_p0") - apart("p0", "other_p") + apart("p0", "other_p0")).alias("value")).filter("value <> 0")
    two = two.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    two = two.unionByName(two.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    return base.unionByName(one).unionByName(two).groupBy("lang", "source", "other").agg(F.sum("value").cast("bigint").alias("value"))


def marking_terms(postings: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, term, value, rank): a group's terms whose share is above that of the language, the ``top`` largest gaps.

    The terms of a group are ranked in parts first, so that only the best of each part meet.
    """
    over = postings.filter("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.col("value").desc(), F.col("term")]
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return best.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, prior: int = 5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs of sources, and the terms that mark each group."""
    groups, postings = index(docs, min_docs, scale, prior, text_col, lang_col, source_col)
    pairs = pair_distances(groups, postings).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other")))
    columns = lambda df, part, item: df.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair", "other").unionByName(columns(marking_terms(postings, top), "term", "term"))
