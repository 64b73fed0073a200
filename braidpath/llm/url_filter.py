"""URL filters by Bloom filter cascades: exact membership of every key of the corpus, tested without a join.

A key is a host suffix followed by a path prefix, as in ``example.net/en/``. A cascade for a list of keys is a row of
Bloom filters: the first holds the listed keys; the second those keys of the corpus that the first lets through
wrongly; the third the listed keys that the second lets through, and so on until nothing is let through wrongly. A
key of the corpus is listed exactly if the first filter that refuses it has an even number, or if none refuses it and
their number is odd. All filters are built by DataFrame aggregation and become constants of the expression that
tests a key; the rows that are judged are neither shuffled nor joined.

The first filter's rate of false positives follows the ratio of listed to corpus keys and the others let through one
half, so the bits are in proportion to the listed keys times the log of that ratio. Beyond MAX_BITS a list is refused
with an error, not cut. Lists are tables with a column ``key``, or short Python lists. Defined are:

* null and empty urls and urls without ``://`` have empty host and path, fit no rule and are allowed;
* very long urls are tested whole; repeated rows get equal verdicts, null ids are kept; keys listed twice count once;
* of keys that fit, the longest decides; no two keys of one url have the same length and differ, so there are no ties;
  a key that is both allowed and blocked blocks;
* empty tables and empty lists are fine; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.llm.common import stage
from braidpath.llm.exact_dedup import LOWER, UPPER

#: 8 MB of filter words; they go to every executor as a constant.
MAX_BITS = 2**26
#: Kinds of keys (labels of the host, length of the path) that a url is tested for at most; beyond, lists are refused.
MAX_SHAPES = 4_096


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of each kind of key, the longest key first to be tried last."""
    own = F.substring_index("key", "/", 1)
    labels = F.length(own) - F.length(F.replace(own, F.lit("."))) + 1
    found = keys.select(labels.alias("labels"), (F.length("key") - F.length(own)).alias("path")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(found) > MAX_SHAPES:
        raise ValueError(f"the lists have over {MAX_SHAPES} kinds of keys")
    return sorted((r["labels"], r["path"]) for r in found)


def key_table(spark: SparkSession, keys: DataFrame | Iterable[str]) -> DataFrame:
    """A list as a table with the column ``key``."""
    if isinstance(keys, DataFrame):
        return keys.select("key").filter("key is not null")
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(list(keys))), "array<string>")).alias("key"))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of the given shapes that could stand for an address: at most one a shape."""
    labels = F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."))) + 1)
    own = [F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    return F.filter(F.array(*own), lambda k: k.isNotNull()) if own else F.array().cast("array<string>")


@dataclass(frozen=True)
class Bloom:
    """A filter of ``bits`` bits in 64-bit words; its hash functions differ from those of other levels by ``seed``."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        # the words are one literal, whatever the number of hash functions
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        unset = lambda at: F.bit_get(F.get(words, F.call_function("div", at, F.lit(64)).cast("int")), (at % 64).cast("int")) == 0
        return ~F.exists(F.array(*places(key, self.bits, self.hashes, self.seed)), unset)


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(bits)) for k in range(hashes)]


def build_bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A filter of the column ``key``, sized for ``n`` keys; one row a word comes back, at most bits / 64."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits; a filter has {MAX_BITS} at most")
    place = F.explode(F.array(*places(F.col("key"), bits, hashes, seed)))
    words = keys.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    own = [0] * (bits // 64)
    for r in words.collect():
        own[r["word"]] = r["bits"]
    return Bloom(tuple(own), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Exact for the listed keys and for all keys of the corpus that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.passes(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
    """From the columns ``key`` of the listed keys and of all keys of the corpus, repeats allowed."""
    inside = stage(listed.select("key").distinct(), "listed-keys")
    n_inside = inside.count()
    if not n_inside:
        return Cascade(())
    rate = min(0.5, max(2.0**-30, n_inside / max(1, n_universe) * math.sqrt(0.5)))
    levels = [build_bloom(inside, n_inside, rate, 0)]
    # what a level lets through wrongly is all that the next has to hold; only the first looks at the corpus
    wrong = universe.select("key").filter(levels[0].passes(F.col("key"))).distinct().join(inside, "key", "left_anti")
    wrong, right = stage(wrong, "cascade-level"), inside
    while n_wrong := wrong.count():
        levels.append(build_bloom(wrong, n_wrong, 0.5, len(levels)))
        wrong, right = stage(right.filter(levels[-1].passes(F.col("key"))), "cascade-level"), wrong
    return Cascade(tuple(levels))


def build_cascades(urls: DataFrame, lists: Mapping[str, DataFrame], url_col: str = "url") -> tuple[dict[str, Cascade], list[tuple[int, int]]]:
    """A cascade for each list over all keys of ``urls``; one pass counts these, one for each list filters them."""
    every = None
    for keys in lists.values():
        every = keys if every is None else every.unionByName(keys)
    forms = shapes(every)
    universe = urls.select(F.explode(candidate_keys(host(F.col(url_col)), path(F.col(url_col)), forms)).alias("key"))
    n = universe.agg(F.approx_count_distinct("key")).first()[0]
    return {name: build_cascade(keys, universe, n) for name, keys in lists.items()}, forms


def judge_urls(urls: DataFrame, rules: DataFrame | Mapping[str, str], blocked: DataFrame | Iterable[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a url: page_id, host, path, rule, verdict.

    ``rules`` maps keys to ``allow`` or ``block``, or has these as columns ``key`` and ``action``; the longest that fits
    decides. Where none fits, the url is blocked if a key of it is in ``blocked``, else allowed.
    """
    spark = urls.sparkSession
    if isinstance(rules, DataFrame):
        lists = {name: key_table(spark, rules.filter(F.col("action") == name)) for name in ("allow", "block")}
    else:
        lists = {name: key_table(spark, [k for k, v in rules.items() if v == name]) for name in ("allow", "block")}
    cascades, forms = build_cascades(urls, lists | {"site": key_table(spark, blocked)}, url_col)
    rows = urls.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), forms))
    longest = lambda c: F.reduce(F.filter("keys", c.holds), F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    rows = rows.withColumns({name: longest(cascades[name]) for name in ("allow", "block")})
    rows = rows.withColumn("site", F.exists("keys", cascades["site"].holds))
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.length("block") >= F.length("allow")))
    rule = F.when(blocks, F.col("block")).otherwise(F.col("allow"))
    verdict = F.when(blocks, "block").when(rule.isNull() & F.col("site"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
