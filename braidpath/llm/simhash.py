"""SimHash near-dedup: fingerprints, and a self-join of the binary trie that they span.

The trie join walks pairs of nodes from the root. A pair carries the number of bits in which its two prefixes
differ; a child pair whose number exceeds the error budget is cut off with all that is below it. Two fingerprints
within a budget of k bits agree in at least one of k + 1 blocks of bits, so the join is made over k + 1 rotations of
the fingerprints, each with another block on top, and in each begins at the pairs of a node with itself at the foot of
that block: a fingerprint is dealt to k + 1 nodes, however many fingerprints there are, and nodes with one fingerprint
are left out. Many small nodes share a task. A node that is too large for a task is opened in DataFrame steps over
node counts, each pair of its descendants within the budget becoming a task or being opened further, so no task gets
more than a bounded number of fingerprints however they cluster. A task walks on in numpy down to small leaves, which
are compared directly, and returns a spanning forest of the links it found.

Fingerprints are distinct before the join, and name the nodes of the link graph: copies of a text count once, and
ids, of any type, are looked at only when components are done. What is defined for odd input:

* null and empty texts, and texts without words, have fingerprint zero and are linked like any other;
* a null id keeps its row, and names a component only if all ids of it are null; negative and string ids are ordinary;
* repeated ids and repeated rows each keep their row; what shares an id isn't linked by that;
* a very long text is read whole, its hashes counted in blocks; an empty table gives an empty result;
* other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import each_text, hot_lookup, map_arrow, one_row_each, stage
from braidpath.llm.graph import components

BITS = 64
#: Fingerprints that a task should have, and the bits by which a node of over HEAVY is opened.
TASK_ROWS, HEAVY, STEP = 16_384, 16_384, 2
#: Leaf pairs with at most so many pairs of fingerprints are compared directly.
LEAF_PAIRS = 96
#: Hashes whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority (over half) of the XXH64 of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    n = len(words) - width + 1
    columns = [words[k : k + n] for k in range(width)]
    counts = np.zeros(BITS, np.int64)
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*columns)), np.uint64, n)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of each row's whole text, as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([fingerprint(t, width, seed) for t in each_text(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col, text_hash(F.col(text_col))), run, f"doc_id {id_type}, fp bigint, text_hash bigint")


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root`` after the links a-b: for each of n nodes the least node that is reached."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _starts(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, within the sorted ranges lo..hi of one trie node each, keys with ``bit`` set begin."""
    mid = (keys[np.minimum(lo, len(keys) - 1)] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(keys, mid), lo, hi)


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, budget: int):
    """Pairs of positions in two sorted arrays of fingerprints within ``budget`` bits.

    Each array holds one trie node of so many bits' depth, the two prefixes ``differing`` in so many. ``right`` None: ``left``
    may hold many nodes, and each is joined with itself, each pair once. Yields blocks (positions in left, positions in right).
    """
    own = right is None
    keys = left if own else right
    if own and depth:
        begin = np.flatnonzero(np.diff(left >> np.uint64(BITS - depth), prepend=~left[:1] >> np.uint64(BITS - depth)))
        end = np.append(begin[1:], len(left))
        pairs = np.stack([begin, end, begin, end, np.zeros_like(begin)], 1)
    else:
        pairs = np.array([[0, len(left), 0, len(keys), differing]], np.int64)
    for bit in range(BITS - 1 - depth, -1, -1):
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF_PAIRS
        yield from _leaves(left, keys, pairs[small], budget, own)
        pairs = pairs[~small]
        if not len(pairs):
            return
        a0, a1, b0, b1, d = pairs.T
        am, bm = _starts(left, a0, a1, bit), _starts(keys, b0, b1, bit)
        children = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        crossed = np.stack((am, a1, b0, bm, d + 1), 1)
        if own:
            crossed = crossed[a0 != b0]  # a node with itself: its two children meet once
        pairs = np.concatenate([*(np.stack(c, 1) for c in children), crossed])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
    yield from _leaves(left, keys, pairs, budget, own)


def _leaves(left: np.ndarray, keys: np.ndarray, pairs: np.ndarray, budget: int, own: bool):
    for at in range(0, len(pairs), 20_000):
        a0, a1, b0, b1, _ = pairs[at : at + 20_000].T
        wide, n = b1 - b0, (a1 - a0) * (b1 - b0)
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = a0[of] + k // wide[of], b0[of] + k % wide[of]
        near = np.bitwise_count(left[a] ^ keys[b]) <= budget
        if own:
            near &= a < b
        yield a[near], b[near]


def rotated(fp: Column, by: int) -> Column:
    """A signed 64-bit column with its bits moved up by ``by``, those on top coming in below."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _opened(heavy: DataFrame, width: int, budget: int) -> list[tuple[int, DataFrame]]:
    """The tasks of nodes too large for one: depths, and for each (turn, p, q), pairs of prefixes of so many bits, p <= q.

    ``heavy`` has the rows (turn, key) of these nodes, of ``width`` bits. Pairs with a node of over HEAVY rows are opened
    by STEP bits, again and again, and descendants that differ in more than ``budget`` bits cut off.
    """
    depth, tasks = width, []
    open_ = heavy.select("turn", F.shiftrightunsigned("key", BITS - depth).alias("p")).distinct().withColumn("q", F.col("p"))
    while True:
        step = min(STEP, BITS - depth)
        depth += step
        nodes = heavy.groupBy("turn", F.shiftrightunsigned("key", BITS - depth).alias("p")).agg(F.count("*").alias("n"))
        above = open_.select("turn", F.col("p").alias("pp"), F.col("q").alias("qq"))
        others = nodes.select("turn", F.col("p").alias("q"), F.col("n").alias("m"), F.shiftrightunsigned("p", step).alias("qq"))
        pairs = above.join(nodes.withColumn("pp", F.shiftrightunsigned("p", step)), ["turn", "pp"]).join(others, ["turn", "qq"])
        differing = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
        pairs = stage(pairs.filter((F.col("p") <= F.col("q")) & (differing <= budget)).select("turn", "p", "q", "n", "m"), "trie-pairs")
        still = F.greatest("n", "m") > (HEAVY if depth < BITS else 2**62)
        tasks.append((depth, pairs.filter(~still).select("turn", "p", "q")))
        open_ = pairs.filter(still)
        if open_.isEmpty():
            return tasks


def near_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """From distinct (fp) the edges (u, v) between fingerprints, enough to connect all within ``budget`` bits.

    A light node goes to a task with others, as a whole. Of an opened one, a task has one descendant and the later ones that
    it is paired with.
    """
    width = min(BITS - 1, BITS // (budget + 1))
    node = F.shiftrightunsigned("key", BITS - width)
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), rotated(F.col("fp"), t * width).alias("key")) for t in range(budget + 1)]))
    rows = fps.select(turns.alias("x")).select("x.*").withColumn("node", F.struct("turn", node.alias("p")))
    counts = stage(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "trie-nodes")
    n_dealt, most = counts.agg(F.sum("n"), F.max("n")).first()
    n_dealt = n_dealt or 0
    tasks = max(1, n_dealt // TASK_ROWS)
    light = hot_lookup(rows, counts.filter(F.col("n") <= HEAVY), "node", "n", n_dealt)
    task = F.pmod(F.xxhash64("node"), F.lit(tasks))
    dealt = light.select("turn", F.lit(width).alias("depth"), F.lit(None).cast("bigint").alias("p"), task.alias("task"), "key")
    if (most or 0) > HEAVY:
        heavy = stage(hot_lookup(rows, counts.filter(F.col("n") > HEAVY), "node", "n", n_dealt).select("turn", "key"), "trie-heavy")
        for depth, pairs in _opened(heavy, width, budget):
            sides = pairs.select("turn", "p", F.col("q").alias("prefix")).unionByName(pairs.select("turn", "p", F.col("p").alias("prefix"))).distinct()
            part = heavy.withColumn("prefix", F.shiftrightunsigned("key", BITS - depth)).join(sides, ["turn", "prefix"])
            dealt = dealt.unionByName(part.select("turn", F.lit(depth).alias("depth"), "p", F.col("p").alias("task"), "key"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        turn, depth, p = int(group["turn"].iloc[0]), int(group["depth"].iloc[0]), group["p"].iloc[0]
        keys = np.sort(group["key"].to_numpy(np.int64).view(np.uint64))
        root = np.arange(len(keys))
        if pd.isna(p):
            for a, b in trie_links(keys, None, depth, 0, budget):
                root = _forest(len(keys), a, b, root)
        else:
            p = int(p)
            nodes, begin = np.unique(keys >> np.uint64(BITS - depth), return_index=True)
            spans = dict(zip(nodes.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(keys)])))
            low, high = spans[p]
            for q, (start, end) in spans.items():
                right, differing = None if q == p else keys[start:end], (p ^ q).bit_count()
                for a, b in trie_links(keys[low:high], right, depth, differing, budget):
                    root = _forest(len(keys), a + low, b + start, root)
        by = np.uint64(turn * width)
        back = keys if not by else keys >> by | keys << np.uint64(BITS) - by
        moved = np.flatnonzero(root != np.arange(len(keys)))
        return pd.DataFrame({"u": back[moved].view(np.int64), "v": back[root[moved]].view(np.int64)})

    return dealt.groupBy("turn", "depth", "p", "task").applyInPandas(join, "u bigint, v bigint")


def labelled(own: DataFrame, budget: int) -> DataFrame:
    """From ``fingerprints`` one row a fingerprint: fp, n_rows, first, component (a fingerprint).

    ``first`` is the least (whether the id is null, id, text_hash) of the rows.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    groups = stage(own.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n_rows")), "fingerprint-groups")
    found = components(near_links(groups.select("fp"), budget), "near-components")
    return groups.join(found, groups["fp"] == found["id"], "left").select("fp", "n_rows", "first", F.coalesce("component", "fp").alias("component"))


def near_components(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row for each of ``docs``: doc_id, fp, component_id (the least doc_id that links lead to)."""
    own = stage(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    fps = labelled(own, budget)
    least = fps.groupBy("component").agg(F.min("first")["doc_id"].alias("component_id"), F.count("*").alias("n_fps"))
    fps = hot_lookup(fps, stage(least, "component-ids"), "component", "n_fps")
    fps = stage(fps.select("fp", "n_rows", "component_id"), "fingerprint-components")
    return hot_lookup(own, fps, "fp", "n_rows").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: of the rows with the least id that of the least text hash.

    A row is known by its id and its text, so repeated and null ids drag nothing along; of rows that share both one stays.
    """
    own = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = labelled(own, budget).groupBy("component").agg(F.min_by(F.struct("first", "n_rows"), "first").alias("x"))
    stay = firsts.select(F.struct("x.first.doc_id", "x.first.text_hash").alias("key"), F.col("x.n_rows").alias("n_rows"))
    return one_row_each(docs, F.struct(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash")), stage(stay, "near-stay"), "n_rows")
