"""Chat formatting by quotation linking: conversations in reply order, without the quotes.

A line that begins with one or more ``>`` is quoted, at as deep a level as it has marks; consecutive lines of one level are
a passage. A line before a quote that says who wrote it goes with the quote. A passage is normalised (marks stripped, lower
case, white space runs to one space) and hashed, as a whole and line by line. A message said a passage if a run of
consecutive lines of its own has the same normalised words, however the lines are broken; runs are looked for at the
lengths in words that the conversation's quotes have, so the work is linear in the text for each length. Joining the hashes
within a conversation finds for each passage, of whatever length, the latest message before that said it; a message
replies to the latest source of its shallowest linked passages, a whole passage counting before a line. Replies form trees;
following them by doubling gives each message its root and depth, and (conv_id, root_turn, depth, turn) is the reply order:
every message comes after the one it answers, and messages that answer nothing come in their turns.

No join meets a text that everyone quotes, or a message that everyone answers, in one task: hashes are range-sorted and
partitions take in what was said before them, and pointers to a message with many answers are followed by broadcast. The
output is range-sorted, so a conversation with a large part of all rows isn't gathered. Defined are:

* null texts count as empty; empty passages and lines link to nothing; very long texts are read whole;
* rows with a null conv_id or turn are kept, and quote and answer nothing;
* rows that share conv_id and turn are one message when links are looked for, and each is returned;
* turns may be of any type with an order, conversations of any type that can be compared;
* ties go as said above, to the latest source; an empty table gives an empty result;
* other columns than the four named stay out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidpath.llm.common import each_text, hot_lookup, map_arrow, stage

QUOTED = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
SPACE = re.compile(r"\s+")
#: What ends a line that names the author of the quote below it, in some languages; it may be broken after the date.
ATTRIBUTION = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió|ha scritto|escreveu)\s*:\s*$", re.I)
ATTRIBUTION_BEGIN = re.compile(r"^\s*(?:on|am|le|el|il|em)\s", re.I)


def normalise(text: str) -> str:
    return SPACE.sub(" ", text.lower()).strip()


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """What a message says itself, and its quoted passages as (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = QUOTED.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(m[2])
        else:
            if not last:
                _drop_attribution(own)
            passages.append((level, [m[2]]))
        last = level
    return ("\n".join(own).strip() if passages else text), passages


def _drop_attribution(own: list[str]) -> None:
    """Take the author's line off the end of ``own``, and blank lines behind it."""
    at = len(own) - 1
    while at >= 0 and not own[at].strip():
        at -= 1
    if at < 0 or not ATTRIBUTION.search(own[at]):
        return
    broken = at > 0 and not ATTRIBUTION_BEGIN.match(own[at]) and ATTRIBUTION_BEGIN.match(own[at - 1])
    del own[at - 1 if broken else at :]


#: Words hash to numbers below a Mersenne prime, and runs of words to the polynomial of these at a fixed place.
MODULUS = (1 << 127) - 1
PLACE = int.from_bytes(xxhash.xxh3_128_digest(b"place")) % MODULUS


def prefixes(words: list[str]) -> list[int]:
    """The hash of the first n words, for each n; that of any run follows from two of them."""
    out = [0]
    for word in words:
        out.append((out[-1] * PLACE + int.from_bytes(xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass")))) % MODULUS)
    return out


def digest(words: list[str]) -> bytes:
    return prefixes(words)[-1].to_bytes(16)


def hashes(lines: list[str]) -> list[tuple[int, int, bytes]]:
    """(0, words, hash) of a passage and (1, words, hash) of its lines, once each; empty ones tell nothing."""
    parts = [(0, normalise(" ".join(lines)))] + [(1, n) for n in map(normalise, lines)]
    return list(dict.fromkeys((k, t.count(" ") + 1, digest(t.split(" "))) for k, t in parts if t))


def runs(text: str, lengths: list[int], wanted: set[bytes] | None = None) -> set[bytes]:
    """The hashes of all runs of consecutive lines that have one of the lengths in words; of those, if given, that are ``wanted``.

    A run costs two steps whatever its length, so the work is linear in the words, and in the lines for each length.
    """
    lines = [w for w in (normalise(line).split(" ") for line in text.split("\n")) if w != [""]]
    if not lines:
        return set()
    ends = np.cumsum([len(line) for line in lines], dtype=np.int64)
    begins, up_to = ends - [len(line) for line in lines], prefixes([w for line in lines for w in line])
    out = set()
    for n in lengths:
        place = pow(PLACE, n, MODULUS)
        for at in begins[np.isin(begins + n, ends)].tolist():
            found = ((up_to[at + n] - up_to[at] * place) % MODULUS).to_bytes(16)
            if wanted is None or found in wanted:
                out.add(found)
    return out


QUOTES = pa.list_(pa.struct([("level", pa.int32()), ("part", pa.int32()), ("n_words", pa.int32()), ("hash", pa.binary())]))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, own text, number of quoted passages, (level, part, n_words, hash) quoted."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n, quotes = [], [], []
        for text in each_text(batch.column(3)):
            body, passages = parse(text)
            own.append(body)
            n.append(len(passages))
            quotes.append([{"level": lv, "part": part, "n_words": w, "hash": h} for lv, lines in passages for part, w, h in hashes(lines)])
        columns = [*batch.columns[:3], pa.array(own, pa.string()), pa.array(n, pa.int32()), pa.array(quotes, QUOTES)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "n_quotes", "quotes"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", text string, n_quotes int, quotes array<struct<level: int, part: int, n_words: int, hash: binary>>"
    return map_arrow(messages.select("conv_id", "turn", "role", text_col), run, schema)


#: Quotes of a conversation that are looked for by name; in one of more, what isn't quoted is sorted out by the join alone.
QUOTES_BY_NAME = 4_096


def said(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): what the messages of conversations with quotes said, in runs of lines as long as a quote.

    But for conversations of very many quotes only what some quote has leaves the task.
    """
    sizes = stage(quotes.groupBy("conv_id").agg(F.collect_set("n_words").alias("lengths"), F.count("*").alias("n_quotes")), "chat-sizes")
    few = hot_lookup(quotes.select("conv_id", "hash"), sizes.select("conv_id", "n_quotes", (F.col("n_quotes") <= QUOTES_BY_NAME).alias("few")), "conv_id", "n_quotes").filter("few")
    names = few.groupBy("conv_id").agg(F.collect_set("hash").alias("wanted"))
    facts = rows.groupBy("conv_id").agg(F.count("*").alias("n_rows")).join(sizes.drop("n_quotes"), "conv_id").join(names, "conv_id", "left")
    own = hot_lookup(rows.select("conv_id", "turn", "text"), stage(facts, "chat-lengths"), "conv_id", "n_rows").select("conv_id", "turn", "text", "lengths", "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, lengths, wanted in zip(each_text(batch.column(2)), batch.column(3), batch.column(4)):
            found.append(list(runs(text, lengths.as_py(), set(wanted.as_py()) if wanted.is_valid else None)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["conv_id", "turn", "hashes"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return map_arrow(own, run, f"{kinds}, hashes array<binary>").select("conv_id", "turn", F.explode("hashes").alias("hash"))


def reply_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) for the messages with a linked passage; ``rows`` as from ``parsed``."""
    rows = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = rows.filter("n_quotes > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    quotes = stage(quotes, "chat-quotes")
    linked = nearest_said(quotes, said(rows, quotes))
    # the least (level, part) first, of its sources the latest
    best = F.max(F.struct((-F.col("level")).alias("level"), (-F.col("part")).alias("part"), "source"))
    linked = linked.groupBy("conv_id", "turn").agg(best.alias("best"), F.count_distinct("hash").alias("n_linked"))
    return linked.select("conv_id", "turn", F.col("best.source").alias("reply_to"), "n_linked")


def nearest_said(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """``quotes`` with ``source``, the latest earlier turn in ``turns`` that said the hash; without one they go.

    A passage may be said and quoted in every turn of a large conversation, so turns aren't joined with turns and no
    window gathers a hash: in order of (conversation, hash, turn), partitions take in the last turn said before them.
    """
    keys = ["conv_id", "hash"]
    events = turns.select(*keys, "turn", F.lit(1).alias("says"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("part"))
    events = stage(events.unionByName(quotes.select(*keys, "turn", F.lit(0).alias("says"), "level", "part")), "chat-events")
    # a message doesn't answer itself: at a turn, quotes come before what is said
    order = [*keys, "turn", "says"]
    dealt = stage(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id()), "chat-dealt")
    spoken = F.when(F.col("says") == 1, F.col("turn"))
    last = dealt.groupBy(*keys, "bucket").agg(F.max(spoken).alias("last"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.max("last").over(before)).drop("last")
    within = Window.partitionBy(*keys, "bucket").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("own", F.max(spoken).over(within)).filter("says = 0").join(last, [*keys, "bucket"])
    return found.withColumn("source", F.coalesce("own", "before")).filter("source is not null").select(*keys, "turn", "level", "part", "source")


def roots(links: DataFrame) -> DataFrame:
    """``links`` with root_turn and depth: pointers are doubled until all have reached a message without a link."""
    at = stage(links.select("conv_id", "turn", F.struct("conv_id", F.col("reply_to").alias("turn")).alias("to"), F.lit(1).alias("depth")), "chat-roots")
    n_rows = at.count()
    while True:
        up = at.select(F.struct("conv_id", "turn").alias("to"), F.col("to.turn").alias("above"), F.col("depth").alias("more"))
        # a row for each message that is pointed at, with or without a pointer of its own
        facts = at.groupBy("to").agg(F.count("*").alias("n_rows")).join(up, "to", "left")
        step = hot_lookup(at, facts, "to", "n_rows", n_rows)
        to = F.struct("conv_id", F.coalesce("above", "to.turn").alias("turn")).alias("to")
        moved = step.select("conv_id", "turn", to, (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        moved = stage(moved, "chat-roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return links.join(at.select("conv_id", "turn", F.col("to.turn").alias("root_turn"), "depth"), ["conv_id", "turn"])


def reply_order(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a message, in reply order: conv_id, root_turn, depth, turn, role, reply_to, n_quotes, n_linked, text without quotes."""
    rows = stage(parsed(messages, text_col), "chat-parsed")
    links = stage(reply_links(rows), "chat-links")
    base = rows.select("conv_id", "turn", "role", "n_quotes", "text")
    if links.isEmpty():
        x = base.withColumns({"reply_to": F.lit(None).cast(base.schema["turn"].dataType), "n_linked": F.lit(0).cast("bigint"), "root_turn": F.col("turn"), "depth": F.lit(0)})
    else:
        x = base.join(roots(links), ["conv_id", "turn"], "left")
        x = x.withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0))})
    order = ["conv_id", "root_turn", "depth", "turn"]
    x = x.select(*order, "role", "reply_to", "n_quotes", "n_linked", "text")
    return x.repartitionByRange(*order).sortWithinPartitions(*order)
