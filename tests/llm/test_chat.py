import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidpath.llm import chat

MESSAGES = [
    (1, 0, "user", "How do I sort a table by two columns?\nIt is a large one."),
    (1, 1, "assistant", "Name both in the order."),
    (1, 2, "user", "> How do I sort a TABLE by two columns?\n> It is a   large one.\nStill the same question."),
    (1, 3, "assistant", ">> How do I sort a table by two columns?\n>> It is a large one.\n> Still the same question.\nAs I said."),
    (1, 4, "user", "> Nobody ever said this thing\nOdd."),
    (2, 0, "user", "How do I sort a table by two columns?"),
    (2, 1, "user", "> a line that comes only later on\nhm"),
    (2, 2, "user", "a line that comes only later on"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 1, "user", ""),
    (None, 0, "user", "> How do I sort a table by two columns?\nno conversation"),
    (4, None, "user", "no turn"),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(*m, "x", "x", "x") for m in MESSAGES]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, source string, hash string, depth string").repartition(3)


def test_parse():
    assert chat.parse("a\n> b\n>> c\n> > d\n> e\nf") == ("a\nf", [(1, ["b"]), (2, ["c", "d"]), (1, ["e"])])
    assert chat.parse("plain > text") == ("plain > text", [])
    assert chat.parse("") == ("", [])


def test_links_and_order(messages):
    got = chat.reply_order(messages).collect()
    assert len(got) == len(MESSAGES)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 2]["reply_to"] == 0 and by[1, 2]["text"] == "Still the same question." and by[1, 2]["n_linked"] == 3
    assert by[1, 3]["reply_to"] == 2 and by[1, 3]["n_quotes"] == 2 and by[1, 3]["text"] == "As I said."
    assert (by[1, 3]["root_turn"], by[1, 3]["depth"]) == (0, 2)
    assert by[1, 4]["reply_to"] is None and by[1, 4]["n_quotes"] == 1
    assert by[2, 1]["reply_to"] is None  # its source comes later
    assert by[None, 0]["reply_to"] is None and by[None, 0]["text"] == "no conversation"
    assert [r["turn"] for r in got if r["conv_id"] == 1] == [0, 2, 3, 1, 4]
    place = {(r["conv_id"], r["turn"]): k for k, r in enumerate(got)}
    assert all(place[r["conv_id"], r["reply_to"]] < place[r["conv_id"], r["turn"]] for r in got if r["reply_to"] is not None)


def test_long_chain_and_common_quote(spark):
    first = "everyone quotes this very line"
    rows = [(9, 0, "u", first)] + [(9, k, "u", f"> {'message number ' + str(k - 1) if k > 1 else first}\nmessage number {k}") for k in range(1, 40)]
    rows += [(10, 0, "u", first)] + [(10, k, "u", f"> {first}\nreply {k}") for k in range(1, 60)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[9, 39]["depth"] == 39 and got[9, 39]["root_turn"] == 0
    assert all(got[10, k]["reply_to"] == 0 and got[10, k]["depth"] == 1 for k in range(1, 60))


def test_no_messages_and_no_quotes(messages):
    assert chat.reply_order(messages.filter("conv_id = -1")).count() == 0
    plain = chat.reply_order(messages.filter("conv_id = 3")).collect()
    assert [(r["turn"], r["root_turn"], r["depth"], r["text"]) for r in plain] == [(0, 0, 0, ""), (1, 1, 0, ""), (1, 1, 0, "")]


def test_short_quotes(spark):
    texts = ["Yes.", "No, 42\nand more of it", "Yes.", "> Yes.\nGood.", "> no, 42\nWhy?", "> Yes.\nYes.", "> Yes.\nhm", "> 7\nnever said", ">\nempty"]
    rows = [(1, k, "u", t) for k, t in enumerate(texts)]
    rows += [(2, k, "u", "> ok\nok") for k in range(400)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)).collect()}
    assert [got[1, k]["reply_to"] for k in range(9)] == [None, None, None, 2, 1, 2, 5, None, None]
    assert [got[1, k]["n_linked"] for k in range(9)] == [0, 0, 0, 1, 1, 1, 1, 0, 0]
    assert [got[2, k]["reply_to"] for k in range(400)] == [None, *range(399)]
    assert got[2, 399]["root_turn"] == 0 and got[2, 399]["depth"] == 399


def test_attribution_goes_with_the_quote():
    assert chat.parse("Hi.\nOn Mon, Ann wrote:\n> b\nYes.") == ("Hi.\nYes.", [(1, ["b"])])
    assert chat.parse("Hi.\nOn Mon, 3 Jan, Ann Smith\n<ann@example.org> wrote:\n\n> b") == ("Hi.", [(1, ["b"])])
    assert chat.parse("Ann wrote:\nno quote here")[0] == "Ann wrote:\nno quote here"
    assert chat.parse("These are the rules:\n> b")[0] == "These are the rules:"


def test_quotes_with_other_line_breaks(spark):
    own = "alpha beta\ngamma delta\n\nepsilon zeta\neta theta\niota"
    quotes = ["> gamma delta epsilon\n> zeta", "> gamma\n> delta epsilon zeta eta theta", "> beta gamma delta", "> " + own.replace("\n", " "), "> eta\n> theta iota"]
    rows = [(1, 0, "u", own)] + [(1, k, "u", f"{q}\nanswer {k}") for k, q in enumerate(quotes, 1)]
    got = {r["turn"]: r["reply_to"] for r in chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    # the third begins within a line
    assert [got[k] for k in range(6)] == [None, 0, 0, None, 0, 0]


def plain_links(rows):
    """The same by comparing every passage with every run of lines of every earlier message."""
    spoken, wanted = defaultdict(set), defaultdict(set)
    for conv, turn, _, text in rows:
        own, passages, last = [], [], 0
        for line in (text or "").split("\n"):
            marks = len(line) - len(line.lstrip("> ")) and line[: len(line) - len(line.lstrip("> "))].count(">")
            if not marks:
                own.append(" ".join(line.lower().split()))
            elif marks == last:
                passages[-1][1].append(" ".join(line.lstrip("> ").lower().split()))
            else:
                passages.append((marks, [" ".join(line.lstrip("> ").lower().split())]))
            last = marks
        if conv is None or turn is None:
            continue
        own = [line for line in own if line]
        spoken[conv, turn] |= {" ".join(own[a:b]) for a in range(len(own)) for b in range(a + 1, len(own) + 1)}
        for level, lines in passages:
            wanted[conv, turn] |= {(level, 0, " ".join(x for x in lines if x))} | {(level, 1, x) for x in lines}
    reply = {}
    for (conv, turn), parts in wanted.items():
        found = []
        for level, part, words in parts:
            sources = [t for (c, t), own in spoken.items() if c == conv and t < turn and words and words in own]
            if sources:
                found.append((level, part, -max(sources), words))
        if found:
            reply[conv, turn] = (-min(found)[2], len({f[3] for f in found}))
    return reply


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["yes", "no", "a longer line of words", "What?", "see  below", "42"]
    rows = []
    for conv in (1, 2, 3, 4, 5, None):
        for turn in range(40):
            lines = []
            for _ in range(rnd.randrange(1, 6)):
                lines.append("> " * rnd.choice([0, 0, 1, 1, 2]) + " ".join(rnd.choices(words, k=rnd.randrange(1, 3))))
            rows.append((conv, turn if rnd.random() < 0.9 else rnd.randrange(40), "u", rnd.choice(["\n".join(lines), "\n".join(lines), None, ""])))
    got = chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)).collect()
    want = plain_links(rows)
    assert len(got) == len(rows) and len(want) > 30
    for r in got:
        reply, n = want.get((r["conv_id"], r["turn"]), (None, 0))
        assert (r["reply_to"], r["n_linked"]) == (reply, n)
        root, depth = r["turn"], 0
        while (r["conv_id"], root) in want:
            root, depth = want[r["conv_id"], root][0], depth + 1
        assert (r["root_turn"], r["depth"]) == (root, depth)


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_turns_of_other_types(spark, kind):
    """Whatever has an order may number the turns: what is said later answers, and the latest source counts."""
    texts = ["alpha", "beta", "alpha", "> alpha\nyes", "> beta\nno", "> gamma\nodd"]
    rows = spark.createDataFrame([(f"c{c}", k, "u", t) for c in (1, 2) for k, t in enumerate(texts)], "conv_id string, k int, role string, text string")
    turn = {"string": "char(97 + k)", "date": "date_add(date'2020-01-01', k)", "double": "k / 10D"}[kind]
    got = chat.reply_order(rows.selectExpr("conv_id", f"{turn} as turn", "role", "text")).collect()
    turns = sorted({r["turn"] for r in got})
    by = {(r["conv_id"], turns.index(r["turn"])): r["reply_to"] and turns.index(r["reply_to"]) for r in got}
    assert by == {(f"c{c}", k): {3: 2, 4: 1}.get(k) for c in (1, 2) for k in range(6)}


def test_only_what_is_quoted_is_said(spark, monkeypatch):
    """Many lines and many lengths of quotes: hashes leave a task for what some quote has, and no fewer without the names."""
    lines = [f"line {'x ' * k}end" for k in range(20)]
    rows = [(1, 0, "u", "\n".join(lines))] + [(1, k, "u", f"> {lines[k]}\nanswer {k}") for k in range(1, 20)]
    df = chat.parsed(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    quotes = df.filter("n_quotes > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    assert chat.said(df, quotes).filter("turn = 0").count() == 19
    links = sorted(map(tuple, chat.reply_links(df).collect()))
    monkeypatch.setattr(chat, "QUOTES_BY_NAME", 3)
    assert chat.said(df, quotes).filter("turn = 0").count() > 19
    assert sorted(map(tuple, chat.reply_links(df).collect())) == links and len(links) == 19


def test_hash_of_a_run_is_that_of_its_words():
    words = "a b c d e f a b c".split()
    up_to = chat.prefixes(words)
    for a in range(9):
        for b in range(a, 10):
            assert (up_to[b] - up_to[a] * pow(chat.PLACE, b - a, chat.MODULUS)) % chat.MODULUS == chat.prefixes(words[a:b])[-1]
    assert len({chat.digest(words[a:b]) for a in range(9) for b in range(a + 1, 10)}) == len({tuple(words[a:b]) for a in range(9) for b in range(a + 1, 10)})
