"""Secret scans: fixed patterns, and a guess-cost dynamic program over values found in credential contexts.

The cost of a value is the least sum, over all ways to cut it into segments, of the segments' log10 guesses plus a
charge for each further segment. A segment is a known word (its rank, and how its capitals vary), a date, a repeat
of a character or block, a keyboard walk or alphabetic sequence, or one brute-force character (the size of the
classes that the value draws from). Segments are bounded in length or taken whole as maximal runs, so the program is
linear in the value. A value that costs THRESHOLD or more is a secret rather than a placeholder.

Words and their ranks are COMMON_WORDS, short and by hand, and then those of a tokenizer's rank file, a public list of
frequent pieces of running text in order (some 30,000 words of LEAST_WORD letters or more), whose place is a parameter.

Offsets are code points, the end exclusive. Defined are: null and empty texts have no spans; very long texts and values are
scanned whole; spans that begin together are ordered by kind, then by end; each row is scanned by itself, so repeated rows
get equal results and null ids are kept; an empty table gives an empty result; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from braidpath.llm.bpe import rank_file
from braidpath.llm.common import each_text, map_arrow

#: log10 of the guesses from which a value counts as a secret, and the charge for each segment after the first.
THRESHOLD, JOINT = 10.0, math.log10(2)

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Words that announce a credential, what stands between, and the scheme of an authorization. Only the value's begin is
#: found: matches don't take the value in, so a word within it announces its own. With ``:`` or ``=`` long words may end a
#: name (mypassword=); short ones, and all before mere white space, are words of their own or humps (userPass).
_LONG = rb"pass(?:word|wd|phrase|code|key)|secret|credentials?|authorization|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|token|bearer"
_OWN = rb"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
_SCHEME = rb"""(?:(?i:basic|bearer|digest|token|negotiate|ntlm|hawk|api-?key)\s+["']?)?"""
CONTEXT = re.compile(
    rb"(?:(?i:" + _LONG + rb")|" + _OWN + rb"""(?i:pass|pwd|auth|login))["']?\s*(?::=|=>|[:=])\s*["']?""" + _SCHEME
    + rb"|" + _OWN + rb"(?i:" + _LONG + rb"""|pass|pwd|auth|login)["']?\s+(?:is\s+)?["']?""" + _SCHEME
)
#: A value goes up to white space or a quote.
VALUE = re.compile(rb"""[^\s"'<>,;|]*""")
LEAST_VALUE = 6
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"bearer", b"key", b"login")

#: Frequent passwords and words, by falling frequency.
COMMON_WORDS = (
    "password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein shadow master "
    "michael mustang jordan superman harley trustno1 ranger hunter buster soccer hockey george killer andrew charlie thomas daniel jessica "
    "pepper ginger welcome admin login secret token example changeme default sample dummy test testing user root guest public private key "
    "access account server client database mysql postgres redis service system local host internal prod production development staging "
    "summer winter spring autumn monday friday january october december orange purple yellow silver golden computer internet cookie cheese "
    "coffee banana flower sunshine princess iloveyou freedom whatever starwars batman matrix love hello world your here none null true false "
    "insert value string replace placeholder redacted hidden"
).split()
#: Letters of the words that are taken from a tokenizer's rank file, which has the frequent words of running text in order.
LEAST_WORD, LONGEST_WORD = 4, 24


@functools.cache
def word_ranks() -> dict[str, int]:
    """The rank of each known word: COMMON_WORDS, then the words of the rank file."""
    with open(rank_file(), "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        words = [t.strip().lower().decode() for t in tokens if re.fullmatch(rb" ?[A-Za-z]{%d,%d}" % (LEAST_WORD, LONGEST_WORD), t)]
    return {w: k for k, w in enumerate(dict.fromkeys([*COMMON_WORDS, *words]), 1)}


#: Rows of a keyboard and sequences; a walk moves to a neighbour in one of them, either way.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm")
STEPS = {pair for row in ROWS for pair in [*zip(row, row[1:]), *zip(row[1:], row)]}

DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.S)


def char_cost(value: str) -> float:
    """log10 of the size of the classes that the value's characters come from."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return math.log10(16 if re.search("[a-fA-F]", value) else 10)
    size = sum(n for pattern, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[^A-Za-z0-9\x80-\U0010ffff]", 33), (r"[\x80-\U0010ffff]", 100)) if re.search(pattern, value))
    return math.log10(max(10, size))


def _capitals(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and (word[0].isupper() or word[-1].isupper())):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) + 1)


def segments(value: str) -> list[tuple[int, int, float, str]]:
    """(start, end, log10 guesses, kind) of all segments but single brute-force characters."""
    low, out, each, ranks = value.lower(), [], char_cost(value), word_ranks()
    for a in range(len(low)):
        for b in range(a + 3, min(len(low), a + LONGEST_WORD) + 1):
            if (rank := ranks.get(low[a:b])) is not None:
                out.append((a, b, math.log10(rank) + _capitals(value[a:b]), "word"))
    for at in range(len(value)):
        if m := DATE.match(value, at):
            out.append((at, m.end(), math.log10(120 if m.end() - at == 4 else 365 * 120), "date"))
    for m in REPEAT.finditer(value):
        block = len(m[1])
        out.append((m.start(), m.end(), block * each + math.log10(max(1, (m.end() - m.start()) // block)), "repeat"))
    at = 0
    for b in range(1, len(low) + 1):
        if b == len(low) or (low[b - 1], low[b]) not in STEPS:
            if b - at >= 4:
                out.append((at, b, math.log10(47 * 4 * (b - at)), "walk"))
            at = b
    return out


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 guesses of a value, and the segmentation that has it; brute-force characters are joined."""
    each, ending = char_cost(value), {}
    for a, b, cost, kind in segments(value):
        ending.setdefault(b, []).append((a, cost, kind))
    n = len(value)
    # best[i][0]: the last segment is complete; best[i][1]: it is a brute-force span that may go on
    best = [[0.0, math.inf]] + [[math.inf, math.inf] for _ in range(n)]
    came: list[list] = [[None, None] for _ in range(n + 1)]
    for b in range(1, n + 1):
        for a, cost, kind in ending.get(b, ()):
            k = int(best[a][1] < best[a][0])
            total = best[a][k] + cost + (JOINT if a else 0.0)
            if total < best[b][0]:
                best[b][0], came[b][0] = total, (a, k, kind)
        go_on, begin = best[b - 1][1] + each, best[b - 1][0] + each + (JOINT if b > 1 else 0.0)
        best[b][1], came[b][1] = (go_on, (b - 1, 1, "brute")) if go_on <= begin else (begin, (b - 1, 0, "brute"))
    if not n:
        return 0.0, []
    k = int(best[n][1] < best[n][0])
    cost, at, cut = best[n][k], n, []
    while at:
        a, before, kind = came[at][k]
        if cut and kind == "brute" == cut[-1][2] and k == 1 and joined:
            cut[-1] = (a, cut[-1][1], kind)
        else:
            cut.append((a, at, kind))
        joined = kind == "brute" and before == 1
        at, k = a, before
    return cost, cut[::-1]


def context_values(raw: bytes) -> set[tuple[int, int]]:
    """Where the values lie that follow a credential context.

    Contexts within one run of characters share its end. There the first value is taken to the end, each later one up to
    the context after it, so that all are read twice at most. A value that is just the next context gives way to it.
    """
    out, runs = set(), {}
    end = 0
    for m in CONTEXT.finditer(raw):
        if m.end() >= end:
            end = VALUE.match(raw, m.end()).end()
        runs.setdefault(end, []).append((m.start(), m.end()))
    for end, found in runs.items():
        nexts = [*(a for a, _ in found[1:]), end]
        led = [k for k, ((_, b), after) in enumerate(zip(found, nexts)) if b < after]
        if led:
            out.add((found[led[0]][1], end))
            out |= {(found[k][1], nexts[k]) for k in led[1:]}
    return {(a, b) for a, b in out if b - a >= LEAST_VALUE}


def scan(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The spans of the fixed patterns, and those with the method's added, as (kind, start, end) in order."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    base = [("access", m.start(), m.end()) for m in ACCESS.finditer(raw)] if b"AKIA" in raw else []
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(raw)]
    values = set()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(raw):
            if len(m[2]) >= 6:
                base.append(("assign", m.start(), m.end()))
                values.add(m.span(2))
    if any(h in low for h in CONTEXT_HINTS):
        values |= context_values(raw)
    more = [("guess", a, b) for a, b in values if guess_cost(raw[a:b].decode("utf-8", "surrogatepass"))[0] >= threshold]
    if len(raw) != len(text):
        # bytes to code points, going once through the text
        ends = sorted({x for _, a, b in base + more for x in (a, b)})
        points, at, n = {}, 0, 0
        for x in ends:
            n += len(raw[at:x].decode("utf-8", "surrogatepass"))
            points[x], at = n, x
        base, more = ([(k, points[a], points[b]) for k, a, b in spans] for spans in (base, more))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [[], [], []], [], []
        for text in each_text(batch.column(1)):
            base, found = scan(text, threshold)
            for out, kind in zip(counts, KINDS):
                out.append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(found))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
