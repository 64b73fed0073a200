"""Byte-level BPE by corpus-level merge replay.

Each task takes its texts in blocks of about BLOCK_CHARS characters as a corpus. It splits them into pieces, gathers the pieces not
yet known, and replays the merges over all of these at once: an inverted index from token pair to positions is
worked off in rank order, and a merge updates the index only at the neighbours it touches. The cost of a merge
is shared by all pieces that hold the pair, and each distinct piece is encoded once however often it occurs.

A vocabulary may hold tokens whose parts rank later than themselves. A pair that such a token forms may appear
after its rank has passed; a piece in which that happens is encoded anew, one lowest merge at a time, which is
what the tiktoken library does for every piece. So the ids are equal to that library's for any rank file.

Defined are: null and empty texts have no ids and decode to nothing; lone pieces of any length cost n log n, so very long
texts are encoded whole; of pairs with the same rank, which only equal tokens have, the leftmost merges first; repeated
rows get equal ids, null doc_ids are kept; an empty table gives an empty result; other columns stay out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from braidpath.llm.common import each_text, map_arrow

#: Distinct pieces that a Python worker remembers between batches, and the longest such piece in characters.
KNOWN_PIECES, KNOWN_LENGTH = 200_000, 64
#: Characters of text whose new pieces share one replay, but for the last text, which comes whole.
BLOCK_CHARS = 1_000_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point by the split pattern's \\p{L}, \\p{N} and \\s."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out


def split_pieces(text: str) -> list[str]:
    """The matches of the public split pattern, found with array operations rather than a regex.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    # the last space of a run goes with what follows: as its head if it is U+0020, else as a piece of its own
    before = starts[(starts > 0) & (kind[starts] != SPACE)]
    before = before[kind[before - 1] == SPACE] - 1
    joined = before[points[before] == 0x20]
    keep = np.zeros(len(points) + 1, bool)
    keep[starts] = True
    keep[before] = True
    keep[joined + 1] = False
    # contractions: an apostrophe that begins a piece and stands alone before letters
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        for q in quotes[keep[quotes]].tolist():
            tail = text[q + 1 : q + 3]
            n = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if n:
                keep[q + 1] = False
                end = q + 1 + n
                if end < len(points) and kind[end] == LETTER:
                    keep[end] = True
    cuts = np.flatnonzero(keep[: len(points)]).tolist()
    cuts.append(len(points))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class Ranks:
    """A rank file: token bytes by id, and the id that each pair of ids merges to."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: by the left id: what a right id merges with it to; the last, empty, stands for the gap between pieces
        self.pairs: list[dict[int, int]] = [{} for _ in range(len(self.tokens) + 1)]
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a][b] = i
        self.byte_pairs = np.full((257, 257), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.pairs[self.byte_ids[a]].get(self.byte_ids[b], -1)

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, by one replay of the merges over all pieces."""
        whole, pairs = self.ids.get, self.pairs
        out: list[list[int]] = [[] if (i := whole(p)) is None else [i] for p in pieces]
        open_ = [k for k, ids in enumerate(out) if not ids and pieces[k]]
        if not open_:
            return out
        # all symbols in one list, -1 between pieces; links to the symbols left and right
        sizes = np.fromiter((len(pieces[k]) for k in open_), np.int64, len(open_))
        first = 1 + np.r_[0, np.cumsum(sizes[:-1] + 1)]
        n = int(first[-1] + sizes[-1] + 1)
        raw = np.full(n, 256, np.int64)
        gaps = np.zeros(n, bool)
        gaps[first - 1] = gaps[-1] = True
        raw[~gaps] = np.frombuffer(b"".join([pieces[k] for k in open_]), np.uint8)
        symbols: list[int] = np.array([*self.byte_ids, -1])[raw].tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # the inverted index: by rank of the pair, the positions of its left symbols
        ranks = self.byte_pairs[raw[:-1], raw[1:]]
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        found, begin = np.unique(ranks[places], return_index=True)
        index: dict[int, list[int]] = {int(r): p.tolist() for r, p in zip(found, np.split(places, begin[1:]))}
        queue = list(index)
        late: list[int] = []
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            places.sort()
            follows = pairs[rank]
            for at in places:
                to = right[at]
                if pairs[symbols[at]].get(symbols[to]) != rank:
                    continue
                symbols[at], symbols[to] = rank, -1
                right[at] = after = right[to]
                left[after] = at
                before = left[at]
                if (new := pairs[symbols[before]].get(rank)) is not None:
                    if new in index:
                        index[new].append(before)
                    else:
                        index[new] = [before]
                        heapq.heappush(queue, new)
                    if new <= rank:
                        late.append(at)
                if (new := follows.get(symbols[after])) is not None:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(queue, new)
                    if new <= rank:
                        late.append(at)
        done = np.array(symbols)
        kept = np.flatnonzero(done >= 0)
        cuts = np.searchsorted(kept, first).tolist()
        cuts.append(len(kept))
        flat = done[kept].tolist()
        for k, a, b in zip(open_, cuts, cuts[1:]):
            out[k] = flat[a:b]
        for j in set((np.searchsorted(first, late, side="right") - 1).tolist()):
            out[open_[j]] = self.one_by_one(pieces[open_[j]])
        return out

    def one_by_one(self, piece: bytes) -> list[int]:
        """Always the lowest rank next, of equal ones the leftmost."""
        symbols = [self.byte_ids[b] for b in piece]
        n, pairs = len(symbols), self.pairs
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, at) for at in range(n - 1) if (r := pairs[symbols[at]].get(symbols[at + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            to = right[at]
            if to >= n or pairs[symbols[at]].get(symbols[to]) != rank:
                continue
            symbols[at], symbols[to] = rank, -1
            right[at] = after = right[to]
            if after < n:
                left[after] = at
                if (r := pairs[rank].get(symbols[after])) is not None:
                    heapq.heappush(queue, (r, at))
            if (before := left[at]) >= 0 and (r := pairs[symbols[before]].get(rank)) is not None:
                heapq.heappush(queue, (r, before))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes the texts of a batch; keeps a bounded number of encoded pieces for the next one."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.known, self.older = ranks, {}, {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return list(self.encode_each(texts))

    def encode_each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers; texts are taken a block at a time."""
        part: list[list[str]] = []
        held = 0
        for text in texts:
            part.append(split_pieces(text))
            held += len(text)
            if held > BLOCK_CHARS:
                yield from self._part(part)
                part, held = [], 0
        yield from self._part(part)

    def _part(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {piece for pieces in texts for piece in pieces if piece not in known}
        # what is met again stays; the rest of the older half goes when the newer is full
        again = new & older.keys()
        known.update((piece, older[piece]) for piece in again)
        new = list(new - again)
        here = dict(zip(new, (array("I", ids).tobytes() for ids in self.ranks.replay([p.encode("utf-8", "surrogatepass") for p in new]))))
        known.update(here)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for piece in here:
            if len(piece) > KNOWN_LENGTH:
                del known[piece]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each rank file and Python worker."""
    return Encoder(Ranks(path))


def rank_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The place of a rank file: in ``folder`` if given, else where the installed tokenizer package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a document: its id, n_tokens, the digest of its ids, the digest of what they decode to, and the ids.

    ``path`` is the rank file on every executor. The digests are lowercase hex SHA-256: of the ids as
    little-endian unsigned 32-bit integers, and of the decoded bytes.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        counts, ids_hex, text_hex, ids_out = [], [], [], []
        for ids in own.encode_each(each_text(batch.column(1))):
            own_ids = np.frombuffer(ids, "<u4")
            counts.append(len(own_ids))
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(own.ranks.decode(own_ids)).hexdigest())
            if with_ids:
                ids_out.append(own_ids.astype(np.int32))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(id_col, text_col), run, schema)


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of ``tokens``: its id and the bytes its ids stand for; null ids are empty."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = encoder(path).ranks
        decoded = [ranks.decode(np.array(ids.as_py() or [], np.int64)) for ids in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=[id_col, "bytes"])

    return map_arrow(tokens.select(id_col, ids_col), run, f"`{id_col}` {id_type}, bytes binary")
