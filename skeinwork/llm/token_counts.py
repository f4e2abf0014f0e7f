"""Token counts of texts under a unigram model over a public vocabulary, by dynamic programming shared in a trie.

Texts are cut into pre-tokens: runs of bytes that aren't ASCII white space, with one space directly before, and what white
space is left between them. A pre-token's tokens are its best-scored segmentation into pieces of the vocabulary, a piece
of rank r (0 first) scoring -ln(r + 2), the rank-frequency law, in whole millionths so that sums and ties are exact; ties
go to fewer tokens. Each byte is a piece, so every text has a segmentation.

The distinct pre-tokens of a slice that aren't known yet are cut at places that no piece spans: every segmentation has a
token's end there, so scores and counts add up over the parts. That leaves short parts even of texts without spaces. The
distinct parts go into a trie. The forward score of a trie node is the best over the pieces that end there, each found by
walking the reversed vocabulary back from the node, of the score at the piece's start plus the piece's: once for each node,
however many parts share that prefix, and a whole depth of the trie at a time. The counts at terminal nodes are kept in a
bounded table for the slices to come. Parts of more than `DEEPEST` bytes (long runs of one mark, say) share no prefixes worth
a trie; the same recurrence runs over their pieces alone, which are found in array operations.

Defined cases: null and empty texts have 0 of everything; repeated rows are counted each; columns named n_bytes, n_pretokens
or n_tokens are replaced, all others stay as they are; very long texts are counted in pieces of whole pre-tokens; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import SLICE_BYTES, map_arrow, own_name, slices, utf8
from skeinwork.llm.segments import distinct

MOST_KNOWN, DEEPEST, TRIE_CELLS, WINDOW = 500_000, 64, 4 << 20, 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def piece_score(rank: int) -> int:
    return -round(1e6 * math.log(rank + 2))


def pretoken_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    if n > 1:
        space = _SPACE[data]
        cut[1:n] |= ~space[:-1] & space[1:]
        cut[1:n] |= space[:-1] & ~space[1:] & (data[:-1] != 32)
        attached = (data[:-1] == 32) & ~space[1:]
        ends = offs[1:]
        attached[ends[(ends > 0) & (ends < n)] - 1] = False  # a text's last space doesn't go with the next text
        cut[: n - 1] |= attached
    return np.flatnonzero(cut[:n])


class UnigramCounter:
    """Counts of tokens of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_KNOWN):
        self.scores = {p: piece_score(r) for p, r in ranks.items()}
        self.longest = max(map(len, self.scores))
        self.most, self.known = most, {}
        # the reversed vocabulary as sorted edges (state, byte) -> state, and each state's score if a piece ends there
        states, edges, ends = {b"": 0}, [], {}
        for p, s in self.scores.items():
            state = 0
            for k in range(1, len(p) + 1):
                suffix = p[-k:]
                at = states.get(suffix)
                if at is None:
                    at = states[suffix] = len(states)
                    edges.append((state << 8 | suffix[0], at))
                state = at
            ends[state] = s
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int32)
        self.ends = np.full(len(states), 1, np.int64)  # scores are negative; 1 is no piece
        self.ends[list(ends)] = list(ends.values())
        # the first two steps back by plain tables
        self.first = np.zeros(256, np.int32)
        for e, t in edges:
            if e >> 8 == 0:
                self.first[e & 255] = t

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.to[at], 0)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces of the vocabulary in tokens that lie one after another: by length, the places of their last bytes and
        their scores."""
        place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
        open_, state = np.arange(len(data)), self.first[data]
        for back in range(1, self.longest + 1):
            alive = state > 0
            open_, state = open_[alive], state[alive]
            score = self.ends[state]
            yield back, open_[score <= 0], score[score <= 0]
            more = place[open_] >= back
            open_, state = open_[more], state[more]
            if not len(open_):
                break
            state = self._step(state, data[open_ - back])

    def _parts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the parts of tokens: places that no piece spans."""
        start = np.arange(len(data))  # of the longest piece that ends with each byte
        for back, last, _ in self._pieces(data, offs):
            start[last] = last - back + 1
        before = np.minimum.accumulate(start[::-1])[::-1]  # of all that end with it or behind it
        return np.flatnonzero(before >= np.arange(len(data)))

    def _forward(self, token: bytes) -> int:
        """The recurrence over a token's pieces, piece by piece in the order of their ends."""
        data = np.frombuffer(token, np.uint8)
        best, count, top, end = [0], [0], None, 0
        for x in range(0, len(data), WINDOW):
            a = max(0, x - self.longest)
            found = [(np.full(len(last), back), last + a, score) for back, last, score in self._pieces(data[a : x + WINDOW], np.array([0, len(data[a : x + WINDOW])]))]
            back, last, score = (np.concatenate(c) for c in zip(*found, strict=True))
            new = last >= x
            order = np.argsort(last[new], kind="stable")
            for b, e, s in zip(*(c[new][order].tolist() for c in (back, last, score)), strict=True):
                if e != end:
                    best.append(top[0])
                    count.append(-top[1])
                    top, end = None, e
                at = e + 1 - b
                value = best[at] + s, -count[at] - 1
                if top is None or value > top:
                    top = value
        return -top[1]

    def _by_trie(self, tokens: list[bytes]) -> np.ndarray:
        """tokens: sorted, distinct, not empty."""
        n, size = len(tokens), np.array([len(t) for t in tokens])
        width = int(size.max())
        cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        # a token makes a new node at each depth beyond what it shares with the one before
        new = inside.copy()
        new[1:] &= ~np.logical_and.accumulate((cells[1:] == cells[:-1]) & inside[1:] & inside[:-1], axis=1)
        number = np.cumsum(new.ravel()).reshape(n, width)
        node = np.zeros((n, width + 1), np.int32)  # depth 0 is the root, node 0
        node[:, 1:] = np.maximum.accumulate(np.where(new, number, 0), axis=0)
        best, count = np.zeros(int(number[-1, -1]) + 1, np.int64), np.zeros(int(number[-1, -1]) + 1, np.int32)
        for d in range(1, width + 1):
            row = np.flatnonzero(new[:, d - 1])
            if not len(row):
                continue
            own = node[row, d]
            score, tokens_ = np.full(len(row), np.iinfo(np.int64).min), np.zeros(len(row), np.int32)
            open_, state = np.arange(len(row)), None
            for back in range(1, min(d, self.longest) + 1):
                byte = cells[row[open_], d - back]
                state = self.first[byte] if state is None else self._step(state, byte)
                alive = state > 0
                open_, state = open_[alive], state[alive]
                if not len(open_):
                    break
                piece = self.ends[state]
                end = np.flatnonzero(piece <= 0)
                at, start = open_[end], node[row[open_[end]], d - back]
                s, c = best[start] + piece[end], count[start] + 1
                better = (s > score[at]) | (s == score[at]) & (c < tokens_[at])
                score[at[better]], tokens_[at[better]] = s[better], c[better]
            best[own], count[own] = score, tokens_
        return count[node[np.arange(n), size]]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = tokens
        if new:
            data, size = np.frombuffer(b"".join(new), np.uint8), np.array([len(t) for t in new])
            offs = np.concatenate(([0], np.cumsum(size)))
            starts = self._parts(data, offs)
            parts, of = distinct(data, starts, np.diff(starts, append=len(data)))
            count = np.empty(len(parts), np.int64)
            width = np.array([len(p) for p in parts])
            short = np.flatnonzero(width <= DEEPEST).tolist()
            short.sort(key=lambda k: parts[k])
            step = max(1, TRIE_CELLS // DEEPEST)
            for k in range(0, len(short), step):
                count[short[k : k + step]] = self._by_trie([parts[p] for p in short[k : k + step]])
            for k in np.flatnonzero(width > DEEPEST).tolist():
                count[k] = self._forward(parts[k])
            total = np.add.reduceat(count[of], np.searchsorted(starts, offs[:-1]))
            self.known.update(zip(new, total.tolist(), strict=True))
        return np.array([self.known[t] for t in tokens], np.int64)

    def texts(self, data: np.ndarray, offs: np.ndarray, most: int = 2 * SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text of a slice."""
        n = len(offs) - 1
        starts = pretoken_starts(data, offs)
        if n == 1 and len(data) > most:  # one very long text, in runs of whole pre-tokens
            ends = [*np.unique(starts[np.searchsorted(starts, np.arange(most, len(data), most), "right") - 1]).tolist(), len(data)]
            ends = [e for e in ends if e]
            found = []
            for a, b in zip([0, *ends], ends):
                own = starts[(starts >= a) & (starts < b)]
                tokens, of = distinct(data[a:b], own - a, np.diff(own, append=b))
                found.append((len(own), int(self.counts(tokens)[of].sum())))
            return tuple(np.array([sum(x)]) for x in zip(*found, strict=True))
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        tokens, of = distinct(data, starts, np.diff(starts, append=len(data)))
        text = np.searchsorted(offs, starts, "right") - 1
        return np.bincount(text, minlength=n), np.bincount(text, self.counts(tokens)[of], minlength=n).astype(np.int64)


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(read_ranks(path))
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Adds n_bytes, n_pretokens and n_tokens to the rows of `documents`, without its text."""
    body = own_name(documents, "body")
    rest = documents.drop("n_bytes", "n_pretokens", "n_tokens")
    names = [c for c in rest.columns if c != "text"]
    kept = rest.select(*(F.col(f"`{c}`") for c in names), F.coalesce("text", F.lit("")).alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text"), "n_bytes long, n_pretokens long, n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for b in batches:
            data, offs = utf8(b.column(body))
            found = [counter.texts(part, o) for _, _, part, o in slices(data, offs)]
            pre, tok = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.diff(offs)), pa.array(pre), pa.array(tok)], names=[*names, "n_bytes", "n_pretokens", "n_tokens"])

    return map_arrow(kept, count, schema)


def digest(documents: DataFrame, vocabulary: str) -> DataFrame:
    return count_tokens(documents.select("doc_id", "text"), vocabulary)
