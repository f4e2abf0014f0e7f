"""Phrases that occur often and hold together, by contiguous pattern growth (PrefixSpan without gaps).

1. Words. Blocks of documents (blocks.py) tell buckets their distinct words with counts; a bucket numbers the words that
   occur often enough in a language and answers each block with its words' numbers. A block then writes its texts as numbers,
   0 where a rare word or the end of a piece breaks every phrase: the sequence database, about half as large as the texts.
2. Projection. An occurrence of a frequent word is a pointer into a block's sequence; the word's projected database is what
   its pointers see, the up to `longest` numbers from there to the next break. It is sent to the word's task, equal
   sights of a block as one with their number.
3. Growth. A task takes one prefix at a time and extends it to the right depth-first: it counts the next number over the
   prefix's pointers, keeps the frequent ones, projects the pointers on each and goes on, and so has each phrase's count and
   those of all its beginnings.
4. Prefixes that occur more often than a task should hold are split: they are counted together with each next word (packed
   partial sums of blocks, by task), and their extensions are prefixes of their own, again and again if need be. A prefix is split above
   `split` occurrences and a 2**20th of all words, so that there are less than 2**20 of any length: what the driver gathers
   and broadcasts of them has that bound at every size. A prefix of `longest` words has no projection and needs no task.
5. Scores. Every phrase has the counts of its beginnings with it; the counts of its ends come by an equality join. The first
   of a language are the first of the firsts of `SALTS` shares, so no task sorts a language.

Words are `[^\\x20\\x09]+` of pieces between `[.,;:!?\\x0A-\\x0D]`, A-Z in lower case; all is by language.

Scale: the texts are exchanged once, in blocks; words, numbers and projected rows are packed arrays, one row for each block and
task. The sequences are a checkpoint, and so are the phrases, some 100th of all words in the worst case.

Defined cases: a null lang is `und` (with rows of that name); null and empty texts have no words; each row counts, also where
a doc_id is repeated or null; equal scores and counts go by the phrase's UTF-8 bytes; a language without a candidate gives no
rows; very long texts are cut into words one at a time, beside a block's other few MB; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.blocks import block_of, bounds, partitions, regroup, sizes
from skeinwork.llm.common import LOWER, UPPER, checkpointed, map_arrow, trimmed, utf8

LEAST, LONGEST, FIRST = 100, 5, 2000
SPLIT, MOST_SPLIT, TASK_ROWS, SALTS = 1 << 19, 1 << 20, 1 << 19, 16
#: Bytes: what ends a word (1) and what ends a piece, too (2); A-Z become small.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
MESSAGE = "kind string, block int, bucket int, lang string, payload binary, words array<string>"
_MESSAGE = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("bucket", pa.int32()), ("lang", pa.string()), ("payload", pa.binary()), ("words", pa.list_(pa.string()))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_MESSAGE), _MESSAGE, strict=True)], schema=_MESSAGE)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and whether the next one isn't in the same piece."""
    data, offs = utf8(texts)
    kind = np.zeros(len(data) + len(offs) - 1, np.uint8)  # one more byte behind each text, which ends its piece
    place = np.arange(len(data)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    kind[place] = KIND[data]
    kind[offs[1:] + np.arange(len(offs) - 1)] = 2
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.string()), np.empty(0, bool)
    within = np.cumsum(inside)
    size = np.diff(np.append(within[starts] - 1, within[-1]))
    body = SMALL[data[inside[place]]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(body)])
    breaks = np.cumsum(kind == 2)[starts]
    last = np.ones(len(starts), bool)
    last[:-1] = breaks[1:] != breaks[:-1]
    return words, last


class Vocabulary:
    """A block's words of one language: the distinct ones in the order in which buckets are told of them."""

    def __init__(self, lang: str, texts: pa.Array, n_buckets: int):
        words, self.last = words_of(texts)
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        bucket = np.array([xxhash.xxh3_64_intdigest(w.encode(), salt) % n_buckets for w in distinct.to_pylist()], np.int64)
        by_word = pc.sort_indices(distinct).to_numpy().astype(np.int64)
        order = by_word[np.argsort(bucket[by_word], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.lang, self.words, self.bucket = lang, distinct.take(pa.array(order)), bucket[order]
        self.codes = rank[codes] if len(codes) else np.empty(0, np.int64)
        self.counts = np.bincount(self.codes, minlength=len(order))


def vocabularies(table: pa.Table, n_buckets: int) -> Iterator[Vocabulary]:
    langs = table.column("lang")
    for lang in sorted(set(langs.to_pylist())):
        texts = table.filter(pc.equal(langs, lang)).column("text")
        yield Vocabulary(lang, texts.cast(pa.large_string()).combine_chunks(), n_buckets)


def tell_words(table: pa.Table, n_buckets: int) -> pa.Table:
    rows, block = [], table.column("block")[0].as_py()
    for v in vocabularies(table, n_buckets):
        rows += [("told", block, b, v.lang, v.counts[x:y].astype(np.int64).tobytes(), v.words.slice(x, y - x).to_pylist()) for b, x, y in bounds(v.bucket)]
    return _table(rows)


def number_words(least: int, n_buckets: int):
    """In a bucket: numbers of the frequent words, to every block that told of them ('numbers', 0 for the others); the words
    themselves ('words', with numbers and counts); and all occurrences by language ('all')."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, given = table.column("bucket")[0].as_py(), 1
        langs = table.column("lang")
        for lang in sorted(set(langs.to_pylist())):
            own = table.filter(pc.equal(langs, lang))
            counts = np.concatenate([np.frombuffer(x, np.int64) for x in own.column("payload").to_pylist()])
            told = own.column("words").combine_chunks()
            coded = told.flatten().dictionary_encode()
            of = coded.indices.to_numpy()
            total = np.bincount(of, counts, len(coded.dictionary)).astype(np.int64)
            frequent = np.flatnonzero(total >= least)
            frequent = frequent[np.argsort(-total[frequent], kind="stable")]
            # shuffles come in any order: numbers go by count and word, so that each run of the task gives the same
            names = coded.dictionary.take(pa.array(frequent))
            by = np.lexsort((np.argsort(pc.sort_indices(names).to_numpy()), -total[frequent])) if len(frequent) else frequent
            frequent, names = frequent[by], names.take(pa.array(by))
            number = np.zeros(len(total), np.int64)
            number[frequent] = (given + np.arange(len(frequent))) * n_buckets + bucket
            given += len(frequent)
            sizes_ = pc.list_value_length(told).to_numpy()
            ends = np.cumsum(sizes_)
            rows = [("numbers", block, bucket, lang, number[of[e - s : e]].tobytes(), None) for block, s, e in zip(own.column("block").to_pylist(), sizes_, ends, strict=True)]
            if len(frequent):
                rows.append(("words", None, bucket, lang, np.concatenate((number[frequent], total[frequent])).tobytes(), names.to_pylist()))
            rows.append(("all", None, bucket, lang, np.int64(counts.sum()).tobytes(), None))
            yield from _table(rows).to_batches()

    return then


def sequences(table: pa.Table, answers: pa.Table, n_buckets: int) -> pa.Table:
    """A block's texts as numbers, 0 at rare words and behind each piece."""
    if not len(table):
        return _table([])
    given = {(r["lang"], r["bucket"]): r["payload"] for r in answers.select(["lang", "bucket", "payload"]).to_pylist()}
    whole = []
    for v in vocabularies(table, n_buckets):
        number = np.empty(len(v.words), np.int64)
        for b, x, y in bounds(v.bucket):
            number[x:y] = np.frombuffer(given[v.lang, b], np.int64)
        ids = number[v.codes]
        whole += [np.insert(ids, np.flatnonzero(v.last) + 1, 0)]
    ids = np.concatenate(whole) if whole else np.empty(0, np.int64)
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0  # one 0 between runs is enough
    return _table([("sequence", table.column("block")[0].as_py(), None, None, pack(ids[keep]), None)])


def pack(ids: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs: high bytes, mostly equal, compress well."""
    planes = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = blob[0]
    body = np.frombuffer(blob, np.uint8, -1, 1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :planes] = body.T
    return out.view("<u8").ravel().astype(np.int64)


def sights(ids: np.ndarray, longest: int) -> np.ndarray:
    """Of each pointer to a number, the `longest` numbers from there, 0 behind the next break."""
    at = np.flatnonzero(ids)
    padded = np.append(ids, np.zeros(longest, np.int64))
    seen = np.empty((len(at), longest), np.int64)
    open_ = np.ones(len(at), bool)
    for k in range(longest):
        seen[:, k] = np.where(open_, padded[at + k], 0)
        open_ &= seen[:, k] != 0
    return seen


def distinct_rows(seen: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in order, and how often each occurs."""
    if not len(seen):
        return seen, np.empty(0, np.int64)
    order = np.lexsort(seen.T[::-1])
    rows = seen[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(1)
    begin = np.flatnonzero(first)
    counts = np.diff(np.append(begin, len(rows))) if weight is None else np.add.reduceat(weight[order], begin)
    return rows[begin], counts


class Prefixes:
    """Prefixes that are split, of one length; less than MOST_SPLIT. A place among them is found by the place of the beginning
    among those one shorter, and the last number, in one sorted array of both (numbers stay below 2**43: they grow with the
    frequent words)."""

    def __init__(self, rows: list[tuple[list[int], int]], shorter: Prefixes | None):
        self.shorter, self.length = shorter, shorter.length + 1 if shorter else 1
        ids = np.array([r for r, _ in rows], np.int64).reshape(-1, self.length)
        keys = self._keys(shorter.places(ids) if shorter else np.zeros(len(ids), np.int64), ids[:, -1])
        order = np.argsort(keys)
        self.keys, self.ids, self.counts = keys[order], ids[order], np.array([c for _, c in rows], np.int64)[order]

    @staticmethod
    def _keys(begin: np.ndarray, last: np.ndarray) -> np.ndarray:
        return begin << 43 | last

    def among(self, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of a prefix, -1 if it isn't one of these; begin: the place of what it is without its last number."""
        keys = self._keys(begin, last)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def places(self, seen: np.ndarray) -> np.ndarray:
        """By row the place of the prefix it begins with, -1 for none."""
        begin = self.shorter.places(seen) if self.shorter else np.zeros(len(seen), np.int64)
        return np.where(begin >= 0, self.among(np.maximum(begin, 0), seen[:, self.length - 1]), -1)


def frontier(seen: np.ndarray, split: list[Prefixes]) -> np.ndarray:
    """How many words the prefix has whose task a row belongs to: one more than the longest split prefix it begins with."""
    length, place, at = np.ones(len(seen), np.int64), np.zeros(len(seen), np.int64), np.arange(len(seen))
    for p in split:
        found = p.among(place[at], seen[at, p.length - 1])
        at = at[found >= 0]
        place[at] = found[found >= 0]
        length[at] += 1
    return length


PROJECTED = "task int, payload binary"


def _dealt(seen: np.ndarray, counts: np.ndarray, length: np.ndarray, n_tasks: int) -> pa.RecordBatch:
    """Distinct rows and their numbers, packed for the task of each row's first `length` words."""
    key = np.zeros(len(seen), np.uint64)
    for k in range(seen.shape[1]):
        with np.errstate(over="ignore"):
            key = np.where(length > k, (key ^ seen[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), key)
            key ^= key >> np.uint64(29)
    task = (key % np.uint64(n_tasks)).astype(np.int64)
    by = np.argsort(task, kind="stable")
    rows = [(t, _pack_rows(seen[by[x:y]], counts[by[x:y]])) for t, x, y in bounds(task[by])]
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["task", "payload"])


def extensions(split: list[Prefixes], n_tasks: int):
    """Each block's counts of the prefixes one longer than the last split ones, by task."""
    length = split[-1].length + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("payload").to_pylist():
                seen = sights(unpack(blob), length)
                own, counts = distinct_rows(seen[(frontier(seen, split) == length) & (seen[:, -1] != 0)])
                yield _dealt(own, counts, np.full(len(own), length), n_tasks)

    return walk


def longer(length: int, above: int):
    """In a task: those prefixes that occur more than `above` times in all."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [_unpack_rows(x.as_py(), length) for x in table.column("payload")]
        rows, counts = distinct_rows(np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts]))
        at = np.flatnonzero(counts > above)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows[at]), pa.list_(pa.int64())), pa.array(counts[at].astype(np.int64))], names=["ids", "a"])

    return then


def project(longest: int, n_tasks: int, split: list[Prefixes]):
    """Each block's projected databases, by task: distinct sights and their numbers."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("payload").to_pylist():
                seen, counts = distinct_rows(sights(unpack(blob), longest))
                length = frontier(seen, split)
                whole = (length <= longest) & (np.take_along_axis(seen, np.minimum(length, longest)[:, None] - 1, 1)[:, 0] != 0)
                yield _dealt(seen[whole], counts[whole], length[whole], n_tasks)

    return walk


def _pack_rows(seen: np.ndarray, counts: np.ndarray) -> bytes:
    parts = [pack(counts), *(pack(c[c != 0]) for c in seen.T), pack((seen != 0).sum(1))]
    return b"".join(np.int64(len(x)).tobytes() + x for x in parts)


def _unpack_rows(blob: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(blob):
        n = int(np.frombuffer(blob, np.int64, 1, at)[0])
        parts.append(unpack(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    counts, *columns, size = parts
    seen = np.zeros((len(counts), longest), np.int64)
    for k, c in enumerate(columns):
        seen[size > k, k] = c
    return seen, counts


PHRASES = "ids array<long>, a long, begins array<long>"


def grow(least: int, longest: int, split: list[Prefixes]):
    """In a task: all frequent phrases of two words and more that begin with its prefixes."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [_unpack_rows(x.as_py(), longest) for x in table.column("payload")]
        seen, weight = np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts])
        del table, parts
        found: list[tuple[list[int], int, list[int]]] = []

        def extend(prefix: list[int], begins: list[int], rows: np.ndarray) -> None:
            """rows: the pointers of the prefix; begins: counts of its own beginnings and its own."""
            if len(prefix) == longest:
                return
            following = seen[rows, len(prefix)]
            rows = rows[following != 0]
            for value, own in _runs(seen[rows, len(prefix)], rows):
                a = int(weight[own].sum())
                if a >= least:
                    found.append(([*prefix, value], a, begins))
                    extend([*prefix, value], [*begins, a], own)

        length = frontier(seen, split)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            for prefix, own in _prefixes(seen[:, :n], at):
                begins = _begins(prefix, split[: n - 1])
                a = int(weight[own].sum())
                if a >= least:
                    if n > 1:
                        found.append((prefix, a, begins))
                    extend(prefix, [*begins, a], own)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["ids", "a", "begins"])

    return then


def _begins(prefix: list[int], split: list[Prefixes]) -> list[int]:
    """Counts of the prefix's beginnings, which are all split."""
    return [int(p.counts[p.places(np.array([prefix]))[0]]) for p in split]


def _runs(values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    for value, x, y in bounds(values):
        yield value, rows[x:y]


def _prefixes(seen: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    order = at[np.lexsort(seen[at].T[::-1])]
    rows = seen[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(1)
    begin = np.flatnonzero(first)
    for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True):
        yield rows[x].tolist(), order[x:y]


class Mined:
    """What mine() finds: words (lang, word, id, a), phrases (PHRASES, of two words and more), totals (lang, n)."""

    def __init__(self, words: DataFrame, phrases: DataFrame, totals: DataFrame):
        self.words, self.phrases, self.totals = words, phrases, totals


def mine(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, split: int = SPLIT, task_rows: int = TASK_ROWS) -> Mined:
    """All phrases of up to `longest` words that occur `least` times in a language."""
    n_blocks = sizes(documents)
    n = partitions(n_blocks)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select(block_of(F.col("doc_id"), F.col("text"), n_blocks).alias("block"), "lang", "text").repartition(n, "block")
    tell, encode = trimmed(lambda table: tell_words(table, n)), trimmed(lambda table, numbers: sequences(table, numbers, n))
    told = texts.groupBy("block").applyInArrow(tell, MESSAGE)
    answered = regroup(told, "bucket", n, number_words(least, n), MESSAGE).repartition(n, "block", "bucket")
    numbers = answered.where("kind = 'numbers'").repartition(n, "block")
    encoded = texts.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(encode, MESSAGE)
    held = checkpointed(encoded.unionByName(answered.where("kind in ('words', 'all')")))
    words = map_arrow(held.where("kind = 'words'").select("lang", "payload", "words"), _word_rows, "lang string, word string, id long, a long")
    totals = map_arrow(held.where("kind = 'all'").select("lang", "payload"), _total_rows, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    occurrences = int(totals.agg(F.sum("n")).first()[0] or 0)
    blocks = held.where("kind = 'sequence'").select("payload")
    n_tasks = max(min(n, 8), occurrences // task_rows)
    above = max(split, least, occurrences // MOST_SPLIT)
    over: list[Prefixes] = []
    long_prefixes = words.where(F.col("a") > above).select(F.array("id").alias("ids"), "a")
    while len(over) < longest - 1:
        found = [(r["ids"], r["a"]) for r in long_prefixes.collect()]  # less than MOST_SPLIT, as `above` has it
        if not found:
            break
        over.append(Prefixes(found, over[-1] if over else None))
        counted = map_arrow(blocks, extensions(over, n_tasks), PROJECTED)
        long_prefixes = regroup(counted, "task", n_tasks, longer(len(over) + 1, above), "ids array<long>, a long")
    projected = map_arrow(blocks, project(longest, n_tasks, over), PROJECTED)
    grown = regroup(projected, "task", n_tasks, grow(least, longest, over), PHRASES)
    spark = documents.sparkSession
    split_phrases = [(ids, a, _begins(ids, over[: p.length - 1])) for p in over[1:] for ids, a in zip(p.ids.tolist(), p.counts.tolist(), strict=True)]
    return Mined(words, checkpointed(grown.unionByName(spark.createDataFrame(split_phrases, PHRASES))), totals)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, blob, words in zip(*(b.column(c).to_pylist() for c in ("lang", "payload", "words")), strict=True):
            number, count = np.frombuffer(blob, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(number), pa.array(count)], names=["lang", "word", "id", "a"])


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int(np.frombuffer(x, np.int64)[0]) for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(n, pa.int64())], names=["lang", "n"])


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, split: int = SPLIT, task_rows: int = TASK_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then count, then bytes."""
    mined = mine(documents, least, longest, split, task_rows)
    whole = mined.phrases
    counts = whole.select("ids", "a").unionByName(mined.words.select(F.array("id").alias("ids"), "a")).withColumnsRenamed({"ids": "end_ids", "a": "r"})
    size = F.size("ids")
    cuts = whole.select("ids", "a", F.posexplode("begins").alias("at", "l")).withColumn("k", F.col("at") + 1)
    cuts = cuts.withColumn("end_ids", F.slice("ids", F.col("k") + 1, size - F.col("k"))).join(counts, "end_ids")
    lost_begin = cuts.where((size > 2) & (F.col("k") == size - 1) & (F.col("l") == F.col("a"))).select(F.slice("ids", 1, size - 1).alias("ids"))
    lost_end = cuts.where((size > 2) & (F.col("k") == 1) & (F.col("r") == F.col("a"))).select(F.col("end_ids").alias("ids"))
    lost = lost_begin.unionByName(lost_end).distinct()
    # the language of a phrase is that of its words
    langs = mined.words.select(F.col("id").alias("first_id"), "lang")
    totals = mined.totals  # a row per language
    cuts = cuts.withColumn("first_id", F.col("ids")[0]).join(langs, "first_id").join(totals, "lang")
    score = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score)
    best = scored.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "lang", "n", "a")).alias("b")).select("ids", "b.*").join(lost, "ids", "left_anti")
    named = best.select("ids", F.posexplode("ids").alias("place", "id")).join(mined.words.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(named, "ids").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc(F.col("phrase").cast("binary"))]
    share = ranked.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= first)
    top = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


digest = collocations

ORACLE_SQL = f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, w[i : i + m - 1] AS p
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
f AS (SELECT lang, m, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.m, c.p, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k]
  JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m]
  JOIN totals t ON t.lang = c.lang),
lost AS (
  SELECT lang, p[1 : m - 1] AS p FROM cuts WHERE m > 2 AND k = m - 1 AND l = a
  UNION SELECT lang, p[2 : m] FROM cuts WHERE m > 2 AND k = 1 AND r = a),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, a, l, r, n, score, array_to_string(p, ' ') AS phrase FROM best ANTI JOIN lost USING (lang, p))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM ranked)
WHERE rank <= {FIRST}
"""
