"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes up to `order` bytes deep. A symbol is coded in the longest context that the
language has seen: with its count if it followed there, and else with an escape and then the next shorter context, down to
a uniform byte. Escapes are method C: d / (n + d) for d distinct successors among n. Statistics are frozen after training,
so the code length of a text in bits is a sum of terms that depend on its byte and the `order` bytes before it, exactly.

The trees of up to `together` languages are united into one, whose nodes hold each of these languages' finished code length of
their last byte and escape cost, and their children in rows that lie over each other in one array. A text walks a united tree
once, by table lookups on whole slices of texts, for all its languages. The shortest code of all trees wins; its share of
exp(-length) among the languages is the score.

Training reads at most about `rows_per_language` labelled documents of each language (documented bound; chosen by a hash
of doc_id over the whole table). The counts of one tree at a time go to the driver: they are bounded by that sample. Trees are
files that a machine gets once and its workers map, so there is no limit to the number of languages.

Defined cases: a null text or one without a letter is `und` with score 0; rows with null labels teach nothing; without
labelled rows everything is `und`; repeated rows are scored each; very long texts are coded in pieces that
see the bytes before them; an empty table gives no rows; columns of the result's names are replaced, all others stay; ties go
to the smaller language name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed, filesystem, fresh_dir, map_arrow, own_name, slices, utf8

ORDER, ROWS_PER_LANGUAGE, MOST_BROADCAST, PIECE = 4, 300, 200_000, 1 << 20
TOGETHER = 8  # languages of one tree
UNKNOWN = "und"
COUNTS = "lang string, depth int, gram long, n long"


def training_rows(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """About as many rows of each language as the bound, chosen by hash; all if there are fewer.

    Sizes and choice are over all rows, but of doc_id and lang alone. The chosen ids are broadcast to the texts while they
    are few (`MOST_BROADCAST`, by count); with very many languages they join by a shuffle."""
    named = labelled.select("doc_id", "lang")
    sizes = checkpointed(named.groupBy("lang").agg(F.count("*").alias("rows")))
    if sizes.count() <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)  # a row per language
    share = sizes.select("lang", (F.lit(rows_per_language) / F.col("rows")).alias("share"))
    place = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = checkpointed(named.join(share, "lang").where(place < F.col("share")).select("doc_id", "lang").distinct())
    few = F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen
    return labelled.join(few, ["doc_id", "lang"]).select("lang", "text")


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """How often each byte string of up to order+1 bytes occurs, by language; as numbers, first byte highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            data, offs = utf8(b.column("text"))
            for lang in sorted(set(langs)):
                for i in np.flatnonzero(langs == lang):
                    text = data[offs[i] : offs[i + 1]].astype(np.int64)
                    for depth in range(1, order + 2):
                        if len(text) < depth:
                            continue
                        grams = sum(text[k : len(text) - depth + 1 + k] << 8 * (depth - 1 - k) for k in range(depth))
                        g, n = np.unique(grams, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "depth": pa.array(np.full(len(g), depth, np.int32)), "gram": g, "n": n})

    return map_arrow(rows, count, COUNTS).groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


def displaced(parent: np.ndarray, symbol: np.ndarray, n_parents: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows laid over each other in one array: base (by parent), owner and entry (by slot).

    The entry of a parent's symbol is at base + symbol, if that slot's owner is the parent. Rows with several entries take
    the first of some places where all their slots are free, largest rows first, else the end; single entries fill the holes.
    parent ascends."""
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    size = np.diff(np.append(first, len(parent)))
    base, used = np.zeros(n_parents, np.int64), np.zeros(2 * len(parent) + 4 * width, bool)
    low = end = 0
    for r in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
        own = symbol[first[r] : first[r] + size[r]]
        at = next((b for b in range(low, min(low + 16, end)) if not used[b + own].any()), None)
        if at is None:
            at, low = end, max(low, end - 4 * width)
        end = max(end, at + int(own[-1]) + 1)
        if end + 2 * width > len(used):
            used = np.append(used, np.zeros(len(used), bool))
        used[at + own] = True
        base[parent[first[r]]] = at
        if at == low:
            low += 1
    ones = first[size == 1]
    free = np.flatnonzero(~used[width : end + width]) + width
    free = np.append(free, np.arange(len(ones)) + max(end, 0) + 2 * width)[: len(ones)]
    base[parent[ones]] = free - symbol[ones]
    slot = base[parent] + symbol
    owner = np.full(int(base.max(initial=0)) + width, -1, np.int32)  # any base with any symbol is within
    entry = np.zeros(len(owner), np.int32)
    owner[slot], entry[slot] = parent, np.arange(len(parent))
    return base.astype(np.int32), owner, entry


class Model:
    """United context tree of a few languages. Node 0 is no node; at depth k the nodes stand for seen strings of k bytes.

    By depth: base, owner, node: a node's children as displaced() rows; cost: bits of a node's last byte after the bytes
    before it, by language; escape: bits of leaving a context, by language."""

    def __init__(self, langs: list[str], symbol: np.ndarray, levels: list[dict[str, np.ndarray]]):
        self.langs, self.symbol, self.levels = langs, symbol, levels

    @classmethod
    def build(cls, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]) -> Model:
        """grams[k], counts[k]: sorted distinct strings of k+1 bytes, and their counts by language."""
        n_langs = len(langs)
        seen = [np.unique(g & 255) for g in grams] or [np.empty(0, np.int64)]
        alphabet = reduce(np.union1d, seen).astype(np.int64)
        symbol = np.zeros(256, np.int32)  # 0: a byte no training text has
        symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        levels: list[dict[str, np.ndarray]] = []
        fallback, parents = np.full((1, n_langs), 8.0), np.zeros(1, np.int64)  # an unseen byte without context is a uniform byte
        for k, (g, c) in enumerate(zip(grams, counts, strict=True)):
            parent = np.searchsorted(parents, g >> 8) + 1 if k else np.ones(len(g), np.int64)
            n_parents = len(parents) + 1
            total, kinds = np.zeros((n_parents, n_langs)), np.zeros((n_parents, n_langs))
            np.add.at(total, parent, c)
            np.add.at(kinds, parent, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                own = np.log2(total + kinds)[parent] - np.log2(c)
            # the same last byte after one byte less of context
            lower = fallback[np.searchsorted(grams[k - 1], g & ((1 << 8 * k) - 1)) + 1] if k else fallback
            cost = np.vstack((np.zeros((1, n_langs)), np.where(c > 0, own, escape[parent] + lower)))
            base, owner, entry = displaced(parent, symbol[g & 255].astype(np.int64), n_parents, len(alphabet) + 1)
            levels.append({"base": base, "owner": owner, "node": np.where(owner >= 0, entry + 1, 0).astype(np.int32), "cost": cost.astype(np.float32), "escape": escape.astype(np.float32)})
            fallback, parents = cost, g
        return cls(langs, symbol, levels)

    def pack(self) -> bytes:
        """All arrays one after another behind a table of them, for open() to map."""
        arrays = {"symbol": self.symbol, **{f"{name}{k}": a for k, level in enumerate(self.levels) for name, a in level.items()}}
        table, at, parts = {}, 0, []
        for name, a in arrays.items():
            table[name] = (a.dtype.str, list(a.shape), at)
            parts.append(np.ascontiguousarray(a).tobytes())
            parts.append(bytes(-len(parts[-1]) % 64))
            at += len(parts[-1]) + len(parts[-2])
        head = json.dumps({"langs": self.langs, "levels": len(self.levels), "arrays": table}).encode()
        return len(head).to_bytes(8, "little") + head + bytes(-(len(head) + 8) % 64) + b"".join(parts)

    @classmethod
    def open(cls, path: str) -> Model:
        """The model in a file, mapped: all workers of a machine share the file's pages."""
        body = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(body[:8].tobytes(), "little")
        head, start = json.loads(body[8 : 8 + n].tobytes()), 8 + n + -(8 + n) % 64

        def array(name: str) -> np.ndarray:
            kind, shape, at = head["arrays"][name]
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            return body[start + at : start + at + size].view(kind).reshape(shape)

        levels = [{name: array(f"{name}{k}") for name in ("base", "owner", "node", "cost", "escape")} for k in range(head["levels"])]
        return cls(head["langs"], array("symbol"), levels)

    @classmethod
    def from_counts(cls, counts: pa.Table, order: int) -> Model:
        """counts: lang, depth, gram, n, in any order."""
        names = counts.column("lang").combine_chunks().dictionary_encode() if len(counts) else pa.array([], pa.string()).dictionary_encode()
        langs = sorted(names.dictionary.to_pylist())
        place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
        lang = place[names.indices.to_numpy()] if langs else np.empty(0, np.int64)
        depth, gram, n = (counts.column(c).to_numpy() for c in ("depth", "gram", "n"))
        grams, sums = [], []
        for d in range(1, order + 2):
            own = depth == d
            if not own.any():
                break
            known, pos = np.unique(gram[own], return_inverse=True)
            c = np.zeros((len(known), len(langs)))
            c[pos, lang[own]] = n[own]
            grams.append(known.astype(np.int64))
            sums.append(c)
        return cls.build(langs, grams, sums)

    def long_lengths(self, text: np.ndarray, most: int = PIECE) -> np.ndarray:
        """code_lengths of one very long text, in pieces with the bytes before them as context."""
        out = np.zeros((1, len(self.langs)))
        for a in range(0, len(text), most):
            before = min(a, len(self.levels))
            part = text[a - before : a + most]
            out += self.code_lengths(part, np.array([0, len(part)]), before)
        return out

    def code_lengths(self, data: np.ndarray, offs: np.ndarray, skip: int = 0) -> np.ndarray:
        """Bits of each text under each language; the first `skip` bytes are context only (of a single text)."""
        n_langs, n = len(self.langs), len(offs) - 1
        out = np.zeros((n, n_langs))
        if not len(data):
            return out
        place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
        symbols = self.symbol[data]
        # nodes[k][i]: the node of the k+1 bytes that end at i; the context of byte i is nodes[k-1][i-1]
        before, bits = np.ones(len(data), np.int32), np.zeros((len(data), n_langs), np.float32)
        open_ = np.ones(len(data), bool)  # bytes whose code length isn't known yet, from the longest context down
        nodes, contexts = [], []
        for k, level in enumerate(self.levels):
            context = before if k == 0 else np.where(place >= k, np.concatenate(([0], nodes[-1][:-1])), 0)
            slot = level["base"][context] + symbols
            contexts.append(context)
            nodes.append(np.where((level["owner"][slot] == context) & (context > 0), level["node"][slot], 0))
        for level, node, context in zip(reversed(self.levels), reversed(nodes), reversed(contexts), strict=True):
            hit = open_ & (node > 0)
            bits[hit] += level["cost"][node[hit]]
            open_ &= ~hit
            miss = open_ & (context > 0)
            if miss.any():
                bits[miss] += level["escape"][context[miss]]
        bits[open_] += 8.0
        bits[:skip] = 0.0
        full = np.flatnonzero(np.diff(offs))
        out[full] = np.add.reduceat(bits, offs[full], axis=0, dtype=np.float64)
        return out


class Models:
    """A model of each group of languages, in files that every machine gets once; tasks map one after another."""

    def __init__(self, langs: list[str], files: list[str]):
        self.langs, self.files = langs, files
        self.open: dict[str, Model] = {}

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "files": self.files, "open": {}}

    def _model(self, file: str) -> Model:
        if file not in self.open:
            self.open[file] = Model.open(SparkFiles.get(file))
        return self.open[file]

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code lengths of a slice of texts (one text, if it is a very long one) under all languages, in the order of langs."""
        models = [self._model(f) for f in self.files]
        return np.concatenate([m.code_lengths(data, offs) if len(data) <= 2 * PIECE else m.long_lengths(data) for m in models], 1)


def train(labelled: DataFrame, order: int = ORDER, rows_per_language: int = ROWS_PER_LANGUAGE, together: int = TOGETHER) -> Models:
    """labelled: doc_id, text, lang. Rows with a null text or language are left out.

    Languages are taken `together` at a time: the driver builds a group's tree and writes it to the shared folder, from where
    Spark gives it to every machine that scores (addFile). A language's code lengths don't depend on its group."""
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    chosen = training_rows(rows, rows_per_language)
    counts = checkpointed(count_grams(chosen, order))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    folder, files = fresh_dir(spark, "languages"), []
    for k in range(0, len(langs), together):
        model = Model.from_counts(counts.where(F.col("lang").isin(langs[k : k + together])).toArrow(), order)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        files.append(f"ppm-{uuid.uuid4().hex}")
        with fs.open_output_stream(f"{root}/{files[-1]}") as f:
            f.write(model.pack())
        spark.sparkContext.addFile(f"{folder}/{files[-1]}")
    return Models(langs, files)


def predict(documents: DataFrame, models: Models, label: str = "lang_pred", sure: str = "score") -> DataFrame:
    """Adds the language and its score to the rows of `documents`, under the given names (which replace columns so named)."""
    rest = documents.drop(label, sure)
    letters, body = own_name(documents, "letter"), own_name(documents, "body")
    # a letter anywhere, by Unicode category
    shown = rest.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).withColumn(body, F.coalesce("text", F.lit("")))
    names = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{label}` string", f"`{sure}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(body))
            letter = b.column(letters).to_numpy(zero_copy_only=False)
            pred, part_of = np.full(len(b), UNKNOWN, object), np.zeros(len(b))
            if models.langs:
                for i, j, part, o in slices(data, offs, PIECE):
                    lengths = models.lengths(part, o)
                    best = lengths.argmin(1)
                    pred[i:j] = np.array(models.langs, object)[best]
                    part_of[i:j] = 1 / np.exp2(np.minimum(0, lengths.min(1)[:, None] - lengths)).sum(1)
                pred[~letter], part_of[~letter] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred.tolist(), pa.string()), pa.array(part_of)], names=[*names, label, sure])

    return map_arrow(shown, score, schema)


def holds_out(folds: int, fold: int):
    """Whether a document is held out: crc32 of doc_id as text, modulo folds, is the fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def digest(documents: DataFrame) -> DataFrame:
    held = documents.select("doc_id", "text", "lang").withColumn("held_out", holds_out(4, 2))
    model = train(held.where("not held_out"))
    return predict(held.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
