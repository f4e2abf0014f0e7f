"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans to theirs.

Base spans are the patterns of base_spans(), which always stay. The field looks at zones, the stretches of a text around
digits, at signs and their spelled-out forms. A zone is cut into pieces (digits, letters, single marks); a segmentation
gives each piece to no entity or to one of up to `MOST_PIECES` pieces. An entity is scored as a whole: what it contains, how it
begins and ends, its shape, checksums, what stands around it. One dynamic program over pieces, entity lengths and kinds
chooses the boundaries and kinds of all entities of a zone together. Its spans are added where no base span overlaps them.

An entity has up to `MOST_PIECES` pieces and 19 digits; that is part of the model.

Weights are trained by conditional likelihood (forward and backward sums over the same segmentations, for all zones
together as arrays) until it rises no more, on zones of about `max_rows` documents and about `max_zones` of those
(documented bounds; both chosen by hash, wherever in a text a zone stands), labelled by the patterns, and on variants of
them that the patterns miss: without the plus sign, with other separators, with "at" and "dot" spelled out, and with plain
numbers in the spans' places. Long zones are cut into pieces of some `ZONE_CHARS` characters for training, outside of spans.
Only those zones go to the driver.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; very long texts are searched whole;
without labelled zones the field adds nothing; repeated rows are searched each; an empty table gives no rows; other columns
play no part in the digest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed, map_arrow, utf8

KINDS = ("email", "ip", "card", "phone")
MOST_PIECES, MAX_ROWS, MAX_ZONES = 24, 20_000, 2_000
MOST_STEPS, RATE, PENALTY, ENOUGH = 400, 0.2, 0.05, 1e-5
ZONE_CHARS, MARGIN = 150, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at >= low else None
        if m:
            s = at
            while s > low and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                found.append((s, m.end()))
                low = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# zones ---------------------------------------------------------------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@]+|[\[(]at[\])]| dot ")
_PIECE = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
_AT = r"(?:\s?[\[(]at[\])]\s?| at )"
_DOT = r"(?:\s?[\[(]dot[\])]\s?| dot |\.)"
_SPELLED = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+\Z")
_MORE, _LESS = re.compile(rf"{_DOT}[A-Za-z0-9]"), re.compile(rf"[A-Za-z0-9]{_DOT}\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9() ./-]*[0-9]\Z")
_GROUPS = re.compile(r"[0-9]+")
_CUE = re.compile(r"(?i)(tel|phone|call|fax|mobile|mail|contact|address|host|server|ip|card|visa|credit|iban)\W*\Z")


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of at least MARGIN characters around triggers; stretches that touch are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def features(text: str, s: int, e: int, kind: str) -> list[str]:
    """What a whole span says, for one kind."""
    span = text[s:e]
    d = sum(c in "0123456789" for c in span)
    groups = [len(x) for x in _GROUPS.findall(span)]
    said = ["any", "digits=" + str(0 if not d else min(d, 20)), "from=" + ("digit" if span[0].isdigit() else "letter" if span[0].isalpha() else span[0])]
    said.append("to=" + ("digit" if span[-1].isdigit() else "letter" if span[-1].isalpha() else "mark"))
    if s and (text[s - 1].isalnum() or text[s - 1] in "._%+-@"):
        said.append("joined_before")
    if e < len(text) and (text[e].isalnum() or text[e] in "@_"):
        said.append("joined_behind")
    if e + 1 < len(text) and text[e] in ".-" and text[e + 1].isalnum() or _MORE.match(text, e):
        said.append("goes_on")
    if _LESS.search(text, max(0, s - 8), s):
        said.append("goes_back")
    if _CUE.search(text, max(0, s - 12), s):
        said.append("cue")
    if kind == "email":
        said.append("shape=" + ("plain" if _EMAIL.match(span) else "spelled" if _SPELLED.match(span) else "none"))
    else:
        said.append("numbers" if _NUMBERS.match(span) else "not_numbers")
        said.append("groups=" + str(min(len(groups), 6)))
        said += [f"has={c}" for c in "+(-./ [" if c in span]
    if kind == "ip":
        parts = span.split(".")
        said.append("quad" if len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256 for x in parts) else "no_quad")
        numbers = _GROUPS.findall(span)
        said.append("four_bytes" if len(numbers) == 4 and all(len(x) < 4 and int(x) < 256 for x in numbers) else "no_bytes")
        said.append("between=" + "".join(sorted(set(_GROUPS.sub("", span)))))
    if kind == "card":
        said.append("sum" if luhn(_digits(span)) else "no_sum")
        said.append("fours" if groups and max(groups) <= 6 and len(groups) > 2 else "run" if len(groups) == 1 else "mixed")
    if kind == "phone":
        said.append("ends=" + ("-".join(map(str, groups[-3:])) if len(groups) > 1 and max(groups) < 8 else "other"))
    return [f"{kind}:{x}" for x in said]


def candidates(text: str, s: int, e: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:
    """Pieces of a zone, and the runs of pieces (first, end, kind) that could be an entity at all."""
    pieces = [m.span() for m in _PIECE.finditer(text, s, e)]
    out = []
    for i, (a, _) in enumerate(pieces):
        head = text[a]
        if not (head.isalnum() and head.isascii() or head in "+(._%-"):
            continue
        digits = 0
        for j in range(i, min(i + MOST_PIECES, len(pieces))):
            x, y = pieces[j]
            if j > i and x - pieces[j - 1][1] > 1:
                break  # more than one white space
            c = text[x]
            digits += y - x if "0" <= c <= "9" else 0
            if digits > 19:
                break
            if not (c.isascii() and c.isalnum()):
                continue
            span = text[a:y]
            numeric = not any(ch.isalpha() for ch in span)
            if j > i + 2 and not numeric and ("@" in span or " at " in span or "(at)" in span or "[at]" in span):
                out.append((i, j + 1, "email"))
            if numeric and head in "0123456789+(" and digits >= 4:
                if 4 <= digits <= 12 and span.count(".") == 3:
                    out.append((i, j + 1, "ip"))
                if 12 <= digits <= 19:
                    out.append((i, j + 1, "card"))
                if 7 <= digits <= 15:
                    out.append((i, j + 1, "phone"))
    return pieces, out


class SemiMarkovField:
    """Weights of whole-span features."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, said: list[str]) -> float:
        w = self.weights
        return sum(w.get(x, 0.0) for x in said)

    def best(self, text: str, s: int, e: int) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        pieces, spans = candidates(text, s, e)
        if not spans:
            return []
        by_end: dict[int, list] = {}
        for i, j, kind in spans:
            x = self.score(features(text, pieces[i][0], pieces[j - 1][1], kind))
            if x > 0:
                by_end.setdefault(j, []).append((x, i, kind))
        top, back = [0.0], [None]
        for j in range(1, len(pieces) + 1):
            value, how = top[j - 1], None
            for x, i, kind in by_end.get(j, ()):
                if top[i] + x > value:
                    value, how = top[i] + x, (i, kind)
            top.append(value)
            back.append(how)
        out, j = [], len(pieces)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, pieces[i][0], pieces[j - 1][1]))
                j = i
        return out[::-1]

    @classmethod
    def train(cls, zones_: list[tuple[str, list[tuple[str, int, int]]]]) -> SemiMarkovField:
        """Gradient ascent (with Adam's steps) of the penalised conditional likelihood of labelled zones (text, spans)."""
        made = cls({})
        known: dict[str, int] = {}
        rows, width = [], 0
        for z, (text, gold) in enumerate(zones_):
            pieces, spans = candidates(text, 0, len(text))
            width = max(width, len(pieces))
            at = set(gold)
            for i, j, k in spans:
                a, b = pieces[i][0], pieces[j - 1][1]
                rows.append((z, i, j, [known.setdefault(f, len(known) + 1) for f in features(text, a, b, k)], (k, a, b) in at))
        if not rows:
            return made
        lattice = Lattice(np.array([r[:3] for r in rows]), len(zones_), width)
        said = np.zeros((len(rows), max(len(r[3]) for r in rows)), np.int64)  # feature 0 is none
        for r, row in enumerate(rows):
            said[r, : len(row[3])] = row[3]
        gold = np.array([r[4] for r in rows], float)
        w = np.zeros(len(known) + 1)
        mean, spread, last = np.zeros_like(w), np.zeros_like(w), -math.inf
        for step in range(1, MOST_STEPS + 1):
            scores = w[said].sum(1)
            total, chance = lattice.sums(scores)
            value = (gold @ scores - total.sum()) / len(zones_) - PENALTY / 2 * (w @ w) / len(zones_)
            if step % 10 == 0:
                if value - last < ENOUGH * abs(value):
                    break
                last = value
            slope = np.bincount(said.ravel(), np.repeat(gold - chance, said.shape[1]), minlength=len(w)) - PENALTY * w
            slope /= len(zones_)
            mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
            w = w + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
            w[0] = 0.0
        made.weights = {f: float(w[k]) for f, k in known.items()}
        return made


class Lattice:
    """All segmentations of many zones: candidates (zone, first piece, end), at most `width` pieces a zone."""

    def __init__(self, spans: np.ndarray, n: int, width: int):
        self.zone, self.first, self.end = spans.T
        self.n, self.width = n, width
        self.by_end, self.by_first = self._steps(self.end), self._steps(self.first)

    def _steps(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By piece: its candidates in the order of zones, where each zone's begin, and the zones."""
        out = []
        order = np.lexsort((self.zone, at))
        bounds = np.searchsorted(at[order], np.arange(self.width + 2))
        for a, b in zip(bounds, bounds[1:]):
            own = order[a:b]
            zones_, begin = np.unique(self.zone[own], return_index=True)
            out.append((own, begin, zones_))
        return out

    @staticmethod
    def _plus(base: np.ndarray, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log of exp(base) and the sum of exp(values) of each zone's run."""
        most = np.maximum(np.maximum.reduceat(values, begin), base)
        runs_ = np.diff(begin, append=len(values))
        return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, runs_)), begin) + np.exp(base - most))

    def sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each zone the logarithm of the sum over its segmentations, and each candidate's probability."""
        ahead, behind = np.zeros((self.width + 1, self.n)), np.zeros((self.width + 1, self.n))
        for j in range(1, self.width + 1):
            own, begin, zones_ = self.by_end[j]
            ahead[j] = ahead[j - 1]
            if len(own):
                ahead[j, zones_] = self._plus(ahead[j - 1, zones_], ahead[self.first[own], self.zone[own]] + scores[own], begin)
        for i in range(self.width - 1, -1, -1):
            own, begin, zones_ = self.by_first[i]
            behind[i] = behind[i + 1]
            if len(own):
                behind[i, zones_] = self._plus(behind[i + 1, zones_], behind[self.end[own], self.zone[own]] + scores[own], begin)
        total = ahead[self.width]
        return total, np.exp(ahead[self.first, self.zone] + scores + behind[self.end, self.zone] - total[self.zone])


#: Numbers that are no personal data; each zone is also learned with some of them in its spans' places.
PLAIN_NUMBERS = (
    "2024-01-05 10:30", "100-200, 300-400", "10 11 12 13", "1.2.3", "12,345,678", "300.1.2.3", "1999-2004", "3.14159 2.71828",
    "1234567", "05.01.2024", "10.0.0.300", "2001 - 2010", "(1) 2345678", "16 32 64 128 256", "1.0.12.2024", "555 1000 2000",
)


def _fours(x: str, mark: str) -> str:
    d = _digits(x)
    return mark.join(d[k : k + 4] for k in range(0, len(d), 4))


#: Spellings that the patterns don't have, by kind.
SPELLINGS = {
    "email": (lambda x: x.replace("@", " at ").replace(".", " dot "), lambda x: x.replace("@", " [at] "), lambda x: x.replace("@", "(at)").replace(".", " (dot) ")),
    "ip": (lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", " . "), lambda x: x[::-1].replace(".", "].[", 1)[::-1]),
    "card": (lambda x: _fours(x, "."), lambda x: _fours(x, "/"), lambda x: _fours(x, " - ")),
    "phone": (lambda x: re.sub(r"^\+[0-9]+[ .-]?", "", x), lambda x: re.sub(r"[ ()-]+", ".", x).strip("+."), lambda x: "00" + x[1:]),
}


def variants(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Zones in which each span is written as the patterns don't have it, and zones with plain numbers in their places."""
    out = []
    for way in range(3):
        new, gold, at = "", [], 0
        for kind, s, e in sorted(spans, key=lambda x: x[1]):
            if s < at:
                continue
            span = SPELLINGS[kind][way](text[s:e])
            new += text[at:s]
            if len(_GROUPS.findall(span)) > 1 or kind == "email":
                gold.append((kind, len(new), len(new) + len(span)))
            new += span
            at = e
        if spans:
            out.append((new + text[at:], gold))
    for way in range(3 if spans else 0):
        new, at = "", 0
        for k, (_, s, e) in enumerate(sorted(spans, key=lambda x: x[1])):
            if s >= at:
                new, at = new + text[at:s] + PLAIN_NUMBERS[(len(text) + 5 * way + k) % len(PLAIN_NUMBERS)], e
        out.append((new + text[at:], []))
    return out


def _labelled(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """All zones of a text, with the spans of the patterns; long ones in pieces, cut at white space outside of spans."""
    base, out = base_spans(text), []
    for s, e in zones(text):
        inside = [(k, a, b) for k, a, b in base if s <= a and b <= e]
        # an entity of two kinds teaches the first
        own = [x for i, x in enumerate(inside) if not any(x[1] < y[2] and y[1] < x[2] for y in inside[:i])]
        while s < e:
            cut = e
            if e - s > 2 * ZONE_CHARS:
                cut = next((k for k in range(s + ZONE_CHARS, e) if text[k].isspace() and not any(a <= k < b for _, a, b in own)), e)
            out.append((text[s:cut], [(k, a - s, b - s) for k, a, b in own if s <= a and b <= cut]))
            s = cut
    return out


_ANY = np.zeros(256, bool)
_ANY[48:58] = _ANY[64] = True


def _triggered(column: pa.Array) -> list[int]:
    """Texts that could hold anything, by one look at their bytes."""
    data, offs = utf8(column)
    seen = np.concatenate(([0], np.cumsum(_ANY[data], dtype=np.int64)))
    some = seen[offs[1:]] > seen[offs[:-1]]
    body = data.tobytes() if not some.all() else b""
    for mark in (b"[at]", b"(at)", b" dot "):
        at = body.find(mark)
        while at >= 0:
            some[np.searchsorted(offs, at, "right") - 1] = True
            at = body.find(mark, at + 1)
    return np.flatnonzero(some).tolist()


def train(documents: DataFrame, max_rows: int = MAX_ROWS, max_zones: int = MAX_ZONES) -> SemiMarkovField:
    n = documents.count()
    place = lambda what, *of: F.pmod(F.xxhash64(F.lit(what), *of), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = rows.where(place("pii", "doc_id", "text") < max_rows / max(n, 1)).select("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, rows = b.column("text"), []
            for i in _triggered(column):
                for text, spans in _labelled(column[i].as_py()):
                    rows.append((text, "\n".join(f"{k}:{s}:{e}" for k, s, e in spans)))
            if rows:
                yield pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "spans": [r[1] for r in rows]})

    # each kind of labelling has its part of the bound, so that zones without spans don't crowd out the others
    made = checkpointed(map_arrow(sample, label, "text string, spans string").distinct())
    some = F.col("spans") != ""
    count = made.agg(F.count_if(some).alias("with"), F.count_if(~some).alias("without")).first()
    share = F.when(some, max_zones / max(count["with"], 1)).otherwise(max_zones / max(count["without"], 1))
    found = sorted((r["text"], r["spans"]) for r in made.where(place("zone", "text") < share).collect())
    zones_ = [(t, [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split("\n") if x)]) for t, spans in found]
    return SemiMarkovField.train(zones_ + [v for t, spans in zones_ for v in variants(t, spans)])


def find(text: str, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; both by kind and start."""
    base = base_spans(text)
    added = [x for s, e in zones(text) for x in field.best(text, s, e) if not any(x[1] < b[2] and b[1] < x[2] for b in base)]
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda x: (order[x[0]], x[1], x[2])
    return sorted(base, key=key), sorted(base + added, key=key)


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
_FOUND = [("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())]
_NOTHING = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0)


def detect(documents: DataFrame, field: SemiMarkovField) -> DataFrame:
    """doc_id with counts of base spans by kind, their digest, all spans, how many of them the field added, and how many there are."""
    held = documents.sparkSession.sparkContext.broadcast(field)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, rows = b.column("text"), [_NOTHING] * len(b)
            for i in _triggered(column):
                base, spans = find(column[i].as_py(), held.value)
                counts = [sum(x[0] == k for x in base) for k in KINDS]
                rows[i] = (*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans) - len(base), len(spans))
            made = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _FOUND, strict=True)] if rows else [pa.array([], kind) for _, kind in _FOUND]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=["doc_id", *(n for n, _ in _FOUND)])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), search, f"doc_id {kind}, {FOUND}")


def digest(documents: DataFrame) -> DataFrame:
    return detect(documents, train(documents))
