"""Problem 9: evaluation passages inside training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.session import spread

#: Words that stand for a unit.
UNITS = frozenset("m cm mm km ft in s ms min h hz fps px kg g v a w deg rad m2 kmh mph percent meters metres seconds minutes hours frames pixels degrees".split())
WORDS = re.compile(r"[^\W_]+")
_ODD = 0x9E3779B97F4A7C15
_NUMBER, _UNIT, _AMOUNT, _NAME = 2, 3, 4, 5
LITERALS = 4  # a window of fewer words that are not placeholders says nothing as a template and stands for itself


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Templates:
    """Words of a text and hashes of all windows of `size` of them, by whole arrays of code points.

    A word's code is a polynomial hash of its lower-case letters and digits, the same in every process.
    Two templates of each window: the plain one, by the words alone (numbers, units and numbers with a
    unit at their end become placeholders), so that equal words have equal templates whatever their case;
    and the named one, in which a number with decimals is one word, and a capitalised word that does not
    begin a sentence is a name and a placeholder too.
    """

    def __init__(self, size: int):
        self.size = size
        self.kind, self.lower = np.full(0x110000, 255, np.uint8), np.zeros(0x110000, np.uint32)  # 255: not yet met
        self.upper, self.small = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self.ends = np.zeros(0x110000, bool)
        self.ends[[ord(c) for c in ".!?:;\n\r"]] = True
        self.point = np.zeros(0x110000, bool)
        self.point[[ord(c) for c in ".,"]] = True
        self._powers(1 << 12)
        codes = sorted(int(self._codes(p, *self._words(self._kinds(p)))[0]) for p in (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in UNITS))
        self.units = np.array(codes, np.uint64)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.units & np.uint64(0xFFFF)).astype(int)] = True

    def _powers(self, n: int) -> None:
        def run(base: int) -> np.ndarray:
            p = np.full(n, base, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.powers, self.inverse = run(_ODD), run(pow(_ODD, -1, 1 << 64))

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if len(points) and kind.max() == 255:
            for c in np.unique(points[kind == 255]).tolist():
                ch = chr(c)
                self.kind[c] = 2 if ch.isdecimal() else 1 if WORDS.fullmatch(ch) else 0
                self.lower[c] = ord(ch.lower()[0])
                self.upper[c], self.small[c] = ch.isupper(), ch.islower()
            kind = self.kind[points]
        if len(points) + 2 > len(self.powers):
            self._powers(2 * len(points) + 2)
        return kind

    def _words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind > 0
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def _prefix(self, points: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((self.lower[points].astype(np.uint64) + np.uint64(1)) * self.powers[: len(points)], out=prefix[1:])
        return prefix

    def _codes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self._prefix(points) if prefix is None else prefix
        return _mixed((prefix[end] - prefix[start]) * self.inverse[start])

    def _is_unit(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), bool)
        maybe = np.flatnonzero(self.low[(code & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            out[maybe] = self.units[np.minimum(np.searchsorted(self.units, code[maybe]), len(self.units) - 1)] == code[maybe]
        return out

    def _placed(self, points: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes with placeholders for numbers, units and amounts, and where they stand."""
        letters = np.zeros(len(points) + 1, np.int64)
        np.cumsum(kind == 1, out=letters[1:])
        out = code.copy()
        some = letters[end] - letters[start]
        out[some == 0] = _NUMBER
        out[self._is_unit(code)] = _UNIT
        mixed = np.flatnonzero((some > 0) & (some < end - start) & (kind[start] == 2))  # digits first: an amount, if only a unit follows
        if len(mixed):
            tail = end[mixed] - some[mixed]
            whole = letters[end[mixed]] - letters[tail] == some[mixed]
            unit = self._is_unit(_mixed((prefix[end[mixed]] - prefix[tail]) * self.inverse[tail]))
            out[mixed[whole & unit]] = _AMOUNT
        return out, out != code

    def _windows(self, code: np.ndarray, placed: np.ndarray, slot: np.ndarray, seed: int) -> np.ndarray:
        n = len(code) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        if len(code) + 2 > len(self.powers):
            self._powers(2 * len(code) + 2)

        def rolled(c: np.ndarray) -> np.ndarray:
            prefix = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(c * self.powers[: len(c)], out=prefix[1:])
            return (prefix[self.size :] - prefix[:n]) * self.inverse[:n]

        slots = np.zeros(len(code) + 1, np.int64)
        np.cumsum(slot, out=slots[1:])
        poor = slots[self.size :] - slots[:n] > self.size - LITERALS
        h = rolled(placed)
        if poor.any():
            h[poor] = rolled(code)[poor] ^ np.uint64(0x5DEECE66D)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def __call__(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the plain and the named template: start and end of each word, and the hash of the window that begins with each."""
        text = text or ""
        plain = text.isascii()
        points = np.frombuffer(text.encode() if plain else text.encode("utf-32-le", "surrogatepass"), np.uint8 if plain else np.uint32)
        kind, prefix = self._kinds(points), self._prefix(points)
        start, end = self._words(kind)
        code = self._codes(points, start, end, prefix)
        placed, slot = self._placed(points, kind, start, end, prefix, code)
        out = [(start, end, self._windows(code, placed, slot, 0))]
        digit = kind == 2
        inner = np.zeros(len(points), bool)
        if len(points) > 2:
            inner[1:-1] = digit[:-2] & digit[2:] & self.point[points[1:-1]]
        if inner.any():  # the point of a number stands inside its word
            kind = np.where(inner, np.uint8(2), kind)
            start, end = self._words(kind)
            code = self._codes(points, start, end, prefix)
            placed, slot = self._placed(points, kind, start, end, prefix, code)
        if len(start):
            stops = np.zeros(len(points) + 1, np.int64)
            np.cumsum(self.ends[points], out=stops[1:])
            first = np.r_[True, stops[start[1:]] > stops[end[:-1]]]
            small = np.zeros(len(points) + 1, np.int64)
            np.cumsum(self.small[points], out=small[1:])
            name = ~first & self.upper[points[start]] & (small[end] - small[start] == end - start - 1) & (end - start > 1)
            placed, slot = np.where(name, np.uint64(_NAME), placed), slot | name
        return [*out, (start, end, self._windows(code, placed, slot, 1))]

    def words(self, text: str, start: np.ndarray, end: np.ndarray, at: int) -> str:
        return " ".join(text[a:b].lower() for a, b in zip(start[at : at + self.size].tolist(), end[at : at + self.size].tolist(), strict=True))


def consistent(a: Column, b: Column) -> Column:
    """Whether the slots of one window (array of words) can be re-filled one for one to give the other."""
    pairs = F.size(F.array_distinct(F.arrays_zip(a, b)))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def template_windows(df: DataFrame, key: str, text: str, size: int, known: np.ndarray | None = None) -> DataFrame:
    """(key, hash, named, at, words) of the windows of both templates; of those only, where known is given, whose hash may be in that filter."""
    shared = None if known is None else df.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(size)
        bits = None if shared is None else shared.value
        for batch in batches:
            row, hashes, named, at, words = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                for k, (start, end, found) in enumerate(templates(value)):
                    some = np.arange(len(found)) if bits is None else np.flatnonzero(may_contain(bits, found))
                    if len(some):
                        row.append(np.full(len(some), i))
                        hashes.append(found[some])
                        named.append(np.full(len(some), k == 1))
                        at.append(some.astype(np.int32))
                        words += [templates.words(value, start, end, j) for j in some.tolist()]
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            cols = [batch.column(0).take(pa.array(join(row, np.int64))), pa.array(join(hashes, np.int64)), pa.array(join(named, bool)), pa.array(join(at, np.int32)), pa.array(words, pa.string())]
            yield pa.record_batch(cols, names=[key, "hash", "named", "at", "words"])

    return df.mapInArrow(cut, f"`{key}` {dict(df.dtypes)[key]}, hash long, named boolean, at int, words string")


def _bits_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [(h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(34)) * np.uint64(_ODD) & np.uint64(size - 1)).astype(np.int64)]


def may_contain(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes may be in the Bloom filter, an array of bytes whose number of bits is a power of two."""
    a, b = _bits_of(hashes, 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bloom_filter(hashes: DataFrame, least: int = 1 << 17, most: int = 1 << 27) -> np.ndarray:
    """A Bloom filter of a column `hash`: 16 bits a value, never more than `most` bits (16 MB), which is the bound of what is gathered and broadcast."""
    n = hashes.agg(F.approx_count_distinct("hash")).first()[0]
    size = min(most, max(least, 1 << (16 * max(1, n)).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(_bits_of(batch.column(0).to_numpy(), size)))
            yield pa.record_batch([pa.array(both >> 5), pa.array(np.int64(1) << (both & 31))], names=["word", "bit"])

    rows = hashes.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 5, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def leaked_passages(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, size: int = 12, salts: int = 4, most_bits: int = 1 << 27) -> DataFrame:
    """(item, doc, doc_at, item_at, named, verbatim): windows of `size` words of a passage whose template stands in a text.

    Words are maximal runs of letters and digits, without case. Numbers, units and, in a second template
    of each window, names become typed placeholders (see Templates; at are word numbers of that
    template); windows of placeholders are hashed and joined, and the slots of each hit are compared:
    verbatim, or re-filled one for one (verbatim false); other hits are dropped. The hashes of all windows
    of the stated items make a Bloom filter of bounded size, so that of the corpus only windows that may
    meet are shuffled; where items are so many that the filter fills, more windows go to the join, and
    the rows are the same. Windows of texts are salted, so that a passage a third of all texts have is spread.

    Null and empty texts or passages, and those of fewer words, have no windows. Repeated rows give
    repeated rows. Empty tables give no rows.
    """
    windows = template_windows(items.select(F.col(item).alias("__item"), passage).where(F.col(passage).isNotNull()), "__item", passage, size)
    known = bloom_filter(windows.select("hash"), most=most_bits)
    texts = template_windows(spread(docs.select(F.col(doc).alias("__doc"), text), docs), "__doc", text, size, known)
    texts = texts.withColumnsRenamed({"at": "doc_at", "words": "__words"}).withColumn("__salt", F.pmod(F.xxhash64("__doc", "doc_at"), F.lit(salts)).cast("int"))
    windows = windows.withColumnRenamed("at", "item_at").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = texts.join(windows, ["hash", "named", "__salt"]).withColumn("verbatim", F.col("words") == F.col("__words"))
    refilled = consistent(F.split("words", " "), F.split("__words", " "))
    hits = hits.where(F.when(F.col("verbatim"), ~F.col("named")).otherwise(refilled))  # what is verbatim by name is so by the plain template
    return hits.select(F.col("__item").alias(item), F.col("__doc").alias(doc), "doc_at", "item_at", "named", "verbatim")
