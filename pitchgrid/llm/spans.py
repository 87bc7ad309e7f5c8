"""Problem 10: long spans that stand verbatim in more than one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pitchgrid.operators.blocks import runs_of
from pitchgrid.session import checkpointed, partitions_for, spread

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def difference_cover(q: int) -> tuple[int, list[int]]:
    """(period, cover) of q + 1 residues whose differences give every residue of period = q*q + q + 1 (q prime).

    Singer's construction: the powers of a generator of GF(q^3) that lie in a plane.
    """
    period, order = q * q + q + 1, q**3 - 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):  # x^3 = a x^2 + b x + c
                x, k, cover = (1, 0, 0), 0, []
                while True:
                    if x[2] == 0 and k < period:
                        cover.append(k)
                    x, k = ((x[2] * c) % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q), k + 1
                    if x == (1, 0, 0) or k > order:
                        break
                if k == order:
                    return period, cover
    raise ValueError(f"{q} is not prime")


def cover_for(least: int) -> tuple[int, int, list[int]]:
    """(window, period, cover): the widest period that leaves windows of at least a third of the span."""
    best = (least, 1, [0])
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if least - (q * q + q + 1) + 1 >= max(8, least // 3):
            period, cover = difference_cover(q)
            best = (least - period + 1, period, cover)
    return best


class Rolling:
    """Two independent 64-bit polynomial hashes of windows of a text's code points."""

    def __init__(self):
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.n = n
        self.powers, self.inverse = [], []
        for base in _BASES:
            for into, b in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                into.append(np.cumprod(p, dtype=np.uint64))

    def prefixes(self, text: str, which: int) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if which:  # the second hash sees scattered codes
            c = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            c ^= c >> np.uint64(31)
        if len(c) + 1 > self.n:
            self.grow(2 * len(c) + 2)
        out = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * self.powers[which][: len(c)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start: np.ndarray, width: int, which: int) -> np.ndarray:
        h = (prefix[start + width] - prefix[start]) * self.inverse[which][start]
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals sorted by start; touching ones become one."""
    if not len(starts):
        return starts, ends
    top = np.maximum.accumulate(ends)
    head = np.r_[True, starts[1:] > top[:-1]]
    return starts[head], np.r_[top[np.flatnonzero(head)[1:] - 1], top[-1]]


def _meeting(rows: DataFrame, n: int, columns: list[str], doc: str) -> DataFrame:
    """The rows (key, doc, *columns, sure) whose key another text has as well.

    Rows go to the partition of their key, or, where `sure` (another text of the same input task has
    the key), to one of their text, for one row a key and task is enough there. So a key has at most
    one row of each input task in a partition, however many texts share it. Partitions are sorted and
    stream: beside a batch only the open key is held, however large a partition is.
    """
    kinds, keep = dict(rows.dtypes), [doc, *columns]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["sure", "key"]):
            sure = t.column("sure").to_numpy(zero_copy_only=False)
            if sure.all():
                chosen = sure
            else:
                code = t.column(doc).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                many, _ = _representatives(t.column("key").to_numpy(), code, t.column("check").to_numpy() if "check" in kinds else None)  # the second hash must agree as well
                chosen = sure | many
            yield from t.select(keep).filter(pa.array(chosen)).combine_chunks().to_batches()

    spread = rows.repartition(n, F.when(F.col("sure"), F.xxhash64(doc)).otherwise(F.col("key"))).sortWithinPartitions("sure", "key")
    return spread.mapInArrow(meet, ", ".join(f"`{c}` {kinds[c]}" for c in keep))


def _representatives(key: np.ndarray, code: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a key that another text of these rows has too, and a row that stands for each key."""
    order = np.lexsort((code, key) if check is None else (code, check, key))
    k, d = key[order], code[order]
    new = k[1:] != k[:-1]
    if check is not None:
        new |= check[order][1:] != check[order][:-1]
    first = np.flatnonzero(np.r_[True, new])
    last = np.r_[first[1:], len(k)] - 1
    many = np.repeat(d[first] != d[last], last - first + 1)
    out = np.zeros(len(key), bool)
    out[order] = many
    return out, order[first]


def shared_spans(docs: DataFrame, doc: str, text: str, least: int = 300, flush: int = 2_000_000) -> DataFrame:
    """(doc, chars, spans array<struct<start,end>>): for each text with one, the maximal stretches covered by
    spans of at least `least` characters that stand verbatim in another text (another value of doc).

    Anchors: windows are hashed only at the positions of a difference cover, modulo its period. For any two
    positions some shift up to the period brings both onto the cover, so two texts that share `least`
    characters share an aligned anchor inside them. Texts with an anchor of another text keep the stretches
    around it; there the spans of exactly `least` characters that begin or end with an anchor are compared
    (96 bits of two hashes). Anchors around which starts are left that these do not cover stay open in all
    texts that have them, and there every start is compared, so that spans are found to the character. A row of a shared value goes once to its partition from each task.

    Rows of one doc are one text for another's sake: they never share with each other. Null, empty and
    shorter texts share nothing; repeated rows change nothing. Empty tables give no rows.
    """
    window, period, cover = cover_for(least)
    mask = np.zeros(period, bool)
    mask[cover] = True
    reach = least - window
    kind, n = dict(docs.dtypes)[doc], partitions_for(docs)
    doc_type = to_arrow_type(docs.schema[doc].dataType)
    texts = docs.select(F.col(doc), F.col(text).alias("text")).where(F.col(doc).isNotNull() & (F.length(text) >= least))

    def anchors(rolling: Rolling, value: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.resize(mask, len(value) - window + 1))
        return at, rolling.at(rolling.prefixes(value, 0), at, window, 0) & 0xFFFFFFFFFFFF  # 48 bits: what meets by chance falls out below

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, size = Rolling(), [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            names = [d for d, _ in held]
            code_of = {d: i for i, d in enumerate(dict.fromkeys(names))}
            lengths = [len(h) for _, h in held]
            key = np.concatenate([h for _, h in held])
            code = np.repeat(np.array([code_of[d] for d in names]), lengths)
            sure, heads = _representatives(key, code, None)
            keep = pa.array(list(code_of), doc_type).take(pa.array(code))
            extra = np.zeros(len(key), bool)
            extra[heads] = True
            # Every row that is sure goes with its text; one row of each key goes with the key. In the
            # order of the texts, so that the names of texts take little room in the shuffle.
            rows = np.concatenate([np.flatnonzero(sure), np.flatnonzero(extra)])
            flag = np.r_[np.ones(int(sure.sum()), bool), np.zeros(int(extra.sum()), bool)]
            by_text = np.argsort(rows, kind="stable")
            rows, flag = rows[by_text], flag[by_text]
            for i in range(0, len(rows), 200_000):
                r = rows[i : i + 200_000]
                yield pa.record_batch([pa.array(key[r]), keep.take(pa.array(r)), pa.array(flag[i : i + 200_000])], names=["key", doc, "sure"])

        for batch in batches:
            for d, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, h = anchors(rolling, value.as_py())
                held.append((d, np.unique(h)))
                size += len(h)
                if size >= flush:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    rows = spread(texts, docs).mapInArrow(emit, f"key long, `{doc}` {kind}, sure boolean")
    met = _meeting(rows, n, ["key"], doc).groupBy(doc).agg(F.collect_set("key").alias("anchors"))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches around shared anchors, with the anchors' places in them."""
        rolling = Rolling()
        for batch in batches:
            out: list[tuple] = []
            for d, value, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                value = value.as_py()
                at, h = anchors(rolling, value)
                known = np.isin(h, shared.values.to_numpy())
                at, h = at[known], h[known]
                starts, ends = _merge(np.maximum(0, at - reach), np.minimum(len(value), at + least))
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    if e - s >= least:
                        own = (at >= s) & (at + window <= e)
                        out.append((d, s, value[s:e], (at[own] - s).tolist(), h[own].tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (doc_type, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=[doc, "start", "piece", "at", "hash"])

    pieces = texts.join(met, doc).select(doc, "text", "anchors").mapInArrow(regions, f"`{doc}` {kind}, start long, piece string, at array<long>, hash array<long>")
    pieces = checkpointed(pieces)

    def spans_at(choose) -> Iterator:  # noqa: ANN001
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rolling = Rolling()
            for batch in batches:
                b = batch.to_pydict()
                codes, keys, checks, ats, names = [], [], [], [], []
                for i in range(batch.num_rows):
                    piece = b["piece"][i]
                    p = choose(b, i, len(piece))
                    if len(p):
                        keys.append(rolling.at(rolling.prefixes(piece, 0), p, least, 0))
                        checks.append(rolling.at(rolling.prefixes(piece, 1), p, least, 1).astype(np.int32))
                        ats.append(p + b["start"][i])
                        codes.append(np.full(len(p), len(names)))
                        names.append(b[doc][i])
                if not names:
                    continue
                key, check, at, code = map(np.concatenate, (keys, checks, ats, codes))
                seen: dict = {}
                same = np.array([seen.setdefault(d, len(seen)) for d in names])[code]
                sure, heads = _representatives(key, same, check)
                extra = np.zeros(len(key), bool)
                extra[heads] = True
                extra |= ~sure
                r = np.concatenate([np.flatnonzero(sure), np.flatnonzero(extra)])
                flag = np.r_[np.ones(int(sure.sum()), bool), np.zeros(int(extra.sum()), bool)]
                by_text = np.argsort(r, kind="stable")
                r, flag = r[by_text], flag[by_text]
                who = pa.array(names, doc_type).take(pa.array(code[r]))
                yield pa.record_batch([pa.array(key[r]), pa.array(check[r]), who, pa.array(at[r]), pa.array(flag)], names=["key", "check", doc, "span", "sure"])

        return hashed

    shape = f"key long, check int, `{doc}` {kind}, span long, sure boolean"

    def found(source: DataFrame, choose) -> DataFrame:  # noqa: ANN001
        return _meeting(source.mapInArrow(spans_at(choose), shape), n, ["span"], doc).distinct()

    def beside_anchors(b: dict, i: int, length: int) -> np.ndarray:
        at = np.array(b["at"][i])
        p = np.unique(np.concatenate([at, at - reach]))
        return p[(p >= 0) & (p + least <= length)]

    def open_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with starts around them that could add to what is known, and the least and greatest shift to such a start."""
        for batch in batches:
            b, out = batch.to_pydict(), []
            for i in range(batch.num_rows):
                at, length = np.array(b["at"][i], np.int64), len(b["piece"][i])
                known = np.array(sorted(set(b["known"][i] or [])), np.int64) - b["start"][i]
                s, e = _merge(np.maximum(0, at - reach), np.minimum(at, length - least) + 1)
                p = np.concatenate([np.arange(x, y) for x, y in zip(s, e, strict=True)] or [np.zeros(0, np.int64)])
                if len(known):
                    a, z = _merge(known, known + least)
                    j = np.searchsorted(a, p, "right") - 1
                    p = p[(j < 0) | (p + least > z[np.maximum(j, 0)])]
                lo, hi = np.searchsorted(p, at - reach), np.searchsorted(p, at, "right")
                some = np.flatnonzero(hi > lo)
                if len(some):
                    out.append((np.array(b["hash"][i], np.int64)[some], at[some] - p[hi[some] - 1], at[some] - p[lo[some]]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.record_batch([pa.array(c) for c in cols], names=["hash", "near", "far"])

    def around_open(b: dict, i: int, length: int) -> np.ndarray:
        p = [np.arange(max(0, o["at"] - o["far"]), min(o["at"] - o["near"], length - least) + 1) for o in b["open"][i]]
        return np.unique(np.concatenate(p))

    sure = checkpointed(found(pieces, beside_anchors))
    known = sure.groupBy(doc).agg(F.collect_list("span").alias("known"))
    # What an uncovered start of one text matches may be covered in another: an open anchor is open for all its texts.
    opened = pieces.join(known, doc, "left").select("start", "piece", "at", "hash", "known").mapInArrow(open_anchors, "hash long, near long, far long")
    opened = opened.groupBy("hash").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    each = pieces.select(doc, "start", F.explode(F.arrays_zip("at", "hash")).alias("a")).select(doc, "start", "a.at", "a.hash").join(opened, "hash")
    each = each.groupBy(doc, "start").agg(F.collect_set(F.struct("at", "near", "far")).alias("open"))
    rest = found(pieces.select(doc, "start", "piece").join(each, [doc, "start"]), around_open)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, chars, spans = [], [], []
            for d, at in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = np.unique(at.values.to_numpy())
                s, e = _merge(p, p + least)
                names.append(d)
                chars.append(int((e - s).sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([pa.array(names, doc_type), pa.array(chars, pa.int64()), pa.array(spans, span)], names=[doc, "chars", "spans"])

    places = sure.unionByName(rest).groupBy(doc).agg(F.collect_set("span").alias("places"))
    return places.mapInArrow(merged, f"`{doc}` {kind}, chars long, spans array<struct<start: long, end: long>>")
