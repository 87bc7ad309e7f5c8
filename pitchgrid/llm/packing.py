"""Problem 8: texts into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.blocks import runs_of
from pitchgrid.session import checkpointed, partitions_for, spread

#: Fixed values of the public byte-level BPE vocabulary: how it cuts text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class TokenCounter:
    """Number of tokens of a text. Merges never cross the pieces, so counts of pieces are kept and added."""

    def __init__(self, vocabulary: str, keep: int = 1 << 20):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces, self.known, self.keep = regex.compile(PIECES), {}, keep

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.pieces.findall(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) <= 40:
                    if len(known) >= self.keep:
                        known.clear()
                    known[piece] = n
            total += n
        return total


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens); a null text has none. The vocabulary's file is read where the driver runs and shipped to every executor."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(SparkFiles.get(name))
            n = [counter(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    return spread(df.select(key, text), df).mapInArrow(count, f"`{key}` {dict(df.dtypes)[key]}, tokens long")


def _pack(sizes: list[int], capacity: int, windows: int) -> tuple[list[int], list[int], set[int]]:
    """Window and offset of each item in turn, and the windows still open at the end: best fit among at most `windows`, the fullest goes when none fits."""
    room: list[tuple[int, int]] = []  # (space left, window)
    at, offset, n = [], [], 0
    for size in sizes:
        i = bisect_left(room, (size, -1))
        if i < len(room):
            space, w = room.pop(i)
        else:
            if len(room) >= windows:
                room.pop(0)
            space, w, n = capacity, n, n + 1
        at.append(w)
        offset.append(capacity - space)
        if space > size or size == 0:
            insort(room, (space - size, w))
    return at, offset, {w for _, w in room}


def _packed(items: DataFrame, shards: str, order: list[str], capacity: int, windows: int, n: int) -> DataFrame:
    """items (.., size, shard) with window (within shard), start, open."""
    kinds = dict(items.dtypes)
    rows = items.repartition(n, shards).sortWithinPartitions(shards, *order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, [shards]):
            ids = group.column(shards).to_numpy()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = group.slice(a, b - a)
                at, start, still = _pack(part.column("size").to_pylist(), capacity, windows)
                part = part.append_column("window", pa.array(at, pa.int64())).append_column("start", pa.array(start, pa.int64()))
                yield from part.append_column("open", pa.array([w in still for w in at])).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in items.columns) + ", window long, start long, open boolean"
    return rows.mapInArrow(pack, schema)


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 2048, windows: int = 64, per_shard: int = 100_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """A container and a place for each text of df (key unique), by tokens of a public tokenizer.

    A text of more than `capacity` tokens is cut into full containers and one rest; no other is cut. Rests
    are packed online, shard by shard in the order of a hash: at most `windows` containers are open, an
    item goes where it fits best, and when it fits nowhere the fullest is emitted. Containers still open
    at a shard's end are merged as items of the next level, shard by shard, until one shard is left.
    Shards hold about per_shard texts and depend on the rows alone, so a rerun gives the same containers.

    Output: key, piece (0..), first_token (of the text), tokens, container, position (token within it).
    Null and empty texts have a place of 0 tokens. Repeated rows are places of their own. An empty table gives no rows.
    """
    counts = checkpointed(token_counts(df, key, text, vocabulary))
    shards = max(1, -(-counts.count() // per_shard))
    n = partitions_for(counts)
    ordinal = F.xxhash64(F.lit("pack"), key)
    rest = counts.select(key, "tokens", (F.col("tokens") % capacity).alias("size"), F.floor(F.col("tokens") / capacity).alias("full"), ordinal.alias("order"))
    whole = rest.where("full > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select(
        key, "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"),
        F.concat(F.lit("text-"), F.col(key).cast("string"), F.lit("-"), F.col("piece")).alias("container"), F.lit(0).cast("long").alias("position"),
    )
    small = rest.where("size > 0 or full = 0").select(key, "full", "size", "order", F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).alias("shard"))
    level = checkpointed(_packed(small, "shard", ["order", key], capacity, windows, n))
    name = lambda k: F.concat_ws("-", F.lit(f"level{k}"), "shard", "window")
    placed = level.select(key, "full", "size", name(0).alias("container"), F.col("start").alias("position"))
    # Open containers become items; `moved` says where each went.
    k, opened = 0, level
    while True:
        size = F.max(F.col("start") + F.col("size")).alias("size")
        items = opened.where("open").groupBy("shard", "window").agg(size)
        last = shards == 1
        shards = -(-shards // 64)
        items = items.select(name(k).alias("was"), "size", F.floor(F.col("shard") / 64).alias("shard"))
        k += 1
        ordered = items.withColumn("order", -F.col("size"))
        opened = checkpointed(_packed(ordered, "shard", ["order", "was"], capacity, windows, min(n, shards)))
        moved = opened.select(F.col("was").alias("container"), name(k).alias("__to"), F.col("start").alias("__base"))
        placed = placed.join(moved, "container", "left").select(
            key, "full", "size", F.coalesce("__to", "container").alias("container"), (F.col("position") + F.coalesce("__base", F.lit(0))).alias("position")
        )
        if last:
            break
    rests = placed.select(key, F.col("full").alias("piece"), (F.col("full") * capacity).alias("first_token"), F.col("size").alias("tokens"), "container", "position")
    return whole.unionByName(rests)


def packing_fill(places: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: texts, tokens, containers used, the least number that could hold the tokens, and the share of the containers that is filled."""
    return places.agg(
        F.count_distinct(F.col(places.columns[0])).alias("texts"), F.sum("tokens").alias("tokens"), F.count_distinct("container").alias("containers"), F.ceil(F.sum("tokens") / capacity).alias("least"),
        F.round(F.sum("tokens") / (F.count_distinct("container") * capacity), 6).alias("fill"),
    )
