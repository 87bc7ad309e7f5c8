"""Problem 7: splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.paths import one_spelling
from pitchgrid.llm.ranking import hash_rank, salted
from pitchgrid.session import checkpointed

SPLITS = ("train", "val", "test")


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, root): the smallest node each node of edges(u, v) is connected to, by alternating large and small stars.

    Every round is two joins on the nodes and one checkpoint; nothing is gathered on the driver.
    """
    now = checkpointed(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    state = None
    for _ in range(limit):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").distinct())
        total = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if total == state:
            break
        state = total
    else:
        raise RuntimeError("the stars did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def tied_groups(df: DataFrame, record: str, ties: Sequence[Column]) -> DataFrame:
    """(record, group_id): records that share a tie value, also through others; group_id is the group's smallest record.

    Null ties nothing. A record (unique) without ties is a group of its own.
    """
    names = [F.concat(F.lit(f"{i}|"), t) for i, t in enumerate(ties)]
    rows = df.select(F.col(record), *[c.alias(f"__t{i}") for i, c in enumerate(names)])
    cols = [f"__t{i}" for i in range(len(names))]
    rows = checkpointed(rows.withColumn("__node", F.coalesce(*cols)))  # names are spelt once
    edges = None
    for c in cols:
        one = rows.where(F.col(c).isNotNull()).select(F.col("__node").alias("u"), F.col(c).alias("v")).distinct()
        edges = one if edges is None else edges.union(one)
    roots = components(edges.distinct())
    tied = rows.where("__node is not null").join(roots.withColumnRenamed("node", "__node"), "__node").select(record, "root")
    heads = tied.groupBy("root").agg(F.min(record).alias("group_id"))
    return tied.join(heads, "root").select(record, "group_id").union(rows.where("__node is null").select(record, F.col(record).alias("group_id")))


def min_cost_flow(n: int, arcs: list[list[int]], source: int, sink: int) -> list[list[int]]:
    """Largest flow of least cost by successive cheapest paths; arcs: [from, to, capacity, cost]; returns them with their flow."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, left, price = [], [], []
    for a, b, cap, cost in arcs:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            graph[x].append(len(to))
            to.append(y)
            left.append(c)
            price.append(w)
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[source] = 0
        queue = [source]
        while queue:
            x = queue.pop(0)
            for e in graph[x]:
                if left[e] > 0 and far[x] + price[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[x] + price[e], e
                    if to[e] not in queue:
                        queue.append(to[e])
        if far[sink] == float("inf"):
            return [[*arc, left[2 * i + 1]] for i, arc in enumerate(arcs)]
        push, x = None, sink
        while x != source:
            push = left[via[x]] if push is None else min(push, left[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            left[via[x]] -= push
            left[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def split_quotas(amounts: dict[int, int], shares: Sequence[float]) -> dict[int, list[int]]:
    """Records of each profile for each split, by min-cost flow: least deviation of each split's total, then of its profiles."""
    total, profiles, k = sum(amounts.values()), sorted(amounts), len(shares)
    aim = lambda n: [round(n * s) for s in shares[1:]]
    whole = lambda n: [n - sum(aim(n)), *aim(n)]
    source, sink, first = 0, 1, 2
    split = lambda s: first + len(profiles) + s
    arcs = []
    for i, p in enumerate(profiles):
        arcs.append([source, first + i, amounts[p], 0])
        for s, want in enumerate(whole(amounts[p])):
            arcs += [[first + i, split(s), max(0, want), 0], [first + i, split(s), amounts[p], 1]]
    for s, want in enumerate(whole(total)):
        arcs += [[split(s), sink, max(0, want), 0], [split(s), sink, total, 10]]
    out = {p: [0] * k for p in profiles}
    for a, b, _, _, flow in min_cost_flow(first + len(profiles) + k, arcs, source, sink):
        if first <= a < first + len(profiles):
            out[profiles[a - first]][b - first - len(profiles)] += flow
    return out


def round_bundles(bundles: list[tuple[int, int, int]], quotas: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
    """Whole components for each split of each bundle (size, profile, count), largest first, so that small ones even out."""
    left = {p: list(q) for p, q in quotas.items()}
    over = [sum(q[s] for q in quotas.values()) for s in range(len(SPLITS))]
    out = []
    for size, profile, count in sorted(bundles, key=lambda b: (-b[0], b[1])):
        want = [max(0, x) for x in left[profile]]
        all_of = sum(want) or 1
        take = [int(count * w // all_of) for w in want]
        for s, n in enumerate(take):
            left[profile][s] -= n * size
            over[s] -= n * size
        for _ in range(count - sum(take)):
            s = max(range(len(SPLITS)), key=lambda s: (over[s] + left[profile][s], -s))
            take[s] += 1
            left[profile][s] -= size
            over[s] -= size
        out.append((size, profile, take))
    return out


def group_split(groups: DataFrame, record: str, positive: str, shares: Sequence[float] = (0.8, 0.1, 0.1), levels: int = 4, salt: str = "split") -> DataFrame:
    """(record, group_id, split) for groups(record, group_id, positive).

    Groups of the same size and the same share of positives (in `levels` steps) form a bundle. A min-cost
    flow settles how many records of each profile go to each split, rounding gives whole groups, and
    within a bundle the groups' salted hashes choose. Only the bundles' counts reach the driver: of N
    records there are at most sqrt(2N) different sizes, so at most (levels + 1) * sqrt(2N) rows.
    """
    groups = checkpointed(groups)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.coalesce(F.col(positive).cast("int"), F.lit(0))).alias("__p"))
    sizes = sizes.select("group_id", "size", F.round(F.col("__p") * levels / F.col("size")).cast("int").alias("profile"))
    bundles = [(r["size"], r["profile"], r["n"]) for r in sizes.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n")).collect()]
    amounts: dict[int, int] = {}
    for size, profile, count in bundles:
        amounts[profile] = amounts.get(profile, 0) + size * count
    taken = round_bundles(bundles, split_quotas(amounts, shares)) if bundles else []
    rows = [(size, profile, n[0], n[0] + n[1]) for size, profile, n in taken]
    limits = groups.sparkSession.createDataFrame(rows, "size long, profile int, __a long, __b long")
    ranked = hash_rank(sizes.withColumn("__h", salted(salt, F.col("group_id"))), ["size", "profile"], "__h", ["group_id"])
    split = F.when(F.col("__rank") <= F.col("__a"), SPLITS[0]).when(F.col("__rank") <= F.col("__b"), SPLITS[1]).otherwise(SPLITS[2])
    chosen = ranked.join(limits, ["size", "profile"]).select("group_id", split.alias("split"))
    return groups.join(chosen, "group_id").select(record, "group_id", "split")


def image_groups(images: DataFrame) -> DataFrame:
    """(image_id, group_id): images tied by video or source_group apart from spelling."""
    return tied_groups(images, "image_id", [one_spelling(F.col("video")), one_spelling(F.col("source_group"))])


def image_splits(images: DataFrame) -> DataFrame:
    """(image_id, group_id, split) for every image, 80/10/10 of the images as near as groups allow."""
    return group_split(image_groups(images).join(images.select("image_id", "has_ball"), "image_id"), "image_id", "has_ball")
