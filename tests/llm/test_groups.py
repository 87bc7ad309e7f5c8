"""Grouped splits: components against union-find, whole groups, shares near their aims."""

import pyarrow.parquet as pq

from pitchgrid.llm.group_split import components, group_split, image_groups, image_splits, min_cost_flow, round_bundles, split_quotas

IMAGES = "image_id long, video string, source_group string, has_ball boolean, root string, size long"


def roots(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, ties in rows:
        for t in ties:
            if t is not None:
                up[find(("i", i))] = find(t)
        find(("i", i))
    least = {}
    for i, _ in rows:
        r = find(("i", i))
        least[r] = min(i, least.get(r, i))
    return {i: least[find(("i", i))] for i, _ in rows}


def test_chains_stars_and_nulls(spark, rng):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)] + [("hub", f"s{i}") for i in range(200)] + [("self", "self")]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert len(got) == 91 + 201 + 1
    assert {got[f"n{i:03d}"] for i in range(91)} == {"n000"} and {got[f"s{i}"] for i in range(200)} == {"hub"} and got["self"] == "self"


def test_groups_and_splits(spark, rng):
    rows = []
    for i in range(600):
        v = rng.choice([None, f"E/v{rng.randrange(150)}.mp4"])
        g = rng.choice([None, f"e/g{rng.randrange(60)}.mp4", "e/hot.mp4"] if i % 3 == 0 else [None, f"e/g{rng.randrange(400)}.mp4"])
        rows.append((i, v if v is None or rng.random() < 0.7 else v.lower().replace("/", "\\"), g if g is None or rng.random() < 0.7 else "./" + g.upper(), rng.choice([True, False, None]), "x", 1))
    df = spark.createDataFrame(rows, IMAGES)
    fold = lambda p: None if p is None else p.lower().replace("\\", "/").removeprefix("./")
    want = roots([(r[0], [r[1] and ("v", fold(r[1])), r[2] and ("s", fold(r[2]))]) for r in rows])
    assert {r.image_id: r.group_id for r in image_groups(df).collect()} == want
    out = image_splits(df).collect()
    assert len(out) == 600 and {r.image_id for r in out} == set(want)
    by = {}
    for r in out:
        assert by.setdefault(r.group_id, r.split) == r.split and want[r.image_id] == r.group_id
    assert sorted(map(tuple, image_splits(df.repartition(3)).collect())) == sorted(map(tuple, out))
    assert image_splits(spark.createDataFrame([], IMAGES)).collect() == []


def test_shares(spark, data):
    out = image_splits(spark.read.parquet(f"{data}/manifest_images.parquet")).collect()
    n = pq.read_table(f"{data}/manifest_images.parquet").num_rows
    assert len(out) == n
    for split, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(r.split == split for r in out) / n - share) < 0.01


def test_flow_and_rounding():
    arcs = [[0, 2, 4, 0], [0, 3, 3, 0], [2, 4, 3, 1], [2, 5, 4, 3], [3, 4, 3, 1], [4, 1, 5, 0], [5, 1, 9, 0]]
    flow = min_cost_flow(6, arcs, 0, 1)
    assert sum(a[-1] for a in flow[:2]) == 7 and sum(a[3] * a[-1] for a in flow) == 5 * 1 + 2 * 3
    quotas = split_quotas({0: 1000, 1: 37}, (0.8, 0.1, 0.1))
    assert {p: sum(q) for p, q in quotas.items()} == {0: 1000, 1: 37}
    bundles = [(300, 0, 1), (50, 0, 4), (1, 0, 500), (1, 1, 37)]
    taken = round_bundles(bundles, quotas)
    assert [sum(t) for _, _, t in taken] == [1, 4, 500, 37]
    totals = [sum(size * t[s] for size, _, t in taken) for s in range(3)]
    assert all(abs(a - b) <= 2 for a, b in zip(totals, (829, 104, 104)))


def test_one_group(spark):
    df = spark.createDataFrame([(i, 0, True) for i in range(5)], "image_id long, group_id long, has_ball boolean")
    assert {r.split for r in group_split(df, "image_id", "has_ball").collect()} == {"train"}
