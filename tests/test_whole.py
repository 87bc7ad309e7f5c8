"""Queries against what their operator promises in full, by hand-made rows and brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pitchgrid.operators import dataset, quality
from pitchgrid.plans.dataset_queries import review_gap, run_summary
from pitchgrid.session import checkpointed
from tests.test_match import det, goal_rows


@pytest.mark.parametrize(("source", "confirmed"), [(None, 1), ("goal_geometry", 0)])
def test_confirmed_goals_reach_the_run_summary(spark, source, confirmed):
    s = checkpointed(run_summary(det(spark, *goal_rows(source))))
    row = s.first()
    assert (row.goal_candidates, row.goals_confirmed) == (1, confirmed)
    assert quality.claim_rows(s).where("claim = 'goal_scoring'").first().status == ("ready" if confirmed else "review")
    assert quality.issue_rows(s).where(F.col("code") == "unconfirmed_goal_candidates").count() == 1 - confirmed


def round_robin(rows, gap, tier, limit):
    """The sampler as a loop over the groups, (group, frame, id) rows."""
    dig = lambda *p: hashlib.sha256("\0".join(map(str, ("7", *p))).encode()).hexdigest()
    left = {}
    for g, f, i in sorted(rows, key=lambda r: dig(tier, r[0], r[2])):
        left.setdefault(g, []).append((f, i))
    out, taken = [], {g: [] for g in left}
    while True:
        before = len(out)
        for g in sorted(left, key=lambda g: dig(tier, "group", g)):
            hit = next((r for r in left[g] if all(abs(r[0] - o) >= gap for o in taken[g])), None)
            if hit is not None and len(out) < limit:
                left[g].remove(hit)
                taken[g].append(hit[0])
                out.append(hit[1])
        if len(out) == before:
            return out


def test_gap_sampler_against_loop(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(("a.mp4", "b.mp4", "b.mp4", "c.mp4")), rnd.randrange(1500), rnd.choice((True, False, None))) for i in range(400)]
    spark.createDataFrame([(i, None if i % 9 == 0 else g, g.replace(".", "_f000000-039999."), f, b) for i, g, f, b in rows], "image_id long, source_group string, video string, frame_index long, has_ball boolean").write.parquet(f"{tmp_path}/manifest_images.parquet")
    got = review_gap(spark, str(tmp_path)).collect()
    for task, tier, ball in (("verify_mask", "positive", True), ("verify_absence", "negative", False)):
        part = [(g, f, i) for i, g, f, b in rows if bool(b) == ball]
        want = round_robin(part, 30, tier, 10**9)
        mine = sorted((r for r in got if r.task == task), key=lambda r: (r.turn, r.group_digest))
        assert [r.image_id for r in mine] == want and max(r.turn for r in mine) > 12
        few = dataset.balanced_take_with_gap(spark.createDataFrame(part, "g string, f long, i long"), "g", F.col("i"), "f", 30, 17, tier=tier)
        assert [r.i for r in few.orderBy("turn", "group_digest").collect()] == want[:17]
