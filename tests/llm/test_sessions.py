"""Session versions against plain snapshots in Python, edges and late events."""

from __future__ import annotations

import random

import pytest

from weftlex.llm import sessions


def brute(events, gap):
    """All versions by cutting a user's whole past at every batch."""
    out = []
    for user in {e[0] for e in events}:
        own, standing = [e for e in events if e[0] == user], []
        for b in sorted({e[1] for e in own}):
            past = sorted((e for e in own if e[1] <= b), key=lambda e: e[2])
            runs = []
            for e in past:
                if runs and e[2] - runs[-1][-1][2] <= gap:
                    runs[-1].append(e)
                else:
                    runs.append([e])
            for r in runs:
                n_new = sum(e[1] == b for e in r)
                if n_new:
                    new = {"user": user, "batch": b, "start_s": r[0][2], "end_s": r[-1][2], "n_events": len(r), "n_new": n_new, "h_sum": sum(e[3] or 0 for e in r), "retracted_batch": None, "retracted_start_s": None}
                    inside = [v for v in standing if v["start_s"] >= new["start_s"] and v["end_s"] <= new["end_s"]]
                    for v in inside:
                        v["retracted_batch"], v["retracted_start_s"] = b, new["start_s"]
                        standing.remove(v)
                    new["n_retracted"] = len(inside)
                    standing.append(new)
                    out.append(new)
    return sorted(out, key=lambda v: (v["user"], v["batch"], v["start_s"]))


def found(spark, events, **options):
    df = spark.createDataFrame(events, "user long, batch long, s long, h long")
    got = [r.asDict() for r in sessions.merged(df, **options).collect()]
    return sorted(got, key=lambda v: (v["user"], v["batch"], v["start_s"]))


@pytest.mark.parametrize(("seed", "gap", "late", "options"), [(1, 420, 3, {}), (2, 420, 3, {"shift": 1, "levels": 3}), (3, 900, 2, {"shift": 1, "levels": 1, "batch_seconds": 400}), (4, 700, 0, {"shift": 2, "levels": 2})])
def test_versions_equal_snapshots(spark, seed, gap, late, options):
    draw, size = random.Random(seed), options.get("batch_seconds", 3600)
    events = []
    for user, n, span in ((1, 90, 30_000), (2, 160, 40_000), (3, 5, 20_000), (4, 1, 1)):
        for _ in range(n):
            s = draw.randrange(-2000, span)
            events.append((user, s // size + draw.choice([0, 0, draw.randint(0, late)]), s, draw.randrange(1 << 32)))
    # one unbroken chain over many blocks, some of its events late
    events += [(5, k * 300 // size + (late if k % 7 == 0 else 0), k * 300, k) for k in range(120)]
    events += events[:40]
    assert found(spark, events, gap=gap, late=late, **options) == brute(events, gap)
    assert found(spark, events, gap=gap, **options) == brute(events, gap)


def test_edges(spark):
    assert found(spark, []) == []
    kept = [(1, 0, 10, None), (1, 0, 10, 5)]
    rows = [*kept, (None, 0, 10, 1), (1, None, 10, 1), (1, 0, None, 1)]
    assert found(spark, rows) == brute(kept, 420)
    with pytest.raises(Exception, match="comes too late"):
        found(spark, [(1, 9, 10, 1)], late=3)
    turns = spark.createDataFrame([(None, 1, "x"), (8, None, "x"), (8, 1, None), (8, 1, "y")], "conv_id long, turn long, batch string")
    got = sessions.conversation_sessions(turns).collect()
    assert len(got) == 1 and got[0].n_events == 2 and got[0].n_retracted == 0
    assert sessions.conversation_sessions(turns.limit(0)).count() == 0
