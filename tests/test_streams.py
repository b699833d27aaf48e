"""Sequences released from streams: any cut of the input gives the rows of the table."""

import random

import pytest

from orrery.streaming import sequences as streams

SCHEMA = "source_file string, ts timestamp, frame_index long, raw_classification string, stable_detail_signal boolean, previous_frame_delta double, future_frame_delta_3 double, horizontal_swipe_signal boolean, hp_area_card_split_signal boolean"


def frames(seed, sources=4, n=60):
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        at = dt.datetime(2024, 1, 1)
        kind = "detail"
        for i in range(n):
            at += dt.timedelta(milliseconds=rng.choice([100, 200, 900]) if rng.random() < 0.95 else 7000)
            kind = rng.choice(["detail", "appraisal", "list"]) if rng.random() < 0.15 else kind
            before, after = rng.choice([0.0, 0.001, 0.05, 0.07]) if rng.random() < 0.3 else 0.0, rng.choice([0.0, 0.05])
            rows.append((f"s{s}", at, i, kind, rng.random() < 0.97, before, after, rng.random() < 0.1, rng.random() < 0.03))
    return rows


def run(spark, folder, rows, cuts, jitter, seed):
    """The rows that a stream releases of files of random sizes, each row at most jitter places from its own; then a row far ahead moves the watermark on."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    order = [i for _, i in sorted((k + rng.uniform(0, jitter), i) for k, i in enumerate(order))]
    streams.use_state_store(spark)
    borders = sorted(rng.sample(range(1, len(order)), cuts)) + [len(order)]
    start = 0
    for n, end in enumerate(borders):
        spark.createDataFrame([rows[i] for i in order[start:end]], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start = end
    import datetime as dt

    for far in (1, 2, 3):
        spark.createDataFrame([("ahead", dt.datetime(2025, 1, far), far, "list", True, 0.0, 0.0, False, False)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
    name = f"released_{seed}"
    query = streams.released(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect()), query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("seed, cuts, jitter", [(1, 2, 0), (2, 6, 12)])
def test_any_cut_gives_the_rows_of_the_table(spark, tmp_path, seed, cuts, jitter):
    rows = frames(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got, left = run(spark, str(tmp_path), rows, cuts, jitter, seed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = sorted(tuple(r) for r in streams.closed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want and len(got) > 20
    assert left <= 10  # latches, and what is ahead


def test_closed_equals_a_loop(spark):
    rows = frames(7)
    want = []
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for source, held in by.items():
        moving, kind, last, run_ = False, None, None, []
        for _, at, i, raw, stable, p, f, swipe, split in sorted(held, key=lambda r: (r[1], r[2])):
            candidate = raw in ("detail", "appraisal") and stable
            goes = p <= 0.005 and f >= 0.04
            sets = candidate and (split or (raw == "appraisal" and p >= 0.04 and f >= 0.04) or (raw == "detail" and swipe and p >= 0.06 and f >= 0.04))
            holds = candidate and (goes or (raw == "appraisal" and p >= 0.032 and f >= 0.035) or (raw == "detail" and ((p >= 0.03 and f >= 0.035) or (p >= 0.06 and f >= 0.03))))
            moving = sets or (holds and moving)
            now = raw if candidate and not moving else None
            if run_ and (now != kind or (at - last).total_seconds() > 5):
                want.append((source, kind, run_[0], run_[-1], len(run_), run_))
                run_ = []
            if now:
                run_ = [*run_, i]
            kind, last = now, at
        if run_:
            want.append((source, kind, run_[0], run_[-1], len(run_), run_))
    assert sorted(tuple(r) for r in streams.closed(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(want)
