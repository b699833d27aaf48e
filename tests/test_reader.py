"""The union of sources: what fails stands apart."""

import json

from orrery.sources import reader


def test_one_broken_source_of_several_leaves_the_others(spark, tmp_path, monkeypatch):
    good = tmp_path / "a.jsonl"
    lines = ['{"frame_path": "f/1.png", "frame_index": "7", "timestamp_s": 1.5, "source_file": "v.mp4", "source_type": "video"}', "", "nope", "[1]", '{"x": 1}', '{"frame_path": "b.gif"}', '{"frame_path": " c.JPG ", "frame_index": true}', '{"frame_path": "é.png", "timestamp_s": "x"}']
    good.write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "bad.jsonl").write_bytes(b'{"frame_path": "\xff.png"}\n')
    (tmp_path / "p.PNG").write_bytes(b"")
    paths = [str(good), f"file://{tmp_path}/p.PNG", str(tmp_path / "bad.jsonl"), str(tmp_path / "missing.jsonl"), str(tmp_path / "gone.png"), str(tmp_path / "v.avi")]
    frames, failed = reader.collect(spark, paths)
    assert sorted(tuple(r)[:5] for r in frames.collect()) == sorted([("v.mp4", "video", "f/1.png", 7, 1.5), ("a.jsonl", "image", "c.JPG", 0, 0.0), ("a.jsonl", "image", "é.png", 0, 0.0), ("p.PNG", "image", paths[1], 0, 0.0), ("bad.jsonl", "image", "�.png", 0, 0.0)])
    reasons = sorted((r["source_file"], r["error"].split(":")[0]) for r in failed.collect())
    assert reasons == [("a.jsonl", "expected a JSON object"), ("a.jsonl", "invalid JSON"), ("a.jsonl", "missing frame_path"), ("a.jsonl", "unsupported image type"), ("gone.png", "FileNotFoundError"), ("missing.jsonl", "FileNotFoundError"), ("v.avi", "ValueError")]
    assert frames.rdd.getNumPartitions() == len(paths)
    assert reader.collect(spark, [])[0].count() == 0


def test_large_sources_come_in_batches(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(json.dumps({"frame_path": f"{i}.png", "frame_index": i}) + "\n" for i in range(30_001)))
    frames, failed = reader.collect(spark, [str(path)])
    assert frames.selectExpr("count(*)", "sum(frame_index)").first()[:] == (30_001, 30_000 * 30_001 // 2) and failed.count() == 0
