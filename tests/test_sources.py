"""Sources, sinks and streams, on small files."""

import json

import pytest

from tallyloom.plans import matching as plans
from tallyloom.sources import files
from tallyloom.streaming import results


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def shard(*rows):
    return {"test": {"results": [dict(instance_id=i, score=s) for i, s in rows]}}


def test_eval_shards_lose_their_shard_suffix(spark, tmp_path):
    put(tmp_path / "run/base__shard01of02/a.json", shard(("p1", 1.0)))
    put(tmp_path / "run/base__shard02of02/a.json", shard(("p2", 0.5)))
    rows = files.read_eval_shards(spark, [f"{tmp_path}/run"]).select("condition", "instance_id", "score").collect()
    assert sorted(map(tuple, rows)) == [("base", "p1", 1.0), ("base", "p2", 0.5)]


def test_rescored_report_is_exploded(spark, tmp_path):
    put(tmp_path / "r.json", {"records": {"a": [{"instance_id": "p1", "score": 1.0, "old_score": 0.5}], "b": []}})
    assert [tuple(r) for r in files.read_rescored(spark, f"{tmp_path}/r.json").select("condition", "score", "old_score").collect()] == [("a", 1.0, 0.5)]


def test_missing_split_names_its_file(spark, tmp_path):
    put(tmp_path / "train.jsonl", '{"messages": [{"role": "user", "content": "x"}], "tools": null}\n\n')
    with pytest.raises(FileNotFoundError, match="validation.jsonl"):
        files.read_sft(spark, str(tmp_path))
    assert [r["split"] for r in files.read_sft(spark, str(tmp_path), ("train",)).collect()] == ["train"]


def test_answers_without_a_file_are_errors(spark, tmp_path):
    put(tmp_path / "p1.txt", "def solve():\n    pass")
    put(tmp_path / "stranger.txt", "x")
    got = files.read_answers(spark, str(tmp_path), spark.createDataFrame([("p1",), ("p2",)], "instance_id string")).collect()
    assert sorted((r["instance_id"], r["status"], r["score"]) for r in got) == [("p1", None, None), ("p2", "gen_error", -0.5)]


def test_sinks_refuse_to_overwrite_and_keep_the_least_cost(spark, tmp_path):
    df = spark.createDataFrame([("p1", 2.0), ("p1", 1.0)], "instance_id string, best_cost double")
    files.save_best_known(df, f"{tmp_path}/best")
    assert [tuple(r) for r in files.load_best_known(spark, f"{tmp_path}/best").collect()] == [("p1", 1.0)]
    files.write_guarded(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_guarded(df, f"{tmp_path}/out")
    files.write_guarded(df, f"{tmp_path}/out", force=True)
    split = spark.createDataFrame([(i, "train" if i % 3 else "validation") for i in range(9)], "id int, split string")
    files.write_splits(split, f"{tmp_path}/splits", ["id"])
    assert spark.read.json(f"{tmp_path}/splits").groupBy("split").count().orderBy("split").collect() == [("train", 6), ("validation", 3)]


def test_result_stream_counts_each_pair_once(spark, tmp_path):
    put(tmp_path / "in/base__shard01of01/a.json", shard(("p1", 1.0), ("p2", 0.0)))
    put(tmp_path / "in/base__shard01of01/b.json", shard(("p1", 1.0)))
    feed = results.stream_results(spark, f"{tmp_path}/in")
    run = feed.writeStream.format("memory").queryName("feed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(60)
    assert sorted(r["instance_id"] for r in spark.table("feed").collect()) == ["p1", "p2"]


def test_effects_have_intervals_around_their_means(spark):
    for r in plans.diagnose_effects(spark, "/root/testdata/sf0.001").collect():
        assert r["lo"] <= r["hi"] and r["significant"] == (r["lo"] > 0 or r["hi"] < 0)
