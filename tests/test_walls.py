"""Walls over a stream: visits in any order, stopped at any point, against the batch rule."""

import random

import pytest

from postsieve.operators.platforms import skip_walled_platform
from postsieve.streaming import walls

SCHEMA = "run_id string, platform_idx int, seq long, url string"


def visits(seed):
    rng = random.Random(seed)
    rows = []
    for run in ("a", "b", None):
        for platform in (0, 1, 2, None):
            places = rng.sample(range(1, 60), 20)
            rows += [(run, platform, s, f"https://x/{s}" + ("/login" if rng.random() < 0.1 else "")) for s in places]
    rows += [("a", 0, None, "https://x/login"), ("a", 1, None, "https://x/p"), ("a", 2, 3, None), ("b", 0, 5, "https://x/5"), ("b", 0, 5, "https://x/5")]
    rng.shuffle(rows)
    return rows


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    walls.stream_skip_walled(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = walls.read_visits(spark, f"{folder}/out", arriving.schema)
    assert found.columns == arriving.columns
    return sorted(map(tuple, found.collect()), key=repr)


def batch_rule(spark, rows):
    return sorted(map(tuple, skip_walled_platform(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order(spark, tmp_path, seed):
    rows = visits(seed)
    for k in range(3):
        add(spark, tmp_path, rows[k::3])
        # Stopped after every batch, and right for what has arrived.
        assert run(spark, tmp_path) == batch_rule(spark, [r for j in range(k + 1) for r in rows[j::3]])


def test_a_batch_done_again_replaces_itself(spark, tmp_path, monkeypatch):
    rows = visits(3)
    for k in range(3):
        add(spark, tmp_path, rows[k::3])
    lowest, calls = walls._lowest, []

    def broken(found, keys):
        calls.append(1)
        # The second batch fails between its walls and its visits.
        if len(calls) == 4:
            raise OSError("lost")
        return lowest(found, keys)

    with monkeypatch.context() as patch:
        patch.setattr(walls, "_lowest", broken)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    assert run(spark, tmp_path) == batch_rule(spark, rows)
    # A wall is stored once, and once more for each earlier one that came later.
    stored = spark.read.parquet(f"{tmp_path}/out/walls")
    assert stored.count() <= 3 * stored.select("run_id", "platform_idx").distinct().count()


def test_what_follows_a_known_wall_is_not_stored(spark, tmp_path):
    add(spark, tmp_path, [("a", 0, 1, "u"), ("a", 0, 2, "https://x/login")])
    assert run(spark, tmp_path) == [("a", 0, 1, "u")]
    add(spark, tmp_path, [("a", 0, 3, "v"), ("a", 1, 3, "v")])
    assert run(spark, tmp_path) == [("a", 0, 1, "u"), ("a", 1, 3, "v")]
    assert spark.read.parquet(f"{tmp_path}/out/visits").count() == 2


def test_empty_stream(spark, tmp_path):
    add(spark, tmp_path, [])
    assert run(spark, tmp_path) == []
