import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessella.streaming import sinks
from tessella.streaming.dedup import counts
from tessella.streaming.earliest import keep_earliest

SCHEMA = "i int, k string, t timestamp, x array<int>, fp string, given string"
OUT = "i int, k string, t timestamp, x array<int>, given string, fp string"


def fed(spark, folder, batches):
    """A stream that takes one batch of (i, k, minutes) after the other."""
    for n, rows in enumerate(batches):
        data = [(i, k, None if m is None else datetime(2024, 1, 1) + timedelta(minutes=m), [i], "mine", None) for i, k, m in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(spark, folder, stream):
    query = sinks.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    rows = sinks.read_batches(spark, f"{folder}/out", OUT).collect()
    return rows, query


def kept(spark, folder, batches, **options):
    options = {"period": "1 day", "wait": "1 hour"} | options
    rows, query = run(spark, folder, keep_earliest(fed(spark, folder, batches), F.col("k"), "t", "i", **options))
    return sorted((r.i, r.fp) for r in rows), rows, query


DAY = 24 * 60


def test_earliest_by_order_not_by_arrival(spark, tmp_path):
    batches = [
        [(1, "a", 600), (2, "b", 601)],
        [(3, "a", 560), (4, "a", 605), (5, "b", 601)],  # 3 is earlier than 1; 5 ties with 2 in time and comes after it in order
        [(6, "c", 720)],  # the watermark passes a and b
        [(7, "a", 500), (8, "b", 602), (9, "b", 900)],  # late, late, a copy
        [(10, "a", DAY + 5), (11, "b", DAY + 300)],  # the next period
        [(12, "z", 9 * DAY)],
    ]
    got, rows, query = kept(spark, str(tmp_path), batches)
    assert got == [(2, "b"), (3, "a"), (6, "c"), (10, "a"), (11, "b")]
    assert all(r.x == [r.i] and r.given is None and r.k == r.fp for r in rows)
    assert next(r.t for r in rows if r.i == 3) == datetime(2024, 1, 1, 9, 20)


def test_state_is_let_go(spark, tmp_path):
    batches = [[(n * 10 + j, f"k{n}-{j}", n * DAY + j) for j in range(10)] for n in range(6)]
    _, rows, query = kept(spark, str(tmp_path), batches)
    assert len(rows) == 50  # the last day's rows may still get earlier ones
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and held[-1] <= 20  # a key of the last day has a row and no more; all older days are gone


def test_nulls_repeats_and_empty_batches(spark, tmp_path):
    batches = [[(1, None, 1), (2, None, 1), (3, "a", None), (4, "", 2), (4, "", 2)], [], [(5, None, 3), (6, "zz", 5000)]]
    got, _, _ = kept(spark, str(tmp_path), batches)
    assert sorted(got, key=str) == sorted([(1, None), (2, None), (4, ""), (5, None)], key=str)
    assert kept(spark, str(tmp_path / "none"), [[]])[0] == []


def test_any_dealing_over_batches_gives_the_same(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice("abc"), r.randrange(3 * DAY)) for i in range(300)]
    want = {}
    for i, k, m in rows:
        want[(k, m // DAY)] = min(want.get((k, m // DAY), (m, i)), (m, i))
    for seed in range(2):
        r.shuffle(rows)
        batches = [rows[n::3] for n in range(3)] + [[(-1, "end", 30 * DAY)]]
        got, _, _ = kept(spark, str(tmp_path / str(seed)), batches, wait="10 days")
        assert got == sorted((i, k) for (k, _), (_, i) in want.items())


def test_counts_are_given_out_once_they_close(spark, tmp_path):
    batches = [[(1, "a", 5), (2, "a", 62)], [(3, "a", 7), (4, "b", 1)], [(5, "c", 200)], [(9, "c", 201)], [(6, "a", 8), (7, "c", 150)], [(8, "z", 5000)]]
    stream = counts(fed(spark, str(tmp_path), batches), "t", "k", "1 hour", "1 hour").select(F.hour("window.start").alias("h"), "k", "n")
    query = sinks.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    got = [(r.h, r.k, r.n) for r in sinks.read_batches(spark, f"{tmp_path}/out", "h int, k string, n bigint").collect()]
    # 6 comes after its hour was closed; 7 is within the hour that the watermark hasn't passed; the last hour is still open.
    assert sorted(got) == [(0, "a", 2), (0, "b", 1), (1, "a", 1), (2, "c", 1), (3, "c", 2)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 1


def test_a_replay_writes_nothing_twice(spark, tmp_path):
    folder, tries = str(tmp_path), []
    stream = fed(spark, folder, [[(n, "é", n), (n + 100, None, n)] for n in range(4)]).select("i", "k")

    def write(batch, to):
        tries.append(to[-1])
        if tries.count(to[-1]) == 1 and to[-1] == "1":
            sinks.write_jsonl_batch(batch.limit(1), to)
            raise OSError("lost half way")
        sinks.write_jsonl_batch(batch, to)
        if tries.count(to[-1]) == 1 and to[-1] == "2":
            raise OSError("lost after writing")

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            sinks.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", write).awaitTermination()
    sinks.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", write).awaitTermination()
    assert tries == ["0", "1", "1", "2", "2", "3"]
    got = sinks.read_batches(spark, f"{folder}/out", "i int, k string")
    assert sorted((r.i, r.k) for r in got.collect()) == sorted((i, "é" if i < 100 else None) for n in range(4) for i in (n, n + 100))
    assert {r.batch for r in got.collect()} == {0, 1, 2, 3}
    assert all('"k":null' in r.value for r in spark.read.text(f"{folder}/out/*").where("value like '%:10%'").collect())


def test_no_batch_yet(spark, tmp_path):
    assert sinks.read_batches(spark, str(tmp_path / "nothing"), "i int").columns == ["i", "batch"]
    assert sinks.whole_batches(spark, str(tmp_path / "nothing")) == []
    (tmp_path / "out" / "batch=000000000000").mkdir(parents=True)
    (tmp_path / "out" / "batch=000000000000" / "part-0.json").write_text('{"i": 1}')
    assert sinks.read_batches(spark, str(tmp_path / "out"), "i int").count() == 0  # it was not written to the end


def test_periods_by_another_time(spark, tmp_path):
    """A row just before a period's end is in the next one, where periods go by the nearest whole minute."""
    batches = [[(1, "a", 10), (2, "a", DAY - 0.25), (3, "a", DAY + 5), (4, "b", DAY - 0.75)], [(9, "z", 9 * DAY)]]
    nearest = F.timestamp_seconds(F.rint(F.unix_micros("t") / 60_000_000).cast("long") * 60)
    got, _, _ = kept(spark, str(tmp_path), batches, within=nearest)
    assert got == [(1, "a"), (2, "a"), (4, "b")]


def test_many_keys_are_few_pieces_of_state(spark, tmp_path):
    batches = [[(n, f"k{n}", n % 600) for n in range(600)], [(1000 + n, f"k{n}", DAY + n % 600) for n in range(600)], [(9999, "z", 9 * DAY)]]
    got, _, query = kept(spark, str(tmp_path), batches, shares=4)
    assert len(got) == 1200
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 40  # a value and a timer for each share and day, not for each key
