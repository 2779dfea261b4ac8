"""Saving with manifests, chunks, packing, incremental runs and shares over time."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from palimpsest.operators import incremental, packing
from palimpsest.operators.selection import job_progress
from palimpsest.settings import Settings
from palimpsest.sources import sinks
from palimpsest.sources.chunks import chunk_digests, chunk_ranges, content_chunks, read_chunks
from palimpsest.streaming.shares import handle_shares

RESULTS = "uri string, relative_path string, output_name string, content binary"
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
sha = lambda b: hashlib.sha256(b).hexdigest()


def on_disk(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if sinks.MANIFESTS not in d and not f.endswith(".crc"))


@pytest.fixture
def results(spark):
    rows = [(f"u{i}", ["a/b", "", None, "../c/./d/"][i % 4], f"n{i}.txt", bytes([i]) * (i * 10) if i != 5 else None) for i in range(12)]
    return spark.createDataFrame(rows, RESULTS).repartition(3)


def test_saved_files_are_listed(spark, results, tmp_path):
    progress = Observation("saving")
    saved = sinks.save_files(results, str(tmp_path), "job-1", progress)
    got = {r.uri: r for r in saved.collect()}
    assert len(got) == 12 and got["u5"].status == "error" and got["u5"].error == "no content" and got["u5"].output_path is None
    assert [got[f"u{i}"].place for i in range(4)] == ["a/b/n0.txt", "n1.txt", "n2.txt", "c/d/n3.txt"]
    for i in range(12):
        if i != 5:
            with open(got[f"u{i}"].output_path, "rb") as f:
                assert f.read() == bytes([i]) * (i * 10)
            assert (got[f"u{i}"].size_bytes, got[f"u{i}"].sha256) == (i * 10, sha(bytes([i]) * (i * 10)))
    assert on_disk(tmp_path) == sorted(r.place for r in got.values() if r.status == "ok")
    counted = job_progress(saved.withColumn("g", F.lit(1)), "g").first()
    assert {k: progress.get[k] for k in ("done", "failed", "total")} == {k: counted[k] for k in ("done", "failed", "total")} == {"done": 11, "failed": 1, "total": 12}
    assert progress.get["bytes"] == sum(10 * i for i in range(12) if i != 5)


def test_a_listed_job_is_not_run_again(spark, results, tmp_path):
    first = rows_of(sinks.save_files(results, str(tmp_path), "once"))
    broken = results.withColumn("content", F.raise_error(F.lit("read again")).cast("binary"))
    assert rows_of(sinks.save_files(broken, str(tmp_path), "once")) == first


def test_names_of_other_jobs_are_left_alone(spark, results, tmp_path):
    first = {r.uri: r for r in sinks.save_files(results, str(tmp_path), "one").collect()}
    second = {r.uri: r for r in sinks.save_files(results.withColumn("content", F.encode(F.lit("other"), "UTF-8")), str(tmp_path), "two").collect()}
    assert not {r.place for r in first.values() if r.status == "ok"} & {r.place for r in second.values()}
    with open(first["u7"].output_path, "rb") as f:
        assert f.read() == bytes([7]) * 70
    assert sinks.saved_files(spark, str(tmp_path)).count() == 24 and sinks.saved_files(spark, str(tmp_path), "two").count() == 12


def test_a_failed_run_is_not_listed_and_can_be_repeated(spark, results, tmp_path):
    """A job that dies after some files were written leaves nothing to readers; the next run of it lists all; what else remains is swept."""
    folder = str(tmp_path)
    dying = results.withColumn("content", F.when(F.col("uri") == "u11", F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        sinks.save_files(dying.coalesce(1).sortWithinPartitions("uri"), folder, "again")
    assert sinks.saved_files(spark, folder).count() == 0
    (tmp_path / "a").mkdir(exist_ok=True)
    (tmp_path / "a" / f"{sinks.PENDING}0123").write_bytes(b"half")  # what a killed process leaves
    (tmp_path / "empty").write_bytes(b"")
    saved = sinks.save_files(results, folder, "again")
    assert saved.where("status = 'ok'").count() == 11
    now = int(time.time() * 1000) + 60_000
    assert sinks.sweep(spark, folder, now - 10_000_000).count() == 0  # nothing is that old
    swept = {(os.path.basename(r.path), r.reason) for r in sinks.sweep(spark, folder, now).where("reason <> 'staged'").collect() if not r.path.endswith(".crc")}
    assert swept == {(f"{sinks.PENDING}0123", "draft"), ("empty", "unlisted")}
    assert on_disk(tmp_path) == sorted(r.place for r in saved.where("status = 'ok'").collect())
    assert rows_of(sinks.saved_files(spark, folder).drop("job")) == rows_of(saved.drop("job"))


def test_equal_names_are_an_error_of_the_job(spark, tmp_path):
    twice = spark.createDataFrame([("u", "d", "same.txt", b"1"), ("v", "./d", "same.txt", b"2")], RESULTS)
    with pytest.raises(ValueError, match="d/same.txt"):
        sinks.save_files(twice, str(tmp_path), "twice")
    assert sinks.saved_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="no name"):
        sinks.save_files(twice, str(tmp_path), "../up")
    assert sinks.save_files(twice.limit(0), str(tmp_path), "none").count() == 0


def test_files_of_many_chunks(spark, tmp_path):
    rng = random.Random(1)
    contents = [(f"u{i}", "d", f"{i}.bin", rng.randbytes(n)) for i, n in enumerate([0, 1, 99, 100, 101, 1000, 4321])]
    chunks = content_chunks(spark.createDataFrame(contents, RESULTS), 100)
    assert sorted((r.uri, r.n_chunks) for r in chunks.select("uri", "n_chunks").distinct().collect()) == [(f"u{i}", n) for i, n in enumerate([1, 1, 1, 1, 2, 10, 44])]
    want = sorted((u, len(c), sha(c)) for u, _, _, c in contents)
    assert rows_of(chunk_digests(chunks.repartition(5)).select("uri", "size_bytes", "sha256")) == want
    saved = sinks.save_files(chunks.repartition(5), str(tmp_path / "made"), "made")
    assert rows_of(saved.select("uri", "size_bytes", "sha256")) == want
    copied = sinks.copy_files(saved.select(F.col("output_path").alias("uri"), "place").selectExpr("uri", "'' AS relative_path", "place AS output_name"), str(tmp_path / "copied"), "copied")
    assert sorted((r.size_bytes, r.sha256) for r in copied.collect()) == sorted(w[1:] for w in want)
    ranges = read_chunks(saved.select("uri", "output_path", "size_bytes"), 64, "output_path")
    assert rows_of(chunk_digests(ranges).select("uri", "size_bytes", "sha256")) == want
    assert ranges.agg(F.max(F.length("content"))).first()[0] == 64


def test_missing_chunks_and_files_are_errors(spark, tmp_path):
    rows = [("gap", 0, 3, b"a"), ("gap", 2, 3, b"c"), ("end", 0, 2, b"a"), ("null", 0, 2, b"a"), ("null", 1, 2, None), ("ok", 1, 2, b"b"), ("ok", 0, 2, b"a")]
    chunks = spark.createDataFrame(rows, "uri string, chunk_no int, n_chunks int, content binary").repartition(3)
    got = {r.uri: r for r in chunk_digests(chunks).collect()}
    assert got["ok"].sha256 == sha(b"ab") and all(got[u].sha256 is None and got[u].error for u in ("gap", "end", "null"))
    saved = {r.uri: r for r in sinks.save_files(chunks.withColumns({"relative_path": F.lit("x"), "output_name": F.col("uri")}), str(tmp_path), "gaps").collect()}
    assert {u: r.status for u, r in saved.items()} == {"ok": "ok", "gap": "error", "end": "error", "null": "error"}
    assert on_disk(tmp_path) == ["x/ok"]
    missing = spark.createDataFrame([(f"{tmp_path}/none", 10), (f"{tmp_path}/x/ok", 5), (f"{tmp_path}/x/ok", None)], "uri string, size_bytes bigint")
    assert sorted(r.error is not None for r in read_chunks(missing).collect()) == [True, True]  # not there; shorter than listed; size unknown
    copied = sinks.copy_files(spark.createDataFrame([(f"{tmp_path}/none", "", "n")], "uri string, relative_path string, output_name string"), str(tmp_path / "c"), "c").first()
    assert copied.status == "error" and on_disk(tmp_path / "c") == []
    # twice the same chunk counts once
    assert chunk_digests(chunks.where("uri = 'ok'").unionByName(chunks.where("uri = 'ok'"))).first().sha256 == sha(b"ab")


def test_ranges_of_large_files(spark):
    files = spark.createDataFrame([("big", 10 * (1 << 30) + 1), ("empty", 0), ("unknown", None)], "uri string, size_bytes bigint")
    rows = chunk_ranges(files, 1 << 30)
    assert [(r.chunk_no, r.start, r.length) for r in rows.where("uri = 'big'").orderBy("chunk_no").collect()][-1] == (10, 10 * (1 << 30), 1)
    assert rows_of(rows.where("uri <> 'big'").select("uri", "chunk_no", "n_chunks", "length")) == [("empty", 0, 1, 0)]


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_packing(spark, tasks):
    rng = random.Random(tasks)
    rows = [(f"u{i:05}", rng.choice([None, 0, rng.randrange(1000), rng.randrange(100_000)])) for i in range(500)]
    packed = packing.pack(spark.createDataFrame(rows, "uri string, size_bytes bigint").repartition(5), tasks, file_bytes=10)
    got = [tuple(r) for r in packed.select("uri", "weight", "task").orderBy("uri").collect()]
    assert [g[:2] for g in got] == [(u, (n or 0) + 10) for u, n in rows]
    numbers = [g[2] for g in got]
    assert numbers == sorted(numbers) and numbers[-1] < tasks
    mean, total = sum(g[1] for g in got) / tasks, {}
    for _, weight, task in got:
        total[task] = total.get(task, 0) + weight
    assert all(total[t] < mean + [g for g in got if g[2] == t][-1][1] for t in total)
    assert packing.dealt(packed, tasks).select((F.spark_partition_id() == F.col("task")).alias("own")).distinct().collect() == [(True,)]


def test_packing_of_nothing_and_ties(spark):
    files = spark.createDataFrame([("u", 5)] * 6 + [("v", None)], "uri string, size_bytes bigint")
    assert packing.pack(files.limit(0), 3).collect() == []
    assert sorted(r.task for r in packing.pack(files, 3, file_bytes=0).where("uri = 'u'").collect()) == [0, 0, 1, 1, 2, 2]
    assert rows_of(packing.pack(files.where("uri = 'v'"), 3, file_bytes=0).select("task")) == [(0,)]
    assert packing.tasks_for(101, 10) == 11 and packing.tasks_for(0, 10) == 1


def test_incremental_runs_compute_what_changed(spark, tmp_path):
    files = spark.createDataFrame([(f"u{i}", "image/png", i) for i in range(10)], "uri string, mime_type string, size_bytes bigint")
    attrs = spark.createDataFrame([(f"u{i}", k, "Make", f"m{i}") for i in range(10) for k in (1, 2)], "uri string, entry_ord int, key string, value string")
    store, computed = str(tmp_path / "store"), []

    def results(held):
        def compute(uris):
            computed.append(sorted(r.uri for r in uris.collect()))
            return held.join(uris, "uri", "left_semi").select("uri", F.upper("value").alias("value"))

        return compute

    def run(found, held, **how):
        out, changed = incremental.refresh(store, incremental.fingerprints(found, held, **how), results(held))
        assert rows_of(out) == rows_of(held.join(found.select("uri"), "uri", "left_semi").select("uri", F.upper("value").alias("value")))
        return {c: n for c, n in changed.groupBy("change").count().collect()}

    assert run(files, attrs) == {"new": 10}
    assert run(files.repartition(3), attrs.repartition(4).orderBy(F.desc("value"))) == {"same": 10} and computed[-1] == []
    edited = attrs.withColumn("value", F.when((F.col("uri") == "u3") & (F.col("entry_ord") == 2), "new").otherwise(F.col("value")))
    fewer = files.where("uri <> 'u4'").unionByName(spark.createDataFrame([("v", "image/png", None)], files.schema))
    assert run(fewer, edited.where("uri <> 'u4'")) == {"new": 1, "changed": 1, "removed": 1, "same": 8} and computed[-1] == ["u3", "v"]
    with pytest.raises(ZeroDivisionError):
        incremental.refresh(store, incremental.fingerprints(files, attrs), lambda uris: 1 / 0)
    assert incremental.stored(spark, store)[1].count() == 18  # the last whole version stands
    assert run(fewer, edited.where("uri <> 'u4'"), settings=Settings(seed="1")) == {"changed": 10} and len(computed[-1]) == 10
    plans = fewer.select("uri", F.when(F.col("uri") == "u1", "x").alias("make"))
    assert run(fewer, edited.where("uri <> 'u4'"), settings=Settings(seed="1"), plans=plans) == {"changed": 10}
    assert run(fewer, edited.where("uri <> 'u4'"), settings=Settings(seed="1"), plans=plans.withColumn("make", F.when(F.col("uri") == "u2", "y").otherwise(F.col("make")))) == {"changed": 1, "same": 9}
    assert incremental.stored(spark, str(tmp_path / "none")) is None


def test_shares_are_handled_once_over_batches_and_restarts(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "share_id int, signature string"
    for part in ([(1, "a"), (2, "b")], [(3, "a"), (4, None), (5, "a")], [(6, "c"), (7, None), (8, "b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        handle_shares(stream, out, checkpoint).awaitTermination()
        assert all(r["count"] == 1 for r in spark.read.parquet(out).groupBy("signature").count().collect())
    assert sorted((r.signature or "") for r in spark.read.parquet(out).collect()) == ["", "a", "b", "c"]


def test_shares_are_forgotten_after_a_time(spark, tmp_path):
    arriving, schema = str(tmp_path / "in"), "at timestamp, signature string"
    got = []
    for moment in ("2024-01-01 10:00:00", "2024-01-01 10:05:00", "2024-01-01 12:00:00", "2024-01-01 14:00:00"):
        spark.createDataFrame([(moment, "a")], "at string, signature string").select(F.col("at").cast("timestamp"), "signature").coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        handle_shares(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "at", "10 minutes").awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got[1] == 1 and got[-1] > 1
