"""Streams that keep state, break off and go on."""

from __future__ import annotations

import zlib
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from episodia.checks import registry, views
from episodia.session import STATE_STORE, materialize, small_tasks
from episodia.streaming import run_stream as rs
from episodia.streaming.ledger import Ledger
from episodia.streaming.running_score import running_score, running_score_stream

OUTPUTS = "id string, output string, finish_reason string, time timestamp"


class Stream:
    """Files of outputs that arrive one after the other."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, *rows):
        timed = self.spark.createDataFrame([(i, o, r, t) for i, o, r, t in rows], "id string, output string, finish_reason string, t string")
        timed.select("id", "output", "finish_reason", F.to_timestamp("t").alias("time")).coalesce(1).write.mode("append").json(f"{self.folder}/in")

    def frame(self):
        return self.spark.readStream.schema(OUTPUTS).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in")


@pytest.fixture
def asked(spark):
    rows = [(f"q{k}", f"w{k // 4}", "7", k // 3) for k in range(9)]
    return materialize(spark.createDataFrame(rows, "id string, context_window_id string, answer string, batch_id long"))


def box(n):
    return f"\\boxed{{{n}}}"


def shown(spark, folder):
    return sorted((r["batch_id"], r["n"], r["n_missing"], r["rows_so_far"], round(r["score_so_far"], 6))
                  for r in running_score(spark, folder).collect())


def test_batches_count_in_order_when_full_or_overdue(spark, asked, tmp_path):
    stream, run = Stream(spark, tmp_path), f"{tmp_path}/run"

    def go():
        running_score_stream(stream.frame(), asked.drop("batch_id"), asked.select("id", "batch_id"), run, f"{tmp_path}/c",
                             late="1 minute", patience=3600).awaitTermination()
        return shown(spark, run)

    noon = "2024-01-01 12:00:00"
    # the second batch is full first and waits for the first
    stream.add(*[(f"q{k}", box(7), "stop", noon) for k in (3, 4, 5)], ("q0", box(8), "stop", noon), ("q0", box(7), "stop", noon))
    assert go() == []
    # the first closes without q2; a repeat of q3 changes nothing, an empty output does not count as come
    stream.add(("q1", box(7), "stop", noon), ("q3", "no", "stop", noon), ("q2", None, "stop", noon), ("q6", box(7), "stop", "2024-01-01 12:10:00"))
    assert go() == []
    stream.add(("nobody", box(1), "stop", "2024-01-01 13:05:00"))
    both = [(0, 3, 1, 3, round(1.75 / 3, 6)), (1, 3, 0, 6, round(4.75 / 6, 6))]
    assert go() == both
    # too late for its batch; the third closes with two missing
    stream.add(("q2", box(7), "stop", "2024-01-01 13:04:30"), ("nobody", box(1), "stop", "2024-01-02 12:00:00"))
    assert go() == [*both, (2, 3, 2, 9, round(5.75 / 9, 6))]
    assert go() == [*both, (2, 3, 2, 9, round(5.75 / 9, 6))]  # nothing new


def state_rows(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "batch").load(f"{folder}/c")


def test_state_goes_with_its_batches(spark, asked, tmp_path):
    stream = Stream(spark, tmp_path)

    def go():
        running_score_stream(stream.frame(), asked.drop("batch_id"), asked.select("id", "batch_id"), f"{tmp_path}/run",
                             f"{tmp_path}/c", late="1 minute", patience=60).awaitTermination()

    stream.add(*[(f"q{k}", box(7), "stop", "2024-01-01 12:00:00") for k in range(4)])
    go()
    held = state_rows(spark, tmp_path).select("key.batch_id", "value.ids", "value.closed").collect()
    assert sorted(map(tuple, held)) == [(0, [], True), (1, ["q3"], False)]
    stream.add(("nobody", box(1), "stop", "2024-01-02 12:00:00"))
    go()
    assert state_rows(spark, tmp_path).count() == 0


def test_running_score_starts_in_a_session_with_the_default_state_store(spark, asked, tmp_path):
    own, plain = spark.conf.get(STATE_STORE), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    stream = Stream(spark, tmp_path)
    stream.add(*[(f"q{k}", box(7), "stop", "2024-01-01 12:00:00") for k in range(3)])
    spark.conf.set(STATE_STORE, plain)
    try:
        running_score_stream(stream.frame(), asked.drop("batch_id"), asked.select("id", "batch_id"), f"{tmp_path}/run",
                             f"{tmp_path}/c").awaitTermination()
        assert spark.conf.get(STATE_STORE) == plain
    finally:
        spark.conf.set(STATE_STORE, own)
    assert shown(spark, f"{tmp_path}/run") == [(0, 3, 0, 3, 1.0)]


class Broken(Exception):
    pass


@pytest.mark.parametrize("at", [1, 2, 3, 4, 5, 7])
def test_a_run_broken_off_anywhere_shows_each_row_once(spark, asked, tmp_path, at):
    stream, run, written = Stream(spark, tmp_path), f"{tmp_path}/run", []
    stream.add(("q0", box(7), "stop", None), ("q1", None, "length", None), ("q2", None, "content_filter", None), ("zz", box(7), "stop", None))
    stream.add(("q0", box(9), "stop", None), ("q1", box(8), "stop", None), ("q4", None, "length", None), ("q5", box(7), "stop", None))

    def step(name):
        written.append(name)
        if len(written) == at:
            raise Broken(name)

    def go():
        rs.run_stream(stream.frame().drop("time"), asked, run, f"{tmp_path}/c", "m", step=step).awaitTermination()

    with pytest.raises(StreamingQueryException, match="Broken"):
        go()
    seen = rs.run_rows(spark, run).count()  # whole triggers only
    assert seen == (0 if at <= 4 else 2)
    go()
    rows = sorted((r["id"], r["batch_id"], r["full_answer"], r["score"]) for r in rs.run_rows(spark, run).collect())
    assert rows == [("q0", 0, box(7), 1.0), ("q1", 0, box(8), 0.75), ("q2", 0, "CONTENT_FILTERED", 0.0), ("q5", 1, box(7), 1.0)]
    assert sorted(map(tuple, rs.run_batches(spark, run).collect())) == [(0, 3, Decimal("1.75")), (1, 1, Decimal("1"))]
    assert [tuple(r) for r in rs.run_rejects(spark, run).collect()] == [("q4", "length")]
    assert rs.run_summary(spark, run, asked, "m").first()[0] == f"Overall score for m on 9 examples: 2.75/9 = {2.75 / 9}"
    go()
    assert rs.run_rows(spark, run).count() == 4


def test_a_trigger_meets_the_questions_once(spark, asked, tmp_path, monkeypatch):
    stream, run, tables = Stream(spark, tmp_path), f"{tmp_path}/run", []
    monkeypatch.setattr(rs, "materialize", lambda df: tables.append(df) or materialize(df))
    stream.add(("q0", box(7), "stop", None), ("q4", box(7), "stop", None), ("q1", None, "length", None), ("zz", None, "length", None))
    rs.run_stream(stream.frame().drop("time"), asked, run, f"{tmp_path}/c", "m").awaitTermination()
    assert len(tables) == 2  # the questions, and the outputs with theirs
    shown = rs.run_rows(spark, run).select("id", "context_window_id", "batch_id", "score").collect()
    assert sorted(map(tuple, shown)) == [("q0", "w0", 0, 1.0), ("q4", "w1", 1, 1.0)]
    assert [tuple(r) for r in rs.run_rejects(spark, run).collect()] == [("q1", "length")]
    assert tuple(Ledger(spark, run, rs.TOTALS).last()[2:]) == (2, Decimal(2), 1)


def test_outputs_arrive_in_many_files_and_a_trigger_takes_a_share(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_A_FILE", 300, raising=False)
    stream, triggers = registry.arriving_outputs(spark, tiny, f"{tmp_path}/in"), []
    (stream.writeStream.foreachBatch(lambda rows, n: triggers.append(sorted(r[0] for r in rows.select("id").collect())))
     .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination())
    ids = [str(r[0]) for r in registry.table(spark, tiny, "events").select("event_id").collect()]
    crc = {i: zlib.crc32(i.encode()) for i in ids}
    shares = [sorted(i for i in ids if crc[i] % 3 == s or crc[i] % 3 < s and crc[i] % 5 == 0) for s in range(3)]
    assert triggers == [*shares, ["none"]]
    assert len(list((tmp_path / "in").glob("part-*"))) == 3 * (1 + len(ids) // 300) + 1


def test_ledger_refuses_another_checkpoint_and_repeats_nothing(spark, asked, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/run", "n long")
    assert ledger.last() is None and ledger.part("rows", "x long").count() == 0
    ledger.commit(0, {"rows": spark.range(3).toDF("x")}, lambda: {"n": 3})
    assert ledger.last()["n"] == 3 and ledger.is_done(0, ledger.last()) and not ledger.is_done(1, ledger.last())
    spark.range(9).toDF("x").write.parquet(f"{tmp_path}/run/rows/trigger=1")  # left by a trigger without commit
    assert ledger.part("rows", "x long").count() == 3
    ledger.commit(1, {"rows": spark.range(1).toDF("x")}, lambda: {"n": 4})
    assert ledger.part("rows", "x long").count() == 4 and ledger.part("rows", "x long", 1).count() == 1
    other = Ledger(spark, f"{tmp_path}/run", "n long")
    other.stream = lambda: "another"
    with pytest.raises(ValueError, match="belongs to the stream"):
        other.is_done(2, other.last())


def test_a_streamed_run_reads_the_events_once(spark, tiny, monkeypatch):
    read, table = [], views.table

    def counted(spark_, d, name):
        read.append(name)
        return table(spark_, d, name)

    for module in (registry, views):
        monkeypatch.setattr(module, "table", counted)
    folder, plan = registry.streamed_run(spark, tiny)
    assert read == ["events"]
    assert plan.count() == table(spark, tiny, "events").count() and rs.run_rows(spark, folder).count() > 0


def test_a_written_table_is_not_written_again(spark, asked, tmp_path, monkeypatch):
    tables = []
    monkeypatch.setattr(rs, "materialize", lambda df: tables.append(materialize(df)) or tables[-1])
    stream = Stream(spark, tmp_path)
    stream.add(("q0", box(7), "stop", None))
    rs.run_stream(stream.frame().drop("time"), asked, f"{tmp_path}/run", f"{tmp_path}/c", "m").awaitTermination()
    assert tables[0] is asked  # the questions stay where they are
    assert materialize(asked.where("batch_id = 0")) is not asked


def test_a_ledger_starts_no_python_in_its_tasks(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/run", "n long, total decimal(28,12)")
    nothing = ledger.part("rows", "x long, s string")
    assert "ExistingRDD" not in nothing._jdf.queryExecution().executedPlan().toString()
    assert nothing.dtypes == [("x", "bigint"), ("s", "string"), ("trigger", "bigint")] and nothing.isEmpty()
    ledger.commit(0, {}, lambda: {"n": 2**40, "total": Decimal("1234567890123456.123456789012")})
    assert tuple(ledger.last()) == (0, "batch", 2**40, Decimal("1234567890123456.123456789012"))


def test_small_tasks_hold_inside_only(spark):
    names = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(name, None) for name in names]
    with pytest.raises(Broken), small_tasks(spark):
        assert [spark.conf.get(name) for name in names] == [str(4 * spark.sparkContext.defaultParallelism), "8m"]
        raise Broken
    assert [spark.conf.get(name, None) for name in names] == before
