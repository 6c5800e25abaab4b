"""Run planning: ranges, batches, seeds, resuming, running scores."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from episodia.functions.scores import exact
from episodia.operators.ordered import positions, running_totals, seq_levels
from episodia.plans import evaluation as ev
from episodia.plans import jobs, scoring
from episodia.sources import results


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(1)
    # one window holds about a third of all rows; ids share prefixes
    rows = [(f"{rnd.getrandbits(64):016x}", "w0" if i % 3 == 0 else f"w{i % 40}") for i in range(900)]
    return rows, spark.createDataFrame(rows, "id string, context_window_id string").repartition(7)


def test_batches_follow_the_global_order(points):
    rows, df = points
    got = {r.id: r for r in ev.batches(df, 16).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [got[i].row_no for i, _ in ordered] == list(range(1, 901))
    assert [got[i].batch_id for i, _ in ordered] == [k // 16 for k in range(900)]
    ranges = ev.batch_ranges(ev.batches(df, 16)).orderBy("batch_id").collect()
    assert (ranges[0].first_row, ranges[0].last_row, ranges[-1].n) == (0, 15, 4)
    shifted = ev.batch_ranges(ev.batches(df, 16), F.lit(100)).orderBy("batch_id").first()
    assert (shifted.first_row, shifted.last_row) == (100, 115)


def test_batches_leave_the_rows_where_they_are_written(points):
    plan = ev.batches(points[1], 16)._jdf.queryExecution().executedPlan().toString()
    assert "row_index" in plan and "Exchange hashpartitioning" not in plan


def test_seed_is_the_first_id_of_a_window(points):
    rows, df = points
    seeds = {r.context_window_id: r.id for r in ev.seed_and_rest(df).where("role = 'seed'").collect()}
    expected = {}
    for i, w in rows:
        expected[w] = min(i, expected.get(w, i))
    assert seeds == expected


def test_running_totals_over_small_buckets(spark):
    rnd = random.Random(2)
    rows = [("g" if i % 3 else "h", i * 5, rnd.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, seq bigint, v bigint").repartition(5)
    got = running_totals(df, {"upto": F.col("v")}, ["g"], seq_levels("seq", fine=32, coarse=256), [F.col("seq")])
    sums = {"g": 0, "h": 0}
    expected = {}
    for g, seq, v in rows:
        sums[g] += v
        expected[(g, seq)] = sums[g]
    assert {(r.g, r.seq): r.upto for r in got.collect()} == expected
    places = positions(df, "pos", ["g"], seq_levels("seq", 32, 256), [F.col("seq")])
    assert places.agg(F.max("pos")).first()[0] == sum(1 for g, *_ in rows if g == "g")


def test_running_score_ends_at_the_overall_score(spark):
    rows = spark.createDataFrame([(i // 8, 0.75 ** (i % 5)) for i in range(100)], "batch_id bigint, score double")
    last = ev.running_score(rows.withColumn("score", exact(F.col("score")))).orderBy(F.desc("batch_id")).first()
    total = scoring.overall_score(rows).first()
    assert last.rows_so_far == 100
    assert last.score_so_far == pytest.approx(total.score, abs=1e-12)


def test_plan_and_resume(spark, tmp_path):
    questions = spark.createDataFrame(
        [("a", "w1", "q1", "1"), ("b", "w1", "q2", "2"), ("c", "w2", "q3", "3"), ("d", "w3", "q4", "4")],
        "id string, context_window_id string, question string, answer string")
    windows = spark.createDataFrame(
        [("w1", "one two three", "L1"), ("w2", "one", "L2"), ("w3", "one two three four", "L3")],
        "context_window_id string, context_window_text string, context_window_text_with_labels string")
    plan = jobs.plan_run(questions, windows, by_window=True, minimum=1, maximum=3)
    assert {(r.id, r.role) for r in plan.collect()} == {("a", "seed"), ("b", "rest")}
    sent = {r.id: r for r in jobs.request_table(plan, windows).collect()}
    system, user = sent["a"].messages
    assert [p.text for p in system.content] == ["You are a helpful assistant.", "one two three"]
    assert [p.cache_control for p in system.content] == [None, "ephemeral"] and user.content[0].text == "q1"
    assert sent["b"].messages[0].content[1].cache_control is None
    labelled = jobs.request_table(plan, windows, labels=True).where("id = 'a'").first()
    assert labelled.messages[0].content[1].text == "L1"

    folder = str(tmp_path)
    outputs = spark.createDataFrame([("a", "\\boxed{1}", "stop"), ("b", "\\boxed{3}", "stop")], results.OUTPUT_ROW)
    assert "1.75/4" in jobs.score_run(questions, outputs, folder, "m").first().summary
    more = spark.createDataFrame([("a", "\\boxed{9}", "stop"), ("c", "\\boxed{3}", "stop")], results.OUTPUT_ROW)
    assert "2.75/4" in jobs.score_run(questions, more, folder, "m").first().summary
    state = jobs.resume_state(spark, folder).first()
    assert (state.n_done, state.sum_score) == (3, 2.75)
    todo = jobs.plan_run(questions, windows, results.read_scored(spark, f"{folder}/full_output"), minimum=0, batch_size=2)
    assert [(r.id, r.batch_id) for r in todo.collect()] == [("d", 0)]


def test_one_window_is_dealt_to_many_shares(spark):
    plan = spark.createDataFrame([(f"i{k}", "big" if k % 4 else "small", f"q{k}", True) for k in range(200)],
                                 "id string, context_window_id string, question string, cache boolean")
    windows = spark.createDataFrame([("big", "B"), ("small", "S"), ("unused", "U")],
                                    "context_window_id string, context_window_text string")
    got = jobs.request_table(plan, windows, rows_per_copy=10).collect()
    assert sorted(r.id for r in got) == sorted(f"i{k}" for k in range(200))
    assert all(r.messages[0].content[1].text == r.context_window_id[0].upper() for r in got)


def test_batches_are_written_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.5), ("c", 1, 0.0)], "id string, batch_id bigint, score double")
    results.write_batches(rows, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert sorted((r.batch_id, r.id, r.score) for r in back.collect()) == [(0, "a", 1.0), (0, "b", 0.5), (1, "c", 0.0)]


def test_dataset_with_texts_is_split(spark):
    rows = spark.createDataFrame([("a", "w", "text"), ("b", "w", "text")],
                                 "id string, context_window_id string, context_window_text string")
    questions, windows = jobs.split_texts(rows)
    assert questions.columns == ["id", "context_window_id"] and windows.count() == 1


def test_window_order(points):
    rows, df = points
    got = [(r.id, r.context_window_id) for r in ev.window_order(df).collect()]
    assert got == sorted(rows, key=lambda r: (r[1], r[0]))


def test_batches_over_many_files_of_a_part(spark, points):
    rows, df = points
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        got = {r.id: r.row_no for r in ev.batches(df, 16).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [got[i] for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] == list(range(1, 901))


def test_run_with_repeated_empty_and_missing_outputs(spark, tmp_path):
    questions = spark.createDataFrame([(i, "w", "1") for i in "abcd"], "id string, context_window_id string, answer string")
    outputs = spark.createDataFrame(
        [("a", "\\boxed{1}", "stop"), ("a", "\\boxed{1}", "stop"), ("b", None, "stop"), ("c", None, "content_filter")],
        results.OUTPUT_ROW)
    folder = str(tmp_path)
    batches = spark.createDataFrame([(i, k // 2) for k, i in enumerate("abcd")], "id string, batch_id bigint")
    first = jobs.score_run(questions, outputs, folder, "m", batches=batches).first().summary
    assert "on 4 examples: 1.0/4 = 0.25" in first
    assert [r.id for r in spark.read.json(f"{folder}/rejects").collect()] == ["b"]
    assert sorted(p.name for p in (tmp_path / "batch_output").glob("batch*")) == ["batch_id=0", "batch_id=1"]
    again = spark.createDataFrame([("b", "\\boxed{1}", "stop"), ("a", "\\boxed{9}", "stop")], results.OUTPUT_ROW)
    assert "2.0/4 = 0.5" in jobs.score_run(questions, again, folder, "m").first().summary
    assert jobs.resume_state(spark, folder).first().n_done == 3


def test_texts_are_measured_once(spark):
    windows = spark.createDataFrame([("w", "a b c")], "context_window_id string, context_window_text string")
    calls = spark.sparkContext.accumulator(0)

    def measure(text):
        def count(values):
            calls.add(len(values))
            return values.str.split().str.len()
        return F.pandas_udf(count, "long")(text)

    asked = spark.createDataFrame([("q", "w"), ("r", "w")], "id string, context_window_id string")
    assert jobs.plan_run(asked, windows, minimum=0, measure=measure).count() == 2
    assert calls.value == 1


@pytest.mark.parametrize("master, fails", [("local[4]", False), ("local", False), ("spark://host:7077", True), ("yarn", True),
                                           ("local-cluster[2,1,1024]", True)])
def test_shared_folder_is_required_on_a_cluster(monkeypatch, master, fails):
    from types import SimpleNamespace as Space
    from unittest.mock import MagicMock

    from episodia import session

    context = MagicMock(master=master, applicationId="app")
    context._jsc.sc().getCheckpointDir().isDefined.return_value = False
    unset = Space(conf=Space(get=lambda key, default=None: default), sparkContext=context)
    if fails:
        with pytest.raises(ValueError):
            session.shared_folder(unset)
    else:
        assert session.shared_folder(unset) == session.shared_folder(unset)
    named = Space(conf=Space(get=lambda key, default=None: "s3://bucket/folder"), sparkContext=context)
    assert session.shared_folder(named) == "s3://bucket/folder"
