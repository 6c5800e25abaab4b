"""Parsing and scoring: awkward texts with their expected outcome written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from episodia.functions import parsing
from episodia.plans import scoring
from episodia.sources.results import SCORED_ROW

BOXED = [
    # answer, output, parse, confidence, score
    ("5", "so \\boxed{5}", "5", "high", 1.0),
    ("5", "\\boxed{\\text{7}}", "7", "high", 0.75 ** 2),
    ("5", "\\boxed{{ +5 }}", "5", "high", 1.0),
    ("1000", "\\boxed{1_000}", "1000", "high", 1.0),
    ("5", "5", "5", "low", 0.0),
    ("5", "\\boxed{five}", "five", "high", 0.0),
    ("Bless", "\\boxed{ bless\n}", " bless\n", "high", 1.0),
    ("Bless", " BLESS ", " BLESS ", "low", 1.0),
    ("Bless", "first \\boxed{\\text{Bane}} then \\boxed{Bless}", "Bane", "high", 0.0),
    ("Bless", "first \\boxed{Bane} then \\boxed{\\text{Bless}}", "Bless", "high", 1.0),
    ("a, b, b", "\\boxed{b, a}", "b, a", "high", 2 / 3),
    ("a, b", "\\boxed{A, b,, }", "A, b", "high", 0.5),
    ("a, b", "\\boxed{a}", "a", "high", 0.0),
    ("3", "\\boxed{99999999999999999999999}", "99999999999999999999999", "high", 0.0),
    ("3", "\\boxed{}", "", "high", 0.0),
    ("-2", "\\boxed{2}", "2", "high", 0.75 ** 4),
]


@pytest.mark.parametrize("chunk", [BOXED])
def test_boxed(spark, chunk):
    rows = spark.createDataFrame(
        [(str(i), "w", a, o) for i, (a, o, *_) in enumerate(chunk)],
        "id string, context_window_id string, answer string, output string")
    got = {r.id: r for r in scoring.score_boxed(rows).collect()}
    for i, (_, _, parse, confidence, score) in enumerate(chunk):
        row = got[str(i)]
        assert (row.attempted_parse, row.parse_confidence) == (parse, confidence), chunk[i]
        assert row.score == pytest.approx(score), chunk[i]


CUED = [
    # answer_type, answer, output, parse, confidence, score
    ("NUMERIC", "[4]", "Answer: **4**", "4", "vhigh", 1.0),
    ("NUMERIC", "[4]", "Answer: [6]", "6", "vhigh", 0.75 ** 2),
    ("NUMERIC", "[4]", "4", "4", "low", 1.0),
    ("NUMERIC", "[4]", "I counted all of them: many", "many", "low", 0.0),
    ("NUMERIC", "[4]", "there are in total at least 5", "5", "low", 0.75),
    ("NUMERIC", "[4]", "there are in total at least 4", "4", "low", 1.0),
    ("LABEL", "['spam']", "Label: spam", "spam", "vhigh", 1.0),
    ("LABEL", '["it\'s"]', "Label: it's", "it's", "vhigh", 1.0),
    ("LABEL", "['spam', 'ham']", "Label: ham", "ham", "vhigh", 0.0),
    ("LABEL", "['spam']", "Answer: I really think it must be spam", "I really think it must be spam", "high", 0.0),
    ("COMPARISON", "['more common than']", "Answer: a is surely more common than b here", "more common", "high", 1.0),
    ("COMPARISON", "['less common than']", "Answer: more common", "more common", "vhigh", 0.0),
    ("COMPARISON", "['same frequency as']", "so: it is the same frequency as the other", "same frequency", "med", 1.0),
    ("DATE", "[datetime.date(2024, 1, 5)]", "Date: January 5, 2024", "2024-01-05 00:00:00", "vhigh", 1.0),
    ("DATE", "[datetime.date(2024, 1, 5)]", "Date: 2024-01-06", "2024-01-06 00:00:00", "vhigh", 0.0),
    ("DATE", "[datetime.date(2024, 1, 5)]", "Date: some day", "some day", "low", 0.0),
]


def test_cued(spark):
    rows = spark.createDataFrame(
        [(str(i), "w", "synth", f"ANSWER_TYPE.{t}", a, o) for i, (t, a, o, *_) in enumerate(CUED)],
        "id string, context_window_id string, dataset string, answer_type string, answer string, output string")
    got = {r.id: r for r in scoring.score_cued(rows).collect()}
    for i, (_, _, _, parse, confidence, score) in enumerate(CUED):
        row = got[str(i)]
        assert (row.attempted_parse, row.parse_confidence) == (parse, confidence), CUED[i]
        assert row.score == pytest.approx(score), CUED[i]


def test_gold_literals(spark):
    texts = ["[5]", "['a, b', 'c']", '["q"]', "['it\\'s']", "[datetime.date(2023, 12, 31)]", "[-3]"]
    rows = spark.createDataFrame([(t,) for t in texts], "answer string")
    got = [r.gold_text for r in parsing.gold_literal(rows, "answer").collect()]
    assert got == ["5", "a, b", "q", "it's", "2023-12-31 00:00:00", "-3"]


def test_gold_in_a_box_scores_one(spark):
    answers = ["12", "Mage Hand", "Bless, Guidance, Bless", "x y"]
    rows = spark.createDataFrame([(a,) for a in answers], "answer string").select(
        F.col("answer").alias("id"), F.lit("w").alias("context_window_id"), "answer",
        F.concat(F.lit("\\boxed{"), "answer", F.lit("}")).alias("output"))
    scores = {r.id: r.score for r in scoring.score_boxed(rows).collect()}
    # a repeated gold item counts in the divisor only
    assert scores == {"12": 1.0, "Mage Hand": 1.0, "x y": 1.0, "Bless, Guidance, Bless": pytest.approx(2 / 3)}


def test_errors_and_filtered_outputs_count(spark):
    gold = spark.createDataFrame(
        [("a", "w", "[1]"), ("b", "w", "2"), ("c", "w", "3")], "id string, context_window_id string, answer string")
    outputs = spark.createDataFrame(
        [("b", None, "content_filter"), ("c", "\\boxed{3}", "stop"), ("z", None, "stop")],
        "id string, output string, finish_reason string")
    rows = scoring.match_outputs(gold, scoring.resolve_filtered(outputs))
    got = {r.id: r for r in scoring.score_all(rows, model="m").collect()}
    assert got["a"].parse_confidence == "ERROR" and got["a"].answer == "1"
    assert got["b"].full_answer == "CONTENT_FILTERED" and got["b"].score == 0.0
    total = scoring.overall_score(scoring.score_all(rows, model="m")).first()
    assert (total.n, total.correct) == (3, 1.0)
    assert [r.id for r in scoring.empty_outputs(outputs).collect()] == ["z"]
    line = scoring.overall_summary("m", scoring.score_all(rows, model="m")).first().summary
    assert line.startswith("Overall score for m on 3 examples: 1.0/3 = 0.333")


def test_label_frequency(spark):
    counts = spark.createDataFrame([("g", "a", 3), ("g", "b", 3), ("g", "c", 1)], "g string, label string, n bigint")
    asked = spark.createDataFrame([("g", "a", "b"), ("g", "a", "c"), ("g", "c", "b")],
                                  "g string, label_a string, label_b string")
    got = {(r.label_a, r.label_b): r.relation for r in scoring.label_frequency_compare(counts, asked, ["g"]).collect()}
    assert got == {("a", "b"): "same frequency as", ("a", "c"): "more common than", ("c", "b"): "less common than"}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    from episodia.streaming.score_stream import output_stream, score_stream

    gold = spark.createDataFrame([(str(i), "w", str(i)) for i in range(6)],
                                 "id string, context_window_id string, answer string")
    arriving, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def deliver(ids):
        rows = [(str(i), f"\\boxed{{{i + i % 2}}}", "stop") for i in ids]
        spark.createDataFrame(rows, "id string, output string, finish_reason string").write.mode("append").json(arriving)

    def run():
        score_stream(output_stream(spark, arriving), gold, target, progress).awaitTermination()
        return spark.read.schema(SCORED_ROW).json(target)

    deliver([0, 1, 2, 2])
    assert run().count() == 3
    deliver([2, 3, 4, 5])
    streamed = run()
    outputs = spark.createDataFrame([(str(i), f"\\boxed{{{i + i % 2}}}") for i in range(6)], "id string, output string")
    batch = scoring.score_boxed(scoring.match_outputs(gold, outputs))
    pick = ("id", "attempted_parse", "score")
    assert sorted(map(tuple, streamed.select(*pick).collect())) == sorted(map(tuple, batch.select(*pick).collect()))
