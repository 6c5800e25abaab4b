"""Bulk scoring of model outputs against gold answers, and summaries of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import parsing as p
from ..functions import scores as sc
from ..sources.results import as_scored

ERROR = "ERROR"


def match_outputs(gold: DataFrame, outputs: DataFrame) -> DataFrame:
    """Gold rows with their outputs by id; rows without output keep a null ``output``."""
    return gold.join(outputs, "id", "left")


def resolve_filtered(outputs: DataFrame) -> DataFrame:
    """Empty outputs that a content filter caused get a fixed text; other empty ones stay empty."""
    text = F.when(F.col("output").isNull() & (F.col("finish_reason") == "content_filter"),
                  fixed.FILTERED_OUTPUT).otherwise(F.col("output"))
    return outputs.withColumn("output", text)


def one_output(outputs: DataFrame) -> DataFrame:
    """One row per id: a text before none, then the smallest text and reason, so repeats never count twice."""
    least = F.min(F.struct(F.col("output").isNull().alias("none"), "output", "finish_reason")).alias("x")
    return outputs.where("id is not null").groupBy("id").agg(least).select("id", "x.output", "x.finish_reason")


def empty_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs that are empty for no accepted reason."""
    return resolve_filtered(outputs).where(F.col("output").isNull())


def parsed_boxed(rows: DataFrame, output: str = "output") -> DataFrame:
    """Boxed parse with the typed answer in ``p_kind/p_i/p_s/p_l``. Unboxed text is never typed."""
    boxed = p.type_answer(p.parse_boxed(rows, output), "boxed", "p_")
    raw = F.col("boxed").isNull() & F.col(output).isNotNull()
    return boxed.withColumn("p_kind", F.when(raw, "string").otherwise(F.col("p_kind"))).withColumn(
        "p_s", F.when(raw, F.col(output)).otherwise(F.col("p_s")))


def score_boxed(rows: DataFrame, model: str = "model") -> DataFrame:
    """Score rows ``(id, context_window_id, answer, output)`` whose answers stand in a box."""
    typed = p.type_answer(parsed_boxed(rows.where(F.col("output").isNotNull())), "answer", "g_")
    return typed.select(
        "id", "context_window_id", F.lit(model).alias("model"),
        p.typed_text("p_").alias("attempted_parse"), "parse_confidence",
        F.col("output").alias("full_answer"), sc.typed_score().alias("score"),
        p.typed_text("g_").alias("answer"))


def score_cued(rows: DataFrame, model: str = "model") -> DataFrame:
    """Score rows ``(id, context_window_id, [dataset], answer_type, answer, output)`` with announced answers.

    The tests run in a fixed order: equal text, comparison phrase (no fall-through), number, date.
    """
    if "dataset" not in rows.columns:
        rows = rows.withColumn("dataset", F.lit(None).cast("string"))
    parsed = p.gold_literal(p.parse_cued(rows.where(F.col("output").isNotNull()), "output"), "answer")
    same = F.col("candidate").eqNullSafe(F.col("gold_text"))
    phrase = F.col("candidate").isin(*fixed.COMPARISONS)
    numeric = F.col("answer_type") == "ANSWER_TYPE.NUMERIC"
    dated = F.col("answer_type") == "ANSWER_TYPE.DATE"
    # which test decides a row
    parsed = parsed.withColumn(
        "rule", F.when(same, "same").when(phrase, "phrase").when(numeric, "number").when(dated, "date"))
    parsed = (
        parsed.withColumn("given_no", F.when(F.col("rule") == "number", p.whole_number(F.col("candidate"))))
        .withColumn("gold_no", F.when(F.col("rule") == "number", p.whole_number(F.col("gold_text"))))
        .withColumn("given_date", F.when(F.col("rule") == "date", p.full_date(F.col("candidate"))))
    )
    number_fits = F.col("given_no").isNotNull() & F.col("gold_no").isNotNull()
    score = (
        F.when(F.col("rule") == "same", 1.0)
        .when(F.col("rule") == "phrase", F.contains(F.col("gold_text"), F.col("candidate")).cast("double"))
        .when((F.col("rule") == "number") & number_fits, sc.partial_credit(F.col("gold_no"), F.col("given_no")))
        .when((F.col("rule") == "date") & (F.col("given_date") == F.col("gold_date")), 1.0)
        .otherwise(0.0)
    )
    unread = ((F.col("rule") == "number") & ~number_fits) | (
        (F.col("rule") == "date") & F.col("given_date").isNull())
    attempted = F.coalesce(
        F.col("given_no").cast("string"),
        F.concat(F.col("given_date").cast("string"), F.lit(" 00:00:00")), F.col("candidate"))
    return parsed.select(
        "id", "context_window_id", "dataset", F.lit(model).alias("model"),
        attempted.alias("attempted_parse"),
        F.when(unread, "low").otherwise(F.col("parse_confidence")).alias("parse_confidence"),
        F.col("output").alias("full_answer"), F.coalesce(score, F.lit(0.0)).alias("score"),
        F.col("gold_text").alias("answer"))


def error_rows(rows: DataFrame, model: str = "model") -> DataFrame:
    """Rows without output: they score nothing and still count."""
    bare = F.btrim(F.btrim("answer", F.lit("[")), F.lit("]"))
    missing = rows.where(F.col("output").isNull())
    return as_scored(missing.withColumns({
        "model": F.lit(model), "attempted_parse": F.lit(ERROR), "parse_confidence": F.lit(ERROR),
        "full_answer": F.lit(ERROR), "score": F.lit(0.0), "answer": bare}))


def score_all(rows: DataFrame, scorer=score_boxed, model: str = "model") -> DataFrame:
    """Scored rows and error rows in the common schema."""
    return as_scored(scorer(rows, model)).unionByName(error_rows(rows, model))


def overall_score(*scored: DataFrame) -> DataFrame:
    """Rows, summed score and mean over all given results, earlier runs included."""
    rows = None
    for part in scored:
        part = part.select(sc.exact(F.col("score")).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    summed = rows.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(F.sum("score"), F.lit(0)).cast("double").alias("correct"))
    mean = F.col("correct") / F.nullif(F.col("n"), F.lit(0)).cast("double")
    return summed.withColumn("score", mean)


def overall_summary(model: str, *scored: DataFrame) -> DataFrame:
    """The summary line of a run."""
    total = overall_score(*scored)
    n, correct = F.col("n").cast("string"), F.col("correct").cast("string")
    return total.select(F.concat(
        F.lit(f"Overall score for {model} on "), n, F.lit(" examples: "), correct, F.lit("/"), n,
        F.lit(" = "), F.col("score").cast("string")).alias("summary"))


def label_frequency_compare(counts: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Relative frequency of asked label pairs, from ``(by, label, n)`` and ``(by, label_a, label_b)``."""
    a = counts.select(*by, F.col("label").alias("label_a"), F.col("n").alias("n_a"))
    b = counts.select(*by, F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    both = asked.join(a, [*by, "label_a"]).join(b, [*by, "label_b"])
    relation = (F.when(F.col("n_a") > F.col("n_b"), "more common than")
                .when(F.col("n_a") < F.col("n_b"), "less common than")
                .otherwise("same frequency as"))
    return both.select(*by, "label_a", "label_b", relation.alias("relation"))
