"""The stages of the pipeline, each on what the one before kept, against plain versions."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import plain_components, plain_spans, plain_words


def test_stages_do_what_their_operators_say(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34 --", "en", "src1", 8), (10**6 + 1, None, "en", "src1", None)], docs.schema)
    docs = docs.union(odd)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if "doc_id" in docs.columns else {}
        docs = corpus_pipeline.materialize(stage(spark, docs, tiny))
        steps[name] = (before, docs.collect())

    before, after = steps["language_id"]
    assert {r["doc_id"] for r in after} == before.keys() - {10**6, 10**6 + 1}
    assert sum(r["lang"] == before[r["doc_id"]]["lang"] for r in after) >= 0.97 * len(after)
    assert all(r["text"] == before[r["doc_id"]]["text"] and r["source"] == before[r["doc_id"]]["source"] for r in after)

    before, after = steps["near_duplicates"]
    components = plain_components({k: r["text"] for k, r in before.items()}, 5)
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, (_, c) in components.items() if k == c)

    before, after = steps["secret_scan"]
    assert before.keys() == {r["doc_id"] for r in after}
    for r in after:
        text, out, at = before[r["doc_id"]]["text"], [], 0
        for start, _, end in plain_spans(text):
            if start >= at:
                out += [text[at:start], "[secret]"]
            at = max(at, end)
        if "".join(out) + text[at:] != r["text"]:  # only learned formats may take more
            assert r["text"].count("[secret]") > len(out) / 2
        assert r["n_chars"] == len(r["text"])

    before, after = steps["source_mixture"]
    total = sum(len(plain_words(r["text"])) for r in before.values())
    taken = sum(len(plain_words(r["text"])) for r in after)
    assert all(r == before[r["doc_id"]] for r in after) and 0.5 * total < taken <= corpus_pipeline.TOKEN_SHARE * total

    _, pieces = steps["best_fit_packing"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in after}
    held: dict = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        assert sum(n for _, n in parts) <= 4096


def test_run_applies_all_stages(spark, tiny):
    rows = corpus_pipeline.run(spark, tiny)
    assert rows.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.agg(F.max("length")).first()[0] <= 4096


CLASHING = ("_gone _again _id _tokens _budget _epoch _place _lang_pred _score _identified _domain _language _origin _bucket "
            "row alike found score aside0 aside1 aside2 node key component_id kept text_md5").split()


def test_stages_leave_columns_of_any_name_alone(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    plain = docs.withColumn("n", F.col("doc_id"))
    named = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = corpus_pipeline.materialize(stage(spark, plain, tiny))
        named = corpus_pipeline.materialize(stage(spark, named, tiny))
        assert named.columns == [*docs.columns, *CLASHING], name
        pick = [c for c in docs.columns if c != "n_chars"]
        assert sorted(map(tuple, named.select(*pick).collect()), key=str) == sorted(map(tuple, plain.select(*pick).collect()), key=str)
        assert named.where(" OR ".join(f"{c} <> concat('{c}', doc_id)" for c in CLASHING)).isEmpty(), name


def test_rows_that_share_an_id_are_told_apart(spark, tiny):
    def text(k):
        return " ".join(f"w{(k * 97 + i * i) % 1013}x{i}" for i in range(60))

    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(2) + " end"), (3, text(3)), (3, text(1) + " end"), (None, text(3)),
            (None, text(4)), (4, ""), (4, ""), (4, None), (5, text(5)), (5, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, tiny).collect()
    expected = [(1, text(1)), (1, text(2)), (3, text(3)), (None, text(3)), (None, text(4)), (4, ""), (4, None), (5, text(5)), (5, text(6))]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)
