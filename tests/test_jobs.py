"""The question job from files to files."""

from __future__ import annotations

import hashlib
import json
import uuid

import pytest

from episodia.plans import assemble, jobs
from episodia.sources import dialogue, results

CHARACTERS = ["Grog", "Pike", "Vex", "DM", "Others"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for campaign, prefix in (("campaign1", "C1"), ("campaign2", "C2")):
        stats = root / "stats" / campaign
        texts = root / "texts" / campaign
        stats.mkdir(parents=True)
        texts.mkdir(parents=True)
        (stats / "characters.tsv").write_text(
            "Player\tCharacter\tNotes\nMatt\tDM\t\nTravis\tGrog\t\nAshley\tPike\t\nNA\tTrinket\tbear\n")
        rolls = ["Episode\tTime\tCharacter\tType of Roll\tTotal Value\tNatural Value\tCrit?\tDamage Dealt\t# Kills\tNotes"]
        spells = ["Episode\tTime\tCharacter\tSpell\tBase Lvl\tCast At\tNotes"]
        for episode in range(1, 7):
            for i in range(12):
                who = CHARACTERS[(episode + i) % 5]
                rolls.append(f"{episode}\t0\t{who}\tType {i % 3}\t1\t{(i * episode) % 20 + 1}\t\t\t\t")
                spells.append(f"{episode}\t0\t{who}\tSpell \"{i % 4}\"\t{i % 3}\t{i % 4}\t")
            if episode < 6:
                (texts / f"{prefix}E{episode:03d}.txt").write_text(f"Matt: {campaign} {episode}\nTravis: rolls\n")
        (stats / "rolls.tsv").write_text("\n".join(rolls) + "\n")
        (stats / "spells.tsv").write_text("\n".join(spells) + "\n")
    return root


def md5_id(text: str) -> str:
    return str(uuid.UUID(bytes=hashlib.md5(text.encode()).digest()))


def test_questions_from_files(spark, files, tmp_path):
    transcripts = dialogue.read_transcripts(spark, f"{files}/texts/campaign1", "campaign1").unionByName(
        dialogue.read_transcripts(spark, f"{files}/texts/campaign2", "campaign2"))
    out = str(tmp_path / "qa")
    questions, missing = jobs.prepare_questions(spark, f"{files}/stats", transcripts, out)
    assert sorted(map(tuple, missing.collect())) == [("campaign1", 6), ("campaign2", 6)]

    asked, windows = results.read_question_set(spark, out)
    texts = {x.context_window_id: x.context_window_text for x in results.whole_texts(windows).collect()}
    lines = [x.asDict() | {"context_window_text": texts[x.context_window_id]} for x in asked.collect()]
    assert {x["split"] for x in lines} == {"test", "validation"}
    assert all(set(x) - {"split"} == {"id", "context_window_id", "context_window_text", "question", "answer",
                                      "question_type", "episodes", "campaign"} for x in lines)
    assert len({x["id"] for x in lines}) == len(lines)
    for x in lines:
        episodes = "_".join(map(str, x["episodes"]))
        assert x["id"] == md5_id(x["campaign"] + x["question"] + episodes)
        assert x["context_window_id"] == md5_id(x["campaign"] + episodes)
        assert 6 not in x["episodes"] and x["episodes"] == sorted(x["episodes"])

    pair = next(x for x in lines if x["campaign"] == "campaign1" and len(x["episodes"]) == 2)
    a, b = pair["episodes"]
    assert pair["context_window_text"].endswith(
        f"[START OF EPISODE]\nMatt: campaign1 {a}\nTravis: rolls\n\n[END OF EPISODE]\n\n"
        f"[START OF EPISODE]\nMatt: campaign1 {b}\nTravis: rolls\n\n[END OF EPISODE]")
    assert pair["context_window_text"].startswith("The following lines contains multiple episode transcripts")
    assert "Matt plays the character DM.\nTravis plays the character Grog.\nAshley plays the character Pike.\n\nUse this" \
        in pair["context_window_text"]

    # window totals are sums of episode totals, and the last running total is the window's total
    for x in lines:
        if x["question"] == "Total number of rolls across all the episodes?":
            assert x["answer"] == str(12 * len(x["episodes"])) and x["question_type"] == "multidoc_rolls"
        if x["question"].startswith("What is the cummulative total of spells cast by the end of episode"):
            place = int(x["question"].rstrip("?").split()[-1])
            assert x["answer"] == str(12 * place) and x["question_type"] == "multidoc_spells"
    kinds = {x["question_type"] for x in lines}
    assert kinds == {"singledoc_rolls", "singledoc_spells", "multidoc_rolls", "multidoc_spells"}
    # quotes of a spell name carry a backslash in questions and answers
    assert any('\\"' in x["question"] for x in lines) and any('\\"' in x["answer"] for x in lines)


def test_long_windows_come_in_parts(spark):
    lines = spark.createDataFrame(
        [("campaign1", e, i << 16, f"e{e} line {i}") for e in (1, 2) for i in range(60)],
        "campaign string, episode int, seq bigint, line string")
    members = spark.createDataFrame([("w", "campaign1", 1, 1), ("w", "campaign1", 2, 2)],
                                    "context_window_id string, campaign string, episode int, ordinal int")
    by = ["context_window_id", "campaign"]
    whole = assemble.context_texts(members, dialogue.text_chunks(lines), by).collect()
    assert [(x.part, x.parts) for x in whole] == [(1, 1)]
    parts = assemble.context_texts(members, dialogue.text_chunks(lines, 100), by, part_chars=200).orderBy("part").collect()
    assert len(parts) > 3 and "".join(x.text for x in parts) == whole[0].text
    assert max(len(x.text) for x in parts) < 500


def test_transcript_job_reports_strangers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("C1E001", "Z1"):
        (source / f"{name}.json").write_text(json.dumps({"TURNS": [{"NAMES": ["SAM"], "UTTERANCES": ["a", "b"]}]}))
    rejects = jobs.prepare_transcripts(spark, str(source), str(tmp_path / "out"))
    assert [x.stem for x in rejects.collect()] == ["Z1"]
    got = dialogue.read_written_transcripts(spark, str(tmp_path / "out")).select("campaign", "text").collect()
    assert [tuple(x) for x in got] == [("campaign1", "Sam: a b\n")]


def test_long_windows_survive_files_and_plans(spark, files, tmp_path):
    """The same questions and whole texts, whatever the size of a part."""
    def run(chars: int):
        transcripts = dialogue.read_transcripts(spark, f"{files}/texts/campaign1", "campaign1", chars).unionByName(
            dialogue.read_transcripts(spark, f"{files}/texts/campaign2", "campaign2", chars))
        out = str(tmp_path / f"qa{chars}")
        jobs.prepare_questions(spark, f"{files}/stats", transcripts, out, part_chars=chars, toy=True)
        asked, windows = results.read_question_set(spark, out, "test")
        plan = jobs.plan_run(asked, windows, minimum=0)
        sent = jobs.request_table(plan, windows)
        return (sorted((x.id, x.context_len) for x in plan.collect()), windows.where("parts > 1").count(),
                sorted((x.id, x.messages[0].content[1].text) for x in sent.collect()))

    whole, none, full = run(1 << 24)
    cut, some, same = run(30)
    assert none == 0 and some > 0 and whole == cut and full == same
    assert len({i for i, _ in whole}) == len(whole)


def test_exports_cut_into_rows_are_split_whole(spark):
    rows = spark.createDataFrame(
        [(q, "w", part, text) for q in ("a", "b") for part, text in ((1, "one\n"), (2, "two"))] + [("c", "v", None, "x")],
        "id string, context_window_id string, part bigint, context_window_text string")
    asked, windows = jobs.split_texts(rows)
    assert sorted(x.id for x in asked.collect()) == ["a", "b", "c"]
    assert {tuple(x) for x in results.whole_texts(windows).collect()} == {("w", "one\ntwo"), ("v", "x")}


def test_one_log_file_per_episode(spark, files, tmp_path):
    """Per-episode files, some with one more column, give the questions of the merged log."""
    import shutil

    from episodia.functions import fixed_values as fixed
    from episodia.sources.logs import ROLL_COLUMNS, read_episode_files, read_rolls

    merged = f"{files}/stats/campaign1/rolls.tsv"
    head, *rows = open(merged).read().splitlines()
    folder = tmp_path / "stats" / "campaign1"
    (folder / "rolls").mkdir(parents=True)
    for n in range(1, 7):
        extra = "x\t" if n >= 4 else ""
        own = [extra + r.split("\t", 1)[1] for r in rows if r.startswith(f"{n}\t")]
        (folder / "rolls" / f"All Rolls-{n:03d}.tsv").write_text("\n".join([extra + head.split("\t", 1)[1], *own]) + "\n")
    got = read_episode_files(spark, str(folder / "rolls"), "campaign1", ROLL_COLUMNS, extra_column=(4, 6)).collect()
    want = read_rolls(spark, merged, "campaign1").collect()
    key = lambda rs: [tuple(r[c] for c in r.asDict() if c != "seq") for r in sorted(rs, key=lambda r: r.seq)]
    assert key(got) == key(want) and len({r.seq for r in got}) == len(got)
    assert fixed.EXTRA_COLUMN_EPISODES == (20, 46)
    shutil.rmtree(folder)


def test_order_over_files_and_splits(spark, tmp_path):
    from episodia.sources.logs import _read_tsv

    path = tmp_path / "log"
    path.mkdir()
    wide = "y" * 400
    for f in range(6):
        (path / f"p{f}.tsv").write_text("n\tx\n" + "".join(f"{f * 1000 + i}\t{wide}\n" for i in range(1000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(1 << 16))
        rows = _read_tsv(spark, str(path), ("n", "x"))
        assert rows.rdd.getNumPartitions() > 6
        got = sorted(rows.select("seq", "n").collect())
        assert [int(r.n) for r in got] == list(range(6000)) and len({r.seq for r in got}) == 6000
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        with pytest.raises(ValueError):
            _read_tsv(spark, str(path), ("n", "x"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_questions_from_spell_files_per_episode(spark, files, tmp_path):
    """The job gives the same questions from one spell file per episode as from the merged log."""
    import shutil

    stats = tmp_path / "stats"
    shutil.copytree(files / "stats", stats)
    for campaign in ("campaign1", "campaign2"):
        head, *rows = (stats / campaign / "spells.tsv").read_text().splitlines()
        (stats / campaign / "spells").mkdir()
        for n in range(1, 7):
            own = [r.split("\t", 1)[1] for r in rows if r.startswith(f"{n}\t")]
            (stats / campaign / "spells" / f"Spells Cast - 2-{n}.tsv").write_text(
                "\n".join([head.split("\t", 1)[1], *own]) + "\n")
    transcripts = dialogue.read_transcripts(spark, f"{files}/texts/campaign1", "campaign1").unionByName(
        dialogue.read_transcripts(spark, f"{files}/texts/campaign2", "campaign2"))
    found = [{(r.id, r.answer) for r in jobs.prepare_questions(
        spark, str(root), transcripts, str(tmp_path / f"qa{by}"), toy=True, by_episode=by)[0].rows.collect()}
        for root, by in ((files / "stats", False), (stats, True))]
    assert found[0] == found[1] and found[0]
