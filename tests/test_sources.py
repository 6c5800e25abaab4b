"""Readers and writers on small files in the source shapes."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from episodia.checks import registry
from episodia.operators.ordered import list_parts
from episodia.sources import dialogue, logs, results

ROLL_HEADER = ("Episode\tTime\tCharacter\tType of Roll\tTotal Value\tNatural Value\tCrit?\tDamage Dealt"
               "\t# Kills\tNotes\n")


def test_roll_log_keeps_text_and_order(spark, tmp_path):
    path = tmp_path / "rolls.tsv"
    path.write_text(ROLL_HEADER + "1\t0:01\tGrog\tAttack\t25\t20\t\t12\t1\t\n"
                    "1\t0:02\tNA\tUnknown\t9\tUnknown\t\t\t1.0\t\n"
                    "2\t0:03\tPike\t\t7\t2\t\t\t\tx\n")
    rows = logs.read_rolls(spark, str(path), "campaign1").orderBy("seq").collect()
    assert [r.episode for r in rows] == [1, 1, 2]
    assert rows[0].natural_value == "20" and rows[0].kills == "1"
    assert rows[1].character is None and rows[1].kills == "1.0"
    assert rows[2].roll_type is None and rows[2].notes == "x"
    assert dict(rows[0].asDict())["campaign"] == "campaign1"


def test_file_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "rolls.tsv"
    body = "".join(f"{i % 3}\tt\tc{i}\tAttack\t1\t1\t\t\t\t{'x' * 80}\n" for i in range(60_000))
    path.write_text(ROLL_HEADER + body)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
        rows = logs.read_rolls(spark, str(path), "campaign1").select("seq", "character")
        assert rows.rdd.getNumPartitions() > 1
        ordered = rows.orderBy("seq").collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert [r.character for r in ordered] == [f"c{i}" for i in range(60_000)]
    assert len({r.seq for r in ordered}) == 60_000


def test_player_map_last_row_wins(spark, tmp_path):
    path = tmp_path / "characters.tsv"
    path.write_bytes("Player\tCharacter\tNotes\r\nMatt\tDM\t\r\nSam\tNott\t\r\nNA\tFrumpkin\tcat\r\nSam\tVeth\tsame\r\n".encode())
    rows = logs.read_players(spark, str(path), "campaign2").orderBy("first_seq").collect()
    assert [(r.player, r.character) for r in rows] == [("Matt", "DM"), ("Sam", "Veth")]


def test_episode_files_merge_and_extra_column(spark, tmp_path):
    header = "Time\tCharacter\tSpell\tBase Lvl\tCast At\tNotes\n"
    (tmp_path / "Spells Cast - Wildemount - 2-3.tsv").write_text(
        header + "0:01\tJester\tBless\t1\t2\t\n0:02\tCaleb\tNA\tCantrip\tCantrip\tn\n")
    (tmp_path / "Spells Cast - Wildemount - 2-20.tsv").write_text(
        "Old\t" + header + "9:99\t0:05\tNott\tMage Hand\tCantrip\tCantrip\t\n")
    log = logs.read_episode_files(spark, str(tmp_path), "campaign2", logs.SPELL_COLUMNS, extra_column=(20, 46))
    rows = log.orderBy("seq").collect()
    assert [(r.episode, r.character, r.spell) for r in rows] == [
        (3, "Jester", "Bless"), (3, "Caleb", None), (20, "Nott", "Mage Hand")]
    assert rows[2].time == "0:05" and rows[0].cast_at == "2"


def test_headers_tell_the_extra_columns(spark, tmp_path):
    header = "Time\tCharacter\tSpell\tBase Lvl\tCast At\tNotes\n"
    files = {1: header + "1\ttime\tBless\t1\t2\t\n", 2: "\t" + header + "9\t2\tNott\tTime\t1\t2\tn\n",
             3: "a\tb\t" + header.upper() + "8\t9\t3\tNott\tAid\tCantrip\t2\n", 4: "no\theader\n4\tCaleb\tHex\t1\t1\t\n",
             5: header, 6: "x\ty\n0\t6\tTime\tCharacter\t1\t1\t\n", 7: ""}
    for episode, text in files.items():
        (tmp_path / f"a b-{episode}.tsv").write_text(text)
    log = logs.read_episode_files(spark, str(tmp_path), "c", logs.SPELL_COLUMNS, extra_column=(6, 9))
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in log.orderBy("seq").collect()] == [
        (1, "1", "time", "Bless", "1", "2", None), (2, "2", "Nott", "Time", "1", "2", "n"),
        (3, "3", "Nott", "Aid", "Cantrip", "2", None), (4, "4", "Caleb", "Hex", "1", "1", None),
        (6, "6", "Time", "Character", "1", "1", None)]
    offsets = logs.header_offsets(spark, str(tmp_path), logs.SPELL_COLUMNS[1:]).collect()
    assert {tuple(r) for r in offsets} == {(f"a b-{k}.tsv", n) for k, n in ((1, 0), (2, 1), (3, 2), (5, 0))}


def dialogue_file(path, turns):
    path.write_text(json.dumps({"TURNS": [{"NAMES": n, "UTTERANCES": u} for n, u in turns]}))


def test_dialogue_to_transcripts_and_back(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    dialogue_file(source / "C1E001.json", [(["MATT"], ["Hello,", "all."]), (["MATT AND LAURA", "SAM"], ["Hi"])])
    dialogue_file(source / "C2E012.json", [(["TRAVIS"], ["So"])])
    dialogue_file(source / "X9.json", [(["NOBODY"], ["lost"])])
    found = dialogue.read_dialogues(spark, str(source))
    assert [r.stem for r in dialogue.dialogue_rejects(found).collect()] == ["X9"]
    lines = dialogue.transcript_lines(dialogue.dialogue_turns(found))
    texts = [r.line for r in lines.where("campaign = 'campaign1'").orderBy("seq").collect()]
    assert texts == ["Matt: Hello, all.", "Matt and laura: Hi", "Sam: Hi"]
    dialogue.write_transcripts(lines, str(target))
    back = {(r.campaign, r.episode): r.text for r in dialogue.read_written_transcripts(spark, str(target)).collect()}
    assert back[("campaign1", 1)] == "Matt: Hello, all.\nMatt and laura: Hi\nSam: Hi\n"
    assert back[("campaign2", 12)] == "Travis: So\n"


ODD_CAMPAIGNS = ("campaign1", "a b", "50%=/x:", "é\t'", None)


def test_transcripts_are_written_by_their_tasks(spark, tmp_path, monkeypatch):
    """One text file per chunk in the folders and with the bytes of Spark's writer, which starts a process for each."""
    rows = [(c, e, n << 16, None if n == 2 else f"{c} {e} {n} ü") for c in ODD_CAMPAIGNS for e in (1, 1000, None) for n in range(4)]
    lines = spark.createDataFrame(rows, "campaign string, episode int, seq bigint, line string")

    def tree(folder):
        return sorted((str(f.parent.relative_to(folder)), f.read_bytes()) for f in folder.rglob("part-*"))

    for _ in range(2):  # the second replaces the first
        dialogue.write_transcripts(lines, str(tmp_path / "own"), part_chars=600)
    back = dialogue.read_written_transcripts(spark, str(tmp_path / "own"))
    assert not [f for f in tmp_path.rglob("*.crc") if f.name != "._SUCCESS.crc"]
    assert sorted(f.name for f in tmp_path.iterdir()) == ["own"]
    monkeypatch.setattr(dialogue, "mounted", lambda spark, path: None)
    dialogue.write_transcripts(lines, str(tmp_path / "spark"), part_chars=600)
    assert tree(tmp_path / "own") == tree(tmp_path / "spark")
    plain = dialogue.read_written_transcripts(spark, str(tmp_path / "spark"))
    assert sorted(map(str, back.collect())) == sorted(map(str, plain.collect()))
    assert back.count() == dialogue.text_chunks(lines, 600).count() > 18


def test_dialogue_files_on_other_stores_are_the_same(spark, tiny, monkeypatch):
    def found():
        folder = registry.dialogue_files(spark, tiny)
        return sorted((f.name, f.read_bytes()) for f in Path(folder).glob("*.json")), list(Path(folder).glob(".*.crc"))

    own, checksums = found()
    assert len(own) == 20 and len(checksums) <= 1  # that of _SUCCESS
    monkeypatch.setattr(registry, "mounted", lambda spark, path: None)
    assert found()[0] == own


def test_whole_text_transcripts(spark, tmp_path):
    (tmp_path / "C1E020.txt").write_text("Matt: one\nSam: two\n")
    (tmp_path / "notes.txt").write_text("no transcript")
    lines = dialogue.read_transcript_lines(spark, str(tmp_path), "campaign1").orderBy("seq").collect()
    assert [(r.episode, r.line) for r in lines] == [(20, "Matt: one"), (20, "Sam: two")]
    rows = dialogue.read_transcripts(spark, str(tmp_path), "campaign1").collect()
    assert [(r.episode, r.text, r.chars) for r in rows] == [(20, "Matt: one\nSam: two\n", 19)]


def test_long_transcript_comes_in_chunks(spark):
    rows = [("campaign1", 1, i << 16, f"line {i}") for i in range(500)]
    lines = spark.createDataFrame(rows, "campaign string, episode int, seq bigint, line string")
    chunks = dialogue.text_chunks(lines, part_chars=100).orderBy("chunk").collect()
    assert len(chunks) > 10 and max(len(c.text) for c in chunks) < 120
    assert "".join(c.text for c in chunks) == "".join(f"line {i}\n" for i in range(500))


def test_list_parts_join_to_the_whole(spark):
    rows = [("campaign1", 1, i * 3, None if i % 7 == 0 else f"s{i}") for i in range(1000)]
    log = spark.createDataFrame(rows, "campaign string, episode int, seq bigint, spell string")
    parts = list_parts(log, ("campaign", "episode"), "spell", part_rows=64).orderBy("part").collect()
    assert len(parts) == 14
    assert ", ".join(p.answer for p in parts) == ", ".join(f"s{i}" for i in range(1000) if i % 7)


def test_question_files_by_split(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "campaign1", 'say "x"', "1"), ("b", "campaign2", "q", "2")],
        "id string, campaign string, question string, answer string")
    results.write_questions(rows, str(tmp_path / "q"))
    assert sorted(p.name for p in (tmp_path / "q").iterdir() if p.is_dir()) == ["split=test", "split=validation"]
    line = results.question_answer_json(rows.where("id = 'a'")).first().value
    assert json.loads(line) == {"question": 'say \\"x\\"', "answer": "1"}


def test_token_counter_takes_any_tokenizer(spark):
    from episodia.functions.text import token_counter

    def load():
        return lambda text: text.split("-")

    rows = spark.createDataFrame([("a-b-c",), (None,)], "t string")
    got = rows.select(token_counter(load)(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [3, None]
