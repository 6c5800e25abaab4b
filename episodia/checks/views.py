"""Source-shaped views over the test tables, written once for Spark and for the SQL oracle.

Each view is a base table and a list of expressions valid in both engines. The mess in them (nulls,
``Unknown``, blanks, ``Others``, ``1.0``) is deliberate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAMPAIGN = "CASE WHEN {0} % 2 = 0 THEN 'campaign1' ELSE 'campaign2' END"
NUMBER = "regexp_extract(props, '[0-9]+', 0)"
DAY = "CAST(day(ts) AS INT)"


def _text(expr: str, width: int = 10) -> str:
    return f"CAST({expr} AS VARCHAR({width}))"


# view name -> (table, row filter, {column: expression})
VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "roll_log": ("events", None, {
        "seq": "event_id",
        "campaign": CAMPAIGN.format("event_id"),
        "episode": DAY,
        "character": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 16 = 15 THEN 'Others' "
                     "WHEN user_id % 16 = 0 THEN 'DM' "
                     f"ELSE concat('u', {_text('user_id % 16')}) END",
        "roll_type": "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN ' ' "
                     "WHEN event_id % 61 = 0 THEN 'Unknown' ELSE event_type END",
        "natural_value": "CASE WHEN event_id % 41 = 0 THEN 'Unknown' "
                         f"ELSE {_text(f'CAST({NUMBER} AS INT) % 20 + 1')} END",
        "damage_dealt": "value",
        "kills": "CASE WHEN event_id % 10 = 0 THEN '1' WHEN event_id % 15 = 1 THEN '1.0' ELSE NULL END",
    }),
    "spell_log": ("events", None, {
        "seq": "event_id",
        "campaign": CAMPAIGN.format("event_id"),
        "episode": DAY,
        "character": f"CASE WHEN user_id % 16 = 0 THEN 'DM' ELSE concat('u', {_text('user_id % 16')}) END",
        "spell": "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Unknown' "
                 "WHEN event_type = 'error' OR event_id % 89 = 0 THEN NULL "
                 f"ELSE concat(event_type, '_', {_text('user_id % 12')}) END",
        "base_lvl": f"CASE WHEN user_id % 10 = 0 THEN 'Cantrip' ELSE {_text('user_id % 9 + 1')} END",
        "cast_at": "CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'Cantrip' "
                   "WHEN user_id % 10 = 0 THEN 'Cantrip' "
                   f"WHEN event_id % 5 = 0 THEN {_text('least(9, user_id % 9 + 2)')} "
                   f"ELSE {_text('user_id % 9 + 1')} END",
    }),
    "player_rows": ("supplier", None, {
        "seq": "s_suppkey",
        "player": f"CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('p', {_text('s_nationkey')}) END",
        "character": f"CASE WHEN s_suppkey % 16 = 0 THEN 'DM' ELSE concat('u', {_text('s_suppkey % 16')}) END",
    }),
    "turns": ("conversations", None, {
        "episode": "CAST(conv_id AS INT)",
        "campaign": CAMPAIGN.format("conv_id"),
        "seq": "turn",
        "name": "upper(role)",
        "utterance": "text",
    }),
    "boxed_outputs": ("events", None, {
        "id": _text("event_id", 20),
        "context_window_id": f"concat('w', {_text('user_id % 50')})",
        "answer": "CASE WHEN event_id % 35 = 5 THEN concat('[', event_type, ']') ELSE "
                  f"CASE event_id % 3 WHEN 0 THEN {NUMBER} WHEN 1 THEN event_type "
                  f"ELSE concat(event_type, ', x', {_text('user_id % 3')}, ', view') END END",
        "output": "CASE event_id % 7 "
                  f"WHEN 0 THEN concat('I think ', {NUMBER}) "
                  "WHEN 1 THEN concat('so ', chr(92), 'boxed{', chr(92), 'text{', event_type, '}}') "
                  f"WHEN 2 THEN concat(chr(92), 'boxed{{{{', {_text(f'CAST({NUMBER} AS INT) + user_id % 4')}, '}}}}') "
                  "WHEN 3 THEN concat(chr(92), 'boxed{', upper(event_type), '}') "
                  "WHEN 4 THEN concat(chr(92), 'boxed{view, x0}') "
                  "WHEN 5 THEN NULL "
                  f"ELSE concat('x', chr(10), chr(92), 'boxed{{', {_text(f'CAST({NUMBER} AS INT) + user_id % 2')}, '}}') END",
        "finish_reason": "CASE WHEN event_type = 'error' THEN 'content_filter' ELSE 'stop' END",
    }),
    "cued_outputs": ("events", None, {
        "id": _text("event_id", 20),
        "context_window_id": f"concat('w', {_text('user_id % 50')})",
        "answer_type": "CASE event_id % 4 WHEN 0 THEN 'ANSWER_TYPE.NUMERIC' WHEN 1 THEN 'ANSWER_TYPE.LABEL' "
                       "WHEN 2 THEN 'ANSWER_TYPE.COMPARISON' ELSE 'ANSWER_TYPE.DATE' END",
        "answer": "CASE event_id % 4 "
                  f"WHEN 0 THEN concat('[', {NUMBER}, ']') "
                  "WHEN 1 THEN concat('[', chr(39), event_type, chr(39), ']') "
                  "WHEN 2 THEN concat('[', chr(39), CASE user_id % 3 WHEN 0 THEN 'more common than' "
                  "WHEN 1 THEN 'less common than' ELSE 'same frequency as' END, chr(39), ']') "
                  f"ELSE concat('[datetime.date(2024, 1, ', {_text('day(ts)', 4)}, ')]') END",
        "output": "CASE event_id % 4 "
                  "WHEN 0 THEN CASE user_id % 4 "
                  f"WHEN 0 THEN concat('Answer: **', {_text(f'CAST({NUMBER} AS INT) + user_id % 3')}, '**') "
                  f"WHEN 1 THEN {NUMBER} "
                  f"WHEN 2 THEN concat('I counted a total of ', {NUMBER}) "
                  "ELSE 'Answer: many' END "
                  "WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'Label: [view]' ELSE concat('Label: ', event_type) END "
                  "WHEN 2 THEN CASE user_id % 5 WHEN 0 THEN 'Answer: the first is of the same frequency as the second' "
                  "WHEN 1 THEN 'Answer: less common' ELSE 'Answer: the first label is more common than the second one' END "
                  "ELSE CASE user_id % 3 "
                  f"WHEN 0 THEN concat('Date: 2024-01-', lpad({_text('day(ts)', 4)}, 2, '0')) "
                  "WHEN 1 THEN CASE user_id % 7 WHEN 0 THEN 'Date: Jan 5, 2024' WHEN 1 THEN 'Date: 5 January 2024' "
                  "WHEN 2 THEN 'Date: 2024/01/05' WHEN 3 THEN 'Date: 1/5/2024' WHEN 4 THEN 'Date: January 5 2024' "
                  "WHEN 5 THEN 'Date: 5 Jan 2024' ELSE 'Date: January 5, 2024' END ELSE 'no idea' END END",
    }),
}

# set windows: five overlapping shares of all episodes
WINDOWS_SQL = """
  SELECT concat('w', CAST(s.r_regionkey AS VARCHAR(10))) AS window_key, e.campaign, e.episode
  FROM region s JOIN (SELECT DISTINCT campaign, episode FROM roll_log) e
    ON (e.episode * 7 + s.r_regionkey * 3) % 5 < 1 + s.r_regionkey % 3
"""


def view_sql(name: str) -> str:
    table, where, columns = VIEWS[name]
    body = ", ".join(f"{expr} AS {column}" for column, expr in columns.items())
    return f"SELECT {body} FROM {table}" + (f" WHERE {where}" if where else "")


# declared, so that reading a table costs no inference job
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, where, columns = VIEWS[name]
    rows = table(spark, sf_dir, base)
    if where:
        rows = rows.where(where)
    return rows.selectExpr(*[f"{expr} AS {column}" for column, expr in columns.items()])


def window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five windows. Each window names the episode residues it takes, so episodes find their
    windows by an equality join and not by testing every pair."""
    specs = table(spark, sf_dir, "region").select(
        F.expr("concat('w', CAST(r_regionkey AS STRING))").alias("window_key"),
        F.explode(F.expr(
            "filter(sequence(0, 4), m -> (m + r_regionkey * 3) % 5 < 1 + r_regionkey % 3)")).alias("residue"))
    episodes = view(spark, sf_dir, "roll_log").select("campaign", "episode").distinct()
    keyed = episodes.withColumn("residue", F.expr("episode * 7 % 5"))
    return keyed.join(specs, "residue").select("window_key", "campaign", "episode")
