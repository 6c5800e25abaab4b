"""SQL oracles for the named queries, written from the definitions and not from the plans.

Every oracle works on log rows directly (no compaction, no buckets), so that it checks the plans'
pre-aggregation and bucketing as well as their results.
"""

from __future__ import annotations

from ..functions import fixed_values as fixed
from .views import VIEWS, WINDOWS_SQL, view_sql

EK = "campaign, episode"
WK = "window_key, campaign"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE) + ")"
VALID_CHARACTER = f"character IS NOT NULL AND lower(character) NOT IN {words(fixed.CHARACTER_STOP_WORDS)}"
VALID_TYPE = (f"roll_type IS NOT NULL AND trim(roll_type, {WS}) <> '' "
              f"AND lower(roll_type) NOT IN {words(fixed.ROLL_TYPE_STOP_WORDS)}")
VALID_SPELL = f"spell IS NOT NULL AND lower(spell) NOT IN {words(fixed.SPELL_STOP_WORDS)}"
UPCAST = "coalesce(cast_at > base_lvl, false)"
MD5_ID = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
SEED = str(fixed.SEED)

CTES = {name: view_sql(name) for name in VIEWS}
CTES["windows"] = WINDOWS_SQL
CTES["members"] = ("SELECT *, row_number() OVER (PARTITION BY window_key, campaign ORDER BY episode) AS ordinal "
                   "FROM windows")
CTES["players"] = ("SELECT player, arg_max(character, seq) AS character, min(seq) AS first_seq "
                   "FROM player_rows WHERE player IS NOT NULL GROUP BY player")
CTES["roll_w"] = "SELECT w.window_key, r.* FROM windows w JOIN roll_log r USING (campaign, episode)"
CTES["spell_w"] = "SELECT w.window_key, r.* FROM windows w JOIN spell_log r USING (campaign, episode)"
CTES["roll_values"] = "SELECT CAST(v AS VARCHAR) AS roll_value FROM range(1, 21) t(v)"
CTES["window_list"] = (
    "SELECT window_key, campaign, string_agg(CAST(episode AS VARCHAR), '_' ORDER BY episode) AS episodes "
    "FROM windows GROUP BY window_key, campaign")
CTES["lines"] = (
    "SELECT campaign, episode, seq * 65536 AS seq, name, utterance, "
    "concat(upper(name[1]), lower(name[2:]), ': ', utterance) AS line FROM turns "
    "UNION ALL SELECT campaign, episode, seq * 65536 + 1, 'GUEST', utterance, concat('Guest: ', utterance) FROM turns "
    "WHERE seq % 3 = 1")  # a turn of two names

NEEDS = {
    "windows": ["roll_log"], "members": ["windows"], "players": ["player_rows"],
    "roll_w": ["windows", "roll_log"], "spell_w": ["windows", "spell_log"],
    "window_list": ["windows"], "lines": ["turns"],
}


def sql(body: str, *ctes: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views and what they need, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in ctes:
        visit(name)
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


ORACLES: dict[str, str] = {}


def both(name: str, log: str, template: str, *ctes: str) -> None:
    """One template for the episode and the window form; ``{src}`` is the log and ``{by}`` the key."""
    plain = {"roll": "roll_log", "spell": "spell_log"}[log]
    ORACLES[name] = sql(template.format(src=plain, by=EK), plain, *ctes)
    ORACLES[f"window_{name}"] = sql(template.format(src=f"{log}_w", by=WK), f"{log}_w", *ctes)


# --- counting ---------------------------------------------------------------------------------------
COUNT = "SELECT {by}, count(*) AS n FROM {src} GROUP BY {by}"


def count_where(condition: str) -> str:
    return f"SELECT {{by}}, count(*) FILTER (WHERE {condition}) AS n FROM {{src}} GROUP BY {{by}}"


def count_per(key: str, condition: str) -> str:
    return (f"SELECT {{by}}, {key}, count(*) AS n FROM {{src}} WHERE {condition} GROUP BY {{by}}, {key}")


def per_player() -> str:
    return ("SELECT {by}, player, count(*) AS n FROM {src} JOIN players p USING (character) "
            f"WHERE {VALID_CHARACTER} AND character <> 'DM' GROUP BY {{by}}, player")


def ties(key: str, pick: str, order: str) -> str:
    return (f"SELECT {{by}}, string_agg({key}, ', ' ORDER BY {order}) AS answer FROM ("
            f"SELECT *, {pick}(n) OVER (PARTITION BY {{by}}) AS best FROM ("
            f"SELECT {{by}}, {key}, count(*) AS n, min(seq) AS first_seq FROM {{src}} "
            f"WHERE {key} IS NOT NULL GROUP BY {{by}}, {key})) WHERE n = best GROUP BY {{by}}")


both("rolls_total", "roll", COUNT)
both("rolls_by_character", "roll", count_per("character", VALID_CHARACTER))
both("rolls_by_player", "roll", per_player(), "players")
both("rolls_by_type", "roll", count_per("roll_type", VALID_TYPE))
VALUES = ("SELECT {by}, roll_value, count(*) FILTER (WHERE natural_value = roll_value) AS n, count(*) AS total "
          "FROM {src} CROSS JOIN roll_values GROUP BY {by}, roll_value")
both("rolls_by_value", "roll", "SELECT {by}, roll_value, n FROM (" + VALUES + ")", "roll_values")
both("rolls_value_pct", "roll",
     "SELECT {by}, roll_value, CAST(round_even(CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * 100.0, 0) AS BIGINT) AS pct "
     "FROM (" + VALUES + ")", "roll_values")
both("roll_type_mode", "roll", ties("roll_type", "max", "roll_type"))
both("roll_type_rarest", "roll", ties("roll_type", "min", "first_seq"))
both("roll_value_mode", "roll", ties("natural_value", "max", "natural_value"))
both("roll_value_rarest", "roll", ties("natural_value", "min", "first_seq"))
both("crits", "roll", count_where("natural_value IN ('1', '20')"))
both("nat20s", "roll", count_where("natural_value = '20'"))
both("nat1s", "roll", count_where("natural_value = '1'"))

both("spells_total", "spell", COUNT)
both("spells_by_character", "spell", count_per("character", VALID_CHARACTER))
both("spells_by_player", "spell", per_player(), "players")
both("spells_by_name", "spell", count_per("spell", VALID_SPELL))
both("spell_caster_count", "spell",
     f"SELECT {{by}}, spell, count(DISTINCT character) AS n FROM {{src}} WHERE {VALID_SPELL} GROUP BY {{by}}, spell")
both("spell_mode", "spell", ties("spell", "max", "spell"))
both("spell_rarest", "spell", ties("spell", "min", "first_seq"))
both("cantrips", "spell", count_where("base_lvl = 'Cantrip'"))
both("upcast_count", "spell", count_where(UPCAST))
both("upcast_spells", "spell",
     "SELECT {by}, string_agg(spell, ', ' ORDER BY first_seq) AS answer FROM ("
     f"SELECT {{by}}, spell, min(seq) AS first_seq FROM {{src}} WHERE {UPCAST} AND spell IS NOT NULL "
     "GROUP BY {by}, spell) GROUP BY {by}")

# --- one episode ------------------------------------------------------------------------------------------
for edge, direction in (("first", "ASC"), ("last", "DESC")):
    ORACLES[f"spells_{edge}_k"] = sql(
        f"SELECT {EK}, CAST(k AS INT) AS k, coalesce(string_agg(spell, ', ' ORDER BY seq), '') AS answer FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {EK} ORDER BY seq {direction}) AS rn FROM spell_log) "
        f"JOIN range(1, 4) t(k) ON rn <= k GROUP BY {EK}, k", "spell_log")
    pick = "arg_min" if edge == "first" else "arg_max"
    PER = (f"SELECT {{by}}, string_agg(spell, ', ' ORDER BY {{per}}) AS answer FROM ("
           f"SELECT {{by}}, {{per}}, {pick}(spell, seq) AS spell FROM {{src}} "
           "WHERE spell IS NOT NULL AND {per} IS NOT NULL AND {cond} GROUP BY {by}, {per}) GROUP BY {by}")
    ORACLES[f"spell_{edge}_per_character"] = sql(
        PER.format(by=EK, per="character", src="spell_log", cond="true"), "spell_log")
    ORACLES[f"window_{edge}_spell_per_episode"] = sql(
        PER.format(by=WK, per="episode", src="spell_w", cond="true"), "spell_w")
    ORACLES[f"window_{edge}_spell_by_character"] = sql(
        PER.format(by=WK + ", character", per="episode", src="spell_w", cond=VALID_CHARACTER), "spell_w")

ORACLES["spells_multi_caster"] = sql(
    f"SELECT {EK}, string_agg(spell, ', ' ORDER BY first_seq) AS answer FROM ("
    f"SELECT {EK}, spell, min(seq) AS first_seq FROM spell_log WHERE spell IS NOT NULL GROUP BY {EK}, spell "
    f"HAVING count(DISTINCT character) > 1) GROUP BY {EK}", "spell_log")
KILLS = "coalesce(sum(CASE WHEN regexp_full_match(kills, '[0-9]+') THEN CAST(kills AS BIGINT) END), 0)"
ORACLES["kills_total"] = sql(f"SELECT {EK}, CAST({KILLS} AS BIGINT) AS n FROM roll_log GROUP BY {EK}", "roll_log")
ORACLES["kills_by_character"] = sql(
    f"SELECT {EK}, character, CAST({KILLS} AS BIGINT) AS n FROM roll_log WHERE character IS NOT NULL "
    f"GROUP BY {EK}, character", "roll_log")
DAMAGE = "CAST(coalesce(sum(TRY_CAST(CAST(damage_dealt AS VARCHAR) AS DECIMAL(24,6))), 0) AS DOUBLE) AS damage"
ORACLES["damage_dealt"] = sql(
    f"SELECT {EK}, 'total' AS scope, CAST(NULL AS VARCHAR) AS character, {DAMAGE} FROM roll_log GROUP BY {EK} "
    f"UNION ALL SELECT {EK}, 'character', character, {DAMAGE} FROM roll_log WHERE character IS NOT NULL "
    f"GROUP BY {EK}, character", "roll_log")
ORACLES["spells_in_order"] = sql(
    f"SELECT {EK}, CAST(1 AS BIGINT) AS part, string_agg(spell, ', ' ORDER BY seq) AS answer "
    f"FROM spell_log WHERE spell IS NOT NULL GROUP BY {EK}", "spell_log")
ORACLES["phrase_count"] = sql(
    f"SELECT {EK}, CAST(sum(CASE WHEN name = 'ASSISTANT' THEN "
    "(length(lower(utterance)) - length(replace(lower(utterance), 'the', ''))) // 3 ELSE 0 END) AS BIGINT) AS n "
    f"FROM turns GROUP BY {EK}", "turns")

# --- several episodes -------------------------------------------------------------------------------------------
for log, name in (("roll_log", "rolls"), ("spell_log", "spells")):
    ORACLES[f"window_{name}_cumulative"] = sql(
        "SELECT m.window_key, m.campaign, CAST(m.ordinal AS INT) AS ordinal, CAST(count(r.seq) AS BIGINT) AS n "
        "FROM members m JOIN members u ON u.window_key = m.window_key AND u.campaign = m.campaign "
        f"AND u.ordinal <= m.ordinal LEFT JOIN {log} r ON r.campaign = u.campaign AND r.episode = u.episode "
        "GROUP BY m.window_key, m.campaign, m.ordinal", "members", log)
ORACLES["window_nth_spell"] = sql(
    "SELECT m.window_key, m.campaign, CAST(m.ordinal AS INT) AS ordinal, CAST(s.rn AS INT) AS nth, s.spell "
    f"FROM members m JOIN (SELECT *, row_number() OVER (PARTITION BY {EK} ORDER BY seq) AS rn FROM spell_log) s "
    "ON s.campaign = m.campaign AND s.episode = m.episode WHERE s.rn <= 3", "members", "spell_log")


def sampled(by: str, kind: str, key: str, src: str, condition: str) -> str:
    parts = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in by.split(","))
    return (f"SELECT {by}, '{kind}' AS kind, value FROM (SELECT {by}, value, row_number() OVER ("
            f"PARTITION BY {by} ORDER BY md5(concat_ws('|', '{SEED}', {parts}, '{kind}', value)), value) AS rk "
            f"FROM (SELECT DISTINCT {by}, {key} AS value FROM {src} WHERE {condition})) "
            f"WHERE rk <= {fixed.PARAMS_PER_KIND}")


SAMPLED_CHARACTERS = sampled(WK, "roll_character", "character", "roll_w", VALID_CHARACTER)
ORACLES["window_rolls_cumulative_by_character"] = sql(
    "SELECT m.window_key, m.campaign, p.value AS character, CAST(m.ordinal AS INT) AS ordinal, "
    "CAST(count(r.seq) AS BIGINT) AS n FROM members m "
    "JOIN picked p ON p.window_key = m.window_key AND p.campaign = m.campaign "
    "JOIN members u ON u.window_key = m.window_key AND u.campaign = m.campaign AND u.ordinal <= m.ordinal "
    "LEFT JOIN roll_log r ON r.campaign = u.campaign AND r.episode = u.episode AND r.character = p.value "
    "GROUP BY m.window_key, m.campaign, p.value, m.ordinal",
    "members", "roll_w", extra={"picked": SAMPLED_CHARACTERS})

# --- parameters, samples, windows -------------------------------------------------------------------------------
ORACLES["player_map_last_wins"] = sql("SELECT * FROM players", "players")
ORACLES["player_prompt"] = sql(
    f"SELECT concat({quoted(fixed.PLAYER_PROMPT_HEAD)}, string_agg(concat(player, ' plays the character ', "
    f"character, '.'), chr(10) ORDER BY first_seq), {quoted(fixed.PLAYER_PROMPT_TAIL)}) AS prompt FROM players",
    "players")
for name, log, key, condition in (
    ("valid_roll_types", "roll_log", "roll_type", VALID_TYPE),
    ("valid_characters", "roll_log", "character", VALID_CHARACTER),
    ("valid_spells", "spell_log", "spell", VALID_SPELL),
):
    ORACLES[name] = sql(f"SELECT {EK}, {key}, min(seq) AS first_seq FROM {log} WHERE {condition} "
                        f"GROUP BY {EK}, {key}", log)
EPISODES = f"SELECT DISTINCT {EK} FROM spell_log s"
HAS_TEXT = "EXISTS (SELECT 1 FROM turns t WHERE t.campaign = s.campaign AND t.episode = s.episode)"
ORACLES["episodes_with_transcript"] = sql(f"{EPISODES} WHERE {HAS_TEXT}", "spell_log", "turns")
ORACLES["episodes_missing_transcript"] = sql(f"{EPISODES} WHERE NOT {HAS_TEXT}", "spell_log", "turns")
ROLL_VALUE_ROWS = "(SELECT DISTINCT window_key, campaign, roll_value FROM windows CROSS JOIN roll_values)"
ORACLES["sample_params"] = sql(" UNION ALL ".join((
    sampled(WK, "roll_character", "character", "roll_w", VALID_CHARACTER),
    sampled(WK, "roll_type", "roll_type", "roll_w", VALID_TYPE),
    sampled(WK, "roll_value", "roll_value", ROLL_VALUE_ROWS, "true"),
    sampled(WK, "spell_character", "character", "spell_w", VALID_CHARACTER),
    sampled(WK, "spell", "spell", "spell_w", VALID_SPELL),
)), "roll_w", "spell_w", "roll_values")


def single_windows(episodes: str) -> str:
    return (f"SELECT campaign, CAST(episode AS VARCHAR) AS episodes, [episode] AS eps FROM (SELECT {EK}, row_number() OVER ("
            f"PARTITION BY campaign ORDER BY md5(concat_ws('|', '{SEED}', 'single', campaign, "
            f"CAST(episode AS VARCHAR))), episode) AS rk FROM {episodes}) WHERE rk <= {fixed.WINDOWS_PER_SIZE}")


def multi_windows(episodes: str) -> str:
    sizes = ", ".join(map(str, fixed.WINDOW_SIZES))
    return ("SELECT DISTINCT campaign, episodes, eps FROM (SELECT campaign, size, sample, "
            "string_agg(CAST(episode AS VARCHAR), '_' ORDER BY episode) AS episodes, list(episode ORDER BY episode) AS eps, "
            "count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY campaign, size, sample ORDER BY "
            f"md5(concat_ws('|', '{SEED}', 'multi', campaign, CAST(size AS VARCHAR), CAST(sample AS VARCHAR), "
            f"CAST(episode AS VARCHAR))), episode) AS rk FROM (SELECT {EK}, unnest([{sizes}]) AS size FROM {episodes}) "
            f"CROSS JOIN range(1, {fixed.WINDOWS_PER_SIZE + 1}) t(sample)) WHERE rk <= size "
            "GROUP BY campaign, size, sample) WHERE members = size")


WINDOW_ID = MD5_ID.format("concat(campaign, episodes)")
for name, picked in (("sample_single_windows", single_windows), ("sample_multi_windows", multi_windows)):
    ORACLES[name] = sql(
        f"SELECT {WINDOW_ID} AS context_window_id, campaign, episodes FROM ({picked('(' + EPISODES + ')')})",
        "spell_log")
PROBE_KINDS = ("rolls_cumulative", "rolls_cumulative_by_character", "spells_cumulative", "nth_1", "nth_2", "nth_3")


def probes(by: str, src: str) -> str:
    parts = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in by.split(","))
    kinds = ", ".join(quoted(k) for k in PROBE_KINDS)
    return (f"SELECT {by}, kind, CAST(ordinal AS INT) AS ordinal FROM (SELECT *, row_number() OVER ("
            f"PARTITION BY {by}, kind ORDER BY md5(concat_ws('|', '{SEED}', {parts}, kind, CAST(ordinal AS VARCHAR))), "
            f"ordinal) AS rk FROM (SELECT {by}, ordinal, unnest([{kinds}]) AS kind FROM {src})) WHERE rk <= {fixed.PROBES}")


ORACLES["probe_ordinals"] = sql(probes(WK, "members"), "members")
ORACLES["window_ids"] = sql(
    f"SELECT window_key, campaign, episodes, {WINDOW_ID} AS context_window_id FROM window_list", "window_list")


def fill(template: str, *params: str) -> str:
    """A question template as a SQL text expression."""
    pieces = template.split("%s")
    out = [quoted(pieces[0])]
    for param, piece in zip(params, pieces[1:]):
        out += [param, quoted(piece)]
    return "concat(" + ", ".join(out) + ")"


def cleaned(expr: str) -> str:
    return f"replace({expr}, '\"', concat(chr(92), '\"'))"


ORACLES["qa_ids"] = sql(
    f"SELECT window_key, campaign, question, {MD5_ID.format('concat(campaign, question, episodes)')} AS id FROM ("
    f"SELECT l.window_key, l.campaign, l.episodes, {cleaned(fill(fixed.WINDOW_QUESTIONS['rolls_by_character'], 'character'))} "
    f"AS question FROM window_list l JOIN (SELECT DISTINCT {WK}, character FROM roll_w WHERE {VALID_CHARACTER}) c "
    "USING (window_key, campaign))", "window_list", "roll_w")

# --- question sets: every kind computed from log rows of every sampled window -------------------------------------
G = "context_window_id"
QCTES = {
    "eligible": f"{EPISODES} WHERE {HAS_TEXT}",
    "ctx": f"SELECT {WINDOW_ID} AS context_window_id, campaign, episodes, eps, len(eps) = 1 AS single FROM ("
           f"{single_windows('eligible')} UNION ALL {multi_windows('eligible')})",
    "mem": "SELECT context_window_id, campaign, single, episode, row_number() OVER (PARTITION BY context_window_id "
           "ORDER BY episode) AS ordinal FROM (SELECT context_window_id, campaign, single, unnest(eps) AS episode FROM ctx)",
    "rw": "SELECT m.context_window_id, m.single, m.ordinal, r.* FROM mem m JOIN roll_log r USING (campaign, episode)",
    "sw": "SELECT m.context_window_id, m.single, m.ordinal, r.* FROM mem m JOIN spell_log r USING (campaign, episode)",
    "picked": " UNION ALL ".join((
        sampled("context_window_id", "roll_character", "character", "rw", VALID_CHARACTER),
        sampled("context_window_id", "roll_type", "roll_type", "rw", VALID_TYPE),
        sampled("context_window_id", "roll_value", "roll_value",
                "(SELECT context_window_id, roll_value FROM ctx CROSS JOIN roll_values)", "true"),
        sampled("context_window_id", "spell_character", "character", "sw", VALID_CHARACTER),
        sampled("context_window_id", "spell", "spell", "sw", VALID_SPELL))),
    "probed": probes("context_window_id", "(SELECT * FROM mem WHERE NOT single)"),
    "heads": f"SELECT *, row_number() OVER (PARTITION BY {EK} ORDER BY seq) AS rn, "
             f"row_number() OVER (PARTITION BY {EK} ORDER BY seq DESC) AS back FROM spell_log",
}


def q_count(kind: str, src: str, condition: str) -> str:
    return (f"SELECT c.{G}, '{kind}' AS kind, '' AS p1, '' AS p2, CAST(count(r.seq) AS VARCHAR) AS answer FROM ctx c "
            f"LEFT JOIN (SELECT * FROM {src} WHERE {condition}) r USING ({G}) GROUP BY c.{G}")


def q_param(kind: str, sample: str, src: str, column: str) -> str:
    return (f"SELECT p.{G}, '{kind}', p.value, '', CAST(count(r.seq) AS VARCHAR) FROM picked p LEFT JOIN {src} r "
            f"ON r.{G} = p.{G} AND r.{column} = p.value WHERE p.kind = '{sample}' GROUP BY p.{G}, p.value")


def q_player(kind: str, sample: str, src: str) -> str:
    return (f"SELECT p.{G}, '{kind}', y.player, '', CAST(count(r.seq) AS VARCHAR) FROM picked p "
            f"JOIN players y ON y.character = p.value AND y.character <> 'DM' "
            f"JOIN {src} r ON r.{G} = p.{G} AND r.character = p.value WHERE p.kind = '{sample}' GROUP BY p.{G}, y.player")


def q_list(kind: str, inner: str) -> str:
    return f"SELECT {G}, '{kind}', '', '', answer FROM ({inner})"


def q_cumulative(kind: str, log: str) -> str:
    return (f"SELECT m.{G}, '{kind}', CAST(m.ordinal AS VARCHAR), '', CAST(count(r.seq) AS VARCHAR) FROM probed m "
            f"JOIN mem u ON u.{G} = m.{G} AND u.ordinal <= m.ordinal LEFT JOIN {log} r ON r.campaign = u.campaign "
            f"AND r.episode = u.episode WHERE m.kind = '{kind}' GROUP BY m.{G}, m.ordinal")


def q_per_episode(kind: str, pick: str, by_character: bool) -> str:
    p1 = "p.value" if by_character else "''"
    join = (f"JOIN picked p ON p.{G} = s.{G} AND p.kind = 'spell_character' AND p.value = s.character"
            if by_character else "")
    return (f"SELECT {G}, '{kind}', p1, '', string_agg(spell, ', ' ORDER BY episode) FROM (SELECT s.{G}, {p1} AS p1, "
            f"s.episode, {pick}(s.spell, s.seq) AS spell FROM sw s {join} WHERE NOT s.single AND s.spell IS NOT NULL "
            f"GROUP BY s.{G}, p1, s.episode) GROUP BY {G}, p1")


def per_character(pick: str) -> str:
    return (f"SELECT {G}, string_agg(spell, ', ' ORDER BY character) AS answer FROM (SELECT {G}, character, "
            f"{pick}(spell, seq) AS spell FROM sw WHERE single AND spell IS NOT NULL AND character IS NOT NULL "
            f"GROUP BY {G}, character) GROUP BY {G}")


def q_ends(edge: str, column: str) -> str:
    return (f"SELECT m.{G}, concat('{edge}_', k), '', '', string_agg(h.spell, ', ' ORDER BY h.seq) FROM mem m "
            f"JOIN heads h USING (campaign, episode) JOIN range(1, 4) t(k) ON h.{column} <= k WHERE m.single "
            f"GROUP BY m.{G}, k")


def fmt(template: str, src: str) -> str:
    return template.format(src=src, by=G)


ANSWERS = "\nUNION ALL ".join((
    q_count("rolls_total", "rw", "true"),
    q_count("crits", "rw", "natural_value IN ('1', '20')"),
    q_count("nat20s", "rw", "natural_value = '20'"),
    q_count("nat1s", "rw", "natural_value = '1'"),
    q_count("spells_total", "sw", "true"),
    q_count("cantrips", "sw", "base_lvl = 'Cantrip'"),
    q_count("upcast_count", "sw", UPCAST),
    q_param("rolls_by_character", "roll_character", "rw", "character"),
    q_param("rolls_by_type", "roll_type", "rw", "roll_type"),
    q_param("rolls_by_value", "roll_value", "rw", "natural_value"),
    f"SELECT p.{G}, 'rolls_value_pct', p.value, '', CAST(CAST(round_even(CAST(count(*) FILTER (WHERE r.natural_value = p.value) "
    f"AS DOUBLE) / count(*) * 100.0, 0) AS BIGINT) AS VARCHAR) FROM picked p JOIN rw r USING ({G}) "
    f"WHERE p.kind = 'roll_value' GROUP BY p.{G}, p.value",
    q_param("spells_by_character", "spell_character", "sw", "character"),
    q_param("spells_by_name", "spell", "sw", "spell"),
    q_player("rolls_by_player", "roll_character", "rw"),
    q_player("spells_by_player", "spell_character", "sw"),
    q_list("roll_type_mode", fmt(ties("roll_type", "max", "roll_type"), "rw")),
    q_list("roll_type_rarest", fmt(ties("roll_type", "min", "first_seq"), "rw")),
    q_list("roll_value_mode", fmt(ties("natural_value", "max", "natural_value"), "rw")),
    q_list("roll_value_rarest", fmt(ties("natural_value", "min", "first_seq"), "rw")),
    q_list("spell_mode", fmt(ties("spell", "max", "spell"), "sw")),
    q_list("spell_rarest", fmt(ties("spell", "min", "first_seq"), "sw")),
    f"SELECT p.{G}, 'spell_caster_count', p.value, '', CAST(count(DISTINCT s.character) AS VARCHAR) FROM picked p "
    f"JOIN sw s ON s.{G} = p.{G} AND s.spell = p.value WHERE p.kind = 'spell' GROUP BY p.{G}, p.value",
    q_list("upcast_spells", f"SELECT {G}, string_agg(spell, ', ' ORDER BY fs) AS answer FROM (SELECT {G}, spell, "
                            f"min(seq) AS fs FROM sw WHERE {UPCAST} AND spell IS NOT NULL GROUP BY {G}, spell) GROUP BY {G}"),
    q_list("spells_multi_caster", f"SELECT {G}, string_agg(spell, ', ' ORDER BY fs) AS answer FROM (SELECT {G}, spell, "
                                  f"min(seq) AS fs FROM sw WHERE single AND spell IS NOT NULL GROUP BY {G}, spell "
                                  f"HAVING count(DISTINCT character) > 1) GROUP BY {G}"),
    q_ends("first", "rn"),
    q_ends("last", "back"),
    q_list("spell_first_per_character", per_character("arg_min")),
    q_list("spell_last_per_character", per_character("arg_max")),
    q_cumulative("rolls_cumulative", "roll_log"),
    q_cumulative("spells_cumulative", "spell_log"),
    f"SELECT m.{G}, 'rolls_cumulative_by_character', p.value, CAST(m.ordinal AS VARCHAR), CAST(count(r.seq) AS VARCHAR) "
    f"FROM probed m JOIN picked p ON p.{G} = m.{G} AND p.kind = 'roll_character' JOIN mem u ON u.{G} = m.{G} "
    "AND u.ordinal <= m.ordinal LEFT JOIN roll_log r ON r.campaign = u.campaign AND r.episode = u.episode "
    f"AND r.character = p.value WHERE m.kind = 'rolls_cumulative_by_character' GROUP BY m.{G}, p.value, m.ordinal",
    f"SELECT m.{G}, m.kind, CAST(m.ordinal AS VARCHAR), '', h.spell FROM probed m JOIN mem u ON u.{G} = m.{G} "
    "AND u.ordinal = m.ordinal JOIN heads h ON h.campaign = u.campaign AND h.episode = u.episode "
    "WHERE m.kind = concat('nth_', h.rn)",
    q_per_episode("first_spell_per_episode", "arg_min", False),
    q_per_episode("last_spell_per_episode", "arg_max", False),
    q_per_episode("first_spell_by_character", "arg_min", True),
    q_per_episode("last_spell_by_character", "arg_max", True),
))


def wording(templates: dict[str, str]) -> str:
    cases = []
    for kind, template in templates.items():
        params = ["p1", "p2"][: template.count("%s")]
        cases.append(f"WHEN {quoted(kind)} THEN {fill(template, *params)}")
    return "CASE kind " + " ".join(cases) + " END"


SPELL_KINDS = "regexp_matches(kind, 'spell|cantrip|upcast|^first_|^last_|^nth_')"
QCTES["answers"] = ANSWERS
QCTES["qa"] = (
    f"SELECT c.context_window_id, c.campaign, c.episodes, "
    f"{cleaned(f'CASE WHEN c.single THEN {wording(fixed.EPISODE_QUESTIONS)} ELSE {wording(fixed.WINDOW_QUESTIONS)} END')} "
    f"AS question, {cleaned('answer')} AS answer, concat(CASE WHEN c.single THEN 'singledoc_' ELSE 'multidoc_' END, "
    f"CASE WHEN {SPELL_KINDS} THEN 'spells' ELSE 'rolls' END) AS question_type FROM answers JOIN ctx c USING ({G})")
USABLE = f"answer IS NOT NULL AND answer <> '' AND lower(answer) NOT IN {words(fixed.EMPTY_ANSWERS)}"
QBASE = ("roll_log", "spell_log", "turns", "players", "roll_values")
ORACLES["qa_rows"] = sql(
    f"SELECT {MD5_ID.format('concat(campaign, question, episodes)')} AS id, context_window_id, question, answer, "
    f"question_type, episodes, campaign FROM qa WHERE {USABLE}", *QBASE, extra=QCTES)
ORACLES["qa_counts_by_type"] = sql(
    f"SELECT campaign, question_type, count(*) AS n FROM qa WHERE {USABLE} GROUP BY campaign, question_type",
    *QBASE, extra=QCTES)
ORACLES["qa_filter"] = sql(
    f"SELECT seq, campaign, episode, natural_value AS answer FROM roll_log WHERE {USABLE.replace('answer', 'natural_value')}",
    "roll_log")
ORACLES["qa_pairs_json"] = sql(
    "SELECT CAST(json_object('question', "
    f"{cleaned(quoted(fixed.EPISODE_QUESTIONS['roll_type_mode']))}, 'answer', {cleaned('answer')}) AS VARCHAR) AS value "
    f"FROM ({ties('roll_type', 'max', 'roll_type').format(by=EK, src='roll_log')})", "roll_log")
ORACLES["split_routing"] = sql(
    f"SELECT {EK}, count(*) AS n, CASE campaign WHEN 'campaign1' THEN 'test' WHEN 'campaign2' THEN 'validation' END AS split "
    f"FROM roll_log GROUP BY {EK}", "roll_log")
ORACLES["clean_text"] = (
    f"SELECT event_id, {cleaned('props')} AS cleaned, CAST(user_id AS VARCHAR) AS number, "
    f"array_to_string(list_transform(string_split(props, ' '), lambda x: {cleaned('x')}), '|') AS items FROM events")
ORACLES["transcript_lines"] = sql("SELECT campaign, episode, seq, line FROM lines", "lines")
ORACLES["context_window_text"] = sql(
    "SELECT m.window_key, m.campaign, CAST(1 AS BIGINT) AS part, concat("
    f"CASE WHEN count(*) = 1 THEN {quoted(fixed.SINGLE_PROMPT)} ELSE {quoted(fixed.MULTI_PROMPT)} END, chr(10), chr(10), "
    f"any_value(pp.prompt), string_agg(concat({quoted(fixed.EPISODE_START)}, t.body, {quoted(fixed.EPISODE_END)}), "
    "concat(chr(10), chr(10)) ORDER BY m.ordinal)) AS text FROM members m JOIN ("
    f"SELECT {EK}, string_agg(concat(line, chr(10)), '' ORDER BY seq) AS body FROM lines GROUP BY {EK}) t "
    "USING (campaign, episode) CROSS JOIN pp GROUP BY m.window_key, m.campaign",
    "members", "lines", "players", extra={"pp": (
        f"SELECT concat({quoted(fixed.PLAYER_PROMPT_HEAD)}, string_agg(concat(player, ' plays the character ', character, "
        f"'.'), chr(10) ORDER BY first_seq), {quoted(fixed.PLAYER_PROMPT_TAIL)}) AS prompt FROM players")})

ODD = "window_key IN ('w0', 'w2', 'w4') AND episode % 16 < 10"
ORACLES["stored_context_text"] = sql(
    "SELECT window_key, campaign, CAST(1 AS BIGINT) AS part, string_agg(concat("
    f"{quoted(fixed.EPISODE_START)}, body, {quoted(fixed.EPISODE_END)}), concat(chr(10), chr(10)) ORDER BY episode) AS text "
    f"FROM windows JOIN (SELECT {EK}, string_agg(concat(line, chr(10)), '' ORDER BY seq) AS body FROM lines GROUP BY {EK}) "
    f"USING (campaign, episode) WHERE {ODD} GROUP BY window_key, campaign", "windows", "lines")
ORACLES["stored_window_rolls"] = sql(
    count_per("roll_type", VALID_TYPE).format(by=WK, src=f"(SELECT * FROM roll_w WHERE {ODD})"), "roll_w")

ORACLES["window_caster_sets"] = ORACLES["window_spell_caster_count"]
ORACLES["window_type_sets"] = sql(
    f"SELECT {WK}, roll_type, count(DISTINCT natural_value) AS n, min(seq) AS first_seq FROM roll_w WHERE {VALID_TYPE} "
    f"GROUP BY {WK}, roll_type HAVING count(DISTINCT natural_value) > 10", "roll_w")

# --- evaluation planning ---------------------------------------------------------------------------------------------
LEN = "CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS BIGINT)"
ORACLES["context_len"] = f"SELECT doc_id, {LEN} AS context_len FROM documents"
ORACLES["context_len_range"] = (
    f"SELECT * FROM ({ORACLES['context_len']}) WHERE context_len > {fixed.MIN_CONTEXT_LEN} "
    f"AND context_len <= {fixed.MAX_CONTEXT_LEN}")
ORACLES["text_variant_select"] = (
    "SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS context_md5 FROM "
    "(SELECT doc_id, concat(text, ' [language ', lang, ']') AS t FROM documents)")
ORACLES["prompt_messages"] = (
    f"SELECT CAST(doc_id AS VARCHAR) AS id, 0 AS message_no, 0 AS part_no, 'system' AS role, md5({quoted(fixed.SYSTEM_TEXT)}) AS text, "
    "CAST(NULL AS VARCHAR) AS cache_control FROM documents UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 0, 1, 'system', md5(text), 'ephemeral' FROM documents UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 1, 0, 'user', md5(concat('Which language does source ', source, ' use?')), NULL FROM documents")
NUMBERED = ("SELECT id, context_window_id, row_number() OVER (ORDER BY context_window_id, id) AS row_no FROM boxed_outputs")
BATCHED = "SELECT *, (row_no - 1) // 8 AS batch_id FROM numbered"
BATCH = {"numbered": NUMBERED, "batched": BATCHED}
ORACLES["batch_assign"] = sql("SELECT * FROM batched", "boxed_outputs", extra=BATCH)
ORACLES["partial_batch_ranges"] = sql(
    "SELECT batch_id, count(*) AS n, min(row_no) - 1 AS first_row, max(row_no) - 1 AS last_row FROM batched "
    "GROUP BY batch_id", "boxed_outputs", extra=BATCH)
ORACLES["seed_and_rest"] = sql(
    "SELECT id, context_window_id, CASE WHEN row_number() OVER (PARTITION BY context_window_id ORDER BY id) = 1 "
    "THEN 'seed' ELSE 'rest' END AS role FROM boxed_outputs", "boxed_outputs")
ORACLES["resume_pending"] = sql(
    "SELECT id, context_window_id, answer FROM boxed_outputs WHERE output IS NULL", "boxed_outputs")

# --- scoring ------------------------------------------------------------------------------------------------------------
P_TEXT = "'\\\\boxed\\{\\\\text\\{([^}]*)\\}\\}'"
P_BOX = "'\\\\boxed[{]+([^}]*)[}]+'"
INT = "regexp_full_match(trim({0}, " + WS + "), '[+-]?[0-9]+(_[0-9]+)*')"
TO_INT = "TRY_CAST(replace(trim({0}, " + WS + "), '_', '') AS BIGINT)"
ITEMS = "list_filter(list_transform(string_split({0}, ','), lambda x: trim(x, " + WS + ")), lambda x: x <> '')"
BOXED_CTES = {
    "parsed": "SELECT *, CASE WHEN regexp_matches(output, " + P_TEXT + ") THEN regexp_extract(output, " + P_TEXT + ", 1) "
              "WHEN regexp_matches(output, " + P_BOX + ") THEN regexp_extract(output, " + P_BOX + ", 1) END AS boxed "
              "FROM boxed_outputs WHERE output IS NOT NULL",
    "typed": "SELECT *, CASE WHEN boxed IS NULL THEN 'string' WHEN " + INT.format("boxed") + " THEN 'int' "
             "WHEN contains(boxed, ',') THEN 'list' ELSE 'string' END AS pk, coalesce(boxed, output) AS ps, "
             "CASE WHEN " + INT.format("answer") + " THEN 'int' WHEN contains(answer, ',') THEN 'list' ELSE 'string' END AS gk "
             "FROM parsed",
    "scored": "SELECT id, context_window_id, answer AS gold, output, ps, pk, gk, boxed, CAST(CASE WHEN pk <> gk THEN 0.0 "
              "WHEN pk = 'int' THEN coalesce(pow(0.75, abs(" + TO_INT.format("answer") + " - " + TO_INT.format("ps") + ")), 0.0) "
              "WHEN pk = 'string' THEN CASE WHEN lower(trim(ps, " + WS + ")) = lower(trim(answer, " + WS + ")) THEN 1.0 ELSE 0.0 END "
              "ELSE CAST(len(list_distinct(list_intersect(" + ITEMS.format("answer") + ", " + ITEMS.format("ps") + "))) AS DOUBLE) "
              "/ len(" + ITEMS.format("answer") + ") END AS DOUBLE) AS score FROM typed",
}


def shown(kind: str, text: str) -> str:
    return (f"CASE {kind} WHEN 'int' THEN CAST({TO_INT.format(text)} AS VARCHAR) "
            f"WHEN 'list' THEN array_to_string({ITEMS.format(text)}, ', ') ELSE {text} END")


ORACLES["parse_boxed"] = sql(
    "SELECT id, coalesce(boxed, output) AS parsed, CASE WHEN boxed IS NULL THEN 'low' ELSE 'high' END AS parse_confidence "
    "FROM parsed", "boxed_outputs", extra={"parsed": BOXED_CTES["parsed"]})
ORACLES["type_answer"] = sql(
    "SELECT id, CASE WHEN " + INT.format("answer") + " THEN 'int' WHEN contains(answer, ',') THEN 'list' ELSE 'string' END "
    "AS kind, CASE WHEN " + INT.format("answer") + " THEN " + TO_INT.format("answer") + " END AS i, CASE WHEN NOT "
    + INT.format("answer") + " AND contains(answer, ',') THEN array_to_string(" + ITEMS.format("answer") + ", '|') END AS items "
    "FROM boxed_outputs", "boxed_outputs")
ORACLES["score_boxed"] = sql(
    "SELECT id, context_window_id, 'm1' AS model, " + shown("pk", "ps") + " AS attempted_parse, CASE WHEN boxed IS NULL "
    "THEN 'low' ELSE 'high' END AS parse_confidence, output AS full_answer, score, " + shown("gk", "gold") + " AS answer "
    "FROM scored", "boxed_outputs", extra=BOXED_CTES)
DEC = "CAST(score AS DECIMAL(20,12))"
ORACLES["resume_state"] = sql(
    f"SELECT count(*) AS n_done, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS sum_score FROM scored",
    "boxed_outputs", extra=BOXED_CTES)
ALL_SCORED = {**BOXED_CTES, "everything": "SELECT id, score FROM scored UNION ALL SELECT id, 0.0 FROM boxed_outputs WHERE output IS NULL"}
ORACLES["running_score"] = sql(
    "SELECT batch_id, n, CAST(sum(n) OVER w AS BIGINT) AS rows_so_far, CAST(sum(s) OVER w AS DOUBLE) / "
    "CAST(sum(n) OVER w AS DOUBLE) AS score_so_far FROM (SELECT batch_id, count(*) AS n, "
    f"sum({DEC}) AS s FROM batched JOIN everything USING (id) GROUP BY batch_id) WINDOW w AS (ORDER BY batch_id)",
    "boxed_outputs", extra={**ALL_SCORED, **BATCH})
TOTAL = (f"SELECT count(*) AS n, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS correct, "
         f"CAST(coalesce(sum({DEC}), 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS score FROM everything")
ORACLES["overall_score"] = sql(TOTAL, "boxed_outputs", extra=ALL_SCORED)
ORACLES["overall_summary"] = sql(
    "SELECT concat('Overall score for m1 on ', n, ' examples: ', correct, '/', n, ' = ', score) AS summary "
    f"FROM ({TOTAL})", "boxed_outputs", extra=ALL_SCORED)
ORACLES["score_error_rows"] = sql(
    "SELECT id, context_window_id, 'm1' AS model, 'ERROR' AS attempted_parse, 'ERROR' AS parse_confidence, "
    "'ERROR' AS full_answer, CAST(0 AS DOUBLE) AS score, trim(trim(answer, '['), ']') AS answer FROM boxed_outputs "
    "WHERE output IS NULL", "boxed_outputs")
ORACLES["content_filtered"] = sql(
    "SELECT id, CASE WHEN output IS NULL AND finish_reason = 'content_filter' THEN 'CONTENT_FILTERED' ELSE output END "
    "AS output FROM boxed_outputs", "boxed_outputs")
SNAP = " ".join(f"WHEN contains(cand, '{p}') THEN '{p}'" for p in fixed.COMPARISONS)
CUES = " OR ".join(f"contains(output, '{c}')" for c in fixed.ANSWER_CUES)
CUED_CTES = {
    "cut": "SELECT *, contains(output, ':') AS colon, CASE WHEN contains(output, ':') THEN "
           "translate(trim(string_split(output, ':')[-1], " + WS + "), '*[]', '') WHEN length(output) < 20 THEN output "
           "ELSE regexp_extract(trim(output, " + WS + "), '(\\S+)$', 1) END AS cand FROM cued_outputs",
    "cued": "SELECT *, CASE WHEN NOT colon OR length(cand) < 20 THEN cand " + SNAP + " ELSE cand END AS candidate, "
            "CASE WHEN NOT colon THEN 'low' WHEN length(cand) < 20 THEN 'vhigh' WHEN " + CUES + " THEN 'high' ELSE 'med' END AS conf, "
            "CASE WHEN contains(answer, 'datetime') THEN CAST(make_date(CAST(regexp_extract(answer, '\\(([0-9]+), ([0-9]+), ([0-9]+)\\)', 1) AS INT), "
            "CAST(regexp_extract(answer, '\\(([0-9]+), ([0-9]+), ([0-9]+)\\)', 2) AS INT), "
            "CAST(regexp_extract(answer, '\\(([0-9]+), ([0-9]+), ([0-9]+)\\)', 3) AS INT)) AS DATE) END AS gold_date FROM cut",
    "golded": "SELECT *, CASE WHEN gold_date IS NOT NULL THEN concat(CAST(gold_date AS VARCHAR), ' 00:00:00') "
              "ELSE trim(answer, concat('[]', chr(39))) END AS gold_text FROM cued",
    "tried": "SELECT *, CASE WHEN candidate = gold_text THEN 'same' WHEN candidate IN " + words(fixed.COMPARISONS) + " THEN 'phrase' "
             "WHEN answer_type = 'ANSWER_TYPE.NUMERIC' THEN 'number' WHEN answer_type = 'ANSWER_TYPE.DATE' THEN 'date' END AS rule, "
             "TRY_CAST(CASE WHEN regexp_full_match(candidate, '[0-9]+') THEN candidate END AS BIGINT) AS no, "
             "TRY_CAST(CASE WHEN regexp_full_match(gold_text, '[0-9]+') THEN gold_text END AS BIGINT) AS gno, "
             "CAST(try_strptime(candidate, ['%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%Y/%m/%d', '%m/%d/%Y', '%B %d %Y']) AS DATE) AS day FROM golded",
}
ORACLES["parse_cued"] = sql("SELECT id, candidate, conf AS parse_confidence FROM cued", "cued_outputs", extra=CUED_CTES)
ORACLES["gold_literal"] = sql(
    "SELECT id, gold_text, CAST(gold_date AS VARCHAR) AS gold_date FROM golded", "cued_outputs", extra=CUED_CTES)
ORACLES["score_cued"] = sql(
    "SELECT id, context_window_id, 'm1' AS model, CASE WHEN rule = 'number' AND no IS NOT NULL THEN CAST(no AS VARCHAR) "
    "WHEN rule = 'date' AND day IS NOT NULL THEN concat(CAST(day AS VARCHAR), ' 00:00:00') ELSE candidate END AS attempted_parse, "
    "CASE WHEN (rule = 'number' AND (no IS NULL OR gno IS NULL)) OR (rule = 'date' AND day IS NULL) THEN 'low' ELSE conf END "
    "AS parse_confidence, output AS full_answer, CAST(CASE rule WHEN 'same' THEN 1.0 WHEN 'phrase' THEN "
    "CASE WHEN contains(gold_text, candidate) THEN 1.0 ELSE 0.0 END WHEN 'number' THEN coalesce(pow(0.75, abs(gno - no)), 0.0) "
    "WHEN 'date' THEN CASE WHEN day = gold_date THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS DOUBLE) AS score, gold_text AS answer "
    "FROM tried", "cued_outputs", extra=CUED_CTES)
ORACLES["label_frequency_compare"] = (
    "WITH c AS (SELECT lang, concat('quality ', CAST(quality AS VARCHAR), ' toxic ', CAST(toxic AS VARCHAR)) AS label, "
    "count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT lang, label_a, label_b, "
    "CASE WHEN n_a > n_b THEN 'more common than' WHEN n_a < n_b THEN 'less common than' ELSE 'same frequency as' END AS relation "
    "FROM (SELECT lang, label AS label_a, n AS n_a, lead(label) OVER w AS label_b, lead(n) OVER w AS n_b FROM c "
    "WINDOW w AS (PARTITION BY lang ORDER BY label)) WHERE label_b IS NOT NULL")
NOTHING = "CAST(NULL AS VARCHAR) AS "
ORACLES["score_stream"] = sql(
    f"SELECT id, context_window_id, {NOTHING}dataset, 'm1' AS model, " + shown("pk", "ps") + " AS attempted_parse, "
    "CASE WHEN boxed IS NULL THEN 'low' ELSE 'high' END AS parse_confidence, output AS full_answer, score, "
    f"CAST(NULL AS BIGINT) AS context_len, {NOTHING}task_group, {NOTHING}task, {NOTHING}answer_type, "
    + shown("gk", "gold") + " AS answer FROM scored", "boxed_outputs", extra=BOXED_CTES)

STREAM_BATCH = {**BATCH, "batched": "SELECT *, (row_no - 1) // 16 AS batch_id FROM numbered"}
ORACLES["running_score_stream"] = sql(
    "SELECT batch_id, n, n_missing, CAST(sum(n) OVER w AS BIGINT) AS rows_so_far, CAST(sum(s) OVER w AS DOUBLE) / "
    "CAST(sum(n) OVER w AS DOUBLE) AS score_so_far FROM (SELECT batch_id, count(*) AS n, count_if(missing) AS n_missing, "
    f"sum({DEC}) AS s FROM batched JOIN everything USING (id) GROUP BY batch_id) WINDOW w AS (ORDER BY batch_id)",
    "boxed_outputs", extra={**BOXED_CTES, **STREAM_BATCH, "everything":
                            "SELECT id, score, false AS missing FROM scored UNION ALL SELECT id, 0.0, finish_reason <> "
                            "'content_filter' FROM boxed_outputs WHERE output IS NULL"})
STREAMED = {**BOXED_CTES, **STREAM_BATCH, "streamed": (
    "SELECT id, CASE WHEN boxed IS NULL THEN 'low' ELSE 'high' END AS parse_confidence, output AS full_answer, score, "
    + shown("gk", "gold") + " AS answer FROM scored UNION ALL SELECT id, 'low', 'CONTENT_FILTERED', 0.0, "
    + shown("CASE WHEN " + INT.format("answer") + " THEN 'int' WHEN contains(answer, ',') THEN 'list' ELSE 'string' END", "answer")
    + " FROM boxed_outputs WHERE output IS NULL AND finish_reason = 'content_filter'")}
ORACLES["run_stream_rows"] = sql(
    "SELECT id, batch_id, parse_confidence, full_answer, score, answer FROM streamed JOIN batched USING (id)",
    "boxed_outputs", extra=STREAMED)
ORACLES["run_stream_parts"] = sql(
    f"SELECT 'batch' AS part, CAST(batch_id AS VARCHAR) AS name, count(*) AS n, CAST(sum({DEC}) AS DOUBLE) AS score "
    "FROM streamed JOIN batched USING (id) GROUP BY batch_id UNION ALL "
    "SELECT 'reject', concat_ws(' ', id, finish_reason), 1, 0.0 FROM boxed_outputs WHERE output IS NULL AND "
    "finish_reason <> 'content_filter' UNION ALL "
    "SELECT 'summary', concat('Overall score for m1 on ', n, ' examples: ', correct, '/', n, ' = ', correct / n), 1, 0.0 "
    f"FROM (SELECT (SELECT count(*) FROM boxed_outputs) AS n, CAST(sum({DEC}) AS DOUBLE) AS correct FROM streamed)",
    "boxed_outputs", extra=STREAMED)

ORACLES["free_dates"] = (
    "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events")

# --- files written and read again: the oracle works on the rows before they were written ---------------------------
ORACLES["log_files_edges"] = sql(
    "SELECT campaign, episode, count(*) AS n, arg_min(character, seq) AS first_character, "
    "arg_max(natural_value, seq) AS last_value FROM (SELECT seq, campaign, episode, coalesce(character, 'nobody') AS character, "
    "natural_value FROM roll_log) GROUP BY 1, 2", "roll_log")
ORACLES["episode_files"] = sql(
    "SELECT campaign, episode, count(*) AS n, arg_min(coalesce(spell, '-'), seq) AS first_spell, arg_max(character, seq) AS "
    "last_character, count(cast_at) AS n_cast, count(*) AS n_time FROM spell_log GROUP BY 1, 2", "spell_log")
# rows count in the order of the steps their files came in
STEPPED = {"roll_log": ("SELECT * REPLACE (seq + 1000000000000 * (CASE WHEN seq % 3 = 0 THEN 0 WHEN episode % 9 = 4 THEN 2 ELSE 1 END) "
                        "AS seq) FROM (" + CTES["roll_log"] + ")"),
           "windows": CTES["windows"], "roll_w": CTES["roll_w"]}
ORACLES["kept_answers"] = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in STEPPED.items()) + (
    " SELECT window_key, campaign, 'roll_type_mode' AS question, '' AS key, answer FROM ("
    + ties("roll_type", "max", "roll_type").format(by=WK, src="roll_w") + ") UNION ALL SELECT window_key, campaign, 'rolls_by_type', "
    "roll_type, CAST(n AS VARCHAR) FROM (" + count_per("roll_type", VALID_TYPE).format(by=WK, src="roll_w") + ") UNION ALL "
    "SELECT window_key, campaign, 'roll_type_rarest', '', answer FROM (" + ties("roll_type", "min", "first_seq").format(by=WK, src="roll_w") + ")")
TEXTS = ("SELECT campaign, episode, string_agg(line, chr(10) ORDER BY seq){0} AS text FROM lines {1} GROUP BY 1, 2")
ORACLES["transcript_files"] = sql(
    "SELECT campaign, episode, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM ("
    + TEXTS.format(" || chr(10)", "WHERE episode % 10 <> 7") + ") UNION ALL SELECT DISTINCT 'none', episode, 0, '' FROM lines "
    "WHERE episode % 10 = 7", "lines")
ORACLES["transcript_named_files"] = sql(
    "SELECT campaign, episode, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM ("
    + TEXTS.format(" || chr(10)", "WHERE campaign = 'campaign1'") + ")", "lines")
ORACLES["dataset_files"] = sql(
    "SELECT CAST(doc_id AS VARCHAR) AS context_window_id, CAST(2 AS BIGINT) AS n, concat(doc_id, '-b') AS last_id, "
    "md5(text) AS text_md5 FROM documents")
ORACLES["question_set_files"] = sql(
    "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS n, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5, "
    f"{LEN} AS context_len FROM documents")
# an id has an output twice or none; empty ones with a reason count as filtered, others stay open
ORACLES["score_run_summary"] = sql(
    "SELECT concat('Overall score for m1 on ', n, ' examples: ', correct, '/', n, ' = ', score) AS summary "
    f"FROM ({TOTAL})", "boxed_outputs", extra={**BOXED_CTES, "everything": "SELECT id, score FROM scored "
    "UNION ALL SELECT id, 0.0 FROM boxed_outputs WHERE output IS NULL"})
