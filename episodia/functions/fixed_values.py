"""Texts, word lists and constants that decide results and ids.

They are part of the data contract (ids are digests over question text), so they are stated here
plainly and nowhere else.
"""

SEED = 31

# --- soft nulls and stop words ---------------------------------------------------------------
CHARACTER_STOP_WORDS = ("others", "unknown")
ROLL_TYPE_STOP_WORDS = ("other", "unknown")
SPELL_STOP_WORDS = ("unknown", "other")
EMPTY_ANSWERS = ("nan", "none", "unknown")
GAME_MASTER = "DM"
CANTRIP = "Cantrip"

# texts that a delimited-file reader with default settings takes as missing
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# white space as a Unicode-aware strip understands it
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- sampling ----------------------------------------------------------------------------------
ROLL_VALUES = tuple(str(v) for v in range(1, 21))
PARAMS_PER_KIND = 2
WINDOW_SIZES = (2, 3, 4, 5, 6, 7, 8, 10, 16, 24)
WINDOWS_PER_SIZE = 10
WINDOWS_PER_SIZE_TOY = 1
PROBES = 3
PROBES_TOY = 1

# --- campaigns -----------------------------------------------------------------------------------
CAMPAIGN_BY_PREFIX = {"C1": "campaign1", "C2": "campaign2"}
SPLIT_BY_CAMPAIGN = {"campaign1": "test", "campaign2": "validation"}
EXTRA_COLUMN_CAMPAIGN = "campaign2"
EXTRA_COLUMN_EPISODES = (20, 46)

# --- evaluation ----------------------------------------------------------------------------------
MIN_CONTEXT_LEN = 1024
MAX_CONTEXT_LEN = 131072
PARTIAL_CREDIT = 0.75
PHRASE = "How do you want to do this?"
COMPARISONS = ("more common", "less common", "same frequency")
ANSWER_CUES = ("User:", "Answer:", "Date:", "Label")
SHORT_ANSWER = 20
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy",
    "d MMMM yyyy", "d MMMM, yyyy", "d MMM yyyy", "d MMM, yyyy", "d-MMM-yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy MMMM d",
)
# words of free dates; a month counts by its number here, and fillers say nothing
MONTHS = {name: k // 2 + 1 for k, name in enumerate((
    "january", "jan", "february", "feb", "march", "mar", "april", "apr", "may", "may", "june", "jun", "july", "jul",
    "august", "aug", "september", "sep", "october", "oct", "november", "nov", "december", "dec"))} | {"sept": 9}
DATE_FILLERS = ("of", "the", "on", "monday", "mon", "tuesday", "tue", "tues", "wednesday", "wed", "thursday", "thu", "thur", "thurs",
                "friday", "fri", "saturday", "sat", "sunday", "sun")
SYSTEM_TEXT = "You are a helpful assistant."
FILTERED_OUTPUT = "CONTENT_FILTERED"

# --- question types --------------------------------------------------------------------------------
SINGLE_ROLLS = "singledoc_rolls"
SINGLE_SPELLS = "singledoc_spells"
MULTI_ROLLS = "multidoc_rolls"
MULTI_SPELLS = "multidoc_spells"

# --- question texts, one episode ---------------------------------------------------------------------
EPISODE_QUESTIONS = {
    "rolls_total": "Total number of rolls in this episode?",
    "rolls_by_character": "Total number of rolls by the character %s in this episode?",
    "rolls_by_player": "Total number of rolls by the player %s in this episode?",
    "rolls_by_type": "Total number of rolls of type %s in this episode?",
    "rolls_by_value": "Number of rolls of natural value %s in this episode?",
    "rolls_value_pct": "In this episode, what percentage of rolls were of value %s? round to the nearest integer.",
    "roll_type_mode": "What is the most common roll type in this episode? Return a comma separated list.",
    "roll_type_rarest": "What is the least common roll type in this episode? Only include types with more than one roll. Return a comma separated list.",
    "roll_value_mode": "What is the most common natural roll value in this episode? Return a comma separated list.",
    "roll_value_rarest": "What is the least common natural roll value in this episode? Only include values with more than one roll. Return a comma separated list.",
    "crits": "What is the count of Crits? (natural rolls of value 1 or 20)?",
    "nat20s": "What is the count of Nat20s (natural rolls of value 20)?",
    "nat1s": "What is the count of Nat1s (natural rolls of value 1)?",
    "spells_total": "How many spells were cast during this episode?",
    "spells_by_character": "How many spells were cast by the character %s in this episode?",
    "spells_by_player": "How many spells were cast by the player %s in this episode?",
    "spells_by_name": "How many %s spells were cast during this episode?",
    "first_1": "What is the first spell cast in this episode?",
    "first_2": "What are the first two spells cast in this episode?",
    "first_3": "What are the first three spells cast in this episode?",
    "last_1": "What is the last spell cast in this episode?",
    "last_2": "What are the last two spells cast in this episode?",
    "last_3": "What are the last three spells cast in this episode?",
    "spell_first_per_character": "What is the first spell cast by each character in this episode? Return a comma separated list and retain the order of spells as they appear in the episode.",
    "spell_last_per_character": "What is the last spell cast by each character in this episode? Return a comma separated list and retain the order of spells as they appear in the episode.",
    "spell_caster_count": "How many characters cast %s spell in this episode?",
    "spell_mode": "What is the most common spell in this episode? Return a comma separated list.",
    "spell_rarest": "What is the least common spell in this episode? Only include spells that were cast at least once. Return a comma separated list.",
    "spells_multi_caster": "Which spells were cast by more than one character in this episode? Return a comma separated list.",
    "cantrips": "What is the total number of cantrip spells cast in this episode?",
    "upcast_count": "In this episode, how many times was a spell cast at a level higher than its base level?",
    "upcast_spells": "In this episode, which spells were cast at a level higher than their base level? Return a comma separated list of unique spells.",
    "kills_total": "Total number of kills in this episode?",
    "kills_by_character": "What are the total number of kills by character %s in this episode?",
    "damage_total": "What is the total damage dealt during this episode?",
    "damage_by_character": "What is the total damage dealt by the character %s in this episode?",
    "phrase_count": "How many times does the Dungeon Master ask 'How do you want to do this?' in this episode?",
    "spells_in_order": "Return a comma separated list and retain the order of spells as they appear in the episode.",
}

# --- question texts, several episodes --------------------------------------------------------------
WINDOW_QUESTIONS = {
    "rolls_cumulative": "What is the cummulative total of rolls by the end of episode %s? Count the number of rolls and not the values of the rolls.",
    "rolls_cumulative_by_character": "What is the cummulative total of rolls by the character %s at the end of episode %s? Count the number of rolls and not the values of the rolls.",
    "rolls_total": "Total number of rolls across all the episodes?",
    "rolls_by_character": "Total number of rolls by the character %s across all episodes?",
    "rolls_by_player": "Total number of rolls by the player %s across all episodes?",
    "rolls_by_type": "Total number of rolls of type %s across all episodes?",
    "rolls_by_value": "Number of rolls of natural value %s across all episodes?",
    "rolls_value_pct": "Across all episodes, what percentage of rolls were of value %s? round to the nearest integer.",
    "roll_type_mode": "What is the most common roll type across all episodes? Return a comma separated list.",
    "roll_type_rarest": "What is the least common roll type across all episodes? Only include types with more than one roll. Return a comma separated list.",
    "roll_value_mode": "What is the most common natural roll value across all episodes? Return a comma separated list.",
    "roll_value_rarest": "What is the least common natural roll value across all episodes? Only include values with more than one roll. Return a comma separated list.",
    "crits": "What is the total count of Crits across all episodes? (natural rolls of value 1 or 20)?",
    "nat20s": "What is the total count of Nat20s across all episodes? (natural rolls of value 20)?",
    "nat1s": "What is the total count of Nat1s across all episodes? (natural rolls of value 1)?",
    "spells_cumulative": "What is the cummulative total of spells cast by the end of episode %s?",
    "nth_1": "What is the first spell cast in the episode %s?",
    "nth_2": "What is the second spell cast in the episode %s?",
    "nth_3": "What is the third spell cast in the episode %s?",
    "first_spell_per_episode": "List the first spell cast in each episode? Return a comma separated list.",
    "last_spell_per_episode": "List the last spell cast in each episode? Return a comma separated list.",
    "first_spell_by_character": "List the first spell cast by the character %s in each episode? Return a comma separated list.",
    "last_spell_by_character": "List the last spell cast by the character %s in each episode? Return a comma separated list.",
    "spells_total": "How many spells were cast across all episodes?",
    "spells_by_character": "How many spells were cast by the character %s across all episodes?",
    "spells_by_player": "How many spells were cast by the player %s across all episodes?",
    "spells_by_name": "How many %s spells were cast across all episodes?",
    "spell_caster_count": "How many characters cast %s spell across all episodes?",
    "spell_mode": "What is the most common spell across all episodes? Return a comma separated list.",
    "spell_rarest": "What is the least common spell across all episodes? Only include spells that were cast at least once. Return a comma separated list.",
    "cantrips": "What is the total number of cantrip spells cast across all episodes?",
    "upcast_count": "Across all episodes, how many times was a spell cast at a level higher than its base level?",
    "upcast_spells": "Across all episodes, which spells were cast at a level higher than their base level? Return a comma separated list of unique spells.",
}

# --- prompts and delimiters ------------------------------------------------------------------------
SINGLE_PROMPT = (
    "The following lines contains a single episode transcript of a Dungeons and Dragons game played by a group of players. "
    "The episode transcript is delimited by [START OF EPISODE] and [END OF EPISODE]. "
    "The transcript is followed by a question about the game statistics. "
    "Answer the question based on the transcript. "
    "Do not try to guess, estimate or approximate the result. "
    "Do not ask the user for clarification or follow-up. "
    "Do step-by-step reasoning if needed. "
    "Return the final answer in \\boxed{{}}. "
)
MULTI_PROMPT = (
    "The following lines contains multiple episode transcripts of a Dungeons and Dragons game played by a group of players. "
    "Each episode transcript is delimited by [START OF EPISODE] and [END OF EPISODE]. "
    "The transcripts are followed by a question about the game statistics. "
    "Answer the question based on the transcripts. "
    "Do not try to guess, estimate or approximate the result. "
    "Do not ask the user for clarification or follow-up. "
    "Do step-by-step reasoning if needed. "
    "Return the final answer in \\boxed{{}}. "
)
PLAYER_SENTENCE = "%s plays the character %s."
PLAYER_PROMPT_HEAD = "The following lines contain the mapping between player names and character names.\n"
PLAYER_PROMPT_TAIL = "\n\nUse this mapping when answering the questions below.\n\n"
EPISODE_START = "[START OF EPISODE]\n"
EPISODE_END = "\n[END OF EPISODE]"
