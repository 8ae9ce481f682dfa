"""Labels derived from a source's play type and written text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import let
from .reports import computed

# Source play types by category.
TYPE_CLASS = {
    "pass": ("Pass Reception", "Pass Incompletion", "Pass Completion", "Passing Touchdown", "Sack", "Interception",
             "Pass Interception", "Pass Interception Return", "Interception Return Touchdown", "Pass Incompletion Return"),
    "rush": ("Rush", "Rushing Touchdown"),
    "special": ("Kickoff", "Kickoff Return (Offense)", "Kickoff Return (Defense)", "Kickoff Return Touchdown",
                "Kickoff Team Fumble Recovery", "Kickoff Team Fumble Recovery Touchdown", "Punt", "Punt Return",
                "Punt Return Touchdown", "Punt Team Fumble Recovery", "Punt Team Fumble Recovery Touchdown", "Blocked Punt",
                "Blocked Punt Touchdown", "Blocked Punt Return Touchdown", "Field Goal Good", "Field Goal Missed",
                "Blocked Field Goal", "Blocked Field Goal Touchdown", "Missed Field Goal Return",
                "Missed Field Goal Return Touchdown", "Extra Point Good", "Extra Point Missed", "Two Point Pass",
                "Two Point Rush", "Two Point Conversion Good", "Two Point Conversion Missed", "Defensive 2pt Conversion"),
    "penalty": ("Penalty",),
    "admin": ("Timeout", "End Period", "End of Half", "End of Game", "End of Regulation", "Start of Period", "Coin Toss",
              "placeholder"),
    "text": ("Fumble", "Fumble Recovery (Own)", "Fumble Recovery (Opponent)", "Fumble Return Touchdown", "Safety",
             "Offensive 1pt Safety", "Uncategorized"),
}
# Verbs that name a call, kick parentheses, and the replaced-play marker.
VERBS = {
    "pass": r"(?i)pass(?:es|ed)?\\b|sack(?:ed)?\\b|incomplete|intercept",
    "rush": r"(?i)\\bruns?\\b|\\brush(?:ed|es)?\\b|\\bkneel(?:s|ed|ing)?\\b|\\bkeeper\\b|\\bscrambl(?:e|es|ed|ing)\\b",
    "special": r"(?i)kickoff|\\bpunt|field goal|\\bkicks?\\b|\\bfg\\b|extra point|onside",
}
KICK_PARENS = r"(?i)\\([^)]*\\bkick\\b[^)]*\\)"
ORIGINAL = r"(?i)\\bOriginal Play:"
NO_PLAY = r"(?i)\\bno play\\b|\\bnullified\\b"
KICK_TYPES = ("kickoff", "punt", "field_goal", "extra_point")
NO_DOWN = tuple(t for t in TYPE_CLASS["special"] if any(w in t for w in ("Kickoff", "Extra Point", "Two Point", "2pt")))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def current_text(text="play_text") -> str:
    """The report up to a replaced original play."""
    whole = f"coalesce({text}, '')"
    return f"if(contains(lower({whole}), 'original play:'), split({whole}, '{ORIGINAL}', 2)[0], {whole})"


def with_verb(df: DataFrame, text="play_text", name="verb") -> DataFrame:
    """The category whose verb is written first; null when none is."""
    clean = f"if(contains(lower({text}), 'kick'), regexp_replace({text}, '{KICK_PARENS}', ' '), {text})"
    at = {f"_at_{c}": f"nullif(regexp_instr(_clean, '{p}'), 0)" for c, p in VERBS.items()}
    df = computed(computed(df, {"_clean": clean}), at)
    first = "least(" + ", ".join(at) + ")"
    arms = " ".join(f"when _at_{c} = {first} then '{c}'" for c in VERBS)
    return df.withColumn(name, F.expr(f"case {arms} end")).drop("_clean", *at)


def classified(df: DataFrame, kind="play_type_raw", text="play_text") -> DataFrame:
    """Adds ``category`` and ``how``; the category ``drop`` means the row is no play.

    Verbs are only looked for where neither the words nor the type have decided."""
    tabled = ("pass", "rush", "special", "penalty")
    of = {c: f"coalesce({kind} in ({quoted(TYPE_CLASS[c])}), false)" for c in TYPE_CLASS}
    df = computed(df, {"_current": current_text(text)})
    df = computed(df, {"_voided": f"((contains(lower(_current), 'no play') or contains(lower(_current), 'nullified')) and _current rlike '{NO_PLAY}')"})
    df = computed(df, {"_open": f"if(_voided or {' or '.join(of[c] for c in (*tabled, 'admin'))}, null, _current)"})
    df = with_verb(df, "_open", "_verb")
    arms = " ".join(f"when {of[c]} then '{c}'" for c in tabled)
    category = f"case when _voided then 'penalty' {arms} when {of['admin']} then 'drop' else coalesce(_verb, 'drop') end"
    how = (f"case when _voided then 'explicit-no-play' when {' or '.join(of[c] for c in tabled)} then 'table' "
           f"when {of['admin']} then 'admin' else concat(if({of['text']}, '', 'unknown-type-'), "
           f"if(_verb is null, 'unresolved', 'text')) end")
    return computed(df, {"category": category, "how": how}).drop("_current", "_voided", "_open", "_verb")


def in_range(value, low: int, high: int) -> str:
    return f"case when try_cast({value} as int) between {low} and {high} then try_cast({value} as int) end"


def structured_clock(minutes="clock.minutes", seconds="clock.seconds") -> str:
    total = f"(coalesce({minutes}, 0) * 60 + coalesce({seconds}, 0))"
    return f"case when {minutes} is null and {seconds} is null then null when {total} between 0 and 900 then {total} end"


def text_clock(text="play_text") -> str:
    """The snap clock a report opens with; a later clock never counts."""
    part = lambda i: f"try_cast(nullif(regexp_extract({text}, '^\\\\s*\\\\((\\\\d{{1,2}}):(\\\\d{{2}})\\\\)', {i}), '') as int)"
    total = "(c.minutes * 60 + c.seconds)"
    return let("c", f"struct({part(1)} as minutes, {part(2)} as seconds)", f"case when c.seconds < 60 and {total} <= 900 then {total} end")


def source_flags(kind="play_type", two_point="two_point_attempt") -> dict[str, str]:
    """Category flags of the professional source's play types."""
    penalty = f"coalesce({kind} = 'no_play', false)"
    special = f"(not {penalty} and (coalesce({kind} in ({quoted(KICK_TYPES)}), false) or coalesce({two_point} = 1, false)))"
    live = f"(not {penalty} and not {special})"
    return {"is_pass": f"{live} and coalesce({kind} = 'pass', false)", "is_rush": f"{live} and coalesce({kind} = 'run', false)",
            "is_special": special, "is_penalty_only": penalty}


ADMIN_ROW = "play_type is null or (play_type = 'no_play' and play_type_nfl = 'TIMEOUT')"


def plain_id(value) -> str:
    """A float id as plain digits; unknown becomes the empty string."""
    return f"coalesce(cast(try_cast({value} as bigint) as string), '')"


def college_conversion(kind="play_type_raw", text="play_text") -> str:
    """Three-valued: an unclear outcome stays null."""
    t = current_text(text)
    return f"""case when {t} rlike '(?i)\\\\bpenalt|\\\\bfumbl' or {kind} like '%Fumble%' then null
        when {kind} like '%Interception%' or {t} rlike '(?i)\\\\bintercept' then false
        when {kind} in ('Passing Touchdown', 'Rushing Touchdown') then true
        when yards_gained is null or distance is null then null
        when {kind} in ('Pass Incompletion', 'Sack') then false
        when {kind} in ('Pass Reception', 'Pass Completion', 'Rush') then yards_gained >= distance end"""


def clear_yards(kind="play_type_raw", text="play_text") -> str:
    """Yardage, null where a penalty, fumble or interception clouds it."""
    return (f"case when {current_text(text)} rlike '(?i)\\\\bpenalt|\\\\bfumbl|\\\\bintercept' "
            f"or {kind} rlike 'Fumble|Interception' then null else yards_gained end")


def flag_conversion(offense="offense") -> str:
    """Conversion from source flags, known only on clean rows of the same team."""
    known = "first_down is not null and fumble_lost is not null and interception is not null and penalty = 0"
    return (f"case when {known} and posteam = {offense} then (first_down = 1 or coalesce(touchdown = 1 and td_team = posteam, false)) "
            f"and fumble_lost = 0 and interception = 0 end")


def final_label(category="category", text="play_text") -> str:
    """1 pass, 0 rush, null when the final record is no eligible call."""
    ok = (f"down between 1 and 4 and distance between 1 and 99 and yards_to_goal between 1 and 99 "
          f"and not {text} rlike '(?i)\\\\b(?:kneels|kneel down|takes a knee)\\\\b'")
    return f"case when not ({ok}) then null when {category} = 'pass' then 1 when {category} = 'rush' then 0 end"


NAME = r"[A-Z][A-Za-z\'.\\-]+(?: [A-Z][A-Za-z\'.\\-]+)"


def passer(text="play_text") -> str:
    """The name before pass/sacked at the start, else after ``pass from``."""
    first = f"regexp_extract({text}, '^({NAME}{{0,2}}?) (?:pass|sacked)\\\\b', 1)"
    later = f"regexp_extract({text}, '\\\\bpass from ({NAME}{{0,2}})\\\\b', 1)"
    return f"coalesce(nullif({first}, ''), nullif({later}, ''))"


# Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def norm_name(name) -> str:
    """Name for matching: plain lower-case words, ``and`` and ``state`` spelled out."""
    text = f"lower(translate(coalesce({name}, ''), '{ACCENTED}', '{PLAIN}'))"
    spelled = f"regexp_replace(replace({text}, '&', ' and '), '\\\\bst\\\\.?\\\\b', 'state')"
    return f"trim(regexp_replace({spelled}, '[^a-z0-9]+', ' '))"


# Abbreviations that differ between sources.
ALIASES = {"LAR": "LA", "WSH": "WAS", "JAC": "JAX"}


def alias(abbreviation) -> str:
    a = f"upper({abbreviation})"
    return f"case {a} " + " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items()) + f" else {a} end"
