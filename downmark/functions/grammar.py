"""A small grammar of play reports: one pass cuts a text into tokens, rules are patterns over them.

A token is a jersey number (``#12``), a clock, a number, a name with its initials
(``R.Back``), a word or a punctuation mark.  ``told`` writes the tokens of a text behind one
another with a blank round each, so a rule is a pattern whose first match is its clause; what
does not fit the clause gives null or ''.  Rules are SQL expressions over that
string bound by ``let``, so the text is cut once a rule and no rule walks over places.
"""

from __future__ import annotations

# The words the reports use.
RUN_VERBS = ("rush", "run", "scramble", "scrambles", "scrambled", "scrambling")
PASS_RESULTS = ("complete", "incomplete", "intercepted")
DEPTHS = ("short", "deep")
SIDES = ("left", "middle", "right")
LINE_PLACES = ("end", "tackle", "guard")
UNITS = ("yard", "yards", "yd", "yds")
AFTER_RECEIVER = ("caught", "thrown", "for", "to", "pushed", "ran")
FORMATIONS = ("shotgun", "no", "huddle", "huddle-shotgun")
REFUSED = ("declined", "offset", "offsetting")

#: Small words inside a name, and capitals that never are one.
PARTICLES = ("de", "la", "da", "del", "di", "van", "von", "der", "st")
NO_NAMES = (*RUN_VERBS, *PASS_RESULTS, *DEPTHS, *SIDES, *FORMATIONS, "pass", "sacked", "penalty", "touchdown", "fumble", "fumbled", "safety", "turnover", "qb", "original", "play", "timeout", "punt", "kickoff")

_LETTER = "A-Za-z\\u00C0-\\u024F"
TOKEN = ("#\\d+|\\d+:\\d\\d|\\d+[A-Za-z]+|-?\\d+|(?:[A-Z][A-Za-z]{0,2}\\.)+[A-Z][" + _LETTER + "'\\u2019-]*|(?:Jr|Sr|[A-Z])\\.|"
         "[" + _LETTER + "][" + _LETTER + "0-9'\\u2019-]*|[.,;:()\\[\\]]")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {q(TOKEN)}, 0)"


def told(text: str) -> str:
    """The tokens of a text in one string, a blank before, between and behind them."""
    return f"concat(' ', array_join({tokens(text)}, ' '), ' ')"


def one_of(words) -> str:
    """A pattern of one token, in letters of any case."""
    return "(?i:" + "|".join(words) + ") "


def read(text: str, pattern: str, group: int = 1) -> str:
    """What a group of the first match holds, null if there is none."""
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


#: A token that an int holds, one after which a name ends, and one that can be part of a name.
NUMBER = ("-?0*(?:\\d{1,9}|1\\d{9}|20\\d{8}|21[0-3]\\d{7}|214[0-6]\\d{6}|2147[0-3]\\d{5}|21474[0-7]\\d{4}|214748[0-2]\\d{3}|2147483[0-5]\\d{2}|"
          "21474836[0-3]\\d|214748364[0-7])|-0*2147483648")
UNIT = one_of(UNITS)
NAME = f"(?!{one_of(NO_NAMES)})(?:[#\\p{{Lu}}\\p{{Lt}}]\\S* |{one_of(PARTICLES)})"


def number(text: str) -> str:
    return f"try_cast({text} as int)"


def yards(clause: str) -> str:
    """Gain or loss in the words before any ruling: a stated loss, else the first amount, else no gain."""
    loss = number(read("t", f" for (?:a )?loss of ({NUMBER}) {UNIT}"))
    amount = f" for ({NUMBER}) {UNIT}(loss )?"
    body = (f"case when p.loss is not null then -p.loss when p.amount is not null then p.amount * if({read('t', amount, 2)} is not null, -1, 1) "
            f"when contains(t, ' no gain ') then 0 end")
    said = let("t", f"lower({told('c')})", let("p", f"struct({loss} as loss, {number(read('t', amount))} as amount)", body))
    return let("c", clause, f"if(contains(lower(c), 'for') or contains(lower(c), 'gain'), {said}, null)")


def ruling(clause: str, named: bool = True) -> str:
    """struct(name, yards, refused) of the words after PENALTY: the team, the name, its yards and from where; the name only if ``named``."""
    word, stop = r"\S+ ", f"(?:[(\\[] |(?:{NUMBER}) {UNIT})"
    name = f"coalesce(rtrim(regexp_extract(t, {q(f'^ {word}((?:(?!{stop}){word})+){stop}')}, 1)), '')"
    spot = number(read("t", f"^ {word}(?:{word})*?({NUMBER}) {UNIT}(?i:from) "))
    return let("t", told(clause), f"struct({f'{name} as name, ' if named else ''}{spot} as yards, t rlike {q(' ' + one_of(REFUSED))} as refused)")


def hurry(text: str) -> str:
    """The one who hurried the passer: a jersey number and one or two names, before a mark, a number, a ruling or the end."""
    closes = r"(?=$|[,;(\[.] |#|(?i:penalty) |(?i:original) (?i:play) )"
    whole = f"^(?>.*? (?i:qb) (?i:hurried) (?i:by) )((?:#\\S* )?+{NAME}(?:(?!#){NAME})?+){closes}"
    return f"if(contains(lower({text}), 'hurried'), rtrim(regexp_extract({told(text)}, {q(whole)}, 1)), '')"


def seen(clause: str) -> str:
    """Formation, depth and direction as short sentences, in that order."""
    side = "|".join(SIDES)
    thrown = f" pass (?:{'|'.join(PASS_RESULTS[:2])}) ({'|'.join(DEPTHS)}) (?:({side}) )?"
    found = f"struct({read('t', thrown)} as depth, {read('t', thrown, 2)} as to, {read('t', f' rush ({side}) ')} as run)"
    over = "if(p.to = 'middle', ' over the middle', concat(' to the ', p.to))"
    through = "if(p.run = 'middle', 'Run through the middle', concat('Run to the ', p.run))"
    body = (f"array_compact(array(if(contains(t, ' shotgun ') or contains(t, ' huddle-shotgun '), 'Shotgun', null), if(t rlike ' no huddle(?:-shotgun)? ', 'No huddle', null), "
            f"case when p.depth is not null then concat(initcap(p.depth), ' pass', if(p.to is null, '', {over})) when p.run is not null then {through} end))")
    return let("t", f"lower({told(clause)})", let("p", found, body))


def players(clause: str, run_type: str) -> str:
    """struct(actor, receiver): who begins the sentence before its verb, and to whom a pass went.

    A lead of clock and formation, and a sentence that someone is eligible, come before
    the actor.  On a run type the place on the line may stand for the verb.
    """
    eligible = r"(?:.*? (?i:reported) (?i:in) (?i:as) (?i:eligible) (?:\. )?)?+"
    lead = f"(?:(?:[(),]|\\S*:\\S*) |{one_of(FORMATIONS)})*+"
    begin = f"^{eligible} ?{lead}"
    verb = f"(?:{one_of((*RUN_VERBS, 'sacked'))}|(?i:pass) {one_of((*PASS_RESULTS, *DEPTHS))})"
    line = f"(?:{one_of(('left', 'right'))}{one_of(LINE_PLACES)}|(?i:up) (?i:the) (?i:middle) )"
    word = "\\S+ "
    throw = f"(?:(?!(?i:pass) ){word})*+(?i:pass) (?:{one_of(PASS_RESULTS[:2])})?(?:{one_of(DEPTHS)})?(?:{one_of(SIDES)})?(?i:to) "
    stop = f"(?:{one_of((*AFTER_RECEIVER, *NO_NAMES))}|[,(\\[.] )"
    actor = f"coalesce({read('t', f'{begin}((?:{NAME})++){verb}')}, if({run_type}, {read('t', f'{begin}(?!{line})((?:{NAME})+?){line}')}, null))"
    receiver = read("t", f"{begin}{throw}((?:(?!{stop}){NAME})++)(?={stop}|$)")
    return let("t", told(clause), f"struct(rtrim({actor}) as actor, rtrim({receiver}) as receiver)")
