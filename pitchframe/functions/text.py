"""Text expressions with the Unicode rules of the CSV tools the data comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode plus the four ASCII separators 1C-1F.
SPACE = r"[\s\x1c-\x1f]"
STRIP = rf"(?U)^{SPACE}+|{SPACE}+\z"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, STRIP, "")


def casefold(c: Column | str) -> Column:
    """Case folding from upper and lower case: sharp s becomes ss, final sigma a plain one, dotless i stays."""
    c = F.col(c) if isinstance(c, str) else c
    kept = F.translate(c, "ı", "\ue000")
    # The inner translate also keeps Catalyst from reducing lower(upper(x)) to lower(x).
    return F.translate(F.lower(F.translate(F.upper(kept), "\ue000", "ı")), "ς", "σ")


def clean(c: Column | str) -> Column:
    """NULL becomes empty text, then strip."""
    c = F.col(c) if isinstance(c, str) else c
    return strip(F.coalesce(c, F.lit("")))


def split_aliases(c: Column | str) -> Column:
    """Parts between bars, stripped, empty ones left out; never NULL."""
    return F.filter(F.transform(F.split(clean(c), r"\|"), strip), lambda a: a != "")


def strip_zeros(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^0+", "")


def int_key(c: Column | str) -> Column:
    """Text of the whole number when every character is a digit, else NULL. Any length, so done on the text."""
    c = F.col(c) if isinstance(c, str) else c
    short = strip_zeros(c)
    return F.when(c.rlike(r"^[0-9]+\z"), F.when(short == "", F.lit("0")).otherwise(short))


def parse_list_text(c: Column | str) -> Column:
    """Text of a list of whole numbers, quoted names and None -> ARRAY<STRING>; NULL when it is no list."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.regexp_extract(c, r"(?s)^\s*\[(.*)\]\s*\z", 1)
    item = r"""('[^']*'|"[^"]*"|[^,\s][^,]*)"""
    parts = F.transform(F.regexp_extract_all(body, F.lit(item), 1), lambda p: F.trim(p))
    plain = F.transform(
        parts, lambda p: F.when(p != "None", F.regexp_replace(p, r"""^['"](.*)['"]\z""", "$1"))
    )
    return F.when(c.rlike(r"(?s)^\s*\[.*\]\s*\z"), plain)


def attack_stem(game: Column | str, attack: Column | str) -> Column:
    return F.format_string("attack_%d_%04d", game, attack)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, group)))


# The phrasings a question may use to name a team and a player.
TEAM_NAME = r"([^\n]+?)の([^\n]+?)選手"
NAME_ONLY = r"([^\s\x1c-\x1f]+?)選手"


def asked_team(question: Column | str) -> Column:
    return _found(strip(question), TEAM_NAME, 1)


def asked_name(question: Column | str) -> Column:
    q = strip(question)
    return F.coalesce(_found(q, TEAM_NAME, 2), _found(q, "(?U)" + NAME_ONLY, 1))


# Wording of the request put before a question.
NAME_LABEL = "選手名: "
TEAM_LABEL = "チーム: "
REQUEST = "この選手のプレースタイルや特徴、強み、代表的なプレー例を簡潔に説明してください。"
QUESTION_LABEL = "質問: "


def prompt_text(question: Column | str) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    name, team = F.nullif(asked_name(q), F.lit("")), F.nullif(asked_team(q), F.lit(""))
    context = F.concat_ws("、", F.concat(F.lit(NAME_LABEL), name), F.concat(F.lit(TEAM_LABEL), team))
    return F.concat_ws("\n", F.nullif(context, F.lit("")), F.lit(REQUEST), F.concat(F.lit(QUESTION_LABEL), q))
