"""Text formatting, screening and settings values."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a submitted text for review.
LISTED_WORDS = (
    "fuck", "shit", "ass", "bitch", "dick", "cock", "pussy", "cunt", "bastard",
    "asshole", "bullshit", "damn", "crap", "piss", "whore", "slut", "nigger",
    "faggot", "retard", "nazi", "hitler",
)


def pace_text(seconds: Column) -> Column:
    """Seconds as MM:SS; minutes wrap at the hour."""
    minutes = F.floor(seconds / 60) % 60
    return F.when(
        seconds.isNotNull(),
        F.concat(
            F.lpad(minutes.cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((seconds % 60).cast("string"), 2, "0"),
        ),
    )


def normalise_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_email(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("@")), F.lit(False))


# White space in the sense of the web form, which goes beyond \\s here.
SPACES = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# the characters outside letters, digits and ``SPACES``, for Python
KEPT_NOT = "[^a-z0-9\\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _spread(words: Sequence[str], gap: str) -> str:
    """A pattern for any of the words with ``gap`` between their characters; no word begins another."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(h) + (gap + _spread(rest, gap) if all(rest) else "") for h, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def contains_listed_word(
    *texts: Column, words: Sequence[str] = LISTED_WORDS, whole_word: bool = False
) -> Column:
    """True when any text holds a listed word after all but letters, digits and space go.

    The default matches inside longer words as well; ``whole_word`` does not. Each text is
    searched once, for all words together. Inside longer words the search skips what would go, so
    no second text is made.
    """
    if not words:
        return F.lit(False)
    # a word that holds another listed word can never be found without it
    shortest = [w for w in words if not any(o != w and o in w for o in words)]
    gone = f"[^a-z0-9{SPACES}]"
    if whole_word:
        pattern = rf"(^|[{SPACES}])({'|'.join(map(re.escape, words))})([{SPACES}]|$)"
    elif all(shortest):
        # a word with a character that goes is never found
        held = [w for w in shortest if not re.search(KEPT_NOT, w, re.ASCII)]
        if not held:
            return F.lit(False)
        first = "".join(sorted({re.escape(w[0]) for w in held}))
        pattern = f"(?=[{first}]){_spread(held, gone + '*+')}"
    else:
        pattern = ""

    def found(c: Column) -> Column:
        text = F.regexp_replace(F.lower(c), gone + "+", "") if whole_word else F.lower(c)
        return F.coalesce(text.rlike(pattern), F.lit(False))

    return reduce(lambda a, b: a | b, [found(c) for c in texts])


def setting_value(c: Column) -> Column:
    """Stored JSON text as a variant; text that is not JSON stays text."""
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))
