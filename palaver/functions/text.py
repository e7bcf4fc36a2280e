"""Text expressions: diff segments, channels, tokens, de-shouting, snippets, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.binding import bind

# Token boundaries, the punctuation cut from a token end, the run length above
# which capitals count as shouting, diff markup, link formats.
TOKEN_BOUNDARY = r"[ {}\n()'>]"
TRAILING_PUNCTUATION = tuple("""?!.,;:-"'""")
SHOUT_LENGTH = 50
ADDED_CELL = '(?s)<td class="diff-addedline">(.*?)</td>'
REMOVED_CELL = '(?s)<td class="diff-deletedline">(.*?)</td>'
CHANGED_SPAN = '(?s)<span class="diffchange">(.*?)</span>'
WIKI_BASE = "http://en.wikipedia.org"
SHORT_BASE = "http://enwp.org"

# Letters that upper-casing changes: lower-case ones but for those without a one-letter
# upper form. Both classes are written so that Java and RE2 read them alike.
CHANGES_WHEN_UPPERED = r"[^\P{Ll}ßŉĸǰ]"
SAME_WHEN_UPPERED = r"[\P{Ll}ßŉĸǰ]"

CHANNELS = ("added", "removed", "comment")


def diff_segments(diff: Column, cell: str = ADDED_CELL, span: str = CHANGED_SPAN) -> Column:
    """Per cell its changed spans, or the whole cell when it has none, as one array."""
    return F.flatten(
        F.transform(
            F.regexp_extract_all(diff, F.lit(cell), F.lit(1)),
            lambda c: F.when(
                c.rlike(span), F.regexp_extract_all(c, F.lit(span), F.lit(1))
            ).otherwise(F.array(c)),
        )
    )


def diff_content(diff: Column) -> Column:
    """Added and removed segments of a revision diff."""
    return F.struct(
        diff_segments(diff, ADDED_CELL).alias("added"),
        diff_segments(diff, REMOVED_CELL).alias("removed"),
    )


def spaced(text: Column) -> Column:
    """One space between any two characters."""
    return F.regexp_replace(text, r"(?s)(.)(?=.)", "$1 ")


def text_channels(
    added: Column, removed: Column, comment: Column, spaced_comment: bool = False
) -> Column:
    """``array<struct<channel, text>>``; a channel that is absent (NULL) is left out."""
    note = spaced(comment) if spaced_comment else comment
    texts = (F.array_join(added, " "), F.array_join(removed, " "), note)
    return F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("channel"), text.alias("text"))
                for name, text in zip(CHANNELS, texts)
            ]
        ),
        lambda c: c["text"].isNotNull(),
    )


def deshout(text: Column, longer_than: int = SHOUT_LENGTH) -> Column:
    """Lower-case the longest run that upper-casing leaves alone, when it is long enough.

    Of runs of equal length the last is taken. The leading test keeps ordinary text, nearly
    all of it, off the slow path.
    """

    def fold(runs: Column) -> Column:
        lengths = F.transform(
            runs,
            lambda r: F.when(r.rlike("^" + SAME_WHEN_UPPERED), F.length(r)).otherwise(F.lit(0)),
        )
        return bind(lengths, lambda ls: bind(last_longest(ls), lambda at: lowered(runs, at)))

    def last_longest(ls: Column) -> Column:
        return F.size(ls) - F.array_position(F.reverse(ls), F.array_max(ls)).cast("int")

    def lowered(runs: Column, at: Column) -> Column:
        return F.array_join(
            F.transform(runs, lambda r, i: F.when(i == at, F.lower(r)).otherwise(r)), ""
        )

    runs = F.regexp_extract_all(
        text, F.lit(f"{CHANGES_WHEN_UPPERED}+|{SAME_WHEN_UPPERED}+"), F.lit(0)
    )
    shouting = text.rlike(f"{SAME_WHEN_UPPERED}{{{longer_than + 1}}}")
    return F.when(shouting, bind(runs, fold)).otherwise(text)


def tokenize(text: Column) -> Column:
    """Tokens between boundary characters, empty ones kept."""
    return F.split(text, TOKEN_BOUNDARY, -1)


def lexicon_tokens(tokens: Column) -> Column:
    """Non-empty tokens of a de-shouted text, less one trailing punctuation character."""
    return F.transform(
        F.filter(tokens, lambda t: t != ""),
        lambda t: F.when(
            F.substring(t, -1, 1).isin(*TRAILING_PUNCTUATION), F.substring(t, F.lit(1), F.length(t) - 1)
        ).otherwise(t),
    )


def compose_message(subject: Column, body: Column) -> Column:
    return F.concat_ws("\n", subject, body)


def snippet(added: Column, length: int = 50) -> Column:
    """The first characters of the added text in quotes, ``(empty)`` without content."""
    head = F.substring(F.array_join(added, " "), 1, length)
    return F.coalesce(F.concat(F.lit('"'), head, F.lit('"')), F.lit("(empty)"))


def revision_link(rev_id: Column, base: str = WIKI_BASE) -> Column:
    return F.concat(F.lit(f"{base}/w/index.php?diff=prev&oldid="), rev_id.cast("string"))


def short_revision_link(rev_id: Column, base: str = SHORT_BASE) -> Column:
    """Names the revision ``None`` when there is none, as prediction rows do."""
    return F.concat(
        F.lit(f"{base}/?diff=prev&oldid="), F.coalesce(rev_id.cast("string"), F.lit("None"))
    )


def user_link(name: Column, base: str = WIKI_BASE) -> Column:
    return F.concat(F.lit(f"{base}/wiki/User:"), name)


def contributions_link(name: Column, offset: Column, base: str = WIKI_BASE) -> Column:
    return F.concat(
        F.lit(f"{base}/wiki/Special:Contributions/"),
        name,
        F.lit("?offset="),
        offset,
        F.lit("&dir=prev"),
    )
