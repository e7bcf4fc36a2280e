"""Feature expressions. Each gives ``array<string>``: the features present in one channel."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.binding import bind
from palaver.functions.literals import mandatory_literal

PADDING = "<>"  # fixed value: stands for the token before the first and after the last


def ngrams(head: Column, tokens: Column, n: int) -> Column:
    """``head_tok_tok…`` for each distinct n-gram, padded by ``n - 1`` on both sides."""
    pad = F.array(*[F.lit(PADDING)] * (n - 1))

    def singles(start: Column) -> Column:
        return F.transform(F.array_distinct(tokens), lambda t: F.concat(start, t))

    def windows(start: Column) -> Column:
        def grams(padded: Column) -> Column:
            def gram(i: Column) -> Column:
                rest = [x for k in range(1, n) for x in (F.lit("_"), F.get(padded, i + k))]
                return F.concat(start, F.get(padded, i), *rest)

            return F.transform(F.sequence(F.lit(0), F.size(padded) - n), gram)

        return F.array_distinct(bind(F.concat(pad, tokens, pad), grams))

    return bind(F.concat(head, F.lit("_")), singles if n == 1 else windows)


@dataclass(frozen=True)
class Pattern:
    """One dictionary pattern; ``groups`` is the number of capture groups in ``regex``."""

    name: str
    regex: str
    binary: bool = True
    expand: bool = False

    @property
    def groups(self) -> int:
        """Groups as Java, which runs the pattern, counts them."""
        if "(?P<" in self.regex:
            raise ValueError(f"a named group is written (?<name>…) here: {self.regex}")
        # Quoted stretches, escapes and classes (with one class inside) hold no groups.
        plain = re.sub(r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\\.|\[[^\]]*\]|[^\]\\])*\]", "", self.regex, flags=re.S)
        return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def may_match(text: Column, pattern: Pattern) -> Column | None:
    """Whether the text contains what every match contains; None if there is no such literal."""
    literal = mandatory_literal(pattern.regex)
    return None if literal is None else text.contains(literal)


def _occurs(text: Column, pattern: Pattern) -> Column:
    possible = may_match(text, pattern)
    return text.rlike(pattern.regex) if possible is None else possible & text.rlike(pattern.regex)


def pattern_presence(
    channel: Column, text: Column, patterns: list[Pattern], prefix: str = ""
) -> Column:
    """``name_channel`` for each binary pattern found anywhere in the text."""
    hits = [
        F.when(_occurs(text, p), F.concat(F.lit(f"{prefix}{p.name}_"), channel))
        for p in patterns
        if p.binary
    ]
    if not hits:
        return F.array().cast("array<string>")
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def pattern_matches(
    channel: Column, text: Column, patterns: list[Pattern], prefix: str = ""
) -> Column:
    """``name_channel_group…``, once per distinct match of each expanded pattern."""
    found = [_expanded(channel, text, p, prefix) for p in patterns if p.expand]
    if not found:
        return F.array().cast("array<string>")
    return F.array_distinct(F.concat(*found))


def _expanded(channel: Column, text: Column, pattern: Pattern, prefix: str) -> Column:
    head = F.concat(F.lit(f"{prefix}{pattern.name}_"), channel)
    none = F.array().cast("array<string>")
    if pattern.groups == 0:
        return F.when(_occurs(text, pattern), F.array(head)).otherwise(none)
    names = [f"g{g}" for g in range(1, pattern.groups + 1)]
    groups = [
        F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(g)).alias(name)
        for g, name in enumerate(names, 1)
    ]
    found = F.transform(
        F.arrays_zip(*groups), lambda m: F.concat_ws("_", head, *[m[name] for name in names])
    )
    possible = may_match(text, pattern)
    return found if possible is None else F.when(~possible, none).otherwise(found)


def bucket(key: Column, bits: int = 15, method: str = "md5") -> Column:
    """Feature key to bucket ``1 … 2^bits``.

    ``md5`` can be recomputed by any SQL engine; ``xxhash64`` is Spark's own and faster.
    """
    mask = (1 << bits) - 1
    digits = min(8, -(-bits // 4))  # only these hold a bit of the mask
    if method == "xxhash64":
        code = F.xxhash64(key)
    elif method == "md5":
        code = F.conv(F.substring(F.md5(key), 9 - digits, digits), 16, 10).cast("bigint")
    else:
        raise ValueError(f"unknown hash method: {method}")
    return (code.bitwiseAND(F.lit(mask).cast("bigint")) + 1).cast("int")
