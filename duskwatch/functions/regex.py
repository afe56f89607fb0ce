"""Regular expressions with the Unicode rules security-log patterns are written for."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that count as white space, as ``str.strip`` sees them.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` for the JVM: Unicode classes, ``.`` stops only at a line feed.

    The JVM's white-space class lacks the four separators U+001C to U+001F.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\s":
                pair = r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]"
            elif pair == r"\S" and not in_class:
                pair = r"[^\s\x1c-\x1f]"
            out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iUd)" if ignore_case else "(?Ud)") + "".join(out)


def any_of(patterns: list[str], starts: str | None = None) -> str:
    """One case-insensitive alternation over ``patterns``.

    ``starts`` is a class of all characters that a match can begin with: no pattern is
    tried where another stands.
    """
    some = "|".join(f"(?:{p})" for p in patterns)
    return java_regex(f"(?={starts})(?:{some})" if starts else some, ignore_case=True)


def first_group(text: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """The group of the first match; null when nothing matched or it is empty."""
    return F.nullif(
        F.regexp_extract(text, java_regex(pattern, ignore_case), group), F.lit("")
    )


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))
