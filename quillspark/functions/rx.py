"""Regular expressions and numbers with the semantics that receipt rules are written in.

Word characters are ASCII, case folding is Unicode's, `$` without the multi-line flag is the very end, white space
includes no-break spaces, a missing match is null, and halves round up.  Only this module knows how
Java differs from that."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_SPACE = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def rx(pattern: str, flags: str = "i") -> str:
    """A pattern for Spark; flags: i (ignore case), m (^ and $ at lines)."""
    # beside a letter or digit of the pattern itself one look is enough, behind that letter where it can be, as most places of a text fail there
    out = re.sub(r"\\b([A-Za-z0-9])(?![*+?{])", r"\1(?<!\\w\1)", pattern)
    out = re.sub(r"\\b(?=[A-Za-z0-9])", r"(?<!\\w)", out)
    out = re.sub(r"(?<=[^\\][A-Za-z0-9])\\b", r"(?!\\w)", out).replace(r"\b", _EDGE)
    if "m" not in flags and out.endswith("$"):
        out = out[:-1] + r"\z"
    return ("(?iu)" if "i" in flags else "") + ("(?m)" if "m" in flags else "") + out


def low_rx(pattern: str) -> str:
    """A pattern for a flat text: used without the flag i, as no letter has to be compared in two cases, which costs far less."""
    return re.sub(r"\\.|[A-ZÁÉÍÓÚÑ]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at each place of a text once: words with the same beginning share it, and a look at two
    letters by class, for all words and for those of some letters, comes before one at each letter."""
    by_first = _by_first(words)
    letters = sorted(by_first)
    one_of = lambda chars: "[" + "".join(map(re.escape, sorted(set(chars)))) + "]"
    second = lambda part: one_of(w[1] for w in words if w[0] in part) if all(len(w) > 1 for w in words if w[0] in part) else ""
    ahead = lambda part: f"(?={one_of(part)}{second(part)})"
    one = lambda part: f"{ahead(part)}(?:{'|'.join(by_first[c] for c in part)})"
    parts = [letters[i : i + 4] for i in range(0, len(letters), 4)]
    return one(letters) if len(parts) == 1 else f"{ahead(letters)}(?:{'|'.join(map(one, parts))})"


def _by_first(words: list[str]) -> dict[str, str]:
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[0], []).append(w[1:])
    return {c: re.escape(c) + ("" if "" in rest else _shared(rest)) for c, rest in ends.items()}


def _shared(words: list[str]) -> str:
    grown = list(_by_first(words).values())
    return grown[0] if len(grown) == 1 else "(?:" + "|".join(grown) + ")"


def spaced(text: Column) -> Column:
    """White space other than ASCII's as plain spaces, for matching."""
    plain = F.octet_length(text) == F.length(text)  # ASCII only
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"[\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " "))


def first(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """The group of the first match, null if there is none or it is empty.

    An array of one, as nullif holds its argument twice: within a lambda both are computed."""
    return F.get(F.array_remove(F.array(F.regexp_extract(text, rx(pattern, flags), group)), ""), 0)


def groups(text: Column, pattern: str, n: int, flags: str = "i") -> Column:
    """All n groups of a line that the pattern matches from its start to its end, as an array; null otherwise.

    One match for all groups; a line holds no line feed, which separates them here."""
    parts = F.split(F.regexp_replace(text, rx(pattern, flags), "\n".join(f"${g}" for g in range(1, n + 1))), "\n", -1)
    return F.get(F.filter(F.array(parts), lambda p: F.size(p) == n), 0)


def every(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def has(text: Column, pattern: str, flags: str = "i") -> Column:
    return text.rlike(rx(pattern, flags))


def one_case(text: Column) -> Column:
    """The text in one case, as matching without case sees it: what a pattern's letters match holds these letters here."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.upper(F.replace(text, F.lit("İ"), F.lit("i")))))


def flat(text: Column) -> Column:
    """The text in one case, character for character, for patterns by low_rx without the flag i: they find what the same pattern without case
    finds in the text.  Letters outside ASCII are no ASCII letters in another case: İ and the Kelvin sign, whose small letters would be, and characters
    of two units, so that positions are the text's, are a sign that no pattern names."""
    one = F.regexp_replace(F.lower(F.translate(text, "İ\u212a", "\ufffd\ufffd")), r"[\x{10000}-\x{10FFFF}]", "\ufffd")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(one)


def place(low: Column, pattern: str) -> Column:
    """Where the first match in a flat text begins, from 1; 0 if there is none."""
    return F.regexp_instr(low, F.lit(rx(pattern, "")))


def line_start(text: Column, at: Column) -> Column:
    """Where the line begins that holds a place."""
    return at - F.length(F.substring_index(F.substring(text, F.lit(1), at - 1), "\n", -1))


def unix(text: Column) -> Column:
    """Carriage returns before line feeds left out, as `lines` does."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def folded(text: Column) -> Column:
    """The text in one case with each run of white space as one space: what a pattern's `\\s+` between words matches is a space here."""
    return F.regexp_replace(one_case(text), r"[^\S ]\s*| \s+", " ")  # runs other than a single space


def holds(low: Column, words: str) -> Column:
    """Whether a folded text holds one of the words (between bars): a cheap look before a pattern that needs one.  Many are sought by one pattern."""
    every = words.split("|")
    if len(every) > 4:
        return low.rlike(any_of(every))
    out = F.lit(False)
    for word in every:
        out = out | F.contains(low, F.lit(word))
    return out


def cut(text: Column, pattern: str, by: str = "", flags: str = "i") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), by)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def lines(text: Column) -> Column:
    return F.split(unix(text), "\n", -1)  # a single mark is split without a pattern


def full_lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(lines(text), trim), lambda x: x != "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def with_folded(text: Column, low: Column | None, use) -> Column:
    """use(low), where low is the folded text; computed here, once, unless the caller has it."""
    return let(folded(text), use) if low is None else use(low)


def first_found(items: Column, use, kind: str = "string") -> Column:
    """use(x) of the first element for which it isn't null; elements behind it are not looked at."""
    return F.aggregate(items, F.lit(None).cast(kind), lambda got, x: F.coalesce(got, use(x)))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def prefix_number(text: Column) -> Column:
    """The longest number that the text starts with, as a double."""
    return F.nullif(F.regexp_extract(text, r"^\d*\.?\d*", 0), F.lit("")).try_cast("double")
