"""Postal addresses as parts, by one grammar, and keys made of the parts.

An address is read once, from the largest unit to the smallest: each part of
``GRAMMAR`` may be missing. Numbers are whole numbers whatever their script, so
"二段", "２段" and "2段" are one section. A list of plates stands for its first;
a sub-plate may follow the plate's number or its unit. What the grammar does not
know stays as the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.parsing import nfkc
from talweg.functions.text import once

# Numerals, and variants of characters.
NUMERALS = "一二三四五六七八九十"
VARIANTS, STANDARD = "臺巿", "台市"

_ONES = f"[{NUMERALS[:-1]}]"
_N = f"[0-9]+|{_ONES}?十{_ONES}?|{_ONES}"
_SUB = f"(?:[之-]({_N}))?"
#: (part, its expression); a part is its expression's one group, or with several groups the first that matched.
GRAMMAR = [
    ("city", "([^0-9]{2}[市縣])?"),
    ("town", "([^0-9路街]{1,3}?[區鄉鎮])?"),
    ("village", "([^0-9路街號]{1,4}?[里村])?"),
    ("neighbourhood", "(?:([0-9]+)鄰)?"),
    ("street", f"([^0-9]*?(?:路|街|大道)|[^0-9{NUMERALS}]+)?"),
    ("section", f"(?:({_N})段)?"),
    ("lane", "(?:([0-9]+)巷)?"),
    ("alley", "(?:([0-9]+)弄)?"),
    ("plate", f"(?:({_N}){_SUB}(?:[、,.及和][0-9之、,.及和-]*)?號{_SUB})?"),
    ("floor", f"(?:(地下|b)?({_N})[樓層f]{_SUB})?"),
    ("rest", "(.*)"),
]
PATTERN = "^" + "".join(x for _, x in GRAMMAR) + "$"
#: Place of each field's groups in the pattern.
GROUPS = {"city": [1], "town": [2], "village": [3], "neighbourhood": [4], "street": [5], "section": [6], "lane": [7], "alley": [8], "plate": [9], "sub": [10, 11], "cellar": [12], "floor": [13], "unit": [14], "rest": [15]}
#: Groups of the pattern, and what they are parted by.
COUNT, MARK = 15, "\x01"
NUMBERS = ["neighbourhood", "section", "lane", "alley", "plate", "sub", "floor", "unit"]


def number(c: Column) -> Column:
    """A whole number in digits or, up to ninety-nine, in numerals; null where it is neither."""
    value = lambda x: F.instr(F.lit(NUMERALS), x)
    tens = F.regexp_extract(c, f"^({_ONES}?)十", 1)
    ones = F.regexp_extract(c, f"({_ONES})$", 1)
    han = F.when(F.contains(c, F.lit("十")), F.when(tens == "", 10).otherwise(value(tens) * 10)).otherwise(0) + F.when(ones == "", 0).otherwise(value(ones))
    return F.coalesce(c.try_cast("long"), F.when(c.rlike(f"^(?:{_N})$"), han.cast("long")))


def cleaned(c: Column) -> Column:
    """One form of characters, no remarks in brackets, no blanks."""
    plain = F.lower(F.translate(nfkc(c), VARIANTS, STANDARD))
    return F.regexp_replace(F.regexp_replace(plain, r"[–—−]", "-"), r"\([^()]*\)|\s+", "")


def parts(c: Column) -> Column:
    """The address as a struct of ``GROUPS``: texts, and whole numbers for ``NUMBERS``; a missing part is null."""
    def fields(text: Column, groups: Column) -> Column:
        def field(name: str) -> Column:
            # A text that the mark stands in, or that the pattern doesn't match, is read group by group.
            found = F.coalesce(*(F.nullif(F.when(F.size(groups) == COUNT, F.get(groups, g - 1)).otherwise(F.regexp_extract(text, PATTERN, g)), F.lit("")) for g in GROUPS[name]))
            return once(found, number) if name in NUMBERS else found

        return F.struct(*(field(name).alias(name) for name in GROUPS))

    # One match for all groups, each expression once.
    split = lambda text: F.split(F.regexp_replace(text, PATTERN, MARK.join(f"${g}" for g in range(1, COUNT + 1))), MARK)
    return once(cleaned(c), lambda text: once(split(text), lambda groups: fields(text, groups)))


def key(p: Column, *names: str) -> Column:
    """The named parts as one text; null if there are none."""
    one = F.concat_ws("|", *(F.coalesce(p[n].cast("string"), F.lit("")) for n in names))
    return F.when(F.replace(one, F.lit("|"), F.lit("")) != "", one)


PLACE = ["street", "section", "lane", "alley", "plate"]


def tiers(p: Column) -> Column:
    """Keys of the parts as array<struct<tier, key>>, the most literal first: with the town, without it, without the floor, without the sub-plate.

    Towns and what lies above don't tell two places apart where streets do, so they go
    first. An address without a plate has the first two only. A key that a stricter tier has already isn't repeated. ``p`` is best a column of its own.
    """
    floor = ["cellar", "floor", "unit", "rest"]
    named = F.when(p["town"].isNotNull(), key(p, "town", *PLACE, "sub", *floor))
    plate = p["plate"].isNotNull()
    keys = [named, key(p, *PLACE, "sub", *floor), F.when(plate, F.concat(key(p, *PLACE, "sub"), F.lit("||||"))), F.when(plate, F.concat(key(p, *PLACE), F.lit("|||||")))]
    rows = []
    for i, k in enumerate(keys):
        new = k.isNotNull()
        for stricter in keys[:i]:
            new = new & ~k.eqNullSafe(stricter)
        rows.append(F.when(new, F.struct(F.lit(i).alias("tier"), k.alias("key"))))
    return F.array_compact(F.array(*rows))
