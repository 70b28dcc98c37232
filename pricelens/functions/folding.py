"""Unicode folding as column expressions.

The tables are generated from Python's own Unicode data, once per process, instead of
being written out: one entry per code point whose folded form differs from itself.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

NON_ASCII = r"[^\x00-\x7F]"


# Characters below this point that fold to nothing are deleted by the translation itself, so that
# ordinary European text never reaches the slower checks.
COMMON_TEXT = 0x2100
# Tables with at most so many expanding characters are expanded by one replacement for each.
CHAINED = 200


@dataclass(frozen=True)
class CharTable:
    """Code points mapping to one character, those that vanish, and those that expand to several."""

    source: str
    target: str
    dropped: str
    expansions: tuple[tuple[str, str], ...]

    @property
    def expansion_class(self) -> str:
        """Regex class of the expanding characters, as few ranges as possible."""
        points = sorted(ord(c) for c, _ in self.expansions)
        ranges: list[list[int]] = []
        for point in points:
            if ranges and point == ranges[-1][1] + 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
        return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _build(rule: Callable[[str], str], keep_identity: bool) -> CharTable:
    source: list[str] = []
    target: list[str] = []
    dropped: list[str] = []
    expansions: list[tuple[str, str]] = []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = rule(char)
        if keep_identity and folded == char:
            continue
        if not folded:
            if point < COMMON_TEXT:
                dropped.append(char)
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions.append((char, folded))
    return CharTable("".join(source), "".join(target), "".join(dropped), tuple(expansions))


@lru_cache(maxsize=1)
def ascii_table() -> CharTable:
    """Case-fold, compatibility-decompose, keep the ASCII part; characters without one vanish."""

    def rule(char: str) -> str:
        return unicodedata.normalize("NFKD", char.casefold()).encode("ascii", "ignore").decode("ascii")

    return _build(rule, keep_identity=False)


@lru_cache(maxsize=1)
def casefold_table() -> CharTable:
    return _build(str.casefold, keep_identity=True)


@lru_cache(maxsize=1)
def compatibility_table() -> CharTable:
    """NFKC of single characters (precomposed input is the normal case for listing text)."""
    return _build(lambda char: unicodedata.normalize("NFKC", char), keep_identity=True)


def literal_map(mapping: dict[str, str]) -> Column:
    """A string map as one foldable expression, so large tables cost one literal in the plan."""
    text = "\x1e".join(f"{key}\x1f{value}" for key, value in mapping.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def _map_chars(text: Column, table: CharTable, lower_ascii: bool) -> Column:
    """Translate one-to-one entries; only rows that hold an expanding character take the split path.

    ASCII letters are lowered with the translation, before expansion: a capital that only
    appears through decomposition stays a capital.
    """
    source, target = table.source, table.target
    if lower_ascii:
        source, target = source + string.ascii_uppercase, target + string.ascii_lowercase
    plain = F.translate(text, source + table.dropped, target)
    if len(table.expansions) <= CHAINED:
        # no expansion holds an expanding character, so the order does not matter
        expanded = reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), table.expansions, plain)
    else:
        expansions = literal_map(dict(table.expansions))
        expanded = F.array_join(
            F.transform(F.split(plain, ""), lambda ch: F.coalesce(F.try_element_at(expansions, ch), ch)), ""
        )
    # the cheap test first: most text is ASCII once translated
    return F.when(plain.rlike(NON_ASCII) & plain.rlike(table.expansion_class), expanded).otherwise(plain)


def ascii_fold(text: Column) -> Column:
    """Case-folded ASCII rendering of ``text``; plain ASCII rows skip the table."""
    mapped = F.regexp_replace(_map_chars(text, ascii_table(), True), NON_ASCII, "")
    return F.when(text.rlike(NON_ASCII), mapped).otherwise(F.lower(text))


def casefold(text: Column) -> Column:
    return F.when(text.rlike(NON_ASCII), _map_chars(text, casefold_table(), True)).otherwise(F.lower(text))


def compatibility_compose(text: Column) -> Column:
    return F.when(text.rlike(NON_ASCII), _map_chars(text, compatibility_table(), False)).otherwise(text)
