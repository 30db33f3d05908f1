"""Text to sentences: native expressions over one filing, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from tellsift.functions.words import LANGUAGE_WORDS

# Every pattern here keeps to what both Java and RE2 understand.
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JUNK = rf"(?:{SPACE}|\\99)+"
CUT = "\x1e"
LIST_ITEM = r"([;:]) ((?:and |or )?)(\((?:[A-Za-z0-9]{1,3}|[ivxIVX]+)\))"
BRACKETS = r"\([^()]*\)|[^()]+|[()]"
SENTENCE_END = r"([.!?][\"”’]*) ([\"“‘]?\p{Lu})"
ABBREVIATION = r"\b(Mr|Mrs|Ms|Dr|Corp|Co|Ltd|No|Nos|v|vs|a\.m|p\.m|U\.S|Form|Case|File)\.\x1e"
WORD = r"\p{L}+"


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    """True if the text holds one of ``parts``; tested byte by byte, so that costly patterns can be spared."""
    return reduce(lambda a, b: a | b, [text.contains(part) for part in parts])


def normalise(text: Column, drop_controls: bool = False) -> Column:
    """Newlines, a literal backslash-99 and runs of white space become one space; ends trimmed."""
    if drop_controls:
        text = F.regexp_replace(text, r"[\x{80}-\x{9f}]", " ")
    return F.trim(F.regexp_replace(text, JUNK, " "))


def segment(clean: Column) -> Column:
    """Sentences of normalised text, as an array in order.

    A list item after ``;`` or ``:`` opens a sentence; closed brackets never hold a boundary; a
    full stop after a known abbreviation is none.
    """
    def listed(text: Column) -> Column:
        return F.when(
            holds_any(text, ["; ", ": "]), F.regexp_replace(text, LIST_ITEM, f"$1 $2{CUT}$3")
        ).otherwise(text)

    pieces = F.regexp_extract_all(let(clean, listed), F.lit(BRACKETS), F.lit(0))

    def cut_piece(piece: Column) -> Column:
        marked = F.regexp_replace(piece, SENTENCE_END, f"$1{CUT}$2")
        joined = let(
            marked,
            lambda m: F.when(m.contains(f".{CUT}"), F.regexp_replace(m, ABBREVIATION, "$1. ")).otherwise(m),
        )
        return F.when(piece.startswith("(") | ~holds_any(piece, ".!?"), piece).otherwise(joined)

    joined = F.array_join(F.transform(pieces, cut_piece), "")
    trimmed = F.transform(F.split(joined, CUT), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != "")


def split_lines(text: Column) -> Column:
    """Sentences of text that is already cut: one per line, not normalised."""
    return F.split(text, "\n")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that ``body`` may use it many times."""
    return F.transform(F.array(value), body)[0]


def language(text: Column, profile: dict[str, list[str]] = LANGUAGE_WORDS) -> Column:
    """Language whose function words occur most often; ties go by name, no hit gives null."""
    names = sorted(profile)

    def hits(words: Column, name: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(profile[name]))).alias(name)

    def choose(counts: Column) -> Column:
        best = F.greatest(*[counts[name] for name in names])
        choice = reduce(
            lambda rest, name: F.when(counts[name] == best, F.lit(name)).otherwise(rest),
            reversed(names),
            F.lit(None).cast("string"),
        )
        return F.when(best > 0, choice)

    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return let(words, lambda w: let(F.struct(*[hits(w, name) for name in names]), choose))
