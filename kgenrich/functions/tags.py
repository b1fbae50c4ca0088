"""F14 tag parts and F17 relation-name words (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def simple_tag(tag: Column) -> Column:
    """n / a / r / v for nouns, adjectives, adverbs, verbs (else null)."""
    return (F.when(tag.startswith("subst:"), "n").when(tag.startswith("adj:"), "a")
            .when(tag.startswith("adv:"), "r")
            .when(tag.startswith("fin:") | tag.startswith("praet:"), "v"))


def _part(tag: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(tag, ":"), i), F.lit(""))


def coarse_tag(tag: Column) -> Column:
    return F.split(tag, ":").getItem(0)


def morph_features(tag: Column) -> Column:
    rest = F.slice(F.split(tag, ":"), 2, 1 << 20)
    return F.when(F.size(rest) > 0, F.array_join(rest, "|")).otherwise(F.lit("_"))


def gender(tag: Column) -> Column:
    return F.when(simple_tag(tag).isin("a", "n"), _part(tag, 3)).otherwise("")


def case(tag: Column) -> Column:
    return F.when(simple_tag(tag).isin("a", "n"), _part(tag, 2)).otherwise("")


def person(tag: Column) -> Column:
    return F.when(simple_tag(tag) == "v", _part(tag, 2)).otherwise("")


def number(tag: Column) -> Column:
    return F.when(simple_tag(tag).isin("a", "n", "v"), _part(tag, 1)).otherwise("")


def aspect(tag: Column) -> Column:
    return F.when(simple_tag(tag) == "v", _part(tag, 3)).otherwise("")


def relation_words(p: Column) -> Column:
    """camelCase relation name -> lower-case words (a split before every
    upper-case letter, as the original does)."""
    spaced = F.regexp_replace(p, r"(\p{Lu})", " $1")
    return F.filter(F.transform(F.split(spaced, " "), F.lower), lambda w: w != "")
