"""Relation specifications and fixed values.

The fixed values below must equal the behaviour being reproduced, so they are
stated plainly and together.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

# --- fixed values -----------------------------------------------------------
# Types that are too wide to select candidates by (local names).
WIDE_TYPES = ["Place", "Thing", "NaturalPlace", "BodyOfWater", "_Feature"]
# Geographic types that make up the entity catalog (in this order).
CATALOG_TYPES = [
    "Place", "PopulatedPlace", "Settlement", "Country", "AdministrativeRegion",
    "Continent", "Island", "City", "River", "BodyOfWater", "Stream", "Lake",
    "NaturalPlace", "MountainRange", "Valley", "Volcano", "Mountain",
]
# Generic nouns never used as a text value: river, stream, city, village.
GENERIC_VALUE_WORDS = ["rzeka", "potok", "miasto", "wieś"]
# Multiplier words after a number.
THOUSAND_WORDS = ["tysiąc", "tys"]
MILLION_WORDS = ["mln", "milion"]
# Lemma overrides applied after link correction.
LEMMA_OVERRIDES = {"Województwo": "województwo"}
# Thresholds.
PREDOMINANT_SHARE = 0.75          # share of typed subjects holding a type
MIN_TYPE_SIZE = 100               # a candidate type needs more entities
TRAINING_LIMIT = 20000            # training pairs cap
CLASSIFIER_CONFIDENCE = 0.7       # keep sentences with p above
EXTRACTOR_CONFIDENCE = 0.8        # keep values with p above
ARTICLE_SENTENCE_LIMIT = 10       # lines before tagging / sentences after
RECENT_YEAR = (1990, 2012)        # recent-year feature bounds
WINDOW = 3                        # token window of the value extractor
CRF_ITERATIONS = 100              # of the extractor's solver at most
LEARNING_CURVE_CAPS = [10, 25, 50, 100, 250, 500, 1000, 2500]
LEARNING_CURVE_RUNS = 10
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class RelationSpec:
    """One relation to learn (a row of the ``relations`` table)."""

    p: str
    is_numeric: bool = False
    subject_type: str | None = None          # type restriction (wins over mining)
    object_type: str | None = None           # restriction for value types
    words: tuple[str, ...] = ()              # relation-name words (F17 when empty)
    needs_word: bool = False                 # G5: sentence must hold a name word
    name_exclusions: tuple[str, ...] = ()    # D7: candidates containing these dropped
    allow_same_prefix: bool = False          # I9 exemption
    allow_unknown_value: bool = False        # I14 fallback to raw value
    dedupe_values: bool = True               # G2 applies when over the limit

    def as_row(self) -> dict:
        d = asdict(self)
        d["words"] = list(self.words)
        d["name_exclusions"] = list(self.name_exclusions)
        return d


RELATIONS_SCHEMA = (
    "p string, is_numeric boolean, subject_type string, object_type string, "
    "words array<string>, needs_word boolean, name_exclusions array<string>, "
    "allow_same_prefix boolean, allow_unknown_value boolean, dedupe_values boolean"
)


def relations_frame(spark, specs):
    """The ``relations`` table (M3) as a small DataFrame."""
    return spark.createDataFrame([s.as_row() for s in specs], RELATIONS_SCHEMA)
