"""numeric test and knowledge-base value normalisation.

All are Column -> Column expressions (JVM side, whole-stage codegen).
The decimal mark is ``,`` (and ``.`` is accepted as in the original locale
parser); no thousands separator is defined.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import GENERIC_VALUE_WORDS
from ..sources.stopwords import default_stop_words

NUMERIC_RE = r"^\s*[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?\s*$"


def is_numeric(s: Column) -> Column:
    """True when the text parses as a number with ``,`` as decimal mark."""
    return F.coalesce(s.rlike(NUMERIC_RE), F.lit(False))


def try_double(s: Column) -> Column:
    """``,``-decimal text -> double, null when it does not parse."""
    t = F.replace(s, F.lit(","), F.lit("."))
    return F.when(F.trim(t).rlike(NUMERIC_RE), t.try_cast("double"))


def truncate_numeric(s: Column) -> Column:
    """Numeric text -> its truncated integer as text; other text unchanged."""
    return F.when(is_numeric(s), try_double(s).cast("bigint").cast("string")).otherwise(s)


def prepare_numeric(value: Column) -> Column:
    """numeric KB value -> ``array<string>`` with zero or one number.

    multiplier from ``tys``/``mln`` (read before stripping), drop
    ``dddd Census``, keep the first run of digits/``.``/``,``/space, keep only
    digits and ``,`` and parse; else the first space-separated part of the run
    that parses (no multiplier); else empty.
    """
    mult = (F.when(value.contains("tys"), F.lit(1000))
            .when(value.contains("mln"), F.lit(1000000)).otherwise(F.lit(1)))
    stripped = F.regexp_replace(value, r"\d{4} Census", "")
    run = F.regexp_extract(stripped, r"([0-9., ]+)", 1)
    digits = F.regexp_replace(run, r"[^0-9,]", "")
    primary = try_double(digits)
    parts = F.filter(F.split(run, " "), lambda x: try_double(x).isNotNull())
    fallback = try_double(F.get(parts, 0))
    out = F.when(primary.isNotNull(), (primary * mult).cast("bigint")) \
        .otherwise(fallback.cast("bigint"))
    return F.when(out.isNotNull(), F.array(out.cast("string"))) \
        .otherwise(F.array().cast("array<string>"))


def prepare_text(value: Column, stop_words=None, generic=None) -> Column:
    """text KB value -> ``array<string>`` of match tokens.

    drop one ``\\dpx``, alphabetic tokens, plus the whole value when there is
    more than one token; drop tokens of one byte, stop words and generic nouns.
    """
    stop = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None
                                          else default_stop_words())])
    gen = F.array(*[F.lit(w) for w in (generic if generic is not None
                                         else GENERIC_VALUE_WORDS)])
    v = F.regexp_replace(value, r"\dpx", "")
    toks = F.regexp_extract_all(v, F.lit(r"(\p{L}+)"), 1)
    allv = F.when(F.size(toks) > 1, F.concat(toks, F.array(v))).otherwise(toks)
    return F.filter(allv, lambda x: (F.octet_length(x) > 1)
                    & ~F.array_contains(stop, x) & ~F.array_contains(gen, x))


def prepare_value(value: Column, numeric: Column | bool, stop_words=None) -> Column:
    """F12 or F13 depending on the relation kind (a Column or a constant)."""
    if isinstance(numeric, bool):
        return prepare_numeric(value) if numeric else prepare_text(value, stop_words)
    return F.when(numeric, prepare_numeric(value)).otherwise(prepare_text(value, stop_words))
