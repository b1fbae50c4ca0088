"""IRI helpers (build, strip prefix, percent-decode) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Default namespaces (parameters of every function below).
DATA_SOURCE = "http://pl.kg.example.org"
ONTOLOGY = "http://kg.example.org/ontology/"


def _quote(name: Column) -> Column:
    # url_encode is form encoding: a space becomes '+'; IRIs want %20, and
    # '/' stays raw as in a path.
    enc = F.url_encode(name)
    return F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def resource_iri(name: Column, source: str = DATA_SOURCE) -> Column:
    return F.concat(F.lit(f"{source}/resource/"), _quote(name))


def property_iri(name: Column, source: str = DATA_SOURCE) -> Column:
    return F.concat(F.lit(f"{source}/property/"), _quote(name))


def type_iri(name: Column) -> Column:
    return F.concat(F.lit(ONTOLOGY), name)


def percent_decode(s: Column) -> Column:
    # url_decode also maps '+' to a space: protect literal '+' first.
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def local_name(iri: Column, source: str = DATA_SOURCE) -> Column:
    """Strip the resource prefix (when present) and percent-decode."""
    prefix = f"{source}/resource/"
    stripped = F.when(iri.startswith(prefix), F.substring(iri, len(prefix) + 1, 1 << 30)) \
        .otherwise(iri)
    return percent_decode(stripped)


def strip_any_prefix(iri: Column) -> Column:
    """Last path segment of an IRI (types, properties), percent-decoded."""
    return percent_decode(F.regexp_extract(iri, r"([^/#]*)$", 1))
