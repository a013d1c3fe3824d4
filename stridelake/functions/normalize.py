"""Label, path and free-text normalisation, and identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def normalize_label(c: Column) -> Column:
    """Lower case, outer spaces off, inner spaces collapsed; exact for ASCII labels."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


@F.pandas_udf(T.StringType())
def normalize_label_unicode(s: pd.Series) -> pd.Series:
    """NFKC, casefold, outer spaces off, inner spaces collapsed; for labels beyond ASCII."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def normalize_token(c: Column) -> Column:
    """Lower case, every run of other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_path_text(c: Column) -> Column:
    """Forward slashes only, single, none at the ends; lower case.  Exact for ASCII; fold other texts with ``fold`` first."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/"), "^/|/$", ""))


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """NFKC and casefold, for names beyond ASCII; the other functions then apply."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalize_path(c: Column) -> Column:
    """A path's identity: forward slashes only, single, none at the ends; each part, the file name with its extension included, as a token."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^/+|/+$", ""), "/+")
    return F.array_join(F.transform(parts, normalize_token), "/")


def motion_stem(c: Column) -> Column:
    """File name without extension and without a trailing ``_poses``, ``_stageii`` or ``_stagei``, as a token."""
    name = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    return normalize_token(F.regexp_replace(name, "(?i)_(?:poses|stageii|stagei)$", ""))


def free_text(c: Column) -> Column:
    """Words of letters or of digits, lower case, with a space on each side of every word."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(c), "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, "[^a-z0-9]+", " ")), F.lit(" "))


def phrase_hits(values: Column, phrases: list[str]) -> Column:
    """The phrases that occur as whole words in any of the normalised values, sorted."""
    return F.filter(F.array(*map(F.lit, sorted(phrases))), lambda p: F.exists(values, lambda v: F.contains(v, F.concat(F.lit(" "), p, F.lit(" ")))))


def clean_component(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def motion_id(source: Column, subject: Column, name: Column, path: Column) -> Column:
    """``source_subject_name_`` and eight digits of the path's SHA-1; empty and null parts are left out."""
    part = lambda c: F.when(F.length(c) > 0, clean_component(c))
    return F.concat_ws("_", part(source), part(subject), part(name), F.substring(F.sha1(path), 1, 8))


def hash_bucket(seed: int | str, ident: Column, n: int) -> Column:
    """The first eight bytes of sha256(``seed:ident``), big-endian, modulo ``n``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 16)
    return F.pmod(F.conv(digits, 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def first_in_bucket(df: DataFrame, ident: str, order: list[str], seed: int | str, n: int) -> DataFrame:
    """``bucket`` and, of the rows that fall into it, the ``ident`` that comes first by ``order``; combined before the shuffle."""
    key = F.struct(*(F.col(c) for c in order), F.col(ident))
    return df.groupBy(hash_bucket(seed, F.col(ident), n).alias("bucket")).agg(F.min_by(F.col(ident), key).alias(ident))


def hash_sample(df: DataFrame, ident: str, seed: str, n: int) -> DataFrame:
    """``n`` rows without replacement: those whose ids have the smallest SHA-256 of ``seed:id``; the same whatever the order."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256), ident).limit(n)


def taxonomy(groups: dict[str, list[str]], excluded: list[str] = (), unmapped: str = "other") -> dict[str, str | None]:
    """Group of each normalised label, None for excluded ones; a label in two groups is an error.  ``""`` holds the group of all others."""
    plain = lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().split())
    lookup: dict[str, str] = {}
    for group, labels in groups.items():
        for label in [group, *labels]:
            if lookup.get(plain(label), group) != group and label != group:
                raise ValueError(f"label {label!r} belongs to both {lookup[plain(label)]} and {group}")
            lookup[plain(label)] = group
    left_out = set(map(plain, excluded))
    known = {label: None if plain(group) in left_out else group for label, group in lookup.items()}
    return known | {"": None if plain(unmapped) in left_out else unmapped}


def map_labels(labels: Column, known: dict[str, str | None]) -> Column:
    """Sorted distinct groups of an array of normalised labels; empty and null labels and excluded groups go."""
    table = F.create_map(*(F.lit(x) for pair in known.items() if pair[0] for x in pair)) if len(known) > 1 else None
    other = F.lit(known[""]).cast("string")

    def group(l):
        if table is None:
            return other
        return F.when(F.map_contains_key(table, l), table[l]).otherwise(other)

    useful = F.filter(labels, lambda l: l.isNotNull() & (l != ""))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(useful, group))))


def label_categories(act: Column, proc: Column, raw: Column) -> Column:
    """Categories of one label: what isn't empty in its act list, else, without a list, its processed, else its raw form; sorted, distinct."""
    one = lambda c: F.when(c != "", F.array(normalize_label(c)))
    acts = F.when(F.size(act) > 0, F.transform(F.filter(act, lambda v: v != ""), normalize_label))
    return F.array_sort(F.array_distinct(F.coalesce(acts, one(proc), one(raw), F.array().cast("array<string>"))))


def label_evidence(act: Column, proc: Column, raw: Column) -> Column:
    """All that one label says: its categories and its processed and raw forms, without empty ones; sorted, distinct."""
    forms = F.array_compact(F.array(normalize_label(proc), normalize_label(raw)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(label_categories(act, proc, raw), forms), lambda v: v != "")))
