"""Column functions on names, paths and identifiers. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetmill.config import EXTERNAL_PREFIXES, EXTERNAL_TYPES, STANDARD_ANNOTATIONS, STOP_WORDS


def parse_signature(text: Column) -> Column:
    """Product ids of a raw signature: split at ``|``, trimmed, empty ones dropped, order kept (DIR-6)."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\|", -1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), lambda x: x != "")


def restrict(own: Column, parent: Column) -> Column:
    """Ids of ``own`` that ``parent`` has too, in own order with repeats (DIR-5)."""
    return F.filter(own, lambda x: F.array_contains(parent, x))


def canonical_ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def canonical_target(text: Column) -> Column:
    """A target's name without white space, type arguments and dimensions (STR-6)."""
    return F.substring_index(F.substring_index(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), "<", 1), "[", 1)


def simple_name(name: Column) -> Column:
    """What follows the last dot of the canonical name (STR-7)."""
    return F.substring_index(canonical_target(name), ".", -1)


def package_prefix(qualified: Column) -> Column:
    """All before the last dot, or nothing (STR-8)."""
    return F.when(F.instr(qualified, ".") > 0, F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def enclosing_class(qualified: Column) -> Column:
    """The last segment but one, or the only one (STR-8)."""
    parts = F.split(qualified, r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))


def known_external(text: Column) -> Column:
    """Whether a name is of a library package or a known library type (STR-9)."""
    target = canonical_target(text)
    hit = simple_name(target).isin(*EXTERNAL_TYPES)
    for p in EXTERNAL_PREFIXES:
        hit = hit | target.startswith(p)
    return hit


def block_id(file: Column, directive: Column, start: Column, end: Column) -> Column:
    """``file:DIRECTIVE:start-end`` (STR-10)."""
    return F.concat(file, F.lit(":"), directive, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def capitalize(token: Column) -> Column:
    """The first character in upper case (STR-11)."""
    return F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 1 << 30))


def csv_quote(value: Column) -> Column:
    """Quoted with doubled quotes; null is empty (STR-12)."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def display_name(qualified: Column, simple: Column) -> Column:
    """The qualified name, or else the simple one (STR-13)."""
    return F.coalesce(qualified, simple)


def join_ids(ids: Column) -> Column:
    """Joined with ``|`` (ARR-1)."""
    return F.array_join(ids, "|")


def mean(*columns: Column) -> Column:
    """Arithmetic mean, added in the order given (MATH-1)."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))


def split_identifier(fragment: Column) -> Column:
    """Parts of an identifier at camel case, underscores and white space (STR-2)."""
    spaced = F.regexp_replace(fragment, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(F.replace(spaced, F.lit("_"), F.lit(" ")), r"\s+")


def stem(token: Column) -> Column:
    """Lower case with the first ending that applies cut: ies, ing, s (STR-3)."""
    t = F.lower(token)
    n = F.length(t)
    return (
        F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("ing") & (n > 5), F.substring(t, F.lit(1), n - 3))
        .when(t.endswith("s") & (n > 3), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def raw_tokens(text: Column) -> Column:
    """Tokens of a text in order, before stemming; standard annotations dropped (STR-1, STR-2, STR-4)."""
    fragments = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda x: (x != "") & ~x.isin(*STANDARD_ANNOTATIONS))
    return F.filter(F.flatten(F.transform(fragments, split_identifier)), lambda x: (F.trim(x) != "") & ~x.isin(*STANDARD_ANNOTATIONS))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Stemmed tokens of a text in order, without digits and stop words (STR-1 to STR-4)."""
    return F.filter(F.transform(raw_tokens(text), stem), lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~x.isin(*stop_words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty (SIM-2, SIM-3)."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))
