"""Settings of the aggregation stage and values that are fixed by the data model."""

from __future__ import annotations

from dataclasses import dataclass

# Names and their order.
DIRECTIVES = ("IF", "ELIF", "ELSE", "ENDIF")
ENTITY_TYPES = ("CLASS", "INTERFACE", "METHOD", "CONSTRUCTOR", "FIELD")
RELATION_TYPES = ("TYPE_REFERENCE", "METHOD_CALL", "CONSTRUCTOR_CALL", "EXTENDS", "IMPLEMENTS", "FIELD_REFERENCE")
RESOLUTION = ("RESOLVED_INTERNAL", "RESOLVED_EXTERNAL", "AMBIGUOUS", "UNRESOLVED")
CLASSIFICATION = ("STRUCTURALLY_CONNECTED", "ISOLATED_ENTITY", "INFRASTRUCTURE_LIKE", "BLOCK_ONLY", "UNCLASSIFIED")
SCOPES = ("INTERNAL_CANDIDATE", "INTRA_SIGNATURE_INTER_CANDIDATE", "CROSS_SIGNATURE")
COMMONALITY = ("FULL_COMMONALITY", "SUBGROUP_COMMONALITY", "VARIABLE_SIGNATURE")
LABEL_CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "UNLABELED")
CANDIDATE_CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "UNRESOLVED")
COMMON = "COMMON"

# Names of library types, and prefixes of library packages.
EXTERNAL_TYPES = (
    "Appendable", "ArrayList", "Boolean", "Byte", "Character", "Class", "Collection",
    "Comparable", "Dimension", "Double", "Exception", "Float", "HashMap", "HashSet",
    "Integer", "Iterable", "Iterator", "LinkedList", "List", "Long", "Map", "Number",
    "Object", "Override", "Runnable", "RuntimeException", "Set", "Short", "String",
    "StringBuilder", "Thread", "Throwable", "Vector", "Void",
)
EXTERNAL_PREFIXES = ("java.", "javax.", "com.", "org.")

# Annotations and stop words that aren't tokens.
STANDARD_ANNOTATIONS = ("Override", "Deprecated", "SuppressWarnings", "FunctionalInterface", "SafeVarargs")
STOP_WORDS = (
    "get", "set", "is", "add", "remove", "create", "new", "run", "main",
    "value", "data", "object", "listener", "action", "handler", "manager",
    "util", "impl", "java", "lang", "void", "int", "boolean", "string",
    "class", "interface", "method", "field", "constructor", "core", "examples",
    "example", "de", "ovgu", "featureide", "asset", "reference", "controller",
    "model", "ui", "sim", "unit", "composite", "serial", "version", "uid",
    "btn", "lbl", "txt", "window", "elevator",
)


@dataclass(frozen=True)
class AggregationConfig:
    """Weights, thresholds and switches of semantic aggregation; the defaults are fixed values."""

    lexical_weight: float = 0.35
    contextual_weight: float = 0.20
    neighborhood_weight: float = 0.20
    direct_dependency_weight: float = 0.15
    block_evidence_weight: float = 0.10
    pairwise_merge_threshold: float = 0.42
    minimum_evidence_families: int = 2
    cluster_cohesion_threshold: float = 0.42
    use_comments: bool = False
    use_string_literals: bool = False
    use_custom_annotations: bool = False
    stop_words: tuple[str, ...] = STOP_WORDS
    aggregate_isolated_entities: bool = True
    process_full_commonality: bool = True
    importance_order: str = "asc"
