"""Names to entities in three states: one match, many, none (JOIN-5 to JOIN-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.functions import text as tx


#: A name looked up at least so often is hot; of all hot names the most frequent HOT_NAMES are broadcast.
HOT, HOT_NAMES = 10_000, 4096


def name_index(rows: DataFrame, kind: Column, name: str, ident: str) -> DataFrame:
    """kind, name, n_ids and the least id, a row for each name with text (JOIN-11)."""
    named = rows.where(F.col(name).isNotNull() & (F.trim(name) != "")).select(kind.alias("kind"), tx.canonical_target(F.col(name)).alias("name"), F.col(ident).alias("id")).distinct()
    return named.groupBy("kind", "name").agg(F.count("*").alias("n_ids"), F.min("id").alias("id"))


def _matched(df: DataFrame, key: str, index: DataFrame, p: str, said: DataFrame) -> DataFrame:
    """``df`` with ``p``_n and ``p``_id of (_k, key) in the index.

    Names are as frequent as code makes them (``get``, ``run``): rows of the hottest take
    their match from a broadcast of bounded size. They go on to the shuffled join under
    keys that no name has and that spread them, so no task gets a name's rows.
    """
    often = said.groupBy(F.col("_k").alias("kind"), F.col(key).alias("name")).agg(F.count("*").alias("_c")).where((F.col("_c") >= HOT) & F.col("name").isNotNull())
    hot = often.orderBy(F.desc("_c"), "kind", "name").limit(HOT_NAMES).drop("_c").join(index, ["kind", "name"], "left")
    hot = F.broadcast(hot.select(F.col("kind").alias("_hk"), F.col("name").alias("_hn"), F.col("n_ids").alias("_hc"), F.col("id").alias("_hi"), F.lit(True).alias("_hot")))
    out = df.join(hot, (F.col("_k") == F.col("_hk")) & (F.col(key) == F.col("_hn")), "left")
    apart = F.concat(F.lit("\n"), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)).cast("string"))
    out = out.withColumn("_j", F.when(F.col("_hot") | F.col("_k").isNull() | F.col(key).isNull(), apart).otherwise(F.col(key)))
    ix = index.toDF("_xk", "_xn", "_xc", "_xi")
    out = out.join(ix, (F.coalesce("_k", F.lit("")) == F.col("_xk")) & (F.col("_j") == F.col("_xn")), "left")
    return out.withColumns({f"{p}_n": F.coalesce("_hc", "_xc"), f"{p}_id": F.coalesce("_hi", "_xi")}).drop("_hk", "_hn", "_hc", "_hi", "_hot", "_j", "_xk", "_xn", "_xc", "_xi")


def lookup(df: DataFrame, kind: Column, name: Column, index: DataFrame, out: str, said: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``_n and ``out``_id: matches of the exact name among those of the kind, or else of its last part (JOIN-7).

    said: the rows whose names are counted to find hot ones, by default ``df``; better a stored form of it.
    """
    keys = {"_k": kind, "_e": tx.canonical_target(name), "_s": tx.simple_name(name)}
    keyed, said = df.withColumns(keys), (df if said is None else said).withColumns(keys)
    joined = _matched(_matched(keyed, "_e", index, "_x", said), "_s", index, "_y", said)
    n = F.coalesce("_x_n", "_y_n", F.lit(0))
    return joined.withColumns({f"{out}_n": n, f"{out}_id": F.when(n == 1, F.coalesce("_x_id", "_y_id"))}).drop("_k", "_e", "_s", *[f"_{p}_{c}" for p in "xy" for c in ("n", "id")])


def tri_state(n: Column, external: Column) -> Column:
    """Status by number of matches."""
    return F.when(n == 1, "RESOLVED_INTERNAL").when(n > 1, "AMBIGUOUS").when(external, "RESOLVED_EXTERNAL").otherwise("UNRESOLVED")


def entity_names(entities: DataFrame) -> DataFrame:
    """Every name an entity goes by: kind, name, id."""
    e = entities.select("entity_id", "entity_type", "simple_name", "qualified_name", "declaring")
    types, of = e.where("entity_type in ('CLASS', 'INTERFACE')"), lambda kind: e.where(F.col("entity_type") == kind)
    member = F.concat("declaring", F.lit("#"), "simple_name")
    return (
        types.select(F.lit("T").alias("kind"), F.col("simple_name").alias("name"), "entity_id")
        .union(types.select(F.lit("T"), "qualified_name", "entity_id"))
        .union(of("METHOD").select(F.lit("M"), "simple_name", "entity_id"))
        .union(of("CONSTRUCTOR").select(F.lit("C"), tx.simple_name(F.col("declaring")), "entity_id"))
        .union(of("CONSTRUCTOR").select(F.lit("C"), "declaring", "entity_id"))
        .union(of("FIELD").select(F.lit("F"), "simple_name", "entity_id"))
        .union(of("FIELD").select(F.lit("F"), member, "entity_id"))
    )


def resolve(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """source_entity_id, target_entity_id and resolution_status of merged relations.

    A key bound while parsing wins; then types, methods, constructors (``this`` by
    the declaring type, ``super`` by nothing) and fields (of the declaring type if
    that is unique, else of any) are looked up by name over all files.
    """
    keys = entities.select(F.col("file").alias("_file"), F.struct("entity_type", "declaring", "key_name", "params", "start_line").alias("_key"), F.col("entity_id").alias("_id"), F.col("declaring").alias("_declaring"))
    src = keys.toDF("s_file", "s_key", "source_entity_id", "s_declaring")
    dst = keys.drop("_declaring").toDF("t_file", "t_key", "bound_id")
    r = relations.join(src, (F.col("file") == F.col("s_file")) & (F.col("source_key") == F.col("s_key")), "left").drop("s_file", "s_key")
    r = r.join(dst, (F.col("file") == F.col("t_file")) & (F.col("target_key") == F.col("t_key")), "left").drop("t_file", "t_key")

    index = shared.stored(name_index(entity_names(entities), F.col("kind"), "name", "entity_id"), "names")

    kind = F.when(F.col("relation_type") == "METHOD_CALL", "M").when(F.col("relation_type") == "CONSTRUCTOR_CALL", "C").when(F.col("relation_type") == "FIELD_REFERENCE", "F").otherwise("T")
    own = F.col("source_entity_id").isNotNull() & F.col("target_text").isin("this", "super") & (F.col("relation_type") == "CONSTRUCTOR_CALL")
    name = F.when(own & (F.col("target_text") == "this"), F.col("s_declaring")).when(own, F.lit("")).otherwise(F.col("target_text"))

    r = said = shared.stored(r, "bound")
    r = lookup(r, F.when(F.col("relation_type") == "FIELD_REFERENCE", "F"), F.concat("s_declaring", F.lit("#"), "target_text"), index, "field", said)
    r = lookup(r, kind, name, index, "any", said)
    declared = (F.col("relation_type") == "FIELD_REFERENCE") & (F.col("field_n") == 1)
    n = F.when(F.col("bound_id").isNotNull() | declared, F.lit(1)).otherwise(F.col("any_n"))
    target = F.coalesce("bound_id", F.when(declared, F.col("field_id")), F.col("any_id"))
    external = F.col("resolved_by_parser") | tx.known_external(F.col("target_text"))
    return r.withColumns({"target_entity_id": target, "resolution_status": tri_state(n, external)})
