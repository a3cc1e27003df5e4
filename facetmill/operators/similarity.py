"""Similarity of components and merge decisions (JOIN-16, JOIN-17, SIM-1 to SIM-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.config import AggregationConfig
from facetmill.functions import text as tx

from . import numbering, tokens


#: Rows in a block of a group, so that a cell of two blocks makes about BLOCK**2 pairs at most.
BLOCK = 256
#: Tasks that one group's rows are dealt over when they get the group's size.
SALTS = 16


def cells(rows: DataFrame, group: list[str], ident: str, order: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of each group, keyed by cell: (group, i, j, a, _x) and (group, i, j, b, _y).

    A group's rows are numbered in order and cut into blocks; blocks i <= j make a cell,
    a triangle of cells for each group. A row is the first of pairs in the cells (i, i),
    (i, i + 1), ... of its block i and the second in (0, j), ..., (j, j) of its block j, so
    every pair has one cell and a group has as many as its size asks for. A group of one
    block, as most are, is copied to no second cell.
    """
    placed = rows.select(*group, F.col(ident).alias("_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    ranked = numbering.number_within(placed, group, [*[F.col(f"_o{k}") for k in range(len(order))], F.col("_id")], "_n")
    ranked = ranked.select(*group, "_id", "_n", F.floor((F.col("_n") - 1) / block).cast("int").alias("_block"))
    last = ranked.groupBy(*group).agg(F.max("_block").alias("_last")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = ranked.withColumn("_salt", (F.col("_n") % SALTS).cast("int")).join(last, [*group, "_salt"])
    x = first.select(*group, F.col("_block").alias("i"), F.explode(F.sequence("_block", "_last")).alias("j"), F.col("_id").alias("a"), F.col("_n").alias("_x"))
    y = ranked.select(*group, F.explode(F.sequence(F.lit(0), "_block")).alias("i"), F.col("_block").alias("j"), F.col("_id").alias("b"), F.col("_n").alias("_y"))
    return x, y


def all_pairs(rows: DataFrame, group: str | list[str], ident: str, order: list[str]) -> DataFrame:
    """Every two rows of a group (of one column, as ``group_id``, or several), once, the first in order first (JOIN-16).

    The result is quadratic by definition; its cells (see ``cells``) are even.
    """
    if isinstance(group, str):
        rows, group = rows.select(F.col(group).alias("group_id"), *dict.fromkeys([ident, *order])), ["group_id"]
    # small rows that make many pairs: left to itself, Spark would put few bytes of cells into one task
    x, y = (shared.dealt(side, *group, "i", "j") for side in cells(rows, group, ident, order))
    return x.join(y, [*group, "i", "j"]).where("_x < _y").drop("_x", "_y", "i", "j")


def shared_elements(sets: DataFrame, group: str, ident: str, order: list[str]) -> DataFrame:
    """(a, b, kind, common): how many elements two sets of a group share, for pairs that share any (SIM-2, SIM-3).

    sets: group, ident, order, kind and x, a row for each element of a set. Sets meet by
    element; those of a frequent element are paired in cells, like those of a group.
    """
    met = all_pairs(sets, [group, "kind", "x"], ident, order)
    return met.groupBy("a", "b", "kind").agg(F.count("*").alias("common"))


def set_jaccard(pairs: DataFrame, sets: DataFrame, group: str, ident: str, order: list[str], kinds: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the Jaccard similarity of each kind of set, 0 where one is empty."""
    common = shared_elements(sets, group, ident, order)
    common = common.groupBy("a", "b").agg(*[F.sum(F.when(F.col("kind") == k, F.col("common"))).alias(f"_c_{k}") for k in kinds])
    sizes = sets.groupBy(ident).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    out = pairs.join(common, ["a", "b"], "left")
    for side in "ab":
        out = out.join(sizes.select(F.col(ident).alias(side), *[F.col(k).alias(f"_{side}_{k}") for k in kinds]), side, "left")
    made = {}
    for k in kinds:
        both = F.coalesce(f"_c_{k}", F.lit(0))
        made[k] = F.when(both > 0, both / (F.col(f"_a_{k}") + F.col(f"_b_{k}") - both)).otherwise(F.lit(0.0))
    return out.withColumns(made).drop(*[f"_{p}_{k}" for p in "abc" for k in kinds])


def weighted_jaccard(pairs: DataFrame, freq: DataFrame, ident: str, token: str, n: str, out: str = "lexical") -> DataFrame:
    """Pairs (a, b) with the sum of least over the sum of greatest counts, 0 for no tokens (SIM-1).

    The greatest add up to both totals less the least, so only shared tokens are joined.
    """
    x = freq.select(F.col(ident).alias("a"), F.col(token).alias("_t"), F.col(n).alias("_x"))
    y = freq.select(F.col(ident).alias("b"), F.col(token).alias("_t"), F.col(n).alias("_y"))
    least = pairs.select("a", "b").join(x, "a").join(y, ["b", "_t"]).groupBy("a", "b").agg(F.sum(F.least("_x", "_y")).alias("_least"))
    total = freq.groupBy(ident).agg(F.sum(n).alias("_n"))
    joined = pairs.join(least, ["a", "b"], "left").join(total.toDF("a", "_na"), "a", "left").join(total.toDF("b", "_nb"), "b", "left")
    low = F.coalesce("_least", F.lit(0))
    high = F.coalesce("_na", F.lit(0)) + F.coalesce("_nb", F.lit(0)) - low
    return joined.withColumn(out, F.when(high > 0, low / high).otherwise(0.0)).drop("_least", "_na", "_nb")


def direct(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with 1 where an edge (from_id, to_id) joins them in either direction (JOIN-17, SIM-4)."""
    both = edges.select(F.least("from_id", "to_id").alias("_l"), F.greatest("from_id", "to_id").alias("_g")).distinct().withColumn("_d", F.lit(1.0))
    keyed = pairs.withColumns({"_l": F.least("a", "b"), "_g": F.greatest("a", "b")})
    return keyed.join(both, ["_l", "_g"], "left").withColumn("direct", F.coalesce("_d", F.lit(0.0))).drop("_l", "_g", "_d")


#: The least value of each measure that counts as evidence, and its name.
FAMILIES = [("lexical", 0.20), ("context", 0.30), ("neighborhood", 0.20), ("direct", None), ("block", 0.20)]


def support(names: dict[str, str] | None = None) -> Column:
    """Names of the measures that reach their evidence threshold (SIM-6)."""
    names = names or {m: m for m, _ in FAMILIES}
    return F.filter(F.array(*[F.when(F.col(m) > 0 if t is None else F.col(m) >= t, F.lit(names[m])) for m, t in FAMILIES]), lambda x: x.isNotNull())


def combined(c: AggregationConfig) -> Column:
    """SIM-5; terms are added in this order."""
    return c.lexical_weight * F.col("lexical") + c.contextual_weight * F.col("context") + c.neighborhood_weight * F.col("neighborhood") + c.direct_dependency_weight * F.col("direct") + c.block_evidence_weight * F.col("block")


#: Names of evidence as reports show them.
SUPPORT = {"lexical": "lexical", "context": "contextual", "neighborhood": "neighborhood", "direct": "dependency", "block": "block"}


def twins(candidates: DataFrame, elements: DataFrame, outgoing: DataFrame) -> DataFrame:
    """(group_id, candidate_id, twin, n, signature, classification_status): each component, the least one like it, and its place in the group.

    Twins are of one group, signature and class and have the same elements (see
    ``elements``) and the same components at the other ends of their edges. So every
    measure of a pair is that of their twins, and no edge joins two twins, as each would
    have itself at an end. Elements count as equal where their number and two 64-bit
    hashes of all are.
    """
    order = candidates.select("group_id", "candidate_id", "signature", "classification_status", F.coalesce(F.get("files", F.lit(0)), F.lit("")).alias("_f"), F.coalesce("min_line", F.lit((1 << 31) - 1)).alias("_l"))
    ends = outgoing.select("candidate_id", "other_candidate_id")
    ends = ends.union(ends.select("other_candidate_id", "candidate_id")).distinct().toDF("component_id", "x")
    all_ = elements.select("component_id", "kind", "x", "n").union(ends.select("component_id", F.lit("ends"), "x", F.lit(1).cast("long")))
    seen = all_.groupBy(F.col("component_id").alias("candidate_id")).agg(F.count("*").alias("_c"), F.bit_xor(F.xxhash64("kind", "x", "n")).alias("_h"), F.bit_xor(F.xxhash64(F.lit("twins"), "n", "x", "kind")).alias("_i"))
    placed = numbering.number_within(order, ["group_id"], [F.col("_f"), F.col("_l"), F.col("candidate_id")], "n").join(seen, "candidate_id", "left").na.fill(0, ["_c", "_h", "_i"])
    same = ["group_id", "signature", "classification_status", "_c", "_h", "_i"]
    placed = shared.stored(placed, "placed")
    least = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min("candidate_id").alias("twin"))
    on = None
    for c in same:
        on = F.col(c).eqNullSafe(F.col(f"_{c}")) if on is None else on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(least, on).select("group_id", "candidate_id", "twin", "n", "signature", "classification_status")


def elements(sets: DataFrame, freq: DataFrame) -> DataFrame:
    """(component_id, kind, x, n): what components are compared by, tokens with their counts among them."""
    return sets.select("component_id", "kind", "x", F.lit(1).cast("long").alias("n")).union(freq.select("component_id", F.lit("tokens"), "token", F.col("n").cast("long")))


def compared(pairs: DataFrame, held: DataFrame, kinds: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the sum of least over the sum of greatest counts of each kind, 0 where none is shared (SIM-1 to SIM-3).

    held: group_id, component_id, kind, x, n. Only what two or more of a group have is
    paired, in cells, so a component of very many names costs none of them.
    """
    key = ["group_id", "kind", "x"]
    often = held.groupBy(*key).agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    met = all_pairs(held.join(often, key).select(*key, F.struct("component_id", "n").alias("_e")), key, "_e", [])
    least = met.select(F.least("a.component_id", "b.component_id").alias("_l"), F.greatest("a.component_id", "b.component_id").alias("_g"), "kind", F.least("a.n", "b.n").alias("n"))
    least = least.groupBy("_l", "_g").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"_c_{k}") for k in kinds])
    own = held.groupBy("component_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds])
    out = pairs.withColumns({"_l": F.least("a", "b"), "_g": F.greatest("a", "b")}).join(least, ["_l", "_g"], "left").drop("_l", "_g")
    for side in "ab":
        out = out.join(own.select(F.col("component_id").alias(side), *[F.col(k).alias(f"_{side}_{k}") for k in kinds]), side, "left")
    made = {}
    for k in kinds:
        low = F.when(F.col("a") == F.col("b"), F.col(f"_a_{k}")).otherwise(F.col(f"_c_{k}"))
        made[k] = F.when(low > 0, low / (F.col(f"_a_{k}") + F.col(f"_b_{k}") - low)).otherwise(F.lit(0.0))
    return out.withColumns(made).drop(*[f"_{p}_{k}" for p in "abc" for k in kinds])


def similarities(like: DataFrame, held: DataFrame, outgoing: DataFrame, c: AggregationConfig) -> DataFrame:
    """All pairs of different ``twins`` of a group with every measure, and a row with a = b for those of several components.

    held: the ``elements`` of all components.
    """
    first = like.where("candidate_id = twin")
    pairs = all_pairs(first.select("group_id", "candidate_id", "n"), "group_id", "candidate_id", ["n"])
    several = like.groupBy("group_id", "twin").agg(F.count("*").alias("_k")).where("_k > 1")
    pairs = pairs.select("group_id", "a", "b").union(several.select("group_id", F.col("twin").alias("a"), F.col("twin").alias("b")))
    placed = held.join(first.select("group_id", F.col("candidate_id").alias("component_id")), "component_id")
    both = compared(pairs, placed, [*tokens.KINDS, "tokens"])
    both = direct(both, outgoing.select(F.col("candidate_id").alias("from_id"), F.col("other_candidate_id").alias("to_id")))
    both = both.withColumns({"lexical": F.col("tokens"), "context": tx.mean(F.col("packages"), F.col("classes"), F.col("files")), "neighborhood": F.col("neighbors"), "block": F.col("block_ids")})
    both = both.withColumns({"combined": combined(c), "threshold": F.lit(c.pairwise_merge_threshold), "support": support(SUPPORT)})
    return both.select("group_id", "a", "b", "lexical", "context", "neighborhood", "direct", "block", "combined", "threshold", F.size("support").alias("support_count"), "support")


def expanded(judged: DataFrame, like: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for every pair of components of a group, the first in order first, from the rows of their twins (JOIN-16).

    Quadratic by definition. Twins are listed in blocks; a row of ``judged`` becomes one
    for each two blocks, which are dealt evenly, before it becomes pairs.
    """
    ranked = numbering.number_within(like.select("twin", "candidate_id", "n"), ["twin"], [F.col("n")], "_k").withColumn("_block", F.floor((F.col("_k") - 1) / block).cast("int"))
    lists = shared.stored(ranked.groupBy("twin", "_block").agg(F.collect_list(F.struct("n", F.col("candidate_id").alias("id"))).alias("_list")), "lists")
    last = lists.groupBy("twin").agg(F.max("_block").alias("_last"))
    each = judged.join(last.toDF("a", "_la"), "a").join(last.toDF("b", "_lb"), "b")
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(0), "_la"))).withColumn("_j", F.explode(F.sequence(F.lit(0), "_lb"))).where("a <> b or _i <= _j").drop("_la", "_lb")
    each = shared.dealt(each, "a", "b", "_i", "_j").join(lists.toDF("a", "_i", "_x"), ["a", "_i"]).join(lists.toDF("b", "_j", "_y"), ["b", "_j"])
    each = each.withColumn("_p", F.explode("_x")).withColumn("_q", F.explode("_y")).where("a <> b or _p.n < _q.n")
    forth = F.col("_p.n") < F.col("_q.n")
    kept = [k for k in judged.columns if k not in ("group_id", "a", "b")]
    return each.select("group_id", F.when(forth, F.col("_p.id")).otherwise(F.col("_q.id")).alias("a"), F.when(forth, F.col("_q.id")).otherwise(F.col("_p.id")).alias("b"), *kept)


#: Components in a block of names, where pairs get their places in the order of names.
NAMES = 4096


def in_order(told: DataFrame, like: DataFrame, names: int | None = None, block: int | None = None) -> tuple[DataFrame, int]:
    """(a, b, told, place): ``expanded`` with the rank of each pair in the order of (a, b), and how many pairs there are.

    told: a, b, told (int), all pairs of twins of one group; where told is null, there is no
    pair. like: components of the group, all or some. Pairs are quadratic, so they
    are neither sorted, shuffled nor stored: components in the order of their names are
    cut into blocks, pairs of one component and one block are counted, running sums of the
    counts say where they start, and then they are made again, with their places. What is
    stored is a count for each component and block. A task holds a block and, for a
    twin, what is told of it and each other; the blocks, which are broadcast, take some
    80 bytes a component.
    """
    names, block = names or NAMES, block or BLOCK
    twins_ = numbering.number(like.select("twin").distinct(), [F.col("twin")], "_t")
    ids = numbering.number(like.select("twin", "candidate_id", "n").join(twins_, "twin"), [F.col("candidate_id")], "_k").withColumn("_j", F.floor((F.col("_k") - 1) / names).cast("int"))
    ids = shared.stored(numbering.number_within(ids, ["twin"], [F.col("n")], "_q").withColumn("_q", F.floor((F.col("_q") - 1) / block).cast("int")), "names")
    lists = ids.groupBy("_j").agg(F.array_sort(F.collect_list(F.struct("_k", "n", F.col("candidate_id").alias("id"), "_t"))).alias("_list"))
    both = told.select("a", "b", "told").union(told.where("a <> b").select("b", "a", "told")).union(twins_.select("twin", "twin", F.lit(None).cast("int")))
    both = both.join(twins_.toDF("b", "_t"), "b").join(twins_.select(F.col("twin").alias("a")), "a", "left_semi").groupBy("a", "_t").agg(F.max("told").alias("told"))
    row = both.groupBy(F.col("a").alias("twin")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "told"))), lambda x: x["told"]).alias("_row"))
    row = shared.stored(row, "told")

    def met(firsts: DataFrame) -> DataFrame:
        """Lists of first components (twin, _q, _j, _as), each an own row, beside what of block _j makes a pair with their twin."""
        said = lambda x: F.get("_row", (x["_t"] - 1).cast("int"))
        seen = F.transform(F.filter("_list", lambda x: said(x).isNotNull()), lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id"), said(x).alias("told")))
        # not in the order of keys that rows are grouped by below: Spark would leave this out, and put few bytes into one task
        each = shared.dealt(firsts.join(row, "twin"), "_j", "_q", "twin").join(F.broadcast(lists), "_j")
        return each.select("twin", "_q", "_j", "_as", seen.alias("_seen")).select("twin", "_q", "_j", F.explode("_as").alias("_a"), "_seen")

    later = F.filter("_seen", lambda x: x["n"] > F.col("_a.n"))
    last = ids.agg(F.max("_j")).first()[0]
    firsts = ids.groupBy("twin", "_q").agg(F.collect_list(F.struct("_k", "n", F.col("candidate_id").alias("id"))).alias("_as"))
    counts = met(firsts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))).select("twin", "_q", "_j", "_a", F.size(later).cast("long").alias("_c")).where("_c > 0")
    counts = shared.stored(counts.withColumn("_i", F.floor((F.col("_a._k") - 1) / names).cast("int")), "counts")
    base = counts.groupBy("_i").agg(F.sum("_c").alias("_s"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = shared.stored(base.withColumn("_base", before("_s", Window.partitionBy(F.lit(0)).orderBy("_i"))), "starts")  # a row for each block
    starts = counts.join(F.broadcast(base.select("_i", "_base")), "_i").withColumn("_start", F.col("_base") + before("_c", Window.partitionBy("_i").orderBy("_a._k", "_j")))
    again = met(starts.groupBy("twin", "_q", "_j").agg(F.collect_list(F.struct("_start", "_a.n", "_a.id")).alias("_as")))
    pairs = again.select("_a", F.posexplode(later).alias("_p", "_b")).select(F.col("_a.id").alias("a"), F.col("_b.id").alias("b"), F.col("_b.told").alias("told"), (F.col("_a._start") + F.col("_p") + 1).alias("place"))
    return pairs, base.agg(F.sum("_s")).first()[0] or 0


def judged(similar: DataFrame, candidates: DataFrame, c: AggregationConfig) -> DataFrame:
    """``similar`` with merge or not, and the first rule that says so (SIM-7)."""
    k = candidates.select("candidate_id", "signature", "classification_status")
    d = similar.join(k.toDF("a", "a_sig", "a_class"), "a").join(k.toDF("b", "b_sig", "b_class"), "b")
    isolated = F.lit(not c.aggregate_isolated_entities) & ((F.col("a_class") == "ISOLATED_ENTITY") | (F.col("b_class") == "ISOLATED_ENTITY"))
    why = (
        F.when(F.col("a_sig") != F.col("b_sig"), "different product signatures").when(isolated, "isolated aggregation disabled")
        .when(F.col("support_count") < c.minimum_evidence_families, "insufficient independent evidence families")
        .when(F.col("combined") < c.pairwise_merge_threshold, "combined score below threshold")
    )
    return d.select(*similar.columns, F.when(why.isNull(), "MERGED").otherwise("NOT_MERGED").alias("decision"), F.coalesce(why, F.lit("threshold and evidence-family requirements satisfied")).alias("reason"))


def decisions(similar: DataFrame, candidates: DataFrame, c: AggregationConfig) -> DataFrame:
    """Merge or not, and why (SIM-7)."""
    return judged(similar, candidates, c).select(*DECISION)


#: Columns of the two reports on pairs.
SIMILARITY = ["group_id", "a", "b", "lexical", "context", "neighborhood", "direct", "block", "combined", "threshold", "support_count", "support"]
DECISION = ["group_id", "a", "b", "decision", "combined", "support", "reason"]
