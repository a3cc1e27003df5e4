"""Complete-link clusters of components, labels and confidences (CLU-1 to CLU-3, LAB-1 to LAB-4, WIN-6)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.config import AggregationConfig
from facetmill.functions import text as tx

from . import grouping, numbering, similarity, tokens
from .components import Candidates, numbered
from .wcc import weakly_connected_components, with_isolated


@dataclass(frozen=True)
class Compared:
    """Components compared with each other: their tokens, twins, and pairs of twins with decisions; ``pairs`` has all pairs."""

    evidence: DataFrame
    frequencies: DataFrame
    like: DataFrame
    judged: DataFrame

    @cached_property
    def pairs(self) -> DataFrame:
        return similarity.expanded(self.judged, self.like)

    def shown(self, *columns: Column | str) -> DataFrame:
        """All pairs with ``columns`` of ``judged``, which are worked out for pairs of twins and only copied to those of components."""
        return similarity.expanded(self.judged.select("group_id", "a", "b", *columns), self.like)

    @property
    def similarities(self) -> DataFrame:
        return self.pairs.select(*similarity.SIMILARITY)

    @property
    def decisions(self) -> DataFrame:
        return self.pairs.select(*similarity.DECISION)


@dataclass(frozen=True)
class Aggregation(Compared):
    """Aggregated candidates and what they are made from; ``members`` maps components to clusters."""

    candidates: DataFrame
    members: DataFrame
    unassigned: DataFrame
    incoming: DataFrame
    outgoing: DataFrame


#: Rows (members and alike pairs) of a part that one call decides; a larger part goes by rounds.
PART = 50_000


def greedy(ids: list[str], alike: set[tuple[str, str]]) -> dict[str, bool]:
    """Members in order of id, accepted while every pair with those accepted before is in ``alike`` (CLU-1)."""
    accepted: list[str] = []
    out = {}
    for i in sorted(ids):
        out[i] = all((j, i) in alike for j in accepted)
        if out[i]:
            accepted.append(i)
    return out


def complete_link(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(group_id, component_id, part, alone): clusters of the components of merged pairs; who isn't accepted is alone.

    nodes: group_id, component_id. pairs: a, b, merged, combined. Members of a part are
    taken in order of id and accepted while all their pairs with those accepted before
    reach the threshold (CLU-1). The mean of such pairs, which has to reach it too,
    then does, as none of them is below it (CLU-2).
    """
    linked = weakly_connected_components(pairs.where("merged"), "a", "b")
    labelled = shared.stored(with_isolated(nodes, "component_id", linked).toDF("component_id", "part"), "parts")
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    near = pairs.where((F.col("combined") >= threshold) & (F.col("a") != F.col("b"))).select(low, high).distinct()
    near = near.join(labelled.toDF("a", "part"), "a").join(labelled.toDF("b", "part"), ["b", "part"])
    near = shared.stored(near.select("part", "a", "b"), "alike")

    rows = labelled.select("part", F.lit(1).alias("m")).union(near.select("part", F.lit(0))).groupBy("part").agg(F.sum("m").alias("members"), F.count("*").alias("rows"))
    sized = shared.stored(labelled.join(rows.where("members > 1"), "part").select("part", "component_id", (F.col("rows") > PART).alias("large")), "sized")
    small, large = sized.where("not large").drop("large"), sized.where("large").drop("large")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = part["b"]
        got = greedy(part.loc[b.isna(), "a"].tolist(), set(zip(part.loc[b.notna(), "a"], b[b.notna()], strict=True)))
        return pd.DataFrame({"part": part["part"].iloc[0], "component_id": list(got), "accepted": list(got.values())})

    shared.ship(nodes.sparkSession)
    some = small.select("part", F.col("component_id").alias("a"), F.lit(None).cast("string").alias("b")).union(near.join(small.select("part").distinct(), "part", "left_semi"))
    decided = some.groupBy("part").applyInPandas(run, "part string, component_id string, accepted boolean")
    if large.limit(1).count():
        decided = decided.union(by_rounds(large, near.join(large.select("part").distinct(), "part", "left_semi")))
    return nodes.join(labelled.join(decided, ["part", "component_id"], "left").select("component_id", "part", (~F.coalesce("accepted", F.lit(True))).alias("alone")), "component_id")


def of_twins(like: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``complete_link`` of all components, by their twins (``similarity.twins``) and the pairs of these.

    A twin stands for its components as it is the least of them, so it is tried first. If
    it is rejected they are too; if it is accepted, all that are accepted later are
    alike to it and so to them, and they are accepted if they are alike to each other. The
    twin's row with itself says that, and whether they are merged with each other.
    """
    first = like.where("candidate_id = twin").select("group_id", F.col("candidate_id").alias("component_id"))
    cross = pairs.where("a <> b")
    placed = complete_link(first, cross, threshold).select(F.col("component_id").alias("twin"), "part", "alone")
    own = pairs.where("a = b").select(F.col("a").alias("twin"), F.col("merged").alias("own_merged"), (F.col("combined") >= threshold).alias("own_alike"))
    met = cross.where("merged").select(F.explode(F.array("a", "b")).alias("twin")).distinct().withColumn("met", F.lit(True))
    all_ = like.select("group_id", F.col("candidate_id").alias("component_id"), "twin").join(placed, "twin").join(own, "twin", "left").join(met, "twin", "left")
    is_first, together = F.col("component_id") == F.col("twin"), F.coalesce("met", "own_merged")
    part = F.when(is_first | together, F.col("part")).otherwise(F.col("component_id"))
    alone = F.when(is_first, F.col("alone")).when(together, F.col("alone") | ~F.col("own_alike")).otherwise(F.lit(False))
    return all_.select("group_id", "component_id", part.alias("part"), alone.alias("alone"))


def by_rounds(members: DataFrame, near: DataFrame) -> DataFrame:
    """(part, component_id, accepted) as ``greedy`` decides, for all parts at once, in joins and counts (CLU-1).

    Undecided members are those alike to all that are accepted. One of them surely stays
    if it is alike to all smaller undecided ones: it has as many alike pairs with them
    as its number among them less one. Those are accepted together, and who isn't alike
    to all of them is rejected. The least undecided member of each part is accepted
    in every round; of random pairs a round decides most.

    members: part, component_id. near: part and the pairs a < b that reach the threshold.
    """
    left, near, out = members, shared.stored(near, "alike"), None
    while left.limit(1).count():
        ranked = numbering.number_within(left, ["part"], [F.col("component_id")], "n")
        smaller = near.groupBy("part", F.col("b").alias("component_id")).agg(F.count("*").alias("alike"))
        state = ranked.join(smaller, ["part", "component_id"], "left")
        state = shared.stored(state.select("part", "component_id", (F.coalesce("alike", F.lit(0)) == F.col("n") - 1).alias("accepted")), "round")
        taken = state.where("accepted").drop("accepted")
        out = taken if out is None else out.union(taken)
        a, b = taken.withColumnRenamed("component_id", "a"), taken.withColumnRenamed("component_id", "b")
        met = near.join(a, ["part", "a"]).select("part", F.col("b").alias("component_id")).union(near.join(b, ["part", "b"]).select("part", F.col("a").alias("component_id")))
        met = met.groupBy("part", "component_id").agg(F.count("*").alias("met"))
        every = taken.groupBy("part").agg(F.count("*").alias("taken"))
        left = shared.stored(state.where("not accepted").join(met, ["part", "component_id"]).join(every, "part").where("met = taken").select("part", "component_id"), "undecided")
        near = near.join(left.withColumnRenamed("component_id", "a"), ["part", "a"]).join(left.withColumnRenamed("component_id", "b"), ["part", "b"]).select("part", "a", "b")
        near = shared.stored(near, "alike")
    accepted = members.sparkSession.createDataFrame([], members.select("part", "component_id").schema) if out is None else out
    return members.join(accepted.withColumn("accepted", F.lit(True)), ["part", "component_id"], "left").select("part", "component_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def label(top: Column) -> Column:
    """LAB-1."""
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return F.when(F.size(top) == 0, "").when(F.size(top) == 1, F.concat(tx.capitalize(first), F.lit(" related code"))).otherwise(F.concat(tx.capitalize(first), F.lit(" "), second, F.lit(" behavior")))


def label_confidence(n_tokens: Column, n_components: Column) -> Column:
    """LAB-2."""
    return F.when(n_tokens == 0, "UNLABELED").when((n_tokens >= 3) & (n_components > 1), "HIGH").when(n_tokens >= 2, "MEDIUM").otherwise("LOW")


def candidate_confidence(confidence: Column, n_components: Column) -> Column:
    """LAB-3."""
    return F.when((n_components > 1) & confidence.isin("HIGH", "MEDIUM"), "HIGH").when(confidence == "MEDIUM", "MEDIUM").when(confidence == "LOW", "LOW").otherwise("UNRESOLVED")


def concerns(confidence: Column) -> Column:
    """LAB-4."""
    return F.when(confidence == "UNRESOLVED", F.array(F.lit("insufficient evidence for semantic aggregation or descriptive label"))).otherwise(F.array().cast("array<string>"))


#: Settings that change decisions and clusters, but no measure of a pair.
THRESHOLDS = ("pairwise_merge_threshold", "minimum_evidence_families", "cluster_cohesion_threshold", "aggregate_isolated_entities")


def compare(c: Candidates, config: AggregationConfig | None = None) -> Compared:
    """Every two components of each group, by their twins."""
    config = config or AggregationConfig()
    evidence = shared.stored(tokens.evidence(c, config.stop_words), "evidence")
    freq = shared.stored(tokens.frequencies(evidence, "component_id"), "frequencies")
    held = shared.stored(similarity.elements(tokens.sets(c), freq), "elements")
    like = shared.stored(similarity.twins(c.candidates, held, c.outgoing), "twins")
    similar = similarity.similarities(like, held, c.outgoing, config)
    return Compared(evidence, freq, like, shared.stored(similarity.judged(similar, like.where("candidate_id = twin"), config), "judged"))


def judged_by(x: Compared, config: AggregationConfig) -> Compared:
    """``x`` with the decisions of other ``THRESHOLDS``; its measures are kept."""
    similar = x.judged.select(*similarity.SIMILARITY).withColumn("threshold", F.lit(config.pairwise_merge_threshold))
    return replace(x, judged=shared.stored(similarity.judged(similar, x.like.where("candidate_id = twin"), config), "judged"))


def aggregate(c: Candidates, groups: DataFrame, config: AggregationConfig | None = None, compared: Compared | None = None) -> Aggregation:
    """Components of each group merged where they are similar enough."""
    config = config or AggregationConfig()
    compared = compared or compare(c, config)
    freq, judged = compared.frequencies, compared.judged
    clusters = of_twins(compared.like, judged.select("a", "b", (F.col("decision") == "MERGED").alias("merged"), "combined"), config.cluster_cohesion_threshold)

    # clusters are numbered by their first component, with its line as text
    k = c.candidates.select(F.col("candidate_id").alias("component_id"), F.coalesce(F.get("files", F.lit(0)), F.lit("")).alias("f"), F.coalesce("min_line", F.lit((1 << 31) - 1)).alias("l"))
    clusters = clusters.withColumn("sub", F.when(F.col("alone"), F.col("component_id")).otherwise("")).drop("alone")
    first = clusters.join(k, "component_id").groupBy("group_id", "part", "sub").agg(F.min(F.struct("f", "l", "component_id")).alias("m"), F.count("*").alias("component_count"))
    key = F.concat_ws("|", "m.f", F.col("m.l").cast("string"), "m.component_id")
    named = numbering.number_within(first, ["group_id"], [key], "n").withColumn("candidate_id", numbered("AFEC-", F.col("group_id"), F.col("n")))
    members = shared.stored(clusters.join(named.select("group_id", "part", "sub", "candidate_id", "component_count"), ["group_id", "part", "sub"]).select("candidate_id", "group_id", "component_id", "component_count"), "clusters")

    of = members.select(F.col("component_id"), F.col("candidate_id").alias("cluster"))
    far = of.toDF("other_candidate_id", "other_cluster")

    def outside(edges: DataFrame) -> DataFrame:
        """FIL-6: the other end isn't in the cluster."""
        e = edges.join(of, edges.candidate_id == of.component_id).join(far, "other_candidate_id").where("cluster <> other_cluster")
        return e.drop("candidate_id", "component_id").withColumnRenamed("cluster", "candidate_id")

    incoming, outgoing = outside(c.incoming), outside(c.outgoing)
    total = freq.join(of, "component_id").groupBy("cluster", "token").agg(F.sum("n").alias("n"))  # AGG-12
    top = tokens.representative(total, "cluster").toDF("candidate_id", "top")
    member = members.join(c.candidates.drop("group_id").withColumnRenamed("candidate_id", "component_id"), "component_id")
    sums = member.groupBy("candidate_id").agg(
        F.first("group_id").alias("group_id"), F.first("signature").alias("signature"), F.array_sort(F.collect_list("component_id")).alias("component_ids"), F.count("*").alias("component_count"),
        F.sum("entity_count").alias("entity_count"), F.sum("internal_edge_count").alias("internal_edge_count"), F.sum("cross_file_internal_edge_count").alias("cross_file_internal_edge_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
    )
    blocks = c.blocks.join(of, c.blocks.candidate_id == of.component_id).groupBy(F.col("cluster").alias("candidate_id")).agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))
    count = lambda e, n: e.groupBy("candidate_id").agg(F.count("*").alias(n))
    out = sums.join(blocks, "candidate_id", "left").join(top, "candidate_id", "left").join(count(incoming, "incoming_edge_count"), "candidate_id", "left").join(count(outgoing, "outgoing_edge_count"), "candidate_id", "left")
    universe = grouping.universe(groups, "ids")
    kinds = groups.crossJoin(universe).select("group_id", grouping.commonality(F.col("ids"), F.col("universe")).alias("commonality"))
    out = out.join(kinds, "group_id", "left").withColumns({
        "commonality": F.coalesce("commonality", F.lit("VARIABLE_SIGNATURE")), "block_ids": F.coalesce("block_ids", F.array().cast("array<string>")),
        "representative_tokens": F.coalesce(F.transform("top", lambda x: x["token"]), F.array().cast("array<string>")),
        "incoming_edge_count": F.coalesce("incoming_edge_count", F.lit(0)), "outgoing_edge_count": F.coalesce("outgoing_edge_count", F.lit(0)),
    }).drop("top")
    out = out.withColumns({"block_count": F.size("block_ids"), "file_count": F.size("files"), "suggested_label": label(F.col("representative_tokens")), "label_confidence": label_confidence(F.size("representative_tokens"), F.col("component_count"))})
    out = out.withColumn("candidate_confidence", candidate_confidence(F.col("label_confidence"), F.col("component_count"))).withColumn("unresolved_concerns", concerns(F.col("candidate_confidence")))
    out = shared.stored(out, "aggregated")
    lost = out.where("candidate_confidence = 'UNRESOLVED'").select(F.explode("component_ids").alias("candidate_id"))  # FIL-8
    return Aggregation(compared.evidence, freq, compared.like, judged, out, members, c.candidates.join(lost, "candidate_id"), incoming, outgoing)
