"""Operator 12: how far sources differ from each other and from their language.

A language keeps the terms that at least ``min_docs`` of its documents hold. A
group (language, source), or a whole language, gives each kept term

    p(n) = 1 + floor(10**9 * (n + prior) / (N + prior * V))

for n occurrences there; N is the sum of n over kept terms, V their number. Two
sources differ by the sum of ``abs(p - q)`` over all kept terms. No table of
sources by terms is built; for sources s and u with z = p(0) the sum is made of

* one-sided terms: ``abs(p_s(n) - z_u)`` for each term of s, priced from the
  histogram of counts of s (how many terms occur n times), and the same for u;
* terms of both: a join of postings on the term corrects what the two prices hold,
  by ``abs(p_s - p_u) - abs(p_s - z_u) - abs(p_u - z_s) + abs(z_s - z_u)``;
* the constant ``(V - V_s - V_u) * abs(z_s - z_u)`` for terms of neither, where V_s
  terms occur in s (terms of both are taken off twice; the correction adds them).

The floor is taken by long division in base 1000, so numbers stay in 64 bits and
exact up to denominators of 9.2e15. Terms are cut and counted in units of texts in
Arrow, one pass for occurrences and documents; all else are DataFrame functions.

Cases: null text, language and source are read as ''; a group without terms is
there with all counts 0; a language without kept terms has pairs of value 0 and
no terms; a source alone in its language has no pairs; repeated rows count each;
ties go to the lesser item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc

#: Bytes between terms once A-Z are lowered: all of ASCII but a-z.
BETWEEN = np.arange(256) < 0x80
BETWEEN[0x61:0x7B] = False
#: Bytes of text in a unit, about.
UNIT = 16 << 20
MIN_DOCS, PRIOR, TOP = 30, 5, 50


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * n / total) by long division in base 1000; n is at most ``total``, which is at least 1."""
    rest, out = n.cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        wide = rest * F.lit(1000)
        rest = wide % total
        out = out * F.lit(1000) + F.call_function("div", wide, total)
    return out + F.lit(1)


def counted(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """(lang, source, term, n, docs) of units of texts: occurrences of each term, and documents with it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def go(batches):
        for b in batches:
            lang, source = (b.column(k).dictionary_encode() for k in (0, 1))
            data, offs = tc.string_buffers(b.column(2))
            data = tc.lower_ascii(data)
            start, end, row = tc.word_bounds(data, offs, BETWEEN)
            bounds = np.append(0, np.cumsum(end - start)).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[~BETWEEN[data]].tobytes())]).dictionary_encode()
            size = max(1, len(words.dictionary))
            # first by document and term, then by group and term
            own, n = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key, at, docs_ = np.unique(group[own // size] * size + own % size, return_inverse=True, return_counts=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, at, n)
            group, term = key // size, words.dictionary.take(pa.array(key % size))
            made = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), term.cast(pa.binary()).cast(pa.string()), pa.array(sums), pa.array(docs_)]
            yield pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "n", "docs"])

    return tc.arrow_batches(rows, go, "lang string, source string, term string, n long, docs long", unit)


def postings(units: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n) of kept terms. Dealt once by language and term, where a frequent term is a row for each unit and source."""
    met = units.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return met.withColumn("held", held).where(F.col("held") >= min_docs).select("lang", "source", "term", "n")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and terms that a source has above its language."""
    kept = tc.stored(postings(counted(docs), min_docs), "postings")
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    of_lang = by_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "support", "v", "total_lang")}
    below = lambda n, v: F.greatest(F.col(n) + F.lit(prior) * F.col(v), F.lit(1).cast("long"))
    groups = groups.withColumns(zero).withColumn("z", share(F.when(F.col("v") > 0, prior).otherwise(0), below("total", "v")))
    groups = tc.stored(groups, "groups")

    known = tc.salted_join(kept, groups, ["lang", "source"], "inner", "term")
    priced = tc.stored(known.withColumn("p", share(F.col("n") + prior, below("total", "v"))).select("lang", "source", "term", "n", "p", "z", "v", "total_lang"), "priced")
    return pairs(priced, groups).unionByName(above(priced, by_lang, below, prior, top))


def pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """Distances of all sources of a language, each from each other."""
    least, most = (f("source", "other") for f in (F.least, F.greatest))
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("support").alias("other_support"))
    histogram = priced.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.first("p").alias("p"))
    one = tc.salted_join(histogram, other, ["lang"], "inner", "n").where("source <> other")
    one = one.select("lang", least.alias("a"), most.alias("b"), (F.col("terms") * F.abs(F.col("p") - F.col("other_z"))).alias("value"))
    x, y = (priced.select("lang", "term", *[F.col(c).alias(f"{k}{c}") for c in ("source", "p", "z")]) for k in ("a_", "b_"))
    gap = lambda i, j: F.abs(F.col(f"a_{i}") - F.col(f"b_{j}"))
    both = x.join(y, ["lang", "term"]).where("a_source < b_source")
    both = both.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), (gap("p", "p") - gap("p", "z") - gap("z", "p") + gap("z", "z")).alias("value"))
    rest = tc.salted_join(groups, other, ["lang"], "inner", "source").where("source < other")
    neither = (F.col("v") - F.col("support") - F.col("other_support")) * F.abs(F.col("z") - F.col("other_z"))
    rest = rest.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), neither.alias("value"))
    added = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (one, both, rest)]
    total = added[0].union(added[1]).union(added[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    each = total.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def above(priced: DataFrame, by_lang: DataFrame, below, prior: int, top: int) -> DataFrame:
    """The ``top`` terms of each source that it has most above its language; a task keeps no more of a source before the shuffle."""
    q = share(F.col("n_lang") + prior, below("total_lang", "v"))
    each = priced.join(by_lang, ["lang", "term"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top)


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(tc.documents(spark, sf_dir))


QUERIES = {"op12_source_divergence_audit": op12_source_divergence_audit}
ORACLE_SQL = {
    "op12_source_divergence_audit": r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') as w from documents),
t as (select k, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct k) >= 30),
groups as (select distinct lang, source from d),
v as (select lang, count(kept.term)::hugeint as v from (select distinct lang from d) left join kept using (lang) group by lang),
posted as (select lang, source, term, count(*)::hugeint as n from t join kept using (lang, term) group by all),
full_ as (select g.lang, g.source, kept.term, coalesce(n, 0) as n from groups g join kept on g.lang = kept.lang left join posted p on p.lang = g.lang and p.source = g.source and p.term = kept.term),
priced as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source)::hugeint + 5 * v) as p from full_ join v using (lang)),
whole as (select lang, term, sum(n)::hugeint as n from full_ group by lang, term),
lp as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang)::hugeint + 5 * v) as q from whole join v using (lang)),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, 0::hugeint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
         union all select a.lang, a.source, 'pair', b.source, abs(a.p - b.p) from priced a join priced b on a.lang = b.lang and a.term = b.term and a.source <> b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from priced join lp using (lang, term) where n > 0 and p > q),
both_ as (select lang, source, part, item, sum(value)::bigint as value from (select * from pair union all select * from term) group by all)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_
qualify part = 'pair' or rank <= 50"""
}
