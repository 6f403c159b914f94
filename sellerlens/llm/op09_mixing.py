"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Targets: the sources share `share` times all words by weight; a target stops at
`max_epochs` times its source's words and the excess goes to the others by
weight. Capped sources are a prefix of the sources ordered by words per weight,
so one pass of running sums finds them.

Selection: a source first gives whole epochs, floor(target / words) of each
document. The rest of the budget is filled in the order of exponential keys
-ln(u) / quality weight (u from a hash of doc_id), so better documents tend to
come first; a document is taken while the words before it plus half its own are
within the budget, which ends within half a document of the target.

Scale: no window ever holds a source. Keys are cut into ordered buckets of
about BUCKET_ROWS rows, words are summed per (source, bucket) with partial
aggregation, and running sums over buckets find the one bucket of each source
in which the budget ends. A bucket of more than BUCKET_ROWS rows (low weights and equal ids
crowd) is cut again, into SPLIT ranges of the first part of the order in which its rows differ, until it is small or all its
rows are equal. Rows that are equal in every column are one group with a count, and the budget may end within it. The result is one
cut per source, which joins back to the documents; the group at the cut is unfolded from its count, a part of it per task.
The windows over sources run in one task, one row a source.

Defined cases: a null text has size 0 and takes 0 words; the null source is a
source, last in order; documents equal in key are ordered by doc_id (null
first), then by a hash of the text, then of the whole row, and of rows equal in all as many are taken as the budget
holds; a very long text may end a source's budget by up to half its words; an
empty table, or one without words, gives targets 0; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sellerlens.llm.common import WORD, discard, fresh, table, written
from sellerlens.llm.op02_quality_rules import SYMBOLS
from sellerlens.plans.broadcast import broadcast_if_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rows of a bucket of keys, about.
BUCKET_ROWS = 20_000
#: Ranges that a bucket of too many rows is cut into; rows that a task unfolds of one group.
SPLIT, UNFOLD_ROWS = 4_096, 10_000
LEAST_QUALITY = 0.05
#: The order of a source's documents.
ORDER = ("key", "doc_id", "tie", "whole")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Words as a share of words and symbols, LEAST_QUALITY at least: 1 for plain prose."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(LEAST_QUALITY), (size + 1).cast("double") / (size + 1 + symbols).cast("double"))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 52 bits of the md5 of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> the same with target. One row per source."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0.0)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), zero))
    first_free = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True)
    return (
        sources.withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum(F.col("source_size").cast("double")).over(whole) * share)
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("level", level)
        .withColumn("free", first_free.over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("free")), F.col("cap"))
                    .otherwise(F.col("weight") * F.col("free")))
        .select("source", "source_size", "target")
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> list[Column]:
    """source, size, and the order of the documents: key, doc_id, tie (of the text), whole (of the row)."""
    size = size_of(F.col(text))
    key = sampling_key(F.col(doc_id), quality_weight(F.col(text), size))
    return [F.col(source).alias("source"), size.alias("size"), key.alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
            F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"), F.xxhash64(*docs.columns).alias("whole")]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.floor((F.lit(1.0) - F.exp(-key)) * buckets)


def _parts() -> list[Column]:
    """The order as numbers that doubles hold exactly, the first deciding."""
    null_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    longs = [x for c in (null_first, F.col("whole")) for x in (F.shiftright(c, 32), c.bitwiseAND(F.lit((1 << 32) - 1)))]
    texts = [F.conv(F.substring("tie", at, n), 16, 10) for at, n in ((1, 13), (14, 13), (27, 6))]
    parts = [F.col("key"), *[(F.col("doc_id").isNotNull())], *longs[:2], *texts, *longs[2:]]
    return [p.cast("double") for p in parts]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _edge(inside: DataFrame, edges: DataFrame, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of each source's bucket in which its budget ends, and (source, before, rest) with the words before it."""
    rows = inside.select("source", "size", *ORDER, bucket.alias("bucket"))
    by = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("less", F.coalesce(F.sum("words").over(by), F.lit(0)))
    e = broadcast_if_small(edges, 100_000)
    last = sums.join(e, _same(sums, e)).withColumn("at", F.col("before") + F.col("less"))
    last = last.filter((F.col("at") < F.col("rest")) & (F.col("rest") <= F.col("at") + F.col("words")))
    last = written(last.select(sums["source"], F.col("bucket").alias("edge"), F.col("at").alias("before"), "rest"), "mix-edge")
    e = broadcast_if_small(last, 100_000)
    left = rows.join(e.select(F.col("source").alias("of"), "edge"), rows["source"].eqNullSafe(F.col("of")) & (rows["bucket"] == F.col("edge")))
    return written(left.select("source", "size", *ORDER), "mix-inside"), last.select("source", "before", "rest")


def decisions(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, epochs; the order of the row at the cut of the last epoch, how many rows are equal to it (m), and how many of those are taken (c)."""
    buckets = max(16, -(-rows.count() // BUCKET_ROWS))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights, share, max_epochs).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    inside, edges = _edge(rows, plan.select("source", F.lit(0).cast("long").alias("before"), "rest"), bucket_of(F.col("key"), buckets))
    while True:
        each = inside.select("source", *[p.alias(f"p{k}") for k, p in enumerate(_parts())])
        n = len(each.columns) - 1
        stats = each.groupBy("source").agg(F.count("*").alias("n"), *[f(f"p{k}").alias(f"{name}{k}") for k in range(n) for name, f in (("lo", F.min), ("hi", F.max))])
        differ = [F.col(f"lo{k}") < F.col(f"hi{k}") for k in range(n)]
        first = F.coalesce(*[F.when(d, F.struct(F.lit(k).alias("k"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi"))) for k, d in enumerate(differ)])
        stats = written(stats.select(F.col("source").alias("of"), "n", first.alias("cut")), "mix-ranges")
        if not stats.filter((F.col("n") > BUCKET_ROWS) & F.col("cut").isNotNull()).limit(1).count():
            break
        ranged = inside.join(broadcast_if_small(stats, 100_000), F.col("source").eqNullSafe(F.col("of")))
        value = F.element_at(F.array(*_parts()), F.col("cut.k") + 1)
        place = F.floor((value - F.col("cut.lo")) / (F.col("cut.hi") - F.col("cut.lo")) * SPLIT)
        before, (inside, edges) = inside, _edge(ranged, edges, F.coalesce(F.least(place, F.lit(SPLIT - 1)), F.lit(0)))
        discard(before, stats)

    groups = inside.groupBy("source", *ORDER).agg(F.count("*").alias("m"), F.max("size").alias("size"))
    e = broadcast_if_small(edges, 100_000)
    groups = groups.join(e.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    before = F.coalesce(F.sum(F.col("m") * F.col("size")).over(W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") - F.col("before") - before
    taken = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("m")).otherwise(F.lit(0)))
    groups = groups.withColumn("c", F.greatest(F.lit(0), F.least(F.col("m"), taken.cast("long"))))
    stop = F.struct((F.col("c") == F.col("m")).alias("all"), *[F.col(c) for c in ORDER], "m", "c")
    # the first group that isn't taken whole; where there is none, the last one
    cuts = groups.groupBy("source").agg(F.min(stop).alias("first"), F.max(stop).alias("last"))
    cut = F.when(F.col("first.all"), F.col("last")).otherwise(F.col("first"))
    cuts = cuts.select(F.col("source").alias("of"), cut.alias("cut"))
    out = plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    out = written(out.select("source", "source_size", "target", "epochs", F.struct(*[f"cut.{c}" for c in ORDER]).alias("at"),
                             F.col("cut.m").alias("m"), F.col("cut.c").alias("c")), "mix-cuts")
    discard(plan, inside, stats)
    return out


def _copies(rows: DataFrame, cuts: DataFrame, carried: list[str]) -> DataFrame:
    """`carried`, source_size, target, n (how often a row is taken): a row per row.

    The rows equal to a cut are summed up to one with their number, and unfolded from it: c of them are taken once more.
    """
    known = broadcast_if_small(cuts.withColumnRenamed("source", "of"), 100_000)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("row_at", F.struct(*ORDER))
    values = [*carried, "source_size", "target"]
    is_cut = F.col("m").isNotNull() & F.col("row_at").eqNullSafe(F.col("at"))
    once = F.when(F.col("m").isNotNull() & (F.col("row_at") < F.col("at")), 1).otherwise(0)
    others = rows.filter(~is_cut).select(*values, (F.col("epochs") + once).cast("long").alias("n"))
    one = [F.first(v).alias(v) for v in ("epochs", "m", "c")]
    group = rows.filter(is_cut).groupBy("source", "row_at").agg(F.first(F.struct(*values)).alias("one"), *one)
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / UNFOLD_ROWS))
    group = group.withColumn("part", F.explode(parts)).repartition("source", "part")
    place = F.explode(F.sequence(F.col("part") * UNFOLD_ROWS + 1, F.least(F.col("m"), (F.col("part") + 1) * UNFOLD_ROWS)))
    group = group.withColumn("place", place)
    return others.unionByName(group.select("one.*", (F.col("epochs") + F.when(F.col("place") <= F.col("c"), 1).otherwise(0)).cast("long").alias("n")))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = written(docs.select(*measures(docs)), "mix-rows")
    return _copies(rows, decisions(rows), ["doc_id", "size"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    row = fresh("row", docs)
    order = measures(docs, doc_id, source, text)
    cuts = decisions(written(docs.select(*order), "mix-rows"))
    # texts are measured again: a table of them with their measures would hold the whole input once more
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *order)
    taken = _copies(held, cuts, [row]).filter("n > 0")
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(f"{row}.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, coalesce(text, '') as text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
keyed as (
  select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
            / greatest(0.05, (size + 1)::double / (size + 1 + length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')))::double) as k,
         md5(text) as tie
  from sized),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
         2.0::double * source_size as cap from totals),
levels as (
  select *, cap / w as ratio,
    (1.5::double * sum(source_size::double) over ()
       - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double)) as level
  from weighed),
free as (select min_by(level, ratio) as level from levels where ratio > level),
plans as (
  select source, source_size,
         case when free.level is null or ratio <= free.level then cap else w * free.level end as target
  from levels, free),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from plans),
placed as (
  select k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size as rest,
         coalesce(sum(k.size) over (partition by k.source order by k.k, k.doc_id nulls first, k.tie
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from keyed k join budgets b on k.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when rest > 0 and before + size / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from placed
"""
