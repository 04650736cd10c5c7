"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, owned

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
HASH_BITS = 60
LEVEL_BITS = 12


def _hash60(col) -> F.Column:
    """The first 60 bits of md5: DuckDB has the same, so that SQL can check the mix."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Only the table of sources, already added up, is ordered. The targets are min(most_epochs * size, level * weight)
    with the one level at which they add up to all sizes: where resharing the excess by weight ends.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("_rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    s = s.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_w", F.sum("weight").over(everything))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most_epochs).withColumn("_wc", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_w") - F.col("_wc")))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * most_epochs, F.col("_level"))
    s = s.withColumn("_final", F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("source_size") / F.col("weight"), F.col("_rank")))).over(everything))
    return s.select("source", "source_size", F.least(F.col("source_size").cast("double") * most_epochs, F.coalesce("_final", F.lit(0.0)) * F.col("weight")).alias("target"))


@owned("mix")
def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per row of df: size, source_size, target and taken (a multiple of size).

    Every row is taken floor(target / source_size) times whole, and once more if its hash lies below the
    source's threshold. The threshold comes from nested histograms of the hash: words by source and bucket
    of 12 bits; then only the boundary bucket is cut into 4096 again, down to a single hash. At the boundary the
    one hash value is taken if that comes nearer to the target. No rows are sorted; each histogram has at most
    4096 rows for each source, added up before the shuffle, so that a hot source costs what others cost.
    A null source is a source of its own, ordered last; null and empty texts have size 0; rows with the same id
    (or a null id) share a hash and go together. An empty table gives an empty result.
    """
    id_, src = F.col(id_col), F.col(source_col).cast("string")
    sized = materialize(df.select(id_.alias("_id"), src.alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _hash60(id_).alias("h")), "sizes")
    targets = materialize(source_targets(sized, weights, most_epochs), "targets")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(F.lit(0)).cast("long")
    # rest: words still to take below the prefix; 0 where whole epochs meet the target
    bound = targets.select(F.col("source").alias("s"), epochs.alias("epochs"), F.lit(0).cast("long").alias("prefix"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = sized.join(bound, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        hist = inside.groupBy("s", "epochs", "rest", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("s").orderBy("prefix")
        hist = hist.withColumn("cum", F.sum("n").over(upto)).filter(F.col("cum") > F.col("rest"))
        first = hist.groupBy("s").agg(F.min_by(F.struct("epochs", "prefix", "n", (F.col("rest") - F.col("cum") + F.col("n")).alias("rest")), "prefix").alias("x"))
        bound = materialize(first.select("s", "x.*"), "bound").select("s", "epochs", "prefix", "rest", "n")
    # the last prefix is a whole hash: below it all is taken, at it what comes nearer
    bound = bound.select(F.col("s"), F.when(F.col("rest") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    limits = targets.join(bound, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", epochs.alias("epochs"), F.coalesce("below", F.lit(1 << HASH_BITS)).alias("below"), (F.col("target") > epochs * F.col("source_size")).alias("more"))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("more") & (F.col("h") < F.col("below")), 1).otherwise(0))
    return sized.join(limits, F.col("source").eqNullSafe(F.col("s"))).select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), (F.col("epochs") + F.when(F.col("more") & (F.col("h") < F.col("below")), 1).otherwise(0)).alias("copies"))


def oracle(weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> str:
    """The same in DuckDB, by sorting and a recursive resharing."""
    pick = " ".join(f"when {i} then {w}.0" for i, w in enumerate(weights))
    return f"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
 ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
s0 as (select source, sum(size)::double n, row_number() over (order by source nulls last) - 1 k from d group by source),
s as (select *, case k % {len(weights)} {pick} end::double w from s0),
r(step, source, n, w, t, capped) as (
 select 0, source, n, w, 0.0::double, false from s
 union all
 select step + 1, source, n, w, t1, t1 >= {most_epochs} * n from (
  select step, source, n, w, case when capped then {most_epochs} * n else least({most_epochs} * n,
   (sum(n) over () - sum(case when capped then {most_epochs} * n else 0 end) over ()) * w / nullif(sum(case when capped then 0 else w end) over (), 0)) end t1
  from r where step < 60)),
tg as (select source, n, coalesce(t, 0) target from r where step = 60),
e as (select *, case when n > 0 then least(floor(target / n), {most_epochs}) else 0 end k from tg),
x as (select d.*, e.n, e.target, e.k, e.target - e.k * e.n rest, sum(size) over (partition by d.source order by h) cum,
 sum(size) over (partition by d.source, h) own from d join e on d.source is not distinct from e.source),
y as (select *, cum - own + own / 2.0 <= rest and rest > 0 as extra from x)
select doc_id, size, n::bigint source_size, target, (size * (k + case when extra then 1 else 0 end))::bigint taken, (k + case when extra then 1 else 0 end)::bigint copies from y"""
