"""Mixing sources to target weights.

A source's token share ``p`` becomes the weight ``p**a / sum(p**a)``.  The
exponent ``a`` is bisected in [0, 1]: the smallest (most even) one for which the
weights' entropy does not exceed the target, which lies the part ``EVENNESS`` of
the way from the natural entropy to that of equal weights, and no source is
repeated more than ``REPEATS`` times.  With a budget of all the corpus' tokens a
source of budget ``b`` and ``t`` tokens gives ``b div t`` whole epochs and a part
of one more.  An epoch is a permutation of the source's ``BLOCKS`` blocks (of
documents by hash); the last epoch takes whole blocks in its order while they
fit the rest of the budget, and of the block that no longer fits whole, documents
in hash order while they fit.

Nothing sorts a whole source: cumulative sums run over a source's blocks, then
over the ``PARTS`` parts of its one cut block, then over the documents of its one
cut part, so a source with a third of all rows costs no task more than another.
The bisection runs on one row that holds a number for each source.

Defined cases: a null text has no tokens; a null source is a source without
name; sources without tokens have weight 0 and pass once; repeated rows are drawn
together; an empty table gives an empty one.  Only doc_id, text and source are
read by :func:`draws`; :func:`mix` returns all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwater.llm.common import durable, read_table

EVENNESS, REPEATS = 0.5, 4
BLOCKS, PARTS, STEPS = 64, 4096, 40

_COLUMNS = """coalesce(source, '') AS _src,
  cast(regexp_count(coalesce(text, ''), '[^\\\\x09-\\\\x0D ]+') AS bigint) AS _tokens,
  cast(conv(substr(md5(coalesce(cast(doc_id AS string), '')), 1, 12), 16, 10) AS bigint) AS _key"""

_BISECT = f"""aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) ->
  transform(
    transform(array((s.lo + s.hi) / 2), m -> named_struct('m', m, 'z', aggregate(p, 0D, (a, x) -> a + power(x, m)), 'l', aggregate(p, 0D, (a, x) -> a + power(x, m) * ln(x)))),
    t -> if(ln(t.z) - t.m * t.l / t.z <= target AND power(array_min(p), t.m - 1) / t.z <= {{repeats}},
            named_struct('lo', s.lo, 'hi', t.m), named_struct('lo', t.m, 'hi', s.hi)))[0]).hi"""


def weights(sources: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> DataFrame:
    """_src, total, weight, budget of each source from _src and total (its tokens)."""
    row = sources.where("total > 0").agg(F.array_sort(F.collect_list("total")).alias("totals"), F.sum("total").cast("double").alias("sum"))
    row = row.withColumn("p", F.expr("transform(totals, x -> x / sum)"))
    natural = "aggregate(p, 0D, (a, x) -> a - x * ln(x))"
    row = row.withColumn("target", F.expr(f"{natural} + {evenness}D * (ln(size(p)) - {natural})"))
    row = row.withColumn("exponent", F.expr(_BISECT.format(repeats=f"{float(repeats)}D")))
    row = row.select("exponent", "sum", F.expr("aggregate(p, 0D, (a, x) -> a + power(x, exponent))").alias("z"))
    weight = F.when(F.col("total") > 0, F.round(F.pow(F.col("total") / F.col("sum"), F.col("exponent")) / F.col("z"), 9)).otherwise(0.0)
    weighed = sources.join(F.broadcast(row.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).withColumn("weight", weight)
    return weighed.select("_src", "total", "weight", F.floor(F.col("weight") * F.col("sum")).alias("budget"))


def schedule(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> DataFrame:
    """What each block of each source gives to each epoch.

    _src, _block, epoch, block_rank (its place in the epoch), whole, and where a
    block is cut: cut_part, cut_key (parts before it are in, and in it the keys
    up to the cut).  ``docs`` has _src, _tokens and _key.
    """
    placed = docs.select("_src", "_tokens", (F.col("_key") % BLOCKS).alias("_block"), F.expr(f"_key div {BLOCKS} % {PARTS}").alias("_part"), "_key")
    sums = durable(placed.groupBy("_src", "_block").agg(F.sum("_tokens").alias("tokens")), "mix-blocks")
    plan = weights(sums.groupBy("_src").agg(F.sum("tokens").alias("total")), evenness, repeats)
    plan = plan.withColumn("full", F.expr("if(total > 0, budget div total, 0)")).withColumn("rest", F.expr("if(total > 0, budget % total, 0)"))
    turn = F.md5(F.concat_ws("|", "_src", F.col("epoch").cast("string"), F.col("_block").cast("string")))
    epochs = sums.join(plan, "_src").withColumn("epoch", F.explode(F.expr("sequence(0L, full)")))
    order = Window.partitionBy("_src", "epoch").orderBy(turn, "_block")
    epochs = epochs.withColumn("block_rank", F.row_number().over(order) - 1).withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    epochs = epochs.withColumn("rest", F.when(F.col("epoch") == F.col("full"), F.col("rest")).otherwise(F.col("total")) - F.col("end") + F.col("tokens"))
    epochs = durable(epochs.where("rest >= 0").select("_src", "_block", "epoch", "block_rank", "weight", "rest", (F.col("tokens") <= F.col("rest")).alias("whole")), "mix-epochs")
    cut = epochs.where("NOT whole").select("_src", "_block", "rest")
    parts = durable(placed.join(cut, ["_src", "_block"]).groupBy("_src", "_block", "_part", "rest").agg(F.sum("_tokens").alias("tokens")), "mix-parts")
    upto = Window.partitionBy("_src", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum("tokens").over(upto)).withColumn("left", F.col("rest") - F.col("end") + F.col("tokens"))
    parts = parts.where("left >= 0 AND tokens > left").groupBy("_src", "_block").agg(F.min("_part").alias("cut_part"), F.min_by("left", "_part").alias("left"))
    inside = placed.join(parts.withColumnRenamed("cut_part", "_part"), ["_src", "_block", "_part"])
    keys = Window.partitionBy("_src", "_block").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.sum("_tokens").over(keys)).where("end <= left").groupBy("_src", "_block").agg(F.max("_key").alias("cut_key"))
    return durable(epochs.drop("rest").join(parts.drop("left"), ["_src", "_block"], "left").join(inside, ["_src", "_block"], "left"), "mix-schedule")


def _drawn(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    part = F.expr(f"_key div {BLOCKS} % {PARTS}")
    rows = docs.withColumn("_block", F.col("_key") % BLOCKS).join(blocks, ["_src", "_block"])
    return rows.where(F.col("whole") | (part < F.col("cut_part")) | ((part == F.col("cut_part")) & (F.col("_key") <= F.col("cut_key"))))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "source", *[c.strip() for c in _COLUMNS.split(",\n")])


def draws(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_rank, weight of each draw of a document."""
    rows = durable(_measured(docs), "mix-rows")
    drawn = _drawn(rows, schedule(rows, evenness, repeats))
    return drawn.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), "epoch", F.col("_block").alias("block"), F.col("block_rank").cast("bigint"), "weight")


def mix(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> DataFrame:
    """The drawn documents with all columns of ``docs``, a row for each draw."""
    rows = durable(_measured(docs), "mix-rows")
    blocks = schedule(rows, evenness, repeats)
    source, _, key = [c.strip() for c in _COLUMNS.split(",\n")]
    packed = docs.select(F.struct("*").alias("_row"), F.expr(source), F.expr(key))
    return _drawn(packed, blocks).select("_row.*")


def op3_mixing_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D ]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS k
  FROM documents),
s AS (SELECT src, sum(n_tokens)::BIGINT AS total FROM d GROUP BY src),
p AS (SELECT total / (SELECT sum(total) FROM s)::DOUBLE AS p FROM s WHERE total > 0),
n AS (SELECT -sum(p * ln(p)) AS h, ln(count(*)) AS top, min(p) AS least FROM p),
b(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT b.i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM b, LATERAL (SELECT (lo + hi) / 2 AS m) x,
       LATERAL (SELECT ln(z) - m * l / z <= (SELECT h + {EVENNESS} * (top - h) FROM n) AND pow((SELECT least FROM n), m - 1) / z <= {REPEATS} AS ok
                FROM (SELECT sum(pow(p, m)) AS z, sum(pow(p, m) * ln(p)) AS l FROM p)) y
  WHERE b.i < {STEPS}),
a AS (SELECT hi AS e, (SELECT sum(pow(p, hi)) FROM p) AS z FROM b WHERE i = {STEPS}),
w AS (SELECT src, total, CASE WHEN total > 0 THEN round(pow(total / (SELECT sum(total) FROM s)::DOUBLE, e) / z, 9) ELSE 0 END AS weight FROM s, a),
q AS (SELECT *, CASE WHEN total > 0 THEN floor(weight * (SELECT sum(total) FROM s)::DOUBLE)::BIGINT // total ELSE 0 END AS f,
             CASE WHEN total > 0 THEN floor(weight * (SELECT sum(total) FROM s)::DOUBLE)::BIGINT % total ELSE 0 END AS rest FROM w),
e AS (SELECT d.*, weight, total, f, rest, k % {BLOCKS} AS block, unnest(range(f + 1)) AS epoch FROM d JOIN q USING (src)),
o AS (SELECT *, md5(src || '|' || epoch || '|' || block) AS turn FROM e),
c AS (SELECT *, dense_rank() OVER (PARTITION BY src, epoch ORDER BY turn, block) - 1 AS block_rank,
             sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY turn, block, k // {BLOCKS} % {PARTS}, k) AS upto FROM o)
SELECT doc_id, source, n_tokens, epoch, block, block_rank, weight FROM c WHERE epoch < f OR upto <= rest
"""

QUERIES = {"op3_mixing_temperature": op3_mixing_temperature}
ORACLES = {"op3_mixing_temperature": ORACLE}
