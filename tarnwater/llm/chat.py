"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation again each time it has grown.  The hash of a
conversation's first k turns is the exclusive or of its turns' hashes, each of
position, role and text (two lanes of 60 bits); it rolls from turn to turn.  A
conversation whose full hash is the hash of a proper prefix of another one is a
snapshot of that one, and an anti-join drops it; of equal conversations the one
of the smallest conv_id stays.  What is left is rendered, ``CHUNK`` turns to a
row, so no conversation is one value of unbounded size.

Texts are hashed where they are read, and only ids, turn numbers and hashes travel
until it is known what is rendered; then the texts travel once.  Positions come
from one total order: the light rows are dealt by ranges of it and numbered, so
turns without number, or all of one number, spread over all tasks.  Where turns
share number and role their texts decide; only these texts are sorted.  Rolling
hashes run over blocks of ``CHUNK`` positions and are shifted by the sums of the
blocks before.  For rendering, texts are dealt by conversation; conversations of
over ``LONG`` turns take a path of their own, dealt by turn and then by chunk.

Defined cases: a conversation's turns are ordered by turn, then role, then text,
nulls first; a null role or text renders as empty, and hashes unlike an empty
one; rows with a null conv_id are one conversation; repeated rows are repeated
turns; an empty table gives an empty one.  Columns other than the four are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwater.llm.common import durable, marked, read_table, release, shuffle_partitions

CHUNK, LONG = 256, 4096
_NULL = -(2**63)
#: What tells the distinct turns of a conversation apart: number, role, and two lanes of the text's hash.
_TURN = ["cid", "turn", "role", "a", "b"]


def _lanes(value: Column) -> list[Column]:
    """Two lanes of 60 bits of a hash of the value; null hashes unlike any text."""
    digest = F.md5(F.coalesce(F.concat(F.lit("="), value), F.lit("-")))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]


def _light(conversations: DataFrame) -> DataFrame:
    """cid, turn, role, a, b, text of every row."""
    a, b = _lanes(F.col("text"))
    return conversations.select(F.coalesce("conv_id", F.lit(_NULL)).alias("cid"), "turn", "role", a.alias("a"), b.alias("b"), "text")


def _in_order(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """``rows`` as a table with the ascending number ``at`` in the order of the keys, nulls first; tied rows may stand in any order."""
    order = [F.asc_nulls_first(k) for k in keys]
    dealt = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    return durable(dealt.withColumn("at", F.monotonically_increasing_id()), "chat-order")


def _ranked(rows: DataFrame) -> DataFrame:
    """The light columns and rank, the place of a text among those of one conversation, turn and role."""
    light = rows.drop("text")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in ("cid", "turn", "role")]
    ties = light.groupBy("cid", "turn", "role").agg(((F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))).alias("tied")).where("tied").drop("tied")
    ties = durable(ties.withColumn("tie", F.xxhash64("cid", "turn", "role")), "chat-ties")
    if ties.isEmpty():
        return light.withColumn("rank", F.lit(0).cast("bigint"))
    texts = marked(rows, F.xxhash64("cid", "turn", "role"), ties.select("tie"), "some").where("some").select(*_TURN, "text").distinct()
    ranks = _in_order(texts, ["cid", "turn", "role", "text"]).drop("text").withColumnRenamed("at", "rank")
    found = light.join(ranks, [*same(light, ranks), light.a == ranks.a, light.b == ranks.b], "left")
    return found.select(*(light[c] for c in _TURN), F.coalesce("rank", F.lit(0)).alias("rank"))


def turns(conversations: DataFrame) -> DataFrame:
    """cid, turn, role, a, b, position (from 0), and x, y: each turn with the rolling hash of the prefix that it ends."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4093))  # equal rows are dealt apart
    placed = _in_order(_ranked(_light(conversations)).withColumn("spread", spread), ["cid", "turn", "role", "rank", "spread"])
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as there were tasks
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = placed.join(F.broadcast(sizes), "part").select(*_TURN, (F.col("ahead") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).alias("at"))
    firsts = placed.groupBy("cid").agg(F.min("at").alias("first"))
    rows = placed.join(firsts, "cid").select(*_TURN, (F.col("at") - F.col("first")).alias("position"))
    told = F.concat_ws("\x1f", F.col("position").cast("string"), F.coalesce(F.concat(F.lit("="), "role"), F.lit("-")), F.col("a").cast("string"), F.col("b").cast("string"))
    x, y = _lanes(told)
    rows = durable(rows.select(*_TURN, "position", F.floor(F.col("position") / CHUNK).alias("block"), x.alias("x"), y.alias("y")), "chat-hashed")
    before = Window.partitionBy("cid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("cid", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select("cid", "block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in "xy"))
    within = Window.partitionBy("cid", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["cid", "block"]).select(*_TURN, "position", *(F.bit_xor(c).over(within).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "xy"))


def maximal(rolled: DataFrame) -> DataFrame:
    """cid and n (its turns) of the conversations that are no proper prefix of another; one of each set of equals."""
    last = rolled.groupBy("cid").agg(F.max("position").alias("position"), F.max_by("x", "position").alias("x"), F.max_by("y", "position").alias("y"))
    last = durable(last.groupBy("position", "x", "y").agg(F.min("cid").alias("cid")), "chat-ends")
    ends = rolled.groupBy("cid").agg(F.max("position").alias("end"))
    inner = rolled.join(ends, "cid").where("position < end").select("position", "x", "y").distinct()
    return last.join(inner, ["position", "x", "y"], "left_anti").select("cid", (F.col("position") + 1).alias("n"))


def _chunks(rows: DataFrame) -> DataFrame:
    """cid, chunk, turns: what stands in each chunk, from places (text null, first and copies) and texts (first null), which meet by the turn."""
    met = rows.groupBy(*_TURN).agg(F.min("text").alias("text"), F.min("first").alias("first"), F.max("copies").alias("copies")).where("first IS NOT NULL")
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    met = met.select("cid", piece.alias("piece"), F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("position"))
    return met.groupBy("cid", F.floor(F.col("position") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, n_turns, rendered: the maximal conversations, ``CHUNK`` turns to a row."""
    rolled = durable(turns(conversations), "chat-rolled")
    kept = durable(maximal(rolled), "chat-kept")
    places = rolled.join(kept, "cid", "left_semi").groupBy(*_TURN).agg(F.min("position").alias("first"), F.count("*").alias("copies"))  # equal turns are neighbours
    places = durable(places, "chat-places")
    release(rolled)
    texts = _light(conversations).select(*_TURN, "text", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("copies"))
    rows = places.select(*_TURN, F.lit(None).cast("string").alias("text"), "first", "copies").union(texts)
    by_cid = lambda x: _chunks(x.repartition(shuffle_partitions(x), "cid"))
    long = kept.where(F.col("n") > LONG).select("cid")
    if long.isEmpty():
        chunks = by_cid(rows)
    else:
        rows = marked(rows, F.col("cid"), long, "long")
        chunks = by_cid(rows.where("NOT long")).union(_chunks(rows.where("long")))
    return chunks.select(
        F.when(F.col("cid") != _NULL, F.col("cid")).alias("conv_id"), "chunk", F.size("turns").cast("bigint").alias("n_turns"), F.array_join("turns.piece", "").alias("rendered")
    )


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY p) AS l FROM t GROUP BY conv_id),
x AS (SELECT DISTINCT l[1:k] AS pre FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
k AS (SELECT conv_id FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pre = m.l))
SELECT t.conv_id, (p - 1) // {CHUNK} AS chunk, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY p) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""

QUERIES = {"op8_chat_snapshots": op8_chat_snapshots}
ORACLES = {"op8_chat_snapshots": ORACLE}
