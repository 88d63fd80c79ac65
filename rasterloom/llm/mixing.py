"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents form blocks of BLOCK. Its target weight is quantised to units, the blocks it gets in a period of
PERIOD slots. Block j (from 1) of a source with u units is released at floor((j-1) * PERIOD / u) and due at
ceil(j * PERIOD / u); in each slot the released block with the earliest deadline runs. Weights add up to one, so every
deadline is met, and after t slots each source has had t * weight blocks to within less than one. The schedule of one
period repeats; a source that has run out leaves its slots empty. All documents are placed, none twice. As every source
gets one slot at least, its share may be off its target by as much as sources / PERIOD.

The schedule is one fold over the slots of a period. Sources of equal units have equal windows and so run in turn: the fold
keeps one counter for each distinct number of units, of which there are fewer than sqrt(2 * period), whatever the number of
sources. The schedule has `period` rows, max(PERIOD, 4 * sources), so that every source has a slot; it is broadcast only while
that is below BROADCAST. A document's place in its source is its rank by hashed id: rows that share an id are counted first,
then counts are summed in small buckets of (source, hash prefix), over the buckets of a longer prefix, and over those
prefixes, so a source with most of the rows is spread over many tasks.

Defined cases: a null source is a source of its own; a null doc_id takes part and sorts first; rows that share a doc_id each
have a place; a source without a given weight, or with none above zero, weighs nothing and gets the one slot; text isn't read; an empty
table gives no rows; further columns are ignored, and `mixed` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK, PERIOD, EXPONENT = 32, 1000, 0.5
#: Documents of a bucket, about.
BUCKET = 512
#: Rows of a schedule that is broadcast; slots folded before they are added to the others; copies of an id given at once.
BROADCAST, FOLDED, AT_ONCE = 100_000, 256, 4096


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")


def units(sizes: DataFrame, weights: DataFrame | None = None, period: int = PERIOD) -> DataFrame:
    """key and u: each source's whole slots in a period, by largest remainder, one at least.

    sizes: key and n. weights: key and weight; without it a source weighs the square root of its documents.
    """
    one = Window.partitionBy()  # a row for each source
    if weights is not None:
        given = weights.groupBy("key").agg(F.sum("weight").cast("double").alias("weight"))
        rows = sizes.join(given, "key", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
        rows = rows.withColumn("weight", F.when(F.sum("weight").over(one) > 0, F.col("weight")).otherwise(1.0))
    else:
        rows = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(EXPONENT)))
    rows = rows.withColumn("exact", (period - F.count("*").over(one)) * F.col("weight") / F.sum("weight").over(one)).withColumn("floor", F.floor("exact").cast("int"))
    left = period - F.count("*").over(one) - F.sum("floor").over(one)
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), "key"))
    return rows.select("key", (1 + F.col("floor") + (nth <= left).cast("int")).cast("int").alias("u"))


def schedule(shares: DataFrame, period: int = PERIOD) -> DataFrame:
    """key, u, nth and slot: when the nth block (from 0) of a source's period runs."""
    numbered = shares.withColumn("i", F.row_number().over(Window.orderBy("key")))
    alike = numbered.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("members"))
    listed = alike.agg(F.array_sort(F.collect_list(F.struct("u", "members"))).alias("classes"))
    kinds = "array<struct<class:int,n:int,slot:int>>"

    def step(state: Column, t: Column) -> Column:
        def job(c: Column, k: Column) -> Column:
            n, m = F.element_at(state["done"], k + 1), F.size(c["members"])
            j = F.floor(n / m).cast("int")
            due = F.ceil((j + 1) * F.lit(period) / c["u"]).cast("int")
            ready = (j < c["u"]) & (F.floor(j * F.lit(period) / c["u"]) <= t)
            return F.struct(F.when(ready, due).otherwise(F.lit(2**31 - 1)).alias("due"), F.element_at(c["members"], n % m + 1)["i"].alias("i"), k.alias("class"), n.alias("n"))

        next_ = F.array_min(F.transform(F.col("classes"), job))
        return F.transform(F.array(next_), lambda p: F.struct(
            F.transform(state["done"], lambda n, k: n + (k == p["class"]).cast("int")).alias("done"), F.concat(state["picks"], F.array(F.struct(p["class"].alias("class"), p["n"].alias("n"), t.alias("slot")))).alias("picks")))[0]

    def some(state: Column, first: Column) -> Column:
        """State after FOLDED slots: picks are gathered apart and then added, so a long period isn't copied at each slot."""
        begun = F.struct(state["done"].alias("done"), F.array().cast(kinds).alias("picks"))
        slots = F.sequence(first, F.least(first + (FOLDED - 1), F.lit(period - 1)))
        return F.aggregate(slots, begun, step, lambda s: F.struct(s["done"].alias("done"), F.concat(state["picks"], s["picks"]).alias("picks")))

    start = F.struct(F.transform("classes", lambda s: F.lit(0)).alias("done"), F.array().cast(kinds).alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1), F.lit(FOLDED)), start, some, lambda s: s["picks"])
    run = listed.filter(F.size("classes") > 0).select("classes", F.explode(picks).alias("p")).select(F.element_at("classes", F.col("p.class") + 1).alias("c"), "p")
    m = F.size("c.members")
    return run.select(F.element_at("c.members", F.col("p.n") % m + 1)["key"].alias("key"), F.col("c.u").alias("u"), F.floor(F.col("p.n") / m).cast("int").alias("nth"), F.col("p.slot").alias("slot"))


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, source, doc_id, h) with `rank`, from 0 in their key by (h, doc_id). most: rows of the largest key."""
    digits = 0
    while most > BUCKET * 16**digits:
        digits += 1
    distinct = rows.groupBy("key", "source", "h", "doc_id").agg(F.count("*").alias("c")).withColumn("bucket", F.substring("h", 1, digits)).withColumn("prefix", F.substring("h", 1, digits // 2))
    buckets = distinct.groupBy("key", "prefix", "bucket").agg(F.sum("c").alias("c"))
    prefixes = buckets.groupBy("key", "prefix").agg(F.sum("c").alias("c"))
    upto = lambda over, at: F.sum("c").over(Window.partitionBy(*over).orderBy(at)) - F.col("c")
    before = buckets.select("key", "prefix", "bucket", upto(["key", "prefix"], "bucket").alias("in_prefix")).join(prefixes.select("key", "prefix", upto(["key"], "prefix").alias("ahead")), ["key", "prefix"])
    place = Window.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = distinct.withColumn("local", F.sum("c").over(place) - F.col("c"))
    first = local.join(before.select("key", "bucket", (F.col("in_prefix") + F.col("ahead")).alias("before")), ["key", "bucket"]).withColumn("first", F.col("before") + F.col("local"))
    parts = first.select("key", "source", "doc_id", "c", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(AT_ONCE).cast("long"))).alias("part"))
    copies = F.sequence(F.col("part"), F.least(F.col("part") + (AT_ONCE - 1), F.col("c") - 1))
    return parts.select("key", "source", "doc_id", "first", F.explode(copies).alias("copy")).select("key", "source", "doc_id", (F.col("first") + F.col("copy")).alias("rank"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """doc_id, source, block, place (in the block) and slot of every row; ordered by slot and place it is the mixture."""
    rows = docs.select("doc_id", "source", _key(), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    sizes = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")), "sources")
    most, sources = sizes.agg(F.max("n"), F.count("*")).first()
    period = max(period, 4 * sources)
    plan = common.stored(schedule(units(sizes, weights, period), period), "schedule")
    send = F.broadcast if period <= BROADCAST else lambda df: df
    rank = F.col("rank")
    blocks = ranked(rows, most or 0).withColumn("block", F.floor(rank / block).cast("long")).withColumn("place", (rank % block).cast("int"))
    units_of = send(plan.select("key", "u").distinct())
    slots = send(plan.select("key", "nth", F.col("slot").alias("in_period")))
    placed = blocks.join(units_of, "key").withColumn("nth", (F.col("block") % F.col("u")).cast("int")).join(slots, ["key", "nth"])
    return placed.select("doc_id", "source", "block", "place", (F.floor(F.col("block") / F.col("u")) * period + F.col("in_period")).cast("long").alias("slot"), (F.col("u") / F.lit(float(period))).alias("weight"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs with their columns, in the order of the mixture: files and rows follow slots. Rows that share a
    doc_id follow the first of its places."""
    at, key = common.fresh(docs, "at"), common.fresh(docs, "key")
    order = mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "place")).alias(at))
    placed = docs.join(order, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    return placed.repartitionByRange(common.partitions(docs.sparkSession), at).sortWithinPartitions(at).drop(at)


def query(spark, sf_dir):
    return mix(common.documents(spark, sf_dir))


ORACLE_SQL = f"""
with recursive d as (
  select doc_id, source, coalesce('=' || source, '') as key, md5(coalesce(doc_id::varchar, '')) as h from documents),
n as (select key, count(*) as n from d group by key),
p as (select greatest({PERIOD}, 4 * count(*)) as period, count(*) as m, sum(sqrt(n)) as total from n),
e as (select key, (period - m) * sqrt(n) / total as exact, period, m from n, p),
f as (select *, floor(exact) as fl, row_number() over (order by round(exact - floor(exact), 9) desc, key) as nth, period - m - sum(floor(exact)) over () as rest from e),
u as (select key, (1 + fl + (nth <= rest)::int)::int as u, period, row_number() over (order by key) as i from f),
l as (select list(u order by i) as us, any_value(period) as period from u),
s as (
  select -1 as slot, 0 as i, 0 as nth, list_transform(us, lambda x: 0) as done, us, period from l where len(us) > 0
  union all
  select slot + 1, i, done[i] , list_transform(done, lambda x, k: x + (k = i)::int), us, period from (
    select *, list_min(list_transform(us, lambda x, k: {{'due': case when done[k] < x and floor(done[k] * period / x) <= slot + 1 then ceil((done[k] + 1) * period / x) else 2147483647 end, 'i': k}})).i as i
    from (select slot, nth, done, us, period from s)) where slot + 1 < period),
r as (select *, row_number() over (partition by key order by h, doc_id nulls first) - 1 as rank from d)
select doc_id, source, (rank // {BLOCK})::bigint as block, (rank % {BLOCK})::int as place,
       (((rank // {BLOCK}) // u.u) * u.period + s.slot)::bigint as slot, u.u / u.period::double as weight
from r join u on r.key = u.key join s on s.i = u.i and s.slot >= 0 and s.nth = (rank // {BLOCK}) % u.u
"""
