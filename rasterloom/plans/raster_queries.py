"""Queries over the derived pixels, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions import colour as C
from rasterloom.operators import clustering, cuts, export, grid, histogram, palette, pitch, ramps, stencil
from rasterloom.sources.pixels import PIXELS_SQL, SIDE, derived_pixels
from rasterloom.sources.scratch import settled

PITCH = 4
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _px(sql: str) -> str:
    return f"with {PIXELS_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sizes(px):
    return px.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# ---- counts

@query("px_histogram", _px("select frame, r, g, b, count(*) as n, min(y * 32 + x) as first_pos from px where a > 0 group by all"))
def px_histogram(spark, d):
    return histogram.histogram(derived_pixels(spark, d), SIDE)


@query("px_collect_histogram", _px("select r * 65536 + g * 256 + b as key, r, g, b, count(*) as w, count(distinct frame) as frames, (select bool_or(a < 255) from px) as alpha_present from px where a > 0 group by all"))
def px_collect_histogram(spark, d):
    return histogram.sprite_histogram(derived_pixels(spark, d))


@query("px_colour_count", _px("select frame, count(distinct (r, g, b)) as colours from px where a > 0 group by frame"))
def px_colour_count(spark, d):
    return histogram.colour_count(derived_pixels(spark, d))


@query("px_luma", _px("select frame, y, x, round(case when a = 0 then 0.0::double else 0.299::double * r + 0.587::double * g + 0.114::double * b end, 6) as luma from px"))
def px_luma(spark, d):
    return derived_pixels(spark, d).select("frame", "y", "x", F.round(histogram.luma(), 6).alias("luma"))


PROFILES_SQL = """, v as (select frame, y, x, case when a = 0 then 0.0::double else 0.299::double * r + 0.587::double * g + 0.114::double * b end as v from px),
pr as (
  select frame, axis, pos, sum(coalesce(d, 0)) as value from (
    select frame, 'x' as axis, x as pos, abs(lead(v) over w - lag(v) over w) as d from v window w as (partition by frame, y order by x)
    union all
    select frame, 'y', y, abs(lead(v) over w - lag(v) over w) from v window w as (partition by frame, x order by y)) group by all)"""


@query("px_profiles", _px(PROFILES_SQL + " select frame, axis, pos, round(value, 6) as value from pr"))
def px_profiles(spark, d):
    return _rounded(histogram.profiles(derived_pixels(spark, d)))


RUNS_SQL = """, m as (
  select frame, 0 as axis, y as line, x as place, a, case when (r, g, b, a) is distinct from lag((r, g, b, a)) over (partition by frame, y order by x) then 1 else 0 end as new from px
  union all
  select frame, 1, x, y, a, case when (r, g, b, a) is distinct from lag((r, g, b, a)) over (partition by frame, x order by y) then 1 else 0 end from px),
i as (select *, sum(new) over (partition by frame, axis, line order by place) as island from m),
runs as (select frame, len, count(*) as cnt from (select frame, count(*) as len from i where a > 0 group by frame, axis, line, island) group by all)"""


@query("px_runs", _px(RUNS_SQL + " select * from runs"))
def px_runs(spark, d):
    return histogram.runs(derived_pixels(spark, d))


# ---- pitch

SCORES_SQL = RUNS_SQL + """, sc as (
  select frame, candidate, sum(cnt * candidate * (1 - err / tol) / multiple) as score, sum(cnt)::bigint as support from (
    select frame, candidate, cnt, multiple, abs(len - candidate * multiple)::double as err, greatest(candidate * 0.35::double, 1.0::double) as tol from (
      select c.frame, candidate, len, cnt, greatest(round(len / candidate::double), 1)::double as multiple
      from (select frame, unnest(range(2, max(len) + 1)) as candidate from runs group by frame) c join runs r on r.frame = c.frame and len >= candidate))
  where err <= tol group by all)"""


@query("px_pitch_scores", _px(SCORES_SQL + " select frame, candidate, round(score, 6) as score, support from sc"))
def px_pitch_scores(spark, d):
    return _rounded(pitch.scores(histogram.runs(derived_pixels(spark, d))))


RUN_PITCH_SQL = SCORES_SQL + """, rk as (select *, row_number() over (partition by frame order by round(score, 6) desc, candidate desc) as k from sc),
b as (select frame, candidate, score, support, coalesce((select q.score from rk q where q.frame = rk.frame and q.k = 2), 0.0) as second from rk where k = 1),
t as (select frame, sum(cnt) as total, coalesce(sum(cnt) filter (len = 1), 0) as units from runs group by frame),
rf as (
  select b.frame, sum(unit * cnt) / sum(cnt) as refined from b join (select frame, cnt, len from runs) r on r.frame = b.frame,
  lateral (select len / greatest(round(len / candidate::double), 1)::double as unit) u where abs(unit - candidate) <= greatest(candidate * 0.35::double, 1.0::double) group by b.frame),
rp as (
  select frame, candidate::double as base_pitch, coalesce(refined, candidate) as pitch, support / total::double as support_ratio,
         case when second <= 0 then 'inf'::double else score / second end as score_margin, units / total::double as unit_run_ratio
  from b join t using (frame) left join rf using (frame)),
rpc as (select *, support_ratio >= 0.55 and unit_run_ratio <= 0.45 and score_margin >= 1.15 as clear from rp)"""


@query("px_pitch_top2", _px(RUN_PITCH_SQL + " select frame, base_pitch, round(pitch, 6) as pitch, round(support_ratio, 6) as support_ratio, round(score_margin, 6) as score_margin, round(unit_run_ratio, 6) as unit_run_ratio, clear from rpc"))
def px_pitch_top2(spark, d):
    return _rounded(pitch.from_runs(settled(histogram.runs(derived_pixels(spark, d)))))


@query("px_pitch_refine", _px(RUN_PITCH_SQL + " select frame, round(pitch, 6) as refined from rpc"))
def px_pitch_refine(spark, d):
    runs = settled(histogram.runs(derived_pixels(spark, d)))
    return _rounded(pitch.refine(pitch.from_runs(runs).select("frame", "base_pitch"), runs))


def _correlation_sql(source: str, keys: str, most: int) -> str:
    """ac: keys, period, r for source (keys, pos from 0, v, n)."""
    return f"""ac as (
  select {keys}, period, case when pp <= 0 or qq <= 0 then 0.0 else pq / sqrt(pp * qq) end as r from (
    select {keys}, period, sum((v - mp) * (w - mq)) as pq, sum((v - mp) * (v - mp)) as pp, sum((w - mq) * (w - mq)) as qq from (
      select *, avg(v) over (partition by {keys}, period) as mp, avg(w) over (partition by {keys}, period) as mq from (
        select {', '.join('p.' + k.strip() for k in keys.split(','))}, period, p.v, q.v as w
        from {source} p, (select unnest(range(2, {most} + 1)) as period), {source} q
        where {' and '.join(f'p.{k.strip()} = q.{k.strip()}' for k in keys.split(','))} and q.pos = p.pos + period and p.n - period >= 2)) group by all))"""


EMBEDDED_SQL = "with e as (select vec_id, unnest(range(len(embedding))) as pos, unnest(embedding)::double as v, len(embedding) as n from embeddings), " + _correlation_sql("e", "vec_id", 32)


def _embedded(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("values"))


@query("profile_autocorr", EMBEDDED_SQL + " select vec_id, period::int as period, round(r, 6) as r from ac")
def profile_autocorr(spark, d):
    return _rounded(pitch.autocorrelation(_embedded(spark, d), ["vec_id"], pitch.PROFILE_MOST))


def _best_sql(keys: str) -> str:
    on = " and ".join(f"m.{k.strip()} = ac.{k.strip()}" for k in keys.split(","))
    return f"""bp as (
  select {', '.join('m.' + k.strip() for k in keys.split(','))}, m.best, m.r as score, min(ac.period) filter (ac.period < m.best and ac.r >= m.r * 0.97 and abs(m.best / ac.period::double - round(m.best / ac.period::double)) <= 0.1) as sub
  from (select {keys}, arg_max(period, (round(r, 6), -period)) as best, max(r) as r from ac group by {keys}) m join ac on {on} group by all)"""


@query("profile_best_period", EMBEDDED_SQL + ", " + _best_sql("vec_id") + " select vec_id, (case when score < 0.35 then 1 else coalesce(sub, best) end)::int as base_pitch, score >= 0.35 as clear, round(score, 6) as score from bp")
def profile_best_period(spark, d):
    return _rounded(pitch.best_period(pitch.autocorrelation(_embedded(spark, d), ["vec_id"], pitch.PROFILE_MOST), ["vec_id"]))


PROFILE_PITCH_SQL = PROFILES_SQL + ", ps as (select frame, axis, pos, value as v, 32 as n from pr), " + _correlation_sql("ps", "frame, axis", 16).replace("ac as", "ac2 as") + ", ac as (select frame, period, sum(r) / 2.0 as r from ac2 group by all), " + _best_sql("frame") + """,
pp as (select frame, (case when score < 0.35 then 1 else coalesce(sub, best) end)::int as base_pitch, score >= 0.35 as clear, score from bp)"""


@query("px_profile_pitch", _px(PROFILE_PITCH_SQL + " select frame, base_pitch, clear, round(score, 6) as score from pp"))
def px_profile_pitch(spark, d):
    return _rounded(pitch.from_profiles(histogram.profiles(derived_pixels(spark, d))))


COMBINED_SQL = RUN_PITCH_SQL + PROFILE_PITCH_SQL + """, j as (
  select r.frame, r.base_pitch as rb, r.pitch as rpitch, r.clear as rc, p.base_pitch::double as pb, p.clear as pc, p.score as ps,
         32 % r.base_pitch = 0 as rdiv, 32 % p.base_pitch = 0 as pdiv, p.base_pitch / r.base_pitch as ratio from rpc r join pp p using (frame)),
k as (select *, case when not pc then 'runs' when rc and rdiv and (not pdiv or rb < pb) then 'runs divide' when rc and abs(rb - pb) <= 1 then 'agree' when not rc and pdiv then 'profile divides'
             when rc and abs(ratio - round(ratio)) <= 0.15 and ratio >= 1.5 then 'harmonic' else 'profile' end as rule from j),
cm as (
  select frame, rule, case when rule in ('runs', 'harmonic', 'runs divide') then rb else pb end as base_pitch,
         case when rule in ('runs', 'harmonic') then rpitch when rule = 'runs divide' then rb when rule = 'agree' then least(greatest(rpitch, pb - 0.5), pb + 0.5) else pb end as pitch,
         case when rule = 'runs' then rc when rule = 'profile' then pdiv else true end as clear, pc as profile_clear, ps as profile_score from k)"""


def _combined(px):
    """Runs and profiles are a few numbers for each frame; settled, as several branches use them."""
    return settled(pitch.combine(settled(pitch.from_runs(settled(histogram.runs(px)))), settled(pitch.from_profiles(settled(histogram.profiles(px)))), _sizes(px)))


@query("px_pitch_combined", _px(COMBINED_SQL + " select frame, rule, base_pitch, round(pitch, 6) as pitch, clear, profile_clear, round(profile_score, 6) as profile_score from cm"))
def px_pitch_combined(spark, d):
    return _rounded(_combined(derived_pixels(spark, d)))


@query("px_pitch_common", _px(COMBINED_SQL + """, c as (select * from cm where clear and base_pitch >= 2),
md as (select (list(base_pitch order by base_pitch))[((count(*) + 1) // 2)::int] as base_pitch, (list(pitch order by pitch))[((count(*) + 1) // 2)::int] as pitch from c)
select base_pitch, round(pitch, 6) as pitch, case when pitch is null then 'no clear pitch' when (select max(pitch) from cm where clear) / pitch > 1.8 or pitch / (select min(pitch) from cm where clear) > 1.8 then 'frames disagree' else 'ok' end as status from md"""))
def px_pitch_common(spark, d):
    return _rounded(pitch.common(_combined(derived_pixels(spark, d))))


# ---- grid

@query("px_transitions", _px("""select distinct frame, axis, boundary from (
  select frame, 'x' as axis, x + 1 as boundary, a > 0 and lead(a) over w > 0 and (r, g, b) <> (lead(r) over w, lead(g) over w, lead(b) over w) as c from px window w as (partition by frame, y order by x)
  union all
  select frame, 'y', y + 1, a > 0 and lead(a) over w > 0 and (r, g, b) <> (lead(r) over w, lead(g) over w, lead(b) over w) from px window w as (partition by frame, x order by y)) where c"""))
def px_transitions(spark, d):
    return grid.transitions(derived_pixels(spark, d))


@query("px_bbox", _px("select frame, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from px where a > 0 group by frame"))
def px_bbox(spark, d):
    return grid.bounds(derived_pixels(spark, d))


BLOCKS_SQL = ", bc as (select frame, (y // 4)::int as block, sum((a > 0)::int)::bigint as cnt from px group by all)"


@query("px_block_counts", _px(BLOCKS_SQL + " select * from bc"))
def px_block_counts(spark, d):
    return grid.block_counts(derived_pixels(spark, d), PITCH)


@query("px_bottom_anchor", _px(BLOCKS_SQL + " select frame, (max(block) - coalesce(max(block) filter (cnt > 0), -1))::int as trailing, max(block) = coalesce(max(block) filter (cnt > 0), -1) as anchored from bc group by frame"))
def px_bottom_anchor(spark, d):
    return grid.trailing_empty(grid.block_counts(derived_pixels(spark, d), PITCH))


def _vote_sql(where: str, share: str) -> str:
    return f""", c as (select frame, (y // 4)::int as ty, (x // 4)::int as tx, r, g, b, a, count(*) as n from px group by all),
v as (select frame, ty, tx, arg_min((r, g, b, a), (-n, concat_ws(',', r, g, b, a))) filter ({where}) as p, sum(n) as area, coalesce(sum(n) filter (a > 0), 0) as o from c group by all),
voted as (select frame, ty, tx, case when {share} then p[1] else 0 end as r, case when {share} then p[2] else 0 end as g, case when {share} then p[3] else 0 end as b, case when {share} then p[4] else 0 end as a from v)"""


VOTE_OPAQUE_SQL = _vote_sql("a > 0", "o >= greatest(round(area * 0.3), 1)")


@query("px_vote_all", _px(_vote_sql("true", "true") + " select * from voted"))
def px_vote_all(spark, d):
    return grid.vote(grid.cells(derived_pixels(spark, d), PITCH).drop("y", "x"), ["frame", "ty", "tx"])


@query("px_vote_opaque", _px(VOTE_OPAQUE_SQL + " select * from voted"))
def px_vote_opaque(spark, d):
    return grid.vote(grid.cells(derived_pixels(spark, d), PITCH).drop("y", "x"), ["frame", "ty", "tx"], grid.REGULAR_ALPHA)


@query("px_uniform_cuts", """select p_partkey, unnest(range(len(c))) as i, unnest(c) as cut from (
  select p_partkey, list_sort(list_distinct(list_transform(range(n + 1), lambda i: (p_size * i // n)::int))) as c from (select p_partkey, p_size, least(p_partkey % 16 + 1, p_size) as n from part where p_size > 0))""")
def px_uniform_cuts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").filter("p_size > 0")
    return part.select("p_partkey", F.posexplode(grid.uniform_cuts(F.col("p_size"), F.col("p_partkey") % 16 + 1)).alias("i", "cut")).withColumn("i", F.col("i").cast("long"))


@query("px_sanitised_cuts", "select p_partkey, unnest(range(len(c))) as i, unnest(c) as cut from (select p_partkey, list_sort(list_distinct([least(greatest(x, 0), 40)::int for x in [p_size - 10, p_size, p_size * 2, 0, 40]])) as c from part)")
def px_sanitised_cuts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = F.array(F.col("p_size") - 10, F.col("p_size"), F.col("p_size") * 2)
    return part.select("p_partkey", F.posexplode(grid.sanitised(raw, F.lit(40))).alias("i", "cut")).withColumn("i", F.col("i").cast("long"))


@query("px_row_offsets", _px("select distinct frame, (y // 5)::int as block, 1 as offset, false as used_drift from px"))  # frames of seven rows of cells never drift
def px_row_offsets(spark, d):
    return grid.row_offsets(derived_pixels(spark, d), 5)


@query("px_point_sample")
def px_point_sample(spark, d):
    return grid.point_sample(derived_pixels(spark, d), PITCH)


# ---- stencils

NEAR_SQL = ", nb as (select p.frame, p.y + dy as y, p.x + dx as x, r, g, b, a from px p, (select unnest([-1, 0, 1]) as dy) o, (select unnest([-1, 0, 1]) as dx) q where a > 0 and (dy <> 0 or dx <> 0) {four})"


@query("px_repair", _px(NEAR_SQL.format(four="") + """, nn as (
  select frame, y, x, sum(n) as n, arg_min((r, g, b, a), (-n, concat_ws(',', r, g, b, a))) as m from (select frame, y, x, r, g, b, a, count(*) as n from nb group by all) group by all)
select frame, y, x, {cols} from px left join nn using (frame, y, x)""".replace("{cols}", ", ".join(f"case when a = 0 and coalesce(n, 0) >= 8 then m[{i}] when a > 0 and coalesce(n, 0) <= 1 then 0 else {c} end as {c}" for i, c in enumerate("rgba", 1)))))
def px_repair(spark, d):
    return stencil.repair(derived_pixels(spark, d))


@query("px_neutral_snap", _px(NEAR_SQL.format(four="") + """, nn as (select frame, y, x, sum((r > g + 5 and r > b + 5)::int) as warm, sum((r >= 240 and g >= 240 and b >= 200)::int) as bright from nb group by all),
s as (select px.*, warm, bright, a > 0 and not (r = g and g = b) and abs(r - g) <= 2 and abs(g - b) <= 2 as snaps, floor((r + g + b) / 3.0)::int as grey from px left join nn using (frame, y, x))
select frame, y, x, case when snaps and warm >= 2 and bright >= 2 then least(grey + 15, 255) when snaps then grey else r end as r,
       case when snaps and warm >= 2 and bright >= 2 then greatest(grey - 1, 0) when snaps then grey else g end as g, case when snaps and warm >= 2 and bright >= 2 then greatest(grey - 1, 0) when snaps then grey else b end as b, a from s"""))
def px_neutral_snap(spark, d):
    return stencil.snap_neutral(derived_pixels(spark, d))


def _outline_sql(four: str) -> str:
    cols = ", ".join(f"case when a = 0 and near then 255 else {c} end as {c}" for c in "rgba")
    return _px(NEAR_SQL.format(four=four) + f" select frame, y, x, {cols} from px left join (select distinct frame, y, x, true as near from nb) using (frame, y, x)")


@query("px_outline4", _outline_sql("and (dy = 0 or dx = 0)"))
def px_outline4(spark, d):
    return stencil.outline(derived_pixels(spark, d), "4-way")


@query("px_outline8", _outline_sql(""))
def px_outline8(spark, d):
    return stencil.outline(derived_pixels(spark, d), "8-way")


@query("px_upscale", _px("select frame, y * 3 + i as y, x * 3 + j as x, r, g, b, a from px, (select unnest(range(3))::int as i) p, (select unnest(range(3))::int as j) q"))
def px_upscale(spark, d):
    return stencil.upscale(derived_pixels(spark, d), 3)


REGIONS_SQL = ', rg as (select n_name as label, (n_nationkey % 5 * 6)::int as bx, (n_nationkey // 5 * 6)::int as "by", (n_nationkey % 7 + 1)::int as bw, (n_nationkey % 3 + 1)::int as bh from nation)'


def _regions(spark, d):
    n = F.col("n_nationkey")
    slices = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("idx"), F.col("n_name").alias("name"), (n % 5 * 6).cast("int").alias("bx"), F.expr("cast(n_nationkey div 5 * 6 as int)").alias("by"), (n % 7 + 1).cast("int").alias("bw"), (n % 3 + 1).cast("int").alias("bh"))
    return export.regions(slices, SIDE, SIDE)


@query("px_crop", _px(REGIONS_SQL + ' select label, frame, y - "by" as y, x - bx as x, r, g, b, a from px join rg on x >= bx and x < bx + bw and y >= "by" and y < "by" + bh'))
def px_crop(spark, d):
    return stencil.crop(derived_pixels(spark, d), _regions(spark, d))


@query("px_regions_nonempty", _px(REGIONS_SQL + ' select * from rg where exists (select 1 from px where a > 0 and x >= bx and x < bx + bw and y >= "by" and y < "by" + bh)'))
def px_regions_nonempty(spark, d):
    return export.nonempty(_regions(spark, d), derived_pixels(spark, d))


@query("px_fit", _px("select f.frame, gy as y, gx as x, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b, coalesce(a, 0) as a from (select distinct frame from px) f cross join (select unnest(range(40))::int as gy) p cross join (select unnest(range(28))::int as gx) q left join px on px.frame = f.frame and px.y = gy - 4 and px.x = gx + 2"))
def px_fit(spark, d):
    px = derived_pixels(spark, d)
    return stencil.fit(px, _sizes(px), 28, 40)


@query("image_diff", _px(VOTE_OPAQUE_SQL + " select px.frame, count(*) as compared, sum(((px.r, px.g, px.b, px.a) <> (v.r, v.g, v.b, v.a))::int)::bigint as mismatched from px join voted v on v.frame = px.frame and v.ty = px.y // 4 and v.tx = px.x // 4 group by px.frame"))
def image_diff(spark, d):
    px = derived_pixels(spark, d)
    small = px_vote_opaque(spark, d).withColumnsRenamed({"ty": "y", "tx": "x"})
    return stencil.difference(px, stencil.upscale(small, PITCH))


# ---- names, layers

@query("export_names", """select base, region_idx, frame, index, case when num <> '' then prefix || lpad(n, greatest(length(num), length(n))::int, '0') else base || lpad(index::varchar, greatest(3, length(index::varchar))::int, '0') end as name from (
  select *, regexp_extract(base, '^(.*?)([0-9]+)$', 1) as prefix, regexp_extract(base, '^(.*?)([0-9]+)$', 2) as num, (try_cast(regexp_extract(base, '^(.*?)([0-9]+)$', 2) as bigint) + index - 1)::varchar as n from (
    select p_brand as base, p_partkey as region_idx, f::int as frame, row_number() over (partition by p_brand order by p_partkey, f) as index from part, (select unnest([1, 2, 3]) as f)))""")
def export_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("base"), F.col("p_partkey").alias("region_idx"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("frame"))
    return export.numbered(part).select("base", "region_idx", "frame", F.col("index").cast("long").alias("index"), "name")


@query("export_token_names", "select n_name, n_name || ' Token ' || regexp_extract(n_name || '/' || r_name || '//', '([^/\\\\]+)[/\\\\]*$', 1) || ' ' as name from nation join region on n_regionkey = r_regionkey")
def export_token_names(spark, d):
    both = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", export.token_name(F.col("n_name"), F.concat("n_name", F.lit("/"), "r_name", F.lit("//"))).alias("name"))


LAYERS_SQL = "l as (select r_regionkey::bigint as id, null::bigint as parent_id, 'group' as kind, r_regionkey <> 2 as visible from region union all select 100 + n_nationkey, case when n_nationkey % 4 = 0 then null else n_regionkey end, case when n_nationkey % 3 = 0 then 'tilemap' else 'image' end, n_nationkey % 6 <> 5 from nation)"


@query("layer_visibility", f"with recursive {LAYERS_SQL}, s(id, kind) as (select id, kind from l where parent_id is null and visible union all select l.id, l.kind from l join s on l.parent_id = s.id where l.visible) select id, kind from s where kind <> 'group'")
def layer_visibility(spark, d):
    region, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    n = F.col("n_nationkey")
    layers = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("group").alias("kind"), (F.col("r_regionkey") != 2).alias("visible")).union(
        nation.select((n + 100).cast("long"), F.when(n % 4 == 0, None).otherwise(F.col("n_regionkey")).cast("long"), F.when(n % 3 == 0, "tilemap").otherwise("image"), n % 6 != 5))
    return export.visible_layers(spark, "rasterloom_layers", layers)


_MODES = ", ".join("({}, '{}', {}, '{}')".format(i, n, f"'{m}'" if m else "null", c) for i, n, m, c in export.BLEND_MODES)


@query("blend_mode_map", f"""with m(i, n, mode, class) as (values {_MODES}),
l as (select n_nationkey as id, case when n_nationkey % 2 = 0 then (n_nationkey % 15)::int end as value, case when n_nationkey % 3 = 0 then 'GlowBlendOp' when n_nationkey % 3 = 1 then 'ScreenBlendOp' end as class from nation)
select id, coalesce(value, c.i, 0) as blend_id, coalesce(k.mode, 'normal') as mode, case when k.mode is null then 'blend mode ' || coalesce(k.n, coalesce(value, c.i, 0)::varchar) || ' became normal' end as warning
from l left join m c on l.class = c.class left join m k on k.i = coalesce(value, c.i, 0)""")
def blend_mode_map(spark, d):
    n = F.col("n_nationkey")
    layers = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("id"), F.when(n % 2 == 0, n % 15).cast("int").alias("value"), F.when(n % 3 == 0, "GlowBlendOp").when(n % 3 == 1, "ScreenBlendOp").alias("class"))
    return export.resolved_blend(layers)


# ---- colour

HIST_SQL = ", h as (select r * 65536 + g * 256 + b as key, r, g, b, count(*) as w, count(distinct frame) as frames from px where a > 0 group by all)"
ENTRIES_SQL = HIST_SQL + ", lab as " + C.OKLAB_SQL.format(cols="key, r, g, b, w, frames", source="h") + """,
en as (select *, sqrt(lab_a * lab_a + lab_b * lab_b) as chroma, case when degrees(atan2(lab_b, lab_a)) < 0 then degrees(atan2(lab_b, lab_a)) + 360 else degrees(atan2(lab_b, lab_a)) end as hue from lab)"""


def _entries(spark, d):
    """A small table used several times over; settled, so that each use doesn't repeat its expressions."""
    return settled(palette.entries(px_collect_histogram(spark, d)))


def _clustered(spark, d):
    return palette.chromatic(_entries(spark, d)).withColumn("cluster", F.floor(F.col("hue") / 60).cast("int"))


CLUSTERED_SQL = ENTRIES_SQL + ", cl as (select *, floor(hue / 60)::int as cluster from en where chroma >= 0.02)"


@query("colour_oklab", _px(ENTRIES_SQL + " select key, round(lab_l, 6) as lab_l, round(lab_a, 6) as lab_a, round(lab_b, 6) as lab_b from en"))
def colour_oklab(spark, d):
    return _rounded(_entries(spark, d).select("key", "lab_l", "lab_a", "lab_b"))


@query("colour_oklch", _px(ENTRIES_SQL + " select key, round(chroma, 6) as chroma, case when chroma >= 0.0001 then round(hue, 4) end as hue from en"))
def colour_oklch(spark, d):
    return _entries(spark, d).select("key", F.round("chroma", 6).alias("chroma"), F.when(F.col("chroma") >= 0.0001, F.round("hue", 4)).alias("hue"))


@query("colour_distance", _px(ENTRIES_SQL + ", t as (select * from en order by w desc, key limit 1) select en.key, round(pow(en.lab_l - t.lab_l, 2) + pow(en.lab_a - t.lab_a, 2) + pow(en.lab_b - t.lab_b, 2), 6) as d2, (en.r - t.r) * (en.r - t.r) + (en.g - t.g) * (en.g - t.g) + (en.b - t.b) * (en.b - t.b) as rgb_d2 from en, t"))
def colour_distance(spark, d):
    all_ = _entries(spark, d)
    top = all_.orderBy(F.desc("w"), "key").limit(1).select(*[F.col(c).alias(f"t_{c}") for c in ("lab_l", "lab_a", "lab_b", "r", "g", "b")])
    part = lambda names, prefix: tuple(F.col(prefix + n) for n in names)
    lab, rgb = ("lab_l", "lab_a", "lab_b"), ("r", "g", "b")
    return all_.crossJoin(F.broadcast(top)).select("key", F.round(C.distance2(part(lab, ""), part(lab, "t_")), 6).alias("d2"), C.distance2(part(rgb, ""), part(rgb, "t_")).alias("rgb_d2"))  # one row


@query("colour_roundtrip", _px(HIST_SQL + " select key, r, g, b, true as inside from h"))
def colour_roundtrip(spark, d):
    lab = [F.col(c) for c in ("lab_l", "lab_a", "lab_b")]
    return _entries(spark, d).select("key", *[C.channel(x).alias(n) for x, n in zip(C.linear_rgb(*lab), "rgb")], C.in_gamut(*lab).alias("inside"))


@query("gamut_clip")
def gamut_clip(spark, d):
    clipped = C.gamut_chroma(F.col("lab_l"), F.col("chroma") * 3, F.col("hue"))
    return _rounded(_entries(spark, d).select("key", (F.col("chroma") * 3).alias("wanted"), clipped.alias("clipped")))


@query("hue_circular_mean", _px(CLUSTERED_SQL + " select cluster, round(case when m < 0 then m + 360 else m end, 4) as hue from (select cluster, degrees(atan2(sum(sin(radians(hue)) * w), sum(cos(radians(hue)) * w))) as m from cl group by cluster)"))
def hue_circular_mean(spark, d):
    return _clustered(spark, d).groupBy("cluster").agg(F.round(palette.circular_mean("hue", "w"), 4).alias("hue"))


@query("nearest_rank_pct", _px(CLUSTERED_SQL + " select cluster, round(l[(round(0.05 * (n - 1)) + 1)::int], 6) as p5, round(l[(round(0.95 * (n - 1)) + 1)::int], 6) as p95 from (select cluster, list(lab_l order by lab_l) as l, count(*) as n from cl group by cluster)"))
def nearest_rank_pct(spark, d):
    return _rounded(_clustered(spark, d).groupBy("cluster").agg(palette.nearest_rank("lab_l", 0.05).alias("p5"), palette.nearest_rank("lab_l", 0.95).alias("p95")))


@query("lower_median", _px(CLUSTERED_SQL + " select cluster, (list(w order by w))[((count(*) + 1) // 2)::int] as w from cl group by cluster"))
def lower_median(spark, d):
    return _clustered(spark, d).groupBy("cluster").agg(pitch.lower_median("w").alias("w"))


ACCENTS_SQL = ENTRIES_SQL + """, pool as (select * from en where chroma >= 0.02), md as (select median(chroma) as m, count(*) as n from pool),
sg as (select greatest(1.4826 * median(abs(chroma - m)), 1e-4) as s from pool, md), tt as (select sum(w) as total, (select count(distinct frame) from px) as tf from en),
ac as (
  select key, chroma, w, case when w < (case when total < 512 then 1 else greatest(2, ceil(total / 2000.0)) end) or w >= greatest(1, total * 0.12) or (tf > 1 and frames = 1 and w <= 2) then 0.0
         else least(greatest((chroma - m) / s / 3, 0), 1) * (0.85 + 0.15 * least(1.0, frames / greatest(2.0, tf * 0.5))) end as score from pool, md, sg, tt where n >= 4)"""


def _accents(spark, d):
    tf = settled(derived_pixels(spark, d).agg(F.count_distinct("frame").alias("tf")))
    return palette.accent_scores(_entries(spark, d), tf)


@query("accent_scores", _px(ACCENTS_SQL + " select key, round(chroma, 6) as chroma, w, round(score, 6) as score from ac"))
def accent_scores(spark, d):
    return _rounded(_accents(spark, d))


@query("accent_topk", _px(ACCENTS_SQL + " select key, round(chroma, 6) as chroma, w, round(score, 6) as score from ac where score >= 0.2 order by round(score, 9) desc, key limit 8"))
def accent_topk(spark, d):
    return _rounded(palette.accents(_accents(spark, d), palette.SLOTS, 0.2))


@query("cluster_outliers", _px(CLUSTERED_SQL + """, md as (select cluster, median(chroma) as m, count(*) as n from cl group by cluster), t as (select sum(w) as total from en)
select cluster, key, round(chroma * (1 + ln(1 + w)), 6) as score from cl join md using (cluster), t where n >= 3 and chroma > greatest(0.06, m * 1.8) and w >= (case when total < 512 then 1 else greatest(2, ceil(total / 2000.0)) end) order by round(chroma * (1 + ln(1 + w)), 9) desc, key limit 8"""))
def cluster_outliers(spark, d):
    return _rounded(palette.cluster_outliers(_clustered(spark, d), palette.totals(_entries(spark, d)).select("pixel_floor"), palette.SLOTS))


@query("sparse_clusters", _px(ENTRIES_SQL + """, cl as (select *, floor(hue / 10)::int as cluster from en where chroma >= 0.02), z as (select cluster, count(*) as n, sum(w) as mass, max(chroma) as most from cl group by cluster)
select cluster, key from cl join z using (cluster) where n <= 6 and mass <= least((select sum(w) from en) * 0.02, 64.0) and most >= 0.10 and chroma >= 0.06 order by cluster, key limit 4"""))
def sparse_clusters(spark, d):
    fine = palette.chromatic(_entries(spark, d)).withColumn("cluster", F.floor(F.col("hue") / 10).cast("int"))
    return palette.sparse_clusters(fine, palette.totals(_entries(spark, d)).select("total"), 4)


STOPS_SQL = CLUSTERED_SQL + ", st as (select * from (select cluster as ramp, row_number() over (partition by cluster order by w desc, key) as stop, r, g, b, lab_l, lab_a, lab_b, w as weight from cl) where stop <= 4)"


def _stops(spark, d):
    """The four most frequent colours of each cluster, as ready-made ramps."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "key"))
    return _clustered(spark, d).withColumn("stop", rank).filter("stop <= 4").select(F.col("cluster").alias("ramp"), "stop", "r", "g", "b", "lab_l", "lab_a", "lab_b", F.col("w").alias("weight"))


@query("ramp_anchor", _px(STOPS_SQL + " select round(sum(lab_l * weight) / sum(weight), 6) as lab_l, round(sum(lab_a * weight) / sum(weight), 6) as lab_a, round(sum(lab_b * weight) / sum(weight), 6) as lab_b from st where stop = 1"))
def ramp_anchor(spark, d):
    return _rounded(palette.anchors(_stops(spark, d).filter("stop = 1")))


REMAP_SQL = STOPS_SQL + ", rm as (select cl.key, cl.cluster as ramp, arg_min(st.stop, (round(pow(cl.lab_l - st.lab_l, 2) + pow(cl.lab_a - st.lab_a, 2) + pow(cl.lab_b - st.lab_b, 2), 12), st.stop)) as stop from cl join st on st.ramp = cl.cluster group by all)"


def _remapped(spark, d):
    return settled(palette.remap(_clustered(spark, d).withColumnRenamed("cluster", "ramp"), _stops(spark, d)))


@query("ramp_remap", _px(REMAP_SQL + " select key, ramp, stop::int as stop from rm"))
def ramp_remap(spark, d):
    return _remapped(spark, d).select("key", "ramp", F.col("stop").cast("int").alias("stop"))


@query("lut_apply", _px(REMAP_SQL + ", lu as (select key, r, g, b from rm join st using (ramp, stop)) select frame, y, x, coalesce(lu.r, px.r) as r, coalesce(lu.g, px.g) as g, coalesce(lu.b, px.b) as b, a from px left join lu on px.a > 0 and lu.key = px.r * 65536 + px.g * 256 + px.b"))
def lut_apply(spark, d):
    lookup = _remapped(spark, d).join(_stops(spark, d).select("ramp", "stop", *"rgb"), ["ramp", "stop"]).select("key", *"rgb")
    return palette.apply_lookup(derived_pixels(spark, d), lookup)


@query("lut_override", _px(ENTRIES_SQL + " select key, case when key % 3 = 0 then 255 - r else r end as r, case when key % 3 = 0 then 255 - g else g end as g, case when key % 3 = 0 then 255 - b else b end as b from en"))
def lut_override(spark, d):
    base = _entries(spark, d).select("key", *"rgb")
    return palette.override(base, base.filter("key % 3 = 0").select("key", *[(255 - F.col(c)).alias(c) for c in "rgb"]))


@query("colour_survival", _px(STOPS_SQL + " select en.key, round(sqrt(min(pow(en.lab_l - st.lab_l, 2) + pow(en.lab_a - st.lab_a, 2) + pow(en.lab_b - st.lab_b, 2))), 6) as distance, round(sqrt(min(pow(en.lab_l - st.lab_l, 2) + pow(en.lab_a - st.lab_a, 2) + pow(en.lab_b - st.lab_b, 2))), 6) <= 0.04 as survived from en, st where chroma > 0.08 group by en.key"))
def colour_survival(spark, d):
    found = palette.survival(_entries(spark, d), _stops(spark, d))
    return found.select("key", F.round("distance", 6).alias("distance"), (F.round("distance", 6) <= 0.04).alias("survived"))


@query("rng_minstd", "select p_partkey, (((p_partkey + 1) * 16807 % 2147483647) * 16807 % 2147483647) * 16807 % 2147483647 as state from part")
def rng_minstd(spark, d):
    seeds = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") + 1).alias("seed"))
    return clustering.states(seeds, 3).select((F.col("seed") - 1).alias("p_partkey"), "state")


@query("weighted_choice", _px(", h as (select frame, r, g, b, count(*) as n, min(y * 32 + x) as p from px where a > 0 group by all), c as (select *, sum(n) over (partition by frame order by p) as upto, sum(n) over (partition by frame) as total from h), f as (select frame, total, ((frame + 1) * 16807 % 2147483647 - 1) / 2147483646.0::double * total as target from c group by all) select c.frame, arg_min(r, upto) as r, arg_min(g, upto) as g, arg_min(b, upto) as b from c join f using (frame) where target < upto group by c.frame"))
def weighted_choice(spark, d):
    return clustering.drawn(px_histogram(spark, d))


# ---- sequential and iterative: checked by tests

@query("kmeans_rgb")
def kmeans_rgb(spark, d):
    return clustering.quantised(px_histogram(spark, d), 16)


@query("kmeans_hue")
def kmeans_hue(spark, d):
    return clustering.hue_clusters(palette.chromatic(_entries(spark, d)).withColumn("sprite", F.lit("all")))


@query("snapped_cuts")
def snapped_cuts(spark, d):
    return cuts.frame_cuts(histogram.profiles(derived_pixels(spark, d)), "snapped", PITCH)


@query("regularised_cuts")
def regularised_cuts(spark, d):
    return cuts.frame_cuts(histogram.profiles(derived_pixels(spark, d)), "regularised", PITCH)


@query("content_anchored")
def content_anchored(spark, d):
    px = derived_pixels(spark, d)
    return cuts.content_spans(grid.transitions(px), grid.bounds(px), _sizes(px), PITCH, "anchored")


@query("elastic_grid")
def elastic_grid(spark, d):
    px = derived_pixels(spark, d)
    return cuts.content_spans(grid.transitions(px), grid.bounds(px), _sizes(px), PITCH, "elastic")


@query("ramp_stops")
def ramp_stops(spark, d):
    return _rounded(ramps.shared_end(ramps.chromatic(_clustered(spark, d))), 4)


@query("grey_ramp")
def grey_ramp(spark, d):
    return _rounded(ramps.grey(_entries(spark, d).filter(F.col("chroma") < palette.NEUTRAL)), 4)


# ---- whole runs

@query("run_downscale")
def run_downscale(spark, d):
    from rasterloom.plans import pipelines

    return pipelines.downscale(derived_pixels(spark, d))[0]


@query("run_compress")
def run_compress(spark, d):
    from rasterloom.plans import pipelines

    return pipelines.compress(derived_pixels(spark, d))[0]


@query("run_palette")
def run_palette(spark, d):
    from rasterloom.plans import pipelines

    return pipelines.compress(derived_pixels(spark, d), pipelines.Compress(target=24))[1]


@query("run_export")
def run_export(spark, d):
    from rasterloom.plans import pipelines

    n = F.col("n_nationkey")
    slices = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey < 4").select(n.alias("idx"), F.lit("").alias("name"), (n * 8).cast("int").alias("bx"), F.lit(4).alias("by"), F.lit(8).alias("bw"), F.lit(8).alias("bh"))
    return pipelines.export_regions(derived_pixels(spark, d), slices, SIDE, SIDE, pipelines.Export(name="tile07", scale=2))
