"""Queries over layers, documents, files, options and reports, each with the SQL it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.functions import colour as C
from rasterloom.functions import options
from rasterloom.operators import grid, histogram, layers, palette, ramps, reports, stencil
from rasterloom.plans.raster_queries import CLUSTERED_SQL, ENTRIES_SQL, ORACLE_SQL, PITCH, REGIONS_SQL, REMAP_SQL, VOTE_OPAQUE_SQL, _clustered, _entries, _px, _regions, _remapped, _rounded, _stops, px_vote_opaque, query
from rasterloom.sources import images, pdn, writers
from rasterloom.sources.pixels import SIDE, derived_pixels
from rasterloom.sources.scratch import settled, shared_folder

LAYERED_SQL = """, ly as (
  select 'base' as layer, 0 as z, 255 as opacity, frame, y, x, r, g, b, a from px
  union all
  select 'glaze', 1, 128, frame, y, 31 - x, r, g, b, case when (x + y) % 3 = 0 then 0 when (x + y) % 3 = 1 then 200 else a end from px where a > 0)"""


def _layered(spark, d):
    """Two layers: the derived pixels, and their mirror image at half opacity with holes."""
    px = derived_pixels(spark, d)
    base = px.select(F.lit("base").alias("layer"), F.lit(0).alias("z"), F.lit(255).alias("opacity"), "frame", "y", "x", *"rgba")
    third = (F.col("x") + F.col("y")) % 3
    glaze = px.filter("a > 0").select(F.lit("glaze").alias("layer"), F.lit(1).alias("z"), F.lit(128).alias("opacity"), "frame", "y", (F.lit(SIDE - 1) - F.col("x")).alias("x"), *"rgb", F.when(third == 0, 0).when(third == 1, 200).otherwise(F.col("a")).alias("a"))
    return base.unionByName(glaze)


COMPOSITE_SQL = LAYERED_SQL + """, pr as (
  select p.frame, p.y, p.x, p.r, p.g, p.b, p.a / 255.0::double as ba, coalesce(q.r, 0) as tr, coalesce(q.g, 0) as tg, coalesce(q.b, 0) as tb, coalesce(q.a / 255.0::double * 128 / 255.0::double, 0.0) as s
  from (select * from ly where z = 0) p left join (select * from ly where z = 1) q using (frame, y, x)),
cp as (
  select frame, y, x, {cols}, round((s + ba * (1 - s)) * 255)::int as a from pr)""".replace("{cols}", ", ".join(f"case when s + ba * (1 - s) > 0 then round((t{c} * s + {c} * (ba * (1 - s))) / (s + ba * (1 - s)))::int else 0 end as {c}" for c in "rgb"))


@query("layer_composite", _px(COMPOSITE_SQL + " select * from cp"))
def layer_composite(spark, d):
    return layers.composite(_layered(spark, d))


@query("layer_profile", _px(COMPOSITE_SQL + """
select 'layer' as level, layer as name, count(*) filter (a > 0) as opaque, count(distinct (r, g, b)) filter (a > 0) as colours from ly group by layer
union all select 'frame', frame::varchar, count(*) filter (a > 0), count(distinct (r, g, b)) filter (a > 0) from cp group by frame
union all select 'total', '', count(*) filter (a > 0), count(distinct (r, g, b)) filter (a > 0) from cp"""))
def layer_profile(spark, d):
    return reports.layer_profile(_layered(spark, d))


# ---- documents and files

def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/rasterloom/files-{uuid.uuid4().hex}"


def _documents(spark, d):
    """The layered frames as Paint.NET documents, written to files and read as layers."""
    both = _layered(spark, d).withColumn("visible", F.col("z") == 0).withColumn("is_background", F.col("z") == 0).withColumn("blend", F.col("z") * 8)
    folder = _folder(spark)
    writers.save(writers.documents(both), folder)
    return pdn.read_layers(spark, f"{folder}/*.pdn").withColumn("frame", F.regexp_extract("file", r"(\d+)\.pdn$", 1).cast("int"))


FILLED_SQL = LAYERED_SQL + """, fl as (
  select frame, 2 as idx, y, x, coalesce(q.r, 0) as r, coalesce(q.g, 0) as g, coalesce(q.b, 0) as b, coalesce(q.a, 0) as a from px p left join (select * from ly where z = 1) q using (frame, y, x)
  union all select frame, 1, y, x, r, g, b, a from px)"""


@query("pdn_pixels", _px(FILLED_SQL + " select frame, idx, y, x, r, g, b, a from fl"))
def pdn_pixels(spark, d):
    return pdn.layer_pixels(_documents(spark, d)).select(F.regexp_extract("file", r"(\d+)\.pdn$", 1).cast("int").alias("frame"), "idx", "y", "x", *"rgba")


@query("pdn_layers", _px(LAYERED_SQL + """ select distinct frame, 32 as width, 32 as height, z + 1 as idx, layer as name, z = 0 as visible, z = 0 as is_background, opacity, z * 8 as blend_id,
  case when z = 0 then 'normal' else 'difference' end as mode, 128 as stride, 4096 as bytes, null::varchar as warning from ly"""))
def pdn_layers(spark, d):
    found = _documents(spark, d)
    from rasterloom.operators import export

    modes = export.resolved_blend(found.select(F.struct("frame", "idx").alias("id"), F.col("blend_id").alias("value"), F.col("blend_class").alias("class")))
    rows = found.withColumn("id", F.struct("frame", "idx")).drop("blend_id", "warning").join(modes, "id")
    return rows.select("frame", "width", "height", "idx", "name", "visible", "is_background", "opacity", "blend_id", "mode", "stride", F.octet_length("raw").alias("bytes"), "warning")


@query("pdn_import", _px(FILLED_SQL + """ select frame, idx, case when idx = 1 then bool_and(a = 255) else false end as is_background, count(*) filter (a > 0) as opaque from fl group by frame, idx"""))
def pdn_import(spark, d):
    """Documents imported as two tables, which are then read."""
    folder, found = _folder(spark), _documents(spark, d)
    writers.import_layers(found, pdn.layer_pixels(found), folder)
    kept, pixels = (spark.read.parquet(f"{folder}/{t}") for t in ("layers", "pixels"))
    counts = pixels.groupBy("file", "idx").agg(F.count(F.when(F.col("a") > 0, 1)).alias("opaque"))
    return kept.join(counts, ["file", "idx"]).select("frame", "idx", "is_background", "opaque")


@query("image_files", _px("select frame::bigint as number, y, x, r, g, b, a from px"))
def image_files(spark, d):
    """Frames written as PNG files and read by the image source; a frame's number is in its file's name."""
    folder = _folder(spark)
    named = derived_pixels(spark, d).withColumn("name", F.lpad(F.col("frame").cast("string"), 9, "0"))
    writers.save(writers.images(named, "name"), folder)
    return images.read_pixels(spark, folder).select(F.col("frame").cast("long").alias("number"), "y", "x", *"rgba")


@query("frames_replaced", _px(VOTE_OPAQUE_SQL + " select frame, count(*) as pixels, sum(r + g + b)::bigint as total from voted group by frame"))
def frames_replaced(spark, d):
    """A table of frames overwritten by their votes."""
    folder = _folder(spark)
    writers.replace_frames(derived_pixels(spark, d), folder)
    writers.replace_frames(px_vote_opaque(spark, d), folder)
    return spark.read.parquet(folder).groupBy("frame").agg(F.count("*").alias("pixels"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total"))


# ---- layers

@query("palette_by_frame", "select n_nationkey + 1 as frame, least(n_nationkey + 1, (select max(r_regionkey) + 1 from region)) as palette_idx from nation")
def palette_by_frame(spark, d):
    frames = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1).alias("frame"))
    return layers.palette_of_frames(frames, spark.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") + 1).alias("palette_idx")))


@query("working_layers", "select r_regionkey::bigint as id, null::bigint as parent_id, 'group' as kind, r_regionkey <> 2 as visible, false as is_background from region union all select 100 + n_nationkey, n_regionkey, 'image', n_nationkey % 6 <> 5, false from nation where n_nationkey % 7 <> 0")
def working_layers(spark, d):
    region, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    n = F.col("n_nationkey")
    both = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("group").alias("kind"), (F.col("r_regionkey") != 2).alias("visible"), F.lit(False).alias("is_background")).union(
        nation.select((n + 100).cast("long"), F.col("n_regionkey").cast("long"), F.lit("image"), n % 6 != 5, n % 7 == 0))
    return layers.working_layers(both)


@query("indexed_rgb", _px(""", ix as (select frame, y, x, (r + g + b) // 40 as idx from px), pl as (select p_partkey::int as idx, p_size * 5 as r, p_size * 3 as g, p_size * 2 as b, 255 as a from part where p_partkey % 3 <> 0)
select frame, y, x, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b, coalesce(a, 0) as a from ix left join pl using (idx)"""))
def indexed_rgb(spark, d):
    indexed = derived_pixels(spark, d).select("frame", "y", "x", F.expr("cast((r + g + b) div 40 as int)").alias("idx"))
    size = F.col("p_size")
    colours = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("int").alias("idx"), (size * 5).alias("r"), (size * 3).alias("g"), (size * 2).alias("b"), F.lit(255).alias("a"))
    return layers.as_rgb(indexed, colours)


@query("reduced_palette", _px("select r, g, b, count(*) as n from px where a > 0 group by all"))
def reduced_palette(spark, d):
    return layers.reduced_palette(derived_pixels(spark, d))


NAMES_SQL = """nm as (select case when n_nationkey % 5 = 0 then r_name else r_name || ' ' || (n_nationkey % 4 + 1) end as name from nation join region on n_regionkey = r_regionkey where n_nationkey % 11 <> 3),
tr as (select r_name as base, k, case when k = 1 then r_name else r_name || ' ' || k end as name from region, (select unnest(range(1, 30)) as k))"""


@query("free_names", f"with {NAMES_SQL} select base, arg_min(name, k) as name from tr where name not in (select name from nm) group by base")
def free_names(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    n = F.col("n_nationkey")
    held = nation.filter(n % 11 != 3).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(n % 5 == 0, F.col("r_name")).otherwise(F.concat("r_name", F.lit(" "), (n % 4 + 1).cast("string"))).alias("name"))
    return layers.free_names(held, region.select(F.col("r_name").alias("base")))


@query("lut_new_layer", _px(REMAP_SQL + ", lu as (select key, r, g, b from rm join st using (ramp, stop)) select 'Ramps 2' as layer, frame, y, x, coalesce(lu.r, px.r) as r, coalesce(lu.g, px.g) as g, coalesce(lu.b, px.b) as b, a from px left join lu on lu.key = px.r * 65536 + px.g * 256 + px.b where px.a > 0"))
def lut_new_layer(spark, d):
    lookup = _remapped(spark, d).join(_stops(spark, d).select("ramp", "stop", *"rgb"), ["ramp", "stop"]).select("key", *"rgb")
    existing, wanted = (spark.range(1).select(F.lit("Ramps").alias(c)) for c in ("name", "base"))
    return layers.remapped_layer(derived_pixels(spark, d), lookup, layers.free_names(existing, wanted).first()["name"])


@query("export_summary", _px(REGIONS_SQL + """, kp as (select * from rg where exists (select 1 from px where a > 0 and x >= bx and x < bx + bw and y >= "by" and y < "by" + bh)),
im as (select count(*) as n from (select distinct label, frame from px join kp on x >= bx and x < bx + bw and y >= "by" and y < "by" + bh))
select (select n from im) || ' images of ' || (select count(*) from kp) || ' regions; background layers ignored' || case when (select count(*) from rg) > (select count(*) from kp) then '; ' || ((select count(*) from rg) - (select count(*) from kp)) || ' empty regions left out' else '' end as message"""))
def export_summary(spark, d):
    from rasterloom.operators import export

    px, every = derived_pixels(spark, d), _regions(spark, d)
    kept = settled(export.nonempty(every, px))
    return layers.summary(stencil.crop(px, kept), every, kept)


# ---- options

WORDS_SQL = "w as (select p_partkey, [null, '', '1', 'true', ' TRUE ', '0', 'False', 'false ', 'yes', 'off'][(p_partkey % 10 + 1)::int] as v, [null, '', '7', '7.9', '-2.5', '1e2'][(p_partkey % 6 + 1)::int] as n, [null, '', '4-way', 'Circle', ' square', '8WAY'][(p_partkey % 6 + 1)::int] as o from part)"


@query("option_values", f"""with {WORDS_SQL}
select p_partkey, v is not null and v <> '' as given,
       case when coalesce(v, '') = '' then true when p_partkey % 10 < 8 then lower(trim(v)) in ('1', 'true') end as strict, case when coalesce(v, '') = '' then false else lower(trim(v)) in ('1', 'true', 'yes', 'y', 'on') end as wide,
       case when coalesce(v, '') = '' then true else lower(v) in ('1', 'true', 'yes') end as lenient, coalesce(nullif(n, '')::double, 2.5) as num, floor(nullif(n, '')::double)::bigint as whole,
       case when coalesce(o, '') = '' then '4-way' when lower(trim(o)) in ('4-way', '4way', 'circle') then '4-way' else '8-way' end as outline from w""")
def option_values(spark, d):
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(x) for x in words]), (k % n + 1).cast("int"))
    v = pick([None, "", "1", "true", " TRUE ", "0", "False", "false ", "yes", "off"], 10)
    n, o = pick([None, "", "7", "7.9", "-2.5", "1e2"], 6), pick([None, "", "4-way", "Circle", " square", "8WAY"], 6)
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", v.alias("v"), n.alias("n"), o.alias("o"))
    v, n, o = F.col("v"), F.col("n"), F.col("o")
    return rows.select("p_partkey", options.given(v).isNotNull().alias("given"), F.when(k % 10 < 8, options.boolean_column(v, True)).alias("strict"), options.boolean_column(v, False, options.WIDE).alias("wide"),
                       options.lenient_column(v, True).alias("lenient"), options.number_column(n, 2.5).alias("num"), options.integer_column(n).alias("whole"), options.outline_column(o).alias("outline"))


@query("option_names", """with n as (select p_partkey, chr(9) || ' ' || p_brand || chr(10) as padded, p_name || case when p_partkey % 3 = 0 then '.ASE' when p_partkey % 3 = 1 then '.aseprite' else '.png' end as file, (p_partkey % 13) || '_' || p_type || '+' || p_name as raw, ['end', 'local', 'x9', '42'][(p_partkey % 4 + 1)::int] as word from part)
select p_partkey, trim(padded, ' ' || chr(9) || chr(10)) as name, regexp_replace(file, '\\.(aseprite|ase)$', '', 'i') as base, regexp_replace(regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9_]+', '') as identifier,
       case word when 'end' then 'end_' when 'local' then 'local_' when '42' then '_' else word end as safe, regexp_replace(file, '\\.[^.]*$', '') as title, 'out/' || file as path from n""")
def option_names(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        k, F.concat(F.lit("\t "), "p_brand", F.lit("\n")).alias("padded"), F.concat("p_name", F.when(k % 3 == 0, ".ASE").when(k % 3 == 1, ".aseprite").otherwise(".png")).alias("file"),
        F.concat((k % 13).cast("string"), F.lit("_"), "p_type", F.lit("+"), "p_name").alias("raw"), F.element_at(F.array(*map(F.lit, ("end", "local", "x9", "42"))), (k % 4 + 1).cast("int")).alias("word"))
    file = F.col("file")
    return rows.select(k, options.export_name(F.col("padded"), F.lit("title")).alias("name"), options.base_name(file).alias("base"), options.identifier_column(F.col("raw")).alias("identifier"), options.identifier_column(F.col("word")).alias("safe"),
                       options.default_name(F.concat(F.lit("/tmp/some/"), file)).alias("title"), options.joined_path(F.lit("out//"), file).alias("path"))


# ---- reports

HEX_SQL = "'#' || lpad(upper(to_hex(r)), 2, '0') || lpad(upper(to_hex(g)), 2, '0') || lpad(upper(to_hex(b)), 2, '0')"


@query("leading_colours", _px(f"select {HEX_SQL} as colour, count(*) as n from px where a > 0 group by r, g, b order by n desc, colour limit 60"))
def leading_colours(spark, d):
    return reports.leading_colours(derived_pixels(spark, d))


@query("greenish", _px("select r, g, b, count(*) as n from px where a > 0 and g > r + 12 and g > b + 4 group by all"))
def greenish(spark, d):
    return reports.greenish(derived_pixels(spark, d))


@query("region_colours", _px(REGIONS_SQL + f' select label, {HEX_SQL} as colour, count(*) as n from px join rg on x >= bx and x < bx + bw and y >= "by" and y < "by" + bh where a > 0 group by all'))
def region_colours(spark, d):
    return reports.region_colours(derived_pixels(spark, d), _regions(spark, d))


@query("pixel_pairs", _px(VOTE_OPAQUE_SQL + f""", tp as (select {HEX_SQL} as colour from px where a > 0 group by r, g, b order by count(*) desc, colour limit 2), sr as (select frame, y, x, {HEX_SQL} as source from px where a > 0)
select frame, y, x, source, case when v.r is not null then {HEX_SQL.replace('(r)', '(v.r)').replace('(g)', '(v.g)').replace('(b)', '(v.b)')} end as output from sr left join (select frame, ty as y, tx as x, r, g, b from voted) v using (frame, y, x) where source in (select colour from tp)"""))
def pixel_pairs(spark, d):
    px = derived_pixels(spark, d)
    wanted = [r["colour"] for r in reports.leading_colours(px, 2).collect()]
    return reports.pairs(px, px_vote_opaque(spark, d).withColumnsRenamed({"ty": "y", "tx": "x"}), wanted)


@query("most_vivid", _px(ENTRIES_SQL + " select key, round(chroma, 6) as chroma, round(lab_l, 6) as lab_l, w from en order by chroma desc, lab_l desc, w desc, key desc limit 12"))
def most_vivid(spark, d):
    return _rounded(reports.most_vivid(_entries(spark, d)))


OTHER_SQL = ", ot as (select frame, y, x, case when (x + y) % 9 = 0 and frame % 2 = 0 then 255 - r else r end as r, g, b, a from px where x < 32 - frame % 4)"


def _other(spark, d):
    """The pixels with some changed in every second frame, and up to three columns less."""
    changed = ((F.col("x") + F.col("y")) % 9 == 0) & (F.col("frame") % 2 == 0)
    return derived_pixels(spark, d).filter(F.col("x") < SIDE - F.col("frame") % 4).withColumn("r", F.when(changed, 255 - F.col("r")).otherwise(F.col("r")))


@query("image_compare", _px(OTHER_SQL + """ select frame, case when frame % 4 <= 2 then n else 0 end as compared, case when frame % 4 <= 2 then bad else 0 end as mismatched, case when frame % 4 > 2 then 'size' when bad > 0 then 'different' else 'equal' end as status
from (select px.frame, count(*) as n, sum((px.r <> ot.r)::int)::bigint as bad from px join ot using (frame, y, x) group by px.frame)"""))
def image_compare(spark, d):
    return reports.compared(derived_pixels(spark, d), _other(spark, d))


@query("first_mismatches", _px(OTHER_SQL + " select frame, y, x from (select px.frame, px.y, px.x, row_number() over (partition by px.frame order by px.y, px.x) as k from px join ot using (frame, y, x) where px.r <> ot.r) where k <= 20"))
def first_mismatches(spark, d):
    return reports.first_mismatches(derived_pixels(spark, d), _other(spark, d))


# ---- cells as the test tools make them

@query("spread_cells", """with w as (select p_partkey, p_size as span, p_partkey % 9 + 1 as n from part where p_size >= 9),
c as (select *, unnest(range(n)) as i from w),
f as (select p_partkey, i, span // n + (i in (select unnest([floor(k * (n / (span % n)::double))::bigint for k in range(span % n)])))::int as width from c)
select p_partkey, i::int as cell, (5 + coalesce(sum(width) over (partition by p_partkey order by i rows between unbounded preceding and 1 preceding), 0))::int as start, (5 + sum(width) over (partition by p_partkey order by i))::int as "end" from f""")
def spread_cells(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").filter("p_size >= 9").withColumn("widths", grid.spread_widths(F.col("p_size").cast("int"), (F.col("p_partkey") % 9 + 1).cast("int")))
    return part.select("p_partkey", F.posexplode(grid.boundaries(F.lit(5), F.col("widths"))).alias("cell", "c")).select("p_partkey", "cell", "c.start", "c.end")


@query("px_transitions_tolerant", _px("""select distinct frame, axis, boundary from (
  select frame, 'x' as axis, x + 1 as boundary, a > 0 and lead(a) over w > 0 and greatest(abs(r - lead(r) over w), abs(g - lead(g) over w), abs(b - lead(b) over w)) > 40 as c from px window w as (partition by frame, y order by x)
  union all
  select frame, 'y', y + 1, a > 0 and lead(a) over w > 0 and greatest(abs(r - lead(r) over w), abs(g - lead(g) over w), abs(b - lead(b) over w)) > 40 from px window w as (partition by frame, x order by y)) where c"""))
def px_transitions_tolerant(spark, d):
    return grid.transitions(derived_pixels(spark, d), 40)


@query("px_vote_first_seen", _px(""", c as (select frame, (y // 5)::int as ty, (x // 5)::int as tx, r, g, b, a, count(*) as n, min(y * 32 + x) as f from px group by all),
v as (select frame, ty, tx, arg_min((r, g, b, a), (-n, f)) filter (a > 0) as p, sum(n) as area, coalesce(sum(n) filter (a > 0), 0) as o from c group by all)
select frame, ty, tx, case when o > 0 and o >= area * 0.3 then p[1] else 0 end as r, case when o > 0 and o >= area * 0.3 then p[2] else 0 end as g, case when o > 0 and o >= area * 0.3 then p[3] else 0 end as b, case when o > 0 and o >= area * 0.3 then p[4] else 0 end as a from v"""))
def px_vote_first_seen(spark, d):
    return grid.first_seen_vote(grid.cells(derived_pixels(spark, d), 5), ["frame", "ty", "tx"])


# ---- colour

@query("ramp_math", "select p_partkey, round(t * t * (3 - 2 * t), 9) as smooth, round(p_size + (90.0 - p_size) * t, 9) as line, round(((h + (((40 - h + 540.0) % 360) - 180) * t) % 360 + 360) % 360, 6) as hue, round(least(abs(h - 40.0) % 360, 360 - abs(h - 40.0) % 360), 9) as apart from (select p_partkey, p_size, (p_partkey * 7 % 360)::double as h, (p_partkey % 11) / 10.0::double as t from part)")
def ramp_math(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(k, "p_size", (k * 7 % 360).cast("double").alias("h"), ((k % 11) / F.lit(10.0)).alias("t"))
    h, t = F.col("h"), F.col("t")
    return rows.select(k, F.round(C.smoothstep(t), 9).alias("smooth"), F.round(C.lerp(F.col("p_size").cast("double"), F.lit(90.0), t), 9).alias("line"), F.round(C.lerp_hue(h, F.lit(40.0), t), 6).alias("hue"), F.round(C.circular_distance(h, F.lit(40.0)), 9).alias("apart"))


@query("accent_split", _px(CLUSTERED_SQL + """, t as (select key from cl order by w desc, key limit 5), o as (select key from cl where chroma > 0.15)
select 'accent' as part, count(*) as n, sum(w)::bigint as w from cl where key in (select key from t) union all select 'rest', count(*), sum(w)::bigint from cl where key not in (select key from t)
union all select 'neutral', count(*), coalesce(sum(w), 0)::bigint from en where chroma < 0.02 union all select 'either', count(*), sum(w)::bigint from cl where key in (select key from t union select key from o)"""))
def accent_split(spark, d):
    """Colours split in accents, the rest and neutral ones, and the union of two choices by key."""
    vivid = _clustered(spark, d)
    taken, strong = vivid.orderBy(F.desc("w"), "key").limit(5).select("key"), vivid.filter("chroma > 0.15").select("key")
    parts = {"accent": vivid.join(taken, "key", "left_semi"), "rest": palette.without(vivid, taken), "neutral": _entries(spark, d).filter(F.col("chroma") < palette.NEUTRAL), "either": vivid.join(taken.union(strong).distinct(), "key", "left_semi")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


_LIN = ("4.0767416621 * l3 - 3.3077115913 * m3 + 0.2309699292 * s3", "-1.2684380046 * l3 + 2.6097574011 * m3 - 0.3413193965 * s3", "-0.0041960863 * l3 - 0.7034186147 * m3 + 1.7076147010 * s3")


def _inside_sql(light: str, c: str, h: str) -> str:
    a, b = f"({c} * cos(radians({h})))", f"({c} * sin(radians({h})))"
    cubes = [f"pow({light} + {x} * {a} + {y} * {b}, 3)" for x, y in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))]
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
    return " and ".join(f"{' + '.join(f'({k}::double) * {q}' for k, q in zip(row, cubes))} between -1e-4 and 1.0001" for row in rows)


ORACLE_SQL["gamut_clip"] = _px(ENTRIES_SQL + f""", bs(key, lab_l, hue, wanted, i, lo, hi) as (
  select key, lab_l, hue, chroma * 3, 0, 0.0::double, chroma * 3 from en
  union all
  select key, lab_l, hue, wanted, i + 1, case when inside then mid else lo end, case when inside then hi else mid end
  from (select *, (lo + hi) * 0.5 as mid, {_inside_sql('lab_l', '((lo + hi) * 0.5)', 'hue')} as inside from bs) where i < 24)
select key, round(wanted, 6) as wanted, round(case when wanted <= 0 then 0.0 when {_inside_sql('lab_l', 'wanted', 'hue')} then wanted else lo end, 6) as clipped from bs where i = 24""").replace("with px", "with recursive px", 1)

ORACLE_SQL["px_point_sample"] = _px(f""", c as (select frame, (y // {PITCH})::int as ty, (x // {PITCH})::int as tx, r, g, b, a, count(*) as n from px group by all),
v as (select frame, ty, tx, arg_min((r, g, b, a), (-n, concat_ws(',', r, g, b, a))) filter (a > 0) as m, coalesce(sum(n) filter (a > 0), 0) as o from c group by all),
p as (select frame, (y // {PITCH})::int as ty, (x // {PITCH})::int as tx, r, g, b, a from px where y % {PITCH} = 1 and x % {PITCH} = 0)
select frame, ty, tx, {{cols}} from v join p using (frame, ty, tx)""".replace("{cols}", ", ".join(f"case when o < 3 then 0 when p.a > 0 then p.{c} else m[{i}] end as {c}" for i, c in enumerate("rgba", 1))))


@query("px_row_offsets_drift", _px(""", up as (select frame, y * 2 + i as y, x * 2 + j as x, r, g, b, case when y > 12 + frame % 9 and (x + y) % 4 <> 0 then 0 else a end as a from px, (select unnest([0, 1]) as i) p, (select unnest([0, 1]) as j) q),
bc as (select frame, y // 5 as block, sum((a > 0)::int) as cnt from up group by all), pk as (select frame, max(block) + 1 as n, max(cnt) as pc, arg_max(block, (cnt, block)) as peak from bc group by frame),
tl as (select bc.frame, avg(cnt) as tail from bc join pk using (frame) where block >= greatest(n - greatest(floor(n * 0.25), 4), peak + 1) group by bc.frame),
fi as (select frame, min(y) // 5 as first from up where a > 0 group by frame),
tr as (select frame, list(distinct boundary order by boundary) as cuts from (select frame, y + 1 as boundary, a > 0 and lead(a) over w > 0 and (r, g, b) <> (lead(r) over w, lead(g) over w, lead(b) over w) as c from up window w as (partition by frame, x order by y)) where c group by frame),
z as (select pk.*, coalesce(pc > 0 and coalesce(tail, 0) > 0 and pc >= tail * 1.6 and n >= 8 and peak >= floor(n * 0.35) and peak <= ceil(n * 0.8), false) as moved, (first + peak) // 2 - first as half, coalesce(cuts, []) as cuts from pk left join tl using (frame) left join fi using (frame) left join tr using (frame)),
u as (select *, len(cuts) > half and half > 0 as drifts, cuts[(half + 1)::int] - cuts[1] - half * 5 as drift from z)
select bc.frame, bc.block::int as block, (case when not moved then 1 when block <= peak then case when drifts then ((-drift) % 5 + 5) % 5 else 3 end else 0 end)::int as offset, moved and coalesce(drifts, false) as used_drift from bc join u using (frame)"""))
def px_row_offsets_drift(spark, d):
    """Offsets of frames of double size whose lower part is thinned out, so that their rows taper."""
    up = stencil.upscale(derived_pixels(spark, d), 2)
    y, x = F.expr("y div 2"), F.expr("x div 2")
    thin = (y > 12 + F.col("frame") % 9) & ((x + y) % 4 != 0)
    return grid.row_offsets(settled(up.withColumn("a", F.when(thin, 0).otherwise(F.col("a")))), 5)


def _greys(spark, d):
    grey = F.floor(histogram.luma()).cast("int")
    return settled(palette.entries(histogram.sprite_histogram(derived_pixels(spark, d).select("frame", "y", "x", *[grey.alias(c) for c in "rgb"], "a"))))


@query("grey_ramp_of_luma", _px(""", gh as (select distinct floor(0.299::double * r + 0.587::double * g + 0.114::double * b)::int as r from px where a > 0),
gl as (select cbrt(case when r / 255.0 >= 0.04045 then pow((r / 255.0 + 0.055) / 1.055, 2.4) else r / 255.0 / 12.92 end) as l from gh),
ge as (select list(l order by l) as ls, count(*) as n from gl), gp as (select ls[(round(0.05 * (n - 1)) + 1)::int] as lo, ls[(round(0.95 * (n - 1)) + 1)::int] as hi from ge),
gq as (select case when hi - lo < 0.05 then greatest(0, lo - 0.05) else lo end as lo, case when hi - lo < 0.05 then least(1, hi + 0.05) else hi end as hi from gp),
gn as (select *, least(greatest(floor((hi - lo) / 0.18) + 2, 2), 5)::int as n from gq), gs as (select unnest(range(1, n + 1))::int as stop, * from gn),
gt as (select stop, lo + (hi - lo) * (t * t * (3 - 2 * t)) as l from (select *, (stop - 1) / (n - 1)::double as t from gs)),
gc as (select *, pow(l, 3) as c from gt)
select stop, round(l, 4) as lightness, case when c <= 0 then 0 when c >= 1 then 255 else round((case when c >= 0.0031308 then 1.055 * pow(c, 1 / 2.4) - 0.055 else c * 12.92 end) * 255) end::int as grey from gc"""))
def grey_ramp_of_luma(spark, d):
    """The grey ramp of the pixels' luma, which has many neutral colours."""
    return ramps.grey(_greys(spark, d)).select("stop", F.round("lightness", 4).alias("lightness"), F.col("g").cast("int").alias("grey"))


@query("cluster_outliers_wide", _px(ENTRIES_SQL + """, cl as (select *, key % 3 as cluster from en where chroma >= 0.02), md as (select cluster, median(chroma) as m, count(*) as n from cl group by cluster), t as (select sum(w) as total from en)
select cluster, key, round(chroma * (1 + ln(1 + w)), 6) as score from cl join md using (cluster), t where n >= 3 and chroma > greatest(0.06, m * 1.8) and w >= (case when total < 512 then 1 else greatest(2, ceil(total / 2000.0)) end) order by round(chroma * (1 + ln(1 + w)), 9) desc, key limit 8"""))
def cluster_outliers_wide(spark, d):
    """Outliers of clusters that mix all hues."""
    every = _entries(spark, d)
    mixed = palette.chromatic(every).withColumn("cluster", F.col("key") % 3)
    return _rounded(palette.cluster_outliers(mixed, palette.totals(every).select("pixel_floor"), palette.SLOTS))


@query("sparse_clusters_single", _px(ENTRIES_SQL + """, cl as (select *, key as cluster from en where chroma >= 0.02), z as (select cluster, count(*) as n, sum(w) as mass, max(chroma) as most from cl group by cluster)
select cluster, key from cl join z using (cluster) where n <= 6 and mass <= least((select sum(w) from en) * 0.02, 64.0) and most >= 0.10 and chroma >= 0.06 order by cluster, key limit 6"""))
def sparse_clusters_single(spark, d):
    """Every colour a cluster of its own, so that rare ones are sparse."""
    every = _entries(spark, d)
    return palette.sparse_clusters(palette.chromatic(every).withColumn("cluster", F.col("key")), palette.totals(every).select("total"), 6)


def _even(spark, d):
    """The pixels without their specks, whose transitions lie on the grid of cells."""
    return settled(derived_pixels(spark, d).withColumn("r", F.col("r") - F.col("r") % 40))


def _spans(spark, d, method):
    from rasterloom.operators import cuts

    px = _even(spark, d)
    sizes = px.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return cuts.content_spans(grid.transitions(px), grid.bounds(px), sizes, PITCH, method)


@query("content_anchored_even")
def content_anchored_even(spark, d):
    return _spans(spark, d, "anchored")


@query("elastic_grid_even")
def elastic_grid_even(spark, d):
    return _spans(spark, d, "elastic")
