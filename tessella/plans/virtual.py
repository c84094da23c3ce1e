"""Virtual slides over the driver's tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import colour
from tessella.functions.geometry import int_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    mpp = F.when(k % 11 != 0, (F.lit(250) + (k % 4) * 83).cast("double") / F.lit(1000.0))
    return table(spark, sf_dir, "part").select(
        k.alias("slide"),
        (F.lit(1000) + s * 173 + k % 97).alias("w"),
        (F.lit(800) + s * 131 + k % 89).alias("h"),
        F.when(k % 3 == 0, 256).otherwise(240).cast("bigint").alias("t"),
        mpp.alias("mpp"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slides(spark, sf_dir).withColumn("l", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(d).cast("bigint").alias("d")) for i, d in enumerate((1, 4, 16))])))
    s = s.select("slide", "w", "h", "t", "mpp", F.col("l.level").alias("level"), int_div("w", F.col("l.d")).alias("lw"), int_div("h", F.col("l.d")).alias("lh"))
    return s.withColumn("ds", F.col("w").cast("double") / F.col("lw").cast("double"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    out = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("slide"),
        (k % 8).alias("tile_x"),
        (int_div(k, 8) % 8).alias("tile_y"),
        F.floor(F.col("l_quantity") * 5).cast("int").alias("r"),
        ((F.round(F.col("l_discount") * 100).cast("int") * 25) % 256).alias("g"),
        ((F.round(F.col("l_tax") * 100).cast("int") * 30) % 256).alias("b"),
    )
    return out.withColumn("intensity", colour.luma("r", "g", "b"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    out = table(spark, sf_dir, "embeddings").select(int_div(v, 64).alias("slide"), (v % 8).alias("tile_x"), (int_div(v, 8) % 8).alias("tile_y"), F.posexplode("embedding").alias("pos", "e"))
    i = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.col("e").cast("double") * 256 + 128).cast("double"))).cast("int")
    return out.select("slide", "tile_x", "tile_y", (F.col("pos") % 8).cast("bigint").alias("px"), int_div(F.col("pos"), 8).alias("py"), i.alias("intensity"))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gray(spark, sf_dir).groupBy("slide", F.col("tile_x").alias("ox"), F.col("tile_y").alias("oy"))
    return g.agg(int_div(F.sum("intensity"), F.count(F.lit(1))).cast("int").alias("g"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Vendor Image Library v1|"),
        F.when(k % 5 == 0, "AppMag = bad").when(k % 5 == 1, "Other = 1").otherwise(F.concat(F.lit("AppMag = "), ((k % 2 + 1) * 20).cast("string"))),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("| MPP = 0."), (k % 4 * 83 + 250).cast("string"))),
        F.when(k % 6 == 0, "|LABEL 1x1").when(k % 6 == 1, "|macro 1x1").otherwise(""),
    )
    return table(spark, sf_dir, "part").select(k.alias("slide"), text.alias("description"), F.when(k % 6 != 2, 240).alias("tile_w"))


def tile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("slide"),
        F.col("event_id"),
        (~F.col("event_type").isin("error", "signup")).alias("kept"),
        (F.col("value") / F.lit(400.0)).cast("float").alias("fraction"),
    )


V_SLIDES = """v_slides as (select p_partkey as slide, 1000 + p_size::bigint * 173 + p_partkey % 97 as w, 800 + p_size::bigint * 131 + p_partkey % 89 as h,
  (case when p_partkey % 3 = 0 then 256 else 240 end)::bigint as t,
  case when p_partkey % 11 = 0 then null else cast(250 + (p_partkey % 4) * 83 as double) / cast(1000 as double) end as mpp from part)"""
V_LEVELS = V_SLIDES + """, v_levels as (select slide, w, h, t, mpp, level, w // d as lw, h // d as lh, cast(w as double) / cast(w // d as double) as ds
  from v_slides, (values (0, 1), (1, 4), (2, 16)) as x(level, d))"""
V_PIXELS = """v_rgb as (select l_suppkey as slide, l_orderkey % 8 as tile_x, (l_orderkey // 8) % 8 as tile_y, cast(floor(l_quantity * 5) as int) as r,
  (cast(round(l_discount * 100) as int) * 25) % 256 as g, (cast(round(l_tax * 100) as int) * 30) % 256 as b from lineitem),
v_pixels as (select *, (2126 * r + 7152 * g + 722 * b) // 10000 as intensity from v_rgb)"""
V_GRAY = """v_e as (select vec_id, unnest(embedding) as e, unnest(range(0, len(embedding))) as pos from embeddings),
v_gray as (select vec_id // 64 as slide, vec_id % 8 as tile_x, (vec_id // 8) % 8 as tile_y, pos % 8 as px, pos // 8 as py,
  cast(greatest(0, least(255, floor(cast(e as double) * 256 + 128))) as int) as intensity from v_e)"""
V_OVERVIEW = V_GRAY + """, v_overview as (select slide, tile_x as ox, tile_y as oy, cast(cast(sum(intensity) as bigint) // count(*) as int) as g from v_gray group by all)"""
V_DESCRIPTIONS = """v_descriptions as (select p_partkey as slide, 'Vendor Image Library v1|'
  || case p_partkey % 5 when 0 then 'AppMag = bad' when 1 then 'Other = 1' else 'AppMag = ' || ((p_partkey % 2 + 1) * 20) end
  || case when p_partkey % 7 = 0 then '' else '| MPP = 0.' || (p_partkey % 4 * 83 + 250) end
  || case p_partkey % 6 when 0 then '|LABEL 1x1' when 1 then '|macro 1x1' else '' end as description,
  case when p_partkey % 6 = 2 then null else 240 end as tile_w from part)"""
V_EVENTS = """v_events as (select user_id as slide, event_id, event_type not in ('error', 'signup') as kept, cast(value / cast(400 as double) as float) as fraction from events)"""


def otsu_sql(name: str, source: str, keys: str) -> str:
    """CTEs ending in `name`: keys, threshold, from source(keys, intensity, n)."""
    return f"""{name}_a as (select *, sum(n) over w as wb, sum(intensity * n) over w as sb, sum(n) over p as total, sum(intensity * n) over p as mass from {source}
  window w as (partition by {keys} order by intensity), p as (partition by {keys})),
{name}_b as (select *, case when total = wb then 0.0 else wb::double * (total - wb)::double * power(sb::double / wb::double - (mass - sb)::double / (total - wb)::double, 2) end as v from {name}_a),
{name}_c as (select *, row_number() over (partition by {keys} order by v desc, intensity) as rn from {name}_b),
{name} as (select {keys}, case when v > 0 then intensity else 0 end::int as threshold from {name}_c where rn = 1)"""
