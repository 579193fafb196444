"""Queries for names, keys, classes, bands, geometry and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgauge.functions.numbers import rounded
from sparkgauge.operators import parse
from sparkgauge.plans.registry import query, table

R6 = rounded

NORM = r"""
with b as ({src}), f as (select *, regexp_replace(trim(lower(regexp_replace({col}, '\.[A-Za-z]{{2,4}}$', ''))), '\s*\([0-9]+\)\s*$', '') as base from b)
select {keep}, case when regexp_extract(base, 'snap[\s_-]*0*([0-9]+)', 1) <> '' then 'snap-' || regexp_extract(base, 'snap[\s_-]*0*([0-9]+)', 1) else trim(regexp_replace(replace(base, '_', ' '), '\s+', ' ', 'g')) end as name_key from f"""


@query("p1_norm_key", NORM.format(src="select p_partkey, case when p_size < 10 then 'Field_Snap_0' || p_partkey || ' ' || p_size || 'h (2).TIF' else upper(p_name) || '_A (' || p_partkey || ').tif' end as raw from part", col="raw", keep="p_partkey"))
def p1(spark, d):
    """Snaps of the small parts, names of the others."""
    number = F.col("p_partkey").cast("string")
    snap = F.concat(F.lit("Field_Snap_0"), number, F.lit(" "), F.col("p_size").cast("string"), F.lit("h (2).TIF"))
    raw = F.when(F.col("p_size") < 10, snap).otherwise(F.concat(F.upper("p_name"), F.lit("_A ("), number, F.lit(").tif")))
    return table(spark, d, "part").select("p_partkey", parse.norm_key(raw).alias("name_key"))


@query("p2_classify_domain", r"""select page_id, case when regexp_matches(url, '^https?://m\.') then 'mobile' when regexp_matches(url, '\.net/') then 'net' when regexp_matches(url, '\.org/') then 'org' else 'com' end as domain from pages""")
def p2(spark, d):
    rules = [(r"^https?://m\.", "mobile"), (r"\.net/", "net"), (r"\.org/", "org")]
    return table(spark, d, "pages").select("page_id", parse.classify(F.col("url"), rules, "com").alias("domain"))


@query("p3_composite_ids", r"""select page_id, coalesce(nullif(regexp_extract(url, '\.(example\.[a-z]+)/', 1), ''), 'none') as host, regexp_extract(url, '/([a-z]{2})/', 1) as lang,
  coalesce(try_cast(nullif(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1), '') as bigint), try_cast(nullif(regexp_extract(url, 'page=(\d+)', 1), '') as bigint)) as number from pages""")
def p3(spark, d):
    u = F.col("url")
    num = lambda p: F.nullif(F.regexp_extract(u, p, 1), F.lit("")).try_cast("bigint")
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(F.nullif(F.regexp_extract(u, r"\.(example\.[a-z]+)/", 1), F.lit("")), F.lit("none")).alias("host"),
        F.regexp_extract(u, r"/([a-z]{2})/", 1).alias("lang"), F.coalesce(num(r"/(\d+)(?:[?#].*)?$"), num(r"page=(\d+)")).alias("number"),
    )


@query("p4_canonical_labels", "select c_custkey, coalesce(r_name, n_name) as label from customer join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and n_regionkey % 2 = 0")
def p4(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    mapping = nation.join(region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_regionkey") % 2 == 0)).select(F.col("n_name").alias("label"), F.col("r_name").alias("canonical"))
    named = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return parse.canonicalise(named, "n_name", mapping, "label").select("c_custkey", "label")


@query("p5_classify_text", """select doc_id, case when regexp_matches(lower(text), 'rights reserved') then 'reserved' when regexp_matches(lower(text), 'public license') then 'copyleft'
  when regexp_matches(lower(text), 'license') then 'permissive' when regexp_matches(text, '@') then 'contact' else 'plain' end as class from documents""")
def p5(spark, d):
    rules = [("(?i)rights reserved", "reserved"), ("(?i)public license", "copyleft"), ("(?i)license", "permissive"), ("@", "contact")]
    return table(spark, d, "documents").select("doc_id", parse.classify(F.col("text"), rules, "plain").alias("class"))


@query("p6_fold", "select doc_id, md5(regexp_replace(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]', '', 'g')) as folded from documents")
def p6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(parse.fold(F.col("text")).cast("binary")).alias("folded"))


@query("p7_bands", """select l_orderkey, l_linenumber, ((l_quantity >= 10)::int + (l_quantity >= 25)::int + (l_quantity >= 40)::int)::bigint as left_band,
  ((l_quantity > 10)::int + (l_quantity > 25)::int + (l_quantity > 40)::int)::bigint as right_band from lineitem""")
def p7(spark, d):
    q, edges = F.col("l_quantity"), [10, 25, 40]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.band(q, edges).alias("left_band"), parse.band(q, edges, "right").alias("right_band"))


@query("p8_extract_timestamp", "select event_id, date_trunc('second', ts) as seen from events")
def p8(spark, d):
    note = F.concat(F.lit("acquired "), F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.lit(" by "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", parse.extract_ts(note).cast("timestamp_ntz").alias("seen"))


@query("p9_hash_key", "select doc_id, md5(text) as full_key, substr(md5(text), 1, 10) as prefix from documents")
def p9(spark, d):
    name = F.concat(F.lit("img_"), F.md5(F.col("text").cast("binary")), F.lit("_final.png"))
    key = F.regexp_extract(name, "([0-9a-f]{32})", 1)
    return table(spark, d, "documents").select("doc_id", key.alias("full_key"), F.substring(key, 1, 10).alias("prefix"))


@query("p10_hierarchical_keys", """select doc_id, source || '||' || coalesce(nullif(lang, ''), 'None') as unit_key, source || '||' || coalesce(nullif(lang, ''), 'None') || '||c' || (doc_id // 100) as series_key,
  lpad((doc_id % 100)::varchar, 4, '0') as sort_key from documents""")
def p10(spark, d):
    unit = F.concat_ws("||", "source", F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("None")))
    block = F.call_function("div", F.col("doc_id"), F.lit(100)).cast("string")
    return table(spark, d, "documents").select("doc_id", unit.alias("unit_key"), F.concat(unit, F.lit("||c"), block).alias("series_key"), F.lpad((F.col("doc_id") % 100).cast("string"), 4, "0").alias("sort_key"))


@query("p11_area_units", """select l_orderkey, l_linenumber, round(100 * l_quantity / 640, 6) as pct, round(l_quantity * 0.65 * 0.65, 6) as um2, round(l_quantity * (830.0 / 640) * (830.0 / 640), 6) as um2_field, 100 * l_quantity / 640 < 1.0 as low from lineitem""")
def p11(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", R6(100 * q / 640).alias("pct"), R6(q * 0.65 * 0.65).alias("um2"), R6(q * (830.0 / 640) * (830.0 / 640)).alias("um2_field"), (100 * q / 640 < 1.0).alias("low")
    )


VARIANT = "with b as (select c_custkey as k, c_acctbal / 10000 as v from customer)"


@query("p12_variants", f"{VARIANT} select k, 'raw' as variant, round(v, 6) as v from b union all select k, 'clipped', round(least(greatest(v, 0), 1), 6) from b union all select k, 'nonnegative', round(v, 6) from b where v >= 0")
def p12(spark, d):
    """All three variants in one pass over the rows."""
    v = F.col("v")
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000).alias("v"))
    tag = lambda n, c: F.struct(F.lit(n).alias("variant"), c.alias("v"))
    some = F.array(tag("raw", v), tag("clipped", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))), F.when(v >= 0, tag("nonnegative", v)))
    return b.select("k", F.explode(F.filter(some, lambda x: x.isNotNull())).alias("x")).select("k", "x.variant", R6(F.col("x.v")).alias("v"))


POLY = """with p as (select l_orderkey as k, list(l_linenumber::double order by l_linenumber, l_partkey, l_quantity) as x, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as y from lineitem group by 1)"""


def _polygons(spark, d):
    """One polygon an order: line number and quantity of its lines."""
    points = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("x"), "l_partkey", F.col("l_quantity").alias("y"))))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(points.alias("p")).select("k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("p13_polygon_area", POLY + """ select k, round(case when len(x) < 3 then 0.0 else abs(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i % len(x) + 1] - x[i % len(x) + 1] * y[i]))) / 2.0 end, 6) as area from p""")
def p13(spark, d):
    return _polygons(spark, d).select("k", R6(parse.shoelace(F.col("x"), F.col("y"))).alias("area"))


@query("p14_normalise_coords", """with c as (select l_orderkey, l_linenumber, l_partkey, [(l_quantity - 5) / 40, l_extendedprice / 50000, (l_quantity + 10) / 40, (l_extendedprice - 5000) / 50000, l_quantity / 40, null] as s from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(list_sum(list_transform(s, lambda x: least(greatest(x, 0), 1))), 6) as total, len(list_filter(s, lambda x: x < 0 or x > 1))::bigint as clamped from c""")
def p14(spark, d):
    """Triangles on a canvas of 40 by 50000, some of them over its edge, their last coordinate lost."""
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    coords = F.array(q - 5, e, q + 10, e - 5000, q, F.lit(None).cast("double"))
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parse.normalise_coords(coords, F.lit(40.0), F.lit(50000.0)).alias("n"))
    total = F.aggregate("n.coords", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R6(total).alias("total"), F.col("n.clamped").cast("bigint").alias("clamped"))


@query("p15_vector_correlation", """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
z as (select vec_id, list_transform(e, lambda x: (x - list_avg(e)) / greatest(list_stddev_pop(e), 1e-6)) as e from v)
select a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / 64, 5) as r from z a join z b on b.vec_id = a.vec_id + 1""")
def p15(spark, d):
    z = parse.zscored(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", "e").select("vec_id", "e")
    return z.alias("a").join(z.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(parse.vec_corr(F.col("a.e"), F.col("b.e")), 5).alias("r"))


@query("p16_closed_vocabulary", "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'pending' end as decision from orders")
def p16(spark, d):
    vocabulary = F.create_map(*[F.lit(x) for pair in {"F": "final", "O": "open", "P": "pending"}.items() for x in pair])
    known = F.coalesce(vocabulary[F.col("o_orderstatus")], F.raise_error(F.concat(F.lit("unknown decision "), F.coalesce("o_orderstatus", F.lit("(blank)")))))
    return table(spark, d, "orders").select("o_orderkey", known.alias("decision"))


@query("p17_reclassify", "select doc_id, case when toxic = 1 then 'toxic' when quality = 0 then 'low' else lang end as class, case when toxic = 1 or quality = 0 then 'annotation' else 'catalogue' end as origin from documents left join labels using (doc_id)")
def p17(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    new = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
    return j.select("doc_id", F.coalesce(new, "lang").alias("class"), F.when(new.isNotNull(), "annotation").otherwise("catalogue").alias("origin"))
