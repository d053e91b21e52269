"""Assay queries: lineitem as activities, supplier or part as scaffold group, price as potency."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators import assays as A
from moltables.operators import fits, histograms as H
from moltables.plans.registry import big, query, rounded, rs, table
from moltables.sources.tables import typed_assays, union_sources

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def items(spark, sf, *extra):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *extra)


@query(f"""
with c as (select a.l_suppkey g, a.l_extendedprice p, count(b.l_suppkey) c
           from (select distinct l_suppkey, l_extendedprice from lineitem) a
           left join lineitem b on a.l_suppkey = b.l_suppkey and b.l_extendedprice <= a.l_extendedprice / 10.0
           group by 1, 2),
     n as (select l_suppkey g, count(*) n from lineitem group by 1)
select {KEY}, {rs("case when n.n > 5 then c.c / n.n::double else 0 end", 8)} as prop_10x
from lineitem join c on c.g = l_suppkey and c.p = l_extendedprice join n on n.g = l_suppkey
""")
def success_rate_in_group(spark, sf):
    d = A.success_rates(items(spark, sf), "l_suppkey", "l_extendedprice")
    return d.withColumn("prop_10x", rounded("prop_10x", 8))


@query("""
select count(*) as groups, count(*) filter (n > 1) as groups_above_1, count(*) filter (n > 5) as groups_above_5,
       count(*) filter (n > 10) as groups_above_10, count(*) filter (n > 25) as groups_above_25
from (select l_partkey, count(*) n from lineitem group by 1)
""")
def group_size_summary(spark, sf):
    return A.group_size_summary(items(spark, sf), "l_partkey")


@query("select l_partkey, count(*) as n from lineitem group by 1 having count(*) > 25")
def large_groups(spark, sf):
    return A.large_groups(items(spark, sf), "l_partkey")


RANKED = """
select {key}, rank() over (partition by l_suppkey order by l_extendedprice {d}) as rank,
       count(*) over (partition by l_suppkey) as count,
       {share} as prop_improv
from lineitem
"""


@query(RANKED.format(key=KEY, d="desc", share=rs(
    "rank() over (partition by l_suppkey order by l_extendedprice desc) / (count(*) over (partition by l_suppkey))::double", 8)))
def potency_rank_descending(spark, sf):
    d = A.rank_in_group(items(spark, sf), "l_suppkey", "l_extendedprice", ascending=False)
    return d.withColumn("prop_improv", rounded("prop_improv", 8))


@query(RANKED.format(key=KEY, d="", share=rs(
    "rank() over (partition by l_suppkey order by l_extendedprice) / (count(*) over (partition by l_suppkey))::double", 8)))
def potency_rank_ascending(spark, sf):
    d = A.rank_in_group(items(spark, sf), "l_suppkey", "l_extendedprice", ascending=True)
    return d.withColumn("prop_improv", rounded("prop_improv", 8))


@query(f"select {KEY}, count(*) over (partition by l_partkey) as n from lineitem")
def group_count_attached(spark, sf):
    return A.with_group_count(items(spark, sf), ["l_partkey"])


@query("""
with f as (select o_custkey, min(o_orderkey) k from orders group by 1),
     g as (select o_custkey, row_number() over (order by k) as group_no from f)
select o_orderkey, orders.o_custkey, group_no from orders join g using (o_custkey)
""")
def first_seen_group_numbers(spark, sf):
    return A.number_groups(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("""
select o_custkey, count(*) as n, min(o_totalprice) as min_potency, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as min_label,
       max(o_totalprice) as max_potency, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as max_label,
       arg_min(o_orderpriority, o_orderkey) as scaffold
from orders group by 1
""")
def potency_extremes_per_group(spark, sf):
    return A.potency_extremes(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderkey", "o_orderpriority")


@query("select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 5")
def most_populous_groups(spark, sf):
    return A.top_groups(items(spark, sf), "l_partkey", 5)


@query(f"""
with s as (select l_returnflag r, l_partkey g from lineitem group by 1, 2 having count(*) < 5)
select {KEY}, l_quantity, l_returnflag from lineitem l
where not exists (select 1 from s where s.r = l.l_returnflag and s.g = l.l_partkey) and abs(l_quantity - l_linenumber * 7) <= 2
""")
def cleaned_groups(spark, sf):
    d = items(spark, sf, "l_quantity", "l_returnflag")
    return A.clean_groups(d, "l_returnflag", "l_partkey", F.col("l_quantity"), F.col("l_linenumber") * 7)


@query(f"""
select count(*) as n, {rs("avg(p)", 8)} as p from (
  select case when n.n > 5 then c.c / n.n::double else 0 end p
  from lineitem join (select a.l_suppkey g, a.l_extendedprice p, count(b.l_suppkey) c
           from (select distinct l_suppkey, l_extendedprice from lineitem) a
           left join lineitem b on a.l_suppkey = b.l_suppkey and b.l_extendedprice <= a.l_extendedprice / 10.0
           group by 1, 2) c on c.g = l_suppkey and c.p = l_extendedprice
  join (select l_suppkey g, count(*) n from lineitem group by 1) n on n.g = l_suppkey)
""")
def success_rate_summary(spark, sf):
    d = A.rate_summary(A.success_rates(items(spark, sf), "l_suppkey", "l_extendedprice"), "prop_10x")
    return d.withColumn("p", rounded("p", 8))


@query("select * from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def rows_of_new_targets(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.only_new(table(spark, sf, "orders"), known, "o_custkey")


@query("select l_orderkey, l_discount from lineitem where l_discount > 0 and l_discount < 0.055")
def finite_range_filter(spark, sf):
    return A.finite_between(table(spark, sf, "lineitem").select("l_orderkey", "l_discount"), "l_discount", 0.0, 0.055)


@query("""
select l_returnflag as standard_type, case l_linestatus when 'O' then '=' else '<' end as standard_relation,
       l_extendedprice as standard_value, 'nM' as standard_units, l_returnflag || l_linestatus as activity_comment,
       p_name as canonical_smiles, p_brand as chembl_id, c_name as target_name, c_mktsegment as target_chembl_id
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey
where l_linenumber <> 1 and l_quantity >= 5 and l_tax < 0.06 and l_discount > 0.01
  and o_orderstatus <> 'P' and o_orderpriority = '1-URGENT' and c_acctbal > 0
""")
def curated_activity_join(spark, sf):
    li, o, c, p = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "part"))
    act = li.select(
        F.col("l_orderkey").alias("assay_id"), F.col("l_partkey").alias("molregno"), F.col("l_returnflag").alias("standard_type"),
        F.when(F.col("l_linestatus") == "O", "=").otherwise("<").alias("standard_relation"),
        F.col("l_extendedprice").alias("standard_value"), F.lit("nM").alias("standard_units"),
        F.concat("l_returnflag", "l_linestatus").alias("activity_comment"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("potential_duplicate"), F.col("l_quantity").alias("pchembl_value"),
        F.when(F.col("l_tax") >= 0.06, "odd").alias("data_validity_comment"),
        F.when(F.col("l_discount") > 0.01, 1).otherwise(0).alias("standard_flag"))
    ass = o.select(F.col("o_orderkey").alias("assay_id"), F.col("o_custkey").alias("tid"),
                   F.when(F.col("o_orderstatus") != "P", 9).otherwise(4).alias("confidence_score"),
                   F.when(F.col("o_orderpriority") == "1-URGENT", "D").otherwise("H").alias("relationship_type"))
    st = p.select(F.col("p_partkey").alias("molregno"), F.col("p_name").alias("canonical_smiles"), F.col("p_brand").alias("chembl_id"))
    tg = c.select(F.col("c_custkey").alias("tid"), F.col("c_name").alias("pref_name"), F.col("c_mktsegment").alias("chembl_id"),
                  F.when(F.col("c_acctbal") > 0, "SINGLE PROTEIN").otherwise("ORGANISM").alias("target_type"))
    return A.activity_join(act, ass, st, tg)


@query(f"""
select p_name as smiles, try_cast(p_type as double) as potency, null::double as potency_m from part where p_type is not null
union all select o_orderpriority, try_cast(o_totalprice::varchar as double), {rs("o_totalprice * 1e-9", 12)} from orders
""")
def typed_assay_values(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_name").alias("smiles"), F.col("p_type").alias("potency"))
    b = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("smiles"), F.col("o_totalprice").cast("string").alias("potency"))
    d = typed_assays(union_sources({"a": a, "b": b}).drop("source"))
    return d.withColumn("potency_m", rounded("potency_m", 12))


@query("""
select 'lineitem' as source, l_extendedprice as value from lineitem
union all select 'orders', o_totalprice from orders union all select 'customer', c_acctbal from customer
""")
def union_of_sources(spark, sf):
    return union_sources({
        "lineitem": table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")),
        "orders": table(spark, sf, "orders").select(F.col("o_totalprice").alias("value")),
        "customer": table(spark, sf, "customer").select(F.col("c_acctbal").alias("value"))})


EDGES = H.even_edges(0.0, 0.025, 21)
_cases = " ".join(
    f"when v >= {EDGES[i]!r}::double and v {'<=' if i == 20 else '<'} {EDGES[i + 1]!r}::double then {i}" for i in range(21))


@query(f"""
with b as (select case {_cases} end bin from (select l_discount + l_tax v from lineitem)),
     c as (select bin, count(*) c from b where bin is not null group by 1)
select r.bin::int as bin, {rs("list_extract(" + str(EDGES[:-1]) + "::double[], r.bin::int + 1)", 8)} as low, coalesce(c.c, 0) as count,
       {rs("coalesce(c.c, 0) / (select sum(c) from c)::double", 8)} as fraction
from range(21) r(bin) left join c using (bin)
""")
def fixed_edge_histogram(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("v"))
    h = H.edge_histogram(d, "v", EDGES)
    return h.withColumns({"low": rounded("low", 8), "fraction": rounded("fraction", 8)})


def _range_sql(src: str, keys: str, over: str, bins: int, more: str = "") -> str:
    k = keys + ", " if keys else ""
    j = f"using ({over})" if over else "on true"
    g = f"{over}, " if over else ""
    kj = f"using ({keys}, bin)" if keys else "using (bin)"
    return f"""
with d as ({src}), s0 as (select {g}min(v) a0, max(v) b0 from d {"group by " + over if over else ""}),
s as (select {g}case when a0 = b0 then a0 - 0.5 else a0 end a, case when a0 = b0 then b0 + 0.5 else b0 end b from s0),
c as (select {k}least(floor((v - a) / (b - a) * {bins}), {bins - 1})::int bin, count(*) c from d join s {j} group by all),
f as (select * from (select distinct {keys or "1 one"} from d) cross join (select range::int bin from range({bins}))),
t as (select {k}sum(c) t from c {"group by " + keys if keys else ""})
select {k}bin, {rs(f"a + (b - a) / {bins} * bin", 6)} as low, {rs(f"a + (b - a) / {bins} * bin + (b - a) / {bins}", 6)} as high,
  {rs(f"a + (b - a) / {bins} * bin + (b - a) / {bins} / 2", 6)} as center, coalesce(c, 0) as count,
  {rs("coalesce(c, 0) / t::double", 8)} as fraction {more}
from f left join c {kj} join t {"using (" + keys + ")" if keys else "on true"} join s {j}
"""


def _six(d, *more):
    return d.withColumns({**{c: rounded(c, 6) for c in ("low", "high", "center")}, "fraction": rounded("fraction", 8),
                          **{c: rounded(c, 6) for c in more}})


@query(_range_sql("select 'l_quantity' term, l_quantity v from lineitem union all select 'l_linenumber', l_linenumber::double from lineitem "
                  "union all select 'net', l_discount * 40 from lineitem", "term", "", 30))
def shared_range_term_histograms(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("net", F.col("l_discount") * 40)
    return _six(H.term_histograms(d, ["l_quantity", "l_linenumber", "net"], 30))


@query(_range_sql(
    "select l_returnflag, 'l_quantity' property, round_even(l_quantity, 0) v from lineitem union all "
    "select l_returnflag, 'kilo', round_even(l_extendedprice / 1000, 0) from lineitem", "l_returnflag, property", "l_returnflag, property", 10))
def property_histograms_per_set(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("kilo"))
    return _six(H.property_histograms(d, "l_returnflag", ["l_quantity", "kilo"], 10))


@query(_range_sql("select event_type, value v from events", "event_type", "", 60,
                  ", " + rs("coalesce(c, 0) / t::double / ((b - a) / 60)", 6) + " as density"))
def class_density_histogram(spark, sf):
    d = table(spark, sf, "events").select("event_type", "value")
    return _six(H.density_histogram(d, "value", 60, ["event_type"]), "density")


@query(f"""
with v as (select value, count(*) n from events group by 1), t as (select sum(n) t from v)
select value, n, {rs("sum(n) over (order by value) / t::double", 8)} as cdf,
  {rs("(sum(n) over (order by value) - n) / t::double", 8)} as cdf_before from v, t
""")
def empirical_distribution(spark, sf):
    d = H.empirical_cdf(table(spark, sf, "events").select("value"), "value")
    return d.withColumns({"cdf": rounded("cdf", 8), "cdf_before": rounded("cdf_before", 8)})


@query(f"""
with v as (select value, count(*) n from events group by 1), t as (select sum(n) t from v),
e as (select 1 - exp(-value / 50.0) f, sum(n) over (order by value) / t::double hi, (sum(n) over (order by value) - n) / t::double lo from v, t)
select {rs("max(greatest(abs(f - hi), abs(f - lo)))", 8)} as ks from e
""")
def ks_distance_to_given(spark, sf):
    d = H.ks_against(table(spark, sf, "events"), "value", 1 - F.exp(-F.col("value") / 50.0))
    return d.select(rounded("ks", 8).alias("ks"))


@query(f"""
with v as (select value, count(*) filter (event_type = 'click') a, count(*) filter (event_type <> 'click') b from events group by 1),
t as (select sum(a) ta, sum(b) tb from v)
select {rs("max(d)", 8)} as ks from (select abs(sum(a) over (order by value) / ta::double - sum(b) over (order by value) / tb::double) d from v, t)
""")
def ks_distance_two_samples(spark, sf):
    d = H.ks_two_samples(table(spark, sf, "events"), "value", F.col("event_type") == "click")
    return d.select(rounded("ks", 8).alias("ks"))


@query(f"""
with v as (select l_discount + l_tax v from lineitem), h as (select stddev_samp(v) * pow(count(*)::double, -0.2) h from v),
w as (select v, count(*) w from v group by 1),
g as (select range::int i, 0.0::double + range * (1.0::double / 99) x from range(100)),
k as (select i, x, sum(w * exp(-0.5 * pow((x - v) / h, 2.0))) raw from g, w, h group by all)
select i, {rs("x", 8)} as x, {rs("raw / sum(raw) over ()", 8)} as density from k
""")
def kernel_density_curve(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("v"))
    k = H.kernel_density(d, "v", 0.0, 1.0, 100)
    return k.withColumns({"x": rounded("x", 8), "density": rounded("density", 8)})


@query(f"""
select {rs("regr_slope(l_extendedprice, ln(l_quantity))", 4)} as a, {rs("regr_intercept(l_extendedprice, ln(l_quantity))", 4)} as b,
  {rs("regr_r2(l_extendedprice, ln(l_quantity))", 8)} as r2, count(*) as n from lineitem where l_quantity > 0
""")
def logarithmic_fit(spark, sf):
    d = fits.log_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return d.withColumns({"a": rounded("a", 4), "b": rounded("b", 4), "r2": rounded("r2", 8)})


_FIT = """
with f as (select regr_slope(l_extendedprice, l_quantity) slope, regr_intercept(l_extendedprice, l_quantity) intercept,
  regr_r2(l_extendedprice, l_quantity) r2, count(*) n, avg(l_quantity) x_mean, regr_sxx(l_extendedprice, l_quantity) sxx,
  min(l_quantity) x_min, max(l_quantity) x_max,
  sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)) s
  from lineitem)
"""


@query(f"""{_FIT} select {rs("slope", 4)} as slope, {rs("intercept", 3)} as intercept, {rs("r2", 8)} as r2, n, {rs("x_mean", 6)} as x_mean,
{rs("sxx", 1)} as sxx, x_min, x_max, {rs("s", 3)} as s_residual from f""")
def linear_fit_summary(spark, sf):
    d = fits.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    digits = {"slope": 4, "intercept": 3, "r2": 8, "x_mean": 6, "sxx": 1, "s_residual": 3}
    return d.withColumns({c: rounded(c, k) for c, k in digits.items()})


# The t quantile by its expansion in 1/v around the normal quantile; exact to far below the rounding here.
_Z = "1.959963984540054"
_T = (f"({_Z} + (pow({_Z}, 3) + {_Z}) / (4.0 * (n - 2)) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96.0 * (n - 2) * (n - 2)))")


@query(f"""{_FIT} select i::int as i, {rs("gx", 6)} as x, {rs("slope * gx + intercept", 2)} as y,
{rs(f"{_T} * s * sqrt(1.0 / n + pow(gx - x_mean, 2) / sxx)", 2)} as confidence,
{rs(f"{_T} * s * sqrt(1 + 1.0 / n + pow(gx - x_mean, 2) / sxx)", 2)} as prediction
from (select *, x_min + (x_max - x_min) * i / 99.0 gx from f, range(100) r(i))""")
def linear_fit_bands(spark, sf):
    d = fits.fit_bands(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return d.withColumns({"x": rounded("x", 6), "y": rounded("y", 2), "confidence": rounded("confidence", 2), "prediction": rounded("prediction", 2)})


@query(f"""
with d as (select embedding[3 * i + 1]::double a, embedding[3 * i + 2]::double b, embedding[3 * i + 3]::double z from embeddings, range(22) r(i)),
m as (select floor((z + 0.4) / 0.04)::int bin, count(*) c, avg(a) ma, avg(b) mb from d where z >= -0.4 and z < 0.4 group by 1)
select r.bin::int as bin, {rs("-0.4 + (r.bin + 0.5) * 0.04", 8)} as center, coalesce(c, 0) as count, {rs("ma", 8)} as mean_a, {rs("mb", 8)} as mean_b
from range(20) r(bin) left join m using (bin)
""")
def axis_binned_means(spark, sf):
    at = lambda i: F.get("embedding", i).cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.struct(at(3 * i).alias("a"), at(3 * i + 1).alias("b"), at(3 * i + 2).alias("z")))
    d = table(spark, sf, "embeddings").select(F.explode(pts).alias("p")).select("p.*")  # the last point lacks b and z
    m = H.binned_means(d, "z", ["a", "b"], -0.4, 0.04, 20)
    return m.withColumns({c: rounded(c, 8) for c in ("center", "mean_a", "mean_b")})


@query(f"""
with p as (select user_id, floor(value / 10.0)::int bin, sum(value) / (25.0 * 10.0) d from events where value >= 0 and value < 300 group by all),
n as (select count(distinct user_id) n from events),
s as (select bin, sum(d) s, sum(d * d) s2 from p group by 1)
select r.bin::int as bin, (r.bin + 0.5) * 10.0::double as center, {rs("coalesce(s, 0) / n", 6)} as mean,
  {rs("sqrt(greatest(coalesce(s2, 0) / n - pow(coalesce(s, 0) / n, 2), 0))", 6)} as sd
from range(30) r(bin) left join s using (bin), n
""")
def axis_density_over_frames(spark, sf):
    d = table(spark, sf, "events").select("user_id", "value")
    a = H.axis_density(d, "user_id", "value", F.col("value"), 0.0, 10.0, 30, 25.0, d)
    return a.withColumns({"mean": rounded("mean", 6), "sd": rounded("sd", 6)})


@query(f"""
with m as (select ceil(v * 20)::int - 1 bin, count(*) c, avg(l_quantity) m from (select l_discount + l_tax v, l_quantity from lineitem) where v > 0 and v <= 1 group by 1)
select r.bin::int as bin, coalesce(c, 0) as count, {rs("m", 6)} as mean from range(20) r(bin) left join m using (bin)
""")
def right_closed_bin_means(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("v"), "l_quantity")
    return H.right_closed_means(d, "v", "l_quantity").withColumn("mean", rounded("mean", 6)).withColumn("count", big("count"))
