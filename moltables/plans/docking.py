"""Score queries: line items as docked poses (part = compound, supplier = directory, price = minus score)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators import ordered as O
from moltables.operators import progress as P
from moltables.operators import scores as D
from moltables.operators import similarity as M
from moltables.plans.registry import query, rounded, rs, table
from moltables.sources import scores as SS
from moltables.sources.lines import lines_from

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
K = ", ".join(KEY)


def poses(spark, sf, *extra):
    return table(spark, sf, "lineitem").select(*KEY, (-F.col("l_extendedprice")).alias("score"), *extra)


_POSES = f"p as (select {K}, -l_extendedprice score from lineitem)"


@query(f"with {_POSES} select {K}, score from (select *, row_number() over (partition by l_partkey order by score, {K}) r from p) where r = 1")
def best_score_per_compound(spark, sf):
    return D.best_per_compound(poses(spark, sf), F.col("l_partkey"), "score", KEY)


@query("""
with p as (select 'Z' || l_partkey || '.' || l_linenumber as name, -l_extendedprice score, l_orderkey, l_suppkey from lineitem)
select split_part(name, '.', 1) as compound, min(score) as score, arg_min(name, (score, name, l_orderkey, l_suppkey)) as name from p group by 1
""")
def best_score_per_base_compound(spark, sf):
    name = F.concat(F.lit("Z"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    d = poses(spark, sf).withColumn("name", name)
    b = D.best_per_compound(d, D.base_compound(F.col("name")), "score", ("name", "l_orderkey", "l_suppkey"))
    return b.select(D.base_compound(F.col("name")).alias("compound"), "score", "name")


@query(f"with {_POSES} select {K}, score, row_number() over (order by score, {K}) as rank from p")
def globally_ranked_poses(spark, sf):
    return O.ordered(poses(spark, sf), [], ["score", *KEY]).row_number("rank").result()


@query(f"with {_POSES} select {K}, score from p order by score, {K}")
def scores_sorted(spark, sf):
    return D.sorted_scores(poses(spark, sf), "score", *KEY)


@query(f"with {_POSES} select {K}, score from p order by score, {K} limit 500")
def top_500_molecules(spark, sf):
    return D.top_scores(poses(spark, sf), "score", KEY, 500)


@query(f"""
with {_POSES}, f as (select s_suppkey from supplier where s_acctbal > 2000)
select {K}, score from (select *, row_number() over (partition by l_partkey order by score, {K}) r from p where l_suppkey in (select * from f) and score <= -50000) where r = 1
""")
def finished_directory_scores(spark, sf):
    fin = table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("l_suppkey"))
    return D.collect_scores(poses(spark, sf), fin, "l_suppkey", "score", F.col("l_partkey"), KEY, limit=-50000.0)


@query(f"""
with {_POSES}, t as (select * from p order by score, {K} limit 300)
select l_suppkey, string_agg(distinct l_linenumber::varchar, ' ' order by l_linenumber::varchar) as indexes from t group by 1
""")
def pose_fetch_list(spark, sf):
    d = D.fetch_list(poses(spark, sf), "score", KEY, 300, "l_suppkey", "l_linenumber")
    return d.select("l_suppkey", F.array_join(F.transform("indexes", lambda i: i.cast("string")), " ").alias("indexes"))


_WANT = "w as (select distinct p_partkey from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3'))"


def _wanted(spark, sf):
    return table(spark, sf, "part").filter("p_brand in ('Brand#1', 'Brand#2', 'Brand#3')").select(F.col("p_partkey").alias("l_partkey"))


@query(f"""
with {_POSES}, {_WANT}
select {K}, score from (select *, row_number() over (partition by l_partkey order by score, l_orderkey, l_linenumber, l_suppkey) r from p
  where score < -90000 and l_partkey in (select * from w)) where r = 1
""")
def best_pose_of_wanted(spark, sf):
    return D.best_poses(poses(spark, sf), _wanted(spark, sf), "l_partkey", "score", ("l_orderkey", "l_linenumber", "l_suppkey"), -90000.0)[0]


@query(f"with {_POSES}, {_WANT} select p_partkey as l_partkey from w where p_partkey not in (select l_partkey from p where score < -90000)")
def wanted_without_pose(spark, sf):
    return D.best_poses(poses(spark, sf), _wanted(spark, sf), "l_partkey", "score", ("l_orderkey", "l_linenumber", "l_suppkey"), -90000.0)[1]


@query("""
select l_quantity, l_discount, l_suppkey, arg_min(l_orderkey, (l_orderkey, l_linenumber, l_partkey)) as l_orderkey from lineitem group by 1, 2, 3
""")
def identical_poses_dropped(spark, sf):
    d = table(spark, sf, "lineitem").select(*KEY, "l_quantity", "l_discount")
    u = D.drop_identical(d, ["l_quantity", "l_discount", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return u.select("l_quantity", "l_discount", "l_suppkey", "l_orderkey")


@query("""
with c as (select l_extendedprice v, sum(count(*)) over (order by l_extendedprice) n from lineitem group by 1)
select o_orderkey, o_totalprice, greatest(1, coalesce(n, 0))::bigint as rank from orders asof left join c on o_totalprice >= v
""")
def rank_against_reference(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.rank_against(o, "o_totalprice", table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")


def _receptor():
    return F.translate(F.replace("o_orderpriority", F.lit(" "), F.lit("_")), "-", ".")


@query(f"""
with p as (select distinct unnest(string_split(o_orderpriority, '-')) part from orders), e as (select part, -length(part)::double energy from p),
q as (select o_orderkey, unnest(string_split(o_orderpriority, '-')) part, o_custkey * 2.5 e12, o_totalprice * 2.5 e13 from orders)
select o_orderkey, {rs("sum(energy)", 4)} as receptor_energy, {rs("any_value(e12)", 4)} as e12, {rs("any_value(e13)", 4)} as e13,
  {rs("sum(energy) + any_value(e12) + any_value(e13)", 4)} as total from q join e using (part) group by 1
""")
def rescored_receptors(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", _receptor().alias("receptor"), F.col("o_custkey").cast("double").alias("e12"), F.col("o_totalprice").alias("e13"))
    parts = o.select(F.explode(F.split("receptor", r"\.")).alias("part")).distinct().withColumn("energy", -F.length("part").cast("double"))
    d = D.rescore(o, "receptor", parts, ["e12", "e13"], ["o_orderkey"], 2.5)
    return d.select("o_orderkey", *[rounded(c, 4).alias(c) for c in ("receptor_energy", "e12", "e13", "total")])


_KIND = "case event_type when 'signup' then 'scored' when 'view' then 'bump' when 'purchase' then 'no_match' when 'click' then 'clash' else 'counter' end"


@query(f"""
with e as (select {_KIND} kind, user_id compound, value from events)
select {", ".join(f"null::double as total_{c}" if c != "secs" else rs("sum(value) filter (kind = 'counter')", 4) + " as total_secs"
                  for c in ("min_steps", "hierarchies", "orients", "conformations", "nodes", "complexes", "secs", "hours"))},
  count(distinct compound) filter (kind <> 'counter') as docked,
  {", ".join(f"count(distinct compound) filter (kind = '{k}') as {k}" for k in ("scored", "bump", "no_match", "no_viable", "clash", "skip", "misc"))} from e
""")
def run_log_totals(spark, sf):
    kind = (F.when(F.col("event_type") == "signup", "scored").when(F.col("event_type") == "view", "bump")
            .when(F.col("event_type") == "purchase", "no_match").when(F.col("event_type") == "click", "clash").otherwise("counter"))
    e = table(spark, sf, "events").select(kind.alias("kind"), F.col("user_id").alias("compound"), "value").withColumn(
        "counter", F.when(F.col("kind") == "counter", "secs"))
    return D.run_totals(e).withColumn("total_secs", rounded("total_secs", 4))


@query("select event_type, count(distinct user_id) as n from events group by 1")
def distinct_per_class(spark, sf):
    return D.distinct_by_class(table(spark, sf, "events"), "event_type", "user_id")


# One run log per user: header, result rows, closing line, counters.
_LOG_KIND = "case event_type when 'signup' then 'scored' when 'view' then 'bump' when 'purchase' then 'no_match' when 'click' then 'no_viable' else 'misc' end"


@query(f"""
select kind, compound, counter, {rs("sum(value)", 4)} as value, count(*) as n from (
  select {_LOG_KIND} kind, 'ZINC' || event_id % 50 as compound, null as counter, null::double as value from events
  union all select 'counter', null, 'secs', max(value) from events group by user_id
  union all select 'counter', null, 'hours', 1.5 from events group by user_id
  union all select 'counter', null, 'hierarchies', count(*)::double from events group by user_id) group by all
""")
def run_log_parsed(spark, sf):
    e = table(spark, sf, "events")
    file = F.concat(F.lit("log_"), F.col("user_id").cast("string"))
    zinc = F.concat(F.lit("ZINC"), (F.col("event_id") % 50).cast("string"))
    text = (F.when(F.col("event_type") == "signup", F.concat(F.lit("1 "), zinc, F.lit(" x" * 19)))
            .when(F.col("event_type") == "view", F.concat(F.lit("2 "), zinc, F.lit(" bump in the way")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("3 "), zinc, F.lit(" no_match found")))
            .when(F.col("event_type") == "click", F.concat(F.lit("4 "), zinc, F.lit("  No viable poses.")))
            .otherwise(F.concat(F.lit("5 "), zinc, F.lit(" odd"))))
    rows = e.select(file.alias("file"), (F.col("event_id") + 10).alias("at"), text.alias("text"))
    users = e.groupBy(file.alias("file")).agg(F.max("value").alias("m"), F.count("*").alias("n"), F.max("event_id").alias("last"))
    head = users.select("file", F.lit(1).cast("bigint").alias("at"), F.lit(" mol#  id_num").alias("text"))
    tail = users.select("file", F.explode(F.array(
        F.struct((F.col("last") + 20).alias("at"), F.lit(" we reached the end of the file").alias("text")),
        F.struct((F.col("last") + 21).alias("at"), F.lit(" close SDIFILE").alias("text")),
        F.struct((F.col("last") + 22).alias("at"), F.concat(F.lit(" total number of hierarchies: "), F.col("n").cast("string")).alias("text")),
        F.struct((F.col("last") + 23).alias("at"), F.concat(F.lit("elapsed time (sec): "), F.format_string("%.2f", "m"), F.lit(" (hour): 1.5")).alias("text")),
    )).alias("t")).select("file", "t.at", "t.text")
    lines = lines_from(rows.unionByName(head).unionByName(tail), F.col("file"), F.col("at"), F.col("text"))
    ev = SS.run_log_events(lines)
    return ev.groupBy("kind", "compound", "counter").agg(rounded(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))


@query(f"""
with e as (select o_custkey, -o_totalprice / 20000 e, o_orderstatus = 'F' i from orders), m as (select *, min(e) over (partition by o_custkey) lo from e)
select o_custkey, {rs("sum(case when i then exp(-(e - lo) / 0.593) else 0 end) / sum(exp(-(e - lo) / 0.593))", 8)} as preference from m group by 1
""")
def boltzmann_preferences(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (-F.col("o_totalprice") / 20000).alias("e"), "o_orderstatus")
    d = D.boltzmann_preference(o, ["o_custkey"], "e", F.col("o_orderstatus") == "F")
    return d.withColumn("preference", rounded("preference", 8))


@query(f"""
with e as (select o_custkey, o_orderstatus, floor(-o_totalprice / 100000) e, string_split(o_orderpriority, '-') parts from orders),
p as (select distinct o_custkey, unnest(parts) part from e),
i as (select distinct p.o_custkey, p.part, e.o_orderstatus, e.e from p join e on e.o_custkey = p.o_custkey and list_contains(e.parts, p.part)),
o as (select distinct p.o_custkey, p.part, e.o_orderstatus, e.e from p join e on e.o_custkey = p.o_custkey and not list_contains(e.parts, p.part)),
si as (select o_custkey, part, sum(exp(-e / 0.593)) s from i group by all), so as (select o_custkey, part, sum(exp(-e / 0.593)) s from o group by all)
select si.o_custkey, si.part, {rs("si.s / (si.s + coalesce(so.s, 0))", 8)} as preference from si left join so using (o_custkey, part)
""")
def receptor_part_preferences(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.floor(-F.col("o_totalprice") / 100000).cast("double").alias("e"),
                                          F.translate("o_orderpriority", "-", ".").alias("receptor"))
    d = D.part_preferences(o, "o_custkey", "receptor", "e", ["o_orderstatus"])
    return d.withColumn("preference", rounded("preference", 8))


@query(f"""
with e as (select user_id, event_id, value, event_type from events),
n as (select a.user_id, a.event_id, abs(a.value - b.value) r, row_number() over (partition by a.user_id, a.event_id order by abs(a.value - b.value)) k
  from e a join e b on a.user_id = b.user_id and a.event_id <> b.event_id),
z as (select user_id, event_id, count(*) filter (r = 0) z, count(*) m from n group by all),
c as (select user_id, least(greatest(3, max(z)), min(m)) k, min(m) m from z group by 1),
w as (select e.user_id, e.event_type, exp(-(-value / 100 - lo) / 0.593) / (c.k / n.r) w from e join c using (user_id)
  join n on n.user_id = e.user_id and n.event_id = e.event_id and n.k - 1 = least(c.k, c.m - 1) join (select user_id, min(-value / 100) lo from e group by 1) l on l.user_id = e.user_id)
select user_id as compound, event_type as part, {rs("sum(w) / any_value(t)", 7)} as preference from w join (select user_id, sum(w) t from w group by 1) using (user_id) group by all
""")
def density_corrected_part_preferences(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("compound"), F.col("event_id").alias("pose"), "value",
                                          F.col("event_type").alias("receptor"), (-F.col("value") / 100).alias("energy"))
    d = D.density_corrected_preferences(e, D.kth_on_line(e, "compound", "pose", "value", 3))
    return d.withColumn("preference", rounded("preference", 7))


@query(f"select l_suppkey, {rs('sum(l_discount * ln(l_discount))', 6)} as information from lineitem where l_discount > 0 group by 1")
def information_contents(spark, sf):
    d = D.information_content(table(spark, sf, "lineitem").select("l_suppkey", "l_discount"), "l_discount", ["l_suppkey"])
    return d.withColumn("information", rounded("information", 6))


_ROC = """
d as (select n_chars s, count(*) filter (quality = 1) l, count(*) filter (quality = 0) d from documents join labels using (doc_id) group by 1),
t as (select sum(l)::double tl, sum(d)::double td from d),
r as (select s, (sum(d) over (order by s)) / td x, (sum(l) over (order by s)) / tl y, (sum(d) over (order by s) - d) / td x0, (sum(l) over (order by s) - l) / tl y0 from d, t)
"""


def _roc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return D.roc_points(d, "n_chars", F.col("quality") == 1)


@query(f"with {_ROC} select s as n_chars, {', '.join(rs(c, 8) + ' as ' + c for c in ('x', 'y', 'x0', 'y0'))} from r")
def roc_curve(spark, sf):
    return _roc(spark, sf).withColumns({c: rounded(c, 8) for c in ("x", "y", "x0", "y0")})


@query(f"""
with {_ROC}, a as (select case when x > 0.001 and x > x0 then (log10(x) - log10(greatest(x0, 0.001))) *
  (y + case when x0 >= 0.001 then y0 else y0 + (y - y0) * (0.001 - x0) / (x - x0) end) / 2 else 0 end a from r)
select {rs("sum(a) / log10(1000)", 7)} as log_auc, {rs("sum(a) / log10(1000) - 0.14462", 7)} as adjusted_log_auc from a
""")
def log_area_under_curve(spark, sf):
    d = D.log_auc(_roc(spark, sf))
    return d.withColumns({c: rounded(c, 7) for c in ("log_auc", "adjusted_log_auc")})


@query("""
with r as (select case when o_orderstatus = 'F' then 'ligand' else 'decoy' end kind, 'N' || o_custkey || '_x' || (o_custkey * 7) as name, o_orderkey,
  case when o_orderpriority = '5-LOW' then 'NA' else 'p' end prot, o_orderpriority as smiles from orders),
f as (select *, row_number() over (partition by name order by o_orderkey) rn from r where kind = 'ligand' or prot = 'NA')
select kind, split_part(name, '_', 1) as short_name, name, smiles from f where rn = 1
""")
def ligand_decoy_lists(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("N"), F.col("o_custkey").cast("string"), F.lit("_x"), (F.col("o_custkey") * 7).cast("string"))
    r = o.select(F.when(F.col("o_orderstatus") == "F", "ligand").otherwise("decoy").alias("kind"), name.alias("name"), "o_orderkey",
                 F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise("p").alias("prot"), F.col("o_orderpriority").alias("smiles"))
    return D.ligand_and_decoy_lists(r, "name", "kind", "prot", ["o_orderkey"], "smiles")


@query("""
with d as (select l_orderkey parent, l_partkey form, min(l_linenumber) at_ from lineitem where l_returnflag <> 'R' group by 1, 2),
r as (select *, row_number() over (partition by parent order by at_, form)::int as state from d)
select parent, form, at_ as "at", state from r where state <= 2
union all select o_orderkey, o_custkey, null, 1 from orders where o_orderkey not in (select parent from d)
""")
def distinct_states_capped(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("form"), F.col("l_linenumber").alias("at"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("form"))
    return D.first_states(li, "parent", "form", "at", 2, o)


@query(f"with {_POSES} select * from (select {K}, score, row_number() over (partition by l_suppkey order by score, {K})::int as rank_in_group from p) where rank_in_group <= 3")
def lowest_three_per_group(spark, sf):
    return D.lowest_k(poses(spark, sf), ["l_suppkey"], "score", KEY, 3)


@query("""
with w as (select p_partkey from part where p_brand = 'Brand#5'),
r as (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) rn from lineitem where l_partkey in (select * from w))
select l_partkey, ((rn - 1) // 1000)::int as part, string_agg(l_orderkey || ':' || l_linenumber, ' ' order by rn) as scores from r group by all
""")
def score_lists_of_wanted(spark, sf):
    w = table(spark, sf, "part").filter("p_brand = 'Brand#5'").select(F.col("p_partkey").alias("l_partkey"))
    d = D.scores_by_compound(poses(spark, sf), w, "l_partkey", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    text = F.transform("scores", lambda s: F.concat_ws(":", s["l_orderkey"].cast("string"), s["l_linenumber"].cast("string")))
    return d.select("l_partkey", "part", F.array_join(text, " ").alias("scores"))


@query("select event_id, user_id, value, c.n from events join (select user_id, event_type, count(*) n from events where event_type <> 'error' group by all) c using (user_id, event_type)")
def scores_with_pose_text(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    t = e.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return D.scores_with_text(e, t, ["user_id", "event_type"]).drop("event_type")


@query(f"""
select l_orderkey, {rs("sum(l_tax * l_quantity) * 0.5924", 6)} as electrostatic, {rs("sum(l_extendedprice - l_discount)", 4)} as vdw,
  {rs("sum(l_discount)", 6)} as desolvation, {rs("sum(l_tax)", 6)} as net_charge, count(*) as n_atoms from lineitem group by 1
""")
def atom_contributions_per_molecule(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_tax").alias("charge"), F.col("l_quantity").alias("field"), F.col("l_extendedprice").alias("a"),
        F.col("l_discount").alias("b"), F.col("l_discount").alias("desolvation"))
    d = D.molecule_contributions(li, "l_orderkey")
    return d.withColumns({"electrostatic": rounded("electrostatic"), "vdw": rounded("vdw", 4), "desolvation": rounded("desolvation"), "net_charge": rounded("net_charge")})


@query("""
select 'd' || l_suppkey as dir, l_orderkey::int as molnum, 'Z' || l_partkey as compound, '1.' || l_returnflag || '.' || l_linestatus as receptor,
  l_quantity::int as heavy_atoms, l_extendedprice as total, l_linenumber as out_index from lineitem
where l_returnflag = 'A' and l_linestatus = 'F' and l_partkey in (select p_partkey from part where p_size < 20)
""")
def score_lines_selected(spark, sf):
    li = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    zero = F.lit("0.0")
    cells = [F.concat(F.lit("d"), s("l_suppkey")), s("l_orderkey"), F.concat(F.lit("Z"), s("l_partkey")),
             F.concat(F.lit("1."), F.col("l_returnflag"), F.lit("."), F.col("l_linestatus")), zero, zero, zero, F.col("l_quantity").cast("int").cast("string"),
             zero, zero, F.lit("1"), zero, *[zero] * 9, s("l_extendedprice"), s("l_linenumber")]
    lines = lines_from(li, F.col("l_returnflag"), F.col("l_orderkey"), F.concat_ws(" ", *cells))
    ids = table(spark, sf, "part").filter("p_size < 20").select(F.concat(F.lit("Z"), s("p_partkey")).alias("compound"))
    d = SS.select_scores(SS.score_lines(lines), ids, part="A").filter(F.array_contains(F.split("receptor", r"\."), "F"))
    return d.select("dir", "molnum", "compound", "receptor", "heavy_atoms", "total", "out_index")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def ids_without_result(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.without_result(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


_STATE = """s as (select c_custkey, coalesce(bool_or(o_orderstatus = 'F'), false) finished, count(o_orderkey) filter (o_orderpriority = '1-URGENT') errors
from customer left join orders on o_custkey = c_custkey group by 1)"""


def _state(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    return P.completeness(c, o, "c_custkey", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")


@query(f"with {_STATE} select c_custkey, finished, errors from s")
def run_completeness(spark, sf):
    return _state(spark, sf)


@query(f"with {_STATE} select c_custkey, errors from s where not finished")
def unfinished_runs(spark, sf):
    return P.split_finished(_state(spark, sf))[1].drop("finished")


@query("""
select c_custkey, case when c_custkey not in (select o_custkey from orders) then 'no log' when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P') then 'restart'
  else 'no poses' end as reason from customer where c_custkey not in (select o_custkey from orders) or c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')
  or c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')
""")
def runs_needing_work(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return P.job_list(table(spark, sf, "customer").select("c_custkey"), o, o.filter("o_orderstatus = 'F'"),
                      o.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), "c_custkey")


@query("select c_custkey, count(distinct o_orderstatus) = 3 as complete from customer left join orders on o_custkey = c_custkey group by 1")
def expected_outputs_complete(spark, sf):
    exp = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("name"))
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("name"))
    return P.all_outputs_present(exp, files, "c_custkey", "name")


@query(f"with {_POSES} select l_suppkey, count(*) as n, arg_min(l_partkey, (score, l_partkey)) as l_partkey, min(score) as score from p group by 1")
def best_member_per_cluster(spark, sf):
    return M.best_member(poses(spark, sf), "l_suppkey", "score", "l_partkey")
