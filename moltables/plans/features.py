"""Feature, similarity and model queries on embeddings, documents and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators import features as X
from moltables.operators import similarity as M
from moltables.operators.variance import variance_clusters
from moltables.plans.registry import big, query, rounded, rs, table

DIM = 64


def wide(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"res_{i + 1}") for i in range(DIM)])


FEATURES = [f"res_{i + 1}" for i in range(DIM)]
_LONG = f"l as (select vec_id, label, 'res_' || i as feature, embedding[i]::double as value from embeddings, range(1, {DIM + 1}) r(i))"


def long(spark, sf):
    return X.to_long(wide(spark, sf), ["vec_id", "label"], FEATURES)


@query(f"with {_LONG} select vec_id, label, feature, {rs('value', 8)} as value from l")
def features_unpivoted(spark, sf):
    d = wide(spark, sf)
    return X.to_long(d, ["vec_id", "label"], X.feature_columns(d, ("vec_id", "label"))).withColumn("value", rounded("value", 8))


@query(f"""with {_LONG}, c as (select feature, count(*) n, corr(value, label) r from l group by 1)
select feature, n, {rs('coalesce(r, 0)', 7)} as r, {rs('coalesce(r * r, 0)', 7)} as r2, {rs('r * r / (1 - r * r) * (n - 2)', 4)} as f_score from c""")
def response_correlations(spark, sf):
    d = X.correlations(long(spark, sf).withColumn("label", F.col("label").cast("double")), "feature", "value", "label")
    return d.withColumns({"r": rounded("r", 7), "r2": rounded("r2", 7), "f_score": rounded("f_score", 4)})


# Under no correlation r has the density (1 - x^2)^((n - 4) / 2) / B(1/2, (n - 2) / 2), summed here by Simpson's rule from |r| to 1.
@query(f"""with {_LONG}, c as (select feature, count(*) n, coalesce(corr(value, label), 0) r from l group by 1),
s as (select feature, n, r, sum(case when k = 0 or k = 4000 then 1 when k % 2 = 1 then 4 else 2 end
  * pow(greatest(0, 1 - pow(abs(r) + (1 - abs(r)) * k / 4000.0, 2)), (n - 4) / 2.0)) * (1 - abs(r)) / 12000.0 area from c, range(4001) x(k) group by feature, n, r)
select feature, n, {rs('2 * area / exp(lgamma(0.5) + lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0))', 7)} as p_value,
  {rs('2 * area / exp(lgamma(0.5) + lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0))', 7)} as f_p_value from s""")
def correlation_p_values(spark, sf):
    d = X.correlations(long(spark, sf).withColumn("label", F.col("label").cast("double")), "feature", "value", "label")
    p = X.with_p_values(d)
    return p.select("feature", "n", rounded("p_value", 7).alias("p_value"), rounded("f_p_value", 7).alias("f_p_value"))


@query(f"""with {_LONG}, g as (select feature, label, count(*)::double n, avg(value) m, var_pop(value) v from l group by all),
a as (select feature, count(*)::int classes, sum(n) n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) b, sum(n * v) w from g group by 1)
select feature, classes, n::bigint as n, {rs('(b / (classes - 1)) / (w / (n - classes))', 6)} as f_score from a""")
def anova_per_feature(spark, sf):
    return X.anova(long(spark, sf), "feature", "label", "value").withColumn("f_score", rounded("f_score", 6))


@query(f"""with {_LONG}, c as (select feature, corr(value, label) r from l group by 1) select feature, {rs('r * r', 7)} as r2 from c order by r * r desc limit 10""")
def top_ten_features(spark, sf):
    c = X.correlations(long(spark, sf).withColumn("label", F.col("label").cast("double")), "feature", "value", "label")
    return X.top_features(c, "r2", "feature", 10).select("feature", rounded("r2", 7).alias("r2"))


@query(f"""with {_LONG}, c as (select feature, corr(value, label) r from l group by 1), i as (select feature, stddev_pop(value) importance from l group by 1)
select feature, {rs('abs(r)', 7)} as abs_r, {rs('importance', 7)} as importance, {rs('abs(r) * importance', 7)} as combined from c join i using (feature)""")
def combined_importance(spark, sf):
    lg = long(spark, sf).withColumn("label", F.col("label").cast("double"))
    imp = lg.groupBy("feature").agg(F.stddev_pop("value").alias("importance"))
    d = X.combined_scores(imp, X.correlations(lg, "feature", "value", "label"), "feature")
    return d.select("feature", *[rounded(c, 7).alias(c) for c in ("abs_r", "importance", "combined")])


@query(f"with {_LONG}, s as (select feature, avg(value) m, stddev_pop(value) s from l group by 1) select vec_id, feature, {rs('(value - m) / s', 6)} as z from l join s using (feature)")
def standardised_features(spark, sf):
    return X.standardised(long(spark, sf), "feature", "value").select("vec_id", "feature", rounded("z", 6).alias("z"))


@query(f"""with {_LONG}, s as (select feature, avg(value) m, stddev_pop(value) s, avg(value) filter (label = 1) - avg(value) filter (label = 0) w from l group by 1),
n as (select sqrt(sum(w * w)) n from s) select vec_id, {rs('sum((value - m) / s * w / n)', 6)} as score from l join s using (feature), n group by 1""")
def projection_on_weights(spark, sf):
    lg = long(spark, sf)
    w = lg.groupBy("feature").agg((F.avg(F.when(F.col("label") == 1, F.col("value"))) - F.avg(F.when(F.col("label") == 0, F.col("value")))).alias("weight"))
    return X.projection_scores(lg, "vec_id", "feature", "value", w).withColumn("score", rounded("score", 6))


@query(f"""with {_LONG}, g as (select feature, label, avg(value) w from l group by all) select feature, {rs('sqrt(var_pop(w) * count(*))', 8)} as importance from g group by 1""")
def importance_from_class_weights(spark, sf):
    w = long(spark, sf).groupBy("feature", F.col("label").alias("class")).agg(F.avg("value").alias("weight"))
    return X.importance_from_weights(w).withColumn("importance", rounded("importance", 8))


_RULES = ["first|building|F|*", "second| AUTOMOBILE |o|1-URGENT, 5-low", "third|BUILDING|f|2-HIGH"]


@query("""
with j as (select o_orderkey, lower(trim(c_mktsegment)) lig, lower(o_orderstatus) mut, lower(o_orderpriority) rep from orders join customer on o_custkey = c_custkey)
select o_orderkey, case when lig = 'building' and mut = 'f' and rep = '2-high' then 'third' when lig = 'automobile' and mut = 'o' and rep in ('1-urgent', '5-low') then 'second'
  when lig = 'building' and mut = 'f' then 'first' end as group_label from j where (lig = 'building' and mut = 'f') or (lig = 'automobile' and mut = 'o' and rep in ('1-urgent', '5-low'))
""")
def rule_based_labels(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = X.label_groups(d, _RULES, "c_mktsegment", "o_orderstatus", "o_orderpriority")
    return out.select("o_orderkey", "group_label")


# A descriptor per letter and feature, computed by rule from the letter's place in the alphabet.
def descriptors(spark, features=3):
    return spark.createDataFrame(
        [(chr(97 + i), f"d{k}", (i * (k + 3)) % 7 / 2.0) for i in range(26) for k in range(features)], "aa string, feature string, value double")


_DESC = "d as (select chr((97 + i)::int) aa, 'd' || k as feature, (i * (k + 3)) % 7 / 2.0::double as value from range(26) a(i), range(3) b(k))"


@query(f"with {_DESC}, s as (select p_partkey, i - 1 as position, substr(p_name, i::int, 1) aa from part, range(1, 5) r(i)) select p_partkey, position::int as position, feature, value from s join d using (aa)")
def encoded_residues(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.array(*[F.substring("p_name", i + 1, 1) for i in range(4)]).alias("res"))
    return X.encode_residues(d, "p_partkey", "res", descriptors(spark))


@query(f"""with {_DESC}, s as (select p_partkey, i - 1 as position, substr(p_name, i::int, 1) aa from part, range(1, 5) r(i)), e as (select * from s join d using (aa))
select a.p_partkey, '0_' || a.feature || '*1_' || b.feature as feature, a.value * b.value as value from e a join e b on a.p_partkey = b.p_partkey and a.position = 0 and b.position = 1
union all select a.p_partkey, '2_' || a.feature || '*3_' || b.feature, a.value * b.value from e a join e b on a.p_partkey = b.p_partkey and a.position = 2 and b.position = 3""")
def position_interactions(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.array(*[F.substring("p_name", i + 1, 1) for i in range(4)]).alias("res"))
    return X.interactions(X.encode_residues(d, "p_partkey", "res", descriptors(spark)), "p_partkey", [(0, 1), (2, 3)])


@query(f"""with {_DESC}, t as (select doc_id, substr(text, 70, 1) || substr(text, 71, 1) || substr(text, 313, 1) || substr(text, 314, 1) l from documents),
s as (select doc_id, l, unnest(string_split(l, '')) aa from t) select doc_id, l as linker, feature, {rs('avg(value)', 8)} as value from s join d using (aa) group by all""")
def linker_feature_table(spark, sf):
    from moltables.functions.sequence import linker
    d = X.linker_features(table(spark, sf, "documents").select("doc_id", "text"), linker(F.col("text")), descriptors(spark), "doc_id")
    return d.withColumn("value", rounded("value", 8))


@query(None)
def forest_importances(spark, sf):
    _, imp = X.forest(wide(spark, sf), "vec_id", FEATURES, "label", trees=20, depth=8)
    return imp.withColumn("importance", rounded("importance", 8))


@query(None)
def replicate_cross_validation(spark, sf):
    d = wide(spark, sf).withColumn("replicate", F.col("vec_id") % 6).withColumn("label", (F.col("label") < 5).cast("string"))
    accs, w = X.grouped_cv(d, FEATURES, "label", "replicate")
    imp = X.importance_from_weights(X.weights_table(d, FEATURES, w))
    return imp.select(F.lit(float(sum(accs) / len(accs))).alias("accuracy"), "feature", "importance")


@query(None)
def fisher_projection(spark, sf):
    d = wide(spark, sf)
    w = X.fisher_direction(d, FEATURES, "label")
    return X.projection_scores(X.to_long(d, ["vec_id"], FEATURES), "vec_id", "feature", "value", w)


@query(None)
def top_down_vector_clusters(spark, sf):
    return M.vector_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


# Merges by chains of nearest clusters, all of them; those of less cost than the threshold make the clusters.
@query("""with recursive start as (select list(struct_pack(id := id, n := n, v := v) order by id) cl from (select min(vec_id) id, count(*)::double n, embedding::double[] v from embeddings where embedding is not null group by embedding)),
chain as (select 0 step, cl, []::bigint[] chain, null::bigint lo, null::bigint hi, null::double cost from start
  union all
  select step + 1,
    case when meet then list_append(list_filter(cl, lambda c: c.id <> tip.id and c.id <> best.id), struct_pack(id := least(tip.id, best.id), n := tip.n + other.n,
      v := list_transform(range(1, len(tip.v) + 1), lambda k: (tip.n * tip.v[k] + other.n * other.v[k]) / (tip.n + other.n)))) else cl end,
    case when meet then chain[:len(chain) - 2] when len(chain) = 0 then [tip.id, best.id] else list_append(chain, best.id) end,
    case when meet then least(tip.id, best.id) end, case when meet then greatest(tip.id, best.id) end, case when meet then best.cost end
  from (select *, list_filter(cl, lambda c: c.id = best.id)[1] other, len(chain) >= 2 and chain[len(chain) - 1] = best.id meet
    from (select *, list_aggregate(list_transform(list_filter(cl, lambda c: c.id <> tip.id), lambda c: struct_pack(cost := 2 * tip.n * c.n / (tip.n + c.n) * pow(list_distance(c.v, tip.v), 2), id := c.id)), 'min') best
      from (select *, list_filter(cl, lambda c: c.id = coalesce(chain[len(chain)], cl[1].id))[1] tip from chain where len(cl) > 1)))),
m as (select hi, lo from chain where cost < 4.0),
f as (select id, id c from (select unnest(cl).id id from start) union all select f.id, m.lo from f join m on m.hi = f.c),
l as (select e.vec_id id, k.c from embeddings e join (select r.v, min(f.c) c from (select unnest(cl) r from start) join f on f.id = r.id group by r.v) k on k.v = e.embedding::double[])
select id as vec_id, c as cluster from l""")
def variance_threshold_clusters(spark, sf):
    return variance_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 2.0)


_BITS = r"""s as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') w from documents),
g as (select doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) t from s),
b as (select distinct doc_id, ('0x' || substr(sha256(t), 1, 7))::bigint % 1048576 bit from g),
sets as (select doc_id, list_sort(list(bit)) bits, count(*) n from b group by 1), reps as (select min(doc_id) id, bits, any_value(n) n from sets group by bits)"""


def fingerprints(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", M.bits_of_text(F.col("text"), 1 << 20).alias("bits"))


@query(f"""with {_BITS}, e as (select id, n, unnest(bits) bit from reps), p as (select a.id a, b.id b, count(*) c, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.bit = b.bit and a.id < b.id group by 1, 2)
select a, b, {rs('c / (na + nb - c)::double', 8)} as similarity from p where c / (na + nb - c)::double >= 0.5""")
def similar_fingerprint_pairs(spark, sf):
    reps, _ = M.distinct_fingerprints(fingerprints(spark, sf), "doc_id", "bits")
    return M.similar_pairs(reps, 0.5).withColumn("similarity", rounded("similarity", 8))


@query(f"""with recursive {_BITS}, e as (select id, n, unnest(bits) bit from reps), p as (select a.id a, b.id b, count(*) c, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.bit = b.bit and a.id < b.id group by 1, 2),
k as (select a, b from p where c / (na + nb - c)::double >= 0.5), u as (select a, b from k union select b, a from k), reach as (select id, id c from reps union select u.a, r.c from u join reach r on r.id = u.b)
select id, min(c) as component from reach group by 1""")
def similarity_components(spark, sf):
    reps, _ = M.distinct_fingerprints(fingerprints(spark, sf), "doc_id", "bits")
    return M.connected_components(reps, M.similar_pairs(reps, 0.5), "a", "b")


@query(None)
def complete_linkage_clusters(spark, sf):
    return M.linkage_clusters(fingerprints(spark, sf), "doc_id", "bits", 0.5, "complete")


@query(None)
def average_linkage_clusters(spark, sf):
    return M.linkage_clusters(fingerprints(spark, sf), "doc_id", "bits", 0.5, "average")


@query("select l_linestatus, l_returnflag, count(*) as n from lineitem group by all")
def cluster_size_table(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("cluster", F.concat("l_linestatus", "l_returnflag"))
    s = M.cluster_sizes(d)
    return s.select(F.substring("cluster", 1, 1).alias("l_linestatus"), F.substring("cluster", 2, 1).alias("l_returnflag"), big("n").alias("n"))
