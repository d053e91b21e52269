"""Series queries: events per user in time order, orders by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators import series as S
from moltables.operators import structure as X
from moltables.operators.ordered import ordered
from moltables.plans.registry import big, query, rounded, rs, table
from moltables.session import shared_folder
from moltables.sources import simulation as SM
from moltables.sources.lines import lines_from
from moltables.sources.sinks import batches
from moltables.streaming import scores as ST


def events(spark, sf, *cols):
    return table(spark, sf, "events").select("user_id", "event_id", *cols)


_POS = "e as (select *, row_number() over (partition by user_id order by event_id) i from events)"


@query(f"with {_POS} select user_id, event_id, value from e where (i - 1) % 10 = 0")
def every_tenth_row(spark, sf):
    return S.every_nth(events(spark, sf, "value"), ["user_id"], ["event_id"], 10)


@query("select event_id, user_id from events order by event_id limit 37")
def first_input_rows(spark, sf):
    return S.first_rows(table(spark, sf, "events").select("event_id", "user_id"), ["event_id"], 37)


@query(f"""
with {_POS}, n as (select user_id, count(*) n from events group by 1),
t as (select user_id, value from e join n using (user_id) where i > floor(n * 0.2))
select user_id, count(*) as n_values, {rs("avg(value)")} as mean, {rs("case when count(*) > 1 then stddev_samp(value) / sqrt(count(*)) end")} as sem from t group by 1
""")
def window_means_after_discard(spark, sf):
    d = S.window_statistics(events(spark, sf, "value"), ["user_id"], ["event_id"], "value")
    return d.withColumns({"mean": rounded("mean"), "sem": rounded("sem")})


_TRAP = f"""{_POS}, l as (select user_id, i, value, value / 10 s, lag(i) over w pi, lag(value) over w pv, lag(value / 10) over w ps from e window w as (partition by user_id order by i)),
legs as (select user_id, coalesce(sum((i - pi) * (value + pv) / 2), 0) integral, count(*) n_points,
  sqrt(coalesce(sum(pow(0.5 * (i - pi) * s, 2) + pow(0.5 * (i - pi) * ps, 2)), 0)) uncertainty from l group by 1)"""


def _legs(spark, sf):
    d = ordered(events(spark, sf, "value"), ["user_id"], ["event_id"]).row_number("i").result()
    return S.integrate(d.withColumn("s", F.col("value") / 10), ["user_id"], "i", "value", "s")


@query(f"with {_TRAP} select user_id, {rs('integral', 4)} as integral, n_points, {rs('uncertainty')} as uncertainty from legs")
def trapezoid_integrals(spark, sf):
    return _legs(spark, sf).withColumns({"integral": rounded("integral", 4), "uncertainty": rounded("uncertainty")})


@query(f"""with {_TRAP} select {rs('sum(integral)', 3)} as decoupling, {rs('-sum(integral)', 3)} as free_energy_raw, {rs('-sum(integral) + 1.5', 3)} as free_energy,
{rs('sqrt(sum(uncertainty * uncertainty))', 4)} as uncertainty from legs""")
def total_free_energy(spark, sf):
    d = S.total_free_energy(_legs(spark, sf), correction=1.5)
    return d.withColumns({c: rounded(c, 4 if c == "uncertainty" else 3) for c in d.columns})


_W, _DEG = 11, 2
# One- and two-value windows are met exactly, three values by their parabola.
_ROWS = ", ".join(
    f"({n}, {at}, {j}, {w!r}::double)" for n in range(1, _W + 1, 2) for at in range(n)
    for j, w in enumerate(S._fit_weights(n, _DEG, at) if n > _DEG else [float(at == k) for k in range(n)]))


@query(f"""
with {_POS}, n as (select user_id, count(*) n, least(11, count(*) - 1 + count(*) % 2) k from events group by 1), w(k, at_, j, w) as (values {_ROWS}),
p as (select e.user_id, e.event_id, k, e.i - 1 i, greatest(0, least(e.i - 1 - k // 2, n - k)) start from e join n using (user_id))
select p.user_id, p.event_id, {rs("greatest(sum(e.value * w.w), 0)")} as smooth from p join w on w.k = p.k and w.at_ = p.i - p.start join e on e.user_id = p.user_id and e.i - 1 = p.start + w.j group by all
""")
def smoothed_series(spark, sf):
    d = S.smooth(events(spark, sf, "value"), ["user_id"], "event_id", "value", window=_W, degree=_DEG)
    return d.select("user_id", "event_id", rounded("smooth").alias("smooth"))


@query(f"""
with b as (select user_id, quantile_cont(value, 0.95) bulk from events group by 1),
e as (select user_id, event_id, value, bulk, value >= bulk * 0.4 i from events join b using (user_id)),
g as (select *, event_id - 0 k, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, i order by event_id) grp from e),
r as (select user_id, grp, count(*) len, min(event_id) lo, max(event_id) hi from g where i group by all),
x as (select *, row_number() over (partition by user_id order by len desc, lo) rn from r),
m as (select user_id, any_value(bulk) bulk, min(event_id) a, max(event_id) z from e where value >= bulk * 0.05 group by 1)
select m.user_id, {rs("bulk")} as bulk, lo as bulk_low, hi as bulk_high, len as bulk_rows, a as extent_low, z as extent_high from m left join x on x.user_id = m.user_id and rn = 1
""")
def plateau_regions(spark, sf):
    return S.plateau(events(spark, sf, "value"), ["user_id"], "event_id", "value", bulk_share=0.4).withColumn("bulk", rounded("bulk"))


@query("select event_type, user_id, arg_max(value, event_id) as value from events group by all")
def last_value_per_key(spark, sf):
    return S.last_value_per_key(table(spark, sf, "events"), ["event_type", "user_id"], ["event_id"], ["value"])


@query("""
with r as (select *, row_number() over (partition by user_id order by value, event_id) rn from events)
select user_id, value, event_id, event_id * 2 as time, event_id // 25 as frame from r where rn = 1
""")
def lowest_energy_frames(spark, sf):
    e = events(spark, sf, "value").withColumn("time", F.col("event_id") * 2)
    return S.lowest_energy_frame(e, "value", "event_id", "time", 25, ["user_id"])


@query(f"""
with s as (select user_id, min(event_id) a, max(event_id) b from events group by 1),
d as (select e.user_id, event_id, value, (event_id - a) / (b - a)::double at_ from events e join s on e.user_id = s.user_id and b > a),
v as (select user_id, regr_slope(value, event_id::double) slope, avg(value) filter (at_ >= 0.75) - avg(value) filter (at_ < 0.75) shift from d where at_ >= 0.5 group by 1)
select user_id, {rs("slope", 8)} as slope, {rs("shift")} as shift, coalesce(abs(slope) <= 0.01 and abs(shift) <= 10, false) as converged from v
""")
def plateau_verdicts(spark, sf):
    d = S.plateau_verdict(events(spark, sf, "value"), ["user_id"], "event_id", "value", 0.01, 10.0)
    return d.withColumns({"slope": rounded("slope", 8), "shift": rounded("shift")})


@query("""
select e.event_id, x.c_custkey as walker from (select event_id, user_id slot, event_id % 12 as time from events) e
join (select unnest(range(12)) time, c_nationkey slot, c_custkey from customer) x using (slot, time)
""")
def demultiplexed_frames(spark, sf):
    f = table(spark, sf, "events").select("event_id", F.col("user_id").alias("slot"), (F.col("event_id") % 12).alias("time"))
    idx = table(spark, sf, "customer").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("time"),
                                              big("c_nationkey").alias("slot"), F.col("c_custkey").alias("walker"))
    return S.demultiplex(f, idx).select("event_id", "walker")


@query(f"select event_id, {rs('sum(value) over (order by event_id)', 3)} as total from events")
def running_total(spark, sf):
    d = S.cumulative_share(table(spark, sf, "events").select("event_id", "value"), "event_id", "value", "total")
    return d.select("event_id", rounded("total", 3).alias("total"))


@query("select event_id, ceil(row_number() over (order by event_id) / 999.0)::bigint as batch from events")
def fixed_size_batches(spark, sf):
    return batches(table(spark, sf, "events").select("event_id"), ["event_id"], 999)


@query("select user_id, event_id, user_id || '_' || (row_number() over (partition by user_id order by event_id) - 1) as name from events")
def running_suffixes(spark, sf):
    return X.running_suffix(events(spark, sf), "user_id", ["event_id"])


_RUN = """e as (select user_id, event_id, event_type, (value / 40)::int r from events),
f as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end cs, case when lag(event_type) over w is distinct from event_type or lag(r) over w is distinct from r then 1 else 0 end cr from e
  window w as (partition by user_id order by event_id)),
g as (select *, sum(cs) over (partition by user_id order by event_id) seg from f)"""


@query(f"with {_RUN} select user_id, event_id, seg::bigint as run from g")
def contiguous_runs(spark, sf):
    return X.run_numbers(events(spark, sf, "event_type"), ["user_id"], ["event_id"], ["event_type"], "run").drop("event_type")


@query(f"with {_RUN} select user_id, event_id, (sum(cr) over (partition by user_id, seg order by event_id))::int as new_resid from g")
def segment_residue_numbers(spark, sf):
    d = events(spark, sf, "event_type", F.round(F.col("value") / 40).cast("int").alias("r"))
    return X.renumber_residues(d, ["user_id"], ["event_id"], "event_type", "r").select("user_id", "event_id", "new_resid")


@query(f"""with {_RUN} select user_id, event_id, case when event_type = 'view' then ceil(row_number() over (partition by user_id, seg order by event_id) / 3.0)::int
else (sum(cr) over (partition by user_id, seg order by event_id))::int end as new_resid from g""")
def water_aware_residue_numbers(spark, sf):
    d = events(spark, sf, "event_type", F.round(F.col("value") / 40).cast("int").alias("r"))
    return X.renumber_residues(d, ["user_id"], ["event_id"], "event_type", "r", per_atoms={"view": 3}).select("user_id", "event_id", "new_resid")


@query("""
with e as (select user_id, event_id, event_type, event_type = 'error' t from events),
l as (select *, lag(event_type) over w pc, lag(t) over w pt from e window w as (partition by user_id order by event_id))
select user_id, event_id, sum(case when coalesce(pt, false) or (not t and pc is not null and pc <> event_type) then 1 else 0 end) over (partition by user_id order by event_id)::bigint as chain_no from l
""")
def chain_splits(spark, sf):
    d = X.chain_numbers(events(spark, sf, "event_type"), ["user_id"], ["event_id"], "event_type", F.col("event_type") == "error")
    return d.drop("event_type")


@query("""
with f as (select user_id, event_type, min(event_id) a from events group by all), n as (select *, row_number() over (partition by user_id order by a) as number from f)
select event_id, number from events join n using (user_id, event_type)
""")
def dense_first_seen_numbers(spark, sf):
    d = X.dense_numbers(events(spark, sf, "event_type"), ["user_id"], "event_type", "event_id", "number")
    return d.select("event_id", "number")


@query(f"""
with {_POS} select 'leg_' || user_id as leg, {rs("(event_id % 5) / 10.0", 3)} as lambda, count(*) as n_values, {rs("avg(value)")} as mean from events where event_type <> 'error' group by all
""")
def dvdl_lines_parsed(spark, sf):
    e = table(spark, sf, "events")
    file = F.concat(F.lit("/ti/leg_"), F.col("user_id").cast("string"), F.lit("/lambda_"), F.format_string("%.3f", (F.col("event_id") % 5) / 10.0), F.lit("/prod.out"))
    text = F.when(F.col("event_type") == "error", F.lit(" no value here")).otherwise(F.concat(F.lit(" DV/DL = "), F.col("value").cast("string")))
    s = SM.dvdl_samples(lines_from(e, file, F.col("event_id"), text))
    return s.groupBy("leg", rounded("lambda", 3).alias("lambda")).agg(F.count("*").alias("n_values"), rounded(F.avg("value")).alias("mean"))


@query("""
with x as (select distinct 'leg_' || user_id leg, (event_id % 5) / 10.0 lam from events), v as (select distinct 'leg_' || user_id leg, (event_id % 5) / 10.0 lam from events where event_type = 'signup')
select leg, lam::double as lambda, case when substr(leg, length(leg)) = '7' then 'missing' when substr(leg, length(leg)) = '3' then 'empty' else 'no values' end as reason from x
where substr(leg, length(leg)) in ('7', '3') or not exists (select 1 from v where v.leg = x.leg and v.lam = x.lam)
""")
def windows_skipped(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("leg_"), F.col("user_id").cast("string")).alias("leg"),
                                          ((F.col("event_id") % 5) / 10.0).alias("lambda"), "event_type")
    expected = e.select("leg", "lambda").distinct()
    last = F.substring("leg", -1, 1)
    files = expected.filter(last != "7").withColumn("length", F.when(last == "3", 0).otherwise(100))
    return SM.dvdl_skips(expected, files, e.filter("event_type = 'signup'"))


@query(f"""
with {_POS} select user_id, block, time, {rs("max(temp)", 2)} as temp, {rs("max(etot)", 2)} as etot from (
  select 'md_' || user_id || '.out' user_id, case when i % 10 = 0 then 'average' when i % 10 = 1 and i > 1 then 'rms' else 'instant' end block, i * 0.5::double as time, value temp, -value * 2 etot from e) group by all
""")
def energy_log_parsed(spark, sf):
    e = ordered(events(spark, sf, "value"), ["user_id"], ["event_id"]).row_number("i").result()
    s = lambda c, f="%.3f": F.format_string(f, c)
    step = F.concat(F.lit(" NSTEP = "), F.col("i").cast("string"), F.lit("  TIME(PS) = "), s(F.col("i") * 0.5), F.lit("  TEMP(K) = "), s(F.col("value")), F.lit("  PRESS =  0.0"))
    etot = F.concat(F.lit(" Etot   = "), s(-F.col("value") * 2), F.lit("  EKtot   = 1.5  EPtot      = -2.5"))
    head = F.when(F.col("i") % 10 == 0, "      A V E R A G E S   O V E R   10 S T E P S").when((F.col("i") % 10 == 1) & (F.col("i") > 1), "      R M S  F L U C T U A T I O N S").otherwise("")
    rows = e.select("user_id", "i", F.posexplode(F.array(head, step, etot)).alias("k", "text"))
    lines = lines_from(rows, F.concat(F.lit("md_"), F.col("user_id").cast("string"), F.lit(".out")), F.col("i") * 3 + F.col("k"), F.col("text"))
    long = SM.energy_log(lines)
    pick = lambda m: rounded(F.max(F.when(F.col("metric") == m, F.col("value"))), 2)
    return long.groupBy(F.col("file").alias("user_id"), "block", "time").agg(pick("TEMP(K)").alias("temp"), pick("Etot").alias("etot"))


@query(f"""
select 'w' || user_id as window_name, (user_id * 3)::double as center, {rs("2 * 50 * pow(pi() / 180, 2)", 8)} as k, event_id, {rs("(value * 9 - 400) - 360 * floor((value * 9 - 400) / 360)", 3)} as angle
from events where event_type not in ('error', 'signup')
""")
def umbrella_series(spark, sf):
    e = table(spark, sf, "events")
    w = F.concat(F.lit("w"), F.col("user_id").cast("string"))
    data = lines_from(e, F.concat(F.lit("/us/"), w, F.lit("/"), w, F.lit(".dat")), F.col("event_id"),
                      F.when(F.col("event_type") == "error", "# skipped").when(F.col("event_type") == "signup", "@ 1 2").otherwise(
                          F.concat(F.col("event_id").cast("string"), F.lit("   "), F.format_string("%.6f", F.col("value") * 9 - 400))))
    rst = lines_from(e.select("user_id").distinct(), F.concat(F.lit("/us/"), w, F.lit("/restraint.in")), F.lit(1),
                     F.concat(F.lit(" &rst iat=1,2 r1=0.0, r2 = "), F.format_string("%.1f", F.col("user_id") * 3.0), F.lit(", rk2 = 50.0, /")))
    d = SM.umbrella_samples(data, rst)
    return d.select(F.col("window").alias("window_name"), "center", rounded("k", 8).alias("k"), F.col("seq").alias("event_id"), rounded("angle", 3).alias("angle"))


@query("select 'u' || user_id as compound, min(value) as value, arg_min(event_id, (value, event_id)) as event_id from events group by 1")
def streamed_best_per_compound(spark, sf):
    schema = table(spark, sf, "events").schema
    out, ckpt = shared_folder(spark, "best"), shared_folder(spark, "best-progress")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ST.best_score_updates(stream, F.concat(F.lit("u"), F.col("user_id").cast("string")), "value", ["event_id"], out, ckpt).awaitTermination()
    return ST.current_best(spark, out)


@query("select c_custkey, c_name from customer")
def streamed_registry(spark, sf):
    schema = table(spark, sf, "customer").schema
    out = shared_folder(spark, "registry")
    for run in range(2):  # the second pass finds nothing new
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
        ST.grow_registry(stream, out, "c_custkey", "c_custkey", "c_name", shared_folder(spark, f"registry-progress-{run}")).awaitTermination()
    return ST.read_table(spark, out).select("c_custkey", "c_name")
