"""Compound-list queries: documents as structures, encoded order and customer keys as ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.functions import compound_ids as ids
from moltables.functions import smiles as S
from moltables.operators import compounds as C
from moltables.plans.registry import big, query, rounded, rs, table
from moltables.sources import tables as ST
from moltables.sources.lines import lines_from

_SYM = f"'{ids.SYMBOLS}'"


def _digits(n: str, width: int = 8) -> str:
    return " || ".join(f"substr({_SYM}, (({n}) // {62**i} % 62 + 1)::int, 1)" for i in range(width - 1, -1, -1))


def _label(b: str) -> str:
    return (f"case when {b} <= 5 then 'M' || lpad(((5 - {b}) * 100)::varchar, 3, '0') when {b} <= 56 then "
            f"'P' || lpad((({b} - 6) * 10)::varchar, 3, '0') when {b} <= 60 then 'P' || (({b} - 51) * 100)::varchar end")


@query(f"""
with n as (select o_orderkey, (o_orderkey * 99999999977 + 12345) % {62**8} v from orders)
select o_orderkey, v as number, {_digits("v")} as text, v as decoded from n
""")
def base62_round_trip(spark, sf):
    n = (F.col("o_orderkey") * 99999999977 + 12345) % 62**8
    d = table(spark, sf, "orders").select("o_orderkey", n.alias("number")).withColumn("text", ids.base62_text(F.col("number")))
    return d.withColumn("decoded", ids.base62_value(F.col("text")))


_CID = f"'ZINC' || substr({_SYM}, (o_custkey % 62 + 1)::int, 1) || substr({_SYM}, (o_orderkey % 62 + 1)::int, 1) || '00' || {_digits('o_orderkey')}"


def order_ids(spark, sf):
    """Compound ids derived from orders: heavy atoms from the customer, logP bin from the order."""
    sym = F.lit(ids.SYMBOLS)
    at = lambda c: F.substring(sym, (F.col(c) % 62 + 1).cast("int"), F.lit(1))
    d = table(spark, sf, "orders")
    return d.withColumn("id", F.concat(F.lit("ZINC"), at("o_custkey"), at("o_orderkey"), F.lit("00"), ids.base62_text(F.col("o_orderkey"))))


@query(f"""
select {_CID} as id, 'H' || lpad((o_custkey % 62)::varchar, 2, '0') || ({_label("o_orderkey % 62")}) as tranche, o_orderkey as sub_id,
  case when o_orderkey % 62 <= 60 then {_CID} else 'ZINC??00' || {_digits('o_orderkey')} end as rebuilt
from orders
""")
def tranche_names(spark, sf):
    d = order_ids(spark, sf).select("id", ids.tranche_of(F.col("id")).alias("tranche"), ids.number_of(F.col("id")).alias("sub_id"))
    return d.withColumn("rebuilt", ids.compound_id(F.col("sub_id"), F.coalesce("tranche", F.lit(""))))


@query("select substr(sha256('S' || o_orderkey), 61, 2) as shard, count(*) as n from orders group by 1")
def hash_shard_sizes(spark, sf):
    code = F.concat(F.lit("S"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").groupBy(ids.hash_shard(code).alias("shard")).agg(F.count("*").alias("n"))


@query("""
with t as (select c_custkey, trim('ZINC' || c_custkey || 'CIN', 'ZINC') s from customer)
select c_custkey, case when length(s) < 8 then lpad(s, 8, '0') else s end as v12, case when length(s) < 12 then lpad(s, 12, '0') else s end as v15 from t
""")
def stripped_padded_ids(spark, sf):
    raw = F.concat(F.lit("ZINC"), F.col("c_custkey").cast("string"), F.lit("CIN"))
    return table(spark, sf, "customer").select("c_custkey", ids.strip_and_pad(raw, 8).alias("v12"), ids.strip_and_pad(raw, 12).alias("v15"))


@query("select page_id, translate(upper(url), '@-+H[]#', '') as simple from pages")
def simplified_smiles(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.simplify_smiles(F.col("url")).alias("simple"))


@query(r"""
with t as (select url || '[H][NH+]=C[2H][Cu]Cl' s, page_id from pages)
select page_id, len(regexp_extract_all(s, '\[[^\]]+\]')) - len(regexp_extract_all(s, '\[[0-9]*H[+-]?[0-9]*\]'))
  + len(regexp_extract_all(regexp_replace(s, '\[[^\]]+\]', '', 'g'), 'Cl|Br|[BCNOPSFIbcnops]')) as heavy from t
""")
def heavy_atom_counts(spark, sf):
    d = table(spark, sf, "pages").withColumn("s", F.concat("url", F.lit("[H][NH+]=C[2H][Cu]Cl")))
    return d.select("page_id", big(S.heavy_atom_count(F.col("s"))).alias("heavy"))


@query(f"""select o_orderkey, {rs("o_totalprice * 1e-9", 14)} as molar, {rs("-log10(o_totalprice * 1e-9)", 8)} as p_value,
  case when o_totalprice - 250000 > 0 then {rs("-log10(case when o_totalprice - 250000 > 0 then o_totalprice - 250000 else 1 end)", 8)} end as guarded from orders""")
def potency_units(spark, sf):
    m = S.nanomolar_to_molar(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", rounded(m, 14).alias("molar"), rounded(S.neg_log10(m), 8).alias("p_value"),
                                             rounded(S.neg_log10(F.col("o_totalprice") - 250000), 8).alias("guarded"))


@query("""
with r as (select md5(text) key, doc_id, row_number() over (partition by text order by doc_id) rn, count(*) over (partition by text) n from documents),
h as (select key, min(doc_id) as first_id, any_value(n) - 1 as n_duplicates from r group by 1),
l as (select key, ((rn - 2) // 1000)::int as part, string_agg(doc_id::varchar, ' ' order by doc_id) as duplicates from r where rn > 1 group by all)
select h.key, first_id, n_duplicates, coalesce(part, 0)::int as part, coalesce(duplicates, '') as duplicates from h left join l using (key)
""")
def duplicate_compounds(spark, sf):
    d = C.duplicate_report(table(spark, sf, "documents").select("text", "doc_id"), "text", "doc_id", "doc_id")
    return d.select(F.md5("key").alias("key"), "first_id", "n_duplicates", "part",
                    F.coalesce(F.array_join("duplicates", " "), F.lit("")).alias("duplicates"))


_TWO = "a as (select * from documents where source <= 'src14'), b as (select * from documents where source > 'src14')"


def two_lists(spark, sf):
    d = table(spark, sf, "documents").select("text", "doc_id", "source")
    return d.filter("source <= 'src14'"), d.filter("source > 'src14'")


@query(f"""
with {_TWO}
select 'a' as file_origin, doc_id, md5(text) as text, count(m) as n_matches, min(m) as first_match
from (select a.doc_id, a.text, b.doc_id m from a left join b using (text)) group by doc_id, text
union all
select 'b', doc_id, md5(text), count(m), min(m) from (select b.doc_id, b.text, a.doc_id m from b left join a using (text)) group by doc_id, text
""")
def cross_list_matches(spark, sf):
    a, b = two_lists(spark, sf)
    return C.cross_matches(a, b, "text", "doc_id").withColumn("text", F.md5("text"))


@query(f"""
with {_TWO}, s as (select distinct text from a intersect select distinct text from b),
u as (select 'a' file_origin, text, doc_id from a union all select 'b', text, doc_id from b),
r as (select *, row_number() over (partition by file_origin, text order by doc_id) rn from u where text in (select text from s))
select file_origin, md5(text) as text, ((rn - 1) // 1000)::int as part, string_agg(doc_id::varchar, ' ' order by doc_id) as ids from r group by file_origin, text, (rn - 1) // 1000
""")
def cross_list_match_lists(spark, sf):
    a, b = two_lists(spark, sf)
    return C.match_lists(a, b, "text", "doc_id").select("file_origin", F.md5("text").alias("text"), "part", F.array_join("ids", " ").alias("ids"))


@query("select l_partkey, min(l_orderkey) as l_orderkey from lineitem group by 1")
def first_seen_ids(spark, sf):
    return ST.first_seen(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@query("""
with b as (select md5(text) key, doc_id, lang from documents where lang is not null),
f as (select key, min(doc_id) doc_id, arg_min(lang, doc_id) lang from b group by 1)
select * from f where key not in (select md5(text) from documents where source = 'src0')
""")
def registry_insert_or_ignore(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", "lang", "source")
    return C.new_registry_rows(d.drop("source"), d.filter("source = 'src0'").select("key"), "key", "doc_id", "lang")


@query("select * from part where p_brand = 'Brand#13'")
def point_lookup(spark, sf):
    return C.find(table(spark, sf, "part"), "p_brand", "Brand#13")


@query("select * from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def batch_key_lookup(spark, sf):
    keys = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return C.find_many(table(spark, sf, "orders"), keys, "o_custkey")


_SUBS = f"""i as (select {_CID} id, o_orderkey, case when o_orderkey % 62 <= 60 then 'H' || lpad((o_custkey % 62)::varchar, 2, '0') || ({_label("o_orderkey % 62")}) end tranche, o_orderstatus, o_orderpriority from orders),
s as (select tranche, o_orderkey sub_id, o_orderpriority smiles from i where o_orderstatus <> 'P' and tranche is not null)"""


@query(f"""
with {_SUBS}
select id, coalesce(i.tranche, '_null_') as tranche, coalesce(smiles, '_null_') as smiles from i left join s on s.tranche = i.tranche and s.sub_id = i.o_orderkey
""")
def encoded_id_lookup(spark, sf):
    d = order_ids(spark, sf)
    subs = d.filter("o_orderstatus <> 'P'").select(
        ids.tranche_of(F.col("id")).alias("tranche"), F.col("o_orderkey").alias("sub_id"), F.col("o_orderpriority").alias("smiles"))
    return C.lookup_ids(d.select("id"), subs.filter("tranche is not null"))


@query(f"""
with {_SUBS}, m as (select distinct tranche from i where tranche < 'H31')
select shard, count(*) as n from (select case when m.tranche is null then 'fake' else 'shard_' || substr(i.tranche, 2, 1) end shard from i left join m using (tranche)) group by 1
""")
def shard_routing(spark, sf):
    d = order_ids(spark, sf).withColumn("tranche", ids.tranche_of(F.col("id")))
    shard_map = d.select("tranche").distinct().filter("tranche < 'H31'").withColumn("shard", F.concat(F.lit("shard_"), F.substring("tranche", 2, 1)))
    routed = C.route(d.select("id", F.col("tranche").alias("t")), F.col("t"), shard_map)
    return routed.groupBy("shard").agg(F.count("*").alias("n"))


def vendor_tables(spark, sf):
    c = table(spark, sf, "customer")
    code = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    codes = table(spark, sf, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") + 300).cast("string")).alias("supplier_code"))
    supplier_codes = c.select(F.col("c_custkey").alias("sup_id"), code.alias("supplier_code"))
    supplier_map = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("sup_id_fk"), big("c_nationkey").alias("cat_content_id"),
                                                    F.lit(1).alias("machine_id_fk"))
    content = table(spark, sf, "nation").filter("n_regionkey <> 2").select(big("n_nationkey").alias("cat_content_id"), F.col("n_name").alias("smiles"))
    return codes, supplier_codes, supplier_map, content


_VENDOR = """
codes as (select 'S' || (o_custkey + 300) supplier_code from orders),
r as (select supplier_code, c_nationkey cat, m.c_custkey mk from codes left join (select 'S' || c_custkey supplier_code, c_custkey sup from customer) using (supplier_code)
  left join (select c_custkey, c_nationkey from customer where c_acctbal > 0) m on m.c_custkey = sup)
"""


@query(f"with {_VENDOR} select supplier_code, coalesce(n_name, '_null_') as smiles from r left join (select * from nation where n_regionkey <> 2) on n_nationkey = cat")
def vendor_code_lookup(spark, sf):
    return C.vendor_lookup(*vendor_tables(spark, sf))


@query(f"with {_VENDOR} select supplier_code, count(*) as n from r where mk is null group by 1")
def vendor_codes_missed(spark, sf):
    codes, sc, sm, _ = vendor_tables(spark, sf)
    return C.split_codes(codes, sc, sm)[1].groupBy("supplier_code").agg(F.count("*").alias("n"))


@query("""
select o_orderkey, o_custkey as sub_id, c_name as tranche_name, n_name as short_name, s_suppkey as tarball_id, s_name as tarball_path
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
left join (select s_suppkey, s_name, s_suppkey * 2 as k from supplier) on k = o_custkey
""")
def results_with_dimensions(spark, sf):
    c = table(spark, sf, "customer")
    res = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("sub_id"), F.col("o_custkey").alias("tranche_id")).join(
        c.select(F.col("c_custkey").alias("tranche_id"), F.col("c_nationkey").alias("cat_id")), "tranche_id", "left")
    s = table(spark, sf, "supplier")
    d = C.with_dimensions(
        res, c.select(F.col("c_custkey").alias("tranche_id"), F.col("c_name").alias("tranche_name")),
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("cat_id"), F.col("n_name").alias("short_name")),
        s.select((F.col("s_suppkey") * 2).alias("sub_id"), F.col("s_suppkey").alias("tarball_id")),
        s.select(F.col("s_suppkey").alias("tarball_id"), F.col("s_name").alias("tarball_path")))
    return d.select("o_orderkey", "sub_id", "tranche_name", "short_name", "tarball_id", "tarball_path")


# Text lists rendered from a table and read back by the list parsers.
@query("""
select 'ok' as kind, c_name as id, c_mktsegment as smiles from customer where c_acctbal >= 0
union all select 'reject', c_name || ',' || c_mktsegment || ',x', null from customer where c_acctbal < 0
""")
def id_smiles_lines(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat_ws(",", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") < 0, "x"))
    good, bad = ST.id_smiles_pairs(lines_from(c, F.col("c_mktsegment"), F.col("c_custkey"), text))
    return good.select(F.lit("ok").alias("kind"), "id", "smiles").unionByName(
        bad.select(F.lit("reject").alias("kind"), F.col("value").alias("id"), F.lit(None).cast("string").alias("smiles")))


@query("""
select o_orderpriority as name, arg_max(o_orderstatus || '-' || o_custkey, o_orderkey) as smiles from orders group by 1
""")
def smiles_by_name_last_wins(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.col("o_orderstatus"), F.lit("-"), F.col("o_custkey").cast("string"), F.lit(" "), F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    d = ST.smiles_by_name(lines_from(o, F.lit("list"), F.col("o_orderkey"), text, hot=True))
    return d.select(F.replace("name", F.lit("_"), F.lit(" ")).alias("name"), "smiles")


@query("""
select 'L' || o_custkey as id, min(o_orderkey) as at from orders where o_orderstatus = 'F' or o_orderpriority = '5-LOW' group by 1
""")
def ids_or_score_lines_first_seen(spark, sf):
    o = table(spark, sf, "orders")
    ident = F.concat(F.lit("L"), F.col("o_custkey").cast("string"))
    rec = F.translate(F.replace("o_orderpriority", F.lit(" "), F.lit("_")), "-", ".")
    scored = F.concat_ws(" ", F.lit("d"), F.lit("1"), ident, rec, *[F.lit("0")] * 10)
    d = ST.ids_or_score_lines(
        lines_from(o, F.lit("list"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", ident).otherwise(scored), hot=True), part="LOW")
    return d.select("id", F.col("place.seq").alias("at"))
