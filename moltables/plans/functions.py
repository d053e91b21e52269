"""Column-function queries on the text, key and number columns of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.functions import geometry as G
from moltables.functions import residues as R
from moltables.functions import sequence as Q
from moltables.functions import smiles as S
from moltables.functions import text as T
from moltables.functions import units as U
from moltables.plans.registry import big, query, rounded, rs, table


@query(r"select doc_id, substr(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 200) as name from documents")
def safe_file_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.safe_name(F.col("text")).alias("name"))


@query("select page_id, url_encode(url) as quoted, url as back from pages")
def quoted_text(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url", S.url_quote(F.col("url")).alias("quoted"))
    # The SQL side escapes the slash as well.
    return d.select("page_id", F.replace("quoted", F.lit("/"), F.lit("%2F")).alias("quoted"), S.url_unquote(F.col("quoted")).alias("back"))


@query(r"""
select page_id, case when contains(html, '<title>') then split_part(split_part(html, '<title>', -1), '</title>', 1) end as title,
  len(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) as n_links, array_to_string(regexp_extract_all(html, '<a href="/([^"]*)"', 1), ' ') as links from pages
""")
def page_markers(spark, sf):
    links = T.all_matches(F.col("html"), '<a href="/([^"]*)"')
    title = F.when(F.col("html").contains("<title>"), F.substring_index(F.substring_index("html", "<title>", -1), "</title>", 1))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), big(F.size(links)).alias("n_links"), F.array_join(links, " ").alias("links"))


@query(r"select page_id, case when contains(url, '://') then url_decode(split_part(split_part(url, '://', -1), '/', 1)) end as host from pages")
def text_between_markers(spark, sf):
    # The marked line comes second, and a later line has the marker again.
    page = F.concat(F.lit("head\n"), F.col("url"), F.lit("\nnext ://other/"))
    page = F.when(F.col("url").contains("://"), page).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.between_markers(page, "://", "/").alias("host"))


@query("select page_id, case when starts_with(p, '/') then p else '/data/' || p end as path from (select page_id, case when page_id < 100 then '/abs/' || page_id else url end p from pages)")
def completed_paths(spark, sf):
    p = F.when(F.col("page_id") < 100, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.complete_path(p, "/data").alias("path"))


@query(r"""
with t as (select event_id, case event_type when 'click' then event_id::varchar when 'view' then value::varchar else event_type end w from events)
select event_id, case when regexp_full_match(w, '[+-]?[0-9]+') then w::bigint end as as_int,
  case when not regexp_full_match(w, '[+-]?[0-9]+') then try_cast(w as double) end as as_double,
  case when not regexp_full_match(w, '[+-]?[0-9]+') and try_cast(w as double) is null then w end as as_text from t
""")
def typed_tokens(spark, sf):
    w = F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).when(
        F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", T.number_or_text(w).alias("t")).select("event_id", "t.*")


@query(f"""select event_id, {rs("(value * 7 - 900) - 360 * floor((value * 7 - 900) / 360.0)", 6)} as wrapped,
  {rs("2 * value * pow(pi() / 180, 2)", 8)} as k, {rs("value / 12.5 * 18.01528 / 6.02214076e23 * 1e24", 6)} as density,
  {rs("value / 12.5 * 18.01528 / 6.02214076e23 * 1e24", 6)} as sd_same, {rs("value / (12.5 * 0.5 * 10) * 18.01528 / 6.02214076e23 * 1e24", 6)} as sd_frames,
  {rs("exp(-0.8 * pow(case when value > 0.5 then value - 0.5 end, 1.0))", 8)} as decay from events""")
def unit_conversions(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", rounded(U.wrap360(v * 7 - 900)).alias("wrapped"), rounded(U.degree_force_constant(v), 8).alias("k"),
        rounded(U.counts_to_density(v, 12.5)).alias("density"), rounded(U.sd_to_density(v, 12.5, 0.5, 10)).alias("sd_same"),
        rounded(U.sd_to_density(v, 12.5, 0.5, 10, same_divisor=False)).alias("sd_frames"),
        rounded(F.when(v > 0.5, U.network_decay(v, 0.5, 0.8, 1.0)), 8).alias("decay"))


def _cut(p: int) -> str:
    return f"case when {p} between 1 and length(text) then substr(text, {p}, 1) else 'X' end"


@query(f"select doc_id, {' || '.join(_cut(p) for p in (70, 71, 313, 314, 99999))} as residues from documents")
def residues_at_positions(spark, sf):
    r = Q.residues_at(F.col("text"), (70, 71, 313, 314, 99999))
    return table(spark, sf, "documents").select("doc_id", F.array_join(r, "").alias("residues"))


@query("""
with e as (select doc_id, case when length(text) >= 70 then substr(text, 1, 69) || 'W' || substr(text, 71) else text end t from documents)
select doc_id, md5(case when length(t) >= 313 then substr(t, 1, 312) || lang[1] || substr(t, 314) else t end) as edited from e join documents using (doc_id)
""")
def point_edited_sequences(spark, sf):
    e = Q.edit_residues(F.col("text"), (70, 313, 999999), (F.lit("W"), F.substring("lang", 1, 1), F.lit("Q")))
    return table(spark, sf, "documents").select("doc_id", F.md5(e).alias("edited"))


@query("select doc_id, substr(text, 70, 1) || substr(text, 71, 1) || substr(text, 313, 1) || substr(text, 314, 1) as linker from documents")
def linker_letters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.linker(F.col("text")).alias("linker"))


@query("""
select doc_id, substr('XXXXXXX' || text || 'XXXXXXX', 70, 15) as one_based, substr('XXXXXXX' || text || 'XXXXXXX', 71, 15) as zero_based,
  substr('XXXXXXX' || text || 'XXXXXXX', 3, 15) as near_start from documents
""")
def padded_windows(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", Q.window_around(t, 70, 7).alias("one_based"), Q.window_around(t, 70, 7, index_base=0).alias("zero_based"),
        Q.window_around(t, 3, 7).alias("near_start"))


@query("select count(*) as n, count(*) filter (length(l) is distinct from 4) as bad from (select substr(text, 70, 1) || substr(text, 71, 1) || substr(text, 313, 1) || substr(text, 314, 1) l from documents)")
def linker_length_check(spark, sf):
    from moltables.operators.features import bad_lengths
    return bad_lengths(table(spark, sf, "documents").select(Q.linker(F.col("text")).alias("l")), "l", 4)


_THREE = " ".join(f"when '{k}' then '{v}'" for k, v in Q.ONE_LETTER.items())
_NAMES = list(Q.ONE_LETTER) + ["HOH", "ZZZ"]
_NAME_SQL = f"list_extract({_NAMES}, (l_partkey % {len(_NAMES)} + 1)::int)"


@query(f"select code, count(*) as n from (select case {_NAME_SQL} {_THREE} else 'X' end code from lineitem) group by 1")
def one_letter_codes(spark, sf):
    name = F.get(F.array(*[F.lit(n.lower()) for n in _NAMES]), (F.col("l_partkey") % len(_NAMES)).cast("int"))
    return table(spark, sf, "lineitem").groupBy(Q.one_letter(name).alias("code")).agg(F.count("*").alias("n"))


@query("""
with c as (select doc_id, unnest(l) c, generate_subscripts(l, 1) i from (select doc_id, string_split(translate(text, 'aehntois', 'AEHNTOIS'), '') l from documents)),
w as (select doc_id, i - 1 as pos, c a, lead(c, 1) over w b, lead(c, 2) over w d from c window w as (partition by doc_id order by i))
select doc_id, pos from w where a = 'E' and b = 'H' and d = 'E' union all select doc_id, pos from w where a = 'H' and b = 'H' union all select doc_id, pos from w where a = 'D' and b = 'A' and d = 'S'
""")
def exact_motif_hits(spark, sf):
    upper = F.translate("text", "aehntois", "AEHNTOIS")
    hits = F.concat(*[Q.find_exact(upper, m) for m in ("ehe", "hh", "das")])
    return table(spark, sf, "documents").select("doc_id", F.explode(hits).alias("pos")).withColumn("pos", big("pos"))


@query(r"""
with t as (select doc_id, regexp_extract_all(text, '[aeiou][^aeiou ][sn]') h, string_split_regex(text, '[aeiou][^aeiou ][sn]') g from documents),
p as (select doc_id, unnest(range(1, len(h) + 1)) k, h, g from t)
select doc_id, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0) as first,
  list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(h[1:k], lambda x: length(x))) as last from p
""")
def regex_motif_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(Q.find_regex(F.col("text"), "[aeiou][^aeiou ][sn]")).alias("s"))
    return d.select("doc_id", big("s.start").alias("first"), big("s.end").alias("last"))


@query("select doc_id, translate(regexp_replace(text, '[^.HGIBETSC~]', 'C', 'g'), '.GIB~', 'FHHEC') as ss from documents")
def coarse_structure_letters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.coarse_structure(F.col("text")).alias("ss"))


_RES = ["ALA", "CASN", "NVAL", "DA5", "UMP", "POPE", "0GB", "TIP3", "WAT", "XYZ", "SOD"]
_RES_CLASS = ["protein", "protein", "protein", "dna", "rna", "lipid", "carbohydrate", "charmm_water", "water", "unknown", "unknown"]


def _res(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.withColumn("res", F.get(F.array(*[F.lit(r) for r in _RES]), (F.col("l_partkey") % len(_RES)).cast("int")))


@query(f"""select list_extract({_RES_CLASS}, (l_partkey % 11 + 1)::int) as class, count(*) as n, count(distinct l_partkey % 11) as n_names from lineitem group by 1""")
def residue_class_counts(spark, sf):
    from moltables.operators.structure import class_counts
    d = _res(spark, sf)
    return class_counts(d, R.residue_class(F.col("res")), "res")


@query("""
select case when l_partkey % 11 = 7 then 'TIP3' when l_partkey % 11 = 10 then 'IONS' else 'PROA' end as segment, count(*) as n from lineitem group by 1
""")
def segment_assignment(spark, sf):
    return _res(spark, sf).groupBy(R.segment_of(F.col("res")).alias("segment")).agg(F.count("*").alias("n"))


@query("select doc_id, md5(replace(replace(replace(replace(text, 'TRI', 'TRIO'), 'POP', 'POPC'), 'DOP', 'DOPE'), 'SWM', 'SWM4')) as renamed from (select doc_id, upper(lang) || 'TRI DOP POP SWM' || source as text from documents)")
def renamed_residues(spark, sf):
    t = F.concat(F.upper("lang"), F.lit("TRI DOP POP SWM"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.rename_residues(t)).alias("renamed"))


@query("""
with l as (select o_orderkey, list_extract(['ATOM', 'CONECT', 'HETATM'], (o_custkey % 3 + 1)::int) || '  ' || o_orderkey || '  ' || list_extract(['C5M', 'O5*', 'P', 'H2''2'], (o_orderkey % 4 + 1)::int) || ' ' ||
  list_extract([' DA A', ' DT B', ' DC C', ' DG D'], (o_custkey % 4 + 1)::int) v from orders)
select o_orderkey, replace(replace(replace(replace(v, ' DA', ' A '), ' DT', ' U '), ' DC', ' C '), ' DG', ' G ') as line from l
where not starts_with(v, 'CONECT') and not contains(v, ' C5M ') and not contains(v, ' P ') and not contains(v, 'H2''2')
""")
def rna_lines(spark, sf):
    pick = lambda items, c: F.get(F.array(*[F.lit(i) for i in items]), (F.col(c) % len(items)).cast("int"))
    v = F.concat(pick(["ATOM", "CONECT", "HETATM"], "o_custkey"), F.lit("  "), F.col("o_orderkey").cast("string"), F.lit("  "),
                 pick(["C5M", "O5*", "P", "H2'2"], "o_orderkey"), F.lit(" "), pick([" DA A", " DT B", " DC C", " DG D"], "o_custkey"))
    d = table(spark, sf, "orders").withColumn("v", v).filter(R.kept_in_rna(F.col("v")))
    return d.select("o_orderkey", R.dna_to_rna(F.col("v")).alias("line"))


@query(f"""
with n as (select l_orderkey, list_extract([' CA ', 'Cl1 ', '1HB ', ' O5*', '2Cl ', ' Fe ', 'SD  '], (l_partkey % 7 + 1)::int) a,
  list_extract([12.01, 35.45, 1.008, 16.0, 35.45, 19.0, 32.065], (l_partkey % 7 + 1)::int)::double m from lineitem)
select l_orderkey, {rs("sum(m)", 4)} as mass from n group by 1
""")
def masses_from_names(spark, sf):
    names = [" CA ", "Cl1 ", "1HB ", " O5*", "2Cl ", " Fe ", "SD  "]
    a = F.get(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % 7).cast("int"))
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(R.mass_of_name(a)).alias("mass"))
    return d.withColumn("mass", rounded("mass", 4))


@query(f"""
with e as (select vec_id, o::int as first_point, embedding[3 * o + 1:3 * o + 12] v from embeddings, range(18) r(o)),
p as (select vec_id, first_point, v[1]::double ax, v[2]::double ay, v[3]::double az, v[4]::double bx, v[5]::double b_y, v[6]::double bz, v[7]::double cx, v[8]::double cy, v[9]::double cz,
  v[10]::double dx, v[11]::double dy, v[12]::double dz from e),
q as (select *, sqrt(pow(ax-bx,2)+pow(ay-b_y,2)+pow(az-bz,2)) ab, sqrt(pow(bx-cx,2)+pow(b_y-cy,2)+pow(bz-cz,2)) bc, sqrt(pow(ax-cx,2)+pow(ay-cy,2)+pow(az-cz,2)) ac,
  bx-ax ux, b_y-ay uy, bz-az uz, cx-bx vx, cy-b_y vy, cz-bz vz, dx-cx wx, dy-cy wy, dz-cz wz from p),
r as (select *, uy*vz-uz*vy n1x, uz*vx-ux*vz n1y, ux*vy-uy*vx n1z, vy*wz-vz*wy n2x, vz*wx-vx*wz n2y, vx*wy-vy*wx n2z from q),
s as (select *, degrees(acos(greatest(-1, least(1, (n1x*n2x+n1y*n2y+n1z*n2z)/(sqrt(n1x*n1x+n1y*n1y+n1z*n1z)*sqrt(n2x*n2x+n2y*n2y+n2z*n2z)))))) t,
  (n1y*n2z-n1z*n2y)*vx+(n1z*n2x-n1x*n2z)*vy+(n1x*n2y-n1y*n2x)*vz sg from r)
select vec_id, first_point, {rs("ab")} as distance, {rs("degrees(acos(greatest(-1, least(1, (ab*ab+bc*bc-ac*ac)/(2*ab*bc)))))", 5)} as angle,
  {rs("case when sg < 0 then -t else t end", 5)} as dihedral from s
""")
def distances_angles_dihedrals(spark, sf):
    pt = [G.point(*[F.get("embedding", 3 * (F.col("first_point") + i) + j).cast("double") for j in range(3)]) for i in range(4)]
    d = table(spark, sf, "embeddings").withColumn("first_point", F.explode(F.sequence(F.lit(0), F.lit(17))))  # four points of 21 in a row
    return d.select(
        "vec_id", "first_point", rounded(G.distance(pt[0], pt[1])).alias("distance"), rounded(G.angle(*pt[:3]), 5).alias("angle"),
        rounded(G.dihedral(*pt), 5).alias("dihedral"))


@query("select doc_id, length(text)::bigint as n, length(text) - length(replace(text, ' ', '')) as blanks from documents")
def user_annotated_columns(spark, sf):
    import pandas as pd
    from moltables.operators.annotate import annotate

    d = table(spark, sf, "documents").select("doc_id", "text")
    fn = lambda pdf: pd.DataFrame({"n": pdf["text"].str.len(), "blanks": pdf["text"].str.count(" ")})
    return annotate(d, fn, "n bigint, blanks bigint").drop("text")


_AB = "AC"


@query("""
select p_partkey, a || b || c || d as linker, substr(p_name, 1, 0) || a || b || c || d || substr(p_name, 5) as sequence
from part, (values ('A'), ('C')) t1(a), (values ('A'), ('C')) t2(b), (values ('A'), ('C')) t3(c), (values ('A'), ('C')) t4(d)
""")
def enumerated_linker_variants(spark, sf):
    from moltables.operators.variants import linker_variants
    d = table(spark, sf, "part").select("p_partkey", "p_name")
    return linker_variants(d, "p_name", (1, 2, 3, 4), _AB).select("p_partkey", "linker", "sequence")


@query("""
select p_partkey, '{"name":"' || p_name || '","sequences":[{"protein":{"id":["A","B"],"sequence":"' || p_type || '"}}],"modelSeeds":[1],"dialect":"alphafold3","version":1}' as document,
  p_type as sequence, 'A B' as ids from part
""")
def sequence_documents_round_trip(spark, sf):
    from moltables.sources.documents import parse_sequence_document, proteins
    from moltables.sources.sinks import variant_documents
    d = variant_documents(table(spark, sf, "part"), F.col("p_name"), F.array(F.lit("A"), F.lit("B")), F.col("p_type"))
    p = d.select("p_partkey", "document", parse_sequence_document(F.col("document")).alias("d")).select("p_partkey", "document", "d.*")
    return proteins(p, keep=("p_partkey", "document")).select("p_partkey", "document", "sequence", F.array_join("ids", " ").alias("ids"))
