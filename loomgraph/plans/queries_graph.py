"""Queries over the graph of world.py, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.search import flexible_pattern
from loomgraph.model import INST, KG, LABEL, NOTE, OBJECT_PROPERTY, SUBCLASS, TYPE
from loomgraph.operators import aggregates as AG
from loomgraph.operators import algebra as A
from loomgraph.operators import graph as G
from loomgraph.operators import paths as P
from loomgraph.plans import catalogue as C
from loomgraph.plans import world as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a function of (triples, closure), or of (spark, sf_dir), under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(W.triples(spark, sf_dir), P.class_closure(W.hierarchy(spark))) if graph else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = W.with_sql(sql) if graph else sql
        return f

    return add


def kg(name: str) -> str:
    return f"'{KG}{name}'"


def of_class(cls: str) -> str:
    return f"select t.s from triples t join closure c on t.p = '{TYPE}' and t.o = c.sub and c.sup = '{KG}{cls}'"


def counts(board: dict[str, str]) -> str:
    return "select " + ", ".join(f"(select count(distinct s) from ({of_class(c[3:])})) as {n}" for n, c in board.items())


# closures and class counts


@query("select 'file' as cls, count(distinct s) as n from (" + of_class("File") + ")")
def class_count_files(t, c):
    return C.count_of(t, c, "kg:File").select(F.lit("file").alias("cls"), "n")


@query(
    "with recursive e(sub, sup) as (select concat('nation/', n_name), concat('region/', r_name) from nation join region on n_regionkey = r_regionkey union all select concat('region/', r_name), 'thing' from region), "
    "c(sub, sup) as (select sub, sub from e union select 'thing', 'thing' union select c.sub, e.sup from c join e on c.sup = e.sub) "
    "select c.sup as cls, count(distinct c_custkey) as n from customer join nation on c_nationkey = n_nationkey join c on c.sub = concat('nation/', n_name) group by 1",
    graph=False,
)
def class_count_closure(spark, d):
    """Customers of each class of places, classes above included: the flagship."""
    customer, nation = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "nation"))
    types = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit("nation/"), "n_name").alias("o"))
    return AG.class_counts(types, P.class_closure(W.places(spark, d)))


@query(
    "with recursive e(sub, sup) as (select concat('nation/', n_name), concat('region/', r_name) from nation join region on n_regionkey = r_regionkey union all select concat('region/', r_name), 'thing' from region), "
    "c(sub, sup, depth) as (select sub, sub, 0 from e union select 'thing', 'thing', 0 union select c.sub, e.sup, c.depth + 1 from c join e on c.sup = e.sub) select sub, sup, depth from c",
    graph=False,
)
def closure_pairs(spark, d):
    return P.class_closure(W.places(spark, d))


@query("select c.sub as sub, c.sup as sup from closure c")
def ontology_closure(t, c):
    return P.class_closure(P.hierarchy(t)).select("sub", "sup")


@query("with recursive e as (select p_partkey as a, p_partkey - p_size as b from part where p_partkey <= 100 and p_partkey > p_size), c(src, dst, depth) as (select a, b, 1 from e union select c.src, e.b, c.depth + 1 from c join e on c.dst = e.a) select cast(src as bigint) as src, cast(dst as bigint) as dst, cast(min(depth) as int) as depth from c group by 1, 2", graph=False)
def path_plus(spark, d):
    """Transitive closure of depth 1 and more over instances, by frontier joins."""
    e = spark.read.parquet(f"{d}/part.parquet").where("p_partkey <= 100 and p_partkey > p_size").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_size")).cast("long").alias("dst"))
    return P.transitive_closure(e, reflexive=False)


@query(counts(C.DASHBOARD))
def class_counts_fused(t, c):
    return AG.count_classes(t, c, C.DASHBOARD)


@query("select sup as cls, count(distinct t.s) as n from triples t join closure on t.p = '" + TYPE + "' and t.o = sub group by 1")
def class_counts_all(t, c):
    return AG.class_counts(t, c)


# algebra


@query(f"select a.s as repo, b.s as file, c.o as ext from triples a join triples b on a.s = b.o join triples c on c.s = b.s where a.p = '{TYPE}' and a.o = {kg('Repository')} and b.p = {kg('belongsToRepository')} and c.p = {kg('hasExtension')} and c.o = '.py'")
def bgp_star(t, c):
    return A.match(t, ("?repo", TYPE, "kg:Repository"), ("?file", "kg:belongsToRepository", "?repo"), ("?file", "kg:hasExtension", ".py")).select("repo", "file", F.lit(".py").alias("ext"))


@query(f"select r.o as repo, count(*) as n from triples r join triples f on r.o = f.s and f.p = {kg('hasFile')} join triples x on x.s = f.o and x.p = {kg('hasCodePart')} where r.p = {kg('hasRepository')} and r.s = '{INST}org/3' group by 1")
def bgp_chain(t, c):
    return A.match(t, (f"{INST}org/3", "kg:hasRepository", "?repo"), ("?repo", "kg:hasFile", "?file"), ("?file", "kg:hasCodePart", "?code")).groupBy("repo").agg(F.count("*").alias("n"))


@query(
    f", a as materialized (select s, o from triples where p = {kg('hasRepository')} and s = '{INST}org/7'), b as materialized (select s, o from triples where p = {kg('hasFile')} and s in (select o from a)), "
    f"c as materialized (select s, o from triples where p = {kg('hasCodePart')} and s in (select o from b)) select a.s as src, c.o as dst from a join b on a.o = b.s join c on b.o = c.s"
)
def path_sequence(t, c):
    e = lambda p: P.edges(t, p)
    return P.sequence(e("kg:hasRepository").where(F.col("src") == f"{INST}org/7"), e("kg:hasFile"), e("kg:hasCodePart"))


@query(f"select s, count(*) as n from triples where p in ({kg('invokes')}, {kg('authoredBy')}) group by 1 having count(*) > 1")
def path_alternative(t, c):
    return A.pattern(t, "?s", "kg:invokes|kg:authoredBy", "?o").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")


@query(f", e as (select s, o from triples where p in ({kg('hasRepository')}, {kg('hasFile')}, {kg('hasCodePart')})), r(x) as (select '{INST}org/5' union select e.o from r join e on e.s = r.x) select x as node from r")
def path_star_alternative(t, c):
    starts = t.sparkSession.createDataFrame([(f"{INST}org/5",)], "n string")
    return P.transitive_closure(P.edges(t, "kg:hasRepository", "kg:hasFile", "kg:hasCodePart"), starts=starts).select(F.col("dst").alias("node"))


@query("select d.doc_id, d.lang, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)", graph=False)
def optional_labels(spark, d):
    return A.optional(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{d}/labels.parquet")).na.fill(-1, ["quality", "toxic"])


@query(f"select r.s as repo, f.o as file, count(*) as n from triples r left join triples f on f.s = r.s and f.p = {kg('hasFile')} left join triples k on k.o = r.s and k.p = {kg('inRepository')} where r.p = '{TYPE}' and r.o = {kg('Repository')} group by 1, 2")
def optional_multiplies(t, c):
    rows = A.optional(A.match(t, ("?repo", TYPE, "kg:Repository")), A.match(t, ("?repo", "kg:hasFile", "?file")))
    return A.optional(rows, A.match(t, ("?commit", "kg:inRepository", "?repo"))).groupBy("repo", "file").agg(F.count("*").alias("n"))


@query(f"select 'out' as direction, o as other from triples where s = '{INST}file/1' and o_kind = 'iri' union all select 'in', s from triples where o = '{INST}file/1'")
def union_in_and_out(t, c):
    out = A.match(t.where("o_kind = 'iri'"), (f"{INST}file/1", "?p", "?other")).select(F.lit("out").alias("direction"), "other")
    return A.union(out, A.match(t, ("?other", "?p", f"{INST}file/1")).select(F.lit("in").alias("direction"), "other"))


@query(f"select s, o from triples where p = '{LABEL}' and s in ('{INST}repo/1', '{INST}repo/2', '{INST}org/3')")
def values_filter(t, c):
    return A.values(A.match(t, ("?s", LABEL, "?o")), "s", [f"{INST}repo/1", f"{INST}repo/2", f"{INST}org/3"])


@query(f"select p, count(*) as n from triples where p in ({', '.join(kg(x[3:]) for x in C.RELATIONSHIPS)}) group by 1")
def in_filter_histogram(t, c):
    return AG.relationship_histogram(t, C.RELATIONSHIPS)


@query(f"select s from triples where p = {kg('hasCyclomaticComplexity')} and o_num > 45")
def numeric_filter(t, c):
    return A.match_numeric(t, C.COMPLEXITY, "n").where("n > 45").select("s")


@query(f"select s from triples where p = '{TYPE}' and o = {kg('Repository')} and s not in (select s from triples where p = {kg('hasFile')})")
def minus_repositories_without_files(t, c):
    return A.minus(A.match(t, ("?s", TYPE, "kg:Repository")), A.match(t, ("?s", "kg:hasFile", "?f")))


@query(f"select s from triples where p = '{TYPE}' and o = {kg('ClassDefinition')} and s in (select o from triples where p = {kg('extendsType')})")
def exists_extended_classes(t, c):
    return A.exists(A.match(t, ("?s", TYPE, "kg:ClassDefinition")), A.match(t, ("?x", "kg:extendsType", "?s")))


@query(f"select s, o as label from triples where p = '{LABEL}' and regexp_matches(o, '(?i)^customer#0000000[0-4]')")
def regex_filter(t, c):
    rows = A.match(t, ("?s", LABEL, "?label"))
    return rows.where(A.regex(F.col("label"), "^customer#0000000[0-4]"))


@query(f"select a.s as s, regexp_replace(a.o, '.*/([^/]+)$', '\\1') as base, lower(b.o) as label from triples a join triples b on a.s = b.s and b.p = '{LABEL}' where a.p = {kg('belongsToRepository')} and contains(b.o, '.java')")
def bind_and_replace(t, c):
    rows = A.match(t, ("?s", "kg:belongsToRepository", "?o"), ("?s", LABEL, "?label")).where(F.col("label").contains(".java"))
    return rows.select("s", F.regexp_replace("o", "^.*[/]([^/]+)$", "$1").alias("base"), F.lower("label").alias("label"))


@query(f"select o as s, '{KG}usedBy' as p, s as o from triples where p = {kg('invokes')} union select s, '{KG}uses', o from triples where p = {kg('invokes')}")
def construct_triples(t, c):
    return A.construct(A.match(t, ("?f", "kg:invokes", "?k")), ("?k", "kg:usedBy", "?f"), ("?f", "kg:uses", "?k"))


@query(f"select count(*) as n from triples where not (p = '{LABEL}')")
def delete_where(t, c):
    return A.delete(t, p=LABEL).agg(F.count("*").alias("n"))


@query(f"select s, o from triples where p = '{NOTE}' and not contains(o, 'PROMO') union all select s, 'promo' from triples where p = '{NOTE}' and contains(o, 'PROMO')")
def upsert_note(t, c):
    notes = t.where(F.col("p") == NOTE).select("s", "p", "o")
    fresh = notes.where(F.col("o").contains("PROMO")).withColumn("o", F.lit("promo"))
    return A.upsert(notes, fresh).select("s", "o")


@query(f"select count(*) as triples, count(distinct s) as subjects, count(distinct p) as predicates, count(distinct o) as objects from triples")
def graph_stats(t, c):
    return AG.graph_stats(t)


# catalogue


@query(
    f"select x.*, (select count(*) from triples where p in (select s from triples where p = '{TYPE}' and o = '{OBJECT_PROPERTY}')) as relationships, (select count(*) from triples where p = {kg('imports')}) as imports, "
    f"(select round(coalesce(avg(m.o_num), 0), 6) from ({of_class('FunctionDefinition')}) f join triples m on m.s = f.s and m.p = {kg('hasCyclomaticComplexity')}) as mean_complexity, "
    f"(select coalesce(sum(m.o_num), 0) from ({of_class('FunctionDefinition')}) f join triples m on m.s = f.s and m.p = {kg('hasCyclomaticComplexity')}) as total_complexity from ({counts(C.DASHBOARD)}) x"
)
def dashboard(t, c):
    return C.dashboard(t, c)


for _name, _board in (("codebase", C.CODEBASE), ("entity_distribution", C.ENTITIES), ("documentation", C.DOCUMENTATION), ("development", C.DEVELOPMENT), ("assets", C.ASSETS)):

    def _f(t, c, board=_board):
        return AG.count_classes(t, c, board)

    _f.__name__ = f"analytics_{_name}"
    query(counts(_board))(_f)


@query(f"select count(distinct s) as n from triples where p = '{TYPE}' and o = {kg('Repository')}")
def repositories_count(t, c):
    return C.exact_count(t, "kg:Repository")


@query(f"select count(*) as n from triples where p in (select s from triples where p = '{TYPE}' and o = '{OBJECT_PROPERTY}')")
def relationships_count(t, c):
    return C.relationships(t)


@query(f"select count(*) as n from triples where p = {kg('imports')}")
def imports_count(t, c):
    return C.imports(t)


_LANG = "case o when '.py' then 'Python' when '.js' then 'JavaScript' when '.md' then 'Markdown' when '.java' then 'Java' else ltrim(o, '.') end"


@query(f"select {_LANG} as language, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as percent from triples where p = {kg('hasExtension')} group by 1")
def language_distribution(t, c):
    return C.language_distribution(t)


@query(f"select {_LANG} as language, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 1) as percent from triples where p = {kg('hasExtension')} group by 1")
def analytics_languages(t, c):
    return C.language_distribution(t, 1)


_CX = f"triples m where m.p = {kg('hasCyclomaticComplexity')}"


@query(f"select (select round(avg(o_num), 6) from {_CX}) as mean, (select count(*) from {_CX} and o_num > 10) as complex, (select sum(o_num) from triples where p = {kg('hasLineCount')}) as lines")
def analytics_complexity(t, c):
    return C.complexity_analytics(t, c)


@query(f"select o.s as org, max(l.o) as label, count(*) as n, string_agg(n.o, ',' order by n.o) as repositories from triples o join triples r on r.s = o.s and r.p = {kg('hasRepository')} join triples l on l.s = o.s and l.p = '{LABEL}' join triples n on n.s = r.o and n.p = '{LABEL}' where o.p = '{TYPE}' and o.o = {kg('Organization')} group by 1")
def organizations(t, c):
    return C.organizations(t)


@query(
    f", repos as (select o as repo from triples where s = '{INST}org/3' and p = {kg('hasRepository')}), files as (select t.o as f from triples t join repos on t.s = repo and t.p = {kg('hasFile')}) "
    f"select (select count(*) from repos) as repositories, (select count(distinct f) from files) as files, (select count(*) from files join triples a on a.o = f and a.p = {kg('isCodePartOf')} join triples b on b.s = a.s and b.o_kind = 'iri') as relationships"
)
def organization_by_id(t, c):
    return C.organization(t, c, f"{INST}org/3")


@query(f"select r.s as repo, l.o as name, max(m.o) as updated from triples r join triples l on l.s = r.s and l.p = '{LABEL}' left join (triples f join triples m on m.s = f.o and f.p = {kg('hasFile')} and m.p = {kg('modified')}) on f.s = r.s where r.p = '{TYPE}' and r.o = {kg('Repository')} group by 1, 2")
def repositories(t, c):
    return C.repositories(t)


@query(
    f", r as (select s as repo from triples where p = '{TYPE}' and o = {kg('Repository')}), f as (select s as repo, o as file from triples where p = {kg('hasFile')}), k as (select f.repo, x.s as code from f join triples x on x.p = {kg('isCodePartOf')} and x.o = f.file) "
    f"select r.repo, (select count(distinct file) from f where f.repo = r.repo) as files, coalesce(a.n, 0) as entities, coalesce(b.m, 0) as mean_complexity, coalesce(p.n, 0) as contributors, cast(null as string) as note, "
    f"case e.x when '.py' then 'Python' when '.js' then 'JavaScript' when '.md' then 'Markdown' when '.java' then 'Java' else ltrim(e.x, '.') end as language from r "
    f"left join (select repo, count(distinct code) as n from k group by 1) a on a.repo = r.repo left join (select repo, round(avg(o_num), 6) as m from k join triples x on x.s = code and x.p = {kg('hasCyclomaticComplexity')} group by 1) b on b.repo = r.repo "
    f"left join (select f.repo, min(x.o) as x from f join triples x on x.s = f.file and x.p = {kg('hasExtension')} group by 1) e on e.repo = r.repo "
    f"left join (select i.o as repo, count(distinct a.o) as n from triples i join triples a on a.s = i.s and a.p = {kg('authoredBy')} where i.p = {kg('inRepository')} group by 1) p on p.repo = r.repo"
)
def repository_rollup(t, c):
    return C.repository_rollup(t)




@query(f"select t.s as s, coalesce(l.o, 'Unknown') as name, lower(regexp_replace(t.o, '.*#', '')) as kind, 'Unknown' as repository, 0 as line, 0.5::double as confidence from triples t left join triples l on l.s = t.s and l.p = '{LABEL}' left join triples n on n.s = t.s and n.p = '{NOTE}' where t.p = '{TYPE}' and (regexp_matches(l.o, '(?i){flexible_pattern('red widgets')}') or regexp_matches(n.o, '(?i){flexible_pattern('red widgets')}')) order by 1 limit 50")
def search_flexible(t, c):
    return C.search(t, c, "red widgets")


@query(
    f", w as (select t.s as id, coalesce(min(l.o), '') as name, min(t.o) as cls, min(r.o) as cl from triples t left join triples l on l.s = t.s and l.p = '{LABEL}' left join triples r on r.s = t.s and r.p = {kg('belongsToRepository')} where t.p = '{TYPE}' group by 1 order by 1 limit 500) "
    "select id, case name when '' then regexp_replace(id, '.*[#/]', '') else name end as name, case lower(regexp_replace(cls, '.*[#/]', '')) when 'repository' then 'repository' when 'file' then 'file' when 'sourcefile' then 'file' when 'functiondefinition' then 'function' when 'classdefinition' then 'class' else 'concept' end as kind, "
    "case lower(regexp_replace(cls, '.*[#/]', '')) when 'repository' then 20 when 'file' then 12 when 'sourcefile' then 12 when 'functiondefinition' then 8 else 10 end as size, coalesce(cl, 'none') as cluster from w"
)
def graph_nodes(t, c):
    return C.graph_nodes(t, 500)


@query(
    f", w as (select s as id from triples where p = '{TYPE}' and s like '{INST}class/%') select distinct s as src, o as dst, 'extends' as kind, 0.9::double as weight from triples where p = {kg('extendsType')} and s in (select id from w) and o in (select id from w)"
)
def graph_edges(t, c):
    nodes = A.match(t, ("?id", TYPE, "kg:ClassDefinition")).where(F.col("id").startswith(f"{INST}class/"))
    return C.graph_edges(t, nodes).select("src", "dst", "kind", F.col("weight").cast("double").alias("weight"))


@query(f"select r.o as cluster, count(*) as size, string_agg(r.s, ',' order by r.s) as members from triples r where r.p = {kg('belongsToRepository')} group by 1")
def graph_clusters(t, c):
    nodes = A.match(t, ("?id", "kg:belongsToRepository", "?cluster"))
    return G.clusters(nodes, "cluster").select("cluster", "size", F.array_join("members", ",").alias("members"))


@query(f"select 'out' as direction, t.p as p, t.o as other, l.o as label from triples t left join triples l on l.s = t.o and l.p = '{LABEL}' where t.s = '{INST}repo/10' union all select 'in', t.p, t.s, l.o from triples t left join triples l on l.s = t.s and l.p = '{LABEL}' where t.o = '{INST}repo/10'")
def entity_details(t, c):
    return C.entity(t, f"{INST}repo/10")


@query(
    f", k as (select s, regexp_replace(o, '.*/([^/]+)$', '\\1') as file from triples where p = {kg('isCodePartOf')}) select a.file as file, a.n as functions, b.c as complexity, l.l as lines from (select file, count(*) as n from k join triples t on t.s = k.s and t.p = '{TYPE}' and t.o = {kg('FunctionDefinition')} group by 1) a "
    f"join (select file, sum(o_num) as c from k join triples t on t.s = k.s and t.p = {kg('hasCyclomaticComplexity')} group by 1) b on a.file = b.file join (select file, sum(o_num) as l from k join triples t on t.s = k.s and t.p = {kg('hasLineCount')} group by 1) l on l.file = a.file order by 3 desc, 1 limit 50"
)
def complexity_by_file(t, c):
    return C.complexity_by_file(t)


@query(f"select round(avg(t.o_num), 6) as mean, count(*) as functions from triples t join triples f on f.s = t.s and f.p = '{TYPE}' and f.o = {kg('FunctionDefinition')} where t.p = {kg('hasCyclomaticComplexity')}")
def complexity_overall(t, c):
    return C.overall_complexity(t)


@query(f"select case when o_num <= 5 then 'low' when o_num <= 10 then 'medium' when o_num <= 20 then 'high' else 'very high' end as bucket, count(*) as n from {_CX} group by 1")
def complexity_distribution(t, c):
    return C.complexity_distribution(t)


@query("select count(*) as n from triples")
def health_probe(t, c):
    return C.health(t)


@query("select s, p, o from triples order by s, p, o limit 1000")
def export_triples(t, c):
    return C.export_rows(t)


@query(f"select s, p, o from triples where o_kind = 'iri' and p not in ('{TYPE}', '{SUBCLASS}') order by s, p, o limit 50000")
def all_edges(t, c):
    return C.all_edges(t)


@query(f"select s, min(o) as type, (select min(o) from triples l where l.s = t.s and l.p = '{LABEL}') as label from triples t where p = '{TYPE}' group by s order by s limit 10000")
def all_nodes(t, c):
    return C.all_nodes(t)


@query(f"select s, o as label from triples where p = '{LABEL}' and lower(o) like '%file12%' order by o desc, s desc limit 100")
def search_nodes(t, c):
    return C.search_nodes(t, "File12")


@query(f"select node, p from (select o as node, p from triples where s = '{INST}file/1' and o_kind = 'iri' union all select s, p from triples where o = '{INST}file/1') order by 1, 2 limit 50")
def neighbours(t, c):
    return C.neighbours(t, f"{INST}file/1")


@query(f"select distinct s from triples where p = {kg('belongsToRepository')} and o = '{INST}repo/4'")
def cluster_nodes(t, c):
    return C.cluster_nodes(t, f"{INST}repo/4")


@query(
    f", ty as (select distinct s, o as cls from triples where p = '{TYPE}'), per as (select s, p, count(*) as c from triples where p <> '{TYPE}' group by 1, 2), tot as (select cls, count(*) as total from ty group by 1) "
    "select cls, p, n, round(n / total, 6) as share, concat(cast(cast(round_even(n / total * 100, 0) as int) as string), '%') as frequency, case when most > 1 then 'multiple' else 'single' end as cardinality from (select cls, p, count(*) as n, max(c) as most from ty join per using (s) group by 1, 2) join tot using (cls)"
)
def class_property_profile(t, c):
    return AG.class_profile(t)


@query(f", ty as (select distinct s, o as cls from triples where p = '{TYPE}') select cls, string_agg(distinct t.p, ',' order by t.p) as properties from ty join triples t on t.s = ty.s and t.p <> '{TYPE}' group by 1")
def class_property_sets(t, c):
    return AG.class_properties(t).select("cls", F.array_join("properties", ",").alias("properties"))


@query(f"select repo, file, time from (select f.s as repo, f.o as file, m.o as time, row_number() over (partition by f.s order by m.o desc, f.o) as r from triples f join triples m on m.s = f.o and m.p = {kg('modified')} where f.p = {kg('hasFile')}) where r = 1")
def newest_file_per_repository(t, c):
    return C.newest_per_repository(t)


@query(f"select distinct t.s as s, '{TYPE}' as p, c.sup as o from triples t join closure c on t.p = '{TYPE}' and t.o = c.sub where t.s like '{INST}file/%'")
def materialised_superclasses(t, c):
    return AG.materialise_superclasses(t.where(F.col("s").startswith(f"{INST}file/")), c)


@query(f"select s, p, o from triples where p in ({kg('hasFile')}, {kg('belongsToRepository')}) union select o, case p when {kg('hasFile')} then {kg('belongsToRepository')} else {kg('hasFile')} end, s from triples where p in ({kg('hasFile')}, {kg('belongsToRepository')})")
def materialised_inverses(t, c):
    own = t.where(F.col("p").isin(KG + "hasFile", KG + "belongsToRepository"))
    return AG.materialise_inverses(own, [("kg:hasFile", "kg:belongsToRepository")])


@query(f"select lower(o) as label, max(s) as s from triples where p = '{LABEL}' group by 1")
def label_index(t, c):
    return AG.label_index(t, LABEL)


@query(f"select s, min(case when p = '{TYPE}' then o end) as type, min(case when p = '{LABEL}' then o end) as label, min(case when p = '{NOTE}' then o end) as note from triples where p in ('{TYPE}', '{LABEL}', '{NOTE}') group by 1")
def property_table(t, c):
    return A.property_table(t, {TYPE: "type", LABEL: "label", NOTE: "note"})
