"""A knowledge graph laid over relational tables: each predicate is a projection, so a filter on it prunes all others.

Nations are organizations, customers repositories, orders files, line items functions, parts classes, suppliers
contributors, events commits, documents documentation. The definitions are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import INST, KG, LABEL, NOTE, OBJECT_PROPERTY, SUBCLASS, TYPE, XSD, typed

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _id(kind: str, key: str) -> str:
    return f"concat('{INST}{kind}/', cast({key} as string))"


def _kg(name: str) -> str:
    return f"'{KG}{name}'"


_ORG, _REPO, _FILE, _PART, _WHO, _DOC, _COMMIT = _id("org", "n_nationkey"), _id("repo", "c_custkey"), _id("file", "o_orderkey"), _id("class", "p_partkey"), _id("person", "s_suppkey"), _id("doc", "doc_id"), _id("commit", "event_id")
_FUNC = f"concat('{INST}function/', cast(l_orderkey as string), '-', cast(l_linenumber as string))"
_OF = f"concat('{INST}file/', cast(l_orderkey as string))"
_KIND = f"case substring(o_orderpriority, 1, 1) when '1' then {_kg('SourceFile')} when '2' then {_kg('DocumentationFile')} when '3' then {_kg('ImageFile')} when '4' then {_kg('TestFile')} else {_kg('File')} end"
_EXT = "case o_orderkey % 5 when 0 then '.py' when 1 then '.js' when 2 then '.md' when 3 then '.java' else '.xyz' end"
_DOCKIND = f"case lang when 'en' then {_kg('Readme')} when 'fr' then {_kg('CodeComment')} when 'de' then {_kg('APIDocumentation')} else {_kg('Documentation')} end"

#: (table, subject, predicate, object, kind of object, its datatype)
MAPPING = [
    ("nation", _ORG, TYPE, _kg("Organization"), "iri", None),
    ("nation", _ORG, LABEL, "n_name", "lit", "string"),
    ("customer", _id("org", "c_nationkey"), KG + "hasRepository", _REPO, "iri", None),
    ("customer", _REPO, TYPE, _kg("Repository"), "iri", None),
    ("customer", _REPO, LABEL, "c_name", "lit", "string"),
    ("orders", _id("repo", "o_custkey"), KG + "hasFile", _FILE, "iri", None),
    ("orders", _FILE, KG + "belongsToRepository", _id("repo", "o_custkey"), "iri", None),
    ("orders", _FILE, TYPE, _KIND, "iri", None),
    ("orders", _FILE, LABEL, f"concat('file', cast(o_orderkey as string), {_EXT})", "lit", "string"),
    ("orders", _FILE, KG + "hasExtension", _EXT, "lit", "string"),
    ("orders", _FILE, KG + "hasSize", "cast(cast(floor(o_totalprice) as bigint) as string)", "lit", "nonNegativeInteger"),
    ("orders", _FILE, KG + "modified", "cast(o_orderdate as string)", "lit", "dateTime"),
    ("lineitem", _FUNC, TYPE, _kg("FunctionDefinition"), "iri", None),
    ("lineitem", _FUNC, KG + "isCodePartOf", _OF, "iri", None),
    ("lineitem", _OF, KG + "hasCodePart", _FUNC, "iri", None),
    ("lineitem", _FUNC, KG + "hasCyclomaticComplexity", "cast(cast(floor(l_quantity) as bigint) as string)", "lit", "nonNegativeInteger"),
    ("lineitem", _FUNC, KG + "hasLineCount", "cast(l_linenumber * 10 as string)", "lit", "nonNegativeInteger"),
    ("lineitem", _FUNC, KG + "invokes", _id("class", "l_partkey"), "iri", None),
    ("lineitem", _FUNC, KG + "authoredBy", _id("person", "l_suppkey"), "iri", None),
    ("part", _PART, TYPE, _kg("ClassDefinition"), "iri", None),
    ("part", _PART, LABEL, "p_name", "lit", "string"),
    ("part", _PART, NOTE, "p_type", "lit", "string"),
    ("part", _PART, KG + "extendsType", _id("class", "p_partkey - p_size"), "iri", None),
    ("supplier", _WHO, TYPE, _kg("Contributor"), "iri", None),
    ("supplier", _WHO, LABEL, "s_name", "lit", "string"),
    ("events", _COMMIT, TYPE, _kg("Commit"), "iri", None),
    ("events", _COMMIT, LABEL, "event_type", "lit", "string"),
    ("events", _COMMIT, KG + "authoredBy", _id("person", "user_id % 100 + 1"), "iri", None),
    ("events", _COMMIT, KG + "inRepository", _id("repo", "user_id"), "iri", None),
    ("documents", _DOC, TYPE, _DOCKIND, "iri", None),
    ("documents", _DOC, LABEL, "concat(lang, ' document ', cast(doc_id as string))", "lit", "string"),
    ("documents", _DOC, KG + "isAbout", f"concat('{INST}topic/', source)", "iri", None),
]
CLASSES = {
    "InformationArtifact": "Thing", "CodeEntity": "InformationArtifact", "File": "InformationArtifact", "SourceFile": "File", "TestFile": "SourceFile", "DocumentationFile": "File", "AssetFile": "File", "ImageFile": "AssetFile", "AudioFile": "AssetFile", "VideoFile": "AssetFile", "FontFile": "AssetFile",
    "FunctionDefinition": "CodeEntity", "ClassDefinition": "CodeEntity", "InterfaceDefinition": "CodeEntity", "AttributeDeclaration": "CodeEntity", "VariableDeclaration": "CodeEntity", "Parameter": "VariableDeclaration", "Documentation": "InformationArtifact", "Readme": "Documentation", "CodeComment": "Documentation", "APIDocumentation": "Documentation",
    "Repository": "Thing", "Organization": "Agent", "Contributor": "Agent", "Agent": "Thing", "Commit": "Event", "Issue": "Event", "Event": "Thing",
}
OBJECT_PROPERTIES = "hasRepository hasFile belongsToRepository isCodePartOf hasCodePart invokes authoredBy extendsType inRepository isAbout".split()


def _ontology() -> list[tuple]:
    rows = [(KG + a, SUBCLASS, KG + b, "iri", None) for a, b in CLASSES.items()]
    return rows + [(KG + p, TYPE, OBJECT_PROPERTY, "iri", None) for p in OBJECT_PROPERTIES]


def triples(spark: SparkSession, sf_dir: str, ontology: bool = True) -> DataFrame:
    """The graph, with its ontology in it. No two rows are equal, so none need be dropped.

    One statement of projections with constant predicates: a filter on the predicate leaves only the scans that matter,
    with only their columns.
    """
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in dict.fromkeys(m[0] for m in MAPPING)}
    null = "cast(null as string)"
    parts = [f"select {s} as s, '{p}' as p, {o} as o, '{kind}' as o_kind, {f"'{data}'" if data else null} as o_type from {{{name}}}" for name, s, p, o, kind, data in MAPPING]
    if ontology:
        rows = ", ".join(f"('{s}', '{p}', '{o}', '{kind}', {null})" for s, p, o, kind, _ in _ontology())
        parts.append(f"select * from values {rows} as t(s, p, o, o_kind, o_type)")
    return typed(spark.sql(" union all ".join(parts), **tables), distinct=False)


def hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(KG + a, KG + b) for a, b in CLASSES.items()], "sub string, sup string")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class hierarchy from the tables: nations below regions below a top."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    low = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("nation/"), "n_name").alias("sub"), F.concat(F.lit("region/"), "r_name").alias("sup"))
    return low.union(r.select(F.concat(F.lit("region/"), "r_name"), F.lit("thing")))


def triples_sql(ontology: bool = True) -> str:
    """The graph as a common table expression: triples(s, p, o, o_kind, o_num)."""
    parts = []
    for name, s, p, o, kind, data in MAPPING:
        number = f"try_cast({o} as double)" if data and data != "string" and data != "dateTime" else "cast(null as double)"
        parts.append(f"select {s} as s, '{p}' as p, {o} as o, '{kind}' as o_kind, {number} as o_num from {name}")
    if ontology:
        parts += [f"select '{s}', '{p}', '{o}', '{k}', null" for s, p, o, k, _ in _ontology()]
    return "triples as (" + " union all ".join(parts) + ")"


CLOSURE_SQL = (
    f"closure(sub, sup) as (select distinct x, x from (select s as x from triples where p = '{SUBCLASS}' union select o from triples where p = '{SUBCLASS}') "
    f"union select c.sub, t.o from closure c join triples t on t.s = c.sup and t.p = '{SUBCLASS}')"
)


def with_sql(body: str) -> str:
    """A query over triples and closure."""
    return f"with recursive {triples_sql()}, {CLOSURE_SQL} {body}"


XSD_STRING = XSD + "string"
