"""Commits, contributors, issues and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import commit_label, contributor_name, epoch_iso, is_fix, issue_references, uri_safe
from loomgraph.model import INST, KG, iri, link, typed, value

COMMIT = "repo_name string, commit_hash string, commit_message string, commit_timestamp long, commit_author string, modified_files array<string>, issue_references array<string>"
_STRUCT = "array<struct<s:string,p:string,o:string,o_kind:string,o_type:string>>"


def with_references(commits: DataFrame) -> DataFrame:
    return commits.withColumn("issue_references", F.array_distinct(issue_references(F.col("commit_message"))))


def contributors(commits: DataFrame) -> DataFrame:
    """(repo_name, contributor): each person of a repository once, however the name is spelled."""
    return commits.select("repo_name", contributor_name(F.col("commit_author")).alias("contributor")).where("contributor <> ''").distinct()


def triples(commits: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Triples of commits, their authors, the issues that they name, fix or not, and the files that they change.

    One pass and one shuffle for all; with predicates only theirs are made. What parts share is worked out once a row.
    """
    wanted = None if predicates is None else {iri(p) for p in predicates}
    some = lambda parts: F.array(*(f(s, p, *o) for f, s, p, *o in parts if wanted is None or iri(p) in wanted)) if wanted is None or any(iri(x[2]) in wanted for x in parts) else None
    name = contributor_name(F.col("commit_author"))
    rows = commits.where("commit_hash is not null").withColumns({"__repo": F.concat(F.lit(INST), uri_safe(F.col("repo_name"))), "__name": name, "__files": F.transform("modified_files", uri_safe)})
    rows = rows.withColumns({"__commit": F.concat("__repo", F.lit("/commit/"), "commit_hash"), "__who": F.when(F.col("__name") != "", F.concat(F.lit(INST + "contributor/"), uri_safe(F.lower("__name"))))})
    repo, c, who, name = (F.col(x) for x in ("__repo", "__commit", "__who", "__name"))
    one = some([
        (link, repo, "rdf:type", F.lit(KG + "Repository")), (link, c, "rdf:type", F.lit(KG + "Commit")), (link, repo, "kg:hasCommit", c), (link, c, "kg:isCommitIn", repo), (value, c, "rdfs:label", commit_label(F.col("commit_hash"), F.col("commit_message"))), (value, c, "kg:hasCommitHash", F.col("commit_hash")),
        (value, c, "kg:hasCommitMessage", F.nullif("commit_message", F.lit(""))), (value, c, "kg:committedAt", epoch_iso(F.col("commit_timestamp")), "dateTime"), (link, c, "kg:authoredBy", who), (link, who, "kg:isAuthorOf", c), (link, who, "rdf:type", F.when(who.isNotNull(), F.lit(KG + "Contributor"))), (value, who, "rdfs:label", name),
    ])

    def of_issue(x: Column) -> Column | None:
        issue = F.concat(repo, F.lit("/issue/"), x)
        fixed = F.when(is_fix(F.col("commit_message")), issue)
        return some([(link, issue, "rdf:type", F.lit(KG + "Issue")), (value, issue, "rdfs:label", F.concat(F.lit("#"), x)), (link, c, "kg:referencesIssue", issue), (link, issue, "kg:isReferencedBy", c), (link, c, "kg:fixesIssue", fixed), (link, fixed, "kg:isFixedBy", c)])

    def of_file(x: Column) -> Column | None:
        file, change = F.concat(repo, F.lit("/"), x), F.concat(c, F.lit("/modification/"), x)
        return some([(link, change, "rdf:type", F.lit(KG + "FileModification")), (link, c, "kg:modifies", file), (link, file, "kg:isModifiedBy", c), (link, change, "kg:isPartOfCommit", c), (link, change, "kg:isModificationOf", file)])

    each = lambda many, of: None if of(F.lit("")) is None else F.coalesce(F.flatten(F.transform(many, of)), F.array().cast(_STRUCT))
    parts = [x for x in (one, each("issue_references", of_issue), each("__files", of_file)) if x is not None]
    return typed(rows.select(F.explode(F.concat(*parts)).alias("t")).select("t.*"))
