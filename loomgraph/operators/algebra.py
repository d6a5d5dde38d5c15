"""Graph-pattern algebra over triples: patterns, optional parts, unions, filters, construction, updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import TYPE, iri

#: Order in which patterns are joined where nothing else decides: what has constants comes first.
_WEIGHT = {"s": 4, "o": 2, "p": 1}


def _is_var(term: str) -> bool:
    return term.startswith("?")


def pattern(triples: DataFrame, s: str, p: str, o: str, numeric: bool = False) -> DataFrame:
    """Bindings of one pattern: a column for each ?variable; constants become filters that reach the scan.

    p may be several predicates joined by |. A variable that occurs twice has to be equal in both places. With numeric
    the object variable is bound to the number rather than to the text.
    """
    df = triples
    places: dict[str, list[str]] = {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if _is_var(term):
            places.setdefault(term[1:], []).append(place)
        elif place == "p" and "|" in term:
            df = df.where(F.col("p").isin(*(iri(x.strip()) for x in term.split("|"))))
        else:
            df = df.where(F.col(place) == iri(term))
    for where in places.values():
        for other in where[1:]:
            df = df.where(F.col(where[0]) == F.col(other))
    named = [F.col("o_num" if numeric and w[0] == "o" else w[0]).alias(v) for v, w in places.items()]
    return df.select(*named) if named else df.select(F.lit(True).alias("__matched"))


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all variables that both sides bind; a cross product where there is none."""
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, how) if on else left.crossJoin(right)


def match(triples: DataFrame, *patterns: tuple) -> DataFrame:
    """A basic graph pattern: the natural join of its patterns.

    Patterns are reordered so that each shares a variable with those before it, the most constant ones first; the join
    strategy is left to the optimizer.
    """
    rest = sorted(patterns, key=lambda t: -sum(w for (k, w), term in zip(_WEIGHT.items(), (t[0], t[2], t[1])) if not _is_var(term)))
    bound: set[str] = set()
    out = None
    while rest:
        pick = next((t for t in rest if bound & {x for x in t[:3] if _is_var(x)}), rest[0])
        rest.remove(pick)
        df = pattern(triples, *pick)
        out = df if out is None else natural(out, df)
        bound |= {x for x in pick[:3] if _is_var(x)}
    return out


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left outer join on the shared variables; several matches multiply rows, as they do in a query."""
    return natural(left, right if condition is None else right.where(condition), "left")


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables that a part doesn't bind are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(df: DataFrame, variable: str, rows: list[str]) -> DataFrame:
    """df restricted to the given values of a variable. The list is a literal of the plan."""
    return df.where(F.col(variable).isin(*(iri(x) for x in rows)))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left without a compatible row of right; all of left where they share no variable."""
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, "left_anti") if on else left


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, "left_semi")


def regex(c: Column, expression: str) -> Column:
    """Whether expression is found in c, without regard to case; false where c is unbound."""
    return F.coalesce(c.rlike("(?i)" + expression), F.lit(False))


def instances(triples: DataFrame, closure: DataFrame, cls: str) -> DataFrame:
    """(s) of each type triple whose class is cls or below it; as often as there are such triples."""
    below = closure.where(F.col("sup") == iri(cls)).select(F.col("sub").alias("o"))
    return triples.where(F.col("p") == TYPE).join(below, "o", "left_semi").select("s")


def construct(bindings: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """(s, p, o) of each template for each row, as a set; a row that leaves a part unbound makes no triple."""

    def term(t: str) -> Column:
        return F.col(t[1:]).cast("string") if _is_var(t) else F.lit(iri(t))

    rows = bindings.select(F.explode(F.array(*(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in templates))).alias("t")).select("t.*")
    return rows.where("s is not null and p is not null and o is not null").distinct()


def delete(triples: DataFrame, s: str = "?s", p: str = "?p", o: str = "?o") -> DataFrame:
    """triples without those that match."""
    hit = reduce(lambda a, b: a & b, (F.col(c) == iri(t) for c, t in (("s", s), ("p", p), ("o", o)) if not _is_var(t)), F.lit(True))
    return triples.where(~hit)


def upsert(triples: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sets values: all triples of a subject and predicate that fresh has go, then fresh comes in."""
    return triples.join(fresh.select("s", "p").distinct(), ["s", "p"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def append(triples: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds triples to a set of them."""
    return triples.unionByName(fresh, allowMissingColumns=True).dropDuplicates(["s", "p", "o"])


def property_table(triples: DataFrame, predicates: dict[str, str], first_only: bool = True) -> DataFrame:
    """A row for each subject with a column, by name, for each predicate: one shuffle in place of a join for each pattern.

    With first_only the smallest value stands for several; without, columns are sorted arrays.
    """
    named = {iri(p): name for p, name in predicates.items()}
    rows = triples.where(F.col("p").isin(*named))
    pick = (lambda c: F.min(c)) if first_only else (lambda c: F.sort_array(F.collect_set(c)))
    return rows.groupBy("s").agg(*(pick(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in named.items()))


def match_numeric(triples: DataFrame, p: str, variable: str, subject: str = "s") -> DataFrame:
    """(subject, variable) of a predicate's numbers."""
    return pattern(triples, f"?{subject}", p, f"?{variable}", numeric=True)
