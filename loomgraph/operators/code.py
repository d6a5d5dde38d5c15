"""Constructs of source code and the relations between them.

A construct is a row (repository, path, kind, name, parent, start_line, end_line, raw, type, items): items are its
parameters, bases, arguments, decorators or imported names, whichever its kind has.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import access_modifier, canonical_name, complexity, file_line_count, is_primitive, modifiers, token_count, truncate_label, uri_safe
from loomgraph.model import INST, KG, from_structs, iri, link, typed, value
from loomgraph.operators.paths import cut

CONSTRUCT = "repository string, path string, kind string, name string, parent string, start_line int, end_line int, raw string, type string, items array<string>"
_COLUMNS = [c.split()[0] for c in CONSTRUCT.split(", ")]
_ARROW = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in CONSTRUCT.split(", ")]
_SLICE = 1 << 22

#: By language: kind, and a pattern whose groups are name, type or base list, and parameters, by the names n, t and i.
PATTERNS = {
    "js": [("class", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?<n>\w+)(?:\s+extends\s+(?<t>[\w.]+))?"), ("function", r"(?m)^[ \t]*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(?<n>\w+)\s*\((?<i>[^)]*)\)(?:\s*:\s*(?<t>[\w<>\[\]|]+))?"), ("interface", r"(?m)^[ \t]*(?:export\s+)?interface\s+(?<n>\w+)(?:\s+extends\s+(?<i>[\w., ]+))?"), ("enum", r"(?m)^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(?<n>\w+)"), ("import", r"(?m)^[ \t]*import\s+(?:(?<i>[\w*{}, ]+)\s+from\s+)?['\"](?<n>[^'\"]+)['\"]"), ("variable", r"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?<n>\w+)(?:\s*:\s*(?<t>[\w<>\[\]|]+))?"), ("type", r"(?m)^[ \t]*(?:export\s+)?type\s+(?<n>\w+)\s*=\s*(?<t>[^;\n]+)")],
    "java": [("class", r"(?m)^[ \t]*(?:(?:public|private|protected|abstract|final|static|sealed|partial|internal)\s+)*class\s+(?<n>\w+)(?:\s*(?:extends|:)\s*(?<t>[\w.]+))?(?:[^{\n]*implements\s+(?<i>[\w., ]+))?"), ("interface", r"(?m)^[ \t]*(?:(?:public|private|protected|internal)\s+)*interface\s+(?<n>\w+)(?:\s*(?:extends|:)\s*(?<i>[\w., ]+))?"), ("enum", r"(?m)^[ \t]*(?:(?:public|private|protected|internal)\s+)*enum\s+(?<n>\w+)"), ("struct", r"(?m)^[ \t]*(?:(?:public|private|internal|readonly)\s+)*struct\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|async|override|virtual|internal)\s+)*(?!(?:return|new|else|throw|case|await|yield)\b)(?<t>[\w<>\[\],.?]+)\s+(?!(?:if|for|while|switch|catch)\b)(?<n>\w+)\s*\((?<i>[^)]*)\)(?=[^;{}()=]*[{;])"), ("import", r"(?m)^[ \t]*(?:import|using)\s+(?:static\s+)?(?<n>[\w.*]+)\s*;"), ("variable", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|readonly)\s+)+(?<t>[\w<>\[\],.?]+)\s+(?<n>\w+)\s*(?:=|;)")],
    "go": [("struct", r"(?m)^type\s+(?<n>\w+)\s+struct"), ("interface", r"(?m)^type\s+(?<n>\w+)\s+interface"), ("function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(?<n>\w+)\s*\((?<i>[^)]*)\)\s*(?<t>[\w.*\[\]]+)?"), ("import", r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"(?<n>[\w./-]+)\"\s*$"), ("variable", r"(?m)^[ \t]*(?:var|const)\s+(?<n>\w+)(?:[ \t]+(?<t>[\w.*\[\]]+))?")],
    "rust": [("struct", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?<n>\w+)"), ("enum", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?<n>\w+)"), ("trait", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?<n>\w+)"), ("module", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?<n>\w+)[^(]*\((?<i>[^)]*)\)(?:\s*->\s*(?<t>[\w<>&:]+))?"), ("import", r"(?m)^[ \t]*use\s+(?<n>[\w:]+)")],
    "ruby": [("class", r"(?m)^[ \t]*class\s+(?<n>\w+)(?:\s*<\s*(?<t>[\w:]+))?"), ("module", r"(?m)^[ \t]*module\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*def\s+(?:self\.)?(?<n>\w+[?!]?)(?:\s*\((?<i>[^)]*)\))?"), ("import", r"(?m)^[ \t]*require(?:_relative)?\s+['\"](?<n>[^'\"]+)")],
    "php": [("class", r"(?m)^[ \t]*(?:(?:abstract|final)\s+)*class\s+(?<n>\w+)(?:\s+extends\s+(?<t>[\w\\]+))?(?:\s+implements\s+(?<i>[\w\\, ]+))?"), ("interface", r"(?m)^[ \t]*interface\s+(?<n>\w+)"), ("trait", r"(?m)^[ \t]*trait\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*(?:(?:public|private|protected|static)\s+)*function\s+(?<n>\w+)\s*\((?<i>[^)]*)\)"), ("import", r"(?m)^[ \t]*use\s+(?<n>[\w\\]+)")],
    "c": [("struct", r"(?m)^[ \t]*(?:typedef\s+)?struct\s+(?<n>\w+)"), ("enum", r"(?m)^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?(?<n>\w+)"), ("class", r"(?m)^[ \t]*class\s+(?<n>\w+)(?:\s*:\s*(?:public|private|protected)\s+(?<t>[\w:]+))?"), ("function", r"(?m)^(?<t>[\w*&:<>]+)[ \t*&]+(?<n>\w+)\s*\((?<i>[^;{)]*)\)\s*\{"), ("import", r"(?m)^[ \t]*#\s*include\s+[<\"](?<n>[^>\"]+)")],
    "swift": [("class", r"(?m)^[ \t]*(?:(?:public|private|open|final|internal)\s+)*class\s+(?<n>\w+)(?:\s*:\s*(?<t>\w+))?"), ("struct", r"(?m)^[ \t]*(?:(?:public|private|internal)\s+)*struct\s+(?<n>\w+)"), ("interface", r"(?m)^[ \t]*(?:(?:public|private|internal)\s+)*protocol\s+(?<n>\w+)"), ("enum", r"(?m)^[ \t]*(?:(?:public|private|indirect)\s+)*enum\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*(?:(?:public|private|static|override|internal)\s+)*func\s+(?<n>\w+)\s*\((?<i>[^)]*)\)(?:\s*->\s*(?<t>[\w<>\[\]?]+))?"), ("import", r"(?m)^import\s+(?<n>[\w.]+)"), ("variable", r"(?m)^[ \t]*(?:let|var)\s+(?<n>\w+)(?:\s*:\s*(?<t>[\w<>\[\]?]+))?")],
    "scala": [("class", r"(?m)^[ \t]*(?:(?:abstract|case|final|sealed)\s+)*class\s+(?<n>\w+)(?:[^{\n]*?\bextends\s+(?<t>\w+))?"), ("trait", r"(?m)^[ \t]*(?:sealed\s+)?trait\s+(?<n>\w+)"), ("module", r"(?m)^[ \t]*(?:case\s+)?object\s+(?<n>\w+)"), ("function", r"(?m)^[ \t]*(?:(?:override|private|protected)\s+)*def\s+(?<n>\w+)(?:\s*\((?<i>[^)]*)\))?(?:\s*:\s*(?<t>[\w\[\]]+))?"), ("import", r"(?m)^[ \t]*import\s+(?<n>[\w.]+)"), ("variable", r"(?m)^[ \t]*va[lr]\s+(?<n>\w+)(?:\s*:\s*(?<t>[\w\[\]]+))?")],
    "lua": [("function", r"(?m)^[ \t]*(?:local\s+)?function\s+(?<n>[\w.:]+)\s*\((?<i>[^)]*)\)"), ("variable", r"(?m)^[ \t]*local\s+(?<n>\w+)\s*="), ("import", r"(?m)\brequire\s*\(?\s*['\"](?<n>[^'\"]+)")],
    "bash": [("function", r"(?m)^[ \t]*(?:function\s+)?(?<n>[\w-]+)\s*\(\)"), ("variable", r"(?m)^[ \t]*(?:export\s+|local\s+|readonly\s+)*(?<n>[A-Za-z_]\w*)="), ("import", r"(?m)^[ \t]*(?:source|\.)\s+(?<n>\S+)")],
    "css": [("class", r"(?m)^[ \t]*\.(?<n>[\w-]+)[^;{}]*(?=\{)"), ("function", r"(?m)^[ \t]*@(?:mixin|function)\s+(?<n>[\w-]+)(?:\s*\((?<i>[^)]*)\))?"), ("variable", r"(?m)^[ \t]*(?<n>(?:--|\$)[\w-]+)\s*:"), ("import", r"(?m)^[ \t]*@(?:import|use)\s+(?:url\()?['\"](?<n>[^'\"]+)")],
    "html": [("import", r"<(?:script|link|img|iframe)\b[^>]*?\b(?:src|href)\s*=\s*['\"](?<n>[^'\"]+)"), ("variable", r"<\w+\b[^>]*?\bid\s*=\s*['\"](?<n>[^'\"]+)")],
}
FAMILY = {e: f for f, es in (("js", ".js .mjs .jsx .ts .tsx"), ("java", ".java .cs .kt"), ("go", ".go"), ("rust", ".rs"), ("ruby", ".rb"), ("php", ".php"), ("c", ".c .h .cpp"), ("swift", ".swift"), ("scala", ".scala"), ("lua", ".lua"), ("bash", ".sh .bash"), ("css", ".css .scss"), ("html", ".html .htm")) for e in es.split()}
_READ = {f: [(kind, re.compile(re.sub(r"\(\?<([nti])>", r"(?P<\1>", p), re.ASCII)) for kind, p in patterns] for f, patterns in PATTERNS.items()}
#: Kinds that have a body, and those of them that may hold others.
_BODIED = frozenset("class function interface struct enum trait module".split())
_HOLDS = _BODIED - {"function"}
#: What is skipped while braces are matched: comments and strings. In these languages # begins a comment, too.
_SKIP = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|"
_BRACES = {False: re.compile(_SKIP + r"[{};]", re.S), True: re.compile(_SKIP + r"(?<!\$)#[^\n]*|[{};]", re.S)}
_BY_INDENT = frozenset(("ruby", "lua"))


def body_end(text: str, start: int, at: int, family: str) -> int:
    """Where the construct ends whose declaration is text[start:at]: after its matching brace or end; at if it has no body.

    A body that is never closed goes to the end of the text.
    """
    if family in _BY_INDENT:
        head = text.rfind("\n", 0, start) + 1
        indent = re.match(r"[ \t]*", text[head:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(text, at)
        return m.end() if m else len(text)
    depth = 0
    for m in _BRACES[family in ("php", "bash")].finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end() if depth == 0 else at
        elif m[0] == ";" and depth == 0:
            return at
    return len(text) if depth else at


def pattern_constructs(text: str, family: str) -> list[tuple]:
    """As python_constructs(), by the patterns of a family; the parent is the innermost class or the like around it."""
    found = []
    for kind, pattern in _READ[family]:
        has = pattern.groupindex
        for m in pattern.finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = body_end(text, start, m.end(), family) if kind in _BODIED else m.end()
            of = lambda g: (m[g] or "").strip() or None if g in has else None  # noqa: B023, E731
            items = [x.strip() for x in re.sub("[{}]", "", of("i") or "").split(",") if x.strip()]
            found.append((start, end, kind, of("n"), of("t"), items))
    found.sort(key=lambda x: (x[0], -x[1]))
    breaks = [m.start() for m in re.finditer("\n", text)]
    out, around = [], []
    for start, end, kind, name, type_, items in found:
        while around and around[-1][0] <= start:
            around.pop()
        parent = around[-1][1] if around else None
        out.append((kind, name, parent, bisect_left(breaks, start) + 1, bisect_left(breaks, max(start, end - 1)) + 1, text[start:end], type_, items))
        if kind in _HOLDS:
            around.append((end, name))
    return out


#: Nodes that are constructs, and values of nodes' fields below which there is none.
_TOLD = frozenset((ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.Call))
_LEAVES = frozenset((ast.Name, ast.Constant, ast.alias, *(t for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for t in base.__subclasses__()), str, int, bytes, bool, float, complex, type(None), type(...)))


def python_constructs(code: str) -> list[tuple]:
    """(kind, name, parent, start_line, end_line, raw, type, items) of a Python text; none if it doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    lines = code.split("\n")

    def source(n: ast.AST) -> str:
        return "\n".join(lines[n.lineno - 1 : n.end_lineno])

    def add(kind: str, name: str, parent: str | None, n: ast.AST, type_: str | None = None, items: list[str] | None = None) -> None:
        out.append((kind, name, parent, n.lineno, n.end_lineno, source(n), type_, items or []))

    def show(n: ast.AST | None) -> str | None:
        """Source of an expression; names, names after dots and whole numbers, which most are, without a call of unparse()."""
        if n is None:
            return None
        end, top = "", n
        while type(n) is ast.Attribute:
            end, n = "." + n.attr + end, n.value
        if type(n) is ast.Name:
            return n.id + end
        return repr(n.value) if type(n) is ast.Constant and type(n.value) is int and not end else ast.unparse(top)

    todo: list[tuple[ast.AST, str | None, str | None]] = [(n, None, None) for n in reversed(tree.body)]
    while todo:
        n, cls, fn = todo.pop()
        inside_cls, inside_fn = cls, fn
        kind = type(n)
        if kind not in _TOLD:
            pass
        elif isinstance(n, ast.ClassDef):
            add("class", n.name, cls, n, None, [show(b) for b in n.bases])
            for d in n.decorator_list:
                add("decorator", show(d), n.name, d)
            inside_cls, inside_fn = n.name, None
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            a = n.args
            args = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            add("function", n.name, cls, n, show(n.returns), [x.arg for x in args])
            for x in args:
                add("parameter", x.arg, n.name, x, show(x.annotation))
            for d in n.decorator_list:
                add("decorator", show(d), n.name, d)
            inside_fn = n.name
        elif isinstance(n, ast.Import):
            for x in n.names:
                add("import", x.name, None, n, None, [x.asname or x.name])
        elif isinstance(n, ast.ImportFrom):
            add("import", "." * n.level + (n.module or ""), None, n, None, [x.name for x in n.names])
        elif isinstance(n, ast.Assign | ast.AnnAssign):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name):
                    add("field" if cls and not fn else "variable", t.id, fn or cls, n, show(getattr(n, "annotation", None)))
        elif isinstance(n, ast.Call):
            add("call", show(n.func), fn or cls, n, None, [show(x) for x in n.args])
        at = len(todo)
        for field in n._fields:
            x = getattr(n, field, None)
            if type(x) is list:
                for c in x:
                    if type(c) not in _LEAVES:
                        todo.append((c, inside_cls, inside_fn))
            elif type(x) not in _LEAVES:
                todo.append((x, inside_cls, inside_fn))
        todo[at:] = todo[:at - 1 if at else None:-1]
    return out


def constructs(files: DataFrame) -> DataFrame:
    """Constructs of files(repository, path, extension, text).

    Python is parsed; other languages are read by the patterns of their family, and a body ends at its matching brace or,
    in languages without them, at the end that stands as far to the right as the beginning. Texts that can't be parsed,
    null ones included, have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in _COLUMNS]
            size = 0
            for r, p, e, code in zip(*(b.column(c).to_pylist() for c in ("repository", "path", "extension", "text"))):
                for row in python_constructs(code) if e == ".py" else pattern_constructs(code, FAMILY[e]):
                    for column, x in zip(columns, (r, p, *row)):
                        column.append(x)
                    size += 100 + len(row[5])
                    if size > _SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], _COLUMNS)
                        columns, size = [[] for _ in _COLUMNS], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], _COLUMNS)

    rows = files.where(F.col("text").isNotNull() & F.col("extension").isin(".py", *FAMILY))
    return rows.select("repository", "path", "extension", "text").mapInArrow(run, CONSTRUCT)


def with_metrics(found: DataFrame) -> DataFrame:
    """Constructs with complexity, token and line counts, access, modifiers and canonical name."""
    raw, name = F.col("raw"), F.col("name")
    return found.withColumns({"complexity": complexity(raw), "tokens": token_count(raw), "lines": file_line_count(raw), "access": access_modifier(raw, name), "modifiers": modifiers(raw), "canonical_name": canonical_name(F.col("parent"), name)})


CLASS_OF = dict(x.split("=") for x in "class=ClassDefinition function=FunctionDefinition interface=InterfaceDefinition enum=EnumDefinition struct=StructDefinition trait=TraitDefinition module=ModuleDefinition parameter=Parameter variable=VariableDeclaration field=AttributeDeclaration call=FunctionCallSite decorator=Decorator type=TypeDeclaration import=ImportDeclaration comment=CodeComment".split())
_PATH_OF = {"parameter": "param", "variable": "var"}


def construct_iri(file: Column, kind: Column, name: Column) -> Column:
    part = F.element_at(F.create_map(*(F.lit(x) for k in CLASS_OF for x in (k, _PATH_OF.get(k, k)))), kind)
    return F.concat(file, F.lit("/"), part, F.lit("/"), uri_safe(name))


def construct_triples(found: DataFrame) -> DataFrame:
    """Triples of with_metrics() rows: one template for all kinds, whose parts are null, and so absent, where they don't apply."""
    file = F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("path")))
    cls = F.concat(F.lit(KG), F.element_at(F.create_map(*(F.lit(x) for kv in CLASS_OF.items() for x in kv)), F.col("kind")))
    # worked out once a row, not in each part of the template
    found = found.where("name is not null").withColumns({"file_iri": file, "construct_iri": construct_iri(file, F.col("kind"), F.col("name")), "class_iri": cls})
    c, file, cls = F.col("construct_iri"), F.col("file_iri"), F.col("class_iri")
    code = F.col("kind").isin("function", "class", "interface", "struct", "trait", "module", "enum")
    only = lambda cond, x: F.when(cond, x)
    m = F.col("modifiers")
    return from_structs(
        found,
        link(c, "rdf:type", cls), value(c, "rdfs:label", truncate_label(F.col("name"))), value(c, "kg:hasSimpleName", F.col("name")), value(c, "kg:hasCanonicalName", F.nullif("canonical_name", F.lit(""))), value(c, "kg:hasSourceCodeSnippet", F.nullif("raw", F.lit(""))), link(c, "kg:isCodePartOf", file), link(file, "kg:hasCodePart", c),
        value(c, "kg:startsAtLine", F.col("start_line"), "positiveInteger"), value(c, "kg:endsAtLine", F.col("end_line"), "positiveInteger"), value(c, "kg:hasCyclomaticComplexity", only(F.col("kind") == "function", F.col("complexity")), "nonNegativeInteger"), value(c, "kg:hasTokenCount", only(code, F.col("tokens")), "nonNegativeInteger"), value(c, "kg:hasLineCount", only(code, F.col("lines")), "nonNegativeInteger"),
        value(c, "kg:hasAccessModifier", only(code, F.col("access"))), *(value(c, f"kg:{n}", only(code & m[s], F.lit("true")), "boolean") for n, s in (("isStatic", "is_static"), ("isAbstract", "is_abstract"), ("isAsynchronous", "is_async"), ("isFinal", "is_final"))),
    )


def _edge(df: DataFrame, s: Column, p: str, o: Column, inverse: str | None = None) -> DataFrame:
    parts = [link(s, p, o)] + ([link(o, inverse, s)] if inverse else [])
    return from_structs(df, *parts)


def _file(df: DataFrame) -> Column:
    return F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("path")))


def inheritance(found: DataFrame) -> DataFrame:
    """extendsType and implementsInterface edges; a base that no construct of the repository declares is an external IRI."""
    bases = F.when(F.col("kind").isin("class", "interface", "struct"), F.when(F.col("type").isNotNull(), F.array_append("items", F.col("type"))).otherwise(F.col("items")))
    declared = F.when(F.col("kind").isin("class", "interface", "trait"), F.array("name"))
    none = F.array().cast("array<string>")
    both = F.concat(F.transform(F.coalesce(bases, none), lambda x: F.struct(x.alias("base"), F.lit(True).alias("used"))), F.transform(F.coalesce(declared, none), lambda x: F.struct(x.alias("base"), F.lit(False).alias("used"))))
    rows = found.where("kind in ('class', 'interface', 'struct', 'trait')").select("repository", "path", "kind", "name", F.explode(both).alias("x")).select("repository", "path", "kind", "name", "x.*")
    # a window in place of a join, for which the files would be parsed twice
    at = F.min(F.when(~F.col("used"), F.struct("path", "kind"))).over(Window.partitionBy("repository", "base"))
    rows = rows.withColumn("at", F.when(F.col("base").isNotNull(), at)).where("used")
    target = F.coalesce(construct_iri(F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("at.path"))), F.col("at.kind"), F.col("base")), F.concat(F.lit(INST + "external/"), uri_safe(F.col("base"))))
    me = construct_iri(_file(rows), F.col("kind"), F.col("name"))
    as_interface = F.coalesce(F.col("at.kind") == "interface", F.lit(False)) & (F.col("kind") != "interface")
    p = F.when(as_interface, iri("kg:implementsInterface")).otherwise(iri("kg:extendsType"))
    q = F.when(as_interface, iri("kg:isImplementedBy")).otherwise(iri("kg:isExtendedBy"))
    back = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    pair = rows.select(me.alias("a"), target.alias("b"), p.alias("p"), q.alias("q")).select("a", "b", "p", "q", back)
    two = lambda x, y: F.when(F.col("back"), F.col(y)).otherwise(F.col(x))
    return typed(pair.select(two("a", "b").alias("s"), two("p", "q").alias("p"), two("b", "a").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type")))


def calls(found: DataFrame) -> DataFrame:
    """callsFunction edges from a function to a function of the same file that one of its calls names."""
    is_call = F.col("kind") == "call"
    rows = found.where("(kind = 'call' and parent is not null or kind = 'function') and name is not null and repository is not null and path is not null")
    rows = rows.select("repository", "path", F.when(is_call, F.substring_index("name", ".", -1)).otherwise(F.col("name")).alias("callee"), F.when(is_call, F.col("parent")).alias("parent"))
    # a group in place of a join, for which the files would be parsed twice
    rows = rows.groupBy("repository", "path", "callee").agg(F.collect_set("parent").alias("parents"), F.bool_or(F.col("parent").isNull()).alias("known")).where("known").select("repository", "path", "callee", F.explode("parents").alias("parent"))
    return _edge(rows, construct_iri(_file(rows), F.lit("function"), F.col("parent")), "kg:callsFunction", construct_iri(_file(rows), F.lit("function"), F.col("callee")), "kg:isCalledByFunctionAt")


def declaration_usage(found: DataFrame) -> DataFrame:
    """usesDeclaration edges from a call to a variable or parameter of its file that is one of its arguments."""
    is_call = F.col("kind") == "call"
    rows = found.where("kind in ('call', 'variable', 'parameter', 'field') and repository is not null and path is not null")
    rows = rows.select("repository", "path", "kind", "name", F.explode(F.when(is_call, F.col("items")).otherwise(F.array("name"))).alias("arg")).where("arg is not null")
    rows = rows.groupBy("repository", "path", "arg").agg(F.collect_set(F.when(is_call, F.col("name"))).alias("calls"), F.collect_set(F.when(~is_call, F.col("kind"))).alias("kinds"))
    rows = rows.where(F.size("kinds") > 0).select("repository", "path", "arg", "kinds", F.explode("calls").alias("call")).select("repository", "path", "arg", "call", F.explode("kinds").alias("kind"))
    return _edge(rows, construct_iri(_file(rows), F.lit("call"), F.col("call")), "kg:usesDeclaration", construct_iri(_file(rows), F.col("kind"), F.col("arg")), "kg:isDeclarationUsedBy")


def type_relations(found: DataFrame) -> DataFrame:
    """(repository, path, construct, type, context, primitive, location) of variables, parameters, returns and fields."""
    context = F.create_map(*(F.lit(x) for x in ("variable", "variable_declaration", "parameter", "function_parameter", "function", "function_return", "field", "class_field")))
    rows = found.where("type is not null and type <> '' and name is not null and kind in ('variable', 'parameter', 'function', 'field')")
    name = F.when(F.col("kind").isin("parameter", "field") & F.col("parent").isNotNull(), F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
    return rows.select("repository", "path", name.alias("construct"), "type", F.element_at(context, F.col("kind")).alias("context"), is_primitive(F.col("type")).alias("primitive"), F.col("start_line").alias("location"))


def access_relations(found: DataFrame) -> DataFrame:
    """(repository, path, function, attribute, context, location): what methods reach by a dot, and what functions assign."""
    method, own = F.expr("kind = 'function' and parent is not null and raw is not null"), F.expr("kind = 'variable' and parent is not null")
    dotted = F.concat(F.regexp_extract_all("raw", F.lit(r"self\.(\w+)"), 1), F.regexp_extract_all("raw", F.lit(r"this\.(\w+)"), 1), F.regexp_extract_all("raw", F.lit(r"\w+\.(\w+)"), 1))
    one = lambda function, attribute, context: F.struct(function.alias("function"), attribute.alias("attribute"), F.lit(context).alias("context"))
    first, second = F.transform(F.array_distinct(dotted), lambda x: one(F.col("name"), x, "field_access")), F.array(one(F.col("parent"), F.col("name"), "variable_access"))
    rows = found.where(method | own).select("repository", "path", F.explode(F.when(method, first).otherwise(second)).alias("x"), F.col("start_line").alias("location"))
    return rows.select("repository", "path", "x.*", "location").distinct()


def manipulations(found: DataFrame) -> DataFrame:
    """manipulates edges from a function to a variable of the same file that its text names."""
    return _mentions(found, "variable", "kg:manipulates", "kg:isManipulatedBy")


def stylings(found: DataFrame) -> DataFrame:
    """styles edges from a function to a class of the same file that its text names."""
    return _mentions(found, "class", "kg:styles", "kg:isStyledBy")


def _mentions(found: DataFrame, kind: str, p: str, inverse: str) -> DataFrame:
    is_code, is_name = (F.col("kind") == "function") & F.col("raw").isNotNull(), (F.col("kind") == kind) & (F.length("name") > 0)
    rows = found.where((is_code | is_name) & F.col("repository").isNotNull() & F.col("path").isNotNull()).groupBy("repository", "path")
    rows = rows.agg(F.collect_list(F.when(is_code, F.struct(F.col("name").alias("function"), "raw"))).alias("code"), F.collect_set(F.when(is_name, F.col("name"))).alias("names")).where(F.size("names") > 0)
    rows = rows.select("repository", "path", "names", F.explode("code").alias("code")).select("repository", "path", F.col("code.function").alias("function"), F.explode(F.filter("names", lambda x: F.contains(F.col("code.raw"), x))).alias("target"))
    return _edge(rows, construct_iri(_file(rows), F.lit("function"), F.col("function")), p, construct_iri(_file(rows), F.lit(kind), F.col("target")), inverse)


#: IRIs of a chunk, of which each is paired with each of another chunk.
CHUNK = 2048


def tests(found: DataFrame, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """tests edges from a function named test_x, or testX, to a function x of the repository; shown may shorten their IRIs.

    That is all pairs of a repository's equal names. IRIs are made different before they are paired, in chunks of which each
    pair is a task's row, so that pairs need no shuffle and a frequent name no single task. Only IRIs that stand for several
    names, as uri_safe() makes some, can be paired twice; theirs are few, and are made different afterwards.
    """
    subject = F.lower(F.regexp_extract("name", r"(?i)^test_?(\w+)$", 1))
    roles = F.array(F.struct(F.lit(False).alias("test"), F.lower("name").alias("subject")), F.when(subject != "", F.struct(F.lit(True).alias("test"), subject.alias("subject"))))
    rows = found.where("kind = 'function' and name is not null and repository is not null and path is not null")
    rows = rows.select("repository", shown(construct_iri(_file(rows), F.lit("function"), F.col("name"))).alias("iri"), F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("x")).select("repository", "iri", "x.*").distinct()
    key = ["repository", "subject"]
    w = Window.partitionBy(*key)
    rows = rows.withColumns({"t": F.count_if("test").over(w), "f": F.count_if(~F.col("test")).over(w), "chunk": F.floor((F.row_number().over(Window.partitionBy(*key, "test").orderBy("iri")) - 1) / CHUNK)}).where("t > 0 and f > 0")
    rows = cut(rows.withColumn("twice", F.count("*").over(Window.partitionBy("iri", "test")) > 1))
    chunks = rows.groupBy(*key, "test", "twice", "chunk", "t", "f").agg(F.collect_list("iri").alias("iris"))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK)))
    session = found.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    on = [*key, "a", "b"]
    left = chunks.where("test").select(*key, F.col("chunk").alias("a"), others("f").alias("b"), F.col("iris").alias("s"), F.col("twice").alias("ts")).repartition(n, *on)
    right = chunks.where("not test").select(*key, F.col("chunk").alias("b"), others("t").alias("a"), F.col("iris").alias("o"), F.col("twice").alias("to")).repartition(n, *on).hint("merge")
    pairs = left.join(right, on).where("not (ts and to)").select(F.explode("s").alias("s"), "o").select("s", F.explode("o").alias("o"))
    few = rows.where("twice")
    pairs = pairs.union(few.where("test").select(*key, F.col("iri").alias("s")).join(few.where("not test").select(*key, F.col("iri").alias("o")), key).select("s", "o").distinct())
    back = F.col("back")
    both = pairs.select("s", "o", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    two = lambda a, b: F.when(back, b).otherwise(a)
    return typed(both.select(two(F.col("s"), F.col("o")).alias("s"), two(F.lit(iri("kg:tests")), F.lit(iri("kg:isTestedBy"))).alias("p"), two(F.col("o"), F.col("s")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type")), distinct=False)


def module_imports(found: DataFrame) -> DataFrame:
    """imports edges from files to modules."""
    rows = found.where("kind = 'import' and name is not null")
    return _edge(rows, _file(rows), "kg:imports", F.concat(F.lit(INST + "module/"), uri_safe(F.col("name"))), "kg:isImportedBy")
