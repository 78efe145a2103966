"""The property graph of parsed Java files: declarations, then references, as one union of selects."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import bare_type, simple_name
from codeweft.operators.graph import first_edges, merge_nodes
from codeweft.operators.resolution import call_targets, link_constructors, resolve_types
from codeweft.sources.java import entities
from codeweft.storage import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _id(kind: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column) if isinstance(column, str) else column)


#: Ways in which code names a type: in headers, where calls look for receivers, and the rest.
HIERARCHY = ("EXTENDS", "IMPLEMENTS")
OF_CALLS = ("USES_TYPE/field", "USES_TYPE/method", "CREATES", "LOCAL", "STATIC")
USES = (*HIERARCHY, *OF_CALLS, "ANNOTATED_WITH/type", "ANNOTATED_WITH/field", "ANNOTATED_WITH/method", "THROWS", "RETURNS_TYPE", "CATCHES")


class JavaTables:
    """Types, methods, fields, references and imports of all files, resolved type references, and calls.

    References, supertypes and calls are resolved when they are first asked for. What was resolved before can be given with
    the files that it is not to be taken for: ``resolved`` and ``stale`` (see :mod:`codeweft.operators.incremental`).
    """

    def __init__(self, parsed: DataFrame, resolved: DataFrame | None = None, stale: DataFrame | None = None) -> None:
        self.parsed = materialize(parsed, "parsed")
        self.files = self.parsed.select("relative_path", "status", "package", F.size("types").alias("type_count"))
        self.types, self.fields, self.methods, self.refs, self.imports = (entities(self.parsed, x) for x in ("types", "fields", "methods", "refs", "imports"))
        self._before, self._stale = resolved, stale
        self._some: dict[tuple[str, ...], DataFrame] = {}
        self._calls: DataFrame | None = None

    @cached_property
    def resolved(self) -> DataFrame:
        """Every reference to a type, resolved: what ``_asked`` holds with ``target, confidence, declared``."""
        fresh = self._resolve(self._stale)
        if self._before is not None:
            fresh = self._before.join(self._stale, "file", "left_anti").unionByName(fresh)
        return materialize(fresh, "resolved")

    def uses(self, *names: str) -> DataFrame:
        """The resolved references of some uses; only these are resolved, unless all are there or are patched."""
        if "resolved" in self.__dict__ or self._before is not None:
            return self.resolved.where(F.col("use").isin(*names))
        if names not in self._some:
            self._some[names] = materialize(self._resolve(None, names), "resolved")
        return self._some[names]

    @cached_property
    def supertypes(self) -> DataFrame:
        return materialize(self._supertypes(), "supertypes")

    @property
    def calls(self) -> DataFrame:
        """CALLS edges of all files, with constructors; resolved once."""
        if self._calls is None:
            self._calls = materialize(call_edges(self, self.refs), "call-edges")
        return self._calls

    def patch_calls(self, before: DataFrame, stale: DataFrame) -> None:
        """Take the calls of before, and resolve only those of the stale files."""
        fresh = call_edges(self, self.refs.join(stale, "file", "left_semi"))
        self._calls = materialize(before.join(stale, "file", "left_anti").unionByName(fresh), "call-edges")

    def _asked(self, only: DataFrame | None, uses: tuple[str, ...] = USES) -> DataFrame:
        """Every place that names a type, in some files or in all: ``use, src, raw, line, ordinal, file, package``."""

        def part(df: DataFrame, use: str, src: Column, raw: Column, line: Column, ordinal: Column | None = None) -> DataFrame:
            return df.select(F.lit(use).alias("use"), src.alias("src"), raw.alias("raw"), line.alias("line"), (ordinal if ordinal is not None else F.lit(0)).cast("int").alias("ordinal"), "file", F.col("file_package").alias("package"))

        line = F.col("location.line_start")
        t, f, m, r = (df if only is None else df.join(only, "file", "left_semi") for df in (self.types, self.fields, self.methods, self.refs))
        each = lambda df, c: df.select("*", F.posexplode(c).alias("_pos", "_one"))
        one, pos = F.col("_one"), F.col("_pos")
        of_ref = r.withColumn("file_package", F.col("file_package"))
        parts = [
            part(each(t, "extends"), "EXTENDS", F.col("fqn"), one, line, pos),
            part(each(t, "implements"), "IMPLEMENTS", F.col("fqn"), one, line, pos),
            *[part(each(df, "annotations"), f"ANNOTATED_WITH/{kind}", F.col("fqn"), F.col("_one.name"), line, pos) for df, kind in ((t, "type"), (f, "field"), (m, "method"))],
            part(each(m, "throws"), "THROWS", F.col("fqn"), one, line, pos),
            part(f, "USES_TYPE/field", F.col("fqn"), F.col("type_text"), line),
            part(each(m, "parameters"), "USES_TYPE/method", F.col("fqn"), F.col("_one.type_text"), line, pos),
            part(m.where("return_type IS NOT NULL"), "RETURNS_TYPE", F.col("fqn"), F.col("return_type"), line),
            part(of_ref.where("kind = 'create'"), "CREATES", F.col("method_fqn"), F.col("type_text"), F.col("line"), F.col("ref_ordinal")),
            part(of_ref.where("kind = 'localvar'"), "LOCAL", F.col("method_fqn"), F.col("type_text"), F.col("line"), F.col("ref_ordinal")),
            part(of_ref.where("kind = 'catch'").select("*", F.explode(F.split("type_text", r"\s*\|\s*")).alias("_one")), "CATCHES", F.col("method_fqn"), one, F.col("line"), F.col("ref_ordinal")),
            part(of_ref.where("kind = 'call' AND receiver_text RLIKE '^[A-Z][A-Za-z0-9_]*$'"), "STATIC", F.col("method_fqn"), F.col("receiver_text"), F.col("line"), F.col("ref_ordinal")),
        ]
        return _union(parts).where(F.col("use").isin(*uses))

    def _resolve(self, only: DataFrame | None, uses: tuple[str, ...] = USES) -> DataFrame:
        asked = self._asked(only, uses).withColumn("raw", F.regexp_replace("raw", r"^@(\w+)", "$1"))
        known = self.types.select("fqn", "package")
        imports = self.imports.select("file", "fqn", "ordinal", "wildcard", "static")
        # A name is resolved once for each file that uses it, however often it does.
        distinct = asked.select("file", "package", "raw").distinct()
        answers = resolve_types(distinct, known, imports)
        key = lambda df: df.withColumn("package", F.coalesce("package", F.lit("")))
        return key(asked).join(key(answers), ["file", "package", "raw"])

    def _supertypes(self) -> DataFrame:
        """``fqn, super, depth`` of every type and each above it, at its least depth.

        The known depths double in each round: a pair that is further apart than all known ones is one of the furthest of
        these, and a known one from there on.
        """
        direct = self.uses(*HIERARCHY).where("declared").select(F.col("src").alias("fqn"), F.col("target").alias("super")).distinct()
        found, reach = [materialize(direct.withColumn("depth", F.lit(1)), "supers")], 1
        while True:  # a pair is met once, so this ends
            seen = _union(found)
            last = seen.where(F.col("depth") == reach)
            if last.isEmpty():
                return seen
            further = last.select("fqn", F.col("super").alias("via")).join(seen.withColumnRenamed("fqn", "via"), "via")
            further = further.groupBy("fqn", "super").agg((F.min("depth") + reach).alias("depth"))
            found.append(materialize(further.join(seen, ["fqn", "super"], "left_anti"), "supers"))
            reach *= 2

    def lineage(self) -> DataFrame:
        """``fqn, super, depth`` with each type as its own at depth 0; a pair is there once."""
        own = self.types.select("fqn", F.col("fqn").alias("super"), F.lit(0).alias("depth")).distinct()
        return own.unionByName(self.supertypes.where("fqn <> super"))


def call_edges(j: JavaTables, refs: DataFrame) -> DataFrame:
    """CALLS edges of some references by receiver: own type, supertype, known name, type name, or an external guess; and
    those of constructors that ``new`` meets."""
    return _method_calls(j, refs).unionByName(_constructor_calls(j, refs))


def _constructor_calls(j: JavaTables, refs: DataFrame) -> DataFrame:
    creates = refs.where("kind = 'create'").withColumn("call_id", F.concat_ws("|", "method_fqn", F.col("ref_ordinal").cast("string")))
    of_create = j.uses(*OF_CALLS).where("use = 'CREATES' AND declared").select(F.col("src").alias("method_fqn"), F.col("ordinal").alias("ref_ordinal"), F.col("target").alias("owner"))
    made = creates.join(of_create, ["method_fqn", "ref_ordinal"])
    constructors = j.methods.where("kind = 'constructor'").select(F.col("owner_fqn").alias("owner"), F.lit("new").alias("name"), F.size("parameters").alias("arity"), _id("method", "fqn").alias("id"))
    linked = link_constructors(made.select("call_id", "owner", F.lit("new").alias("name"), F.col("arg_count").alias("arity")), constructors).join(made.select("call_id", "method_fqn", "file", "line", "ref_ordinal"), "call_id")
    return linked.select(F.lit("CALLS").alias("type"), _id("method", "method_fqn").alias("src"), F.col("target").alias("dst"), "confidence", "file", F.col("line").cast("int").alias("line"), F.col("ref_ordinal").cast("int").alias("ordinal"))


def _method_calls(j: JavaTables, refs: DataFrame) -> DataFrame:
    r = refs.where("kind = 'call'").join(j.methods.select(F.col("fqn").alias("method_fqn"), "owner_fqn"), "method_fqn")
    lineage, named = j.lineage(), j.uses(*OF_CALLS)
    fields = named.where("use = 'USES_TYPE/field'").select(F.col("src").alias("fqn"), "target").join(j.fields.select("fqn", "owner_fqn", "name"), "fqn")
    of_field = lineage.join(fields.withColumnRenamed("owner_fqn", "super").drop("fqn"), "super").groupBy(F.col("fqn").alias("owner_fqn"), "name").agg(F.min_by("target", "depth").alias("field_type"))
    params = j.methods.select(F.col("fqn").alias("method_fqn"), F.explode("parameters").alias("p")).select("method_fqn", F.col("p.name").alias("name"), F.col("p.index").alias("ordinal"))
    param_types = named.where("use = 'USES_TYPE/method'").select(F.col("src").alias("method_fqn"), "ordinal", "target")
    of_param = params.join(param_types, ["method_fqn", "ordinal"]).groupBy("method_fqn", "name").agg(F.max_by("target", "ordinal").alias("param_type"))
    locals_ = j.refs.where("kind = 'localvar'").select("method_fqn", F.col("ref_ordinal").alias("ordinal"), "name")
    local_types = named.where("use = 'LOCAL'").select(F.col("src").alias("method_fqn"), "ordinal", "target")
    of_local = locals_.join(local_types, ["method_fqn", "ordinal"]).groupBy("method_fqn", "name").agg(F.max_by("target", "ordinal").alias("local_type"))
    static = named.where("use = 'STATIC'").select(F.col("src").alias("method_fqn"), F.col("raw").alias("receiver_text"), F.col("target").alias("static_type")).distinct()
    parent = j.uses(*HIERARCHY).where("use = 'EXTENDS' AND declared").groupBy(F.col("src").alias("owner_fqn")).agg(F.min_by("target", "ordinal").alias("parent"))
    name = F.regexp_replace("receiver_text", r"^this\.", "").alias("receiver_name")
    r = r.withColumn("receiver_name", name)
    r = r.join(of_field.withColumnRenamed("name", "receiver_name"), ["owner_fqn", "receiver_name"], "left")
    r = r.join(of_param.withColumnRenamed("name", "receiver_name"), ["method_fqn", "receiver_name"], "left")
    r = r.join(of_local.withColumnRenamed("name", "receiver_name"), ["method_fqn", "receiver_name"], "left")
    r = r.join(static, ["method_fqn", "receiver_text"], "left").join(parent, "owner_fqn", "left")
    owner = (
        F.when(F.col("receiver_text").isNull() | (F.col("receiver_text") == "this"), F.col("owner_fqn"))
        .when(F.col("receiver_text") == "super", F.coalesce("parent", F.lit("super")))
        .otherwise(F.coalesce("local_type", "param_type", "field_type", "static_type", F.col("receiver_text")))
    )
    calls = materialize(r.select("method_fqn", owner.alias("owner"), "name", F.col("arg_count").alias("arity"), "line", "file", "ref_ordinal"), "call-owners")
    # Calls of one name and arity on one type have the same targets, so these are sought once, and only on types that are asked.
    asked = calls.select("owner", "name", "arity").distinct()
    above = lineage.withColumnRenamed("fqn", "owner").join(asked.select("owner", "name").distinct(), "owner").select("owner", "name", "super")
    members = j.methods.where("kind = 'method'").select(F.col("owner_fqn").alias("super"), "name", F.size("parameters").alias("arity"), _id("method", "fqn").alias("id")).distinct()
    candidates = above.join(members, ["super", "name"]).select("owner", "name", "arity", "id")
    t = call_targets(asked, candidates).withColumnsRenamed({"owner": "_owner", "name": "_name", "arity": "_arity"})
    found = calls.join(t, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("name") == F.col("_name")) & F.col("arity").eqNullSafe(F.col("_arity")))
    return found.select(F.lit("CALLS").alias("type"), _id("method", "method_fqn").alias("src"), F.col("target").alias("dst"), "confidence", "file", F.col("line").cast("int").alias("line"), F.col("ref_ordinal").cast("int").alias("ordinal"))


#: Types of edges that Java files give, in the order in which they are made.
EDGE_TYPES = ("CONTAINS", "IMPORTS", "DECLARES", *HIERARCHY, "ANNOTATED_WITH", "THROWS", "USES_TYPE", "RETURNS_TYPE", "CREATES", "CATCHES", "OVERRIDES", "CALLS")


def java_edges(j: JavaTables, types: Iterable[str] = EDGE_TYPES) -> DataFrame:
    """``type, src, dst, confidence, file, line, ordinal`` of edges of some types; only what these need is resolved."""
    line = F.col("location.line_start")
    high = F.lit("HIGH")

    def edge(df: DataFrame, kind: str, src: Column, dst: Column, confidence: Column = high, at: Column | None = None, ordinal: Column | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), confidence.alias("confidence"), "file", (at if at is not None else F.lit(0)).cast("int").alias("line"), (ordinal if ordinal is not None else F.lit(0)).cast("int").alias("ordinal"))

    def named() -> DataFrame:
        # A reference to a primitive or to nothing is no edge.
        asked = [u for u in USES if u.split("/")[0] in types and u not in ("LOCAL", "STATIC")]
        targets = (j.resolved if set(EDGE_TYPES) <= set(types) else j.uses(*asked)).where(F.col("use").isin(*asked))
        space = F.when(F.col("use").isin(*HIERARCHY) | F.endswith("use", F.lit("/type")), "type:").when(F.endswith("use", F.lit("/field")), "field:").otherwise("method:")
        targets = targets.where(~bare_type(F.col("raw")).isin("int", "long", "double", "float", "boolean", "char", "byte", "short", "void", "var", ""))
        return targets.select(F.split_part("use", F.lit("/"), F.lit(1)).alias("type"), F.concat(space, F.col("src")).alias("src"), _id("type", "target").alias("dst"), "confidence", "file", "line", "ordinal")

    def overrides() -> DataFrame:
        marked = F.when(F.exists("annotations", lambda a: simple_name(a["name"]) == "Override"), "HIGH").otherwise("MEDIUM")
        own = j.methods.select("fqn", "owner_fqn", "name", F.size("parameters").alias("arity"), "kind", "file", marked.alias("confidence"), line.alias("line"))
        above = j.supertypes.select(F.col("fqn").alias("owner_fqn"), "super")
        over = own.join(above, "owner_fqn").join(own.select(F.col("fqn").alias("super_fqn"), F.col("owner_fqn").alias("super"), "name", "arity", "kind"), ["super", "name", "arity", "kind"])
        return edge(over, "OVERRIDES", _id("method", "fqn"), _id("method", "super_fqn"), F.col("confidence"), F.col("line"))

    files = j.files.withColumnRenamed("relative_path", "file").where("package IS NOT NULL")
    makers = {
        "CONTAINS": lambda: [edge(files, "CONTAINS", _id("package", "package"), _id("file", "file"))],
        "IMPORTS": lambda: [
            edge(j.imports.where("NOT wildcard"), "IMPORTS", _id("file", "file"), _id("type", "fqn"), ordinal=F.col("ordinal")),
            edge(j.imports.where("wildcard"), "IMPORTS", _id("file", "file"), _id("package", "fqn"), ordinal=F.col("ordinal")),
        ],
        "DECLARES": lambda: [
            edge(j.types.where("enclosing_fqn IS NULL"), "DECLARES", _id("file", "file"), _id("type", "fqn"), at=line),
            edge(j.types.where("enclosing_fqn IS NOT NULL"), "DECLARES", _id("type", "enclosing_fqn"), _id("type", "fqn"), at=line),
            edge(j.fields, "DECLARES", _id("type", "owner_fqn"), _id("field", "fqn"), at=line),
            edge(j.methods, "DECLARES", _id("type", "owner_fqn"), _id("method", "fqn"), at=line),
        ],
        "OVERRIDES": lambda: [overrides()],
        "CALLS": lambda: [j.calls.withColumn("type", F.lit("CALLS"))],
    }
    parts = [named()] if set(types) & set(EDGE_TYPES) - set(makers) else []
    for kind, make in makers.items():
        parts += make() if kind in types else []
    return first_edges(_union(parts), F.struct("ordinal", "file", "line"))


def declared(j: JavaTables) -> DataFrame:
    """A row for each place that declares a node: files, packages, types, fields and methods."""
    line = F.col("location.line_start")
    files = j.files.withColumnRenamed("relative_path", "file")

    def node(df: DataFrame, id_: Column, kind: Column, name: Column, **more: Column) -> DataFrame:
        return df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), *[c.alias(k) for k, c in more.items()])

    return _union([
        node(files, _id("file", "file"), F.lit("SourceFile"), F.col("file"), file=F.col("file"), parse_status=F.col("status")),
        node(files.where("package IS NOT NULL"), _id("package", "package"), F.lit("Package"), F.col("package")),
        node(j.types, _id("type", "fqn"), F.initcap("kind"), F.col("name"), fqn=F.col("fqn"), package=F.col("package"), owner=F.col("enclosing_fqn"), file=F.col("file"), line_start=line, line_end=F.col("location.line_end"), annotations=F.transform("annotations", lambda a: a["name"])),
        node(j.fields, _id("field", "fqn"), F.lit("Field"), F.col("name"), fqn=F.col("fqn"), owner=F.col("owner_fqn"), file=F.col("file"), line_start=line, line_end=F.col("location.line_end")),
        node(j.methods, _id("method", "fqn"), F.initcap("kind"), F.col("name"), fqn=F.col("fqn"), owner=F.col("owner_fqn"), return_type=F.col("return_type"), file=F.col("file"), line_start=line, line_end=F.col("location.line_end"), annotations=F.transform("annotations", lambda a: a["name"])),
    ]).withColumn("placeholder", F.lit(False))


def java_graph(j: JavaTables) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all files; a name met before its declaration is a placeholder node."""
    edges = materialize(java_edges(j), "java-edges")  # read for the ends of edges and as the result
    ends = edges.select(F.col("dst").alias("id"))
    kind = F.when(F.col("id").startswith("extmethod:"), "Method").when(F.col("id").startswith("package:"), "Package").otherwise("Type")
    guessed = ends.distinct().select("id", kind.alias("kind"), simple_name(F.regexp_replace("id", "^[^:]*:", "")).alias("name"), F.lit(True).alias("placeholder"))
    nodes = merge_nodes(_union([declared(j), guessed]).withColumn("ordinal", F.col("file")))
    return nodes, edges
