"""From parsed Java types to call edges: receivers resolved to classes, interfaces expanded to what implements them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_type(kind: Column) -> Column:
    """A type without its arguments."""
    return F.regexp_replace(kind, "<.*", "")


def last_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def class_files(types: DataFrame) -> DataFrame:
    """(class_name, path, kind): of types with one name the last by path."""
    return types.groupBy("class_name").agg(F.max_by(F.struct("path", "kind"), F.struct("path", "start_line")).alias("x")).select("class_name", "x.path", "x.kind")


def call_edges(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee, caller_file, callee_file) of the calls in methods.

    `obj.m` goes to the type of the field obj, else of the local variable, else of the parameter; without a type the text
    stays. `m` is of the same class. Of a longer receiver the first name counts. Type arguments are dropped.
    """
    parts = F.split("call", r"\.")
    calls = methods.select("path", "class_name", "name", "params", "locals", F.explode("calls").alias("call"))
    calls = calls.withColumn("obj", F.when(F.size(parts) > 1, parts[0])).withColumn("m", F.element_at(parts, -1))
    fields = types.select("class_name", "path", F.posexplode("fields").alias("place", "f")).groupBy("class_name", F.col("f.name").alias("obj"))
    fields = fields.agg(raw_type(F.max_by("f.type", F.struct("path", "place"))).alias("field_type"))
    of = lambda c: F.get(F.filter(c, lambda v: v["name"] == F.col("obj")), F.size(F.filter(c, lambda v: v["name"] == F.col("obj"))) - 1)["type"]
    known = calls.join(fields, ["class_name", "obj"], "left")
    kind = F.coalesce("field_type", raw_type(of("locals")), raw_type(of("params")))
    own = F.when(F.col("obj").isNull(), F.concat_ws(".", "class_name", "m")).when(kind.isNotNull(), F.concat_ws(".", kind, "m")).otherwise(F.col("call"))
    edges = known.select(F.concat_ws(".", "class_name", "name").alias("caller"), own.alias("callee"), F.col("path").alias("caller_file"), F.when(F.col("obj").isNull(), F.col("class_name")).otherwise(kind).alias("callee_class"))
    files = class_files(types).select(F.col("class_name").alias("callee_class"), F.col("path").alias("file"))
    return edges.join(files, "callee_class", "left").select("caller", "callee", "caller_file", F.coalesce("file", "caller_file").alias("callee_file")).distinct()


def implementors(types: DataFrame) -> DataFrame:
    """(interface, class_name, path): classes by the last name of each interface that they name."""
    named = types.where("kind <> 'interface'").select("class_name", "path", F.explode("interfaces").alias("i"))
    known = class_files(types).where("kind = 'interface'").select(F.col("class_name").alias("interface"))
    return named.select("class_name", "path", last_name(F.col("i")).alias("interface")).join(known, "interface").distinct()


def expand_interfaces(edges: DataFrame, types: DataFrame) -> DataFrame:
    """edges, and for each call of an interface one of every class that names it, whether or not it defines the method."""
    of = implementors(types)
    more = edges.join(of, F.substring_index("callee", ".", 1) == of["interface"])
    more = more.select("caller", F.concat_ws(".", "class_name", last_name(F.col("callee"))).alias("callee"), "caller_file", F.col("path").alias("callee_file"))
    return edges.unionByName(more).distinct()


def expand_endpoints(edges: DataFrame, endpoints: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """edges, and for endpoints (signature) on interface methods an edge to each class that defines the method, where none is."""
    of, own = implementors(types), methods.select("class_name", F.col("name").alias("m")).distinct()
    e = endpoints.select("signature", F.substring_index("signature", ".", 1).alias("interface"), last_name(F.col("signature")).alias("m"))
    files = class_files(types).select(F.col("class_name").alias("interface"), F.col("path").alias("caller_file"))
    more = e.join(of, "interface").join(own, ["class_name", "m"], "left_semi").join(files, "interface")
    more = more.select(F.col("signature").alias("caller"), F.concat_ws(".", "class_name", "m").alias("callee"), "caller_file", F.col("path").alias("callee_file")).distinct()
    return edges.unionByName(more.join(edges.select("caller", "callee"), ["caller", "callee"], "left_anti"))


def resolve_class(names: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """names with the path of the class each means: by full name, else by simple name with that full name, else the first simple hit by path.

    Types are guessed small from the keys that their texts are made of, so the hints keep them from being sent to the driver whole.
    """
    full = types.select(F.col("full_name").alias("k"), "path", F.lit(0).alias("way"))
    simple = types.select(F.col("class_name").alias("k"), "path", F.lit(1).alias("way"))
    asked = names.select(name).distinct()
    found = asked.join(full.hint("merge"), F.col(name) == F.col("k")).unionByName(asked.join(simple.hint("merge"), last_name(F.col(name)) == F.col("k")))
    best = found.groupBy(name).agg(F.min(F.struct("way", "path")).alias("x")).select(name, F.col("x.path").alias("class_path"))
    return names.join(best.hint("merge"), name, "left")


def import_files(types: DataFrame) -> DataFrame:
    """(path, imported): files whose name is the last part of an import, or that with Impl at its end."""
    stem = F.regexp_extract("path", r"([^/]+)\.java$", 1)
    files = types.select("path", stem.alias("stem")).distinct()
    asked = types.select(F.col("path").alias("from"), F.explode("imports").alias("i")).select("from", last_name(F.col("i")).alias("n")).distinct()
    ways = asked.select("from", F.explode(F.array("n", F.concat("n", F.lit("Impl")))).alias("stem"))
    return ways.join(files, "stem").where("from <> path").select(F.col("from").alias("path"), F.col("path").alias("imported")).distinct()


def edges_with_files(edges: DataFrame) -> DataFrame:
    """(node, file) of a graph with file columns: of several the first in order."""
    ends = edges.select(F.col("caller").alias("node"), F.col("caller_file").alias("file")).unionByName(edges.select(F.col("callee").alias("node"), F.col("callee_file").alias("file")))
    return ends.groupBy("node").agg(F.min("file").alias("file"))


def statement_files(statements: DataFrame, types: DataFrame, layer: str = "mapper") -> DataFrame:
    """(path, namespace, sql_id, method, layer, file): the files of a mapper statement.

    The classes that its namespace, parameter type, result type and result map name are of the given layer, its own file
    is of layer xml. method is the last name of the namespace with the id; null without a namespace.
    """
    has = F.coalesce(F.col("namespace"), F.lit("")) != ""
    s = statements.where("sql_id is not null").select("path", "namespace", "sql_id", F.when(has, F.concat_ws(".", last_name(F.col("namespace")), "sql_id")).alias("method"), "parameter_type", "result_type", "result_map")
    refs = s.select("path", "namespace", "sql_id", "method", F.explode(F.array("namespace", "parameter_type", "result_type", "result_map")).alias("name")).where("name <> ''")
    found = resolve_class(refs, types).where("class_path is not null").select("path", "namespace", "sql_id", "method", F.lit(layer).alias("layer"), F.col("class_path").alias("file"))
    return found.unionByName(s.select("path", "namespace", "sql_id", "method", F.lit("xml").alias("layer"), F.col("path").alias("file"))).distinct()


def local_calls(methods: DataFrame) -> DataFrame:
    """(caller, callee, caller_file, callee_file): every call taken as one of the caller's own class.

    The file is that of a method with the called name, of several the last by path and line; else the caller's.
    """
    calls = methods.select("path", "class_name", "name", F.explode("calls").alias("call")).select("path", "class_name", "name", last_name(F.col("call")).alias("m"))
    files = methods.groupBy(F.col("name").alias("m")).agg(F.max_by("path", F.struct("path", "start_line")).alias("file"))
    return calls.join(files, "m", "left").select(F.concat_ws(".", "class_name", "name").alias("caller"), F.concat_ws(".", "class_name", "m").alias("callee"), F.col("path").alias("caller_file"), F.coalesce("file", "path").alias("callee_file")).distinct()


#: The ends of a class that implements a service interface, in the order in which they are tried.
IMPL_ENDS = ("Impl", "IMPL", "impl")


def service_imports(types: DataFrame, services: DataFrame) -> DataFrame:
    """(path, imported): for each import the service file (services: path) that it means.

    A leading I before a capital is left out; first with an end of IMPL_ENDS, then the full name with one, then the name
    itself with or without the I; of several the least path.
    """
    asked = types.select(F.col("path").alias("from"), F.explode("imports").alias("i")).select("from", "i", last_name(F.col("i")).alias("n")).distinct()
    bare = F.regexp_replace("n", "^I(?=[A-Z])", "")
    names = [F.concat(x, F.lit(e)) for x in (bare, F.col("n")) for e in IMPL_ENDS]
    ways = F.array(*(F.struct(F.lit(k).alias("way"), x.alias("stem")) for k, x in enumerate(names)), *(F.struct(F.lit(len(names)).alias("way"), x.alias("stem")) for x in (F.col("n"), bare)))
    files = services.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")).distinct()
    hit = asked.select("from", "i", F.inline(ways)).join(files, "stem")
    best = hit.groupBy("from", "i").agg(F.min(F.struct("way", "path")).alias("x"))
    return best.select(F.col("from").alias("path"), F.col("x.path").alias("imported")).distinct()


def service_chain(types: DataFrame, services: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, file, depth): service files that each root (path) reaches over imports, by least depth; a root is no file of its own chain unless it is reached."""
    from .graph import reach

    edges = service_imports(types, services).select(F.col("path").alias("caller"), F.col("imported").alias("callee"))
    far = reach(edges, roots.select(F.col("path").alias("node")), max_depth=1 << 30)
    back = far.join(edges, far["node"] == edges["caller"]).where(F.col("callee") == F.col("root")).groupBy("root").agg(F.min(F.col("depth") + 1).alias("depth"))
    return far.where("depth > 0").select("root", F.col("node").alias("file"), "depth").unionByName(back.select("root", F.col("root").alias("file"), "depth"))


def namespace_methods(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """(namespace, class_name, method, sql_id, path): methods of classes with a constant NAMESPACE, and the id that each adds to it.

    Of a file counts the class of its name, else the first. A method without `NAMESPACE + "id"` has sql_id null.
    """
    from ..functions.javatext import without_comments

    code = without_comments(F.col("text"))
    name = F.regexp_extract(code, r'\bNAMESPACE\s*=\s*"([^"]*)"', 1)
    files = sources.select("path", F.trim(name, F.lit(".")).alias("namespace"), F.split("text", "\n").alias("lines")).where("namespace <> ''")
    own = (F.col("class_name") == F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).cast("int")
    chosen = methods.groupBy("path").agg(F.max_by("class_name", F.struct(own, -F.col("start_line"))).alias("class_name"))
    body = without_comments(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    found = methods.join(chosen, ["path", "class_name"]).join(files, "path")
    return found.select("namespace", "class_name", F.col("name").alias("method"), F.nullif(F.regexp_extract(body, r'NAMESPACE\s*\+\s*"([^"]+)"', 1), F.lit("")).alias("sql_id"), "path")


def batch_endpoints(methods: DataFrame, suffix: str = "BAT", method: str = "execute") -> DataFrame:
    """(path, signature, http_method, end_point): methods of that name in classes with that end in any case, whose end point
    is their file, and `run` of classes named ..Tasklet, whose end point is the class and whose verb is BATCH."""
    own = methods.select("path", "class_name", "name", F.concat_ws(".", "class_name", "name").alias("signature"))
    by_suffix = own.where(F.upper("class_name").endswith(suffix.upper()) & (F.col("name") == method)).select("path", "signature", F.lit(None).cast("string").alias("http_method"), F.col("path").alias("end_point"))
    tasklets = own.where(F.col("class_name").endswith("Tasklet") & (F.col("name") == "run")).select("path", "signature", F.lit("BATCH").alias("http_method"), F.col("class_name").alias("end_point"))
    return by_suffix.unionByName(tasklets).distinct()


def chains_to(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, chain): for each root (path) the shortest chain of files whose last uses a target (path); the least in order of several, none without one.

    edges (path, imported) are imports, files of one package and what else counts. Chains don't pass through targets.
    """
    from .graph import shortest_paths

    goal = targets.select(F.col("path").alias("imported")).distinct()
    uses = edges.join(goal, "imported", "left_semi").select(F.col("path").alias("node")).distinct()
    between = edges.join(goal, "imported", "left_anti").select(F.col("path").alias("caller"), F.col("imported").alias("callee"))
    far = shortest_paths(between, roots.select(F.col("path").alias("node")).distinct(), max_depth=1 << 30)
    best = far.join(uses, "node", "left_semi").groupBy("root").agg(F.min(F.struct("depth", "path")).alias("x"))
    return best.select("root", F.col("x.path").alias("chain"))


def package_edges(files: DataFrame, others: DataFrame) -> DataFrame:
    """(path, imported): files (path, text) and those of others (path) in the same folder whose name stands in the text as a word."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    words = files.select(F.col("path").alias("from"), folder.alias("folder"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w$]+)"), F.lit(1)))).alias("stem"))
    named = others.select("path", folder.alias("folder"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")).distinct()
    return words.join(named, ["folder", "stem"]).where("from <> path").select(F.col("from").alias("path"), F.col("path").alias("imported")).distinct()


def controller_groups(types: DataFrame, controllers: DataFrame, services: DataFrame, values: DataFrame) -> DataFrame:
    """(controller, files, context): per controller (path) itself and the services (path) it imports, and the value files
    (path) that it or those services import; arrays in order. An import means the file of its name or that with Impl."""
    edges = import_files(types)
    c = controllers.select(F.col("path").alias("controller")).distinct()
    first = c.join(edges, c["controller"] == edges["path"]).select("controller", F.col("imported").alias("file")).join(services.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    files = c.select("controller", F.col("controller").alias("file")).unionByName(first.select("controller", "file")).distinct()
    vo = files.join(edges, files["file"] == edges["path"]).select("controller", F.col("imported").alias("vo")).join(values.select(F.col("path").alias("vo")).distinct(), "vo", "left_semi")
    lists = lambda df, col, name: df.groupBy("controller").agg(F.array_sort(F.collect_set(col)).alias(name))
    return lists(files, "file", "files").join(lists(vo, "vo", "context"), "controller", "left").select("controller", "files", F.coalesce("context", F.array().cast("array<string>")).alias("context"))
