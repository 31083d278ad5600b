"""Project files: walks, solutions, references, properties, conditions, imports, compile commands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.functions.columns import ci, struct_udf
from depweave.functions.ids import ignored_directory
from depweave.plans.numbering import numbered
from depweave.plans.staging import stage

#: Endings of C++ files, and pieces of a solution file's line.
CPP_ENDINGS = ("c", "cc", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx", "inl", "ipp", "ixx", "tpp")
SLN_PROJECT = r'^\s*Project\([^)]*\)\s*=\s*"[^"]+",\s*"([^"]+)"\s*,'
COMMAND_TOKEN = r'"(?:\\.|[^"])*"|[^\s]+'


def files(spark: SparkSession, root: str, endings: tuple[str, ...] = CPP_ENDINGS) -> DataFrame:
    """``path, length`` of files below root with one of the endings, none of them in a directory that is never walked; sorted whatever the case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root.rstrip("/")) + 2, 1 << 20)
    parts = F.split(below, "/")
    pruned = F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda d: ignored_directory(d))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings) & ~pruned).distinct().orderBy(ci("path"), "path")


def capped_files(rows: DataFrame, cap: int = 250_000) -> DataFrame:
    """The first ``cap`` files in order; with ``over``: whether there were more."""
    placed = numbered(rows, [ci("path"), "path"], "_n")
    over = placed.where(F.col("_n") > cap).limit(1).count() > 0
    return placed.where(F.col("_n") <= cap).drop("_n").withColumn("over", F.lit(over))


def sln_projects(lines: DataFrame, line: str = "value", ending: str = ".vcxproj") -> DataFrame:
    """``path``: projects of one ending that the lines of a solution file name."""
    return lines.select(F.regexp_extract(line, SLN_PROJECT, 1).alias("path")).where((F.col("path") != "") & F.endswith(F.lower("path"), F.lit(ending))).distinct()


def slnx_projects(documents: DataFrame, xml: str = "text") -> DataFrame:
    """``path``: what the Project elements of a solution in XML name."""
    return documents.select(F.explode(F.xpath(F.col(xml), F.lit("//Project/@Path"))).alias("path")).where("path <> ''").distinct()


def _element(xml: Column, pattern: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))


def package_references(documents: DataFrame, key: str, xml: str = "text") -> DataFrame:
    """``key, package``: package references as ``name (version)``, distinct whatever the case, sorted as upper case.

    The name is Include, else Update; the version an attribute, else an element inside.
    """
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<PackageReference\b(?:[^>]*/>|.*?</PackageReference>))"), F.lit(1))
    rows = documents.select(key, F.posexplode(blocks).alias("pos", "b"))
    attribute = lambda name: F.regexp_extract(F.regexp_extract("b", "(?s)^<PackageReference([^>]*)>", 1), rf'\b{name}\s*=\s*"([^"]*)"', 1)
    some = lambda *xs: F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in xs))
    name, version = some(attribute("Include"), attribute("Update")), some(attribute("Version"), F.regexp_extract("b", r"(?s)<Version>(.*?)</Version>", 1))
    named = rows.select(key, "pos", F.when(version.isNotNull(), F.concat(name, F.lit(" ("), version, F.lit(")"))).otherwise(name).alias("package")).where("package is not null")
    return named.groupBy(key, ci("package").alias("u")).agg(F.min_by("package", "pos").alias("package")).orderBy(key, "u").drop("u")


def metadata_references(documents: DataFrame, key: str, xml: str = "text") -> DataFrame:
    """``key, name``: stems of referenced files, distinct whatever the case, sorted as upper case."""
    names = F.regexp_extract_all(F.col(xml), F.lit(r'<Reference\b[^>]*\bInclude\s*=\s*"([^",]+)'), F.lit(1))
    rows = documents.select(key, F.posexplode(names).alias("pos", "n")).select(key, "pos", F.regexp_replace(F.regexp_extract("n", r"([^/\\]+)$", 1), r"(?i)\.(dll|exe)$", "").alias("name"))
    return rows.groupBy(key, ci("name").alias("u")).agg(F.min_by("name", "pos").alias("name")).orderBy(key, "u").drop("u")


def project_references(documents: DataFrame, key: str, xml: str = "text") -> DataFrame:
    """``key, target, label``: referenced projects by path whatever the case, with the label that sorts first."""
    paths = F.regexp_extract_all(F.col(xml), F.lit(r'<ProjectReference\b[^>]*\bInclude\s*=\s*"([^"]+)"'), F.lit(1))
    rows = documents.select(key, F.explode(paths).alias("target")).withColumn("label", F.regexp_replace(F.regexp_extract("target", r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", ""))
    return rows.groupBy(key, ci("target").alias("u")).agg(F.min_by(F.struct("target", "label"), F.struct(ci("label").alias("l"), "label", "target")).alias("r")).select(key, "r.target", "r.label")


#: How properties and metadata are written.
_PROPERTY = re.compile(r"\$\(([^)]+)\)")
_METADATA = re.compile(r"%\([^)]+\)")


def expand(text: str, properties: dict[str, str], passes: int = 4) -> str:
    """``$(Name)`` replaced by its value whatever the case, a few times over; unknown names and metadata are empty."""
    known = {k.upper(): v for k, v in properties.items()}
    for _ in range(passes):
        new = _PROPERTY.sub(lambda m: known.get(m[1].strip().upper(), ""), text)
        if new == text:
            break
        text = new
    return _METADATA.sub("", _PROPERTY.sub("", text))


_LEX = re.compile(r"\s*(?:('(?:[^'])*')|(==|!=|<=|>=|<|>|!|\(|\))|([^\s()'!=<>]+))")


def holds(condition: str | None, properties: dict[str, str], existing: frozenset[str] = frozenset()) -> bool:
    """Whether a condition holds: Or binds weakest, then And, then Not; then a call, a comparison or a truth value.

    Two numbers are compared as numbers, else as texts whatever their case. A blank condition holds.
    """
    if not (condition or "").strip():
        return True
    words = [next(g for g in m.groups() if g is not None) for m in _LEX.finditer(expand(condition, properties))]
    at = 0

    def peek() -> str:
        return words[at].lower() if at < len(words) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1] if at <= len(words) else ""

    def any_of() -> bool:
        found = all_of()
        while peek() == "or":
            take()
            found = all_of() or found
        return found

    def all_of() -> bool:
        found = one()
        while peek() == "and":
            take()
            found = one() and found
        return found

    def one() -> bool:
        if peek() == "!":
            take()
            return not one()
        if peek() == "(":
            take()
            found = any_of()
            take()
            return found
        left = take().strip("'")
        if left.lower() in ("exists", "hastrailingslash") and peek() == "(":
            take()
            text = take().strip("'")
            take()
            return text.rstrip("/") in existing if left.lower() == "exists" else text.endswith(("/", "\\"))
        if peek() in ("==", "!=", "<", ">", "<=", ">="):
            sign, right = take(), take().strip("'")
            try:
                a, b = float(left), float(right)
            except ValueError:
                a, b = left.upper(), right.upper()
            return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]
        return left.lower() in ("true", "1", "yes", "on")

    return any_of()


def conditions(rows: DataFrame, condition: str = "condition", properties: str = "properties", out: str = "active") -> DataFrame:
    """Rows with ``out``: whether the condition holds under the row's properties (a map)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for c, p in batches:
            yield pa.array([holds(x, dict(y or [])) for x, y in zip(c.to_pylist(), p.to_pylist(), strict=True)], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return rows.withColumn(out, F.arrow_udf(run, "boolean")(F.col(condition), F.col(properties)))


def import_closure(roots: DataFrame, imports: DataFrame) -> DataFrame:
    """``project, file, hops``: the files that a project's file imports, directly or through others, each once.

    ``roots``: ``project, file``; ``imports``: ``file, target``.
    """
    seen = stage(roots.select("project", "file").distinct().withColumn("hops", F.lit(0)), "imports")
    front, hop = seen, 0
    while True:
        hop += 1
        near = front.select("project", "file").join(imports, "file").select("project", F.col("target").alias("file")).distinct()
        front = stage(near.join(seen.select("project", "file"), ["project", "file"], "left_anti").withColumn("hops", F.lit(hop)), "imports")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


_STATEMENTS = "array<struct<place:long,pos:int,kind:string,name:string,value:string,conditions:array<string>>>"
_MAP = pa.map_(pa.string(), pa.string())


def load_level(state: dict[str, str], statements: list[dict], environment: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """What one level of files makes of a project's properties, and the targets of its imports in order.

    ``statements`` come in the order of files and, within a file, of the document. A file's properties
    are set first, each expanded with what is set so far; then its imports are looked at. Both count
    only where all their conditions hold. Blank values, and those in which a ``$(`` is left, set nothing.
    """
    state, targets = dict(state), []
    for place in sorted({s["place"] for s in statements}):
        here = sorted((s for s in statements if s["place"] == place), key=lambda s: s["pos"])
        for kind in ("property", "import"):
            for s in here:
                known = environment | state
                if s["kind"] != kind or not all(holds(c, known) for c in s["conditions"] or []):
                    continue
                value = expand((s["value"] or "").strip(), known).strip()
                if kind == "import" and value and not set(value) & {"*", "?"}:
                    targets.append(value)
                elif kind == "property" and value and "$(" not in value and (s["name"] or "").strip():
                    state[s["name"].strip().upper()] = value
    return state, targets


def loaded_properties(roots: DataFrame, statements: DataFrame, environment: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``project, file, place`` of the files that each project loads, in their order, and rows ``project, name, value`` of the properties at the end, names in upper case.

    ``roots``: ``project, file``; ``statements``: ``file, pos, kind`` (property or import)``, name,
    value, conditions`` (an array: those of the element and all around it). Files are loaded breadth
    first: what a file imports comes behind all files that wait already, each file once, whatever the
    case of its path; files without statements load nothing. A value can so override one of a file
    before it, and conditions see what is set at that point. ``environment`` has values of names that
    no property has.

    A round loads one level of all projects: a join with the statements, and a fold over a project's
    files of that level, which are one row.
    """
    known = {k.upper(): v for k, v in (environment or {}).items()}
    rows = stage(statements.select(ci("file").alias("u"), "pos", "kind", "name", "value", "conditions"), "statements")
    there = stage(rows.select("u").distinct(), "there")

    def fold(values: list[dict]) -> list[list]:
        done = [load_level({k.upper(): v for k, v in v_["state"] or []}, v_["statements"], known) for v_ in values]
        return [[list(state.items()) for state, _ in done], [targets for _, targets in done]]

    run = struct_udf(fold, [("state", _MAP), ("targets", pa.list_(pa.string()))], "state map<string,string>, targets array<string>")
    first = roots.groupBy("project").agg(F.min("file").alias("file")).withColumn("place", F.lit(0).cast("long"))
    front = stage(first, "front")
    loaded = front
    state = stage(first.select("project", F.create_map().cast("map<string,string>").alias("state")), "state")
    while True:
        said = front.select("project", "place", ci("file").alias("u")).join(rows, "u").groupBy("project").agg(F.collect_list(F.struct("place", "pos", "kind", "name", "value", "conditions")).cast(_STATEMENTS).alias("statements"))
        new = stage(said.join(state, "project").select("project", run(F.struct("state", "statements")).alias("r")).select("project", "r.*"), "level")
        kept = state.join(new.select("project"), "project", "left_anti")
        state = stage(kept.unionByName(new.select("project", "state")), "state")
        each = new.select("project", F.posexplode("targets").alias("i", "file")).withColumn("u", ci("file"))
        fresh = each.join(there, "u", "left_semi").join(loaded.select("project", ci("file").alias("u")), ["project", "u"], "left_anti")
        fresh = fresh.groupBy("project", "u").agg(F.min(F.struct("i", "file")).alias("f"))
        order = F.row_number().over(Window.partitionBy("project").orderBy("f.i"))  # files of one level of a project
        last = loaded.groupBy("project").agg(F.max("place").alias("last"))
        front = stage(fresh.withColumn("n", order).join(last, "project").select("project", F.col("f.file").alias("file"), (F.col("last") + F.col("n")).alias("place")), "front")
        if not front.limit(1).count():
            return loaded, state.select("project", F.explode("state").alias("name", "value"))
        loaded = stage(loaded.unionByName(front), "loaded")


def chosen_configuration(candidates: DataFrame, wanted_configuration: str = "", wanted_platform: str = "") -> DataFrame:
    """``project, configuration, platform``: the best of each project; ties by name.

    What is wanted counts most (100 and 75), then Debug (20), x64 (10) and Release (5).
    """
    c, p = ci("configuration"), ci("platform")
    given = lambda x, want, n: F.when((x == want.upper()) & F.lit(want != ""), n).otherwise(0)
    score = given(c, wanted_configuration, 100) + given(p, wanted_platform, 75) + F.when(c == "DEBUG", 20).when(c == "RELEASE", 5).otherwise(0) + F.when(p == "X64", 10).otherwise(0)
    order = Window.partitionBy("project").orderBy(F.desc("_s"), c, p)
    return candidates.withColumn("_s", score).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("project", "configuration", "platform")


def command_tokens(command: Column) -> Column:
    """Words of a command line; what stands in quotes is one word, without them."""
    words = F.regexp_extract_all(command, F.lit(f"({COMMAND_TOKEN})"), F.lit(1))
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit('"')) & F.endswith(w, F.lit('"')), F.substring(w, F.lit(2), F.length(w) - 2)).otherwise(w))


def compile_commands(entries: DataFrame) -> DataFrame:
    """``file, tokens``: of each source the entry with the most words, the first of equals; and every entry of an unknown source, with a null file.

    ``entries``: ``file, arguments, command, ordinal``; without a file, the last word with the ending of a C++ file is it.
    """
    blank = F.filter(F.col("arguments"), lambda x: F.trim(x) != "")
    tokens = F.when(F.size(blank) > 0, blank).otherwise(command_tokens(F.coalesce("command", F.lit(""))))
    rows = entries.withColumn("tokens", tokens)
    sources = F.filter("tokens", lambda t: F.rlike(F.lower(t), F.lit(rf"\.({'|'.join(map(re.escape, CPP_ENDINGS))})$")))
    rows = rows.withColumn("file", F.coalesce(F.nullif(F.trim("file"), F.lit("")), F.try_element_at(sources, F.lit(-1))))
    known = rows.where("file is not null").groupBy("file").agg(F.max_by("tokens", F.struct(F.size("tokens").alias("n"), (-F.col("ordinal")).alias("o"))).alias("tokens"))
    return known.unionByName(rows.where("file is null").select("file", "tokens"))


def relevant_commands(commands: DataFrame, files: DataFrame, directory: str) -> DataFrame:
    """Those of the commands whose ``file`` is unknown, is one of the project's files (``path``), or lies below its directory; whatever the case."""
    below = F.startswith(ci("file"), F.lit(directory.upper().rstrip("/") + "/"))
    mine = files.select(ci("path").alias("_u"), F.lit(True).alias("_mine")).distinct()
    found = commands.withColumn("_u", ci("file")).join(mine, "_u", "left")
    return found.where(F.col("file").isNull() | below | F.col("_mine")).select(*commands.columns)


def include_directories(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``project, directory, ordinal``: directories of ``;``-lists in order (of equal places by name), each once; with ``existing`` (``directory``) those only that exist."""
    each = rows.select("project", "ordinal", F.posexplode(F.split("value", ";")).alias("pos", "directory")).withColumn("directory", F.trim("directory")).where("directory <> ''")
    first = each.groupBy("project", "directory").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    first = first if existing is None else first.join(existing, "directory", "left_semi").select("project", "directory", "at")
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy("project").orderBy("at", "directory")) - 1).drop("at")
