"""Queries of project files: walks, solutions, references, configurations, compile commands, include directories; spreads of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import ids
from depweave.operators import layout as L
from depweave.sources import projects as J
from depweave.sources.workspace import Workspace


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def ignored_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a directory, here one for each part, is walked."""
    names = F.array(*map(F.lit, ("Node_Modules", " bin ", "cmake-build-debug", "src", "objects")))
    p = Workspace(spark, sf_dir).table("part")
    name = F.coalesce(F.get(names, F.col("p_size") % 6), F.col("p_name"))
    return p.select("p_partkey", ids.ignored_directory(name).alias("ignored"))


def solution_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that the lines of a solution name, and those of a solution in XML; a line and a document for each supplier."""
    s = Workspace(spark, sf_dir).table("supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    ending = F.when(n < 12, ".VcxProj").otherwise(".csproj")
    line = F.when(n < 18, _text(' Project("{8BC9}") = "s', k, '", "dir\\s', k, ending, '", "{', k, '}"')).otherwise("EndProject")
    xml = _text('<Solution><Folder Name="a"><Project Path="s', k, '.csproj" /></Folder><Project Path="" /></Solution>')
    lines = J.sln_projects(s.select(line.alias("value"))).withColumn("kind", F.lit("sln"))
    return lines.unionByName(J.slnx_projects(s.select(xml.alias("text"))).withColumn("kind", F.lit("slnx")))


def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced projects and files of a project file for each supplier."""
    rows = Workspace(spark, sf_dir).table("lineitem").select("l_suppkey", "l_partkey").distinct()
    k = F.col("l_partkey")
    path = _text("..\\d", k % 7, "\\x", k, ".csproj")
    refs = _text('<ProjectReference Include="', path, '" />\n<ProjectReference Include="', F.upper(path), '" />\n')
    refs = F.concat(refs, _text('<Reference Include="/lib/n', k % 10, F.when(k % 2 == 0, ".DLL").otherwise(""), ', Version=1" />'))
    files = rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(refs)), "\n").alias("text"))
    projects = J.project_references(files, "l_suppkey").select("l_suppkey", F.lit("project").alias("kind"), "target", "label")
    return projects.unionByName(J.metadata_references(files, "l_suppkey").select("l_suppkey", F.lit("file").alias("kind"), F.col("name").alias("target"), F.col("name").alias("label")))


def chosen_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of a project for each supplier, where Release is wanted."""
    c = F.when(F.col("l_returnflag") == "A", "Debug").when(F.col("l_returnflag") == "R", "release").otherwise(_text("Own", F.col("l_linenumber")))
    rows = Workspace(spark, sf_dir).table("lineitem").select(F.col("l_suppkey").alias("project"), c.alias("configuration"), F.when(F.col("l_linestatus") == "O", "x64").otherwise("Win32").alias("platform"))
    return J.chosen_configuration(rows.distinct(), "Release")


def compile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command of each source that belongs to a project, of an entry for each line: arguments or a command line, with or without a file."""
    w = Workspace(spark, sf_dir)
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    stem = _text("/src/", F.when(k % 3 == 0, "sub").otherwise("subway"), "/f", k)
    words = F.when(F.col("l_quantity") > 40, F.array(F.lit("cc"), F.lit("-c"), F.lit("-O2"), F.lit("-g"), _text(stem, ".cpp"))).when(n % 2 == 0, F.array(F.lit("cc"), F.lit(" "), F.lit("-c"), _text(stem, ".cpp")))
    entries = w.table("lineitem").select(
        F.when(n % 3 == 0, F.lit(None)).otherwise(_text(stem, ".cpp")).alias("file"), words.alias("arguments"),
        _text('cc "-I x y" -DK', n, " ", stem, ".C++").alias("command"), (F.col("l_orderkey") * 10 + n).alias("ordinal"),
    )
    lost = w.table("supplier").select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("array<string>").alias("arguments"), _text("cc -v -DS", F.col("s_suppkey")).alias("command"), F.col("s_suppkey").alias("ordinal"))
    entries = entries.unionByName(lost)  # of an unknown source
    mine = w.table("part").where("p_size <= 25").select(_text("/SRC/subway/f", F.col("p_partkey"), ".cpp").alias("path"))
    return J.relevant_commands(J.compile_commands(entries), mine, "/Src/sub/").select("file", F.array_join("tokens", "|").alias("tokens"))


def include_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that exist of the lists of a project, here of a supplier's lines."""
    w = Workspace(spark, sf_dir)
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = w.table("lineitem").select(F.col("l_suppkey").alias("project"), (F.col("l_orderkey") * 10 + n).alias("ordinal"), _text("/inc/p", k, "; ;/inc/l", n, " ;/inc/p", n).alias("value"))
    p = w.table("part")
    existing = p.where("p_size <= 25").select(_text("/inc/p", F.col("p_partkey")).alias("directory")).unionByName(p.select(_text("/inc/l", F.col("p_size") % 5).alias("directory")).distinct())
    return J.include_directories(rows, existing).select("project", "directory", F.col("ordinal").cast("long").alias("ordinal"))


def collision_spread_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, one for each order, on spots that several share, spread as documents and as other nodes; pinned ones stay."""
    k, c = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 20)
    nodes = Workspace(spark, sf_dir).table("orders").select(k.alias("id"), (c * 10 + 0.25).alias("x"), (k % (1 + c % 9) * 7.0).alias("y"), (F.col("o_orderstatus") == "P").alias("pinned"))
    found = (L.spread(nodes, ["id"], how, F.col("pinned")).select(F.lit(how).alias("how"), "id", "x", "y") for how in ("other", "document"))
    return next(found).unionByName(next(found))


QUERIES = {f.__name__: f for f in (
    ignored_directories, solution_projects, file_references, chosen_configurations, compile_commands, include_directories, collision_spread_kinds,
)}

_SPREAD = """
SELECT '{how}' AS how, id, CAST(CASE WHEN pinned OR c = 1 THEN x ELSE x + (i % {per} - (least({per}, c - i // {per} * {per}) - 1) / 2.0) * {across} END AS DOUBLE) AS x,
       CAST(CASE WHEN pinned OR c = 1 THEN y ELSE y + (i // {per} - (ceil(c / {per}) - 1) / 2.0) * {down} END AS DOUBLE) AS y FROM k"""
_PER = lambda most: f"greatest(2, least({most}, CAST(ceil(sqrt(c)) AS BIGINT)))"

ORACLES = {
    "ignored_directories": "SELECT p_partkey, p_size % 6 IN (0, 1, 2) AS ignored FROM part",
    "solution_projects": r"""
        SELECT 'dir\s' || s_suppkey || '.VcxProj' AS path, 'sln' AS kind FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT 's' || s_suppkey || '.csproj', 'slnx' FROM supplier""",
    "file_references": r"""
        SELECT DISTINCT l_suppkey, 'project' AS kind, '..\D' || l_partkey % 7 || '\X' || l_partkey || '.CSPROJ' AS target, 'X' || l_partkey AS label FROM lineitem
        UNION ALL SELECT DISTINCT l_suppkey, 'file', 'n' || l_partkey % 10, 'n' || l_partkey % 10 FROM lineitem""",
    "chosen_configurations": """
        WITH c AS (SELECT DISTINCT l_suppkey AS project, CASE l_returnflag WHEN 'A' THEN 'Debug' WHEN 'R' THEN 'release' ELSE 'Own' || l_linenumber END AS configuration, CASE l_linestatus WHEN 'O' THEN 'x64' ELSE 'Win32' END AS platform FROM lineitem)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE configuration WHEN 'release' THEN 105 WHEN 'Debug' THEN 20 ELSE 0 END + CASE platform WHEN 'x64' THEN 10 ELSE 0 END DESC, upper(configuration), upper(platform)) = 1""",
    "compile_commands": """
        WITH e AS (SELECT l_partkey AS k, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS o, l_quantity > 40 AS long, '/src/' || CASE WHEN l_partkey % 3 = 0 THEN 'sub' ELSE 'subway' END || '/f' || l_partkey AS stem FROM lineitem),
        t AS (SELECT *, CASE WHEN long THEN 'cc|-c|-O2|-g|' || stem || '.cpp' WHEN n % 2 = 0 THEN 'cc|-c|' || stem || '.cpp' ELSE 'cc|-I x y|-DK' || n || '|' || stem || '.C++' END AS tokens,
                     CASE WHEN long THEN 5 WHEN n % 2 = 0 THEN 3 ELSE 4 END AS words, stem || CASE WHEN n % 3 <> 0 OR long OR n % 2 = 0 THEN '.cpp' ELSE '.C++' END AS file FROM e)
        SELECT file, arg_max(tokens, {'n': words, 'o': -o}) AS tokens FROM t WHERE k % 3 = 0 OR (file LIKE '%.cpp' AND k IN (SELECT p_partkey FROM part WHERE p_size <= 25)) GROUP BY file
        UNION ALL SELECT NULL, 'cc|-v|-DS' || s_suppkey FROM supplier""",
    "include_directories": """
        WITH e AS (SELECT l_suppkey AS project, l_orderkey * 10 + l_linenumber AS o, unnest([{'p': 0, 'd': '/inc/p' || l_partkey}, {'p': 2, 'd': '/inc/l' || l_linenumber}, {'p': 3, 'd': '/inc/p' || l_linenumber}]) AS u FROM lineitem),
        f AS (SELECT project, u.d AS directory, min({'o': o, 'p': u.p}) AS first FROM e WHERE u.d IN (SELECT '/inc/p' || p_partkey FROM part WHERE p_size <= 25 UNION ALL SELECT '/inc/l' || p_size % 5 FROM part) GROUP BY ALL)
        SELECT project, directory, row_number() OVER (PARTITION BY project ORDER BY first, directory) - 1 AS ordinal FROM f""",
    "collision_spread_kinds": """
        WITH n AS (SELECT o_orderkey AS id, o_custkey // 20 * 10 + 0.25 AS x, o_orderkey % (1 + o_custkey // 20 % 9) * 7.0 AS y, o_orderstatus = 'P' AS pinned FROM orders),
        k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY x, y, pinned) AS c FROM n WINDOW w AS (PARTITION BY x, y, pinned ORDER BY id))"""
    + _SPREAD.format(how="other", per=_PER(16), across="CASE WHEN c >= 80 THEN 94.0 ELSE 128.0 END", down="CASE WHEN c >= 80 THEN 54.0 ELSE 72.0 END") + " UNION ALL" + _SPREAD.format(how="document", per=_PER(8), across="172.0", down="66.0"),
}
