import random
import re

from pyspark.sql import functions as F

from depweave.sources import cpp as C
from depweave.sources import projects as J
from depweave.sources import view_state as V
from depweave.sources.store import KEEP, SnapshotStore, hydrated
from depweave.streaming.history import edge_counts, recorded
from tests.conftest import rows

SOURCE = """#include <vector>
#include "a.h"
#define MAX 3
namespace N {
class Foo : public Bar {
  Foo(int a);
  void run() {
    auto p = new Foo(2); int q = helper(1) + 1;
  }
};
}
"""


def test_strip(spark):
    def strip(text, keep_strings=False):
        return C.stripped(spark.createDataFrame([(text,)], "text string"), keep_strings=keep_strings).first()["code"]

    assert strip("int value = 1; // inline comment") == "int value = 1; "
    kept = strip('s = "http://example"; // gone\nint value = 3; /* block */ int next = 4;', keep_strings=True)
    assert kept == 's = "http://example"; \nint value = 3;  int next = 4;'
    assert strip('a = "x\\"y"; b') == "a =       ; b" and strip("/* a\nb */c") == "\nc" and strip(None) is None and strip("") == ""
    assert strip(r"""a = '\'' + "\\"; // x""") == "a =      +     ; " and strip('open "to the end\nx / y') == "open            \nx / y"
    assert strip('"a\\\nb" c') == "       c" and strip('"' + "\\x00" * 50_000 + '";') == " " * 200_002 + ";"


def test_strip_against_a_scanner(spark):
    lexeme = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["/", "*", '"x\\"y"', '"a\n', r"'\''", r'"\\\\"', '"//"', "a", " ", "\n", "//", "/*", "*/", "é"]) for _ in range(rng.randrange(30))) for _ in range(800)]
    for keep in (False, True):
        blank = lambda m: "" if m[0].startswith("//") else re.sub("[^\n]", "", m[0]) if m[0].startswith("/*") else m[0] if keep else " " * len(m[0])  # noqa: E731, B023
        got = {r["text"]: r["code"] for r in C.stripped(spark.createDataFrame([(t,) for t in texts], "text string"), keep_strings=keep).collect()}
        for t in texts:
            assert got[t] == lexeme.sub(blank, t), (t, keep)


def test_cpp_facts(spark):
    docs = spark.createDataFrame([("d", SOURCE), ("e", None), ("f", "")], "document_id string, text string")
    assert rows(C.facts(docs, "includes"), "document_id", "target", "quoted") == [("d", "a.h", True), ("d", "vector", False)]
    found = {(r["kind"], r["qualified_name"], r["is_definition"]) for r in C.facts(docs, "declarations").collect()}
    assert found == {("MacroDefinition", "MAX", False), ("ClassDeclaration", "N::Foo", False), ("ConstructorDeclaration", "N::Foo::Foo", False), ("MethodDeclaration", "N::Foo::run", True)}
    refs = {(r["token"], r["reference_kind"]) for r in C.facts(docs, "references").collect()}
    assert {("Bar", "inheritance"), ("Foo", "creation"), ("helper", "call")} <= refs and ("run", "call") not in refs and "new" not in {t for t, _ in refs}
    assert rows(C.facts(docs, "ranges"), "qualified_name", "start", "end") == [("N::Foo::run", 7, 9)]
    calls = spark.createDataFrame([("d", 'h = LoadLibraryW(L"k.dll"); GetProcAddress(h, "f"); // LoadLibrary("x.dll")')], "document_id string, text string")
    assert rows(C.facts(calls, "native")) == [("d", 1, "GetProcAddress", "h", "f"), ("d", 1, "LoadLibrary", "h", "k.dll")]


def test_cpp_scopes_and_bodies(spark):
    text = """namespace A::B {
struct T;
enum class Color { red };
struct T
  : public Base
{
  T();
  int one() { return 1; }
  void two() {
    if (x) { y(); } else {
      z(); }
  } };
void T::three() {
} }
void four() {
  never(
typedef int gone(int);
using Alias = A::B::T;
"""
    docs = spark.createDataFrame([("d", text), ("long", "#include \"" + "x" * 300 + ".h\"")], "document_id string, text string")
    found = {(r["kind"], r["qualified_name"], r["line"], r["is_definition"]) for r in C.facts(docs, "declarations").collect()}
    assert found == {
        ("StructDeclaration", "A::B::T", 2, False), ("EnumDeclaration", "A::B::Color", 3, False), ("StructDeclaration", "A::B::T", 4, False), ("ConstructorDeclaration", "A::B::T::T", 7, False),
        ("MethodDeclaration", "A::B::T::two", 9, True), ("MethodDeclaration", "A::B::T::three", 13, True), ("FunctionDeclaration", "four", 15, True), ("TypeAliasDeclaration", "Alias", 18, False),
    }
    assert rows(C.facts(docs, "ranges"), "qualified_name", "start", "end", "idx") == [("A::B::T::three", 13, 14, 1), ("A::B::T::two", 9, 12, 0), ("four", 15, 15, 2)]
    assert {("Base", "inheritance"), ("x", "reference"), ("y", "call"), ("never", "call")} <= {(r["token"], r["reference_kind"]) for r in C.facts(docs, "references").collect()}
    snippet = C.facts(docs, "includes").first()["snippet"]
    assert len(snippet) == 180 and snippet.endswith("x...")


def test_conditions():
    p = {"Config": "Debug", "Tools": "17"}
    assert J.holds("'$(config)' == 'debug' And $(Tools) >= 9", p) and not J.holds("'$(MissingProp)' != ''", p) and not J.holds("$(MissingProp)", p)
    assert J.holds("false Or (true And !false)", p) and J.holds("Exists('/a/')", p, frozenset({"/a"})) and J.holds(" ", p) and not J.holds("HasTrailingSlash('a')", p)
    assert J.expand("$(A)%(x)$(no)", {"a": "$(B)", "b": "v"}) == "v"


def test_project_files(spark, tmp_path):
    xml = '<Project><PackageReference Include="b" Version="1"/><PackageReference Update="A"><Version>2.0</Version></PackageReference><PackageReference Include="B" Version="9" /><Reference Include="C:\\\\x\\\\Lib.dll, v=1" /><ProjectReference Include="..\\\\P\\\\P.csproj" /></Project>'
    docs = spark.createDataFrame([("p", xml)], "project string, text string")
    assert [r["package"] for r in J.package_references(docs, "project").collect()] == ["A (2.0)", "b (1)", "B (9)"]
    assert rows(J.metadata_references(docs, "project")) == [("p", "Lib")]
    assert rows(J.project_references(docs, "project"), "label") == [("P",)]
    sln = spark.createDataFrame([('Project("{G}") = "A", "a\\A.vcxproj", "{H}"',), ('Project("{G}") = "B", "b\\B.csproj", "{H}"',)], "value string")
    assert rows(J.sln_projects(sln)) == [("a\\A.vcxproj",)]
    assert rows(J.slnx_projects(spark.createDataFrame([("<Solution><Project Path='x/y.csproj'/></Solution>",)], "text string"))) == [("x/y.csproj",)]
    for name in ("a.cpp", "sub/B.h", "bin/c.cpp", "cmake-build-x/d.cpp", "n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in J.files(spark, str(tmp_path)).collect()] == ["a.cpp", "B.h"]
    c = spark.createDataFrame([("p", "Release", "x64"), ("p", "Debug", "Win32"), ("p", "Debug", "x64")], "project string, configuration string, platform string")
    assert rows(J.chosen_configuration(c)) == [("p", "Debug", "x64")] and rows(J.chosen_configuration(c, "release")) == [("p", "Release", "x64")]
    e = spark.createDataFrame([("a.cpp", ["cc", "a.cpp"], None, 1), (None, None, 'cc "-I x y" -c a.cpp', 2)], "file string, arguments array<string>, command string, ordinal int")
    assert rows(J.compile_commands(e)) == [("a.cpp", ["cc", "-I x y", "-c", "a.cpp"])]
    imports = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c")], "file string, target string")
    assert rows(J.import_closure(spark.createDataFrame([("p", "r")], "project string, file string"), imports)) == [("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("p", "r", 0)]


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.latest("/w") is None and store.latest(" \t") is None and store.load(None, "projects") is None
    tables = {"projects": spark.createDataFrame([("k", "n")], "project_key string, name string"), "documents": spark.createDataFrame([("d", "k", "f")], "document_id string, project_key string, name string")}
    store.save("/other", tables)
    ids = [store.save("/w/", tables) for _ in range(KEEP + 2)]
    kept = [r["snapshot_id"] for r in store.manifest().where("workspace = '/w'").orderBy("snapshot_id").collect()]
    assert kept == ids[-KEEP:] and store.latest(" /w ") == ids[-1] and store.latest("/other") == 1
    assert store.load("/w", "projects", ["name"], {"language": "string"}).collect()[0].asDict() == {"project_key": "k", "name": "n", "language": None}
    symbols = spark.createDataFrame([("d", "s")], "document_id string, symbol_id string")
    deps = spark.createDataFrame([("k", "package", "z"), ("k", "package", "a"), ("k", "package", "a")], "project_key string, kind string, name string")
    row = hydrated(tables["projects"], tables["documents"], symbols, deps).first()
    assert row["documents"][0]["symbol_count"] == 1 and [d["name"] for d in row["dependencies"]] == ["a", "z"]
    store.clear()
    assert store.latest("/w") is None


def test_streams(spark, tmp_path):
    states = spark.createDataFrame([(1, 1, None, "a"), (1, 2, None, "a"), (1, 3, None, "b"), (1, 4, None, "c"), (1, 5, -2, None), (1, 6, 9, None), (1, 7, None, "d"), (2, 1, None, "x")], "user_id long, ordinal int, move int, state string")
    states.write.parquet(f"{tmp_path}/states")
    q = recorded(spark.readStream.schema(states.schema).parquet(f"{tmp_path}/states")).writeStream.format("memory").queryName("hist").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hist")) == [(1, 1, "d", 2), (2, 0, "x", 1)]
    obs = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as source, 'b' as target union all select timestamp'2024-01-01 00:02:00', 'a', 'b'")
    obs.write.parquet(f"{tmp_path}/obs")
    q = edge_counts(spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/obs")).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.table("counts").collect()] == [2]


def test_view_states(spark):
    said = """{"dependencyMapDirection": "invalid", "panelWidth": -10, "mobilePanelHeight": 99999, "other": 1,
        "pinnedNodes": [{"nodeId": " node-a ", "x": 1, "y": 2}, {"nodeId": "node-a", "x": 3, "y": 4}, {"nodeId": "node-b", "x": NaN, "y": 10}, {"x": 1, "y": 1}],
        "hiddenNodes": [{"nodeId": " ", "label": "ignored"}, {"nodeId": "node-x", "label": " ", "group": "  "}, {"nodeId": "node-x", "label": "Node X", "group": "document"}, {"nodeId": "z", "label": "a"}, {"nodeId": "Q"}]}"""
    df = V.imported(spark.createDataFrame([(1, said), (2, None), (3, "no json"), (4, "{}")], "id int, json string"))
    got = {r["id"]: r["state"] for r in df.collect()}
    s = got[1]
    assert (s["dependencyMapDirection"], s["panelWidth"], s["mobilePanelHeight"], s["includeSymbols"], s["includeProjects"]) == ("both", 320, 1600, False, True)
    assert [tuple(n) for n in s["pinnedNodes"]] == [("node-a", 3.0, 4.0)]
    assert [tuple(n) for n in s["hiddenNodes"]] == [("z", "a", ""), ("node-x", "Node X", "document"), ("Q", "Q", "")]
    assert got[2] == got[3] == got[4] and got[2]["pinnedNodes"] == [] and got[2]["panelWidth"] == 320
    again = V.imported(V.exported(df), out="back")
    assert again.where(V.changed("state", "back")).count() == 0
    other = again.withColumn("back", F.col("back").withField("includeSymbols", F.lit(True)))
    assert other.where(V.changed("state", "back")).count() == 4


def test_heads_of_several_lines(spark):
    text = """namespace N {
class D :
  public E, // the first
  protected A::F
{
  void run(G* g);
};
struct One : Two {};
enum class H : int { x };
using T = U<W>;
class Long :
  public L1,

  public L2,
  public L3,
  public L4,
  public L5,
  public TooFar
{};
}"""
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "class Open :")], "document_id string, text string")
    found = C.facts(docs, "declaration_references")
    assert rows(found.where("qualified_name = 'N::D'"), "token", "reference_kind", "namespace_scope") == [("A::F", "inheritance", "N"), ("E", "inheritance", "N")]
    assert rows(found.where("name = 'run'"), "token", "reference_kind") == [("G", "reference"), ("g", "reference")]
    assert rows(found.where("name in ('One', 'H', 'T')"), "name", "token", "reference_kind") == [("One", "Two", "inheritance"), ("T", "U", "reference"), ("T", "W", "reference")]
    # Eight lines, blank ones among them, belong to a head.
    assert rows(found.where("name = 'Long'"), "token") == [("L1",), ("L2",), ("L3",), ("L4",), ("L5",), ("TooFar",)] and found.where("document_id <> 'd'").count() == 0
    further = spark.createDataFrame([("d", text.replace("L2,", "L2,\n"))], "document_id string, text string")
    assert "TooFar" not in [r["token"] for r in C.facts(further, "declaration_references").where("name = 'Long'").collect()]


def test_a_document_of_many_scopes(spark):
    """Scopes over buckets of lines find what a stack finds."""
    rng, lines, stack, want = random.Random(1), [], [], []
    for k in range(2500):
        if stack and rng.random() < 0.4:
            lines.append("}" if stack.pop()[1] == "n" else "};")
        elif len(stack) < 6 and rng.random() < 0.4:
            kind = rng.choice("nc")
            name = f"s{k}"
            if kind == "c":
                want.append((len(lines) + 1, "::".join([n for n, _ in stack] + [name])))
            lines.append(f"namespace {name} {{" if kind == "n" else f"struct {name} {{")
            stack.append((name, kind))
        else:
            lines.append(f"void f{k}();")
            want.append((len(lines), "::".join([n for n, _ in stack] + [f"f{k}"])))
    docs = spark.createDataFrame([("d", "\n".join(lines))], "document_id string, text string")
    assert sorted((r["line"], r["qualified_name"]) for r in C.facts(docs, "declarations").collect()) == want


def test_properties_in_load_order(spark):
    """A later import overrides an earlier value; conditions see what is set at that point; files load breadth first."""
    given = "file string, pos int, kind string, name string, value string, conditions array<string>"
    data = [
        ("root", 3, "import", None, "a.props", None), ("root", 1, "property", "X", "1", []), ("root", 4, "import", None, "$(Which).props", ["'$(X)' == '1'"]), ("root", 2, "property", "Which", "b", []), ("root", 5, "import", None, "c*.props", []),
        ("A.props", 1, "property", "x", "2", []), ("A.props", 2, "import", None, "deep.props", ["'$(X)' == '2'"]), ("A.props", 3, "import", None, "root", []), ("A.props", 4, "import", None, "never.props", ["'$(X)' == '3'"]),
        ("b.props", 1, "property", "X", "$(x)3", ["$(X) &lt; 1", ""]), ("b.props", 2, "property", "Y", "$(X)/$(None)y", []), ("b.props", 3, "property", "X", " ", []),
        ("deep.props", 1, "property", "X", "4", ["'$(Y)' != ''"]), ("deep.props", 2, "import", None, "B.PROPS", []), ("never.props", 1, "property", "X", "9", []), ("other", 1, "property", "Z", "$(env)", []),
    ]
    data[9] = ("b.props", 1, "property", "X", "$(x)3", ["'$(X)' == '1'"])  # a.props has set it to 2 by then
    roots = spark.createDataFrame([("p", "root"), ("q", "other"), ("none", "gone")], "project string, file string")
    files, properties = J.loaded_properties(roots, spark.createDataFrame(data, given).repartition(3), {"ENV": "e"})
    assert [(r["project"], r["file"]) for r in files.orderBy("project", "place").collect()] == [("none", "gone"), ("p", "root"), ("p", "a.props"), ("p", "b.props"), ("p", "deep.props"), ("q", "other")]
    assert rows(properties, "project", "name", "value") == [("p", "WHICH", "b"), ("p", "X", "4"), ("p", "Y", "2/y"), ("q", "Z", "e")]
