"""View states as JSON: read leniently, brought into form, written back, compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.columns import ColumnOrName, ci, col

#: Switches and what they are where a state does not say; sizes with default, least and most.
SWITCHES = {
    "includeProjects": True, "includeDocuments": True, "includePackages": True, "includeSymbols": False, "includeAssemblies": True, "includeNativeDependencies": True, "includeDocumentDependencies": True,
    "includeSymbolDependencies": True, "isDependencyMapMode": False, "isImpactAnalysisMode": False, "showCyclesOnly": False,
}
SIZES = {"panelWidth": (320, 220, 640), "mobilePanelHeight": (320, 180, 1600)}
DIRECTIONS = ("incoming", "outgoing")
SCHEMA = (
    ", ".join(f"{s} boolean" for s in SWITCHES) + ", dependencyMapDirection string, " + ", ".join(f"{s} int" for s in SIZES)
    + ", pinnedNodes array<struct<nodeId:string,x:double,y:double>>, hiddenNodes array<struct<nodeId:string,label:string,group:string>>"
)


def _last_of_each(nodes: Column) -> Column:
    """The last of the nodes of one id."""
    back = F.reverse(nodes)
    ids = F.transform(back, lambda n: n["nodeId"])
    return F.filter(back, lambda n, i: F.array_position(ids, n["nodeId"]) == i + 1)


def pinned_nodes(nodes: Column) -> Column:
    """Ids trimmed, blank ones and places that are not finite dropped, the last of an id kept; by id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.filter(nodes, lambda n: (F.trim(n["nodeId"]) != "") & finite(n["x"]) & finite(n["y"]))
    return F.array_sort(_last_of_each(F.transform(good, lambda n: F.struct(F.trim(n["nodeId"]).alias("nodeId"), n["x"].alias("x"), n["y"].alias("y")))))


def hidden_nodes(nodes: Column) -> Column:
    """Ids trimmed, blank ones dropped, a blank label is the id, a blank group empty, the last of an id kept; by label whatever the case, then by id."""
    said = lambda x: F.nullif(F.trim(x), F.lit(""))
    good = F.transform(F.filter(nodes, lambda n: F.trim(n["nodeId"]) != ""), lambda n: F.struct(
        F.trim(n["nodeId"]).alias("nodeId"), F.coalesce(said(n["label"]), F.trim(n["nodeId"])).alias("label"), F.coalesce(said(n["group"]), F.lit("")).alias("group")))
    keyed = F.array_sort(F.transform(_last_of_each(good), lambda n: F.struct(ci(n["label"]).alias("k"), n["nodeId"].alias("i"), n.alias("node"))))
    return F.transform(keyed, lambda n: n["node"])


def normalized(json: ColumnOrName) -> Column:
    """A state from its JSON, every field there: null or broken JSON is the default state.

    Sizes that are missing or not positive are the default, all are kept within their bounds; a
    direction that is neither incoming nor outgoing, whatever the case, is both.
    """
    s = F.from_json(col(json), SCHEMA)
    fields = [F.coalesce(s[n], F.lit(default)).alias(n) for n, default in SWITCHES.items()]
    direction = F.lower(s["dependencyMapDirection"])
    fields.append(F.when(direction.isin(*DIRECTIONS), direction).otherwise(F.lit("both")).alias("dependencyMapDirection"))
    for n, (default, least, most) in SIZES.items():
        fields.append(F.least(F.lit(most), F.greatest(F.lit(least), F.when(s[n] > 0, s[n]).otherwise(default))).alias(n))
    none = lambda kind: F.array().cast(kind)
    fields.append(F.coalesce(pinned_nodes(s["pinnedNodes"]), none("array<struct<nodeId:string,x:double,y:double>>")).alias("pinnedNodes"))
    fields.append(F.coalesce(hidden_nodes(s["hiddenNodes"]), none("array<struct<nodeId:string,label:string,group:string>>")).alias("hiddenNodes"))
    return F.struct(*fields)


def exported(states: DataFrame, state: str = "state", out: str = "json") -> DataFrame:
    """states with ``out``, the JSON of each normalized state; importing it gives the state again."""
    return states.withColumn(out, F.to_json(F.col(state)))


def imported(states: DataFrame, json: str = "json", out: str = "state") -> DataFrame:
    return states.withColumn(out, normalized(json))


def changed(before: ColumnOrName, after: ColumnOrName) -> Column:
    """Whether two normalized states differ in anything."""
    return ~F.to_json(col(before)).eqNullSafe(F.to_json(col(after)))
