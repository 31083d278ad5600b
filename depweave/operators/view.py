"""What a view shows: filters by group and kind, searches, the explorer tree."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.columns import ci
from depweave.operators.edges import document_edges, observed
from depweave.operators.pairs import counted, places
from depweave.operators.payload import BROADCAST_NODES, among, between
from depweave.plans.staging import stage

SYMBOL_KINDS = ("symbol-reference", "symbol-call", "symbol-inheritance", "symbol-implementation", "symbol-creation")


@dataclass(frozen=True)
class View:
    """Parameters of a view; symbols are off at first, all else is on."""

    projects: bool = True
    documents: bool = True
    symbols: bool = False
    packages: bool = True
    assemblies: bool = True
    native: bool = True
    document_dependencies: bool = True
    symbol_dependencies: bool = True
    cycles_only: bool = False
    direction: str = "both"
    hidden_kinds: frozenset[str] = field(default_factory=frozenset)

    def focused(self, group: str, symbol_kind: str | None = None, in_cycle: bool = False) -> View:
        """The view in which a node of that group and kind can be seen."""
        on = {"project": "projects", "document": "documents", "symbol": "symbols", "package": "packages", "assembly": "assemblies", "dll": "native"}.get(group)
        kinds = self.hidden_kinds - {symbol_kind or "Unknown"} if group == "symbol" else self.hidden_kinds
        changes = {on: True} if on else {}
        return replace(self, **changes, hidden_kinds=kinds, cycles_only=self.cycles_only and in_cycle, document_dependencies=True, symbol_dependencies=True)


def direction(name: str | None) -> str:
    """incoming, outgoing or both; anything else is both."""
    return name if name in ("incoming", "outgoing") else "both"


def visible_nodes(nodes: DataFrame, view: View, hidden: DataFrame | None = None) -> DataFrame:
    """Nodes that the view shows; ``hidden`` has the ids of those that are hidden one by one."""
    off = [g for g, on in (("project", view.projects), ("document", view.documents), ("symbol", view.symbols), ("package", view.packages), ("assembly", view.assemblies), ("dll", view.native)) if not on]
    shown = nodes.where(~F.col("group").isin(off)) if off else nodes
    if view.hidden_kinds:
        shown = shown.where((F.col("group") != "symbol") | ~F.coalesce("symbol_kind", F.lit("Unknown")).isin(*view.hidden_kinds))
    if view.cycles_only:
        shown = shown.where("is_in_cycle")
    return shown if hidden is None else shown.join(hidden.select("id"), "id", "left_anti")


def visible_edges(edges: DataFrame, shown: DataFrame, view: View) -> DataFrame:
    """Edges that the view shows, between nodes that it shows."""
    off = []
    if not view.symbols:
        off.append("contains-symbol")
    if not view.document_dependencies:
        off.append("document-reference")
    if not (view.symbols and view.symbol_dependencies):
        off += SYMBOL_KINDS
    if not view.assemblies:
        off.append("project-assembly")
    if not view.native:
        off.append("project-dll")
    kept = edges.where(~F.col("kind").isin(off)) if off else edges
    if view.cycles_only:
        kept = kept.where("is_cycle_edge")
    return between(kept, shown)


def visible_document_edges(observations: DataFrame, declarations: DataFrame, shown: DataFrame, view: View) -> DataFrame:
    """Edges between documents that the view shows (``shown``: their ids); others are left out before pairs are made. Which are in cycles the caller knows."""
    edges = document_edges(among(observations, "source_document_id", shown), among(declarations, "document_id", shown), samples=False)
    return edges if view.document_dependencies else edges.limit(0)


def symbol_search(rows: DataFrame, query: str, fields: tuple[str, ...] = ("display_name", "name", "project_name", "document_name", "kind_label", "kind"), hidden: DataFrame | None = None) -> DataFrame:
    """Rows that have the query in one of the fields, whatever the case; a blank query finds all."""
    found = rows
    if query.strip():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(ci(f), F.lit(query.strip().upper())), F.lit(False))
        found = rows.where(hit)
    return found if hidden is None else found.join(hidden.select("symbol_id"), "symbol_id", "left_anti")


def graph_search(nodes: DataFrame, query: str) -> DataFrame:
    """Documents and symbols whose label has the query; nothing for a blank one."""
    q = query.strip().lower()
    rows = nodes.where(F.col("group").isin("document", "symbol"))
    return rows.where(F.contains(F.lower("label"), F.lit(q))) if q else rows.limit(0)


def search_edges(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges with ``dimmed``: false where an end is a match."""
    ids = matches.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    one = edges.join(ids.withColumnsRenamed({"_id": "source", "_hit": "_h1"}), "source", "left").join(ids.withColumnsRenamed({"_id": "target", "_hit": "_h2"}), "target", "left")
    return one.withColumn("dimmed", ~(F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False)))).drop("_h1", "_h2")


def search_document_edges(observations: DataFrame, declarations: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges between documents with ``dimmed``, see ``search_edges``; each end is looked up before pairs are made."""
    ids = stage(matches.select(F.col("id").alias("_id")).distinct(), "matches")
    ids = (F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids).withColumn("_hit", F.lit(True))
    hit = lambda rows, end, name: rows.join(ids, F.col(end) == F.col("_id"), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")
    found = counted(observed(hit(observations, "source_document_id", "_h1"), "_h1"), places(hit(declarations, "document_id", "_h2"), ["_h2"]), near=["_h1"], far=["_h2"])
    return found.where("source <> target").select("source", "target", "reference_count", (~(F.col("_h1") | F.col("_h2"))).alias("dimmed"))


def tree_filter(items: DataFrame, projects: DataFrame, query: str, workspace_name: str = "") -> DataFrame:
    """Items (``project_key, section, label``) of the explorer tree that a query leaves.

    A match of the workspace, or of a project's name or language, keeps all below it; else items
    match by their own label. Projects without a match have no rows.
    """
    q = query.strip().upper()
    if not q or q in workspace_name.upper():
        return items
    whole = projects.where(F.contains(ci("name"), F.lit(q)) | F.coalesce(F.contains(ci("language"), F.lit(q)), F.lit(False))).select("project_key").distinct().withColumn("_whole", F.lit(True))
    return items.join(whole, "project_key", "left").where(F.coalesce("_whole", F.lit(False)) | F.contains(ci("label"), F.lit(q))).drop("_whole")


def symbol_kinds(nodes: DataFrame) -> DataFrame:
    """``symbol_kind`` of all symbols, distinct and sorted; null is Unknown."""
    return nodes.where("group = 'symbol'").select(F.coalesce("symbol_kind", F.lit("Unknown")).alias("symbol_kind")).distinct().orderBy("symbol_kind")
