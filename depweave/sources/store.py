"""Snapshots as Parquet below one path, committed through a log of manifests.

A snapshot's tables are written to a folder of their own first. A manifest then lists every
snapshot that is kept, with its folder; it counts from the moment its commit file exists, which is
created under the next number and must not exist before. Readers take the last complete commit.
Whatever was written without one is never seen, and nothing that the last manifest lists is
deleted, so a writer may stop after any step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.columns import ci
from depweave.functions.ids import document_id
from depweave.operators.ranked import retained

#: The present format, snapshots kept of a workspace, and the order in which each table is read.
FORMAT, KEEP = 5, 20
ORDERS = {
    "projects": ["project_name", "project_key"],
    "documents": ["project_name", "project_key", "document_name", "document_file_path"],
    "symbols": ["project_name", "project_key", "document_name", "line_number", "display_name"],
    "dependencies": ["project_name", "project_key", "dependency_kind", "dependency_name"],
    "document_dependencies": ["source_document_id", "target_document_id"],
    "symbol_dependencies": ["source_symbol_id", "target_symbol_id"],
    "cycles": ["cycle_id"],
    "cycle_nodes": ["cycle_id", "sort_order"],
    "diagnostics": ["ordinal"],
}
#: Columns that older writers left out, with what stands for them.
_SAMPLE = {"sample_file_path": "CAST(NULL AS STRING)", "sample_line_number": "CAST(NULL AS INT)", "sample_snippet": "CAST(NULL AS STRING)"}
MISSING = {
    "symbols": {"project_key": "project_name", "document_id": "CAST(NULL AS STRING)", "document_file_path": "CAST(NULL AS STRING)", "display_name": "symbol_name"},
    "dependencies": {"dependency_origin": "CAST(NULL AS STRING)", "confidence": "CAST(NULL AS STRING)", "imported_symbols": "CAST(NULL AS STRING)"},
    "document_dependencies": _SAMPLE,
    "symbol_dependencies": {"reference_kind": "'reference'", "confidence": "'high'", **_SAMPLE},
}
#: What a null of a column stands for.
FILLED = {"symbol_dependencies": {"reference_kind": "reference", "confidence": "high"}}
MANIFEST = "workspace string, snapshot_id long, format_version int, analyzed_at timestamp, project_count long, document_count long, symbol_count long, folder string"


def legacy_documents(symbols: DataFrame) -> DataFrame:
    """The documents of a snapshot that has symbols only: those that the symbols name, ordered whatever the case."""
    return symbols.select("project_key", "project_name", "document_id", "document_name", "document_file_path").distinct().orderBy(ci("project_name"), "project_key", ci("document_name"), ci("document_file_path"))


class SnapshotStore:
    """Saves and loads snapshots of workspaces; several writers may save at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._to_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._to_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _files(self, below: str) -> list[str]:
        """Names of what a folder holds; none if it does not exist. Any other failure is raised."""
        folder = self._to_path(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _delete(self, name: str) -> None:
        self._fs.delete(self._to_path(f"{self.path}/{name}"), True)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._to_path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, said: str) -> bool:
        """Writes a small file that must not exist; False if it does."""
        to = self._to_path(f"{self.path}/{name}")
        if self._fs.exists(to):
            return False
        try:
            out = self._fs.create(to, False)
        except Exception as failed:  # another writer was first
            if self._fs.exists(to):
                return False
            raise failed
        out.write(bytearray(said.encode()))
        out.close()
        return True

    # The log

    def _last(self) -> tuple[int, int, str | None]:
        """The greatest number of a commit, complete or not; the last complete one and its folder (0 and None before the first)."""
        numbers = [int(n.removesuffix(".json")) for n in self._files("log") if n.endswith(".json") and not n.startswith((".", "_"))]
        for number in sorted(numbers, reverse=True):
            said = self._read(f"log/{number:012d}.json")
            if said and said.endswith("\n"):  # a writer that stopped half-way left no end of line
                return max(numbers), number, json.loads(said)["manifest"]
        return max(numbers, default=0), 0, None

    def _manifest(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{folder}")

    def manifest(self) -> DataFrame:
        """A row for each snapshot that can be loaded."""
        return self._manifest(self._last()[2])

    def _commit(self, change) -> DataFrame:
        """Commits what ``change`` makes of the last manifest, again on the next one if another writer was first; returns it."""
        while True:
            greatest, _, folder = self._last()
            name = f"manifests/{uuid.uuid4().hex}"
            change(self._manifest(folder)).coalesce(1).write.parquet(f"{self.path}/{name}")
            if self._create(f"log/{greatest + 1:012d}.json", json.dumps({"manifest": name}) + "\n"):
                return self._manifest(name)
            self._delete(name)

    # Snapshots

    @staticmethod
    def workspace_key(workspace: str | None) -> str | None:
        """The workspace's path without blanks around it and separators after it; None for a blank one."""
        w = (workspace or "").strip()
        return (w.rstrip("/\\") or w) if w else None

    def save(self, workspace: str, tables: dict[str, DataFrame], analyzed_at: str | None = None) -> int:
        """Writes all tables, commits them as one snapshot, and drops what is no longer kept. Returns the snapshot's id."""
        key = self.workspace_key(workspace)
        if key is None:
            raise ValueError("a workspace needs a path")
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        count = lambda name: self.spark.read.parquet(f"{self.path}/{folder}/{name}").count() if name in tables else 0
        counts = {f"{n}_count": count(f"{n}s") for n in ("project", "document", "symbol")}
        at = F.to_timestamp(F.lit(analyzed_at)) if analyzed_at else F.current_timestamp()

        def change(now: DataFrame) -> DataFrame:
            new = now.agg((F.coalesce(F.max("snapshot_id"), F.lit(0)) + 1).alias("snapshot_id")).select(
                F.lit(key).alias("workspace"), "snapshot_id", F.lit(FORMAT).alias("format_version"), at.alias("analyzed_at"),
                *(F.lit(n).cast("long").alias(c) for c, n in counts.items()), F.lit(folder).alias("folder"),
            )
            return retained(now.unionByName(new), "workspace", "snapshot_id", KEEP).select(*now.columns)

        kept = self._commit(change)
        number = kept.where(F.col("folder") == folder).first()["snapshot_id"]
        self.vacuum(committed=kept)
        return number

    def vacuum(self, committed: DataFrame | None = None, unseen: bool = False) -> None:
        """Deletes the folders of snapshots that earlier manifests list and the last one does not, and all but two manifests.

        With ``unseen`` also what no manifest ever listed, which writers that stopped have left; then
        no writer may be at work.
        """
        _, number, folder = self._last()
        if folder is None:
            return
        committed = self._manifest(folder) if committed is None else committed
        logs = [n for n in self._files("log") if n.endswith(".json") and int(n.removesuffix(".json")) < number]
        older = [(n, said) for n in logs if (said := self._read(f"log/{n}")) and said.endswith("\n")]
        kept = {r["folder"] for r in committed.select("folder").toLocalIterator()} | {r["folder"] for r in self._manifest(folder).select("folder").toLocalIterator()}
        for k, (n, said) in enumerate(older):
            name = json.loads(said)["manifest"]
            if self._fs.exists(self._to_path(f"{self.path}/{name}")):
                for r in self._manifest(name).select("folder").toLocalIterator():
                    if r["folder"] not in kept:
                        self._delete(r["folder"])
                if k + 1 < len(older):
                    self._delete(name)
            if k + 1 < len(older):
                self._delete(f"log/{n}")
        if unseen:
            for n in self._files("data"):
                if f"data/{n}" not in kept:
                    self._delete(f"data/{n}")
            named = {folder, *(json.loads(said)["manifest"] for _, said in older)}
            for n in self._files("manifests"):
                if f"manifests/{n}" not in named:
                    self._delete(f"manifests/{n}")

    def _found(self, workspace: str | None):
        key = self.workspace_key(workspace)
        if key is None:
            return None
        rows = self.manifest().where((F.col("workspace") == key) & (F.col("format_version") == FORMAT))
        return rows.agg(F.max_by(F.struct("snapshot_id", "folder"), "snapshot_id").alias("r")).first()["r"]

    def latest(self, workspace: str | None) -> int | None:
        """The last snapshot of a workspace in the present format; None if there is none."""
        found = self._found(workspace)
        return found["snapshot_id"] if found else None

    def load(self, workspace: str | None, name: str, order: list[str] | None = None, columns: dict[str, str] | None = None) -> DataFrame | None:
        """A table of the last snapshot in its documented order, or in ``order``; None without a snapshot or without the table.

        Columns that an older writer left out are there: a project's name is its key, a symbol's name
        is shown, samples are null; so are further ``columns`` (name: type). Documents that were not
        stored are those that the symbols name.
        """
        found = self._found(workspace)
        if not found:
            return None
        if not self._fs.exists(self._to_path(f"{self.path}/{found['folder']}/{name}")):
            if name != "documents":
                return None
            symbols = self.load(workspace, "symbols")
            return None if symbols is None else legacy_documents(symbols)
        df = projected(self.spark.read.parquet(f"{self.path}/{found['folder']}/{name}"), name)
        df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in (columns or {}).items() if c not in df.columns})
        order = order or [c for c in ORDERS.get(name, []) if c in df.columns]
        return df.orderBy(*order) if order else df

    def clear(self) -> None:
        """Forgets all snapshots: the log goes first, so nothing that it lists is gone while it is read."""
        for n in ("log", "manifests", "data"):
            self._delete(n)
        self._fs.delete(self._to_path(self.path), True)


def projected(df: DataFrame, name: str) -> DataFrame:
    """A stored table with the columns of the present format."""
    for c, stands in MISSING.get(name, {}).items():
        if c not in df.columns:
            df = df.withColumn(c, F.expr(stands))
    if name == "symbols":
        df = df.withColumn("document_id", F.coalesce("document_id", document_id("project_name", "document_file_path", "document_name")))
    for c, value in FILLED.get(name, {}).items():
        df = df.withColumn(c, F.coalesce(c, F.lit(value)))
    return df


def hydrated(projects: DataFrame, documents: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row for each project with its documents and, by kind, its dependencies as sorted arrays; documents carry their number of symbols."""
    counts = symbols.groupBy("document_id").agg(F.count("*").alias("symbol_count"))
    docs = documents.join(counts, "document_id", "left").groupBy("project_key").agg(F.array_sort(F.collect_list(F.struct("document_id", "name", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count")))).alias("documents"))
    deps = dependencies.groupBy("project_key").agg(F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("dependencies"))
    return projects.join(docs, "project_key", "left").join(deps, "project_key", "left")
