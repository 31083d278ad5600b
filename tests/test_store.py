"""The snapshot log: nothing is lost wherever a writer stops, old formats are read, and tables come in their order."""

import pytest
from pyspark.sql import functions as F

from depweave.sources.store import ORDERS, SnapshotStore


class Stops(SnapshotStore):
    """A store whose writer stops before its n-th change of the files."""

    def __init__(self, spark, path, before):
        super().__init__(spark, path)
        self.left = before

    def _step(self):
        if self.left == 0:
            raise RuntimeError("stopped")
        self.left -= 1

    def _create(self, name, said):
        self._step()
        if self.left == 0 and said.endswith("\n"):
            super()._create(name, said[:5])  # the file is there, half of it
            raise RuntimeError("stopped")
        return super()._create(name, said)

    def _delete(self, name):
        self._step()
        super()._delete(name)

    def _commit(self, change):
        self._step()
        return super()._commit(change)


def one(spark, said):
    return {"diagnostics": spark.createDataFrame([(1, said)], "ordinal int, message string"), "projects": spark.createDataFrame([("k", said)], "project_key string, project_name string")}


def said(store, workspace="/w"):
    found = [r["message"] for r in store.load(workspace, "diagnostics").collect()]
    assert found == [r["project_name"] for r in store.load(workspace, "projects").collect()]  # both tables or neither
    return found[0]


def test_a_writer_may_stop_between_any_two_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("depweave.sources.store.KEEP", 2)  # so that old snapshots are dropped as well
    path = f"file://{tmp_path}/s"
    store = SnapshotStore(spark, path)
    store.save("/other", one(spark, "other"))
    for k in range(3):
        store.save("/w", one(spark, f"v{k}"))
    stopped = 0
    for before in range(12):
        last = said(store)
        try:
            Stops(spark, path, before).save("/w", one(spark, f"stop{before}"))
        except RuntimeError:
            stopped += 1
        assert said(store) in (last, f"stop{before}") and said(store, "/other") == "other"
        assert store.manifest().where("workspace = '/w'").count() == 2
    assert stopped >= 3
    number = store.save("/w", one(spark, "after"))
    assert said(store) == "after" and store.latest("/w") == number
    store.vacuum(unseen=True)
    assert said(store) == "after" and said(store, "/other") == "other"
    assert len(store._files("data")) == 3 and len(store._files("manifests")) <= 2


def test_two_writers_and_a_broken_commit(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = SnapshotStore(spark, path), SnapshotStore(spark, path)
    real, done = a._create, []

    def create(name, text):
        if not done:  # b commits in between, under the number that a was about to take
            done.append(b.save("/w", one(spark, "b")))
        return real(name, text)

    a._create = create
    assert (a.save("/w", one(spark, "a")), done) == (2, [1]) and said(b) == "a"
    assert b._create(f"log/{99:012d}.json", '{"manif') and said(a) == "a"
    assert a.save("/w", one(spark, "c")) == 3 and said(b) == "c" and "000000000100.json" in a._files("log")
    a.clear()
    assert a.latest("/w") is None and a.manifest().count() == 0


def test_another_failure_is_not_an_empty_store(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "000000000001.json").write_text('{"manifest": "manifests/gone"}\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND|gone"):
        SnapshotStore(spark, f"file://{tmp_path}").save("/w", one(spark, "x"))


def test_formats_before_this_one(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    symbols = spark.createDataFrame([("s1", "b", "x.cs", "Class", "B", 9), ("s2", "A", "y.cs", "Class", "Z", 1), ("s3", "A", "y.cs", "Class", "Y", 1), ("s4", "A", "Y.cs", "Class", "C", 4)],
                                    "symbol_id string, project_name string, document_name string, symbol_kind string, symbol_name string, line_number int")
    edges = spark.createDataFrame([("s1", "s2", 3, None)], "source_symbol_id string, target_symbol_id string, reference_count int, reference_kind string")
    store.save("/w", {"symbols": symbols, "symbol_dependencies": edges})
    got = store.load("/w", "symbols").collect()
    assert [(r["symbol_id"], r["project_key"], r["display_name"], r["document_file_path"]) for r in got] == [("s4", "A", "C", None), ("s3", "A", "Y", None), ("s2", "A", "Z", None), ("s1", "b", "B", None)]
    assert got[0]["document_id"].startswith("document:a_y_cs_") and len({r["document_id"] for r in got}) == 3
    documents = store.load("/w", "documents").collect()
    assert [(r["project_name"], r["document_name"].lower()) for r in documents] == [("A", "y.cs"), ("A", "y.cs"), ("b", "x.cs")]
    edge = store.load("/w", "symbol_dependencies").first()
    assert (edge["reference_kind"], edge["confidence"], edge["sample_snippet"]) == ("reference", "high", None)
    assert store.load("/w", "cycles") is None


def test_nine_orders(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    tables = {}
    for name, order in ORDERS.items():
        # Every place of the order decides once, as the columns before it are equal.
        rows = [tuple((k * 7 + d * 3) % 5 if c <= d else 0 for c in range(len(order))) for d in range(len(order)) for k in range(5)]
        tables[name] = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in order)).repartition(3)
        if name == "symbols":
            tables[name] = tables[name].withColumns({"symbol_name": F.lit("s"), "document_id": F.lit("d"), "project_name": F.col("project_name").cast("string"), "document_name": F.col("document_name").cast("string")})
    store.save("/w", tables)
    for name, order in ORDERS.items():
        got = [tuple(r) for r in store.load("/w", name).select(*order).collect()]
        assert len(got) == 5 * len(order) and got == sorted(got), name
