import pytest

from engramlake.store import GraphStore

N = "brain_id string, id string, content string"
S = "brain_id string, id string, source_id string, target_id string"
F_ = "brain_id string, id string, synapse_ids array<string>"


def test_versions_cascades_and_rollback(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read("neurons")
    store.upsert("neurons", spark.createDataFrame([("b", "x", "1"), ("b", "y", None), ("c", "z", "3")], N))
    store.write("synapses", spark.createDataFrame([("b", "s1", "x", "y"), ("b", "s2", "y", "y")], S))
    store.write("fibers", spark.createDataFrame([("b", "f1", ["s2", None, "s1"]), ("b", "f2", None)], F_))
    store.upsert("neurons", spark.createDataFrame([("b", "x", "new"), ("b", "w", "4")], N))
    assert {(r.id, r.content) for r in store.read("neurons").collect()} == {("x", "new"), ("y", None), ("z", "3"), ("w", "4")}
    assert {r.id for r in store.read("neurons", brain="c").collect()} == {"z"}
    store.update("neurons", spark.createDataFrame([("y", "2"), ("none", "q")], "id string, content string"))
    store.delete("neurons", spark.createDataFrame([("x",)], "id string"))
    assert {r.id for r in store.read("synapses").collect()} == {"s2"}
    assert {r.id: r.synapse_ids for r in store.read("fibers").collect()} == {"f1": ["s2", None], "f2": None}
    assert {(r.id, r.content) for r in store.read("neurons").collect()} == {("y", "2"), ("z", "3"), ("w", "4")}
    store.rollback("neurons", 1)
    assert store.read("neurons").count() == 3
    store.transplant("c", "d")
    assert {r.id for r in store.read("neurons", brain="d").collect()} == {"d:z"}
