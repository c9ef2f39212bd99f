"""Replacing a document's rows in the store."""

from chronoweave.sources.store import Store


def test_replace_by_nothing_empties_the_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.init()
    row = lambda d, i: (d, i, 1, 2, 1, "POTENTIAL_GAP", 0.5, [])
    schema = store.read("gaps").schema
    make = lambda rows: spark.createDataFrame(rows, schema)
    store.replace("gaps", make([row("a", "g1"), row("b", "g2"), row("c", "g3")]))
    store.replace("gaps", make([]), spark.createDataFrame([("a",)], "doc_id string"))
    assert {r.doc_id for r in store.read("gaps").collect()} == {"b", "c"} and store.get("gaps", "a").count() == 0
    store.replace("gaps", make([row("b", "g4"), row("b", "g5")]))
    assert sorted((r.doc_id, r.id) for r in store.read("gaps").collect()) == [("b", "g4"), ("b", "g5"), ("c", "g3")]
