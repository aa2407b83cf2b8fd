"""JSON-LD blocks as rows of variants."""

from pyspark.sql import functions as F

from webloom.operators import structured

BLOCKS = [
    ("a", ['{"@context":"https://schema.org","@type":["Shop","Thing"],"name":"x"}', "bad", '[{"@type":"A"},{"@type":"B","@id":"#b"}, 5]']),
    ("b", ['{"@context":["c1","c2"],"@graph":[{"@type":"G","price":5},{"@type":"H","@context":"own"},null,7]}', "null", '{"name":1}', '"text"', ""]),
    ("c", []),
    ("d", None),
    ("e", [None, "[" * 2000]),
]


def test_nodes_of_blocks_lists_and_graphs(spark):
    found = structured.nodes(spark.createDataFrame(BLOCKS, "url string, json_ld array<string>"))
    rows = sorted((r["url"], r["block"], tuple(r["node"]), r["node_id"], r["types"], r["contexts"], sorted(r["fields"])) for r in found.drop("data").collect())
    assert rows == [
        ("a", 0, (0, 0), None, ["Shop", "Thing"], ["https://schema.org"], ["@context", "@type", "name"]),
        ("a", 2, (0, 0), None, ["A"], [], ["@type"]),
        ("a", 2, (1, 0), "#b", ["B"], [], ["@id", "@type"]),
        ("b", 0, (0, 0), None, [], ["c1", "c2"], ["@context", "@graph"]),
        ("b", 0, (0, 1), None, ["G"], ["c1", "c2"], ["@type", "price"]),
        ("b", 0, (0, 2), None, ["H"], ["own"], ["@context", "@type"]),
        ("b", 2, (0, 0), None, [], [], ["name"]),
    ]
    price = found.select(F.try_variant_get("data", "$.price", "int").alias("p")).filter("p is not null").collect()
    assert [r["p"] for r in price] == [5]
    assert {tuple(r) for r in structured.type_counts(found).collect()} == {(t, 1, 1) for t in ("Shop", "Thing", "A", "B", "G", "H")}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
