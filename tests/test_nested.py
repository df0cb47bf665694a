"""JSON at any depth against plain recursion."""

import json
import random

import pytest

from sparkloom.functions import nested
from sparkloom.operators import taxonomy


def walk(v, path=()):
    if isinstance(v, dict):
        for k in sorted(v):
            yield from walk(v[k], (*path, k))
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield from walk(x, (*path, f"[{k}]"))
    else:
        yield path, v


def made(rng, depth):
    kind = rng.choice("dls" if depth else "s")
    if kind == "d":
        return {rng.choice("abcdef") * rng.randint(1, 2): made(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if kind == "l":
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 3, -2.5, "text é", '{"no": "json"}', "", "[1]"])


def test_leaves_against_recursion(spark):
    rng = random.Random(6)
    docs = [made(rng, 7) for _ in range(60)] + [{}, [], 5, "bare", {"a": {"a": {"a": {"a": {"a": {"a": {"a": {"a": [[[[1]]]]}}}}}}}}]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, None), (901, "{broken"), (902, "")], "id int, j string")
    got = {}
    for r in nested.leaves(rows, "j").selectExpr("id", "path", "place", "CASE WHEN kind = 'VOID' THEN NULL ELSE to_json(value) END AS v").collect():
        got.setdefault(r.id, []).append((tuple(r.place), tuple(r.path), None if r.v is None else json.loads(r.v)))
    want = {k: [(p, v) for p, v in walk(d)] for k, d in enumerate(docs)}
    assert {k: [x[1:] for x in sorted(v, key=lambda x: x[0])] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_flattened_and_numbers(spark):
    rows = spark.createDataFrame([(1, '{"b": {"x": 1, "y": [2.5, "t"]}, "a": null}'), (2, "{}"), (3, None)], "id int, j string")
    assert {r.id: r.text for r in nested.flattened(rows, "id", "j").collect()} == {1: "none 1 2.5 t"}
    assert sorted((r.name, r.value) for r in nested.numbers(rows, "j").collect()) == [("b_x", 1.0), ("b_y_0", 2.5)]
    with pytest.raises(ValueError, match="taken"):
        nested.leaves(rows.withColumnRenamed("id", "path"), "j")


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_texts_stay_in_their_rows(spark, monkeypatch, levels):
    """The values of JSON of any depth in order, as leaves give them, with nothing shuffled."""
    monkeypatch.setattr(nested, "LEVELS", levels)
    rng = random.Random(9)
    docs = [made(rng, 8) for _ in range(150)] + [{}, [], 5, "bare", "", None, [[[[[[[[["deep"]]]]]]]]], {"b": 1e20, "a": [0.10, 12345678901234567890123, 2.0]}]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, None), (901, "{broken"), (902, "")], "id int, j string")
    want = {}
    for r in nested.leaves(rows, "j").select("id", "place", nested.text_of(nested.F.col("value"), nested.F.col("kind")).alias("t")).collect():
        want.setdefault(r.id, []).append((r.place, r.t))
    out = nested.texts(rows, "j")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.text for r in out.collect()} == {k: None for k in [*range(len(docs)), 900, 901, 902]} | {k: " ".join(t for _, t in sorted(v, key=lambda x: x[0])) for k, v in want.items()}
    assert {r.id for r in nested.flattened(rows, "id", "j").collect()} == set(want)


def test_trees_of_any_depth(spark):
    tree = {"name": "n0", "children": []}
    at = tree
    for k in range(1, 12):
        at["children"] = [{"name": f"n{k}", "confidence_threshold": 0.1 * k, "merged_from": ["x"]}, {}]
        at = at["children"][0]
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps({"taxonomy": {"name": "w"}})), (3, "{broken")], "id int, taxonomy string")
    nodes = taxonomy.nodes_of(rows).collect()
    deepest = max(nodes, key=lambda r: (r.depth, r.name != "Unknown"))
    assert len(nodes) == 24 and deepest.path.count(taxonomy.ARROW) == 11 and deepest.ord == [0] * 11 and deepest.merged_from == ["x"]
    assert sum(r.name == "Unknown" and r.confidence_threshold == 0.5 and r.source == "unknown" for r in nodes) == 11
    assert [(r.path, r.depth) for r in nodes if r.id == 2] == [("w", 0)]
