"""Taxonomies as tables of nodes.

Spark has no recursive types, so a tree is one row per node: path (names joined by
an arrow), name, depth and what else is known. Paths answer most tree questions by
comparing them; nothing is collected to walk a tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept

ARROW = " → "


def parts(path: Column) -> Column:
    return F.split(path, ARROW)


def parent(path: Column) -> Column:
    """The path above; null for roots."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), ARROW))


def nodes(tree: dict) -> Iterator[tuple]:
    """Rows of a nested taxonomy: path, ord, name, description, confidence_threshold, source, merged_from."""

    def walk(node: dict, above: tuple[str, ...], ords: tuple[int, ...]):
        if not isinstance(node, dict) or not node.get("name"):
            raise ValueError("every node needs a name")
        children = node.get("children") or []
        if not isinstance(children, list):
            raise ValueError("children must be a list")
        path = (*above, node["name"])
        threshold = node.get("confidence_threshold")
        yield ARROW.join(path), list(ords), node["name"], len(ords), node.get("description"), None if threshold is None else float(threshold), node.get("source"), list(node.get("merged_from") or [])
        for k, c in enumerate(children):
            yield from walk(c, path, (*ords, k))

    yield from walk(tree, (), ())


NODE = "path string, ord array<int>, name string, depth int, description string, confidence_threshold double, source string, merged_from array<string>"


def load(spark: SparkSession, text: str | dict) -> DataFrame:
    """Nodes of one taxonomy given as JSON, plain or wrapped in ``taxonomy``; a tree is small by nature."""
    tree = json.loads(text) if isinstance(text, str) else text
    return spark.createDataFrame(list(nodes(tree.get("taxonomy", tree))), NODE)


def nodes_of(trees: DataFrame, content: str = "taxonomy") -> DataFrame:
    """The rows' other columns with the nodes of their trees as JSON, at any depth, a level after another.

    A tree may be wrapped in ``taxonomy``. Missing names are ``Unknown``, thresholds 0.5, sources ``unknown``.
    """
    rest = [c for c in trees.columns if c != content]
    get = lambda v, p, t: F.try_variant_get(v, p, t)

    def named(v: Column, above: Column, ordinals: Column) -> list[Column]:
        name = F.coalesce(get(v, "$.name", "string"), F.lit("Unknown"))
        return [
            *rest, F.when(above == "", name).otherwise(F.concat(above, F.lit(ARROW), name)).alias("path"), ordinals.alias("ord"), name.alias("name"), get(v, "$.description", "string").alias("description"),
            F.coalesce(get(v, "$.confidence_threshold", "double"), F.lit(0.5)).alias("confidence_threshold"), F.coalesce(get(v, "$.source", "string"), F.lit("unknown")).alias("source"),
            F.coalesce(get(v, "$.merged_from", "array<string>"), F.array().cast("array<string>")).alias("merged_from"), get(v, "$.children", "variant").alias("_children"),
        ]

    whole = F.try_parse_json(F.col(content).cast("string"))
    tops = trees.select(*rest, F.coalesce(get(whole, "$.taxonomy", "variant"), whole).alias("_v")).where("_v IS NOT NULL")
    level, found = kept(tops.select(*named(F.col("_v"), F.lit(""), F.array().cast("array<int>")))), []
    while True:
        found.append(level)
        below = level.where("_children IS NOT NULL").select(*rest, F.col("path").alias("_above"), F.col("ord").alias("_ord"), "_children")
        each = below.lateralJoin(trees.sparkSession.tvf.variant_explode(F.col("_children").outer()))
        level = kept(each.select(*named(F.col("value"), F.col("_above"), F.concat("_ord", F.array("pos")))))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).withColumn("depth", F.size("ord")).drop("_children")


def merge_raw(primary: DataFrame, secondary: DataFrame, label: str = "refinement") -> DataFrame:
    """Nodes of two trees given as JSON, one row each, merged by path."""
    return merge(nodes_of(primary).drop("merged_from"), nodes_of(secondary).drop("merged_from"), label)


def marked(tree: DataFrame, source: str) -> DataFrame:
    """``tree`` whose nodes say where they come from, unless they do already."""
    own = F.coalesce("source", F.lit(source)) if "source" in tree.columns else F.lit(source)
    return tree.withColumn("source", own)


def to_dict(tree: DataFrame) -> list[dict]:
    """The roots of a tree as nested dictionaries, children in the order of their names; a tree is small by nature."""
    found: dict[str, dict] = {}
    roots = []
    for row in sorted(tree.collect(), key=lambda r: r["path"].split(ARROW)):
        node = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("path", "ord", "depth", "parent_key") and v is not None} | {"children": []}
        found[row["path"]] = node
        above = found.get(row["path"].rpartition(ARROW)[0])
        (roots if above is None else above["children"]).append(node)
    return roots


def levels(tree: DataFrame) -> DataFrame:
    """Nodes and mean threshold per depth."""
    return tree.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.avg("confidence_threshold").alias("avg_threshold"))


def analytics(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), F.avg("confidence_threshold").alias("avg_threshold"))


def duplicates(tree: DataFrame) -> DataFrame:
    """Names that more than one node has."""
    return tree.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def problems(tree: DataFrame, deepest: int = 5) -> DataFrame:
    """path and problem of nodes without a name, too deep, or whose parent is not there."""
    wrong = tree.select("path", F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.col("depth") > deepest, "too deep").alias("problem")).where("problem IS NOT NULL")
    above = tree.select(F.col("path").alias("_above")).distinct()
    orphan = tree.withColumn("_parent", parent(F.col("path"))).where("_parent IS NOT NULL").join(above, F.col("_parent") == F.col("_above"), "left_anti")
    return wrong.unionByName(orphan.select("path", F.lit("no parent").alias("problem")))


def preorder(tree: DataFrame) -> DataFrame:
    """``tree`` with position, from 1: paths in order of their names, parents first.

    One tree is one sequence; it is numbered in one task, since it is small.
    """
    return tree.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(parts(F.col("path")))))


def confidence(tree: DataFrame, default: float = 0.7, floor: float = 0.1, positive_only: bool = True) -> DataFrame:
    """Mean threshold with weights that fall along the preorder, from 2 to 1."""
    valid = tree.where(F.col("confidence_threshold").isNotNull() & ((F.col("confidence_threshold") > 0) | F.lit(not positive_only)))
    weight = F.greatest(F.lit(1.0), F.lit(2.0) - (F.col("position") - 1) * F.lit(0.1))
    mean = F.sum(F.col("confidence_threshold") * weight) / F.sum(weight)
    return preorder(valid).agg(F.greatest(F.round(F.coalesce(mean, F.lit(default)), 3), F.lit(floor)).alias("confidence"))


def merge(primary: DataFrame, secondary: DataFrame, label: str = "secondary") -> DataFrame:
    """Nodes of both by path: the primary's values first, the higher threshold, where merged from."""
    side = lambda t: t.select("path", "name", "depth", "confidence_threshold", *[(F.col(c) if c in t.columns else F.lit(None).cast("string")).alias(c) for c in ("description", "source")])
    a, b = side(primary).alias("a"), side(secondary).alias("b")
    both = F.col("a.path").isNotNull() & F.col("b.path").isNotNull()
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("path", "name", "depth")],
        F.coalesce(F.nullif("a.description", F.lit("")), "b.description").alias("description"),
        F.greatest("a.confidence_threshold", "b.confidence_threshold").alias("confidence_threshold"),
        F.when(both, "merged").when(F.col("a.path").isNotNull(), F.coalesce("a.source", F.lit("primary"))).otherwise(F.coalesce("b.source", F.lit(label))).alias("source"),
        F.when(both, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")).alias("merged_from"),
    )


def ancestors(selected: DataFrame) -> DataFrame:
    """Selected paths and all paths above them, each once."""
    p = parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, F.lit(1), k), ARROW))
    return selected.select(F.explode(above).alias("path")).distinct()


def trim(tree: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The first ``limits[depth]`` children of each node, in name order, without what hangs below dropped nodes."""
    above = F.coalesce(parent(F.col("path")), F.lit(""))
    rank = F.row_number().over(Window.partitionBy("_above").orderBy("name"))
    limit = F.coalesce(F.try_element_at(F.array(*map(F.lit, limits)), F.col("depth") + 1), F.lit(2**31 - 1))
    numbered = tree.withColumn("_above", above).withColumn("_keep", rank <= limit).drop("_above")
    dropped = numbered.where("NOT _keep").select(F.col("path").alias("_dropped"))
    below = numbered.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts(F.col("path")))), lambda k: F.array_join(F.slice(parts(F.col("path")), F.lit(1), k), ARROW))).alias("_dropped"))
    gone = below.join(dropped, "_dropped", "left_semi").select("path").distinct()
    return numbered.drop("_keep").join(gone, "path", "left_anti")


def ids(tree: DataFrame, project: str) -> DataFrame:
    """path with a dotted id of ordinals and the id without dots that some data uses."""
    above = F.coalesce(parent(F.col("path")), F.lit(""))
    own = tree.withColumn("_o", F.row_number().over(Window.partitionBy(above).orderBy("name")) - 1)
    steps = own.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts(F.col("path")))), lambda k: F.array_join(F.slice(parts(F.col("path")), F.lit(1), k), ARROW))).alias("_k", "_at"))
    found = steps.join(own.select(F.col("path").alias("_at"), "_o"), "_at").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_k", "_o"))).alias("s"))
    text = F.transform("s", lambda x: x["_o"].cast("string"))
    return found.select("path", F.concat(F.lit(f"{project}."), F.array_join(text, ".")).alias("node_id"), F.concat(F.lit(project), F.array_join(text, "")).alias("legacy_id"))


def resolve(tree: DataFrame, index_path: str) -> DataFrame:
    """The node at an index path such as ``cat_0_1`` or ``0_1``, ordinals in name order."""
    want = ".".join(x for x in index_path.split("_") if x.isdigit())
    return tree.join(ids(tree, "x").where(F.col("node_id") == f"x.{want}").select("path"), "path", "left_semi")


def resolve_all(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (a path as text) and path of the nodes that paths name; what names no node is left out.

    ``cat_0_1`` and ``0_1`` are ordinals in name order below the root; others are names
    parted by dots, from the root or from below it. The tree has one root.
    """
    w = F.col("wanted")
    bare = F.regexp_replace(w, "^cat_", "")
    by_index = bare.rlike(r"^\d+(_\d+)*$")
    steps = F.filter(F.transform(F.split(w, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    asked = wanted.select("wanted").distinct().where(F.trim(w) != "")
    asked = asked.select("wanted", F.when(by_index, F.array_join(F.transform(F.split(bare, "_"), lambda x: x.cast("bigint").cast("string")), ".")).alias("ordinals"), F.when(~by_index, F.array_join(steps, ARROW)).alias("names"))
    nodes = ids(tree, "x").select("path", F.regexp_replace("node_id", r"^x\.0\.?", "").alias("ordinals"), parts(F.col("path")).alias("p"))
    below = F.when(F.size("p") > 1, F.array_join(F.slice("p", 2, F.size("p")), ARROW))
    named = nodes.select("path", F.explode(F.array_compact(F.array(F.col("path"), below))).alias("names"), (F.size("p")).alias("n"))
    numbered = nodes.where("ordinals <> ''").select("path", "ordinals")
    # a name that starts at the root goes before the same one below it
    first = named.groupBy("names").agg(F.max_by("path", -F.col("n")).alias("path"))
    return asked.join(numbered, "ordinals").select("wanted", "path").unionByName(asked.join(first, "names").select("wanted", "path"))


def find_by_name(tree: DataFrame, name: str) -> DataFrame:
    """The first node in preorder whose name has ``name`` as a part, in any case."""
    hits = preorder(tree).where(F.contains(F.lower("name"), F.lit(name.lower())))
    return hits.groupBy().agg(F.min_by("path", "position").alias("path")).where("path IS NOT NULL")


def belongs(path: Column, ancestor: str) -> Column:
    """Whether a path is ``ancestor`` or below it."""
    return (path == ancestor) | path.startswith(ancestor + ARROW)


def without(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(~belongs(F.col("path"), path))


def selection(tree: DataFrame, selected: DataFrame) -> DataFrame:
    """path, selected, has_selected_below and has_unselected_below of every node."""
    chosen = tree.select("path").join(selected.select("path").distinct().withColumn("_s", F.lit(True)), "path", "left").select("path", F.coalesce("_s", F.lit(False)).alias("selected"))
    p = parts(F.col("path"))
    pairs = chosen.select("selected", F.explode(F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), ARROW)))).alias("path"))
    below = pairs.groupBy("path").agg(F.bool_or("selected").alias("a"), F.bool_or(~F.col("selected")).alias("b"))
    return chosen.join(below, "path", "left").select("path", "selected", F.coalesce("a", F.lit(False)).alias("has_selected_below"), F.coalesce("b", F.lit(False)).alias("has_unselected_below"))


def children_of(tree: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected paths with the names of their children, in order."""
    kids = tree.select(parent(F.col("path")).alias("path"), "name").where("path IS NOT NULL")
    return selected.select("path").distinct().join(kids, "path", "left").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("children"))


def flatten_names(tree: DataFrame, depth: int = 3) -> DataFrame:
    """Names above ``depth`` as one line, parents first."""
    rows = tree.where(F.col("depth") < depth)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(parts(F.col("path")).alias("p"), "name"))), lambda x: x["name"]), ", ").alias("names"))


def _names(tree: DataFrame, term: str) -> Column:
    """Whether a node's name, or its description if the tree has such, has ``term`` as a part, in any case."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return has(F.col("name")) | has(F.col("description")) if "description" in tree.columns else has(F.col("name"))


def search(tree: DataFrame, term: str, prune: bool = False) -> DataFrame:
    """Nodes whose name or description has ``term``; with ``prune`` only where all above have it too.

    Without descriptions the names in a path tell, also where a node above is not in the tree.
    """
    hits = tree.where(_names(tree, term))
    if prune and "description" not in tree.columns:
        return hits.where(F.forall(parts(F.col("path")), lambda c: F.contains(F.lower(c), F.lit(term.lower()))))
    return _open(tree, hits, tree.where(~_names(tree, term)).select("path")) if prune else hits


def _open(tree: DataFrame, rows: DataFrame, shut: DataFrame) -> DataFrame:
    """Those of ``rows`` with none of the paths ``shut`` above them."""
    p = parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), ARROW))
    pairs = rows.where(F.size(p) > 1).select("path", F.explode(above).alias("_above"))
    hidden = pairs.join(shut.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()
    return rows.join(hidden, "path", "left_anti")


def visible(tree: DataFrame, expanded: DataFrame, term: str = "", page: int = 0, size: int = 50) -> DataFrame:
    """A page (from 0) of the nodes that a tree shows, with position (from 1): found by ``term``, under nodes that are found and expanded.

    Parents come first, children in the order of their names. expanded: paths.
    """
    hit = _names(tree, term) if term else F.lit(True)
    shut = tree.where(~hit).select("path").unionByName(tree.select("path").join(expanded.select("path"), "path", "left_anti"))
    shown = preorder(_open(tree, tree.where(hit), shut))
    return shown.where(F.col("position").between(page * size + 1, (page + 1) * size))
