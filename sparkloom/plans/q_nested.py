"""Queries over JSON of any depth: searchable text, factors and metrics, trees."""

from pyspark.sql import functions as F

from ..functions import nested as N
from ..operators import search as S
from ..operators import taxonomy as X
from ..session import table
from .catalog import query
from .q_quality import r6
from .views import view

#: Extracted data of depth four, the same text for both engines.
DATA = """concat('{"a":{"k":', CAST(event_id % 90 AS {text}), ',"list":[{"name":"', event_type, '","deep":{"cents":', CAST(CAST(round(value * 100) AS BIGINT) AS {text}), '}},"x', CAST(event_id % 7 AS {text}), '"]},"note":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"Seen By"' END, ',"ok":true}')"""
TREE = "json_tree(j)"


def events(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "event_type", DATA.replace("{text}", "STRING") + " AS j")


@query("searchable_text", f"""WITH t AS (SELECT event_id, event_type, {DATA.replace('{text}', 'VARCHAR')} AS j FROM events),
a AS (SELECT event_id, fullkey, CASE WHEN type = 'NULL' THEN 'none' ELSE trim(CAST(atom AS VARCHAR), '"') END AS v FROM t, {TREE} WHERE type NOT IN ('OBJECT', 'ARRAY'))
SELECT event_id, lower(any_value(event_type) || ' ' || s) AS text FROM (SELECT event_id, string_agg(v, ' ' ORDER BY fullkey) AS s FROM a GROUP BY event_id) JOIN t USING (event_id) GROUP BY event_id, s""")
def searchable_text(spark, d):
    """Categories and all values of nested data, in lower case."""
    rows = events(spark, d).withColumns({"id": F.col("event_id"), "categories": F.array("event_type"), "extracted_data": F.col("j")})
    return S.searchable(rows).select(F.col("id").alias("event_id"), "text")


@query("nested_factors", f"""WITH t AS (SELECT event_type, {DATA.replace('{text}', 'VARCHAR')} AS j FROM events),
a AS (SELECT event_type, replace(replace(replace(substr(fullkey, 3), '[', '.'), ']', ''), '.', '_') AS name, CAST(atom AS DOUBLE) AS v FROM t, {TREE} WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
SELECT event_type, name, count(*) AS n, round(avg(v), 6) AS mean FROM a GROUP BY ALL""")
def nested_factors(spark, d):
    """Numbers at any depth by their joined keys."""
    found = N.numbers(events(spark, d).select("event_type", "j"), "j")
    return r6(found.groupBy("event_type", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


PERFORMANCE = """concat('{"suite":{"name":"s', CAST(doc_id % 3 AS {text}), '","metrics":{"f1":', CAST(quality AS {text}), ',"rouge":{"mean":', CAST(toxic AS {text}), ',"std":9},"label":"x"}},"other":{"f1":5}}')"""


@query("performance_metrics", "SELECT doc_id, 'suite_f1' AS name, CAST(quality AS DOUBLE) AS value FROM labels UNION ALL SELECT doc_id, 'suite_rouge', CAST(toxic AS DOUBLE) FROM labels")
def performance_metrics(spark, d):
    """Metrics of benchmark suites, plain or as a mean."""
    return N.performance(table(spark, d, "labels").selectExpr("doc_id", PERFORMANCE.replace("{text}", "STRING") + " AS j"), "j")


def tree(nodes, name):
    """A tree of regions, nations and segments as JSON, one row, from nodes of depth 0 to 2; nodes without the one above are not in it."""
    kids = lambda: F.array_sort(F.collect_list("c"))
    at = lambda k: nodes.where(F.col("depth") == k).select(X.parent(F.col("path")).alias("above"), "path", "name", "confidence_threshold")
    two = at(2).select("above", F.struct("name", "confidence_threshold").alias("c")).groupBy("above").agg(kids().alias("children"))
    one = at(1).join(two.withColumnRenamed("above", "path"), "path", "left").select("above", F.struct("name", "confidence_threshold", "children").alias("c")).groupBy("above").agg(kids().alias("children"))
    zero = at(0).join(one.withColumnRenamed("above", "path"), "path", "left").select(F.struct("name", "confidence_threshold", "children").alias("c")).agg(kids().alias("children"))
    return zero.select(F.to_json(F.struct(F.struct(F.lit(name).alias("name"), "children").alias("taxonomy"))).alias("taxonomy"))


@query("taxonomy_json_nodes", "SELECT 'World → ' || path AS path, name, depth + 1 AS depth, confidence_threshold FROM v_tax_b WHERE string_split(path, ' → ')[1] IN (SELECT path FROM v_tax_b WHERE depth = 0) UNION ALL SELECT 'World', 'World', 0, 0.5")
def taxonomy_json_nodes(spark, d):
    """A tree written as nested JSON, read back level by level."""
    return X.nodes_of(tree(view(spark, d, "v_tax_b"), "World")).select("path", "name", "depth", "confidence_threshold")


@query("taxonomy_merge_raw", """SELECT 'World → ' || coalesce(a.path, b.path) AS path, greatest(a.confidence_threshold, b.confidence_threshold) AS confidence_threshold,
CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'merged' ELSE 'unknown' END AS source FROM v_tax_a a FULL JOIN (SELECT * FROM v_tax_b WHERE string_split(path, ' → ')[1] IN (SELECT path FROM v_tax_b WHERE depth = 0)) b ON a.path = b.path UNION ALL SELECT 'World', 0.5, 'merged'""")
def taxonomy_merge_raw(spark, d):
    """Two trees as JSON merged by path."""
    merged = X.merge_raw(tree(view(spark, d, "v_tax_a"), "World"), tree(view(spark, d, "v_tax_b"), "World"))
    return merged.select("path", "confidence_threshold", "source")


SHOWN = """t AS (SELECT 'World → ' || path AS path, name, CASE WHEN name LIKE '%A%' THEN 'first kind' ELSE 'other' END AS description FROM v_tax_b WHERE string_split(path, ' → ')[1] IN (SELECT path FROM v_tax_b WHERE depth = 0) UNION ALL SELECT 'World', 'World', 'all of the first kind'),
h AS (SELECT *, name ILIKE '%first%' OR description ILIKE '%FIRST%' AS hit, NOT name IN ('AMERICA', 'NATION_2', 'NATION_10') AS expanded FROM t)"""


def described(spark, d):
    """A tree with descriptions under one root."""
    tree = view(spark, d, "v_tax_b").select("path", "name")
    tree = tree.join(tree.join(view(spark, d, "v_tax_b").where("depth = 0").select("path"), "path").select(F.col("path").alias("top")), F.element_at(X.parts(F.col("path")), 1) == F.col("top")).drop("top")
    tree = tree.select(F.concat(F.lit("World → "), "path").alias("path"), "name", F.when(F.contains("name", F.lit("A")), "first kind").otherwise("other").alias("description"))
    return tree.unionByName(spark.createDataFrame([("World", "World", "all of the first kind")], "path string, name string, description string"))


@query("taxonomy_visible", f"""WITH {SHOWN}, v AS (SELECT path FROM h WHERE hit AND NOT EXISTS (SELECT 1 FROM h a WHERE starts_with(h.path, a.path || ' → ') AND NOT (a.hit AND a.expanded))),
n AS (SELECT path, row_number() OVER (ORDER BY string_split(path, ' → ')) AS position FROM v) SELECT path, CAST(position AS INT) AS position FROM n WHERE position BETWEEN 11 AND 20""")
def taxonomy_visible(spark, d):
    """The second page of ten of what a tree shows: found by name or description, below expanded nodes."""
    tree = described(spark, d)
    return X.visible(tree, tree.where("name NOT IN ('AMERICA', 'NATION_2', 'NATION_10')"), "FIRST", 1, 10).select("path", "position")


@query("taxonomy_search_pruned", f"WITH {SHOWN} SELECT path FROM h WHERE hit AND NOT EXISTS (SELECT 1 FROM h a WHERE starts_with(h.path, a.path || ' → ') AND NOT a.hit)")
def taxonomy_search_pruned(spark, d):
    """Nodes found by description, all above them too."""
    return X.search(described(spark, d), "first", True).select("path")
