"""Graph files: edge lists, GEXF, OBJ, and embeddings as text.

Files are read by Spark's text and XML sources in splits.  The order of lines
comes from a line's split and its place in it, and identifiers are numbered by
first appearance with range partitions and running sums; no file is taken
whole into one task, except that an OBJ face counts the vertices before it by
the same running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import json_string, json_value
from weft.model import Graph, running_sum
from weft.shared import materialise

# A data line of an edge list, and attribute types that are not text.
EDGE_LINE = r"^[ \t]*([+-]?\d+)[ \t]+([+-]?\d+)"
KINDS = {"integer": "number", "long": "number", "float": "number", "double": "number", "boolean": "boolean"}


class LoadError(ValueError):
    """A file that is missing, malformed or without data."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): line numbers from 0 in file order."""
    try:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
        rows = materialise(raw)
    except Exception as e:
        raise LoadError(f"{path}: {str(e).splitlines()[0]}") from e
    ordered = rows.select("value", F.struct("f", "b", "m").alias("at"), F.lit(1).cast("long").alias("one"))
    return materialise(running_sum(ordered, "at", "one", "line").select("line", "value"))


def _compact(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (o, a, b) -> (edges (o, src, dst), ids (name, id)), ids by first appearance, a before b."""
    ends = pairs.select(F.explode(F.array(F.struct((F.col("o") * 2).alias("o"), F.col("a").alias("name")), F.struct((F.col("o") * 2 + 1).alias("o"), F.col("b").alias("name")))).alias("e")).select("e.o", "e.name")
    first = ends.groupBy("name").agg(F.min("o").alias("first")).withColumn("one", F.lit(1).cast("long"))
    ids = materialise(running_sum(first, "first", "one", "id").select("name", "id"))
    edges = pairs.join(ids.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
    return edges.select("o", "src", "dst"), ids


def read_edges(spark: SparkSession, path: str, directed: bool = False, skip_header: bool = False) -> Graph:
    """Edge list: two whole numbers a line, anything after them ignored; blank and % lines skipped.

    skip_header drops the first data line, which must be numeric all the same.
    """
    lines = _lines(spark, path).where(~F.trim(F.regexp_replace("value", r"[\t\r]", " ")).rlike(r"^(%.*)?$"))
    parsed = lines.select(F.col("line").alias("o"), F.regexp_extract("value", EDGE_LINE, 1).alias("ta"), F.regexp_extract("value", EDGE_LINE, 2).alias("tb"))
    rows = materialise(parsed.select("o", F.expr("try_cast(ta as bigint)").alias("a"), F.expr("try_cast(tb as bigint)").alias("b")))
    if not rows.where("a is null or b is null").isEmpty():
        raise LoadError(f"{path}: a line that is not an edge")
    if skip_header:
        first = rows.agg(F.min("o")).first()[0]
        rows = rows.where(F.col("o") > F.lit(-1 if first is None else first))
    if not rows.where("a < 0 or b < 0").isEmpty() or rows.isEmpty():
        raise LoadError(f"{path}: a negative id, or no edge")
    edges, ids = _compact(rows)
    return Graph.from_edges(edges, ids.select("id"), directed, ["o"])


_NODE = "_id string, _label string, attvalues struct<attvalue: array<struct<_for:string, _id:string, _value:string>>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    try:
        raw = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
        return materialise(raw.withColumn("m", F.monotonically_increasing_id()))
    except Exception as e:
        raise LoadError(f"{path}: {str(e).splitlines()[0]}") from e


def read_gexf(spark: SparkSession, path: str) -> Graph:
    """GEXF: nodes in document order with their attributes as JSON text; undirected.

    Attributes are keyed by id, label first; of unknown or other types they
    are strings.  A repeated node id is a further vertex, and edges go to the first.
    """
    nodes = _xml(spark, path, "node", _NODE)
    if nodes.isEmpty() or not nodes.where("_id is null").isEmpty():
        raise LoadError(f"{path}: no node, or a node without id")
    kinds = _xml(spark, path, "attributes", "_class string, attribute array<struct<_id:string, _type:string>>")
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    types = kinds.where("_class is null or _class <> 'edge'").select(F.explode("attribute").alias("a")).select(F.col("a._id").alias("key"), F.coalesce(F.try_element_at(known, F.lower("a._type")), F.lit("string")).alias("kind")).dropDuplicates(["key"])
    numbered = running_sum(nodes.withColumn("one", F.lit(1).cast("long")), "m", "one", "id")
    numbered = materialise(numbered.select("id", F.col("_id").alias("name"), F.col("_label").alias("label"), F.coalesce("attvalues.attvalue", F.array().cast("array<struct<_for:string,_id:string,_value:string>>")).alias("values")))
    fields = numbered.select("id", F.posexplode("values").alias("k", "a")).select("id", "k", F.coalesce("a._for", "a._id").alias("key"), F.col("a._value").alias("value"))
    if not fields.where("key is null or value is null").isEmpty():
        raise LoadError(f"{path}: an attribute value without key or value")
    part = F.concat(F.lit("\n  "), json_string(F.col("key")), F.lit(": "), json_value(F.col("kind"), F.col("value")))
    bodies = fields.join(types, "key", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", part.alias("t")))).alias("parts"))
    label = F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit('\n  "label": '), json_string(F.col("label"))))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(label, F.coalesce(F.transform("parts", lambda p: p["t"]), F.array().cast("array<string>")))
    data = F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("\n}"))).otherwise("{}")
    vertices = materialise(numbered.join(bodies, "id", "left").select("id", "name", data.alias("data")))

    names = vertices.groupBy("name").agg(F.min("id").alias("n_id"))
    edges = _xml(spark, path, "edge", "_source string, _target string").select(F.col("m").alias("o"), "_source", "_target")
    joined = edges.join(names.select(F.col("name").alias("_source"), F.col("n_id").alias("src")), "_source", "left").join(names.select(F.col("name").alias("_target"), F.col("n_id").alias("dst")), "_target", "left")
    if not joined.where("src is null or dst is null").isEmpty():
        raise LoadError(f"{path}: an edge with an unknown end")
    return Graph.from_edges(joined.select("o", "src", "dst"), vertices.select("id", "data"), False, ["o"])


def read_obj(spark: SparkSession, path: str) -> Graph:
    """OBJ: v lines are vertices; f lines are loops of edges, each edge once, none to itself.

    A face refers to the vertices before it, from 1, or from -1 backwards.
    """
    lines = _lines(spark, path).select("line", F.regexp_replace("value", r"^[ \t]+|[\r\n]+$", "").alias("t"))
    lines = lines.withColumn("v", F.col("t").rlike(r"^v[ \t]").cast("long"))
    before = materialise(running_sum(lines, "line", "v", "n"))
    count = before.agg(F.sum("v")).first()[0] or 0
    if not count:
        raise LoadError(f"{path}: no vertex")
    faces = before.where(F.col("t").rlike(r"^f[ \t]")).select("line", "n", F.filter(F.split(F.substring("t", 3, 1 << 30), r"[ \t]+"), lambda x: x != "").alias("refs"))
    faces = faces.select("line", "n", F.transform("refs", lambda x: F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("bigint")).alias("refs"))
    bad = F.exists("refs", lambda r: r.isNull() | (r == 0) | (F.abs(r) > F.col("n")))
    faces = materialise(faces.select("line", bad.alias("bad"), F.transform("refs", lambda r: F.when(r > 0, r - 1).otherwise(F.col("n") + r)).alias("vs")))
    if not faces.where("bad").isEmpty():
        raise LoadError(f"{path}: a face with an unknown vertex")
    following = F.concat(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), F.slice("vs", F.lit(1), F.lit(1)))
    loops = faces.where(F.size("vs") >= 2).select("line", F.posexplode(F.arrays_zip(F.col("vs").alias("a"), following.alias("b"))).alias("k", "e")).select("line", "k", F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst")).where("src <> dst")
    edges = loops.groupBy("src", "dst").agg(F.min(F.struct("line", "k")).alias("o"))
    return Graph.from_edges(edges, spark.range(count), False, ["o"])


def write_embedding(positions: DataFrame, name: str, dim: int, path: str) -> None:
    """Text: the name, then ``N dim``, then a line of ``%f`` values per vertex in order of id."""
    n = positions.count()
    spark = positions.sparkSession
    head = spark.createDataFrame([(-2, name), (-1, f"{n} {dim}")], "id long, value string")
    value = F.concat_ws("", F.transform("pos", lambda x: F.concat(F.format_string("%.6f", x), F.lit(" "))))
    head.unionByName(positions.select("id", value.alias("value"))).coalesce(1).sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def read_embedding(spark: SparkSession, path: str, n: int, dim: int) -> tuple[str, DataFrame]:
    """(name, positions); another number of vertices or dimensions is an error."""
    lines = _lines(spark, path)
    head = {r["line"]: r["value"] for r in lines.where("line < 2").collect()}
    if len(head) < 2 or head[1].split() != [str(n), str(dim)]:
        raise LoadError(f"{path}: not {n} vertices of {dim} dimensions")
    rows = lines.where("line >= 2").select((F.col("line") - 2).alias("id"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double")).alias("pos"))
    rows = materialise(rows.where(F.col("id") < n))
    if rows.count() != n or not rows.where((F.size("pos") != dim) | F.exists("pos", lambda x: x.isNull())).isEmpty():
        raise LoadError(f"{path}: positions are missing")
    return head[0], rows
