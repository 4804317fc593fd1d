"""Mixing sources to target weights by pivotal dependent rounding.

Each document starts with ``target / source_size`` copies.  The whole part
stands; the fraction is rounded by pairing: of two documents of a source,
word mass moves from one to the other until one's fraction is 0 or 1, the
direction drawn so that each fraction keeps its expectation.  Mass is counted
in words, so a pairing keeps the source's words exactly.  Leaves of a
reduction tree settle all but one document each, the residuals of ``fan``
leaves meet in a node of the next level, and so on until each source has at
most one fraction, which is drawn.

Defined results: null texts and texts without words have size 0 and take
nothing; a null source is a source of its own, last in order; repeated ids are
told apart by their sizes, and rows alike in id, source and size by a number
from 0 on, so that any number of them spreads over the leaves: they get any of
the equal outcomes.  A document's draws depend on its id, size, that number
and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.shared import materialise, small_enough

# The contract's white space, weights, share and cap.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0

#: Fractions that meet in one node of the tree.
FAN = 256
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 200_000
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, n_docs, target (water filling).

    Targets are min(cap * size, level * weight) with one level for all, the
    fixed point of resharing each excess by weight.  There is a row per source,
    so ordering them takes one task with as many rows as there are sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("l")))).over(everything)["l"]
    target = F.when(fits.isNull(), F.col("most")).otherwise(F.least(F.col("most"), fits * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _draw(seed: int, level: int, *cols):
    """Uniform in [0, 1) from the rows' own values."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(source, key, row, ..) with ``twin``: the place from 0 among rows of one source and key.

    Rows are counted per input partition, which ``row`` tells, and the counts
    are summed; only rows that have twins are sorted, each partition's apart.
    """
    twins = materialise(rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("source").alias("t_source"), F.col("key").alias("t_key")))
    if twins.isEmpty():
        return rows.withColumn("twin", F.lit(0).cast("long"))
    alike = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("key") == F.col("t_key"))
    part = F.shiftright("row", 33)  # as monotonically_increasing_id numbers them
    own = rows.join(twins, alike, "left_semi").select("row", "source", "key", part.alias("part"))
    counts = own.groupBy("source", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("source").alias("c_source"), F.col("key").alias("c_key"), F.col("part").alias("c_part"), F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "key", "part").orderBy("row")) - 1
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("key") == F.col("c_key")) & (F.col("part") == F.col("c_part"))
    placed = own.withColumn("place", place).join(counts, same).select(F.col("row").alias("p_row"), (F.col("place") + F.col("before")).cast("long").alias("twin"))
    return rows.join(placed, F.col("row") == F.col("p_row"), "left").drop("p_row").withColumn("twin", F.coalesce("twin", F.lit(0).cast("long")))


_ITEM = "struct<key:bigint,id:{id},row:bigint,size:bigint,p:double>"


def _settle(nodes: DataFrame, level: int, seed: int, item: str, last: bool) -> DataFrame:
    """(source, node, items) -> (source, node, done: settled items, rest: the residual or null)."""
    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(f"array<{item}>").alias("done"))

    def put(x, p):
        return F.struct(x["key"].alias("key"), x["id"].alias("id"), x["row"].alias("row"), x["size"].alias("size"), p.alias("p"))

    def pair(acc, y):
        x = acc["rest"]
        a, b, p, q = x["size"].cast("double"), y["size"].cast("double"), x["p"], y["p"]
        up = F.least((1 - p) * a, q * b)  # words that x can take from y
        down = F.least(p * a, (1 - q) * b)  # words that y can take from x
        gain = _draw(seed, level, x["key"], y["key"], x["size"], y["size"]) < down / (up + down)
        move = F.when(gain, up).otherwise(-down)
        p2, q2 = p + move / a, q - move / b
        p2 = F.when(p2 < EPS, 0.0).when(p2 > 1 - EPS, 1.0).otherwise(p2)
        q2 = F.when(q2 < EPS, 0.0).when(q2 > 1 - EPS, 1.0).otherwise(q2)
        x_in = (p2 == 0.0) | (p2 == 1.0)
        y_in = (q2 == 0.0) | (q2 == 1.0)
        nx, ny = put(x, p2), put(y, q2)
        done = F.concat(acc["done"], F.when(x_in & y_in, F.array(nx, ny)).when(x_in, F.array(nx)).otherwise(F.array(ny)))
        rest = F.when(x_in & y_in, F.lit(None).cast(item)).when(x_in, ny).otherwise(nx)
        both = F.struct(rest.alias("rest"), done.alias("done"))
        return F.when(x.isNull(), F.struct(y.alias("rest"), acc["done"].alias("done"))).otherwise(both)

    ordered = F.array_sort("items")
    out = nodes.withColumn("a", F.aggregate(ordered, start, pair)).select("source", "node", F.col("a.rest").alias("rest"), F.col("a.done").alias("done"))
    if not last:
        return out
    coin = (_draw(seed, -1, F.col("rest.key"), F.col("rest.size")) < F.col("rest.p")).cast("double")
    done = F.when(F.col("rest").isNull(), F.col("done")).otherwise(F.concat("done", F.array(put(F.col("rest"), coin))))
    return out.select("source", "node", F.lit(None).cast(item).alias("rest"), done.alias("done"))


def mix_sources(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 17,
    fan: int = FAN,
) -> DataFrame:
    """One row per document: id, row, size, source_size, target, copies, taken.

    row numbers the documents of this run.  Nodes hold ``fan`` fractions on
    average, spread by hash, so a source of any share has as many nodes as it
    needs.  Levels: log of the largest source's documents to the base ``fan``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0))).cast("long").alias("size"))
    sizes = materialise(sizes.withColumn("row", F.monotonically_increasing_id()))
    targets = materialise(source_targets(sizes, weights, share, cap))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    if small_enough(targets, BROADCAST_SOURCES):
        known = sizes.join(F.broadcast(targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        parts = 64  # a hot source is spread over so many keys
        spread = targets.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        known = sizes.withColumn("own", F.pmod(F.col("row"), F.lit(parts)).cast("int")).join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("salt"))).drop("s", "own", "salt")
    ratio = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    known = known.withColumn("whole", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    open_ = known.where((F.col("p") > EPS) & (F.col("size") > 0))

    kind = dict(sizes.dtypes)["id"]
    item = _ITEM.format(id=kind)
    open_ = _numbered(open_.withColumn("key", F.xxhash64(F.lit(seed), F.col("id"), F.col("size"))))
    key = F.when(F.col("twin") == 0, F.col("key")).otherwise(F.xxhash64("key", "twin"))
    leaves = F.ceil(F.col("n_docs") / fan)
    level = open_.select("source", F.pmod(F.xxhash64(key, F.lit(1)), leaves).alias("node"), F.struct(key.alias("key"), "id", "row", "size", "p").cast(item).alias("item"))
    settled, depth, width = None, 0, max(1, -(-most // fan))
    while True:
        nodes = level.groupBy("source", "node").agg(F.collect_list("item").alias("items"))
        out = _settle(nodes, depth, seed, item, width == 1)
        if width > 1:
            out = materialise(out)
        done = out.select(F.explode("done").alias("d")).select(F.col("d.row").alias("d_row"), F.col("d.p").alias("up"))
        settled = done if settled is None else settled.unionByName(done)
        if width == 1:
            break
        level = out.where("rest is not null").select("source", F.floor(F.col("node") / fan).alias("node"), F.col("rest").alias("item"))
        depth, width = depth + 1, -(-width // fan)
    result = known.join(settled, F.col("row") == F.col("d_row"), "left")
    copies = (F.col("whole") + F.coalesce(F.col("up"), F.lit(0.0))).cast("long")
    return result.select(F.col("id").alias(id_col), "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
