"""Pairs of vectors within an angle, by cells around pivots.

Every block gets a few of its own vectors as pivots. A vector lies in the cell of its nearest pivot, and a cell's radius is the
widest angle of its vectors to the pivot. If x lies in a cell and y is within the angle of x, the triangle inequality on
angles puts y within angle plus radius of that pivot; so y only visits such cells, and in a cell only vectors
whose angles to the pivot differ by no more than the angle are compared. Nothing is missed. Where vectors form
clusters most pairs never meet; without any structure every pair has to be compared by any exact method.
`block_pairs` does that, part by part of a block as matrix products, at a small part of the cost of a joined row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.operators.pairing import slice_join
from crossmarket.sources.checkpoints import cut, cut_at

SLACK = 1e-7  # radians; arc cosines are this exact


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def directions(vectors: DataFrame, block: str, row_id: str, vector: str) -> DataFrame:
    """block, row_id and the vector in unit length; missing and zero vectors have no direction and take no part."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return (vectors.select(block, row_id, values.alias("_u"), norm.alias("_norm")).where("_norm > 0")
            .select(block, row_id, F.transform("_u", lambda x: x / F.col("_norm")).alias("_u")))


def angle_candidates(vectors: DataFrame, block: str, row_id: str, vector: str, threshold: float, pivots: int) -> DataFrame:
    """Pairs (left_id < right_id, _a, _b in unit length) of one block that the cells cannot rule out."""
    angle = math.acos(threshold) + SLACK
    rows = cut(directions(vectors, block, row_id, vector))
    order = Window.partitionBy(block).orderBy(F.xxhash64(row_id), row_id)
    chosen = (rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pivots).groupBy(block)
              .agg(F.sort_array(F.collect_list(F.struct("_n", "_u"))).alias("_pivots")))
    measured = rows.join(chosen, block).withColumn("_angles", F.transform("_pivots", lambda p: F.acos(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(p["_u"], F.col("_u")))))))
    placed = cut(measured.withColumn("_cell", F.array_position("_angles", F.array_min("_angles")).cast("int")).drop("_pivots"))
    own = F.element_at("_angles", F.col("_cell"))
    radii = (placed.groupBy(block, "_cell").agg(F.max(own).alias("_radius")).groupBy(block)
             .agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_radius"))).alias("_radii")))
    left = placed.select(block, "_cell", F.col(row_id).alias("left_id"), own.alias("_to_a"), F.col("_u").alias("_a"))
    visits = F.transform(F.map_entries("_radii"), lambda e: F.when(
        F.element_at(F.col("_angles"), e["key"]) <= e["value"] + angle,
        F.struct(e["key"].alias("_cell"), F.element_at(F.col("_angles"), e["key"]).alias("_to_b"))))
    right = placed.join(radii, block).select(block, F.col(row_id).alias("right_id"), F.col("_u").alias("_b"),
                                             F.explode(F.array_compact(visits)).alias("_v")).select(
        block, "right_id", "_b", "_v._cell", "_v._to_b")
    near = (F.col("left_id") < F.col("right_id")) & (F.abs(F.col("_to_a") - F.col("_to_b")) <= angle)
    # Of a pair in two cells, the smaller id's cell is where it is compared.
    return slice_join(left, right, [block, "_cell"], "left_id", "right_id", near).drop("_cell", "_to_a", "_to_b")


def block_pairs(vectors: DataFrame, block: str, row_id: str, vector: str, threshold: float, rows: int = 2048) -> DataFrame:
    """All pairs of one block with at least the given cosine: block, left_id < right_id, similarity.

    Every block is dealt into parts of about `rows` vectors by the hash of their ids. Each two parts, and each with itself, meet
    in one group, where a matrix product compares them; a group holds two parts and at most rows * rows pairs.
    """
    unit, path = cut_at(directions(vectors, block, row_id, vector).withColumn("_d", F.size("_u")))
    keys = [block, "_d"]
    parts = unit.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int")
    dealt = unit.join(parts, keys).withColumn("_own", part)
    own, last = F.col("_own"), F.col("_parts") - 1
    left = dealt.select(*keys, row_id, "_u", own.alias("_i"), F.explode(F.sequence(own, last)).alias("_j"))
    again = vectors.sparkSession.read.schema(unit.schema).parquet(path)  # so that the two sides have columns of their own
    dealt = again.join(parts.toDF(*parts.columns), keys).withColumn("_own", part)
    right = dealt.select(*keys, row_id, "_u", F.explode(F.sequence(F.lit(0), own)).alias("_i"), own.alias("_j"))
    names, slack = ["left_id", "right_id", "similarity"], 1e-9

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        sides = []
        for table in (one, two):
            ids, values = table.column(row_id).combine_chunks(), table.column("_u").combine_chunks().flatten()
            sides.append((ids, values.to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.empty((0, 0))))
        (a_ids, a), (b_ids, b) = sides
        kind = table.schema.field(row_id).type
        found = [pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names)]
        same = len(a) and one.column("_i")[0] == one.column("_j")[0]
        for low in range(0, len(a) if len(b) else 0, 256):
            near = ~(a[low:low + 256] @ b.T < threshold - slack)
            at, to = np.nonzero(near)
            at += low
            cosine = np.einsum("ij,ij->i", a[at], b[to])
            kept = np.flatnonzero(~(cosine < threshold))
            x, y = a_ids.take(pa.array(at[kept])), b_ids.take(pa.array(to[kept]))
            first = pc.less(x, y)
            table = pa.table([pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(cosine[kept])], names)
            found.append(table.filter(first) if same else table)
        met = pa.concat_tables(found)
        key = (one if one.num_rows else two).column(block)
        return met.add_column(0, block, pa.repeat(key[0], met.num_rows))

    fields = {f.name: f.dataType.simpleString() for f in unit.schema.fields}
    schema = f"`{block}` {fields[block]}, left_id {fields[row_id]}, right_id {fields[row_id]}, similarity double"
    group = [*keys, "_i", "_j"]
    many = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (left.repartition(many, *group).groupBy(*group).cogroup(right.repartition(many, *group).groupBy(*group))
            .applyInArrow(compare, schema))
