"""A cell-partitioned vector index and its exact search.

Vectors of unit length are assigned to the nearest of ``n_cells`` centroids and written in folders
by cell, packed into blocks of at most ``BLOCK_ROWS`` rows; a small table holds every cell's
centroid, number of rows and radius (largest distance of a row).  For a query q no row of a cell
is nearer than |q - centroid| - radius, so

1. each query visits its nearest cells until they hold k rows, which bounds its k-th distance;
2. it then visits exactly the other cells whose lower bound does not exceed that distance.

Queries are a DataFrame and are never collected: parts of a cell's queries meet groups of its blocks, and
both are shuffled into as many tasks as keep a task's share below ``TASK_BYTES``.  Cells that no query visits are left out by their folder.  Cosine similarity is
1 - distance^2 / 2, so the order is that of ``vector_top_k``; zero vectors have no direction and lie
in cell -1, which is visited when the others hold fewer than k rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shuffle_partitions
from .retrieval import best_of, matrix, read_index, usable_vectors

BLOCK_ROWS = 4096
SAMPLE_ROWS = 20_000  # rows that the centroids are fitted on
QUERY_ROWS = 1024  # queries of one matrix product
#: Bytes of vectors in a part of a cell's queries and in a group of its blocks: what is shuffled falls with
#: them, the memory of a task grows with them; and bytes that a task is to read.
PART_BYTES, GROUP_BYTES, TASK_BYTES = 8 << 20, 32 << 20, 64 << 20
SLACK = 1e-9  # rounding of distances


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1.0)[:, None]


def fit_centroids(corpus: DataFrame, vec: str, n_cells: int, seed: int = 42) -> np.ndarray:
    """Unit centroids by k-means on at most ``SAMPLE_ROWS`` rows, drawn by hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = usable_vectors(corpus, vec).select(F.col(vec).cast("array<double>").alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = rows.select("v", F.xxhash64("v", F.lit(seed)).alias("k"))
    some = first_rows(rows, SAMPLE_ROWS).select(array_to_vector("v").alias("v"), F.col("w").cast("double").alias("w"))
    if some.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=n_cells, featuresCol="u", weightCol="w", maxIter=10, seed=seed).fit(Normalizer(inputCol="v", outputCol="u").transform(some))
    return unit_rows(np.array(model.clusterCenters()))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """(v, k, w): the first ``n`` of the (v, k) in the order of the hash k, equal ones as one row that counts
    them.  Only rows of the hash's lowest ranges, some ``n`` distinct ones, are shuffled."""
    part = F.shiftright("k", 48)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # at most 65,536 rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b")).where(F.col("b") < n).agg(F.max("part")).first()[0]
    near = rows.where(part <= F.lit(last)).groupBy("k", "v").agg(F.count(F.lit(1)).alias("w")).orderBy("k", "v").limit(n)
    before = Window.orderBy("k", "v").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    near = near.withColumn("b", F.coalesce(F.sum("w").over(before), F.lit(0))).where(F.col("b") < n)
    return near.select("v", "k", F.least("w", F.lit(n) - F.col("b")).alias("w"))


def build_cells(corpus: DataFrame, ids: Sequence[str], path: str, vec: str = "embedding", n_cells: int = 64,
                centroids: np.ndarray | None = None) -> None:
    """Write the index under ``path``: ``cells`` (folders by cell, blocks of ids and unit vectors) and
    ``centroids`` (cell, centroid, n, radius)."""
    spark = corpus.sparkSession
    c = fit_centroids(corpus, vec, n_cells) if centroids is None else unit_rows(np.asarray(centroids, float))
    names = list(ids)
    id_types = ", ".join(f"`{n}`:{corpus.schema[n].dataType.simpleString()}" for n in names)
    dims = c.shape[1] if len(c) else 0

    def assign(batches):
        for batch in batches:
            x = unit_rows(matrix(pa.Table.from_batches([batch])["__v"], dims) if dims else np.zeros((batch.num_rows, 0)))
            zero = ~(x != 0).any(axis=1)
            cell = np.argmax(x @ c.T, axis=1) if len(c) else np.zeros(len(x), int)
            far = np.sqrt(((x - c[cell]) ** 2).sum(1)) if len(c) else np.zeros(len(x))
            cell[zero], far[zero] = -1, 0.0
            order = np.argsort(cell, kind="stable")
            for value in np.unique(cell).tolist():
                at = order[cell[order] == value]
                for lo in range(0, len(at), BLOCK_ROWS):
                    some = at[lo:lo + BLOCK_ROWS]
                    rows = pa.StructArray.from_arrays([batch.column(i).take(pa.array(some)) for i in range(len(names))], names=names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([value], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([float(far[some].max())]),
                         pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), rows),
                         pa.array([np.ascontiguousarray(x[some]).tobytes()], pa.binary())], names=["cell", "n", "radius", "ids", "x"])

    rows = usable_vectors(corpus, vec).select(*names, F.col(vec).cast("array<double>").alias("__v"))
    blocks = rows.mapInArrow(assign, f"cell int, n int, radius double, ids array<struct<{id_types}>>, x binary")
    blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    sizes = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(-1, [0.0] * dims)], "cell int, centroid array<double>")
    table.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/centroids")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vec: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, the index's ids, similarity, cells_visited, cells_skipped (of the cells that
    hold rows): the k most similar rows of every query, ties to the smaller ids, NULL first."""
    cells = read_index(spark, f"{path}/cells")
    id_type = cells.schema["ids"].dataType.elementType
    names = id_type.fieldNames()
    table = sorted(read_index(spark, f"{path}/centroids").collect(), key=lambda r: r.cell)  # one row per cell
    known = [r for r in table if r.cell >= 0]
    dims = len(table[0].centroid) if table else 0
    centre = np.array([r.centroid for r in known]).reshape(len(known), dims)
    radius, count = np.array([r.radius for r in known]), np.array([r.n for r in known], np.int64)
    number = np.array([r.cell for r in known], np.int32)
    zero_rows = sum(r.n for r in table if r.cell < 0)

    asked = usable_vectors(queries, vec).select(F.col(query_id).alias("__qid"), F.col(vec).cast("array<double>").alias("__v"))
    qid = queries.schema[query_id].dataType.simpleString()
    # a query's own number: ids may repeat or be NULL
    asked = materialize(asked.withColumn("__qn", F.monotonically_increasing_id()), "cell-queries")

    def visits(theta: bool):
        def run(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                x = unit_rows(matrix(t["__v"], dims))
                far = np.sqrt(np.maximum(0, ((x[:, None, :] - centre[None]) ** 2).sum(-1))) if len(known) else np.zeros((len(x), 0))
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1) if len(known) else far
                first = np.zeros(far.shape, bool)
                # the nearest cells up to the one that completes k rows
                np.put_along_axis(first, order, np.concatenate((np.zeros((len(x), 1)), held[:, :-1]), axis=1) < k, axis=1) if len(known) else None
                first[~(x != 0).any(axis=1)] = True  # no direction: every row ties
                pick = first if not theta else ~first & (far - radius <= np.asarray(t["theta"])[:, None] + SLACK)
                row, col = np.nonzero(pick)
                cell = number[col]
                if not theta:
                    lone = np.flatnonzero((held[:, -1] < k) if len(known) else np.ones(len(x), bool)) if zero_rows else np.zeros(0, int)
                    lone = np.union1d(lone, np.flatnonzero(~(x != 0).any(axis=1))) if zero_rows else lone
                    row, cell = np.concatenate((row, lone)), np.concatenate((cell, np.full(len(lone), -1, np.int32)))
                yield pa.RecordBatch.from_arrays([t["__qn"].combine_chunks().take(pa.array(row)), pa.array(cell, pa.int32()),
                                                  t["__v"].combine_chunks().take(pa.array(row))], names=["__qn", "cell", "__v"])

        return run

    out = T.StructType([T.StructField("__qn", T.LongType()), *id_type.fields, T.StructField("__d", T.DoubleType())])
    by_id = [(n, "ascending") for n in names]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of a group of one cell's blocks for each of a part of the queries."""
        asked_v = unit_rows(matrix(left["__v"], dims))
        rows = pa.concat_tables([pa.Table.from_struct_array(chunk.flatten()) for chunk in right["ids"].chunks])
        c = np.concatenate([np.frombuffer(x.as_py(), float) for x in right["x"]]).reshape(rows.num_rows, -1)
        order = pc.sort_indices(rows, sort_keys=by_id, null_placement="at_start").to_numpy()
        found = []
        for at in range(0, len(asked_v), QUERY_ROWS):
            q = asked_v[at:at + QUERY_ROWS]
            best = place = None  # queries x k: negative similarities and places in the order of ids
            for lo in range(0, len(order), BLOCK_ROWS):
                some = c[order[lo:lo + BLOCK_ROWS]]
                s = -(q @ some.T)
                s[~(q != 0).any(axis=1)] = np.inf
                s[:, ~(some != 0).any(axis=1)] = np.inf
                r, col = best_of(np.where(np.isnan(s), np.inf, s), k)
                near, where = s[r, col].reshape(len(q), -1), (col + lo).reshape(len(q), -1)
                if best is not None:
                    near, where = np.concatenate((best, near), axis=1), np.concatenate((place, where), axis=1)
                    r, col = best_of(near, k)
                    near, where = near[r, col].reshape(len(q), -1), where[r, col].reshape(len(q), -1)
                best, place = near, where
            found.append((np.repeat(np.arange(at, at + len(q)), best.shape[1]), place.ravel(), best.ravel()))
        of, at, far = (np.concatenate(x) for x in zip(*found))
        hits = rows.take(pa.array(order[at])).append_column("__d", pa.array(far, mask=~np.isfinite(far)))
        return hits.add_column(0, "__qn", left["__qn"].combine_chunks().take(pa.array(of)))

    def search(pairs: DataFrame) -> DataFrame:
        asked_in = {r.cell: r["count"] for r in pairs.groupBy("cell").count().collect()}  # at most one row per cell
        size = {r.cell: r.n for r in table if r.cell in asked_in}
        if not size:
            return spark.createDataFrame([], out)
        row = 8 * max(1, dims)
        n_parts = max(1, math.ceil(n_queries / max(QUERY_ROWS, PART_BYTES // row)))
        groups = {cell: math.ceil(n / max(BLOCK_ROWS, GROUP_BYTES // row)) for cell, n in size.items()}
        n_bytes = row * sum(asked_in[cell] * groups[cell] + n_parts * n for cell, n in size.items())
        units = n_parts * sum(groups.values())
        n_tasks = max(1, min(units, max(shuffle_partitions(spark), math.ceil(n_bytes / TASK_BYTES))))
        groups_of = F.element_at(F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]), F.col("cell"))
        part = F.pmod(F.xxhash64("__qn"), F.lit(n_parts)).cast("int")
        tagged = pairs.select("__qn", "__v", "cell", part.alias("part"), F.explode(F.sequence(F.lit(0), groups_of - 1)).alias("group"))
        # every (cell, part) with every block of the cell
        per = pairs.select(F.col("cell").alias("gcell"), part.alias("gpart")).distinct()
        blocks = cells.where(F.col("cell").isin(list(size)))
        given = blocks.join(F.broadcast(per), F.col("cell") == F.col("gcell")).select(
            "gcell", "gpart", F.pmod(F.xxhash64("ids", "x"), groups_of).cast("int").alias("ggroup"), "ids", "x")
        key, gkey = ["cell", "part", "group"], ["gcell", "gpart", "ggroup"]
        return tagged.repartition(n_tasks, *key).groupBy(*key).cogroup(given.repartition(n_tasks, *gkey).groupBy(*gkey)).applyInArrow(
            lambda left, right: meet(left, right) if left.num_rows and right.num_rows else out_empty(), out)

    def out_empty() -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(out).empty_table()

    n_queries = asked.count()
    pair_schema = "__qn long, cell int, __v array<double>"
    one = materialize(asked.mapInArrow(visits(False), pair_schema), "cell-visits")
    top = materialize(search(one), "cell-round1")
    nth = F.row_number().over(Window.partitionBy("__qn").orderBy("__d"))
    kth = top.where(F.col("__d").isNotNull()).select("__qn", F.col("__d").alias("d"), nth.alias("nth")).where(F.col("nth") == k)
    # cosine -> distance of unit vectors; fewer than k rows so far: all others
    theta = asked.join(kth, "__qn", "left").withColumn(
        "theta", F.when(F.col("d").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("d")))))
    two = materialize(theta.select("__qid", "__v", "__qn", "theta").mapInArrow(visits(True), pair_schema), "cell-visits")
    every = top.unionByName(search(two))
    w = Window.partitionBy("__qn").orderBy(F.asc_nulls_last("__d"), *[F.asc(f"`{n}`") for n in names])
    best = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    seen = one.unionByName(two).groupBy("__qn").agg(F.count(F.lit(1)).alias("cells_visited"))
    rows = best.join(seen, "__qn").join(asked.select("__qn", "__qid"), "__qn")
    return rows.select(F.col("__qid").cast(qid).alias(query_id), "rank", *[F.col(f"`{n}`") for n in names], (-F.col("__d")).alias("similarity"),
                       "cells_visited", (F.lit(len(table)) - F.col("cells_visited")).alias("cells_skipped"))
