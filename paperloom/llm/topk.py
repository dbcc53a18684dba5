"""Exact top-k by inner product: a ball tree per shard, branch and bound, a shared k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

SCALE = 256
K = 5
#: Vectors of a shard's tree, vectors of a leaf, queries of a block.
SHARD = 8_192
LEAF = 128
BLOCK = 1_024
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
HITS = "query_id long, vec_id long, score long"
LEAST = -(1 << 63)


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` with ``q = floor(256 * x)`` of each component; vectors with a null or non-finite one are left out."""
    usable = F.col(vector_column).isNotNull() & F.forall(
        vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    floor = F.transform(vector_column, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_column).alias("vec_id"), floor.alias("q"))


class BallTree:
    """Balls over blocks of vectors, each split at the median of its widest direction until a leaf's size.

    ``order`` puts the vectors of every node next to each other.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []
        self._vectors, self._leaf = vectors.astype(np.float64), leaf
        self.centres, self.radii = [], []
        self._grow(0, len(vectors))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.vectors = vectors[self.order]

    def _grow(self, low: int, high: int) -> int:
        own = self._vectors[self.order[low:high]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(self.nodes)
        self.nodes.append((low, high, -1, -1))
        self.centres.append(centre)
        self.radii.append(away.max())
        if high - low > self._leaf and away.max() > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(own @ (other - one), half)]
            self.nodes[node] = (low, high, self._grow(low, low + half), self._grow(low + half, high))
        return node


class Best:
    """The k best of each query so far: higher scores first, smaller ids among equal scores."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.scores = np.full((queries, k), LEAST, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        every = np.concatenate([self.scores[rows], scores], axis=1)
        whose = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        whose = np.where(every == LEAST, np.iinfo(np.int64).max, whose)
        k = self.scores.shape[1]
        # Negating LEAST would overflow; its order is kept by counting from the top instead.
        order = np.lexsort((whose, ~every), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(every, order, 1)
        self.ids[rows] = np.take_along_axis(whose, order, 1)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """Branch and bound for a block of queries: nodes by their upper bound, a node only for the queries whose k-th score
    it may reach. Equal bounds are followed, for a smaller id."""
    exact = tree.vectors.shape[1] * float(np.abs(tree.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) < EXACT
    kind = np.float64 if exact else object
    own, asked = tree.vectors.astype(kind), queries.astype(kind)
    real = queries.astype(np.float64)
    length = np.sqrt((real**2).sum(axis=1))
    bounds = real @ tree.centres.T + length[:, None] * tree.radii
    bounds += 1e-9 * (length[:, None] * (np.sqrt((tree.centres**2).sum(axis=1)) + tree.radii)) + 1e-6
    waiting = [(-float(bounds[:, 0].max(initial=-np.inf)), 0)]
    import heapq

    while waiting:
        _, node = heapq.heappop(waiting)
        rows = np.flatnonzero(bounds[:, node] >= best.kth())
        if not len(rows):
            continue
        low, high, left, right = tree.nodes[node]
        if left < 0:
            scores = (asked[rows] @ own[low:high].T).astype(np.int64)
            whose = ids[tree.order[low:high]]
            scores[query_ids[rows][:, None] == whose[None, :]] = LEAST
            best.add(rows, scores, whose[None, :])
        else:
            for child in (left, right):
                heapq.heappush(waiting, (-float((bounds[rows, child]).max()), child))


def _matrix(cells: pa.ListArray) -> np.ndarray:
    return cells.flatten().to_numpy().reshape(len(cells), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries(vec_id, q)`` the ``k`` largest integer inner products
    with ``vectors(vec_id, q)``, itself left out; ties go to the smaller ``vec_id``.

    Vectors are dealt by a hash into shards, queries into blocks. A first pass takes each block through one shard; its
    k-th scores then go with the block to all other shards, and within a task they rise from leaf to leaf. Of equal
    vectors only the ``k + 1`` of smallest id can be among the best of any query, so the others stay out of the shards.

    Only vectors of the query's length are candidates. A vector of length 0 scores 0. Equal rows, of one ``vec_id`` and
    one vector, count once; rows with a null ``vec_id`` take no part. Scores must fit 64 bits. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    shape = [F.size("q").alias("width"), "vec_id", "q"]
    alike = Window.partitionBy("q").orderBy("vec_id")
    rows = vectors.where("vec_id is not null").select(*shape).distinct().withColumn("nth", F.row_number().over(alike))
    rows = rows.where(F.col("nth") <= k + 1).drop("nth")
    asked = queries.where("vec_id is not null").select(*shape).distinct()
    counts = [{row.width: row.n for row in df.groupBy("width").agg(F.count("*").alias("n")).collect()} for df in (rows, asked)]

    def dealt(df: DataFrame, size: int, per: dict[int, int], name: str) -> DataFrame:
        """``(width, name, ids, q)``: a row for each group of about ``size`` vectors."""
        groups = spark.createDataFrame([(width, -(-n // size)) for width, n in per.items()], "width int, parts int")
        cell = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col("parts")).cast("int")
        split = df.join(F.broadcast(groups), "width").select("width", cell.alias(name), F.struct("vec_id", "q").alias("v"))
        one = split.groupBy("width", name).agg(F.sort_array(F.collect_list("v")).alias("v"))
        return one.select("width", name, F.col("v.vec_id").alias(f"{name}_ids"), F.col("v.q").alias(f"{name}_q"))

    # Bounded lists: a shard or block holds about its fixed number of vectors, however many there are.
    shards = cut_lineage(dealt(rows, shard, counts[0], "shard"))
    blocks = cut_lineage(dealt(asked, block, counts[1], "block"))
    shards_of = spark.createDataFrame([(w, -(-n // shard)) for w, n in counts[0].items()], "width int, shards int")
    blocks_of = spark.createDataFrame([(w, -(-n // block)) for w, n in counts[1].items()], "width int, blocks int")

    def cells(home: bool, floors: DataFrame | None) -> DataFrame:
        """Every block with its home shard, or with all others, and the k-th scores known so far."""
        places = F.sequence(F.lit(0), F.col("shards") - 1)
        first = F.pmod("block", "shards")
        places = F.array(first) if home else F.filter(places, lambda n: n != first)
        wanted = blocks.join(F.broadcast(shards_of), "width")
        if floors is not None:
            wanted = wanted.join(floors, ["width", "block"], "left")
        wanted = wanted.withColumn("shard", F.explode(places))
        reach = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda n: n.cast("int"))
        met = F.pmod(F.col("block"), F.col("shards")) == F.col("shard")
        copies = shards.join(F.broadcast(blocks_of), "width").join(F.broadcast(shards_of), "width")
        copies = copies.withColumn("block", F.explode(reach)).where(met if home else ~met).drop("shards", "blocks")
        return wanted.drop("shards").join(copies, ["width", "block", "shard"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in range(batch.num_rows):
                one = batch.slice(nth, 1)
                ids, asking = (one.column(name).flatten().to_numpy() for name in ("shard_ids", "block_ids"))
                own, queries_ = _matrix(one.column("shard_q").flatten()), _matrix(one.column("block_q").flatten())
                floors = one.column("floors").flatten().to_numpy() if one.column("floors")[0].is_valid else np.full(len(asking), LEAST)
                best = Best(len(asking), k, floors)
                search(BallTree(own), ids, queries_, asking, best)
                row, place = np.nonzero(best.scores > LEAST)
                arrays = [pa.array(asking[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    columns = ["shard_ids", "shard_q", "block_ids", "block_q", "floors"]
    home = cells(True, None).withColumn("floors", F.lit(None).cast("array<long>"))
    seen = cut_lineage(home.select(*columns).mapInArrow(find, HITS))
    kth = seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("kth"))
    listed = blocks.select("width", "block", F.posexplode("block_ids").alias("nth", "query_id"))
    known = listed.join(kth, "query_id", "left").select(
        "width", "block", F.struct("nth", F.coalesce("kth", F.lit(LEAST)).alias("kth")).alias("f")
    )
    floors = known.groupBy("width", "block").agg(F.sort_array(F.collect_list("f")).getField("kth").alias("floors"))
    more = cells(False, floors).select(*columns).mapInArrow(find, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = seen.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
