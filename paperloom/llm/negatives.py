"""Hard negatives by bounds along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, fresh_path

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors of a pass, about: what is broadcast and what a task keeps the best of. Candidates that a task judges at a time.
PASS_ANCHORS = 2_048
CHUNK = 8_192
#: One in so many candidates is looked at first; what it gives is a bound for all others.
HOME = 16
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
HITS = "anchor_id long, at int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(vec_id, label, q)`` with ``q = floor(256 * x)`` of each component. Rows with a null id or label, a null vector, or a
    null or non-finite component are left out; of rows of one id the one of the smallest label and vector stays."""
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector_column, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    usable = rows.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.coalesce(finite, F.lit(False)))
    shaped = usable.select(F.col(id_column).alias("vec_id"), F.struct(F.col(label_column).alias("label"), whole.alias("q")).alias("row"))
    return shaped.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


class AnchorTree:
    """A minimum spanning tree over anchors, walked from its root with the largest subtree of a node last.

    A walk so keeps the bounds of a logarithmic number of nodes.
    """

    def __init__(self, vectors: np.ndarray):
        points = vectors.astype(np.float64)
        count = len(points)
        away = np.full(count, np.inf)
        near = np.full(count, -1)
        waiting = np.ones(count, bool)
        order, at = [], 0
        for _ in range(count):
            order.append(at)
            waiting[at] = False
            found = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
            closer = waiting & (found < away)
            away[closer], near[closer] = found[closer], at
            at = int(np.where(waiting, away, np.inf).argmin())
        self.root = order[0]
        self.edges = away
        size = np.ones(count, np.int64)
        self.children: list[list[int]] = [[] for _ in range(count)]
        for at in reversed(order[1:]):
            size[near[at]] += size[at]
            self.children[near[at]].append(at)
        for own in self.children:
            own.sort(key=lambda child: -size[child])


@dataclass
class Search:
    """One pass: anchors with a tree, and for each of them windows of scores of which the best are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: AnchorTree
    #: Windows, an anchor's in a row; one that takes nothing has ``low`` above ``high``.
    low: np.ndarray
    high: np.ndarray
    best: int
    same_label: bool


def find(search: Search, candidates: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The best candidates of every window, of ``(ids, labels, vectors)`` in chunks.

    An anchor's score differs from its parent's by at most the length of their edge times the candidate's norm. So bounds
    are carried from the root along the edges; only candidates whose bounds reach into an anchor's windows are scored
    again, and start the next edges from their exact score. A window's lower end rises to its last best score.
    """
    count, windows = search.low.shape
    low = search.low.copy()
    scores = np.full((count, windows, search.best), LEAST, np.int64)
    ids = np.full((count, windows, search.best), MOST, np.int64)
    longest = float(np.sqrt((search.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    greatest = float(np.abs(search.vectors.astype(np.float64)).max(initial=0))

    def take(node: int, found: np.ndarray, whose: np.ndarray) -> None:
        for at in range(windows):
            inside = (found >= low[node, at]) & (found <= search.high[node, at])
            if not inside.any():
                continue
            every, all_ids = np.append(scores[node, at], found[inside]), np.append(ids[node, at], whose[inside])
            # Negating LEAST would overflow; its order is kept by counting from the top instead.
            order = np.lexsort((all_ids, ~every))[: search.best]
            scores[node, at], ids[node, at] = every[order], all_ids[order]
            low[node, at] = max(low[node, at], int(scores[node, at, -1]))

    for whose, labels, vectors in candidates:
        exact = vectors.shape[1] * greatest * float(np.abs(vectors.astype(np.float64)).max(initial=0)) < EXACT
        kind = np.float64 if exact else object
        own, asked = vectors.astype(kind), search.vectors.astype(kind)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        stack: list[tuple[int, np.ndarray | None, np.ndarray | None]] = [(search.tree.root, None, None)]
        while stack:
            node, least, most = stack.pop()
            if least is None:
                every = (own @ asked[node]).astype(np.int64)
                least, most = every.astype(np.float64), every.astype(np.float64)
                rows = np.arange(len(whose))
            else:
                reach = norms * (search.tree.edges[node] + 1e-9 * longest) + 1e-6
                least, most = least - reach, most + reach
                open_ = search.low[node] <= search.high[node]
                if open_.any():
                    bottom, top = float(low[node][open_].min()), float(search.high[node][open_].max())
                    rows = np.flatnonzero((most >= bottom) & (least <= top))
                else:
                    rows = np.zeros(0, np.int64)
                every = (own[rows] @ asked[node]).astype(np.int64)
                least[rows] = most[rows] = every
            fit = ((labels[rows] == search.labels[node]) == search.same_label) & (whose[rows] != search.ids[node])
            if fit.any():
                take(node, every[fit], whose[rows[fit]])
            stack += [(child, least, most) for child in search.tree.children[node]]
    node, at, place = np.nonzero(scores > LEAST)
    arrays = [pa.array(search.ids[node]), pa.array(at, pa.int32()), pa.array(ids[node, at, place]), pa.array(scores[node, at, place])]
    yield pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "at", "vec_id", "score"])


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = pa.compute.list_flatten(table["q"]).to_numpy().reshape(len(table), width)
        return table["vec_id"].to_numpy(), table["label"].to_numpy(), vectors

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(batch.num_rows for batch in held) >= CHUNK:
            yield joined()
            held = []
    if held:
        yield joined()


def _best(rows: DataFrame, search: Search) -> DataFrame:
    """``HITS`` of one pass over all ``rows``, the best of each window first.

    A share of the rows is searched first. Its last best scores, one number for each window, bound all other tasks, so what
    these send does not grow with their number.
    """
    spark, width = rows.sparkSession, search.vectors.shape[1]

    def hits(some: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from find(shared.value, _chunks(batches, width))

        return cut_lineage(some.select("vec_id", F.col("label").cast("long").alias("label"), "q").mapInArrow(run, HITS))

    order = Window.partitionBy("anchor_id", "at").orderBy(F.desc("score"), "vec_id")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.best)

    home = F.pmod(F.xxhash64("vec_id", F.lit("home")), F.lit(HOME)) == 0
    seen = cut_lineage(first(hits(rows.where(home))).drop("rank"))
    place = {anchor_id: nth for nth, anchor_id in enumerate(search.ids.tolist())}
    # At most one number for each window of the pass.
    for row in seen.groupBy("anchor_id", "at").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect():
        if row.n == search.best:
            nth = place[row.anchor_id]
            search.low[nth, row.at] = max(search.low[nth, row.at], row.last)
    return first(seen.union(hits(rows.where(~home))))


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    pass_anchors: int = PASS_ANCHORS,
) -> DataFrame:
    """``RESULT``: for each of ``anchors(vec_id, label, q)`` and each of its positives the best ``negatives`` rows of another
    label, ranked from 1, with ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Scores are integer inner products, higher first, ties by smaller ``vec_id``. An anchor's positives are its first
    ``positives`` other rows of its label (fewer, if there are fewer; none gives no rows). ``rows(vec_id, label, q)`` and
    anchors are as ``labelled`` returns them, one row for each id; only vectors of an anchor's length are compared with it.
    Equal vectors are candidates of their own; scores must fit 64 bits; empty tables give no rows.

    Anchors are taken in passes of about ``pass_anchors``, dealt by a hash of their id; a pass is broadcast and every task
    judges its share of all rows, so no row is sent to meet its anchors.
    """
    spark = rows.sparkSession
    width = F.size("q").alias("width")
    rows = cut_lineage(rows.select("vec_id", "label", "q", width))
    asked = cut_lineage(anchors.select("vec_id", "label", "q", width))
    path = fresh_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(f"{path}/pass=-1")
    passed = 0
    for length in sorted(asked.groupBy("width").agg(F.count("*").alias("n")).collect()):
        parts = -(-length.n // pass_anchors)
        part = F.pmod(F.xxhash64("vec_id", F.lit("pass")), F.lit(parts))
        near = rows.where(F.col("width") == length.width)
        for number in range(parts):
            chosen = asked.where((F.col("width") == length.width) & (part == number)).orderBy("vec_id").collect()
            if chosen:
                found = _pass(near, chosen, length.width, positives, negatives, low, high)
                found.write.parquet(f"{path}/pass={passed}")
                passed += 1
    return spark.read.schema(RESULT + ", pass int").parquet(path).drop("pass")


def _pass(rows: DataFrame, chosen: list, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result of one pass, whose anchors the driver holds."""
    spark = rows.sparkSession
    ids = np.array([row.vec_id for row in chosen], np.int64)
    labels = np.array([row.label for row in chosen], np.int64)
    vectors = np.array([row.q for row in chosen], np.int64).reshape(len(chosen), width)
    tree = AnchorTree(vectors)
    every = np.full((len(ids), 1), LEAST, np.int64), np.full((len(ids), 1), MOST, np.int64)
    place = {anchor_id: nth for nth, anchor_id in enumerate(ids.tolist())}
    # At most ``positives`` rows for each anchor of the pass.
    pairs = _best(rows, Search(ids, labels, vectors, tree, *every, positives, same_label=True)).collect()
    # Windows without a positive take nothing.
    least, most = np.full((len(ids), positives), MOST, np.int64), np.full((len(ids), positives), LEAST, np.int64)
    for pair in pairs:
        at = place[pair.anchor_id], pair.rank - 1
        least[at], most[at] = -(-low * pair.score // 100), high * pair.score // 100
    found = _best(rows, Search(ids, labels, vectors, tree, least, most, negatives, same_label=False))
    named = spark.createDataFrame(
        [(pair.anchor_id, pair.rank - 1, pair.vec_id, pair.score) for pair in pairs],
        "anchor_id long, at int, positive_id long, positive_score long",
    )
    return found.join(named, ["anchor_id", "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
