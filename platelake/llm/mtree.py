"""Exact top-k inner-product search in M-trees.

Inner products become a metric by one more coordinate: in a tree whose longest vector has norm R, a vector x gets
``sqrt(R^2 - |x|^2)`` and a query 0, so that ``distance^2 = |q|^2 + R^2 - 2 <q, x>``.  A tree consists of pages: an inner page
holds routing objects with covering radius and distance to the page's own routing object, a leaf page holds vectors with
that distance.  Search is best first by the lower bound ``distance to the routing object - radius``; an entry whose stored
parent distance already rules it out by the triangle inequality is passed over without computing its distance.

The trees are the branches of a root page of at most ``cells`` routing objects from a bounded sample; a cell larger than
``tree_rows`` is split by a hash into several trees.  First each query searches the cell nearest to it, which gives a lower
bound of its k-th score; then it visits only the cells whose bound can still reach that score.  Queries go to the trees in
blocks, trees are rows of a stored table, and equal vectors are one entry with their smallest ids.

Scores are integers and exact: bounds only decide what is skipped, with a slack above the rounding of doubles.

Defined cases: NULL vectors and those with NULL or non-finite components take no part; neither do vectors of another length
than the query's.  Rows with equal id and vector count once; an id with several vectors asks with each of them, its best
pairs are ranked together, and a query never returns its own id.  A component beyond 2 ** 62 after scaling is set to that
bound, a score beyond the range of long to the range's end.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platelake.llm.ids import as_key
from platelake.sources.workspace import stored

SCALE = 1024
LEAF, FANOUT = 256, 8
CELLS, TREE_ROWS, QUERY_BLOCK = 64, 8192, 4096


# Components and scores are held inside the range of long.
LARGEST, MOST = 2.0 ** 62, (1 << 63) - 1
ROUTE = "qid string, v array<bigint>, own long, cell int, least long"


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in the narrowest arithmetic that is exact."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if bound < 2 ** 52:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 2 ** 62:
        return rows @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows], dtype=object)


class MTree:
    """Pages over integer vectors (n x d) with the ids of each vector, smallest first."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], seed: int = 5):
        self.vectors, self.ids = vectors, ids
        x = vectors.astype(np.float64)
        norms = (x * x).sum(axis=1)
        self.far = float(norms.max(initial=0))
        self.points = np.hstack([x, np.sqrt(np.maximum(self.far - norms, 0))[:, None]])
        self.pages: list[tuple] = []
        rng = np.random.default_rng(seed)
        centre = self.points.mean(axis=0)
        self.root = self._page(np.arange(len(x)), centre, rng)
        self.centre, self.radius = centre, float(self._far(self.points, centre).max(initial=0))
        # Rows are laid out in the order of the leaf pages, which become slices.
        order = np.concatenate([p[1] for p in self.pages if p[0]])
        self.vectors, self.ids, self.points = vectors[order], [ids[i] for i in order], self.points[order]
        self.largest = float(np.abs(vectors).max(initial=0))
        at = 0
        for number, p in enumerate(self.pages):
            if p[0]:
                self.pages[number] = (True, at, p[2])
                at += len(p[2])

    @staticmethod
    def _far(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - at) ** 2).sum(axis=1))

    def _page(self, rows: np.ndarray, parent: np.ndarray, rng) -> int:
        """Add the page of ``rows`` (and those below it); returns its number."""
        here = self.points[rows]
        number = len(self.pages)
        self.pages.append(())
        if len(rows) <= LEAF:
            self.pages[number] = (True, rows, self._far(here, parent))
            return number
        # Routing objects: spread out by taking the point farthest from those chosen, on a sample of the page.
        sample = here[rng.choice(len(rows), min(len(rows), 512), replace=False)]
        chosen = [0]
        near = self._far(sample, sample[0])
        for _ in range(FANOUT - 1):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self._far(sample, sample[chosen[-1]]))
        objects = sample[chosen]
        owner = np.stack([self._far(here, o) for o in objects]).argmin(axis=0)
        if len(np.unique(owner)) < 2 or np.bincount(owner).max() > 0.9 * len(rows):  # no use: deal evenly
            owner = np.arange(len(rows)) % FANOUT
        objects = np.stack([here[owner == k].mean(axis=0) if (owner == k).any() else o for k, o in enumerate(objects)])
        keep = [k for k in range(FANOUT) if (owner == k).any()]
        radius = np.array([self._far(here[owner == k], objects[k]).max() for k in keep])
        below = np.array([self._page(rows[owner == k], objects[k], rng) for k in keep])
        self.pages[number] = (False, below, self._far(objects[keep], parent), objects[keep], radius)
        return number

    def search(self, q: np.ndarray, k: int, least: int | None = None, without: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), by score and then by smaller id; nothing below ``least``, nothing of the id ``without``."""
        query = np.append(q.astype(np.float64), 0.0)
        length = float(query @ query)
        slack = 1e-6 * (1.0 + np.sqrt(length + self.far))
        best: list[tuple] = []  # heap of (score, -id), worst first
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2 ** 52

        def reach() -> float:
            """Largest distance that can still matter."""
            low = best[0][0] if len(best) >= k else least
            if low is None:
                return np.inf
            if least is not None:
                low = max(low, least)
            return np.sqrt(max(length + self.far - 2.0 * float(low), 0.0)) + slack

        start = float(self._far(self.centre[None], query)[0])
        heap = [(max(start - self.radius, 0.0), self.root, start)]
        while heap:
            bound, number, to_parent = heapq.heappop(heap)
            if bound > reach():
                break
            page = self.pages[number]
            if page[0]:
                near = np.abs(page[2] - to_parent) <= reach()
                if not near.any():
                    continue
                rows = np.arange(page[1], page[1] + len(near)) if near.all() else page[1] + np.flatnonzero(near)
                if exact:  # integers below 2 ** 52 in doubles
                    own = self.points[rows[0]:rows[-1] + 1] if len(rows) == len(near) else self.points[rows]
                    scores = own @ query
                else:
                    scores = products(self.vectors[rows], q)
                low = best[0][0] if len(best) >= k else None
                low = least if low is None else low if least is None else max(low, least)
                if low is not None:
                    can = np.flatnonzero(scores >= low)
                    rows, scores = rows[can], scores[can]
                for at in np.argsort(-scores, kind="stable").tolist() if exact else range(len(rows)):
                    s = int(scores[at])
                    if len(best) >= k and s < best[0][0]:
                        continue
                    for i in self.ids[rows[at]][:k + 1].tolist():
                        if i == without:
                            continue
                        item = (s, -i)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                        else:
                            break
                continue
            _, below, to_object, objects, radius = page
            can = np.flatnonzero(np.abs(to_object - to_parent) - radius <= reach())
            if len(can) == 0:
                continue
            far = self._far(objects[can], query)
            for d, c in zip(far.tolist(), can.tolist()):
                low = max(d - float(radius[c]), 0.0)
                if low <= reach():
                    heapq.heappush(heap, (low, int(below[c]), d))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of floor(scale * x)), without the vectors that take no part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("embedding").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (embeddings.filter(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
            .select("vec_id", F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(
                F.lit(LARGEST), F.lit(float(scale)) * c))).cast("bigint")).alias("v")))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return ((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = CELLS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best rows of ``vectors`` (both vec_id, v).

    Queries with one vector share a search, which keeps one row more since their own one may take a place.  The vectors of an
    id that has several are searched one by one and pass over all rows of that id.
    """
    keep = k + 1
    same = Window.partitionBy("v").orderBy("vec_id")
    few = (vectors.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= keep)
           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    entries = stored(few.withColumn("dim", F.size("v")), "mtree-entries")
    several = (vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct().groupBy("vec_id").count()
               .filter("count > 1").select("vec_id", F.col("vec_id").alias("own")))
    name = F.concat_ws(" ", F.sha2(F.to_json("v"), 256), F.col("own").cast("string"))
    each = stored(queries.select("vec_id", "v").distinct().join(several, "vec_id", "left").withColumn("qid", name)
                  .withColumn("dim", F.size("v")), "mtree-queries")
    asked = each.groupBy("qid", "dim").agg(F.first("v").alias("v"), F.first("own").alias("own"))
    parts = []
    for dim in [r["dim"] for r in each.select("dim").distinct().collect()]:
        parts.append(_searched(entries.filter(F.col("dim") == dim).select("v", "ids"),
                               asked.filter(F.col("dim") == dim).select("qid", "v", "own"), keep, cells, tree_rows))
    spark = vectors.sparkSession
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (each.select(F.col("vec_id").alias("query_id"), "qid").join(found, "qid").filter("vec_id != query_id")
            .select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _searched(entries: DataFrame, asked: DataFrame, keep: int, cells: int, tree_rows: int) -> DataFrame:
    """qid, vec_id, score: the ``keep`` best rows of each distinct query vector."""
    picked = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(cells).collect()
    if not picked:
        return entries.sparkSession.createDataFrame([], "qid string, vec_id long, score long")
    centres = np.array([r["v"] for r in picked], np.float64)

    def assigned(batches):
        for pdf in batches:
            x = np.stack(pdf["v"]) if len(pdf) else np.empty((0, centres.shape[1]))
            cell = _nearest(x, centres)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell.astype("int32"), far=far)

    dealt = stored(entries.mapInPandas(assigned, "v array<bigint>, ids array<bigint>, cell int, far double"), "mtree-cells")
    stats = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # <= cells rows
    radius = np.full(len(centres), -np.inf)
    split = {}
    for r in stats:
        radius[r["cell"]] = r["radius"]
        split[r["cell"]] = -(-r["n"] // tree_rows)
    trees_of = F.element_at(F.lit([split.get(c, 1) for c in range(len(centres))]), F.col("cell") + 1)
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("v", F.lit(3)), trees_of).cast("int"))

    def built(key, pdf):
        tree = MTree(np.stack(pdf["v"]).astype(np.int64), [np.asarray(i, np.int64) for i in pdf["ids"]])
        return pd.DataFrame({"cell": [key[0]], "tree": [key[1]], "pages": [pickle.dumps(tree, 5)]})

    trees = stored(dealt.groupBy("cell", "tree").applyInPandas(built, "cell int, tree int, pages binary"), "mtree-trees")

    def nearest(batches):
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf["qid"], "v": pdf["v"], "own": pd.array([None if o == "" else int(o) for o in pdf["own"]], dtype="Int64"),
                                "cell": _nearest(np.stack(pdf["v"]), centres).astype("int32") if len(pdf) else [],
                                "least": None})

    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def visited(routes: DataFrame) -> DataFrame:
        """Search the trees of the routes' cells; routes: qid, v, own, cell, least."""
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")
        grouped = routes.groupBy("cell", block).agg(F.collect_list(F.struct("qid", "v", "own", "least")).alias("asked"))

        def run(batches):
            for pdf in batches:
                for pages, wanted in zip(pdf["pages"], pdf["asked"]):
                    tree, rows = pickle.loads(pages), []
                    for w in wanted:
                        least, own = (None if pd.isna(w[c]) else int(w[c]) for c in ("least", "own"))
                        got = tree.search(np.asarray(w["v"], np.int64), keep, least=least, without=own)
                        rows += [(w["qid"], i, max(min(s, MOST), -MOST)) for s, i in got]
                    yield pd.DataFrame(rows, columns=["qid", "vec_id", "score"]).astype({"vec_id": "int64", "score": "int64"})

        found = trees.join(grouped, "cell").repartition("cell", "tree", "block").select("pages", "asked")
        return found.mapInPandas(run, "qid string, vec_id long, score long")

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    routes = asked.select("qid", "v", as_key("own")).mapInPandas(nearest, ROUTE)
    first = stored(visited(routes), "mtree-first")
    kth = (first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == keep)
           .select("qid", F.col("score").alias("least")))
    started = routes.select("qid", "v", "own", F.col("cell").alias("home")).join(kth, "qid", "left")

    def reachable(batches):
        for pdf in batches:
            rows = []
            for qid, v, own, home, least in zip(*(pdf[c] for c in ("qid", "v", "own", "home", "least"))):
                q = np.asarray(v, np.float64)
                bound = centres @ q + np.sqrt(q @ q) * radius
                bound = bound + 1e-6 * (1 + np.abs(bound))
                for c in np.flatnonzero(np.isfinite(radius)):
                    if c != home and (least == "" or bound[c] >= int(least)):
                        rows.append((qid, v, None if own == "" else int(own), int(c), None if least == "" else int(least)))
            yield pd.DataFrame(rows, columns=["qid", "v", "own", "cell", "least"]).astype({"own": "Int64", "least": "Int64"})

    rest = started.select("qid", "v", as_key("own"), "home", as_key("least")).mapInPandas(reachable, ROUTE)
    both = first.union(visited(rest))
    return (both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
            .select("qid", "vec_id", "score"))
