"""Exact top-k search by inner product: best-first search in M-trees of bounded size.

1. Routes. A hashed sample of at most ``ROUTE_SAMPLE`` vectors gives the routing objects of the top level, ``MOST_ROUTES`` at most. Every vector
   goes to the nearest one; the count and the covering radius of each are taken over all vectors. What is larger than ``TREE_ROWS`` is
   cut into tiles by a hash of the vector.
2. Pages. Each tile is loaded into an M-tree of its own and written page by page. An entry of an inner page is a vector of the tile, the
   covering radius of the vectors below it, its distance from the entry above, and the page below; an entry of a leaf is a vector, that
   distance and the id. Inner products become a metric by one more component, ``sqrt(M - |x|^2)`` for the largest squared norm ``M`` of
   the tile, zero for a query: then ``d(q, x)^2 = |q|^2 + M - 2 qx``, and the nearest have the largest products.
3. Search. Blocks of queries take the page with the least lower bound first. ``|d(q, parent) - d(entry, parent)| - radius`` comes from stored
   numbers and leaves out entries before a product is computed, ``d(q, entry) - radius`` leaves out pages; both are compared with the
   distance of the k-th product so far, ties included. Products are exact integers.
4. Rounds. Each query searches the tile where its own vector would live; its k-th product there is the limit with which it visits
   all other tiles that the radius of their route does not rule out. A task has one tile and at most about ``QUERY_GROUP`` queries, whatever the
   size of the table.

Of equal vectors only the ``k + 1`` smallest ids can be among the k best, so only they are sent on: batch by batch, then tile by tile.

Nulls: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null id. Rows with one id
are one query, of which the greatest vector asks, and never each other's candidates; those with different vectors are candidates of their own, those
with equal ones count once. A shorter vector is as one with zeros behind it. A scaled component has to fit an int and a product
a long, or the job fails. No queries or no candidates give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm.store import forget, keep

K = 20
SCALE = 64
PAGE = 64
TREE_ROWS = 8192
MOST_ROUTES = 256
ROUTE_SAMPLE = 4096
QUERY_GROUP = 16384
QUERY_BLOCK = 64
BATCH = 4096
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
SLACK = 1e-6
KINDS = (np.int8, np.int16, np.int32)


# --- vectors ------------------------------------------------------------------------------------


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``id, v``: the vectors that take part, as whole numbers."""
    finite = F.forall(vector_column, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(vector_column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).cast("array<int>")
    return vectors.where(F.col(id_column).isNotNull() & finite).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; what a row lacks is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (sizes == width).all():
        return values.reshape(-1, width).astype(np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def pack(rows: np.ndarray) -> np.ndarray:
    """``rows`` in the smallest kind of integer that holds them."""
    most = int(np.abs(rows.astype(np.int64)).max(initial=0))
    return rows.astype(next(kind for kind in KINDS if most <= np.iinfo(kind).max or kind is np.int32))


def packed_rows(rows: np.ndarray) -> pa.Array:
    """Every row as bytes; the length tells the kind."""
    data = np.ascontiguousarray(pack(rows))
    size = data.shape[1] * data.itemsize
    offsets = pa.py_buffer((np.arange(len(data) + 1) * size).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, offsets, pa.py_buffer(data.tobytes())])


def unpack(data: bytes, width: int) -> np.ndarray:
    """One packed row."""
    return np.frombuffer(data, KINDS[(len(data) // width).bit_length() - 1])


def unpacked_rows(column: pa.Array, width: int) -> np.ndarray:
    rows = [unpack(data, width) for data in column.to_pylist()]
    return np.stack(rows).astype(np.int64) if rows else np.empty((0, width), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("an inner product may not fit a long")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64))


# --- routes -------------------------------------------------------------------------------------


class Routes:
    """The top level: routing objects, and over all vectors their counts and covering radii."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.width = pivots, pivots.shape[1]
        self.radii, self.tiles = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Route of each row and the distance from its pivot."""
        square = squares(rows)[:, None] + squares(self.pivots)[None] - 2.0 * products(rows, self.pivots)
        route = square.argmin(axis=1)
        return route, np.sqrt(np.maximum(square[np.arange(len(rows)), route], 0))


def first_ids(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest different ids of every vector."""
    if not len(ids):
        return np.empty(0, np.int64)
    data = np.ascontiguousarray(rows)
    key = np.unique(data.view(np.dtype((np.void, data.shape[1] * data.itemsize))).ravel(), return_inverse=True)[1]
    order = np.lexsort([ids, key])
    fresh = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(ids[order]) != 0)])
    order = order[fresh]
    start = np.concatenate([[True], np.diff(key[order]) != 0])
    turn = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return np.sort(order[turn < most])


def choose_routes(vectors: DataFrame) -> Routes | None:
    """Routing objects for ``vectors`` (id, v) from a hashed sample of ``ROUTE_SAMPLE`` rows; None if there are no vectors."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    width = max(width, 1)
    share = min(1.0, 1.5 * ROUTE_SAMPLE / n)
    place = F.xxhash64("id", "v")
    some = vectors.withColumn("place", place).where(F.col("place") <= F.lit(int(share * (2.0**64 - 2048)) - 2**63))
    sample = some.orderBy("place").limit(ROUTE_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    rows = matrix(sample, width) if len(sample) else np.zeros((1, width), np.int32)
    different = np.sort(np.unique(rows, axis=0, return_index=True)[1])
    return Routes(rows[different[: min(max(-(-n // TREE_ROWS), 1), MOST_ROUTES)]])


def route(vectors: DataFrame, routes: Routes, most: int | None) -> DataFrame:
    """``route, id, v, reach`` of all rows of ``vectors``; with ``most``, only the first ids of vectors that are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            ids, rows = part.column(0).to_numpy(), matrix(part.column(1), routes.width)
            if most:
                kept = first_ids(ids, rows, most)
                ids, rows = ids[kept], rows[kept]
            to, reach = routes.nearest(rows)
            columns = [pa.array(to.astype(np.int32)), pa.array(ids), packed_rows(rows), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(columns, names=["route", "id", "v", "reach"])

    return vectors.mapInArrow(run, "route int, id long, v binary, reach double")


def _tile(routes: Routes) -> F.Column:
    """Tile of a row in its route, by the vector, so that equal vectors meet; -1 where the route has no vectors."""
    tiles = F.element_at(F.array(*[F.lit(int(n)) for n in routes.tiles]), F.col("route") + 1)
    return F.when(tiles > 0, F.pmod(F.xxhash64("v"), tiles)).otherwise(-1).cast("int")


# --- pages --------------------------------------------------------------------------------------


class Loader:
    """Pages of an M-tree over ``rows``, bulk-loaded: pivots from the rows, each row to the nearest, the groups in turn."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        norms = squares(rows)
        self.top = float(norms.max(initial=0))
        self.more = np.sqrt(np.maximum(self.top - norms, 0))
        self.pages: list[tuple] = []

    def distances(self, some: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        inner = products(self.rows[some], self.rows[pivots]) + self.more[some][:, None] * self.more[pivots][None]
        return np.sqrt(np.maximum(2 * (self.top - inner), 0))

    def load(self, some: np.ndarray, parent: int | None = None) -> int:
        """Number of the page that holds ``some`` rows; a page comes after all pages below it."""
        if len(some) <= PAGE:
            entries, radii, links = some, np.zeros(len(some)), self.ids[some]
        else:
            fan = min(PAGE, -(-2 * len(some) // PAGE))
            pivots = some[np.arange(fan) * len(some) // fan]
            away = self.distances(some, pivots)
            nearest = away.argmin(axis=1)
            if (nearest == nearest[0]).all():  # equal rows: any way to part them is as good
                nearest = np.arange(len(some)) * fan // len(some)
            groups = [(p, some[nearest == i], away[nearest == i, i].max()) for i, p in enumerate(pivots) if (nearest == i).any()]
            entries, radii = np.array([p for p, _, _ in groups]), np.array([r for _, _, r in groups])
            links = np.array([self.load(rows, p) for p, rows, _ in groups], np.int64)
        from_parent = np.zeros(len(entries)) if parent is None else self.distances(entries, np.array([parent]))[:, 0]
        self.pages.append((len(some) > PAGE, entries, radii, from_parent, links))
        return len(self.pages) - 1


PAGES = "route int, tile int, page int, is_inner boolean, top double, entries binary, radii binary, from_parent binary, links binary"


def load_pages(routed: DataFrame, routes: Routes, most: int) -> DataFrame:
    """The pages of the trees of all tiles."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, vectors = rows.column("id").to_numpy(), unpacked_rows(rows.column("v"), routes.width)
        kept = first_ids(ids, vectors, most)
        # In the order of a hash, so that evenly spaced rows are a sample.
        kept = kept[np.argsort((ids[kept].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5555), kind="stable")]
        loader = Loader(ids[kept], vectors[kept])
        loader.load(np.arange(len(kept)))
        inner, entries, radii, from_parent, links = zip(*loader.pages)
        n = len(loader.pages)
        columns = [
            pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(inner),
            pa.array([loader.top] * n), pa.array([pack(loader.rows[e]).tobytes() for e in entries], pa.binary()),
            *[pa.array([x.tobytes() for x in part], pa.binary()) for part in (radii, from_parent, links)],
        ]
        return pa.table(columns, names=[f.split()[0] for f in PAGES.split(", ")])

    placed = routed.select("route", _tile(routes).alias("tile"), "id", "v")
    return placed.groupBy("route", "tile").applyInArrow(run, PAGES)


# --- search -------------------------------------------------------------------------------------


class Page:
    def __init__(self, is_inner: bool, entries: bytes, radii: bytes, from_parent: bytes, links: bytes, width: int):
        self.is_inner, self.links = is_inner, np.frombuffer(links, np.int64)
        self.radii, self.from_parent = np.frombuffer(radii), np.frombuffer(from_parent)
        kind = KINDS[(len(entries) // (width * len(self.links))).bit_length() - 1]
        self.entries = np.frombuffer(entries, kind).reshape(-1, width).astype(np.float64)


class Best:
    """The k best products of a block of queries, and the pair of product and id that a candidate has to beat."""

    def __init__(self, limits: np.ndarray, limit_ids: np.ndarray, k: int):
        self.scores = np.full((len(limits), k), NONE)
        self.ids = np.full((len(limits), k), LAST)
        self.limits, self.limit_ids = limits.copy(), limit_ids.copy()

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Products of the queries ``who`` with vectors of ``ids``, where ``fits``."""
        limit = self.limits[who][:, None]
        fits &= (scores > limit) | ((scores == limit) & (ids[None] < self.limit_ids[who][:, None]))
        some = np.nonzero(fits.any(axis=1))[0]
        if not len(some):
            return
        fits, rows, k = fits[some], who[some], self.scores.shape[1]
        scores = np.concatenate([self.scores[rows], np.where(fits, scores[some], NONE)], axis=1)
        ids = np.concatenate([self.ids[rows], np.where(fits, ids[None], LAST)], axis=1)
        # ~ turns the order around, and has no overflow.
        order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        full = rows[self.scores[rows, -1] != NONE]
        self.limits[full], self.limit_ids[full] = self.scores[full, -1], self.ids[full, -1]


def search_tree(pages: list[Page], top: float, own: np.ndarray, queries: np.ndarray, limits: np.ndarray, limit_ids: np.ndarray, k: int) -> Best:
    """The k best of the tree for each query; ``limits`` is what the k-th one has to beat (``NONE``: nothing)."""
    best = Best(limits, limit_ids, k)
    whole = squares(queries) + top
    slack = SLACK * np.sqrt(whole) + SLACK
    asked = queries.astype(np.float64)

    def reach(who: np.ndarray) -> np.ndarray:
        """Distance beyond which nothing is of use."""
        far = np.sqrt(np.maximum(whole[who] - 2.0 * best.limits[who], 0)) + slack[who]
        return np.where(best.limits[who] == NONE, np.inf, far)

    everyone = np.arange(len(queries))
    waiting = [(0.0, len(pages) - 1, everyone, None, np.zeros(len(queries)))]
    while waiting:
        _, number, who, from_parent, low = heapq.heappop(waiting)
        page, far = pages[number], reach(who)
        stay = low <= far
        if not stay.any():
            continue
        who, far = who[stay], far[stay]
        if from_parent is None:
            needed = np.ones((len(who), len(page.links)), bool)
        else:
            needed = np.abs(from_parent[stay][:, None] - page.from_parent[None]) - page.radii[None] <= far[:, None]
        at = np.nonzero(needed.any(axis=0))[0]
        if not len(at):
            continue
        needed, scores = needed[:, at], products(asked[who], page.entries[at])
        if not page.is_inner:
            ids = page.links[at]
            best.add(who, scores, ids, needed & (ids[None] != own[who][:, None]))
            continue
        away = np.sqrt(np.maximum(whole[who][:, None] - 2.0 * scores, 0))
        lows = np.maximum(away - page.radii[at][None], 0)
        needed &= lows <= far[:, None]
        for i, child in enumerate(page.links[at].tolist()):
            some = np.nonzero(needed[:, i])[0]
            if len(some):
                heapq.heappush(waiting, (float(lows[some, i].min()), child, who[some], away[some, i], lows[some, i]))
    return best


FOUND = "query long, v binary, route int, tile int, id long, score long"


def search_tiles(pages: DataFrame, visits: DataFrame, routes: Routes, groups: int, k: int) -> DataFrame:
    """``query, v, route, tile, id, score``: the best of each tile for the queries that visit it (route, tile, query, v, limit, limit_id)."""

    def run(key: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        parts = []
        if held.num_rows and asking.num_rows:
            held, asking = held.sort_by("page"), asking.sort_by([("home", "ascending"), ("query", "ascending")])
            fields = [held.column(c).to_pylist() for c in ("is_inner", "entries", "radii", "from_parent", "links")]
            tree, top = [Page(*fields, routes.width) for fields in zip(*fields)], held.column("top")[0].as_py()
            own, packed = asking.column("query").to_numpy(), asking.column("v").combine_chunks()
            limits, limit_ids = asking.column("limit").to_numpy(), asking.column("limit_id").to_numpy()
            for start in range(0, len(own), QUERY_BLOCK):
                some = slice(start, start + QUERY_BLOCK)
                queries = unpacked_rows(packed[some], routes.width)
                best = search_tree(tree, top, own[some], queries, limits[some], limit_ids[some], k)
                rows, turn = np.nonzero(best.scores != NONE)
                parts.append((start + rows, best.ids[rows, turn], best.scores[rows, turn]))
            rows, ids, scores = map(np.concatenate, zip(*parts))
            place = [pa.array(np.full(len(rows), part.as_py(), np.int32)) for part in key[:2]]
            columns = [pa.array(own[rows]), packed.take(pa.array(rows)), *place, pa.array(ids), pa.array(scores)]
        else:
            columns = [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        return pa.table(columns, names=[f.split()[0] for f in FOUND.split(", ")])

    copies = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    visits = visits.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    keys = ("route", "tile", "part")
    return copies.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(run, FOUND)


def further_tiles(limited: DataFrame, routes: Routes) -> DataFrame:
    """The tiles that may hold more for queries (query, v, home, home_tile, limit, limit_id), beside the tile they have searched."""
    tiles = [(r, t) for r, n in enumerate(routes.tiles.tolist()) for t in range(n)]
    name = ["route", "tile", "query", "v", "home", "limit", "limit_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, QUERY_BLOCK) for b in batches for i in range(0, b.num_rows, QUERY_BLOCK)):
            column = dict(zip(part.schema.names, part.columns))
            rows = unpacked_rows(column["v"], routes.width)
            home, home_tile, limit = (column[c].to_numpy() for c in ("home", "home_tile", "limit"))
            inner = products(rows, routes.pivots).astype(np.float64)
            length = np.sqrt(squares(rows))[:, None]
            most = inner + length * routes.radii[None]
            useful = (limit[:, None] == NONE) | (most + SLACK * (1 + length * (routes.radii[None] + 1)) + SLACK * np.abs(inner) >= limit[:, None])
            for r, t in tiles:
                some = np.nonzero(useful[:, r] & ((home != r) | (home_tile != t)))[0]
                if len(some):
                    take = pa.array(some)
                    place = [pa.array(np.full(len(some), x, np.int32)) for x in (r, t)]
                    yield pa.RecordBatch.from_arrays([*place, *[column[c].take(take) for c in name[2:]]], names=name)

    schema = "route int, tile int, query long, v binary, home int, limit long, limit_id long"
    return limited.mapInArrow(run, schema)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, id, score``: for every row of ``queries`` the k rows of ``vectors`` with another id and the largest products."""
    spark = vectors.sparkSession
    held = scaled(vectors, id_column, vector_column, scale)
    asking = scaled(queries, id_column, vector_column, scale).groupBy("id").agg(F.max("v").alias("v"))
    routes = choose_routes(held.unionByName(asking))
    if routes is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    routed, routed_path = keep(route(held, routes, k + 1), "routed")
    for r in routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect():
        routes.radii[r["route"]], routes.tiles[r["route"]] = r["reach"], -(-r["n"] // TREE_ROWS)
    pages, pages_path = keep(load_pages(routed, routes, k + 1), "pages")
    forget(spark, routed_path)
    asked, asked_path = keep(route(asking, routes, None), "asked")
    groups = max(-(-asked.count() // QUERY_GROUP), 1)
    # A route without a vector has no tile; its queries have nothing to begin with.
    home = asked.select(
        "route", _tile(routes).alias("tile"), F.col("id").alias("query"), "v", F.col("route").alias("home"),
        F.lit(int(NONE)).alias("limit"), F.lit(int(LAST)).alias("limit_id"),
    )
    near, near_path = keep(search_tiles(pages, home, routes, groups, k).select("query", "id", "score"), "near")
    last = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "id")).alias("last"))
    enough = F.coalesce(F.col("n") == k, F.lit(False))
    limited = home.drop("limit", "limit_id").join(last, "query", "left").select(
        "query", "v", "home", F.col("tile").alias("home_tile"),
        F.when(enough, -F.col("last.s")).otherwise(F.lit(int(NONE))).alias("limit"),
        F.when(enough, F.col("last.id")).otherwise(F.lit(int(LAST))).alias("limit_id"),
    )
    far = search_tiles(pages, further_tiles(limited, routes), routes, groups, k).select("query", "id", "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    ranked = near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)
    found, _ = keep(ranked.select(F.col("query").alias("query_id"), "rank", "id", "score"), "top")
    forget(spark, pages_path, asked_path, near_path)
    return found

