"""Approximate nearest neighbours: balanced posting lists below an in-memory graph of centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.batches import pieces
from folioscope.runtime import drop, settled, small_batches, written

#: Vectors that centroids, graph and distance ratio are fitted on at most, and their bytes: those with the smallest hash.
MAX_SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
#: Distinct vectors for each list; there are half as many lists as vectors in the sample at most, and beyond, lists grow and are dealt over more tasks.
PER_LIST = 8
#: Lists that a boundary vector is in at most, and how much farther than the nearest these may be.
REPLICAS, BOUNDARY = 4, 1.15
#: Neighbours of a centroid in the graph; centroids of a point that one step of a walk expands.
DEGREE, WIDTH = 24, 4
#: A centroid that fewer have as a neighbour is linked from so many of its own nearest: few walks would come by it else.
BACK = 12
#: The distance that others are compared with is that of a query's REFERENCE-th nearest centroid: the nearest may hold the query itself.
REFERENCE = 16
#: Entries of lists, their bytes, and queries that meet in one task at most; larger lists are dealt over several.
MAX_VECTORS, MEET_BYTES, MAX_QUERIES = 16_384, 32 << 20, 4096
#: Share of true neighbours that the fitted ratio finds in the sample.
TARGET = 0.925


def _balanced(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of at most `lists` clusters of nearly equal size, near ones side by side.

    Clusters are halved along their widest direction until there are enough; then points move
    to the nearest centre, where a centre counts as farther the more points it has. Centres lie
    on the sphere that lifted vectors lie on, so a list of many directions is no nearer than one of few.
    """
    rng = np.random.default_rng(7)
    clusters = [np.arange(len(points))]
    while len(clusters) < lists:
        most = max(map(len, clusters))
        if most < 2:
            break
        split, room = [], lists - len(clusters)
        for now in clusters:
            own = points[now]
            spread = own - own.mean(axis=0)
            if room <= 0 or len(now) < 2 or 2 * len(now) <= most or not np.abs(spread).max() > 1e-9:
                split.append(now)
                continue
            axis = rng.standard_normal(points.shape[1])
            for _ in range(3):
                axis = spread.T @ (spread @ axis)
                axis /= max(np.linalg.norm(axis), 1e-30)
            order = np.argsort(spread @ axis, kind="stable")
            split += [now[order[: len(now) // 2]], now[order[len(now) // 2 :]]]
            room -= 1
        if len(split) == len(clusters):
            break
        clusters = split
    radius = float(np.sqrt((points * points).sum(axis=1).max()))
    centres = _on_sphere(np.array([points[x].mean(axis=0) for x in clusters]), radius)
    sizes = np.array([len(x) for x in clusters], np.float64)
    for _ in range(4):
        own = np.concatenate([np.argmin(_squares(points[a : a + 2048], centres) * (0.9 + 0.1 * np.sqrt(sizes / sizes.mean())), axis=1) for a in range(0, len(points), 2048)])
        sizes = np.bincount(own, minlength=len(centres)).astype(np.float64)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = _on_sphere(np.where(sizes[:, None] > 0, sums, centres), radius)
    return centres


@dataclass
class Centroids:
    """Centres of the lists, with a graph over them that a search walks best first."""

    centres: np.ndarray
    edges: np.ndarray
    entries: np.ndarray
    top: float  # the largest norm; vectors get a coordinate that lifts them to it, queries a zero
    ratio: float = 2.0
    pool: int = 64  # centroids that a query's first walk looks for

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, top: float, neighbours: int = 20) -> Centroids:
        """neighbours: how many of the sample's vectors stand for a query's nearest of all, as a sample holds a share of these."""
        lifted = lift(sample, top)
        centres = _balanced(lifted, lists)
        k = len(centres)
        degree = min(DEGREE, k)
        near = np.concatenate([np.argpartition(_squares(centres[a : a + 1024], centres), degree - 1, axis=1)[:, :degree] for a in range(0, k, 1024)])
        # A ring over all centroids keeps the graph connected.
        ring = ((np.arange(k)[:, None] + np.array([1, -1])) % k).astype(near.dtype)
        out = cls(centres, np.concatenate([near, ring, _back(near, _squares_of(near, centres))], axis=1), np.unique(np.linspace(0, k - 1, min(32, k)).astype(int)), top)
        out._fit_ratio(sample, lifted, neighbours)
        return out

    def _fit_ratio(self, sample: np.ndarray, lifted: np.ndarray, neighbours: int) -> None:
        """Take the distance ratio within which TARGET of the sample's true neighbours have a list."""
        if len(sample) <= neighbours:
            self.ratio = np.inf
            return
        queries = np.arange(0, len(sample), max(1, len(sample) // 256))
        scores = sample[queries] @ sample.T
        scores[np.arange(len(queries)), queries] = -np.inf
        best = np.argpartition(-scores, neighbours - 1, axis=1)[:, :neighbours]
        needed, at = np.unique(best, return_inverse=True)
        lists = self.assign(lifted[needed])
        padded = np.array([np.resize(x, REPLICAS) for x in lists])[at.reshape(best.shape)]  # repeats its lists
        ratios, every = [], []
        for q, own in zip(queries, padded, strict=True):
            far = np.sqrt(_squares(flat(sample[q : q + 1], self.top), self.centres)[0])
            known = min(REFERENCE, len(far)) - 1
            every.append(np.sort(far) / max(np.partition(far, known)[known], 1e-12))
            ratios += (far[own].min(axis=1) / max(np.partition(far, known)[known], 1e-12)).tolist()
        self.ratio = float(np.quantile(ratios, TARGET)) * (1 + 1e-9)
        self.pool = max(64, int(1.5 * np.mean([np.searchsorted(x, self.ratio, side="right") for x in every])))

    def walk(self, points: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the `pool` nearest to each point, nearest first, that a best-first walk over the graph finds.

        Each step expands the nearest centroids of a point's pool that aren't expanded yet; the walk ends when all are. A walk
        whose pool is an eighth of the graph would see all of it, and is a scan.
        """
        m, k = len(points), len(self.centres)
        pool = min(pool, k)
        if 8 * pool >= k:
            far = _squares(points, self.centres)
            near = np.argpartition(far, pool - 1, axis=1)[:, :pool]
            value = np.take_along_axis(far, near, axis=1)
        else:
            rows = np.arange(m)[:, None]
            seen = np.zeros((m, k), bool)
            seen[:, self.entries] = True
            near = np.broadcast_to(self.entries, (m, len(self.entries)))
            value = _squares(points, self.centres[self.entries])
            open_ = np.ones(near.shape, bool)
            while True:
                step = np.argpartition(np.where(open_, value, np.inf), min(WIDTH, near.shape[1]) - 1, axis=1)[:, :WIDTH]
                go = np.take_along_axis(open_, step, axis=1)
                if not go.any():
                    break
                np.put_along_axis(open_, step, False, axis=1)
                r, _ = np.nonzero(go)
                found = self.edges[near[rows, step][go]]
                key = (r[:, None] * k + found).ravel()
                key = np.sort(key[~seen.ravel()[key]])
                key = key[np.diff(key, prepend=-1) > 0]
                seen.ravel()[key] = True
                r, c = key // k, key % k
                d = self.centres[c] - points[r]
                count = np.bincount(r, minlength=m)
                place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                more = np.zeros((m, count.max(initial=0)), near.dtype)
                far = np.full(more.shape, np.inf)
                more[r, place], far[r, place] = c, np.einsum("ij,ij->i", d, d)
                near, value = np.concatenate([near, more], axis=1), np.concatenate([value, far], axis=1)
                open_ = np.concatenate([open_, np.isfinite(far)], axis=1)
                if near.shape[1] > pool:
                    keep = np.argpartition(value, pool - 1, axis=1)[:, :pool]
                    near, value, open_ = near[rows, keep], value[rows, keep], open_[rows, keep]
        order = np.lexsort((near, value), axis=1)
        return np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)

    def within(self, points: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Per point the centroids, nearest first, whose distance is at most `ratio` times that of the REFERENCE-th.

        sizes: entries of each list; a point goes on until its lists hold `least` of them or none is left.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(points)
        left, pool = np.arange(len(points)), self.pool
        bound = min(ratio, 1e6) ** 2 * (1 + 1e-12)
        while len(left):
            again = []
            for a in range(0, len(left), 256):
                rows = left[a : a + 256]
                near, value = self.walk(points[rows], pool)
                inside = (value <= value[:, min(REFERENCE, value.shape[1]) - 1, None] * bound).sum(axis=1)
                held = np.cumsum(sizes[near], axis=1)
                n = np.maximum(inside, (held < least).sum(axis=1) + 1)
                for i, row in enumerate(rows):
                    if n[i] < near.shape[1] or near.shape[1] == len(self.centres):
                        own = near[i, : n[i]]
                        out[row] = own[np.isfinite(value[i, : n[i]]) & (sizes[own] > 0)]
                    else:
                        again.append(row)
            left, pool = np.array(again, np.int64), 4 * pool
        return out

    def assign(self, lifted: np.ndarray) -> list[np.ndarray]:
        """Per vector its lists: the nearest, and for a boundary vector all others that are about as near, REPLICAS at most."""
        out: list[np.ndarray] = []
        for a in range(0, len(lifted), 256):
            near, value = self.walk(lifted[a : a + 256], 8 * REPLICAS)
            n = np.minimum((value <= value[:, :1] * BOUNDARY**2).sum(axis=1), REPLICAS)
            out += [x[:c] for x, c in zip(near, n.tolist(), strict=True)]
        return out


def _squares_of(near: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each centre to its neighbours."""
    return np.array([((centres[x] - c) ** 2).sum(axis=1) for x, c in zip(near, centres, strict=True)])


def _back(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each centroid, those that it is among the BACK nearest of and that fewer than BACK have as a neighbour; rows are filled up with itself."""
    k = len(near)
    rare = np.flatnonzero(np.bincount(near.ravel(), minlength=k) < BACK)
    nearest = np.take_along_axis(near, np.argsort(far, axis=1), axis=1)[rare, :BACK]
    at, to = nearest.ravel(), np.repeat(rare, nearest.shape[1])
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    count = np.bincount(at, minlength=k)
    out = np.repeat(np.arange(k)[:, None], count.max(initial=0), axis=1).astype(near.dtype)
    out[at, np.arange(len(at)) - (np.cumsum(count) - count)[at]] = to
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)


def _on_sphere(points: np.ndarray, radius: float) -> np.ndarray:
    return points * (radius / np.maximum(np.sqrt((points * points).sum(axis=1)), 1e-300))[:, None]


def lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one coordinate more, which brings all to the norm `top`: the nearest to a flat query has the largest inner product with it."""
    return np.concatenate([vectors, np.sqrt(np.maximum(top * top - (vectors * vectors).sum(axis=1), 0))[:, None]], axis=1)


def flat(queries: np.ndarray, top: float) -> np.ndarray:
    """Queries in the lifted space, at the norm `top`: their length doesn't change which vector is nearest."""
    return np.concatenate([_on_sphere(queries, top), np.zeros((len(queries), 1))], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in the order of the coordinates: equal pairs give equal sums."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_of(rough: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], count: int) -> list[list[tuple[float, int]]]:
    """Per query the `count` best (-score, id) among the vectors with a finite rough score, each of which stands for some ids; ties to smaller ids."""
    out = []
    for query, row in zip(queries, rough, strict=True):
        edge = np.partition(row, -count)[-count] if len(row) > count else -np.inf
        near = np.flatnonzero((row >= edge - 1e-9 * max(1.0, abs(edge) if np.isfinite(edge) else 1.0)) & np.isfinite(row))
        scores = _exact(np.broadcast_to(query, (len(near), len(query))), vectors[near])
        out.append(sorted((-s, x) for k, s in zip(near, scores.tolist(), strict=True) for x in ids[k])[:count])
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) without null, zero, non-finite or null-holding vectors and null ids; vec stays an array of floats or becomes one of doubles."""
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(good & F.exists("vec", lambda x: x != 0))


def _groups(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each list, parts of each group): neighbouring lists share a group of at most `most` entries; a longer list is dealt over parts."""
    group, parts, size = np.zeros(len(held), np.int64), [1], 0
    for k, n in enumerate(held.tolist()):
        if size and size + n > most:
            parts.append(1)
            size = 0
        group[k] = len(parts) - 1
        parts[-1] = max(1, -(-n // most))
        size += n
    return group, np.array(parts)


def search(vectors: DataFrame, query_rows: DataFrame, count: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, compared) of the `count` nearest by inner product of each query, itself left out.

    vectors and query_rows have id_col and vec_col; a query's own id is no candidate. Vectors
    that are null, zero or not finite, and those of another length than most, take no part.
    Equal vectors are one entry with their count + 1 smallest ids, which is all that a
    result can hold, so neither a hot vector nor its queries weigh more than one.
    Repeated ids with one vector count once. Extra columns are ignored.

    Distinct vectors go to balanced lists; a boundary vector goes to several. Queries walk the
    graph of centroids and keep the lists within the fitted distance ratio. Neighbouring lists
    and the queries that chose any of them meet in tasks of bounded size, where a query is compared
    with its own lists alone; the best of each task are merged per query. The result is a
    table in the shared folder; what led to it is removed.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double, compared long"
    all_rows = usable(vectors, id_col, vec_col)
    lengths = all_rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, kind = lengths[0]["width"], all_rows.schema["vec"].dataType.simpleString()
    rows = all_rows.filter(F.size("vec") == width).distinct()
    asked = usable(query_rows, id_col, vec_col).withColumn("vec", F.col("vec").cast(kind)).filter(F.size("vec") == width).distinct()
    # The limit on ranks runs before the shuffle as well, so a hot vector sends count + 1 ids of each task.
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("k") <= count + 1)
    distinct = written(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = distinct.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    sample = distinct.orderBy(F.xxhash64("vec"), F.col("ids")[0]).limit(max(256, min(MAX_SAMPLE, SAMPLE_BYTES // (8 * width)))).select("vec").toArrow()
    lists = max(1, min(sample.num_rows // 2, -(-facts["n"] // PER_LIST)))
    share = math.ceil(count * sample.num_rows / facts["n"])
    fitted = Centroids.fit(_matrix(sample.column("vec"), width), lists, float(np.sqrt(facts["top"])), max(4, share))
    # Half the sample's size at most, and DEGREE + 2 edges of each, whatever the input.
    shared = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = shared.value.assign(lift(_matrix(batch.column("vec"), width), shared.value.top))
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            columns = [pa.array(np.concatenate(own) if own else [], pa.int64()), batch.column("vec").take(pa.array(at)), batch.column("ids").take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "vec", "ids"])

    postings = written(distinct.mapInArrow(place, f"list long, vec {kind}, ids array<long>"), "postings")
    drop(distinct)
    held = {x["list"]: x["count"] for x in postings.groupBy("list").count().collect()}  # one row a list
    sizes = np.array([held.get(k, 0) for k in range(len(fitted.centres))], np.int64)
    most = max(64, min(MAX_VECTORS, MEET_BYTES // (8 * width)))
    group, vparts = _groups(sizes, most)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            # REPLICAS entries at most are one vector.
            own = shared.value.within(flat(_matrix(batch.column("vec"), width), shared.value.top), shared.value.ratio, sizes, REPLICAS * (count + 1))
            names, at, chosen = [], [], []
            for i, x in enumerate(own):
                x = np.sort(x)  # neighbouring lists have neighbouring groups
                cuts = np.flatnonzero(np.diff(group[x], prepend=-1, append=-1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    names.append(int(group[x[a]]))
                    at.append(i)
                    chosen.append(x[a:b])
            columns = [pa.array(names, pa.int64()), batch.column("query").take(pa.array(at, pa.int64())), batch.column("vec").take(pa.array(at, pa.int64())), pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "query", "vec", "lists"])

    # One search for all queries with the same vector, under the smallest of their ids.
    reps = asked.groupBy("vec").agg(F.min("id").alias("query"))
    probes = written(reps.repartition("query").select("query", "vec").mapInArrow(probe, f"group long, query long, vec {kind}, lists array<int>"), "probes")
    wanted = {x["group"]: x["count"] for x in probes.groupBy("group").count().collect()}  # one row a group
    deal = spark.createDataFrame([(k, int(n), -(-wanted.get(k, 1) // MAX_QUERIES)) for k, n in enumerate(vparts)], "group long, vparts int, qparts int")
    of_list = spark.createDataFrame([(k, int(g)) for k, g in enumerate(group)], "list long, group long").join(deal, "group")
    left = (
        probes.join(F.broadcast(deal), "group")
        .withColumn("qpart", F.pmod(F.xxhash64("query"), F.col("qparts")))
        .withColumn("vpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vparts").cast("long") - 1)))
        .select("group", "vpart", "qpart", "query", "vec", "lists")
    )
    right = (
        postings.join(F.broadcast(of_list), "list")
        .withColumn("vpart", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("vparts")))
        .withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts").cast("long") - 1)))
        .select("group", "vpart", "qpart", "list", "vec", "ids")
    )

    def meet(queries: pa.Table, own: pa.Table) -> pa.Table:
        # One row a query: its best here, as (score turned round, id), which sorts nearest first and ties to smaller ids.
        names, best, seen = [], [], []
        if queries.num_rows and own.num_rows:
            asked_vecs, names = _matrix(queries.column("vec"), width), queries.column("query").to_pylist()
            lists, at = np.unique(own.column("list").to_numpy(), return_inverse=True)
            ids = own.column("ids").to_pylist()
            _, first, column = np.unique([x[0] for x in ids], return_index=True, return_inverse=True)  # a replicated vector is one column
            held_vecs, ids = _matrix(own.column("vec").take(pa.array(first)), width), [ids[k] for k in first]
            members = [np.unique(column[at == k]) for k in range(len(lists))]
            chosen = queries.column("lists").to_pylist()
            for a in range(0, len(names), 256):
                rough = np.full((len(names[a : a + 256]), len(ids)), -np.inf)
                by_list: dict[int, list[int]] = {}
                for i, x in enumerate(chosen[a : a + 256]):
                    for k in x:
                        by_list.setdefault(k, []).append(i)
                for k, x in enumerate(lists.tolist()):
                    if x in by_list:
                        rough[np.ix_(by_list[x], members[k])] = asked_vecs[a + np.array(by_list[x])] @ held_vecs[members[k]].T
                seen += np.isfinite(rough).sum(axis=1).tolist()
                best += best_of(rough, asked_vecs[a : a + 256], held_vecs, ids, count + 1)
        kind = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"query": pa.array(names, pa.int64()), "best": pa.array([[{"far": s, "vec_id": x} for s, x in row] for row in best], kind), "compared": pa.array(seen, pa.int64())})

    keys = ["group", "vpart", "qpart"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, best array<struct<far: double, vec_id: long>>, compared long")
    # A query has count + 1 entries from each task that it was in, and a vector comes from REPLICAS tasks at most.
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, REPLICAS * (count + 1))
    merged = met.groupBy("query").agg(nearest.alias("best"), F.sum("compared").alias("compared")).select("query", F.slice(F.array_distinct("best"), 1, count + 1).alias("best"), "compared")
    names = asked.join(reps, "vec").select(F.col("id").alias("query_id"), "query")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, count)
    each = names.join(merged, "query").select("query_id", "compared", F.posexplode(others).alias("at", "x"))
    return settled(each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (F.lit(0.0) - F.col("x.far")).alias("score"), "compared"), "nearest", postings, probes)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all; `compared` is the number of distinct vectors that the query was compared with."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
