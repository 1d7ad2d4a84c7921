"""Approximate nearest neighbours by an adaptive scan of dimensions within the probed lists of an index.

Vectors are dealt to the list of their nearest centroid and turned by one random rotation. A list is stored in blocks of
at most ROWS vectors, each as columns: the first few rotated dimensions of all its vectors, then the next few. A query
goes first to its own list, which gives it a bound, then to the others that it probes. There it adds up its distance to
all vectors of a block dimension by dimension; after t of d dimensions the distance so far, scaled by d / t, estimates
the whole, and a hypothesis test abandons those that are almost surely beyond the bound. What survives all dimensions is
measured on the original vectors in double precision.

Equal vectors are one entry of the index with the least ids that have it: more than k + 1 of them can never be among
anyone's k nearest, so a group of copies costs one vector wherever it lies, and no result changes. The number of lists that
a query probes is found by measurement: a set of queries is held against all vectors, and as many lists are
probed as hold the asked share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, ship, stored

K = 10
#: Share of the true neighbours that the probed lists are to hold, and the number of queries that it is measured with.
RECALL = 0.98
MEASURED = 256
#: The centroids and the mean are fitted on at most so many distinct vectors, and fewer if these had more values.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
MOST_LISTS = 4096
#: Vectors of a block, queries that meet it in one go, and the dimensions that are looked at between two tests.
ROWS, QUERIES, STEP = 4096, 4096, 16
#: Significance of the test: after t dimensions the estimate may pass the bound by the share ERROR / sqrt(t).
ERROR = 2.1
#: Vectors of more lengths than this are an error: each length is a space of its own.
LENGTHS = 100
#: Room for rounding in the partial distances.
SLACK = 1e-4


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, ask): rows with an id whose vector is neither null, empty nor zero and has finite components only."""
    v = F.col(vector_col)
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is more than any number
    return rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def distinct(keyed: DataFrame, most: int) -> DataFrame:
    """(h1, h2, v, ids): each vector once, with the ``most`` least of its ids."""
    w = Window.partitionBy("h1", "h2").orderBy("id")
    few = keyed.select("h1", "h2", "id", "v").withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= most)
    return few.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))


class Space:
    """Centroids, mean and rotation of vectors of one length; small, and the same whatever the order of the rows."""

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 12):
        rng, d = np.random.default_rng(7), sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.centroids = sample[rng.permutation(len(sample))[:lists]].copy()
        for _ in range(rounds):
            home = self.nearest(sample)
            sizes = np.bincount(home, minlength=len(self.centroids))
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, home, sample)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows from all centroids, less the row's own norm."""
        return (self.centroids**2).sum(1)[None] - 2 * (x @ self.centroids.T)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(x[a : a + 4096]).argmin(1) for a in range(0, len(x), 4096)])

    def turned(self, x: np.ndarray, home: int) -> np.ndarray:
        """``x`` as seen from a list's centroid, rotated; in single precision where that is enough."""
        out = (x - self.centroids[home]) @ self.rotation
        return out.astype(np.float32) if np.abs(out).max(initial=0) < 1e15 else out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), kind))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``q``, in double precision."""
    difference = np.ascontiguousarray(x) - q
    return np.sqrt((difference * difference).sum(axis=1))


def scan(columns: list[np.ndarray], q: np.ndarray, bound: float, d: int, tested: bool = True) -> np.ndarray:
    """Positions in a block that no test has abandoned; ``columns`` has its rotated dimensions by STEP, ``q`` is the rotated query."""
    alive, partial, t = None, np.zeros(columns[0].shape[1]), 0
    for part in columns:
        seen = part if alive is None else part[:, alive]
        difference = seen - q[t : t + len(part), None]
        partial = partial + np.einsum("ij,ij->j", difference, difference, dtype=np.float64)
        t += len(part)
        share = 1.0 if t == d or not tested else d / t / (1 + ERROR / np.sqrt(t)) ** 2
        passing = partial * share <= bound * bound * (1 + SLACK)
        if not passing.all():
            alive = np.flatnonzero(passing) if alive is None else alive[passing]
            partial = partial[passing]
        if not len(partial):
            break
    return np.arange(columns[0].shape[1]) if alive is None else alive


def _kth(scores: np.ndarray, weights: np.ndarray, k: int) -> float:
    """The k-th least score, where a score counts ``weights`` times; infinite if there are fewer."""
    order = np.argsort(scores)
    at = np.searchsorted(np.cumsum(weights[order]), k)
    return float(scores[order[at]]) if at < len(order) else np.inf


def _blocks(index: DataFrame, space: Space, d: int, kind: str) -> DataFrame:
    """(list, block, n, columns, originals, h1, h2, ids): the index, a row for each block of at most ROWS vectors of a list."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home = space.nearest(matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *b.columns], names=["list", *b.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(home: int, rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x = matrix(rows["v"].chunk(0))
            turned = space.turned(x, home)
            parts = [np.ascontiguousarray(turned[:, a : a + STEP].T).tobytes() for a in range(0, d, STEP)]
            cells = {"list": [home], "n": [len(x)], "columns": [parts], "originals": [x.astype(np.float32 if kind == "float" else np.float64).tobytes()]}
            cells |= {c: [rows[c].to_pylist()] for c in ("h1", "h2", "ids")}
            return pa.RecordBatch.from_pydict(cells, schema=schema)

        home, held, n = None, [], 0
        for b in batches:  # sorted by list
            lists = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1), len(lists)] if len(lists) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                while a < z:
                    if held and (int(lists[a]) != home or n == ROWS):
                        yield block(home, pa.Table.from_batches(held))
                        held, n = [], 0
                    home, take = int(lists[a]), min(z - a, ROWS - n)
                    held.append(b.slice(a, take))
                    n, a = n + take, a + take
        if held:
            yield block(home, pa.Table.from_batches(held))

    long = pa.list_(pa.int64())
    schema = pa.schema([("list", pa.int32()), ("n", pa.int32()), ("columns", pa.list_(pa.binary())), ("originals", pa.binary()), ("h1", long), ("h2", long), ("ids", pa.list_(long))])
    placed = index.select("h1", "h2", "v", "ids").mapInArrow(assign, f"list int, h1 bigint, h2 bigint, v array<{kind}>, ids array<bigint>")
    # ranges of (list, hash): a list of any size is as many tasks' as it needs, and a task holds one block at a time
    ranged = placed.repartitionByRange("list", "h1").sortWithinPartitions("list", "h1", "h2")
    made = ranged.mapInArrow(pack, "list int, n int, columns array<binary>, originals binary, h1 array<bigint>, h2 array<bigint>, ids array<array<bigint>>")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), "dimscan")


def _open(columns: list, n: int, d: int) -> list[np.ndarray]:
    widths = [min(STEP, d - a) for a in range(0, d, STEP)]
    return [np.frombuffer(x, np.float32 if len(x) == 4 * w * n else np.float64).reshape(w, n) for x, w in zip(columns, widths, strict=True)]


FOUND = "q1 bigint, q2 bigint, list int, score double, ids array<bigint>"


def _search(asks: DataFrame, blocks: DataFrame, space: Space, d: int, kind: str, k: int, tested: bool = True) -> DataFrame:
    """FOUND: of each ask (list, q1, q2, v, bound) the entries of that list's blocks that are within its bound, of each block the k nearest.

    Asks of a list are dealt in groups of about QUERIES, and each group meets each block of the list: a list that many queries
    probe and that has many blocks is many bounded cogroups. Without ``tested`` nothing is abandoned by the test, only by the bound itself.
    """
    real = np.float32 if kind == "float" else np.float64

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, scores, places = [], [], []
        if left.num_rows and right.num_rows:
            left, block = left.combine_chunks(), right.to_pylist()[0]
            n, ids = block["n"], pa.array(block["ids"], pa.list_(pa.int64()))
            sizes = np.diff(ids.offsets.to_numpy())
            x = np.frombuffer(block["originals"], real).reshape(n, d)
            columns = _open(block["columns"], n, d)
            v, bounds = matrix(left["v"].chunk(0)), left["bound"].to_numpy()
            turned = space.turned(v, block["list"])
            for i, bound in enumerate(bounds):
                if not np.isfinite(bound):  # what a few of them give holds for all
                    bound = _kth(exact(x[: 4 * k].astype(np.float64), v[i]), sizes[: 4 * k], k)
                alive = scan(columns, turned[i], bound, d, tested)
                found = exact(x[alive].astype(np.float64), v[i])
                best = found <= min(bounds[i], _kth(found, sizes[alive], k))
                q.append(np.full(best.sum(), i))
                scores.append(found[best])
                places.append(alive[best])
        if not q:
            return schema.empty_table()
        at = pa.array(np.concatenate(q).astype(np.int64))
        return pa.Table.from_arrays([*[left[c].take(at) for c in ("q1", "q2", "list")], pa.array(np.concatenate(scores)), ids.take(pa.array(np.concatenate(places).astype(np.int64)))], schema=schema)

    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("list", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
    sizes = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups"))
    homes = blocks.select("list", "block").join(sizes, "list")
    left = asks.join(homes, "list").select("list", "block", F.pmod(F.xxhash64("q1", "q2"), F.col("groups")).alias("g"), "q1", "q2", "v", "bound")
    right = blocks.join(sizes, "list").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("list", "block", "g", "n", "columns", "originals", "ids")
    right = right.toDF(*right.columns)  # columns of their own, as both sides come from the blocks
    return left.groupBy("list", "block", "g").cogroup(right.groupBy("list", "block", "g")).applyInArrow(meet, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q1, q2, best, bound): the k nearest (score, id) of each query vector, ties by id, and the score of the k-th, infinite if there are fewer."""
    rows = found.select("q1", "q2", "score", F.explode("ids").alias("id"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "id"))).where(F.col("n") <= k)
    last = F.max(F.when(F.col("n") == k, F.col("score")))
    return ranked.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("best"), F.coalesce(last, F.lit(float("inf"))).alias("bound"))


def _asks(queries: DataFrame, space: Space, entries: np.ndarray, probes: int | None, k: int, kind: str) -> DataFrame:
    """(list, q1, q2, v, bound): queries (q1, q2, v, bound) at lists with entries.

    Without ``probes`` these are the nearest list of each query, and further ones until there are k entries; with it, what is left of
    its nearest ``probes`` lists.
    """
    used = np.flatnonzero(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                few = b.slice(at, 64)
                order = used[np.argsort(space.distances(matrix(few.column(2)))[:, used], axis=1, kind="stable")]
                enough = (np.cumsum(entries[order], axis=1) < k).sum(axis=1) + 1
                at_home = np.arange(len(used)) < enough[:, None]
                picked = at_home if probes is None else ~at_home & (np.arange(len(used)) < probes)
                q = pa.array(np.repeat(np.arange(len(order)), picked.sum(1)))
                yield pa.RecordBatch.from_arrays([pa.array(order[picked].astype(np.int32)), *[c.take(q) for c in few.columns]], names=["list", *few.schema.names])

    return queries.select("q1", "q2", "v", "bound").mapInArrow(run, f"list int, q1 bigint, q2 bigint, v array<{kind}>, bound double")


def _one_length(rows: DataFrame, total: int, d: int, kind: str, k: int, recall: float) -> DataFrame:
    """(q1, q2, best) of the query vectors of ``d`` components."""
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    size = max(1, min(SAMPLE, SAMPLE_VALUES // d))
    some = keyed if total <= size else keyed.where(F.shiftrightunsigned("h1", 1) < int(min(1.0, 2 * size / total) * (1 << 63)) - 1)
    sample = matrix(some.groupBy("h1", "h2").agg(F.min("v").alias("v")).orderBy("h1", "h2").limit(size).select("v").toArrow()["v"].combine_chunks())
    space = Space(sample, max(1, min(MOST_LISTS, len(sample), round(total**0.5 / 2))))
    blocks = _blocks(distinct(keyed, k), space, d, kind)
    entries = np.zeros(len(space.centroids), np.int64)
    for r in blocks.groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row per list
        entries[r.list] = r.n
    queries = cut(keyed.where("ask").groupBy("h1", "h2").agg(F.min("v").alias("v")).select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v", F.lit(float("inf")).alias("bound")))
    probes = 1
    if (entries > 0).sum() > 1:
        probes = _probes(queries, blocks, space, entries, d, kind, k, recall)
    near = cut(_search(_asks(queries, space, entries, None, k, kind), blocks, space, d, kind, k))
    bounded = queries.drop("bound").join(_best(near, k).drop("best"), ["q1", "q2"])
    far = _search(_asks(bounded, space, entries, probes, k, kind), blocks, space, d, kind, k)
    return _best(near.unionByName(far), k).drop("bound")


def _probes(queries: DataFrame, blocks: DataFrame, space: Space, entries: np.ndarray, d: int, kind: str, k: int, recall: float) -> int:
    """How many lists hold the share ``recall`` of the true k nearest of MEASURED queries, which are compared with every entry."""
    few = cut(queries.orderBy("q1", "q2").limit(MEASURED))
    asks = _asks(few, space, entries, None, k, kind).unionByName(_asks(few, space, entries, len(entries), k, kind))
    true = _search(asks, blocks, space, d, kind, k, tested=False)
    rows = true.select("q1", "q2", "list", "score", F.explode("ids").alias("id"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "id"))).where(F.col("n") <= k)
    found = ranked.join(few, ["q1", "q2"]).select("list", "v").toArrow()  # at most k rows of each of MEASURED queries
    used = np.flatnonzero(entries)
    distances = space.distances(matrix(found["v"].combine_chunks()))[:, used]
    home = distances[np.arange(len(distances)), np.searchsorted(used, found["list"].to_numpy())]
    return int(np.quantile((distances < home[:, None]).sum(1), recall, method="higher")) + 1 if len(home) else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` is true, by Euclidean distance, ties by id.

    Every usable row is indexed and is a candidate of every query but its own: rows without an id, and vectors that are null,
    empty or zero or that hold a null, NaN or infinite component take no part. Rows that repeat an id and a vector count
    once; a query is no candidate of itself, nor is any other row of its id. An id that has several vectors is nearest by each of them, and as a
    query is answered for each. Vectors of another length are no candidates: a length is a space of its own. With fewer than k
    candidates all are returned. An empty table gives an empty result; other columns are not read.
    """
    ship(vectors.sparkSession)
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = usable(vectors, is_query, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("ask")).where("ask").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for r in sizes:  # one in practice
        of_length = rows.where(F.size("v") == r.d)
        best = _one_length(of_length, r.n, r.d, kind, k + 1, recall)
        asked = of_length.where("ask").select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q1"), F.xxhash64(F.lit(1), "v").alias("q2")).distinct()
        own = F.filter("best", lambda x: x.id != F.col("query_id"))
        found = asked.join(best, ["q1", "q2"]).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "hit"))
        out = out.unionByName(found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")))
    return out


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """What the query returns: the ten nearest of every row whose vec_id is divisible by 100."""
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
