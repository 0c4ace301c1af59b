"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are scaled by their largest component, which no cosine depends on: what is very large or
tiny neither overflows nor vanishes, and vectors that differ in length alone become equal. Equal
ones are collapsed to one that carries its smallest ids, as many as an answer can need.
The distinct vectors are dealt by hash to shards of about ``SHARD`` vectors. Within a shard a graph
is grown in lots: a greedy beam search over the graph so far proposes neighbours, relaxed distance
pruning keeps diverse ones (a candidate goes if an already kept one is nearer to it by the factor
``ALPHA``), edges are added in reverse and pruned again where a node has too many. A task loads its
shard once and queries stream through it in bounded lots; a beam search finds the nearest, scores
are computed in double precision, and the shards' answers are merged. What moves is the queries,
once to each shard; the index moves to its tasks once.

Defined results: vectors that are null, zero or hold null or non-finite components take no part,
nor do null ids; vectors of another length are never compared; rows that repeat an id with the same
vector count once; with different vectors each is a query and a candidate, and the id's answers are
merged by their best scores; a query never finds its own id; of equally near ones that the beam
reaches the smaller ids are returned; with fewer candidates than ``k`` all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stash, tidy

SHARD = 8192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
ENTRIES = 16
#: Queries that a shard searches at a time.
LOT = 256


def beam_search(x, graph, entries, queries, beam: int, width: int = 4):
    """Ids (q, beam) and squared distances, nearest first, of unit vectors; -1 where fewer were reached."""
    import numpy as np

    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    e = np.unique(entries)
    seen[:, e] = True
    ids = np.full((q, beam), n)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    d = 2 - 2 * queries @ x[e].T
    m = min(beam, len(e))
    o = np.argsort(d, 1, kind="stable")[:, :m]
    ids[:, :m], dist[:, :m], done[:, :m] = e[o], np.take_along_axis(d, o, 1), False
    while not done.all():
        # the nearest ``width`` that are not expanded yet
        order = np.argsort(np.where(done, np.inf, dist), 1, kind="stable")[:, :width]
        fresh = ~np.take_along_axis(done, order, 1)
        np.put_along_axis(done, order, True, 1)
        live = np.flatnonzero(fresh.any(1))
        near = graph[np.where(fresh[live], ids[live[:, None], order[live]], n)].reshape(len(live), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(new, near, n)
        width_new = int(new.sum(1).max()) if len(live) else 0
        if not width_new:
            continue
        near = np.sort(near, 1)[:, :width_new]
        dn = 2 - 2 * np.einsum("qmd,qd->qm", x[np.minimum(near, n - 1)], queries[live])
        dn[near == n] = np.inf
        all_ids = np.concatenate([ids[live], near], 1)
        all_d = np.concatenate([dist[live], dn], 1)
        all_done = np.concatenate([done[live], near == n], 1)
        o = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, o, 1) for a in (all_ids, all_d, all_done))
    return np.where(np.isinf(dist), -1, ids), dist


def robust_prune(x, nodes, cand, degree: int, alpha: float):
    """(b, degree) kept candidates of each node; cand (b, m), -1 for none; n for none in the result."""
    import numpy as np

    n, b = len(x), len(nodes)
    cand = np.sort(np.where((cand < 0) | (cand == nodes[:, None]), n, cand), 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    xc = x[np.minimum(cand, n - 1)]
    d = 2 - 2 * np.einsum("bmd,bd->bm", xc, x[nodes])
    d[cand == n] = np.inf
    o = np.argsort(d, 1, kind="stable")
    cand, d, xc = np.take_along_axis(cand, o, 1), np.take_along_axis(d, o, 1), np.take_along_axis(xc, o[:, :, None], 1)
    alive = ~np.isinf(d)
    out = np.full((b, degree), n)
    r = np.arange(b)
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[r, first]
        if not has.any():
            break
        out[has, k] = cand[r, first][has]
        far = 2 - 2 * np.einsum("bmd,bd->bm", xc, xc[r, first])
        alive &= ~((alpha * alpha * far <= d) & has[:, None])
        alive[r, first] = False
    return out


def build_graph(x, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, lot: int = 512, seed: int = 5):
    """(n + 1, degree) neighbours of unit vectors (n: none), and the entries of a search."""
    import numpy as np

    rng, n = np.random.default_rng(seed), len(x)
    middle = x.mean(0)
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), int((x @ middle).argmax())))
    graph = np.full((n + 1, degree), n)
    graph[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    order = rng.permutation(n)
    for a in range(0, n, lot):
        p = order[a : a + lot]
        found, _ = beam_search(x, graph, entries, x[p], beam)
        graph[p] = robust_prune(x, p, np.concatenate([found, np.where(graph[p] == n, -1, graph[p])], 1), degree, alpha)
        source = np.repeat(p, degree)
        target = graph[p].ravel()
        ok = target < n
        source, target = source[ok], target[ok]
        if not len(target):
            continue
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        t, at, count = np.unique(target, return_index=True, return_counts=True)
        for most in (degree // 4, degree, int(count.max())):  # in classes of size, so that padding stays small
            part = (count <= most) & (count > 0)
            if part.any():
                pad = np.arange(int(count[part].max()))
                more = np.where(pad[None, :] < count[part][:, None], source[np.minimum(at[part][:, None] + pad, len(source) - 1)], -1)
                old = graph[t[part]]
                both = np.concatenate([np.where(old == n, -1, old), more], 1)
                room = np.sort(np.where(both < 0, n, both), 1)
                room[:, 1:][room[:, 1:] == room[:, :-1]] = n
                fits = (room < n).sum(1) <= degree
                tp = t[part]
                graph[tp[fits]] = np.sort(room[fits], 1)[:, :degree]
                over = np.flatnonzero(~fits)
                for b in range(0, len(over), lot):
                    graph[tp[over[b : b + lot]]] = robust_prune(x, tp[over[b : b + lot]], both[over[b : b + lot]], degree, alpha)
            count = np.where(part, 0, count)
    return graph, entries


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the direction: the vector over its largest component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda c: c != 0))
    # Zero has two signs, which would hash apart.
    return good.withColumn("most", F.array_max(F.transform("v", F.abs))).select("vec_id", F.transform("v", lambda c: c / F.col("most") + F.lit(0.0)).alias("v"))


def distinct_vectors(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """Each direction v with its ``keep`` smallest ids; copies are thinned in salted lots first."""
    h = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    lot = W.partitionBy("h", "v", "salt").orderBy("vec_id")
    thin = h.withColumn("r", F.row_number().over(lot)).filter(F.col("r") <= keep).drop("r")
    whole = W.partitionBy("h", "v").orderBy("vec_id")
    thin = thin.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= keep)
    return thin.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("v", "ids")


INDEX = "shard long, width int, ids array<array<bigint>>, vectors binary, graph binary, entries array<int>"


def build_index(vectors: DataFrame, keep: int, shard_size: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a shard: its vectors, their ids and the graph. Stashed."""
    unique = stash(distinct_vectors(usable(vectors, id_col, vector_col), keep), "vectors")
    shards = max(1, -(-unique.count() // shard_size))

    def build(table):
        import numpy as np
        import pyarrow as pa

        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        order = np.argsort([i[0] for i in table.column("ids").to_pylist()], kind="stable")
        x = np.ascontiguousarray(x[order])
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        graph, entries = build_graph(unit)
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                "width": pa.array([x.shape[1]], pa.int32()),
                "ids": pa.array([[table.column("ids")[int(i)].as_py() for i in order]], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                "entries": pa.array([entries.tolist()], pa.list_(pa.int32())),
            }
        )

    dealt = unique.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards))).withColumn("width", F.size("v"))
    return stash(dealt.groupBy("shard", "width").applyInArrow(build, INDEX), "index")


class Shard:
    """A loaded row of the index."""

    def __init__(self, row: dict):
        import numpy as np

        self.x = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
        self.ids, self.entries = row["ids"], np.array(row["entries"])
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.x) + 1, -1).astype(np.int64)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.unit = (self.x / self.norms[:, None]).astype(np.float32)

    def nearest(self, ids: list[int], vectors, k: int):
        """(query, id, cosine) of each query's k nearest that the beam reaches, ties by id."""
        import numpy as np

        norms = np.sqrt((vectors * vectors).sum(1))
        found, _ = beam_search(self.unit, self.graph, self.entries, (vectors / norms[:, None]).astype(np.float32), SEARCH_BEAM)
        for q, own, norm, row in zip(ids, vectors, norms, found):
            at = row[row >= 0]
            cos = (self.x[at] * own).sum(1) / (self.norms[at] * norm)
            best, last = [], None
            for j in np.argsort(-cos, kind="stable"):
                if last is not None and cos[j] < last:
                    break  # all that are as near as the k-th are in
                best += [(-cos[j], i) for i in self.ids[at[j]] if i != q]
                if last is None and len(best) >= k:
                    last = cos[j]
            for c, i in sorted(best)[:k]:
                yield q, i, -float(c)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard_size: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by ``every``."""
    index = build_index(vectors, k + 1, shard_size, id_col, vector_col)
    queries = usable(vectors, id_col, vector_col).filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    shards = index.count()
    n_shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # A stated query set against every shard of its width: a shard's row first, then the queries.
    sent = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), F.size("v").alias("width"), F.col("vec_id").alias("query_id"), F.col("v").alias("asked")
    )
    streams = index.unionByName(sent, allowMissingColumns=True).withColumn("second", F.col("query_id").isNotNull())
    parts = max(shards, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    streams = streams.repartition(parts, "shard", "width").sortWithinPartitions("shard", "width", "second")
    streams = streams.select("shard", "width", "ids", "vectors", "graph", "entries", "query_id", "asked")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        key, loaded = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            is_query = batch.column(6).is_valid().to_pylist()
            a = 0
            while a < len(keys):
                if not is_query[a]:
                    key, loaded = keys[a], Shard({n: batch.column(c)[a].as_py() for c, n in enumerate(("shard", "width", "ids", "vectors", "graph", "entries"))})
                    a += 1
                    continue
                b = a
                while b < len(keys) and is_query[b] and keys[b] == keys[a] and b - a < LOT:
                    b += 1
                if keys[a] == key:
                    qv = batch.column(7).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                    out = list(zip(*loaded.nearest(batch.column(6).slice(a, b - a).to_pylist(), np.asarray(qv), k))) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])
                a = b

    hits = streams.mapInArrow(tidy(search), "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
