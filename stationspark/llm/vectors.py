"""Search and near-duplicate detection over embedding tables (operators 3 and 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, table
from .graph import connected_components

#: Vectors of a shard and queries of a block in the search.
SHARD, BLOCK = 8192, 2048
#: Vectors of a tile in the near-duplicate comparison, and rows of it that are multiplied at a time.
TILE, STRIP = 4096, 512
#: Ranges that the axes cut the vectors into at most (a larger range has more tiles), and bytes of the tiles that go to a task as one.
RANGES, GROUP = 256, 8 << 20
#: Vectors that the principal axes are fitted on, those with the smallest hashed ids. The axes only order the work: any
#: rotation gives the same links.
AXES_SAMPLE = 20_000
#: Dimensions that are accumulated between two tests of the bound.
STEP = 16
#: What rounding in the single-precision bounds can amount to, many times over.
SLACK = 1e-4


def _usable(column: str) -> Column:
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(rows, dtype=np.float64) -> np.ndarray:
    rows = list(rows)
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array([np.asarray(r, dtype) for r in rows]).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


# -- exact top-k by MaxScore --------------------------------------------------------------------------------------------


def max_score(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (query position, id, score) of one shard for a block of queries; ``ids`` ascend.

    A dimension is a term with a posting for every vector. A term's contributions to a query lie between two bounds; counted
    from the lower one they are not negative. Terms stand in falling order of what they can add. Those that together cannot
    lift a vector over a query's k-th best score are non-essential: only the others are traversed for all vectors, and the
    rest are probed, a few at a time, for vectors that are still competitive. Ids ascend, so an equal score comes too late.
    """
    width = max(docs.shape[1], queries.shape[1])
    docs, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (docs, queries))
    limit = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if limit >= 2**63:
        raise OverflowError("an inner product can exceed a long")
    exact = np.float64 if limit < 2**53 else np.int64
    docs, queries = docs.astype(exact), queries.astype(exact)
    a, b = queries * docs.min(axis=0, initial=0), queries * docs.max(axis=0, initial=0)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(-(high - low).mean(axis=0), kind="stable")
    docs, queries, low, high = docs[:, order], queries[:, order], low[:, order], high[:, order]
    tail = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1), x.dtype)], axis=1)
    rest, spread, floor = tail(high), tail(high - low), low.sum(axis=1)
    m = len(queries)
    none = np.iinfo(np.int64).min
    best = np.full(m, none, np.int64)  # the k-th score so far
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, size = 0, max(1024, k + 1)
    while at < len(docs):
        part, part_ids = docs[at : at + size], ids[at : at + size]
        full = best > none
        essential = width
        if full.all():
            useless = spread < (best - floor)[:, None] + 1  # what stands from there on can only tie
            essential = int(np.where(useless.any(axis=1), useless.argmax(axis=1), width).max())
        score = queries[:, :essential] @ part[:, :essential].T
        alive = score + rest[:, essential, None] > np.where(full, best, none)[:, None]
        alive &= query_ids[:, None] != part_ids[None, :]
        q, d = np.nonzero(alive)
        s = score[q, d]
        for j in range(essential, width, STEP):
            s = s + np.einsum("ij,ij->i", queries[q, j : j + STEP], part[d, j : j + STEP])
            keep = s + rest[q, min(j + STEP, width)] > best[q]
            q, d, s = q[keep], d[keep], s[keep]
        q, i, s = np.concatenate([top[0], q]), np.concatenate([top[1], part_ids[d]]), np.concatenate([top[2], np.rint(s).astype(np.int64)])
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        counts = np.bincount(q, minlength=m)
        place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        best[q[place == k - 1]] = s[place == k - 1]
        keep = place < k
        top = (q[keep], i[keep], s[keep])
        at, size = at + size, 2048
    return top


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products, ties to the smaller id.

    Components become floor(scale * x) in double precision. Vectors that are null or hold a null or non-finite component take
    no part, as a query or as a candidate; nor do rows without an id. A query's own id is no candidate. Shorter vectors count
    as padded with zeros; repeated rows are candidates each, but one query: of rows of one id that ask, the first by their
    components is asked for. Other columns are ignored; an empty table gives no rows.

    Queries in blocks meet vectors in shards; every pair of them is a task of bounded size that returns k rows a query.
    """
    spark = vectors.sparkSession
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(_usable(embedding) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), whole.alias("x"), is_query.alias("is_query"))
    queries = rows.where("is_query").groupBy("id").agg(F.min("x").alias("x"))
    n, m = rows.count(), queries.count()
    shards, blocks = -(-n // SHARD) or 1, -(-m // BLOCK) or 1

    def spread(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))).select("shard", "block", "id", "x")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left = left.sort_values("id", kind="stable")
        query_ids = right["id"].to_numpy()
        q, i, s = max_score(left["id"].to_numpy(), _matrix(left["x"], np.int64), query_ids, _matrix(right["x"], np.int64), k)
        give_back()
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": i, "score": s})

    left, right = spread(rows, "shard", shards, "block", blocks), spread(queries, "block", blocks, "shard", shards)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# -- near duplicates by PCA-ordered tiles --------------------------------------------------------------------------------


def principal_axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes by falling variance of the unit vectors of a bounded sample (AXES_SAMPLE), as columns, and the sample on them."""
    rows = vectors.orderBy(F.xxhash64("class"), "class").limit(AXES_SAMPLE).select("x").collect()
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : len(r["x"])] = r["x"]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)]
    return axes, x @ axes


def cut_ranges(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of 2^depth - 1 cuts in heap order, each at the median of the axis along which its part varies most."""
    axis, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = [sample]
    for node in range(2**depth - 1):
        part = parts[node]
        if len(part):
            axis[node] = part.var(axis=0).argmax()
            value[node] = np.median(part[:, axis[node]])
        above = part[:, axis[node]] > value[node]
        parts += [part[~above], part[above]]
    return axis, value


def range_of(turned: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The range, from 0, that each row lies in."""
    node = np.zeros(len(turned), np.int64)
    for _ in range(int(np.log2(len(axis) + 1))):
        node = 2 * node + 1 + (turned[np.arange(len(turned)), axis[node]] > value[node])
    return node - len(axis)


def reachable(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which ranges (their least and greatest components as rows) can hold unit vectors with a cosine of ``threshold``, as a matrix.

    What keeps two ranges apart on each axis adds up to a distance, and unit vectors that far apart have a smaller cosine.
    """
    apart = np.zeros((len(low), len(low)))
    for lo, hi in zip(low.T, high.T, strict=True):
        apart += np.maximum(0, np.maximum(lo[:, None] - hi[None, :], lo[None, :] - hi[:, None])) ** 2
    return 1 - apart / 2 >= threshold - SLACK


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``threshold``, as a matrix of booleans."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)
    tail = lambda r: np.sqrt(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norms of what is from there on
    ta, tb = np.pad(tail(ra), ((0, 0), (0, 1))), np.pad(tail(rb), ((0, 0), (0, 1)))
    out = np.zeros((len(a), len(b)), bool)
    width = ra.shape[1]
    for at in range(0, len(a), STRIP):
        strip = slice(at, at + STRIP)
        score = ra[strip, :STEP] @ rb[:, :STEP].T
        possible = score + ta[strip, min(STEP, width), None] * tb[None, :, min(STEP, width)] >= threshold - SLACK
        i, j = np.nonzero(possible)
        s, k = score[i, j], STEP
        while k < width and len(i) * 8 < possible.size:  # few pairs are left: the next dimensions for these alone
            s = s + np.einsum("ij,ij->i", ra[strip][i, k : k + STEP], rb[j, k : k + STEP])
            k += STEP
            keep = s + ta[strip][i, min(k, width)] * tb[j, min(k, width)] >= threshold - SLACK
            i, j, s = i[keep], j[keep], s[keep]
        if len(i) * 8 < possible.size:
            cosine = np.concatenate([np.einsum("ij,ij->i", a[strip][i[p : p + 50_000]], b[j[p : p + 50_000]]) / (na[strip][i[p : p + 50_000]] * nb[j[p : p + 50_000]]) for p in range(0, len(i), 50_000)] or [np.zeros(0)])
            out[strip][i, j] = cosine >= threshold
        else:  # many are: all dimensions of the strip in double precision, and those at the threshold once more by themselves
            cosine = ua[strip] @ ub.T
            hit = cosine >= threshold
            i, j = np.nonzero(np.abs(cosine - threshold) < 1e-12)
            hit[i, j] = np.einsum("ij,ij->i", a[strip][i], b[j]) / (na[strip][i] * nb[j]) >= threshold
            out[strip] = hit
    return out


def forest(ids_a: np.ndarray, ids_b: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``hit`` connects: every id in a link to the smallest one it reaches; at most one an id."""
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit, a, b = hit[np.ix_(rows, cols)], ids_a[rows], ids_b[cols]
    la, lb, most = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        na, nb = la.copy(), lb.copy()
        for at in range(0, len(a), 256):  # in strips, so that no square of numbers is held
            part, some = slice(at, at + 256), hit[at : at + 256]
            na[part] = np.minimum(la[part], np.where(some, lb[None, :], most).min(axis=1))
            nb = np.minimum(nb, np.where(some, na[part, None], most).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    return u[u != v], v[u != v]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (it is its component's smallest id).

    Two vectors link when their cosine in double precision is at least ``threshold`` (positive). Vectors that are null or
    zero or hold a null or non-finite component link with nothing. Shorter vectors count as padded with zeros. Equal vectors
    are one class with a count, so a group of copies costs as much as one vector; repeated rows are members as any other and
    each gets its row. Rows with a null id get a row of their own but link with nothing. Other columns are ignored.

    Classes lie in ranges of the principal axes, cut at medians of the sample, and in tiles of their range by a hash. Pairs of
    tiles whose ranges are too far apart for the threshold never meet. The others meet as groups of tiles of bounded size, in
    tasks that return a count per vector and a spanning forest of their links, never the links themselves. Components that are
    too large or small to be squared are scaled by a power of two, which changes no cosine.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("x"))
    some = _usable("x") & F.exists("x", lambda v: v != 0) & F.col("vec_id").isNotNull()
    # Adding 0.0 makes minus zero zero, so equal vectors have equal hashes.
    hashed = lambda seed: F.xxhash64(F.lit(seed), F.transform("x", lambda v: v + F.lit(0.0)))
    rows = rows.withColumn("some", some).withColumn("h1", hashed(1)).withColumn("h2", hashed(2))
    classes = rows.where("some").groupBy("h1", "h2").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"), F.first("x").alias("x"))
    most = F.array_max(F.transform("x", F.abs))
    times = lambda f: F.transform("x", lambda v: v * F.lit(f))
    classes = classes.withColumn("x", F.when(most > 1e150, times(2.0**-600)).when(most < 1e-150, times(2.0**600)).otherwise(F.col("x")))
    classes = materialize(classes, "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes, sample = principal_axes(classes, width)
    depth = min(int(np.ceil(np.log2(max(1, n / TILE)))), int(np.log2(RANGES)))
    cuts = spark.sparkContext.broadcast((axes, *cut_ranges(sample, depth)))  # bounded: the square of the dimension, and RANGES

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.zeros((len(pdf), width))
            for k, row in enumerate(pdf["x"]):
                x[k, : len(row)] = row
            at = range_of((x / np.linalg.norm(x, axis=1, keepdims=True)) @ cuts.value[0], *cuts.value[1:])
            yield pd.DataFrame({"class": pdf["class"], "copies": pdf["copies"], "range": at, "x": [row.tobytes() for row in x]})
        give_back()

    placed = materialize(classes.select("class", "copies", "x").mapInPandas(place, "class long, copies long, range long, x binary"), "placed")

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(-1, width)
            turned, at = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ cuts.value[0], pdf["range"].to_numpy()
            yield pd.DataFrame([(r, int((at == r).sum()), turned[at == r].min(axis=0), turned[at == r].max(axis=0)) for r in np.unique(at)], columns=["range", "n", "low", "high"])

    def join_bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"range": pdf["range"].iloc[:1], "n": [pdf["n"].sum()], "low": [np.stack(pdf["low"]).min(axis=0)], "high": [np.stack(pdf["high"]).max(axis=0)]})

    boxes = "range long, n long, low array<double>, high array<double>"
    boxes = placed.select("range", "x").mapInPandas(bounds, boxes).groupBy("range").applyInPandas(join_bounds, boxes).orderBy("range").collect()  # RANGES rows at most
    near = np.zeros((2**depth, 2**depth), bool)
    some_ranges = [r["range"] for r in boxes]
    near[np.ix_(some_ranges, some_ranges)] = reachable(np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes]), threshold)
    in_range = np.zeros(2**depth, np.int64)
    in_range[some_ranges] = [-(-r["n"] // TILE) for r in boxes]
    first = np.cumsum(in_range) - in_range
    size = max(1, GROUP // (8 * TILE * width))
    plan = spark.sparkContext.broadcast((near, first, in_range))  # bounded by the square of RANGES

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        near, first, in_range = plan.value
        mine = int(pdf["range"].iloc[0])
        others = np.unique(np.concatenate([np.arange(first[r], first[r] + in_range[r]) // size for r in np.flatnonzero(near[mine])]))
        whole = {"ids": pdf["class"].to_numpy().tobytes(), "copies": pdf["copies"].to_numpy().tobytes(), "x": b"".join(pdf["x"])}
        return pd.DataFrame([{"tile": pdf["tile"].iloc[0], "range": mine, "others": others, **whole}])

    numbers = lambda x: F.array(*[F.lit(int(v)) for v in x])
    of_range = lambda x: F.get(numbers(x), F.col("range").cast("int")).cast("long")
    tiled = placed.withColumn("tile", of_range(first) + F.pmod(F.xxhash64("class"), of_range(in_range)))
    packed = tiled.groupBy("tile").applyInPandas(gather, "tile long, range long, others array<long>, ids binary, copies binary, x binary")
    packed = packed.withColumn("group", F.floor(F.col("tile") / size)).withColumn("other", F.explode("others")).drop("others")
    packed = packed.withColumn("i", F.least("group", "other")).withColumn("j", F.greatest("group", "other")).drop("other")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        near, i, j = plan.value[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
        tiles = [(r.group, r.tile, r.range, np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.x, np.float64).reshape(-1, width)) for r in pdf.itertuples()]
        out = [np.zeros((0, 3), np.int64)]
        for ga, ta, ra, ia, ca, xa in tiles:
            for gb, tb, rb, ib, cb, xb in tiles:
                if ga != i or gb != j or (i == j and ta > tb) or not near[ra, rb]:
                    continue
                hit = linked(xa, xb, cuts.value[0], threshold)
                if ta == tb:
                    np.fill_diagonal(hit, False)
                u, v = forest(ia, ib, hit)
                out.append(np.stack([u, v, np.zeros(len(u), np.int64)], axis=1))
                for ids, links in [(ia, hit @ cb)] + ([] if ta == tb else [(ib, ca @ hit)]):
                    some = links > 0
                    out.append(np.stack([ids[some], ids[some], links[some]], axis=1))
        give_back()
        return pd.DataFrame(np.concatenate(out), columns=["u", "v", "links"])

    found = materialize(packed.groupBy("i", "j").applyInPandas(compare, "u long, v long, links long"), "links")
    links = found.where("links > 0").groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("u", "v")).withColumnRenamed("node", "class")
    of_class = classes.select("h1", "h2", "class", "copies").join(links, "class", "left").join(parts, "class", "left")
    of_class = materialize(of_class, "of-class")  # a plain table: the join below can split a class of very many members
    mine = rows.select("vec_id", "some", F.when(F.col("some"), F.col("h1")).otherwise(F.xxhash64("vec_id", "h1")).alias("h1"), "h2")
    joined = mine.join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("some"), F.coalesce("component", "class")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("some"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
