"""Vector operators: term embedding, cosine scoring, exact top-k.

Vectors live in a keyed ``DataFrame(id, vec array<float|double>)`` — never
aligned by position.

Top-k plan (exact, no cross join). Vectors are scaled to norm 1. What follows depends on the
measured size of ``b``:

* up to ``broadcast_bytes`` it is one matrix that each task has; a batch of query vectors is one
  matrix product, and nothing is shuffled;
* beyond, ``b`` is cut into balls: each vector goes to the nearest of some of its own vectors (centres, a
  sample of bounded size), and a ball's radius is the largest angle in it. *First pass:* a query
  visits its nearest balls until they hold k vectors, whose k-th best similarity is a floor. *Second pass:*
  it visits those others that can hold a better vector: by the triangle
  inequality none is nearer than its angle to the centre less the radius. Queries and balls are dealt to blocks of
  ``block_rows``, pairs of which are the units of work; each emits its per-row top-k, and at most
  ``k`` rows a unit and query reach the final ``row_number() <= k``.

Ids may be of any type that can be ordered. Similarities are float64, rounded
to 9 places; ties go to the smaller id.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlink.functions.text import whitespace_tokens
from termlink.session import cut_lineage

ROUND = 9

# the block scorer runs in Python workers: send this module by value
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass


# ---------------------------------------------------------------------------
# embedding
# ---------------------------------------------------------------------------

def hash_bucket(tok: Column, dim: int) -> Column:
    """Test encoder's token → dimension: first 8 hex digits of md5, mod dim."""
    return (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast("int")


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: each distinct non-null text with its smallest id. Found by
    (md5, length); one copy per map task reaches the shuffle."""
    return (df.where(F.col(text_col).isNotNull())
            .groupBy(F.md5(F.col(text_col)).alias("__h"), F.length(F.col(text_col)).alias("__n"))
            .agg(F.min(id_col).alias("id"), F.min_by(F.col(text_col), F.col(id_col)).alias("text"))
            .select("id", "text"))


def embed_terms_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = 64,
                       digits: int | None = ROUND) -> DataFrame:
    """Mean-pooled one-hot hashing encoder, natively: ``(id, dim, val)`` for
    the non-zero dimensions, over the whole text of each *distinct* term,
    under its smallest id. ``digits``: places of the values; None for all."""
    toks = (distinct_texts(df, id_col, text_col)
            .select(F.col("id").alias(id_col), F.explode(whitespace_tokens(F.col("text"))).alias("tok")))
    per_dim = toks.groupBy(id_col, hash_bucket(F.col("tok"), dim).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(id_col))
    return per_dim.select(id_col, "dim", (share if digits is None else F.round(share, digits)).alias("val"))


def densify(sparse: DataFrame, id_col: str, dim: int) -> DataFrame:
    """(id, dim, val) → (id, vec array<double>) — groups have at most ``dim`` rows."""
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "val"))).alias("m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))).alias("vec"))


def embed_terms(df: DataFrame, id_col: str, text_col: str,
                encoder: Callable[[pd.Series], np.ndarray] | None = None, dim: int = 64,
                encoder_factory: Callable[[], Callable[[pd.Series], np.ndarray]] | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """One vector per distinct term. ``encoder`` maps a batch of texts to an
    (n, dim) array and is called once per Arrow batch inside ``mapInPandas``.
    ``encoder_factory`` instead builds the encoder (e.g. loads a model) once
    per task, before the task's first batch. Without either, the native
    hashing encoder is used.

    ``keep`` (native encoder only): a vector per row with a text of at least one token, beside these columns and
    found inside the row, so that neither texts, tokens nor vectors are shuffled."""
    if keep is not None:
        if encoder is not None or encoder_factory is not None:
            raise ValueError("keep is for the native encoder")
        kept = df.select(*keep)
        schema = T.StructType([*kept.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
        hit = F.transform(whitespace_tokens(F.col(text_col)), lambda t: hash_bucket(t, dim))
        return df.where(F.col(text_col).isNotNull()).select(*keep, hit.alias("vec")).mapInArrow(_shares(dim), schema)
    if encoder is None and encoder_factory is None:
        return densify(embed_terms_sparse(df, id_col, text_col, dim, digits=None), id_col, dim)
    terms = distinct_texts(df, id_col, text_col)
    id_type = df.schema[id_col].dataType

    def run(batches):
        enc = encoder_factory() if encoder_factory is not None else encoder
        for pdf in batches:
            vecs = np.asarray(enc(pdf["text"]), dtype=np.float64)
            yield pd.DataFrame({"id": pdf["id"].values, "vec": list(vecs)})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return terms.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def _shares(dim: int):
    """The last column, lists of dimensions, becomes the vector of their shares; rows with an empty list go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _PRODUCTS // dim)
        for whole in batches:
            for b in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                n = b.columns[-1].value_lengths().to_numpy(zero_copy_only=False)
                hit = b.columns[-1].flatten().to_numpy(zero_copy_only=False)
                counts = np.bincount(np.repeat(np.arange(len(n)), n) * dim + hit, minlength=len(n) * dim).reshape(len(n), dim)
                some = np.flatnonzero(n)
                flat = (counts[some] / n[some, None]).ravel()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in b.columns[:-1]), vec], names=b.schema.names)
    return run


# ---------------------------------------------------------------------------
# cosine
# ---------------------------------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine_col(a: Column, b: Column) -> Column:
    """Cosine in double; 0.0 when either vector has zero norm."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(_dot(a, b) / (na * nb))


def cosine_one_to_all(vectors: DataFrame, query_id, id_col: str = "id", vec_col: str = "vec",
                      include_self: bool = False) -> DataFrame:
    """Cosine of one stored vector against all others.

    The single query vector (one row, size = dimension) is fetched and
    inlined as a literal, so the scan of ``vectors`` needs no join at all.
    """
    row = vectors.where(F.col(id_col) == F.lit(query_id)).select(vec_col).first()
    if row is None:
        raise ValueError(f"no vector with {id_col} = {query_id!r}")
    q = F.array(*[F.lit(float(x)) for x in row[0]])
    out = vectors if include_self else vectors.where(F.col(id_col) != F.lit(query_id))
    return out.select(F.lit(query_id).alias("query_id"), F.col(id_col).alias("other_id"),
                      F.round(cosine_col(F.col(vec_col), q), ROUND).alias("similarity"))


def unit_vector(vec: Column) -> Column:
    """The vector in double precision, scaled to norm 1; a zero vector stays."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the norm as a variable: an expression would be worked out again for each component
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), F.lit(0))


def _best(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest values, largest first, ties by column."""
    kk = min(k, S.shape[1])
    least = np.partition(S, S.shape[1] - kk, axis=1)[:, S.shape[1] - kk]
    i, j = np.nonzero(S >= least[:, None])       # more than kk of a row where the last value is tied
    order = np.lexsort((j, -S[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < kk], j[place < kk]


def _block_topk(k: int):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a_id": a["id"][:0], "b_id": b["id"][:0], "similarity": np.zeros(0)})
        b = b.sort_values("id", kind="stable")
        S = np.round(np.stack(a["vec"].to_numpy()) @ np.stack(b["vec"].to_numpy()).T, ROUND)
        i, j = _best(S, k)
        return pd.DataFrame({"a_id": a["id"].to_numpy()[i], "b_id": b["id"].to_numpy()[j], "similarity": S[i, j]})
    return run


def _matrix(vecs: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _against_all(ids: pa.Array, matrix: np.ndarray, k: int, copies: tuple[pa.Array, np.ndarray] | None = None):
    """Top-k of a batch against one matrix, whose rows come in the order of ``ids``. Equal vectors of a batch are scored once.

    ``copies``: ids in order, and the row of the matrix that each stands for; the k best of these are found. An
    id that stands for several rows is told once, at its best rank."""
    rows = max(1, _PRODUCTS // max(1, len(ids), 0 if copies is None else k * min(k, len(ids))))
    if copies is not None:
        same = np.cumsum(np.r_[True, pc.not_equal(copies[0][1:], copies[0][:-1]).to_numpy(zero_copy_only=False)]) if len(copies[0]) else np.zeros(0)
        several = len(same) > 0 and same[-1] < len(same)
        held = np.argsort(copies[1], kind="stable")         # by row, then in the ids' order
        count = np.bincount(copies[1], minlength=len(ids))
        start = np.cumsum(count) - count

    def best(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row of ``v``, row of the matrix, copy, similarity and rank."""
        for at in range(0, len(v), rows):
            S = np.round(v[at:at + rows] @ matrix.T, ROUND)
            i, j = _best(S, k)
            sim, copy = S[i, j], j
            if copies is not None:
                # texts that fewer than k ids of better texts precede: no other has one of the k best
                before, new = np.cumsum(count[j]) - count[j], np.r_[True, (i[1:] != i[:-1]) | (sim[1:] != sim[:-1])]
                near = before[new][np.cumsum(new) - 1] - before[np.searchsorted(i, i)] < k
                group, j = (np.cumsum(new) - 1)[near], j[near]
                n = count[j]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # by group (row, then similarity), then id: one sort of whole numbers
                group, copy = np.divmod(np.sort(np.repeat(group, n) * len(held) + held[np.repeat(start[j], n) + nth]), len(held))
                i, sim = i[new][group], sim[new][group]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, sim, copy = i[first], sim[first], copy[first]
                j = copies[1][copy]
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            if copies is not None and several:
                first = np.sort(np.unique(np.stack([i, same[copy]]), axis=1, return_index=True)[1])
                i, j, copy, sim, rank = i[first], j[first], copy[first], sim[first], rank[first]
            yield i + at, j, copy, sim, rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, max(1, _PRODUCTS // k)) for at in range(0, whole.num_rows, max(1, _PRODUCTS // k))):
                v = np.ascontiguousarray(_matrix(b.column(1)))
                _, own, which = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
                i, j, copy, sim, rank = (np.concatenate(x) for x in zip(*best(v[own])))
                first, n = np.searchsorted(i, which), np.bincount(i, minlength=len(own))[which]
                row = np.repeat(np.arange(len(v)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = first[row] + nth
                out = {"a_id": b.column(0).take(pa.array(row)), "b_id": ids.take(pa.array(j[at]))}
                if copies is not None:
                    out["id"] = copies[0].take(pa.array(copy[at]))
                yield pa.RecordBatch.from_pydict({**out, "similarity": pa.array(sim[at]), "rank": pa.array(rank[at])})
    return run


class Balls:
    """``b`` (columns id, vec; unit or zero vectors) in balls round some of its own vectors; zero vectors are a
    ball of their own, which is at a right angle to everything."""

    def __init__(self, b: DataFrame, n: int, block_rows: int) -> None:
        self.block_rows = block_rows
        self.spark = spark = b.sparkSession
        picked = (b.where(F.exists("vec", lambda x: x != 0)).select(F.xxhash64("id").alias("h"), "vec").orderBy("h")
                  .limit(min(MOST_BALLS, max(1, -(-n // block_rows)))).collect())
        centres = np.array([r.vec for r in picked]) if picked else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                v = _matrix(x.column(1))
                near = v @ shared.value.T if len(shared.value) else np.zeros((len(v), 0))
                ball = near.argmax(axis=1) if near.shape[1] else np.zeros(len(v), np.int64)
                angle = np.arccos(np.clip(near[np.arange(len(v)), ball], -1, 1)) if near.shape[1] else np.zeros(len(v))
                zero = ~v.any(axis=1)
                ball[zero], angle[zero] = len(shared.value), 0.0
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(ball.astype(np.int32)), pa.array(angle)], names=["id", "vec", "ball", "angle"])

        self.id_type = b.schema["id"].dataType.simpleString()
        self.rows = cut_lineage(b.select("id", "vec").mapInArrow(assign, f"id {self.id_type}, vec array<double>, ball int, angle double"))
        # MOST_BALLS + 1 rows at most
        found = {r.ball: (r.n, r.radius) for r in self.rows.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
        self.sizes = np.array([found.get(i, (0, 0.0))[0] for i in range(len(centres) + 1)])
        radius = np.array([found.get(i, (0, 0.0))[1] for i in range(len(centres) + 1)])
        self.shared = spark.sparkContext.broadcast((centres, self.sizes, radius))

    def visits(self, a: DataFrame, k: int, second: bool) -> DataFrame:
        """``id, vec, ball``: the balls that the rows of ``a`` visit in the first pass, or (column ``floor`` added)
        in the second."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, sizes, radius = shared.value
            for whole in batches:
                rows = max(1, _PRODUCTS // len(sizes))
                for x in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                    v = _matrix(x.column(1))
                    angle = np.full((len(v), len(sizes)), np.pi / 2)
                    if len(centres):
                        angle[:, :-1] = np.arccos(np.clip(v @ centres.T, -1, 1))
                    angle[:, sizes == 0] = np.inf
                    order = np.argsort(angle, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    visited = np.zeros(angle.shape, bool)
                    np.put_along_axis(visited, order, held - sizes[order] < k, axis=1)
                    visited &= sizes > 0
                    if second:
                        # a ball of zero vectors holds similarities of 0 only
                        best = np.cos(np.maximum(0.0, np.where(np.isinf(angle), np.pi, angle) - radius - 1e-7))
                        best[:, -1] = 0.0
                        visited = ~visited & (sizes > 0) & (best >= x.column(2).to_numpy()[:, None] - 1e-8)
                    i, ball = np.nonzero(visited)
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(i)), x.column(1).take(pa.array(i)), pa.array(ball.astype(np.int32))],
                                                     names=["id", "vec", "ball"])
        kind = a.schema["id"].dataType.simpleString()
        return a.select("id", "vec", *(["floor"] if second else [])).mapInArrow(run, f"id {kind}, vec array<double>, ball int")

    def best(self, visits: DataFrame, k: int, schema: T.StructType) -> DataFrame:
        """The ``k`` best of each visited block of a ball, per query."""
        asked = visits.groupBy("ball").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("na"))
        held = self.spark.createDataFrame([(i, -(-int(n) // self.block_rows)) for i, n in enumerate(self.sizes) if n], "ball int, nb int")
        cells = asked.join(held, "ball")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            return (df.join(cells, "ball").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).select("ball", "a", "b", "id", "vec"))
        keys = ["ball", "a", "b"]
        return (dealt(visits, "a", "b").groupBy(*keys).cogroup(dealt(self.rows, "b", "a").groupBy(*keys))
                .applyInPandas(lambda key, x, y: _block_topk(k)(x, y), schema))


def fits_whole(b: DataFrame, copies: DataFrame, vec_col: str = "vec", broadcast_bytes: int = 64 << 20) -> bool:
    """Whether the vectors, and their copies' ids, are few enough for each task to have them all."""
    n, dim = b.agg(F.count("*"), F.max(F.size(vec_col))).first()
    return n * (dim or 0) * 8 <= broadcast_bytes and (
        copies.agg(F.sum(8 + F.length(F.col("id").cast("string")))).first()[0] or 0) <= broadcast_bytes


#: Centres at most; one query vector's angles to all of them are found at once.
MOST_BALLS = 1024
#: Similarities that a task holds at once.
_PRODUCTS = 1 << 21


def topk_cosine(a: DataFrame, b: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
                block_rows: int = 2048, broadcast_bytes: int = 64 << 20, work: dict | None = None,
                copies: DataFrame | None = None) -> DataFrame:
    """Exact top-k of ``b`` for every row of ``a`` by cosine → (a_id, b_id,
    similarity, rank), ids in their own types. Rows with a null id or vector
    take no part. ``work``: is told the similarities computed by balls and those of all pairs.

    ``copies`` (b_id, id), where ``b`` :func:`fits_whole`: ids that share the vector ``b_id``, its k smallest
    at least; the k best of these are found inside the tasks → (a_id, b_id, id, similarity, rank)."""
    def units(df: DataFrame) -> DataFrame:
        return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
                .select(F.col(id_col).alias("id"), unit_vector(F.col(vec_col)).alias("vec")))

    A, B = units(a), units(b)
    n, dim = B.agg(F.count("*"), F.max(F.size("vec"))).first()
    a_type, b_type = a.schema[id_col].dataType, b.schema[id_col].dataType
    columns = [T.StructField("a_id", a_type), T.StructField("b_id", b_type), T.StructField("similarity", T.DoubleType())]
    if n * (dim or 0) * 8 <= broadcast_bytes:
        held = B.orderBy("id").toArrow().combine_chunks() if n else None
        ids = held["id"].combine_chunks() if n else pa.array([])
        matrix = _matrix(held["vec"].combine_chunks()) if n else np.zeros((0, 1))
        own = []
        if copies is not None:
            columns.insert(2, T.StructField("id", copies.schema["id"].dataType))
            c = copies.orderBy("id").toArrow().combine_chunks() if n else pa.table({"b_id": ids, "id": ids})
            c = c.filter(pc.is_in(c["b_id"], value_set=ids))
            own = [(c["id"].combine_chunks(), pc.index_in(c["b_id"].combine_chunks(), value_set=ids).to_numpy())]
        out = T.StructType([*columns, T.StructField("rank", T.LongType())])
        return (A if n else A.limit(0)).mapInArrow(_against_all(ids, matrix, k, *own), out)
    if copies is not None:
        raise ValueError("copies are for vectors that fit whole")
    balls = Balls(B, n, block_rows)
    A, schema = cut_lineage(A), T.StructType(columns)
    w = Window.partitionBy("a_id").orderBy(F.col("similarity").desc(), F.col("b_id"))

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    first = balls.visits(A, k, False)
    near = cut_lineage(balls.best(first, k, schema))
    floor = ranked(near).groupBy(F.col("a_id").alias("id")).agg(
        F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("floor"))
    more = balls.visits(A.join(floor, "id"), k, True)
    if work is not None:
        sizes = balls.spark.createDataFrame([(i, int(m)) for i, m in enumerate(balls.sizes)], "ball int, m long")
        work["products"] = first.select("ball").unionByName(more.select("ball")).join(sizes, "ball").agg(F.sum("m")).first()[0]
        work["all"] = A.count() * n
    return ranked(near.unionByName(balls.best(more, k, schema)))


def dedupe_candidates(df: DataFrame, keys=("trait_id", "efo_id"), sim: str = "similarity",
                      tiebreak: str = "term_row") -> DataFrame:
    """Best row per key pair (after top-k): highest similarity, then smallest
    ``tiebreak``. An aggregate (``min_by``), not a per-key sort."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    best = df.groupBy(*keys).agg(F.min_by(packed, F.struct((-F.col(sim)).alias("s"), F.col(tiebreak)))
                                 .alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others])
