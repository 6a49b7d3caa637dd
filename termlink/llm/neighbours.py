"""Nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

*Space.*  A vector x of norm at most M becomes (x / M, sqrt(1 - |x / M|^2)) on the unit sphere, where the
nearest are those of the largest inner product with (q, 0).  Vectors are kept apart by length and by factors of
two of their norms (a *space* each), so that a few huge ones can't blur the others.  On the way a vector
is one byte a component and two floats; results are scored on the original vectors in double precision.

*Graph.*  Each vector starts with near ones out of small blocks (one random, the others cells of random
hyperplanes).  Then, round by round, a vector is sent to all its neighbours; those that meet at one are
neighbours of a neighbour, and compared if one of the two came to that neighbour in the last round.  A pair goes on only
if it would enter one of the two lists, at most ``emitted`` for a vector and place.  The rounds end when less than ``settled`` of all list
entries are new.  A place that many vectors are sent to is dealt to blocks of ``block`` of them, anew each round.

*Search.*  A query keeps the ``beam`` best nodes seen.  Each round it visits the ``visited`` best that it hasn't visited yet:
it is joined to the graph there, and compared with all their neighbours.  It ends when all of its beam is
visited.  It starts from the best of ``entries`` nodes of each space, chosen by hash, and if its vector is in the graph, from that.

All state is tables in the shared folder, one row a vector or query; nothing is gathered but the ``entries`` of a space.
Equal vectors are one node, whose rows are listed at the end.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query
nor as candidate; vectors of different length aren't compared; a null id is carried and no query; a row is
no candidate for itself, but other rows of its id or vector are; ties go to the smaller id (null first); fewer
than k candidates are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termlink.llm.embedding_dedup import representatives
from termlink.llm.tables import shuffles_dropped, staged, successive

_NODE = "id long, space long, code binary, scale float, rest float"
#: Rows that a task handles at a time.
_ROWS = 4096
#: Copies of an entry node in the search.
_COPIES = 16


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.int8) if data is not None and data.size else np.zeros(0, np.int8), at


def _coded(x: np.ndarray, norm: float) -> tuple[bytes, float]:
    """Components over ``norm`` as signed bytes, and what a byte's one stands for."""
    x = x / norm
    scale = float(np.abs(x).max()) / 127
    return np.rint(x / scale).astype(np.int8).tobytes(), scale


def _sizes(x: np.ndarray) -> tuple[float, int]:
    """The norm, and the power of two of the space: norm is in (2**(e - 1/2), 2**(e + 1/2)]."""
    top = float(np.abs(x).max())
    e = math.log2(top) + math.log2(float(np.sqrt(((x / top) ** 2).sum())))
    return e, math.ceil(e - 0.5)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for v in b.column(1):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            power, e = _sizes(x)
            top = float(np.abs(x).max())
            # x / M without overflow: M is 2**(e + 1/2)
            code, scale = _coded(x / top * 2.0 ** (math.log2(top) - e - 0.5), 1.0)
            out.append((len(x) * 4096 + e + 2048, code, scale, math.sqrt(max(0.0, 1 - 2.0 ** (2 * (power - e - 0.5))))))
        space, code, scale, rest = map(list, zip(*out)) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(space, pa.int64()), pa.array(code, pa.binary()),
                                          pa.array(scale, pa.float32()), pa.array(rest, pa.float32())],
                                         names=["id", "space", "code", "scale", "rest"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and where each begins; rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def ready(last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for c in range(keys):
            k = t.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        cuts = np.append(np.flatnonzero(new), t.num_rows)
        held.clear()
        if not last:
            held.append(t.slice(cuts[-2]))
            cuts = cuts[:-1]
        if len(cuts) > 1:
            yield t, cuts

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(h.num_rows for h in held) >= _ROWS:
                yield from ready(False)
    if held:
        yield from ready(True)


def _meet(keys: int, emitted: int, crowd: int | None = None) -> Callable:
    """Compares the members of each group; rows: keys, id, code, scale, rest, least (what a neighbour has to beat), fresh.
    Rows out: a, b, s; with ``crowd`` also the first key, -1 and the size of groups larger than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _grouped(batches, keys):
            data, at = _bytes(t.column(keys + 1))
            ids, scale, rest, least, fresh = (t.column(keys + c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4, 5))
            a, b, s = [], [], []
            if crowd is not None:
                big = np.flatnonzero(np.diff(cuts) > crowd)
                a.append(t.column(0).to_numpy()[cuts[big]])
                b.append(np.full(len(big), -1))
                s.append(np.diff(cuts)[big].astype(np.float32))
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                code = data[at[lo]: at[hi]].reshape(hi - lo, -1).astype(np.float32 if at[lo + 1] - at[lo] < 1024 else np.float64)
                # whole numbers, so that a pair is as near wherever it meets
                near = ((code @ code.T) * np.outer(scale[lo:hi], scale[lo:hi]) + np.outer(rest[lo:hi], rest[lo:hi])).astype(np.float32)
                wanted = (near > least[lo:hi, None]) & (fresh[lo:hi, None] | fresh[None, lo:hi])
                np.fill_diagonal(wanted, False)
                if hi - lo > emitted + 1:
                    near[~wanted] = -np.inf
                    best = np.argpartition(-near, emitted - 1, axis=1)[:, :emitted]
                    some = np.zeros_like(wanted)
                    np.put_along_axis(some, best, True, axis=1)
                    wanted &= some
                i, j = np.nonzero(wanted)
                a.append(ids[lo + i])
                b.append(ids[lo + j])
                s.append(near[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["a", "b", "s"])
    return run


_GRAPH = f"{_NODE}, near array<struct<s:float,id:long,fresh:boolean>>, sent long"
_NEAR_TYPE = pa.list_(pa.struct([("s", pa.float32()), ("id", pa.int64()), ("fresh", pa.bool_())]))


def _first_of(group: np.ndarray, other: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Positions of one entry for each (group, other), the one with the least ``later``."""
    order = np.lexsort((later, other, group))
    g, o = group[order], other[order]
    return order[np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]))[: len(order)]]


def _merge(k: int) -> Callable:
    """Each node's ``k`` best out of its list and its new pairs.  Rows sorted by id, the node's first: id, other (null for the
    node, -1: how many were sent to it), s, space, code, scale, rest, near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _grouped(batches, 1):
            t = t.slice(0, cuts[-1])
            node = pa.array(cuts[:-1])
            other, s = t.column(1), t.column(2)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            pair = np.flatnonzero(pc.greater_equal(other, 0).fill_null(False).to_numpy(zero_copy_only=False))
            size = np.flatnonzero(pc.less(other, 0).fill_null(False).to_numpy(zero_copy_only=False))
            sent = np.bincount(group[size], s.take(pa.array(size)).to_numpy(zero_copy_only=False), len(cuts) - 1).astype(np.int64)
            old = t.column(7).take(node)
            flat = old.flatten()
            ids = np.concatenate([flat.field(1).to_numpy(), other.take(pa.array(pair)).to_numpy(zero_copy_only=False).astype(np.int64)])
            near = np.concatenate([flat.field(0).to_numpy(), s.take(pa.array(pair)).to_numpy(zero_copy_only=False).astype(np.float32)])
            of = np.concatenate([np.repeat(np.arange(len(node)), old.value_lengths().to_numpy()), group[pair]])
            fresh = np.arange(len(ids)) >= len(flat)
            one = _first_of(of, ids, fresh)
            one = one[np.lexsort((ids[one], -near[one], of[one]))]
            place = np.arange(len(one)) - np.searchsorted(of[one], of[one])
            one = one[place < k]
            ends = np.append(0, np.cumsum(np.bincount(of[one], minlength=len(node)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [pa.array(near[one]), pa.array(ids[one]), pa.array(fresh[one])], fields=list(_NEAR_TYPE.value_type)))
            yield pa.RecordBatch.from_arrays([t.column(0).take(node), *(t.column(c).take(node) for c in (3, 4, 5, 6)), lists, pa.array(sent)],
                                             names=["id", "space", "code", "scale", "rest", "near", "sent"])
    return run


def _merged(graph: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    new = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "s")
    own = graph.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("float").alias("s"), "space", "code", "scale", "rest", "near")
    return (own.unionByName(new, allowMissingColumns=True).repartition("id").sortWithinPartitions("id", F.col("other").asc_nulls_first())
            .mapInArrow(_merge(k), _GRAPH))


def _least(k: int) -> Column:
    return F.when(F.size("near") >= k, F.element_at("near", -1)["s"]).otherwise(-3.0).cast("float")


def entry_nodes(nodes: DataFrame, entries: int) -> dict[int, tuple]:
    """``entries`` nodes of each space at most: ids, codes, scales, rests."""
    w = W.partitionBy("space").orderBy(F.xxhash64("id"), "id")
    top = nodes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= entries).select(*nodes.columns).orderBy("space", "id").toArrow()
    out = {}
    for space in sorted(set(top["space"].to_pylist())):
        t = top.filter(pc.equal(top["space"], space))
        out[space] = (t["id"].to_numpy(), np.stack([np.frombuffer(c, np.int8) for c in t["code"].to_pylist()]),
                      t["scale"].to_numpy(), t["rest"].to_numpy())
    return out


def _first_blocks(nodes: DataFrame, entries, n: int, trees: int, leaf: int, emitted: int, seed: int) -> DataFrame:
    """``a, b, s``: near ones of each node out of its blocks."""
    bits = max(1, math.ceil(math.log2(max(2, n / leaf))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for space, (_, code, scale, _) in entries.value.items():
            # hyperplanes half way between two entry nodes each
            x = code * scale[:, None]
            pick = np.random.default_rng([seed, space]).integers(0, len(x), (2, (trees - 1) * bits))
            aim = (x[pick[0]] - x[pick[1]]).T
            planes[space] = aim, ((x[pick[0]] + x[pick[1]]).T * aim).sum(axis=0) / 2
        for b in batches:
            data, at = _bytes(b.column(2))
            out = []
            for i, (space, scale) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_numpy())):
                aim, middle = planes[space]
                side = (data[at[i]: at[i + 1]] * scale) @ aim > middle
                out.append([0, *(side.reshape(trees - 1, bits) @ (1 << np.arange(bits)))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=[*b.schema.names, "cells"])

    celled = staged(nodes.mapInArrow(cells, f"{_NODE}, cells array<long>"), "graph-cells")
    listed = celled.select("id", "space", F.posexplode("cells").alias("tree", "cell"))
    full = staged(listed.groupBy("space", "tree", "cell").agg(F.ceil(F.count("*") / leaf).alias("blocks")).where("blocks > 1"), "graph-full")
    return (celled.select("*", F.posexplode("cells").alias("tree", "cell")).join(full, ["space", "tree", "cell"], "left")
            .withColumn("salt", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.coalesce("blocks", F.lit(1))))
            .repartition("space", "tree", "cell", "salt").sortWithinPartitions("space", "tree", "cell", "salt", "id")
            .select("space", F.col("tree").cast("long").alias("tree"), "cell", "salt", "id", "code", "scale", "rest",
                    F.lit(-3.0).cast("float").alias("least"), F.lit(True).alias("fresh"))
            .mapInArrow(_meet(4, emitted), "a long, b long, s float"))


def build_graph(nodes: DataFrame, entries, k: int, trees: int, leaf: int, rounds: int, emitted: int, block: int, settled: float,
                seed: int) -> DataFrame:
    """``id, space, code, scale, rest, near, sent``: each node's ``k`` nearest found (near: s, id, fresh; nearest first)."""
    put = successive(nodes.sparkSession, "graph")
    n = nodes.count()
    graph = put(_merged(nodes.withColumn("near", F.array().cast("array<struct<s:float,id:long,fresh:boolean>>")),
                        _first_blocks(nodes, entries, n, trees, leaf, emitted, seed), k))
    for r in range(rounds):
        # places that many were sent to in the round before
        crowded = staged(graph.where(F.col("sent") > block).select(
            F.col("id").alias("place"), F.ceil(F.col("sent") / block).alias("blocks")), "graph-crowded")
        sent = (graph.select("id", "code", "scale", "rest", _least(k).alias("least"), F.explode("near").alias("x"))
                .withColumn("place", F.col("x.id")).join(crowded, "place", "left")
                .withColumn("salt", F.pmod(F.xxhash64("id", F.lit(r)), F.coalesce("blocks", F.lit(1))))
                .repartition("place", "salt").sortWithinPartitions("place", "salt", "id")
                .select("place", "salt", "id", "code", "scale", "rest", "least", F.col("x.fresh").alias("fresh")))
        graph = put(_merged(graph, sent.mapInArrow(_meet(2, emitted, block // 2), "a long, b long, s float"), k))
        new = graph.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"])))).first()[0]
        if not new or new < settled * k * n:
            break
    return graph


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, the node's own first: id, query (null for the node), space, code, scale, least, near (id, code,
    scale); rows out: the nodes nearer to a query than ``least``."""
    for t, cuts in _grouped(batches, 1):
        own, own_at = _bytes(t.column(3))
        near = t.column(6)
        flat = near.flatten()
        data, at = _bytes(flat.field(1))
        ends = np.append(0, np.cumsum(near.value_lengths().fill_null(0).to_numpy()))
        ids, scales = flat.field(0).to_numpy(), flat.field(2).to_numpy()
        query, space = (t.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        scale, least = (t.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in (4, 5))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = ends[lo], ends[lo + 1]
            if hi - lo < 2 or a == b:
                continue
            kind = np.float32 if at[a + 1] - at[a] < 1024 else np.float64
            x = data[at[a]: at[b]].reshape(b - a, -1).astype(kind)
            for i in range(lo + 1, hi, _ROWS):
                j = min(hi, i + _ROWS)
                q = own[own_at[i]: own_at[j]].reshape(j - i, -1).astype(kind)
                s = ((q @ x.T) * np.outer(scale[i:j], scales[a:b])).astype(np.float32)
                r, c = np.nonzero(s > least[i:j, None])
                for held, values in zip(out, (query[i + r].astype(np.int64), space[i + r].astype(np.int64), ids[a + c], s[r, c])):
                    held.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query", "space", "id", "s"])


_STATE = "query long, space long, code binary, scale float, beam array<struct<s:float,id:long>>, done array<long>, next array<long>"
_BEAM_TYPE = pa.list_(pa.struct([("s", pa.float32()), ("id", pa.int64())]))


def _step(beam: int, visited: int) -> Callable:
    """A query's beam with what its visits found, and its next visits.  Rows sorted by query and space, the state's
    first: query, space, id (null for the state), s, code, scale, beam, done, next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _grouped(batches, 2):
            head = pa.array(cuts[:-1])
            ids = t.column(2).fill_null(-1).to_numpy()
            s = t.column(3).fill_null(0).to_numpy().astype(np.float32)
            old, done, gone = (t.column(c).take(head) for c in (6, 7, 8))
            beams, dones, nexts = [], [], []
            for g, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                was = old[g].values
                own = np.concatenate([was.field(1).to_numpy(), ids[lo + 1: hi]])
                near = np.concatenate([was.field(0).to_numpy(), s[lo + 1: hi]])
                one = np.unique(own, return_index=True)[1]
                one = one[np.lexsort((own[one], -near[one]))][:beam]
                seen = np.concatenate([done[g].values.to_numpy(), gone[g].values.to_numpy()])
                beams.append(pa.StructArray.from_arrays([pa.array(near[one]), pa.array(own[one])], ["s", "id"]))
                dones.append(seen)
                nexts.append(own[one][~np.isin(own[one], seen)][:visited])

            def lists(parts: list, flat: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).take(head) for c in (0, 1, 4, 5)), lists(beams, pa.concat_arrays(beams)),
                 lists(dones, pa.array(np.concatenate(dones))), lists(nexts, pa.array(np.concatenate(nexts)))],
                names=["query", "space", "code", "scale", "beam", "done", "next"])
    return run


def search(graph: DataFrame, queries: DataFrame, entries, beam: int, visited: int, max_rounds: int = 1000) -> DataFrame:
    """``query, space, beam`` (s, id; nearest first) of each query and space of its length.

    queries: ``query, code, scale, own`` (an array of (s, id, space) to start from).  The entries are visited first where a
    query has no own start in a space."""
    spark = graph.sparkSession

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for query, code, scale, own in zip(*(b.column(i).to_pylist() for i in range(4))):
                q = np.frombuffer(code, np.int8)
                for space, (ids, x, scales, _) in entries.value.items():
                    if space // 4096 != len(q):
                        continue
                    s = ((x.astype(np.float64) @ q) * (scales * np.float32(scale))).astype(np.float32)
                    mine = {o["id"]: o["s"] for o in own if o["space"] == space}
                    best = sorted(((v, i) for i, v in ({int(i): float(v) for i, v in zip(ids, s)} | mine).items()), reverse=True)[:beam]
                    out.append((query, space, code, scale, [{"s": v, "id": i} for v, i in best], [], [*mine] or [i for _, i in best[:visited]]))
            cols = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.binary(), pa.float32(), _BEAM_TYPE, pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types)],
                                             names=["query", "space", "code", "scale", "beam", "done", "next"])

    codes = graph.select(F.col("id").alias("other"), F.col("code").alias("other_code"), F.col("scale").alias("other_scale"))
    near = F.collect_list(F.struct(F.col("other").alias("id"), F.col("other_code").alias("code"), F.col("other_scale").alias("scale")))
    roads = staged(graph.select("id", F.explode("near.id").alias("other")).join(codes, "other").groupBy("id").agg(near.alias("near")), "graph-roads")
    # the entries are where all queries without an own start begin: their rows are copied, and those queries dealt to the copies
    hot = sorted({int(i) for ids, *_ in entries.value.values() for i in ids})
    crowd = spark.createDataFrame([(i, _COPIES) for i in hot], "id long, copies int") if hot else None

    def copies(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(crowd), "id", "left") if crowd is not None else df.withColumn("copies", F.lit(1))
    roads = copies(roads).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    put = successive(spark, "beams")
    state = put(queries.select("query", "code", "scale", "own").mapInArrow(enter, _STATE))
    for _ in range(max_rounds):
        active = state.where(F.size("next") > 0)
        if active.isEmpty():
            break
        least = F.when(F.size("beam") >= beam, F.element_at("beam", -1)["s"]).otherwise(-3.0).cast("float")
        asked = copies(active.select("query", "space", "code", "scale", least.alias("least"), F.explode("next").alias("id")))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("query"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        met = (roads.unionByName(asked, allowMissingColumns=True).repartition("id", "salt")
               .sortWithinPartitions("id", "salt", F.col("query").asc_nulls_first())
               .select(F.xxhash64("id", "salt").alias("id"), "query", "space", "code", "scale", "least", "near"))
        seen = met.mapInArrow(_visit, "query long, space long, id long, s float")
        both = (state.withColumn("id", F.lit(None).cast("long")).withColumn("s", F.lit(None).cast("float"))
                .unionByName(seen, allowMissingColumns=True).repartition("query", "space")
                .sortWithinPartitions("query", "space", F.col("id").asc_nulls_first())
                .select("query", "space", "id", "s", "code", "scale", "beam", "done", "next"))
        state = put(both.mapInArrow(_step(beam, visited), _STATE))
    return state.select("query", "space", "beam")


def _query_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: class, v, space, scale, code of the node: its direction, and itself as a start."""
    for b in batches:
        out, code_of, scale_of = [], [], []
        for v, space, scale, code in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            c, s = _coded(x, float(np.sqrt((x * x).sum())))
            code_of.append(c)
            scale_of.append(s)
            dot = np.frombuffer(c, np.int8).astype(np.float64) @ np.frombuffer(code, np.int8)
            out.append(np.float32(dot * (np.float32(scale) * np.float32(s))))
        own = [[{"s": s, "id": i, "space": p}] for s, i, p in zip(out, b.column(0).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(code_of, pa.binary()), pa.array(scale_of, pa.float32()),
             pa.array(own, pa.list_(pa.struct([("s", pa.float32()), ("id", pa.int64()), ("space", pa.int64())])))],
            names=["query", "code", "scale", "own"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", near: int = 48,
            trees: int = 6, leaf: int = 64, rounds: int = 12, emitted: int = 16, block: int = 256, settled: float = 0.02, entries: int = 256,
            beam: int = 128, visited: int = 64, seed: int = 42) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each row that ``is_query`` (a condition on
    ``vec_id``) holds for.  ``near``: neighbours of a node of the graph."""
    spark = vectors.sparkSession
    with shuffles_dropped(spark):
        rows, classes = representatives(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")), "vec_id", "embedding")
        rows = staged(rows.where("class is not null"), "graph-rows")
        nodes = staged(classes.select("class", "v").mapInArrow(_nodes, _NODE), "graph-nodes")
        start = spark.sparkContext.broadcast(entry_nodes(nodes, entries))    # entries * spaces codes
        graph = build_graph(nodes, start, near, trees, leaf, rounds, emitted, block, settled, seed)
        asking = rows.where(is_query).select("class").distinct().join(classes.select("class", "v"), "class")
        queries = staged(asking.join(nodes.withColumnRenamed("id", "class"), "class").select("class", "v", "space", "scale", "code")
                         .mapInArrow(_query_codes, "query long, code binary, scale float, own array<struct<s:float,id:long,space:long>>"),
                         "graph-queries")
        found = search(graph, queries, start, max(beam, 2 * k), visited)
        original = classes.select("class", F.col("v").cast("array<double>").alias("x"))
        pairs = found.select("query", F.explode(F.slice("beam", 1, 2 * k)).alias("b")).select("query", F.col("b.id").alias("class"))
        scored = (pairs.join(original, "class").join(original.select(F.col("class").alias("query"), F.col("x").alias("q")), "query")
                  .select("query", "class", F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("score")))
        # the best k + 1 rows of a query's vector: one of them may be the query itself
        first = W.partitionBy("class").orderBy("vec_id", "row")
        members = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
        best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
        lists = (scored.join(members, "class").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
                 .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "row", "score"))).alias("best")))
        own = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("self"), F.col("class").alias("query"))
        return staged(own.join(lists, "query").select(
            "query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["row"] != F.col("self")), 1, k)).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score"), "nearest")
