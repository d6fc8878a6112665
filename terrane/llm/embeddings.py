"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components
from .shingles import mix

LINKS, BUILD_BEAM, STEP = 32, 32, 4
TOP = 64  # nodes of the highest layer at most
MARGIN = 0.02  # under the threshold, so far go walks from link to link
PART = 4096  # nodes of a graph in a row
VISITED = 32_000_000  # bytes of visited marks at once
WIDTH = 16  # of beams, unless audits ask for more
MEND, ROUNDS = 4, 32  # links to a node that its own search missed, and rounds of them at most


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as float32 of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of similarity (-1: none), those that are closer to their node than to any chosen before,
    most at most; then the nearest of the others, up to half of most in all. -1 fills the rest."""
    v = vectors[np.maximum(near, 0)]
    between = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        blocked = (chosen & (between[:, j, :] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = (near[:, j] >= 0) & ~blocked & (chosen.sum(axis=1) < most)
    spare = (near >= 0) & ~chosen
    room = np.maximum(0, most // 2 - chosen.sum(axis=1))
    chosen |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(near, order, 1), -1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def top(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam(queries: np.ndarray, entries: np.ndarray, vectors: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest nodes that a best-first walk of links from entries (rows of nodes) finds, for all queries at
    once: (ids, sims), -1 where there are fewer."""
    n, found_ids, found_sims = len(vectors), [], []
    for low in range(0, len(queries), step := max(1, min(1024, VISITED // max(n, 1)))):
        q, ids = queries[low : low + step], entries[low : low + step]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[rows, ids] = True
        sims = np.einsum("bed,bd->be", vectors[ids], q)
        ids, sims = top(ids, sims, width)
        pad = width - ids.shape[1]
        ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2.0)
        done = ids < 0
        while True:
            open_ = ~done
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            order = np.argsort(~open_[live], axis=1, kind="stable")[:, :STEP]  # sorted by similarity already
            go = np.take_along_axis(open_[live], order, 1)
            at = np.where(go, np.take_along_axis(ids[live], order, 1), -1)
            done[live[:, None], order] = True
            near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(live), -1)
            near = np.where(near < 0, n, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            # The same node by two ways counts once.
            by = np.argsort(near, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            sorted_ = np.take_along_axis(near, by, 1)
            np.put_along_axis(twice, by[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~twice
            new = np.full(near.shape, -2.0, np.float32)
            r, c = np.nonzero(fresh)
            new[r, c] = np.einsum("ij,ij->i", vectors[near[r, c]], q[live[r]])
            all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
            all_sims = np.concatenate((sims[live], new), axis=1)
            all_done = np.concatenate((done[live], ~fresh), axis=1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_done))
        found_ids.append(ids)
        found_sims.append(sims)
    return np.concatenate(found_ids), np.concatenate(found_sims)


class Graph:
    """Layers from the full one (0) up, each of a sixteenth of the nodes below: (nodes, links between their places).
    Nodes of a similarity of near or more are a group."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, near: float = 0.9):
        self.vectors, self.near = vectors, near
        self.layers = layers
        if layers is None:
            self.layers, nodes = [], np.arange(len(vectors))
            height = mix(np.arange(len(vectors), dtype=np.uint64) + np.uint64(1))
            sets = [nodes]
            while len(sets[-1]) > TOP:
                sets.append(nodes[height >> np.uint64(64 - 4 * len(sets)) == 0])
            for nodes in reversed([s for s in sets if len(s)]):  # the upper layers help to build the lower
                self.layers.insert(0, (nodes, self._built(nodes)))
            self._mend()

    def entries(self, queries: np.ndarray, above: int, count: int = 4) -> np.ndarray | None:
        """Places near the queries in the layer under `above`."""
        if above >= len(self.layers):
            return None
        nodes, links = self.layers[above]
        start = self.entries(queries, above + 1)
        if start is None:
            sims = queries @ self.vectors[nodes].T
            ids = np.argsort(-sims, axis=1)[:, :count]
        else:
            ids, _ = beam(queries, start, self.vectors[nodes], links, 16)
            ids = np.where(ids[:, :count] < 0, ids[:, :1], ids[:, :count])
        return np.searchsorted(self.layers[above - 1][0], nodes[ids]) if above and self.layers[above - 1] is not None else ids

    def _built(self, nodes: np.ndarray) -> np.ndarray:
        v = self.vectors[nodes]
        links = np.full((len(nodes), LINKS), -1, np.int32)
        order = np.argsort(mix(nodes.astype(np.uint64) + np.uint64(99)), kind="stable")
        # Places in order of insertion; the walk needs none but those inserted.
        done, inverse = 0, np.empty(len(nodes), np.int64)
        inverse[order] = np.arange(len(nodes))
        while done < len(nodes):
            new = order[done : done + min(max(64, done), 2048)]
            sims = v[new] @ v[new].T
            np.fill_diagonal(sims, -2.0)
            near, s = top(np.broadcast_to(new, sims.shape), sims, min(BUILD_BEAM, len(new)))
            near = np.where(s <= -2.0, -1, near)
            if done:
                start = order[:1] if done < 256 else order[: done : max(1, done // 64)][:64]
                best = np.argsort(-(v[new] @ v[start].T), axis=1)[:, :4]
                ids, found = beam(v[new], start[best], v, links, BUILD_BEAM)
                near, s = top(np.concatenate((near, ids), 1), np.concatenate((s, found), 1), BUILD_BEAM)
            chosen = diverse(near, s, v, LINKS)
            links[new] = chosen
            # Links back: each target chooses among its own and the new ones.
            frm, to = np.repeat(new, LINKS)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
            strength = np.einsum("ij,ij->i", v[frm], v[to])
            by = np.lexsort((-strength, to))
            frm, to = frm[by], to[by]
            targets, first = np.unique(to, return_index=True)
            turn = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
            some = turn < LINKS
            offered = np.full((len(targets), LINKS), -1, np.int64)
            offered[np.searchsorted(targets, to[some]), turn[some]] = frm[some]
            for low in range(0, len(targets), 1024):
                t = targets[low : low + 1024]
                both = np.concatenate((links[t], offered[low : low + 1024]), axis=1)
                order_ = np.sort(both, axis=1)
                same = np.concatenate((np.zeros((len(t), 1), bool), order_[:, 1:] == order_[:, :-1]), axis=1)
                both = np.where(same, -1, order_)
                sims = np.where(both >= 0, np.einsum("bed,bd->be", v[np.maximum(both, 0)], v[t]), -2.0)
                links[t] = diverse(*top(both, sims, both.shape[1]), v, LINKS)
            done += len(new)
        return links

    def _missed(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes, those that a search for them misses, and the nodes that it meets instead, the nearest first."""
        v, links = self.vectors, self.layers[0][1]
        q, step = v[nodes], max(1, VISITED // (8 * len(v)))
        met, _ = self.search(q, WIDTH)
        away = ~(met == nodes[:, None]).any(axis=1)
        # Upper layers may lead to a node that its group doesn't: a beam that spreads has the links of the group alone.
        at = links[nodes]
        sims = np.einsum("bed,bd->be", v[np.maximum(at, 0)], q)
        sims = np.where((at >= 0) & (sims >= self.near), sims, 2.0)
        rows, last = np.flatnonzero(~away & (sims < 2.0).any(axis=1)), sims.argmin(axis=1)
        if len(rows):
            met[rows], _ = beam(q[rows], at[rows, last[rows]][:, None], v, links, WIDTH)
            away[rows] = ~(met[rows] == nodes[rows, None]).any(axis=1)
        # Beams that are full of nodes as near as the node itself spread to it.
        rows = np.flatnonzero(away)
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            r, c = np.nonzero(met[some] >= 0)
            r, found = spread(self, q[some], r, met[some][r, c].astype(np.int64), 1 - MARGIN)
            away[some[r[nodes[some[r]] == found]]] = False
        return nodes[away], met[away]

    def _mend(self) -> None:
        """Links in the full layer to nodes that a search for them misses, from the nearest nodes that it meets. Without
        them, a few nodes that hardly any links lead to make audits widen the beams of all queries.

        A node gives one such link a round, as one into a group may open all of it. Others that met the same get one from
        those that it went to, if they are as near: equal directions hardly link. Where no node has room, all get more.
        What is missed after the last round is left to audits."""
        more = lambda x: np.pad(x, ((0, 0), (0, MEND)), constant_values=-1)
        nodes, links = self.layers[0]
        lost = nodes
        for _ in range(ROUNDS):
            lost, met = (np.concatenate(x) for x in zip(*(self._missed(lost[i : i + 1024]) for i in range(0, len(lost), 1024)), strict=True))
            if not len(lost):
                break
            if not (links[met[met >= 0]] < 0).any():
                links = more(links)
            given, heirs = np.zeros(len(links), bool), {}
            for node, by in zip(lost.tolist(), met, strict=True):
                best, some = int(by[0]), by[by >= 0]
                some = some[~given[some] & (links[some] < 0).any(axis=1)][:MEND]
                after, count = heirs.get(best, ([], 0))
                if not len(some) and after:
                    heir = after[count // MEND]
                    if self.vectors[node] @ self.vectors[heir] >= self.vectors[node] @ self.vectors[best] - 1e-6:
                        links = links if (links[heir] < 0).any() else more(links)
                        some, count = np.array([heir]), count + 1
                if len(some):
                    links[some, (links[some] < 0).argmax(axis=1)] = node
                    given[some] = True
                    after.append(node)
                    heirs[best] = after, count
            self.layers[0] = nodes, links

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.entries(queries, 1)
        if start is None:
            start = np.broadcast_to(np.arange(min(4, len(self.vectors))), (len(queries), min(4, len(self.vectors))))
        return beam(queries, start, self.vectors, self.layers[0][1], width)


def spread(graph: Graph, queries: np.ndarray, rows: np.ndarray, nodes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Beams without a bound: from the pairs (row of queries, node) on, along links to every node that is as near as
    floor less MARGIN. Returns the pairs of floor or more."""
    links, n = graph.layers[0][1], len(graph.vectors)
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True
    seen[rows, nodes] = True
    out = []
    while len(rows):
        sims = np.einsum("ij,ij->i", graph.vectors[nodes], queries[rows])
        out.append((rows[sims >= floor], nodes[sims >= floor]))
        go = sims >= floor - MARGIN
        rows, nodes = np.repeat(rows[go], links.shape[1]), links[nodes[go]].ravel()
        nodes = np.where(nodes < 0, n, nodes)
        new = ~seen[rows, nodes]
        both = np.unique(rows[new] * n + nodes[new])
        rows, nodes = both // n, both % n
        seen[rows, nodes] = True
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (rows, nodes)


def linked(graph: Graph, queries: np.ndarray, floor: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of queries, node) of similarity floor or more that beams of a width find. A beam that links fill
    spreads on from them until it has met no more."""
    ids, sims = graph.search(queries, width)
    near = (ids >= 0) & (sims >= floor - MARGIN)
    full = near.all(axis=1)
    x, y = np.nonzero((sims >= floor) & (ids >= 0) & ~full[:, None])
    r, c = np.nonzero(near & full[:, None])
    more = spread(graph, queries, r, ids[r, c].astype(np.int64), floor)
    return np.concatenate((x, more[0])), np.concatenate((ids[x, y], more[1]))


def audited(graph: Graph, queries: np.ndarray, floor: float, recall: float, audits: int, width: int = WIDTH) -> int:
    """The width of beams with which evenly spread queries find recall of the pairs that a product with all nodes has:
    doubled until it does. A beam as wide as the shard meets all that can be reached."""
    sample = queries[np.unique(np.linspace(0, len(queries) - 1, min(audits, len(queries))).astype(int))]
    step = max(1, VISITED // (8 * len(graph.vectors)))
    blocks = [sample[i : i + step] for i in range(0, len(sample), step)]
    true = sum(int((b @ graph.vectors.T >= floor).sum()) for b in blocks)
    while width < len(graph.vectors) and sum(len(linked(graph, b, floor, width)[0]) for b in blocks) < recall * true:
        width *= 2
    return width


class Forest:
    """Components of numbered things, and the links that joined them."""

    def __init__(self, n: int):
        self.up, self.joined = np.arange(n), []

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            if (up == x).all():
                return x
            x = self.up[up]

    def join(self, one: int, others: np.ndarray) -> None:
        roots, at = np.unique(self.roots(others), return_index=True)
        own = int(self.roots(np.array([one]))[0])
        if len(roots) == 1 and roots[0] == own:
            return
        self.joined += [(one, int(others[i])) for r, i in zip(roots, at, strict=True) if r != own]
        least = min(own, int(roots[0]))
        self.up[roots] = self.up[own] = least
        self.up[one], self.up[others] = least, least


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, d1, d2, vec): dim null where the vector is null, empty, zero or has a null or non-finite component."""

    def read(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.zeros(0)
                ok = len(v) and np.isfinite(v).all() and v.any()
                raw = (v + 0.0).tobytes()
                d = xxhash.xxh3_128_digest(raw)
                out.append((len(v), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), raw) if ok else (None,) * 4)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["vec_id", "dim", "d1", "d2", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(read, "vec_id long, dim int, d1 long, d2 long, vec binary")


def near_duplicates(vectors: DataFrame, at: float = 0.9, recall: float = 0.999, audits: int = 256, shards: int = 8, most: int = 250_000) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for every vector.

    Equal vectors are one class. Classes are dealt to `shards` shards, more if one would have over `most`; each builds
    its graph. Every class queries every shard. The queries are dealt to as many chunks as there are shards, so the
    graphs move as often as the queries do, and a task has a shard and a chunk of about its size. Links of a cosine (in
    double precision) of at or more count, those that the query's own search found. A chunk returns each query's number
    of links and enough links to join what they join; its pairs exist for some queries at a time only. Recall is audited
    in every chunk and shard.

    Null, empty, zero and non-finite vectors link with nothing; vectors of different lengths are never linked; repeated
    rows count as vectors each; a null vec_id links with nothing but equal vectors, whose component it has; an empty
    table gives no rows; other columns aren't read.
    """
    rows = Written(usable(vectors), "hnsw-rows").df
    classes = Written(
        rows.where("dim is not null and vec_id is not null").groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")),
        "hnsw-classes",
    ).df
    n = classes.count()
    shards = max(shards, -(-n // most))
    sharded = classes.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "vec")

    def build(table):
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), float).reshape(table.num_rows, -1)
        graph = Graph(unit(x), near=at)
        ids, many = table.column("id").to_numpy(), table.column("n").to_numpy()
        links = graph.layers[0][1]
        rest = pickle.dumps(graph.layers[1:])
        cuts = range(0, len(x), PART)
        get = lambda a: [np.ascontiguousarray(a[i : i + PART]).tobytes() for i in cuts]
        return pa.table(
            {"dim": [x.shape[1]] * len(cuts), "shard": [table.column("shard")[0].as_py()] * len(cuts), "part": list(range(len(cuts))), "ids": get(ids), "many": get(many), "vecs": get(x), "links": get(links), "upper": [rest if i == 0 else b"" for i in cuts]},
            schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "many", "vecs", "links", "upper"))]),
        )

    graphs = sharded.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, part int, ids binary, many binary, vecs binary, links binary, upper binary")
    graphs = Written(graphs, "hnsw-graphs").df

    def ask(left, right):
        if not left.num_rows or not right.num_rows:
            return empty
        order = np.argsort(left.column("part").to_numpy())
        get = lambda c, kind: np.frombuffer(b"".join(left.column(c)[int(i)].as_py() for i in order), kind)
        ids, many = get("ids", np.int64), get("many", np.int64)
        x = get("vecs", float).reshape(len(ids), -1)
        upper = pickle.loads(left.column("upper")[int(order[0])].as_py())
        graph = Graph(unit(x), [(np.arange(len(ids)), get("links", np.int32).reshape(len(ids), -1)), *upper])
        own, mult = right.column("id").to_numpy(), right.column("n").to_numpy()
        q = np.frombuffer(b"".join(right.column("vec").to_pylist()), float).reshape(len(own), -1)
        scaled = lambda v: v / np.abs(v).max(axis=1, keepdims=True)
        qs, xs, qu, floor = scaled(q), scaled(x), unit(q), at - 1e-4
        qn, xn = np.linalg.norm(qs, axis=1), np.linalg.norm(xs, axis=1)
        width = audited(graph, qu, floor, recall, audits)
        # Queries and nodes as numbers: those of the queries, then those of nodes that are no query here.
        every, number = np.unique(np.concatenate((own, ids)), return_inverse=True)
        q_number, x_number = number[: len(own)], number[len(own) :]
        forest, count = Forest(len(every)), np.zeros(len(own), np.int64)
        for low in range(0, len(own), step := max(1, min(1024, VISITED // (8 * len(ids))))):
            rows_, nodes = linked(graph, qu[low : low + step], floor, width)
            rows_ = rows_ + low
            ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", qs[r], xs[m]) / (qn[r] * xn[m]) >= at for r, m in ((rows_[i : i + 65536], nodes[i : i + 65536]) for i in range(0, len(rows_), 65536)))])
            ok &= q_number[rows_] != x_number[nodes]
            rows_, nodes = rows_[ok], nodes[ok]
            by = np.argsort(rows_, kind="stable")
            rows_, nodes = rows_[by], nodes[by]
            np.add.at(count, rows_, many[nodes])
            some, first = np.unique(rows_, return_index=True)
            for i, j, k in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(nodes)], strict=False):
                forest.join(int(q_number[i]), x_number[nodes[j:k]])
        home = np.isin(own, ids)
        count[home] += mult[home] - 1
        # A spanning forest of the links is enough for components.
        a, b = ([int(every[p[k]]) for p in forest.joined] for k in (0, 1))
        some = count > 0
        return pa.table({"a": pa.array(np.concatenate((own[some], np.array(a, np.int64)))), "b": pa.array([None] * int(some.sum()) + b, pa.int64()), "n": pa.array(np.concatenate((count[some], np.zeros(len(a), np.int64))))})

    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    asked = classes.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("chunk"), "id", "n", "vec")
    given = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dim", "shard", "chunk"]
    found = Written(given.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(ask, "a long, b long, n long"), "hnsw-links").df
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    comps = components(found.where("b is not null").select("a", "b"), "hnsw")
    of_class = classes.select("d1", "d2", "id").join(counts.withColumnRenamed("a", "id"), "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("d1", "d2", "n_links", F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
