"""Distance-limited ligand-receptor transport between spots.

Per sample and LR, on the spot pairs with distance d <= r (self pair included):
  K_ij = exp(-(d_ij / r)^2 / eps)
  a_i  = ligand level / total ligand, b_j = receptor level / total receptor
  u = (a / K v)^rho,  v = (b / K^T u)^rho,  rho = lam / (lam + eps),  v0 = 1
  flow_ij = u_i K_ij v_j
Sparse unbalanced Sinkhorn.  A spot is one row with its levels and partners; a slide is cut into
square tiles.  Each of ``iters`` iterations carries a value two pairs far, so a task that also holds
the spots around its tile, that far and one pair more, gets every flow of the tile's own spots
without another shuffle.  Competition between LRs for shared subunits is not modelled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import cut_lineage, ship_library

KEYS = ["sample", "barcode"]
#: side of a tile, in widths of the rim around it
TILE_RIMS = 6


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for every entry, one after another."""
    first = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(first - start, count)


class _Tile:
    """Spots of one tile and its rim, the pairs between them, and the flow of every LR."""

    def __init__(self, rows: pa.Table, r: float, eps: float, rho: float, iters: int) -> None:
        self.eps, self.r, self.rho, self.iters = eps, r, rho, iters
        names = rows.column("barcode").to_pylist()
        order = sorted(set(names))                  # a spot's number is its place in the order of names
        number = {b: i for i, b in enumerate(order)}
        self.names, self.n = pa.array(order, pa.string()), len(order)
        spot = np.array([number[b] for b in names])
        # a spot that comes with several positions keeps them all; its levels and pairs come with each
        by = np.argsort(spot, kind="stable")
        self.x, self.y = (rows.column(c).to_numpy()[by] for c in ("x", "y"))
        self.places = np.bincount(spot, minlength=self.n)
        self.first = np.cumsum(self.places) - self.places
        self.own = np.zeros(self.n, bool)
        self.own[spot[rows.column("own").to_numpy(zero_copy_only=False)]] = True
        one = np.zeros(len(names), bool)
        one[by[self.first]] = True
        who, l = self._entries(rows, "l", one, spot)
        _, w = self._entries(rows, "w", one, spot)
        self.levels = who, l.to_numpy(), w.to_numpy()
        src, dst = self._entries(rows, "dst", one, spot)
        _, d = self._entries(rows, "d", one, spot)
        codes = dst.dictionary_encode()
        at = np.array([number.get(b, -1) for b in codes.dictionary.to_pylist()], np.int64)
        dst = at[codes.indices.to_numpy()] if len(codes) else np.empty(0, np.int64)
        here = dst >= 0                             # partners beyond the rim
        self.src, self.dst = src[here], dst[here]
        self.k = np.exp(-((d.to_numpy()[here] / r) ** 2) / eps)

    @staticmethod
    def _entries(rows: pa.Table, name: str, one: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        lists = rows.column(name).combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        values, keep = lists.flatten(), np.repeat(one, size)
        return np.repeat(spot, size)[keep], values.filter(pa.array(keep))

    def flows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(LR, src, dst, flow) of the pairs with an end among the tile's own spots."""
        who, side, w = self.levels
        by = np.argsort(side, kind="stable")
        who, side, w = who[by], side[by], w[by]
        near = self.own[self.src] | self.own[self.dst]
        for lr in np.unique(side // 2):
            a, b = np.full(self.n, np.nan), np.full(self.n, np.nan)     # nan: no level
            for level, s in ((a, 2 * lr), (b, 2 * lr + 1)):
                lo, hi = np.searchsorted(side, [s, s + 1])
                level[who[lo:hi]] = w[lo:hi]
            e = np.flatnonzero(~(np.isnan(a[self.src]) | np.isnan(b[self.dst])))
            if not len(e):
                continue
            src, dst, k = self.src[e], self.dst[e], self.k[e]
            u, v = np.zeros(self.n), np.ones(self.n)
            sends, gets = np.unique(src), np.unique(dst)
            for _ in range(self.iters):
                u[sends] = (a[sends] / np.bincount(src, k * v[dst], self.n)[sends]) ** self.rho
                v[gets] = (b[gets] / np.bincount(dst, k * u[src], self.n)[gets]) ** self.rho
            m = near[e]
            src, dst = src[m], dst[m]
            yield int(lr), src, dst, u[src] * k[m] * v[dst]

    def field(self, src: np.ndarray, dst: np.ndarray, flow: np.ndarray, top: int, sender: bool) -> tuple[np.ndarray, ...]:
        """(spot, vx, vy) of the tile's own spots; see ``direction_field``."""
        me, other = (src, dst) if sender else (dst, src)
        mine = self.own[me]
        me, other, flow = me[mine], other[mine], flow[mine]
        total = np.bincount(me, flow, self.n)
        # every position of the one end with every position of the other
        n_me, n_other = self.places[me], self.places[other]
        at = np.repeat(np.arange(len(me)), n_me * n_other)
        place = _ranges(np.zeros(len(me), np.int64), n_me * n_other)
        p, q = self.first[me[at]] + place // n_other[at], self.first[other[at]] + place % n_other[at]
        sign = 1.0 if sender else -1.0
        dx, dy = sign * (self.x[q] - self.x[p]), sign * (self.y[q] - self.y[p])
        dd = np.sqrt(dx * dx + dy * dy)
        far = dd > 0
        at, dx, dy, dd = at[far], dx[far], dy[far], dd[far]
        me, other, flow = me[at], other[at], flow[at]
        by = np.lexsort((other, -flow, me))
        me, flow, dx, dy, dd = me[by], flow[by], dx[by], dy[by], dd[by]
        rank = np.arange(len(me)) - np.searchsorted(me, me)
        best = rank < top
        me, flow, dx, dy, dd = me[best], flow[best], dx[best], dy[best], dd[best]
        vx, vy = (np.bincount(me, flow * (c / dd), self.n) for c in (dx, dy))
        spots = np.unique(me)
        vx, vy, total = vx[spots], vy[spots], total[spots]
        n = np.sqrt(vx * vx + vy * vy)
        scale = np.where(n > 0, n, 1.0)
        return spots, np.where(n > 0, vx / scale * total, 0.0), np.where(n > 0, vy / scale * total, 0.0)


class _Tiles:
    """The tiles behind a flow: spot rows by (sample, tx, ty), the LRs' names, and what an LR's flow counts for."""

    def __init__(self, rows: DataFrame, names: list[str], placed: bool, r: float, eps: float, rho: float, iters: int,
                 groups: list[tuple[str | None, list[int]]] | None = None, key: str = "lr") -> None:
        self.rows, self.names, self.placed, self.key = rows, names, placed, key
        self.args, self.groups = (r, eps, rho, iters), groups

    def by(self, groups: list[tuple[str | None, list[int]]], key: str) -> _Tiles:
        """The same tiles, flows added up over the LRs of each group and over equal pairs."""
        return _Tiles(self.rows, self.names, self.placed, *self.args, groups, key)

    def run(self, emit: Callable, cols: str) -> DataFrame:
        """``emit`` (tile, src, dst, flow) -> (list of arrays) for every tile and key."""
        args, names, groups = self.args, self.names, self.groups

        def flows(tile: _Tile) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
            if groups is None:
                for lr, src, dst, flow in tile.flows():
                    yield names[lr], src, dst, flow
                return
            found = {lr: x for lr, *x in tile.flows()}
            for name, lrs in groups:
                some = [found[lr] for lr in lrs if lr in found]
                if some:
                    src, dst, flow = (np.concatenate(c) for c in zip(*some))
                    pair, which = np.unique(src * tile.n + dst, return_inverse=True)
                    yield name, pair // tile.n, pair % tile.n, np.bincount(which, flow)

        def one(rows: pa.Table) -> pa.Table:
            out = []
            if rows.column("own").to_numpy().any():
                tile = _Tile(rows, *args)
                sample = rows.column("sample")[0].as_py()
                for name, src, dst, flow in flows(tile):
                    for columns in emit(tile, src, dst, flow):
                        head = [pa.repeat(pa.scalar(v, pa.string()), len(columns[-1])) for v in (sample, name)]
                        out.append(pa.RecordBatch.from_arrays([*head, *columns], names=fields))
            return pa.Table.from_batches(out, schema=schema)

        fields = [c.split()[0] for c in cols.split(", ")]
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.float64()) for c in cols.split(", ")])
        ship_library(self.rows.sparkSession)
        return self.rows.groupBy("sample", "tx", "ty").applyInArrow(one, cols)

    def field(self, top: int) -> DataFrame:
        def emit(tile: _Tile, src: np.ndarray, dst: np.ndarray, flow: np.ndarray) -> Iterator[list[pa.Array]]:
            for name in ("sender", "receiver"):
                spot, vx, vy = tile.field(src, dst, flow, top, name == "sender")
                yield [tile.names.take(pa.array(spot)), pa.array(vx), pa.array(vy), pa.repeat(pa.scalar(name), len(spot))]

        out = self.run(emit, f"sample string, {self.key} string, barcode string, vx double, vy double, direction string")
        return out.filter(F.col(self.key).isNotNull())

    def flow(self) -> DataFrame:
        def emit(tile: _Tile, src: np.ndarray, dst: np.ndarray, flow: np.ndarray) -> Iterator[list[pa.Array]]:
            own = tile.own[src]
            yield [tile.names.take(pa.array(src[own])), tile.names.take(pa.array(dst[own])), pa.array(flow[own])]

        out = self.run(emit, f"sample string, {self.key} string, src string, dst string, flow double")
        out._tiles = self
        return out


def lr_transport(ce: DataFrame, pairs: DataFrame, r: float, eps: float = 0.1, lam: float = 1.0,
                 iters: int = 5, spots: DataFrame | None = None) -> DataFrame:
    """(sample, lr, src, dst, flow) from complex expression ``ce`` and pairs (sample, src, dst, d).

    ``spots`` (sample, barcode, x, y): positions that the pairs come from; without them a sample is
    one tile."""
    ends = pairs.select("sample", F.col("src").alias("barcode")).unionByName(pairs.select("sample", F.col("dst").alias("barcode")))
    placed = spots is not None
    if not placed:
        spots = ends.distinct().select(*KEYS, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    # LRs of the catalogue, by number
    names = sorted(row[0] for row in ce.select("lr").distinct().dropna().collect())
    number = ce.sparkSession.createDataFrame([(lr, i) for i, lr in enumerate(names)], "lr string, i int")
    lev = ce.filter(F.col("value").isNotNull() & F.col("side").isin("L", "R"))
    total = lev.groupBy("sample", "lr", "side").agg(F.sum("value").alias("_t"))
    lev = (lev.join(F.broadcast(total), ["sample", "lr", "side"]).join(F.broadcast(number), "lr")       # samples x LRs
           .select(*KEYS, (F.col("i") * 2 + F.when(F.col("side") == "R", 1).otherwise(0)).alias("l"),
                   (F.col("value") / F.col("_t")).alias("w")))
    lev = lev.groupBy(*KEYS).agg(F.collect_list(F.struct("l", "w")).alias("_l"))
    near = pairs.dropna(subset=["src", "dst"]).groupBy("sample", F.col("src").alias("barcode")).agg(
        F.collect_list(F.struct("dst", "d")).alias("_p"))
    reach = float(pairs.agg(F.max("d")).first()[0] or 0.0)
    rim = max((2 * iters + 1) * reach, 1e-9)
    side = TILE_RIMS * rim
    tile = lambda c, by: F.floor((F.col(c) + F.lit(by * rim)) / F.lit(side))
    over = lambda c, out: F.explode(F.sequence(tile(c, -1.001), tile(c, 1.001))).alias(out)
    t = (spots.select(*KEYS, "x", "y").join(lev.hint("merge"), KEYS, "left").join(near.hint("merge"), KEYS, "left")
         .filter(F.col("_l").isNotNull() | F.col("_p").isNotNull())
         .select(*KEYS, "x", "y", "_l", "_p"))
    blank = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c.split(".")[1])
    t = t.select("*", over("x", "tx")).select("*", over("y", "ty")).select(
        "sample", "tx", "ty", "barcode", "x", "y", ((F.col("tx") == tile("x", 0)) & (F.col("ty") == tile("y", 0))).alias("own"),
        blank("_l.l", "int"), blank("_l.w", "double"), blank("_p.dst", "string"), blank("_p.d", "double"))
    return _Tiles(t, names, placed, r, eps, lam / (lam + eps), iters).flow()


def spot_amounts(flow: DataFrame) -> DataFrame:
    """Sent (as source) and received (as destination) totals per spot and LR."""
    s = flow.groupBy("sample", "lr", F.col("src").alias("barcode")).agg(F.sum("flow").alias("sent"))
    r = flow.groupBy("sample", "lr", F.col("dst").alias("barcode")).agg(F.sum("flow").alias("received"))
    return s.join(r, ["sample", "lr", "barcode"], "full").fillna(0.0, ["sent", "received"])


def pathway_sum(amounts: DataFrame, lr_db: DataFrame) -> DataFrame:
    """Sent / received per (pathway, spot) plus the all-pathway total (pathway NULL)."""
    t = amounts.join(lr_db.select("lr", "pathway"), "lr")
    keys = [F.col(c) for c in ("sample", "barcode", "pathway")]
    return t.groupingSets([keys, keys[:2]], *keys).agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))


def pathway_flow(flow: DataFrame, lr_db: DataFrame) -> DataFrame:
    """Flow per (pathway, spot pair): the LRs of a pathway added up, inside the tiles of ``lr_transport``."""
    tiles = getattr(flow, "_tiles", None)
    if tiles is not None and tiles.key == "lr":
        # one row per LR of the catalogue
        at = {lr: i for i, lr in enumerate(tiles.names)}
        groups: dict = {}
        for row in lr_db.select("lr", "pathway").collect():
            if row["lr"] in at:
                groups.setdefault(row["pathway"], []).append(at[row["lr"]])
        return tiles.by(list(groups.items()), "pathway").flow()
    t = flow.join(lr_db.select("lr", "pathway"), "lr")
    return t.groupBy("sample", "pathway", "src", "dst").agg(F.sum("flow").alias("flow"))


def direction_field(flow: DataFrame, spots: DataFrame, k: int = 5, key: str = "lr") -> DataFrame:
    """Per spot, sender vector = sum over the k strongest partners of flow * unit(x_j - x_i),
    normalised and scaled by the spot's total sent flow; receiver vector likewise from incoming
    flow with the direction reversed.  d = 0 pairs are skipped.  ``key``: what flows are kept apart
    by (``lr``, or ``pathway`` on the output of ``pathway_flow``).

    On flows as ``lr_transport`` and ``pathway_flow`` return them, made with ``spots``, the partners of
    a spot never leave its tile; other flows are joined with the positions."""
    tiles = getattr(flow, "_tiles", None)
    if tiles is not None and tiles.placed and tiles.key == key:
        return tiles.field(k)
    pos = spots.select("sample", F.col("barcode").alias("b"), "x", "y")

    def side(f: DataFrame, me: str, other: str, sign: float, name: str) -> DataFrame:
        f = f.join(pos.withColumnRenamed("b", me).withColumnRenamed("x", "xm").withColumnRenamed("y", "ym"), ["sample", me])
        f = f.join(pos.withColumnRenamed("b", other).withColumnRenamed("x", "xo").withColumnRenamed("y", "yo"),
                   ["sample", other])
        dx, dy = F.col("xo") - F.col("xm"), F.col("yo") - F.col("ym")
        dd = F.sqrt(dx * dx + dy * dy)
        f = f.filter(dd > 0).select("sample", key, F.col(me).alias("barcode"), other, "flow",
                                    (F.lit(sign) * dx / dd).alias("ux"), (F.lit(sign) * dy / dd).alias("uy"))
        tot = flow.groupBy("sample", key, F.col(me).alias("barcode")).agg(F.sum("flow").alias("total"))
        w = Window.partitionBy("sample", key, "barcode").orderBy(F.desc("flow"), other)
        top = f.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        vec = top.groupBy("sample", key, "barcode").agg(F.sum(F.col("flow") * F.col("ux")).alias("vx"),
                                                         F.sum(F.col("flow") * F.col("uy")).alias("vy"))
        n = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
        out = vec.join(tot, ["sample", key, "barcode"]).select(
            "sample", key, "barcode",
            F.when(n > 0, F.col("vx") / n * F.col("total")).otherwise(F.lit(0.0)).alias("vx"),
            F.when(n > 0, F.col("vy") / n * F.col("total")).otherwise(F.lit(0.0)).alias("vy"))
        return out.withColumn("direction", F.lit(name))

    return side(flow, "src", "dst", 1.0, "sender").unionByName(side(flow, "dst", "src", -1.0, "receiver"))


def direction_grid(field: DataFrame, spots: DataFrame, cell: float, q: float = 0.995) -> DataFrame:
    """Mean vector per grid cell (floor(x / cell), floor(y / cell)); vector lengths clipped at
    their exact ``q`` quantile per (sample, lr, direction)."""
    f = field.join(spots.select(*KEYS, "x", "y"), KEYS)
    g = f.groupBy("sample", "lr", "direction", F.floor(F.col("x") / cell).alias("gx"),
                  F.floor(F.col("y") / cell).alias("gy")).agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    g = g.withColumn("len", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    g = cut_lineage(g)      # read for the quantiles and again to be clipped
    qs = g.groupBy("sample", "lr", "direction").agg(F.percentile("len", q).alias("_q"))
    g = g.join(qs, ["sample", "lr", "direction"])
    scale = F.when(F.col("len") > F.col("_q"), F.col("_q") / F.col("len")).otherwise(F.lit(1.0))
    return g.select("sample", "lr", "direction", "gx", "gy", (F.col("vx") * scale).alias("vx"),
                    (F.col("vy") * scale).alias("vy"), F.least("len", "_q").alias("len"))
