"""Vectors against vectors: the nearest and farthest of a query set, and all similar pairs, by products of blocks.

Both deal their rows to cells.  A cell holds one tile of bounded size and streams the rows it is compared with, so memory
depends neither on the table nor on how many rows are alike.  Products of blocks only say which scores may count; those are
computed again as the native cosine does, one product after the other, and rounded half-even as bround does.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON

#: Bytes of doubles in a tile that a task holds, of queries (with their best so far) and of rows for pairs.
QUERY_TILE_BYTES, PAIR_TILE_BYTES = 4 << 20, 32 << 20
#: Cells at least, where the rows are enough: work for all cores.
CELLS, PAIR_TILES = 64, 10
#: Rows of a stream or of a tile below which it isn't divided.
LEAST_ROWS = 4_096
#: Queries and rows of a product, pairs that are scored again at once, pairs in a batch of results.
BLOCK, PAIRS_AT_ONCE, PAIRS_OUT = (256, 2_048), 16_384, 65_536


class Vectors:
    """Vectors of an Arrow list column as doubles, padded to one width; dim is -1 where a vector or one of its elements is null."""

    def __init__(self, parts: list[pa.Array]):
        made = [_matrix(x) for x in parts]
        width = max((v.shape[1] for v, _ in made), default=0)
        self.v = np.concatenate([_padded(v, width) for v, _ in made]) if made else np.zeros((0, 0))
        self.dim = np.concatenate([d for _, d in made]) if made else np.zeros(0, np.int64)
        self.norm = np.sqrt(_summed(self.v * self.v))
        self.least = self.norm.min(initial=1.0)
        self.plain = bool(np.isfinite(self.norm).all())
        self.unit = self.v / self.norm[:, None] if self.plain and self.least > 0 else None
        self.one_dim = int(self.dim[0]) if len(self.dim) and (self.dim == self.dim[0]).all() else -1

    def __len__(self) -> int:
        return len(self.v)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    n = len(column)
    if n and not values.null_count and sizes.min() == sizes.max() >= 0:
        return values.to_numpy().astype(np.float64).reshape(n, sizes[0]), sizes.astype(np.int64)
    rows = column.to_pylist()
    dim = np.array([-1 if r is None or None in r else len(r) for r in rows], np.int64)
    out = np.zeros((n, max(0, dim.max(initial=0))))
    for i in np.flatnonzero(dim > 0):
        out[i, : dim[i]] = rows[i]
    return out, dim


def _padded(v: np.ndarray, width: int) -> np.ndarray:
    return v if v.shape[1] == width else np.pad(v, ((0, 0), (0, width - v.shape[1])))


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows, one number after the other from the left."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _scores(q: Vectors, r: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    width = min(q.v.shape[1], r.v.shape[1])
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        a, b = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
        out[at : at + PAIRS_AT_ONCE] = _summed(q.v[a, :width] * r.v[b, :width]) / (q.norm[a] * r.norm[b] + EPSILON)
    return out


def _units(score: np.ndarray, digits: int) -> np.ndarray:
    """Scores in units of the last digit, rounded half-even by their decimal form; what is not a number is beyond all."""
    x = score * 10.0**digits
    out = np.rint(x) + 0.0
    out[np.isnan(x)] = np.inf
    for n in np.flatnonzero(np.abs(np.abs(x - np.trunc(x)) - 0.5) < 1e-6):
        out[n] = float(Decimal(repr(float(score[n]))).scaleb(digits).to_integral_value(ROUND_HALF_EVEN))
    return out


def _products(q: Vectors, r: Vectors, i: slice, j: slice) -> np.ndarray:
    """Cosines of a block to within a hundredth of a unit of the sixth digit; -inf where there is none, inf where it is not a number."""
    width = min(q.v.shape[1], r.v.shape[1])
    if q.unit is not None and r.unit is not None and q.least * r.least > 0.2:  # EPSILON is then under a hundredth
        out = q.unit[i, :width] @ r.unit[j, :width].T
    else:
        with np.errstate(all="ignore"):
            out = q.v[i, :width] @ r.v[j, :width].T
            out /= q.norm[i, None] * r.norm[None, j] + EPSILON
    if not (q.plain and r.plain):
        out[np.isnan(out)] = np.inf
    if q.one_dim < 0 or q.one_dim != r.one_dim:
        out[(q.dim[i, None] != r.dim[None, j]) | (q.dim[i, None] < 0)] = -np.inf
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array([*column.to_pylist(), None], object)[:-1]


class _Best:
    """The k best of each query so far: the highest score in units, of equal ones the one that came first."""

    def __init__(self, queries: int, k: int, digits: int):
        self.queries, self.k, self.scale = queries, k, 10.0**digits
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, units, place, id
        self.more: list[tuple] = []
        self.n_more = 0
        self.limit = np.full(queries, -np.inf)  # what a later row must reach
        self.full = np.zeros(queries, bool)

    def limits(self, i: slice, block: np.ndarray, extra: int) -> np.ndarray:
        """Lower bounds of the scores that may count; a query that isn't full takes this block's own best."""
        limit, need = self.limit[i], self.k + extra
        if block.shape[1] > need and not self.full[i].all():
            todo = np.flatnonzero(~self.full[i])
            least = np.partition(block[todo], block.shape[1] - need, axis=1)[:, block.shape[1] - need]
            limit = limit.copy()
            limit[todo] = (np.rint(least * self.scale) - 0.52) / self.scale
        return limit

    def add(self, query: np.ndarray, units: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        self.more.append((query, units, place, ids))
        self.n_more += len(query)
        if self.n_more > max(PAIRS_OUT, self.queries * self.k):
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        query, units, place, ids = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        self.more, self.n_more = [], 0
        order = np.lexsort((place, -units, query))
        q = query[order]
        start = np.searchsorted(q, np.arange(self.queries))
        rank = np.arange(len(q)) - start[q]
        keep = order[rank < self.k]
        self.kept = query[keep], units[keep], place[keep], ids[keep]
        last = order[rank == self.k - 1]
        self.full[query[last]] = True
        with np.errstate(invalid="ignore"):
            self.limit[query[last]] = np.where(units[last] == -np.inf, np.finfo(float).min, (units[last] + 0.48) / self.scale)


def _runs(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, side, rows) of neighbouring rows."""
    key = np.asarray(table.column("cell")).astype(np.int64) * 2 + np.asarray(table.column("side"))
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(key[a] // 2), int(key[a] % 2), table.slice(a, b - a)


def _sorted_cells(df: DataFrame, cells: int, order: str) -> DataFrame:
    return df.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "side", order)


def nearest(vectors: DataFrame, queries: DataFrame, near: int, far: int = 0, but_self: bool = False, digits: int = 6) -> DataFrame:
    """(far, query_id, id, rank, score): for each query the `near` rows of highest rounded cosine and the `far` of lowest (with
    the score negated), ties by id.  Tables have id, v and query_id, q; but_self leaves out rows whose id is the query's.

    Exact.  Queries are dealt to tiles of measured size, rows to streams; what leaves a task is the best rows of each
    query in a stream, and the number of streams falls as that of the tiles rises."""
    size = queries.agg(F.coalesce(F.sum(8 * F.greatest(F.size("q"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    tiles = max(1, -(-int(size) // QUERY_TILE_BYTES))
    rows = vectors.select("id", "v") if not but_self else vectors.select("id", "v").filter("id is not null")
    least = max(CELLS, 3 * vectors.sparkSession.sparkContext.defaultParallelism)
    streams = max(1, min(-(-least // tiles), -(-rows.count() // LEAST_ROWS)))
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    tile, stream = F.pmod(F.xxhash64("query_id", "q"), F.lit(tiles)).cast("int"), F.pmod(F.xxhash64("id", "v"), F.lit(streams)).cast("int")
    asked = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(streams - 1)), lambda s: tile * streams + s)).alias("cell"), F.lit(0).alias("side"), null(vectors, "id").alias("id"), "query_id", F.col("q").alias("v"))
    given = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: t * streams + stream)).alias("cell"), F.lit(1).alias("side"), "id", null(queries, "query_id").alias("query_id"), "v")
    dealt = _sorted_cells(asked.union(given), tiles * streams, "id")
    kinds = [(bool(f), k) for f, k in ((0, near), (1, far)) if k]
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, names, held, best, place = -1, [], [], None, [], 0

        def done():
            for (is_far, _), b in zip(kinds, best, strict=True):
                b.merge()
                query, units, _, ids = b.kept
                score = pa.array(np.where(np.isinf(units), np.nan, units / 10.0**digits), mask=units == -np.inf, from_pandas=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), is_far)), pa.concat_arrays(names).take(pa.array(query)), pa.array(ids, id_of), score], ["far", "query_id", "id", "score"])

        for batch in batches:
            id_of = batch.schema.field("id").type
            for at, side, part in _runs(batch):
                if at != cell:
                    if held is not None:
                        yield from done()
                    cell, asked, names, held, place = at, [], [], None, 0
                if side == 0:
                    asked.append(part.column("v"))
                    names.append(part.column("query_id"))
                    continue
                if not asked:
                    continue
                if held is None:
                    held = Vectors(asked)
                    best = [_Best(len(held), k, digits) for _, k in kinds]
                    own = np.concatenate([_ids(x) for x in names])
                given, ids = Vectors([part.column("v")]), _ids(part.column("id"))
                extra = max(part.column("id").value_counts().field(1).to_pylist()) if but_self else 0
                for y in range(0, len(given), BLOCK[1]):
                    for x in range(0, len(held), BLOCK[0]):
                        i, j = slice(x, x + BLOCK[0]), slice(y, y + BLOCK[1])
                        block = _products(held, given, i, j)
                        for (is_far, _), b in zip(kinds, best, strict=True):
                            if is_far:
                                odd = np.isinf(block)  # no score is last, and no number first, in both orders
                                np.negative(block, out=block, where=~odd)
                            p = np.flatnonzero(block >= b.limits(i, block, extra)[:, None])
                            a, c = p // block.shape[1] + x, p % block.shape[1] + y
                            if but_self:
                                other = ids[c] != own[a]
                                p, a, c = p[other], a[other], c[other]
                            units = _units(_scores(held, given, a, c), digits)
                            if is_far:
                                units = np.where(np.isinf(units), units, 0.0 - units)
                            units[block.ravel()[p] == -np.inf] = -np.inf
                            b.add(a, units, c + place, ids[c])
                    for b in best:
                        if not b.full.all():
                            b.merge()
                place += len(given)
        if held is not None:
            yield from done()

    found = dealt.mapInArrow(run, f"far boolean, query_id {query_type}, id {id_type}, score double")
    by = Window.partitionBy("far", "query_id").orderBy(F.desc("score"), F.asc("id"))
    k = F.when(F.col("far"), far).otherwise(near)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("far", "query_id", "id", "rank", "score")


def pair_tiles(rows: int, size: int) -> int:
    return max(1, min(PAIR_TILES, -(-rows // LEAST_ROWS)), -(-size // PAIR_TILE_BYTES))


def similar_pairs(vectors: DataFrame, least: float, digits: int = 6, tile_rows: int | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b whose rounded cosine reaches `least`: exact; ids are integers.

    Rows are dealt to tiles; a cell holds one tile and streams another (or itself), so a row travels once for each tile and
    once more.  There are PAIR_TILES tiles until one would be over PAIR_TILE_BYTES: so far what travels grows as the table
    does, beyond as its square, in steps of that size."""
    rows = vectors.select("id", "v").filter("id is not null and v is not null")
    if tile_rows is None:
        seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v")), F.lit(0)).alias("bytes")).first()
        tiles = pair_tiles(seen["n"], seen["bytes"])
    else:
        tiles = max(1, -(-rows.count() // tile_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    # cell of tiles t <= u: u (u + 1) / 2 + t
    cell = lambda t, u: F.floor(u * (u + 1) / 2).cast("int") + t
    upper, lower = F.transform(F.sequence(F.col("tile"), F.lit(tiles - 1)), lambda u: cell(F.col("tile"), u)), F.transform(F.sequence(F.lit(0), F.col("tile")), lambda t: cell(t, F.col("tile")))
    dealt = rows.withColumn("tile", own)
    held = dealt.select(F.explode(upper).alias("cell"), F.lit(0).alias("side"), "id", "v")
    given = dealt.select(F.explode(lower).alias("cell"), F.lit(1).alias("side"), "id", "v")
    cells = tiles * (tiles + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, names, tile, out, n_out = -1, [], [], None, [], 0

        def made():
            a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "score"])

        for batch in batches:
            for at, side, part in _runs(batch):
                if at != cell:
                    cell, parts, names, tile = at, [], [], None
                if side == 0:
                    parts.append(part.column("v"))
                    names.append(part.column("id"))
                    continue
                if not parts:
                    continue
                if tile is None:
                    tile = Vectors(parts)
                    own = np.concatenate([np.asarray(x).astype(np.int64) for x in names])
                    same = int((np.sqrt(8 * cell + 1) - 1) // 2)
                    same = cell == same * (same + 1) // 2 + same
                rows, ids = Vectors([part.column("v")]), np.asarray(part.column("id")).astype(np.int64)
                for y in range(0, len(rows), BLOCK[1]):
                    for x in range(0, len(tile), BLOCK[0]):
                        i, j = slice(x, x + BLOCK[0]), slice(y, y + BLOCK[1])
                        if same and own[i].min() >= ids[j].max():
                            continue  # rows come by id, so half of the blocks have no a < b
                        block = _products(tile, rows, i, j)
                        p = np.flatnonzero(block >= least - 0.52 / 10.0**digits)
                        a, b = p // block.shape[1] + x, p % block.shape[1] + y
                        if same:
                            first = own[a] < ids[b]
                            a, b = a[first], b[first]
                        units = _units(_scores(tile, rows, a, b), digits)
                        score = np.where(np.isinf(units), np.nan, units / 10.0**digits)
                        keep = ~(score < least)
                        left, right = own[a[keep]], ids[b[keep]]
                        out.append((np.minimum(left, right), np.maximum(left, right), score[keep]))
                        n_out += len(left)
                        if n_out > PAIRS_OUT:
                            yield made()
                            out, n_out = [], 0
        if n_out:
            yield made()

    return _sorted_cells(held.union(given), cells, "id").mapInArrow(run, "a long, b long, score double")
