"""Exact k nearest neighbours over nested vocabularies, all of them from one search.

The vector of a row over the smaller of two vocabularies is a prefix of that over the larger one, where terms are numbered by falling
document frequency. So rows are written, ordered and read once for all points of a feature curve, and the products over a band of
columns count for every vocabulary that holds the band. Rows that are equal over a vocabulary are merged there: one of
them stands for all, as in ``knn``. With one neighbour a train row is its own nearest: beside its group only rows that
differ by less than the rounding of squared distances vote, and these are found by a join of bounded lengths, not by the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators import knn
from litsieve.operators.terms import tally
from litsieve.session import drop_scratch, materialize, scratch_mark, scratch_path, ship_package
from litsieve.sources.bodies import file_path, open_root

FILE_COLUMNS = ["idx", "val", "first", "cell", "n_true", "n_false"]
#: Entries of a task's queries.
SLICE_ENTRIES = 3 << 20
#: A column is multiplied entry by entry where less than this share of the pairs of a cell's rows and queries use it, if a band has a FEW of them.
THIN = 0.0016
FEW = 64
#: Where more than this share of the queries reach a block all are multiplied, which saves a copy of their rows.
FULL = 0.6
BLOCK_ROWS = 2_048
#: Squared distances below this are rounded to 0; rows so near differ by at most ``NEAR`` in any length.
SAME = 0.5 * 10.0**-knn.DIGITS
NEAR = math.sqrt(SAME) + 1e-6
#: Lengths of a row, over columns that leave the same remainder, that two near rows must share; width of a cell of the first two.
PARTS = 4
CELL = 1.5e-4
PAIR_ROWS = 512


class _Rows:
    """Sparse rows: entries with the band of each one's column, squared lengths by band, and over each vocabulary."""

    def __init__(self, table: pa.Table | pa.RecordBatch, sizes: np.ndarray) -> None:
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        idx, val = one(table.column("idx")), one(table.column("val"))
        self.n, self.bands = len(idx), len(sizes)
        counts = np.diff(np.asarray(idx.offsets))
        self.row = np.repeat(np.arange(self.n), counts)
        self.idx = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.val = val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.entries = int(counts.max(initial=0))
        self.slot = self.row * self.bands + np.searchsorted(sizes, self.idx, "right")
        self.square = self.val * self.val
        self.band_squares = np.bincount(self.slot, self.square, self.n * self.bands).reshape(self.n, self.bands)
        self.norm = np.cumsum(self.band_squares, axis=1)

    def place(self, columns: np.ndarray) -> None:
        """Finds the entries on sorted ``columns``; those elsewhere are left out from here on, and of repeated ones all but the last."""
        places = np.full(max(self.idx.max(initial=0), columns.max(initial=0)) + 1, -1)
        places[columns] = np.arange(len(columns))
        self.at = places[self.idx]
        on = self.at >= 0
        on[:-1] &= (self.row[1:] != self.row[:-1]) | (self.idx[1:] != self.idx[:-1])
        if not on.all():
            self.row, self.at, self.val, self.slot = (x[on] for x in (self.row, self.at, self.val, self.slot))
        #: Ends of each row's entries on each vocabulary; they are ordered by column.
        ends = np.bincount(self.slot, minlength=self.n * self.bands).reshape(self.n, self.bands).cumsum(axis=1)
        self.starts = np.r_[0, np.cumsum(ends[:, -1])]
        self.ends = self.starts[:-1, None] + ends

    def take(self, rows: np.ndarray, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``rows``, entry) of the entries of ``rows`` on a vocabulary."""
        counts = self.ends[rows, band] - self.starts[rows]
        to = np.repeat(np.arange(len(rows)), counts)
        return to, np.arange(len(to)) + np.repeat(self.starts[rows] - (np.cumsum(counts) - counts), counts)


class _Queries:
    """A task's queries over the columns that they use, and what was found for each vocabulary."""

    def __init__(self, table: pa.Table, sizes: np.ndarray, k: int) -> None:
        self.rows = _Rows(table, sizes)
        self.n, self.bands = self.rows.n, len(sizes)
        self.columns = np.unique(self.rows.idx)
        self.rows.place(self.columns)
        self.cuts = np.searchsorted(self.columns, sizes)
        self.share = np.bincount(self.rows.at, minlength=len(self.columns)) / self.n
        self.norm, self.length = self.rows.norm, np.sqrt(self.rows.band_squares)
        #: Upper bounds of the squared k-th distances; a row that another one stands for reaches nothing.
        self.bound = np.full((self.n, self.bands), np.inf)
        self.bound[table.column("first").to_numpy()[:, None] > np.arange(self.bands)] = -np.inf
        self.near = [knn._Nearest(self.n, k, 1) for _ in sizes]
        for band, near in enumerate(self.near):
            near.bound = self.bound[:, band : band + 1]
        self.buffers = [np.empty(knn.PRODUCT_QUERIES * knn.PRODUCT_ROWS, np.float32) for _ in range(2)]
        self.dense = np.zeros((knn.PRODUCT_ROWS, len(self.columns)))


def _cells(cells: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of a cell; those of few rows are joined."""
    starts = [0]
    for cut in np.flatnonzero(cells[1:] != cells[:-1]) + 1:
        if cut - starts[-1] >= knn.PRODUCT_ROWS:
            starts.append(int(cut))
    return list(zip(starts, [*starts[1:], len(cells)], strict=True))


def _lengths(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares, 0.0))


def _banded(of: _Rows, entries: slice, rows: tuple[int, int], values: np.ndarray) -> np.ndarray:
    """Sums of ``values``, those of the entries of a run of rows, over each vocabulary."""
    low, high = rows
    slots = of.slot[entries] - low * of.bands
    return np.bincount(slots, values, (high - low) * of.bands).reshape(high - low, of.bands).cumsum(axis=1)


class _File:
    """The rows of a train file in blocks of near ones, and lower bounds of the squared distances of all queries to the blocks.

    All arrays by band or vocabulary have it as their last axis.
    """

    def __init__(self, queries: _Queries, train: _Rows, counts: dict) -> None:
        self.queries, self.train, self.counts = queries, train, counts
        train.place(queries.columns)
        self.cells = _cells(counts["cell"])
        self.blocks = [(low, min(high, low + knn.PRODUCT_ROWS)) for start, high in self.cells for low in range(start, high, knn.PRODUCT_ROWS)]
        starts = np.array([low for low, _ in self.blocks])
        # no product with a row is larger than that with the greatest values of its block
        most = np.zeros((len(starts), len(queries.columns)), np.float32)
        block = np.zeros((knn.PRODUCT_ROWS, len(queries.columns)), np.float32)
        for b, (low, high) in enumerate(self.blocks):
            entries = slice(train.starts[low], train.starts[high])
            block[train.row[entries] - low, train.at[entries]] = np.abs(train.val[entries])
            most[b] = block.max(axis=0)
            block[train.row[entries] - low, train.at[entries]] = 0.0
        shortest = np.minimum.reduceat(train.norm, starts)
        self.least = np.empty((queries.n, len(starts), queries.bands))
        rows = queries.rows
        for start in range(0, queries.n, knn.PRODUCT_QUERIES):
            some = slice(start, min(queries.n, start + knn.PRODUCT_QUERIES))
            entries = slice(rows.starts[some.start], rows.starts[some.stop])
            dense = np.zeros((some.stop - start, len(queries.columns)), np.float32)
            dense[rows.row[entries] - start, rows.at[entries]] = np.abs(rows.val[entries])
            product = np.zeros((some.stop - start, len(starts)))
            for band, (low, high) in enumerate(zip(np.r_[0, queries.cuts[:-1]], queries.cuts, strict=True)):
                product += dense[:, low:high] @ most[:, low:high].T
                known = queries.norm[some, band, None] + shortest[:, band]
                self.least[some, :, band] = known - 2.0 * (1 + 1e-3) * product - 1e-6 * (1e-3 + known)
        self._part(_lengths(queries.norm), _lengths(train.norm), slice(0, len(starts)), starts)
        at = self.at = np.cumsum([0, *(-(-(high - low) // knn.PRODUCT_ROWS) for low, high in self.cells)])
        for cell, (low, high) in enumerate(self.cells):
            own = slice(train.starts[low], train.starts[high])
            centre = np.bincount(train.at[own], train.val[own], len(queries.columns)) / (high - low)
            ends = np.r_[0.0, np.cumsum(centre * centre)][queries.cuts]
            far = [
                _lengths(of.norm[part] - 2.0 * _banded(of, entries, rows, of.val[entries] * centre[of.at[entries]]) + ends)
                for of, entries, rows, part in ((rows, slice(None), (0, rows.n), slice(None)), (train, own, (low, high), slice(low, high)))
            ]
            blocks = slice(at[cell], at[cell + 1])
            self._part(*far, blocks, starts[blocks] - low)

    def _part(self, own: np.ndarray, their: np.ndarray, blocks: slice, starts: np.ndarray) -> None:
        """Raises the bounds of blocks by the triangle inequality: distances of the queries and of the rows to one point."""
        least, most = np.minimum.reduceat(their, starts), np.maximum.reduceat(their, starts)
        for start in range(0, len(own), knn.PRODUCT_QUERIES):
            some = slice(start, start + knn.PRODUCT_QUERIES)
            gap = np.maximum(np.maximum(own[some, None] - most, least - own[some, None]) - knn.SLACK, 0.0)
            part = self.least[some, blocks]
            np.maximum(part, gap * gap, out=part)

    def offer(self) -> None:
        at = self.at
        means = self.least.mean(axis=(0, 2))
        for cell in np.argsort([means[a:b].min() for a, b in zip(at, at[1:])], kind="stable"):
            _Cell(self, cell, slice(at[cell], at[cell + 1])).offer()


class _Cell:
    """Rows of a cell. Columns that many of its rows and of the queries use are multiplied as dense matrices, the others entry by entry."""

    def __init__(self, file: _File, cell: int, blocks: slice) -> None:
        queries, train = file.queries, file.train
        self.file, self.queries, self.train, self.blocks = file, queries, train, blocks
        low, high = file.cells[cell]
        share = np.bincount(train.at[train.starts[low] : train.starts[high]], minlength=len(queries.columns)) / (high - low) * queries.share
        self.thin = (share > 0) & (share < THIN)
        bands = list(zip(np.r_[0, queries.cuts[:-1]], queries.cuts, strict=True))
        for low, high in bands:
            if np.count_nonzero(self.thin[low:high]) < FEW:
                self.thin[low:high] = False
        self.thin_bands = [self.thin[low:high].any() for low, high in bands]
        main = (share > 0) & ~self.thin
        # a band's columns, and two more that raise its product
        width = np.array([np.count_nonzero(main[low:high]) for low, high in bands])
        self.ends = np.cumsum(width + 2)
        self.begins = self.ends - width - 2
        self.place = np.full(len(queries.columns), -1)
        self.place[main] = np.concatenate([np.arange(b, b + w) for b, w in zip(self.begins, width, strict=True)])
        self.rounding = (max(queries.rows.entries, train.entries) + 32 + 4 * queries.bands) * 1.2e-7

    def _matrix(self, of: _Rows, to: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
        place = self.place[of.at[entries]]
        inside = place >= 0
        out = np.zeros((n, self.ends[-1]), np.float32)
        out[to[inside], place[inside]] = of.val[entries][inside]
        return out

    def _thin_entries(self, of: _Rows, to: np.ndarray, entries: np.ndarray) -> list:
        """(row, column, value) of the entries on thin columns, by band."""
        on = self.thin[of.at[entries]]
        to, at, val, band = to[on], of.at[entries][on], of.val[entries][on], of.slot[entries][on] % of.bands
        return [(to[own], at[own], val[own]) if thin else None for b, thin in enumerate(self.thin_bands) for own in [band == b]]

    def _block(self, low: int, high: int) -> dict:
        """The rows of a block, ordered by the first vocabulary over which they stand for themselves."""
        train, first = self.train, self.file.counts["first"]
        rows = low + np.argsort(first[low:high], kind="stable")
        to, entries = train.take(rows)
        right = self._matrix(train, to, entries, len(rows))
        squares = train.band_squares[rows]
        right[:, self.ends - 2], right[:, self.ends - 1] = squares * (self.rounding - 1) / 2, self.rounding * np.sqrt(squares)
        lists = []
        for found in self._thin_entries(train, to, entries):
            if found is not None:
                row, column, val = found
                order = np.argsort(column.astype(np.uint16) if len(self.place) < 1 << 16 else column, kind="stable")
                sizes = np.bincount(column, minlength=len(self.place))
                found = (row[order], val[order], sizes, np.cumsum(sizes) - sizes)
            lists.append(found)
        held = np.searchsorted(first[rows], np.arange(train.bands), "right")
        return {"rows": rows, "right": right, "lists": lists, "held": held, "entries": (to, train.at[entries], train.val[entries])}

    def offer(self) -> None:
        """Products in single precision, raised by a bound of each one's error, choose the pairs; the distances of these are computed in
        double precision."""
        queries, least = self.queries, self.file.least[:, self.blocks]
        every = np.flatnonzero((least <= queries.bound[:, None]).any(axis=(1, 2)))
        made: dict = {}
        for start in range(0, len(every), knn.PRODUCT_QUERIES):
            some = every[start : start + knn.PRODUCT_QUERIES]
            to, entries = queries.rows.take(some)
            left = self._matrix(queries.rows, to, entries, len(some))
            left[:, self.ends - 2], left[:, self.ends - 1] = 1.0, queries.length[some]
            thin = self._thin_entries(queries.rows, to, entries)
            for block in np.argsort(least[some].mean(axis=(0, 2)), kind="stable"):
                reach = least[some, block] <= queries.bound[some]
                met = reach.any(axis=1)
                if not met.any():
                    continue
                if block not in made:
                    made[block] = self._block(*self.file.blocks[self.blocks.start + block])
                if met.mean() > FULL:
                    self._offer_block(left, thin, some, reach, made[block])
                else:
                    self._offer_block(left[met], _kept(thin, met), some[met], reach[met], made[block])

    def _offer_block(self, left: np.ndarray, thin: list, active: np.ndarray, reach: np.ndarray, block: dict) -> None:
        shape = (len(left), len(block["rows"]))
        total, part = (b[: shape[0] * shape[1]].reshape(shape) for b in self.queries.buffers)
        reached = reach.any(axis=0)
        last = reach.shape[1] - 1 - reach[:, ::-1].argmax(axis=1)
        for band in range(int(np.flatnonzero(reached).max()) + 1):
            alive = last >= band
            if alive.mean() <= FULL:
                # the other queries reach the block over smaller vocabularies only
                left, active, reach, last, thin = left[alive], active[alive], reach[alive], last[alive], _kept(thin, alive)
                total, part = total[alive], self.queries.buffers[1][: len(left) * shape[1]].reshape(len(left), shape[1])
            columns = slice(self.begins[band], self.ends[band])
            np.matmul(left[:, columns], block["right"][:, columns].T, out=part if band else total)
            if band:
                np.add(total, part, out=total)
            if thin[band] is not None:
                _add_thin(total, thin[band], block["lists"][band])
            if reached[band] and block["held"][band]:
                self._choose(band, total[:, : block["held"][band]], active, reach[:, band], block)
        self._clear(block)

    def _clear(self, block: dict) -> None:
        if block.pop("dense", None):
            self.queries.dense[block["entries"][:2]] = 0.0

    def _exact(self, band: int, x: np.ndarray, y: np.ndarray, block: dict) -> np.ndarray:
        """Squared distances of queries ``x`` and rows ``y`` of the block over a vocabulary."""
        queries, rows = self.queries, self.queries.rows
        if "dense" not in block:
            queries.dense[block["entries"][:2]] = block["entries"][2]
            block["dense"] = True
        d2 = np.empty(len(x))
        step = max(1, knn.EXACT_CELLS // max(1, rows.entries))
        for at in range(0, len(x), step):
            i, j = x[at : at + step], y[at : at + step]
            to, entries = rows.take(i, band)
            product = np.bincount(to, rows.val[entries] * queries.dense[j[to], rows.at[entries]], len(i))
            d2[at : at + step] = queries.norm[i, band] + self.train.norm[block["rows"][j], band] - 2.0 * product
        return np.round(np.maximum(d2, 0.0), knn.DIGITS)

    def _choose(self, band: int, closeness: np.ndarray, active: np.ndarray, open_: np.ndarray, block: dict) -> None:
        """``closeness`` of a query and a train row is at least a . b - |b|^2 / 2, whatever the rounding: the larger, the nearer."""
        queries, near, width = self.queries, self.queries.near[band], closeness.shape[1]
        norm = queries.norm[active, band]

        def chosen() -> np.ndarray:
            bound = queries.bound[active, band]
            closest = np.where(open_ & np.isfinite(bound), (norm - np.where(np.isfinite(bound), bound, 0.0)) / 2 - 2e-9, 0.0)
            least = (closest - 2.4e-7 * np.abs(closest)).astype(np.float32)
            least[np.isinf(bound)] = -np.inf
            least[~open_] = np.inf
            return np.flatnonzero(closeness >= least[:, None])

        found = chosen()
        if len(found) > knn.CROWD * near.k * np.count_nonzero(open_) and width >= near.k:
            # each train row stands for one neighbour at least: any k of them bound the k-th distance
            own = np.flatnonzero(open_)
            best = np.argpartition(closeness[own], width - near.k, axis=1)[:, width - near.k :]
            worst = self._exact(band, np.repeat(active[own], near.k), best.ravel(), block).reshape(-1, near.k).max(axis=1)
            queries.bound[active[own], band] = np.minimum(queries.bound[active[own], band], worst)
            found = chosen()
        if not len(found):
            return
        i, j = np.divmod(found, width)
        i = active[i]
        d2 = self._exact(band, i, j, block)
        kept = d2 <= queries.bound[i, band]
        i, j, d2 = i[kept], j[kept], d2[kept]
        if near.k == 1:
            np.minimum.at(queries.bound[:, band], i, d2)
        other = block["rows"][j]
        t, f = (self.file.counts[c][other, band] for c in ("t", "f"))
        near.add(row=i, d2=d2, n=np.ones(len(i), np.int64), first=np.zeros(len(i), np.int64), t=t, f=f)


def _kept(thin: list, rows: np.ndarray) -> list:
    """The entries of some rows, numbered anew."""
    new = np.cumsum(rows) - 1
    return [x and (new[x[0][own]], x[1][own], x[2][own]) for x in thin for own in [x and rows[x[0]]]]


def _add_thin(total: np.ndarray, queries: tuple, lists: tuple) -> None:
    """Adds the products over thin columns: each query's entry meets the list of its column's entries in the block."""
    (row, column, val), (list_rows, list_vals, sizes, starts) = queries, lists
    counts = sizes[column]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    if n:
        entries = np.arange(n) + np.repeat(starts[column] - (ends - counts), counts)
        to = np.repeat(row * total.shape[1], counts) + list_rows[entries]
        np.add(total, np.bincount(to, np.repeat(val, counts) * list_vals[entries], total.size).reshape(total.shape), out=total, casting="unsafe")


def _tallies(column: pa.ChunkedArray, first: np.ndarray, bands: int) -> np.ndarray:
    """Votes of each row over each vocabulary; a row has them from its first one on."""
    out = np.zeros((len(first), bands), np.int64)
    out[np.arange(bands) >= first[:, None]] = column.combine_chunks().flatten().to_numpy()
    return out


def _slices(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
    """The batches of a task as tables of at most ``most_rows`` rows and about ``SLICE_ENTRIES`` entries."""
    for table in knn._slices(batches, most_rows):
        upto = np.cumsum([0, *(len(chunk) for chunk in table.column("idx").chunks)])
        sizes = np.concatenate([np.diff(np.asarray(chunk.offsets)) for chunk in table.column("idx").chunks])
        part = np.cumsum(sizes) // SLICE_ENTRIES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), upto[-1]]
        yield from (table.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _search(root: str, files: list[tuple[str, int, int]], sizes: Sequence[int], k: int, slice_rows: int):
    """Per query and vocabulary: the distance levels that can hold a k-th neighbour, from the train files below ``root``."""
    bands = len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = open_root(root)
        schema = pa.schema([("q", pa.string()), ("subset", pa.int32()), ("d2", pa.float64()), ("n_true", pa.int64()), ("n_false", pa.int64()), ("nearer", pa.int64())])
        for table in _slices(batches, slice_rows):
            queries = _Queries(table, np.array(sizes), k)
            cells = np.sort(table.column("cell").to_numpy())
            own = [np.searchsorted(cells, high, "right") - np.searchsorted(cells, low) for _, low, high in files]
            # files of most queries' cells first: their bounds drop others
            for i in np.argsort(-np.array(own), kind="stable"):
                with place.open_input_file(f"{base}/{files[i][0]}") as source:
                    read = pq.read_table(source, columns=FILE_COLUMNS)
                first = read.column("first").to_numpy()
                counts = {"first": first, "cell": read.column("cell").to_numpy()}
                counts |= {c: _tallies(read.column(x), first, bands) for c, x in (("t", "n_true"), ("f", "n_false"))}
                _File(queries, _Rows(read, np.array(sizes)), counts).offer()
                for near in queries.near:
                    near.compact()
            for band, near in enumerate(queries.near):
                for found in near.table(table.column("q").to_numpy()):
                    yield pa.RecordBatch.from_pandas(found.assign(subset=np.int32(band)), schema=schema, preserve_index=False)

    return run


def _prefix_key(size: int) -> Column:
    """128 bits of the vector over the first ``size`` columns."""
    n = F.size(F.filter("idx", lambda i: i < size))
    idx, val = F.slice("idx", F.lit(1), n), F.slice("val", F.lit(1), n)
    return F.concat_ws("-", F.xxhash64(F.lit(1), idx, val), F.xxhash64(F.lit(2), idx, val))


def _place(df: DataFrame, pivots: list[tuple[np.ndarray, np.ndarray]], sizes: Sequence[int]) -> DataFrame:
    """Adds ``cell``, the pivot of the nearest direction, the length, and ``parts``: for each vocabulary ``PARTS`` lengths of a train row."""
    bands = len(sizes)
    width = 1 + max([int(i.max(initial=0)) for i, _ in pivots] + [max(sizes, default=0)])
    directions = np.zeros((width, len(pivots)))
    for c, (idx, val) in enumerate(pivots):
        directions[idx, c] = val / max(math.sqrt(float(val @ val)), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIR_ROWS):
                part = batch.slice(start, PAIR_ROWS)
                rows = _Rows(part, np.array(sizes))
                product = np.zeros((rows.n, len(pivots)))
                held = np.flatnonzero(np.diff(np.searchsorted(rows.row, np.arange(rows.n + 1))))
                if len(held):
                    product[held] = np.add.reduceat(rows.val[:, None] * directions[rows.idx], np.searchsorted(rows.row, held), axis=0)
                lengths = np.bincount(rows.slot * PARTS + rows.idx % PARTS, rows.square, rows.n * bands * PARTS).reshape(rows.n, bands, PARTS)
                lengths = np.sqrt(np.cumsum(lengths, axis=1)).reshape(rows.n, -1)
                keep = np.where(part.column("has").to_numpy(zero_copy_only=False), bands * PARTS, 0)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(keep)].astype(np.int32), lengths[keep > 0].ravel())
                more = [pa.array(product.argmax(axis=1).astype(np.int32)), pa.array(np.sqrt(rows.norm[:, -1])), lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "cell", "length", "parts"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema + ", cell int, length double, parts array<double>")


def _same_rows(placed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(subset, q, other): train rows that are not equal over a vocabulary, but so near that their rounded distance is 0."""
    bands = F.sequence(F.col("first"), F.lit(len(sizes) - 1))
    parts = [F.element_at("parts", F.col("subset") * PARTS + p + 1).alias(f"p{p}") for p in range(PARTS)]
    each = placed.filter("has").select("q", "parts", F.explode(bands).alias("subset")).select("q", "subset", *parts)
    each = materialize(each, "knn-lengths")
    cell = lambda x: F.floor(x / CELL)
    there = each.select("subset", F.col("q").alias("other"), *(F.col(f"p{p}").alias(f"o{p}") for p in range(PARTS)),
                        cell(F.col("p0")).alias("c0"), cell(F.col("p1")).alias("c1"))
    here = each
    for p in range(2):
        here = here.withColumn(f"c{p}", F.explode(F.sequence(cell(F.col(f"p{p}") - NEAR), cell(F.col(f"p{p}") + NEAR))))
    near = F.col("q") != F.col("other")
    for p in range(PARTS):
        near &= F.abs(F.col(f"p{p}") - F.col(f"o{p}")) <= NEAR
    pairs = materialize(here.join(there, ["subset", "c0", "c1"]).filter(near).select("subset", "q", "other"), "knn-pairs")
    if pairs.isEmpty():
        return pairs
    vectors = placed.filter("has").select("q", "idx", "val")
    both = pairs.join(vectors, "q").join(vectors.toDF("other", "other_idx", "other_val"), "other")

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PAIR_ROWS):
                part = batch.iloc[start : start + PAIR_ROWS]
                columns = knn._columns(part["idx"], part["other_idx"])
                a, b = knn._dense(part["idx"], part["val"], columns), knn._dense(part["other_idx"], part["other_val"], columns)
                inside = columns[None, :] < np.array(sizes)[part["subset"].to_numpy()][:, None]
                d2 = (np.where(inside, a - b, 0.0) ** 2).sum(axis=1)
                yield part.loc[np.round(d2, knn.DIGITS) == 0, ["subset", "q", "other"]]

    return materialize(both.mapInPandas(same, "subset int, q string, other string"), "knn-same")


def _train_files(train: DataFrame, n_train: int, order: list[Column]) -> tuple[str, list[tuple[str, int, int]]]:
    """Writes the train rows as files of near rows: (folder, (name, least cell, greatest cell) of each file)."""
    spark = train.sparkSession
    root = scratch_path(spark, "knn-files")
    n_files = math.ceil(n_train / knn.FILE_ROWS)
    train.select(*FILE_COLUMNS, "length", "q").repartitionByRange(n_files, *order).sortWithinPartitions(*order).write.parquet(root)
    written = spark.read.parquet(root)
    name = F.substring_index(file_path(F.col("_metadata.file_path")), "/", -1).alias("name")
    return root, sorted(tuple(r) for r in written.groupBy(name).agg(F.min("cell"), F.max("cell")).collect())


def nested_votes(rows: DataFrame, sizes: Sequence[int], k: int, weight: str | None = None) -> DataFrame:
    """(doc_id, subset, votes_true, votes_false, predicted): the train rows vote for all rows, over each of the vocabularies.

    ``rows`` is (doc_id, flag, train, idx, val); ``sizes``, which do not fall, say how many columns the vocabularies have.
    ``weight`` names a column: a train row then is that many neighbours. All ties of the k-th distance vote.
    """
    spark = rows.sparkSession
    ship_package()
    keys = F.array(*(_prefix_key(n) for n in sizes)).alias("keys")
    keyed = materialize(rows.select("doc_id", keys), "knn-query")
    merged = materialize(
        rows.withColumn("keys", keys)
        .groupBy(F.element_at("keys", -1).alias("q"))
        .agg(
            F.first("idx").alias("idx"),
            F.first("val").alias("val"),
            F.first("keys").alias("keys"),
            F.max("train").alias("has"),
            tally(F.col("train") & F.col("flag"), weight).alias("n_true"),
            tally(F.col("train") & ~F.col("flag"), weight).alias("n_false"),
        ),
        "knn-merged",
    )
    # a train row, if there is one, stands for the rows that are equal over a vocabulary, and so over each larger one
    each = merged.select("q", "has", "n_true", "n_false", F.posexplode("keys").alias("subset", "key"))
    sums = [F.sum(c).alias(c) for c in ("n_true", "n_false")]
    groups = each.groupBy("subset", "key").agg(F.min(F.struct((~F.col("has")).alias("none"), "q")).alias("least"), *sums)
    groups = materialize(groups.select("subset", "key", F.col("least.q").alias("q"), (~F.col("least.none")).alias("has"), "n_true", "n_false"), "knn-groups")
    tallies = F.sort_array(F.collect_list(F.struct("subset", "n_true", "n_false")))
    stands = groups.groupBy("q").agg(F.min("subset").alias("first"), tallies.alias("tallies"))
    stands = stands.select("q", "first", F.col("tallies.n_true").alias("n_true"), F.col("tallies.n_false").alias("n_false"))

    n_train = merged.filter("has").count()
    width = 1 + (merged.agg(F.max(F.array_max("idx"))).first()[0] or 0)
    pivots = [(np.zeros(0, np.int64), np.zeros(0))]
    if n_train:
        n_pivots = min(knn.MAX_PIVOTS, math.ceil(2 * math.sqrt(n_train / BLOCK_ROWS)))
        most = max(n_pivots, min(knn.SAMPLE * n_pivots, knn.DENSE_CELLS // width))
        sample = merged.filter("has").orderBy("q").limit(most).select("idx", "val").collect()
        pivots = knn._centres([(np.array(r["idx"], dtype=np.int64), np.array(r["val"], dtype=float)) for r in sample], n_pivots)
    placed = materialize(_place(merged.select("q", "idx", "val", "has").join(stands, "q"), pivots, sizes), "knn-cells")

    order = [F.col("cell"), F.col("length"), F.col("q")]
    found = []
    open_ = placed.filter(~F.col("has")) if k == 1 else placed
    if n_train:
        root, files = _train_files(placed.filter("has"), n_train, order)
        n_queries = open_.count()
        n_slices = max(math.ceil(n_queries / knn.SLICE_ROWS), min(4 * spark.sparkContext.defaultParallelism, math.ceil(n_queries / 1024)), 1)
        spread = open_.select("q", "idx", "val", "first", "cell", "length").repartitionByRange(n_slices, *order).sortWithinPartitions(*order)
        levels = spread.mapInArrow(_search(root, files, sizes, k, knn.SLICE_ROWS), knn.LEVELS)
        found.append(levels.filter(F.col("nearer") < k).select("subset", "q", "n_true", "n_false"))
    if k == 1:
        found.append(groups.filter("has").select("subset", "q", "n_true", "n_false"))
        others = groups.filter("has").select("subset", F.col("q").alias("other"), "n_true", "n_false")
        found.append(_same_rows(placed, sizes).join(others, ["subset", "other"]).select("subset", "q", "n_true", "n_false"))
    if not found:
        found.append(groups.filter(F.lit(False)).select("subset", "q", "n_true", "n_false"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    votes = every.groupBy("subset", "q").agg(F.sum("n_true").alias("votes_true"), F.sum("n_false").alias("votes_false"))
    by_key = groups.select("subset", "key", "q").join(votes, ["subset", "q"]).drop("q")
    return keyed.select("doc_id", F.posexplode("keys").alias("subset", "key")).join(by_key, ["subset", "key"]).select(
        "doc_id", "subset", "votes_true", "votes_false", (F.col("votes_true") > F.col("votes_false")).alias("predicted")
    )
