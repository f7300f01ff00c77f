"""Shape of a trip around each of its points: all points of the trip within a radius, in time order.

A trip's points are summed up in a tree over time: a node is a stretch of points with its box, its length along the track and
the moments of its places.  Around a point, a node wholly within the radius enters by these sums, one wholly outside not
at all, and only nodes across the border are opened.  A vessel at anchor, or one that passes by, is told by a few nodes; the
path joins the ends of neighbouring nodes.  Where tracks cross the border so often that most nodes would be opened, a block
of points meets all of the trip's at once, as matrices.  Where there are very many, points are dealt out by place into ever
smaller cells: what is within the radius of all of a cell's points is summed up for all of them, in runs over time, what is
out of reach of all is left out, and the points of a small cell meet only those near the border, whose number grows with the
root of those within.  All ways give the same sums; memory is bounded by BLOCK and MATRIX.

Squared great-circle distances to the centre are worked out from moments: with h a quarter of the squared chord, the square
of the angle is 4 (h + h²/3 + 8h³/45 + ...), of which the first two terms are kept (the third is under 1e-10 of the sum for
radii under EXACT_KM; beyond, every point is taken by itself).
"""

from __future__ import annotations

from functools import reduce

import numpy as np

from ..functions.geo import DEGREE_KM, EARTH_KM

#: Children of a node; pairs of points and nodes, and cells of a matrix, at a time; a trip that small needs no tree.
FAN, BLOCK, MATRIX, SMALL, EXACT_KM = 8, 1 << 20, 1 << 18, 128, 50.0
#: Places of a trip that cells are worth their while for; points of a cell that isn't divided further; neighbouring places whose choices are all worked out.
MANY, CELL, GROUP = 2048, 96, 4
#: Moments of a set of offsets b: weight, b, |b|², products of two parts, |b|² b, |b|⁴.
_PAIRS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))
_W, _B, _S, _P, _T, _Q = 0, slice(1, 4), 4, slice(5, 11), slice(11, 14), 14


def great_circle(p1, l1, p2, l2):
    """Distance in km between places in radians, by the formula of functions.geo."""
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((l2 - l1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Great-circle km between places on the unit sphere, near ones (EXACT_KM)."""
    d = u - v
    h2 = np.einsum("ij,ij->i", d, d) / 4
    return 2 * EARTH_KM * np.sqrt(h2) * (1 + h2 * (1 / 6 + h2 * (3 / 40)))


def _ends(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at.min(axis=0), at.max(axis=0)


def _quarters(at: np.ndarray) -> list[np.ndarray]:
    """Numbers of the places, halved twice at the median of the longest side."""
    parts = [np.arange(len(at))]
    for _ in range(2):
        halves = []
        for k in parts:
            lo, hi = _ends(at[k])
            order = np.argpartition(at[k, np.argmax(hi - lo)], len(k) // 2)
            halves += [k[order[: len(k) // 2]], k[order[len(k) // 2 :]]]
        parts = halves
    return parts


def _on_sphere(p, l):  # noqa: E741
    return np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], axis=-1)


def _moments(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    size = (b * b).sum(axis=1)
    parts = [np.ones(len(b)), *b.T, size, *(b[:, i] * b[:, j] for i, j in _PAIRS), *(size[:, None] * b).T, size * size]
    return np.stack(parts, axis=1) * w[:, None]


def _shifted(m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of |b + e|² and |b + e|⁴ from the moments of b."""
    ee = (e * e).sum(axis=1)
    be = (m[:, _B] * e).sum(axis=1)
    square = m[:, _S] + 2 * be + m[:, _W] * ee
    cross = np.stack([e[:, i] * e[:, j] * (1 if i == j else 2) for i, j in _PAIRS], axis=1)
    fourth = m[:, _Q] + 4 * (m[:, _P] * cross).sum(axis=1) + m[:, _W] * ee * ee + 4 * (m[:, _T] * e).sum(axis=1) + 2 * m[:, _S] * ee + 4 * be * ee
    return square, fourth


class Track:
    """Different places of a trip in time order, in degrees, with the number of rows at each."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, weight: np.ndarray, radius_km: float, planar: bool, mean_lat: float):
        self.n, self.radius, self.planar = len(lat), radius_km, planar
        self.lat, self.lon, self.weight = lat, lon, weight.astype(float)
        self.p, self.l = np.radians(lat), np.radians(lon)
        self.u = _on_sphere(self.p, self.l)
        self.at = np.stack([lon * DEGREE_KM * np.cos(np.radians(mean_lat)), lat * DEGREE_KM], axis=1) if planar else self.u
        self.leg = great_circle(self.p[:-1], self.l[:-1], self.p[1:], self.l[1:])
        self.exact = radius_km > EXACT_KM
        self.chord2 = 4 * np.sin(min(radius_km / EARTH_KM / 2, np.pi / 2)) ** 2

    def near(self, i, j) -> np.ndarray:
        """Whether places i and j are within the radius, as the distance itself says."""
        if self.planar:
            return np.sqrt((self.at[i, 0] - self.at[j, 0]) ** 2 + (self.at[i, 1] - self.at[j, 1]) ** 2) <= self.radius
        return great_circle(self.p[i], self.l[i], self.p[j], self.l[j]) <= self.radius

    def build(self) -> None:
        """Nodes of all levels, single places first: where each begins and ends, its children's level, box, mean, moments and path."""
        sizes = [1]
        while sizes[-1] * FAN < 2 * self.n and not self.exact and self.n > SMALL:
            sizes.append(sizes[-1] * FAN)
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("first", "last", "level", "lo", "hi", "mean", "moments", "path", "place")}
        self.base = [0]
        for level, size in enumerate(sizes):
            first = np.arange(0, self.n, size)
            last = np.minimum(first + size, self.n) - 1
            w = np.add.reduceat(self.weight, first)
            mean = np.add.reduceat(self.u * self.weight[:, None], first) / w[:, None]
            node = np.arange(self.n) // size
            inner = np.where(np.arange(1, self.n) % size == 0, 0.0, self.leg)
            made = {
                "first": first, "last": last, "level": np.full(len(first), level), "mean": mean, "path": np.add.reduceat(np.append(inner, 0.0), first),
                "lo": np.minimum.reduceat(self.at, first), "hi": np.maximum.reduceat(self.at, first),
                "moments": np.add.reduceat(_moments(self.u - mean[node], self.weight), first),
                "place": np.add.reduceat(np.stack([self.lat, self.lon], axis=1) * self.weight[:, None], first),
            }
            for k, v in made.items():
                parts[k].append(v)
            self.base.append(self.base[-1] + len(first))
        self.node = {k: np.concatenate(v) for k, v in parts.items()}
        self.levels = len(sizes)

    def _sides(self, i: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point and node: wholly within, wholly outside.  Single places are always either."""
        at, lo, hi = self.at[i], self.node["lo"][node], self.node["hi"][node]
        least, most = np.maximum(np.maximum(lo - at, at - hi), 0.0), np.maximum(np.abs(at - lo), np.abs(at - hi))
        least2, most2 = (least**2).sum(axis=1), (most**2).sum(axis=1)
        if self.planar:
            return np.sqrt(most2) <= self.radius, np.sqrt(least2) > self.radius
        within, outside = most2 <= self.chord2 * (1 - 1e-9), least2 > self.chord2 * (1 + 1e-9)
        single = np.flatnonzero((node < self.base[1]) & ~within & ~outside)
        within[single] = self.near(i[single], node[single])
        outside[single] = ~within[single]
        return within, outside

    def _elements(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and nodes, in time order, that make up the rows' surroundings; None if too many nodes lie across the border."""
        top = np.arange(self.base[-2], self.base[-1])
        i, node = np.repeat(rows, len(top)), np.tile(top, len(rows))
        found = []
        for level in range(self.levels - 1, -1, -1):
            within, outside = self._sides(i, node)
            found.append((i[within], node[within]))
            open_ = ~within & ~outside
            i, node = i[open_], node[open_]
            if not len(i) or not level:
                break
            if len(i) * FAN > BLOCK or len(i) * FAN > max(64 * len(rows), self.n * len(rows) // 4):
                return None
            child = (node - self.base[level])[:, None] * FAN + np.arange(FAN)
            i, child = np.repeat(i, FAN), child.ravel()
            there = child < self.base[level] - self.base[level - 1]
            i, node = i[there], child[there] + self.base[level - 1]
        i, node = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(i * self.n + self.node["first"][node], kind="stable")
        return i[order], node[order]

    def _summed(self, i: np.ndarray, node: np.ndarray):
        """For each different row of i: weight, path, sum of squared distances to the centre, first and last place."""
        cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        at = {k: v[node] for k, v in self.node.items() if k in ("first", "last", "moments", "path", "place", "mean")}
        n = np.add.reduceat(at["moments"][:, _W], cut)
        center = np.radians(np.add.reduceat(at["place"], cut) / n[:, None])
        row = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(i))))
        e = at["mean"] - _on_sphere(center[:, 0], center[:, 1])[row]
        step = np.append(great_circle(self.p[at["last"][:-1]], self.l[at["last"][:-1]], self.p[at["first"][1:]], self.l[at["first"][1:]]), 0.0)
        step[np.append(cut[1:], len(i)) - 1] = 0.0
        path = np.add.reduceat(at["path"] + step, cut)
        if self.exact:
            far = 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt((e * e).sum(axis=1)) / 2, 1.0))
            spread = np.add.reduceat(far * far * at["moments"][:, _W], cut)
        else:
            square, fourth = _shifted(at["moments"], e)
            spread = 4 * EARTH_KM**2 * np.add.reduceat(square / 4 + fourth / 48, cut)
        return n, path, spread, at["first"][cut], at["last"][np.append(cut[1:], len(i)) - 1]

    def _by_matrix(self, rows: np.ndarray, put) -> None:
        """The same for all pairs of rows and places; put(rows, results) gets them."""
        d = (self.at[rows, 0][:, None] - self.at[:, 0]) ** 2
        for k in range(1, self.at.shape[1]):
            d += (self.at[rows, k][:, None] - self.at[:, k]) ** 2
        if self.planar:
            near = np.sqrt(d, out=d) <= self.radius
        else:
            near = d <= self.chord2 * (1 - 1e-9)
            r, close = np.nonzero(~near & (d <= self.chord2 * (1 + 1e-9)))
            near[r, close] = self.near(rows[r], close)
        if self.exact or self.n <= SMALL or 8 * np.count_nonzero(near) < near.size:
            i, j = np.nonzero(near)
            return put(rows, self._summed(i, j))
        close = near[:, rows[0]]
        if not close.all():  # offsets from a far place would lose digits
            self._by_matrix(rows[close], put)
            return self._by_matrix(rows[~close], put)
        edge = np.zeros((len(rows), self.n + 1), np.int8)
        edge[:, :-1] = near
        edge[:, 1:] -= near
        flat = edge.ravel()
        begin, end = np.flatnonzero(flat == 1), np.flatnonzero(flat == -1)
        middle = self.u[rows[0]]
        sums = near.astype(float) @ np.column_stack([_moments(self.u - middle, self.weight), self.lat * self.weight, self.lon * self.weight])
        n = sums[:, _W]
        center = np.radians(sums[:, -2:] / n[:, None])
        square, fourth = _shifted(sums[:, :-2], middle - _on_sphere(center[:, 0], center[:, 1]))
        row, begin, end = begin // (self.n + 1), begin % (self.n + 1), end % (self.n + 1) - 1
        run = np.append(0.0, np.cumsum(self.leg))
        step = np.append(great_circle(self.p[end[:-1]], self.l[end[:-1]], self.p[begin[1:]], self.l[begin[1:]]), 0.0)
        cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        last = np.append(cut[1:], len(row)) - 1
        step[last] = 0.0
        path = np.add.reduceat(run[end] - run[begin] + step, cut)
        return put(rows, (n, path, 4 * EARTH_KM**2 * (square / 4 + fourth / 48), begin[cut], end[last]))

    def _by_points(self, rows: np.ndarray, put) -> None:
        """The same for one row at a time, with the places within the radius taken by themselves."""
        arc = (lambda h: np.arcsin(np.minimum(h, 1.0))) if self.exact else (lambda h: h * (1 + h * h * (1 / 6 + h * h * (3 / 40))))
        at, u = [np.ascontiguousarray(v) for v in self.at.T], [np.ascontiguousarray(v) for v in self.u.T]
        for i in rows:
            d = (at[0] - at[0][i]) ** 2
            for v in at[1:]:
                d += (v - v[i]) ** 2
            if self.planar:
                j = np.flatnonzero(np.sqrt(d, out=d) <= self.radius)
            else:
                near = d <= self.chord2 * (1 - 1e-9)
                close = np.flatnonzero(~near & (d <= self.chord2 * (1 + 1e-9)))
                near[close] = self.near(i, close)
                j = np.flatnonzero(near)
            w, places = self.weight[j], [v[j] for v in u]
            n = w.sum()
            center = _on_sphere(np.radians((self.lat[j] @ w) / n), np.radians((self.lon[j] @ w) / n))
            legs, off = np.zeros(len(j) - 1), np.zeros(len(j))
            for v, c in zip(places, center, strict=True):
                legs += (v[1:] - v[:-1]) ** 2
                off += (v - c) ** 2
            path, far = 2 * EARTH_KM * arc(np.sqrt(legs) / 2).sum(), 2 * EARTH_KM * arc(np.sqrt(off) / 2)
            put(i, (n, path, (far * far) @ w, j[0], j[-1]))

    def _apart(self, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places p lie within the radius of the whole box, and which of none of it; those in doubt are neither."""
        least2, most2 = np.zeros(len(p)), np.zeros(len(p))
        for x, a, b in zip(p.T, lo, hi, strict=True):
            most2 += np.maximum(x - a, b - x) ** 2
            least2 += np.maximum(np.maximum(a - x, x - b), 0.0) ** 2
        reach2 = self.radius**2 if self.planar else self.chord2
        return most2 <= reach2 * (1 - 1e-9), least2 > reach2 * (1 + 1e-9)

    def _by_cells(self, rows: np.ndarray, put) -> None:
        """The same for rows dealt out by place: cells no wider than the radius get the places in their reach."""
        stack = [(rows, np.arange(self.n))]
        while stack:
            rows, there = stack.pop()
            lo, hi = _ends(self.at[rows])
            there = there[~self._apart(self.at[there], lo, hi)[1]]
            if np.sqrt(((hi - lo) ** 2).sum()) <= (self.radius if self.planar else np.sqrt(self.chord2)):
                self._cell(rows, there, put)
            else:
                stack += [(rows[k], there) for k in _quarters(self.at[rows]) if len(k)]

    def _cell(self, rows: np.ndarray, there: np.ndarray, put) -> None:
        """One cell: a line holds, in time order, runs of places within the radius of all its rows (`whole`: first, last, path) and
        single places that are within the radius of some.  Smaller cells have shorter lines."""
        at, u, w, n = self.at[there], self.u[there], self.weight[there], len(there)
        middle = self.u[rows[0]]
        sums = np.column_stack([_moments(u - middle, w), self.lat[there] * w, self.lon[there] * w])
        stack = [(rows, np.arange(n), np.arange(n), np.zeros(n, bool), np.zeros(n), np.zeros(sums.shape[1]))]
        while stack:
            rows, first, last, whole, path, base = stack.pop()
            edge = np.flatnonzero(~whole)
            place = first[edge]
            within, outside = self._apart(at.take(place, axis=0), *_ends(self.at[rows]))
            new = sums.take(place[within], axis=0)
            base = base + np.ones(len(new)) @ new
            whole, keep = whole.copy(), np.ones(len(whole), bool)
            whole[edge[within]], keep[edge[outside]] = True, False
            keep = np.flatnonzero(keep)
            first, last, whole, path = first[keep], last[keep], whole[keep], path[keep]
            joined = whole[1:] & whole[:-1]
            k = np.flatnonzero(joined)
            path[k + 1] += _far(u.take(last[k], axis=0), u.take(first[k + 1], axis=0))
            begin = np.flatnonzero(np.append(True, ~joined))
            path, first, whole, last = np.add.reduceat(path, begin), first[begin], whole[begin], last[np.append(begin[1:], len(whole)) - 1]
            few = np.count_nonzero(~whole)
            if len(rows) <= CELL or len(rows) * few <= MATRIX // 8:
                self._meet(rows, there, (at, u, sums, middle), (first, last, whole, path, base), put)
            else:
                stack += [(rows[k], first, last, whole, path, base) for k in _quarters(self.at[rows])]

    def _meet(self, rows: np.ndarray, there: np.ndarray, places, line, put) -> None:
        """The rows of a small cell and the single places of its line, as matrices.

        What a few single places between two runs add to the path hangs on which of them are within the radius, and on nothing else:
        it is worked out once for every choice of up to GROUP places.  Longer groups are followed from place to place."""
        (at, u, sums, middle), (first, last, whole, path, base) = places, line
        edge, runs = np.flatnonzero(~whole), np.flatnonzero(whole)
        place = first[edge]
        begin = np.flatnonzero(np.append(True, edge[1:] > edge[:-1] + 1)) if len(edge) else edge  # groups of neighbours
        size = np.diff(np.append(begin, len(edge)))
        before, after = edge[begin] - 1, edge[begin] + size  # the runs beside them
        between = (before >= 0) & (after < len(whole))
        detour, choices = np.zeros(len(edge)), []
        known = path[runs].sum()
        for g in range(1, GROUP + 1):
            k = np.flatnonzero(between & (size == g))
            if not len(k):
                continue
            stops = [u.take(i, axis=0) for i in (last[before[k]], *(place[begin[k] + i] for i in range(g)), first[after[k]])]
            far = {(i, j): _far(stops[i], stops[j]) for j in range(g + 2) for i in range(j)}
            along = []
            for choice in range(1 << g):
                way = [0, *(i + 1 for i in range(g) if choice >> i & 1), g + 1]
                along.append(reduce(np.add, [far[x] for x in zip(way[:-1], way[1:], strict=True)]))
            known += along[0].sum()
            if g == 1:
                detour[begin[k]] = along[1] - along[0]
            else:
                choices.append((begin[k], g, np.stack(along) - along[0]))
        long = ~between | (size > GROUP)
        low, high = np.maximum(before, 0)[long], np.minimum(after, len(whole) - 1)[long]
        length = high - low + 1  # with the runs beside them
        opens = np.cumsum(length) - length
        item = np.arange(length.sum()) + np.repeat(low - opens, length)
        closes = np.zeros(len(item), bool)
        closes[opens + length - 1] = True
        to = first[item]
        to[opens] = last[low]
        to, always, nth = u.take(to, axis=0), whole[item], np.maximum(np.cumsum(~whole) - 1, 0)[item]
        early, late = (runs[0], len(edge) - (len(whole) - 1 - runs[-1])) if len(runs) else (len(edge), 0)
        coefficients = np.vstack([sums.take(place, axis=0).T, detour])
        p = at.take(place, axis=0).T
        block = max(1, MATRIX // max(1, len(edge)))
        for a in range(0, len(rows), block):
            r = rows[a : a + block]
            d = np.zeros((len(edge), len(r)))
            for k, v in enumerate(p):
                d += (v[:, None] - self.at[r, k]) ** 2
            if self.planar:
                near = np.sqrt(d, out=d) <= self.radius
            else:
                near = d <= self.chord2 * (1 - 1e-9)
                close, i = np.nonzero(~near & (d <= self.chord2 * (1 + 1e-9)))
                near[close, i] = self.near(r[i], there[place[close]])
            told = coefficients @ near.astype(float)
            path_km = told[-1] + known
            for k, g, along in choices:
                code = reduce(np.add, [near[k + i].astype(np.intp) << i for i in range(g)])
                code *= len(k)
                code += np.arange(len(k))[:, None]
                path_km += along.ravel().take(code).sum(axis=0)
            if len(item):
                i, j = np.nonzero((near[nth] | always[:, None]).T if len(edge) else np.broadcast_to(always, (len(r), len(item))))
                step = _far(to.take(j[1:], axis=0), to.take(j[:-1], axis=0))
                step[closes[j[:-1]] | (i[1:] != i[:-1])] = 0.0
                path_km += np.bincount(i[:-1], step, len(r))
            told = told[:-1].T + base
            n = told[:, _W]
            center = np.radians(told[:, -2:] / n[:, None])
            square, fourth = _shifted(told[:, :-2], middle - _on_sphere(center[:, 0], center[:, 1]))
            ends = [np.full(len(r), x) for x in ((first[runs[0]], last[runs[-1]]) if len(runs) else (0, 0))]
            if early:
                hit = near[:early]
                ends[0] = np.where(hit.any(axis=0), place[hit.argmax(axis=0)], ends[0])
            if late < len(edge):
                hit = near[late:][::-1]
                ends[1] = np.where(hit.any(axis=0), place[len(edge) - 1 - hit.argmax(axis=0)], ends[1])
            put(r, (n, path_km, 4 * EARTH_KM**2 * (square / 4 + fourth / 48), there[ends[0]], there[ends[1]]))

    def _by_tree(self, only: np.ndarray, put, many_places: bool) -> None:
        """The same by the tree, and by another way where it doesn't help."""
        self.build()
        done, many, block, skip, miss, left = 0, 256, max(1, MATRIX // self.n), self.n <= SMALL, 0, []
        way, again = (self._by_matrix, 32) if block > 16 else (self._by_points, 512 // block)
        if many_places:
            way, again, block = (lambda rows, _: left.append(rows)), 32, 256
        while done < len(only):
            rows = only[done : done + (block if skip else many)]
            told = None if skip else self._elements(rows)
            if told is not None:
                put(rows, self._summed(*told))
                many, miss = min(1024, 2 * many), 0
            elif not skip and len(rows) > 16:
                many = max(16, len(rows) // 4)
                continue
            else:
                rows = rows[:block]
                way(rows, put)
                miss += 1
                skip = self.n <= SMALL or miss % again > 0  # now and then the tree is tried again
            done += len(rows)
        if left:
            self._by_cells(np.concatenate(left), put)

    def shapes(self, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_near, straightness, radius_gyration_km and sinuosity of each place, or only of some, whose numbers rise."""
        out = [np.empty(self.n) for _ in range(3)] + [np.empty(self.n, np.int64) for _ in range(2)]
        many_places = self.n > MANY and not self.exact

        def put(rows, told) -> None:
            for x, y in zip(out, told, strict=True):
                x[rows] = y

        if only is not None and many_places:  # rows of one place: cells at once
            self._by_cells(only, put)
        else:
            only = np.arange(self.n) if only is None else only
            self._by_tree(only, put, many_places)
        n, path, spread, first, last = (x[only] for x in out)
        chord = great_circle(self.p[first], self.l[first], self.p[last], self.l[last])
        one = n < 2
        straight = np.where(one | (path == 0), 1.0, chord / np.where(path > 0, path, 1.0))
        radius = np.where(one, 0.0, np.sqrt(np.maximum(spread, 0.0) / n))
        winding = np.where(one | (chord <= 0.001), 1.0, np.clip(path / np.where(chord > 0.001, chord, 1.0), 1, 10))
        return np.rint(n).astype(np.int64), straight, radius, winding
