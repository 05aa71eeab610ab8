"""Stops matched to the shapes of their trips, by place and by the feed's own distances.

Trips of a shape with one list of (stop, distance) are one pattern, reported with its first trip.
Patterns are dealt into parts of a shape, each with a copy of the shape and with its stops. Every
distance depends on the shape and the stop alone, so a NumPy helper finds the candidate places once
for each stop of a part. Only patterns whose stops all have candidates are searched for the cheapest
assignment with ascending places along the shape. No candidate leaves the worker but in a problem.

A second pass places stops by `shape_dist_traveled`, for patterns whose last stop and whose shape
have it. A stop that has none is placed by candidates there too.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import Feed, first_rows
from ..functions.geo import RADIUS
from ..notices import notices
from ..shared import forget, shuffles_dropped, written
from .distances import stop_coordinates

FEED = "feed_id"
#: Metres from a shape within which a stop is on it; so many times for the ends of rail trips; candidates that are too many.
NEAR_M, RAIL_ENDS, TOO_MANY = 100.0, 4.0, 20
RAIL = 2
TOO_FAR, TOO_FAR_USER = "stop_too_far_from_shape", "stop_too_far_from_shape_using_user_distance"
TOO_MANY_MATCHES, OUT_OF_ORDER = "stop_has_too_many_matches_for_shape", "stops_match_shape_out_of_order"
#: Stops of a shape in a part of the work, at least; stops compared with a shape at once.
PART, BLOCK = 2_048, 1_024
#: Stops of patterns in a part for each point of the shape, at least; in a task, about; shapes whose ids are broadcast, at most.
STEPS_A_POINT, TASK_STEPS, FEW_SHAPES = 2, 500_000, 100_000
#: Children of a node of a shape's tree; radians by which bounds are wider, and so beyond the error of arccos near 0.
WIDE, SLACK, SLACK_NEAR = 8, 1e-9, 1e-7
#: Nodes whose children are looked at in one go, and arcs found for a block of stops beyond which it is halved.
GO, FOUND_MOST = 16_384, 1 << 19
#: User distances this close count as equal.
SAME = 1e-9 * 32


def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def degrees(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1]))), np.degrees(np.arctan2(v[..., 1], v[..., 0]))


def angle_m(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(u, v), axis=-1), (u * v).sum(axis=-1)) * RADIUS


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def apart(dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the angles from a point to an arc, from below, and to its nearer end, from above.

    dots: the point's products with the arc's normal, inner sides and ends.
    """
    cosine = np.maximum(dots[..., 3], dots[..., 4])
    sine = np.abs(dots[..., 0])
    over = (dots[..., 1] > 0) & (dots[..., 2] > 0)
    ends = np.arccos(np.clip(cosine, -1, 1))
    steep = np.maximum(np.abs(cosine), np.where(over, sine, 0))
    slack = np.where(steep > 1 - 1e-8, SLACK_NEAR, SLACK)
    return np.where(over, np.arcsin(np.minimum(sine, 1)), ends) - slack, ends + slack


class Shape:
    """A shape's points as unit vectors, metres along it, user distances as a running maximum, and its arcs."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, user: np.ndarray):
        self.points = vectors(lat, lon)
        a, b = np.radians(lat), np.radians(lon)
        h = np.sin(np.diff(a) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin(np.diff(b) / 2) ** 2
        self.along = np.concatenate(([0.0], np.cumsum(2 * RADIUS * np.arcsin(np.sqrt(np.minimum(1, h))))))
        self.user = np.maximum.accumulate(np.maximum(np.nan_to_num(user, nan=0.0), 0.0)).tolist()
        self.left, self.right = self.points[:-1], self.points[1:]
        self.normal = unit(np.cross(self.left, self.right))
        # an arc's ends as planes: a place lies over the arc where it is on the inner side of both
        self.from_left, self.to_right = np.cross(self.normal, self.left), np.cross(self.right, self.normal)
        self.levels = self.tree() if len(self.left) else []

    def tree(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Nodes over WIDE arcs, over WIDE such nodes and so on, from the root's children down to the arcs, WIDE nodes in a row.

        A node is the arc from its first point to its last one (normal, inner sides and ends), and
        how far from that its own arcs may be: as far as its points, and a little more, as an arc
        between two points near another bulges by the cosine of half its length.
        """
        n = len(self.left)
        half = np.arctan2(np.linalg.norm(self.left - self.right, axis=-1), np.linalg.norm(self.left + self.right, axis=-1))
        levels, size = [], 1
        while True:
            starts = np.arange(0, n, size)
            first, last = self.points[starts], self.points[np.minimum(starts + size, n)]
            normal = unit(np.cross(first, last))
            nodes = np.stack([normal, np.cross(normal, first), np.cross(last, normal), first, last], axis=1)
            reach = np.zeros(len(starts))
            if size > 1:
                off = apart(np.einsum("ijk,ik->ij", nodes[np.arange(n) // size], self.left))[0] + 2 * SLACK_NEAR
                sine = np.maximum.reduceat(off, starts) / np.maximum(np.cos(np.maximum.reduceat(half, starts)), 1e-300)
                # almost opposite ends tell no arc
                reach = np.where((sine < 1) & ((first * last).sum(axis=-1) > -0.99), np.arcsin(np.minimum(sine, 1)), np.pi)
            # a normal is as exact as its arc is long
            reach += np.minimum(SLACK_NEAR, 2e-15 / np.maximum(np.linalg.norm(first - last, axis=-1), 1e-300))
            empty = -len(starts) % WIDE
            nodes = np.concatenate([nodes, np.zeros((empty, 5, 3))]).reshape(-1, WIDE * 5, 3)
            levels.append((nodes, np.concatenate([reach, np.full(empty, -np.inf)]).reshape(-1, WIDE)))
            if len(nodes) == 1:
                return levels[::-1]
            size *= WIDE

    def nearest(self, p: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest place on arc i for each p, and the metres between; arrays of one length."""
        n = self.normal[i]
        over = ((p * self.from_left[i]).sum(axis=-1) > 0) & ((p * self.to_right[i]).sum(axis=-1) > 0)
        foot = unit(p - (p * n).sum(axis=-1, keepdims=True) * n)
        a, b = self.left[i], self.right[i]
        end = np.where(((p * a).sum(axis=-1) >= (p * b).sum(axis=-1))[..., None], a, b)
        place = np.where(over[..., None], foot, end)
        return place, angle_m(p, place)

    def arcs_of(self, p: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, arc), ascending, of arcs that may be within `most` radians of their p; without it, that may be the nearest of all to it.

        From the root down only nodes are followed that may be so near; the nearest end of a node
        seen bounds the nearest place. None where there are over FOUND_MOST for more than one p.
        """
        rows, at = np.arange(len(p)), np.zeros(len(p), int)
        best = np.full(len(p), np.inf) if most is None else most
        for nodes, reach in self.levels:
            lows = []
            for go in range(0, len(rows), GO):
                own, parent = rows[go : go + GO], at[go : go + GO]
                over, ends = apart(np.einsum("ijk,ik->ij", nodes[parent], p[own]).reshape(-1, WIDE, 5))
                # nodes that aren't there are beyond all
                lows.append(np.where(reach[parent] >= 0, over - reach[parent], np.inf))
                if most is None:
                    np.minimum.at(best, own, np.where(reach[parent] >= 0, ends, np.inf).min(axis=1))
            low = np.concatenate(lows) if lows else np.zeros((0, WIDE))
            k, child = np.nonzero(low <= best[rows][:, None])
            if len(k) > FOUND_MOST and len(p) > 1:
                return None
            rows, at = rows[k], at[k] * WIDE + child
        return rows, at

    def metres_at(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.along[i] + angle_m(place, self.points[i])


@dataclass
class Found:
    """Candidates of stops, one after the other, n for each: metres along the shape, metres from it, and where; nearest: (metres, lat, lon) of stops without any, else NaN."""

    n: np.ndarray
    along: np.ndarray
    metres: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    nearest: np.ndarray

    def __iter__(self) -> Iterator[Found]:
        """Each stop's own."""
        ends = np.cumsum(self.n)
        for k, (a, b) in enumerate(zip(ends - self.n, ends, strict=True)):
            yield Found(self.n[k], self.along[a:b], self.metres[a:b], self.lat[a:b], self.lon[a:b], self.nearest[k])


def minima(index: list[int], metres: list[float], ends: list[float]) -> list[int]:
    """Which of the close arcs (ascending, with metres to them and to their far ends) are candidates, as positions.

    A run of neighbouring arcs is one candidate, its nearest arc, but for where the shape comes
    back: after an arc whose far end is farther than the arc itself, one nearer than that end
    starts another.
    """
    out: list[int] = []
    best = -1
    for k, i in enumerate(index):
        fresh = best < 0 or i != index[k - 1] + 1 or ends[k - 1] > metres[k - 1] and metres[k] < ends[k - 1]
        if fresh and best >= 0:
            out.append(best)
        if fresh or metres[k] < metres[best]:
            best = k
    return [*out, best] if best >= 0 else out


def find(shape: Shape, p: np.ndarray, limits: np.ndarray) -> Found:
    """The candidates of each stop p within its limit of metres."""
    if len(shape.points) == 1:
        place = np.broadcast_to(np.stack(degrees(shape.points[0])), (len(p), 2))
        return Found(np.zeros(len(p), int), *[np.zeros(0)] * 4, np.column_stack([angle_m(p, shape.points[0]), place]))
    parts = [found for at in range(0, len(p), BLOCK) for found in find_block(shape, p[at : at + BLOCK], limits[at : at + BLOCK])]
    return Found(*(np.concatenate([getattr(f, c) for f in parts]) for c in Found.__dataclass_fields__))


def find_block(shape: Shape, p: np.ndarray, limit: np.ndarray) -> list[Found]:
    """find for some stops; a list, as they are halved where too much would be held for them at once."""
    halves = lambda: find_block(shape, p[: len(p) // 2], limit[: len(p) // 2]) + find_block(shape, p[len(p) // 2 :], limit[len(p) // 2 :])
    found = shape.arcs_of(p, (limit + 1) / RADIUS)
    if found is None:
        return halves()
    rows, arcs = found
    place, metres = shape.nearest(p[rows], arcs)
    close = metres <= limit[rows]
    rows, arcs, place, metres = rows[close], arcs[close], place[close], metres[close]
    ends = angle_m(p[rows], shape.right[arcs])
    bounds = np.searchsorted(rows, np.arange(len(p) + 1))
    far = np.flatnonzero(np.diff(bounds) == 0)
    # the nearest place of stops without a candidate, the first of equals
    nearest = np.full((len(p), 3), np.nan)
    if len(far):
        found = shape.arcs_of(p[far])
        if found is None:
            return halves()
        r, i = found
        there, metres_there = shape.nearest(p[far[r]], i)
        order = np.lexsort((i, metres_there, r))
        first = order[np.unique(r[order], return_index=True)[1]]
        nearest[far] = np.column_stack([metres_there[first], *degrees(there[first])])
    counts, kept = np.zeros(len(p), int), []
    lists = arcs.tolist(), metres.tolist(), ends.tolist()
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[k], bounds[k + 1]
        own = minima(*(x[a:b] for x in lists))
        counts[k] = len(own)
        kept += [a + x for x in own]
    at = np.array(kept, int)
    return [Found(counts, shape.metres_at(place[at], arcs[at]), metres[at], *degrees(place[at]), nearest)]


def assign(choices: list[list[tuple[float, float]]]) -> tuple[int, list[int]]:
    """choices: for each stop (metres along, metres from the shape). The stop that fails, and the cheapest ascending choice.

    -1 and a choice for every stop; or the first stop that can't follow, and the cheapest choice for those before it.
    """
    states: list[tuple[float, float, int, int]] = [(0.0, 0.0, -1, -1)]  # place, cost, choice and the state before
    back = [states]
    fails = -1
    for k, own in enumerate(choices):
        after = []
        for c, (place, cost) in enumerate(own):
            best, at = float("inf"), -1
            for i, state in enumerate(states):
                if state[0] <= place and state[1] < best:
                    best, at = state[1], i
            if at >= 0:
                after.append((place, best + cost, c, at))
        if not after:
            fails = k
            break
        back.append(after)
        states = after
    path, at = [], min(range(len(states)), key=lambda i: states[i][1])
    for level in reversed(back[1:]):
        path.append(level[at][2])
        at = level[at][3]
    return fails, path[::-1]


def by_user_distance(shape: Shape, distances: list[float]) -> list[tuple[int, float] | None]:
    """Where each distance above 0 lies: (point, share of the way to the next); None for stops without one. Never before the one before."""
    out: list[tuple[int, float] | None] = []
    at, n, user = 0, len(shape.points), shape.user
    for d in distances:
        if not d > 0:
            out.append(None)
            continue
        after = max(at, bisect_right(user, d))
        at = max(at, after - 1)
        if after <= 0 or at + 1 >= n or abs(user[min(after, n - 1)] - user[at]) <= SAME * max(1.0, abs(user[at]), abs(user[min(after, n - 1)])):
            out.append((at, 0.0))
        else:
            out.append((at, (d - user[at]) / (user[after] - user[at])))
    return out


def along_arcs(shape: Shape, at: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places a share t of the way from points `at` to the next ones, and the metres along the shape."""
    after = np.minimum(at + 1, len(shape.points) - 1)
    a, b = shape.points[at], shape.points[after]
    angle = angle_m(a, b) / RADIUS
    sine = np.where(angle > 1e-15, np.sin(angle), 1.0)
    place = np.where((angle > 1e-15)[:, None], unit((np.sin((1 - t) * angle) / sine)[:, None] * a + (np.sin(t * angle) / sine)[:, None] * b), a)
    return place, shape.along[at] + t * (shape.along[after] - shape.along[at])


PLACE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("along", "m", "lat", "lon")])
PLACE_ARROW = pa.struct([(c, pa.float64()) for c in PLACE.names])
FOUND = T.ArrayType(T.StructType(
    [T.StructField("stop_id", T.StringType()), T.StructField("large", T.BooleanType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("nearest", PLACE)]
))


def places_array(columns: list[np.ndarray], mask: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(PLACE.names), mask=None if mask is None else pa.array(mask))


@F.arrow_udf(FOUND)
def found_udf(lats: pa.Array, lons: pa.Array, user: pa.Array, ids: pa.Array, slats: pa.Array, slons: pa.Array, large: pa.Array) -> pa.Array:
    """The candidates of a part's stops; its lists go to and fro as flat arrays."""
    out, sizes = [], []
    for k in range(len(ids)):
        la, lo, u, sa, so, big = (c[k].values.to_numpy(zero_copy_only=False) for c in (lats, lons, user, slats, slons, large))
        f = find(Shape(la, lo, u), vectors(sa, so), np.where(big.astype(bool), NEAR_M * RAIL_ENDS, NEAR_M))
        offsets = pa.array(np.concatenate([[0], np.cumsum(f.n)]), pa.int32())
        places = pa.ListArray.from_arrays(offsets, places_array([f.along, f.metres, f.lat, f.lon]))
        none = f.n > 0
        nearest = places_array([np.zeros(len(none)), *f.nearest.T], none)
        out.append(pa.StructArray.from_arrays([ids[k].values, large[k].values, places, nearest], FOUND.elementType.names))
        sizes.append(len(none))
    kind = pa.struct([("stop_id", pa.string()), ("large", pa.bool_()), ("places", pa.list_(PLACE_ARROW)), ("nearest", PLACE_ARROW)])
    return pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes)], pa.int32()), pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind))


def second_pass(choices: list[list[dict] | None], limits, nearest) -> list[tuple]:
    """Problems (code, stop, count, place, place before) of a pattern; choices: places, one for a stop with a distance."""
    out: list[tuple] = []
    for k, own in enumerate(choices):
        if not own:
            # a stop that can't be placed ends the pass
            return out + ([(TOO_FAR_USER, k, 0, nearest[k], None)] if nearest[k]["m"] > limits[k] else [])
        if len(own) > TOO_MANY:
            out.append((TOO_MANY_MATCHES, k, len(own), min(own, key=lambda c: c["m"]), None))
    at, path = assign([[(c["along"], c["m"]) for c in own] for own in choices])
    if at >= 0:
        return [*out, (OUT_OF_ORDER, at, 0, min(choices[at], key=lambda c: c["m"]), choices[at - 1][path[-1]])]
    chosen = [own[c] for own, c in zip(choices, path, strict=True)]
    return out + [(TOO_FAR_USER, k, 0, c, None) for k, c in enumerate(chosen) if c["m"] > NEAR_M]  # rail or not


#: Problems of a part: pattern, stop in the part, pass, code, number of candidates, place (metres, lat, lon) and place of the stop before (lat, lon).
Problem = tuple[int, int, int, str, int, tuple[float, float, float], tuple[float, float] | None]


def out_of_order(along: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, each from one of starts: which lists fall somewhere, and where first, as a place in along."""
    falls = np.concatenate(([False], along[1:] < along[:-1]))
    falls[starts] = False
    at = np.flatnonzero(falls)
    lists, first = np.unique(np.searchsorted(starts, at, side="right") - 1, return_index=True)
    return lists, at[first]


def part_problems(shape: Shape, measured: bool, sizes: np.ndarray, rail: np.ndarray, d: np.ndarray, stop: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> list[Problem]:
    """Problems of some patterns of a shape; sizes: stops of each pattern; stop: a number for each place (of stops), lat and lon."""
    ends = np.cumsum(sizes)
    starts, of = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(of))
    large = rail[of] & ((k == starts[of]) | (k == ends[of] - 1))
    limit = np.where(large, NEAR_M * RAIL_ENDS, NEAR_M)
    p = vectors(lat, lon)
    _, first, own = np.unique(stop * 2 + large, return_index=True, return_inverse=True)
    found = find(shape, p[first], limit[first])
    n, nearest = found.n[own], found.nearest[own]
    upto = np.cumsum(found.n)[own]
    at = upto - n
    out: list[Problem] = []

    def closest(i: int) -> tuple[float, float, float]:
        """The place nearest to a stop, the first of equals."""
        c = at[i] + int(np.argmin(found.metres[at[i] : upto[i]]))
        return found.metres[c], found.lat[c], found.lon[c]

    # the first pass: too far, too many, and out of order where every stop has a candidate
    out += [(of[i], i, 0, TOO_FAR, 0, tuple(nearest[i]), None) for i in np.flatnonzero((n == 0) & (nearest[:, 0] > limit)).tolist()]
    out += [(of[i], i, 0, TOO_MANY_MATCHES, n[i], closest(i), None) for i in np.flatnonzero(n > TOO_MANY).tolist()]
    for x in np.flatnonzero(np.minimum.reduceat(n, starts) > 0).tolist():
        a, b = starts[x], ends[x]
        fails, path = assign([list(zip(found.along[at[i] : upto[i]].tolist(), found.metres[at[i] : upto[i]].tolist(), strict=True)) for i in range(a, b)])
        if fails >= 0:
            c = at[a + fails - 1] + path[-1]
            out.append((x, a + fails, 0, OUT_OF_ORDER, 0, closest(a + fails), (found.lat[c], found.lon[c])))
    if not measured:
        return out

    # the second pass: patterns whose last stop has a distance, on shapes that have some
    asked = d[ends - 1] > 0
    where = [w for x in np.flatnonzero(asked).tolist() for w in by_user_distance(shape, d[starts[x] : ends[x]].tolist())]
    steps = np.flatnonzero(asked[of])
    placed = np.array([w is not None for w in where], bool)
    place, far = along_arcs(shape, np.array([w[0] for w in where if w], int), np.array([w[1] for w in where if w], float))
    there = np.full((4, len(of)), np.nan)  # along the shape, metres from it, lat, lon
    there[:, steps[placed]] = far, angle_m(p[steps[placed]], place), *degrees(place)
    whole = asked & np.logical_and.reduceat(~np.isnan(there[0]), starts)
    # patterns whose stops all have a distance have one choice for each
    some = np.flatnonzero(whole[of])
    fallen, fails = out_of_order(there[0][some], np.searchsorted(some, starts[whole]))
    bad = np.flatnonzero(whole)[fallen]
    told = lambda i: (there[1, i], there[2, i], there[3, i])
    out += [(x, i, 1, OUT_OF_ORDER, 0, told(i), told(i - 1)[1:]) for x, i in zip(bad.tolist(), some[fails].tolist(), strict=True)]
    whole_and_right = whole.copy()
    whole_and_right[bad] = False
    out += [(of[i], i, 1, TOO_FAR_USER, 0, told(i), None) for i in np.flatnonzero(whole_and_right[of] & (there[1] > NEAR_M)).tolist()]  # rail or not
    names = ("along", "m", "lat", "lon")
    for x in np.flatnonzero(asked & ~whole).tolist():
        choices, near = [], []
        for i in range(starts[x], ends[x]):
            columns = there[:, [i]] if d[i] > 0 else [c[at[i] : upto[i]] for c in (found.along, found.metres, found.lat, found.lon)]
            choices.append([dict(zip(names, c, strict=True)) for c in zip(*columns, strict=True)])
            near.append(dict(zip(names, (0.0, *nearest[i]), strict=True)))
        for code, i, count, spot, before in second_pass(choices, limit[starts[x] : ends[x]], near):
            out.append((x, starts[x] + i, 1, code, count, (spot["m"], spot["lat"], spot["lon"]), before and (before["lat"], before["lon"])))
    return out


TOLD = T.StructType(
    [T.StructField(c, T.StringType()) for c in (FEED, "shape_id", "trip_id", "code", "stop1", "name1", "stop2", "name2")]
    + [T.StructField(c, T.LongType()) for c in ("trip_row", "pass", "at", "n", "row1", "row2")] + [T.StructField(c, T.DoubleType()) for c in ("m", "lat", "lon", "lat2", "lon2")]
)
TOLD_KINDS = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}


def told_of(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The problems of part k of a batch, with all that a notice says; of those that are told once for a stop, the first in the part."""
    cell = lambda name: batch.column(name)[k].values
    floats = lambda x: x.to_numpy(zero_copy_only=False).astype(float)  # noqa: E731  nulls are NaN
    trip_row, trip_id, rail, rows, stops, d = cell("items").flatten()
    sizes = pc.list_value_length(stops).to_numpy()
    stops, rows = stops.flatten(), rows.flatten()
    user = floats(cell("user"))
    none = not batch.column("spots")[k].is_valid
    ids, lats, lons, names = [pa.array([], t) for t in (stops.type, pa.float64(), pa.float64(), pa.string())] if none else cell("spots").flatten()
    # a stop that isn't among the stops, or whose place can't be found, lies at (0, 0)
    known = pc.index_in(stops, value_set=ids)
    at = lambda x: np.nan_to_num(floats(pc.take(x, known)))
    spot = pc.fill_null(known, -1).to_numpy().astype(np.int64)
    shape = Shape(floats(cell("lats")), floats(cell("lons")), user)
    found = part_problems(shape, bool((~(user <= 0)).any()), sizes, rail.to_numpy(zero_copy_only=False).astype(bool), d.flatten().to_numpy(), spot, at(lats), at(lons))
    own = stops.dictionary_encode()
    coded, firsts = own.indices.to_numpy(), trip_row.to_numpy()
    first: dict[int, tuple] = {}
    kept = []
    for x in found:
        if x[3] not in (TOO_FAR, TOO_FAR_USER):
            kept.append(x)
            continue
        key = (firsts[x[0]], x[2], x[1])
        code = coded[x[1]]
        if code not in first or key < first[code][0]:
            first[code] = (key, x)
    kept += [x for _, x in first.values()]
    pattern, step, turn, code, n, place, before = zip(*kept, strict=True) if kept else [()] * 7
    starts = np.cumsum(sizes) - sizes
    pattern, step = np.array(pattern, np.int64), np.array(step, np.int64)
    late = pa.array([s - 1 if c == OUT_OF_ORDER else None for s, c in zip(step.tolist(), code, strict=True)], pa.int64())
    name = lambda i: pc.fill_null(pc.take(names, pc.take(known, i)), "")
    columns = {
        FEED: pa.array([batch.column(FEED)[k].as_py()] * len(kept), pa.string()), "shape_id": pa.array([batch.column("shape_id")[k].as_py()] * len(kept), pa.string()),
        "trip_id": trip_id.take(pa.array(pattern)), "code": pa.array(code, pa.string()), "stop1": stops.take(pa.array(step)), "name1": name(pa.array(step)),
        "stop2": pc.take(stops, late), "name2": name(late), "trip_row": trip_row.take(pa.array(pattern)), "pass": pa.array(turn, pa.int64()), "at": pa.array(step - starts[pattern]),
        "n": pa.array([int(x) for x in n], pa.int64()), "row1": rows.take(pa.array(step)), "row2": pc.take(rows, late),
        **{c: pa.array([x[i] for x in place], pa.float64()) for i, c in enumerate(("m", "lat", "lon"))},
        **{c: pa.array([x and x[i] for x in before], pa.float64()) for i, c in enumerate(("lat2", "lon2"))},
    }
    out = pa.RecordBatch.from_arrays([columns[f.name].cast(TOLD_KINDS[f.dataType]) for f in TOLD], TOLD.names)
    return out.filter(pc.not_equal(out.column("stop1"), ""))


def told_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield told_of(batch, k)


def patterns(feed: Feed, shapes: DataFrame) -> DataFrame:
    """Distinct patterns of shapes with the first trip of each: feed_id, shape_id, trip_row, trip_id, rail, rows, stops, d.

    rows, stops and d are lists, with the stop times in order: unset ids are empty and unset distances 0. Patterns of shapes
    that aren't there, or whose first trip's route is unknown, are left out. What makes a pattern is dealt once, as its key. The trips'
    lists are written before, so what was shuffled for them goes before they are dealt by pattern.
    """
    kinds = first_rows(feed["routes"].where("route_id is not null").select(FEED, "route_id", "route_type", "_row_number"), "route_id")
    kinds = kinds.select(FEED, "route_id", (F.coalesce("route_type", F.lit(-1)) == RAIL).alias("rail"))
    trips = feed["trips"].where("trip_id is not null").select(FEED, "trip_id", "shape_id", "route_id", F.col("_row_number").alias("trip_row"))
    trips = trips.join(few(shapes.select(FEED, "shape_id")), [FEED, "shape_id"], "left_semi")
    step = F.struct(
        F.coalesce("stop_sequence", F.lit(0)).alias("k"), F.col("_row_number").alias("row"), F.coalesce("stop_id", F.lit("")).alias("stop_id"),
        F.coalesce("shape_dist_traveled", F.lit(0.0)).alias("d"),
    )
    lists = feed["stop_times"].where("trip_id is not null").groupBy(FEED, "trip_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    lists = lists.select(FEED, "trip_id", F.col("steps.row").alias("rows"), F.col("steps.stop_id").alias("stops"), F.col("steps.d").alias("d"))
    first = F.min_by(F.struct("trip_row", "trip_id", "route_id", "rows"), "trip_row").alias("t")
    lists = written(trips.join(lists, [FEED, "trip_id"]), "lists")
    grouped = lists.groupBy(FEED, "shape_id", "stops", "d").agg(first)
    grouped = grouped.select(FEED, "shape_id", "t.trip_row", "t.trip_id", "t.route_id", "t.rows", "stops", "d")
    found = written(grouped.join(kinds, [FEED, "route_id"]).select(FEED, "shape_id", "trip_row", "trip_id", "rail", "rows", "stops", "d"), "patterns")
    forget(lists)
    return found


def few(df: DataFrame) -> DataFrame:
    """A table of shapes for a join, broadcast while it has at most FEW_SHAPES rows; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= FEW_SHAPES else df


def shape_arrays(feed: Feed) -> DataFrame:
    """feed_id, shape_id, lats, lons, user: a shape's points in order; a point's unset distance is 0."""
    point = F.struct(F.coalesce("shape_pt_sequence", F.lit(0)).alias("k"), "_row_number", "shape_pt_lat", "shape_pt_lon", F.coalesce("shape_dist_traveled", F.lit(0.0)).alias("d"))
    rows = feed["shapes"].where("shape_id is not null and shape_pt_lat is not null and shape_pt_lon is not null")
    shapes = rows.groupBy(FEED, "shape_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return shapes.select(FEED, "shape_id", F.col("p.shape_pt_lat").alias("lats"), F.col("p.shape_pt_lon").alias("lons"), F.col("p.d").alias("user"))


def dealt(df: DataFrame, item: Column, shapes: DataFrame, *order: str) -> DataFrame:
    """Rows of a shape in parts, by a hash, each with the shape: feed_id, shape_id, part, items (a list of item), lats, lons, user.

    A part has about as many rows as the shape has points, PART at least, so the copies
    of shapes grow with the rows. Parts go to a fixed number of tasks: their work is in Python and
    not in bytes.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [FEED, "shape_id"]
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    most = F.greatest(F.lit(PART), F.size("lats"))
    parts = shapes.join(counts, key).select(*key, F.ceil(F.col("_n") / most).alias("_parts"), "lats", "lons", "user")
    rows = df.join(parts.select(*key, "_parts"), key).withColumn("part", F.pmod(F.xxhash64(*order), "_parts"))
    groups = rows.repartition(tasks, *key, "part").groupBy(*key, "part").agg(F.collect_list(item).alias("items"))
    copies = parts.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), "lats", "lons", "user")
    return groups.join(copies, [*key, "part"])


def candidates(feed: Feed, rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """The candidates of each visited (feed_id, shape_id, stop_id, large): places, and nearest where there are none."""
    pairs = rows.select(FEED, "shape_id", "stop_id", "lat", "lon", "large").distinct()
    work = dealt(pairs, F.struct("stop_id", "lat", "lon", "large"), shapes, "stop_id")
    found = found_udf("lats", "lons", "user", "items.stop_id", "items.lat", "items.lon", "items.large")
    return work.select(FEED, "shape_id", F.explode(found).alias("f")).select(FEED, "shape_id", "f.*")


def visited(feed: Feed) -> DataFrame:
    """Distinct (feed_id, shape_id, stop_id) of trips with a shape, with lat and lon ((0, 0) for a stop without a place)."""
    trips = feed["trips"].where("shape_id is not null and trip_id is not null").select(FEED, "trip_id", "shape_id")
    stops = feed["stop_times"].where("stop_id is not null").select(FEED, "trip_id", "stop_id").distinct()
    pairs = trips.join(stops, [FEED, "trip_id"]).select(FEED, "shape_id", "stop_id").distinct()
    return pairs.join(stop_coordinates(feed), [FEED, "stop_id"], "left").na.fill(0.0, ["lat", "lon"])


def shape_candidates(feed: Feed) -> DataFrame:
    """feed_id, shape_id, stop_id, n_candidates, nearest_m: for each visited (shape, stop), within NEAR_M, the metres of the best."""
    found = candidates(feed, visited(feed).withColumn("large", F.lit(False)), shape_arrays(feed))
    best = F.coalesce(F.array_min(F.col("places.m")), F.col("nearest.m"))
    return found.select(FEED, "shape_id", "stop_id", F.size("places").alias("n_candidates"), best.alias("nearest_m"))


def closest_shape_point(feed: Feed) -> DataFrame:
    """feed_id, shape_id, stop_id, distance_m: for each visited (shape, stop) the metres to the nearest place of the shape, however far."""
    return shape_candidates(feed).select(FEED, "shape_id", "stop_id", F.round("nearest_m", 2).alias("distance_m"))


#: Decimal places that notices tell.
DIGITS = {"m": 2, "lat": 6, "lon": 6, "lat2": 6, "lon2": 6}


def scaled(name: str, digits: int) -> Column:
    """A number as it is told, as a whole number of its last decimal place; divided again it is the same double, and as whole it packs well."""
    return F.round(F.round(name, digits) * 10**digits).cast("int")


def part_counts(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """feed_id, shape_id, steps, parts (stored): the stops in a shape's patterns, and in how many parts these are dealt.

    A part has about STEPS_A_POINT stops for each point of the shape, PART at least, so the copies of shapes grow with the stops.
    """
    key = [FEED, "shape_id"]
    points = shapes.select(*key, F.size("lats").alias("points"))
    counts = points.join(rows.groupBy(*key).agg(F.sum(F.size("stops")).alias("steps")), key)
    return written(counts.select(*key, "steps", F.ceil(F.col("steps") / F.greatest(F.lit(PART), F.col("points") * STEPS_A_POINT)).alias("parts")), "parts")


def parts_of(rows: DataFrame, shapes: DataFrame, counts: DataFrame, spots: DataFrame) -> DataFrame:
    """Patterns in parts of a shape, by a hash: feed_id, shape_id, items (patterns), spots (their stops, null if none is known), lats, lons, user.

    rows, shapes and counts are stored. Patterns and stops are each shuffled once to their parts.
    """
    key = [FEED, "shape_id"]
    steps = counts.agg(F.sum("steps")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-steps // TASK_STEPS))
    rows = rows.join(few(counts.select(*key, "parts")), key).withColumn("part", F.pmod(F.xxhash64("trip_row"), "parts"))
    # dealt by stop, rows of a stop and part meet before the stop's place is joined
    asked = rows.select(*key, "part", F.explode(F.array_distinct("stops")).alias("stop_id")).where("stop_id <> ''")
    asked = asked.repartition(tasks, FEED, "stop_id").distinct()
    listed = lambda df, item, name: df.repartition(tasks, *key, "part").groupBy(*key, "part").agg(F.collect_list(item).alias(name))
    items = listed(rows, F.struct("trip_row", "trip_id", "rail", "rows", "stops", "d"), "items")
    places = listed(asked.join(spots, [FEED, "stop_id"]), F.struct("stop_id", "lat", "lon", "name"), "spots")
    copies = shapes.join(few(counts.select(*key, "parts")), key).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "lats", "lons", "user")
    # none is broadcast, however few rows Spark expects: a row is a whole part
    return items.join(places.hint("merge"), [*key, "part"], "left").join(copies.hint("merge"), [*key, "part"])


def stop_to_shape(feed: Feed) -> DataFrame:
    """Stops too far from their trip's shape, matched too often, or out of order.

    A stop too far from a shape, by place or by user distance, is reported once for the shape,
    with the first trip; the other problems for each pattern and pass, with its first trip. Steps
    without a stop id count in a pattern and are never reported. Each step is written before the
    next, and what it read or shuffled goes then: lists of trips, patterns, problems. The problems stay.
    """
    with shuffles_dropped(feed.spark):
        shapes = written(shape_arrays(feed), "shapes")
        rows = patterns(feed, shapes)
        names = first_rows(feed["stops"].where("stop_id is not null").select(FEED, "stop_id", "stop_name", "_row_number"), "stop_id")
        spots = stop_coordinates(feed).join(names.select(FEED, "stop_id", F.col("stop_name").alias("name")), [FEED, "stop_id"])
        counts = part_counts(rows, shapes)
        work = parts_of(rows, shapes, counts, spots)
        told = work.select(FEED, "shape_id", "items", "spots", "lats", "lons", "user").mapInArrow(told_by_part, TOLD)
        told = written(told.withColumns({c: scaled(c, digits) for c, digits in DIGITS.items()}), "problems")
        forget(shapes, rows, counts)
    # of a trip, the first pass comes first; then stops in order. What isn't told once for a stop stands for itself
    itself = F.when(~F.col("code").isin(TOO_FAR, TOO_FAR_USER), F.struct("trip_row", "pass", "at", "code")).alias("itself")
    rest = [c for c in TOLD.names if c not in (FEED, "shape_id", "stop1", "pass", "at")]
    once = told.groupBy(FEED, "shape_id", "stop1", itself).agg(F.min_by(F.struct(*rest), F.struct("trip_row", "pass", "at")).alias("x"))
    return told_notices(once.select(FEED, "shape_id", "stop1", "x.*").withColumns({c: F.col(c) / 10**digits for c, digits in DIGITS.items()}))


def told_notices(told: DataFrame) -> DataFrame:
    """Problems as notices: whole contexts, with both stops where they are out of order."""
    spot = lambda lat, lon: F.concat_ws(",", lat, lon)
    stop = lambda n, match: {
        "stopTimeCsvRowNumber": F.col(f"row{n}"), "stopId": F.col(f"stop{n}"), "stopName": F.col(f"name{n}"), "match": match}
    shared = {"tripCsvRowNumber": F.col("trip_row"), "shapeId": F.col("shape_id"), "tripId": F.col("trip_id")}
    places = {1: spot("lat", "lon"), 2: spot("lat2", "lon2")}
    both = {f"{k}{n}": F.when(F.col("code") == OUT_OF_ORDER, v) for n, match in places.items() for k, v in stop(n, match).items()}
    one = {k: F.when(F.col("code") != OUT_OF_ORDER, v) for k, v in stop(1, places[1]).items()}
    last = {
        "matchCount": F.when(F.col("code") == TOO_MANY_MATCHES, F.col("n")),
        "geoDistanceToShape": F.when(F.col("code").isin(TOO_FAR, TOO_FAR_USER), F.col("m")),
    }
    return notices(told, F.col("code"), "WARNING", "trips.txt", "trip_row", **shared, **one, **both, **last)
