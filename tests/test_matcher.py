"""Shape matching against a brute-force matcher: every arc for every stop, every assignment, trip by trip."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from headway.operators import matcher
from tests.feeds import codes, feed

R = 6_371_010.0


def vec(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])


def apart(u, v):
    return math.atan2(np.linalg.norm(np.cross(u, v)), float(u @ v)) * R


def nearest(p, a, b):
    """The nearest place of the arc, by halving it many times about the best of many steps."""
    n = np.cross(a, b)
    if np.linalg.norm(n) > 0:
        n /= np.linalg.norm(n)
        q = p - (p @ n) * n
        q /= np.linalg.norm(q)
        if np.cross(a, q) @ n > 0 and np.cross(q, b) @ n > 0:
            return q
    return a if apart(p, a) <= apart(p, b) else b


def slow_candidates(p, points, along, limit):
    out, best, before, receding = [], None, math.inf, False
    for i in range(len(points) - 1):
        q = nearest(p, points[i], points[i + 1])
        m = apart(p, q)
        if m <= limit:
            if receding and m < before and best:
                out.append(best)
                best = None
            if best is None or m < best[1]:
                best = (along[i] + apart(points[i], q), m)
        elif best:
            out.append(best)
            best = None
        before = apart(p, points[i + 1])
        receding = before > m
    return out + ([best] if best else [])


def slow_nearest(p, points):
    if len(points) == 1:
        return apart(p, points[0])
    return min(apart(p, nearest(p, points[i], points[i + 1])) for i in range(len(points) - 1))


def slow_order(choices):
    """(failing stop or None, chosen): by trying every ascending choice."""
    def best(upto):
        ways = [w for w in itertools.product(*map(range, map(len, choices[:upto]))) if all(choices[k][w[k]][0] <= choices[k + 1][w[k + 1]][0] for k in range(upto - 1))]
        return min(ways, key=lambda w: sum(choices[k][c][1] for k, c in enumerate(w)), default=None)

    for k in range(1, len(choices) + 1):
        if best(k) is None:
            return k - 1, best(k - 1)
    return None, best(len(choices))


def slow_by_distance(d, start, points, along, user):
    at = after = start
    while after < len(points) and d >= user[after]:
        at, after = after, after + 1
    if after <= 0 or at + 1 >= len(points) or abs(user[at] - user[after]) < 1e-7:
        return at, along[at], points[at]
    t = (d - user[at]) / (user[after] - user[at])
    angle = apart(points[at], points[at + 1]) / R
    q = points[at] if angle == 0 else (math.sin((1 - t) * angle) * points[at] + math.sin(t * angle) * points[at + 1]) / math.sin(angle)
    return at, along[at] + t * (along[at + 1] - along[at]), q


def slow_problems(shapes, stops, routes, trips, times):
    """(code, trip, stop, stop before or None) as the contract says, over shapes, then trips in order, then both passes."""
    out = []
    for shape, rows in shapes.items():
        points = [vec(a, b) for a, b, _ in rows]
        along, user, told, seen = [0.0], [], set(), set()
        for (a, b, _), (c, d, _) in itertools.pairwise(rows):
            h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
            along.append(along[-1] + 2 * R * math.asin(math.sqrt(h)))
        for *_, d in rows:
            user.append(max([d or 0.0, *user[-1:]]))
        for trip, route, own_shape in trips:
            own = times[trip]
            pattern = tuple((s, d or 0.0) for s, d in own)
            if own_shape != shape or pattern in seen:
                continue
            seen.add(pattern)
            if route not in routes:
                continue
            place = [vec(*stops.get(s, (0.0, 0.0))) for s, _ in own]
            limits = [400.0 if routes[route] == 2 and k in (0, len(own) - 1) else 100.0 for k in range(len(own))]

            def tell(code, k, before=None, trip=trip, own=own):
                stop = own[k][0]
                if stop and code in ("far", "user"):
                    if stop in told:
                        return
                    told.add(stop)
                if stop:
                    out.append((code, trip, stop, before))

            def by_place(k, far, place=place, limits=limits, points=points, along=along, tell=tell):
                found = slow_candidates(place[k], points, along, limits[k])
                if not found and slow_nearest(place[k], points) > limits[k]:
                    tell(far, k)
                if len(found) > 20:
                    tell("many", k)
                return found

            choices = [by_place(k, "far") for k in range(len(own))]
            if all(choices):
                fails, _ = slow_order(choices)
                if fails is not None:
                    tell("order", fails, own[fails - 1][0])
            if not own or not (own[-1][1] or 0) > 0 or not user[-1] > 0:
                continue
            choices, start = [], 0
            for k, (_, d) in enumerate(own):
                if d and d > 0:
                    start, a, q = slow_by_distance(d, start, points, along, user)
                    choices.append([(a, apart(place[k], q))])
                else:
                    choices.append(by_place(k, "user"))
                    if not choices[-1]:
                        break
            else:
                fails, way = slow_order(choices)
                if fails is not None:
                    tell("order", fails, own[fails - 1][0])
                else:
                    for k, c in enumerate(way):
                        if choices[k][c][1] > 100.0:
                            tell("user", k)
    return out


NAMES = {matcher.TOO_FAR: "far", matcher.TOO_FAR_USER: "user", matcher.TOO_MANY_MATCHES: "many", matcher.OUT_OF_ORDER: "order"}


def random_feed(r):
    shapes, step = {}, 0.002
    for name in ("H1", "H2", "H3"):
        lat, lon, total, rows = 40.0, -74.0, 0.0, []
        for _ in range(r.choice([1, 2, 12, 25])):
            rows.append((lat, lon, r.choice([total, total, None])))
            lat, lon, total = lat + r.uniform(-step, step), lon + r.uniform(-step / 3, step), total + r.choice([0.0, 1.0, 2.0])
        shapes[name] = rows
    shapes["H4"] = [(40.0 + (0.0 if k % 2 else 0.004), -74.0 + k * 1e-5, None) for k in range(50)]  # past (40, -74) 25 times, and away
    stops = {f"S{k}": (40.0 + r.uniform(-0.003, 0.003), -74.0 + r.uniform(-0.001, 0.012)) for k in range(12)} | {"S0": (40.0, -74.0), "S1": (40.0, -73.9999)}
    routes = {"bus": 3, "rail": 2}
    trips, times = [], {}
    for k in range(40):
        trip = f"T{k:02}"
        trips.append((trip, r.choice(["bus", "bus", "rail", "none"]), r.choice(list(shapes))))
        size = r.choice([1, 2, 3, 4])
        given = sorted(r.uniform(0, 25) for _ in range(size)) if r.random() < 0.8 else [r.uniform(0, 25) for _ in range(size)]
        times[trip] = [(r.choice([*stops, "S0", "S1", "gone", None]), r.choice([d, d, None, 0.0])) for d in given]
        if k % 5 == 4:
            times[trip] = times[f"T{k - 1:02}"]
    return shapes, stops, routes, trips, times


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    shapes, stops, routes, trips, times = random_feed(random.Random(seed))
    f = feed(
        spark,
        shapes=[dict(shape_id=h, shape_pt_lat=a, shape_pt_lon=b, shape_pt_sequence=k, shape_dist_traveled=d) for h, rows in shapes.items() for k, (a, b, d) in enumerate(rows)],
        stops=[dict(stop_id=s, stop_lat=a, stop_lon=b) for s, (a, b) in stops.items()],
        routes=[dict(route_id=k, route_type=v) for k, v in routes.items()],
        trips=[dict(trip_id=t, route_id=r, shape_id=h) for t, r, h in trips],
        stop_times=[dict(trip_id=t, stop_id=s, stop_sequence=k, shape_dist_traveled=d) for t, own in times.items() for k, (s, d) in enumerate(own)],
    )
    found = [(NAMES[c], x["tripId"], x.get("stopId") or x["stopId1"], x.get("stopId2")) for c, _, x in codes(matcher.stop_to_shape(f))]
    want = slow_problems(shapes, {k: v for k, v in stops.items()}, routes, trips, {t: [(s or "", d) for s, d in own] for t, own in times.items()})
    # an unknown stop before another is named by its id, an unset one by none
    assert sorted(found, key=str) == sorted(((c, t, s, b if c == "order" else None) for c, t, s, b in want), key=str)
    assert {c for c, *_ in found} >= {"far"}


def random_tables(seed):
    shapes, stops, routes, trips, times = random_feed(random.Random(seed))
    return dict(
        shapes=[dict(shape_id=h, shape_pt_lat=a, shape_pt_lon=b, shape_pt_sequence=k, shape_dist_traveled=d) for h, rows in shapes.items() for k, (a, b, d) in enumerate(rows)],
        stops=[dict(stop_id=s, stop_name=f"Name {s}", stop_lat=a, stop_lon=b) for s, (a, b) in stops.items()],
        routes=[dict(route_id=k, route_type=v) for k, v in routes.items()],
        trips=[dict(trip_id=t, route_id=r, shape_id=h) for t, r, h in trips],
        stop_times=[dict(trip_id=t, stop_id=s, stop_sequence=k, shape_dist_traveled=d) for t, own in times.items() for k, (s, d) in enumerate(own)],
    )


def test_parts_tell_what_the_whole_tells(spark, monkeypatch):
    """Patterns in parts of a stop or two, each part in a task of its own: the same notices, each once."""
    f = feed(spark, **random_tables(29))
    whole = codes(matcher.stop_to_shape(f))
    monkeypatch.setattr(matcher, "PART", 1)
    monkeypatch.setattr(matcher, "STEPS_A_POINT", 0)
    monkeypatch.setattr(matcher, "TASK_STEPS", 10)
    monkeypatch.setattr(matcher, "FEW_SHAPES", 0)
    assert codes(matcher.stop_to_shape(f)) == whole and {c for c, *_ in whole} == set(NAMES)


def test_little_stays_on_disk(spark):
    """The problems alone stay, and are shuffled once for those told once; patterns and what was shuffled for them go before."""
    from headway.shared import shared_folder

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder = shared_folder(spark).removeprefix("file:")
    before, setting = set(os.listdir(folder)), spark.conf.get(cleanup, None)
    found = matcher.stop_to_shape(feed(spark, **random_tables(5)))
    found.collect()
    assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["problems"]
    assert spark.conf.get(cleanup, None) == setting
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and plan.count("Aggregate") == 1


def test_candidates_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        lat, lon, rows = 40.0, -74.0, []
        for _ in range(r.randrange(2, 40)):
            rows.append((lat, lon))
            lat, lon = lat + r.choice([0, 1, -1]) * r.uniform(0, 0.0015), lon + r.choice([0, 1, 1, -1]) * r.uniform(0, 0.0015)
        shape = matcher.Shape(np.array([a for a, _ in rows]), np.array([b for _, b in rows]), np.zeros(len(rows)))
        places = [(a + r.uniform(-0.001, 0.001), b + r.uniform(-0.001, 0.001)) for a, b in r.choices(rows, k=8)] + [(41.0, -74.0)]
        points = [vec(a, b) for a, b in rows]
        p = matcher.vectors(*(np.array(x) for x in zip(*places, strict=True)))
        for limit in (100.0, 400.0):
            for (a, b), f in zip(places, matcher.find(shape, p, np.full(len(p), limit)), strict=True):
                want = slow_candidates(vec(a, b), points, shape.along.tolist(), limit)
                assert [*zip(f.along, f.metres, strict=True)] == [pytest.approx(w, abs=1e-4) for w in want]
                if not want:
                    assert f.nearest[0] == pytest.approx(slow_nearest(vec(a, b), points), abs=1e-4)


def arcs_looked_at(shape, p):
    """How many arcs are measured exactly for each p."""
    return len(shape.arcs_of(p)[0]) / len(p)


def test_search_of_long_shapes_grows_slowly():
    """The nearest place on long shapes, against every arc; few arcs are measured, on a long shape hardly more."""
    r = np.random.default_rng(3)
    looked = {}
    for n in (1_000, 30_000):
        k = np.arange(n)
        for name, lat, lon in (
            ("line", 40 + k * 2e-3 * 1_000 / n + (k % 7 == 0) * 5e-5, -74 + k % 2 * 1e-5),
            ("ring", 40 + 0.3 * np.sin(k * 6.3 / n), -74 + 0.3 * np.cos(k * 6.3 / n)),
            ("twice", 40 + np.abs(n / 2 - k) * 1e-4, -74 + 0 * k), ("far", -80 + k * 160 / n, 170 + k * 20 / n), ("still", 40 + 0 * k, -74 + k // 100 * 1e-9),
        ):
            shape = matcher.Shape(lat, lon, np.zeros(n))
            p = matcher.vectors(np.concatenate([40 + r.uniform(-1, 1, 40), r.uniform(-90, 90, 20), [0.0, 90.0]]), np.concatenate([-74 + r.uniform(-1, 30, 40), r.uniform(-180, 180, 20), [0.0, 0.0]]))
            found = matcher.find(shape, p, np.full(len(p), 100.0))
            for k, f in enumerate(found):
                place, metres = shape.nearest(p[[k]], np.arange(n - 1))
                assert (f.metres.min() if f.n else f.nearest[0]) == metres.min()
                assert f.n > 0 if metres.min() <= 100 else f.n == 0
            if name == "line":
                looked[n] = arcs_looked_at(shape, p[:40])
    assert looked[1_000] < 60 and looked[30_000] < 60


def test_blocks_are_halved_where_much_is_found(monkeypatch):
    """A stop at the pole of a shape has all arcs as near; blocks of such stops give the same one by one."""
    k = np.arange(500)
    shape = matcher.Shape(0.0 * k, k * 0.1, 0.0 * k)
    p = matcher.vectors(np.full(9, 90.0), np.zeros(9))
    want = matcher.find(shape, p, np.full(9, 100.0))
    monkeypatch.setattr(matcher, "FOUND_MOST", 600)
    found = matcher.find(shape, p, np.full(9, 100.0))
    assert (found.n == 0).all() and (found.nearest == want.nearest).all() and found.nearest[0][0] == pytest.approx(matcher.RADIUS * np.pi / 2)


def test_assignment_against_every_choice():
    r = random.Random(7)
    for _ in range(400):
        choices = [[(r.randrange(10) * 1.0, r.uniform(0, 9)) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 5))]
        fails, path = matcher.assign(choices)
        want, way = slow_order(choices)
        assert fails == (-1 if want is None else want)
        assert path == list(way)


LINE = [(40.0, -74.0), (40.0, -73.995), (40.0, -73.99)]


def line_feed(spark, stops, kind=3, distances=None, shape_distances=None, shape=LINE, **more):
    return feed(
        spark, routes=[dict(route_id="R", route_type=kind)], trips=[dict(trip_id="T", route_id="R", shape_id="H")],
        shapes=[dict(shape_id="H", shape_pt_lat=a, shape_pt_lon=b, shape_pt_sequence=k, shape_dist_traveled=(shape_distances or {}).get(k)) for k, (a, b) in enumerate(shape)],
        stops=[dict(stop_id=s, stop_name=f"Name {s}", stop_lat=a, stop_lon=b) for s, (a, b) in stops.items()],
        stop_times=[dict(trip_id="T", stop_id=s, stop_sequence=k, shape_dist_traveled=(distances or {}).get(s)) for k, s in enumerate(stops)], **more,
    )


def told(f):
    return [(NAMES[c], x.get("stopId") or (x["stopId1"], x["stopId2"])) for c, _, x in codes(matcher.stop_to_shape(f))]


def test_the_wider_limit_is_for_the_ends_of_rail_trips(spark):
    off = {"A": (40.0, -74.0), "B": (40.002, -73.995), "C": (40.002, -73.99)}  # 222 m
    assert told(line_feed(spark, off)) == [("far", "B"), ("far", "C")]
    assert told(line_feed(spark, off, kind=2)) == [("far", "B")]


def test_the_wider_limit_is_not_for_user_distances(spark):
    ends = {"A": (40.002, -74.0), "C": (40.002, -73.99)}
    assert told(line_feed(spark, ends, kind=2)) == []
    assert told(line_feed(spark, ends, kind=2, distances={"A": 0.001, "C": 2.0}, shape_distances={1: 1.0, 2: 2.0})) == [("user", "A"), ("user", "C")]


def test_a_context_is_whole(spark):
    off = {"A": (40.0, -74.0), "B": (40.002, -73.995), "C": (40.0, -73.99)}
    ((code, row, context),) = codes(matcher.stop_to_shape(line_feed(spark, off)))
    assert (code, row) == (matcher.TOO_FAR, 2)
    assert context.pop("geoDistanceToShape").startswith("222.")
    assert context == {"tripCsvRowNumber": "2", "shapeId": "H", "tripId": "T", "stopTimeCsvRowNumber": "3", "stopId": "B", "stopName": "Name B", "match": "40.0,-73.995"}


def test_a_shape_of_one_point(spark):
    near = {"A": (40.0, -74.0), "B": (40.0, -73.99)}
    assert told(line_feed(spark, near, shape=LINE[:1])) == [("far", "B")]


def test_a_run_that_stays_near_is_one_match(spark):
    """Zigzags within the limit are one candidate while they do not recede; visits from afar are one each."""
    visits = [(40.0 if k % 2 else 40.01, -74.0 + k * 1e-6) for k in range(44)]
    assert told(line_feed(spark, {"A": (40.0, -74.0), "B": (40.0, -73.99995)}, shape=visits)) == [("many", "A"), ("many", "B")]
    assert told(line_feed(spark, {"A": (40.0, -74.0), "B": (40.0, -73.99995)}, shape=visits[:40])) == []
