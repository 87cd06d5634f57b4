"""Geography on the sphere and in the European equal-area projection."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: The GRS80 ellipsoid and the projection's origin and false origin.
_A, _E2 = 6378137.0, 0.00669438002290
_LAT0, _LON0, _X0, _Y0 = math.radians(52), math.radians(10), 4321000.0, 3210000.0


def _q(sin_lat):
    e = math.sqrt(_E2)
    log = np.log if isinstance(sin_lat, (float, np.ndarray)) else F.log
    return (1 - _E2) * (sin_lat / (1 - _E2 * sin_lat * sin_lat) - log((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e))


def laea_constants() -> tuple[float, float, float]:
    """The radius of the authalic sphere, the authalic latitude of the origin, and q at the pole."""
    pole = _q(1.0)
    return _A * math.sqrt(pole / 2), math.asin(_q(math.sin(_LAT0)) / pole), pole


def _scale() -> float:
    radius, beta0, _ = laea_constants()
    return _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (radius * math.cos(beta0))


def laea(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres in the Lambert azimuthal equal-area projection of Europe."""
    (radius, beta0, pole), scale = laea_constants(), _scale()
    beta, turn = F.asin(_q(F.sin(F.radians(lat))) / pole), F.radians(lon) - _LON0
    b = radius * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(turn)))
    x = _X0 + b * scale * F.cos(beta) * F.sin(turn)
    return x, _Y0 + b / scale * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(turn))


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres in that projection."""
    (radius, beta0, _), scale = laea_constants(), _scale()
    east, north = (x - _X0) / scale, (y - _Y0) * scale
    far = F.sqrt(east * east + north * north)
    turn = 2 * F.asin(far / (2 * radius))
    beta = F.asin(F.cos(turn) * math.sin(beta0) + F.when(far > 0, north * F.sin(turn) * math.cos(beta0) / far).otherwise(0.0))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    lon = F.atan2(east * F.sin(turn), far * math.cos(beta0) * F.cos(turn) - north * math.sin(beta0) * F.sin(turn))
    return F.degrees(F.lit(_LON0) + F.when(far > 0, lon).otherwise(0.0)), F.degrees(lat)


def _centre(p: tuple, q: tuple, r: tuple) -> tuple[float, float]:
    """The point as far from each of three; the same to the last bit in whatever order they come."""
    (ax, ay), (bx, by), (cx, cy) = sorted((p, q, r))
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    return ax + (cy * b2 - by * c2) / d, ay + (bx * c2 - cx * b2) / d


def _on_rim(p: tuple, q: tuple, radius: float) -> tuple[tuple, tuple]:
    """The two points at radius from both p and q; the first is to the right as seen from p to q."""
    (ax, ay), (bx, by) = sorted((p, q))
    dx, dy = bx - ax, by - ay
    d = math.hypot(dx, dy)
    h = math.sqrt(max(radius * radius - d * d / 4, 0.0)) / d
    one, two = ((ax + bx) / 2 + h * dy, (ay + by) / 2 - h * dx), ((ax + bx) / 2 - h * dy, (ay + by) / 2 + h * dx)
    return (one, two) if (ax, ay) == tuple(p) else (two, one)


def cell_ring(site: tuple, others: Iterable[tuple], radius: float, corners: int = 96) -> list[tuple]:
    """Counter-clockwise ring of what lies within radius of site and nearer to it than to the others (nearest first).

    others are taken only until one is too far to cut what is left, so they may be made as they are asked for. What two cells share, corners between three sites and ends of the rim between two, are computed from those sites
    alone, so neighbouring cells have the same corners to the last bit. The rim's own corners stand at fixed angles.
    """
    sx, sy = site
    # Corners and, for each, which site's edge leaves it (None: the square that the cell is cut from, outside the rim).
    w = 2 * radius
    shape: list[tuple] = [(sx - w, sy - w, None), (sx + w, sy - w, None), (sx + w, sy + w, None), (sx - w, sy + w, None)]
    reach = math.inf
    for other in others:
        nx, ny = other[0] - sx, other[1] - sy
        half = (nx * nx + ny * ny) / 2
        if half > reach:
            break
        side = [(x - sx) * nx + (y - sy) * ny - half for x, y, _ in shape]
        if max(side) <= 0:
            continue
        cut: list[tuple] = []
        for i, (x, y, edge) in enumerate(shape):
            j = (i + 1) % len(shape)
            a, b = side[i], side[j]
            if a <= 0:
                cut.append((x, y, edge))
            if (a <= 0) != (b <= 0):
                t = a / (a - b)
                at = (x + (shape[j][0] - x) * t, y + (shape[j][1] - y) * t)
                cut.append((*at, other if a <= 0 else edge))
        shape = cut
        # A site at more than twice the way to the farthest corner cuts nothing, nor do those after it; a little more, for the digits.
        reach = 2.000001 * max((x - sx) ** 2 + (y - sy) ** 2 for x, y, _ in shape)
    n = len(shape)
    exact = []
    for i, (x, y, edge) in enumerate(shape):
        before = shape[i - 1][2]
        degenerate = before is None or edge is None or before == edge
        exact.append((x, y) if degenerate else _centre(site, before, edge))
    ring: list[tuple] = []
    stretches = []
    for i, (_, _, edge) in enumerate(shape):
        if edge is None or math.dist(site, edge) >= 2 * radius:
            continue
        a, b = exact[i], exact[(i + 1) % n]
        enter, leave = _on_rim(site, edge, radius)
        # Along the edge, so that the site is to the left.
        dx, dy = leave[0] - enter[0], leave[1] - enter[1]
        along = lambda p: (p[0] - enter[0]) * dx + (p[1] - enter[1]) * dy
        start, end = (enter if along(a) <= 0 else a), (leave if along(b) >= along(leave) else b)
        if along(end) > along(start):
            stretches.append((start, end))
    angle = lambda p: math.atan2(p[1] - sy, p[0] - sx) % (2 * math.pi)
    corner = lambda k: (sx + radius * math.cos(2 * math.pi * k / corners), sy + radius * math.sin(2 * math.pi * k / corners))
    if not stretches:
        return [corner(k) for k in range(corners)]
    for (start, end), (following, _) in zip(stretches, stretches[1:] + stretches[:1]):
        ring += [start, end]
        if end != following and (len(stretches) > 1 or math.dist(end, following) > 0):
            a, b = angle(end) * corners / (2 * math.pi), angle(following) * corners / (2 * math.pi)
            if b <= a:
                b += corners
            ring += [corner(k % corners) for k in range(math.floor(a) + 1, math.ceil(b)) if a < k < b]
    return ring


def area(shape: np.ndarray) -> float:
    x, y = shape[:, 0], shape[:, 1]
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line that are needed to stay within tolerance of it: the ends, and wherever a stretch strays farther, its farthest point."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        way, own = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(way @ way)
        at = np.clip(own @ way / length, 0, 1) if length else np.zeros(len(own))
        far = np.linalg.norm(own - at[:, None] * way, axis=1)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            open_ += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[keep]
