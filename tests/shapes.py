"""Hand-made tiles and brute-force counterparts in plain Python."""

import math
import random

SIDE = 40


def cross():
    return {(20, x) for x in range(SIDE)} | {(y, 20) for y in range(SIDE)}


def tee():
    return {(20, x) for x in range(SIDE)} | {(y, 20) for y in range(20, SIDE)}


def ring():
    return {(10, x) for x in range(10, 20)} | {(19, x) for x in range(10, 20)} | {(y, 10) for y in range(10, 20)} | {(y, 19) for y in range(10, 20)}


def gap():
    return {(20, x) for x in range(SIDE) if not 18 <= x <= 20}


def spur():
    return {(20, x) for x in range(SIDE)} | {(y, 20) for y in range(15, 20)}


def noise(density, seed, side=SIDE):
    rng = random.Random(seed)
    return {(y, x) for y in range(side) for x in range(side) if rng.random() < density}


def frame(spark, tiles):
    rows = [(t, y, x) for t, px in tiles.items() for y, x in sorted(px)]
    return spark.createDataFrame(rows, "tile_id string, y int, x int")


def dims(spark, tiles, side=SIDE):
    return spark.createDataFrame([(t, side, side) for t in tiles], "tile_id string, width int, height int")


def pixels_of(df, tile):
    return {(r["y"], r["x"]) for r in df.where(df["tile_id"] == tile).collect()}


def near(px, p, diagonal=True):
    out = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy, dx) != (0, 0) and (diagonal or dy == 0 or dx == 0) and (p[0] + dy, p[1] + dx) in px:
                out.append((p[0] + dy, p[1] + dx))
    return out


def groups(px, diagonal=True):
    left, found = set(px), []
    while left:
        stack = [left.pop()]
        group = set(stack)
        while stack:
            for q in near(px, stack.pop(), diagonal):
                if q in left:
                    left.discard(q)
                    group.add(q)
                    stack.append(q)
        found.append(frozenset(group))
    return set(found)


def filled(px, side=SIDE):
    box = {(y, x) for y in range(-1, side + 1) for x in range(-1, side + 1)} - px
    outside = next(g for g in groups(box, diagonal=False) if (-1, -1) in g)
    return px | (box - outside)


def line(x0, y0, x1, y1):
    n = max(abs(x1 - x0), abs(y1 - y0))
    if n == 0:
        return {(y0, x0)}
    sx, sy = (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
    return {(y0 + sy * ((2 * abs(y1 - y0) * i + n) // (2 * n)), x0 + sx * ((2 * abs(x1 - x0) * i + n) // (2 * n))) for i in range(n + 1)}


def contacts(px, x0, y0, x1, y1):
    on = line(x0, y0, x1, y1)
    n = 0
    for y, x in px:
        if (y, x) in on or any(max(abs(y - ey), abs(x - ex)) <= 2 for ey, ex in ((y0, x0), (y1, x1))):
            continue
        n += min(max(abs(y - ly), abs(x - lx)) for ly, lx in on) <= 2
    return n


def greedy_keep(points, r, inclusive):
    """points: (rank, x, y); best rank first."""
    kept = []
    for p in sorted(points):
        d = [math.hypot(p[1] - k[1], p[2] - k[2]) for k in kept]
        if not any(v <= r if inclusive else v < r for v in d):
            kept.append(p)
    return kept
