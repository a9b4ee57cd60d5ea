"""Small numpy steps used inside tasks: walks along lines and thinning on dense blocks.

Blocks come as stacks ``(n, height, width)`` of 0/1 with a dark rim, so one call serves many small windows or one
large block. Directions are numbered in scan order: dy outer, dx inner."""

from __future__ import annotations

import numpy as np

DY = np.array([-1, -1, -1, 0, 0, 1, 1, 1])
DX = np.array([-1, 0, 1, -1, 1, -1, 0, 1])
_UNIT = np.stack([DY, DX], axis=1) / np.sqrt(DY * DY + DX * DX)[:, None]
TURN = np.round(_UNIT @ _UNIT.T, 9)        # cosine between two step directions


def degree(stack: np.ndarray) -> np.ndarray:
    out = np.zeros(stack.shape, dtype=np.uint8)
    h, w = stack.shape[1:]
    for dy, dx in zip(DY, DX):
        out[:, 1:-1, 1:-1] += stack[:, 1 + dy:h - 1 + dy, 1 + dx:w - 1 + dx]
    return out


def around(stack: np.ndarray, b: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(m, 8) flags of the lit neighbours."""
    return stack[b[:, None], y[:, None] + DY, x[:, None] + DX] > 0


def walk(stack, deg, b, y, x, d, mode: str, limit: int, exit_dist: float = 6.0):
    """Walk from ``(y, x)`` by the first step ``d``; returns the path ``(m, limit + 1, 2)``, its length and why it ended.

    ``straight`` takes the straightest next pixel, stops on a branch pixel and never revisits. ``coords`` crosses the
    crowded pixels near its start, taking the farthest one, and stops at any branching beyond ``exit_dist``.
    ``terminus`` only follows pixels with two neighbours. Reasons: 0 stuck or end, 1 branching, 2 loop, 3 limit."""
    m = len(b)
    path = np.full((m, limit + 1, 2), -9, dtype=np.int32)
    path[:, 0] = np.stack([y, x], axis=1)
    cy, cx = y + DY[d], x + DX[d]
    path[:, 1] = np.stack([cy, cx], axis=1)
    n = np.full(m, 1)
    why = np.full(m, 3)
    came = d.copy()
    live = np.arange(m)
    for _ in range(limit):
        live = live[n[live] < limit]
        if not len(live):
            break
        bb, yy, xx = b[live], cy[live], cx[live]
        lit = around(stack, bb, yy, xx)
        ny, nx = yy[:, None] + DY, xx[:, None] + DX
        back = lit & (ny == path[live, n[live] - 1, 0][:, None]) & (nx == path[live, n[live] - 1, 1][:, None])
        here = lit.sum(1)
        ahead = lit & ~back
        if mode == "straight":
            pick = np.where(ahead, TURN[came[live]], -9.0).argmax(1)
            stop = ~ahead.any(1)
            why[live[stop]] = 0
        elif mode == "coords":
            seen = ((path[live, None, :, 0] == ny[:, :, None]) & (path[live, None, :, 1] == nx[:, :, None])).any(2)
            ahead = lit & ~seen
            dist2 = (yy - y[live]) ** 2 + (xx - x[live]) ** 2
            outside = dist2 > exit_dist ** 2
            far = (ny - y[live][:, None]) ** 2 + (nx - x[live][:, None]) ** 2
            pick = np.where(ahead, far, -1).argmax(1)
            dead = (here <= 1) | ~ahead.any(1)
            fork = outside & ((here >= 3) | (ahead.sum(1) > 1))
            stop = dead | fork
            why[live[stop]] = np.where(fork, 1, 0)[stop]
        else:
            pick = ahead.argmax(1)
            dead, fork = (here <= 1) | ~ahead.any(1), (here >= 3) | (ahead.sum(1) > 1)
            stop = dead | fork
            why[live[stop]] = np.where(fork & (here > 1), 1, 0)[stop]
        ty, tx = yy + DY[pick], xx + DX[pick]
        again = ~stop & ((path[live, :, 0] == ty[:, None]) & (path[live, :, 1] == tx[:, None])).any(1)
        why[live[again]] = 2
        go = ~stop & ~again
        w = live[go]
        cy[w], cx[w], came[w] = ty[go], tx[go], pick[go]
        n[w] += 1
        path[w, n[w]] = np.stack([cy[w], cx[w]], axis=1)
        if mode == "straight":
            fork = deg[b[w], cy[w], cx[w]] >= 3
            why[w[fork]] = 1
            w = w[~fork]
        live = w
    return path, n, why


def follow_from_end(stack, deg, b, y, x, limit: int):
    """Path of up to ``limit`` steps from a line end, stopping on a pixel without exactly two neighbours."""
    first = around(stack, b, y, x)
    d = first.argmax(1)
    path, n, _ = walk(stack, deg, b, y, x, d, "terminus", limit)
    n = np.where(first.any(1), n, 0)
    return path, n


def thin_pass(bw: np.ndarray, rounds: int) -> tuple[np.ndarray, bool]:
    """Up to ``rounds`` rounds of two-step parallel thinning (Guo and Hall, 1989) on one block, and whether the last one changed it."""
    for _ in range(rounds):
        before = bw.copy()
        for step in (0, 1):
            c = bw[1:-1, 1:-1]
            n, s, w, e = bw[:-2, 1:-1], bw[2:, 1:-1], bw[1:-1, :-2], bw[1:-1, 2:]
            nw, ne, sw, se = bw[:-2, :-2], bw[:-2, 2:], bw[2:, :-2], bw[2:, 2:]
            ring = [n, ne, e, se, s, sw, w, nw]
            steps = sum((1 - ring[2 * i]) & (ring[2 * i + 1] | ring[(2 * i + 2) % 8]) for i in range(4))
            n1 = (nw | n) + (ne | e) + (se | s) + (sw | w)
            n2 = (n | ne) + (e | se) + (s | sw) + (w | nw)
            least = np.minimum(n1, n2)
            guard = ((n | ne | (1 - se)) & e) if step == 0 else ((s | sw | (1 - nw)) & w)
            drop = (c == 1) & (steps == 1) & (least >= 2) & (least <= 3) & (guard == 0)
            c[drop] = 0
        if (bw == before).all():
            return bw, False
    return bw, True
