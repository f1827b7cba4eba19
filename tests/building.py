"""The literal two-storey building of FIXTURES.md section 4 as a triangle table."""

from __future__ import annotations

import math

SCHEMA = "scan_id string, face_id bigint, " + ", ".join(f"{c}{d} double" for c in "abc" for d in "xyz")

W, D, STOREY, CEILING = 8.0, 6.0, 3.0, 2.7
WALLS = [(0, 0, W, 0, 0.25), (W, 0, W, D, 0.25), (W, D, 0, D, 0.25), (0, D, 0, 0, 0.25), (4, 0, 4, D, 0.15)]
FURNITURE = {
    "bathroom": [(1.0, 1.0, 0.4, 0.7, 0.4), (1.2, 5.0, 0.6, 0.45, 0.18)],
    "bedroom": [(2.0, 3.6, 1.6, 2.0, 0.5)],
    "bare": [],
}


def _rect(o, u, v):
    """Two triangles of the rectangle o, o+u, o+u+v, o+v; the normal is u x v."""
    add = lambda p, *q: tuple(a + sum(r[i] for r in q) for i, a in enumerate(p))
    a, b, c, d = o, add(o, u), add(o, u, v), add(o, v)
    return [(*a, *b, *c), (*a, *c, *d)]


def _wall(wall, z0, z1, hole, outer_only=False):
    x1, y1, x2, y2, t = wall
    length = math.hypot(x2 - x1, y2 - y1)
    dx, dy = (x2 - x1) / length, (y2 - y1) / length
    nx, ny = -dy, dx
    spans = [(0.0, length, z0, z1)]
    if hole:
        a, b, h0, h1 = hole
        spans = [(0.0, a, z0, z1), (b, length, z0, z1), (a, b, z0, h0), (a, b, h1, z1)]
        spans = [s for s in spans if s[1] - s[0] > 1e-6 and s[3] - s[2] > 0.02]
    out = []
    for a, b, lo, hi in spans:
        along, up = (dx * (b - a), dy * (b - a), 0.0), (0.0, 0.0, hi - lo)
        back = tuple(-v for v in along)
        left = (x1 + dx * a + nx * t / 2, y1 + dy * a + ny * t / 2, lo)
        right = (x1 + dx * a - nx * t / 2, y1 + dy * a - ny * t / 2, lo)
        end_left = (left[0] + along[0], left[1] + along[1], lo)
        out += _rect(end_left, back, up)
        if not outer_only:
            out += _rect(right, along, up)
    return out


def _slab(z, up):
    return _rect((0, 0, z), (W, 0, 0), (0, D, 0)) if up else _rect((0, 0, z), (0, D, 0), (W, 0, 0))


def _box(cx, cy, w, d, h, z=0.0):
    x0, y0, x1, y1 = cx - w / 2, cy - d / 2, cx + w / 2, cy + d / 2
    return (
        _rect((x0, y0, z), (w, 0, 0), (0, 0, h)) + _rect((x1, y0, z), (0, d, 0), (0, 0, h))
        + _rect((x1, y1, z), (-w, 0, 0), (0, 0, h)) + _rect((x0, y1, z), (0, -d, 0), (0, 0, h))
        + _rect((x0, y0, z + h), (w, 0, 0), (0, d, 0))
    )


def triangles(scan="b", furniture="bathroom", tilt=0.0, scale=1.0, one_sided=False, gap=False):
    out = []
    for storey in (0.0, STOREY):
        for i, wall in enumerate(WALLS):
            hole = None
            if i == 0 and storey == 0.0:
                hole = (1.55, 2.45, 0.0, 2.1)
            if i == 2:
                hole = (1.4, 2.6, storey + 0.9, storey + 2.1)
            if gap and i == 3 and storey == 0.0:
                hole = (2.0, 3.0, 0.0, CEILING)
            out += _wall(wall, storey, storey + CEILING, hole, one_sided)
        out += _slab(storey, True) + _slab(storey + CEILING, False)
    out += _box(2.0, 2.0, 0.4, 0.4, CEILING)
    # The ramp: footprint (5.2, 0.4) to (6.4, 3.2), rising 2.2 towards +Y.
    out += _rect((5.2, 0.4, 0.0), (1.2, 0, 0), (0, 2.8, 2.2))
    for cx, cy, w, d, h in FURNITURE[furniture]:
        out += _box(cx, cy, w, d, h)
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    turned = []
    for t in out:
        pts = [t[i : i + 3] for i in (0, 3, 6)]
        pts = [(x * scale, (y * c - z * s) * scale, (y * s + z * c) * scale) for x, y, z in pts]
        turned.append(tuple(float(v) for p in pts for v in p))
    return [(scan, i, *t) for i, t in enumerate(turned)]
