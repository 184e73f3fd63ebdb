"""Cutting closed meshes by convex solids, half-spaces among them, without a solid-modelling kernel.

A convex cutter is a set of planes (point, outward normal). What is left of a host's skin is found triangle by triangle; the
walls of the cut are the host's sections along each plane, cut down to the cutter's face. Sections are taken of the
host as it came, so any number of cutters may follow one another.
"""

from __future__ import annotations

import numpy as np

from .solids import Mesh, frame, moved, signed_area, triangulate

Planes = tuple[np.ndarray, np.ndarray]
#: Distances below this share of the host's extent count as none.
EPSILON = 1e-9
#: Vertices closer than this share of the extent are one.
WELD_SHARE = 1e-7


def weld(mesh: Mesh) -> Mesh:
    """A mesh whose vertices in one grid cell are one; triangles that collapse go."""
    v, f = mesh
    cell = max(float(np.ptp(v, axis=0).max(initial=0)) * WELD_SHARE, 1e-12)
    _, first, inverse = np.unique(np.round((v - v.min(0)) / cell).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    g = inverse.reshape(-1)[f]
    return v[first], g[(g[:, 0] != g[:, 1]) & (g[:, 1] != g[:, 2]) & (g[:, 2] != g[:, 0])]


def is_closed(mesh: Mesh) -> bool:
    """True if every edge is used once in each direction."""
    f = mesh[1]
    edges = np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]])
    there, n = np.unique(edges, axis=0, return_counts=True)
    back = np.unique(edges[:, ::-1], axis=0)
    return len(f) >= 4 and bool((n == 1).all()) and there.shape == back.shape and bool((there == back).all())


def convex_planes(mesh: Mesh) -> Planes | None:
    """The planes of a convex mesh, each once; None if it is not convex or has no volume."""
    v, f = weld(mesh)
    a, b, c = (v[f[:, i]] for i in range(3))
    normals = np.cross(b - a, c - a)
    sizes = np.linalg.norm(normals, axis=1)
    keep = sizes > 1e-14
    if keep.sum() < 4:
        return None
    points, normals = a[keep], normals[keep] / sizes[keep, None]
    extent = float(np.ptp(v, axis=0).max())
    if np.einsum("ij,ij->", points - v[0], normals * sizes[keep, None]) < 0:
        normals = -normals
    if (((v[None] - points[:, None]) * normals[:, None]).sum(2) > extent * 1e-6).any():
        return None
    chosen: list[int] = []
    for i in range(len(points)):
        if not any(normals[i] @ normals[j] > 1 - 1e-9 and abs((points[i] - points[j]) @ normals[j]) <= extent * 1e-7 for j in chosen):
            chosen.append(i)
    return points[chosen], normals[chosen]


def _split(polygon: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a convex polygon at or below zero and above it."""
    low, high = [], []
    for i in range(len(polygon)):
        p, q, d, e = polygon[i], polygon[(i + 1) % len(polygon)], distances[i], distances[(i + 1) % len(polygon)]
        (low if d <= 0 else high).append(p)
        if (d <= 0) != (e <= 0):
            x = p + (q - p) * (d / (d - e))
            low.append(x)
            high.append(x)
    return np.array(low), np.array(high)


def _side(polygon: np.ndarray, point: np.ndarray, normal: np.ndarray, eps: float) -> np.ndarray:
    d = (polygon - point) @ normal
    return np.where(np.abs(d) <= eps, 0.0, d)


def outside(polygons: list[np.ndarray], planes: Planes, eps: float, facing: np.ndarray | None = None) -> list[np.ndarray]:
    """The parts of convex polygons that lie outside a convex solid, split along its planes.

    What lies on a plane counts as inside, but for planes whose normal is `facing`.
    """
    out = []
    for polygon in polygons:
        rest = polygon
        for point, normal in zip(*planes, strict=True):
            d = _side(rest, point, normal, eps)
            if facing is not None and normal @ facing > 1 - 1e-9:
                d = np.where(d == 0, eps, d)
            rest, gone = _split(rest, d)
            if len(gone) >= 3:
                out.append(gone)
            if len(rest) < 3:
                break
    return out


def section(host: Mesh, point: np.ndarray, normal: np.ndarray, eps: float) -> list[np.ndarray]:
    """Triangles of a closed mesh's section by a plane, facing along -normal; nothing where the host ends at the plane from below.

    Points on the plane count as below, so each triangle with corners on both sides gives one segment between two edges, and
    the segments of neighbours meet on the edge they share.
    """
    v, f = host
    d = _side(v, point, normal, eps)
    above = d > 0
    follows: dict[tuple[int, int], tuple[int, int]] = {}
    for t in f[above[f].any(1) & ~above[f].all(1)].tolist():
        ends = {}
        for i in range(3):
            p, q = t[i], t[(i + 1) % 3]
            if above[p] != above[q]:
                ends["up" if above[q] else "down"] = (min(p, q), max(p, q))
        follows[ends["down"]] = ends["up"]
    if not follows:
        return []
    at = {e: v[e[0]] + (v[e[1]] - v[e[0]]) * (d[e[0]] / (d[e[0]] - d[e[1]])) for e in follows}
    loops, open_ones = [], set(follows)
    while open_ones:
        e = first = open_ones.pop()
        ring = [at[e]]
        while (e := follows.get(e)) is not None and e != first and e in open_ones:
            open_ones.discard(e)
            ring.append(at[e])
        if len(ring) >= 3:
            loops.append(np.array(ring))
    m = frame(point, -normal, None)
    flat = [moved(x, np.linalg.inv(m))[:, :2] for x in loops]
    flat = [x for x in flat if abs(signed_area(x)) > eps * eps]
    # Outer loops turn one way and holes the other; which is which shows by the largest.
    if not flat:
        return []
    turn = np.sign(signed_area(max(flat, key=lambda x: abs(signed_area(x)))))
    outers = [x for x in flat if np.sign(signed_area(x)) == turn]
    out = []
    holes: list[list[np.ndarray]] = [[] for _ in outers]
    for x in flat:
        if np.sign(signed_area(x)) != turn:
            inside = [i for i, o in enumerate(outers) if _within(x[0], o)]
            if inside:
                holes[min(inside, key=lambda i: abs(signed_area(outers[i])))].append(x)
    for outer, own in zip(outers, holes, strict=True):
        p, tris = triangulate(outer, own)
        out += [moved(np.column_stack([p[t], np.zeros(3)]), m) for t in tris]
    return out


def _within(p: np.ndarray, loop: np.ndarray) -> bool:
    a, b = loop, np.roll(loop, -1, axis=0)
    crosses = ((a[:, 1] > p[1]) != (b[:, 1] > p[1])) & (p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
    return bool(crosses.sum() % 2)


def subtract(host: Mesh, cutters: list[Planes]) -> Mesh:
    """A closed host without the union of convex cutters; walls of the cuts included."""
    v, f = weld(host)
    eps = max(float(np.ptp(v, axis=0).max()), 1e-9) * EPSILON
    skin = [v[t] for t in f]
    for planes in cutters:
        skin = outside(skin, planes, eps)
    for k, (points, normals) in enumerate(cutters):
        for i in range(len(points)):
            walls = section((v, f), points[i], normals[i], eps)
            for j in range(len(points)):
                if j != i:
                    walls = [low for w in walls for low, _ in [_split(w, _side(w, points[j], normals[j], eps))] if len(low) >= 3]
            for other, planes in enumerate(cutters):
                if other < k:
                    walls = outside(walls, planes, eps)
                elif other > k:  # of walls that two cutters share, the later one's goes
                    walls = outside(walls, planes, eps, normals[i])
            skin += walls
    tris = [p[[0, i, i + 1]] for p in skin for i in range(1, len(p) - 1)]
    if not tris:
        return np.zeros((0, 3)), np.zeros((0, 3), np.int64)
    return np.concatenate(tris), np.arange(3 * len(tris)).reshape(-1, 3)


def half_space(mesh: Mesh, agree: bool) -> Planes:
    """The plane of a slab that stands in for a half-space: one plane, the solid behind it."""
    v = mesh[0]
    top, bottom = v[4:8], v[:4]
    on = top if agree else bottom
    away = (top - bottom)[0] if agree else (bottom - top)[0]
    return on[:1], (away / np.linalg.norm(away))[None]


def cut(host: Mesh, cutters: list[tuple[str, Mesh]]) -> tuple[Mesh, str]:
    """(mesh, outcome): the host without its cutters (source, mesh); unsupported ones leave it as it was, and the outcome says why."""
    if not cutters:
        return host, "untouched"
    if len(host[1]) < 4 or not is_closed(weld(host)):
        return host, "host_open"
    planes = []
    for source, mesh in cutters:
        if "halfspace_agree" in source or "halfspace_disagree" in source:
            planes.append(half_space(mesh, "halfspace_agree" in source))
            continue
        found = convex_planes(mesh) if len(mesh[1]) else None
        if found is None:
            return host, "cutter_empty" if not len(mesh[1]) else "cutter_not_convex"
        planes.append(found)
    left = subtract(host, planes)
    return left, "cut" if len(left[1]) else "emptied"
