"""Areas and lines on the WGS84 ellipsoid (Karney 2013; Bessel's auxiliary sphere), vectorised over edges."""

from __future__ import annotations

import numpy as np

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
_X, _W = np.polynomial.legendre.leggauss(16)


def _zone(sin_phi: np.ndarray) -> np.ndarray:
    """Area between the equator and a latitude, per radian of longitude (m2)."""
    e = np.sqrt(E2)
    return B * B / 2 * (sin_phi / (1 - E2 * sin_phi**2) + np.arctanh(e * sin_phi) / e)


def _solve(lon1, lat1, lon2, lat2):
    """Great-ellipse elements of each edge: (sin a0, cos a0, sigma1, sigma2, k2, sphere longitude difference)."""
    f = FLAT
    b1, b2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    dlon = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    omega = dlon.copy()
    s1, c1, s2, c2 = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2)
    for _ in range(60):
        so, co = np.sin(omega), np.cos(omega)
        azimuth = np.arctan2(c2 * so, c1 * s2 - s1 * c2 * co)
        sin0 = np.sin(azimuth) * c1
        cos0 = np.hypot(np.cos(azimuth), np.sin(azimuth) * s1)
        sigma1 = np.arctan2(s1, np.cos(azimuth) * c1)
        sigma12 = np.arctan2(np.hypot(c1 * s2 - s1 * c2 * co, c2 * so), s1 * s2 + c1 * c2 * co)
        k2 = EP2 * cos0**2
        half = sigma12 / 2
        s = sigma1[:, None] + half[:, None] * (1 + _X)
        inner = (2 - f) / (1 + (1 - f) * np.sqrt(1 + k2[:, None] * np.sin(s) ** 2))
        new = dlon + f * sin0 * (inner @ _W) * half
        change = np.abs(new - omega)
        omega = new
        if not len(change) or change.max() < 1e-15:
            break
    else:
        if change.max() > 1e-12:
            raise ValueError("an edge is nearly antipodal: its geodesic can't be found")
    return sin0, cos0, sigma1, sigma1 + sigma12, k2, omega


def edge_areas(x1, y1, x2, y2) -> np.ndarray:
    """Signed area (m2) between each geodesic edge (degrees) and the equator; positive eastward."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (x1, y1, x2, y2))
    # along a meridian to a pole, all of the longitude's change is made at the pole
    polar = np.maximum(np.abs(lat1), np.abs(lat2)) >= np.pi / 2
    out = np.where(polar, _zone(np.sign(lat1 + lat2)) * ((lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi), 0.0)
    use = np.flatnonzero((lon1 != lon2) & ~((lat1 == 0) & (lat2 == 0)) & ~polar)
    if not len(use):
        return out
    sin0, cos0, sigma1, sigma2, k2, _ = _solve(lon1[use], lat1[use], lon2[use], lat2[use])
    half = (sigma2 - sigma1) / 2
    s = sigma1[:, None] + half[:, None] * (1 + _X)
    sin_b = cos0[:, None] * np.sin(s)
    cos_b2 = np.maximum(1 - sin_b**2, 1e-300)
    sin_phi = sin_b / np.sqrt(sin_b**2 + (1 - FLAT) ** 2 * cos_b2)
    d_omega = sin0[:, None] / cos_b2
    inner = (2 - FLAT) / (1 + (1 - FLAT) * np.sqrt(1 + k2[:, None] * np.sin(s) ** 2))
    d_lambda = d_omega - FLAT * sin0[:, None] * inner
    out[use] = (_zone(sin_phi) * d_lambda) @ _W * half
    return out


def ring_area_km2(points) -> float:
    """Signed area of a closed or open ring of (lon, lat), counterclockwise positive."""
    p = np.asarray(points, float)
    q = np.roll(p, -1, axis=0)
    return float(-edge_areas(p[:, 0], p[:, 1], q[:, 0], q[:, 1]).sum() / 1e6)


def distance_m(x1, y1, x2, y2) -> np.ndarray:
    """Geodesic distance in metres."""
    lon1, lat1, lon2, lat2 = (np.atleast_1d(np.radians(np.asarray(v, float))) for v in (x1, y1, x2, y2))
    same = (lon1 == lon2) & (lat1 == lat2)
    _, _, sigma1, sigma2, k2, _ = _solve(lon1, lat1, lon2, lat2)
    half = (sigma2 - sigma1) / 2
    s = sigma1[:, None] + half[:, None] * (1 + _X)
    return np.where(same, 0, B * (np.sqrt(1 + k2[:, None] * np.sin(s) ** 2) @ _W) * half)


def destination(lon, lat, azimuth, metres) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) reached from a point along a geodesic: Newton steps on the arc for the distance, then the longitude's integral."""
    lon1, lat1, a1 = (np.atleast_1d(np.radians(np.asarray(v, float))) for v in (lon, lat, azimuth))
    length = np.atleast_1d(np.asarray(metres, float))
    beta = np.arctan((1 - FLAT) * np.tan(lat1))
    sin0 = np.sin(a1) * np.cos(beta)
    cos0 = np.hypot(np.cos(a1), np.sin(a1) * np.sin(beta))
    sigma1, k2 = np.arctan2(np.sin(beta), np.cos(a1) * np.cos(beta)), EP2 * cos0**2
    along = lambda arc: sigma1[:, None] + arc[:, None] / 2 * (1 + _X)
    speed = lambda sigma: B * np.sqrt(1 + k2[:, None] * np.sin(sigma) ** 2)
    arc = length / B
    for _ in range(20):
        step = ((speed(along(arc)) @ _W) * arc / 2 - length) / speed((sigma1 + arc)[:, None])[:, 0]
        arc = arc - step
        if np.abs(step).max() < 1e-15:
            break
    sigma2 = sigma1 + arc
    beta2 = np.arctan2(cos0 * np.sin(sigma2), np.hypot(cos0 * np.cos(sigma2), sin0))
    omega = np.arctan2(sin0 * np.sin(sigma2), np.cos(sigma2)) - np.arctan2(sin0 * np.sin(sigma1), np.cos(sigma1))
    inner = (2 - FLAT) / (1 + (1 - FLAT) * np.sqrt(1 + k2[:, None] * np.sin(along(arc)) ** 2))
    turned = omega - FLAT * sin0 * (inner @ _W) * arc / 2
    lon2 = (lon1 + turned + np.pi) % (2 * np.pi) - np.pi
    return np.degrees(lon2), np.degrees(np.arctan2(np.tan(beta2), 1 - FLAT))
