"""Map projections of longitude and latitude columns or arrays: spherical Mercator back to degrees, and local
Lambert azimuthal equal-area on the ellipsoid (Snyder 1987)."""

from __future__ import annotations

import numpy as np

from .geodesic import A, E2


def mercator_to_degrees(x, y) -> tuple[np.ndarray, np.ndarray]:
    """EPSG:3857 metres to degrees."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2)


def _q(sin_phi):
    e = np.sqrt(E2)
    return (1 - E2) * (sin_phi / (1 - E2 * sin_phi**2) + np.arctanh(e * sin_phi) / e)


def equal_area(lon, lat, lon0: float, lat0: float) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of a centre, areas kept."""
    phi, phi1, dlon = np.radians(np.asarray(lat, float)), np.radians(lat0), np.radians(np.asarray(lon, float) - lon0)
    pole = _q(1.0)
    beta, beta1 = np.arcsin(np.clip(_q(np.sin(phi)) / pole, -1, 1)), np.arcsin(np.clip(_q(np.sin(phi1)) / pole, -1, 1))
    rq = A * np.sqrt(pole / 2)
    m1 = np.cos(phi1) / np.sqrt(1 - E2 * np.sin(phi1) ** 2)
    d = A * m1 / (rq * np.cos(beta1)) if abs(np.cos(beta1)) > 1e-12 else 1.0
    b = rq * np.sqrt(2 / (1 + np.sin(beta1) * np.sin(beta) + np.cos(beta1) * np.cos(beta) * np.cos(dlon)))
    x = b * d * np.cos(beta) * np.sin(dlon)
    y = b / d * (np.cos(beta1) * np.sin(beta) - np.sin(beta1) * np.cos(beta) * np.cos(dlon))
    return x, y


def equal_area_inverse(x, y, lon0: float, lat0: float) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of metres east and north of a centre."""
    x, y, phi1 = np.asarray(x, float), np.asarray(y, float), np.radians(lat0)
    pole = _q(1.0)
    beta1 = np.arcsin(np.clip(_q(np.sin(phi1)) / pole, -1, 1))
    rq = A * np.sqrt(pole / 2)
    d = A * np.cos(phi1) / np.sqrt(1 - E2 * np.sin(phi1) ** 2) / (rq * np.cos(beta1)) if abs(np.cos(beta1)) > 1e-12 else 1.0
    rho = np.maximum(np.hypot(x / d, y * d), 1e-12)
    angle = 2 * np.arcsin(np.clip(rho / (2 * rq), -1, 1))
    q = pole * np.clip(np.cos(angle) * np.sin(beta1) + d * y * np.sin(angle) * np.cos(beta1) / rho, -1, 1)
    sin_phi = q / pole
    for _ in range(10):
        sin_phi = np.clip(sin_phi - (_q(sin_phi) - q) * (1 - E2 * sin_phi**2) ** 2 / (2 * (1 - E2)), -1, 1)
    lon = lon0 + np.degrees(np.arctan2(x * np.sin(angle), d * rho * np.cos(beta1) * np.cos(angle) - d**2 * y * np.sin(beta1) * np.sin(angle)))
    return lon, np.degrees(np.arcsin(sin_phi))
