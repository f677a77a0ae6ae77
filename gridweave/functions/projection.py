"""Transverse Mercator both ways and a change of datum, in numpy; for layers of polygons in an older system."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Fixed values of the reference systems.
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
BESSEL = Ellipsoid(6377397.155, 1 / 299.1528128)
#: Shifts (m), rotations (arc seconds, position vector) and scale (ppm) from the older datum.
KOREA_1985 = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)


@dataclass(frozen=True)
class TransverseMercator:
    """Krueger's series to the fourth order of the third flattening."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    k0: float
    fe: float
    fn: float

    def _series(self) -> tuple[float, list[float], list[float], float]:
        n = self.ellipsoid.f / (2 - self.ellipsoid.f)
        radius = self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        out = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        xi = float(np.arctan(self._conformal(np.radians(self.lat0))))
        return radius, out, back, xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(out))

    def _conformal(self, phi: np.ndarray) -> np.ndarray:
        e = math.sqrt(self.ellipsoid.e2)
        s = np.sin(phi)
        return np.sinh(np.arctanh(s) - e * np.arctanh(e * s))

    def forward(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius, out, _, m0 = self._series()
        lam, t = np.radians(np.asarray(lon) - self.lon0), self._conformal(np.radians(lat))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        north = xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(out))
        east = eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(out))
        return self.fe + self.k0 * radius * east, self.fn + self.k0 * radius * (north - m0)

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius, _, back, m0 = self._series()
        xi, eta = (np.asarray(y) - self.fn) / (self.k0 * radius) + m0, (np.asarray(x) - self.fe) / (self.k0 * radius)
        xi0 = xi - sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(back))
        eta0 = eta - sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(back))
        target = np.sin(xi0) / np.sqrt(np.sinh(eta0) ** 2 + np.cos(xi0) ** 2)
        tau, e2 = target, self.ellipsoid.e2
        for _ in range(6):  # Newton's steps from the conformal latitude to the geographic
            t = self._conformal(np.arctan(tau))
            tau = tau + (target - t) / np.sqrt(1 + t * t) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * np.sqrt(1 + tau * tau))
        return np.degrees(np.arctan(tau)), self.lon0 + np.degrees(np.arctan2(np.sinh(eta0), np.cos(xi0)))


UNIFIED = TransverseMercator(GRS80, 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0)
CENTRAL_1985 = TransverseMercator(BESSEL, 38.0, 127.0 + 10.405 / 3600, 1.0, 200_000.0, 500_000.0)


def change_datum(lat: np.ndarray, lon: np.ndarray, source: Ellipsoid = BESSEL, target: Ellipsoid = GRS80, shift: tuple = KOREA_1985) -> tuple[np.ndarray, np.ndarray]:
    """Geographic coordinates on another datum, by a seven-parameter shift of points at height 0."""
    dx, dy, dz, rx, ry, rz, ppm = shift
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    phi, lam = np.radians(lat), np.radians(lon)
    n = source.a / np.sqrt(1 - source.e2 * np.sin(phi) ** 2)
    x, y, z = n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - source.e2) * np.sin(phi)
    m = 1 + ppm * 1e-6
    x, y, z = dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z)
    p = np.hypot(x, y)
    phi = np.arctan2(z, p * (1 - target.e2))
    for _ in range(8):
        n = target.a / np.sqrt(1 - target.e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + target.e2 * n * np.sin(phi), p)
    return np.degrees(phi), np.degrees(np.arctan2(y, x))


def from_central_1985(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the older central belt in the unified system."""
    return UNIFIED.forward(*change_datum(*CENTRAL_1985.inverse(x, y)))


def reproject_rings(polygons: DataFrame, column: str = "rings") -> DataFrame:
    """The layer with its rings moved from the older central belt to the unified system."""
    kind = polygons.schema[column].dataType

    @F.pandas_udf(kind)
    def move(rings: pd.Series) -> pd.Series:
        def one(layer):
            out = []
            for ring in layer:
                x, y = from_central_1985(np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring]))
                out.append([{"x": float(a), "y": float(b)} for a, b in zip(x, y, strict=True)])
            return out

        return rings.map(one)

    moved: Column = move(F.col(column))
    return polygons.withColumn(column, moved)
