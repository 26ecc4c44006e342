"""Reference systems as pairs of array functions, to and from longitudes and latitudes in degrees.

Any two systems here are a pair that can be transformed: through degrees. Rows of an ``(n, dims)``
array are tuples; a third and fourth number pass through. Where a system does not reach, NaN comes out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

Move = Callable[[np.ndarray], np.ndarray]

# Numbers of the systems, the sphere radius of web mercator.
DEGREES, MERCATOR = 4326, 3857
UTM_NORTH, UTM_SOUTH, ZONES = 32600, 32700, 60
EARTH_RADIUS = 6378137.0
# Web mercator ends here; beyond it the northing grows without bound.
MERCATOR_LATITUDE = 85.06

#: First and last number of each group of systems.
RANGES = ((DEGREES, DEGREES), (MERCATOR, MERCATOR), (UTM_NORTH + 1, UTM_NORTH + ZONES), (UTM_SOUTH + 1, UTM_SOUTH + ZONES))


def _to_mercator(coords: np.ndarray) -> np.ndarray:
    out = coords.copy()
    out[:, 0] = np.radians(coords[:, 0]) * EARTH_RADIUS
    latitude = np.where(np.abs(coords[:, 1]) <= MERCATOR_LATITUDE, coords[:, 1], np.nan)
    out[:, 1] = np.log(np.tan(np.pi / 4 + np.radians(latitude) / 2)) * EARTH_RADIUS
    return out


def _from_mercator(coords: np.ndarray) -> np.ndarray:
    out = coords.copy()
    out[:, 0] = np.degrees(coords[:, 0] / EARTH_RADIUS)
    out[:, 1] = np.degrees(2 * np.arctan(np.exp(coords[:, 1] / EARTH_RADIUS)) - np.pi / 2)
    return out


# --- transverse Mercator ------------------------------------------------------------

# The WGS 84 ellipsoid, the scale and false origin of UTM.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
#: Degrees from a zone's meridian, and of latitude, within which the series hold to far below a millimetre.
REACH, HIGHEST = 20.0, 89.0

_N = FLATTENING / (2 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_E = np.sqrt(_E2)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The series of the transverse Mercator projection in the third flattening, to its fourth power.
_FORTH = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def _meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def _to_utm(zone: int, south: bool, coords: np.ndarray) -> np.ndarray:
    out = coords.copy()
    # Longitudes count from the zone's meridian, the short way round.
    east = (coords[:, 0] - _meridian(zone) + 180) % 360 - 180
    inside = (np.abs(east) <= REACH) & (np.abs(coords[:, 1]) <= HIGHEST)
    east, sine = np.radians(np.where(inside, east, np.nan)), np.sin(np.radians(coords[:, 1]))
    t = np.sinh(np.arctanh(sine) - _E * np.arctanh(_E * sine))
    xi, eta = np.arctan2(t, np.cos(east)), np.arcsinh(np.sin(east) / np.hypot(t, np.cos(east)))
    x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(_FORTH, 1))
    y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(_FORTH, 1))
    out[:, 0] = FALSE_EASTING + SCALE * _RECTIFYING * x
    out[:, 1] = FALSE_NORTHING * south + SCALE * _RECTIFYING * y
    return out


def _from_utm(zone: int, south: bool, coords: np.ndarray) -> np.ndarray:
    out = coords.copy()
    x = (coords[:, 0] - FALSE_EASTING) / (SCALE * _RECTIFYING)
    y = (coords[:, 1] - FALSE_NORTHING * south) / (SCALE * _RECTIFYING)
    xi = y - sum(c * np.sin(2 * j * y) * np.cosh(2 * j * x) for j, c in enumerate(_BACK, 1))
    eta = x - sum(c * np.cos(2 * j * y) * np.sinh(2 * j * x) for j, c in enumerate(_BACK, 1))
    conformal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    tau = conformal
    for _ in range(5):
        # Newton steps for the tangent of the latitude; the second one is exact to double precision nearly everywhere.
        root = np.sqrt(1 + tau**2)
        sigma = np.sinh(_E * np.arctanh(_E * tau / root))
        now = tau * np.sqrt(1 + sigma**2) - sigma * root
        tau = tau + (conformal - now) / np.sqrt(1 + now**2) * (1 + (1 - _E2) * tau**2) / ((1 - _E2) * root)
    east = np.degrees(np.arctan2(np.sinh(eta), np.cos(xi)))
    east = np.where(np.abs(east) <= REACH, east, np.nan)
    out[:, 0] = (east + _meridian(zone) + 180) % 360 - 180
    out[:, 1] = np.degrees(np.arctan(tau))
    return out


def system(srid: int) -> tuple[Move, Move] | None:
    """``(to degrees, from degrees)`` of a reference system; None if it is not known."""
    if srid == DEGREES:
        return np.copy, np.copy
    if srid == MERCATOR:
        return _from_mercator, _to_mercator
    for first, south in ((UTM_NORTH, False), (UTM_SOUTH, True)):
        if first < srid <= first + ZONES:
            return partial(_from_utm, srid - first, south), partial(_to_utm, srid - first, south)
    return None
