"""Geographic Column expressions: local frames, central angles, WGS84 distance, ENU."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: The WGS84 ellipsoid, the mean radius of the fallback, and the origin of the evaluation frame.
WGS84_A_M, WGS84_F = 6_378_137.0, 1.0 / 298.257223563
WGS84_B_M = WGS84_A_M * (1.0 - WGS84_F)
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
MEAN_RADIUS_KM = 6371.0088
ENU_ORIGIN = (35.4, -117.956)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def wrapped(angle: Column) -> Column:
    """An angle in radians brought to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def circular_mean_longitude(lon: Column) -> Column:
    """Aggregate: mean direction of longitudes in degrees."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(lon))), F.sum(F.cos(F.radians(lon)))))


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    """East and north metres in the equirectangular frame about (lat0, lon0)."""
    x = radius * math.cos(math.radians(lat0)) * wrapped(F.radians(lon) - math.radians(lon0))
    return x, radius * (F.radians(lat) - math.radians(lat0))


def local_ll(x: Column, y: Column, lat0: float, lon0: float, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    """Inverse of local_xy: latitude and wrapped longitude in degrees."""
    lon = wrapped(x / (radius * math.cos(math.radians(lat0))) + math.radians(lon0))
    return F.degrees(y / radius + math.radians(lat0)), F.degrees(lon)


def _angle(phi1: Column, phi2: Column, dlambda: Column) -> tuple[Column, Column]:
    """(cosine clipped to [-1, 1], sine) of the central angle."""
    u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi1) * F.sin(phi2) + F.cos(phi1) * F.cos(phi2) * F.cos(dlambda)))
    return u, F.sqrt(F.greatest(F.lit(0.0), 1.0 - u * u))


def great_circle_delta(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle in radians between geographic points."""
    u, s = _angle(F.radians(lat1), F.radians(lat2), wrapped(F.radians(lon1 - lon2)))
    return F.atan2(s, u)


def _frame(x: Column, y: Column, lat0: float, lon0: float, radius: float) -> tuple[Column, Column]:
    return math.radians(lat0) + y / radius, math.radians(lon0) + x / (radius * math.cos(math.radians(lat0)))


def spherical_delta(x: Column, y: Column, sx: Column, sy: Column, lat0: float, lon0: float, radius: float = EARTH_RADIUS_M) -> Column:
    """Central angle between points of the local frame."""
    (phi, lam), (phis, lams) = _frame(x, y, lat0, lon0, radius), _frame(sx, sy, lat0, lon0, radius)
    u, s = _angle(phi, phis, wrapped(lam - lams))
    return F.atan2(s, u)


def spherical_delta_gradient(x: Column, y: Column, sx: Column, sy: Column, lat0: float, lon0: float, radius: float = EARTH_RADIUS_M) -> Column:
    """struct(delta, dx, dy): central angle and its derivatives by the first point; a central difference of 1 m where both coincide."""
    (phi, lam), (phis, lams) = _frame(x, y, lat0, lon0, radius), _frame(sx, sy, lat0, lon0, radius)
    dl = wrapped(lam - lams)
    u, s = _angle(phi, phis, dl)
    by_phi = F.cos(phi) * F.sin(phis) - F.sin(phi) * F.cos(phis) * F.cos(dl)
    by_lam = -F.cos(phi) * F.cos(phis) * F.sin(dl)
    at = lambda a, b: spherical_delta(a, b, sx, sy, lat0, lon0, radius)
    apart = s > 1e-10
    return F.struct(
        F.atan2(s, u).alias("delta"),
        F.when(apart, -by_lam / s / (radius * math.cos(math.radians(lat0)))).otherwise((at(x + 1.0, y) - at(x - 1.0, y)) / 2.0).alias("dx"),
        F.when(apart, -by_phi / s / radius).otherwise((at(x, y + 1.0) - at(x, y - 1.0)) / 2.0).alias("dy"),
    )


#: Vertical conventions of catalogs: sign, and whether the reference depth is added.
VERTICAL = {"positive_depth": (1.0, False), "negative_depth": (-1.0, False), "positive_depth_plus_z0": (1.0, True)}


def depth_to_internal(depth_km: Column, vertical: str = "positive_depth", z0: float = 0.0) -> Column:
    sign, shifted = VERTICAL[vertical]
    return sign * depth_km * 1000.0 + (z0 if shifted else 0.0)


def internal_to_depth(z: Column, vertical: str = "positive_depth", z0: float = 0.0) -> Column:
    sign, shifted = VERTICAL[vertical]
    return sign * (z - (z0 if shifted else 0.0)) / 1000.0


def wgs84_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 100) -> Column:
    """Vincenty's inverse distance; great-circle distance where it does not converge in the given rounds.

    The fixed point is a native fold over a struct, which passes its state on once it has converged.
    """
    dlon = wrapped(F.radians(lon2 - lon1))
    reduced = lambda lat: F.atan((1.0 - WGS84_F) * F.tan(F.radians(lat)))
    given = F.struct(F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"), dlon.alias("l"))

    def solve(g: Column) -> Column:
        zero = F.lit(0.0)
        start = F.struct(g["l"].alias("lam"), zero.alias("sigma"), zero.alias("ss"), F.lit(1.0).alias("cs"), F.lit(1.0).alias("c2a"), zero.alias("c2m"), F.lit(False).alias("done"))

        def step(state: Column, _: Column) -> Column:
            sl, cl = F.sin(state["lam"]), F.cos(state["lam"])
            ss = F.hypot(g["c2"] * sl, g["c1"] * g["s2"] - g["s1"] * g["c2"] * cl)
            cs = g["s1"] * g["s2"] + g["c1"] * g["c2"] * cl
            first = F.struct(ss.alias("ss"), cs.alias("cs"), F.atan2(ss, cs).alias("sigma"), F.when(ss == 0, 0.0).otherwise(g["c1"] * g["c2"] * sl / ss).alias("sa"))

            def rest(a: Column) -> Column:
                c2a = 1.0 - a["sa"] * a["sa"]
                c2m = F.when(c2a > 2.220446049250313e-16, a["cs"] - 2.0 * g["s1"] * g["s2"] / c2a).otherwise(0.0)
                c = WGS84_F / 16.0 * c2a * (4.0 + WGS84_F * (4.0 - 3.0 * c2a))
                lam = g["l"] + (1.0 - c) * WGS84_F * a["sa"] * (a["sigma"] + c * a["ss"] * (c2m + c * a["cs"] * (2.0 * c2m * c2m - 1.0)))
                done = (a["ss"] == 0) | (F.abs(lam - state["lam"]) <= 1e-12)
                return F.struct(lam.alias("lam"), a["sigma"].alias("sigma"), a["ss"].alias("ss"), a["cs"].alias("cs"), c2a.alias("c2a"), c2m.alias("c2m"), done.alias("done"))

            return F.when(state["done"], state).otherwise(let(first, rest))

        def finish(v: Column) -> Column:
            u2 = v["c2a"] * (WGS84_A_M**2 - WGS84_B_M**2) / WGS84_B_M**2
            big_a = 1.0 + u2 / 16384.0 * (4096.0 + u2 * (-768.0 + u2 * (320.0 - 175.0 * u2)))
            big_b = u2 / 1024.0 * (256.0 + u2 * (-128.0 + u2 * (74.0 - 47.0 * u2)))
            m, ss, cs = v["c2m"], v["ss"], v["cs"]
            ds = big_b * ss * (m + 0.25 * big_b * (cs * (2.0 * m * m - 1.0) - big_b / 6.0 * m * (4.0 * ss * ss - 3.0) * (4.0 * m * m - 3.0)))
            phi1, phi2 = F.radians(lat1), F.radians(lat2)
            chord = F.pow(F.sin(0.5 * (phi2 - phi1)), 2.0) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(0.5 * g["l"]), 2.0)
            return F.when(ss == 0, 0.0).when(v["done"], WGS84_B_M * big_a * (v["sigma"] - ds) / 1000.0).otherwise(MEAN_RADIUS_KM * 2.0 * F.asin(F.sqrt(chord)))

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step), finish)

    return let(given, solve)


def vincenty_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 100) -> np.ndarray:
    """wgs84_distance_km over arrays; rounds go on only for pairs that have not converged."""
    sine = lambda lat: np.sin(np.arctan((1.0 - WGS84_F) * np.tan(np.radians(lat))))
    cosine = lambda lat: np.cos(np.arctan((1.0 - WGS84_F) * np.tan(np.radians(lat))))
    given = np.radians(lon2 - lon1)
    given = np.arctan2(np.sin(given), np.cos(given))
    phi1, phi2 = np.radians(lat1), np.radians(lat2)
    chord = np.sin(0.5 * (phi2 - phi1)) ** 2 + np.cos(phi1) * np.cos(phi2) * np.sin(0.5 * given) ** 2
    out = MEAN_RADIUS_KM * 2.0 * np.arcsin(np.sqrt(np.minimum(chord, 1.0)))
    left, lam, all1, all2 = np.arange(len(given)), given, (sine(lat1), cosine(lat1)), (sine(lat2), cosine(lat2))
    for _ in range(rounds):
        if not len(left):
            break
        (s1, c1), (s2, c2), l0 = (x[left] for x in all1), (x[left] for x in all2), given[left]
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(c1 * c2 * sl, ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1.0 - sa * sa
        m = np.where(c2a > 2.220446049250313e-16, cs - 2.0 * s1 * s2 / np.where(c2a > 0, c2a, 1.0), 0.0)
        c = WGS84_F / 16.0 * c2a * (4.0 + WGS84_F * (4.0 - 3.0 * c2a))
        new = l0 + (1.0 - c) * WGS84_F * sa * (sigma + c * ss * (m + c * cs * (2.0 * m * m - 1.0)))
        done = (ss == 0) | (np.abs(new - lam) <= 1e-12)
        u2 = c2a * (WGS84_A_M**2 - WGS84_B_M**2) / WGS84_B_M**2
        a = 1.0 + u2 / 16384.0 * (4096.0 + u2 * (-768.0 + u2 * (320.0 - 175.0 * u2)))
        b = u2 / 1024.0 * (256.0 + u2 * (-128.0 + u2 * (74.0 - 47.0 * u2)))
        ds = b * ss * (m + 0.25 * b * (cs * (2.0 * m * m - 1.0) - b / 6.0 * m * (4.0 * ss * ss - 3.0) * (4.0 * m * m - 3.0)))
        km = np.where(ss == 0, 0.0, WGS84_B_M * a * (sigma - ds) / 1000.0)
        out[left[done]] = km[done]
        left, lam = left[~done], new[~done]
    return out


def ecef(lat: Column, lon: Column, height_m: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of WGS84 geodetic points."""
    phi, lam = F.radians(lat), F.radians(lon)
    prime = WGS84_A_M / F.sqrt(1.0 - WGS84_E2 * F.sin(phi) * F.sin(phi))
    return (prime + height_m) * F.cos(phi) * F.cos(lam), (prime + height_m) * F.cos(phi) * F.sin(lam), (prime * (1.0 - WGS84_E2) + height_m) * F.sin(phi)


def enu_km(lat: Column, lon: Column, depth_km: Column, origin: tuple[float, float] = ENU_ORIGIN) -> tuple[Column, Column, Column]:
    """East, north and down in kilometres about an origin at sea level."""
    phi0, lam0 = map(math.radians, origin)
    sp, cp, sl, cl = math.sin(phi0), math.cos(phi0), math.sin(lam0), math.cos(lam0)
    prime = WGS84_A_M / math.sqrt(1.0 - WGS84_E2 * sp * sp)
    x, y, z = ecef(lat, lon, -1000.0 * depth_km)
    dx, dy, dz = x - prime * cp * cl, y - prime * cp * sl, z - prime * (1.0 - WGS84_E2) * sp
    return (cl * dy - sl * dx) / 1000.0, (cp * dz - sp * cl * dx - sp * sl * dy) / 1000.0, -(cp * cl * dx + cp * sl * dy + sp * dz) / 1000.0
