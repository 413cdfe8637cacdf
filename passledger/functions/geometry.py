"""Vector and orbit geometry as Column expressions (SI units, radians inside)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed of light, WGS-84 ellipsoid, Earth rotation.
SPEED_OF_LIGHT = 299792458.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RATE = 7.292115146706979e-5
ERA_AT_2000 = 0.7790572732640
ERA_PER_DAY = 1.00273781191135448
UNIX_AT_J2000 = 946728000.0

Vector = Sequence[Column]


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a: Vector, b: Vector) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def finite(value: Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    return (
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    )


def doppler(range_rate: Column, centre_hz: Column, bias_hz: Column | float = 0.0) -> Column:
    """Receding object, negative shift."""
    bias = bias_hz if isinstance(bias_hz, Column) else F.lit(float(bias_hz))
    return -range_rate * centre_hz / F.lit(SPEED_OF_LIGHT) + bias


def range_and_rate(
    position: Vector, velocity: Vector, station: Vector, station_velocity: Vector
) -> tuple[Column, Column]:
    dr, dv = minus(position, station), minus(velocity, station_velocity)
    distance = norm(dr)
    return distance, dot(dv, dr) / distance


def range_rate_partials(
    position: Vector, velocity: Vector, station: Vector, station_velocity: Vector
) -> list[Column]:
    """Partials of the range rate by position, then by velocity."""
    dr, dv = minus(position, station), minus(velocity, station_velocity)
    distance = norm(dr)
    rate = dot(dv, dr) / distance
    unit = [x / distance for x in dr]
    return [(v - rate * u) / distance for v, u in zip(dv, unit)] + unit


def rtn_error(error: Vector, position: Vector, velocity: Vector) -> list[Column]:
    """Error along the radial, tangential and normal axes of the reference.

    Null where the reference gives no frame (zero radius or zero momentum).
    """
    momentum = cross(position, velocity)
    r, h = norm(position), norm(momentum)
    usable = (r > 0) & (h > 0)
    # A divisor without a frame is null, so nothing stands in a branch, where Spark would
    # compute each shared part again for every place it is used in.
    r, h = F.when(usable, r), F.when(usable, h)
    radial = [x / r for x in position]
    normal = [x / h for x in momentum]
    tangent = cross(normal, radial)
    return [dot(error, axis) for axis in (radial, tangent, normal)]


def geodetic_to_ecef(latitude: Column, longitude: Column, altitude: Column) -> list[Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    lat, lon = F.radians(latitude), F.radians(longitude)
    bend = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [
        (bend + altitude) * F.cos(lat) * F.cos(lon),
        (bend + altitude) * F.cos(lat) * F.sin(lon),
        (bend * (1 - e2) + altitude) * F.sin(lat),
    ]


def earth_rotation_angle(unix_s: Column) -> Column:
    """Earth rotation angle in radians, UT1 taken as UTC."""
    days = (unix_s - UNIX_AT_J2000) / 86400.0
    turns = F.lit(ERA_AT_2000) + days * ERA_PER_DAY
    return (turns - F.floor(turns)) * (2 * 3.141592653589793)


def station_inertial(ecef: Vector, unix_s: Column) -> tuple[list[Column], list[Column]]:
    """Station position and velocity after the rotation about the pole.

    Polar motion, nutation and precession are left out.
    """
    angle = earth_rotation_angle(unix_s)
    c, s = F.cos(angle), F.sin(angle)
    x, y = c * ecef[0] - s * ecef[1], s * ecef[0] + c * ecef[1]
    return [x, y, ecef[2]], [-EARTH_RATE * y, EARTH_RATE * x, F.lit(0.0)]


def wrap_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def equinoctial(
    eccentricity: Column,
    inclination: Column,
    raan: Column,
    perigee: Column,
    mean_anomaly: Column,
) -> dict[str, Column]:
    """Mean equinoctial elements from classical angles in degrees."""
    along = F.radians(raan + perigee)
    tilt = F.tan(F.radians(inclination) * 0.5)
    return {
        "f": eccentricity * F.cos(along),
        "g": eccentricity * F.sin(along),
        "h": tilt * F.cos(F.radians(raan)),
        "k": tilt * F.sin(F.radians(raan)),
        "longitude_deg": wrap_degrees(raan + perigee + mean_anomaly),
    }


def classical(
    f: Column, g: Column, h: Column, k: Column, longitude_deg: Column
) -> dict[str, Column]:
    """Classical angles in degrees; null where the elements are not valid."""
    raan = F.degrees(F.atan2(k, h))
    perigee_longitude = F.degrees(F.atan2(g, f))
    inclination = 2.0 * F.degrees(F.atan(F.hypot(h, k)))
    valid = (F.hypot(f, g) < 1.0) & (inclination < 180.0)
    for value in (f, g, h, k, longitude_deg):
        valid = valid & finite(value)
    return {
        name: F.when(valid, value)
        for name, value in {
            "eccentricity": F.hypot(f, g),
            "inclination_deg": inclination,
            "raan_deg": wrap_degrees(raan),
            "perigee_deg": wrap_degrees(perigee_longitude - raan),
            "mean_anomaly_deg": wrap_degrees(longitude_deg - perigee_longitude),
        }.items()
    }
