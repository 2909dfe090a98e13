"""Spherical geometry as column expressions; degrees in, arcseconds for separations."""

from pyspark.sql import functions as F

PIXEL_SCALE = 5.160234650248e-05  # fixed value: degrees per pixel of a tile
CENTRE = 5000.0  # fixed value: reference pixel
SIDE = 10000


def unit_vector(ra, dec):
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord(arcsec):
    return 2 * F.sin(F.radians(arcsec / 3600.0) / 2)


def ang_sep_arcsec(ra1, dec1, ra2, dec2):
    """Haversine separation, exact down to micro-arcseconds."""
    s1, s2 = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    h = s1 * s1 + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * s2 * s2
    return 2 * F.degrees(F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * 3600


def tan_project(ra, dec, ra0, dec0, origin=1):
    """Gnomonic pixel position; NULL on the far hemisphere."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi, eta = F.cos(d) * F.sin(a) / c, (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / c
    place = lambda v, sign: F.when(c > 0, CENTRE + sign * F.degrees(v) / PIXEL_SCALE - (1 - origin))
    return place(xi, -1), place(eta, 1)


def tan_deproject(x, y, ra0, dec0, origin=1):
    xi, eta = -F.radians((x + (1 - origin) - CENTRE) * PIXEL_SCALE), F.radians((y + (1 - origin) - CENTRE) * PIXEL_SCALE)
    d0, rho = F.radians(dec0), F.sqrt(xi * xi + eta * eta)
    c = F.atan(rho)
    dec = F.when(rho == 0, dec0).otherwise(F.degrees(F.asin(F.cos(c) * F.sin(d0) + eta * F.sin(c) * F.cos(d0) / F.when(rho == 0, 1.0).otherwise(rho))))
    ra = ra0 + F.degrees(F.atan2(xi * F.sin(c), rho * F.cos(d0) * F.cos(c) - eta * F.sin(d0) * F.sin(c)))
    return F.pmod(ra, F.lit(360.0)), dec


def in_footprint(x, y):
    """Whether a 1-based pixel lies on the tile."""
    return F.coalesce(x.between(0.5, SIDE + 0.5) & y.between(0.5, SIDE + 0.5), F.lit(False))


def sky_median(df, keys, ra="ra", dec="dec"):
    """Median per axis; a group that spans more than 180 degrees is unwrapped first."""
    wide = F.max(ra) - F.min(ra) > 180
    shifted = F.percentile(F.when(F.col(ra) < 180, F.col(ra) + 360).otherwise(F.col(ra)), 0.5)
    median = F.when(wide, F.pmod(shifted, F.lit(360.0))).otherwise(F.percentile(ra, 0.5))
    return df.groupBy(*keys).agg(median.alias("ra"), F.percentile(dec, 0.5).alias("dec"))
