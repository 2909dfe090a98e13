"""Magnitudes, sizes, star models and feature ratios as column expressions."""

from functools import reduce

from pyspark.sql import functions as F


def photometry(df, pixel_scale, zero_point):
    """Adds arcsecond radii, axis_ratio, mag and mu; an exact zero under a logarithm drops the row."""
    a, b, flux, re = F.col("A"), F.col("B"), F.col("total_flux"), F.col("R_e") * pixel_scale
    sizes = {c.lower() + "_arcsec" if c[0] == "R" else f"{c}_arcsec": F.col(c) * pixel_scale for c in ("R_fwhm", "A", "B") if c in df.columns} | {f"r_{n}_arcsec": F.col(f"R{n}") * pixel_scale for n in (10, 25, 75, 90, 100) if f"R{n}" in df.columns}
    mag = -2.5 * F.log10(F.when(flux > 0, flux)) + zero_point
    area = F.when((a > 0) & (b > 0), 3.141592653589793 * re * re * b / F.when(a > 0, a)).otherwise(3.141592653589793 * re * re)
    out = df.withColumns(sizes | {"re_arcsec": re, "axis_ratio": F.try_divide(F.least(a, b), F.greatest(a, b)), "mag": mag, "mu": mag + 0.752 + 2.5 * F.log10(F.when(area > 0, area))})
    return out.where((F.coalesce(flux, F.lit(1.0)) != 0) & (F.coalesce(re, F.lit(1.0)) != 0))


def rescale_flux(flux, zp_from, zp_to):
    return flux * F.pow(F.lit(10.0), F.lit(-0.4 * (zp_from - zp_to)))


#: Fixed values of the star model: area and spike length a, b, c, d, break; thickness.
STAR_AREA = (7.21366775e5, 0.613780414, 126.614049, 8.26137977e5, 9.49)
STAR_SPIKE = (1363.06644, 0.345428885, 3.30158864, 1090.29943, 15.29)


def _decay(x, a, b, c, d, cut):
    return F.greatest(F.lit(0.0), F.when(x < cut, F.lit(a)).otherwise(F.lit(d)) * F.exp(-b * (x - 6.1368)) + c)


def star_model(gmag):
    """(R_ISO, spike length, thickness) of a star of this magnitude."""
    # fixed values of the thickness: break, slopes before and after it, value at the break
    thick = F.greatest(F.lit(0.0), F.when(gmag <= 15.6, 1.5 - 0.5 * (gmag - 15.6)).otherwise(1.5 - 0.05 * (gmag - 15.6)))
    return F.sqrt(_decay(gmag, *STAR_AREA) / 3.141592653589793), _decay(gmag, *STAR_SPIKE), thick


def star_model_power(gmag, a, b, c, top):
    """The second model: a power law of the magnitude, never below zero, and never above ``top``."""
    return F.least(F.greatest(F.pow(a * gmag, F.lit(-float(b))) + c, F.lit(0.0)), F.lit(float(top)))


def ratio_feature(a, b, log=False):
    ratio = F.try_divide(a, b)
    return F.ln(F.when(ratio > 0, ratio)) if log else ratio


def separator_value(kind, x, p):
    """Separator curves over x; p holds the parameters in order."""
    curves = {
        "linear": lambda: F.greatest(p[0] * x + p[1], F.lit(0.0)),
        "quadratic": lambda: p[0] * x * x + p[1] * x + p[2],
        "cubic": lambda: reduce(lambda s, c: s * x + c, p[1:], F.lit(float(p[0]))),
        "exponential": lambda: p[0] * F.exp(p[1] * x) + p[2],
        "modified_exponential": lambda: p[0] * F.exp(p[1] * F.pow(x, F.lit(float(p[2])))) + p[3],
        "sigmoid_exponential": lambda: p[0] * F.exp(p[1] * x) / (1 + F.exp(-p[2] * (x - p[3]))) + p[4],
        "steep_fall": lambda: p[0] / (1 + F.exp(p[1] * (x - p[2]))) + p[3],
        "exp_poly": lambda: F.exp(p[0] * x * x + p[1] * x + p[2]),
    }
    return curves[kind]()


def smooth_label(y, alpha):
    return y * (1 - alpha) + 0.5 * alpha


def peak_offset(xpeak, ypeak, xmin, xmax, ymin, ymax):
    return F.hypot(xpeak - F.rint((xmin + xmax) / 2), ypeak - F.rint((ymin + ymax) / 2))


def rebin_header(cd, crpix, bin_size):
    return cd * bin_size, (crpix - 0.5) / bin_size + 0.5


def clean_pixels(value, band="r"):
    floor = -2 if band == "i" else -5
    return F.when(value.isNull() | F.isnan(value) | (value >= 65536) | (value < floor), 0.0).otherwise(value)


def field_background_scale(brightest):
    """(bright flag, factor, box) by the brightest star."""
    factor = F.when(brightest < 7, 30).when(brightest < 9, 10).otherwise(5)
    return brightest < 9, factor, F.when(brightest <= 8, 50).otherwise(100)
