"""Rule-based candidate cuts, kept as data and compiled to one filter."""

import re
from functools import reduce

from pyspark.sql import functions as F

#: Strict (min, max) of each feature by band.
BOUNDS = {
    "r": {"mu": (22.0, None), "re_arcsec": (1.6, 55.0), "axis_ratio": (0.17, None), "r_10": (0.353, 18.2), "r_25": (0.4, 32.1), "r_75": (2.16, 102.1), "r_90": (2.5, 145.1), "r_100": (2.8, 254.1), "r_fwhm": (0.4, 13.8), "mu_median": (0.34, 28.7), "mu_mean": (0.4, 65.1), "mu_max": (2.0, 6255.0), "total_flux": (55.0, None), "mag": (12.17, 25.7)},
    "g": {"mu": (22.51, None), "re_arcsec": (1.6, None), "axis_ratio": (0.17, None), "r_10": (0.4, 8.1), "r_25": (0.72, 15.0), "r_75": (2.17, 42.0), "r_90": (2.47, 54.0), "r_100": (2.8, 79.0), "r_fwhm": (0.417, 13.5), "mu_median": (0.0072, 0.8), "mu_mean": (0.017, 2.01), "mu_max": (0.066, 226.0), "total_flux": (1.77, None), "mag": (16.0, 26.5)},
    "i": {"mu": (22.0, 29.5), "re_arcsec": (1.6, 40.0), "axis_ratio": (0.17, None), "r_10": (0.4, 14.95), "r_25": (0.58, 25.5), "r_75": (2.1, 58.0), "r_90": (2.5, 77.0), "r_100": (2.7, 117.0), "r_fwhm": (0.4, 20.8), "mu_median": (0.445, 40.7), "mu_mean": (0.565, 100.8), "mu_max": (2.47, 4465.0), "total_flux": (66.0, None), "mag": (13.1, 26.0)},
}
#: Relations between features by band (ANSI SQL, valid in both engines).
RELATIONS = {
    "r": ["mu > 0.6155e0*mag + 11.3832e0", "mu > 1.35e0*mag - 6.4e0", "mu/r_75 < greatest(1.51e0*mag - 24.6e0, 3e0)", "ln(r_90/r_75) < 0.295e0*ln(r_100) - 0.13e0"],
    "g": ["mu > 0.7063e0*mag + 9.442e0", "mu > 4.1e0*mag - 78e0", "ln(r_100/r_90) < -1.2615e0*ln(mag) + 4.3e0", "ln(mag/r_75) < greatest(6.45e0*ln(mag) - 17.9e0, 0.75e0)"],
    "i": ["r_90/r_75 < 0.01e0*r_100 + 1.4e0", "r_100/r_90 < -0.085e0*mag + 3.3e0", "mag/r_75 < greatest(1.4e0*mag - 23e0, 2.5e0)", "r_90/r_75 < -0.07e0*mag + 2.97e0", "r_75/r_25 < 0.2e0*mag + 1e0", "r_75/r_25 < -1.1e0*mag + 30.5e0", "ln(r_100/r_75) < -2.7e0*ln(mag) + 9.05e0", "ln(r_75/r_25) < 0.8e0*ln(mag) - 0.81e0"],
}


def rule_sql(band, columns):
    """The whole rule set of a band as one SQL condition over the features present; sizes may be named with or without _arcsec."""
    long_names = "r_10_arcsec" in columns
    columns = [re.sub("^(r_(?:[0-9]+|fwhm))_arcsec$", r"\1", c) for c in columns]
    basic = [f"{c} {op} {v}e0" for c, (lo, hi) in BOUNDS[band].items() if c in columns for op, v in ((">", lo), ("<", hi)) if v is not None]
    text = " and ".join(basic + RELATIONS[band])
    return re.sub(r"\b(r_(?:[0-9]+|fwhm))\b", r"\1_arcsec", text) if long_names else text


def band_rules(df, bands=("r", "g", "i")):
    """Rows of these bands that pass all rules of their own band; other bands give none."""
    cases = [(F.col("band") == b) & F.coalesce(F.expr(rule_sql(b, df.columns)), F.lit(False)) for b in bands]
    return df.where(reduce(lambda a, b: a | b, cases))


def filter_keep_known(df, bands=("r", "g", "i")):
    """Rule survivors plus every known row (lsb = 1)."""
    passed = reduce(lambda a, b: a | b, [(F.col("band") == b) & F.coalesce(F.expr(rule_sql(b, df.columns)), F.lit(False)) for b in bands])
    return df.where(passed | (F.coalesce("lsb", F.lit(0.0)) == 1))


def filter_audit(df):
    """Rows removed per band, known and other."""
    passed = reduce(lambda a, b: a | b, [(F.col("band") == b) & F.coalesce(F.expr(rule_sql(b, df.columns)), F.lit(False)) for b in BOUNDS])
    known = F.coalesce("lsb", F.lit(0.0)) == 1
    count = lambda c: F.sum(c.cast("long"))
    return df.groupBy("band").agg(count(~passed & known).alias("removed_known"), count(~passed & ~known).alias("removed_other"))


def first_pass_cuts(df, mu_limit=22.0, re_limit=1.6):
    """Surface brightness, size and streak cuts of the first pass."""
    top = F.when(F.col("band") == "i", 46.0).otherwise(55.0)
    return df.where((F.col("mu") > mu_limit) & (F.col("re_arcsec") > re_limit) & (F.col("re_arcsec") < top) & ((F.col("axis_ratio") >= 0.17) | (F.col("n_pix") <= 1000)))


#: Relations of the extended first pass by band (ANSI SQL, valid in both engines).
EXTENDED = {
    "r": ["mu > 0.6060e0*mag + 11.6293e0", "mu_max < 1.2e10*exp(0.84e0*mag)", "r_90 < 12e0*r_10 + 20e0", "r_90 < 3e0*re_arcsec + 9e0", "mu_median < 4e0*re_arcsec + 4e0", "mu_median < 4e0*r_10 + 12e0", "mu_median < 0.3e0*r_90 + 15e0", "mu_max < 120e0*r_90 + 650e0"],
    "g": ["mu > 0.6981e0*mag + 8.7072e0", "mu_max < -20e0*mag + 500e0", "r_90 > 4.3025e0*r_10 - 1.5e0", "r_90 < 1.9e0*re_arcsec + 3.5e0", "mu_median < 0.15e0*re_arcsec + 3.3e0", "mu_median < 3e0*r_10 + 1e0", "mu_median < 0.08e0*r_90 + 3.5e0", "mu_max < 14e0*r_90 + 20e0"],
    "i": ["mu > 0.5864e0*mag + 11.9705e0", "mu_max < 5593.3712e0/(1e0 + exp(0.9174e0*(mag - 16.1930e0))) + 200e0", "r_90 < 12e0*r_10 + 3e0", "r_90 < 3e0*re_arcsec + 3.8e0", "mu_median < 2e0*re_arcsec + 8e0", "mu_median < 4e0*r_10 + 12e0", "mu_median < 4e0*r_90 + 9.5e0", "mu_max < 35e0*r_90 + 100e0", "r_25 < 2.5e0*r_10 + 1e0"],
}


def first_pass_extended(df, mu_limit=22.0, re_limit=1.6):
    """The first pass and its optional relations between features; bands without a set give none."""
    long_names = "r_10_arcsec" in df.columns
    text = lambda b: " and ".join(EXTENDED[b])
    named = lambda b: re.sub(r"\b(r_[0-9]+)\b", r"\1_arcsec", text(b)) if long_names else text(b)
    passed = reduce(lambda a, b: a | b, [(F.col("band") == b) & F.coalesce(F.expr(named(b)), F.lit(False)) for b in EXTENDED])
    return first_pass_cuts(df, mu_limit, re_limit).where(passed)
