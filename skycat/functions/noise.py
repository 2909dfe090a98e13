"""Noise that depends on nothing but the pixel: the same on every run, engine and cluster."""

from pyspark.sql import functions as F

#: A linear congruential step modulo 2^31.
FACTOR, STEP, MODULUS = 1103515245, 12345, 2147483648


def hashed(*ids, seed=1):
    """A whole number in [0, 2^31) from whole numbers that are not negative; the seed may be a column."""
    seed = seed if not isinstance(seed, int) else F.lit(seed)
    h = seed.cast("long") % MODULUS
    for c in (*ids, F.lit(0), F.lit(0)):
        h = (h * FACTOR + c.cast("long") * STEP + STEP) % MODULUS
        # the low bits of such a step are poor: mix the high ones in
        h = h.bitwiseXOR(F.shiftright(h, 15))
    return h


def normal_noise(*ids, seed=1):
    """A standard normal deviate from two hashes."""
    seed = seed if not isinstance(seed, int) else F.lit(seed)
    unit = lambda s: (hashed(*ids, seed=s) + 0.5) / float(MODULUS)
    return F.sqrt(-2 * F.ln(unit(2 * seed))) * F.cos(2 * 3.141592653589793 * unit(2 * seed + 1))
