"""Fixed values of the data model: physical constants, instrument figures, thresholds, flag bits."""

import math

# Cosmology and angles.
C_KM_S, H0 = 299792.458, 70.0
ARCSEC_TO_RAD = math.pi / (180.0 * 3600.0)
RAD_TO_ARCSEC = 1.0 / ARCSEC_TO_RAD
OMEGA_M = 0.3
# Instrument and extraction.
PIXEL_SCALE = 0.04
PSF_FWHM_ARCSEC = 0.09
PSF_FWHM_PIX = PSF_FWHM_ARCSEC / PIXEL_SCALE
DRIZZLE_NOISE_CORR = 1.4
SKY_ANNULUS_FACTOR = 10.0
FLUX_FACTOR = {"f300": 5.99e-17, "f450": 8.8e-18, "f606": 1.89e-18, "f814": 2.45e-18}
REFERENCE_BAND, OTHER_BANDS = "f450", ("f814", "f300", "f606")
MATCH_RADIUS_PIX, MATCH_RADIUS_ARCSEC = 3.0, 1.5
MIN_BANDS, EDGE_MARGIN_PIX, STAR_RADIUS_PIX = 3, 50.0, 30.0
CHIP_BOX = (127.0, 2175.0, 184.0, 2232.0)
FIELD_CENTRE = (189.228621, 62.212572)
# Redshift range, selection, physical sizes.
Z_MIN, Z_MAX = 0.05, 6.0
Z_CUT = (0.3, 2.0)
SIZE_KPC = (0.3, 15.0)
MIN_PER_TYPE, MIN_PER_TYPE_COMPARE, MIN_PER_TYPE_OVERVIEW = 30, 9, 20
CATASTROPHIC = 0.15
# Quality bits.
FLAGS = {
    "BLENDED": 1, "EDGE": 2, "SATURATED": 4, "LOW_SNR": 8, "CROWDED": 16, "BAD_PHOTOZ": 32, "PSF_LIKE": 64, "MASKED": 128,
    "UNRELIABLE_Z": 256, "VERY_LOW_SNR": 512, "HIGH_Z_UNRELIABLE": 1024, "CATASTROPHIC_PHOTOZ": 2048,
}
STRICT_MASK = 4095
MODERATE_MASK = FLAGS["BAD_PHOTOZ"] | FLAGS["PSF_LIKE"] | FLAGS["MASKED"]
LENIENT_MASK = FLAGS["PSF_LIKE"] | FLAGS["MASKED"]
# Names and groups of the spectral templates.
TEMPLATES = ["elliptical", "S0", "Sa", "Sb", "sbt1", "sbt2", "sbt3", "sbt4", "sbt5", "sbt6"]
SED_GROUP = {
    "elliptical": "elliptical", "S0": "elliptical", "Sa": "spiral", "Sb": "spiral", "sbt1": "spiral", "sbt2": "spiral",
    "sbt3": "irregular", "sbt4": "irregular", "sbt5": "irregular", "sbt6": "merger",
}
LOW_DUST, HIGH_DUST = ("sbt1", "sbt2"), ("sbt3", "sbt4", "sbt5", "sbt6")
AV_GRID = [0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0]
# Filter curves, order U, B, V, I; photo-z pivots and widths, and the simple top-hats.
BANDS = ["U", "B", "V", "I"]
PIVOT, WIDTH = [2984.0, 4556.0, 6001.0, 8002.0], [895.0, 789.0, 1775.0, 1642.0]
SIMPLE_CENTRE, SIMPLE_WIDTH = [3000.0, 4500.0, 6060.0, 8140.0], [1521.0, 1501.0, 951.0, 766.0]
# Intergalactic absorption (lines in A with their coefficients and power; edge in A with coefficient, powers and cap).
IGM_LINES, IGM_POWER = ((1216.0, 0.0036), (1026.0, 0.0017), (972.5, 0.0012)), 3.46
IGM_EDGE = (912.0, 0.25, 3.0, 0.46, 30.0)
# Starburst attenuation, by inverse powers of the wavelength in micrometres: blue of 0.63, red of it, scale, ratio to B - V.
DUST_BLUE, DUST_RED, DUST_SCALE, DUST_RATIO = (-2.156, 1.509, -0.198, 0.011), (-1.857, 1.040), 2.659, 4.05
DUST_RANGE = (0.12, 0.63, 2.2)
