"""Default parameters; every operator takes them as arguments."""

# Defaults of the method.
SCALE_FACTOR = 1e-4
VALID_RANGE = (0.0, 1.0)
VALID_THRESHOLD = 0.0
AUTO_SCALE_ABOVE = 10.0
COMPOSITE_TAG = "daily_nanmedian_reflectance_gt0_le1_v1"
DEFAULT_HOUR, DEFAULT_MINUTE = 10, 30
CFAR_SCALES = ((11, 3), (25, 9), (51, 21))
STD_OFFSET = 0.005
ALPHA, NULL_TRIM, REFERENCE_QUANTILE = 0.01, 0.001, 0.95
MIN_SAMPLES = 1000
RATIO_EPSILON, JOINT_FLOOR = 1e-12, 1e-12
ALPHA_CANDIDATES = (1e-2, 5e-3, 1e-3, 5e-4, 1e-4, 5e-5, 1e-5)
TARGET_FAR, DATE_QUANTILE = 0.01, 0.95
SAMPLES_PER_FRAME, MIN_VALID_FRACTION, MIN_STABLE_PIXELS, MIN_VALID_PIXELS = 12_000, 0.95, 1000, 100
MIN_FRAMES = 4
TRANSITION_MULTIPLIER, GUARD_FRAMES, MIN_STABLE_OBSERVATIONS, MIN_STABLE_DAYS, MIN_STATE_CHANGE = 3.0, 1, 3, 30, 1e-4
MAD_SCALE = 1.4826
LOG_VARIANCE_RANGE = (-7.0, 5.0)
MIN_REGION, PIXEL_SIZE_M = 20, 20.0
DISPLAY_RANGE = (1.0, 3.0)
QUANT_RESIDUAL, QUANT_BYTE = 10_000.0, 100.0
PERIOD_DAYS, HARMONICS = 365.25, 3
DECISION_RULE = "joint_null_calibrated_d2_and_cfar_or_sam"
PROFILE_VERSION = 4
