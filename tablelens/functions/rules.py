"""Thresholds and weights of the catalogue's rules."""

# ---------------------------------------------------------------------------
# Numbers that must equal the reference's for the same
# results, in the order its rules use them.
# Column roles: distinct-share bounds for id / categorical decisions.
BOOLEAN_MAX_DISTINCT = 2
NUMERIC_ID_MIN_SHARE = 0.8
TEXT_ID_MIN_SHARE = 0.5
CATEGORICAL_MAX_SHARE = 0.15
# Health score: weights, penalty factors, size reference and grade cut-offs.
HEALTH_COMPLETENESS = 40
HEALTH_MISSING_FACTOR = 2
HEALTH_UNIQUENESS = 30
HEALTH_DUPLICATE_FACTOR = 3
HEALTH_DIVERSITY_STEP = 5
HEALTH_DIVERSITY_MAX = 15
HEALTH_DIVERSITY_MIN_COLUMNS = 4
HEALTH_SIZE = 15
HEALTH_SIZE_ROWS = 500
GRADES = [(85, "A"), (70, "B"), (55, "C"), (40, "D")]  # else "F"
# Outliers: IQR fence factor, z-score cut, least values per column.
IQR_FACTOR = 1.5
Z_CUT = 3
OUTLIER_MIN_VALUES = 5
EPSILON = 1e-9
# Risks: missing %, duplicate %, outlier share %, max/mean ratio, leader share.
RISK_MISSING_PCT = 5
RISK_DUPLICATE_PCT = 1
RISK_OUTLIER_PCT = 3
RISK_MAX_TO_MEAN = 10
RISK_LEADER_SHARE = 0.5
# End of fixed values.
# ---------------------------------------------------------------------------

# ---------------------------------------------------------------------------
# Sizes of the catalogue's outputs, as the reference shows them.
TOP_BAR = 15              # bars in a top-N bar chart
TOP_FREQUENCY = 15        # values in a frequency chart
TOP_SHARE = 10            # slices in a share (pie) chart
TOP_FUNNEL = 8            # stages in a funnel
TOP_PARETO = 15           # bars in a Pareto chart
TOP_BOX = 8               # categories in a box chart
TOP_VIOLIN = 6            # categories in a violin chart
MANY_LABELS = 1_000_000   # categories from which charts find the top ones by buckets
HISTOGRAM_BINS = 30
ROLLING_MONTHS = 3
SAMPLE_ROWS = 2000        # points in a scatter chart
SAMPLE_SEED = 42
MAX_COLORS = 12           # colours kept in a scatter chart
PIE_MAX_DISTINCT = 12     # a share chart is drawn only up to this many values
MAX_CHARTS = 8
MAX_KPIS = 8
OUTLIER_MAX_COLUMNS = 10
UNDERSERVED_MIN_COUNT = 3
SEASONAL_MIN_NAMES = 4
BEST_MONTH_MIN_MONTHS = 3
TRAJECTORY_MIN_MONTHS = 4
DUPLICATE_LISTING = 50
PREVIEW_ROWS = 10
PROFILE_JSON_COLUMNS = 20
MAX_FILTERS = 5
FILTER_MAX_VALUES = 100
MAX_RECOMMENDATIONS = 6
# End of fixed values.
# ---------------------------------------------------------------------------

# Density curves (own choice): bins under the kernel, places of the curve.
DENSITY_BINS = 200
DENSITY_POINTS = 100
