"""Word lists, limits and contracts that decide results.

Everything here is data. Change a value and published results change.
"""

from __future__ import annotations

# Text that counts as "no value" (compared after strip + lower).
NULL_TOKENS = ("", "?", "na", "n/a", "nd", "not documented", "none", "null", "nan")

# Words read as booleans.
TRUE_WORDS = ("yes", "y", "true", "1")
FALSE_WORDS = ("no", "n", "false", "0")

# Words folded to yes / no when a column is used in a model.
MODEL_YES_WORDS = ("true", "yes", "y")
MODEL_NO_WORDS = ("false", "no", "n")

# Words that make a profiled column binary.
PROFILE_BINARY_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1", "m", "f")

# Characters cut from the first word before it is compared.
LEADING_WORD_PUNCTUATION = ":-;,."

# Labels tried first, in this order, as the event of a binary outcome.
PREFERRED_EVENTS = ("true", "1", "yes", "y", "date", "death", "recurrence", "recurred")

# Column names with their own type rule in profiles.
IDENTIFIER_NAMES = ("patient_id", "histo_report", "notes")
DATE_NAMES = ("dob", "dod")

# Profile limits.
CATEGORICAL_MAX_LEVELS = 20
TOP_VALUES = 5
VALUE_COUNT_LIMIT = 100
SAMPLE_VALUES = 4
DATA_FILE_VALUE_LIMIT = 200
PREVIEW_ROWS = 10
HISTOGRAM_BINS = 12

# Model settings.
NEWTON_STEPS = 80
NEWTON_TOLERANCE = 1e-6
RIDGE = 1e-6
PROBABILITY_FLOOR = 1e-8
SIGMOID_CLIP = 35.0
COX_ETA_CLIP = 30.0
EXP_CLIP = 30.0
MIN_SPREAD = 1e-12
CONFIDENCE_Z = 1.96
MIN_CLASS_FOR_FOLDS = 3
MAX_FOLDS = 5
BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_SEED = 20260528
FOLD_SEED = 20260526
RISK_GROUPS = 10
LOESS_SPAN = 0.75
LOESS_POINTS = 101
LASSO_PENALTIES = 30
LASSO_MIN_RATIO = 0.02
LASSO_MIN_PENALTY = 1e-5
LASSO_SELECTED = 1e-5
LOW_CLASS_COUNT = 5

# Markers of a histology report, in reply order.
MARKER_ORDER = (
    "IDH1 or IDH2 mutated",
    "MGMT promoter methylation status",
    "EGFR amplification",
    "ATRX mutation",
    "Subtype",
)
ENTITY_KEY_PATTERN = r"(?i)(K\d+)"

# The published dataset, in contract order.
CANONICAL_VERSION = "1.0.0"
CANONICAL_FIELDS = (
    ("patient_id", "string"),
    ("source", "string"),
    ("contributor", "string"),
    ("dob", "date"),
    ("sex", "string"),
    ("presentation_date", "date"),
    ("age_at_presentation", "int"),
    ("neutrophils", "double"),
    ("lymphocytes", "double"),
    ("nlr", "double"),
    ("first_mri_date", "date"),
    ("tumour_side", "string"),
    ("tumour_lobe", "string"),
    ("periventricular", "boolean"),
    ("multifocal", "boolean"),
    ("resection_date", "date"),
    ("resection_type", "string"),
    ("postop_mri_date", "date"),
    ("five_ala", "boolean"),
    ("residual_enhancement", "boolean"),
    ("radiotherapy", "boolean"),
    ("tmz", "boolean"),
    ("recurrence_date", "date"),
    ("recurrence_type", "string"),
    ("recurrence_side", "string"),
    ("recurrence_lobe", "string"),
    ("recurrence_local", "boolean"),
    ("dod", "date"),
    ("qmc_local", "boolean"),
    ("referring_centre", "string"),
    ("histo_report", "string"),
    ("notes", "string"),
    ("data_quality_flags", "array<string>"),
)

# Time zone of run identities.
RUN_TIMEZONE = "America/New_York"
PIPELINE_VERSION = "0.1.0"
