"""Schemas, code tables, layouts and rule constants.

Everything in the "fixed values" blocks must equal the reference application's
constants for results to match; they are data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Vital-sign medians, valid ranges and model column order.
# ---------------------------------------------------------------------------
MEDIAN_VITALS = {
    "Age": 45.0,
    "Pulse": 82.0,
    "HR": 82.0,
    "SBP": 130.0,
    "DBP": 78.0,
    "Resp": 18.0,
    "RR": 18.0,
    "O2Sat": 98.0,
    "Temp": 98.2,
    "PainScale": 5.0,
}
VALID_RANGES = {
    "Age": (0.0, 120.0),
    "Pulse": (20.0, 250.0),
    "HR": (20.0, 250.0),
    "SBP": (40.0, 300.0),
    "DBP": (20.0, 200.0),
    "Resp": (4.0, 60.0),
    "RR": (4.0, 60.0),
    "O2Sat": (50.0, 100.0),
    "Temp": (86.0, 113.0),
    "PainScale": (0.0, 10.0),
}
ZERO_IS_MISSING = ("Pulse", "HR", "SBP", "DBP", "Resp", "RR", "O2Sat")
STRUCTURED_COLUMNS = ["Age", "Temp", "Pulse", "Resp", "SBP", "DBP", "O2Sat", "PainScale", "ArrivalMode"]
ARRIVAL_MODE_CODES = {"Ambulance": 1.0, "Public Transport": 2.0, "Walk-in": 3.0, "Other": 4.0}
ARRIVAL_MODE_DEFAULT = 3.0

# Dashboard feature names (11 structured, then BERT_0..BERT_767).
DASHBOARD_FEATURES = [
    "Age", "Temp", "Pulse", "Resp", "SBP", "DBP", "O2Sat", "PainScale",
    "ArrivalMode_Ambulance", "ArrivalMode_Public", "ArrivalMode_Walk-in",
]
DASHBOARD_TEXT_PREFIX = "BERT_"
DASHBOARD_TEXT_DIMS = 768
# Service feature names (9 structured, then BERT_i).
SERVICE_FEATURES = ["Age", "Temp", "Pulse", "Resp", "SBP", "DBP", "O2Sat", "PainScale", "ArrivalMode"]

# Token colours by level, service action codebook, env/batch action codebook.
COLOR_MAP = {1: "RED", 2: "ORG", 3: "YEL", 4: "GRN", 5: "BLU"}
COLOR_DEFAULT = "UNK"
# Chart labels of the levels.
LEVEL_LABELS = {1: "RED (Resuscitation)", 2: "ORANGE (Emergent)", 3: "YELLOW (Urgent)", 4: "GREEN (Less Urgent)", 5: "BLUE (Non-Urgent)"}
SERVICE_ACTIONS = {0: "Assign to Bed", 1: "Move to Waiting Room", 2: "Direct to Fast Track"}
SERVICE_ACTION_DEFAULT = "Move to Waiting Room"
BATCH_ACTIONS = {0: "Wait", 1: "Fast Track", 2: "Acute", 3: "Critical", 4: "Diagnostics"}
# Chart names of the batch actions and the chart column order.
CHART_ACTIONS = {0: "Wait/Home", 1: "Fast Track", 2: "Acute Care", 3: "Critical Care", 4: "Diagnostics"}
CHART_ORDER = ["Critical Care", "Acute Care", "Diagnostics", "Fast Track", "Wait/Home"]

# Fairness label maps.
SEX_LABELS = {1: "Female", 2: "Male"}
RACE_LABELS = {1: "White", 2: "Black", 3: "Hispanic", 4: "Asian/Other"}

# Hybrid routing.
CONFIDENCE_THRESHOLD = 0.6
RL_LEVEL_INDEX = 2  # predicted ESI 3 always goes to the policy
SUPERVISED_ACTION_BY_LEVEL = {1: 3, 2: 2, 3: 2, 4: 1, 5: 1}
FALLBACK_PROBS = [0.1, 0.15, 0.5, 0.15, 0.1]
FALLBACK_LEVEL = 3
FALLBACK_CONFIDENCE = 0.5
N_CLASSES = 5

# Batch ED state used for occupancy features, and capacities.
BATCH_ED_STATE = {"waiting": 5, "occ_critical": 2, "occ_acute": 10, "occ_fast": 5}
CAPACITY = {"waiting": 50.0, "occ_critical": 10.0, "occ_acute": 30.0, "occ_fast": 20.0}

# Handoff alert thresholds (rule order matters).
SHOCK_CRITICAL = 1.0
SHOCK_WARNING = 0.7
HR_TACHY = 120.0
SBP_HYPO = 90.0
O2_HYPOXIA = 92.0
ALERT_CAP = 10
WATCH_NAMES = 3

# Alert texts (patient, value), in rule order.
ALERT_SHOCK = "⚠️ %s: Critical Shock Index (%s)"
ALERT_TACHYCARDIA = "\U0001f534 %s: Tachycardia (HR %s)"
ALERT_HYPOTENSION = "\U0001f534 %s: Hypotension (SBP %s)"
ALERT_HYPOXIA = "\U0001f534 %s: Hypoxia (O2 %s%%)"

# Hand-off summary texts.
SUMMARY_CRITICAL = "%d critical patient(s) requiring immediate attention"
SUMMARY_URGENT = "%d urgent case(s) in queue"
SUMMARY_STABLE = "%d stable patient(s) for routine care"
SUMMARY_EMPTY = "ED is currently clear. No active patients."
SUMMARY_WATCH = " Watch closely: "
NO_VITALS_RECORDED = "No vitals recorded"
NO_VITALS = "No vitals"

# Audit labels.
AGE_PEDIATRIC, AGE_ADULT, AGE_GERIATRIC = "Pediatric (<18)", "Adult (18-65)", "Geriatric (>65)"
SEX_DEFAULT, RACE_DEFAULT = "Unknown", "Other"

# Evaluation report lines.
REPORT_TITLE = "Hybrid System Evaluation Report"
REPORT_LINES = [
    ("RL Interventions: ", "rl_intervention_pct", 1),
    ("Critical Miss Rate: ", "critical_miss_rate", 2),
    ("Over-Triage Rate: ", "over_triage_rate", 2),
    ("Overall Accuracy: ", "accuracy", 2),
]

# Complaint text for missing complaints.
GENERAL_COMPLAINT = "General complaint"

# Rewards of a decision (by action and acuity) and the costs of a full area.
REWARD_WAIT_MISSED, REWARD_WAIT = -500, -1
REWARD_CRITICAL, REWARD_CRITICAL_WASTED, COST_CRITICAL_FULL = 20, -20, 50
REWARD_FAST, REWARD_FAST_MISSED, COST_FAST_FULL = 15, -500, 30
REWARD_ACUTE, REWARD_ACUTE_MISSED, REWARD_ACUTE_WASTED, COST_ACUTE_FULL = 15, -500, -10, 40
REWARD_ESCALATE = -5

# Spark-line warning limits (vital, comparison, limit).
SPARKLINE_RULES = [("hr", ">", 100.0), ("sbp", "<", 90.0), ("o2sat", "<", 95.0)]

# Wait text by level, the minutes template and the default text.
WAIT_ESTIMATES = {
    1: "You will be seen immediately",
    2: "Estimated wait: 10-15 minutes",
    3: "Estimated wait: 30-60 minutes",
    4: "Estimated wait: 1-2 hours",
    5: "Estimated wait: 2-4 hours",
}
WAIT_MINUTES_TEMPLATE = "Estimated wait: %d minutes"
WAIT_TEXT_DEFAULT = "Please wait for your turn"

# Kiosk input ranges (field, low, high), inclusive.
INPUT_RANGES = [
    ("age", 0.0, 120.0),
    ("heart_rate", 30.0, 250.0),
    ("temperature", 90.0, 110.0),
    ("pain", 0.0, 10.0),
]

# Kiosk defaults (replace 0 or empty) and kiosk constants.
KIOSK_DEFAULTS = {"Age": 30.0, "Pulse": 80.0, "Temp": 98.6}
KIOSK_CONSTANTS = {"Resp": 16.0, "SBP": 120.0, "DBP": 80.0, "O2Sat": 98.0}

# Bed load (occupied = min(n + 8, 20) / 20) and bands.
BED_BASE = 8
BED_CAPACITY = 20
BED_BANDS = [(0.9, "red"), (0.7, "yellow")]
BED_BAND_DEFAULT = "green"

# ---------------------------------------------------------------------------
# Fixed-width layouts, (name, start, end, scale) with [start:end).
# Layout A is the two-year merge layout, layout B the single-year parser.
# ---------------------------------------------------------------------------
LAYOUT_A = [
    ("Age", 10, 14, 1.0),
    ("Temp", 47, 51, 10.0),
    ("Pulse", 51, 54, 1.0),
    ("Resp", 54, 57, 1.0),
    ("SBP", 57, 60, 1.0),
    ("DBP", 60, 63, 1.0),
    ("O2Sat", 63, 66, 1.0),
    ("ESI", 66, 68, 1.0),
    ("ArrivalMode", 30, 31, 1.0),
    ("PainScale", 174, 176, 1.0),
]
LAYOUT_B = [
    ("Age", 10, 14, 1.0),
    ("Temp", 48, 51, 10.0),
    ("Pulse", 51, 54, 1.0),
    ("Resp", 54, 57, 1.0),
    ("SBP", 57, 60, 1.0),
    ("DBP", 60, 63, 1.0),
    ("O2Sat", 63, 66, 1.0),
    ("ESI", 66, 68, 1.0),
]
CODES_FROM = 68
CODE_PATTERN = "[A-Z][0-9]{2,4}"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
VITALS_KEYS = ["Age", "Pulse", "HR", "SBP", "DBP", "Resp", "RR", "O2Sat", "O2_Sat",
               "Temp", "PainScale", "ArrivalMode", "patient_id"]
VITALS_STRUCT = T.StructType([T.StructField(k, T.DoubleType(), True) for k in VITALS_KEYS])

VISIT_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType(), True) for name, *_ in LAYOUT_A]
    + [T.StructField("Chief_complain", T.StringType(), True), T.StructField("Year", T.IntegerType(), True)]
)

DECISION_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("ESI", T.IntegerType(), True),
    T.StructField("Sup_Pred", T.IntegerType(), True),
    T.StructField("Sup_Conf", T.DoubleType(), True),
    T.StructField("Source", T.StringType(), True),
    T.StructField("Final_Action", T.IntegerType(), True),
    T.StructField("Is_Critical_Miss", T.BooleanType(), True),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])
