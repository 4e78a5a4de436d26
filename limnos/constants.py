"""Domain constants.

FIXED VALUES: every literal below must equal the monitoring rules the engine
reproduces (regulatory limits, weights, bands, vocabularies, word lists).
They are stated plainly, in natural order, in one place.
"""

# --- FIXED VALUES: regulatory limits (inclusive) -------------------------
DO_MIN = 5.0            # dissolved oxygen >= 5 mg/L
BOD_MAX = 3.0           # BOD <= 3 mg/L
PH_MIN = 6.5            # 6.5 <= pH <= 8.5
PH_MAX = 8.5

# --- FIXED VALUES: risk score ------------------------------------------------
RISK_WEIGHTS = {"dissolved_oxygen": 0.4, "bod": 0.4, "ph": 0.2}
BOD_RISK_SPAN = 47.0    # BOD risk reaches 100 at BOD = 50
PH_LOW_SPAN = 6.5       # pH risk reaches 100 at pH = 0
PH_HIGH_SPAN = 5.5      # pH risk reaches 100 at pH = 14
RISK_BANDS = [(25.0, "Low Risk"), (50.0, "Moderate Risk"), (75.0, "High Risk")]
RISK_TOP_BAND = "Severe Risk"
RISK_SEVERITY_RANK = {"Severe Risk": 4, "High Risk": 3, "Moderate Risk": 2,
                      "Low Risk": 1, "Unknown": -1}

# Alert thresholds on the risk score (kept as published: 76 / 51)
ALERT_SEVERE_SCORE = 76.0
ALERT_HIGH_SCORE = 51.0
TREND_CHANGE = 15.0
TREND_HIGH_SCORE = 51.0

# --- FIXED VALUES: parameter vocabularies -----------------------------------
CORE_PARAMS = ["dissolved_oxygen", "bod", "ph"]
LIVE_PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity",
               "nitrate", "fecal_coliform", "total_coliform", "fecal_streptococci",
               "turbidity", "cod", "total_dissolved_solids"]
AUX8 = ["temperature", "conductivity", "nitrate", "fecal_coliform",
        "total_coliform", "turbidity", "cod", "total_dissolved_solids"]
HISTORY_PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature",
                  "conductivity", "total_dissolved_solids"]

# --- FIXED VALUES: what field staff note beside the measured values -----------
FIELD_OBSERVATIONS = ["odour", "colour", "flow", "weather", "floating_matter", "human_activities",
                      "visibility_effluent_discharge", "major_polluting_sources", "use_based_class"]

# --- FIXED VALUES: label vocabularies ---------------------------------------
LBL_INSUFFICIENT = "Insufficient_Data"
LBL_NON_COMPLIANT = "Non-Compliant"
LBL_COMPLIANT_AVAIL = "Compliant_Based_On_Available_Parameters"
LBL_COMPLIANT = "Compliant"
INVALID_RULE_LABELS = ["Insufficient_Data", "Unknown", "Missing", "NaN", "nan"]

# --- FIXED VALUES: hotspot status ---------------------------------------------
HOTSPOT_PRIORITY = {"Persistent Hotspot": 4, "Recurring Risk": 3,
                    "Intermittent Risk": 2, "Insufficient Monitoring": 1,
                    "Stable / Low Risk": 0}

# --- FIXED VALUES: actions of operational alerts ----------------------------
ALERT_ACTIONS = {
    "Severe": "Escalate for immediate field inspection and source tracking.",
    "Regulatory Violation": "Inspect nearby discharge source and issue warning.",
    "ML Non-Compliance": "Schedule prioritized testing to verify ML prediction.",
    "Increasing Risk": "Monitor closely in next sampling cycle.",
    "Low Confidence Data": "Repeat sampling or repair missing sensor data.",
    "None": "No action required.",
}
SEVERITY_RANK = {"Severe": 4, "High": 3, "Warning": 2, "Info": 1, "Safe": 0, "Normal": 0}

# --- FIXED VALUES: text matching word lists ----------------------------------
GENERIC_WATER_WORDS = ["river", "creek", "sea", "nala", "nalla", "dam", "lake", "pond", "well"]
MATCH_STOPWORDS = ["river", "nalla", "nala", "near", "bridge", "village", "taluka",
                   "district", "at", "of", "the", "in", "d/s", "u/s", "ds", "us",
                   "dam", "sump", "midc", "road", "temple", "pump", "house", "intake",
                   "water", "bpt", "from"]
STATE_CODES = {1: "Jammu & Kashmir", 12: "Arunachal Pradesh", 18: "Assam",
               28: "Andhra Pradesh", 29: "Karnataka"}
POSITION_UP = r"\b(u/s|upstream|before)\b"
POSITION_DOWN = r"\b(d/s|downstream|after)\b"
CONTEXT_RULES = [
    (r"\b(drain|effluent|discharge|stp|cetp|industry|nallah|sewage)\b", "Point Source / Drain"),
    (r"\b(confluence|sangam)\b", "Confluence"),
    (r"\b(lake|pond|reservoir|tank)\b", "Lentic Waterbody"),
    (r"\b(well|groundwater|piezometer|tubewell)\b", "Groundwater"),
]
CONTEXT_DEFAULT = "Riverine / General"

# --- FIXED VALUES: missing-value tokens of the numeric parsers
CENSORED_MISSING = ["bdl", "below detection limit", "na", "-", "nil", "nd",
                    "not detectable", "", "null"]
BASIC_MISSING = ["nd", "na", "none", "null", ""]

# --- FIXED VALUES: live parameter names, lower-cased and trimmed -> canonical
LIVE_PARAM_ALIASES = [
    ("ph", "ph"), ("p_h", "ph"),
    ("do", "dissolved_oxygen"), ("dissolved oxygen", "dissolved_oxygen"),
    ("dissolved_o2", "dissolved_oxygen"),
    ("bod", "bod"), ("biochemical oxygen demand", "bod"),
    ("temperature", "temperature"), ("temp", "temperature"),
    ("conductivity", "conductivity"), ("conductance", "conductivity"), ("ec", "conductivity"),
    ("nitrate", "nitrate"), ("no3", "nitrate"),
    ("turbidity", "turbidity"),
    ("cod", "cod"),
    ("tds", "total_dissolved_solids"), ("total dissolved solids", "total_dissolved_solids"),
    ("fecal coliform", "fecal_coliform"), ("faecal coliform", "fecal_coliform"),
    ("total coliform", "total_coliform"),
]
