"""Fixed values that decide results: column names, bands, coefficients, messages."""

# Ordered candidate names of the PM2.5 column, one list per loader.
VALUE_COLUMNS = {
    "canonical": ("pm2.5", "pm2.5_corrected", "pm25"),
    "legacy": ("pm25", "PM2.5", "pm2_5"),
    "tolerant": ("pm25", "PM2.5", "pm2_5", "pm25_1", "pm25_2", "pm25_value"),
}

# Fragments that identify a PM2.5 column by name.
VALUE_NAME_FRAGMENTS = ("pm25", "pm2.5", "pm2_5", "pm 2.5", "pm")
VALUE_NAME_EXCLUDED = "10"

# Candidate names of the time column for the tolerant scan.
TIME_COLUMNS_TOLERANT = ("date", "timestamp", "datetime", "time")

# Sensor metadata renames, one map per loader.
SENSOR_RENAMES = {
    "canonical": {"id": "sensor_id", "title": "location_name"},
    "tolerant": {"id": "sensor_id"},
    "legacy": {"type": "sensor_type", "param": "parameter"},
}

# Valid measurement range, lower bound included, upper bound excluded.
VALID_MIN = 0.0
VALID_MAX = 1000.0

# Six-level bands as (upper bound included, label, message); above the last is Hazardous.
RISK_BANDS = (
    (5.0, "Good", "No health impacts expected"),
    (15.0, "Moderate", "Unusually sensitive people should consider reducing prolonged outdoor exertion"),
    (25.0, "Unhealthy for Sensitive Groups",
     "Active children and adults with respiratory disease should limit outdoor exertion"),
    (35.0, "Unhealthy", "Everyone may begin to experience health effects"),
    (50.0, "Very Unhealthy", "Health warnings of emergency conditions"),
)
RISK_TOP = ("Hazardous", "Health alert: everyone may experience serious health effects")
RISK_UNKNOWN = "Unknown"

# Estimator categories as (upper bound included, label, colour); the rest is Hazardous/maroon.
ESTIMATOR_CATEGORIES = (
    (5.0, "Good", "green"),
    (15.0, "Moderate", "yellow"),
    (25.0, "Very Unhealthy", "purple"),
)
ESTIMATOR_TOP = ("Hazardous", "maroon")

# Guideline concentrations.
GUIDELINE_ANNUAL = 5.0
GUIDELINE_24H = 15.0
GUIDELINE_HIGH = 25.0

# Relative risk per 10 units above the annual guideline, with description.
RISK_COEFFICIENTS = (
    ("mortality", 1.062, "All-cause mortality (WHO 2021)"),
    ("cardiovascular", 1.11, "Cardiovascular hospital admissions"),
    ("respiratory", 1.08, "Respiratory hospital admissions"),
    ("lung_cancer", 1.09, "Lung cancer mortality"),
)
# The short form reports the first three outcomes only.
SHORT_OUTCOMES = ("mortality", "cardiovascular", "respiratory")

# Yearly cases per person and unit of excess concentration.
IMPACT_RATES = (
    ("premature_deaths_per_year", 0.0001),
    ("hospital_admissions_per_year", 0.0002),
    ("asthma_emergency_visits", 0.00015),
    ("lost_work_days_per_year", 0.001),
)

# General recommendation as (upper bound included, text).
RECOMMENDATIONS = (
    (5.0, "Safe for outdoor activities"),
    (15.0, "Limit prolonged exertion if sensitive"),
    (25.0, "Sensitive groups limit outdoor activities"),
    (50.0, "Avoid outdoor activities"),
)
RECOMMENDATION_TOP = "Stay indoors, keep windows closed"

# Advice per profile as ((upper bound included, text), ...), last text above all bounds.
PROFILE_ADVICE = {
    "sensitive": (((15.0, "Generally safe, keep medication handy"),
                   (25.0, "Limit outdoor time, keep windows closed")),
                  "Stay indoors, use air purifier"),
    "athlete": (((25.0, "OK for light training"),), "Train indoors today"),
    "elderly": (((15.0, "Safe for short walks"),), "Remain indoors"),
    "parent": (((15.0, "Safe for outdoor play"),
                (25.0, "Limit outdoor play to 1 hour")),
               "Keep children indoors"),
}
DEFAULT_PROFILE = "sensitive"
# Menu numbers of the profiles.
PROFILE_CHOICES = {"1": "sensitive", "2": "athlete", "3": "elderly", "4": "parent"}

# Display names of district slugs.
DISTRICT_NAMES = {
    "avan": "Avan",
    "nor-nork": "Nor Nork",
    "ajapnyak": "Ajapnyak",
    "arabkir": "Arabkir",
    "davtashen": "Davtashen",
    "erebuni": "Erebuni",
    "shengavit": "Shengavit",
    "kentron": "Kentron",
}

# The known sensors and their districts.
SENSOR_DISTRICTS = {
    2: "Nor Nork",
    4: "Arabkir",
    7: "Davtashen",
    9: "Erebuni",
    11: "Shengavit",
    28: "Ajapnyak",
    29: "Arabkir",
    30: "Davtashen",
    41: "Avan",
    43: "Shengavit",
    45: "Nor Nork",
    50: "Ajapnyak",
    53: "Kentron",
}

# Reported percentiles.
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
