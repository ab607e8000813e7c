"""Fixed domain values: pollutants, units, breakpoints, bands, feature windows."""

from __future__ import annotations

# --- fixed values: pollutants and weather variables --------------------------------
POLLUTANTS = (
    "pm25", "pm10", "no", "no2", "nox", "nh3", "co", "so2", "o3",
    "benzene", "toluene", "xylene",
)
WEATHER = (
    "temperature_2m", "relative_humidity_2m", "precipitation", "pressure_msl",
    "cloud_cover", "wind_speed_10m", "wind_direction_10m",
)
DRIFT_FEATURES = ("pm25", "pm10", "no", "no2", "nox", "nh3", "co", "so2", "o3")
QUALITY_NON_NEGATIVE = ("pm25", "no2", "co", "so2", "o3", "aqi")

# --- fixed values: raw CSV header -> column name -------------------------------------
RAW_READING_NAMES = {
    "StationId": "station_id", "Datetime": "timestamp",
    "PM2.5": "pm25", "PM10": "pm10", "NO": "no", "NO2": "no2", "NOx": "nox", "NH3": "nh3",
    "CO": "co", "SO2": "so2", "O3": "o3",
    "Benzene": "benzene", "Toluene": "toluene", "Xylene": "xylene",
    "AQI": "aqi", "AQI_Bucket": "aqi_bucket",
}
RAW_STATION_NAMES = {
    "StationId": "station_id", "StationName": "station_name",
    "City": "city", "State": "state", "Status": "status",
}

# --- fixed values: unit conversion ----------------------------------------------------
MOLAR_VOLUME = 24.45
MOLAR_MASS = {
    "no": 30.01, "no2": 46.0055, "nox": 46.0055, "nh3": 17.031,
    "co": 28.01, "so2": 64.066, "o3": 48.00,
}
PPB_GASES = ("no", "no2", "nh3", "so2", "o3", "nox")
CANONICAL_UNIT = {p: "mg/m3" if p == "co" else "ug/m3" for p in POLLUTANTS}

# --- fixed values: sub-index breakpoints (value low, value high, index low, index high) --
BREAKPOINTS = {
    "pm25": [(0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200),
             (91, 120, 201, 300), (121, 250, 301, 400), (251, 1000, 401, 500)],
    "pm10": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200),
             (251, 350, 201, 300), (351, 430, 301, 400), (431, 2000, 401, 500)],
    "no2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 180, 101, 200),
            (181, 280, 201, 300), (281, 400, 301, 400), (401, 1000, 401, 500)],
    "so2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 380, 101, 200),
            (381, 800, 201, 300), (801, 1600, 301, 400), (1601, 3000, 401, 500)],
    "co": [(0, 1, 0, 50), (1.1, 2, 51, 100), (2.1, 10, 101, 200),
           (10.1, 17, 201, 300), (17.1, 34, 301, 400), (34.1, 100, 401, 500)],
    "o3": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 168, 101, 200),
           (169, 208, 201, 300), (209, 748, 301, 400), (749, 2000, 401, 500)],
    "nh3": [(0, 200, 0, 50), (201, 400, 51, 100), (401, 800, 101, 200),
            (801, 1200, 201, 300), (1201, 1800, 301, 400), (1801, 3000, 401, 500)],
}

# --- fixed values: bands (inclusive upper bound, text; None = no bound) ---------------
ADVISORIES = (
    (50, "Air quality is good. Outdoor activity is safe."),
    (100, "Air quality is satisfactory. Sensitive people should stay alert."),
    (200, "Moderate pollution. Limit prolonged outdoor exertion."),
    (300, "Poor air quality. Consider reducing outdoor activities."),
    (400, "Very poor air quality. Avoid outdoor exposure if possible."),
    (None, "Severe air quality. Stay indoors and use protection."),
)
SERVING_BANDS = (
    (50, "Good"), (100, "Satisfactory"), (200, "Moderate"),
    (300, "Poor"), (400, "Very Poor"), (None, "Severe"),
)
# Right-closed intervals starting above 0; values outside (0, 500] have no category.
PROFILE_EDGES = (0, 50, 100, 150, 200, 300, 500)
PROFILE_LABELS = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")

# --- fixed values: display names of the six headline pollutants, in tie-break order ---
HEADLINE_POLLUTANTS = (
    ("pm25", "PM2.5"), ("pm10", "PM10"), ("no2", "NO2"),
    ("so2", "SO2"), ("co", "CO"), ("o3", "O3"),
)

# --- fixed values: location name hints per city, in order of preference ---------------
LOCATION_HINTS = {
    "Delhi": ("R K Puram", "DPCC", "IGI Airport", "Civil Lines"),
    "Mumbai": ("Bandra Kurla Complex", "Mazgaon", "Worli", "Colaba"),
    "Chennai": ("Velachery", "Manali", "Alandur"),
    "Kolkata": ("Rabindra Bharati University", "Bidhannagar", "Victoria"),
    "Ahmedabad": ("SAC ISRO", "Bopal", "Maninagar", "Navrangpura"),
}
DEFAULT_COORDINATES = (13.0827, 80.2707)

# --- fixed values: history, retention and split parameters ----------------------------
MIN_HISTORY_ROWS = 168
BACKFILL_HOURS = 200
SAFETY_LAG_HOURS = 2
BACKFILL_DAYS = 30
MEASUREMENT_RETENTION_DAYS = 10
READING_RETENTION_HOURS = 200
PREDICTION_RETENTION_DAYS = 7
N_AHEAD = 24
REPORTED_HORIZONS = (1, 6, 12, 24)
TRAIN_END = "2018-01-01"
VALIDATION_END = "2019-06-01"

# --- fixed values: drift thresholds -----------------------------------------------------
PSI_HIGH = 0.25
PSI_MODERATE = 0.12
PSI_LOW = 0.05
KS_P_THRESHOLD = 0.05
Z_THRESHOLD = 1.5
RETRAIN_FRACTION = 0.4
MIN_DRIFT_VALUES = 10

# --- fixed values: latency histogram upper bounds in seconds ----------------------------
LATENCY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)

# --- fixed values: ranges of the parameter search ----------------------------------------
SEARCH_RANGES = {"trees": (100, 300), "rate": (0.01, 0.2), "leaves": (20, 100), "depth": (3, 8), "least": (10, 100)}
