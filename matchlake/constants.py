"""Units, thresholds, pitch size, word lists. They must equal the published domain values."""

# --- units -------------------------------------------------------------------------------------------------------
MPH_PER_MS = 2.23694          # miles per hour in one metre per second
KMH_PER_MPH_TRACK = 1.60934   # used by the trajectory layer
KMH_PER_MPH = 1.609344        # used by the statistics and risk layers

# --- pitch -------------------------------------------------------------------------------------------------------
PITCH_LENGTH_M = 105.0
PITCH_WIDTH_M = 68.0
PITCH_MARGIN_M = 5.0

# --- speed -------------------------------------------------------------------------------------------------------
HSR_MPH = 12.3
SPRINT_MPH = 15.7
MAX_PLAUSIBLE_MPH = 25.0
WALK_KMH = 7.0
JOG_KMH = 15.0
SMOOTHING_ROWS = 5
BURST_EXIT_SHARE = 0.9
BURST_BRIDGE_S = 0.2
BURST_DWELL_S = 1.0
ACCEL_MS2 = 3.0
ACCEL_CLIP_MS2 = 6.0
ACCEL_DWELL_S = 0.7
DEFAULT_THRESHOLDS = {
    "preset": "gps_standard",
    "hsr_kmh": 19.8,
    "sprint_kmh": 25.3,
    "walk": 7.0,
    "jog": 15.0,
    "run": 19.8,
    "hsr": 25.3,
}

# --- heatmaps ----------------------------------------------------------------------------------------------------
FRAME_GRID = (21, 14)    # columns, rows; cells hold seconds
SAMPLE_GRID = (12, 8)    # columns, rows; cells hold samples

# --- rates and risk ----------------------------------------------------------------------------------------------
MIN_RATE_MINUTES = 0.1
MIN_EXPOSURE_MINUTES = 1.0
ACWR_SESSIONS = 4
ACWR_CAP = 5.0
RISK_RED = 70.0
RISK_YELLOW = 40.0
RISK_RANK = {"Low": 1, "Medium": 2, "High": 3}
LOW_SAMPLE = 3

# --- identity ----------------------------------------------------------------------------------------------------
STITCH_MAX_SPEED_MS = 12.0
STITCH_MAX_COST = 10.0
STITCH_MAX_GAP_S = 300.0     # cost <= 10 with the largest bonus (20) leaves at most 30 * 10 s of gap
OCCLUSION_FRAMES = 30
APPEARANCE_THRESHOLD = 0.7

# --- ball --------------------------------------------------------------------------------------------------------
BALL_GAP_FRAMES = 15
BALL_EXTRAPOLATE_FRAMES = 10
BALL_MAX_SPEED_MS = 35.0
BALL_PX_PER_M = 20.0

# --- model features ----------------------------------------------------------------------------------------------
FEATURES = [
    "acwr",
    "distance_m_per_min",
    "sprints_per_90",
    "hsr_m_per_min",
    "top_speed_kmh",
    "minutes_played",
    "heart_rate_avg",
    "hr_missing",
]
FEATURE_LABELS = {
    "acwr": "Acute:chronic workload ratio",
    "distance_m_per_min": "Distance per minute (m/min)",
    "sprints_per_90": "Sprints per 90 min",
    "hsr_m_per_min": "High-speed running per minute (m/min)",
    "top_speed_kmh": "Top speed (km/h)",
    "minutes_played": "Minutes played",
    "heart_rate_avg": "Average heart rate (bpm)",
    "hr_missing": "Heart rate not provided",
}
