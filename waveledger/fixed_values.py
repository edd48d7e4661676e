"""Keys, setpoints, thresholds and formats the results depend on.

These are data, not logic.  They must stay exactly as they are for results to
match previously published tables.
"""

# Sensors, in report order.
SENSORS = ["current", "sound_vibrometer", "sound_phone", "vibration"]

# The three waveform sensors that are compared with each other.
MODALITIES = ["sound_phone", "sound_vibrometer", "current"]

# Metadata columns, in file order.
METADATA_COLUMNS = [
    "condition", "operation", "reversal", "speed_percent", "sensor", "format",
    "sample_rate_hz", "duration_s", "channels", "bit_depth", "file_size_bytes",
    "new_path", "original_name", "original_path",
]

# Folder name -> canonical operation key.
OPERATIONS = {
    "нормална работа": "normal",
    "разхлабен фундамент": "loose_foundation",
    "неоптимално управление": "suboptimal_control",
    "неоптимално управление - коеф. рт": "suboptimal_control_rt",
}

# Folder name -> (condition suffix, reversal flag).
REVERSALS = {
    "без реверсиране": ("no_reversal", "no"),
    "с реверсиране": ("with_reversal", "yes"),
}

# Sensor folder name -> (sensor, file extension).
SENSOR_ALIASES = {
    "вибрации": ("vibration", ".xls"),
    "звук - виброметър": ("sound_vibrometer", ".wav"),
    "звук": ("sound_vibrometer", ".wav"),
    "звук - телефон 1м": ("sound_phone", ".m4a"),
    "звук - телефон": ("sound_phone", ".m4a"),
    "ток осцилоскоп": ("current", ".bin"),
    "ток": ("current", ".bin"),
    "tок": ("current", ".bin"),
    "ток - кр2=0.1": ("current", ".bin"),
}

# Cyrillic letter -> Latin text.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "",
    "ю": "yu", "я": "ya",
}

# Speed setpoints, percent of rated speed.
SETPOINTS = [1, 2, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
CAPPED_OPERATION = "suboptimal_control"
CAP_SETPOINT = 65
SPOT_SENSOR = "vibration"
SPOT_SKIPPED_SETPOINTS = [1, 2]

# Spot readings.
QUANTITIES = ["Velocity", "Acceleration", "Displacement"]
QUANTITY_UNITS = {"Velocity": "mm/s", "Acceleration": "m/s²", "Displacement": "mm"}

# Pairing and windows.
MIN_CURRENT_DURATION_S = 20.0
DURATION_TOLERANCE_S = 1e-3
MIN_VALID_SAMPLES = 32

# Spectral bands, half-open, in Hz.
WIDE_BANDS = [(0, 50), (50, 150), (150, 400), (400, 1000), (1000, 3000), (3000, 8000)]
FINE_BANDS = [(0, 100), (100, 250), (250, 500), (500, 1000),
              (1000, 2000), (2000, 5000), (5000, 10000)]
PSD_FLOOR = 1e-18
DB_FLOOR = 1e-20
ROLLOFF_SHARE = 0.85
HARMONIC_MARKERS_HZ = [300.0, 600.0, 900.0, 1200.0]

# Quality control.
QC_BLOCK_S = 0.01
QC_MIN_RUN_S = 0.1
QC_SILENT_SHARE = 0.01
QC_SILENT_PEAK_SHARE = 1e-6
QC_DURATION_TOLERANCE_S = 0.000051
QC_RATE_TOLERANCE_HZ = 1.0
BASELINE_MIN_RUN_SHARE = 0.98
BASELINE_MIN_HEADROOM_CODE = 4

# Decisions.
F1_MARGIN = 0.05
MAE_MARGIN = 5.0
T_CRITICAL_SMALL = 2.776
T_CRITICAL_LARGE = 1.96
T_SMALL_N = 5

# Display labels.
MODALITY_LABELS = {
    "sound_phone": "Smartphone audio",
    "sound_vibrometer": "Vibrometer waveform",
    "current": "Armature current",
}

# SI prefixes by power of ten, and the factors accepted when parsing seconds.
SI_PREFIXES = {-15: "f", -12: "p", -9: "n", -6: "u", -3: "m",
               0: "", 3: "k", 6: "M", 9: "G", 12: "T"}
SECONDS_FACTORS = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3,
                   "": 1.0, "k": 1e3, "M": 1e6}

# What the quality report says about clipping.
CLIPPING_UNKNOWN, CLIPPING_FOUND, CLIPPING_NONE = "unverifiable", "limit samples detected", "not detected"

# Scope capture layout: little-endian byte offsets and widths.
SCOPE_MAGICS = (b"RG01", b"AG01")
SCOPE_FILE_HEADER = 12
SCOPE_MIN_WAVEFORM_HEADER = 140
SCOPE_BUFFER_HEADER = 12
SCOPE_WIDTHS = {1: "u1", 2: "<i2", 4: "<f4", 8: "<f8"}
SCOPE_UNITS = {0: "unknown", 1: "V", 2: "s", 3: "Hz"}
DEEP_MEMORY_HEADER = 4200
DEEP_MEMORY_STEP_OFFSETS = (633, 757, 881, 1005)
DEEP_MEMORY_RATE_HZ = 500_000.0
