"""Results depend on these being exactly as written."""

# Band names of one acquisition, in stacking order.
BANDS = ["red", "green", "blue", "nir"]

# Every country of the benchmark dataset.
ALL_COUNTRIES = [
    "austria", "belgium", "brazil", "cambodia", "corsica", "croatia", "denmark",
    "estonia", "finland", "france", "germany", "india", "kenya", "latvia",
    "lithuania", "luxembourg", "netherlands", "portugal", "rwanda", "slovakia",
    "slovenia", "south_africa", "spain", "sweden", "vietnam",
]

# The countries that have presence-only labels.
PRESENCE_ONLY_COUNTRIES = ["brazil", "india", "kenya", "rwanda"]

FULL_DATA_COUNTRIES = [c for c in ALL_COUNTRIES if c not in PRESENCE_ONLY_COUNTRIES]

# Splits and temporal options of a sample.
SPLITS = ["train", "val", "test"]
TEMPORAL_OPTIONS = [
    "stacked", "windowA", "windowB", "median", "rgb", "random_window",
    "window_a_rgb", "window_b_rgb",
]

# Land-cover product -> class code that means cropland.
CROPLAND_CLASS = {"io-lulc-annual-v02": 5, "esa-worldcover": 40}

# Class codes of a label mask.
BACKGROUND, FIELD, BOUNDARY, UNKNOWN = 0, 1, 2, 3

# Public object-store root and key prefix of the scene metadata.
SCENE_STORE = "https://sentinel-cogs.s3.us-west-2.amazonaws.com"
SCENE_PREFIX = "sentinel-s2-l2a-cogs"

# WGS-84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
