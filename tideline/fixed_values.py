"""Labels, thresholds and rules that the results depend on."""

# Order of areas (stocks) and subareas in tables.
STOCKS = ["Kauai/Niihau", "Oahu", "Maui Nui", "Hawaii"]
SUBAREAS = ["KA", "KB", "KC", "KD", "OA", "OB", "MA", "MB", "HA", "HB"]

# Areas outside the stocks, and the place that is left out.
NON_STOCK_AREAS = ["Unknown", "Offshore", "NWHI"]
OFFSHORE_AREA = "Offshore"
EXCLUDED_PLACE = "Kaula Rock"

# Spellings of one area, and of the sighting types.
AREA_SPELLINGS = {"Maui Nui": ["4-island", "4-island ", "4-Island", "Maui"]}
SIGHT_TYPE_SPELLINGS = {
    "Original": ["Original", "Original ", "original"],
    "Within-day": ["within-day", "Within-day "],
    "Within-year": ["within-year"],
}
DISCOVERY_TYPES = ["Original", "Within-year", "Between-year"]

# Names of areas for display.
DISPLAY_NAMES = {
    "Kauai/Niihau": "Kauaʻi/Niʻihau",
    "Oahu": "Oʻahu",
    "Hawaii": "Hawaiʻi",
}

# Contributors.
CRC_SOURCE = "RWB"
PWF_SOURCES = ["PWF Line Transect", "PWF Platform of Opportunity", "PWF Donation", "PWF", "PWF "]

# Curation thresholds.
DEPTH_LIMIT = 3000
MIN_DISTINCTIVENESS = 3
MIN_PHOTO_QUALITY = 3
COMPLETE = "complete"
WINDWARD_AREA = "Hawaii"
WINDWARD_EXCLUSION_LON = 155.82
WINDWARD_EFFORT_LON = 155.8
FIRST_YEAR = 2000
LAST_YEAR = 2018
MIN_QUALITY_ROWS = 5

# Sightings of one stock placed in a subarea of the other.
CROSS_STOCK_SUBAREAS = {"Maui Nui": ["OB", "OA"], "Oahu": ["MB", "MA"]}

# Subarea boundaries, in degrees of latitude and of longitude without sign.
KAUAI_EAST_LON = 159.5
KAUAI_WEST_LON = 159.94
KAUAI_MIDDLE_LAT = 22
HAWAII_MIDDLE_LAT = {"first_sighting": 19.71, "each_sighting": 19.73}
MAUI_NORTH_LAT = 21
MAUI_NORTH_LON = 156.8
MAUI_WEST_LON = 157.5
OAHU_MIDDLE_LAT = 21.5

# Kauai/Niihau labels of the east, south-middle, north-middle and west part.
KAUAI_LABELS = {
    "first_sighting": ["KD", "KC", "KB", "KA"],
    "each_sighting": ["KA", "KB", "KC", "KD"],
}
NO_SUBAREA = "NA"

# Sampling null (yearly survival and detection), seed, replicates.
NULL_SURVIVAL = 0.9
NULL_DETECTION = 0.4
SEED = 1020
MOVEMENT_REPLICATES = 1000
TREND_REPLICATES = 10000
BOOTSTRAP_REPLICATES = 1000
FACTOR_TOLERANCE = 1e-10

# Earth radius in km, histogram range (km) and bins, density grid points.
EARTH_RADIUS_KM = 6378.137
HISTOGRAM_MAX_KM = 30
HISTOGRAM_BINS = 150
DENSITY_POINTS = 512

# Discovery curves above both limits are left out of the small plot.
LARGE_CURVE_ORIGINAL = 50
LARGE_CURVE_SIGHT = 125

# Models at or below this weight are not reported.
MIN_MODEL_WEIGHT = 0.0001

# Cumulative Poisson(1) probabilities for 0, 1, 2, ... events. A uniform of 32 bits is at most
# 1 - 2 ** -32, which the last one does not leave below 12, so that 12 events are the most there are.
POISSON_ONE_CUMULATIVE = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
]
