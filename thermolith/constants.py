"""Thresholds and sizes that the results depend on."""

# They must equal those of the monitored process.
SATURATED = 65000
EMPTY = 5000
OUTLIER = 6000.0
WINDOW_LAYERS = 3
CLOSE_RADIUS = 2
FAR_RADIUS = 4
TOP = 5
EPS = 20.0
MIN_POINTS = 5
IDLE_SECONDS = 10
BATCH_LIMIT = 160
