"""Thresholds and weights used across the operators.

Every operator takes these as keyword arguments; the values here are only the defaults.
"""
from earlog.functions.ship import by_value

by_value(__name__)          # functions that run in tasks read some of them
del by_value                # nothing but values is shipped

# --- fixed values: limits and weights that decide results -------------------------------
UNKNOWN_DURATION_S = 210.0
VOCAL_RATIO_SPLIT = 0.5          # vocal / instrumental split of listens
VOCAL_RATIO_MIN = 0.3            # instrumental filter of the catalogue
MIN_PLAY_COUNT = 2
FEATURE_VERSION = 6
SIMILARITY_VERSION = 2
SESSION_GAP_MIN = 45
SESSION_MAX_TRACKS = 200
TRANSITION_GAP_MIN = 15
HALF_LIFE_DAYS = 180
MIX_KEY_CONF = 0.7
TEMPO_TOLERANCE = 0.06
UNAVAILABLE_TTL_DAYS = 30
ERROR_TEXT_MAX = 300
ARTIST_CACHE_DAYS = 30
ARTIST_CACHE_MISS_DAYS = 3
RADIO_CACHE_DAYS = 7
RADIO_CACHE_MISS_DAYS = 1
CONFIRM_RATIO = 0.8
MATCH_RATIO = 0.6
TRANSCRIPT_MIN_WORDS = 8
ARTIST_MATCH_SCORE = 75
VOCABULARY_SIZE = 20000
BOT_STREAK = 12
NETWORK_STREAK = 10

MOODS = ["happy", "sad", "relaxed", "aggressive", "electronic", "acoustic", "party",
         "epic", "dark", "romantic", "atmospheric"]
MOOD_COLS = ["mood_" + m for m in MOODS]
MOOD_DEFAULT = 0.125
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# standardised 53-number vector: slice name -> (first, end), 0-based half open
DENSE_SLICES = {"timbre": (0, 33), "harmony": (33, 45), "rhythm": (45, 48), "macro": (48, 53)}

TRACK_WEIGHTS = {"timbre": 0.15, "rhythm": 0.15, "harmony": 0.15, "macro": 0.10,
                 "embedding": 0.30, "moods": 0.10, "instruments": 0.10, "genre": 0.10,
                 "topics": 0.075, "lyrics": 0.075}
ARTIST_WEIGHTS = {"timbre": 0.12, "rhythm": 0.12, "harmony": 0.12, "macro": 0.08,
                  "embedding": 0.24, "genre": 0.12, "instruments": 0.08, "moods": 0.12}
TAG_WEIGHTS = {"genres": 0.30, "instruments": 0.15, "moods": 0.30, "vocal": 0.25}
CLUSTER_WEIGHTS = {"timbre": 0.35, "rhythm": 0.25, "harmony": 0.25, "macro": 0.15}
KEY_BONUS = 0.05
SHRINKAGE = 3.0

GROUP_LABELS = {"embedding": "by neural timbre", "timbre": "by timbre", "rhythm": "by rhythm",
                "harmony": "by harmony", "macro": "by character", "moods": "by mood",
                "instruments": "by instruments", "genre": "by genre", "lyrics": "by lyrics",
                "topics": "by topics"}
# by the position of the mood in MOODS, not by its name: a mostly sad group is "Energetic", a mostly aggressive one "Melancholic"
CLUSTER_NAMES = ["Happy", "Energetic", "Calm", "Melancholic", "Electronic", "Acoustic", "Party", "Epic", "Dark", "Romantic",
                 "Atmospheric"]
# --- end of fixed values ----------------------------------------------------------------
