"""Fixed values.

Everything here is output data or a published default that results depend on: labels,
bucket bounds, thresholds and formats. Kept together and in plain text; the logic that uses
them lives elsewhere.
"""

# --- fixed values: event vocabulary -----------------------------------------------------
VIEW = "view"
CART = "cart"
PURCHASE = "purchase"

UNKNOWN_CATEGORY = "(unknown)"
NO_BRAND = "(no brand)"

# --- fixed values: raw time format ------------------------------------------------------
UTC_SUFFIX = " UTC"
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"

# --- fixed values: words that a raw file uses for a missing value -----------------------
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: sampling -------------------------------------------------------------
HASH_SPACE = 10_000
TARGET_EVENTS = 1_500_000

# --- fixed values: bucket tables --------------------------------------------------------
# (exclusive upper bound, label); the first bound above the value wins, None means the rest.
# All bucketed values are whole numbers, so "exactly 1" is "below 2".
EVENTS_PER_SESSION = (
    (2, "1"),
    (3, "2"),
    (6, "3-5"),
    (11, "6-10"),
    (21, "11-20"),
    (None, "21+"),
)
SESSION_DURATION = (
    (1, "0s (single event)"),
    (60, "< 1 min"),
    (300, "1-5 min"),
    (1_800, "5-30 min"),
    (7_200, "30 min - 2 h"),
    (None, "> 2 h (suspicious)"),
)
EVENT_GAP = (
    (1, "0s (same second)"),
    (60, "< 1 min"),
    (600, "1-10 min"),
    (1_800, "10-30 min"),
    (86_400, "30 min - 24 h"),
    (None, "> 24 h (returned another day)"),
)
CONVERSION_DELAY = (
    (600, "< 10 min"),
    (3_600, "10-60 min"),
    (86_400, "1-24 h"),
    (604_800, "1-7 days"),
    (None, "> 7 days"),
)
SAME_SESSION = "same session"
CONVERSION_KIND = (
    (86_400, "same day (different session)"),
    (None, "later return (> 1 day)"),
)

# --- fixed values: report labels --------------------------------------------------------
PER_USER = "per user"
PER_SESSION = "per session"

TOTAL_EVENTS = "total events"
MISSING_CATEGORY = "events with NULL/empty category_code"
MISSING_BRAND = "events with NULL/empty brand"
MISSING_PRICE = "events with NULL or non-positive price"
DUPLICATE_EVENTS = "duplicate events (redundant rows)"
SESSIONS_WITHOUT_VIEW = "sessions with purchase but no view"
USERS_WITHOUT_VIEW = "users with purchase but no view (ever)"

STEP_VIEWED = "Viewed"
STEP_CARTED = "Added to cart"
STEP_PURCHASED = "Purchased"
VIEW_TO_CART = "view → cart"
CART_TO_PURCHASE = "cart → purchase"

NOT_TESTABLE = "not testable (empty/zero-variance segment)"
SIGNIFICANT = "significant (survives Bonferroni)"
BORDERLINE = "borderline — significant only before correction"
NO_EVIDENCE = "no evidence of a real difference"

QUARTILE_LABEL = "Q%d ($%.0f–$%.0f)"

# --- fixed values: report thresholds and limits -----------------------------------------
QUARTILES = 4
MIN_VIEWERS = 200
TOP_CATEGORIES = 10
MIN_CARTERS = 50
MIN_CART_ADDS = 20
TOP_PRODUCTS = 15

# --- fixed values: inference ------------------------------------------------------------
ALPHA = 0.05
MIN_EXPECTED = 5
