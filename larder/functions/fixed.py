"""Word lists, lookup tables, constants and patterns.

Everything in this module is data that results depend on. Where order matters
(first match wins) the order of the entries is part of the value.
"""

# --- visibility and job states ------------------------------------------------
HIDDEN_STATUSES = ["quarantined", "rejected"]
OPEN_JOB_STATUSES = ["pending", "processing", "cooling_down"]
LIGHT_FIELDS = ["id", "name", "image", "description", "cook_time", "prep_time"]

# --- ingredient term cleaning -------------------------------------------------
TERM_PUNCTUATION = r"[.,/#!$%^&*;:{}=\-_`~()]"
PREPARATION_WORDS = [
    "melted", "softened", "chopped", "sliced", "diced", "minced", "crushed", "beaten",
    "sifted", "warm", "cold", "hot", "boiling", "room temperature", "granulated",
    "all-purpose", "all purpose", "dried", "raw", "cooked", "steamed", "baked", "fried",
    "grilled",
]
TERM_MAPPINGS = {
    "milk": "milk whole",
    "egg": "egg whole",
    "eggs": "egg whole",
    "flour": "flour wheat all-purpose",
    "sugar": "sugar granulated",
    "butter": "butter salted",
    "rice": "rice white raw",
    "white rice": "rice white raw",
    "oats": "oats rolled raw",
    "rolled oats": "oats rolled raw",
    "pasta": "pasta dry",
}
CACHE_KEY_VERSION = "v9"

# --- ingredient lines: quantity, unit, name -----------------------------------
LINE_PATTERN = r"^((?:\d+\s+)?\d+/\d+|\d+(?:\.\d+)?|\d+)\s*([a-zA-Z]+)?\s+(.*)$"

# grams per unit
WEIGHT_UNITS = [
    (["g", "gram"], 1.0),
    (["kg", "kilogram"], 1000.0),
    (["oz", "ounce"], 28.35),
    (["lb", "pound"], 453.59),
]
# millilitres per unit
VOLUME_UNITS = [
    (["ml", "milliliter"], 1.0),
    (["l", "liter"], 1000.0),
    (["cup", "c"], 236.59),
    (["tbsp", "tablespoon", "tbs", "T"], 14.79),
    (["tsp", "teaspoon", "tspn", "t"], 4.93),
    (["fl oz", "floz"], 29.57),
    (["pint", "pt"], 473.18),
    (["quart", "qt"], 946.35),
    (["gallon", "gal"], 3785.41),
]
# grams per counted unit
COUNT_UNITS = [
    (["pinch", "pn"], 0.3),
    (["dash"], 0.6),
    (["slice"], 30.0),
    (["clove"], 5.0),
]
# grams per millilitre, first key contained in the name wins
DENSITIES = [
    ("flour", 0.55),
    ("sugar", 0.85),
    ("brown sugar", 0.93),
    ("butter", 0.96),
    ("oil", 0.92),
    ("oats", 0.40),
    ("rice", 0.85),
    ("milk", 1.03),
    ("cream", 1.01),
    ("honey", 1.42),
    ("molasses", 1.40),
    ("syrup", 1.35),
    ("water", 1.0),
    ("cocoa", 0.45),
    ("powdered sugar", 0.50),
    ("cornstarch", 0.55),
    ("cheese", 0.45),
    ("nuts", 0.60),
    ("spinach", 0.12),
    ("lettuce", 0.15),
]
DEFAULT_DENSITY = 1.0
# grams per piece: every keyword group of an entry must occur; first entry wins
PIECE_WEIGHTS = [
    ([["egg"]], 50.0),
    ([["banana"]], 120.0),
    ([["apple"]], 180.0),
    ([["slice"]], 30.0),
    ([["bread"]], 30.0),
    ([["chicken"], ["breast", "thigh"]], 200.0),
    ([["avocado"]], 150.0),
    ([["onion"]], 110.0),
    ([["carrot"]], 60.0),
    ([["potato"]], 213.0),
]
DEFAULT_PIECE_WEIGHT = 100.0
DEFAULT_SERVING_G = 100.0

# household portions: units of a line -> words a portion's measure may contain
PORTION_CLASSES = {
    "cup": (["cup"], ["cup"]),
    "tbsp": (["tbsp", "tablespoon"], ["tbsp", "tablespoon"]),
    "tsp": (["tsp", "teaspoon"], ["tsp", "teaspoon"]),
    "slice": (["slice"], ["slice"]),
    "oz": (["oz"], ["oz"]),
    "piece": ([""], ["large", "small", "medium", "item", "whole"]),
}

# --- nutrients ----------------------------------------------------------------
NUTRIENT_IDS = {
    "calories": 1008,
    "protein": 1003,
    "fat": 1004,
    "carbs": 1005,
    "fiber": 1079,
    "sugar": 2000,
    "calcium_mg": 1087,
    "iron_mg": 1089,
    "vitamin_a_mcg": 1106,
    "vitamin_c_mg": 1162,
}
NUTRIENTS = list(NUTRIENT_IDS)
WHOLE_NUMBER_NUTRIENTS = ["calories", "protein", "fat", "carbs", "calcium_mg", "vitamin_a_mcg"]
ONE_DECIMAL_NUTRIENTS = ["iron_mg", "vitamin_c_mg"]

# --- food choice --------------------------------------------------------------
PROCESSED_FOOD = (
    "dried|dehydrated|powder|chip|candied|syrup|baked|fried|roasted|grilled|boiled|"
    "stewed|canned|cooked|mix|soup|stew|salad"
)
LOW_CALORIE_QUERY = (
    "water|salt|diet|tea|coffee|soda|coke|pepsi|spice|seasoning|baking powder|baking soda"
)
DATA_TYPE_SCORES = {"SR Legacy": 100, "Foundation": 90, "Survey (FNDDS)": 50}
CANDIDATES_PER_TERM = 5

# --- quality ------------------------------------------------------------------
GATE_SCORE = 60
AUDIT_SCORE = 90
MAX_RETRIES = 3

# --- message texts ------------------------------------------------------------
AUDIT_TEXTS = {
    "repaired": "Auto-repaired image URL from JSON object.",
    "bad image": "Image URL failed validation: {}",
    "no image": "Missing image.",
    "no instructions": "Missing instructions.",
    "enriched": "Enriched nutrition.",
    "no nutrition": "Missing nutrition (lookup failed).",
    "low score": "Quarantined: Low quality score ({}/100).",
    "scheduled": "Scheduled auto-repair crawl (Attempt {}).",
    "exhausted": "Auto-repair exhausted. Permanently hiding (Rejected).",
    "no url": "Cannot auto-repair: No source URL.",
}
RECRAWL_LOG = "Auto-repair triggered by the audit (low quality score)"
ARCHIVE_LOG = "Archived/Stopped by user"
DEFAULT_DESCRIPTION = "A delicious recipe for {}."
LAST_LOG_DEFAULT = "Routine check"

# --- pages --------------------------------------------------------------------
BLOCK_STATUSES = [403, 429]
BLOCK_TITLES = ["Access Denied", "Just a moment..."]
BLOCK_BODY = "Access Denied"
EXCLUDED_PATHS = ["about", "contact", "privacy-policy", "login", "cart"]
# a directory called recipe, or a last path segment containing the word
RECIPE_LINK = r"/recipe/|/[^/]*recipe[^/]*$"
DOM_NAME = [".wprm-recipe-name", ".entry-title", "h1"]
DOM_DESCRIPTION = [".wprm-recipe-summary", ".entry-content p"]
DOM_INGREDIENTS = [".wprm-recipe-ingredient", ".wprm-recipe-ingredient-name", "li.ingredient"]
DOM_INSTRUCTIONS = [
    ".wprm-recipe-instruction-text", ".wprm-recipe-instruction", ".instructions li",
]
DOM_IMAGE = [
    ".wprm-recipe-image img", ".wprm-recipe-image-container img", ".entry-content img",
]

# --- text search --------------------------------------------------------------
WORD_BREAK = r"[^\p{L}\p{N}]+"
SIMILARITY_THRESHOLD = 0.3
POSITION_WEIGHT = 0.1
RANK_NORM = 1.64493406685
SEARCH_LIMIT = 50
# the published Snowball list for English
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()

# --- publishing ---------------------------------------------------------------
SITE_PAGES = ["", "/recipes", "/lab", "/docs"]
URLS_PER_SITEMAP = 50000
SITEMAP_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
]
SITEMAP_FOOT = "</urlset>"
SITEMAP_INDEX_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
]
SITEMAP_INDEX_FOOT = "</sitemapindex>"
SITEMAP_ENTRY = "  <sitemap><loc>{site}</loc></sitemap>"
STATIC_LINE = "  <url><loc>{site}{page}</loc><changefreq>daily</changefreq></url>"
RECIPE_LINE = "  <url><loc>{site}/recipe/%s</loc><lastmod>%s</lastmod></url>"

# --- keys ---------------------------------------------------------------------
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
MIN_INTERVAL_SECONDS = 60
