"""Word lists, vocabularies, tables and thresholds.

Everything below is a FIXED VALUE: results depend on these exact words, numbers
and texts, in this order.
"""

# --- tokenising and lexical scoring (fixed values) ---------------------------
STOP_WORDS = [
    "a", "an", "the", "is", "in", "on", "at", "of", "for", "to", "and",
    "or", "with", "my", "me", "i", "this", "that", "photo", "picture",
    "image", "photos", "pictures", "images", "show", "give", "find",
]
PEOPLE_WORDS = [
    "people", "person", "group", "crowd", "family", "friends", "team",
    "couple", "man", "woman", "child", "children", "baby", "faces",
    "portrait", "selfie",
]
DOCUMENT_WORDS = [
    "receipt", "invoice", "passport", "id", "card", "ticket", "certificate",
    "document", "letter", "menu", "whiteboard", "poster", "screenshot",
    "text", "ocr", "scan", "scanned",
]
HYBRID_WEIGHTS = {
    "embedding": 0.55, "caption": 0.15, "objects": 0.10, "keywords": 0.08,
    "scene": 0.06, "ocr": 0.05, "event": 0.03, "people": 0.03, "document": 0.03,
}
CANDIDATES_PER_QUERY = 20
CONFIRMED_BOOST = 0.35
EMPTY_INDEX = "Search index is empty. Upload photos to start searching."
WHOLE_LIBRARY_QUERY = "photo"

# --- query intent (fixed values; first hit in this order wins) ---------------
INTENT_KEYWORDS = {
    "DOCUMENT": [
        "receipt", "receipts", "passport", "passports", "invoice", "invoices",
        "bill", "bills", "license", "licence", "certificate", "id", "pan card",
        "aadhaar", "driving license", "identity card", "tax", "statement",
        "ticket", "document",
    ],
    "OBJECT": [
        "car", "cars", "dog", "dogs", "cat", "cats", "person", "people", "man",
        "woman", "flower", "flowers", "boat", "boats", "bird", "birds", "phone",
        "laptop", "bicycle", "airplane", "pizza", "food", "vehicle", "pet",
        "astronaut", "shoe", "bottle", "cup", "chair", "table",
    ],
    "SCENE": [
        "beach", "beaches", "mountain", "mountains", "forest", "forests",
        "desert", "snow", "sunset", "sunsets", "city", "street", "park",
        "indoor", "indoors", "outdoor", "outdoors", "ocean", "river", "landscape",
    ],
    "TEXT": ["phone number", "email", "address", "name", "document text", "text"],
}
NOT_A_DOCUMENT_TYPE = ["other", "unknown", "none"]
CONTRADICTING_TYPES = ["receipt", "passport", "invoice"]

# --- controlled vocabularies of knowledge records (fixed values) -------------
EVENT_TYPES = [
    "birthday", "wedding", "graduation", "concert", "travel", "holiday",
    "sports", "exhibition", "party", "dinner", "picnic", "hiking", "camping",
    "christmas", "new_year", "thanksgiving", "halloween", "reunion",
    "conference", "workshop", "performance", "sporting_event",
    "family_gathering", "casual_outing", "ceremony", "other",
]
MOODS = [
    "joyful", "peaceful", "energetic", "melancholic", "romantic", "mysterious",
    "dramatic", "nostalgic", "tense", "celebratory", "serene", "playful",
    "gloomy", "unknown",
]
INDOOR_OUTDOOR = ["indoor", "outdoor", "unknown"]
WEATHERS = [
    "clear", "cloudy", "rainy", "snowy", "foggy", "stormy", "overcast",
    "windy", "hazy", "unknown",
]
SEASONS = ["spring", "summer", "autumn", "winter", "unknown"]
DOCUMENT_TYPES = [
    "receipt", "id_card", "letter", "screenshot", "whiteboard", "menu",
    "poster", "book_page", "certificate", "invoice", "ticket",
    "handwritten_note", "other",
]
SCENES = [
    "beach", "mountain", "cityscape", "park", "restaurant", "office", "home",
    "school", "gym", "forest", "desert", "garden", "street", "store", "museum",
    "airport", "concert_hall", "stadium", "hotel", "classroom", "unknown",
]
NULL_WORDS = ["null", "n/a", "none"]
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]
TEXT_LIMITS = {
    "caption": 500, "detailed_description": 4000, "detected_text": 4000,
    "location_guess": 200,
}
LIST_LIMITS = {"objects": 30, "activities": 20, "keywords": 20, "dominant_colors": 5}

# --- statuses (fixed values) --------------------------------------------------
ASSET_STATUSES = ["UPLOADED", "PROCESSING", "READY", "FAILED"]
ANALYSIS_STATUSES = [
    "PENDING", "PROCESSING", "COMPLETED", "FAILED", "SKIPPED_NO_PROVIDER",
]
ASSET_ERROR_CHARS = 1000
ANALYSIS_ERROR_CHARS = 2000

# --- local labelling (fixed values) -------------------------------------------
SCENE_LABELS = [
    "indoor room", "outdoor landscape", "mountain landscape", "sandy beach",
    "garden flowers", "city skyline", "forest trees", "office desk", "kitchen",
    "desert sand", "sunset sky",
]
OBJECT_LABELS = [
    "analog clock", "flower garden", "car vehicle", "dog pet", "cat pet",
    "mountain", "tree", "building", "boat vessel", "receipt document",
    "passport document", "laptop computer", "phone", "person people",
    "food meal", "sandy beach", "bird animal", "bicycle bike", "furniture room",
]
SCENE_RULES = ["mountain", "beach", "garden", "city", "forest", "sunset", "desert", "outdoor"]
OBJECT_RULES = [
    "clock", "flower", "mountain", "tree", "car", "dog", "cat", "boat",
    "building", "receipt", "passport", "person", "food", "beach", "bird",
    "bicycle", "furniture",
]
DOCUMENT_RULES = ["receipt", "passport"]
INDOOR_SCENES = ["indoor", "office", "kitchen"]
SCENE_OBJECTS = {
    "beach": ["ocean", "sand"], "mountain": ["mountain", "sky"],
    "garden": ["flower", "plant"], "city": ["building", "street"],
    "forest": ["tree", "forest"],
}
TEMPLATE_WORDS = [
    "filename", "jpg", "jpeg", "png", "image", "photo", "photos",
    "aspect", "ratio", "width", "height", "pixels", "px", "0000", "0001",
    "with", "and", "the", "for", "from", "resized", "dark", "bright",
    "blurred", "rotated",
]
TOPIC_WORDS = {
    "clock": ["analog", "time", "dial", "wall"],
    "flower": ["blossom", "flora", "garden", "nature"],
    "mountain": ["peak", "landscape", "outdoors", "scenery"],
    "beach": ["ocean", "sand", "waves", "coast"],
}
KEYWORD_VALUE = 0.85
PALETTE = [
    ("black", 0, 0, 0), ("white", 255, 255, 255), ("gray", 128, 128, 128),
    ("red", 255, 0, 0), ("green", 0, 128, 0), ("blue", 0, 0, 255),
    ("yellow", 255, 255, 0), ("orange", 255, 165, 0), ("purple", 128, 0, 128),
    ("brown", 165, 42, 42), ("pink", 255, 192, 203),
]
METRIC_KEYS = ["p_hash", "blur_score", "brightness", "darkness", "sharpness", "is_screenshot"]

# --- quality (fixed values) ---------------------------------------------------
QUALITY_WEIGHTS = {"sharpness": 0.35, "exposure": 0.30, "aesthetic": 0.25, "resolution": 0.10}
GRADES = [("EXCELLENT", 0.85), ("GOOD", 0.70), ("FAIR", 0.50), ("POOR", 0.30)]
WORST_GRADE = "VERY_POOR"
QUALITY_THRESHOLDS = {
    "very_blurry": 60.0, "brightness_low": 0.15, "brightness_high": 0.92,
    "min_megapixels": 0.5, "full_megapixels": 12.0,
}
ISSUE_TEXTS = {
    "LOW_EXPOSURE": "appears underexposed",
    "OVER_EXPOSURE": "appears overexposed",
    "OUT_OF_FOCUS": "is out of focus",
    "MOTION_BLUR": "has motion blur",
    "LOW_RESOLUTION": "has low resolution",
    "HIGH_NOISE": "has high sensor noise",
    "LENS_OBSTRUCTION": "may have a lens obstruction",
    "UNKNOWN": "has an unspecified quality problem",
}
REVIEW_LABELS = {
    "MOTION_BLUR": "Out of focus / motion blur",
    "OUT_OF_FOCUS": "Out of focus",
    "UNDEREXPOSED": "Underexposed",
    "OVEREXPOSED": "Overexposed",
    "LOW_RESOLUTION": "Low resolution",
    "NOISY": "High noise",
    "LENS_OBSTRUCTION": "Lens obstruction",
}
ANTONYM_PROMPTS = [
    ("a high quality photo", "a low quality photo"),
    ("a clear, clean photograph", "a blurry, distorted photograph"),
    ("a beautiful, well-composed photo", "an unappealing, poor photo"),
]
PROMPT_TEMPERATURE = 0.1

# --- screenshots (fixed values) -----------------------------------------------
SCREENSHOT_RATIOS = [1.7778, 1.6, 1.3333, 2.3333, 0.5625, 2.1667, 2.1111, 2.2222, 0.75, 0.4615]
SCREENSHOT_SIZES = [
    (1920, 1080), (1080, 1920), (1280, 720), (720, 1280), (2560, 1440),
    (1440, 2560), (3840, 2160), (2160, 3840), (1440, 900), (1680, 1050),
    (1080, 2400), (2400, 1080), (1170, 2532), (2532, 1170), (1284, 2778),
    (2778, 1284),
]

# --- duplicate and similarity rules (fixed values) -----------------------------
GENERIC_WORDS = [
    "photo", "photos", "image", "images", "picture", "pictures",
    "outdoor", "outdoors", "indoor", "indoors", "nature", "landscape",
    "sky", "tree", "trees", "grass", "field", "fields", "cloud", "clouds",
    "scene", "scenes", "view", "views", "background", "color", "colors",
    "light", "lighting", "shot", "front", "close-up", "day", "daytime",
    "night", "overall", "small", "large", "high", "low", "wood", "wooden",
    "floor", "table", "wall", "room",
]
EDITED_NAME = "^(dark|bright|cropped|rotated|resized|blurred|edited|compressed|scaled|small|thumb)_+"
EDIT_PREFIXES = ["resized_", "dark_", "bright_", "blurred_", "rotated_"]
WORD_BREAKS = "[\\s,._\\-:;!?\"'()]+"
BEACH_LEFT = ["beach", "coast", "ocean", "sea", "sunset"]
BEACH_RIGHT = ["beach", "coast", "ocean", "sea", "dusk"]
MOUNTAIN_LEFT = ["mountain", "valley", "hill", "peak"]
MOUNTAIN_RIGHT = ["mountain", "valley", "hill", "landscape"]
INDOOR_RIGHT = ["floor", "room", "kitchen", "office"]
INDOOR_LEFT = ["floor", "room"]
MONOCHROME = ["black", "white", "gray"]
NEAR_RADIUS = 4
SIMILAR_RADIUS = 8
RECEIPT_WORDS = ["receipt", "invoice", "total", "payment"]
ID_TEXT_WORDS = ["passport", "driving license", "pan card", "aadhaar", "identity card"]
ID_CAPTION_WORDS = ["passport", "id card"]
ID_AUDIT_WORDS = ["passport", "driving license", "pan card", "aadhaar", "identity card", "id card"]

# --- library (fixed values) -----------------------------------------------------
RETENTION_DAYS = 30
CAPACITY_BYTES = 50 * 1024 * 1024 * 1024
THUMBNAIL_BYTES = 15 * 1024
DEFAULT_COLLECTIONS = [
    ("beach", "Beaches", "Sandy shores and ocean horizons", ["beach", "ocean", "sea", "sand"]),
    ("dog", "Dogs", "Your favorite furry companions", ["dog", "puppy", "canine", "pet"]),
    ("food", "Food", "Gastronomic adventures and dishes", ["food", "dish", "meal", "cooking", "restaurant"]),
    ("receipt", "Receipts", "Scanned documents and bills", ["receipt", "bill", "invoice"]),
    ("college", "College", "Campus days and class memories", ["college", "campus", "university", "classroom"]),
    ("car", "Vehicles", "Cars, drives, and trips", ["car", "vehicle", "automobile", "drive"]),
    ("mountain", "Mountains", "High peaks and forest trails", ["mountain", "hiking", "trail", "peak"]),
    ("document", "Documents", "Invoices, notes, and records", ["document", "text", "paper", "notes"]),
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
