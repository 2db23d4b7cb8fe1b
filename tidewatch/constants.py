"""Constants, word lists and patterns of the incident rules.

Patterns are written with ``\\b``, ``\\w``, ``\\W`` and ``\\s``; ``functions.text.java`` turns
these into Unicode classes for Spark.
"""

CLUSTER_DISTANCE_M = 2000.0
CLUSTER_WINDOW_S = 7200
CLUSTER_MIN_RADIUS_M = 50.0
#: Consecutive members of a cluster are at most twice the distance apart; 1 % more for the sphere.
CLUSTER_LINK_M = 4040.0
EARTH_RADIUS_CLUSTER_M = 6371008.8
EARTH_RADIUS_GEO_M = 6371000.0

GPS_RADIUS_M = 15.0
GPS_CONFIDENCE = 0.97
MAX_LANDMARK_RADIUS_M = 1500.0
NEARBY_WINDOW_S = 1200
NEARBY_SPREAD_M = 120.0
NEARBY_MIN_SAMPLES = 2

GAZETTEER = [
    ("mayur vihar phase 1", 28.6098555, 77.2926318, 500.0),
    ("mayur vihar phase-1", 28.6098555, 77.2926318, 500.0),
    ("mayur vihar", 28.6098555, 77.2926318, 600.0),
    ("mayur vihar metro", 28.6038, 77.29, 90.0),
    ("mayur vihar-i", 28.6038, 77.29, 90.0),
]
CLASS_FLOORS = {"railway": 80.0, "highway": 60.0, "bridge": 60.0, "amenity": 40.0, "shop": 40.0, "building": 25.0}
PLACE_RANK_RADII = [(28, 30.0), (25, 70.0), (21, 180.0), (17, 500.0), (14, 1200.0)]
LANDMARK_CONFIDENCE = [(40.0, 0.85), (100.0, 0.7), (300.0, 0.55), (800.0, 0.4)]
LANDMARK_CONFIDENCE_ELSE = 0.25

HAMMING_THRESHOLD = 5
MIN_TEXT_LENGTH = 12
NEAR_DUPLICATE_RATIO = 0.85
GEO_AGREEMENT_SCALE_M = 500.0
CORROBORATION_MIN_SOURCES = 3
CORROBORATION_MIN_CONFIDENCE = 70.0
CONTRADICTION_PENALTY = 45.0
PRIORITY_SEVERITY = 7.0
PRIORITY_CONFIDENCE = 70.0

HAZARDS = ["COLLAPSE", "FIRE", "FLOOD", "OTHER"]
HAZARD_WEIGHTS = {"FLOOD": 2.0, "FIRE": 3.0, "COLLAPSE": 3.0, "OTHER": 1.0}
HAZARD_LABELS = {"FLOOD": "Flooding", "FIRE": "Fire", "COLLAPSE": "Structural collapse", "OTHER": "Hazard"}
URGENT_ORDER = ["rescue_boat", "medical_evac", "ambulance", "fire_engine", "life_jackets"]
URGENT_FOR_SEVERITY = ["rescue_boat", "medical_evac", "ambulance", "fire_engine"]
RESPONDER_ORDER = ["UNACKNOWLEDGED", "ACKNOWLEDGED", "DISPATCHED", "RESOLVED"]
RESPONDER_PREFIX = "Responder"

RISK_WEIGHTS = {
    "contradiction": 0.35,
    "recycled_media": 0.20,
    "image_text_mismatch": 0.15,
    "duplicate_concentration": 0.15,
    "low_independent_ratio": 0.10,
    "weak_geo_agreement": 0.10,
    "labeled_rumour": 0.15,
}
RISK_MEDIUM, RISK_HIGH = 0.34, 0.67

MEDIA_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
MEDIA_MAX_BYTES = 8 * 1024 * 1024
SEEN_IDS_KEPT = 5000

# Patterns, all matched without regard to case.
REPOST_PREFIX = r"^\s*(?:RT|Repost|Forwarded(?:\s+update)?|Shared\s+from)\s*(?:@[A-Za-z0-9_]+)?\s*:?\s*"
NORMALIZE_PREFIX = r"^\s*(?:RT|Repost|Forwarded(?:\s+update)?|Shared\s+from)\b[:\s]*"
NOISE = r"^(?:[^\w]*|\W*(?:thoughts|prayers|stay\s+safe|sending|keep\s+believing|positive\s+energy)\b.*)$"
HAZARD_PATTERNS = {
    "COLLAPSE": r"\b(collaps\w*|caved?\s+in|given?\s+way|rubble|debris|broken\s+concrete|concrete\s+pieces|fallen\s+(?:wall|slab|railing)|crack\w*|structural\w*)\b",
    "FIRE": r"\b(fire|blaze|burning|flames?|smoke|short\s*circuit\s+spark\w*)\b",
    "FLOOD": r"\b(flood\w*|waterlog\w*|water\s+(?:rising|rises?|level|is|has|near|entered|entering|flowing|above)|submerged|inundat\w*|knee[- ]deep|waist[- ]deep|chest[- ]level|overflow\w*|drown\w*)\b",
    "OTHER": r"\b(gas\s+leak|landslide|electrocut\w*|live\s+wire|building\s+lean\w*|road\s+blocked|accident|injured|casualt\w*|trapped|stranded|stuck|unsafe|evacuat\w*)\b",
}
TRAPPED_VERBS = r"\b(trapped|stuck|stranded|waiting\s+for\s+rescue|cannot\s+(?:cross|leave|get\s+out)|unable\s+to\s+(?:cross|leave|move)|need\s+rescue|on\s+a?\s*(?:shop\s+)?roof|shouting\s+for)\b"
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "a dozen": 12, "fifteen": 15, "twenty": 20,
}
PEOPLE = r"people|persons?|residents?|children|kids|students?|families|men|women|shopkeepers?|passengers?|patients?|elderly|workers?|commuters?"
TRAPPED_COUNT = rf"\b(\d{{1,3}}|{'|'.join(NUMBER_WORDS)})\s+(?:\w+\s+)?(?:{PEOPLE})\b"
RESOURCE_PATTERNS = {
    "rescue_boat": r"\b(boats?|rescue\s+boat|raft)\b",
    "life_jackets": r"\b(life\s*jackets?|buoys?)\b",
    "rope": r"\bropes?\b",
    "first_aid": r"\bfirst\s*aid\b",
    "ambulance": r"\bambulances?\b",
    "medical_evac": r"\b(medical\s+(?:help|team|evac\w*)|paramedics?|hospital\s+support)\b",
    "fire_engine": r"\b(fire\s+(?:engine|brigade|tender))\b",
    "water_pump": r"\b(pumps?|dewater\w*)\b",
    "police_barricade": r"\b(police\s+barricade|barricades?|traffic\s+control)\b",
    "drinking_water": r"\b(drinking\s+water|clean\s+water)\b",
    "food": r"\b(food|rations?|meals?)\b",
    "power_restoration": r"\b(generator|power\s+(?:supply|backup|restor\w*)|electric\w+\s+team)\b",
    "technical_team": r"\b(technical\s+(?:team|help)|engineers?)\b",
}
ACCESS_IMPEDIMENT = r"\b(road\s+(?:blocked|closed)|blocked|not\s+passable|impassable|no\s+access|cut\s+off|cannot\s+cross|unable\s+to\s+cross|diverted|jammed|barricade\w*|turning\s+back|avoid\s+(?:the\s+)?(?:route|road|bridge)|entry\s+closed|route\s+should\s+be\s+avoided|approach\s+lane\s+is\s+no\s+longer)\b"
TIME_HINT = r"\b(just\s+now|right\s+now|a\s+few\s+minutes\s+ago|\d+\s+minutes?\s+ago|\d+\s+hours?\s+ago|since\s+morning|since\s+last\s+night|this\s+morning|this\s+afternoon|last\s+night|earlier\s+today)\b"
NAMED_LANDMARKS = [
    r"\b((?:metro\s+)?pillar\s+\d+)\b",
    r"\b(sector\s+\d+\s+(?:bridge|crossing))\b",
    r"\b(mayur\s+vihar(?:\s+phase[\s-]*\d|\s+metro(?:\s+station)?)?)\b",
]
PREPOSITION_LANDMARK = r"\b(?:near|beside|next\s+to|outside|opposite|in\s+front\s+of|at|by|close\s+to)\s+(?:the\s+)?([A-Za-z0-9][\w'’\- ]{2,40})"
CLAUSE_WORD = r"\s+(?:is|are|was|were|has|have|had|and|but|because|while|so|that|which|after|due|looks?|seems?|getting|gets|goes|going|will|can|cannot|under|with|for)\b"
STOP_LANDMARKS = ["the", "this", "that", "here", "there", "home", "it", "me", "us", "least", "lowest point", "night", "moment"]
DENIAL = r"\b(not\s+collaps\w*|has\s+not\s+collaps\w*|did\s+not\s+collapse|no\s+(?:flood\w*|fire|collapse|damage)\b|is\s+fine\b|are\s+fine\b|false\s+alarm|rumou?r|fake\s+news|nothing\s+happened|only\s+waterlogged|safe\s+and\s+intact)\b"
RUMOUR = r"\b(rumou?r|fake\s+news|hoax|unverified\s+claim)\b"
REPOST_ORIGIN = r"(?:^\s*(?:RT|repost|forwarded)\s+|\b(?:via|source|shared\s+from|reposted\s+from|forwarded\s+from)\s*:?[ \t]*)(@[A-Za-z0-9_]+)"
URL = r"https?://\S+"
MENTION = r"@[A-Za-z0-9_]+"

# Texts shown to people.
ASSESSMENT_NONE = "No material misinformation signals detected."
ASSESSMENT_TAIL = ". This is a heuristic risk estimate, not proof that any claim is false."
NOTE_SOURCES = "independent_sources is an estimate from usernames, explicit repost attribution, and image similarity - not verified unique-human identity."
NOTE_EXTERNAL = "external verification is not configured for this deployment; that signal contributes zero to confidence, not corroboration."
NOTE_NO_IMAGES = "no image-content analysis is available for this incident's media."
NOTE_SOME_IMAGES = "some attached images could not be analyzed (no vision provider configured, or the file was unreadable/unsupported)."
