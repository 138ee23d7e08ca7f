"""Word lists, patterns and constants that decide the results.

Everything in this module is data, not logic. Patterns are written for Java's regex
engine: ``(?U)`` gives Unicode classes, ``(?iU)`` Unicode case folding as well.
"""

from __future__ import annotations

# ---- fixed values: digits -------------------------------------------------------
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EASTERN_ARABIC_INDIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹"

# ---- fixed values: white space and links ----------------------------------------
# Unicode white space, spelled out because a property class is much slower to match.
# Java's plain \s covers the first range; the others are rare in text.
RARE_SPACE_CHARS = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = rf"\t-\r {RARE_SPACE_CHARS}"
LINK = rf"[hH][tT][tT][pP][sSſ]?://[^{SPACE_CHARS}]+"
LINK_TRAILERS = ".,؛،)؟]"

# ---- fixed values: phone numbers ------------------------------------------------
HOME_COUNTRY_CODE = "216"
HOME_REGION = "TN"
HOME_PREFIX = r"^[234579]\d$"
NANP_NATIONAL = r"^[2-9]\d{2}[2-9]\d{6}$"
PHONE_DIGIT_COUNTS = (8, 11, 13)
# Country code: lengths of its national numbers (public numbering plans; home and North America have rules of their own).
OTHER_COUNTRIES = {
    "7": (10,), "20": (8, 9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9),
    "39": (9, 10, 11), "40": (9,), "41": (9,), "43": (9, 10, 11), "44": (9, 10), "45": (8,), "46": (7, 8, 9), "47": (8,),
    "48": (9,), "49": (9, 10, 11), "51": (8, 9), "52": (10,), "54": (10, 11), "55": (10, 11), "56": (9,), "57": (10,),
    "58": (10,), "60": (8, 9, 10), "61": (9,), "62": (8, 9, 10, 11), "63": (10,), "64": (8, 9, 10), "65": (8,), "66": (8, 9),
    "81": (9, 10), "82": (8, 9, 10), "84": (9, 10), "86": (10, 11), "90": (10,), "91": (10,), "92": (9, 10), "93": (9,),
    "94": (9,), "95": (8, 9, 10), "98": (10,), "212": (9,), "213": (8, 9), "218": (8, 9), "220": (7,), "221": (9,),
    "222": (8,), "223": (8,), "224": (9,), "225": (10,), "226": (8,), "227": (8,), "228": (8,), "229": (8, 10),
    "230": (7, 8), "231": (8, 9), "233": (9,), "234": (8, 10), "235": (8,), "236": (8,), "237": (9,), "238": (7,),
    "240": (9,), "241": (7, 8), "242": (9,), "243": (9,), "244": (9,), "249": (9,), "250": (9,), "251": (9,), "252": (8, 9),
    "253": (8,), "254": (9,), "255": (9,), "256": (9,), "257": (8,), "258": (8, 9), "260": (9,), "261": (9,), "263": (9,),
    "351": (9,), "352": (8, 9), "353": (8, 9), "354": (7,), "355": (8, 9), "356": (8,), "357": (8,), "358": (8, 9, 10),
    "359": (8, 9), "370": (8,), "371": (8,), "372": (7, 8), "373": (8,), "374": (8,), "375": (9,), "377": (8, 9),
    "380": (9,), "381": (8, 9), "382": (8,), "383": (8,), "385": (8, 9), "386": (8,), "387": (8,), "389": (8,),
    "420": (9,), "421": (9,), "502": (8,), "503": (8,), "504": (8,), "505": (8,), "506": (8,), "507": (7, 8), "591": (8,),
    "593": (8, 9), "595": (9,), "598": (8,), "852": (8,), "853": (8,), "855": (8, 9), "856": (8, 10), "880": (10,),
    "886": (8, 9), "960": (7,), "961": (7, 8), "962": (8, 9), "963": (8, 9), "964": (8, 10), "965": (8,), "966": (9,),
    "967": (7, 8, 9), "968": (8,), "970": (8, 9), "971": (8, 9), "972": (8, 9), "973": (8,), "974": (8,), "975": (8,),
    "976": (8,), "977": (8, 10), "992": (9,), "993": (8,), "994": (9,), "995": (9,), "996": (9,), "998": (9,),
}
PHONE_CONTEXT_RADIUS = 28
PHONE_MARKER_REACH = 24
PHONE_MARKER = (
    r"(?iU)(?:tel|tél|telephone|téléphone|phone|whatsapp|watsap|واتساب|هاتف|تلفون|اتصل|☎|📞)"
    rf"[{SPACE_CHARS}]*[:：\-]?[{SPACE_CHARS}]*$"
)
DATE_SHAPE = r"^\s*\d{1,2}[./\-]\d{1,2}[./\-](?:20)?\d{2}\s*$"
SIZE_CONTEXT = (
    r"(?iU)(taille|tailles|size|sizes|mesure|mesures|cm|mètre|metre|pcs|pi[eè]ces|"
    r"quantit[eé]|quantity|مقاس|مقاسات|قياس|كمية|قطع)"
)
PRICE_CONTEXT = r"(?iU)(prix|price|dt|tnd|dinars?|دينار|السوم|الثمن|tarif|د)"
# First digit of the local number -> line kind (public national numbering plan).
HOME_LINE_KINDS = {"2": "mobile", "4": "mobile", "5": "mobile", "9": "mobile", "7": "landline"}

# ---- fixed values: lead text ----------------------------------------------------
# Offer and need patterns are matched on lower-cased sentences, so they need no slow case flags.
SENTENCE_BREAK = r"(?<=[.!?؟؛\n]) +"
NEED = (
    r"(cherche|recherche|besoin|needed?|looking for|want(?:ed)?|مطلوب|نلوج|نحب|نحتاج|يلزم|انتداب|ننتدب|"
    r"نشرى|نشتري|نبغي|نلقا|فما|شكون|وين|كيفاش|بقداش|قداش|سعر|ثمن|combien|prix|price|dispo\?|available\?)"
)
OFFER = (
    r"(atelier|usine|factory|sous[- ]?trait|fa[çc]on|tissu|fabric|couture|confection|نخدم|نقبل|نوفر|متوفر|"
    r"للبيع|نبيع|خياطة|خياط|خيط|مصنع|معمل|قماش|موداليست|modeliste|styliste|designer|couturier|needle|tricot|"
    r"knit|crochet|تريكو|حياكة|تفصيل|تفصيلة|مرحبا\s+بيك|مرحبا\s+في|ااجا|انخيط|اخيط|نخيط|نخدم|na5dem|"
    r"na5demlek|n5dm|disponible|available|j'ai|3andi|عندي|موجود)"
)
NAME_PATTERNS = (
    r"(?iU)(?:^|\b)(?:atelier|soci[eé]t[eé]|ste|factory|usine|contact|chez)\s+([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ' .\-]{2,60})",
    r"(?iU)(?:اسمي|أنا|انا|معكم|السيد|السيدة|شركة|مصنع|معمل|ورشة|أتيلي|اتيلي)\s*[:\-،]?\s*"
    r"([\u0600-\u06FFA-Za-zÀ-ÿ][\u0600-\u06FFA-Za-zÀ-ÿ' .\-]{2,60})",
    r"(?iU)(?:name|nom)\s*[:\-]\s*([\u0600-\u06FFA-Za-zÀ-ÿ][\u0600-\u06FFA-Za-zÀ-ÿ' .\-]{2,60})",
)
NAME_EDGE_CHARS = " -،:؛.\n\t"
NAME_CUT = r"(?iU)(?:\s{2,}|[.!?؟؛]|tel|tél|phone|☎|📞)"
NAME_LENGTH = (2, 80)
SENTENCE_CAP = 280
WHAT_FALLBACK = "Detected intent: "
WHY_FALLBACK = "Not explicitly stated"

# ---- fixed values: intents ------------------------------------------------------
INTENTS = ("atelier", "factory", "subcontractor", "fabric_supplier", "job_offer", "other")
INTENT_PRIORITY = {
    "job_offer": 5,
    "subcontractor": 4,
    "fabric_supplier": 3,
    "factory": 2,
    "atelier": 1,
    "other": 0,
}
EXCERPT_RADIUS = 60
EXCERPT_CAP = 200
EXCERPT_MISS_CAP = 160

# ---- fixed values: merging ------------------------------------------------------
RAW_TEXT_SEPARATOR = "\n---\n"
RAW_TEXT_CAP = 20_000

# ---- fixed values: runs ---------------------------------------------------------
SOURCE_MODES = ("live", "cached")
RUN_STATUSES = (
    "live_success",
    "live_failed_cache_used",
    "cache_only",
    "blocked",
    "login_wall",
    "empty_or_markup_changed",
    "network_error",
    "parser_error",
)
SUCCESS_STATUSES = ("live_success", "live_failed_cache_used", "cache_only")
ERROR_DETAIL_CAP = 2000

# ---- fixed values: page status markers ------------------------------------------
LOGIN_MARKERS = (
    "login.php",
    "Log in to Facebook",
    "Log Into Facebook",
    "You must log in",
    "تسجيل الدخول",
    "Connectez-vous",
)
BLOCK_MARKERS = (
    "temporarily blocked",
    "You Can't Use This Feature Right Now",
    "rate limit",
    "captcha",
    "checkpoint",
)
BLOCKED_HTTP_CODES = (401, 403, 429)
ERROR_TITLE_AR = "<title>خطأ</title>"
ERROR_TITLE_EN = "<title>Error</title>"
SMALL_CARD_CHARS = 5000
MIN_POST_CHARS = 18

# ---- fixed values: links to posts -----------------------------------------------
POST_LINK_HINTS = ("/posts/", "/permalink/", "/videos/", "/photos/", "/story")
POST_PATH_WORDS = ("posts", "videos", "photos", "watch", "story", "permalink")
POST_QUERY_KEYS = ("story_fbid", "fbid", "v", "photo_id", "id")
DEFAULT_SITE_DOMAIN = "facebook.com"
DEFAULT_SITE_BASE = "https://www.facebook.com"
DEFAULT_RELATIVE_BASE = "https://mbasic.facebook.com"

# ---- fixed values: exported columns ---------------------------------------------
EXPORT_COLUMNS = (
    "id",
    "phone_raw",
    "phone_normalized",
    "name",
    "what",
    "why",
    "intent",
    "intent_confidence",
    "intent_matched_keywords",
    "intent_raw_excerpt",
    "first_seen",
    "last_seen",
    "post_count",
    "links",
    "source_group_id",
    "raw_text",
)

# ---- fixed values: activity window ----------------------------------------------
ACTIVITY_WINDOW_SECONDS = 60
ACTIVITY_CAP = 8
