"""URL, link, page and menu-text vocabularies."""

from __future__ import annotations

# --- Fixed values: menu words ---------------------------------------------------
STRICT_MENU_WORDS = [
    "menu", "menus", "lunch", "dinner", "brunch", "breakfast", "dining", "nutrition", "allergen", "allergens", "allergy",
    "dietary", "gluten", "vegan", "vegetarian", "carta", "menú", "carte", "speisekarte", "karte", "menü", "cardápio",
    "cardapio", "ementa", "menukaart", "メニュー", "お品書き", "品書き", "菜单", "菜單", "餐牌", "菜谱", "메뉴", "เมนู", "मेन्यू", "मेनू",
    "قائمة", "منيو", "меню", "thực đơn", "thuc don", "jadalnia", "jelovnik",
]
SECONDARY_MENU_WORDS = [
    "order", "ordering", "takeout", "take-out", "delivery", "catering", "food", "drinks", "beverages", "wine", "cocktails",
    "desserts", "prix fixe", "a la carte", "tasting", "carte des vins",
]
MENU_ITEM_HINTS = [
    "appetizer", "appetizers", "entree", "entrees", "salad", "salads", "sandwich", "sandwiches", "burger", "pizza",
    "pasta", "dessert", "desserts", "beverage", "beverages", "soup", "noodles", "rice", "chicken", "beef", "pork", "tofu",
]
ORDERING_HOSTS = [
    "beyondmenu", "toasttab", "square.site", "chownow", "doordash", "ubereats", "grubhub", "olo.com", "order.online",
    "bento-order",
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
LOCATION_PATH_WORDS = [
    "cupertino", "sunnyvale", "santa-clara", "santaclara", "san-jose", "sanjose", "fremont", "dublin", "milpitas",
    "mountain-view", "mountainview", "palo-alto", "paloalto",
]
# --- Fixed values: link kind -> words, tried in this order ------------------------
LINK_KINDS: list[tuple[str, list[str]]] = [
    ("allergy_info", [
        "allergy-friendly", "allergy friendly", "allergy policy", "food allergy", "allergy advice", "dietary requirement",
        "may contain",
    ]),
    ("allergen", ["allerg", "allergi", "allergè", "alergen", "アレルゲン", "过敏", "過敏", "알레르", "αλλεργ", "аллерг"]),
    ("nutrition", ["nutrition", "nutritional", "nutri", "nährwert", "valeurs nutri", "栄養", "营养", "영양", "διατροφ", "naering"]),
    ("menu", [
        "menu", "carte", "speisekarte", "メニュー", "菜单", "菜單", "메뉴", "carta", "speise", "meny", "spisekart", "matseddel",
        "ruokalista", "cardapio", "cardápio", "jadlospis", "jelovnik", "karte", "μενού", "μενου", "меню", "meniu",
        "menukaart", "etlap", "jidelni", "תפריט", "منيو", "เมนู", "मेन्यू", "मेनू",
    ]),
]
KIND_PRIORITY = {"allergen": 0, "allergy_info": 1, "nutrition": 2, "menu": 3}
HOP_PRIORITY = {"allergen": 0, "nutrition": 1, "allergy_info": 2, "menu": 3}
SECOND_HOP_WORDS = [
    "menu", "food", "lunch", "dinner", "breakfast", "brunch", "drink", "wine", "cocktail", "beverage", "allergen",
    "allergy", "nutrition", "dietary", ".pdf",
]
HOP_IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tiff"]
ALLERGEN_PROBE_PATHS = [
    "/allergens", "/allergen", "/allergy", "/allergen-menu", "/allergens-menu", "/allergen-information", "/allergen-info",
    "/allergy-information", "/food-allergens", "/allergen-guide", "/allergen-chart", "/allergen-matrix", "/nutrition",
    "/nutritional-information", "/dietary", "/dietary-information",
]
ALLERGEN_PDF_PATHS = [
    "/allergens.pdf", "/allergen.pdf", "/allergen-menu.pdf", "/allergens-menu.pdf", "/allergen-guide.pdf",
    "/allergen-chart.pdf", "/allergen-matrix.pdf", "/allergen-information.pdf", "/menu-allergens.pdf", "/allergy.pdf",
    "/nutrition.pdf", "/dietary.pdf", "/allergens-and-nutrition.pdf",
]
# --- Fixed values: hosts --------------------------------------------------------
TWO_LEVEL_TLDS = [
    "co.uk", "org.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.za", "com.sg", "co.in", "com.mx", "co.kr",
    "com.hk", "com.tw",
]
SOCIAL_DOMAINS = [
    "instagram.com", "facebook.com", "fb.com", "fb.me", "tiktok.com", "twitter.com", "x.com", "youtube.com", "youtu.be",
    "linkedin.com", "pinterest.com", "snapchat.com", "threads.net", "wa.me", "t.me", "vk.com", "weibo.com",
]
MAPS_HINTS = ["maps.google.", "google.com/maps", "goo.gl/maps", "maps.app.goo.gl"]
PROFILE_LINK_HOSTS = ["instagram.com", "facebook.com", "tiktok.com", "twitter.com", "x.com"]
SHARED_PLATFORM_HOSTS = [
    "facebook.com", "instagram.com", "toasttab.com", "order.online", "square.site", "sites.google.com", "business.site",
    "linktr.ee", "clover.com", "yelp.com", "doordash.com", "ubereats.com", "grubhub.com", "wixsite.com",
    "godaddysites.com", "wordpress.com", "weebly.com", "blogspot.com",
]
NON_OFFICIAL_HOSTS = [
    "allmenus.com", "bbb.org", "buzzfile.com", "chamberofcommerce.com", "city-data.com", "clustrmaps.com", "doordash.com",
    "facebook.com", "find-open.com", "findmeglutenfree.com", "foursquare.com", "google.com", "grubhub.com",
    "instagram.com", "loc8nearme.com", "mapquest.com", "menupix.com", "menupages.com", "manta.com", "nicelocal.com",
    "opentable.com", "places.singleplatform.com", "restaurantguru.com", "restaurantji.com", "seamless.com", "sirved.com",
    "tripadvisor.", "ubereats.com", "usarestaurants.info", "wheree.com", "whereorg.com", "yellowpages.com", "yelp.",
    "zmenu.com",
]
DIRECTORY_HOST_HINTS = ["business", "directory", "listing", "places", "reviews", "restaurants"]
MENU_PLATFORM_HINTS = ["beyondmenu.com", "toasttab.com", "chownow.com", "clover.com", "square.site"]
NAME_STOPWORDS = ["and", "bar", "cafe", "coffee", "food", "grill", "kitchen", "llc", "restaurant", "the"]
GENERIC_CATEGORY_WORDS = ["amenity", "bar", "cafe", "catering", "food", "meal", "primary", "restaurant", "restaurants", "type"]
# --- Fixed values: data endpoints ---------------------------------------------------
ENDPOINT_HINTS = ["/api/", ".json", "/graphql", "allergen", "nutrition", "menu", "/items", "/products", "/content", "/catalog"]
ENDPOINT_HOSTS = ["contentful", "prismic", "sanity", "datocms", "graphcms", "cloudfront", "amazonaws", "googleapis", "cdn."]
ENDPOINT_SKIP = [
    ".js", ".mjs", ".css", ".png", ".jpg", ".jpeg", ".svg", ".webp", ".gif", ".woff", ".woff2", ".ttf", ".ico", ".map",
    ".mp4", ".pdf",
]
APP_ROOT_MARKS = ['id="root"', 'id="app"', "__next_data__", "ng-version", "data-reactroot"]
# --- Fixed values: dish-name gates ---------------------------------------------------
NAME_CONNECTORS = ["and", "&", "of", "the", "with", "a", "an", "to", "de", "la"]
NAME_END_CONNECTORS = [" with", " and", " of", " the", " in", " on", " to", " or", " a", " for",
                       " de", " la", " du", " &", ",", "-", "+", "/", ":"]
CATEGORY_LINES = [
    "appetizers", "starters", "small plates", "shared plates", "large plates", "plates", "snacks", "salads", "soups",
    "entrees", "mains", "sandwiches", "bowls", "noodles", "rice", "desserts", "sweets", "drinks", "beverages", "cocktails",
    "beer", "wine", "coffee", "tea", "lunch", "dinner", "brunch", "breakfast", "sides", "vegetarian", "vegan", "water",
    "coffee tea", "juice lemonade soda", "sparkling wine rose", "white wine", "red wine", "breakfast plates",
    "bread and pastries", "bread pastries", "salads soup", "salads soups", "burgers", "pancakes", "kids menu",
    "homemade desserts", "to share to add", "to share", "to add",
]
NEGATIVE_ITEM_WORDS = [
    "free shipping", "terms apply", "gifts under", "gift boxes", "wishlist", "choose price range", "gratuity",
    "take out/delivery", "delivery orders", "your cart", "shopping cart", "checkout", "subtotal", "service fee",
]
TOTAL_WORDS = ["subtotal", "total", "delivery", "service fee"]
NON_DISH_EXACT = [
    "about", "about us", "contact", "contact us", "home", "login", "log in", "logout", "register", "gallery", "careers",
    "jobs", "press", "blog", "news", "faq", "faqs", "locations", "location", "shop", "store", "stores", "hours",
    "directions", "subscribe", "menu", "menus", "order", "order online", "cart", "reservations", "reservation", "events",
    "gift cards", "gift card", "merch", "newsletter", "privacy", "terms", "search", "more", "all", "français", "english",
    "español", "fr en", "en fr", "tote bags", "tote bag", "our story", "our team", "the team", "book", "book now",
    "book a table", "find us", "all locations", "all cities", "select filter option", "select location", "canada",
    "united states", "usa", "discover", "open menu", "view menu", "delivery", "pickup", "takeout", "catering",
    "private events", "event venues", "getting here", "where to stay", "things to do", "our partners", "eat & drink",
]
NON_DISH_PHRASES = [
    "follow us", "sign in", "sign up", "add to cart", "view menu", "read more", "learn more", "download", "app store",
    "google play", "all rights", "opening hours", "view cart", "checkout", "book a table", "delivery in", "order now",
    "see menu", "our menu", "www.", "modern slavery", "slavery act", "pursuant to", "conservation international",
    "this statement is made", "fiscal year", "operated by", "sourced by", "© ", " fy2",
]
SENTENCE_MARKS = "、。，％〜「」『』…"
# --- Fixed values: bare prices ----------------------------------------------------------
PRICE_FOLLOWERS = ["%", "am", "pm", "cal", "g", "gram", "grams", "kg", "kcal", "lb", "lbs", "ml", "oz", "year", "years"]
PRICE_PRECEDERS = ["abv", "cal", "kcal", "form", "section"]
NON_MENU_PHRASES = [
    "modern slavery act", "pursuant to", "requirements of section", "conservation international",
    "retail industry leaders association", "including our most", "periodic reports", "central tea buying",
    "central cocoa purchasing",
]
PRICE_PATTERN = (
    r"(?iU)(?:[$€£¥₹฿₩₫₪₴₦]\s?(?:\d[\d., ]*\d|\d))|(?:(?:\d[\d., ]*\d|\d)\s?[$€£¥₹฿₩₫₪₴₦])"
    r"|(?:(?:usd|eur|gbp|jpy|inr|thb|krw|cny|rmb|sgd|hkd|aud|cad|chf|brl|mxn|php|idr|vnd|rs\.?|r\$)\s?(?:\d[\d., ]*\d|\d))"
    r"|(?:(?:\d[\d., ]*\d|\d)\s?(?:円|元|圆|บาท|/-|"
    r"(?:usd|eur|gbp|jpy|inr|thb|krw|cny|rmb|sgd|hkd|aud|cad|chf|brl|mxn|php|idr|vnd|rs\.?|r\$)))"
    r"|\b\d{1,3}(?:,\d{3})*\.\d{2}\b"
)
BARE_PRICE_PATTERN = r"(?U)(?<![\w.$])(?:[2-9]|[1-9]\d|1\d{2})(?:\.\d{1,2})?(?![\w.])"
CURRENCY_SYMBOLS = "$€£¥₹฿₩₫₪₴₦"
CURRENCY_CODES = r"\b(usd|eur|gbp|jpy|inr|thb|krw|cny|rmb|aud|cad|chf|sgd|hkd|brl|mxn|rs|r\$)\b"
# --- Fixed values: evaluation-time noise words ------------------------------------------
NOISE_MODIFIERS = [
    "beef", "lamb", "chicken", "pork", "veggie", "vegan", "small", "large", "regular", "each", "single", "double", "side",
    "extra", "add",
]
NOISE_UI_WORDS = [
    "cart", "checkout", "subtotal", "add to", "select", "choose", "quantity", "sign in", "log in", "your order",
    "view menu", "order online", "served until", "serves", "click", "©", "all rights", "copyright", "www.", "http",
    "page ",
]
NOISE_ENDINGS = ["with", "and", "&", "of", "the", "in", "on", "to", "de", "la", "or", ",", "-", "~"]
NOISE_MARKS = "、。，％~〜・「」『』…"
SIZE_LINE = r"(?i)^\s*\d+\s*(oz|ml|g|gm|kg|inch|in|pc|pcs|pieces|cl|l)\b|^\s*\d+\s*/"
TIME_LINE = r"(?i)\b\d{1,2}\s*[:.]\s*\d{2}\b|\b\d{1,2}\s*[ap]\.?m\.?\b"
SIZE_SUFFIX = (r"(?i)(?:\s*\([^)]*\)|\s*[-–—,]?\s*(?:small|medium|large|regular|reg|kids?|mini|x-?large|x-?l|sm|md|lg"
               r"|\d+\s*(?:oz|inch|in|cm|\")))\s*$")
# --- Fixed values: handling wording in evidence text --------------------------------------
DISCLAIMER_WORDS = [
    "food allergy", "food allergies", "allergy notice", "allergen notice", "allergen information", "allergen guide",
]
CROSS_CONTACT_WORDS = ["cross contact", "cross contamination", "shared fryer", "shared fryers", "may contain", "cannot guarantee"]
STAFF_WORDS = [
    "tell your server", "inform your server", "please inform", "please alert", "notify your server", "let us know",
    "speak to a manager",
]
NUT_FREE_WORDS = ["nut free", "peanut free", "tree nut free", "no peanuts", "no tree nuts"]
ALLERGY_TEXT = r"(?i)allerg|cross.?contam|nut[\s-]?free|gluten|dietary|intoleran|peanut|tree nut"
