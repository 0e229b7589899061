"""Country, region, address and place-type vocabularies."""

from __future__ import annotations

EARTH_RADIUS_M = 6_371_000

# --- Fixed values: place types ------------------------------------------------
FOOD_TYPES = [
    "restaurant", "cafe", "coffee_shop", "bakery", "bar", "pub", "bistro", "diner", "meal_takeaway", "meal_delivery",
    "fast_food", "ice_cream", "food_court", "tea_house", "juice_shop", "deli", "steak_house", "pizza",
]
NON_FOOD_TYPES = [
    "shopping_mall", "department_store", "hotel", "lodging", "movie_theater", "museum", "supermarket", "grocery",
    "tourist_attraction", "gym", "convention_center", "store", "stadium", "park", "airport", "hospital",
]
FOOD_AMENITIES = ["restaurant", "cafe", "fast_food", "food_court"]
GEOCODE_PLACE_TYPES = ["city", "town", "village", "municipality", "hamlet", "suburb"]
QUALITY_FIELDS = ["name", "address", "website_url", "phone_number", "opening_hours", "categories", "source_last_updated"]

# --- Fixed values: country code -> address spellings --------------------------
COUNTRY_ALIASES = {
    "usa": "US", "u.s.a": "US", "u.s.a.": "US", "us": "US", "united states": "US", "united states of america": "US",
    "canada": "CA", "united kingdom": "GB", "uk": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "ireland": "IE",
    "australia": "AU", "new zealand": "NZ", "india": "IN", "pakistan": "PK", "bangladesh": "BD", "sri lanka": "LK",
    "nepal": "NP", "thailand": "TH", "vietnam": "VN", "indonesia": "ID", "malaysia": "MY", "china": "CN", "taiwan": "TW",
    "hong kong": "HK", "japan": "JP", "south korea": "KR", "lebanon": "LB", "syria": "SY", "jordan": "JO", "israel": "IL",
    "turkey": "TR", "türkiye": "TR", "turkiye": "TR", "egypt": "EG", "iran": "IR", "saudi arabia": "SA", "iceland": "IS",
    "united arab emirates": "AE", "uae": "AE", "iraq": "IQ", "afghanistan": "AF", "mexico": "MX", "france": "FR",
    "germany": "DE", "italy": "IT", "spain": "ES", "netherlands": "NL", "ethiopia": "ET", "nigeria": "NG", "ghana": "GH",
    "brazil": "BR", "singapore": "SG", "peru": "PE", "chile": "CL", "argentina": "AR", "colombia": "CO", "venezuela": "VE",
    "cuba": "CU", "jamaica": "JM", "morocco": "MA", "algeria": "DZ", "tunisia": "TN", "libya": "LY", "kenya": "KE",
    "tanzania": "TZ", "south africa": "ZA", "russia": "RU", "georgia": "GE", "ukraine": "UA", "denmark": "DK",
    "sweden": "SE", "norway": "NO", "finland": "FI", "poland": "PL", "czech republic": "CZ", "czechia": "CZ",
    "austria": "AT", "switzerland": "CH", "belgium": "BE", "portugal": "PT", "greece": "GR", "philippines": "PH",
    "myanmar": "MM", "burma": "MM", "cambodia": "KH", "laos": "LA", "uzbekistan": "UZ", "mongolia": "MN", "qatar": "QA",
    "kuwait": "KW", "bahrain": "BH", "oman": "OM", "armenia": "AM",
}
US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
US_STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania",
    "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia",
]
STATE_COUNTRY_COLLISIONS = [n for n in US_STATE_NAMES if n in COUNTRY_ALIASES]

# --- Fixed values: code, lat_min, lat_max, lon_min, lon_max, in priority order -
COUNTRY_BOXES = [
    ("US", 24.5, 49.4, -125.0, -66.9), ("US", 51.0, 71.5, -169.0, -129.0), ("US", 18.9, 22.3, -160.3, -154.8),
    ("CA", 49.4, 83.2, -141.1, -52.6), ("GB", 49.9, 60.9, -8.7, 1.8), ("IE", 51.4, 55.5, -10.6, -5.9),
    ("AU", -43.7, -10.6, 113.1, 153.7), ("NZ", -47.3, -34.3, 166.3, 178.7),
]

# --- Fixed values: labelling culture -------------------------------------------
MANDATE_REGIONS = [
    "GB", "IE", "AU", "NZ", "FR", "DE", "IT", "ES", "NL", "BE", "SE", "DK", "FI", "NO", "PT", "AT", "PL", "CZ", "GR", "CH",
]
HIGH_LABELING_REGIONS = ["US", "CA", *MANDATE_REGIONS, "JP", "SG", "KR", "HK"]
HIGH_LABELING_TRUST, LOW_LABELING_TRUST = 0.70, 0.35

# --- Fixed values: home-country spellings used for source provenance -----------
HOME_NAMES = {
    "united states": "US", "usa": "US", "us": "US", "u.s.a.": "US", "u.s.": "US", "united kingdom": "GB", "uk": "GB",
    "u.k.": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "great britain": "GB", "britain": "GB", "canada": "CA",
    "australia": "AU", "new zealand": "NZ", "ireland": "IE", "germany": "DE", "deutschland": "DE", "france": "FR",
    "spain": "ES", "italy": "IT", "netherlands": "NL", "belgium": "BE", "austria": "AT", "switzerland": "CH",
    "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "portugal": "PT", "poland": "PL", "malta": "MT",
    "singapore": "SG", "philippines": "PH", "japan": "JP", "taiwan": "TW", "india": "IN", "mexico": "MX", "brazil": "BR",
    "south africa": "ZA", "south korea": "KR", "hong kong": "HK", "china": "CN", "united arab emirates": "AE", "uae": "AE",
    "saudi arabia": "SA",
}
CCTLD = {("uk" if code == "GB" else code.lower()): code for code in HOME_NAMES.values()}
_NAMED = {code: next(name for name, of in HOME_NAMES.items() if of == code).title() for code in dict.fromkeys(HOME_NAMES.values())}
REGION_TOKEN = _NAMED | {"US": "USA", "GB": "UK", "AE": "UAE"}
COUNTRY_LABEL = _NAMED | {"US": "the United States", "GB": "the United Kingdom", "NL": "the Netherlands",
                          "PH": "the Philippines", "AE": "the UAE"}
STRONG_NAMES = {
    "GB": ["united kingdom", "great britain"],
    "NZ": ["new zealand", "aotearoa"],
    "ZA": ["south africa"],
    "SA": ["saudi arabia"],
    "AE": ["united arab emirates"],
    "KR": ["south korea"],
    "HK": ["hong kong"],
}
STRUCTURAL_TELLS = {
    "NZ": r"\+64\b|nz\$|\bnzd\b", "GB": r"\+44\b|£|\bgbp\b", "ZA": r"\+27\b|\bzar\b",
    "SA": r"\+966\b|\bsar\b|﷼", "AE": r"\+971\b|\baed\b", "KR": r"\+82\b|₩|\bkrw\b", "HK": r"\+852\b|hk\$|\bhkd\b",
}
ADDRESS_COUNTRIES = [
    "united states of america", "united states", "usa", "united kingdom", "great britain", "england", "scotland", "wales",
    "canada", "australia", "new zealand", "ireland", "germany", "france", "spain", "italy", "netherlands", "belgium",
    "austria", "switzerland", "sweden", "norway", "denmark", "finland", "portugal", "poland", "malta", "singapore",
    "philippines", "japan", "taiwan", "india", "mexico", "brazil", "south africa", "south korea", "hong kong", "china",
    "united arab emirates", "saudi arabia",
]
NON_CITY_TOKENS = [
    "menu", "menus", "pdf", "pdfs", "brunch", "dinner", "lunch", "breakfast", "drinks", "drink", "dessert", "desserts",
    "kids", "kid", "catering", "wine", "wines", "cocktail", "cocktails", "seasonal", "weekend", "new", "updated",
    "current", "food", "allergen", "allergens", "nutrition", "final", "draft", "specials", "special", "main", "mains",
    "full", "sample", "bar", "happy", "hour", "holiday", "spring", "summer", "fall", "autumn", "winter", "takeout",
    "delivery", "order", "ordering", "togo", "dinein", "print", "online", "download", "view", "our", "home", "index",
    "page", "files", "file", "uploads", "upload", "assets", "asset", "wp", "content", "sites", "default", "documents",
    "docs", "img", "images", "image", "media", "static", "cdn", "s", "downloads",
]
STREET_SUFFIXES = [
    "ave", "avenue", "blvd", "boulevard", "cir", "circle", "ct", "court", "dr", "drive", "hwy", "highway", "ln", "lane",
    "pkwy", "parkway", "pl", "place", "rd", "road", "st", "street", "ter", "terrace", "way",
]
