"""Allergen, diet and nut vocabularies."""

from __future__ import annotations

# --- Fixed values: canonical allergen key -> accepted surface forms ---------
ALLERGEN_FORMS = {
    "peanut": ["peanut", "peanuts", "groundnut"],
    "tree_nut": ["tree nut", "tree nuts", "treenut"],
    "milk": ["milk", "dairy", "lactose"],
    "egg": ["egg", "eggs"],
    "soy": ["soy", "soya", "soybean"],
    "gluten": ["gluten", "cereals"],
    "wheat": ["wheat"],
    "fish": ["fish"],
    "shellfish": ["shellfish", "crustacean", "crustaceans"],
    "mollusc": ["mollusc", "mollusk", "molluscs"],
    "sesame": ["sesame"],
    "mustard": ["mustard"],
    "celery": ["celery"],
    "sulphites": ["sulphites", "sulphite", "sulfites", "sulfite"],
    "lupin": ["lupin", "lupine"],
}
ALLERGEN_DISPLAY = {key: key.replace("_", " ").capitalize() for key in ALLERGEN_FORMS}

# --- Fixed values: diets ----------------------------------------------------
DIET_EXCLUDED_ALLERGENS = {
    "vegetarian": ["fish", "shellfish", "mollusc"],
    "vegan": ["milk", "egg", "fish", "shellfish", "mollusc"],
}
DIET_EXCLUDED_CATEGORIES = {
    "vegetarian": ["meat", "poultry", "gelatin"],
    "vegan": ["meat", "poultry", "gelatin", "honey", "dairy", "egg"],
}
DIET_LABELS = {
    "vegan": ["vegan", "plant-based", "plant based"],
    "vegetarian": ["vegetarian", "vegan", "plant-based", "plant based"],
}
DIET_GOOD_SHARE = 0.4

# --- Fixed values: nut taxonomy ---------------------------------------------
TREE_NUT_TYPES = [
    "almond", "cashew", "walnut", "pecan", "pistachio", "hazelnut", "macadamia", "brazil_nut", "pine_nut", "chestnut",
]
NUT_TYPES = TREE_NUT_TYPES + ["peanuts"]
NUT_LABELS = {n: n.replace("_", " ") + "s" for n in TREE_NUT_TYPES} | {
    "brazil_nut": "Brazil nuts", "pistachio": "pistachios", "peanuts": "peanuts"}
NUT_REQUEST_ALIASES = {
    "tree nuts": "tree_nuts", "tree nut": "tree_nuts", "treenut": "tree_nuts", "tree-nut": "tree_nuts",
    "brazil": "brazil_nut", "brazil nut": "brazil_nut", "brazilnut": "brazil_nut",
    "pine": "pine_nut", "pine nut": "pine_nut", "pinenut": "pine_nut",
    "peanut": "peanuts", "peanuts": "peanuts",
}

# --- Fixed values: words naming one specific nut ----------------------------
NUT_TYPE_TERMS = {
    "almond": [
        "almond", "amandine", "amande", "almendra", "mandel", "mandorla", "amêndoa", "badem", "hạnh nhân", "アーモンド", "杏仁",
        "아몬드", "बादाम", "миндаль", "لوز", "marzipan", "frangipane", "financier", "amaretto", "amaretti", "bakewell",
        "marcona", "turron", "turrón", "torrone", "macaron",
    ],
    "cashew": [
        "cashew", "anacardo", "anacardi", "cajou", "cashewkern", "カシューナッツ", "腰果", "hạt điều", "काजू", "كاجو", "кешью",
    ],
    "walnut": ["walnut", "walnuss", "muhammara", "waldorf", "くるみ", "クルミ", "核桃", "호두", "अखरोट", "ceviz"],
    "pecan": ["pecan"],
    "pistachio": ["pistachio", "pistacho", "pistache", "pistazie", "pistacchio", "ピスタチオ", "开心果", "فستق", "фисташки"],
    "hazelnut": [
        "hazelnut", "filbert", "nutella", "gianduja", "frangelico", "avellana", "noisette", "haselnuss", "nocciola",
        "avelã", "fındık", "ヘーゼルナッツ", "بندق", "فندق", "фундук",
    ],
    "macadamia": ["macadamia", "macademia"],
    "brazil_nut": ["brazil nut", "brazilnut"],
    "pine_nut": ["pine nut", "pinenut", "pignoli", "pinoli", "piñón", "松子", "잣"],
    "chestnut": ["chestnut"],
    "peanuts": [
        "peanut", "groundnut", "cacahuete", "cacahuate", "cacahuète", "arachide", "arachidi", "erdnuss", "amendoim",
        "đậu phộng", "落花生", "ピーナッツ", "花生", "땅콩", "ถั่วลิสง", "मूंगफली", "арахис", "فول سوداني",
    ],
}

# --- Fixed values: words the scorer accepts as grounded nut evidence --------
PEANUT_TERMS = [
    "peanut", "peanuts", "groundnut", "cacahuete", "cacahuate", "cacahuète", "arachide", "arachidi", "erdnuss", "amendoim",
    "落花生", "ピーナッツ", "花生", "땅콩", "ถั่วลิสง", "मूंगफली", "арахис", "đậu phộng", "فول سوداني", "fıstığı",
]
TREE_NUT_TERMS = [
    "tree nut", "treenut", "tree-nut", "almond", "cashew", "walnut", "pecan", "hazelnut", "pistachio", "macadamia",
    "chestnut", "pine nut", "pinenut", "brazil nut", "almendra", "amande", "mandel", "mandorla", "anacardo", "cajou",
    "avellana", "noisette", "haselnuss", "nocciola", "pistacho", "pistache", "pistazie", "pistacchio", "walnuss",
    "amêndoa", "badem", "アーモンド", "杏仁", "아몬드", "बादाम", "миндаль", "لوز", "カシューナッツ", "腰果", "काजू", "كاجو", "fındık",
    "ヘーゼルナッツ", "بندق", "фундук", "ピスタチオ", "开心果", "فستق", "くるみ", "核桃", "호두", "अखरोट", "ceviz", "pinoli", "松子", "잣",
    "fıstığı", "hạnh nhân", "anacardi", "cashewkern", "hạt điều", "кешью", "avelã", "фисташки", "クルミ", "piñón", "filbert",
    "marzipan", "frangipane", "gianduja", "nutella", "pignoli",
]
GENERIC_NUT_TERMS = ["nut", "nuts"]
NUT_LOOKALIKES = ["coconut", "butternut", "doughnut", "donut", "nutmeg"]

# --- Fixed values: literal dietary and allergen words in menu text ----------
DIETARY_TERMS = ["vegan", "vegetarian", "gluten-free", "gluten free", "dairy-free", "dairy free", "halal", "kosher"]
ALLERGEN_TERMS = [
    "peanut", "peanuts", "tree nut", "nuts", "almond", "cashew", "walnut", "pecan", "hazelnut", "pistachio", "macadamia",
    "chestnut", "pine nut", "brazil nut", "filbert", "marzipan", "frangipane", "gianduja", "nutella", "pignoli", "sesame",
    "soy", "shellfish", "shrimp", "crab", "egg", "milk", "dairy", "wheat", "gluten", "allergen", "allergy", "cacahuete",
    "cacahuate", "cacahuète", "arachide", "arachidi", "erdnuss", "amendoim", "落花生", "ピーナッツ", "花生", "땅콩", "ถั่วลิสง",
    "मूंगफली", "арахис", "almendra", "amande", "mandel", "mandorla", "amêndoa", "badem", "アーモンド", "杏仁", "아몬드", "बादाम",
    "миндаль", "لوز", "anacardo", "cajou", "カシューナッツ", "腰果", "काजू", "كاجو", "avellana", "noisette", "haselnuss",
    "nocciola", "fındık", "ヘーゼルナッツ", "بندق", "фундук", "pistacho", "pistache", "pistazie", "pistacchio", "ピスタチオ", "开心果",
    "فستق", "walnuss", "くるみ", "核桃", "호두", "अखरोट", "ceviz", "pinoli", "松子", "잣", "đậu phộng", "فول سوداني", "fıstığı",
    "hạnh nhân", "anacardi", "cashewkern", "hạt điều", "кешью", "avelã", "фисташки", "クルミ", "piñón",
]
ALLERGEN_FALSE_FRIENDS = {
    "egg": ["eggplant", "eggplants", "veggie", "veggies"],
    "nuts": ["coconut", "coconuts", "doughnut", "doughnuts", "donut", "donuts"],
    "wheat": ["buckwheat", "buckwheats"],
    "crab": ["crabapple", "crabapples", "crabgrass"],
}

# --- Fixed values: nut-free wording -----------------------------------------
NUT_FREE_CLAIMS = ["nut free", "nut-free", "no nuts", "without nuts", "free of nuts", "peanut free", "peanut-free"]
NUT_FREE_PAGE_WORDS = [
    "nut free", "nut-free", "no nuts", "without nuts", "free of nuts", "free from nuts", "peanut free", "peanut-free",
    "tree nut free", "tree-nut-free",
]
NUT_FREE_FACILITY_KEYS = [
    "nutfree", "nutsfree", "nonuts", "withoutnuts", "freeofnuts", "freefromnuts", "donotusenuts", "peanutfree",
    "treenutfree",
]

# --- Fixed values: chart header -> allergen token, tried in this order ------
CHART_HEADERS: list[tuple[str, list[str]]] = [
    ("peanut", ["peanut", "groundnut", "erdnuss", "erdnüsse", "erdnusse", "cacahuète", "cacahuete", "arachide", "arachidi"]),
    ("tree nut", [
        "tree nut", "treenut", "tree-nut", "schalenfrüchte", "schalenfruchte", "fruits à coque", "fruits a coque",
        "frutos de cáscara", "frutos de cascara", "frutta a guscio",
    ]),
    ("shellfish", [
        "crustacean", "shellfish", "krebstier", "crustacé", "crustace", "crustáceo", "crustaceo", "crostacei",
        "schaaldier",
    ]),
    ("mollusc", ["mollusc", "mollusk", "weichtier", "mollusque", "molusco", "mollusco"]),
    ("fish", ["fish", "fisch", "poisson", "pescado", "pesce"]),
    ("milk", ["milk", "dairy", "lactose", "milch", "lait", "leche", "latte", "melk"]),
    ("egg", ["egg", "eier", "œuf", "oeuf", "huevo", "uovo"]),
    ("soy", ["soya", "soybean", "soy", "soja", "soia"]),
    ("gluten", ["gluten"]),
    ("wheat", ["wheat", "weizen", "blé", "trigo", "frumento", "tarwe"]),
    ("sesame", ["sesame", "sesam", "sésame", "sésamo", "sesamo"]),
    ("mustard", ["mustard", "senf", "moutarde", "mostaza", "senape"]),
    ("celery", ["celery", "sellerie", "céleri", "apio", "sedano", "selderij"]),
    ("sulphites", ["sulphite", "sulfite", "sulphur", "sulfur", "schwefeldioxid", "solfiti"]),
    ("lupin", ["lupin", "lupine", "altramuces", "lupini"]),
    ("tree nut", ["almond", "mandel", "amande", "almendra", "mandorla"]),
    ("tree nut", ["cashew", "cajou", "anacardo", "anacardi"]),
    ("tree nut", ["pecan", "pekan"]),
    ("tree nut", ["pistachio", "pistazie", "pistache", "pistacho", "pistacchio"]),
    ("tree nut", ["macadamia", "macademia"]),
    ("tree nut", ["hazelnut", "haselnuss", "noisette", "avellana", "nocciola"]),
    ("tree nut", ["walnut", "walnuss", "noix", "nuez", "noce"]),
    ("tree nut", ["nut", "nuss", "nüsse", "nusse"]),
]
CHART_GRID_WORDS = ["allergen", "allergy", "allergies", "nutrition", "intoleran"]
CELL_POSITIVE_SYMBOLS = "✓✔✅☑●•◆■▪♦"
CELL_POSITIVE_WORDS = ["x", "yes", "y", "contains", "1", "true"]
CELL_NEGATIVE_WORDS = ["-", "–", "—", "0", "no", "n", "none", "free", "n/a", "na", "✗", "✘", "✕", "×", "○", "◦"]
CELL_ALT_WORDS = ["yes", "contain", "tick", "check", "present"]
CELL_CLASS_WORDS = ["contains", "present", "allergen-yes", "tick", "yes", "marked", "active", "filled"]
CELL_BLANK_FILLS = ["transparent", "none", "inherit", "#fff", "#ffffff", "white", "rgba(0,0,0,0)"]

# --- Fixed values: truthy flags in structured allergen data -----------------
TRUE_WORDS = ["true", "1", "yes", "y", "contains", "may contain", "present", "x", "✓", "✔", "●"]
FLAG_KEYS = ["contains", "present", "value", "status", "flag", "ispresent", "has", "marked"]
FLAG_NAME_KEYS = ["name", "allergen", "allergenname", "allergen_name", "label", "title", "code"]
OBJECT_NAME_KEYS = ["name", "title", "itemname", "item_name", "displayname", "label"]
OBJECT_PRICE_KEYS = [
    "price", "amount", "cost", "baseprice", "base_price", "pricev2", "displayprice", "display_price", "unitprice",
    "unit_price",
]
OBJECT_TEXT_KEYS = ["description", "desc", "caption", "subtitle"]
LOCALE_KEYS = ["locale", "en", "en-us", "en_us", "en-gb", "en_gb", "value", "default"]
