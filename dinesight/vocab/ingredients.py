"""Ingredient words that imply an allergen, and free-from wording."""

from __future__ import annotations

# --- Fixed values: ingredient words, the allergens they imply, how surely, and phrases that do not count ---
RULES = [
    {"variants": ["tahini", "tahina", "tahin"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["za'atar", "zaatar", "za atar"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["halva", "halvah", "halwa"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["gomashio", "gomasio"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["benne"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["furikake"], "tokens": ["sesame"],
     "tier": "def", "exclusions": []},
    {"variants": ["hummus", "houmous", "hommus"], "tokens": ["sesame"],
     "tier": "may", "exclusions": []},
    {"variants": ["baba ganoush", "babaganoush", "baba ghanoush"], "tokens": ["sesame"],
     "tier": "may", "exclusions": []},
    {"variants": ["paneer"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["ghee"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["labneh", "labne", "labane"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["alfredo"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["bechamel", "béchamel"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["au gratin", "gratin"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["queso", "crema"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": [
            "mozzarella", "parmesan", "parmigiano", "ricotta", "mascarpone", "burrata", "cheddar", "gouda", "brie", "feta",
            "halloumi", "provolone", "gorgonzola", "camembert",
        ], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["custard", "creme brulee", "crème brûlée", "panna cotta", "gelato", "kulfi"], "tokens": ["milk"],
     "tier": "may", "exclusions": []},
    {"variants": ["malai", "khoya", "raita", "lassi", "kheer"], "tokens": ["milk"],
     "tier": "def", "exclusions": []},
    {"variants": ["cheese"], "tokens": ["milk"],
     "tier": "def", "exclusions": ["vegan cheese", "nut cheese"]},
    {"variants": ["yogurt", "yoghurt", "yoghourt"], "tokens": ["milk"],
     "tier": "def", "exclusions": ["coconut yogurt", "soy yogurt", "almond yogurt", "oat yogurt"]},
    {"variants": ["butter"], "tokens": ["milk"],
     "tier": "def", "exclusions": [
            "peanut butter", "almond butter", "cashew butter", "hazelnut butter", "sunflower butter", "seed butter",
            "nut butter", "cocoa butter", "shea butter", "apple butter", "fruit butter", "body butter", "butter lettuce",
            "butter bean",
        ]},
    {"variants": ["cream"], "tokens": ["milk"],
     "tier": "def", "exclusions": [
            "coconut cream", "cashew cream", "almond cream", "oat cream", "soy cream", "cream of tartar", "ice cream cone",
        ]},
    {"variants": ["buttermilk", "condensed milk", "evaporated milk", "whey", "casein", "milk"], "tokens": ["milk"],
     "tier": "def", "exclusions": [
            "coconut milk", "almond milk", "soy milk", "soya milk", "oat milk", "rice milk", "cashew milk", "hemp milk",
            "pea milk", "macadamia milk", "flax milk", "hazelnut milk", "walnut milk", "peanut milk", "milk thistle",
        ]},
    {"variants": ["mayonnaise", "mayo", "aioli", "aïoli"], "tokens": ["egg"],
     "tier": "def", "exclusions": ["vegan mayo", "vegan mayonnaise", "vegan aioli"]},
    {"variants": ["hollandaise", "bearnaise", "béarnaise"], "tokens": ["egg"],
     "tier": "def", "exclusions": []},
    {"variants": ["meringue", "pavlova", "zabaglione", "financier"], "tokens": ["egg"],
     "tier": "def", "exclusions": []},
    {"variants": ["carbonara"], "tokens": ["egg"],
     "tier": "def", "exclusions": []},
    {"variants": ["frittata", "omelet", "omelette", "quiche", "shakshuka", "tamagoyaki", "chawanmushi"], "tokens": ["egg"],
     "tier": "def", "exclusions": []},
    {"variants": ["egg"], "tokens": ["egg"],
     "tier": "def", "exclusions": ["egg plant", "eggfruit"]},
    {"variants": ["brioche", "challah", "custard"], "tokens": ["egg"],
     "tier": "may", "exclusions": []},
    {"variants": ["tofu", "bean curd"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["edamame"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["tempeh"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["miso"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["natto"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["doenjang", "gochujang"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["tamari"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["soy sauce", "soya sauce", "shoyu"], "tokens": ["soy", "wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": ["teriyaki", "hoisin", "ponzu"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["edamame", "soybean", "soya bean"], "tokens": ["soy"],
     "tier": "def", "exclusions": []},
    {"variants": ["seitan"], "tokens": ["wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": ["panko", "breadcrumb", "bread crumb"], "tokens": ["wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": ["tempura", "katsu", "schnitzel", "milanese", "breaded"], "tokens": ["wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": ["udon", "ramen", "somen", "lo mein", "chow mein", "spaetzle"], "tokens": ["wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": [
            "naan", "roti", "paratha", "chapati", "pita", "focaccia", "ciabatta", "couscous", "bulgur", "semolina",
            "farro", "orzo",
        ], "tokens": ["wheat", "gluten"],
     "tier": "def", "exclusions": []},
    {"variants": ["barley", "rye", "malt", "spelt", "kamut", "farina"], "tokens": ["gluten"],
     "tier": "def", "exclusions": ["malt vinegar"]},
    {"variants": ["gnocchi", "pierogi", "wonton", "dumpling", "pretzel", "crouton"], "tokens": ["wheat", "gluten"],
     "tier": "may", "exclusions": []},
    {"variants": ["anchovy", "anchovies"], "tokens": ["fish"],
     "tier": "def", "exclusions": []},
    {"variants": ["fish sauce", "nuoc mam", "nam pla", "patis", "colatura"], "tokens": ["fish"],
     "tier": "def", "exclusions": []},
    {"variants": ["bonito", "katsuobushi", "dashi"], "tokens": ["fish"],
     "tier": "def", "exclusions": ["kombu dashi"]},
    {"variants": ["surimi"], "tokens": ["fish"],
     "tier": "def", "exclusions": []},
    {"variants": [
            "tuna", "salmon", "cod", "halibut", "tilapia", "mackerel", "sardine", "herring", "trout", "snapper",
            "branzino", "sea bass", "mahi", "swordfish", "haddock", "pollock", "catfish", "barramundi",
        ], "tokens": ["fish"],
     "tier": "def", "exclusions": []},
    {"variants": ["caviar", "roe", "ikura", "tobiko", "masago", "taramasalata", "lox", "gravlax"], "tokens": ["fish"],
     "tier": "def", "exclusions": []},
    {"variants": ["worcestershire", "caesar"], "tokens": ["fish"],
     "tier": "may", "exclusions": ["vegan caesar", "vegan worcestershire"]},
    {"variants": ["shrimp", "prawn"], "tokens": ["shellfish"],
     "tier": "def", "exclusions": []},
    {"variants": ["lobster", "crab", "crawfish", "crayfish", "langoustine", "scampi", "krill"], "tokens": ["shellfish"],
     "tier": "def", "exclusions": ["crab apple", "crabapple"]},
    {"variants": ["shrimp paste", "belacan", "terasi", "bagoong", "xo sauce"], "tokens": ["shellfish"],
     "tier": "def", "exclusions": []},
    {"variants": [
            "mussel", "clam", "scallop", "squid", "calamari", "octopus", "cuttlefish", "escargot", "snail", "abalone",
            "whelk", "cockle", "periwinkle", "geoduck",
        ], "tokens": ["mollusc"],
     "tier": "def", "exclusions": []},
    {"variants": ["oyster"], "tokens": ["mollusc"],
     "tier": "def", "exclusions": ["oyster mushroom"]},
    {"variants": ["mustard", "dijon", "colman"], "tokens": ["mustard"],
     "tier": "def", "exclusions": ["mustard green"]},
    {"variants": ["celery", "celeriac", "celery salt"], "tokens": ["celery"],
     "tier": "def", "exclusions": []},
    {"variants": ["lupin", "lupini", "lupine"], "tokens": ["lupin"],
     "tier": "def", "exclusions": []},
    {"variants": ["groundnut", "goober"], "tokens": ["peanut"],
     "tier": "def", "exclusions": ["groundnut-free"]},
    {"variants": ["gado gado", "gado-gado", "gadogado"], "tokens": ["peanut"],
     "tier": "def", "exclusions": []},
    {"variants": ["peanut sauce", "satay sauce", "peanut oil", "groundnut oil"], "tokens": ["peanut"],
     "tier": "def", "exclusions": []},
    {"variants": ["satay", "sate"], "tokens": ["peanut"],
     "tier": "may", "exclusions": []},
    {"variants": ["pad thai", "phad thai"], "tokens": ["peanut"],
     "tier": "may", "exclusions": []},
    {"variants": ["kung pao", "gong bao", "kung po"], "tokens": ["peanut"],
     "tier": "may", "exclusions": []},
    {"variants": ["massaman"], "tokens": ["peanut"],
     "tier": "may", "exclusions": []},
    {"variants": ["baklava", "baklawa"], "tokens": ["tree nut"],
     "tier": "def", "exclusions": []},
    {"variants": ["marzipan"], "tokens": ["almond"],
     "tier": "def", "exclusions": []},
    {"variants": ["frangipane"], "tokens": ["almond"],
     "tier": "def", "exclusions": []},
    {"variants": ["amaretto", "amaretti"], "tokens": ["almond"],
     "tier": "def", "exclusions": []},
    {"variants": ["gianduja", "gianduia"], "tokens": ["hazelnut"],
     "tier": "def", "exclusions": []},
    {"variants": ["nutella", "ferrero"], "tokens": ["hazelnut"],
     "tier": "def", "exclusions": []},
    {"variants": ["praline", "pralines"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
    {"variants": ["nougat", "turron", "turrón"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
    {"variants": ["pesto"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
    {"variants": ["korma", "pasanda"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
    {"variants": ["kulfi"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
    {"variants": ["romesco"], "tokens": ["tree nut"],
     "tier": "may", "exclusions": []},
]
TREE_NUT_TOKENS = [
    "tree nut", "almond", "walnut", "cashew", "hazelnut", "pistachio", "pecan", "pine nut", "macadamia", "brazil nut",
]
# --- Fixed values: free-from wording ; tokens it rules out -------------------
FREE_FROM: list[tuple[list[str], list[str]]] = [
    (["dairy free", "dairy-free", "non dairy", "non-dairy"], ["milk"]),
    (["gluten free", "gluten-free"], ["wheat", "gluten"]),
    (["wheat free", "wheat-free"], ["wheat"]),
    (["soy free", "soy-free", "soya free", "soya-free"], ["soy"]),
    (["sesame free", "sesame-free"], ["sesame"]),
    (["egg free", "egg-free", "eggless"], ["egg"]),
    (["peanut free", "peanut-free"], ["peanut"]),
    (["tree nut free", "tree-nut-free", "treenut free"], TREE_NUT_TOKENS),
    (["nut free", "nut-free"], ["peanut", *TREE_NUT_TOKENS]),
    (["shellfish free", "shellfish-free"], ["shellfish", "mollusc"]),
    (["fish free", "fish-free"], ["fish"]),
    (["vegan", "plant based", "plant-based"], ["milk", "egg", "fish", "shellfish", "mollusc"]),
]


def ingredient_rules() -> list[dict]:
    """The rules as records: variants, tokens, tier, exclusions."""
    return RULES
