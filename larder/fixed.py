"""Fixed values.

Everything here has to equal the published data contract for results to match:
type names, thresholds, word lists and text patterns.  Nothing here is logic.
Larger dictionaries (brands, labels, stores, allergens, cities, taxonomies) are
not kept here; they are tables read with ``sources.readers.scan_dictionary`` and
``scan_taxonomy`` and passed to the operators.
"""

# --- fixed values: types -----------------------------------------------------

PREDICTION_TYPES = [
    "ingredient_spellcheck", "packager_code", "label", "category", "image_flag",
    "product_weight", "expiration_date", "brand", "image_orientation", "store",
    "nutrient", "trace", "packaging_text", "packaging", "location",
    "nutrient_mention", "image_lang", "nutrition_image", "is_upc_image",
    "nutrient_extraction", "ingredient_detection",
]

OCR_DEFAULT_TYPES = [
    "category", "label", "packager_code", "product_weight", "image_flag",
    "expiration_date", "brand", "store", "packaging", "nutrient",
    "nutrient_mention", "image_lang", "image_orientation",
]

PRODUCT_NAME_TYPES = ["label", "product_weight", "brand"]

# project name by product type, and domain label by project
SERVER_BY_PRODUCT_TYPE = {"food": "off", "beauty": "obf", "petfood": "opff", "product": "opf"}
FOOD_SERVERS = ["off", "off_pro"]

# required and input prediction types of the fourteen candidate builders
REQUIRED_TYPES = {
    "packager_code": ["packager_code"],
    "label": ["label"],
    "category": ["category"],
    "product_weight": ["product_weight"],
    "expiration_date": ["expiration_date"],
    "brand": ["brand"],
    "store": ["store"],
    "packaging": ["packaging"],
    "is_upc_image": ["is_upc_image"],
    "nutrition_image": ["nutrient_mention", "image_orientation"],
    "ingredient_spellcheck": ["ingredient_spellcheck"],
    "nutrient_extraction": ["nutrient_extraction"],
    "image_orientation": ["image_orientation"],
    "ingredient_detection": ["ingredient_detection"],
}
EXTRA_INPUT_TYPES = {
    "nutrition_image": ["nutrient"],
    "nutrient_extraction": ["image_orientation", "nutrient_mention"],
    "ingredient_detection": ["image_orientation"],
}

QUESTION_TYPES = [
    "category", "label", "product_weight", "brand", "nutrition_image",
    "packaging", "is_upc_image", "image_orientation",
]
QUESTION_DEFAULT_TYPES = ["category", "label", "product_weight", "brand", "packaging"]
QUESTION_TEXTS = {
    "category": "Does the product belong to this category?",
    "label": "Does the product have this label?",
    "product_weight": "Does this weight match the weight displayed on the product?",
    "brand": "Does the product belong to this brand?",
    "nutrition_image": "Is this image a nutrition image for this language?",
    "packaging": "Does the product have this packaging element?",
    "is_upc_image": "Is there a product barcode on this image?",
    "image_orientation": "Is this image rotated with the following orientation?",
}

# annotation outcomes: name -> code
OUTCOME_CODES = {
    "saved": 1, "updated": 2, "error_missing_product": 3, "error_updated_product": 4,
    "error_already_annotated": 5, "error_unknown_insight": 6, "error_invalid_image": 8,
    "vote_saved": 9, "error_failed_update": 10, "error_invalid_data": 11,
    "user_input_updated": 12, "cannot_vote": 13,
}

# outcomes whose code is written back on the insight row
OUTCOMES_STORED = [
    "saved", "updated", "user_input_updated", "error_invalid_image",
    "error_missing_product", "error_updated_product",
]

# --- fixed values: thresholds ------------------------------------------------

AUTOMATIC_WAIT_MINUTES = 10
BRAND_MIN_COUNT = 15
BRAND_MIN_LENGTH = 4
BRAND_PREFIX_MIN_COUNT = 5
DEFAULT_NEIGHBORS = 10
DEFAULT_LOGO_THRESHOLD = 0.2
MAX_IMAGE_VECTORS = 10
DATASET_MIN_ROWS = 2_800_000
UPDATED_PRODUCT_WAIT_SECONDS = 10
DISPLAY_IMAGE_SIZE = 400
SMALL_IMAGE_SIZE = 200
THUMB_IMAGE_SIZE = 100

# --- fixed values: units and nutrients ---------------------------------------

WEIGHT_FACTORS = {
    # unit: (factor, normalised unit)
    "mg": (0.001, "g"), "g": (1.0, "g"), "kg": (1000.0, "g"),
    "oz": (28.349523125, "g"), "lbs": (453.59237, "g"), "µg": (0.000001, "g"),
    "ml": (1.0, "ml"), "cl": (10.0, "ml"), "dl": (100.0, "ml"), "l": (1000.0, "ml"),
    "fl oz": (30.0, "ml"),
}

NUTRIENT_DEFAULT_UNIT = {
    "energy-kcal": "kcal", "energy-kj": "kJ", "proteins": "g", "carbohydrates": "g",
    "sugars": "g", "added-sugars": "g", "fat": "g", "saturated-fat": "g",
    "trans-fat": "g", "fiber": "g", "salt": "g", "iron": "mg", "sodium": "mg",
    "calcium": "mg", "potassium": "mg", "cholesterol": "mg", "vitamin-d": "µg",
}

CATEGORY_NUTRIENTS = [
    "fat", "saturated-fat", "carbohydrates", "sugars", "fiber", "proteins",
    "salt", "energy-kcal", "fruits-vegetables-nuts",
]

INGREDIENT_LANGS = ["xx", "en", "fr", "es", "de", "nl", "it"]
INGREDIENT_EXCLUDED = ["en:n"] + [f"en:no{i}" for i in range(1, 13)]

CATEGORIES_EXCLUDED = ["en:meats-and-their-products"]
LABELS_DISABLED = ["en:eu-agriculture", "en:non-eu-agriculture"]

# --- fixed values: packaging -------------------------------------------------

SHAPE_ONLY_EXCLUDED = [
    "en:tray", "en:packaging", "en:backing", "en:packet", "en:string", "en:bowl",
    "en:sheet", "en:net", "en:pouch-flask", "en:spoon", "en:tablespoon", "en:mold",
    "en:cutlery", "en:overpack", "en:plate", "en:basket", "en:wedge",
]

# --- fixed values: image flags -----------------------------------------------

FLAGGED_LABELS = [
    "Face", "Head", "Selfie", "Hair", "Forehead", "Chin", "Cheek", "Arm", "Tooth",
    "Human Leg", "Ankle", "Eyebrow", "Ear", "Neck", "Jaw", "Nose",
    "Facial Expression", "Glasses", "Eyewear", "Jeans", "Shoe", "Child", "Baby",
    "Human", "Dog", "Cat", "Computer", "Laptop", "Refrigerator",
]
HUMAN_LABELS = [
    "face", "head", "selfie", "hair", "forehead", "chin", "cheek", "tooth", "eyebrow",
    "ear", "neck", "nose", "facial expression", "child", "baby", "human",
]
LIKELIHOODS = ["UNKNOWN", "VERY_UNLIKELY", "UNLIKELY", "POSSIBLE", "LIKELY", "VERY_LIKELY"]

# --- fixed values: text patterns ---------------------------------------------
# Java regular expressions; (?iu) = case-insensitive over Unicode, (?U) = Unicode
# classes.  field: "full" keeps line breaks, "contiguous" has them as spaces.

WEIGHT_UNITS = r"(fl oz|dle?|cle?|mge?|mle?|lbs|oz|ge?|kge?|le?)"
WEIGHT_PROMPTS = (
    r"(poids|poids net [aà] l'emballage|poids net|poids net égoutté|masse nette"
    r"|volume net total|net weight|net wt\.?|peso neto|peso liquido|netto[ -]?gewicht)"
)
WEIGHT_PATTERNS = [
    # (matcher, priority, pattern, value group, unit group, count group, prompt group, automatic)
    ("with_mention", 1, rf"(?iu)(?<![a-z]){WEIGHT_PROMPTS}\s?:?\s?([0-9]+[,.]?[0-9]*)\s?{WEIGHT_UNITS}(?![a-z])", 2, 3, 0, 1, True),
    ("with_ending_mention", 1, rf"(?iu)(?<![a-z])([0-9]+[,.]?[0-9]*)\s?{WEIGHT_UNITS}\s(net)(?![a-z])", 1, 2, 0, 3, True),
    ("multi_packaging", 2, rf"(?iu)(?<![a-z])(\d+)\s?x\s?([0-9]+[,.]?[0-9]*)\s?{WEIGHT_UNITS}(?![a-z])", 2, 3, 1, 0, True),
    ("no_mention", 3, r"(?iu)(?<![a-z])([0-9]+[,.]?[0-9]*)\s?(dle|cle|mge|mle|ge|kge)(?![a-z])", 1, 2, 0, 0, False),
]

EXPIRATION_YEARS = (2015, 2025)
DATE_PATTERNS = [
    ("full_digits_short", r"(?<!\d)(\d{2})[-./](\d{2})[-./](\d{2})(?!\d)", True),
    ("full_digits_long", r"(?<!\d)(\d{2})[-./](\d{2})[-./](\d{4})(?!\d)", False),
]

PACKAGER_PATTERNS = [
    # (type, field, pattern)
    ("fr_emb", "full", r"(?iu)emb ?(\d ?\d ?\d ?\d ?\d) ?([a-z])?(?![a-z0-9])"),
    ("fsc", "full", r"(?iu)fsc.? ?(c\d{6})"),
    ("eu_fr", "contiguous", r"(?iu)fr (\d{2,3}|2[ab])[\-\s.](\d{3})[\-\s.](\d{3}) (ce|ec)(?![a-z0-9])"),
    ("eu_de", "contiguous", r"(?iu)de (bb|be|bw|by|hb|he|hh|mv|ni|nw|rp|sh|sl|sn|st|th)[\-\s.](\d{1,5})[\-\s.] ?(eg|ec)(?![a-z0-9])"),
    ("rspo", "contiguous", r"(?U)(?<!\w)RSPO-\d{7}(?!\d)"),
    ("fr_gluten", "contiguous", r"FR-\d{3}-\d{3}"),
]

LABEL_PATTERNS = [
    # (value tag, field, pattern)
    ("en:organic", "contiguous", r"(?iuU)(?:ingr[ée]dients?\sbiologiques?)|(?:ingr[ée]dients?\sbio[\s.,)])|(?:agriculture ue/non ue biologique)|(?:agriculture bio(?:logique)?[\s.,)])|(?:production bio(?:logique)?[\s.,)])"),
    ("xx-bio-xx", "full", r"(?<![a-zA-Z])([A-Z]{2})[\-\s.](BIO|ÖKO|OKO|EKO|ØKO|ORG|Bio)[\-\s.](\d{2,3})"),
    ("es-eco", "full", r"(?<![a-zA-Z])ES[\-\s.]ECO[\-\s.](\d{3})[\-\s.]([A-Z]{2,3})"),
    ("fr:ab-agriculture-biologique", "contiguous", r"(?iuU)certifi[ée] ab[\s.,)]"),
    ("fr:label-rouge", "contiguous", r"(?iuU)(?<!\w)homologation(?: n°?)? ?la ?\d{2}\/\d{2}(?!\w)"),
    ("fr:aoc", "contiguous", r"(?U)(?<!\w)(?:AOC)(?!\w)"),
    ("en:nutriscore", "full", r"NUTRI-SCORE"),
    ("en:eu-non-eu-agriculture", "contiguous", r"(?iuU)agriculture ue\s?/\s?non\s?(?:-\s?)?ue|eu\s?/\s?non\s?(?:-\s?)?eu agriculture"),
    ("en:eu-agriculture", "contiguous", r"(?iuU)agriculture ue(?!\s?/)|(?<!-)\s?eu agriculture"),
    ("en:non-eu-agriculture", "contiguous", r"(?iuU)agriculture non\s?(?:-\s?)?ue|non\s?(?:-\s?)?eu agriculture"),
    ("en:no-preservatives", "contiguous", r"(?iuU)senza conservanti(?! arti)|без консервантов|conserveermiddelvrij|(?<!\w)(?:sans|ni) conservateur(?!s? arti)|fără conservanți|no preservative|sin conservante(?!s? arti)|ohne konservierungsstoffe"),
    ("en:no-flavors", "contiguous", r"(?iuU)без ароматизаторов|senza aromi|zonder toegevoegde smaakstoffen|(?<!\w)(?:sans|ni) ar[ôo]mes? ajout[ée]s|sin aromas?|ohne zusatz von aromen|no flavors?"),
    ("en:no-artificial-flavors", "contiguous", r"(?iuU)без искусственных ароматизаторов|ohne künstliche aromen|sin aromas? artificiales?|vrij van kunstmatige smaakstoffen|(?<!\w)(?:sans|ni) ar[ôo]mes? artificiels?|no artificial flavors?"),
    ("en:no-colorings", "contiguous", r"(?iuU)no colorings?|no colourants?|ohne farbstoffzusatz|(?<!\w)(?:sans|ni) colorants?|zonder kleurstoffen|sin colorantes?|без красителей|senza coloranti"),
    ("en:no-additives", "contiguous", r"(?iuU)zonder toevoegingen|sin aditivos(?! arti)|(?<!\w)(?:sans|ni) additif(?!s? arti)|ohne zusätze|no additives?"),
]

# The phrases that start with "anything" can only begin where the text does (line breaks are
# spaces there), so they are anchored: same matches, no retry from every position.
PROTECTED_ORIGIN_PATTERNS = [
    # (language prefix, pattern, group holding the category)
    ("fr:", r"(?iud)(appellation)\s*(.+)\s*(contr[ôo]l[ée]e|prot[ée]g[ée]e)", 2),
    ("fr:", r"(?iud)^(.+)\s*(appellation d'origine contr[ôo]l[ée]e|appellation d'origine prot[ée]g[ée]e)", 1),
    ("es:", r"(?iud)^(.+)(\s*denominacion de origen protegida)", 1),
    ("es:", r"(?iud)(denominacion de origen protegida\s*)(.+)", 2),
    ("en:", r"(?iud)^(.+)\s*(aop|dop|pdo)", 1),
    ("en:", r"(?iud)(aop|dop|pdo)\s*(.+)", 2),
]

# Lower-case strings of which any match of a pattern contains one
PATTERN_LITERALS = {
    "fr_emb": ["emb"], "fsc": ["fsc"], "eu_fr": ["fr "], "eu_de": ["de b", "de h", "de m", "de n", "de r", "de s", "de t"],
    "rspo": ["rspo-"], "fr_gluten": ["fr-"],
    "en:organic": ["ingr", "agriculture", "production"], "es-eco": ["eco"], "fr:ab-agriculture-biologique": ["certifi"],
    "fr:label-rouge": ["homologation"], "fr:aoc": ["aoc"], "en:nutriscore": ["nutri-score"], "en:eu-non-eu-agriculture": ["agriculture"],
    "en:eu-agriculture": ["agriculture"], "en:non-eu-agriculture": ["agriculture"],
    "with_mention": ["poids", "masse nette", "volume net", "net w", "peso", "netto"], "with_ending_mention": ["net"], "multi_packaging": ["x"],
}

TRACE_PROMPT = (
    r"(?iu)(?:possibilit[ée] de traces|conditionné dans un atelier qui manipule"
    r"|peut contenir(?: des traces)?|traces? [ée]ventuelles? d[e']|traces? d[e']|may contain)"
)

ORGANIC_MARK = r"(?:(?:\* ?=?|\(¹\)|\") ?)"
ORGANIC_ORIGIN_FR = r"issus? de l'agriculture (?:biologique|bio|durable)"
ORGANIC_MENTIONS = [
    rf"{ORGANIC_MARK}?ingr[ée]dients?(?: agricoles?)? {ORGANIC_ORIGIN_FR}",
    rf"{ORGANIC_MARK}?produits? {ORGANIC_ORIGIN_FR}",
    rf"{ORGANIC_MARK}?{ORGANIC_ORIGIN_FR}",
    rf"{ORGANIC_MARK}organic(?: farming)?",
    rf"{ORGANIC_MARK}?aus biologischer landwirtschaft",
    rf"{ORGANIC_MARK}?procedentes del cultivo ecol[óo]gico",
    rf"{ORGANIC_MARK}?de cultivo ecol[óo]gico certificado",
    rf"{ORGANIC_MARK}?ingredientes? ecol[óo]gicos?",
    rf"{ORGANIC_MARK}?biologico",
]

NUTRIENT_UNITS = {
    "energy": ["kj", "kcal"], "saturated_fat": ["g"], "trans_fat": ["g"], "fat": ["g"],
    "sugar": ["g"], "carbohydrate": ["g"], "protein": ["g"], "salt": ["g", "mg"],
    "fiber": ["g"],
}
NUTRIENT_VALUE_PATTERN = r"(?iuU)(?<!\w)([0-9]+[,.]?[0-9]*) ?(g|kj|kcal)(?!\w)"
NUTRIENT_MENTIONS = {
    "energy": [
        ("énergie", ["fr"]), ("energie", ["fr", "de", "nl"]), ("valeurs? [ée]nerg[ée]tiques?", ["fr"]),
        ("energy", ["en"]), ("calories", ["fr", "en"]), ("energia", ["es", "it", "pt", "hu"]),
        ("valor energ[ée]tico", ["es"]), ("energi", ["da"]),
    ],
    "saturated_fat": [
        ("mati[èe]res? grasses? satur[ée]s?", ["fr"]), ("acides? gras satur[ée]s?", ["fr"]),
        ("dont satur[ée]s?", ["fr"]), ("acidi grassi saturi", ["it"]), ("saturated fat", ["en"]),
        ("of which saturates", ["en"]), ("verzadigde vetzuren", ["nl"]), ("waarvan verzadigde", ["nl"]),
        ("gesättigte fettsäuren", ["de"]), ("[aá]cidos grasos saturados", ["es"]),
        ("dos quais saturados", ["pt"]), ("mættede fedtsyrer", ["da"]),
        ("amelyb[őö]l? telített zs[íi]rsavak", ["hu"]),
    ],
    "trans_fat": [("mati[èe]res? grasses? trans", ["fr"]), ("trans fat", ["en"])],
    "fat": [
        ("mati[èe]res? grasses?", ["fr"]), ("graisses?", ["fr"]), ("lipides?", ["fr"]),
        ("total fat", ["en"]), ("vetten", ["nl"]), ("fett", ["de"]), ("grasas", ["es"]),
        ("grassi", ["it"]), ("l[íi]pidos", ["es", "pt"]), ("fedt", ["da"]), ("zs[íi]r", ["hu"]),
    ],
    "sugar": [
        ("sucres?", ["fr"]), ("sugars?", ["en"]), ("zuccheri", ["it"]), ("suikers?", ["nl"]),
        ("zucker", ["de"]), ("az[úu]cares", ["es"]), ("sukkerarter", ["da"]),
        ("amelyb[őö]l? cukrok", ["hu"]),
    ],
    "carbohydrate": [
        ("total carbohydrate", ["en"]), ("glucids?", ["fr"]), ("glucides?", ["en"]),
        ("carboidrati", ["it"]), ("koolhydraten", ["nl"]), ("koolhydraat", ["nl"]),
        ("kohlenhydrate", ["de"]), ("hidratos de carbono", ["es", "pt"]), ("kulhydrat", ["da"]),
        ("szénhidrát", ["hu"]),
    ],
    "protein": [
        ("prot[ée]ines?", ["fr"]), ("protein", ["en", "da"]), ("eiwitten", ["nl"]), ("eiweiß", ["de"]),
        ("prote[íi]nas", ["es", "pt"]), ("fehérje", ["hu"]),
    ],
    "salt": [
        ("sel", ["fr"]), ("salt", ["en", "da"]), ("zout", ["nl"]), ("salz", ["de"]), ("sale", ["it"]),
        ("sal", ["es", "pt"]), ("só", ["hu"]),
    ],
    "fiber": [
        ("fibres?", ["en", "fr", "it"]), ("(?:dietary )?fibers?", ["en"]), ("fibres? alimentaires?", ["fr"]),
        ("(?:voedings)?vezels?", ["nl"]), ("ballaststoffe", ["de"]),
        ("fibra(?: alimentaria)?", ["es"]), ("kostfibre", ["da"]), ("rost", ["hu"]),
    ],
    "nutrition_values": [
        ("informations? nutritionnelles?(?: moyennes?)?", ["fr"]),
        ("valeurs? nutritionnelles?(?: moyennes?)?", ["fr"]), ("analyse moyenne pour", ["fr"]),
        ("valeurs? nutritives?", ["fr"]), ("valeurs? moyennes?", ["fr"]),
        ("nutrition facts?", ["en"]), ("average nutritional values?", ["en"]),
        ("valori nutrizionali medi", ["it"]), ("gemiddelde waarden per", ["nl"]),
        ("nutritionele informatie", ["nl"]), ("(?:er)?næringsindhold", ["da"]),
        ("átlagos tápérték(?:tartalom)?", ["hu"]), ("tápérték adatok", ["hu"]),
    ],
}

ENTITY_VALUE_PATTERN = r"(?iu)(< ?)?((?:[0-9]+[,.]?[0-9]*)|O) ?(g|mg|µg|mcg|kj|kcal)?"
NINE_AS_G_NUTRIENTS = [
    "proteins", "sugars", "carbohydrates", "fat", "fiber", "salt",
    "saturated_fat", "added_sugars", "trans_fat",
]

# --- fixed values: event routing ---------------------------------------------

BULK_USERS = ["scanbot", "update_all_products"]
OCR_TASKS = [
    "extract_ingredients", "extract_nutrition", "predict_category",
    "import_insights_from_image", "run_logo_object_detection",
]
UPLOAD_TASKS = ["add_image_fingerprint", "run_nutrition_table_object_detection"]
