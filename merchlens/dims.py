"""Fixed values and the small dimension tables built from them.

Every table here has a fixed, known size (27 categories, 13 measures, ...), so it
is safe to broadcast whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import local_rows

# --- Fixed values: category code, full name, short name, group ---------------------------
CATEGORIES: list[tuple[int, str, str, str]] = [
    (10, "Livres techniques, éducatifs, artistiques ou spirituels", "Livres techniques", "Livres & Médias"),
    (40, "Rétro Gaming", "Rétro Gaming", "Jeux Vidéo"),
    (50, "Accessoires & Périphériques de Jeux Vidéo", "Accessoires JV", "Jeux Vidéo"),
    (60, "Consoles", "Consoles", "Jeux Vidéo"),
    (1140, "Figurine", "Figurine", "Jouets & Loisirs"),
    (1160, "Jeu de carte à collectionner", "Cartes à collectionner", "Jouets & Loisirs"),
    (1180, "Jeux de rôle & figurines", "Jeux de rôle", "Jouets & Loisirs"),
    (1280, "Jouets, Figurines et Poupées", "Jouets & Figurines", "Jouets & Loisirs"),
    (1281, "Jeux éducatifs & Créatifs", "Jeux éducatifs", "Jouets & Loisirs"),
    (1300, "Modélisme & Drones", "Modélisme & Drones", "Jouets & Loisirs"),
    (1301, "Bébé, Jeux & Loisirs", "Bébé & Jeux", "Bébé & Enfant"),
    (1302, "Sport, Loisirs & Plein Air", "Sport & Loisirs", "Sport & Vie"),
    (1320, "Bébé & Puériculture", "Bébé & Puériculture", "Bébé & Enfant"),
    (1560, "Équipement de la maison & décoration", "Équipement maison", "Maison & Jardin"),
    (1920, "Textiles d'intérieur", "Textiles", "Maison & Jardin"),
    (1940, "Alimentation & Épicerie", "Alimentation", "Sport & Vie"),
    (2060, "Décoration & Éclairage", "Déco & Éclairage", "Maison & Jardin"),
    (2220, "Animaux & Accessoires", "Animaux", "Sport & Vie"),
    (2280, "Journaux, magazines et revues", "Journaux & magazines", "Livres & Médias"),
    (2403, "Séries & encyclopédies", "Séries & encyclopédies", "Livres & Médias"),
    (2462, "Jeux Vidéo Modernes", "Jeux Vidéo", "Jeux Vidéo"),
    (2522, "Fournitures de bureau & papeterie", "Fournitures bureau", "Sport & Vie"),
    (2582, "Jardinage, déco & extérieur", "Jardinage & déco", "Maison & Jardin"),
    (2583, "Piscine & équipement de piscine", "Piscine", "Maison & Jardin"),
    (2585, "Jardin, Bricolage & Outillage", "Jardin & Bricolage", "Maison & Jardin"),
    (2705, "Romans, récits et littérature", "Romans & littérature", "Livres & Médias"),
    (2905, "Jeux PC en Téléchargement", "Jeux PC", "Jeux Vidéo"),
]
CANONICAL_CLASSES: list[int] = [row[0] for row in CATEGORIES]  # position = encoded label
CANONICAL_FINGERPRINT = "cdfa70b13f7390e6"

# --- Fixed values: measure thresholds (last bucket is open) and bucket labels --------------
BUCKETS: dict[str, tuple[list[float], list[str]]] = {
    "volume": ([0.0, 5e3, 1.5e6], ["petit volume", "volume moyen", "grand volume"]),
    "surface": ([0.0, 1600.0, 2e4], ["petite surface", "surface moyenne", "grande surface"]),
    "length": (
        [0.0, 10.0, 40.0, 350.0],
        ["petite longueur", "longueur moyenne", "grande longueur", "très grande longueur"],
    ),
    "weight": ([0.0, 1.5, 20.0], ["poids leger", "poids moyen", "poids lourd"]),
    "price": ([0.0, 20.0, 100.0], ["prix bas", "prix moyen", "prix eleve"]),
    "age": ([0.0, 3.0, 15.0], ["age bébé", "age enfant", "age adulte"]),
    "memory": ([0.0, 8.0, 64.0], ["petite mémoire", "mémoire moyenne", "grande mémoire"]),
    "date": (
        [1800.0, 1960.0, 2007.0, 2021.0],
        ["date ancienne", "date contemporaine", "date récente", "date future"],
    ),
    "numero": ([0.0, 20.0], ["petit numero", "grand numero"]),
    "card": ([0.0, 5.0], ["peu de cartes", "beaucoup de cartes"]),
    "piece": ([0.0, 3.0], ["peu de pièces", "beaucoup de pièces"]),
    "integer": (
        [0.0, 1.0, 2.0, 5.0, 20.0, 100.0],
        ["zéro", "un", "petit nombre", "nombre moyen", "grand nombre", "très grand nombre"],
    ),
    "float": (
        [0.0, 1.0, 10.0, 100.0],
        ["petite quantité", "quantité moyenne", "grande quantité", "très grande quantité"],
    ),
}

# --- Fixed values: factor of each unit to the base unit of its measure ---------------------
UNIT_FACTORS: dict[str, float] = {
    "mm": 0.1, "cm": 1.0, "dm": 10.0, "m": 100.0,
    "mm2": 0.01, "cm2": 1.0, "dm2": 100.0, "m2": 1e4,
    "mm3": 1e-3, "cm3": 1.0, "dm3": 1000.0, "m3": 1e6,
    "ml": 1.0, "cl": 10.0, "dl": 100.0, "l": 1000.0,
    "g": 1e-3, "kg": 1.0, "tonne": 1e3,
    "mois": 1 / 12, "ans": 1.0,
    "mo": 1e-3, "go": 1.0, "to": 1e3,
}


# --- Fixed values: written-out units ---------------------------------------------------------
UNIT_SPELLINGS: dict[str, str] = {
    "metre": "m", "metres": "m", "mètre": "m", "mètres": "m", "métre": "m", "métres": "m",
    "centimetre": "cm", "centimetres": "cm", "centimètre": "cm", "centimètres": "cm", "centimétre": "cm", "centimétres": "cm",
    "millimetre": "mm", "millimetres": "mm", "millimètre": "mm", "millimètres": "mm", "millimétre": "mm", "millimétres": "mm",
    "gramme": "g", "grammes": "g", "kilo": "kg", "kilos": "kg", "kilogramme": "kg", "kilogrammes": "kg",
    "tonne": "tonne", "tonnes": "tonne",
    "litre": "l", "litres": "l", "centilitre": "cl", "centilitres": "cl", "millilitre": "ml", "millilitres": "ml",
    "an": "ans", "ans": "ans",
}


# --- Fixed values: keywords per category ----------------------------------------------------
KEYWORDS: dict[str, list[str]] = {
    "Animaux": ["chien", "chat", "animal", "compagnie", "collier"],
    "Bureau & Papeterie": ["verso", "cahier", "encre", "papier", "recto", "a5"],
    "Épicerie": ["epices", "arôme", "chocolat", "sucre", "sachet", "capsule"],
    "Puériculture": ["langer", "bavoir", "assiette", "siege", "tétine", "poussette"],
    "Vêtement Bébé & Loisirs": ["bébé", "chaussettes", "paire", "longueur", "filles", "garçons"],
    "Figurines": ["figurine", "gundam", "statuette", "officiel", "marvel", "funko"],
    "Jeux de cartes": ["mtg", "oh", "rare", "vf", "carte", "magic"],
    "Jeux de rôle & Figurines": ["halloween", "figurine", "warhammer", "prince", "masque"],
    "Bricolage & Outillage": ["arrosage", "tondeuse", "aspirateur", "appareils", "outil", "coupe", "bâche"],
    "Décoration & Équipement Jardin": ["bois", "jardin", "résistant", "tente", "parasol", "aluminium"],
    "Piscine & Accessoires": ["piscine", "filtration", "pompe", "dimensions", "eau", "ronde"],
    "Accessoires & Périphériques": ["nintendo", "manette", "protection", "ps4", "silicone", "câble"],
    "Consoles": ["console", "oui", "jeu", "écran", "portable", "marque", "jeux"],
    "Jeux PC en Téléchargement": ["windows", "jeu", "directx", "plus", "téléchargement", "disque", "édition"],
    "Jeux Vidéo Modernes": ["duty", "jeux", "manettes", "ps3", "xbox", "kinect"],
    "Rétro Gaming": ["japonais", "import", "langue", "titres", "sous", "français"],
    "Jeux éducatifs": ["joue", "cartes", "enfants", "éducatif", "bois", "jouer"],
    "Jouets & Figurines": ["doudou", "enfants", "cadeau", "peluche", "jouet", "puzzle"],
    "Loisirs & Plein air": ["camping", "pêche", "stress", "stream", "bracelet", "trampoline"],
    "Modélisme & Drones": ["drone", "générique", "dji", "avion", "batterie", "cámera", "one"],
    "Littérature": ["monde", "ouvrage", "siècle", "roman", "livre", "histoire", "tome"],
    "Livres spécialisés": ["guide", "édition", "histoire", "art", "collection"],
    "Presse & Magazines": ["journal", "france", "illustre", "magazine", "presse", "revue"],
    "Séries & Encyclopédies": ["lot", "livres", "tomes", "volumes", "tome", "revues"],
    "Décoration & Lumières": ["led", "noël", "lumière", "lampe", "décoration", "couleur"],
    "Textiles d'intérieur": ["oreiller", "taie", "coussin", "couverture", "canapé", "cotton"],
    "Équipement Maison": ["matelas", "assise", "bois", "table", "hauteur", "mousse"],
}

# --- Fixed values: patterns that reveal a unit of measure -----------------------------------
UNIT_PATTERNS: dict[str, str] = {
    "cm": r"\b\d+\s*(cm|centimetre?s?|centimètre?s?)\b",
    "mm": r"\b\d+\s*(mm|millimetre?s?|millimètre?s?)\b",
    "m": r"\b\d+\s*(m|metre?s?|mètre?s?)\b",
    "kg": r"\b\d+\s*(kg|kilo|kilogramme?s?)\b",
    "g": r"\b\d+\s*(g|gramme?s?)\b",
    "ml": r"\b\d+\s*(ml|millilitres?|millilitre?)\b",
    "l": r"\b\d+\s*(l|litres?|litre?)\b",
    "cl": r"\b\d+\s*cl\b",
    "x_dim": r"\b\d+\s*(x|×)\s*\d+(\s*(cm|mm|m))?\b",
    "age_ans": r"\b\d+\s*ans\b",
    "age_mois": r"\b\d+\s*mois\b",
    "age_range_ans": r"\b\d+\s*[-–/]\s*\d+\s*ans\b",
    "age_range_mois": r"\b\d+\s*[-–/]\s*\d+\s*mois\b",
    "age_min_ans": r"\b(?:à\s*partir\s*de\s*)?\d+\s*ans\s*(?:et\s*plus|\+|plus)?\b",
    "pointure": r"\bpointures?\s*:?(\s*(eu|eur|fr))?\s*\d{2}(?:[.,]\d)?(\s*[-/]\s*\d{2}(?:[.,]\d)?)?\b",
    "inch": r"\b\d+\s*(\"|pouces?|po)\b",
    "time_heures": r"\b\d+\s*(?:h|heures?)\b",
    "time_jours": r"\b\d+\s*jours?\b",
    "go": r"\b\d+\s*(go|giga-?octets?)\b",
    "gb": r"\b\d+\s*(gb|gigabytes?)\b",
    "mo": r"\b\d+\s*(mo|méga-?octets?|mega-?octets?)\b",
    "mb": r"\b\d+\s*(mb|megabytes?)\b",
    "ko": r"\b\d+\s*(ko|kilo-?octets?)\b",
    "kb": r"\b\d+\s*(kb|kilobytes?)\b",
    "ram": r"\b\d+\s*(go|gb|mo|mb)\s*ram\b",
    "vram": r"\b\d+\s*(go|gb|mo|mb)\s*vram\b",
    "ghz": r"\b\d+(?:\.\d+)?\s*ghz\b",
    "mhz": r"\b\d+(?:\.\d+)?\s*mhz\b",
    "bits": r"\b(32|64)\s*[- ]?(?:bit|bits)\b",
    "kbps": r"\b\d+\s*kbps\b",
    "mbps": r"\b\d+\s*mbps\b",
    "fps": r"\b\d+\s*fps\b",
}

# --- Fixed values: template phrases, stop words, punctuation --------------------------------
BOILERPLATE_PHRASES = ["li li strong", "li li", "br br", "et de"]

STOPWORDS_FR = """
au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon
ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous
c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est sommes êtes sont serai seras
sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes
fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes
ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez
auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses
eût eussions eussiez eussent
""".split()

STOPWORDS_EN = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom
this that that'll these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn
hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

STOPWORDS = sorted(set(STOPWORDS_FR) | set(STOPWORDS_EN))

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "…«»•·–—‹›"

# --- Fixed values: pixel colour classes, in class order -------------------------------------
COLOR_CLASSES = [
    "noir", "gris", "blanc", "rouge", "orange", "jaune",
    "vert", "turquoise", "cyan", "bleu", "violet", "rose",
]

# --- Fixed values: vectoriser presets --------------------------------------------------------
VECTORIZER_PRESETS: dict[str, dict] = {
    "baseline": {"max_features": 10000, "ngram_range": (1, 2), "min_df": 2, "max_df": 0.95},
    "small": {"max_features": 5000, "ngram_range": (1, 1), "min_df": 2, "max_df": 0.95},
    "large": {"max_features": 20000, "ngram_range": (1, 3), "min_df": 2, "max_df": 0.95},
    "unigram": {"max_features": 10000, "ngram_range": (1, 1), "min_df": 2, "max_df": 0.95},
    "trigram": {"max_features": 15000, "ngram_range": (1, 3), "min_df": 2, "max_df": 0.95},
}


def category_dim(spark: SparkSession) -> DataFrame:
    return F.broadcast(local_rows(spark, CATEGORIES, "code int, name string, short_name string, group_name string"))


def class_dim(spark: SparkSession, classes: list[int] | None = None) -> DataFrame:
    rows = list(enumerate(classes or CANONICAL_CLASSES))
    return F.broadcast(local_rows(spark, rows, "class_idx int, code int"))
