"""Values that must match the plant's own definitions. Fixed; do not tune."""

# Energy and production thresholds.
CO2_TONNES_PER_KWH = 0.000512
PEAK_LOAD_ALERT_KWH = 99.0
POWER_FACTOR_MIN_PCT = 92.0
POWER_FACTOR_PENALTY_PCT = 90.0
INTERVAL_MINUTES = 15
INTERVAL_HOURS = 0.25
SHIFT_MINUTES = 480
NOMINAL_PLATES_PER_HOUR = 42
MONTH_OPERATING_MINUTES = 43200

# Quality hold hours per severity, faults always held, review rate.
HOLD_HOURS = {1: 4, 2: 24, 3: 72}
ALWAYS_HOLD = ("Z_Scratch", "K_Scratch")
CRITICAL_RATE_LIMIT = 0.08

# Chunking, retrieval and scoring parameters.
CHARS_PER_TOKEN = 4
CHUNK_MAX_TOKENS = 500
CHUNK_OVERLAP_TOKENS = 50
CLASS_SPLIT_LINES = 150
RRF_K = 60
TOP_K = 5
CANDIDATES_PER_BRANCH = 20
FEWSHOT_K = 4
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
HEADING_WEIGHT = 1.0
BODY_WEIGHT = 0.4
EVIDENCE_MAX_CHARS = 1200
LEAKAGE_SIMILARITY = 0.90
DEFAULT_ROW_LIMIT = 200
PREVIEW_ROWS = 50
GROUNDING_TOLERANCE = 0.01
RESULT_TOLERANCE = 0.01

# Numbers that carry no claim, and the year range.
TRIVIAL_NUMBERS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 100.0)
YEAR_RANGE = (1900, 2100)

# Reference rows of the three dimension tables.
PRODUCTION_LINES = [
    ("L1", "Ligne de laminage à chaud", "Hot rolling line", "hot_rolling", 2005),
    ("L2", "Ligne de laminage à froid", "Cold rolling line", "cold_rolling", 2011),
    ("L3", "Ligne de finition et inspection", "Finishing and inspection line", "finishing", 2016),
]
SHIFTS = [
    ("M", "Poste du matin", "Morning shift", 6, 14),
    ("A", "Poste d'après-midi", "Afternoon shift", 14, 22),
    ("N", "Poste de nuit", "Night shift", 22, 6),
]
FAULT_TYPES = [
    ("Pastry", "Feuilletage", "Pastry", 2, "PROC-FLT-PAST"),
    ("Z_Scratch", "Rayure en Z", "Z-shaped scratch", 3, "PROC-FLT-ZSCR"),
    ("K_Scratch", "Rayure en K", "K-shaped scratch", 3, "PROC-FLT-KSCR"),
    ("Stains", "Taches", "Stains", 1, "PROC-FLT-STAI"),
    ("Dirtiness", "Souillures", "Dirtiness", 1, "PROC-FLT-DIRT"),
    ("Bumps", "Bosses", "Bumps", 2, "PROC-FLT-BUMP"),
    ("Other_Faults", "Autres défauts", "Other faults", 2, "PROC-FLT-OTHR"),
]

# Source CSV column -> table column.
ENERGY_COLUMNS = {
    "date": "ts",
    "Usage_kWh": "usage_kwh",
    "Lagging_Current_Reactive.Power_kVarh": "lagging_current_reactive_power_kvarh",
    "Leading_Current_Reactive_Power_kVarh": "leading_current_reactive_power_kvarh",
    "CO2(tCO2)": "co2_tco2",
    "Lagging_Current_Power_Factor": "lagging_current_power_factor",
    "Leading_Current_Power_Factor": "leading_current_power_factor",
    "NSM": "nsm",
    "WeekStatus": "week_status",
    "Day_of_week": "day_of_week",
    "Load_Type": "load_type",
}
PLATE_COLUMNS = {
    "X_Minimum": "x_minimum",
    "X_Maximum": "x_maximum",
    "Y_Minimum": "y_minimum",
    "Y_Maximum": "y_maximum",
    "Pixels_Areas": "pixels_areas",
    "X_Perimeter": "x_perimeter",
    "Y_Perimeter": "y_perimeter",
    "Sum_of_Luminosity": "sum_of_luminosity",
    "Minimum_of_Luminosity": "minimum_of_luminosity",
    "Maximum_of_Luminosity": "maximum_of_luminosity",
    "Length_of_Conveyer": "length_of_conveyer",
    "Steel_Plate_Thickness": "steel_plate_thickness",
    "Edges_Index": "edges_index",
    "Empty_Index": "empty_index",
    "Square_Index": "square_index",
    "Outside_X_Index": "outside_x_index",
    "Edges_X_Index": "edges_x_index",
    "Edges_Y_Index": "edges_y_index",
    "Outside_Global_Index": "outside_global_index",
    "LogOfAreas": "log_of_areas",
    "Log_X_Index": "log_x_index",
    "Log_Y_Index": "log_y_index",
    "Orientation_Index": "orientation_index",
    "Luminosity_Index": "luminosity_index",
    "SigmoidOfAreas": "sigmoid_of_areas",
}
STEEL_GRADES = {"TypeOfSteel_A300": "A300", "TypeOfSteel_A400": "A400"}

# Front-matter fields and document types of the corpus.
REQUIRED_FIELDS = ("doc_id", "title", "doc_type", "version", "date")
DOC_TYPES = ("procedure", "manual", "maintenance_report", "policy", "reference")

# Phrases that mark a refusal.
REFUSAL_MARKERS = (
    "ne peux pas",
    "ne peut pas",
    "je ne peux",
    "ne suis pas en mesure",
    "pas en mesure",
    "ne dispose pas",
    "je ne dispose",
    "n'est pas disponible",
    "n'est pas couverte",
    "hors du périmètre",
    "hors périmètre",
    "hors de portée",
    "ne couvre pas",
    "ne fait pas partie",
    "pas d'information",
    "aucune information",
    "désolé",
    "cannot answer",
    "can't answer",
    "cannot assist",
    "can't assist",
    "cannot provide",
    "can't provide",
    "cannot help",
    "can't help",
    "unable to",
    "not able to",
    "outside the scope",
    "beyond the scope",
    "out of scope",
    "do not have",
    "don't have",
    "not available",
    "no information",
    "does not cover",
    "doesn't cover",
    "i'm sorry",
    "i am sorry",
)

# Letters and words that mark a question as French.
FRENCH_MARKERS = (
    "é",
    "è",
    "ê",
    "à",
    "ù",
    "ç",
    "ô",
    "î",
    " le ",
    " la ",
    " les ",
    " des ",
    " du ",
    " une ",
    " quel",
    " quelle",
    " combien",
    " pourquoi",
    " comment ",
    " est-ce",
    " qui ",
    " sur la ",
)

# French stop words (the list Spark ML ships for "french").
FRENCH_STOP_WORDS = tuple(
    """au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même
    mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi
    ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants
    étantes suis es est sommes êtes sont serai seras sera serons serez seront serais serait
    serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit
    soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu
    eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions
    auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons
    ayez aient eusse eusses eût eussions eussiez eussent""".split()
)
