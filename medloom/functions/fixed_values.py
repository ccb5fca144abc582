"""Word lists, patterns, weights and thresholds that decide results.

Nothing here is derived. Every table is a plain list in its natural order; operators turn the
tables into dimension DataFrames (``medloom.functions.dims``).
"""

# --- fixed values: dosha codes -------------------------------------------------------------
DOSHAS = ("vata", "pitta", "kapha")
DOSHA_CODES = ("vata", "pitta", "kapha", "vata-pitta", "vata-kapha", "pitta-kapha", "tridosha")
GUNAS = ("sattva", "rajas", "tamas")

# --- fixed values: body-system aliases, tested in this order by substring -------------------
SYSTEM_ALIASES = (
    ("gastrointestinal", "digestive"), ("abdomen", "digestive"), ("ano-rectal", "digestive"),
    ("digestive", "digestive"), ("liver", "digestive"), ("mouth", "oral-dental"),
    ("teeth", "oral-dental"), ("nose", "ent"), ("ear", "ent"), ("throat", "ent"),
    ("head", "nervous"), ("nervous", "nervous"), ("mental", "mental"), ("psychiatric", "mental"),
    ("eye", "eye"), ("skin", "skin"), ("urinary", "urinary"), ("renal", "urinary"),
    ("musculoskeletal", "musculoskeletal"), ("joints", "musculoskeletal"),
    ("gynaecology", "reproductive"), ("obstetrics", "reproductive"),
    ("reproductive", "reproductive"), ("male", "reproductive"), ("respiratory", "respiratory"),
    ("cardiovascular", "cardiovascular"), ("heart", "cardiovascular"), ("blood", "blood"),
    ("metabolic", "metabolic"), ("endocrine", "metabolic"), ("paediatric", "paediatric"),
    ("systemic", "systemic"), ("toxicology", "systemic"), ("infectious", "systemic"),
)
UNLABELLED_SYSTEMS = ("unspecified", "other")
UNKNOWN_ANSWERS = ("i don't know", "i dont know", "i prefer not to say", "prefer not to say", "")

# --- fixed values: data-quality gate ---------------------------------------------------------
PII_NAME = r"(?i)(^|_|\s)(name|phone|mobile|email|address|aadhaar|dob)($|_|\s)"
CONFLICT_STOP_WORDS = (
    "of", "or", "and", "in", "on", "the", "a", "an", "with", "to", "side", "severe", "mild",
    "difficulty",
)
GATE = {
    "max_duplicate_rate": 0.05,
    "max_null_rate": 0.30,
    "min_text_uniqueness": 0.20,
    "noise_feature_alpha": 0.01,
    "max_noise_feature_share": 0.50,
}

# --- fixed values: symptom phrase normalisation ----------------------------------------------
QUALIFIERS = (
    "severe", "mild", "moderate", "chronic", "acute", "recurrent", "persistent", "intermittent",
    "frequent", "excessive", "increased", "marked", "progressive", "sudden", "occasional",
    "slight", "extreme", "intense", "constant", "general", "generalized", "generalised",
    "localized", "localised", "bilateral", "unilateral", "significant", "gradual", "episodic",
    "prolonged", "repeated", "profuse", "very", "some", "possible",
)
DESCRIPTORS = (
    "hard", "soft", "warm", "cold", "non-tender", "tender", "painless", "slow growing", "smooth",
    "firm", "mobile", "fixed", "small", "large", "thick", "thin", "white", "red", "yellow",
    "black", "dark", "pale", "sticky", "foul", "round", "irregular", "dry", "moist", "rough",
    "shiny", "slow", "fast", "etc", "others", "other symptoms", "variable", "associated",
    "especially", "symptoms", "signs", "condition", "cases", "may", "later", "chronic", "course",
    "deep", "dull", "eyes", "feet", "hot", "movement", "onset", "recurrent", "severe", "sweet",
    "worse", "worsens", "refractory", "pulsatile", "mixed features", "pitting", "blood", "heat",
    "infections", "frequency", "systemic features", "systemic disease", "neurological symptoms",
    "skin changes", "watering", "urination", "wasting",
)
SPELLING = (
    (r"oedema", "edema"), (r"oea\b", "ea"), (r"diarrhoea", "diarrhea"), (r"haem", "hem"),
    (r"anaem", "anem"), (r"aemia", "emia"), (r"oesoph", "esoph"), (r"colour", "color"),
    (r"tumour", "tumor"), (r"behaviour", "behavior"), (r"paediatric", "pediatric"),
)
SYNONYMS = {
    "breathlessness": "shortness of breath", "dyspnea": "shortness of breath",
    "difficulty breathing": "shortness of breath",
    "difficulty in breathing": "shortness of breath",
    "breathing difficulty": "shortness of breath", "labored breathing": "shortness of breath",
    "high blood pressure": "hypertension", "elevated blood pressure": "hypertension",
    "tiredness": "fatigue", "exhaustion": "fatigue", "lethargy": "fatigue",
    "debility": "weakness", "body weakness": "weakness", "emesis": "vomiting",
    "anorexia": "loss of appetite", "poor appetite": "loss of appetite",
    "reduced appetite": "loss of appetite", "decreased appetite": "loss of appetite",
    "appetite loss": "loss of appetite", "pruritus": "itching", "itchiness": "itching",
    "itchy skin": "itching", "pyrexia": "fever", "high fever": "fever",
    "low-grade fever": "fever", "low grade fever": "fever", "sleeplessness": "insomnia",
    "difficulty sleeping": "insomnia", "sleep disturbance": "insomnia",
    "sleep disturbances": "insomnia", "painful": "pain", "aches": "pain", "ache": "pain",
    "pains": "pain", "dryness": "dryness", "loose stools": "diarrhea",
    "loose motions": "diarrhea", "watery stools": "diarrhea", "frequent urination": "polyuria",
    "excessive urination": "polyuria", "excessive thirst": "thirst", "polydipsia": "thirst",
    "swollen": "swelling", "inflammation": "swelling", "puffiness": "swelling",
    "giddiness": "dizziness", "vertigo": "dizziness", "lightheadedness": "dizziness",
    "body ache": "body pain", "body aches": "body pain", "muscle aches": "muscle pain",
    "myalgia": "muscle pain", "arthralgia": "joint pain", "joint pains": "joint pain",
    "stomach pain": "abdominal pain", "abdominal discomfort": "abdominal pain",
    "stomach ache": "abdominal pain", "tummy pain": "abdominal pain", "skin rash": "rash",
    "rashes": "rash", "skin rashes": "rash", "weight gain": "weight gain",
    "obesity": "weight gain", "burning": "burning sensation", "heartburn": "acidity",
    "hyperacidity": "acidity", "acid reflux": "acidity", "sour belching": "acidity",
    "anxiety": "anxiety", "palpitation": "palpitations", "heavy": "heaviness",
    "coughing": "cough", "inflamed": "swelling", "thickened": "thickening",
    "headaches": "headache", "heavy feeling": "heaviness", "feeling of heaviness": "heaviness",
    "heaviness of body": "heaviness", "watering eyes": "lacrimation",
    "watery eyes": "lacrimation", "excessive lacrimation": "lacrimation",
    "jaundice": "jaundice", "yellowing of skin": "jaundice",
}
MEANING_PREFIXES = ("hyper", "hypo", "non", "an", "dys", "poly", "oligo")
MERGE_SIMILARITY = 0.88
MIN_DOC_FREQ = 3

# --- fixed values: phonetic key of romanised Sanskrit ----------------------------------------
PHONETIC_FOLDS = (
    ("sh", "s"), ("aa", "a"), ("ii", "i"), ("uu", "u"), ("bh", "b"), ("dh", "d"), ("th", "t"),
    ("kh", "k"), ("gh", "g"), ("ph", "p"), ("ch", "c"), ("jh", "j"), ("v", "w"), ("ee", "i"),
    ("oo", "u"),
)
PHONETIC_TAGS = (("wata", "vata"), ("pitta", "pitta"), ("kapa", "kapha"), ("sannipat", "tridosha"))
LINK_SIMILARITY = 0.80

# --- fixed values: prevalence classes and preferences ----------------------------------------
PREVALENCE_CLASSES = (
    (">1 / 1000", 2e-3), ("6-9 / 10 000", 7.5e-4), ("1-5 / 10 000", 3e-4),
    ("1-9 / 100 000", 5e-5), ("1-9 / 1 000 000", 5e-6), ("<1 / 1 000 000", 5e-7),
)
CASE_REPORTS_TYPE = "Cases/families"
CASE_REPORTS_PREVALENCE = 2e-7
GENERIC_SUFFIXES = (
    "fever", "disease", "hemorrhagic", "haemorrhagic", "virus", "infection", "syndrome",
)
GEOGRAPHY_PREFERENCE = ("India", "South East Asia", "Asia", "Worldwide")
TYPE_PREFERENCE = (
    "Point prevalence", "Annual incidence", "Prevalence at birth", "Lifetime prevalence",
    "Cases/families",
)

# --- fixed values: literature key and endemic pattern ----------------------------------------
KEY_QUALIFIERS = ("acute", "chronic", "mild", "severe", "early", "late", "recurrent", "general")
ENDEMIC_PATTERN = (
    r"(?i)virus|viral|fever|(?<!psor)(?<!lith)(?<!ondr)iasis|infection|bacterial|plague|pox|"
    r"typhus|malaria|leprosy|tuberculosis|mycosis|fung|worm|parasit|tick|pinta|yaws|tularemia|"
    r"cholera|encephalitis|poisoning|disease of|borrelia|rickett|leishman|trypanosom|ebola|zika|"
    r"dengue|chikungunya|lyme|chagas|toxo|amoeb|amebi|giardi|cysticerc|hydatid"
)
REGIONAL_BASELINE_SHARE = 0.03
REGIONAL_MIN_HITS = 30

# --- fixed values: age and sex wording --------------------------------------------------------
AGE_WORDS = (
    (r"neonat|from birth|congenital|infant", 0, 2),
    (r"pregnan|post-?partum|lactating|reproductive", 15, 49),
    (r"post-?menopaus", 45, 120),
    (r"child", 0, 18),
    (r"elderly|old age", 60, 120),
    (r"young adult", 18, 35),
    (r"middle-aged", 40, 65),
    (r"adult", 18, 120),
)
FEMALE_WORDS = r"female|women|woman|pregnan|menopaus|post-?partum|lactat|multiparous|gynae"
MALE_WORDS = r"(?<![a-z])(?:males?|men)(?![a-z])|prostat"
LEANING_WORDS = r"more|predominant|mostly|common|slightly|\d+x"

# --- fixed values: emergency checklist (code, advice) and symptom triggers --------------------
RED_FLAGS = (
    ("chest_pain", "Possible heart attack. Call 112/108 now. Chew an aspirin only if a doctor has advised it."),
    ("stroke", "Possible stroke - every minute matters. Call 112/108 now and note the time it started."),
    ("breathing", "Breathing emergency. Call 112/108 now."),
    ("unconscious", "Seek emergency care now."),
    ("bleeding", "Possible internal bleeding. Go to an emergency department now."),
    ("meningitis", "Possible meningitis or sepsis. Go to an emergency department now."),
    ("headache", "Seek emergency care now."),
    ("abdomen", "Seek emergency care now."),
    ("pregnancy", "Obstetric emergency. Go to the nearest hospital with maternity services now."),
    ("infant", "Seek emergency paediatric care now."),
    ("allergy", "Possible anaphylaxis. Call 112/108 now."),
    ("self_harm", "You are not alone. Call Tele-MANAS 14416 (24x7, free) or 112 now."),
)
SYMPTOM_TRIGGERS = (
    ("chest pain", "chest_pain"), ("facial deviation", "stroke"), ("paralysis", "stroke"),
    ("difficulty speaking", "stroke"), ("loss of consciousness", "unconscious"),
    ("unconsciousness", "unconscious"), ("seizures", "unconscious"), ("fainting", "unconscious"),
    ("hemoptysis", "bleeding"), ("blood in stool", "bleeding"), ("vision loss", "headache"),
)

# --- fixed values: seasons (name, start month, start day, text) and dosha cycle ---------------
SEASONS = (
    ("shishira", 1, 15, "Late winter - cold, dry; Kapha accumulates."),
    ("vasanta", 3, 15, "Spring - Kapha liquefies and aggravates; digestion weakens."),
    ("grishma", 5, 15, "Summer - heat, dryness; Vata accumulates, Kapha subsides."),
    ("varsha", 7, 15, "Monsoon - Vata aggravates, Pitta accumulates; digestion weakest."),
    ("sharad", 9, 15, "Autumn - Pitta aggravates after the rains."),
    ("hemanta", 11, 15, "Early winter - strongest digestion; Pitta subsides."),
)
DOSHA_CYCLE = {
    "vata": {"grishma": "chaya", "varsha": "prakopa", "sharad": "prashama"},
    "pitta": {"varsha": "chaya", "sharad": "prakopa", "hemanta": "prashama"},
    "kapha": {"shishira": "chaya", "vasanta": "prakopa", "grishma": "prashama"},
}
STATE_WEIGHTS = {"prakopa": 1.20, "chaya": 1.08, "prashama": 0.95, "neutral": 1.0}
HABITAT_DOSHAS = {"jangala": ("vata", "pitta"), "anupa": ("kapha", "vata"), "sadharana": ()}
HABITAT_FACTOR = 1.05

# --- fixed values: differential model ---------------------------------------------------------
THETA_LISTED = 0.8
BETA_IMBALANCE = 1.0
GAMMA_CONSTITUTION = 0.5
FEEDBACK_PSEUDO_CASES = 10.0
LLR_PSEUDO_COUNT = 5.0
DUAL_MARGIN = 0.10

# --- fixed values: examination and history evidence (source, item, dosha, weight) --------------
EVIDENCE_WEIGHTS = (
    ("pariksha.nadi", "sarpa_vata", "vata", 1.2), ("pariksha.nadi", "manduka_pitta", "pitta", 1.2),
    ("pariksha.nadi", "hamsa_kapha", "kapha", 1.2),
    ("pariksha.jihva", "dry_cracked", "vata", 0.8), ("pariksha.jihva", "red_inflamed", "pitta", 0.8),
    ("pariksha.jihva", "coated_white", "kapha", 0.8),
    ("pariksha.mala", "hard_dry", "vata", 0.8), ("pariksha.mala", "loose_burning", "pitta", 0.8),
    ("pariksha.mala", "sticky_heavy", "kapha", 0.8),
    ("pariksha.mutra", "scanty_clear", "vata", 0.5),
    ("pariksha.mutra", "dark_yellow_burning", "pitta", 0.8),
    ("pariksha.mutra", "cloudy_turbid", "kapha", 0.5),
    ("pariksha.shabda", "hoarse_dry", "vata", 0.5), ("pariksha.shabda", "sharp_loud", "pitta", 0.5),
    ("pariksha.shabda", "deep_slow", "kapha", 0.5),
    ("pariksha.sparsha", "cold_dry", "vata", 0.8), ("pariksha.sparsha", "warm", "pitta", 0.8),
    ("pariksha.sparsha", "cool_moist", "kapha", 0.8),
    ("pariksha.drik", "dry_dull", "vata", 0.5), ("pariksha.drik", "red_yellowish", "pitta", 0.8),
    ("pariksha.drik", "watery_white", "kapha", 0.5),
    ("pariksha.akriti", "thin", "vata", 0.5), ("pariksha.akriti", "medium", "pitta", 0.3),
    ("pariksha.akriti", "heavy", "kapha", 0.5),
    ("anupashaya", "cold", "vata", 0.5), ("anupashaya", "cold", "kapha", 0.3),
    ("anupashaya", "wind_dryness", "vata", 0.8), ("anupashaya", "heat_sun", "pitta", 0.8),
    ("anupashaya", "spicy_sour_food", "pitta", 0.8), ("anupashaya", "damp_weather", "kapha", 0.8),
    ("anupashaya", "heavy_sweet_food", "kapha", 0.8),
    ("anupashaya", "fasting_irregular_meals", "vata", 0.8),
    ("anupashaya", "stress_overwork", "vata", 0.5), ("anupashaya", "stress_overwork", "pitta", 0.3),
    ("anupashaya", "morning", "kapha", 0.3), ("anupashaya", "afternoon_noon", "pitta", 0.3),
    ("anupashaya", "evening_dawn", "vata", 0.3),
    ("upashaya", "warmth", "vata", 0.5), ("upashaya", "warmth", "kapha", 0.3),
    ("upashaya", "oil_massage", "vata", 0.8), ("upashaya", "cool_things", "pitta", 0.8),
    ("upashaya", "fasting_light_food", "kapha", 0.8), ("upashaya", "exercise", "kapha", 0.5),
    ("upashaya", "rest", "vata", 0.3),
    ("agni", "irregular", "vata", 0.8), ("agni", "sharp_frequent_hunger", "pitta", 0.8),
    ("agni", "slow_heavy_after_meals", "kapha", 0.8),
)
AGNI_TYPES = (
    ("irregular", "vishama"), ("sharp_frequent_hunger", "tikshna"),
    ("slow_heavy_after_meals", "manda"), ("balanced", "sama"),
)
AMA_SIGNS = (
    "coated tongue", "heaviness", "tastelessness", "loss of appetite", "indigestion", "bloating",
    "fatigue", "slow digestion",
)
AMA_EXAMINED = "coated tongue (examined)"

# --- fixed values: subdoshas (name, dosha, seat, governs, signs) -------------------------------
SUBDOSHAS = (
    ("prana", "vata", "head, chest", "breathing, swallowing, mind",
     ("shortness of breath", "wheezing", "anxiety", "insomnia", "dizziness", "worry",
      "restlessness", "difficulty swallowing")),
    ("udana", "vata", "throat, chest", "speech, effort, memory",
     ("hoarseness", "difficulty speaking", "muffled voice", "memory loss", "low energy", "cough")),
    ("samana", "vata", "beside the digestive fire", "movement of food, absorption",
     ("variable appetite", "malabsorption", "diarrhea", "bloating")),
    ("vyana", "vata", "heart, whole body", "circulation, movement",
     ("palpitations", "irregular heartbeat", "tremors", "numbness", "tingling", "muscle spasm",
      "low blood pressure", "loss of sensation")),
    ("apana", "vata", "colon, pelvis", "elimination, menstruation, childbirth",
     ("constipation", "gas", "lower abdominal pain", "irregular periods", "difficulty urinating",
      "pelvic pain", "back pain", "weak stream", "difficulty passing stool", "straining",
      "tenesmus")),
    ("pachaka", "pitta", "stomach, small intestine", "digestion",
     ("acidity", "regurgitation", "burning sensation", "indigestion", "thirst", "diarrhea")),
    ("ranjaka", "pitta", "liver, spleen", "blood formation",
     ("jaundice", "anemia", "dark urine", "liver enlargement", "hepatomegaly",
      "bleeding tendency", "pallor")),
    ("sadhaka", "pitta", "heart (mind)", "emotion, intellect, ambition",
     ("anger", "irritability", "mood swings", "low mood", "depression", "agitation")),
    ("alochaka", "pitta", "eyes", "vision",
     ("red eyes", "photophobia", "eye pain", "blurred vision", "reduced vision",
      "vision problems")),
    ("bhrajaka", "pitta", "skin", "complexion, body heat",
     ("rash", "redness", "photosensitivity", "skin lesions", "hot flushes", "burning pain",
      "heat intolerance")),
    ("kledaka", "kapha", "stomach", "moistening food",
     ("heaviness", "nausea", "slow digestion", "loss of appetite", "coated tongue", "salivation")),
    ("avalambaka", "kapha", "chest, heart, lungs", "support, lubrication of chest",
     ("chest congestion", "productive cough", "mucus", "wheezing", "lung infections")),
    ("bodhaka", "kapha", "tongue", "taste",
     ("loss of taste", "tastelessness", "salivation", "coated tongue")),
    ("tarpaka", "kapha", "head, sinuses", "nourishing the senses",
     ("nasal congestion", "runny nose", "sneezing", "loss of smell", "drowsiness",
      "nasal obstruction", "congestion")),
    ("shleshaka", "kapha", "joints", "joint lubrication",
     ("joint pain", "stiffness", "swelling", "reduced range of motion", "muscle stiffness")),
)

# --- fixed values: tissues (name, nourishes, depletion signs, excess signs) ----------------------
DHATUS = (
    ("rasa", "plasma, lymph",
     ("dryness", "dry mouth", "thirst", "fatigue", "palpitations", "dehydration"),
     ("nausea", "salivation", "heaviness", "loss of appetite")),
    ("rakta", "blood",
     ("pallor", "anemia", "dry skin", "low blood pressure", "cold intolerance"),
     ("rash", "redness", "skin lesions", "abscess", "bleeding tendency", "jaundice", "red eyes",
      "hypertension")),
    ("mamsa", "muscle",
     ("emaciation", "muscle wasting", "weight loss", "muscle weakness", "weakness"),
     ("local swelling", "swollen lymph nodes", "thickening")),
    ("meda", "fat", ("emaciation", "dry skin", "joint pain"),
     ("weight gain", "sweating", "foul smell", "thirst", "fatigue")),
    ("asthi", "bone, teeth, nails, hair", ("bone pain", "fractures", "cracking", "joint pain"),
     ("skeletal deformities", "thickening")),
    ("majja", "marrow, nerves",
     ("dizziness", "blurred vision", "bone pain", "fainting", "memory loss"),
     ("heaviness", "drowsiness", "numbness")),
    ("shukra", "reproductive tissue", ("infertility", "low energy", "weakness"), ()),
)
BMI_UNDERWEIGHT = 18.5
BMI_OVERWEIGHT = 23.0
BMI_OBESE = 25.0

# --- fixed values: channels (name, carries, signs) ----------------------------------------------
SROTAS = (
    ("pranavaha", "breath",
     ("cough", "shortness of breath", "wheezing", "chest congestion", "chest tightness",
      "hemoptysis", "productive cough", "lung infections")),
    ("udakavaha", "water", ("thirst", "dry mouth", "dehydration")),
    ("annavaha", "food",
     ("loss of appetite", "indigestion", "nausea", "vomiting", "acidity", "regurgitation",
      "belching", "tastelessness", "slow digestion")),
    ("rasavaha", "plasma", ("fever", "fatigue", "heaviness", "tastelessness", "pallor")),
    ("raktavaha", "blood",
     ("skin lesions", "rash", "abscess", "jaundice", "bleeding", "epistaxis", "red eyes",
      "bleeding tendency")),
    ("mamsavaha", "muscle",
     ("muscle pain", "muscle wasting", "swollen lymph nodes", "local swelling",
      "muscle weakness")),
    ("medovaha", "fat", ("weight gain", "sweating", "thirst", "foul smell")),
    ("asthivaha", "bone",
     ("bone pain", "fractures", "deformity", "cracking", "skeletal deformities")),
    ("majjavaha", "marrow, nerves",
     ("dizziness", "fainting", "numbness", "tingling", "memory loss", "seizures", "confusion",
      "paralysis")),
    ("shukravaha", "reproductive tissue", ("infertility",)),
    ("mutravaha", "urine",
     ("burning urination", "painful urination", "dysuria", "urgency", "difficulty urinating",
      "hematuria", "blood in urine", "dark urine", "weak stream")),
    ("purishavaha", "faeces",
     ("constipation", "diarrhea", "blood in stool", "tenesmus", "straining", "gas",
      "difficulty passing stool", "abdominal cramps")),
    ("swedavaha", "sweat", ("sweating", "night sweats", "dry skin", "roughness")),
    ("artavavaha", "menstrual blood", ("irregular periods", "pelvic pain", "infertility")),
    ("manovaha", "mind",
     ("anxiety", "depression", "low mood", "mood swings", "insomnia", "hallucinations", "worry",
      "agitation", "irritability", "anger")),
)

# --- fixed values: life stages [low, high) and dosha clock [start hour, end hour) -----------------
LIFE_STAGES = (
    (0, 30, "bala", "kapha", "Growth stage - Kapha naturally predominates; prone to colds, congestion."),
    (30, 60, "madhya", "pitta", "Middle age - Pitta predominates; watch acidity, inflammation, stress."),
    (60, 200, "jirna", "vata", "Later life - Vata predominates; joints, sleep, dryness, digestion weaken."),
)
DOSHA_CLOCK = (
    (6, 10, "kapha"), (10, 14, "pitta"), (14, 18, "vata"), (18, 22, "kapha"), (22, 2, "pitta"),
    (2, 6, "vata"),
)

# --- fixed values: questionnaire options (module, question, option, signals) -----------------------
MODULE_OPTIONS = (
    ("agni_mala", "agni", "irregular", {"vata": 0.8}), ("agni_mala", "agni", "sharp", {"pitta": 0.8}),
    ("agni_mala", "agni", "slow", {"kapha": 0.8}), ("agni_mala", "agni", "balanced", {}),
    ("agni_mala", "koshtha", "hard", {"vata": 0.8}), ("agni_mala", "koshtha", "regular", {"kapha": 0.3}),
    ("agni_mala", "koshtha", "loose", {"pitta": 0.8}),
    ("agni_mala", "stool", "hard_dry", {"vata": 0.8}), ("agni_mala", "stool", "loose_burning", {"pitta": 0.8}),
    ("agni_mala", "stool", "sticky_heavy", {"kapha": 0.8}), ("agni_mala", "stool", "normal", {}),
    ("agni_mala", "urine", "scanty_clear", {"vata": 0.5}),
    ("agni_mala", "urine", "dark_yellow_burning", {"pitta": 0.8}),
    ("agni_mala", "urine", "cloudy_turbid", {"kapha": 0.5}), ("agni_mala", "urine", "normal", {}),
    ("agni_mala", "sweat", "scanty", {"vata": 0.5}), ("agni_mala", "sweat", "profuse", {"pitta": 0.8}),
    ("agni_mala", "sweat", "moderate_cool", {"kapha": 0.5}), ("agni_mala", "sweat", "normal", {}),
    ("agni_mala", "aharashakti", "small", {"vata": 0.3}), ("agni_mala", "aharashakti", "moderate", {}),
    ("agni_mala", "aharashakti", "large", {"pitta": 0.3}),
    ("ojas_bala", "energy", "steady", {}), ("ojas_bala", "energy", "dips", {"vata": 0.5}),
    ("ojas_bala", "energy", "exhausted", {"vata": 0.5, "kapha": 0.3}),
    ("ojas_bala", "recovery", "quick", {}), ("ojas_bala", "recovery", "average", {}),
    ("ojas_bala", "recovery", "slow", {"vata": 0.5}),
    ("ojas_bala", "infections", "rare", {}), ("ojas_bala", "infections", "some", {}),
    ("ojas_bala", "infections", "frequent", {"kapha": 0.5}),
    ("ojas_bala", "sleep", "refreshing", {}), ("ojas_bala", "sleep", "light", {"vata": 0.8}),
    ("ojas_bala", "sleep", "heavy", {"kapha": 0.8}),
    ("ojas_bala", "stress", "calm", {}), ("ojas_bala", "stress", "irritable", {"pitta": 0.8}),
    ("ojas_bala", "stress", "overwhelmed", {"vata": 0.8}),
    ("ojas_bala", "vyayamashakti", "high", {}), ("ojas_bala", "vyayamashakti", "moderate", {}),
    ("ojas_bala", "vyayamashakti", "low", {"vata": 0.3}),
    ("dashavidha", "samhanana", "firm", {"kapha": 0.3}), ("dashavidha", "samhanana", "moderate", {}),
    ("dashavidha", "samhanana", "loose", {"vata": 0.3}),
    ("dashavidha", "satmya", "all", {}), ("dashavidha", "satmya", "some", {}),
    ("dashavidha", "satmya", "few", {"vata": 0.3}),
    ("artava", "regularity", "regular", {}), ("artava", "regularity", "irregular", {"vata": 0.8}),
    ("artava", "regularity", "na", {}),
    ("artava", "length", "short", {"pitta": 0.5}), ("artava", "length", "normal", {}),
    ("artava", "length", "long", {"kapha": 0.5, "vata": 0.3}),
    ("artava", "flow", "scanty", {"vata": 0.8}), ("artava", "flow", "heavy", {"pitta": 0.8}),
    ("artava", "flow", "moderate", {}),
    ("artava", "pain", "cramping", {"vata": 0.8}), ("artava", "pain", "burning", {"pitta": 0.8}),
    ("artava", "pain", "dull", {"kapha": 0.8}), ("artava", "pain", "none", {}),
    ("artava", "character", "dark_clots", {"vata": 0.5}), ("artava", "character", "bright", {"pitta": 0.5}),
    ("artava", "character", "mucoid", {"kapha": 0.5}), ("artava", "character", "normal", {}),
)
MANAS_QUESTIONS = (
    "criticism", "drive", "food", "decisions", "emotions", "learning", "speech", "work",
    "free_time", "conflict",
)
MANAS_OPTIONS = (("s", "sattva"), ("r", "rajas"), ("t", "tamas"))
NUMBER_QUESTIONS = (
    ("dashavidha", "height_cm", 50.0, 230.0), ("dashavidha", "weight_kg", 10.0, 250.0),
)
OJAS_POINTS = (
    ("energy", "steady", 20), ("energy", "dips", 10), ("energy", "exhausted", 0),
    ("recovery", "quick", 20), ("recovery", "average", 12), ("recovery", "slow", 0),
    ("infections", "rare", 20), ("infections", "some", 10), ("infections", "frequent", 0),
    ("sleep", "refreshing", 15), ("sleep", "light", 5), ("sleep", "heavy", 7),
    ("stress", "calm", 15), ("stress", "irritable", 7), ("stress", "overwhelmed", 0),
    ("vyayamashakti", "high", 10), ("vyayamashakti", "moderate", 6), ("vyayamashakti", "low", 0),
)
DIGESTION_NAMES = (
    ("agni", "irregular", "vishama"), ("agni", "sharp", "tikshna"), ("agni", "slow", "manda"),
    ("agni", "balanced", "sama"), ("koshtha", "hard", "krura"), ("koshtha", "regular", "madhya"),
    ("koshtha", "loose", "mridu"), ("aharashakti", "small", "avara"),
    ("aharashakti", "moderate", "madhyama"), ("aharashakti", "large", "pravara"),
)
MODULE_TO_ENCOUNTER_AGNI = (
    ("irregular", "irregular"), ("sharp", "sharp_frequent_hunger"),
    ("slow", "slow_heavy_after_meals"), ("balanced", "balanced"),
)

# --- fixed values: daily routine, tastes, foods, incompatible combinations -------------------------
ROUTINE_POINTS = (
    ("woke_before_6", 15), ("slept_7_8", 15), ("meals_on_time", 15), ("exercise_30", 15),
    ("abhyanga", 10), ("pranayama", 10), ("warm_water", 10), ("no_screens_late", 10),
)
TASTE_EFFECTS = (
    ("sweet", -1, -1, 1), ("sour", -1, 1, 1), ("salty", -1, 1, 1), ("pungent", 1, 1, -1),
    ("bitter", 1, -1, -1), ("astringent", 1, -1, -1),
)
FOODS = (
    ("milk", ("sweet",), ("milk",)), ("curd", ("sour",), ("curd",)),
    ("buttermilk", ("sour", "astringent"), ()), ("ghee", ("sweet",), ("ghee",)),
    ("honey", ("sweet", "astringent"), ("honey",)),
    ("hot_drink", ("bitter", "astringent"), ("hot",)), ("fish", ("sweet",), ("fish",)),
    ("meat", ("sweet",), ("meat",)), ("eggs", ("sweet",), ("meat",)),
    ("sour_fruit", ("sour",), ("sour_fruit",)), ("banana", ("sweet", "astringent"), ("banana",)),
    ("other_fruit", ("sweet",), ()), ("radish", ("pungent",), ("radish",)),
    ("salty_snack", ("salty",), ("salty",)), ("fried", ("salty",), ("heavy",)),
    ("sweets", ("sweet",), ("heavy",)), ("spicy", ("pungent",), ()),
    ("greens", ("bitter", "astringent"), ()), ("dal", ("astringent", "sweet"), ()),
    ("rice", ("sweet",), ()), ("roti", ("sweet",), ()), ("cold_drink", ("sweet",), ("cold",)),
    ("fermented", ("sour",), ()), ("alcohol", ("sour", "pungent"), ()),
    ("leftovers", (), ("stale",)),
)
MEAL_RULES = (
    (("milk", "fish"), None, "Milk with fish is a classical incompatible combination (Samyoga viruddha)."),
    (("milk", "sour_fruit"), None, "Milk with sour fruit curdles in the stomach (Samyoga viruddha)."),
    (("milk", "salty"), None, "Milk with salty food is considered incompatible."),
    (("milk", "radish"), None, "Milk with radish is a classical incompatible combination."),
    (("milk", "banana"), None, "Milk with banana is heavy and produces Ama."),
    (("milk", "meat"), None, "Milk with meat or eggs is considered incompatible."),
    (("honey", "hot"), None, "Honey should not be heated or taken in hot drinks (Samskara viruddha)."),
    (("honey", "ghee"), None, "Honey and ghee in equal quantity are incompatible (Matra viruddha)."),
    (("hot", "cold"), None, "Hot and cold foods together disturb Agni (Virya viruddha)."),
    (("curd",), "dinner", "Curd at night aggravates Kapha and Pitta (Kala viruddha)."),
    (("stale",), None, "Stale or reheated food is tamasic and produces Ama."),
)
FAVOURED_TASTES = (
    ("vata", ("sweet", "sour", "salty")), ("pitta", ("sweet", "bitter", "astringent")),
    ("kapha", ("pungent", "bitter", "astringent")),
)

# --- fixed values: guidance texts -------------------------------------------------------------------
SEASON_GUIDANCE = (
    ("shishira", "Favour warm, freshly cooked, slightly unctuous food."),
    ("shishira", "Oil massage (abhyanga) before a warm bath; protect from cold wind."),
    ("vasanta", "Lighter, warm, easily digested meals; reduce heavy, sweet, cold and fried food."),
    ("vasanta", "Brisk exercise; avoid daytime sleep - Kapha is aggravated in spring."),
    ("grishma", "Cooling, light, liquid-rich food; stay hydrated; avoid excess salt, sour and spicy."),
    ("grishma", "Avoid midday sun and strenuous exercise in the heat."),
    ("varsha", "Digestion is weakest in the monsoon: warm, light, freshly cooked food; boiled water."),
    ("varsha", "Keep dry; avoid daytime sleep and getting chilled - Vata is aggravated."),
    ("sharad", "Pitta is aggravated: cooling, mildly bitter and sweet food; avoid fried, sour, spicy."),
    ("sharad", "Avoid strong sun; moonlight walks are traditional for this season."),
    ("hemanta", "Digestion is strongest: nourishing, warm meals are well tolerated."),
    ("hemanta", "Regular oil massage and exercise; protect from cold."),
)
DOSHA_GUIDANCE = (
    ("vata", "Keep a regular routine for meals and sleep."),
    ("vata", "Warm, moist, grounding food; avoid cold and dry snacks."),
    ("vata", "Gentle, steady exercise; avoid over-exertion and long fasts."),
    ("pitta", "Avoid skipping meals; favour cooling foods and drinks."),
    ("pitta", "Limit chilli, sour, fermented and fried food, and alcohol."),
    ("pitta", "Avoid overheating; make time to cool down mentally."),
    ("kapha", "Light, warm, freshly cooked food; reduce heavy, sweet, oily and cold food."),
    ("kapha", "Daily vigorous exercise; avoid daytime naps."),
    ("kapha", "Eat only when genuinely hungry."),
)
ADVICE_LOW_ROUTINE = "Your daily routine score is low - begin with fixed wake and meal times."
ADVICE_INCOMPATIBLE = "Some meals combined incompatible foods (Viruddha ahara) - see the diet log."
ADVICE_LOW_OJAS = "Low Ojas: prioritise sleep, regular nourishing meals and rest; discuss with a practitioner."
ADVICE_AMA = "Signs of Ama: favour light, warm, freshly cooked food until appetite returns."

# --- fixed values: assessment completeness weights and longitudinal limits -----------------------------
COMPLETENESS_WEIGHTS = (
    ("identity", 10), ("location", 10), ("prakriti", 20), ("agni_mala", 15), ("ojas_bala", 15),
    ("manas_prakriti", 10), ("dashavidha", 10), ("artava", 10), ("checkup", 5), ("dinacharya", 5),
)
HISTORY_LIMIT = 24
BACKFILL_DAYS = 30
LEARNING_DECISIONS = ("confirmed", "revised")
MIN_LEARNING_CASES = 20
K_ANONYMITY = 5

# --- fixed values: graph clustering and risk model -----------------------------------------------------
MIN_CO_OCCURRENCE = 2
MIN_NPMI = 0.25
RESOLUTIONS = (0.3, 0.4, 0.5, 0.6, 0.8, 1.0)
CLUSTER_RANGE = (8, 30)
TARGET_SENSITIVITY = 0.80
MIN_AUC_GAIN = 0.01
