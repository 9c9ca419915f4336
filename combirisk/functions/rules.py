"""Rule tables of the text and pair classifiers.

Fixed values: words, weights, patterns and their order decide the labels, so
they are stated plainly here and passed as parameters everywhere else.
"""

from __future__ import annotations

# Phenotype -> keywords (any substring).
PHENOTYPES = {
    "bleeding": ["bleeding", "hemorrhage", "haemorrhage"],
    "hypotension": ["hypotensive", "hypotension", "blood pressure"],
    "bradycardia": ["bradycardia", "heart rate decrease"],
    "nephrotoxicity": ["renal", "kidney", "nephrotox"],
    "hepatotoxicity": ["hepat", "liver"],
    "arrhythmia": ["arrhythmia", "qt prolongation", "torsade"],
    "hyperkalemia": ["hyperkalemia", "potassium"],
    "hypoglycemia": ["hypoglycemia", "blood sugar"],
    "serotonin_syndrome": ["serotonin"],
    "cns_depression": ["sedation", "drowsiness", "cns depression"],
}
CRITICAL_PHENOTYPES = ["bleeding", "arrhythmia", "nephrotoxicity", "hepatotoxicity", "serotonin_syndrome"]

# Mechanism -> regular expressions; the kinetic groups are tried before the dynamic ones.
PK_MECHANISMS = {
    "metabolism_increase": ["increase.*metabolism", "induc.*cyp", "induc.*enzyme"],
    "metabolism_decrease": ["decrease.*metabolism", "inhibit.*cyp", "inhibit.*enzyme"],
    "concentration_increase": [
        "increase.*concentration", "increase.*serum", "increase.*plasma", "increase.*auc", "increase.*level",
    ],
    "concentration_decrease": [
        "decrease.*concentration", "decrease.*serum", "decrease.*plasma", "decrease.*auc", "decrease.*level",
        "reduce.*absorption",
    ],
    "excretion_change": ["excretion.*rate", "renal.*clearance"],
}
PD_MECHANISMS = {
    "additive_effect": ["increase.*activit", "increase.*effect", "additive", "synergist"],
    "antagonistic_effect": ["decrease.*activit", "decrease.*effect", "antagoni", "reduce.*efficacy"],
    "bleeding_risk": ["bleeding", "hemorrhag", "anticoagulant.*activit", "antithrombotic.*activit"],
    "cardiac_effect": ["qt.*prolong", "bradycardia", "hypotension", "arrhythm"],
    "toxicity": ["toxic", "adverse", "risk.*severity"],
}

# Clinical effect -> keywords, first group wins.
CLINICAL_EFFECTS = {
    "bleeding": ["bleeding", "hemorrhag", "anticoagulant"],
    "hypotension": ["hypotension", "blood pressure"],
    "bradycardia": ["bradycardia", "heart rate"],
    "qt_prolongation": ["qt prolong", "torsade", "arrhythm"],
    "hyperkalemia": ["hyperkalemia", "potassium"],
    "hypoglycemia": ["hypoglycemia", "blood sugar"],
    "nephrotoxicity": ["nephrotox", "kidney", "renal"],
    "hepatotoxicity": ["hepatotox", "liver"],
    "myopathy": ["myopathy", "rhabdomyolysis", "muscle"],
    "cns_depression": ["sedation", "drowsiness", "cns depress"],
}

# Interaction type -> keywords, first group wins, else "Other".
INTERACTION_TYPES = {
    "Anticoagulant Effect": ["anticoagulant"],
    "Bleeding Risk": ["bleeding", "hemorrhage"],
    "Efficacy Change": ["therapeutic efficacy"],
    "Metabolism Effect": ["metabolism"],
    "Adverse Effects": ["adverse effect"],
    "Concentration Change": ["serum concentration"],
    "Blood Pressure Effect": ["hypotensive", "blood pressure"],
    "Cardiac Effect": ["cardiotoxic", "arrhythmia", "qt"],
    "Nephrotoxic Effect": ["nephrotoxic", "kidney"],
    "Hepatotoxic Effect": ["hepatotoxic", "liver"],
}
# Numeric variant: position in this list, else its length.
INTERACTION_TYPE_CODES = [
    ["anticoagulant"],
    ["bleeding", "hemorrhage"],
    ["therapeutic efficacy"],
    ["metabolism"],
    ["serum concentration"],
    ["cardiotoxic", "arrhythmia"],
]

# Keyword weights (presence, not count).
KEYWORD_WEIGHTS = {
    "prolongation": 1.45, "bleeding": 1.03, "hemorrhage": 0.63, "anticoagulant": 0.57,
    "antithrombotic": 0.57, "hyperkalemia": 0.50, "hypoglycemia": 0.45, "risk": 0.33,
    "severity": 0.33, "toxicity": 0.30, "increased": 0.20, "decrease": -0.30, "serum": -0.31,
    "concentration": -0.25, "metabolism": -0.35, "therapeutic": -1.20, "efficacy": -1.27,
    "antihypertensive": -1.49, "reduce": -1.61,
}
# Terms whose weights are learned from labelled rows.
CLINICAL_TERMS = [
    "prolongation", "bleeding", "anticoagulant", "hemorrhage", "risk", "severity", "increased",
    "hyperkalemia", "decrease", "serum", "therapeutic", "efficacy", "antihypertensive", "reduce",
    "hypotension", "combined", "toxicity", "activities",
]

# Fallback keywords per level, in order.
FALLBACK_KEYWORDS = {
    "contraindicated": [
        "contraindicated", "never use", "do not use", "fatal", "death", "torsades de pointes",
        "serotonin syndrome", "cardiac arrest",
    ],
    "major": [
        "serious", "severe", "dangerous", "significant", "life-threatening", "hospitaliz", "bleeding",
        "hemorrhag", "anticoagulant activities", "hyperkalemia", "rhabdomyolysis", "renal failure",
        "hypoglycemic activities",
    ],
    "moderate": [
        "caution", "monitor", "adjust", "moderate", "avoid", "may increase", "may decrease",
        "serum concentration",
    ],
    "minor": ["mild", "minor", "minimal", "unlikely", "slight"],
}
FALLBACK_CONFIDENCE = {"contraindicated": 0.85, "major": 0.80, "moderate": 0.75, "minor": 0.70}

# Text markers: (score, evidence, markers), tried in this order.
CONTRA_EFFECTS = [
    "torsades de pointes", "serotonin syndrome", "neuroleptic malignant", "cardiac arrest", "fatal",
    "death", "qt prolongation", "qtc prolongation", "ventricular fibrillation",
    "ventricular tachycardia", "contraindicated", "do not use", "intracranial hemorrhage",
    "intracranial bleeding",
]
MAJOR_EFFECTS = [
    "bleeding and hemorrhage", "gastrointestinal bleeding", "hemorrhage", "bleeding", "bleeding risk",
    "bleeding can be increased", "hemorrhagic", "anticoagulant activities", "antithrombotic activities",
    "hyperkalemia", "hyperkalemic", "hypoglycemic activities", "hypoglycemia", "bradycardia",
    "hypertensive crisis", "severe hypotension", "myopathy, rhabdomyolysis", "rhabdomyolysis",
    "angioedema", "renal failure", "liver damage", "agranulocytosis", "nephrotoxicity",
    "hepatotoxicity", "bone marrow suppression", "thrombocytopeni", "neutropeni", "seizure",
    "cardiotoxic", "ototoxic", "neurotoxic", "toxicity", "respiratory depression", "cns depression",
]
CONTRA_STRONG = [
    "absolutely contraindicated", "never use together", "fatal combination", "lethal", "death reported",
    "potentially fatal", "avoid combination", "do not administer", "life-threatening arrhythmia",
]
MAJOR_STRONG = [
    "serious bleeding", "significant hemorrhage", "severe hypotension", "hospitalization may be required",
    "significantly increased risk", "substantially increased", "marked increase", "severe toxicity",
    "potentially life-threatening", "requires immediate attention",
]
MODERATE_EFFECTS = [
    "hypertension", "hypotension", "methemoglobinemia", "dehydration", "hypokalemia", "hyponatremia",
    "edema", "metabolism", "serum concentration", "plasma concentration", "therapeutic efficacy",
    "therapeutic effect", "excretion rate", "absorption", "bioavailability", "protein binding",
    "renal clearance", "adverse effects can be increased", "myopathy", "gastrointestinal irritation",
    "extrapyramidal", "antihypertensive activities", "vasodilatory activities", "cyp3a4", "cyp2d6",
    "cyp2c9", "p-glycoprotein",
]
MINOR_EFFECTS = [
    "sedation", "sedative activities", "tendinopathy", "gastric", "nausea", "headache", "dizziness",
    "drowsiness", "constipation", "fluid retention", "cns depressant", "dry mouth", "insomnia",
    "theoretical", "unlikely", "minimal",
]
MARKER_DEFAULT = (1.6, "default")
MARKER_NULL = (2.0, "none")

# Known pairs (substring of either name, either orientation).
KNOWN_CONTRAINDICATED = [
    ("phenelzine", "fluoxetine"), ("tranylcypromine", "sertraline"), ("isocarboxazid", "paroxetine"),
    ("selegiline", "meperidine"), ("nitroglycerin", "sildenafil"), ("nitroglycerin", "tadalafil"),
    ("isosorbide", "sildenafil"), ("isosorbide", "vardenafil"), ("spironolactone", "potassium chloride"),
    ("amiloride", "potassium"), ("triamterene", "potassium supplements"), ("itraconazole", "simvastatin"),
    ("ketoconazole", "lovastatin"), ("clarithromycin", "simvastatin"), ("amiodarone", "sotalol"),
    ("dofetilide", "amiodarone"), ("haloperidol", "thioridazine"),
]
KNOWN_MAJOR = [
    ("warfarin", "aspirin"), ("warfarin", "ibuprofen"), ("warfarin", "naproxen"), ("rivaroxaban", "aspirin"),
    ("apixaban", "aspirin"), ("warfarin", "heparin"), ("warfarin", "enoxaparin"), ("digoxin", "amiodarone"),
    ("digoxin", "verapamil"), ("digoxin", "quinidine"), ("lithium", "ibuprofen"), ("lithium", "furosemide"),
    ("clopidogrel", "omeprazole"), ("clopidogrel", "esomeprazole"),
]

# Risk classes by name substring.
RISK_CLASSES = {
    "anticoagulants": [
        "warfarin", "heparin", "enoxaparin", "rivaroxaban", "apixaban", "dabigatran", "edoxaban", "fondaparinux",
    ],
    "antiplatelets": ["aspirin", "clopidogrel", "ticagrelor", "prasugrel", "dipyridamole"],
    "antiarrhythmics": ["amiodarone", "sotalol", "dofetilide", "flecainide", "propafenone"],
    "narrow_therapeutic": [
        "warfarin", "digoxin", "lithium", "phenytoin", "theophylline", "cyclosporine", "tacrolimus", "methotrexate",
    ],
    "maois": ["phenelzine", "tranylcypromine", "isocarboxazid", "selegiline"],
    "qt_prolonging": [
        "amiodarone", "sotalol", "dofetilide", "haloperidol", "thioridazine", "ziprasidone", "droperidol", "methadone",
    ],
}
RISK_CLASS_SCORES = {"very_high": 4.0, "high": 3.5, "elevated": 3.0, "moderate": 2.5, "standard": 2.0}
SCORED_CLASSES = {
    "anticoagulants": [
        "warfarin", "heparin", "enoxaparin", "dalteparin", "tinzaparin", "nadroparin", "rivaroxaban",
        "apixaban", "dabigatran", "edoxaban", "betrixaban", "fondaparinux", "argatroban", "bivalirudin",
    ],
    "antiplatelets": [
        "aspirin", "clopidogrel", "ticagrelor", "prasugrel", "dipyridamole", "ticlopidine", "cangrelor",
        "abciximab", "eptifibatide", "tirofiban", "cilostazol",
    ],
    "qt_prolonging": [
        "amiodarone", "sotalol", "dofetilide", "dronedarone", "quinidine", "procainamide", "flecainide",
        "ibutilide", "haloperidol", "ziprasidone", "quetiapine", "thioridazine", "droperidol",
        "azithromycin", "erythromycin", "clarithromycin", "moxifloxacin", "levofloxacin",
        "amitriptyline", "imipramine", "citalopram", "escitalopram", "methadone", "ondansetron", "sumatriptan",
    ],
    "maois": ["phenelzine", "tranylcypromine", "isocarboxazid", "selegiline", "rasagiline", "safinamide"],
    "strong_cyp3a4_inhibitors": [
        "ketoconazole", "itraconazole", "clarithromycin", "ritonavir", "nelfinavir", "indinavir",
        "nefazodone", "cobicistat",
    ],
    "serotonergics": [
        "fluoxetine", "sertraline", "paroxetine", "citalopram", "escitalopram", "venlafaxine",
        "duloxetine", "tramadol", "meperidine", "dextromethorphan", "fentanyl", "methadone",
        "sumatriptan", "rizatriptan", "zolmitriptan",
    ],
}

# Semantic bands: thresholds per class, markers that override, fallback keywords.
SEMANTIC_THRESHOLDS = {"contraindicated": 0.65, "major": 0.55, "moderate": 0.45}
SEMANTIC_OVERRIDE = [
    "bleeding", "hemorrhag", "anticoagulant activities", "hyperkalemia", "rhabdomyolysis", "renal failure",
]
SEMANTIC_FALLBACK = [
    (4.0, "contraindicated", ["fatal", "death", "torsades", "serotonin syndrome", "cardiac arrest", "contraindicated", "lethal"]),
    (3.2, "major", ["bleeding", "hemorrhage", "hyperkalemia", "rhabdomyolysis", "renal failure", "serious", "hospitalization"]),
    (2.0, "moderate", ["monitor", "caution", "may increase", "may decrease", "concentration", "metabolism"]),
]

# Keyword baseline: (label, confidence, keywords) in order, else the default.
BASELINE_RULES = [
    ("Contraindicated", 0.8, ["qt prolongation", "torsades", "serotonin syndrome", "contraindicated", "avoid", "do not use", "fatal"]),
    ("Major", 0.7, ["bleeding", "hemorrhage", "hyperkalemia", "hypoglycemia", "bradycardia", "hypotension", "rhabdomyolysis", "seizure", "respiratory depression", "renal failure", "hepatotoxicity"]),
    ("Moderate", 0.6, ["serum concentration", "metabolism", "therapeutic efficacy", "excretion", "absorption", "bioavailability", "clearance"]),
    ("Minor", 0.5, ["sedation", "drowsiness", "nausea", "dizziness", "headache", "constipation", "dry mouth"]),
]
BASELINE_DEFAULT = ("Moderate", 0.4)
RANDOM_PRIOR = {"Minor": 0.05, "Moderate": 0.15, "Major": 0.65, "Contraindicated": 0.15}

# High-risk side-effect terms of the regimen score and of the item score.
HIGH_RISK_EFFECTS = [
    "bleeding", "hemorrhage", "cardiac", "arrhythmia", "qt prolongation", "hepatotoxicity",
    "nephrotoxicity", "seizure", "respiratory depression", "hypotension", "hypertension",
    "hypoglycemia", "hyperkalemia", "serotonin syndrome", "neuroleptic malignant", "rhabdomyolysis",
    "thrombocytopenia", "agranulocytosis", "anaphylaxis",
]
ITEM_RISK_EFFECTS = [
    "bleeding", "cardiac", "death", "arrhythmia", "arrest", "failure", "hepato", "nephro", "seizure",
]

# Severity and risk words looked for in generated text.
MENTION_SEVERITY = {
    "contraindicated": ["contraindicated", "avoid", "do not use", "prohibited"],
    "major": ["major", "serious", "significant", "severe", "dangerous"],
    "moderate": ["moderate", "caution", "monitor", "watch"],
    "minor": ["minor", "mild", "slight", "minimal"],
}
MENTION_RISK = {
    "critical": ["critical", "emergency", "urgent", "immediate"],
    "high": ["high", "significant", "serious", "substantial"],
    "moderate": ["moderate", "medium", "some"],
    "low": ["low", "minimal", "slight", "minor"],
}
INTERACTION_WORDS = ["interaction", "interact", "combine", "combination"]
SEVERITY_WORDS = ["major", "minor", "moderate", "contraindicated", "severe", "serious"]

# Salt suffixes dropped by the name normaliser, in this order.
SALT_SUFFIXES = [
    "hydrochloride", "hcl", "sodium", "potassium", "calcium", "acetate", "sulfate", "sulphate",
    "mesylate", "maleate", "tartrate", "fumarate", "succinate", "besylate", "citrate", "phosphate",
    "nitrate", "bromide", "chloride", "iodide", "lactate", "gluconate", "carbonate", "oxide", "hydroxide",
]
# Everyday and brand names -> generic names.
ALIASES = {
    "aspirin": "acetylsalicylic acid", "tylenol": "acetaminophen", "advil": "ibuprofen",
    "motrin": "ibuprofen", "aleve": "naproxen", "coumadin": "warfarin", "plavix": "clopidogrel",
    "lipitor": "atorvastatin", "zocor": "simvastatin", "crestor": "rosuvastatin",
    "xarelto": "rivaroxaban", "eliquis": "apixaban", "pradaxa": "dabigatran", "lasix": "furosemide",
    "hctz": "hydrochlorothiazide", "prilosec": "omeprazole", "nexium": "esomeprazole",
    "synthroid": "levothyroxine", "lopressor": "metoprolol", "toprol": "metoprolol",
    "norvasc": "amlodipine", "prinivil": "lisinopril", "zestril": "lisinopril",
    "vasotec": "enalapril", "cozaar": "losartan", "diovan": "valsartan", "prozac": "fluoxetine",
    "zoloft": "sertraline", "lexapro": "escitalopram", "cymbalta": "duloxetine",
    "xanax": "alprazolam", "valium": "diazepam", "ativan": "lorazepam", "ambien": "zolpidem",
    "glucophage": "metformin",
}

# Code labels.
CODE_LEVEL1 = {
    "A": "Alimentary tract and metabolism", "B": "Blood and blood forming organs",
    "C": "Cardiovascular system", "D": "Dermatologicals", "G": "Genito-urinary system",
    "H": "Systemic hormones", "J": "Antiinfectives for systemic use",
    "L": "Antineoplastic and immunomodulating", "M": "Musculo-skeletal system", "N": "Nervous system",
    "P": "Antiparasitic products", "R": "Respiratory system", "S": "Sensory organs", "V": "Various",
}
CODE_LEVEL2 = {
    "C01": "Cardiac therapy", "C02": "Antihypertensives", "C03": "Diuretics",
    "C04": "Peripheral vasodilators", "C05": "Vasoprotectives", "C07": "Beta blocking agents",
    "C08": "Calcium channel blockers", "C09": "Agents acting on RAAS", "C10": "Lipid modifying agents",
    "B01": "Antithrombotic agents", "B02": "Antihemorrhagics", "B03": "Antianemic preparations",
    "B05": "Blood substitutes", "B06": "Other hematological agents",
}
CODE_LEVEL4 = {
    "B01AA": "Vitamin K antagonists", "B01AB": "Heparin group", "B01AC": "Platelet aggregation inhibitors",
    "B01AD": "Enzymes", "B01AE": "Direct thrombin inhibitors", "B01AF": "Direct factor Xa inhibitors",
    "B01AX": "Other antithrombotic agents",
}

# Evidence rules: pair rules, interval-prolonging names, whole-word patterns per level.
QT_NAMES = [
    "amiodarone", "sotalol", "quinidine", "procainamide", "disopyramide", "droperidol", "haloperidol",
    "methadone", "erythromycin", "clarithromycin", "moxifloxacin", "levofloxacin", "ondansetron",
    "domperidone", "thioridazine", "pimozide", "arsenic", "cisapride", "terfenadine", "astemizole",
    "dofetilide", "ibutilide", "ziprasidone", "sevoflurane", "chloroquine", "hydroxychloroquine",
]
EVIDENCE_PAIRS = [
    ("amiodarone", "sotalol", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "quinidine", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "erythromycin", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "clarithromycin", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "haloperidol", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "methadone", "Contraindicated", "FDA - Combined QT prolongation"),
    ("amiodarone", "droperidol", "Contraindicated", "FDA Black Box"),
    ("haloperidol", "droperidol", "Contraindicated", "FDA Black Box"),
    ("haloperidol", "methadone", "Major", "FDA - QT prolongation"),
    ("sotalol", "quinidine", "Contraindicated", "FDA - Combined QT prolongation"),
    ("selegiline", "fluoxetine", "Contraindicated", "FDA Black Box - Serotonin syndrome"),
    ("selegiline", "sertraline", "Contraindicated", "FDA Black Box - Serotonin syndrome"),
    ("linezolid", "fluoxetine", "Contraindicated", "FDA - Serotonin syndrome"),
    ("linezolid", "sertraline", "Contraindicated", "FDA - Serotonin syndrome"),
    ("simvastatin", "itraconazole", "Contraindicated", "FDA - Rhabdomyolysis risk"),
    ("simvastatin", "ketoconazole", "Contraindicated", "FDA - Rhabdomyolysis risk"),
    ("lovastatin", "itraconazole", "Contraindicated", "FDA - Rhabdomyolysis risk"),
    ("lovastatin", "ketoconazole", "Contraindicated", "FDA - Rhabdomyolysis risk"),
    ("simvastatin", "amiodarone", "Major", "FDA - Myopathy/rhabdomyolysis"),
    ("simvastatin", "diltiazem", "Major", "FDA - Myopathy risk"),
    ("simvastatin", "verapamil", "Major", "FDA - Myopathy risk"),
    ("digoxin", "amiodarone", "Major", "FDA - Digoxin toxicity"),
    ("digoxin", "quinidine", "Major", "FDA - Digoxin toxicity"),
    ("digoxin", "verapamil", "Major", "FDA - Digoxin toxicity"),
    ("digoxin", "clarithromycin", "Major", "FDA - Digoxin toxicity"),
]
EVIDENCE_QT = ("Contraindicated", 0.88, "FDA - Combined QT prolongation risk")
EVIDENCE_BASE = {"Contraindicated": 0.90, "Major": 0.77, "Moderate": 0.65, "Minor": 0.55}
EVIDENCE_PATTERNS = {
    "Contraindicated": {
        "qt prolongation": "FDA Black Box Warning for QT drugs",
        "qtc prolongation": "FDA Black Box Warning",
        "torsades de pointes": "ACC/AHA Guidelines - Life-threatening arrhythmia",
        "torsade": "ACC/AHA Guidelines",
        "serotonin syndrome": "FDA MAOI Drug Label Warning",
        "serotonin toxicity": "Boyer & Shannon, NEJM 2005",
        "cardiac arrest": "Life-threatening - Emergency medicine literature",
        "ventricular fibrillation": "ACC/AHA Arrhythmia Guidelines",
        "ventricular tachycardia": "ACC/AHA Guidelines",
        "fatal bleeding": "FDA Anticoagulant Warnings",
        "intracranial hemorrhage": "CHEST Guidelines",
        "intracranial bleeding": "CHEST Guidelines",
        "malignant hyperthermia": "FDA Anesthesia Warnings",
        "neuroleptic malignant syndrome": "FDA Antipsychotic Labels",
        "contraindicated": "FDA Label Explicit Contraindication",
        "do not use": "FDA Label",
        "must not be": "FDA Label",
        "never": "FDA Label",
    },
    "Major": {
        "risk or severity of bleeding": "CHEST Antithrombotic Guidelines",
        "bleeding and hemorrhage": "ISTH Bleeding Assessment",
        "hemorrhage can be increased": "FDA Anticoagulant Labels",
        "gastrointestinal bleeding": "FDA NSAID Warnings",
        "bleeding risk": "Clinical Pharmacology Standard",
        "bleeding can be increased": "FDA Label",
        "arrhythmogenic": "ACC/AHA - Arrhythmia risk",
        "bradycardia": "ACC/AHA Heart Rhythm Guidelines",
        "hypotension": "Clinical significance - Circulation",
        "hypertensive crisis": "JNC Hypertension Guidelines",
        "hypertension can be increased": "JNC Guidelines",
        "hyperkalemia": "Endocrine Society Guidelines",
        "hyperkalemic": "Endocrine Society Guidelines",
        "hypokalemia": "Electrolyte Guidelines",
        "hypoglycemia": "ADA Diabetes Guidelines",
        "severe hypoglycemia": "FDA Diabetes Drug Labels",
        "respiratory depression": "FDA Opioid REMS",
        "cns depression": "FDA Sedative Warnings",
        "seizure": "Epilepsia Guidelines",
        "convulsion": "Clinical Neurology",
        "nephrotoxicity": "KDIGO Guidelines",
        "hepatotoxicity": "FDA DILI Guidance",
        "renal failure": "KDIGO AKI Guidelines",
        "liver failure": "AASLD Guidelines",
        "rhabdomyolysis": "Statin label warnings",
        "myopathy": "ACC/AHA Statin Guidelines",
        "bone marrow suppression": "ASCO Guidelines",
        "agranulocytosis": "FDA Clozapine REMS",
        "thrombocytopenia": "ASH Guidelines",
        "anticoagulant activities": "CHEST Guidelines",
        "antithrombotic activities": "CHEST Guidelines",
        "toxicity": "Clinical toxicology",
    },
    "Moderate": {
        "serum concentration": "Clinical PK literature",
        "plasma concentration": "Clinical PK literature",
        "auc": "FDA PK Guidance",
        "metabolism of": "FDA DDI Guidance 2020",
        "cyp3a4": "FDA Drug Interaction Tables",
        "cyp2d6": "FDA Drug Interaction Tables",
        "cyp2c9": "FDA Drug Interaction Tables",
        "p-glycoprotein": "FDA Transporter Guidance",
        "therapeutic efficacy": "Clinical significance standard",
        "therapeutic effect": "Clinical pharmacology",
        "reduce the effect": "FDA label language",
        "diminish the effect": "FDA label language",
        "excretion rate": "Clinical PK",
        "excretion of": "Clinical PK",
        "absorption of": "Biopharmaceutics",
        "bioavailability": "FDA BA/BE Guidance",
        "antihypertensive activities": "JNC Guidelines",
        "hypotensive effect": "Clinical pharmacology",
        "pr interval": "ECG interpretation",
        "qrs": "ECG interpretation",
        "gastrointestinal": "Clinical significance",
        "ulceration": "FDA NSAID guidance",
    },
    "Minor": {
        "sedation": "Minor clinical effect",
        "drowsiness": "Package insert standard",
        "dizziness": "Common adverse event",
        "headache": "Common adverse event",
        "nausea": "Common adverse event",
        "constipation": "Common adverse event",
        "dry mouth": "Anticholinergic effect",
        "insomnia": "Common adverse event",
        "theoretical": "Limited clinical evidence",
        "unlikely": "Low probability",
        "minimal": "Minimal clinical significance",
    },
}

# Four-stage seriousness rules.
# Pairs: (name 1, name 2, consequence, frequency, mechanism, action, quality, reference).
STAGED_CONTRAINDICATED = [
    ("selegiline", "meperidine", "Fatal serotonin syndrome", "Rare", "Pharmacodynamic", "Absolute contraindication - never co-administer", "High", "FDA Black Box Warning"),
    ("tranylcypromine", "meperidine", "Fatal serotonin syndrome", "Rare", "Pharmacodynamic", "Absolute contraindication - never co-administer", "High", "FDA Black Box Warning"),
    ("phenelzine", "meperidine", "Fatal serotonin syndrome", "Rare", "Pharmacodynamic", "Absolute contraindication - never co-administer", "High", "FDA Black Box Warning"),
    ("methotrexate", "trimethoprim", "Severe pancytopenia, potentially fatal", "Rare", "Pharmacodynamic", "Avoid combination; use alternative antibiotic", "Moderate", "Multiple case reports, pharmacological basis"),
    ("cisapride", "erythromycin", "Torsades de pointes, sudden death", "Rare", "Pharmacodynamic", "Absolute contraindication", "High", "FDA - Drug withdrawn for this reason"),
    ("cisapride", "ketoconazole", "Torsades de pointes, sudden death", "Rare", "Pharmacodynamic", "Absolute contraindication", "High", "FDA - Drug withdrawn for this reason"),
    ("thioridazine", "fluoxetine", "QT prolongation, torsades de pointes", "Rare", "Pharmacodynamic", "Absolute contraindication - use alternative", "High", "FDA Label Contraindication"),
    ("thioridazine", "paroxetine", "QT prolongation, torsades de pointes", "Rare", "Pharmacodynamic", "Absolute contraindication - use alternative", "High", "FDA Label Contraindication"),
    ("pimozide", "clarithromycin", "QT prolongation, sudden cardiac death", "Rare", "Pharmacodynamic", "Absolute contraindication", "High", "FDA Label Contraindication"),
    ("pimozide", "erythromycin", "QT prolongation, sudden cardiac death", "Rare", "Pharmacodynamic", "Absolute contraindication", "High", "FDA Label Contraindication"),
]
STAGED_HIGH = [
    ("amiodarone", "sotalol", "Additive QT prolongation, torsades risk", "Uncommon", "Pharmacodynamic", "Avoid if possible; if necessary, monitor ECG closely", "High", "ACC/AHA Guidelines, FDA warnings"),
    ("amiodarone", "haloperidol", "Additive QT prolongation", "Uncommon", "Pharmacodynamic", "Monitor ECG; consider alternative antipsychotic", "Moderate", "FDA warnings, pharmacological basis"),
    ("warfarin", "aspirin", "Serious bleeding, GI hemorrhage", "Common", "Pharmacodynamic", "Use lowest aspirin dose; add PPI; monitor INR/bleeding", "High", "CHEST Guidelines, TWOSIDES PRR=8.5"),
    ("warfarin", "nsaid", "GI bleeding, hemorrhage", "Common", "Mixed", "Avoid if possible; use alternative analgesic", "High", "FDA NSAID Black Box, CHEST Guidelines"),
    ("dabigatran", "aspirin", "Major bleeding", "Common", "Pharmacodynamic", "Assess bleeding risk; minimize aspirin use", "High", "RE-LY trial data"),
    ("rivaroxaban", "aspirin", "Major bleeding", "Common", "Pharmacodynamic", "Use low-dose aspirin only if indicated", "High", "COMPASS trial"),
    ("simvastatin", "amiodarone", "Myopathy, rhabdomyolysis", "Uncommon", "Pharmacokinetic", "Limit simvastatin to 20mg/day", "High", "FDA Label - dose limit 20mg"),
    ("simvastatin", "diltiazem", "Myopathy risk", "Uncommon", "Pharmacokinetic", "Limit simvastatin to 10mg/day", "Moderate", "FDA Label"),
    ("lovastatin", "itraconazole", "Rhabdomyolysis", "Rare", "Pharmacokinetic", "Avoid combination; use alternative statin", "High", "FDA Label Contraindication"),
    ("digoxin", "amiodarone", "Digoxin toxicity (bradycardia, arrhythmia)", "Common", "Pharmacokinetic", "Reduce digoxin dose by 50%; monitor levels", "High", "FDA Label, PK studies"),
    ("digoxin", "verapamil", "Digoxin toxicity, bradycardia", "Common", "Mixed", "Reduce digoxin dose; monitor levels and HR", "High", "FDA Label"),
    ("spironolactone", "potassium", "Severe hyperkalemia, cardiac arrhythmia", "Common", "Pharmacodynamic", "Avoid combination; monitor potassium closely", "High", "Endocrine Society Guidelines"),
    ("ace_inhibitor", "potassium", "Hyperkalemia", "Uncommon", "Pharmacodynamic", "Monitor potassium; avoid supplements unless deficient", "High", "Clinical practice guidelines"),
]
STAGED_QT_NAMES = [name for name in QT_NAMES if name != "sevoflurane"]
STAGED_QT = ("High", "Additive QT prolongation", "Uncommon", "Pharmacodynamic", "ECG monitoring; consider alternative agents", "High", "FDA/CredibleMeds QT drug list", 0.85, "Major")
# Whole-word patterns: (pattern, seriousness, consequence, frequency, mechanism, action, quality, reference, legacy).
STAGED_PATTERNS = [
    ("torsades de pointes", "High", "Life-threatening ventricular arrhythmia", "Rare", "Pharmacodynamic", "Avoid combination; if essential, continuous cardiac monitoring", "High", "ACC/AHA Arrhythmia Guidelines", "Contraindicated"),
    ("qt prolongation", "High", "Risk of torsades de pointes, sudden death", "Uncommon", "Pharmacodynamic", "ECG monitoring; consider alternative", "High", "FDA QT Guidance, CredibleMeds", "Major"),
    ("ventricular fibrillation", "High", "Cardiac arrest, sudden death", "Rare", "Pharmacodynamic", "Avoid combination", "High", "ACC/AHA Guidelines", "Contraindicated"),
    ("serotonin syndrome", "High", "Potentially fatal hyperthermia, rigidity, autonomic instability", "Uncommon", "Pharmacodynamic", "Avoid combination; 14-day washout for MAOIs", "High", "Boyer & Shannon NEJM 2005, FDA MAOI warnings", "Contraindicated"),
    ("intracranial hemorrhage", "High", "Life-threatening intracranial bleeding", "Rare", "Pharmacodynamic", "Avoid combination; assess bleeding risk", "High", "CHEST Guidelines", "Contraindicated"),
    ("rhabdomyolysis", "High", "Muscle breakdown, acute kidney injury", "Rare", "Pharmacokinetic", "Avoid combination or limit statin dose", "High", "FDA Statin Labels", "Major"),
    ("risk or severity of bleeding", "High", "Increased bleeding risk, hemorrhage", "Common", "Pharmacodynamic", "Monitor for bleeding; consider dose reduction", "High", "CHEST Antithrombotic Guidelines", "Major"),
    ("hemorrhage can be increased", "High", "Serious bleeding events", "Common", "Pharmacodynamic", "Close monitoring; bleeding precautions", "High", "FDA Anticoagulant Labels", "Major"),
    ("gastrointestinal bleeding", "High", "GI hemorrhage", "Uncommon", "Pharmacodynamic", "Add PPI; monitor for GI symptoms", "High", "FDA NSAID Black Box Warning", "Major"),
    ("bradycardia", "High", "Symptomatic slow heart rate", "Uncommon", "Pharmacodynamic", "Monitor heart rate; adjust doses as needed", "Moderate", "ACC/AHA Heart Rhythm Guidelines", "Major"),
    ("hypotension", "High", "Symptomatic low blood pressure", "Common", "Pharmacodynamic", "Monitor BP; adjust doses; counsel on symptoms", "Moderate", "Clinical pharmacology literature", "Major"),
    ("hyperkalemia", "High", "Cardiac arrhythmias from elevated potassium", "Uncommon", "Pharmacodynamic", "Monitor potassium; avoid K supplements", "High", "Endocrine Society Guidelines", "Major"),
    ("toxicity", "High", "Drug toxicity", "Uncommon", "Pharmacokinetic", "Monitor drug levels; reduce dose if needed", "Moderate", "Clinical toxicology", "Major"),
    ("nephrotoxicity", "High", "Kidney damage", "Uncommon", "Mixed", "Monitor renal function; stay hydrated", "Moderate", "KDIGO Guidelines", "Major"),
    ("serum concentration", "Moderate", "Altered drug levels", "Common", "Pharmacokinetic", "Consider dose adjustment; monitor response", "Moderate", "Clinical PK literature", "Moderate"),
    ("metabolism of", "Moderate", "Altered drug metabolism", "Common", "Pharmacokinetic", "Adjust dose based on interaction magnitude", "Moderate", "FDA DDI Guidance", "Moderate"),
    ("therapeutic efficacy", "Moderate", "Reduced drug effectiveness", "Common", "Pharmacokinetic", "Monitor therapeutic response", "Moderate", "Clinical pharmacology", "Moderate"),
    ("antihypertensive activities", "Moderate", "Additive blood pressure lowering", "Common", "Pharmacodynamic", "Monitor BP; adjust doses as needed", "Moderate", "JNC Guidelines", "Moderate"),
    ("excretion rate", "Moderate", "Altered drug elimination", "Common", "Pharmacokinetic", "Consider renal function in dosing", "Moderate", "Clinical PK", "Moderate"),
    ("sedation", "Low", "Drowsiness", "Common", "Pharmacodynamic", "Counsel patient about sedation", "Low", "Package insert standard", "Minor"),
    ("drowsiness", "Low", "Increased sleepiness", "Common", "Pharmacodynamic", "Advise caution with driving/machinery", "Low", "Package insert", "Minor"),
    ("dizziness", "Low", "Lightheadedness", "Common", "Pharmacodynamic", "Rise slowly; avoid alcohol", "Low", "Common adverse event", "Minor"),
]
# (seriousness, consequence, frequency, mechanism, action, quality, reference, confidence, legacy)
STAGED_EMPTY = ("Moderate", "Unknown interaction", "Unknown", "Unknown", "Monitor for unexpected effects", "Very Low", "No description available", 0.3, "Moderate")
STAGED_DEFAULT = ("Moderate", "Potential interaction - clinical significance unclear", "Unknown", "Unknown", "Monitor for unexpected effects; adjust therapy if needed", "Low", "Pattern not matched - default classification", 0.5, "Moderate")
