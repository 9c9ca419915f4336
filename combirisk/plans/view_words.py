"""Words that give the generated tables an interaction-domain reading."""

COLOURS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
SHAPES = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FIRST_LETTERS = ["A", "B", "C", "N", "J"]
GROUP_LETTERS = ["A", "B", "C", "D"]
GENERICS = [
    "warfarin", "heparin", "rivaroxaban", "apixaban", "dabigatran", "aspirin", "clopidogrel", "ticagrelor",
    "amiodarone", "sotalol", "dofetilide", "flecainide", "digoxin", "lithium", "phenytoin", "theophylline",
    "cyclosporine", "tacrolimus", "methotrexate", "phenelzine", "tranylcypromine", "selegiline", "haloperidol", "thioridazine",
    "ziprasidone", "droperidol", "methadone", "quinidine", "erythromycin", "clarithromycin", "itraconazole", "ketoconazole",
    "simvastatin", "lovastatin", "diltiazem", "verapamil", "fluoxetine", "sertraline", "paroxetine", "meperidine",
    "nitroglycerin", "sildenafil", "spironolactone", "amiloride", "ibuprofen", "naproxen", "omeprazole", "furosemide",
    "cisapride", "pimozide", "trimethoprim", "atorvastatin", "metformin", "metoprolol", "lisinopril", "losartan",
    "levothyroxine", "glipizide", "prednisone", "gabapentin", "albuterol", "cetirizine", "loratadine", "ranitidine",
]
EFFECTS = [
    "bleeding", "nausea", "headache", "seizure", "rash", "dizziness",
    "fatigue", "cardiac arrest", "cough", "insomnia", "dry mouth", "hypotension",
]
TEMPLATES = [
    "The risk or severity of bleeding can be increased when {1} is combined with {2}.",
    "{1} may increase the anticoagulant activities of {2}.",
    "The metabolism of {1} can be decreased when combined with {2}.",
    "The serum concentration of {1} can be increased when it is combined with {2}.",
    "The therapeutic efficacy of {1} can be decreased when used in combination with {2}.",
    "{1} may increase the hypotensive activities of {2}; monitor blood pressure.",
    "The risk or severity of QT prolongation can be increased when {1} is combined with {2}.",
    "The risk or severity of hyperkalemia can be increased when {1} is combined with {2}.",
    "{1} may reduce the antihypertensive activities of {2}; the clinical relevance is minor.",
    "The excretion rate of {1} may be reduced by {2}, with renal impairment as a possible result.",
    "{1} and {2} together are contraindicated: torsades de pointes and cardiac arrest were reported.",
    "The risk or severity of adverse effects can be increased when {1} is combined with {2}.",
    "{1} may increase the sedation and drowsiness caused by {2}.",
    "The risk of serotonin syndrome is higher when {1} is taken with {2}.",
    "Hepatotoxicity and liver damage are more likely when {1} is combined with {2}.",
    "The absorption of {1} is slightly lower with {2}; an effect is unlikely to be clinically significant.",
    "Hypoglycemia can be more severe when {1} is combined with {2}.",
    "Bradycardia and arrhythmia can be worse when {1} is combined with {2}.",
    "   ",
    None,
]
