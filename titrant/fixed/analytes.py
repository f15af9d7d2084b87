"""Analyte catalogue: LOINC code, canonical name and health topic (fixed values)."""

ANALYTES = [
    ("6690-2", "Leukocytes", "blood_count"),
    ("789-8", "Erythrocytes", "blood_count"),
    ("718-7", "Hemoglobin", "blood_count"),
    ("4544-3", "Hematocrit", "blood_count"),
    ("777-3", "Platelets", "blood_count"),
    ("787-2", "MCV", "blood_count"),
    ("785-6", "MCH", "blood_count"),
    ("786-4", "MCHC", "blood_count"),
    ("788-0", "RDW", "blood_count"),
    ("32623-1", "MPV", "blood_count"),
    ("2345-7", "Glucose", "blood_sugar"),
    ("3094-0", "BUN", "kidney"),
    ("2160-0", "Creatinine", "kidney"),
    ("2951-2", "Sodium", "electrolytes"),
    ("2823-3", "Potassium", "electrolytes"),
    ("2075-0", "Chloride", "electrolytes"),
    ("2028-9", "CO2", "electrolytes"),
    ("17861-6", "Calcium", "electrolytes"),
    ("1751-7", "Albumin", "liver"),
    ("2885-2", "Total Protein", "liver"),
    ("6768-6", "ALP", "liver"),
    ("1742-6", "ALT", "liver"),
    ("1920-8", "AST", "liver"),
    ("1975-2", "Total Bilirubin", "liver"),
    ("2093-3", "Total Cholesterol", "heart_lipids"),
    ("2085-9", "HDL Cholesterol", "heart_lipids"),
    ("13457-7", "LDL Cholesterol", "heart_lipids"),
    ("2571-8", "Triglycerides", "heart_lipids"),
    ("13458-5", "VLDL Cholesterol", "heart_lipids"),
    ("3016-3", "TSH", "thyroid_hormones"),
    ("3024-7", "Free T4", "thyroid_hormones"),
    ("3051-0", "Free T3", "thyroid_hormones"),
    ("3026-2", "Total T4", "thyroid_hormones"),
    ("2324-2", "GGT", "liver"),
    ("1968-7", "Direct Bilirubin", "liver"),
    ("1971-1", "Indirect Bilirubin", "liver"),
    ("2532-0", "LDH", "liver"),
    ("33914-3", "eGFR", "kidney"),
    ("3084-1", "Uric Acid", "kidney"),
    ("14959-1", "Microalbumin", "kidney"),
    ("2777-1", "Phosphate", "electrolytes"),
    ("19123-9", "Magnesium", "electrolytes"),
    ("4548-4", "HbA1c", "blood_sugar"),
    ("2498-4", "Iron", "vitamins_minerals"),
    ("2276-4", "Ferritin", "vitamins_minerals"),
    ("1989-3", "Vitamin D", "vitamins_minerals"),
    ("1988-5", "CRP", "inflammation"),
    ("4537-7", "ESR", "inflammation"),
    ("751-8", "Neutrophils", "blood_count"),
    ("731-0", "Lymphocytes", "blood_count"),
    ("742-7", "Monocytes", "blood_count"),
    ("711-2", "Eosinophils", "blood_count"),
    ("704-7", "Basophils", "blood_count"),
    ("2986-8", "Testosterone", "thyroid_hormones"),
    ("2991-8", "Free Testosterone", "thyroid_hormones"),
    ("13967-5", "SHBG", "thyroid_hormones"),
    ("2132-9", "Vitamin B12", "vitamins_minerals"),
    ("13965-9", "Homocysteine", "vitamins_minerals"),
    ("22322-2", "HBsAb", "urinalysis_other"),
    ("5195-3", "HBsAg", "urinalysis_other"),
    ("16128-1", "HCV Ab", "urinalysis_other"),
    ("75622-1", "HIV Ab/Ag", "urinalysis_other"),
    ("5291-0", "RPR", "urinalysis_other"),
    ("5292-8", "VDRL", "urinalysis_other"),
    ("14677-9", "ANA", "inflammation"),
    ("13335-5", "H. pylori", "urinalysis_other"),
    ("73963-7", "TB IGRA", "urinalysis_other"),
    ("2335-8", "Stool Occult Blood", "urinalysis_other"),
    ("24108-3", "CA 19-9", "urinalysis_other"),
    ("3091-6", "Urea", "kidney"),
    ("43396-1", "Non-HDL Cholesterol", "heart_lipids"),
    ("2965-2", "Urine Specific Gravity", "urinalysis_other"),
    ("2756-5", "Urine pH", "urinalysis_other"),
    ("20454-5", "Urine Protein", "urinalysis_other"),
    ("25428-4", "Urine Glucose", "urinalysis_other"),
    ("2514-9", "Urine Ketones", "urinalysis_other"),
    ("5794-3", "Urine Blood", "urinalysis_other"),
    ("5799-2", "Leukocyte Esterase", "urinalysis_other"),
    ("5802-4", "Urine Nitrite", "urinalysis_other"),
    ("1990-1", "Urine Bilirubin", "urinalysis_other"),
    ("13658-0", "Urobilinogen", "urinalysis_other"),
    ("883-9", "ABO Blood Group", "urinalysis_other"),
    ("10331-7", "Rh Type", "urinalysis_other"),
    ("34532-2", "Blood Type", "urinalysis_other"),
    ("2106-3", "Urine hCG", "urinalysis_other"),
    ("37874-4", "Plateletcrit", "blood_count"),
    ("32207-3", "PDW", "blood_count"),
    ("53553-4", "Estimated Average Glucose", "blood_sugar"),
    ("53115-2", "Immature Granulocytes", "blood_count"),
    ("58413-6", "NRBC", "blood_count"),
]

# Specimen words that may follow a name in brackets or after a slash (fixed values).
SPECIMENS = ["serum", "plasma", "whole blood", "blood", "urine", "huyết thanh",
             "máu", "nước tiểu", "sang", "urina"]

# Abbreviation -> normalised name, first hit wins (fixed values).
ABBREVIATIONS = [
    ("gamma gt", "ggt"), ("gamma glutamyl transferase", "ggt"),
    ("hba1c", "hba1c"), ("hb a1c", "hba1c"), ("hemoglobin a1c", "hba1c"),
    ("hdl-c", "hdl cholesterol"), ("hdl c", "hdl cholesterol"),
    ("high density lipoprotein cholesterol", "hdl cholesterol"),
    ("ldl-c", "ldl cholesterol"), ("ldl c", "ldl cholesterol"),
    ("alt (gpt)", "alt"), ("ast (got)", "ast"),
    ("hs crp", "crp"), ("hs-crp", "crp"),
    ("high-sensitive c-reactive protein", "crp"), ("high sensitive c-reactive protein", "crp"),
    ("25-oh vitamin d", "vitamin d"), ("25 oh vitamin d", "vitamin d"),
    ("tsh", "tsh"), ("free t4", "free t4"), ("free t3", "free t3"), ("egfr", "egfr"),
    ("eag", "estimated average glucose"),
    ("mchc", "mchc"), ("mch", "mch"), ("mcv", "mcv"), ("rdw", "rdw"), ("mpv", "mpv"), ("pdw", "pdw"),
    ("pct", "plateletcrit"), ("plt", "platelets"), ("rbc", "erythrocytes"), ("wbc", "leukocytes"),
    ("hct", "hematocrit"), ("hb", "hemoglobin"), ("hgb", "hemoglobin"),
    ("neu", "neutrophils"), ("eos", "eosinophils"), ("ba so", "basophils"),
    ("nrbc", "nucleated red blood cells"), ("shbg", "sex hormone binding globulin"),
    ("ca 19-9", "ca 19-9"), ("ca 125", "ca 125"), ("cea", "cea"), ("afp", "afp"), ("psa", "psa"),
    ("hbsab", "hepatitis b surface antibody"), ("hbsag", "hepatitis b surface antigen"),
    ("hcv ab", "hepatitis c antibody"), ("alp", "alkaline phosphatase"),
    ("ig", "immature granulocytes"),
]

# Health topics in display order, and analyte category -> topic (fixed values).
TOPICS = ["blood_sugar", "heart_lipids", "kidney", "liver", "blood_count", "thyroid_hormones",
          "vitamins_minerals", "electrolytes", "inflammation", "urinalysis_other", "other"]
CATEGORY_TOPICS = {
    "cbc": "blood_count", "hematology": "blood_count", "electrolyte": "electrolytes",
    "lipid": "heart_lipids", "endocrine": "thyroid_hormones", "hormone": "thyroid_hormones",
    "tumor-marker": "urinalysis_other", "kidney": "kidney", "liver": "liver",
    "metabolic": "blood_sugar", "infectious": "urinalysis_other",
    "nutrition": "vitamins_minerals", "inflammatory": "inflammation",
}

# Panels and their member codes (fixed values).
PANELS = [
    ("CBC", ["6690-2", "789-8", "718-7", "4544-3", "777-3"]),
    ("BMP", ["2345-7", "3094-0", "2160-0", "2951-2", "2823-3", "2075-0", "2028-9", "17861-6"]),
    ("Lipid Panel", ["2093-3", "2085-9", "13457-7", "2571-8"]),
    ("Thyroid Panel", ["3016-3", "3024-7"]),
]

# Differential leukocyte fractions whose printed flag is never trusted (fixed values).
LEUKOCYTE_FRACTIONS = ["751-8", "731-0", "742-7", "711-2", "704-7"]

# Low clinical priority names; each also caps severity at mild (fixed values).
LOW_PRIORITY = ["basophils", "nucleated red blood cells", "nrbc", "platelets distribution width",
                "pdw", "plateletcrit", "pct", "mean platelet volume", "mpv",
                "immature granulocytes", "rdw"]
SEVERITY_CAPS = [(name, "mild") for name in LOW_PRIORITY]

# Names that mark a glycated haemoglobin test (fixed values).
GLYCATED_NAMES = ["hba1c", "hb a1c", "hemoglobin a1c", "glycated hemoglobin", "glycosylated hemoglobin"]
