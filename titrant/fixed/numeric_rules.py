"""Numeric interpretation rules, one row per LOINC code.

Fixed values: units, adult reference ranges and severity bands as published by
the sources named in the last column.  A range is (sex, low, high); a band is
(low, high), closed on both ends.
"""

NUMERIC_RULES = [
    # bmp
    ("2345-7", "Glucose", "mg/dL", [('any', 70, 100)],
     {"normal": [70, 100], "mild_low": [54, 69], "mild_high": [101, 125], "moderate_low": [40, 53], "moderate_high": [126, 250], "critical_low": [0, 39], "critical_high": [251, 9999]},
     "ADA — fasting plasma glucose"),
    ("3094-0", "BUN (Blood Urea Nitrogen)", "mg/dL", [('any', 7, 20)],
     {"normal": [7, 20], "mild_low": [4, 6], "mild_high": [21, 30], "moderate_low": [1, 3], "moderate_high": [31, 60], "critical_low": [0, 0.9], "critical_high": [61, 999]},
     "ARUP Laboratories — adult reference range"),
    ("2160-0", "Creatinine", "mg/dL", [('male', 0.7, 1.3), ('female', 0.6, 1.1)],
     {"normal": [0.6, 1.3], "mild_low": [0.4, 0.5], "mild_high": [1.4, 2.0], "moderate_low": [0.1, 0.3], "moderate_high": [2.1, 4.0], "critical_low": [0, 0.09], "critical_high": [4.1, 999]},
     "KDIGO — adult male serum creatinine"),
    ("2951-2", "Sodium", "mmol/L", [('any', 136, 145)],
     {"normal": [136, 145], "mild_low": [130, 135], "mild_high": [146, 150], "moderate_low": [120, 129], "moderate_high": [151, 160], "critical_low": [0, 119], "critical_high": [161, 999]},
     "ARUP Laboratories — adult reference range"),
    ("2823-3", "Potassium", "mmol/L", [('any', 3.5, 5.0)],
     {"normal": [3.5, 5.0], "mild_low": [3.0, 3.4], "mild_high": [5.1, 5.5], "moderate_low": [2.5, 2.9], "moderate_high": [5.6, 6.5], "critical_low": [0, 2.4], "critical_high": [6.6, 999]},
     "ARUP Laboratories — adult reference range"),
    ("2075-0", "Chloride", "mmol/L", [('any', 98, 106)],
     {"normal": [98, 106], "mild_low": [90, 97], "mild_high": [107, 112], "moderate_low": [80, 89], "moderate_high": [113, 120], "critical_low": [0, 79], "critical_high": [121, 999]},
     "ARUP Laboratories — adult reference range"),
    ("2028-9", "CO2 (Bicarbonate)", "mmol/L", [('any', 22, 29)],
     {"normal": [22, 29], "mild_low": [18, 21], "mild_high": [30, 34], "moderate_low": [12, 17], "moderate_high": [35, 40], "critical_low": [0, 11], "critical_high": [41, 999]},
     "ARUP Laboratories — adult reference range"),
    ("17861-6", "Calcium", "mg/dL", [('any', 8.5, 10.5)],
     {"normal": [8.5, 10.5], "mild_low": [7.5, 8.4], "mild_high": [10.6, 11.5], "moderate_low": [6.0, 7.4], "moderate_high": [11.6, 13.0], "critical_low": [0, 5.9], "critical_high": [13.1, 999]},
     "ARUP Laboratories — adult total calcium"),
    # cbc
    ("6690-2", "Leukocytes (WBC)", "K/uL", [('any', 4.5, 11.0)],
     {"normal": [4.5, 11.0], "mild_low": [3.5, 4.4], "mild_high": [11.1, 15.0], "moderate_low": [1.0, 3.4], "moderate_high": [15.1, 30.0], "critical_low": [0, 0.9], "critical_high": [30.1, 999]},
     "ARUP Laboratories — adult reference range"),
    ("789-8", "Erythrocytes (RBC)", "M/uL", [('male', 4.5, 5.9), ('female', 4.0, 5.2)],
     {"normal": [4.0, 5.9], "mild_low": [3.5, 3.9], "mild_high": [6.0, 6.5], "moderate_low": [2.5, 3.4], "moderate_high": [6.6, 8.0], "critical_low": [0, 2.4], "critical_high": [8.1, 999]},
     "ARUP Laboratories — adult male"),
    ("718-7", "Hemoglobin", "g/dL", [('male', 13.5, 17.5), ('female', 12.0, 15.5)],
     {"normal": [12.0, 17.5], "mild_low": [10.0, 11.9], "mild_high": [17.6, 19.0], "moderate_low": [7.0, 9.9], "moderate_high": [19.1, 21.0], "critical_low": [0, 6.9], "critical_high": [21.1, 999]},
     "WHO — adult male hemoglobin"),
    ("4544-3", "Hematocrit", "%", [('male', 38.3, 48.6), ('female', 35.5, 44.9)],
     {"normal": [35.5, 48.6], "mild_low": [30.0, 35.4], "mild_high": [48.7, 54.0], "moderate_low": [20.0, 29.9], "moderate_high": [54.1, 60.0], "critical_low": [0, 19.9], "critical_high": [60.1, 100]},
     "ARUP Laboratories — adult male"),
    ("777-3", "Platelets", "K/uL", [('any', 150, 400)],
     {"normal": [150, 400], "mild_low": [100, 149], "mild_high": [401, 500], "moderate_low": [50, 99], "moderate_high": [501, 700], "critical_low": [0, 49], "critical_high": [701, 9999]},
     "ARUP Laboratories — adult reference range"),
    ("787-2", "MCV (Mean Corpuscular Volume)", "fL", [('any', 80, 100)],
     {"normal": [80, 100], "mild_low": [70, 79], "mild_high": [101, 110], "moderate_low": [50, 69], "moderate_high": [111, 130], "critical_low": [0, 49], "critical_high": [131, 999]},
     "ARUP Laboratories — adult reference range"),
    ("785-6", "MCH (Mean Corpuscular Hemoglobin)", "pg", [('any', 27, 33)],
     {"normal": [27, 33], "mild_low": [23, 26], "mild_high": [34, 37], "moderate_low": [15, 22], "moderate_high": [38, 45], "critical_low": [0, 14], "critical_high": [46, 999]},
     "ARUP Laboratories — adult reference range"),
    ("786-4", "MCHC (Mean Corpuscular Hemoglobin Concentration)", "g/dL", [('any', 32, 36)],
     {"normal": [32, 36], "mild_low": [28, 31], "mild_high": [36.1, 38], "moderate_low": [20, 27], "moderate_high": [38.1, 40], "critical_low": [0, 19], "critical_high": [40.1, 999]},
     "ARUP Laboratories — adult reference range"),
    ("788-0", "RDW (Red Cell Distribution Width)", "%", [('any', 11.5, 14.5)],
     {"normal": [11.5, 14.5], "mild_low": [9.0, 11.4], "mild_high": [14.6, 18.0], "moderate_low": [5.0, 8.9], "moderate_high": [18.1, 25.0], "critical_low": [0, 4.9], "critical_high": [25.1, 999]},
     "ARUP Laboratories — adult reference range"),
    ("32623-1", "MPV (Mean Platelet Volume)", "fL", [('any', 7.5, 11.5)],
     {"normal": [7.5, 11.5], "mild_low": [6.0, 7.4], "mild_high": [11.6, 13.0], "moderate_low": [4.0, 5.9], "moderate_high": [13.1, 16.0], "critical_low": [0, 3.9], "critical_high": [16.1, 999]},
     "ARUP Laboratories — adult reference range"),
    ("37874-4", "Plateletcrit (PCT)", "%", [('any', 0.17, 0.35)],
     {"normal": [0.17, 0.35], "mild_low": [0.1, 0.169], "mild_high": [0.351, 0.45], "moderate_low": [0.05, 0.099], "moderate_high": [0.451, 0.6], "critical_low": [0, 0.049], "critical_high": [0.601, 999]},
     "Mindray BC-5800 / common adult reference"),
    ("32207-3", "Platelet Distribution Width (PDW)", "%", [('any', 9.0, 17.0)],
     {"normal": [9.0, 17.0], "mild_low": [7.0, 8.9], "mild_high": [17.1, 19.0], "moderate_low": [5.0, 6.9], "moderate_high": [19.1, 22.0], "critical_low": [0, 4.9], "critical_high": [22.1, 999]},
     "Mindray BC-5800 / common adult reference"),
    ("751-8", "Neutrophils (%)", "%", [('any', 40.0, 70.0)],
     {"normal": [40.0, 70.0], "mild_low": [30.0, 39.9], "mild_high": [70.1, 80.0], "moderate_low": [15.0, 29.9], "moderate_high": [80.1, 90.0], "critical_low": [0, 14.9], "critical_high": [90.1, 100.0]},
     "ARUP Laboratories — adult differential"),
    ("731-0", "Lymphocytes (%)", "%", [('any', 20.0, 40.0)],
     {"normal": [20.0, 40.0], "mild_low": [15.0, 19.9], "mild_high": [40.1, 50.0], "moderate_low": [10.0, 14.9], "moderate_high": [50.1, 70.0], "critical_low": [0, 9.9], "critical_high": [70.1, 100.0]},
     "ARUP Laboratories — adult differential"),
    ("742-7", "Monocytes (%)", "%", [('any', 2.0, 8.0)],
     {"normal": [2.0, 8.0], "mild_low": [0.5, 1.9], "mild_high": [8.1, 11.0], "moderate_low": [0, 0.4], "moderate_high": [11.1, 20.0], "critical_high": [20.1, 100.0]},
     "ARUP Laboratories — adult differential"),
    ("711-2", "Eosinophils (%)", "%", [('any', 0.0, 4.0)],
     {"normal": [0.0, 4.0], "mild_high": [4.1, 7.0], "moderate_high": [7.1, 15.0], "critical_high": [15.1, 100.0]},
     "ARUP Laboratories — adult differential"),
    ("704-7", "Basophils (%)", "%", [('any', 0.0, 1.0)],
     {"normal": [0.0, 1.0], "mild_high": [1.1, 2.9], "moderate_high": [3.0, 5.0], "critical_high": [5.1, 100.0]},
     "ARUP Laboratories — adult differential"),
    # cmp
    ("1751-7", "Albumin", "g/dL", [('any', 3.5, 5.0)],
     {"normal": [3.5, 5.0], "mild_low": [2.8, 3.4], "mild_high": [5.1, 5.5], "moderate_low": [2.0, 2.7], "moderate_high": [5.6, 6.5], "critical_low": [0, 1.9], "critical_high": [6.6, 999]},
     "ARUP Laboratories — adult serum albumin"),
    ("2885-2", "Total Protein", "g/dL", [('any', 6.0, 8.3)],
     {"normal": [6.0, 8.3], "mild_low": [5.0, 5.9], "mild_high": [8.4, 9.5], "moderate_low": [3.5, 4.9], "moderate_high": [9.6, 12.0], "critical_low": [0, 3.4], "critical_high": [12.1, 999]},
     "ARUP Laboratories — adult total protein"),
    ("6768-6", "ALP (Alkaline Phosphatase)", "U/L", [('any', 44, 147)],
     {"normal": [44, 147], "mild_low": [30, 43], "mild_high": [148, 250], "moderate_low": [10, 29], "moderate_high": [251, 500], "critical_low": [0, 9], "critical_high": [501, 9999]},
     "ARUP Laboratories — adult ALP"),
    ("1742-6", "ALT (Alanine Aminotransferase)", "U/L", [('male', 7, 56), ('female', 7, 45)],
     {"normal": [7, 56], "mild_high": [57, 120], "moderate_high": [121, 300], "critical_high": [301, 99999]},
     "ARUP Laboratories — adult male ALT"),
    ("1920-8", "AST (Aspartate Aminotransferase)", "U/L", [('any', 10, 40)],
     {"normal": [10, 40], "mild_high": [41, 80], "moderate_high": [81, 200], "critical_high": [201, 99999]},
     "ARUP Laboratories — adult AST"),
    ("1975-2", "Total Bilirubin", "mg/dL", [('any', 0.1, 1.2)],
     {"normal": [0.1, 1.2], "mild_high": [1.3, 2.5], "moderate_high": [2.6, 5.0], "critical_high": [5.1, 999]},
     "ARUP Laboratories — adult total bilirubin"),
    # kidney
    ("33914-3", "eGFR (Estimated Glomerular Filtration Rate)", "mL/min/1.73m2", [('any', 90, 999)],
     {"normal": [90, 999], "mild_low": [60, 89], "moderate_low": [30, 59], "critical_low": [0, 29]},
     "KDIGO 2012 — normal kidney function ≥90"),
    ("3084-1", "Uric Acid", "mg/dL", [('male', 3.5, 7.2), ('female', 2.6, 6.0)],
     {"normal": [2.6, 7.2], "mild_low": [1.5, 2.5], "mild_high": [7.3, 9.0], "moderate_low": [0.5, 1.4], "moderate_high": [9.1, 12.0], "critical_low": [0, 0.4], "critical_high": [12.1, 999]},
     "ARUP Laboratories — adult male uric acid"),
    ("14959-1", "Microalbumin (Urine)", "mg/L", [('any', 0, 30)],
     {"normal": [0, 30], "mild_high": [31, 300], "moderate_high": [301, 1000], "critical_high": [1001, 99999]},
     "KDIGO — normal urine albumin"),
    ("2777-1", "Phosphate", "mg/dL", [('any', 2.5, 4.5)],
     {"normal": [2.5, 4.5], "mild_low": [1.8, 2.4], "mild_high": [4.6, 5.5], "moderate_low": [1.0, 1.7], "moderate_high": [5.6, 7.0], "critical_low": [0, 0.9], "critical_high": [7.1, 999]},
     "ARUP Laboratories — adult serum phosphate"),
    ("19123-9", "Magnesium", "mg/dL", [('any', 1.7, 2.2)],
     {"normal": [1.7, 2.2], "mild_low": [1.4, 1.6], "mild_high": [2.3, 2.6], "moderate_low": [1.0, 1.3], "moderate_high": [2.7, 4.0], "critical_low": [0, 0.9], "critical_high": [4.1, 999]},
     "ARUP Laboratories — adult serum magnesium"),
    # lipid
    ("2093-3", "Total Cholesterol", "mg/dL", [('any', 0, 200)],
     {"normal": [0, 200], "mild_high": [201, 239], "moderate_high": [240, 300], "critical_high": [301, 9999]},
     "ATP III — desirable total cholesterol"),
    ("2085-9", "HDL Cholesterol", "mg/dL", [('male', 40, 999), ('female', 50, 999)],
     {"normal": [40, 999], "mild_low": [30, 39], "moderate_low": [20, 29], "critical_low": [0, 19]},
     "ATP III — male HDL (low HDL is risk factor)"),
    ("13457-7", "LDL Cholesterol (calculated)", "mg/dL", [('any', 0, 100)],
     {"normal": [0, 100], "mild_high": [101, 129], "moderate_high": [130, 189], "critical_high": [190, 9999]},
     "ACC/AHA 2018 — optimal LDL"),
    ("2571-8", "Triglycerides", "mg/dL", [('any', 0, 150)],
     {"normal": [0, 150], "mild_high": [151, 199], "moderate_high": [200, 499], "critical_high": [500, 99999]},
     "ATP III — normal triglycerides"),
    ("13458-5", "VLDL Cholesterol (calculated)", "mg/dL", [('any', 2, 30)],
     {"normal": [2, 30], "mild_high": [31, 40], "moderate_high": [41, 60], "critical_high": [61, 9999]},
     "ARUP Laboratories — adult reference range"),
    # liver
    ("2324-2", "GGT (Gamma-Glutamyl Transferase)", "U/L", [('male', 9, 48), ('female', 9, 36)],
     {"normal": [9, 48], "mild_high": [49, 100], "moderate_high": [101, 300], "critical_high": [301, 99999]},
     "ARUP Laboratories — adult male GGT"),
    ("1968-7", "Direct Bilirubin", "mg/dL", [('any', 0, 0.3)],
     {"normal": [0, 0.3], "mild_high": [0.4, 1.0], "moderate_high": [1.1, 3.0], "critical_high": [3.1, 999]},
     "ARUP Laboratories — adult direct bilirubin"),
    ("1971-1", "Indirect Bilirubin", "mg/dL", [('any', 0.1, 1.0)],
     {"normal": [0.1, 1.0], "mild_high": [1.1, 2.0], "moderate_high": [2.1, 5.0], "critical_high": [5.1, 999]},
     "ARUP Laboratories — adult indirect bilirubin (calculated)"),
    ("2532-0", "LDH (Lactate Dehydrogenase)", "U/L", [('any', 140, 280)],
     {"normal": [140, 280], "mild_low": [100, 139], "mild_high": [281, 450], "moderate_low": [50, 99], "moderate_high": [451, 800], "critical_low": [0, 49], "critical_high": [801, 99999]},
     "ARUP Laboratories — adult LDH"),
    # thyroid
    ("3016-3", "TSH (Thyroid Stimulating Hormone)", "mIU/L", [('any', 0.4, 4.0)],
     {"normal": [0.4, 4.0], "mild_low": [0.1, 0.39], "mild_high": [4.1, 10.0], "moderate_low": [0.01, 0.09], "moderate_high": [10.1, 20.0], "critical_low": [0, 0.009], "critical_high": [20.1, 999]},
     "ATA — adult TSH reference range"),
    ("3024-7", "Free T4 (Thyroxine)", "ng/dL", [('any', 0.8, 1.8)],
     {"normal": [0.8, 1.8], "mild_low": [0.5, 0.79], "mild_high": [1.81, 2.5], "moderate_low": [0.2, 0.49], "moderate_high": [2.6, 5.0], "critical_low": [0, 0.19], "critical_high": [5.1, 999]},
     "ARUP Laboratories — adult free T4"),
    ("3051-0", "Free T3 (Triiodothyronine)", "pg/mL", [('any', 2.3, 4.2)],
     {"normal": [2.3, 4.2], "mild_low": [1.5, 2.29], "mild_high": [4.3, 6.0], "moderate_low": [0.5, 1.49], "moderate_high": [6.1, 10.0], "critical_low": [0, 0.49], "critical_high": [10.1, 999]},
     "ARUP Laboratories — adult free T3"),
    ("3026-2", "Total T4 (Thyroxine)", "ug/dL", [('any', 4.5, 12.0)],
     {"normal": [4.5, 12.0], "mild_low": [3.0, 4.4], "mild_high": [12.1, 15.0], "moderate_low": [1.0, 2.9], "moderate_high": [15.1, 25.0], "critical_low": [0, 0.9], "critical_high": [25.1, 999]},
     "ARUP Laboratories — adult total T4"),
    # vitamins
    ("1989-3", "25-Hydroxyvitamin D", "ng/mL", [('any', 30, 100)],
     {"normal": [30, 100], "mild_low": [20, 29], "moderate_low": [12, 19], "critical_low": [0, 11], "mild_high": [101, 150], "critical_high": [151, 999]},
     "Endocrine Society 2011 — sufficient ≥30 ng/mL"),
    ("2132-9", "Vitamin B12", "pg/mL", [('any', 200, 900)],
     {"normal": [200, 900], "mild_low": [150, 199], "moderate_low": [100, 149], "critical_low": [0, 99], "mild_high": [901, 2000]},
     "ARUP Laboratories — adult serum B12"),
    ("2284-8", "Folate (Serum)", "ng/mL", [('any', 3.0, 20.0)],
     {"normal": [3.0, 20.0], "mild_low": [2.0, 2.9], "critical_low": [0, 1.9], "mild_high": [20.1, 50.0]},
     "ARUP Laboratories — adult serum folate"),
    ("2498-4", "Iron (Serum)", "ug/dL", [('male', 65, 175), ('female', 50, 170)],
     {"normal": [50, 175], "mild_low": [30, 49], "moderate_low": [10, 29], "critical_low": [0, 9], "mild_high": [176, 300], "moderate_high": [301, 500], "critical_high": [501, 9999]},
     "ARUP Laboratories — adult male serum iron"),
    ("2276-4", "Ferritin", "ng/mL", [('male', 30, 400), ('female', 15, 150)],
     {"normal": [15, 400], "mild_low": [10, 14], "moderate_low": [5, 9], "critical_low": [0, 4], "mild_high": [401, 1000], "moderate_high": [1001, 2000], "critical_high": [2001, 99999]},
     "ARUP Laboratories — adult male ferritin"),
]
