"""Analyte families for range plausibility (fixed values)."""

# family, LOINC codes, plausible value span, plausible range span, category
FAMILIES = [
    ("cbc_cell_counts", ['6690-2', '789-8', '26464-8', '26474-7'],
     (0.1, 2000), (0.1, 500), "hematology"),
    ("cbc_indices", ['787-2', '785-6', '786-4', '788-0', '4544-3'],
     (1, 500), (1, 200), "hematology"),
    ("cbc_hemoglobin", ['718-7', '4544-3'],
     (3, 60), (3, 60), "cbc"),
    ("cbc_platelets", ['777-3', '32623-1'],
     (10, 1500), (50, 600), "cbc"),
    ("electrolytes", ['2951-2', '2823-3', '2075-0', '17861-6', '19123-9', '2777-1'],
     (0.1, 200), (0.1, 200), "electrolyte"),
    ("calcium_mgdl", ['17861-6'],
     (4, 20), (6, 14), "electrolyte"),
    ("calcium_mmol", ['17861-6'],
     (1.0, 5.0), (1.5, 3.5), "electrolyte"),
    ("phosphate_mmol", ['2777-1'],
     (0.3, 5.0), (0.5, 2.5), "electrolyte"),
    ("lipids_mgdl", ['2093-3', '2085-9', '13457-7', '2571-8'],
     (5, 1500), (0, 1000), "lipid"),
    ("lipids_mmol", ['2093-3', '2085-9', '13457-7', '2571-8'],
     (0.1, 30), (0, 15), "lipid"),
    ("thyroid_tsh", ['3016-3'],
     (0.001, 500), (0.01, 20), "endocrine"),
    ("thyroid_hormones", ['3024-7', '3026-2', '3051-0'],
     (0.01, 200), (0.01, 80), "endocrine"),
    ("hormones", ['2986-8', '2991-8', '83085-1'],
     (0.01, 5000), (0.01, 2000), "hormone"),
    ("tumor_markers", ['2857-1', '10535-3', '19961-2', '83112-3'],
     (0, 100000), (0, 1000), "tumor-marker"),
    ("kidney", ['2160-0', '3094-0', '3084-1', '33914-3', '62238-1'],
     (0.01, 500), (0.01, 300), "kidney"),
    ("liver", ['1742-6', '1920-8', '6768-6', '2324-2', '1975-2', '1968-7'],
     (0.01, 5000), (0, 500), "liver"),
    ("glucose", ['2345-7', '4548-4'],
     (0.1, 1000), (0.1, 500), "metabolic"),
    ("infectious", ['5196-1', '16935-9', '13955-0', '22322-2'],
     (0, 50000), (0, 10000), "infectious"),
    ("iron_studies", ['2498-4', '2276-4', '2500-7', '14800-7'],
     (0.1, 100000), (0.1, 5000), "nutrition"),
    ("inflammatory", ['1988-5', '33959-8'],
     (0.01, 5000), (0, 500), "inflammatory"),
    ("vitamin_d", ['1989-3', '62292-8'],
     (0.1, 500), (0.1, 200), "nutrition"),
    ("vitamin_b12", ['2132-9'],
     (10, 5000), (50, 2000), "nutrition"),
    ("folate", ['2284-8', '20567-4'],
     (0.1, 100), (0.5, 50), "nutrition"),
]

RESTRICTED_FLAG_CATEGORIES = ['hormone', 'tumor-marker', 'infectious']
DECISION_THRESHOLD_CODES = ['2093-3', '2085-9', '13457-7', '2571-8', '4548-4', '53553-4']
