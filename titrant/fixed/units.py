"""Unit tables (fixed values)."""

# LOINC -> canonical unit and ordered (from unit, factor) pairs; every factor is of high confidence.
UNIT_CONVERSIONS = [
    ("2345-7", "mg/dL", [('mmol/L', 18.0182), ('g/L', 100.0)]),
    ("2160-0", "mg/dL", [('µmol/L', 0.0113), ('umol/L', 0.0113)]),
    ("718-7", "g/dL", [('g/L', 0.1), ('mmol/L', 1.6114)]),
    ("2093-3", "mg/dL", [('mmol/L', 38.67)]),
    ("2571-8", "mg/dL", [('mmol/L', 88.57)]),
    ("2085-9", "mg/dL", [('mmol/L', 38.67)]),
    ("13457-7", "mg/dL", [('mmol/L', 38.67)]),
    ("3024-7", "ng/dL", [('pmol/L', 0.0777)]),
    ("3051-0", "pg/mL", [('pmol/L', 0.6513)]),
    ("3094-0", "mg/dL", [('mmol/L', 2.8011)]),
    ("3084-1", "mg/dL", [('µmol/L', 0.01681), ('umol/L', 0.01681), ('mmol/L', 16.81)]),
    ("1975-2", "mg/dL", [('µmol/L', 0.0585), ('umol/L', 0.0585)]),
    ("1968-7", "mg/dL", [('µmol/L', 0.0585), ('umol/L', 0.0585)]),
    ("17861-6", "mg/dL", [('mmol/L', 4.0078)]),
    ("19123-9", "mg/dL", [('mmol/L', 2.4305)]),
    ("2777-1", "mg/dL", [('mmol/L', 3.0974)]),
    ("1989-3", "ng/mL", [('nmol/L', 0.4006)]),
    ("2132-9", "pg/mL", [('pmol/L', 1.3554)]),
]

# printed unit -> canonical spelling
UNIT_ALIASES = {
    "U/L": "U/L",
    "IU/L": "U/L",
    "u/l": "U/L",
    "UI/L": "U/L",
    "K/uL": "K/uL",
    "10^3/uL": "K/uL",
    "x10^9/L": "K/uL",
    "10*3/uL": "K/uL",
    "G/L": "K/uL",
    "M/uL": "M/uL",
    "10^6/uL": "M/uL",
    "x10^12/L": "M/uL",
    "T/L": "M/uL",
    "g/L": "g/L",
    "g/dL": "g/dL",
    "gm/dL": "g/dL",
    "mg/dL": "mg/dL",
    "mg/dl": "mg/dL",
    "mmol/L": "mmol/L",
    "mmol/l": "mmol/L",
    "mEq/L": "mmol/L",
    "meq/L": "mmol/L",
    "µmol/L": "µmol/L",
    "umol/L": "µmol/L",
    "mIU/L": "mIU/L",
    "mU/L": "mIU/L",
    "uIU/mL": "mIU/L",
    "fL": "fL",
    "fl": "fL",
    "pg": "pg",
    "ng/dL": "ng/dL",
    "ng/dl": "ng/dL",
    "pg/mL": "pg/mL",
    "pg/ml": "pg/mL",
    "ug/dL": "ug/dL",
    "µg/dL": "ug/dL",
    "%": "%",
    "mm/hr": "mm/hr",
    "mm/h": "mm/hr",
    "mg/L": "mg/L",
    "mg/l": "mg/L",
    "ng/mL": "ng/mL",
    "ng/ml": "ng/mL",
    "pmol/L": "pmol/L",
    "pmol/l": "pmol/L",
    "mL/min/1.73m2": "mL/min/1.73m2",
    "mL/min/1.73 m2": "mL/min/1.73m2",
}

# unit (lower case) -> physically possible span
UNIT_BOUNDS = {
    "%": (0, 100), "mmol/mol": (0, 250),
    "mg/dl": (0, 10000), "g/dl": (0, 50), "g/l": (0, 500), "ug/dl": (0, 10000), "μg/dl": (0, 10000),
    "ng/dl": (0, 50000), "ng/ml": (0, 100000), "pg/ml": (0, 50000), "ug/l": (0, 100000), "mg/l": (0, 5000),
    "mmol/l": (0, 500), "nmol/l": (0, 50000), "pmol/l": (0, 500), "meq/l": (0, 500),
    "u/l": (0, 50000), "iu/l": (0, 50000),
    "cells/ul": (0, 500000), "10^9/l": (0, 500), "10^12/l": (0, 20), "k/ul": (0, 2000),
    "10^3/ul": (0, 2000), "10^3/μl": (0, 2000),
    "fl": (0, 200), "pg": (0, 100),
    "miu/l": (0, 1000), "miu/ml": (0, 100000), "μiu/ml": (0, 1000),
    "mm/hr": (0, 200),
}

# LOINC -> humanly possible span in the canonical unit
HUMAN_BOUNDS = {
    "6690-2": (0.1, 500.0), "718-7": (1.0, 30.0), "4544-3": (5.0, 100.0), "777-3": (1.0, 5000.0),
    "2345-7": (1.0, 5000.0), "2951-2": (80.0, 200.0), "2823-3": (1.0, 15.0), "17861-6": (0.1, 30.0),
    "2160-0": (0.01, 100.0), "33914-3": (2.0, 200.0), "3094-0": (0.5, 200.0),
    "1742-6": (1.0, 20000.0), "1920-8": (1.0, 20000.0), "6768-6": (1.0, 5000.0), "2324-2": (1.0, 10000.0),
    "2093-3": (10.0, 2000.0), "2571-8": (10.0, 50000.0), "2085-9": (1.0, 500.0), "13457-7": (1.0, 1000.0),
    "3016-3": (0.001, 500.0),
    "1989-3": (1.0, 500.0), "2132-9": (10.0, 100000.0), "2284-8": (0.5, 100.0),
    "2498-4": (1.0, 2000.0), "2276-4": (1.0, 100000.0),
    "1988-5": (0.01, 1000.0), "3084-1": (0.1, 50.0), "4548-4": (1.0, 25.0),
}

# Glycated haemoglobin conversions, tolerances and plausible spans
IFCC_SLOPE, IFCC_INTERCEPT = 10.93, -23.5
EAG_SLOPE, EAG_INTERCEPT = 28.7, -46.7
MMOL_TO_MGDL = 18.015
IFCC_TOLERANCE, EAG_MGDL_TOLERANCE, EAG_MMOL_TOLERANCE = 2.0, 5.0, 0.3
NGSP_SPAN, IFCC_SPAN = (3.0, 20.0), (10.0, 195.0)
EAG_MGDL_SPAN, EAG_MMOL_SPAN = (50.0, 500.0), (2.5, 28.0)
ADA_NORMAL, ADA_PREDIABETES = 5.7, 6.5
