"""Name similarity against the standard library on all pairs."""

from difflib import SequenceMatcher

from titrant.operators import names


def test_closest_names_match_all_pairs(spark):
    words = ["hemoglobin a1c", "hemoglobin", "glucose", "glucose fasting", "cholesterol", "hdl cholesterol", "ldl cholesterol", "tsh", "ferritin", "creatinine"]
    entries = spark.createDataFrame([(w, f"{k}-0", 0, k) for k, w in enumerate(words)], "norm string, loinc string, kind int, ord int")
    asked = ["hemoglobin a1", "glucos", "cholesterol", "cholestrol", "hdl cholestrol", "ferritine", "creatinin", "zzz", "tsx", "glucose fastin", "haemoglobin"]
    got = {r.norm_key: (r.near_loinc, round(r.near_score, 9)) for r in names.closest_names(spark.createDataFrame([(a,) for a in asked], "norm_key string"), entries).collect()}
    want = {}
    for a in asked:
        scored = [(-SequenceMatcher(None, a, w).ratio(), k) for k, w in enumerate(words)]
        best = min(scored)
        if -best[0] >= names.FUZZY_CUTOFF:
            want[a] = (f"{best[1]}-0", round(-best[0], 9))
    assert got == want and len(want) >= 8
