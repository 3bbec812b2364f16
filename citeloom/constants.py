"""Values that results depend on, as plain tables."""

from __future__ import annotations

#: Citation reporters that the extractor knows; callers whose texts cite others pass them along.
REPORTERS = [
    "U.S.", "S. Ct.", "S.Ct.", "L. Ed.", "L. Ed. 2d", "L.Ed.2d", "F.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "B.R.", "F.R.D.", "Fed. Cl.", "Fed. Appx.", "A.2d", "A.3d", "N.E.2d", "N.E.3d", "N.W.2d", "P.2d", "P.3d", "S.E.2d", "S.W.2d", "S.W.3d", "So. 2d", "So. 3d", "WL",
]

#: Doctrines and the phrases that name them.
DOCTRINES = {
    "terry_stop": ["terry stop", "investigatory stop", "articulable suspicion", "brief detention", "terry v. ohio"],
    "exclusionary_rule": ["exclusionary rule", "fruit of the poisonous tree", "suppression of evidence"],
    "plain_view": ["plain view", "inadvertent discovery", "immediately apparent"],
    "exigent_circumstances": ["exigent circumstances", "hot pursuit", "imminent destruction", "emergency exception"],
    "automobile_exception": ["automobile exception", "vehicle search", "inventory search", "carroll doctrine"],
    "consent_search": ["consent to search", "voluntary consent", "third party consent", "third-party consent"],
    "probable_cause": ["probable cause", "reasonable belief", "totality of the circumstances", "totality of circumstances"],
    "good_faith": ["good faith exception", "leon", "reasonably relied", "good-faith exception"],
    "curtilage": ["curtilage", "open fields", "immediate vicinity"],
    "search_incident": ["search incident to arrest", "wingspan", "chimel", "grab area"],
}

#: Words kept by the tokenizers though they may be stop words.
PRESERVED = (
    "unreasonable reasonable reasonably warrant warrantless probable cause seizure seize seized search searched searching arrest arrested consent consented exception exceptions "
    "curtilage exigent contraband suppression suppress suppressed exclusionary detention detain detained stop frisk plain view expectation privacy trespass third party"
).split()

#: Stop words of the default tokenizer.
STOP_WORDS = (
    "a an the and or but if then than of to in on at by for from with without within into over under about against between through during before after above below up down out off "
    "is are was were be been being am do does did have has had having will would shall should can could may might must i you he she it we they me him her us them my your his its our their "
    "this that these those who whom which what when where why how not no nor so as such too very just only own same other any each few more most some all both also there here again once while because until although though"
).split()

#: Courts with the strings that name them, in the order they are tried.
COURT_ALIASES = {
    "ca1": ["1st cir", "first circuit"], "ca2": ["2nd cir", "second circuit"], "ca3": ["3rd cir", "third circuit"], "ca4": ["4th cir", "fourth circuit"], "ca5": ["5th cir", "fifth circuit"],
    "ca6": ["6th cir", "sixth circuit"], "ca7": ["7th cir", "seventh circuit"], "ca8": ["8th cir", "eighth circuit"], "ca9": ["9th cir", "ninth circuit"], "ca10": ["10th cir", "tenth circuit"],
    "ca11": ["11th cir", "eleventh circuit"], "cadc": ["d.c. cir", "dc cir"], "cafc": ["fed. cir", "federal circuit"],
}

#: Labels of courts.
CIRCUIT_LABELS = {
    "ca1": "1st Cir", "ca2": "2nd Cir", "ca3": "3rd Cir", "ca4": "4th Cir", "ca5": "5th Cir", "ca6": "6th Cir", "ca7": "7th Cir", "ca8": "8th Cir", "ca9": "9th Cir", "ca10": "10th Cir", "ca11": "11th Cir",
    "cadc": "DC Cir", "cafc": "Fed Cir", "scotus": "SCOTUS",
}

#: Prefixes of federal court ids.
FEDERAL_PREFIXES = ["ca1", "ca2", "ca3", "ca4", "ca5", "ca6", "ca7", "ca8", "ca9", "ca10", "ca11", "cadc"]

#: Limits and thresholds.
MIN_CHARS, MAX_CHARS, MIN_TOKENS, TOP_K, RRF_K, RRF_CUT, SIM_CUT, CASE_SIM_CUT, RELEVANT_RRF, NAME_CUT, DENSITY_CUT = 200, 50_000, 20, 5, 60, 0.01, 0.6, 0.8, 0.02, 0.7, 1
DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 100, 1e-6
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SIM_GRID, RRF_GRID, DENSITY_GRID = [0.60, 0.65, 0.70, 0.75, 0.80, 0.85], [0.010, 0.015, 0.020, 0.025, 0.030, 0.035], [1, 2, 3, 4, 5]
YEAR_SHIFTS = [-3, -2, -1, 1, 2, 3]
YEAR_RANGE = (2005, 2025)
EXCLUDED_YEARS = ["2026"]
PUNISHED, SUSPECTED = 0.70, 0.40
STATE_SHARE = 0.4
FEATURES = ["rrf_score", "dense_score", "case_sim", "density_score", "pagerank_score", "name_score", "temporal_valid"]
