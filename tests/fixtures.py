"""Planted-structure tables built with our own draws."""

import numpy as np

SYSTEMS = {
    "Digestive": ["bloating", "gas", "constipation", "acidity", "nausea", "belching", "indigestion", "abdominal cramps"],
    "Respiratory": ["cough", "wheezing", "sputum", "chest tightness", "sneezing", "runny nose", "hoarseness", "chest congestion"],
    "Skin": ["rash", "itching", "redness", "dry skin", "skin lesions", "roughness", "hot flushes", "photosensitivity"],
    "Musculoskeletal": ["joint pain", "stiffness", "back pain", "muscle pain", "bone pain", "cracking", "swelling", "weakness"],
}


def condition_rows(n=160, seed=0):
    """(condition_id, system, symptoms): three to five symptoms of one system, fever now and then."""
    rng = np.random.default_rng(seed)
    names = list(SYSTEMS)
    rows = []
    for i in range(n):
        system = names[i % len(names)]
        picked = list(rng.choice(SYSTEMS[system], rng.integers(3, 6), replace=False))
        if rng.random() < 0.3:
            picked.append("fever")
        rows.append((i, system.lower(), [str(p) for p in picked]))
    return rows


def planted_docs(n=300, groups=4, per=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = i % groups
        for t in rng.choice(per, 3, replace=False):
            rows.append((i, f"g{g}_s{t}"))
    return rows


def cohort_rows(n=1500, seed=3):
    """Outcome driven by age and family history only."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        age = int(rng.integers(17, 81))
        family = str(rng.choice(["yes", "no", "unknown"], p=[0.4, 0.55, 0.05]))
        z = -3 + 0.06 * age + (1.0 if family == "yes" else 0.0) - 0.4
        rows.append((i, age, family, str(rng.choice(["yes", "no"])), str(rng.choice(["regular", "irregular"])), float(rng.integers(5, 10)),
                     int(rng.random() < 1 / (1 + np.exp(-z)))))
    return rows
