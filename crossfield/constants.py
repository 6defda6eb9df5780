"""Fixed values of the measurement domain, stated plainly.

Word lists, code sets, lookup tables and physical constants that results
depend on.  Nothing here is logic.
"""

from __future__ import annotations

# ---------------------------------------------------------------- code sets
# Reaction modifier (sf8) codes by meaning.
SF8_RELATIVE = ["REL", "RAT", "RTE", "FCT"]
SF8_AVERAGED = ["MXW", "SPA", "FIS", "AV", "BRA", "BRS"]
SF8_OTHER = ["ETA", "ALF", "RES", "G", "S0", "2G", "RM"]
# sf8 codes whose energy is not mono-energetic.
SF8_SPECTRUM_AVERAGED = ["MXW", "SPA", "SDT", "FST", "FIS", "TTA", "BRA", "BRS", "AV"]
# sf9 codes of data that were not measured.
SF9_NOT_MEASURED = ["CALC", "DERIV", "EVAL", "RECOM"]
# sf5 branch codes of partial quantities.
SF5_PARTIAL = [
    "PRE", "SEC", "TER", "QTR", "DL", "PAR",
    "CUM", "(CUM)", "(CUM)/M+", "CHN", "IND", "UNW",
    "(M)", "M+", "EXL", "POT",
    "1", "2", "3", "4",
]
# sf6 quantities that are cross sections.
SF6_ACCEPTED = ["SIG", "WID"]
# Spellings that mean "no code".
NULL_WORDS = ["", "NONE", "NAN", "NULL"]
# Flags of superseded sub-entries.
SUPERSEDED_FLAGS = ["1", "D"]

# --------------------------------------------------------- reaction numbers
# Reaction lists behind each selection mode.
MT_REACTOR_CORE = [2, 4, 16, 18, 102, 103, 107]
MT_THRESHOLD_ONLY = [16, 17, 103, 104, 105, 106, 107]
MT_FISSION_DETAILS = [18, 19, 20, 21, 38]
MT_LUMPED_FROM = 9000
# Inclusive reaction-number ranges a neutron can induce.
MT_NEUTRON_RANGES = [
    (1, 5), (10, 45), (50, 91), (102, 117), (201, 207), (301, 301), (444, 444),
    (454, 459), (500, 572), (600, 849), (9000, 9999),
]

# Reaction names.
MT_NAMES = {
    1: "Total", 2: "Elastic", 3: "Nonelastic", 4: "Inelastic", 5: "Other/Misc",
    10: "(n,continuum)", 11: "(n,2nd)", 16: "(n,2n)", 17: "(n,3n)", 18: "Fission",
    19: "(n,f) - 1st chance", 20: "(n,nf) - 2nd chance", 21: "(n,2nf) - 3rd chance",
    22: "(n,nα)", 23: "(n,n3α)", 24: "(n,2nα)", 25: "(n,3nα)", 28: "(n,np)",
    29: "(n,n2α)", 30: "(n,2n2α)", 32: "(n,nd)", 33: "(n,nt)", 34: "(n,n³He)",
    35: "(n,nd2α)", 36: "(n,nt2α)", 37: "(n,4n)", 38: "(n,3nf) - 4th chance",
    41: "(n,2np)", 42: "(n,3np)", 44: "(n,n2p)", 45: "(n,npa)",
    50: "(n,n₀) - Ground state",
    51: "(n,n₁) - 1st excited",
    52: "(n,n₂) - 2nd excited",
    53: "(n,n₃) - 3rd excited",
    54: "(n,n₄) - 4th excited",
    55: "(n,n₅) - 5th excited",
    56: "(n,n₆) - 6th excited",
    57: "(n,n₇) - 7th excited",
    58: "(n,n₈) - 8th excited",
    59: "(n,n₉) - 9th excited",
    60: "(n,n₁₀) - 10th excited",
    61: "(n,n₁₁) - 11th excited",
    62: "(n,n₁₂) - 12th excited",
    63: "(n,n₁₃) - 13th excited",
    64: "(n,n₁₄) - 14th excited",
    65: "(n,n₁₅) - 15th excited",
    66: "(n,n₁₆) - 16th excited",
    67: "(n,n₁₇) - 17th excited",
    68: "(n,n₁₈) - 18th excited",
    69: "(n,n₁₉) - 19th excited",
    70: "(n,n₂₀) - 20th excited",
    71: "(n,n₂₁) - 21st excited",
    72: "(n,n₂₂) - 22nd excited",
    73: "(n,n₂₃) - 23rd excited",
    74: "(n,n₂₄) - 24th excited",
    75: "(n,n₂₅) - 25th excited",
    76: "(n,n₂₆) - 26th excited",
    77: "(n,n₂₇) - 27th excited",
    78: "(n,n₂₈) - 28th excited",
    79: "(n,n₂₉) - 29th excited",
    80: "(n,n₃₀) - 30th excited",
    81: "(n,n₃₁) - 31st excited",
    82: "(n,n₃₂) - 32nd excited",
    83: "(n,n₃₃) - 33rd excited",
    84: "(n,n₃₄) - 34th excited",
    85: "(n,n₃₅) - 35th excited",
    86: "(n,n₃₆) - 36th excited",
    87: "(n,n₃₇) - 37th excited",
    88: "(n,n₃₈) - 38th excited",
    89: "(n,n₃₉) - 39th excited",
    90: "(n,n₄₀) - 40th excited",
    91: "(n,n continuum)",
    102: "(n,γ) Capture", 103: "(n,p)", 104: "(n,d)", 105: "(n,t)", 106: "(n,³He)",
    107: "(n,α)", 108: "(n,2α)", 109: "(n,3α)", 111: "(n,2p)", 112: "(n,pα)",
    113: "(n,t2α)", 114: "(n,d2α)", 115: "(n,pd)", 116: "(n,pt)", 117: "(n,dα)",
    201: "Total absorption", 202: "Total capture", 203: "Total (n,Xp)",
    204: "Total (n,Xd)", 205: "Total (n,Xt)", 206: "Total (n,X³He)", 207: "Total (n,Xα)",
    301: "Heating (KERMA)", 444: "Damage energy",
    454: "ν̄ - Avg neutrons/fission", 455: "ν̄ delayed", 456: "ν̄ prompt",
    457: "Q̄ - Energy release", 458: "Energy release (fragments)",
    459: "Energy release (prompt γ)",
    500: "Total photon production", 501: "(n,total) γ", 502: "(n,γ) γ production",
    504: "(n,n') γ production", 515: "(n,p) γ production", 516: "(n,d) γ production",
    517: "(n,t) γ production", 518: "(n,³He) γ production", 522: "(n,nα) γ production",
    526: "(n,n2α) γ production",
    600: "(n,p₀) - ground", 601: "(n,p₁) - 1st excited", 649: "(n,p continuum)",
    650: "(n,d₀) - ground", 699: "(n,d continuum)",
    700: "(n,t₀) - ground", 749: "(n,t continuum)",
    750: "(n,³He₀) - ground", 799: "(n,³He continuum)",
    800: "(n,α₀) - ground", 801: "(n,α₁) - 1st excited", 849: "(n,α continuum)",
    9000: "Covariance data (lumped)", 9001: "Covariance: Total", 9002: "Covariance: Elastic",
    9004: "Covariance: Inelastic", 9016: "Covariance: (n,2n)", 9017: "Covariance: (n,3n)",
    9018: "Covariance: Fission", 9102: "Covariance: (n,γ)", 9103: "Covariance: (n,p)",
    9104: "Covariance: (n,d)", 9105: "Covariance: (n,t)", 9107: "Covariance: (n,α)",
}

# Reaction categories as inclusive ranges, first match wins.
MT_CATEGORIES = [
    ("Fundamental", [(1, 5)]),
    ("Neutron Emission", [(16, 17), (37, 37)]),
    ("Fission", [(18, 21), (38, 38)]),
    ("Charged Particle", [(103, 109), (111, 112), (115, 117)]),
    ("Capture", [(102, 102)]),
    ("Inelastic Levels", [(50, 91)]),
    ("Photon Production", [(500, 572)]),
    ("Covariance", [(9000, 9199)]),
]

# Particles emitted per reaction number range (others emit none).
PARTICLE_COLUMNS = ["out_n", "out_p", "out_a", "out_g", "out_f", "out_t", "out_h", "out_d", "is_met"]
PARTICLE_EMISSION = [
    ((2, 2), {"out_n": 1}),
    ((4, 4), {"out_n": 1, "out_g": 1}),
    ((16, 16), {"out_n": 2}),
    ((17, 17), {"out_n": 3}),
    ((18, 21), {"out_f": 1}),
    ((22, 22), {"out_n": 1, "out_a": 1}),
    ((28, 28), {"out_n": 1, "out_p": 1}),
    ((37, 37), {"out_n": 4}),
    ((38, 38), {"out_n": 4, "out_f": 1}),
    ((51, 91), {"out_n": 1, "out_g": 1}),
    ((102, 102), {"out_g": 1}),
    ((103, 103), {"out_p": 1}),
    ((104, 104), {"out_d": 1}),
    ((105, 105), {"out_t": 1}),
    ((106, 106), {"out_h": 1}),
    ((107, 107), {"out_a": 1}),
    ((108, 108), {"out_a": 2}),
    ((600, 649), {"out_p": 1, "is_met": 1}),
    ((650, 699), {"out_d": 1, "is_met": 1}),
    ((700, 749), {"out_t": 1, "is_met": 1}),
    ((750, 799), {"out_h": 1, "is_met": 1}),
    ((800, 849), {"out_a": 1, "is_met": 1}),
]

# ----------------------------------------------------------------- nuclides
# Element symbols, Z = 1..99 in order.
ELEMENT_SYMBOLS = [
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si",
    "P", "S", "Cl", "Ar", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni",
    "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y", "Zr", "Nb", "Mo",
    "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe", "Cs", "Ba",
    "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb",
    "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po",
    "At", "Rn", "Fr", "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf",
    "Es",
]
# Projectile display names, keyed in lower case.
PROJECTILE_NAMES = {
    "n": "n (neutron)", "p": "p (proton)", "d": "d (deuteron)", "t": "t (triton)",
    "a": "α (alpha)", "g": "γ (photon)", "he3": "³He",
}
MAGIC_NUMBERS = [2, 8, 20, 28, 50, 82, 126]
FISSILE_NUCLIDES = [(92, 233), (92, 235), (94, 239)]
# Nuclear radius constant (fm), wave-number constant (1/fm at 1 MeV).
RADIUS_FM = 1.25
WAVE_NUMBER = 0.22
# Mass-formula coefficients in MeV.
SEMF_VOLUME, SEMF_SURFACE, SEMF_COULOMB, SEMF_ASYMMETRY, SEMF_PAIRING = 15.75, 17.8, 0.711, 23.7, 11.18
# Seconds per half-life unit.
YEAR_S = 31557600.0
HALF_LIFE_UNITS = {
    "ys": 1e-24, "zs": 1e-21, "as": 1e-18, "fs": 1e-15, "ps": 1e-12, "ns": 1e-9,
    "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0,
    "y": YEAR_S, "ky": YEAR_S * 1e3, "My": YEAR_S * 1e6, "Gy": YEAR_S * 1e9,
    "Ty": YEAR_S * 1e12, "Py": YEAR_S * 1e15, "Ey": YEAR_S * 1e18,
}
STABLE_HALF_LIFE_S = 1e30

# ----------------------------------------------------------------- energies
# Physical limits of the quality chain (eV, barns), inclusive.
ENERGY_LIMITS = (1e-5, 1e9)
CROSS_SECTION_LIMITS = (1e-10, 1e6)
# Audit regimes (upper bound in eV, exclusive).
ENERGY_REGIMES = [("thermal", 1.0), ("resonance", 1e4), ("fast", 2e7)]
ENERGY_REGIME_ABOVE = "ultra_fast"
# Named regions (lower inclusive, upper exclusive, eV).
ENERGY_REGIONS = [
    ("Thermal", 1e-5, 0.625), ("Epithermal", 0.625, 1e3),
    ("Resonance", 1e3, 1e5), ("Fast", 1e5, 2e7),
]
UNCERTAINTY_PERCENTILES = [10, 25, 50, 75, 90, 95, 99]
OUTLIER_THRESHOLDS = [2.0, 3.0, 4.0, 5.0]

# ---------------------------------------------------------------- validation
# Share of a normal distribution within 1, 2 and 3 sigma.
NORMAL_COVERAGE = {1: 0.6826894921370859, 2: 0.9544997361036416, 3: 0.9973002039367398}
# Criticality benchmarks (name, reference k, reference sigma).
CRITICALITY_BENCHMARKS = [
    ("PWR_PIN", 1.18647, 0.00012),
    ("BWR_ASSEMBLY", 1.17234, 0.00015),
    ("FAST_CORE", 1.03567, 0.00020),
    ("JEZEBEL", 1.00000, 0.00010),
]
# Sensitivity of k to a reaction (Z, A, MT, coefficient) per reactor type.
SENSITIVITIES = {
    "PWR": [
        (92, 235, 18, 0.500), (92, 235, 102, -0.150), (92, 235, 2, 0.020),
        (92, 238, 102, -0.080), (92, 238, 18, 0.015), (92, 238, 2, -0.010),
        (94, 239, 18, 0.300), (94, 239, 102, -0.100),
        (1, 1, 2, 0.180), (1, 1, 102, -0.050), (8, 16, 2, 0.005),
    ],
    "BWR": [(92, 235, 18, 0.520), (92, 235, 102, -0.160), (92, 238, 102, -0.090), (1, 1, 2, 0.200)],
    "Fast": [(92, 235, 18, 0.400), (92, 238, 18, 0.250), (94, 239, 18, 0.450), (92, 238, 2, 0.150)],
}
# Impact bands of a sensitivity (exclusive lower bound of |S|).
IMPACT_BANDS = [("CRITICAL", 0.3), ("HIGH", 0.1), ("MEDIUM", 0.05), ("LOW", 0.01)]
