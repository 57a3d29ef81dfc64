"""Item ids, diagnosis codes, names and limits.

These lists must equal the published clinical definitions for the results to be right,
so they are given plainly and in their natural order.
"""

# --- infusions of vasoactive drugs: item id -> name used in output columns
PRESSOR_ITEMS = {
    221906: "noradrenalin",
    221749: "phenylephrine",
    222315: "vasopressin",
    221289: "adrenalin",
    221662: "dopamine",
    221653: "dobutamin",
    221986: "milrinone",
    229764: "angiotensin",
}
PRESSORS = list(PRESSOR_ITEMS.values())

# rows at or above this rate are taken as charting errors
RATE_BELOW = {"noradrenalin": 5.5}

# noradrenaline equivalents: divisor per drug (dobutamine and milrinone do not count)
EQUIVALENT_DIVISORS = {
    "noradrenalin": 1,
    "phenylephrine": 10,
    "vasopressin": 24,
    "adrenalin": 1,
    "dopamine": 100,
    "angiotensin": 100,
}

# decimals kept in the daily maxima
DAILY_DECIMALS = {
    "noradrenalin": 2,
    "phenylephrine": 1,
    "vasopressin": 1,
    "adrenalin": 2,
    "dopamine": 1,
    "dobutamin": 1,
    "milrinone": 3,
    "angiotensin": 1,
    "vasopressor_rate": 2,
}

MILRINONE_ITEM = 221986

# --- fluids in
CRYSTALLOID_ITEMS = [225828, 225827, 225158, 225825]
COLLOID_ITEMS = [220864, 225795, 225174]
BLOOD_ITEMS = [225171, 220970, 225168, 225170]
INTAKE_ITEMS = [
    220862, 220864, 225173, 225171, 225795, 220970, 225174, 227530, 225168, 225170,
    225823, 225941, 225827, 225825, 220950, 228140, 228141, 228142, 220949, 220952,
    225797, 225799, 226453, 225828, 225830, 225159, 225158, 228341, 225161, 226089,
    226452, 227533, 225943, 225944, 227977, 227976, 227978, 227979, 228355, 226875,
    225937, 226877, 227698, 227699, 227696, 227695, 228356, 229013, 229295, 228359,
    226023, 226020, 226022, 221207, 226027, 226024, 226026, 225928, 228131, 228132,
    228133, 228134, 228135, 229010, 229011, 228348, 228351, 227973, 227974, 227975,
    226019, 226016, 226017, 227518, 225931, 226882, 226881, 226880, 226031, 226028,
    226030, 221036, 229297, 226039, 226036, 226038, 225930, 228383, 225929, 229009,
    229014, 228360, 228361, 228363, 226047, 226044, 226045, 226046, 225935, 226051,
    226048, 226049, 226050, 225936, 228364, 228367, 229012, 229296, 226059, 226058,
    225934, 227090, 225801, 225920, 225917, 225916, 229583, 226000, 229574, 225995,
    225996, 225994, 225991, 226002,
]

MILLILITRES = ["ml", "mL", "cm3"]
LITRES = "L"
MICROLITRES = "uL"

# --- fluids out
DAILY_OUTPUT_ITEMS = [
    226616, 226569, 226570, 226632, 226608, 226609, 226606, 226607, 226588, 226589,
    229413, 229414, 226561, 226621, 227701, 226571, 226572, 226580, 226559, 226573,
    227489, 227488, 226604, 226605, 226584, 226599, 226600, 226601, 226602, 226574,
    226598, 226597, 226565, 226590, 226591, 226610, 226558, 226592, 226575, 226576,
    226582, 226623, 226624, 226612, 226619, 226620, 226583, 226622, 226564, 226593,
    226595, 226557, 226579, 226567, 226617, 226618, 226563, 226625, 227511, 226603,
    226560, 226613, 226614,
]
# urine has its own table in the hourly view, so these ids are left out there
URINE_ITEMS = [
    226557, 226558, 226559, 226560, 226561, 226563, 226564, 226565, 226567, 226584,
    227488, 227489,
]
HOURLY_OUTPUT_ITEMS = [i for i in DAILY_OUTPUT_ITEMS if i not in URINE_ITEMS]
IRRIGANT_IN_ITEM = 227488
DIALYSIS_ITEMS = [226499, 225806, 225807, 226457]
DIALYSATE_IN_ITEM = 225806

# --- procedure
ECHO_ITEM = 225432

# --- diagnoses
ARREST_CODES = [
    "I4901", "42741", "I472", "4271", "42789", "42613", "4275", "I469", "I468", "I462",
    "I97121", "R001", "I2102", "I2121", "I2101", "I2109", "I2119", "I2129", "I2111",
    "I213", "4260", "I442",
]
CHRONIC_DIALYSIS_CODES = ["Z992", "V4511"]

# --- eligibility
CARDIAC_UNITS = [
    "Coronary Care Unit (CCU)",
    "Cardiac Vascular Intensive Care Unit (CVICU)",
]
CARDIAC_SERVICES = ["CSURG", "CMED"]

# first year of each anchor group
ANCHOR_YEARS = {
    "2008 - 2010": 2008,
    "2011 - 2013": 2011,
    "2014 - 2016": 2014,
    "2017 - 2019": 2017,
}

# race text fragment -> class, first match wins ("unkown" is spelt so in the definition,
# which sends UNKNOWN to "other")
RACE_FRAGMENTS = [
    ("asian", "Asian"),
    ("black", "Black"),
    ("white", "White"),
    ("hispanic", "Hispanic"),
    ("south american", "Hispanic"),
    ("alaska", "American Native"),
    ("pacific", "Native Hawaiian"),
    ("unkown", "Unknown"),
    ("unable", "Unknown"),
    ("declined", "Unknown"),
]

# --- prescriptions
INTRAVENOUS = ["IV DRIP", "IV"]
INFUSION_FREQUENCIES = ["INFUSION", "IV DRIP"]
INFUSION_STRENGTHS = ["100mg/10mL Vial", "2.5mg/10mL Vial"]
DOSE_PATTERN = "^[-]?[0-9]+[.]?[0-9]*$"
NOT_A_DOSE = ["-", "."]

# furosemide equivalents
LOOP_DIURETICS = [
    "Furo", "Furos", "furose", "Furosemi", "Furosemid", "furosemide", "Furosemide",
    "Furosemide ", "Furosemide 100mg/10mL 10mL VIAL", "Furosemide 20mg/2mL 2mL VIAL",
    "Furosemide 40mg/4mL 4mL VIAL", "Furosemide-Heart Failure",
    "Furosemide in 0.9% Sodium Chloride", "Furosemide (Latex Free)",
    "Furosemide Solution", "Lasix", "LaSIX", "torsemide", "Torsemide", "Torsemide ",
]
BUMETANIDE = ["Bume", "Bumet", "Bumeta", "Bumetan", "Bumetanid", "Bumetanide", "bumex"]
ETHACRYNATE = ["Ethacrynate Sodium", "Ethacrynic Acid"]
BUMETANIDE_FACTOR = 20.0
ETHACRYNATE_FACTOR = 0.4

# Rate control.  In the published lists three pairs of names run together, so the joined
# names match nothing; metoCLOPramide is listed among the beta blockers.
RATE_CONTROL_NAMES = [
    "Esmolol", "Esmolol (0.9% NaCl)", "Esmolol in Saline (Iso-osm)Metoprolol",
    "metoCLOPramide", "Metoprolol Tartrate", "metoprolol tartrateDiltia", "Diltiaz",
    "DiltiazemVerapamil", "Verapamil HCl",
]
BETA_BLOCKERS = [
    "Esmolol", "Esmolol (0.9% NaCl)", "Esmolol in Saline (Iso-osm)Metoprolol",
    "metoCLOPramide", "Metoprolol Tartrate", "metoprolol tartrate",
]
CALCIUM_ANTAGONISTS = ["Diltia", "Diltiaz", "Diltiazem", "Verapamil", "Verapamil HCl"]
# the same lists with every name on its own
REPAIRED_BETA_BLOCKERS = [
    "Esmolol", "Esmolol (0.9% NaCl)", "Esmolol in Saline (Iso-osm)", "Metoprolol",
    "metoCLOPramide", "Metoprolol Tartrate", "metoprolol tartrate",
]
REPAIRED_RATE_CONTROL_NAMES = REPAIRED_BETA_BLOCKERS + CALCIUM_ANTAGONISTS

# --- monitoring
MONITOR_MEASURES = [
    "svo2", "pap_d", "pap_s", "pap_m", "pcwp", "co_cont", "co_therm",
    "cardiac_function_index", "picco_ci", "picco_co", "elwi", "gedi", "itbvi",
    "picco_svi", "picco_svri", "picco_svv",
]
VENTILATED = ["Tracheostomy", "InvasiveVent", "NonInvasiveVent"]
DEFAULT_SF_RATIO = 475
