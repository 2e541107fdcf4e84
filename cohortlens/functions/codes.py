"""Ordinal code lists and seeded keys."""

from pyspark.sql import Column, functions as F

from cohortlens.functions.nulls import first_of

# Credential ranks.
DEGREE_RANK = {"DIPL": 1, "CSC": 2, "CERT": 3}
INTENDED_DEGREE_RANK = {"AA&S": 1, "AAS": 2, "CERT": 3, "CSC": 4}
DEGREE_LEVELS = ["AA&S", "AAS", "CERT", "CSC"]

# College name to short code.
COLLEGE_CODES = {
    "Blue Ridge": "BRCC", "Central Virginia": "CVCC", "Dabney S. Lancaster": "DSLCC", "Danville": "DCC", "Eastern Shore": "ESCC",
    "Germanna": "GCC", "J. Sargeant Reynolds": "JSRCC", "John Tyler": "JTCC", "Lord Fairfax": "LFCC", "Mountain Empire": "MECC",
    "New River": "NRCC", "Northern Virginia": "NVCC", "Patrick Henry": "PHCC", "Paul D. Camp": "PDCCC", "Piedmont Virginia": "PVCC",
    "Rappahannock": "RCC", "Southside Virginia": "SSVCC", "Southwest Virginia": "SWVCC", "Thomas Nelson": "TNCC", "Tidewater": "TCC",
    "Virginia Highlands": "VHCC", "Virginia Western": "VWCC", "Wytheville": "WCC",
}

# Enrolment status to intensity.
STATUS_INTENSITY = {
    "Full-Time": 1.0, "Three-Quarter Time": 0.75, "Half-Time": 0.5, "Less than Half-Time": 0.25,
    "Leave of Absence": 0.0, "Withdrew": 0.0,
}

# Subject code to subject cluster (a subject listed twice keeps its last cluster).
SUBJECT_CLUSTERS = {
    "BUS": [
        "ACC", "BUS", "MKT", "HRI", "FIN", "REA", "ACQ", "CON", "ISR"
    ],
    "ART": [
        "ART", "DAN", "MUS", "HRT", "CRF", "PHT", "IDS", "DEC"
    ],
    "SCI": [
        "BIO", "GOL", "PHY", "NAS", "CHM", "SCT"
    ],
    "EGR": [
        "EGR", "CSC", "ITD", "ITE", "ITN", "ITP", "HIM", "ENE", "GIS", "ENV", "HIT", "ARC", "ETR", "AST", "IND",
        "IST", "DRF", "CAD", "TEL", "MEC", "AMT", "CIV", "INS", "NUC", "UMS", "AVI", "ESR", "NAN", "SIM"
    ],
    "MTH": [
        "MTE", "MTH", "MTT", "MCR", "MDE"
    ],
    "SOC": [
        "EDU", "SOC", "ECO", "GEO", "HIS", "PSY", "PLS", "ADJ", "LGL", "CHD", "SSC", "PBS", "EIP"
    ],
    "MED": [
        "EMS", "NUR", "HLT", "PED", "DMS", "RAD", "EMT", "PNE", "DNA", "SUR", "NSG", "HCT", "DNH", "OCT", "CSP",
        "DIT", "PSG", "PNG", "PTH", "MEN", "MDL", "RTH", "MDA", "OPT", "ROC", "DNL", "OMP", "PBH", "DIA"
    ],
    "HUM": [
        "HUM", "CST", "PHI", "REL", "ENG", "ENF", "EDE", "HMS", "SDV", "SPD", "STD", "SCM", "MET"
    ],
    "FLA": [
        "ASL", "ARA", "FRE", "GER", "JPN", "KOR", "ITA", "LAT", "SPA", "CHI", "ESL", "RUS", "INT", "GRE", "POR",
        "VTN", "HIN"
    ],
    "OCC": [
        "FST", "AGR", "AIR", "ARO", "AUT", "FOR", "FIR", "WEL", "VET", "EQU", "LBR", "BCS", "BLD", "BSK", "COS",
        "VEN", "TRK", "TRV", "PNT", "MSC", "MAR", "MAC", "ELE", "RVH", "RPK", "SAF", "AUB", "DSL", "FNS", "MRT",
        "MTS", "FUR", "GWR", "MIN", "PPT", "HVE", "APL"
    ],
}
OTHER_CLUSTER = "OTH"
CLUSTERS = sorted(SUBJECT_CLUSTERS) + [OTHER_CLUSTER]

# Group labels, the first one is the reference group.
GROUPS = ["white", "afam", "hisp", "asian", "other"]


def subject_cluster(subject: Column) -> Column:
    cases = [(subject.isin(codes), F.lit(name)) for name, codes in SUBJECT_CLUSTERS.items()]
    return first_of(*cases, default=F.lit(OTHER_CLUSTER))


def college_code(college: Column, codes=COLLEGE_CODES) -> Column:
    """Short code of a college; a name that is not listed has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), college)


def degree_rank(degree: Column) -> Column:
    """0 unknown, 1-3 by :data:`DEGREE_RANK`, 4 for any degree with an A in its code."""
    base = first_of(*[(degree == k, v) for k, v in DEGREE_RANK.items()], default=0)
    return F.when(F.coalesce(degree.contains("A"), F.lit(False)), 4).otherwise(base)


def intended_rank(degree: Column) -> Column:
    return first_of(*[(degree == k, v) for k, v in INTENDED_DEGREE_RANK.items()], default=5)


def status_intensity(status: Column) -> Column:
    return first_of(*[(status == k, F.lit(v)) for k, v in STATUS_INTENSITY.items()])


def seeded_key(seed, *ids: Column) -> Column:
    """Deterministic pseudo-random order key; unlike ``rand()`` it does not depend on partitioning."""
    return F.md5(F.concat_ws("#", *[i.cast("string") for i in ids], F.lit(str(seed))))


def missing_code(source_missing: Column, value_missing: Column) -> Column:
    """Composite 0-6 missing code from a 0/1/2 source code and a 0/1 value code."""
    base = source_missing * 2 + value_missing
    return F.when(source_missing == 2, 6).when(source_missing == 1, base + 1).otherwise(base)
