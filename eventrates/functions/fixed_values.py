"""Variable codes, derived-column recipes, category lists, break lists and cutoffs of the standard study.

Every operator takes such values as arguments; these are the defaults the ready-made plans use.
"""

from __future__ import annotations

# Exclusions and recodes of the event table.
EXCLUDED_PROBLEMS = ["Truancy (P)", "Curfew Violations (P)"]
CATEGORY_RECODE = {"East African": "Black", "Latino": "Latinx", "Native American": "Indigenous"}
BOOKED = "BKG-Booking"
EXCLUDED_YEARS = [2016, 2021]
PERIOD_CUTOFF = "2020-05-25"
PARTIAL_MONTHS = ["2016-10"]

# Label in a column name -> category value.
CATEGORY_LABELS = {
    "Asian": "Asian",
    "Black": "Black",
    "Latin": "Latinx",
    "NatAm": "Indigenous",
    "Other": "Other",
    "Unkwn": "Unknown",
    "White": "White",
}
# Category levels of the regression, base first.
MODEL_LEVELS = ["White", "Black", "Latinx", "Indigenous", "Asian", "Other", "Unknown"]

# Areas that touch the boundary but lie outside it.
OUTSIDE_AREAS = [
    "27053020400", "27053021200", "27053021700", "27053021800", "27053022000", "27053022801", "27053022802",
    "27053022901", "27053023100", "27053023600", "27053024700", "27053024901", "27053980000", "27053020102",
    "27053020101", "27053020500",
]

# Break points of the rate classes.
RATE_BREAKS = {
    "NStopsBlackRatePerStratum": [0, 5, 10, 25, 100, 500, 1250],
    "NStopsWhiteRatePerStratum": [0, 5, 10, 25, 100, 500, 1250],
    "NStopsTotalRatePerCapita": [0, 5, 10, 25, 50, 85, 120],
    "NStopsBlackRatePerCapita": [0, 5, 10, 25, 50, 85, 120],
    "NStopsWhiteRatePerCapita": [0, 5, 10, 25, 50, 85, 120],
    "NStopsBlackRatePerCapitaCity": [0, 0.25, 0.5, 0.75, 1, 1.25, 1.5],
    "NStopsWhiteRatePerCapitaCity": [0, 0.25, 0.5, 0.75, 1, 1.25, 1.5],
    "NStopsBlackPSRatePerStratum": [0, 5, 10, 25, 75, 150],
    "NStopsWhitePSRatePerStratum": [0, 5, 10, 25, 75, 150],
    "NStopsBlackPSBSRatePerStratum": [0, 5, 10, 15, 30, 65],
    "NStopsWhitePSBSRatePerStratum": [0, 5, 10, 15, 30, 65],
    "NStopsBlackPSASRatePerStratum": [0, 1, 3, 10, 20, 80],
    "NStopsWhitePSASRatePerStratum": [0, 1, 3, 10, 20, 80],
    "NStopsBlackVSRatePerStratum": [0, 5, 10, 25, 75, 100],
    "NStopsWhiteVSRatePerStratum": [0, 5, 10, 25, 75, 100],
    "NStopsBlackVSBSRatePerStratum": [0, 5, 10, 15, 30, 65],
    "NStopsWhiteVSBSRatePerStratum": [0, 5, 10, 15, 30, 65],
    "NStopsBlackVSASRatePerStratum": [0, 1, 3, 10, 20, 80],
    "NStopsWhiteVSASRatePerStratum": [0, 1, 3, 10, 20, 80],
}
# Break points where each category has its own scale.
OWN_SCALE_BREAKS = {
    "NStopsBlackPSRatePerStratum": [0, 5, 10, 25, 75, 150],
    "NStopsWhitePSRatePerStratum": [0, 0.5, 1, 3, 5, 9],
}

# Age cells of the source table, youngest first; both sexes list the same 23 cells.
AGE_CELLS = [
    "5below", "5_9", "10_14", "15_17", "18_19", "20", "21", "22_24", "25_29", "30_34", "35_39", "40_44", "45_49",
    "50_54", "55_59", "60_61", "62_64", "65_66", "67_69", "70_74", "75_79", "80_84", "85_plus",
]
# Bands as first and last age cell.
TOTAL_AGE_BANDS = {
    "0_14": ("5below", "10_14"),
    "15_19": ("15_17", "18_19"),
    "20_24": ("20", "22_24"),
    "25_34": ("25_29", "30_34"),
    "35_44": ("35_39", "40_44"),
    "45_54": ("45_49", "50_54"),
    "55_64": ("55_59", "62_64"),
    "65plus": ("65_66", "85_plus"),
}
SHARE_AGE_BANDS = {
    "18_24": ("18_19", "22_24"),
    "25_34": ("25_29", "30_34"),
    "35_44": ("35_39", "40_44"),
    "45_54": ("45_49", "50_54"),
    "55_64": ("55_59", "62_64"),
    "65plus": ("65_66", "85_plus"),
}


# Variable name -> source code. "fast" is how the source list spells the women's master's cell.
VARIABLE_CODES = {
    "pop_tot": "B01003_001",
    "pop_male": "B01001_002",
    "pop_female": "B01001_026",
    "race_tot": "B02001_001",
    "race_wht": "B02001_002",
    "race_blk": "B02001_003",
    "hisp_tot": "B03002_001",
    "hisp_no_tot": "B03002_002",
    "hisp_no_wht": "B03002_003",
    "hisp_no_blk": "B03002_004",
    "hisp_no_ind": "B03002_005",
    "hisp_no_asn": "B03002_006",
    "hisp_no_hwn": "B03002_007",
    "hisp_no_oth": "B03002_008",
    "hisp_no_2more": "B03002_009",
    "hisp_no_2more_oth": "B03002_010",
    "hisp_no_2more_nonoth": "B03002_011",
    "hisp_yes_tot": "B03002_012",
    "hisp_yes_wht": "B03002_013",
    "hisp_yes_blk": "B03002_014",
    "hisp_yes_ind": "B03002_015",
    "hisp_yes_asn": "B03002_016",
    "hisp_yes_hwn": "B03002_017",
    "hisp_yes_oth": "B03002_018",
    "hisp_yes_2more": "B03002_019",
    "hisp_yes_2more_oth": "B03002_020",
    "hisp_yes_2more_nonoth": "B03002_021",
    "inc_med": "B06011_001",
    "edu_tot": "B15002_001",
    "edu_tot_m": "B15002_002",
    "edu_tot_m_none": "B15002_003",
    "edu_tot_m_nursery": "B15002_004",
    "edu_tot_m_gr_5_6": "B15002_005",
    "edu_tot_m_gr_7_8": "B15002_006",
    "edu_tot_m_gr_9": "B15002_007",
    "edu_tot_m_gr_10": "B15002_008",
    "edu_tot_m_gr_11": "B15002_009",
    "edu_tot_m_gr_12_nodip": "B15002_010",
    "edu_tot_m_gr_hs_grad": "B15002_011",
    "edu_tot_m_coll_1yrless": "B15002_012",
    "edu_tot_m_coll_1yrmore": "B15002_013",
    "edu_tot_m_assoc": "B15002_014",
    "edu_tot_m_bach": "B15002_015",
    "edu_tot_m_mast": "B15002_016",
    "edu_tot_m_prof": "B15002_017",
    "edu_tot_m_doct": "B15002_018",
    "edu_tot_f": "B15002_019",
    "edu_tot_f_none": "B15002_020",
    "edu_tot_f_nursery": "B15002_021",
    "edu_tot_f_gr_5_6": "B15002_022",
    "edu_tot_f_gr_7_8": "B15002_023",
    "edu_tot_f_gr_9": "B15002_024",
    "edu_tot_f_gr_10": "B15002_025",
    "edu_tot_f_gr_11": "B15002_026",
    "edu_tot_f_gr_12_nodip": "B15002_027",
    "edu_tot_f_gr_hs_grad": "B15002_028",
    "edu_tot_f_coll_1yrless": "B15002_029",
    "edu_tot_f_coll_1yrmore": "B15002_030",
    "edu_tot_f_assoc": "B15002_031",
    "edu_tot_f_bach": "B15002_032",
    "edu_tot_f_fast": "B15002_033",
    "edu_tot_f_prof": "B15002_034",
    "edu_tot_f_doct": "B15002_035",
    "pov": "B17001_002",
    "pov_tot": "B17001_001",
    "unemp1": "C23002A_008",
    "unemp3": "C23002A_021",
    "unemp_tot1": "C23002A_006",
    "unemp_tot3": "C23002A_019",
    "build1": "B25024_007",
    "build2": "B25024_008",
    "build3": "B25024_009",
    "build_tot": "B25024_001",
    "vehicle": "B08141_002",
    "vehicle_tot": "B08141_001",
    "age_tot_m_5below": "B01001_003",
    "age_tot_m_5_9": "B01001_004",
    "age_tot_m_10_14": "B01001_005",
    "age_tot_m_15_17": "B01001_006",
    "age_tot_m_18_19": "B01001_007",
    "age_tot_m_20": "B01001_008",
    "age_tot_m_21": "B01001_009",
    "age_tot_m_22_24": "B01001_010",
    "age_tot_m_25_29": "B01001_011",
    "age_tot_m_30_34": "B01001_012",
    "age_tot_m_35_39": "B01001_013",
    "age_tot_m_40_44": "B01001_014",
    "age_tot_m_45_49": "B01001_015",
    "age_tot_m_50_54": "B01001_016",
    "age_tot_m_55_59": "B01001_017",
    "age_tot_m_60_61": "B01001_018",
    "age_tot_m_62_64": "B01001_019",
    "age_tot_m_65_66": "B01001_020",
    "age_tot_m_67_69": "B01001_021",
    "age_tot_m_70_74": "B01001_022",
    "age_tot_m_75_79": "B01001_023",
    "age_tot_m_80_84": "B01001_024",
    "age_tot_m_85_plus": "B01001_025",
    "age_tot_f_5below": "B01001_027",
    "age_tot_f_5_9": "B01001_028",
    "age_tot_f_10_14": "B01001_029",
    "age_tot_f_15_17": "B01001_030",
    "age_tot_f_18_19": "B01001_031",
    "age_tot_f_20": "B01001_032",
    "age_tot_f_21": "B01001_033",
    "age_tot_f_22_24": "B01001_034",
    "age_tot_f_25_29": "B01001_035",
    "age_tot_f_30_34": "B01001_036",
    "age_tot_f_35_39": "B01001_037",
    "age_tot_f_40_44": "B01001_038",
    "age_tot_f_45_49": "B01001_039",
    "age_tot_f_50_54": "B01001_040",
    "age_tot_f_55_59": "B01001_041",
    "age_tot_f_60_61": "B01001_042",
    "age_tot_f_62_64": "B01001_043",
    "age_tot_f_65_66": "B01001_044",
    "age_tot_f_67_69": "B01001_045",
    "age_tot_f_70_74": "B01001_046",
    "age_tot_f_75_79": "B01001_047",
    "age_tot_f_80_84": "B01001_048",
    "age_tot_f_85_plus": "B01001_049",
    "noHS_num": "B06009_002",
    "noHS_denom": "B06009_001",
    "manageprof_num": "B08124_002",
    "manageprof_denom": "B08124_001",
    "crowd_num1": "B25014_005",
    "crowd_num2": "B25014_006",
    "crowd_num3": "B25014_007",
    "crowd_num4": "B25014_011",
    "crowd_num5": "B25014_012",
    "crowd_num6": "B25014_013",
    "crowd_denom": "B25014_001",
    "pubassist_num": "B19058_002",
    "pubassist_denom": "B19058_001",
    "incunder30_num1": "B19001_002",
    "incunder30_num2": "B19001_003",
    "incunder30_num3": "B19001_004",
    "incunder30_num4": "B19001_005",
    "incunder30_num5": "B19001_006",
    "incunder30_denom": "B19001_001",
}


def age_columns(sexes: str, band: tuple[str, str] | None = None) -> list[str]:
    """Estimate columns of the age cells in a band, for ``"m"``, ``"f"`` or ``"mf"``."""
    first, last = (AGE_CELLS.index(c) for c in band) if band else (0, len(AGE_CELLS) - 1)
    return [f"age_tot_{s}_{c}E" for s in sexes for c in AGE_CELLS[first : last + 1]]


# Derived totals, as sums of columns.
DERIVED_TOTALS = {
    "med_inc": ["inc_medE"],
    "tot_pop": ["pop_totE"],
    "tot_male": ["pop_maleE"],
    "tot_female": ["pop_femaleE"],
    "tot_white": ["hisp_no_whtE", "hisp_yes_whtE"],
    "tot_black": ["hisp_no_blkE", "hisp_yes_blkE"],
    "edu_tot_hs_grad": ["edu_tot_m_gr_hs_gradE", "edu_tot_f_gr_hs_gradE"],
    "edu_tot_bach": ["edu_tot_m_bachE", "edu_tot_f_bachE"],
    **{f"tot_age_{name}": age_columns("mf", band) for name, band in TOTAL_AGE_BANDS.items()},
    "age_tot_mE": age_columns("m"),
    "age_tot_fE": age_columns("f"),
}
# Derived ratios, as numerator and denominator sums.
DERIVED_RATIOS = {
    "pct_male": (["pop_maleE"], ["pop_totE"]),
    "pct_female": (["pop_femaleE"], ["pop_totE"]),
    "pct_white": (["tot_white"], ["hisp_totE"]),
    "pct_black": (["tot_black"], ["hisp_totE"]),
    "pct_highschool": (["edu_tot_hs_grad"], ["edu_totE"]),
    "pct_college": (["edu_tot_bach"], ["edu_totE"]),
    "pct_pov": (["povE"], ["pov_totE"]),
    "pct_unemp": (["unemp1E", "unemp3E"], ["unemp_tot1E", "unemp_tot3E"]),
    "pct_build": (["build1E", "build2E", "build3E"], ["build_totE"]),
    "pct_vehicle": (["vehicleE"], ["vehicle_totE"]),
    **{f"pct_m_{name}": (age_columns("m", band), ["age_tot_mE"]) for name, band in SHARE_AGE_BANDS.items()},
    **{f"pct_f_{name}": (age_columns("f", band), ["age_tot_fE"]) for name, band in SHARE_AGE_BANDS.items()},
    **{f"pct_{name}": (age_columns("mf", band), ["age_tot_mE", "age_tot_fE"]) for name, band in SHARE_AGE_BANDS.items()},
    "pct_noHS": (["noHS_numE"], ["noHS_denomE"]),
    "pct_manageprof": (["manageprof_numE"], ["manageprof_denomE"]),
    "pct_crowd": ([f"crowd_num{i}E" for i in range(1, 7)], ["crowd_denomE"]),
    "pct_pubassist": (["pubassist_numE"], ["pubassist_denomE"]),
    "pct_incunder30": ([f"incunder30_num{i}E" for i in range(1, 6)], ["incunder30_denomE"]),
}
