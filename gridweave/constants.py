"""Fixed values of the domain: codes, bands and thresholds that results depend on."""

# Fixed values.
SEED = 42
TRAIN_MAX = "202603"
DWELL_CODES = ["000", "030", "060", "120", "180", "240"]
TIME_BINS = ["00"] + [f"{h:02d}" for h in range(6, 24)]
SEXES = ["M", "F"]
LIVING_BANDS = ["0_9", "10_14", "15_19", "20_24", "25_29", "30_34", "35_39", "40_44", "45_49", "50_54", "55_59", "60_64", "65_69", "70_over"]
STAY_BANDS = ["00_09", "10_19", "20_29", "30_39", "40_49", "50_59", "60_69", "70_over"]
TEN_YEAR_BANDS = {
    "00": ["0_9"],
    "10": ["10_14", "15_19"],
    "20": ["20_24", "25_29"],
    "30": ["30_34", "35_39"],
    "40": ["40_44", "45_49"],
    "50": ["50_54", "55_59"],
    "60": ["60_64", "65_69"],
    "70": ["70_over"],
}
MASK_TOKENS = ["*", ""]
ZERO_REPLACEMENT = 1e-3
DAY_BINS = ["10", "11", "12", "13", "14", "15", "16"]
NIGHT_BINS = ["00", "22", "23"]
GRID_X0, GRID_Y0, GRID_STEP = 936375.0, 1937125.0, 250.0
AM_HOURS, PM_HOURS = [7, 8, 9], [18, 19, 20]
REGIMES = ["low_density", "activity_A", "dense_mixed", "activity_B", "residential", "mid_density"]
ACTIVITY = ["activity_A", "activity_B"]
STRUCTURAL = "structural_missing"
TIERS = ["도심", "광역중심", "지역중심", "지구중심"]
UNIVERSE_THRESHOLD = 50

MIX = [f"mix_{s}{b}" for s in SEXES for b in TEN_YEAR_BANDS]
DWELL = [f"dwell_share_{c}" for c in DWELL_CODES]
FEATURES = ["presence_log_z", "stay_vol_log_z", *(f"clr_{c}_z" for c in MIX), *(f"clr_{c}_z" for c in DWELL), "dwell_missing", "mix_missing"]
