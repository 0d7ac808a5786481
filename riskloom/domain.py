"""Column names, thresholds and lookup tables of the loan-default domain."""

from __future__ import annotations

# Names and thresholds the results depend on.
ID = "SK_ID_CURR"
LABEL = "TARGET"
META_COLUMNS = ("SK_ID_CURR", "TARGET", "SK_ID_BUREAU", "SK_ID_PREV")
EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365.25
SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 5
MISSING_LIMIT = 0.80
BINARY_MAX_UNIQUE = 2
UNKNOWN_CODE = -1
CORRELATION_TOP_N = 30
OUTLIER_QUANTILE = 0.99
TENURE_CLIP_QUANTILE = 0.98
BACKGROUND_ROWS = 500
TOP_FEATURES = 20
TOP_DRIVERS = 5

# Left-closed bins.
AGE_EDGES = [20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70]
TENURE_BANDS = [
    (0, 1, "<1yr"),
    (1, 3, "1-3yr"),
    (3, 5, "3-5yr"),
    (5, 10, "5-10yr"),
    (10, 20, "10-20yr"),
    (20, None, "20+yr"),
]

# Risk bands as (exclusive upper bound, name).
RISK_BANDS = [(0.20, "Low Risk"), (0.50, "Medium Risk"), (None, "High Risk")]

# Insight thresholds.
IMBALANCE_WARNING = 5.0
IMBALANCE_CRITICAL = 10.0
HIGH_MISSING_PCT = 50.0
MODERATE_MISSING_PCT = 10.0
YOUNG_AGE = 30
SENIOR_AGE = 55
SHORT_TENURE = 1
HIGH_CREDIT_INCOME = 3
YOUNG_RISK_FACTOR = 1.25
DOCUMENT_RISK_FACTOR = 1.2
DOCUMENT_MIN_ROWS = 10
SEVERITIES = ("info", "warning", "critical")
EXTERNAL_SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

# Which domain category a column belongs to.
FEATURE_CATALOGUE = {
    "demographic": [
        "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "CNT_CHILDREN", "CNT_FAM_MEMBERS",
        "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "DAYS_BIRTH", "REGION_POPULATION_RELATIVE",
        "REGION_RATING_CLIENT", "REGION_RATING_CLIENT_W_CITY", "REG_REGION_NOT_LIVE_REGION",
        "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION", "REG_CITY_NOT_LIVE_CITY",
        "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY", "ORGANIZATION_TYPE",
        "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE",
    ],
    "financial": [
        "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_CONTRACT_TYPE",
        "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_TYPE_SUITE", "OCCUPATION_TYPE",
        "DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "OWN_CAR_AGE",
        "DAYS_LAST_PHONE_CHANGE",
    ],
    "credit_history": EXTERNAL_SCORES + [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)],
    "behavioural": [
        "DEF_30_CNT_SOCIAL_CIRCLE", "DEF_60_CNT_SOCIAL_CIRCLE", "OBS_30_CNT_SOCIAL_CIRCLE",
        "OBS_60_CNT_SOCIAL_CIRCLE", "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY",
        "AMT_REQ_CREDIT_BUREAU_WEEK", "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT",
        "AMT_REQ_CREDIT_BUREAU_YEAR", "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE",
        "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL",
    ],
}

# Feature-name pattern -> business label. The first pattern found in a name wins.
FEATURE_LABELS = {
    "amt_credit": "credit amount requested",
    "credit_to_income": "credit-to-income ratio",
    "amt_goods_price": "goods price relative to credit",
    "amt_annuity": "loan annuity amount",
    "annuity_to_income": "annuity-to-income ratio",
    "amt_income_total": "total annual income",
    "debt_to_income": "debt-to-income ratio",
    "days_employed": "employment duration",
    "employment_age": "employment-to-age ratio",
    "name_income_type": "income type",
    "organization_type": "employer organisation type",
    "days_birth": "applicant age",
    "code_gender": "applicant gender",
    "cnt_children": "number of dependants",
    "cnt_fam_members": "family size",
    "name_education_type": "education level",
    "name_family_status": "family/marital status",
    "flag_own_car": "vehicle ownership",
    "flag_own_realty": "property ownership",
    "ext_source_1": "external credit score (bureau 1)",
    "ext_source_2": "external credit score (bureau 2)",
    "ext_source_3": "external credit score (bureau 3)",
    "bureau": "bureau credit history",
    "prev_app": "previous loan application history",
    "days_credit": "days since last credit bureau record",
    "credit_active": "active credit lines",
    "amt_credit_sum": "total outstanding credit",
    "amt_credit_sum_debt": "outstanding debt amount",
    "flag_document": "document submission",
    "flag_cont_mobile": "mobile contact availability",
    "flag_email": "email contact availability",
    "region_rating": "regional creditworthiness rating",
    "reg_city_not_work_city": "residence vs. workplace city mismatch",
}

# The random-search space.
SEARCH_SPACE = {
    "num_leaves": [31, 50, 70, 100, 150],
    "max_depth": [-1, 5, 8, 10, 15],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.15],
    "min_child_samples": [20, 50, 100, 200],
    "n_estimators": [200, 400, 600, 800, 1000],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
}
SEARCH_DRAWS = 30
