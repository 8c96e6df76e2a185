"""Names, constants and lookup lists that results must agree on."""

# Class boundaries in months and the classes they open.
CUTPOINTS = [6.0, 12.0, 24.0, 36.0, 48.0, 60.0, 72.0]
N_CLASSES = 8
HORIZON = 72.0

# Repeated cross-validation seeds.
SEEDS = [42, 123, 2024, 31415, 65537]

# Treatment arms in index order, with their lower-case spellings.
ARMS = ["None", "Resection", "TACE", "RFA", "Sorafenib", "Combo"]
ARM_INDEX = {"none": 0, "resection": 1, "tace": 2, "rfa": 3, "sorafenib": 4, "combo": 5}

# Per-class weights of the focal loss.
FOCAL_CLASS_WEIGHTS = [1.0, 1.5, 1.7, 2.1, 2.5, 2.7, 2.3, 4.5]
FOCAL_GAMMA = 1.5

# Canonical column names.
TIME_COL = "overall_survival_months"
EVENT_COL = "event"
LABEL_COL = "survival_class"

# Monitor thresholds and rates.
MONITOR_WINDOW = 30
ERROR_SOFT, ERROR_HARD = 0.18, 0.32
ENTROPY_SOFT, ENTROPY_HARD = 0.65, 0.85
ONLINE_RATE, PROXIMAL_RATE = 5e-3, 1e-2
RESIDUAL_MIX = 0.5

# Weights of the post-hoc explanation report.
LAMBDA_CAL, LAMBDA_EXP, LAMBDA_CLIN, TANH_KAPPA = 0.4, 0.3, 0.2, 5.0

# Scenario sweep gates.
PROPENSITY_GATE = (0.05, 0.95)
GUIDELINE_CUTOFF = 0.30
SCENARIO_DRAWS = 200

# Gradient privacy defaults.
CLIP_NORM, NOISE_MULTIPLIER = 1.0, 1.1

# Curated feature order (67 names).
CURATED = [
    "age", "age_ge_65", "sex_male", "year_of_diagnosis_scaled", "race_asian", "race_other", "diabetes",
    "comorbidity_count", "hbv_positive", "hcv_positive", "nbnc", "cirrhosis", "alcohol_related",
    "antiviral_therapy", "log_afp", "albumin", "bilirubin", "inr", "platelets", "meld", "albi_grade",
    "child_pugh_b_or_c", "alt", "ast", "creatinine", "sodium", "hemoglobin", "neutrophil_lymphocyte_ratio",
    "liver_recovery_score", "tumor_size_cm", "log_tumor_size", "lesion_count", "multifocal",
    "vascular_invasion", "extrahepatic_spread", "ajcc_stage", "stage_i", "stage_ii", "stage_iii", "stage_iv",
    "bclc_stage", "bclc_a", "bclc_b", "bclc_c", "bclc_d", "treatment_no_resection", "treatment_ablation",
    "treatment_resection", "treatment_tace", "treatment_rfa", "treatment_sorafenib", "treatment_combo",
    "radiotherapy", "chemotherapy", "palliative_care", "planned_margin_risk", "transplant", "systemic_agents",
    "ecog", "portal_hypertension", "ascites", "encephalopathy", "tumor_number_gt3", "size_gt5", "afp_gt400",
    "resection_eligible", "comorbidity_count_ge2",
]
EXPLICIT = [f"x_{i:02d}" for i in range(67)]

# Index ranges of the feature blocks and widths of the state blocks.
FEATURE_BLOCKS = {"dem": (0, 8), "hep": (8, 14), "lab": (14, 29), "tum": (29, 45), "trt": (45, 58), "fu": (58, 67)}
STATE_BLOCKS = {"patient": 12, "tumor": 6, "liver": 8, "treatment": 6, "guideline": 4, "explanation": 10}
STATE_WIDTH = 46
# State coordinates that restate the treatment, neutralised in scenarios.
ACTION_DERIVED = (34, 44, 45)
TREATMENT_COORDS = range(26, 32)

# Features tracked in the missingness report, and features whose attribution must not protect.
MISSINGNESS_FOCUS = ["log_afp", "child_pugh_b_or_c"]
RISK_FEATURES = ["log_afp", "tumor_size_cm", "vascular_invasion", "extrahepatic_spread", "stage_iv"]

# Substrings that mark a covariate as assigned with or after treatment.
ASSIGNMENT_TOKENS = [
    "treatment", "therapy", "resection", "ablation", "tace", "rfa", "sorafenib", "chemotherapy", "radiotherapy",
    "surgical_margin", "post_",
]

# Columns of the longitudinal interval table.
LONGITUDINAL_COLUMNS = [
    "patient_id", "start_month", "end_month", "tumor_diameter_start_cm", "tumor_diameter_observed_cm",
    "growth_rate_per_month", "treatment_shrinkage_rate_per_month", "fibrosis_start", "fibrosis_observed",
    "kappa_age_per_month", "kappa_treatment_per_month", "kappa_recovery_per_month", "recovery_score",
    "loco_regional_action",
]
MAX_DIAMETER_CM = 20.0

# Longitudinal rule variants as (tumour rule on, fibrosis rule on).
DYNAMICS = {
    "static_only": (False, False), "gompertz_only": (True, False),
    "fibrosis_only": (False, True), "full_dynamics": (True, True),
}

# Prediction table header required by the audit.
PREDICTION_COLUMNS = [
    "patient_id", "seed", "fold", "true_class", "event", "overall_survival_months", "pred_class",
    "p_c1", "p_c2", "p_c3", "p_c4", "p_c5", "p_c6", "p_c7", "p_c8",
]
AUDIT_SECTIONS = ["locked_external_validation", "censoring_audit", "figure_inputs", "edge_profiling"]

# Fixed values of the freeze manifest: its version, training cohort, scope text, flags and digested contracts.
FREEZE_VERSION = 2
TRAINING_COHORT = "Internal-673"
IMPUTATION_SCOPE = "Internal-673 training partition only"
FREEZE_FLAGS = ["frozen_before_external_access", "preprocessing_frozen", "imputation_frozen", "calibration_frozen", "thresholds_frozen"]
FREEZE_CONTRACTS = ["preprocessing", "imputation", "calibration", "decision"]

# Fixed values of the artifact manifest: its version, status and the artifacts of a fold run.
ARTIFACT_VERSION = 1
ARTIFACT_STATUS = "real_experiment_outputs"
RUN_ARTIFACTS = ["metrics", "predictions", "model"]
METRIC_FIELDS = ["seed", "fold", "macro_f1"]

# Fixed value of the shadow gate.
DEVICE_CLASS = "IMDRF_Class_II"

# What an acceptance review asks for, as (kind, least number of files, whether its lack blocks, globs).
_FIGURES = ["csv", "json", "parquet", "xlsx", "npy", "npz"]
ACCEPTANCE = [
    ("split_manifests", 5, True, [f"{f}/**/splits_seed_*.json" for f in ("outputs", "audit", "artifacts")]),
    ("per_fold_metrics", 25, True, [f"{f}/**/{n}" for f in ("outputs", "audit", "artifacts") for n in ("metrics.json", "*metrics.json")]),
    ("per_fold_predictions", 25, True, ["outputs/**/*prediction*.csv", "outputs/**/*pred*.parquet", "audit/**/*prediction*.csv",
                                        "artifacts/**/*prediction*.csv", "artifacts/**/*pred*.parquet"]),
    ("model_checkpoints", 25, True, ["outputs/**/model.joblib", "outputs/**/*checkpoint*", "audit/**/model.joblib", "audit/**/*model.joblib", "audit/**/*checkpoint*",
                                     "artifacts/**/model.joblib", "artifacts/**/*model.joblib", "artifacts/**/*checkpoint*", "artifacts/**/*.pt", "artifacts/**/*.pth"]),
    ("hashes", 1, True, ["outputs/**/*hash*.json", "audit/**/*hash*", "artifacts/**/*hash*", "artifacts/**/*checksum*"]),
    ("statistical_scripts", 1, True, ["scripts/**/*stat*.py", "scripts/**/*bootstrap*.py", "scripts/**/*mcnemar*.py", "scripts/**/*nadeau*.py",
                                      "audit/**/*stat*.py", "artifacts/**/*stat*.py"]),
    ("figure_inputs", 1, True, [f"figures/**/*.{x}" for x in _FIGURES] + [f"audit/**/figure_inputs/**/*.{x}" for x in _FIGURES[:4]] + ["audit/**/*figure*input*"]
     + [f"artifacts/**/figure_inputs/**/*.{x}" for x in _FIGURES[:4]] + ["artifacts/**/*figure*input*"]),
    ("censoring_audit", 1, True, [f"{f}/**/*{n}*" for f in ("outputs", "audit", "artifacts") for n in ("censor", "ipcw", "60*month")]),
    ("locked_external_validation", 1, True, ["outputs/**/*locked*external*", "outputs/**/*external*validation*", "outputs/**/*transfer*",
                                             "audit/**/*external*validation*", "artifacts/**/*external*validation*", "artifacts/**/*locked*external*"]),
    ("edge_profiling", 1, True, ["outputs/**/*profil*", "outputs/**/*jetson*", "outputs/**/*latency*log*", "outputs/**/*power*", "audit/**/*profil*",
                                 "artifacts/**/*profil*", "artifacts/**/*jetson*", "artifacts/**/*latency*log*"]),
    ("environment_lock", 4, False, ["environment.yml", "requirements.txt", "requirements-lock.txt", "Dockerfile", "artifacts/**/*environment*", "audit/**/*environment*"]),
]
