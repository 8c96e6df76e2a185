"""Curated features, exact imputation and scaling, and the block state projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import ARM_INDEX, CURATED, EXPLICIT, FEATURE_BLOCKS, MISSINGNESS_FOCUS, STATE_BLOCKS, STATE_WIDTH
from cohortry.functions.vectors import clip, total
from cohortry.operators.moments import scale_stats
from cohortry.operators.quantiles import exact_quantiles

# Stage spellings.
STAGE_TEXT = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "a": 1, "b": 2, "c": 3, "d": 4}


def number(df: DataFrame, *names: str, default: float | None = None) -> Column:
    """First of the named columns that exists, read as a number; unreadable cells are null."""
    for name in names:
        if name in df.columns:
            return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))
    return F.lit(default).cast("double")


def flag(df: DataFrame, *names: str) -> Column:
    return clip(number(df, *names), 0.0, 1.0)


def mentions(df: DataFrame, name: str, pattern: str) -> Column:
    """1 where the text matches, 0 where it does not or is null; null when the column is absent."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return F.coalesce(F.lower(F.col(name).cast("string")).rlike(pattern), F.lit(False)).cast("double")


def stage(df: DataFrame, name: str, any_numeric: bool) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    if any_numeric:
        return number(df, name)
    text = F.lower(F.trim(F.col(name).cast("string")))
    value = F.lit(None).cast("double")
    for spelling, n in STAGE_TEXT.items():
        value = F.when(text == spelling, F.lit(float(n))).otherwise(value)
    return value


def curate(df: DataFrame, keep=("row_id",)) -> DataFrame:
    """The 67 named features, each null where its source is missing, as one projection.

    Column-wide facts (a stage column with any number, a hepatitis column with no value) come from one aggregate, run
    only when such a column is present.
    """
    keep = [c for c in keep if c in df.columns]
    if all(c in df.columns for c in EXPLICIT):
        return df.select(*keep, *[number(df, c).alias(c) for c in EXPLICIT])
    probes = {c: F.count(number(df, c)) for c in ("ajcc_stage", "bclc_stage", "nbnc") if c in df.columns}
    facts = df.agg(*[v.alias(k) for k, v in probes.items()]).first().asDict() if probes else {}

    age, ajcc, bclc = number(df, "age", "age_years"), *(stage(df, c, facts.get(c, 0) > 0) for c in ("ajcc_stage", "bclc_stage"))
    hbv, hcv = flag(df, "hbv_positive", "hbv"), flag(df, "hcv_positive", "hcv")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    is_true = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    nbnc = flag(df, "nbnc") if facts.get("nbnc", 0) else ((zero(hbv) == 0) & (zero(hcv) == 0)).cast("double")
    cirrhosis, size = flag(df, "cirrhosis"), number(df, "tumor_size_cm", "tumor_size")
    lesions = number(df, "lesion_count", "tumor_count", default=1.0)
    afp, child = number(df, "afp", "alpha_fetoprotein"), flag(df, "child_pugh_b_or_c", "child_pugh_bc")
    comorbid = number(df, "comorbidity_count")
    surgery = {}
    # the pattern for no resection also matches "unknown"; kept so results agree
    for name, pattern in (("no_resection", "none|no"), ("ablation", "ablation|rfa"), ("resection", "resection")):
        own = flag(df, f"treatment_{name}")
        surgery[name] = F.coalesce(own, mentions(df, "surgical_strategy", pattern)) if "surgical_strategy" in df.columns else own
    recovery = clip(F.lit(1.0) - F.lit(0.01) * clip(age - 50, 0.0, float("inf")) - F.lit(0.2) * zero(cirrhosis), 0.0, 1.0)
    known = ajcc.isNotNull() & child.isNotNull() & size.isNotNull()
    values = {
        "age": age, "age_ge_65": is_true(age >= 65), "sex_male": flag(df, "sex_male", "male"),
        "year_of_diagnosis_scaled": (number(df, "year_of_diagnosis", "diagnosis_year") - 2008) / F.lit(14.0),
        "race_asian": mentions(df, "race", "asian"), "race_other": mentions(df, "race", "other|black|white|unknown"),
        "comorbidity_count": comorbid, "hbv_positive": hbv, "hcv_positive": hcv, "nbnc": nbnc, "cirrhosis": cirrhosis,
        "alcohol_related": flag(df, "alcohol_related", "alcohol_use"),
        "log_afp": F.when(afp.isNotNull(), F.log1p(F.greatest(afp, F.lit(0.0)))),
        "platelets": number(df, "platelets", "platelet"), "child_pugh_b_or_c": child,
        "neutrophil_lymphocyte_ratio": number(df, "neutrophil_lymphocyte_ratio", "nlr"),
        "liver_recovery_score": recovery, "tumor_size_cm": size,
        "log_tumor_size": F.when(size.isNotNull(), F.log1p(F.greatest(size, F.lit(0.0)))), "lesion_count": lesions,
        "ajcc_stage": ajcc, "bclc_stage": bclc,
        "planned_margin_risk": flag(df, "planned_margin_risk", "anticipated_margin_risk"),
        "ecog": number(df, "ecog", "ecog_status"), "tumor_number_gt3": is_true(lesions > 3), "size_gt5": is_true(size > 5),
        "afp_gt400": (afp > 400).cast("double"),
        "resection_eligible": F.when(known, ((ajcc <= 2) & (child == 0) & (size <= 5)).cast("double")),
        "comorbidity_count_ge2": (comorbid >= 2).cast("double"),
        **{f"stage_{s}": is_true(ajcc == n) for s, n in (("i", 1), ("ii", 2), ("iii", 3), ("iv", 4))},
        **{f"bclc_{s}": is_true(bclc == n) for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4))},
        **{f"treatment_{k}": v for k, v in surgery.items()},
    }
    plain = {"albumin", "bilirubin", "inr", "meld", "albi_grade", "alt", "ast", "creatinine", "sodium", "hemoglobin"}
    for name in CURATED:
        if name not in values:
            values[name] = number(df, name) if name in plain else flag(df, name)
    return df.select(*keep, *[values[n].alias(n) for n in CURATED])


@dataclass
class Preprocessor:
    """Medians, means and deviations fitted once and applied as literals."""

    names: list[str]
    medians: list[float]
    mean: list[float]
    scale: list[float]

    def imputed(self, curated: DataFrame, keep=("row_id",)) -> DataFrame:
        keep = [c for c in keep if c in curated.columns]
        have = set(curated.columns)
        return curated.select(*keep, *[
            F.coalesce(F.col(n) if n in have else F.lit(None).cast("double"), F.lit(m)).alias(n)
            for n, m in zip(self.names, self.medians)])

    def scaled(self, curated: DataFrame, keep=("row_id",)) -> DataFrame:
        filled = self.imputed(curated, keep)
        keep = [c for c in keep if c in filled.columns]
        return filled.select(*keep, *[((F.col(n) - F.lit(m)) / F.lit(s)).alias(n)
                                      for n, m, s in zip(self.names, self.mean, self.scale)])

    def stats_rows(self) -> list[tuple]:
        return [(i, n, float(a), float(b), float(c)) for i, (n, a, b, c) in enumerate(zip(self.names, self.medians, self.mean, self.scale))]


def fit_preprocessor(curated: DataFrame, names=None) -> Preprocessor:
    """Exact medians, then mean and population deviation of the filled columns in one aggregate."""
    names = list(names or [c for c in curated.columns if c in set(CURATED) | set(EXPLICIT)])
    found = {r["name"]: r["value"] for r in exact_quantiles(curated, names, [0.5]).collect()}
    medians = [0.0 if found[n] is None else float(found[n]) for n in names]
    filled = curated.select(*[F.coalesce(F.col(n), F.lit(m)).alias(n) for n, m in zip(names, medians)])
    mean, scale = scale_stats(filled, names)
    return Preprocessor(names, medians, mean, scale)


def missing_flags(curated: DataFrame, names=CURATED, keep=("row_id",)) -> DataFrame:
    have = set(curated.columns)
    keep = [c for c in keep if c in have]
    return curated.select(*keep, *[
        (F.col(n).isNull().cast("int") if n in have else F.lit(1)).alias(f"{n}__missing") for n in names])


def missing_summary(flags: DataFrame) -> DataFrame:
    """Count and rate per indicator in long form, with the audited pair marked."""
    names = [c for c in flags.columns if c.endswith("__missing")]
    sums = flags.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    focus = [f"{n}__missing" for n in MISSINGNESS_FOCUS]
    return sums.unpivot("n", names, "indicator", "missing").select(
        "indicator", F.col("missing").cast("bigint").alias("missing"), (F.col("missing") / F.col("n")).alias("rate"),
        F.col("indicator").isin(focus).alias("audited"))


def observed_actions(df: DataFrame, *, action: str = "index_treatment_action", row_id: str = "row_id", out: str = "arm",
                     check: bool = True) -> DataFrame:
    """Adds the arm index of the recorded action; unrecognised or contradicted rows raise with their first five ids."""
    if action not in df.columns:
        raise ValueError(f"the recorded action column {action!r} is required")
    text = lambda name: F.lower(F.trim(F.col(name).cast("string")))

    def index_of(value: Column) -> Column:
        found = F.lit(None).cast("int")
        for name, i in ARM_INDEX.items():
            found = F.when(value == name, F.lit(i)).otherwise(found)
        return found

    arm = index_of(text(action))
    # Spellings that say nothing, and the arms each legacy entry permits.
    blank = ["", "unknown", "nan", "na", "n/a", "not recorded"]
    strategies = {"none": [0, 2, 4, 5], "no resection": [0, 2, 4, 5], "ablation": [3, 5], "rfa": [3, 5], "resection": [1, 5],
                  "tace": [2, 5], "sorafenib": [4, 5], "combo": [5], "combination": [5]}
    flags = {"treatment_no_resection": [0, 2, 3, 4, 5], "treatment_resection": [1, 5], "treatment_tace": [2, 5],
             "treatment_ablation": [3, 5], "treatment_rfa": [3, 5], "treatment_sorafenib": [4, 5], "treatment_combo": [5]}
    conflict = F.lit(False)
    for name in ("index_treatment_action", "recorded_pretreatment_action"):
        if name in df.columns and name != action:
            told = text(name).isNotNull() & ~text(name).isin(blank)
            conflict = conflict | F.coalesce(told & ~F.coalesce(index_of(text(name)) == arm, F.lit(False)), F.lit(False))
    if "surgical_strategy" in df.columns and action != "surgical_strategy":
        said = text("surgical_strategy")
        allowed = F.lit(False)
        for name, arms in strategies.items():
            allowed = allowed | ((said == name) & arm.isin(arms))
        conflict = conflict | F.coalesce(said.isNotNull() & ~said.isin(blank) & ~allowed, F.lit(False))
    for name, arms in flags.items():
        if name in df.columns:
            conflict = conflict | (F.coalesce(number(df, name), F.lit(0.0)) > 0) & ~arm.isin(arms)
    out_df = df.withColumn(out, arm)
    if check:
        fault = F.when(arm.isNull(), F.lit("unrecognised")).when(conflict, F.lit("contradicted"))
        bad = df.select(row_id, fault.alias("fault")).where(F.col("fault").isNotNull()).limit(5).collect()
        if bad:
            raise ValueError("recorded actions are unusable: " + ", ".join(f"{r[0]} {r['fault']}" for r in bad))
    return out_df


def chunk_bounds(length: int, width: int) -> list[tuple[int, int]]:
    """Contiguous chunks, the first ``length mod width`` of them one longer."""
    small, longer = divmod(length, width)
    edges = [i * small + min(i, longer) for i in range(width + 1)]
    return list(zip(edges, edges[1:]))


def resize(values: list[Column], width: int) -> list[Column]:
    """Wider blocks are averaged in chunks, narrower ones repeated and cut, empty ones zero."""
    if len(values) == width:
        return list(values)
    if not values:
        return [F.lit(0.0)] * width
    if len(values) > width:
        return [total(values[a:b]) / float(b - a) for a, b in chunk_bounds(len(values), width)]
    return [values[i % len(values)] for i in range(width)]


def project_state(scaled: DataFrame, names=CURATED, keep=("row_id",)) -> DataFrame:
    """Unscaled 46-wide state as columns s0..s45, in two projections."""
    names = list(names)
    block = {b: [F.col(n) for n in names[lo:hi]] for b, (lo, hi) in FEATURE_BLOCKS.items()}
    keep = [c for c in keep if c in scaled.columns]
    tumor, liver, treat = resize(block["tum"], 5), resize(block["lab"], 7), resize(block["trt"], 6)
    patient = [*resize(block["dem"], 4), *resize(block["hep"], 2), *resize(block["tum"], 3), *resize(block["lab"], 3)]
    follow = resize(block["fu"], 4)
    base = scaled.select(*keep, *[c.alias(f"{p}{i}") for p, cs in
                                  (("a", patient), ("b", tumor), ("c", liver), ("d", treat), ("e", follow)) for i, c in enumerate(cs)])
    grab = lambda p, n: [F.col(f"{p}{i}") for i in range(n)]
    t, l, d = grab("b", 5), grab("c", 7), grab("d", 6)
    liver_mean = total(l) / 7.0
    guideline = [F.tanh(t[0] - l[0]), F.tanh(liver_mean), F.tanh(total(d[1:])), F.lit(1.0)]
    explanation = [*grab("e", 4), F.abs(t[0]), F.abs(t[1]), F.abs(l[0]), F.abs(l[1]), d[0], d[1]]
    state = [*grab("a", 12), *t, F.sqrt(total(x * x for x in t)), *l, liver_mean, *d, *guideline, *explanation]
    assert len(state) == STATE_WIDTH
    return base.select(*keep, *[s.alias(f"s{i}") for i, s in enumerate(state)])


STATE_COLUMNS = [f"s{i}" for i in range(STATE_WIDTH)]


def scale_state(state: DataFrame, stats=None, *, disabled_blocks=(), keep=("row_id",)) -> tuple[DataFrame, tuple]:
    """Standardise the state with given or freshly fitted statistics, zero disabled blocks, pack as array ``state``."""
    mean, scale = stats or scale_stats(state, STATE_COLUMNS)
    mask = block_mask(disabled_blocks)
    keep = [c for c in keep if c in state.columns]
    cells = [(F.col(c) - F.lit(m)) / F.lit(s) if on else F.lit(0.0) for c, m, s, on in zip(STATE_COLUMNS, mean, scale, mask)]
    return state.select(*keep, F.array(*cells).alias("state")), (mean, scale)


def block_mask(disabled_blocks=()) -> list[int]:
    unknown = set(disabled_blocks) - set(STATE_BLOCKS)
    if unknown:
        raise ValueError(f"unknown state blocks: {sorted(unknown)}")
    return [0 if b in disabled_blocks else 1 for b, width in STATE_BLOCKS.items() for _ in range(width)]


def inference_frame(df: DataFrame, *, time: str, event: str, label: str) -> DataFrame:
    """Rows without their outcome columns."""
    return df.drop(time, event, label)
