"""SQL answers to the registered queries, for the results SQL can express."""

from __future__ import annotations

from cohortry.fixed import CURATED, RISK_FEATURES
from cohortry.functions.hashing import POISSON_ONE
from cohortry.plans.oracle_views import STATE, cls, sql, u
from cohortry.plans.queries import BETA, NAMES

CUTS = [6, 12, 24, 36, 48, 60, 72]
ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, doubles: str = "", **extra: str) -> None:
    ORACLES[name] = sql(body, doubles, extra)


def listed(prefix: str, n: int, start: int = 0) -> str:
    return " ".join(f"{prefix}{i}" for i in range(start, start + n))


P_COLUMNS = listed("p_c", 8, 1)


def unpack(array: str) -> str:
    return ", ".join(f"{array}[{k + 1}] AS p_c{k + 1}" for k in range(8))


def argmax(p: str) -> str:
    return f"(list_position({p}, list_max({p}))-1)"


def risk(p: str) -> str:
    return "-(" + "+".join(f"{k}*{p}[{k + 1}]" for k in range(8)) + ")"


def square_error(p: str, y: str = "label") -> str:
    return "(" + "+".join(f"pow({p}[{k + 1}]-({y}={k})::INT,2)" for k in range(8)) + ")"


def residual(p: str, y: str = "label") -> str:
    return f"(1-{p}[{y}+1]+0.5::DOUBLE*{square_error(p, y)})"


def rank(p: str, y: str = "label") -> str:
    return "(1+" + "+".join(f"({p}[{k + 1}]>{p}[{y}+1] OR ({p}[{k + 1}]={p}[{y}+1] AND {k}<{y}))::INT" for k in range(8)) + ")"


def multiplicity(word: str) -> str:
    return "(" + "+".join(f"({word}>={c!r}::DOUBLE)::INT" for c in POISSON_ONE) + ")"


def draws(source: str, unit: str, replicates: int) -> str:
    """Rows of the source crossed with the replicates that drew them."""
    word = f"(('0x'||substr(md5(concat('boot|42|', b, '|', {unit})), 1+8*j, 8))::BIGINT/4294967296.0::DOUBLE)"
    counts = f"""SELECT unit, 4*b+j AS rep, {multiplicity('u')} AS w FROM (SELECT {unit} AS unit, b, j, {word} AS u
      FROM (SELECT DISTINCT {unit} FROM {source}) CROSS JOIN (SELECT unnest(range({(replicates + 3) // 4})) AS b) CROSS JOIN (SELECT unnest(range(4)) AS j))"""
    return f"SELECT s.*, rep, w FROM {source} s JOIN ({counts}) d ON s.{unit}=d.unit WHERE w>0 AND rep<{replicates}"


# sources and contracts
oracle("validated_cohort", "SELECT row_id, t, event::BIGINT AS event, label::BIGINT AS label, 'unknown' AS surgical_strategy, 'unknown' AS dominant_aetiology FROM labelled", "t")
oracle("contract_faults", "SELECT count(*) AS rows, 0::BIGINT AS bad_time, 0::BIGINT AS bad_event, count_if(event=0 AND t<72)::BIGINT AS immature FROM cohort")
oracle("survival_class", "SELECT row_id, cls::BIGINT AS cls FROM labelled")
oracle("normalised_labels", "SELECT row_id, cls::BIGINT AS numeric_label, cls::BIGINT AS text_label FROM labelled")
oracle("mature_labels", "SELECT row_id, label::BIGINT AS label FROM labelled")
oracle("cohort_report", "SELECT count(*) AS rows, avg(event) AS event_rate, min(t) AS min_time, max(t) AS max_time, count_if(label IS NULL)::BIGINT AS unlabelled, "
       + ", ".join(f"count_if(label={k})::BIGINT AS class_{k}" for k in range(8)) + ", 3::BIGINT AS columns FROM labelled", "event_rate min_time max_time")
oracle("contract_row_digests", """SELECT c_custkey, sha256('{"c_custkey":'||c_custkey||',"c_mktsegment":"'||c_mktsegment||'","c_name":"'||c_name||'","c_nationkey":'||c_nationkey||'}') AS digest FROM customer""")
oracle("run_gaps", """SELECT coalesce(e.seed, f.seed)::BIGINT AS seed, coalesce(e.fold, f.fold)::BIGINT AS fold, coalesce(runs, 0)::BIGINT AS runs,
  CASE WHEN e.seed IS NULL THEN 'extra' WHEN f.seed IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM (SELECT s AS seed, k AS fold FROM (SELECT unnest([42,123,2024,31415,65537]) AS s) CROSS JOIN (SELECT unnest(range(5)) AS k)) e
  FULL JOIN (SELECT ([42,123,2024,31415,65537])[arm+1] AS seed, patient_id%6 AS fold, count(*) AS runs FROM cohort GROUP BY ALL) f
  ON e.seed=f.seed AND e.fold=f.fold WHERE NOT (f.seed=42 AND f.fold=0) OR f.seed IS NULL
  UNION ALL SELECT 42, 0, 0, 'missing'""")
oracle("prediction_table", f"""SELECT patient_id::VARCHAR AS patient_id, 42::BIGINT AS seed, floor({u('fold|42', 'patient_id')}*5)::BIGINT AS fold, row_id, label::BIGINT AS true_class,
  event::BIGINT AS event, t AS overall_survival_months, {argmax('p')}::BIGINT AS pred_class, {unpack('p')},
  """ + ", ".join(f"1/(1+exp(-({-2.0 + 0.3 * i!r}::DOUBLE+0.2::DOUBLE*x1-0.1::DOUBLE*x2))) AS hazard_{a}_{b}m" for i, (a, b) in enumerate(zip([0, *CUTS], CUTS))) + " FROM predictions",
       "overall_survival_months " + P_COLUMNS + " " + " ".join(f"hazard_{a}_{b}m" for a, b in zip([0, *CUTS], CUTS)))

SEEDED = "SELECT p.*, s.seed, floor((('0x'||substr(md5(concat('fold|', seed, '|', patient_id)),1,8))::BIGINT/4294967296.0::DOUBLE)*5)::INT AS fold FROM predictions p CROSS JOIN (SELECT unnest([42,123,2024,31415,65537]) AS seed) s WHERE label IS NOT NULL"
oracle("metric_summary", """SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS runs FROM fold_scores GROUP BY metric""", "mean std",
       seeded=SEEDED, fold_scores=f"""UNPIVOT (SELECT seed, fold, {', '.join(f"avg(({rank('p')}<={k})::INT::DOUBLE) AS top{k}_accuracy" for k in (1, 2, 3))}, avg({square_error('p')})/8 AS brier
         FROM seeded GROUP BY seed, fold) ON top1_accuracy, top2_accuracy, top3_accuracy, brier INTO NAME metric VALUE value""")
oracle("freeze_contract_digests", """SELECT feature, sha256('{"feature":"'||feature||'","mean":"'||m::DECIMAL(18,6)||'","scale":"'||s::DECIMAL(18,6)||'"}') AS digest FROM (
  SELECT 'x1' AS feature, avg(x1) AS m, stddev_pop(x1) AS s FROM cohort UNION ALL SELECT 'x2', avg(x2), stddev_pop(x2) FROM cohort)""")

# features
oracle("curated_features", "SELECT * FROM curated", " ".join(CURATED))
oracle("imputer_scaler_stats", " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS place, '{n}' AS feature, coalesce((SELECT median({n}) FROM curated), 0)::DOUBLE AS median, avg({n}) AS mean, CASE WHEN stddev_pop({n})>1e-12 THEN stddev_pop({n}) ELSE 1 END AS scale FROM imputed"
    for i, n in enumerate(CURATED)), "median mean scale")
oracle("missingness_summary", " UNION ALL ".join(
    f"SELECT '{n}__missing' AS indicator, count_if({n} IS NULL)::BIGINT AS missing, count_if({n} IS NULL)/count(*) AS rate, {str(n in ('log_afp', 'child_pugh_b_or_c')).lower()} AS audited FROM curated" for n in CURATED), "rate")
oracle("observed_actions", "SELECT row_id, arm::BIGINT AS arm FROM acted")
oracle("state_vector", "SELECT * FROM state", " ".join(STATE))
MASKED = set(range(12, 18)) | set(range(32, 36))
oracle("masked_state", " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS coordinate, 0e0 AS mean_abs" if i in MASKED else f"SELECT {i}::BIGINT AS coordinate, avg(abs(s{i})) AS mean_abs FROM state" for i in range(46)), "mean_abs")
oracle("inference_frame", "SELECT row_id, patient_id, arm::BIGINT AS arm, x1*1e5 AS x1, x2*1e4 AS x2 FROM cohort", "x1 x2")

# survival
oracle("horizon_outcome", "SELECT row_id, ((event=1 AND t<=24) OR t>=24) AS observed, (t>24)::BIGINT AS outcome FROM cohort")
ARM_STEPS = "SELECT arm, t, sum(count(*)) OVER (PARTITION BY arm ORDER BY t DESC)::BIGINT AS at_risk, sum(event)::BIGINT AS deaths, sum(1-event)::BIGINT AS censored FROM cohort GROUP BY arm, t"
oracle("life_table_by_arm", "SELECT * FROM arm_steps", "t", arm_steps=ARM_STEPS)
oracle("survival_by_arm", "SELECT arm::BIGINT AS arm, t, at_risk, deaths, product(1-deaths::DOUBLE/at_risk) OVER (PARTITION BY arm ORDER BY t) AS survival FROM arm_steps", "t survival", arm_steps=ARM_STEPS)
oracle("censoring_survival", "SELECT row_id, greatest(g_at, 0.001::DOUBLE) AS g FROM cohort JOIN curve USING (t)", "g")
oracle("censoring_survival_before", "SELECT row_id, g_before FROM cohort JOIN curve USING (t)", "g_before")
oracle("reverse_km_lookup", "SELECT row_id, coalesce(g_at, 1) AS g FROM (SELECT row_id, x1*20 AS t FROM cohort) q ASOF LEFT JOIN curve c ON q.t>=c.t", "g")
oracle("reverse_km_left_lookup", "SELECT row_id, coalesce(g_at, 1) AS g FROM (SELECT row_id, x1*20 AS t FROM cohort) q ASOF LEFT JOIN curve c ON q.t>c.t", "g")
oracle("risk_table", " UNION ALL ".join(
    [f"SELECT {i}::BIGINT AS interval, {a}::DOUBLE AS start_month, {b}::DOUBLE AS stop_month, count_if(t>={a})::BIGINT AS risk_set, count_if(event=1 AND t>={a} AND t<{b})::BIGINT AS events, count_if(event=0 AND t>={a} AND t<{b})::BIGINT AS censored, NULL::BIGINT AS administrative_censoring_at_horizon, NULL::BIGINT AS observed_events_after_horizon FROM cohort"
     for i, (a, b) in enumerate(zip([0, *CUTS], CUTS))]
    + ["SELECT 7, 72, NULL, count_if(t>=72)::BIGINT, 0, count_if(t>=72)::BIGINT, count_if(t>=72)::BIGINT, count_if(t>=72 AND event=1)::BIGINT FROM cohort"]))
CELLS = f"""SELECT c.*, k AS interval, ({CUTS})[k+1] AS stop, CASE WHEN k=0 THEN 0 ELSE ({CUTS})[k] END AS start, CASE WHEN event=1 AND n<7 THEN n ELSE -1 END AS event_interval,
  CASE WHEN event=0 THEN least(n, 6) ELSE -1 END AS censor_interval FROM (SELECT *, {cls()} AS n FROM cohort) c CROSS JOIN (SELECT unnest(range(7)) AS k)"""
LIK = "CASE WHEN event_interval>=0 THEN interval<=event_interval ELSE stop<=t END"
oracle("person_period_cells", f"SELECT row_id, event_interval::BIGINT AS event_interval, censor_interval::BIGINT AS censor_interval, interval::BIGINT AS interval, (event_interval=interval)::BIGINT AS target, ({LIK})::BIGINT AS in_lik, (t>=start)::BIGINT AS at_risk FROM cells", cells=CELLS)
BOUND = "SELECT b.stop, coalesce((SELECT arg_max(g_at, t) FROM curve WHERE t<=b.stop), 1) AS g FROM (SELECT unnest([6,12,24,36,48,60,72]) AS stop) b"
WEIGHTED = f"""SELECT c.*, (event_interval=interval)::INT AS target, ({LIK}) AS lik, CASE WHEN event_interval=interval THEN 1/greatest(k.g_at, 0.001::DOUBLE) WHEN {LIK} THEN 1/greatest(b.g, 0.001::DOUBLE) ELSE 0 END AS cell_weight
  FROM cells c JOIN curve k USING (t) JOIN bounds b USING (stop)"""
oracle("cell_weights", "SELECT row_id, interval::BIGINT AS interval, cell_weight FROM weighted", "cell_weight", cells=CELLS, bounds=BOUND, weighted=WEIGHTED)
oracle("discrete_nll", """SELECT sum(CASE WHEN lik THEN bce*cell_weight ELSE 0 END)/count(DISTINCT CASE WHEN lik THEN row_id END) AS weighted_mean, sum(CASE WHEN lik THEN bce ELSE 0 END) AS plain_sum
  FROM (SELECT *, greatest(z,0)-z*target+ln(1+exp(-abs(z))) AS bce FROM (SELECT *, -2e0+0.3::DOUBLE*interval+0.2::DOUBLE*x1-0.1::DOUBLE*x2 AS z FROM weighted))""", "weighted_mean plain_sum", cells=CELLS, bounds=BOUND, weighted=WEIGHTED)


def hazard_chain() -> str:
    parts, stay = [], "1"
    for k in range(7):
        parts.append(f"{stay}*h{k}")
        stay += f"*(1-h{k})"
    return ", ".join(f"{x} AS q{i}" for i, x in enumerate([*parts, stay]))


oracle("hazard_probabilities", "SELECT row_id, " + ", ".join(f"q{k}/s AS p_c{k + 1}" for k in range(8)) + " FROM (SELECT *, " + "+".join(f"q{k}" for k in range(8)) + f" AS s FROM (SELECT row_id, {hazard_chain()} FROM hz))", P_COLUMNS,
       hz="SELECT row_id, " + ", ".join(f"least(1-1e-7, greatest(1e-7, 1/(1+exp(-({-2.0 + 0.3 * k!r}::DOUBLE+0.2::DOUBLE*x1-0.1::DOUBLE*x2))))) AS h{k}" for k in range(7)) + " FROM cohort")
SCORED = "SELECT *, 0.2::DOUBLE*x1-0.3::DOUBLE*x2 AS s FROM cohort"
SUMS = "SELECT t, sum(event) AS deaths, sum(event*s) AS score, sum(sum(exp(s))) OVER (ORDER BY t DESC) AS q FROM scored_rows GROUP BY t"
HAZARD = "SELECT t, deaths::BIGINT AS deaths, deaths/q AS increment, sum(deaths/q) OVER (ORDER BY t) AS cumulative_hazard FROM sums_by_time WHERE deaths>0"
oracle("partial_likelihood", "SELECT sum(deaths*ln(q)-score) AS neg_log_partial_likelihood FROM sums_by_time WHERE deaths>0", "neg_log_partial_likelihood", scored_rows=SCORED, sums_by_time=SUMS)
oracle("baseline_hazard", "SELECT * FROM hazard_steps", "t increment cumulative_hazard", scored_rows=SCORED, sums_by_time=SUMS, hazard_steps=HAZARD)
oracle("cox_scoring", "SELECT row_id, l AS log_hazard, exp(l) AS relative_hazard FROM (SELECT row_id, (x1-avg(x1) OVER ())/stddev_pop(x1) OVER ()*0.25::DOUBLE-(x2-avg(x2) OVER ())/stddev_pop(x2) OVER ()*0.4::DOUBLE AS l FROM cohort)", "log_hazard relative_hazard")
oracle("cox_class_probabilities", "SELECT row_id, " + ", ".join(f"q{k}/(" + "+".join(f"q{j}" for j in range(8)) + f") AS p_c{k + 1}" for k in range(8)) + " FROM (SELECT row_id, 1-v1 AS q0, "
       + ", ".join(f"greatest(v{k}-v{k + 1},0) AS q{k}" for k in range(1, 7)) + ", v7 AS q7 FROM (SELECT row_id, " + ", ".join(f"exp(-exp(s)*h{k + 1}) AS v{k + 1}" for k in range(7))
       + " FROM scored_rows CROSS JOIN (SELECT " + ", ".join(f"coalesce(max(cumulative_hazard) FILTER (WHERE t<={c}),0) AS h{k + 1}" for k, c in enumerate(CUTS)) + " FROM hazard_steps)))", P_COLUMNS,
       scored_rows=SCORED, sums_by_time=SUMS, hazard_steps=HAZARD)


def rmst(keys: str, steps: str, tau: int) -> str:
    return f"""SELECT {keys}, sum(width*height) AS rmst FROM (SELECT {keys}, coalesce(lag(s) OVER w, 1) AS height, t-coalesce(lag(t) OVER w, 0) AS width FROM (
      SELECT {keys}, least(t, {tau}) AS t, s FROM (SELECT {keys}, t, product(greatest(1-d/r, 0)) OVER (PARTITION BY {keys} ORDER BY t) AS s FROM {steps}) WHERE t<{tau}
      UNION ALL SELECT DISTINCT {keys}, {tau}, 0 FROM {steps}) WINDOW w AS (PARTITION BY {keys} ORDER BY t)) GROUP BY {keys}"""


oracle("weighted_rmst_by_arm", "SELECT arm::BIGINT AS arm, rmst FROM (" + rmst("arm", "wsteps", 24) + ")", "rmst",
       wsteps=f"SELECT arm, t, sum(w*event) AS d, sum(sum(w)) OVER (PARTITION BY arm ORDER BY t DESC) AS r FROM (SELECT *, 0.5::DOUBLE+{u('w', 'row_id')} AS w FROM cohort) GROUP BY arm, t")
FOLDED = f"SELECT *, floor({u('fold|42', 'patient_id')}*5)::INT AS fold FROM predictions"
oracle("residual_weights", """SELECT row_id, v/avg(v) OVER () AS weight FROM (SELECT row_id, CASE WHEN raw IS NULL THEN 1e-6 ELSE least(4, greatest(0.25::DOUBLE, raw)) END AS v FROM (
  SELECT row_id, CASE WHEN event=1 OR t>=72 THEN (1+coalesce(r.r, (SELECT avg(residual) FROM val)))/greatest(CASE WHEN t<72 THEN g_before ELSE (SELECT coalesce(arg_max(g_at, t), 1) FROM fcurve WHERE t<72) END, 0.001::DOUBLE) END AS raw
  FROM folded f JOIN fcurve USING (t) LEFT JOIN (SELECT label, avg(residual) AS r FROM val GROUP BY label) r ON r.label=f.label WHERE fold<4))""", "weight",
       folded=FOLDED, val=f"SELECT label, {residual('p')} AS residual FROM folded WHERE fold=4 AND label IS NOT NULL",
       fsteps="SELECT t, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS r, sum(1-event) AS c FROM folded WHERE fold<4 GROUP BY t",
       fcurve="SELECT t, product(1-c/r) OVER (ORDER BY t) AS g_at, coalesce(product(1-c/r) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS g_before FROM fsteps")

# metrics
oracle("top_k_accuracy", "SELECT arm::BIGINT AS arm, " + ", ".join(f"avg(({rank('p')}<={k})::INT::DOUBLE) AS top{k}_accuracy" for k in (1, 2, 3)) + " FROM predictions WHERE label IS NOT NULL GROUP BY arm",
       "top1_accuracy top2_accuracy top3_accuracy")
oracle("ordinal_risk", f"SELECT row_id, {risk('p')} AS risk, {argmax('p')}::BIGINT AS pred_class FROM predictions", "risk")


def pairs(keys: str, p: str, tau: str, where: str = "true", rounding: bool = True) -> dict[str, str]:
    value = f"round({risk(p)},{3 if rounding else 12})"
    same = " AND ".join(f"b.{k}=a.{k}" for k in keys.split(",")) if keys else "true"
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return {
        "ranked": f"SELECT {head}t, event, {value} AS r FROM predictions WHERE {where}",
        "ksteps": f"SELECT {head}t, count(*) AS n, sum(event) AS d, sum(count(*)) OVER ({part} ORDER BY t DESC)::DOUBLE AS at_risk FROM ranked GROUP BY {head}t",
        "kcurve": f"SELECT {head}t, at_risk-n AS later, coalesce(product(1-(n-d)/at_risk) OVER ({part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS g FROM ksteps",
        "grouped": f"SELECT {head}t, r, event, count(*) AS c FROM ranked GROUP BY ALL",
        "won": f"""SELECT {', '.join('a.' + k for k in keys.split(',')) + ', ' if keys else ''}a.t, a.r, a.c, sum(CASE WHEN b.r<a.r THEN b.c WHEN b.r=a.r THEN b.c*0.5::DOUBLE ELSE 0 END) AS good
          FROM grouped a JOIN grouped b ON {same} AND b.t>a.t WHERE a.event=1 GROUP BY ALL""",
        "anchored": f"SELECT w.*, k.later, k.g, 1/(k.g*k.g) AS iw FROM won w JOIN kcurve k ON k.t=w.t" + (" AND " + " AND ".join(f"k.{x}=w.{x}" for x in keys.split(",")) if keys else ""),
        "indices": f"""SELECT {head}sum(c*later)::BIGINT AS comparable, sum(c*good)/sum(c*later) AS harrell_c_index,
          sum(c*good*iw) FILTER (WHERE g>1e-8 AND t<={tau})/sum(c*later*iw) FILTER (WHERE g>1e-8 AND t<={tau}) AS ipcw_c_index FROM anchored""" + (f" GROUP BY {keys}" if keys else ""),
    }


oracle("concordance_overall", "SELECT * FROM indices", "harrell_c_index ipcw_c_index", **pairs("", "p", "1e9"))
oracle("concordance_by_arm", "SELECT * REPLACE (arm::BIGINT AS arm) FROM indices", "harrell_c_index ipcw_c_index", **pairs("arm", "q", "60"))


def f1_views(keys: str, source: str, p: str) -> dict[str, str]:
    head = f"{keys}, " if keys else ""
    on = "".join(f" AND c.{k}=y.{k}" for k in keys.split(",")) if keys else ""
    return {
        "shown": f"SELECT {head}label AS y, {argmax(p)} AS yhat FROM {source}",
        "seen": f"SELECT DISTINCT {head}y AS k FROM shown UNION SELECT DISTINCT {head}yhat FROM shown",
        "per_class": f"""SELECT {', '.join('c.' + x for x in keys.split(',')) + ', ' if keys else ''}c.k, count_if(y.y=c.k) AS tn, count_if(y.yhat=c.k) AS pn, count_if(y.y=c.k AND y.yhat=c.k) AS tp
          FROM seen c JOIN shown y ON true{on} GROUP BY ALL""",
        "f1s": f"""SELECT {head}sum(tp)/sum(tn) AS accuracy, avg(2*tp/(tn+pn)) AS macro_f1, sum(2*tp/(tn+pn)*tn)/sum(tn) AS weighted_f1,
          avg(CASE WHEN pn>0 THEN tp/pn ELSE 0 END) AS macro_precision, avg(CASE WHEN tn>0 THEN tp/tn ELSE 0 END) AS macro_recall, sum(tn)::BIGINT AS rows FROM per_class""" + (f" GROUP BY {keys}" if keys else ""),
    }


F1 = "accuracy macro_f1 weighted_f1 macro_precision macro_recall"
oracle("classification_report", f"SELECT f.* REPLACE (arm::BIGINT AS arm), top2_accuracy, top3_accuracy FROM f1s f JOIN (SELECT arm, avg(({rank('p')}<=2)::INT::DOUBLE) AS top2_accuracy, avg(({rank('p')}<=3)::INT::DOUBLE) AS top3_accuracy FROM matured GROUP BY arm) USING (arm)",
       F1 + " top2_accuracy top3_accuracy", matured="SELECT * FROM predictions WHERE label IS NOT NULL", **f1_views("arm", "matured", "p"))
oracle("full_classification_report", f"SELECT f.*, top2_accuracy, top3_accuracy, i.ipcw_c_index AS c_index, i.harrell_c_index AS harrell_c_index_unweighted FROM f1s f CROSS JOIN (SELECT avg(({rank('p')}<=2)::INT::DOUBLE) AS top2_accuracy, avg(({rank('p')}<=3)::INT::DOUBLE) AS top3_accuracy FROM matured) CROSS JOIN indices i",
       F1 + " top2_accuracy top3_accuracy c_index harrell_c_index_unweighted", matured="SELECT * FROM predictions WHERE label IS NOT NULL", **f1_views("", "matured", "p"), **pairs("", "p", "1e9", "label IS NOT NULL", rounding=False))
oracle("multinomial_brier", f"SELECT arm::BIGINT AS arm, avg({square_error('p')})/8 AS brier FROM predictions WHERE label IS NOT NULL GROUP BY arm", "brier")
oracle("ipcw_brier", """SELECT sum(loss*w)/sum(w) AS ipcw_brier, false AS fell_back FROM (SELECT 1/CASE WHEN k=0 THEN coalesce((SELECT arg_max(g_at,t) FROM curve WHERE t<=0),1) WHEN t<bound THEN c.g_at ELSE b.g END AS w, loss FROM (
  SELECT p.t, event, k, ([0,6,12,24,36,48,60,72])[k+1] AS bound, pow(p[k+1]-(cls=k)::INT, 2) AS loss FROM predictions p CROSS JOIN (SELECT unnest(range(8)) AS k)) x
  JOIN curve c USING (t) LEFT JOIN bounds b ON b.stop=bound WHERE event=1 OR t>=bound)""", "ipcw_brier", bounds=BOUND)
oracle("focal_loss", "SELECT avg(pow(greatest(1-py,1e-8),1.5::DOUBLE)*-ln(py)*([1.0,1.5,1.7,2.1,2.5,2.7,2.3,4.5])[label+1]::DOUBLE) AS focal_mean, sum(pow(greatest(1-py,1e-8),1.5::DOUBLE)*-ln(py)) AS focal_sum FROM (SELECT label, p[label+1] AS py FROM predictions WHERE label IS NOT NULL)", "focal_mean focal_sum")
oracle("monitor_residuals", f"SELECT row_id, {residual('p')} AS residual FROM predictions WHERE label IS NOT NULL", "residual")
oracle("selection_score", f"SELECT arm::BIGINT AS arm, macro_f1, r AS mean_residual, macro_f1-0.1::DOUBLE*r AS selection_score FROM f1s JOIN (SELECT arm, avg({residual('p')}) AS r FROM matured GROUP BY arm) USING (arm)", "macro_f1 mean_residual selection_score",
       matured="SELECT * FROM predictions WHERE label IS NOT NULL", **f1_views("arm", "matured", "p"))
oracle("abstention", "SELECT row_id, h AS entropy, CASE WHEN h>=0.85::DOUBLE THEN 'hard_abstain' WHEN h>=0.65::DOUBLE THEN 'soft_abstain' ELSE 'serve' END AS decision, h>=0.65::DOUBLE AS abstain FROM (SELECT row_id, -("
       + "+".join(f"greatest(p[{k}],1e-12)*ln(greatest(p[{k}],1e-12))" for k in range(1, 9)) + ") AS h FROM predictions)", "entropy")
oracle("net_benefit", """SELECT threshold, count_if(r>=threshold AND y=1)::BIGINT AS true_positive, count_if(r>=threshold AND y=0)::BIGINT AS false_positive,
  count_if(r>=threshold AND y=1)/count(*)-count_if(r>=threshold AND y=0)/count(*)*threshold/(1-threshold) AS net_benefit
  FROM (SELECT 1-(t>24)::INT AS y, p[1]+p[2]+p[3] AS r FROM predictions WHERE (event=1 AND t<=24) OR t>=24) CROSS JOIN (SELECT unnest([0.05::DOUBLE,0.1::DOUBLE,0.2::DOUBLE,0.3::DOUBLE,0.5::DOUBLE,0.7::DOUBLE]) AS threshold) GROUP BY threshold""", "threshold net_benefit")


def classes3(a: str, b: str) -> str:
    return "[" + ", ".join(f"exp({0.3 * k!r}::DOUBLE*{a}-{0.2 * k!r}::DOUBLE*{b})" for k in range(3)) + "]"


oracle("permutation_attribution", f"""SELECT row_id, feature, avg(base-swapped[c+1]/list_sum(swapped)) AS attribution FROM (SELECT b.row_id, b.feature, b.base, b.c,
  {classes3("CASE WHEN b.feature='x1' THEN d.swap ELSE b.x1 END", "CASE WHEN b.feature='x2' THEN d.swap ELSE b.x2 END")} AS swapped FROM trials b JOIN trials d ON d.feature=b.feature AND d.rep=b.rep AND d.donor=b.place) GROUP BY row_id, feature""", "attribution",
       based=f"SELECT row_id, x1, x2, list_max(e)/list_sum(e) AS base, list_position(e, list_max(e))-1 AS c, row_number() OVER (ORDER BY row_id) AS place FROM (SELECT row_id, x1, x2, {classes3('x1', 'x2')} AS e FROM cohort)",
       trials="""SELECT b.*, f.feature, r.rep, CASE WHEN f.feature='x1' THEN x1 ELSE x2 END AS swap, row_number() OVER (PARTITION BY f.feature, r.rep ORDER BY ('0x'||substr(md5(concat('perm|42|',f.feature,'|',r.rep,'|',row_id)),1,8))::BIGINT, row_id) AS donor
         FROM based b CROSS JOIN (SELECT unnest(['x1','x2']) AS feature) f CROSS JOIN (SELECT unnest(range(5)) AS rep) r""")
BETAS = "[" + ", ".join(f"{b!r}::DOUBLE" for b in BETA) + "]"
MOMENT = "[" + ", ".join(f"avg(x[{i + 1}])" for i in range(64)) + "]"
oracle("cluster_quality", """SELECT s.silhouette, d.davies_bouldin, c.calinski_harabasz FROM sil s CROSS JOIN db d CROSS JOIN ch c""", "silhouette davies_bouldin calinski_harabasz",
       centres=f"SELECT label, count(*) AS n, {MOMENT} AS m FROM vectors GROUP BY label", grand=f"SELECT {MOMENT} AS m FROM vectors",
       spread="SELECT c.label, avg(list_distance(x, c.m)) AS s, sum(pow(list_distance(x, c.m),2)) AS ss FROM vectors v JOIN centres c USING (label) GROUP BY c.label",
       db="SELECT avg(w) AS davies_bouldin FROM (SELECT a.label, max((sa.s+sb.s)/list_distance(a.m,b.m)) AS w FROM centres a JOIN centres b ON a.label<>b.label JOIN spread sa ON sa.label=a.label JOIN spread sb ON sb.label=b.label GROUP BY a.label)",
       ch="SELECT (SELECT sum(n*pow(list_distance(c.m, g.m),2)) FROM centres c CROSS JOIN grand g)*((SELECT sum(n) FROM centres)-count(*))/(sum(ss)*(count(*)-1)) AS calinski_harabasz FROM spread",
       gaps="SELECT a.vec_id, a.label AS own, b.label AS k, sum(list_distance(a.x,b.x)) AS s, count(*) AS n FROM vectors a CROSS JOIN vectors b GROUP BY ALL",
       sil="SELECT avg(CASE WHEN size<=1 THEN 0 ELSE (b-a)/greatest(a,b) END) AS silhouette FROM (SELECT vec_id, max(CASE WHEN own=k THEN s/nullif(n-1,0) END) AS a, max(CASE WHEN own=k THEN n END) AS size, min(CASE WHEN own<>k THEN s/n END) AS b FROM gaps GROUP BY vec_id)")
oracle("consistency_loss", f"SELECT avg(list_sum([abs(tanh(5*attr[i])-tanh(5*x[i]*({BETAS})[i])) for i in range(1,65)]))/64 AS consistency_loss FROM attributed", "consistency_loss")
HITS = [i for i, n in enumerate(NAMES) if n in RISK_FEATURES]
oracle("rule_violation_loss", "SELECT (" + "+".join(f"greatest(0,-avg(attr[{i + 1}]))" for i in HITS) + f")/{len(HITS)} AS rule_violation_loss FROM attributed", "rule_violation_loss")
oracle("attribution_alignment", """SELECT (SELECT corr(a.feature, b.feature) FROM placed a JOIN placed b ON a.ip=b.sp) AS index_rho, (SELECT corr(ip, sp) FROM placed) AS rank_rho""", "index_rho rank_rho",
       importances="SELECT unnest(range(64)) AS feature, unnest([" + ", ".join(f"avg(abs(attr[{i + 1}]))" for i in range(64)) + "]) AS imp FROM attributed",
       placed="SELECT feature, row_number() OVER (ORDER BY imp, feature) AS ip, row_number() OVER (ORDER BY abs(round(0.9::DOUBLE-feature*0.013::DOUBLE,3)), feature) AS sp FROM importances")
LABEL_STEPS = {"lsteps": "SELECT t, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS at_risk, sum(1-event) AS c FROM predictions WHERE label IS NOT NULL GROUP BY t",
               "lcurve": "SELECT t, product(1-c/at_risk) OVER (ORDER BY t) AS g_at FROM lsteps",
               "lbounds": "SELECT b.stop, coalesce((SELECT arg_max(g_at, t) FROM lcurve WHERE t<=b.stop), 1) AS g FROM (SELECT unnest([6,12,24,36,48,60,72]) AS stop) b"}
oracle("explanation_report", """SELECT *, loss_pred+0.4::DOUBLE*loss_cal+0.3::DOUBLE*loss_exp+0.2::DOUBLE*loss_clin AS loss_total FROM
  (SELECT -avg(ln(greatest(p[label+1],1e-12))) AS loss_pred FROM predictions WHERE label IS NOT NULL) CROSS JOIN
  (SELECT sum(loss*w)/sum(w) AS loss_cal FROM (SELECT 1/CASE WHEN k=0 THEN coalesce((SELECT arg_max(g_at,t) FROM lcurve WHERE t<=0),1) WHEN t<bound THEN c.g_at ELSE b.g END AS w, loss FROM (
    SELECT p.t, event, k, ([0,6,12,24,36,48,60,72])[k+1] AS bound, pow(p[k+1]-(label=k)::INT, 2) AS loss FROM predictions p CROSS JOIN (SELECT unnest(range(8)) AS k) WHERE label IS NOT NULL) x
    JOIN lcurve c USING (t) LEFT JOIN lbounds b ON b.stop=bound WHERE event=1 OR t>=bound)) CROSS JOIN
  (SELECT avg(abs(tanh(5*(x1*0.1::DOUBLE))-tanh(5*x1*0.3::DOUBLE))+abs(tanh(5*(-x2*0.2::DOUBLE))-tanh(5*x2*-0.2::DOUBLE))+abs(tanh(5*-0.05::DOUBLE)-tanh(5*0.1::DOUBLE)))/3 AS loss_exp FROM predictions WHERE label IS NOT NULL) CROSS JOIN
  (SELECT (greatest(0,-avg(x1*0.1::DOUBLE))+0.05::DOUBLE)/2 AS loss_clin FROM predictions WHERE label IS NOT NULL)""", "loss_pred loss_cal loss_exp loss_clin loss_total", **LABEL_STEPS)

# networks: losses of a linear hazard net before and after its first step, which moves every weight by the rate against the sign of its gradient
_FOLD = u("fold|42", "patient_id")
_NLL = "sum(CASE WHEN {where} THEN cell_weight*(greatest(z,0)-z*target+ln(1+exp(-abs(z)))) ELSE 0 END)/count(DISTINCT CASE WHEN {where} AND cell_weight>0 THEN row_id END)"
oracle("discrete_network_start", f"""SELECT epoch, {_NLL.format(where='fold<4')} AS train_nll, {_NLL.format(where='fold=4')} AS valid_nll
  FROM (SELECT c.*, epoch, epoch*(b+u*x1+v*x2) AS z FROM net_cells c JOIN net_step s USING (interval) CROSS JOIN (SELECT unnest([0::BIGINT,1::BIGINT]) AS epoch)) GROUP BY epoch""",
       "train_nll valid_nll", cells=CELLS, bounds=BOUND, weighted=WEIGHTED, net_cells=f"SELECT *, floor({_FOLD}*5)::INT AS fold FROM weighted",
       net_slope="SELECT interval, " + ", ".join(f"sum(cell_weight*(0.5::DOUBLE-target)*{x})/any_value(whole) AS g{i}" for i, x in enumerate(("1", "x1", "x2")))
       + " FROM net_cells CROSS JOIN (SELECT count(DISTINCT row_id) AS whole FROM net_cells WHERE fold<4 AND cell_weight>0) WHERE fold<4 GROUP BY interval",
       net_step="SELECT interval, " + ", ".join(f"-0.05::DOUBLE*g{i}/(abs(g{i})+1e-8::DOUBLE) AS {n}" for i, n in enumerate("buv")) + " FROM net_slope")
oracle("discrete_network", f"SELECT count(*) AS rows, count(*) AS sum_to_one, true AS kept_is_least, true AS ended_by_rule, true AS loss_agrees, true AS below_start FROM cohort WHERE floor({_FOLD}*5)=4")
oracle("softmax_boosting", f"SELECT count(*) AS rows, count(*) AS sum_to_one, 500::BIGINT AS rounds, 0::BIGINT AS rises FROM labelled WHERE label IS NOT NULL AND floor({_FOLD}*5)=4")
oracle("softmax_network", f"SELECT count(*) AS rows, count(*) AS sum_to_one, count(*) AS arms_sum_to_one, true AS kept_is_least, true AS below_start FROM labelled WHERE label IS NOT NULL AND floor({_FOLD}*5)=4")

# splits and tests
STRATUM = "coalesce(label::VARCHAR,'null')||'|'||event"
oracle("repeated_splits", """SELECT s.seed::BIGINT AS seed, s.fold::BIGINT AS fold, c.row_id, s.role FROM cohort c JOIN (
  SELECT seed, fold, patient_id, 'test' AS role FROM grid WHERE test=fold UNION ALL
  SELECT seed, fold, patient_id, CASE WHEN row_number() OVER (PARTITION BY seed, fold, inner_s ORDER BY v, patient_id)%5=1 THEN 'val' ELSE 'train' END FROM grid WHERE test<>fold) s USING (patient_id)""",
       present=f"""SELECT (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label, event)) AS pair_min, (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label)) AS label_min""",
       units=f"""SELECT patient_id, arg_min(CASE WHEN pair_min>=5 THEN {STRATUM} WHEN label_min>=5 THEN coalesce(label::VARCHAR,'null') ELSE 'all' END, row_id) AS outer_s,
         arg_min(CASE WHEN pair_min>=10 THEN {STRATUM} WHEN label_min>=10 THEN coalesce(label::VARCHAR,'null') ELSE 'all' END, row_id) AS inner_s FROM labelled CROSS JOIN present GROUP BY patient_id""",
       dealt="""SELECT *, (row_number() OVER (PARTITION BY seed, outer_s ORDER BY uu, patient_id)-1+floor((('0x'||substr(md5(concat('start|',seed,'|',outer_s)),1,8))::BIGINT/4294967296.0::DOUBLE)*5)::INT)%5 AS test FROM (
         SELECT *, ('0x'||substr(md5(concat('split|',seed,'|',patient_id)),1,8))::BIGINT AS uu FROM units CROSS JOIN (SELECT unnest([42,123,2024,31415,65537]) AS seed))""",
       grid="SELECT *, ('0x'||substr(md5(concat('val|',seed+fold,'|',patient_id)),1,8))::BIGINT AS v FROM dealt CROSS JOIN (SELECT unnest(range(5)) AS fold)")
oracle("grouped_folds", f"SELECT row_id, floor({u('fold|42', 'patient_id')}*5)::BIGINT AS fold FROM cohort")
oracle("balanced_group_folds", f"SELECT seed::BIGINT AS seed, {STRATUM} AS stratum, count(*) AS rows, true AS even FROM labelled CROSS JOIN (SELECT unnest([42,123,2024,31415,65537]) AS seed) GROUP BY ALL")
oracle("prediction_rerun", f"SELECT 42::BIGINT AS seed, floor({u('fold|42', 'patient_id')}*5)::BIGINT AS fold, count(*) AS rows, count(*) AS streamed FROM cohort GROUP BY ALL")
PER = "SELECT patient_id, avg(x1) AS v FROM cohort GROUP BY patient_id"
oracle("bootstrap_interval", "SELECT (SELECT avg(v) FROM per) AS estimate, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, count(*) AS replicates FROM (SELECT rep, sum(v*w)/sum(w) AS d FROM drawn GROUP BY rep)",
       "estimate ci_low ci_high", per=PER, drawn=draws("per", "patient_id", 1000))
oracle("bootstrap_median", "SELECT (SELECT quantile_cont(v, 0.5) FROM per) AS estimate, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, count(*) AS replicates FROM (SELECT rep, quantile_cont(v, 0.5) AS d FROM (SELECT rep, v, unnest(range(w)) FROM drawn) GROUP BY rep)",
       "estimate ci_low ci_high", per=PER, drawn=draws("per", "patient_id", 1000))
FOLD_METRICS = "UNPIVOT (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variant, seed, fold, " + ", ".join(f"avg(({rank(p)}<={k})::INT::DOUBLE) AS top{k}_accuracy" for k in (1, 2, 3)) + " FROM seeded GROUP BY seed, fold" for p, v in (("p", "full"), ("q", "reduced"))
) + ") ON top1_accuracy, top2_accuracy, top3_accuracy INTO NAME metric VALUE value"
oracle("corrected_t_test", """SELECT *, mean_difference/standard_error AS t_statistic, runs-1 AS degrees_of_freedom FROM (SELECT metric, variant_a, variant_b, avg(d) AS mean_difference, count(*) AS runs, 1/count(*)+0.25::DOUBLE AS correction_factor, sqrt((1/count(*)+0.25::DOUBLE)*var_samp(d)) AS standard_error
  FROM (SELECT a.metric, a.variant AS variant_a, b.variant AS variant_b, a.value-b.value AS d FROM fold_scores a JOIN fold_scores b ON a.metric=b.metric AND a.seed=b.seed AND a.fold=b.fold AND a.variant<b.variant) GROUP BY ALL)""",
       "mean_difference correction_factor standard_error t_statistic", seeded=SEEDED, fold_scores=FOLD_METRICS)
oracle("discordance_test", f"""SELECT arm::BIGINT AS arm, a AS a_correct_b_wrong, b AS a_wrong_b_correct, a+b AS discordant, least(1, 2*list_sum([exp(lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)-(a+b)*ln(2)) for k in range(least(a,b)+1)])) AS p_value_two_sided_exact
  FROM (SELECT arm, count_if({argmax('p')}=label AND {argmax('q')}<>label)::BIGINT AS a, count_if({argmax('p')}<>label AND {argmax('q')}=label)::BIGINT AS b FROM predictions WHERE label IS NOT NULL GROUP BY arm)""", "p_value_two_sided_exact")
oracle("candidate_search", "SELECT candidate::BIGINT AS candidate, selection_score, macro_f1, phase_p_residual, candidate=(arg_min(candidate, (-selection_score, candidate)) OVER ()) AS best FROM (SELECT candidate, avg(macro_f1-0.1::DOUBLE*r) AS selection_score, avg(macro_f1) AS macro_f1, avg(r) AS phase_p_residual FROM f1s JOIN (SELECT candidate, fold, avg(" + residual("c") + ") AS r FROM tried GROUP BY ALL) USING (candidate, fold) GROUP BY candidate)",
       "selection_score macro_f1 phase_p_residual", tried=f"SELECT label, floor({u('fold|42', 'patient_id')}*4)::INT AS fold, candidate, CASE WHEN candidate=0 THEN q ELSE p END AS c FROM predictions CROSS JOIN (SELECT unnest([0,1]) AS candidate) WHERE label IS NOT NULL",
       **f1_views("candidate,fold", "tried", "c"))

# artifacts: file names of 25 runs; which kinds they satisfy and what a changed manifest breaks is known
_KINDS = [("split_manifests", 5, True, 0), ("per_fold_metrics", 25, True, 25), ("per_fold_predictions", 25, True, 25), ("model_checkpoints", 25, True, 25), ("hashes", 1, True, 0),
          ("statistical_scripts", 1, True, 0), ("figure_inputs", 1, True, 0), ("censoring_audit", 1, True, 0), ("locked_external_validation", 1, True, 0),
          ("edge_profiling", 1, True, 0), ("environment_lock", 4, False, 0), ("audit_manifest", 1, True, 1)]
oracle("acceptance_audit", " UNION ALL ".join(f"SELECT '{k}' AS kind, {m}::BIGINT AS minimum, {str(h).lower()} AS hard, {n}::BIGINT AS found, {str(n >= m).lower()} AS passed, false AS ready" for k, m, h, n in _KINDS))
oracle("audit_manifest", """SELECT 'changed' AS manifest, scope, fault FROM (VALUES ('outputs/model/run=run_42_0/model.joblib', 'digest_mismatch'), ('42/2', 'run missing'),
  ('figure_inputs', 'found False, wanted entries'), ('fold_runs[1].metrics', 'the path leaves the folder')) v(scope, fault)""")

# fusion
oracle("fusion_moments", "SELECT " + ", ".join(f"avg(list_dot_product({a}, {b}))/8 AS g_{i}_{j}" for i, j, a, b in ((0, 0, "p", "p"), (0, 1, "p", "q"), (1, 1, "q", "q"))) + ", avg(p[label+1])/8 AS b_0, avg(q[label+1])/8 AS b_1 FROM predictions WHERE label IS NOT NULL", "g_0_0 g_0_1 g_1_1 b_0 b_1")
oracle("completed_probabilities", "SELECT row_id, " + ", ".join(
    f"CASE WHEN arm=0 THEN 0.125::DOUBLE ELSE {'p[1]/(p[1]+p[4])' if k == 1 else 'p[4]/(p[1]+p[4])' if k == 4 else '0'} END AS p_c{k + 1}" for k in range(8)) + " FROM predictions", P_COLUMNS)
oracle("ensemble_scoring", "SELECT row_id, " + unpack("f") + " FROM (SELECT row_id, [v/list_sum(l) for v in l] AS f FROM platted)", P_COLUMNS,
       fused="SELECT row_id, [(0.7::DOUBLE*p[k]+0.3::DOUBLE*q[k]) for k in range(1,9)] AS r FROM predictions",
       fused2="SELECT row_id, [v/list_sum(r) for v in r] AS r FROM fused",
       headed="SELECT row_id, r, [exp(r[k]+0.1::DOUBLE*(row_id%4)+0.05::DOUBLE*(k-1)) for k in range(1,9)] AS e FROM fused2",
       blended="SELECT row_id, [0.4::DOUBLE*r[k]+0.6::DOUBLE*e[k]/list_sum(e) for k in range(1,9)] AS b FROM headed",
       blended2="SELECT row_id, [v/list_sum(b) for v in b] AS b FROM blended",
       platted="SELECT row_id, [CASE WHEN k=8 THEN 0.2::DOUBLE ELSE 1/(1+exp(-(0.9::DOUBLE*ln(b[k]/(1-b[k]))+0.1::DOUBLE))) END for k in range(1,9)] AS l FROM blended2")

# contrasts
oracle("arm_report", "SELECT arm::BIGINT AS arm, count(*) AS rows, count_if(observed)::BIGINT AS observed_rows, count_if(NOT observed)::BIGINT AS excluded_immature FROM exposed GROUP BY arm")


def smd(x: str, w: str) -> str:
    out = []
    for side, mask in (("a", "arm=action"), ("r", "arm=0")):
        out.append(f"sum({w}*{x}) FILTER (WHERE {mask})/sum({w}) FILTER (WHERE {mask}) AS m{side}, sum({w}*{x}*{x}) FILTER (WHERE {mask})/sum({w}) FILTER (WHERE {mask}) AS q{side}")
    return f"SELECT action, (ma-mr)/sqrt(greatest((qa-ma*ma+qr-mr*mr)/2,1e-12)) AS d FROM (SELECT action, {', '.join(out)} FROM compared WHERE support GROUP BY action)"


oracle("covariate_balance", " UNION ALL ".join(f"SELECT b.action::BIGINT AS action, {i}::BIGINT AS covariate, b.d AS smd_before, a.d AS smd_after FROM ({smd(x, '1')}) b JOIN ({smd(x, 'iptw')}) a USING (action)" for i, x in enumerate(("x1", "x2"))), "smd_before smd_after")
oracle("worst_balance", "SELECT action::BIGINT AS action, max(abs(b)) AS max_abs_smd_before, max(abs(a)) AS max_abs_smd_after_iptw FROM (" + " UNION ALL ".join(f"SELECT action, b.d AS b, a.d AS a FROM ({smd(x, '1')}) b JOIN ({smd(x, 'iptw')}) a USING (action)" for x in ("x1", "x2")) + ") GROUP BY action",
       "max_abs_smd_before max_abs_smd_after_iptw")
oracle("overlap_retention", "SELECT action::BIGINT AS action, arm::BIGINT AS arm, count_if(support)::BIGINT AS retained, count(*) AS total, count_if(support)/count(*) AS fraction FROM compared WHERE arm=action OR arm=0 GROUP BY action, arm", "fraction")


def three(source: str, keys: str, w: str) -> str:
    s = lambda mask, v: f"sum({v}*{w}) FILTER (WHERE {mask})"
    a, r = "arm=action", "arm=0"
    return f"""SELECT {keys}, {s(a, 'y')}/{s(a, '1')}-{s(r, 'y')}/{s(r, '1')} AS naive, {s(a, 'iptw*y')}/{s(a, 'iptw')}-{s(r, 'iptw*y')}/{s(r, 'iptw')} AS iptw, sum(psi_a*{w})/sum({w})-sum(psi_r*{w})/sum({w}) AS aipw,
      least(1,greatest(1e-6,sum(psi_a*{w})/sum({w})))/least(1,greatest(1e-6,sum(psi_r*{w})/sum({w}))) AS risk_ratio FROM {source} WHERE support GROUP BY {keys}"""


THREE = "naive iptw aipw risk_ratio"
oracle("contrast_estimates", "SELECT * REPLACE (action::BIGINT AS action) FROM (" + three("compared", "action", "1") + ")", THREE)
EV = "(CASE WHEN {0}<1 THEN 1/{0} ELSE {0} END)+sqrt((CASE WHEN {0}<1 THEN 1/{0} ELSE {0} END)*((CASE WHEN {0}<1 THEN 1/{0} ELSE {0} END)-1))"
NEAR = "(CASE WHEN risk_ratio_low<=1 AND risk_ratio_high>=1 THEN 1e0 WHEN risk_ratio>=1 THEN risk_ratio_low ELSE risk_ratio_high END)"
oracle("bootstrap_contrasts", f"SELECT *, {EV.format('risk_ratio')} AS e_value_point, {EV.format(NEAR)} AS e_value_ci_bound, 1000::BIGINT AS replicates FROM (SELECT e.* REPLACE (action::BIGINT AS action), d.* EXCLUDE (action) FROM point e JOIN (SELECT action, "
       + ", ".join(f"quantile_cont({n},0.025) AS {n}_low, quantile_cont({n},0.975) AS {n}_high, count({n}) AS {n}_valid" for n in THREE.split()) + " FROM reps GROUP BY action) d USING (action))",
       THREE + " e_value_point e_value_ci_bound " + " ".join(f"{n}_low {n}_high" for n in THREE.split()),
       point=three("compared", "action", "1"), drawn=draws("compared", "row_id", 1000), reps=three("drawn", "rep, action", "w"))
oracle("weighted_rmst_contrasts", "SELECT action::BIGINT AS action, max(rmst) FILTER (WHERE side='a')-max(rmst) FILTER (WHERE side='r') AS rmst_difference FROM (" + rmst("action, side", "csteps", 24) + ") GROUP BY action", "rmst_difference",
       sided="SELECT *, CASE WHEN arm=action THEN 'a' ELSE 'r' END AS side FROM compared WHERE support AND (arm=action OR arm=0)",
       csteps="SELECT action, side, t, sum(iptw*event) AS d, sum(sum(iptw)) OVER (PARTITION BY action, side ORDER BY t DESC) AS r FROM sided GROUP BY action, side, t")

# scenarios
ACTED_STATE = "SELECT s.*, a.arm FROM state s JOIN acted a USING (row_id)"
TEMPLATE = "SELECT k AS arm, " + ", ".join(f"coalesce(m{i}, (SELECT median(s{i}) FROM acted_state)) AS m{i}" for i in range(26, 32)) + " FROM (SELECT unnest(range(6)) AS k) LEFT JOIN (SELECT arm, " + ", ".join(f"median(s{i}) AS m{i}" for i in range(26, 32)) + " FROM acted_state GROUP BY arm) ON arm=k"
oracle("arm_templates", "SELECT arm::BIGINT AS arm, unnest(range(6))::BIGINT AS coordinate, unnest([m26,m27,m28,m29,m30,m31]) AS median FROM templates", "median", acted_state=ACTED_STATE, templates=TEMPLATE)
oracle("inferred_actions", "SELECT row_id, (list_position(l, list_max(l))-1)::BIGINT AS arm FROM (SELECT row_id, [s26,s27,s28,s29,s30,s31] AS l FROM state)")
oracle("forced_state", " UNION ALL ".join(f"SELECT {i}::BIGINT AS coordinate, " + (f"(SELECT m{i} FROM templates WHERE arm=5)" if 26 <= i < 32 else "0e0" if i in (34, 44, 45) else f"(SELECT avg(s{i}) FROM state)") + " AS mean" for i in range(46)), "mean", acted_state=ACTED_STATE, templates=TEMPLATE)
SWEPT = {
    "acted_state": ACTED_STATE, "templates": TEMPLATE,
    "crossed": "SELECT row_id, a.arm AS factual, t.arm, [exp(0.4::DOUBLE*k*s1) for k in range(6)] AS re, [exp(0.15::DOUBLE*k*(0.5::DOUBLE*s0-0.4::DOUBLE*s12+0.6::DOUBLE*m26+0.3::DOUBLE*m29-0.2::DOUBLE*m31)) for k in range(8)] AS rp FROM acted_state a CROSS JOIN templates t",
    "chances": "SELECT row_id, factual, arm, re[arm+1]/list_sum(re) AS propensity, list_sum(rp[3:8])/list_sum(rp) AS p FROM crossed",
    "swept": "SELECT c.*, c.p-f.p AS delta FROM chances c JOIN chances f ON f.row_id=c.row_id AND f.arm=c.factual",
}
oracle("scenario_sweep", "SELECT row_id, factual::BIGINT AS factual, arm::BIGINT AS arm, propensity, propensity>=0.05::DOUBLE AND propensity<=0.95::DOUBLE AS estimable, p AS p_os_gt_12m, delta FROM swept", "propensity p_os_gt_12m delta", **SWEPT)
NOISE = "0.1::DOUBLE*((('0x'||substr(md5(concat('draw|',row_id,'|',arm,'|',d)),1,8))::BIGINT/4294967296.0::DOUBLE)-0.5::DOUBLE)"
BETWEEN = lambda q: f"g[{int(q * 199) + 1}]+{q * 199 - int(q * 199):.17g}::DOUBLE*(g[{int(q * 199) + 2}]-g[{int(q * 199) + 1}])"
oracle("clinical_sweep", f"""SELECT row_id, arm::BIGINT AS arm, delta, delta_ci_low, delta_ci_high, confidence FROM (
  SELECT row_id, arm, delta, propensity AS e, {BETWEEN(0.025)} AS delta_ci_low, {BETWEEN(0.975)} AS delta_ci_high,
    confidence FROM swept_differences) WHERE NOT (delta_ci_low<=0 AND delta_ci_high>=0)""", "delta delta_ci_low delta_ci_high confidence", **SWEPT,
       swept_gated="SELECT *, propensity>=0.05::DOUBLE AND propensity<=0.95::DOUBLE AND confidence>=0.3::DOUBLE AS passes FROM (SELECT *, ('0x'||substr(md5(concat('guide|',row_id,'|',arm)),1,8))::BIGINT/4294967296.0::DOUBLE AS confidence FROM swept)",
       swept_draws=f"SELECT row_id, factual, arm, delta, propensity, confidence, passes, [p+{NOISE} for d in range(200)] AS q FROM swept_gated WHERE passes OR arm=factual",
       swept_differences="SELECT a.row_id, a.arm, a.delta, a.propensity, a.confidence, list_sort([a.q[i]-f.q[i] for i in range(1, 201)]) AS g FROM swept_draws a JOIN swept_draws f ON f.row_id=a.row_id AND f.arm=a.factual WHERE a.passes AND a.arm<>a.factual")
_HELD = f"FROM cohort WHERE floor({_FOLD}*5)=4"
oracle("fitted_scenarios", f"SELECT count(*) AS subjects, count(*) AS ranked, count(*) AS propensities_sum_to_one, 6*count(*) AS rows, count(*) AS factual_without_difference, 6*count(*) AS chances, 0::BIGINT AS with_interval {_HELD}")

# monitoring, log and privacy
ROLLING = "SELECT event_id, event_type, streaming_error*1e6 AS streaming_error_ppm, CASE WHEN streaming_error>0.32::DOUBLE THEN 'full_retrain' WHEN streaming_error>0.18::DOUBLE THEN 'soft_update' ELSE 'no_update' END AS action FROM (SELECT event_id, event_type, avg(residual) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS streaming_error FROM monitor_rows)"
oracle("monitor_replay", ROLLING, "streaming_error_ppm")
oracle("monitor_stream", ROLLING, "streaming_error_ppm")
_SLOPES = [("residual/4e0", "0.4"), ("(-0.1::DOUBLE)", "0.3"), ("0.05::DOUBLE", "0.3")]
_RAW = ", ".join(f"greatest(w[{i}]-0.005::DOUBLE*{g}-0.01::DOUBLE*(w[{i}]-{a}::DOUBLE),0)" for i, (g, a) in enumerate(_SLOPES, 1))
ORACLES["monitor_weights"] = f"""WITH RECURSIVE rolled AS MATERIALIZED (SELECT event_id, event_type, value/250 AS residual, row_number() OVER w AS n, avg(value/250) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS e
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
  held AS (SELECT event_type, 0::BIGINT AS n, 0::BIGINT AS event_id, [0.4::DOUBLE,0.3::DOUBLE,0.3::DOUBLE] AS w FROM (SELECT DISTINCT event_type FROM rolled)
    UNION ALL SELECT event_type, n, event_id, CASE WHEN raw IS NULL THEN w WHEN list_sum(raw)>0 THEN [v/list_sum(raw) for v in raw] ELSE [1e0/3,1e0/3,1e0/3] END FROM (
      SELECT h.event_type, r.n, r.event_id, h.w, CASE WHEN e>0.18::DOUBLE AND e<=0.32::DOUBLE THEN [{_RAW}] END AS raw FROM held h JOIN rolled r ON r.event_type=h.event_type AND r.n=h.n+1))
  SELECT event_id, round(w[1],6)+0e0 AS w0, round(w[2],6)+0e0 AS w1, round(w[3],6)+0e0 AS w2 FROM held WHERE n>0"""
MOVES = [("0.5", "x1", "0.4"), ("0.3", "(-x2)", "0.35"), ("0.2", "p[1]", "0.25")]
oracle("proximal_step", "SELECT row_id, " + ", ".join(f"CASE WHEN m0+m1+m2>0 THEN m{i}/(m0+m1+m2) ELSE 1e0/3 END AS w{i}" for i in range(3)) + " FROM (SELECT row_id, " + ", ".join(
    f"greatest({w}::DOUBLE-0.2::DOUBLE*{g}-0.1::DOUBLE*({w}::DOUBLE-{a}::DOUBLE),0) AS m{i}" for i, (w, g, a) in enumerate(MOVES)) + " FROM predictions)", "w0 w1 w2")
ENTRIES = sql("SELECT * FROM log_entries")
LINK = """WITH RECURSIVE log_rows AS ({entries}), linked AS (
  SELECT chain_id, seq, 'signed_root' AS prev_hash, sha256('signed_root'||body) AS hash FROM log_rows l WHERE seq=(SELECT min(seq) FROM log_rows m WHERE m.chain_id=l.chain_id)
  UNION ALL SELECT l.chain_id, l.seq, k.hash, sha256(k.hash||l.body) FROM linked k JOIN log_rows l ON l.chain_id=k.chain_id AND l.seq=k.seq+1) """
ORACLES["log_append"] = LINK.format(entries=ENTRIES) + "SELECT chain_id, seq, prev_hash, hash FROM linked"
ORACLES["log_append_stream"] = ORACLES["log_append"]
ORACLES["log_verify"] = LINK.format(entries=ENTRIES) + """SELECT chain_id, count(*) AS entries, NOT (chain_id LIKE '%3' AND count_if(seq=1)>0) AS valid, CASE WHEN chain_id LIKE '%3' AND count_if(seq=1)>0 THEN 1::BIGINT END AS first_break FROM linked GROUP BY chain_id"""
oracle("shadow_gate", "SELECT mode, decision, count(*) AS n FROM (SELECT CASE WHEN h>=0.85::DOUBLE THEN 'hard_abstain' WHEN h>=0.65::DOUBLE THEN 'soft_abstain' ELSE 'serve' END AS decision FROM (SELECT -("
       + "+".join(f"p[{k}]*ln(p[{k}])" for k in range(1, 9)) + ") AS h FROM predictions)) CROSS JOIN (SELECT unnest(['silent_shadow','live_closed_loop']) AS mode) GROUP BY ALL")


def noise(i: int) -> str:
    part = lambda s: f"(('0x'||substr(md5(concat('{s}|test-key|',label,'|',vec_id,'|{i}')),1,8))::BIGINT/4294967296.0::DOUBLE)"
    return f"sqrt(-2*ln(1-{part('r')}))*cos(2*pi()*{part('a')})"


oracle("private_gradients", "SELECT vec_id, " + ", ".join(f"g[{i + 1}]*k AS c{i}" for i in range(64)) + ", " + ", ".join(f"g[{i + 1}]*k+0.55::DOUBLE*{noise(i)} AS n{i}" for i in range(64))
       + " FROM (SELECT vec_id, label, g, least(1, 0.5::DOUBLE/greatest(sqrt(list_dot_product(g,g)),1e-12)) AS k FROM (SELECT vec_id, label, [v*3 for v in x] AS g FROM vectors))", listed("c", 64) + " " + listed("n", 64))
oracle("private_round_sum", "SELECT label::BIGINT AS label, sites, unnest(range(64))::BIGINT AS coordinate, unnest(l) AS total FROM (SELECT label, count(*) AS sites, [" + ", ".join(f"sum(x[{i + 1}]*k+1.1::DOUBLE*{noise(i)})" for i in range(64))
       + "] AS l FROM (SELECT *, least(1, 1/greatest(sqrt(list_dot_product(x,x)),1e-12)) AS k FROM vectors) GROUP BY label)", "total")

# longitudinal
oracle("dynamics_predictions", "SELECT event_id, e_t+d1 AS tumor_diameter_predicted_cm, e_t AS tumor_diameter_error_cm, e_f+f1 AS fibrosis_predicted, e_f AS fibrosis_error FROM errors WHERE variant='full_dynamics'",
       "tumor_diameter_predicted_cm tumor_diameter_error_cm fibrosis_predicted fibrosis_error")
AGREE = "tumor_bias_cm tumor_mae_cm tumor_loa_low_cm tumor_loa_high_cm fibrosis_bias fibrosis_mae"
AGREE_SQL = "count(*) AS n_intervals, avg(e_t) AS tumor_bias_cm, avg(abs(e_t)) AS tumor_mae_cm, avg(e_t)-1.96::DOUBLE*stddev_samp(e_t) AS tumor_loa_low_cm, avg(e_t)+1.96::DOUBLE*stddev_samp(e_t) AS tumor_loa_high_cm, avg(e_f) AS fibrosis_bias, avg(abs(e_f)) AS fibrosis_mae"
oracle("dynamics_agreement", f"SELECT variant, {AGREE_SQL} FROM errors GROUP BY variant", AGREE)
MAES = "SELECT patient_id, avg(abs(e_t)) AS v FROM errors WHERE variant='full_dynamics' GROUP BY patient_id"


def subject_interval(replicates: int) -> str:
    return "SELECT (SELECT avg(v) FROM maes) AS estimate, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, count(*) AS replicates FROM (SELECT rep, sum(v*w)/sum(w) AS d FROM drawn GROUP BY rep)"


oracle("dynamics_subject_interval", subject_interval(1000), "estimate ci_low ci_high", maes=MAES, drawn=draws("maes", "patient_id", 1000))
oracle("backtest_job", f"SELECT * FROM (SELECT variant, {AGREE_SQL} FROM errors WHERE variant='full_dynamics' GROUP BY variant) CROSS JOIN (SELECT estimate AS subject_estimate, ci_low AS subject_ci_low, ci_high AS subject_ci_high, replicates AS subject_replicates FROM ({subject_interval(1000)}))",
       AGREE + " subject_estimate subject_ci_low subject_ci_high", maes=MAES, drawn=draws("maes", "patient_id", 1000))
