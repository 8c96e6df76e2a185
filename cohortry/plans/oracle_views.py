"""The same views as SQL common table expressions, written independently of the DataFrame code."""

from __future__ import annotations

import re

from cohortry.fixed import ARMS, CURATED, FEATURE_BLOCKS
from cohortry.plans.views import BCLC, CLINICAL, RACES, STRATEGY_OF_ARM


def u(salt: str, key: str) -> str:
    return f"(('0x'||substr(md5(concat('{salt}','|',{key})),1,8))::BIGINT/4294967296.0::DOUBLE)"


def quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def cls(t: str = "t") -> str:
    return " + ".join(f"({t}>={c})::INT" for c in (6, 12, 24, 36, 48, 60, 72))


def bumps(z: str) -> str:
    raw = [f"exp(-abs({k}.5::DOUBLE-{z}))" for k in range(8)]
    return "[" + ", ".join(raw) + "]"


def _clinical() -> str:
    cols = []
    for name, kind, low, span in CLINICAL:
        r = u(name, "row_id")
        value = f"{low}::DOUBLE+{span}::DOUBLE*{r}" if kind == "num" else f"floor({low}::DOUBLE+{span}::DOUBLE*{r})" if kind == "int" \
            else f"({r}<{low}::DOUBLE)::INT::DOUBLE"
        cols.append(f"CASE WHEN {u('na_' + name, 'row_id')}>=0.1::DOUBLE THEN {value} END AS {name}")
    def pick(values, salt):
        return f"({quoted(values)})[floor({u(salt, 'row_id')}*{len(values)})::INT+1]"
    flags = {"treatment_resection": 1, "treatment_tace": 2, "treatment_rfa": 3, "treatment_sorafenib": 4, "treatment_combo": 5}
    late = [f"CASE WHEN {u('na_' + n, 'row_id')}>=0.1::DOUBLE THEN (act={a})::INT::DOUBLE END AS {n}" for n, a in flags.items()]
    return f"""SELECT c.*, CASE WHEN row_id%2=1 THEN ' '||upper(({quoted(ARMS)})[act+1]) ELSE ({quoted(ARMS)})[act+1] END AS index_treatment_action,
      CASE WHEN {u('na_strategy', 'row_id')}>=0.2::DOUBLE THEN ({quoted(STRATEGY_OF_ARM)})[act+1] ELSE 'unknown' END AS surgical_strategy, {', '.join(late)}
      FROM (SELECT row_id, patient_id, t, event, {', '.join(cols)},
        CASE WHEN {u('na_race', 'row_id')}>=0.1::DOUBLE THEN {pick(RACES, 'race')} END AS race,
        CASE WHEN {u('na_bclc', 'row_id')}>=0.1::DOUBLE THEN {pick(BCLC, 'bclc')} END AS bclc_stage,
        floor({u('action', 'row_id')}*6)::INT AS act FROM cohort) c"""


def _curated() -> str:
    b = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(0, least(1, {c})) END"
    tr = lambda c: f"coalesce(({c})::INT, 0)::DOUBLE"
    kn = lambda c, k: f"CASE WHEN {k} THEN (({c})::INT)::DOUBLE END"
    bclc = "(CASE trim(lower(bclc_stage)) WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END)"
    surg = lambda flag, pat: f"coalesce({flag}, coalesce(regexp_matches(lower(surgical_strategy),'{pat}'), false)::INT::DOUBLE)"
    null = "NULL::DOUBLE"
    e = {
        "age": "age", "age_ge_65": tr("age>=65"), "sex_male": b("sex_male"), "year_of_diagnosis_scaled": "(year_of_diagnosis-2008)/14.0::DOUBLE",
        "race_asian": "coalesce(regexp_matches(lower(race),'asian'),false)::INT::DOUBLE",
        "race_other": "coalesce(regexp_matches(lower(race),'other|black|white|unknown'),false)::INT::DOUBLE",
        "nbnc": "(coalesce(hbv_positive,0)=0 AND coalesce(hcv_positive,0)=0)::INT::DOUBLE", "alcohol_related": "alcohol_use",
        "log_afp": "CASE WHEN afp IS NOT NULL THEN ln(1+greatest(afp,0)) END", "platelets": "platelet", "neutrophil_lymphocyte_ratio": "nlr",
        "liver_recovery_score": "CASE WHEN age IS NOT NULL THEN least(1,greatest(0, 1.0::DOUBLE-0.01::DOUBLE*greatest(age-50,0)-0.2::DOUBLE*coalesce(cirrhosis,0))) END",
        "log_tumor_size": "CASE WHEN tumor_size_cm IS NOT NULL THEN ln(1+greatest(tumor_size_cm,0)) END", "bclc_stage": bclc + "::DOUBLE",
        "planned_margin_risk": "anticipated_margin_risk", "systemic_agents": null, "treatment_no_resection": surg(null, "none|no"),
        "treatment_ablation": surg(null, "ablation|rfa"), "treatment_resection": surg("treatment_resection", "resection"),
        "tumor_number_gt3": tr("lesion_count>3"), "size_gt5": tr("tumor_size_cm>5"), "afp_gt400": kn("afp>400", "afp IS NOT NULL"),
        "resection_eligible": kn("ajcc_stage<=2 AND child_pugh_b_or_c=0 AND tumor_size_cm<=5",
                                 "ajcc_stage IS NOT NULL AND child_pugh_b_or_c IS NOT NULL AND tumor_size_cm IS NOT NULL"),
        "comorbidity_count_ge2": kn("comorbidity_count>=2", "comorbidity_count IS NOT NULL"),
        **{f"stage_{s}": tr(f"ajcc_stage={n}") for s, n in (("i", 1), ("ii", 2), ("iii", 3), ("iv", 4))},
        **{f"bclc_{s}": tr(f"{bclc}={n}") for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4))},
    }
    return "SELECT row_id, " + ", ".join(f"{e.get(n, n)} AS {n}" for n in CURATED) + " FROM clinical"


def _state() -> str:
    block = {k: CURATED[a:b] for k, (a, b) in FEATURE_BLOCKS.items()}
    def chunks(k, sizes):
        out, at = [], 0
        for s in sizes:
            out.append("(" + "+".join(block[k][at:at + s]) + f")/{s}.0::DOUBLE")
            at += s
        return out
    dem, hep = chunks("dem", [2] * 4), chunks("hep", [3, 3])
    tum3, lab3 = chunks("tum", [6, 5, 5]), chunks("lab", [5, 5, 5])
    tum5, lab7, trt, fu = chunks("tum", [4, 3, 3, 3, 3]), chunks("lab", [3] + [2] * 6), chunks("trt", [3] + [2] * 5), chunks("fu", [3, 2, 2, 2])
    named = {f"a{i}": x for i, x in enumerate(dem + hep + tum3 + lab3)}
    named |= {f"b{i}": x for i, x in enumerate(tum5)} | {f"c{i}": x for i, x in enumerate(lab7)}
    named |= {f"d{i}": x for i, x in enumerate(trt)} | {f"e{i}": x for i, x in enumerate(fu)}
    mean = "(" + "+".join(f"c{i}" for i in range(7)) + ")/7.0::DOUBLE"
    final = [f"a{i}" for i in range(12)] + [f"b{i}" for i in range(5)] + ["sqrt(" + "+".join(f"b{i}*b{i}" for i in range(5)) + ")"]
    final += [f"c{i}" for i in range(7)] + [mean] + [f"d{i}" for i in range(6)]
    final += ["tanh(b0-c0)", f"tanh({mean})", "tanh(d1+d2+d3+d4+d5)", "1.0::DOUBLE"]
    final += [f"e{i}" for i in range(4)] + ["abs(b0)", "abs(b1)", "abs(c0)", "abs(c1)", "d0", "d1"]
    inner = ", ".join(f"{x} AS {n}" for n, x in named.items())
    return "SELECT row_id, " + ", ".join(f"{x} AS s{i}" for i, x in enumerate(final)) + f" FROM (SELECT row_id, {inner} FROM scaled)"


def scale(c: str) -> str:
    """Standardise over the whole view; a constant column keeps scale 1."""
    return f"({c}-avg({c}) OVER ())/CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () ELSE 1 END"


STATE = [f"s{i}" for i in range(46)]

VIEWS = {
    "cohort": """SELECT o_orderkey AS row_id, o_custkey AS patient_id, date_diff('day', o_orderdate, coalesce(nx, mx))::DOUBLE/7 AS t,
      (nx IS NOT NULL)::INT AS event, substr(o_orderpriority,1,1)::INT-1 AS arm, o_totalprice/1e5 AS x1, c_acctbal/1e4 AS x2
      FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx, max(o_orderdate) OVER () AS mx
            FROM orders) JOIN customer ON c_custkey=o_custkey""",
    "labelled": f"SELECT *, CASE WHEN event=0 AND t<72 THEN NULL ELSE cls END AS label FROM (SELECT *, {cls()} AS cls FROM cohort)",
    "predictions": f"""SELECT * EXCLUDE (rp, rq), [v/list_sum(rp) for v in rp] AS p, [v/list_sum(rq) for v in rq] AS q FROM (
      SELECT *, {bumps('zp')} AS rp, {bumps('zq')} AS rq FROM (
        SELECT *, 8e0*(0.6::DOUBLE*least(t,90)/90e0+0.4::DOUBLE*{u('p', 'row_id')}) AS zp,
                  8e0*(0.3::DOUBLE*least(t,90)/90e0+0.7::DOUBLE*{u('q', 'row_id')}) AS zq FROM labelled))""",
    "clinical": _clinical(),
    "curated": _curated(),
    "imputed": "SELECT row_id, " + ", ".join(f"coalesce({n}, coalesce(median({n}) OVER (), 0)) AS {n}" for n in CURATED) + " FROM curated",
    "scaled": "SELECT row_id, " + ", ".join(f"{scale(n)} AS {n}" for n in CURATED) + " FROM imputed",
    "raw_state": _state(),
    "state": "SELECT row_id, " + ", ".join(f"{scale(s)} AS {s}" for s in STATE) + " FROM raw_state",
    "acted": "SELECT row_id, list_position(['none','resection','tace','rfa','sorafenib','combo'], lower(trim(index_treatment_action)))-1 AS arm FROM clinical",
    # distinct times with leaving counts and the risk set
    "steps": "SELECT t, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS at_risk, count(*) AS n, sum(event) AS deaths, sum(1-event) AS censored FROM cohort GROUP BY t",
    "curve": """SELECT t, n, product(1-censored/at_risk) OVER (ORDER BY t) AS g_at,
      coalesce(product(1-censored/at_risk) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g_before FROM steps""",
    "vectors": "SELECT vec_id, label, [v::DOUBLE for v in embedding] AS x FROM embeddings",
    "attributed": "SELECT *, [" + ", ".join(f"x[{i + 1}]*{u(f'attr{i}', 'vec_id')}" for i in range(64)) + "] AS attr FROM vectors",
    "monitor_rows": "SELECT event_id, ts, event_type, value/250 AS residual FROM events",
    "intervals": f"""SELECT event_id, user_id AS patient_id, 0.0::DOUBLE AS start_month, dt AS end_month,
      least(0.5::DOUBLE+value/25, 19.9::DOUBLE) AS d0, least(0.5::DOUBLE+nv/25, 19.9::DOUBLE) AS d1, 0.05::DOUBLE*{u('g', 'event_id')} AS growth, 0.02::DOUBLE*{u('s', 'event_id')} AS shrink,
      least(value/400,1) AS f0, least(nv/400,1) AS f1, 0.01::DOUBLE*{u('ka', 'event_id')} AS ka, 0.01::DOUBLE*{u('kt', 'event_id')} AS kt,
      0.01::DOUBLE*{u('kr', 'event_id')} AS kr, {u('rec', 'event_id')} AS rec, ({u('act', 'event_id')}<0.5::DOUBLE)::INT AS act, dt
      FROM (SELECT *, (epoch_us(nt)/1e6 - epoch_us(ts)/1e6)/86400e0 AS dt FROM (
        SELECT *, lead(ts) OVER w AS nt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nt IS NOT NULL) WHERE dt>0""",
    "errors": """SELECT i.*, v.variant,
      CASE WHEN v.tum THEN least(20, greatest(0, d0*exp(growth*ln(20e0/d0)*dt)-shrink*d0*dt)) ELSE d0 END - d1 AS e_t,
      CASE WHEN v.fib THEN least(1, greatest(0, f0+(ka+kt*act-kr*rec)*dt)) ELSE f0 END - f1 AS e_f
      FROM intervals i CROSS JOIN (VALUES ('static_only',false,false),('gompertz_only',true,false),('fibrosis_only',false,true),('full_dynamics',true,true)) v(variant,tum,fib)""",
    "log_entries": """SELECT 'c'||conv_id AS chain_id, turn AS seq,
      '{"chain_id":"c'||conv_id||'","payload":{"digest":"'||sha256(role||'|'||text)||'","role":"'||role||'"},"ts":'||turn||'}' AS body FROM conversations""",
    "exposed": "SELECT *, (t>24)::INT::DOUBLE AS y, ((event=1 AND t<=24) OR t>=24) AS observed, [" + ", ".join(
        f"exp({0.1 * k:.17g}::DOUBLE*x1-{0.05 * k:.17g}::DOUBLE*x2)" for k in range(5)) + "] AS re, [" + ", ".join(
        f"1/(1+exp(-({-1.0 + 0.2 * k:.17g}::DOUBLE+0.3::DOUBLE*x1)))" for k in range(5)) + "] AS m FROM cohort",
    "compared": """SELECT *, CASE WHEN support AND arm=action THEN 1/e_a WHEN support AND arm=0 THEN 1/e_r ELSE 0 END AS iptw,
      m_a + CASE WHEN arm=action THEN (y-m_a)/e_a ELSE 0 END AS psi_a, m_r + CASE WHEN arm=0 THEN (y-m_r)/e_r ELSE 0 END AS psi_r FROM (
      SELECT *, (e_a>=0.05::DOUBLE AND e_a<=0.95::DOUBLE AND e_r>=0.05::DOUBLE AND e_r<=0.95::DOUBLE) AS support FROM (
      SELECT x.*, a.action, re[a.action+1]/list_sum(re) AS e_a, re[1]/list_sum(re) AS e_r, m[a.action+1] AS m_a, m[1] AS m_r
      FROM exposed x CROSS JOIN (SELECT unnest([1,2,3,4]) AS action) a WHERE x.observed))""",
}


def sql(body: str, doubles: str = "", extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Query with the views it mentions; the named double columns are rounded as the DataFrame results are."""
    views = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b", text) and name not in needed:
                visit(views[name].replace(f"FROM {name} ", "FROM __self__ ") if recursive else views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    names = doubles.split()
    head = "SELECT * REPLACE (" + ", ".join(f"round({n},6)+0e0 AS {n}" for n in names) + f") FROM ({body})" if names else body
    if not needed:
        return head
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS {'MATERIALIZED ' if n in VIEWS else ''}({views[n]})" for n in needed) + " " + head
