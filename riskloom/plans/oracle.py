"""SQL twins of the registered queries, in the dialect of the checking engine."""

from __future__ import annotations

import math

from riskloom.operators import resampling
from riskloom.plans import catalog
from riskloom.sources import stand_ins as si

_APP = """
li as (
  select l_orderkey, max(l_shipdate) last_ship, sum(l_quantity) qty, count(*) n_lines,
         max(case when l_returnflag = 'R' then l_discount end) disc_r
  from lineitem group by l_orderkey),
app as (
  select o_orderkey app_id, strftime(o_orderdate, '%b-%Y') issue_d, strftime(last_ship, '%b-%Y') last_pymnt_d,
         strftime(cast(coalesce(last_ship, o_orderdate) as date) + to_months(cast(o_orderkey % 5 as integer)), '%b-%Y') last_credit_pull_d,
         case o_orderstatus when 'F' then 'Charged Off' when 'P' then 'Late (31-120 days)' else 'Current' end loan_status,
         o_totalprice loan_amnt, c_acctbal annual_inc, qty dti, disc_r,
         600.0::double + (o_custkey * 37) % 250 fico_range_low, c_mktsegment home_ownership, o_orderpriority purpose,
         case when n_lines >= 4 then '60 months' else '36 months' end term,
         case when c_nationkey = 1 then '< 1 year' when c_nationkey = 2 then '1 year'
              when c_nationkey between 3 and 10 then cast(c_nationkey - 1 as varchar) || ' years'
              when c_nationkey > 10 then '10+ years' end emp_length,
         cast((o_orderkey * 7919) % 1000 as double) / 1000 u
  from orders join customer on o_custkey = c_custkey left join li on l_orderkey = o_orderkey),
dated as (
  select *, cast((year(last_pymnt_dt) - year(issue_dt)) * 12 + month(last_pymnt_dt) - month(issue_dt) as integer) m
  from (select *, cast(try_strptime(issue_d, '%b-%Y') as date) issue_dt,
               cast(try_strptime(last_pymnt_d, '%b-%Y') as date) last_pymnt_dt,
               cast(try_strptime(last_credit_pull_d, '%b-%Y') as date) pull_dt from app)),
cohort as (
  select *, cast(case when loan_status = 'Charged Off' and (m is null or m <= 8) then 1 else 0 end as integer) y
  from dated where issue_dt between date '1996-01-01' and date '1997-12-31')
"""


def _band(col: str, spec) -> str:
    edges, labels = spec
    arms = [f"when {col} < {edges[0]} then null"]
    for upper, label in zip(edges[1:], labels):
        test = f"{col} is not null" if math.isinf(upper) else f"{col} <= {upper}"
        arms.append(f"when {test} then '{label}'")
    return "case " + " ".join(arms) + " end"


_EMP = ("case when emp_length is null then 'not stated' when emp_length in ('< 1 year','1 year','2 years','3 years') "
        "then '0-3 years' when emp_length = '10+ years' then '10+ years' else '4-9 years' end")

_SCORED = f"""
scored0 as (
  select *, round(0.5::double*u + 0.5::double*(case when home_ownership in ('BUILDING','MACHINERY') then 1 else 0 end)*u + 0.2::double*y*u, 6) p from cohort),
scored as (
  select *, round(0.7::double*p + 0.3::double*u, 6) p2, {_EMP} employment, {_band('annual_inc', si.INCOME_BANDS)} income_band,
         {_band('fico_range_low', si.SCORE_BANDS)} score_band, {_band('dti', si.DTI_BANDS)} dti_band
  from scored0)
"""


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def _on(body: str, *ctes: str) -> str:
    """Query over applications and cohort."""
    return _sql(body, _APP, *ctes)


def _sc(body: str, *ctes: str) -> str:
    """Query over the scored cohort."""
    return _sql(body, _APP, _SCORED, *ctes)


_RANKED = """
rk as (select *, row_number() over (order by p desc, app_id) rank, count(*) over () n,
              sum(y) over () n_pos from scored)
"""

_K = "round_even(n * {share}::double, 0)"

# Generic metric block over src(g, app_id, y, p), g any text group.
_METRICS = """
mr as (select g, app_id, y, p, row_number() over (partition by g order by p desc, app_id) rank,
              count(*) over (partition by g) n, sum(y) over (partition by g) n_pos from src),
mcum as (select *, sum(y) over (partition by g order by rank) cp, rank - sum(y) over (partition by g order by rank) cn from mr),
mconf as (
  select g, count(*) n, cast(sum(y) as bigint) n_def, count(*) filter (where rank <= round_even(n * 0.1::double, 0)) k,
         count(*) filter (where rank <= round_even(n * 0.1::double, 0) and y = 1) tp,
         count(*) filter (where rank <= round_even(n * 0.1::double, 0) and y = 0) fp,
         count(*) filter (where rank > round_even(n * 0.1::double, 0) and y = 1) fn,
         count(*) filter (where rank > round_even(n * 0.1::double, 0) and y = 0) tn
  from mr group by g),
mtie as (select g, p, sum(y)::double pos, sum(1 - y)::double neg from src group by g, p),
mauc as (
  select g, sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0) auc
  from (select *, sum(neg) over (partition by g order by p rows between unbounded preceding and 1 preceding) below from mtie)
  group by g),
mks as (select g, max(cast(cp as double) / n_pos - cast(cn as double) / (n - n_pos)) ks from mcum group by g),
metrics as (
  select g, n, n_def, k, tp, fp, fn, tn, tp / nullif(tp + fn, 0)::double recall, tp / nullif(tp + fp, 0)::double "precision",
         tp / nullif(tp + fn, 0)::double / 0.1::double lift, auc, 2 * auc - 1 gini, ks * 100 ks
  from mconf join mauc using (g) join mks using (g))
"""
_METRIC_COLS = ('n, n_def, k, tp, fp, fn, tn, round(recall, 6) recall, round("precision", 6) "precision", round(lift, 6) lift, '
                "round(auc, 6) auc, round(gini, 6) gini, round(ks, 6) ks")


def _split(src: str = "cohort") -> str:
    """Exact stratified piles of ``src`` into ``piled``."""
    return f"""
hs as (select *, md5('42|' || cast(app_id as varchar)) h from {src}),
cls as (select y, count(*) nc from hs group by y),
tot as (select sum(nc) n, ceil(0.2::double * sum(nc)) n_test from cls),
r1 as (select y, nc, floor(nc * (n - n_test) / n::double) fl, nc * (n - n_test) / n::double - floor(nc * (n - n_test) / n::double) fr,
              n - n_test n_rest from cls, tot),
r2 as (select *, fl + case when row_number() over (order by fr desc, cast(y as varchar)) <= n_rest - sum(fl) over () then 1 else 0 end rest from r1),
t1 as (select *, ceil(0.25::double * n_rest) n_val from r2),
t2 as (select *, floor(rest * (n_rest - n_val) / n_rest::double) fl2,
              rest * (n_rest - n_val) / n_rest::double - floor(rest * (n_rest - n_val) / n_rest::double) fr2 from t1),
quota as (select y, nc - rest q_test, rest - (fl2 + case when row_number() over (order by fr2 desc, cast(y as varchar)) <= n_rest - n_val - sum(fl2) over () then 1 else 0 end) q_val from t2),
piled as (
  select *, case when pos <= q_test then 'test' when pos <= q_test + q_val then 'val' else 'train' end pile
  from (select hs.*, row_number() over (partition by y order by h) pos from hs) join quota using (y))
"""


def _null_rates(cols: list[str], src: str = "cohort") -> str:
    return "nr as (" + " union all ".join(
        f"select '{c}' \"column\", count(*) n, count(*) filter (where {c} is null) n_null from {src}" for c in cols) + ")"


def _psi(numeric: list[str], text: list[str], src: str = "sides", key: str = "even") -> str:
    """PSI of ``src`` columns, the boolean ``key`` marking the expected side, into ``psi(feature, psi)``."""
    parts = []
    for c in numeric:
        probs = ", ".join(f"{i / 10}::double" for i in range(11))
        parts.append(f"""
select feature, sum(case when te > 0 and ta > 0 then (greatest(a / nullif(ta, 0), 1e-6) - greatest(e / nullif(te, 0), 1e-6))
       * ln(greatest(a / nullif(ta, 0), 1e-6) / greatest(e / nullif(te, 0), 1e-6)) end) psi
from (select feature, b, coalesce(e, 0)::double e, coalesce(a, 0)::double a, sum(coalesce(e, 0)) over ()::double te, sum(coalesce(a, 0)) over ()::double ta
  from (select '{c}' feature, unnest(range(0, greatest(len(ed) - 1, 1))) b from
         (select list_sort(list_distinct(quantile_cont({c}::double, [{probs}]))) ed from {src} where {key}))
  left join (select case when len(ed) < 3 then 0 else len(list_filter(ed[2:len(ed) - 1], lambda t: t <= {c})) end b,
       count(*) filter (where {key}) e, count(*) filter (where not {key}) a
     from {src}, (select list_sort(list_distinct(quantile_cont({c}::double, [{probs}]))) ed from {src} where {key})
     where {c} is not null group by 1) using (b)) group by feature""")
    for c in text:
        parts.append(f"""
select '{c}' feature, sum((greatest(a / ta, 1e-6) - greatest(e / te, 1e-6)) * ln(greatest(a / ta, 1e-6) / greatest(e / te, 1e-6))) psi
from (select e::double e, a::double a, sum(e) over ()::double te, sum(a) over ()::double ta from
  (select {c}, count(*) filter (where {key}) e, count(*) filter (where not {key}) a from {src} where {c} is not null group by {c}))""")
    return "psi as (" + "\nunion all ".join(parts) + ")"


_SIDES = "sides as (select *, app_id % 2 = 0 even from cohort)"


def _audit(segments: list[str], src: str = "scored", by: str = "'all'", score: str = "p") -> str:
    rows = " union all ".join(f"select v, y, reviewed, '{s}' segment, {s} grp from fl" for s in segments)
    return f"""
fl as (select *, rank <= round_even(n * 0.1::double, 0) reviewed from
  (select *, {by} v, row_number() over (partition by {by} order by {score} desc, app_id) rank, count(*) over (partition by {by}) n from {src})),
sg as ({rows}),
aud as (
  select v, segment, grp, count(*) people, count(*) filter (where y = 1) defaults,
         count(*) filter (where y = 1) / count(*)::double base_rate,
         count(*) filter (where y = 1 and reviewed) / nullif(count(*) filter (where y = 1), 0)::double recall,
         count(*) filter (where reviewed) / count(*)::double flag_rate,
         count(*) filter (where y = 0 and reviewed) / nullif(count(*) filter (where y = 0), 0)::double fpr
  from sg where grp is not null group by v, segment, grp having count(*) filter (where y = 1) >= {catalog.MIN_DEFAULTS}),
hi as (select * from (select *, row_number() over (partition by v, segment order by flag_rate desc, grp desc) i from aud) where i = 1),
lo as (select * from (select *, row_number() over (partition by v, segment order by flag_rate, grp) i from aud) where i = 1),
ext as (select hi.v, hi.segment, hi.grp most_flagged, lo.grp least_flagged, hi.base_rate hb, lo.base_rate lb, hi.flag_rate hf,
               lo.flag_rate lf, hi.fpr hp, lo.fpr lp, hi.recall hr, lo.recall lr
        from hi join lo on hi.v = lo.v and hi.segment = lo.segment)
"""


def _inventory() -> str:
    pol = si.application_policy()
    rows = []
    for name, g in pol.groups.items():
        for c in g.columns:
            meaning = si.MEANINGS.get(c, "")
            pct = f"(select round_even(100.0::double * (count(*) filter (where {c} is null) / count(*)::double), 2) from cohort)"
            if g.status == "DROP":
                what = "'-'"
            elif g.status == "USED FOR TARGET":
                what = "'target source, then dropped'"
            elif c in pol.unknown_text:
                what = "'blank becomes Unknown'"
            elif c in pol.categorical:
                what = "'one-hot'"
            elif c in pol.flagged:
                what = "'flag and train median'"
            elif c in pol.median_only:
                what = "'train median, too few blanks to flag'"
            else:
                what = f"case when {pct} > 0 then 'train median' else 'as is' end"
            rows.append(f"select '{c}' \"column\", '{meaning}' meaning, '{g.status}' status, '{g.reason}' why, {pct} pct_blank, "
                        f"{what} what_we_do, '{name}' \"group\"")
    return "inv as (" + " union all ".join(rows) + ")"


_DOCS = """
known as (select * from documents where doc_id in (select doc_id from labels)),
rest as (select * from documents where doc_id not in (select doc_id from labels))
"""


def _shaped(src: str) -> str:
    return (f"select lang, source, lang || '/' || source pair, lang || '/' || cast(cast(floor(n_chars / 1000) as integer) as varchar) size from {src}")


def _long(src: str) -> str:
    return " union all ".join(f"select '{c}' \"column\", {c} value from ({_shaped(src)})" for c in ("lang", "source", "pair", "size"))


def _constants() -> str:
    """Preparation constants of the train pile: nums(column, median, mean, scale) and cats(column, value)."""
    nums = " union all ".join(
        f"select '{c}' \"column\", md \"median\", avg(coalesce({c}::double, md)) mean, "
        f"case when stddev_pop(coalesce({c}::double, md)) = 0 then 1 else stddev_pop(coalesce({c}::double, md)) end scale "
        f"from train, (select quantile_cont({c}::double, 0.5) md from train) group by md" for c in si.NUMERIC)
    cats = " union all ".join(f"select distinct '{c}' \"column\", coalesce({c}, 'Unknown') value from train" for c in si.CATEGORICAL)
    return f"train as (select * from piled where pile = 'train'), nums as ({nums}), cats as ({cats})"


def _prepared() -> str:
    parts = [f"select app_id, '{c}' feature, (coalesce({c}::double, \"median\") - mean) / scale value from piled, nums where \"column\" = '{c}'"
             for c in si.NUMERIC]
    parts += [f"select app_id, '{c}_missing' feature, case when {c} is null then 1.0 else 0.0 end::double value from piled" for c in si.FLAGGED]
    parts += [f"select app_id, '{c}_' || c.value feature, case when coalesce({c}, 'Unknown') = c.value then 1.0 else 0.0 end::double value "
              f"from piled, (select value, row_number() over (order by value) i from cats where \"column\" = '{c}') c where i > 1" for c in si.CATEGORICAL]
    return "select app_id, feature, round(value, 6) value from (" + " union all ".join(parts) + ")"


def _linear() -> str:
    enc = {c: f"coalesce({c}, 0)::double" for c in ("loan_amnt", "dti", "disc_r", "fico_range_low")}
    enc |= {f"purpose_{v}": f"case when purpose = '{v}' then 1.0 else 0.0 end::double" for v in ("2-HIGH", "5-LOW")}
    rows = " union all ".join(
        f"select app_id, '{f}' feature, {b}::double * ({enc[f]} - (select avg({enc[f]}) from cohort)) phi from cohort"
        for f, b in catalog.COEFFICIENTS.items())
    return f"""select app_id, place, feature, round(phi, 6) phi, direction from (
  select *, cast(row_number() over (partition by app_id order by abs(phi) desc, feature) as integer) place,
         case when phi > 0 then 'up' else 'down' end direction from ({rows})) where place <= 3"""


def _capacity_rows(shares, body: str) -> str:
    return " union all ".join(body.format(share=s, k=_K.format(share=s)) for s in shares)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    r = "round({0}, 6) {0}".format

    q["cohort_filter"] = _on("select app_id, issue_dt, last_pymnt_dt from cohort")
    q["orig_year_counts"] = _on("""select cast(year(issue_dt) as integer) issue_year, count(*) n, year(issue_dt) in (1996, 1997) in_cohort
        from dated group by year(issue_dt)""")
    q["snapshot_date"] = _on("""select count(*) total_rows, cast(min(year(issue_dt)) as integer) first_year, cast(max(year(issue_dt)) as integer) last_year,
        max(pull_dt) snapshot_dt, count(*) filter (where year(issue_dt) in (1996, 1997)) cohort_rows, strftime(max(pull_dt), '%b %Y') snapshot from dated""")
    q["month_periods"] = _on("""select app_id, issue_dt issue_month, cast(year(issue_dt) as integer) issue_year, strftime(issue_dt, '%Y-%m') period,
        strftime(issue_dt, '%b %Y') display from dated""")
    q["month_gap"] = _on("select app_id, m from dated")
    gaps = """gp as (select *, cast((year(s) - year(last_pymnt_dt)) * 12 + month(s) - month(last_pymnt_dt) as integer) gap_global,
        cast((year(pull_dt) - year(last_pymnt_dt)) * 12 + month(pull_dt) - month(last_pymnt_dt) as integer) gap_own
        from cohort, (select max(pull_dt) s from cohort))"""
    q["month_gap_two_anchors"] = _on("select app_id, gap_global, gap_own from gp", gaps)
    q["label_rule"] = _on("select app_id, y from cohort")
    q["label_status_counts"] = _on("select loan_status, count(*) n, loan_status in ('Charged Off', 'Default') counts_as_failed from cohort group by loan_status")
    q["label_summary"] = _on("""select n, n_failed, n_target, n_never_paid_failed, n_failed - n_target n_failed_later, round(n_failed / n::double, 6) failed_rate,
        round(n_target / n::double, 6) target_rate, round((n - n_target)::double / greatest(n_target, 1), 6) class_ratio
        from (select count(*) n, count(*) filter (where loan_status = 'Charged Off') n_failed, cast(sum(y) as bigint) n_target,
              count(*) filter (where loan_status = 'Charged Off' and m is null) n_never_paid_failed from cohort)""")
    q["label_sensitivity"] = _on("""select cutoff, 12 - cutoff implied_lag, defaults, round(defaults / n::double, 6) rate,
        round((defaults - base) / n::double * 100, 6) delta_pp from (
        select c.cutoff, count(*) n, count(*) filter (where loan_status = 'Charged Off' and (m is null or m <= c.cutoff)) defaults, cast(sum(y) as bigint) base
        from cohort, (values (8), (9), (12)) c(cutoff) group by c.cutoff)""")
    ladder = " union all ".join(
        f"""select '{name}' anchor, loan_status, pos "position", count({g}) n, count(app_id) n_rows,
        round(quantile_cont({g}, 0.25)::double, 6) p25, round(quantile_cont({g}, 0.5)::double, 6) "median", round(quantile_cont({g}, 0.75)::double, 6) p75, round(avg({g}), 6) mean
        from (values ('Current', 1), ('Late (31-120 days)', 2), ('In Grace Period', 3)) s(loan_status, pos) left join gp using (loan_status) group by loan_status, pos"""
        for name, g in (("snapshot", "gap_global"), ("own pull", "gap_own"), ("issue", "m")))
    q["lag_ladder"] = _on(ladder, gaps)
    cases = [("failed early", "loan_status = 'Charged Off' and m <= 8"), ("failed late", "loan_status = 'Charged Off' and m > 15"),
             ("still paying", "loan_status = 'Current'"), ("never paid", "loan_status = 'Charged Off' and m is null")]
    q["example_per_case"] = _on(" union all ".join(
        f"(select '{n}' example, app_id, issue_d, last_pymnt_d, loan_status, m, y from cohort where {c} order by app_id limit 1)" for n, c in cases))

    q["dq_clear"] = _on("select app_id, case when annual_inc < 0 then null else annual_inc end annual_inc, case when dti > 250 then null else dti end dti from cohort")
    q["dq_clear_counts"] = _on("""select 'annual_inc' "column", count(*) filter (where annual_inc < 0) n_cleared from cohort
        union all select 'dti', count(*) filter (where dti > 250) from cohort""")
    q["missing_flags"] = _on("select app_id, cast(dti is null as integer) dti_missing, cast(disc_r is null as integer) disc_r_missing from cohort")
    q["flag_eligibility"] = _on("""select "column", round(n_null / n::double, 6) null_rate, n_null / n::double >= 0.005 eligible from nr""", _null_rates(si.NUMERIC))
    q["regroup_case"] = _on(f"select app_id, {_EMP} employment from app")
    q["right_closed_bands"] = _on(f"""select app_id, {_band('annual_inc', si.INCOME_BANDS)} income_band, {_band('dti', si.DTI_BANDS)} dti_band,
        {_band('fico_range_low', si.SCORE_BANDS)} score_band from app""")
    q["unknown_fill"] = _on("select app_id, coalesce(emp_length, 'Unknown') emp_length from app")
    q["text_scalars"] = _on("""select app_id, replace('purpose_' || lower(purpose), '_', ' ') pretty, home_ownership sentence, substr(loan_status, 1, 6) clipped,
        cast(fico_range_low as integer) fico_int from app""")
    q["math_scalars"] = _on("""select app_id, abs(annual_inc) abs_inc, round(sqrt(abs(annual_inc)), 6) root, round(ln(greatest(annual_inc, 1e-6)), 6) log_floor,
        round(1 / (1 + exp(-(annual_inc / 10000))), 6) sigmoid, cast(round_even(loan_amnt / 1000, 0) as bigint) thousands,
        round(loan_amnt / nullif(dti - 100, 0), 9) ratio from app""")

    feats = ", ".join(si.application_policy().features())
    q["policy_projection"] = _on(f"select {feats}, y from cohort")
    q["policy_gaps"] = _on("select 'u' \"column\", 'unclassified' problem, count(u) n_filled from app")
    roles = [(c, "numeric") for c in ("loan_amnt", "annual_inc", "dti", "fico_range_low", "disc_r")] + \
            [(c, "categorical") for c in si.CATEGORICAL]
    q["column_roles"] = _on(" union all ".join(f"select '{c}' \"column\", '{k}' role, count(*) filter (where {c} is null) n_null from cohort" for c, k in roles)
                            + " union all select 'disc_r_missing', 'flags', 0")
    q["null_rates"] = _on('select "column", n, n_null, round(n_null / n::double, 6) null_rate from nr', _null_rates(catalog.PROFILED))
    q["complete_columns"] = _on("select count(*) filter (where n_null = 0) n_complete, count(*) n_columns from nr", _null_rates(catalog.PROFILED))
    q["missing_bands"] = _on("""select "column", case when r > 0.9 then 'almost entirely empty' when r > 0.5 then 'mostly empty' when r > 0.2 then 'substantially missing'
        when r > 0.01 then 'some missing' else 'trace missing' end band, round(r, 6) null_rate from (select *, n_null / n::double r from nr) where r > 0.00001""",
                             _null_rates(catalog.PROFILED))
    sig = " union all ".join(f"select '{c}' \"column\", avg(case when {c} is null then y end) a, avg(case when {c} is not null then y end) b, "
                             f"avg(cast({c} is null as integer)) r from cohort" for c in catalog.PROFILED)
    q["missing_signal"] = _on(f"""select "column", round(a, 6) rate_missing, round(b, 6) rate_present, round(a - b, 6) gap from ({sig})
        where r > 0.005 and r < 0.98 order by abs(a - b) desc, "column" limit 12""")
    q["joint_missing"] = _on("""select *, all_missing = any_missing identical from (
        select count(*) filter (where dti is null and last_pymnt_d is null and disc_r is null) all_missing,
               count(*) filter (where dti is null or last_pymnt_d is null or disc_r is null) any_missing from cohort)""")
    q["missing_by_month"] = _on("""select strftime(issue_dt, '%Y-%m') "month", count(*) n, round(avg(cast(disc_r is null as integer)), 6) disc_r_missing_rate,
        round(avg(cast(dti is null as integer)), 6) dti_missing_rate from cohort group by 1""")
    q["column_inventory"] = _on("select * from inv", _inventory())
    q["treatment"] = _on('select "column", what_we_do from inv', _inventory())
    q["inventory_rollup"] = _on("select status, split_part(why, '.', 1) why, count(*) n_columns from inv group by 1, 2", _inventory())
    q["kept_with_blanks"] = _on('select "column", pct_blank, what_we_do from inv where status = \'KEEP\' and pct_blank > 0', _inventory())
    q["quantile_scan"] = _sc(" union all ".join(
        f"select '{c}' \"column\", {p}::double q, round(quantile_cont({c}, {p})::double, 6) value from scored"
        for c in ("p", "dti", "loan_amnt") for p in (0.5, 0.9, 0.99, 0.999, 1.0)))
    q["placeholder_counts"] = _on("""select 'dti at least 100' test, count(*) filter (where dti >= 100) n from cohort
        union all select 'dti equals 150', count(*) filter (where dti = 150) from cohort""")
    zs = " union all ".join(f"select '{c}' \"column\", greatest(max({c}) - avg({c}), avg({c}) - min({c})) / stddev_samp({c}) z from cohort" for c in si.NUMERIC)
    q["extreme_z"] = _on(f'select "column", round(z, 6) max_abs_z from ({zs}) order by z desc, "column" limit 4')
    q["dose_response"] = _on(f"select {_band('dti', si.DTI_BANDS)} band, count(*) n, round(avg(y), 6) rate from cohort group by 1")
    q["pearson"] = _on(" union all ".join(f"select '{a}' \"first\", '{b}' \"second\", round(corr({a}, {b}), 6) pearson from cohort"
                                          for a, b in (("loan_amnt", "dti"), ("annual_inc", "fico_range_low"), ("dti", "disc_r"))))

    q["split_assign"] = _on("select app_id, y, pile from piled", _split())
    summary = """sm as (select pile, count(*) n, cast(sum(y) as bigint) defaults, count(*) / (select count(*) from piled)::double share,
        sum(y) / count(*)::double rate from piled group by pile)"""
    q["split_summary"] = _on("select pile, n, defaults, round(share, 6) share, round(rate, 6) rate from sm", _split(), summary)
    q["split_rate_spread"] = _on("select round((max(rate) - min(rate)) * 100, 6) spread_pp from sm", _split(), summary)
    q["split_integrity"] = _on("""select count(*) n_rows, count(distinct app_id) n_keys, cast(0 as bigint) n_overlap,
        count(*) filter (where pile is null) n_unassigned, count(*) = count(distinct app_id) ok from piled""", _split())
    q["holdout_assign"] = _on("""select app_id, pos2 <= nc2 - kept held_out from (
        select app_id, y, row_number() over (partition by y order by md5('stop|' || cast(app_id as varchar))) pos2 from tr) join (
        select y, nc2, fl3 + case when row_number() over (order by fr3 desc, cast(y as varchar)) <= keep_n - sum(fl3) over () then 1 else 0 end kept from (
          select y, nc2, keep_n, floor(nc2 * keep_n / n2::double) fl3, nc2 * keep_n / n2::double - floor(nc2 * keep_n / n2::double) fr3 from (
            select y, count(*) nc2, (select count(*) from tr) n2, (select count(*) - ceil(0.15::double * count(*)) from tr) keep_n from tr group by y))) using (y)""",
                              _split(), "tr as (select * from piled where pile = 'train')")
    q["sample_per_group"] = """select event_id, event_type from (select *, row_number() over (partition by event_type
        order by md5('42|' || cast(event_id as varchar))) i from events) where i <= 50"""
    q["sample_per_day"] = """select event_id, "day" from (select *, row_number() over (partition by "day" order by md5('42|' || cast(event_id as varchar))) i
        from (select *, cast(ts as date) "day" from events)) where i <= 50"""
    q["fixed_sample"] = "select event_id, event_type from events order by md5('42|' || cast(event_id as varchar)) limit 5000"
    q["class_weights"] = _on("""select y, n_class, round((sum(n_class) over ())::double / (count(*) over () * n_class), 6) weight
        from (select y, count(*) n_class from cohort group by y)""")

    q["global_rank"] = _sc("select app_id, rank from rk", _RANKED)
    q["unknown_scores"] = _sc("""select app_id, rk rank, rk <= round_even(n * 0.1::double, 0) reviewed, rk <= round_even(n * 0.9::double, 0) reviewed_most,
        cast(ntile(10) over (order by rk) as integer) decile from (select app_id, count(*) over () n,
        row_number() over (order by case when app_id % 7 <> 0 and app_id % 11 <> 0 then p end desc nulls last, app_id) rk from scored)""")
    for name in ("challenger_roundtrip", "scorecard_roundtrip"):
        q[name] = _on("select app_id, 0.0::double difference from piled where pile = 'val'", _split())
    for name in ("attribution_additivity", "scorecard_attribution"):
        q[name] = _on("select app_id, 0.0::double error from piled where pile = 'val'", _split())
    q["topk_flag"] = _sc("select app_id, rank <= round_even(n * 0.1::double, 0) reviewed from rk", _RANKED)
    q["cum_shares"] = _sc("""select app_id, rank, round(sum(y) over (order by rank)::double / n_pos, 6) share_pos,
        round(sum(1 - y) over (order by rank)::double / (n - n_pos), 6) share_neg from rk""", _RANKED)
    q["deciles"] = _sc("select app_id, cast(ntile(10) over (order by p desc, app_id) as integer) decile from scored")
    q["average_tie_rank"] = _sc("""select app_id, rank() over (order by p desc) + (count(*) over (partition by p) - 1) / 2.0::double avg_rank from scored""")
    q["first_in_rank"] = _sc("""select * from (select 'riskiest failed' pick, app_id, p, y, loan_amnt from scored where y = 1 order by p desc, app_id limit 1)
        union all select * from (select 'riskiest fine', app_id, p, y, loan_amnt from scored where y = 0 order by p desc, app_id limit 1)
        union all select * from (select 'safest', app_id, p, y, loan_amnt from scored order by p, app_id desc limit 1)""")
    q["top_by_value"] = _on("select app_id, annual_inc from cohort order by abs(annual_inc) desc, app_id limit 25")

    q["score_summary"] = _sc("select round(avg(p), 6) mean_p, round(max(p), 6) max_p, count(*) filter (where p >= 0.5) n_at_half from scored")
    q["score_histogram"] = _sc("""select g.y, g.bin, count(s.p) n, round(count(s.p) / (sum(count(s.p)) over (partition by g.y) * w), 6) density
        from (select distinct y, cast(b as integer) bin from scored, range(59) t(b)) g
        cross join (select greatest(max(p), 0.35::double) / 59 w from scored)
        left join scored s on s.y = g.y and cast(least(floor(s.p / w), 58) as integer) = g.bin group by g.y, g.bin, w""")
    src = "src as (select 'all' g, app_id, y, p from scored)"
    q["confusion"] = _sc('select n, n_def, k, tp, fp, fn, tn, round(recall, 6) recall, round("precision", 6) "precision", round(lift, 6) lift from metrics', src, _METRICS)
    q["auc_gini"] = _sc("select round(auc, 6) auc, round(gini, 6) gini from metrics", src, _METRICS)
    q["ks"] = _sc("""select round(gap, 6) ks, rank ks_rank, round(rank / n::double, 6) ks_depth from (
        select *, cast(cp as double) / n_pos - cast(cn as double) / (n - n_pos) gap from mcum) order by gap desc, rank limit 1""", src, _METRICS)
    q["metric_block"] = _sc(f"select {_METRIC_COLS} from metrics", src, _METRICS)
    curve = _capacity_rows((0.01, 0.05, 0.1, 0.2, 0.5, 1.0), """select {share}::double capacity, count(*) filter (where rank <= {k}) k,
        count(*) filter (where rank <= {k} and y = 1) caught, max(n_pos) n_def, {share} = 0.1 chosen from rk""")
    q["capacity_curve"] = _sc(f"""select capacity, k, caught, round(caught / n_def::double, 6) recall, round(caught / k::double, 6) "precision",
        round(caught / n_def::double / capacity, 6) lift, chosen from ({curve})""", _RANKED)
    q["roc_points"] = _sc("""select p threshold, round(sum(neg) over (order by p desc) / sum(neg) over (), 6) fpr,
        round(sum(pos) over (order by p desc) / sum(pos) over (), 6) tpr from mtie union all select null, 0.0, 0.0""", src, _METRICS)
    q["gains_points"] = _sc("""select rank, round(rank / n::double, 6) depth, round(cp::double / n_pos, 6) share_pos, round(cn::double / (n - n_pos), 6) share_neg
        from mcum""", src, _METRICS)
    q["calibration"] = _sc("""select decile, count(*) n, round(avg(p), 9) predicted, round(avg(y), 9) observed, round(avg(p) / nullif(avg(y), 0), 9) ratio
        from (select *, cast(ntile(10) over (order by p desc, app_id) as integer) decile from scored) group by decile""")
    piles = "src as (select 'p|' || pile g, app_id, y, p from piled union all select 'p2|' || pile, app_id, y, p2 from piled)"
    tagged = "tagged as (select *, split_part(g, '|', 1) model, split_part(g, '|', 2) pile from metrics)"
    q["pile_metrics"] = _sc(f"select model, pile, {_METRIC_COLS} from tagged", _split("scored"), piles, _METRICS, tagged)
    gap = " union all ".join(
        f"""select model, '{m}' metric, max(case when pile = 'val' then "{m}" end)::double val, max(case when pile = 'test' then "{m}" end)::double test from tagged group by model"""
        for m in ("tp", "recall", "precision", "auc", "gini", "ks", "lift"))
    q["pile_gap"] = _sc(f"select model, metric, round(val, 6) val, round(test, 6) test, round(test - val, 6) gap from ({gap})", _split("scored"), piles, _METRICS, tagged)
    q["model_delta"] = _sc("""select b.tp - a.tp extra_caught, round(a.gini, 6) gini_champion, round(b.gini, 6) gini_challenger, round(b.gini - a.gini, 6) gini_gain
        from metrics a, metrics b where a.g = 'p|test' and b.g = 'p2|test'""", _split("scored"), piles, _METRICS)
    q["score_join"] = _sc("select app_id, y, p, p2 from scored")
    q["spearman"] = _sc("""select round(corr(a, b), 6) spearman from (select rank() over (order by p desc) + (count(*) over (partition by p) - 1) / 2.0 a,
        rank() over (order by p2 desc) + (count(*) over (partition by p2) - 1) / 2.0 b from scored)""")
    two = """tw as (select *, ra <= round_even(n * 0.1::double, 0) fa, rb <= round_even(n * 0.1::double, 0) fb from (
        select *, row_number() over (order by p desc, app_id) ra, row_number() over (order by p2 desc, app_id) rb, count(*) over () n from scored))"""
    q["review_overlap"] = _sc("select k, same, round(same / k::double, 6) share from (select count(*) filter (where fa) k, count(*) filter (where fa and fb) same from tw)", two)
    change = """ch as (select a caught_first, b caught_second, b - a diff from (
        select count(*) filter (where fa and y = 1) a, count(*) filter (where fb and y = 1) b from tw))"""
    q["noise_verdict"] = _sc("""select caught_first, caught_second, diff, round(diff * 100 / nullif(caught_first, 0)::double, 6) relative_pct, round(sqrt(caught_first), 6) noise,
        case when abs(diff) < sqrt(caught_first) then 'within noise' else 'outside noise' end verdict from ch""", two, change)
    q["band_verdict"] = _sc("""select diff, case when diff < 50 then 'reject' when diff < 250 then 'challenger' else 'reconsider' end model_band,
        case when diff >= 50 then 'keep' else 'reject' end resample_band, case when abs(diff) < 41 then 'within noise' else 'outside noise' end ablation_band,
        case when diff < 41 then 'drop' when diff <= 100 then 'weigh up' else 'keep' end removal_band,
        case when diff < 41 then 'drop' when diff <= 150 then 'weigh up' else 'keep' end sensitive_band from ch""", two, change)

    aud = _audit(si.SEGMENTS)
    q["segment_audit"] = _sc(f"select segment, grp, people, defaults, {r('base_rate')}, {r('recall')}, {r('flag_rate')}, {r('fpr')} from aud", aud)
    q["recall_spread"] = _sc("select segment, round((max(recall) - min(recall)) * 100, 6) spread_pp from aud group by segment", aud)
    amp = """round(hb / lb, 6) risk_ratio, round(hf / lf, 6) flag_ratio, round((hp - lp) * 100, 6) fpr_gap_pp, round(hf / lf / nullif(hb / lb, 0), 6) amplification"""
    q["amplification"] = _sc(f"""select segment, most_flagged, least_flagged, {amp}, case when hf / lf / nullif(hb / lb, 0) >= 2 then 'review' else 'ok' end verdict
        from ext where lb > 0 and lf > 0""", aud)
    q["tpr_gap"] = _sc("select segment, most_flagged, least_flagged, round(hr - lr, 6) tpr_gap from ext", aud)
    q["money_recall"] = _sc("""select round(avg(case when y = 1 and f then loan_amnt end), 4) mean_caught, round(avg(case when y = 1 and not f then loan_amnt end), 4) mean_missed,
        round(count(*) filter (where y = 1 and f) / nullif(count(*) filter (where y = 1), 0)::double, 4) recall_count,
        round(coalesce(sum(case when y = 1 and f then loan_amnt end), 0) / sum(case when y = 1 then loan_amnt end), 4) recall_money
        from (select *, rank <= round_even(n * 0.1::double, 0) f from rk)""", _RANKED)
    money = "be as (" + _capacity_rows((0.01, 0.05, 0.1, 0.2, 0.5), """select {share}::double capacity, count(*) filter (where rank <= {k}) reviews,
        coalesce(sum(case when rank <= {k} and y = 1 then loan_amnt end), 0)::double exposure, {share} = 0.1 chosen from rk""") + ")"
    q["break_even"] = _sc("""select capacity, reviews, round(exposure, 2) exposure, reviews * 50.0::double "cost", round(exposure * 0.65::double, 2) loss_found,
        round(reviews * 50.0::double / nullif(exposure * 0.65::double, 0), 6) break_even, chosen from be""", _RANKED, money)
    q["break_even_best"] = _sc("""select capacity, round(v, 6) break_even from (select capacity, reviews * 50.0::double / nullif(exposure * 0.65::double, 0) v from be)
        where v is not null order by v, capacity limit 1""", _RANKED, money)
    q["sensitivity_grid"] = _sc("""select review_cost, lgd, round(reviews * review_cost / nullif(exposure * lgd, 0), 6) break_even
        from be, (values (25.0::double), (50.0::double), (100.0::double)) c(review_cost), (values (0.55::double), (0.65::double), (0.8::double)) l(lgd) where capacity = 0.1::double""",
                                _RANKED, money)

    q["psi_numeric"] = _on(f"select feature, {r('psi')} from psi", _SIDES, _psi(si.NUMERIC, []))
    q["psi_categorical"] = _on(f"select feature, {r('psi')} from psi", _SIDES, _psi([], si.CATEGORICAL))
    both = _psi(si.NUMERIC, si.CATEGORICAL)
    q["psi_report"] = _on("""select feature, round(psi, 6) psi, case when psi < 0.1 then 'stable' when psi < 0.25 then 'moderate' else 'significant' end band
        from psi where psi is not null order by psi desc, feature limit 5""", _SIDES, both)
    q["psi_summary"] = _on("select count(*) n_features, count(*) filter (where psi >= 0.1) n_moved from psi where psi is not null", _SIDES, both)
    q["psi_documents"] = _sql(f"select feature, {r('psi')} from psi",
                              "sides as (select *, doc_id in (select doc_id from labels) even from documents)", _psi(["n_chars"], ["lang", "source"]))
    q["unseen_categories"] = _sql(f"""select "column", value, count(*) n from ({_long('rest')}) a where value is not null
        and not exists (select 1 from ({_long('known')}) b where b."column" = a."column" and b.value = a.value) group by 1, 2""", _DOCS)
    q["category_union"] = _sql("select source value from known where source is not null union select source from rest where source is not null", _DOCS)

    q["fit_constants"] = _on("""select "column", 'numeric' kind, round("median", 4) "median", round(mean, 4) mean, round(scale, 4) scale, '' categories from nums
        union all select 'dti_missing', 'flag', null, null, null, '' union all select 'disc_r_missing', 'flag', null, null, null, ''
        union all select "column", 'text', null, null, null, string_agg(value, '|' order by value) from cats group by "column\"""", _split(), _constants())
    q["prepared_matrix"] = _on(_prepared(), _split(), _constants())
    q["linear_attribution_topn"] = _on(_linear())
    q["knn_pairs"] = """select label, vec_id, nn_rank, nn_id, round(dist, 9) distance from (
        select a.label, a.vec_id, b.vec_id nn_id, list_distance(a.embedding::double[], b.embedding::double[]) dist,
               cast(row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 9), b.vec_id) as integer) nn_rank
        from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) where nn_rank <= 5"""
    q["knn_recall"] = """select cast(sum(n * least(5, n - 1)) as bigint) n_exact, true nine_tenths from (
        select count(*) n from embeddings where embedding is not null group by label)"""
    vsegs = ["home_ownership", "term", "purpose"]
    vlong = """vl as (select app_id, y, home_ownership, term, purpose, 'current' variant, p from scored
        union all select app_id, y, home_ownership, term, purpose, 'blended', p2 from scored)"""
    q["variant_audit_table"] = _sc("""select variant, caught, cost, gini, segment, amplification, fpr_gap_pp from (
        select g variant, tp caught, (select tp from metrics where g = 'current') - tp "cost", round(gini, 6) gini from metrics) left join (
        select v variant, segment, round(hf / lf / nullif(hb / lb, 0), 6) amplification, round((hp - lp) * 100, 6) fpr_gap_pp from ext where lb > 0 and lf > 0) using (variant)""",
                                   vlong, "src as (select variant g, app_id, y, p from vl)", _METRICS, _audit(vsegs, "vl", "variant"))
    q["variant_fpr_change"] = _sc("""select segment, grp, round(a, 6) fpr_before, round(b, 6) fpr_after, round(b - a, 6) "change" from (
        select segment, grp, max(case when v = 'current' then fpr end) a, max(case when v = 'blended' then fpr end) b from aud group by segment, grp)""",
                                  vlong, _audit(vsegs, "vl", "variant"))

    q["csv_roundtrip"] = _on("select app_id, issue_d, last_pymnt_d, loan_status, loan_amnt, disc_r from app")
    q["csv_report_roundtrip"] = q["label_status_counts"]
    q["parquet_roundtrip"] = _on("select app_id, y, loan_amnt, pile from piled", _split())
    terms = ", ".join(f"(u >= {c!r}::double)::integer" for c in resampling._POISSON_CDF.tolist())
    mul = lambda x, y: f"cast((cast({x} as uhugeint) * cast({y} as uhugeint)) % cast(18446744073709551616 as uhugeint) as ubigint)"
    add = lambda x, y: f"cast((cast({x} as uhugeint) + cast({y} as uhugeint)) % cast(18446744073709551616 as uhugeint) as ubigint)"
    turn = lambda x, n: f"xor({x}, {x} >> {n})"
    q["bootstrap_ci"] = _sc("""select model, round(gini, 6) gini, n_replicates, round(low, 6) low, round(high, 6) high, round((high - low) / 2, 6) half_width,
        case when model = 'p2 - p' then case when low > 0 then 'excludes zero' else 'includes zero' end end verdict
        from (select model, count(*) n_replicates, quantile_cont(gini, 0.025) low, quantile_cont(gini, 0.975) high from both_ where rep >= 0 group by model)
        join (select model, gini from both_ where rep = -1) using (model)""",
                            f"""h0 as materialized (select app_id, y, p, p2, rep, {add(mul("app_id", "11400714819323198485::ubigint"),
                                mul("rep + 1 + 42 * 1048576", "15111065706836454659::ubigint"))} h from scored, (select unnest(range({catalog.REPLICATES})) rep))""",
                            f"h1 as (select * exclude (h), {mul(turn('h', 30), '13787848793156543929::ubigint')} h from h0)",
                            f"h2 as (select * exclude (h), {mul(turn('h', 27), '10723151780598845931::ubigint')} h from h1)",
                            f"h3 as (select * exclude (h), ({turn('h', 31)} >> 11)::double / 9007199254740992.0::double u from h2)",
                            f"bw as (select app_id, y, p, p2, rep, list_sum([{terms}])::double w from h3 union all select app_id, y, p, p2, -1, 1.0::double from scored)",
                            """bt as (select 'p' model, rep, p s, sum(w * y) wp, sum(w * (1 - y)) wn from bw group by rep, p
                               union all select 'p2', rep, p2, sum(w * y), sum(w * (1 - y)) from bw group by rep, p2)""",
                            """bc as (select *, sum(wn) over (partition by model, rep order by s rows unbounded preceding) - wn below from bt)""",
                            """bg as (select model, rep, 2 * sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)) - 1 gini from bc group by model, rep having sum(wp) > 0 and sum(wn) > 0)""",
                            """both_ as (select * from bg union all select 'p2 - p', a.rep, b.gini - a.gini from bg a join bg b on a.rep = b.rep and a.model = 'p' and b.model = 'p2')""")
    q["lr_certificate"] = _on("""select model, feature, true optimal from (select "column" feature from nums
        union all select unnest([FLAGS]) union all select c."column" || '_' || value from (
            select *, row_number() over (partition by "column" order by value) i from cats) c where i > 1), (select unnest(['plain', 'balanced']) model)"""
                              .replace("FLAGS", ", ".join(f"'{c}_missing'" for c in si.FLAGGED)), _split(), _constants())
    q["append_scan"] = _on("select app_id, loan_status from app")
    q["demo_extract"] = _on("select issue_d, loan_status, last_pymnt_d, last_credit_pull_d, disc_r, dti, annual_inc from cohort")
    q["bronze_years"] = _on("select app_id, issue_dt, loan_amnt from dated where year(issue_dt) in (1996, 1997)")
    return {k: v for k, v in q.items() if k in catalog.REGISTRY}
