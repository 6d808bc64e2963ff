"""The registered queries as plain SQL, written independently of the operators."""

from __future__ import annotations

SUBJECTS = """
s AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS target,
         CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE c_mktsegment END AS grp,
         o_orderpriority AS role,
         c_nationkey % 5 + 1 AS grade,
         CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS flag,
         o_totalprice AS amount,
         CAST(floor(c_acctbal / 450.0) AS INT) AS tenure,
         18 + 2 * c_nationkey AS age,
         CAST(1 + o_orderkey % 4 AS INT) AS job_satisfaction,
         CAST(1 + o_custkey % 4 AS INT) AS env_satisfaction
  FROM orders JOIN customer ON o_custkey = c_custkey
),
t AS (
  SELECT *, CASE target WHEN 'Yes' THEN 1.0::DOUBLE WHEN 'No' THEN 0.0::DOUBLE END AS y,
         CASE WHEN target = 'Yes' THEN 1 ELSE 0 END AS label
  FROM s
)"""

HR = """id AS "EmployeeNumber", target AS "Attrition", grp AS "Department", role AS "JobRole",
grade AS "JobLevel", flag AS "OverTime", amount AS "MonthlyIncome", tenure AS "YearsAtCompany",
age AS "Age", job_satisfaction AS "JobSatisfaction", env_satisfaction AS "EnvironmentSatisfaction" """

ORACLES: dict[str, str] = {}


def put(name: str, body: str, *tables: str) -> None:
    """Register a statement over the subjects and further common tables."""
    ORACLES[name] = "WITH " + ",".join([SUBJECTS, *tables]) + body


def even(value: str, digits: int) -> str:
    """Round half to even at the scaled value."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(CAST(round_even(({value}) * {scale}, 0) AS DOUBLE) / {scale})"


# Sources and sinks

WHOLE = ("JobLevel", "YearsAtCompany", "Age", "JobSatisfaction", "EnvironmentSatisfaction")
put(
    "scan_csv",
    "SELECT * REPLACE ("
    + ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in WHOLE)
    + f") FROM (SELECT {HR} FROM s)",
)
put(
    "scan_dispatch",
    """SELECT fmt, count(*) AS n, count(target) AS known, CAST(sum(age) AS BIGINT) AS ages
    FROM s, (VALUES ('csv'), ('parquet')) f(fmt) GROUP BY fmt""",
)
put(
    "sink_json",
    f"SELECT {HR} FROM (SELECT * REPLACE (CASE WHEN age <> 18 THEN amount END AS amount) FROM s)",
)

# Schema, projection, predicate, scalar

put(
    "resolve_roles",
    """SELECT target, grp AS "group", grade, flag, amount, age, role, tenure, id,
    job_satisfaction AS "JobSatisfaction", env_satisfaction AS "EnvironmentSatisfaction" FROM s""",
)
put(
    "match_columns",
    """SELECT id AS "EmployeeNumber", job_satisfaction AS "JobSatisfaction",
    env_satisfaction AS "EnvironmentSatisfaction" FROM s""",
)
FAMILIES = {
    "EmployeeNumber": ("numeric", "id"),
    "Department": ("categorical", "grp"),
    "JobRole": ("categorical", "role"),
    "JobLevel": ("numeric", "grade"),
    "OverTime": ("categorical", "flag"),
    "MonthlyIncome": ("numeric", "amount"),
    "YearsAtCompany": ("numeric", "tenure"),
    "Age": ("numeric", "age"),
    "JobSatisfaction": ("numeric", "job_satisfaction"),
    "EnvironmentSatisfaction": ("numeric", "env_satisfaction"),
}
put(
    "column_families",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{family}' AS family, count({source}) AS non_null FROM s"
        for c, (family, source) in FAMILIES.items()
    ),
)
put(
    "drop_columns",
    f"SELECT {HR.replace('id AS ' + chr(34) + 'EmployeeNumber' + chr(34) + ', ', '')}, id AS row FROM s",
)
put("encode_target_strict", 'SELECT id AS "EmployeeNumber", label FROM t')
put("encode_target_lenient", 'SELECT id AS "EmployeeNumber", y AS outcome FROM t')


def code(column: str) -> str:
    return f"dense_rank() OVER (ORDER BY coalesce({column}, 'nan')) - 1"


put(
    "label_encode",
    f"""SELECT id AS "EmployeeNumber", {code('grp')} AS "Department", {code('role')} AS "JobRole",
    {code('flag')} AS "OverTime" FROM s""",
)
ORACLES["label_encoder_table"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS "value", row_number() OVER (ORDER BY v) - 1 AS code
    FROM (SELECT DISTINCT {c} AS v FROM customer)"""
    for c in ("c_name", "c_mktsegment")
)
CHOSEN = "grp IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"
put("filter_in", f'SELECT id AS "EmployeeNumber", grp AS "Department" FROM s WHERE {CHOSEN}')
put(
    "nan_to_null",
    'SELECT id AS "EmployeeNumber", CASE WHEN tenure >= 0 THEN amount END AS amount FROM s',
)
put("drop_nulls", 'SELECT id AS "EmployeeNumber", grp AS "Department" FROM s WHERE grp IS NOT NULL')
put("distinct_groups", "SELECT DISTINCT grp FROM s WHERE grp IS NOT NULL")
put(
    "cast_or_default",
    """SELECT id AS scenario,
    CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 0.0::DOUBLE ELSE amount END AS amount FROM s""",
)
put(
    "band_thresholds",
    """SELECT id AS "EmployeeNumber",
    CASE WHEN amount < 100000 THEN 'small' WHEN amount < 250000 THEN 'middle'
         WHEN amount < 400000 THEN 'large' ELSE 'huge' END AS left_closed,
    CASE WHEN round(amount, -5) <= 100000 THEN 'small' WHEN round(amount, -5) <= 250000 THEN 'middle'
         WHEN round(amount, -5) <= 400000 THEN 'large' ELSE 'huge' END AS right_closed FROM s""",
)
put(
    "minmax_normalise",
    """SELECT id AS "EmployeeNumber",
    round((amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()), 9) AS own,
    round((job_satisfaction - 1) / 3.0::DOUBLE, 9) AS fixed FROM s""",
)

# Aggregations

RATE = f"count(*) AS n, coalesce(sum(y), 0.0::DOUBLE) AS positives, {even('coalesce(sum(y), 0) / count(*) * 100', 2)} AS rate"
for name, key in (("rate_by_group", "grp"), ("rate_by_grade", "grade"), ("rate_by_flag", "flag")):
    put(
        name,
        f"""SELECT CAST({key} AS VARCHAR) AS {key}, {RATE} FROM t
        WHERE {key} IS NOT NULL GROUP BY {key}""",
    )
for name, key in (("counts_by_group", "grp"), ("counts_by_role", "role")):
    put(
        name,
        f"""SELECT {key}, count(target) AS total, coalesce(sum(y), 0.0::DOUBLE) AS attrited FROM t
        WHERE {key} IS NOT NULL GROUP BY {key}""",
    )
put(
    "amount_by_group",
    """SELECT grp, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median,
    min(amount) AS min, max(amount) AS max FROM s WHERE grp IS NOT NULL GROUP BY grp""",
)
put(
    "score_means_by_group",
    f"""SELECT grp, {even('avg(job_satisfaction)', 2)} AS "JobSatisfaction",
    {even('avg(env_satisfaction)', 2)} AS "EnvironmentSatisfaction"
    FROM s WHERE grp IS NOT NULL GROUP BY grp""",
)
put(
    "crosstab_group_flag",
    """SELECT grp, count(*) FILTER (flag = 'No') AS "No", count(*) FILTER (flag = 'Yes') AS "Yes"
    FROM s WHERE grp IS NOT NULL GROUP BY grp""",
)
BANDED = """
b AS (
  SELECT *, CASE WHEN tenure >= 0 AND tenure < 2 THEN 0 WHEN tenure >= 2 AND tenure < 5 THEN 1
    WHEN tenure >= 5 AND tenure < 10 THEN 2 WHEN tenure >= 10 AND tenure < 15 THEN 3
    WHEN tenure >= 15 AND tenure < 20 THEN 4 WHEN tenure >= 20 AND tenure < 100 THEN 5 END AS band_order
  FROM t
)"""
BAND_NAME = """CASE band_order WHEN 0 THEN '0-2' WHEN 1 THEN '2-5' WHEN 2 THEN '5-10'
WHEN 3 THEN '10-15' WHEN 4 THEN '15-20' WHEN 5 THEN '20+' ELSE 'nan' END AS tenure_group"""
put(
    "rate_by_tenure_band",
    f"SELECT band_order, {BAND_NAME}, {RATE} FROM b GROUP BY band_order",
    BANDED,
)
put(
    "count_by_tenure_band",
    f"SELECT band_order, {BAND_NAME}, count(*) AS count FROM b GROUP BY band_order",
    BANDED,
)
put(
    "age_histogram",
    """SELECT CAST(i AS INT) AS bin, '(' || (18 + 5 * i) || ', ' || (23 + 5 * i) || ']' AS age_range,
    (SELECT count(*) FROM s WHERE age > 18 + 5 * i AND age <= 23 + 5 * i) AS count
    FROM range(9) r(i)""",
)


def kpis(where: str) -> str:
    return f"""SELECT count(*) AS total_employees, {even('avg(y) * 100', 2)} AS attrition_rate,
    CAST(sum(y) AS BIGINT) AS attritioned, CAST(count(*) - sum(y) AS BIGINT) AS retained,
    {even('avg(amount)', 2)} AS avg_income, {even('avg(age)', 2)} AS avg_age,
    {even('median(amount)', 2)} AS median_income FROM t {where}"""


put("kpi_summary", kpis(""))
put("kpi_filtered", kpis(f"WHERE {CHOSEN}"))
put("target_split", "SELECT target AS value, count(*) AS count FROM s WHERE target IS NOT NULL GROUP BY target")
put("group_counts", "SELECT grp AS value, count(*) AS count FROM s WHERE grp IS NOT NULL GROUP BY grp")
put(
    "table_shape",
    """SELECT count(*) AS rows, 11 AS cols, 'EmployeeNumber,Attrition,Department,JobRole,JobLevel,OverTime,MonthlyIncome,YearsAtCompany,Age,JobSatisfaction,EnvironmentSatisfaction' AS columns FROM s""",
)
put(
    "overview_rates",
    """SELECT count(*) AS total, count(*) FILTER (y = 1) AS attrited, count(*) FILTER (y = 0) AS retained,
    round(100.0::DOUBLE * count(*) FILTER (y = 1) / count(*), 1) AS attrition_pct,
    round(100.0::DOUBLE * count(*) FILTER (y = 0) / count(*), 1) AS retention_pct FROM t""",
)
NUMERIC = {
    "JobLevel": "grade",
    "MonthlyIncome": "amount",
    "YearsAtCompany": "tenure",
    "Age": "age",
    "JobSatisfaction": "job_satisfaction",
    "EnvironmentSatisfaction": "env_satisfaction",
}
put(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS col_name, {even(f'corr({x}, {y})', 3)} AS corr FROM s"
        for a, x in NUMERIC.items()
        for b, y in NUMERIC.items()
    ),
)
put(
    "top_corr_columns",
    """SELECT CAST(row_number() OVER (ORDER BY size DESC, name) AS INT) AS rank, name AS "column" FROM c
    QUALIFY rank <= 4""",
    "c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS name, abs(corr({x}, y)) AS size FROM t" for a, x in NUMERIC.items())
    + ")",
)
ORDERED = """
o AS (
  SELECT target AS class, amount, row_number() OVER (PARTITION BY target ORDER BY {order}) AS rn,
         count(*) OVER (PARTITION BY target) AS n
  FROM {source} WHERE target IS NOT NULL
)"""
FIVE = """SELECT class, any_value(n) AS n, max(amount) FILTER (rn = 1) AS min,
  max(amount) FILTER (rn = n // 4 + 1) AS q1, max(amount) FILTER (rn = n // 2 + 1) AS median,
  max(amount) FILTER (rn = n * 3 // 4 + 1) AS q3, max(amount) FILTER (rn = n) AS max
FROM o GROUP BY class"""
put("five_number_by_class", FIVE, ORDERED.format(order="amount", source="s"))
put(
    "head_per_class",
    "SELECT class, CAST(rn AS INT) AS position, amount FROM o WHERE rn <= 200",
    ORDERED.format(order="id", source="s"),
)

# Scores of the fixed scorer

SCORED = f"""
p AS (
  SELECT *, 1 / (1 + exp(-(amount * (1.0::DOUBLE / 150000) + age * 0.05::DOUBLE
         + (-(250000.0::DOUBLE / 150000) - 2.1::DOUBLE)))) AS prob
  FROM t
),
r AS (SELECT *, {even('prob * 100', 1)} AS risk_score FROM p),
k AS (
  SELECT *, CASE WHEN risk_score <= 25 THEN 'Low' WHEN risk_score <= 50 THEN 'Medium'
    WHEN risk_score <= 75 THEN 'High' ELSE 'Critical' END AS risk_category
  FROM r
)"""
REPORT = 'id AS "EmployeeNumber", risk_score, risk_category, grp AS "Department", role AS "JobRole", grade AS "JobLevel"'
put("sink_csv", f"SELECT {REPORT} FROM k".replace("grade AS", "grade::BIGINT AS"), SCORED)
put(
    "filter_category",
    """SELECT id AS "EmployeeNumber", risk_score, risk_category FROM k WHERE risk_category = 'Critical'""",
    SCORED,
)
put("report_columns", f"SELECT {REPORT} FROM k", SCORED)
put("top_risk", f"SELECT {REPORT} FROM k ORDER BY risk_score DESC, id LIMIT 100", SCORED)
put(
    "score_population",
    """SELECT id AS "EmployeeNumber", grp AS "Department", round(prob, 9) AS prob, risk_score,
    risk_category FROM k""",
    SCORED,
)
put(
    "crosstab_group_risk",
    """SELECT grp, """
    + ", ".join(
        f"""count(*) FILTER (risk_category = '{c}') AS "{c}" """
        for c in ("Low", "Medium", "High", "Critical")
    )
    + "FROM k WHERE grp IS NOT NULL GROUP BY grp",
    SCORED,
)
put("risk_category_counts", "SELECT risk_category, count(*) AS count FROM k GROUP BY risk_category", SCORED)
put(
    "risk_summary",
    f"""SELECT count(*) AS total, {even('avg(risk_score)', 2)} AS avg_risk,
    count(*) FILTER (risk_score >= 50) AS high_risk_count,
    round(100.0::DOUBLE * count(*) FILTER (risk_score >= 50) / count(*), 1) AS high_risk_pct FROM k""",
    SCORED,
)
put(
    "share_of_total",
    """SELECT risk_category, count(*) AS count,
    CAST(round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM k), 0) AS INT) AS pct
    FROM k GROUP BY risk_category""",
    SCORED,
)
put(
    "apply_sigmoid",
    """SELECT id AS "EmployeeNumber",
    round(1 / (1 + exp(-(0.75::DOUBLE * ln(prob / (1 - prob)) - 0.5::DOUBLE))), 9) AS prob FROM p""",
    SCORED,
)
put(
    "field_profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS feature, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max,
        {even(f'avg({x})', 2)} AS mean, median({x})::DOUBLE AS median,
        {'0.1' if a == 'MonthlyIncome' else '1.0'}::DOUBLE AS step FROM s"""
        for a, x in NUMERIC.items()
    ),
)
put(
    "field_profile_categorical",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS feature, row_number() OVER (ORDER BY v) - 1 AS position, v AS option,
        row_number() OVER (ORDER BY v) = 1 AS is_default
        FROM (SELECT DISTINCT coalesce({x}, 'nan') AS v FROM s)"""
        for a, x in (("Department", "grp"), ("JobRole", "role"), ("OverTime", "flag"))
    ),
)
_NONE = "NULL::BIGINT AS option_position, NULL::VARCHAR AS option, NULL::BOOLEAN AS is_default"
_FORM = {"Department": "grp", "OverTime": "flag", "MonthlyIncome": "amount", "Age": "age", "YearsAtCompany": "tenure", "Senior": "CAST(tenure >= 10 AS INT)"}


def _field(position: int, name: str, x: str) -> str:
    if name in ("Department", "OverTime"):
        return f"""SELECT {position} AS position, '{name}' AS name, 'categorical' AS type,
        row_number() OVER (ORDER BY v) - 1 AS option_position, v AS option, row_number() OVER (ORDER BY v) = 1 AS is_default,
        NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS median, NULL::DOUBLE AS mean, NULL::DOUBLE AS step
        FROM (SELECT DISTINCT coalesce({x}, 'nan') AS v FROM s)"""
    step = "0.1" if name in ("MonthlyIncome", "Senior") else "1.0"
    return f"""SELECT {position}, '{name}', 'numeric', {_NONE}, min({x})::DOUBLE, max({x})::DOUBLE, median({x})::DOUBLE,
        {even(f'avg({x})', 2)}, {step}::DOUBLE FROM s"""


put("field_table", " UNION ALL ".join(_field(i, name, x) for i, (name, x) in enumerate(_FORM.items())))
put(
    "default_scenario",
    "SELECT "
    + ", ".join(
        f"min(coalesce({x}, 'nan')) AS \"{name}\"" if name in ("Department", "OverTime") else f"median({x})::DOUBLE AS \"{name}\""
        for name, x in _FORM.items()
    )
    + " FROM s",
)
CODED = f"""
e AS (
  SELECT id, amount AS "MonthlyIncome", CAST(age AS DOUBLE) AS "Age",
         CAST({code('grp')} AS DOUBLE) AS "Department", CAST({code('flag')} AS DOUBLE) AS "OverTime"
  FROM s
)"""


def smallest_mode(column: str) -> str:
    return f"""(SELECT "{column}" FROM e GROUP BY "{column}" ORDER BY count(*) DESC, "{column}" LIMIT 1)"""


put(
    "fill_values",
    f"""SELECT 'MonthlyIncome' AS feature, median("MonthlyIncome") AS median, NULL::DOUBLE AS mode FROM e
    UNION ALL SELECT 'Age', median("Age"), NULL FROM e
    UNION ALL SELECT 'Department', median("Department"), {smallest_mode('Department')} FROM e
    UNION ALL SELECT 'OverTime', median("OverTime"), {smallest_mode('OverTime')} FROM e""",
    CODED,
)

# Sorts and contributions

put(
    "sort_by",
    """SELECT id AS "EmployeeNumber", CASE WHEN tenure <> 3 THEN tenure END AS "YearsAtCompany" FROM s
    ORDER BY coalesce("YearsAtCompany", 0) DESC""",
)
CONTRIBUTED = """
c AS (
  SELECT id, 'MonthlyIncome' AS feature, amount AS value,
         (1.0::DOUBLE / 150000) * (amount - avg(amount) OVER ()) AS contribution FROM s
  UNION ALL
  SELECT id, 'Age', age::DOUBLE, 0.05::DOUBLE * (age - avg(age) OVER ()) FROM s
),
d AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS rank FROM c
),
f AS (
  SELECT id, coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (contribution > 0), '') AS risk_factors,
         coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (contribution < 0), '') AS retention_factors,
         string_agg(feature, ', ' ORDER BY rank) FILTER (contribution > 0) AS reasons
  FROM d GROUP BY id
)"""
put(
    "linear_contributions",
    """SELECT id AS entity, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM c""",
    CONTRIBUTED,
)
put(
    "fixed_tree_contributions",
    """SELECT id AS entity, 'MonthlyIncome' AS feature, amount AS value,
      round(0.1::DOUBLE * (1 - rich - 0.5) + 0.4::DOUBLE * (rich - 0.5) * (0.4 + 1 - old) / 2
            + 0.9::DOUBLE * (rich - 0.5) * (0.6 + old) / 2, 6) AS contribution FROM o
    UNION ALL
    SELECT id, 'Age', age::DOUBLE,
      round(0.4::DOUBLE * (1 - old - 0.4) * (0.5 + rich) / 2
            + 0.9::DOUBLE * (old - 0.6) * (0.5 + rich) / 2, 6) FROM o""",
    """
o AS (
  SELECT id, amount, age, CASE WHEN amount > 250000 THEN 1.0::DOUBLE ELSE 0 END AS rich,
         CASE WHEN age > 40 THEN 1.0::DOUBLE ELSE 0 END AS old FROM s
)""",
)
put(
    "top_contributions",
    """SELECT id AS entity, CAST(rank AS INT) AS rank, feature, round(value, 6) AS value,
    round(contribution, 6) AS contribution FROM d WHERE rank <= 15""",
    CONTRIBUTED,
)
put(
    "risk_drivers",
    """SELECT id AS "EmployeeNumber", risk_factors, retention_factors FROM f""",
    CONTRIBUTED,
)
LEVEL = "CASE WHEN prob < 0.3 THEN 'LOW' WHEN prob < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END"
put(
    "explain_all",
    f"""SELECT k.id AS "EmployeeNumber", {even('prob', 4)} AS probability, {LEVEL} AS risk_level,
    {LEVEL} || ' risk because: ' || coalesce(reasons, 'balanced factors') AS explanation,
    risk_factors, retention_factors, label AS actual FROM k JOIN f ON k.id = f.id""",
    SCORED,
    CONTRIBUTED,
)
IMPORTANCE = """
i AS (
  SELECT feature, avg(abs(contribution)) AS importance,
         row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS rank
  FROM c GROUP BY feature
)"""
put(
    "global_importance",
    "SELECT CAST(rank AS INT) AS rank, feature, round(importance, 6) AS importance FROM i",
    CONTRIBUTED,
    IMPORTANCE,
)
# The sentences of the insights.
put(
    "insights",
    """SELECT * FROM (VALUES
    (1, (SELECT '🔑 **' || feature || '** is the strongest predictor of attrition — focus retention efforts here first.' FROM i WHERE rank = 1)),
    (2, (SELECT '📊 **' || max(feature) FILTER (rank = 2) || '** and **' || max(feature) FILTER (rank = 1) || '** together account for the largest share of attrition risk signals.' FROM i)),
    (3, (SELECT CASE WHEN count(*) FILTER (rank <= 5 AND (lower(feature) LIKE '%income%' OR lower(feature) LIKE '%salary%')) > 0
         THEN '💰 Compensation-related features rank highly — consider salary benchmarking to reduce voluntary turnover.'
         ELSE '🕐 Work-life balance and job satisfaction factors appear more influential than compensation in this dataset.' END FROM i)),
    (4, (SELECT CASE WHEN count(*) FILTER (rank <= 7 AND lower(feature) LIKE '%overtime%') > 0
         THEN '⏰ Employees working overtime show significantly elevated attrition risk — monitor workload distribution.'
         ELSE '🏢 Department and role-specific factors drive attrition — targeted department interventions may be most effective.' END FROM i)),
    (5, (SELECT '📈 The top 5 features (' || string_agg(feature, ', ' ORDER BY rank) || ') explain the majority of model predictions — prioritise data collection and HR programmes around these areas.' FROM i WHERE rank <= 5))
    ) v(position, insight)""",
    CONTRIBUTED,
    IMPORTANCE,
)

# Threshold ladders


def models(digits: int) -> str:
    def chance(margin: str) -> str:
        return f"round(1 / (1 + exp(-({margin}))), {digits})"

    a = "(amount - 250000) / 150000 + (age - 42) / 20::DOUBLE"
    b = "(tenure - 9) / 6::DOUBLE - (grade - 3) / 2::DOUBLE"
    c = "(job_satisfaction - 2.5::DOUBLE) + (env_satisfaction - 2.5::DOUBLE) / 2"
    return f"""
m AS (
  SELECT 'A' AS model, id, label, {chance(a)} AS prob FROM t
  UNION ALL SELECT 'B', id, label, {chance(b)} FROM t
  UNION ALL SELECT 'C', id, label, {chance(c)} FROM t
)"""


put(
    "band_scenario",
    """SELECT id, prob, CASE WHEN prob < 0.25 THEN 'Low' WHEN prob < 0.5 THEN 'Medium'
    WHEN prob < 0.75 THEN 'High' ELSE 'Critical' END AS band FROM m WHERE model = 'A'""",
    models(2),
)
put(
    "band_population",
    f"""SELECT id, prob, {even('prob * 100', 1)} AS risk_score,
    CASE WHEN {even('prob * 100', 1)} <= 25 THEN 'Low' WHEN {even('prob * 100', 1)} <= 50 THEN 'Medium'
    WHEN {even('prob * 100', 1)} <= 75 THEN 'High' ELSE 'Critical' END AS band FROM m WHERE model = 'A'""",
    models(2),
)
put("band_explain", f"SELECT id, prob, {LEVEL} AS band FROM m WHERE model = 'A'", models(2))
put(
    "band_score_mean",
    """SELECT grp, feature, mean,
    CASE WHEN mean >= 3.5 THEN 'good' WHEN mean >= 2.5 THEN 'fair' ELSE 'poor' END AS band FROM u""",
    f"""
g AS (
  SELECT concat_ws('/', grp, grade, id % 4) AS grp, {even('avg(job_satisfaction)', 2)} AS a,
         {even('avg(env_satisfaction)', 2)} AS b FROM s GROUP BY 1
),
u AS (
  SELECT grp, 'JobSatisfaction' AS feature, a AS mean FROM g
  UNION ALL SELECT grp, 'EnvironmentSatisfaction', b FROM g
)""",
)

# Split and balance


def row_hash(seed: str, entity: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {entity}), 1, 15))::BIGINT"


put(
    "stratified_split",
    """SELECT id AS "EmployeeNumber", label,
    CASE WHEN rn < test THEN 'test' WHEN rn < test + floor((n - test) * 0.25 + 0.5) THEN 'cal'
         ELSE 'train' END AS split
    FROM (SELECT *, floor(n * 0.2 + 0.5) AS test FROM h)""",
    f"""
h AS (
  SELECT id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY {row_hash('42', 'id')}) - 1 AS rn FROM t
)""",
)
put(
    "stratified_folds",
    """SELECT id AS "EmployeeNumber", label,
    (CASE WHEN rn >= n // 3 THEN 1 ELSE 0 END) + (CASE WHEN rn >= 2 * n // 3 THEN 1 ELSE 0 END) AS fold
    FROM h""",
    f"""
h AS (
  SELECT id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY {row_hash('fold42', 'id')}) - 1 AS rn FROM t
)""",
)
put(
    "class_weight",
    """SELECT count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
    count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1) AS weight FROM t""",
)
DOCUMENTS = """
d AS (
  SELECT d.doc_id, 1 - quality AS bad, length(text)::DOUBLE AS n_chars,
         len(list_filter(regexp_split_to_array(text, '[ \\n]'), lambda w: w <> ''))::DOUBLE AS words,
         len(string_split(text, chr(10)))::DOUBLE AS lines
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def gap(features: list[str]) -> str:
    return " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in features)


SPACE = ["n_chars", "words", "lines"]
VECTORS = f"""
v AS (SELECT {', '.join(SPACE)}, min(doc_id) AS vid, count(*) AS copies FROM {{source}} GROUP BY ALL),
w AS (
  SELECT a.vid, b.vid AS nvid, b.copies AS ncopies, {gap(SPACE)} AS d2,
         row_number() OVER (PARTITION BY a.vid ORDER BY {gap(SPACE)}, b.vid) AS rank
  FROM v a JOIN v b ON a.vid <> b.vid
)"""
ORACLES["nearest_neighbours"] = (
    "WITH "
    + ",".join([DOCUMENTS, VECTORS.format(source="d")])
    + "SELECT vid, CAST(rank AS INT) AS rank, nvid, ncopies, d2 FROM w WHERE rank <= 3"
)
# Oversampling when the positives are fewer: each positive is drawn equally often, the
# remainder goes to the smallest hashes; a pick counts the row's own copies first.
ORACLES["smote"] = f"""WITH {DOCUMENTS},
q AS (SELECT * FROM d WHERE bad = 1),
z AS (SELECT count(*) FILTER (bad = 1) AS pos, count(*) FILTER (bad = 0) AS neg FROM d),
{VECTORS.format(source="q")},
x AS (
  SELECT q.doc_id, v.vid, v.copies, (neg - pos) // pos + CASE WHEN
         row_number() OVER (ORDER BY {row_hash('base42', 'q.doc_id')}) <= (neg - pos) % pos
         THEN 1 ELSE 0 END AS draws, least(5, pos - 1) AS k
  FROM q JOIN v ON q.n_chars = v.n_chars AND q.words = v.words AND q.lines = v.lines, z
),
y AS (
  SELECT doc_id, vid, copies,
         {row_hash('pick42', "doc_id || '|' || draw")} % k + 1 - (copies - 1) AS pick,
         {row_hash('lam42', "doc_id || '|' || draw")} / 1152921504606846976::DOUBLE AS lam
  FROM x, unnest(range(1, draws + 1)) r(draw)
),
n AS (
  SELECT *, sum(ncopies) OVER (PARTITION BY vid ORDER BY rank) AS upto,
         sum(ncopies) OVER (PARTITION BY vid ORDER BY rank) - ncopies AS before FROM w
)
SELECT doc_id AS entity, CAST(bad AS INT) AS bad, n_chars, words, lines, false AS synthetic FROM d
UNION ALL
SELECT y.doc_id, 1, {', '.join(f'round(a.{f} + lam * (coalesce(b.{f}, a.{f}) - a.{f}), 6)' for f in SPACE)}, true
FROM y JOIN v a ON a.vid = y.vid
LEFT JOIN n ON n.vid = y.vid AND y.pick > n.before AND y.pick <= n.upto
LEFT JOIN v b ON b.vid = n.nvid"""

# Fitted models: the rows follow from the data, what must hold of the model is a column.
PARTS = f"""
ranked AS (
  SELECT doc_id, CAST(bad AS INT) AS label, count(*) OVER (PARTITION BY bad) AS n,
         row_number() OVER (PARTITION BY bad ORDER BY {row_hash('42', 'doc_id')}) - 1 AS rn FROM d
),
parts AS (
  SELECT doc_id, label, CASE WHEN rn < test THEN 'test'
         WHEN rn < test + floor((n - test) * 0.25 + 0.5) THEN 'cal' ELSE 'train' END AS split
  FROM (SELECT *, floor(n * 0.2 + 0.5) AS test FROM ranked)
)"""
for _name in ("fit_random_forest", "fit_boosted_trees", "fit_logistic"):
    ORACLES[_name] = f"""WITH {DOCUMENTS}, {PARTS}
SELECT doc_id, label, true AS in_unit_interval, true AS better_than_chance FROM parts WHERE split = 'test'"""
ORACLES["platt_calibrate"] = f"""WITH {DOCUMENTS}, {PARTS}
SELECT doc_id, label, true AS in_unit_interval, true AS slopes_vanish FROM parts WHERE split = 'test'"""
for _name, _drawn in (("random_search_cv", 6), ("random_search_forest", 10), ("random_search_boosted", 10)):
    ORACLES[_name] = f"""WITH {DOCUMENTS}, {PARTS},
f AS (
  SELECT label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY {row_hash('fold42', 'doc_id')}) - 1 AS rn
  FROM parts WHERE split = 'train'
)
SELECT fold, label, count(*) AS n, CAST({_drawn} AS INT) AS drawn, true AS best_refitted FROM (
  SELECT label, (CASE WHEN rn >= n // 3 THEN 1 ELSE 0 END) + (CASE WHEN rn >= 2 * n // 3 THEN 1 ELSE 0 END) AS fold
  FROM f
) GROUP BY fold, label"""
TEXT_VALUES = {
    "n_chars": "length(text)",
    "words": "len(w)",
    "uniq": "len(list_distinct(w)) / greatest(len(w), 1)",
    "digits": "length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)",
    "lines": "len(string_split(text, chr(10)))",
    "avgw": "greatest(length(text), 1) / greatest(len(w), 1)",
    "lang": "dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1",
    "source": "dense_rank() OVER (ORDER BY coalesce(source, 'nan')) - 1",
}
_values = ", ".join(f"CAST({v} AS DOUBLE) AS {f}" for f, v in TEXT_VALUES.items())
_long = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS feature, round({f}, 6) AS value, true AS local_accuracy_ok FROM features"
    for f in TEXT_VALUES
)
for _name in ("tree_contributions", "boosted_contributions"):
    ORACLES[_name] = f"""WITH worded AS (
  SELECT d.doc_id, text, lang, source,
         list_filter(regexp_split_to_array(text, '[ \\n]'), lambda w: w <> '') AS w
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
features AS (SELECT doc_id, {_values} FROM worded)
{_long}"""
put(
    "empty_if_missing",
    """SELECT operator, present, CASE WHEN present THEN n ELSE 0 END AS n FROM (
    SELECT 'rate_by_group' AS operator, count(DISTINCT grp) AS n FROM s
    UNION ALL SELECT 'counts_by_role', count(DISTINCT role) FROM s
    UNION ALL SELECT 'rate_by_flag', count(DISTINCT flag) FROM s
    ), (VALUES (true), (false)) p(present)""",
)

# Evaluate

QUALITY = f"""
n AS (
  SELECT model, count(*) FILTER (label = 1 AND prob > 0.5) AS tp, count(*) FILTER (label = 0 AND prob > 0.5) AS fp,
         count(*) FILTER (label = 1 AND prob <= 0.5) AS fn, count(*) FILTER (label = 0 AND prob <= 0.5) AS tn
  FROM m GROUP BY model
),
q AS (
  SELECT model, {even('(tp + tn) / (tp + tn + fp + fn)', 4)} AS accuracy,
         {even('coalesce(tp / nullif(tp + fp, 0), 0)', 4)} AS precision,
         {even('coalesce(tp / nullif(tp + fn, 0), 0)', 4)} AS recall,
         {even('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 4)} AS f1 FROM n
)"""
AREA = """
st AS (
  SELECT model, prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM m GROUP BY model, prob
),
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY prob
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM st
),
area AS (
  SELECT model, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
         sum(pos * (less + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM below GROUP BY model
)"""
put("classification_metrics", "SELECT * FROM q", models(2), QUALITY)
put(
    "auc_roc",
    f"SELECT model, positives, negatives, {even('auc', 6)} AS auc_roc FROM area",
    models(4),
    AREA,
)
put(
    "confusion_matrix",
    """SELECT model, 0 AS actual, 0 AS predicted, 'TN' AS cell, tn AS count FROM n
    UNION ALL SELECT model, 0, 1, 'FP', fp FROM n UNION ALL SELECT model, 1, 0, 'FN', fn FROM n
    UNION ALL SELECT model, 1, 1, 'TP', tp FROM n""",
    models(2),
    QUALITY,
)
METRICS = f"""
al AS (SELECT q.*, {even('auc', 4)} AS auc_roc FROM q JOIN area USING (model))"""
put(
    "compare_models",
    """SELECT metric, model, value, value = max(value) OVER (PARTITION BY metric) AS is_best
    FROM (UNPIVOT al ON accuracy, precision, recall, f1, auc_roc INTO NAME metric VALUE value)""",
    models(2),
    QUALITY,
    AREA,
    METRICS,
)
put(
    "select_best",
    "SELECT model, auc_roc FROM al ORDER BY auc_roc DESC, model LIMIT 1",
    models(2),
    QUALITY,
    AREA,
    METRICS,
)
CURVE = """
cu AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg,
         row_number() OVER w AS rn, sum(pos) OVER (PARTITION BY model) AS apos,
         sum(neg) OVER (PARTITION BY model) AS aneg
  FROM st WINDOW w AS (PARTITION BY model ORDER BY prob DESC)
),
pt AS (
  SELECT model, row_number() OVER (PARTITION BY model ORDER BY prob DESC) AS point, prob,
         round(fp / aneg, 9) AS fpr, round(tp / apos, 9) AS tpr
  FROM cu WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT DISTINCT model, 0, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM st
)"""
put("roc_curve", "SELECT model, point, prob, fpr, tpr FROM pt", models(4), AREA, CURVE)
put(
    "roc_thin",
    """SELECT pt.model, step, fpr, tpr
    FROM (SELECT model, length, least((SELECT max(length) FROM le), 100) AS m FROM le) x,
         range(100) r(step)
    JOIN pt ON pt.model = x.model AND pt.point = step * x.length // x.m
    WHERE step < x.m""",
    models(4),
    AREA,
    CURVE,
    "le AS (SELECT model, count(*) AS length FROM pt GROUP BY model)",
)

put(
    "model_report",
    """SELECT 'metric' AS section, model, metric AS name, NULL::INT AS position, NULL::DOUBLE AS x, value AS y,
           value = max(value) OVER (PARTITION BY metric) AS flag
    FROM (UNPIVOT al ON accuracy, precision, recall, f1, auc_roc INTO NAME metric VALUE value)
    UNION ALL SELECT 'cell', model, 'TN', 0, NULL, tn::DOUBLE, NULL FROM n
    UNION ALL SELECT 'cell', model, 'FP', 1, NULL, fp::DOUBLE, NULL FROM n
    UNION ALL SELECT 'cell', model, 'FN', 2, NULL, fn::DOUBLE, NULL FROM n
    UNION ALL SELECT 'cell', model, 'TP', 3, NULL, tp::DOUBLE, NULL FROM n
    UNION ALL SELECT 'curve', pt.model, NULL, CAST(step AS INT), fpr, tpr, NULL
    FROM (SELECT model, length, least((SELECT max(length) FROM le), 100) AS m FROM le) x, range(100) r(step)
    JOIN pt ON pt.model = x.model AND pt.point = step * x.length // x.m WHERE step < x.m""",
    models(2),
    QUALITY,
    AREA,
    METRICS,
    CURVE,
    "le AS (SELECT model, count(*) AS length FROM pt GROUP BY model)",
)

# Scenarios

# The keywords and advice in this statement.
SCENARIOS = f"""
fi AS (
  SELECT median("MonthlyIncome") AS fill_amount, median("Age") AS fill_age, median("Department") AS fill_grp,
         median("OverTime") AS fill_flag, {smallest_mode('Department')} AS fill_grp_mode,
         avg("MonthlyIncome") AS fill_amount_mean, avg("Age") AS fill_age_mean, avg("Department") AS fill_grp_mean,
         avg("OverTime") AS fill_flag_mean FROM e
),
sc AS (
  SELECT s.id AS scenario,
    CASE WHEN s.id % 5 = 0 THEN fi.fill_amount WHEN s.id % 7 = 0 THEN 0 ELSE s.amount END AS "MonthlyIncome",
    CASE WHEN s.id % 3 = 0 THEN fi.fill_age ELSE s.age END AS "Age",
    CASE WHEN s.id % 11 = 0 THEN fi.fill_grp_mode WHEN s.id % 13 = 0 OR s.grp IS NULL THEN fi.fill_grp
         ELSE e."Department" END AS "Department",
    CASE WHEN s.id % 4 = 0 THEN fi.fill_flag ELSE e."OverTime" END AS "OverTime"
  FROM s JOIN e ON s.id = e.id, fi
),
sp AS (
  SELECT *, 1 / (1 + exp(-("MonthlyIncome" * (1.0::DOUBLE / 150000) + "Age" * -0.03125::DOUBLE
    + "Department" * 0.25::DOUBLE + "OverTime" * 0.5::DOUBLE + -1.0::DOUBLE))) AS prob FROM sc
),
co AS (
  SELECT scenario, 'MonthlyIncome' AS feature, (1.0::DOUBLE / 150000) * ("MonthlyIncome" - fill_amount_mean) AS v FROM sc, fi
  UNION ALL SELECT scenario, 'Age', -0.03125::DOUBLE * ("Age" - fill_age_mean) FROM sc, fi
  UNION ALL SELECT scenario, 'Department', 0.25::DOUBLE * ("Department" - fill_grp_mean) FROM sc, fi
  UNION ALL SELECT scenario, 'OverTime', 0.5::DOUBLE * ("OverTime" - fill_flag_mean) FROM sc, fi
),
ra AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, v > 0 ORDER BY abs(v) DESC, feature) AS rank FROM co
),
dr AS (
  SELECT scenario,
    coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (v > 0 AND rank <= 3), '') AS risk_factors,
    coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (v < 0 AND rank <= 3), '') AS retention_factors,
    string_agg(CASE feature
      WHEN 'OverTime' THEN 'Reduce mandatory overtime and implement flexible work arrangements.'
      WHEN 'MonthlyIncome' THEN 'Conduct salary benchmarking and consider compensation adjustments.'
      WHEN 'Age' THEN 'Develop a retention plan for mid-career employees — career development and mentoring.'
      ELSE 'Review and improve conditions related to **' || feature || '** through targeted HR intervention.'
      END, ' | ' ORDER BY rank) FILTER (v > 0 AND rank <= 3) AS advice
  FROM ra GROUP BY scenario
)"""
put(
    "score_scenarios",
    f"""SELECT sp.scenario, "MonthlyIncome", "Age", "Department", "OverTime", {even('prob', 4)} AS probability,
    CASE WHEN prob < 0.25 THEN 'Low' WHEN prob < 0.5 THEN 'Medium' WHEN prob < 0.75 THEN 'High'
         ELSE 'Critical' END AS risk_category, risk_factors, retention_factors
    FROM sp JOIN dr ON sp.scenario = dr.scenario""",
    CODED,
    SCENARIOS,
)
put(
    "recommendations",
    """SELECT scenario, coalesce(advice, 'Employee appears stable — continue standard engagement practices.')
    AS recommendations FROM dr""",
    CODED,
    SCENARIOS,
)
