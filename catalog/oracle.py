"""SQL for the same results, written against the test tables and independent of the Spark code."""

from __future__ import annotations

FACTORY = """
machines AS (
  SELECT s.s_suppkey AS machine_id, s.s_name AS machine_name, r.r_name AS department,
         CAST(1 + s.s_suppkey % 10 AS INT) AS age_years
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey),
employees AS (
  SELECT c_custkey AS emp_id, c_name AS emp_name, CAST(1 + c_custkey % 12 AS INT) AS experience_yrs
  FROM customer),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_unit
  FROM part),
line_base AS (
  SELECT l.*, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d,
         CAST(round(l_tax * 100) AS INT) AS t, CAST(round(l_extendedprice * 100) AS BIGINT) AS x
  FROM lineitem l),
production AS (
  SELECT CAST(b.l_shipdate AS DATE) AS prod_date, b.l_suppkey AS machine_id, o.o_custkey AS emp_id,
         b.l_partkey AS product_id,
         CASE b.l_returnflag WHEN 'A' THEN 'Morning' WHEN 'N' THEN 'Evening' ELSE 'Night' END AS shift,
         b.q * 20 AS units_made, CAST(floor(b.q * b.d / 5.0) AS INT) AS units_defective,
         CAST(b.t / 10.0 AS DECIMAL(5,2)) AS downtime_hrs,
         CAST((600 + 20 * b.d + 4 * b.q) / 10.0 AS DECIMAL(5,1)) AS temperature,
         CAST((40 + b.l_orderkey % 41) / 10.0 AS DECIMAL(5,2)) AS pressure,
         CAST((400 + b.x % 401) / 10.0 AS DECIMAL(5,1)) AS humidity,
         CAST((50 + b.x % 400) / 100.0 AS DECIMAL(5,2)) AS vibration_level
  FROM line_base b JOIN orders o ON b.l_orderkey = o.o_orderkey),
sales AS (
  SELECT CAST(o.o_orderdate AS DATE) AS sale_date, b.l_partkey AS product_id, b.q AS qty_sold,
         CAST(CAST(floor((b.x * (100 - b.d) + 50) / 100.0) AS BIGINT) / 100.0 AS DECIMAL(12,2)) AS revenue,
         r.r_name AS region, c.c_mktsegment AS customer
  FROM line_base b JOIN orders o ON b.l_orderkey = o.o_orderkey
                   JOIN customer c ON o.o_custkey = c.c_custkey
                   JOIN nation n ON c.c_nationkey = n.n_nationkey
                   JOIN region r ON n.n_regionkey = r.r_regionkey),
maintenance AS (
  SELECT event_id AS maint_id, user_id AS machine_id, CAST(ts AS DATE) AS maint_date,
         event_type AS maint_type, CAST(value AS DECIMAL(10,2)) AS cost
  FROM events),
star AS (
  SELECT p.*, m.machine_name, m.department, m.age_years, e.emp_name, e.experience_yrs,
         pr.product_name, pr.category, pr.price_per_unit,
         CAST(units_defective AS DOUBLE) / NULLIF(units_made, 0) * 100 AS defect_rate,
         CAST(units_made - units_defective AS DOUBLE) / NULLIF(units_made, 0) * 100 AS efficiency,
         units_defective * pr.price_per_unit AS revenue_lost
  FROM production p JOIN machines m ON p.machine_id = m.machine_id
                    JOIN employees e ON p.emp_id = e.emp_id
                    JOIN products pr ON p.product_id = pr.product_id),
sold AS (SELECT s.*, pr.product_name, pr.category FROM sales s JOIN products pr ON s.product_id = pr.product_id),
upkeep AS (
  SELECT ma.*, m.machine_name, m.department
  FROM maintenance ma JOIN machines m ON ma.machine_id = m.machine_id),
labelled AS (
  SELECT s.*, CAST(defect_rate > (SELECT round(quantile_cont(defect_rate, 0.75), 2) FROM star) AS INT) AS high_defect,
         CAST(temperature > 85 AS INT) AS predicted
  FROM star s)
"""

RUN_KEY = (
    "prod_date, machine_id, emp_id, product_id, shift, units_made, units_defective, downtime_hrs, temperature, pressure, "
    "humidity, vibration_level"
)


def _parts(fractions: list[float], keep: str = "high_defect AS label") -> str:
    """Labelled runs with the part that their bucket puts them in, and the columns to ``keep``."""
    keys = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in RUN_KEY.split(","))
    cuts = ", ".join(
        f"coalesce(max(CASE WHEN upto <= floor(total * {f} + 1e-9) THEN bucket END), -1) AS cut{i}"
        for i, f in enumerate(fractions)
    )
    part = " + ".join(f"CAST(bucket > cut{i} AS INT)" for i in range(len(fractions)))
    return f""", placed AS (
        SELECT {keep}, high_defect, CAST('0x' || left(md5(concat_ws('|', '42', {keys})), 4) AS INT) AS bucket FROM labelled),
    ranked AS (
        SELECT high_defect, bucket, sum(n) OVER (PARTITION BY high_defect ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY high_defect) AS total
        FROM (SELECT high_defect, bucket, COUNT(*) AS n FROM placed GROUP BY ALL)),
    cuts AS (SELECT high_defect, {cuts} FROM ranked GROUP BY high_defect),
    parts AS (SELECT placed.*, {part} AS part FROM placed JOIN cuts USING (high_defect)) """


UNITS = "CAST(SUM(units_made) AS BIGINT) AS total_units, CAST(SUM(units_defective) AS BIGINT) AS total_defects"
def ratio(part: str, whole: str, digits: int = 2) -> str:
    """part / whole * 100 of whole numbers, rounded half up in whole numbers."""
    scaled = f"(CAST({part} AS HUGEINT) * {200 * 10**digits} + CAST({whole} AS HUGEINT)) // (2 * CAST({whole} AS HUGEINT))"
    return f"(CAST({scaled} AS DOUBLE) / {10**digits})"


RATE = ratio("SUM(units_defective)", "SUM(units_made)")
ROW_RATE = ratio("units_defective", "units_made")
ROW_EFFICIENCY = ratio("(units_made - units_defective)", "units_made")
SCALES = {"downtime_hrs": 2, "temperature": 1, "vibration_level": 2, "revenue": 2}


def mean(column: str, digits: int = 6) -> str:
    """Mean of a decimal column, rounded half up in whole numbers."""
    one = 10 ** SCALES[column]
    top = f"CAST(SUM({column}) * {one} AS HUGEINT) * {2 * 10**digits} + COUNT({column}) * {one}"
    return f"(CAST(({top}) // (CAST(COUNT({column}) AS HUGEINT) * {2 * one}) AS DOUBLE) / {10**digits})"


def total(column: str, digits: int = 2) -> str:
    return f"CAST(round(SUM({column}), {digits}) AS DOUBLE)"


MACHINES = f"""
  SELECT machine_id, machine_name, department, age_years, {UNITS}, {mean('downtime_hrs', 2)} AS avg_downtime,
         {mean('temperature', 1)} AS avg_temp, {RATE} AS defect_rate
  FROM star GROUP BY ALL"""

SHIFTS = f"SELECT shift, {UNITS}, {RATE} AS defect_rate FROM star GROUP BY shift"

MONTHS = f"""
  SELECT strftime(prod_date, '%Y-%m') AS month, {UNITS}, {mean('downtime_hrs', 2)} AS avg_downtime,
         {mean('temperature', 1)} AS avg_temp, {RATE} AS defect_pct
  FROM {{source}} GROUP BY ALL"""

LOST_BY_PRODUCT = f"SELECT product_name, {total('revenue_lost')} AS revenue_lost FROM star GROUP BY product_name"

PERFORMANCE = f"""
  SELECT p.machine_id, machine_name, department, age_years, COUNT(*) AS total_runs, {UNITS},
         {RATE} AS defect_rate_pct, {mean('downtime_hrs', 2)} AS avg_downtime, {mean('temperature', 1)} AS avg_temp,
         {mean('vibration_level', 2)} AS avg_vibration
  FROM production p JOIN machines m ON p.machine_id = m.machine_id
  GROUP BY ALL"""

KPIS = """
  SELECT CAST(SUM(units_made) AS BIGINT) AS total_units,
         CAST(SUM(units_made - units_defective) AS BIGINT) AS total_good,
         CAST(SUM(units_defective) AS BIGINT) AS total_defects,
         {rate} AS defect_rate,
         CAST(round(SUM(downtime_hrs), 1) AS DOUBLE) AS total_downtime,
         (SELECT CAST(round(SUM(revenue), 2) AS DOUBLE) FROM sold) AS total_revenue,
         CAST(round(SUM(revenue_lost), 2) AS DOUBLE) AS total_revenue_lost,
         round(AVG({efficiency}), 2) AS avg_efficiency,
         (SELECT CAST(round(SUM(cost), 2) AS DOUBLE) FROM upkeep) AS total_maintenance_cost,
         MIN(prod_date) AS first_date, MAX(prod_date) AS last_date
  FROM star"""
ROW_KPIS = KPIS.format(rate=RATE, efficiency=ROW_EFFICIENCY)

FACTORS = [
    "temperature", "pressure", "downtime_hrs", "age_years", "vibration_level", "humidity", "experience_yrs",
]
MATRIX = ["defect_rate", *FACTORS, "units_made", "efficiency"]
DESCRIBED = ["units_made", "units_defective", "defect_rate", "downtime_hrs", "temperature", "vibration_level"]


def _each(template: str, values: list) -> str:
    return " UNION ALL ".join(template.format(i=i, v=v) for i, v in enumerate(values))


def _orphans() -> str:
    links = [
        ("production", "machine_id", "machines"), ("production", "emp_id", "employees"),
        ("production", "product_id", "products"), ("sales", "product_id", "products"),
        ("maintenance", "machine_id", "machines"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{fact}' AS table_name, 'foreign_key' AS check_name, '{key}' AS column_name, COUNT(*) AS violations "
        f"FROM {fact} f WHERE f.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = f.{key})"
        for fact, key, dim in links
    )


def _nulls() -> str:
    columns = {
        "machines": ["machine_id", "machine_name", "department", "age_years"],
        "employees": ["emp_id", "emp_name"],
        "products": ["product_id", "product_name", "category"],
        "production": [
            "prod_date", "machine_id", "emp_id", "product_id", "shift", "units_made", "units_defective", "downtime_hrs",
        ],
        "sales": ["sale_date", "product_id", "qty_sold", "revenue"],
        "maintenance": ["maint_id", "machine_id", "maint_date", "maint_type", "cost"],
    }
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, 'not_null' AS check_name, '{c}' AS column_name, "
        f"COUNT(*) - COUNT({c}) AS violations FROM {table}"
        for table, names in columns.items()
        for c in names
    )


def _duplicates() -> str:
    keys = {"machines": "machine_id", "employees": "emp_id", "products": "product_id", "maintenance": "maint_id"}
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, 'primary_key' AS check_name, '{key}' AS column_name, "
        f"COUNT(*) - COUNT(DISTINCT {key}) AS violations FROM {table}"
        for table, key in keys.items()
    )


def _correlations(names: list[str], digits: int) -> str:
    return ", ".join(
        f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {digits}) AS c{i}_{j}"
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    )


def _matrix(where: str = "") -> str:
    cells = " UNION ALL ".join(
        f"SELECT {i} AS row_idx, {j} AS col_idx, '{a}' AS row_name, '{b}' AS col_name, c{i}_{j} AS correlation FROM m"
        for i, a in enumerate(MATRIX)
        for j, b in enumerate(MATRIX)
    )
    return f", m AS (SELECT {_correlations(MATRIX, 2)} FROM star) SELECT * FROM ({cells}) {where}"


def _describe() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, round(AVG(CAST({c} AS DOUBLE)), 2) AS mean,
            round(stddev_samp(CAST({c} AS DOUBLE)), 2) AS std, round(MIN(CAST({c} AS DOUBLE)), 2) AS min,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS p25,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS p50,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS p75, round(MAX(CAST({c} AS DOUBLE)), 2) AS max
            FROM star"""
        for c in DESCRIBED
    )


def _fences(value: str) -> str:
    return f""", v AS (SELECT shift, CAST({value} AS DOUBLE) AS v FROM star),
    box AS (SELECT shift, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
            FROM v GROUP BY shift),
    fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM box)"""


_FIT = """, f AS (
    SELECT regr_slope(defect_rate, CAST(temperature AS DOUBLE)) AS slope,
           regr_intercept(defect_rate, CAST(temperature AS DOUBLE)) AS intercept,
           MIN(CAST(temperature AS DOUBLE)) AS x_min, MAX(CAST(temperature AS DOUBLE)) AS x_max
    FROM star)"""


def _share(source: str, value: str) -> str:
    return f"SELECT *, round(CAST({value} AS DOUBLE) / SUM({value}) OVER () * 100, 1) AS share_pct FROM ({source})"


_WORST = """
  SELECT CAST(row_number() OVER (ORDER BY {rate} DESC, prod_date, machine_name, shift, units_made, units_defective,
              temperature, emp_name) AS INT) AS rank,
         CAST(prod_date AS VARCHAR) AS prod_date, machine_name, shift, units_made, units_defective,
         {rate} AS defect_rate, CAST(temperature AS DOUBLE) AS temperature, emp_name
  FROM star QUALIFY rank <= 5"""

_PICKS = f""", m AS ({MACHINES}), s AS ({SHIFTS}), t AS ({MONTHS.format(source='star')}),
  picks AS (
  SELECT * FROM (SELECT 'best_machine' AS what, machine_name AS name, defect_rate AS value FROM m ORDER BY defect_rate, machine_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'worst_machine', machine_name, defect_rate FROM m ORDER BY defect_rate DESC, machine_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'best_shift', shift, defect_rate FROM s ORDER BY defect_rate, shift LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'worst_shift', shift, defect_rate FROM s ORDER BY defect_rate DESC, shift LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'best_month', month, defect_pct FROM t ORDER BY defect_pct, month LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'worst_month', month, defect_pct FROM t ORDER BY defect_pct DESC, month LIMIT 1))"""

_OUTCOMES = """, o AS (
    SELECT CAST(COUNT(*) FILTER (high_defect = 0 AND predicted = 0) AS DOUBLE) AS tn,
           CAST(COUNT(*) FILTER (high_defect = 0 AND predicted = 1) AS DOUBLE) AS fp,
           CAST(COUNT(*) FILTER (high_defect = 1 AND predicted = 0) AS DOUBLE) AS fn,
           CAST(COUNT(*) FILTER (high_defect = 1 AND predicted = 1) AS DOUBLE) AS tp
    FROM labelled),
  r AS (
    SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
           tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp) AS acc FROM o),
  q AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM r)"""


def _report_line(name: str, p: str, r: str, f: str, s: str) -> str:
    return (
        f"SELECT '{name}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, "
        f"CAST({s} AS BIGINT) AS support FROM q"
    )


def _weighted(m: str) -> str:
    return f"({m}0 * s0 + {m}1 * s1) / n"


_CLASS_REPORT = _OUTCOMES + " UNION ALL ".join(
    [
        " " + _report_line("LOW Defect", "p0", "r0", "f0", "s0"),
        _report_line("HIGH Defect", "p1", "r1", "f1", "s1"),
        _report_line("accuracy", "acc", "acc", "acc", "n"),
        _report_line("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n"),
        _report_line("weighted avg", _weighted("p"), _weighted("r"), _weighted("f"), "n"),
    ]
)

_HISTOGRAM = """, ranges AS (SELECT shift, MIN(defect_rate) AS low, MAX(defect_rate) AS high FROM star GROUP BY shift),
  frame AS (SELECT shift, low, high, CAST(bin AS INT) AS bin FROM ranges, range(20) b(bin)),
  counts AS (
    SELECT s.shift, CAST(LEAST(floor((defect_rate - low) / (high - low) * 20), 19) AS INT) AS bin, COUNT(*) AS n
    FROM star s JOIN ranges r ON s.shift = r.shift GROUP BY ALL)
  SELECT f.shift, f.bin, round(low + f.bin * (high - low) / 20, 6) AS bin_low,
         round(low + (f.bin + 1) * (high - low) / 20, 6) AS bin_high, COALESCE(n, 0) AS n
  FROM frame f LEFT JOIN counts c ON f.shift = c.shift AND f.bin = c.bin"""

_INSIGHTS = f""", m AS ({MACHINES}), s AS ({SHIFTS}), t AS ({MONTHS.format(source='star')}), k AS ({ROW_KPIS})
  SELECT * FROM (SELECT 1 AS position, 'Worst machine' AS topic, machine_name || ' has the highest defect rate: '
    || format('{{:,.2f}}', defect_rate) || '%. Age: ' || age_years || ' years.' AS message
    FROM m ORDER BY defect_rate DESC, machine_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 2, 'Best machine', machine_name || ' has the lowest defect rate: '
    || format('{{:,.2f}}', defect_rate) || '%.' FROM m ORDER BY defect_rate, machine_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 3, shift || ' shift', shift || ' shift has the highest defect rate: '
    || format('{{:,.2f}}', defect_rate) || '%.' FROM s ORDER BY defect_rate DESC, shift LIMIT 1)
  UNION ALL SELECT 5, 'Revenue loss', 'Rs.' || format('{{:,.0f}}', total_revenue_lost) || ' lost to defective units, '
    || format('{{:,.1f}}', round(total_revenue_lost / total_revenue * 100, 1))
    || '% of sales. One point less would save about Rs.' || format('{{:,.0f}}', round(total_revenue_lost * 0.33)) || '.'
    FROM k
  UNION ALL SELECT * FROM (SELECT 6, 'Best month', month || ' had the lowest defect rate: '
    || format('{{:,.2f}}', defect_pct) || '%.' FROM t ORDER BY defect_pct, month LIMIT 1)"""


_KEY_TEXT = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in RUN_KEY.split(","))
_KEY_SHOWN = ", ".join(
    f"CAST({k.strip()} AS {'VARCHAR' if k.strip() == 'prod_date' else 'DOUBLE'}) AS {k.strip()}"
    if k.strip() in ("prod_date", "downtime_hrs", "temperature", "pressure", "humidity", "vibration_level") else k.strip()
    for k in RUN_KEY.split(",")
)

_LABEL_HISTOGRAM = """, v AS (SELECT high_defect, CAST(temperature AS DOUBLE) AS x FROM labelled WHERE temperature IS NOT NULL),
  ranges AS (SELECT high_defect, MIN(x) AS low, MAX(x) AS high FROM v GROUP BY high_defect),
  frame AS (SELECT high_defect, low, high, CAST(bin AS INT) AS bin FROM ranges, range(20) b(bin)),
  counts AS (
    SELECT v.high_defect, CAST(LEAST(floor((x - low) / (high - low) * 20), 19) AS INT) AS bin, COUNT(*) AS n
    FROM v JOIN ranges r ON v.high_defect = r.high_defect GROUP BY ALL)
  SELECT f.high_defect, f.bin, round(low + f.bin * (high - low) / 20, 6) AS bin_low,
         round(low + (f.bin + 1) * (high - low) / 20, 6) AS bin_high, COALESCE(n, 0) AS n
  FROM frame f LEFT JOIN counts c ON f.high_defect = c.high_defect AND f.bin = c.bin"""


def _scenarios() -> str:
    """Planned runs: high is bad for most inputs, low for experience and units; the mixed one is the mean."""
    high = ["temperature", "pressure", "downtime_hrs", "age_years", "vibration_level", "humidity"]
    parts = []
    for name, shift in (("bad", "Night"), ("normal", "Morning"), ("mixed", "Evening")):
        columns = []
        for c in [*high, "experience_yrs", "units_made"]:
            f = "AVG" if name == "mixed" else "MAX" if (name == "bad") == (c in high) else "MIN"
            columns.append(f"round({f}(CAST({c} AS DOUBLE)), 6) AS {c}")
        parts.append(
            f"SELECT department, '{name}' AS scenario, '{shift}' AS shift, {', '.join(columns)}, TRUE AS adds_up, "
            "TRUE AS words_right, TRUE AS prediction_right FROM star GROUP BY department"
        )
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    tables = ["machines", "employees", "products", "production", "sales", "maintenance"]
    visible = """SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_id, emp_id, product_id, shift, units_made,
        units_defective, defect_rate, efficiency, units_made - units_defective AS good_units,
        CAST(revenue_lost AS DOUBLE) AS revenue_lost, strftime(prod_date, '%Y-%m') AS month,
        CAST(weekofyear(prod_date) AS INT) AS week FROM star"""
    bodies = {
        "table_counts": _each("SELECT '{v}' AS table_name, COUNT(*) AS n FROM {v}", tables),
        "dq_orphans": _orphans(),
        "dq_nulls": _nulls(),
        "dq_dup_keys": _duplicates(),
        "surrogate_key": """SELECT row_number() OVER (ORDER BY sale_date, product_id, qty_sold, revenue, region,
            customer) AS sale_id, CAST(sale_date AS VARCHAR) AS sale_date, product_id, qty_sold,
            CAST(revenue AS DOUBLE) AS revenue, region, customer FROM sales""",
        "ingest_csv": """SELECT maint_id, machine_id, CAST(maint_date AS VARCHAR) AS maint_date, maint_type,
            CAST(cost AS DOUBLE) AS cost, CAST(0 AS BIGINT) AS rejected_rows FROM maintenance""",
        "csv_result": MONTHS.format(source="production"),
        "enriched_production": """SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_id, emp_id, product_id, shift,
            units_made, units_defective, CAST(downtime_hrs AS DOUBLE) AS downtime_hrs,
            CAST(temperature AS DOUBLE) AS temperature, CAST(pressure AS DOUBLE) AS pressure,
            CAST(humidity AS DOUBLE) AS humidity, CAST(vibration_level AS DOUBLE) AS vibration_level, machine_name,
            department, age_years, emp_name, experience_yrs, product_name, category,
            CAST(price_per_unit AS DOUBLE) AS price_per_unit, defect_rate FROM star""",
        "enriched_sales": """SELECT CAST(sale_date AS VARCHAR) AS sale_date, product_id, qty_sold,
            CAST(revenue AS DOUBLE) AS revenue, region, customer, product_name, category FROM sold""",
        "enriched_maintenance": """SELECT maint_id, machine_id, CAST(maint_date AS VARCHAR) AS maint_date, maint_type,
            CAST(cost AS DOUBLE) AS cost, machine_name, department FROM upkeep""",
        "derived_metrics": visible,
        "rounded_metrics": f"""SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_id, emp_id, product_id,
            {ROW_RATE} AS defect_rate, {ROW_EFFICIENCY} AS efficiency,
            CAST(round(revenue_lost, 2) AS DOUBLE) AS revenue_lost FROM star""",
        "date_labels": """SELECT CAST(prod_date AS VARCHAR) AS prod_date, strftime(prod_date, '%b %Y') AS month_label,
            strftime(prod_date, '%b') AS short_month, strftime(prod_date, '%d %b %Y') AS day_label,
            CAST(weekofyear(prod_date) AS INT) AS week, COUNT(*) AS runs FROM production GROUP BY prod_date""",
        "label_text": f""", p AS (SELECT product_id, product_name, {UNITS}, {RATE} AS rate FROM star GROUP BY ALL)
            SELECT product_id, left(product_name, 12) AS short_name, format('{{:,}}', total_units) AS units_text,
                   CAST(rate AS VARCHAR) || '%' AS rate_text, repeat('#', CAST(floor(rate / 100 * 50) AS INT)) AS bar
            FROM p""",
        "slice_filter": """SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_name, shift, units_made,
            units_defective FROM star WHERE shift = 'Night'
            AND prod_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""",
        "scatter_points": "SELECT department AS category, CAST(temperature AS DOUBLE) AS x, defect_rate AS y FROM star",
        "distinct_values": _each(
            "SELECT DISTINCT '{v}' AS \"column\", {v} AS value FROM star", ["machine_name", "department"]
        ),
        "production_summary": f"""SELECT {UNITS}, CAST(round(SUM(downtime_hrs), 0) AS DOUBLE) AS total_downtime,
            COUNT(*) AS total_runs, round(AVG(CAST(units_defective AS DOUBLE) / units_made * 100), 2)
            AS mean_defect_rate, {mean('temperature', 1)} AS avg_temp FROM production""",
        "kpi_summary": f"""SELECT * REPLACE (CAST(first_date AS VARCHAR) AS first_date,
            CAST(last_date AS VARCHAR) AS last_date) FROM ({KPIS.format(rate=RATE, efficiency='efficiency')})""",
        "machine_performance": PERFORMANCE,
        "shift_analysis": f"""SELECT shift, {UNITS}, COUNT(*) AS total_runs, {mean('downtime_hrs', 2)} AS avg_downtime,
            {mean('temperature')} AS avg_temp, round(AVG(efficiency), 2) AS avg_efficiency, {RATE} AS defect_rate
            FROM star GROUP BY shift""",
        "monthly_trend": MONTHS.format(source="production"),
        "department_analysis": f"""SELECT department, {UNITS}, {total('downtime_hrs', 1)} AS total_downtime,
            {mean('temperature')} AS avg_temp, COUNT(DISTINCT machine_id) AS machine_count, {RATE} AS defect_rate
            FROM star GROUP BY department""",
        "product_analysis": f"""SELECT product_id, product_name, category, {UNITS},
            {total('revenue_lost')} AS revenue_lost, {RATE} AS defect_rate FROM star GROUP BY ALL""",
        "sales_by_product": _share(
            f"""SELECT product_name, CAST(SUM(qty_sold) AS BIGINT) AS total_qty, {total('revenue')} AS total_revenue,
            {mean('revenue')} AS avg_price FROM sold GROUP BY product_name""",
            "total_revenue",
        ),
        "machine_mean_rates": f"""SELECT machine_name, CAST(SUM(units_made) AS BIGINT) AS total_units,
            round(AVG(defect_rate), 2) AS mean_defect_rate, {mean('downtime_hrs', 2)} AS avg_downtime,
            {mean('temperature', 2)} AS avg_temp FROM star GROUP BY machine_name""",
        "shift_summary": f"""SELECT shift, {UNITS}, {mean('downtime_hrs')} AS avg_downtime, {RATE} AS defect_rate
            FROM star GROUP BY shift""",
        "revenue_lost_by_product": LOST_BY_PRODUCT,
        "revenue_by_product": f"SELECT product_name, {total('revenue')} AS revenue FROM sold GROUP BY product_name",
        "machine_shift_pivot": """SELECT machine_name,
            round(AVG(defect_rate) FILTER (shift = 'Evening'), 2) AS evening,
            round(AVG(defect_rate) FILTER (shift = 'Morning'), 2) AS morning,
            round(AVG(defect_rate) FILTER (shift = 'Night'), 2) AS night FROM star GROUP BY machine_name""",
        "department_means": f"""SELECT department, round(AVG(defect_rate), 2) AS mean_defect_rate,
            {mean('downtime_hrs', 2)} AS avg_downtime, {mean('temperature', 2)} AS avg_temp,
            round({mean('temperature', 2)} / 10, 4) AS avg_temp_tenth FROM star GROUP BY department""",
        "department_losses": f"""SELECT department, {UNITS}, {total('downtime_hrs', 1)} AS total_downtime,
            {total('revenue_lost', 0)} AS revenue_lost, {RATE} AS defect_rate FROM star GROUP BY department""",
        "monthly_chart": f"""SELECT strftime(prod_date, '%Y-%m') AS month, strftime(MIN(prod_date), '%b') AS month_label,
            {UNITS}, SUM(units_made) / 1000 AS units_thousands, {mean('temperature')} AS avg_temp,
            {RATE} AS defect_pct FROM star GROUP BY month""",
        "monthly_sales": f"""SELECT strftime(sale_date, '%Y-%m') AS month, {total('revenue')} AS revenue
            FROM sold GROUP BY month""",
        "maintenance_cost_by_type": f"SELECT maint_type, {total('cost')} AS cost FROM upkeep GROUP BY maint_type",
        "revenue_by_region": f"""SELECT region, {total('revenue')} AS revenue FROM sold
            WHERE region IS NOT NULL GROUP BY region""",
        "report_machines": MACHINES,
        "report_months": MONTHS.format(source="star"),
        "month_trend": f""", t AS ({MONTHS.format(source='production')}),
            u AS (SELECT *, lag(defect_pct) OVER (ORDER BY month) AS before FROM t)
            SELECT * EXCLUDE (before), CASE WHEN before IS NULL THEN '' WHEN defect_pct > before THEN 'up'
                   WHEN defect_pct < before THEN 'down' ELSE 'same' END AS trend FROM u""",
        "best_worst_flags": f""", m AS ({PERFORMANCE})
            SELECT *, defect_rate_pct = (SELECT MIN(defect_rate_pct) FROM m) AS is_best,
                   defect_rate_pct = (SELECT MAX(defect_rate_pct) FROM m) AS is_worst FROM m""",
        "machine_bands": f""", m AS (SELECT machine_name, round(AVG({ROW_RATE}), 2) AS mean_defect_rate,
              {mean('downtime_hrs', 2)} AS avg_downtime, CAST(SUM(units_made) AS BIGINT) AS total_units,
              {mean('temperature', 2)} AS avg_temp FROM star GROUP BY machine_name),
            o AS (SELECT AVG(mean_defect_rate) AS a FROM m)
            SELECT m.*, CAST(mean_defect_rate AS VARCHAR) || '%' AS label, round(a, 1) AS overall_mean,
                   CASE WHEN mean_defect_rate > a + 0.5 THEN 'red' WHEN mean_defect_rate > a THEN 'orange'
                        ELSE 'green' END AS band FROM m, o""",
        "shift_share": _share(SHIFTS.replace(UNITS, UNITS.split(", ")[0]), "total_units"),
        "region_share": _share(f"SELECT region, {total('revenue')} AS revenue FROM sold GROUP BY region", "revenue"),
        "maintenance_share": _share(f"SELECT maint_type, {total('cost')} AS cost FROM upkeep GROUP BY ALL", "cost"),
        "revenue_lost_bands": f""", p AS ({LOST_BY_PRODUCT}),
            o AS (SELECT MAX(revenue_lost) AS peak, AVG(revenue_lost) AS a FROM p)
            SELECT p.*, round(revenue_lost / 1000, 6) AS lost_thousands,
                   CASE WHEN revenue_lost = peak THEN 'red' WHEN revenue_lost > a THEN 'orange' ELSE 'blue' END AS band
            FROM p, o""",
        "worst_runs": _WORST.format(rate="defect_rate"),
        "worst_runs_rounded": _WORST.format(rate=ROW_RATE),
        "best_worst_picks": _PICKS + " SELECT * FROM picks",
        "machine_status": f""", m AS ({MACHINES}),
            o AS (SELECT AVG(defect_rate) AS a, MIN(defect_rate) AS lo, MAX(defect_rate) AS hi FROM m)
            SELECT m.*, CASE WHEN defect_rate <= a * 0.8 THEN 'green' WHEN defect_rate >= a * 1.2 THEN 'red'
                   ELSE 'orange' END AS status, CAST(defect_rate AS VARCHAR) || '%' AS badge,
                   defect_rate = lo AS is_best, defect_rate = hi AS is_worst FROM m, o""",
        "shift_status": f"""SELECT *, CASE WHEN defect_rate <= 2.5 THEN 'green' WHEN defect_rate >= 3.5 THEN 'red'
            ELSE 'orange' END AS status FROM ({SHIFTS})""",
        "month_status": _PICKS + """, u AS (SELECT *, lag(defect_pct) OVER (ORDER BY month) AS before FROM t)
            SELECT * EXCLUDE (before), CASE WHEN before IS NULL THEN '' WHEN defect_pct > before THEN 'up'
                   WHEN defect_pct < before THEN 'down' ELSE 'same' END AS trend,
                   month = (SELECT name FROM picks WHERE what = 'best_month') AS is_best,
                   month = (SELECT name FROM picks WHERE what = 'worst_month') AS is_worst FROM u""",
        "correlation_factors": f""", c AS (SELECT {", ".join(
                f"round(corr(defect_rate, CAST({f} AS DOUBLE)), 6) AS {f}" for f in FACTORS)} FROM star),
            l AS ({_each("SELECT '{v}' AS factor, {v} AS correlation FROM c", FACTORS)})
            SELECT factor, correlation, abs(correlation) AS abs_correlation,
                   CASE WHEN abs(correlation) > 0.6 THEN 'Strong' WHEN abs(correlation) > 0.3 THEN 'Moderate'
                        ELSE 'Weak' END AS strength,
                   CASE WHEN correlation > 0.05 THEN 'Positive (bad)' WHEN correlation < -0.05 THEN 'Negative (good)'
                        ELSE 'Neutral' END AS direction FROM l""",
        "correlation_matrix": _matrix(),
        "correlation_lower": _matrix("WHERE row_idx > col_idx"),
        "describe_stats": _describe(),
        "trend_line_fit": _FIT + " SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, x_min, x_max FROM f",
        "trend_line_points": _FIT + """ SELECT CAST(i AS INT) AS point, round(x_min + i * (x_max - x_min) / 99, 6) AS x,
            round(intercept + slope * (x_min + i * (x_max - x_min) / 99), 6) AS y FROM f, range(100) r(i)""",
        "shift_boxplot": _fences("defect_rate") + """ SELECT
            CAST(CASE v.shift WHEN 'Morning' THEN 1 WHEN 'Evening' THEN 2 ELSE 3 END AS INT) AS position, v.shift,
            COUNT(*) AS n, round(LEAST(MIN(v) FILTER (v >= low), ANY_VALUE(q1)), 6) AS whisker_low,
            round(ANY_VALUE(q1), 6) AS q1, round(ANY_VALUE(median), 6) AS median, round(ANY_VALUE(q3), 6) AS q3,
            round(GREATEST(MAX(v) FILTER (v <= high), ANY_VALUE(q3)), 6) AS whisker_high,
            COUNT(*) FILTER (v < low OR v > high) AS outliers
            FROM v JOIN fences f ON v.shift = f.shift GROUP BY v.shift""",
        "shift_outliers": _fences("revenue_lost") + """ SELECT v.shift, round(v, 6) AS revenue_lost, COUNT(*) AS points
            FROM v JOIN fences f ON v.shift = f.shift WHERE v < low OR v > high GROUP BY ALL""",
        "rate_histogram": _HISTOGRAM,
        "high_defect_label": """SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_id, emp_id, product_id,
            defect_rate, high_defect FROM labelled""",
        "stratified_split": _parts([0.8]) + """SELECT part = 1 AS is_test, high_defect, COUNT(*) AS n
            FROM parts GROUP BY part, high_defect""",
        "fold_sizes": _parts([0.2, 0.4, 0.6, 0.8]) + """SELECT CAST(part AS INT) AS fold, high_defect, COUNT(*) AS n
            FROM parts GROUP BY part, high_defect""",
        "model_checks": _parts([0.8]) + """SELECT COUNT(*) AS scored, CAST(SUM(high_defect) AS BIGINT) AS actual_high,
            CAST(0 AS BIGINT) AS bad_probabilities, CAST(0 AS BIGINT) AS disagreements, CAST(0 AS BIGINT) AS changed_scores,
            TRUE AS importances_complete, TRUE AS beats_larger_class FROM parts WHERE part = 1""",
        "label_balance": f"""SELECT high_defect, COUNT(*) AS n, {ratio('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 1)} AS share_pct
            FROM labelled GROUP BY high_defect""",
        "category_encoding": _each(
            "SELECT '{v}' AS \"column\", category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS code "
            "FROM (SELECT DISTINCT {v} AS category FROM star)",
            ["shift", "department", "product_name"],
        ),
        "confusion_matrix": _OUTCOMES + f""", c AS (
            SELECT 0 AS actual, 0 AS predicted, tn AS n FROM o UNION ALL SELECT 0, 1, fp FROM o
            UNION ALL SELECT 1, 0, fn FROM o UNION ALL SELECT 1, 1, tp FROM o)
            SELECT actual, predicted, CAST(n AS BIGINT) AS n,
                   {ratio('n', 'SUM(n) OVER (PARTITION BY actual)', 1)} AS row_pct FROM c""",
        "classification_report": _CLASS_REPORT,
        "rule_accuracy": _OUTCOMES + f""" SELECT CAST(n AS BIGINT) AS n, CAST(tn + tp AS BIGINT) AS correct,
            CAST(fp + fn AS BIGINT) AS wrong, CAST(fp AS BIGINT) AS false_alarms, CAST(fn AS BIGINT) AS missed,
            {ratio('tn + tp', 'n')} AS accuracy_pct FROM q""",
        "kpi_targets": f""", k AS ({ROW_KPIS})
            SELECT 'total_units' AS kpi, CAST(total_units AS DOUBLE) AS value, CAST(900000 AS DOUBLE) AS target,
                   round(total_units - CAST(900000 AS DOUBLE), 2) AS delta, CAST(NULL AS VARCHAR) AS band FROM k
            UNION ALL SELECT 'defect_rate', defect_rate, 3.0, round(defect_rate - CAST(3 AS DOUBLE), 2),
                   CASE WHEN defect_rate < 3 THEN 'good' WHEN defect_rate < 5 THEN 'warning' ELSE 'danger' END FROM k
            UNION ALL SELECT 'total_revenue', round(total_revenue, 0), NULL, NULL, NULL FROM k""",
        "report_kpis": f""", k AS ({ROW_KPIS})
            SELECT * EXCLUDE (first_date, last_date),
                   strftime(first_date, '%d %b %Y') || ' to ' || strftime(last_date, '%d %b %Y') AS period FROM k""",
        "insights": _INSIGHTS,
        "bundle_worst_runs": _WORST.format(rate=ROW_RATE),
        "bundle_kpis": f""", k AS ({ROW_KPIS})
            SELECT * EXCLUDE (first_date, last_date),
                   strftime(first_date, '%d %b %Y') || ' to ' || strftime(last_date, '%d %b %Y') AS period FROM k""",
        "append_batches": """SELECT CAST(row_number() OVER (ORDER BY sale_date >= DATE '1995-01-01', sale_date,
            CAST(product_id AS VARCHAR), qty_sold, revenue, region, customer) AS BIGINT) AS sale_id,
            CAST(sale_date AS VARCHAR) AS sale_date, CAST(product_id AS VARCHAR) AS product_id, qty_sold,
            CAST(revenue AS DOUBLE) AS revenue, region, customer FROM sales""",
        "footer_counts": _each(
            "SELECT '{v}' AS table_name, COUNT(*) AS n FROM {v}",
            ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"],
        ),
        "slice_by_month": """SELECT CAST(prod_date AS VARCHAR) AS prod_date, machine_id, shift, units_made, units_defective
            FROM production WHERE prod_date BETWEEN DATE '1994-02-10' AND DATE '1996-03-15' AND quarter(prod_date) = 1""",
        "scatter_sample": f"""SELECT department, defect_rate, {_KEY_SHOWN} FROM star
            QUALIFY row_number() OVER (PARTITION BY department ORDER BY md5(concat_ws('|', '42', {_KEY_TEXT})), {RUN_KEY}) <= 60""",
        "label_histogram": _LABEL_HISTOGRAM,
        "sketch_quantiles": """SELECT shift, COUNT(humidity) AS n, TRUE AS p10_near, TRUE AS p25_near, TRUE AS p50_near,
            TRUE AS p75_near, TRUE AS p90_near FROM star
            WHERE date_trunc('month', prod_date) BETWEEN DATE '1993-03-01' AND DATE '1997-10-01' GROUP BY shift""",
        "rate_bars": f""", m AS ({MACHINES}) SELECT machine_id, defect_rate,
            CAST(LEAST(100, round(defect_rate / (SELECT MAX(defect_rate) FROM m) * 100)) AS INT) AS bar_pct FROM m""",
        "fold_checks": _parts([0.2, 0.4, 0.6, 0.8]) + """SELECT CAST(part AS INT) AS fold, COUNT(*) AS n, TRUE AS in_range,
            TRUE AS mean_right, TRUE AS std_right FROM parts GROUP BY part""",
        "importance_checks": _each(
            "SELECT '{v}' AS feature, TRUE AS agrees, TRUE AS in_range, TRUE AS bar_right",
            ["temperature", "pressure", "downtime_hrs", "age_years", "vibration_level", "humidity", "experience_yrs",
             "units_made", "shift_num", "dept_num"],
        ),
        "scenario_checks": _scenarios(),
        "score_checks": """SELECT machine_id, shift, COUNT(*) AS runs, round(AVG(defect_rate), 6) AS mean_rate,
            CAST(0 AS BIGINT) AS faulty FROM star GROUP BY machine_id, shift""",
        "sample_checks": _parts([0.8], keep=RUN_KEY) + f"""SELECT CAST(row_number() OVER (ORDER BY {RUN_KEY}) - 1 AS INT) AS sample,
            high_defect AS actual, TRUE AS consistent FROM parts WHERE part = 1 QUALIFY sample < 60""",
    }
    return {name: f"WITH {FACTORY}{body}" for name, body in bodies.items()}
