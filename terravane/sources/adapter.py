"""The lending platform's tables, laid over the given test tables.

Each view is one SELECT that Spark and DuckDB read alike; ``view`` gives the
DataFrame, ``oracle`` puts the views that a DuckDB query names before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the province's cities and their codes, in the platform's order
CITIES = {
    "广州": "gz", "深圳": "sz", "佛山": "fs", "东莞": "dg", "珠海": "zh", "中山": "zs", "惠州": "hui",
    "江门": "jm", "肇庆": "zq", "清远": "qy", "韶关": "sg", "汕头": "st", "汕尾": "sw", "揭阳": "jy",
    "潮州": "cz", "梅州": "mz", "河源": "hy", "阳江": "yj", "茂名": "mm", "湛江": "zj", "云浮": "yf",
}
_NAMES, _CODES = (f"'{','.join(x)}'" for x in (CITIES.keys(), CITIES.values()))


def _nth(words: str, index: str) -> str:
    return f"split_part({words}, ',', CAST({index} AS INT) + 1)"


_PLACE = "CAST(22.5 AS DOUBLE) + (p_partkey * 37 % 1000) / CAST(1000 AS DOUBLE) AS lat, CAST(113 AS DOUBLE) + (p_partkey * 53 % 997) / CAST(1000 AS DOUBLE) AS lng"

#: Name to (base tables, SELECT).
VIEWS = {
    "loan": (
        ("orders", "part"),
        """SELECT o_orderkey AS loan_id, o_custkey AS customer_id, o_orderkey * 7 % (SELECT count(*) FROM {part}) AS collateral_id,
        o_totalprice AS balance, CAST(o_orderdate AS DATE) AS origination_date FROM {orders}""",
    ),
    "collateral": (
        ("part",),
        f"""SELECT p_partkey AS collateral_id, CAST(40 + 2 * p_size AS DOUBLE) AS area,
        CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE round(p_retailprice * (200 + p_partkey % 400), 2) END AS true_market_price,
        CAST(p_partkey * 13 % 101 AS DOUBLE) AS missing_pct, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS is_high_risk_zone,
        CAST(p_partkey % 60 AS DOUBLE) AS age, {_nth(_CODES, "p_partkey % 21")} AS city, {_PLACE},
        {_nth(_NAMES, "p_partkey % 21")} || '市' || {_nth("'东城,西湖,南山,北苑,中洲'", "p_partkey % 5")} || '区花园' || CAST(p_partkey AS STRING) || '号' AS property_addr
        FROM {{part}}""",
    ),
    "borrower": (
        ("customer",),
        """SELECT c_custkey AS customer_id, CAST(550 + c_custkey % 250 AS DOUBLE) AS credit_score, (10 + c_custkey % 71) / CAST(100 AS DOUBLE) AS debt_ratio,
        CAST(4000 + c_custkey * 37 % 21000 AS DOUBLE) AS income, c_name AS name FROM {customer}""",
    ),
    "avm": (
        ("part",),
        """SELECT p_partkey AS collateral_id, round(p_retailprice * (200 + p_partkey % 400) * (60 + p_partkey % 80) / 100, 2) AS avm_value
        FROM {part} WHERE p_partkey % 3 = 0""",
    ),
    "listing": (
        ("lineitem", "part"),
        f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS url_key, l_orderkey AS etl_no, {_nth(_CODES, "l_suppkey % 21")} AS city,
        CASE WHEN l_linenumber = 1 THEN {_nth("'东城,西湖,南山,北苑,中洲'", "l_partkey % 5")} WHEN l_linenumber = 7 THEN NULL ELSE p_name END AS community,
        CAST(1 + p_size % 4 AS INT) AS bedrooms, CAST(p_size % 3 AS INT) AS halls, CAST(1 + p_size % 2 AS INT) AS bathrooms,
        l_quantity AS area, CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS unit_price, floor(l_extendedprice / 100) / CAST(100 AS DOUBLE) AS total_price,
        CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 60 AS INT) END AS age, CAST(1960 + l_partkey % 60 AS INT) AS building_year,
        CASE l_linenumber % 4 WHEN 0 THEN '低层' WHEN 1 THEN '中层' WHEN 2 THEN '高层' ELSE '' END || '(共' || CAST(6 + p_size % 30 AS STRING) || '层)' AS floor,
        {_nth("'东,南,西,北,未知'", "l_partkey % 5")} AS direction, {_PLACE},
        CAST(l_shipdate AS DATE) AS first_seen, CAST(l_shipdate AS DATE) + CAST(l_partkey % 120 AS INT) AS last_seen, l_linenumber AS line_no, l_discount AS discount, l_tax AS tax,
        l_suppkey AS agent
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    ),
    "place": (
        ("part",),
        f"""SELECT p_partkey AS place_id, {_nth(_CODES, "p_partkey % 21")} AS city, {_PLACE},
        round(p_retailprice * 10 + p_partkey % 97 * 25, 2) AS unit_price FROM {{part}}""",
    ),
    "ad": (
        ("lineitem", "part"),
        f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS ad_id, l_orderkey AS load_no, {_nth(_CODES, "l_suppkey % 21")} AS city, {_nth(_CODES, "l_suppkey * 7 % 21")} AS other_city,
        {_nth("'急售,笋盘,业主诚心,,新收,低价'", "l_orderkey % 6")} || {_nth("'万科,金色,碧桂园,华府,东城,紫麟,阳光'", "l_partkey % 7")} || {_nth("'花园,家园,三期,城,公馆,苑北区,小区,一期'", "(l_partkey + l_linenumber) % 8")}
          || {_nth("' 精装两房, 南向三房,，近地铁, 集中供暖,望京灶'", "l_suppkey % 5")} AS title,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE {_nth("'万科,金色,碧桂园,华府,东城,紫麟,阳光'", "l_partkey % 7")} || {_nth("'花园,家园北区,公馆,一期'", "l_partkey % 4")} END AS community,
        'https://' || {_nth("'www,gz,shenzhen,m,bj,foshan'", "l_orderkey % 6")} || '.anjuke.com/prop/view/A' || CAST(l_orderkey AS STRING) || 'x' || CAST(l_linenumber AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '?from=list' ELSE '' END AS url,
        CASE WHEN l_linenumber % 3 <> 0 THEN CAST(19.5 AS DOUBLE) + (l_partkey * 37 % 620) / CAST(100 AS DOUBLE) END AS lat,
        CASE WHEN l_linenumber % 3 <> 0 THEN CAST(109 AS DOUBLE) + (l_partkey * 53 % 890) / CAST(100 AS DOUBLE) END AS lng,
        CASE l_linenumber % 3 WHEN 0 THEN 'pending' ELSE 'hit' END AS geocode_status, floor(l_extendedprice / l_quantity) * 20 AS unit_price, CAST(l_shipdate AS DATE) AS seen
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    ),
    "gazette": (
        ("part",),
        f"""SELECT p_partkey AS place, {_nth(_CODES, "p_partkey % 21")} AS city, {_nth("'万科,金色,碧桂园,华府,东城,紫麟,阳光'", "p_partkey % 7")} || {_nth("'花,家园,公馆,一期,花园二区'", "p_partkey % 5")} AS community,
        {_PLACE}, CASE p_partkey % 6 WHEN 0 THEN 'miss' WHEN 1 THEN 'pending' ELSE 'hit' END AS status FROM {{part}}""",
    ),
    "image": (
        ("events",),
        """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'collateral' ELSE 'loan' END AS table_name,
        CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event_type,
        CASE WHEN event_id % 13 = 0 THEN '{{bad' WHEN event_id % 17 = 0 THEN NULL ELSE '{{"loan_id": ' || CAST(user_id AS STRING) || ', "risk_class": "old"}}' END AS before_json,
        CASE WHEN event_type = 'error' OR event_id % 19 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '[1' ELSE '{{"loan_id": ' || CAST(user_id AS STRING) || ', "balance": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id % 1000 AS STRING) || '.25' END
          || ', "collateral_id": ' || CAST(user_id * 7 AS STRING) || '}}' END AS after_json, ts AS cdc_ts, user_id FROM {events}""",
    ),
    "change": (
        ("events",),
        """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'collateral' WHEN 'click' THEN 'customer' ELSE 'loan' END AS table_name,
        CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event_type,
        CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id * 11 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS entity_id,
        ts AS cdc_ts, round(value * 4000, 2) AS balance FROM {events}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables in ``sf_dir``."""
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def oracle(names: str, body: str) -> str:
    """DuckDB text of ``body`` over the named views (separated by spaces)."""
    parts = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names.split()]
    return f"WITH {', '.join(parts)} SELECT * FROM ({body}) AS answer"
