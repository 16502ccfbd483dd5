"""Shared CTE text for the DuckDB side; each entry names the CTEs it needs before it."""

from __future__ import annotations

DIMS = {"tipo": ["tipo"], "marca": ["tipo", "marca"], "ean": ["tipo", "marca", "ean"]}


def json_pairs(dims: list[str]) -> str:
    inner = " || ',' || ".join(f"""'["{d}","' || {d} || '"]'""" for d in dims)
    return f"'[' || {inner} || ']'"


def entity_id(dims: list[str]) -> str:
    return f"sha256({json_pairs(dims)})"


SERIES_ID = """sha256('["' || entity_id || '","' || measure || '"]')"""


def node_id(level: int, dims: list[str]) -> str:
    inner = "".join(f""" || ',"' || {d} || '"'""" for d in dims)
    return f"""sha256('["h",{level}'{inner} || ']')"""


def months(grain: str = "ean") -> str:
    """CTE m_<grain>: monthly sales with exact decimal sums."""
    dims = DIMS[grain]
    return f"""
m_{grain} AS (
  SELECT {", ".join(_dim(d) + " AS " + d for d in dims)},
         CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS unidades,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS valor
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY ALL)"""


def _dim(d: str) -> str:
    return {"tipo": "p_type", "marca": "p_brand", "ean": "lpad(CAST(p_partkey AS VARCHAR), 13, '0')"}[d]


def obs(grain: str = "ean") -> str:
    """CTEs up to obs: canonical observations with the dimension columns kept."""
    dims = DIMS[grain]
    cols = ", ".join(dims)
    return (
        months(grain)
        + f""",
o1 AS (
  SELECT {cols}, ds, 'unidades' AS measure, unidades AS y_raw FROM m_{grain}
  UNION ALL
  SELECT {cols}, ds, 'valor' AS measure, valor AS y_raw FROM m_{grain}),
o2 AS (SELECT *, {entity_id(dims)} AS entity_id FROM o1),
obs AS (SELECT *, {SERIES_ID} AS series_id FROM o2)"""
    )


GRID = """
grid AS (
  SELECT CAST(g AS DATE) AS ds
  FROM generate_series(TIMESTAMP '1996-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) t(g))"""


def prep(grain: str = "ean", fill: str = "zero") -> str:
    """CTEs up to prep: dense grid from the first date of each series, gaps filled."""
    value = {
        "zero": "coalesce(y, 0.0)",
        "ffill": "last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds)",
    }[fill]
    reason = {"zero": "zero_preenchido", "ffill": "ffill"}[fill]
    return (
        obs(grain)
        + ","
        + GRID
        + f""",
bounds AS (SELECT series_id, entity_id, measure, min(ds) AS min_ds FROM obs GROUP BY ALL),
dense AS (
  SELECT b.series_id, b.entity_id, b.measure, g.ds, CAST(o.y_raw AS DOUBLE) AS y
  FROM bounds b JOIN grid g ON g.ds >= b.min_ds
  LEFT JOIN obs o ON o.series_id = b.series_id AND o.ds = g.ds),
prep0 AS (
  SELECT series_id, entity_id, measure, ds, {value} AS y, y IS NOT NULL AS observed,
         y IS NULL AS was_adjusted, CASE WHEN y IS NULL THEN '{reason}' ELSE '' END AS adjustment_reason
  FROM dense),
prep AS (SELECT * FROM prep0 WHERE y IS NOT NULL)"""
    )


def raw_long() -> str:
    """CTE src: every lineitem row as messy text, as the Spark side builds it."""
    return """
src AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
         l_orderkey * 8 + l_linenumber AS row_no,
         CASE WHEN nk THEN '' ELSE p_type END AS tipo,
         CASE WHEN nk THEN '' ELSE p_brand END AS marca,
         CASE WHEN nk THEN '' ELSE lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS ean,
         CAST(p_size AS VARCHAR) AS tamanho,
         CASE WHEN l_tax = 0.07 AND l_discount = 0.09 THEN '2026-13'
              WHEN l_returnflag = 'A' THEN strftime(l_shipdate, '%Y%m')
              WHEN l_linestatus = 'O' THEN year(l_shipdate) || '-Q' || quarter(l_shipdate)
              ELSE strftime(l_shipdate, '%Y-%m') END AS periodo,
         CASE WHEN l_tax = 0.01 AND l_discount = 0.05 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5'
              ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS unidades,
         CASE WHEN l_tax = 0.02 AND l_discount = 0.04 THEN 'n/a'
              WHEN l_tax = 0.02 AND l_discount = 0.03 THEN '--'
              WHEN l_tax = 0.02 AND l_discount = 0.02 THEN 'sem valor'
              ELSE 'R$ ' || translate(format('{:,.2f}', l_extendedprice), ',.', '.,') END AS valor,
         CAST(l_suppkey AS VARCHAR) AS fornecedor
  FROM (SELECT *, l_tax = 0.08 AND l_discount = 0.1 AS nk FROM lineitem JOIN part ON l_partkey = p_partkey))"""


PERIOD = """CASE WHEN regexp_full_match(periodo, '\\d{4}-\\d{1,2}') THEN TRY_CAST(periodo || '-01' AS DATE)
       WHEN regexp_full_match(periodo, '\\d{6}') THEN TRY_CAST(substr(periodo,1,4) || '-' || substr(periodo,5,2) || '-01' AS DATE)
       WHEN regexp_full_match(periodo, '\\d{4}-?Q[1-4]') THEN make_date(CAST(substr(periodo,1,4) AS INT), CAST(right(periodo,1) AS INT)*3-2, 1)
       WHEN regexp_full_match(periodo, '\\d{4}') THEN make_date(CAST(periodo AS INT), 1, 1) END"""


def number(col: str) -> str:
    return f"""CASE WHEN {col} IN ('', '-', '--', 'n/a', 'N/A') THEN NULL
       ELSE TRY_CAST(CASE WHEN contains({col}, '.') AND contains({col}, ',')
            THEN replace(replace(replace(replace({col}, 'R$', ''), ' ', ''), '.', ''), ',', '.')
            ELSE replace(replace(replace({col}, 'R$', ''), ' ', ''), ',', '.') END AS DOUBLE) END"""


def canon_long() -> str:
    """CTEs up to cobs / issues of the long normalization."""
    return (
        raw_long()
        + f""",
ann AS (
  SELECT *, {PERIOD} AS ds, tipo = '' AND marca = '' AND ean = '' AS no_key, {entity_id(DIMS["ean"])} AS entity_id
  FROM src),
good AS (SELECT * FROM ann WHERE NOT no_key AND ds IS NOT NULL),
cell AS (
  SELECT row_key, row_no, entity_id, ds, 'unidades' AS measure, {number("unidades")} AS y FROM good
  UNION ALL
  SELECT row_key, row_no, entity_id, ds, 'valor' AS measure, {number("valor")} AS y FROM good),
issues AS (
  SELECT 'E_KEY_EMPTY' AS code, 'error' AS severity, row_key FROM ann WHERE no_key
  UNION ALL SELECT 'E_DATE_AMBIGUOUS', 'error', row_key FROM ann WHERE NOT no_key AND ds IS NULL
  UNION ALL SELECT 'E_ROW_INVALID', 'warning', row_key FROM cell WHERE y IS NULL
  UNION ALL SELECT 'E_UNITS_FRACTION', 'error', row_key FROM cell WHERE measure = 'unidades' AND y <> floor(y)),
cobs AS (
  SELECT row_key AS source_row_id, row_no, entity_id, {SERIES_ID} AS series_id, ds, measure,
         CAST(y AS DECIMAL(20,2)) AS y_raw
  FROM cell WHERE y IS NOT NULL AND NOT (measure = 'unidades' AND y <> floor(y)))"""
    )


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
