"""Scans, parsing, normalization, stored tables."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.functions import ids, periods, text
from seriesmill.operators import normalize as N
from seriesmill.session import scratch_dir
from seriesmill.sources import scan, store


def canonical(spark, sf):
    src = T.raw_long(spark, sf)
    return N.normalize_long(src, T.STUDY, T.LONG_MAPPING, F.col("row_key"), F.col("row_no"))


def canonical_wide(spark, sf):
    return N.normalize_wide(
        T.raw_wide(spark, sf),
        T.STUDY,
        T.wide_mapping(),
        F.concat_ws("-", "tipo", "marca", "medida"),
        F.lit(0),
    )


@query(
    "normalize_long",
    S.q(
        S.canon_long(),
        "SELECT source_row_id, entity_id, series_id, ds, measure, CAST(y_raw AS DOUBLE) AS y_raw FROM cobs",
    ),
)
def _(spark, sf):
    return canonical(spark, sf).observations.select(
        "source_row_id", "entity_id", "series_id", "ds", "measure", F.col("y_raw").cast("double").alias("y_raw")
    )


@query("normalize", S.q(S.canon_long(), """
SELECT c.ds, c.measure, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
       CAST(sum(y_raw) AS DOUBLE) AS total FROM cobs c GROUP BY c.ds, c.measure"""))
def _(spark, sf):
    return canonical(spark, sf).observations.groupBy("ds", "measure").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(ids.packed(F.col("entity_id"))).alias("n_entities"),
        F.sum("y_raw").cast("double").alias("total"),
    )


# One key column, so that other dimensions of a part change between its rows.
BY_EAN = replace(T.LONG_MAPPING, key_columns=("ean",), dimension_columns={d: d for d in ("tipo", "marca", "fornecedor")})
CONFLICTS = """k AS (SELECT entity_id, row_no, tipo, marca, fornecedor FROM good),
l AS (SELECT entity_id, row_no, 'tipo' AS dimension, tipo AS value FROM k
      UNION ALL SELECT entity_id, row_no, 'marca', marca FROM k UNION ALL SELECT entity_id, row_no, 'fornecedor', fornecedor FROM k),
f AS (SELECT *, first_value(value) OVER (PARTITION BY entity_id, dimension ORDER BY row_no, value) AS first_value FROM l),
conf AS (SELECT entity_id, dimension FROM f WHERE first_value <> '' GROUP BY ALL HAVING count(DISTINCT value) > 1)"""
LANES = "".join(f"|| '-' || CAST(sum(CAST(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


def literal(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


def json_text(text_: str) -> str:
    return literal(json.dumps(text_, ensure_ascii=False))


EAN_CANON = S.canon_long().replace("tipo = '' AND marca = '' AND ean = '' AS no_key", "ean = '' AS no_key").replace(S.entity_id(S.DIMS["ean"]), S.entity_id(["ean"]))


@query("normalize_result", S.q(EAN_CANON + ",\n" + CONFLICTS, f"""
, h AS (SELECT sha256(series_id || '|' || strftime(ds, '%Y-%m-%d') || '|' || CAST(y_raw AS VARCHAR)) AS h FROM cobs),
dig AS (SELECT count(*) AS n, sha256(CAST(count(*) AS VARCHAR) {LANES}) AS digest FROM h),
ne AS (SELECT count(DISTINCT entity_id) AS e FROM good)
SELECT code, severity, count(*) AS n_rows FROM issues GROUP BY ALL
UNION ALL SELECT 'E_DIMENSION_CONFLICT', 'error', count(*) FROM conf
UNION ALL SELECT 'E_ENTITY_LIMIT', 'error', 1 UNION ALL SELECT 'E_OBS_LIMIT', 'error', 1 UNION ALL SELECT 'E_ROWS_LIMIT', 'error', 1
UNION ALL SELECT 'E_MEASURE_MISSING', 'error', 1
UNION ALL SELECT 'fingerprint', sha256('["lineitem","' || n || '","' || e || '",' || {json_text(BY_EAN.to_json())} || ',' || {json_text(T.STUDY.to_json())} || ',"' || digest || '"]'), n FROM dig, ne
""").replace(")\n, h AS", "),\nh AS"))
def _(spark, sf):
    """Every kind of issue of a source, and its fingerprint."""
    src = T.raw_long(spark, sf)
    out = N.normalize(src, T.STUDY, BY_EAN, F.col("row_key"), F.col("row_no"), "lineitem", N.Limits(10, 10, 10))
    counts = out.issues.groupBy("code", "severity").agg(F.count("*").alias("n_rows"))
    lacking = N.normalize(src.drop("valor"), T.STUDY, BY_EAN, F.col("row_key"), F.col("row_no")).issues
    lacking = lacking.groupBy("code", "severity").agg(F.count("*").alias("n_rows"))
    mark = out.observations.agg(F.lit("fingerprint").alias("code"), F.lit(out.fingerprint).alias("severity"), F.count("*").alias("n_rows"))
    return counts.unionByName(lacking).unionByName(mark)


@query("inspect_sample", S.q(S.raw_long(), """, first AS (SELECT * FROM src ORDER BY row_no LIMIT 100)
SELECT c."column", c.kind AS inferred_type, c.n_filled, n_rows, 'E_ROWS_LIMIT' AS code FROM (
  SELECT count(*) AS n_rows, [
    {'column': 'row_no', 'kind': 'integer', 'n_filled': count(*)},
    {'column': 'tipo', 'kind': 'text', 'n_filled': count_if(tipo <> '')},
    {'column': 'ean', 'kind': 'integer', 'n_filled': count_if(ean <> '')},
    {'column': 'tamanho', 'kind': 'integer', 'n_filled': count(*)},
    {'column': 'valor', 'kind': 'text', 'n_filled': count(*)}] AS cs FROM first), unnest(cs) t(c)""").replace(")\n, first", "),\nfirst"))
def _(spark, sf):
    """The first hundred rows of a source that is over its row limit."""
    path = scratch_dir(spark, "inspect_sample")
    T.raw_long(spark, sf).orderBy("row_no").write.csv(path, sep=";", header=True)
    profile, _, issues = scan.inspect_text(spark, path, max_rows=500)
    return profile.where(F.col("column").isin("row_no", "tipo", "ean", "tamanho", "valor")).drop("role").withColumn("code", F.lit(issues.first()["code"]))


@query("flag_invalid_rows", S.q(S.canon_long(), "SELECT code, severity, row_key AS source_row_id FROM issues"))
def _(spark, sf):
    return canonical(spark, sf).issues.select("code", "severity", "source_row_id")


@query(
    "build_entities",
    S.q(
        S.canon_long(),
        """SELECT entity_id, '{"tipo":"' || tipo || '","marca":"' || marca || '","ean":"' || ean || '"}' AS dimensions_json,
                  '{"tamanho":"' || tamanho || '"}' AS attributes_json
           FROM good QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY row_no, tamanho) = 1""",
    ),
)
def _(spark, sf):
    return canonical(spark, sf).entities.select("entity_id", "dimensions_json", "attributes_json")


@query(
    "dimension_conflicts",
    S.q(
        S.raw_long(),
        """, k AS (SELECT sha256('[["ean","' || ean || '"]]') AS entity_id, row_no, tipo, marca, fornecedor FROM src WHERE ean <> ''),
l AS (SELECT entity_id, row_no, 'tipo' AS dimension, tipo AS value FROM k
      UNION ALL SELECT entity_id, row_no, 'marca', marca FROM k
      UNION ALL SELECT entity_id, row_no, 'fornecedor', fornecedor FROM k),
f AS (SELECT *, first_value(value) OVER (PARTITION BY entity_id, dimension ORDER BY row_no, value) AS first_value FROM l)
SELECT entity_id, dimension, first_value, count(DISTINCT value) AS n_values, count_if(value <> first_value) AS conflict_rows,
       'E_DIMENSION_CONFLICT' AS code
FROM f WHERE first_value <> '' GROUP BY ALL HAVING count(DISTINCT value) > 1""",
    ).replace(")\n, k", "),\nk"),
)
def _(spark, sf):
    rows = T.raw_long(spark, sf).where("ean <> ''").withColumn("eid", ids.entity_id([("ean", F.col("ean"))]))
    return N.dimension_conflicts(rows, ["tipo", "marca", "fornecedor"], "eid", "row_no")


@query(
    "guard_limits",
    S.q(
        S.canon_long(),
        """SELECT code, found, allowed FROM (
             SELECT 'E_ENTITY_LIMIT' AS code, count(DISTINCT entity_id) AS found, CAST(150 AS BIGINT) AS allowed FROM cobs
             UNION ALL SELECT 'E_OBS_LIMIT', count(*), CAST(10000000000 AS BIGINT) FROM cobs) WHERE found > allowed""",
    ),
)
def _(spark, sf):
    return N.guard_limits(canonical(spark, sf).observations, 150, 10_000_000_000)


@query("content_digest", S.q(S.canon_long(), f"""
, h AS (SELECT sha256(series_id || '|' || strftime(ds, '%Y-%m-%d') || '|' || CAST(y_raw AS VARCHAR)) AS h FROM cobs)
SELECT count(*) AS n_rows, sha256(CAST(count(*) AS VARCHAR)
  {"".join(f"|| '-' || CAST(sum(CAST(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))}) AS digest
FROM h""").replace(")\n, h", "),\nh"))
def _(spark, sf):
    return N.content_digest(canonical(spark, sf).observations)


WIDE_LONG = (
    S.months("marca")
    + """,
w AS (SELECT tipo, marca, ds, unnest(['UN', ' Venda ', 'peso']) AS medida,
             unnest([unidades, valor, unidades]) AS y FROM m_marca),
ids AS (SELECT DISTINCT tipo, marca, medida FROM w WHERE ds BETWEEN DATE '1996-09-01' AND DATE '2001-08-01'),
"""
    + S.GRID.strip()
    + """,
wide AS (SELECT i.*, g.ds, w.y FROM ids i CROSS JOIN grid g
         LEFT JOIN w ON w.tipo = i.tipo AND w.marca = i.marca AND w.medida = i.medida AND w.ds = g.ds),
lab AS (SELECT *, CASE lower(trim(medida)) WHEN 'un' THEN 'unidades' WHEN 'venda' THEN 'valor' END AS measure,
          """
    + S.entity_id(["tipo", "marca"])
    + """ AS entity_id FROM wide)"""
)


@query(
    "unpivot_wide",
    S.q(WIDE_LONG, "SELECT entity_id, measure, ds, coalesce(CAST(y AS VARCHAR), '') AS raw_value FROM lab"),
)
def _(spark, sf):
    src = T.raw_wide(spark, sf).withColumns(
        {
            "entity_id": ids.entity_id([("tipo", F.col("tipo")), ("marca", F.col("marca"))]),
            "measure": text.measure_of_label(F.col("medida")),
        }
    )
    return N.unpivot_wide(src, T.wide_mapping(), ["entity_id", "measure"])


@query(
    "normalize_wide",
    S.q(
        WIDE_LONG,
        f"""SELECT entity_id, {S.SERIES_ID} AS series_id, ds, measure, CAST(y AS DOUBLE) AS y_raw
            FROM lab WHERE y IS NOT NULL AND measure IS NOT NULL""",
    ),
)
def _(spark, sf):
    return canonical_wide(spark, sf).observations.select(
        "entity_id", "series_id", "ds", "measure", F.col("y_raw").cast("double").alias("y_raw")
    )


@query(
    "measure_label",
    S.q(
        WIDE_LONG,
        """SELECT code, severity, count(*) AS n_rows, severity = 'error' AS blocking FROM (
             SELECT 'E_MEASURE_UNKNOWN' AS code, 'error' AS severity FROM ids
             WHERE lower(trim(medida)) NOT IN ('un', 'unidade', 'unidades', 'valor', 'venda', 'value', 'val')
             UNION ALL SELECT 'E_ROW_INVALID', 'warning' FROM lab WHERE measure IS NOT NULL AND y IS NULL) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return N.issue_counts(canonical_wide(spark, sf).issues)


@query(
    "autodetect_wide",
    S.q(WIDE_LONG, """SELECT ds, count(*) AS n_rows, CAST(sum(y) AS DOUBLE) AS total FROM lab
        WHERE medida = 'UN' AND y IS NOT NULL GROUP BY ds"""),
)
def _(spark, sf):
    units = T.raw_wide(spark, sf).where(F.col("medida") == T.WIDE_LABELS["unidades"])
    study, mapping = scan.autodetect_wide(units)
    out = N.normalize_wide(units, study, mapping, F.concat_ws("-", *mapping.key_columns), F.lit(0))
    return out.observations.groupBy("ds").agg(
        F.count("*").alias("n_rows"), F.sum("y_raw").cast("double").alias("total")
    )


@query(
    "infer_time_settings",
    """WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds FROM orders),
       g AS (SELECT ds, date_diff('day', lag(ds) OVER (ORDER BY ds), ds) AS gap FROM d)
       SELECT max(ds) AS history_end, count(*) AS n_periods,
              CASE WHEN min(gap) <= 31 THEN 'monthly' WHEN min(gap) <= 100 THEN 'quarterly' ELSE 'yearly' END AS frequency
       FROM g""",
)
def _(spark, sf):
    orders = T.table(spark, sf, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("ds"))
    return scan.time_settings(orders)


@query(
    "period_gaps",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders)
       SELECT ds, CAST(date_diff('day', lag(ds) OVER (ORDER BY ds), ds) AS INTEGER) AS gap_days FROM d""",
)
def _(spark, sf):
    return scan.period_gaps(T.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ds")))


@query("parse_number", S.q(S.raw_long(), f"SELECT row_key, valor, {S.number('valor')} AS y FROM src"))
def _(spark, sf):
    return T.raw_long(spark, sf).select("row_key", "valor", text.parse_number(F.col("valor")).alias("y"))


@query("parse_period", S.q(S.raw_long(), f"SELECT periodo, {S.PERIOD} AS ds, count(*) AS n FROM src GROUP BY ALL"))
def _(spark, sf):
    src = T.raw_long(spark, sf).groupBy("periodo").agg(F.count("*").alias("n"))
    return src.select("periodo", periods.parse_period(F.col("periodo")).alias("ds"), "n")


HEADER_SQL = """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders),
h AS (
  SELECT CASE WHEN p = '1-URGENT' AND s = 'F' THEN strftime(d, '%Y-%m-%d 00:00:00')
              WHEN p = '1-URGENT' THEN strftime(d, '%Y%m') || '.0'
              WHEN p = '2-HIGH' THEN strftime(d, '%m/%Y')
              WHEN p = '3-MEDIUM' AND s = 'F' THEN strftime(d, '%Y/%m')
              WHEN p = '3-MEDIUM' THEN year(d) || '-Q' || quarter(d)
              WHEN p = '4-NOT SPECIFIED' AND s = 'F' THEN strftime(d, '%Y')
              WHEN p = '4-NOT SPECIFIED' THEN 'MAT-' || strftime(d, '%Y-%m')
              WHEN s = 'F' THEN 'Mês ' || (1 + (2001 - year(d)) * 12 + 8 - month(d))
              ELSE 'total ' || year(d) END AS header,
         CASE WHEN p = '3-MEDIUM' AND s <> 'F' THEN CAST(date_trunc('quarter', d) AS DATE)
              WHEN p = '4-NOT SPECIFIED' AND s = 'F' THEN CAST(date_trunc('year', d) AS DATE)
              WHEN p = '5-LOW' AND s <> 'F' THEN NULL
              ELSE CAST(date_trunc('month', d) AS DATE) END AS ds
  FROM d)
SELECT header, ds, count(*) AS n FROM h GROUP BY ALL"""


@query("parse_period_header", HEADER_SQL)
def _(spark, sf):
    d, p, s = F.col("d"), F.col("o_orderpriority"), F.col("o_orderstatus")
    orders = T.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    back = (2001 - F.year(d)) * 12 + 9 - F.month(d)
    header = (
        F.when((p == "1-URGENT") & (s == "F"), F.date_format(d, "yyyy-MM-dd 00:00:00"))
        .when(p == "1-URGENT", F.concat(F.date_format(d, "yyyyMM"), F.lit(".0")))
        .when(p == "2-HIGH", F.date_format(d, "MM/yyyy"))
        .when((p == "3-MEDIUM") & (s == "F"), F.date_format(d, "yyyy/MM"))
        .when(p == "3-MEDIUM", F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")))
        .when((p == "4-NOT SPECIFIED") & (s == "F"), F.date_format(d, "yyyy"))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("MAT-"), F.date_format(d, "yyyy-MM")))
        .when(s == "F", F.concat(F.lit("Mês "), back.cast("string")))
        .otherwise(F.concat(F.lit("total "), F.year(d).cast("string")))
    )
    counted = orders.select(header.alias("header")).groupBy("header").agg(F.count("*").alias("n"))
    parsed = periods.parse_period_header(F.col("header"), T.HISTORY_END)
    return counted.select("header", parsed.alias("ds"), "n")


@query(
    "assign_source_row_id",
    """SELECT 'r' || o_orderkey AS source_row_id, o_totalprice AS price FROM orders""",
)
def _(spark, sf):
    orders = T.table(spark, sf, "orders")
    out = scan.assign_source_row_id(orders, F.col("o_orderkey"))
    return out.select(
        "source_row_id", F.get_json_object("raw_json", "$.o_totalprice").cast("double").alias("price")
    )


@query("number_source_rows", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS first_row, count(*) + 1 AS last_row FROM lineitem")
def _(spark, sf):
    rows = scan.assign_source_row_id(T.table(spark, sf, "lineitem"))
    return rows.agg(
        F.countDistinct("source_row_id").alias("n"),
        F.min("row_number").alias("first_row"),
        F.max("row_number").alias("last_row"),
    )


@query(
    "inspect_source",
    S.q(
        S.raw_long(),
        """SELECT c."column", c.role, c.kind AS inferred_type, c.n_filled, n_rows FROM (
             SELECT count(*) AS n_rows, [
               {'column': 'row_key', 'role': 'dimension', 'kind': 'text', 'n_filled': count(*)},
               {'column': 'row_no', 'role': 'dimension', 'kind': 'integer', 'n_filled': count(*)},
               {'column': 'tipo', 'role': 'dimension', 'kind': 'text', 'n_filled': count_if(tipo <> '')},
               {'column': 'marca', 'role': 'dimension', 'kind': 'text', 'n_filled': count_if(marca <> '')},
               {'column': 'ean', 'role': 'dimension', 'kind': 'integer', 'n_filled': count_if(ean <> '')},
               {'column': 'tamanho', 'role': 'dimension', 'kind': 'integer', 'n_filled': count(*)},
               {'column': 'periodo', 'role': 'period', 'kind': 'text', 'n_filled': count(*)},
               {'column': 'unidades', 'role': 'measure', 'kind': 'text', 'n_filled': count(*)},
               {'column': 'valor', 'role': 'measure', 'kind': 'text', 'n_filled': count(*)},
               {'column': 'fornecedor', 'role': 'dimension', 'kind': 'integer', 'n_filled': count(*)}] AS cs
             FROM src), unnest(cs) t(c)""",
    ),
)
def _(spark, sf):
    return scan.inspect_source(T.raw_long(spark, sf))


@query("scan_text_table", S.q(S.raw_long(), "SELECT tipo, count(*) AS n_rows, count(DISTINCT ean) AS n_ean, min(ean) AS first_ean, count_if(valor = 'n/a') AS n_blank FROM src GROUP BY tipo"))
def _(spark, sf):
    path = scratch_dir(spark, "scan_text_table")
    T.raw_long(spark, sf).write.mode("overwrite").csv(path, sep=";", header=True)
    back = scan.scan_text_table(spark, path)
    return back.groupBy("tipo").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("ean").alias("n_ean"),
        F.min("ean").alias("first_ean"),
        F.count_if(F.col("valor") == "n/a").alias("n_blank"),
    )


@query("sniff_delimiter", "SELECT ',' AS delimiter")
def _(spark, sf):
    path = scratch_dir(spark, "sniff_delimiter")
    T.table(spark, sf, "orders").write.mode("overwrite").csv(path, sep=",", header=True)
    return scan.sniff_delimiter(spark, path)


@query("save_load_canonical", S.q(S.canon_long(), """
SELECT 'observations' AS name, count(*) AS n_rows, round(CAST(sum(y_raw) AS DOUBLE), 2) AS total, count(DISTINCT series_id) AS n_keys FROM cobs
UNION ALL SELECT 'entities', count(*), CAST(sum(length(ean)) AS DOUBLE), count(*) FROM (SELECT DISTINCT ean FROM good)
UNION ALL SELECT 'source_rows', count(*), CAST(sum(row_no) AS DOUBLE), count(DISTINCT row_key) FROM src"""))
def _(spark, sf):
    """Saved twice; loaded once, with the values that went in."""
    root = scratch_dir(spark, "canonical")
    data = N.normalize(T.raw_long(spark, sf), T.STUDY, T.LONG_MAPPING, F.col("row_key"), F.col("row_no"))
    store.save_canonical(data, root, "lineitem")
    store.save_canonical(data, root, "lineitem")
    figures = {
        "observations": (F.round(F.sum("y_raw").cast("double"), 2), "series_id"),
        "entities": (F.sum(F.length(F.get_json_object("dimensions_json", "$.ean"))).cast("double"), "entity_id"),
        "source_rows": (F.sum(F.get_json_object("raw_json", "$.row_no").cast("long")).cast("double"), "source_row_id"),
    }
    out = None
    for name, df in store.load_canonical(spark, root, "lineitem").items():
        total, key = figures[name]
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), total.alias("total"), F.count_distinct(key).alias("n_keys"))
        out = part if out is None else out.unionByName(part)
    return out


@query("upsert_results", S.q(S.obs("marca"), """
, stored AS (SELECT series_id, ds, CAST(y_raw AS DOUBLE) AS yhat, 'old' AS origin FROM obs WHERE ds <= DATE '2000-12-01'),
batch AS (SELECT series_id, ds, CAST(y_raw AS DOUBLE) * 2 AS yhat, 'new' AS origin FROM obs WHERE ds >= DATE '2000-06-01')
SELECT * FROM batch UNION ALL
SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.series_id = s.series_id AND b.ds = s.ds)""").replace(")\n, stored", "),\nstored"))
def _(spark, sf):
    obs = T.observations(spark, sf, "marca").select("series_id", "ds", F.col("y_raw").cast("double").alias("yhat"))
    stored = obs.where(F.col("ds") <= F.lit(date(2000, 12, 1))).withColumn("origin", F.lit("old"))
    fresh = obs.where(F.col("ds") >= F.lit(date(2000, 6, 1)))
    repeated = fresh.withColumns({"seq": F.lit(1), "origin": F.lit("stale")}).unionByName(
        fresh.withColumns({"yhat": F.col("yhat") * 2, "seq": F.lit(2), "origin": F.lit("new")})
    )
    return store.upsert(stored, repeated, ["series_id", "ds"], "seq")


@query("upsert_nodes", """
WITH stored AS (SELECT 'run' AS run_id, CAST(c_custkey AS VARCHAR) AS node_id, c_mktsegment AS level, '{"old":1}' AS dimensions_json FROM customer),
batch AS (SELECT 'run' AS run_id, CAST(o_custkey AS VARCHAR) AS node_id, 'folha' AS level, '{}' AS dimensions_json
          FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000)
SELECT * FROM batch UNION ALL
SELECT * FROM stored WHERE node_id NOT IN (SELECT node_id FROM batch)""")
def _(spark, sf):
    stored = T.table(spark, sf, "customer").select(
        F.lit("run").alias("run_id"),
        F.col("c_custkey").cast("string").alias("node_id"),
        F.col("c_mktsegment").alias("level"),
        F.lit('{"old":1}').alias("dimensions_json"),
    )
    big = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).where("m > 400000")
    batch = big.select(
        F.lit("run").alias("run_id"),
        F.col("o_custkey").cast("string").alias("node_id"),
        F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("string").alias("dimensions_json"),
    )
    return store.upsert_nodes(stored, batch)


@query("save_assumptions", """
SELECT CAST(o_custkey AS VARCHAR) AS draft_id, strftime(max(o_orderdate), '%Y-%m-%d') AS updated_at,
       arg_max(CAST(o_orderkey AS VARCHAR), (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS payload FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    """Two writers and a compaction between them; the newest draft of each id is read."""
    path = scratch_dir(spark, "drafts")
    orders = T.table(spark, sf, "orders").select(
        F.lit("d").alias("dataset_id"),
        F.lit("scenario").alias("kind"),
        F.col("o_custkey").cast("string").alias("draft_id"),
        F.col("o_orderkey").cast("string").alias("payload"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
    )
    late = F.col("updated_at") >= "1998-01-01"
    store.save_assumptions(orders.where(late), path)
    store.compact_assumptions(spark, path)
    store.save_assumptions(orders.where(~late), path)
    store.save_assumptions(orders.where(late), path)
    store.compact_assumptions(spark, path)
    return store.saved_assumptions(spark, path, "d").select("draft_id", "updated_at", "payload")


@query("save_load_assumptions", """
SELECT CAST(o_custkey AS VARCHAR) AS draft_id, CAST(max(o_orderdate) AS DATE) AS updated_at,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS payload FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    drafts = T.table(spark, sf, "orders").select(
        F.lit("d").alias("dataset_id"),
        F.lit("scenario").alias("kind"),
        F.col("o_custkey").cast("string").alias("draft_id"),
        F.col("o_orderdate").cast("date").alias("updated_at"),
        F.col("o_orderkey").alias("payload"),
    )
    return store.load_assumptions(drafts).select("draft_id", "updated_at", "payload")


def _runs(spark, sf):
    """Runs derived from the tables: one per customer, its orders stand for the forecasts."""
    orders = T.table(spark, sf, "orders")
    runs = orders.groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("started_at"),
        F.max("o_orderstatus").alias("st"),
        F.count("*").alias("n"),
    )
    customers = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    runs = runs.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.col("c_nationkey").cast("string").alias("dataset_id"),
        F.when(F.col("st") == "P", "partial").when(F.col("st") == "O", "completed").otherwise("failed").alias("status"),
        "started_at",
        F.to_json(F.struct(F.col("n").alias("horizon_periods"))).alias("config_json"),
    )
    datasets = T.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("dataset_id"),
        F.col("n_name").alias("filename"),
        F.col("n_regionkey").alias("created_at"),
    )
    items = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    keyed = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("run_id"), "o_orderpriority")
    nodes = keyed.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "run_id", F.col("l_partkey").alias("node_id")
    ).distinct().withColumn("level", F.when(F.col("node_id") % 2 == 0, "folha").otherwise("tipo"))
    forecasts = keyed.select("run_id", F.col("o_orderpriority").alias("model_alias"))
    return runs, datasets, nodes, forecasts


RUNS = """
WITH runs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(c_nationkey AS VARCHAR) AS dataset_id,
         CASE max(o_orderstatus) WHEN 'P' THEN 'partial' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status,
         CAST(min(o_orderdate) AS DATE) AS started_at, count(*) AS horizon
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey)"""


@query("run_catalog", RUNS + """,
n AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(DISTINCT CASE WHEN l_partkey % 2 = 0 THEN l_partkey END) AS n_series
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
m AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS models FROM orders GROUP BY 1)
SELECT runs.run_id, dataset_id, n_name AS filename, status, started_at, coalesce(n_series, 0) AS n_series, horizon, models
FROM runs LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = dataset_id LEFT JOIN n USING (run_id) LEFT JOIN m USING (run_id)
WHERE status <> 'failed'""")
def _(spark, sf):
    return store.run_catalog(*_runs(spark, sf))


@query("list_runs", RUNS + " SELECT run_id, dataset_id, status, started_at FROM runs")
def _(spark, sf):
    return store.list_runs(_runs(spark, sf)[0]).drop("config_json")


@query("list_datasets", "SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_name AS filename, n_regionkey AS created_at FROM nation")
def _(spark, sf):
    return store.list_datasets(_runs(spark, sf)[1])


@query("run_dataset", RUNS + """ SELECT run_id, status, n_name AS filename,
row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, run_id) AS position
FROM runs JOIN nation ON CAST(n_nationkey AS VARCHAR) = dataset_id""")
def _(spark, sf):
    runs, datasets, _, _ = _runs(spark, sf)
    return store.rank_newest(runs).join(datasets, "dataset_id").select("run_id", "status", "filename", "position")


@query("stable_id", """SELECT o_orderkey, sha256('["' || o_orderkey || '","' || o_orderpriority || '"]') AS id FROM orders""")
def _(spark, sf):
    return T.table(spark, sf, "orders").select(
        "o_orderkey", ids.series_id(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("id")
    )


@query("period_label", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS monthly,
 year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarterly, strftime(o_orderdate, '%Y') AS yearly,
 CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS next_quarter FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return T.table(spark, sf, "orders").select(
        "o_orderkey",
        *[periods.period_label(d, f).alias(f) for f in ("monthly", "quarterly", "yearly")],
        periods.add_periods(periods.period_floor(d, "monthly"), 1, 3).alias("next_quarter"),
    )


@query("filter_text", """SELECT c_custkey, 'pais=' || c_nationkey || '; segmento=' || c_mktsegment || ',OUTRO' AS text,
 CAST(2 AS INTEGER) AS n_dims, c_mktsegment AS first_value FROM customer""")
def _(spark, sf):
    raw = F.concat(F.lit("segmento="), F.col("c_mktsegment"), F.lit(", OUTRO; pais="), F.col("c_nationkey").cast("string"))
    parsed = T.table(spark, sf, "customer").select("c_custkey", text.filters_from_text(raw).alias("f"))
    return parsed.select(
        "c_custkey",
        text.filters_to_text(F.col("f")).alias("text"),
        F.size("f").alias("n_dims"),
        F.col("f")["segmento"][0].alias("first_value"),
    )


@query("protect_formulas", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' || lang WHEN doc_id % 4 = 1 THEN '-' || lang ELSE lang END AS cell FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(cell, '^[=+\-@]') THEN '''' || cell ELSE cell END AS cell,
       regexp_matches(cell, '^[=+\-@]') AS was_protected FROM t""")
def _(spark, sf):
    k = F.col("doc_id") % 4
    cell = F.when(k == 0, F.concat(F.lit("="), "lang")).when(k == 1, F.concat(F.lit("-"), "lang")).otherwise(F.col("lang"))
    docs = T.table(spark, sf, "documents").select("doc_id", cell.alias("cell"))
    return docs.select(
        "doc_id",
        text.protect_formula(F.col("cell")).alias("cell"),
        text.is_formula(F.col("cell")).alias("was_protected"),
    )


@query("study_name", r"""SELECT page_id, CASE WHEN length(s) <= 120 AND s <> '' THEN s END AS name
FROM (SELECT page_id, trim(regexp_replace(url || '   ' || page_id, '\s+', ' ', 'g')) AS s FROM pages)""")
def _(spark, sf):
    raw = F.concat(F.col("url"), F.lit("   "), F.col("page_id").cast("string"))
    return T.table(spark, sf, "pages").select("page_id", text.clean_study_name(raw).alias("name"))
