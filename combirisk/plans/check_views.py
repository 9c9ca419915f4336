"""The views of :mod:`combirisk.plans.views` written once more, in plain SQL.

The text is the common prefix of every check query.
"""

from __future__ import annotations

from combirisk.functions.rules import PHENOTYPES
from combirisk.plans.view_words import (
    COLOURS,
    EFFECTS,
    FIRST_LETTERS,
    GENERICS,
    GROUP_LETTERS,
    KINDS,
    SHAPES,
    TEMPLATES,
)


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def any_contains(column: str, keywords) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(k)})" for k in keywords) + ")"


def phenotype_list(column: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {any_contains(f'lower({column})', kws)} THEN {lit(name)} END" for name, kws in PHENOTYPES.items()
    )
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


# Levels written out in the check queries.
DEPTH = 8
SOURCES = 100
FIRST_SQL = f"SELECT item FROM nodes ORDER BY item LIMIT {SOURCES}"
EVERY_SQL = "SELECT item FROM nodes"


def walk_sql(sources: str, prefix: str = "", counted: bool = True) -> str:
    """Breadth-first levels l0..l8 and everything seen s0..s8, written out."""
    p = prefix
    parts = [f"{p}g AS MATERIALIZED (SELECT item, other FROM sym), {p}l0 AS MATERIALIZED (SELECT item AS source, item AS node, 1.0::DOUBLE AS sigma FROM ({sources})), {p}s0 AS MATERIALIZED (SELECT source, node, 0 AS dist FROM {p}l0)"]
    for d in range(1, DEPTH + 1):
        total = "sum(sigma)" if counted else "1.0::DOUBLE"
        parts.append(
            f"{p}l{d} AS MATERIALIZED (SELECT l.source, g.other AS node, {total} AS sigma FROM {p}l{d - 1} l JOIN {p}g g ON l.node = g.item ANTI JOIN {p}s{d - 1} s ON l.source = s.source AND g.other = s.node GROUP BY 1, 2), "
            f"{p}s{d} AS MATERIALIZED (SELECT * FROM {p}s{d - 1} UNION ALL SELECT source, node, {d} FROM {p}l{d})"
        )
    return ", ".join(parts)


def between_sql(sources: str, prefix: str = "") -> str:
    """Dependency sums over the sources, divided by the largest, as ``btw(item, betweenness)``."""
    p = prefix
    parts = [walk_sql(sources, p), f"{p}d{DEPTH} AS MATERIALIZED (SELECT source, node, 0.0::DOUBLE AS delta FROM {p}l{DEPTH})"]
    for d in range(DEPTH - 1, 0, -1):
        parts.append(
            f"{p}d{d} AS MATERIALIZED (SELECT p.source, p.node, coalesce(sum(p.sigma / c.sigma * (1 + x.delta)), 0) AS delta FROM {p}l{d} p LEFT JOIN ({p}l{d + 1} c JOIN {p}d{d + 1} x ON c.source = x.source AND c.node = x.node JOIN {p}g g ON c.node = g.item) ON p.source = c.source AND p.node = g.other GROUP BY 1, 2)"
        )
    union = " UNION ALL ".join(f"SELECT node, delta FROM {p}d{d}" for d in range(1, DEPTH + 1))
    parts.append(f"{p}bt AS (SELECT node AS item, sum(delta) AS b FROM ({union}) GROUP BY 1), {p}btw AS MATERIALIZED (SELECT n.item, coalesce(b, 0) / (SELECT max(b) FROM {p}bt) AS betweenness FROM nodes n LEFT JOIN {p}bt USING (item))")
    return ", ".join(parts)


_VIEWS = f"""
part_keys AS (
  SELECT p_partkey, p_type,
         list_position({sql_list(COLOURS)}, split_part(p_name, ' ', 1)) - 1 AS w1,
         list_position({sql_list(SHAPES)}, split_part(p_name, ' ', 2)) - 1 AS w2,
         CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand
  FROM part),
named_parts AS (
  SELECT p_partkey, p_type, w1, w2, brand, w1 * 8 + w2 AS g,
         {sql_list(GENERICS)}[w1 * 8 + w2 + 1] AS generic,
         {sql_list(GENERICS)}[w1 * 8 + w2 + 1] || ' b' || lpad(CAST(brand AS VARCHAR), 2, '0') AS item,
         'DB' || lpad(CAST(w1 * 8 + w2 + 64 * (brand - 1) + 1 AS VARCHAR), 5, '0') AS drug_id
  FROM part_keys),
item_base AS (
  SELECT item, drug_id, generic, w1, w2, g, brand, max(p_type) AS kind
  FROM named_parts GROUP BY ALL),
item_codes AS (
  SELECT *,
    {sql_list(FIRST_LETTERS)}[(brand - 1) // 5 + 1] || lpad(CAST((brand - 1) % 5 + 1 AS VARCHAR), 2, '0')
      || {sql_list(GROUP_LETTERS)}[w1 // 2 + 1] || {sql_list(GROUP_LETTERS)}[w2 // 2 + 1]
      || lpad(CAST(g + 1 AS VARCHAR), 2, '0') AS code1,
    'V' || lpad(CAST(list_position({sql_list(KINDS)}, kind) AS VARCHAR), 2, '0') || 'A'
      || {sql_list(GROUP_LETTERS)}[w2 // 2 + 1] || lpad(CAST(brand AS VARCHAR), 2, '0') AS code2
  FROM item_base),
items AS (
  SELECT item, drug_id, generic, g, brand, kind,
    CASE WHEN brand = 25 THEN '[]'
         WHEN brand BETWEEN 6 AND 15 THEN '[''' || code1 || ''', ''' || code2 || ''']'
         ELSE '[''' || code1 || ''']' END AS atc,
    CASE WHEN brand = 25 THEN CAST([] AS VARCHAR[])
         WHEN brand BETWEEN 6 AND 15 THEN [code1, code2] ELSE [code1] END AS codes,
    brand BETWEEN 11 AND 15 AS is_cardiovascular,
    brand = 6 AS is_antithrombotic
  FROM item_codes),
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, item, drug_id,
         CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS INTEGER) AS disc,
         l_returnflag AS rf, year(l_shipdate) AS yr, month(l_shipdate) AS mon
  FROM lineitem JOIN named_parts ON l_partkey = p_partkey),
pair_rows AS (
  SELECT a.item AS ia, b.item AS ib, a.drug_id AS ida, b.drug_id AS idb,
    CASE WHEN a.rf = 'R' AND b.rf = 'R' THEN 4 WHEN a.rf = 'R' OR b.rf = 'R' THEN 3
         WHEN a.rf = 'N' OR b.rf = 'N' THEN 2 ELSE 1 END AS num,
    CAST((a.l_partkey + b.l_partkey + a.l_suppkey + b.l_suppkey) % {len(TEMPLATES)} AS INTEGER) AS slot,
    (40 + 2 * (a.disc + b.disc) + (a.l_partkey + b.l_partkey) % 16) / 100.0::DOUBLE AS conf
  FROM lines a
  JOIN (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key FROM orders) ON a.l_orderkey = o_orderkey
  JOIN lines b ON b.l_orderkey = next_key AND a.l_linenumber = b.l_linenumber
  WHERE a.item <> b.item),
directed AS (
  SELECT ia AS i1, ib AS i2, ida AS id1, idb AS id2, num, slot, conf FROM pair_rows
  UNION ALL SELECT ib, ia, idb, ida, num, slot, conf FROM pair_rows),
interactions AS (
  SELECT id1 AS drugbank_id_1, id2 AS drugbank_id_2, i1 AS drug_name_1, i2 AS drug_name_2,
    x.atc AS atc_1, y.atc AS atc_2,
    x.is_cardiovascular AS is_cardiovascular_1, y.is_cardiovascular AS is_cardiovascular_2,
    x.is_antithrombotic AS is_antithrombotic_1, y.is_antithrombotic AS is_antithrombotic_2,
    replace(replace({sql_list(TEMPLATES)}[slot + 1], '{{1}}', i1), '{{2}}', i2) AS interaction_description,
    CASE WHEN slot >= 18 THEN NULL WHEN num = 4 THEN 'Contraindicated interaction'
         WHEN num = 3 THEN 'Major interaction' WHEN num = 2 THEN 'Moderate interaction'
         ELSE 'Minor interaction' END AS severity_label,
    conf AS severity_confidence,
    CASE WHEN slot >= 18 THEN NULL ELSE num END AS severity_numeric
  FROM directed JOIN items x ON i1 = x.item JOIN items y ON i2 = y.item),
edges AS (
  SELECT a, b, n AS numeric,
    CASE n WHEN 4 THEN 'Contraindicated interaction' WHEN 3 THEN 'Major interaction'
           WHEN 2 THEN 'Moderate interaction' ELSE 'Minor interaction' END AS label,
    CASE n WHEN 4 THEN 10.0::DOUBLE WHEN 3 THEN 7.0 WHEN 2 THEN 4.0 ELSE 1.0 END AS weight,
    d AS description, c AS confidence, n_rows
  FROM (SELECT least(drug_name_1, drug_name_2) AS a, greatest(drug_name_1, drug_name_2) AS b,
          coalesce(severity_numeric, 2) AS n, coalesce(interaction_description, '') AS d,
          severity_confidence AS c,
          count(*) OVER (PARTITION BY least(drug_name_1, drug_name_2), greatest(drug_name_1, drug_name_2)) AS n_rows,
          row_number() OVER (PARTITION BY least(drug_name_1, drug_name_2), greatest(drug_name_1, drug_name_2)
            ORDER BY coalesce(severity_numeric, 2) DESC, coalesce(interaction_description, ''), severity_confidence) AS rn
        FROM interactions)
  WHERE rn = 1),
tagged_edges AS (SELECT *, {phenotype_list('description')} AS phenotypes FROM edges),
sym AS (SELECT a AS item, b AS other, numeric, label, weight, description, confidence FROM edges
        UNION ALL SELECT b, a, numeric, label, weight, description, confidence FROM edges),
nodes AS (SELECT DISTINCT item FROM sym),
{between_sql(FIRST_SQL, "bw_")},
metrics AS MATERIALIZED (
  SELECT item, degree, wsum, c4, c3, c2, c1,
    degree / (n - 1)::DOUBLE AS degree_centrality,
    wsum / max(wsum) OVER () AS weighted_degree,
    betweenness,
    least(1.0, (10 * c4 + 7 * c3 + 4 * c2 + c1) / (10.0 * greatest(1, c4 + c3 + c2 + c1))) AS severity_profile
  FROM (SELECT item, count(*) AS degree, sum(weight) AS wsum,
          count(*) FILTER (numeric = 4) AS c4, count(*) FILTER (numeric = 3) AS c3,
          count(*) FILTER (numeric = 2) AS c2, count(*) FILTER (numeric = 1) AS c1,
          count(*) OVER () AS n
        FROM sym GROUP BY item) JOIN bw_btw USING (item)),
pri AS MATERIALIZED (
  SELECT *, 0.25::DOUBLE * degree_centrality + 0.30::DOUBLE * weighted_degree + 0.20::DOUBLE * betweenness
            + 0.25::DOUBLE * severity_profile AS pri FROM metrics),
share_pri AS (
  SELECT item, degree, wshare, severe, pri,
    CASE WHEN pri > 0.5 THEN 'High Risk' WHEN pri >= 0.3 THEN 'Medium Risk' ELSE 'Lower Risk' END AS risk_level
  FROM (SELECT item, degree, ws / 100.0::DOUBLE AS wshare, severe,
          round(0.25 * degree / (max(degree) OVER ())::DOUBLE + 0.30 * ws / (max(ws) OVER ())::DOUBLE
                + 0.20 * degree / (max(degree) OVER ())::DOUBLE + 0.25 * severe / degree::DOUBLE, 3) AS pri
        FROM (SELECT item, count(*) AS degree, count(*) FILTER (numeric >= 3) AS severe,
                CAST(sum(CASE numeric WHEN 4 THEN 100 WHEN 3 THEN 70 WHEN 2 THEN 40 ELSE 15 END) AS BIGINT) AS ws
              FROM sym GROUP BY item))),
regimens AS (SELECT l_orderkey AS regimen_id, item, min(l_linenumber) AS position FROM lines GROUP BY 1, 2),
regimen_size AS (SELECT regimen_id, count(*) AS n FROM regimens GROUP BY 1),
regimen_pairs AS (
  SELECT x.regimen_id, x.item AS a, y.item AS b FROM regimens x
  JOIN regimens y ON x.regimen_id = y.regimen_id AND x.item < y.item),
regimen_edges AS (
  SELECT p.regimen_id, e.* FROM regimen_pairs p JOIN tagged_edges e ON p.a = e.a AND p.b = e.b),
side_effects AS MATERIALIZED (SELECT DISTINCT item, {sql_list(EFFECTS)}[mon] || ' s' || l_suppkey || ' ' || yr AS attr FROM lines),
proteins AS MATERIALIZED (SELECT DISTINCT item, 'P' || l_suppkey || '-' || qty AS attr FROM lines),
diseases AS MATERIALIZED (
  SELECT DISTINCT item, lower(c_mktsegment) || ' ' || c_custkey AS attr
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
pathways AS MATERIALIZED (SELECT DISTINCT item, 'SMP' || l_suppkey || '-' || yr || lpad(CAST(mon AS VARCHAR), 2, '0') AS attr FROM lines),
reports AS (
  SELECT l_orderkey AS report_id, item, {sql_list(EFFECTS)}[mon] AS reaction, rf = 'R' AS serious,
         (rf = 'R' AND o_orderpriority LIKE '1%') AS death
  FROM lines JOIN orders ON l_orderkey = o_orderkey)
"""

_WHOLE_VIEWS = _VIEWS.replace(between_sql(FIRST_SQL, "bw_"), between_sql(EVERY_SQL, "bw_"))


def with_views(sql: str, all_sources: bool = False) -> str:
    """Put the views in front of ``sql`` (which may go on with ``, name AS (...)``); ``all_sources`` takes betweenness from every item."""
    body = sql.strip()
    views = _WHOLE_VIEWS if all_sources else _VIEWS
    head = "WITH RECURSIVE" if "/*recursive*/" in body else "WITH"
    body = body.replace("/*recursive*/", "").strip()
    if body.startswith(","):
        return f"{head} {views.strip()}{body}"
    return f"{head} {views.strip()}\n{body}"
