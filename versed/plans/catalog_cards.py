"""Queries over the driver's tables, each beside the SQL that must give the same rows: cards, compositions, second identifiers, registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from versed.operators import cards
from versed.plans.registry import query
from versed.sources.tables import table

LONG = "long"
ACT_SQL = "'3' || (1950 + o_custkey % 70) || CASE WHEN o_custkey % 11 = 0 THEN 'r' ELSE 'R' END || lpad((o_custkey % 9999)::VARCHAR, 4, '0')"
TEXT_SQL = f"CASE WHEN o_orderkey % 13 = 0 THEN '9' ELSE '0' END || substr({ACT_SQL}, 2) || '-' || CASE WHEN o_orderkey % 17 = 0 THEN '20011399' ELSE strftime(o_orderdate, '%Y%m%d') END"
LINKS_SQL = f"""l AS (SELECT DISTINCT {ACT_SQL} AS act, {TEXT_SQL} AS dated, o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_custkey % 11 = 0 AS bad, o_orderdate::DATE AS day FROM orders),
t AS (SELECT DISTINCT act, dated, day FROM l WHERE NOT bad)"""


def _links(spark, sf):
    """Orders as dated texts of their customer, an act; some ids are of another sector, some dates are none, some acts no base acts."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rest = F.concat((c % 70 + 1950).cast("string"), F.when(c % 11 == 0, "r").otherwise("R"), F.lpad((c % 9999).cast("string"), 4, "0"))
    day = F.when(o % 17 == 0, "20011399").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf, "orders").select(F.concat(F.lit("3"), rest).alias("act"), F.concat(F.when(o % 13 == 0, "9").otherwise("0"), rest, F.lit("-"), day).alias("dated"))


@query(f"WITH {LINKS_SQL} SELECT * FROM t")
def dated_texts(spark, sf):
    links = _links(spark, sf)
    return cards.consolidations(links, links, "act", "dated").select("act", "dated", "day")


@query(f"""WITH {LINKS_SQL}, a AS (SELECT DISTINCT act, CASE WHEN substr(act, 8)::BIGINT % 2 = 0 THEN DATE '1995-06-01' END AS as_of, substr(act, 8)::BIGINT % 5 <> 0 AS in_force FROM l),
m AS (SELECT act, max(dated) AS latest_id, max(day) AS latest_day FROM t WHERE day <= DATE '1997-01-01' GROUP BY act),
p AS (SELECT a.act, a.as_of, max(t.day) FILTER (WHERE t.day <= a.as_of) AS f, min(t.day) FILTER (WHERE t.day > a.as_of) AS nx, max(t.day) AS last FROM a LEFT JOIN t ON t.act = a.act GROUP BY 1, 2)
SELECT a.act, m.latest_id, m.latest_day, m.act IS NOT NULL AND NOT in_force AS historical, CASE WHEN m.act IS NOT NULL AND NOT in_force THEN '1999-12-31' END AS ended, a.as_of,
CASE WHEN a.as_of IS NULL THEN NULL WHEN last IS NULL THEN 'not_found' WHEN f IS NOT NULL AND a.as_of <= last THEN 'ok' ELSE 'revision_unknown' END AS revision_status,
CASE WHEN f IS NOT NULL AND a.as_of <= last THEN '0' || substr(a.act, 2) || '-' || strftime(f, '%Y%m%d') END AS revision_id,
CASE WHEN a.as_of <= last THEN f END AS valid_from, CASE WHEN f IS NOT NULL AND a.as_of <= last THEN (nx - 1)::DATE END AS valid_to, CASE WHEN f IS NOT NULL AND a.as_of <= last AND nx IS NULL THEN last END AS known_through
FROM a LEFT JOIN m ON m.act = a.act JOIN p ON p.act = a.act""")
def act_cards(spark, sf):
    """Each act with its latest text in 1996 and, for every other act, the revision of a day."""
    links = _links(spark, sf)
    number = F.substring("act", 8, 9).cast("long")
    acts = links.select("act").distinct().withColumns({"as_of": F.when(number % 2 == 0, F.lit("1995-06-01").cast("date")), "in_force": number % 5 != 0, "ended": F.lit("1999-12-31")})
    return cards.act_cards(acts, cards.consolidations(links, links, "act", "dated"), "act", "dated", F.lit("1997-01-01").cast("date"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def compositions(spark, sf):
    return cards.composition(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").select("l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("""SELECT o_orderkey AS ident, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 3 <> 0 THEN 'ECLI:' || c_custkey END AS ecli, CASE WHEN c_custkey IS NULL THEN 'not_found' WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'ok' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""")
def second_identifiers(spark, sf):
    key = F.col("c_custkey")
    works = table(spark, sf, "customer").select(key.alias("ident"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("ECLI:"), key.cast("string"))).alias("ecli"))
    return cards.second_identifier(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ident")), works, "ident", "ecli")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 3 <> 0 THEN 'consolidation_id=c' || user_id WHEN user_id % 2 = 0 THEN 'consolidation_id=r' END, CASE WHEN event_id % 4 <> 0 THEN 'court=' || event_type END, 'judgment_date=' || strftime(ts, '%Y-%m-%d')], lambda x: x IS NOT NULL), ';') AS data FROM events""")
def citation_data(spark, sf):
    user = F.col("user_id")
    values = {
        "consolidation_id": F.when(user % 3 != 0, F.concat(F.lit("c"), user.cast("string"))).otherwise(" "), "court": F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise(""),
        "judgment_date": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    found = cards.citation_data(values, {"consolidation_id": F.when(user % 2 == 0, "r").otherwise("")})
    pairs = F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "events").select("event_id", F.array_join(pairs, ";").alias("data"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'parties_and_this_case_only' END AS scope, CASE WHEN s_nationkey % 4 = 0 THEN 'A decision of ' || s_name || ' binds only the parties, and only in this case.' END AS notice FROM supplier""")
def binding_scopes(spark, sf):
    kind = F.when(F.col("s_nationkey") % 4 == 0, "international_forum").when(F.col("s_nationkey") % 4 == 1, "state")
    return table(spark, sf, "supplier").select("s_suppkey", cards.binding_scope(kind, F.col("s_name")).alias("b")).select("s_suppkey", "b.scope", "b.notice")


@query("""WITH q AS (SELECT s_suppkey AS request, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'XX' ELSE 'REGION_' || (s_nationkey % 7) END AS o FROM supplier),
r AS (SELECT r_name AS o, n_name AS adapter FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT '', n_name FROM nation),
g AS (SELECT upper(o) AS o, string_agg(adapter, ',' ORDER BY adapter) AS a, count(*) AS n FROM r GROUP BY 1)
SELECT request, CASE WHEN q.o = '' OR (q.o <> 'XX' AND right(q.o, 1)::INT < 6) THEN 'ok' ELSE 'unknown_legal_order' END AS status, CASE WHEN q.o <> 'XX' THEN coalesce(g.a, '') ELSE '' END AS adapters, CASE WHEN q.o <> 'XX' THEN coalesce(g.n, 0) ELSE 0 END AS total FROM q LEFT JOIN g ON g.o = q.o""")
def registers(spark, sf):
    """Suppliers ask for the registers (nations) of an order (region): blank, unknown, with registers, or known without any."""
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.upper("r_name").alias("legal_order"), F.col("n_name").alias("adapter"))
    k = F.col("s_suppkey") % 4
    order = F.when(k == 0, " ").when(k == 1, "xx").otherwise(F.concat(F.lit("Region_"), (F.col("s_nationkey") % 7).cast("string")))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request"), order.alias("legal_order"))
    found = cards.registers(asked, rows, [f"REGION_{n}" for n in range(6)])
    return found.select("request", "status", F.array_join("adapters", ",").alias("adapters"), F.col("total").cast(LONG).alias("total"))
