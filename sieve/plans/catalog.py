"""Registered queries: one per inventory item, each with its DuckDB oracle SQL.

Every query reads whole test tables (or columns Spark derives from them with
the same expression the oracle uses) and returns a DataFrame. Where the test
data has no NULLs or blanks, a defect-carrying column is derived from an
existing one by a value mapping over the whole table (never a row subset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators import completeness as C
from sieve.operators import custom_sql as Q
from sieve.operators import duplicates as D
from sieve.operators import outliers as O
from sieve.operators import patterns as PT
from sieve.operators import ranges as N
from sieve.operators import referential as R
from sieve.sources.tables import read_table, read_tables, register_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# ------------------------------------------------------------ derived inputs
# Value mappings over whole tables that plant NULL / empty / blank values.
def _orders_derived(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    prio = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("   "))
             .otherwise(F.col("o_orderpriority")))
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", prio.alias("priority_text"), status.alias("status_text"))


ORDERS_DERIVED_SQL = """(SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW' THEN ''
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '   ' ELSE o_orderpriority END AS priority_text,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status_text FROM orders)"""


# ============================================================== completeness
@register("c1_completeness_labels", """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic,
       concat_ws(', ', CASE WHEN l.quality IS NULL THEN 'quality' END,
                       CASE WHEN l.toxic IS NULL THEN 'toxic' END) AS incomplete_fields
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL OR l.toxic IS NULL""")
def c1_completeness_labels(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source")
    joined = docs.join(_t(spark, d, "labels"), "doc_id", "left")
    return C.completeness(joined, ["quality", "toxic"]).violations


@register("c1_completeness_nullif", """
SELECT o_orderkey, o_custkey, NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority,
       'o_orderpriority' AS incomplete_fields
FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NULL""")
def c1_completeness_nullif(spark, d):
    o = _t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return C.completeness(o, ["o_orderpriority"]).violations


@register("c1_completeness_null_only", f"""
SELECT *, 'priority_text' AS incomplete_fields FROM {ORDERS_DERIVED_SQL} t WHERE priority_text IS NULL""")
def c1_completeness_null_only(spark, d):
    return C.completeness(_orders_derived(spark, d), ["priority_text"], check_empty_strings=False).violations


@register("c2_completeness_empty", f"""
SELECT *, 'priority_text' AS incomplete_fields FROM {ORDERS_DERIVED_SQL} t
WHERE priority_text IS NULL OR priority_text = ''""")
def c2_completeness_empty(spark, d):
    return C.completeness(_orders_derived(spark, d), ["priority_text"]).violations


@register("c3_completeness_whitespace", f"""
SELECT *, 'priority_text' AS incomplete_fields FROM {ORDERS_DERIVED_SQL} t
WHERE priority_text IS NULL OR priority_text = '' OR trim(priority_text, ' ') = ''""")
def c3_completeness_whitespace(spark, d):
    return C.completeness(_orders_derived(spark, d), ["priority_text"], check_whitespace=True).violations


@register("c4_incomplete_fields", f"""
SELECT *, concat_ws(', ',
    CASE WHEN priority_text IS NULL OR priority_text = '' THEN 'priority_text' END,
    CASE WHEN status_text IS NULL OR status_text = '' THEN 'status_text' END,
    CASE WHEN o_custkey IS NULL THEN 'o_custkey' END) AS incomplete_fields
FROM {ORDERS_DERIVED_SQL} t
WHERE priority_text IS NULL OR priority_text = '' OR status_text IS NULL OR status_text = ''
   OR o_custkey IS NULL""")
def c4_incomplete_fields(spark, d):
    return C.completeness(_orders_derived(spark, d), ["priority_text", "status_text", "o_custkey"]).violations


@register("c5_completeness_profile", f"""
SELECT 'priority_text' AS column_name, CAST(count(*) AS BIGINT) AS total_records,
       CAST(count_if(priority_text IS NULL OR priority_text = '') AS BIGINT) AS null_count,
       round(CAST(count_if(priority_text IS NULL OR priority_text = '') AS DOUBLE) / count(*) * 100, 4) AS null_percentage
FROM {ORDERS_DERIVED_SQL} a
UNION ALL
SELECT 'status_text', count(*), count_if(status_text IS NULL OR status_text = ''),
       round(CAST(count_if(status_text IS NULL OR status_text = '') AS DOUBLE) / count(*) * 100, 4)
FROM {ORDERS_DERIVED_SQL} b
UNION ALL
SELECT 'o_custkey', count(*), count_if(o_custkey IS NULL),
       round(CAST(count_if(o_custkey IS NULL) AS DOUBLE) / count(*) * 100, 4)
FROM {ORDERS_DERIVED_SQL} c""")
def c5_completeness_profile(spark, d):
    return C.completeness_profile(_orders_derived(spark, d), ["priority_text", "status_text", "o_custkey"],
                                  check_empty_strings=True)


@register("c6_first_missing_field", f"""
SELECT o_orderkey, CASE WHEN priority_text IS NULL THEN 'priority_text'
                        WHEN status_text IS NULL THEN 'status_text' END AS missing_field
FROM {ORDERS_DERIVED_SQL} t WHERE priority_text IS NULL OR status_text IS NULL""")
def c6_first_missing_field(spark, d):
    return C.first_missing_field(_orders_derived(spark, d), ["priority_text", "status_text"], keep=["o_orderkey"])


# ================================================================ referential
@register("r1_orphans_documents_labels", """
SELECT d.* FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL AND d.doc_id IS NOT NULL""")
def r1_orphans_documents_labels(spark, d):
    return R.orphans(_t(spark, d, "documents"), "doc_id", _t(spark, d, "labels"), "doc_id").violations


# Orphans are derived on the child's key by a value mapping; parents are read whole.
_CUST_REF = "CASE WHEN o_orderkey % 10 = 3 THEN -o_custkey ELSE o_custkey END"
_USER_REF = "CASE WHEN event_id % 7 = 2 THEN -1 - user_id ELSE user_id END"
_ORDERS_REF_SQL = f"(SELECT * REPLACE ({_CUST_REF} AS o_custkey) FROM orders)"
_EVENTS_REF_SQL = f"(SELECT * REPLACE ({_USER_REF} AS user_id) FROM events)"


def _orders_ref(spark, d) -> DataFrame:
    return _t(spark, d, "orders").withColumn("o_custkey", F.expr(_CUST_REF))


@register("r1_orphans_orders_customer", f"""
SELECT o.* FROM {_ORDERS_REF_SQL} o WHERE o.o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def r1_orphans_orders_customer(spark, d):
    return R.orphans(_orders_ref(spark, d), "o_custkey", _t(spark, d, "customer"), "c_custkey").violations


@register("r1_orphans_events_customer", f"""
SELECT e.* FROM {_EVENTS_REF_SQL} e WHERE e.user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)""")
def r1_orphans_events_customer(spark, d):
    ev = _t(spark, d, "events").withColumn("user_id", F.expr(_USER_REF))
    return R.orphans(ev, "user_id", _t(spark, d, "customer"), "c_custkey").violations


@register("r2_orphans_null_keys", f"""
SELECT t.* FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {_CUST_REF} END AS cust_ref
                 FROM orders) t
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = t.cust_ref)""")
def r2_orphans_null_keys(spark, d):
    o = _t(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.expr(_CUST_REF)).alias("cust_ref"))
    return R.orphans(o, "cust_ref", _t(spark, d, "customer"), "c_custkey", allow_null=False).violations


@register("r3_orphan_values", f"""
SELECT DISTINCT o.o_custkey AS orphan_value FROM {_ORDERS_REF_SQL} o WHERE o.o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
ORDER BY orphan_value LIMIT 20""")
def r3_orphan_values(spark, d):
    return R.orphans(_orders_ref(spark, d), "o_custkey", _t(spark, d, "customer"), "c_custkey").extras["orphan_values"](20)


@register("r4_orphan_counts", """
SELECT 'documents -> labels' AS relationship, CAST(count(*) AS BIGINT) AS orphan_count FROM documents d
  WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL
SELECT 'orders -> customer', count(*) FROM orders o
  WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'lineitem -> orders', count(*) FROM lineitem l
  WHERE l.l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'lineitem -> part', count(*) FROM lineitem l
  WHERE l.l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)""")
def r4_orphan_counts(spark, d):
    t = read_tables(spark, d, ["documents", "labels", "orders", "customer", "lineitem", "part"])
    return R.orphan_counts([
        ("documents -> labels", t["documents"], "doc_id", t["labels"], "doc_id"),
        ("orders -> customer", t["orders"], "o_custkey", t["customer"], "c_custkey"),
        ("lineitem -> orders", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        ("lineitem -> part", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
    ])


_PART_REF = "CASE WHEN l_linenumber = 6 THEN -l_partkey ELSE l_partkey END"
_SUPP_REF = "CASE WHEN l_orderkey % 11 = 5 THEN -1 - l_suppkey WHEN l_orderkey % 13 = 5 THEN NULL ELSE l_suppkey END"


@register("r5_multi_parent_orphans", f"""
SELECT l.* FROM (SELECT * REPLACE ({_PART_REF} AS l_partkey, {_SUPP_REF} AS l_suppkey) FROM lineitem) l
WHERE (l.l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey))
   OR (l.l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey))""")
def r5_multi_parent_orphans(spark, d):
    return _multi_parent(spark, d).violations


def _multi_parent(spark, d, **opts):
    li = _t(spark, d, "lineitem").withColumns({"l_partkey": F.expr(_PART_REF), "l_suppkey": F.expr(_SUPP_REF)})
    return R.multi_parent_orphans(li, [("l_partkey", _t(spark, d, "part"), "p_partkey"),
                                       ("l_suppkey", _t(spark, d, "supplier"), "s_suppkey")], **opts)


# ================================================================= duplicates
def _dup_summary_sql(table: str, keys: list[str], where: str | None = None, key_exprs=None) -> str:
    exprs = key_exprs or keys
    cond = where if where is not None else " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""
SELECT CAST(COALESCE(SUM(cnt - 1), 0) AS BIGINT) AS violation_count, CAST(count(*) AS BIGINT) AS group_count,
       CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS member_rows
FROM (SELECT count(*) AS cnt FROM {table} {'WHERE ' + cond if cond else ''}
      GROUP BY {', '.join(exprs)} HAVING count(*) > 1) g"""


@register("d1_duplicates_lineitem", _dup_summary_sql("lineitem", ["l_orderkey", "l_linenumber"]))
def d1_duplicates_lineitem(spark, d):
    return D.duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).summary


@register("d1_duplicates_documents_text", _dup_summary_sql("documents", ["text"]))
def d1_duplicates_documents_text(spark, d):
    return D.duplicates(_t(spark, d, "documents"), ["text"]).summary


@register("d1_duplicates_orders", _dup_summary_sql("orders", ["o_custkey", "o_orderdate"]))
def d1_duplicates_orders(spark, d):
    return D.duplicates(_t(spark, d, "orders"), ["o_custkey", "o_orderdate"]).summary


@register("d2_duplicate_groups", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS duplicate_count FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def d2_duplicate_groups(spark, d):
    return D.duplicate_groups(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("d2_top_duplicate_groups", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS duplicate_count FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
ORDER BY duplicate_count DESC, l_orderkey, l_linenumber LIMIT 10""")
def d2_top_duplicate_groups(spark, d):
    return D.top_duplicate_groups(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 10)


@register("d3_duplicate_members", """
SELECT l.*, g.cnt AS group_size FROM lineitem l
JOIN (SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS cnt FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) g
  ON l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.l_linenumber""")
def d3_duplicate_members(spark, d):
    return D.duplicate_members(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _part_cased(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    name = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    return p.select("p_partkey", name.alias("name"), "p_brand", "p_size")


PART_CASED_SQL = """(SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name,
    p_brand, p_size FROM part)"""


@register("d4_duplicates_case_sensitive", _dup_summary_sql(PART_CASED_SQL + " t", ["name", "p_brand"]))
def d4_duplicates_case_sensitive(spark, d):
    return D.duplicates(_part_cased(spark, d), ["name", "p_brand"]).summary


@register("d4_duplicates_case_insensitive", _dup_summary_sql(
    PART_CASED_SQL + " t", ["name", "p_brand"], key_exprs=["lower(name)", "lower(p_brand)"]))
def d4_duplicates_case_insensitive(spark, d):
    return D.duplicates(_part_cased(spark, d), ["name", "p_brand"], case_sensitive=False).summary


@register("d4_groups_case_insensitive", f"""
SELECT min(name) AS name, min(p_brand) AS p_brand, CAST(count(*) AS BIGINT) AS duplicate_count
FROM {PART_CASED_SQL} t WHERE name IS NOT NULL AND p_brand IS NOT NULL
GROUP BY lower(name), lower(p_brand) HAVING count(*) > 1""")
def d4_groups_case_insensitive(spark, d):
    return D.duplicate_groups(_part_cased(spark, d), ["name", "p_brand"], case_sensitive=False)


def _orders_nullable_keys(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"))


@register("d5_duplicates_keep_nulls", _dup_summary_sql(
    "(SELECT o_custkey, NULLIF(o_orderpriority, '5-LOW') AS prio FROM orders) t", ["o_custkey", "prio"], where=""))
def d5_duplicates_keep_nulls(spark, d):
    return D.duplicates(_orders_nullable_keys(spark, d), ["o_custkey", "prio"], ignore_null=False).summary


@register("d5_members_keep_nulls", """
WITH t AS (SELECT o_orderkey, o_custkey, NULLIF(o_orderpriority, '5-LOW') AS prio FROM orders),
g AS (SELECT o_custkey, prio, CAST(count(*) AS BIGINT) AS cnt FROM t GROUP BY o_custkey, prio HAVING count(*) > 1)
SELECT t.*, g.cnt AS group_size FROM t JOIN g
  ON t.o_custkey IS NOT DISTINCT FROM g.o_custkey AND t.prio IS NOT DISTINCT FROM g.prio""")
def d5_members_keep_nulls(spark, d):
    return D.duplicate_members(_orders_nullable_keys(spark, d), ["o_custkey", "prio"], ignore_null=False)


@register("d6_uniqueness_events", _dup_summary_sql("events", ["event_id"]))
def d6_uniqueness_events(spark, d):
    return D.duplicates(_t(spark, d, "events"), ["event_id"]).summary


# Spark's soundex written with DuckDB string functions (oracle only): letters
# map to digit classes, H/W are transparent, other characters separate, runs of
# one digit collapse, vowels drop, the result is padded to four characters.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SOUNDEX_CODES = "01230127022455012623017202"  # fixed values: American soundex classes A..Z (7 = H, W)


def _duck_soundex(x: str) -> str:
    u = f"upper({x})"
    first = f"substr({u}, 1, 1)"
    first_code = f"(CASE WHEN {first} IN ('H', 'W') THEN '0' ELSE translate({first}, '{_AZ}', '{_SOUNDEX_CODES}') END)"
    rest = f"translate(regexp_replace(substr({u}, 2), '[^A-Z]', '0', 'g'), '{_AZ}', '{_SOUNDEX_CODES}')"
    s = f"replace({first_code} || {rest}, '7', '')"
    for digit in "123456":
        s = f"regexp_replace({s}, '{digit}+', '{digit}', 'g')"
    tail = f"rpad(substr(replace(substr({s}, 2), '0', ''), 1, 3), 3, '0')"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN '' "
            f"WHEN NOT regexp_matches(substr({x}, 1, 1), '^[A-Za-z]$') THEN {x} ELSE {first} || {tail} END)")


_PART_BLOCKS_SQL = f"""
WITH k AS (SELECT p_partkey AS match_id, {_duck_soundex('p_name')} AS soundex_p_name, p_brand, p_size FROM part
           WHERE p_name IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL AND p_partkey IS NOT NULL),
b AS (SELECT soundex_p_name, p_brand, p_size, min(match_id) AS anchor_id, CAST(count(*) AS BIGINT) AS block_size
      FROM k GROUP BY soundex_p_name, p_brand, p_size HAVING count(*) > 1)"""


@register("d7_fuzzy_duplicates", _PART_BLOCKS_SQL + """
SELECT b.anchor_id, k.match_id, k.soundex_p_name, k.p_brand, k.p_size, b.block_size
FROM k JOIN b ON k.soundex_p_name = b.soundex_p_name AND k.p_brand = b.p_brand AND k.p_size = b.p_size
WHERE k.match_id <> b.anchor_id""")
def d7_fuzzy_duplicates(spark, d):
    return D.fuzzy_duplicates(_t(spark, d, "part"), "p_partkey", ["p_name"], ["p_brand", "p_size"]).violations


@register("d7_fuzzy_pair_count", _PART_BLOCKS_SQL + """
SELECT CAST(COALESCE(SUM(block_size * (block_size - 1) / 2), 0) AS BIGINT) AS violation_count,
       CAST(count(*) AS BIGINT) AS block_count, CAST(COALESCE(max(block_size), 0) AS BIGINT) AS largest_block
FROM b""")
def d7_fuzzy_pair_count(spark, d):
    return D.fuzzy_duplicates(_t(spark, d, "part"), "p_partkey", ["p_name"], ["p_brand", "p_size"]).summary


# ===================================================================== ranges
@register("n1_range_lineitem_quantity", """
SELECT * FROM lineitem WHERE l_quantity IS NOT NULL AND NOT isnan(l_quantity)
  AND (l_quantity < 1 OR l_quantity > 45)""")
def n1_range_lineitem_quantity(spark, d):
    return N.value_range(_t(spark, d, "lineitem"), "l_quantity", 1, 45).violations


@register("n1_range_events_value", """
SELECT * FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND (value < 1 OR value > 300)""")
def n1_range_events_value(spark, d):
    return N.value_range(_t(spark, d, "events"), "value", 1, 300).violations


@register("n2_range_exclusive", """
SELECT * FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND (value <= 1 OR value >= 300)""")
def n2_range_exclusive(spark, d):
    return N.value_range(_t(spark, d, "events"), "value", 1, 300, inclusive=False).violations


@register("n3_range_min_only", """
SELECT * FROM lineitem WHERE l_discount IS NOT NULL AND NOT isnan(l_discount) AND l_discount < 0.01""")
def n3_range_min_only(spark, d):
    return N.value_range(_t(spark, d, "lineitem"), "l_discount", min_value=0.01).violations


@register("n3_range_max_only", """
SELECT * FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND o_totalprice > 300000""")
def n3_range_max_only(spark, d):
    return N.value_range(_t(spark, d, "orders"), "o_totalprice", max_value=300000).violations


@register("n4_range_summary", """
SELECT 'l_quantity < 1' AS violation_type, CAST(count(*) AS BIGINT) AS violation_count FROM lineitem WHERE l_quantity < 1
UNION ALL SELECT 'l_quantity > 45', count(*) FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT 'l_discount > 0.08', count(*) FROM lineitem WHERE l_discount > 0.08
UNION ALL SELECT 'l_tax < 0', count(*) FROM lineitem WHERE l_tax < 0""")
def n4_range_summary(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return N.range_summary(_t(spark, d, "lineitem"), [
        ("l_quantity < 1", q < 1), ("l_quantity > 45", q > 45), ("l_discount > 0.08", disc > 0.08),
        ("l_tax < 0", tax < 0)])


@register("n5_date_range", """
SELECT * FROM orders WHERE o_orderdate IS NOT NULL
  AND (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-01-01')""")
def n5_date_range(spark, d):
    return N.date_range(_t(spark, d, "orders"), "o_orderdate", "1996-01-01", "2001-01-01").violations


@register("n6_future_dates", """
SELECT * FROM lineitem WHERE l_shipdate IS NOT NULL AND l_shipdate > TIMESTAMP '2001-06-30 00:00:00'""")
def n6_future_dates(spark, d):
    return N.future_dates(_t(spark, d, "lineitem"), "l_shipdate", "2001-06-30 00:00:00").violations


@register("n7_cross_field", """
SELECT l.*, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate IS NOT NULL AND o.o_orderdate IS NOT NULL AND NOT (l.l_shipdate >= o.o_orderdate)""")
def n7_cross_field(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = _t(spark, d, "lineitem").join(o, "l_orderkey")
    return N.cross_field(joined, "l_shipdate", ">=", "o_orderdate").violations


# =================================================================== patterns
@register("p1_pattern_brand", """
SELECT * FROM part WHERE p_brand IS NOT NULL AND NOT regexp_matches(p_brand, '^Brand#[0-9]$')""")
def p1_pattern_brand(spark, d):
    return PT.pattern(_t(spark, d, "part"), "p_brand", r"^Brand#[0-9]$").violations


_NAME_VALUE = "CASE WHEN c_custkey % 6 = 1 THEN replace(c_name, '#', '') ELSE c_name END"


@register("p1_pattern_customer_name", f"""
SELECT * FROM (SELECT c_custkey, {_NAME_VALUE} AS name FROM customer) t
WHERE name IS NOT NULL AND NOT regexp_matches(name, '^Customer#[0-9]{{9}}$')""")
def p1_pattern_customer_name(spark, d):
    names = _t(spark, d, "customer").select("c_custkey", F.expr(_NAME_VALUE).alias("name"))
    return PT.pattern(names, "name", r"^Customer#[0-9]{9}$").violations


@register("p3_pattern_inverse", r"""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE text IS NOT NULL AND regexp_matches(text, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')""")
def p3_pattern_inverse(spark, d):
    docs = _t(spark, d, "documents")
    out = PT.pattern(docs, "text", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", inverse=True, must_contain="@")
    return out.violations.select("doc_id", "lang", "source", "n_chars")


@register("p4_pattern_match_null", """
SELECT * FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS prio FROM orders) t
WHERE prio IS NULL OR NOT regexp_matches(prio, '^[1-3]-')""")
def p4_pattern_match_null(spark, d):
    o = _orders_nullable_keys(spark, d).select("o_orderkey", "prio")
    return PT.pattern(o, "prio", "^[1-3]-", match_null=False).violations


@register("p5_like_widget", """
SELECT * FROM part WHERE p_name IS NOT NULL AND p_name NOT LIKE '%widget'""")
def p5_like_widget(spark, d):
    return PT.like(_t(spark, d, "part"), "p_name", "%widget").violations


@register("p5_like_https", """
SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url NOT LIKE 'https:%'""")
def p5_like_https(spark, d):
    return PT.like(_t(spark, d, "pages").select("page_id", "url"), "url", "https:%").violations


@register("p6_character_classes", """
SELECT * FROM part WHERE p_brand IS NOT NULL AND NOT regexp_matches(p_brand, '^Brand#[1-2][0-9]$')""")
def p6_character_classes(spark, d):
    return PT.pattern(_t(spark, d, "part"), "p_brand", r"^Brand#[1-2][0-9]$").violations


# =================================================================== outliers
def _z_sql(table: str, col: str, cond: str, cols: str = "e.*") -> str:
    return f"""
WITH s AS (SELECT avg(CAST({col} AS DOUBLE)) AS m, stddev_samp(CAST({col} AS DOUBLE)) AS sd
           FROM {table} WHERE {col} IS NOT NULL)
SELECT {cols}, round((CAST(e.{col} AS DOUBLE) - s.m) / s.sd, 4) AS zscore
FROM {table} e, s WHERE e.{col} IS NOT NULL AND {cond.format(z=f'((CAST(e.{col} AS DOUBLE) - s.m) / s.sd)')}"""


@register("o1_zscore_events_both", _z_sql("events", "value", "abs({z}) > 3"))
def o1_zscore_events_both(spark, d):
    return O.zscore(_t(spark, d, "events"), "value", 3).violations


@register("o2_zscore_events_high", _z_sql("events", "value", "{z} > 3"))
def o2_zscore_events_high(spark, d):
    return O.zscore(_t(spark, d, "events"), "value", 3, "high").violations


@register("o2_zscore_events_low", _z_sql("events", "value", "{z} < -1"))
def o2_zscore_events_low(spark, d):
    return O.zscore(_t(spark, d, "events"), "value", 1, "low").violations


@register("o1_zscore_events_1_5", _z_sql("events", "value", "abs({z}) > 1.5"))
def o1_zscore_events_1_5(spark, d):
    return O.zscore(_t(spark, d, "events"), "value", 1.5).violations


@register("o1_zscore_documents", _z_sql("documents", "n_chars", "abs({z}) > 3",
                                        "e.doc_id, e.lang, e.source, e.n_chars"))
def o1_zscore_documents(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return O.zscore(docs, "n_chars", 3).violations


def _iqr_cont_sql(table: str, col: str, cols: str = "e.*", k: float = 1.5) -> str:
    return f"""
WITH q AS (SELECT quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3
           FROM {table} WHERE {col} IS NOT NULL)
SELECT {cols} FROM {table} e, q WHERE e.{col} IS NOT NULL
  AND (e.{col} < q.q1 - {k} * (q.q3 - q.q1) OR e.{col} > q.q3 + {k} * (q.q3 - q.q1))"""


def _iqr_rank_sql(table: str, col: str, cols: str = "e.*", k: float = 1.5) -> str:
    return f"""
WITH o AS (SELECT CAST({col} AS DOUBLE) AS v, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS n
           FROM {table} WHERE {col} IS NOT NULL),
q AS (SELECT max(CASE WHEN i = n // 4 THEN v END) AS q1, max(CASE WHEN i = (3 * n) // 4 THEN v END) AS q3 FROM o)
SELECT {cols} FROM {table} e, q WHERE e.{col} IS NOT NULL
  AND (e.{col} < q.q1 - {k} * (q.q3 - q.q1) OR e.{col} > q.q3 + {k} * (q.q3 - q.q1))"""


@register("o5_iqr_cont_events", _iqr_cont_sql("events", "value"))
def o5_iqr_cont_events(spark, d):
    return O.iqr(_t(spark, d, "events"), "value", 1.5).violations


@register("o5_iqr_cont_documents", _iqr_cont_sql("documents", "n_chars", "e.doc_id, e.lang, e.source, e.n_chars"))
def o5_iqr_cont_documents(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return O.iqr(docs, "n_chars", 1.5).violations


@register("o6_iqr_rank_events", _iqr_rank_sql("events", "value"))
def o6_iqr_rank_events(spark, d):
    return O.iqr(_t(spark, d, "events"), "value", 1.5, quartiles="rank").violations


@register("o6_iqr_rank_documents", _iqr_rank_sql("documents", "n_chars", "e.doc_id, e.lang, e.source, e.n_chars"))
def o6_iqr_rank_documents(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return O.iqr(docs, "n_chars", 1.5, quartiles="rank").violations


@register("o7_zscore_stats", """
SELECT 'zscore' AS method, CAST(3 AS DOUBLE) AS threshold, 'both' AS direction, CAST(count(*) AS BIGINT) AS n,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std_dev,
       CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS iqr,
       round(avg(value) - 3 * stddev_samp(value), 4) AS lower_bound,
       round(avg(value) + 3 * stddev_samp(value), 4) AS upper_bound, CAST(NULL AS VARCHAR) AS note
FROM events WHERE value IS NOT NULL""")
def o7_zscore_stats(spark, d):
    return O.zscore(_t(spark, d, "events"), "value", 3).extras["stats"]()


@register("o7_iqr_stats", """
WITH q AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL)
SELECT 'iqr' AS method, CAST(1.5 AS DOUBLE) AS threshold, 'high' AS direction, CAST(n AS BIGINT) AS n,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std_dev,
       round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
       CAST(NULL AS DOUBLE) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
       CAST(NULL AS VARCHAR) AS note
FROM q""")
def o7_iqr_stats(spark, d):
    return O.iqr(_t(spark, d, "events"), "value", 1.5, "high").extras["stats"]()


@register("o8_iqr_approx_events", """
WITH q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL)
SELECT e.* FROM events e, q WHERE e.value IS NOT NULL
  AND (e.value < q.q1 - 1.5 * (q.q3 - q.q1) OR e.value > q.q3 + 1.5 * (q.q3 - q.q1))""")
def o8_iqr_approx_events(spark, d):
    """An accuracy above the number of rows of a small table makes its sketch exact (rank error n / accuracy < 1)."""
    return O.iqr(_t(spark, d, "events"), "value", 1.5, quartiles="approx", accuracy=1_000_000).violations


@register("o8_approx_rank_error", """
SELECT p AS probability, CAST(count(*) AS BIGINT) AS n, true AS within_bound
FROM events, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(p) WHERE value IS NOT NULL GROUP BY p""")
def o8_approx_rank_error(spark, d):
    """Whether each sketched quartile's exact rank lies within n / accuracy of the wanted rank."""
    from sieve.operators import quantiles as QQ

    values, probs, accuracy = QQ.clean_values(_t(spark, d, "events"), "value"), [0.25, 0.5, 0.75], 200
    marks, _ = QQ.quantiles_approx(values, probs, accuracy)
    n = F.count(F.lit(1))
    rows = values.agg(n.alias("n"), *[F.struct(F.count_if(F.col("v") < F.lit(m)).alias("below"),
                                               F.count_if(F.col("v") <= F.lit(m)).alias("upto")).alias(f"m{i}") for i, m in enumerate(marks)])
    each = [F.struct(F.lit(p).alias("probability"), F.col("n").cast("bigint").alias("n"),
                     ((F.col(f"m{i}.below") - F.col("n") / accuracy <= F.col("n") * p)
                      & (F.col(f"m{i}.upto") + F.col("n") / accuracy >= F.col("n") * p)).alias("within_bound")) for i, p in enumerate(probs)]
    return rows.select(F.explode(F.array(*each)).alias("r")).select("r.*")


# ================================================================= custom SQL
def _views(spark, d, names):
    register_views(spark, read_tables(spark, d, names))


@register("q1_custom_sql", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o
WHERE o.o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)""")
def q1_custom_sql(spark, d):
    _views(spark, d, ["orders"])
    return Q.custom_sql(spark, """
        SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o
        WHERE o.o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)""").violations


@register("q2_count_query", """
SELECT CAST(count(*) AS BIGINT) AS violation_count FROM lineitem WHERE l_tax > l_discount""")
def q2_count_query(spark, d):
    _views(spark, d, ["lineitem"])
    return Q.custom_sql(spark, "SELECT * FROM lineitem WHERE l_tax > l_discount",
                        count_query="SELECT count(*) AS cnt FROM lineitem WHERE l_tax > l_discount").summary


@register("q3_violation_sample", """
SELECT * FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate LIMIT 5""")
def q3_violation_sample(spark, d):
    v = N.value_range(_t(spark, d, "lineitem"), "l_quantity", 1, 45).violations
    return v.orderBy(*v.columns).limit(5)


@register("q4_inactive_parents", """
SELECT c.* FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderdate >= TIMESTAMP '2000-06-01' AND o.o_custkey = c.c_custkey)""")
def q4_inactive_parents(spark, d):
    o = _t(spark, d, "orders")
    recent = F.col("o_orderdate") >= F.lit("2000-06-01").cast(o.schema["o_orderdate"].dataType)
    return Q.inactive_parents(_t(spark, d, "customer"), "c_custkey", o, "o_custkey", child_filter=recent).violations


@register("q5_child_after_parent", """
SELECT l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F' AND l.l_shipdate > o.o_orderdate""")
def q5_child_after_parent(spark, d):
    return Q.child_after_parent_event(_t(spark, d, "lineitem"), "l_orderkey", "l_shipdate",
                                      _t(spark, d, "orders"), "o_orderkey", "o_orderdate",
                                      parent_filter=F.col("o_orderstatus") == "F").violations


# ====================================================================== suite
from sieve.plans import flagship as _fs  # noqa: E402
from sieve.plans import report as G  # noqa: E402

_SUITE_COLUMNS = ["rule_name", "rule_type", "severity", "severity_rank", "passed", "violation_count"]
_SUITE_SQL = _fs.flagship_oracle_sql()


@register("e1_suite_results", _SUITE_SQL)
def e1_suite_results(spark, d):
    return _fs.flagship_results(spark, d).select(*_SUITE_COLUMNS)


@register("e2_suite_severity_filter", f"""
SELECT * FROM ({_SUITE_SQL}) r WHERE severity IN ('critical', 'high')""")
def e2_suite_severity_filter(spark, d):
    from sieve.plans.suite import run_suite
    tables = read_tables(spark, d, _fs.FLAGSHIP_TABLES)
    return run_suite(spark, tables, _fs.FLAGSHIP_RULES, severity_filter=["CRITICAL", "High"]).results.select(
        *_SUITE_COLUMNS)


@register("e6_fused_row_checks", """
SELECT CAST(count_if(l_quantity < 1 OR l_quantity > 45) AS BIGINT) AS quantity_range,
       CAST(count_if(l_discount < 0 OR l_discount > 0.08) AS BIGINT) AS discount_range,
       CAST(count_if(NOT regexp_matches(l_returnflag, '^[AR]$')) AS BIGINT) AS returnflag_format,
       CAST(count_if(l_shipdate > TIMESTAMP '2001-06-30') AS BIGINT) AS shipdate_future,
       CAST(count_if(l_comment_missing) AS BIGINT) AS completeness
FROM (SELECT *, l_returnflag IS NULL OR l_returnflag = '' OR l_linestatus IS NULL OR l_linestatus = ''
          AS l_comment_missing FROM lineitem) t""")
def e6_fused_row_checks(spark, d):
    """E6 on its own: five row rules on lineitem evaluated in one scan."""
    from sieve.plans.fused import fused_counts
    li = _t(spark, d, "lineitem")
    return fused_counts(li, {
        "quantity_range": N.value_range(li, "l_quantity", 1, 45),
        "discount_range": N.value_range(li, "l_discount", 0, 0.08),
        "returnflag_format": PT.pattern(li, "l_returnflag", "^[AR]$"),
        "shipdate_future": N.future_dates(li, "l_shipdate", "2001-06-30"),
        "completeness": C.completeness(li, ["l_returnflag", "l_linestatus"]),
    })


@register("g1_run_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_rules, CAST(count_if(passed) AS BIGINT) AS passed,
       CAST(count_if(NOT passed) AS BIGINT) AS failed FROM ({_SUITE_SQL}) r""")
def g1_run_summary(spark, d):
    return G.run_summary(_fs.flagship_results(spark, d))


@register("g2_failures_by_severity", f"""
SELECT CAST(count_if(NOT passed AND severity = 'critical') AS BIGINT) AS critical,
       CAST(count_if(NOT passed AND severity = 'high') AS BIGINT) AS high,
       CAST(count_if(NOT passed AND severity = 'medium') AS BIGINT) AS medium,
       CAST(count_if(NOT passed AND severity = 'low') AS BIGINT) AS low FROM ({_SUITE_SQL}) r""")
def g2_failures_by_severity(spark, d):
    return G.failures_by_severity(_fs.flagship_results(spark, d))


@register("g3_failed_rules", f"""
SELECT rule_name, severity, severity_rank, violation_count FROM ({_SUITE_SQL}) r WHERE NOT passed
ORDER BY severity_rank, rule_name""")
def g3_failed_rules(spark, d):
    return G.failed_rules(_fs.flagship_results(spark, d)).select(
        "rule_name", "severity", "severity_rank", "violation_count")


@register("g4_high_failures", f"""
SELECT rule_name, violation_count FROM ({_SUITE_SQL}) r WHERE NOT passed AND severity = 'high'""")
def g4_high_failures(spark, d):
    return G.high_failures(_fs.flagship_results(spark, d)).select("rule_name", "violation_count")


def _g5_sql(orders: str) -> str:
    issue = "o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_totalprice > 300000"
    return f"""
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS total_records, CAST(count_if({issue}) AS BIGINT) AS records_with_issues,
       CAST(100.0 - count_if({issue}) * 100.0 / count(*) AS DECIMAL(5,2)) AS quality_score
FROM {orders} o
UNION ALL
SELECT 'lineitem', count(*), count_if(l_quantity > 45 OR l_discount > 0.08),
       CAST(100.0 - count_if(l_quantity > 45 OR l_discount > 0.08) * 100.0 / count(*) AS DECIMAL(5,2))
FROM lineitem"""


def _g5(spark, d, orders, **opts) -> DataFrame:
    o = G.with_match_flag(orders, "o_custkey", _t(spark, d, "customer"), "c_custkey", "has_customer", **opts)
    li = _t(spark, d, "lineitem")
    return G.quality_scores([
        ("orders", o, ~F.col("has_customer") | (F.col("o_totalprice") > 300000)),
        ("lineitem", li, (F.col("l_quantity") > 45) | (F.col("l_discount") > 0.08)),
    ])


@register("g5_quality_score", _g5_sql(_ORDERS_REF_SQL))
def g5_quality_score(spark, d):
    return _g5(spark, d, _orders_ref(spark, d))


@register("g6_quality_trend", """
SELECT CAST(ts AS DATE) AS check_date, CAST(count(*) AS BIGINT) AS records_checked,
       CAST(count_if(value > 300) AS BIGINT) AS high_value, CAST(count_if(event_type = 'error') AS BIGINT) AS errors
FROM events GROUP BY CAST(ts AS DATE) ORDER BY check_date DESC""")
def g6_quality_trend(spark, d):
    ev = _t(spark, d, "events")
    return G.quality_trend(ev, "ts", {"high_value": F.col("value") > 300, "errors": F.col("event_type") == "error"})


@register("g7_history_trend", """
WITH h AS (SELECT event_type AS connection, CAST(ts AS DATE) AS timestamp, CAST(count(*) AS BIGINT) AS total,
                  CAST(count_if(value > 100) AS BIGINT) AS failed FROM events GROUP BY 1, 2)
SELECT *, lag(failed) OVER (PARTITION BY connection ORDER BY timestamp) AS previous_failed,
       failed - lag(failed) OVER (PARTITION BY connection ORDER BY timestamp) AS failed_change FROM h""")
def g7_history_trend(spark, d):
    """History: one 'run' per (event type, day) with the rows over 100 as its failures."""
    ev = _t(spark, d, "events")
    hist = ev.groupBy(F.col("event_type").alias("connection"), F.to_date("ts").alias("timestamp")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(F.col("value") > 100).cast("bigint").alias("failed"))
    return G.history_trend(hist)


# ================================================================== streaming
from sieve.functions import predicates as P  # noqa: E402
from sieve.streaming import checks as S  # noqa: E402

_KNOWN_EVENT = "^(view|click|purchase|signup)$"
_T1_CONDS = {
    "value_range": "value IS NOT NULL AND NOT isnan(value) AND (value < 1 OR value > 300)",
    "event_type_known": f"event_type IS NOT NULL AND NOT regexp_matches(event_type, '{_KNOWN_EVENT}')",
    "user_present": "user_id IS NULL",
}
_T1_ANY = " OR ".join(f"({c})" for c in _T1_CONDS.values())


def _events_stream(spark, d, max_files=None):
    schema = _t(spark, d, "events").schema
    return S.file_stream(spark, d, schema, file_glob="events.parquet", max_files_per_trigger=max_files)


def _t1_predicates(stream):
    return {
        "value_range": P.out_of_range(stream, "value", 1, 300),
        "event_type_known": P.pattern_violation("event_type", _KNOWN_EVENT),
        "user_present": P.any_missing(stream, ["user_id"]),
    }


@register("t1_stream_row_checks", f"""
SELECT event_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _T1_CONDS.items())})
       AS failed_rules
FROM events WHERE {_T1_ANY}""")
def t1_stream_row_checks(spark, d):
    stream = _events_stream(spark, d)
    q, good, bad = S.run_row_checks(spark, stream, _t1_predicates(stream))
    q.awaitTermination()
    return spark.read.parquet(bad).select("event_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@register("t1_stream_good_bad_split", f"""
SELECT 'bad' AS status, CAST(count_if({_T1_ANY}) AS BIGINT) AS row_count FROM events
UNION ALL SELECT 'good', CAST(count_if(NOT ({_T1_ANY})) AS BIGINT) FROM events""")
def t1_stream_good_bad_split(spark, d):
    stream = _events_stream(spark, d)
    q, good, bad = S.run_row_checks(spark, stream, _t1_predicates(stream))
    q.awaitTermination()
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
              .select(F.lit(k).alias("status"), "row_count") for k, p in (("bad", bad), ("good", good))]
    return counts[0].unionByName(counts[1])


@register("t2_stream_window_trend", """
SELECT CAST(ts AS DATE) AS window_date, CAST(count(*) AS BIGINT) AS records_checked,
       CAST(count_if(value > 300) AS BIGINT) AS high_value, CAST(count_if(event_type = 'error') AS BIGINT) AS errors
FROM events GROUP BY CAST(ts AS DATE)""")
def t2_stream_window_trend(spark, d):
    stream = _events_stream(spark, d)
    trend = S.windowed_trend(stream, "ts", {"high_value": F.col("value") > 300,
                                            "errors": F.col("event_type") == "error"})
    q, path = S.run_to_parquet(spark, trend, "window_trend", output_mode="complete")
    q.awaitTermination()
    return spark.read.parquet(path).select(F.to_date(F.col("window.start")).alias("window_date"),
                                           "records_checked", "high_value", "errors")


@register("t3_stream_orphans", ORACLE["r1_orphans_events_customer"])
def t3_stream_orphans(spark, d):
    stream = _events_stream(spark, d)
    stream = stream.withColumn("user_id", F.expr(_USER_REF))
    orphans = S.stream_orphans(stream, "user_id", _t(spark, d, "customer"), "c_custkey")
    q, path = S.run_to_parquet(spark, orphans, "orphans")
    q.awaitTermination()
    return spark.read.parquet(path)


@register("t4_stream_batch_duplicates", _dup_summary_sql("events", ["user_id", "event_type"]))
def t4_stream_batch_duplicates(spark, d):
    """D1 per micro-batch; the events file arrives as one batch, so it equals the table's D1."""
    q, path = S.run_batch_duplicates(spark, _events_stream(spark, d, max_files=1), ["user_id", "event_type"])
    q.awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


@register("t4_stream_drop_repeats", """
SELECT DISTINCT user_id, event_type FROM events""")
def t4_stream_drop_repeats(spark, d):
    """Several batches; the watermark is longer than the data's span, so every repeat is met whatever the batches are."""
    stream = _events_in_files(spark, d, max_files=1)
    s = S.drop_repeats(stream, ["user_id", "event_type"], "ts", "3650 days")
    q, path = S.run_to_parquet(spark, s, "drop_repeats")
    q.awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type")


def _events_in_files(spark, d, max_files: int, files: int = 4) -> DataFrame:
    """The events table as a stream over several files, written in no particular order."""
    ev = _t(spark, d, "events")
    path = scratch_path(spark, "streams/events")
    ev.repartition(files).write.parquet(path)
    return S.file_stream(spark, path, ev.schema, file_glob="*.parquet", max_files_per_trigger=max_files)


# ============================================================ sources, sinks
from pyspark.sql import types as _T  # noqa: E402

from sieve.staging import scratch_path  # noqa: E402
from sieve.sources import files as _files  # noqa: E402
from sieve.sources import sinks as _sinks  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a sink round trip."""
    return scratch_path(spark, f"sinks/{name}")


_ORDERS_CSV_SCHEMA = _T.StructType([
    _T.StructField("o_orderkey", _T.LongType()), _T.StructField("o_custkey", _T.LongType()),
    _T.StructField("o_totalprice", _T.DoubleType()), _T.StructField("o_orderpriority", _T.StringType()),
])


@register("s3_csv_source_range", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(NULL AS VARCHAR) AS _corrupt_record
FROM orders WHERE o_totalprice > 300000""")
def s3_csv_source_range(spark, d):
    """Orders written as CSV, read back with an explicit schema (PERMISSIVE), then N3."""
    path = _scratch(spark, "orders_csv")
    _t(spark, d, "orders").select(*[f.name for f in _ORDERS_CSV_SCHEMA.fields]).write.option(
        "header", True).csv(path)
    df = _files.read_csv(spark, path, _ORDERS_CSV_SCHEMA)
    return N.value_range(df, "o_totalprice", max_value=300000).violations


@register("s3_csv_corrupt_rows", """
SELECT CAST(count_if(o_orderkey % 9 = 4) AS BIGINT) AS corrupt_rows,
       CAST(count_if(o_orderkey % 9 = 4 OR o_custkey IS NULL OR o_totalprice IS NULL OR o_orderpriority IS NULL)
            AS BIGINT) AS rows_with_nulls, CAST(count(*) AS BIGINT) AS total_rows FROM orders""")
def s3_csv_corrupt_rows(spark, d):
    """Orders written as CSV with a price that is no number in every ninth row or so."""
    path = _scratch(spark, "orders_csv")
    price = F.when(F.col("o_orderkey") % 9 == 4, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    _t(spark, d, "orders").select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderpriority").write.option(
        "header", True).csv(path)
    return _files.corrupt_summary(_files.read_csv(spark, path, _ORDERS_CSV_SCHEMA))


@register("s6_report_sink", f"""
SELECT rule_name, rule_type, severity, passed, violation_count FROM ({_SUITE_SQL}) r""")
def s6_report_sink(spark, d):
    rep = _fs.flagship_report(spark, d)
    path = _scratch(spark, "report")
    _sinks.write_report(rep, path)
    return spark.read.json(path).select("rule_name", "rule_type", "severity", "passed",
                                        F.col("violation_count").cast("bigint").alias("violation_count"))


@register("s7_summary_sink", f"""
SELECT CAST(count(*) AS BIGINT) AS total_rules, CAST(count_if(passed) AS BIGINT) AS passed,
       CAST(count_if(NOT passed) AS BIGINT) AS failed,
       CAST(count_if(NOT passed AND severity = 'critical') AS BIGINT) AS critical_count,
       CAST(count_if(NOT passed AND severity = 'high') AS BIGINT) AS high_failures,
       CAST(string_agg(CASE WHEN NOT passed THEN rule_name END, ',' ORDER BY severity_rank, rule_name) AS VARCHAR)
         AS failed_rules
FROM ({_SUITE_SQL}) r""")
def s7_summary_sink(spark, d):
    rep = _fs.flagship_report(spark, d)
    path = _scratch(spark, "summary")
    _sinks.write_summary(rep, path)
    s = spark.read.json(path)
    return s.select(*[F.col(c).cast("bigint").alias(c) for c in ("total_rules", "passed", "failed", "critical_count")],
                    F.col("failures_by_severity.high").cast("bigint").alias("high_failures"),
                    F.array_join(F.transform("failed_rules", lambda r: r["name"]), ",").alias("failed_rules"))


@register("s8_history_sink", f"""
WITH r AS ({_SUITE_SQL}), one AS (
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(passed) AS BIGINT) AS passed,
         CAST(count_if(NOT passed) AS BIGINT) AS failed,
         CAST(count_if(NOT passed AND severity = 'critical') AS BIGINT) AS critical,
         CAST(count_if(NOT passed AND severity = 'high') AS BIGINT) AS high FROM r)
SELECT * FROM one UNION ALL SELECT * FROM one""")
def s8_history_sink(spark, d):
    """Two runs appended to one history dataset, read back."""
    path = _scratch(spark, "history")
    for _ in range(2):
        _sinks.append_history(_fs.flagship_report(spark, d), path)
    return _sinks.read_history(spark, path).select("total", "passed", "failed", "critical", "high")


_S9_COUNTS = [
    ("lineitem_required", "SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL "
     "OR l_suppkey IS NULL OR l_returnflag IS NULL OR l_returnflag = ''"),
    ("lineitem_order_fk", "SELECT count(*) FROM lineitem l WHERE l.l_orderkey IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"),
    ("lineitem_unique_line", "SELECT COALESCE(SUM(c), 0) FROM (SELECT count(*) c FROM lineitem "
     "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    ("customer_name_unique", "SELECT COALESCE(SUM(c), 0) FROM (SELECT count(*) c FROM customer "
     "WHERE c_name IS NOT NULL GROUP BY c_name HAVING count(*) > 1)"),
]


def _s9_oracle() -> str:
    member_rules = {n for n, _ in _S9_COUNTS}
    parts = [f"SELECT '{n}' AS rule_name, CAST(({sql}) AS BIGINT) AS violation_rows"
             for n, kind, sev, sql in _fs.FLAGSHIP_COUNTS_SQL if n not in member_rules]
    parts += [f"SELECT '{n}', CAST(({sql}) AS BIGINT)" for n, sql in _S9_COUNTS]
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(parts) + "\n) v WHERE violation_rows > 0"


@register("s9_violation_sink", _s9_oracle())
def s9_violation_sink(spark, d):
    """Every violating row of every failed rule (duplicates: all member rows), written and counted back."""
    rep = _fs.flagship_report(spark, d)
    path = _scratch(spark, "violations")
    _sinks.write_violations(rep, path)
    return (spark.read.parquet(path).groupBy("rule_name")
            .agg(F.count(F.lit(1)).cast("bigint").alias("violation_rows")))


# ====================================================== suite behaviours
# The flagship rules plus one failing critical rule in the middle.
_CRIT_RULE = {"name": "orders_totalprice_cap", "table": "orders", "type": "range", "severity": "critical",
              "column": "o_totalprice", "max": 300000}
_CRIT_SQL = ("orders_totalprice_cap", "range", "critical",
             "SELECT count(*) FROM orders WHERE o_totalprice > 300000")
_CRIT_AT = 5


def _crit_rules():
    r = list(_fs.FLAGSHIP_RULES)
    return r[:_CRIT_AT] + [_CRIT_RULE] + r[_CRIT_AT:]


def _crit_rows_sql() -> str:
    rows = list(_fs.FLAGSHIP_COUNTS_SQL)
    rows = rows[:_CRIT_AT] + [_CRIT_SQL] + rows[_CRIT_AT:]
    parts = [f"SELECT {i} AS pos, '{n}' AS rule_name, '{k}' AS rule_type, '{s}' AS severity, "
             f"CAST({_fs._RANK[s]} AS INTEGER) AS severity_rank, CAST(({q}) AS BIGINT) = 0 AS passed, "
             f"CAST(({q}) AS BIGINT) AS violation_count" for i, (n, k, s, q) in enumerate(rows)]
    return "\nUNION ALL\n".join(parts)


@register("e3_stop_on_critical", f"""
WITH r AS ({_crit_rows_sql()}),
cut AS (SELECT min(pos) AS p FROM r WHERE severity = 'critical' AND NOT passed)
SELECT rule_name, rule_type, severity, severity_rank, passed, violation_count FROM r, cut
WHERE cut.p IS NULL OR r.pos <= cut.p""")
def e3_stop_on_critical(spark, d):
    from sieve.plans.suite import run_suite
    tables = read_tables(spark, d, _fs.FLAGSHIP_TABLES)
    return run_suite(spark, tables, _crit_rules(), {"stop_on_critical": True}).results.select(*_SUITE_COLUMNS)


@register("g4_critical_failures", f"""
WITH r AS ({_crit_rows_sql()})
SELECT rule_name, violation_count FROM r WHERE NOT passed AND severity = 'critical'""")
def g4_critical_failures(spark, d):
    from sieve.plans.suite import run_suite
    tables = read_tables(spark, d, _fs.FLAGSHIP_TABLES)
    res = run_suite(spark, tables, _crit_rules()).results
    return G.critical_failures(res).select("rule_name", "violation_count")


_BROKEN_RULES = [
    {"name": "broken_unknown_table", "type": "completeness", "table": "no_such_table", "columns": ["x"], "severity": "low"},
    {"name": "broken_unknown_column", "type": "range", "table": "orders", "column": "o_nope", "min": 0,
     "severity": "medium"},
    {"name": "broken_sql", "type": "custom_sql", "query": "SELEC * FORM orders", "severity": "high"},
    {"name": "broken_cast", "type": "range", "table": "orders", "column": "o_orderpriority", "min": 0, "severity": "low"},
]


@register("e4_error_isolation", f"""
SELECT rule_name, passed, violation_count, false AS has_error FROM ({_SUITE_SQL}) r
UNION ALL SELECT 'broken_unknown_table', false, CAST(0 AS BIGINT), true
UNION ALL SELECT 'broken_unknown_column', false, CAST(0 AS BIGINT), true
UNION ALL SELECT 'broken_sql', false, CAST(0 AS BIGINT), true
UNION ALL SELECT 'broken_cast', false, CAST(0 AS BIGINT), true""")
def e4_error_isolation(spark, d):
    """Rules that fail on the data give one failed result each; the other rules are untouched."""
    from sieve.plans.suite import run_suite
    tables = read_tables(spark, d, _fs.FLAGSHIP_TABLES)
    res = run_suite(spark, tables, _fs.FLAGSHIP_RULES + _BROKEN_RULES).results
    return res.select("rule_name", "passed", "violation_count", F.col("error_message").isNotNull().alias("has_error"))


# ============================================================ outliers
@register("o3_zscore_top_sample", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events WHERE value IS NOT NULL)
SELECT e.*, round((e.value - s.m) / s.sd, 4) AS zscore FROM events e, s
WHERE e.value IS NOT NULL AND abs((e.value - s.m) / s.sd) > 3
ORDER BY abs(round((e.value - s.m) / s.sd, 4)) DESC, e.event_id LIMIT 5""")
def o3_zscore_top_sample(spark, d):
    """The report's sample: the 5 strongest outliers (|z| desc, id as tie-break)."""
    v = O.zscore(_t(spark, d, "events"), "value", 3).violations
    return v.orderBy(F.abs(F.col("zscore")).desc(), F.col("event_id")).limit(5)


@register("o4_zscore_no_variance", """
SELECT 'zscore' AS method, CAST(3 AS DOUBLE) AS threshold, 'both' AS direction, CAST(count(*) AS BIGINT) AS n,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std_dev, CAST(NULL AS DOUBLE) AS q1,
       CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS iqr,
       CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound,
       'All values are equal, or there are too few to tell' AS note
FROM orders WHERE o_orderpriority IS NOT NULL""")
def o4_zscore_no_variance(spark, d):
    """A column with one value (every order has a priority -> 1.0): the check passes with a note."""
    o = _t(spark, d, "orders").select(
        F.when(F.col("o_orderpriority").isNotNull(), F.lit(1.0)).alias("has_priority"))
    return O.zscore(o, "has_priority", 3).extras["stats"]()


# ====================================================== named patterns
from sieve.functions.patterns import NAMED_PATTERNS as _NP  # noqa: E402


# Values with good and bad forms, derived from whole tables by expressions both engines read alike.
_NAMED_VALUES = {
    "email": ("customer", "c_custkey", "'user.' || c_custkey || '@' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.com' END"),
    "us_phone": ("orders", "o_orderkey", "'(' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ') ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') "
                 "|| '-' || lpad(CAST(o_orderkey % 10000 AS STRING), CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 4 END, '0')"),
    "us_zip": ("customer", "c_custkey", "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-0123' ELSE '-12' END"),
    "ca_postal": ("customer", "c_custkey", "'R' || c_custkey % 10 || 'A' || CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '  ' END "
                  "|| c_custkey % 10 || 'B' || c_custkey % 7"),
    "ssn": ("customer", "c_custkey", "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || CASE WHEN c_custkey % 5 = 2 THEN '.' ELSE '-' END || '45-' "
            "|| lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"),
    "url": ("pages", "page_id", "CASE WHEN page_id % 5 = 0 THEN replace(url, 'http', 'ftp') ELSE url END"),
    "ipv4": ("events", "event_id", "'10.' || event_id % 256 || '.' || user_id % 256 || CASE WHEN event_id % 6 = 0 THEN '' ELSE '.7' END"),
    "date_iso": ("orders", "o_orderkey", "CASE WHEN o_orderkey % 4 = 2 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/') "
                 "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"),
    "uuid": ("customer", "c_custkey", "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' "
             "|| substr(md5(c_name), 17, 4) || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE '-' || substr(md5(c_name), 21, 12) END"),
}


def _named_pattern(pattern: str, table: str, key: str, value: str) -> None:
    @register(f"p2_named_pattern_{pattern}", f"""
SELECT * FROM (SELECT {key}, {value} AS value FROM {table}) t
WHERE value IS NOT NULL AND NOT regexp_matches(value, '{_NP[pattern]}')""")
    def query(spark, d):
        return PT.pattern(_t(spark, d, table).select(key, F.expr(value).alias("value")), "value", pattern).violations


for _name, _spec in _NAMED_VALUES.items():
    _named_pattern(_name, *_spec)


_Q1_NOT_EXISTS = """
SELECT c.c_custkey, c.c_name, c.c_mktsegment FROM customer c
WHERE c.c_mktsegment = 'BUILDING' AND NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderdate >= TIMESTAMP '2000-06-01' AND o.o_custkey = c.c_custkey)"""


@register("q1_custom_sql_not_exists", _Q1_NOT_EXISTS)
def q1_custom_sql_not_exists(spark, d):
    """A user's business rule as SQL. (With NOT IN, Spark would broadcast the subquery whatever its size.)"""
    _views(spark, d, ["customer", "orders"])
    return Q.custom_sql(spark, _Q1_NOT_EXISTS).violations


from sieve.plans import catalog_more, catalog_state, catalog_tables  # noqa: E402, F401  (register further queries)
