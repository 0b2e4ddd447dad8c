"""Curation queries: gates, units, joins, panels, dedupe, parsers on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.functions import numeric, text, units
from quotaloom.operators import gates, joins, panels, setops
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import CASES, cases, rounded, table
from quotaloom.session import checkpoint_dir, spread
from quotaloom.sources import sinks, tables

# ---------------------------------------------------------------- gates

WINDOWS = {"F": (3.0, 25.0), "O": (1.0, 20.0)}
RULES = gates.GateRules(
    windows=WINDOWS, media=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), name_tokens=("000007", "000013"),
    numeric={"o_totalprice": (1000.0, 400000.0)})


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("input_row"), F.concat(F.lit("E"), F.pmod("o_custkey", F.lit(700))).alias("entity"),
        F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("structure"),
        (F.col("o_totalprice") > 20000).alias("structure_ok"),
        F.format_string("Customer#%09d", F.col("o_custkey")).alias("entity_name"),
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate").cast("string")).alias("species"),
        F.col("o_orderstatus").alias("endpoint"), F.dayofmonth("o_orderdate").cast("double").alias("duration_h"),
        F.when(F.month("o_orderdate") < 11, "true").otherwise("no").alias("identity_verified"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("medium"), F.col("o_totalprice"),
        F.lit(None).cast("string").alias("case_id"))


SUBMISSIONS = """
sub AS (SELECT o_orderkey AS input_row, concat('E', o_custkey % 700) AS entity, concat('S', CAST(floor(o_custkey / 2) AS BIGINT)) AS structure,
   o_totalprice > 20000 AS structure_ok, printf('Customer#%09d', o_custkey) AS entity_name,
   CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS VARCHAR) END AS species, o_orderstatus AS endpoint,
   CAST(day(o_orderdate) AS DOUBLE) AS duration_h, CASE WHEN month(o_orderdate) < 11 THEN 'true' ELSE 'no' END AS identity_verified,
   nullif(o_orderpriority, '5-LOW') AS medium, o_totalprice FROM orders),
reasoned AS (SELECT *, concat_ws('; ',
   CASE WHEN species IS NULL THEN 'Missing species' END,
   CASE WHEN identity_verified <> 'true' THEN 'Test-substance identity and structure not confirmed' END,
   CASE WHEN endpoint NOT IN ('F', 'O') THEN 'Unsupported endpoint' END,
   CASE WHEN endpoint IN ('F', 'O') AND NOT ((endpoint = 'F' AND duration_h BETWEEN 3 AND 25) OR (endpoint = 'O' AND duration_h BETWEEN 1 AND 20)) THEN 'Duration outside endpoint window' END,
   CASE WHEN NOT structure_ok THEN 'No fixed-composition, carbon-containing molecular representation' END,
   CASE WHEN regexp_matches(entity_name, '000007|000013') THEN 'Unresolved or variable-composition test substance' END,
   CASE WHEN medium NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'Unsupported medium; use freshwater or culture codes' END,
   CASE WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN 'Invalid numeric value: o_totalprice' END) AS r0 FROM sub),
ok AS (SELECT * FROM reasoned WHERE r0 = ''),
con AS (SELECT entity, count(DISTINCT structure) > 1 AS conflict FROM ok GROUP BY entity),
sh AS (SELECT structure, count(DISTINCT entity) AS ids_sharing_representation FROM ok GROUP BY structure),
gated AS (SELECT r.*, CASE WHEN coalesce(conflict, false) THEN 'Inconsistent identity mapping; merge aliases or correct the structure' ELSE r0 END AS rejection_reason,
   coalesce(ids_sharing_representation, 0) AS ids FROM reasoned r LEFT JOIN con USING (entity) LEFT JOIN sh USING (structure))
"""


@query("gate_rejected", f"WITH {SUBMISSIONS} SELECT input_row, entity, rejection_reason FROM gated WHERE rejection_reason <> ''")
def gate_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return gates.prepare_inputs(submissions(spark, sf), RULES)[1].select("input_row", "entity", "rejection_reason")


@query("gate_accepted", f"""WITH {SUBMISSIONS} SELECT concat('row-', input_row) AS case_id, entity, entity_name, duration_h, medium,
  CAST(ids AS BIGINT) AS ids_sharing_representation FROM gated WHERE rejection_reason = ''""")
def gate_accepted(spark: SparkSession, sf: str) -> DataFrame:
    accepted = gates.prepare_inputs(submissions(spark, sf), RULES)[0]
    return accepted.select("case_id", "entity", "entity_name", "duration_h", "medium", "ids_sharing_representation")


@query("first_reason", """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_totalprice > 300000 THEN 'large' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'low' END) AS reason FROM orders""")
def first_reason(spark: SparkSession, sf: str) -> DataFrame:
    rules = [(F.col("o_orderstatus") == "P", "open"), (F.col("o_totalprice") > 300000, "large"),
             (F.col("o_orderpriority") == "5-LOW", "low")]
    return table(spark, sf, "orders").select("o_orderkey", gates.first_reason(rules).alias("reason"))


TRIGGERS = {"salt_like": "o_orderpriority = '5-LOW'", "inorganic": "o_totalprice > 200000", "ambiguous": "o_orderstatus = 'P'"}


@query("rejection_categories", """WITH t AS (SELECT o_custkey, o_orderpriority = '5-LOW' AS salt_like, o_totalprice > 200000 AS inorganic, o_orderstatus = 'P' AS ambiguous FROM orders)
SELECT CASE WHEN ambiguous THEN 'ambiguous' WHEN inorganic THEN 'inorganic' WHEN salt_like THEN 'salt_like' ELSE 'other_scope_excluded' END AS rejection_category,
  count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM t GROUP BY ALL""")
def rejection_categories(spark: SparkSession, sf: str) -> DataFrame:
    rules = [(F.expr(c), name) for name, c in TRIGGERS.items()]
    cat = gates.last_category(rules, "other_scope_excluded").alias("rejection_category")
    return table(spark, sf, "orders").groupBy(cat).agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_entities"))


@query("trigger_counts", """WITH t AS (SELECT o_custkey, o_orderpriority = '5-LOW' AS salt_like, o_totalprice > 200000 AS inorganic, o_orderstatus = 'P' AS ambiguous FROM orders),
l AS (SELECT 'salt_like' AS trigger, o_custkey FROM t WHERE salt_like UNION ALL SELECT 'inorganic', o_custkey FROM t WHERE inorganic
      UNION ALL SELECT 'ambiguous', o_custkey FROM t WHERE ambiguous UNION ALL SELECT 'unique_total', o_custkey FROM t)
SELECT trigger, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM l GROUP BY trigger""")
def trigger_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", *[F.expr(c).alias(k) for k, c in TRIGGERS.items()])
    return setops.trigger_counts(rows, "o_custkey", list(TRIGGERS), "unique_total")


@query("data_flow", """WITH s AS (SELECT o_custkey, CASE WHEN o_totalprice <= 200000 AND o_orderstatus <> 'P' THEN 'scoreable'
    WHEN o_totalprice > 200000 THEN 'rejected' ELSE 'no_target' END AS subset FROM orders)
SELECT subset, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM s GROUP BY subset
UNION ALL SELECT 'all', count(*), count(DISTINCT o_custkey) FROM s""")
def data_flow(spark: SparkSession, sf: str) -> DataFrame:
    bad, target = F.col("o_totalprice") > 200000, F.col("o_orderstatus") != "P"
    return setops.data_flow(table(spark, sf, "orders"), "o_custkey", {
        "scoreable": ~bad & target, "rejected": bad, "no_target": ~bad & ~target}, "all")


@query("coerce_bool", """SELECT l_partkey, bool_or(l_tax > 0.04) AS any_flag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_true
FROM lineitem GROUP BY l_partkey""")
def coerce_bool(spark: SparkSession, sf: str) -> DataFrame:
    as_text = F.when(F.col("l_linestatus") == "F", " Yes ").otherwise("0")
    flag = F.when(F.col("l_tax") > 0.04, "1").otherwise("FALSE")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.bool_or(numeric.coerce_bool(flag)).alias("any_flag"),
        F.count_if(numeric.coerce_bool(as_text)).alias("n_true"))


@query("missing_counts", """SELECT o_orderkey, CAST((o_orderstatus = 'P')::INT + (o_orderpriority = '5-LOW')::INT AS BIGINT) AS missing_input_count FROM orders""")
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("a"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("b"))
    return rows.select("o_orderkey", numeric.missing_count(["a", "b"]).alias("missing_input_count"))


@query("missingness_profile", """SELECT o_orderkey, 'missing' AS medium, (o_orderstatus = 'P')::INT::DOUBLE AS ctx_missing_a, (o_orderpriority = '5-LOW')::INT::DOUBLE AS ctx_missing_b FROM orders""")
def missingness_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("medium"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("a"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("b"))
    return gates.missingness_frame(rows, ["o_orderkey"], ["medium"], ["a", "b"])


@query("profile_sizes", """SELECT 'full_input' AS profile, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM orders UNION ALL
SELECT 'without_price', count(*), 2 FROM orders UNION ALL SELECT 'observed_only', count(*) FILTER (WHERE o_orderstatus <> 'P'), 3 FROM orders""")
def profile_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    made = gates.profiles(rows, {"without_price": ["o_totalprice"]}, {"observed_only": F.col("o_orderstatus") != "P"})
    widths = F.create_map(*[F.lit(v) for k, d in made.items() for v in (k, len(d.columns))])
    stacked = gates.stack_profiles(made)
    return stacked.groupBy("profile").agg(F.count("*").alias("n_rows")).select(
        "profile", "n_rows", widths[F.col("profile")].cast("long").alias("n_columns"))


@query("source_family", """SELECT doc_id, CASE WHEN (a OR d) AND NOT c THEN 'adopted_source' WHEN a AND c THEN 'mixed_source' ELSE 'decision' END AS source_family,
  array_to_string(regexp_extract_all(text, '(en[a-z]{2})'), '; ') AS reference_codes
FROM (SELECT doc_id, text, regexp_matches(text, '(?i)license') AS a, regexp_matches(text, '(?i)copyright') AS d, regexp_matches(text, '(?i)en[a-z]{2}') AS c FROM documents)""")
def source_family(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", gates.source_family(t, "en[a-z]{2}", "license", "copyright").alias("source_family"),
        gates.reference_codes(t, "en[a-z]{2}").alias("reference_codes"))


@query("row_flags", """SELECT doc_id, regexp_matches(t, '(?i)(^|[^a-z])und([^a-z]|$)') AS exclude_keyword_flag, regexp_matches(t, '(?i)(^|[^a-z])the([^a-z]|$)') AS include_keyword_flag,
  contains(lower(source), 'b') AS acceptable FROM (SELECT doc_id, source, concat_ws(' ', coalesce(text, ''), coalesce(source, '')) AS t FROM documents)""")
def row_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.row_flags(table(spark, sf, "documents"), ["text", "source"], "(^|[^a-z])und([^a-z]|$)", "(^|[^a-z])the([^a-z]|$)")
    return rows.select("doc_id", "exclude_keyword_flag", "include_keyword_flag",
                       F.lower("source").contains("b").alias("acceptable"))


# ---------------------------------------------------------------- units and text

@query("unit_conversion", """WITH u AS (SELECT doc_id, n_chars::DOUBLE AS v, CASE lang WHEN 'en' THEN 'AI  mg/L' WHEN 'de' THEN 'µmol / L' WHEN 'fr' THEN 'ug/l' ELSE 'furlong' END AS unit,
   CASE lang WHEN 'en' THEN 'd' WHEN 'de' THEN ' Weeks' WHEN 'fr' THEN 'min' ELSE 'x' END AS du, 100.0::DOUBLE + doc_id AS mw FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(translate(lower(trim(unit)), 'µμ³', 'uu3'), '^ai\\s+', ''), '\\s+', '', 'g') AS unit,
  round(CASE du WHEN 'd' THEN v * 24 WHEN ' Weeks' THEN v * 168 WHEN 'min' THEN v / 60 END, 6) AS hours,
  round(log10(CASE unit WHEN 'AI  mg/L' THEN v * 1e-3 / mw WHEN 'µmol / L' THEN v * 1e-6 WHEN 'ug/l' THEN v * 1e-6 / mw END), 6) AS log_molar FROM u""")
def unit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    unit = (F.when(lang == "en", "AI  mg/L").when(lang == "de", "µmol / L").when(lang == "fr", "ug/l").otherwise("furlong"))
    span = F.when(lang == "en", "d").when(lang == "de", " Weeks").when(lang == "fr", "min").otherwise("x")
    value, weight = F.col("n_chars").cast("string"), (F.lit(100.0) + F.col("doc_id")).cast("string")
    return rounded(table(spark, sf, "documents").select(
        "doc_id", units.clean_unit(unit).alias("unit"), units.exposure_hours(value, span).alias("hours"),
        units.measured_target(value, unit, weight).alias("log_molar")))


@query("concentration_outputs", """SELECT p_partkey, round(-3 + log10(p_retailprice) + 3.0, 6) + 0 AS log_mg_l, round(pow(10, -3 + log10(p_retailprice) + 3.0), 4) AS mg_l FROM part""")
def concentration_outputs(spark: SparkSession, sf: str) -> DataFrame:
    log_mg, value = units.concentration_outputs(F.lit(-3.0), F.col("p_retailprice"))
    return rounded(table(spark, sf, "part").select("p_partkey", log_mg.alias("log_mg_l"), F.round(value, 4).alias("mg_l")))


@query("key_normalisation", """SELECT s_suppkey, regexp_replace(regexp_replace(trim(s_name), '^(\\d+)\\.0+$', '\\1'), '[^0-9]', '', 'g') AS digits,
  lower(regexp_replace(trim(lower(regexp_replace(s_name, '[^a-zA-Z0-9]+', '_', 'g')), '_'), 'x', 'x')) AS token,
  trim(replace(s_name, '#', '')) AS plain FROM supplier""")
def key_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, sf, "supplier").select(
        "s_suppkey", text.normalise_key(name).alias("digits"), text.slug(name).alias("token"),
        text.strip_hyphens(F.replace(name, F.lit("#"), F.lit("-"))).alias("plain"))


@query("duration_text", """SELECT doc_id, CASE lang WHEN 'en' THEN n_chars * 24.0::DOUBLE WHEN 'de' THEN n_chars::DOUBLE END AS hours FROM documents""")
def duration_text(spark: SparkSession, sf: str) -> DataFrame:
    lang, k = F.col("lang"), F.col("n_chars").cast("string")
    spelled = (F.when(lang == "en", F.concat(F.lit(" "), k, F.lit(" Days"))).when(lang == "de", F.concat(k, F.lit("hours")))
               .otherwise(F.concat(k, F.lit(" - 96 h"))))
    return table(spark, sf, "documents").select("doc_id", text.parse_duration_hours(spelled).alias("hours"))


@query("numeric_labels", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS value, o_orderstatus = 'P' AS censored FROM orders""")
def numeric_labels(spark: SparkSession, sf: str) -> DataFrame:
    price = F.format_string("%.2f", F.col("o_totalprice"))
    label = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("< "), price)).otherwise(F.concat(F.lit("$ "), price, F.lit(" each")))
    value, censored = text.parse_numeric_label(label)
    return table(spark, sf, "orders").select("o_orderkey", value.alias("value"), censored.alias("censored"))


@query("effect_values", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN round(l_extendedprice, 2) WHEN 'N' THEN round(l_quantity, 2) END AS value,
  CASE l_returnflag WHEN 'A' THEN 'mg/L' WHEN 'N' THEN 'µg/L' ELSE 'mg/L' END AS unit, l_returnflag = 'R' AS is_censored FROM lineitem""")
def effect_values(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    spelled = (F.when(flag == "A", F.concat(F.format_number("l_extendedprice", 2), F.lit(" mg/L")))
               .when(flag == "N", F.concat(F.format_string("%.2f", F.col("l_quantity")), F.lit("ug/l nominal")))
               .otherwise(F.concat(F.lit("ca. "), F.format_string("%.2f", F.col("l_quantity")), F.lit(" mg/L"))))
    rows = spread(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.parse_effect_value(spelled).alias("_v")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_v.*")


@query("primary_class", """SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'ECONOMY' WHEN contains(p_type, 'PROMO') THEN 'PROMO' WHEN contains(p_type, 'STANDARD') THEN 'STANDARD' ELSE 'other' END AS primary_class FROM part""")
def primary_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", text.primary_class(F.col("p_type"), ["ECONOMY", "PROMO", "STANDARD"]).alias("primary_class"))


@query("url_parts", """SELECT page_id, nullif(regexp_extract(url, 'https?://[^/]+/([^/?]+)', 1), '') AS first_segment, nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS page FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", text.url_part(F.col("url"), r"https?://[^/]+/([^/?]+)").alias("first_segment"),
        text.url_part(F.col("url"), r"page=(\d+)").alias("page"))


@query("stable_seeds", """SELECT s_suppkey, CAST(concat('0x', substr(sha256(concat_ws('|', 'panel', s_name)), 1, 8)) AS BIGINT) AS seed FROM supplier""")
def stable_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", numeric.stable_seed("panel", F.col("s_name")).alias("seed"))


@query("csv_escape", """SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*[=+\\-@]') THEN concat('''', text) ELSE text END AS text, n_chars FROM documents""")
def csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    return text.escape_formulas(table(spark, sf, "documents").select("doc_id", "text", "n_chars"))


@query("hashed_fingerprints")
def hashed_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Set bits of every whole document."""
    bits = text.hashed_fingerprint(F.col("text"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bits.alias("bits")).withColumn("n_bits", F.size("bits"))


@query("legacy_renames", """SELECT o_orderkey, o_totalprice AS score, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS method, o_orderpriority AS note FROM orders""")
def legacy_renames(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("old_score"), F.col("o_orderstatus").alias("old_method"),
        F.col("o_orderpriority").alias("note"))
    return sinks.rename_legacy(rows, {"old_score": "score", "old_method": "method"}, {"P": "pending", "F": "final"}, ["method"])


# ---------------------------------------------------------------- html

@query("html_anchors", """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
   regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages)
SELECT page_id, CAST(i AS BIGINT) AS pos, trim(h[i + 1]) AS href, trim(regexp_replace(regexp_replace(l[i + 1], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS label
FROM (SELECT *, unnest(range(len(h))) AS i FROM a)""")
def html_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.anchors(table(spark, sf, "pages"), "page_id", "html")


@query("html_field_pairs")
def html_field_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Heading and first paragraph of every article, by nesting."""
    return tables.field_pairs(table(spark, sf, "pages"), "page_id", "html", "article", "h1", "p")


@query("archive_listing", """WITH m AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages),
l AS (SELECT page_id, i, trim(replace(h[i + 1], '&amp;', '&')) AS path FROM (SELECT *, unnest(range(len(h))) AS i FROM m)),
f AS (SELECT page_id, path, min(i) AS pos FROM l GROUP BY ALL)
SELECT page_id, CAST(pos AS BIGINT) AS pos, path, string_split(regexp_replace(path, '/+$', ''), '/')[-1] AS basename, ends_with(path, '/') AS is_directory FROM f""")
def archive_listing(spark: SparkSession, sf: str) -> DataFrame:
    return tables.zip_listing(table(spark, sf, "pages"), "page_id", "html", 'href="([^"]+)"')


@query("result_blocks", """WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) > 60 THEN 'Duration' WHEN role = 'user' THEN 'Details' ELSE 'Effect' END AS label, text FROM conversations),
c AS (SELECT *, sum((label = 'Duration')::INT) OVER w AS b, sum((label = 'Details')::INT) OVER w AS s FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, label, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(b AS BIGINT) AS block, arg_max(text, turn) FILTER (WHERE label = 'Duration') AS "Duration", arg_max(text, turn) FILTER (WHERE label = 'Effect') AS "Effect"
FROM c WHERE b > 0 AND label <> 'Details' GROUP BY conv_id, b, s
HAVING count(*) FILTER (WHERE label = 'Duration') > 0 AND nullif(trim(arg_max(text, turn) FILTER (WHERE label = 'Effect')), '') IS NOT NULL
   AND nullif(trim(arg_max(text, turn) FILTER (WHERE label = 'Duration')), '') IS NOT NULL""")
def result_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    label = (F.when((F.col("role") == "user") & (F.length("text") > 60), "Duration")
             .when(F.col("role") == "user", "Details").otherwise("Effect"))
    fields = rows.select("conv_id", "turn", label.alias("label"), F.col("text").alias("value"))
    return panels.result_blocks(fields, "conv_id", "turn", "label", "value", "Duration", ["Effect"], ["Details"],
                                ["Duration", "Effect"])


@query("first_nonempty_fields", """SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS question,
  arg_min(text, turn) FILTER (WHERE role IN ('assistant', 'system') AND text <> '') AS answer FROM conversations GROUP BY conv_id""")
def first_nonempty_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return panels.first_nonempty(rows, "conv_id", "turn", "role", "text", {
        "question": ["User"], "answer": ["assistant", "system"]})


# ---------------------------------------------------------------- joins

@query("star_assembly", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, n_name, r_name, p_brand, o_orderstatus
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag IN ('A', 'R') AND o_orderstatus = 'F' AND p_size <= 25""")
def star_assembly(spark: SparkSession, sf: str) -> DataFrame:
    def t(name): return table(spark, sf, name)
    joined = joins.star(t("lineitem"), [
        (t("orders"), "l_orderkey", "o_orderkey"), (t("part"), "l_partkey", "p_partkey"),
        (t("supplier"), "l_suppkey", "s_suppkey"), (t("nation"), "s_nationkey", "n_nationkey"),
        (t("region"), "n_regionkey", "r_regionkey")],
        F.col("l_returnflag").isin("A", "R") & (F.col("o_orderstatus") == "F") & (F.col("p_size") <= 25))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name", "n_name", "r_name",
                         "p_brand", "o_orderstatus")


def catalog_and_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    catalog = part.select(
        F.concat(F.lit("ID"), F.col("p_size")).alias("cid"), F.concat(F.lit("00-"), F.col("p_brand")).alias("ckey"),
        F.when(F.col("p_retailprice") > 1000, F.col("p_name")).otherwise("").alias("structure"), F.col("p_type").alias("weight"),
        F.col("p_partkey").alias("seq"))
    index = part.select(F.col("p_partkey").alias("row"), F.concat(F.lit("ID"), F.col("p_size") + 20).alias("sid"),
                        F.concat(F.lit("00"), F.col("p_brand")).alias("skey"))
    return catalog, index


@query("fill_cascade", """WITH cat AS (SELECT concat('ID', p_size) AS cid, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, CASE WHEN p_retailprice > 1000 THEN p_name ELSE '' END AS structure, p_type AS weight, p_partkey AS seq FROM part),
idx AS (SELECT p_partkey AS row, concat('ID', p_size + 20) AS sid, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part),
b1 AS (SELECT cid, structure, weight, row_number() OVER (PARTITION BY cid ORDER BY structure = '', CAST(seq AS VARCHAR)) AS rn FROM cat),
b2 AS (SELECT concat('00', digits) AS k, structure, weight, row_number() OVER (PARTITION BY digits ORDER BY structure = '', CAST(seq AS VARCHAR)) AS rn FROM cat),
j AS (SELECT i.row, nullif(b1.structure, '') AS s1, nullif(b1.weight, '') AS w1, nullif(b2.structure, '') AS s2, nullif(b2.weight, '') AS w2
      FROM idx i LEFT JOIN b1 ON b1.cid = i.sid AND b1.rn = 1 LEFT JOIN b2 ON b2.k = concat('00', i.digits) AND b2.rn = 1)
SELECT row, coalesce(s1, s2, '') AS structure, coalesce(w1, w2, '') AS weight, coalesce(s1, w1, s2, w2) IS NOT NULL AS resolved,
  CASE WHEN (s1 IS NULL AND s2 IS NOT NULL) OR (w1 IS NULL AND w2 IS NOT NULL) THEN 'by_key' WHEN coalesce(s1, w1) IS NOT NULL THEN 'by_id' ELSE '' END AS resolution_source FROM j""")
def fill_cascade(spark: SparkSession, sf: str) -> DataFrame:
    catalog, index = catalog_and_index(spark, sf)
    out = joins.resolve_index(index, catalog, ["structure", "weight"], [
        ("by_id", F.col("sid"), F.col("cid")),
        ("by_key", text.normalise_key(F.col("skey")), text.normalise_key(F.col("ckey")))], "structure", ["seq"])
    return out.select("row", "structure", "weight", "resolved", "resolution_source")


@query("catalog_filter", """WITH t AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49), u AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000)
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM t) OR s_nationkey IN (SELECT s_nationkey FROM u)""")
def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")
    targets = table(spark, sf, "lineitem").where("l_quantity > 49").select(
        F.col("l_suppkey"), F.lit(None).cast("int").alias("nation")).unionByName(
        supplier.where("s_acctbal > 9000").select(F.lit(None).cast("long").alias("l_suppkey"), F.col("s_nationkey").alias("nation")))
    return joins.catalog_semi_join(supplier, targets, {
        "id": (F.col("s_suppkey").cast("string"), F.col("l_suppkey").cast("string")),
        "nation": (F.col("s_nationkey").cast("string"), F.col("nation").cast("string"))}, ["s_suppkey"]).select("s_suppkey", "s_name")


@query("feature_fallback", """WITH f AS (SELECT p_partkey, p_size, p_brand, CASE WHEN p_retailprice > 1200 THEN p_retailprice END AS mech_price FROM part),
a AS (SELECT p_size, mech_price, row_number() OVER (PARTITION BY p_size ORDER BY CAST(p_partkey AS VARCHAR)) AS rn FROM f),
b AS (SELECT p_brand, mech_price, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_partkey AS VARCHAR)) AS rn FROM f)
SELECT d.p_partkey, round(CASE WHEN a.mech_price IS NULL THEN b.mech_price ELSE a.mech_price END, 6) AS mech_price FROM part d
LEFT JOIN a ON a.p_size = d.p_size AND a.rn = 1 LEFT JOIN b ON b.p_brand = d.p_brand AND b.rn = 1""")
def feature_fallback(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    features = part.withColumn("mech_price", F.when(F.col("p_retailprice") > 1200, F.col("p_retailprice")))
    out = joins.attach_with_fallback(
        part.select("p_partkey", F.col("p_size").alias("sz"), F.col("p_brand").alias("br")), features, ["mech_price"],
        (F.col("sz").cast("string"), F.col("p_size").cast("string")), (F.col("br"), F.col("p_brand")), ["p_partkey"])
    return rounded(out.select("p_partkey", "mech_price"))


@query("feature_merge", """WITH a AS (SELECT o_custkey AS id, nullif(o_orderpriority, '5-LOW') AS k, max(o_totalprice) AS mech_a FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
b AS (SELECT o_custkey AS id, nullif(o_orderpriority, '5-LOW') AS k, min(o_totalprice) AS mech_b FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
c AS (SELECT o_custkey AS id, nullif(o_orderpriority, '5-LOW') AS k, count(*)::DOUBLE AS mech_c FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
ab AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.k, b.k) AS k, mech_a, mech_b FROM a FULL JOIN b ON a.id IS NOT DISTINCT FROM b.id AND a.k IS NOT DISTINCT FROM b.k)
SELECT coalesce(ab.id, c.id) AS id, coalesce(ab.k, c.k) AS k, mech_a, mech_b, mech_c,
  CAST((mech_a IS NOT NULL)::INT + (mech_b IS NOT NULL)::INT + (mech_c IS NOT NULL)::INT AS BIGINT) AS feature_count
FROM ab FULL JOIN c ON ab.id IS NOT DISTINCT FROM c.id AND ab.k IS NOT DISTINCT FROM c.k""")
def feature_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("k"),
                                             "o_totalprice", "o_orderstatus")
    def part(status, agg): return rows.where(F.col("o_orderstatus") == status).groupBy("id", "k").agg(agg)
    return joins.merge_feature_tables([
        part("F", F.max("o_totalprice").alias("mech_a")), part("O", F.min("o_totalprice").alias("mech_b")),
        part("P", F.count("*").cast("double").alias("mech_c"))], ["id", "k"])


@query("existence_flags", f"""WITH {CASES}, k AS (SELECT DISTINCT endpoint, source_id FROM cases WHERE study_year = 1995)
SELECT case_id, k.endpoint IS NOT NULL AS known FROM cases c LEFT JOIN k ON c.endpoint = k.endpoint AND c.source_id = k.source_id""")
def existence_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    return joins.membership_flag(rows, rows.where("study_year = 1995"), ["endpoint", "source_id"], "known").select("case_id", "known")


@query("identity_overlap", """WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45)
SELECT 'part' AS key, (SELECT count(DISTINCT part) FROM a) AS n_train, (SELECT count(DISTINCT part) FROM b) AS n_panel, (SELECT count(*) FROM (SELECT part FROM a INTERSECT SELECT part FROM b)) AS n_shared
UNION ALL SELECT 'supp', (SELECT count(DISTINCT supp) FROM a), (SELECT count(DISTINCT supp) FROM b), (SELECT count(*) FROM (SELECT supp FROM a INTERSECT SELECT supp FROM b))""")
def identity_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    keys = {"part": F.col("l_partkey").cast("string"), "supp": F.col("l_suppkey").cast("string")}
    return joins.identity_overlap(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O' AND l_quantity > 45"), keys)


@query("metadata_recovery", """WITH c AS (SELECT o_orderkey AS case_id, coalesce(o_orderpriority, '') AS a, coalesce(nullif(o_orderstatus, 'P'), '') AS b FROM orders),
m AS (SELECT DISTINCT c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat, CASE c_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS a,
   CASE WHEN c_acctbal > 5000 THEN 'F' WHEN c_acctbal > 0 THEN 'O' ELSE '' END AS b FROM customer),
p AS (SELECT case_id, seg, nat FROM c LEFT JOIN m ON c.a = m.a AND c.b = m.b)
SELECT case_id, coalesce(string_agg(DISTINCT seg, ';' ORDER BY seg), '') AS seg, coalesce(string_agg(DISTINCT nat, ';' ORDER BY nat), '') AS nat FROM p GROUP BY case_id""")
def metadata_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("a"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("b"))
    bucket = F.pmod("c_nationkey", F.lit(5))
    a = (F.when(bucket == 0, "1-URGENT").when(bucket == 1, "2-HIGH").when(bucket == 2, "3-MEDIUM")
         .when(bucket == 3, "4-NOT SPECIFIED").otherwise("5-LOW"))
    b = F.when(F.col("c_acctbal") > 5000, "F").when(F.col("c_acctbal") > 0, "O")
    meta = table(spark, sf, "customer").select(a.alias("a"), b.alias("b"), F.col("c_mktsegment").alias("seg"),
                                               F.col("c_nationkey").cast("string").alias("nat"))
    return joins.recover_metadata(rows, meta, ["a", "b"], "case_id", ["seg", "nat"])


@query("reconciliation", """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 5000),
j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE kb IS NULL) AS left_only, count(*) FILTER (WHERE ka IS NULL) AS right_only,
  count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa <> sb) AS n_different FROM j""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    other = rows.where("o_totalprice > 5000").withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")))
    return joins.reconcile(rows.where("o_orderstatus <> 'P'"), other, "o_orderkey", ["o_orderstatus"], ["o_totalprice"])


@query("lineage_fill", """WITH k AS (SELECT p_brand, CASE WHEN count(DISTINCT p_size) = 1 THEN max(p_size) END AS sz, CASE WHEN min(p_type) = max(p_type) THEN max(p_type) END AS ty FROM part GROUP BY p_brand),
d AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_size END AS p_size, CASE WHEN p_size < 40 THEN p_type END AS p_type FROM part)
SELECT p_partkey, coalesce(p_size, sz) AS p_size, coalesce(p_type, ty) AS p_type,
  CAST((p_size IS NULL AND sz IS NOT NULL)::INT + (p_type IS NULL AND ty IS NOT NULL)::INT AS BIGINT) AS filled_from_reference FROM d LEFT JOIN k USING (p_brand)""")
def lineage_fill(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    lookup = joins.unambiguous_lookup(part, "p_brand", ["p_size", "p_type"])
    holes = part.withColumns({"p_size": F.when(F.col("p_size") > 25, F.col("p_size")),
                              "p_type": F.when(part["p_size"] < 40, F.col("p_type"))})
    return joins.fill_from_lookup(holes, lookup, "p_brand", ["p_size", "p_type"]).drop("p_brand")


@query("complete_endpoints", f"""WITH {CASES}, e AS (SELECT DISTINCT entity FROM cases), d AS (SELECT unnest(['A', 'N', 'R', 'X']) AS endpoint),
k AS (SELECT entity, endpoint, count(*) AS case_count FROM cases GROUP BY ALL)
SELECT e.entity, d.endpoint, case_count FROM e CROSS JOIN d LEFT JOIN k ON k.entity = e.entity AND k.endpoint = d.endpoint""")
def complete_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    counts = cases(spark, sf).groupBy("entity", "endpoint").agg(F.count("*").alias("case_count"))
    return joins.complete_categories(counts, ["entity"], "endpoint", ["A", "N", "R", "X"])


# ---------------------------------------------------------------- panels

@query("case_panel", """WITH r AS (SELECT p_brand AS b, l_returnflag AS f, l_extendedprice AS x, l_quantity AS q, p_type AS ty, l_suppkey AS su, l_orderkey AS doc, l_tax > 0.07 AS flag FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT b, f, ty, row_number() OVER (PARTITION BY b, f ORDER BY k DESC, ty) AS rn FROM (SELECT b, f, ty, count(*) AS k FROM r GROUP BY b, f, ty)),
g AS (SELECT b, f, round(median(x), 6) AS v, round(median(q), 6) AS duration, count(*) AS case_row_count, round(min(x), 6) AS v_min, round(max(x), 6) AS v_max,
  bool_or(flag) AS std, count(DISTINCT doc) AS document_count, string_agg(DISTINCT CAST(su AS VARCHAR), '; ' ORDER BY CAST(su AS VARCHAR)) AS suppliers,
  round(max(x) - min(x), 6) AS case_spread FROM r GROUP BY b, f)
SELECT g.b AS p_brand, g.f AS l_returnflag, v, duration, case_row_count, v_min, v_max, std, document_count, m.ty AS p_type, suppliers, case_spread
FROM g JOIN m ON g.b = m.b AND g.f = m.f WHERE m.rn = 1""")
def case_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", "l_returnflag", F.col("l_extendedprice").alias("v"), "l_quantity", "p_type", "l_suppkey", "l_orderkey",
        (F.col("l_tax") > 0.07).alias("std"))
    out = panels.case_panel(rows, ["p_brand", "l_returnflag"], "v", {"duration": "l_quantity"}, ["p_type"],
                            {"suppliers": "l_suppkey"}, "l_orderkey", ["std"])
    return rounded(out)


@query("mode_median_meta", """WITH m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type)),
k AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rn FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY p_brand, p_name)),
d AS (SELECT p_brand, median(p_size::DOUBLE) AS ms, median(p_retailprice) AS mp FROM part GROUP BY p_brand)
SELECT d.p_brand, round(ms, 6) AS p_size, round(mp, 6) AS p_retailprice, m.p_type, k.p_name FROM d JOIN m ON d.p_brand = m.p_brand JOIN k ON k.p_brand = d.p_brand WHERE m.rn = 1 AND k.rn = 1""")
def mode_median_meta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panels.species_meta(table(spark, sf, "part"), ["p_brand"], ["p_type", "p_name"], ["p_size", "p_retailprice"]))


@query("ordinal_pivot", """WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'agonist' WHEN 'O' THEN 'antagonist' END AS m,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.25 END::DOUBLE AS v FROM orders)
SELECT o_custkey, max(v) FILTER (WHERE m = 'agonist') AS agonist, max(v) FILTER (WHERE m = 'antagonist') AS antagonist FROM s WHERE m IS NOT NULL GROUP BY o_custkey""")
def ordinal_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return panels.ordinal_pivot(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority",
                                {"f": "agonist", "o": "antagonist"}, {"1-urgent": 1.0, "2-high": 0.75, "3-medium": 0.5, "5-low": 0.25})


@query("signal_table", """SELECT l_partkey, round(max(abs(l_discount - 0.05)), 6) AS a_max_abs, round(max(abs(l_tax - 0.03)), 6) AS b_max_abs,
  round((sum(abs(l_discount - 0.05)) + sum(abs(l_tax - 0.03))) / (2 * count(*)), 6) AS mean_abs, round(min(l_quantity), 6) AS c_min, round(max(l_extendedprice), 6) AS d_max,
  round(median(l_quantity), 6) AS c_median, CAST((max(abs(l_discount - 0.05)) >= 0.045)::INT + (max(abs(l_tax - 0.03)) >= 0.045)::INT AS BIGINT) AS active_count FROM lineitem GROUP BY l_partkey""")
def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_discount") - 0.05).alias("a"), (F.col("l_tax") - 0.03).alias("b"),
                                               F.col("l_quantity").alias("c"), F.col("l_extendedprice").alias("d"))
    return rounded(panels.signal_table(rows, "l_partkey", ["a", "b"], "c", "d", "c", 0.045))


@query("ratio_table", """WITH f AS (SELECT p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
SELECT p_brand, round(p_retailprice / nullif(p_size - 10, 0)::DOUBLE, 6) AS hit_rate FROM f WHERE rn = 1""")
def ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("den", F.col("p_size") - 10)
    return rounded(panels.ratio_table(rows, "p_brand", "p_retailprice", "den", "hit_rate", ["p_partkey"]).select("p_brand", "hit_rate"))


@query("reference_catalog", """WITH r AS (SELECT unnest(string_split(concat_ws('; ', o_orderpriority, o_orderstatus), '; ')) AS reference_code, o_orderstatus AS fam, CAST(o_custkey AS VARCHAR) AS nm, year(o_orderdate) AS y FROM orders),
d AS (SELECT reference_code, fam, nm, min(y) AS lo, max(y) AS hi FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY reference_code, fam ORDER BY nm) AS rn FROM d)
SELECT reference_code, fam, count(*) AS n_names, CAST(min(lo) AS INTEGER) AS min_year, CAST(max(hi) AS INTEGER) AS max_year,
  string_agg(nm, '; ' ORDER BY nm) FILTER (WHERE rn <= 8) AS name_examples, reference_code AS lookup_query FROM k GROUP BY ALL""")
def reference_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.concat_ws("; ", "o_orderpriority", "o_orderstatus").alias("codes"), F.col("o_orderstatus").alias("fam"),
        F.col("o_custkey").cast("string").alias("nm"), F.year("o_orderdate").alias("y"))
    return panels.reference_catalog(rows, "codes", ["fam"], "nm", "y", "fam")


@query("extraction_queue", """WITH c AS (SELECT p_partkey, p_size, CASE WHEN p_size > 10 THEN p_retailprice END AS a, CASE WHEN p_size < 40 THEN p_retailprice * 2 END AS b, p_type <> 'ECONOMY' AS ok, p_brand = 'Brand#12' AS ov, p_size % 2 = 0 AS ind FROM part),
l AS (SELECT *, 'a' AS endpoint, a AS value FROM c WHERE a IS NOT NULL UNION ALL SELECT *, 'b', b FROM c WHERE b IS NOT NULL)
SELECT p_partkey, endpoint, round(value, 6) AS value, CASE WHEN NOT (ok AND NOT ov) THEN 'low' WHEN ind AND p_size >= 20 THEN 'high' WHEN ind THEN 'medium' ELSE 'low' END AS extraction_priority, ok AND NOT ov AS selected FROM l""")
def extraction_queue(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(size > 10, price).alias("a"), F.when(size < 40, price * 2).alias("b"), (F.col("p_type") != "ECONOMY").alias("ok"),
        (F.col("p_brand") == "Brand#12").alias("ov"), (size % 2 == 0).alias("ind"), (F.when(size >= 20, 2).otherwise(1)).alias("cnt"))
    out = panels.extraction_queue(rows, {"a": "a", "b": "b"}, "ok", "ov", "ind", "cnt")
    return rounded(out.select("p_partkey", "endpoint", "value", "extraction_priority", "selected"))


@query("best_hits", """WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey FROM c WHERE rn = 1""")
def best_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return panels.best_hit(rows, "o_custkey", F.col("o_orderstatus") == "F", [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("hash_sample", """SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS selection_key FROM customer ORDER BY selection_key, c_custkey LIMIT 100""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator itself: the limit is the requested sample size."""
    return panels.hash_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 100)


@query("present_in_all", f"WITH {CASES} SELECT entity FROM cases GROUP BY entity HAVING count(DISTINCT endpoint) = 3")
def present_in_all(spark: SparkSession, sf: str) -> DataFrame:
    return panels.present_in_all(cases(spark, sf), "entity", "endpoint", 3)


# ---------------------------------------------------------------- sets and audits

@query("dedupe_exact", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn = 1""")
def dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = rows.withColumn("order_id", F.struct("l_partkey", "l_suppkey", "l_shipdate"))
    return setops.dedupe_exact(rows, ["l_orderkey", "l_linenumber"], "order_id").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("duplicate_audit", """WITH a AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag)
SELECT 'order_line' AS "check", 'l_orderkey; l_linenumber' AS key_fields, CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
  CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS rows_in_duplicate_groups, CAST(sum(n) FILTER (WHERE n > 1) - count(*) FILTER (WHERE n > 1) AS BIGINT) AS rows_beyond_first_record FROM a
UNION ALL SELECT 'part_supplier', 'l_partkey; l_suppkey; l_returnflag', CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE n > 1), CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT),
  CAST(sum(n) FILTER (WHERE n > 1) - count(*) FILTER (WHERE n > 1) AS BIGINT) FROM b""")
def duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return setops.duplicate_audit(table(spark, sf, "lineitem"), {
        "order_line": ["l_orderkey", "l_linenumber"], "part_supplier": ["l_partkey", "l_suppkey", "l_returnflag"]})


@query("shared_entities", f"WITH {CASES} SELECT entity FROM cases WHERE split = 'F' INTERSECT SELECT entity FROM cases WHERE split = 'O'")
def shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    return setops.common_keys(rows.where("split = 'F'"), rows.where("split = 'O'"), "entity")


@query("unshared_entities", f"WITH {CASES} SELECT entity FROM cases WHERE s2 > 48 EXCEPT SELECT entity FROM cases WHERE s2 < 5")
def unshared_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases(spark, sf)
    return setops.only_left(rows.where("s2 > 48"), rows.where("s2 < 5"), "entity")


@query("feature_manifest", """SELECT 'o_orderstatus' AS "column", 'string' AS dtype, count(DISTINCT o_orderstatus) AS n_unique, 0.0::DOUBLE AS missing_fraction FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(DISTINCT o_custkey), 0.0 FROM orders
UNION ALL SELECT 'medium', 'string', count(DISTINCT nullif(o_orderpriority, '5-LOW')), round(avg((o_orderpriority = '5-LOW')::INT), 6) FROM orders""")
def feature_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("medium"))
    return rounded(setops.feature_manifest(rows))


@query("cache_upsert", """WITH u AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM u WHERE rn = 1""")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return setops.latest_per_key(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey")


def spread_labels(edges: str, rounds: int = 12) -> str:
    """Smallest label of every node after so many steps along the edges (a, b), more than the graph is wide."""
    steps = [f"both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges})", "l0 AS (SELECT DISTINCT a AS node, a AS label FROM both_ways)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT node, min(label) AS label FROM (SELECT * FROM l{k} UNION ALL SELECT b, label FROM both_ways JOIN l{k} ON node = a) GROUP BY node)")
    return ", ".join(steps)


@query("components", f"""WITH e AS (SELECT DISTINCT concat('P', l_partkey) AS a, concat('S', l_suppkey) AS b FROM lineitem), {spread_labels('e')}
SELECT node, label AS component FROM l12""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("a"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("b"))
    return setops.components(edges, "a", "b")


@query("reference_components", f"""WITH refs AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS r FROM lineitem GROUP BY l_orderkey),
e AS (SELECT DISTINCT r[1] AS a, unnest(r) AS b FROM refs), {spread_labels('e')}
SELECT l_orderkey, label AS reference_number FROM refs JOIN l12 ON node = r[1]""")
def reference_components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that share a supplier fall together; an order has a few lines, so its list of suppliers is short."""
    refs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ";").alias("refs"))
    return setops.reference_components(refs, "l_orderkey", "refs")


@query("panel_enrichment", """WITH p AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 <> 0 THEN concat(' ', CAST(o_custkey AS VARCHAR), ' ') END AS casrn,
   o_orderstatus AS chemical_name, o_totalprice / 1000 AS source_value,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'mg/L' WHEN '2-HIGH' THEN 'ug/L' WHEN '3-MEDIUM' THEN 'mM' WHEN '5-LOW' THEN 'ppb' ELSE 'drops' END AS source_unit FROM orders),
k AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_nationkey % 3 <> 0 THEN c_name WHEN c_nationkey % 2 = 0 THEN '  ' END AS dtxsid,
   CASE WHEN c_acctbal > 0 THEN c_acctbal / 10 END AS molecular_weight FROM customer),
j AS (SELECT p.*, dtxsid, molecular_weight, CASE WHEN molecular_weight IS NULL OR source_value <= 0 THEN NULL WHEN source_unit = 'mM' THEN source_value * 1e-3::DOUBLE
   WHEN source_unit = 'mg/L' THEN source_value * 1e-3::DOUBLE / molecular_weight WHEN source_unit IN ('ug/L', 'ppb') THEN source_value * 1e-6::DOUBLE / molecular_weight END AS molar
   FROM p LEFT JOIN k ON trim(casrn) = key)
SELECT row_id, dtxsid, round(molecular_weight, 6) AS molecular_weight, round(molar * 1000000, 4) AS micromolar, round(log10(molar), 6) AS log_molar,
  coalesce(nullif(trim(dtxsid), ''), casrn) AS entity FROM j""")
def panel_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.col("o_orderpriority")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("casrn"),
        F.col("o_orderstatus").alias("chemical_name"), (F.col("o_totalprice") / 1000).alias("source_value"),
        F.when(unit == "1-URGENT", "mg/L").when(unit == "2-HIGH", "ug/L").when(unit == "3-MEDIUM", "mM").when(unit == "5-LOW", "ppb").otherwise("drops").alias("source_unit"))
    catalog = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).when(F.col("c_nationkey") % 2 == 0, "  ").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10).alias("mass"))
    out = joins.enrich_panel(rows, catalog, "chemical_name", "casrn", {"dtxsid": "name", "molecular_weight": "mass"}, "source_value", "source_unit",
                             "molecular_weight", "dtxsid", "c_custkey")
    out = out.select("row_id", "dtxsid", "molecular_weight", F.round(F.col("value_molar") * 1000000, 4).alias("micromolar"), "log_molar", "entity")
    return rounded(out)


#: the same columns under other names in each market segment's files; one segment's files have no key column
SEGMENT_HEADERS = {
    "AUTOMOBILE": ("id", "structure", "name"), "BUILDING": ("DTX", "SMILES", "label"), "FURNITURE": ("ident", "SMI", "name"),
    "HOUSEHOLD": ("id", "label"), "MACHINERY": ("DTX", "SMI")}
CATALOG_COLUMNS = {"id": ("DTX", "ident"), "structure": ("SMILES", "SMI"), "name": ("label",)}


@query("catalog_union", """WITH c AS (SELECT *, concat(' ', lower(c_name)) AS key, concat('s-', c_nationkey, ' ') AS st FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
SELECT upper(trim(key)) AS id, trim(st) AS structure, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS name FROM c WHERE c_custkey % 7 <> 0""")
def catalog_union(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the customers as delimited files with other headers in each segment and reads all of them as one catalog."""
    rows = table(spark, sf, "customer").select(
        "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" "), F.lower("c_name"))).otherwise(" ").alias("key"),
        F.concat(F.lit("s-"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("st"), F.col("c_custkey").cast("string").alias("no"))
    root = f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    for segment, names in SEGMENT_HEADERS.items():
        columns = ["key", "no"] if names == ("id", "label") else ["key", "st", "no"]
        part = rows.where(F.col("c_mktsegment") == segment).select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{segment}")
    return tables.read_catalog(spark, [f"{root}/{s}" for s in SEGMENT_HEADERS], CATALOG_COLUMNS, "structure", ["id"], ["id"])


@query("release_manifest", """SELECT CAST(n_nationkey AS VARCHAR) AS nation, CAST(sum(length(line) + 1) AS BIGINT) AS bytes,
  sha256(string_agg(line || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM (SELECT *, concat_ws('|', c_custkey, c_name, c_mktsegment) AS line FROM customer)
  JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One text file for each nation, counted before it is released, and the manifest of the files."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    n, entities = rows.agg(F.count("*"), F.count_distinct("c_custkey")).first()
    root = f"{checkpoint_dir(spark)}/release-{uuid.uuid4().hex}"
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(root)
    sinks.assert_counts(spark.read.text(root).select(F.substring_index("value", "|", 1).alias("key")), "key", n, entities)
    files = sinks.release_manifest(spark, root, "part-*")
    return files.select(F.regexp_extract("path", "nation=([^/]+)", 1).alias("nation"), "bytes", "sha256")
