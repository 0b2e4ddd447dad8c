"""Distance and support queries: embeddings as feature blocks, suppliers as lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.operators import neighbors, scorer, support
from quotaloom.plans.registry import query
from quotaloom.plans.testbed import VECTORS, rounded, table, vectors
from quotaloom.session import materialize

BLOCKS = ("b1", "b2", "b3", "b4")

PAIRS = VECTORS + """,
q AS (SELECT * FROM vectors WHERE partition <> 'train'), t AS (SELECT * FROM vectors WHERE partition = 'train'),
d AS (SELECT q.case_id, t.case_id AS tid, t.entity AS grp, list_distance(q.vector, t.vector) AS distance,
             1 - list_cosine_similarity(q.vector, t.vector) AS cosine FROM q, t)
"""


def split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, sf)
    return rows.where("partition <> 'train'"), rows.where("partition = 'train'")


@query("knn_mean", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, tid) AS rn FROM d)
SELECT case_id, round(avg(distance), 6) AS knn_distance FROM r WHERE rn <= 5 GROUP BY case_id""")
def knn_mean(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(neighbors.mean_distance(q, neighbors.nearest(q, t, 5, neighbors.euclidean, ["vector"]), "knn_distance"))


@query("knn_cosine", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cosine, tid) AS rn FROM d)
SELECT case_id, round(avg(cosine), 6) AS cosine_distance FROM r WHERE rn <= 5 GROUP BY case_id""")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(neighbors.mean_distance(q, neighbors.nearest(q, t, 5, neighbors.cosine, ["vector"]), "cosine_distance"))


@query("knn_distinct_group", f"""WITH {PAIRS}, rep AS (SELECT min(case_id) AS tid FROM t GROUP BY entity),
r AS (SELECT d.*, row_number() OVER (PARTITION BY case_id ORDER BY distance, d.tid) AS rn FROM d JOIN rep ON d.tid = rep.tid)
SELECT case_id, round(avg(distance), 6) AS group_distance FROM r WHERE rn <= 5 GROUP BY case_id""")
def knn_distinct_group(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    reps = neighbors.first_per_group(t, "entity", "case_id")
    return rounded(neighbors.mean_distance(q, neighbors.nearest(q, reps, 5, neighbors.euclidean, ["vector"]), "group_distance"))


@query("knn_group_minimum", f"""WITH {PAIRS}, g AS (SELECT case_id, grp, min(distance) AS distance FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, grp) AS rn FROM g)
SELECT case_id, round(avg(distance), 6) AS group_distance FROM r WHERE rn <= 5 GROUP BY case_id""")
def knn_group_minimum(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    found = neighbors.nearest(q, t, 5, neighbors.euclidean, ["vector"], group="entity")
    return rounded(neighbors.mean_distance(q, found, "group_distance"))


@query("neighbor_evidence", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, tid) AS rn FROM d)
SELECT case_id, CAST(rn AS INTEGER) AS neighbor_rank, tid AS neighbor_id, grp AS reference_entity, round(distance, 6) AS distance FROM r WHERE rn <= 5""")
def neighbor_evidence(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    found = neighbors.nearest(q, t, 5, neighbors.euclidean, ["vector"])
    out = neighbors.evidence(found, t, "case_id", {"reference_entity": "entity"})
    return rounded(out.select("case_id", "neighbor_rank", "neighbor_id", "reference_entity", "distance"))


TANIMOTO = VECTORS + """,
b AS (SELECT case_id, entity, partition, i FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors) WHERE vector[i] > 0),
c AS (SELECT case_id, entity, partition, count(*) AS k FROM b GROUP BY ALL),
x AS (SELECT q.case_id, t.case_id AS tid, count(*) AS both FROM b q JOIN b t ON q.i = t.i AND q.partition <> 'train' AND t.partition = 'train' GROUP BY ALL),
p AS (SELECT q.case_id, t.case_id AS tid, t.entity AS grp, 1 - coalesce("both", 0) / (q.k + t.k - coalesce("both", 0))::DOUBLE AS distance
      FROM (SELECT * FROM c WHERE partition <> 'train') q CROSS JOIN (SELECT * FROM c WHERE partition = 'train') t LEFT JOIN x ON x.case_id = q.case_id AND x.tid = t.case_id)
"""


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", neighbors.sign_words(F.col("vector"), 64))


@query("tanimoto_novelty", f"WITH {TANIMOTO.replace('AS both ', 'AS \"both\" ')} SELECT case_id, round(min(distance), 6) AS similarity_novelty FROM p GROUP BY case_id")
def tanimoto_novelty(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(neighbors.tanimoto_novelty(words(q), words(t)))


@query("tanimoto_knn_group", f"""WITH {TANIMOTO.replace('AS both ', 'AS "both" ')}, rep AS (SELECT min(case_id) AS tid FROM vectors WHERE partition = 'train' GROUP BY entity),
r AS (SELECT p.*, row_number() OVER (PARTITION BY case_id ORDER BY distance, p.tid) AS rn FROM p JOIN rep ON p.tid = rep.tid)
SELECT case_id, round(avg(distance), 6) AS tanimoto_distance FROM r WHERE rn <= 5 GROUP BY case_id""")
def tanimoto_knn_group(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    reps = neighbors.first_per_group(words(t), "entity", "case_id")
    found = neighbors.nearest(words(q), reps, 5, neighbors.tanimoto, ["words"])
    return rounded(neighbors.mean_distance(q, found, "tanimoto_distance"))


def context(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("endpoint"),
        F.when(F.col("c_nationkey") != 7, F.col("c_acctbal")).alias("x1"), F.col("c_nationkey").cast("double").alias("x2"),
        F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") / 1000).cast("int").cast("string")).alias("medium"))
    return rows.where("x2 >= 20"), rows.where("x2 < 20")


CONTEXT = """
ctx AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS endpoint, CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS x1, c_nationkey::DOUBLE AS x2,
   CASE WHEN c_acctbal > 0 THEN CAST(CAST(trunc(c_acctbal / 1000) AS INTEGER) AS VARCHAR) END AS medium FROM customer),
qq AS (SELECT * FROM ctx WHERE x2 >= 20), tt AS (SELECT * FROM ctx WHERE x2 < 20)
"""


@query("gower_knn", f"""WITH {CONTEXT}, g AS (SELECT max(x1) - min(x1) AS r1, max(x2) - min(x2) AS r2 FROM tt),
p AS (SELECT q.case_id, t.case_id AS tid,
   CASE WHEN q.x1 IS NULL OR t.x1 IS NULL THEN 0 ELSE least(abs(q.x1 - t.x1) / r1, 1) END + least(abs(q.x2 - t.x2) / r2, 1) + coalesce((q.medium <> t.medium)::INT, 0) AS num,
   1 + (q.x1 IS NOT NULL AND t.x1 IS NOT NULL)::INT + (q.medium IS NOT NULL AND t.medium IS NOT NULL)::INT AS den FROM qq q JOIN tt t ON q.endpoint = t.endpoint, g),
r AS (SELECT *, num / den AS dist, row_number() OVER (PARTITION BY case_id ORDER BY num / den, tid) AS rn FROM p),
m AS (SELECT case_id, avg(dist) AS v FROM r WHERE rn <= 5 GROUP BY case_id)
SELECT case_id, round(coalesce(v, 1), 6) AS context_distance, (x1 IS NULL)::INT / 2.0::DOUBLE AS context_missing_fraction FROM qq LEFT JOIN m USING (case_id)""")
def gower_knn(spark: SparkSession, sf: str) -> DataFrame:
    q, t = context(spark, sf)
    return rounded(neighbors.gower_knn(q, t, "endpoint", ["x1", "x2"], ["medium"]))


@query("nan_euclidean_knn", f"""WITH {CONTEXT},
rep AS (SELECT min(case_id) AS case_id FROM tt GROUP BY endpoint, medium), rr AS (SELECT tt.* FROM tt JOIN rep USING (case_id)),
s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM rr),
p AS (SELECT q.case_id, r.case_id AS tid, CASE WHEN q.x1 IS NOT NULL AND r.x1 IS NOT NULL THEN sqrt(((q.x1 - r.x1) / s1) ** 2 + ((q.x2 - r.x2) / s2) ** 2)
     ELSE sqrt(2 * ((q.x2 - r.x2) / s2) ** 2) END AS dist FROM qq q, rr r, s),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dist, tid) AS rn FROM p)
SELECT case_id, round(avg(dist), 6) AS signal_distance FROM k WHERE rn <= 5 GROUP BY case_id""")
def nan_euclidean_knn(spark: SparkSession, sf: str) -> DataFrame:
    q, t = context(spark, sf)
    t = t.withColumn("grp", F.concat_ws("|", "endpoint", F.coalesce("medium", F.lit("-"))))
    return rounded(neighbors.nan_euclidean_knn(q, t, "grp", ["x1", "x2"]))


@query("taxonomy_novelty", """WITH l AS (SELECT s_suppkey, lower(r_name) AS a, CASE WHEN s_acctbal > 0 THEN lower(n_name) END AS b, CASE WHEN s_acctbal > 0 THEN lower(s_name) END AS c, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT * FROM l WHERE s_acctbal < 6000), q AS (SELECT * FROM l WHERE s_acctbal >= 3000 OR s_acctbal < 0)
SELECT CAST(s_suppkey AS VARCHAR) AS case_id, round(1 - CASE WHEN c IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE t.a = q.a AND t.b = q.b AND t.c = q.c) THEN 3
  WHEN b IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE t.a = q.a AND t.b = q.b) THEN 2 WHEN EXISTS (SELECT 1 FROM t WHERE t.a = q.a) THEN 1 ELSE 0 END / 3.0::DOUBLE, 6) AS taxonomy_novelty FROM q""")
def taxonomy_novelty(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = F.col("s_acctbal") > 0
    rows = rows.select(F.col("s_suppkey").cast("string").alias("case_id"), F.col("r_name").alias("phylum"), "s_acctbal",
                       F.when(known, F.col("n_name")).alias("genus"), F.when(known, F.col("s_name")).alias("species"))
    return rounded(support.taxonomy_novelty(rows.where("s_acctbal >= 3000 OR s_acctbal < 0"), rows.where("s_acctbal < 6000"),
                                            ["phylum", "genus", "species"]))


@query("range_score", f"""WITH {VECTORS}, e AS (SELECT case_id, partition, i, vector[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)),
r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e WHERE partition = 'train' GROUP BY i)
SELECT case_id, round(avg((x < lo OR x > hi)::INT), 6) AS range_score FROM e JOIN r USING (i) WHERE partition <> 'train' GROUP BY case_id""")
def range_score(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(support.range_score(q, t).select("case_id", "range_score"))


def blocks(df: DataFrame) -> DataFrame:
    return df.select("case_id", "entity", *[F.slice("vector", 16 * i + 1, 16).alias(b) for i, b in enumerate(BLOCKS)])


@query("block_scaling", f"""WITH {VECTORS}, e AS (SELECT case_id, partition, i, vector[i] AS x, (i - 1) // 16 AS b FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)),
n AS (SELECT case_id, b, sum(x * x) AS s FROM e WHERE partition = 'train' GROUP BY ALL), k AS (SELECT b, sqrt(avg(s)) AS scale FROM n GROUP BY b)
SELECT case_id, round(sqrt(sum((x / (scale * 2)) ** 2)), 6) AS scaled_norm FROM e JOIN k USING (b) GROUP BY case_id""")
def block_scaling(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    scales = support.block_scales(blocks(rows.where("partition = 'train'")), BLOCKS)
    scaled = support.scale_blocks(blocks(rows), scales)
    return rounded(scaled.select("case_id", F.sqrt(support.squared_norm("vector")).alias("scaled_norm")))


SUBSETS = {"all_blocks": BLOCKS, "without_b1": BLOCKS[1:], "without_b4": BLOCKS[:3], "only_b2": ("b2",)}


@query("block_subset_knn", f"""WITH {VECTORS}, e AS (SELECT case_id, partition, i, vector[i] AS x, (i - 1) // 16 AS b FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)),
n AS (SELECT case_id, b, sum(x * x) AS s FROM e WHERE partition = 'train' GROUP BY ALL), k AS (SELECT b, sqrt(avg(s)) AS scale FROM n GROUP BY b),
v AS (SELECT case_id, partition, b, list(x / (scale * 2) ORDER BY i) AS x FROM e JOIN k USING (b) GROUP BY ALL),
p AS (SELECT q.case_id, t.case_id AS tid, q.b, list_distance(q.x, t.x) ** 2 AS d2 FROM v q JOIN v t ON q.b = t.b AND q.partition <> 'train' AND t.partition = 'train'),
s AS (SELECT case_id, tid, sqrt(sum(d2)) AS a, sqrt(sum(d2) FILTER (WHERE b <> 0)) AS w1, sqrt(sum(d2) FILTER (WHERE b <> 3)) AS w4, sqrt(sum(d2) FILTER (WHERE b = 1)) AS o2 FROM p GROUP BY ALL),
l AS (SELECT case_id, tid, 'all_blocks' AS variant, a AS d FROM s UNION ALL SELECT case_id, tid, 'without_b1', w1 FROM s UNION ALL SELECT case_id, tid, 'without_b4', w4 FROM s UNION ALL SELECT case_id, tid, 'only_b2', o2 FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, variant ORDER BY d, tid) AS rn FROM l)
SELECT case_id, variant, round(avg(d), 6) AS distance FROM r WHERE rn <= 5 GROUP BY ALL""")
def block_subset_knn(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    scales = support.block_scales(blocks(t), BLOCKS)
    found = neighbors.nearest(support.scale_each_block(blocks(q), scales), support.scale_each_block(blocks(t), scales), 5,
                              neighbors.block_subsets(SUBSETS), BLOCKS)
    return rounded(found.groupBy("case_id", "variant").agg(F.avg("distance").alias("distance")))


@query("local_outlier_factor", f"""WITH {PAIRS},
dt AS (SELECT a.case_id, b.case_id AS tid, list_distance(a.vector, b.vector) AS distance FROM t a, t b WHERE a.case_id <> b.case_id),
ni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, tid) AS rn FROM dt) WHERE rn <= 20),
no AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, tid) AS rn FROM d) WHERE rn <= 20),
kd AS (SELECT case_id AS tid, max(distance) AS kd FROM ni GROUP BY case_id),
li AS (SELECT case_id AS tid, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM ni JOIN kd USING (tid) GROUP BY case_id),
lo AS (SELECT case_id, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM no JOIN kd USING (tid) GROUP BY case_id)
SELECT case_id, round(avg(li.lrd) / any_value(lo.lrd), 6) AS lof FROM no JOIN li USING (tid) JOIN lo USING (case_id) GROUP BY case_id""")
def local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(neighbors.local_outlier_factor(q, t, k=20))


@query("standardised_block", """WITH m AS (SELECT median(p_size::DOUBLE) AS m1, median(p_retailprice) AS m2 FROM part WHERE p_type <> 'ECONOMY'),
f AS (SELECT p_partkey, p_type, p_size::DOUBLE AS a, coalesce(CASE WHEN p_brand <> 'Brand#7' THEN p_retailprice END, 0) AS b, p_brand = 'Brand#7' AS hole, p_retailprice FROM part),
mm AS (SELECT median(a) AS m1, median(CASE WHEN NOT hole THEN p_retailprice END) AS m2 FROM f),
g AS (SELECT p_partkey, a, CASE WHEN hole THEN m2 ELSE p_retailprice END AS b FROM f, mm), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM g)
SELECT p_partkey, round((a - ma) / sa, 6) AS z1, round((b - mb) / sb, 6) AS z2 FROM g, s""")
def standardised_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("a"),
                                           F.when(F.col("p_brand") != "Brand#7", F.col("p_retailprice")).alias("b"))
    out = support.apply_standardise(rows, support.impute_and_standardise(rows, ["a", "b"]), "z")
    return rounded(out.select("p_partkey", F.col("z")[0].alias("z1"), F.col("z")[1].alias("z2")))


@query("one_hot_block", """WITH c AS (SELECT DISTINCT p_type FROM part WHERE p_size > 25), o AS (SELECT p_partkey, p_type FROM part)
SELECT p_partkey, (p_type IN (SELECT p_type FROM c))::INT::DOUBLE AS hot, CAST((SELECT count(*) FROM c) AS INTEGER) AS width FROM o""")
def one_hot_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    categories = support.index_categories(rows.where("p_size > 25"), ["p_type"])
    width = categories.agg(F.count("*").cast("int").alias("width")).select("width").scalar()
    return support.one_hot_slots(rows, categories, ["p_type"], "slots").select(
        "p_partkey", F.size("slots").cast("double").alias("hot"), width.alias("width"))


@query("mahalanobis")
def mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    out = support.shrinkage_mahalanobis(support.mahalanobis(q, t), t)
    return rounded(out.select("case_id", "mahalanobis", "shrinkage_mahalanobis"))


@query("leverage")
def leverage(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    return rounded(support.leverage(q, t).select("case_id", "leverage"))


@query("isolation_forest")
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    q, t = split(spark, sf)
    forest = support.isolation_trees(t, "vector", "case_id", trees=100)
    return rounded(support.isolation_score(q, forest).select("case_id", "isolation_forest"))


@query("support_scores")
def support_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All support scores of every unseen row."""
    from quotaloom.operators.scorer import SupportScorer

    q, t = split(spark, sf)
    scorer = SupportScorer(blocks=("vector",), fingerprint="words", descriptor="vector", group="entity", trees=50, lof_neighbors=20)
    return rounded(scorer.fit(words(t)).score(words(q)))


RISK_LINEAGE = ["r_name", "n_name", "kind"]


def risk_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a case: its signs are the fingerprint, two components the descriptors, the customer of its number the context."""
    rows = vectors(spark, sf).select("*", F.col("case_id").cast("long").alias("_key"))
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(customers, F.col("_key") == F.col("c_custkey"), "left")
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return rows.select(
        "case_id", "partition", F.concat_ws("-", "entity", (F.col("_key") % 40).cast("string")).alias("entity"), F.col("c_mktsegment").alias("endpoint"),
        neighbors.sign_words(F.col("vector"), 64).alias("words"), F.slice("vector", 1, 2).alias("descriptor"), F.abs(F.col("vector")[2]).alias("spread"),
        F.abs(F.col("vector")[3]).alias("abs_error"), "r_name", F.when(bal > 0, F.col("n_name")).alias("n_name"),
        F.when(bal > 3000, F.concat_ws(" ", "n_name", (F.col("_key") % 4).cast("string"))).alias("kind"),
        F.when(nation != 7, bal).alias("x1"), nation.cast("double").alias("x2"), F.when(bal > 0, (bal / 1000).cast("int").cast("string")).alias("medium"),
        F.when(bal > 1000, nation * 1.5).alias("g1"), F.when(F.col("_key") % 3 > 0, bal / 100).alias("g2"))


def risk_scorer_of(rows: DataFrame) -> scorer.ErrorRiskScorer:
    return scorer.ErrorRiskScorer("words", "descriptor", RISK_LINEAGE, ["x1", "x2"], ["medium"], ["g1", "g2"]).fit(rows.where("partition = 'train'"))


def scaled(c: str) -> str:
    return f"CASE WHEN hi_{c} - lo_{c} > 1e-12 THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0 END"


RISK = f"""{VECTORS},
rc AS (SELECT v.case_id, v.partition, concat_ws('-', v.entity, CAST(v.case_id AS BIGINT) % 40) AS entity, c_mktsegment AS endpoint, vector, vector[1] AS e1, vector[2] AS e2,
   abs(vector[3]) AS u_model, lower(r_name) AS l1, CASE WHEN c_acctbal > 0 THEN lower(n_name) END AS l2,
   CASE WHEN c_acctbal > 3000 THEN lower(concat_ws(' ', n_name, CAST(v.case_id AS BIGINT) % 4)) END AS l3,
   CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS x1, c_nationkey::DOUBLE AS x2, CASE WHEN c_acctbal > 0 THEN CAST(CAST(trunc(c_acctbal / 1000) AS INTEGER) AS VARCHAR) END AS medium,
   CASE WHEN c_acctbal > 1000 THEN c_nationkey * 1.5::DOUBLE END AS g1, CASE WHEN CAST(v.case_id AS BIGINT) % 3 > 0 THEN c_acctbal / 100 END AS g2
   FROM vectors v LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON CAST(v.case_id AS BIGINT) = c_custkey),
tr AS (SELECT * FROM rc WHERE partition = 'train'), qr AS (SELECT * FROM rc WHERE partition <> 'train'),
rep AS (SELECT tr.* FROM tr JOIN (SELECT min(case_id) AS case_id FROM tr GROUP BY entity) USING (case_id)),
bits AS (SELECT case_id, i FROM (SELECT case_id, vector, unnest(range(1, 65)) AS i FROM rc) WHERE vector[i] > 0),
nb AS (SELECT case_id, count(*) AS k FROM bits GROUP BY case_id),
bt AS (SELECT q.case_id, r.case_id AS tid, count(*) AS n_both FROM (SELECT bits.* FROM bits JOIN qr USING (case_id)) q JOIN (SELECT bits.* FROM bits JOIN rep USING (case_id)) r USING (i) GROUP BY ALL),
tk AS (SELECT q.case_id, r.case_id AS tid, 1 - coalesce(n_both, 0) / (a.k + b.k - coalesce(n_both, 0))::DOUBLE AS dist FROM qr q CROSS JOIN rep r JOIN nb a ON a.case_id = q.case_id
   JOIN nb b ON b.case_id = r.case_id LEFT JOIN bt ON bt.case_id = q.case_id AND bt.tid = r.case_id),
chem AS (SELECT case_id, avg(dist) AS d_chem_knn FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dist, tid) AS rn FROM tk) WHERE rn <= 5 GROUP BY case_id),
mo AS (SELECT count(*) AS n, avg(e1) AS m1, avg(e2) AS m2, var_pop(e1) AS a, covar_pop(e1, e2) AS b, var_pop(e2) AS c FROM rep),
lw AS (SELECT any_value(mo) AS mo, sum(((e1 - m1) ** 2 + (e2 - m2) ** 2) ** 2) AS fourth FROM rep, mo),
sh AS (SELECT mo.n AS n, mo.m1 AS m1, mo.m2 AS m2, mo.a AS a, mo.b AS b, mo.c AS c, (mo.a + mo.c) / 2 AS mu,
   (mo.a ** 2 + 2 * mo.b ** 2 + mo.c ** 2 - 2 * ((mo.a + mo.c) / 2) ** 2) / 2 AS delta, (fourth / mo.n - (mo.a ** 2 + 2 * mo.b ** 2 + mo.c ** 2)) / (2 * mo.n) AS beta FROM lw),
sg AS (SELECT m1, m2, (1 - s) * a + s * mu AS a, (1 - s) * b AS b, (1 - s) * c + s * mu AS c FROM (SELECT *, CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END AS s FROM sh)),
mah AS (SELECT case_id, sqrt(greatest(0, (c * (e1 - m1) ** 2 - 2 * b * (e1 - m1) * (e2 - m2) + a * (e2 - m2) ** 2) / (a * c - b * b))) AS d_chem_mahal FROM qr, sg),
tax AS (SELECT case_id, 1 - CASE WHEN l3 IS NOT NULL AND EXISTS (SELECT 1 FROM tr t WHERE t.l1 = q.l1 AND t.l2 = q.l2 AND t.l3 = q.l3) THEN 3
   WHEN l2 IS NOT NULL AND EXISTS (SELECT 1 FROM tr t WHERE t.l1 = q.l1 AND t.l2 = q.l2) THEN 2 WHEN EXISTS (SELECT 1 FROM tr t WHERE t.l1 = q.l1) THEN 1 ELSE 0 END / 3.0::DOUBLE AS d_species_tax FROM qr q),
rg AS (SELECT max(x1) - min(x1) AS r1, max(x2) - min(x2) AS r2 FROM tr),
gp AS (SELECT q.case_id, t.case_id AS tid,
   (CASE WHEN q.x1 IS NULL OR t.x1 IS NULL THEN 0 ELSE least(abs(q.x1 - t.x1) / r1, 1) END + least(abs(q.x2 - t.x2) / r2, 1) + coalesce((q.medium <> t.medium)::INT, 0))
   / (1 + (q.x1 IS NOT NULL AND t.x1 IS NOT NULL)::INT + (q.medium IS NOT NULL AND t.medium IS NOT NULL)::INT) AS dist FROM qr q JOIN tr t ON q.endpoint = t.endpoint, rg),
gow AS (SELECT case_id, avg(dist) AS v FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dist, tid) AS rn FROM gp) WHERE rn <= 5 GROUP BY case_id),
ss AS (SELECT avg(g1) AS m1, stddev_pop(g1) AS s1, avg(g2) AS m2, stddev_pop(g2) AS s2 FROM rep),
mp AS (SELECT q.case_id, r.case_id AS tid, (q.g1 IS NOT NULL AND r.g1 IS NOT NULL)::INT + (q.g2 IS NOT NULL AND r.g2 IS NOT NULL)::INT AS seen,
   coalesce(((q.g1 - r.g1) / s1) ** 2, 0) + coalesce(((q.g2 - r.g2) / s2) ** 2, 0) AS sq FROM qr q CROSS JOIN rep r CROSS JOIN ss),
me AS (SELECT case_id, avg(sqrt(2 * sq / seen)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY 2 * sq / seen, tid) AS rn FROM mp WHERE seen > 0) WHERE rn <= 5 GROUP BY case_id),
comp AS (SELECT q.case_id, q.partition, d_chem_knn, d_chem_mahal, d_species_tax, coalesce(gow.v, 1) AS d_context, ((q.x1 IS NULL)::INT + (q.x2 IS NULL)::INT) / 2.0::DOUBLE AS context_missing_fraction,
   coalesce(me.v, 0) AS d_mech, ((g1 IS NULL)::INT + (g2 IS NULL)::INT) / 2.0::DOUBLE AS bioactivity_missing_fraction, u_model
   FROM qr q JOIN chem USING (case_id) JOIN mah USING (case_id) JOIN tax USING (case_id) LEFT JOIN gow USING (case_id) LEFT JOIN me USING (case_id)),
lim AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in scorer.COMPONENTS)} FROM comp WHERE partition = 'calibration')"""
RISK_AXES = ", ".join(f"round(({' + '.join(scaled(c) for c in columns)}) / {len(columns)}.0::DOUBLE, 6) + 0 AS axis_{name}" for name, columns in scorer.AXES.items())


@query("risk_components", f"WITH {RISK} SELECT case_id, {', '.join(f'round({c}, 6) AS {c}' for c in scorer.COMPONENTS)}, {RISK_AXES} FROM comp, lim")
def risk_components(spark: SparkSession, sf: str) -> DataFrame:
    """The eight components of every held-out case, and the axes scaled by the calibration cases."""
    scored = risk_scored(spark, sf)
    return rounded(scored.select("case_id", *scorer.COMPONENTS, *[f"axis_{a}" for a in scorer.AXES]))


@query("risk_scores")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The learnt score of the held-out cases."""
    return rounded(risk_scored(spark, sf).select("case_id", "risk_score"))


def risk_scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(risk_cases(spark, sf))
    fitted, held = risk_scorer_of(rows), rows.where("partition <> 'train'")
    parts = materialize(fitted.components(held, "spread"))
    known = held.where("partition = 'calibration'").select("case_id", "abs_error")
    return fitted.fit_meta(parts.join(known, "case_id"), "abs_error").scores(parts)
