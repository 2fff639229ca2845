"""Queries on residues, columns of alignments, clusters by age, and what was left unchecked elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conservation as c
from ..operators import blocks, folds, graph, models, profiles, statistics
from ..operators import sequences as s
from .registry import Tables, query

LETTERS = "ACDEFGHIKLMNPQRSTVWYACDEFG"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Distinct names of parts as rows of an alignment of eight columns: letters become amino acids, a blank is a gap.
MSA = f"""msa AS (SELECT p_name AS seq_id, i AS pos, CASE WHEN substring(p_name, i, 1) = ' ' THEN '-' ELSE translate(upper(substring(p_name, i, 1)), '{UPPER}', '{LETTERS}') END AS aa
    FROM (SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '^[A-Za-z ]{{8}}')) n, range(1, 9) r(i))"""


def msa(t: Tables) -> DataFrame:
    names = t.part.where("p_name RLIKE '^[A-Za-z ]{8}'").select(F.col("p_name").alias("seq_id")).distinct()
    letters = names.select("seq_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("pos"))
    letter = F.substring("seq_id", F.col("pos").cast("int"), F.lit(1))
    return letters.select("seq_id", "pos", F.when(letter == " ", "-").otherwise(F.translate(F.upper(letter), UPPER, LETTERS)).alias("aa"))


PHYSCHEM = ", ".join(f"('{r[0]}', [{', '.join(f'{v}::DOUBLE' for v in r[1:])}])" for r in map(str.split, s.PHYSCHEM.strip().splitlines()))


@query("physchem", f"WITH {MSA}, known(letter, properties) AS (VALUES {PHYSCHEM}) SELECT seq_id, pos, round(coalesce(properties[1], 0), 6) AS hydrophobicity, round(coalesce(properties[5], 0), 6) AS polarity, round(coalesce(properties[8], 0), 6) AS net_charge, round(coalesce(properties[9], 0), 6) AS mass FROM msa LEFT JOIN known ON aa = letter")
def physchem(t: Tables) -> DataFrame:
    found = s.physchem(msa(t))
    return found.select("seq_id", "pos", *(F.round(F.get("properties", F.lit(i)), 6).alias(n) for i, n in ((0, "hydrophobicity"), (4, "polarity"), (7, "net_charge"), (8, "mass"))))


HENIKOFF = f"{MSA}, k AS (SELECT pos, count(DISTINCT aa) AS k FROM msa GROUP BY pos), n AS (SELECT pos, aa, count(*) AS n FROM msa GROUP BY ALL), weights AS (SELECT seq_id, avg(1.0::DOUBLE / (k * n)) AS weight FROM msa JOIN k USING (pos) JOIN n USING (pos, aa) GROUP BY seq_id)"


@query("henikoff_weights", f"WITH {HENIKOFF} SELECT seq_id, round(weight, 9) AS weight FROM weights")
def henikoff_weights(t: Tables) -> DataFrame:
    return c.henikoff_weights(msa(t)).withColumn("weight", F.round("weight", 9))


BACKGROUND = ", ".join(f"('{a}', {q / sum(c.BACKGROUND)!r}::DOUBLE)" for a, q in zip(c.AMINO, c.BACKGROUND, strict=True))
FREQUENCIES = f"""{HENIKOFF}, back(aa, q) AS (VALUES {BACKGROUND}),
    total AS (SELECT pos, sum(weight) AS w, coalesce(sum(weight) FILTER (aa = '-'), 0) AS g FROM msa JOIN weights USING (seq_id) GROUP BY pos),
    seen AS (SELECT pos, aa, sum(weight) AS s FROM msa JOIN weights USING (seq_id) WHERE aa <> '-' GROUP BY ALL),
    counted AS (SELECT pos, aa, q, g / w AS gap, coalesce(s, 0) + 1e-7 AS n FROM total CROSS JOIN back LEFT JOIN seen USING (pos, aa)),
    freq AS (SELECT pos, aa, q, gap, n / sum(n) OVER (PARTITION BY pos) AS f FROM counted)"""
SCORES = {
    "shannon": "1 + sum(f * ln(f)) / ln(20)",
    "relative_entropy": "sum(f * ln(f / q))",
    "js_divergence": "sum(f * log2(2 * f / (f + q)) + q * log2(2 * q / (f + q))) / 2",
}
for _how, _sql in SCORES.items():

    @query(f"conservation_{_how}", f"WITH {FREQUENCIES} SELECT pos, round(CASE WHEN max(gap) > 0.3 THEN -1000 ELSE ({_sql}) * (1 - max(gap)) END, 6) AS score FROM freq GROUP BY pos")
    def conservation_score(t: Tables, how: str = _how) -> DataFrame:
        return c.conservation(msa(t), how, gap_penalty=True, gap_cut=0.3).select("pos", F.round("score", 6).alias("score"))


@query(
    "pssm_profile",
    f"WITH {MSA}, ids AS (SELECT x.seq_id AS a, y.seq_id AS b, avg((x.aa = y.aa)::INT) AS value FROM msa x JOIN msa y ON x.pos = y.pos AND x.seq_id < y.seq_id GROUP BY ALL), near AS (SELECT a AS seq_id FROM ids WHERE value >= 0.5 UNION ALL SELECT b FROM ids WHERE value >= 0.5), w AS (SELECT s.seq_id, 1.0::DOUBLE / (2 + (SELECT count(*) FROM near n WHERE n.seq_id = s.seq_id)) AS weight FROM (SELECT DISTINCT seq_id FROM msa) s), m AS (SELECT sum(weight) AS m FROM w), seen AS (SELECT pos, aa, sum(weight) AS s FROM msa JOIN w USING (seq_id) WHERE aa <> '-' GROUP BY ALL), letters AS (SELECT unnest(string_split('{c.AMINO}', '')) AS aa), counted AS (SELECT p.pos, l.aa, coalesce(s, 0) / m + m / 20 AS n FROM (SELECT DISTINCT pos FROM msa) p CROSS JOIN letters l CROSS JOIN m LEFT JOIN seen ON seen.pos = p.pos AND seen.aa = l.aa), prob AS (SELECT pos, aa, n / sum(n) OVER (PARTITION BY pos) AS p FROM counted) SELECT pos, aa, round(p, 9) AS p, round(1 / (1 + exp(-p)), 9) AS logistic, round(greatest(p * ln(p * 20), 0), 9) AS information FROM prob",
)
def pssm_profile(t: Tables) -> DataFrame:
    rows = msa(t)
    x, y = (rows.select("pos", F.col("seq_id").alias(n), F.col("aa").alias(f"aa_{n}")) for n in "ab")
    ids = x.join(y, "pos").where("a < b").groupBy("a", "b").agg(F.avg((F.col("aa_a") == F.col("aa_b")).cast("int")).alias("value"))
    p = c.pssm(rows, ids, 0.5)
    both = p.join(c.pssm_sigmoid(p).withColumnRenamed("p", "logistic"), ["pos", "aa"]).join(c.pssm_information(p).withColumnRenamed("p", "information"), ["pos", "aa"])
    return both.select("pos", "aa", *(F.round(n, 9).alias(n) for n in ("p", "logistic", "information")))


@query(
    "condition_change",
    "WITH r AS (SELECT l_linenumber, l_quantity > 25 AS m, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2.0::DOUBLE AS r FROM lineitem), s AS (SELECT l_linenumber, count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n2, sum(r) FILTER (m) AS r1 FROM r GROUP BY ALL) SELECT l_linenumber, round((r1 - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::DOUBLE), 3) AS z, abs((r1 - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::DOUBLE)) > 1.43953147 AS changed FROM s",
)
def condition_change(t: Tables) -> DataFrame:
    return statistics.condition_change(t.lineitem.withColumn("marked", F.col("l_quantity") > 25), ["l_linenumber"], "l_extendedprice", "marked")


FOLDED = "alike AS (SELECT a.entity, b.entity AS match, round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 9) AS cosine FROM profile a JOIN profile b ON a.feature = b.feature AND a.entity <> b.entity GROUP BY ALL), nearest AS (SELECT entity, match FROM alike QUALIFY row_number() OVER (PARTITION BY entity ORDER BY cosine DESC, match) = 1)"


@query("leave_one_out_nearest", f"WITH {FOLDED} SELECT n.entity, count(*) AS n, round(corr(p.value, q.value), 6) AS pearson FROM nearest n JOIN profile p ON p.entity = n.match JOIN profile q ON q.entity = n.entity AND q.feature = p.feature GROUP BY n.entity", ("profile",))
def leave_one_out_nearest(t: Tables) -> DataFrame:
    return folds.evaluate(folds.leave_one_out(t.profile, t.profile, "nearest"), t.profile).select("entity", "n", F.round("pearson", 6).alias("pearson"))


@query("leave_one_out_ridge")
def leave_one_out_ridge(t: Tables) -> DataFrame:
    from .models import halves

    sequence, response = halves(t)
    return folds.evaluate(folds.leave_one_out(sequence, response, "ridge", alpha=1.0), response)


@query("leave_one_out_joint")
def leave_one_out_joint(t: Tables) -> DataFrame:
    from .models import halves

    sequence, response = halves(t)
    return folds.evaluate(folds.leave_one_out(sequence, response, "joint", components=5), response)


CLUSTERS = "clusters AS (SELECT c_custkey % 50 AS cluster, n_name AS species FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 GROUP BY ALL), clades AS (SELECT n_name AS species, r_name AS clade FROM nation JOIN region ON n_regionkey = r_regionkey), ages AS (SELECT cluster, max(n_nationkey)::DOUBLE AS age FROM clusters JOIN nation ON n_name = species GROUP BY cluster)"


def clusters(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = t.customer.where("c_custkey % 3 = 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    members = own.select((F.col("c_custkey") % 50).alias("cluster"), F.col("n_name").alias("species")).distinct()
    clades = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("species"), F.col("r_name").alias("clade"))
    return members, clades, own.groupBy((F.col("c_custkey") % 50).alias("cluster")).agg(F.max("n_nationkey").cast("double").alias("age"))


@query(
    "gains_losses",
    f"WITH {CLUSTERS}, dist AS (SELECT x.n_name AS a, y.n_name AS b, abs(x.n_nationkey - y.n_nationkey)::DOUBLE AS dist FROM nation x, nation y), aged AS (SELECT cluster, species, age FROM clusters JOIN ages USING (cluster)), below AS (SELECT age, species FROM aged UNION SELECT age, b FROM aged JOIN dist ON a = species AND dist <= age), overlap AS (SELECT DISTINCT x.age, y.age AS gained_age FROM below x JOIN below y ON x.species = y.species AND y.age >= x.age), lost AS (SELECT o.age, o.gained_age, (SELECT count(*) FROM ages g WHERE g.age = o.gained_age) AS gained, (SELECT count(*) FROM ages g WHERE g.age = o.gained_age AND NOT EXISTS (SELECT 1 FROM clusters c JOIN below b ON b.species = c.species WHERE c.cluster = g.cluster AND b.age = o.age)) AS lost FROM overlap o), older AS (SELECT age, min(gained_age) AS older FROM overlap WHERE gained_age > age GROUP BY age) SELECT l.age, l.gained_age, l.gained, l.lost, CASE WHEN l.gained_age > l.age AND l.gained_age >= older THEN l.lost - coalesce(p.lost, 0) ELSE 0 END AS newly_lost FROM lost l LEFT JOIN older o ON o.age = l.age LEFT JOIN lost p ON p.age = older AND p.gained_age = l.gained_age",
)
def gains_losses(t: Tables) -> DataFrame:
    members, _, ages = clusters(t)
    a, b = t.nation.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")), t.nation.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))
    distances = a.crossJoin(b).select("a", "b", F.abs(F.col("i") - F.col("j")).cast("double").alias("dist"))  # nations
    return graph.gains_losses(members, ages, distances)


RELATED = "related AS (SELECT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b, round(avg(l_discount), 6) AS value FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1 GROUP BY ALL)"


def related(t: Tables) -> DataFrame:
    other = F.col("l_partkey") % 100 + 1
    pairs = t.lineitem.where(F.col("l_suppkey") != other).groupBy(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b"))
    return pairs.agg(F.round(F.avg("l_discount"), 6).alias("value"))


@query("significance_rule", "WITH m AS (SELECT l_suppkey, avg(l_discount) - 0.05 AS z, avg(l_tax) - 0.04 AS zofz, avg(l_quantity) / 50 AS p_adjusted, avg(l_extendedprice) / 40000 AS p_perm FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, p_adjusted < 0.51 AND p_perm <= 1 AND sign(z) = sign(zofz) AS accept FROM m")
def significance_rule(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("z"), (F.avg("l_tax") - 0.04).alias("zofz"), (F.avg("l_quantity") / 50).alias("p_adjusted"), (F.avg("l_extendedprice") / 40000).alias("p_perm"))
    return statistics.significance_rule(m, "z", "zofz", "p_adjusted", 0.51, "p_perm", 1.0).select("l_suppkey", "accept")


@query("binding_cut_top", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 50 AS bound FROM lineitem")
def binding_cut_top(t: Tables) -> DataFrame:
    keyed = t.lineitem.withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return statistics.binding_cut(keyed, ["l_returnflag"], "l_extendedprice", "top", 50, "key").select("l_orderkey", "l_linenumber", "bound")


@query("zero_point", "WITH c AS (SELECT l_quantity AS x, avg(l_discount) - 0.05 AS y FROM lineitem GROUP BY l_quantity), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM c) SELECT round(min(CASE WHEN y = 0 THEN x ELSE x - y * (x2 - x) / (y2 - y) END), 6) AS zero FROM s WHERE y = 0 OR y * y2 < 0")
def zero_point(t: Tables) -> DataFrame:
    curve = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg((F.avg("l_discount") - 0.05).alias("y"))
    return statistics.zero_point(curve, "x", "y").select(F.round("zero", 6).alias("zero"))


@query("split_linkage", "WITH RECURSIVE " + RELATED + ", edges AS (SELECT a, b FROM related WHERE 1 - value <= 0.92), nodes AS (SELECT a AS id FROM related UNION SELECT b FROM related), reach(id, got) AS (SELECT id, id FROM nodes UNION SELECT r.id, CASE WHEN e.a = r.got THEN e.b ELSE e.a END FROM reach r JOIN edges e ON r.got IN (e.a, e.b)) SELECT id, min(got) AS component FROM reach GROUP BY id")
def split_linkage(t: Tables) -> DataFrame:
    rows = related(t).select("a", "b", (1 - F.col("value")).alias("distance"))
    nodes = rows.select(F.col("a").alias("id")).union(rows.select("b")).distinct()
    return graph.single_link(nodes, rows, 0.92)


@query("mst_split")
def mst_split(t: Tables) -> DataFrame:
    return graph.split_linkage(related(t).select(F.lit(0).alias("block"), "a", "b", (1 - F.col("value")).alias("distance")), "block", "average", [0.93, 0.95])


@query("conserved_groups")
def conserved_groups(t: Tables) -> DataFrame:
    members = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("species"))
    a, b = t.nation.select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_nationkey").alias("i")), t.nation.select(F.col("n_nationkey").cast("string").alias("b"), F.col("n_nationkey").alias("j"))
    distances = a.crossJoin(b).where("i < j").select("a", "b", F.abs(F.col("i") - F.col("j")).cast("double").alias("dist"))  # 25 nations
    return graph.conserved_groups(related(t).withColumn("distance", 0.1 - F.col("value")), members, distances, 0.05, 0.055)


@query("subcluster")
def subcluster(t: Tables) -> DataFrame:
    rows = related(t).select("a", "b", (1 - F.col("value")).alias("distance"))
    nodes = rows.select(F.col("a").alias("id")).union(rows.select("b")).distinct()
    members = graph.single_link(nodes, rows, 0.93).select("id", F.col("component").alias("cluster"))
    return graph.subcluster(members, rows, "average", 0.94)


@query("split_by_delim", "SELECT p_partkey AS entity, string_split(p_name, ' ')[1] AS head FROM part")
def split_by_delim(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity"), F.substring_index("p_name", " ", 1).alias("head"))


@query("reconstruct_response")
def reconstruct_response(t: Tables) -> DataFrame:
    from .models import halves

    sequence, response = halves(t)
    return models.reconstruct(sequence, response, source="sequence", amount=5)


@query("primal_ridge")
def primal_ridge(t: Tables) -> DataFrame:
    from .models import halves

    sequence, response = halves(t)
    return models.apply_linear(sequence, models.ridge_primal(sequence, response, 1.0))


@query("latent_stats_operator", "WITH d AS (SELECT a.l_suppkey AS entity, b.l_suppkey AS match, round(avg(abs(a.q - b.q)), 6) AS distance FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) a JOIN (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) b ON a.l_linenumber = b.l_linenumber AND a.l_suppkey <> b.l_suppkey GROUP BY ALL) SELECT entity, min(distance) AS min_distance FROM d GROUP BY entity")
def latent_stats_operator(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("feature")).agg(F.avg("l_quantity").alias("value"))
    return models.latent_stats(blocks.best_matches(q, 1, "near", 6).select("entity", "match", (-F.col("value")).alias("distance")))


@query("family_relations", f"WITH {CLUSTERS}, m AS (SELECT a.cluster AS a, b.cluster AS b, round(count(*) / 25.0::DOUBLE, 6) AS value FROM clusters a JOIN clusters b ON a.species = b.species AND a.cluster < b.cluster GROUP BY ALL), mutual AS (SELECT a, b, value FROM m UNION ALL SELECT b, a, value FROM m), best AS (SELECT x.a AS cluster, x.b AS parent, x.value FROM mutual x JOIN ages p ON p.cluster = x.a JOIN ages q ON q.cluster = x.b WHERE q.age > p.age AND x.value >= 0.2 QUALIFY row_number() OVER (PARTITION BY x.a ORDER BY x.value DESC, x.b) = 1) SELECT a.cluster, a.age, b.parent, b.value FROM ages a LEFT JOIN best b USING (cluster)")
def family_relations(t: Tables) -> DataFrame:
    members, _, ages = clusters(t)
    x, y = members.select(F.col("cluster").alias("a"), "species"), members.select(F.col("cluster").alias("b"), "species")
    means = x.join(y, "species").where("a < b").groupBy("a", "b").agg(F.round(F.count("*") / F.lit(25.0), 6).alias("value"))
    return graph.family(ages, means, 0.2).select("cluster", "age", "parent", "value")


@query("merge_paralogs", "WITH RECURSIVE " + RELATED + ", members AS (SELECT s_suppkey AS id, s_suppkey % 40 AS cluster FROM supplier), m AS (SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b FROM related JOIN members x ON x.id = a JOIN members y ON y.id = b WHERE x.cluster <> y.cluster GROUP BY ALL HAVING avg(value) >= 0.065), reach(id, got) AS (SELECT DISTINCT cluster, cluster FROM members UNION SELECT r.id, CASE WHEN e.a = r.got THEN e.b ELSE e.a END FROM reach r JOIN m e ON r.got IN (e.a, e.b)) SELECT members.id, min(got) AS cluster FROM members JOIN reach ON reach.id = members.cluster GROUP BY members.id")
def merge_paralogs(t: Tables) -> DataFrame:
    return graph.merge_paralogs(t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40).alias("cluster")), related(t), 0.065)


@query("one_to_one", "WITH " + RELATED + " SELECT value > 0.06 AS one_to_one, count(*) AS n, round(avg(value), 6) AS mean FROM related GROUP BY 1")
def one_to_one(t: Tables) -> DataFrame:
    edges = related(t)
    return graph.one_to_one(edges, edges.where("value > 0.06").select("a", "b")).withColumn("mean", F.round("mean", 6))


@query("cut_at_value", "WITH c AS (SELECT l_quantity AS x, avg(l_discount) AS y FROM lineitem GROUP BY l_quantity) SELECT min(x) AS cut FROM c WHERE y >= 0.0505")
def cut_at_value(t: Tables) -> DataFrame:
    return statistics.cut_at_value(t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("y")), "x", "y", 0.0505)


@query("filter_features_list", "SELECT entity, feature, value FROM profile WHERE feature IN (SELECT p_brand FROM part WHERE p_size > 45)", ("profile",))
def filter_features_list(t: Tables) -> DataFrame:
    return profiles.filter_features(t.profile, t.part.where("p_size > 45").select(F.col("p_brand").alias("feature")).distinct())
