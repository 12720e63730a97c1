"""More registered queries, for the operators that ``queries`` leaves out. Importing this module adds them to the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions.expressions import value
from strandloom.operators import aggregate, annotate, denoise, filters, joins, kmers, taxonomy
from strandloom.plans.queries import KMERS, RC, REC, SETS, B, _benchmark, _index, paths, query, records, table, taxa
from strandloom.records import annotation_keys, as_records, attribute, set_attributes

# --- predicates ---------------------------------------------------------------


@query("filter_count", f"SELECT md5(s) AS md5, count(*) AS count FROM {REC} GROUP BY s HAVING count(*) BETWEEN 2 AND 10")
def _(spark, d):
    out = filters.keep(aggregate.dereplicate(records(spark, d), keep_attributes=[]), filters.count_between(2, 10))
    return out.select(F.md5("sequence").alias("md5"), "count")


@query("filter_samples", f"SELECT md5(s) AS md5 FROM {REC} GROUP BY s HAVING count(DISTINCT coalesce(source, 'NA')) >= 2")
def _(spark, d):
    return filters.keep(aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[]), filters.in_samples(2)).select(F.md5("sequence").alias("md5"))


def _rated(spark, d):
    labels = as_records(table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("sequence"), "quality"))
    return joins.annotate_from(records(spark, d), set_attributes(labels, {"quality": F.col("quality")}))


@query("filter_has_attribute", "SELECT 'd' || doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(spark, d):
    return filters.keep(_rated(spark, d), filters.attribute_exists("quality")).select("id")


def _customers(spark, d):
    return as_records(table(spark, d, "customer").select(F.col("c_name").alias("id"), F.lit("").alias("sequence"), F.col("c_mktsegment").alias("definition"), F.concat(F.lit("c"), "c_custkey").alias("taxid"), F.col("c_custkey").alias("input_order")))


@query("filter_definition", "SELECT c_name AS id FROM customer WHERE regexp_matches(c_mktsegment, '^(?:MACH|AUTO)')")
def _(spark, d):
    return filters.keep(_customers(spark, d), filters.definition_matches("^(?:mach|auto)", ignore_case=True)).select("id")


@query("filter_id", "SELECT c_name AS id FROM customer WHERE regexp_matches(c_name, '7$') AND regexp_matches(c_name, '#0+1')")
def _(spark, d):
    return filters.keep(_customers(spark, d), filters.id_matches("7$", "#0+1")).select("id")


@query("filter_one_of_two", f"SELECT id FROM {REC} WHERE (length(s) >= 700) <> coalesce(lang = 'de', false)")
def _(spark, d):
    return filters.keep(records(spark, d), filters.exactly_one(filters.length_between(700), filters.attribute_matches({"lang": "^de$"}))).select("id")


@query("filter_paired", f"SELECT id FROM {REC} WHERE (length(s) >= 700) <> regexp_matches({RC.format('s')}, '^ac')")
def _(spark, d):
    r = records(spark, d)
    pairs = joins.pair_up(r, annotate.reverse_complement(r))
    return pairs.where(filters.paired(filters.length_between(700), F.col("mate.sequence").rlike("^ac"), "xor")).select("id")


@query("on_mate", f"SELECT id, s AS sequence, substring({RC.format('s')}, 3, 20) AS mate FROM {REC}")
def _(spark, d):
    r = records(spark, d)
    out = joins.on_mate(joins.pair_up(r, annotate.reverse_complement(r)), lambda x: annotate.cut(x, 3, 22))
    return out.select("id", "sequence", F.col("mate.sequence").alias("mate"))


@query("taxonomy_outside", "SELECT 'c' || c_custkey AS taxid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def _(spark, d):
    return paths(spark, d).where("rank = 'species'").where(taxonomy.outside_clades("r2")).select("taxid")


@query("taxonomy_required_rank", "SELECT 'c' || c_custkey AS taxid FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation")
def _(spark, d):
    return paths(spark, d).where(taxonomy.has_rank("genus", "family")).select("taxid")


@query("taxonomy_resolve", "SELECT o_orderkey, 'c' || o_custkey * 2 AS taxid, o_custkey * 2 IN (SELECT c_custkey FROM customer) AS known FROM orders")
def _(spark, d):
    asked = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("tx:c"), (F.col("o_custkey") * 2).cast("string"), F.lit(" [name]@species")).alias("taxid"))
    return taxonomy.resolve(asked, taxa(spark, d)).select("o_orderkey", "taxid", F.col("__known").alias("known"))


# --- annotation ---------------------------------------------------------------


@query("clear", f"SELECT id, CAST(0 AS BIGINT) AS keys, CAST(1 AS BIGINT) AS count FROM {REC}")
def _(spark, d):
    return annotate.clear(records(spark, d)).select("id", F.size(annotation_keys()).cast("bigint").alias("keys"), "count")


@query("keep_keys", f"SELECT id, lang, CAST(CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS BIGINT) AS keys FROM {REC}")
def _(spark, d):
    return annotate.keep_keys(records(spark, d), "lang").select("id", attribute("lang").alias("lang"), F.size(annotation_keys()).cast("bigint").alias("keys"))


@query("set_identifier", f"SELECT source || '_' || id AS id, s AS sequence FROM {REC}")
def _(spark, d):
    return annotate.set_id(records(spark, d), 'annotations.sample + "_" + sequence.Id()').select("id", "sequence")


@query("add_length", f"SELECT id, CAST(length(s) AS BIGINT) AS seq_length FROM {REC}")
def _(spark, d):
    return annotate.add_length(records(spark, d)).select("id", attribute("seq_length", "bigint").alias("seq_length"))


@query("subsequence", f"SELECT id || '_sub[11..60]' AS id, substring(s, 11, 50) AS sequence FROM {REC} WHERE length(s) >= 60")
def _(spark, d):
    return annotate.subsequence(filters.keep(records(spark, d), filters.length_between(60)), 10, 60).select("id", "sequence")


@query("subsequence_circular", f"SELECT id || '_sub[51..10]' AS id, substring(s, 51) || substring(s, 1, 10) AS sequence FROM {REC} WHERE length(s) >= 60")
def _(spark, d):
    return annotate.subsequence(filters.keep(records(spark, d), filters.length_between(60)), 50, 10, circular=True).select("id", "sequence")


@query("concatenate", f"SELECT id, s || {RC.format('s')} AS sequence FROM {REC}")
def _(spark, d):
    return annotate.concatenate(records(spark, d).withColumn("other", S.revcomp("sequence")), "other").select("id", "sequence")


@query("merge_slot", f"SELECT id, coalesce(lang, 'NA') AS lang, CAST(1 AS BIGINT) AS weight FROM {REC}")
def _(spark, d):
    return annotate.merge_slot(records(spark, d), "lang").select("id", F.explode("merged.lang").alias("lang", "weight"))


@query("map_sums", f"SELECT coalesce(source, 'NA') AS value, count(*) AS weight FROM {REC} GROUP BY 1")
def _(spark, d):
    return aggregate.map_sums(aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[]), "sample")


@query("class_predicate", f"SELECT CAST(length(s) > 500 AND lang = 'en' AS VARCHAR) AS class, count(*) AS n FROM {REC} GROUP BY 1".replace("CAST(length(s) > 500 AND lang = 'en' AS VARCHAR)", "CAST(coalesce(length(s) > 500 AND lang = 'en', false) AS VARCHAR)"))
def _(spark, d):
    p = filters.expression('len(sequence) > 500 && annotations.lang == "en"')
    return records(spark, d).groupBy(aggregate.class_predicate(p).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("class_composite", f"SELECT coalesce(source, 'NA') || ':' || ((doc_id % 5) + 1) AS class, count(*) AS n FROM {REC} GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(aggregate.class_composite(aggregate.class_attribute("sample"), aggregate.class_rotate(5)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "expression_functions",
    f"""SELECT id, CAST(length(s) AS DOUBLE) AS n, CASE WHEN length(s) > 0 THEN round((length(s) - length(replace(replace(s, 'g', ''), 'c', ''))) / length(s), 9) END AS gc,
    CASE WHEN length(s) > 700 THEN 'long' ELSE 'short' END AS size, CASE WHEN length(s) >= 6 THEN substring(s, 3, 4) END AS part, replace('d ' || source, ' ', '_') AS plain, source || '/' || id AS printed,
    CAST(doc_id AS BIGINT) AS number, lang IS NOT NULL AS has_lang FROM {REC}""",
)
def _(spark, d):
    r = set_attributes(records(spark, d), {"m": F.create_map(F.coalesce(attribute("lang"), F.lit("none")), F.lit(1)), "number": F.col("input_order").cast("string")})
    texts = {"n": "len(sequence)", "gc": "gc(sequence)", "size": 'ifelse(len(sequence) > 700, "long", "short")', "part": "substr(sequence.Sequence(), 2, 4)", "plain": 'subspc("d " + annotations.sample)', "printed": 'sprintf("%s/%s", annotations.sample, sequence.Id())', "number": "int(annotations.number)", "has_lang": '!contains(annotations.m, "none")'}
    out = r.select("id", *[value(t).alias(c) for c, t in texts.items()])
    return out.withColumns({"n": F.col("n").cast("double"), "gc": F.round("gc", 9), "number": F.col("number").cast("bigint")})


# --- sorts and limits ---------------------------------------------------------


@query("head", f"SELECT id, s AS sequence FROM {REC} ORDER BY doc_id LIMIT 25 OFFSET 10")
def _(spark, d):
    return joins.head(records(spark, d), 25, 10).select("id", "sequence")


@query("longest", f"SELECT id, CAST(length(s) AS BIGINT) AS n FROM {REC} ORDER BY length(s) DESC, id LIMIT 15")
def _(spark, d):
    return joins.sort_records(records(spark, d), "length").limit(15).select("id", F.length("sequence").cast("bigint").alias("n"))


# --- taxonomy -----------------------------------------------------------------

LINEAGE = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("taxonomic_path", f"SELECT c_name AS id, '[\"1@root@no rank\",\"r' || r_regionkey || '@' || r_name || '@family\",\"n' || n_nationkey || '@' || n_name || '@genus\",\"c' || c_custkey || '@' || c_name || '@species\"]' AS path FROM {LINEAGE}")
def _(spark, d):
    out = taxonomy.annotate_path(taxonomy.with_lineage(_customers(spark, d), paths(spark, d)))
    return out.select("id", F.try_element_at("annotations", F.lit("taxonomic_path")).alias("path"))


@query("taxonomic_rank", "SELECT c_name AS id, 'species' AS rank, c_name AS name FROM customer")
def _(spark, d):
    out = taxonomy.annotate_taxon(taxonomy.with_lineage(_customers(spark, d), paths(spark, d)))
    return out.select("id", attribute("taxonomic_rank").alias("rank"), attribute("scientific_name").alias("name"))


@query("annotate_ranks", f"SELECT c_name AS id, 'n' || n_nationkey AS genus, r_name AS family, 'NA' AS phylum FROM {LINEAGE}")
def _(spark, d):
    out = taxonomy.annotate_rank(taxonomy.with_lineage(_customers(spark, d), paths(spark, d)), "genus", "family", "phylum")
    return out.select("id", attribute("genus_taxid").alias("genus"), attribute("family_name").alias("family"), attribute("phylum_taxid").alias("phylum"))


@query("lca_pair", "SELECT c_custkey, CASE WHEN a.n_nationkey = b.n_nationkey THEN 'n' || b.n_nationkey WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE '1' END AS lca FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON c_custkey % 25 = b.n_nationkey")
def _(spark, d):
    p = paths(spark, d).select("taxid", "path")
    pairs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), F.col("c_custkey") % 25).alias("b"))
    both = pairs.join(p.select(F.col("taxid").alias("a"), F.col("path").alias("pa")), "a").join(p.select(F.col("taxid").alias("b"), F.col("path").alias("pb")), "b")
    return both.select("c_custkey", taxonomy.lca("pa", "pb")["taxid"].alias("lca"))


BOUGHT = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(
    "annotate_lca",
    f"""WITH r AS (SELECT l_suppkey AS g, n_regionkey AS k, count(*) AS w FROM {BOUGHT} GROUP BY ALL), t AS (SELECT g, sum(w) AS w FROM r GROUP BY g),
    best AS (SELECT g, k, w FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY w DESC, 'r' || k) = 1),
    n AS (SELECT l_suppkey AS g, n_nationkey AS k, n_regionkey AS up, count(*) AS w FROM {BOUGHT} GROUP BY ALL),
    bn AS (SELECT n.g, n.k, n.w FROM n JOIN best ON n.g = best.g AND n.up = best.k QUALIFY row_number() OVER (PARTITION BY n.g ORDER BY n.w DESC, 'n' || n.k) = 1)
    SELECT CAST(t.g AS VARCHAR) AS id, CASE WHEN best.w / t.w < 0.25 THEN '1' WHEN best.w / t.w * (bn.w / best.w) < 0.25 THEN 'r' || best.k ELSE 'n' || bn.k END AS taxid
    FROM t JOIN best USING (g) JOIN bn USING (g)""",
)
def _(spark, d):
    nations = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("l_suppkey is not null and c_nationkey is not null")
    counts = nations.groupBy("l_suppkey", F.concat(F.lit("n"), "c_nationkey").alias("taxid")).agg(F.count(F.lit(1)).alias("w"))
    own = counts.groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("taxid", "w"))).alias("m"))  # at most one entry for each nation
    out = taxonomy.annotate_lca(as_records(own.select("id", F.lit("").alias("sequence"), F.create_map(F.lit("taxid"), "m").alias("merged"))), paths(spark, d), "common", error=0.75)
    return out.select("id", attribute("common_taxid").alias("taxid")).where("taxid is not null")  # a supplier of known nations only


# --- k-mers -------------------------------------------------------------------

BENCH_KMERS = f"(SELECT DISTINCT least(k, {RC.format('k')}) AS kmer FROM (SELECT unnest(list_transform(range(1, length(s) - 6), lambda i: substring(s, i, 8))) AS k FROM {B} WHERE length(s) >= 8))"


@query("kmer_union_with", f"SELECT DISTINCT 'all' AS set_id, kmer FROM (SELECT kmer FROM {KMERS} UNION ALL SELECT kmer FROM {BENCH_KMERS})")
def _(spark, d):
    return kmers.union_with(kmers.build_index(records(spark, d), 8, "all"), kmers.build_index(_benchmark(spark, d), 8, "all"))


@query("kmer_intersect_with", f"SELECT DISTINCT 'all' AS set_id, kmer FROM {KMERS} WHERE kmer IN (SELECT kmer FROM {BENCH_KMERS})")
def _(spark, d):
    return kmers.intersect_with(kmers.build_index(records(spark, d), 8, "all"), kmers.build_index(_benchmark(spark, d), 8, "all"))


@query("kmer_contains", f"SELECT set_id, kmer FROM {SETS} WHERE kmer IN (SELECT kmer FROM {BENCH_KMERS})")
def _(spark, d):
    return kmers.contains(_index(spark, d), kmers.build_index(_benchmark(spark, d), 8, "all")).select("set_id", "kmer")


@query("kmer_copy_drop", f"SELECT set_id, count(*) AS kmers FROM {SETS} WHERE set_id LIKE 'e_' GROUP BY set_id UNION ALL SELECT 'others', count(*) FROM {SETS} WHERE set_id NOT LIKE 'e_'")
def _(spark, d):
    index = _index(spark, d)
    copied = kmers.copy_sets(index, "e?").groupBy("set_id").agg(F.count(F.lit(1)).alias("kmers"))
    return copied.union(kmers.drop_sets(index, "e?").agg(F.lit("others").alias("set_id"), F.count(F.lit(1)).alias("kmers")))


@query("fourmer_profile", f"SELECT id, w AS word, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4))) AS w FROM {B} WHERE length(s) >= 4) GROUP BY ALL")
def _(spark, d):
    return _benchmark(spark, d).where(F.length("sequence") >= 4).select("id", F.explode(kmers.fourmer_profile()).alias("word", "n")).select("id", "word", F.col("n").cast("bigint").alias("n"))


# --- errors -------------------------------------------------------------------


PARTS = "(SELECT 'all' AS sample, substring(md5(CAST(l_partkey AS VARCHAR)), 1, 4) AS m, count(*) AS n FROM lineitem GROUP BY ALL)"
LETTERS = "(SELECT l_returnflag AS sample, translate(substring(md5(CAST(l_partkey AS VARCHAR)), 1, 4), '0123456789abcdef', 'acgtacgtacgtacgt') AS m, count(*) AS n FROM lineitem GROUP BY ALL)"


def _nodes(spark, d, sample, letters):
    word = F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 4)
    word = F.translate(word, "0123456789abcdef", "acgtacgtacgtacgt") if letters else word
    return table(spark, d, "lineitem").groupBy(sample.alias("sample"), word.alias("sequence")).agg(F.count(F.lit(1)).alias("n")).select("sample", F.col("sequence").alias("id"), "sequence", "n")


@query(
    "error_ratios",
    f"""WITH v AS MATERIALIZED {PARTS}, e AS (SELECT a.m AS father, b.m AS son, a.n AS nf, b.n AS ns FROM v a JOIN v b ON a.n > b.n AND hamming(a.m, b.m) = 1)
    SELECT substring(father, p, 1) AS "from", substring(son, p, 1) AS "to", count(*) AS edges, round(avg(ns / nf), 9) AS ratio FROM e, LATERAL (SELECT unnest(range(1, 5)) AS p) WHERE substring(father, p, 1) <> substring(son, p, 1) GROUP BY ALL""",
)
def _(spark, d):
    return denoise.ratio_table(denoise.error_edges(_nodes(spark, d, F.lit("all"), False))).select("from", "to", "edges", F.round("ratio", 9).alias("ratio"))


@query(
    "error_status",
    f"""WITH v AS MATERIALIZED {LETTERS}, e AS (SELECT a.sample AS sample, a.m AS father, b.m AS son FROM v a JOIN v b ON a.sample = b.sample AND a.n > b.n AND hamming(a.m, b.m) = 1)
    SELECT sample, m AS id, CASE WHEN (sample, m) IN (SELECT (sample, son) FROM e) THEN 'i' WHEN (sample, m) IN (SELECT (sample, father) FROM e) THEN 'h' ELSE 's' END AS status FROM v""",
)
def _(spark, d):
    nodes = _nodes(spark, d, F.col("l_returnflag"), True)
    return denoise.status(nodes, denoise.error_edges(nodes))
