"""One query per operator over the driver's tables, and the SQL for the same rows.

Documents become records: the letters a, c, g and t of the whole lower-case text are the sequence,
``source`` is the sample and ``lang`` an attribute. Regions, nations and customers are a taxonomy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions.expressions import value
from strandloom.operators import aggregate, annotate, denoise, filters, joins, kmers, patterns, reads, taxonomy
from strandloom.operators.assign import nearest_in_space
from strandloom.records import as_records, attribute, set_attributes
from strandloom.streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Records in DuckDB.
REC = "(SELECT doc_id, 'd' || doc_id AS id, regexp_replace(lower(text), '[^acgt]', '', 'g') AS s, lang, source FROM documents)"
RC = "reverse(translate({0}, 'acgt', 'tgca'))"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))  # noqa: E731  their values need no escapes
    notes = F.map_filter(F.create_map(F.lit("lang"), quoted("lang"), F.lit("sample"), quoted("source")), lambda _, v: v.isNotNull())
    return as_records(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("sequence"), F.col("doc_id").alias("input_order"), notes.alias("annotations"), "source"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.createDataFrame([("1", "1", "no rank", "root")], "taxid string, parent string, rank string, scientific_name string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("taxid"), F.lit("1").alias("parent"), F.lit("family").alias("rank"), F.col("r_name").alias("scientific_name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("genus"), "n_name")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("species"), "c_name")
    return root.union(r).union(n).union(c)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.with_paths(taxa(spark, sf_dir))


# --- predicates ---------------------------------------------------------------


@query("filter_length", f"SELECT id, CAST(length(s) AS BIGINT) AS n FROM {REC} WHERE length(s) BETWEEN 200 AND 5000")
def _(spark, d):
    return filters.keep(records(spark, d), filters.length_between(200, 5000)).select("id", F.length("sequence").cast("bigint").alias("n"))


@query("filter_attribute_regex", f"SELECT id, lang FROM {REC} WHERE regexp_matches(lang, '^[ef]')")
def _(spark, d):
    return filters.keep(records(spark, d), filters.attribute_matches({"lang": "^[ef]"})).select("id", attribute("lang").alias("lang"))


@query("filter_sequence_regex", f"SELECT id FROM {REC} WHERE regexp_matches(s, 'aca[ct]t+g')")
def _(spark, d):
    return filters.keep(records(spark, d), filters.sequence_matches("ACA[CT]T+G")).select("id")


@query("filter_expression", f"SELECT id FROM {REC} WHERE length(s) > 300 AND lang = 'fr' OR length(s) > 0 AND (length(s) - length(replace(replace(s, 'g', ''), 'c', ''))) / length(s) > 0.32")
def _(spark, d):
    return filters.keep(records(spark, d), filters.expression('len(sequence) > 300 && annotations.lang == "fr" || gc(sequence) > 0.32')).select("id")


@query("filter_inverse", f"SELECT id FROM {REC} WHERE NOT (length(s) >= 500 AND coalesce(lang = 'en', false))")
def _(spark, d):
    return filters.keep(records(spark, d), filters.selection(min_length=500, expressions=['annotations.lang == "en"'], inverse=True)).select("id")


@query("filter_id_list", f"SELECT id FROM {REC} WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return filters.keep_ids(records(spark, d), table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")))).select("id")


@query("filter_iupac", f"SELECT id FROM {REC} WHERE regexp_matches(s, 'ac[ag]t[acgt]c[ct]t') OR regexp_matches({RC.format('s')}, 'ac[ag]t[acgt]c[ct]t')")
def _(spark, d):
    return filters.keep(records(spark, d), filters.pattern_matches("acrtncyt")).select("id")


def _hits(pattern: str, errors: int, s: str = "s") -> str:
    """DuckDB: the 1-based places of ``s`` where the pattern, whose n match anything, has at most so many mismatches."""
    parts = [(m.start(), m[0]) for m in re.finditer("[acgt]+", pattern)]
    window = " || ".join(f"substring({s}, i + {a}, {len(t)})" for a, t in parts)
    return f"list_filter(range(1, length({s}) - {len(pattern) - 2}), lambda i: hamming({window}, '{''.join(t for _, t in parts)}') <= {errors})"


@query("filter_approximate", f"SELECT id FROM {REC} WHERE length(s) >= 10 AND len({_hits('acgtacgtgg', 2)}) + len({_hits('ccacgtacgt', 2)}) > 0")
def _(spark, d):
    return filters.keep(records(spark, d), filters.pattern_matches("acgtacgtgg", errors=2)).select("id")


@query("divide", f"SELECT id, length(s) >= 800 AS kept FROM {REC}")
def _(spark, d):
    kept, gone = filters.divide(records(spark, d), filters.length_between(800))
    return kept.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False)))


# --- annotation ---------------------------------------------------------------


@query(
    "sequence_facts",
    f"""SELECT id, md5(s) AS md5, md5({RC.format('s')}) AS rc_md5, CAST(length(s) AS BIGINT) AS n,
    CAST(length(s) - length(replace(s, 'a', '')) AS BIGINT) AS a, CAST(length(s) - length(replace(s, 'c', '')) AS BIGINT) AS c,
    CASE WHEN length(s) > 0 THEN round((length(s) - length(replace(replace(s, 'g', ''), 'c', ''))) / length(s), 9) END AS gc,
    CASE WHEN length(s) > length(replace(replace(s, 'g', ''), 'c', '')) THEN round((length(replace(s, 'c', '')) - length(replace(s, 'g', ''))) / (length(s) - length(replace(replace(s, 'g', ''), 'c', ''))), 9) END AS skew FROM {REC}""",
)
def _(spark, d):
    c = S.composition("sequence")
    return records(spark, d).select("id", F.md5("sequence").alias("md5"), F.md5(S.revcomp("sequence")).alias("rc_md5"), F.length("sequence").cast("bigint").alias("n"), c["a"].alias("a"), c["c"].alias("c"), F.round(S.gc("sequence"), 9).alias("gc"), F.round(S.gc_skew("sequence"), 9).alias("skew"))


@query("reverse_complement", f"SELECT id, {RC.format('s')} AS sequence FROM {REC}")
def _(spark, d):
    return annotate.reverse_complement(records(spark, d)).select("id", "sequence")


@query("cut", f"SELECT id, substring(s, 5, greatest(length(s) - 13, 0)) AS sequence FROM {REC}")
def _(spark, d):
    return annotate.cut(records(spark, d), 5, -10).select("id", "sequence")


@query("fragment", f"""SELECT id || '_frg[' || (i * 150 + 1) || '..' || CASE WHEN i = n - 1 THEN length(s) ELSE i * 150 + 200 END || ']' AS id, CASE WHEN i = n - 1 THEN substring(s, i * 150 + 1) ELSE substring(s, i * 150 + 1, 200) END AS sequence
  FROM (SELECT *, (length(s) - 200) // 150 + 1 AS n FROM {REC} WHERE length(s) > 400) t, LATERAL (SELECT unnest(range(0, n)) AS i)
  UNION ALL SELECT id, s FROM {REC} WHERE length(s) <= 400""")
def _(spark, d):
    return annotate.fragment(records(spark, d), 400, 200, 50).select("id", "sequence")


@query("set_keys", f"SELECT id, upper(lang) AS up, CAST(length(s) AS DOUBLE) / 2 AS half FROM {REC}".replace("upper(lang)", "lang || '_' || source"))
def _(spark, d):
    out = annotate.set_keys(records(spark, d), {"up": 'annotations.lang + "_" + annotations.sample', "half": "len(sequence) / 2"})
    return out.select("id", attribute("up").alias("up"), attribute("half", "double").alias("half"))


@query("rename_delete_keys", f"SELECT id, lang AS language, CAST(NULL AS VARCHAR) AS sample FROM {REC}")
def _(spark, d):
    out = annotate.delete_keys(annotate.rename_key(records(spark, d), "lang", "language"), "sample")
    return out.select("id", attribute("language").alias("language"), attribute("sample").alias("sample"))


@query("number", f"SELECT id, row_number() OVER (ORDER BY doc_id) AS seq_number FROM {REC}")
def _(spark, d):
    return annotate.number(records(spark, d)).select("id", attribute("seq_number", "bigint").alias("seq_number"))


@query("expression_value", f"SELECT id, CASE WHEN length(s) > 1000 THEN 'long' ELSE 'short' END AS size, replace(s, 'ac', 'x') AS edited FROM {REC}")
def _(spark, d):
    return records(spark, d).select("id", value('len(sequence) > 1000 ? "long" : "short"').alias("size"), value('replace(sequence.Sequence(), "ac", "x")').alias("edited"))


@query("count_literals", f"SELECT id, CAST(len(string_split(s, 'acat')) - 1 AS BIGINT) AS hits FROM {REC} WHERE contains(s, 'acat')")
def _(spark, d):
    out = annotate.count_literals(records(spark, d), ["acat"])
    return out.select("id", attribute("literal_Fwd", "bigint").alias("hits")).where("hits is not null")


# --- aggregation --------------------------------------------------------------


@query(
    "dereplicate",
    f"""SELECT md5(s) AS md5, count(*) AS count, 'd' || min(doc_id) AS id, CASE WHEN count(DISTINCT lang) = 1 AND count(lang) = count(*) THEN min(lang) END AS lang FROM {REC} GROUP BY s""",
)
def _(spark, d):
    out = aggregate.dereplicate(records(spark, d))
    return out.select(F.md5("sequence").alias("md5"), "count", "id", attribute("lang").alias("lang"))


@query("dereplicate_categories", f"SELECT md5(s) AS md5, coalesce(lang, 'NA') AS lang, count(*) AS count FROM {REC} GROUP BY s, lang HAVING count(*) > 1")
def _(spark, d):
    out = aggregate.dereplicate(records(spark, d), categories=["lang"], drop_singletons=True, keep_attributes=[])
    return out.select(F.md5("sequence").alias("md5"), attribute("lang").alias("lang"), "count")


MERGED = f"SELECT md5(s) AS md5, source AS sample, count(*) AS weight FROM {REC} GROUP BY s, source"


@query("dereplicate_histogram", MERGED)
def _(spark, d):
    out = aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[])
    return out.select(F.md5("sequence").alias("md5"), F.explode("merged.sample").alias("sample", "weight"))


@query("demerge", MERGED.replace("AS weight", "AS count"))
def _(spark, d):
    out = annotate.demerge(aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[]), "sample")
    return out.select(F.md5("sequence").alias("md5"), attribute("sample").alias("sample"), "count")


@query("count_records", f"SELECT count(*) AS variants, CAST(count(*) AS BIGINT) AS reads, CAST(sum(length(s)) AS BIGINT) AS symbols FROM {REC}")
def _(spark, d):
    return aggregate.count_records(records(spark, d))


@query("sample_summary", f"SELECT sample, CAST(sum(weight) AS BIGINT) AS reads, count(*) AS variants, count(*) FILTER (weight = 1) AS singletons FROM ({MERGED}) GROUP BY sample")
def _(spark, d):
    return aggregate.sample_summary(aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[])).drop("bad")


@query("attribute_census", f"SELECT 'lang' AS key, 'scalar' AS kind, count(lang) AS records FROM {REC} UNION ALL SELECT 'sample', 'scalar', count(source) FROM {REC} UNION ALL SELECT 'count', 'scalar', count(*) FROM {REC}")
def _(spark, d):
    return aggregate.attribute_census(records(spark, d))


@query("matrix_long", f"WITH m AS (SELECT s, source AS sample, doc_id FROM {REC}), i AS (SELECT s, 'd' || min(doc_id) AS id FROM m GROUP BY s) SELECT id, sample, count(*) AS count FROM m JOIN i USING (s) GROUP BY id, sample")
def _(spark, d):
    return aggregate.matrix_long(aggregate.dereplicate(records(spark, d), merge=["sample"], keep_attributes=[]))


#: The sources of the driver's documents.
SOURCES = [f"src{i}" for i in range(20)]


@query("matrix", f"SELECT coalesce(lang, 'NA') AS id, {', '.join(f"count(*) FILTER (source = '{x}') AS {x}" for x in SOURCES)} FROM {REC} GROUP BY 1")
def _(spark, d):
    by_lang = aggregate.dereplicate(records(spark, d).withColumn("sequence", aggregate.class_attribute("lang")), merge=["sample"], keep_attributes=[]).withColumn("id", F.col("sequence"))
    return aggregate.matrix(by_lang, transpose=False)


@query("class_rotate", f"SELECT (doc_id % 7) + 1 AS class, count(*) AS n FROM {REC} GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(aggregate.class_rotate(7).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("class_pair", f"SELECT coalesce(lang, 'NA') || '_' || coalesce(source, 'NA') AS class, count(*) AS n FROM {REC} GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(aggregate.class_pair("lang", "sample").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _crc32_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


CRC32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: xor(h >> 8, {_crc32_table()}[(xor(h, c) & 255) + 1])), 4294967295)"


@query("class_hash", f"SELECT CAST(CASE WHEN s = '' THEN 0 ELSE {CRC32} END % 100 AS BIGINT) AS class, count(*) AS n FROM {REC} GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(aggregate.class_hash(100).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# --- joins, sets, sorts -------------------------------------------------------


@query("annotate_from", "SELECT 'd' || d.doc_id AS id, CAST(l.quality AS BIGINT) AS quality, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'rated' END, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    labels = as_records(table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("sequence"), "quality"))
    labels = set_attributes(labels, {"quality": F.col("quality"), "lang": F.lit("rated")})
    return joins.annotate_from(records(spark, d), labels).select("id", attribute("quality", "bigint").alias("quality"), attribute("lang").alias("lang"))


@query("pair_up", f"SELECT a.id AS id, {RC.format('b.s')} AS mate FROM {REC} a JOIN {REC} b USING (doc_id)")
def _(spark, d):
    r = records(spark, d)
    return joins.pair_up(r, annotate.reverse_complement(r)).select("id", F.col("mate.sequence").alias("mate"))


@query("concat", f"SELECT id, s AS sequence FROM {REC} UNION ALL SELECT 'b' || item_id, regexp_replace(lower(text), '[^acgt]', '', 'g') FROM benchmark")
def _(spark, d):
    b = as_records(table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("sequence")))
    return joins.concat(records(spark, d), b).select("id", "sequence")


@query("top_by_count", f"SELECT md5(s) AS md5, count(*) AS count FROM {REC} GROUP BY s ORDER BY count(*) DESC, 'd' || min(doc_id) LIMIT 20")
def _(spark, d):
    out = aggregate.dereplicate(records(spark, d), keep_attributes=[])
    return joins.sort_records(out).limit(20).select(F.md5("sequence").alias("md5"), "count")


# --- taxonomy -----------------------------------------------------------------

TAXA = """(SELECT '1' AS taxid, '1' AS parent, 'no rank' AS rank, 'root' AS scientific_name UNION ALL SELECT 'r' || r_regionkey, '1', 'family', r_name FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'genus', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'species', c_name FROM customer)"""


@query("taxonomy_paths", f"WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM {TAXA}), p AS (SELECT taxid, taxid AS path FROM t WHERE taxid = parent UNION ALL SELECT t.taxid, p.path || '|' || t.taxid FROM t JOIN p ON t.parent = p.taxid WHERE t.taxid <> t.parent) SELECT * FROM p")
def _(spark, d):
    return paths(spark, d).select("taxid", F.array_join("path.taxid", "|").alias("path"))


@query("taxonomy_subclade", f"SELECT 'c' || c_custkey AS taxid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'r2'")
def _(spark, d):
    return taxonomy.subclade(paths(spark, d), "r2").select("taxid")


@query("taxonomy_rank", "SELECT 'c' || c_custkey AS taxid, r_name AS family FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    return paths(spark, d).where("rank = 'species'").select("taxid", taxonomy.at_rank("family")["name"].alias("family"))


@query("taxonomy_names", f"SELECT taxid FROM {TAXA} WHERE regexp_matches(scientific_name, '(?i)ica$|^nation_1')")
def _(spark, d):
    return taxonomy.named(taxa(spark, d), "ica$|^nation_1").select("taxid")


@query("taxonomy_parents", "SELECT CAST(0 AS BIGINT) AS depth, 'n3' AS taxid UNION ALL SELECT 1, 'r' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 2, '1'")
def _(spark, d):
    return taxonomy.parents(paths(spark, d), "n3").select(F.col("depth").cast("bigint").alias("depth"), "taxid")


@query("taxonomy_sons", "SELECT 'n' || n_nationkey AS taxid FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    return taxonomy.sons(taxa(spark, d), "r1").select("taxid")


@query("taxonomy_ranks", f"SELECT DISTINCT rank FROM {TAXA}")
def _(spark, d):
    return taxonomy.ranks(taxa(spark, d))


@query("taxonomy_sub_tree", "SELECT '1' AS taxid UNION ALL SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'n7' UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 7")
def _(spark, d):
    return taxonomy.sub_taxonomy(paths(spark, d), "n7").select("taxid")


@query(
    "lca",
    """SELECT CASE WHEN count(DISTINCT c_custkey) = 1 THEN 'c' || min(c_custkey) WHEN count(DISTINCT n_nationkey) = 1 THEN 'n' || min(n_nationkey) WHEN count(DISTINCT n_regionkey) = 1 THEN 'r' || min(n_regionkey) ELSE '1' END AS lca, l_partkey AS part
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY l_partkey""",
)
def _(spark, d):
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", F.concat(F.lit("c"), "o_custkey").alias("taxid")).agg(F.count(F.lit(1)).alias("w"))
    per = taxonomy.with_lineage(bought, paths(spark, d)).where("path is not null").groupBy("l_partkey").agg(F.collect_list(F.struct("path", F.col("w").cast("double").alias("weight"))).alias("e"))
    return per.select(taxonomy.weighted_lca(F.col("e"))["taxid"].alias("lca"), F.col("l_partkey").alias("part"))


# --- k-mers -------------------------------------------------------------------

KMERS = f"(SELECT id, source, lang, least(k, {RC.format('k')}) AS kmer FROM (SELECT id, source, lang, unnest(list_transform(range(1, length(s) - 6), lambda i: substring(s, i, 8))) AS k FROM {REC} WHERE length(s) >= 8))"


@query("kmer_counts", f"SELECT kmer, count(*) AS n FROM {KMERS} GROUP BY kmer")
def _(spark, d):
    return kmers.count_kmers(records(spark, d), 8)


@query("kmer_spectrum", f"SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM {KMERS} GROUP BY kmer) GROUP BY n")
def _(spark, d):
    return kmers.spectrum(kmers.count_kmers(records(spark, d), 8))


@query("kmer_top", f"SELECT kmer, count(*) AS n FROM {KMERS} GROUP BY kmer ORDER BY n DESC, kmer LIMIT 25")
def _(spark, d):
    return kmers.top_kmers(kmers.count_kmers(records(spark, d), 8), 25)


def _index(spark, d):
    return kmers.build_index(records(spark, d), 8, attribute("lang"))


SETS = f"(SELECT DISTINCT lang AS set_id, kmer FROM {KMERS})"


@query("kmer_index", f"SELECT lang AS set_id, kmer, count(*) AS n FROM {KMERS} GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500")
def _(spark, d):
    return kmers.build_index(records(spark, d), 8, attribute("lang"), min_count=2, max_count=500)


@query("kmer_union", f"SELECT DISTINCT kmer FROM {SETS}")
def _(spark, d):
    return kmers.union(_index(spark, d))


@query("kmer_intersect", f"SELECT kmer FROM {SETS} GROUP BY kmer HAVING count(*) = (SELECT count(DISTINCT set_id) FROM {SETS})")
def _(spark, d):
    return kmers.intersect(_index(spark, d))


@query("kmer_difference", f"SELECT kmer FROM {SETS} GROUP BY kmer HAVING bool_and(set_id = 'en')")
def _(spark, d):
    return kmers.difference(_index(spark, d), "en")


@query("kmer_quorum", f"SELECT kmer FROM {SETS} GROUP BY kmer HAVING count(*) >= 2 AND count(*) <= 3")
def _(spark, d):
    return kmers.quorum(_index(spark, d), at_least=2, at_most=3)


@query("kmer_jaccard", f"WITH s AS MATERIALIZED {SETS}, z AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1) SELECT a.set_id AS set_i, b.set_id AS set_j, count(*) AS shared, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 9) AS jaccard FROM s a JOIN s b ON a.kmer = b.kmer AND a.set_id < b.set_id JOIN z x ON x.set_id = a.set_id JOIN z y ON y.set_id = b.set_id GROUP BY a.set_id, b.set_id")
def _(spark, d):
    return kmers.jaccard(_index(spark, d)).withColumn("jaccard", F.round("jaccard", 9))


B = "(SELECT 'b' || item_id AS id, regexp_replace(lower(text), '[^acgt]', '', 'g') AS s FROM benchmark)"
BK = f"(SELECT DISTINCT id, least(k, {RC.format('k')}) AS kmer FROM (SELECT id, unnest(list_transform(range(1, length(s) - 10), lambda i: substring(s, i, 12))) AS k FROM {B} WHERE length(s) >= 12))"
DK = BK.replace(B, REC)


def _benchmark(spark, d):
    return as_records(table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("sequence")))


@query("kmer_shared", f"SELECT d.id AS query, b.id AS reference, count(*) AS shared FROM {DK} d JOIN {BK} b USING (kmer) GROUP BY ALL HAVING count(*) >= 5")
def _(spark, d):
    return kmers.shared_counts(records(spark, d), _benchmark(spark, d), 12, 5)


@query("kmer_match", f"""WITH r AS (SELECT DISTINCT kmer FROM {BK}), p AS (SELECT id, i, substring(s, i, 12) AS k FROM (SELECT id, s, unnest(range(1, length(s) - 10)) AS i FROM {REC} WHERE length(s) >= 12))
 SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM p JOIN r ON least(k, {RC.format('k')}) = r.kmer GROUP BY id""")
def _(spark, d):
    out = kmers.match_positions(records(spark, d), kmers.build_index(_benchmark(spark, d), 12), 12)
    return out.select("id", F.size("positions").cast("bigint").alias("n"), F.array_min("positions").cast("bigint").alias("first"), F.array_max("positions").cast("bigint").alias("last"))


@query(
    "superkmers",
    f"""WITH r AS (SELECT id, s, list_transform(range(1, length(s) - 7), lambda i: least(substring(s, i, 9), {RC.format('substring(s, i, 9)')})) AS words FROM {REC} WHERE length(s) >= 21),
    p AS (SELECT id, s, i, list_min(list_slice(words, i, i + 12)) AS z FROM (SELECT *, unnest(range(1, length(s) - 19)) AS i FROM r)),
    runs AS (SELECT *, sum(CASE WHEN z = before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, lag(z) OVER (PARTITION BY id ORDER BY i) AS before FROM p)),
    g AS (SELECT id AS parent_id, any_value(s) AS s, any_value(z) AS z, min(i) - 1 AS a, max(i) + 20 AS b FROM runs GROUP BY id, run)
    SELECT parent_id, parent_id || '_superkmer_' || a || '_' || b AS id, substring(s, a + 1, b - a) AS sequence, CAST(list_sum(list_transform(range(1, 10), lambda i: (instr('acgt', substring(z, i, 1)) - 1) * CAST(4 ** (9 - i) AS BIGINT))) AS BIGINT) AS minimizer_value, z AS minimizer_seq,
    21 AS k, 9 AS m, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM g""",
)
def _(spark, d):
    return kmers.superkmers(records(spark, d), 21, 9)


# --- distances and kernels ----------------------------------------------------


@query("one_difference_pairs", "SELECT a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON a.c_name < b.c_name AND substring(a.c_name, 1, 13) = substring(b.c_name, 1, 13) AND hamming(a.c_name, b.c_name) = 1 UNION ALL SELECT a.c_name, b.c_name FROM customer a JOIN customer b ON a.c_name < b.c_name AND substring(a.c_name, 14) = substring(b.c_name, 14) AND hamming(a.c_name, b.c_name) = 1")
def _(spark, d):
    names = table(spark, d, "customer").select(F.lit("all").alias("sample"), F.col("c_name").alias("id"), F.col("c_name").alias("sequence"))
    return denoise.one_difference_pairs(names).select("a", "b")


@query("denoise_status")
def _(spark, d):
    reads_ = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 4).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    nodes = reads_.select("sample", F.col("m").alias("id"), F.translate("m", "0123456789abcdef", "acgtacgtacgtacgt").alias("sequence"), "n")
    nodes = nodes.groupBy("sample", F.col("sequence").alias("id"), "sequence").agg(F.sum("n").alias("n"))
    edges = denoise.error_edges(nodes)
    return denoise.status(nodes, edges).join(denoise.flow_weights(nodes, edges), ["sample", "id"]).select("sample", "id", "status", "weight")


@query("nearest_landmark", "SELECT a.vec_id AS vec_id, b.vec_id AS reference, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)), 6) AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE label = 0) b QUALIFY rank() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))) = 1")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    marks = vectors.where("label = 0")  # all vectors of one label are the references
    return nearest_in_space(vectors, marks, "embedding", "vec_id", cells=16).select("vec_id", "reference", F.round("distance", 6).alias("distance"))


def _amplicons(first: str, second: str) -> str:
    """DuckDB: what stands between a hit of the first pattern and one of the second behind it."""
    return f"SELECT id, i + 8 AS a, j - 1 AS b FROM (SELECT id, unnest({_hits(first, 1)}) AS i FROM {REC} WHERE length(s) >= 8) JOIN (SELECT id, unnest({_hits(second, 1)}) AS j FROM {REC} WHERE length(s) >= 8) USING (id) WHERE j - i - 8 BETWEEN 20 AND 300"


@query("pcr", f"SELECT id || '_sub[' || a || '..' || b || ']' AS id, CAST(b - a + 1 AS INTEGER) AS n FROM ({_amplicons('acatnaca', 'atnntcaa')} UNION ALL {_amplicons('ttgannat', 'tgtnatgt')})")
def _(spark, d):
    return patterns.pcr(records(spark, d), "acatnaca", "ttgannat", errors=1, min_length=20, max_length=300, fragment=2000).select("id", F.length("sequence").alias("n"))


@query(
    "microsatellites",
    f"""WITH u AS (SELECT id, s, i, u, substring(s, i, u) AS unit FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM {REC}), (SELECT unnest(range(1, 5)) AS u)
      WHERE i + 3 * u - 1 <= length(s) AND substring(s, i, 3 * u) = repeat(substring(s, i, u), 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i, u) = 1)
    SELECT id, list_min(list_transform(range(0, u), lambda k: least(substring(unit, k + 1) || substring(unit, 1, k), substring({RC.format('unit')}, k + 1) || substring({RC.format('unit')}, 1, k)))) AS unit FROM u""",
)
def _(spark, d):
    return patterns.microsatellites(records(spark, d), max_unit=4, min_count=3).select("id", attribute("microsat_unit_normalized").alias("unit"))


@query("split")
def _(spark, d):
    return patterns.split_on_patterns(records(spark, d), {"p": "acatnaca"}, errors=1).select("id", F.length("sequence").alias("n"))


@query("demultiplex")
def _(spark, d):
    marker = reads.Marker("acatnaca", "ttgannat", errors=1, forward_tag_length=2, reverse_tag_length=2, samples=tuple((a + b, c + e, "x", f"s{a}{b}{c}{e}") for a in "acgt" for b in "acgt" for c in "acgt" for e in "acgt"))
    return reads.demultiplex(records(spark, d), [marker]).select("id", attribute("sample").alias("sample"))


# --- events -------------------------------------------------------------------


@query("attributes_of_events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("annotations"))
    return e.select("event_id", attribute("k", "bigint").alias("k"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS weight FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").withColumn("weight", F.col("value"))
    return windowed_counts(e, "ts", "10 minutes", "1 hour", ["event_type"]).select("start", "event_type", "n", F.round("weight", 4).alias("weight"))
