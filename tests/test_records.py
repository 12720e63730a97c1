"""Records, expressions, filters, annotation and aggregation on the small fixtures."""

from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions.expressions import predicate, value
from strandloom.operators import aggregate, annotate, filters, joins
from strandloom.records import as_records, attribute, set_attributes


def to_uniq(spark):
    rows = [("seq1", "aaacccgggttt", 2, 4, 5), ("seq2", "aaacccgggttt", 3, 4, 5), ("seq3", "aaacccgggttt", 3, 5, 5), ("seq4", "aaacccgggttt", 3, 5, 6), ("seq5", "aaacccgggtttca", 2, 4, 5), ("seq6", "aaacccgggtttca", 3, 4, 5), ("seq7", "aaacccgggtttca", 3, 5, 5), ("seq8", "aaacccgggtttca", 3, 5, 6)]
    df = as_records(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "input_order long, id string, sequence string, a int, b int, c int"))
    return set_attributes(df, {k: F.col(k) for k in "abc"}).drop("a", "b", "c")


def found(df, *keys):
    return sorted((r["id"], r["count"], *(r[k] for k in keys)) for r in df.select("id", "count", *[attribute(k, "bigint").alias(k) for k in keys]).collect())


def test_dereplicate(spark):
    df = to_uniq(spark).cache()
    assert found(aggregate.dereplicate(df), "a", "b", "c") == [("seq1", 4, None, None, None), ("seq5", 4, None, None, None)]
    by_a = [("seq1", 1, 2, 4, 5), ("seq2", 3, 3, None, None), ("seq5", 1, 2, 4, 5), ("seq6", 3, 3, None, None)]
    key = lambda rows: sorted(rows, key=repr)
    assert key(found(aggregate.dereplicate(df, categories=["a"]), "a", "b", "c")) == key(by_a)
    assert [r[:2] for r in found(aggregate.dereplicate(df, categories=["a", "b"]))] == [("seq1", 1), ("seq2", 1), ("seq3", 2), ("seq5", 1), ("seq6", 1), ("seq7", 2)]
    merged = {r["id"]: r["merged"] for r in aggregate.dereplicate(df, merge=["a", "b"]).collect()}
    assert merged == {i: {"a": {"2": 1, "3": 3}, "b": {"4": 2, "5": 2}} for i in ("seq1", "seq5")}
    assert aggregate.dereplicate(df, categories=["a"], drop_singletons=True).count() == 2
    back = annotate.demerge(aggregate.dereplicate(df, merge=["a"]), "a")
    assert back.agg(F.sum("count")).first()[0] == 8 and back.count() == 4


def test_summary_and_matrix(spark):
    rows = [("Seq_1", {"15a": 1, "29a": 1}), ("Seq_2", {"15a": 12, "29a": 10}), ("Seq_3", {"15a": 15, "29a": 7})]
    df = as_records(spark.createDataFrame([(i, "a" * 100, sum(m.values()), {"sample": m}) for i, m in rows], "id string, sequence string, count long, merged map<string,map<string,long>>"))
    assert tuple(aggregate.count_records(df).first()) == (3, 46, 300)
    assert sorted(map(tuple, aggregate.sample_summary(df).drop("bad").collect())) == [("15a", 28, 3, 1), ("29a", 18, 3, 1)]
    assert {r["key"]: r["records"] for r in aggregate.attribute_census(df).collect()} == {"merged_sample": 3, "count": 3}
    m = {r["sample"]: r.asDict() for r in aggregate.matrix(df).collect()}
    assert m["15a"] == {"sample": "15a", "Seq_1": 1, "Seq_2": 12, "Seq_3": 15}


def test_sequence_functions(spark):
    df = spark.createDataFrame([("atcg.-[]nrx",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(S.revcomp("s")).collect()] == ["nyn[]-.cgat", "", None]
    one = spark.range(1).select(S.smallest_rotation(F.lit("tgca")), S.encode_kmer(F.lit("acgt")), S.decode_kmer(F.lit(27), 4), S.canonical(F.lit("ttt")), S.hamming(F.lit("acgt"), F.lit("aggt")), S.gc(F.lit("nnnn"))).first()
    assert tuple(one) == ("atgc", 27, "acgt", "aaa", 1, None)
    long = "acgt" * 200
    assert spark.range(1).select(S.kmers(F.lit(long), 7)).first()[0] == [long[i : i + 7] for i in range(794)]
    assert spark.range(1).select(S.fragment(F.lit("a" * 10), 4, 1)).first()[0] == [(0, "aaaa"), (3, "aaaa"), (6, "aaaa")]


def test_expressions(spark):
    df = as_records(spark.createDataFrame([("x", "acgg", {"n": "3", "m": '{"a":3,"b":1}', "v": "[3,1]", "t": '"two words"'})], "id string, sequence string, annotations map<string,string>"))
    ask = lambda t: df.select(value(t)).first()[0]
    assert ask("len(sequence) + 1") == 5.0 and ask("max(annotations.m)") == 3.0 and ask('whichmin(annotations.m)') == "b"
    assert ask("saturatingsub(annotations.m, 1)") == {"a": 2.0} and ask('subspc(annotations.t)') == "two_words"
    assert ask('annotations.n > 2 ? "y" : "n"') == "y" and ask('sprintf("%s_%d", sequence.Id(), 7)') == "x_7"
    assert ask("gc(sequence)") == 0.75 and ask('substr("hello", 1, 3)') == "ell" and ask("composition(sequence)")["g"] == 2
    sure = lambda t: df.select(predicate(t)).first()[0]
    assert sure('annotations.n == 3 && sequence.Id() =~ "^x"') and not sure("annotations.missing > 1") and not sure("!(annotations.n == 3)")
    assert sure('contains(annotations.m, "a") && ismap(annotations.m) && isvector(annotations.v)')


def test_filters_and_edits(spark):
    df = to_uniq(spark)
    assert filters.keep(df, filters.selection(min_length=13)).count() == 4
    kept, gone = filters.divide(df, filters.expression("annotations.a == 2"))
    assert (kept.count(), gone.count()) == (2, 6)
    assert filters.negated(None) is None and filters.keep(df, None).count() == 8
    one = df.where("id = 'seq1'")
    assert annotate.cut(one, 2, 4).first()["sequence"] == "aac" and annotate.cut(one, -3).first()["sequence"] == "ttt"
    assert annotate.subsequence(one, 1, 3).first()["id"] == "seq1_sub[2..3]"
    q = as_records(spark.createDataFrame([("s", "atcg", [40, 30, 20, 10])], "id string, sequence string, qualities array<tinyint>"))
    r = annotate.subsequence(q, 3, 2, circular=True).first()
    assert (r["sequence"], r["qualities"]) == ("gat", [10, 40, 30])
    r = annotate.reverse_complement(q).first()
    assert (r["sequence"], r["qualities"]) == ("cgat", [10, 20, 30, 40])
    assert sorted(x[0] for x in annotate.number(df).select(attribute("seq_number", "bigint")).collect()) == list(range(1, 9))
    left = annotate.keep_keys(df, "a", where=F.col("id") == "seq1")
    assert {r["id"]: sorted(r["annotations"]) for r in left.collect()}["seq1"] == ["a"] and sorted(left.where("id='seq2'").first()["annotations"]) == ["a", "b", "c"]


def test_join_overwrites_and_passes(spark):
    left = to_uniq(spark).where("id in ('seq1', 'seq2')")
    right = set_attributes(as_records(spark.createDataFrame([("seq1", ""), ("seq1", "")], "id string, sequence string")), {"a": F.lit(9)})
    rows = sorted((r["id"], r["a"], r["b"]) for r in joins.annotate_from(left, right).select("id", attribute("a").alias("a"), attribute("b").alias("b")).collect())
    assert rows == [("seq1", "9", "4"), ("seq1", "9", "4"), ("seq2", "3", "4")]
