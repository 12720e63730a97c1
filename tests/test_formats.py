"""Readers and writers, taxonomies, tag sheets."""

from pyspark.sql import functions as F

from strandloom.operators import taxonomy
from strandloom.records import attribute
from strandloom.sources import readers, tagsheets, taxonomies, writers


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    p = folder / name
    p.write_text(text)
    return str(p)


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "x.fasta", '>s1 {"count":3,"merged_sample":{"a":2,"b":1},"k":"v","taxid":"9606"} some words\nACGT\nacgu\n>s2 plain title\nNNN\n>s3 a=1; b=two words; c=1.5;\nac\n')
    df = readers.read_sequences(spark, path, u_to_t=True).cache()
    rows = {r["id"]: r for r in df.collect()}
    assert rows["s1"]["sequence"] == "acgtacgt" and rows["s1"]["count"] == 3 and rows["s1"]["merged"] == {"sample": {"a": 2, "b": 1}} and rows["s1"]["taxid"] == "9606"
    assert rows["s1"]["definition"] == "some words" and rows["s2"]["definition"] == "plain title" and rows["s3"]["annotations"] == {"a": "1", "b": '"two words"', "c": "1.5"}
    assert rows["s1"]["source"] == "x"
    out = str(tmp_path / "out")
    writers.write_fasta(df, out)
    again = {r["id"]: r for r in readers.read_fasta(spark, out).collect()}
    assert all(again[i][c] == rows[i][c] for i in rows for c in ("sequence", "count", "merged", "annotations", "definition", "taxid"))


def test_fastq(spark, tmp_path):
    body = "".join(f"@r{i} n={i};\nACGTACGT\n+\n{'@IIIIIII' if i % 3 else 'IIIIIII!'}\n" for i in range(400))
    path = put(tmp_path, "y.fastq", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "997", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = readers.read_fastq(spark, path)
            rows = df.select("id", "sequence", "qualities", attribute("n", "bigint").alias("n")).collect()
            assert sorted(r["n"] for r in rows) == list(range(400)), size
            assert all(r["qualities"] == ([31] + [40] * 7 if r["n"] % 3 else [40] * 7 + [0]) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = str(tmp_path / "fq")
    writers.write_fastq(df, out, compression="gzip")
    assert readers.read_fastq(spark, out).count() == 400


def test_flat_files(spark, tmp_path):
    embl = "ID   X1; SV 1; linear; DNA; 12 BP.\nDE   a gene\nDE   of a fish\nOS   Danio rerio\nFT   source          1..12\nFT                   /db_xref=\"taxon:7955\"\nSQ   Sequence 12 BP;\n     acgtacgtac gt        12\n//\nID   X2; SV 1;\nSQ   Sequence 4 BP;\n     acgt     4\n//\n"
    rows = {r["id"]: r for r in readers.read_sequences(spark, put(tmp_path, "a.dat", embl)).collect()}
    assert (rows["X1"]["sequence"], rows["X1"]["taxid"], rows["X1"]["definition"]) == ("acgtacgtacgt", "7955", "a gene of a fish") and rows["X2"]["taxid"] == "1"
    gb = "LOCUS       AB1  8 bp DNA\nDEFINITION  one\n            two.\nACCESSION   AB1\nSOURCE      Mus musculus\nFEATURES             Location/Qualifiers\n     source          1..8\n                     /db_xref=\"taxon:10090\"\nORIGIN\n        1 acgtacgt\n//\n"
    (r,) = readers.read_sequences(spark, put(tmp_path, "b.gb", gb)).collect()
    assert (r["id"], r["sequence"], r["taxid"], r["definition"], r["annotations"]["scientific_name"]) == ("AB1", "acgtacgt", "10090", "one two.", '"Mus musculus"')


def test_csv_and_table(spark, tmp_path):
    path = put(tmp_path, "c.csv", 'id,sequence,count,size,note\ns1,ACGT,4,7,"x"\n# a remark\ns2,AC,,,\n')
    df = readers.read_sequences(spark, path)
    rows = {r["id"]: r for r in df.collect()}
    assert rows["s1"]["count"] == 4 and rows["s1"]["annotations"]["size"] == "7" and rows["s2"]["count"] == 1 and rows["s2"]["annotations"] == {}
    assert sorted(map(tuple, writers.table(df, sequence=True).collect())) == [("s1", "x", "7", "acgt"), ("s2", "NA", "NA", "ac")]
    assert readers.read_sequences(spark, put(tmp_path / "e", "e.fasta", "")).count() == 0


def test_taxonomy(spark, tmp_path):
    d = tmp_path / "dump"
    put(d, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n9\t|\t1\t|\tfamily\t|\n5\t|\t9\t|\tgenus\t|\n3\t|\t5\t|\tspecies\t|\n4\t|\t5\t|\tspecies\t|\n")
    put(d, "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n9\t|\tCervidae\t|\t\t|\tscientific name\t|\n5\t|\tCervus\t|\t\t|\tscientific name\t|\n3\t|\tCervus elaphus\t|\t\t|\tscientific name\t|\n3\t|\tred deer\t|\t\t|\tcommon name\t|\n4\t|\tCervus nippon\t|\t\t|\tscientific name\t|\n")
    put(d, "merged.dmp", "77\t|\t3\t|\n")
    taxa, aliases = taxonomies.read_taxonomy(spark, str(d))
    taxa = taxonomy.with_paths(taxa).cache()
    assert {r["taxid"]: [x["taxid"] for x in r["path"]] for r in taxa.collect()}["3"] == ["1", "9", "5", "3"]
    assert [r["taxid"] for r in taxonomy.named(taxa, "red deer", fixed=True).collect()] == ["3"]
    assert sorted(r["taxid"] for r in taxonomy.sub_taxonomy(taxa, "5").collect()) == ["1", "3", "4", "5", "9"]
    old = taxonomy.resolve(spark.createDataFrame([("taxon:77 [x]@species",), ("12",)], "taxid string"), taxa, aliases)
    assert sorted((r["taxid"], r["__known"]) for r in old.collect()) == [("12", False), ("3", True)]
    p = taxa.select("taxid", "path").where("taxid in ('3', '4', '5')")
    e = p.select(F.struct("path", F.when(F.col("taxid") == "3", 9.0).otherwise(1.0).alias("weight")).alias("e")).agg(F.collect_list("e").alias("e"))
    assert e.select(taxonomy.weighted_lca(F.col("e"))["taxid"]).first()[0] == "5"
    assert e.select(taxonomy.weighted_lca(F.col("e"), 0.2)["taxid"]).first()[0] == "3"
    assert taxonomy.newick(taxa).startswith("((('3 [Cervus elaphus]@species','4") and taxonomy.newick(taxa).endswith(";")


def test_tag_sheets():
    for text in (tagsheets.example_sheet(), "exp1 s1 aattaac TTAGATACCCCACTATGC TAGAACAGGCTCCTCTAG F @ a=1;\n"):
        (m,) = tagsheets.parse_sheet(text)
        assert m.samples == (("aattaac", "aattaac", "exp1", "s1"),) and m.forward_tag_length == 7
