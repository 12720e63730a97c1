"""Operators that join or run kernels, against brute force."""

import random

from pyspark.sql import functions as F

from strandloom.functions.registry import apply_record, register
from strandloom.kernels.distance import lcs_distance, one_difference
from strandloom.operators import assign, denoise, kmers, patterns, reads, taxonomy
from strandloom.records import as_records, attribute


def recs(spark, rows):
    return as_records(spark.createDataFrame([(i, s, k) for k, (i, s) in enumerate(rows)], "id string, sequence string, input_order long"))


def test_kmer_sets(spark):
    df = recs(spark, [("a", "acgatcgatctagctagctgatcgatcgatcg"), ("b", "ctagctagctgatcgatcgatcgtttaaaccc")])
    index = kmers.build_index(df, 15, F.col("id")).cache()
    n = {s: index.where(F.col("set_id") == s).count() for s in "ab"}
    union, both = kmers.union(index).count(), kmers.intersect(index).count()
    assert union == n["a"] + n["b"] - both and kmers.difference(index, "a").count() == n["a"] - both
    assert kmers.quorum(index, at_least=1).count() == union and kmers.quorum(index, exactly=2).count() == both
    assert abs(kmers.jaccard(index).first()["jaccard"] - both / union) < 1e-12
    assert kmers.build_index(recs(spark, [(str(i), "acgatcgatctagctagctgatcgatcgatcg") for i in range(3)]), 15, min_count=3).count() == n["a"]
    sup = kmers.superkmers(recs(spark, [("s", "acgt" * 8), ("t", "aaaaccccggggttttaaaaccccggggtttt")]), 15, 7).collect()
    assert all(len(r["sequence"]) >= 15 for r in sup) and {r["parent_id"] for r in sup} == {"s", "t"}
    assert kmers.shared_counts(df, df, 9, self_join=True).collect()[0]["shared"] > 5


def test_denoise(spark):
    big = "acgtacgtacgtac"
    rows = [("big", big, 10), ("s1", "acgtaagtacgtac", 1), ("s2", "acgtacgtacgta", 1), ("alone", "tttttttttttttt", 3)]
    df = as_records(spark.createDataFrame([(i, s, n, {"sample": {"x": n}}) for i, s, n in rows], "id string, sequence string, count long, merged map<string,map<string,long>>"))
    out = {r["id"]: r for r in denoise.clean(df, with_chimeras=True).select("id", attribute("clean_status").alias("s"), attribute("clean_weight").alias("w")).collect()}
    assert {i: r["s"] for i, r in out.items()} == {"big": '{"x":"h"}', "s1": '{"x":"i"}', "s2": '{"x":"i"}', "alone": '{"x":"s"}'}
    assert out["big"]["w"] == '{"x":12}'
    assert sorted(r["id"] for r in denoise.clean(df, only_heads=True).collect()) == ["alone", "big"]
    rng = random.Random(1)
    texts = list({"".join(rng.choice("ac") for _ in range(rng.randrange(4, 8))) for _ in range(60)})
    nodes = spark.createDataFrame([("x", t, t, 1) for t in texts], "sample string, id string, sequence string, n long")
    pairs = {(r["a"], r["b"]) for r in denoise.one_difference_pairs(nodes).collect()}
    assert pairs == {(a, b) for a in texts for b in texts if a < b and one_difference(a, b)[0] == 1}


def test_chimera(spark):
    left, right = "acgtaaccggttacgtccaa", "ttgcaaggccttggcatgca"
    rows = [("p1", left + right, 20), ("p2", right[::-1] + left[::-1], 20), ("c", left + left[::-1], 2)]
    nodes = spark.createDataFrame([("x", i, s, n) for i, s, n in rows], "sample string, id string, sequence string, n long")
    (r,) = denoise.chimeras(nodes, denoise.error_edges(nodes)).collect()
    assert r["id"] == "c" and r["chimera"].startswith("{p1}/{p2}@")


def test_assign(spark):
    rng = random.Random(2)
    base = {g: "".join(rng.choice("acgt") for _ in range(60)) for g in "ab"}
    swap = lambda s, i: s[:i] + ("a" if s[i] != "a" else "c") + s[i + 1 :]
    rows = [("a1", base["a"], "s1"), ("a2", swap(base["a"], 30), "s2"), ("b1", base["b"], "s3")]
    taxa = spark.createDataFrame([("1", "1", "no rank", "root"), ("ga", "1", "genus", "A"), ("gb", "1", "genus", "B"), ("s1", "ga", "species", "A one"), ("s2", "ga", "species", "A two"), ("s3", "gb", "species", "B one")], "taxid string, parent string, rank string, scientific_name string")
    taxa = taxonomy.with_paths(taxa).cache()
    refs = as_records(spark.createDataFrame(rows, "id string, sequence string, taxid string"))
    indexed = assign.index_references(refs, taxa).cache()
    index = {r["id"]: r["index"] for r in assign.reference_index(refs, taxa).collect()}
    assert index["a1"] == {0: "s1", 1: "ga"}
    queries = recs(spark, [("q1", base["a"]), ("q2", swap(base["a"], 10)), ("q3", "t" * 40), ("q4", swap(swap(base["b"], 5), 50))])
    out = {r["id"]: r["taxid"] for r in assign.assign(queries, indexed, taxa).collect()}
    assert out == {"q1": "s1", "q2": "ga", "q3": "1", "q4": "s3"}
    near = {(r["query"], r["reference"]): r["distance"] for r in assign.nearest_references(queries, refs).collect()}
    assert near[("q2", "a1")] == (lambda f: f[1] - f[0])(lcs_distance(swap(base["a"], 10), base["a"]))


def test_demultiplex_and_pairs(spark):
    f, r = "ttagataccccactatgc", "tagaacaggctcctctag"
    tags = [("aattaac", "aattaac", "e", "s1"), ("gaagtag", "gaagtag", "e", "s2")]
    rng = random.Random(3)
    rows = []
    for k in range(6):
        inner = "".join(rng.choice("acgt") for _ in range(50))
        t = tags[k % 2][0]
        s = t + f + inner + patterns._rc(r) + patterns._rc(t)
        rows.append((f"{k}", patterns._rc(s) if k % 3 == 0 else s))
    df = recs(spark, [*rows, ("bad", "acgt" * 20)])
    for mode in ("strict", "hamming", "indel"):
        marker = reads.Marker(f, r, forward_tag_length=7, reverse_tag_length=7, matching=mode, samples=tuple(tags))
        out = {x["id"].split("_")[0]: x["s"] for x in reads.demultiplex(df, [marker]).select("id", attribute("sample").alias("s")).collect()}
        assert out == {str(k): f"s{k % 2 + 1}" for k in range(6)}
    assert reads.demultiplex(df, [marker], keep_errors=True).count() == 7
    whole = rows[1][1]
    pairs = df.where("id = '1'").withColumn("sequence", F.substr("sequence", F.lit(1), F.lit(70))).withColumn("mate", F.struct(F.lit("1").alias("id"), F.lit(patterns._rc(whole[25:])).alias("sequence"), F.lit(None).cast("array<tinyint>").alias("qualities"), F.col("annotations")))
    (one,) = reads.assemble_pairs(pairs).collect()
    assert one["sequence"] == whole
    (tagged,) = reads.tag_mates(pairs, [marker]).select(attribute("sample").alias("s")).collect()
    assert tagged["s"] == "s2"


def test_pattern_operators(spark):
    df = recs(spark, [("x", "ggg" + "acgtta" + "ccc"), ("y", "tttttt")])
    out = {r["id"]: (r["m"], r["l"]) for r in patterns.annotate_pattern(df, "acgtta").select("id", attribute("pattern_match").alias("m"), attribute("pattern_location").alias("l")).collect()}
    assert out == {"x": ("acgtta", "4..9"), "y": (None, None)}
    assert sorted(r["sequence"] for r in patterns.split_on_patterns(df, {"p": "acgtta"}, errors=0).collect()) == ["ccc", "ggg", "tttttt"]
    (m,) = patterns.microsatellites(recs(spark, [("m", "gg" + "ac" * 6 + "tt"), ("n", "acgtcatg")]), min_count=5).collect()
    assert m["id"] == "m" and m["annotations"]["microsat_unit"] == '"ac"'


def test_script_and_sql(spark):
    df = recs(spark, [("x", "acgt"), ("y", "gg")])
    assert sorted(r["id"] for r in apply_record(df, lambda r: None if r["id"] == "y" else [r, {**r, "id": "z"}]).collect()) == ["x", "z"]
    register(spark)
    assert tuple(spark.sql("SELECT revcomp('aacg'), gc('acgg'), lcs_distance('axx', 'yya'), iupac_match('ttacgt', 'acnt', 0)").first()) == ("cgtt", 0.75, 4, True)


def test_stream(spark, tmp_path):
    from strandloom.streaming.incremental import each_batch, stream_counts

    src = str(tmp_path / "in")
    recs(spark, [("x", "acgt"), ("y", "acgt"), ("z", "gg")]).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = stream_counts(stream, ["sequence"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["sequence"]: r["count"] for r in spark.table("counts").collect()} == {"acgt": 2, "gg": 1}
    q = each_batch(stream, lambda b: b.where("id <> 'z'"), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_chimeras_equal_all_pairs(spark):
    from strandloom.kernels.distance import common_ends, one_difference

    rng = random.Random(5)
    base = ["".join(rng.choice("acgt") for _ in range(rng.choice([30, 40]))) for _ in range(14)]
    mosaics = [base[i][:c] + base[j][c:] for i, j, c in ((rng.randrange(14), rng.randrange(14), rng.choice([2, 5, 12, 25])) for _ in range(25))]
    seqs = sorted(set(base + mosaics))
    rows = [("s", f"v{i:02d}", x, 100 + rng.randrange(50) if x in base else rng.randrange(1, 60)) for i, x in enumerate(seqs)]
    nodes = spark.createDataFrame(rows, "sample string, id string, sequence string, n long")
    edges = denoise.error_edges(nodes)
    fathered = {r["son"] for r in edges.collect()}
    want = set()
    for _, ident, own, n in rows:
        if ident in fathered:
            continue
        ends = [(*common_ends(own, q), p) for _, p, q, m in rows if m > n and one_difference(own, q)[0] < 0]
        if not ends:
            continue
        left, right = max(e[0] for e in ends), max(e[1] for e in ends)
        p, q = min(e[2] for e in ends if e[0] == left), min(e[2] for e in ends if e[1] == right)
        if left and right and p != q and left < len(own) > right and left + right >= len(own):
            want.add((ident, f"{{{p}}}/{{{q}}}@({left + right - len(own)})({len(own) - right})({left})({len(own)})"))
    assert want and {(r["id"], r["chimera"]) for r in denoise.chimeras(nodes, edges).collect()} == want


def test_pcr_windows_and_repeated_rows(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("acgt") for _ in range(n)) for n in (3000, 900, 50)]
    rows = [(f"r{i}", t, i) for i, t in enumerate([*texts, texts[0]])]
    df = as_records(spark.createDataFrame([*rows, rows[1]], "id string, sequence string, input_order long"))
    args = dict(errors=1, min_length=10, max_length=200)
    for flanks in ({}, {"flank": 15}, {"flank": 15, "full_flanks": True}):
        whole = sorted(map(tuple, patterns.pcr(df, "acgnta", "ttnacg", **args, **flanks).select("id", "sequence").collect()))
        cut = sorted(map(tuple, patterns.pcr(df, "acgnta", "ttnacg", **args, **flanks, fragment=500).select("id", "sequence").collect()))
        assert whole and cut == whole


def test_nearest_references_lose_none(spark, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("acgt") for _ in range(rng.randrange(30, 60))) for _ in range(25)]
    edit = lambda s, share: "".join(rng.choice("acgt") if rng.random() < share else c for c in s if rng.random() > share / 8)
    asked = [("exact", base[0]), ("none", "t" * 9), ("short", "ac")] + [(f"q{i}", edit(rng.choice(base), i / 40)) for i in range(24)]
    refs, queries = recs(spark, [(f"r{i:02d}", b) for i, b in enumerate(base)]), recs(spark, asked)
    want = set()
    for name, s in asked:
        d = [(lambda f: f[1] - f[0])(lcs_distance(s, b)) for b in base]
        want |= {(name, f"r{i:02d}", x) for i, x in enumerate(d) if x == min(d)}
    for tile in (512, 7):
        monkeypatch.setattr(assign, "TILE", tile)
        assert {tuple(r) for r in assign.nearest_references(queries, refs).select("query", "reference", "distance").collect()} == want


def test_landmarks_and_geometric_assignment(spark):
    rng = random.Random(8)
    base = {t: "".join(rng.choice("acgt") for _ in range(50)) for t in ("s1", "s2", "s3")}
    swap = lambda s, i: s[:i] + ("a" if s[i] != "a" else "c") + s[i + 1 :]
    rows = [(f"{t}{k}", swap(b, 3 * k), t) for t, b in base.items() for k in range(4)] + [("g", swap(base["s1"], 40), "ga")]
    taxa = spark.createDataFrame([("1", "1", "no rank", "root"), ("ga", "1", "genus", "A"), ("gb", "1", "genus", "B"), ("s1", "ga", "species", "A one"), ("s2", "ga", "species", "A two"), ("s3", "gb", "species", "B one")], "taxid string, parent string, rank string, scientific_name string")
    taxa = taxonomy.with_paths(taxa).cache()
    refs = assign.landmarks(as_records(spark.createDataFrame(rows, "id string, sequence string, taxid string")), 3, seed=1).cache()
    coords = {r["id"]: r["c"] for r in refs.select("id", assign.coordinates().alias("c")).collect()}
    assert all(len(c) == 3 for c in coords.values()) and refs.where(attribute("landmark_id", "bigint") >= 0).count() == 3
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    under = {"ga": {"ga", "s1", "s2"}, "s1": {"s1"}, "s2": {"s2"}, "s3": {"s3"}}
    want = {i: {square(coords[i], coords[j]): t for j, _, u in rows if u in under[t]} for i, _, t in rows}
    assert {r["id"]: r["index"] for r in assign.geometric_index(refs, taxa).collect()} == want
    indexed = assign.index_geometric(refs, taxa)
    out = {r["id"]: r["taxid"] for r in assign.assign_geometric(refs.withColumn("taxid", F.lit(None).cast("string")), indexed, taxa, "1").collect()}
    assert len(out) == len(rows) and all(out[f"s3{k}"] == "s3" for k in range(4))


def test_clusters_and_low_complexity(spark):
    from strandloom.operators import complexity

    rng = random.Random(9)
    a, b = ("".join(rng.choice("acgt") for _ in range(40)) for _ in range(2))
    near = a[:20] + ("c" if a[20] != "c" else "g") + a[21:]
    df = as_records(spark.createDataFrame([("x", a, 5, "k"), ("y", near, 2, "k"), ("z", b, 3, "k"), ("w", a, 1, "other")], "id string, sequence string, count long, fam string"))
    out = {r["id"]: r["c"] for r in assign.cluster_greedy(df, ["fam"], 0.9).select("id", F.col("cluster_id").alias("c")).collect()}
    assert out["x"] == out["y"] and out["z"] != out["x"] and len(out) == 4
    low = as_records(spark.createDataFrame([("p", a + "a" * 60 + b), ("q", a)], "id string, sequence string"))
    masked = {r["id"]: r["sequence"] for r in complexity.mask_low(low, k=20).collect()}
    assert masked["q"] == a and "." * 40 in masked["p"] and len(masked["p"]) == 140
    parts = complexity.extract_regions(low, low=False, k=20).collect()
    assert all("a" * 30 not in r["sequence"] for r in parts)


def _any_order(df):
    """The rows in another order, and with other row numbers, each time they are computed."""
    return df.coalesce(1).mapInPandas(lambda frames: (f.sample(frac=1) for f in frames), df.schema)


def test_annotate_lca_of_rows_in_any_order(spark):
    tree = [("1", "1", "no rank", "root")] + [(f"n{i}", "1", "genus", f"N{i}") for i in range(30)]
    taxa = taxonomy.with_paths(spark.createDataFrame(tree, "taxid string, parent string, rank string, scientific_name string"))
    rows = spark.createDataFrame([(f"s{i}", f"n{i % 31}") for i in range(200)], "id string, t string")
    df = as_records(_any_order(rows).select("id", F.lit("").alias("sequence"), F.create_map(F.lit("taxid"), F.create_map("t", F.lit(2).cast("long"))).alias("merged")))
    out = {r["id"]: r["t"] for r in taxonomy.annotate_lca(df, taxa, "common").select("id", attribute("common_taxid").alias("t")).collect()}
    assert out == {f"s{i}": f"n{i % 31}" if i % 31 < 30 else None for i in range(200)}


def test_number_of_many_rows_and_of_none(spark):
    from strandloom.operators import annotate

    df = as_records(spark.range(60000).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("acgt"), 9).alias("sequence"), (F.col("id") * 7919 % 60000).alias("input_order")).withColumn("input_order", F.when(F.col("id") != "0", F.col("input_order"))))
    out = annotate.number(df).select("input_order", attribute("seq_number", "bigint").alias("n")).collect()
    assert sorted(r["n"] for r in out) == list(range(1, 60001)) and all(r["n"] == (r["input_order"] or 60000) for r in out)
    assert annotate.number(df.where("false")).count() == 0
    assert sorted(r["n"] for r in annotate.number(df.limit(50).withColumn("input_order", F.lit(None).cast("long"))).select(attribute("seq_number", "bigint").alias("n")).collect()) == list(range(1, 51))


def test_one_difference_pairs_meet_once_and_are_not_sent_to_the_driver(spark):
    rng = random.Random(10)
    texts = ["", "a", "aa", *sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)} - {"a", "aa"})]
    nodes = spark.createDataFrame([("x", f"{k}{copy}", t) for k, t in enumerate(texts) for copy in "pq"] + [("x", "none", None), ("y", "0p", "b")], "sample string, id string, sequence string")
    out = denoise.one_difference_pairs(nodes)
    ids = [(f"{k}{copy}", t) for k, t in enumerate(texts) for copy in "pq"]
    want = sorted(("x", a, b, s, t) for a, s in ids for b, t in ids if a < b and one_difference(s, t)[0] == 1)
    assert want and sorted(map(tuple, out.collect())) == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_in_space_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    nan, inf = float("nan"), float("inf")
    marks = [[float(rng.randrange(9)) for _ in range(3)] for _ in range(40)] + [[1.0, 2.0], [3.0, 2.0], [inf, 0.0, 0.0], [nan, 0.0, 0.0]]
    asked = marks + [[rng.random() * 9 for _ in range(3)] for _ in range(300)] + [[2.0, 2.0], [1e200, 0.0, 0.0], [1e-200, 0.0, 0.0]]
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(asked)] + [("none", None)], "id string, v array<double>")
    refs = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(marks)] + [("none", None)], "id string, v array<double>")

    def distance(a, b):
        d = sum((x - y) ** 2 if abs(x - y) < 1e150 else inf if x - y == x - y else nan for x, y in zip(a, b))
        return (d != d, 0.0 if d != d else d)  # NaN is the largest

    want = set()
    for i, a in enumerate(asked):
        d = {f"r{k}": distance(a, b) for k, b in enumerate(marks) if len(a) == len(b)}
        want |= {(f"q{i}", k) for k, x in d.items() if x == min(d.values())}
    for tile in ((4096, 8192), (4096, 7)):
        monkeypatch.setattr(assign, "SPACE_TILE", tile)
        out = assign.nearest_in_space(queries, refs, "v", "id", cells=4)
        rows = out.collect()
        assert len(rows) == len(want) and {(r["id"], r["reference"]) for r in rows} == want
    assert "CoGroups" in out._jdf.queryExecution().optimizedPlan().toString()  # pairs are no rows
    assert assign.nearest_in_space(queries, refs.where("false"), "v", "id").count() == 0
