"""Taxonomic assignment by similarity, indexing of references, landmarks, checks of reference libraries.

Nearest references are found among candidates that share words; the pairs come from an equi-join on words and
are verified by the exact distance in Arrow batches. Queries for which that is not sure to find the nearest are
compared with all references, tile by tile. The root is the answer below half identity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.sequences import squared_distance
from strandloom.kernels import stats
from strandloom.kernels.distance import fourmers, lcs_distance
from strandloom.operators import kmers as K
from strandloom.operators import taxonomy as X
from strandloom.records import raw_attribute, set_attributes

INDEX_KEY = "ref_index"


@F.pandas_udf(T.IntegerType())
def lcs_gap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment length less matches."""
    found = [lcs_distance(x, y) for x, y in zip(a, b)]
    return pd.Series([n - m for m, n in found], dtype="int32")


@F.pandas_udf(T.StructType([T.StructField("matches", T.IntegerType()), T.StructField("length", T.IntegerType())]))
def lcs_both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lcs_distance(x, y) for x, y in zip(a, b)], columns=["matches", "length"], dtype="int32")


#: Sequences of either side that one task of ``scan_references`` compares.
TILE = 512


def _nearest_in_tile(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """The nearest references of each query within the tile. References come by rising 4-mer bound (an error spoils at most four), so most are left out unread."""
    texts, ids = r["rs"].tolist(), r["reference"].tolist()
    profiles, sizes = np.array([fourmers(t) for t in texts]).reshape(len(texts), 256), np.array([len(t) for t in texts])
    out = []
    for query, text, bound in zip(q["query"], q["qs"], q["bound"]):
        shared = np.minimum(profiles, fourmers(text)).sum(axis=1)
        least = np.maximum(np.ceil((np.maximum(sizes, len(text)) - 3 - shared) / 4), np.abs(sizes - len(text)))
        best, found = None if pd.isna(bound) else int(bound), []
        for k in np.argsort(least, kind="stable").tolist():
            if best is not None and least[k] > best:
                break
            told = lcs_distance(text, texts[k], best)
            if told is None:
                continue
            if best is None or told[1] - told[0] < best:
                best, found = told[1] - told[0], []
            found.append((query, ids[k], *told))
        out += [f for f in found if f[3] - f[2] == best]
    return pd.DataFrame(out, columns=["query", "reference", "matches", "length"])


def scan_references(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query, reference, matches, length): for each (query, qs, bound) the nearest of all (reference, rs), none further than the bound, in each tile of the table of both.

    For what has no other way: tiles are of bounded size and dealt out to all tasks, and only a tile's winners leave it.
    """
    blocks = [max(1, -(-df.count() // TILE)) for df in (queries, references)]
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("i", at("query", blocks[0])).withColumn("j", every(blocks[1]))
    r = references.withColumn("j", at("reference", blocks[1])).withColumn("i", every(blocks[0]))
    return q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInPandas(_nearest_in_tile, "query string, reference string, matches int, length int")


def nearest_references(queries: DataFrame, references: DataFrame, word: int = 8, min_shared: int = 1) -> DataFrame:
    """(query, reference, distance, identity) of each query's references at the smallest distance.

    Distinct query sequences meet references over shared words; the best counts of shared words bound
    the distance (an error spoils at most ``word`` words), so pairs that cannot win are left out unread.
    Where the bound lets a reference without enough shared words be as near, or no reference shares any, the query
    is compared with all references (``scan_references``), so none is lost.
    """
    q = queries.where("sequence is not null").select("sequence").distinct().withColumn("id", F.md5("sequence"))
    r = references.where("sequence is not null").select("id", "sequence")
    qs, rs = q.select(F.col("id").alias("query"), F.col("sequence").alias("qs")), r.select(F.col("id").alias("reference"), F.col("sequence").alias("rs"))
    pairs = K.shared_counts(q, r, word, min_shared)
    best = pairs.groupBy("query").agg(F.max("shared").alias("most"))
    long = pairs.join(best, "query").join(qs, "query").join(rs, "reference")
    # the best candidate's true distance is a bound for all the others
    top = long.where("shared = most").groupBy("query").agg(F.min_by(F.struct("qs", "rs"), F.struct("reference")).alias("t"))
    bound = top.select("query", lcs_gap("t.qs", "t.rs").alias("bound"))
    words = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("qs") - word + 1, F.lit(1))), lambda i: F.substr("qs", i, F.lit(word)))))
    told = qs.join(bound, "query", "left").withColumn("needed", words - word * F.col("bound"))
    sure = F.coalesce(F.col("needed") >= min_shared, F.lit(False))
    near = long.join(told.where(sure).select("query", "needed"), "query").where(F.col("shared") >= F.col("needed")).select("query", "reference", lcs_both("qs", "rs").alias("l"))
    scored = near.select("query", "reference", "l.matches", "l.length").union(scan_references(told.where(~sure).select("query", "qs", "bound"), rs))
    scored = scored.withColumn("distance", F.col("length") - F.col("matches"))
    least = scored.groupBy("query").agg(F.min("distance").alias("least"))
    found = scored.join(least, "query").where("distance = least").join(qs, "query").select("qs", "reference", "distance", F.try_divide("matches", "length").alias("identity"))
    return queries.select(F.col("id").alias("query"), "sequence").join(found, F.col("sequence") == F.col("qs")).select("query", "reference", "distance", "identity")


def reference_index(references: DataFrame, taxa: DataFrame, word: int = 8) -> DataFrame:
    """(id, index): for each reference a map of distance -> taxid: the last common ancestor with the references that near.

    For every ancestor of a reference the smallest distance to a reference outside its child on the path is
    taken, and made monotone towards the root.
    """
    r = references.join(taxa.select("taxid", "path"), "taxid").select("id", "sequence", "path")
    pairs = K.shared_counts(r, r, word, self_join=True)
    a, b = r.select(F.col("id").alias("query"), F.col("sequence").alias("sa"), F.col("path").alias("pa")), r.select(F.col("id").alias("reference"), F.col("sequence").alias("sb"), F.col("path").alias("pb"))
    both = pairs.join(a, "query").join(b, "reference").withColumn("d", lcs_gap("sa", "sb")).withColumn("common", X.lca("pa", "pb")["taxid"])
    long = both.select(F.col("query").alias("id"), "common", "d").union(both.select("reference", "common", "d"))
    per = long.groupBy("id", "common").agg(F.min("d").alias("d"))
    steps = r.select("id", F.posexplode("path").alias("depth", "node"))
    level = steps.join(per.withColumnRenamed("common", "taxid"), (steps["id"] == per["id"]) & (F.col("node.taxid") == F.col("taxid")), "left").select(steps["id"], "depth", F.col("node.taxid").alias("taxid"), "d")
    deepest = level.groupBy("id").agg(F.max("depth").alias("deepest"))
    level = level.join(deepest, "id").withColumn("d", F.when(F.col("depth") == F.col("deepest"), 0).otherwise(F.col("d"))).where("d is not null")
    # a distance at which a wider taxon is reached ends the narrower one: the widest taxon of a distance stands
    w = Window.partitionBy("id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    kept = level.withColumn("above", F.min("d").over(w)).where("above is null or d < above")
    return kept.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("d").cast("int").alias("key"), F.col("taxid").alias("value"))))).alias("index"))


def index_references(references: DataFrame, taxa: DataFrame, word: int = 8) -> DataFrame:
    """References with their index as an annotation."""
    out = references.join(reference_index(references, taxa, word).withColumnRenamed("index", "__index"), "id", "left")
    return set_attributes(out, {INDEX_KEY: F.col("__index")}).drop("__index")


def _by_distance(key: str) -> Column:
    """An index annotation, whose JSON has distances as text."""
    return F.transform_keys(F.from_json(raw_attribute(key), "map<string,string>"), lambda k, _: k.cast("int"))


def taxon_at_distance(index: Column, distance: Column) -> Column:
    """The taxid at the largest key not above the distance."""
    best = F.array_max(F.filter(F.map_keys(index), lambda k: k <= distance))
    return F.try_element_at(index, best)


def assign(queries: DataFrame, references: DataFrame, taxa: DataFrame, word: int = 8, min_identity: float = 0.5, root: str | None = None) -> DataFrame:
    """Queries with ``taxid`` and ``assign_rank``, ``_bestid``, ``_bestmatch``, ``_match_count``, ``_similarity_method``.

    Of each nearest reference the index gives a taxon at the distance found; theirs is the last common
    ancestor. Below ``min_identity``, without a candidate, or for fewer than five bases it is the root.
    """
    root_id = root or taxa.where("taxid = parent").select("taxid").first()[0]
    indexed = references.where(F.map_contains_key("annotations", INDEX_KEY)).select("id", _by_distance(INDEX_KEY).alias("index"))
    near = nearest_references(queries, references, word).where(F.col("identity") >= min_identity)
    hits = near.join(indexed.withColumnRenamed("id", "reference"), "reference").withColumn("taxid", taxon_at_distance(F.col("index"), F.col("distance")))
    hits = hits.join(taxa.select("taxid", "path"), "taxid")
    per = hits.groupBy("query").agg(F.collect_list(F.struct("path", F.lit(1.0).alias("weight"))).alias("e"), F.max("identity").alias("__identity"), F.min("reference").alias("__best"), F.count(F.lit(1)).alias("__n"))
    found = per.select(F.col("query").alias("id"), X.weighted_lca(F.col("e")).alias("__l"), "__identity", "__best", "__n")
    out = queries.drop("taxid").join(found, "id", "left")
    told = F.col("__l.taxid").isNotNull() & (F.length("sequence") >= 5)
    out = out.withColumn("taxid", F.when(told, F.col("__l.taxid")).otherwise(F.lit(root_id)))
    keys = {"assign_rank": F.when(told, F.col("__l.rank")).otherwise(F.lit("no rank")), "assign_bestid": F.coalesce("__identity", F.lit(0.0)), "assign_bestmatch": F.col("__best"), "assign_match_count": F.coalesce("__n", F.lit(0)), "assign_similarity_method": F.lit("lcs")}
    return set_attributes(out, keys).select(*queries.columns)


def landmarks(library: DataFrame, n: int, seed: int = 0, sample: int = 2000, rounds: int = 2) -> DataFrame:
    """Records with ``landmark_coord``, distances to n landmarks, and ``landmark_id`` of those that are landmarks, else -1.

    Landmarks are medoids of k-means over a bounded sample (``sample`` records by a hash), refined in
    coordinates to the landmarks of the round before; then every record's coordinates are computed.
    """
    rows = library.select("id", "sequence").orderBy(F.xxhash64("sequence", F.lit(seed)), "id").limit(sample).collect()
    texts = [r["sequence"] for r in rows]
    chosen = list(np.random.default_rng(seed).permutation(len(texts))[:n])
    for k in range(rounds):
        coordinates = np.array([[(lambda f: f[1] - f[0])(lcs_distance(t, texts[c])) for c in chosen] for t in texts], float)
        chosen = list(stats.kmeans(coordinates, n, seed + k)[0])
    marks = [(rows[c]["id"], texts[c]) for c in chosen]

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [(lambda f: f[1] - f[0])(lcs_distance(x, t)) for _, t in marks])

    place = F.lit(-1)
    for i, (ident, _) in enumerate(marks):
        place = F.when(F.col("id") == ident, i).otherwise(place)
    out = library.withColumn("__coord", run("sequence"))  # a column first: Python has no place in the lambdas that write annotations
    return set_attributes(out, {"landmark_coord": F.col("__coord"), "landmark_id": place}).select(*library.columns)


def coordinates() -> Column:
    return F.from_json(raw_attribute("landmark_coord"), "array<int>")


#: Queries, and references, that one task of ``nearest_in_space`` compares.
SPACE_TILE = (4096, 8192)


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors."""
    vectors = vectors.tolist()
    sizes = np.array([len(v) for v in vectors], int)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.array([vectors[k] for k in at], float).reshape(len(at), n)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of ``squared_distance``."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += (x[:, k] - y[:, k]) ** 2
    return out


def _nearest_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the nearest rows of y, NaN being the largest distance.

    Products tell which rows may be nearest, within the bound of their rounding; those are compared term by term.
    """
    square, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    told = square[:, None] + other - 2 * (x @ y.T)
    slack = 32 * (x.shape[1] + 8) * np.finfo(float).eps * (square + other.max()) + 1e-300
    may = told <= (told.min(axis=1) + slack)[:, None] if np.isfinite(told).all() else np.ones(told.shape, bool)
    i, j = np.nonzero(may)
    d = np.concatenate([_squares(x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
    least = np.fmin.reduceat(d, np.searchsorted(i, np.arange(len(x))))[i]
    kept = (d == least) | (np.isnan(d) & np.isnan(least))
    return i[kept], j[kept], d[kept]


def nearest_in_space(queries: DataFrame, references: DataFrame, vector: str, key: str, cells: int = 64) -> DataFrame:
    """(key, reference, distance): references at the smallest squared distance between vectors of their length.

    References are dealt to cells around ``cells`` of their own vectors, and neighbouring or split cells to blocks of
    bounded size. The nearest centre bounds a query's distance, and the query goes to the blocks of the cells that the triangle
    inequality cannot rule out; vectors that are not finite, or of no centre's length, rule out none. A tile of queries and a
    block are compared by matrix products.
    """
    told = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    q, r = queries.where(told).select(key, F.col(vector).alias("qv")), references.where(told).select(F.col(key).alias("reference"), F.col(vector).alias("rv"))
    kinds = (q.schema[key].dataType.simpleString(), r.schema["reference"].dataType.simpleString())
    out = f"`{key}` {kinds[0]}, reference {kinds[1]}, distance double"
    finite = F.forall("rv", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    centres = [np.array(x[0], float) for x in r.where(finite).select("rv").distinct().orderBy(F.xxhash64("rv")).limit(cells).collect()]

    def to_centres(x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, infinite to those of another length."""
        return np.array([_squares(x, np.broadcast_to(c, x.shape)) if len(c) == x.shape[1] else np.full(len(x), np.inf) for c in centres] or [np.full(len(x), np.inf)]).T

    @F.pandas_udf("cell int, away double")
    def cell_of(vectors: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(vectors), -1), np.zeros(len(vectors))
        with np.errstate(all="ignore"):
            for at, x in _by_length(vectors):
                d = to_centres(x)
                sure = np.isfinite(x).all(axis=1) & np.isfinite(d.min(axis=1))
                cell[at[sure]], away[at[sure]] = d[sure].argmin(axis=1), np.sqrt(d[sure].min(axis=1))
        return pd.DataFrame({"cell": cell.astype("int32"), "away": away})

    dealt = r.withColumn("__c", cell_of("rv"))
    found = sorted(map(tuple, dealt.groupBy("__c.cell").agg(F.max("__c.away"), F.count(F.lit(1))).collect()))  # a row for each cell
    radius, blocks, block, room = {}, {}, -1, 0
    for cell, most, n in found:
        radius[cell] = most
        if n > room:  # the cell has blocks of its own, or begins one
            first, block = block + 1, block + -(-n // SPACE_TILE[1])
            blocks[cell], room = (first, block - first + 1), SPACE_TILE[1] - n if n < SPACE_TILE[1] else 0
        else:
            blocks[cell], room = (block, 1), room - n
    if not found:
        return q.select(key, F.lit(None).cast(kinds[1]).alias("reference"), F.lit(None).cast("double").alias("distance")).where("false")

    @F.pandas_udf("blocks array<int>, bound double")
    def blocks_of(vectors: pd.Series) -> pd.DataFrame:
        into, bound = [None] * len(vectors), np.full(len(vectors), np.inf)
        with np.errstate(all="ignore"):
            for at, x in _by_length(vectors):
                d = to_centres(x)
                for k, own, row in zip(at, d.min(axis=1), np.sqrt(d)):
                    near = [c for c in blocks if not np.isfinite(own) or c < 0 or row[c] - radius[c] <= np.sqrt(own) * (1 + 1e-9) + 1e-9]
                    into[k] = sorted({b for c in near for b in range(blocks[c][0], sum(blocks[c]))})
                    bound[k] = own if np.isfinite(own) else np.inf
        return pd.DataFrame({"blocks": into, "bound": bound})

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        with np.errstate(all="ignore"):
            for s, x in _by_length(a["qv"]):
                for t, y in _by_length(b["rv"]):
                    for k in range(0, len(x) if x.shape[1] == y.shape[1] else 0, 256):
                        i, j, d = _nearest_rows(x[k : k + 256], y)
                        i = s[i + k]
                        near = ~(d > a["bound"].to_numpy()[i])
                        parts.append(pd.DataFrame({key: a[key].to_numpy()[i[near]], "reference": b["reference"].to_numpy()[t[j[near]]], "distance": d[near]}))
        return pd.concat(parts) if parts else pd.DataFrame({key: a[key][:0], "reference": b["reference"][:0], "distance": np.zeros(0)})

    rows = q.count()
    tiles = max(1, -(-rows // min(SPACE_TILE[0], max(256, rows // 32))))
    asked = q.withColumn("i", F.pmod(F.xxhash64(key, "qv"), F.lit(tiles)).cast("int")).withColumn("__b", blocks_of("qv")).select(key, "qv", "i", "__b.bound", F.explode("__b.blocks").alias("j"))
    first, n = (F.create_map(*[F.lit(v) for c in blocks for v in (c, blocks[c][k])])[F.col("__c.cell")] for k in (0, 1))
    held = dealt.select("reference", "rv", (first + F.pmod(F.xxhash64("reference", "rv"), n)).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    near = asked.groupBy("i", "j").cogroup(held.groupBy("i", "j")).applyInPandas(compare, out).withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # pandas has no NaN but null
    return near.withColumn("__least", F.min("distance").over(Window.partitionBy(key))).where("distance = __least").drop("__least")


GEOMETRIC_KEY = "geomref_index"


def geometric_index(references: DataFrame, taxa: DataFrame) -> DataFrame:
    """(id, index): for each reference with coordinates a map of squared distance -> its taxid, for the references of its taxon and below it, itself at 0.

    References meet over the taxa on their paths, so only those of a clade are compared.
    """
    r = references.withColumn("__v", coordinates()).where("__v is not null").join(taxa.select("taxid", "path"), "taxid").select("id", "taxid", "path", "__v")
    below = r.select(F.explode("path.taxid").alias("taxid"), F.col("__v").alias("__w")).distinct()
    found = r.select("id", "taxid", "__v").join(below, "taxid").select("id", "taxid", squared_distance("__v", "__w").cast("int").alias("d")).distinct()
    return found.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("d").alias("key"), F.col("taxid").alias("value"))))).alias("index"))


def index_geometric(references: DataFrame, taxa: DataFrame) -> DataFrame:
    """References with their index in landmark space as an annotation; those without coordinates, or of an unknown taxon, pass as they are."""
    out = references.join(geometric_index(references, taxa).withColumnRenamed("index", "__index"), "id", "left")
    return set_attributes(out, {GEOMETRIC_KEY: F.col("__index")}).select(*references.columns)


def assign_geometric(queries: DataFrame, references: DataFrame, taxa: DataFrame, root: str) -> DataFrame:
    """Like ``assign`` by squared distance in landmark space; the index is read at the smallest key not below it, else the root."""
    q, r = queries.withColumn("__v", coordinates()), references.withColumn("__v", coordinates())
    near = nearest_in_space(q, r, "__v", "id").withColumnRenamed("id", "query")
    indexed = references.select(F.col("id").alias("reference"), _by_distance(GEOMETRIC_KEY).alias("index"))
    key = F.array_min(F.filter(F.map_keys("index"), lambda k: k >= F.col("distance")))
    hits = near.join(indexed, "reference").withColumn("taxid", F.coalesce(F.try_element_at("index", key), F.lit(root))).join(taxa.select("taxid", "path"), "taxid")
    per = hits.groupBy("query").agg(F.collect_list(F.struct("path", F.lit(1.0).alias("weight"))).alias("e"), F.min("reference").alias("__best"), F.count(F.lit(1)).alias("__n"), F.min("distance").alias("__d"))
    out = queries.drop("taxid").join(per.select(F.col("query").alias("id"), X.weighted_lca(F.col("e")).alias("__l"), "__best", "__n", "__d"), "id", "left").withColumn("taxid", F.coalesce("__l.taxid", F.lit(root)))
    return set_attributes(out, {"assign_rank": F.coalesce("__l.rank", F.lit("no rank")), "assign_bestid": F.col("__d"), "assign_bestmatch": F.col("__best"), "assign_match_count": F.col("__n"), "assign_similarity_method": F.lit("geometric")}).select(*queries.columns)


def cluster_greedy(df: DataFrame, by: list[str], identity: float = 0.9) -> DataFrame:
    """Records with ``cluster_id``: within each group, by falling count, the first earlier head that is similar enough, else a head of its own.

    A group is walked against its heads only, batch by batch; heads of a group are what it keeps in memory.
    """
    rows = df.select(*by, "id", "sequence", "count")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["count", "id"], ascending=[False, True])
        heads: list[tuple[str, str]] = []
        out = []
        for ident, s in zip(frame["id"], frame["sequence"]):
            for head, t in heads:
                limit = int((1 - identity) * max(len(s), len(t)) / identity) + 1
                found = lcs_distance(s, t, limit)
                if found and found[0] / found[1] >= identity:
                    out.append(head)
                    break
            else:
                heads.append((ident, s))
                out.append(ident)
        return pd.DataFrame({"id": frame["id"], "cluster_id": out})

    found = rows.groupBy(*by).applyInPandas(run, "id string, cluster_id string")
    return df.join(found, "id", "left")


def family_index(references: DataFrame, taxa: DataFrame, identity: float = 0.9, word: int = 8) -> DataFrame:
    """``reference_index`` in two steps: within families, and, for what lies above, among the heads of each family's clusters."""
    r = references.join(taxa.select("taxid", "path"), "taxid").withColumn("family", F.coalesce(X.at_rank("family")["taxid"], F.lit("NA")))
    heads = cluster_greedy(r, ["family"], identity)
    own = reference_index(references, taxa, word)
    top = reference_index(heads.where("id = cluster_id").select(*references.columns), taxa, word)
    out = heads.select("id", "cluster_id").join(own, "id").join(top.select(F.col("id").alias("cluster_id"), F.col("index").alias("above")), "cluster_id", "left")
    keys = F.map_keys("index")
    return out.select("id", F.map_concat("index", F.map_filter(F.coalesce("above", F.create_map().cast("map<int,string>")), lambda k, _: ~F.array_contains(keys, k) & (k > F.array_max(keys)))).alias("index"))


def check_library(references: DataFrame, taxa: DataFrame, ranks: tuple[str, ...] = ("species", "genus", "family"), outgroup: int = 20, seed: int = 0) -> DataFrame:
    """Distinct (sequence, taxid) records with a taxon at each rank, and ``trusted``: the p-value that distances to other families are larger than those within.

    Each record meets a bounded sample of its genus, or family, and of other families: the records of
    smallest hashes, so that no group is paired in full.
    """
    distinct = references.dropDuplicates(["sequence", "taxid"]).join(taxa.select("taxid", "path"), "taxid").where(X.has_rank(*ranks))
    r = distinct.select("id", "sequence", X.at_rank("genus")["taxid"].alias("genus"), X.at_rank("family")["taxid"].alias("family"))
    h = F.xxhash64("id", F.lit(seed))

    def some(df: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("h")
        return df.withColumn("h", h).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= outgroup).drop("__r")

    genus = some(r, "genus").groupBy("genus").agg(F.collect_list(F.struct("id", "sequence")).alias("g"))
    family = some(r, "family").groupBy("family").agg(F.collect_list(F.struct("id", "sequence")).alias("f"))
    others = [(x["id"], x["sequence"], x["family"]) for x in r.withColumn("h", h).orderBy("h").limit(5 * outgroup).collect()]  # a bounded sample
    rows = r.join(genus, "genus").join(family, "family")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, s, fam, g, f in zip(frame["id"], frame["sequence"], frame["family"], frame["g"], frame["f"]):
                gap = lambda t: (lambda d: d[1] - d[0])(lcs_distance(s, t))
                near, level = [x["sequence"] for x in g if x["id"] != ident], "genus"
                if not near:
                    near, level = [x["sequence"] for x in f if x["id"] != ident], "family"
                far = [t for _, t, other in others if other != fam][:outgroup]
                if near and far:
                    out.append((ident, stats.mann_whitney([gap(t) for t in far], [gap(t) for t in near], "greater")[1], level))
                else:
                    out.append((ident, 1.0 if not near else 0.0, "none"))
            yield pd.DataFrame(out, columns=["id", "__p", "__level"])

    found = rows.mapInPandas(run, "id string, __p double, __level string")
    out = distinct.join(found, "id", "left")
    return set_attributes(out, {"trusted": F.col("__p"), "trusted_level": F.col("__level")}).select(*references.columns)


def consensus_reads(df: DataFrame, slot: str = "sample", max_differences: int = 1, min_degree: int = 5, low_coverage: float = 0.0, k: int | None = None) -> DataFrame:
    """Per sample, each variant with ``min_degree`` neighbours or more becomes the consensus of its neighbourhood; others stay as they are."""
    from strandloom.kernels.graphs import consensus
    from strandloom.operators.denoise import error_edges, sample_nodes

    nodes = sample_nodes(df, slot)
    edges = error_edges(nodes, max_differences).select("sample", "son", "father")
    both = edges.union(edges.select("sample", F.col("father").alias("son"), F.col("son").alias("father")))
    other = nodes.select("sample", F.col("id").alias("father"), F.struct("sequence", "n").alias("o"))
    around = both.join(other, ["sample", "father"]).groupBy("sample", F.col("son").alias("id")).agg(F.collect_list("o").alias("near"))
    rows = nodes.join(around, ["sample", "id"], "left")

    @F.pandas_udf("struct<sequence:string,facts:string>")
    def run(s: pd.Series, n: pd.Series, near: pd.Series) -> pd.DataFrame:
        out = []
        for text, w, others in zip(s, n, near):
            if others is None or len(others) < min_degree:
                out.append((text, json.dumps({"consensus": False, "weight": int(w)})))
                continue
            made, facts = consensus([(text, int(w)), *((o["sequence"], int(o["n"])) for o in others)], k, low_coverage)
            out.append((made or text, json.dumps({"consensus": True, "weight": int(w) + sum(int(o["n"]) for o in others), "seq_degree": len(others)} | facts)))
        return pd.DataFrame(out, columns=["sequence", "facts"])

    out = rows.withColumn("__c", run("sequence", "n", "near"))
    return out.select("id", F.col("__c.sequence").alias("sequence"), F.col("n").alias("count"), "sample", F.from_json("__c.facts", "map<string,string>").alias("annotations"))
