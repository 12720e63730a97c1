"""Taxonomies as tables, and taxonomic operators over records.

A taxonomy is (taxid, parent, rank, scientific_name[, alt_names]); the root is its own parent.
``with_paths`` adds ``path``, the array of (taxid, rank, name) from the root down, once: after
that every ancestor test is an array expression in generated code, without recursion at query time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.records import attribute, raw_attribute, set_attributes

PATH = "array<struct<taxid:string,rank:string,name:string>>"


def with_paths(taxa: DataFrame, max_depth: int = 128) -> DataFrame:
    """Path doubling: each round joins a node's known ancestors to those of the highest one, so rounds grow with the logarithm of the depth."""
    own = taxa.select("taxid", "parent", F.array(F.struct("taxid", "rank", F.col("scientific_name").alias("name"))).alias("path"))
    cur = own.select("taxid", F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("next"), "path")
    depth = 1
    while depth < max_depth and cur.where("next is not null").limit(1).count():
        up = cur.select(F.col("taxid").alias("next"), F.col("next").alias("__n"), F.col("path").alias("__p"))
        cur = cur.join(up, "next", "left").select("taxid", F.when(F.col("__p").isNotNull(), F.col("__n")).alias("next"), F.when(F.col("__p").isNotNull(), F.concat("__p", "path")).otherwise(F.col("path")).alias("path"))
        cur = cur.checkpoint() if cur.sparkSession.conf.get("spark.checkpoint.dir", None) else cur.cache()
        depth *= 2
    return taxa.join(cur.select("taxid", "path"), "taxid")


def clean_taxid(text: Column) -> Column:
    """The identifier in ``code:taxid [name]@rank``, ``taxid@name@rank`` or a plain number."""
    return F.regexp_extract(F.regexp_replace(text, r"^\s*[A-Za-z]\w*:", ""), r"\w+", 0)


def taxid_text(code: str, taxid: str = "taxid", name: str = "scientific_name", rank: str = "rank", raw: bool = False) -> Column:
    return F.col(taxid) if raw else F.concat(F.lit(f"{code}:"), taxid, F.lit(" ["), name, F.lit("]@"), rank)


def resolve(df: DataFrame, taxa: DataFrame, aliases: DataFrame | None = None, column: str = "taxid") -> DataFrame:
    """Normal form of taxids: aliases become the current one; ``__known`` tells whether the taxonomy has it. The optimizer picks how to join."""
    out = df.withColumn(column, clean_taxid(F.col(column)))
    if aliases is not None:
        out = out.join(aliases.select(F.col("old_taxid").alias(column), F.col("taxid").alias("__new")), column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
    return out.join(taxa.select(F.col("taxid").alias(column), F.lit(True).alias("__known")), column, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))


def with_lineage(df: DataFrame, taxa: DataFrame, column: str = "taxid") -> DataFrame:
    """Add ``path`` by a left join; null without a known taxon."""
    return df.join(taxa.select(F.col("taxid").alias(column), "path"), column, "left")


def in_clade(*taxids: str) -> Column:
    """The path goes through one of the taxa."""
    return F.coalesce(F.exists("path", lambda x: x["taxid"].isin(*taxids)), F.lit(False))


def in_clade_of(key: str) -> Column:
    """The path goes through the taxon that an attribute holds."""
    t = clean_taxid(attribute(key))
    return F.coalesce(F.exists("path", lambda x: x["taxid"] == t), F.lit(False))


def outside_clades(*taxids: str) -> Column:
    """Not in one of the clades; records without a taxon are outside."""
    return ~in_clade(*taxids)


def has_rank(*ranks: str) -> Column:
    """All of the ranks are on the path."""
    found = F.transform("path", lambda x: x["rank"])
    return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(found, r), F.lit(False)) for r in ranks], F.lit(True))


def at_rank(rank: str, path: str = "path") -> Column:
    """The ancestor-or-self of the rank, nearest to the taxon; null without one."""
    found = F.filter(path, lambda x: x["rank"] == rank)
    return F.try_element_at(found, F.lit(-1))


def annotate_rank(df: DataFrame, *ranks: str) -> DataFrame:
    """``<rank>_taxid`` and ``<rank>_name``: NA if the path lacks the rank, nothing without a path."""
    for r in ranks:
        t = at_rank(r)
        df = set_attributes(df, {f"{r}_taxid": F.when(F.col("path").isNotNull(), F.coalesce(t["taxid"], F.lit("NA"))), f"{r}_name": F.when(F.col("path").isNotNull(), F.coalesce(t["name"], F.lit("NA")))})
    return df


def annotate_path(df: DataFrame) -> DataFrame:
    return set_attributes(df, {"taxonomic_path": F.transform("path", lambda x: F.concat(x["taxid"], F.lit("@"), x["name"], F.lit("@"), x["rank"]))})


def annotate_taxon(df: DataFrame) -> DataFrame:
    last = F.try_element_at("path", F.lit(-1))
    return set_attributes(df, {"taxonomic_rank": last["rank"], "scientific_name": last["name"]})


def lca(a: str, b: str) -> Column:
    """The last common element of two paths; null if there is none."""
    both = F.zip_with(a, b, lambda x, y: F.when(x["taxid"] == y["taxid"], x))
    n = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x.isNotNull(), 1).otherwise(0)).alias("n"), (s["on"] & x.isNotNull()).alias("on")))["n"]
    return F.when(n > 0, F.try_element_at(a, n))


def weighted_lca(entries: Column, error: float = 0.0, max_depth: int = 128) -> Column:
    """(taxid, rank, name, share) of weighted paths, as one expression over an array of (path, weight).

    From the root down the heaviest node among the paths still followed is taken (the smallest taxid of
    equal ones) and the share that stays is multiplied by its part of the weight; paths that have ended
    keep their weight. The node before the share falls below 1 - error is the answer.
    """
    threshold = 1.0 - error
    state = F.struct(entries.alias("left"), F.lit(1.0).alias("share"), F.lit(None).cast("struct<taxid:string,rank:string,name:string>").alias("node"), F.lit(False).alias("done"), F.lit(1.0).alias("kept"))

    def step(s: Column, i: Column) -> Column:
        going = F.filter(s["left"], lambda e: F.size(e["path"]) >= i)
        nodes = F.array_distinct(F.transform(going, lambda e: F.element_at(e["path"], i)))
        weigh = lambda n: F.aggregate(F.filter(going, lambda e: F.element_at(e["path"], i)["taxid"] == n["taxid"]), F.lit(0.0), lambda t, e: t + e["weight"])
        ranked = F.array_sort(F.transform(nodes, lambda n: F.struct((-weigh(n)).alias("w"), n["taxid"].alias("taxid"), n.alias("node"))))
        best = F.try_element_at(ranked, F.lit(1))
        total = F.aggregate(s["left"], F.lit(0.0), lambda t, e: t + e["weight"])
        share = s["share"] * F.try_divide(-best["w"], total)
        ends = s["done"] | (F.size(going) == 0) | (share < threshold)
        left = F.filter(s["left"], lambda e: (F.size(e["path"]) < i) | (F.try_element_at(e["path"], i)["taxid"] == best["taxid"]))
        return F.struct(F.when(ends, s["left"]).otherwise(left).alias("left"), F.when(ends, s["share"]).otherwise(share).alias("share"), F.when(ends, s["node"]).otherwise(best["node"]).alias("node"), ends.alias("done"), F.when(ends, s["kept"]).otherwise(share).alias("kept"))

    longest = F.least(F.coalesce(F.array_max(F.transform(entries, lambda e: F.size(e["path"]))), F.lit(0)), F.lit(max_depth))
    out = F.aggregate(F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>")), state, step)
    return F.struct(out["node"]["taxid"].alias("taxid"), out["node"]["rank"].alias("rank"), out["node"]["name"].alias("name"), out["kept"].alias("share"))


def annotate_lca(df: DataFrame, taxa: DataFrame, slot: str, error: float = 0.0, source: str = "taxid") -> DataFrame:
    """``<slot>_taxid``, ``_name`` and ``_error`` from the histogram of taxids; unknown taxids are left out.

    Records meet their result by a digest of the histogram: a number given to rows would differ where they are computed again.
    """
    entries = F.array_sort(F.map_entries(F.try_element_at("merged", F.lit(source))))
    tagged = df.withColumn("__entries", entries).withColumn("__key", F.sha2(F.to_json("__entries"), 256))
    long = tagged.select("__key", "__entries").dropDuplicates(["__key"]).select("__key", F.inline("__entries").alias("t", "w")).withColumn("t", clean_taxid(F.col("t")))
    long = long.join(taxa.select(F.col("taxid").alias("t"), "path"), "t")
    per = long.groupBy("__key").agg(F.collect_list(F.struct("path", F.col("w").cast("double").alias("weight"))).alias("e"))
    found = per.select("__key", weighted_lca(F.col("e"), error).alias("l"))
    out = tagged.join(found, "__key", "left")
    return set_attributes(out, {f"{slot}_taxid": F.col("l.taxid"), f"{slot}_name": F.col("l.name"), f"{slot}_error": F.round(1 - F.col("l.share"), 3)}).drop("__key", "__entries", "l")


def named(taxa: DataFrame, *patterns: str, fixed: bool = False, ignore_case: bool = True) -> DataFrame:
    """Taxa whose scientific or alternative name is, or matches, one of the patterns."""
    names = F.array_compact(F.array_append(F.map_values("alt_names"), F.col("scientific_name"))) if "alt_names" in taxa.columns else F.array("scientific_name")
    names = F.coalesce(names, F.array("scientific_name"))

    def hit(x: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | ((F.lower(x) == p.lower() if ignore_case else x == p) if fixed else x.rlike(("(?i)" if ignore_case else "") + p))
        return out

    return taxa.where(F.exists(names, hit))


def subclade(taxa: DataFrame, *taxids: str) -> DataFrame:
    return taxa.where(in_clade(*taxids))


def sub_taxonomy(taxa: DataFrame, taxid: str) -> DataFrame:
    """The path to a taxon and all below it."""
    up = taxa.where(F.col("taxid") == taxid).select(F.explode("path.taxid").alias("taxid"))
    return taxa.join(up.union(subclade(taxa, taxid).select("taxid")).distinct(), "taxid", "left_semi")


def parents(taxa: DataFrame, taxid: str) -> DataFrame:
    """(depth, taxid, rank, scientific_name) from a taxon up to the root; depth 0 is the taxon."""
    steps = taxa.where(F.col("taxid") == taxid).select(F.posexplode(F.reverse("path")).alias("depth", "t"))
    return steps.select("depth", "t.taxid", "t.rank", F.col("t.name").alias("scientific_name"))


def sons(taxa: DataFrame, taxid: str) -> DataFrame:
    return taxa.where((F.col("parent") == taxid) & (F.col("taxid") != taxid))


def ranks(taxa: DataFrame) -> DataFrame:
    return taxa.select("rank").distinct()


def from_records(df: DataFrame, key: str = "taxonomic_path", leaves: bool = False) -> DataFrame:
    """A taxonomy out of the records' ``taxid@name@rank`` paths; with ``leaves`` each record is a taxon below its own."""
    steps = F.from_json(raw_attribute(key), "array<string>")
    split = F.transform(steps, lambda x: F.split(x, "@"))
    long = df.select(F.posexplode(split).alias("i", "x"), split.alias("p"))
    taxa = long.select(F.element_at("x", 1).alias("taxid"), F.when(F.col("i") == 0, F.element_at("x", 1)).otherwise(F.element_at(F.element_at("p", F.greatest(F.col("i"), F.lit(1))), 1)).alias("parent"), F.element_at("x", 3).alias("rank"), F.element_at("x", 2).alias("scientific_name")).distinct()
    if leaves:
        below = df.where(F.size(split) > 0).select(F.format_string("SEQ%010d", F.col("input_order")).alias("taxid"), F.element_at(F.element_at(split, -1), 1).alias("parent"), F.lit("sequence").alias("rank"), F.col("id").alias("scientific_name"))
        taxa = taxa.union(below)
    return taxa


def class_at_rank(rank: str) -> Column:
    return F.coalesce(at_rank(rank)["taxid"], F.lit("NA"))


def newick(taxa: DataFrame, max_taxa: int = 100_000) -> str:
    """The taxa as a tree in Newick form; bounded, as a tree file is for a reader."""
    rows = taxa.select("taxid", "parent", "scientific_name", "rank").orderBy("taxid").limit(max_taxa + 1).collect()
    if len(rows) > max_taxa:
        raise ValueError(f"a tree of more than {max_taxa} taxa")
    known = {r["taxid"] for r in rows}
    below: dict[str | None, list] = {}
    for r in rows:
        below.setdefault(r["parent"] if r["parent"] in known and r["parent"] != r["taxid"] else None, []).append(r)
    done: dict[str, str] = {}
    stack = [(r, False) for r in below.get(None, [])]
    while stack:
        r, seen = stack.pop()
        if not seen:
            stack.append((r, True))
            stack += [(s, False) for s in below.get(r["taxid"], [])]
        else:
            inner = ",".join(done.pop(s["taxid"]) for s in below.get(r["taxid"], []))
            label = f"'{r['taxid']} [{r['scientific_name']}]@{r['rank']}'"
            done[r["taxid"]] = (f"({inner})" if inner else "") + label
    return ",".join(done[r["taxid"]] for r in below.get(None, [])) + ";"
