"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and further columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import bpe, chat, common, embeddings, gif, langid, packing, quality, similar, simhash, substrings, token_output, tokens
from strandloom.llm.common import connected_components, scratch_path, scratch_paths

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `h` int"


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    odd = [None, "", " ", "a", "!!", "two words", "tab\tand space  twice ", "x <|endoftext|> y", "Ünïcode – 漢字 don't.\r\nline", "w " * 3000 + "z" * 5000]
    texts = [*odd, *(prose(rng, rng.randrange(3, 300)) for _ in range(40))]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 0.5, 1) for i, t in enumerate([*texts, texts[12], texts[12] + " more"])]
    return spark.createDataFrame([*rows, rows[20]], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, links):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    df = spark.createDataFrame([*edges, *edges], "src long, dst long")
    want = classes(200, edges)
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(df.where("false")).count() == 0


def test_components_leave_few_files(spark, monkeypatch):
    rng = random.Random(35)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(400)]
    df = spark.createDataFrame(edges, "src long, dst long")
    made, write = [], common.write_table

    def counted(table, name):
        out, path = write(table, name)
        made.append(len(out.inputFiles()))
        return out, path

    monkeypatch.setattr(common, "write_table", counted)
    monkeypatch.setattr(common, "ROWS_A_FILE", 250, raising=False)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = classes(600, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert made[0] == 8 and len(made) > 2 and max(made[1:]) <= 2


def test_a_passage_is_joined_once_a_document(spark):
    rng = random.Random(36)
    passage = prose(rng, 120)
    texts = [passage, *(" ".join(f"{prose(rng, 40)} {passage}" for _ in range(5)) + " " + prose(rng, 30) for _ in range(3))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lost = substrings.repeats(docs).where("removed").select("doc_id", "kind", "id", "first", "size", "kept_doc_id", "kept_first").cache()
    runs = substrings.runs_of(lost.where("kept_doc_id = 0")).collect()
    assert len(runs) == len({(r["doc_id"], r["chunk"]) for r in runs}) > 0
    assert max(len({p["first"] - p["kept_first"] for p in r["places"]}) for r in runs) == 5
    left = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
    assert left[0] == passage and all(passage not in left[i] and len(left[i].split()) == 230 for i in (1, 2, 3))


def test_simhash(spark, docs, empty):
    rows = sorted(docs.select("doc_id", "text").distinct().collect())
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.simhash_classes(docs).collect()}
    fps = [fingerprint(r["text"]) for r in rows]
    assert [got[r["doc_id"]][0] & (1 << 64) - 1 for r in rows] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[r["doc_id"]][1] for r in rows] == classes(len(rows), links)
    assert simhash.simhash_classes(empty).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(classes(len(rows), links))


def test_similar_dedup(spark):
    rng = random.Random(12)
    texts = [prose(rng, 200) for _ in range(6)]
    edit = lambda t, at: " ".join("edited" if i in at else w for i, w in enumerate(t.split()))
    texts += [edit(texts[0], (30, 100, 170)), edit(texts[1], (5, 60, 120, 180)), edit(texts[2], range(20, 200, 15)), edit(texts[3], (50,)).upper(), "one two", "One  two", "two one", None, " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in ((t or "").lower().split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any((fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 2 for i, j in links)
    kept = simhash.similar_dedup(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, extra int"))
    assert {r["doc_id"] for r in kept.collect()} == set(classes(len(sets), links))


def test_pivots_find_what_no_band_does(spark):
    rng = np.random.default_rng(31)
    pairs = []
    while len(pairs) < 8:
        words = [f"w{i:x}" for i in rng.integers(1 << 40, size=67)]
        texts = [" ".join(words[:64]), " ".join([*words[:30], "other", *words[31:]])]  # 55 shingles of 68 in common
        sets = [simhash._near_shingles(t) for t in texts]
        bands = [substrings.band_keys(s, np.array([[0, len(s)]]), simhash.NEAR_BANDS)[0] for s in sets]
        if not np.isin(*bands).any():
            pairs.append(texts)
    rows = [t for pair in pairs for t in pair]
    kept = {r["doc_id"] for r in simhash.similar_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert {2 * i for i in range(8)} <= kept and len(kept) <= 8 + 2  # a pair meets with probability 0.9


@pytest.mark.parametrize("dense", [1, 4, 1000])
def test_pivot_links_between_components(spark, dense):
    rng = random.Random(32)
    sets = [sorted({rng.getrandbits(62) for _ in range(60)}) for _ in range(3)]
    sets += [sorted([*s[: 60 - cut], *(rng.getrandbits(62) for _ in range(cut))]) for s in sets for cut in (2, 4, 6, 20)]
    rows = [(i, len(s), np.packbits(simhash._votes(np.array(s, np.uint64)) > 0).view(np.int64).tolist(), [i % 2, 7], s) for i, s in enumerate(sets)]
    items = spark.createDataFrame(rows, "id long, n int, fp array<long>, keys array<int>, shingles array<long>")
    near = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    known = connected_components(spark.createDataFrame(links[:2], "src long, dst long"))
    found = similar.links_between(items.drop("shingles"), known, 0.8, simhash.NEAR_RADIUS, lambda wanted: items.join(wanted, "id").select("id", "shingles"), dense)
    got = [(r["src"], r["dst"]) for r in found.collect()]
    assert all(near(sets[a], sets[b]) for a, b in got)
    assert classes(len(sets), got + links[:2]) == classes(len(sets), links)


@pytest.mark.parametrize("dense", [1, 4, 1000])
def test_simhash_links_lose_none(spark, dense):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for c in centres for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense)
    at = {x: i for i, x in enumerate(signed)}
    got = [(at[r["src"]], at[r["dst"]]) for r in links.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in got)
    assert classes(len(fps), got) == classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def test_encoder_equals_the_library():
    enc = tokens.TextEncoder(BYTE_BPE)
    rng = random.Random(4)
    parts = [*"ab.,'! \n\t é1Z#", "  ", "\n\n", "<|endoftext|>", " it's", "漢字", "\x1c", " .", "word", " \n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    assert list(enc.encode_all(texts)) == [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_known_pieces_are_looked_up_once():
    class Counted(dict):
        lookups = 0

        def _count(self):
            Counted.lookups += 1

        def get(self, *a):
            self._count()
            return super().get(*a)

        def __getitem__(self, k):
            self._count()
            return super().__getitem__(k)

        def __contains__(self, k):
            self._count()
            return super().__contains__(k)

    enc = tokens.TextEncoder(BYTE_BPE)
    text = " ".join(f"word{i}" for i in range(500))
    want = np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.encode(text) == want
    enc.table.number = Counted(enc.table.number)
    assert enc.encode(text) == want and Counted.lookups <= 500


def library(path, docs):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    rows = docs.select("doc_id", "text").collect()
    return tok, [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]


def test_token_shards(spark, docs, empty):
    _, want = library(BYTE_BPE, docs)
    shards = token_output.write_tokens(docs, scratch_path(spark, "t"), BYTE_BPE, 0)
    got = sorted(token_output.read_tokens(spark, shards).select("start", "doc_id", "n_tokens", "ids_crc32", "ids").collect())
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in want)
    by = dict(want)
    at = 0
    for r in got:
        ids = np.array([*by[r["doc_id"]], 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    found = [token_output.read_document(s[0], 5) for s in shards]
    assert [f.tolist() for f in found if f is not None] == [[*by[5], 0]]
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, scratch_path(spark, "t"), BYTE_BPE, 0)).count() == 0


def test_packing(spark, docs, empty):
    _, want = library(BYTE_BPE, docs)
    rows = packing.pack(packing.token_pieces(docs, BYTE_BPE, 2)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((d, k, a, b - a, zlib.crc32(np.array([*ids, 2][a:b], "<u4").tobytes())) for d, ids in want for k, (a, b) in enumerate(packing.cut_points(len(ids) + 1)))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    lengths = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.lower_bound(lengths) <= len(bins) <= packing.lower_bound(lengths) + 1
    assert packing.pack(packing.token_pieces(empty, BYTE_BPE, 2)).count() == 0


def test_packing_bounds_and_rounds(spark, monkeypatch):
    assert packing.lower_bound(np.bincount([600] * 7, minlength=1025)) == 7 and packing.lower_bound(np.bincount([342] * 6, minlength=1025)) == 3
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randrange(1, 1025), i) for i in range(3000)]
    monkeypatch.setattr(packing, "GROUP", 1000)
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert len(got) == len(rows)
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=1025))
    assert bound <= len({r["sequence_id"] for r in got}) <= 1.03 * bound


def test_bpe(spark, docs, empty):
    tok, want = library(WORD_BPE, docs)
    got = sorted(map(tuple, bpe.round_trip(docs, WORD_BPE).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((d, len(i), sha(" ".join(map(str, i))), sha(tok.decode(i, skip_special_tokens=False))) for d, i in want)
    assert bpe.round_trip(empty, WORD_BPE).count() == 0


def test_gif(spark, docs, empty):
    media = gif.text_media(docs).cache()
    got = {r["doc_id"]: r for r in gif.media_features(media).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    frames = gif.frame_table(media.where("doc_id = 22")).collect()
    assert sum(sum(f["histogram"]) for f in frames) == got[22]["payload_bytes"] and [f["start_cs"] for f in frames] == [4 * i for i in range(len(frames))]
    assert gif.media_features(gif.text_media(empty)).count() == 0
    broken = media.where("doc_id = 22").withColumn("media", F.expr("substring(media, 1, 900)"))
    assert gif.media_features(broken).first()["payload_sha256"] is None and gif.frame_table(broken).count() == 0


def pack_codes(codes, size):
    bits = nb = 0
    out = bytearray()
    for c, w in codes:
        bits |= c << nb
        nb += w
        while nb >= 8:
            out.append(bits & 255)
            bits >>= 8
            nb -= 8
    return bytes(out) + (bytes([bits & 255]) if nb else b"")


def lzw(pixels, size):
    clear, w, table = 1 << size, size + 1, {bytes([i]): i for i in range(1 << size)}
    nxt, codes, cur = clear + 2, [(clear, size + 1)], b""
    for p in pixels:
        if cur + bytes([p]) in table:
            cur += bytes([p])
            continue
        codes.append((table[cur], w))
        if nxt < 4096:
            table[cur + bytes([p])] = nxt
            nxt += 1
            w += nxt - 1 == 1 << w and w < 12
        else:
            codes.append((clear, w))
            w, table, nxt = size + 1, {bytes([i]): i for i in range(clear)}, clear + 2
        cur = bytes([p])
    return pack_codes([*codes, (table[cur], w), (clear + 1, w)], size)


def test_lzw_and_disposal():
    rng = np.random.default_rng(0)
    for size, n, high in ((2, 100, 4), (8, 576, 256), (8, 30000, 256), (8, 50000, 3), (4, 20000, 2), (8, 9000, 1)):
        px = rng.integers(0, high, n).astype(np.uint8)
        assert (gif.lzw_decode(lzw(px.tolist(), size), size, n) == px).all()
    block = lambda s: b"".join(bytes([len(s[i : i + 255])]) + s[i : i + 255] for i in range(0, len(s), 255)) + b"\0"
    image = lambda x, y, w, h, px, dispose, clear=None, lace=0: b"\x21\xf9\x04" + bytes([dispose << 2 | (clear is not None), 5, 0, clear or 0, 0]) + b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, lace]) + b"\x02" + block(lzw(px, 2))
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = b"GIF89a\x02\0\x02\0\x81\0\0" + palette + image(0, 0, 2, 2, [1, 1, 1, 1], 1) + image(0, 0, 1, 2, [2, 0], 2, 0) + image(1, 0, 1, 2, [3, 3], 3) + image(0, 0, 2, 2, [2, 0, 0, 3], 0, 0, 0x40) + b"\x3b"
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    frames = list(gif.decode_gif(data))
    assert [f.canvas.tolist() for f in frames] == [[[red, red], [red, red]], [[green, red], [red, red]], [[none, blue], [none, blue]], [[green, red], [none, blue]]]
    assert [f.start for f in frames] == [0, 5, 10, 15]
    with pytest.raises(ValueError):
        list(gif.decode_gif(data[:60]))


def test_language(spark, docs, empty):
    rng = random.Random(6)
    words = {"aa": ["kala", "maka", "tala"], "bb": ["zyx", "wyz", "xyy"]}
    rows = [(i, prose(rng, 20, words["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb", "s", 0, 0.0, 0) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "aa", "s", 0, 0.0, 0), (901, "12 !", "bb", "s", 0, 0.0, 0), (902, rows[0][1], None, None, None, None, None)], DOCS)
    model = langid.fit(df, per_class=30, landmarks=8)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(200)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und", "und", "bb"]
    kept = langid.keep_identified(df, per_class=30, landmarks=8)
    assert kept.columns == df.columns and kept.count() == 201
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0 and langid.keep_identified(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    make = lambda g: prose(rng, 60, words) + (" vilex vilest" if g == 0 else "")
    grades = [rng.choice([0, 1, 2, 2]) for _ in range(1200)]
    texts = [" ".join(w + rng.choice(["***", "&&&", "$$$", "###", "%%%"]) for w in make(2).split()) if g == 1 else make(g) for g in grades]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 0.0, 0) for i, t in enumerate(texts)] + [(2000, None, "en", "s", 0, 0.0, 0), (2001, "", None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(g > 1), int(g == 0)) for i, g in enumerate(grades) if i < 1000] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.fit(df, labels)).collect()}
    right = [(got[i]["p_good"] >= quality.MIN_P) == (grades[i] == 2) for i in range(1000, 1200)]
    assert sum(right) >= 190 and all(0 <= r["expected_grade"] <= 2 for r in got.values()) and len(got) == 1202
    assert quality.keep_good(df, labels.where("false")).count() == 1202 and quality.keep_good(empty, labels).count() == 0


def test_substrings(spark, empty):
    rng = random.Random(8)
    passage = prose(rng, 60)
    own = [prose(rng, 200).split() for _ in range(30)]
    near = prose(rng, 80).split()
    other = near[:40] + ["changed"] + near[41:]
    rows = []
    for i, w in enumerate(own):
        text = " ".join(w)
        if i in (3, 7, 11, 20):
            text = " ".join(w[:90]) + f" {passage} " + " ".join(w[90:])
        if i in (5, 25):
            text += "\n" + " ".join(near if i == 5 else other)
        rows.append((i, text, "en", "s", len(text), 0.0, 0))
    df = spark.createDataFrame([*rows, (90, None, None, None, None, None, None), (91, "", "en", "s", 0, 0.0, 0), (None, rows[3][1], "en", "s", 0, 0.0, 0)], DOCS)
    out = {r["doc_id"]: r for r in substrings.remove_repeats(df).collect()}
    assert len(out) == 33 and all(out[i]["text"] == rows[i][1] for i in range(30) if i not in (7, 11, 20, 25))
    for i in (7, 11, 20):
        left = out[i]["text"]
        assert passage not in left and len(left.split()) < 230 and out[i]["n_chars"] == len(left)
        assert left.startswith(" ".join(own[i][:90])) and left.endswith(" ".join(own[i][90:]))
    assert len(out[25]["text"].split()) < 240 and out[25]["text"].startswith(" ".join(own[25]))
    found = substrings.repeats(df)
    assert {r["doc_id"] for r in found.collect()} == {3, 5, 7, 11, 20, 25} and {r["doc_id"] for r in found.where("removed").collect()} == {7, 11, 20, 25}
    assert substrings.remove_repeats(empty).count() == 0 and substrings.repeats(empty).count() == 0


def test_passages_go_to_their_ends(spark):
    rng = random.Random(14)
    texts, want = [], []
    for n in (51, 60, 80, 200):
        passage = [f"p{n}x{i}" for i in range(n)]
        other = passage[:100] + ["differs"] + passage[101:] if n == 200 else passage
        a, b, c, d = ([f"{rng.getrandbits(40):x}" for _ in range(70)] for _ in range(4))
        texts += [" ".join(a + passage + b), " ".join(c + other + d)]
        want += [texts[-2], " ".join([*c, *(["differs"] if n == 200 else []), *d])]
    out = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [" ".join(out[i].split()) for i in range(len(texts))] == want


@pytest.mark.parametrize("crowd", [2, 1000])
def test_common_passage_is_one_row_a_document(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd, raising=False)
    rng = random.Random(33)
    own = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passage, begins = own(110), [rng.randrange(5, 50) for _ in range(40)]
    own_words = [own(60) for _ in begins]
    rows = [(i, " ".join([*w[:at], *passage, *w[at:]])) for i, (w, at) in enumerate(zip(own_words, begins))]
    rows += [(0, " ".join(own(80))), (0, rows[0][1])]  # a kept doc_id that is there three times
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined = []
    real = substrings.write_table

    def seen(df, name):
        out = real(df, name)
        if name in ("lost", "runs"):
            joined.append((name, out[0].where("kind = 0").count() if name == "lost" else out[0].count()))
        return out

    monkeypatch.setattr(substrings, "write_table", seen)
    before = scratch_paths()
    left = substrings.remove_repeats(docs)
    tables = {p.rpartition("/")[2].rpartition("-")[0] for p in scratch_paths() - before}
    assert not tables & {"paragraphs", "lines", "met", "classes"}
    assert {r["doc_id"]: r["text"].split() for r in left.where("doc_id > 0").collect()} == dict(enumerate(own_words[1:], 1))
    assert joined[0][1] > 3 * 39 and dict(joined)["runs"] <= 2 * 39


def test_short_and_wrapped_paragraphs(spark):
    rng = random.Random(15)
    short, near, five = [f"s{i}" for i in range(16)], [f"n{i}" for i in range(36)], "one two three four five"
    wrapped = [f"w{i}" for i in range(60)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    changed = [*wrapped[:30], "changed", *wrapped[31:]]
    own = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(50)) for _ in range(8)]
    pairs = [(" ".join(short), " ".join(short)), (" ".join(near), " ".join([*near[:-2], "other", near[-1]])), (five, five), (wrap(wrapped, 9), wrap(changed, 7))]
    texts = [f"{own[2 * k + j]}\n\n{p[j]}\n\nend {k} {j}" for k, p in enumerate(pairs) for j in (0, 1)]
    out = {r["doc_id"]: r["text"].split() for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(8)] == [texts[i].split() if i % 2 == 0 else [*own[i].split(), "end", str(i // 2), "1"] for i in range(8)]


@pytest.mark.parametrize("dense", [2, 8, 1000])
def test_line_links_lose_none(spark, monkeypatch, dense):
    monkeypatch.setattr(similar.similar_links, "__defaults__", (dense, 2))
    rng = random.Random(11)
    base = list(range(100))
    sets = [rng.sample(base, rng.randrange(80, 101)) + rng.sample(range(100, 140), rng.randrange(0, 12)) for _ in range(60)]
    sets += [list(range(k, k + 90)) for k in range(200, 300, 6)] + [sets[0]]
    rows = [(i, [i % 3, 7], sorted(s)) for i, s in enumerate(sets)]
    got = [(r["src"], r["dst"]) for r in substrings.line_links(spark.createDataFrame([*rows, rows[5]], "id long, keys array<long>, shingles array<int>")).collect()]
    near = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    assert all(near(sets[a], sets[b]) for a, b in got)
    assert classes(len(sets), got) == classes(len(sets), links)


def test_chat(spark):
    rows = []
    say = lambda c, *turns: rows.extend((c, i, r, t, "more") for i, (r, t) in enumerate(turns))
    a, b, c = ("user", "hi"), ("assistant", None), ("user", "")
    say(1, a), say(2, a, b), say(3, a, b, c), say(4, a, b, c), say(5, a, c), say(6, ("user", "hi there")), say(7, (None, None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string").repartition(3)
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert {k: (r["n_turns"], r["n_equal"]) for k, r in got.items()} == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1)}
    assert got[3]["chat"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\n\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat.render(df.where("false")).count() == 0


def test_chat_order_over_partitions(spark, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(None, t, r, f"text {i:03d}") for t in (None, 1) for r in ("assistant", "user") for i in range(300)]
    random.Random(13).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [r[0] for r in chat.prefix_hashes(df).orderBy("place").select(F.struct("place", "role", "text")).collect()]
    want = [(r, x) for _, _, r, x in sorted(rows, key=lambda r: (r[1] or 0, r[2], r[3]))]
    assert [(r["role"], r["text"]) for r in got] == want and [r["place"] for r in got] == list(range(1, 1201))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 20))
    x = np.concatenate((base, base[:80] + rng.standard_normal((80, 20)) * 0.15, base[:20])).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 2 if i < 280 else int(i - 280) % 2) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 20, 1), (902, [float("nan")] * 20, 1), (903, rows[0][1], None), (904, [1.0], 0), (905, [], 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    linked = (v @ v.T >= 0.98) & (labels[:, None] == labels[None, :])
    want = classes(len(x), [(i, j) for i, j in zip(*np.nonzero(linked)) if i < j])
    for cell, crowd in ((1000, 4096), (10, 4096), (1000, 16)):
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "CROWD", crowd)
        got = {r["vec_id"]: r for r in embeddings.near_classes(df).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == want
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, *_ in odd)
    assert embeddings.near_classes(df.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(i, prose(rng, 120, words) + (" vilex" if i % 9 == 0 else ""), "en" if i % 3 else "fr", "s", 0) for i in range(120)]
    rows += [(200, rows[1][1], "en", "s", 0), (201, "123", "en", "s", 0), (202, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = corpus_pipeline.identify(spark, docs, str(tmp_path))
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} >= set(range(120)) and told.where("doc_id in (201, 202)").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert 200 not in ids and 1 in ids and not ids & {i for i in range(0, 120, 9)}


def test_bpe_over_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 700)
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id"), (None, None), (7, "again  &&& don't\x1c<|endoftext|>")], "doc_id long, text string")).repartition(3)
    tok, want = library(WORD_BPE, rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted(map(tuple, bpe.round_trip(rows, WORD_BPE).collect()), key=key)
    assert got == sorted(((d, len(i), sha(" ".join(map(str, i))), sha(tok.decode(i, skip_special_tokens=False))) for d, i in want), key=key)
    pieces = {r["id"]: r["piece"] for r in bpe.vocabulary(spark, WORD_BPE).collect()}
    assert len(pieces) == tok.get_vocab_size() and all(pieces[i] == tok.id_to_token(i) for i in (0, 300, 49407))


def test_words_equal_the_library():
    enc = bpe.WordEncoder(WORD_BPE)
    rng = random.Random(16)
    parts = [*"abÀéßÿ.,'&!<|>0AZ", "'s", "<|endoftext|>", "İ", "ﬁ", "漢", "é", "Σ", "&&&"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(5000)]
    flat, lengths = enc.encode(words)
    want = [e.ids for e in enc.tok.encode_batch(words, add_special_tokens=False)]
    assert enc.by_part and lengths.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]


def test_gif_of_others(spark):
    block = lambda s: b"".join(bytes([len(s[i : i + 255])]) + s[i : i + 255] for i in range(0, len(s), 255)) + b"\0"
    image = lambda x, y, w, h, px, dispose, clear=None: b"\x21\xf9\x04" + bytes([dispose << 2 | (clear is not None), 7, 0, clear or 0, 0]) + b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, 0]) + b"\x02" + block(lzw(px, 2))
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 90, 90, 90])
    foreign = b"GIF89a\x02\0\x02\0\x81\0\0" + palette + image(0, 0, 2, 2, [0, 0, 1, 1], 1) + image(0, 0, 1, 2, [2, 3], 2, 3) + image(1, 0, 1, 1, [3], 3) + image(0, 1, 2, 1, [2, 1], 0) + b"\x3b"
    grey = gif.encode_gif(gif.pad_payload(b"abc" * 700))
    red = grey[:13] + bytes([255, 0, 0]) * 256 + grey[13 + 768 :]
    media = spark.createDataFrame([(1, 0, foreign), (2, 2100, grey), (3, 2100, red), (4, 0, b"GIF89a"), (5, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in gif.media_features(media).collect()}
    assert got[4]["feature"] is None and got[5]["feature"] is None and got[4]["timed"] is None
    for k, m in ((1, foreign), (2, grey), (3, red)):
        frames = list(gif.decode_gif(m))
        slow = [[sum(1 for p in f.canvas.reshape(-1, 4).tolist() if p[3] and (p[0] >> 6) * 16 + (p[1] >> 6) * 4 + (p[2] >> 6) == c) for c in range(64)] for f in frames]
        assert got[k]["histogram"] == [sum(c) for c in zip(*slow)] and got[k]["frames"] == len(frames)
        assert [(t["start_cs"], t["delay_cs"], {c["colour"]: c["pixels"] for c in t["colours"]}) for t in got[k]["timed"]] == [(f.start, f.delay, {c: n for c, n in enumerate(s) if n}) for f, s in zip(frames, slow)]
    assert [t["start_cs"] for t in got[1]["timed"]] == [0, 7, 14, 21] and got[2]["payload_sha256"] == got[3]["payload_sha256"] and got[2]["feature"] != got[3]["feature"]
    assert got[3]["histogram"][48] == got[3]["payload_bytes"] == 2304


def test_gif_codes_are_near_a_plain_coder():
    rng = np.random.default_rng(3)
    words = [f"w{i} ".encode() for i in rng.integers(0, 200, 200)]
    text = b"".join(words[i] for i in rng.integers(0, 200, 40_000))
    frames = [rng.integers(0, 256, (5, 576)), rng.integers(0, 2, (5, 576)), np.zeros((1, 576)), rng.integers(90, 95, (600, 576)), np.frombuffer(text[: 576 * 200], np.uint8).reshape(-1, 576)]
    for f in (f.astype(np.uint8) for f in frames):
        plain = [lzw(x.tolist(), 8) for x in f[:40]]
        got = [s for i in range(0, len(f), 512) for s in gif._streams(*gif._lzw_codes(f[i : i + 512]))]
        assert (gif.lzw_decode_all(got, 8, 576) == f).all() and (gif.lzw_decode_all(plain, 8, 576) == f[:40]).all()
        assert sum(map(len, got[:40])) <= 1.06 * sum(map(len, plain))
    assert len(gif.encode_gif(b"a" * 40320)) < 10_000


def test_exact_filling_and_one_repeated_row(spark):
    rng = random.Random(17)
    for lengths in ([700, 300, 24, 500, 500, 24, 1024, 1], [rng.randrange(1, 1025) for _ in range(4000)], [342] * 30, [], [512, 512]):
        x = np.array(lengths, np.int64)
        bins, offsets, fill = packing.fill_exactly(x)
        assert all((fill <= 1024).tolist()) and fill.sum() == x.sum() and len(set(bins.tolist())) == len(fill)
        for k in range(len(fill)):
            own = sorted(zip(offsets[bins == k].tolist(), x[bins == k].tolist()))
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert len(packing.fill_exactly(np.array([700, 300, 24, 500, 500, 24]))[2]) == 2
    got = packing.pack(spark.createDataFrame([(7, 0, 0, 300, 5)] * 500, packing.PIECES)).collect()
    assert len(got) == 500 and len({r["sequence_id"] for r in got}) == 167


def test_filters_keep_columns_of_clashing_names(spark):
    words = {"aa": ["kala", "maka", "tala"], "bb": ["zyx", "wyz", "xyy"]}
    rng = random.Random(18)
    rows = [(i % 50, prose(rng, 12, words["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb", 7.5, "mine", f"s{i}") for i in range(120)]
    rows += [(60, "z" * 2_000_000 + " " + "kala " * 1000, "aa", 7.5, "mine", "long"), (61, None, None, None, None, None), (None, "kala maka", "aa", 7.5, "mine", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, __spans string").withColumns({"p_good": F.lit(0.25), "expected_grade": F.lit("x"), "__grade": F.lit(1), "__Lang": F.lit(2)})
    told = langid.keep_identified(df, per_class=20, landmarks=4)
    assert told.columns == df.columns and {(r["score"], r["lang_pred"], r["p_good"]) for r in told.collect()} == {(7.5, "mine", 0.25)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] * 3, "doc_id long, quality int, toxic int")
    good = quality.keep_good(df, labels, max_rows=40)
    assert good.columns == df.columns and {(r["p_good"], r["expected_grade"], r["__grade"]) for r in good.collect()} == {(0.25, "x", 1)}
    cut = substrings.remove_repeats(df)
    assert cut.columns == df.columns and {r["__spans"] for r in cut.where("text is not null").collect()} <= {r[5] for r in rows}


def test_kernel_equals_a_plain_one():
    rng = random.Random(19)
    texts = [prose(rng, 15, [a + b for a in p for b in "aeiou"]) for p in ("klm", "rst", "klrs") for _ in range(12)]
    langs = [x for x in ("a", "b", "c") for _ in range(12)]
    codes = [langid.gram_codes(t) for t in texts]
    model = langid.fit_kernel(codes, langs, landmarks=12)
    grams = [{(" " + t + " ")[i : i + k] for k in (1, 2, 3) for i in range(len(t) + 3 - k)} for t in texts]
    plain = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    assert np.allclose(model.kernel(codes), plain, atol=1e-5)
    # with every text a landmark the Nyström map is the kernel itself, so ridge on it is kernel ridge regression
    values, vectors = np.linalg.eigh(plain)
    good = values > 1e-6 * values.max()
    phi = plain @ vectors[:, good] / np.sqrt(values[good])
    y = (np.array(langs)[:, None] == np.array(["a", "b", "c"])[None, :]).astype(float)
    z, t = phi - phi.mean(0), y - y.mean(0)
    want = z @ np.linalg.solve(z.T @ z + 1e-3 * np.eye(z.shape[1]), z.T @ t) + y.mean(0)
    got = model.kernel(codes).astype(float) @ model.weights + model.bias
    assert np.allclose(got, want, atol=0.02)


def test_ordinal_gradient_fits_by_likelihood():
    rng = np.random.default_rng(4)
    x = [np.unique(rng.integers(0, 400, 30)).astype(np.int32) for _ in range(900)]
    w = np.zeros(quality.BUCKETS)
    w[:400] = rng.standard_normal(400)
    s = np.array([w[f].sum() / quality.scale(len(f)) for f in x])
    grades = np.digitize(s + 0.1 * rng.logistic(size=len(s)), np.quantile(s, [0.3, 0.6]))
    model = quality.fit_ordinal(x[:700], grades[:700])
    tails = model.tails(x[700:])
    rank = lambda v: np.argsort(np.argsort(v))
    assert model.thresholds[0] < model.thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()
    assert np.corrcoef(rank(tails.sum(axis=1)), rank(s[700:]))[0, 1] > 0.7
    below = lambda m, f, k: 1 / (1 + np.exp(-(m.thresholds[k] - m.weights[f].sum() / quality.scale(len(f)))))
    assert np.allclose(tails, [[1 - below(model, f, k) for k in (0, 1)] for f in x[700:]])


def test_substring_recall_of_near_lines(spark):
    rng = random.Random(20)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, pairs = [], []
    for k in range(90):
        words = [f"{rng.getrandbits(30):x}" for _ in range(rng.randrange(30, 120))]
        other = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(0, 4)):
            other[at] = "edited" + str(rng.random())
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = sets(rows[-2][1]), sets(rows[-1][1])
        pairs.append((2 * k, len(a & b) / len(a | b)))
    rows += [(500, rows[0][1]), (501, "\n\n".join([rows[2][1], "z " * 900_000])), (501, rows[4][1])]
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 1 and removed").select("doc_id", "kept_doc_id").distinct().collect()
    got = {(r["kept_doc_id"], r["doc_id"]) for r in found}
    near = {(a, a + 1) for a, s in pairs if s >= 0.8}
    assert len(near) > 40 and len(near & got) >= 0.9 * len(near)
    assert got - {(0, 500), (2, 501), (4, 501), (0, 1), (2, 3), (4, 5)} <= near


def test_rows_without_or_with_equal_ids(spark):
    rows = [(None, "no id here"), (3, "b b b"), (3, "a a"), (1, None), (3, "b b b"), (None, None), (2, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok, _ = library(BYTE_BPE, df)
    shards = token_output.write_tokens(df, scratch_path(spark, "t"), BYTE_BPE, 0)
    got = sorted(token_output.read_tokens(spark, shards).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, None, 1, 2, 3, 3, 3] and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    want = sorted((d is not None, d or 0, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    classes_ = simhash.simhash_classes(df).collect()
    assert len(classes_) == 7 and {r["component_id"] for r in classes_ if r["fp"] == classes_[0]["fp"]} != {None}
    same = {r["component_id"] for r in classes_ if r["doc_id"] == 2}
    assert same == {2}
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_classes(df).collect()}
    assert (2, 2) in near and (None, None) in near
    turns = spark.createDataFrame([(None, None, "user", "hi"), (None, 1, None, None), (4, 1, "user", "hi"), (4, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert {(r["conv_id"], r["n_turns"]) for r in chat.render(turns).collect()} == {(None, 2), (4, 2)}


def test_a_worker_keeps_one_operators_table():
    import pyarrow as pa

    from strandloom.llm import quality, simhash

    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array(["one two three four five six"])})
    quality.features("some words of a text")
    assert quality._words and [b.num_rows for b in simhash._near_batches(iter([batch]))] == [1]
    assert not quality._words  # what near-dedup does not read is not held meanwhile


def test_tables_relieve_the_driver(spark, monkeypatch):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1), raising=False)
    monkeypatch.setattr(common, "_relieved_until", 0.0, raising=False)
    monkeypatch.setattr(common, "REST_S", 3600, raising=False)
    before = collections()
    for _ in range(3):
        common.write_table(spark.range(3), "relief")
    assert collections() == before + 1 and given == [1]  # at once, and not again before it has rested
    assert "Trim native heap" in common._trim_jvm(spark)
