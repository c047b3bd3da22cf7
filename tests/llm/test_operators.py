"""Each operator against brute force, and over nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stellate.llm import byte_bpe, lengths, near_copies, perspectives, quality, repeats, sstable, toxicity, urls, winnowing
from stellate.llm import common

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, rest string, id string, chosen string, c0 string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else "".join(rng.choice(["ka", "to", "mi", "re", "su", "né"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (60, 80, 200, 400)]
    words = base[2].split()
    words[50] = "changed"
    shared = prose(rng, 40)
    out = [*base, base[0], " ".join(words), None, "", " ", "one", "a b c", "x" * 3000, "spam " * 300, prose(rng, 70) + " " + shared, prose(rng, 90) + " " + shared + " " + prose(rng, 5), base[3] + "é" * 400 + base[3], prose(rng, 20_000)]
    return [(i, t) for i, t in enumerate(out)] + [(None, "an id that is null " * 8), (4, base[0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "r", "i", "c", "z") for i, t in texts()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_shards(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(sstable.encode_to_shards(docs)) == sorted(expected, key=lambda r: (r[0] is not None, r))
    assert sstable.encode_to_shards(none).collect() == []


def test_word_encoder_is_the_tokenizer():
    encoder = sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["٠", "०0", "0", "x̀", "Á.", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "a\x1cb", "İ", "Σς", "don't", "100.0", "🙂", "a b", "ﬁ", "THE"]
    for text in (" ".join(odd), "\n".join(odd[::-1]), *odd):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_composes_before_it_folds():
    encoder = sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [c + mark for c, mark in zip("HTWYJ", "\u0331\u0308\u030a\u030a\u030c")]
    for text in (*words, " ".join(words), "Ab" + "Cd".join(words), "É T THE"):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_shard_lookup():
    entries = [(sstable.key_of(i), bytes(2 * (i % 5 + 1))) for i in range(-500, 500, 2)] + [(sstable.key_of(500), b"ab"), (sstable.key_of(500), b"cd")]
    shard = sstable.in_memory(entries, 2, block_bytes=128)
    assert len(shard.index) > 10 and list(shard.scan()) == entries
    assert shard.get(sstable.key_of(-500)) == [bytes(2 * (-500 % 5 + 1))] and shard.get(sstable.key_of(500)) == [b"ab", b"cd"] and shard.get(sstable.key_of(7)) == []
    assert [sstable.identifier_of(sstable.key_of(x)) for x in (None, -3, 8, "k")] == [None, -3, 8, "k"]


def test_shards_of_one_identifier(spark):
    """Its rows go to several shards, in order of their texts; lookups find all; writing again harms nothing."""
    rng = random.Random(31)
    made = [(5, prose(rng, 12)) for _ in range(300)] + [(5, None), (None, "x"), (9, "y"), (9, "y")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    path = common.scratch(spark, "test")
    shards = sstable.write_shards(df, path, shards=6)
    again = sstable.write_shards(df, path, shards=6)
    assert len(shards) > 3 and [s[1:] for s in shards] == [s[1:] for s in again] and not {s[0] for s in shards} & {s[0] for s in again}
    encoder = sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [[*np.frombuffer(encoder.encode([t])[0], "<u2").tolist(), 2] for t in [None, *sorted(t for i, t in made if i == 5 and t)]]
    found = sstable.lookup([s[0] for s in shards], [5, 9, None, 6])
    assert [x.tolist() for x in found[5]] == want and len(found[9]) == 2 and len(found[None]) == 1 and found[6] == []
    assert sorted(tuple(r) for r in sstable.read_shards(spark, shards).where("doc_id is not null").collect()) == sorted(tuple(r) for r in sstable.read_shards(spark, again).where("doc_id is not null").collect())
    assert common.discard_scratch(spark) and not common.GIVEN


def test_other_vocabularies_are_encoded_whole():
    encoder = sstable.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  words,\nand THREE more"
    assert not encoder.by_word and np.frombuffer(encoder.encode([text, None])[0], "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).by_word


def test_rules_of_one_label(spark):
    """Many nested rules below one top-level label, swept over several partitions."""
    rng = random.Random(32)
    hosts = ["com", *(f"{a}.com" for a in "abcdef"), *(f"{b}.{a}.com" for a in "abc" for b in "xyz")]
    rules = sorted({h + p: rng.choice(["allow", "block"]) for h in hosts for p in rng.sample(["/", "/a", "/a/b", "/a/b/c", "/b", ""], 3)}.items())
    cases = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c/d', '/ab', '/b?x', '/c'])}" for _ in range(400)]

    def judge(url):
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (m[1] == (h := r.split("/")[0]) or m[1].endswith("." + h)) and m[2].startswith(r[len(h) :])]
        return (m[1], m[2], max(fits)[2], max(fits)[3]) if fits else (m[1], m[2], None, "allow")

    found = urls.judge_urls(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), urls.rules_table(spark, rules))
    assert rows(found) == [(i, *judge(u)) for i, u in enumerate(cases)]


def test_parts_of_turns_without_numbers(spark):
    """Equal, null and negative turn numbers: no part has more turns than the limit, and the parts make up the dialogue."""
    rng = random.Random(33)
    turns = [(None if i % 2 else 1, rng.choice([None, -5, 3, 3]), rng.choice(["ann", "bob", None, "system"]), rng.choice([None, "hi", prose(rng, 4)])) for i in range(240)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["speaker"]): r["text"] for r in perspectives.rotate(df, part_turns=1_000).collect()}
    parts, found = defaultdict(str), perspectives.rotate(df, part_turns=8).collect()
    for r in sorted(found, key=lambda r: r["part"]):
        assert r["n_turns"] <= 8 and len(parts[r["conv_id"], r["speaker"]]) == r["part_start"]
        parts[r["conv_id"], r["speaker"]] += r["text"]
    assert parts == whole and len(whole) == 6 and max(r["part"] for r in found) == 14


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.net/en/x", "block"), ("com", "block"), ("b.com/p", "allow")]
    cases = ["http://net/", "http://a.NET/x?q", "https://www.example.net/en/1", "https://example.net/en/x/y", "http://example.net", "http://xexample.net/en/", "ftp://b.com/path#f", "http://com", "nothing", None, "", "://", "http://a.b.com/P", "http://net/"] + ["http://hot.net/en/"] * 50
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").selectExpr("page_id", "url", "'x' as key", "'y' as host")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")

    assert rows(urls.judge_urls(pages, urls.rules_table(spark, rules))) == [(i, *judge(u)) for i, u in enumerate(cases)]
    assert {r["verdict"] for r in urls.judge_urls(pages, urls.rules_table(spark, [])).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), urls.rules_table(spark)).collect() == []


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, None, None, "lone"), (None, 0, "cy", "x"), (3, 0, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'p' as part", "'s' as speaker")
    whole = {(r["conv_id"], r["speaker"]): r for r in perspectives.rotate(df).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "cy")}
    r = whole[1, "ann"]
    assert r["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n" + "<|assistant|>\nbye<|end|>\n" * 2
    assert [r["text"][int(a) : int(b)] for a, b in (m.split(":") for m in r["mask"].split(","))] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"] and r["mask_chars"] == 29
    parts = defaultdict(str)
    for r in sorted(perspectives.rotate(df, part_turns=2).collect(), key=lambda r: r["part"]):
        assert len(parts[r["conv_id"], r["speaker"]]) == r["part_start"]
        parts[r["conv_id"], r["speaker"]] += r["text"]
    assert parts == {k: r["text"] for k, r in whole.items()}
    assert perspectives.rotate(df.limit(0)).collect() == []


def test_toxicity(spark, docs, none):
    rng, made = random.Random(5), []
    for i in range(2_400):
        words = prose(rng, rng.randint(30, 120)).split()
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grolk", "vexnit", "zorbed"]) + rng.choice(["", "ing", "o"]))
        made.append((i, " ".join(words), int(bad)))
    labelled = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    found = toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string"), labelled).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in found)
    truth = {i: y for i, _, y in made}
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert {r["score"] for r in toxicity.score(docs, labelled.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, labelled).collect() == []


def test_toxicity_scores_are_those_of_the_compressor(spark, docs):
    """Every window compressed by the library anew, and the logistic function written out; null, empty and long texts under a fitted model."""
    import math

    import zstandard as z

    rng = random.Random(15)
    made = [(i, prose(rng, 60) + " grolk vexnit zorbed" * (i % 4 == 0) + " " + prose(rng, 30)) for i in range(240)]
    labels = [(i, int(i % 4 == 0)) for i, _ in made] + [(4, 0), (4, None), (None, 1), (5, None), (9, 0), (9, 0)]
    train = spark.createDataFrame([*made, made[3], (7, "another text of an id")], "doc_id long, text string")
    model = toxicity.fit(train, spark.createDataFrame(labels, "doc_id long, toxic int"))
    header, common, toxic, weights = model
    params = z.ZstdCompressionParameters(
        window_log=20, chain_log=20, hash_log=20, search_log=8, min_match=3, target_length=256, strategy=z.STRATEGY_BTOPT, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    kind = z.DICT_TYPE_FULLDICT if header else z.DICT_TYPE_RAWCONTENT

    def size(window, content):
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(header + content, dict_type=kind), compression_params=params).compress(window))

    def brute(text):
        words = [w[k : k + 64] for w in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split() for k in range(0, len(w), 64)]
        parts = [b" " + b" ".join(words[k : k + 7]) + b" " for k in range(0, len(words), 7)]
        gains = [size(p, common) - size(p, toxic + common) for p in parts] or [0]
        hits = [sum(g >= c for g in gains) for c in (2, 3, 4)]
        x = [math.log2(1 + n) for n in hits] + [min(1, 10 * n / len(gains)) for n in hits] + [sum(gains) / len(gains), min(10, max(gains)) / 8]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, weights)) + weights[-1])))

    some = docs.where("length(text) < 4000 or text is null")
    found = toxicity.scored(some.select("doc_id", "text"), model).join(some.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(found) >= 10 and any(not r["text"] for r in found)
    for r in found:
        assert r["predicted"] == (r["score"] >= 0.3) and (r["doc_id"] == 4 or abs(r["score"] - brute(r["text"])) < 1e-9)
    assert toxicity.scored(docs, model).count() == docs.count() and sum(map(len, (common, toxic))) > 0


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, "x" * 100 + str(i)) for i in range(200)] + [(0, "a"), (500, "y" * 30_000), (501, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(502)] * 2, "doc_id long, toxic int")
    found, counts = toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 60, 2_000)
    assert len({i for i, _, _ in found}) == len(found) and all(sum(len(t) for _, y, t in found if y == c) <= 2_000 and sum(y == c for _, y, _ in found) > 10 for c in (0, 1))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 and i < 500 for i, _, _ in found) and sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(502))


def links_of(pairs):
    """Class (least id, null last) and links of each row, by its place."""
    sh = near_copies.Shingler()
    sets = [set(sh(t).tolist()) for _, t in pairs]
    up, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if j != i and a and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (id_, _) in enumerate(pairs):
        if id_ is not None:
            least[find(i)] = min(id_, least.get(find(i), id_))
    return [(least.get(find(i)), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("limits", [{}, {"unit_nodes": 4, "unit_shingles": 2000}])
def test_near_copies(spark, docs, none, limits):
    rng, made = random.Random(7), []
    base = prose(rng, 150).split()
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(150)] = "w" + str(rng.randrange(9))
        made.append(" ".join(own))
    made += [prose(rng, 60) for _ in range(10)] + [None, "", "a b", "a b"]
    pairs = list(enumerate(made))
    found = near_copies.near_copies(spark.createDataFrame(pairs, "doc_id long, text string"), **limits).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == dict(enumerate(links_of(pairs)))
    if not limits:
        assert len(near_copies.near_copies(docs).collect()) == len(texts())
        kept = near_copies.keep_one(docs)
        lead = {c for c, _ in links_of(texts())}
        assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(lead, key=str) and not {4, 5} & lead
        assert near_copies.near_copies(none).collect() == [] and near_copies.keep_one(none).collect() == []


def odd_rows(rng):
    """Rows of equal and of null ids: copies, near copies and others, with identical rows among them."""
    base = [prose(rng, 90) for _ in range(4)]
    near = [b + " " + prose(rng, 3) for b in base]
    rows = [(7, base[0]), (7, near[0]), (7, base[1]), (7, base[1]), (None, near[1]), (None, base[2]), (None, base[2]), (9, near[2]), (None, base[3]), (None, near[3]), (3, prose(rng, 50)), (None, None), (None, ""), (3, "")]
    return [*rows, (12, near[0])]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_of_odd_ids(spark, kind):
    made = [(i if kind == "long" or i is None else f"id {i:03}", t) for i, t in odd_rows(random.Random(11))]
    df = spark.createDataFrame(made, f"doc_id {kind}, text string")
    expected = links_of(made)
    alone = [not near_copies.Shingler()(t).size for _, t in made]
    expected = [(i if lone else c, n) for (i, _), (c, n), lone in zip(made, expected, alone)]
    found = near_copies.near_copies(df).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in found), key=str) == sorted(((i, c, n) for (i, _), (c, n) in zip(made, expected)), key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in near_copies.keep_one(df).collect()), key=str)
    sh, groups = near_copies.Shingler(), []
    for i, t in made:  # classes as lists of rows; those without words by themselves
        own = set(sh(t).tolist())
        near = [g for g in groups if own and any(9 * len(own & o) >= 4 * (len(own) + len(o)) for _, _, o in g)]
        groups = [g for g in groups if all(g is not n for n in near)] + [[x for n in near for x in n] + [(i, t, own)]]
    assert len(kept) == len(groups)
    for g in groups:
        mine = [r for r in kept if any(r == (i, t) for i, t, _ in g)]
        ids = [i for i, _, _ in g if i is not None]
        assert [r for r in mine if r[0] == (min(ids) if ids else None)]


def test_prefixes_are_shortened_until_the_recall_is_reached():
    for trees, recall in ((16, 0.9995), (8, 0.99), (4, 0.999999)):  # without links, the longest that finds the least similar pairs
        d = near_copies.next_depth(np.zeros(20), 8, trees, recall)
        assert (d == 1 or 1 - (1 - 0.8**d) ** trees >= recall) and 1 - (1 - 0.8 ** (d + 1)) ** trees < recall
    high, low = np.zeros(20), np.zeros(20)
    high[19], low[0] = 1000, 1000
    assert near_copies.next_depth(high, 8) == 8 and near_copies.next_depth(low, 8) == 4 and 4 < near_copies.next_depth(high + low / 100, 8) < 8


def test_the_forest_finds_nine_links_in_ten_and_more(spark):
    """Against all pairs of a table."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    df = spark.read.parquet(path)
    made = [(r["doc_id"], r["text"]) for r in df.collect()]
    sh = near_copies.Shingler()
    sets = [sh(t) for _, t in made]
    sizes, owner = np.array([len(x) for x in sets]), defaultdict(list)
    for i, x in enumerate(sets):
        for v in x.tolist():
            owner[v].append(i)
    common = defaultdict(int)
    for own in owner.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                common[i, j] += 1
    links = sum(9 * n >= 4 * (sizes[i] + sizes[j]) for (i, j), n in common.items())
    found = sum(r["n_links"] for r in near_copies.near_copies(df).collect()) // 2
    assert links > 50 and 0.9 * links <= found <= links
    assert found == links  # as measured: none is lost here


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limits", [{}, {"literals_most": 2, "windows_most": 2}])
def test_contamination(spark, docs, none, limits):
    rng = random.Random(9)
    longer = prose(rng, 30)
    items = [(1, longer), (2, "Short Item here"), (3, None), (4, "!!"), (10, "short item HERE"), (5, prose(rng, 10))]
    made = [prose(rng, 50) + " " + longer + " x", " ".join(longer.split()[3:14]), " ".join(longer.split()[:9]), "a short, item: here! and short item here", items[5][1].upper(), None, "", "short", longer + " " + longer, "na " * 500]
    docs_ = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    expected = []
    for i, t in enumerate(made):
        w, hit, own = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    own |= x
        expected.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    assert rows(winnowing.contamination(docs_, bench, **limits).drop("items")) == expected
    if not limits:
        assert len(winnowing.contamination(docs, bench).collect()) == len(texts())
        assert winnowing.clean_documents(docs, bench.limit(0)).count() == len(texts())
        assert winnowing.contamination(none, bench).collect() == []


def test_byte_bpe(docs, none):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in texts():
        ids = encoding.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(byte_bpe.encode_texts(docs)) == sorted(expected, key=lambda r: (r[0] is not None, r))
    assert byte_bpe.encode_texts(none).collect() == []
    bpe, rng = byte_bpe.ByteBPE(ranks), random.Random(1)
    pieces = [bytes(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 7, 16, 17, 100, 256, 257, 2000) for alphabet in (b"ab", b"the ", bytes(range(256)))] + [b"", b"x" * 1000]
    for p, ids in zip(pieces, bpe.encode_pieces(pieces)):
        assert bpe.decode(ids) == p and (p in ranks or bpe._long(p) == ids)


def test_lengths(docs, none):
    sums = lengths.with_suffix_sums(lengths.histogram(docs))
    by = {r["doc_id"] if r["doc_id"] is not None else -1: r["n_tokens"] for r in byte_bpe.encode_texts(docs).collect()}
    sizes = [by[i if i is not None else -1] for i, _ in texts()]
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"]) == (sum(x >= n for x in sizes), sum(x for x in sizes if x >= n))
        assert (r["docs_fit"], r["tokens_truncated"], r["tokens_total"]) == (sum(x <= n for x in sizes), sum(min(x, n) for x in sizes), sum(sizes))
    limits = [0, 1, 50, 10**6]
    assert [tuple(r) for r in lengths.at_limits(sums, limits).orderBy("n_limit").collect()] == [(n, sum(x <= n for x in sizes), sum(min(x, n) for x in sizes)) for n in limits]
    assert lengths.quantile(sums, 0.5) == sorted(sizes)[-(-len(sizes) // 2) - 1]
    assert lengths.with_suffix_sums(lengths.histogram(none)).collect() == []


def repeated(pairs):
    seen, out = {}, {}
    for i, t in pairs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen[raw[s : s + 100]] = True
        out[i] = (len(raw), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, docs, none, hot):
    pairs = sorted([(i, t) for i, t in texts()[:-2]])
    rng = random.Random(2)
    shared = prose(rng, 60)
    pairs += [(100 + i, prose(rng, 30) + shared[rng.randrange(50) :] + prose(rng, 30)) for i in range(20)] + [(200, "ab" * 500), (201, "ab" * 300), (202, "\x00" * 400)]
    found = repeats.find_repeats(spark.createDataFrame(pairs, "doc_id long, text string"), hot=hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == repeated(pairs)
    if hot > 1:
        twice = spark.createDataFrame([(1, shared), (1, shared), (None, shared[:150])], "doc_id long, text string")
        assert [(r["doc_id"], r["n_removed"] > 0) for r in repeats.find_repeats(twice).orderBy("doc_id").collect()] == [(None, False), (1, True), (1, True)]
        out = repeats.drop_repeats(docs)
        assert out.columns == docs.columns and out.count() == docs.count() and {r["c0"] for r in out.collect()} == {"z"}
        assert repeats.find_repeats(none).collect() == []


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_of_identical_rows(spark, hot):
    rng = random.Random(5)
    shared = prose(rng, 60)
    pairs = [(i, prose(rng, 30) + shared[rng.randrange(50) :] + prose(rng, 30)) for i in range(12)]
    copied = pairs + [pairs[0]] * 2 + pairs[5:7]
    found = repeats.find_repeats(spark.createDataFrame(copied, "doc_id long, text string").repartition(3), hot=hot).collect()
    expected = repeated(pairs)
    assert sorted(tuple(r) for r in found) == sorted((i, *expected[i]) for i, _ in copied) and expected[0][1] == 0 < expected[5][1]


def test_rank_takes_identical_rows_from_several_batches():
    rng = random.Random(7)
    gram, tail = bytes(range(32)), bytes(rng.randrange(256) for _ in range(68))
    made = [(5, 1, 0, 0, 40, 8, bytes(8) + gram + tail), (5, 2, 0, 0, 40, 8, b"x" * 8 + gram + tail)]

    def batch(rows):
        cols = list(zip(*rows))
        kinds = [repeats.pa.int64()] * 6 + [repeats.pa.binary()]
        return repeats.pa.RecordBatch.from_arrays([repeats.pa.array(c, k) for c, k in zip(cols, kinds)], names=list("abcdefg"))

    marks = [tuple(r.values()) for b in repeats.rank(iter([batch(made), batch(made[:1]), batch(made)])) for r in b.to_pylist()]
    assert marks == [(2, 0, 0, 48, 148)]


def test_match_reads_a_stream():
    """Batches of any size give the same places: those of equal phrases but the first, and the first of each phrase where a trigger has several."""
    rng = random.Random(8)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(0, 40)):
            phrase, mark = rng.randint(0, 3), rng.random() < 0.1
            pack = repeats.packed(*(np.array([x]) for x in (rng.choice([3, 40_000]), rng.randint(0, 5), 0 if mark else phrase, 0 if mark else phrase + 1)))
            rows.append((rng.randint(0, 5), phrase, rng.randint(0, 4), rng.choice([0, 8]), int(pack[0])))
        rows.sort(key=lambda r: (*r[:4], (r[4] & (1 << 64) - 1) >> 48, r[4]))
        places, expected = defaultdict(lambda: defaultdict(set)), []
        for trigger, context, doc, tie, pack in rows:
            more, place, before, count = (int(x[0]) for x in repeats.unpacked(np.array([pack])))
            if count:
                places[trigger][context].add((doc, tie, more, place, before, count))
            else:
                expected.append((doc, tie, more, place, context, 0, 0))
        for trigger, phrases in places.items():
            for at in phrases.values():
                if len(phrases) > 1:
                    d, t, m, p, b, n = min(at)
                    expected.append((d, t, m, p, p + n, b, trigger or 1))
        for trigger, context, doc, tie, pack in rows:
            more, place, before, count = (int(x[0]) for x in repeats.unpacked(np.array([pack])))
            if count and (doc, tie, more, place, before, count) != min(places[trigger][context]):
                expected.append((doc, tie, more, place, place + count + repeats.LENGTH - 1, 0, 0))
        for size in (1, 3, 50):
            cut = [rows[i : i + size] for i in range(0, len(rows), size)]
            batches = [repeats.pa.RecordBatch.from_arrays([repeats.pa.array([r[k] for r in part], repeats.pa.int64()) for k in range(5)], names=list("abcde")) for part in cut]
            found = [r for b in repeats.match(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
            assert sorted(found) == sorted(expected)


def test_triggers_are_the_first_divisible_hash_or_the_least():
    rng = np.random.default_rng(3)
    for n in (69, 70, 200, 3000):
        for most in (40, 1 << 62):  # small hashes: often divisible
            h = rng.integers(1, most, n, np.uint64) << np.uint64(33 if most == 40 else 0) | (rng.integers(0, 600, n, np.uint64) if most == 40 else np.uint64(1) * (rng.random(n) > 0.01))
            at = repeats.triggers(h)
            assert len(at) == n - repeats.SPAN + 1
            for s in range(len(at)):
                own = h[s : s + repeats.SPAN]
                divisible = np.flatnonzero(own % np.uint64(repeats.MODULUS) == 0)
                assert at[s] == s + (divisible[0] if len(divisible) else np.argmin(own >> np.uint64(32)))


def test_rank_reads_a_stream(monkeypatch):
    """However few phrases are held at once, marks are the same: strings with an earlier equal in their trigger."""
    rng, gram = random.Random(12), [bytes([g] * 32) for g in range(5)]
    rows = []
    for trigger in range(5):
        for doc in range(12):
            before = rng.randint(0, 68)
            rows.append((trigger, doc, 0, 0, 10, before, bytes(rng.choice(b"ab") if rng.random() < 0.05 else 97 for _ in range(before)) + gram[trigger] + b"c" * (rng.randint(max(0, 68 - before), 68) - rng.randint(0, 1) * (before == 68))))
    rows = [r for r in rows if len(r[6]) >= 100]
    seen, expected = set(), set()
    for trigger, doc, _, _, low, before, what in rows:
        for i in range(max(0, before - 68), min(before, len(what) - 100) + 1):
            if what[i : i + 100] in seen:
                expected |= {(doc, trigger, low + i + k) for k in range(100)}
            seen.add(what[i : i + 100])
    kinds = [repeats.pa.int64()] * 6 + [repeats.pa.binary()]
    for held in (1, 5, 1000):
        monkeypatch.setattr(repeats, "RANKED", held)
        found = set()
        for trigger in range(5):  # places by trigger, as documents are the same in each
            part = [r for r in rows if r[0] == trigger]
            batches = [repeats.pa.RecordBatch.from_arrays([repeats.pa.array([r[k] for r in part[i : i + 4]], kinds[k]) for k in range(7)], names=list("abcdefg")) for i in range(0, len(part), 4)]
            found |= {(d, trigger, p) for b in repeats.rank(iter(batches)) for d, _, _, lo, hi in zip(*[c.to_pylist() for c in b.columns]) for p in range(lo, hi)}
        assert found == expected
        whole = [repeats.pa.RecordBatch.from_arrays([repeats.pa.array([r[k] for r in rows[i : i + 3]], kinds[k]) for k in range(7)], names=list("abcdefg")) for i in range(0, len(rows), 3)]
        assert {(d, p) for b in repeats.rank(iter(whole)) for d, _, _, lo, hi in zip(*[c.to_pylist() for c in b.columns]) for p in range(lo, hi)} == {(d, p) for d, _, p in expected}


def test_repeats_of_a_text_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 5_000)
    rng = random.Random(6)
    long = prose(rng, 3_000)
    pairs = [(1, long), (2, prose(rng, 30) + long[4_000:9_500] + prose(rng, 900) + long[:6_000])]
    found = repeats.find_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == repeated(pairs)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_of_one_id(spark, hot):
    """1,500 rows of one id (and of none), half of them unique: no text loses bytes for another's sake."""
    rng = random.Random(13)
    shared = prose(rng, 40)
    for id_ in (5, None):
        made = [prose(rng, 25) + (shared if i % 2 else "") + prose(rng, 25) for i in range(1_500)]
        found = repeats.find_repeats(spark.createDataFrame([(id_, t) for t in made], "doc_id long, text string"), hot=hot)
        gone = sorted(r["n_removed"] for r in found.collect())
        assert gone[:751] == [0] * 751 and gone[751] > 150  # the first shared one stays, too


def test_repeats_of_text_ids(spark):
    rng = random.Random(14)
    shared = prose(rng, 60)
    pairs = [(f"k{i:02}", prose(rng, 30) + shared[rng.randrange(50) :] + prose(rng, 30)) for i in range(12)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, shared[:140])], "doc_id string, text string").selectExpr("*", "'x' as key", "'y' as _key")
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.find_repeats(df).collect()}
    assert found == repeated([(None, shared[:140]), *sorted(pairs)])
    assert repeats.drop_repeats(df).columns == df.columns and repeats.find_repeats(df.limit(0)).collect() == []


def test_quality(spark, docs, none):
    def base(t):
        raw = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", raw)
        lines = [x for x in raw.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(three) if three.count(w) > 1 for k in range(3)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(covered)

    made = [t for _, t in texts() if not t or len(t) < 10_000] + ["a\n\na\nb\n b\n", "x\x0by\x1cz w " * 30, "p # q <> |\n" * 3]
    for t in made:
        assert quality.text_counts((t or "").encode())[:5] == base(t)
    rng = random.Random(4)
    clean = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["***", "%%%", "###"]) for w in prose(rng, 100).split()) for _ in range(12)]
    judged = quality.judge(spark.createDataFrame([(i, t, "xx") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] == (r["doc_id"] < len(clean)) and not r["base_failed"] for r in judged)
    out = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert out[6]["base_failed"] and out[12]["base_failed"] and not out[12]["kept"] and len(quality.judge(docs).collect()) == len(texts())
    assert quality.keep_documents(docs).columns == docs.columns and quality.judge(none).collect() == []
    stats = docs.select("doc_id", quality.F.coalesce("lang", quality.F.lit("")).alias("lang"), quality.counted(quality.F.col("text")).alias("s")).select("doc_id", "lang", "s.*")
    refs = quality.references(stats)
    assert sorted(quality.with_references(stats, refs, 0).toJSON().collect()) == sorted(quality.with_references(stats, refs).toJSON().collect())
    assert quality.jensen_shannon(np.array([1, 0]), np.array([0, 1])) == 1.0 and quality.jensen_shannon(np.array([2, 2]), np.array([1, 1])) == 0.0


def test_quality_rejects_texts_without_common_words(spark):
    rng = random.Random(6)
    foreign = {w: x for w, x in zip("the of and to in".split(), "der die und den zu".split())}
    n = [round(50 * 1.03**i) for i in range(120)]
    clean = [prose(rng, k) for k in n] * 2
    soup = [" ".join([w for w in prose(rng, 3 * k).split() if w not in foreign][:k]) for k in n[::10]]
    other = [" ".join(foreign.get(w, w) for w in prose(rng, k).split()) for k in n[::10]]
    few = [(1000 + i, prose(rng, 100), "few") for i in range(12)] + [(1100, soup[7], "few")]
    made = [(i, t, "en") for i, t in enumerate(clean + soup + other)] + few + [(1200, soup[7], "none")]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(made, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == {*range(len(clean)), *range(1000, 1012), 1200}


def test_verdicts_of_quality_against_brute_force(spark):
    """kept, from histograms, medians, limits and distances computed anew."""
    import math
    import statistics

    rng = random.Random(21)
    made = [(i, prose(rng, rng.randint(50, 260)), rng.choice(["en", "de"])) for i in range(260)]
    made += [(300 + i, " ".join(w + rng.choice(["", "##", "%"]) for w in prose(rng, 80).split()), "en") for i in range(10)]
    made += [(400 + i, " ".join("kami" for _ in range(3)) + " " + " ".join("su" + "ka" * (k % 7) + "é" * (k % 3) for k in range(90)), "de") for i in range(3)] + [(500, "too short", "en"), (501, None, "de"), (502, prose(rng, 70), "fr")]
    vocabulary = sorted({w for ws in quality.COMMON_WORDS.values() for w in ws.split()})
    marks, symbols = set(".,;:!?'\"()-+=/@_[]{}~^`\\"), set("#*$%&|<>")

    def histograms(t):
        chars, words = [0] * 6, [0] * (len(vocabulary) + 1)
        for c in t:
            chars[0 if ord(c) > 127 or c.isdigit() or c.islower() else 1 if c.isupper() else 2 if c in " \t\n\r\v\f" else 3 if c in marks else 4 if c in symbols else 5] += 1
        for w in re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
            words[vocabulary.index(w) if w in vocabulary else -1] += 1
        return chars, words

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2))

    def lower(values, share):  # percentile_approx, exact on few values
        return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]

    def percentile(values, share):
        v, at = sorted(values), share * (len(values) - 1)
        return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))

    good = {i: (len(t.split()), lang, *histograms(t)) for i, t, lang in made if t and len(t.split()) >= 50 and not quality.base_failed(*[quality.text_counts(t.encode())[k] for k in (0, 4)])}
    refs = {}
    for lang in {g[1] for g in good.values()}:
        own = [g for g in good.values() if g[1] == lang]
        refs[lang] = [lower([g[2][k] / sum(g[2]) for g in own], 0.5) for k in range(6)], [sum(g[3][k] for g in own) for k in range(len(vocabulary) + 1)]
    z, limits = defaultdict(list), {}
    for n, lang, _, words in good.values():
        if sum(refs[lang][1]) >= 1_000:
            for band in ((n // 50).bit_length() - 1, -1):
                z[lang, band].append(round(distance(words, refs[lang][1]) * math.sqrt(n), 2))
    for k, v in z.items():
        if len(v) >= 30:
            low, mid = percentile(v, 0.25), percentile(v, 0.5)
            limits[k] = max(2.0, mid + 8 * (mid - low))
    expected = {}
    for i, t, _ in made:
        if i not in good:
            expected[i] = False
            continue
        n, lang, chars, words = good[i]
        ref_chars, ref_words = refs[lang]
        if sum(ref_words) < 1_000:
            expected[i] = True
            continue
        limit = max(0.15, limits.get((lang, (n // 50).bit_length() - 1), limits.get((lang, -1), 4.0)) / math.sqrt(n))
        if n * (1 - ref_words[-1] / sum(ref_words)) >= 10:
            limit = min(limit, 0.95 * distance([0] * len(vocabulary) + [1], ref_words))
        expected[i] = distance(chars, ref_chars) <= 0.1 + 0.2 / math.sqrt(n) and distance(words, ref_words) <= limit
    found = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert found == expected and 5 < sum(not x for x in expected.values()) < 60 and statistics.mean(expected.values()) > 0.8


def test_stages_judge_rows_not_ids(spark):
    """Clean and bad rows of equal and null ids; identical rows."""
    rng = random.Random(22)
    item, fine = prose(rng, 20), [prose(rng, 80) for _ in range(5)]
    rows = [(7, fine[0] + " " + item), (7, fine[1]), (None, fine[2] + " " + item), (None, fine[3]), (8, fine[4]), (8, fine[4]), (5, "short"), (5, fine[0]), (None, None)]
    for kind in ("long", "string"):
        made = [(i if kind == "long" or i is None else str(i), t, "en", "k") for i, t in rows]
        df = spark.createDataFrame(made, f"doc_id {kind}, text string, lang string, key string")
        clean = winnowing.clean_documents(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
        assert sorted(map(str, clean.collect())) == sorted(map(str, df.where(~df.text.endswith(item) | df.text.isNull()).collect())) and clean.columns == df.columns
        kept = quality.keep_documents(df)
        assert sorted(map(str, kept.collect())) == sorted(map(str, df.where("length(text) > 20").collect())) and kept.columns == df.columns


def test_keys_are_broadcast_or_shuffled_alike(docs):
    key, found = common.text_key("text"), docs.where("length(text) > 300")
    want = docs.where("not coalesce(length(text) > 300, false)").count()
    assert {common.of_other_texts(docs, found.select(key.alias("key")), key, most).count() for most in (0, 1_000)} == {want}
