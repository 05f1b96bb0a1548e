"""The operators against plain Python versions, on odd rows, on empty tables and on the small test tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import common, components, minhash, packing, pii, quality, repeats, templates, tiling, tokens, urls, warc
from wattloom.llm.queries import ORACLES, QUERIES


def docs_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- shared helpers -------------------------------------------------------------------------------------------------


def test_words_are_cut_at_ascii_space_only():
    text = "a b\tc\x0bd\x0ce\rf\x1cg\x85h  i\n"
    assert [w.decode() for w in text.encode().split()] == brute.words(text)


def test_word_hashes(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é\t\x85") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " ", "x", "ab ba", "a" * 5000 + " b"]
    seen = {}
    for size in (1 << 20, 3, 17):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        for t in texts:
            words, hashes = t.encode().split(), common.word_hashes(t.encode())
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 500
    many = [f"{a}{b}" for a in range(300) for b in ("x", "yx", "xy", "xxxxxxxxxxxxxxxxx", "\u00e9")]
    assert len(set(common.word_hashes(" ".join(many).encode()).tolist())) == len(many)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 9, 18, 35])
def test_equal_windows_have_equal_names(width):
    rng = np.random.default_rng(width)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    names = common.window_names(words, width)
    seen = {}
    for i in range(len(words) - width + 1):
        assert seen.setdefault(tuple(words[i:i + width]), names[i]) == names[i]
    assert len(set(seen.values())) == len(seen) and len(names) == len(words) - width + 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components.components(spark.createDataFrame(edges + edges[:9], "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_base(spark, folder, frame, odd_rows):
    got = {r.doc_id: tuple(r)[1:7] for r in quality.rules(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute.quality_base(t) for i, t in docs_of(spark, folder)}
    odd = quality.rules(frame(odd_rows))
    assert rows(odd, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *brute.quality_base(t)) for i, t in odd_rows), key=repr)
    assert quality.rules(frame([])).count() == 0 and quality.keep_good(frame([])).count() == 0


def test_quality_verdicts(frame):
    good = "This is a proper sentence with enough words in it.\nAnd here is another one that ends well."
    nav = "Home | News | Sport | Weather | About | Contact\n" * 1 + "Login | Register | Help | Search | Menu | Top"
    shout = " ".join(f"LOUD{i}!!" for i in range(30))
    boiler = "All rights reserved by the owner of this page today.\nPowered by some software that nobody knows at all."
    bare = "\n".join(f"heading number {i} without any end" for i in range(8))
    df = frame([(1, good), (2, nav), (3, shout), (4, boiler), (5, bare), (6, good + "\nshort tail"), (7, None), (8, "")])
    assert {r.doc_id for r in quality.rules(df).filter("kept").collect()} == {1, 6}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and rows(kept, *df.columns) == rows(df.filter("doc_id in (1, 6)"), *df.columns)


# --- near duplicates ------------------------------------------------------------------------------------------------


def test_near_duplicates(spark, folder):
    docs = docs_of(spark, folder)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_minhash_near_dedup"](spark, folder).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_odd_rows(frame, odd_rows):
    known = [(i, t) for i, t in odd_rows if i is not None and i not in (17, 18)]
    expected = brute.near_duplicates(known)
    got = minhash.near_duplicates(frame(odd_rows), width=2).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in expected} == expected
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (17, 18))
    assert minhash.near_duplicates(frame([])).count() == 0
    left = minhash.drop_near_duplicates(frame(odd_rows), width=2)
    assert left.columns == frame([]).columns and {2, 3, 8, 10} & {r.doc_id for r in left.collect()} == set()


def test_chain_without_a_common_leader(spark, monkeypatch, frame):
    """Near copies of an absent text: few pairs reach the similarity, and links must not get lost in large buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10000)}" for _ in range(150)]
    docs = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(150), 9 + i % 8):
            words[k] = f"n{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(docs), width=2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(docs).items()}


# --- substrings -----------------------------------------------------------------------------------------------------


def test_substrings(spark, folder, frame, odd_rows):
    assert rows(QUERIES["op7_substring_dedup"](spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(docs_of(spark, folder)), key=repr)
    got = repeats.deduplicated(frame(odd_rows))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(odd_rows), key=repr)
    assert repeats.deduplicated(frame([])).count() == 0


@pytest.mark.parametrize("width", [3, 10, 35])
def test_substrings_of_few_words(frame, width):
    rng = random.Random(width)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(25)]
    got = repeats.deduplicated(frame(docs), width=width)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(docs, width), key=repr)


def test_longest_repeats(frame):
    text = " ".join(f"w{i}" for i in range(100))
    got = repeats.longest_repeats(frame([(1, text), (2, text), (3, "short text")]), width=10)
    assert rows(got, "length", "documents") == [(10, 2), (20, 2), (40, 2), (80, 2)]
    assert repeats.longest_repeats(frame([]), width=10).count() == 0


# --- line templates -------------------------------------------------------------------------------------------------


def test_line_templates(frame):
    rng = random.Random(1)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12)) + "."
    docs = []
    for i in range(40):
        lines = [own(), own()]
        if i % 2:
            lines.insert(rng.randrange(3), f"Page viewed {i} times by {rng.randrange(999)} readers since {1990 + i}.")
        if i % 3 == 0:
            lines.append(f"This was signed by user{'q' * i} on the public mailing list archive.")
        docs.append((i, "\n".join(lines)))
    copies = "\n".join(own() for _ in range(4))
    docs += [(100 + k, copies) for k in range(30)]  # copies keep their lines
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "a\n")]
    df = frame(docs)
    left = templates.without_recurring(df, n_lines="total", n_dropped="gone")
    assert left.columns == [*df.columns, "total", "gone"]
    for r in left.collect():
        old = dict(docs)[r.doc_id]
        if old is None:
            assert r.text is None and (r.total, r.gone) == (0, 0)
            continue
        kept = [x for x in old.split("\n") if not x.startswith(("Page viewed", "This was signed"))]
        assert (r.text, r.total, r.gone) == ("\n".join(kept), len(old.split("\n")), len(old.split("\n")) - len(kept)), r.doc_id
    assert templates.without_recurring(frame([])).count() == 0


def test_rare_lines_stay(frame, odd_rows):
    assert rows(templates.without_recurring(frame(odd_rows)), "doc_id", "text", "kept") == rows(frame(odd_rows), "doc_id", "text", "kept")


def test_line_templates_by_brute_force(spark, folder):
    """Counts made again in plain Python from the lines, for the small table."""
    docs, least = docs_of(spark, folder), 5
    expected = {i: len(gone) for (i, _), gone in zip(docs, brute.recurring_lines([t for _, t in docs], least))}
    got = templates.without_recurring(spark.read.parquet(f"{folder}/documents.parquet"), n_dropped="gone", min_docs=least)
    assert {r.doc_id: r.gone for r in got.collect()} == expected and sum(expected.values()) > 0


# --- decontamination ------------------------------------------------------------------------------------------------


def test_leaks(spark, folder):
    docs = docs_of(spark, folder)
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    expected = set()
    for (i, t), (j, b) in itertools.product(docs, bench):
        item = brute.words(brute.lower(b))
        grams = {tuple(item[k:k + 5]) for k in range(len(item) - 4)}
        own = brute.words(brute.lower(t))
        if any(tuple(own[k:k + 5]) in grams for k in range(len(own) - 4)) and 100 * brute.tiled(t, b) >= 60 * len(item):
            expected.add((i, j))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, folder).collect()}
    assert got == expected and expected


def test_tiling_by_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        doc = " ".join(rng.choice("abcdef") for _ in range(rng.randrange(70)))
        item = " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 25)))
        least = rng.choice([2, 3, 5])
        d, b = tiling.words_of(doc.encode()), tiling.words_of(item.encode())
        want = brute.tiled(doc, item, least)
        assert int(tiling.tile(d, b, least).sum()) == want
        assert int(tiling.tile(tiling.near_parts(d, b, min(least, len(b))), b, least).sum()) == want


def test_reordered_and_odd_items(spark, frame, odd_rows):
    words = [f"t{i}" for i in range(30)]
    moved = " ".join(words[20:] + ["x"] + words[10:20] + ["y"] + words[:10])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "two words"), (5, "never seen words anywhere in here"), (1, " ".join(words)), (None, "t0 t1 t2 t3 t4 t5")], "item_id long, text string")
    docs = frame([*odd_rows, (50, moved), (51, "clean text of a few words that nobody has seen"), (52, " ".join(words[:12]))])
    got = tiling.leaks(docs, bench)
    assert rows(got.select("doc_id", "item_id").distinct(), "doc_id", "item_id") == sorted([(50, 1), (9, 4), (10, 4), (50, None), (52, None)], key=repr)
    left = tiling.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 4
    assert tiling.leaks(frame([]), bench).count() == 0 and tiling.leaks(docs, bench.limit(0)).count() == 0
    assert tiling.without_leaks(docs, bench.limit(0)).count() == docs.count()


# --- packing --------------------------------------------------------------------------------------------------------


def check_bins(got, capacity):
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert sum(r.n_tokens for r in own) == own[0].bin_used <= capacity
        assert [r.start for r in own] == list(itertools.accumulate([0, *[r.n_tokens for r in own[:-1]]]))
        sources = [r.source for r in own if r.source is not None]
        assert len(sources) == len(set(sources))
    return bins


def test_packing(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200, 700]) if i % 3 else rng.randrange(1, 90), rng.choice(["a", "a", "b", "c", f"s{i}", None]), rng.choice([f"c{i}", "same", None])) for i in range(300)]
    items += [(400, None, "a", "x"), (401, -5, "b", "y"), (17, 20, "z", None), (17, 20, "z", None), (None, 33, None, None)]
    df = spark.createDataFrame(items, "doc_id long, n int, source string, dup string")
    got = packing.best_fit(df, "doc_id", "n", "source", "dup", capacity=64, shard_docs=120).collect()
    check_bins(got, 64)
    clusters = {i: c for i, _, _, c in items}
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(clusters.get(r.doc_id))
    assert all(own.count("same") <= 1 for own in bins.values())
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: n * (2 if i == 17 and n == 20 else 1) for i, n, *_ in items if n and n > 0 and i != 17} | {17: sum(n for i, n, *_ in items if i == 17)}
    assert packing.best_fit(df.limit(0), "doc_id", "n", "source", "dup").count() == 0


def test_best_fit_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pieces = sorted(((rng.randrange(1, 40), 1 << rng.randrange(6) if rng.random() < 0.7 else 0, 1 << rng.randrange(9) if rng.random() < 0.5 else 0) for _ in range(60)), reverse=True)
        bins, expected = [], []
        for size, s, c in pieces:
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and not b[1] & s and not b[2] & c]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([50, 0, 0])
            expected.append((k, 50 - bins[k][0]))
            bins[k] = [bins[k][0] - size, bins[k][1] | s, bins[k][2] | c]
        assert packing.pack(pieces, 50) == expected


# --- token files ----------------------------------------------------------------------------------------------------


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def expected_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(vocabulary()), [], 0
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens(spark, folder):
    assert sorted(map(tuple, QUERIES["op4_token_ids"](spark, folder).collect())) == expected_tokens(sorted(docs_of(spark, folder)))


def test_tokens_of_odd_rows(frame, odd_rows, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 3000)
    more = [(30, "Don't <|endoftext|> I'll x<|startoftext|>y"), (31, "ÀÉ ǅ İ ſ ẞ ß"), (32, "é café ́"), (33, "a b c 1234 ½ ٣"), (34, "it's we're--you've!!'s'")]
    docs = [(i, t) for i, t in odd_rows if i is not None and i not in (17, 18)] + more
    got = tokens.token_index(frame(docs), vocabulary())
    assert sorted(map(tuple, got.collect())) == expected_tokens(sorted(docs, key=lambda d: d[0]))
    assert tokens.token_index(frame([]), vocabulary()).count() == 0
    every = tokens.token_index(frame(odd_rows), vocabulary()).collect()
    ends = sorted((r.start, r.start + r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in every)
    assert len(every) == len(odd_rows) and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("values", [[0], [7] * 5000, list(range(3000)), [2 ** 32 - 1, 0], [1, 2, 3] * 700 + [2 ** 31], []])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    data = tokens.encode_file([1], [len(ids)], ids)
    r = tokens.Reader(data)
    assert (r.ids() == ids).all() and r.ids(1, min(2, len(ids))).tolist() == values[1:2]
    rng = np.random.default_rng(len(values))
    mixed = np.where(rng.random(4000) < 0.05, rng.integers(0, 2 ** 32, 4000), rng.integers(100, 900, 4000)).astype(np.uint32)
    r = tokens.Reader(tokens.encode_file([1], [4000], mixed))
    assert (r.ids() == mixed).all() and (r.ids(1500, 2600) == mixed[1500:2600]).all() and len(r.data) < 4000 * 2.4


# --- URLs -----------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    pages = [(1, "http://WWW.Example.com/en/x"), (2, "https://a.b.example.com/en/"), (3, "http://example.com/fr/1"), (4, "http://x.net/fr/2"), (5, "http://x.net/en/2?a=1&utm_source=q#f"),
             (6, "https://www.x.net/en/2/?a=1"), (7, None), (8, "no scheme"), (9, "http://y.org"), (10, "http://notexample.com/en/"), (11, "ftp://h.net://fr/"), (12, "http://net/es/a"), (12, "http://net/es/a"),
             (None, "http://Y.org/"), (13, "http://ÄB.net/en/\nx"), (14, "http://z.org/Q"), (15, "")]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in pages], "page_id long, url string, html string, rule string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.captured_again(df)).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.b.example.com", "/en/", "example.com/en/", "block"), (3, "example.com", "/fr/1", "com/", "allow"),
        (4, "x.net", "/fr/2", "net/fr/", "block"), (5, "x.net", "/en/2", None, "block"), (6, "www.x.net", "/en/2/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "y.org", "", None, "block"), (10, "notexample.com", "/en/", "com/", "allow"), (11, "h.net:", "//fr/", None, "allow"), (12, "net", "/es/a", "net/es/", "block"),
        (None, "y.org", "/", None, "block"), (13, "Äb.net", "/en/\nx", None, "allow"), (14, "z.org", "/Q", None, "allow"), (15, "", "", None, "allow")}
    assert urls.judge(df.limit(0), urls.captured_again(df)).count() == 0
    assert urls.judge(df, spark.createDataFrame([], "canonical string")).filter("rule is null and verdict = 'block'").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    assert {r.page_id for r in urls.judge(pages, listed).filter("verdict = 'block'").collect()} == set(range(5000))


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    html = ["<p>x</p>", "", None, "ü" * 5000, "\r\n\r\nWARC/1.1\r\n\r\n", "same", "same", "same", "<p>x</p>", "y"]
    pages = [(i * 3 % 10, f"http://h{i % 3}.org/p?{i}" if i else None, t) for i, t in enumerate(html)] + [(20, "http://é.org/ a\nb", "same"), (None, "http://n.org/", "same"), (20, "http://r.org", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").repartition(4)
    first = {}
    for i, _, t in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(t or "", i)
    expected = []
    for i, _, t in pages:
        data = (t or "").encode()
        response = i is None or first[t or ""] == i
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[t or ""]))
    got = warc.archived(df)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    order = [r.url_key.encode() for r in got.orderBy("position").collect()]
    assert order == sorted(order) and [r.position for r in got.orderBy("position").collect()] == list(range(len(pages)))
    assert warc.archived(df.limit(0)).count() == 0


def test_ranges_follow_each_other(spark):
    entries = spark.range(500).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("url_key"), (F.col("id") * 7 % 500).alias("captured"), F.col("id").alias("page_id"),
        F.concat(F.lit("run"), (F.col("id") % 5)).alias("run"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("payload_bytes"), F.lit("d").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(0).cast("long").alias("warc_offset"))
    from pyspark.sql import Window

    entries = entries.withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("url_key", "captured", "page_id")).cast("long"))
    got = [(r.url_key, r.captured, r.page_id) for r in warc.merged_index(entries, 40).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 500


def test_loser_tree():
    rng = random.Random(6)
    for _ in range(300):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(9))]
        assert warc.loser_tree_merge(runs) == sorted(x for r in runs for x in r)


def test_records_round_trip():
    data = warc.record(5, "http://a.org/ü b", b"<p>\r\n\r\n</p>", warc.base32_sha1(b"<p>\r\n\r\n</p>"), None)
    deflate = zlib.compressobj(6, wbits=31)
    (at, fields, body), = warc.records(deflate.compress(data) + deflate.flush())
    assert at == 0 and warc.entry(fields, body)[2:] == (5, 11, warc.base32_sha1(b"<p>\r\n\r\n</p>"), "response", None)
    damaged = dict(fields) | {"WARC-Payload-Digest": "sha1:X"}
    with pytest.raises(ValueError):
        warc.entry(damaged, body)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, folder, name):
    from oracle import compare, connect

    assert compare(QUERIES[name](spark, folder).toPandas(), connect(folder).execute(ORACLES[name]).df()) == []


def test_archive_of_many_small_records():
    """Twenty thousand records in one file are read in linear time; a cut file is noticed."""
    import gzip
    import time

    members = [gzip.compress(warc.record(i, f"http://a.example/{i}", b"x%d" % i, warc.base32_sha1(b"x%d" % i), None), 1) for i in range(20_000)]
    data, start = b"".join(members), time.perf_counter()
    found = [(at, warc.entry(fields, body)[2]) for at, fields, body in warc.records(data)]
    assert [page for _, page in found] == list(range(20_000)) and found[5][0] == sum(map(len, members[:5]))
    assert time.perf_counter() - start < 30
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(data[:-20]))
