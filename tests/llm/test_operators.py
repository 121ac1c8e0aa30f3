import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidegraph.llm import decontamination, jaccard_join, language_id, lm_scoring, packing, quality_rules, registry, substring_dedup, suffix_dedup, toxicity, url_filters
from tidegraph.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key int, component_id long, t string, n int"
SF = "/root/testdata/sf0.001"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgéß") for _ in range(r.randint(2, 7))) for _ in range(n))


def changed(text, *places):
    w = text.split(" ")
    for p in places:
        w[p] = "changed"
    return " ".join(w)


BASE, PASSAGE = prose(1, 90), prose(2, 60)
ROWS = [
    (1, BASE), (2, BASE), (3, changed(BASE, 40)), (4, changed(BASE, 10, 70)), (5, None), (6, ""), (7, " \n\t "), (8, "One two three"), (9, "ONE  TWO three"), (10, "one two three four five"),
    (11, prose(3, 70) + "\n" + PASSAGE + "\n" + prose(4, 70)), (12, prose(5, 40) + " " + changed(PASSAGE, 30) + " " + prose(6, 90)), (13, "w " * 400), (14, prose(7, 30_000)), (15, "a\nb c d\na\nb c d\n" * 30),
    (16, "x" * 250), (17, "y" + "x" * 250), (18, prose(8, 55) + " %%% ### " * 30), (19, "DIE!! " * 80 + prose(9, 20)),
]
REPEATED = [*ROWS, (1, BASE), (None, BASE), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 1.0, "x", 3, 5, "t", 2) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, REPEATED).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ROWS[:1]).limit(0)


@pytest.mark.parametrize("most", [2, 256])
def test_suffix_dedup(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    want = brute.repeats(ROWS)
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(REPEATED)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


@pytest.mark.parametrize(("most", "chunk"), [(1024, 1 << 20), (8, 1 << 20), (1024, 1 << 9)])
def test_suffix_dedup_of_a_phrase_in_many_contexts(spark, monkeypatch, most, chunk):
    """Phrases of 30 to 140 bytes, each in hundreds of contexts of which some return; texts longer than a chunk."""
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
    r = random.Random(11)
    phrases, around = [prose(40 + i, 60)[:n] for i, n in enumerate((30, 70, 95, 99, 140))], [prose(60 + i, 12)[:40] for i in range(40)]
    rows = [(i, " ".join(r.choice(around)[r.randint(0, 30) :] + p + r.choice(around) for p in phrases for _ in range(2))) for i in range(260)]
    want = brute.repeats(rows)
    for x in suffix_dedup.dedup(frame(spark, rows)).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id], x.doc_id


def test_run_length_index_against_sets():
    r = random.Random(5)
    batch = []
    for a in range(25):
        base = bytes(r.choice(b"ab c") for _ in range(176))
        for _ in range(r.choice([1, 2, 5, 12])):
            x, p, n = bytearray(base), 76, r.randint(1, 77)
            for _ in range(r.choice([0, 1, 2])):
                k = r.choice([*range(76), *range(100, 176)])
                x[k] = r.choice(b"xyz")
            s = r.randint(0, 77 - n)
            batch.append((a, bytes(x[s : s + n + 99]), n, p - s))
    seen = set()
    for (a, c, n, _), got in zip(batch, suffix_dedup.repeated_strings(batch)):
        own = [c[i : i + 100] for i in range(n)]
        assert [(a, w) in seen for w in own] == got.tolist()
        seen |= {(a, w) for w in own}


def test_jaccard_join(docs):
    want = brute.classes(ROWS)
    rows = jaccard_join.linked_classes(docs).collect()
    assert len(rows) == len(REPEATED)
    for r in rows:
        assert r.doc_id is None or (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert {r.component_id for r in rows if r.doc_id is None} == {None}


@pytest.mark.parametrize("block", [2, 2048])
def test_jaccard_star_of_near_copies(spark, monkeypatch, block):
    """Copies linked to their base but not to each other, the base neither first nor last; and small sets at the boundary."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [(i, changed(BASE, (7 * i) % 90, (7 * i + 45) % 90)) for i in range(12)] + [(50, BASE)]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(i))) for i in range(4, 16)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_classes(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_jaccard_signatures_meet():
    """Any two linked sets share a signature, whatever their sizes and the boundary."""
    r = np.random.default_rng(3)
    for _ in range(400):
        n = int(r.integers(2, 60))
        a = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.1], r.integers(0, 1 << 60, int(r.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) and both and 100 * both >= 80 * (len(a) + len(b) - both):
            for small in (1, 8, 20, 63):
                assert len(np.intersect1d(jaccard_join.signatures(a, small), jaccard_join.signatures(b, small)))
        if len(a) and len(b):
            assert jaccard_join.at_most_shared(jaccard_join.parities(a), jaccard_join.parities(b), len(a), len(b)) >= both


def test_jaccard_boundary_follows_the_lists(spark):
    """Sets whose shingles are rare are best kept in lists; where all lists are long, pairs cost less."""
    words = [f"w{i}" for i in range(9)]
    texts = [" ".join(random.Random(i).choices(words, k=40)) for i in range(50)]
    rare = frame(spark, [(i, prose(i + 10_000, 40)) for i in range(400)])
    common = frame(spark, [(i, texts[i % 50]) for i in range(400)])
    found = [jaccard_join.boundary(jaccard_join.costs(x, jaccard_join.frequencies(x))) for x in (rare, common)]
    assert found[0] < 36 <= found[1]
    assert jaccard_join.boundary([]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 75: 50, 100: 50}


def test_quality_rules(docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    text = dict(ROWS)
    assert len(rows) == len(REPEATED)
    for r in rows:
        if r.doc_id is not None:
            m = brute.measures(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, r.doc_id
            assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    kept = {r.doc_id for r in rows if r.kept and r.doc_id}
    assert {1, 2, 3, 4, 11, 12, 14} <= kept and not kept & {5, 6, 7, 8, 13, 15, 18, 19}


def test_rule_ablation(docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    for r in quality_rules.ablation(quality_rules.ledger(docs)).collect():
        assert r.n_failing == sum(bool(x.fail_bits & r.bit) for x in rows)
        assert r.n_only_this == sum(x.fail_bits == r.bit for x in rows)
        assert r.n_kept_without == sum(not x.fail_bits & ~r.bit for x in rows)


def test_decontamination(spark, docs, monkeypatch):
    items = [(1, " ".join(PASSAGE.split()[5:30])), (2, "three four FIVE"), (None, "one two"), (None, "two three"), ("3b", None), (4, "nothing here"), (5, "!!"), (10, " ".join(BASE.split()[:10])), (10, "w w w")]
    bench = spark.createDataFrame([(i if i is None else str(i), t) for i, t in items], "item_id string, text string")
    want = sorted(map(str, brute.contamination(REPEATED, items)))
    for size in (1 << 20, 60):  # one block, and several that are put together
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        found = decontamination.decontaminate(docs, bench)
        assert sorted(str((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), r["items"])) for r in found.collect()) == want
    out = {r.doc_id: r for r in decontamination.digests(found).collect()}
    assert out[8].n_items == 1 and out[8].n_hit == 3 and out[8].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[5].items_sha256 == hashlib.sha256(b"").hexdigest() and not out[5].contaminated and out[1].contaminated


def test_near_phrases(spark, docs):
    scrambled = " ".join(sorted(PASSAGE.split()[10:20]))
    bench = spark.createDataFrame([("n", scrambled)], "item_id string, text string")
    found = decontamination.near_phrases(decontamination.build_index(docs), bench)
    assert {r.doc_id for r in found.collect()} == {11, 12}


@pytest.mark.parametrize("size", [1, 150, 400_000])
def test_near_phrases_in_shards_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "SHARD_TOKENS", size)
    r = random.Random(3)
    common = [f"t{i}" for i in range(30)]
    items = [(str(i), " ".join(r.choice(common) for _ in range(n))) for i, n in enumerate((14, 10, 4, 1))] + [("rare", "r0 r1 r2 r3 r4 r5 r6 r7 r8 r9")]
    rows = [(i, " ".join(r.choice(common if r.random() < 0.7 else ["x", "y"]) for _ in range(r.randint(0, 80)))) for i in range(30)]
    # Nine of ten terms; the tenth, the rarest, is in another document. Then seven, and eight spread over twice the slack.
    rows += [(50, "r1 r2 r3 z r4 r5 r6 r7 r8 r9"), (51, "r0"), (52, "r1 r2 r3 r4 r5 r6 r7"), (53, " ".join(["r0", *"z" * 18, *[f"r{i}" for i in range(1, 7)], *"z" * 12, "r7 r8"])), (53, None), (None, "r9 r8 r7 r6 r5 r4 r3 r2")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    index = decontamination.build_index(frame(spark, rows).coalesce(1))
    got = [tuple(x) for x in decontamination.near_phrases(index, bench).collect()]
    want = brute.near(rows, items)
    assert (50, "rare", 9, 0) in want and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing_round_trip(docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, capacity=capacity).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in ROWS[1:]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, s, len(x := ids[s : s + capacity]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert len(by_doc[1]) == 2 * len(by_doc[2])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.03 * sum(r.length for r in rows) / capacity + 1


def test_word_codes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path("word_bpe_49k.json")
    tokenizer, codes = Tokenizer.from_file(path), packing.WordCodes(path)
    odd = ["á b\x1cc <|endoftext|> I'm it's x\u0300", "\u1100\u1161 \u212b \u212a \ufb01 \u01f0 ΑΣ İ ß ẞ Ǆ ªº²", "don't 'LL (foo)[bar]; a<b <|START", "日本語 abc中文 😀x", " \u0308a\u2003b\u00a0c", "", "ŉ ſ \ua7d8 ქ Ꭰ"]
    for t in odd:
        assert codes.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_lm_scoring(spark, docs):
    named = frame(spark, ROWS).select("doc_id", lm_scoring.held_out("doc_id", 7).alias("held_out"), "text")
    want = brute.unigram(ROWS)
    rows = lm_scoring.score(named).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert len(lm_scoring.score(docs.select("doc_id", lm_scoring.held_out("doc_id", 7).alias("held_out"), "text")).collect()) == len(REPEATED)


def test_lm_score_is_a_softmax_and_beats_the_base(spark):
    """``score`` summed token by token from plain softmax rows; more than the base on held-out text; the same on any partitioning."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", lm_scoring.held_out("doc_id", 7).alias("held_out"), "text")
    one = {r.doc_id: r for r in lm_scoring.score(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm_scoring.score(docs.repartition(7)).collect()}
    assert all(abs(r.score - many[d]) < 1e-4 * abs(r.score) for d, r in one.items())
    train = docs.where("not held_out")
    counts = lm_scoring.written(lm_scoring.word_counts(train), "counts")
    lex = lm_scoring.lexicon(counts, train.count())
    model = lm_scoring.train(lm_scoring.written(lm_scoring.encode(docs, lex), "coded"), lex)
    count = {r.word: r.c for r in counts.collect()}
    rank = {w: i + 2 for i, w in enumerate(lex.words[: lm_scoring.VOCAB])}
    other = sum(c for w, c in count.items() if w not in rank)
    kinds = sum(w not in rank for w in count)
    for r in docs.orderBy("doc_id").limit(12).collect():
        a, b, total = lm_scoring.END, lm_scoring.END, 0.0
        for w in [*brute.low_words(r.text), None]:
            i = lm_scoring.END if w is None else rank.get(w, lm_scoring.OTHER)
            x = (model.R[a] * model.c1 + model.R[b] * model.c2) @ model.Q.T + model.b
            total += (x[i] - np.log(np.exp(x.astype(float)).sum())) / np.log(10)
            total += np.log10((count.get(w, 0) + 1) / (other + kinds + 1)) if i == lm_scoring.OTHER else 0
            a, b = i, a
        assert abs(total - one[r.doc_id].score) < 1e-3 * abs(total)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_log_bilinear_probabilities_sum_to_one():
    model = lm_scoring.LogBilinear.start(np.full(30, 1 / 30), seed=1)
    a1, a2, z = model.tables()
    total = np.exp(a1[:, None, :] + a2[None, :, :] - z[:, :, None]).sum(2)
    assert np.allclose(total, 1, atol=1e-4)


def test_noise_contrastive_training_learns_a_cycle():
    ids = np.tile(np.arange(2, 12), 2000)
    unigram = np.bincount(ids, minlength=12) + 1.0
    t = lm_scoring.Trainer(lm_scoring.LogBilinear.start(unigram / unigram.sum()), unigram / unigram.sum(), 0)
    one, two = lm_scoring.contexts(ids, np.array([0]))
    for _ in range(60):
        t.step(ids[:8192], one[:8192], two[:8192])
    a1, a2, z = t.m.tables()
    p = (a1[one, ids] + a2[two, ids] - z[one, two])[5:]
    assert p.mean() > np.log(0.3)


def test_url_filters(spark):
    urls = [
        ("http://a.b.example.org/es/x?y", "a.b.example.org", "/es/x", "example.org/es/", "block"), ("https://EXAMPLE.org/en/123#q", "example.org", "/en/123", "example.org/en/1", "block"), ("x://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("x://com/de/", "com", "/de/", "com/de/", "block"), ("x://a.com/fr", "a.com", "/fr", None, "allow"), ("x://a.net/", "a.net", "/", None, "allow"), ("x://org", "org", "", None, "allow"),
        ("x://org?/p", "org", "", None, "allow"), (None, "", "", None, "allow"), ("example.org/es/", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("", "", "", None, "allow"), ("x://" + "q." * 5000 + "com/de/" + "z" * 9999, "q." * 5000 + "com", "/de/" + "z" * 9999, "com/de/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], 7) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = [tuple(r) for r in url_filters.filter_urls(pages).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [u[1:] for u in urls]
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    trie = url_filters.HostPathTrie((("block", "a.b", "/x/"), ("allow", "a.b", "/x/y/"), ("block", "a.b", "/x/y/z"), ("allow", "a.b", "/x/"), ("allow", "a.b", "")))
    assert trie.match("c.a.b", "/x/q") == ("block", "a.b/x/") and trie.match("a.b", "/x/y/zz/1") == ("block", "a.b/x/y/z") and trie.match("a.b", "") == ("allow", "a.b") and trie.match("b", "/x/") is None


def test_language_id_held_out(spark):
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_id_against_plain_compression(spark, docs):
    import zstandard

    dicts = {"en": (prose(1, 60) + " the and of").encode(), "de": b"der die und das ist nicht", "x": b"abc " * 20}
    codes = language_id.Codes(dicts)
    for r in language_id.predict(docs, dicts).where("doc_id < 14").collect():
        if r.lang_pred != "und":
            data, sizes = language_id.letters(r.text).encode(), {}
            for lang, d in dicts.items():
                plain = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(dict_data=plain, compression_params=zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False))
                sizes[lang] = sum(len(c.compress(data[i : i + language_id.BLOCK])) for i in range(0, len(data), language_id.BLOCK))
            assert list(sizes.values()) == codes.sizes(r.text) and sizes[r.lang_pred] == min(sizes.values())


def test_language_id_samples_whole_texts(spark, monkeypatch):
    """Pieces reach the end of a long text; any number of languages, and ids that repeat."""
    long = "start " + "middle " * 3000 + "finish"
    rows = [(1, long, "aa"), (1, "other words", "aa"), (1, "other words", "aa"), (2, None, "aa"), (3, "x y", None)] + [(10 + i, f"w{i}", f"l{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.sample_texts(df)
    assert len(found) == 301 and sorted(found["aa"], key=len)[0] == "other words" and any(p.startswith("start") and p.endswith("finish") for p in found["aa"])
    assert len(language_id.train_dictionaries(df)) == 301 and len(language_id.spread(long, 400)) <= 403


def test_language_id_cases(spark, docs, empty):
    out = language_id.predict(docs, {"en": b"the and of", "de": b"der die und"}).collect()
    assert len(out) == len(REPEATED)
    assert all((r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.train_dictionaries(empty) == {} and language_id.predict(empty, {"en": b"x"}).count() == 0
    assert language_id.train_dictionaries(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = toxicity.fit(toxicity.labelled_sample(docs, train))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.score(docs.select("doc_id", "text"), model).withColumnRenamed("toxic", "said").join(test, "doc_id").collect()
    said, true = [r.said for r in rows], [r.toxic == 1 for r in rows]
    hit = sum(a and b for a, b in zip(said, true))
    assert hit / max(1, sum(said)) > 0.95 and hit / sum(true) > 0.8


def test_toxicity_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (8, None), (8, 0), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(frame(spark, ROWS), labels)
    assert sorted(y for _, y in rows) == [0, 1]
    none = toxicity.fit([])
    out = toxicity.score(docs.withColumn("grade", F.lit("x")), none).collect()
    assert len(out) == len(REPEATED) and all(r.expected_severity < 1e-6 and r.grade == 0 and not r.toxic for r in out)
    assert toxicity.score(empty, none).count() == 0 and toxicity.labelled_sample(empty, labels) == []


def test_substring_dedup(docs):
    spans = {r.doc_id: r for r in substring_dedup.merged_spans(substring_dedup.passages(docs)).collect()}
    assert spans[2].spans == [(0, 90)] and spans[2].first_ref == 1 and spans[3].spans == [(0, 90)]
    assert spans[12].spans == [(40, 100)] and spans[12].first_ref == 11
    assert not {1, 11, 14, 5, 6, 7, 8, 10, 16} & set(spans)
    left = {r.doc_id: r for r in substring_dedup.remove(docs, substring_dedup.merged_spans(substring_dedup.passages(docs))).collect()}
    assert 2 not in left and left[11].text == dict(ROWS)[11] and PASSAGE.split()[3] not in left[12].text.split() and len(left[12].text) == left[12].n_chars and 5 in left


@pytest.fixture(scope="module")
def gap_spans(spark):
    """Spans of documents that hold two passages of an earlier one, of n words each, with g unlike words between."""
    cases = [(60, 20), (60, 60), (60, 100), (60, 150), (100, 150), (200, 200)]
    rows = []
    for i, (n, g) in enumerate(cases):
        one, two = prose(500 + i, n), prose(600 + i, n)
        for j in (0, 1):
            rows.append((10 * i + j, " ".join([prose(700 + 10 * i + j, 30), one, prose(800 + 10 * i + j, g), two, prose(900 + 10 * i + j, 30)])))
    found = {r.doc_id: r.spans for r in substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows))).collect()}
    return {c: found.get(10 * i + 1) for i, c in enumerate(cases)}, found


def test_passages_on_both_sides_of_a_gap(gap_spans):
    spans, found = gap_spans
    assert spans.pop((60, 20)) == [(30, 170)] and not any(d % 10 == 0 for d in found)
    for (n, g), got in spans.items():
        assert got == [(30, 30 + n), (30 + n + g, 30 + n + g + n)], (n, g)


def test_passage_whose_parts_are_older(spark):
    """Parts of a passage are first seen in documents of their own, then two documents hold all of it."""
    cases, rows = [(40, 40), (45, 35), (30, 30), (10,) * 8, (40, 40, 40)], []
    for i, lengths in enumerate(cases):
        fragments = [prose(2000 + 20 * i + j, n) for j, n in enumerate(lengths)]
        rows += [(100 * i + j, " ".join([prose(3000 + 20 * i + j, 30), x, prose(4000 + 20 * i + j, 30)])) for j, x in enumerate(fragments)]
        rows += [(100 * i + 50 + j, " ".join([prose(5000 + 20 * i + j, 30), *fragments, prose(6000 + 20 * i + j, 30)])) for j in (0, 1)]
    found = {r.doc_id: r.spans for r in substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows))).collect()}
    assert found == {100 * i + 51: [(30, 30 + sum(x))] for i, x in enumerate(cases)}


def test_exact_passages_against_all_windows(spark):
    """Fragments of 20 to 70 words, in all kinds of order: every word in a window of 50 that an earlier document holds goes."""
    r = random.Random(21)
    pool = [prose(12_000 + i, r.randint(20, 70)) for i in range(14)]
    rows = [(i, " ".join(r.choice(pool) if r.random() < 0.7 else prose(13_000 + 40 * i + j, 15) for j in range(r.randint(1, 8)))) for i in range(70)]
    rows += [(0, prose(1, 5)), (None, pool[0]), (200, None), (200, pool[0])]
    found = {x.doc_id: x.spans for x in substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows[:70]))).collect()}
    seen, n = set(), 0
    for d, text in rows[:70]:
        w = text.lower().split()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        covered = {i for s in found.get(d, ()) for i in range(s.lo, s.hi)}
        for i, x in enumerate(windows):
            assert x not in seen or covered.issuperset(range(i, i + 50)), (d, i)
            n += x in seen
        seen.update(windows)
    assert n > 500
    left = substring_dedup.remove(frame(spark, rows), substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows)))).collect()
    assert {x.doc_id for x in left} >= {0, None, 200}


def test_near_passages_are_found(spark):
    """Passages of 60 words with 5 to 18 % of their words changed at random: nearly all are found."""
    shares, each, rows = (0.05, 0.1, 0.15, 0.18), 25, []
    for i in range(len(shares) * each):
        r, passage = random.Random(i), prose(7000 + i, 60)
        words = passage.split(" ")
        for p in r.sample(range(1, 59), int(shares[i // each] * 60)):
            words[p] = "changed"
        rows += [(2 * i + j, " ".join([prose(8000 + 2 * i + j, 30), x, prose(9000 + 2 * i + j, 30)])) for j, x in enumerate((passage, " ".join(words)))]
    found = {r.doc_id: r.spans for r in substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows))).collect()}
    assert not any(d % 2 == 0 for d in found)
    got = [sum(any(s.lo >= 27 and s.hi <= 93 for s in found.get(2 * i + 1, ())) for i in range(k * each, k * each + each)) for k in range(len(shares))]
    assert all(n >= 0.9 * each for n in got), got


def marked(spark, rows):
    return {r.doc_id: r.spans for r in substring_dedup.merged_spans(substring_dedup.passages(frame(spark, rows))).collect()}


@pytest.mark.parametrize(("size", "copies"), [(15, 1), (30, 1), (45, 1), (30, substring_dedup.LIST + 4)])
def test_near_passages_whose_fragments_are_older(spark, size, copies):
    """Passages of 90 words, later copies with 10 % of the words changed, fragments in documents older than both."""
    n, fragments, firsts, copied = 30, [], [], []
    for i in range(n):
        r, passage = random.Random(900 + i), prose(20_000 + i, 90).split(" ")
        words = ["changed" if p in set(r.sample(range(90), 9)) else x for p, x in enumerate(passage)]
        around = lambda x, k: " ".join([prose(k, 20), *x, prose(k + 1, 20)])
        fragments += [around(passage[a : a + size], 10**6 + 4000 * i + 20 * a + 2 * c) for a in range(0, 90, size) for c in range(copies)]
        firsts.append(around(passage, 30_000 + 2 * i))
        copied.append(around(words, 40_000 + 2 * i))
    texts = fragments + firsts + copied
    found = marked(spark, list(enumerate(texts)))
    assert not any(d < len(fragments) + len(firsts) for d in found)
    whole = [sum(min(s.hi, 110) - max(s.lo, 20) for s in found.get(len(texts) - n + i, ())) >= 72 for i in range(n)]
    assert sum(whole) >= 0.9 * n, sum(whole)


def test_near_passages_whose_pairs_of_seeds_are_in_many_older_documents(spark):
    """Near passages of 60 words; parts of 45 words that hold nearly all their pairs of seeds stand in more older documents
    than are met first, so that only words beside the pairs tell the whole one."""
    n, copies, around = 20, substring_dedup.LIST + 8, lambda k, x: " ".join([prose(k, 20), *x, prose(k + 1, 20)])
    older, firsts, later = [], [], []
    for i in range(n):
        r, passage = random.Random(300 + i), prose(70_000 + i, 60).split(" ")
        gone = set(r.sample(range(60), 5))
        older += [around(3 * 10**6 + 1000 * i + 4 * c + 2 * (lo > 0), passage[lo : lo + 45]) for lo in (0, 15) for c in range(copies)]
        firsts.append(around(80_000 + 4 * i, passage))
        later.append(around(90_000 + 4 * i, ["changed" if p in gone else x for p, x in enumerate(passage)]))
    texts = older + firsts + later
    found = marked(spark, list(enumerate(texts)))
    assert not any(d < len(older) + n for d in found)
    whole = [sum(min(s.hi, 80) - max(s.lo, 20) for s in found.get(len(texts) - n + i, ())) >= 48 for i in range(n)]
    assert sum(whole) >= 0.9 * n, sum(whole)


def test_documents_that_share_a_sentence_only_are_not_chained(spark):
    """Of pairs of seeds in two documents those go that can't have the words of a passage; one place of 50 words stays."""
    near = lambda n, k: bytes([1] * n + [2 + k] * (substring_dedup.MARGIN - n))
    rows = [(2, 1, 20, 35, 60, 75, near(5, 0) + near(5, 0), near(5, 1) + near(5, 1)), (3, 1, 20, 35, 60, 75, near(15, 0) + near(15, 0), near(15, 1) + near(15, 1))]
    rows += [(4, 1, a, a + 9, a, a + 9, near(0, 0) * 2, near(0, 1) * 2) for a in (10, 30)]
    both = spark.createDataFrame(rows, "doc_id long, ref_id long, a int, b int, ra int, rb int, near binary, other binary")
    assert sorted((r.doc_id, r.a) for r in substring_dedup.alignable(both).collect()) == [(3, 20), (4, 10), (4, 30)]


def test_words_that_may_be_the_rarest_aligned_one():
    """Against all stretches: the words with no more rarer ones than a fifth of the longest part of the class."""
    r = random.Random(8)
    for m in (0, 39, 40, 90, 430):
        keys = np.array([r.randrange(max(5, m // 2)) for _ in range(m)], np.uint64)
        counts = (keys % np.uint64(7)).astype(np.int64)
        order, due = list(zip(counts.tolist(), keys.tolist())), set()
        for size, most in ((40, 10), (55, 13), (70, 16), (85, 19)):
            for s in range(m - size + 1):
                due |= {x[1] for x in order[s : s + size] if sum(y < x for y in order[s : s + size]) <= most}
        assert set(substring_dedup.rare_keys(keys, counts).tolist()) == due, m


def test_near_passages_share_a_block_key():
    """Two places with a passage around them have a key of every size in common that their pair's width allows, whatever the
    others of the pair share; places of a common sentence in unlike texts have none of three words."""
    r, around = random.Random(31), substring_dedup.MARGIN
    for m in range(150):
        width = r.choice([6, 9, 13, 20, 27, 35, 45, 49])
        before = r.randint(0, around)
        behind = min(around, max(0, r.randint(50, 60) - width - before))
        words = np.array([[r.randrange(1, 1 << 16) for _ in range(2 * around)] for _ in range(2)], np.uint16)
        ends = [*range(before), *range(around, around + behind)]
        changed = set(r.sample(ends, min((width + len(ends)) // 5, max(0, (min(before, behind) or len(ends)) // 2 - 1)))) - {before - 1, around + behind - 1}
        for i in ends:
            if i not in changed:
                words[1, i] = words[0, i]
        aligned = lambda lo, n: all(2 * sum(i in changed for i in range(k, lo + n)) <= lo + n - k for k in range(lo, lo + n))
        if width + len(ends) < 50 or not aligned(0, before) or not aligned(around, behind):
            continue
        for size, most in substring_dedup.BLOCKS.items():
            if width <= most:
                core = np.full((2, 2), r.choice([0, 5, 30, around]))
                row, key = substring_dedup.block_keys(words, size, np.full(2, width), core)
                assert set(key[row == 0]) & set(key[row == 1]), (m, size)
    words = np.array([[r.randrange(1, 1 << 16) for _ in range(2 * around)] for _ in range(40)], np.uint16)
    words[:, around : around + 6] = words[0, around : around + 6]
    row, key = substring_dedup.block_keys(words, 3, np.full(40, 8), np.tile([0, 6], (40, 1)))
    assert len(set(key)) == len(key) > 40


def test_near_passages_against_all_pairs_of_windows(spark):
    """Texts of boilerplate sentences, of which some are in most documents, and parts of earlier texts with words changed:
    of the words in windows of 50 that match 43 words or more of an earlier document's, place by place, nine in ten go."""
    r = random.Random(77)
    sentences = [prose(50_000 + i, r.randint(8, 18)).split(" ") for i in range(12)]
    texts = []
    for d in range(60):
        words = []
        while len(words) < 160:
            if r.random() < 0.4:
                words += sentences[min(r.randrange(12), r.randrange(12))]
            elif d > 5 and r.random() < 0.5:
                other = texts[r.randrange(d)]
                lo = r.randrange(len(other) - 70)
                words += [f"new{d}" if r.random() < 0.08 else x for x in other[lo : lo + 70]]
            else:
                words += prose(60_000 + 1000 * d + len(words), r.randint(10, 30)).split(" ")
        texts.append(words)
    found = marked(spark, [(i, " ".join(x)) for i, x in enumerate(texts)])
    ids = {}
    coded = [np.array([ids.setdefault(x, len(ids)) for x in t]) for t in texts]
    due = missed = 0
    for d, a in enumerate(coded):
        near = np.zeros(len(a), bool)
        for b in coded[:d]:
            same = a[:, None] == b[None, :]
            for shift in range(50 - len(a), len(b) - 49):
                line = np.diagonal(same, shift)
                sums = np.concatenate([[0], np.cumsum(line)])
                for i in np.flatnonzero(sums[50:] - sums[:-50] >= 43) + max(0, -shift):
                    near[i : i + 50] = True
        gone = np.zeros(len(a), bool)
        for s in found.get(d, ()):
            gone[s.lo : s.hi] = True
        due, missed = due + int(near.sum()), missed + int((near & ~gone).sum())
    assert due > 1500 and missed <= 0.1 * due, (due, missed)


def test_common_words_and_parts():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice([b"u", b"v", b"w"]) for _ in range(r.randint(0, 12))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_lcs_row(row, x, b)]
        mask = substring_dedup._common(a, b)
        rest = iter(b)
        assert sum(mask) == row[-1] and all(x in rest for x, m in zip(a, mask) if m)
    exact = lambda n: b"\1" * n
    cut = lambda m: sorted(substring_dedup.parts(bytearray(m), 0, len(m)))
    assert cut(exact(60) + bytes(40) + exact(49)) == [(0, 60, 60)]
    assert cut(bytes(9) + exact(50) + bytes(90) + (exact(4) + b"\0") * 12 + bytes(3)) == [(9, 59, 50), (149, 208, 48)]
    assert cut(exact(49) + bytes(80) + exact(49)) == [] and cut((exact(3) + b"\0") * 40) == []


def _lcs_row(old, x, b):
    new = [0]
    for j, y in enumerate(b, 1):
        new.append(old[j - 1] + 1 if x == y else max(old[j], new[-1]))
    return new[1:]


def test_chains_run_forward():
    got = substring_dedup.chains_of([0, 10, 20, 30, 5], [100, 110, 121, 131, 500])
    assert got == [[(0, 100), (10, 110), (20, 121), (30, 131)]]
    assert substring_dedup.chains_of([0, 0, 0], [1, 2, 3]) == [] and substring_dedup.chains_of([0, 1000], [0, 1000]) == []


def test_without():
    assert substring_dedup.without("a b\nc  d e", [(1, 3)]).split() == ["a", "d", "e"]
    assert substring_dedup.without("a b c", [(0, 3)]).split() == [] and substring_dedup.without(" a b", [(1, 9)]).split() == ["a"]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert suffix_dedup.dedup(empty).count() == 0
    assert jaccard_join.linked_classes(empty).count() == 0
    assert quality_rules.apply_policy(quality_rules.ledger(empty)).count() == 0
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert packing.pack(empty).count() == 0
    assert substring_dedup.merged_spans(substring_dedup.passages(empty)).count() == 0
    assert lm_scoring.score(empty.select("doc_id", F.lit(False).alias("held_out"), "text")).count() == 0


def test_stages_leave_only_the_tables_that_their_result_reads(spark, docs, tmp_path):
    import os

    from tidegraph.llm.common import shared_dir

    there = shared_dir(spark).removeprefix("file://")
    stages = dict(corpus_pipeline.STAGES)
    for name, kept in (("jaccard_join", {"gone", "again"}), ("substring_dedup", {"spans", "several"})):
        before = set(os.listdir(there))
        out = stages[name](spark, docs, str(tmp_path))
        assert {x.split("-")[0] for x in set(os.listdir(there)) - before} <= kept and out.count() > 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage on its own input: what it keeps, its columns, and the pieces at the end."""
    bench = [("b1", " ".join(dict(ROWS)[14].split()[100:130]))]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, REPEATED).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, stages = at.columns, dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    one = stages["quality_rules"](spark, at, str(tmp_path))
    assert one.columns == columns and set(ids(one)) == {1, 2, 3, 4, 11, 12, 14, None}
    two = stages["jaccard_join"](spark, one, str(tmp_path))
    assert two.columns == columns and ids(two) == sorted([1, 4, 11, 12, 14, None] if brute.classes(ROWS)[4][1] == 4 else [1, 11, 12, 14, None], key=str)
    three = stages["substring_dedup"](spark, two, str(tmp_path))
    assert three.columns == columns and {1, 11, 12, 14, None} <= set(ids(three))
    four = stages["decontamination"](spark, three, str(tmp_path))
    assert four.columns == columns and set(ids(three)) - set(ids(four)) == {14}
    five = corpus_pipeline.run(spark, str(tmp_path))
    assert set(ids(five)) == set(ids(four)) and five.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_every_operator_is_registered():
    names = registry.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are called as the stages' own are kept, with ids that repeat or lack."""
    extra = ["_spans", "_ref", "_h", "_top", "_text", "row", "key", "_Spans_"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").select("text").first().text
    texts = [(1, BASE), (2, changed(BASE, 40)), (2, BASE + " again"), (None, prose(71, 80)), (None, item), (3, prose(72, 70) + " " + PASSAGE), (4, PASSAGE + " " + prose(73, 70)), (5, item)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t), *[f"{c}{k}" for c in extra], {"m": k}) for k, (d, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra) + ", m map<string,int>")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes), name
        rows = out.collect()
        assert all(r[c] == f"{c}{r.m['m']}" for r in rows for c in extra), name
        if name == "decontamination":
            assert sorted(r.m["m"] for r in rows) == [0, 1, 2, 3, 5, 6]
        if name == "substring_dedup":
            assert len(next(r.text for r in rows if r.doc_id == 4)) < len(texts[6][1])


def test_language_learns_from_rows_without_id(spark):
    rows = [(None, "the and of to in is that it was for on are with " * 3, "en") for _ in range(30)] + [(None, "le la les des est une dans pour que qui sur pas " * 3, "fr") for _ in range(30)]
    docs = spark.createDataFrame([*rows, (2, "that it was for the", None), (7, "dans pour que les", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train_dictionaries(docs)).collect() if r.doc_id}
    assert found == {2: "en", 7: "fr"}


@pytest.mark.parametrize("at_once", [1, 3, 10**6])
def test_windows_are_found_in_parts(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontamination, "AT_ONCE", at_once)
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("ab") for _ in range(60))) for i in range(6)]
    items = [(str(i), " ".join(r.choice("ab") for _ in range(n))) for i, n in enumerate([3, 4, 5, 6, 12, 11])]
    found = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(str((x.doc_id, x.n_words, sum(s.hi - s.lo for s in x.spans), x["items"])) for x in found.collect()) == sorted(map(str, brute.contamination(docs, items)))
