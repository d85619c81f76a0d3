"""The training-data operators on small tables: planted cases, brute force, odd input."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, exact_dedup, language_id, language_model, near_dedup, packing, quality, repeated_spans, sharding, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, __p0 int"
WORDS = {"en": "the and of in to that is was for it with as".split(), "fr": "le la et les des une dans que pour est qui".split()}


def made(seed: int, lang: str = "en", n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "ing", "eur", "ly", "x"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    base = [made(i, "en" if i % 2 else "fr") for i in range(24)]
    near = base[3].split(" ")
    near[60] = "changed"
    out = [*base, base[0], base[0].replace(" ", "\n\t"), " ".join(near), None, "", "   ", "12 34 !!", "short one", "a" * 3000, base[5] + base[7], "é" * 150 + "日本" * 90]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "fr" if t and "le " in t else "en", f"s{i % 3}", None, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [(None, made(1), "en", None, 3, None, None, None), (4, texts[4], "fr", "s", 1, "x", "y", 1), (7, texts[7], None, "s", 1, "x", "y", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer_paths():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_exact_groups(docs, none):
    got = exact_dedup.groups(docs).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for i, t in listed(docs):
        want.setdefault(plain(t), []).append(i)
    assert len(got) == docs.count()
    for r in got:
        group = next(ids for t, ids in want.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in group if i is not None]
        assert r["group_size"] == len(group) and r["keep_id"] == (min(known) if known else None)
    assert sum(r["kept"] for r in got) == len(want)
    assert exact_dedup.groups(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_saturated_filter(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 64)
    assert sorted(map(str, exact_dedup.groups(docs).collect())) == want


def test_sharding(spark, docs):
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    out = sharding.shuffled(rows, 8, 3).collect()
    assert len(out) == docs.count()
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards.get(k, ())) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffled(rows, 8, 3).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shuffled(rows.limit(0), 8, 1).count() == 0


def test_language(docs, none):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert got[27]["lang_pred"] == got[28]["lang_pred"] == got[30]["lang_pred"] == "und" and got[27]["score"] == 0
    held = [i for i in range(24) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(24))
    assert language_id.identify(none).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {27, 28, 29, 30}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_quality(spark, docs, none):
    rows = [(100 + i, made(i) if i % 3 else (made(i).upper() + "!!").replace(" ", "!! "), "en", "s", 1, "x", "y", 1) for i in range(200)]
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.score(some.union(docs), quality.train(some, labels)).collect()}
    held = [i for i in range(200) if zlib.crc32(str(100 + i).encode()) % 5 == 0]
    assert all(got[100 + i]["held_out"] and got[100 + i]["predicted"] == int(i % 3 > 0) for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert quality.score(none, quality.train(some, labels.limit(0))).count() == 0


def test_near_classes(docs, none, texts):
    got = {r["doc_id"]: r for r in near_dedup.classes(docs).collect() if r["doc_id"] is not None}
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert all(got[i]["class_id"] == top(i) for i in sets)
    assert got[26]["class_id"] == 3
    assert near_dedup.classes(none).count() == 0
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({top(i) for i in sets})


def near_family(n: int, pool: int = 24) -> list[str]:
    """Texts with four or five of ``pool`` edits of one template: few pairs are 0.8 similar."""
    r = random.Random(1)
    spots, found = r.sample(range(2, 138, 5), pool), set()
    while len(found) < n:
        found.add(tuple(sorted(r.sample(spots, r.randint(4, 5)))))
    return [" ".join(f"x{k}" if k in edits else f"w{k}" for k in range(140)) for edits in sorted(found)]


def near_labels(texts: list[str]) -> list[int]:
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a in label[:]:
        for b in range(a):
            m = len(sets[a] & sets[b])
            if label[a] != label[b] and m >= 0.8 * (len(sets[a]) + len(sets[b]) - m):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def linked_labels(spark, texts: list[str], bands: list[list[int]]) -> list[int]:
    """Labels from links of the texts with these buckets instead of their own."""
    rows = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, bands, strict=True))], "doc_id long, text string, bands array<long>")
    rows = rows.withColumn("key", near_dedup.row_key()).withColumn("key2", near_dedup.row_key(1))
    signed = rows.mapInArrow(near_dedup._signed, near_dedup.SIGNED).drop("bands")
    signed = signed.join(rows.select("doc_id", "bands"), "doc_id").persist()
    doc = {r["node"]: r["doc_id"] for r in signed.select("node", "doc_id").collect()}
    label = list(range(len(texts)))
    for r in near_dedup.connected(signed, rows.select("key", "text")).collect():
        low, high = sorted((label[doc[r["node"]]], label[doc[r["label"]]]))
        label = [low if x == high else x for x in label]
    return label


def test_near_family(spark):
    texts = near_family(300)
    got = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = near_labels(texts)
    assert 1 < len(set(want)) < len(texts)
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want))


def near_chain(n: int) -> list[str]:
    """Windows over one row of words; only neighbours are 0.8 similar."""
    return [" ".join(f"w{k}" for k in range(12 * i, 12 * i + 116)) for i in range(n)]


def test_near_links_between_clusters(spark):
    """Members of one bucket near different leaders meet each other, too."""
    texts = near_chain(60)
    assert linked_labels(spark, texts, [[64, 65]] * len(texts)) == near_labels(texts) == [0] * len(texts)


def test_near_links_of_far_bands(spark):
    """Two shared bands are enough, however far apart."""
    texts = near_chain(20)
    assert linked_labels(spark, texts, [[64, 84]] * len(texts)) == [0] * len(texts)


def test_near_links_done_in_turns(spark):
    """Two texts that share two bands meet although each is near a leader in one of them."""
    chain, bands, want, texts = near_chain(400), [[0, 2], [0, 1, 2], [0, 1, 3], [1, 3]], [], []
    for g in range(20):
        texts += chain[20 * g : 20 * g + 4]
        want += [4 * g] * 4
    assert linked_labels(spark, texts, [[64 * (i // 4 + 1) + k for k in bands[i % 4]] for i in range(len(texts))]) == want


def test_dart_estimates():
    r = np.random.default_rng(1)
    a = near_dedup.mix64(r.integers(0, 1 << 60, 400).astype(np.uint64))
    for share in (0.2, 0.5, 0.9):
        m = int(400 * share)
        both = np.concatenate([a, a[:m], near_dedup.mix64(np.arange(400 - m, dtype=np.uint64))])
        sig = near_dedup.darts(both, np.repeat([0, 1], 400), 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - m / (800 - m)) < 0.05
    w = np.array([3, 1, 1, 1])
    x = near_dedup.darts(np.concatenate([a[:2], a[:2]]), np.array([0, 0, 1, 1]), 2, 4096, w)
    assert abs((x[0] == x[1]).mean() - 2 / 4) < 0.05


def brute_repeats(texts, least=200):
    seen, raws = {}, [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - least + 1):
            seen.setdefault(raw[i : i + least], []).append((d, i))
    masks = [np.zeros(len(raw), dtype=bool) for raw in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i : i + least] = True
    return raws, masks


@pytest.mark.parametrize("hot", [400, 1])
def test_repeats(docs, none, monkeypatch, hot):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    given = listed(docs)
    raws, masks = brute_repeats([t for _, t in given])
    want = sorted((str(i), int(m.sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~m])).hexdigest()) for (i, _), r, m in zip(given, raws, masks, strict=True))
    got = repeated_spans.digests(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert repeated_spans.digests(none).count() == 0
    assert repeated_spans.remove_repeats(docs).columns == docs.columns


def test_interval_tree():
    r = random.Random(3)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(30)]
    ends = np.cumsum([len(s) for s in strings])
    places, lengths = repeated_spans.maximal_repeats(np.frombuffer("".join(strings).encode(), np.uint8), ends, np.zeros(30, np.int64), 9)
    mark = repeated_spans._covered(places, lengths, int(ends[-1]))
    _, masks = brute_repeats(strings, 9)
    assert (mark == np.concatenate(masks)).all()


def test_packing(docs, none, tokenizer_paths):
    from tokenizers import Tokenizer

    path, _, pattern = tokenizer_paths
    t = Tokenizer.from_file(path)
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(800).cast("long")).withColumn("text", F.lit("hi <|endoftext|> x<|endoftext|>")))
    rows = packing.pack(docs, path, pattern, with_ids=True).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        whole.setdefault(r["doc_id"], []).append(r)
    for i, text in listed(docs):
        if i in (4, 7):  # stands twice
            continue
        ids = [x for r in whole[i] for x in r["ids"]]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, packing.END]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in whole[i])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, path, pattern).count() == 0


def test_plan_is_tight():
    r = random.Random(5)
    for _ in range(20):
        h = {n: r.randrange(0, 40) for n in r.sample(range(1, 1025), 60)}
        runs, load, used = packing.plan(h), {}, {}
        for n, r0, r1, first, offset in runs:
            used.setdefault(n, []).append((r0, r1))
            for k in range(r1 - r0):
                load.setdefault(first + k, []).append((offset, n))
        for n, c in h.items():
            spans = sorted(used.get(n, []))
            assert sum(b - a for a, b in spans) == c and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        for b in load.values():
            b.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 1024
        assert len(load) <= 1.25 * sum(n * c for n, c in h.items()) / 1024 + 2


def test_bpe_split_takes_no_longer_beside_ascii(tokenizer_paths):
    split = byte_bpe.Splitter(tokenizer_paths[2])
    text, took = "один два 日本 три " * 8000, []
    for run in (split.findall, split):
        began = time.process_time()
        run(text)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.05


def test_bpe(docs, none, tokenizer_paths):
    import tiktoken

    _, path, pattern = tokenizer_paths
    c = byte_bpe.Codec(byte_bpe.load_ranks(path), pattern)
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.transducer.ranks, special_tokens={}).encode_ordinary
    r = random.Random(2)
    odd = [chr(i) for i in range(0x378, 0x1FAFF) if not 0xD800 <= i < 0xE000 and not chr(i).isprintable()]
    for k in range(600):
        s = "".join(r.choice([r.choice(odd), "the", "ing", "é", "日本", "\n", "  ", "123", "aaaa", "🙂", "'s", chr(r.randrange(32, 0xD7FF))]) for _ in range(r.randrange(30)))
        ids = np.frombuffer(c.encode(s), "<u4")
        assert ids.tolist() == exact(s) and "".join(byte_bpe.decode_stream(c, ids, 3)) == s
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, path, pattern).collect()}
    for i, t in listed(docs):
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["n_tokens"] == len(exact(t or ""))
    assert byte_bpe.round_trip(none, path, pattern).count() == 0


def test_utf8_stream():
    for s in ("héllo", "日本🙂x", ""):
        for step in (1, 2, 3):
            m, raw = byte_bpe.Utf8Stream(), s.encode()
            assert "".join(m.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + m.close() == s
    m = byte_bpe.Utf8Stream()
    assert m.feed(b"a\xff\xe6") + m.close() == "a��"


@pytest.mark.parametrize("head", [1 << 18, 128])
def test_language_model(docs, none, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    words = lambda t: [*[w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))], None]
    given = listed(docs)
    counts = {}
    for i, t in given:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    got = {(r["doc_id"], r["n_tokens"]): r for r in language_model.score(docs).collect()}
    for i, t in given:
        r = got[i, len(words(t))]
        want = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in words(t))
        assert r["base_score"] == pytest.approx(want) and r["train_tokens"] == total and r["n_known"] == sum(w in counts for w in words(t))
        assert r["score"] < 0
    long = [r for k, r in got.items() if k[1] > 50]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    assert language_model.score(none).count() == 0


def test_language_model_gradient():
    """Against differences of the log-likelihood."""
    r = np.random.default_rng(5)
    weights = r.normal(size=(64, language_model.CLASS_SIZE))
    one, two = r.integers(0, 9, size=(2, 50)).astype(np.uint64)
    symbol = r.integers(0, language_model.SYMBOLS, size=50)
    block, met, g = language_model.gradient(weights, one, two, symbol)
    assert met.sum() == 50 * 6
    whole = np.zeros_like(weights)
    whole[block] = g
    total = lambda w: language_model.log_probability(w, one, two, symbol).sum() * np.log(10)
    for b in range(language_model._FIXED, 64):
        step = np.zeros_like(weights)
        step[b, b % 16] = 1e-5
        assert (total(weights + step) - total(weights - step)) / 2e-5 == pytest.approx(whole[b, b % 16], abs=1e-5)


def test_language_model_adds_up():
    """The classes and symbols of a context have probabilities that add up to one."""
    r = np.random.default_rng(6)
    weights = r.normal(size=(64, language_model.CLASS_SIZE))
    every = np.arange(language_model.SYMBOLS)
    one, two = np.full(len(every), 3, np.uint64), np.full(len(every), 4, np.uint64)
    assert (10 ** language_model.log_probability(weights, one, two, every)).sum() == pytest.approx(1)


def test_language_model_mixing():
    """Moves of tasks are averaged by how often each met a block."""
    r = np.random.default_rng(7)
    weights, scale = np.zeros((1 << 13, language_model.CLASS_SIZE), np.float32), np.ones(1 << 13, np.float32)
    learners = [language_model._Learner(weights, scale) for _ in range(2)]
    for x, n in zip(learners, (9000, 300), strict=True):
        one, two = r.integers(0, 99, size=(2, n)).astype(np.uint64)
        x.update(one, two, r.integers(0, language_model.SYMBOLS, size=n))
        assert x.met.sum() == 6 * n
    met = sum(x.met for x in learners)
    want = sum(x.met[:, None] * (x.weights - x.before) for x in learners) / np.maximum(met, 1)[:, None]
    got = np.zeros_like(want)
    for batch in language_model._mixed(b for x in learners for b in x.moves()):
        for row in batch.to_pylist():
            at, n, move, _ = language_model._read(row)
            assert (n == met[at]).all()
            got[at] = move
    assert np.allclose(got, want, atol=5e-3)


def test_language_model_rare_words(spark):
    """What follows a word is learnt for words that are no symbols of their own, too. The order
    of pairs is random, so that only the word before tells what follows."""
    r = random.Random(1)
    fill = " ".join(f"filler{k}" for k in range(300))
    lines = [fill] * 60 + [" ".join(f"rare{k} {'alpha' if k % 2 else 'beta'}" for k in r.sample(range(40), 40)) for _ in range(30)]
    tries = [f"rare{k} {w}" for k in range(40) for w in ("alpha", "beta")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = [i for i in range(2000) if not held(i)][: len(lines)], [i for i in range(2000) if held(i)][: len(tries)]
    docs = spark.createDataFrame([*zip(ids[0], lines), *zip(ids[1], tries)], "doc_id long, text string")
    found = {r["text"]: r["score"] for r in language_model.score(docs).join(docs, "doc_id").select("text", "score").distinct().collect()}
    # How likely the end is after alpha and after beta is in all of these, so only gaps tell.
    gap = [found[f"rare{k} alpha"] - found[f"rare{k} beta"] for k in range(40)]
    assert min(gap[1::2]) > max(gap[::2])


def test_vector_search(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 8)) * r.uniform(0.5, 2, size=(300, 1))
    v[40:90] = v[7]
    rows = [(i, v[i].astype(np.float32).tolist()) for i in range(300)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, [1.0] * 8), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in vector_search.search(df, df.filter("vec_id % 20 = 0"), factor=1.0).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    a = v.astype(np.float32).astype(float)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        s = (a[q] * a).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        assert [found[k][0] for k in range(1, 21)] == want.tolist()
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_vector_ties(spark):
    """Far more distinct vectors tie at the border than are asked for; the smaller ids win."""
    r = np.random.default_rng(0)
    rows = [(0, [1.0] + [0.0] * 8, 1, "x")] + [(1000 - i, [0.0, *r.normal(size=8).tolist()], 2, "y") for i in range(1, 601)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id int, score string")
    got = {x["rank"]: x["vec_id"] for x in vector_search.search(df, df.filter("vec_id = 0")).collect()}
    assert [got[k] for k in range(1, 21)] == list(range(400, 420))


def test_vector_batches_and_recall(spark, monkeypatch):
    """The relaxed search in several batches finds at least 0.9 of what brute force finds."""
    monkeypatch.setattr(vector_search, "BATCH", 30)
    monkeypatch.setattr(vector_search, "SHARD", 500)
    r = np.random.default_rng(3)
    v = r.normal(size=(40, 16))[r.integers(0, 40, 2000)] + 0.3 * r.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for x in vector_search.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    s = v[::20] @ v.T
    s[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert len(got) == 100 and np.mean([len(got[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9


def plain_grams(text):
    """The n-grams of one text, by the definition."""
    runs = ["\0"]
    for c in f"{text} ".lower():
        runs += [c] if c.isalpha() else ["\0"] if runs[-1] != "\0" else []
    return [tuple(runs[i : i + n]) for n in (1, 2, 3) for i in range(len(runs) - n + 1) if runs[i : i + n] != ["\0"]]


def bucket_of(gram):
    h = np.zeros(1, np.uint64)
    for c in gram:
        h = h * np.uint64(0x100000001B3) + np.uint64(0 if c == "\0" else ord(c)) + np.uint64(1)
    return int(near_dedup.mix64(h ^ np.uint64(len(gram) << 56))[0] & np.uint64(language_id.BUCKETS - 1))


def test_language_grams_stand_alone():
    """What a text yields does not depend on what stands before it."""
    texts = ["abc", "def", "abc.", "def", "", "1", "Ünï  a", "ΑΣ", "x\ty"]
    bucket, owner, _ = language_id._grams(texts)
    for k, t in enumerate(texts):
        assert sorted(bucket[owner == k].tolist()) == sorted(bucket_of(g) for g in plain_grams(t))


def test_language_brute_force(spark):
    """Predictions and posteriors against counting in dictionaries."""
    rows = [(i, made(i, "fr" if i % 3 else "en", 3 + i % 5), "fr" if i % 3 else "en", "s", 1, "x", "y", 1) for i in range(60)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    counts, docs = {"en": {}, "fr": {}}, {"en": 0, "fr": 0}
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            docs[lang] += 1
            for g in plain_grams(t):
                b = bucket_of(g)
                counts[lang][b] = counts[lang].get(b, 0) + 1
    every = {x: sum(c.values()) + 0.5 * language_id.BUCKETS for x, c in counts.items()}
    for i, t, *_ in rows:
        logs = {x: np.log(docs[x] / sum(docs.values())) + sum(np.log((c.get(bucket_of(g), 0) + 0.5) / every[x]) for g in plain_grams(t)) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_sharding_query(spark, tmp_path):
    """op8_sharding on a table with nulls, copies and long texts: sizes, checksums and the law."""
    texts = [None, "", "é" * 40, "a" * 200_000, *["same"] * 30, *[made(i) for i in range(30)]]
    rows = [(None if i == 7 else i, t, "en", "s", 1, "x", "y", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path)).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_pipeline(spark, small):
    import corpus_pipeline
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = entry.queries()["pipeline"](spark, small).collect()
    ids = {r["doc_id"] for r in out}
    kept = near_dedup.drop_near_copies(exact_dedup.drop_copies(language_id.keep_identified(docs)))
    assert ids == {r["doc_id"] for r in kept.select("doc_id").collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0


def test_pieces_are_held(tokenizer_paths):
    """200 thousand pieces that come again are not encoded again, and a state holds its own arcs."""

    class Counted(byte_bpe.Transducer):
        def encode_piece(self, piece):
            asked.append(piece)
            return [1, 2]

    asked = []
    pieces = byte_bpe._Pieces(Counted({bytes((i,)): i for i in range(256)}))
    for _ in range(3):
        for i in range(200_000):
            pieces[f"{i:012d}"]
    assert len(asked) == 200_000
    t = byte_bpe.Transducer(byte_bpe.load_ranks(tokenizer_paths[1]))
    want = [t.encode_piece(w) for w in (b" the", b" there", b"zqzq")]
    assert t.made == sum(len(x) - 1 for x in t.arcs) > 0
    t.made = byte_bpe.MAX_ARCS + 1  # the table starts afresh
    assert [t.encode_piece(w) for w in (b" the", b" there", b"zqzq")] == want and 0 < t.made < 20
