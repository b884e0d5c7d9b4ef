"""The ten operators against brute force, on small tables with every odd case."""

import base64
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from metrolith.llm import bpe, chat, decontaminate, html, language, licenses, neardup, quality, queries, substrings, urlfilter
from metrolith.llm._spark import plus
from metrolith.llm.graph import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def odd_documents(seed=1):
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Ünd", "MIT", "license", "apache", "License", "漢字", "#", "$$"]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i if r.random() < 0.93 else None, r.choice([" ", "\n", "  "]).join(w), r.choice(["en", "fr", None, "??"])))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \t\n", None), (903, "one", "en"), (904, "ONE", "fr"), (905, "a " * 30000, "en"), (906, None, None), (5, rows[5][1], "en"), (5, rows[5][1], "en"), (907, "x\x00y \\<tag> é😀", "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string").repartition(5)
    clash = {c: F.lit("old") for c in ("n_words", "kept", "score", "labels", "ids", "h", "t", "doc", "g", "root", "host", "bits", "__x", "__doc", "__text", "__runs", "runs", "identity", "nameless", "__hits", "__items", "__longest", "hits", "items", "__norm", "__n", "__gate", "__mit", "key", "found", "norm")}
    return df.withColumns(clash)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def ran_empty(spark, f, schema="doc_id long, text string, lang string"):
    assert f(spark.createDataFrame([], schema)).count() == 0


# 1


def test_language(spark, docs):
    r = random.Random(4)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "de": ["der", "ung", "sch", "ei", "ü"], "fr": ["les", "eau", "é", "oi", "que"]}
    made = [(i, " ".join("".join(r.choices(parts[l], k=r.randint(1, 3))) for _ in range(60)), l) for i, l in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    train, test = df.filter("doc_id % 4 <> 1"), df.filter("doc_id % 4 = 1")
    out = language.identify(test.withColumn("truth", F.col("lang")).drop("lang"), train)
    assert out.filter("lang_pred = truth").count() >= 0.95 * test.count()
    odd = language.identify(docs.select("doc_id", "text"), train)
    assert odd.filter("score < 0 or score > 1 or lang_pred is null").count() == 0
    assert {r["lang_pred"] for r in odd.filter("text is null or text rlike '^[^\\\\p{L}]*$'").collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(df, df.filter("false")).collect()} == {"und"}
    ran_empty(spark, lambda e: language.identify(e, train))


def test_language_sample_heeds_copies_and_long_texts(spark):
    made = spark.range(400).selectExpr("concat('text ', id) as text", "'en' as lang")
    copies = spark.range(200000).selectExpr("'the one text' as text", "'en' as lang")
    long = spark.range(3).selectExpr("concat(id, repeat('é', 30000)) as text", "'fr' as lang")
    got = language.sample(made.unionByName(copies).unionByName(long))
    assert Counter(l for l, _ in got) == {"en": 300, "fr": 3} and len(set(got)) == 303
    assert all(len(t) <= language.SAMPLE_BYTES + 2 for _, t in got)


def test_scores_equal_exact_kernel_ridge_regression():
    """With every training text a landmark, the Nystroem features span the whole kernel."""
    import numpy as np

    r = random.Random(5)
    text = lambda parts: " ".join("".join(r.choices(parts, k=3)) for _ in range(12)).encode()
    parts = {"aa": ["the", "and", "er"], "bb": ["der", "ung", "sch"], "cc": ["les", "eau", "oi"]}
    pairs = [(l, text(p)) for l, p in parts.items() for _ in range(8)]
    names, kernel = language.train(pairs, landmarks=8)
    grams = lambda t: {t[i : i + n].lower() for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    every = set().union(*(grams(t) for _, t in pairs))

    def k(a, b):
        x, y = grams(a) & every, grams(b) & every
        return len(x & y) / np.sqrt(len(x) * len(y)) + 1  # the constant is the intercept's

    train, test = [t for _, t in pairs], [text(p) for p in parts.values() for _ in range(3)]
    gram = np.array([[k(a, b) for b in train] for a in train])
    y = np.array([[float(l == n) for n in names] for l, _ in pairs])
    want = np.array([[k(a, b) for b in train] for a in test]) @ np.linalg.solve(gram + language.RIDGE * np.eye(len(train)), y)
    import pickle

    assert pickle.loads(pickle.dumps(kernel)).score(*language._joined(test)) == pytest.approx(want, abs=2e-3)


# 2


def small_ranks(tmp_path):
    ranks = {bytes((i,)): i for i in range(256)}
    for k, t in enumerate([b"th", b"the", b" t", b"he", b"in", b"ing", b" the", b"w1", b"w2", b"aa", b"aaaa", "é".encode(), b"er", b"ere", b"there"]):
        ranks[t] = 256 + k
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(n).encode() for t, n in ranks.items()))
    return path, ranks


def test_transducer_equals_merging(tmp_path):
    _, ranks = small_ranks(tmp_path)
    r, t = random.Random(3), bpe.Transducer(ranks, max_bytes=30000)
    for _ in range(3000):
        s = "".join(r.choice(["t", "h", "e", "r", "in", "g", "a", " ", "é", "w1"]) for _ in range(r.randint(1, 30))).encode()
        assert list(t.encode(s)) == [ranks[x] for x in bpe.merge(ranks, s)]
    for a in ranks:
        for b in r.sample(sorted(ranks), 40):
            assert t.fits(a, b) == (bpe.merge(ranks, a + b) == [a, b])
    assert len(t.encode(b"a" * 50000)) == 12500


def test_utf8_stream_takes_any_cut():
    raw = "aé漢😀z".encode() * 3
    for step in range(1, 8):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + s.finish() == raw.decode()


def test_utf8_stream_replaces_broken_bytes_as_python_does():
    r = random.Random(6)
    parts = ["a".encode(), "é".encode(), "漢".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe6\xbc", b"\xf0\x9f\x98", b"\x80", b"\xed\xa0\x80", b"\xe0\x80", b"\xc0\xaf", b"\xf5"]
    for _ in range(2000):
        raw, step = b"".join(r.choice(parts) for _ in range(r.randint(0, 9))), r.randint(1, 5)
        s = bpe.Utf8Stream()
        assert "".join(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + s.finish() == raw.decode("utf-8", "replace"), (raw, step)


def test_transducer_tables_stay_within_their_bytes():
    import tracemalloc

    P = pytest.importorskip("public_tokenizers")
    assert P
    path, pattern = queries.tokenizer()
    raw, r = open(path, "rb").read(), random.Random(2)
    codec = bpe.Codec(raw, pattern)
    word = lambda: "".join(chr(r.choice([r.randint(97, 122), r.randint(0x400, 0x4FF)])) for _ in range(r.randint(3, 20)))
    pieces = codec.pieces
    pieces.known.half, pieces.transducer.half = 1 << 20, 1 << 20
    tracemalloc.start()
    for _ in range(3):
        codec.encode(" ".join(word() for _ in range(2000)))
    now, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert pieces.transducer.old.moves and pieces.known.old and now < 9 * (1 << 20)


def test_states_of_a_long_run_of_texts_are_made_once():
    """Texts that come again ask for no move anew, in a worker whose states take more than 64 MB."""
    path, pattern = queries.tokenizer()
    raw, r = open(path, "rb").read(), random.Random(4)
    t = bpe.Codec(raw, pattern).pieces.transducer
    made = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(5, 10))).encode() for _ in range(170000)]
    first = [t.encode(w) for w in made]
    assert t.now.bytes > 64 << 20
    asked, move = Counter(), t.move
    t.move = lambda *a: asked.update(n=1) or move(*a)
    assert [t.encode(w) for w in made] == first and asked["n"] == 0


def test_bpe(spark, docs, tmp_path):
    path, ranks = small_ranks(tmp_path)
    out = bpe.encode(docs, str(path), r"\S+|\s+", digest=True)
    want = []
    for d, text, _ in odd_documents():
        ids = [ranks[p] if (p := m.encode()) in ranks else None for m in re.findall(r"\S+|\s+", text or "")]
        ids = [x for m, one in zip(re.findall(r"\S+|\s+", text or ""), ids, strict=True) for x in ([one] if one is not None else [ranks[y] for y in bpe.merge(ranks, m.encode())] if len(m) < 400 else [])]
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, str(path), r"\S+|\s+").drop("text"), str(path))
    assert rows(back, "text") == sorted(((t or "",) for _, t, _ in odd_documents()), key=str)
    ran_empty(spark, lambda e: bpe.encode(e, str(path), ".", digest=True))


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path, pattern = queries.tokenizer()
    ranks = bpe.load_ranks(open(path, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(open(path, "rb").read(), pattern)
    for _, t, _ in odd_documents():
        assert codec.encode(t or "") == enc.encode_ordinary(t or "")


# 3


def brute_repeats(docs, size):
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    words = [((0, d) if d is not None else (1, signed(t or "")), re.findall(SPACED, t or "")) for d, t, *_ in docs]
    first: dict = {}
    for d, w in words:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, ((2, 0), 0)), (d, s))
    out = []
    for (d, w), (i, *_) in zip(words, docs, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (d, s):
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,anchor", [(20, 8), (4, 2), (600, 8)])
def test_substrings(spark, docs, size, anchor):
    out = substrings.digests(substrings.dedup_substrings(docs, size, anchor))
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(odd_documents(), size)
    ran_empty(spark, substrings.dedup_substrings)


def test_a_frequent_anchor_is_dealt_to_many_groups(spark):
    r = random.Random(9)
    line, word = " ".join(f"boiler{i}" for i in range(19)), lambda: f"v{r.randrange(10**6)}"
    made = [(i, " ".join([line, *(word() for _ in range(25))]), "en") for i in range(400)]
    made += [(1000 + i, made[i * 7][1], "en") for i in range(20)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    size = 1 << 10  # bytes of a group
    assert 0 < len(substrings.hot_prefixes(df, 20, 8, size, 10**5)) <= 40
    groups, hot = Counter(), spark.sparkContext.broadcast(substrings.hot_prefixes(df, 20, 8, size, 10**5))
    for r_ in df.select("doc_id", F.lit(1).cast("long").alias("h"), F.lit(False).alias("nameless"), "text").mapInArrow(lambda it: substrings._split(it, 8, 20, 8, hot), "g long, doc long, text long, start long, n long, rows binary").filter("g is not null").collect():
        groups[r_["g"]] += len(r_["rows"])
    assert max(groups.values()) < 0.05 * sum(groups.values())
    out = substrings.digests(substrings.dedup_substrings(df, 20, 8, size))
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(made, 20)


def test_the_last_step_of_substrings_holds_little(spark, docs):
    """One Python step after the join, and a large batch leaves it in small ones; the digests are those of `kept`."""
    out = substrings.digests(substrings.dedup_substrings(docs, 20))
    assert re.split(r"\bJoin\b", out._jdf.queryExecution().optimizedPlan().toString())[0].count("MapInArrow") == 1
    made = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["a\tb  c " + "word " * 200] * 4999 + [None], "runs": [[]] * 4998 + [[{"start": 1, "n": 2}], None]})
    sent, joined = {"bytes": 0, "rows": 0}, []
    for b in substrings._cleared(iter([made]), "runs", "text", 2):
        sent = {"bytes": max(sent["bytes"], b.column(b.schema.get_field_index("kept")).nbytes), "rows": sent["rows"] + len(b)}
        joined += b.select(["doc_id", "n_words", "n_removed"]).to_pylist()
    assert sent["bytes"] < 2 << 20 and sent["rows"] == 5000
    assert [tuple(x.values()) for x in joined[-3:]] == [(4997, 203, 0), (4998, 203, 3), (4999, 0, 0)]
    kept = ["", " \t", " a\x0bb\u00a0c\x1cd \r\n e\x00\x85f\u3000\U0001d7d8 ", "\x0c x  y"]
    df = spark.createDataFrame([(i, 0, 0, k) for i, k in enumerate(kept)], "doc_id long, n_words long, n_removed long, kept string")
    assert [r["kept_sha256"] for r in substrings.digests(df).orderBy("doc_id").collect()] == [sha(" ".join(re.findall(SPACED, k))) for k in kept]


# 4


def test_urls(spark):
    made = ["http://A.Example.org/es/x?q", "https://b.com/fr/", "https://b.com/de/1#f", "x", None, "", "ftp://org", "http://cheap-pills.example.net/a", "http://m.cheap-pills.example.net", "://x.org/", "http://notorg/", "http://example.org/en/12", "a\nb://h.com/de/\nq"] * 2
    df = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string").withColumn("rule", F.lit("old"))
    listed = spark.createDataFrame([("cheap-pills.example.net",), ("cheap-pills.example.net",), (None,), ("absent.net",)], "key string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, queries.URL_RULES, listed).collect()}
    for i, u in enumerate(made):
        host = re.split(r"[/?#]", u.split("://", 1)[1])[0].translate(LOW) if u and "://" in u else ""
        path = re.split(r"[?#]", u.split("://", 1)[1])[0][len(host) :] if u and "://" in u else ""
        fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fit)[1:]) if fit else (None, "block" if host == "cheap-pills.example.net" or host.endswith(".cheap-pills.example.net") else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    ran_empty(spark, lambda e: urlfilter.filter_urls(e, queries.URL_RULES, listed), "page_id long, url string")


@pytest.mark.parametrize("bits,keys,shard,most", [(2, 3000, 1 << 18, 4 << 20), (2, 3000, 100, 200), (10, 2_400_000, 1 << 18, 1 << 20)])
def test_cascade_is_exact(spark, monkeypatch, bits, keys, shard, most):
    """Many levels, many shards, several passes, and more than a million listed keys."""
    for name, v in (("BITS", bits), ("SHARD_KEYS", shard), ("PASS_BYTES", most)):
        monkeypatch.setattr(urlfilter, name, v)
    universe = spark.range(keys).select(F.concat(F.lit("k"), "id").alias("key"))
    bad = (F.crc32("key") % 5 == 0) if keys < 10**6 else (F.crc32("key") % 2 == 0)
    found = urlfilter.cascade(universe, universe.filter(bad).unionByName(spark.createDataFrame([("foreign",), (None,)], "key string")))
    said, passes = F.lit(False), found.passes()
    for lo, hi in passes:
        said = said | found.listed(F.col("key"), lo, hi)
    assert len(found.levels) > 2 and (len(passes) > 1) == (most < 4 << 20)
    assert universe.filter(said != bad).count() == 0
    assert keys < 10**6 or universe.filter(bad).count() > 10**6


def test_list_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SHARD_KEYS", 2)
    monkeypatch.setattr(urlfilter, "PASS_BYTES", 30)
    pages = spark.range(60).selectExpr("id as page_id", "concat('http://a', id, '.b', id % 7, '.com/x') as url", "'old' as `new block`")
    listed = spark.createDataFrame([(f"a{i}.b{i % 7}.com",) for i in range(0, 60, 3)] + [("b2.com",)], "key string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages, [], listed).collect()}
    assert [got[i]["verdict"] for i in range(60)] == ["block" if i % 3 == 0 or i % 7 == 2 else "allow" for i in range(60)] and got[0]["new block"] == "old"


# 5


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination(spark, block):
    r = random.Random(7)
    bench = [(str(i), " ".join(r.choice("abcdefghij") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 25])))) for i in range(30)] + [(None, "Q r s t"), ("7", None), ("8", "")]
    made = [(i, " ".join(r.choice("abcdefghij") for _ in range(60)) + " , " + (r.choice(bench)[1] or "") + " x  Q r S T" * r.randint(0, 1)) for i in range(60)] + [(900, None), (901, ""), (None, "q-r-s-t")]
    windows: dict = {}
    words = lambda t: re.findall(ALNUM, (t or "").translate(LOW))
    for i, t in bench:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i or "null")
    want = []
    for d, t in made:
        w, items = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    items |= windows[k]
                    hit[s : s + n] = [True] * n
        want.append((d, len(w), sum(hit), len(items), sha(",".join(sorted(items))), any(hit)))
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("n_hit", F.lit("old")).repartition(3)
    b = spark.createDataFrame(bench, "item_id string, text string")
    assert rows(decontaminate.decontaminate(df, b, block_words=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    assert decontaminate.decontaminate(df, b.filter("false")).filter("contaminated").count() == 0
    ran_empty(spark, lambda e: decontaminate.decontaminate(e, b))


def test_longest_match_and_locations_equal_brute_force(spark):
    r = random.Random(11)
    stock = "s0 s1 s2 s3 s4 s5 s6 s7 s8 s9"
    bench = [(str(i), " ".join([r.choice("ab") for _ in range(r.randint(0, 6))] + [stock] + [r.choice("ab") for _ in range(r.randint(0, 12))])) for i in range(60)]
    made = [(i, " ".join(" ".join([stock] + [r.choice("abc") for _ in range(r.randint(0, 14))]) for _ in range(r.randint(1, 4)))) for i in range(40)]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string"), spans=True).collect()}
    items = [f" {t} " for _, t in bench]
    for d, t in made:
        w = t.split()
        best, hit = 0, [False] * len(w)
        for a in range(len(w)):
            for b in range(a + 10, len(w) + 1):
                if not any(f" {' '.join(w[a:b])} " in x for x in items):
                    break
                best = max(best, b - a)
                hit[a:b] = [True] * (b - a)
        h = got[d]["hits"]
        assert got[d]["longest"] == best and sorted(i for a, b in zip(h[::2], h[1::2], strict=True) for i in range(a, b)) == [i for i, x in enumerate(hit) if x]


def test_longest_match(spark):
    b = spark.createDataFrame([("i", "a b c d e f g h i j k l m n")], "item_id string, text string")
    d = spark.createDataFrame([(1, "z a b c d e f g h i j k l q"), (2, "b c d e f g h i j k l m n o")], "doc_id long, text string")
    assert rows(decontaminate.decontaminate(d, b), "doc_id", "longest", "n_hit") == [(1, 12, 12), (2, 13, 13)]


# 6


def brute_groups(docs, k):
    sets = []
    for _, t, *_ in docs:
        w = re.findall(SPACED, (t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    p = list(range(len(docs)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) or docs[i][0] is not None and docs[i][0] == docs[j][0]:
                p[find(i)] = find(j)
    least: dict = {}
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, *_) in enumerate(docs)], key=str)


def test_documents_of_several_texts_lose_no_link(spark):
    r = random.Random(12)
    text = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 99)) for _ in range(40))
    a, b, c = text(), text(), text()
    near = a.replace(a.split()[39], "z", 1)
    made = [(5, a), (5, b), (8, near), (3, c), (20, c), (20, b + " y"), (30, None), (30, text()), (31, ""), (None, c), (None, text()), (2**62 + 5, near), (-9, "one"), (40, "ONE"), (50, text())]
    out = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3), 2)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(made, 2)


def test_a_large_cluster_is_compared_by_size(spark):
    """Every text shares a band with others, few are linked: tasks of sets too different in size are not made."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(400)]
    made = [(i, " ".join(base[: r.randint(40, 400)])) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    out = neardup.near_duplicates(df, 2, block_docs=20)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(made, 2)
    texts = df.selectExpr("doc_id as node", "0L as root", "size(split(text, ' ')) - 1L as n", "text as t")
    pairs = neardup._dealt(texts, 80, 20).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert pairs < 0.75 * 300 * 299 / 2


@pytest.mark.parametrize("k,block", [(2, 1024), (5, 3)])
def test_near_duplicates(spark, docs, k, block):
    out = neardup.near_duplicates(docs, k, 80, block_docs=block)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(odd_documents(), k)
    ran_empty(spark, neardup.near_duplicates)


def test_superminhash_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    for share in (0, 150, 270):
        b = np.concatenate([a[:share], r.integers(0, 2**63, 300 - share).astype(np.uint64)])
        sig = neardup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
        assert abs((sig[0] == sig[1]).mean() - share / (600 - share)) < 0.1
    one = neardup.superminhash(a[:1], np.zeros(1, np.int64), 1)
    assert len(set(one[0] >> np.uint64(48))) == neardup.SIZE  # the ranks of one element are all different


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (300, 300)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 300: 300}
    assert components(edges.filter("false")).count() == 0


# 7


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 15), (1, 0)])
def test_chat(spark, budget, history):
    r = random.Random(2)
    word = lambda: r.choice(["</turn>", "<turn:user>", "\\", "### Assistant:", "ok", "é\n", "<ctx:x>", "\\<"])
    turns = [(c, t, ("system" if t == 0 and c % 2 else r.choice(["user", "assistant", "a>b"])), None if r.random() < 0.1 else " ".join(word() for _ in range(r.randint(0, 30)))) for c in range(12) for t in range(r.randint(1, 9))]
    turns += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, None, "again"), (4, None, "user", "no turn")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("old")).repartition(3)
    key = lambda x: (x is not None, x if x is not None else 0)
    want = []
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (key(t[1]), (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        want.append((c, len(mine), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)), len(loss), sha(loss)))
    windows = chat.format_windows(df, budget, history)
    assert rows(chat.digests(windows), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=str)
    for w in windows.collect():
        assert w["n_tokens"] <= budget or w["n_turns"] == 1 and w["n_repeated"] == 0
    assert chat.digests(chat.format_windows(df.filter("false"))).count() == 0


def test_system_turn_and_history_are_repeated(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "w " * 10) for i in range(1, 9)]
    windows = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 60, 20).orderBy("window").collect()
    assert len(windows) > 2 and all(w["formatted"].startswith("<ctx:system>be brief") for w in windows[1:]) and all(w["n_repeated"] >= 2 for w in windows[1:])


def test_windows_stay_within_the_budget_if_the_turn_does(spark):
    words = lambda n: " ".join(["w"] * (n - 5))
    for sizes in ([200, 900, 200, 950], [1500, 300, 900, 400, 1000, 60], [90, 90, 90, 700, 340, 100, 1024, 3]):
        turns = [(1, i, "system" if i == 0 else "user", words(max(6, n))) for i, n in enumerate(sizes)]
        got = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
        assert sum(w["n_turns"] for w in got) == len(sizes) and [w["first_turn"] for w in got] == [sum(x["n_turns"] for x in got[:k]) for k in range(len(got))]
        assert all(w["n_tokens"] <= chat.BUDGET or w["n_turns"] == 1 and w["n_repeated"] == 0 and sizes[w["first_turn"]] > chat.BUDGET for w in got), [(w["n_tokens"], w["n_turns"]) for w in got]


def test_spans_are_the_longest_that_fit(spark):
    """Against a plain search: no window could take one more turn with what it repeats."""
    r = random.Random(4)
    turns = [(c, t, "system" if t == 0 and c % 2 else r.choice(["user", "assistant"]), " ".join(["w"] * r.randint(0, 40))) for c in range(20) for t in range(r.randint(1, 25))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for budget, history in ((100, 30), (60, 60), (46, 0)):
        windows: dict = {}
        for w in chat.format_windows(df, budget, history).orderBy("conv_id", "window").collect():
            windows.setdefault(w["conv_id"], []).append(w)
        for c, got in windows.items():
            size = [1 + len(t[3].split()) + 4 for t in turns if t[0] == c]
            for a, b in zip(got, got[1:], strict=False):
                assert a["n_tokens"] + size[b["first_turn"]] > budget
                system = c % 2 == 1
                repeated = list(chat.read_turns(b["formatted"]))[: b["n_repeated"]]
                tail = b["n_repeated"] - (1 if system and repeated and repeated[0][1] == "system" else 0)
                first = b["first_turn"] - tail
                assert sum(size[first : b["first_turn"]]) <= history


def test_tokens_are_counted_by_the_tokenizer(spark):
    pytest.importorskip("public_tokenizers")
    turns = spark.createDataFrame([(1, 0, "user", "Hello there, wörld"), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    codec = bpe.Codec(open(queries.tokenizer()[0], "rb").read(), queries.tokenizer()[1])
    want = sum(len(codec.encode(x)) for x in ("Hello there, wörld", "user", "assistant")) + 8
    assert chat.format_windows(turns, count=bpe.TokenCounter(spark, *queries.tokenizer())).first()["n_tokens"] == want


# 8


def test_html(spark):
    page = '<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>home</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Tea &amp; caf&eacute;</h1><p>First  line\n here.<p><b>Bold</b> end &lt;x&gt;.<br>more</p><form><label>Mail</label><input></form></article><div class="comments"><p>I disagree.</p></div><aside>Related</aside><footer>&copy; x</footer><script>var a="<p>no</p>";</script></body></html>'
    made = [(1, page), (2, None), (3, ""), (4, page.split("<form>")[0]), (5, "<article>" + "<p>long text of words here.</p>" * 5000 + "</article>"), (6, "<" * 200), (7, "<div>" * 3000 + "x")]
    df = spark.createDataFrame(made, "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == got[4]["text"] == "Tea & café\nFirst line here.\nBold end <x>. more"
    assert got[2]["text"] == got[3]["text"] == "" and got[5]["n_chars"] == 5000 * 24 + 4999 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    ran_empty(spark, html.extract, "page_id long, html string")


def test_html_on_held_out_layouts():
    model, wrong, all_ = html.Model(html.labelled_pages()), 0, 0
    for page in html.labelled_pages(100, seed=99):
        nodes, blocks = html.parse(page)
        for n in nodes:
            n.label = n.label if n.label >= 0 else nodes[n.parent].label if n.parent >= 0 else 0
        p = model.marginals(nodes)
        wrong, all_ = wrong + sum((p[k] > 0.5) != bool(nodes[k].label) for k, _ in blocks), all_ + len(blocks)
    assert wrong < 0.07 * all_  # the layouts name parts of the text like parts that are not


#: Pages as common site software lays them out, written by hand; + begins a block to keep, - one to leave out.
LAID_OUT = [
    """<html><head><title>-t</title></head><body class="home single-post"><div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title">-My garden blog</p></div>
    <nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href=/>-Home</a></li><li><a href=/about>-About</a></li></ul></nav></header>
    <div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">+Growing tomatoes on a balcony</h1></header>
    <div class="entry-content"><p>+Tomatoes need six hours of sun and a deep pot, more than most people think.</p><figure class="header-image"><img src=a><figcaption>+Two pots in June</figcaption></figure><h2>+Water</h2><p>+Water them in the morning, never on the leaves.</p><ul><li>+Use rain water where you can</li><li>+Feed every second week</li></ul></div></article>
    <div id="comments" class="comments-area"><h2>-2 thoughts</h2><ol class="comment-list"><li class="comment"><p>-Great advice, thank you so much for this!</p></li></ol></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget"><h2>-Recent posts</h2><ul><li><a href=/1>-Basil in winter</a></li></ul></section></aside><footer id="colophon" class="site-footer"><div>-Proudly powered by a press</div></footer></div></body></html>""",
    """<html><body><div class="mw-page-container"><div id="mw-navigation"><div class="menu"><ul><li><a href=/>-Main page</a></li><li><a href=/r>-Random page</a></li></ul></div></div>
    <div id="content" class="body" role="main"><h1 id="firstHeading">+Heron</h1><div id="bodyContent"><div class="content-text"><p>+Herons are long-legged <a href=/b>birds</a> of fresh water and coasts.</p><div id="toc" class="toc" role="navigation"><ul><li><a href=#1>-1 Habits</a></li><li><a href=#2>-2 Food</a></li></ul></div><h2><span>+Habits</span></h2><p>+They stand still for a long time and strike at fish.</p><table class="infobox"><tr><th>+Weight</th><td>+Two kilograms</td></tr></table><section id="related-work"><h2>+Related species</h2><p>+The bittern is a near relative that hides in reeds.</p></section></div></div></div>
    <div id="footer" role="contentinfo"><ul><li>-This page was last edited in May.</li></ul></div></div></body></html>""",
    """<html><body><div class="cookie-consent-banner" role="dialog"><p>-We and our partners use cookies.</p><button>-Accept</button></div><header class="global-header"><a href=/>-Daily News</a><form class="search-form"><input><button>-Search</button></form></header>
    <main><article class="article"><h1>+Bridge opens after three years</h1><div class="article-meta"><span>+By a staff writer</span></div><div class="article-body"><p>+The new bridge over the river was opened to traffic on Monday morning.</p><div class="ad-slot"><p>-Buy a new car today</p></div><p>+Hundreds of people walked across it before the first cars came.</p><div class="newsletter-signup"><p>-Get our newsletter in your inbox</p><form><input><button>-Sign up</button></form></div><div class="side-by-side"><p>+The old bridge had carried two lanes, the new one carries four.</p></div><p hidden>-draft note to the editor</p></div></article>
    <aside class="most-read"><h2>-Most read</h2><ol><li><a href=/x>-Storm warning for the coast</a></li><li><a href=/y>-Council votes on budget</a></li></ol></aside></main><footer><p>-Copyright Daily News</p><nav><a href=/t>-Terms</a></nav></footer></body></html>""",
    """<html><body><div class="document"><div class="sphinxsidebar" role="navigation"><h3>-Table of contents</h3><ul><li><a href=a>-Install</a></li></ul></div><div class="documentwrapper"><div class="body" role="main"><section id="comments-policy"><h1>+Writing comments in the code</h1><p>+A comment says why a line is there and not what it does.</p><div class="highlight"><pre>+x = 1  # why</pre></div><p>+Where <math><mi>n</mi><mo>+</mo><mn>1</mn></math> lines follow, leave one empty.</p><div class="admonition note"><p>+Old code need not be changed.</p></div></section></div></div></div><div class="footer">-Created with a generator.</div></body></html>""",
    """<html><body><div id="header"><a href=/>-Tools shop</a></div><div id="nav"><a href=1>-Hammers</a> <a href=2>-Saws</a></div><div id="main"><div class="post" id="search-results-3"><h2>+How to choose a saw</h2><p>+Look at the teeth first: few large ones cut fast, many small ones cut clean.</p><blockquote><p>+A sharp saw does not need force.</p></blockquote><p>+Keep it dry and oil the blade twice a year.</p></div><div class="share-buttons"><a href=f>-Share</a> <a href=g>-Post</a></div><div class="related-posts"><h3>-You may also like</h3><a href=h>-Five hammers compared</a></div></div><div id="footer">-Copyright Tools shop</div></body></html>""",
]


def test_html_on_pages_laid_out_by_hand():
    model, right, kept, all_ = html.Model(html.labelled_pages()), 0, 0, 0
    missed = []
    for page in LAID_OUT:
        out = html.main_text(page, model).split("\n")
        want = [s for _, s in html.parse(page)[1] if s[0] == "+"]
        right, kept, all_ = right + sum(x in want for x in out), kept + len([x for x in out if x]), all_ + len(want)
        missed += [x for x in want if x not in out] + [x for x in out if x and x not in want]
    assert right / kept >= 0.9 and right / all_ >= 0.9, (right, kept, all_, missed)
    assert not any("draft" in html.main_text(p, model) for p in LAID_OUT) and "n + 1" not in html.main_text(LAID_OUT[3], model) and "n+1 lines" in html.main_text(LAID_OUT[3], model)


def test_marginals_equal_all_labellings():
    import itertools
    import math

    r, model = random.Random(15), html.Model(html.labelled_pages(60))
    tags = ["div", "p", "nav", "article", "ul", "li", "a", "section", "aside", "form", "footer"]

    def tree(depth):
        t = r.choice(tags)
        name = r.choice(["", ' class="comment"', ' id="main content"', ' class="zzz"'])
        return f"<{t}{name}>{'word ' * r.randint(0, 9)}{''.join(tree(depth + 1) for _ in range(r.randint(0, 2))) if depth < 3 else ''}</{t}>"

    for _ in range(25):
        nodes, _ = html.parse(tree(0))
        if len(nodes) > 11:
            continue
        total, mine = 0.0, [0.0] * len(nodes)
        for y in itertools.product((0, 1), repeat=len(nodes)):
            score = model.prior[y[0]]
            for i, n in enumerate(nodes):
                score += sum(model.unary[f][y[i]] for f in html.features(n) if f in model.unary)
                score += y[i] * max(-html.NAME_WEIGHT, min(html.NAME_WEIGHT, sum(model.word.get(w, 0.0) for w in n.names)))
                if i:
                    score += model.pair[html.group(n), y[n.parent]][y[i]]
            p = math.exp(score)
            total += p
            mine = [m + p * v for m, v in zip(mine, y, strict=True)]
        assert model.marginals(nodes) == pytest.approx([m / total for m in mine], rel=1e-6)


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    model = html.Model(html.labelled_pages(60))
    for one in ("<div>", "<div></x>", "<b><a>", "<li>", "<p><table>"):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            html.main_text(one * n + "x", model)
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.02), one


# 9


def test_quality(spark, docs):
    def base(t):
        w = re.findall(SPACED, t or "")
        n, hit = len(w), [False] * len(w)
        c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        for i in range(n - 2):
            if c[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [True] * 3
        lines = [x for x in (t or "").split("\n") if re.search(SPACED, x)]
        return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(hit), n < 50 or 100 * sum(hit) > 50 * n

    out = quality.quality(docs)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted([(d, *base(t)) for d, t, _ in odd_documents()], key=str)
    assert out.filter("kept and base_failed").count() == 0
    ran_empty(spark, quality.quality)


def brute_bits(made):
    """Bits a word of each text, by a plain modified Kneser-Ney model of the texts of the other fold."""
    import numpy as np

    fold = lambda t: int(quality._keys([t.encode()], np.zeros(1, np.int64))[0]) & 1
    words = [re.findall(ALNUM, t.translate(LOW)) for _, t, _ in made]
    folds = [fold(t) for _, t, _ in made]
    total = Counter(x for w in words for x in w)
    vocab = {x for x, n in total.items() if n > 1}
    name = lambda x: x if x in vocab else "<rare>"
    out = []
    for w, f in zip(words, folds, strict=True):
        pairs, before, follow, count = Counter(), Counter(), {}, Counter()
        for other, g in zip(words, folds, strict=True):
            if g != f:
                pairs.update(zip(map(name, other), map(name, other[1:]), strict=False))
        for (u, v), n in pairs.items():
            before[v] += 1
            count[u] += n
            follow.setdefault(u, []).append(n)
        d = quality.discounts(np.array([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
        e = quality.discounts(np.array([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)]))
        kinds, rare = sum(before.values()), Counter(x for o, g in zip(words, folds, strict=True) if g != f for x in o if x not in vocab)
        left = sum(e[min(n, 3)] for n in before.values()) / kinds
        bits = 0.0
        for u, v in zip(w, w[1:], strict=False):
            a, b = name(u), name(v)
            low = max(0, before[b] - e[min(before[b], 3)]) / kinds + left / (1 << quality.ID_BITS)
            n = pairs[a, b]
            p = (max(0, n - d[min(n, 3)]) + sum(d[min(x, 3)] for x in follow[a]) * low) / count[a] if count[a] else low
            if b == "<rare>":
                p *= (rare[v] + 0.5) / (sum(rare.values()) + 0.5 * quality.CLASSES)
            bits -= np.log2(p)
        out.append(bits / max(1, len(w) - 1))
    return out


def test_perplexity_equals_a_plain_kneser_ney_model(spark):
    r = random.Random(3)
    made = [(i, " ".join(r.choice(["the", "of", "tea", "and", "house"]) + r.choice(["", "s", "ing", f"x{r.randint(0, 30)}"]) for _ in range(r.randint(0, 90))), "en") for i in range(40)]
    made += [(100 + i, made[i][1], "en") for i in range(3)]
    got = {r["doc_id"]: r["bits"] for r in quality.quality(spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert [got[d] for d, *_ in made] == pytest.approx(brute_bits(made), abs=1e-4)


def test_probabilities_sum_to_one(spark):
    import numpy as np

    r = random.Random(1)
    made = [(i, " ".join(r.choice(["the", "of", "tea", "and", "house"]) for _ in range(60)), "en") for i in range(20)]
    trained = quality.train(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    assert trained.pairs.filter("g >= 0").count() > 1
    m, n = trained.models[0], np.zeros(quality._IDS, np.int64)
    u, counts = int(trained.words.ids.max()), quality.Counts()
    for row in trained.pairs.filter("g >= 0").collect():
        counts.add(*quality._counted(row["x"], row["y"]))
    counts.merge()
    code = counts.codes * quality._BACK & quality._MASK
    mine = code >> quality.ID_BITS == u
    n[code[mine] & (quality._IDS - 1)] = counts.n[0][mine]
    v = np.arange(quality._IDS)
    assert m.count[u] == n.sum() > 0 and np.exp2(-m.bits(np.full(len(v), u), v, n)).sum() == pytest.approx(1, abs=1e-6)


def test_order_of_words_and_repetition_are_judged(spark):
    """Sentences of a small grammar; the same words shuffled, and one word over and over, are rejected."""
    r = random.Random(8)
    names, verbs, things = [f"name{i}" for i in range(150)], [f"verb{i}" for i in range(150)], [f"thing{i}" for i in range(150)]
    text = lambda: " ".join(f"the {(a := r.randrange(150), names[a])[1]} {verbs[(a * 7 + r.randint(0, 2)) % 150]} a {things[(a * 11 + r.randint(0, 2)) % 150]} ." for _ in range(60))
    made = [(i, text(), "en") for i in range(300)]
    salad = []
    for i in range(20):
        w = text().split()
        r.shuffle(w)
        salad.append((1000 + i, " ".join(w), "en"))
    out = quality.quality(spark.createDataFrame(made + salad, "doc_id long, text string, lang string")).filter("not base_failed")
    bad = {r["doc_id"] for r in out.filter("not kept").collect()}
    assert {d for d, *_ in salad} <= bad and len(bad) == len(salad)


@pytest.mark.parametrize("n_junk,copies", [(1, 1), (100, 1), (1, 100)])
def test_quality_rejects_noise_that_is_part_of_the_corpus(spark, n_junk, copies):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["the", "of", "tea", "and", "house", "river"]) + r.choice(["", "s", "ing"]) for _ in range(120))
    noise = lambda: " ".join("".join(chr(r.randint(33, 126)) for _ in range(40)) for _ in range(80))
    made = [(i, text(), "en") for i in range(200)] + [(1000 + i, x, "en") for i, x in enumerate([noise() for _ in range(n_junk)] * copies)]
    out = quality.quality(spark.createDataFrame(made, "doc_id long, text string, lang string")).filter("not base_failed")
    assert {r["doc_id"] for r in out.filter("not kept").collect()} == {d for d, _, _ in made if d >= 1000}
    assert out.filter("doc_id < 1000 and not kept").count() == 0


# 10


def test_licenses(spark, docs):
    phrases = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

    def base(t):
        w, at, labels = re.findall(ALNUM, (t or "").translate(LOW)), [], set()
        for label, p in phrases:
            p = p.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    more = [(1001, "Licensed under the Apache License, Version 2.0. MIT-license, mit LICENSE"), (1002, "GNU General Public License, version 3."), (1003, "submit license"), (1004, "CC BY-NC 4.0")]
    out = licenses.scan(docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("labels", F.lit("old")))
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted([(d, *base(t)) for d, t, *_ in odd_documents() + more], key=str)
    got = {r["doc_id"]: r["labels"] for r in out.filter("doc_id > 1000").collect()}
    assert got == {1001: "apache,apache-2.0,mit", 1002: "gpl,gpl-3.0", 1003: "", 1004: "cc-by-nc"}
    assert out.filter("score < 0 or score > 1").count() == 0 and len(licenses.rules()) > 100
    ran_empty(spark, licenses.scan)


def test_a_generic_line_leaves_every_label(spark):
    def sample(x):
        for a, b in ((r"licen\[cs\]e", "license"), (r"\[a-z0-9\]\+|\[abc\]", "a"), (r"\\S\*|\{0,\d\}\??", ""), (r"\\d|\[1-4\]|\[05\]|\[\^ \]\+", "1"), (r"\w\?| \?", "")):
            x = re.sub(a, b, x)
        while (y := re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)([?+]?)", lambda m: "" if m[3] == "?" else m[1], x)) != x:
            x = y
        return x

    made = [(i, f"It is released under the {sample(e)} now" + f" {k}" * (k not in e), label) for i, (label, _, k, e) in enumerate(licenses.rules()) if label != "license-line"]
    assert len(made) < 900
    made += [(900 + i, f"{v} {x} License.", y) for i, (v, x, y) in enumerate([("released under the", "GNU Lesser General Public", "lgpl"), ("Licensed under the", "ISC", "isc"), ("distributed under the", "BSD", "bsd"), ("Licensed under the", "Mozilla Public", "mpl"), ("Licensed under the", "Eclipse Public", "epl"), ("under a", "Creative Commons", "creative-commons"), ("licensed under the", "Foo Bar", "license-line")])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string, label string")).collect()}
    assert [(t, l, got[i]["labels"]) for i, t, l in made if l not in got[i]["labels"].split(",")] == []
    assert [got[i]["labels"] for i, *_ in made if i >= 900] == ["gpl,lgpl", "isc", "bsd", "mpl", "epl", "creative-commons", "license-line"]
    assert [got[i]["score"] for i, *_ in made if i >= 901] == [0.85, 0.6, 0.65, 0.65, 0.55, 0.2]


def test_scan_equals_a_plain_scan(spark):
    r = random.Random(14)
    table = licenses.rules()
    assert len(table) > 200
    pieces = ["licensed under the", "mit license", "apache license version 2 0", "gnu general public license version 3", "or any later version", "all rights reserved", "spdx license identifier", "bsd 3 clause", "mozilla public license", "creative commons attribution", "share alike 4 0", "copyright 2020 acme", "without warranty", "the", "x", "cc by sa 4 0", "proprietary license", "released under the", "permission"]
    made = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(1, 12)))) for i in range(150)]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for d, t in made:
        norm, found = f" {t} ", []
        for label, priority, keyword, expression in table:
            if keyword in norm:
                found += [(-priority, m.start(), -m.end(), label) for m in re.finditer(f"(?<= ){expression}(?= )", norm)]
        seen, labels, best, n = [], {label for label, phrase in licenses.BASE if f" {phrase} " in norm}, 0, 0
        for p, a, b, label in sorted(found):
            if any(x <= a and y >= -b for x, y, _ in seen):
                continue
            stands = not any(z and x < -b and y > a for x, y, z in seen)
            seen.append((a, -b, stands))
            if stands:
                labels, best, n = labels | {label}, max(best, -p), n + 1
        assert (got[d]["labels"], got[d]["n_detections"]) == (",".join(sorted(labels)), n), t


def test_every_gate_lets_its_rules_through():
    for label, _, keyword, expression in licenses.rules():
        sure = expression
        while (cut := re.sub(r"\(\?:[^()]*\)(\?|\{0)", "", sure)) != sure:
            sure = cut
        assert re.compile(expression) and any(g.strip() in f" {keyword} {sure} " for g in licenses.GATES), (label, expression)


def test_plus_replaces_clashing_names(spark):
    assert plus(spark.createDataFrame([], "a int, N long, b int").schema, "n string").names == ["a", "b", "n"]
