"""Operators for training text against brute force on small and awkward tables."""

import hashlib
import random
import re
import time
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.llm import bpe, decontaminate, divergence, htmlcrf, kneser, neardup, pii, substrings, toolcalls, toxicity
from hazeline.llm.bwt import repeated_starts
from hazeline.llm.components import components
from hazeline.llm.mainpages import labelled_pages
from hazeline.llm.superminhash import signatures

WORD = re.compile("[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
VOCABULARY = " ".join(f"w{i}" for i in range(60)).split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, node int, __text int, found int"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank, short, long, copied, near-copied and odd texts, with ids that repeat or are missing."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(6)]
    near = [b.replace("w7 ", "x7 ", 1) for b in base[:4]]
    passage = prose(rng, 90)
    rows = [None, "", " \n\t ", "one", "one two three four", "One TWO three four", "é" * 50, "a" * 900, prose(rng, 6000)]
    rows += base + near + base[:3] + [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(4)]
    rows += [f"mail a.b@mail.example.com or 10.0.0.255, 4111 1111 1111 1111 and +49 30 1234567 now {i}" for i in range(3)]
    rows += ["Line one\nLine one\n\n \nLine two\nLine one", "#$%&*|<> " * 40, "x@y x@y.z.w_a@b.c 1.2.3.4.5.6.7.8 999.1.1.1",
             "😀 ünï ÇÖDÉ 'quoted' don't we'll 12 345.6\r\n\x0b\x0c end  ", "0" * 500, "+1 " + "(" * 300, "a.b" * 200 + "@c"]
    ids = list(range(len(rows)))
    ids[4], ids[-1] = None, ids[-2]
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(
        *[F.coalesce(c, F.lit(-1)).alias(c) if c == "doc_id" else F.col(c) for c in columns]).collect())


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_quality_counts(docs, texts, empty):
    want = []
    for i, t in texts:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        times = Counter(tuple(words[j: j + 8]) for j in range(len(words) - 7))
        hit = {j + k for j in range(len(words) - 7) if times[tuple(words[j: j + 8])] > 1 for k in range(8)}
        want.append((-1 if i is None else i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
                     len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)))
    got = by_row(divergence.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed")
    assert got == sorted(want)
    assert divergence.quality(empty).count() == 0


def test_quality_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5])], "p array<double>, q array<double>")
    got = df.select(divergence._distance(F.col("p"), F.col("q"))).first()[0]
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = sum(0.5 * a * np.log2(a / b) for x in (p, q) for a, b in zip(x, m) if a > 0)
    assert got == pytest.approx(np.sqrt(want))


def test_languages_with_longer_codes_stay_apart(spark):
    rng = random.Random(12)
    few = "ANG MGA SA NG NA AY KO MO SIYA AKO".split()
    rows = [(i, prose(rng, 80), "fi-FI" if i % 2 else "FI") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(few) for _ in range(80)), ("fil", "fil_PH")[i % 2]) for i in range(30)]
    rows += [(2000, "short", None), (2001, "short", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["language"]: r["language_words"] for r in divergence.references(docs).collect()}
    assert got == {"fi": 16000, "fil": 2400, "und": 2}
    assert all(r["kept"] for r in divergence.quality(docs).where("doc_id < 2000").collect())


def test_near_duplicates(docs, texts, empty):
    sets = [shingle_set(t) for _, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        r = find(i)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    want = sorted((-1 if d is None else d, len(sets[i]), -1 if least[find(i)] is None else least[find(i)])
                  for i, (d, _) in enumerate(texts))
    found = neardup.near_duplicates(docs)
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2])
                 for r in found.select("doc_id", "n_shingles", "component_id").collect())
    assert got == want
    assert neardup.near_duplicates(empty).count() == 0
    stay = neardup.one_of_each_group(docs)
    assert stay.columns == docs.columns
    groups = {find(i) for i in range(len(sets)) if sets[i]}
    assert stay.where("text rlike '[^ \\\\x09-\\\\x0D]'").count() == len(groups)


def test_a_large_group_of_near_copies_stays_whole(spark):
    rng = random.Random(9)
    base = [rng.choice(VOCABULARY) + str(rng.randrange(1000)) for _ in range(200)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(200)] = f"edit{rng.random()}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in range(600):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in range(600)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.sort(pool[:300]), np.sort(pool[100:400])]  # similarity 0.5
    sig = signatures(np.concatenate(sets), np.array([0, 300, 600]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06
    assert (signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_sketch_loses_less_than_banding():
    least, n = 0.85 - neardup.SLACK, neardup.BANDS * neardup.ROWS
    lost = sum(comb(n, i) * 0.85 ** i * 0.15 ** (n - i) for i in range(n) if i / n < least)
    assert lost < (1 - 0.85 ** neardup.ROWS) ** neardup.BANDS


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 99)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (300, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(100)}, **{i: 200 for i in range(200, 231)}}


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return path, tokenizers.PATTERN, ranks, tiktoken.Encoding(
        "own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(docs, texts, empty, encoding):
    path, pattern, _, library = encoding
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_row(bpe.tokenized(docs, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    assert bpe.tokenized(empty, path, pattern).count() == 0


def test_splitting_and_merging_of_random_signs(encoding):
    _, pattern, ranks, library = encoding
    fast, slow = bpe.Encoder(bpe.Vocabulary(ranks, pattern)), bpe.Encoder(bpe.Vocabulary(ranks, pattern + "|(?!)"))
    assert fast.splitter and not slow.splitter
    rng = random.Random(2)
    signs = "aAéß09٣ \t\n\r\x1c\x85\xa0 　'sltdmrev.,!-😀中문ก²½ǅª"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(600)]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [library.encode_ordinary(t) for t in texts]
    for encoder in (fast, slow):
        found = list(encoder.encode(data, at))
        assert [ids for ids, _ in found] == want
        assert [back for _, back in found] == raw


def test_perfect_hash_is_minimal(encoding):
    keys = bpe._keys(list(encoding[2]))
    numbers = bpe.PerfectHash(keys).numbers(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys)))


def windows_of(items):
    out = {}
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOW))
        k = min(13, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            out.setdefault(tuple(words[i: i + k]), set()).add(item)
    return out


def test_contamination(spark, docs, texts, empty):
    rng = random.Random(6)
    items = [(1, " ".join(texts[9][1].split()[20:60])), (2, "one two"), (3, "ONE"), (4, None), (5, "!!"), (1, prose(rng, 20)),
             (6, " ".join(texts[10][1].split()[:13])), (None, "three four"), (7, " ".join(texts[9][1].split()[20:60]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = windows_of(items)
    want = []
    for i, t in texts:
        words = ITEM_WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for k in {len(w) for w in found}:
            for s in range(len(words) - k + 1):
                if names := found.get(tuple(words[s: s + k])):
                    hit.update(range(s, s + k))
                    ids |= names
        names = sorted(str(x) for x in ids if x is not None)
        want.append((-1 if i is None else i, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                     len(hit) > 0 and 20 * len(hit) >= len(words)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(decontaminate.contamination(docs, benchmark), *columns) == sorted(want)
    assert decontaminate.without_benchmark(docs, benchmark).count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0


def test_page_text(spark):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li>'
            '<li><a href="/b">More</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div><article><h1>A heading &amp; more</h1>'
            '<p><b>First words of it.<br><p>Then   a long paragraph\n of some ordinary words, and it ends here.</p>'
            '<p>Short one.</p></article><section class="comments"><p>I do not agree with this at all.</p></section>'
            '<footer>&copy; someone</footer></body></html>')
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (4, "x", "<div><!-- never closed")]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in htmlcrf.extracted(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    text = "A heading & more First words of it. Then a long paragraph of some ordinary words, and it ends here. Short one."
    assert (1, text, len(text)) in got and (2, "", 0) in got and (3, "", 0) in got and (4, "", 0) in got


def test_text_after_scripts_and_open_heads_stays():
    def texts(page):
        return [b.text for b in htmlcrf.blocks(page)]
    loop = "<script>for(i=0;i<n;i++){f(i)}</script>"
    assert texts(f"<p>one</p>{loop}<p>two</p>") == ["one", "two"]
    assert texts(f"<head>{loop}<script>a='<!-- '</script></head><body><p>two</p>") == ["two"]
    assert texts(f"<p>one<script>a='<!-- '</script><p>two</p><object>{loop}</object><p>three") == ["one", "two", "three"]
    assert texts("<html><head><title>T <b</title><meta x><body><p>one</p>") == ["one"]
    assert texts("<head><title>T</title><link a><div>one</div>") == texts("<head><style>p{}</style>one") == ["one"]
    assert texts("<p>one<!--> two<p>three<script>never closed <p>four") == ["one two", "three"]


def test_formulas_drawings_and_objects_stay():
    def texts(page):
        return [b.text for b in htmlcrf.blocks(page)]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>") == ["a x = 2 b"]
    assert texts("<p>a<svg><title/><script/><g><text>label</text></g></svg> b</p>") == ["a label b"]
    assert texts("<p>a <object data=x><param name=y>fallback</object> <canvas>drawn</canvas></p>c") == ["a fallback drawn", "c"]
    assert texts("<p>a <svg><path d='M0'/><div>b</div>c") == ["a", "b", "c"]


def test_pages_take_linear_time():
    chain = htmlcrf.trained(labelled_pages(20, 3), epochs=1)
    forms = ["<a " * 100_000, "<!" * 100_000, "<a " * 100_000 + "\"x\" ' >", "<a \"x\" '" * 60_000 + ">", "<a b='" * 100_000,
             "<div class=content>x" * 40_000, "".join(f"<t{i % 3000} class=n{chr(97 + i % 26)}{chr(97 + i % 25)}>x" for i in range(40_000)),
             "<center>" * 30_000 + "<li>x</li></i>" * 30_000, "<blockquote>" * 30_000 + "</x>y<p>z</p>" * 30_000, "<svg>" * 100_000 + "x"]
    for form in forms:
        begin = time.monotonic()
        htmlcrf.main_text(chain, form)
        assert time.monotonic() - begin < 10, form[:30]


def test_block_labels_on_pages_not_seen():
    chain = htmlcrf.trained(labelled_pages(200, 1))
    pages = [htmlcrf.blocks(page) for page in labelled_pages(80, 2)]
    pairs = [(b.label, got) for page in pages for b, got in zip(page, chain.labels(page))]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def test_viterbi_equals_trying_all_labels():
    chain = htmlcrf.trained(labelled_pages(30, 3), epochs=1)
    page = htmlcrf.blocks(labelled_pages(1, 4)[0])[:8]
    _, s = chain.scores(page)

    def score(labels):
        return sum(b * x for b, x in zip(labels, s)) + sum(chain.steps[a][b] for a, b in zip(labels, labels[1:]))
    best = max((score(labels) for n in range(1 << len(page)) if (labels := [n >> i & 1 for i in range(len(page))])))
    assert score(chain.labels(page)) == pytest.approx(best)


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.randrange(5, 60)).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "Rotten,", "WRETCH."])
            words.append("women" if rng.random() < 0.8 else "men")
        elif rng.random() < 0.2:
            words.append("men")
        rows.append((i, " ".join(words), 1))
        labels.append((i, None, int(toxic)))
    rows += [(900, None, 1), (901, "", 1), (None, "vile", 1), (0, "vile", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    marks = spark.createDataFrame(labels + [(1, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got) and len(got) == 904
    assert toxicity.toxicity(empty, marks.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}
    kept = toxicity.without_toxic(docs, docs, marks)
    assert kept.columns == docs.columns and 904 > kept.count() > 500


def test_counterfactual_term_holds_identity_weights_down():
    rng = np.random.default_rng(4)
    raw = [b"women", b"men"]
    numbers, _ = toxicity.word_numbers(np.frombuffer(b"women men", np.uint8), np.array([0, 9]))
    women, men = numbers.tolist()
    assert raw
    sets, labels = [], []
    for i in range(1500):
        y = i % 3 == 0
        words = set(rng.integers(0, toxicity.BUCKETS, 8).tolist())
        if y and i % 2:
            words.add(77)
        words.add(women if (rng.random() < 0.9) == y else men)
        sets.append(np.array(sorted(words)))
        labels.append(float(y))
    free = toxicity.fitted(sets, np.array(labels), penalty=0.0).weights
    held = toxicity.fitted(sets, np.array(labels), penalty=5.0).weights
    assert abs(held[women] - held[men]) < 0.5 * abs(free[women] - free[men])


def test_repeated_strings_by_merged_transforms():
    rng = random.Random(3)
    for _ in range(40):
        depth = rng.choice([2, 3, 4, 5, 8])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 12))]
        times = Counter(s[i: i + depth] for s in strings for i in range(len(s) - depth + 1))
        want = [[times[s[i: i + depth]] > 1 for i in range(len(s) - depth + 1)] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, depth, rng.choice([5, 30, 1000]))] == want


@pytest.mark.parametrize("most_contents", [4096, 1])
def test_repeated_bytes(docs, texts, empty, most_contents):
    raw = [(t or "").encode() for _, t in texts]
    times = Counter(b[j: j + 200] for b in raw for j in range(len(b) - 199))
    want = []
    for (i, _), b in zip(texts, raw):
        hit = bytearray(len(b))
        for j in range(len(b) - 199):
            if times[b[j: j + 200]] > 1:
                hit[j: j + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1]))
        kept = bytes(x for x, h in zip(b, hit) if not h)
        want.append((-1 if i is None else i, len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    got = by_row(substrings.without_repeats(docs, most_contents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want)
    if most_contents > 1:
        assert substrings.without_repeats(empty).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("c", "1", "sum", '{"b": 2, "a": 1}', []), ("c", "2", "sum", '{"a": 1}', ["1"]), ("c", "3", "sum", "[1]", ["2", "9"]),
        ("c", "4", "sum", '{"a": "x", "b": 1, "z": null}', ["5"]), ("c", "5", "sum", '{"a": 1, "b": 1}', ["4"]),
        ("c", "6", "other", None, None), ("c", "1", "sum", '{"b": 2, "a": 1}', []), (None, "1", "sum", "{}", []), ("d", "1", "sum", '{"a":1,"b":1}', [])],
        "conv_id string, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("c", "1", "3"), ("c", "1", "4"), ("c", "7", "lost"), ("c", "2", None), (None, "1", "x")],
                                    "conv_id string, call_id string, content string")
    schemas = spark.range(1).select(F.lit("sum").alias("name"), F.expr("map('a', 'BIGINT', 'b', 'BIGINT')").alias("fields"),
                                    F.expr("array('a', 'b')").alias("required"))
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.linked(calls, results, schemas).collect()}
    assert {k: (r["status"], r["level"]) for k, r in got.items()} == {
        ("c", "1"): ("linked", 0), ("c", "2"): ("linked", 1), ("c", "3"): ("open", 2), ("c", "4"): ("cyclic", None),
        ("c", "5"): ("cyclic", None), ("c", "6"): ("open", 0), ("c", "7"): ("orphan", None), ("d", "1"): ("open", 0)}
    assert got["c", "1"]["json"] == '{"arguments":{"a":1,"b":2},"id":"1","level":0,"name":"sum","result":"3"}'
    assert got["c", "1"]["problems"] == [] and got["c", "2"]["problems"] == ["missing field b"]
    assert got["c", "3"]["problems"] == ["unknown need", "no JSON object"]
    assert sorted(got["c", "4"]["problems"]) == ["unknown field z", "wrong type of a"]
    assert got["c", "6"]["problems"] == ["no JSON object"]


def test_language_model(spark, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60), "en" if i % 2 else None, 1) for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("#%&QXZ!?~") for _ in range(300)), "en", 1) for i in range(5)]
    rows += [(300, None, "en", 1), (301, "", None, 1), (302, "short", "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(200, 0, 0), (None, 1, 0), (5, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser.quality(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(120)) and not any(got[200 + i]["kept"] for i in range(5))
    assert got[300]["perplexity"] is None and not got[300]["kept"] and got[302]["kept"]
    assert kneser.quality(empty, labels).count() == 0 and kneser.quality(docs, labels.limit(0)).where("kept").count() == 126


def kneser_ney_perplexity(trusted, text, order=4):
    """Interpolated modified Kneser-Ney by its textbook recursion over dictionaries."""
    counts = Counter(p[i: i + order] for t in trusted for p in ["\n" * (order - 1) + t] for i in range(len(t)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(k, c):
        n = Counter(levels[k].values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return (0.5, 0.75, 0.9)[min(c, 3) - 1]
        i = min(c, 3)
        return min(max(i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i], 0.05), i - 0.05)

    def share(gram):
        if not gram:
            return 1 / 0x110000
        k, context = len(gram), gram[:-1]
        after = {g: c for g, c in levels[k].items() if g[:-1] == context}
        if not after:
            return share(gram[1:])
        total, c = sum(after.values()), after.get(gram, 0)
        spared = sum(discount(k, x) for x in after.values())
        return ((c - discount(k, c)) if c else 0) / total + spared / total * share(gram[1:])

    padded = "\n" * (order - 1) + text
    return 2 ** (-sum(np.log2(share(padded[i: i + order])) for i in range(len(text))) / len(text))


@pytest.mark.parametrize("shard_grams, slice_bytes, group_slices", [(65_536, 4_000_000, 4_096), (40, 300, 2)])
def test_perplexity_equals_brute_force(spark, monkeypatch, shard_grams, slice_bytes, group_slices):
    """With one shard and slice, and with many shards, slices and groups of slices."""
    monkeypatch.setattr(kneser, "SHARD_GRAMS", shard_grams)
    monkeypatch.setattr(kneser, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(kneser, "GROUP_SLICES", group_slices)
    rng = random.Random(9)
    syllables = ["ab ", "abc", "ba", "日本", "é", "c\n", "😀"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + [None, "", "z", "\n\n\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(25)] + [(41, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in kneser.quality(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (pytest.approx(kneser_ney_perplexity(texts[:25], t), rel=1e-5) if t else None)


def test_language_model_scores_a_very_long_text_whole(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en") for i in range(40)]
    tail = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(100_000))
    rows += [(50, prose(rng, 1_500_000), "en"), (51, prose(rng, 50_000) + tail, "en"), (52, prose(rng, 60), "en"), (52, prose(rng, 60), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    got = [(r["doc_id"], r["n_chars"], r["kept"]) for r in kneser.quality(docs, labels).collect()]
    assert sorted(got) == sorted((i, len(t), i != 51) for i, t, _ in rows)


def test_language_model_tells_code_points_apart(spark):
    from hazeline.llm.kneser import CODE_POINTS, KEYS, ORDER, costs, perplexities, sliced

    rng = random.Random(7)
    clean = ["".join(rng.choice(["привет ", "мир ", "слово ", "язык "]) for _ in range(40)) for _ in range(40)]
    # each sign by another with the same remainder of its lead byte and the same length: one symbol to a folded alphabet
    garbled = ["".join(chr(ord(c) ^ rng.randrange(16)) if c > "~" else c for c in t) for t in clean[:10]]
    rows = [(i, t, "ru") for i, t in enumerate(clean)] + [(100 + i, t, "ru") for i, t in enumerate(garbled)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser.quality(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not any(got[100 + i]["kept"] for i in range(10))

    # against one text's sum of costs, and every context's probabilities add up to 1 over all code points
    text = "абв абг 中文 abc abd"
    padded = "\n" * (ORDER - 1) + text
    grams = Counter(tuple(ord(c) for c in reversed(padded[i: i + ORDER])) for i in range(len(text)))
    gram = ", ".join(f"{k} int" for k in KEYS)
    counts = spark.createDataFrame([(*g, c) for g, c in grams.items()], f"{gram}, c bigint")
    signs = sorted({ord(c) for c in text} | {0x1F600})
    context = next(iter(grams))[1:]
    wanted = spark.createDataFrame(sorted({(c, *context) for c in signs} | set(grams)), gram)
    bits = {tuple(r[k] for k in KEYS): r["bits"] for r in costs(wanted, counts).collect()}
    mass = sum(2 ** -bits[c, *context] for c in signs[:-1]) + (CODE_POINTS - len(signs) + 1) * 2 ** -bits[signs[-1], *context]
    assert mass == pytest.approx(1)
    one = perplexities(sliced(spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, lang string")), counts).first()
    assert one["perplexity"] == pytest.approx(2 ** (sum(bits[g] * c for g, c in grams.items()) / len(text)))


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def valid(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def test_personal_data(docs, texts, empty):
    want = []
    for i, t in texts:
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, form) in enumerate(BASE)
                       for m in re.finditer(form, t or "") if valid(kind, m.group()))
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        want.append((-1 if i is None else i, *[sum(f[3] == kind for f in found) for kind, _ in BASE],
                     hashlib.sha256(joined.encode()).hexdigest()))
    got = pii.personal_data(docs)
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)
    assert pii.personal_data(empty).count() == 0
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    rest = [r["text"] for r in clean.collect()]
    assert not any(re.search(form, t or "") and valid(kind, re.search(form, t).group()) for kind, form in BASE[:1] for t in rest)
    assert sum(t is None for t in rest) == 1
    assert clean.where("n_chars <> char_length(text)").count() == 0
    assert any("mail [EMAIL] or [IP], [CARD] and [PHONE] now" in (t or "") for t in rest)


def test_long_secrets_and_addresses_go_whole(spark):
    rng = random.Random(4)
    token = "".join(rng.choice("abcdefghijABCDEFGHIJ0123456789") for _ in range(3000))
    name, label = "n" * 200, "d" * 100
    rows = [(i, f"config: token={token[: 40 + i]} end", "en") for i in range(30)]
    rows += [(50, f"config: token={token} end", "en"),
             (51, f"mail {name} [at] {label}" + "".join(f" [dot] l{i}" for i in range(12)) + " end", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert got[50] == f"secret:8:{8 + 6 + 3000}" and got[51] == f"address:5:{len(rows[-1][1]) - 4}"
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[50] == "config: [SECRET] end" and clean[51] == "mail [ADDRESS] end"


def test_thousands_of_spans_in_one_text(spark):
    """Ten thousand addresses and secrets, base spans that cover wider ones, and context across the borders of chunks."""
    n, part = 10_000, "mail a.b@mail.example.com or token=abcdefgh12345678 and key 😀 token=x@y.example.com now "
    docs = spark.createDataFrame([(1, part * n)], "doc_id bigint, text string")
    begin = time.monotonic()
    row = pii.personal_data(docs).first()
    assert time.monotonic() - begin < 60
    spans = [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in row["spans"].split(","))]
    text = part * n
    assert row["n_email"] == 2 * n and sum(kind == "secret" for kind, _, _ in spans) == n
    assert all(text[a:b] in ("a.b@mail.example.com", "x@y.example.com", "token=abcdefgh12345678") for _, a, b in spans)


def test_span_votes_tell_true_from_false():
    rows = [(0, (1, 1, 1, 1), 500), (0, (1, 0, -1, 1), 20), (4, (1, -1, 1, 1), 60), (4, (0, -1, -1, 0), 80), (4, (0, -1, -1, 1), 10)]
    labels = pii._expected(rows)
    assert labels[0] > 0.9 and labels[2] > labels[3]
    assert pii.fitted([]) == pii.Classifier([0.0] * len(pii.KINDS), [(0.0, 0.0)] * len(pii.LABELERS))
