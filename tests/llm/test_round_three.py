"""Hard negatives, capture index and cross-tokenizer alignment against brute force on small and awkward tables."""

import base64
import gzip
import hashlib
import math
import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hazeline.llm import alignment, captures, divergence, hardneg, toolcalls

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
VECTORS = "vec_id bigint, embedding array<float>, label int, q int, cell string, batch int"
PAGES = "page_id bigint, url string, html string, key string, digest string, file int"
TEXTS = "doc_id bigint, text string, run string, radix int, told string"


# --- hard negatives ---------------------------------------------------------------------------------

def brute_negatives(rows):
    """The contract, pair by pair."""
    least = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        least[vec_id] = min(least.get(vec_id, row), row)
    out = []
    for a, (own, q) in least.items():
        if a % 100:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(q, other)), -2 ** 63), 2 ** 63 - 1), v, label) for v, (label, other) in least.items() if v != a)
        for ps, p, _ in [s for s in scored if s[2] == own][:5]:
            inside = [s for s in scored if s[2] != own and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a, p, r, v, -ps, -s) for r, (s, v, _) in enumerate(inside, 1)]
    return sorted(out)


def vectors(rng, n, dims, spread):
    rows = []
    for i in range(n):
        centre = np.random.RandomState(i % 4).rand(dims) if spread else 0
        rows.append([i, (rng.normal(size=dims) * 0.2 + centre).round(2).astype(np.float32).tolist(), i % 4 if i % 3 else 1])
    return rows


@pytest.mark.parametrize("dims,spread,scale", [(6, True, 1), (12, False, 1), (3, True, 2.0 ** 20), (3, True, 2.0 ** 30)])
def test_hard_negatives(spark, dims, spread, scale):
    rows = vectors(np.random.RandomState(dims), 420, dims, spread)
    rows = [[i, [x * scale for x in v], label] for i, v, label in rows]
    rows += [[None, [0.1] * dims, 1], [1000, None, 1], [1001, [0.1] * dims, None], [1002, [float("nan")] * dims, 1],
             [1003, [float("inf")] * dims, 1], [1004, [None] * dims, 1], [1100, [0.0] * dims, 2], [1200, [], 3],
             [1300, [0.5], 1], list(rows[100]), [200, rows[5][1], 3], [1005, rows[7][1], 2], [1006, rows[7][1], 2]]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS).repartition(3)
    got = hardneg.mined(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hardneg.mined(df.limit(0)).count() == 0


def test_batches_and_cells_of_any_size_agree(spark, monkeypatch):
    rows = vectors(np.random.RandomState(1), 700, 5, True)
    monkeypatch.setattr(hardneg, "BATCH", 2)
    monkeypatch.setattr(hardneg, "CELL_VALUES", 400)
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS)
    assert sorted(map(tuple, hardneg.mined(df).collect())) == brute_negatives(rows)


def test_reading_stops_before_the_end():
    rng = np.random.RandomState(3)
    rows = np.floor(rng.normal(size=(5000, 3)) * 256)
    cell, anchor = hardneg.Cell(np.arange(5000), rows), np.array([300.0, -200.0, 0.0])
    met = []
    order, scores = cell.best(anchor, lambda t, o, s: bool(met.append(len(o))) or t < np.sort(s)[-5] if len(s) >= 5 else False)
    assert len(order) < 2500 and sorted(scores)[-5:] == sorted(rows @ anchor)[-5:] and met == sorted(met)


# --- capture index ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"https://{rng.choice(['www', 'm', 'Blog'])}.site{i % 5}.example.org/p/{i % 37}?q={i % 3}#top",
             f"<p>{rng.choice(['same', 'other', str(i)])} é</p>" * (i % 4)) for i in range(300)]
    rows += [(None, "http://a.example/", "<p>same é</p>"), (None, None, None), (400, None, ""), (401, "", None),
             (402, "no scheme\r\nX: 1", "<p>1</p>"), (403, "http://long.example/" + "x" * 5000, "y" * 300_000),
             (404, "http://user:pw@h.example:8080/a b", "\r\n\r\nWARC/1.1"), rows[7], (7, rows[7][1], "else"), (-5, rows[9][1], "else")]
    return rows, spark.createDataFrame([(*r, "k", "d", 1) for r in rows], PAGES).repartition(4)


def told(html):
    raw = (html or "").encode()
    return len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute_records(rows, least=0):
    holder = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least and page is not None:
            holder[html or ""] = max(holder.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        other = holder.get(html or "")
        out.append((page, *told(html), *(("response", None) if other is None or other == page else ("revisit", other))))
    return sorted(out, key=str)


def test_records_come_back_through_the_index(pages, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK", 7)
    rows, df = pages
    got = captures.round_trip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_records(rows)
    assert captures.round_trip(df.limit(0)).count() == 0


def test_captures_of_a_url(spark, pages, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK", 3)
    rows, df = pages
    index = captures.archived(df, least=10_000)
    url = rows[9][1]
    same = spark.createDataFrame([("HTTPS://" + url.split("//")[1].split("#")[0].replace("Blog", "blog"),), ("http://nowhere.example/",)], "url string")
    bare = url.split("//")[1].split("#")[0].lower()
    want = sorted((r[0], r[2]) for r in rows if r[1] and "//" in r[1] and r[1].split("//")[1].split("#")[0].lower() == bare)
    got = captures.captures_of(same, index)
    assert sorted((r.page_id, r.payload) for r in got.collect()) == want and len(want) > 1
    keys = df.select(captures.url_key(F.col("url")).alias("key"), "page_id")
    assert captures.look_up(keys, index).where("length <= 0").count() == 0
    small = captures.fetched(captures.look_up(keys, index), index).where("payload_bytes < 10000")
    assert small.where("record_type <> 'response'").count() == 0


def test_files_are_plain_warc(pages):
    rows, df = pages
    index = captures.archived(df)
    system, path = captures._files(index.folder)
    from pyarrow import fs

    data = b"".join(gzip.decompress(open(f.path, "rb").read()) for f in system.get_file_info(fs.FileSelector(path("")))
                    if f.path.endswith(".warc.gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def test_keys_are_reversed_hosts(spark):
    urls = ["http://WWW.Example.org:80/a?b=c#d", "https://u@x.y/", "ftp://h", "plain", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(captures.url_key(F.col("url"))).collect()]
    assert got == ["org,example,www):80/a?b=c", "y,x)/", "h)", "plain", ""]


# --- alignment --------------------------------------------------------------------------------------

AWKWARD = [None, "", " ", "a", "  two  spaces ", "tabs\tand\nlines\r\n\n end", "x▁y", "don't we'll I'M", "ünï ÇÖDÉ 東京 😀👩‍👩‍👧 ①²5 ½",
           "é combining ñ", "<|endoftext|> <s> </s> <unk> <0x41>", "a" * 3000, "ab,cd.ef;gh" * 50, "\x00\x01 nul", "１２ full ｗｉｄｅ",
           "नमस्ते दुनिया สวัสดี", "the cat, the dog; the end.", " no-break space", "((((" * 40 + "x" + "))))" * 40, "1234567890 " * 20]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = "the of and cat dog Überraschung naïve running 42 (see) e.g. don't".split()
    rows = AWKWARD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows += rows[20:24] * 3 + [" ".join(rng.choice(words) for _ in range(20_000))]
    ids = list(range(len(rows)))
    ids[3], ids[-1] = None, ids[-2]
    return list(zip(ids, rows))


def brute_alignment(texts):
    """Whole texts by the libraries, groups from the ends of both, counts in dictionaries."""
    tok = alignment.Tokenizers(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    docs, count, top = [], defaultdict(int), defaultdict(int)
    for doc_id, text in texts:
        links, groups, sizes = defaultdict(int), [], (0, 0)
        if text:
            a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
            raw_a, raw_b, whole = [tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b], (" " + text).encode()
            if b"".join(raw_a) == whole == b"".join(raw_b):
                ends_a, ends_b = np.cumsum([*map(len, raw_a)]).tolist(), np.cumsum([*map(len, raw_b)]).tolist()
                cuts, sizes = sorted(set(ends_a) & set(ends_b)), (len(a), len(b))
                groups = [([], []) for _ in cuts]
                for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
                    for i, end in zip(ids, ends):
                        groups[bisect_left(cuts, end)][side].append(i)
                for left, right in groups:
                    for x in left:
                        for y in right:
                            links[x, y] += 1
        for pair in links:
            count[pair] += 1
        docs.append((doc_id, sizes, groups, links))
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = []
    for doc_id, sizes, groups, links in docs:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((doc_id, *sizes, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
                     sum(n * count[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=str), sorted((*p, n, n == top[p[0]]) for p, n in count.items())


@pytest.mark.parametrize("piece", [4_000_000, 300])
def test_alignment(spark, texts, monkeypatch, piece):
    monkeypatch.setattr(alignment, "SLICE", piece)
    df = spark.createDataFrame([(*t, "r", 1, "t") for t in texts], TEXTS).repartition(3)
    rows, pairs = brute_alignment(texts)
    got = alignment.aligned(df, *FILES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == rows
    assert sorted(map(tuple, alignment.alignment_table(df, *FILES).collect())) == pairs
    assert alignment.aligned(df.limit(0), *FILES).count() == 0
    assert sum(r[1] == 0 for r in rows) == 3  # null, empty, and a sign that B takes for a space


def test_pieces_are_encoded_as_whole_texts_are():
    tok = alignment.Tokenizers(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    rng = random.Random(8)
    signs = list("abzAZ  \n\t'’.,;:-_()[]0159²½éßÇñ東あ한가а́अ◌्▁|#$%<>/\\\"") + [" the", "ing", "'s", "  ", " ", "　", "😀", "‍"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        numbers = tok.numbers([text])[0].tolist()
        if all(tok.whole[x] for x in numbers):
            shown = [side.split("|") for x in numbers for side in tok.groups[x][:-1].split(";")]
            a, b = ([int(i) for pair in shown for i in pair[k].split(",")] for k in (0, 1))
            assert a == tok.a.encode(" " + text, add_special_tokens=False).ids and b == tok.b.encode(text), repr(text)


def test_packing_keeps_numbers():
    for values in ([], [0], [1, 255, 256, 1 << 40], list(range(1000))):
        assert alignment.unpack(alignment.pack(np.array(values, np.int64))).tolist() == values


# --- levels of tool calls ---------------------------------------------------------------------------

def brute_levels(needs):
    known = {}
    while True:
        ready = {k: 1 + max((known[n] for n in mine), default=-1) for k, mine in needs.items()
                 if k not in known and all(n in known for n in mine)}
        if not ready:
            return known
        known |= ready


def graph(rng, n):
    """Chains, branches, several needs, self-needs and cycles."""
    needs = {str(i): {str(j) for j in rng.sample(range(max(0, i - 4), i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))} for i in range(n)}
    needs["7"] |= {"7"}
    needs["20"], needs["21"] = {"21"}, {"20"}
    needs["22"] = {"21"}
    return needs


def test_levels_of_any_graph(spark):
    rng = random.Random(11)
    graphs = {f"g{k}": graph(rng, 60) for k in range(4)} | {"chain": {str(i): {str(i - 1)} if i else set() for i in range(5000)}}
    calls = spark.createDataFrame([(g, c) for g, needs in graphs.items() for c in needs], "conv_id string, call_id string")
    edges = spark.createDataFrame([(g, c, n) for g, needs in graphs.items() for c, mine in needs.items() for n in mine],
                                  "conv_id string, call_id string, need string")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls, edges).collect()}
    assert got == {(g, c): level for g, needs in graphs.items() for c, level in brute_levels(needs).items()}


def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = toolcalls.materialized
    monkeypatch.setattr(toolcalls, "materialized", lambda df, label: rounds.append(label) or real(df, label))
    calls = spark.range(5000).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"))
    edges = spark.range(1, 5000).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"),
                                        (F.col("id") - 1).cast("string").alias("need"))
    assert toolcalls.levels(calls, edges).agg(F.max("level")).first()[0] == 4999
    assert rounds.count("chains") < 20


def test_turns_of_every_role_are_carried(spark):
    turns = spark.createDataFrame([("c", 0, "system", "be kind"), ("c", 1, "user", "hi"), ("c", 2, "assistant", "yes"), ("c", 3, "tool", None),
                                   ("c", 4, None, "?"), (None, 5, "user", "x"), ("c", None, "assistant", "y")],
                                  "conv_id string, turn int, role string, text string")
    plain = {(r.conv_id, r.call_id): r.json for r in toolcalls.plain_turns(turns).collect()}
    assert len(plain) == 5 and plain["c", "c:0"] == '{"role":"system","text":"be kind","turn":0}'
    assert toolcalls.plain_turns(turns).count() == 5
    empty = turns.limit(0)
    calls, results = toolcalls.calls_of(empty)
    assert toolcalls.linked(calls, results, toolcalls.answer_schema(calls)).count() == 0


# --- verdict of the quality rules -------------------------------------------------------------------

def brute_kept(rows):
    """kept of every row by plain counting; rows: (doc_id, text, lang)."""
    space = "\x20\t\n\x0b\x0c\r"

    def words_of(text):
        return [w for w in re.split(f"[{space}]+", text) if w]

    def classes(text):
        counts = [0] * 6
        for c in text:
            kind = unicodedata.category(c)
            counts[3 if c in space else 4 if c in "#*$%&|<>" else 1 if kind == "Lu" else 0 if kind[0] == "L" else 2 if kind == "Nd" else 5] += 1
        return counts

    def distance(p, q):
        out = 0.0
        for a, b in zip(p, q):
            out += (a * math.log2(2 * a / (a + b)) if a > 0 else 0.0) / 2 + (b * math.log2(2 * b / (a + b)) if b > 0 else 0.0) / 2
        return math.sqrt(max(out, 0.0))

    texts = [(i, t or "", (lang or "").split("-")[0].strip().lower() or "und") for i, t, lang in rows]
    kept = {}
    for i, text, lang in texts:
        mine = [t for _, t, other in texts if other == lang]
        whole = [sum(x) for x in zip(*map(classes, mine))]
        times = Counter(w for t in mine for w in words_of(t.lower()))
        total = sum(len(words_of(t)) for t in mine)
        top = sorted((-n, w.encode()) for w, n in times.items() if n > 1)[:24]
        words, counts = words_of(text), classes(text)
        windows = Counter(tuple(words[j: j + 8]) for j in range(len(words) - 7))
        hit = {j + k for j in range(len(words) - 7) if windows[tuple(words[j: j + 8])] > 1 for k in range(8)}
        good = len(words) >= 20 and 100 * len(hit) <= 30 * len(words)
        if len(words) >= 50 and sum(counts) >= 200 and total >= 2000:
            good &= distance([c / sum(counts) for c in counts], [c / sum(whole) for c in whole]) <= 0.29
            own = Counter(words_of(text.lower()))
            mine, theirs = [own[w.decode()] / len(words) for _, w in top], [-n / total for n, _ in top]
            good &= not top or distance([*mine, 1 - sum(mine)], [*theirs, 1 - sum(theirs)]) <= 0.48
        kept[i] = good
    return kept


def test_verdict_of_the_quality_rules(spark):
    rng = random.Random(21)
    english = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all".split()
    made = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(english if rng.random() < 0.5 else made) for _ in range(90)), ("en", "EN-us")[i % 2]))
    rows += [(100 + i, " ".join(rng.choice(made) for _ in range(90)), "en") for i in range(5)]
    rows += [(200 + i, " ".join(f"{rng.randrange(10**6)}|#$%" for _ in range(80)), "en") for i in range(5)]
    rows += [(300, "THE OF AND " * 40, "en"), (301, "short text", "en"), (302, None, "en"), (303, "", None), (304, "x y " * 60, "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r.kept for r in divergence.quality(df).collect()}
    assert got == brute_kept(rows) and 5 < sum(got.values()) < len(rows) - 5
