"""Each corpus operator against brute force on small tables, and its defined edge cases."""

import gzip
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stringloom.llm.components import components
from stringloom.llm.decontaminate import ItemIndex, drop_contaminated, find_matches, simhash, word_hashes
from stringloom.llm.fingerprint import edited_fingerprints, fingerprint_documents, next_ids
from stringloom.llm.html_text import extract_text, main_text
from stringloom.llm.license_scan import TEMPLATES, Templates, scan_licenses, words
from stringloom.llm.line_dedup import dedup_lines
from stringloom.llm.mixing import find_exponent, mix
from stringloom.llm.near_dedup import drop_near_duplicates, near_duplicates, odd_sketch, shingle_set, signature
from stringloom.llm.quality import FAR, LENGTH, Features, ImportanceModel, best_threshold, kth_largest, resample
from stringloom.llm.url_filter import Rule, filter_urls
from stringloom.llm.warc import archive_pages, member_chunks, read_records, record_header, to_chunks

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[\x20\x09-\x0d]"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, schema="doc_id long, text string, source string"):
    return spark.createDataFrame([(i, t, "s") for i, t in texts], schema)


def random_texts(n, seed=0, words=400, vocabulary=3000):
    r = random.Random(seed)
    names = ["w" + format(i * 7919 % 65536, "x") for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            base = r.choice(out).split()
            for _ in range(r.choice([0, 1, 2, 5, 12])):
                if base:
                    base[r.randrange(len(base))] = r.choice(names)
            out.append(" ".join(base))
        else:
            out.append(" ".join(r.choice(names) for _ in range(r.randrange(words))))
    return list(enumerate(out))


def brute_components(texts, k, above):
    def shingles(t):
        w = [x for x in re.split(SPACE + "+", (t or "").translate(LOW)) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= above * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "above"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, k, above):
    texts = random_texts(160, seed=k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts), shingle=k, threshold=(above, 100)).collect()}
    assert got == brute_components(texts, k, above)


@pytest.mark.parametrize("block", [1 << 17, 400])
def test_near_duplicates_large_family(spark, monkeypatch, block):
    """Copies that link only in part: the blocks across components have work, whatever their size."""
    monkeypatch.setattr("stringloom.llm.near_dedup.BLOCK", block)
    r = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(r.choice([1, 3, 6, 9])):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts, 3, 85)


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a"), (7, "a b c d"), (7, "a b c d"), (None, "a b"), (9, "x " * 50000), (10, "x " * 60000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([(False, 1, 0, 1, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (False, 4, 1, 4, True), (False, 5, 1, 4, False), (False, 6, 1, 6, True), (False, 7, 2, 7, True), (False, 7, 2, 7, True), (True, 0, 1, None, True), (False, 9, 1, 9, True), (False, 10, 1, 9, False)])
    assert near_duplicates(docs(spark, []).limit(0)).collect() == []
    clash = docs(spark, [(1, "a b c"), (2, "a b c")]).selectExpr("doc_id", "text", "1 as n", "2 as id", "3 as component")
    assert [r.doc_id for r in drop_near_duplicates(clash).collect()] == [1]


def test_odd_sketch_estimates_similarity():
    a = shingle_set(" ".join(f"w{i}" for i in range(2000)).encode(), 3)
    b = shingle_set(" ".join(f"w{i}" for i in range(100, 2100)).encode(), 3)
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    n, k = 2048, 1024
    apart = sum(bin(x & (2**64 - 1)).count("1") for x in (odd_sketch(signature(a, k), n) ^ odd_sketch(signature(b, k), n)).tolist())
    assert abs(1 + n * math.log(1 - 2 * apart / n) / (4 * k) - true) < 0.05


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}


def test_decontamination_matches_all_windows(spark):
    r = random.Random(1)
    item = lambda n: " ".join(f"q{r.randrange(400)}" for _ in range(n))
    items = [(i, item(r.choice([3, 5, 12, 30, 45]))) for i in range(12)] + [(90, None), (91, "")]
    texts = []
    for i in range(60):
        w = item(80).split()
        if i % 2:
            part = (r.choice(items[:12])[1]).split()
            if i % 4 == 1 and len(part) > 10:
                part = part[2:] if i % 8 == 1 else [*part[:-1], "changed"]
            w[20:20] = part
        texts.append((i, " ".join(w).upper() + "!"))
    texts += [(100, None), (101, ""), (102, items[3][1])]
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for d, t in texts:
        w = split(t)
        for i, x in items:
            q = split(x)
            if not q or not w:
                continue
            best = 0.0
            for at in range(max(1, len(w) - len(q) + 1)):
                a, b = bag(w[at : at + len(q)]), bag(q)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(m.doc_id, m.item_id): round(m.similarity, 9) for m in find_matches(docs(spark, texts), bench).collect()}
    assert got == want
    assert want
    kept = {x.doc_id for x in drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}
    assert find_matches(docs(spark, texts), bench.limit(0)).collect() == []
    assert find_matches(docs(spark, texts).limit(0), bench).collect() == []


def test_decontamination_recall_at_the_threshold():
    r = random.Random(4)
    word = lambda: f"q{r.randrange(3000)}"
    items = [[word() for _ in range(r.choice([13, 22, 31, 40, 49, 58]))] for _ in range(150)]
    index = ItemIndex([(i, " ".join(x)) for i, x in enumerate(items)])
    missed = 0
    for i, x in enumerate(items):
        k = (len(x) - 4) // 9  # the most words at one end that can change: similarity 0.8 or just above
        for edited in ([word() for _ in range(k)] + x[k:], x[:-k] + [word() for _ in range(k)]):
            text = " ".join([word() for _ in range(30)] + edited + [word() for _ in range(30)])
            missed += i not in {m[0] for m in index.matches(text, 0.8)}
    assert missed == 0


def test_decontamination_in_blocks_ties_long_texts_and_clashing_names(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, " ".join(f"q{r.randrange(400)}" for _ in range(30))) for i in range(6)]
    texts = [(1, f"a b c {items[2][1]} d {items[5][1]}"), (1, items[2][1]), (2, items[2][1] + " x " + items[2][1]), (3, "word " * 60000 + items[0][1]), (None, items[4][1]), (4, "clean")]
    df = docs(spark, texts).withColumns({c: F.lit("z") for c in ("item_id", "similarity", "hamming", "key", "__id", "id")})
    bench = spark.createDataFrame([*items, (9, items[2][1])], "item_id long, text string")
    rows = lambda: Counter((m.doc_id, m.item_id, m.start_word) for m in find_matches(df, bench).collect())
    whole = rows()
    assert whole == Counter([(1, 2, 3), (1, 9, 3), (1, 5, 34), (1, 2, 0), (1, 9, 0), (2, 2, 0), (2, 9, 0), (3, 0, 60000), (None, 4, 0)])
    monkeypatch.setattr("stringloom.llm.decontaminate.BLOCK_WORDS", 60)
    assert rows() == whole
    assert [x.doc_id for x in drop_contaminated(df, bench).collect()] == [4]


def test_decontamination_index_is_bounded():
    r = random.Random(8)
    items = [(i, " ".join(f"q{r.randrange(10**6)}" for _ in range(40))) for i in range(2500)]
    arrays = [v for v in vars(ItemIndex(items)).values() if hasattr(v, "nbytes")]
    assert sum(a.nbytes for a in arrays) <= 60 * 40 * 2500


def test_simhash_of_equal_words_is_equal():
    assert (simhash(word_hashes("One two three")) == simhash(word_hashes("one, two. THREE!"))).all()


def quality_rows(n=400):
    r = random.Random(3)
    clean = [f"{a}{b}{c}" for a in ("bo", "ka", "mi", "ru") for b in ("lan", "tor", "ves") for c in ("", "a", "en", "is")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randrange(30, 120))]
        bad = i % 5 == 0
        if bad:
            w = [x + "###" for x in w] if i % 10 else [x if r.random() > 0.1 else r.choice(["vilelk", "vilemur"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad and i % 10 else 1, int(bad and not i % 10)))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = quality_rows()
    known = [x for x in labels if x[0] % 2]
    known += [x for x in labels if x[0] % 4 == 0]
    model = ImportanceModel(docs(spark, rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.accepted for r in model.score(docs(spark, rows)).collect()}
    unseen = [x for x in labels if x[0] % 4 == 2]
    right = [got[i] == (q == 1 and not t) for i, q, t in unseen]
    assert sum(right) / len(right) >= 0.95
    assert {r.doc_id for r in model.accepted(docs(spark, rows)).collect()} == {i for i, ok in got.items() if ok}


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ImportanceModel(docs(spark, rows), none)
    scored = model.score(docs(spark, rows))
    assert all(r.accepted and r.tail == 0 for r in scored.collect())
    assert ImportanceModel(docs(spark, rows).limit(0), none).score(docs(spark, []).limit(0)).count() == 0
    assert resample(scored, 0.5).where("sampled").count() >= 3
    assert best_threshold([0.0, -1.0], [True, True]) == float("-inf")


def test_quality_matches_brute_force(spark):
    """Counts, ratios, weights, tails and the Gumbel top-k, from their definitions."""
    rows, labels = quality_rows(120)
    rows += [(900, None), (901, "one"), (902, "again again again " * 30000)]
    df = docs(spark, rows).withColumns({c: F.lit(1) for c in ("bucket", "raw", "target", "good", "held", "log_weight", "__text2")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ImportanceModel(df, known)
    held = {r.doc_id for r in known.where(F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(3)) == 0).collect()}
    features = Features()
    bag = {i: Counter(features.of(t).tolist()) for i, t in rows}
    good = {i for i, q, t in labels if q and not t}
    raw, target = Counter(), Counter()
    for i, c in bag.items():
        raw.update(c)
        if i in good and i not in held:
            target.update(c)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {f: math.log((target[f] + 1) / (n * scale + 1)) for f, n in raw.items()}
    scored = model.score(df)
    got = {r.doc_id: r for r in scored.collect()}
    for i, c in bag.items():
        n = sum(c.values())
        assert got[i].n_features == n
        assert abs(got[i].log_weight - (sum(k * ratio[f] for f, k in c.items()) / n if n else 0)) < 1e-9
        assert abs(got[i].tail - (sum(k * ratio[f] for f, k in c.items() if ratio[f] < -FAR) / n if n else 0)) < 1e-9
    noise = scored.select("doc_id", ((F.pmod(F.xxhash64(F.lit(5), "doc_id", "n_features", "log_weight"), F.lit(2**52)) + 0.5) / 2.0**52).alias("u")).collect()
    keys = {r.doc_id: LENGTH * got[r.doc_id].log_weight / 2.0 - math.log(-math.log(r.u)) for r in noise}
    chosen = set(sorted(keys, key=lambda i: -keys[i])[: math.ceil(0.3 * len(rows))])
    assert {r.doc_id for r in resample(scored, 0.3, temperature=2.0, seed=5).where("sampled").collect()} == chosen


def test_quality_features_are_words_and_pairs():
    of = lambda t: set(Features().of(t).tolist())
    assert of("alpha beta gamma") != of("gamma alpha beta")
    assert of("international") != of("internal")


def test_quality_ties_are_sampled_together(spark):
    same = spark.createDataFrame([(None, 3, 0.5)] * 10 + [(1, 3, 0.1)], "doc_id long, n_features long, log_weight double")
    assert resample(same, 0.2).where("sampled").count() in (1, 10, 11)


def test_kth_largest(spark):
    r = random.Random(2)
    values = [r.choice([r.gauss(0, 1e6), r.random(), 3.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_html_main_text(spark):
    page = """<html><head><title>T</title><style>x{}</style></head><body class="page"><header><h1>Site</h1></header>
    <nav><a href=/a>menu</a></nav><div id="sidebar-left">side</div><div class="cookie-notice">cookies</div>
    <article><h1>Head &amp; line</h1><p>One   two&nbsp;three <b>bold<i>!</i></b>
    <p>Short.<ul><li>first<li>second</ul><div class="ad">buy</div><script>if (a<b) {}</script><form>name <input></form>
    <div class="comments"><p>reader words</p></div></article><footer>foot</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne two three bold!\nShort.\nfirst\nsecond"
    own = "<article><div class='article-header'><h1>Own title</h1></div><p>Text of it.</p></article><div class='site-header'>x</div>"
    assert main_text(own) == "Own title\nText of it."
    plain = "<body><div class=menu>a</div><div><p>" + "long words here " * 20 + "</p><p>tail</p></div><p class=footer>x</p>"
    assert main_text(plain) == ("long words here " * 20).strip() + "\ntail"
    for odd in (None, "", "<", "<p", "<!-- open", "</p></p>", "<![CDATA[x]]>", "<script>never ends", "&#x110000;&bogus;", "a" * 100000):
        assert isinstance(main_text(odd), str)
    df = spark.createDataFrame([(1, "u", page, 7), (2, None, None, 7), (2, None, None, 7)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in extract_text(df).collect())
    assert got == [(1, "Head & line\nOne two three bold!\nShort.\nfirst\nsecond"), (2, ""), (2, "")]
    assert extract_text(df.limit(0)).count() == 0


def test_html_ratios_decide_on_pages_with_an_article():
    prose = [" ".join(["long plain words of prose"] * 20), " ".join(["more of the same story"] * 15), "Short."]
    text = "".join(f"<p>{x}</p>" for x in prose)
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6)) + "</ul></div>"
    teaser = "<article><h3><a href=/x>Teaser</a></h3><p><a href=/x>Read on</a></p></article>"
    for page in (f"<div>{text}</div>{links}{teaser}", f"{teaser}{links}<div>{text}</div>", f"<article>{text}{links}</article>", f"<main>{text}{links}</main>"):
        assert main_text(f"<body>{page}</body>").split("\n") == prose


def test_html_inline_non_content_does_not_split_its_block():
    for inside in ("<script>x</script>", "<span class='ad'>buy</span>", "<button><div>x</div></button>", "<svg><text>x</text></svg>", "<noscript>x</noscript>", "<select><option>x</select>"):
        assert main_text(f"<article><p>One {inside} two</p><p>three</p></article>") == "One two\nthree"
    prose = "long words of prose " * 9
    page = f"<article><p>{prose}</p><div class='warning'>Mind this well, it is part of the story.</div><p class='byline'>By someone who wrote all of it.</p></article>"
    assert main_text(page).split("\n")[1:] == ["Mind this well, it is part of the story.", "By someone who wrote all of it."]


def test_fingerprints_match_brute_force(spark):
    r = random.Random(4)
    texts = [(i * 37 - 4000, "".join(r.choice("aB éﬁ\n\tÄ") for _ in range(r.randrange(40)))) for i in range(200)] + [(10**15, "x"), (-(2**62), "A\u0308 b")]
    texts += [(5, None), (6, "Ä  B"), (7, "abc")]
    got = {x.doc_id: x for x in edited_fingerprints(docs(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: x[0])
    canon = lambda t: re.sub(r"[\s\x1c-\x1f\x85]+", " ", unicodedata.normalize("NFKC", t).lower()).strip(" ")
    codes = defaultdict(set)
    for n, (i, t) in enumerate(order):
        t, nt = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nt[:k]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        codes[canon(t)].add(x.fingerprint)
        codes[canon(e)].add(x.edited_fingerprint)
        assert x.near_edited == float(canon(e) == canon(t))
        assert x.near_next == float(canon(nt) == canon(t))
    assert all(len(v) == 1 for v in codes.values())
    assert len({next(iter(v)) for v in codes.values()}) == len(codes)
    assert fingerprint_documents(docs(spark, texts)).count() == len(texts)
    assert edited_fingerprints(docs(spark, []).limit(0)).collect() == []
    assert len(edited_fingerprints(docs(spark, [(1, "same"), (1, "same"), (None, "abcd"), (2, "b")])).collect()) == 4


def test_next_ids(spark):
    r = random.Random(6)
    ids = sorted({r.randrange(-(2**63), 2**63) for _ in range(50)} | set(range(3000)))
    got = {x.id: x.next_id for x in next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_warc_round_trip(spark):
    r = random.Random(12)
    big = "".join(r.choice("abcdefgh") for _ in range(200_000)) + "é"
    rows = [(3, "http://a/ b", "x" * 150), (1, "http://c", "x" * 150), (2, None, None), (4, "u", "short"), (5, "u", "short"), (6, "http://b", big), (7, "v", big), (1, "http://c", "x" * 150), (None, "n", "x" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(df, chunk=1000).collect())
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "").encode() == p]
        again = len(p) >= 100 and same and (i is None or i > min(same))
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(same) if again else None] += 1
    assert got == want
    chunks = to_chunks(df, chunk=1000)
    assert chunks.where("chunk_no > 0").count() > 0
    assert read_records(chunks.limit(0)).count() == 0
    assert archive_pages(df.limit(0)).count() == 0


def test_warc_members_are_gzip():
    payload = "html <b>" * 9000
    digest = hashlib.sha256(payload.encode()).hexdigest()
    head = record_header(1, "http://x/", len(payload), digest, None, "2020-01-01T00:00:00Z")
    parts = list(member_chunks(head, payload, 64))
    assert len(parts) > 1
    assert gzip.decompress(b"".join(p[2] for p in parts)) == head + payload.encode() + b"\r\n\r\n"
    assert parts[-1][3] == hashlib.sha256(b"".join(p[2] for p in parts)).hexdigest()


def test_warc_reader_tells_lost_chunks(spark):
    r = random.Random(3)
    big = "".join(r.choice("abcdefgh") for _ in range(9000))
    rows = spark.createDataFrame([(i, "u", f"{i}{big}") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    chunks = to_chunks(rows, chunk=700).collect()
    names = ["record_id", "chunk_no", "is_last", "data", "running_digest"]
    last = max(c.chunk_no for c in chunks if c.record_id == "0-1")
    assert last > 3
    table = lambda keep: spark.createDataFrame([tuple(c[n] for n in names) for c in keep], "record_id string, chunk_no int, is_last boolean, data binary, running_digest string")
    assert read_records(table(chunks[::-1])).count() == 4
    hit = lambda c, n: c.record_id == "0-1" and c.chunk_no == n
    swapped = [(c.asDict() | {"chunk_no": {1: 2, 2: 1}.get(c.chunk_no, c.chunk_no)}) if c.record_id == "0-1" else c for c in chunks]
    changed = [(c.asDict() | {"data": bytes([c.data[0] ^ 1]) + c.data[1:]}) if hit(c, 2) else c for c in chunks]
    for broken in ([c for c in chunks if not hit(c, last)], [c for c in chunks if not hit(c, 0)], [c for c in chunks if not hit(c, 2)], swapped, changed, [*chunks, *[c for c in chunks if hit(c, 1)]]):
        with pytest.raises(Exception, match="WARC record 0-1"):
            read_records(table(broken)).collect()


def test_warc_clashing_names_and_long_payload(spark):
    df = spark.createDataFrame([(1, "u", "é" * 300_000, 5), (2, "u", "é" * 300_000, 5)], "page_id long, url string, html string, digest int").withColumns({"length": F.lit(1), "refers_to": F.lit(2), "n": F.lit(3), "again_id": F.lit(4)})
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(df, chunk=100).collect())
    assert got == [(1, 600_000, "response", None), (2, 600_000, "revisit", 1)]


def brute_lines(texts, at_least):
    key = lambda line: re.sub(f"^{SPACE}+|{SPACE}+$", "", line).translate(LOW)
    n = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, c in n.items() if k and c >= at_least}
    return Counter((i, len((t or "").split("\n")), sum(key(x) in gone for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t in texts)


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(8)
    lines = ["Top", " top\t", "TOP", "", "é", "É", "x y", "a\rb", "\x0b", "long " * 50]
    texts = [(i, "\n".join(r.choice([*lines, f"own {i}"]) for _ in range(r.randrange(12)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n"), (3, "top\nown"), (3, "top\nown"), (None, "top\nz")]
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in dedup_lines(docs(spark, texts)).collect())
    assert got == brute_lines(texts, 10)
    assert dedup_lines(docs(spark, []).limit(0)).collect() == []
    clash = docs(spark, texts).withColumns({c: F.lit(1) for c in ("id", "pos", "key", "h1", "gone")})
    assert dedup_lines(clash).count() == len(texts)


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        ("p/LICENSE", mit), ("p/src/a.c", "int main"), ("p/src/deep/b.c", "some code words before the notice\nLicensed under the Apache License, Version 2.0.\nmore code here"),
        ("p/vendor/LICENSE", "Licensed under CC BY-NC 4.0."), ("./p//vendor/x/y.c", "nothing here"), ("q/z.c", None), (None, "text"), ("root.c", ""), ("p/src/a.c", "int main"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = Counter((r.path, r.license, r.origin, r.license_path) for r in scan_licenses(df).collect())
    assert got == Counter([
        ("p/LICENSE", "MIT", "file", "p/LICENSE"), ("p/src/a.c", "MIT", "inherited", "p/LICENSE"), ("p/src/a.c", "MIT", "inherited", "p/LICENSE"),
        ("p/src/deep/b.c", "Apache-2.0", "header", "p/src/deep/b.c"), ("p/vendor/LICENSE", "CC-BY-NC-4.0", "file", "p/vendor/LICENSE"),
        ("p/vendor/x/y.c", "CC-BY-NC-4.0", "inherited", "p/vendor/LICENSE"), ("q/z.c", None, "none", None), (None, None, "none", None), ("root.c", None, "none", None),
    ])
    assert scan_licenses(df.limit(0)).collect() == []


def test_license_cosine_matches_brute_force():
    r = random.Random(7)
    vocabulary = sorted({w for t in TEMPLATES.values() for x in t for w in words(x)})
    files, frequency = 40, {w: r.randrange(40) for w in vocabulary}
    scanner = Templates(TEMPLATES, files, frequency)
    idf = lambda w: math.log((1 + files) / (1 + (frequency.get(w, 0) if w in frequency else 0))) + 1
    for _ in range(60):
        w = [r.choice([*vocabulary, "zzz", "qqq"]) for _ in range(r.randrange(1, 40))] if r.random() < 0.5 else words(r.choice(r.choice(list(TEMPLATES.values()))))[r.randrange(3) :]
        a, best = Counter(w), []
        for name, t in TEMPLATES.items():
            for x in t:
                b = Counter(words(x))
                dot = sum(a[k] * b[k] * idf(k) ** 2 for k in a)
                norm = lambda c: math.sqrt(sum((n * idf(k)) ** 2 for k, n in c.items()))
                best.append((-round(dot / (norm(a) * norm(b)), 9), name) if a else (0.0, name))
        got = scanner.best(a)
        assert abs(got[0] - min(best)[0]) < 1e-8
        assert got[1] in {n for s, n in best if abs(s - min(best)[0]) < 1e-8}


def test_license_notices_inside_text_ties_and_names(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/x.c", f"Some ordinary sentence about other things entirely. {apache} Another ordinary sentence of prose follows here."), ("a/y.c", f"words of prose here\n{apache}\nmore words of prose\nReleased under the MIT License.\nand prose"),
        ("p/LICENSE.txt", apache), ("p/LICENSE", apache), ("p/sub/z.c", "nothing"), ("q/COPYING", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        ("r/g.c", "code here and there\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\nmore code"), ("long.c", "ordinary prose goes on. " * 40000 + apache),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("q") for c in ("own", "share", "dir", "given")})
    got = {x.path: x for x in scan_licenses(df, keep=("own", "share")).collect()}
    assert (got["a/x.c"].license, got["a/x.c"].origin) == ("Apache-2.0", "header")
    assert got["a/y.c"].licenses == ["Apache-2.0", "MIT"]
    assert (got["p/sub/z.c"].license_path, got["p/sub/z.c"].own) == ("p/LICENSE", "q")
    assert (got["q/COPYING"].license, got["q/COPYING"].origin) == ("BSD-2-Clause", "file")
    assert got["r/g.c"].license == "GPL-2.0"
    assert got["long.c"].license == "Apache-2.0"


def test_url_filter_matches_brute_force(spark):
    rules = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "bad-site.org", "")]
    r = random.Random(9)
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "notexample.com", "net", "x.net", "bad-site.org", "sub.bad-site.org", "com", "example.com:80", "örg.net"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/EN/', '/es/x', '/en/a?b#c', '?/en/', '#x'])}" for _ in range(400)] + [None, "", "example.com/en/", "x://", "a://b://example.com/en/", "://com/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1])]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path) and (x.path or True)]
        best = max(fits, key=lambda x: (len(x.text), x.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect())
    assert got == Counter((i, *judge(u)) for i, u in rows)
    clash = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("q") for c in ("h", "p", "host", "token", "rule")})
    assert filter_urls(clash, rules).count() == len(rows)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []


def test_mixing_budgets(spark):
    r = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 30))), "big" if i % 10 else f"s{i % 30}") for i in range(600)] + [(900, None, "big"), (901, "", None), (902, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, max_repeats=2.0, block_tokens=100).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    tokens, uses = Counter(), Counter()
    for x in out:
        tokens[x.source] += x.n_tokens
        uses[x.doc_id] += 1
        assert 0 <= x.slot <= 1
    own = Counter()
    for _, t, s in rows:
        own[s or ""] += len((t or "").split())
    assert max(uses.values()) <= 2 + 1
    assert abs(sum(tokens.values()) - total) <= 30 * len(own)
    shares = spark.createDataFrame([(math.log(n / total),) for n in own.values()], "lnp double")
    a = find_exponent(shares, 1.0, max_repeats=2.0)
    z = sum((n / total) ** a for n in own.values())
    for s, n in own.items():
        want = (n / total) ** a / z * total
        assert want / n <= 2.001
        assert -1e-6 <= tokens[s] - want <= 30 or n == 0
    entropy = find_exponent(shares, 1.0, target_entropy=1.0)
    z = sum((n / total) ** entropy for n in own.values())
    h = -sum((p := (n / total) ** entropy / z) * math.log(p) for n in own.values())
    assert abs(h - 1.0) < 1e-3
    assert mix(df.limit(0), max_repeats=2.0).collect() == []
    assert Counter(map(tuple, mix(df, max_repeats=2.0, block_tokens=100).collect())) == Counter(map(tuple, out))


def brute_mix(rows, max_repeats, block_tokens, hashes):
    """The uses of documents by the definition, from the hashes that Spark gives."""
    own = Counter()
    for r in rows:
        own[r.source] += r.n_tokens
    total, own = sum(own.values()), {s: n for s, n in own.items() if n}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum((n / total) ** a for n in own.values())
        low, high = (low, a) if max((n / total) ** a / z * total / n for n in own.values()) <= max_repeats else (a, high)
    z = sum((n / total) ** high for n in own.values())
    out = Counter()
    for s, n in own.items():
        budget = (n / total) ** high / z * total
        whole, rest, blocks = int(budget / n), budget - int(budget / n) * n, math.ceil(n / block_tokens)
        mine = [r for r in rows if r.source == s]
        for epoch in range(whole):
            out.update((r.doc_id, s, epoch) for r in mine)
        dealt = sorted((hashes[whole, r.doc_id][1] % blocks, hashes[whole, r.doc_id][0], r.doc_id, r.n_tokens) for r in mine)
        used = 0
        for block in range(blocks):
            members = [x for x in dealt if x[0] == block]
            size = sum(x[3] for x in members)
            at = used
            for _, _, doc_id, tokens in members:
                if used < rest and (used + size <= rest or at < rest):
                    out[doc_id, s, whole] += 1
                at += tokens
            used += size
    return out


def test_mixing_matches_the_definition(spark, monkeypatch):
    monkeypatch.setattr("stringloom.llm.mixing.SPAN", 3)
    r = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 30))) + f" {i}", "big" if i % 10 else f"s{i % 30}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("q") for c in ("block", "tokens", "span", "order", "h", "epoch")})
    h = F.xxhash64(F.lit(0), F.col("text"))
    order = F.xxhash64(F.lit(0), F.col("e"), F.col("doc_id"), h)
    known = df.select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("e")).select("doc_id", "e", order.alias("o"), F.xxhash64(F.lit("block"), order).alias("b")).collect()
    hashes = {(x.e, x.doc_id): (x.o, x.b) for x in known}
    tokens = [type("R", (), {"doc_id": i, "source": s, "n_tokens": len(t.split())}) for i, t, s in rows]
    got = Counter((x.doc_id, x.source, x.epoch) for x in mix(df, max_repeats=2.0, block_tokens=100).collect())
    assert got == brute_mix(tokens, 2.0, 100, hashes)


def test_mixing_refuses_limits_that_nothing_meets(spark):
    df = docs(spark, [(1, "a b c"), (2, "d e"), (3, "f " * 70000)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    with pytest.raises(ValueError, match="no exponent"):
        mix(df, budget_ratio=5.0, max_repeats=2.0)
    with pytest.raises(ValueError, match="no exponent"):
        mix(df, target_entropy=0.00001)
    assert {x.n_tokens for x in mix(df, budget_ratio=2.0, max_repeats=2.0).collect()} == {3, 2, 70000}


def test_pipeline_on_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as cp

    clash = {c: F.lit("q") for c in ("key", "component", "kept_text", "good", "block")}
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).withColumns(clash).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/empty").collect() == []
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y z"), (5, "long words " * 30000)]]
    for name, data, schema in (("documents", rows, DOC), ("labels", [(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None)], "item_id long, text string")):
        spark.createDataFrame(data, schema).withColumns(clash).write.parquet(f"{tmp_path}/odd/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, f"{tmp_path}/odd")
        assert now.columns == cp.COLUMNS
        now.write.parquet(f"{tmp_path}/odd/{name}")
        now = spark.read.parquet(f"{tmp_path}/odd/{name}")
    assert sorted((r.doc_id or 0) for r in now.collect()) == [0, 1, 2, 3, 3, 5]
    assert cp.run(spark, f"{tmp_path}/odd").count() >= 5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows, labels = quality_rows(300)
    rows = [(i, f"{t}\nshared footer line" if i % 3 else t) for i, t in rows]
    rows += [(1000, rows[1][1] + " extra"), (1001, rows[2][1]), (1002, "zero one two three four five six seven eight nine ten"), (1003, None)]
    for name, data, schema in (("documents", [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, "one two three four five six seven eight nine")], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in now.collect()})
    bad = {i for i, q, t in labels if not q or t}
    assert len(bad & seen[0]) <= 3
    assert len({i for i, q, t in labels if q and not t} - seen[0]) <= 10
    assert seen[1] == seen[0]
    assert 1001 not in seen[2]
    assert 1002 in seen[2]
    assert 1002 not in seen[3]
    assert cp.run(spark, str(tmp_path)).count() == now.count()
