"""Each dealt operator against a brute-force version, and on odd, empty and repeated rows."""

import hashlib
import math
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from veriframe.llm import bpe, common, embdedup, htmllayouts, htmltext, langid, linededup, media, mixing, ngramlm, simhash, toxicity
from veriframe.llm.common import connected_components

WORDS = "the of and to in that is was for on are with as his they at be this have from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# components


def test_components_of_paths_stars_and_cycles(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(700, 701), (701, 702), (702, 700), (5, 5)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e}
    want = groups(edges, nodes)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1 toxicity


def toxic_corpus(documents, spark, n=700):
    r = random.Random(1)
    bad = ["vilbad", "viltru", "vilosk"]
    rows, labels = [], []
    for i in range(n):
        words = prose(r, r.randrange(20, 80)).split()
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark, documents):
    docs, labels = toxic_corpus(documents, spark)
    got = by_id(toxicity.toxicity(docs, labels))
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == want[i] for i in held) / len(held) > 0.97
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got.values())
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_toxicity_odd_rows(spark, odd, nothing, documents):
    docs, labels = toxic_corpus(documents, spark, 200)
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(nothing, none).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(odd, none).collect())
    strange = spark.createDataFrame([(4, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(odd, strange).count() == odd.count()


# 2 media


def test_media_round_trip_of_any_bytes():
    r = random.Random(4)
    payloads = [bytes(r.randrange(256) for _ in range(192 * r.randrange(1, 6))) for _ in range(30)] + [b"\xff" * 384, b"\0" * 192, bytes(range(256)) * 3]
    read = media.decode(media.encode(payloads))
    assert [media.payload_of(x) for x in read] == payloads
    for x, p in zip(read, payloads):
        assert x["thumb"].ravel()[: len(p) // 64].tolist() == list(p[::64])  # a pixel is the block's first byte


def peak_of(code):
    """MB that a process of its own takes at most."""
    run = subprocess.run([sys.executable, "-c", f"import resource\n{code}\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"], capture_output=True, text=True, check=True, timeout=500)
    return int(run.stdout.split()[-1])


def test_media_of_a_long_payload():
    r = np.random.default_rng(3)
    long = r.integers(32, 127, 192 * 20_000, np.uint8).tobytes()
    short = [bytes(r.integers(0, 256, 192 * k, np.uint8)) for k in (1, 40, 3)]
    files = media.encode([short[0], long, *short[1:]])
    assert [media.payload_of(x) for x in media.decode(files)] == [short[0], long, *short[1:]]
    assert files == [media.encode([p])[0] for p in (short[0], long, *short[1:])]


def test_long_texts_need_memory_in_proportion():
    """50 MB texts: media, toxicity and language."""
    text = "t = 'Some words of a long text that go on and on, with more of them. ' * 750_000"
    assert peak_of(f"from veriframe.llm import media\n{text}\np = t.encode()\np += b' ' * (-len(p) % 192)\nassert media.payload_of(media.decode(media.encode([p]))[0]) == p") < 1500
    assert peak_of(f"from veriframe.llm import langid, toxicity\n{text}\nm = toxicity.Model(); assert abs(m.score([t])[0] - m.score([t[:640_000]])[0]) < 1e-6\nassert langid.vectors([t])[1].all()") < 900


def test_long_texts_score_as_if_whole(monkeypatch):
    r = random.Random(8)
    texts = [prose(r, 400) + f" {i}" for i in range(12)]
    model = toxicity.Model()
    model.train(texts, np.array([i % 2 for i in range(12)], np.float32), ["en", "de"] * 6, np.ones(12))
    whole, grams = model.score(texts), langid.vectors(texts)[0]
    monkeypatch.setattr(toxicity, "PIECE", 300)
    assert np.allclose(model.score(texts), whole)
    monkeypatch.setattr(langid, "pieces", lambda t: common.pieces(t, 200))
    assert np.allclose(langid.vectors(texts)[0], grams)
    assert all("".join(common.pieces(t, 50)) == t for t in texts) and [len(x) for x in common.pieces("x" * 100, 30)] == [30, 30, 30, 10]


def test_samples_are_bounded(spark):
    """A key repeated often, many languages, only null keys, a text too long for its share."""
    hot = spark.range(100_000).selectExpr("7L AS doc_id", "concat('text ', id % 3) AS text", "'en' AS lang")
    many = spark.range(3000).selectExpr("id + 100 AS doc_id", "concat('some words ', id) AS text", "concat('l', id % 1000) AS lang")
    found = common.bounded_sample(hot.union(many), hot.union(many), ["lang"], "doc_id", "text", 400, 50, 200, 10_000)
    assert len(found) <= 200 and len({f.stratum for f in found}) <= 50 and sum(f.key == 7 for f in found) == 1
    model = langid.fit(hot.union(many))
    assert len(model.langs) <= langid.KINDS
    nulls = hot.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang").limit(20)
    assert langid.fit(nulls).langs == [] and langid.identified(nulls).where("lang_pred = 'und'").count() == 20
    long = spark.createDataFrame([(1, "x" * 9000, "a"), (2, "short", "a"), (3, None, "a")], "doc_id bigint, text string, lang string")
    assert sorted(f.key for f in common.bounded_sample(long, long, ["lang"], "doc_id", "text", 400, 50, 200, 5000)) == [2, 3]


def test_media_reads_files_of_another_encoder(spark, tmp_path):
    """Files that the JVM's encoder writes: thumbnails are near the means of the blocks of what its decoder reads."""
    jvm = spark.sparkContext._jvm
    for kind in (10, 5):  # grey, colour (subsampled)
        image = jvm.java.awt.image.BufferedImage(43, 37, kind)
        for y in range(37):
            for x in range(43):
                v = (x * 5 + y * 3) % 256 if x < 30 else 200
                image.setRGB(x, y, (v << 16) | (((v * 2) % 256 if kind == 5 else v) << 8) | v)
        path = str(tmp_path / f"{kind}.jpg")
        assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))
        again = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(path))
        grey = np.zeros((37, 43))
        for y in range(37):
            for x in range(43):
                if kind == 10:
                    grey[y, x] = again.getRaster().getSample(x, y, 0)
                    continue
                p = again.getRGB(x, y)
                grey[y, x] = 0.299 * ((p >> 16) & 255) + 0.587 * ((p >> 8) & 255) + 0.114 * (p & 255)
        with open(path, "rb") as f:
            got = media.decode([f.read()])[0]
        assert (got["width"], got["height"]) == (43, 37)
        for by in range(4):
            for bx in range(5):
                assert abs(float(got["thumb"][by, bx]) - grey[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8].mean()) < 4


def test_media_file_is_read_by_another_decoder(spark, tmp_path):
    path = tmp_path / "a.jpg"
    path.write_bytes(media.encode([b"some text " * 96])[0])
    image = spark.sparkContext._jvm.javax.imageio.ImageIO.read(spark.sparkContext._jvm.java.io.File(str(path)))
    assert (image.getWidth(), image.getHeight()) == (24, 40)


def test_media_queries(spark, odd, nothing):
    got = media.digests(odd).collect()
    assert len(got) == odd.count() and media.digests(nothing).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    files = media.stored(odd)
    whole = media.media_columns(files, "doc_id", "media").where("error is null")
    assert whole.count() == odd.count()
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xd8\xff")), (4, bytearray(b"GIF89a"))], "i bigint, c binary")
    assert all(r["error"] and r["width"] is None for r in media.media_columns(bad, "i", "c").collect())


# 3 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>x="</p><article>no"</script></head><body class="has-sidebar">
<header><a href=/>Site</a><p>The name of the site and its long line of thought.</p></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies so that this site works better for you.</p></div>{}
<div class="sidebar"><p>Popular posts that you may like to read this week on our site.</p></div>
<section id="comments"><p>Great article, thanks for sharing it with all of us here!</p></section>
<form><label>Name</label><input><button>Send it to us</button></form><footer>&copy; 2024 Someone of the site.</footer></body>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>"])
def test_html_leaves_the_article(wrap):
    body = "<h1>The title of it</h1><p>First  &amp; long paragraph with\n some words that go on and on.<p>A second one, <b>with bold</b> and <a href=x>a link</a>, which is long too.<div class=ad>Buy now, great offers are here today.</div><p>And a third paragraph that ends the whole article.</p>"
    got = htmltext.main_text(PAGE.replace("{}", wrap.format(body)))
    assert got == "The title of it First & long paragraph with some words that go on and on. A second one, with bold and a link, which is long too. And a third paragraph that ends the whole article."


def test_html_of_neutral_layouts():
    """Without any telling tag, class or id the article stays whole in most pages; the cut mends what the classifier misses."""
    weights = np.array(list(htmltext.WEIGHTS.values()))
    right = alone = changed = blocks = 0
    for found, truth in htmllayouts.labelled(300, 77):
        cut, classified = htmltext.labels(found), (htmltext.features(found) @ weights > 0).tolist()
        right += cut == truth
        alone += classified == truth
        changed += sum(a != b for a, b in zip(cut, classified))
        blocks += len(truth)
    assert right > 0.85 * 300 and right > alone and 0.002 < changed / blocks < 0.05


def test_html_weights_are_what_fit_learns():
    learnt = htmltext.fit(htmllayouts.labelled(2500))
    assert learnt.keys() == htmltext.WEIGHTS.keys() and all(abs(learnt[k] - v) < 0.02 for k, v in htmltext.WEIGHTS.items())


def article_of(html):
    """The text of the article element by a regular expression, paragraph by paragraph."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inside)]
    return " ".join(" ".join(unescape(p).split()) for p in parts if p.strip())


def test_html_against_the_article_elements(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extracted(pages).collect()}
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(got) == len(raw) and all(got[i] == article_of(h) for i, h in raw.items())
    # the same pages with every telling name gone
    same = 0
    for h in raw.values():
        neutral = re.sub(r"<(/?)(article|nav|header|footer|aside)\b", r"<\1div", re.sub(r'\s(class|id|role)="[^"]*"', "", h))
        same += htmltext.main_text(neutral) == article_of(h)
    assert same > 0.9 * len(raw)


def test_html_of_many_blocks():
    r = random.Random(3)
    page = "".join("<div>" * (r.random() < 0.3) + "<p>" + "word " * r.randrange(1, 30) + "</p>" + "</div>" * (r.random() < 0.3) for _ in range(30_000))
    began = time.perf_counter()
    assert len(htmltext.main_text(page)) > 0 and time.perf_counter() - began < 20


def test_html_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p>Broken <b>page that <i>never ends its tags, but has words"), (5, "u", "<div>" * 3000 + "A deep paragraph that still is found by all." + "</div>" * 10), (None, "u", "<script>alert(1)"), (6, "u", "<p>" + "Long words here. " * 20000)]
    got = {r["page_id"]: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text")).collect()}
    assert len(got) == 7 and got[1]["text"] == got[2]["text"] == got[None]["text"] == ""
    assert got[4]["text"] == "Broken page that never ends its tags, but has words"
    assert got[6]["n_chars"] == len("Long words here. " * 20000) - 1
    assert htmltext.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_minimum_cut_is_minimal():
    r = random.Random(8)
    for _ in range(60):
        n = r.randrange(2, 8)
        s, t = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        edges = [(i, j, r.random()) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda keep: sum(t[i] if keep[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(htmltext.minimum_cut(s, t, edges)) - best) < 1e-6


# 4 SimHash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, documents):
    r = random.Random(5)
    rows = []
    for i in range(120):
        t = prose(r, 120)
        rows.append((len(rows), t))
        for _ in range(r.randrange(3)):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, ""), (1001, None), (1002, rows[0][1])]
    got = by_id(simhash.near_duplicates(documents(rows)))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in fps.items())
    want = groups([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    assert {i: g["component_id"] for i, g in got.items()} == want


def test_similar_texts_of_one_key(documents):
    """Texts that share a key are judged each by itself; repeated rows give one."""
    r = random.Random(4)
    a, b, c = (prose(r, 40) for _ in range(3))
    rows = [(7, a), (7, a), (7, b), (8, a), (9, b), (10, c), (None, a), (None, a)]
    for n in (1, 3):
        out = simhash.one_of_each(documents(rows).repartition(n))
        assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter([(7, a), (7, b), (10, c), (None, a), (None, a)])
        assert out.columns == documents(rows).columns


def test_simhash_finds_every_link_of_two_bits():
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    values = sorted({*base, *(v ^ (1 << a) ^ (1 << b) for v in base for a, b in [(r.randrange(64), r.randrange(64)) for _ in range(4)])})
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    for masks in (simhash._masks(simhash.BLOCKS, 4), simhash._masks((8,) * 8, 6)):
        assert all(any((values[i] ^ values[j]) & m == 0 for m in masks) for i, j in links)
    dense = [values[0] ^ x for x in range(3000)]  # larger than one tree
    assert len(simhash.forest(dense)) == 2999
    assert simhash.links is not None


def test_simhash_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[None]["component_id"] is None
    kept = [r["doc_id"] for r in simhash.one_of_each(odd).collect()]
    assert kept.count(4) == 1 and 5 not in kept and None in kept and 1 in kept and 2 not in kept
    assert simhash.near_duplicates(nothing).count() == simhash.one_of_each(nothing).count() == 0


# 5 languages


def test_languages_held_out(documents):
    r = random.Random(2)
    parts = {"xa": ["ka", "lo", "mi", "tu"], "xb": ["sch", "ein", "ung", "ber"], "xc": ["eau", "tion", "é", "que"]}
    rows = [(i, " ".join("".join(r.choice(parts[v]) for _ in range(3)) for _ in range(r.randrange(5, 60))), v, "s") for i in range(400) for v in [r.choice(list(parts))]]
    rows += [(900, "12 34 !!", "xa", "s"), (901, None, "xa", "s"), (902, "Kalo MITU", None, "s")]
    got = by_id(langid.identified(documents(rows)))
    held = [x for x in rows if x[0] < 900 and got[x[0]]["held_out"]]
    assert held and all(got[i]["lang_pred"] == v for i, _, v, _ in held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "xa" and all(0 <= g["score"] <= 1 for g in got.values())


def test_languages_reject_what_is_far(documents):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["kalo", "mitu", "kami"]) for _ in range(40)), "xa", "s") for i in range(100)]
    got = by_id(langid.identified(documents([*rows, (900, "zzz qqq www vvv yyy " * 10, "xa", "s")]))) if zlib.crc32(b"900") % 5 == 0 else by_id(langid.predict(documents([(900, "zzz qqq www vvv yyy " * 10)]), langid.fit(documents(rows))))
    assert got[900]["rejected"] and got[900]["lang_pred"] == "xa"


def test_languages_odd_rows(odd, nothing, spark):
    got = langid.identified(odd).collect()
    assert len(got) == odd.count()
    assert langid.identified(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.Model([], [])).collect()} == {"und"}


# 6 mixing


def brute_mix(rows):
    size = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) for _, t, _, _ in rows]
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    left, open_, target = 1.5 * sum(size), set(sources), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * per > 2 * own[s]]
        if not over:
            target |= {s: weight[s] * per for s in open_}
            break
        for s in over:
            target[s] = 2.0 * own[s]
            left -= target[s]
            open_.discard(s)
    return size, own, target


def test_mixing_against_resharing(documents):
    r = random.Random(7)
    rows = [(i, prose(r, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", "d", "e", None])) for i in range(900)]
    size, own, target = brute_mix(rows)
    got = by_id(mixing.mix(documents(rows)))
    taken = Counter()
    for n, (i, _, _, s) in zip(size, rows):
        g = got[i]
        assert g["size"] == n and g["source_size"] == own[s] and math.isclose(g["target"], target[s], rel_tol=1e-9)
        assert g["taken"] in (0, n, 2 * n)
        taken[s] += g["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in own)
    assert by_id(mixing.mix(documents(rows))) == got
    out = mixing.mixed(documents(rows))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: g["copies"] for i, g in got.items() if g["copies"]})
    assert out.columns == documents(rows).columns


def test_mixing_budgets_are_nested(documents):
    r = random.Random(9)
    docs = documents([(i, prose(r, 20), "en", "a" if i % 3 else "b") for i in range(300)])
    small, large = by_id(mixing.mix(docs, budget=0.4)), by_id(mixing.mix(docs, budget=0.9))
    assert all(large[i]["copies"] >= g["copies"] for i, g in small.items())


def test_mixing_odd_rows(odd, nothing, documents):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0
    blank = mixing.mix(documents([(1, ""), (2, None)])).collect()
    assert all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in blank)


# 7 embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS component", "2 AS id", "3 AS n")


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(1)
    rows = []
    for c in range(60):
        base = r.standard_normal(32)
        for _ in range(1 if c % 3 else 25):
            v = (base + r.standard_normal(32) * r.choice([0.02, 0.12, 0.2])).astype(np.float32)
            rows.append((len(rows), v.tolist(), c % 4))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(3)]  # equal vectors
    got = by_id(embdedup.near_duplicates(vectors(spark, rows)), "vec_id")
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([v[2] for v in rows])[:, None] == np.array([v[2] for v in rows])[None])
    np.fill_diagonal(near, False)
    want = groups([(i, j) for i, j in zip(*np.nonzero(near)) if i < j], range(len(rows)))
    assert sum(g["n_links"] for g in got.values()) >= 0.99 * near.sum()
    assert all(g["n_links"] <= near[i].sum() for i, g in got.items())
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.99 * len(want)
    assert all(g["kept"] == (i == g["component_id"]) for i, g in got.items())


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, -0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0], 2), (2, [2.0, 0.0], 1)]
    got = embdedup.near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[1]["n_links"] == 2 and by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(3, 12))
    assert embdedup.near_duplicates(vectors(spark, [])).count() == 0
    same = embdedup.near_duplicates(vectors(spark, [(i, [1.0, 2.0], 1) for i in range(50)])).collect()
    assert all(r["n_links"] == 49 and r["component_id"] == 0 for r in same)


# 8 BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_as_the_library(odd, nothing, documents, tokenizer, spark):
    r = random.Random(3)
    rows = [(20 + i, "".join(r.choice("abcdeé 日!'\n1") for _ in range(300))) for i in range(40)] + [(1, "don't we'll <|endoftext|> it's"), (2, "a" * 3000), (3, None)]
    for docs in (documents(rows), odd):
        got, ids = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}, bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
        for x in docs.collect():
            want = tokenizer.encode_ordinary(x["text"] or "")
            g = got[x["doc_id"]]
            assert g["n_tokens"] == len(want) and g["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert g["decoded_sha256"] == hashlib.sha256((x["text"] or "").encode()).hexdigest()
        back = bpe.decode(ids, RANKS)
        assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_by_higher_order_functions(spark, tokenizer):
    ranks = bpe.read_ranks(RANKS)
    words = ["hello", " tokenization", "ntanti", "日本", "é", "x", "", None, " the", "abcabcabcabc"]
    got = {r["word"]: r["ids"] for r in bpe.word_tokens(spark, spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()}
    assert all(got[w] == (bpe.merge(w.encode(), ranks) if w else []) for w in words)


# 9 substring dedup


def plain_units(text):
    """(place of the first word, behind the last, words) of lines and paragraphs, by loops over words."""
    lines = [x.split() for x in text.lower().split("\n")]
    words = [w for x in lines for w in x]
    n, found, at, begins = len(words), set(), 0, set()
    if n < 5:
        return []
    for x in lines:
        begins.add(at)
        if len(x) >= 5:
            found.add((at, at + len(x)))
        at += len(x)
    begins |= {i + 1 for i, w in enumerate(words) if w[-1] in ".!?…"}
    crc = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] + [0]
    rank = [(i not in begins, ((crc[i] * 0x9E3779B97F4A7C15 + crc[i + 1] * 0xC2B2AE3D27D4EB4F) % 2**64) >> 8) for i in range(n)]
    first = lambda k: sorted({min(range(i, i + min(k, n)), key=lambda p: (rank[p], p)) for i in range(n - min(k, n) + 1)})
    cuts = [*first(9), n]
    for i in first(16):
        end = [c for c in cuts if c >= i + 16]
        if end:
            found.add((i, end[0]))
    return [(i, j, tuple(words[i:j])) for i, j in sorted(found)]


def brute_dedup(rows):
    """For each row the places of words that go: those in a unit that an earlier row, or the row before, has."""
    first = {}
    for i, t in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        for _, _, h in plain_units(t or ""):
            first.setdefault(h, i)
    out = {}
    for i, t in rows:
        seen, gone = set(), set()
        for a, b, h in plain_units(t or ""):
            if first[h] != i or h in seen:
                gone |= set(range(a, b))
            seen.add(h)
        out[i] = gone
    return out


def places(text, spans):
    """The places of the words inside spans of code points."""
    return {k for k, m in enumerate(re.finditer(r"\S+", text)) if any(s["start"] <= m.start() and m.end() <= s["end"] for s in spans)}


def test_repeats_find_any_run_of_51_words(documents):
    """Whatever precedes and follows it, with and without full stops."""
    r = random.Random(21)
    words = lambda n, stop: " ".join(f"{r.randrange(10**6)}x" + "." * (stop and r.random() < 0.1) for _ in range(n))
    rows, passages = [], []
    for i in range(0, 400, 2):
        stop = i % 4 == 0
        passages.append(words(51, stop))
        rows += [(i + k, f"{words(r.randrange(80), stop)} {passages[-1]} {words(r.randrange(80), stop)}") for k in (0, 1)]
    out = by_id(linededup.without_repeats(documents(rows).repartition(5)))
    for i, t in rows:
        inside = places(t, out[i]["spans"])
        assert inside == brute_dedup([(j, u) for j, u in rows if j // 2 == i // 2])[i]
        at = t.split().index(passages[i // 2].split()[0])
        assert i % 2 == 0 and not inside or i % 2 and len(inside) >= 16 and inside <= set(range(at, at + 51))
    assert sum(len(places(t, out[i]["spans"])) for i, t in rows) > 0.65 * 51 * len(passages)


def test_repeats_of_null_and_repeated_keys(documents):
    line = "This line is printed at the foot of many pages"
    rows = [(None, f"{line}\nnull one has words"), (None, f"{line}\nnull two has words"), (3, line), (3, line), (3, f"three\n{line}"), (-(1 << 63), f"least\n{line}")]
    out = [r["text"] for r in linededup.without_repeats(documents(rows).repartition(3)).collect()]
    assert sum(line in t for t in out) == 1 and sorted(len(t.split()) for t in out)[:2] == [0, 0]


def test_repeats_against_a_table_of_units(documents):
    r = random.Random(11)
    passage = "It begins here with some words of its own. " + " ".join(f"Sentence {n} of the passage has a few words." for n in range(8)) + " It ends there."
    line = "This line is printed at the foot of many pages"
    rows = []
    for i in range(120):
        lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(3, 30))) + "." for _ in range(r.randrange(1, 8))]
        if i % 5 == 0:
            lines[-1] += " " + passage  # behind other words of its line
        if i % 4 == 0:
            lines.insert(0, line)
        rows.append((i, "\n".join(lines)))
    out = by_id(linededup.without_repeats(documents(rows)))
    want = brute_dedup(rows)
    assert {i: places(t, out[i]["spans"]) for i, t in rows} == want
    assert all(out[i]["text"].split() == [w for k, w in enumerate(t.split()) if k not in want[i]] for i, t in rows)
    assert sum("Sentence 3 of the passage" in o["text"] for o in out.values()) == 1 and "Sentence 3" in out[0]["text"]
    assert sum(line in o["text"] for o in out.values()) == 1
    for i, t in rows:
        if i % 5 and i % 4:
            assert out[i]["text"] == t and out[i]["spans"] == []
        for s in out[i]["spans"]:
            assert t[s["start"] : s["end"]].strip() == t[s["start"] : s["end"]]


def test_repeats_inside_a_text():
    t = "alpha beta gamma delta epsilon zeta\nother words that are here only once\nalpha beta gamma  DELTA epsilon zeta\n"
    got, spans, n = linededup.cut(t, set())
    assert got == "alpha beta gamma delta epsilon zeta\nother words that are here only once\n" and len(spans) == 1


def test_repeats_odd_rows(odd, nothing):
    got = linededup.without_repeats(odd).collect()
    assert len(got) == odd.count() and linededup.without_repeats(nothing).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[4]["text"].startswith("One two three")
    assert by[5]["text"] == "" and len(by[6]["text"]) <= 150_000
    assert set(odd.columns) <= set(linededup.without_repeats(odd).columns)


# 10 language model


def plain_automaton(texts, strength=(1000.0, 10.0)):
    """A backoff automaton in dicts, and a walk through it: (probability of a word after words, score of a text)."""
    grams = Counter()
    for t in texts:
        w = ["<s>", *t.encode().lower().split(), b""]
        for n in (1, 2, 3):
            grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n > 1 or i)
    total, words = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    seen = lambda h: len(texts) if h == ("<s>",) else grams[h]

    def probability(h, w):
        if not h:
            return (grams[(w,)] + 1) / (total + words + 1)
        m = strength[len(h) - 1]
        lower = probability(h[1:], w)
        if not seen(h):
            return lower
        return (grams[(*h, w)] + m * lower) / (seen(h) + m)

    def score(t):
        state, out = ("<s>",), 0.0
        for w in [*t.encode().lower().split(), b""]:
            out += math.log10(probability(state, w))
            state = (*state, w)[-2:]
        return out

    return grams, probability, score


def test_scores_against_a_plain_automaton(documents, monkeypatch):
    r = random.Random(12)
    rows = [(i, prose(r, r.randrange(1, 50)) + f" once upon a time rare{i % 40} rarer{i}") for i in range(250)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, ""), (2001, "one"), (2002, "x y " * 500)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    learnt = [t for i, t in rows if i not in held]
    _, _, score = plain_automaton(learnt)
    c = Counter(w for t in learnt for w in ngramlm.tokens(t))
    n, v = sum(c.values()), len(c)
    for block, ranges in ((16_000_000, 6_000_000), (3000, 4000)):  # one block and range, and many
        monkeypatch.setattr(ngramlm, "BLOCK", block)
        monkeypatch.setattr(ngramlm, "RANGE", ranges)
        got = by_id(ngramlm.scores(documents(rows).repartition(3)))
        assert len(got) == len(rows)
        for i, t in rows:
            ws, g = ngramlm.tokens(t), got[i]
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(g["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            assert math.isclose(g["score"], score(t), rel_tol=1e-9)


def test_probabilities_of_a_state_add_up_to_one():
    r = random.Random(2)
    grams, probability, _ = plain_automaton([prose(r, r.randrange(1, 12)) for _ in range(100)])
    words = [g[0] for g in grams if len(g) == 1]
    for h in [(), ("<s>",), *r.sample([g for g in grams if 0 < len(g) < 3 and g[-1] != b""], 20)]:
        assert math.isclose(sum(probability(h, w) for w in words) + probability(h, b"never seen"), 1.0, rel_tol=1e-9)


def test_random_words_score_below_text(documents):
    r = random.Random(5)
    rows = [(i, prose(r, 40)) for i in range(400)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    noise = [i for i in range(10_000, 10_300) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows += [(i, " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(40))) for i in noise]
    got = by_id(ngramlm.scores(documents(rows)))
    each = lambda ids: [got[i]["score"] / got[i]["n_tokens"] for i in ids]
    assert max(each(noise)) < min(each(held))


def test_texts_that_occur_twice_score_above(documents):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(60))) for i in range(600)]
    rows += [(5000 + i, rows[i][1]) for i in range(30)]
    got = by_id(ngramlm.scores(documents(rows)))
    learnt = lambda i: not got[i]["held_out"]
    twice = [got[i]["score"] for i in range(30) if learnt(i) and learnt(5000 + i)]
    once = [got[i]["score"] for i in range(30, 600) if learnt(i)]
    assert min(twice) > max(once)


def test_count_packing():
    for a in ([], [0], [1, 2, 1 << 63], list(range(1000))):
        x = np.array(a, np.uint64)
        assert ngramlm._unpack(b"..." + ngramlm._pack(x), 3)[0].tolist() == a


def test_scores_odd_rows(odd, nothing):
    got = ngramlm.scores(odd).collect()
    assert len(got) == odd.count() and ngramlm.scores(nothing).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1


# the pipeline


def test_pipeline_stages(spark, documents, tmp_path, tokenizer):
    import corpus_pipeline as pipeline

    docs, labels = toxic_corpus(documents, spark, 400)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(docs.where("doc_id < 50").select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars")).union(documents([(5000, None), (5001, "")]).select("doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "mixing", "encoding"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append(at.count())
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    left = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()}
    assert len(toxic & left) < 0.1 * len(toxic) and len(left) > 0.6 * docs.count()
    one = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert one.where("doc_id between 1000 and 1049").count() == 0 and one.select("doc_id").distinct().count() == one.count()
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    want = Counter((r["doc_id"], tuple(tokenizer.encode_ordinary(r["text"] or ""))) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in at.collect()) == want
    assert pipeline.run(spark, str(tmp_path)).count() == seen[-1]
