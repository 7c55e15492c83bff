"""Quality rules, mixing, packing, counting, languages and main text."""

import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curalake.llm import counting, extract, langid, mixing, packing, quality, tokens
from llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    None, "", " ", "a  b", "\n\n x", "don't I'll 's", "x_y __ 12ab", "é²³ ½", "<|endoftext|> a", "\xa0 a\xa0\xa0b", "日本 語", "\x1c a", "ａ１", "¿qué? ª º µ", "a\tb\r\n  ",
    "||| ### $$$", "x" * 30_000, "wort " * 5_000,
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


def odd_docs(spark):
    return frame(spark, [(i, t, [None, "en"][i % 2], [None, "s", "t"][i % 3]) for i, t in enumerate(ODD)] + [(None, "some words here", "de", "s"), (1, "", "en", "s")])


def test_base_counts(spark, texts):
    for t in [*texts, *ODD, "a b c a b c", "a a a a", "a b c d", "l\nl\n \nl", "a b a b a"]:
        n, chars, symbols, lines, repeats, _ = quality.text_measures(t)
        failed = n < 50 or 100 * repeats > 50 * n
        assert (n, chars, symbols, lines, repeats, failed) == brute.quality(t)


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(1)
    clean = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 900)) for _ in range(k))
    rows = [(i, clean(80 + i % 60), "en", "a") for i in range(300)]
    rows += [(300 + i, " ".join(w + "###" for w in clean(80).split()), "en", "a") for i in range(60)]  # junk in a clean source
    rows += [(400 + i, " ".join(w + "|" for w in clean(80).split()), "en", "tables") for i in range(300)]  # a source of tables keeps its own level
    rows += [(800, None, "en", "a"), (801, "short", None, None), (802, clean(90), None, None)]
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    assert all(out[i] == (False, True) for i in range(300))
    assert all(out[i] == (False, False) for i in range(300, 360))
    assert all(out[i] == (False, True) for i in range(400, 700))
    assert out[800] == out[801] == (True, False) and out[802] == (False, True)
    kept = quality.quality_filter(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in out.items() if x[1]}


def test_quality_fences_follow_the_upper_quantiles(spark):
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 900)) for _ in range(k))
    lines = lambda n, dup: "\n".join(x for k in range(n - dup) for x in [words(8), *(["--"] if k <= dup and dup else [])])  # noqa: E731  n - dup + 1 distinct
    rows = [(i, "\n".join(words(8) for _ in range(11)), "en", "plain") for i in range(300)]
    rows += [(300, lines(20, 9), "en", "plain"), (301, lines(12, 1), "en", "plain")]
    rows += [(302, " ".join(w + ("#" if k % 5 == 0 else "") for k, w in enumerate(words(90).split())), "en", "plain")]  # about 3 % symbols
    rows += [(400 + i, lines(20, 8 + i % 3), "en", "lists") for i in range(300)]  # a source of lists keeps its own level
    docs = frame(spark, rows)
    measured = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert not any(r["base_failed"] for r in measured.values())
    assert all(measured[i]["kept"] for i in range(300)) and all(measured[400 + i]["kept"] for i in range(300))
    assert measured[300]["n_dup_lines"] == 9 and not measured[300]["kept"]
    assert measured[301]["n_dup_lines"] == 1 and measured[301]["kept"]
    assert not measured[302]["kept"]


def test_quality_of_odd_tables(spark):
    assert quality.quality_verdicts(odd_docs(spark)).count() == len(ODD) + 2
    assert quality.quality_verdicts(frame(spark, [])).count() == 0 and quality.quality_filter(frame(spark, [])).count() == 0
    extra = odd_docs(spark).selectExpr("*", "1 AS lang_key", "2 AS symbols_upper", "3 AS _measures", "4 AS n_words")
    assert quality.quality_filter(extra).columns == extra.columns


def test_joined_by_salt_gives_the_same(spark):
    docs = odd_docs(spark)
    from curalake.llm import common

    table = spark.createDataFrame([("=s", 1), ("=t", 2), ("", 3)], "k string, v int")
    keyed = docs.withColumn("k", common.null_key(F.col("source")))
    plain = sorted((r["doc_id"] or -1, r["v"]) for r in common.attach(keyed, table, ["k"], F.col("doc_id")).collect())
    assert plain == sorted((r["doc_id"] or -1, r["v"]) for r in common.attach(keyed, table, ["k"], F.col("doc_id"), limit=0).collect())


def poisson_count(u, rate):
    k, log_p = 0, -rate
    upto = math.exp(-rate)
    while u >= upto:
        k += 1
        log_p += math.log(rate) - math.log(k)
        upto += math.exp(log_p)
    return k


def test_poisson_counts_and_weights(spark):
    import hashlib

    docs = frame(spark, [(i, "x" * (50 + i % 7), "en", "big" if i % 10 else "small") for i in range(4000)])
    sizes = {r["source_key"]: (r["size"], r["rate"]) for r in mixing.source_rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    total = sum(s for s, _ in sizes.values())
    assert all(abs(s * r - total / 2) < 1e-6 * total for s, r in sizes.values())
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0}).collect()
    counts = defaultdict(int)
    for r in out:
        counts[r["doc_id"]] += 1
    for i in range(4000):
        u = int(hashlib.md5(f"{mixing.SEED}:={i}".encode()).hexdigest()[:13], 16) / 2**52
        assert counts[i] == poisson_count(u, sizes["=big" if i % 10 else "=small"][1])
    small = sum(len(r["text"]) for r in out if r["source"] == "small")
    assert abs(small / sum(len(r["text"]) for r in out) - 0.5) < 0.05
    assert len({(r["doc_id"], r["copy_no"]) for r in out}) == len(out) == len({r["shuffle_key"] for r in out})


def test_mixing_of_odd_tables(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs, {"s": 3.0}, epochs=2.0)
    assert {r["source"] for r in out.collect()} <= {"s"}
    assert mixing.mix(docs, epochs=200.0).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mix(frame(spark, [])).count() == 0
    plain = sorted((r["doc_id"] or -1, r["copy_no"]) for r in mixing.mix(docs, epochs=3.0).collect())
    wide = docs.selectExpr("*", "'x' AS COPY_NO", "'y' AS shuffle_key", "1 AS _cdf", "2 AS _copies", "3 AS _source_key", "4 AS rate", "5 AS one")
    out = mixing.mix(wide, epochs=3.0)
    assert out.columns == [*wide.columns, "_copy_no", "_shuffle_key"]
    assert sorted((r["doc_id"] or -1, r["_copy_no"]) for r in out.collect()) == plain
    assert out.select("COPY_NO", "shuffle_key", "_cdf", "_copies", "_source_key", "rate", "one").distinct().collect() == [("x", "y", 1, 2, 3, 4, 5)]


def test_ids_equal_the_tokenizer(texts):
    coder = tokens.PreTokenEncoder(tokens.vocabulary_path())
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    every = [*ODD, *texts, *["a'b 's x'll", "a\u2028b", "ｘ", "\u0301a"]]
    expected = [np.array(plain.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in every]
    assert coder.ids_of(every) == expected
    coder.ranks = None
    coder._reset()
    assert coder.ids_of(every) == expected


def test_packing_covers_every_id_once(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *ODD])] + [(None, "a b", "en", "s")]
    out = packing.pack_documents(frame(spark, rows).repartition(3)).collect()
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    pieces, sequences, groups = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        groups[r["step_group"]].add(r["tier"])
    for i, t, _, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["tier"] and at & (at - 1) == 0 and at <= 2048
    assert all(len(t) == 1 for t in groups.values())
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packer_keeps_short_ends_few():
    rng = random.Random(4)
    for _ in range(30):
        packer, sizes = packing.Packer(), []
        for batch in range(5):
            for _ in range(rng.randint(0, 40)):
                sizes.append(rng.choice([1, 2047, 2048, 2049, rng.randint(1, 9000)]))
                packer.add(len(sizes) - 1, sizes[-1])
            packer.pack(batch == 4)
        assert sum(w[0] for w in packer.windows) == sum(sizes)
        assert sum(w[0] < 256 for w in packer.windows) <= 8


def test_edits_equal_a_full_count(texts):
    coder = tokens.PreTokenEncoder(tokens.vocabulary_path())
    rng = random.Random(7)
    for t in [*texts[:80], *[x for x in ODD if x]]:
        chars, sums = counting.build_tree(coder, t)
        assert sums[0] == coder.count(t) and sum(chars) == len(t)
        spots = sorted(rng.randint(0, len(t)) for _ in range(2 * rng.randint(1, 5)))
        edits = [(a, b if rng.random() < 0.5 else a, rng.choice(["", "x", " ", "[private]", "12\n", "\n ", "'s", "½"])) for a, b in zip(spots[::2], spots[1::2], strict=True)]
        new, chars, sums, encoded = counting.apply_edits(coder, t, chars, sums, edits)
        expected = t
        for a, b, x in reversed(edits):
            expected = expected[:a] + x + expected[b:]
        assert new == expected and sum(chars) == len(new) and sums[0] == coder.count(new)
        again = counting.apply_edits(coder, new, chars, sums, [(0, min(3, len(new)), "Z")])
        assert again[2][0] == coder.count(again[0])


def test_edits_touch_little(texts):
    coder = tokens.PreTokenEncoder(tokens.vocabulary_path())
    t = " ".join(texts[:20]).replace("'", " ")
    _, _, _, encoded = counting.apply_edits(coder, t, *counting.build_tree(coder, t), [(len(t) // 2, len(t) // 2 + 3, "x")])
    assert encoded < 4 * 64 * 12 < len(t)


def test_edited_counts_query(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *ODD, "mail me at a.b@c.org or +1 (389) 555-5010 now"])]
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    count = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids)
    for r in counting.edited_counts(frame(spark, rows).withColumn("tree", F.lit(1))).collect():
        t = rows[r["doc_id"]][1]
        assert (r["n_tokens"], r["n_tokens_after"]) == (count(t), count(counting.PRIVATE.sub(counting.INSTEAD, t or "")))
    assert counting.edited_counts(frame(spark, [])).count() == 0


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs.unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1_000_000)))
    rows = {r["doc_id"]: r for r in out.collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(rows[1_000_000 + k]["lang_pred"] == "und" for k in (0, 1, 2, 15))
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_languages_without_labels(spark):
    docs = frame(spark, [(i, "some text", None, "s") for i in range(9)])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert langid.identify(frame(spark, [])).count() == 0


def test_temperature_and_sparse_weights():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(500, 3))
    classes = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.temperature(logits * 5, classes) - 5) < 1.5
    z, n = langid.ftrl_pass([(0, np.array([1, 2]), np.array([0.6, 0.8])), (1, np.array([3]), np.array([1.0]))] * 20, np.zeros((2, 8)), np.zeros((2, 8)))
    w = langid.ftrl_weights(z, n)
    assert w[0, 1] > 0 > w[0, 3] and not w[:, [0, 4, 5, 6, 7]].any()


PAGES = [
    "<html><body><div id='top-bar' class='header'><p>Site</p></div><nav><ul><li><a href=/a>A</a></ul></nav><div class=cookie-notice><p>We use cookies on this site.</p></div>"
    "<div class='layout'><div class='post-content'><h1>Ti&amp;tle</h1><p>First  para\n graph with <b>bold</b> words, and more of them here.<p>Second paragraph, longer than the first one by some words."
    "<div class='ad'>Buy now</div><p>Third paragraph ends it, with &eacute; and &#8212; in it.</p></div><aside class=sidebar><h3>Popular</h3><ul><li><a href=b>Other story</a></ul></aside></div>"
    "<section class='comments'><div class=comment><p>Nice article, I liked the second paragraph.</p></div></section><form><label>Mail</label><input name=m><p>Subscribe</p></form>"
    "<footer>&copy; 2024</footer><script>var x='<p>no</p>'</script></body></html>",
]


def test_main_text_of_other_layouts(spark):
    trees = extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    expected = "Ti&tle\nFirst para graph with bold words, and more of them here.\nSecond paragraph, longer than the first one by some words.\nThird paragraph ends it, with é and — in it."
    assert extract.main_text(PAGES[0], trees) == expected
    good = total = 0
    words = lambda t: set(t.split("\n"))
    source = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()]
    for k, page in enumerate(source):
        inner, outer = extract.weak_blocks(extract.Page(page))
        new = extract.Page(extract.layout(inner, outer, random.Random(f"held-out {k}")))
        gold = extract.gold_labels(new)
        want, got = words("\n".join(t for o, t in new.blocks if gold[o])), words(new.text(new.decode(trees.odds(new.features()))))
        good += len(want & got)
        total += (len(want) + len(got)) / 2
    assert good / total > 0.93


def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r for r in extract.main_texts(pages).collect()}
    for r in pages.collect():
        inner, _ = extract.weak_blocks(extract.Page(r["html"]))
        assert out[r["page_id"]]["text"] == "\n".join(inner) and out[r["page_id"]]["n_chars"] == len("\n".join(inner))


def test_no_contradiction_along_the_tree():
    rng = np.random.default_rng(3)
    page = extract.Page(PAGES[0])
    page.features()
    for _ in range(50):
        inside = page.decode(rng.normal(size=len(page.tag)) * 3)
        cut = [False] * len(page.tag)
        for v in range(1, len(page.tag)):
            p = page.parent[v]
            cut[v] = cut[p] or inside[p] and not inside[v]
            assert not (cut[v] and inside[v])


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "plain words", "<p>a<p>b", "</div></p>x", "<!-- c", "<a href='", "<script>x", "<div " * 300, "<td>a<td>b<table><tr><td>c", "&lt;b&gt; &amp;amp;"]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)], "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in extract.main_texts(pages).collect()}
    assert len(out) == len(odd) and out[0] == out[1] == ""
    assert extract.main_texts(pages.limit(0)).count() == 0


def test_main_text_outside_a_body():
    trees = extract.Trees(None, [])
    expected = {
        "plain words": "plain words", "some <b>bold</b> words": "some bold words", "bare text<p>a paragraph</p>more text": "bare text\na paragraph\nmore text",
        "<html>no body here": "no body here", "<html><head><title>t</title></head><body><p>inside it</p></body></html>after it": "inside it\nafter it",
        "early text<html><body class=x><p>inside it</p>": "early text\ninside it", "\ufeff<html><body>words</body></html>": "words",
    }
    assert {page: extract.main_text(page, trees) for page in expected} == expected
    page = extract.Page("early text<html><body class=story><p>inside it</p></body></html>late text")
    assert page.tag == ["#root", "html", "body", "p"] and page.parent == [-1, 0, 1, 2] and page.words[2] == {"story"} and [o for o, _ in page.blocks] == [2, 3, 2]
    assert extract.Page("<html><head></head>\n<body><p>x</p></body>\n</html>\n").tag == ["#root", "html", "head", "body", "p"]


def test_main_text_of_bad_markup():
    """Quotes in unquoted values, quotes that are never closed (the tag ends with the page), short comments, images in words."""
    trees = extract.Trees(None, [])
    expected = {
        "<p data-x=it's>Hello there</p><p>I don't know</p><p>end</p>": "Hello there\nI don't know\nend", '<p class="x>Hello</p><p>World</p>': "",
        '<p>first</p><p class="x>Hello</p>': "first", "<p>a</p><!--><p>b</p>": "a\nb", "<p>a</p><!---><p>b</p><!-- > --><p>c</p>": "a\nb\nc",
        "<p>wo<img src=x>rd one<br>two</p>": "word one two", "<p title = 'a > b' hidden>x</p><p a=b\"c>y</p>": "x\ny", "<p a==\">z</p>": "z", "<p a=>q</p>": "q",
    }
    assert {page: extract.main_text(page, trees) for page in expected} == expected
    assert extract.main_text("<p>" + "<b a='" * 20_000, trees) == "" and extract.main_text("<p " + "a= " * 100_000 + ">x</p>", trees) == "x"


def test_main_text_of_plain_words(spark):
    pages = spark.createDataFrame([(1, None, "plain words")], "page_id bigint, url string, html string")
    assert [r["text"] for r in extract.main_texts(pages).collect()] == ["plain words"]
