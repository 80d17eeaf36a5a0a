from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import langid_crf, quality_rules, toxicity_nnpu, url_lm, warc

SMALL = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    size = np.array([4, 2])
    post, moves, norm = langid_crf.posteriors(e, size, t, s)
    total, want, pairs = 0.0, np.zeros((2, 4, 3)), np.zeros((3, 3))
    for c, n in enumerate(size):
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([s[p[0]] + sum(e[c, k, p[k]] for k in range(n)) + sum(t[p[k - 1], p[k]] for k in range(1, n)) for p in paths])
        weight = np.exp(score) / np.exp(score).sum()
        total += np.log(np.exp(score).sum())
        for p, w in zip(paths, weight, strict=True):
            for k in range(n):
                want[c, k, p[k]] += w
            for k in range(1, n):
                pairs[p[k - 1], p[k]] += w
    assert np.allclose(post, want) and np.allclose(moves, pairs) and norm == pytest.approx(total)


def test_language_id(spark):
    docs = read(spark, "documents")
    judged = langid_crf.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(judged) and (judged.lang_pred == judged.lang).mean() >= 0.97 and judged.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 -", "de"), (None, "the thing that was", None)], "doc_id long, text string, lang string")
    model = langid_crf.fit(["the thing that was"] * 3, ["en"] * 3)
    assert [r["lang_pred"] for r in langid_crf.predict(odd, model).collect()] == ["und", "und", "und", "en"]
    assert {r["lang_pred"] for r in langid_crf.identify_languages(odd.where("lang is null")).collect()} == {"und"}
    assert langid_crf.identify_languages(docs.limit(0)).count() == 0


def test_language_sample_has_every_language(spark):
    rows = [(i, "the thing that was " * 200, "en") for i in range(3000)] + [(None, "the thing " * (5 + i % 3), "en") for i in range(90)]
    rows += [(10_000 + i, "1 " * 3000 + "qwx zyqq xqz", "rare") for i in range(8)] + [(20_000 + i, f"ñandú{i}", "one") for i in range(8)] + [(1, "12 -", "none"), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    held = [(r["lang"], r["h"]) for r in langid_crf.sample(docs, 60).collect()]
    assert {"rare", "one", "en"} == {lang for lang, _ in held} and 60 <= len(set(held)) <= 63
    model = langid_crf.train(docs, 3)
    assert model.labels == ["en", "one", "rare"]
    import pyarrow as pa

    assert langid_crf.judge(langid_crf.train(docs, 60), pa.array(["zyqq xqz qwx", "that was the thing", "ñandú"]))[0] == ["rare", "en", "one"]
    assert [langid_crf.share(c, 10) for c in ([], [2], [100, 100], [1, 100], [3] * 20)] == [0, 2, 5, 9, 1]
    assert langid_crf.TRAIN_DOCS >= 1500 and langid_crf.TRAIN_WINDOWS * langid_crf.SEQUENCE >= 1600 / 6


def test_mixed_languages_pass_the_pipeline(spark):
    words = {"aa": "alpha arrow amber", "bb": "bison broom blitz", "cc": "cedar cloud crisp", "dd": "dingo drift dwell", "ee": "ember eagle epoch"}
    rows = [(i, f"{text} " * 20, lang) for i in range(20) for lang, text in words.items()]
    mixed = " ".join(f"{text} " * 20 for text in words.values())
    docs = spark.createDataFrame([*rows, (999, mixed, None), (998, "12 -", None), (997, None, None)], "doc_id long, text string, lang string")
    score = langid_crf.identify_languages(docs).where("doc_id = 999").first()["score"]
    assert score < 0.3
    assert {r["doc_id"] for r in langid_crf.keep_identified(docs).where("doc_id > 900").collect()} == {999}


def test_toxicity(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    judged = toxicity_nnpu.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    bad = judged.toxic == 1
    assert judged[bad].score.mean() > judged[~bad].score.mean() + 0.3 and judged[~bad].predicted.mean() <= 0.1
    none = toxicity_nnpu.score_toxicity(docs.limit(5), labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.1}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x" * 100_000)], "doc_id long, text string")
    assert toxicity_nnpu.score_toxicity(odd, labels.limit(0)).count() == 3


def test_nnpu_risk_ignores_words_of_clean_text():
    rng = np.random.default_rng(0)
    plain = [np.unique(rng.integers(0, 500, 40)) for _ in range(400)]
    positive = [np.unique(np.append(x, 1000 + rng.integers(0, 3))) for x in plain[:60]]
    model = toxicity_nnpu.fit(positive, plain[60:] + positive[:10], 0.1)
    assert {1000, 1001, 1002} <= set(model.words.tolist()) and len(model.words) < 100
    assert model.weights[np.isin(model.words, [1000, 1001, 1002])].min() > np.median(model.weights)


def test_quality(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    judged = quality_rules.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((judged.score >= 0.7) == (judged.quality == 1)).mean() >= 0.95
    table, names = quality_rules.with_statistics(docs.join(labels, "doc_id"), ["doc_id", "quality"])
    data = table.toPandas()
    x = data[[f"__s_{n}" for n in names]].to_numpy(float)
    model = quality_rules.fit(x, data.quality.to_numpy(float), names)
    compiled = table.select(model.column().alias("s")).toPandas().s.to_numpy()
    assert model.rules and np.allclose(compiled, model.scores(x, names))
    odd = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [r["score"] for r in quality_rules.score_quality(odd, labels.limit(0)).collect()] == [0.5, 0.5]


def test_urls(spark):
    rows = [(1, "https://a.EXAMPLE.com/en/7x?q"), (2, "http://example.com/en/1"), (3, "https://xexample.com/en/7"), (4, "ftp://b.example.net/de/81#x"), (5, "https://example.net/de/7"), (6, None), (7, "no scheme"), (8, "http://h?x"), (9, "http://org/es/"), (9, "http://org/es/")]
    got = {r["page_id"]: r for r in url_lm.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 10)] == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/1", "com/en/"), ("xexample.com", "/en/7", "com/en/"), ("b.example.net", "/de/81", "example.net/de/8"),
        ("example.net", "/de/7", "net/de/"), ("", "", None), ("", "", None), ("h", "", None), ("org", "/es/", "org/es/"),
    ]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5, 9)] == ["allow", "block", "block", "block", "allow", "block"]
    pages = read(spark, "pages")
    assert url_lm.filter_urls(pages).count() == pages.count() and url_lm.filter_urls(pages.limit(0)).count() == 0


def test_markov_sums_to_one(spark):
    """Without rejected URLs their model is uniform, so the ratios give the accepted model's probabilities."""
    import pyarrow as pa

    window, _ = url_lm.byte_windows(pa.array(["http://a.b/c1", "http://a.c/d"]))
    seen = dict(zip(*(x.tolist() for x in np.unique(window, return_counts=True)), strict=True))
    byte, above = np.arange(url_lm.BYTES), ~np.int64(255)
    known, unknown = (window[5] & above) | byte, np.int64(12345 << 8) | byte
    rows = {int(w): 0 for w in (*known, *unknown)} | seen
    counts = spark.createDataFrame([(w, n, 0) for w, n in rows.items()], "w long, a long, b long")
    found = {r["w"]: np.exp(r["ratio"]) / url_lm.BYTES for r in url_lm.log_ratios(counts).collect()}
    for context in (known, unknown):
        assert sum(found[int(w)] for w in context) == pytest.approx(1)


def test_warc(spark):
    page = '<html lang="EN"><head><title>A &amp; B</title><style>x</style></head><body><script>no</script><p>One <b>two</b><br>three</p><!-- gone --><a href="/l">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x/", page), (2, None, None)], "page_id long, url string, html string")
    derived = warc.derivatives(warc.responses_of(pages), "page_id")
    rows = {(r["page_id"], r["record_type"]): r for r in derived.collect()}
    meta, text = rows[1, "metadata"], rows[1, "conversion"]
    assert text["content"] == "A & B\nOne two\nthree\nlink" and text["refers_to"] == meta["refers_to"] and meta["concurrent_to"] == text["record_id"]
    assert "title: A & B\r\n" in meta["content"] and "outlink: /l\r\n" in meta["content"] and "language: en" in meta["content"]
    assert text["block_digest"] == warc.digest(text["content"].encode()) and text["source_payload_digest"] == warc.digest(page.encode())
    assert text["source_headers"][0] == "HTTP/1.1 200 OK" and rows[2, "conversion"]["content"] == ""
    whole = b"".join(bytes(r["record"]) for r in warc.warc_files(derived).collect())
    back = list(warc.parse_records(whole))
    assert len(back) == 4 and all(int(dict(h)["Content-Length"]) == len(b) for h, b in back)
    assert {dict(h)["WARC-Record-ID"] for h, _ in back} == {r["record_id"] for r in rows.values()}
    assert warc.split_http(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == (["HTTP/1.1 200 OK", "A: b"], b"body")


def test_pipeline_stages(spark):
    docs = read(spark, "documents")
    extra = docs.withColumn("doc_id", F.col("doc_id") + 100_000).limit(30).unionByName(docs.limit(1).withColumn("text", F.lit("123")).withColumn("doc_id", F.lit(999_999).cast("long")))
    kept = docs.unionByName(extra)
    before = {r["doc_id"] for r in kept.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, SMALL)
        assert kept.columns == docs.columns
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before, name
        if name == "language_id":
            assert 999_999 not in after
        if name == "simhash_near_dedup":
            assert not any(i >= 100_000 for i in after)
        before = after
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
