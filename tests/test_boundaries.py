"""Sentence boundaries learned from a corpus: scores against a plain count, engines, the registry, chunks."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from docloom.functions.markdown import ChunkOptions
from docloom.operators import boundaries as B
from docloom.operators import registry
from docloom.operators import text as X

NAMES = ["Marek", "Ilse", "Tomas", "Greta", "Paulo", "Signe", "Davor", "Edda"]


def _corpus():
    """(text, sentences): abbreviations that no list holds, before small and capital letters, and words that start sentences."""
    out = []
    for i in range(240):
        a, b = NAMES[i % 8], NAMES[(i // 8) % 8]
        out.append([f"The harbour of {a} has abt. {i} berths.", f"It was built by Hr. {b} long ago.", "The crane lifts 3.5 tons.", f"Then {a} left the town."])
    out += [[f"It weighs {i} lbt.", "The rest was sold.", f"Later {NAMES[i % 8]} paid 4 lbt. of salt."] for i in range(40)]
    out += [[f"The tons of salt sold in town long ago at the berths of {NAMES[i % 8]} were lost to {NAMES[i % 7]}."] for i in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(s), s) for i, s in enumerate(_corpus())]
    return spark.createDataFrame([*rows, (9000, None, []), (9001, "", [])], "doc_id long, text string, wanted array<string>").repartition(5).cache()


@pytest.fixture
def trained(docs):
    return B.trained(docs)


def _plain(docs):
    """Scores by a loop over all words."""
    dotted, plain = Counter(), Counter()
    for row in docs.collect():
        for raw in re.split(r"\s+", row["text"] or ""):
            word = re.sub(r"^[^\w]+|[^\w.]+$", "", raw)
            if re.fullmatch(r"[^\W\d_](?:(?:[^\W\d_]|\.)*[^\W\d_])?\.?", word):
                (dotted if word.endswith(".") else plain)[word.removesuffix(".").lower()] += 1
    p = sum(dotted.values()) / (sum(dotted.values()) + sum(plain.values()))
    out = {}
    for t, d in dotted.items():
        letters = len(t.replace(".", ""))
        ll = 2 * (d * (math.log(0.99) - math.log(p)) + plain[t] * (math.log(0.01) - math.log(1 - p)))
        out[t] = (d, plain[t], ll * math.exp(-letters) * (len(t) - letters + 1) * letters ** -float(plain[t]))
    return out


def test_scores_equal_a_plain_count(docs):
    got = {r["type"]: (r["dotted"], r["plain"], r["score"]) for r in B.abbreviation_scores(docs).collect()}
    want = _plain(docs)
    assert got.keys() == want.keys()
    for t, (d, p, s) in want.items():
        assert got[t][:2] == (d, p) and got[t][2] == pytest.approx(s, rel=1e-9)
    assert {t for t, x in want.items() if x[2] >= B.ABBREVIATION_SCORE} == {"abt", "hr", "lbt"}


def test_starters_follow_ends(spark, docs):
    short = spark.createDataFrame([("abt",), ("hr",), ("lbt",)], "type string")
    found = {r["type"]: r for r in B.starter_scores(docs, short).collect()}
    assert (found["the"]["after_end"], found["the"]["elsewhere"]) == (240, 40 + 240 + 60)  # "lbt. The" is no end by types alone; first words are not counted
    assert found["then"]["score"] >= B.STARTER_SCORE and "berths" not in found
    assert "marek" not in found  # after Hr. only, which ends nothing


def test_trained_beats_heuristic_on_labels(docs, trained, monkeypatch):
    monkeypatch.setitem(registry.sentence_splitters.items, "trained", trained)

    def right(name):
        return sum(list(r["sentences"]) == list(r["wanted"]) for r in X.split_sentences(docs, splitter=name).collect())

    assert right("heuristic") == 62
    assert right("trained") == right("auto") == 342


def test_joined_engine_equals_the_shipped_one(docs, trained, monkeypatch):
    joined = B.trained(docs, in_hand=0)
    assert joined.abbreviations is not None and trained.abbreviations is None
    monkeypatch.setitem(registry.sentence_splitters.items, "a", trained)
    monkeypatch.setitem(registry.sentence_splitters.items, "b", joined)
    a, b = ({r["doc_id"]: list(r["sentences"]) for r in X.split_sentences(docs, splitter=n).collect()} for n in "ab")
    assert a == b and a[9000] == a[9001] == []


def test_chunks_use_the_registered_engine(spark, trained, monkeypatch):
    text = "Cranes of abt. nine tons. Boats of abt. six tons. Carts of abt. one ton."
    doc = spark.createDataFrame([("d", text)], "source string, text string")
    cut = lambda: [r["text"] for r in X.chunks(doc, options=ChunkOptions(max_chars=20, min_chars=1, overlap=0)).orderBy("chunk_index").collect()]
    assert any(c.endswith("abt.") for c in cut())
    monkeypatch.setitem(registry.sentence_splitters.items, "trained", trained)
    assert cut() == ["Cranes of abt. nine tons.", "Boats of abt. six tons.", "Carts of abt. one ton."]


def test_unknown_engine_and_empty_corpus(spark):
    with pytest.raises(KeyError):
        registry.sentence_splitter("nothing")
    empty = spark.createDataFrame([], "doc_id long, text string")
    engine = B.trained(empty)
    assert engine.shared.abbreviations == B.ABBREVIATIONS and not engine.shared.starters
    assert B.abbreviation_scores(empty).count() == 0
