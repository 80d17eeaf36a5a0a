from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from docloom.llm import bpe, mpeg_audio, token_output, winnow
from docloom.llm.graph import local_components
from docloom.llm.packing import CAPACITY, Plan, _Lengths, make_plan, pack, reduce_by_dominance
from docloom.llm.simhash_golay import drop_near_duplicates, fingerprints, fuzzy_keys, golay_home, links, near_duplicates
from docloom.llm.textcore import buffers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "Hello  World again"), (1, "Hello  World again"), (2, None), (3, ""), (4, "hello world again"), (None, "it's we're 'll <|endoftext|> é日本   x"), (5, "word " * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_ids_equal_the_library(tokenizer):
    random.seed(1)
    marks = "ab'sretvlmd  \n\t\r12é ñ ß“”…—日本😀̀Ⅳ A.,!?"
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> hi", "it's we're 'rest  'll\n'd '", "", "a", "\U0001fae8 x"]
    coder = bpe.ColumnBpe(bpe.tokenizer_path(), capacity=500)  # small: the cache is emptied on the way
    at = 0
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        ids, counts = coder.encode(*buffers(pa.array(part)))
        at = 0
        for t, n in zip(part, counts, strict=True):
            assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            at += n


def test_full_cache_keeps_what_is_met_often(tokenizer):
    coder, learned = bpe.ColumnBpe(bpe.tokenizer_path(), capacity=300), []
    learn, coder._learn = coder._learn, lambda new: learned.extend(new) or learn(new)
    often = [f" often{'abcdefgh'[i % 8] * (i + 1)}" for i in range(50)]
    for k in range(40):
        text = "".join(often) + "".join(f" rare{chr(97 + k % 26)}{'xy'[k // 26]}{'z' * i}" for i in range(40))
        ids, counts = coder.encode(*buffers(pa.array([text])))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        assert len(coder.known) <= 300
    assert len(learned) == 50 + 40 * 40 and all(learned.count(p.encode()) == 1 for p in often)


def test_pieces_of_other_vocabularies(tokenizer, tmp_path):
    texts = ["it's  ÿ\x00ÿÿ Ā日本 é", "", " a\n\nb 123", "<|endoftext|>ÿ"]
    setup = json.loads(tokenizer.to_str())
    setup["model"]["vocab"]["ÿÿ"] = 50_257
    setup["model"]["merges"].append(["ÿ", "ÿ"])
    (path := tmp_path / "other.json").write_text(json.dumps(setup))
    for p, joined in ((bpe.tokenizer_path(), True), (str(path), False)):
        coder, own = bpe.ColumnBpe(p), Tokenizer.from_file(p)
        assert (coder.letters is not None) == joined
        ids, counts = coder.encode(*buffers(pa.array(texts)))
        found = [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(found, []) and counts.tolist() == [len(x) for x in found]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("top", [1, 300, 50_257, 2**32 - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    ids[:1] = 4_000_000_000
    raw = token_output.write_segment(ids, np.array([n]), pa.array([None], pa.int64()))
    got, counts, docs = token_output.read_segment(raw)
    assert (got == ids).all() and counts.tolist() == [n] and docs.null_count == 1


def test_token_output(spark, odd, tokenizer):
    got = token_output.token_output(odd).collect()
    assert len(got) == len(ODD)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    five = next(r for r in got if r["doc_id"] == 5)
    ids = np.array([*tokenizer.encode("word " * 5000, add_special_tokens=False).ids, 2], "<u4")
    assert (five["n_tokens"], five["ids_crc32"]) == (len(ids), bpe.crc32(ids))
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert token_output.token_output(odd.limit(0)).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_never_costs_a_sequence():
    rng = np.random.default_rng(0)
    for _ in range(120):
        items = rng.integers(1, 21, rng.integers(1, 10)).tolist()
        histogram = {x: items.count(x) for x in items}
        plan, left = Plan(20), _Lengths(dict(histogram))
        reduce_by_dominance(plan, left)
        rest = [x for x, n in left.count.items() for _ in range(n)]
        assert plan.sequences + (fewest(rest, 20) if rest else 0) == fewest(items, 20)
        whole = make_plan(histogram, 20)
        held = {}
        for length, _, many, first, offset in whole.rows:
            for k in range(many):
                held.setdefault(first + k, []).append((offset, length))
        for places in held.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 20


def test_pack(odd, tokenizer):
    rows = pack(odd.repartition(3)).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= CAPACITY
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert all(n == CAPACITY for _, _, n in long[1:]) and long[0][2] <= CAPACITY and [s for _, s, _ in long] == [0, *np.cumsum([n for _, _, n in long])[:-1].tolist()]
    assert pack(odd.limit(0)).count() == 0


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints():
    texts = [t for _, t in ODD] + [" \n", "One", "a\tb  c D", "É x\x0by"]
    assert fingerprints(*buffers(pa.array(texts))).tolist() == [slow_fingerprint(t) for t in texts]


def test_golay_codes_reach_every_neighbour():
    home = golay_home()
    assert len(np.unique(home)) == 4096 and np.bincount(home).min() == np.bincount(home).max() == 2048
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    other = base.copy()
    for k in range(len(base)):
        for bit in rng.choice(64, 3, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(bit)
    keys = lambda x: [set(fuzzy_keys(x[i : i + 1])[1].tolist()) for i in range(len(x))]
    assert all(a & b for a, b in zip(keys(base), keys(other), strict=True))


@pytest.mark.parametrize("block", [2048, 3])
def test_links_against_brute_force(spark, block):
    from docloom.llm.graph import connected_components

    rng = np.random.default_rng(1)
    bits = set()
    for b in rng.integers(0, 2**63, 10, dtype=np.uint64).tolist():
        for _ in range(25):
            x = b
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            bits.add(x)
    fps = np.sort(np.array(sorted(bits), np.uint64).view(np.int64))
    u, v = np.nonzero(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]) <= 3)
    want = dict(zip(fps.tolist(), fps[local_components(len(fps), u, v)].tolist(), strict=True))
    found = dict(map(tuple, connected_components(links(spark.createDataFrame([(x,) for x in fps.tolist()], "fp long"), 3, block)).collect()))
    assert {x: found.get(x, x) for x in fps.tolist()} == want


def test_near_duplicates(odd):
    rows = {(r["doc_id"], r["component_id"]) for r in near_duplicates(odd).collect()}
    assert rows == {(1, 1), (4, 1), (2, 2), (3, 2), (5, 5), (None, None)}
    kept = [r["doc_id"] for r in drop_near_duplicates(odd).collect()]
    assert sorted(kept, key=str) == [1, 2, 5, None]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(300)) for c in "xyz")
    rows = [(5, x), (5, y), (3, y.upper()), (None, x), (None, z), (None, z), (None, z.upper()), (7, "other words here"), (7, "not the same at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"].lower()) for r in kept.collect()), key=str) == sorted([(5, x), (3, y), (None, z), (7, rows[7][1]), (7, rows[8][1])], key=str)


def slow_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n and i is not None else set()
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                ids.add(i)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("item_bytes", [winnow.ITEM_BYTES, 0])
def test_decontamination_against_brute_force(spark, item_bytes):
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(rng.choice(["aa", "Bb", "c1", "dé", "é"], n))
    docs = [(i, say(rng.integers(0, 60))) for i in range(120)] + [(200, None), (201, "-- !"), (200, None)]
    items = [(i, say(rng.integers(0, 25))) for i in range(25)] + [(None, say(3)), (3, say(20)), (90, None)]
    got = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), item_bytes).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *slow_hits(t, items)) for i, t in docs)


@pytest.mark.parametrize("item_bytes", [winnow.ITEM_BYTES, 0])
def test_contaminated_rows_go_whatever_their_id(spark, item_bytes):
    leak = " ".join(f"w{i}" for i in range(20))
    rows = [(None, leak), (None, "clean one"), (5, leak), (5, "clean two"), (5, None), (6, leak + " more"), (7, "clean three"), (7, "clean three")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = winnow.drop_contaminated(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"), item_bytes)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[k] for k in (1, 3, 4, 6, 7)], key=str)


def test_decontamination_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in winnow.decontaminate(odd, none).collect()} == {0}
    assert winnow.decontaminate(odd.limit(0), none).count() == 0
    assert winnow.drop_contaminated(odd, none).count() == len(ODD)


def test_audio_round_trip_and_resync(odd):
    for n in (64, 640, 1344, 12_800, 122_880):
        payload = random.randbytes(n)
        stored = mpeg_audio.carry(payload)
        s = mpeg_audio.parse(stored)
        assert mpeg_audio.carried(stored, s) == payload and s.crc_failed == 0 and s.skipped == 0 and s.table_frames == len(s.frames) - 1
        body = stored[s.frames[0][0] :]
        again = mpeg_audio.parse(b"junk\xff\xfb\0" * 3 + body + b"TAG" + b"song".ljust(125, b"\0"))
        assert len(again.frames) == len(s.frames) and again.skipped == 21 and again.tags == {"v1:title": "song"}
    broken = bytearray(body)
    broken[8] ^= 1
    assert mpeg_audio.parse(bytes(broken)).crc_failed == 1
    assert mpeg_audio.parse(b"").frames == [] and mpeg_audio.parse(b"no audio").skipped == 8
    rows = mpeg_audio.media_column(odd).collect()
    for r in rows:
        text = (dict(ODD[2:])[r["doc_id"]] if r["doc_id"] != 1 else ODD[0][1]) or ""
        padded = text.encode().ljust(max(64, -(-len(text.encode()) // 64) * 64), b"\0")
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["n_bytes"] == len(text.encode()) and r["payload_bytes"] == len(padded)
    assert mpeg_audio.media_column(odd.limit(0)).count() == 0
