"""Context mixing: counts against plain ones, probabilities that add up, and better predictions of held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("watchloom.llm")
from watchloom.llm import mixlm  # noqa: E402


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of (id, text) rows."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(t for (i, x), h in zip(docs, held, strict=True) if i is not None and not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for (i, x), h in zip(docs, held, strict=True)]


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(9)
    tongues = [[f"{a}{b}{c}" for a in x for b in y for c in z] for x, y, z in (("the qu on".split(), "a e".split(), "rk sh nt l".split()), ("ł ö".split(), "uu ii".split(), "zz kk m pp".split()))]
    rows = []
    for i in range(260):
        own = tongues[i % 2]
        rows.append((i, " ".join(rnd.choice(own[: 4 + len(own) // (1 + rnd.randrange(3))]) for _ in range(rnd.randint(5, 80)))))
    return [*rows, (1001, None), (1002, ""), (1003, " \n "), (1004, "Ab\x1cc " * 30), (1005, "x" * 5000 + " y"), (None, "theark quesh"), (7, rows[7][1]), (7, rows[7][1]), (1006, "word " * 4000)]


def test_scores_of_a_table(spark, docs):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, score string, block int")
    got = mixlm.lm_scores(frame, tokens=3000).toPandas()
    by = lambda r: tuple((x is None or x != x, x) for x in r[:4])
    mine = sorted(([None if x != x else x for x in r] for r in got.itertuples(index=False)), key=by)
    for a, b in zip(mine, sorted(plain(docs), key=by), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert np.isfinite(got["score"]).all() and (got["score"] < 0).all()
    held = got[got["held_out"]]
    assert len(held) > 20 and held["score"].sum() > 0.95 * held["base_score"].sum() and (held["score"] > held["base_score"]).mean() > 0.7
    assert got["bits_per_byte"].to_numpy() == pytest.approx([-s * math.log2(10) / sum(len((t or "").encode()) + 1 for t in tokens(x)) for s, x in zip(got["score"], _texts(got, docs), strict=True)])
    assert got[got["doc_id"] == 7]["score"].nunique() <= 2


def _texts(got, docs):
    of = {i: x for i, x in docs}
    return [of[None if k != k else int(k)] for k in got["doc_id"]]


def test_empty_and_untaught_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert mixlm.lm_scores(none).collect() == []
    row = mixlm.lm_scores(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    # nothing known: every bit of "ab " and of the closing space is even
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 2) and row["bits_per_byte"] == pytest.approx(8, abs=0.01)


def trained():
    words = [b"", b"a", b"ab", b"abc", b"abcd", b"abce", b"abcdefgh", b"b", "é".encode(), b"z" * 60]
    n = np.array([9, 5, 0, 7, 3, 1, 2, 4, 6, 1])
    table = pa.table({"word": pa.array(words, pa.binary()), "n": n, "cut": pa.array(np.full(len(words), mixlm.HEAD, np.int32))})
    model = mixlm.Model(np.zeros((len(mixlm.TABLES), mixlm.SLOTS, 2), np.int64))
    mixlm._walk_words(table, model, "count")
    return words, n, table, model


def test_counts_of_branches_are_exact():
    """With all weight on the word so far the model is the smoothed trie, which is worked out bit by bit here."""
    words, n, table, model = trained()
    model.mixers[1].weights[:] = [1, 0, 0, 0, 0]
    got = mixlm._walk_words(table, model, "score")
    for w, lp in zip(words, got, strict=True):
        want = 0.0
        spelled = w + b" "
        for j in range(mixlm.HEAD, min(len(spelled), mixlm.TRIE)):
            for t in range(8):
                same = [(x + b" ", k) for x, k in zip(words, n, strict=True) if (x + b" ")[:j] == spelled[:j] and len(x) >= j and (x + b" ")[j] >> (8 - t) == spelled[j] >> (8 - t)]
                ones = sum(k for x, k in same if x[j] >> (7 - t) & 1)
                zeros = sum(k for x, k in same) - ones
                p = (ones + 0.4) / (ones + zeros + 0.8) if ones and zeros else 0.5
                want += math.log(p if spelled[j] >> (7 - t) & 1 else 1 - p)
        if len(w) < mixlm.TRIE:
            assert lp == pytest.approx(want, abs=1e-9)


def test_probabilities_of_all_next_bytes_add_up():
    _, _, table, model = trained()
    mixlm._walk_words(table, model, "learn")
    for m in model.mixers:
        m.settle([])
    nexts = [b"", *(bytes([b]) for b in range(256) if b != 32)]
    words = mixlm.Words(pa.array(nexts, pa.binary()))
    every, zero = np.arange(len(nexts)), np.zeros(len(nexts), np.int64)
    lp = mixlm.walk(words, every, zero, zero, 0, 1, model, "score", classes=(zero + 3, zero + 2))
    assert np.exp(lp).sum() == pytest.approx(1)


def test_adaptation_is_a_distribution():
    rnd = np.random.default_rng(2)
    share = rnd.dirichlet(np.ones(6))
    for history in ([], [0, 1, 0, 0], [5] * 20):
        total = sum(math.exp(mixlm.adapted(np.log(share)[np.array([*history, k])], np.array([*history, k]), np.array([len(history) + 1]))[-1]) for k in range(6))
        assert total == pytest.approx(1)


def test_bytes_after_the_trie_count_in_full():
    words, _, table, model = trained()
    mixlm._walk_words(table, model, "learn")
    lp = mixlm._walk_words(pa.table({"word": pa.array([b"z" * 60, b"z" * 61], pa.binary()), "n": [1, 0], "cut": pa.array([3, 3], pa.int32())}), model, "score")
    assert lp[1] < lp[0] < 0


def test_weights_are_learnt_from_all_training_texts(spark, docs, monkeypatch):
    """The map's counts hold every bit of every training word, however many blocks there are."""
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert mixlm.cut_blocks(frame.repartition(1), 300).count() > 20
    learn, learnt = mixlm.learn_mixers, []
    monkeypatch.setattr(mixlm, "learn_mixers", lambda *a: learnt.extend(learn(*a)) or learnt)
    mixlm.lm_scores(frame.repartition(1), tokens=300).count()
    sizes = [len((t or "").encode()) + 1 for i, x in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x)]
    seen = [sum(v for kind, what, _, v, _ in learnt if (kind, what) == (k, 1)) for k in (0, 1)]
    assert seen == [8 * sum(min(n, mixlm.HEAD) for n in sizes), 8 * sum(max(n - mixlm.HEAD, 0) for n in sizes)]


def test_blocks_split_texts_as_plain_python_does(spark, monkeypatch):
    """Words, numbers and block ends, with a piece for each text; texts are split by columns, never one by one."""
    texts = ["Ab  ab\x1cC\x85\u3000 ÄB\tq\n", None, "", " \r\n ", "a" * 50 + "\x0b\x0cAB ab", " ab q", "\x00 Z", "ab " * 30]
    monkeypatch.setattr(mixlm, "PIECE_BYTES", 8)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    blocks = sorted(mixlm.cut_blocks(frame, 7).collect(), key=lambda r: r["block"])
    assert [r["doc_id"] for r in blocks] == [[0, 1, 2], [3, 4, 5], [6, 7]]
    for row in blocks:
        spelled = [[*(t.encode() for t in tokens(texts[i])[:-1]), b""] for i in row["doc_id"]]
        ids = mixlm._ids(row["ids"], np.array(row["sizes"]))
        assert [bytes(row["words"][i]) for i in ids] == [w for t in spelled for w in t] and row["sizes"] == [len(t) for t in spelled]
        learnt = Counter(w for i, t in zip(row["doc_id"], spelled, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
        assert {bytes(w): n for w, n in zip(row["words"], row["trained"], strict=True)} == {w: learnt[w] for t in spelled for w in t}
        assert row["held"] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in row["doc_id"]]
    assert mixlm._split(pa.array(["A b ", None])).to_pylist() == [["a", "b", ""], [""]]
