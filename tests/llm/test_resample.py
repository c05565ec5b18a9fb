"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("watchloom.llm")
from watchloom.llm import resample  # noqa: E402


def plain_features(text, most=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain_table(docs, target):
    """Rows (doc_id, n_features, weight, score, rank); ranks of equal (score, id) are interchangeable."""
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(plain_features(text)[1])
    for text in target:
        want.update(plain_features(text)[1])
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in raw}
    rows = []
    for doc_id, text in docs:
        n, codes = plain_features(text)
        weight = sum(gain[b] for b in codes) // len(codes) if codes else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(codes), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((i for i, r in enumerate(rows) if r[4] >= 20), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0]))
    rank = {i: k + 1 for k, i in enumerate(able[: 25 * len(able) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_spans_are_all_runs_of_words(most):
    for text in ("", "one", " A,b--c\x00É9 z[ ]é_7 ", "x " * 40, "déjà VU İstanbul ẞ 東京 9to5"):
        n, codes = resample.feature_buckets(text, resample.span_patterns(most), 10000)
        words, plain = plain_features(text, most)
        assert (n, Counter(codes.tolist())) == (words, Counter(plain))


def test_long_texts_are_scanned_match_by_match(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(5000))
    at_once = [sorted(resample.spans(resample.folded(text), p)) for p in resample.span_patterns(2)]
    monkeypatch.setattr(resample, "AT_ONCE", 10)
    assert [sorted(resample.spans(resample.folded(text), p)) for p in resample.span_patterns(2)] == at_once


def test_table_equals_the_plain_version(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(f"{rnd.choice('abc')}{rnd.randrange(60)}" for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "word " * 30_000), (None, "no id " * 15), (5, docs[5][1]), *[(77, "same words " * 20)] * 90]
    target = [None, "", "a1 a2 a3 b4", *(" ".join(f"a{rnd.randrange(60)}" for _ in range(30)) for _ in range(20))]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, rank string, n_words int, _tie int")
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in resample.resample_table(frame, wanted).collect()]
    by = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=by) == sorted(plain_table(docs, target), key=by)
    drawn = sorted(r[4] for r in got if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resample_table(none, some).collect() == []
    assert [r["n_features"] for r in resample.resample_table(some, none).collect()] == [79]
