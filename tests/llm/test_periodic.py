"""Periodic runs against a plain scan of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("watchloom.llm")
from watchloom.llm import periodic  # noqa: E402

SCHEMA = "doc_id long, text string, runs string, collapsed long, source string"


def plain_runs(words):
    """Every lag from 1 on; a stretch keeps its smallest period."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - period:
            j = i
            while j < len(words) - period and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(6, 4 * period):
                found.setdefault((i, j - i + period), period)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def built(rnd):
    """Stretches of few words, powers of units with powers inside, cut at both ends."""
    letters = rnd.choice([1, 2, 2, 3, 5, 50])
    words = []
    for _ in range(rnd.randint(0, 6)):
        unit = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 7, 15, 16, 17, 31, 32, 33, 40, 64, 70]))]
        if rnd.random() < 0.3:
            unit = unit[:3] * rnd.randint(3, 8) + unit
        power = unit * rnd.randint(1, 8)
        words += power[rnd.randint(0, 3) : len(power) - rnd.randint(0, 3)]
    return words


def test_runs_of_random_words_equal_a_scan_of_all_lags():
    rnd = random.Random(5)
    for _ in range(60):
        docs = [built(rnd) for _ in range(6)]
        doc, start, length, period = periodic.find_runs([np.array(d, np.int64) for d in docs])
        for k, words in enumerate(docs):
            own = doc == k
            assert list(zip(start[own], length[own], period[own], strict=True)) == plain_runs(words)


@pytest.mark.parametrize("unit", [1, 15, 16, 31, 32, 100, 257])
def test_a_run_of_exactly_four_periods_is_found_and_a_word_less_is_not(unit):
    words = [*range(1000, 1000 + unit)] * 4 + [7]
    full = max(6, 4 * unit)
    words = words if unit > 1 else [1000] * 6 + [7]
    _, start, length, period = periodic.find_runs([np.array([5, *words], np.int64)])
    assert list(zip(start, length, period, strict=True)) == [(1, full, unit)]
    assert not len(periodic.find_runs([np.array([5, *words[1:]], np.int64)])[0])


def test_no_documents_and_a_low_exponent():
    assert all(not len(x) for x in periodic.find_runs([]))
    with pytest.raises(ValueError):
        periodic.find_runs([], exponent=3)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = None
    for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or m * best[2] > best[1] * p:
            best = (s, m, p)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    s, m, p = best or (None, None, None)
    return (doc_id, len(runs), s, m, p, 1000 * m // p if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_table_equals_the_plain_version(spark):
    rnd = random.Random(11)
    prose = [f"w{rnd.randrange(400)}" for _ in range(3000)]
    texts = [None, "", " \t\n", "ha " * 9, "é\x1cb c " * 30, "a b " * 3 + "x", " ".join(prose), ("line one two\n" * 40) + " ".join(prose[:50]), "x" * 100_000, "tie tie"]
    rows = [(i, texts[i % len(texts)] if i < 60 else " ".join(rnd.choices(prose, k=rnd.randint(1, 300))), "clash", 1, "s") for i in range(220)]
    rows += [(None, "la la la la la la la", None, None, None), (5, "é b", "c", 2, None), (5, "é b", "c", 2, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periodic.run_table(docs).collect()]
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=by) == sorted((expected(r[0], r[1]) for r in rows), key=by)
    assert sum(r[1] > 0 for r in got) > 20
    kept = periodic.with_runs(docs)
    assert kept.columns == ["doc_id", "text", "source", "runs", "collapsed"] and kept.where("doc_id is null").first()["collapsed"] == "la"
    assert periodic.run_table(docs.limit(0)).collect() == []
