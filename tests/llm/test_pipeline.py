"""The corpus pipeline against plain versions of its stages, each judged on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("watchloom.llm")
import corpus_pipeline  # noqa: E402
from watchloom.llm import decontaminate, toxicity  # noqa: E402

BAD = ["grumfel", "snorkwit", "blathorn"]
ITEMS = [(1, "Which river runs past the old mill of Varnholm? The Silder runs past it in the west."), (2, "Name the metal that melts in a warm hand. It is gallium of course.")]


def fixture_rows():
    draw = np.random.default_rng(12)
    word = lambda: "".join(draw.choice(list("aeiourstlnd"), int(draw.integers(2, 9))))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(int(draw.integers(20, 90)))]
        toxic = i % 5 == 0
        if toxic:
            words[int(draw.integers(len(words)))] = BAD[int(draw.integers(3))]
            words[int(draw.integers(len(words)))] = BAD[int(draw.integers(3))]
        text = " ".join(words)
        if i % 31 == 7:
            text += " " + ITEMS[i % 2][1]
        rows.append([i, text, "en", f"s{i % 3}" if i % 11 else None, len(text)])
        labels.append((i, int(toxic)))
    for i in range(240, 300):  # near and exact copies
        words = rows[i - 239][1].split()
        if i % 2:
            words[len(words) // 2] = "altered"
        rows.append([i, " ".join(words), "en", "s1", 0])
    rows += [[400, None, None, "s0", None], [401, "", "en", "s2", 0], [402, "  ", "en", None, 0]]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = fixture_rows()
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_stages_and_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources", "token_files"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "token_files":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append((name, given, [tuple(r) for r in out.collect()]))
        given = seen[-1][2]
    by = {name: (before, after) for name, before, after in seen}

    before, after = by["toxicity"]
    truth = dict(fixture_rows()[1])
    train = sorted((r for r in before if r[0] in truth and zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: r[0])
    model = toxicity.fit_bags([toxicity.unit_set(r[1], 2000) for r in train], [truth[r[0]] for r in train])
    plain = [r for r in before if model.probability(model.highest([r[1]]))[0] < 0.5]
    assert Counter(after) == Counter(plain)
    insult = re.compile("|".join(BAD))
    clean = sum(not insult.search(r[1] or "") for r in before)
    assert not any(insult.search(r[1] or "") for r in after) and 0.93 * clean <= len(after) <= clean  # 200 documents teach little

    before, after = by["ngram_jaccard_join"]
    sets = [shingle_set(r[1]) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    chosen = [min((r for r, g in zip(before, group, strict=True) if g == k), key=lambda r: r[0]) for k in set(group)]
    assert Counter(after) == Counter(chosen) and len(after) < len(before)

    before, after = by["benchmark_decontamination"]
    items = [" ".join(decontaminate.words_of(t)) for _, t in ITEMS]
    clean = [r for r in before if not any(t in " ".join(decontaminate.words_of(r[1])) for t in items)]
    assert Counter(after) == Counter(clean) and len(after) < len(before)

    before, after = by["mix_sources"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    sizes, taken, copies = Counter(), Counter(), Counter(after)
    for r in before:
        sizes[r[3]] += words(r)
    for r in after:
        taken[r[3]] += words(r)
    from test_llm_exact import plain_targets

    target = plain_targets(sizes)
    largest = max(map(words, before))
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in sizes) and max(copies.values()) <= 2 and set(copies) <= set(before)

    from tokenizers import Tokenizer

    before, after = by["token_files"]
    tokenizer, start, want = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), 0, []
    for r in sorted(before, key=lambda r: r[0]):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(after) == sorted(want)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(after)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
