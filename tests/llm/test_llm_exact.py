"""Sharding, mixing, token files, WARC and substring removal against plain versions on a small fixture."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("watchloom.llm")
from watchloom.llm import mixing, runindex, sharding, substrings, tokens, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string"
LONG = " ".join(f"word{i % 997} and{i % 89}" for i in range(12_000))
SHARED = "this passage of well over one hundred bytes is shared by several documents, word for word, so that it must go from all but one"
ROWS = [
    (1, f"first {SHARED} end", "en", "a", 1, 1, "x"),
    (2, f"second text, {SHARED}", None, "b", None, None, None),
    (3, None, "en", None, None, 2, "y"),
    (4, "", None, "b", 0, 3, "y"),
    (5, LONG, "en", "a", 9, 4, "z"),
    (6, "tie tie", "de", "c", 7, 5, "z"),
    (6, "tie tie", "de", "c", 7, 5, "z"),
    (None, f"no id {SHARED} {SHARED}", "de", "c", 7, 5, "z"),
    (7, "ab" * 150, "fr", "c", 7, 5, "z"),
    (8, "Ünï cödé   spaces\x0bhere\tand  there " * 9, "fr", "é", 7, 5, "z"),
    (9, LONG[:5000], "en", "a", 9, 4, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_shards_are_a_permutation(spark, docs):
    got = sharding.shard_table(docs, shards=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_table(docs.repartition(3), shards=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shard_table(docs.limit(0)).count() == 0


def test_shard_operator_keeps_rows_and_replaces_clashing_names(docs):
    out = sharding.shuffled_shards(docs, shards=3)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "row_no", "shuffled_no", "shard", "slot"}
    assert sorted(r.shuffled_no for r in out.collect()) == list(range(len(ROWS)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_feistel_permutes_every_size(spark, n):
    out = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 5).alias("p"))
    assert sorted(r.p for r in out.collect()) == list(range(n))


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(docs):
    got = mixing.mix_table(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += words(r[1])
    target = plain_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in ROWS)
    source = {r[0]: r[3] for r in ROWS}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert Counter(map(tuple, mixing.mix_table(docs.repartition(5)).collect())) == Counter(map(tuple, got))


def test_mix_of_hot_and_equal_rows(spark):
    rows = [(i // 2, "a b c d", "hot") for i in range(400)] + [(1000 + i, "x y", f"s{i % 5}") for i in range(50)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_table(df)
    assert got.count() == len(rows)
    per = {r[0]: r for r in got.withColumn("hot", F.col("source_size") == 1600).groupBy("hot").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert abs(per[True].t - per[True].g) <= 1
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns and docs.where("source = 'hot'").count() == pytest.approx(per[True].g / 4, abs=1)
    assert mixing.mix_table(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_only_rows_at_the_cut_are_ordered(spark, monkeypatch):
    """Whole copies are those that mix() gives, though most texts are neither folded nor ordered; columns named like results stay."""
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 40))), [None, "a", "b", "c"][i % 4]) for i in range(3000)]
    rows += [(7, "one text of many", "a")] * 400 + [(None, None, "empty"), (5, "", "empty"), (5, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mix(df.withColumn("_size", mixing.word_count(F.col("text"))), size="_size").groupBy(*df.columns).agg(F.sum("copies").alias("n")).collect()
    ordered, taken = [], mixing._taken
    monkeypatch.setattr(mixing, "_taken", lambda folded, *a: ordered.append(folded.agg(F.sum("_n")).first()[0]) or taken(folded, *a))
    got = Counter(map(tuple, mixing.mixed_documents(df).collect()))
    assert got == Counter({tuple(r)[:3]: r["n"] for r in want if r["n"]}) and ordered[0] < 100
    named = mixing.mixed_documents(df.withColumn("copies", F.lit("own")))
    assert named.columns == [*df.columns, "copies"] and {r["copies"] for r in named.collect()} == {"own"}


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_files_round_trip(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    odd = [(20, "İstanbul ΣΑΣ ΟΔΟΣ. it's don't <|endoftext|> a<|startoftext|>b x\x1cy ½ ² !!..,, 12,34. 日本語 ,. .a", "", "", 0, 0, "")]
    df = docs.unionAll(spark.createDataFrame(odd, SCHEMA))
    manifest = tokens.write_token_files(df, vocabulary, partitions=3)
    got = sorted(map(tuple, tokens.read_token_files(manifest).collect()), key=lambda r: r[1])
    rows = sorted([*ROWS, *odd], key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    start = 0
    for (_, begin, n, crc), row in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]
        assert (begin, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert manifest.select("width").distinct().collect()[0][0] == 2
    assert tokens.token_table(df.limit(0), vocabulary).count() == 0


def test_every_letter_has_the_ids_of_the_tokenizer(vocabulary):
    encode = tokens.Encoder(vocabulary)
    assert encode.by_word and encode.words.direct
    ids = lambda text: np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, encode.kind).tobytes()
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    assert [c for c in letters if encode(f"a{c}b {c},") != ids(f"a{c}b {c},")] == []
    for text in ("\u0995\u09b2\u09dc", "\u0915\u095c\u0932, \u0915\u095c.", "\ufb2a\ufb35\u05dd"):
        assert encode(text) == ids(text)


def test_words_in_use_are_kept_when_the_memo_is_full(vocabulary, monkeypatch):
    """A word that comes up all the time is encoded once, whatever passes through a memo that stays within its bound."""
    monkeypatch.setattr(tokens, "MEMO_BYTES", 40 * (tokens.ENTRY_BYTES + 20))
    words, asked = tokens.Encoder(vocabulary).words, []
    monkeypatch.setattr(words, "direct", False)
    encoded = words.encoded
    monkeypatch.setattr(words, "encoded", lambda w: asked.append(w) or encoded(w))
    for i in range(500):
        assert words["often"] == encoded("often") and words[f"w{i}"] == encoded(f"w{i}")
        assert len(words) + len(words.older) <= 60
    assert asked.count("often") == 1


def test_columns_of_texts_have_the_ids_of_the_tokenizer(vocabulary, monkeypatch):
    """Each simple letter and mark beside letters, digits, marks and quotes; texts that are encoded whole among others; a tokenizer of another kind."""
    rest = [None, "", "  ", "it's I'LL a''s 'tis x'd.' don't<|endoftext|>'s b<|startoftext|>c", "x\x1cy it's", "İstanbul ΣΑΣ ½ ²3 日本語,x a\u0301 \u0995\u09b2\u09dc,", "a\xa0b\u3000c\x85d\te", "q" * 300]
    for path in (vocabulary, vocabulary.replace("word_bpe_49k", "byte_bpe_50k")):
        encode = tokens.Encoder(path)
        assert encode.by_piece == (path == vocabulary)
        simple = [c for c in map(chr, range(33, 0x9FA6)) if not 0xD800 <= ord(c) < 0xE000 and re.match(encode.simple, c)]
        texts = [*(f"{c} a{c}B {c.upper()}{c}. '{c}, 1{c}2'S" for c in simple[:: 1 if encode.by_piece else 40]), *rest]
        ids = [[*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
        for bound in (128_000_000, 30_000):
            monkeypatch.setattr(tokens, "MEMO_BYTES", bound)
            got, counts = encode.many(pa.array(texts), 7)
            assert counts.tolist() == list(map(len, ids)) and [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == ids
        assert [x.tolist() for x in encode.many(pa.array([], pa.string()), 7)] == [[], []]


def test_a_piece_is_looked_up_once_for_all_words_of_a_slice(vocabulary):
    encode, asked = tokens.Encoder(vocabulary), []

    class Counted(tokens.WordIds):
        def get(self, word):
            asked.append(word)
            return super().get(word)

    encode.words = Counted(encode.tokenizer, encode.kind)
    encode.many(pa.array(["Mill mill, mill. mill!!! MILL's", "mill ''mill' mill,"] * 50), 1)
    assert sorted(w for w in asked if w) == ["!!!", "'", "''", "'s", ",", ".", "mill"] and "mill" in encode.words



def test_warc_round_trip(spark):
    big = "<p>" + "x" * 3_000_000
    rows = [(1, "http://a", "one"), (2, None, "one"), (3, "http://b\r\nX: 1", None), (4, "http://c", ""), (5, "http://d", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "one"), (6, "http://f", big), (2, None, "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("extra"))
    got = Counter(map(tuple, warc.warc_table(pages).collect()))
    last = {}
    for key, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if key is None else key)
    want = Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        revisit = key != last[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[key, len(body), digest, "revisit" if revisit else "response", last[html or ""] if revisit else None] += 1
    assert got == want
    assert warc.warc_table(pages.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.warc_table(pages.where("length(html) < 10"), least=10).collect())


def test_warc_members_and_payloads(spark):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(300)], "page_id long, url string, html string").repartition(2)
    members = warc.normalise_archives(warc.write_archives(warc.record_types(pages), file_bytes=20_000))
    files = members.collect()
    assert len(files) > 4 and sum(f.n_records for f in files) == 300
    rows = {r.page_id: r for r in warc.read_archives(members, per_task=7).collect()}
    assert all(bytes(rows[i].payload or b"") == (f"page {i} " * (i % 50)).encode() or rows[i].record_type == "revisit" for i in range(300))
    r = rows[17]
    with open(r.file.removeprefix("file://"), "rb") as f:
        f.seek(r.offset)
        assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")


def plain_repeats(rows, length):
    seen, out = {}, []
    order = sorted({(r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), (r[1] or "").encode()) for r in rows})
    results = {}
    for key in order:
        text = key[3]
        cover = np.zeros(len(text) + 1, int)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.setdefault(w, key)
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(text) else 0
        results[key[:2], text] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    for r in rows:
        out.append((r[0], *results[(r[0] is None, r[0] or 0), (r[1] or "").encode()]))
    return Counter(out)


def test_repeated_substrings_go(spark, docs):
    got = Counter(map(tuple, substrings.without_repeats(docs, with_text=False).collect()))
    assert got == plain_repeats(ROWS, 100)
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in substrings.without_repeats(docs).collect()}
    assert kept[1].decode() == ROWS[0][1] and SHARED not in kept[2].decode()


def test_repeated_substrings_of_many_variants(spark):
    draw = np.random.default_rng(3)
    base = [bytes(draw.integers(97, 123, 400).astype(np.uint8)).decode() for _ in range(4)]
    rows = []
    for i in range(150):
        text = list(base[int(draw.integers(4))][int(draw.integers(100)) :])
        for _ in range(int(draw.integers(4))):
            text[int(draw.integers(len(text)))] = "#"
        rows.append((i, "".join(text) * int(draw.integers(1, 3)), None, None, None, None, None))
    rows.append((500, "a" * 1000, None, None, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(map(tuple, substrings.without_repeats(df, with_text=False, parts=5).collect()))
    assert got == plain_repeats(rows, 100)


def test_spans_are_cut_between_anchors(monkeypatch):
    monkeypatch.setattr(substrings, "SPANS", 500)
    draw = np.random.default_rng(3)
    head = np.zeros(200, substrings.ASKED)
    head["key"], head["lo"], head["crc"] = draw.integers(0, 40, 200), draw.integers(0, 9, 200), np.arange(200)
    head["hi"] = head["lo"] + draw.integers(100, 180, 200)
    bodies = [bytes(draw.integers(0, 255, int(h["hi"] - h["lo"])).astype("u1")) for h in head]
    seen, keys = {}, []
    for own, raw in substrings.by_anchor(head, np.frombuffer(b"".join(bodies), np.uint8)):
        ends = np.cumsum(own["hi"] - own["lo"])
        seen |= {int(h["crc"]): raw[e - (h["hi"] - h["lo"]) : e].tobytes() for h, e in zip(own, ends.tolist(), strict=True)}
        keys += sorted(set(own["key"].tolist()))
    assert [seen[i] for i in range(200)] == bodies and len(keys) == len(set(keys)) == len(set(head["key"].tolist()))


def test_run_index_classes():
    draw = np.random.default_rng(0)
    base = draw.integers(97, 101, 300).astype(np.uint8)
    texts = [base[s : s + int(draw.integers(5, 60))].copy() for s in draw.integers(0, 240, 60)]
    index = runindex.RunIndex(np.concatenate(texts), np.array([len(t) for t in texts]), 12)
    assert len(index.run_start) < index.n
    first, names, seen = {}, {}, set()
    for k, text in enumerate(texts):
        for i in range(len(text) - 11):
            first.setdefault(text[i : i + 12].tobytes(), int(index.begin[k]) + i)
    for k, i, c in zip(*(x.tolist() for x in index.stream()), strict=True):
        word = texts[k][i : i + 12].tobytes()
        assert len(word) == 12 and index.first_place[c] == first[word] and names.setdefault(word, c) == c
        seen.add((k, i))
    assert len(seen) == sum(max(0, len(t) - 11) for t in texts) and len(set(names.values())) == len(names)
