"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id. Each task encodes its range and
writes one ``ids`` file (16 bits where the vocabulary fits, else 32), one ``offsets`` file
(64 bits, counted from the file's start, one more than documents) and one ``docs`` file.
The manifest, one row a file, is committed by Spark, so files of lost or repeated tasks are
never referred to. File bases come from a prefix sum over the manifest. Readers map the files.

Defined cases: a null text is empty and gives the end id alone; a null doc_id sorts first;
rows with one doc_id are ordered by a hash of their text, so a frequent doc_id is split over
tasks; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm import files
from watchloom.llm.common import spread, stored
from watchloom.session import new_run_dir

END_ID = 1
MEMO_BYTES = 128_000_000  # of words and ids that a worker keeps, with ENTRY_BYTES for each
ENTRY_BYTES = 200
SLICE_BYTES = 2_000_000  # of texts that are split and looked up at a time
DOC = [("doc_id", "<i8"), ("known", "u1")]
FILE_SCHEMA = "file string, part int, n_docs long, n_ids long, width int"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(spare)) for b in range(256))


class WordIds(dict):
    """Ids of a white-space separated word as bytes, encoded once and kept up to a bound of bytes; beyond it those not used lately are dropped.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in order. A word's last comma or full stop is a token of its own. Words of letters alone go
    straight to the vocabulary's merges where a probe shows that this gives the same ids; they must be letters
    alone in composed form too, as some letters (Bengali, Hindi, Punjabi, Hebrew) compose to a letter and a mark,
    and a mark joins the comma after it.
    """

    letters = byte_letters()

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.kept, self.older = 0, {}
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.tokenizer, self.kind, self.model = tokenizer, kind, tokenizer.model
        self.direct = all(self.merged(w) == self.encoded(w) for w in ("the", "Straße", "ÉTÉ", "ñandú", "слово", "words", "Ǆ", "中文", "internationalisation"))

    def encoded(self, word: str) -> bytes:
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def merged(self, word: str) -> bytes:
        return self.of_plain(self.plain(word))

    @staticmethod
    def plain(word: str) -> str:
        return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()

    def of_plain(self, plain: str) -> bytes:
        # letters of ASCII are written as themselves
        shown = plain if plain.isascii() else plain.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(shown)])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        return self.keep(word, self.fresh(word) if got is None else got)

    def keep(self, word: str, got: bytes) -> bytes:
        if len(word) < 64:
            self.kept += ENTRY_BYTES + len(word) + len(got)
            if self.kept > MEMO_BYTES // 2:  # a word of the older half comes back when it is met
                self.older = dict(self)
                self.clear()
                self.kept = ENTRY_BYTES
            self[word] = got
        return got

    def fresh(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.of_plain(word.lower()) if self.direct else self.encoded(word)
            if word[-1] in ".," and word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
            return self.encoded(word)
        if word.isalpha():
            # lower case of these two depends on what follows, or is more than a letter
            direct = self.direct and "\u03a3" not in word and "\u0130" not in word and (plain := self.plain(word)).isalpha()
            return self.of_plain(plain) if direct else self.encoded(word)
        if word[-1] in ".," and word[:-1].isalpha() and self.plain(word[:-1]).isalpha():
            return self[word[:-1]] + self[word[-1]]
        return self.encoded(word)


def chosen(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of ``ids``, which holds a run of each of ``sizes``, the runs that ``codes`` name, one after the other."""
    own = sizes[codes]
    first = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(own) - own)
    return ids[np.repeat(first, own) + np.arange(own.sum())]


def totals(sizes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` over consecutive runs of so many."""
    return np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(runs))])


class Encoder:
    """Text to id bytes; one per worker.

    ``many`` takes a column of texts: words are split and told apart by Arrow functions, and so are the pieces that the
    tokenizer cuts a word into, so each different piece of a slice is looked up once. Pieces that no memo holds are encoded together.
    """

    # str.split() also splits at these four, which the tokenizer takes for ordinary characters
    odd = re.compile("[\x1c-\x1f]")
    # a tokenizer that works like this may have words of simple letters and no "<" (added tokens have one) cut into pieces here
    normalizers = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    piece = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    simple = "^[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0400-\u045f\u4e00-\u9fa5]*$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.words = WordIds(self.tokenizer, self.kind)
        self.by_word = self.spaces_dropped()
        self.by_piece = self.by_word and self.cuts_pieces()
        if self.by_piece:
            from tokenizers import pre_tokenizers

            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def cuts_pieces(self) -> bool:
        told = json.loads(self.tokenizer.to_str())
        cut, steps = told["pre_tokenizer"] or {}, (told["normalizer"] or {}).get("normalizers")
        split, *rest = cut.get("pretokenizers") or [{}]
        return (
            steps == self.normalizers
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": self.piece}, "Removed", True)
            and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
            and all("<" in t["content"] for t in told["added_tokens"])
        )

    def spaces_dropped(self) -> bool:
        probe = "ab  cd.\n ef\t gh'll <|endoftext|> ée 12"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def __call__(self, text: str) -> bytes:
        if self.by_word and not self.odd.search(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each followed by ``end_id``, and how many each text has with it."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd.pattern) if self.by_piece else pa.array(np.ones(len(texts), bool))
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        per, words = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
        ids, sizes = self.of_words(words.dictionary)
        codes = np.insert(words.indices.to_numpy(), np.cumsum(per), len(sizes))
        ids, sizes = np.append(ids, np.array(end_id, self.kind)), np.append(sizes, 1)
        got, counts = chosen(ids, sizes, codes), totals(sizes[codes], per + 1)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):  # in place of the empty text that stood for them
            parts = np.split(got, np.cumsum(counts)[:-1])
            for i in whole.tolist():
                parts[i] = np.append(np.frombuffer(self(texts[i].as_py()), self.kind), np.array(end_id, self.kind))
                counts[i] = len(parts[i])
            got = np.concatenate(parts)
        return got, counts

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has; an empty word has none."""
        simple = pc.match_substring_regex(words, self.simple)
        split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(simple)), self.piece, r"\0 "), " ")
        per, pieces = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
        ids, sizes = self.of_pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = pieces.indices.to_numpy()
        cut, lengths = chosen(ids, sizes, codes), totals(sizes[codes], per)
        others = [self.words[w] for w in words.filter(pc.invert(simple)).to_pylist()]
        ids, sizes = np.append(cut, np.frombuffer(b"".join(others), self.kind)), np.append(lengths, [len(x) // cut.itemsize for x in others]).astype(np.int64)
        known = simple.to_numpy(zero_copy_only=False)
        order = np.empty(len(words), np.int64)
        order[known], order[~known] = np.arange(len(lengths)), len(lengths) + np.arange(len(others))
        return chosen(ids, sizes, order), sizes[order]

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, width = self.words, np.dtype(self.kind).itemsize
        got, older = [words.get(p) for p in pieces], words.older
        fresh = []
        for i, known in enumerate(got):
            if known is None:
                if (known := older.get(pieces[i])) is not None:
                    got[i] = words.keep(pieces[i], known)
                elif pieces[i]:
                    fresh.append(i)
                else:
                    got[i] = b""
        for at in range(0, len(fresh), 1000):
            some = fresh[at : at + 1000]
            told = self.bare.encode(" ".join([pieces[i] for i in some]), add_special_tokens=False)
            raw, ends = np.array(told.ids, self.kind).tobytes(), (np.cumsum(np.bincount(told.word_ids)) * width).tolist()
            for i, a, b in zip(some, [0, *ends], ends, strict=False):
                got[i] = words.keep(pieces[i], raw[a:b])
        return np.frombuffer(b"".join(got), self.kind), np.array([len(x) // width for x in got], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files; returns the manifest with ``base``, ids before the file."""
    folder = new_run_dir(docs.sparkSession, "token-files")
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        width, n_docs, n_ids = np.dtype(encode.kind).itemsize, 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        with files.writing(f"{folder}/{name}.ids") as ids, files.writing(f"{folder}/{name}.offsets") as offsets, files.writing(f"{folder}/{name}.docs") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in rest():
                doc, ends = np.zeros(batch.num_rows, DOC), np.zeros(batch.num_rows, "<u8")
                keys, texts = batch["doc_id"], batch["text"]
                doc["doc_id"], doc["known"] = pc.fill_null(keys, 0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
                place = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // SLICE_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    got, counts = encode.many(texts.slice(a, b - a), end_id)
                    ids.write(got.tobytes())
                    ends[a:b] = n_ids + np.cumsum(counts)
                    n_ids += len(got)
                offsets.write(ends.tobytes())
                names.write(doc.tobytes())
                n_docs += batch.num_rows
        yield files.rows(schema, file=[f"{folder}/{name}"], part=[part], n_docs=[n_docs], n_ids=[n_ids], width=[width])

    keys = [F.col("doc_id"), F.xxhash64("text")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = narrow.repartitionByRange(partitions, *keys) if partitions else narrow.repartitionByRange(*keys)
    manifest = stored(dealt.sortWithinPartitions(*keys, "text").mapInArrow(write, FILE_SCHEMA), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.mapped(f"{row['file']}.ids", f"<u{row['width']}") as ids, files.mapped(f"{row['file']}.offsets", "<u8") as offsets, files.mapped(f"{row['file']}.docs", DOC) as names:
                    for at in range(0, row["n_docs"], 10_000):
                        ends = np.asarray(offsets[at : at + 10_001]).astype(np.int64)
                        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                        own = names[at : at + len(crc)]
                        doc_id = pa.array(own["doc_id"].astype(np.int64), mask=own["known"] == 0)
                        yield files.rows(schema, doc_id=doc_id, start=ends[:-1] + row["base"], n_tokens=np.diff(ends), ids_crc32=crc)

    return spread(manifest, "file").mapInArrow(read, READ_SCHEMA)


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path))
