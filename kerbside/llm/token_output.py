"""Operator 7: token ids as Parquet list columns, written and read back."""

from __future__ import annotations

import gc
import json
import os
import re
import string
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch

#: Parquet row groups and pages of the token files, in bytes: a reader of a few documents skips the rest by page index.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Bytes that a worker remembers words with, and characters above which a part of a text isn't remembered.
REMEMBERED, LONG = 160 << 20, 64
#: Bytes of an entry beside its characters and ids: two objects and a place in a table.
ENTRY = 190
#: Bytes of texts that are cut to parts at once; and all bytes, with line ends and tabs as spaces.
AT_ONCE = 8 << 20
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 13]] = 32
#: Words without a character above U+024F: their letters are lower-cased one by one and unchanged by composition.
_PLAIN = re.compile(r"[\x21-ɏ]*")
#: Closing marks: all of ASCII but the apostrophe, which may begin a contraction.
_MARKS = string.punctuation.replace("'", "")
#: Where a long part may be cut: after a mark that neither composes nor begins a contraction, before a letter or digit.
_CUT = re.compile(r"(?<=[.,;:!?。、，；：！？])(?=[^\W_])")
#: Texts by which a tokenizer is tested for the rule that ids of parts, joined, are those of the text.
_SAMPLE = ("Don't   stop.I'll GO\tnow\n\n", "é e\u0301 \u0301x A\u030a", "12.5%,x;y  ##a 'S 's", "日本語。日本、x！", " Σ ΣΑΣ İ ß ", "a\x0bb\x0cc\x85d\u00a0e\u2003f\u3000g")


class _Words:
    """Ids, as little-endian 32-bit integers, of space-free parts of texts.

    Parts of letters alone are one piece to the tokenizer, and its last token ends a word; so many of them are encoded
    as one text and told apart again. Those without their closing marks and capitals are remembered too, in the same
    table, as they are parts themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = self._without_rules([t.removesuffix("</w>") for t in vocabulary])
        self._forget([])
        for text in _SAMPLE:
            if self.ids([text])[0].tobytes() != self.encode([text])[0]:
                raise ValueError(f"{path}: ids of the parts of a text, joined, aren't those of the text")

    def _without_rules(self, words: list[str]):
        """The tokenizer for small letters between spaces, which its normal form and its first rule for pieces leave as they are; the whole one if a word of its vocabulary tells them apart."""
        from tokenizers import Tokenizer

        state = json.loads(self.tokenizer.to_str())
        pieces = (state["pre_tokenizer"] or {}).get("pretokenizers") or []
        if not pieces or pieces[0]["type"] != "Split":
            return self.tokenizer
        state |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, *pieces[1:]]}}
        plain = Tokenizer.from_str(json.dumps(state))
        plain.encode_special_tokens = True
        words = [w for w in (*words, *map(chr, range(0x250))) if w.isalpha() and w == w.lower() and _PLAIN.fullmatch(w)]
        texts = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        same = all(np.array_equal(a, b) for a, b in zip(self.ids(texts), self.ids(texts, plain)))
        return plain if same else self.tokenizer

    def _forget(self, used: list[str]) -> None:
        """Keeps of the parts those that are used and known."""
        known = self.parts if used else {}
        self.parts: dict[str, bytes] = {"": b""} | {p: known[p] for p in used if p in known}
        self.bytes = sum(ENTRY + len(p) + len(x) for p, x in self.parts.items())

    def ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def long(self, part: str) -> bytes:
        """Ids of a long part, cut where that is safe and encoded some pieces at a time."""
        pieces, out = _CUT.split(part), []
        for k in range(0, len(pieces), 1024):
            out += [x.tobytes() for x in self.ids(pieces[k : k + 1024])]
        return b"".join(out)

    def learn(self, wanted: list[str]) -> None:
        """Puts the ids of all wanted parts, which aren't there, into parts."""
        parts, split = self.parts, {}
        letters, others = [p for p in wanted if p.isascii() and p.islower() and p.isalpha()], []
        listed = [*letters]
        parts.update(dict.fromkeys(letters, b""))
        for part in wanted:
            if part in parts:
                continue
            head = part.rstrip(_MARKS)
            tail = part[len(head) :]
            if head.isascii() or _PLAIN.fullmatch(head):
                if tail and not (head and head[-1] <= "ÿ" and head[-1].isalpha()):
                    head, tail = part, ""
                head = head.lower()
                simple = head.isalpha()
            else:
                head, tail, simple = part, "", False
            if head != part:
                split[part] = head, tail
            if head not in parts:
                parts[head] = b""  # listed once
                listed.append(head)
                (letters if simple else others).append(head)
            if tail not in parts:
                parts[tail] = b""
                listed.append(tail)
                others.append(tail)
        for k in range(0, len(letters), 16384):
            groups = [letters[i : i + 256] for i in range(k, min(k + 16384, len(letters)), 256)]
            for some, x in zip(groups, self.ids([" ".join(g) for g in groups], self.plain)):
                cut = np.flatnonzero(self.ends[x]) + 1
                if len(cut) != len(some) or cut[-1] != len(x):
                    others += some
                    continue
                data, cut = x.tobytes(), (cut * 4).tolist()
                parts.update(zip(some, (data[i:j] for i, j in zip([0, *cut], cut))))
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            parts.update(zip(some, (x.tobytes() for x in self.ids(some))))
        for part, (head, tail) in split.items():
            parts[part] = parts[head] + parts[tail]
        self.bytes += sum(ENTRY + len(p) + len(parts[p]) for p in chain(listed, split))

    def found(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that all differ, learned where they are new."""
        if self.bytes > REMEMBERED:
            self._forget(parts)
        ids = list(map(self.parts.get, parts))
        new = [k for k, x in enumerate(ids) if x is None]
        self.learn([parts[k] for k in new if len(parts[k]) <= LONG])
        for k in new:
            ids[k] = self.parts[parts[k]] if len(parts[k]) <= LONG else self.long(parts[k])
        return ids

    def column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, each text's followed by end (ids as bytes), and how many a text has.

        Parts are cut and told apart by Arrow, so that Python meets each part of a column once.
        """
        texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.string()), ""), "", " ")  # a space ends each text
        stops = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = _BLANK[np.frombuffer(texts.buffers()[2], np.uint8)[stops[0] : stops[-1]]]
        cut = np.append(0, np.flatnonzero(data == 32) + 1).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(data)).dictionary_encode()
        known = parts.dictionary.cast(pa.binary())
        letters = known.buffers()[2].to_pybytes()[: int(np.frombuffer(known.buffers()[1], np.int32)[len(known)])]
        ids = self.found(letters.decode().split(" ")[:-1])  # each ends with its one space
        lengths = np.array([*map(len, ids), len(end)], np.int64) // 4
        flat = np.frombuffer(b"".join([*ids, end]), "<i4")
        last = np.searchsorted(cut, stops[1:] - stops[0])
        codes = np.insert(parts.indices.to_numpy(), last, len(ids))
        n = lengths[codes]
        upto = np.cumsum(n)
        at = np.repeat((np.cumsum(lengths) - lengths)[codes] - (upto - n), n) + np.arange(upto[-1])
        return flat[at], np.diff(upto[last + np.arange(len(last))], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        flat, n = self.column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]


_loaded: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def encoder(path: str):
    """Texts -> their ids as bytes, as the tokenizer at path gives for whole texts without special tokens.

    The tokenizer must end words at white space, and lower-case: its normal form and pieces then depend on nothing
    across a space, so ids of the parts between spaces are those of the text; that is tested on _SAMPLE. Each part is
    encoded once a worker, unless it is long; what is remembered is bounded by bytes.
    """
    return _words(path).encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes doc_id, n_tokens, ids (with end_id last) in ascending doc_id order, one file a range of doc_id.

    Ids are dictionary-encoded where a page's values repeat and fall back to plain pages; doc_id and n_tokens are
    delta-encoded (format v2). Page indexes and small pages let a reader fetch chosen documents, or n_tokens alone.
    """

    stop = np.array([end_id], "<i4").tobytes()

    def run(batches):
        words = _words(tokenizer)
        gc.disable()  # the memory holds millions of small objects without cycles
        try:
            yield from encoded(words, batches)
        finally:
            gc.enable()

    def encoded(words, batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(texts):
                start, at = at, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE)))
                flat, n = words.column(texts.slice(start, at - start), stop)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.record_batch([ids.slice(start, at - start), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    out = d.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")
    out.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true").parquet(path)


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Encodes whole texts to files at path (default: the shared folder), and reads back where each document lies.

    docs: columns doc_id, text; others are ignored. Returns, for each row, doc_id, start (ids of all documents
    before), n_tokens (with the end id), ids_crc32 (of the ids as little-endian 32-bit integers).

    Starts come from sums for each file and a running sum within it; only the sums, one a file, meet in one task.
    Null or empty text: the end id alone. Rows that repeat a doc_id are neighbours, in the order of their files;
    null doc_id: first. Empty input: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    path = path or scratch.path("tokens")
    write_tokens(docs, path, tokenizer, end_id)
    files = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)

    def checked(batches):
        for b in batches:
            lists = b.column("ids")
            off, flat = lists.offsets.to_numpy(), np.asarray(lists.values).astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(off, off[1:])]
            first = int(off[0])
            assert first == 0 or len(flat) >= 4 * int(off[-1])
            yield pa.record_batch([b.column("file"), b.column("row"), b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    place = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    read = scratch.write(place.mapInArrow(checked, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), "index")
    from pyspark.sql import Window

    sums = read.groupBy("file").agg(F.sum("n_tokens").alias("s"), F.min("doc_id").alias("least"))
    sums = sums.select("file", (F.sum("s").over(Window.orderBy(F.col("least").asc_nulls_first(), "file")) - F.col("s")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return read.withColumn("inside", inside).join(F.broadcast(sums), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
