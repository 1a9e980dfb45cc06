"""Token ids in files of directly addressable codes.

Format.  An id is split into chunks of 8, 8, 8 and 8 bits, the lowest first, as many as it
needs.  Level k holds the k-th chunks of all ids that have one, in order, and a bitmap that
says which of them go on in level k + 1; a rank directory holds the number of ones before
every 512 bits of that bitmap.  So token i is its chunk in level 0 and, while the bit at its
place is set, the chunk in the next level at the rank of that bit: one look at a chunk, a
directory entry and at most 64 bytes of bitmap a level, without decoding anything before it.
A slice is as direct, as the chunks of neighbours stand together in every level.

File (little-endian; sections start at multiples of 8): the header - magic, version, number
of levels, documents, tokens, and for each section its place and length in bytes -, doc ids
(int64), null flags of doc ids (uint8), first token of each document and the end (uint64),
then per level chunks, bitmap, directory.

Writing.  Rows are range-partitioned and sorted by (doc_id, hash of the text) by Spark; each
task encodes its texts, and closes a file whenever ``FILE_TOKENS`` are held.  A file gets a
name of its own for every attempt, and becomes part of the result only by its row in the
manifest, a Parquet table that Spark commits: what failed or doubled attempts left behind is
never read.  Manifest rows (one a file) are numbered by a two-level running sum, which gives
every file the position of its first token.

Encoding.  The byte-level pre-tokenizer always starts a pre-token at a space that stands
behind a character other than white space.  So texts are cut there, a slice of
``SLICE_BYTES`` at a time by Arrow; each distinct piece of a slice is encoded once by the
tokenizers library, about the last ``REMEMBERED`` of them are remembered in a worker (some 200
bytes each), and the ids of the slice are taken from those of its pieces.  A word of Latin
letters is one pre-token, as are the ASCII signs behind it and a line break between two such
words.  If no entry of the vocabulary reaches from one of these into the next, the library's
model gives the same ids for many such words at once, and the tokens that begin with a space
say where each starts.  A tokenizer of another kind gets whole texts.

Defined cases: null text is encoded as the empty text, so it has the end id alone; null ids
come first; rows that repeat a doc_id are documents of their own, in order of the hashes of
their texts; an empty table gives an empty manifest and no rows; extra columns are ignored.
Texts are encoded whole; a document longer than a file's measure has a file to itself or
with what was held before it.  Strings of special tokens in a text are encoded as the
library does by default (``special_as_text=True``: as ordinary text).
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.llm.common import partitions, pick
from shoplytics.operators.ordering import running_sum
from shoplytics.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
FILE_TOKENS = 1 << 21
REMEMBERED = 1_000_000
CHUNK_BITS = 8
RANK_BITS = 512
_MAGIC, _VERSION = b"DACTOKEN", 1
_HEAD = struct.Struct("<8sIIQQ")
_SECTION = struct.Struct("<QQ")


# --- codes ------------------------------------------------------------------------

def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap as bytes, rank directory) of every level."""
    out, left = [], ids.astype(np.uint32)
    while True:
        more = left >> np.uint32(CHUNK_BITS)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        per = RANK_BITS // 8
        blocks = -(-len(bits) // per)
        ones = np.bitwise_count(np.pad(bits, (0, blocks * per - len(bits)))).reshape(blocks, per).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ones, dtype=np.uint64)])
        out.append(((left & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, ranks))
        if not goes_on.any():
            return out
        left = more[goes_on]


def file_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: the documents' ids, where each starts (and the end), and all tokens."""
    sections = [np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
                np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    coded = levels(ids)
    for chunks, bits, ranks in coded:
        sections += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    at = _HEAD.size + len(sections) * _SECTION.size
    head, body = [_HEAD.pack(_MAGIC, _VERSION, len(coded), len(doc_ids), len(ids))], []
    for s in sections:
        head.append(_SECTION.pack(at, len(s)))
        padded = s + bytes(-len(s) % 8)
        body.append(padded)
        at += len(padded)
    return b"".join(head + body)


class TokenFile:
    """A file of token ids, open for reading at any place; reads only what is asked for."""

    def __init__(self, file):
        self.file = file
        magic, version, self.n_levels, self.n_docs, self.n_tokens = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a file of token codes")
        n = 3 + 3 * self.n_levels
        table = self._read(_HEAD.size, n * _SECTION.size)
        self.sections = [_SECTION.unpack_from(table, i * _SECTION.size) for i in range(n)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _part(self, section: int, lo: int, hi: int, dtype: str) -> np.ndarray:
        """Entries lo to hi of a section."""
        at, size = self.sections[section]
        width = np.dtype(dtype).itemsize
        lo, hi = min(lo * width, size), min(hi * width, size)
        return np.frombuffer(self._read(at + lo, hi - lo), dtype=dtype)

    def _rank(self, level: int, i: int) -> tuple[int, bool]:
        """Ones of the level's bitmap before place i, and the bit at i."""
        block = i // RANK_BITS
        before = int(self._part(5 + 3 * level, block, block + 1, "<u8")[0])
        first = block * RANK_BITS // 8
        bits = self._part(4 + 3 * level, first, i // 8 + 1, "u1")
        whole, rest = i // 8 - first, i % 8
        last = int(bits[whole]) if whole < len(bits) else 0
        ones = int(np.bitwise_count(bits[:whole]).sum()) + (last & ((1 << rest) - 1)).bit_count()
        return before + ones, bool(last >> rest & 1)

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k in range(self.n_levels):
            value |= int(self._part(3 + 3 * k, i, i + 1, "u1")[0]) << (CHUNK_BITS * k)
            i, goes_on = self._rank(k, i)
            if not goes_on:
                break
        return value

    def tokens(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids at places lo to hi (all without)."""
        hi = self.n_tokens if hi is None else hi
        out = np.zeros(max(0, hi - lo), dtype=np.uint32)
        where = np.arange(len(out))
        for k in range(self.n_levels):
            if hi <= lo:
                break
            out[where] |= self._part(3 + 3 * k, lo, hi, "u1").astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            bits = np.unpackbits(self._part(4 + 3 * k, lo // 8, -(-hi // 8), "u1"), bitorder="little")[lo % 8:][:hi - lo]
            where = where[bits.astype(bool)]
            lo, hi = self._rank(k, lo)[0], self._rank(k, hi)[0]
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and their first tokens with the end."""
        null = self._part(1, 0, self.n_docs, "u1")
        ids = self._part(0, 0, self.n_docs, "<i8")
        return [None if n else int(d) for d, n in zip(ids, null)], self._part(2, 0, self.n_docs + 1, "<u8")


# --- tokenizer ----------------------------------------------------------------------

class _Remembered(dict):
    """What ``made`` gives for a list of keys, for about the last ``REMEMBERED`` distinct keys asked."""

    def __init__(self, made):
        super().__init__()
        self.made, self.before = made, {}

    def all(self, keys: list[str]) -> list[bytes]:
        """The values of ``keys``, which are distinct; those of long ones are not kept."""
        values = list(map(self.get, keys))
        absent = [i for i, v in enumerate(values) if v is None]
        asked = [keys[i] for i in absent]
        found = list(map(self.before.get, asked))
        new = [i for i, v in enumerate(found) if v is None]
        for i, v in zip(new, self.made([asked[i] for i in new])):
            found[i] = v
        for i, v in zip(absent, found):
            values[i] = v
        self.update(zip(asked, found) if max(map(len, asked), default=0) < _LONG else
                    [(k, v) for k, v in zip(asked, found) if len(k) < _LONG])
        if len(self) >= REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        return values


#: Keys of so many characters are not remembered.
_LONG = 64
#: Text that one column operation takes, in bytes.
SLICE_BYTES = 8 << 20
#: New words that the model gets at once.
_TOGETHER = 32
#: The symbol that the byte level has for each byte.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_SYMBOLS = "".join(chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))
_SPACE = _SYMBOLS[0x20]
#: Letters of Latin script (below U+0250), and ASCII signs: in any version of Unicode a run of either is one pre-token,
#: the first with the space before it; a line break between such runs is one too.
_LETTER, _SIGN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", f"[{re.escape(string.punctuation)}]"
_PLAIN = f"^{_LETTER}+{_SIGN}*(?:\n{_LETTER}+{_SIGN}*)*$"
#: The same letters as UTF-8 bytes read as Latin-1; the last byte of one; where two pre-tokens of plain words meet.
_BYTES = "(?:[A-Za-z]|\xc2[\xaa\xb5\xba]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
_TAIL = f"(?:{_BYTES}|^[\x80-\xbf])"
_MEET = re.compile(f"{_TAIL}(?:{_SIGN}|[ \n])|{_SIGN}[ \n]|\n(?:{_BYTES}|[\xc2-\xc9]$)")
_INSIDE = re.compile(f"{_SIGN}[^{re.escape(string.punctuation)}]")
_CLOSE = "[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "
_BETWEEN = re.compile(r"(?<!\s)(?= )")


class _Encoder:
    """Texts to their ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        pre, model, added = (made.get(k) or {} for k in ("pre_tokenizer", "model", "added_tokens"))
        # Pieces can be encoded on their own: the splitting pattern of the byte level, and nothing that looks across cuts.
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not any(made.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
                     and model.get("type") == "BPE" and not model.get("dropout")
                     and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
                     and not any(" " in t["content"] or t["content"].strip(string.punctuation) in ("", t["content"]) for t in added))
        self.model, vocab = self.tokenizer.model, model.get("vocab") or {}
        # The model finds pre-tokens of plain words by itself: no entry reaches over the place where two of them meet.
        self.joins = (self.cuts and not any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
                      and all(c in vocab for c in _SYMBOLS) and all(_INSIDE.search(t["content"]) for t in added))
        if self.joins:
            shown = str.maketrans({c: chr(b) for b, c in enumerate(_SYMBOLS)})
            specials = {t["content"] for t in added}
            self.joins = not any(_MEET.search(t.translate(shown)) for t in vocab if t not in specials)
            self.begins = np.zeros(1 + max(vocab.values()), dtype=bool)
            self.begins[[i for t, i in vocab.items() if t.startswith(_SPACE)]] = True
        self.behind, self.piece = _Remembered(self._behind), _Remembered(lambda texts: list(map(self._library, texts)))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _behind(self, words: list[str]) -> list[bytes]:
        """A space and a word, for each of ``words``, which hold none."""
        import pyarrow as pa
        import pyarrow.compute as pc
        out: list = [None] * len(words)
        plain = np.flatnonzero(pc.match_substring_regex(pa.array(words, pa.large_string()), _PLAIN)).tolist() if self.joins else []
        ids = array("I")
        for i in range(0, len(plain), _TOGETHER):
            text = "".join([" " + words[j] for j in plain[i:i + _TOGETHER]])
            ids.extend([t.id for t in self.model.tokenize(codecs.charmap_decode(text.encode(), "strict", _SYMBOLS)[0])])
        coded = np.array(ids, dtype="<u4")
        # Only the first token of a word begins with a space.
        at = [*(4 * np.flatnonzero(self.begins[coded])).tolist(), 4 * len(ids)] if plain else [0]
        if len(at) != len(plain) + 1:
            raise AssertionError("a plain word without a token that begins it")
        held = coded.tobytes()
        for j, lo, hi in zip(plain, at[:-1], at[1:]):
            out[j] = held[lo:hi]
        return [self._library(" " + w) if x is None else x for w, x in zip(words, out)]

    def column(self, texts, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts, ``end`` behind each, and where each starts (and the end)."""
        import pyarrow as pa
        import pyarrow.compute as pc
        texts, each = texts.fill_null(""), np.arange(len(texts))
        if not self.cuts:
            known, order, starts = [self._library(t) + end for t in texts.to_pylist()], each, each
        else:
            apart = pc.match_substring_regex(texts, _CLOSE)
            split = pc.split_pattern(pc.if_else(apart, pa.scalar("", texts.type), texts), " ")
            n, words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), split.flatten()
            begin = np.cumsum(n) - n
            # What goes to the library: first words, and whole texts that have spaces behind white space.
            pieces = [_BETWEEN.split(texts[i].as_py()) if a else [w]
                      for i, (w, a) in enumerate(zip(words.take(pa.array(begin)).to_pylist(), apart.to_pylist()))]
            have = list(dict.fromkeys(itertools.chain.from_iterable(pieces)))
            ids_of = dict(zip(have, self.piece.all(have)))
            firsts = [b"".join(map(ids_of.__getitem__, x)) for x in pieces]
            coded = words.dictionary_encode()
            order = coded.indices.to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(np.bincount(np.delete(order, begin), minlength=len(coded.dictionary)))
            known = self.behind.all(coded.dictionary.take(pa.array(asked)).to_numpy(zero_copy_only=False).tolist())
            place = np.zeros(len(coded.dictionary), dtype=np.int32 if len(order) < 1 << 30 else np.int64)
            place[asked] = np.arange(len(asked))
            del split, words, coded, pieces, ids_of
            order = place[order]
            order[begin] = len(known) + each
            order, starts = np.insert(order, begin + n, len(known) + len(each)), begin + each
            known += [*firsts, end]
        made = pa.array(known, pa.large_binary()).take(pa.array(order))
        at = np.frombuffer(made.buffers()[1], dtype=np.int64, count=len(made) + 1) // 4 if len(made) else np.zeros(1, dtype=np.int64)
        ids = np.frombuffer(made.buffers()[2], dtype="<u4", count=int(at[-1])) if at[-1] else np.zeros(0, dtype="<u4")
        return ids, at[np.append(starts, len(made))]

    def __call__(self, text: str) -> bytes:
        import pyarrow as pa
        return self.column(pa.array([text], pa.large_string()))[0].tobytes()


def _slices(batch) -> Iterator:
    """A batch in stretches of rows with about ``SLICE_BYTES`` of text (or one row)."""
    import pyarrow.compute as pc
    size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_ENCODERS: dict[tuple, _Encoder] = {}


def _encoder(path: str, special_as_text: bool) -> _Encoder:
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(path, special_as_text)
    return _ENCODERS[key]


# --- files ---------------------------------------------------------------------------

def _store(uri: str):
    """(file system, path) of a shared folder: a path, or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)


_MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def _writer(folder: str, tokenizer: str, end_id: int | None, special_as_text: bool, file_tokens: int):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        encode, part = _encoder(tokenizer, special_as_text), TaskContext.get().partitionId()
        system, base = _store(folder)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        size = seq = 0

        def close():
            nonlocal held, size, seq
            ids = np.concatenate([x for _, x, _ in held])
            starts = np.cumsum(np.concatenate([[0], *[n for _, _, n in held]]), dtype=np.int64)
            docs = [d for have, _, _ in held for d in have]
            name = f"{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(file_bytes(docs, starts, ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name],
                                              "n_docs": [len(docs)], "n_tokens": [len(ids)]})
            held, size, seq = [], 0, seq + 1
            return row

        for b in (s for batch in batches for s in _slices(batch)):
            docs = b.column("doc_id").to_pylist()
            ids, at = encode.column(b.column("text"), end)
            lo = 0
            while lo < len(docs):
                # Up to the document that fills the file.
                hi = min(len(docs), max(lo + 1, int(np.searchsorted(at, at[lo] + file_tokens - size))))
                held.append((docs[lo:hi], ids[at[lo]:at[hi]], np.diff(at[lo:hi + 1])))
                size += int(at[hi] - at[lo])
                lo = hi
                if size >= file_tokens:
                    yield close()
        if held:
            yield close()
    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = END_ID,
                 special_as_text: bool = False, file_tokens: int = FILE_TOKENS) -> str:
    """Encode all texts with the tokenizer file at the path ``tokenizer`` (which every
    executor has), append ``end_id``, and write the files and their manifest below
    ``folder`` (a new one in the shared checkpoint folder without).  Returns the folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    system, base = _store(folder)
    system.create_dir(base, recursive=True)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = rows.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id, special_as_text, file_tokens), _MANIFEST)
    files.write.mode("overwrite").parquet(f"{folder}/files")
    placed = running_sum(spark.read.schema(_MANIFEST).parquet(f"{folder}/files"), ["part", "seq"], "n_tokens", "start", inclusive=False)
    placed.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, file, n_docs, n_tokens, start (tokens of all files before): one row per file."""
    return spark.read.schema(f"{_MANIFEST}, start long").parquet(f"{folder}/manifest")


def _dealt(files: DataFrame) -> DataFrame:
    """The manifest rows over tasks, about four files to a task at scale."""
    n = files.count()
    spread = max(1, min(n, max(partitions(files.sparkSession), n // 4)))
    return files.repartition(spread, "file")


_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        system, base = _store(folder)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                with system.open_input_file(f"{base}/{name}") as f:
                    file = TokenFile(f)
                    docs, starts = file.documents()
                    ids = file.tokens().astype("<u4").tobytes()
                at = starts.astype(np.int64)
                crcs = [zlib.crc32(memoryview(ids)[4 * lo:4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)),
                                                  pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(manifest(spark, folder)).select("file", "start").mapInArrow(read, _DOCS)


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame, column: str = "position") -> DataFrame:
    """position, token_id: the ids at the asked positions of the whole sequence, one row per row
    of ``wanted`` within it.  Positions meet their file by stretches of ``FILE_TOKENS``; only
    their chunks are read."""
    files = manifest(spark, folder).withColumn("cell", F.explode(F.expr(
        f"sequence(start div {FILE_TOKENS}, (start + n_tokens - 1) div {FILE_TOKENS})")))
    asked = pick(wanted, column).select(F.col(column).cast("long").alias("position")).withColumn("cell", F.expr(f"position div {FILE_TOKENS}"))
    met = asked.join(files, "cell").filter("position >= start AND position < start + n_tokens").select("file", "start", "position")

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa
        system, base = _store(folder)
        name = file = None
        for b in batches:
            out = []
            for f, start, position in zip(*(b.column(c).to_pylist() for c in ("file", "start", "position"))):
                if f != name:
                    name, file = f, TokenFile(system.open_input_file(f"{base}/{f}"))
                out.append(file.token(position - start))
            yield pa.RecordBatch.from_arrays([b.column("position"), pa.array(out, pa.int64())], names=["position", "token_id"])

    return met.sortWithinPartitions("file", "position").mapInArrow(look, "position long, token_id long")
