"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash over the last bytes before a white-space byte says so; equal passages in different
documents are therefore cut alike. Chunk hashes are counted over all documents, the texts of the shared chunks that save
most are fetched and encoded once, and their ids are broadcast (at most ``SHARED_CHUNKS`` of ``CHUNK_BYTES`` bytes). A text is
then a row of shared chunks and pieces of its own, and every join is repaired: the words around it are encoded apart and
together, and with more words until both agree with what stands there. Which chunks are shared changes the time an encoding
takes, never its result.

A piece is encoded word by word with a memo where the tokenizer never looks across white space (probed, not assumed), and
by the library as a whole otherwise.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task per core already

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pressline.llm.frames import Batches, by_batch, narrow, texts  # noqa: E402

# A white-space byte in so many ends a chunk; chunks of prose have about 32 words.
CHUNK_WORDS = 32
# The shared chunks broadcast: 32 MB of text at most. Others are encoded where they stand.
SHARED_CHUNKS = 1 << 15
CHUNK_BYTES = 1 << 10
# Bytes hashed, and bytes given to the library, at a time; bound the memory a long text takes.
HASH_STEP = 1 << 20
PIECE_BYTES = 1 << 16
# Words of one generation of the memo; there are two.
MEMO_WORDS = 1 << 18
JOINS = 1 << 15
LEARN_WORDS = 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_GEAR = np.array([(b + 1) * 0x9E3779B1 & 0xFFFFFFFF for b in range(256)], np.uint32)
_WINDOW = 16
# Words a tokenizer is probed with, and marks often found at the end of a word.
_KINDS = ("a", "Zé", "x's", "'", "'s", "12", "3", "...", "#!", "ßä", "中文", "\u0301", "e\u0301", "🙂", "_", "<|", "|>", "\u00a0", "\u2003")
_MARKS = b".,;:!?$&%*#"
# Words of Latin letters, and the characters byte-level models have for bytes: printable ones stand for themselves, the others
# for the characters from U+0100 on, in order.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _SELF)}
_SMALL = [*map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]


def cuts(data: bytes) -> list[int]:
    """The places before white space at which ``data`` is cut, from 0 to its length."""
    found = [0]
    for start in range(0, len(data), HASH_STEP):
        # The window before the first place of a step is hashed with it, so steps do not change where cuts fall.
        first = max(0, start - _WINDOW)
        part = np.frombuffer(data, np.uint8)[first : start + HASH_STEP]
        mixed = _GEAR[part]
        for step in (1, 2, 4, 8):
            mixed[step:] = mixed[step:] + (mixed[: len(mixed) - step if len(mixed) > step else 0] << np.uint32(step))
        wanted = _SPACE[part[1:]] & ((mixed[:-1] >> np.uint32(16)) % np.uint32(CHUNK_WORDS) == 0)
        places = np.flatnonzero(wanted) + first + 1
        found += places[places >= max(start, 1)].tolist()
    found.append(len(data))
    return found


def _hash(chunk: bytes) -> int:
    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def encode_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# Ids are packed 32-bit numbers throughout: joining words is joining bytes.
ID = 4
# Hash to a chunk and its ids.
Shared = dict[int, tuple[bytes, bytes]]


def packed(ids) -> bytes:
    return np.fromiter(ids, "<i4", len(ids)).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<i4").tolist()


@dataclass
class Encoder:
    """A tokenizer from the text of its file, with a bounded memo of words."""

    source: str
    memo: dict[bytes, bytes] = field(default_factory=dict)
    older: dict[bytes, bytes] = field(default_factory=dict)
    joins: dict[tuple[bytes, bytes], tuple[bytes, bytes, bytes]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tokenizer = Tokenizer.from_str(self.source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.digits = [str(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.by_word = self._isolates_space()
        self.splits_marks, self.folds_case = self.by_word and self._splits_marks(), self.by_word and self._folds_case()
        self.model = self.tokenizer.model
        self.letters_alone = self.by_word and self._letters_alone()
        self.tokens = self._tokens()

    def library(self, data: bytes) -> bytes:
        return packed(self.tokenizer.encode(data.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)

    def _isolates_space(self) -> bool:
        """Whether white space between words of all kinds leaves the words' own ids, and nothing of its own."""
        alone = {k: self.library(k.encode()) for k in _KINDS}
        return all(
            self.library(f"{space}{a}{space}{b}{space}".encode()) == alone[a] + alone[b]
            for space in (" ", "\n", "\t", "\r\n", "  ", "\x0b", "\x0c") for a in _KINDS for b in _KINDS
        )

    def _splits_marks(self) -> bool:
        """Whether marks behind a letter or digit have the ids they have alone."""
        marks = [m + n for m in _MARKS.decode() for n in ("", *_MARKS.decode())]
        return all(
            self.library(f"{word}{m}".encode()) == self.library(word.encode()) + self.library(m.encode())
            for word in ("a", "Ab", "x's", "12", "3", "éz", "zé", "ß", "aÿ", "中a", "a.b", "#1", "<|x") for m in marks
        )

    def _folds_case(self) -> bool:
        """Whether a word of ASCII letters and digits, or of Latin letters, has the ids of its lower case."""
        upper = [c.upper() for c in _SMALL if c not in "ßÿ"]
        tried = [f"{left}{c}{right}" for c in upper for left in ("", "a", "Z9") for right in ("", "b", "Q", "7")]
        tried += [f"{left}{c}{right}" for c in upper for left in ("", "é", "À") for right in ("ß", "Éa")]
        return all(self.library(w.encode()) == self.library(w.lower().encode()) for w in tried)

    def _letters_alone(self) -> bool:
        """Whether the model alone gives a word of small Latin letters its ids: nothing before it changes or splits such a word but the
        byte-level characters, and no added token can lie in one."""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(_LATIN.fullmatch(encode_bytes(a)) for a in added):
            return False
        tried = _SMALL + [a + b for a in _SMALL for b in _SMALL] + ["".join(_SMALL), "internationalisation" * 9, "zéß" * 40]
        return all(self.library(w.encode()) == self._by_model(w.encode()) for w in tried)

    def _by_model(self, word: bytes) -> bytes:
        return array("i", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _tokens(self) -> list[str] | None:
        """The strings of all ids, where decoding is joining them by a space: a tokenizer without a decoder."""
        if self.tokenizer.decoder is not None:
            return None
        every = [self.tokenizer.id_to_token(i) for i in range(len(self.digits))]
        whole = None not in every and self.tokenizer.decode(list(range(len(every))), skip_special_tokens=False) == " ".join(every)
        return every if whole else None

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word and the marks at its end, where those are known to be encoded apart; the word folded where case is no matter."""
        core = word.rstrip(_MARKS) if self.splits_marks else word
        latin = _LATIN.fullmatch(core)
        if not latin and not core[-1:].isalnum():
            core = word
        marks = word[len(core) :]
        if self.folds_case and (latin or core.isalnum()):
            core = core.decode().lower().encode()
        return core, marks

    def _learn(self, lacking: list[bytes]) -> None:
        """Adds words to the memo; what is new in them goes to the model where that suffices, else to the library in calls of many
        words with a space between."""
        parts = [self._parts(w) for w in lacking]
        new = list(dict.fromkeys(p for pair in parts for p in pair if p and p not in self.memo))
        if self.letters_alone:
            rest = []
            for word in new:
                if _LATIN.fullmatch(word) and (self.folds_case or word.decode().islower()):
                    self.memo[word] = self._by_model(word)
                else:
                    rest.append(word)
            new = rest
        for k in range(0, len(new), LEARN_WORDS):
            self._encode_words(new[k : k + LEARN_WORDS])
        for word, (core, marks) in zip(lacking, parts, strict=True):
            if word not in self.memo:
                self.memo[word] = self.memo[core] + self.memo[marks] if marks else self.memo[core]

    def _encode_words(self, new: list[bytes]) -> None:
        plain = [w.decode("utf-8", "surrogatepass") for w in new]
        made = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in plain])
        starts = np.array([o[0] for o in made.offsets], np.int64)
        owner = np.searchsorted(ends, starts, side="right")
        if len(starts) and ((starts[1:] < starts[:-1]).any() or (starts + 1 == ends[owner]).any()):
            self.memo.update((w, self.library(w)) for w in new)
            return
        bounds = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
        ids = packed(made.ids)
        self.memo.update((w, ids[ID * bounds[k] : ID * bounds[k + 1]]) for k, w in enumerate(new))

    def piece(self, data: bytes) -> bytes:
        if not self.by_word:
            return self.library(data)
        words = data.split()
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        lacking = set(words).difference(self.memo)
        if lacking:
            known = {w for w in lacking if w in self.older}
            self.memo.update((w, self.older[w]) for w in known)
            self._learn(list(lacking - known))
        return b"".join(map(self.memo.__getitem__, words))

    def join(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> bytes:
        """The ids of ``left + right`` from the ids of both, repaired around the join.

        Words around it are encoded apart and together. The outer ids are kept where those of the words apart are what
        stands there; else the same is tried with twice the words, up to both parts as a whole.
        """
        words = 1
        while True:
            tail, head = _last_words(left, words), _first_words(right, words)
            if (tail, head) not in self.joins:
                if len(self.joins) >= JOINS:
                    self.joins.clear()
                self.joins[tail, head] = self.library(tail), self.library(head), self.library(tail + head)
            a, b, both = self.joins[tail, head]
            if len(tail) == len(left) and len(head) == len(right):
                return both
            if left_ids.endswith(a) and right_ids.startswith(b) and self._settled(a, b, both, words):
                return left_ids[: len(left_ids) - len(a)] + both + right_ids[len(b) :]
            words *= 2

    def _settled(self, a: bytes, b: bytes, both: bytes, words: int) -> bool:
        """The join changes nothing; or the ids at both outer ends are those of the words apart."""
        return a + b == both or words > 1 and bool(a and b) and both[:ID] == a[:ID] and both[-ID:] == b[-ID:]


def _last_words(data: bytes, words: int) -> bytes:
    at = len(data)
    for _ in range(words):
        kept = data[:at].rstrip()
        at = max(kept.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at < 0:
            return data
    return data[at:]


def _first_words(data: bytes, words: int) -> bytes:
    at = 0
    for _ in range(words):
        at = len(data) - len(data[at:].lstrip())
        ends = [e for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := data.find(s, at)) >= 0]
        if not ends:
            return data
        at = min(ends)
    return data[:at]


_ENCODERS: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The encoder of a tokenizer file, built once per worker."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def encode(data: bytes, own: Encoder, shared: Shared) -> bytes:
    """The ids of a text: shared chunks are looked up, what lies between is encoded, joins are repaired."""
    places = cuts(data)
    parts: list[tuple[bytes, bytes]] = []
    start = 0
    for a, b in zip(places, places[1:]):
        known = shared.get(_hash(data[a:b])) if shared and b - a <= CHUNK_BYTES else None
        if known and known[0] == data[a:b]:
            if a > start:
                parts.append((data[start:a], own.piece(data[start:a])))
            parts.append(known)
            start = b
        elif b - start >= PIECE_BYTES:
            parts.append((data[start:b], own.piece(data[start:b])))
            start = b
    if start < len(data):
        parts.append((data[start:], own.piece(data[start:])))
    return _joined(parts, own)


def _joined(parts: list[tuple[bytes, bytes]], own: Encoder) -> bytes:
    """Joins neighbours. Where words are apart, what stands before the last word of a part is closed."""
    if not parts:
        return b""
    done: list[bytes] = []
    left, ids = parts[0]
    for right, right_ids in parts[1:]:
        merged = own.join(left, ids, right, right_ids)
        if own.by_word and right.strip():
            left = _last_words(right, 1)
            cut = len(merged) - len(own.piece(left))
            done.append(merged[:cut])
            ids = merged[cut:]
        else:
            left, ids = left + right, merged
    return b"".join([*done, ids])


def shared_chunks(docs: DataFrame, source: str, limit: int = SHARED_CHUNKS) -> Shared:
    """Hash to (chunk, ids) of the chunks that stand in all documents at least twice and save most.

    Hashes are counted over all texts; only the kept hashes, their texts and ids reach the driver, within the bound above.
    """
    docs = narrow(docs, "text").where("text IS NOT NULL")

    @by_batch
    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sizes = [], []
        for text in texts(batch.column(0)):
            data = encode_bytes(text)
            places = cuts(data)
            for a, b in zip(places, places[1:]):
                if b - a <= CHUNK_BYTES:
                    found.append(_hash(data[a:b]))
                    sizes.append(b - a)
        values, first, n = np.unique(np.array(found, np.int64), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.array(sizes, np.int64)[first]), pa.array(n)], ["h", "size", "n"])

    counted = docs.mapInArrow(hashes, "h long, size long, n long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    best = counted.where("n > 1").orderBy(F.expr("(n - 1) * size").desc(), "h").limit(limit).select("h")
    kept = docs.sparkSession.sparkContext.broadcast({r["h"] for r in best.collect()})
    if not kept.value:
        return {}

    def fetch(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for text in texts(batch.column(0)):
                data = encode_bytes(text)
                places = cuts(data)
                for a, b in zip(places, places[1:]):
                    if b - a <= CHUNK_BYTES and (h := _hash(data[a:b])) in kept.value and h not in seen:
                        seen.add(h)
                        found.append((h, data[a:b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["h", "chunk"]
            )

    tokenizer = docs.sparkSession.sparkContext.broadcast(source)

    @by_batch
    def ids(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(tokenizer.value)
        made = [own.piece(c.as_py()) for c in batch.column(1)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], ["h", "chunk", "ids"])

    chunks = docs.mapInArrow(fetch, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))
    encoded = chunks.mapInArrow(ids, "h long, chunk binary, ids binary")
    return {r["h"]: (bytes(r["chunk"]), bytes(r["ids"])) for r in encoded.collect()}


def _map(docs: DataFrame, path: str, finish: Callable[[Iterator], list[pa.Array]], fields: list[StructField]) -> DataFrame:
    """``doc_id`` and the columns ``finish`` makes of the (ids, decoded text) of each batch."""
    docs = narrow(docs, "doc_id", "text")
    with open(path, encoding="utf-8") as file:
        source = file.read()
    context = docs.sparkSession.sparkContext
    tokenizer, chunks = context.broadcast(source), context.broadcast(shared_chunks(docs, source))

    def coded(column: pa.Array) -> Iterator[tuple[bytes, list[int], str, Encoder]]:
        own = encoder(tokenizer.value)
        for text in texts(column):
            ids = encode(encode_bytes(text), own, chunks.value)
            numbers = unpacked(ids)
            yield ids, numbers, own.decode(numbers), own

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *finish(coded(batch.column(1)))], ["doc_id", *[f.name for f in fields]])

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], *fields]))


def _sha256(text: str) -> str:
    return hashlib.sha256(encode_bytes(text)).hexdigest()


def coded(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row of ``docs(doc_id, text, ...)``; ``path`` is a tokenizers file the driver can read.

    ``ids`` are those of the whole text without special tokens added, ``decoded`` their decoding with special tokens kept.
    A null or empty text has no ids and decodes to an empty text. Repeated rows keep one row each; an empty table gives an
    empty table.
    """
    def finish(found) -> list[pa.Array]:
        sizes, ids, decoded = [0], [], []
        for own, _, text, _ in found:
            ids.append(own)
            sizes.append(sizes[-1] + len(own) // ID)
            decoded.append(text)
        numbers = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), numbers), pa.array(decoded, pa.string())]

    return _map(docs, path, finish, [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ``coded`` with its lists and texts digested in the same task."""
    def finish(found) -> list[pa.Array]:
        rows = [
            (len(ids), _sha256(" ".join(map(own.digits.__getitem__, ids))), _sha256(decoded)) for _, ids, decoded, own in found
        ]
        return [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]]

    return _map(docs, path, finish, [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ])
