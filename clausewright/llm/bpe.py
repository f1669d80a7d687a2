"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols; decoding joins vocabulary strings.

The vocabulary file is a parameter (a path that every executor can open, as an installed package has it); it is never
copied or trained. Texts are encoded where they lie: no shuffle, and a task holds one Arrow batch and a bounded memo of words.
A long text is split piece by piece from segments of about SEGMENT characters, and a long word is merged in flat arrays.

Letters and digits are those of Unicode 16.0, which the published tokenizers library has built in, whatever the tables of the
expression module: those of the interpreter's unicodedata (15.1) and the ones that 16.0 added."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read

#: The published split of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LN}]+|\s+(?!\S)|\s+"
#: Characters of a long text that are split at a time.
SEGMENT = 1 << 20

# Letters and digits that Unicode 16.0 added to 15.1, first and last of each range.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
DIGITS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _frozen(kind: str, added: list[tuple[int, int]]) -> set[str]:
    """The characters of a general category in Unicode 16.0."""
    return {chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind} | {chr(c) for a, b in added for c in range(a, b + 1)}


def _ranges(chars: set[str]) -> str:
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Splitter:
    """Calls give a text's pieces. ASCII texts have the split spelt out in ASCII ranges. For others the module's own classes serve where they agree with Unicode 16.0 on all of a text's characters; else the classes are spelt out, which is slower."""

    def __init__(self):
        letters, digits = _frozen("L", LETTERS_16), _frozen("N", DIGITS_16)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.odd = frozenset(letters ^ set(regex.findall(r"\p{L}", every)) | digits ^ set(regex.findall(r"\p{N}", every)))
        made = lambda l, n: regex.compile(PATTERN.replace("{L}", f"[{l}]").replace("{N}", f"[{n}]").replace("{LN}", l + n)).findall
        self.usual, self.spelt = made(r"\p{L}", r"\p{N}"), made(_ranges(letters), _ranges(digits))
        ascii_only = PATTERN.replace("{L}", "[A-Za-z]").replace("{N}", "[0-9]").replace("{LN}", "A-Za-z0-9")
        self.ascii = re.compile(ascii_only.replace(r"[^\s", r"[^\t-\r ").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.usual(text) if self.odd.isdisjoint(text) else self.spelt(text)


#: Words in each of the two halves of a worker's memo. A full half replaces the older one, so words that come again stay.
MEMO = 300_000


class Memo(dict):
    """Pieces and the bytes of their ids; a piece that isn't there is worked out, and kept if it is short."""

    def __init__(self, word):
        self.word, self.older = word, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.word(piece).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """encode(text) -> ids and decode(ids) -> text, as the vocabulary file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [0] * 256
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split = Splitter()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.texts = list(map(str, range(max(self.bytes_of) + 1)))
        self.memo = Memo(self.word)

    def word(self, piece: str) -> array:
        """Ids of one piece: the lowest rank merges first, ties to the left. A queue entry is rank and place in one number; one whose place has no pair of that rank any more is skipped."""
        ids = list(map(self.byte_ids.__getitem__, piece.encode("utf-8")))
        n, get, made_of = len(ids), self.merges.get, self.made
        # The rank of the pair that begins at each place, -1 for none.
        ranks = [get(pair, -1) for pair in zip(ids, ids[1:])] + [-1]
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return array("i", ids)
        heapify(queue)
        numbers = list if n < 1 << 16 else lambda x: array("i", x)
        after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> bits, entry & place
            if ranks[i] != rank:
                continue
            j, made = after[i], made_of[rank]
            ids[i], ids[j], ranks[j] = made, -1, -1
            k = after[i] = after[j]
            ranks[i] = -1
            if k < n:
                before[k] = i
                r = ranks[i] = get((made, ids[k]), -1)
                if r >= 0:
                    heappush(queue, r << bits | i)
            h = before[i]
            if h >= 0:
                r = ranks[h] = get((ids[h], made), -1)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return array("i", [x for x in ids if x >= 0])

    def _plain(self, text: str, out: array) -> None:
        out.frombytes(b"".join(map(self.memo.__getitem__, self.split(text))))

    def encode(self, text: str) -> array:
        """A special token's string is that token wherever it stands."""
        out = array("i")
        parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                for segment in segments(part):
                    self._plain(segment, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.texts.__getitem__, ids))


_EDGE = regex.compile(r"(?<=[!-~])(?= )")


def segments(text: str) -> Iterator[str]:
    """The text cut before spaces that follow a visible ASCII character, where no piece goes across."""
    at = 0
    while len(text) - at > SEGMENT and (m := _EDGE.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:] if at else text


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs's own rows as doc_id, n_tokens long, ids_sha256, decoded_sha256 and, if asked, ids array<int> and decoded string.

    A null or empty text has no tokens and the digests of empty strings. Rows are kept one for one: a null or repeated doc_id
    stays as it is, and other columns of docs are left out, so their names can't clash."""
    import pyarrow as pa

    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        bpe = tokenizer(path)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for doc_id, texts in _slices(batch):
                out = []
                for t in texts:
                    ids = bpe.encode(t or "")
                    decoded = bpe.decode(ids)
                    out.append((len(ids), digest(bpe.listed(ids).encode()), digest(decoded.encode()), ids.tolist() if with_ids else None, decoded if with_ids else None))
                cols = list(zip(*out))
                arrays = [doc_id, pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                if with_ids:
                    arrays += [pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def _slices(batch, rows: int = 256):
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part.column(0), part.column(1).to_pylist()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_path(), with_ids=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, as doc_id, n_tokens, ids and the digests of ids and decoded text; the last stage gives tokens in place of texts, so text, lang, source and n_chars end here."""
    return encode_documents(docs, default_path(), with_ids=True).drop("decoded")
