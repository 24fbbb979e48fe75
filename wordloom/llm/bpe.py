"""BPE encoding and decoding with a public tokenizer file (BPE with word ends).

Encoding keeps, per short word, its parts side by side and the rank of each adjacent pair in a
contiguous array: the least rank is found by scanning, its boundary is deleted, and the ranks of the
two new neighbours are looked up again, until no adjacent pair has a rank. Words of similar length are
rows of one matrix, so that one scan serves thousands of words. A word beyond ``SHORT`` parts goes
through a heap of ranks over linked parts, with the same result in n log n.

Each Python worker remembers the words it has met (up to ``CACHE_WORDS`` words and ``CACHE_BYTES`` of them, then
it starts anew), so the merges run once per distinct word. Nothing is shuffled. Texts are cut at blanks into pieces of
about ``PIECE`` characters, so that the words of a long text are never all held as objects.

Special token strings in a text become their ids, before any normalization. Then: NFC, lower case
character by character, words by the tokenizer's own pattern, bytes, merges. Decoding joins the tokens
of the file's alphabet with blanks, as a tokenizer without a decoder does.

Code points that no version of Unicode before 17 assigns may be taken as letters here and not there.

Defined results: a null text encodes as an empty one, to no ids; null ids decode to an empty text;
repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts up to which a word is merged by scanning.
SHORT = 64
CACHE_WORDS = 100_000
CACHE_BYTES = 8 << 20
#: Rows and characters that are coded at once.
ROWS, CHARACTERS = 256, 1 << 20
PIECE = 1 << 16
#: Words held before their ids are looked up.
GATHER = 50_000
NONE = np.int32(2**31 - 1)
#: Lower case that Python's own tables lack or do by context. Fixed values of Unicode 16.
LOWER = str.maketrans({
    "Σ": "σ",
    "\u1c89": "\u1c8a",
    "\ua7cb": "\u0264",
    "\ua7cc": "\ua7cd",
    "\ua7da": "\ua7db",
    "\ua7dc": "\u019b",
} | {chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)})


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Tables of one tokenizer file and the words met so far."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)  # a merge's rank is its place in the file
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.met: dict[str, bytes] = {}
        self.met_bytes = 0

    # -- merging -------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words with 2 to ``width`` bytes."""
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts = self.inner[raw]
        rows = np.arange(len(words))
        parts[rows, n - 1] = self.final[raw[rows, n - 1]]
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        ranks[np.arange(width) >= (n - 1)[:, None]] = NONE
        done_parts, done_n, live = np.empty_like(parts), n.copy(), rows
        columns = np.arange(width)
        while len(live):
            best = ranks.argmin(1)
            line = np.arange(len(live))
            least = ranks[line, best]
            over = least == NONE
            if over.any():
                done_parts[live[over]], done_n[live[over]] = parts[over], n[over]
                go = ~over
                parts, ranks, n, live, best, least = (x[go] for x in (parts, ranks, n, live, best, least))
                line = np.arange(len(live))
                if not len(live):
                    break
            parts[line, best] = self.made[least]
            # delete the boundary: what follows moves up by one
            source = columns + (columns > best[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NONE
            n = n - 1
            after = np.minimum(best + 1, width - 1)
            fresh = self._rank(parts[line, best], parts[line, after])
            ranks[line, best] = np.where(best < n - 1, fresh, NONE)
            before = np.maximum(best - 1, 0)
            fresh = self._rank(parts[line, before], parts[line, best])
            ranks[line, before] = np.where(best > 0, fresh, ranks[line, before])
        packed = done_parts.astype("<u4")
        return [packed[i, :k].tobytes() for i, k in enumerate(done_n)]

    def _merge_long(self, word: bytes) -> bytes:
        data = np.frombuffer(word, np.uint8)
        parts = self.inner[data].copy()
        parts[-1] = self.final[data[-1]]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        parts, alive = parts.tolist(), [True] * n
        first = self._rank(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = int(self.made[rank])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n:
                    r = int(self._rank(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p, on in zip(parts, alive, strict=True) if on], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes the words not met yet."""
        new = [w for w in words if w not in self.met]
        size = sum(map(len, new))
        if len(self.met) + len(new) > CACHE_WORDS or self.met_bytes + size > CACHE_BYTES:
            self.met.clear()
            self.met_bytes = 0
            new = list(words)
            size = sum(map(len, new))
        self.met_bytes += size
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            data = w.encode()
            if len(data) == 1:
                self.met[w] = self.final[data[0]].astype("<u4").tobytes()
            elif len(data) > SHORT:
                self.met[w] = self._merge_long(data)
            else:
                by_width.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((w, data))
        for width, group in by_width.items():
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                self.met.update(zip((w for w, _ in part), self._merge_rows([d for _, d in part], width), strict=True))

    # -- texts ---------------------------------------------------------------------------

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Normalized pieces of a text, cut at blanks, and ids of special tokens."""
        for run in self.marks.split(text) if self.marks else [text]:
            if run in self.special:
                yield self.special[run]
                continue
            at = 0
            while at < len(run):
                end = len(run)
                if end - at > PIECE:
                    cut = max(run.rfind(" ", at + 1, at + PIECE), run.rfind("\n", at + 1, at + PIECE))
                    if cut < 0:  # a single word fills the piece: go on to the next blank
                        found = [x for x in (run.find(" ", at + PIECE), run.find("\n", at + PIECE)) if x >= 0]
                        cut = min(found, default=end)
                    end = cut
                piece = run[at:end]
                if not piece.isascii():
                    # lower case by character: a final sigma stays a plain one
                    piece = unicodedata.normalize("NFC", piece).translate(LOWER)
                yield piece.lower()
                at = end

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit integers.

        Words of many texts are gathered until ``GATHER`` are held, so that their merges share scans.
        """
        held: list[list[str] | int | None] = []  # pieces of texts; None ends a text
        size, done = 0, []

        def settle() -> Iterator[bytes]:
            nonlocal size, done
            lists = [x for x in held if isinstance(x, list)]
            self.learn(set().union(*lists))
            met = self.met
            for x in held:
                if x is None:
                    yield b"".join(done)
                    done = []
                elif isinstance(x, int):
                    done.append(x.to_bytes(4, "little"))
                else:
                    done.extend([met[w] for w in x])
            held.clear()
            size = 0

        for text in texts:
            for piece in self._pieces(text):
                if not isinstance(piece, int):
                    piece = self.pattern.findall(piece)
                    size += len(piece)
                held.append(piece)
                if size >= GATHER:
                    yield from settle()
            held.append(None)
        yield from settle()

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_OPEN: dict[str, WordBpe] = {}


def _open(key: str, file) -> WordBpe:
    """One set of tables per worker process."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordBpe(file.value)
    return _OPEN[key]


def _file_of(df: DataFrame, path: str):
    """The tokenizer file, sent once to each executor; some MB, whatever the corpus holds."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids: binary, little-endian unsigned 32-bit integers of the whole text."""
    file = _file_of(docs, path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    schema = rows.select("_id").schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _open(path, file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = pa.array(list(bpe.encode_all(t.as_py() or "" for t in part.column(1))), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["_id", "ids"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ids) with ``decoded``: the text of the ids, special tokens included."""
    file = _file_of(encoded, path)
    rows = encoded.select(F.col(id_col).alias("_id"), "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _open(path, file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pa.array([bpe.decode(i.as_py() or b"") for i in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts.cast(pa.string())], names=["_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (id, text), bounded in rows and, but for a longer text, in characters."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    lo, held = 0, 0
    for k, length in enumerate(lengths):
        if k > lo and (k - lo == ROWS or held + length > CHARACTERS):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += length
    if batch.num_rows:
        yield batch.slice(lo)


def code_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids, and the digests of the ids and of the text decoded from them.

    One Python step: each worker holds the tokenizer once, and decoded texts never leave it.
    """
    file = _file_of(docs, path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    schema = rows.select("_id").schema.add("n_tokens", "long").add("ids", "binary")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _open(path, file)
        for batch in batches:
            for part in _slices(batch):
                ids = list(bpe.encode_all(t.as_py() or "" for t in part.column(1)))
                columns = [
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
