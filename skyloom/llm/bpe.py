"""Byte-level BPE encoding and decoding, and edit-aware token counting.

Words of a batch are merged together: their symbols stand in one flat array,
each round looks up all adjacent pairs by binary search over the sorted pair
keys, and every word merges its pair of lowest rank. A worker keeps the words
it has met (bounded), so a frequent word is merged once.

Defined cases: a null text is the empty text (0 tokens); repeated rows each
give a row; extra columns are ignored; a very long text stays whole and the
batch around it is cut by bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import map_arrow, map_batches, slices

#: Pre-token pattern of the public byte-level vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps before it starts anew.
KEPT_WORDS = 150_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte.

    Printable Latin-1 characters stand for themselves, the other bytes take
    the code points from 256 on in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """A byte-level BPE model read from the JSON of a tokenizer file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        chars = byte_characters()
        as_byte = {c: b for b, c in enumerate(chars)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.of_byte = np.array([vocab[c] for c in chars], np.int64)
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for text, k in vocab.items():
            pieces[k] = bytes(as_byte[c] for c in text)
        for text, k in self.special.items():
            pieces[k] = text.encode()
        self.token_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into[order]
        self.none = len(merges)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token's string is a piece of its own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.find(part)
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (none: no merge) and its place in the sorted keys."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word: (ids of all, len + 1 offsets), by rounds over all words at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, at = np.full(len(sym), self.none), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], at[inner] = self.look_up(sym[inner], sym[inner + 1])
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff(np.append(starts, len(sym))))
            ready = each == self.none
            keep = ~ready
            done_sym.append(sym[ready])
            done_word.append(word[ready])
            hit = np.flatnonzero((rank == each) & keep)
            # in a run of overlapping hits (a a a a) the 1st, 3rd, ... merge
            place = np.arange(len(hit))
            first = np.concatenate([[True], np.diff(hit) > 1])[: len(hit)]
            hit = hit[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            sym[hit] = self.into[at[hit]]
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            rank[touched] = self.none
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], at[touched] = self.look_up(sym[touched], sym[touched + 1])
        ids, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that are not kept yet."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if not new:
            return
        ids, at = self.merge([b"" if p in self.special else p.encode() for p in new])
        if self.special and any(p in self.special for p in new):
            parts = [np.array([self.special[p]]) if p in self.special else ids[at[k] : at[k + 1]] for k, p in enumerate(new)]
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def indices(self, pieces: list[str]) -> list[int]:
        """Places of the pieces among the kept words, which they join if needed."""
        try:
            return list(map(self.index.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            return list(map(self.index.__getitem__, pieces))

    def counts(self, places: np.ndarray) -> np.ndarray:
        return self.at[places + 1] - self.at[places]

    def encode(self, text: str) -> np.ndarray:
        if len(self.index) > KEPT_WORDS:
            self.forget()
        places = np.array(self.indices(self.pieces(text)), np.int64)
        return gather(self.ids, self.at, places)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.token_bytes, self.token_at, ids).tobytes().decode("utf-8", "replace")


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenation of values[at[k] : at[k + 1]] for the k in which."""
    sizes = at[which + 1] - at[which]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(at[which] - (ends - sizes), sizes) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def model(data: bytes) -> Bpe:
    """The worker's model of a tokenizer file, kept between batches."""
    return Bpe(data)


def tokenizer_file(docs: DataFrame, path: str | None):
    """The tokenizer file (a few MB, whatever the corpus) as a broadcast."""
    with open(path or default_tokenizer(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns doc_id, n_tokens long, ids array<int>, decoded string; one row for
    each row of docs.
    """
    shared = tokenizer_file(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for part in (part for batch in batches for part in slices(batch, "text")):
            if len(bpe.index) > KEPT_WORDS:
                bpe.forget()
            pieces = [bpe.pieces(t or "") for t in part.column("text").to_pylist()]
            places = np.array(bpe.indices(list(chain.from_iterable(pieces))), np.int64)
            words_at = np.concatenate([[0], np.cumsum(list(map(len, pieces)))])
            flat = gather(bpe.ids, bpe.at, places)
            tokens_at = np.concatenate([[0], np.cumsum(bpe.counts(places))])[words_at]
            raw = gather(bpe.token_bytes, bpe.token_at, flat)
            bytes_at = np.concatenate([[0], np.cumsum(bpe.token_at[flat + 1] - bpe.token_at[flat])])[tokens_at].tolist()
            data = raw.tobytes()
            decoded = [data[i:j].decode("utf-8", "replace") for i, j in zip(bytes_at[:-1], bytes_at[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(tokens_at, pa.int32()), pa.array(flat, pa.int32()))
            out = [part.column("doc_id"), pa.array(np.diff(tokens_at), pa.int64()), ids, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    """Digests of bpe_encode_decode's ids (decimal, joined by commas) and decoded texts."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


class CountTree:
    """Token count of one text that follows edits.

    Leaves are blocks of pre-tokens with their code points and tokens; inner
    nodes hold sums. An edit re-encodes the blocks that it touches plus
    boundary context, until a boundary of the new pre-tokens meets an old one,
    and updates the sums above these blocks.
    """

    BLOCK = 64
    #: Code points beside an edit that can change pre-tokens: above the longest special token and contraction.
    CONTEXT = 16

    def __init__(self, bpe: Bpe, text: str, pieces: list[str] | None = None):
        self.bpe, self.reencoded = bpe, 0
        self.waiting: dict[int, list[str]] = {}  # pre-tokens of edited blocks that are not counted yet
        pieces = bpe.pieces(text) if pieces is None else pieces
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        tokens = np.cumsum(bpe.counts(np.array(bpe.indices(pieces), np.int64)))
        self.pieces = len(pieces)
        last = np.append(np.arange(self.BLOCK - 1, max(len(pieces) - 1, 0), self.BLOCK), len(pieces) - 1) if pieces else np.zeros(0, int)
        bounds = [0, *ends[last].tolist()]
        self.texts = [text[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.size = 1 << max(0, (len(self.texts) - 1)).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(last)] = np.diff(bounds)
        self.tokens[self.size : self.size + len(last)] = np.diff(tokens[last], prepend=0)
        half = self.size
        while half > 1:
            for sums in (self.chars, self.tokens):
                sums[half // 2 : half] = sums[half : 2 * half].reshape(-1, 2).sum(1)
            half //= 2

    def settle(self) -> None:
        """Count the edited blocks and update the sums above them."""
        for block, pieces in self.waiting.items():
            tokens = int(self.bpe.counts(np.array(self.bpe.indices(pieces), np.int64)).sum()) if pieces else 0
            self.add(self.tokens, block, tokens - int(self.tokens[block + self.size]))
        self.waiting.clear()

    @property
    def total(self) -> int:
        self.settle()
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def block_at(self, position: int) -> tuple[int, int]:
        """The block with that code point, and the block's start; past the end, the last block with text."""
        node, start = 1, 0
        position = min(position, self.length - 1)
        while node < self.size:
            left = 2 * node
            if position < start + self.chars[left]:
                node = left
            else:
                start += int(self.chars[left])
                node = left + 1
        return node - self.size, start

    def add(self, sums: np.ndarray, block: int, more: int) -> None:
        node = block + self.size
        while node:
            sums[node] += more
            node //= 2

    def put(self, block: int, text: str, pieces: list[str]) -> None:
        self.texts[block] = text
        self.add(self.chars, block, len(text) - int(self.chars[block + self.size]))
        self.waiting[block] = pieces

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace code points start to end (both within the text) by text."""
        start, end = max(0, min(start, self.length)), max(0, min(end, self.length))
        end = max(start, end)
        if not self.texts:
            again = self.reencoded
            self.__init__(self.bpe, text)
            self.reencoded = again + self.pieces
            return
        first, at = self.block_at(max(0, start - self.CONTEXT))
        last = self.block_at(min(self.length, end + self.CONTEXT))[0]
        while True:
            region = "".join(self.texts[first : last + 1])
            region = region[: start - at] + text + region[end - at :]
            ahead, k = "", last + 1
            while k < len(self.texts) and len(ahead) < self.CONTEXT:
                ahead += self.texts[k]
                k += 1
            pieces = self.bpe.pieces(region + ahead)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            self.reencoded += len(pieces)
            stop = int(np.searchsorted(ends, len(region)))
            if not ahead or not region or ends[stop] == len(region):
                break
            last = k - 1
        self.put(first, region, pieces[: stop + 1] if region else [])
        for block in range(first + 1, last + 1):
            self.put(block, "", [])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokens of every whole text before and after its edits.

    docs: doc_id, text and, for each row, edits array<struct<start:int, stop:int,
    text:string>>, applied in order, each to the text that the former left
    (null: no edits). Positions are code points, cut to the text.
    Returns doc_id, n_tokens, edited_tokens, n_pieces (pre-tokens of the text),
    reencoded (pre-tokens encoded again for the edits), all long.
    """
    shared = tokenizer_file(docs, path)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = model(shared.value)
        rows = []
        for part in slices(batch, "text"):
            if len(bpe.index) > KEPT_WORDS:
                bpe.forget()
            texts = [t or "" for t in part.column("text").to_pylist()]
            pieces = [bpe.pieces(t) for t in texts]
            bpe.learn(chain.from_iterable(pieces))  # the words of all texts together
            trees = [CountTree(bpe, t, p) for t, p in zip(texts, pieces, strict=True)]
            before = [tree.total for tree in trees]
            for tree, changes in zip(trees, part.column("edits").to_pylist(), strict=True):
                for e in changes or ():
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
            bpe.learn(chain.from_iterable(p for tree in trees for p in tree.waiting.values()))
            rows += [(n, tree.total, tree.pieces, tree.reencoded) for n, tree in zip(before, trees, strict=True)]
        cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "edited_tokens", "n_pieces", "reencoded"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text", "edits")
    return map_arrow(chosen, one, "doc_id long, n_tokens long, edited_tokens long, n_pieces long, reencoded long")
