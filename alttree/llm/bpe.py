"""BPE encoding and decoding of whole texts, equal to the tokenizers library's, with a tree for long unsplit text.

Texts are cut at ASCII white space, across which no token reaches; each different word is encoded once per worker and
then looked up. Texts of Latin letters are cut into the library's pieces some hundred at a time, by arrays of their characters; equal
pieces found by hash (and compared) are looked up once. A stretch without a cut that is longer than `long` bytes would keep one task busy, so it is split into
leaves that Spark encodes in parallel, and neighbours are concatenated pairwise up a tree: a window of tokens round
each join is encoded anew and doubled until its first and last tokens equal the old ones, which makes the joined
tokens those of the whole text (every neighbouring pair of tokens is then one that BPE itself makes).

Null texts count as empty and have no tokens. Rows are encoded one by one, repeated ones too; other columns are not
read. Strings of special tokens inside a text are encoded as these tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm.tables import keep, partitions, read, utf8
from alttree.llm.wordbytes import give_back, running, stretch

K = TypeVar("K")
LONG = 4096
CACHE, PIECES = 300_000, 100_000  # words or Latin pieces of a cache generation, and pieces of other words


def _latin(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] in kinds)


# Characters below U+0250 need no normalisation but lower case, so their pieces are found without the library.
LATIN = re.compile(f"[{_latin('LNPS')}]*")
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[{_latin('PS')}]+")
LATIN_TEXT = re.compile(f"[{_latin('LNPS')} \\t\\n\\v\\f\\r]*")
SPACE, LETTER, NUMBER, SIGN = range(4)
KINDS = np.array([{"L": LETTER, "N": NUMBER, "P": SIGN, "S": SIGN}.get(unicodedata.category(chr(c))[0], SPACE) for c in range(0x250)], np.int8)
KINDS[:0x21] = SPACE
CHARACTERS = np.random.default_rng(20240602).integers(1, 2**64, 0x250, dtype=np.uint64)
TOGETHER = 1 << 19  # characters of texts that are cut together
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte-level alphabet: shown bytes as they are, the others from U+0100 on.
BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Item:
    """Part of a text in order: ready ids, or the leaves of one long piece (its symbols, still to be encoded)."""

    ids: bytes
    leaves: list[str]


class Recent(dict[K, bytes]):
    """A function's values for the keys seen lately: two generations of `size` keys at most."""

    def __init__(self, make: Callable[[K], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: K) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: Iterable[K]) -> list[bytes]:
        return list(map(self.__getitem__, keys))


class Encoder:
    """The library's encoding, word by word, with a bounded cache."""

    def __init__(self, path: str, long: int = LONG):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.long = self.tokenizer.model, long
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.path = path
        self.pieces, self.words = Recent(self._piece, PIECES), Recent(self._word, CACHE)

    @cached_property
    def spec(self) -> dict:
        """The model as written; read where a long piece asks for it, as it takes more memory than the library."""
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    @cached_property
    def ranks(self) -> dict[tuple[str, ...], int]:
        pairs = (m if isinstance(m, list) else m.split(" ") for m in self.spec["merges"])
        return {tuple(m): k for k, m in enumerate(pairs)}

    @property
    def vocab(self) -> dict[str, int]:
        return self.spec["vocab"]

    @property
    def suffix(self) -> str:
        return self.spec.get("end_of_word_suffix") or ""

    def token(self, i: int) -> str:
        return self.tokenizer.id_to_token(i)

    def split(self, text: str) -> list[str]:
        """Pieces of a stretch without special tokens, in the model's symbols."""
        low = text.lower()
        if LATIN.fullmatch(low):
            return list(map(byte_letters, LATIN_PIECES.findall(low)))
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _piece(self, piece: str) -> bytes:
        return ids_bytes([t.id for t in self.model.tokenize(piece)])

    def latin(self, text: bytes) -> str | None:
        """A text in lower case, with a space before it, if it has Latin letters alone and no special tokens and is not too long for arrays."""
        low = text.decode("utf-8", "replace").lower()
        return f" {low}" if len(low) < 2 * TOGETHER and "<|" not in low and LATIN_TEXT.fullmatch(low) else None

    def latin_ids(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts as `latin` gives them; None for those with long pieces."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        start, end = latin_pieces(codes)
        heads = np.cumsum([0, *map(len, texts)])
        long = np.unique(np.searchsorted(heads, start[2 * (end - start) > self.long], "right") - 1)
        if len(long):
            some = [t for k, t in enumerate(texts) if k not in set(long.tolist())]
            rest = iter(self.latin_ids(some) if some else [])
            return [None if k in set(long.tolist()) else next(rest) for k in range(len(texts))]
        first, which = alike(codes, start, end)
        ids = self.words.all([joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.cumsum(sizes)
        after = np.cumsum(sizes[which])  # ids up to each piece's last
        at = np.repeat((ends - sizes)[which] - (after - sizes[which]), sizes[which]) + np.arange(after[-1] if len(after) else 0)
        flat = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cut = np.concatenate([[0], after])[np.searchsorted(start, heads)] * 4
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _word(self, word: bytes | str) -> bytes:
        """Ids of a stretch without ASCII white space, or, if it is no bytes, of one of a Latin text's pieces."""
        if isinstance(word, str):
            return self._piece(byte_letters(word))
        text = word.decode("utf-8", "replace")
        if "<|" in text and self.special.search(text):
            return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(self.pieces.all(self.split(text)))

    def items(self, words: list[bytes]) -> list[Item]:
        """A text's words in order, long pieces as leaves."""
        out: list[Item] = []

        def ready(ids: bytes) -> None:
            if not out or out[-1].leaves:
                out.append(Item(b"", []))
            out[-1].ids += ids

        for w in words:
            if len(w) <= self.long:
                ready(self.words[w])
                continue
            text = w.decode("utf-8", "replace")
            at = 0
            for m in [*self.special.finditer(text), None]:
                for p in self.split(text[at:m.start() if m else len(text)]):
                    if len(p) <= self.long:
                        ready(self.pieces[p])
                    else:
                        out.append(Item(b"", [p[k:k + self.long] for k in range(0, len(p), self.long)]))
                if m:
                    ready(ids_bytes([self.tokenizer.token_to_id(m.group())]))
                    at = m.end()
        return out

    # Long pieces: tokens are strings; the last symbol of a piece carries the suffix

    def symbols(self, token: str) -> list[str]:
        ended = bool(self.suffix) and token.endswith(self.suffix)
        body = token[:-len(self.suffix)] if ended else token
        return [*body[:-1], body[-1] + self.suffix] if ended else list(body)

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE by the smallest rank, leftmost first."""
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Tokens of two neighbouring stretches together."""
        if not left or not right:
            return left or right
        width = 2
        while True:
            a, b = left[-width:], right[:width]
            new = self.merge([s for t in (*a, *b) for s in self.symbols(t)])
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return left[:-width] + new + right[width:] if len(a) < len(left) else new + right[width:]
            width *= 2


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, long: int = LONG) -> Encoder:
    """One per worker and vocabulary."""
    if (path, long) not in _encoders:
        _encoders[path, long] = Encoder(path, long)
    return _encoders[path, long]


def byte_letters(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)


def ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def latin_pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces that LATIN_PIECES finds in lower-case Latin characters, of which the first is white space."""
    kind = KINDS[codes]
    begins = (kind != SPACE) & ((kind == NUMBER) | (kind != np.roll(kind, 1)))
    tail = np.concatenate([codes, np.zeros(3, codes.dtype)])
    quote = np.flatnonzero((codes == ord("'")) & begins)
    one, two = tail[quote + 1], tail[quote + 2]
    size = np.zeros(len(quote), np.int64)
    for ending in ("re", "ve", "ll"):
        size[(one == ord(ending[0])) & (two == ord(ending[1]))] = 3
    size[np.isin(one, [ord(c) for c in "stmd"])] = 2
    quote, size = quote[size > 0], size[size > 0]
    begins[quote + 1] = False
    after = (quote + size)[quote + size < len(codes)]
    begins[after] = kind[after] != SPACE  # no letter further on belongs to the ending
    stops = begins | (kind == SPACE)
    start = np.flatnonzero(begins)
    places = np.append(np.flatnonzero(stops), len(codes))
    return start, places[np.searchsorted(places, start) + 1]


def alike(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different stretch, and for each stretch which of these it is."""
    hashes = stretch(running(CHARACTERS[codes]), start, end)
    order = np.argsort(hashes)
    new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
    first, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    size, own = end - start, first[which]
    same = np.array_equal(size, size[own])
    if same:
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(codes[np.repeat(start, size) + at], codes[np.repeat(start[own], size) + at])
    return (first, which) if same else (np.arange(len(start)), np.arange(len(start)))  # two of one hash


def word_ids(texts: pa.Array, enc: Encoder) -> Iterator[bytes | list[Item]]:
    """Per text its ids as little-endian 32-bit numbers, or its items where it has a long unsplit stretch."""
    held: list[tuple[bytes, str | None]] = []
    size = 0
    for value in texts:
        text = value.as_py()
        held.append((text, enc.latin(text)))
        size += len(text)
        if size > TOGETHER:
            yield from _held_ids(held, enc)
            held, size = [], 0
    yield from _held_ids(held, enc)


def _held_ids(held: list[tuple[bytes, str | None]], enc: Encoder) -> Iterator[bytes | list[Item]]:
    latin = [low for _, low in held if low is not None]
    ids = iter(enc.latin_ids(latin) if latin else [])
    for text, low in held:
        found = None if low is None else next(ids)
        if found is not None:
            yield found
            continue
        words = text.split()
        if words and max(map(len, words)) > enc.long:
            yield enc.items(words)
        else:
            yield b"".join(enc.words.all(words))


def column_names(schema: str) -> list[str]:
    return [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]


ITEMS = pa.list_(pa.struct([("ids", pa.binary()), ("leaves", pa.list_(pa.string()))]))


def encode(docs: DataFrame, path: str | None = None, long: int = LONG, finish=None, finished: str = "ids binary") -> DataFrame:
    """doc_id and what `finish` makes of a text's ids (little-endian 32-bit numbers); by default the ids themselves.

    finish(enc, list of ids) gives a list of Arrow arrays for the columns `finished`; it runs where the text is encoded.
    """
    path = path or vocabulary()
    finish = finish or (lambda enc, ids: [pa.array(ids, pa.binary())])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, long)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                got = list(word_ids(rows.column("text"), enc))
                ids = [g if isinstance(g, bytes) else b"" for g in got]
                items = [None if isinstance(g, bytes) else [{"ids": i.ids, "leaves": i.leaves} for i in g] for g in got]
                columns = [rows.column("row_id"), rows.column("doc_id"), pa.array(items, ITEMS), *finish(enc, ids)]
                yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", utf8().alias("text"))
    schema = f"row_id long, doc_id {kind}, items array<struct<ids: binary, leaves: array<string>>>, {finished}"
    names = ["row_id", "doc_id", "items", *column_names(finished)]
    first = keep(rows.mapInArrow(short, schema), "encoded")
    split = first.where(F.col("items").isNotNull()).select("row_id", "doc_id", "items")
    plain = first.where(F.col("items").isNull()).drop("row_id", "items")
    if split.isEmpty():
        return plain
    return plain.unionByName(_long_texts(split, path, long, finish, finished, kind))


def _long_texts(split: DataFrame, path: str, long: int, finish, finished: str, kind: str) -> DataFrame:
    """Leaves encoded in parallel, joined pairwise level by level, and put back into their texts."""
    spark, suffix = split.sparkSession, encoder(path, long).suffix
    items = split.select("row_id", "doc_id", F.posexplode("items").alias("item", "i"))
    leaves = items.select("row_id", "item", F.size("i.leaves").alias("n"), F.posexplode("i.leaves").alias("leaf", "symbols"))
    leaves = leaves.withColumn("last", F.col("leaf") == F.col("n") - 1).repartition(partitions(spark), "row_id", "item", "leaf")

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, long)
        for f in frames:
            symbols = ([*s[:-1], s[-1] + suffix] if last else list(s) for s, last in zip(f["symbols"], f["last"], strict=True))
            yield f[["row_id", "item", "leaf"]].assign(tokens=[enc.merge(s) for s in symbols])

    def pair(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("leaf")
        out = f.iloc[:1][["row_id", "item", "leaf"]].assign(leaf=f["leaf"].iloc[0] // 2)
        parts = [list(t) for t in f["tokens"]]
        out["tokens"] = [encoder(path, long).join(*parts) if len(parts) == 2 else parts[0]]
        return out

    schema = "row_id long, item int, leaf int, tokens array<string>"
    level = keep(leaves.mapInPandas(leaf, schema), "leaves")
    most = level.agg(F.max("leaf")).first()[0]
    while most:
        level = keep(level.groupBy("row_id", "item", F.floor(F.col("leaf") / 2)).applyInPandas(pair, schema), "level")
        most //= 2

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path, long)
        f = f.sort_values("item")
        ids = b"".join(i if t is None else ids_bytes([enc.vocab[x] for x in t]) for i, t in zip(f["ids"], f["tokens"], strict=True))
        done = dict(zip(column_names(finished), finish(enc, [ids]), strict=True))
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]]} | {c: a.to_pylist() for c, a in done.items()})

    tokens = level.select("row_id", "item", "tokens")
    joined = items.select("row_id", "doc_id", "item", "i.ids").join(tokens, ["row_id", "item"], "left")
    return joined.groupBy("row_id").applyInPandas(whole, f"doc_id {kind}, {finished}")


def decode(enc: Encoder, ids: bytes) -> str:
    """Special tokens kept."""
    return enc.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


_tokens: dict[int, tuple[np.ndarray, list[str]]] = {}


def digests(enc: Encoder, rows: list[bytes]) -> list[pa.Array]:
    """Number of ids, and digests of the ids in decimal and of the decoded text. The vocabulary's decimals and, where
    decoding only joins tokens by spaces, its tokens are looked up instead of asking the library for each text."""
    if id(enc) not in _tokens:
        size = enc.tokenizer.get_vocab_size()
        names = [enc.token(k) or "" for k in range(size)]
        plain = enc.tokenizer.decoder is None
        _tokens[id(enc)] = np.array([str(k) for k in range(size)], object), np.array(names, object) if plain else None
    decimal, names = _tokens[id(enc)]
    n, ids_sha, text_sha = [], [], []
    for ids in rows:
        k = np.frombuffer(ids, "<u4")
        n.append(len(k))
        ids_sha.append(hashlib.sha256(" ".join(decimal[k]).encode()).hexdigest())
        text = decode(enc, ids) if names is None else " ".join(names[k])
        text_sha.append(hashlib.sha256(text.encode()).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), finish=digests, finished="n_tokens long, ids_sha256 string, decoded_sha256 string")
