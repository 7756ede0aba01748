"""Byte-level BPE by a prefix-sharing trie.

Distinct words are inserted into a trie over bytes. A depth-first walk gives
each prefix the last token of its encoding: the one token ``t`` that ends the
prefix and is compatible with the last token of the prefix before it (BPE would
leave the two as they are). A shared prefix is thereby encoded once, and a
word's ids follow by stepping back through the last tokens.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, return_memory, ship

ship(__name__)

#: Fixed by the byte-level tokenizer format: the pattern of its pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of characters below this are cut by the standard library's faster engine, with the same classes spelled out.
LOW = 0x530


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as a map back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def low_pattern() -> str:
    """PRETOKEN for characters below LOW, its classes spelled out as ranges."""

    def ranges(kind: str) -> str:
        inside = [unicodedata.category(chr(i))[0] == kind for i in range(LOW)] + [False]
        at = [i for i in range(LOW + 1) if inside[i] != (i > 0 and inside[i - 1])]
        return "".join(f"\\u{lo:04x}-\\u{hi - 1:04x}" for lo, hi in zip(at[::2], at[1::2]))

    space = r"\t-\r \x85\xa0"
    return PRETOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{ranges('L')}{ranges('N')}]").replace(r"\p{L}", f"[{ranges('L')}]").replace(r"\p{N}", f"[{ranges('N')}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class Vocabulary:
    """Tokens as bytes, merge ranks and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

        def raw(token: str) -> bytes:
            return bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.longest = max(map(len, self.ids))
        self.pair, self.made, self.parts = {}, {}, {}
        for r, m in enumerate(model["merges"]):
            left, right = map(raw, m.split(" ") if isinstance(m, str) else m)
            x, y, t = self.ids[left], self.ids[right], self.ids[left + right]
            self.pair[x, y] = r
            if t not in self.made:
                self.made[t], self.parts[t] = r, (x, y)
        self.extended = {self.ids[t[:-1]] << 8 | t[-1]: i for t, i in self.ids.items() if t[:-1] in self.ids}
        self.size_of = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.compatible: dict[int, bool] = {}

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart.

        Goes back in merge order over the states that meet at their boundary:
        x is the left side's last part and y the right side's first part, which
        are used up at ranks cx and cy. They join if their own merge comes
        first (among equal ranks BPE merges from the left).
        """
        known = self.compatible.get(left << 32 | right)
        if known is None:
            if len(self.compatible) > 100_000:
                self.compatible.clear()
            made, parts, pair = self.made, self.parts, self.pair
            x, y, cx, cy, known = left, right, 1 << 60, 1 << 60, True
            while True:
                m = pair.get((x, y))
                if m is not None and m < cx and m <= cy:
                    known = False
                    break
                rx, ry = made.get(x, -1), made.get(y, -1)
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    x, cx = parts[x][1], rx
                else:
                    y, cy = parts[y][0], ry
            self.compatible[left << 32 | right] = known
        return known


class Trie:
    """Distinct words over shared prefixes, held as sorted words: neighbours share a path.

    Walking the sorted words is the depth-first walk: from one word to the next
    the path is cut back to their common prefix and then extended.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: set[bytes] = set()

    def insert(self, word: bytes) -> None:
        self.words.add(word)

    def encode(self) -> dict[bytes, list[int]]:
        """The ids of every word. last[d] is the last token of the path's prefix of d bytes."""
        v = self.vocabulary
        ids, longest, stays, size_of, extended, compatible = v.ids.get, v.longest, v.stays, v.size_of, v.extended.get, v.compatible.get
        out: dict[bytes, list[int]] = {}
        last, before = [-1], b""
        for word in sorted(self.words):
            depth = 0
            if word[:1] == before[:1]:
                top = min(len(before), len(word))
                while depth < top and before[depth] == word[depth]:
                    depth += 1
            del last[depth + 1 :]
            tail = last[depth]
            for end in range(depth + 1, len(word) + 1):
                # the usual case: the last token grows by a byte and stays apart from the one before it
                t = extended(tail << 8 | word[end - 1])
                if t is not None:
                    at = end - size_of[t]
                    if at == 0:
                        last.append(t)
                        tail = t
                        continue
                    left = last[at]
                    known = compatible(left << 32 | t)
                    if known or known is None and stays(left, t):
                        last.append(t)
                        tail = t
                        continue
                # only one token fits; a fresh one is mostly short
                for at in range(end - 1, max(-1, end - longest - 1), -1):
                    t = ids(word[at:end])
                    if t is not None and (at == 0 or stays(last[at], t)):
                        last.append(t)
                        tail = t
                        break
                else:
                    raise ValueError("a byte without a token")
            found, at = [], len(word)
            while at:
                t = last[at]
                found.append(t)
                at -= size_of[t]
            found.reverse()
            out[word] = found
            before = word
        return out


class Slots(dict):
    """Words to consecutive numbers; a word that is looked up for the first time gets the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Whole texts to ids, through a memory of distinct words (pre-tokens) in two generations.

    A generation that exceeds ``limit`` words becomes the older one, and the
    older one is forgotten; frequent words are carried over when they recur.

    Ids are the tokenizers library's without special tokens being added; the
    strings of added tokens in a text become their ids, as there.
    """

    def __init__(self, path: str, limit: int = 80_000, block_chars: int = 1 << 20):
        self.vocabulary = v = Vocabulary(path)
        self.pretoken, self.low, self.high = regex.compile(PRETOKEN, regex.V1), re.compile(low_pattern()), re.compile(f"[^\x00-\x1b -{chr(LOW - 1)}]")
        self.cut = re.compile(r"(?<=\S)[ \t\n\r\f\v]")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.limit, self.block_chars = limit, block_chars
        self.slots, self.flat, self.start = Slots(), np.empty(0, np.int32), np.zeros(1, np.int64)
        self.forget()
        top = max(v.bytes_of) + 1
        sizes = np.zeros(top + 1, np.int64)
        for i, b in v.bytes_of.items():
            sizes[i + 1] = len(b)
        self.token_start = np.cumsum(sizes)
        self.token_bytes = np.frombuffer(b"".join(v.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def forget(self) -> None:
        """Drop the older generation."""
        self.old = (Slots(), np.empty(0, np.int32), np.zeros(1, np.int64))

    def words(self, text: str):
        """Lists of pre-tokens; together they are the text. A long text comes in pieces cut before white space, which no pre-token crosses."""
        if self.split_added is not None and any(a in text for a in self.vocabulary.added):
            for piece in self.split_added.split(text):
                if piece in self.vocabulary.added:
                    yield [piece]
                else:
                    yield from self._plain(piece)
        else:
            yield from self._plain(text)

    def _plain(self, text: str):
        at = 0
        while at < len(text):
            end = self.cut.search(text, at + self.block_chars) if len(text) - at > self.block_chars else None
            piece = text[at : end.start()] if end else text[at:] if at else text
            yield (self.pretoken if self.high.search(piece) else self.low).findall(piece)
            at += len(piece)

    def _learn(self) -> None:
        """Take the new words from the older generation, and encode those not seen in either through one trie."""
        v, trie = self.vocabulary, Trie(self.vocabulary)
        old, old_flat, old_start = self.old
        parts = []
        for word in self.slots.new:
            slot = old.get(word)
            if slot is not None:
                parts.append(slot)
            elif word in v.added:
                parts.append(word)
            else:
                raw = word.encode("utf-8", "replace")
                trie.insert(raw)
                parts.append(raw)
        encoded = trie.encode()
        flat, sizes = [], []
        for p in parts:
            own = encoded[p] if isinstance(p, bytes) else old_flat[old_start[p] : old_start[p + 1]].tolist() if isinstance(p, int) else [v.added[p]]
            flat += own
            sizes.append(len(own))
        self.slots.new = []
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.array(sizes, np.int64))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids end."""
        found, sizes = [], np.zeros(len(texts), np.int64)
        block: list[str] = []
        spans: list[tuple[int, int]] = []  # text, words

        def close() -> None:
            ids, begin = self._ids(block)
            found.append(ids)
            at = np.cumsum([0, *(n for _, n in spans)])
            np.add.at(sizes, [k for k, _ in spans], begin[at[1:]] - begin[at[:-1]])
            block.clear()
            spans.clear()

        chars = 0
        for k, text in enumerate(texts):
            for words in self.words(text or ""):
                block += words
                spans.append((k, len(words)))
            chars += len(text or "")
            if chars >= self.block_chars:
                close()
                chars = 0
        if spans:
            close()
        return (np.concatenate(found) if found else np.empty(0, np.int32)), np.cumsum(sizes)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and where each word's ids begin (with the end of all)."""
        if len(self.slots) > self.limit:
            self.old = (self.slots, self.flat, self.start)
            self.slots, self.flat, self.start = Slots(), np.empty(0, np.int32), np.zeros(1, np.int64)
        picked = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if self.slots.new:
            self._learn()
        begin, size = self.start[picked], self.start[picked + 1] - self.start[picked]
        return _gather(self.flat, begin, size), np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text's tokens; ids without a token give nothing."""
        known = (ids >= 0) & (ids < len(self.token_start) - 1)
        safe = np.where(known, ids, 0)
        size = np.where(known, self.token_start[safe + 1] - self.token_start[safe], 0)
        out = _gather(self.token_bytes, self.token_start[safe], size).tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        upto = total[ends]
        return [out[a:b] for a, b in zip([0, *upto[:-1]], upto)]


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i]+size[i]] for all i, in one array."""
    total = int(size.sum())
    if not total:
        return values[:0]
    shift = begin - np.concatenate([[0], np.cumsum(size)[:-1]])
    return values[np.repeat(shift, size) + np.arange(total)]


@lru_cache(1)
def default_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ROWS = 200


def _worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task where workers are reused."""
    kept = sys.modules.setdefault("_cellgraph_bpe_worker", types.ModuleType("_cellgraph_bpe_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def _round_trip(path: str, with_decoded: bool):
    def run(batches):
        encoder = _worker_encoder(path)
        gc.disable()  # no cycles arise here, and collections would walk the large memory again and again
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    ids, ends = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns = [*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                    names = [*part.schema.names[:-1], "ids"]
                    if with_decoded:
                        columns.append(pa.array([b.decode("utf-8", "replace") for b in encoder.decode(ids, ends)], pa.string()))
                        names.append("decoded")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            gc.enable()
            encoder.forget()  # the worker may serve other operators next
            return_memory()

    return run


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, with_decoded: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * with_decoded
    return rows.mapInArrow(_round_trip(path, with_decoded), schema)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row's whole text.

    A null or empty text has no ids. Ids of rows may repeat or be null; each
    input row gives one output row, and other columns are ignored.
    """
    return _encoded(docs, id_col, text_col, path or default_path(), False)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with ``decoded``: the text that the ids decode to (empty for no ids)."""
    return _encoded(docs, id_col, text_col, path or default_path(), True)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``; special tokens are kept, invalid UTF-8 becomes U+FFFD, null ids give an empty text."""
    rows = rows.select(F.col(id_col).alias(id_col), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    path = path or default_path()

    def run(batches):
        encoder = _worker_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(1)
                sizes = np.array([len(x) for x in lists], np.int64)
                ids = np.array(lists.flatten().fill_null(-1), np.int64)
                texts = [b.decode("utf-8", "replace") for b in encoder.decode(ids, np.cumsum(sizes))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids and decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe_trie(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents to ids and back, as digests."""
    return digests(encode_decode(load(spark, sf_dir, "documents")))
