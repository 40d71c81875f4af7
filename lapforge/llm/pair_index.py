"""Byte-pair encoding and decoding with a pair occurrence index.

A public tokenizer's file gives vocabulary and merges. The distinct pieces of text that a task meets for the first
time are laid out in one row of symbols, and an index maps every pair that has a merge to all its positions there.
The active ranks are taken in ascending order: all positions of a pair are merged from left to right, and the lists
of the pairs that arise beside them are extended. A position whose symbols have changed meanwhile is stale and is
passed over. Taking a whole list at once is the same as merging position by position if no merge makes a pair of a
lower rank than its own, which is verified when the file is loaded.

Texts go through the tasks as Arrow batches, with no shuffle. What a worker remembers is bounded.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import map_batches

CACHE_PIECES = 500_000   # pieces whose ids a worker remembers
CACHE_LENGTH = 64        # longer pieces are not remembered
BATCH_CHARS = 1 << 21    # characters of texts that are encoded at once, or one text
#: Fixed value: the piece pattern of byte-level tokenizers.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Elsewhere the Unicode versions of two libraries may differ; such texts are cut by the tokenizer's own splitter.
SETTLED_BLOCKS = ((0x0000, 0x0557), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
SETTLED = regex.compile("[" + "".join(f"{chr(92)}U{a:08x}-{chr(92)}U{b:08x}" for a, b in SETTLED_BLOCKS) + "]*+")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class PairIndex:
    """The merges of a byte-level tokenizer, applied to many pieces at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut.get("add_prefix_space") and not spec["normalizer"]
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.path, vocabulary, letters = path, model["vocab"], byte_letters()
        self.first = np.array([vocabulary[c] for c in letters], np.int64)  # id of each byte
        self.merges: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        least: dict[int, int] = {}  # of the pairs that a symbol is part of
        for r, (a, b, _) in enumerate(self.merges):
            least.setdefault(a, r)
            least.setdefault(b, r)
        if any(least.get(made, r + 1) <= r for r, (_, _, made) in enumerate(self.merges)):
            raise ValueError("a merge makes a pair of a lower rank than its own")
        self.size = max(vocabulary.values()) + 1
        keys = np.array([a * self.size + b for a, b, _ in self.merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        of_letter = {c: b for b, c in enumerate(letters)}
        names = vocabulary | self.special
        self.raw: list[bytes] = [b""] * (max(names.values()) + 1)
        for token, number in names.items():
            known = all(c in of_letter for c in token)
            self.raw[number] = bytes(of_letter[c] for c in token) if known else token.encode()
        self.known: dict[str, bytes] = {}
        self.splitter = None

    def merge_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """ids of each piece."""
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbols = self.first[data]
        symbols[ends] = -1  # between two pieces
        pairs = symbols[:-1] * self.size + symbols[1:]
        at = np.searchsorted(self.keys, pairs)
        at[at == len(self.keys)] = 0
        found = np.flatnonzero((self.keys[at] == pairs) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)) if len(
            self.keys) else np.zeros(0, np.int64)
        ranks = self.order[at[found]]
        by_rank = np.argsort(ranks, kind="stable")
        found, ranks = found[by_rank], ranks[by_rank]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ranks
        index = {int(ranks[i]): part.tolist() for i, part in zip(starts, np.split(found, starts[1:]))}
        active = sorted(index)
        symbol, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merges = self.rank, self.merges
        while active:
            r = heapq.heappop(active)
            a, b, made = merges[r]
            places = index.pop(r)
            places.sort()
            for i in places:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = made, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    new = rank.get((made, symbol[k]))
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(active, new)
                h = before[i]
                if h >= 0:
                    new = rank.get((symbol[h], made))
                    if new is not None:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(active, new)
        left = np.array(symbol, np.int64)
        keep = left != -2
        out = left[keep].astype("<u4")
        stops = np.cumsum(keep)[ends] - 1
        return [out[a:b] for a, b in zip(np.r_[0, stops[:-1] + 1], stops)]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens; joined they are the text."""
        if SETTLED.fullmatch(text):
            return PIECES.findall(text)
        if self.splitter is None:
            from tokenizers import Tokenizer
            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers; a special token in a text is its id."""
        parts: list[list[str]] = []
        for text in texts:
            if not text:
                parts.append([])
            elif self.marks is not None and self.marks.search(text):
                parts.append([p for k, x in enumerate(self.marks.split(text)) if x
                              for p in ([x] if k % 2 else self.split(x))])
            else:
                parts.append(self.split(text))
        wanted = set().union(*parts)
        if len(self.known) + len(wanted) > CACHE_PIECES:
            self.known.clear()
        for content, number in self.special.items():
            self.known[content] = np.array([number], "<u4").tobytes()
        new = sorted(wanted - self.known.keys())
        fresh = {p: ids.tobytes() for p, ids in zip(new, self.merge_pieces([p.encode() for p in new]))} if new else {}
        known = self.known
        known.update(fresh)
        out = [b"".join([known[p] for p in part]) for part in parts]
        for p in new:
            if len(p) > CACHE_LENGTH:
                del known[p]
        return out

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


_INDEXES: dict[str, PairIndex] = {}


def pair_index(path: str) -> PairIndex:
    """The worker's own copy, read once."""
    if path not in _INDEXES:
        _INDEXES[path] = PairIndex(path)
    return _INDEXES[path]


def _runs(lengths: list[int], limit: int):
    """Ranges of rows with ``limit`` characters at most, or one row."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): one row per row of ``docs`` (doc_id, text), ids as little-endian unsigned 32-bit integers.

    The same ids as the tokenizer's own encoder gives without adding special tokens; a special token that stands in
    a text is encoded as itself. A null or empty text has no ids. A null doc_id and repeated rows keep their rows;
    other columns are ignored.
    """
    path = path or tokenizer_path()

    def encode(batch):
        index, text = pair_index(path), batch.column("text")
        ids = batch.column("doc_id")
        lengths = pa.compute.binary_length(text).fill_null(0).to_pylist()
        for a, b in _runs(lengths, BATCH_CHARS):
            yield {"doc_id": ids.slice(a, b - a), "ids": index.encode(text.slice(a, b - a).to_pylist())}
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, encode, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the texts of ``encoded`` (doc_id, ids). Null ids give the empty text; an id that the
    tokenizer doesn't have raises an error."""
    path = path or tokenizer_path()

    def decode(batch):
        index, ids = pair_index(path), batch.column("ids")
        lengths = pa.compute.binary_length(ids).fill_null(0).to_pylist()
        for a, b in _runs(lengths, 4 * BATCH_CHARS):
            part = ids.slice(a, b - a)
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": part,
                   "text": [index.decode(x) for x in part.to_pylist()]}
    return map_batches(encoded.select("doc_id", "ids"), decode, "doc_id bigint, ids binary, text string")


def round_trip_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and the SHA-256 of its ids and of the text they decode to. Null and
    empty texts, null ids and repeated rows are as in ``encode_documents``."""
    decoded = decode_documents(encode_documents(docs, path), path)
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
