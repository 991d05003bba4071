"""Byte-level BPE ids and counts, and edit-aware counting with segment trees over pre-tokens.

A boundary before a space that stands between two other characters is a pre-token boundary whatever else
the text holds, since no pre-token has a space after another character. Texts are cut there into
chunks, chunks are encoded once and kept, and chunks met for the first time are encoded together.

For edits, a document keeps a tree: its leaves are runs of chunks with their lengths in characters and their
token counts, inner nodes hold sums. An edit finds its leaves by prefix sums of characters, grows the region
until both its ends are boundaries that the edit can't have changed, encodes that region alone and updates the sums above.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, forget_others

KEPT, KEPT_CHARS = 200_000, 16_000_000  # chunks that a worker keeps, and their characters
LEAF = 16  # chunks in a leaf
LEAF_CHARS = 4096  # a leaf that grows beyond this is cut again
#: Texts with other characters than these go through the tokenizers library itself.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡΣ-ωА-я]")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
DOUBLE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


class Encoder:
    """ids of byte_bpe_50k.json, as little-endian unsigned 32-bit numbers."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.json_path = json_path
        self.kept: dict[str, bytes] = {}
        self.size = 0

    @cached_property
    def full(self):
        """The library's own tokenizer, for unusual texts."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.json_path)
        out.encode_special_tokens = True  # their strings are ordinary text
        return out

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if UNUSUAL.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast(text), "<u4").tobytes()

    def make_room(self, missing: set[str], needed: list[list[str]]) -> set[str]:
        """What to learn; beyond the bounds all kept chunks go, and what a batch needs is learnt anew."""
        self.size += sum(map(len, missing))
        if len(self.kept) + len(missing) > KEPT or self.size > KEPT_CHARS:
            self.kept.clear()
            missing = {c for parts in needed for c in parts}
            self.size = sum(map(len, missing))
        return missing

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that follow a space, all of them in one call."""
        kept = self.kept
        odd = [c for c in chunks if not c or c[0].isspace() or c[-1].isspace()]
        for c in odd:
            kept[c] = np.array(self.fast(" " + c), "<u4").tobytes()
        chunks = list(chunks.difference(odd))
        if not chunks:
            return
        joined = " " + " ".join(chunks)
        ids = np.array(self.fast(joined), "<u4")
        if joined.isascii():
            sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        else:
            sizes = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)) + 1
        at = (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1) * 4
        raw, a = ids.tobytes(), 0
        for c, b in zip(chunks, at.tolist(), strict=True):
            kept[c] = raw[a:b]
            a = b

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null has none."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, str, list[str]]] = []
        missing: set[str] = set()
        kept = self.kept
        for i, text in enumerate(texts):
            if not text:
                continue
            if UNUSUAL.search(text):
                out[i] = self.one(text)
                continue
            parts = BETWEEN.split(text) if any(d in text for d in DOUBLE) else text.split(" ")
            head = parts.pop(0)
            missing.update(set(parts).difference(kept))
            cut.append((i, head, parts))
        if missing:
            self.learn(self.make_room(missing, [parts for _, _, parts in cut]))
        get = kept.__getitem__
        for i, head, parts in cut:
            out[i] = self.one(head) + b"".join(map(get, parts))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(b) // 4 for b in self.encode(texts)]


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a worker; the vocabulary files lie where public_tokenizers says."""
    forget_others("tokens")
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    return _encoders[name]


_encoders: dict[str, Encoder] = {}
CACHES["tokens"] = _encoders


def leaves(text: str, enc: Encoder) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf of a text; their sums are the text's own."""
    if not text:
        return [], []
    if UNUSUAL.search(text):  # no kept chunks: cut at the same places, encode leaf by leaf
        ends = [m.start() for m in BETWEEN.finditer(text)][LEAF - 1 :: LEAF] + [len(text)]
        parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return [len(p) for p in parts], [len(enc.one(p)) // 4 for p in parts]
    parts = BETWEEN.split(text) if any(d in text for d in DOUBLE) else text.split(" ")
    missing = set(parts[1:]).difference(enc.kept)
    if missing:
        enc.learn(enc.make_room(missing, [parts[1:]]))
    chars = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    chars[0] -= 1
    sizes = [len(enc.one(parts[0])) // 4, *(len(enc.kept[p]) // 4 for p in parts[1:])]
    cuts = np.arange(0, len(parts), LEAF)
    return np.add.reduceat(chars, cuts).tolist(), np.add.reduceat(np.array(sizes, np.int64), cuts).tolist()


class Tree:
    """Sums of characters and of tokens over leaves, in an implicit binary tree."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node >>= 1

    def state(self) -> tuple[list[int], list[int]]:
        found = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if c]
        return [c for c, _ in found], [t for _, t in found]


def holds(text: str, place: int) -> bool:
    """Whether a leaf may start here."""
    return 0 < place < len(text) - 1 and text[place] == " " and not text[place - 1].isspace() and not text[place + 1].isspace()


def edit(text: str, tree: Tree, start: int, end: int, new: str, enc: Encoder) -> tuple[str, Tree, int]:
    """Replaces text[start:end]; returns the new text, the updated tree, and how many characters were encoded again.

    Bounds beyond the text are drawn in. The tree is the old one, changed, or a new one if a leaf had to be cut.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    if not text or not after:
        chars, tokens = leaves(after, enc)
        return after, Tree(chars, tokens), len(after)
    first, a = tree.leaf_at(min(start, len(text) - 1))
    while a and (start < a + 2 or not holds(after, a)):  # the boundary at a reads characters a - 1 .. a + 1
        first, a = tree.leaf_at(a - 1)
    last, z = tree.leaf_at(min(max(end - 1, start, 0), len(text) - 1))
    z += tree.chars[last + tree.size]
    moved = len(new) - (end - start)
    while z < len(text) and (end > z - 1 or not holds(after, z + moved)):
        last, b = tree.leaf_at(z)
        z = b + tree.chars[last + tree.size]
    region = after[a : z + moved]
    if len(region) > LEAF_CHARS:
        chars, tokens = tree.state()
        ends = np.cumsum(chars)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, z, "left")) + 1
        c, t = leaves(region, enc)
        return after, Tree(chars[:i] + c + chars[j:], tokens[:i] + t + tokens[j:]), len(region)
    tree.put(first, len(region), enc.counts([region])[0])
    for leaf in range(first + 1, last + 1):
        if tree.chars[leaf + tree.size] or tree.tokens[leaf + tree.size]:
            tree.put(leaf, 0, 0)
    return after, tree, len(region)


TREES = "doc_id long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def count_tokens(df: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, the tree's leaves (leaf_chars, leaf_tokens), text, and edits (of `df` if it is a list of edits, else null).

    Other columns are left out. Null and empty texts have no leaves and no tokens. Map-only.
    """

    def run(batches):
        enc = encoder()
        for batch in batches:
            found = [leaves(t, enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(t) for _, t in found], pa.int64()), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32())), batch.column(1), batch.column(2)],
                ["doc_id", "n_tokens", "leaf_chars", "leaf_tokens", "text", "edits"],
            )

    given = dict(df.dtypes).get("edits", "")
    edits = df["edits"] if given.startswith("array<struct<") else F.lit(None)
    return df.select(df[id_column].cast("long").alias("doc_id"), df[text].cast("string").alias("text"), edits.cast(EDITS).alias("edits")).mapInArrow(run, f"{TREES}, text string, edits {EDITS}")


EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def apply_edits(trees: DataFrame) -> DataFrame:
    """Applies each row's `edits` (in order; places are those of the text as it is then) to its text and tree.

    Takes what count_tokens() returns. Gives doc_id, the new text, n_tokens before (tokens_before) and after,
    the new leaves, n_edits and encoded_chars, the characters that were encoded again. A null list is no edit; a null
    place is 0; a null replacement is empty. Map-only.
    """

    def run(batches):
        enc = encoder()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, tree, spent, edits = row["text"] or "", Tree(row["leaf_chars"] or [], row["leaf_tokens"] or []), 0, row["edits"] or []
                for e in edits:
                    text, tree, n = edit(text, tree, e["start"] or 0, e["end"] or 0, e["text"] or "", enc)
                    spent += n
                chars, tokens = tree.state()
                out.append((row["doc_id"], text, row["n_tokens"], tree.n_tokens, chars, tokens, len(edits), spent))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text", "tokens_before", "n_tokens", "leaf_chars", "leaf_tokens", "n_edits", "encoded_chars"])

    return trees.mapInArrow(run, "doc_id long, text string, tokens_before long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_edits long, encoded_chars long")


def collect_edits(docs: DataFrame, edits: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """Joins a table of edits (doc_id, seq, start, end, text) to documents as an `edits` column, ordered by seq.

    Edits without a document, or with a null doc_id, are left out; documents without edits get a null list.
    """
    lists = (
        edits.groupBy(edits["doc_id"].alias("_edited"))
        .agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("l"))
        .select("_edited", F.transform("l", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))
    )
    return docs.drop("edits").join(lists, docs[id_column] == F.col("_edited"), "left").drop("_edited")
