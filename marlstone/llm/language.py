"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds one bit for each language (as many 64-bit words as that takes), so one look-up
per hash function, joined with AND, gives all languages that contain an n-gram. A text's hits are
popcounts per language over its n-grams, in which an n-gram of k of n languages counts log((n + 1) / k); each is corrected for the chance that
the filter answers yes without cause, and the language with the largest corrected share wins.

The filters learn from a bounded sample of labelled rows; counting over the sample is distributed,
and only n-grams found in at least MIN_SHARE of a language's sampled texts reach the driver: with texts of
at most L distinct n-grams that is L / MIN_SHARE n-grams a language, whatever the corpus' size. All languages are learned, however rare.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, utf8

N = (2, 3)
LOG2_SLOTS, HASHES = 18, 3
PER_LANGUAGE = 3000  # sampled texts a language, about
MIN_SHARE = 0.02  # of a language's sampled texts that hold an n-gram


def letter_table() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(letter_table())
    return _letters[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and single spaces, the row of each, and whether a row has a letter."""
    data, at = utf8(texts)
    n = len(at) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[at]  # in code points
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    low = letters()[codes]
    is_letter = low != 32
    has = np.bincount(rows[is_letter], minlength=n) > 0
    keep = is_letter.copy()  # letters, and the first other character after a letter of the same row
    keep[1:] |= is_letter[:-1]
    low, rows = low[keep].astype(np.uint64), rows[keep]
    start = np.ones(len(rows), bool)
    start[1:] = rows[1:] != rows[:-1]
    # a space before each row's first letter: rows follow one another, so it also ends the row before
    low = np.insert(low, np.flatnonzero(start), 32)
    rows = np.insert(rows, np.flatnonzero(start), rows[start])
    hashes, owner = [], []
    for k in N:
        if len(rows) < k:
            continue
        h = low[: len(low) - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(0x110000) + low[j : len(low) - k + 1 + j]
        same = rows[: len(h)] == rows[k - 1 :]
        same &= ~((low[: len(h)] == 32) & (low[1 : len(h) + 1] == 32))
        hashes.append(h[same] ^ np.uint64(k << 60))
        owner.append(rows[: len(h)][same])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    return mix(np.concatenate(hashes)), np.concatenate(owner), has


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slots[h] has a bit for each language."""

    languages: list[str]
    slots: np.ndarray = field(repr=False)  # (words of a mask, slots)
    false_rate: np.ndarray = field(repr=False)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages whose filter holds it, as bits: (words of a mask, n-grams)."""
        return look(self.slots, hashes)

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and whether there is a letter at all."""
        hashes, rows, has = grams(texts)
        n, k = len(texts), len(self.languages)
        hits = np.zeros((n, k))
        masks = self.masks(hashes)
        held = np.bitwise_count(masks).sum(0)
        weight = np.log((k + 1) / np.maximum(held, 1))
        total = np.bincount(rows, weight, n)
        for j in range(k):
            hits[:, j] = np.bincount(rows, weight * ((masks[j // 64] >> np.uint64(j % 64)) & np.uint64(1)), n)
        share = hits / np.maximum(total, 1e-9)[:, None]
        true = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = np.argmax(true, 1)
        odds = np.exp(20 * (true - true.max(1, keepdims=True)))
        return best, (odds / odds.sum(1, keepdims=True)).max(1), has


def slot_of(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(21 * j)) & np.uint64((1 << LOG2_SLOTS) - 1)).astype(np.int64) for j in range(HASHES)]


def look(slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = None
    for s in slot_of(hashes):
        out = slots[:, s] if out is None else out & slots[:, s]
    return out


def learn(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from a sample of about `per_language` texts of each language (chosen by a hash of the key).

    Rows with a null language or text don't count. Without any labelled row there is no language, and every text is `und`.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros((1, 1 << LOG2_SLOTS), np.uint64), np.zeros(0))
    known = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.struct(F.lit(i).alias("i"), F.lit(min(1.0, per_language / counts[name])).alias("share")))])
    u = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)).cast("double") / (1 << 30)
    sample = labelled.withColumn("s", F.element_at(known, F.col("l"))).where(u < F.col("s.share")).select(F.col("s.i").alias("l"), "t")

    def count(batches):
        for batch in batches:
            hashes, rows, _ = grams(batch.column(1))
            o = np.lexsort((rows, hashes))
            rows, hashes = rows[o], hashes[o]
            once = np.ones(len(rows), bool)  # an n-gram counts once a text
            once[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            rows, hashes = rows[once], hashes[once]
            of = batch.column(0).to_numpy()[rows]
            o = np.lexsort((hashes, of))
            of, h = of[o], hashes[o]
            if len(h):
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
                places = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(of[new].astype(np.int32)), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(places, len(h))))], ["l", "g", "n"])

    texts = {r.l: r.n for r in sample.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not texts:
        return filters_of(languages, np.zeros(0, np.int64), np.zeros(0, np.uint64))
    needs = F.create_map(*[F.lit(x) for i, n in texts.items() for x in (i, max(2, int(np.ceil(MIN_SHARE * n))) if n > 4 else 1)])
    found = sample.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= F.element_at(needs, F.col("l"))).select("l", "g").toArrow()
    return filters_of(languages, found["l"].to_numpy(), found["g"].to_numpy().view(np.uint64))


def filters_of(languages: list[str], of: np.ndarray, hashes: np.ndarray) -> Filters:
    """Filters of the languages' n-grams: the hash of each, and the index of the language."""
    slots = np.zeros((-(-len(languages) // 64), 1 << LOG2_SLOTS), np.uint64)
    bits = np.uint64(1) << (of % 64).astype(np.uint64)
    for s in slot_of(hashes):
        np.bitwise_or.at(slots, (of // 64, s), bits)
    fill = np.array([((slots[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
    return Filters(languages, slots, fill**HASHES)


def identify(df: DataFrame, filters: Filters, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row. `und` with score 0 if the text is null or has no letter. Map-only."""

    def run(batches):
        for batch in batches:
            if filters.languages:
                best, score, has = filters.decide(batch.column(1))
                names = np.where(has, np.array(filters.languages, object)[best], "und")
                score = np.where(has, score, 0.0)
            else:
                names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(names), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return df.select(df[id_column].cast("long").alias("doc_id"), df[text]).mapInArrow(run, "doc_id long, lang_pred string, score double")
