"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text's terms are all its words. A term weighs (1 + log(count)) * idf, and the labels weigh terms too: from ORDINARY for a word as common among
examples of label 0 up to 1 for one whose log odds of label 1 are MARKS standard errors above zero. No word is left out, and words that no example has count for the text's own length.

Examples lie in blocks of BLOCK like ones. The index has postings by term, cut by block, and each term's largest weight in a block. For a
text, the exact share of its frequent terms and the sums of these maxima bound the cosine with any example of a block; the FIRST best blocks are compared, and then those whose bound is
above the K-th best cosine so far. So the K nearest examples are exact. Postings are read by entry (a term's within a block), or by term where these blocks hold many of a text's entries. They vote by distance; votes are calibrated by isotonic
regression over the leave-one-out votes of the examples, which a job computes. A text without words has no neighbours and gets the share of label 1.

What is fitted is bounded by the sample: at most SAMPLE labelled rows of each label, chosen by a hash of the id, with all their words.
Where a label has more rows than that, its examples count for the others too (as many as there are by example), so that frequencies, votes, calibration
and the share of label 1 are those of all labelled rows, whatever the size of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, forget_others, give_back

SAMPLE = 8000  # labelled rows of each label, at most
ORDINARY = 0.2  # what the idf of a word counts that doesn't mark label 1
MARKS = (2.0, 4.0)  # standard errors of the log odds from which a word's weight rises, and where it is 1
FREQUENT = 20  # terms in at least 1 / FREQUENT of the examples stand in a dense matrix
BLOCK, FIRST = 32, 8  # examples of a block; blocks that are compared at once
K = 8  # neighbours
TOGETHER = 64  # texts compared together
WHOLE = 3  # where the blocks to be compared hold 1 / WHOLE of a text's entries, its terms' postings are read in one run each
PART = 1 << 18  # postings weighed together
SOFTEN = 0.02  # the vote of a neighbour is 1 / (distance + SOFTEN)
REJECT = 0.7
WORD = re.compile(r"[^\W\d_]+")
ASCII = re.compile(r"[\x00-\x7f]+")
LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))  # ASCII that isn't a letter becomes a space


def words_of(text: str) -> list[str] | list[bytes]:
    """What WORD finds in the lower-cased text, in order; as UTF-8 where all that isn't ASCII is letters, since bytes are split several times as fast."""
    text = text.lower()
    return text.encode().translate(LETTERS).split() if WORD.fullmatch(ASCII.sub("", text) + "a") else WORD.findall(text)


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of a text's words (of their UTF-8), and how often each occurs."""
    digests = b"".join(map(xxhash.xxh3_64_digest, words_of(text))) if text else b""
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64), return_counts=True)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1, for one i after another."""
    ends = np.cumsum(n, dtype=np.int64)
    out = np.repeat(first - (ends - n), n)
    out += np.arange(len(out))
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def tf_table(counts: np.ndarray) -> np.ndarray:
    """1 + log(count), by count."""
    return 1 + np.log(np.maximum(np.arange(int(counts.max(initial=0)) + 1), 1))


@dataclass
class Index:
    """The examples, in blocks. Only what the first fields hold is sent about; the rest is made of it where it is needed."""

    words: np.ndarray = field(repr=False)  # sorted hashes; a word's place is its term
    scale: np.ndarray = field(repr=False)  # by term, and of a word that no example has
    ids: np.ndarray = field(repr=False)  # by example, as all of the next
    toxic: np.ndarray = field(repr=False)
    stands: np.ndarray = field(repr=False)  # for how many rows each example stands, in proportion
    norms: np.ndarray = field(repr=False)
    have: np.ndarray = field(repr=False)  # by term: how many examples have it
    example: np.ndarray = field(repr=False)  # by posting, in order of terms, then examples
    counts: np.ndarray = field(repr=False)  # by posting

    def __post_init__(self) -> None:
        self.ready = self.sent = False
        self.compared = self.skipped = 0  # blocks
        self.answers: dict[bytes, tuple[float, list[int]] | None] = {}

    def __getstate__(self):
        return {f: getattr(self, f) for f in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()
        self.sent = True

    def expand(self) -> None:
        """column: by term, its row in `dense`, or -1. dense: weights of frequent terms by example. For other terms, first: their first entry, an entry being a block that holds the term; block, most: an entry's block, and
        the term's largest weight there; postings: an entry's first posting; place, weight: by posting. Weights are in single precision, so cosines are exact to six digits."""
        n_blocks = -(-len(self.ids) // BLOCK)
        often = np.flatnonzero(self.have > max(len(self.ids) / FREQUENT, 1))
        self.column = np.full(len(self.words), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n_blocks * BLOCK), np.float32)
        tf = tf_table(self.counts).astype(np.float32)
        scale, norms = self.scale.astype(np.float32), self.norms.astype(np.float32)
        ends = np.cumsum(self.have, dtype=np.int64)
        rare_ends = np.cumsum(np.where(self.column < 0, self.have, 0), dtype=np.int64)
        n, done = int(rare_ends[-1]) if len(rare_ends) else 0, 0
        self.place, self.weight, new = np.empty(n, self.example.dtype), np.empty(n, np.float32), np.zeros(n, bool)
        for a in range(0, len(self.example), PART):  # in parts, as several workers do so beside one another
            of = np.searchsorted(ends, np.arange(a, min(a + PART, len(self.example))), "right").astype(np.int32)
            place, at = self.example[a : a + PART], self.column[of]
            weight = tf[self.counts[a : a + PART]] * scale[of] / norms[place]
            own, rare = at >= 0, at < 0
            self.dense[at[own], place[own]] = weight[own]
            part = slice(done, done + int(rare.sum()))
            self.place[part], self.weight[part], done = place[rare], weight[rare], part.stop
        firsts = np.append(0, rare_ends[:-1])[: len(rare_ends)]
        new[firsts[firsts < rare_ends]] = True
        for a in range(1, n, PART):
            blocks = self.place[a - 1 : a + PART] // BLOCK
            new[a : a + PART] |= blocks[1:] != blocks[:-1]
        entries = int(np.count_nonzero(new))
        self.postings, self.block, self.most, done = np.full(entries + 1, n, np.int32), np.empty(entries, self.place.dtype), np.empty(entries, np.float32), 0
        for a in range(0, n, PART):
            start = np.flatnonzero(new[a : a + PART]) + a
            self.postings[done : done + len(start)], done = start, done + len(start)
        for a in range(0, entries, PART):
            start, end = self.postings[a : min(a + PART, entries)], self.postings[min(a + PART, entries)]
            self.block[a : a + PART] = self.place[start] // BLOCK
            self.most[a : a + PART] = np.maximum.reduceat(self.weight[start[0] : end], start - start[0])
        self.first = np.searchsorted(self.postings[:-1], np.append(firsts, n).astype(np.int32)).astype(np.int32)
        if self.sent:  # a worker needs it no more
            self.example = self.counts = self.have = None
            del new, ends, rare_ends, firsts
            give_back()
        self.ready = True

    def weigh(self, one: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector, of length 1 with the words that no example has, which are left out."""
        hashes, counts = one
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        have = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        w = (1 + np.log(counts)) * self.scale[np.where(have, at, -1)]
        return at[have], w[have] / np.sqrt((w * w).sum())

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the K examples with the largest positive cosines (ties: the smallest id), and these; example but[i] is left out."""
        if not self.ready:
            self.expand()
        weighed = [*map(self.weigh, vectors)]
        often = np.zeros((len(vectors), len(self.dense)), np.float32)
        for row, (terms, weights) in zip(often, weighed, strict=True):
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return [self.closest(*one, part.astype(float), but[i] if but else -1) for i, (one, part) in enumerate(zip(weighed, often @ self.dense, strict=True))]

    def closest(self, terms: np.ndarray, weights: np.ndarray, cosines: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples of one text, from the part of its cosines that frequent terms make up."""
        rare = self.column[terms] < 0
        lo = self.first[terms[rare]]
        size = self.first[terms[rare] + 1] - lo
        entry, w = spread(lo, size), np.repeat(weights[rare], size)
        block = self.block.take(entry).astype(np.intp)
        cosines = cosines.reshape(-1, BLOCK)
        bound = cosines.max(1, initial=0) + np.bincount(block, self.most.take(entry) * w, len(cosines))

        def compare(due: np.ndarray) -> None:
            mine = np.flatnonzero(due.take(block))
            if WHOLE * len(mine) < len(entry):
                some, of = entry.take(mine), w.take(mine)
                end = some + 1
            else:  # a run for each term instead of one for each entry
                some, end, of = lo, lo + size, weights[rare]
            first = self.postings.take(some)
            n = self.postings.take(end) - first
            post = spread(first, n)
            share = np.bincount(self.place.take(post), self.weight.take(post) * np.repeat(of, n), cosines.size)
            cosines[due] += share.reshape(cosines.shape)[due]
            if but >= 0:
                cosines.ravel()[but] = 0

        due = bound > 0
        if len(due) > FIRST:
            due &= bound >= np.partition(bound, -FIRST)[-FIRST]
        compare(due)
        tried = due
        found = cosines[tried].ravel()
        least = np.partition(found, -K)[-K] if len(found) > K else 0
        due = (bound > max(least - 4e-6, 0)) & ~tried
        self.compared += int(tried.sum() + due.sum())
        self.skipped += int(len(due) - tried.sum() - due.sum())
        if due.any():
            compare(due)
            tried = tried | due
            found = cosines[tried].ravel()
            least = np.partition(found, -K)[-K] if len(found) > K else 0
        best = np.flatnonzero((found > 0) & (found >= least - 2e-6))
        place = np.flatnonzero(tried)[best // BLOCK] * BLOCK + best % BLOCK
        found = np.minimum(np.round(found[best], 6), 1)
        order = np.lexsort((self.ids[place], -found))[:K]
        return place[order], found[order]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        w = self.stands[found] / (1 - cosines + SOFTEN)
        return float((w * self.toxic[found]).sum() / w.sum())

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]] | None]:
        """The vote and the ids of the neighbours; None for a text without any. What was met before is kept, and forgotten all together beyond a bound."""
        keys = [xxhash.xxh3_128_digest(h.tobytes() + n.tobytes()) for h, n in vectors]
        if len(self.answers) > 5_000:
            self.answers.clear()
        new = {k: v for k, v in zip(keys, vectors, strict=True) if len(v[0]) and k not in self.answers}
        names = list(new) if len(self.ids) else []
        for a in range(0, len(names), TOGETHER):
            some = names[a : a + TOGETHER]
            for k, (found, cosines) in zip(some, self.nearest([new[k] for k in some]), strict=True):
                self.answers[k] = (self.vote(found, cosines), self.ids[found].tolist()) if len(found) else None
        return [self.answers.get(k) for k in keys]


@dataclass
class Model:
    """The index and the calibration of its votes."""

    index: Index | None
    empty_score: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    shared: Broadcast | None = field(default=None, repr=False)  # the index, once for all jobs

    def spread(self, spark: SparkSession) -> Broadcast:
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self.index)
        return self.shared

    def level(self, raw: float) -> float:
        return float(np.interp(raw, *self.steps)) if self.steps else raw

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        got = self.index.votes([*map(vector, texts)])
        return [(self.level(x[0]), x[1]) if x else (self.empty_score, []) for x in got]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return self.scores([text])[0]


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points of the least-squares non-decreasing fit: equal x are one point first, then adjacent violators are pooled."""
    weights = np.ones(len(x)) if weights is None else weights
    x, of = np.unique(np.round(x, 9), return_inverse=True)
    w = np.bincount(of, weights, len(x))
    y = np.bincount(of, weights * y, len(x)) / w
    pools: list[list[float]] = []  # weight, mean, sum of x
    for a, b, n in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        pools.append([n, b, a * n])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            n, m, s = pools.pop()
            p = pools[-1]
            p[1] = (p[0] * p[1] + n * m) / (p[0] + n)
            p[0] += n
            p[2] += s
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] for p in pools])


def alike(rows: np.ndarray) -> np.ndarray:
    """A number for each row of a matrix, the same for rows near one another: a few rounds of spherical k-means, the same in each run."""
    rows = rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)
    k = len(rows) // (4 * BLOCK)
    if k < 2 or not rows.shape[1]:
        return np.zeros(len(rows), np.int64)
    centres = rows[:: len(rows) // k][:k]
    for _ in range(6):
        of = np.argmax(rows @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(np.any(sums, 1)[:, None], sums, centres)
        centres = centres / np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
    return np.argmax(rows @ centres.T, 1)


def terms_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place of each one given."""
    words = np.unique(hashes)
    return words, np.searchsorted(words, hashes).astype(np.int32)


def build(ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, words: np.ndarray, of: np.ndarray, counts: np.ndarray, stands: np.ndarray) -> Index:
    """The index over examples (id, label, number of terms, rows it stands for; their terms and counts one after another)."""
    counts, owner = small(counts), small(np.repeat(np.arange(len(ids)), sizes))
    have = np.bincount(of, minlength=len(words))
    n1 = np.bincount(of, toxic[owner], len(words))
    ones, zeros = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((n1 + 0.5) / (ones + 1)) - np.log((have - n1 + 0.5) / (zeros + 1))
    errors = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (have - n1 + 0.5))
    marks = np.clip((errors - MARKS[0]) / (MARKS[1] - MARKS[0]), 0, 1)
    scale = np.log((stands.sum() + 1) / (np.bincount(of, stands[owner], len(words)) + 0.5)) * (ORDINARY + (1 - ORDINARY) * marks)
    scale = np.append(scale, np.log((stands.sum() + 1) / 0.5) * ORDINARY)
    tf, squares = tf_table(counts), np.zeros(len(ids))
    for a in range(0, len(of), 1 << 19):  # in parts, as the driver's memory is small
        part = slice(a, a + (1 << 19))
        squares += np.bincount(owner[part], (tf[counts[part]] * scale[of[part]]) ** 2, len(ids))
    norms = np.sqrt(squares)
    column = np.full(len(words), -1, np.int16)
    often = np.argsort(-have, kind="stable")[:256]  # by their commonest terms, examples that are alike become neighbours
    column[often] = np.arange(len(often))
    rows, own = np.zeros((len(ids), len(often)), np.float32), np.flatnonzero(column[of] >= 0)
    rows[owner[own], column[of[own]]] = (tf[counts[own]] * scale[of[own]]) / norms[owner[own]]
    by_id = np.argsort(ids)
    kinds = np.empty(len(ids), np.int64)
    kinds[by_id] = alike(rows[by_id])
    del rows, own
    order = np.lexsort((ids, toxic, kinds))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    # a posting as one number, in order of term, example and count, sorted where it stands
    n, most = max(len(ids), 1), int(counts.max(initial=0)) + 1
    if len(words) * n * most >= 1 << 63:
        raise ValueError("the sample's words, examples and counts don't fit in 63 bits")
    key = of * np.int64(n)
    key += place[owner]
    key *= most
    key += counts
    key.sort()
    return Index(words, scale, ids[order], toxic[order], stands[order], norms[order], small(have), small(key // most % n), small(key % most))


def examples(documents: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """_id, _y, _text of the sampled labelled documents, equal texts once; and the number of labelled ids by label."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("_of")).agg((F.max(label) > 0).cast("int").alias("_y"))
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_of"), "_of").limit(sample) for y in (0, 1)]
    labelled = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    rows = documents.select(F.col(id_column).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    # at most 2 * sample short rows are broadcast
    rows = rows.join(F.broadcast(chosen[0].union(chosen[1])), F.col("_id") == F.col("_of")).groupBy("_text").agg(F.min("_id").alias("_id"), F.max("_y").alias("_y"))
    return rows.select("_id", "_y", "_text"), labelled


def learn(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled documents.

    Null labels and null ids don't count; of several labels of an id the largest holds; equal texts count once.
    Without any labelled document every score is 0.
    """
    rows, labelled = examples(documents, labels, id_column, text, label, sample)
    rows = checkpointed(rows)

    def vectors(batches):
        forget_others("toxicity")
        kinds = pa.list_(pa.int64()), pa.list_(pa.int32())
        for batch in batches:
            got = [vector(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.view(np.int64) for h, _ in got], kinds[0]), pa.array([n.astype(np.int32) for _, n in got], kinds[1])], ["id", "y", "h", "n"])

    found = rows.mapInArrow(vectors, "id long, y int, h array<long>, n array<int>").toArrow()  # 2 * sample rows at most
    ids, y = found["id"].to_numpy(), found["y"].to_numpy()
    n = np.bincount(y, minlength=2)
    if not len(y):
        none = np.zeros(0)
        return Model(build(none.astype(np.int64), none, none.astype(np.int64), none.astype(np.uint64), none.astype(np.int32), none, none))
    each = np.array([max(labelled.get(k, 0) / sample, 1.0) for k in (0, 1)])  # rows by sampled row
    share = n[1] * each[1] / (n * each).sum()
    each = each * n.sum() / (n * each).sum()  # the sample is as much evidence as it has texts
    sizes = pc.list_value_length(found["h"]).to_numpy()
    some = sizes > 0  # texts without words are near to none
    counts = small(pc.list_flatten(found["n"]).to_numpy())
    words, of = terms_of(pc.list_flatten(found["h"]).to_numpy().view(np.uint64))
    del found
    index = build(ids[some], y[some].astype(float), sizes[some], words, of, counts, each[y[some]])
    del of, counts
    model = Model(index, share)
    if not len(index.ids):
        return model
    shared = model.spread(documents.sparkSession)

    def left_out(batches):
        """Votes of the examples, each without itself."""
        index = shared.value
        places = {i: k for k, i in enumerate(index.ids.tolist())}
        for batch in batches:
            texts = {i: t for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) if i in places}
            ids, votes = list(texts), []
            for a in range(0, len(ids), TOGETHER):
                part = ids[a : a + TOGETHER]
                votes += [index.vote(*x) if len(x[0]) else share for x in index.nearest([vector(texts[i]) for i in part], [places[i] for i in part])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(votes, pa.float64())], ["id", "vote"])

    votes = rows.mapInArrow(left_out, "id long, vote double").toArrow().sort_by("id")  # 2 * sample rows at most
    by_id = np.argsort(index.ids)
    model.steps = isotonic(votes["vote"].to_numpy(), index.toxic[by_id], index.stands[by_id])
    return model


def score_documents(df: DataFrame, model: Model, *, text: str = "text", threshold: float = REJECT) -> DataFrame:
    """Every row of `df` with score, predicted and evidence (ids of the nearest examples, nearest first); map-only.

    Null and empty texts, and texts without words, get the share of label 1. Columns of `df` with these names are replaced.
    """
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])
    shared, rest = model.spread(df.sparkSession), replace(model, index=None, shared=None)

    def run(texts: pa.Array) -> pa.Array:
        forget_others("toxicity")
        got = shared.value.votes([vector(t) for t in texts.to_pylist()])  # one index for each worker, whatever the number of its tasks
        return pa.array([{"score": rest.level(x[0]), "evidence": x[1]} if x else {"score": rest.empty_score, "evidence": []} for x in got], kind)

    scored, name = F.arrow_udf(run, "struct<score:double,evidence:array<bigint>>"), "__toxicity_scored"
    return (
        df.withColumn(name, scored(F.col(text).cast("string"))).drop(*({"score", "predicted", "evidence"} - {text}))
        .withColumns({"score": F.col(f"{name}.score"), "evidence": F.col(f"{name}.evidence"), "predicted": (F.col(f"{name}.score") >= threshold).cast("int")}).drop(name)
    )
