"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification, connected components.

Shingles are five consecutive words. A first permutation sends each shingle to one of D places; a second one, a
table of D values, is read from there on: coordinate k of a signature is the least value at the places shifted by k. So
two permutations give all coordinates, and a shingle's values are one slice of the table.

Documents with equal sets are one class. Class representatives that share a band are candidates. Instead of all pairs of
a bucket, each member first meets one bucket leader, that which it shares most buckets with; the pairs are verified on full
sets and joined into components. Twice over, since leaders may differ. Where a bucket still holds several components,
its members are compared across components, by a byte of each coordinate first and on full sets where enough of them agree, and only links that join components leave the task. A bucket with more text than a task takes is first cut
by its shingles: with the rarest first, two linked sets share one of their first quarter, so members meet by these, and what only the common passages of a large
bucket brought together is parted. So no link between components is lost except those that share no band (at Jaccard 0.75 with 51 bands of 5
coordinates, one in a million) or agree in too few coordinates (less than one in ten million).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, checkpointed, forget_others, key_bits, mix, passes

WORDS = 5
NEED, OF = 75, 100  # Jaccard at least NEED / OF
PLACES = 1 << 20
BANDS, ROWS = 51, 5
COORDINATES = BANDS * ROWS
BLOCK = 3_000_000  # characters
AGREE = 150  # coordinates of COORDINATES; at Jaccard 0.75 fewer agree less than once in ten million
MEMBERS = 1000  # of a bucket whose signatures a task compares
FEW_EDGES = 1 << 19  # that the driver joins into components
LOG2_BITS = 23
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(1)
def circulant() -> np.ndarray:
    """The second permutation as a table, lengthened by its beginning."""
    table = np.random.Generator(np.random.PCG64(20240229)).permutation(PLACES).astype(np.int32)
    return np.concatenate([table, table[:COORDINATES]])


class Words(dict):
    """64-bit numbers of words; a worker keeps those it has met, and forgets them all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            self[word] = out
        return out


_words = CACHES["neardup"] = Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text: of five words each, or of all words if there are fewer."""
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """COORDINATES minima, int32. A set's signature doesn't depend on anything but the set."""
    slices = np.lib.stride_tricks.sliding_window_view(circulant(), COORDINATES)
    at = (mix(found ^ np.uint64(0x5BF03635)) & np.uint64(PLACES - 1)).astype(np.int64)
    out = np.full(COORDINATES, PLACES, np.int32)
    for a in range(0, len(at), 256):  # rows that stay in the cache
        np.minimum(out, slices[at[a : a + 256]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys; a key tells its band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), rows.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out + rows[:, :, j])
    return out


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketch(docs: DataFrame) -> DataFrame:
    """From _id, _text: _id, n_shingles, s1, s2 (128 bits that name the set), the band keys and a byte of each coordinate."""

    def run(batches):
        forget_others("neardup")
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                names.append([int(mix(found).sum()), int(mix(found ^ np.uint64(0xABCDEF12345)).sum())] if len(found) else [0, 0])
                keys.append(signature(found) if len(found) else np.zeros(COORDINATES, np.int32))
            if not sizes:
                continue
            s = np.array(names, np.uint64)
            signatures = np.array(keys)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), longs(band_keys(signatures).ravel()))
            signs = pa.array([x.tobytes() for x in signatures.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), longs(s[:, 0]), longs(s[:, 1]), bands, signs], ["id", "n", "s1", "s2", "bands", "sign"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, sign binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents in `ids`, one row an id.

    Workers skip other documents by a bit set of fixed size; those that pass it by chance are left out by the join.
    """
    bits = key_bits(ids.select(F.xxhash64("id").alias("h")), "h", LOG2_BITS)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column(2).to_numpy().view(np.uint64), LOG2_BITS))).select([0, 1])

    some = docs.select(F.col("_id").alias("id"), F.col("_text").alias("text"), F.xxhash64("_id").alias("h")).mapInArrow(run, "id long, text string")
    return some.join(ids.select("id").distinct(), "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold.

    Texts travel instead of sets: they are smaller. Each pair takes its later text to its earlier one; a task keeps
    the last set it made, as pairs with the same first document follow one another.
    """
    texts = checkpointed(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))))

    def compare(batches):
        forget_others("neardup")
        last, kept = None, None
        for batch in batches:
            out = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a != last:
                    last, kept = a, shingles(x)
                other = shingles(y)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                out.append(OF * both >= NEED * (len(kept) + len(other) - both))
            yield batch.filter(pa.array(out, pa.bool_())).select([0, 1])

    return (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        .select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()
    )


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) in order, and the least node that each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        for ends in (label[a], label[b]):
            np.minimum.at(label, ends, least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(edges: DataFrame, rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """id, component (its least id) for the nodes of the edges (a, b): minimum labels with hooking and pointer jumping.

    Up to `few` edges are joined in the driver (16 bytes each), as rounds of shuffles would take far longer than they are worth. More are joined in rounds. In a round, each node's label and that of its root fall to the least label next to them, then labels jump to their label's label. Both sides
    of each join are read from checkpoints, so a hot node is split at run time, and minima are map-side combined.
    """
    edges = checkpointed(edges.where("a != b").select("a", "b").distinct())
    if edges.count() <= few:
        got = edges.toArrow()
        nodes, labels = least_labels(got["a"].to_numpy(), got["b"].to_numpy())
        return checkpointed(edges.sparkSession.createDataFrame(pa.table({"id": nodes.astype(np.int64), "component": labels.astype(np.int64)})))
    edges = checkpointed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    last = None
    for _ in range(rounds):
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        seen = labels.join(near, F.col("a") == F.col("id")).select("id", F.col("component").alias("root"), F.least("m", "component").alias("component"))
        hooked = checkpointed(seen.select("id", "component").union(seen.select(F.col("root").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component")))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = checkpointed(hooked.join(up, "component").select("id", F.least("next", "component").alias("component")))
        now = labels.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()
        if now == last:
            return labels
        last = now
    raise RuntimeError("the components didn't settle")


def best(pairs: DataFrame) -> DataFrame:
    """For each b, the a that it shares most buckets with."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("most")).select((-F.col("most.a")).alias("a"), "b")


def distinct_buckets(members: DataFrame) -> DataFrame:
    """Of buckets with the same members (key, id, component) one: near-copies meet in many bands."""
    named = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("h2"))
    return members.join(named.groupBy("n", "h", "h2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows (key, id, component, sign), in order of key, that agree in AGREE coordinates with a row of the same key and another component."""
    rest = None
    for batch in chain(batches, [None]):
        table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        key, component = table["key"].to_numpy(), table["component"].to_numpy()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        done = len(key) if batch is None else int(new[-1])  # the last key may go on
        sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        keep = np.zeros(len(key), bool)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            for k in range(a + 1, b if a < done else a):
                like = (component[a:k] != component[k]) & ((sign[a:k] == sign[k]).sum(1) >= AGREE)
                if like.any():
                    keep[a:k] |= like
                    keep[k] = True
        yield from table.slice(0, done).filter(pa.array(keep[:done])).select(["key", "id", "component"]).to_batches()
        rest = table.slice(done).combine_chunks().to_batches()[0] if done < len(key) else None


def possible(members: DataFrame, signs: DataFrame) -> DataFrame:
    """Those members (key, id, component) that can be linked to another component of their bucket, by the signatures (id, sign); of buckets with more than MEMBERS all.

    A pair is left out if fewer than AGREE of COORDINATES coordinates agree.
    """
    large = F.count("*").over(Window.partitionBy("key")) > MEMBERS
    sized = checkpointed(members.select("key", "id", "component", large.alias("large")))
    some = sized.where("not large").join(signs, "id").select("key", "id", "component", "sign").repartition("key").sortWithinPartitions("key")
    return checkpointed(some.mapInArrow(agreeing, "key long, id long, component long").union(sized.where("large").select("key", "id", "component")))


def cut_by_shingles(members: DataFrame) -> DataFrame:
    """Smaller buckets (key, id, component) in place of some buckets (key, id, component, text): two linked members meet in one at least.

    In a set ordered by how many members of the bucket have a shingle, the first n - ceil(0.75 n) + 1 of n shingles hold one of any linked set's. Shingles of one member alone
    come first and lead nowhere, so each shingle of a bucket is one short row, and few of them make a new bucket.
    """

    def run(batches):
        for batch in batches:
            for key, i, component, text in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                found = shingles(text)
                for a in range(0, len(found), 50_000):
                    part = longs(found[a : a + 50_000])
                    same = lambda x: pa.array(np.full(len(part), x, np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(key), same(i), same(component), same(len(found)), part], ["key", "id", "component", "n", "x"])

    rows = members.select("key", "id", "component", "text").mapInArrow(run, "key long, id long, component long, n long, x long")
    shared = rows.groupBy("key", "x").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("c > 1")
    mine = Window.partitionBy("key", "id")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("c", "x"))  # behind the shingles of this member alone
    first = rows.join(shared, ["key", "x"]).withColumn("place", place).where(f"place <= n - ({NEED} * n + {OF - 1}) div {OF} + 1 and lo != hi")
    return distinct_buckets(checkpointed(first.select(F.xxhash64("key", "x").alias("key"), "id", "component")))


def across(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join different components of a bucket (key, id, component, text), verified on full sets.

    Buckets of more than `block` characters are cut by their shingles first. What is still larger is dealt in blocks, and each task compares two of them. A task counts what a document shares
    with all others through the postings of its shingles, and returns no more links than it takes to join what it has.
    """
    large = checkpointed(members.groupBy("key").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") > block).select("key"))
    if not large.isEmpty():
        texts = members.select("id", "text").dropDuplicates(["id"])
        cut = cut_by_shingles(members.join(large, "key", "left_semi"))
        members = checkpointed(members.join(large, "key", "left_anti").select("key", "id", "component", "text").union(cut.join(texts, "id").select("key", "id", "component", "text")))
    blocks = members.groupBy("key").agg((F.sum(F.length("text")) / block + 1).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = dealt.select("key", "id", "component", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "id", "component", "text", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, of, block = (table[c].to_numpy() for c in ("id", "component", "block"))
        split = block.min() != block.max()
        sets = [shingles(t) for t in table["text"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(number, kind="stable")
        holders = owner[order]  # postings, shingle after shingle
        first = np.searchsorted(number[order], np.arange(number.max() + 2))
        ends = np.cumsum(sizes)
        root = of.copy()
        a, b = [], []
        for k in range(1, len(ids)):
            may = (root[:k] != root[k]) & ((block[:k] != block[k]) | (not split))
            if not may.any():
                continue
            own = number[ends[k] - sizes[k] : ends[k]]
            both = np.bincount(np.concatenate([holders[first[x] : first[x + 1]] for x in own]), minlength=len(ids))[:k]
            for i in np.flatnonzero(may & (OF * both >= NEED * (sizes[:k] + sizes[k] - both))):
                if root[i] != root[k]:
                    a.append(min(ids[i], ids[k]))
                    b.append(max(ids[i], ids[k]))
                    root[root == root[i]] = root[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts are lower-cased in A-Z and cut at ASCII white space. Documents without words have an empty set and are linked to nothing.
    Rows that share an id are one document for links, each with its own n_shingles; rows with a null id
    come last: they are linked to nothing, their component is null and they are kept.
    """
    docs = df.select(F.col(id_column).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    known = docs.where(F.col("_id").isNotNull())
    sketches = checkpointed(sketch(docs))
    full = sketches.where("n > 0 and id is not null")
    classes = checkpointed(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sign").alias("sign")))
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = checkpointed(
        keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("members")).where("members > 1").join(keys, "key").select("key", "least", F.col("rep").alias("id"))
    )
    tried = checkpointed(best(shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))))
    links = checkpointed(verified(known, tried))

    def named(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their component."""
        of = shared.join(components(links), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = of.groupBy("key").agg(F.min(F.struct("component", "id")).alias("lo"), F.max("component").alias("hi")).where("lo.component != hi")
        return checkpointed(of.join(mixed.select("key", "lo"), "key"))

    left = named(links)
    pairs = left.where("component != lo.component").select(F.least("id", "lo.id").alias("a"), F.greatest("id", "lo.id").alias("b"))
    again = checkpointed(best(pairs.join(tried, ["a", "b"], "left_anti")))
    links = checkpointed(links.union(verified(known, again)))
    left = possible(distinct_buckets(named(links)).select("key", "id", "component"), classes.select(F.col("rep").alias("id"), "sign"))
    texts = checkpointed(texts_of(known, left.select("id")).dropDuplicates(["id"]))
    links = links.union(checkpointed(across(left.join(texts, "id"))))

    groups = components(links)
    classes = checkpointed(
        classes.select("s1", "s2", "n", "rep").join(groups, F.col("rep") == F.col("id"), "left").select("s1", "s2", F.col("n").alias("m"), F.coalesce("component", "rep").alias("component_id"))
    )
    full = full.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"]).where("n = m").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    alone = sketches.where("n = 0 or id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
