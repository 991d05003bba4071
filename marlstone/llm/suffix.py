"""Exact repeats of LENGTH bytes by distributed difference-cover suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier (in a smaller doc_id, or before in the same document).

Suffixes of a whole corpus need not be sorted against each other: equal strings of LENGTH bytes have the same anchor, the least of
their GRAM-byte grams by a hash. So a text falls into runs of windows with a common anchor, and only runs with the same
anchor can hold equal windows. (1) Anchors are counted; those met twice or more go into a bit set of fixed size. (2) Runs
with such an anchor are dealt out by it, equal runs of a task once only. (3) Each task sorts the suffixes of its runs by the
difference cover modulo 3: it sorts the triples at sampled places, recurses on their names (until names stand for LENGTH
bytes), merges the remaining suffixes, and compares adjacent prefixes; of equal windows, all but the earliest are covered. (4) Covered
stretches are joined to the texts by document.

A task's share is bounded: runs are cut at PIECE windows, and tasks sort at most about CHUNK bytes at a time. Anchors with more bytes than that
(a second bit set knows them) aren't sorted together: each of their windows is dealt out by its own digest, so that only equal ones meet, one at a time. A passage that
a third of all documents holds is dealt out once by each slice of the input. The bit sets only save work: beyond some 2**LOG2_BITS repeated
anchors the first lets most runs pass, at most 3.9 times the text, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget_others, join_few, key_bits, mix, passes, utf8

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1  # grams in a window
SLICE = 1 << 19  # bytes looked at together
PIECE = 4096  # windows of a run
CHUNK = 1 << 20  # bytes sorted together, about
HOT = CHUNK // (LENGTH + WINDOW)  # runs of an anchor, or as much in longer ones, beyond which its windows are dealt out one by one
SEEN = 100_000  # runs that a worker tells apart
LOG2_BITS, LOG2_HOT = 26, 20


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of pieces of texts, one after another; each piece's row, place in the text, place in the bytes, and length.

    Pieces overlap by LENGTH - 1 bytes, so each window lies in one of them; shorter texts have none.
    """
    data, at = utf8(batch.column(1))
    row, start, end, size = [], [], [], 0

    def take():
        lengths = np.array(end) - np.array(start)
        return np.concatenate([data[a:b] for a, b in zip(start, end, strict=True)]), np.array(row), np.array(start) - at[np.array(row)], np.cumsum(lengths) - lengths, lengths

    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a >= LENGTH:
            n = min(b - a, SLICE - size + LENGTH) if b - a > SLICE else b - a
            row.append(i)
            start.append(a)
            end.append(a + n)
            size += n
            a += n - LENGTH + 1
            if size >= SLICE:
                yield take()
                row, start, end, size = [], [], [], 0
    if row:
        yield take()


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = mix(x.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < GRAM:
        left = h[:-step] * np.uint64(0x9FB21C651E98DF25)
        left ^= left >> np.uint64(32)
        left += h[step:]
        h = left
        step *= 2
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(x: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a common anchor: anchor, piece, first window, number of windows, and whether the anchor occurs in it again."""
    h = grams(x)
    least, step = h, 1
    while 2 * step <= WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - step)], least[WINDOW - step :])
    counts = lengths - LENGTH + 1
    piece = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + places[piece]
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if (size > PIECE).any():
        first = np.concatenate([np.arange(f, f + n, PIECE) for f, n in zip(first.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(first, len(at)))
    start, key = at[first], anchor[first]
    again = np.zeros(len(first), bool)
    for a in range(0, len(first), 1 << 14):
        part = slice(a, a + (1 << 14))
        view = np.arange(WINDOW)
        lo = (h[start[part, None] + view] == key[part, None]).argmax(1) + start[part]
        ends = start[part] + size[part] - 1
        hi = WINDOW - 1 - (h[ends[:, None] + view] == key[part, None])[:, ::-1].argmax(1) + ends
        again[part] = lo != hi
    return mix(key), piece[first], start, size, again


def anchors(docs: DataFrame) -> DataFrame:
    """g, n: anchors and how often they occur (2 at least if a run holds one again; a run longer than WINDOW counts for as many)."""

    def run(batches):
        forget_others("suffix")
        for batch in batches:
            for x, _, _, places, lengths in slices(batch):
                g, _, _, size, again = runs(x, places, lengths)
                g, inverse = np.unique(g, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.bincount(inverse, 1 + again + (size - 1) // WINDOW).astype(np.int64))], ["g", "n"])

    return docs.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


RUNS = "g long, doc_id long, start long, end long, body binary, again boolean"


def repeated_runs(docs: DataFrame, bits: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Runs whose anchor passes the first bit set: g, doc_id, start, end, their bytes, and whether the anchor occurs in them again.

    Runs known to be covered have no bytes. Of anchors that pass the second bit set there is a row for each window, dealt by its digest,
    with the digest in place of the bytes and a null in place of `again`.
    """

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for x, row, start, places, lengths in slices(batch):
                g, piece, first, size, again = runs(x, places, lengths)
                own = np.flatnonzero(passes(bits, g, LOG2_BITS))
                if not len(own):
                    continue
                raw, out, covered = x.tobytes(), [], []

                def known(name: bytes, doc: int, s: int, end: int) -> bool:
                    """Whether equal bytes were met at an earlier place; they are covered then."""
                    other = seen.get(name)
                    if other is None or other >= (doc, s):
                        if len(seen) > SEEN:
                            seen.clear()
                        seen[name] = (doc, s)
                        return False
                    if covered and covered[-1][0] == doc and covered[-1][1] <= s <= covered[-1][2]:
                        covered[-1][2] = max(end, covered[-1][2])
                    else:
                        covered.append([doc, s, end])
                    return True

                docs_of, at = ids[row[piece[own]]], first[own] - places[piece[own]] + start[piece[own]]
                split = passes(hot, g[own], LOG2_HOT)
                for key, doc, s, p, n, twice, each in zip(g[own].view(np.int64).tolist(), docs_of.tolist(), at.tolist(), first[own].tolist(), size[own].tolist(), again[own].tolist(), split.tolist(), strict=True):
                    body = raw[p : p + n - 1 + LENGTH]
                    if known(hashlib.blake2b(body, digest_size=16).digest(), doc, s, s + len(body)):
                        continue
                    if not each:
                        out.append((key, doc, s, s + len(body), body, twice))
                        continue
                    for j in range(n):
                        name = hashlib.blake2b(body[j : j + LENGTH], digest_size=16, person=b"window").digest()
                        if not known(name, doc, s + j, s + j + LENGTH):
                            out.append((int.from_bytes(name[:8], "little", signed=True), doc, s + j, s + j + LENGTH, name, None))
                # stretches need no anchor any more: their documents spread them
                out += [(int(k), doc, a, b, None, False) for k, (doc, a, b) in zip(mix(np.array([c[0] for c in covered], np.int64).view(np.uint64)).view(np.int64), covered, strict=True)]
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
                for a in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[a : a + 50_000], strict=True), kinds, strict=True)], ["g", "doc_id", "start", "end", "body", "again"])

    return docs.mapInArrow(run, RUNS)


def packed(*columns: np.ndarray) -> np.ndarray:
    """Rows of small non-negative numbers as one number each, in the same order."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        top = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 63) // top:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key * np.uint64(top) + c.astype(np.uint64)
    return key


def suffix_order(s: np.ndarray, stands_for: int = 1) -> np.ndarray:
    """Places of s (numbers from 1) in the order of their suffixes; those alike over LENGTH bytes are in any order.

    stands_for: the bytes that a number of s stands for.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])  # with a place past the end, where the first kind would not close
    triple = packed(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(triple)
    triple = triple[order]
    new = np.ones(len(sample), np.int64)
    new[1:] = triple[1:] != triple[:-1]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if not new.all() and 3 * stands_for < LENGTH:
        order = suffix_order(name, 3 * stands_for)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    order = sample[order]
    order = order[order < n]
    rest = np.arange(0, n, 3)
    # how many sampled suffixes of each kind stand before each of the rest; those alike over LENGTH bytes may be out of order
    in_one = order[order % 3 == 1]
    both = np.concatenate([in_one, rest])
    key = packed(t[both], rank[both + 1])
    first, key = key[: len(in_one)], key[len(in_one) :]
    by = np.argsort(key)
    rest = rest[by]
    before = np.searchsorted(np.sort(first), key[by])
    in_two = order[order % 3 == 2]
    both = np.concatenate([in_two, rest])
    key = packed(t[both], t[both + 1], rank[both + 2])
    before += np.searchsorted(np.sort(key[: len(in_two)]), key[len(in_two) :])
    mine = np.maximum.accumulate(before) + np.arange(len(rest))
    out = np.empty(n, np.int64)
    out[mine] = rest
    free = np.ones(n, bool)
    free[mine] = False
    out[free] = order
    return out


def later_windows(bodies: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) stretches covered by windows of the bodies that also start earlier in one of them."""
    x = np.frombuffer(b"".join(bodies) + b"\0" * LENGTH, np.uint8)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    n = int(lengths.sum())
    order = suffix_order(x[:n].astype(np.int64) + 1)
    piece = np.repeat(np.arange(len(bodies)), lengths)
    within = np.arange(n) - (np.cumsum(lengths) - lengths)[piece]
    order = order[(within <= lengths[piece] - LENGTH)[order]]
    words = np.ndarray((n + LENGTH - 7,), "<u8", x.tobytes(), strides=(1,)).copy()
    alike = np.arange(1, len(order))
    for j in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # adjacent prefixes
        alike = alike[words[order[alike] + j] == words[order[alike - 1] + j]]
    same = np.zeros(len(order), bool)
    same[alike] = True
    first = np.flatnonzero(~same)
    rank = np.unique(doc, return_inverse=True)[1]
    age = ((rank << 40) + start)[piece[order]] + within[order]
    least = np.repeat(np.minimum.reduceat(age, first), np.diff(np.append(first, len(order)))) if len(order) else age
    late = np.sort(order[age > least])
    if not len(late):
        return []
    new = np.ones(len(late), bool)
    new[1:] = (late[1:] - late[:-1] > LENGTH) | (piece[late[1:]] != piece[late[:-1]])
    a, b = late[new], late[np.append(new[1:], True)]
    return list(zip(doc[piece[a]].tolist(), (start[piece[a]] + within[a]).tolist(), (start[piece[a]] + within[b] + LENGTH).tolist(), strict=True))


def stretches(batches: Iterator[pa.RecordBatch], chunk: int, sorts: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """doc_id, start, end stretches from rows of RUNS in order of g; `sorts` gets the bytes of each sort."""
    waiting: list[tuple[bytes, tuple[int, int]]] = []
    bodies: dict[bytes, tuple[int, int]] = {}  # of the anchor at hand
    size, last, twice, out = 0, None, False, []

    def close():
        """An anchor with one body that holds it once has no other equal windows: its runs are done."""
        nonlocal size, twice
        if twice or len(bodies) > 1:
            more = sum(map(len, bodies))
            if size + more > chunk:
                flush()
            waiting.extend(bodies.items())
            size += more
        bodies.clear()
        twice = False

    def flush():
        nonlocal size
        if waiting:
            if sorts is not None:
                sorts.append(size)
            at = np.array([place for _, place in waiting], np.int64)
            out.extend(later_windows([body for body, _ in waiting], at[:, 0], at[:, 1]))
        waiting.clear()
        size = 0

    def pack():
        rows = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["doc_id", "start", "end"])
        out.clear()
        return rows

    single: dict[bytes, tuple[int, int, int]] = {}  # windows of the digest at hand
    for batch in batches:
        g, doc, start, end, body, again = (batch.column(j).to_pylist() for j in range(6))
        for key, d, a, b, text, more in zip(g, doc, start, end, body, again, strict=True):
            if text is None:
                out.append((d, a, b))
                continue
            if key != last:
                close()
                single.clear()
                last = key
            if more is None:  # a window by itself
                other = single.get(text)
                if other is None or (d, a, b) < other:
                    single[text] = (d, a, b)
                if other is not None and other[:2] != (d, a):
                    out.append(max(other, (d, a, b)))
                continue
            twice |= more
            other = bodies.get(text)
            if other is None:
                bodies[text] = (d, a)
            elif other != (d, a):  # all windows of the later one are repeats
                late = max(other, (d, a))
                bodies[text] = min(other, (d, a))
                out.append((*late, late[1] + len(text)))
        yield pack()
    close()
    flush()
    yield pack()


def covered(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, start, end stretches from the runs of repeated_runs()."""
    return found.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: stretches(batches, chunk), "doc_id long, start long, end long")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row.

    Null texts are empty ones. Rows that share an id count as one document: a string at the same place of both is no repeat, and what is
    covered in one goes from each. Rows with a null id are left whole, and nothing is a repeat of them.
    """
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    seen = checkpointed(anchors(known).where("n > 1"))
    bits, often = key_bits(seen, "g", LOG2_BITS), key_bits(seen.where(F.col("n") > hot), "g", LOG2_HOT)
    found = covered(repeated_runs(known, bits, often))
    spans = checkpointed(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw, out = data.tobytes(), []
            for a, b, found in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((s["start"], min(s["end"], b - a)) for s in found or ()):
                    if lo >= hi:
                        continue
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                edges = [0, *(x for span in merged for x in span), b - a]
                kept = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((b - a, b - a - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    return join_few(docs, spans, ["doc_id"]).select("doc_id", "text", "spans").mapInArrow(cut, RESULT)
