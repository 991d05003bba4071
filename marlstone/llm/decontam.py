"""Benchmark decontamination by template windows and slot consistency.

Texts become templates: words in lower case, with typed placeholders for numbers, units and names (runs of words
with a capital that don't begin a sentence). Windows of W template tokens of the benchmark meet those of the documents in an equi-join on their hash;
a bit set of fixed size first leaves out windows of documents that no item has. Where an item's windows are found near one alignment, the values that the document
has in the item's slots are compared, both ways: a re-parameterised question maps each value of the item to one value of its own, and no two to the same.

Items whose windows are not half words (arithmetic, dates, lists of names) and items of few template tokens are matched as they stand, by windows over their words and
values. Those of fewer than SHORTEST tokens, and plain counts (1 2 3 4 ...), are found where they stand by themselves: between two stops, line ends or text ends.

Documents are read, not shuffled: what meets the benchmark are windows that pass the bit set, and only the rows whose text holds an item are joined to their hits.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, checkpointed, forget_others, join_few, key_bits, mix, passes

W = 8
SHORTEST = 4  # tokens; shorter items must stand by themselves
LITERAL = 0.5  # of a window's tokens must be words, or its values count too
COVER = 0.3  # of an item's windows found near one alignment
RUN = 13  # windows one after another that are enough, whatever the item's length
CONSISTENT = 0.6  # of the slots whose values are mapped one to one
SEGMENT = 4096  # windows of an item that are judged together
SLICE = 1 << 20  # characters looked at together
LOG2_BITS = 22
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?:;\n|#*&$%]")
#: Units of measure, in lower case.
UNITS = frozenset("mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph percent dollar dollars euro euros cent cents degree degrees watt watts volt volts joule joules hz khz mhz ghz kb mb gb tb".split())
NUMBER, UNIT, NAME = 1 << 2, 2 << 2, 3 << 2


def hash_of(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) >> 1 & ~3


def code(token: str) -> int:
    """A hash, and in the lowest two bits 0 for a word, 1 for a capitalised one, 2 for a number, 3 for a stop.

    Words all in capitals are plain words, so that a passage in capitals stays what it is.
    """
    if token[0].isdigit():
        return hash_of(token) | 2
    if not token[0].isalpha():
        return 3
    return hash_of(token.lower()) | (token[0].isupper() and len(token) > 1 and not token.isupper())


class Codes(dict):
    """The codes of what stands between two spaces, as int64 bytes; a worker forgets them all beyond a bound."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        out = np.array([code(t) for t in TOKEN.findall(chunk)], np.int64).tobytes()
        if len(chunk) <= 256:
            self[chunk] = out
        return out


_codes = CACHES["decontamination"] = Codes()
_unit_codes = np.array(sorted(hash_of(u) for u in UNITS), np.int64)


@dataclass
class Template:
    """The templates of some texts, one after another, and their tokens as they stand."""

    codes: np.ndarray = field(repr=False)  # of the template's tokens
    values: np.ndarray = field(repr=False)  # what stands in a slot; a word's own code else
    slots: np.ndarray = field(repr=False)  # whether it is a slot
    owner: np.ndarray = field(repr=False)  # the text
    words: np.ndarray = field(repr=False)  # codes of words and values, names one by one
    word_owner: np.ndarray = field(repr=False)
    opens: np.ndarray = field(repr=False)  # whether a word stands first, or after a stop
    closes: np.ndarray = field(repr=False)  # whether it stands last, or before a stop

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows, and which of them lie in one text and, if not `literal`, have words enough."""
        codes, owner = (self.words, self.word_owner) if literal else (self.codes, self.owner)
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        codes = codes.view(np.uint64)
        h = np.full(n, ~np.uint64(size) if literal else np.uint64(size), np.uint64)
        for j in range(size):
            h ^= codes[j : j + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        fit = owner[size - 1 :] == owner[:n]
        if not literal:
            words = np.concatenate([[0], np.cumsum(~self.slots)])
            fit &= words[size:] - words[:-size] >= LITERAL * size
        return mix(h), fit


def template(texts: list[str | None]) -> Template:
    get = _codes.__getitem__
    raw = [b"".join(map(get, t.split(" "))) if t else b"" for t in texts]
    arr = np.frombuffer(b"".join(raw), np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) // 8 for r in raw])
    kind, base = arr & 3, arr & ~np.int64(3)
    edge = np.ones(len(arr) + 1, bool)  # between two texts
    edge[1:-1] = owner[1:] != owner[:-1]
    stop = kind == 3
    first = edge[:-1].copy()  # begins a sentence or a text
    first[1:] |= stop[:-1]
    last = edge[1:].copy()
    last[:-1] |= stop[1:]
    unit = np.zeros(len(arr), bool)
    after = np.flatnonzero((kind[:-1] == 2) & (kind[1:] < 2) & ~edge[1:-1]) + 1
    unit[after] = np.isin(base[after], _unit_codes)  # a unit stands after a number
    name = (kind == 1) & ~first & ~unit
    codes = np.where(kind == 2, NUMBER, np.where(unit, UNIT, np.where(name, NAME, base)))
    keep = ~stop
    words, word_owner, opens, closes = base[keep], owner[keep], first[keep], last[keep]
    if name.any():  # a run of names is one, with their sum as its value
        again = np.zeros(len(arr), bool)
        again[1:] = name[1:] & name[:-1]
        start = np.flatnonzero(name & ~again)
        base[start] = np.add.reduceat(np.where(name, base, 0), start)
        keep &= ~again
    return Template(codes[keep], base[keep], ((kind == 2) | unit | name)[keep], owner[keep], words, word_owner, opens, closes)


def counts_on(text: str) -> bool:
    """Whether a text is only numbers with equal steps between them, as 1 2 3 4."""
    tokens = TOKEN.findall(text)
    return all(t.isascii() and t.isdigit() and len(t) < 19 for t in tokens) and len({int(b) - int(a) for a, b in zip(tokens, tokens[1:])}) < 2


#: A window of an item: its hash and place, the item's windows (of the segment) and length, how it is matched, and what stands in its slots.
ITEM_WINDOWS = "h long, item long, part long, q int, total int, length int, size int, literal boolean, alone boolean, item_values binary, slots int"


def item_windows(text: str) -> list[tuple]:
    """Rows of ITEM_WINDOWS without the item: each hash once in a segment, at its first place."""
    one = template([text])
    size, literal, alone = min(W, len(one.codes)), False, False
    if size >= SHORTEST:
        hashes, fit = one.windows(size)
    if size < SHORTEST or not fit.any():
        literal, size = True, min(W, len(one.words))
        if not size:
            return []
        alone = len(one.words) < SHORTEST or counts_on(text)
        hashes, fit = one.windows(size, True)
    out, length = [], min(len(one.words) if literal else len(one.codes), SEGMENT)
    for a in range(0, len(hashes), SEGMENT):
        places = {}
        for q in np.flatnonzero(fit[a : a + SEGMENT]).tolist():
            places.setdefault(int(hashes[a + q]), a + q)
        for h, q in places.items():
            own = b"" if literal else one.values[q : q + size].tobytes()
            slots = 0 if literal else sum(1 << j for j in range(size) if one.slots[q + j])
            out.append((h - (1 << 64) if h >> 63 else h, a, q, len(places), length, size, literal, alone, own, slots))
    return out


def items_of(benchmark: DataFrame) -> DataFrame:
    """The windows of all items (columns i, t)."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.bool_(), pa.binary(), pa.int32()]
        names = [c.split()[0] for c in ITEM_WINDOWS.split(", ")]
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 22  # of items that share an id each is judged by itself
                rows = [(h, i, key * 1_048_576 + part // SEGMENT, *rest) for h, part, *rest in item_windows(t)]
                for a in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[a : a + 20_000], strict=True), kinds, strict=True)], names)

    return benchmark.mapInArrow(run, ITEM_WINDOWS)


DOCUMENT_WINDOWS = "h long, k1 long, k2 long, p int, opens boolean, closes boolean, doc_values binary"


def documents_of(docs: DataFrame, bits: np.ndarray, sizes: list[tuple[int, bool]]) -> DataFrame:
    """The windows of the texts (columns k1, k2, t) that pass the bit set, each once."""

    def look(keys: list[tuple[int, int]], texts: list[str]):
        doc, out = template(texts), []
        for size, literal in sizes:
            hashes, fit = doc.windows(size, literal)
            may = np.flatnonzero(fit)
            may = may[passes(bits, hashes[may], LOG2_BITS)]
            owner = doc.word_owner if literal else doc.owner
            starts = np.searchsorted(owner, owner[may])  # of each window's text
            for p, at, h in zip(may.tolist(), starts.tolist(), hashes[may].view(np.int64).tolist(), strict=True):
                values = b"" if literal else doc.values[p : p + size].tobytes()
                out.append((h, *keys[owner[p]], p - at, literal and bool(doc.opens[p]), literal and bool(doc.closes[p + size - 1]), values))
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in DOCUMENT_WINDOWS.split(", ")]
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[a : a + 20_000], strict=True), kinds, strict=True)], names)

    def run(batches):
        forget_others("decontamination")
        for batch in batches:
            keys, texts, size = [], [], 0
            for k1, k2, t in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if not t:
                    continue
                keys.append((k1, k2))
                texts.append(t)
                size += len(t)
                if size > SLICE:
                    yield from look(keys, texts)
                    keys, texts, size = [], [], 0
            yield from look(keys, texts)

    return docs.mapInArrow(run, DOCUMENT_WINDOWS).distinct()


def runs(found: list[dict]) -> list[list[dict]]:
    """Hits one after another at the same alignment, at least RUN of them."""
    out: list[list[dict]] = []
    for x in sorted(found, key=lambda x: (x["p"] - x["q"], x["p"])):
        if out and (out[-1][-1]["p"], out[-1][-1]["q"]) == (x["p"] - 1, x["q"] - 1):
            out[-1].append(x)
        else:
            out.append([x])
    return [x for x in out if len(x) >= RUN]


def consistent(found: list[dict], size: int) -> float:
    """The share of slots whose values are each other's most usual partner: a mapping that is one to one."""
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for x in found:
        if x["slots"]:
            mine, theirs = np.frombuffer(x["item_values"], np.int64).tolist(), np.frombuffer(x["doc_values"], np.int64).tolist()
            pairs.update({(x["p"] + j, x["q"] + j): (mine[j], theirs[j]) for j in range(size) if x["slots"] >> j & 1})
    counts = Counter(pairs.values())
    there, back = {}, {}
    for (a, b), n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        there.setdefault(a, b)
        back.setdefault(b, a)
    return sum(n for (a, b), n in counts.items() if there[a] == b and back[b] == a) / len(pairs) if pairs else 1.0


def judge(found: list[dict], total: int, size: int, literal: bool, alone: bool) -> tuple[float, float] | None:
    """Cover and consistency of an item in hits that are near one alignment; None if it isn't held."""
    by: dict[int, list[dict]] = defaultdict(list)
    for x in found:
        by[x["p"] - x["q"]].append(x)
    cover = lambda part: len({x["q"] for x in part}) / total
    if alone:
        for part in by.values():
            part = sorted(part, key=lambda x: x["q"])
            if cover(part) == 1 and part[0]["opens"] and part[-1]["closes"]:
                return 1.0, 1.0
        return None
    for part in ([found, *by.values()] if len(by) > 1 else [found]):
        if cover(part) >= COVER and (same := consistent(part, size)) >= CONSISTENT:
            return cover(part), same
    for part in runs(found):
        if (same := consistent(part, size)) >= CONSISTENT:
            return cover(part), same
    return None


def held(hits: DataFrame) -> DataFrame:
    """k1, k2, item, cover, consistent: the items that texts hold, from joined windows.

    Hits within about half an item's length of one alignment are judged together (what is put in or left out shifts the alignment), each
    in two overlapping groups. A group has at most about twice as many hits as the item has windows.
    """
    step = F.greatest(F.expr("length div 2"), F.lit(16))
    near = F.floor((F.col("p") - F.col("q")) / step)
    fields = ("p", "q", "opens", "closes", "item_values", "doc_values", "slots")
    groups = (
        hits.withColumn("near", F.explode(F.array(near, near - 1))).groupBy("k1", "k2", "item", "part", "near")
        .agg(F.collect_list(F.struct(*fields)).alias("found"), *[F.first(c).alias(c) for c in ("total", "size", "literal", "alone")])
    )

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (got := judge(r["found"], r["total"], r["size"], r["literal"], r["alone"])) is not None:
                    out.append((r["k1"], r["k2"], r["item"], *got))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [*[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)], ["k1", "k2", "item", "cover", "consistent"])

    found = groups.mapInArrow(run, "k1 long, k2 long, item long, cover double, consistent double")
    return found.groupBy("k1", "k2", "item").agg(F.max(F.struct("cover", "consistent")).alias("best"))


def contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of `df` with hits (item, cover, consistent; by item) and contaminated.

    Items with a null id or text, and those without a word or number, match nothing. Null and empty texts hold nothing. Equal texts are looked at as
    one. Columns of `df` named hits or contaminated are replaced. Items are never gathered: the driver gets the sizes of windows (W of each
    kind at most) and a bit set of fixed size.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    windows = checkpointed(items_of(items.distinct()))
    sizes = sorted((r["size"], r["literal"]) for r in windows.select("size", "literal").distinct().collect())
    bits = key_bits(windows, "h", LOG2_BITS)
    texts = df.select(F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.col(text), F.lit(1)).alias("k2"), F.col(text).cast("string").alias("t"))
    hits = documents_of(texts, bits, sizes).join(windows, "h")
    each = held(hits).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("item", "best.cover", "best.consistent"))).alias("__hits"))
    keyed = df.withColumns({"__k1": F.xxhash64(F.col(text)), "__k2": F.xxhash64(F.col(text), F.lit(1))})
    out = join_few(keyed, checkpointed(each.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})), ["__k1", "__k2"]).drop("__k1", "__k2", *({"hits", "contaminated"} - {text}))
    return out.withColumn("hits", F.coalesce("__hits", F.array().cast("array<struct<item:bigint,cover:double,consistent:double>>"))).drop("__hits").withColumn("contaminated", F.size("hits") > 0)
