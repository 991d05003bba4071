"""Personal data: fixed patterns, and terms whose co-occurrence with an entity gives it away.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone numbers. Every distinct value is an entity.
The words of a document are the context terms of every entity in it. Over all documents, with N documents, the information that a term t gives about
an entity e is PMI(e, t) = log(N df(e, t) / (df(e) df(t))), and that of the entity itself IC(e) = log(N / df(e)). A term that
gives at least GENERALISE of IC(e), seen with e in at least SUPPORT documents, is generalised to its kind wherever it stands in documents
that hold e; from REMOVE on it is removed. Entities in fewer than SUPPORT documents can't have such terms, so their texts are not paired.

Counts are map-side combined. Words that occur with such an entity are counted in its documents; elsewhere only candidate terms are: workers
leave out other words by a bit set of fixed size, and an exact join follows. Only rows whose text holds a disclosing term are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget_others, key_bits, passes

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A look-behind only saves trying the same run of digits again; a run's later starts fail if its first does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
LOG2_BITS = 22
PAIRS = 100_000  # kept together by a worker


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """Base spans (kind, start, end), by kind, then start; each kind's are leftmost and don't overlap."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((0, a, m.end()))
        floor = m.end() if m else at + 1  # what is left of a sign that failed can't be part of a later address
        at = text.find("@", floor)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(m[0]) <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def entity(kind: int, value: str) -> str:
    """One name for the spellings of a value."""
    if kind == 0:
        return f"0:{value.lower()}"
    return f"{kind}:" + (value if kind == 1 else "".join(c for c in value if c in "0123456789"))


def words_beside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that overlap no base span."""
    out, taken, k = [], [], 0
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            out.append((m[0].lower(), *m.span()))
    return out


def context(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of each entity with each word of the text; words that overlap a base span aren't terms."""
    words = words_beside(text, base) if base else []
    return [(e, *w) for e in dict.fromkeys(entity(k, text[a:b]) for k, a, b in base) for w in words]


def mentions(docs: DataFrame) -> DataFrame:
    """From __k1, __k2 (which name a text) and __text: a row (k1, k2, e, n) for each entity of a text, n rows having that text."""

    def run(batches):
        forget_others("")
        for batch in batches:
            counts: Counter[tuple[int, int, str]] = Counter()
            for k1, k2, text in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if text:
                    counts.update((k1, k2, e) for e in {entity(kind, text[a:b]) for kind, a, b in find(text)})
            out = [(*k, n) for k, n in counts.items()]
            for a in range(0, len(out), 20_000):
                columns = zip(*out[a : a + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["k1", "k2", "e", "n"])

    found = docs.select("__k1", "__k2", "__text").mapInArrow(run, "k1 long, k2 long, e string, n long")
    return found.groupBy("k1", "k2", "e").agg(F.sum("n").alias("n"))


class Passing(dict):
    """Whether a bit set lets a text pass; a task forgets its answers all together beyond a bound."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits.tobytes(), 64 - LOG2_BITS

    def __missing__(self, text: str) -> bool:
        slot = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42) >> self.shift  # as Spark's xxhash64
        out = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
        if len(self) > 150_000:
            self.clear()
        if len(text) <= 256:
            self[text] = out
        return out


def counted(docs: DataFrame, count, schema: str) -> DataFrame:
    """The sums of what `count()` gives: it makes a function for each task that adds a text's keys to a Counter. Keys are combined within a task, PAIRS at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(counts):
        columns = zip(*[(*k, n) for k, n in counts.items()], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string()] * (len(names) - 1) + [pa.int64()], strict=True)], names)

    def run(batches):
        forget_others("")
        counts: Counter[tuple[str, ...]] = Counter()
        add = count()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for keys in add(text):
                        counts.update(keys)
                        if len(counts) > PAIRS:
                            yield rows(counts)
                            counts.clear()
        if counts:
            yield rows(counts)

    return docs.select("__text").mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def names_in(text: str, base: list[tuple[int, int, int]], may: Passing) -> list[str]:
    """The entities of a text that a bit set lets pass."""
    return [e for e in dict.fromkeys(entity(k, text[a:b]) for k, a, b in base) if may[e]]


def pairs(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """e, t, n: in how many documents each entity that passes the bit set occurs with each word; with e = '' in how many documents any of them does."""

    def count():
        may = Passing(bits)

        def add(text):
            base = find(text)
            names = names_in(text, base, may)
            words = {w for w, _, _ in words_beside(text, base)} if names else ()
            for e in [*names, ""] if names else ():
                yield ((e, w) for w in words)

        return add

    return counted(docs, count, "e string, t string, n long")


def elsewhere(docs: DataFrame, bits: np.ndarray, candidates: DataFrame) -> DataFrame:
    """t, n: in how many documents each candidate term (column t) occurs that pairs() hasn't counted: those without an entity that passes
    the bit set, and those that hold the term within base spans alone."""
    terms = key_bits(candidates.select(F.xxhash64("t").alias("h")), "h", LOG2_BITS)

    def count():
        may, known = Passing(bits), Passing(terms)

        def add(text):
            base = find(text)
            words = {*WORD.findall(text.lower())}
            if base and names_in(text, base, may):
                words -= {w for w, _, _ in words_beside(text, base)}
            yield [(w,) for w in words if known[w]]

        return add

    return counted(docs, count, "t string, n long").join(candidates.select("t"), "t", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """e, t, level: pairs whose term gives the entity away; level 1 is to be generalised, 2 removed."""
    n_docs = F.lit(docs.count())
    entities = checkpointed(found.groupBy("e").agg(F.sum("n").alias("de")).where((F.col("de") >= SUPPORT) & (F.col("de") < n_docs)))
    bits = key_bits(entities.select(F.xxhash64("e").alias("h")), "h", LOG2_BITS)
    both = checkpointed(pairs(docs, bits).where(F.col("n") >= SUPPORT))
    share = lambda dt: F.log(n_docs * F.col("n") / (F.col("de") * dt)) / F.log(n_docs / F.col("de"))
    joint = both.join(entities, "e").join(both.where("e = ''").select("t", F.col("n").alias("least")), "t")
    joint = checkpointed(joint.where(share(F.col("least")) >= GENERALISE - 1e-9))  # dt is not less, so nothing is lost
    rest = elsewhere(docs, bits, joint.select("t").distinct()).withColumnRenamed("n", "rest")
    part = share(F.col("least") + F.coalesce("rest", F.lit(0)))
    return (
        joint.join(rest, "t", "left").withColumn("part", part).where(F.col("part") >= GENERALISE)
        .select("e", "t", F.when(F.col("part") >= REMOVE, 2).otherwise(1).alias("level"))
    )


def places(text: str, base: list[tuple[int, int, int]], level: dict[str, int]) -> list[tuple[int, int, int]]:
    """Where each of a text's disclosing terms stands: (start, end, level), by start."""
    return [(a, b, level[w]) for w, a, b in words_beside(text, base) if w in level] if level else []


def sanitise(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, int]]) -> str:
    """The text with base spans replaced by their kind's name, and terms generalised ([NAME] or [TERM]) or removed."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base]
    marks += [(a, b, "" if level == 2 else "[NAME]" if text[a].isupper() else "[TERM]") for a, b, level in terms]
    parts, at = [], 0
    for a, b, new in sorted(marks):
        if a < at:  # kinds may overlap one another: the rest of the later one goes too
            at = max(at, b)
            continue
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


MARKED = pa.struct([
    ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("terms", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32())]))),
    ("clean_text", pa.string()),
])


def sanitise_documents(df: DataFrame, *, text: str = "text", clean: bool = True) -> DataFrame:
    """Every row of `df` with base (array of kind, start, end), terms (array of start, end, level) and, unless `clean` is false, clean_text.

    Offsets are in code points, ends exclusive. Null texts are empty ones (clean_text stays null). Results depend on the text alone, and each row counts as a
    document, so repeated rows get equal results and null ids are fine. Columns of `df` named base, terms or clean_text are
    replaced; names that begin with `__` are the operator's own.
    """
    keyed = df.withColumns({"__text": F.col(text).cast("string"), "__k1": F.xxhash64(F.col(text)), "__k2": F.xxhash64(F.col(text), F.lit(1))})
    keyed = keyed.drop(*({"base", "terms", "clean_text"} - {text}))
    found = checkpointed(mentions(keyed))  # small beside the texts, and read twice
    own = (
        found.join(disclosing(keyed, found), "e").groupBy("k1", "k2", "t").agg(F.max("level").alias("level"))
        .groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("t", "level")).alias("__own"))
    )

    own = checkpointed(own)
    bits = key_bits(own.select(F.xxhash64("__k1", "__k2").alias("h")), "h", LOG2_BITS)
    key = F.xxhash64("__k1", "__k2")

    def result(t: str | None, levels: list[dict] | None) -> dict:
        base = find(t or "")
        terms = places(t or "", base, {w["t"]: w["level"] for w in levels or ()})
        new = (sanitise(t, base, terms) if base or terms else t) if clean else None
        return {"base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "terms": [{"start": a, "end": b, "level": n} for a, b, n in terms] or None, "clean_text": new}

    def may(keys: pa.Array) -> pa.Array:
        return pa.array(passes(bits, keys.to_numpy().view(np.uint64), LOG2_BITS))

    def mark(texts: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([result(t, levels) for t, levels in zip(texts.to_pylist(), own.to_pylist(), strict=True)], MARKED)

    def mark_others(texts: pa.Array, keys: pa.Array) -> pa.Array:
        """For rows that have no terms for sure; null for the others."""
        return pa.array([None if some else result(t, None) for t, some in zip(texts.to_pylist(), may(keys).to_pylist(), strict=True)], MARKED)

    # rows that may have terms are dealt out evenly and joined; each task of a stage needs one Python worker
    kind = "struct<base:array<struct<kind:int,start:bigint,end:bigint>>,terms:array<struct<start:bigint,end:bigint,level:int>>,clean_text:string>"
    some = keyed.where(F.arrow_udf(may, "boolean")(key)).hint("rebalance").join(own, ["__k1", "__k2"], "left")
    some = some.withColumn("__done", F.arrow_udf(mark, kind)(F.col("__text"), F.col("__own"))).drop("__own")
    others = keyed.withColumn("__done", F.arrow_udf(mark_others, kind)(F.col("__text"), key)).where("__done IS NOT NULL")
    marked = some.unionByName(others).drop("__text", "__k1", "__k2")
    return marked.withColumns({c: F.col("__done")[c] for c in ("base", "terms", "clean_text")[: 2 + clean]}).drop("__done")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from base and terms."""
    named = lambda column, kind: F.transform(column, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + F.lit(1))
    base = named(F.col("base"), kind)
    terms = F.coalesce(named(F.col("terms"), lambda s: F.lit("term")), F.array().cast("array<string>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, terms)).alias("spans"),
        F.size(terms).cast("long").alias("n_terms"),
    )
