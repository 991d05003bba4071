"""Operators that judge each row by itself: URLs, audio, language, PII spans, tokens, packing, toxicity, templates."""

import hashlib
import io
import math
import pickle
import re
import tracemalloc
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import audio, decontam, language, packing, pii, tokens, toxicity, urls

TEXTS = [(1, "Plain words here."), (1, "Plain words here."), (2, None), (None, "no id"), (3, ""), (4, "é\n ü  x " * 3000), (5, "\x1c\u2028 odd 🙂 <|endoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids and texts, repeated rows, a long text, and columns whose names clash with results."""
    rows = [(i, t, "x", 1.0, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, score double, terms int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# -- URLs


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.NET/en/x?q=/de/", "k"), (2, "https://example.net/fr/", "k"), (3, "http://notexample.com/de/", "k"), (4, "http://x.example.com/de/1#f", "k"), (5, None, "k"), (6, "no scheme", "k"),
         (7, "http://a.org/fr/", "k"), (7, "http://a.org/fr/", "k"), (8, "http://net", "k"), (9, "http://net?/", "k"), (10, "x://http://y.net/", "k"), (11, "://", "k"), (12, "http://" + "a." * 5000 + "net/" + "p/" * 5000, "k")],
        "page_id long, url string, verdict string",
    )
    rules = urls.rules_frame(spark, [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")])
    got = {(r.page_id): (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: ("example.com/de/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: ("net/", "block")}
    assert urls.filter_urls(pages, rules).count() == pages.count()
    assert urls.filter_urls(pages, rules.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == pages.count()
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_urls_ties_and_odd_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy/z"), (2, "http://b.c")], "page_id long, url string")
    rules = urls.rules_frame(spark, [("allow", "a.b.c", "/x"), ("block", "b.c", "/xy/"), ("allow", "b.c", "/xy/"), ("allow", "b.c", ""), ("block", None, "/")])
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {1: ("a.b.c/x", "allow"), 2: ("b.c", "allow")}  # equally long: the longer host


def test_urls_match_brute_force(spark):
    """Many rules of many shapes; columns of the pages that clash with the operator's."""
    rng = np.random.default_rng(4)
    pick = lambda n, letters="ab": "".join(rng.choice(list(letters), n))
    host = lambda: ".".join(pick(1) for _ in range(rng.integers(1, 6)))
    rules = list({(h, p): (str(rng.choice(["allow", "block"])), h, p) for h, p in ((host(), "/" + pick(rng.integers(0, 40), "x/")) for _ in range(600))}.values())
    pages = [(i, f"http://{host()}/{pick(rng.integers(0, 60), 'x/')}?{pick(3)}", "c", i, 1, "d") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, u_url string, best long, short int, digest string")
    got = urls.filter_urls(df, urls.rules_frame(spark, rules))
    assert got.columns == [*df.columns, "host", "path", "rule", "verdict"]
    for r in got.collect():
        rest = r.url.split("://")[1].split("?")[0]
        h, p = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        fit = [(len(rh + rp), len(rh), v == "block", rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, best[3], best[4]) and (r.u_url, r.best) == ("c", r.page_id)


# -- audio


def test_wav_is_read_by_others():
    data = bytes(range(256)) + b"x"
    media = audio.to_wav(data)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(1000)) == (audio.RATE, 1, 1, data)
    assert audio.from_wav(media) == (data, audio.RATE)
    with pytest.raises(ValueError):
        audio.from_wav(b"nothing")


def test_resampling_matches_the_direct_sum():
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        n = -(-len(x) * up // down)
        taps = audio.polyphase(up, down)
        direct = np.zeros(n)
        for k in range(n):
            place, phase = divmod(k * down, up)
            for j in range(2 * audio.TAPS):
                i = place - audio.TAPS + 1 + j
                direct[k] += x[i] * taps[phase][j] if 0 <= i < len(x) else 0
        assert np.allclose(audio.resample(x, up, down, 0, n), direct, atol=1e-4)
        assert np.allclose(audio.resample(x, up, down, 100, 50), direct[100:150], atol=1e-4)


def test_log_mel_matches_the_definition():
    """Frames, discrete Fourier sums and triangles, one by one."""
    data = np.random.default_rng(5).integers(0, 256, 900).astype(np.uint8)
    x = (data.astype(float) - 128) / 128
    y = audio.resample(x.astype(np.float32), 1, 2, 0, 450).astype(float)
    got = audio.log_mel(data.tobytes())
    top = 2595 * math.log10(1 + 4000 / 700)
    hz = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    assert len(got) == 5  # 450 samples, frames of 200 every 80
    for f in range(len(got)):
        frame = [y[f * 80 + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / 199)) if f * 80 + i < len(y) else 0.0 for i in range(200)]
        power = [abs(sum(v * np.exp(-2j * math.pi * b * i / 256) for i, v in enumerate(frame))) ** 2 for b in range(129)]
        for m in range(audio.MELS):
            lo, mid, hi = hz[m : m + 3]
            e = sum(p * max(0, min((b * 8000 / 256 - lo) / (mid - lo), (hi - b * 8000 / 256) / (hi - mid))) for b, p in enumerate(power))
            assert got[f, m] == pytest.approx(math.log(max(e, 1e-6)), abs=2e-3)


def test_pieces_do_not_show(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    whole = audio.log_mel(data)
    monkeypatch.setattr(audio, "PIECE", 100)
    assert np.allclose(audio.log_mel(data), whole, atol=1e-4)


def test_hysteresis():
    energy = np.array([0, 0.5, 0.8, 0.5, 0.1, 0.6, 0.2, 1.0, 0.46, 0.44])
    assert audio.segments(energy).tolist() == [[2, 4], [7, 9]]
    assert audio.segments(np.ones(5)).tolist() == [[0, 5]]


def test_text_as_audio(docs, none):
    got = audio.text_as_audio(docs).collect()
    assert len(got) == len(TEXTS)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert by_id[1][0] == by_id[1][1]
    for i, t in TEXTS:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = by_id[i][0]
        media = audio.to_wav(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert audio.text_as_audio(none).count() == 0


def test_tensors(spark):
    tone = (128 + 100 * np.sin(np.arange(16_000) / 5)).astype(np.uint8)
    quiet = np.full(8_000, 128, np.uint8)
    media = audio.to_wav(np.concatenate([quiet, tone, quiet]).tobytes())
    df = spark.createDataFrame([(1, bytearray(media)), (2, None), (None, bytearray(media))], "doc_id long, media binary")
    rows = audio.audio_tensors(df, media="media", key="doc_id").toArrow()
    assert rows.filter(pa.compute.is_null(rows["doc_id"])).num_rows == rows.num_rows // 2
    one = rows.filter(pa.compute.equal(rows["doc_id"], 1)).to_pylist()
    assert 0.45 < one[0]["start_s"] < 0.55 and 1.45 < one[-1]["end_s"] < 1.6
    tensor = audio.to_tensor(rows["tensor"])
    assert tensor.type.shape == [audio.FRAMES, audio.MELS] and len(tensor) == rows.num_rows


# -- language


def test_language(spark, docs, none):
    words = {"aa": "kala nama tala rama", "bb": "zyx wyvern qux phlyx", "cc": "øre æble åben"}
    rows = [(i, f"{words[k]} " * (i % 5 + 1), k) for i, k in enumerate(list(words) * 30)] + [(999, "kala", None), (998, None, "aa")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(train)
    assert filters.languages == ["aa", "bb", "cc"]
    test = spark.createDataFrame([(1, "Rama kala"), (2, "WYVERN phlyx"), (3, "åben øre"), (4, None), (5, "123 !?"), (6, ""), (None, "nama" * 9000), (6, "")], "doc_id long, text string")
    got = language.identify(test, filters).collect()
    assert [r.lang_pred for r in got] == ["aa", "bb", "cc", "und", "und", "und", "aa", "und"] and all(0 <= r.score <= 1 for r in got)
    assert language.identify(none, filters).count() == 0
    empty = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def brute_grams(text):
    """2- and 3-grams of the lower-cased letters, other characters between them being one space; as a list."""
    letters = "".join(c.lower() if c.isalpha() else " " for c in text or "")
    line = re.sub(" +", " ", " " + letters)
    return [line[i : i + n] for n in (2, 3) for i in range(len(line) - n + 1)] if line.strip() else []


def test_languages_match_brute_force(spark):
    """More languages than a 64-bit word has bits; sets of n-grams in place of the filters."""
    rng = np.random.default_rng(11)
    names = [f"l{i:02d}" for i in range(80)]
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(3, 8))) for _ in range(12)] for k in names}
    rows = [(i, " ".join(rng.choice(words[k], 6)) + "! " * (i % 2), k) for i, k in enumerate(names * 6)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == names and len(filters.slots) == 2
    holds = {}
    for k in names:
        mine = Counter(g for _, t, lang in rows if lang == k for g in set(brute_grams(t)))
        holds[k] = {g for g, n in mine.items() if n >= 2}
    texts = [" ".join([*rng.choice(words[k], 4), *rng.choice(words[names[0]], 2)]) for k in names]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), filters).orderBy("doc_id").collect()
    near = 0
    for r, text in zip(got, texts, strict=True):
        share = Counter()
        for g in brute_grams(text):
            have = [k for k in names if g in holds[k]]
            for k in have:
                share[k] += np.log(81 / len(have))
        top = share.most_common(2)
        assert share[r.lang_pred] >= 0.97 * top[0][1]
        near += r.lang_pred == top[0][0]
    assert near >= 78


def test_filters_return_all_languages():
    """No false negatives, and false positives as often as is reckoned."""
    rng = np.random.default_rng(3)
    h, of = rng.integers(0, 1 << 63, 9000).astype(np.uint64), rng.integers(0, 70, 9000)
    of[of == 1] = 2
    of[:4000] = 1
    filters = language.filters_of([str(i) for i in range(70)], np.concatenate([of, of[4000:] * 0 + 69]), np.concatenate([h, h[4000:]]))
    masks = filters.masks(h)
    assert (masks[of // 64, np.arange(9000)] >> (of % 64).astype(np.uint64) & np.uint64(1)).all()
    assert (masks[1, 4000:] >> np.uint64(5) & np.uint64(1)).all()
    other = filters.masks(rng.integers(0, 1 << 63, 400_000).astype(np.uint64))
    assert abs((other[0] >> np.uint64(1) & np.uint64(1)).mean() - filters.false_rate[1]) < 0.001 and filters.false_rate[1] > 0


def test_grams_do_not_cross_texts():
    one = Counter(language.grams(pa.array(["ab c", "dé"]))[0].tolist())
    two = Counter(language.grams(pa.array(["ab c"]))[0].tolist()) + Counter(language.grams(pa.array(["dé"]))[0].tolist())
    assert sum((one - two).values()) <= 0 or set(one) == set(two)


# -- personal data: spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(digits[0::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m)) % 10 == 0]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+-( é20", max_size=60))
def test_spans_match_the_patterns(text):
    assert pii.find(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x@y.zz", "@", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-99", " ", "a.b@c", "-", "+", "00000000000000000", "+49 30 1234567"]), max_size=10))
def test_spans_of_joined_values(parts):
    text = "".join(parts)
    assert pii.find(text) == plain_spans(text)


def test_spans_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "0" * 6000 + "1.2.3.4"):
        pii.find(text)


# -- tokens


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


MIXED = st.text(alphabet="ab zÉß1'.\n\t -s <|>\u00a0\x1c🙂", max_size=80)


@settings(max_examples=300, deadline=None)
@given(text=MIXED)
def test_ids_are_those_of_the_tokenizer(exact, text):
    assert np.frombuffer(tokens.encoder().encode([text, None, text])[0], "<u4").tolist() == exact(text)
    assert sum(tokens.leaves(text, tokens.encoder())[1]) == len(exact(text))


@settings(max_examples=200, deadline=None)
@given(text=MIXED.map(lambda t: t * 5), edits=st.lists(st.tuples(st.integers(-2, 420), st.integers(0, 60), MIXED.map(lambda t: t[:12])), max_size=5))
def test_edits_count_as_a_recount(exact, text, edits):
    enc = tokens.encoder()
    tree = tokens.Tree(*tokens.leaves(text, enc))
    for start, n, new in edits:
        low = min(max(start, 0), len(text))
        expected = text[:low] + new + text[min(max(start + n, low), len(text)) :]
        text, tree, _ = tokens.edit(text, tree, start, start + n, new, enc)
        assert text == expected and tree.n_tokens == len(exact(text)) and tree.n_chars == len(text)


def test_an_edit_is_local():
    enc, text = tokens.encoder(), "some words stand here, and more of them. " * 2000
    tree = tokens.Tree(*tokens.leaves(text, enc))
    assert tokens.edit(text, tree, 40_000, 40_003, "x", enc)[2] < 500
    long = tokens.edit(text, tree, 10, 10, "new words " * 2000, enc)
    assert long[1].n_tokens == enc.counts([long[0]])[0]


def test_little_room_changes_nothing(monkeypatch, exact):
    monkeypatch.setattr(tokens, "KEPT", 3)
    for text in ("one two three four five six", "six seven  eight"):
        assert np.frombuffer(tokens.encoder().encode([text])[0], "<u4").tolist() == exact(text)


def test_counting_frames(spark, docs, none, exact):
    edits = spark.createDataFrame([(1, 2, 0, 5, "Many"), (1, 1, 5, 5, " more"), (3, 1, 0, 0, "new"), (77, 1, 0, 0, "lost"), (None, 1, 0, 0, "lost"), (4, 1, None, None, None)], "doc_id long, seq int, start long, end long, text string")
    joined = tokens.collect_edits(docs, edits)
    assert joined.count() == len(TEXTS)
    got = {r.doc_id: r for r in tokens.apply_edits(tokens.count_tokens(joined)).collect()}
    assert got[1].text == "Many more words here." and got[3].text == "new" and got[2].text == "" and got[None].n_edits == 0
    assert all(r.n_tokens == len(exact(r.text)) == sum(r.leaf_tokens) for r in got.values())
    assert tokens.count_tokens(none).count() == 0


# -- packing


def test_first_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 30, rng.integers(1, 60))
        bins, at = packing.first_fit_decreasing(lengths, 30)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(30)
            assert (bins[i], at[i]) == (b, 30 - room[b])
            room[b] -= lengths[i]


def test_packing_frames(docs, none, exact):
    rows = packing.pack_documents(docs, length=64, group=2, keep_ids=True).collect()
    per, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    for i, t in TEXTS:
        if i != 1:
            assert [x for r in sorted(per[i], key=lambda r: r.start) for x in r.ids] == [*exact(t or ""), packing.EOS]
    assert len(per[1]) == 2 and packing.pack_documents(none).count() == 0


def test_equal_rows_spread_over_groups(spark, exact):
    text = "equal words " * 40
    rows = [(None, text)] * 9000 + [(i, f"text {i} " * (i % 60)) for i in range(9000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    assert len(got) == 18_000 and got.ids_crc32.isin([zlib.crc32(np.array([*exact(text), packing.EOS], "<u4").tobytes())]).sum() >= 9000
    per_group = got.groupby(got.sequence_id // (1 << 32)).size()
    assert len(per_group) == 5 and per_group.max() < 1.2 * packing.GROUP
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= packing.LENGTH
    assert got.length.sum() / (got.sequence_id.nunique() * packing.LENGTH) > 0.97


def test_full_pieces_are_sequences_by_themselves(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "word " * 50_000), (2, "few words")], "doc_id long, text string")).collect()
    full = [r for r in got if r.length == packing.LENGTH]
    assert len(full) > 20 and all(r.offset == 0 and r.sequence_id < 0 for r in full) and len({r.sequence_id for r in full}) == len(full)
    assert len({r.sequence_id for r in got if r.sequence_id >= 0}) == 1


# -- toxicity


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}x" for k in "abcdefghijklmnopqrstuvwxyz"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = [str(w) for w in rng.choice(words, 30)]
        if bad:
            text += [str(x) for x in rng.choice(["grobian", "grobschaft", "snurfel"], 2)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (5, 0), (12345, 1)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    return model, rows, labels


def test_toxicity(spark, model, docs, none):
    model = model[0]
    df = spark.createDataFrame([(1, "wax Grobian wbx"), (2, "wax wbx wcx"), (3, ""), (4, None), (5, "snurfel! " * 5000), (5, "snurfel! " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[5].predicted == 1 and got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got.values())
    assert len(got[1].evidence) == toxicity.K
    assert toxicity.score_documents(none, model).count() == 0
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == len(TEXTS) and set(docs.columns) <= set(scored.columns)
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}


def greatest(labels):
    """Of several labels of an id the largest."""
    return {i: y for i, y in sorted((i, y) for i, y in labels if i is not None and y is not None)}


def brute_votes(rows, labels, queries):
    """Plain TF-IDF with the weights of labels, cosines and votes; queries are (text, id to leave out)."""
    label = greatest(labels)
    texts = {i: t for i, t in rows if i in label}
    bags = {i: Counter(toxicity.WORD.findall(t.lower())) for i, t in texts.items()}
    n = len(bags)
    have = Counter(w for b in bags.values() for w in b)
    n1 = Counter(w for i, b in bags.items() if label[i] for w in b)
    ones = sum(label[i] for i in bags)

    def scale(w):
        k1, k0 = n1[w], have[w] - n1[w]
        odds = math.log((k1 + 0.5) / (ones + 1)) - math.log((k0 + 0.5) / (n - ones + 1))
        z = odds / math.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))
        mark = min(1, max(0, (z - toxicity.MARKS[0]) / (toxicity.MARKS[1] - toxicity.MARKS[0]))) if have[w] else 0
        return math.log((n + 1) / (have[w] + 0.5)) * (toxicity.ORDINARY + (1 - toxicity.ORDINARY) * mark)

    def weigh(bag):
        w = {t: (1 + math.log(c)) * scale(t) for t, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors, out = {i: weigh(b) for i, b in bags.items()}, []
    for text, but in queries:
        q = weigh(Counter(toxicity.WORD.findall(text.lower())))
        near = sorted((-min(1, round(sum(x * v.get(t, 0) for t, x in q.items()), 6)), i) for i, v in vectors.items() if i != but)[: toxicity.K]
        near = [(-c, i) for c, i in near if c < 0]
        w = [1 / (1 - c + toxicity.SOFTEN) for c, _ in near]
        out.append(([i for _, i in near], sum(x * label[i] for x, (_, i) in zip(w, near, strict=True)) / sum(w) if w else None))
    return out


def test_scores_match_brute_force(model):
    model, rows, labels = model
    queries = [t for _, t in rows[:40]] + ["grobian", "snurfel snurfel wax", "wax " * 50 + "grobschaft", "nothing wax known"]
    expected = brute_votes(rows, labels, [(t, None) for t in queries])
    got = model.index.votes([toxicity.vector(t) for t in queries])
    for (ids, vote), (own_vote, own_ids) in zip(expected, got, strict=True):
        assert own_ids == ids and own_vote == pytest.approx(vote, abs=1e-4)
    left_out = brute_votes(rows, labels, [(t, i) for i, t in rows])
    label = greatest(labels)
    x, y = toxicity.isotonic(np.array([v for _, v in left_out]), np.array([float(label[i]) for i, _ in rows]))
    assert np.allclose([model.level(v) for _, v in left_out], np.interp([v for _, v in left_out], x, y), atol=0.01)


def test_bounds_skip_blocks_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    kinds = [[f"{k}{c}{d}" for c in "abcdefgh" for d in "abcdefgh"] for k in "uvxyz"]
    texts = [" ".join(rng.choice(kinds[i % 5], 25)) + f" own{i % 90}" for i in range(600)]
    made = [toxicity.vector(t) for t in texts]
    args = np.arange(600), rng.integers(0, 2, 600).astype(float), np.array([len(h) for h, _ in made]), *toxicity.terms_of(np.concatenate([h for h, _ in made])), np.concatenate([n for _, n in made]), np.ones(600)
    index = toxicity.build(*args)
    got = index.nearest(made)
    assert index.skipped > index.compared
    monkeypatch.setattr(toxicity, "FIRST", 10_000)  # all blocks at once
    whole = toxicity.build(*args)
    for (a, x), (b, y) in zip(got, whole.nearest(made), strict=True):
        assert index.ids[a].tolist() == whole.ids[b].tolist() and np.allclose(x, y, atol=2e-6)


def test_a_text_near_all_blocks_reads_a_run_for_each_term(monkeypatch):
    rng = np.random.default_rng(9)
    names = [a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefghijklmn"]
    made = [toxicity.vector(" ".join(rng.choice(names, 25))) for _ in range(900)]  # all words rare, and alike in all blocks
    args = np.arange(900), np.arange(900) % 2.0, np.array([len(h) for h, _ in made]), *toxicity.terms_of(np.concatenate([h for h, _ in made])), np.concatenate([n for _, n in made]), np.ones(900)
    index, runs, spread = toxicity.build(*args), [], toxicity.spread
    monkeypatch.setattr(toxicity, "spread", lambda first, n: runs.append(len(first)) or spread(first, n))
    got = index.nearest(made[:50])
    assert len(index.dense) == 0 and index.compared > index.skipped
    entries = sum(int((index.first[t + 1] - index.first[t]).sum()) for t, _ in map(index.weigh, made[:50]))
    assert sum(runs) < entries  # as many as the entries, if each entry were a run
    monkeypatch.setattr(toxicity, "WHOLE", 0)  # by entry alone
    for (a, x), (b, y) in zip(got, index.nearest(made[:50]), strict=True):
        assert np.array_equal(a, b) and np.array_equal(x, y)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from("aB \n_1'\u00c9\u00df\u0130\u00b2\u00bd\u0663\u00a0\u2028\x1c\x85\u0301")), max_size=60))
def test_words_split_as_bytes_are_those_of_the_pattern(text):
    got = [w.decode() if isinstance(w, bytes) else w for w in toxicity.words_of(text)]
    assert got == toxicity.WORD.findall(text.lower())
    hashes, counts = toxicity.vector(text)
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == Counter(toxicity.xxhash.xxh3_64_intdigest(w.encode()) for w in got)


def test_words_of_common_text_are_split_as_bytes():
    assert toxicity.words_of("Grüße an ALLE, l'été 2024_x") == [w.encode() for w in ("grüße", "an", "alle", "l", "été", "x")]
    assert toxicity.words_of("m² — \ud800 ja") == ["m²", "ja"]  # other characters: by the pattern


def test_a_worker_makes_the_index_in_little_more_than_it_takes(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 5000, raising=False)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.zipf(1.3, 300) % 20_000) for _ in range(2000)]
    words, of = toxicity.terms_of(np.concatenate(sets).astype(np.uint64))
    index = toxicity.build(np.arange(2000), np.arange(2000) % 2.0, np.array([len(x) for x in sets]), words, of, rng.integers(1, 4, len(of)), np.ones(2000))
    postings = len(index.example)
    index = pickle.loads(pickle.dumps(index))
    tracemalloc.start()
    try:
        index.expand()
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most - kept < 8 * postings
    term = np.repeat(np.arange(len(index.first) - 1), np.diff(index.first))  # of each entry
    size = np.diff(index.postings)
    place = np.split(index.place, index.postings[1:-1])
    assert (size > 0).all() and len(index.place) == index.postings[-1] and (index.column[term] < 0).all()
    assert all((p // toxicity.BLOCK == b).all() for p, b in zip(place, index.block.tolist(), strict=True))
    assert len({*zip(term.tolist(), index.block.tolist(), strict=True)}) == len(term)
    assert np.array_equal(index.most, [w.max() for w in np.split(index.weight, index.postings[1:-1])])


def test_a_copy_is_nearest_to_its_example(model):
    model, rows, _ = model
    texts = dict(rows)
    for i in (1, 2, 3, 4, 6, 5, 10):  # without marks, and with some
        (found, cosines), = model.index.nearest([toxicity.vector(texts[i])])
        assert model.index.ids[found[0]] == i and cosines[0] == 1 > cosines[1]


def test_a_capped_label_keeps_its_share(spark, model):
    _, rows, labels = model
    learn = lambda n: toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:400], "doc_id long, toxic int"), sample=n)
    whole, capped = learn(400), learn(80)  # 320 and 80 rows
    index = capped.index
    assert len(index.ids) == 160 and whole.empty_score == pytest.approx(0.2) and capped.empty_score == pytest.approx(0.2)
    raw = [index.vote(*index.nearest([toxicity.vector(dict(rows)[i])], [k])[0]) for k, i in enumerate(index.ids.tolist())]
    assert np.average([capped.level(x) for x in raw], weights=index.stands) == pytest.approx(0.2, abs=0.03)


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]
    for labels in ([1, 1, 0, 1, 1, 1], [0, 1, 1, 1, 1, 1]):  # ties are one point, in any order
        x, y = toxicity.isotonic(np.ones(6), np.array(labels, float))
        assert x.tolist() == [1] and y.tolist() == [pytest.approx(5 / 6)]
    assert toxicity.isotonic(np.array([0.5] * 4), np.array([0, 0, 1, 1.0]))[1].tolist() == [0.5]


# -- templates

ITEM = "A train leaves Bonn with 120 people and after 3 hours it carries 45 boxes more than the slow one from Anna Maria did before."


def held(spark, items, texts):
    """Ids of the items that each text holds."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [h["item"] for h in r.hits] for r in decontam.contamination(docs, bench).collect()}
    return [got[i] for i in range(len(texts))]


def test_templates_catch_new_parameters(spark, none):
    changed = ITEM.replace("Bonn", "Oslo").replace("120", "77").replace("45", "9,5").replace("Anna Maria", "Peter")
    other = "A boat leaves quietly and nobody on board knows where the old captain wants to go after the storm of last night."
    odd = "A train leaves Bonn with 120 people and after 3 hours. " + "Words of no kind. " * 20
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, other), (3, "too short"), (4, None), (None, ITEM), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Before. " + ITEM + " Behind."), (2, f"x {changed} y"), (3, ITEM.upper()), (4, odd), (5, None), (6, ""), (7, "much too short"), (8, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (9, "w " * 20_000 + other), (9, "w " * 20_000 + other), (None, other), (10, "Too short!")],
        "doc_id long, text string",
    )
    got = defaultdict(list)
    for r in decontam.contamination(docs.withColumn("hits", docs.doc_id), bench).collect():
        got[r.doc_id].append(sorted(h["item"] for h in r.hits))
    assert got == {1: [[1]], 2: [[1]], 3: [[1]], 4: [[]], 5: [[]], 6: [[]], 7: [[]], 8: [[]], 9: [[2], [2]], None: [[2]], 10: [[3]]}
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_slots_map_one_to_one(spark):
    item = "If 5 birds sit on the fence and 5 more come while 5 others go home then how many of the 5 are left there?"
    same, mixed = item.replace("5", "8"), item
    for n in ("1", "2", "3", "4"):
        mixed = mixed.replace("5", n, 1)
    apples = "Anna puts 5 red apples into the basket and takes 7 green pears out of the other basket near the door"
    merged = apples.replace("5", "9").replace("7", "9")
    assert held(spark, [(1, item), (2, apples)], [same, mixed, apples, merged, apples.replace("5", "9").replace("7", "4"), apples.replace("5", "7").replace("7 g", "5 g")]) == [[1], [], [2], [], [2], [2]]


def test_each_occurrence_is_judged_by_itself(spark):
    item = "If 5 birds sit on the fence and 5 more come while 5 others go home then how many of the 5 are left there?"
    texts = [between.join(item.replace("5", v) for v in values) for values in ("58", "8855", "56789", "6789") for between in (" ", " And now for some other words. " * 30)]
    texts.append(" ".join(item.replace("5", v).replace("come while", "come by and by while") for v in "6789"))
    assert held(spark, [(1, item)], texts) == [[1]] * len(texts)


SHORT = [
    (1, "12 + 7 = 19, 19 * 3 = 57, 57 - 8 = 49, 49 / 7 = 7"), (2, "1914 1918 1939 1945 1989"), (3, "3 4 5 6 7 8 9 10 11"), (4, "on 12 7 1999 9 11 2001 5 8 2010 and 3 3 2020"), (5, "12 34 + 56 78 = 90 12 34"), (6, "Name three."),
    (7, "Paris Berlin Rome Madrid Oslo Vienna Prague Lisbon"), (8, "42"), (9, "Who is Zaphod Beeblebrox?"),
]


def test_no_item_is_left_out(spark):
    copies = held(spark, SHORT, [f"Some words before.\n{text}\nAnd behind." for _, text in SHORT])
    assert copies == [[i] for i, _ in SHORT]
    changed = ["13 + 7 = 20 and 50 more", "1914 1918 1939 1946 1989", "1 2 3 4 5 6 7 8 9 10 11 12", "They name three of them.", "Rome Paris Oslo Berlin Lisbon Vienna Madrid Prague", "There are 42 of them", "34 12 + 78 56 = 90 12 34"]
    assert held(spark, SHORT, changed) == [[]] * len(changed)
    assert all(decontam.item_windows(t) for _, t in SHORT)


def brute_held(item, text):
    """For items and texts without slots or repeated windows: the cover by plain words, and the longest run."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    a, b = words(item), words(text)
    have = {tuple(a[i : i + 8]): i for i in range(len(a) - 7)}
    hits = [(p, have[w]) for p in range(len(b) - 7) if (w := tuple(b[p : p + 8])) in have]
    step = max(len(a) // 2, 16)
    by, runs = defaultdict(set), Counter()
    for p, q in hits:
        for k in (0, 1):
            by[(p - q) // step - k].add(q)
        runs[p - q] = runs[p - q] + 1
    return any(len(s) / len(have) >= decontam.COVER for s in by.values()) or any(n >= decontam.RUN for n in runs.values())


def test_covers_match_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(400)]
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(10, 90, 25))]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.integers(1, 5)):
            one = items[rng.integers(len(items))][1].split()
            a = rng.integers(len(one))
            parts += [*rng.choice(words, rng.integers(0, 40)), *one[a : a + rng.integers(1, 60)]]
        texts.append(" ".join(parts))
    expected = [[i for i, t in items if brute_held(t, text)] for text in texts]
    assert held(spark, items, texts) == expected and 20 < sum(map(bool, expected)) < 80


def test_a_long_run_of_a_long_item_is_enough(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(200)]
    texts = ["Before " + " ".join(words[80:120]) + " behind", " ".join(words[80:100]), " ".join(words[80:99]), " and ".join(" ".join(words[k : k + 15]) for k in (10, 50, 90))]
    assert held(spark, [(1, " ".join(words))], texts) == [[1], [1], [], []]


def test_a_long_item_is_judged_in_segments(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", 20)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(200)]
    assert {r[1] for r in decontam.item_windows(" ".join(words))} == set(range(0, 193, 20))


def test_benchmark_meets_documents_in_a_join(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(50)], "item_id long, text string")
    items = decontam.items_of(bench.selectExpr("item_id AS i", "text AS t"))
    bits = decontam.key_bits(items, "h", decontam.LOG2_BITS)
    windows = decontam.documents_of(docs.selectExpr("1L AS k1", "2L AS k2", "text AS t"), bits, [(8, False)])
    plan = windows.join(items, "h")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and decontam.contamination(docs, bench).where("contaminated").count() == 1
